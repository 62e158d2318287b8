"""License scans: Dice coefficient over word bigrams of normalised text against license templates.

Templates are notices, standard headers and whole license texts. A passage is a line, the whole text of a
document, or a run of its words, across lines, as long as the template or 0.8 or 1.25 times as long. A
passage of a bigrams and a template of b can only reach the threshold t if they share t / (2 - t) b of them.
Documents that do not hold so many of a template's bigrams anywhere are dropped for that template first; of
the others, only the bigrams shared with it are placed.

Runs are scored by a running sum: the occurrence of a bigram at p that a template holds c times counts for
the runs that begin after its c-th occurrence before p, at most the run's length before p, and not after p.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import texts
from clickloom.state import settle

THRESHOLD = 0.8
# Wording of common license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

#: Standard headers, and notices of licenses without one above.
HEADERS = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "This project is licensed under the terms of the BSD 2-Clause license.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software "
        "Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "ISC": [
        "This project is licensed under the terms of the ISC license.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software "
        "Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
#: Lengths of runs of words, as shares of the template's.
SPANS = (1.0, 0.8, 1.25)


def all_templates() -> dict[str, list[str]]:
    """Notices, headers and the whole texts in ``licenses/``, a file per license. Read on the driver only."""
    out = {name: [*TEMPLATES.get(name, []), *HEADERS.get(name, [])] for name in {**TEMPLATES, **HEADERS}}
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        out.setdefault(file.stem, []).append(file.read_text(encoding="utf-8"))
    return out


def normalised(text: Column) -> Column:
    """Lower case; every run of other than letters and digits is one blank; none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def template_rows(templates: dict[str, list[str]]) -> list[tuple[str, int, str, int, int]]:
    """(license, wording number, bigram, its count, bigrams of the wording) of fixed wordings."""
    rows = []
    for name, wordings in templates.items():
        for i, wording in enumerate(wordings):
            words = re.sub(r"[\W_]+", " ", wording.lower()).strip().split(" ")
            pairs = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
            rows += [(name, i, pair, n, len(words) - 1) for pair, n in sorted(pairs.items())]
    return rows


def word_list(text: Column) -> Column:
    return F.filter(F.split(normalised(text), " "), lambda x: x != "")


def neighbours(words: Column | str, join) -> Column:
    """``join`` of every element of an array and the next one."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), join)


def runs_of_words(matches: DataFrame) -> DataFrame:
    """(row, template, both, p_size, t_size, license, line) of runs that begin with a shared bigram; no better ones begin elsewhere."""
    spots = matches.groupBy("row", "template", "pid").agg(
        F.sort_array(F.collect_list(F.struct("pos", "begins"))).alias("at"),
        *[F.first(c).alias(c) for c in ("t_count", "t_size", "license", "n_pairs")],
    )
    spans = F.array_distinct(F.array(*[F.greatest(F.round(F.col("t_size") * x).cast("int"), F.lit(1)) for x in SPANS]))
    spots = spots.withColumn("span", F.explode(spans))

    def steps(x, i):
        first = F.greatest(F.coalesce(F.get(F.col("at"), i - F.col("t_count"))["pos"], F.lit(-1)), x["pos"] - F.col("span")) + 1
        no_line = F.lit(None).cast("int")
        step = lambda at, n, line: F.struct(at.alias("start"), F.lit(n).alias("step"), line.alias("line"))
        return F.array(step(first, 1, no_line), step(x["pos"], 0, x["begins"]), step(x["pos"] + 1, -1, no_line))

    key = ["row", "template", "span"]
    events = spots.select(*key, "t_size", "license", "n_pairs", F.explode(F.flatten(F.transform("at", steps))).alias("e"))
    at = events.groupBy(*key, "e.start").agg(
        F.sum("e.step").alias("step"), F.max("e.line").alias("line"), *[F.first(c).alias(c) for c in ("t_size", "license", "n_pairs")]
    )
    both = F.sum("step").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("both", both).where("line is not null").select(
        "row", "template", "both", F.least("span", F.col("n_pairs") - F.col("start")).alias("p_size"), "t_size", "license", "line"
    )


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Per document: n_lines, n_hits (lines that match by themselves), license, best_dice, best_line (of the best passage).

    Repeated bigrams count as often as both sides hold them. The best passage has the greatest
    coefficient; ties go to the first license by name, then to lines and the whole text before runs of
    words, then to the first line. ``best_line`` counts from 0, -1 stands for the whole text of several
    lines; of a run of words it is the line in which it begins. Documents without a match have nulls there.
    Null texts are one empty line; passages of fewer than two words match nothing. Every row is a
    document of its own; rows equal in id and text get equal results.
    """
    wordings = template_rows(templates or all_templates())
    ids = {key: i for i, key in enumerate(dict.fromkeys((r[0], r[1]) for r in wordings))}
    pids = {pair: i for i, pair in enumerate(dict.fromkeys(r[2] for r in wordings))}
    # A fixed list of wordings, some ten thousand rows whatever the documents are.
    known = docs.sparkSession.createDataFrame(
        [(ids[r[0], r[1]], r[0], r[2], pids[r[2]], r[3], r[4]) for r in wordings],
        "template int, license string, pair string, pid int, t_count int, t_size int",
    )
    keyed = texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    # Rows and templates that can match at all: of all bigrams of a document, without their numbers and places.
    held = keyed.select("row", word_list(F.col("text")).alias("words"))
    pairs = F.array_distinct(neighbours("words", lambda a, b: F.concat_ws(" ", a, b)))
    possible = settle(
        held.select("row", F.explode(pairs).alias("pair")).join(F.broadcast(known), "pair")
        .groupBy("row", "template").agg(F.sum("t_count").alias("most"), F.first("t_size").alias("t_size"))
        .where(F.col("most") >= F.col("t_size") * (threshold / (2 - threshold)) - 1e-9).select("row", "template"),
        "license_possible",
    )
    mine = keyed.join(possible.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    of_line = lambda x, i: F.struct(i.alias("line"), word_list(x).alias("words"))
    lines = mine.select("row", F.transform(F.split("text", "\n", -1), of_line).alias("lines"))
    spread = lambda x: F.transform(x["words"], lambda w: F.struct(x["line"].alias("line"), w.alias("word")))
    flat = lines.select("row", F.transform("lines", lambda x: F.size(x["words"]) - 1).alias("sizes"), F.flatten(F.transform("lines", spread)).alias("words"))
    joined = neighbours("words", lambda a, b: F.struct(
        F.concat_ws(" ", a["word"], b["word"]).alias("pair"), a["line"].alias("begins"), F.when(a["line"] == b["line"], a["line"]).alias("line")
    ))
    placed = flat.select("row", "sizes", (F.size("words") - 1).alias("n_pairs"), F.posexplode(joined).alias("pos", "p"))
    matches = settle(
        placed.select(
            "row", "n_pairs", "pos", "p.*", F.get(F.col("sizes"), F.col("p.line")).alias("line_size"), (F.size("sizes") > 1).alias("several")
        ).join(F.broadcast(known), "pair").join(possible, ["row", "template"]).drop("pair"),
        "license_matches",
    )
    fixed = lambda *names: [F.first(c).alias(c) for c in names]
    passages = (
        matches.where("line is not null").select("row", "template", "pid", "line", F.col("line_size").alias("p_size"), "t_count", "t_size", "license")
        .unionByName(matches.where("several").select(
            "row", "template", "pid", F.lit(-1).alias("line"), F.col("n_pairs").alias("p_size"), "t_count", "t_size", "license"
        ))
        .groupBy("row", "template", "line", "pid").agg(F.count(F.lit(1)).alias("p_count"), *fixed("p_size", "t_count", "t_size", "license"))
        .groupBy("row", "template", "line").agg(F.sum(F.least("p_count", "t_count")).alias("both"), *fixed("p_size", "t_size", "license"))
    )
    scored = passages.withColumn("run", F.lit(0)).unionByName(runs_of_words(matches).withColumn("run", F.lit(1)))
    matched = scored.withColumn("dice", 2 * F.col("both") / (F.col("p_size") + F.col("t_size"))).where(F.col("dice") >= threshold)
    best = F.min(F.struct((-F.col("dice")).alias("less"), "license", "run", "line"))
    whole_lines = F.when((F.col("run") == 0) & (F.col("line") >= 0), F.col("line"))
    hits = matched.groupBy("row").agg(best.alias("best"), F.count_distinct(whole_lines).alias("n_hits"))
    rows_of = keyed.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first(F.size(F.split("text", "\n", -1))).cast("bigint").alias("n_lines"), F.count(F.lit(1)).alias("rows")
    )
    out = rows_of.join(hits, "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(
        "doc_id", "n_lines", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.col("best.license").alias("license"),
        (-F.col("best.less")).alias("best_dice"), F.col("best.line").cast("bigint").alias("best_line"),
    )
