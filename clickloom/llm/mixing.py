"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Every source gets a share of all words by its weight; no target exceeds ``max_epochs`` times the
source's own words, and what a clamped source leaves is shared by weight among the others. A source
then repeats each document ``floor(target / words)`` times, and the rest of its target is filled with
whole documents in seeded order, the last of them cut.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from clickloom.llm.common import WORD, hot_join, numbered
from clickloom.state import settle

#: A source's documents are laid out in 2**BUCKET_BITS buckets of seeded hash values.
BUCKET_BITS = 14
SEED = 17


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the closed form of water-filling.

    Weights go round in code point order of the sources, null last. Sources are clamped in order of
    cap / weight: source k is clamped when its cap is below its share of what the sources before it
    left. One row per source passes through the windows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    weighed = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    placed = weighed.withColumn("level", level).withColumn("clamped", F.col("cap") <= F.col("w") * F.col("level"))
    # Once a source is not clamped, none after it is: its level is the water's height.
    height = F.max(F.when(~F.col("clamped"), F.col("level"))).over(everything)
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.least("cap", F.col("w") * height))
    return placed.select("source", "source_size", target.alias("target"))


def placed_rows(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Column]:
    """What decides a row's place in the mix: doc_id, source, size, row, key, h and bucket.

    ``row`` is the hash of id and text, ``key`` stands for the source, null too: joins then need no
    null-safe condition. ``h`` orders a source's documents, ``bucket`` is its top bits.
    """
    doc_id, source = F.col(id_col).cast("bigint"), F.col(source_col).cast("string")
    row = F.xxhash64(doc_id, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    h = F.xxhash64(F.lit(seed), doc_id, row)
    return [
        doc_id.alias("doc_id"), source.alias("source"), word_count(text_col).alias("size"), row.alias("row"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"), h.alias("h"),
        F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int").alias("bucket"),
    ]


def _planned(placed: DataFrame, weights: Sequence[float], max_epochs: float, share: float) -> DataFrame:
    """One written row per source: target, whole repetitions, and where its extra repetition ends.

    ``cut`` is the bucket in which the extra words run out, ``left`` what is left of them there; buckets
    below it are taken whole. Null where they do not run out.
    """
    per_bucket = settle(
        placed.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix_buckets"
    )
    per_source = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = (
        source_targets(per_source, weights, max_epochs, share)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("extra", F.round(F.col("target")).cast("bigint") - F.col("whole") * F.col("source_size"))
        .withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        .drop("source")
    )
    targets = settle(targets, "mix_targets")
    run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        per_bucket.withColumn("upto", F.sum("words").over(run))
        .join(targets.select("key", "extra"), "key")
        .where((F.col("upto") - F.col("words") < F.col("extra")) & (F.col("upto") >= F.col("extra")))
        .select("key", F.col("bucket").alias("cut"), (F.col("extra") - F.col("upto") + F.col("words")).alias("left"))
    )
    rows_of = per_bucket.groupBy("key").agg(F.sum("n").alias("n"))
    return settle(targets.join(cuts, "key", "left").join(rows_of, "key"), "mix_plan")


#: Documents of one bucket in seeded order; a null id comes first.
ORDER = ("h", "doc_id", "row", "size")


def _words_upto() -> Column:
    ranked = Window.partitionBy("key").orderBy(*ORDER)
    return F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _in_reach() -> Column:
    """Words that the extra repetition takes of a document outside the cut bucket."""
    return F.when(F.col("extra") <= 0, 0).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), F.col("size")).otherwise(0)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: float = 3.0,
    share: float = 1.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, row, source, size, source_size, target, whole, taken): the words each document gives to the mix.

    ``taken = whole * size`` plus one more repetition, whole or (for one document per source) cut. It
    never exceeds ``ceil(max_epochs)`` times the size, and each source's sum is its target rounded.
    A null text has no words; a null source is a source. Rows that repeat an id are documents of their
    own; rows equal in id, text and source are told apart only by place in the seeded order, so reruns
    agree in every row's values. ``row`` is the hash of id and text.
    """
    placed = settle(docs.select(*placed_rows(docs, seed, id_col, text_col, source_col)), "mix_sizes")
    plan = _planned(placed, weights, max_epochs, share)
    joined = hot_join(placed, plan, ["key"], "n", ["doc_id", "row"])
    at_cut = F.col("bucket") == F.col("cut")
    columns = ["doc_id", "row", "source", "size", "source_size", "target", "whole"]
    # Only the documents of one bucket per source are ranked.
    edge = (
        joined.where(at_cut)
        .withColumn("upto", _words_upto())
        .withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("upto") + F.col("size"))))
    )
    rest = joined.where(F.col("cut").isNull() | ~at_cut).withColumn("more", _in_reach())
    taken = (F.col("whole") * F.col("size") + F.col("more")).cast("bigint").alias("taken")
    return edge.select(*columns, taken).unionByName(rest.select(*columns, taken))


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, share: float = 1.0, seed: int = SEED
) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per repetition, each source's last one cut to its words.

    What a document gives follows from its own place and its source's plan: below the source's cut it is
    taken once more, beyond it not. So texts stay where they are read; plans, one row per source, come to
    them (broadcast if Spark finds them small, else by a join whose hot sources adaptive execution splits).
    Only rows equal to the cut one in id, text and source are numbered, over the cluster, and written
    before they are used, so that a row computed again gets the same number.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; ``n_chars`` follows the text if there, other columns
    are carried whatever their names. Documents without words (null or empty texts) are not in the mix;
    null ids and null sources are values of their own; an empty table gives an empty mix.
    """
    places = placed_rows(docs, seed)
    placed = settle(docs.select(*places), "mix_sizes")
    plan = _planned(placed, weights, max_epochs, share)
    place = F.struct("h", F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row", "size")
    # The document in which the extra words of a source run out: its place, how many rows equal to it are
    # taken whole before it, and the words taken of it.
    ends = (
        placed.join(plan.where("cut is not null").select("key", F.col("cut").alias("bucket"), "left"), ["key", "bucket"])
        .withColumn("upto", _words_upto())
        .withColumn("nth", F.row_number().over(Window.partitionBy("key", *ORDER).orderBy("upto")))
        .where((F.col("upto") - F.col("size") < F.col("left")) & (F.col("upto") >= F.col("left")))
        .groupBy("key")
        .agg(F.min(F.struct("nth", place.alias("place"), (F.col("left") - F.col("upto") + F.col("size")).alias("words"))).alias("end"))
    )
    plan = settle(plan.join(ends, "key", "left").select("key", "whole", "extra", "cut", "end"), "mix_ends")

    # The columns of docs travel as one struct: no name of theirs can clash.
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *places).join(plan, "key")
    at_end = F.coalesce((F.col("bucket") == F.col("cut")) & (place == F.col("end.place")), F.lit(False))
    more = F.when(F.col("bucket") != F.col("cut"), _in_reach()).when(place < F.col("end.place"), F.col("size")).otherwise(0)
    more = F.when(F.col("cut").isNull(), _in_reach()).otherwise(more)
    plain = rows.where(~at_end).select("doc", "size", "whole", more.alias("more"))
    equal = numbered(
        rows.where(at_end).select("key", F.xxhash64(F.to_json("doc")).alias("by"), "doc", "size", "whole", "end"), "key", ["by"], "mix_equal"
    )
    nth = F.col("_rank") + 1
    ended = F.when(nth < F.col("end.nth"), F.col("size")).when(nth == F.col("end.nth"), F.col("end.words")).otherwise(0)
    equal = equal.select("doc", "size", "whole", ended.alias("more"))

    once_more = F.when((F.col("more") > 0) & (F.col("more") == F.col("size")), 1).otherwise(0)
    times = F.when(F.col("size") > 0, F.col("whole") + once_more).otherwise(0).cast("int")
    whole = plain.unionByName(equal).select("doc", F.explode(F.array_repeat(F.lit(True), times))).select("doc.*")
    # One document per source is cut; only those pass through Python.
    cut = equal.where("more > 0 and more < size").select(first_words("doc.text", "more").alias("cut"), "doc")
    put = {"text": F.col("cut"), "n_chars": F.length("cut").cast("bigint")}
    return whole.unionByName(cut.select(*[put.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns]))


@F.pandas_udf(StringType())
def first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    """Each text up to the end of its n-th word, white space kept."""
    word = re.compile(WORD)

    def cut(t: str, k: int) -> str:
        end = 0
        for _, m in zip(range(k), word.finditer(t), strict=False):
            end = m.end()
        return t[:end]

    return pd.Series([cut(t, int(k)) for t, k in zip(text, n, strict=True)], dtype=object)
