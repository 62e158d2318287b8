"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy node arrays.

Statistics of whole texts come from one pass over Arrow batches. The trees are fitted on a bounded
sample of labelled documents; scoring walks all rows of a batch down each tree level by level. A
feature with a monotonic constraint can only move the score one way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from clickloom.llm.common import texts
from clickloom.llm.textblocks import SMALL_BLOCK_CHARS, Words, blocks, grams

#: At most about this many labelled documents are used for the fit, chosen by a hash of their id.
FIT_ROWS = 20_000
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_digits", "n_punct", "n_lines", "n_distinct"]
#: Feature and the way it may move the score: -1 lowers it, 0 free.
FEATURES = {
    "symbol_share": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": 0, "digit_share": 0,
    "punct_share": 0, "word_length": 0, "line_words": 0, "distinct_share": 0, "log_words": 0,
}


def statistics(values: list[str | None] | pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text of a batch, block by block."""
    out = {c: np.zeros(len(values), np.int64) for c in (*COUNTS, *EXTRA)}
    symbols = np.zeros(128, bool)
    symbols[[ord(c) for c in SYMBOLS]] = True
    for at, held in blocks(values, SMALL_BLOCK_CHARS):
        w, n = Words(held), len(held)
        rows = slice(at, at + n)
        cp, text_at = w.cp, w.text_at[:-1]

        def per_text(mask):
            return np.add.reduceat(mask.astype(np.int64), text_at)

        low = np.minimum(cp, 127)
        out["n_words"][rows] = w.counts
        out["word_chars"][rows] = per_text(~w.space)
        out["n_symbols"][rows] = per_text(symbols[low])
        upper = ((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7))
        out["n_upper"][rows] = per_text(upper)
        out["n_digits"][rows] = per_text((cp >= 48) & (cp <= 57))
        alnum = (low >= 48) & (low <= 57) | (low >= 65) & (low <= 90) | (low >= 97) & (low <= 122) | (cp > 127)
        out["n_punct"][rows] = per_text(~alnum & ~w.space)

        # Lines: spans between line feeds; equal lines have equal hashes within their text.
        line_end = np.flatnonzero(cp == 10)
        line_start = np.concatenate([[0], line_end[:-1] + 1])
        text_of_line = np.searchsorted(w.text_at, line_start, "right") - 1
        has_word = np.searchsorted(w.starts, line_end) > np.searchsorted(w.starts, line_start)
        line_start, line_end, text_of_line = line_start[has_word], line_end[has_word], text_of_line[has_word]
        out["n_lines"][rows] = np.bincount(text_of_line, minlength=n)
        h = w.span_hashes(line_start, line_end)
        order = np.lexsort((h, text_of_line))
        h, t = h[order], text_of_line[order]
        again = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
        out["n_dup_lines"][rows] = np.bincount(t[1:][again], minlength=n)

        text = w.text_of_word()
        order = np.lexsort((w.hashes, text))
        h, t = w.hashes[order], text[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        out["n_distinct"][rows] = np.bincount(t[fresh], minlength=n)

        g = grams(w.hashes, 3)
        inside = np.flatnonzero(text[: len(g)] == text[2:]) if len(g) else np.zeros(0, np.int64)
        if len(inside):
            g, t = g[inside], text[inside]
            order = np.lexsort((g, t))
            same = (g[order][1:] == g[order][:-1]) & (t[order][1:] == t[order][:-1])
            twice = np.zeros(len(g), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(text) + 3, np.int64)
            np.add.at(covered, inside[twice], 1)
            np.add.at(covered, inside[twice] + 3, -1)
            words = np.cumsum(covered)[: len(text)] > 0
            out["n_repeat_words"][rows] = np.bincount(text[words], minlength=n)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Feature matrix in the order of ``FEATURES``; texts without words give zeros."""
    words = np.maximum(s["n_words"], 1).astype(float)
    chars = np.maximum(s["word_chars"], 1).astype(float)
    lines = np.maximum(s["n_lines"], 1).astype(float)
    return np.column_stack([
        s["n_symbols"] / chars, s["n_repeat_words"] / words, s["n_dup_lines"] / lines, s["n_upper"] / chars,
        s["n_digits"] / chars, s["n_punct"] / chars, s["word_chars"] / words, words / lines,
        s["n_distinct"] / words, np.log1p(s["n_words"]),
    ])


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself, so a walk of ``depth`` steps ends in leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves' values for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node]
        return total


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.3,
    bins: int = 64, min_rows: int = 5, penalty: float = 1.0,
) -> Trees:
    """Boosted logistic trees on binned features.

    A split on a constrained feature needs its children's values in the allowed order, and below it
    the children's values stay on their side of the split's middle.
    """
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)] if n else [np.zeros(0)] * m
    codes = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)]) if m else np.zeros((n, 0), int)
    rate0 = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate0 / (1 - rate0)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    raw = np.full(n, base)

    def add() -> int:
        feature.append(0), threshold.append(np.inf), value.append(0.0)
        left.append(len(left)), right.append(len(right))
        return len(feature) - 1

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-raw))
        grad, curve = y - p, np.maximum(p * (1 - p), 1e-9)

        def leaf(rows, low, high, grad=grad, curve=curve):
            return float(np.clip(grad[rows].sum() / (curve[rows].sum() + penalty), low, high))

        def grow(rows, level, low, high, grad=grad, curve=curve, leaf=leaf):
            node = add()
            value[node] = rate * leaf(rows, low, high)
            if level == depth or len(rows) < 2 * min_rows:
                return node
            g_all, c_all = grad[rows].sum(), curve[rows].sum()
            best = (1e-6, None)
            for f in range(m):
                size = len(cuts[f]) + 1
                g = np.cumsum(np.bincount(codes[rows, f], grad[rows], size))[:-1]
                c = np.cumsum(np.bincount(codes[rows, f], curve[rows], size))[:-1]
                k = np.cumsum(np.bincount(codes[rows, f], minlength=size))[:-1]
                if not len(g):
                    continue
                vl = np.clip(g / (c + penalty), low, high)
                vr = np.clip((g_all - g) / (c_all - c + penalty), low, high)
                gain = g * g / (c + penalty) + (g_all - g) ** 2 / (c_all - c + penalty) - g_all**2 / (c_all + penalty)
                allowed = (k >= min_rows) & (len(rows) - k >= min_rows)
                if monotone[f]:
                    allowed &= (vr - vl) * monotone[f] >= 0
                gain = np.where(allowed, gain, -np.inf)
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (gain[b], (f, b, float(vl[b] + vr[b]) / 2))
            if best[1] is None:
                return node
            f, b, middle = best[1]
            goes_left = codes[rows, f] <= b
            bounds = ((low, high), (low, high))
            if monotone[f] > 0:
                bounds = ((low, middle), (middle, high))
            elif monotone[f] < 0:
                bounds = ((middle, high), (low, middle))
            feature[node], threshold[node], value[node] = f, float(cuts[f][b]), 0.0
            left[node] = grow(rows[goes_left], level + 1, *bounds[0])
            right[node] = grow(rows[~goes_left], level + 1, *bounds[1])
            return node

        start = len(feature)
        roots.append(grow(np.arange(n), 0, -4.0, 4.0))
        tree = Trees(
            np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value),
            np.array([start]), depth, 0.0,
        )
        raw += tree.score(x)
    if not roots:
        roots = [add()]
    return Trees(
        np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots),
        depth, base,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts) of every document; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(s[c]) for c in (*COUNTS, *EXTRA)]], ["doc_id", *COUNTS, *EXTRA])

    ddl = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in (*COUNTS, *EXTRA))
    return texts(docs).mapInArrow(run, ddl)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Trees fitted on at most about ``fit_rows`` labelled documents, taken by hash of the id.

    Labels other than 0 and 1, null ids and labels without a document are left out; of several labels
    of an id the larger counts. Without labels every document scores even odds or better.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    n = marked.count()
    # A margin below the bound keeps the hash sample under it.
    share = min(1.0, 0.95 * fit_rows / max(n, 1))
    edge = int(share * (1 << 30))
    chosen = F.broadcast(marked.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < edge))
    # texts() renames nothing that labels hold, and the chosen ids are at most fit_rows rows.
    rows = with_statistics(docs.join(chosen.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_semi"))
    # One row per id, however many rows hold it: the least by its counts.
    single = rows.groupBy("doc_id").agg(F.min(F.struct(*COUNTS, *EXTRA)).alias("least")).select("doc_id", "least.*")
    found = single.join(chosen, "doc_id").toPandas()
    found = found.sort_values(["doc_id", *COUNTS, *EXTRA])
    x = features({c: found[c].to_numpy() for c in (*COUNTS, *EXTRA)})
    return fit_trees(x, found["quality"].to_numpy(float), list(FEATURES.values()))


JUDGED = [*COUNTS, "score", "base_failed", "kept"]


def _judged(docs: DataFrame, trees: Trees, carry: list[str]) -> DataFrame:
    """``doc``, a struct of the carried columns, with the counts and verdicts: no carried name can clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A carried text is read where it is, not sent beside itself.
            text = pc.struct_field(b.column("doc"), "text") if carried else b.column("text")
            s = statistics(text)
            score = trees.score(features(s))
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            cols = [*[pa.array(s[c]) for c in COUNTS], pa.array(score), pa.array(failed), pa.array(~failed & (score >= 0))]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *cols], ["doc", *JUDGED])

    carried = "text" in carry and docs.schema["text"].dataType == StringType()
    alone = [] if carried else [F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    slim = docs.select(F.struct(*carry).alias("doc"), *alone)
    results = [*[StructField(c, LongType()) for c in COUNTS], StructField("score", DoubleType())]
    results += [StructField(c, BooleanType()) for c in ("base_failed", "kept")]
    return slim.mapInArrow(run, StructType([slim.schema["doc"], *results]))


def judge(docs: DataFrame, trees: Trees, carry: list[str] | None = None) -> DataFrame:
    """``docs`` columns in ``carry`` (default: doc_id) with the counts, ``score``, ``base_failed`` and ``kept``.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows. kept: not
    base_failed and a score of even odds or better. Every row is judged by itself: null and repeated ids and
    repeated rows come back as often as they are there; a null text has no words and fails; a very long
    text is counted whole; an empty table gives an empty one. A carried column named as a result stands
    beside it under the same name: take ``kept_documents`` for such tables.
    """
    return _judged(docs, trees, ["doc_id"] if carry is None else carry).select("doc.*", *JUDGED)


def kept_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs`` whatever their names."""
    return _judged(docs, trees, docs.columns).where("kept").select("doc.*")
