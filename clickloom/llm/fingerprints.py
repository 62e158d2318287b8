"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

Terms are shingles of five words, weighted by how often a text holds them. The occurrences of a term are
numbered and each is dealt to one of ``BINS`` samples by a hash of the term and its number, so a text costs
one draw per occurrence at most and not one per term and sample. In a sample a term has the weight S that was
dealt there. Every term draws r and c from Gamma(2, 1) and beta from (0, 1) there, all fixed by term and
sample; it takes t = floor(ln S / r + beta), y = exp(r (t - beta)) and a = c / (y exp(r)). The smallest a of
the terms is the sample.

If x and y are the weights of a term in two texts, the first min(x, y) occurrences are dealt alike in both. So
the two texts have the same sample, of those that either has, with a probability equal to the generalised
Jaccard similarity of their whole weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import SPACE
from clickloom.state import settle

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
#: Gamma(2, 1) is drawn from a table of 2**TABLE_BITS equal shares.
TABLE_BITS = 12
#: ln a lies within +-LOG_RANGE and is kept to 2**-LOG_BITS in the low bits of a sample.
LOG_RANGE, LOG_BITS = 512.0, 45


def gamma_quantiles(n: int = 1 << TABLE_BITS) -> list[float]:
    """The middle of each of ``n`` equal shares of Gamma(2, 1): where 1 - (1 + x) exp(-x) reaches it."""
    out, x = [], 0.0
    for i in range(n):
        p, low, high = (i + 0.5) / n, x, 60.0
        for _ in range(60):
            x = (low + high) / 2
            low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < p else (low, x)
        out.append(x)
    return out


def _list(values: list[float]) -> Column:
    """A constant array: folded once, not evaluated per row."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def sample(term: Column, weight: Column | None = None) -> Column:
    """One term's draw in one bin as a number: the bin in the high bits, then ln a. Equal draws mean equal (term, t).

    The bits of the term's hash give, in turn, the bin, r and c (shares of Gamma(2, 1)) and beta.
    Without ``weight`` the weight is one, for which t is 0.
    """
    quantiles = gamma_quantiles()
    share = (1 << TABLE_BITS) - 1
    r = F.get(_list(quantiles), F.shiftright(term, BIN_BITS).bitwiseAND(F.lit(share)).cast("int"))
    ln_c = F.get(_list([math.log(q) for q in quantiles]), F.shiftright(term, BIN_BITS + TABLE_BITS).bitwiseAND(F.lit(share)).cast("int"))
    beta = F.shiftrightunsigned(term, BIN_BITS + 2 * TABLE_BITS) * F.lit(2.0 ** -(64 - BIN_BITS - 2 * TABLE_BITS))
    if weight is None:
        ln_a = ln_c - r * (F.lit(1.0) - beta)
    else:
        ln_a = ln_c - r * (F.floor(F.ln(weight) / r + beta) - beta + F.lit(1.0))
    low = ((ln_a + F.lit(LOG_RANGE)) * F.lit(float(1 << LOG_BITS))).cast("bigint")
    return F.shiftleft(term.bitwiseAND(F.lit(BINS - 1)), 56).bitwiseOR(low)


def samples_of(term: Column, weight: Column) -> Column:
    """The draws of a term in all bins that its occurrences are dealt to.

    The first occurrence is in the bin of the term's hash, with the draw of a term held once; the others
    are dealt by hash, and in other bins the term's hash is made anew.
    """
    mask = F.lit(BINS - 1)
    own = term.bitwiseAND(mask).cast("int")
    dealt = F.transform(
        F.sequence(F.lit(0), weight - 1), lambda i: F.when(i == 0, own).otherwise(F.xxhash64(term, i).bitwiseAND(mask).cast("int"))
    )
    there = lambda k: F.when(k == own, term).otherwise(
        F.shiftleft(F.shiftright(F.xxhash64(F.lit("bin"), term, k), BIN_BITS), BIN_BITS).bitwiseOR(k.cast("bigint"))
    )
    held = lambda x, bins: F.size(bins) - F.size(F.array_remove(bins, x.bitwiseAND(mask).cast("int")))
    drawn = lambda bins: F.transform(F.transform(F.array_distinct(bins), there), lambda x: sample(x, held(x, bins)))
    return F.flatten(F.transform(F.array(dealt), drawn))


def with_samples(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the sorted samples of a text column, at most one per bin; empty without words.

    Texts that hold no shingle twice, nearly all, need no weights and skip the counting of runs.
    """
    w, s, q, p, a = (f"_{out}_{x}" for x in "wsqpa")
    none = F.array().cast("array<bigint>")
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    n = F.size(w)
    many = F.transform(
        F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(SHINGLE)])
    )
    terms = F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(F.lit("whole"), F.col(w)))).otherwise(none)
    repeats = F.size(F.array_distinct(s)) < F.size(s)
    starts = F.filter(
        F.sequence(F.lit(0), F.size(q) - 1), lambda i: (i == 0) | (F.get(F.col(q), i) != F.get(F.col(q), i - 1))
    )
    weight = lambda at, j: F.coalesce(F.get(F.col(p), j + 1), F.size(q)) - at
    weighed = F.transform(
        p,
        lambda at, j: F.when(weight(at, j) == 1, F.array(sample(F.get(F.col(q), at)))).otherwise(
            samples_of(F.get(F.col(q), at), weight(at, j))
        ),
    )
    drawn = F.when(F.size(q) > 0, F.flatten(weighed)).otherwise(F.transform(s, lambda x: sample(x)))
    firsts = F.filter(
        a, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(F.col(a), i - 1), 56))
    )
    return (
        df.withColumn(w, words)
        .withColumn(s, terms)
        .drop(w)
        .withColumn(q, F.when(repeats, F.sort_array(s)).otherwise(none))
        .withColumn(p, F.when(F.size(q) > 0, starts).otherwise(F.array().cast("array<int>")))
        .withColumn(a, F.sort_array(drawn))
        .drop(s, p, q)
        .withColumn(out, firsts)
        .drop(a)
    )


def likeness(a: str, b: str) -> Column:
    """Share of equal samples among the bins used by either text; 1 for two texts without words."""
    bins = lambda c: F.transform(c, lambda x: F.shiftright(x, 56))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def as_text(samples: str) -> Column:
    """Samples as text: seven hex digits each, a one, the bin and sixteen bits of the draw."""
    short = lambda x: F.shiftleft(F.shiftright(x, 56), 16) + F.shiftright(x, 8).bitwiseAND(F.lit(0xFFFF)) + F.lit(1 << 24)
    return F.array_join(F.transform(samples, lambda x: F.hex(short(x))), "")


#: Characters of a text that help to order it among rows of the same id when blocks are drawn up.
PREFIX = 32
#: Borders that are searched one by one; above that, groups of borders first.
FEW = 64


def _place() -> Column:
    """Place of a row in the order of ids (null first), then texts; rows equal in this stay in one block."""
    return F.struct(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.substring("text", 1, PREFIX).alias("start"))


def in_order_blocks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, extra, block) in which every document meets the next one in its own block.

    Blocks are ranges of rows in order, a few per shuffle partition and about equally large wherever the ids
    lie; a null or repeated id is split by the starts of the texts. The first document of a block is added to
    the block before it as an ``extra`` row, the very first one to the last block. Texts move once.
    """
    spark = docs.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = settle(docs.select(_place().alias("place")).select("place.*"), "fingerprint_places")
    ranged = places.repartitionByRange(blocks, "has_id", "id", "start").select(F.spark_partition_id().alias("part"), F.struct(*places.columns).alias("place"))
    # One short row per range: its first place.
    borders = ranged.groupBy("part").agg(F.min("place").alias("border")).agg(F.sort_array(F.collect_list("border")).alias("borders"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("borders") - 1) / FEW)), lambda g: F.slice("borders", (g * FEW + 1).cast("int"), F.lit(FEW)))
    borders = settle(borders.where(F.size("borders") > 0).withColumn("groups", groups), "fingerprint_borders")
    met = docs.join(F.broadcast(borders)).withColumn("place", _place())
    group = F.size(F.filter("groups", lambda g: g[0] <= F.col("place"))) - 1
    within = F.size(F.filter(F.get("groups", F.col("group")), lambda x: x <= F.col("place"))) - 1
    placed = met.withColumn("group", group).withColumn("block", F.col("group") * FEW + within)
    goes_to = F.when(F.col("block") > 0, F.col("block") - 1).otherwise(F.size("borders") - 1)
    heads = (
        placed.where(F.col("place") == F.get("borders", F.col("block")))
        .groupBy("block", goes_to.alias("goes_to"))
        .agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
        .select("doc_id", "text", F.lit(1).alias("extra"), F.col("goes_to").alias("block"))
    )
    return placed.select("doc_id", "text", F.lit(0).alias("extra"), "block").unionByName(heads)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document and its edited text, with their fingerprints and likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The edited text ends in the first floor(n_chars / 2) code points (or all) of the next document in
    place of its own last ones. Order: doc_id, null first, then text; the last document is followed by
    the first, a single one by itself. Null texts are empty.
    """
    slim = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("block").orderBy("extra", "doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("_next", F.lit(1), half))
    rows = (
        in_order_blocks(slim)
        .withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
        .withColumn("edited", edited)
        .drop("_next")
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    sampled = with_samples(with_samples(rows, "text", "own"), "edited", "other")
    paired = sampled.select(
        "doc_id", "extra", "n_chars", "edited_sha256", "own", "other", F.lead("own").over(order).alias("after")
    ).where("extra = 0")
    return paired.select(
        "doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", "after").alias("near_next"),
    )
