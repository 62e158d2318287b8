"""Row-local features of an id sequence.

Every function works on the array inside one row, so no row is exploded or shuffled however long
the table is. Counting is done by sorting (value, position) pairs and cutting them into runs,
which keeps the cost at n log n for long sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.hashing import blake2b_buckets

HALF_LIFE = 10.0


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a computed value several times inside one expression while computing it once.

    Stacked columns would be copied into each other when a filter is pushed below them; a lambda
    variable cannot be.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last_mean(items: Column, k: int) -> Column:
    """Mean of the last ``k`` elements, ignoring nulls; null when nothing is left."""
    known = F.filter(last_items(items, k), lambda v: v.isNotNull())

    def mean(xs: Column) -> Column:
        total = F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
        return F.when(F.size(xs) > 0, total / F.size(xs))

    return bind(known, mean)


def last_items(items: Column, k: int) -> Column:
    return bind(items, lambda a: F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), F.lit(k)))


def list_mean(items: Column) -> Column:
    """Mean of the elements, 0 for an empty list."""
    total = F.aggregate(items, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(0.0)


def list_std(items: Column, mean: Column) -> Column:
    """Population standard deviation of the elements, 0 for an empty list."""
    squares = F.aggregate(
        items, F.lit(0.0), lambda acc, v: acc + (v.cast("double") - mean) * (v.cast("double") - mean)
    )
    return F.when(F.size(items) > 0, F.sqrt(squares / F.size(items))).otherwise(0.0)


def at_end(items: Column, back: int, default: int = -1) -> Column:
    """Element counted from the end (1 = last) or the default."""
    return F.coalesce(F.try_element_at(items, F.lit(-back)), F.lit(default))


def length_bin(n: Column) -> Column:
    """Session length class; a null length falls to the last class."""
    # The limits and names of the classes.
    return (
        F.when(n <= 50, "0-50").when(n <= 200, "51-200").when(n <= 500, "201-500").otherwise("500+")
    )


def run_starts(items: Column, key: Callable[[Column], Column] = lambda e: e) -> Column:
    """Positions at which a run of equal neighbours begins."""
    n = F.size(items)
    spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(
        spots, lambda i: (i == 0) | (key(F.get(items, i)) != key(F.get(items, i - 1)))
    )


def _run_end(items: Column, starts: Column, j: Column) -> Column:
    return F.coalesce(F.get(starts, j + 1), F.size(items))


def longest_run(items: Column) -> Column:
    """Length of the longest run of equal neighbours, 0 for an empty list."""

    def longest(starts: Column) -> Column:
        lengths = F.transform(starts, lambda s, j: _run_end(items, starts, j) - s)
        return F.coalesce(F.array_max(lengths), F.lit(0))

    return bind(run_starts(items), longest)


def counts(ids: Column) -> Column:
    """One struct per distinct id: value ``v``, count ``n``, ``first`` and ``last`` position."""
    pairs = F.sort_array(F.transform(ids, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

    def describe(p: Column, starts: Column) -> Column:
        def run(s: Column, j: Column) -> Column:
            end = _run_end(p, starts, j)
            return F.struct(
                F.get(p, s)["v"].alias("v"),
                (end - s).alias("n"),
                F.get(p, s)["i"].alias("first"),
                F.get(p, end - 1)["i"].alias("last"),
            )

        return F.transform(starts, run)

    return bind(pairs, lambda p: bind(run_starts(p, lambda e: e["v"]), lambda s: describe(p, s)))


def with_counts(df: DataFrame, ids: str = "_ids", out: str = "_runs") -> DataFrame:
    return df.withColumn(out, counts(F.col(ids)))


STAT_COLUMNS = [
    "seq_len", "uniq_cnt", "uniq_ratio", "top1_id", "top1_share", "top2_share", "last_id",
    "entropy", "rep_run_max", "decayed_unique",
]


def stats(ids: Column, runs: Column) -> Column:
    """The ten sequence statistics as a struct; all are 0 for an empty sequence.

    Of equally frequent ids the one seen first ranks higher. ``decayed_unique`` weights each
    distinct id by how recently it was last seen, halving every ten steps.
    """

    def top_two(r: Column) -> Column:
        ranked = F.transform(
            r, lambda e: F.struct(e["n"].alias("n"), (-e["first"]).alias("f"), e["v"].alias("v"))
        )
        return F.slice(F.sort_array(ranked, asc=False), 1, 2)

    def all_of(a: Column, n: Column, r: Column, top: Column) -> Column:
        first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))

        def share(part: Column) -> Column:
            return F.coalesce(part, F.lit(0)) / F.greatest(n, F.lit(1))

        def spread(acc: Column, e: Column) -> Column:
            p = e["n"] / n
            return acc - p * F.ln(p + 1e-12)

        def fresh(acc: Column, e: Column) -> Column:
            return acc + F.pow(F.lit(2.0), -(n - 1 - e["last"]) / F.lit(HALF_LIFE))

        values = [
            n,
            F.size(r),
            share(F.size(r)),
            F.coalesce(first["v"], F.lit(0)),
            share(first["n"]),
            share(second["n"]),
            at_end(a, 1, 0),
            F.aggregate(r, F.lit(0.0), spread),
            longest_run(a),
            F.aggregate(r, F.lit(0.0), fresh),
        ]
        return F.struct(*[v.alias(c) for v, c in zip(values, STAT_COLUMNS)])

    return bind(
        ids,
        lambda a: bind(
            F.size(a), lambda n: bind(runs, lambda r: bind(top_two(r), lambda top: all_of(a, n, r, top)))
        ),
    )


def with_stats(df: DataFrame, ids: str = "_ids", runs: str = "_runs") -> DataFrame:
    """Add the ten statistics as columns."""
    return df.withColumn("_stats", stats(F.col(ids), F.col(runs))).select("*", "_stats.*").drop("_stats")


def _share_of(tally: Column, key: Column, size: Column) -> Column:
    return F.coalesce(F.try_element_at(tally, key), F.lit(0)) / size


def with_ratios(df: DataFrame, vocab: list[int], ids: str = "_ids", runs: str = "_runs") -> DataFrame:
    """Add the share of each vocabulary id in the row's sequence, as one array in vocabulary order."""
    wanted = F.array(*[F.lit(v).cast("bigint") for v in vocab])

    def shares(r: Column, n: Column) -> Column:
        tally = F.map_from_arrays(F.transform(r, lambda e: e["v"]), F.transform(r, lambda e: e["n"]))
        return bind(tally, lambda t: F.transform(wanted, lambda v: _share_of(t, v, n)))

    size = F.greatest(F.size(ids), F.lit(1))
    return df.withColumn("ratio", bind(size, lambda n: bind(F.col(runs), lambda r: shares(r, n))))


def bucket_counts(runs: Column, bucket: Callable[[Column], Column]) -> Column:
    """Map from hash bucket to the number of ids in it; only distinct ids are hashed."""
    return _slot_counts(F.transform(runs, lambda r: F.struct(bucket(r["v"]).alias("b"), r["n"].alias("n"))))


def with_hash_bag(
    df: DataFrame, bucket: Callable[[Column], Column], dims: int = 128, ids: str = "_ids", runs: str = "_runs"
) -> DataFrame:
    """Add the hashed bag of ids: ``dims`` shares that sum to 1 for a non-empty sequence.

    ``bucket`` maps an id to its bucket.
    """
    return df.withColumn("bag", _dense(bucket_counts(F.col(runs), bucket), dims, F.size(ids)))


def with_digest_bag(df: DataFrame, dims: int = 128, ids: str = "_ids", runs: str = "_runs") -> DataFrame:
    """As ``with_hash_bag`` with blake2b buckets, hashed in Arrow batches."""
    values = F.transform(runs, lambda r: r["v"].cast("string"))
    hashed = df.withColumn("_b", blake2b_buckets(values, dims))
    slots = F.transform(runs, lambda r, j: F.struct(F.get("_b", j).alias("b"), r["n"].alias("n")))
    return hashed.withColumn("bag", _dense(_slot_counts(slots), dims, F.size(ids))).drop("_b")


def _slot_counts(slots: Column) -> Column:
    def tally(s: Column, starts: Column) -> Column:
        def total(at: Column, j: Column) -> Column:
            part = F.slice(s, at + 1, _run_end(s, starts, j) - at)
            return F.aggregate(part, F.lit(0), lambda acc, e: acc + e["n"])

        return F.map_from_arrays(
            F.transform(starts, lambda at: F.get(s, at)["b"]), F.transform(starts, total)
        )

    return bind(F.sort_array(slots), lambda s: bind(run_starts(s, lambda e: e["b"]), lambda st: tally(s, st)))


def _dense(tally: Column, dims: int, size: Column) -> Column:
    places = F.sequence(F.lit(0), F.lit(dims - 1))
    return bind(
        F.greatest(size, F.lit(1)),
        lambda n: bind(tally, lambda t: F.transform(places, lambda b: _share_of(t, b, n))),
    )
