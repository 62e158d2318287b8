"""One logistic click model per segment, all segments fitted together.

Each Newton step is one pass: every task adds up the gradient and the packed upper triangle of the
curvature matrix of the segments it meets, in numpy on Arrow batches, and only these sums are shuffled.
So a segment with a third of all rows costs no more than a third of a scan, no segment's rows are ever
gathered, and a hundred features make one array of 7,021 numbers per segment instead of as many columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.numeric import sigmoid
from clickloom.operators.joins import cross_one, lookup_join
from clickloom.operators.scaling import apply_standard, fit_standard
from clickloom.state import settle

#: Bytes of partial sums that a task holds before it hands them on.
HELD_BYTES = 64 << 20
#: Partial sums of one segment meet in up to so many tasks first.
SALTS = 64
SUMS_DDL = "_seg bigint, w array<double>, g array<double>, h array<double>"
SUMS = pa.schema([("_seg", pa.int64()), *[(c, pa.list_(pa.float64())) for c in "wgh"]])


@dataclass
class SegmentModels:
    segments: list[str]
    features: list[str]
    scaler: DataFrame
    weights: DataFrame
    whole: DataFrame


def _margin(w: Sequence[Column], x: Sequence[Column]) -> Column:
    total = w[0]
    for weight, value in zip(w[1:], x, strict=True):
        total = total + weight * value
    return total


def _matrix(lists: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums_batch(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    seg = np.fromiter(held, np.int64, len(held))
    lists = [pa.array([v[i] for v in held.values()], pa.list_(pa.float64())) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(seg), *lists], schema=SUMS)


def _partial_sums(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_seg, weights, gradient, packed curvature) of the rows (_seg, y, x, w) that a task reads."""
    upper = np.triu_indices(d)
    most = max(1, HELD_BYTES // (8 * (len(upper[0]) + 2 * d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            seg, y = b.column("_seg").to_numpy(), b.column("y").to_numpy()
            x, w = _matrix(b.column("x"), d), _matrix(b.column("w"), d)
            p = 1 / (1 + np.exp(-np.einsum("ij,ij->i", x, w)))
            order = np.argsort(seg, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(seg[order]) != 0])
            for rows in np.split(order, starts[1:]):
                own, key = x[rows], int(seg[rows[0]])
                v = p[rows] * (1 - p[rows])
                sums = held.setdefault(key, [w[rows[0]], np.zeros(d), np.zeros(len(upper[0]))])
                sums[1] += (y[rows] - p[rows]) @ own
                sums[2] += ((own * v[:, None]).T @ own)[upper]
            if len(held) >= most:
                yield _sums_batch(held)
                held = {}
        if held:
            yield _sums_batch(held)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbouring rows of the same segment; the rows come sorted by segment."""
    key, total = None, None
    for b in batches:
        for r in b.select(SUMS.names).to_pylist():
            own = [np.array(r[c]) for c in "wgh"]
            if key == r["_seg"]:
                total = [own[0], total[1] + own[1], total[2] + own[2]]
                continue
            if key is not None:
                yield _sums_batch({key: total})
            key, total = r["_seg"], own
    if key is not None:
        yield _sums_batch({key: total})


def _moved(d: int, ridge: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One ridge-penalised Newton step per row of sums; the intercept is not penalised."""
    upper, penalty = np.triu_indices(d), np.diag([1e-9] + [ridge] * (d - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _added(batches):
            (w,), (g,), (packed,) = (_matrix(b.column(c), n) for c, n in (("w", d), ("g", d), ("h", len(upper[0]))))
            h = np.zeros((d, d))
            h[upper] = packed
            h = h + np.triu(h, 1).T
            w = w + np.linalg.solve(h + penalty, g - penalty @ w)
            yield pa.RecordBatch.from_arrays([b.column("_seg"), pa.array([w], pa.list_(pa.float64()))], ["_seg", "w"])

    return run


def _newton(rows: DataFrame, keys: list[str], start: DataFrame, d: int, steps: int, ridge: float) -> DataFrame:
    """(keys, n, w0, w1, ...) after ``steps`` Newton steps; ``rows`` has keys, y and x, ``start`` keys, n and _seg."""
    weights = start.withColumn("w", F.array_repeat(F.lit(0.0), d))
    for _ in range(steps):
        scored = lookup_join(rows, weights, keys, "n", spread=["x"]).where(F.col("w").isNotNull())
        partial = scored.select("_seg", "y", "x", "w").mapInArrow(_partial_sums(d), SUMS_DDL)
        salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        few = salted.repartition("_seg", "salt").sortWithinPartitions("_seg").mapInArrow(_added, SUMS_DDL)
        moved = few.repartition("_seg").sortWithinPartitions("_seg").mapInArrow(_moved(d, ridge), "_seg bigint, w array<double>")
        weights = settle(start.join(moved, "_seg").select(*keys, "n", "_seg", "w"), "weights")
    return weights.select(*keys, "n", *[F.get("w", F.lit(i)).alias(f"w{i}") for i in range(d)])


def fit_segments(
    df: DataFrame, segments: Sequence[str], features: Sequence[str], label: str,
    steps: int = 5, ridge: float = 1.0, min_rows: int = 10,
) -> SegmentModels:
    """Fit one model per segment with at least ``min_rows`` rows, and one for all rows.

    Features are scaled once over all rows; missing features count as 0 after scaling.
    """
    segments, features = list(segments), list(features)
    scaler = settle(fit_standard(df, features), "scaler")
    scaled = apply_standard(df, scaler, features).fillna(0.0, features)
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    base = settle(scaled.select(*segments, F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), x.alias("x")), "segment_rows")
    sizes = base.dropna(subset=segments).groupBy(*segments).agg(F.count(F.lit(1)).alias("n"))
    # A segment's number is its place in a written table.
    start = settle(sizes.where(F.col("n") >= min_rows), "segment_sizes").withColumn("_seg", F.monotonically_increasing_id())
    d = len(features) + 1
    weights = _newton(base.dropna(subset=segments), segments, settle(start, "segment_numbers"), d, steps, ridge)
    everyone = base.withColumn("_all", F.lit(1))
    one = settle(everyone.groupBy("_all").agg(F.count(F.lit(1)).alias("n")).withColumn("_seg", F.lit(0).cast("bigint")), "all_rows")
    whole = _newton(everyone, ["_all"], one, d, steps, ridge)
    return SegmentModels(segments, features, scaler, weights, whole.drop("_all", "n"))


def parts(models: SegmentModels) -> dict[str, DataFrame]:
    """The fitted tables by name, to be stored; ``from_parts`` puts them together again."""
    return {"segment_scaler": models.scaler, "segment_weights": models.weights, "segment_whole": models.whole}


def from_parts(tables: dict[str, DataFrame], names: dict[str, list[str]]) -> SegmentModels:
    return SegmentModels(names["keys"], names["features"], tables["segment_scaler"], tables["segment_weights"], tables["segment_whole"])


def score_segments(
    df: DataFrame, models: SegmentModels, keep: Sequence[str], out: str = "p",
    null_segment: str = "global", default: float = 0.5,
) -> DataFrame:
    """Segment model where there is one, else the model of all rows; ``keep`` columns come back as they are.

    ``null_segment="default"`` gives rows without a segment the default instead.
    """
    names = [f"w{i}" for i in range(len(models.features) + 1)]
    rows = cross_one(cross_one(df, models.scaler), models.whole.withColumnsRenamed({w: f"_all_{w}" for w in names}))
    own = models.weights.withColumnsRenamed({"n": "_own_n"} | {w: f"_own_{w}" for w in names})
    joined = lookup_join(rows, own, models.segments, "_own_n", spread=list(keep))
    x = [F.coalesce((F.col(f) - F.col(f"{f}_mean")) / F.col(f"{f}_std"), F.lit(0.0)) for f in models.features]
    p = sigmoid(_margin([F.coalesce(f"_own_{w}", f"_all_{w}") for w in names], x))
    if null_segment == "default":
        known = F.lit(True)
        for c in models.segments:
            known = known & F.col(c).isNotNull()
        p = F.when(known, p).otherwise(default)
    return joined.select(*keep, p.alias(out), F.col("_own_w0").isNotNull().alias("own_model"))
