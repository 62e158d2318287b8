"""N-gram Jaccard self-join by universe partitioning, exact.

Sets of shingles are cut into segments by a hash of the shingle, the same way for all sets of a size
band. If two sets are alike enough, at most H shingles differ, so of H + 1 segments one is equal; a
segment that is also indexed with one shingle left out counts twice, as it bears one difference. For
each band a cost model says how many segments there are and how many of them get such neighbourhoods.
There are ``slack`` more segments than needed: two alike sets then share at least ``slack + 1`` of them,
so every set may leave out its ``slack`` segments with the longest lists (empty ones, shared passages).

Lists are made in buckets of packed signatures. Sets are first linked to one frequent partner each and
grouped; then only pairs of sets from different groups are looked at, and of these only such as their
sizes, their own shingles and their differences to the partner leave open. These bounds never rule out an
alike pair. Every pair left is verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import hot_join, texts
from clickloom.llm.components import components
from clickloom.llm.textblocks import SMALL_BLOCK_CHARS, Words, blocks, distinct_pairs, mixed, shingles
from clickloom.state import settle

#: Signatures of one bucket, about.
BUCKET_ROWS = 1_500_000
#: Cost model: signatures that one list of unrelated sets costs. Such lists come from short segments; a
#: segment that holds ``per`` shingles on average is empty, and so in common, with a chance of exp(-per).
LIST_COST = 80
#: Earlier lists of a set that travel with it, to tell whether a pair has been looked at.
EARLIER = 16
#: Share of a band's differences held as slack.
SLACK = 0.12


class Bands:
    """Size bands and their segment plans for a similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.last = [0]  # last size of each band; band 0 is the empty set
        self._plans: list[tuple[int, int, int]] = [(0, 0, 0)]

    def upto(self, size: int) -> None:
        while self.last[-1] < size:
            low = self.last[-1] + 1
            high = max(low, low * self.den // self.num)
            self.last.append(high)
            self._plans.append(self.plan(low, high))

    def plan(self, low: int, high: int) -> tuple[int, int, int]:
        """(segments, segments with neighbourhoods, slack) of a band: the cheapest that bears all differences."""
        most = (self.den - self.num) * high // self.num  # differences of an alike pair
        slack = int(most * SLACK)
        need = most + 1 + slack
        best = None
        for d in range(need // 2 + 1):
            m = need - d
            per = (low + high) / 2 / m
            cost = m + d * per + LIST_COST * ((m - d) * math.exp(-per) + d * (per + 1) * math.exp(1 - per))
            if best is None or cost < best[0]:
                best = (cost, m, d)
            if d > 400 and cost > 2 * best[0]:
                break
        return best[1], best[2], slack

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(band, segments, with neighbourhoods, slack) of each size."""
        self.upto(int(sizes.max(initial=1)))
        band = np.searchsorted(self.last, sizes)
        plans = np.array(self._plans)
        return band, plans[band, 0], plans[band, 1], plans[band, 2]


@lru_cache(maxsize=4)
def bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def shingle_sets(held: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle) of the distinct shingles of texts, and the set sizes."""
    found = []
    for at, few in blocks(held, SMALL_BLOCK_CHARS):
        t, h = distinct_pairs(*shingles(Words(few, lower=True), words))
        found.append((t + at, h))
    t, h = map(np.concatenate, zip(*found, strict=True))
    return t, h, np.bincount(t, minlength=len(held))


def set_keys(t: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set; order does not matter."""
    keys = []
    for seed in (0x51ED2701, 0x7A3C9F15):
        total = np.zeros(n, np.uint64)
        np.add.at(total, t, mixed(h ^ np.uint64(seed)))
        keys.append(mixed(total).view(np.int64))
    return keys[0], keys[1]


def signatures(t: np.ndarray, h: np.ndarray, sizes: np.ndarray, num: int, den: int):
    """(entry, signature) rows and, per entry, (text, band, slack).

    An entry is a text in the partition of its own band, or of the band below if that holds sizes it
    can be alike to.
    """
    b = bands(num, den)
    band, *_ = b.of(sizes)
    entry_text, entry_band, entry_slack, rows_entry, rows_sig = [], [], [], [], []
    offset = 0
    plans = np.array(b._plans)
    lasts = np.array(b.last)
    for below in (0, 1):
        mine = band - below
        used = (sizes > 0) & (mine > 0)
        if below:
            used &= -(-sizes * num // den) <= lasts[np.maximum(mine, 0)]
        if not used.any():
            continue
        number = np.cumsum(used) - 1  # entry of each used text
        keep = used[t]
        tt, hh = t[keep], h[keep]
        m, d = plans[np.maximum(mine, 0), 0], plans[np.maximum(mine, 0), 1]
        m = np.where(used, m, 0)
        seg_at = np.cumsum(m) - m
        bands_of = mixed(np.maximum(mine, 0).astype(np.uint64) + np.uint64(77))
        seg = (mixed(hh ^ bands_of[tt]) % m[tt].astype(np.uint64)).astype(np.int64)
        value = mixed(hh + np.uint64(0xC0FFEE))
        total = np.zeros(int(m.sum()), np.uint64)
        place = seg_at[tt] + seg
        np.add.at(total, place, value)
        seg_text = np.repeat(np.arange(len(sizes)), m)
        inner = (np.arange(len(total)) - seg_at[seg_text]).astype(np.uint64)
        name = mixed(bands_of[seg_text] + inner * np.uint64(0x9E3779B97F4A7C15))
        rows_entry.append(number[seg_text] + offset)
        rows_sig.append(mixed(total + name))
        near = seg < d[tt]  # segments with neighbourhoods: once more for each shingle left out
        rows_entry.append(number[tt[near]] + offset)
        rows_sig.append(mixed(total[place[near]] - value[near] + name[place[near]]))
        entry_text.append(np.flatnonzero(used))
        entry_band.append(mine[used])
        entry_slack.append(plans[mine[used], 2])
        offset += int(used.sum())
    if not offset:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows_entry), np.concatenate(rows_sig), tuple(map(np.concatenate, (entry_text, entry_band, entry_slack)))


def _keys(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2 = ([] for _ in range(3))
            for _, held in blocks(b.column("text")):
                t, h, sizes = shingle_sets(held, words)
                a, c = set_keys(t, h, len(held))
                n.append(sizes), k1.append(a), k2.append(c)
            cols = [pa.array(np.concatenate(x).astype(np.int64)) if x else pa.array([], pa.int64()) for x in (n, k1, k2)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *cols], ["doc_id", "row", "n_shingles", "node", "node2"])

    return run


def _packed(words: int, num: int, den: int, buckets: int):
    """Signatures of each block of texts, packed by bucket: entry numbers, six-byte signatures, entry table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, held in blocks(b.column("text")):
                t, h, sizes = shingle_sets(held, words)
                node, _ = set_keys(t, h, len(held))
                # Copies of a set within the block are one set.
                first = np.zeros(len(held), bool)
                first[np.unique(node, return_index=True)[1]] = True
                entry, sig, (text, band, slack) = signatures(t, h, np.where(first, sizes, 0), num, den)
                if not len(sig):
                    continue
                bucket = (sig % np.uint64(buckets)).astype(np.int64)
                short = (sig >> np.uint64(16)).astype(np.uint64)
                order = np.argsort(bucket, kind="stable")
                bucket, short, entry = bucket[order], short[order], entry[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
                six = np.ascontiguousarray(short.view(np.uint8).reshape(-1, 8)[:, :6])
                out = []
                for lo, hi in zip(starts, stops, strict=True):
                    used, local = np.unique(entry[lo:hi], return_inverse=True)
                    out.append((
                        int(bucket[lo]), six[lo:hi].tobytes(), local.astype(np.uint32).tobytes(),
                        node[text[used]].tobytes(), band[used].astype(np.int32).tobytes(), slack[used].astype(np.int32).tobytes(),
                    ))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                    ["bucket", "sigs", "entries", "nodes", "bands", "slacks"],
                )

    return run


def _lists(table: pa.Table) -> pa.Table:
    """Signatures of one bucket that two different sets hold."""
    sigs, nodes, bnds, slacks = [], [], [], []
    for c in range(table.num_rows):
        row = {k: table.column(k)[c].as_py() for k in ("sigs", "entries", "nodes", "bands", "slacks")}
        six = np.frombuffer(row["sigs"], np.uint8).reshape(-1, 6)
        wide = np.zeros((len(six), 8), np.uint8)
        wide[:, :6] = six
        local = np.frombuffer(row["entries"], np.uint32)
        sigs.append(wide.reshape(-1).view(np.uint64))
        nodes.append(np.frombuffer(row["nodes"], np.int64)[local])
        bnds.append(np.frombuffer(row["bands"], np.int32)[local])
        slacks.append(np.frombuffer(row["slacks"], np.int32)[local])
    sig, node, band, slack = map(np.concatenate, (sigs, nodes, bnds, slacks))
    order = np.lexsort((node, band, sig))
    sig, node, band, slack = sig[order], node[order], band[order], slack[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (band[1:] != band[:-1])
    fresh = new.copy()
    fresh[1:] |= node[1:] != node[:-1]
    sig, node, band, slack, new = sig[fresh], node[fresh], band[fresh], slack[fresh], new[fresh]
    run = np.cumsum(new) - 1
    size = np.bincount(run)[run] if len(run) else run
    keep = size > 1
    bucket = table.column("bucket")[0].as_py()
    name = mixed(sig[keep] ^ mixed(np.full(int(keep.sum()), bucket, np.uint64) + band[keep].astype(np.uint64) * np.uint64(1 << 40)))
    pivot = node[np.flatnonzero(new)][run][keep] if len(run) else node
    return pa.table({
        "run": name.view(np.int64), "node": node[keep], "band": band[keep].astype(np.int32), "slack": slack[keep].astype(np.int32),
        "size": size[keep].astype(np.int64), "pivot": pivot,
    })


COMPARED_DDL = "a bigint, b bigint, total_a bigint, total_b bigint, both bigint"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the sets of each pair and of what they share."""
    for batch in batches:
        rows = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            rows.append((len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
        sizes = np.array(rows, np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *map(pa.array, sizes)], ["a", "b", "total_a", "total_b", "both"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, held in blocks(b.column("text")):
                t, h, sizes = shingle_sets(held, words)
                cuts = np.cumsum(sizes)[:-1]
                sets = [x.tobytes() for x in np.split(h, cuts)]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(at, len(held)), pa.array(sets, pa.binary())], ["node", "set"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(x.as_py(), np.int64) for x in b.column("set")]
        if not sets:
            continue
        nodes = np.repeat(b.column("node").to_numpy(), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(nodes)], ["shingle", "node"])


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of both sets and of what they share.

    A set in very many pairs is repeated under several sub-keys.
    """
    per = 200
    for side in "ab":
        uses = pairs.groupBy(F.col(side).alias("node")).agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("deals"))
        mine = sets.join(uses, "node").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
        mine = mine.select(F.col("node").alias(side), "deal", F.col("set").alias(f"set_{side}"), "deals")
        many = settle(uses.where("deals > 1").select(F.col("node").alias(side), "deals", (F.col("deals") * per).cast("bigint").alias("n")), "join_hot")
        marked = hot_join(pairs, many, [side], "n", ["a", "b"], "left")
        dealt = marked.withColumn("deal", F.pmod(F.xxhash64("a", "b"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
        pairs = dealt.join(mine.drop("deals"), [side, "deal"]).drop("deal")
    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(_shared, COMPARED_DDL)


def ngram_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, label) of every row: classes of documents linked by similar shingle sets.

    A-Z are lowered; a text of fewer than ``words`` words is one shingle, one without words has no
    shingle and is linked with nothing. Two rows link when den * |intersection| >= num * |union|;
    component_id is the smallest doc_id reachable (a null id counts as largest). Rows that repeat an id
    are documents of their own with the same id, so unrelated rows may share a component_id, or all have
    null; ``label`` names the class itself and is null only for rows without words.
    """
    spark = docs.sparkSession
    slim = texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    keyed = settle(
        slim.mapInArrow(_keys(words), "doc_id bigint, row bigint, n_shingles bigint, node bigint, node2 bigint"), "join_keys"
    )
    total = keyed.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, total // BUCKET_ROWS)
    packed = slim.select("text").mapInArrow(
        _packed(words, num, den, buckets), "bucket bigint, sigs binary, entries binary, nodes binary, bands binary, slacks binary"
    )
    lists = settle(
        packed.groupBy("bucket").applyInArrow(_lists, "run bigint, node bigint, band int, slack int, size bigint, pivot bigint"), "join_lists"
    )
    # Every set leaves out its longest lists, as many as there is slack.
    place = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.col("size").desc(), "run"))
    kept = settle(lists.withColumn("place", place).where(F.col("place") > F.col("slack")).drop("place", "slack"), "join_kept")

    reps = keyed.where("n_shingles > 0").groupBy("node", "node2").agg(F.min("row").alias("row"))
    wanted = kept.select("node").distinct().join(reps, "node")
    needed = slim.join(wanted.select("node", "row"), "row").dropDuplicates(["node", "row"])
    sets = settle(needed.select("node", "text").mapInArrow(_sets(words), "node bigint, set binary"), "join_sets")

    # Shingles no other listed set holds bound what a set can share: many sets of a group of edited
    # copies are out at once, and so are most pairs.
    owners = sets.mapInArrow(_exploded, "shingle bigint, node bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    alone = owners.where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    info = sets.select("node", (F.octet_length("set") / 8).cast("bigint").alias("total")).join(alone, "node", "left")
    info = settle(info.select("node", "total", F.coalesce("own", F.lit(0)).alias("own")), "join_own")
    possible = info.where(f"{den} * (total - own) >= {num} * total")
    held = settle(kept.drop("pivot", "size").join(possible, "node"), "join_held")

    def fits(x: str, y: str):
        """Can sets x and y be alike, by their sizes and own shingles?"""
        return (
            (F.col(f"{y}.total") * num <= F.col(f"{x}.total") * den) & (F.col(f"{x}.total") * num <= F.col(f"{y}.total") * den)
            & (den * (F.col(f"{x}.total") - F.col(f"{x}.own")) >= num * (F.col(f"{y}.total") + F.col(f"{x}.own")))
            & (den * (F.col(f"{y}.total") - F.col(f"{y}.own")) >= num * (F.col(f"{x}.total") + F.col(f"{y}.own")))
        )

    # One partner for each set: of its lists' members with the fewest own shingles, the most frequent.
    me = F.struct("own", "node", "total")
    heads = settle(held.groupBy("run").agg(F.min(me).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "join_heads")
    led = hot_join(held, heads, ["run"], "n", ["node"]).withColumn("me", me).where("node <> head.node").where(fits("me", "head"))
    votes = led.groupBy("node", F.col("head.node").alias("pivot")).agg(F.count(F.lit(1)).alias("n"), F.min("head.own").alias("own"))
    partner = votes.groupBy("node").agg(F.max_by("pivot", F.struct("n", -F.col("own"), "pivot")).alias("pivot"))
    tried = settle(partner.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "join_tried")
    compared = settle(compare(tried, sets), "join_compared")
    alike_pairs = F.col("both") * den >= (F.col("total_a") + F.col("total_b") - F.col("both")) * num
    links = compared.where(alike_pairs).select("a", "b")
    groups = components(links)
    # What a set lacks of its partner and has beyond it: by these counts alone most pairs of sets with the
    # same partner, which are most pairs of a group of edited copies, are too far apart.
    ends = partner.select("node", "pivot", F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    first = F.col("node") == F.col("a")
    own_total, its_total = F.when(first, F.col("total_a")).otherwise(F.col("total_b")), F.when(first, F.col("total_b")).otherwise(F.col("total_a"))
    shapes = ends.join(compared, ["a", "b"]).select("node", "pivot", (its_total - F.col("both")).alias("lacks"), (own_total - F.col("both")).alias("has"))
    known = settle(
        possible.select("node").join(groups, "node", "left").join(shapes, "node", "left")
        .select("node", F.coalesce("label", "node").alias("group"), "pivot", "lacks", "has"), "join_groups"
    )
    labelled = held.join(known, "node")
    mixed_runs = labelled.groupBy("run").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.count(F.lit(1)).alias("n")).where("g0 <> g1")
    # A pair is looked at in the first list that both sets are in: in a later one, an earlier common list is
    # among the last few of both, or else the pair comes once more.
    earlier = F.collect_list("run").over(Window.partitionBy("node").orderBy("run").rowsBetween(-EARLIER, -1))
    whole = F.struct("own", "node", "total", "pivot", "lacks", "has", "earlier")
    members = settle(
        hot_join(labelled, mixed_runs.select("run", "n"), ["run"], "n", ["node"])
        .withColumn("earlier", earlier).select("run", "group", whole.alias("me")), "join_mixed"
    )

    def apart(x: str, y: str):
        """Are sets x and y, compared to the same partner, too far apart by what they lack and have?"""
        of = lambda side, name: F.col(f"{side}.{name}")
        beyond = of(x, "has") + of(y, "has") - 2 * F.least(of(x, "has") - of(x, "own"), of(y, "has") - of(y, "own"))
        differ = F.abs(of(x, "lacks") - of(y, "lacks")) + beyond
        far = differ * (den + num) > (of(x, "total") + of(y, "total")) * (den - num)
        return F.coalesce((of(x, "pivot") == of(y, "pivot")) & far, F.lit(False))

    # Pairs of different groups within a list that can still be alike.
    left = members.select("run", F.col("me").alias("x"), F.col("group").alias("ga"))
    right = members.select(F.col("run").alias("run_b"), F.col("me").alias("y"), F.col("group").alias("gb"))
    near = left.join(
        right, (F.col("run") == F.col("run_b")) & (F.col("x.node") < F.col("y.node")) & (F.col("ga") != F.col("gb")) & fits("x", "y")
        & ~apart("x", "y") & ~F.arrays_overlap("x.earlier", "y.earlier")
    )
    pairs = near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    more = compare(settle(pairs.join(tried, ["a", "b"], "left_anti"), "join_pairs"), sets)
    classes = components(links.unionByName(settle(more.where(alike_pairs).select("a", "b"), "join_more")))

    alike = keyed.groupBy("node", "node2", "n_shingles").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    labelled_sets = alike.join(classes, "node", "left").withColumn("label", F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")))
    best = labelled_sets.where("label is not null").groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    settled = settle(
        hot_join(labelled_sets, best, ["label"], "sets", ["node", "node2"], "left").select("node", "node2", "component_id", "label", "n"), "join_classes"
    )
    out = hot_join(keyed, settled, ["node", "node2"], "n", ["row"], "left")
    return out.select(
        "doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "label",
    )
