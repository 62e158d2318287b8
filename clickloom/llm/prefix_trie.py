"""Prefix trie of conversations: shared beginnings are counted exactly, the rest never leaves its row.

Every conversation gives one row per prefix, told by a 128-bit digest. Digests of a conversation's
prefixes are running sums of its turns' hashes, each hashed with its place; sums need no order of
combination, so a conversation of any length is summed in chunks of 4,096 turns.

A count-min sketch of the digests (two rows of cells that count to two) screens them. A cell that counts
one proves that no other conversation has the prefix: its node is emitted from the row at hand. Only
prefixes that may be shared shuffle, and are grouped exactly. The sketch is a bit per cell, at most
``MOST_BITS`` of them; what a full sketch cannot rule out is grouped too, so its size changes no result.

Sums over subtrees need no walk down the trie. A node belongs to its smallest member; that member's
nodes are a chain, and every member adds to a node what its own chain holds from that depth on. So a
subtree's sum is one sum along each conversation and one over each node's members.

Turns are ordered by number, null first, and equal numbers by content hash. Null roles and texts are
empty; rows without a conversation id belong to none and make no node. Repeated rows are turns of their
own. An empty table has no node. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import WORD, hot_join, numbered
from clickloom.state import settle

#: Turns of a conversation that are summed together.
CHUNK = 4096
#: Cells of a sketch row for each prefix, and the most that a row gets: 16 MB of bits.
CELLS_PER_PREFIX = 8
MOST_BITS = 2**27
#: Bits of one of Spark's bitmaps.
BITMAP_BITS = 32_768
#: Characters of conversation ids joined into one row before the ids of a node meet.
JOINED_CHARS = 16_384

LANES = ("s0", "s1", "s2", "s3")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n, t1, t2, words): turns in order, from 1, with content hashes instead of texts."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.xxhash64(F.lit(1), F.length(role), role, text).alias("t1"), F.xxhash64(F.lit(2), F.length(role), role, text).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    placed = numbered(rows, "conv_id", ["turn", "t1", "t2"], "trie_turns")
    return settle(
        placed.select("conv_id", (F.col("_rank") + 1).alias("pos"), F.col("_total").alias("n"), "t1", "t2", "words"), "trie_placed"
    )


def rebuilt(placed: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that start as the first of their block does: (rows, conversations).

    Conversation c takes the first h turns of conversation c - c % ``block``, then its own after its first
    h; h is the CRC-32 of its decimal id modulo ``most``. Rows are (conv_id, pos, length, t1, t2, words),
    conversations (conv_id, length), those without a turn too.
    """
    base = F.col("conv_id") - F.col("conv_id") % block
    convs = placed.where("pos = 1").select(
        "conv_id", "n", base.alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).alias("h")
    )
    head = F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "words")))
    heads = placed.where((F.col("conv_id") == base) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))
    info = convs.join(heads, "base", "left").withColumn(
        "taken", F.filter(F.coalesce("head", F.array()), lambda x: x["pos"] <= F.col("h"))
    )
    size = F.size("taken").cast("bigint")
    info = settle(
        info.select("conv_id", "n", "h", "taken", size.alias("n_taken"), (size + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")),
        "trie_conversations",
    )
    shifts = info.select("conv_id", "n", "h", "n_taken", "length")
    own = hot_join(placed.drop("n"), shifts, ["conv_id"], "n", ["conv_id", "pos"]).where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n_taken")).alias("pos"), "length", "t1", "t2", "words"
    )
    lent = info.select("conv_id", "length", F.explode("taken").alias("x")).select("conv_id", "x.pos", "length", "x.t1", "x.t2", "x.words")
    return own.unionByName(lent), info.select("conv_id", "length")


def _key(depth: Column, lanes: list[Column]) -> list[Column]:
    """The two halves of a prefix digest."""
    low = [c % F.lit(2**32) for c in lanes]
    return [F.xxhash64(F.lit(half), depth, *low) for half in (1, 2)]


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, last): every prefix, the empty one included, and its parent's key."""
    lanes = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), "pos", "t1", "t2")
        lanes += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(2**32 - 1))]
    marked = settle(
        rows.select(
            "conv_id", F.floor((F.col("pos") - 1) / CHUNK).alias("chunk"), F.col("pos").alias("depth"), "words",
            (F.col("pos") == F.col("length")).alias("last"), *[c.alias(x) for c, x in zip(lanes, LANES, strict=True)],
        ),
        "trie_marked",
    )
    upto = _running(marked, LANES, F.col("depth").asc(), F.col("chunk").asc())
    sums, before = [F.col(f"sum_{x}") for x in LANES], [F.col(f"sum_{x}") - F.col(x) for x in LANES]
    own, parent = _key(F.col("depth"), sums), _key(F.col("depth") - 1, before)
    zero = F.lit(0).cast("bigint")
    root = _key(zero, [zero] * 4)
    nowhere = F.lit(None).cast("bigint")
    inner = upto.select(
        "conv_id", "depth", own[0].alias("k1"), own[1].alias("k2"), parent[0].alias("p1"), parent[1].alias("p2"), "words", "last"
    )
    tops = convs.select(
        "conv_id", zero.alias("depth"), root[0].alias("k1"), root[1].alias("k2"), nowhere.alias("p1"), nowhere.alias("p2"),
        zero.alias("words"), (F.col("length") == 0).alias("last"),
    )
    return settle(inner.unionByName(tops), "trie_prefixes")


def _running(rows: DataFrame, columns: tuple[str, ...], order: Column, chunk_order: Column) -> DataFrame:
    """Add ``sum_<c>``: inclusive running sums along each conversation, chunk by chunk.

    ``rows`` is a written table with conv_id and chunk; rows that tie in ``order`` get the same sum.
    """
    totals = rows.groupBy("conv_id", "chunk").agg(*[F.sum(c).alias(f"t_{c}") for c in columns])
    earlier = Window.partitionBy("conv_id").orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv_id", "chunk", *[F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0)).alias(f"o_{c}") for c in columns])
    inside = Window.partitionBy("conv_id", "chunk").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(starts, ["conv_id", "chunk"]).select(
        *rows.columns, *[(F.sum(c).over(inside) + F.col(f"o_{c}")).alias(f"sum_{c}") for c in columns]
    )


def sketch(found: DataFrame, most_bits: int = MOST_BITS) -> tuple[int, np.ndarray]:
    """(cells per row, bits): the cells of both sketch rows that hold two prefixes or more.

    The number of cells follows the number of prefixes up to ``most_bits``; at most 32 MB reach the driver.
    """
    wanted = max(BITMAP_BITS, CELLS_PER_PREFIX * found.count())
    width = min(1 << (wanted - 1).bit_length(), most_bits)
    cells = F.array(F.pmod("k1", F.lit(width)), F.pmod("k2", F.lit(width)) + width)
    full = found.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark numbers the bits of its bitmaps from 1.
    at = F.col("cell") + 1
    maps = full.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((2 * width // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for r in maps.collect():
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return width, out.reshape(-1)


def screened(found: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The prefixes with ``single`` and ``parent_single``: true where the sketch proves that nobody shares them."""
    width, bits = sketch(found, most_bits)
    shared = found.sparkSession.sparkContext.broadcast(bits)

    def at_most_one(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        maps = shared.value
        out = np.zeros(len(k1), bool)
        for row, k in enumerate((k1, k2)):
            cell = (k & (width - 1)) + row * width
            out |= (maps[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 0
        return out

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = lambda name, b=b: b.column(name).fill_null(0).to_numpy(zero_copy_only=False)
            alone = at_most_one(key("k1"), key("k2"))
            above = at_most_one(key("p1"), key("p2")) & b.column("p1").is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(alone), pa.array(above)], [*b.schema.names, "single", "parent_single"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in found.dtypes)
    return settle(found.mapInArrow(looked_up, f"{kinds}, single boolean, parent_single boolean"), "trie_screened")


def id_digests(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of each key's conv_ids, ascending, comma-joined.

    Ids are sorted over the cluster and joined to long rows first. SHA-256 cannot be composed from parts,
    so the last step reads a key's joined rows in order, one after the other, in constant memory.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0
        row = lambda: pa.RecordBatch.from_pydict(
            {"k1": [key[0]], "k2": [key[1]], "first": [first], "ids": [",".join(ids)]}, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        )
        for b in batches:
            for k1, k2, c in zip(*[b.column(x).to_pylist() for x in ("k1", "k2", "conv_id")], strict=True):
                if ids and (key != (k1, k2) or size >= JOINED_CHARS):
                    yield row()
                    ids, size = [], 0
                if not ids:
                    key, first = (k1, k2), c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
        for b in batches:
            done = []
            for k1, k2, text in zip(*[b.column(x).to_pylist() for x in ("k1", "k2", "ids")], strict=True):
                if key == (k1, k2):
                    state.update(b"," + text.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], schema=kinds)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], schema=kinds)

    sorted_ids = settle(rows.select("k1", "k2", "conv_id"), "trie_ends").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    long = sorted_ids.mapInArrow(joined, "k1 bigint, k2 bigint, first bigint, ids string")
    return long.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashed, "k1 bigint, k2 bigint, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` are turns (conv_id, pos, length, t1, t2, words), ``convs`` all conversations (conv_id, length).
    (conv_id, depth) names a node, conv_id being its smallest member.
    """
    found = screened(prefixes(rows, convs), most_bits)
    single, members = found.where("single"), found.where("not single")
    nodes = settle(
        members.groupBy("k1", "k2", "p1", "p2", "depth").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
            F.bool_and("last").alias("childless"), F.bool_or("parent_single").alias("parent_single"),
        ),
        "trie_nodes",
    )
    # A single node whose parent may be shared hangs from the exact part of the trie.
    first = single.where("depth > 0 and not parent_single")
    deeper = single.where("depth = 0 or parent_single")
    keyed = lambda df: df.where("depth > 0 and not parent_single").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = keyed(nodes).unionByName(keyed(first)).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_children"))

    zero, yes = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    nokey = F.lit(None).cast("bigint")
    chunk = F.floor(F.col("depth") / CHUNK).alias("chunk")
    chains = (
        nodes.select(
            "conv_id", chunk, "depth", nokey.alias("k1"), nokey.alias("k2"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.col("childless").cast("bigint").alias("leaf"),
        )
        .unionByName(single.where("last").select("conv_id", chunk, "depth", nokey.alias("k1"), nokey.alias("k2"), zero.alias("saved"), yes.alias("leaf")))
        .unionByName(members.select("conv_id", chunk, "depth", "k1", "k2", zero.alias("saved"), zero.alias("leaf")))
    )
    from_here = _running(settle(chains, "trie_chains"), ("saved", "leaf"), F.col("depth").desc(), F.col("chunk").desc())
    subtrees = from_here.where("k1 is not null").groupBy("k1", "k2").agg(
        F.sum("sum_leaf").alias("n_leaves"), F.sum("sum_saved").alias("saved_tokens")
    )
    ends = id_digests(members.where("last"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = settle(
        nodes.join(subtrees, ["k1", "k2"]).join(children, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left").select(
            "k1", "k2", "p1", "p2", "depth", "conv_id", "parent_single", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        ),
        "trie_whole",
    )
    alone = [
        "k1", "k2", "p1", "p2", "depth", "conv_id", "parent_single", yes.alias("n_convs"), F.when(F.col("last"), zero).otherwise(yes).alias("n_children"),
        yes.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    ]
    results = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = whole.where("n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_children")
    )
    hanging = whole.where("depth > 0 and not parent_single").unionByName(first.select(*alone))
    placed = hot_join(hanging, above, ["p1", "p2"], "_children", ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", *results)
    own_parent = F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id")
    rest = whole.where("depth = 0 or parent_single").unionByName(deeper.select(*alone)).select("conv_id", "depth", own_parent, *results)
    return placed.unionByName(rest)
