"""Merkle manifest of a dataset: nested-struct rollup, proofs by transform and explode.

A row's leaf is the hash of its fields. Within a source the leaves are numbered by id, and a number's
base-3 digits say where a leaf hangs. Leaves are dealt into blocks of 729 consecutive ones; in a block
the digits are grouped away one after the other, each time nesting up to three child structs in their
parent. All these groupings share the first one's partitioning, so rows move once. The blocks' tops are
the next round's leaves, until each source has one top, its subroot; the subroots make one more tower.

Proofs come from the nested structs alone, from the root down: a transform over the nested children
gives every leaf of a block its siblings, an explode emits them, and a block meets the path above it by
grouping on its key. Nothing is joined to emit them, and no row holds more than 729 leaves.

Nulls in any field are hashed as such. Rows with a null id come first in their source; rows that repeat
an id are ordered by leaf, and equal rows are interchangeable. An empty text differs from a null one; a
very long one is hashed whole. An empty table has an empty manifest. Columns other than the five fields
are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import numbered
from clickloom.state import settle

FAN = 3
#: Levels that are grouped away inside a block.
DEPTH = 6
BLOCK = FAN**DEPTH
FIELDS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
STEPS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Hash of the fields in order: ``-`` for null, else byte count, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields.values()]
    return digest(F.concat(*parts))


def leaves(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """(doc_id, key, leaf, found): ``found`` is the leaf of a row whose text has become ``found_text``.

    ``found`` is null where the text is as it was. ``key`` stands for the source: empty for null, else
    the source behind a letter, so that keys order as sources do with null first.
    """
    fields = {c: F.col(c).cast(kind).cast("string") for c, kind in FIELDS.items()}
    found = F.lit(None).cast("string")
    if found_text is not None:
        changed = ~found_text.eqNullSafe(fields["text"])
        found = F.when(changed, leaf_hash(fields | {"text": found_text}))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), fields["source"]), F.lit("")).alias("key"),
        leaf_hash(fields).alias("leaf"), found.alias("found"),
    )


def _count_at(level: int) -> Column:
    """Nodes of the source ``level`` levels above the block's leaves."""
    return F.ceil(F.col("n") / F.lit(FAN**level))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(key, block, n, node): each block's nodes nested into one struct (hash, kids).

    ``nodes`` has key, pos, n (nodes of the key), hash and item. A level that is one node for the whole
    key is the key's top already: it is nested on but not hashed again.
    """
    digits = [f"d{i}" for i in range(DEPTH)]
    out = nodes.select(
        "key", F.floor(F.col("pos") / BLOCK).alias("block"), "n",
        *[F.pmod(F.floor(F.col("pos") / FAN**i), F.lit(FAN)).cast("int").alias(d) for i, d in enumerate(digits)],
        F.struct("hash", "item").alias("node"),
    ).repartition("key", "block")
    for level in range(DEPTH):
        run = F.sort_array(F.collect_list(F.struct(F.col(digits[level]).alias("at"), "node")))
        grouped = out.groupBy("key", "block", "n", *digits[level + 1 :]).agg(run.alias("run"))
        kids = F.transform("run", lambda x: x["node"])
        grouped = grouped.withColumn("kids", kids).drop("run")
        joined = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        hashed = F.when(_count_at(level) > 1, digest(joined)).otherwise(F.col("kids")[0]["hash"])
        out = grouped.withColumn("node", F.struct(hashed.alias("hash"), "kids")).drop("kids")
    return out


def _siblings(kids: Column, i: Column) -> Column:
    """The hashes left and right of child ``i``."""
    hashes = F.transform(kids, lambda x: x["hash"])
    left = F.array_join(F.slice(hashes, F.lit(1), i), "")
    return F.struct(left.alias("left"), F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), "").alias("right"))


def _emitted(node: Column, level: int, steps: Column) -> Column:
    """All leaves below ``node`` with their steps, lowest first."""
    if level == 0:
        return F.array(F.struct(node["hash"].alias("hash"), node["item"].alias("item"), steps.alias("steps")))
    kids = node["kids"]

    def below(kid: Column, i: Column) -> Column:
        own = F.concat(F.array(_siblings(kids, i)), steps)
        return _emitted(kid, level - 1, F.when(_count_at(level - 1) > 1, own).otherwise(steps))

    return F.flatten(F.transform(kids, below))


def _met(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Each block with the path above it, found by grouping on (key, block)."""
    kinds = dict(blocks.dtypes) | dict(paths.dtypes)
    empty = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    both = blocks.select("key", "block", "n", "node", empty("up")).unionByName(
        paths.select("key", "block", empty("n"), empty("node"), "up")
    )
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "up")]
    return both.groupBy("key", "block").agg(*firsts)


def tower(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(key, hash, item, up) of every node; ``up`` holds subroot, root and the steps to the root.

    ``above`` gets the tops (key, hash), one per key, and returns (key, up) for them.
    """
    rounds, level = [], nodes
    while True:
        low = settle(_blocks(level), f"{name}_blocks")
        rounds.append(low)
        # Each round leaves a 729th of the nodes, so there are as many rounds as digits of the largest key.
        if (low.agg(F.max("block")).first()[0] or 0) == 0:
            break
        level = low.select(
            "key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"),
            F.col("node.hash").alias("hash"), F.struct("block").alias("item"),
        )
    paths = above(rounds[-1].select("key", F.col("node.hash").alias("hash"))).select("key", F.lit(0).cast("bigint").alias("block"), "up")
    out = None
    for low in reversed(rounds):
        met = _met(low, paths)
        out = met.select("key", "up", F.explode(_emitted(F.col("node"), DEPTH, F.col("up.steps"))).alias("e")).select(
            "key", "e.hash", "e.item", F.struct("up.subroot", "up.root", "e.steps").alias("up")
        )
        if low is not rounds[0]:
            paths = out.select("key", "item.block", "up")
    return out


def _all_sources(tops: DataFrame) -> DataFrame:
    """(key, up) of the sources' tops: their place in the tower of subroots."""
    ranked = numbered(tops.select(F.lit("").alias("all"), "key", "hash"), "all", ["key"], "merkle_sources")
    nodes = ranked.select(
        F.lit("").alias("key"), F.col("_rank").alias("pos"), F.col("_total").alias("n"), "hash", F.struct(F.col("key").alias("source")).alias("item")
    )
    alone = lambda top: top.select(
        "key", F.struct(F.col("hash").alias("subroot"), F.col("hash").alias("root"), F.array().cast(STEPS).alias("steps")).alias("up")
    )
    placed = tower(nodes, alone, "merkle_sources")
    return placed.select(
        F.col("item.source").alias("key"), F.struct(F.col("hash").alias("subroot"), "up.root", "up.steps").alias("up")
    )


def manifest(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, found, subroot, root, steps): the proof of every row.

    ``steps`` lead from the leaf over the subroot to the root, each with the hashes to the left and to the
    right; ``found`` is the leaf of the text as found now where ``found_text`` differs, else null.
    """
    hashed = settle(leaves(docs, found_text), "merkle_leaves")
    ranked = numbered(hashed, "key", ["doc_id", "leaf"], "merkle_ranked")
    nodes = ranked.select(
        "key", F.col("_rank").alias("pos"), F.col("_total").alias("n"), F.col("leaf").alias("hash"), F.struct("doc_id", "found").alias("item")
    )
    placed = tower(nodes, _all_sources, "merkle")
    return placed.select("item.doc_id", F.col("hash").alias("leaf"), "item.found", "up.subroot", "up.root", "up.steps")


def proof_digest(steps: str = "steps") -> Column:
    """Hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, steps: str = "steps") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def without_line_feeds() -> Column:
    """The text after tampering: documents whose id has an even CRC-32 lose their line feeds."""
    text = F.col("text").cast("string")
    even = F.crc32(F.col("doc_id").cast("bigint").cast("string")) % 2 == 0
    return F.when(even, F.translate(text, "\n", "")).otherwise(text)
