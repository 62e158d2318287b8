"""Line dedup: range-partitioned line hashes, streamed in order, with a keep bitmap per document.

Every long line gives a row (hash, document, place). Rows are range-partitioned by all three, largest
document first, so that even a line found everywhere is cut over many ranges. Each range is streamed:
a hash inside it is decided there; the first and last hash of a range also leave a summary, and the
summaries of neighbouring ranges, two per range, decide hashes that cross a border.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import texts
from clickloom.state import settle

#: The characters stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STREAMED = pa.schema([
    ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()),
    ("drop", pa.bool_()), ("summary", pa.bool_()), ("n_docs", pa.int64()), ("first_doc", pa.int64()),
    ("last_doc", pa.int64()), ("part", pa.int32()),
])
STREAMED_DDL = (
    "h1 bigint, h2 bigint, doc_id bigint, row bigint, pos int, drop boolean, summary boolean, "
    "n_docs bigint, first_doc bigint, last_doc bigint, part int"
)
#: Stands for a null document id: below every other, so it is never the largest unless alone.
NO_ID = -(2**63)


def line_key() -> Column:
    """The line without white space at its ends, A-Z lowered; translate only where a line is not ASCII."""
    line = F.btrim("line", F.lit(BLANKS))
    ascii_only = F.octet_length("line") == F.length("line")
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _stream(min_docs: int):
    """Decide each hash of a sorted range; the first and the last one stay open and are summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # rows of one hash not yet known to be common: few documents
        state = {"key": None, "n": 0, "first": None, "last": None, "index": -1}

        def rows(h1, h2, doc, row, pos, drop):
            n = len(doc)
            none = pa.nulls(n)
            return pa.RecordBatch.from_arrays([
                pa.array(h1), pa.array(h2), pa.array(doc), pa.array(row), pa.array(pos), drop,
                pa.array(np.zeros(n, bool)), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()),
                pa.array(np.full(n, part, np.int32)),
            ], schema=STREAMED)

        def summary():
            return pa.RecordBatch.from_pylist([{
                "h1": state["key"][0], "h2": state["key"][1], "summary": True, "n_docs": state["n"],
                "first_doc": state["first"], "last_doc": state["last"], "part": part,
            }], schema=STREAMED)

        def release(decided: bool):
            """Rows held back for the hash that just ended; small groups only."""
            for h1, h2, doc, row, pos in held:
                if decided:
                    continue  # fewer documents than needed: nothing is dropped
                yield rows(h1, h2, doc, row, pos, pa.nulls(len(doc), pa.bool_()))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, row = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id", "row"))
            pos = batch.column("pos").to_numpy()
            new = np.ones(len(doc), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if state["key"] == (h1[0], h2[0]):
                new[0] = False
            cuts = np.flatnonzero(new)
            if not len(cuts) or cuts[0]:
                cuts = np.insert(cuts, 0, 0)
            stops = np.append(cuts[1:], len(doc))
            # A hash that begins and ends inside this batch with fewer rows than documents needed drops nothing.
            look = stops - cuts >= min_docs
            look[0] = look[-1] = True
            spans = [(a, b, bool(new[a])) for a, b in zip(cuts[look], stops[look], strict=True)]
            for a, b, starts in spans:
                if starts:
                    if state["key"] is not None:
                        open_group = state["index"] == 0
                        if open_group:
                            yield summary()
                        yield from release(not open_group)
                    state = {
                        "key": (int(h1[a]), int(h2[a])), "n": 0, "first": int(doc[a]), "last": None,
                        "index": state["index"] + 1,
                    }
                d = doc[a:b]
                fresh = np.ones(b - a, bool)
                fresh[1:] = d[1:] != d[:-1]
                fresh[0] = state["last"] is None or d[0] != state["last"]
                before = state["n"]
                state["n"] += int(fresh.sum())
                state["last"] = int(d[-1])
                part_rows = (h1[a:b], h2[a:b], d, row[a:b], pos[a:b])
                if state["index"] > 0 and state["n"] >= min_docs:
                    # enough documents inside this range: all but those of the first document go
                    for x in (*held, part_rows):
                        gone = x[2] != state["first"]
                        if gone.any():
                            yield rows(*[y[gone] for y in x], pa.array(np.ones(int(gone.sum()), bool)))
                    held.clear()
                elif state["index"] > 0 and before < min_docs:
                    held.append(part_rows)
                else:
                    yield rows(*part_rows, pa.nulls(b - a, pa.bool_()))
        if state["key"] is not None:
            yield summary()
            yield from release(False)

    return run


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Lines to drop: (doc_id, row, pos), pos from 0.

    A line's key is the line stripped of white space at both ends and with A-Z lowered. Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents (distinct ids; null is one
    id, the smallest) lose every line but those of the largest id holding them. ``row`` is a hash of
    id and text: rows equal in both share it.
    """
    lines = (
        texts(docs)
        .select(
            F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"),
            F.xxhash64("doc_id", "text").alias("row"),
            F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
        )
        .where(F.length("line") >= min_chars)
        .withColumn("key", line_key())
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "row", "pos")
    )
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("row"), F.col("pos")]
    # Written first: drawing the range borders reads its input once more, and that should not be the texts.
    ranged = settle(lines, "line_hashes").repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = settle(ranged.mapInArrow(_stream(min_docs), STREAMED_DDL), "line_ranges")

    # Two summaries per range at most, so this table is bounded by the number of ranges.
    same = Window.partitionBy("h1", "h2").orderBy("part")
    borders = (
        streamed.where("summary")
        .withColumn("shared", (F.lag("last_doc").over(same) == F.col("first_doc")).cast("bigint"))
        .groupBy("h1", "h2")
        .agg(
            (F.sum("n_docs") - F.sum(F.coalesce("shared", F.lit(0)))).alias("docs"),
            F.max("first_doc").alias("keeper"),
        )
    )
    rows = streamed.where(~F.col("summary"))
    undecided = (
        rows.where(F.col("drop").isNull())
        .join(F.broadcast(borders), ["h1", "h2"])
        .where((F.col("docs") >= min_docs) & (F.col("doc_id") != F.col("keeper")))
    )
    columns = ["doc_id", "row", "pos"]
    found = rows.where("drop").select(*columns).unionByName(undecided.select(*columns))
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, bitmap) of the documents that lose lines: zlib-packed bits, 1 for a line that goes.

    Bits past the end of the bitmap are 0: those lines stay. A document without a row keeps all lines.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for places in b.column("places").to_pylist():
                bits = np.zeros(max(places) + 1, np.uint8)
                bits[places] = 1
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), pa.array(maps, pa.binary())], ["doc_id", "row", "bitmap"]
            )

    gone = repeated_lines(docs, min_chars, min_docs)
    by_doc = gone.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_set("pos").alias("places"))
    return by_doc.select("doc_id", "row", "places").mapInArrow(packed, "doc_id bigint, row bigint, bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, n, dropped = [], [], []
        for text, bitmap in zip(b.column("text").to_pylist(), b.column("bitmap").to_pylist(), strict=True):
            lines = text.split("\n")
            n.append(len(lines))
            if bitmap is None:
                kept.append(text)
                dropped.append(0)
                continue
            bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
            stay = [x for i, x in enumerate(lines) if i >= len(bits) or not bits[i]]
            kept.append("\n".join(stay))
            dropped.append(len(lines) - len(stay))
        names = [c for c in b.schema.names if c != "bitmap"]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in names], pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())],
            [*names, "_kept", "_n_lines", "_n_dropped"],
        )


def drop_repeated_lines(docs: DataFrame, carry: list[str], min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Documents with repeated lines removed: ``carry`` columns, ``_kept``, ``_n_lines``, ``_n_dropped``.

    A null or empty text is one empty line. Needs columns ``doc_id`` and ``text``; no row is lost.
    """
    maps = keep_bitmaps(docs, min_chars, min_docs).select("row", "bitmap")
    keyed = docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c).alias(f"c_{c}") for c in carry],
        F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row"),
    )
    joined = keyed.join(maps, "row", "left").drop("row")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "bitmap")
    out = joined.mapInArrow(_apply, f"{types}, _kept string, _n_lines bigint, _n_dropped bigint")
    return out.select(*[F.col(f"c_{c}").alias(c) for c in carry], "_kept", "_n_lines", "_n_dropped")
