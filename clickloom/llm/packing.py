"""Packing: concatenate and cut. Two passes of prefix sums give every document its place in one long row of ids.

Pass one tokenizes each partition in order and notes where each document starts inside it. The
partition totals, one row per partition, are summed up to give each partition its place. Pass two cuts
the row of ids into windows of fixed length; a document that crosses a border gives one piece on each
side, marked as such.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import texts
from clickloom.state import settle

WINDOW = 2048
END_ID = 1
#: Words, and parts of words, that one age of a worker's memory holds; there are two ages.
MEMORY_WORDS = 300_000
#: Rows of a batch on the way back to Spark.
OUT_BYTES = 4_000_000

TOKENIZED = "doc_id bigint, part int, place bigint, local_start bigint, n_tokens bigint, ids binary"


# How the tokenizer file splits normalised text, and the last letter that the short way takes.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LAST_LETTER = 0x52F


class Remembered(dict):
    """Ids of short keys, in two ages: a full young one becomes the old one, and keys seen again return from it."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def find(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.find(key)
        if len(key) <= 64:
            if len(self) >= MEMORY_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class PartIds(Remembered):
    """Ids of a part: a run of letters, a digit, a run of signs or a contraction, by the tokenizer's own merges."""

    def __init__(self, tokenizer, to_bytes: dict[int, str]):
        super().__init__()
        self.model, self.to_bytes = tokenizer.model, to_bytes

    def find(self, key: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(key if key.isascii() else key.translate(self.to_bytes))]
        return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(Remembered):
    """Ids of a piece of text without blanks or line feeds, found by the tokenizer when first seen.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    pieces in order. A new piece of printable ASCII characters and plain alphabetic letters is split
    here as the tokenizer splits it, and its parts are remembered too; any other piece, and one that
    may hold a special string, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fits = None
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"].get("pretokenizers", [])
        if [s.get("pattern", {}).get("Regex") for s in steps] == [SPLIT, None]:
            self._learn_letters()

    def _learn_letters(self) -> None:
        """Ask the tokenizer what it makes of each single character of the short way."""
        normal, cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.lower, to_bytes, letters = {}, {}, set()
        for c in map(chr, [*range(0x21, 0x7F), *range(0xA0, LAST_LETTER + 1)]):
            low = normal(c)
            if c >= "\x80" and not (c.isalpha() and len(low) == 1 and len(cut(f"a{low}a")) == 1):
                continue
            self.lower[ord(c)] = low
            to_bytes[ord(low)] = cut(low)[0][0]
            if low.isalpha():
                letters.add(low)
        letter = "".join(sorted(letters))
        self.special = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.fits = re.compile(f"[{re.escape(''.join(map(chr, self.lower)))}]+").fullmatch
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[0-9]|[^0-9{letter}]+").findall
        self.parts = PartIds(self.tokenizer, to_bytes)

    def find(self, key: str) -> bytes:
        if self.fits and self.special not in key:
            if key.isascii() and key.isprintable():
                low = key.lower()
                return b"".join(map(self.parts.__getitem__, (low,) if low.isalpha() else self.split(low)))
            if self.fits(key):
                return b"".join(map(self.parts.__getitem__, self.split(key.translate(self.lower))))
        return np.array(self.tokenizer.encode(key, add_special_tokens=False).ids, "<u4").tobytes()


_LOADED: dict[str, WordIds] = {}


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _LOADED:
            _LOADED[path] = WordIds(path)
        words = _LOADED[path]
        part, start, place = TaskContext.get().partitionId(), 0, 0
        end = np.array([END_ID], "<u4").tobytes()

        def batch(rows):
            doc, places, starts, ids = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array(doc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(places, pa.int64()),
                pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
            ], ["doc_id", "part", "place", "local_start", "n_tokens", "ids"])

        held, size = [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                pieces = text.as_py().replace("\n", " ").split(" ")
                ids = b"".join(map(words.__getitem__, pieces)) + end
                held.append((doc, place, start, ids))
                start += len(ids) // 4
                place += 1
                size += len(ids)
                if size > OUT_BYTES:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    return run


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Written table (doc_id, part, place, local_start, n_tokens, ids): ids as little-endian 32-bit, end id last."""
    return settle(texts(docs).mapInArrow(_tokenize(path), TOKENIZED), "pack_ids")


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids; only the last sequence can be shorter.

    Every row of ``docs`` is a document of its own, also when it repeats an id; null and empty texts
    are the end id alone. Columns: doc_id, start, length, doc_tokens, sequence_id, offset, ids (the
    piece), ids_crc32, opens and closes (the piece holds the document's first, last id).
    """
    ids = tokenized(docs, path)
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row of two numbers for each partition of the tokenized table.
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    w = F.lit(window)
    placed = ids.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("local_start"))
    last = F.floor((F.col("at") + F.col("n_tokens") - 1) / w).cast("bigint")
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("at") / w).cast("bigint"), last)))
    start = F.greatest(F.lit(0), F.col("sequence_id") * w - F.col("at"))
    stop = F.least(F.col("n_tokens"), (F.col("sequence_id") + 1) * w - F.col("at"))
    cut = cut.withColumn("start", start).withColumn("length", stop - start)
    piece = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return cut.select(
        "doc_id", "start", "length", F.col("n_tokens").alias("doc_tokens"), "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * w).alias("offset"), piece.alias("ids"),
        (F.col("start") == 0).alias("opens"), (F.col("start") + F.col("length") == F.col("n_tokens")).alias("closes"),
    ).withColumn("ids_crc32", F.crc32("ids"))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids): whole sequences, padded to ``window`` unless their length is a power of two."""
    parts = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex")))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["hex"]), "")
    pad = "".join(f"{b:02X}" for b in pad_id.to_bytes(4, "little"))
    is_power = F.bit_count("length") == 1
    missing = F.when(is_power, 0).otherwise(F.lit(window) - F.col("length")).cast("int")
    return parts.select("sequence_id", "length", F.unhex(F.concat(joined, F.repeat(F.lit(pad), missing))).alias("ids"))


