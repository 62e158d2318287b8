"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

The corpus is its own reference, so sending every shard to every document would be quadratic. Shards are
keyed instead: every window of ``length`` words has an anchor, the smallest hash among its short grams,
and equal windows have equal anchors at the same place. Neighbouring windows with the same anchor form a
passage; a shard holds the passages of one anchor, from all documents. Passages whose anchor occurs once
are never moved. An anchor with very many passages is split further, by the window itself.

In a shard a suffix automaton of its different passages is built, and every passage is streamed through
it: where the match reaches ``length`` words, the automaton's state names the window, and windows met
twice are repeated. Spans are removed word by word in the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import WORD, hot_join, texts
from clickloom.llm.textblocks import Words, blocks, grams
from clickloom.state import settle

#: Words of the grams from which anchors are chosen.
GRAM = 12
#: Passages of one anchor in a shard; beyond that its windows are dealt by their own words.
MOST_PASSAGES = 500

_WORDS = re.compile(WORD)


class SuffixAutomaton:
    """All substrings of the sequences added, with the suffix link and longest length of each state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:  # already there from an earlier sequence
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def windows(self, sequence: list, size: int) -> Iterator[tuple[int, int]]:
        """(start, state) of every window of ``size`` items whose matching statistic reaches ``size``."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            while state and length[link[state]] >= size:
                state = link[state]
                matched = length[state]
            if matched >= size:
                yield i + 1 - size, state


def shard_masks(passages: dict[str, int], size: int) -> dict[str, int]:
    """For the passages of a shard, with their numbers of occurrences: bits of the windows met twice or more."""
    if len(passages) == 1:
        ((text, n),) = passages.items()
        # Windows of one passage differ, as their anchor stands at different places.
        return {text: (1 << (text.count(" ") + 2 - size)) - 1} if n > 1 else {}
    automaton = SuffixAutomaton()
    split = {text: text.split(" ") for text in passages}
    for sequence in split.values():
        automaton.add(sequence)
    met: dict[int, int] = {}
    seen = []
    for text, sequence in split.items():
        n = passages[text]
        for start, state in automaton.windows(sequence, size):
            met[state] = met.get(state, 0) + n
            seen.append((text, start, state))
    masks: dict[str, int] = {}
    for text, start, state in seen:
        if met[state] > 1:
            masks[text] = masks.get(text, 0) | 1 << start
    return masks


def _anchored(size: int):
    """Per document: words, hash of its kept text if nothing goes, and its passages."""
    span = size - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("text").to_pylist()
            n_words, whole, anchors, starts, counts = [], [], [], [], []
            for _, held in blocks(values):
                w = Words(held)
                n_words += w.counts.tolist()
                whole += [hashlib.sha256(" ".join(_WORDS.findall(x)).encode()).hexdigest() for x in held]
                text = w.text_of_word()
                g = grams(w.hashes, GRAM)
                n = len(w.hashes) - size + 1
                if n <= 0:
                    windows = np.zeros(0, np.int64)
                else:
                    windows = np.flatnonzero(text[:n] == text[size - 1 :])
                if len(windows):
                    least = np.lib.stride_tricks.sliding_window_view(g, span)
                    at = np.concatenate([least[lo : lo + 65536].argmin(1) for lo in range(0, len(least), 65536)])
                    at = (at + np.arange(len(at)))[windows]
                    new = np.ones(len(windows), bool)
                    new[1:] = (at[1:] != at[:-1]) | (np.diff(windows) != 1)
                    first = np.flatnonzero(new)
                    size_of = np.diff(np.append(first, len(windows)))
                    owner = text[windows[first]]
                    offset = windows[first] - w.first[owner]
                    anchor = g[at[first]].view(np.int64)
                    cuts = np.searchsorted(owner, np.arange(1, len(held)))
                    anchors += np.split(anchor, cuts)
                    starts += np.split(offset.astype(np.int32), cuts)
                    counts += np.split(size_of.astype(np.int32), cuts)
                else:
                    anchors += [np.zeros(0, np.int64)] * len(held)
                    starts += [np.zeros(0, np.int32)] * len(held)
                    counts += [np.zeros(0, np.int32)] * len(held)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("row"), pa.array(n_words, pa.int64()), pa.array(whole, pa.string()),
                pa.array(anchors, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())),
            ], ["doc_id", "row", "n_words", "whole_sha256", "anchors", "starts", "counts"])

    return run


def _cut(size: int):
    """Passages of documents; a passage's text only where the batch has it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first_at = [], {}
            for row, text, runs in zip(b.column("row").to_pylist(), b.column("text"), b.column("runs").to_pylist(), strict=True):
                words = _WORDS.findall(text.as_py())
                for r in runs:
                    spans = [(r["start"], r["count"])]
                    if r["hot"]:
                        spans = [(r["start"] + j, 1) for j in range(r["count"])]
                    for start, count in spans:
                        passage = " ".join(words[start : start + count + size - 1])
                        name = int.from_bytes(hashlib.blake2b(passage.encode(), digest_size=8).digest(), "little", signed=True)
                        key = name if r["hot"] else r["anchor"]
                        at = first_at.setdefault((key, passage), len(rows))
                        if at == len(rows):
                            rows.append([key, name, row, start, 1, passage])
                        else:
                            rows[at][4] += 1
                            rows.append([key, name, row, start, None, None])
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "name", "row", "start", "n", "passage"]
            )

    return run


def _shards(size: int):
    """Decide shard after shard of a partition sorted by key."""

    def decide(key, names, passages):
        masks = shard_masks(passages, size)
        return [(key, names[p], m, passages[p]) for p, m in masks.items()]

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "name", "mask", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, passages, out = None, {}, {}, []
        for b in batches:
            for k, name, n, p in zip(*(b.column(c).to_pylist() for c in ("key", "name", "n", "passage")), strict=True):
                if k != key:
                    if passages:
                        out += decide(key, names, passages)
                    key, names, passages = k, {}, {}
                    if len(out) > 20_000:
                        yield batch(out)
                        out = []
                passages[p] = passages.get(p, 0) + n
                names[p] = name
        if passages:
            out += decide(key, names, passages)
        yield batch(out)

    return run


def _removed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, kept = [], []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                words = _WORDS.findall(text.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    at = s["start"] + np.flatnonzero([s["mask"] >> j & 1 for j in range(s["mask"].bit_length())])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n.append(int(gone.sum()))
                kept.append(" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["row", "n_removed", "kept"])

    return run


def remove_repeated(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, row, n_words, n_removed, kept, whole_sha256): words in windows of ``length`` found elsewhere go.

    ``kept`` holds the words left, joined by one blank; it is null where nothing goes (``whole_sha256``
    is then the hash of all words). Windows are judged on the input. Every row is a document, so rows
    that repeat a text lose it. Null and short texts have no window.
    """
    slim = texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    found = settle(
        slim.mapInArrow(
            _anchored(length),
            "doc_id bigint, row bigint, n_words bigint, whole_sha256 string, anchors array<bigint>, starts array<int>, counts array<int>",
        ),
        "sub_docs",
    )
    runs = found.select("row", F.explode(F.arrays_zip("anchors", "starts", "counts")).alias("r")).select(
        "row", F.col("r.anchors").alias("anchor"), F.col("r.starts").alias("start"), F.col("r.counts").alias("count")
    )
    shared = settle(
        runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("hot", F.col("n") > MOST_PASSAGES), "sub_anchors"
    )
    wanted = (
        hot_join(runs, shared, ["anchor"], "n", ["row", "start"])
        .groupBy("row")
        .agg(F.collect_set(F.struct("anchor", "start", "count", "hot")).alias("runs"))
    )
    passages = settle(
        slim.join(wanted, "row").select("row", "text", "runs")
        .mapInArrow(_cut(length), "key bigint, name bigint, row bigint, start int, n bigint, passage string"),
        "sub_passages",
    )
    sorted_shards = passages.where("passage is not null").select("key", "name", "n", "passage").repartition("key").sortWithinPartitions("key")
    repeated = settle(sorted_shards.mapInArrow(_shards(length), "key bigint, name bigint, mask bigint, n bigint"), "sub_repeated")
    spans = (
        hot_join(passages.select("key", "name", "row", "start"), repeated, ["key", "name"], "n", ["row", "start"])
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", "mask")).alias("spans"))
    )
    cut = slim.join(spans, "row").dropDuplicates(["row"]).select("row", "text", "spans").mapInArrow(_removed(length), "row bigint, n_removed bigint, kept string")
    return found.select("doc_id", "row", "n_words", "whole_sha256").join(cut, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
