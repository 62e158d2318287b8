"""Token counts by finite-state machines compiled from a byte-level BPE vocabulary.

Two deterministic transducers count tokens without building them.

* The splitter walks code points and marks where a pre-token starts. It has eight states, so a chunk of
  text is a map from entry state to exit state. The maps of all chunks of a block are computed at once
  and composed by a parallel prefix scan; each chunk then knows its entry state.
* The counter walks the bytes of a pre-token. A state holds every way the bytes read so far can still be
  continued: (last finished token or the tokens that may follow it, trie node of the unfinished one, tokens so far). One of the ways is the
  encoding of the bytes read so far, so every transition has a number: the tokens this byte adds to (or
  takes from) that encoding. The numbers along a pre-token sum up to its token count. Transitions are
  made when first needed and kept in flat tables that all pre-tokens of a block walk in step.

A sequence of tokens is the encoding of its bytes exactly if each pair of neighbours is the encoding of
the pair's bytes; that is what makes the states finite.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import texts
from clickloom.llm.textblocks import blocks

#: States whose transitions are kept in tables; beyond that transitions are worked out each time.
MOST_STATES = 40_000
CHUNK = 64
#: Below a trie node with so few tokens a way keeps which of them are possible, not what came before.
FEW_TOKENS = 64

# Symbols the splitter reads. White space and apostrophes are split by what follows them.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, BLANK_BEFORE, SPACE_BEFORE, SPACE_INSIDE, END = range(9)
# Its states: at a pre-token's start, inside one of a kind, after a joined blank, one or two characters
# before the end of a contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
# Contractions split off by the pre-token pattern.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a pre-token start here), both indexed by symbol * 8 + state."""
    nxt, new = np.zeros((9, 8), np.uint8), np.zeros((9, 8), np.uint8)
    for symbol, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        nxt[symbol] = inside
        new[symbol] = 1
        new[symbol, [inside, AFTER_BLANK]] = 0
    nxt[LETTER, ONE_MORE], nxt[LETTER, TWO_MORE] = START, ONE_MORE
    new[LETTER, [ONE_MORE, TWO_MORE]] = 0
    for symbol, state in ((QUOTE1, ONE_MORE), (QUOTE2, TWO_MORE)):
        nxt[symbol], new[symbol] = state, 1
        nxt[symbol, [IN_OTHERS, AFTER_BLANK]] = IN_OTHERS
        new[symbol, [IN_OTHERS, AFTER_BLANK]] = 0
    nxt[BLANK_BEFORE], new[BLANK_BEFORE] = AFTER_BLANK, 1
    nxt[SPACE_BEFORE], new[SPACE_BEFORE] = START, 1
    nxt[SPACE_INSIDE], new[SPACE_INSIDE] = IN_SPACE, 1
    new[SPACE_INSIDE, IN_SPACE] = 0
    return nxt.ravel(), new.ravel()


NEXT, NEW = splitter_tables()


def scan_states(symbols: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, by composing the state maps of chunks of ``symbols``."""
    n = len(symbols)
    m = -(-n // CHUNK)
    padded = np.full(m * CHUNK, END, np.uint8)
    padded[:n] = symbols
    lanes = np.ascontiguousarray(padded.reshape(m, CHUNK).T) * np.uint8(8)
    maps = np.tile(np.arange(8, dtype=np.uint8), (m, 1))
    for j in range(CHUNK):
        maps = NEXT.take(lanes[j][:, None] + maps)
    step = 1
    while step < m:  # prefix scan: after it, map i leads from before the first chunk to behind chunk i
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.zeros(m, np.uint8)
    state[1:] = maps[:-1, START]
    marks = np.empty((CHUNK, m), np.uint8)
    for j in range(CHUNK):
        at = lanes[j] + state
        marks[j] = NEW.take(at)
        state = NEXT.take(at)
    return marks.T.reshape(-1)[:n].astype(bool)


def character_classes(path: str) -> list[tuple[int, int, int]]:
    """Ranges (first, last, class) of code points as the tokenizer's own pattern sees them.

    Classes: 0 letter, 1 number, 2 other, 3 white space; code points in no range are other. Each code
    point is put behind a letter, a number and a mark to see which of them it joins. Planes without
    characters are other.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    found = np.full(0x110000, 2, np.uint8)
    for low in [*range(0, 0x40000, 0x2000), 0xE0000]:
        points = [c for c in range(low, low + 0x2000) if not 0xD800 <= c <= 0xDFFF]
        if not points:
            continue
        joins = []
        for before, after in (("a", "!"), ("1", "!"), ("!", "a")):
            text = "".join(before + chr(c) + after for c in points)
            starts = np.zeros(len(text) + 1, bool)
            starts[[span[0] for _, span in split(text)]] = True
            joins.append(~starts[1 : 3 * len(points) : 3])
        found[points] = np.select(joins, [0, 1, 2], 3)
    edges = np.flatnonzero(np.diff(found)) + 1
    firsts = np.concatenate([[0], edges])
    lasts = np.concatenate([edges, [len(found)]]) - 1
    return [(int(a), int(b), int(found[a])) for a, b in zip(firsts, lasts, strict=True) if found[a] != 2]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class Counter:
    """The counting transducer of a vocabulary, grown as texts need it."""

    def __init__(self, path: str, most_states: int = MOST_STATES):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = _byte_letters()
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.single = {self.bytes_of[i][0]: i for i in self.bytes_of if len(self.bytes_of[i]) == 1}
        self.specials = [t["content"] for t in data["added_tokens"]]
        self.halves = {new: (*pair, rank) for pair, (rank, new) in self.merges.items()}
        # Trie of all tokens in order of their bytes: the tokens below a node are one range of places.
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.sorted = sorted(self.bytes_of, key=self.bytes_of.__getitem__)
        self.place = {t: i for i, t in enumerate(self.sorted)}
        first, last = [0], [len(self.sorted)]
        for i, t in enumerate(self.sorted):
            node = 0
            for b in self.bytes_of[t]:
                nxt = self.child.get(node * 256 + b)
                if nxt is None:
                    nxt = self.child[node * 256 + b] = len(first)
                    first.append(i)
                    last.append(i)
                node = nxt
                last[node] = i + 1
            self.token_at[node] = t
            first[node] = i + 1  # a node's own token comes before those below it
        last[0] = len(self.sorted)
        self.first, self.last = first, last
        self.right_edges: dict[int, list] = {}
        self.left_edges: dict[int, list] = {}
        self.alone_ok: dict[int, bool] = {}
        self.below: dict[tuple[int, int], tuple] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.most = most_states
        self.forget()

    def forget(self) -> None:
        """Start the tables anew: state 0 is a pre-token's start, state 1 stands for 'counted elsewhere'."""
        start = ((-1, 0, 0),)
        self.states, self.index = [start, ()], {start: 0}
        self.next = np.full((1024, 256), -1, np.int32)
        self.adds = np.zeros((1024, 256), np.int16)
        self.next[1] = 1
        self.walked = self.elsewhere = 0

    def encode(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes: merge the pair of lowest rank until none is left."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            ranks = [self.merges.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:], strict=False)]
            best, new = min(ranks)
            if best == 1 << 60:
                break
            out, i = [], 0
            while i < len(ids):
                if i < len(ranks) and ranks[i][0] == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stood at one end (0 left, 1 right) while ``token`` was merged, and when each was used up."""
        known = (self.left_edges, self.right_edges)[side]
        if token not in known:
            chain = [(token, 1 << 60)]
            while (t := chain[-1][0]) in self.halves:
                half = self.halves[t]
                chain.append((half[side], half[2]))
            known[token] = chain[::-1]
        return known[token]

    def fits(self, before: int, token: int) -> bool:
        """Are ``before`` (-1: nothing) and ``token`` the encoding of their bytes together?

        Both sides merge as they would alone until a merge across the border comes first.
        """
        key = (before, token)
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= 400_000:
            self.pairs.clear()
        if token not in self.alone_ok:
            self.alone_ok[token] = self.encode(self.bytes_of[token]) == [token]
        good = self.alone_ok[token]
        if good and before >= 0:
            left, right = self.edge(before, 1), self.edge(token, 0)
            i = j = 0
            while True:
                (a, a_until), (b, b_until) = left[i], right[j]
                across = self.merges.get((a, b), (1 << 61, 0))[0]
                # Of equal merges the one further left is done first.
                if across < a_until and across <= b_until:
                    good = False
                    break
                if a_until == b_until == 1 << 60:
                    break
                if a_until <= b_until:
                    i += 1
                else:
                    j += 1
        self.pairs[key] = good
        return good

    def context(self, before: int, node: int):
        """What ``before`` means for the tokens below ``node``: itself, or which of a few of them may follow it."""
        first, last = self.first[node], self.last[node]
        if last - first > FEW_TOKENS:
            return before
        key = (before, node)
        known = self.below.get(key)
        if known is None:
            if len(self.below) >= 200_000:
                self.below.clear()
            known = self.below[key] = tuple(p for p in range(first, last) if self.fits(before, self.sorted[p]))
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after ``byte`` and the tokens it adds to the encoding.

        A way is (context, trie node, tokens); one that no token can end is left out.
        """
        ways, done = [], None
        for context, node, tokens in state:
            child = self.child.get(node * 256 + byte)
            if child is None:
                continue
            token = self.token_at.get(child)
            if isinstance(context, tuple):
                ends = token is not None and self.place[token] in context
                first, last = self.first[child], self.last[child]
                below = tuple(p for p in context if first <= p < last)
            else:
                ends = done is None and token is not None and self.fits(context, token)
                below = self.context(context, child)
            if below != ():
                ways.append((below, child, tokens))
            if ends and done is None:
                done = (token, tokens + 1)
        token, added = done
        return (*((c, n, t - added) for c, n, t in ways), (token, 0, 0)), added

    def transition(self, state: int, byte: int) -> bool:
        """Fill in one transition; False if the tables are full."""
        after, added = self.step(self.states[state], byte)
        to = self.index.get(after)
        if to is None:
            if len(self.states) >= self.most:
                return False
            to = self.index[after] = len(self.states)
            self.states.append(after)
            if to >= len(self.next):
                more = min(self.most, 2 * len(self.next)) - len(self.next)
                self.next = np.concatenate([self.next, np.full((more, 256), -1, np.int32)])
                self.adds = np.concatenate([self.adds, np.zeros((more, 256), np.int16)])
        self.next[state, byte], self.adds[state, byte] = to, added
        return True

    def alone(self, data: bytes) -> int:
        """Tokens of one pre-token without the tables."""
        state, total = ((-1, 0, 0),), 0
        for b in data:
            state, added = self.step(state, b)
            total += added
        return total

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Token counts of pre-tokens of ``data``, all walked in step, the longest first."""
        if self.elsewhere > 0.1 * self.walked:
            self.forget()  # the kept states are not those of the texts at hand
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        apart: list[int] = []
        j = 0
        while True:
            live = int(np.searchsorted(-lengths, -j))  # pre-tokens of more than j bytes
            if not live:
                break
            at = state[:live] * 256 + data[starts[:live] + j]
            to = self.next.ravel()[at]
            lost = np.flatnonzero(to < 0)
            if len(lost):
                for key in np.unique(at[lost]).tolist():
                    self.transition(key >> 8, key & 255)
                to = self.next.ravel()[at]
                full = np.flatnonzero(to < 0)
                apart += full.tolist()
                to[full] = 1
            total[:live] += self.adds.ravel()[at]
            state[:live] = to
            j += 1
            if live <= 8:
                break
        for i in range(live):  # a few very long ones are left: walk each to its end
            if state[i] != 1:
                self._walk(data, int(starts[i]), j, int(lengths[i]), int(state[i]), total, i, apart)
        for i in apart:
            total[i] = self.alone(data[starts[i] : starts[i] + lengths[i]].tobytes())
        self.walked += len(starts)
        self.elsewhere += len(apart)
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def _walk(self, data, start, j, length, state, total, i, apart) -> None:
        for b in data[start + j : start + length].tobytes():
            if self.next[state, b] < 0 and not self.transition(state, b):
                apart.append(i)
                return
            total[i] += self.adds[state, b]
            state = int(self.next[state, b])


class TokenCounter:
    """Counts of whole texts: special strings, splitter and counter."""

    def __init__(self, path: str, classes: list[tuple[int, int, int]], most_states: int = MOST_STATES):
        self.counter = Counter(path, most_states)
        self.classes = np.full(0x110000, 2, np.uint8)
        for first, last, kind in classes:
            self.classes[first : last + 1] = kind
        self.special = re.compile("|".join(map(re.escape, sorted(self.counter.specials, key=len, reverse=True)))) if self.counter.specials else None

    def symbols(self, cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kind = self.classes[cp]
        symbol = kind.copy()
        after = np.empty_like(kind)
        after[:-1] = kind[1:]
        after[-1] = 3
        after[ends - 1] = 3  # the end of a piece counts as white space; harmless where a piece is empty
        space = kind == 3
        symbol[space] = np.where(after == 3, SPACE_INSIDE, np.where(cp == 32, BLANK_BEFORE, SPACE_BEFORE))[space]
        quotes = np.flatnonzero(cp == 39)
        quotes = quotes[quotes + 2 < len(cp) + 1]
        if len(quotes):
            wide = np.concatenate([cp, [0, 0]])
            wide[ends] = 0
            a, b = wide[quotes + 1], wide[quotes + 2]
            symbol[quotes[np.isin(a, [ord(c) for c in SHORT_ENDINGS])]] = QUOTE1
            pairs = a.astype(np.int64) << 21 | b
            symbol[quotes[np.isin(pairs, [ord(x) << 21 | ord(y) for x, y in LONG_ENDINGS])]] = QUOTE2
        symbol[ends] = END
        return symbol

    def pieces(self, held: list[str]) -> np.ndarray:
        """Token counts of texts without special strings."""
        text = "\0".join(held) + "\0"
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter((len(x) + 1 for x in held), np.int64, len(held))
        ends = np.cumsum(sizes) - 1
        starts_here = scan_states(self.symbols(cp, ends))
        starts_here[ends] = False
        cuts = starts_here.copy()
        cuts[ends] = True
        cut_at = np.flatnonzero(cuts)
        is_start = starts_here[cut_at]
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        byte_at = np.cumsum(width) - width
        first = byte_at[cut_at]
        length = np.diff(np.append(first, first[-1]))[is_start]
        first = first[is_start]
        counts = self.counter.count(np.frombuffer(text.encode("utf-8"), np.uint8), first, length)
        piece = np.searchsorted(ends, cut_at[is_start])
        return np.bincount(piece, counts, len(held)).astype(np.int64)

    def counts(self, values: list[str | None]) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for at, held in blocks(values):
            pieces, owner = held, np.arange(len(held))
            if self.special is not None and any(self.special.search(x) for x in held):
                split = [self.special.split(x) for x in held]
                owner = np.repeat(owner, [len(x) for x in split])
                pieces = [y for x in split for y in x]
                out[at : at + len(held)] += np.array([len(x) - 1 for x in split])
            out[at : at + len(held)] += np.bincount(owner, self.pieces(pieces), len(held)).astype(np.int64)
        return out


_CLASSES: dict[str, list] = {}
_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: whole texts, null as empty.

    ``path``: a byte-level BPE file, at the same place on every executor. Each row is counted on its
    own, so repeated ids and rows need no rule. No shuffle.
    """
    if path not in _CLASSES:
        _CLASSES[path] = character_classes(path)
    classes = _CLASSES[path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(path, classes)
        counter = _COUNTERS[path]
        for b in batches:
            n = pa.array(counter.counts(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    sized = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    counted = sized.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
