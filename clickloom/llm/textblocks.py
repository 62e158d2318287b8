"""Texts of one Arrow batch as arrays: words, word hashes and shingles without a loop over characters.

Memory follows the block (about a million characters, or one text if that is longer), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_CHARS = 1_000_000
#: Where results of a block do not depend on its size: several arrays of eight bytes a character are held at once.
SMALL_BLOCK_CHARS = 250_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def blocks(values: Iterable[str | None] | pa.Array, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of neighbouring texts (null: empty) of about ``chars`` characters, with their first index.

    Of an Arrow array only the block's texts become strings.
    """
    start, held, size = 0, [], 0
    for i, v in enumerate(values):
        v = (v.as_py() if isinstance(v, pa.Scalar) else v) or ""
        if held and size + len(v) > chars:
            yield start, held
            start, held, size = i, [], 0
        held.append(v)
        size += len(v) + 1
    if held:
        yield start, held


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_CHARS + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            p = np.cumprod(p, dtype=np.uint64)
            if len(_POWERS) > k:
                _POWERS[k] = p
            else:
                _POWERS.append(p)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """Words of a block of texts.

    ``cp``: code points, a line feed after each text. ``text_at``: start of each text, one more at the
    end. ``starts, ends``: each word's span. ``first``: index of each text's first word, one more at
    the end. ``hashes``: 64-bit hash of each word.
    """

    def __init__(self, values: list[str], lower: bool = False, seed: int = 0):
        data = ("\n".join(values) + "\n").encode("utf-32-le", "surrogatepass")
        cp = np.frombuffer(data, np.uint32)
        if lower:
            cp = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
        self.cp = cp
        self.text_at = np.zeros(len(values) + 1, np.int64)
        np.cumsum(np.fromiter((len(v) + 1 for v in values), np.int64, len(values)), out=self.text_at[1:])
        self.space = (cp == 32) | ((cp >= 9) & (cp <= 13))
        edge = np.diff(self.space.astype(np.int8), prepend=1)
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge[1:] == 1) + 1
        self.first = np.searchsorted(self.starts, self.text_at)
        self.counts = np.diff(self.first)
        self.hashes = self.span_hashes(self.starts, self.ends, seed)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hashes of spans of code points by differences of one running polynomial."""
        power, inverse = _powers(len(self.cp))
        terms = mixed(self.cp.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2 * seed + 1)) * power
        sums = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        length = (ends - starts).astype(np.uint64)
        return mixed((sums[ends] - sums[starts]) * inverse[starts] + length)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def factors(k: int, seed: int = 0) -> np.ndarray:
    """Odd multipliers for the places of a sequence of ``k`` hashes."""
    x = mixed(np.arange(1 + 1000 * seed, k + 1 + 1000 * seed, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return x | np.uint64(1)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``k`` neighbouring hashes; the caller leaves out those that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, f in enumerate(factors(k, seed)):
        total += hashes[j : j + n] * f
    return mixed(total)


def shingles(w: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every shingle of ``k`` words; a text of fewer words gives its whole sequence."""
    text = w.text_of_word()
    at = np.arange(len(text))
    whole = at + k <= w.first[text + 1] if len(text) else np.zeros(0, bool)
    if len(text) >= k:
        g = grams(w.hashes, k, seed)
        full = np.flatnonzero(whole)
        out_text, out_hash = text[full], g[full]
    else:
        out_text, out_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        f = factors(k, seed)
        place = at - w.first[text]
        chosen = np.isin(text, short)
        terms = w.hashes[chosen] * f[place[chosen]]
        sums = np.add.reduceat(terms, np.cumsum(w.counts[short]) - w.counts[short])
        out_text = np.concatenate([out_text, short])
        out_hash = np.concatenate([out_hash, mixed(sums + w.counts[short].astype(np.uint64))])
    return out_text, out_hash


def distinct_pairs(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, ordered by text and value."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    if len(text):
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        text, value = text[new], value[new]
    return text, value
