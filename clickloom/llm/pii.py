"""Personal data by anchor expansion.

One Aho-Corasick automaton per task runs once over each whole text and stops at anchors: at-signs, plus
signs, digits, the ``://`` of a scheme, and cue words such as ``password`` or ``iban``. At an anchor a
small parser of that kind expands left and right to the borders of the address or account and validates
it. Parsers never look behind the end of their last match, and each kind's expansions go forward only,
so a text is read a bounded number of times however long it is.

All kinds are leftmost and do not overlap within a kind; matches that fail validation are dropped, and
nothing is tried again inside them. Base kinds:

* email: local part, at-sign, two labels or more
* ip: four numbers joined by dots, none above 255
* card: digits with single blanks or hyphens between them, 16 to 19 of them, Luhn's check sum
* phone: a plus sign and 8 to 15 digits with blanks, brackets, dots and hyphens among them

Kinds found by cue, whose spans are added to those:

* login: a scheme with a user part before the host (``https://user:word@host``)
* iban: after the cue ``iban``, two capitals, two digits, 11 to 30 more capitals or digits, in one piece or in
  groups of four, remainder 1 modulo 97
* account: the value behind an identifier cue and a colon, equals or number sign, six signs or more with
  at least two digits among them (pass words, tokens, account, customer, passport and insurance numbers)

Cues are found in any mixture of cases and only as whole words. Offsets are code points, ends exclusive.
A null or empty text has no spans; every input row comes back once, rows with null or repeated ids too.
Other columns are passed by, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")

# The words that announce an identifier.
CUES = (
    "account", "acct", "api key", "api-key", "api_key", "apikey", "customer", "login", "member", "passport",
    "passwd", "password", "pwd", "secret", "ssn", "tax", "token", "user", "userid", "username",
)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SCHEME = LETTERS | frozenset("0123456789+.-")
DIGITS = frozenset("0123456789")
WORDLIKE = LETTERS | DIGITS | frozenset("_")

# What may stand to the right of an anchor.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"[0-9][ ().0-9-]+[0-9]")
USER_HOST = re.compile(r"[A-Za-z0-9._%+~:-]+@[A-Za-z0-9.-]+")
IBAN = re.compile(
    r"[\"']?(?:[ \t]{0,2}[:=#][ \t]{0,2}|[ \t]{1,2})[\"']?([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?))\b", re.A
)
VALUE = re.compile(
    r"(?:[ _-]?(?:id|no|nr|number|key|code))?\.?[\"']?[ \t]{0,2}[:=#][ \t]{0,2}[\"']?([A-Za-z0-9][A-Za-z0-9._/+=-]{5,})", re.I | re.A
)

SPANS = "array<struct<kind:string,start:int,end:int>>"
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, nines cast out; the sum ends in 0."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


class Finder:
    """Spans of one text after another; one per task."""

    def __init__(self) -> None:
        import ahocorasick

        anchors = ahocorasick.Automaton()
        for word in ("@", "+", "://", *"0123456789", "iban", *CUES):
            kind = {"@": "email", "+": "phone", "://": "login", "iban": "iban"}.get(word, "digit" if word in DIGITS else "account")
            anchors.add_word(word, (kind, len(word)))
        anchors.make_automaton()
        self.anchors = anchors
        self.parsers: dict[str, Callable[[str, int, int], None]] = {
            "email": self.email, "phone": self.phone, "login": self.login, "iban": self.iban, "account": self.account, "digit": self.digit,
        }

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by kind as listed, then start."""
        self.found: dict[str, list[Span]] = {k: [] for k in KINDS}
        #: Where each parser's last match ended, failed ones included.
        self.done = dict.fromkeys(KINDS, 0)
        # Lowering the bytes lowers A-Z only, so places stay.
        for last, (kind, size) in self.anchors.iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
            self.parsers[kind](text, last + 1 - size, last + 1)
        return [(k, a, b) for k in KINDS for a, b in self.found[k]]

    def email(self, text: str, at: int, after: int) -> None:
        start, floor = at, self.done["email"]
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, after)):
            self.done["email"] = m.end()
            self.found["email"].append((start, m.end()))

    def digit(self, text: str, at: int, after: int) -> None:
        if at >= self.done["ip"]:
            m = NUMBERS.match(text, at)
            self.done["ip"] = m.end()
            if m.end() - at >= 7:
                self.addresses(text, at, m.end())
        if at >= self.done["card"]:
            m = CARD.match(text, at)
            self.done["card"] = m.end() if m else after
            if m and m.end() - at >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.found["card"].append(m.span())

    def addresses(self, text: str, start: int, end: int) -> None:
        """Four numbers of the chain after the other; what is left over is none."""
        parts = text[start:end].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                self.found["ip"].append((start, start + size))
            start += size + 1

    def phone(self, text: str, at: int, after: int) -> None:
        if at < self.done["phone"]:
            return
        if m := PHONE.match(text, after):
            self.done["phone"] = m.end()
            if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                self.found["phone"].append((at, m.end()))

    def login(self, text: str, at: int, after: int) -> None:
        start, floor, first = at, self.done["login"], None
        while start > floor and text[start - 1] in SCHEME:
            start -= 1
            if text[start] in LETTERS:
                first = start
        if first is not None and (m := USER_HOST.match(text, after)):
            self.done["login"] = m.end()
            self.found["login"].append((first, m.end()))

    def iban(self, text: str, at: int, after: int) -> None:
        if at < self.done["iban"] or (at and text[at - 1] in WORDLIKE):
            return
        if m := IBAN.match(text, after):
            self.done["iban"] = m.end()
            if iban_ok(m[1]):
                self.found["iban"].append(m.span(1))

    def account(self, text: str, at: int, after: int) -> None:
        if at < self.done["account"] or (at and text[at - 1] in WORDLIKE):
            return
        if m := VALUE.match(text, after):
            self.done["account"] = m.end()
            value = m[1].rstrip("._/+=-")
            if len(value) >= 6 and sum(c in DIGITS for c in value) >= 2:
                self.found["account"].append((m.start(1), m.start(1) + len(value)))


@lru_cache(maxsize=1)
def finder() -> Finder:
    return Finder()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) of every row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder().spans
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(rows, pa.list_(kind))], ["doc_id", "text", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(found, f"doc_id bigint, text string, spans {SPANS}")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: str = "spans") -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first and longest counts."""
    order = F.array_sort(spans, lambda a, b: F.coalesce(F.nullif(a["start"] - b["start"], F.lit(0)), b["end"] - a["end"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] >= acc["at"], F.struct(put.alias("out"), s["end"].alias("at"))).otherwise(acc)

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    return F.aggregate(order, start, step, rest)
