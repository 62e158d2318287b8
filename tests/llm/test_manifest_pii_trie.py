"""Merkle manifest, personal data and prefix trie against brute force and edge tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clickloom.llm import common, merkle, pii, prefix_trie

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, root string, key string, node int, up int"


# Merkle manifest


def brute_manifest(rows):
    """Per row: (doc_id, leaf, subroot, root, proof digest, folded root)."""
    hashed = []
    for i, source, lang, n, text in rows:
        field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        leaf = sha("".join(map(field, (i, source, lang, n, text))))
        cut = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        found = sha("".join(map(field, (i, source, lang, n, cut))))
        hashed.append((source, i, leaf, found))

    def climb(nodes):
        """The top, and per node the steps (left, right) to it."""
        steps, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k in range(len(where)):
                at = where[k]
                run = at // 3 * 3
                steps[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
                where[k] = at // 3
            nodes = [sha("".join(nodes[j : j + 3])) for j in range(0, len(nodes), 3)]
        return nodes[0], steps

    by_source = defaultdict(list)
    for r in hashed:
        by_source[r[0]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        tops[s] = climb([r[2] for r in by_source[s]])
    root, upper = climb([tops[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, above in zip(sources, upper, strict=True):
        for (_, i, leaf, found), own in zip(by_source[s], tops[s][1], strict=True):
            steps = own + above
            h = found
            for left, right in steps:
                h = sha(left + h + right)
            out.append((i, leaf, tops[s][0], root, sha("".join(a + b for a, b in steps)), h))
    return out


def manifest_rows(docs):
    out = merkle.manifest(docs, merkle.without_line_feeds()).withColumn("folded", merkle.folded(F.coalesce("found", "leaf")))
    cols = ["doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof"), "folded"]
    return Counter(tuple(r) for r in out.select(*cols).collect())


@pytest.fixture(scope="module")
def records():
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", "é", "", "hot", "hot", "hot"]), rnd.choice(["en", None]), rnd.randint(0, 9), f"x\n{i}\n") for i in range(120)]
    rows += [(None, None, None, None, None), (None, "a", "en", 1, "t\n"), (7, None, "en", None, ""), (-5, "a", None, 2, "\n" * 9), (9, "hot", "en", 1, "long " * 50_000)]
    rows += [rows[3], rows[3], (rows[3][0], "hot", "en", 1, "another\ntext"), (2**63 - 1, "b", "en", 1, "far"), (-(2**63), "b", "en", 1, "far")]
    rows += [(500 + i, "single" + str(i), "en", 1, "one\n") for i in range(11)]
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", 1, 2) for r in rows], DOCS).repartition(3)


def test_manifest_is_that_of_brute_force(spark, records, many_ranges):
    assert manifest_rows(as_docs(spark, records)) == Counter(brute_manifest(records))


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest_over_several_rounds_of_blocks(spark, records, monkeypatch, many_ranges, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 3**depth)
    assert manifest_rows(as_docs(spark, records)) == Counter(brute_manifest(records))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_manifest_of_few_rows(spark, records, n):
    rows = [(i, "s", "en", 1, f"{i}\n") for i in range(n)]
    assert manifest_rows(as_docs(spark, rows)) == Counter(brute_manifest(rows))


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_untouched_texts_fold_to_the_root(spark, records):
    out = merkle.manifest(as_docs(spark, records))
    assert out.where(merkle.folded(F.col("leaf")) != F.col("root")).count() == 0
    assert out.where("found is not null").count() == 0


def test_numbers_go_on_over_ranges(spark, many_ranges):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    got = common.numbered(rows.repartition(5), "g", ["v"], "numbers").collect()
    want = defaultdict(list)
    for r in rows.collect():
        want[r["g"]].append(r["v"])
    assert {(r["g"], r["v"], r["_rank"], r["_total"]) for r in got} == {
        (g, v, i, len(vs)) for g, vs in want.items() for i, v in enumerate(sorted(vs))
    }
    assert len({r["_part"] for r in got if r["g"] == "hot"}) > 1


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(digits[::-1]):
        total += sum(divmod(int(d) * 2, 10)) if i % 2 else int(d)
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))
                or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 8 <= len(digits) <= 15
            ):
                out.append((kind, *m.span()))
    return out


def base_of(text):
    return [s for s in pii.Finder().spans(text) if s[0] in pii.BASE]


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(1)
    f = pii.Finder()
    for n in range(30_000):
        signs = ("ab1200456.@+- ()%_é:", "0123.@-+ ", "0 -", "1.2", "+1( )-.2")[n % 5]
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 50)))
        assert [s for s in f.spans(t) if s[0] in pii.BASE] == brute_base(t), t


@pytest.mark.parametrize("text", [
    "x" * 30_000 + "@" + "y" * 30_000, "a@b" * 9000, "1.2.3.4." * 4000, "4" * 20_000, "0" * 5000 + "1.1.1.1", "+1" * 9000, "+1 (" * 9000,
    "4 0 1 2 8 8 8 8 8 8 8 8 1 8 8 1", "4012-8888-8888-1881", "256.1.1.1.1.1.1.1", "a@b.c@d.e", "a@b@c.d", "@b.c", "é@b.c", "İ x@y.zz", "😀 +49 30 1234567 😀",
])
def test_base_spans_of_odd_texts(text):
    assert base_of(text) == brute_base(text)


def found(text):
    return [(k, text[a:b]) for k, a, b in pii.Finder().spans(text) if k not in pii.BASE]


def test_spans_found_by_cue():
    assert found("PassWord = \"ab12cd34\", x") == [("account", "ab12cd34")]
    assert found("token=55cf1b56d3.") == [("account", "55cf1b56d3")]
    assert found("Customer No.: 0012-3456-ab then") == [("account", "0012-3456-ab")]
    assert found("user id#a1b2c3 and password: nothing") == [("account", "a1b2c3")]
    assert found("tokens = ab12cd34 mytoken=ab12cd34 the token ab12cd34") == []
    assert found("see https://joe:pw1@host.example/x or http://host.example/@joe") == [("login", "https://joe:pw1@host.example")]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 and iban GB82WEST12345698765432.") == [
        ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
    ]
    assert found("iban DE88370400440532013000 miban DE89370400440532013000") == []


def test_scan_keeps_every_row(spark):
    rows = [(1, "me@x.org +1 (988) 555-2485"), (1, "me@x.org +1 (988) 555-2485"), (None, "1.2.3.4"), (2, None), (3, ""), (4, "é 4041894974608795 é " * 2000)]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id bigint, text string, spans string, kind int")
    got = pii.scan(docs).select("doc_id", "text", pii.listed(F.col("spans")).alias("s"), pii.counted("spans", "card").alias("n"), pii.redacted().alias("r"))
    want = Counter((i, t or "", ",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(t or ""))) for i, t in rows)
    assert Counter((r["doc_id"], r["text"], r["s"]) for r in got.collect()) == want
    clean = {(r["doc_id"], r["r"]) for r in got.collect()}
    assert (1, "<email> <phone>") in clean and (None, "<ip>") in clean and (2, "") in clean and (4, "é <card> é " * 2000) in clean
    assert pii.scan(spark.createDataFrame([], docs.schema)).count() == 0


# Prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = turns.get(first, [])[:h] + own[h:]
    members = defaultdict(set)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        n_words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(cs) - 1) * n_words
    return {
        (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p],
         sha(",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p))))
        for p, cs in members.items()
    }


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(spark, rows, bits=prefix_trie.MOST_BITS):
    df = spark.createDataFrame([(*r, 1, "k", True) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, k1 string, last boolean")
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(df.repartition(3))), most_bits=bits)
    out = [tuple(r) for r in got.select(*COLUMNS).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(8)
    rows = []
    for c in [*range(-25, 90), 2**62, -(2**63), 10**12 + 3, 10**12 + 7]:
        for turn in range(rnd.choice([0, 1, 2, 3, 4, 6, 9])):
            same = rnd.random() < 0.6
            rows.append((c, turn, rnd.choice(["user", None, ""]) if not same else "user", rnd.choice(["a b", "", None, "c\td  e"]) if same else f"own {rnd.randint(0, 9)}"))
    rows += [(41, None, "user", "null turn"), (None, 0, "user", "nobody's"), (43, 1, "user", "long " * 30_000), (200, 5, "user", "alone"), (300, 0, "user", "two turns"), (300, 1, "user", "here")]
    rows += [(301, t, "user", f"turn {t}") for t in range(5)]
    # A third of all conversations are copies of one, and one conversation has a third of all turns.
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1100) for t in range(6)]
    rows += [(77_777, t, "user", f"hot {t % 3}") for t in range(500)]
    return rows


def test_trie_is_that_of_brute_force(spark, talks):
    assert trie_rows(spark, talks) == brute_trie(talks)


def test_trie_with_small_chunks_and_a_full_sketch(spark, talks, monkeypatch, many_ranges):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "JOINED_CHARS", 40)
    monkeypatch.setattr(prefix_trie, "BITMAP_BITS", 64)
    monkeypatch.setattr(F, "bitmap_bucket_number", lambda c: F.floor((c - 1) / 64) + 1)
    monkeypatch.setattr(F, "bitmap_bit_position", lambda c: F.pmod(c - 1, F.lit(64)))
    whole = prefix_trie.np.frombuffer
    monkeypatch.setattr(prefix_trie.np, "frombuffer", lambda b, kind: whole(b, kind)[:8])
    assert trie_rows(spark, talks, bits=64) == brute_trie(talks)


@pytest.mark.parametrize("rows", [
    [], [(5, 0, "user", "x")], [(20, 0, "user", "x")], [(None, 0, "user", "x")], [(1, 0, "user", "a"), (2, 0, "user", "a")],
    [(20, 0, "u", "a"), (21, 0, "u", "b"), (22, 0, "u", "c"), (23, 0, "u", "d")],
])
def test_trie_of_few_rows(spark, rows):
    assert trie_rows(spark, rows) == brute_trie(rows)
