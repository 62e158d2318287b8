"""The corpus pipeline, stage by stage and as a whole, against a brute-force chain."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm import WORD, brute_mix, words
from tokenizers import Tokenizer

import corpus_pipeline
from clickloom.llm import mixing, quality
from clickloom.llm.queries import WORD_BPE, vocabulary
from clickloom.state import new_path

#: Columns named as the operators name theirs.
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, n_words int, taken int, _row string, _kept string, row int, doc string, place int"
EXTRA = (0.5, False, 1, 2, "r", "k", 3, "d", 4)


@pytest.fixture(scope="module")
def rows():
    """Good texts, junk, copies near and exact, shared lines, repeated rows and ids, nulls, a hot source."""
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    line, base = make(9) + " a line of more than forty characters", make(120).split(" ")
    texts = [make(rnd.randint(60, 140)) for _ in range(50)] + [make(20) for _ in range(5)] + ["same word again " * 40, None, "", " \n"]
    texts += [make(40) + "\n" + line + "\n  " + line.upper() + "\t\n" + make(30) for _ in range(8)]
    for i in range(10):
        copy = list(base)
        for j in range(i):
            copy[(j * 23) % 120] = "edit"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 3
    out = [(i, t, "en", ("hot" if i % 3 else f"s{i % 5}") if i % 11 else None) for i, t in enumerate(texts)]
    out += [out[4], out[4], (out[6][0], out[6][1], "fr", "other"), (7, make(70), "en", "s1"), (None, make(80), "en", "s1"), (None, make(80), "en", "hot"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], DDL).repartition(5)


@pytest.fixture(scope="module")
def folder(spark, docs):
    path = new_path(spark, "corpus")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(50)] + [(58, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(df):
    """Rows of a stage, after a look at what it must carry along."""
    got = df.collect()
    assert df.columns == DDL.replace(",", "").split()[::2]
    assert all(tuple(r)[5:] == EXTRA and r["n_chars"] == len(r["text"] or "") for r in got)
    return [tuple(r)[:4] for r in got]


def brute_quality(spark, rows, trees):
    s = quality.statistics([r[1] or "" for r in rows])
    score = trees.score(quality.features(s))
    return [r for r, n, rep, x in zip(rows, s["n_words"], s["n_repeat_words"], score, strict=True) if n >= 50 and 100 * rep <= 50 * n and x >= 0]


def brute_lines(rows):
    space = " \t\n\v\f\r"
    key = lambda x: x.strip(space).translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(-(2**64) if i is None else i)
    gone = {k: max(ids) for k, ids in held.items() if len(k) >= 40 and len(ids) >= 5}
    out = []
    for i, t, *rest in rows:
        stay = [x for x in (t or "").split("\n") if gone.get(key(x), i) == i]
        out.append((i, t if t is None or len(stay) == len(t.split("\n")) else "\n".join(stay), *rest))
    return out


def row_hashes(spark, rows):
    df = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "k int, doc_id bigint, text string")
    got = df.select("k", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h")).collect()
    return {r["k"]: r["h"] for r in got}


def brute_near(spark, rows):
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    hashes, classes, out = row_hashes(spark, rows), defaultdict(list), []
    for i, r in enumerate(rows):
        if sets[i]:
            classes[root(i)].append(((r[0] is None, r[0] or 0, hashes[i], (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")), r))
        else:
            out.append(r)
    return out + [min(c, key=lambda x: x[0])[1] for c in classes.values()]


def brute_mixed(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, doc_id bigint, text string, lang string, source string")
    h = {r["k"]: r["h"] for r in df.select("k", mixing.placed_rows(df)[5]).collect()}
    keyed = [(h[k], r[0], r[1], r[3], k) for k, r in enumerate(rows)]
    taken, _ = brute_mix(keyed)
    out = []
    for (i, t, lang, source), n in zip(rows, taken, strict=True):
        size = len(words(t))
        ends = [m.end() for m in WORD.finditer(t or "")]
        out += [(i, t, lang, source)] * (n // size if size else 0)
        if size and n % size:
            out.append((i, t[: ends[n % size - 1]], lang, source))
    return out


def test_stages_and_run_are_those_of_brute_force(spark, docs, rows, folder, many_ranges):
    at, want = docs, rows
    trees = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    chain = {"quality_rules": lambda r: brute_quality(spark, r, trees), "line_dedup": brute_lines, "ngram_jaccard": lambda r: brute_near(spark, r), "mixing": lambda r: brute_mixed(spark, r)}
    assert [n for n, _ in corpus_pipeline.STAGES] == [*chain, "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, at, folder).write.parquet(path)
        at = spark.read.parquet(path)
        before, want = len(want), chain[name](want)
        assert Counter(plain(at)) == Counter(want), name
        assert name in ("line_dedup", "mixing") or 0 < len(want) < before
    tok = Tokenizer.from_file(vocabulary(WORD_BPE))
    tokens = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in want)
    for pieces in (corpus_pipeline.STAGES[-1][1](spark, at, folder), corpus_pipeline.run(spark, folder)):
        got = pieces.orderBy("sequence_id", "offset").collect()
        assert sum(r["length"] for r in got) == sum(n * c for (_, n), c in tokens.items())
        assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == tokens
        filled = Counter()
        for r in got:
            assert r["offset"] == filled[r["sequence_id"]]
            filled[r["sequence_id"]] += r["length"]
        assert sorted(filled.values())[1:] == [2048] * (len(filled) - 1)


def test_no_document(spark, docs, folder):
    at = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        assert at.count() == 0 and (name == "packing" or at.columns == docs.columns)
