"""One query per text operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import (
    fingerprints, license_scan, line_dedup, merkle, mixing, ngram_join, packing, pii, prefix_trie, quality, substring_dedup, token_counts, warc,
)
from clickloom.llm.common import table
from clickloom.llm.registry import ORACLES, QUERIES, query  # noqa: F401

#: Name of a vocabulary file, and its place where the tokenizers are installed.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


D_BASE32 = """(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr({0}, 1 + 10 * (k // 8), 10) AS BIGINT) >> (5 * (7 - k % 8))) & 31 AS INT), 1), '' ORDER BY k)
  FROM range(32) r(k))"""


@query(f"""WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
 q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id,
   row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS LAST) AS nth FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {D_BASE32.format('h')} AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first_id END AS refers_to FROM q""")
def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written to a content-addressed archive and read back."""
    path = warc.new_archive(spark)
    warc.write_archive(table(spark, sf, "pages"), path, min_bytes=0)
    return warc.records(warc.read_archive(spark, path)).drop("header", "payload")


@query()
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of the documents mixed to weights 5, 2, 1, at most three epochs each."""
    mixed = mixing.mix(table(spark, sf, "documents"), weights=(5, 2, 1), max_epochs=3, share=1.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query()
def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Documents judged by trees fitted on labelled documents."""
    docs = table(spark, sf, "documents")
    trees = quality.fit_quality(docs, table(spark, sf, "labels"))
    return quality.judge(docs, trees)


D_LICENSES = ", ".join(
    "('{}', {}, '{}', {}, {})".format(*r) for r in license_scan.template_rows(license_scan.TEMPLATES)
)
D_RATIO = f"{license_scan.THRESHOLD} / (2 - {license_scan.THRESHOLD})"


@query(f"""WITH t(license, wording, pair, t_count, t_size) AS (VALUES {D_LICENSES}),
 d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
 l AS (SELECT rid, unnest(generate_series(0, len(parts) - 1)) AS line, unnest(parts) AS passage FROM d
   UNION ALL SELECT rid, -1, array_to_string(parts, chr(10)) FROM d WHERE len(parts) > 1),
 w AS (SELECT rid, line, string_split(trim(regexp_replace(lower(passage), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS words FROM l),
 b AS (SELECT rid, line, len(words) - 1 AS p_size, words[i] || ' ' || words[i + 1] AS pair
   FROM (SELECT *, unnest(generate_series(1, len(words) - 1)) AS i FROM w WHERE len(words) BETWEEN 2 AND 100)),
 m AS (SELECT rid, line, license, wording, t_size, p_size, sum(least(p_count, t_count)) AS both_count FROM
   (SELECT rid, line, p_size, pair, count(*) AS p_count FROM b GROUP BY ALL) JOIN t USING (pair) GROUP BY ALL),
 s AS (SELECT *, 2.0::DOUBLE * both_count / (p_size + t_size) AS dice FROM m),
 h AS (SELECT rid, min((-dice, license, line)) AS best, count(DISTINCT CASE WHEN line >= 0 THEN line END) AS n_hits
   FROM s WHERE dice >= {license_scan.THRESHOLD} GROUP BY rid)
SELECT doc_id, len(parts) AS n_lines, coalesce(n_hits, 0) AS n_hits, best[2] AS license, -best[1] AS best_dice,
  CAST(best[3] AS BIGINT) AS best_line FROM d LEFT JOIN h USING (rid)""")
def op8_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and texts compared to license notices."""
    return license_scan.scan(table(spark, sf, "documents"))


@query()
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents concatenated and cut into windows of 2048 ids."""
    pieces = packing.pack(table(spark, sf, "documents"), vocabulary(WORD_BPE), window=2048)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "opens", "closes")


D_KEY = "translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
 l AS (SELECT doc_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line FROM d),
 k AS (SELECT doc_id, pos, line, {D_KEY} AS key FROM l),
 c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 f AS (SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id""")
def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines found in five documents or more, kept only in the last of them."""
    kept = line_dedup.drop_repeated_lines(table(spark, sf, "documents"), ["doc_id"], min_chars=40, min_docs=5)
    return kept.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256")
    )


@query()
def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and their edited texts by consistent weighted samples."""
    return fingerprints.fingerprints(table(spark, sf, "documents"))


@query()
def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document by the compiled transducers."""
    return token_counts.token_counts(table(spark, sf, "documents"), vocabulary(BYTE_BPE), limit=512)


D_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
D_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, {D_WORDS.format(D_ASCII_LOWER)} AS words FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
   ELSE list_transform(generate_series(1, len(words) - 3), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g FROM w),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y USING (g) GROUP BY ALL)
   JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_n >= 85 * (na.n + nb.n - both_n)),
 r AS (SELECT a AS doc_id, a AS reached FROM p UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM documents d
 LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""")
def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Documents linked by sets of four-word shingles that are 85 % alike."""
    return ngram_join.ngram_components(table(spark, sf, "documents"), words=4, num=85, den=100).drop("row", "label")


@query(f"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {D_WORDS.format("coalesce(text, '')")} AS words FROM documents),
 p AS (SELECT rid, unnest(generate_series(1, len(words) - 34)) AS i, words FROM w WHERE len(words) >= 35),
 h AS MATERIALIZED (SELECT rid, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM p),
 c AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
 g AS (SELECT DISTINCT rid, i + k AS pos FROM c, range(35) t(k)),
 x AS (SELECT w.rid, w.doc_id, u.pos, w.words[u.pos] AS word FROM w, LATERAL (SELECT unnest(generate_series(1, len(w.words))) AS pos) u),
 f AS (SELECT x.*, g.pos IS NOT NULL AS gone FROM x LEFT JOIN g ON g.rid = x.rid AND g.pos = x.pos),
 s AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM f GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (rid)""")
def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words in windows of 35 words that occur more than once."""
    cut = substring_dedup.remove_repeated(table(spark, sf, "documents"), length=35)
    return cut.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit (reversed polynomial 0xEDB88320)."""
    steps = f"""flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"""
    return f"""xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}),
   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""


def field_sql(*values: str) -> str:
    return " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)


D_LEAF = field_sql("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "text")


@query(f"""WITH RECURSIVE t AS (SELECT *, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents),
 l AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS key, sha256({D_LEAF}) AS leaf,
   sha256({D_LEAF.replace("text", "cut")}) AS found FROM t),
 d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM l),
 a(key, lev, pos, n, h) AS (SELECT key, 0, pos, n, leaf FROM d
   UNION ALL SELECT key, lev + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY key, lev, pos // 3),
 am AS MATERIALIZED (SELECT * FROM a),
 s AS MATERIALIZED (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM am WHERE n = 1),
 b(lev, pos, n, h) AS (SELECT 0, pos, n, subroot FROM s
   UNION ALL SELECT lev + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY lev, pos // 3),
 bm AS MATERIALIZED (SELECT * FROM b),
 sides AS MATERIALIZED (SELECT key, lev, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
   coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
   FROM (SELECT key, lev, pos, n, h FROM am UNION ALL SELECT NULL, 1000 + lev, pos, n, h FROM bm) WHERE n > 1 WINDOW w AS (PARTITION BY key, lev, pos // 3 ORDER BY pos)),
 p AS MATERIALIZED (SELECT rid, lft, rgt, row_number() OVER (PARTITION BY rid ORDER BY lev) AS step FROM (
   SELECT d.rid, x.lev, lft, rgt FROM d JOIN sides x ON x.key = d.key AND x.pos = CAST(floor(d.pos / power(3, x.lev)) AS BIGINT)
   UNION ALL SELECT d.rid, x.lev, lft, rgt FROM d JOIN s USING (key) JOIN sides x ON x.key IS NULL AND x.pos = CAST(floor(s.pos / power(3, x.lev - 1000)) AS BIGINT))),
 f(rid, step, h) AS (SELECT rid, 0, found FROM d UNION ALL SELECT f.rid, f.step + 1, sha256(lft || h || rgt) FROM f JOIN p ON p.rid = f.rid AND p.step = f.step + 1),
 e AS (SELECT rid, arg_max(h, step) AS folded_root FROM f GROUP BY rid),
 q AS (SELECT rid, string_agg(lft || rgt, '' ORDER BY step) AS joined FROM p GROUP BY rid)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(coalesce(joined, '')) AS proof_sha256, folded_root, folded_root = r.h AS verified
 FROM d JOIN s USING (key) JOIN e USING (rid) LEFT JOIN q USING (rid), (SELECT h FROM bm WHERE n = 1) r""")
def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves and proofs of all documents, held against texts of which some lost their line feeds."""
    proven = merkle.manifest(table(spark, sf, "documents"), merkle.without_line_feeds())
    out = proven.withColumn("folded_root", merkle.folded(F.coalesce("found", "leaf")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: A sign for the borders of matches; in texts it is put out of the way first.
D_MARK = "chr(57344)"


def spans_sql(kind: int, pattern: str, put: str = "\\0", prefix: str = "", valid: str = "true", text: str = "t", size: str = "len(m)") -> str:
    """Matches of a pattern with their places: the text is split at marks set around each match."""
    marked = f"regexp_replace({text}, '{pattern}', '{prefix}' || {D_MARK} || '{put}' || {D_MARK}, 'g')"
    return f"""SELECT rid, {kind} AS kind, a AS start, a + {size} AS stop FROM (
   SELECT rid, parts[i] AS m, list_sum(list_transform(parts[1:i - 1], lambda x: len(x))) AS a
   FROM (SELECT rid, parts, unnest(generate_series(2, len(parts), 2)) AS i FROM (SELECT rid, string_split({marked}, {D_MARK}) AS parts FROM d)))
   WHERE {valid}"""


D_DIGITS = "string_split(regexp_replace(m, '[^0-9]', '', 'g'), '')"
D_LUHN = f"""list_sum(list_transform(list_reverse({D_DIGITS}), lambda x, i:
   CASE WHEN i % 2 = 1 THEN CAST(x AS INT) WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END)) % 10 = 0"""
D_PLAIN = "replace(m, ' ', '')"
D_IBAN = f"""list_reduce(list_prepend(0, list_transform(string_split(substr({D_PLAIN}, 5) || substr({D_PLAIN}, 1, 4), ''),
   lambda x: CASE WHEN ascii(x) >= 65 THEN ascii(x) - 55 ELSE ascii(x) - 48 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"""
D_SPANS = " UNION ALL ".join([
    spans_sql(1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    spans_sql(2, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", valid="len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 OR CAST(right(x, 3) AS INT) > 255)) = 0"),
    spans_sql(3, r"[0-9]([\x20-]?[0-9])+", valid=f"len({D_DIGITS}) BETWEEN 16 AND 19 AND {D_LUHN}"),
    spans_sql(4, r"\+[0-9][\x20().0-9-]+[0-9]", valid=f"len({D_DIGITS}) BETWEEN 8 AND 15"),
    spans_sql(5, r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._%+~:-]+@[A-Za-z0-9.-]+"),
    spans_sql(
        6, r"""(^|[^A-Za-z0-9_])([Ii][Bb][Aa][Nn]["'']?(?:[ \t]{0,2}[:=#][ \t]{0,2}|[ \t]{1,2})["'']?)([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?))\b""",
        "\\3", "\\1\\2", D_IBAN,
    ),
    spans_sql(
        7, rf"""(^|[^a-z0-9_])((?:{"|".join(pii.CUES)})(?:[ _-]?(?:id|no|nr|number|key|code))?\.?["'']?[ \t]{{0,2}}[:=#][ \t]{{0,2}}["'']?)([a-z0-9][a-z0-9._/+=-]{{5,}})""",
        "\\3", "\\1\\2", "len(rtrim(m, '._/+=-')) >= 6 AND len(regexp_replace(rtrim(m, '._/+=-'), '[^0-9]', '', 'g')) >= 2",
        "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "len(rtrim(m, '._/+=-'))",
    ),
])
D_KINDS = "[" + ", ".join(f"'{k}'" for k in pii.KINDS) + "]"
D_LISTED = f"string_agg({D_KINDS}[kind] || ':' || start || ':' || stop, ',' ORDER BY kind, start)"


@query(f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, replace(coalesce(text, ''), {D_MARK}, chr(57345)) AS t FROM documents),
 s AS ({D_SPANS}),
 g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(pii.BASE, 1))},
   {D_LISTED} FILTER (kind <= {len(pii.BASE)}) AS base, {D_LISTED} AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
 FROM d LEFT JOIN g USING (rid)""")
def op12_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in all documents: counts, a digest of the base spans, all spans."""
    found = pii.scan(table(spark, sf, "documents"))
    return found.select(
        "doc_id", *[pii.counted("spans", k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.listed(pii.base_spans()), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


D_TURN = "{'r': coalesce(role, ''), 't': coalesce(text, '')}"


@query(f"""WITH o AS MATERIALIZED (SELECT conv_id AS c, list({D_TURN} ORDER BY turn NULLS FIRST) AS own FROM conversations
   WHERE conv_id IS NOT NULL GROUP BY conv_id),
 h AS (SELECT c, own, {crc32_sql("CAST(c AS VARCHAR)")} % 4 AS h FROM o),
 r AS MATERIALIZED (SELECT h.c, list_concat(coalesce(b.own[1:h], []), h.own[h + 1:]) AS turns FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
 p AS MATERIALIZED (SELECT c, d, md5(CAST(to_json(turns[1:d]) AS VARCHAR)) AS k, md5(CAST(to_json(turns[1:d - 1]) AS VARCHAR)) AS pk, d = len(turns) AS is_last,
   CASE WHEN d > 0 THEN len({D_WORDS.format("turns[d].t")}) ELSE 0 END AS w
   FROM (SELECT c, turns, unnest(generate_series(0, len(turns))) AS d FROM r)),
 n AS MATERIALIZED (SELECT d, k, min(c) AS c, min(pk) AS pk, count(*) AS n, (count(*) - 1) * max(w) AS saved, bool_and(is_last) AS leaf,
   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_last), '')) AS ends FROM p GROUP BY d, k),
 u AS (SELECT DISTINCT a.d, a.k, b.d AS bd, b.k AS bk FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
 t AS (SELECT u.d, u.k, count(*) FILTER (n.leaf) AS n_leaves, sum(n.saved) AS saved FROM u JOIN n ON n.d = u.bd AND n.k = u.bk GROUP BY ALL),
 kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL)
SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, coalesce(kids.n, 0) AS n_children, n_leaves,
  CAST(t.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
 FROM n JOIN t USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.k = n.pk""")
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The trie of all conversations, rebuilt to start as the first of their block does."""
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf, "conversations"))))


@query()
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
