"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents the stage before kept, and its result is
written and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import line_dedup, mixing, ngram_join, packing, quality
from clickloom.llm.common import table
from clickloom.llm.queries import WORD_BPE, vocabulary
from clickloom.state import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees keep. The trees are fitted on the labelled documents still here.

    A null or empty text has no words and goes; every row is judged by itself, whatever its id.
    """
    return quality.kept_documents(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines found in five documents or more, except in the last of these.

    No row is lost: a null text stays null, a text that loses all lines becomes empty. Rows equal in id and
    text lose the same lines.
    """
    slim = docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc"))
    kept = line_dedup.drop_repeated_lines(slim, ["doc"], min_chars=40, min_docs=5)
    text = F.when(F.col("_n_dropped") > 0, F.col("_kept")).otherwise(F.col("doc.text"))
    put = {"text": text, "n_chars": F.coalesce(F.length(text).cast("bigint"), F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*[put.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id, a null id last.

    Five-word shingles, similarity of 0.8. Every row is a document of its own: a class is told by its
    label, not by ids, and of rows with equal id the one with the smallest text hash stays. Of rows
    equal in id and text just one stays, the least by its other columns. Documents without words stay,
    all of them.
    """
    classes = ngram_join.ngram_components(docs, words=5, num=80, den=100)
    rows = classes.groupBy("label", "row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    chosen = settle(
        rows.groupBy("label", F.when(F.col("label").isNull(), F.col("row")).alias("lone"))
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "copies")).alias("first"))
        .select(F.col("first.row").alias("row"), (F.col("label").isNotNull() & (F.col("first.copies") > 1)).alias("repeated")),
        "pipeline_chosen",
    )
    row = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    # The document travels as one struct: no column of it can clash.
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), row.alias("row"))
    whole = keyed.join(chosen.where("not repeated"), "row", "left_semi").select("doc.*")
    # Rows equal in id and text: reduced to the least of them, however many there are.
    repeated = keyed.join(chosen.where("repeated"), "row", "left_semi")
    return whole.unionByName(repeated.groupBy("row").agg(F.min("doc").alias("least")).select("least.*"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last repetition of one per source is cut."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), max_epochs=3)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    pieces = packing.pack(docs, vocabulary(WORD_BPE), window=2048)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "opens", "closes")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Trees, seeded repetitions and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
