"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions.hashing import affine_fold
from clickloom.operators import target_encoding
from clickloom.operators.profile import cardinality
from clickloom.plans.catalog.registry import ads, d6, query, r6
from clickloom.sources import readers, writers
from clickloom.state import new_path, settle


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'", raw=True)
def scan_filter_project(spark, sf):
    return readers.scan(spark, f"{sf}/events.parquet").where("event_type = 'click'").select("event_id", "user_id")


@query("SELECT event_id, value FROM events", raw=True)
def read_named_columns(spark, sf):
    return readers.read_columns(spark, f"{sf}/events.parquet", ["event_id", "value"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type", raw=True)
def sql_over_parquet_file(spark, sf):
    return spark.sql(f"SELECT event_type, count(*) AS n FROM parquet.`{sf}/events.parquet` GROUP BY event_type")


@query("SELECT event_id // 50000 AS chunk, count(*) AS n FROM events GROUP BY 1", raw=True)
def row_chunks(spark, sf):
    """Row counts of 50,000-row chunks in file order."""
    rows = readers.with_row_index(spark, f"{sf}/events.parquet")
    return rows.groupBy(F.floor(F.col("row_index") / 50_000).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_id AS row_index FROM events", raw=True)
def row_index_in_file_order(spark, sf):
    return readers.with_row_index(spark, f"{sf}/events.parquet").select("event_id", "row_index")


@query('SELECT "ID", CAST(clicked AS DOUBLE) AS clicked FROM impressions')
def csv_round_trip(spark, sf):
    path = new_path(spark, "csv")
    writers.write_csv(ads(spark, sf).select("ID", F.col("clicked").cast("double").alias("clicked")), path)
    return readers.read_csv(spark, path, "ID string, clicked double")


@query("SELECT inventory_id AS inventory, count(*) AS n FROM impressions GROUP BY 1")
def sql_over_csv(spark, sf):
    path = new_path(spark, "csv")
    writers.write_csv(ads(spark, sf).select("event_id", "inventory_id"), path)
    table = readers.read_csv(spark, path, "event_id bigint, inventory_id string")
    return readers.sql_over(
        spark, "SELECT inventory_id AS inventory, count(*) AS n FROM {t} GROUP BY inventory_id", t=table
    )


@query('SELECT "ID", clicked, gender, age_group FROM impressions')
def parquet_zstd_round_trip(spark, sf):
    path = new_path(spark, "zstd")
    writers.write_parquet(ads(spark, sf).select("ID", "clicked", "gender", "age_group"), path)
    return spark.read.parquet(path)


@query(
    "SELECT age_group, inventory_id, count(*) AS n, CAST(sum(clicked) AS BIGINT) AS clicks FROM impressions "
    "WHERE age_group IS NOT NULL AND inventory_id IS NOT NULL GROUP BY 1, 2"
)
def write_one_folder_per_group(spark, sf):
    path = new_path(spark, "groups")
    keys = ["age_group", "inventory_id"]
    writers.write_by_group(ads(spark, sf).select("event_id", "clicked", *keys), path, keys)
    back = spark.read.schema("event_id bigint, clicked int, age_group string, inventory_id string").parquet(path)
    return back.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("clicked").alias("clicks"))


@query("SELECT day_of_week, count(*) AS n FROM impressions WHERE clicked = 1 GROUP BY day_of_week")
def create_table_as_select(spark, sf):
    ads(spark, sf).createOrReplaceTempView("train_rows")
    spark.sql("SELECT day_of_week FROM train_rows WHERE clicked = 1").createOrReplaceTempView("click_rows")
    return spark.sql("SELECT day_of_week, count(*) AS n FROM click_rows GROUP BY day_of_week")


@query(f"SELECT count(*) AS n, {d6('sum(value)')} AS total FROM events", raw=True)
def dataset_in_part_files(spark, sf):
    """Rewritten as parts of bounded row count, then read as one table."""
    path = new_path(spark, "parts")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    rows.write.option("maxRecordsPerFile", 50_000).parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "SELECT gender AS key, CAST(count(*) AS BIGINT) AS key_rows FROM (SELECT coalesce(gender, '__NA__') AS gender "
    "FROM impressions) GROUP BY 1"
)
def fitted_state_saved_and_reloaded(spark, sf):
    """A fitted encoding written to a named path and read back for use."""
    fold = affine_fold(F.col("event_id"))
    enc = target_encoding.fit(ads(spark, sf), ["gender"], "clicked", fold)
    path = new_path(spark, "state")
    settle(enc.table, path=path)
    again = target_encoding.TargetEncoding(["gender"], spark.read.parquet(path))
    return again.part("gender", full=True).select("key", F.col("rows").alias("key_rows"))


@query("SELECT run, built, n FROM (SELECT count(*) AS n FROM events), (VALUES (1, 1), (2, 0)) AS v(run, built)", raw=True)
def stage_skipped_when_done(spark, sf):
    """The second run finds the first run's table and does not build it again."""
    path = new_path(spark, "stage")
    runs = []
    for run in (1, 2):
        table, built = writers.stage(spark, path, lambda: spark.read.parquet(f"{sf}/events.parquet"))
        runs.append(
            table.groupBy().agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(run).alias("run"), F.lit(int(built)).alias("built"), "n")
        )
    return runs[0].unionByName(runs[1])


REPORTED = ["gender", "age_group", "inventory_id", "feat_c_2", "l_feat_1"]


@query(
    "SELECT 'Distinct values' AS value UNION ALL SELECT c || ': ' || n FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS c, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n FROM impressions"
        for c in REPORTED
    )
    + ")"
)
def text_report(spark, sf):
    path = new_path(spark, "report")
    writers.write_report(cardinality(ads(spark, sf), REPORTED), path, "Distinct values")
    return spark.read.text(path)


@query("SELECT run, n, clicks FROM (SELECT count(*) AS n, CAST(sum(clicked) AS BIGINT) AS clicks FROM impressions), (VALUES (1), (2)) AS v(run)")
def run_log_append(spark, sf):
    path = new_path(spark, "log")
    for run in (1, 2):
        entry = ads(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum("clicked").alias("clicks"))
        log = writers.append_log(entry.select(F.lit(run).alias("run"), "n", "clicks"), path)
    return log
