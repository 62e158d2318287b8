"""The ad impressions table, derived from the ``events`` table.

Each event is one impression shown to a user; a ``click`` event is a positive. The ``seq`` column
holds the user's previous items as comma-separated text, with the untidy tokens real logs have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.functions.sequences import bind, last_items

KEEP = 20
SLICE_MINUTES = 10

CATS = ["gender", "age_group", "inventory_id", "day_of_week", "hour"]


def _time_slice(ts: str, minutes: int) -> Column:
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return F.floor((day * 1440 + F.hour(ts) * 60 + F.minute(ts)) / minutes)


def with_history(
    df: DataFrame,
    user: str,
    order: list[str],
    token: str,
    out: str = "seq",
    keep: int = KEEP,
    minutes: int = SLICE_MINUTES,
) -> DataFrame:
    """Add the last ``keep`` tokens of the same user before each row, as comma-joined text.

    A plain window by user would sort one busy user's rows in one task. Instead rows are windowed
    inside (user, time slice); a slice hands at most ``keep`` tokens on, so the window by user only
    sees one short row per slice. The result equals the plain window: the last ``keep`` rows count,
    null tokens among them are left out (null if none is left), rows with a null user are one user,
    and a null time comes first. ``order[0]`` is the time.
    """
    cut = df.withColumn("_slice", _time_slice(order[0], minutes))
    inside = Window.partitionBy(user, "_slice").orderBy(*order)
    local = cut.select(
        "*",
        F.collect_list(F.struct(F.col(token).alias("t"))).over(inside.rowsBetween(-keep, -1)).alias("_local"),
        F.lead(F.lit(1)).over(inside).isNull().alias("_closing"),
    )
    tails = local.where("_closing").select(
        user, "_slice", last_items(F.concat("_local", F.array(F.struct(F.col(token).alias("t")))), keep).alias("_tail")
    )
    earlier = Window.partitionBy(user).orderBy("_slice").rowsBetween(-keep, -1)
    carried = tails.select(
        F.col(user).alias("_user"), F.col("_slice").alias("_of"), last_items(F.flatten(F.collect_list("_tail").over(earlier)), keep).alias("_carry")
    )
    last_rows = last_items(F.concat(F.coalesce("_carry", F.slice("_local", 1, 0)), "_local"), keep)
    past = F.transform(F.filter(last_rows, lambda x: x["t"].isNotNull()), lambda x: x["t"])
    same = F.col(user).eqNullSafe(F.col("_user")) & F.col("_slice").eqNullSafe(F.col("_of"))
    return (
        local.join(carried, same, "left")
        .withColumn(out, bind(past, lambda a: F.when(F.size(a) > 0, F.array_join(a, ","))))
        .drop("_slice", "_local", "_closing", "_carry", "_user", "_of")
    )


def impressions(spark: SparkSession, sf_dir: str, seq: bool = True) -> DataFrame:
    """Impressions with labels, categories and numbers; ``seq`` adds the history column."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    item = F.col("k") % 18
    if seq:
        token = F.when(item == 13, " 13").when(F.col("k") == 50, "x").otherwise(item.cast("string"))
        events = with_history(
            events.withColumn("_token", token), "user_id", ["ts", "event_id"], "_token"
        )
    user = F.col("user_id")
    columns = [
        F.col("event_id"),
        F.col("event_id").cast("string").alias("ID"),
        F.col("ts").alias("event_time"),
        (F.col("event_type") == "click").cast("int").alias("clicked"),
        F.when(user % 11 != 0, F.concat((user % 2 + 1).cast("string"), F.lit(".0"))).alias("gender"),
        F.when(user % 13 != 0, F.concat((user % 8 + 1).cast("string"), F.lit(".0"))).alias("age_group"),
        item.cast("string").alias("inventory_id"),
        (F.weekday("ts") + 1).cast("string").alias("day_of_week"),
        F.hour("ts").cast("string").alias("hour"),
        user.alias("feat_c_2"),
        (user % 2).alias("l_feat_1"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("feat_e_3"),
        F.col("value").alias("history_a_1"),
        (F.col("value") - 100.0).alias("history_a_2"),
        (F.col("value") / 7.0).alias("feat_a_1"),
    ]
    return events.select(*columns, *(["seq"] if seq else []))


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Four fifths of the impressions to fit on, one fifth to score."""
    return df.where("event_id % 5 < 4"), df.where("event_id % 5 = 4")


DUCK_IMPRESSIONS = """impressions AS (
WITH e AS (SELECT event_id, ts, user_id, event_type, value,
                  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CAST(event_id AS VARCHAR) AS "ID", ts AS event_time,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicked,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE CAST(user_id % 2 + 1 AS VARCHAR) || '.0' END AS gender,
  CASE WHEN user_id % 13 = 0 THEN NULL ELSE CAST(user_id % 8 + 1 AS VARCHAR) || '.0' END AS age_group,
  CAST(k % 18 AS VARCHAR) AS inventory_id,
  CAST(isodow(ts) AS VARCHAR) AS day_of_week,
  CAST(hour(ts) AS VARCHAR) AS hour,
  user_id AS feat_c_2, user_id % 2 AS l_feat_1,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS feat_e_3,
  value AS history_a_1, value - CAST(100 AS DOUBLE) AS history_a_2, value / CAST(7 AS DOUBLE) AS feat_a_1,
  string_agg(CASE WHEN k % 18 = 13 THEN ' 13' WHEN k = 50 THEN 'x'
                  ELSE CAST(k % 18 AS VARCHAR) END, ',')
    OVER (PARTITION BY user_id ORDER BY ts, event_id
          ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS seq
FROM e)"""
