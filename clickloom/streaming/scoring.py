"""Scoring of new impressions as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def score_arrivals(
    spark: SparkSession, source: str, schema: StructType, scorer: Callable[[DataFrame], DataFrame],
    sink: str, checkpoint: str, files_per_batch: int = 100,
) -> DataFrame:
    """Run ``scorer`` over every file not yet seen in ``source`` and add the result to ``sink``.

    Files arrive in micro-batches. A batch's rows are written first, then scored as a plain batch job of
    ``spark``: lookups of tables of any size, adaptive execution and models work as they do elsewhere, and
    the arrived files are read once. The checkpoint fixes which files make a batch; its result goes to the
    folder ``batch=<number>``, replacing what a killed run may have left there. So a restarted job neither
    repeats nor skips rows, provided that ``scorer`` is a function of its rows and of written tables.
    """

    def score(rows: DataFrame, batch: int) -> None:
        staged = f"{checkpoint}_rows/{batch}"
        rows.write.mode("overwrite").parquet(staged)
        scorer(spark.read.schema(schema).parquet(staged)).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    # Before the first file arrives the sink is an empty table of the right columns.
    nothing = scorer(spark.createDataFrame([], schema))
    nothing.write.mode("ignore").parquet(f"{sink}/batch=-1")
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (
        arrivals.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return scored(spark, sink, nothing.schema)


def scored(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """All rows scored so far."""
    return spark.read.schema(schema).parquet(f"{sink}/batch=*")
