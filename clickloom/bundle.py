"""Everything a fit leaves behind, published as one unit.

A bundle is a folder below a root: tables, models and plain values (vocabulary, feature lists, limits)
of one fit. It counts only once its manifest is there, which is written last and names every part with
its schema and row count. Readers choose among published bundles and check the parts against the
manifest, so they see a whole fit or none: never tables of one fit with the model of another, never a
half-written folder. Published bundles are not changed; a new fit is a new folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST_DDL = "version string, published bigint, parts string, vals string"


class NotPublished(ValueError):
    """The bundle has no manifest, or its parts are not those of its manifest."""


@dataclass
class Bundle:
    version: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, PipelineModel] = field(default_factory=dict)
    values: dict[str, Any] = field(default_factory=dict)


def publish(
    spark: SparkSession, root: str, tables: Mapping[str, DataFrame], models: Mapping[str, PipelineModel] | None = None,
    values: Mapping[str, Any] | None = None,
) -> str:
    """Write all parts below ``root``, then the manifest. Returns the version's name."""
    version = uuid.uuid4().hex
    folder = f"{root}/{version}"
    parts = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/tables/{name}")
        parts[name] = {"schema": df.schema.json(), "rows": spark.read.schema(df.schema).parquet(f"{folder}/tables/{name}").count()}
    for name, model in (models or {}).items():
        model.write().save(f"{folder}/models/{name}")
    told = {"tables": parts, "models": sorted(models or {})}
    row = (version, time.time_ns() // 1000, json.dumps(told), json.dumps(dict(values or {})))
    spark.createDataFrame([row], MANIFEST_DDL).coalesce(1).write.json(f"{folder}/manifest")
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """(version, published, parts, vals) of every whole bundle below ``root``: one row per fit."""
    try:
        return spark.read.schema(MANIFEST_DDL).json(f"{root}/*/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST_DDL)


def load(spark: SparkSession, root: str, version: str | None = None) -> Bundle:
    """The named bundle, or the one published last; refuses what is not whole."""
    found = published(spark, root)
    if version is not None:
        found = found.where(F.col("version") == version)
    told = found.orderBy(F.desc("published"), F.desc("version")).first()
    if told is None or told["parts"] is None:
        raise NotPublished(f"no published bundle {version or ''} below {root}")
    folder, parts = f"{root}/{told['version']}", json.loads(told["parts"])
    out = Bundle(told["version"], values=json.loads(told["vals"]))
    for name, part in parts["tables"].items():
        schema = StructType.fromJson(json.loads(part["schema"]))
        try:
            rows = (table := spark.read.schema(schema).parquet(f"{folder}/tables/{name}")).count()
        except AnalysisException as gone:
            raise NotPublished(f"table {name} of bundle {told['version']} is not there") from gone
        if rows != part["rows"]:
            raise NotPublished(f"table {name} of bundle {told['version']} has {rows} rows, not {part['rows']}")
        out.tables[name] = table
    out.models = {name: PipelineModel.load(f"{folder}/models/{name}") for name in parts["models"]}
    return out
