"""Document texts: YAML, JSON and JSON lines, on the driver and as frames."""

from __future__ import annotations

import json

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.errors import Validation


def yaml_to_json(text: str) -> str:
    try:
        return json.dumps(yaml.safe_load(text))
    except yaml.YAMLError as e:
        raise Validation(f"invalid yaml: {e}") from e


def json_to_yaml(text: str) -> str:
    try:
        return yaml.safe_dump(json.loads(text), sort_keys=False)
    except ValueError as e:
        raise Validation(f"invalid json: {e}") from e


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One document a line; with a schema nothing is scanned to infer one."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def as_json(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON text; nulls are left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))


def parsed(df: DataFrame, text_col: str, name: str = "document") -> DataFrame:
    """A text column as VARIANT documents; texts that are no JSON become null."""
    return df.withColumn(name, F.try_parse_json(text_col))
