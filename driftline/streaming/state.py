"""User functions with keyed state in streams."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .processors import UserState, keyed


def stream_state(df: DataFrame, step: Any, names: list[str], scalar: bool, schema: T.StructType) -> DataFrame:
    return keyed(df, UserState(step, names, scalar, list(schema.names)), schema)
