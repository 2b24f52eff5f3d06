"""Frontmatter read as YAML: values keep their kinds (numbers, lists, maps, dates), and a broken block is a row with its error.

The block is parsed in Arrow batches and becomes a ``variant``, from which
``variant_get`` takes values by path and type. Dates are ISO strings in it, which
casts to a date or timestamp read. Defined results: without a block, value and
error are null; an empty block is an empty map; what is no map, has too many nodes
(``NODES``, aliases unfolded) or is no YAML has an error and no value; of equal
keys the last counts; keys become strings, and infinite numbers, too.
"""

from __future__ import annotations

import base64
import datetime
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.frontmatter import extract

#: Values of a block at most; a few aliases may unfold to billions.
NODES = 100_000


def _plain(value, left: list[int]):
    left[0] -= 1
    if left[0] < 0:
        raise ValueError(f"more than {NODES} values")
    if isinstance(value, dict):
        return {k if isinstance(k, str) else str(k): _plain(v, left) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v, left) for v in (sorted(value, key=str) if isinstance(value, set) else value)]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    return value


def parsed(block: str | None) -> tuple[str | None, str | None]:
    """(JSON, error) of a block."""
    import yaml

    if block is None:
        return None, None
    try:
        value = yaml.load(block, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        value = {} if value is None else value
        if not isinstance(value, dict):
            raise ValueError(f"the block is a {type(value).__name__}, not a map")
        return json.dumps(_plain(value, [NODES]), ensure_ascii=False), None
    except (yaml.YAMLError, ValueError, RecursionError, OverflowError) as e:
        return None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def _parsed(c: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsed(b) for b in c], columns=["json", "error"])


def with_typed_frontmatter(docs: DataFrame, text: str = "text", out: str = "front") -> DataFrame:
    """``docs`` with ``out``: struct<value variant, error string, body string> of a document's frontmatter; the body of a broken one is what follows the block."""
    found = docs.withColumn("_x", extract(F.coalesce(F.col(text), F.lit("")))).withColumn("_y", _parsed(F.col("_x.block")))
    return found.withColumn(out, F.struct(F.try_parse_json(F.col("_y.json")).alias("value"), F.col("_y.error").alias("error"), F.col("_x.body").alias("body"))).drop("_x", "_y")


def typed(value: Column, path: str, kind: str) -> Column:
    """A value of a typed frontmatter by path (``$.a.b``), null if it is not there or of another kind."""
    return F.try_variant_get(value, path, kind)
