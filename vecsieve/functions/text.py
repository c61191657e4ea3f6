"""String and parameter functions of the run log."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _shown(value: object) -> str:
    """A parameter for display: lists joined by |, floats as %g, anything else by name."""
    if isinstance(value, list):
        return "|".join(map(_shown, value))
    return "%g" % value if isinstance(value, float) else str(value)


@F.pandas_udf(StringType())
def format_number(x: pd.Series) -> pd.Series:
    """Six significant digits as C's %g, which rounds the exact binary value: the JVM's formats round its decimal text."""
    return x.map(lambda v: None if v is None else "%g" % v)


@F.pandas_udf(StringType())
def _shown_params(params: pd.Series) -> pd.Series:
    return params.map(lambda text: None if text is None else json.dumps({k: _shown(v) for k, v in json.loads(text).items()}))


def shown_params(params: Column) -> Column:
    """Map of a JSON object's values as they are displayed; the run log's size, in Arrow batches."""
    return F.from_json(_shown_params(params), "map<string,string>")


def format_params(params: Column) -> Column:
    """``k=v`` by key, joined by a space."""
    pairs = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), " ")


def run_name(technique: Column, dataset: Column, params: Column) -> Column:
    pairs = F.array_sort(F.map_entries(params))
    return F.concat_ws("-", technique, dataset, F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], e["value"])), "-"))


def reversed_hash_path(root: str, cid: Column) -> Column:
    """Three folders from the last characters of an id, two each, last first."""
    part = lambda i: F.substring(cid, F.length(cid) - i, 2)
    return F.concat_ws("/", F.lit(root), part(1), part(3), part(5), cid)


def family(name: Column) -> Column:
    return F.split_part(name, F.lit("-"), F.lit(1))


def path_segment(path: Column, index: int) -> Column:
    return F.element_at(F.split(path, "/"), index)


def learning_rate(name: Column) -> Column:
    """The rate in a run's name, before its low-rank or seed part."""
    return F.regexp_extract(name, r"-lr(.+?)-(?:lora|seed)", 1).try_cast("double")


def lora_rank(name: Column) -> Column:
    return F.regexp_extract(name, r"-lora(\d+)", 1).try_cast("int")


def mirrored(filename: Column, renamed: dict[str, str]) -> Column:
    """``folder/stem.safetensors``: the folder is what stands before ``-features-``, else before the last dash, with ``renamed`` parts."""
    stem = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.[^.]*$", "")
    folder = F.when(stem.contains("-features-"), F.split_part(stem, F.lit("-features-"), F.lit(1))).otherwise(F.regexp_replace(stem, r"-[^-]*$", ""))
    for old, new in renamed.items():
        folder = F.replace(folder, F.lit(old), F.lit(new))
    return F.concat(folder, F.lit("/"), stem, F.lit(".safetensors"))


def trained(run: Column, folders: dict[str, str]) -> Column:
    """``folder/run.safetensors`` of the first prefix that a run's name has; any other name is an error."""
    found = F.coalesce(*[F.when(run.startswith(prefix), folder) for prefix, folder in folders.items()])
    sure = F.coalesce(found, F.raise_error(F.concat(F.lit("no folder holds runs like "), run)).cast("string"))
    return F.concat(sure, F.lit("/"), run, F.lit(".safetensors"))
