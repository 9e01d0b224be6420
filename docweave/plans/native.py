"""Paths of fixed steps as Catalyst plans over VARIANT: no Python, no shuffle."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.plans.steps import Child, Index, Iterate, Range, Step


def expressible(steps: tuple[Step, ...]) -> bool:
    """Whether the steps need neither descent nor errors nor mandatory fields."""
    return all(isinstance(s, (Child, Index, Range, Iterate)) and not s.strict and not getattr(s, "mandatory", False) for s in steps)


def _key(name: str) -> str:
    return f"[{json.dumps(name)}]" if '"' not in name and "\\" not in name else ""


def select(df: DataFrame, doc: str, steps: tuple[Step, ...], out: str = "value") -> DataFrame:
    """A row for each match, with the columns of df and the match as VARIANT. A document that isn't JSON, or has
    duplicate keys in an object, gives no row."""
    if not expressible(steps):
        raise ValueError("these steps need the document walker")
    spark = df.sparkSession
    df = df.withColumn("dw_v", F.try_parse_json(F.col(doc)))
    path = "$"

    def settle(df: DataFrame, path: str) -> DataFrame:
        if path != "$":
            df = df.withColumn("dw_v", F.try_variant_get("dw_v", path, "variant"))
        return df.where("dw_v is not null")

    for s in steps:
        if isinstance(s, Child) and s.names and len(s.names) == 1 and _key(s.names[0]):
            path += _key(s.names[0])
            continue
        if isinstance(s, Index) and len(s.places) == 1:
            path += f"[{s.places[0]}]"
            continue
        df, path = settle(df, path), "$"
        df = df.lateralJoin(spark.tvf.variant_explode(F.col("dw_v").outer()))
        match s:
            case Child(None):
                keep: Column = F.col("key").isNotNull()
            case Child(names):
                keep = F.col("key").isin(*names)
            case Index(places):
                keep = F.col("key").isNull() & F.col("pos").isin(*places)
            case Range(low, high):
                keep = F.col("key").isNull() & (F.col("pos") >= (low or 0))
                keep = keep if high is None else keep & (F.col("pos") <= high)
            case Iterate(_, arrays_only):
                keep = F.col("key").isNull() if arrays_only else F.lit(True)
        df = df.where(keep).withColumn("dw_v", F.col("value")).drop("pos", "key", "value")
    return settle(df, path).withColumnRenamed("dw_v", out)


def first(doc: Column, path: str, kind: str) -> Column:
    """The typed value at a path of names and single indices, as one expression; null where it is missing or of another type."""
    return F.try_variant_get(F.try_parse_json(doc), path, kind)
