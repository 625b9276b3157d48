"""Payloads whose shape drifts: read as VARIANT, checked field by field.

A schema put on JSON text turns what does not fit into nulls, silently. Here a payload
is parsed once into a VARIANT and every expected field is held against the type found:
rows that fit come out typed, the others with the list of what was wrong.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentflow.session import stage

# Types found in a payload that a kind takes; a whole number is a number too.
_FITS = {
    "string": ["string"], "boolean": ["boolean"], "bigint": ["whole"], "double": ["whole", "number"],
    "variant": ["string", "boolean", "whole", "number", "object", "array"],
}


@dataclass(frozen=True)
class Field:
    """An expected value: column name, path in the payload, type, whether it must be there."""

    name: str
    path: str
    kind: str = "string"
    required: bool = False

    def __post_init__(self):
        if self.kind not in _FITS:
            raise ValueError(f"unknown kind: {self.kind}")


def kind_of(value: Column) -> Column:
    """string, boolean, whole, number, object, array or null; SQL null for no value at all."""
    shape = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(shape == "VOID", "null").when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean").when(shape.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), "whole")
        .when(shape.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "number").when(shape.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def checked(df: DataFrame, column: str, fields: Sequence[Field]) -> DataFrame:
    """Add the fields, typed, and ``problems``: one (field, problem, found) per fault.

    Problems are ``absent`` (no payload), ``malformed`` (no JSON), ``missing`` (a required
    field is not there, or null), ``retyped`` (the value is of another type) and ``range``
    (a number too large for the kind). A field that is not required may be missing or null.
    """
    names = [f.name for f in fields]
    if len(set(names)) < len(names) or set(names) & {"problems", column}:
        raise ValueError("field names must differ, also from the payload's and from problems")
    parsed = df.drop("problems", *names).withColumn("_v", F.try_parse_json(F.col(column)))
    parsed = parsed.withColumns({f"_p{i}": F.try_variant_get("_v", f.path, "variant") for i, f in enumerate(fields)})
    parsed = parsed.withColumns({f"_k{i}": kind_of(F.col(f"_p{i}")) for i in range(len(fields))})

    def fault(name: str, problem: str, found: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), F.lit(problem).alias("problem"), found.cast("string").alias("found"))

    whole = F.when(F.col(column).isNull(), fault(column, "absent", F.lit(None))).when(
        F.col("_v").isNull(), fault(column, "malformed", F.lit(None))
    )
    faults = [whole]
    values = {
        f.name: F.when(F.col(f"_k{i}").isin(_FITS[f.kind]), F.try_variant_get(f"_p{i}", "$", f.kind)) for i, f in enumerate(fields)
    }
    parsed = parsed.withColumns(values)
    for i, f in enumerate(fields):
        kind = F.col(f"_k{i}")
        gone = kind.isNull() | (kind == "null")
        lacking = F.when(F.col("_v").isNotNull() & gone, fault(f.name, "missing", kind)) if f.required else F.lit(None)
        retyped = F.when(~gone & ~kind.isin(_FITS[f.kind]), fault(f.name, "retyped", kind))
        beyond = F.when(~gone & F.col(f.name).isNull(), fault(f.name, "range", kind))
        faults.append(F.coalesce(retyped, beyond, lacking))
    out = parsed.withColumn("problems", F.array_compact(F.array(*faults)))
    return out.drop("_v", *[f"_{a}{i}" for i in range(len(fields)) for a in "pk"])


def split_payloads(df: DataFrame, column: str, fields: Sequence[Field]) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, typed, without the payload; rejected rows with payload and problems).

    The checked rows are staged, so that both outputs come from one parse.
    """
    both = stage(checked(df, column, fields), "payloads")
    good = both.filter(F.size("problems") == 0).drop(column, "problems")
    return good, both.filter(F.size("problems") > 0).drop(*[f.name for f in fields])


def shapes(df: DataFrame, column: str, paths: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (``by``, path, kind, n): which types each path has held, to see a drift coming.

    The kind is null where the path is not there, and ``malformed`` for no JSON.
    """
    parsed = df.filter(F.col(column).isNotNull()).select(*by, F.try_parse_json(F.col(column)).alias("_v"))
    kinds = F.array(*[
        F.struct(
            F.lit(p).alias("path"),
            F.when(F.col("_v").isNull(), "malformed").otherwise(kind_of(F.try_variant_get("_v", p, "variant"))).alias("kind"),
        ) for p in paths
    ])
    return parsed.select(*by, F.inline(kinds)).groupBy(*by, "path", "kind").agg(F.count(F.lit(1)).alias("n"))


def common_schema(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The one type that covers all payloads, per group, as Spark writes it."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("schema"))
