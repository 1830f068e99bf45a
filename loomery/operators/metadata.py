"""A dictionary DSL over metadata tables: filter, group, aggregate, project, order, limit.

Filters are AND-ed. `=` and `!=` treat null as a value, `in` means membership (of the field in
a list, or of the value in a list field), `contains` ignores case and looks into list elements,
comparisons drop nulls and values of another type, and an unknown operator, or none, lets every row
pass. Operators and functions are read without regard to case. Sums and averages of nothing are 0. A limit of 0 or less means none. Sort keys see
projected fields only; strings sort without regard to case, nulls last, ties by the input's ordinal.
"""

from __future__ import annotations

import warnings
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def predicate(df: DataFrame, field: str, op: str | None, value: Any) -> Column:
    """The condition of one filter; a field that the table lacks is null."""
    op = (op or "").lower()
    types = {f.name: f.dataType for f in df.schema}
    col = F.col(f"`{field}`") if field in types else F.lit(None).cast("string")
    kind = types.get(field, T.StringType())
    listed = isinstance(kind, T.ArrayType)
    if op == "=":
        return col.eqNullSafe(F.lit(value))
    if op == "!=":
        return ~col.eqNullSafe(F.lit(value))
    if op == "in":
        if isinstance(value, (list, tuple, set)):
            known = [v for v in value if v is not None]
            hit = F.coalesce(col.isin(known), F.lit(False)) if known else F.lit(False)
            return hit | col.isNull() if len(known) < len(value) else hit
        if listed:
            return F.coalesce(F.array_contains(col, F.lit(value)), F.lit(False))
        return col.eqNullSafe(F.lit(value))
    if op == "contains":
        needle = F.lit(str("" if value is None else value).lower())
        if listed:
            return F.coalesce(F.exists(col, lambda x: F.contains(F.lower(F.coalesce(x.cast("string"), F.lit(""))), needle)), F.lit(False))
        return F.contains(F.lower(F.coalesce(col.cast("string"), F.lit(""))), needle)
    if op in (">", ">=", "<", "<="):
        if value is None or listed or (isinstance(value, str) != isinstance(kind, T.StringType)) and not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.lit(False)
        right = F.lit(value)
        return F.coalesce({">": col > right, ">=": col >= right, "<": col < right, "<=": col <= right}[op], F.lit(False))
    warnings.warn(f"unknown filter operator {op!r} lets every row pass", stacklevel=3)
    return F.lit(True)


def filtered(df: DataFrame, filters: list[dict] | None) -> DataFrame:
    conditions = [predicate(df, f.get("field") or "", f.get("op"), f.get("value")) for f in filters or ()]
    return df.where(reduce(and_, conditions)) if conditions else df


def _aggregate(df: DataFrame, spec: dict) -> Column:
    func, field = (spec.get("func") or "").lower(), spec.get("field") or "*"
    name = spec.get("as_") or spec.get("as") or f"{spec.get('func', '')}_{spec.get('field', '')}".strip("_")
    kind = {f.name: f.dataType for f in df.schema}.get(field)
    col = F.col(f"`{field}`") if kind is not None else F.lit(None).cast("double")
    if isinstance(kind, T.BooleanType):
        col = col.cast("int")
    number = col if kind is None or isinstance(kind, (T.NumericType, T.BooleanType)) else F.lit(None).cast("double")
    if func == "count":
        out = F.count(F.lit(1)) if field == "*" else F.count(F.col(f"`{field}`") if kind is not None else F.lit(None))
    elif func == "sum":
        out = F.coalesce(F.sum(number), F.lit(0))
    elif func == "avg":
        out = F.coalesce(F.avg(number), F.lit(0.0))
    else:
        out = F.max(F.lit(None).cast("string"))
    return out.alias(name)


def query_metadata(df: DataFrame, select: list[str] | None = None, filters: list[dict] | None = None, group_by: list[str] | None = None, aggregates: list[dict] | None = None, order_by: list[dict] | None = None, limit: int | None = None, ordinal: str | None = None) -> DataFrame:
    """Runs a query. ordinal: a column that gives the rows their order; it decides which row is the
    first of a group and breaks ties. Without it a hash of the row does, which is the same for any layout of files."""
    rows = filtered(df, filters)
    at = F.col(f"`{ordinal}`") if ordinal else F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows = rows.withColumn("__ordinal", at)
    names = set(df.columns)
    if group_by or aggregates:
        aggs = [_aggregate(df, a) for a in aggregates or ()]
        others = [c for c in select or () if c not in (group_by or ())]
        firsts = [(F.min_by(F.col(f"`{c}`"), F.col("__ordinal")) if c in names else F.max(F.lit(None).cast("string"))).alias(c) for c in others]
        place = F.min("__ordinal").alias("__ordinal")
        out = rows.groupBy(*[F.col(f"`{c}`") for c in group_by or ()]).agg(*aggs, *firsts, place)
    elif select:
        out = rows.select(*[F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in select], "__ordinal")
    else:
        out = rows
    if order_by:
        keys = []
        types = dict(out.dtypes)
        for k in order_by:
            if k["field"] not in types:
                continue
            col = F.lower(f"`{k['field']}`") if types[k["field"]] == "string" else F.col(f"`{k['field']}`")
            keys.append(col.desc_nulls_last() if str(k.get("direction", "asc")).lower() == "desc" else col.asc_nulls_last())
        out = out.orderBy(*keys, F.col("__ordinal").asc_nulls_last())
    elif limit and limit > 0:
        out = out.orderBy(F.col("__ordinal").asc_nulls_last())
    if limit and limit > 0:
        out = out.limit(limit)
    return out.drop("__ordinal")


def describe_fields(df: DataFrame, fields: list[str], ordinal: str, most: int = 15) -> DataFrame:
    """(field, value, n, first_at): the first `most` distinct values of each field in order of appearance,
    lists flattened, with how many rows hold them."""
    parts = []
    for name in fields:
        col = F.col(f"`{name}`")
        listed = dict(df.dtypes)[name].startswith("array")
        values = F.explode(F.array_distinct(F.transform(col, lambda x: x.cast("string")))) if listed else col.cast("string")
        parts.append(df.select(F.lit(name).alias("field"), values.alias("value"), F.col(f"`{ordinal}`").alias("at")).where("value is not null"))
    seen = reduce(DataFrame.unionByName, parts).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    rank = F.row_number().over(W.partitionBy("field").orderBy("first_at", "value"))
    return seen.withColumn("r", rank).where(F.col("r") <= most).drop("r")
