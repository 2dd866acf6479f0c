"""B: projections, filters and row-level checks (all native Column expressions)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


# --------------------------------------------------------------------------- B1
def preview(col: str | Column, n: int) -> Column:
    """``LEFT(text, n)`` in characters (200 CV, 300 posting, 500 discovered posting)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.left(c, F.lit(n))


# --------------------------------------------------------------------------- B2
def filter_feed(df: DataFrame, active: str | None = "is_active", lower_cols: tuple[str, ...] = ("source",),
                **filters) -> DataFrame:
    """AND of optional equality filters; a None/'' value means "no filter".

    Values for ``lower_cols`` are compared lower-cased; the feed is limited to
    active rows.  Filters are plain predicates, so they reach the Parquet scan.
    """
    out = df.where(F.col(active)) if active else df
    for col, value in filters.items():
        if value is None or value == "":
            continue
        if col in lower_cols:
            out = out.where(F.lower(F.col(col)) == F.lit(str(value).lower()))
        else:
            out = out.where(F.col(col) == F.lit(value))
    return out


# --------------------------------------------------------------------------- B3
def escape_like(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(df: DataFrame, col: str, term: str, raw: bool = False) -> DataFrame:
    """Case-insensitive partial match.  By default ``%``/``_`` in the term are literal;
    ``raw=True`` keeps them as wildcards (the reference's behaviour)."""
    pattern = f"%{term if raw else escape_like(term)}%"
    return df.where(F.col(col).ilike(pattern))


# --------------------------------------------------------------------------- B4
def lookup(df: DataFrame, ids: DataFrame, key: str = "id", owner: str = "user_id",
           ids_key: str = "id", ids_owner: str = "user_id") -> DataFrame:
    """Batch get-by-id with owner check: rows whose (id, owner) is requested (left semi join)."""
    req = ids.select(F.col(ids_key).alias("_k"), F.col(ids_owner).alias("_o")).distinct()
    return df.join(req, (df[key] == req._k) & (df[owner] == req._o), "left_semi")


# --------------------------------------------------------------------------- B5
def normalise_blanks(df: DataFrame, blank_to_null: tuple[str, ...] = (), positive: tuple[str, ...] = (),
                     lower: tuple[str, ...] = (), defaults: Mapping[str, str] | None = None) -> DataFrame:
    """'' → NULL, numbers ≤ 0 → NULL, lower-casing, default strings for NULL/blank."""
    exprs = {}
    for c in blank_to_null:
        exprs[c] = F.nullif(F.trim(F.col(c)), F.lit(""))
    for c in positive:
        exprs[c] = F.when(F.col(c) > 0, F.col(c))
    for c in lower:
        exprs[c] = F.lower(exprs.get(c, F.col(c)))
    for c, value in (defaults or {}).items():
        exprs[c] = F.coalesce(F.nullif(F.trim(exprs.get(c, F.col(c))), F.lit("")), F.lit(value))
    return df.withColumns(exprs)


# --------------------------------------------------------------------------- B6
def contract_violations(df: DataFrame, row_id: str, contract: Mapping[str, Mapping]) -> DataFrame:
    """Long table (row_id, column, rule, value) of enum, range, length and not-null violations.

    ``contract = {col: {"enum": [...], "range": (lo, hi), "max_len": n, "not_null": True}}``.
    One pass: every rule is a ``when`` producing a struct or NULL; the array of them is
    exploded and NULLs dropped.
    """
    checks = []
    for col, rules in contract.items():
        c = F.col(col)
        val = c.cast("string")
        if rules.get("not_null"):
            checks.append(F.when(c.isNull(), F.struct(F.lit(col).alias("column"), F.lit("not_null").alias("rule"), val.alias("value"))))
        if "enum" in rules:
            checks.append(F.when(c.isNotNull() & ~c.isin(list(rules["enum"])),
                                 F.struct(F.lit(col).alias("column"), F.lit("enum").alias("rule"), val.alias("value"))))
        if "range" in rules:
            lo, hi = rules["range"]
            checks.append(F.when(c.isNotNull() & ((c < lo) | (c > hi)),
                                 F.struct(F.lit(col).alias("column"), F.lit("range").alias("rule"), val.alias("value"))))
        if "max_len" in rules:
            checks.append(F.when(F.length(c) > rules["max_len"],
                                 F.struct(F.lit(col).alias("column"), F.lit("max_len").alias("rule"), val.alias("value"))))
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(F.col(row_id).alias("row_id"), F.explode(arr).alias("_v")).select("row_id", "_v.*")


# --------------------------------------------------------------------------- B7
def parse_payload(df: DataFrame, col: str, schema: str, out: str = "parsed") -> DataFrame:
    """JSON text → struct (PERMISSIVE: malformed text yields NULL fields, the raw text is kept)."""
    return df.withColumn(out, F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"}))


def parse_payload_variant(df: DataFrame, col: str, out: str = "parsed") -> DataFrame:
    """Open-shape JSON → VARIANT (``try_parse_json``: malformed → NULL, never an error)."""
    return df.withColumn(out, F.try_parse_json(F.col(col)))


# --------------------------------------------------------------------------- B8
def weights_sum_check(df: DataFrame, map_col: str, total: float = 100.0, tol: float = 1e-9) -> DataFrame:
    """Sum of each allocation map's values and whether it equals ``total``."""
    s = F.aggregate(F.map_values(F.col(map_col)), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return df.withColumn("weight_sum", s).withColumn("weights_ok", F.abs(F.col("weight_sum") - total) <= tol)


# --------------------------------------------------------------------------- B9
def compose_text(description: str = "description_text", requirements: str = "requirements_text",
                 role: str = "role_title", company: str = "company_name", location: str = "location") -> Column:
    """Posting body = description + requirements block; under 50 characters a header text instead."""
    desc = F.coalesce(F.col(description), F.lit(""))
    req = F.col(requirements)
    body = F.when((req.isNotNull()) & (req != ""), F.concat(desc, F.lit("\n\nRequirements:\n"), req)).otherwise(desc)
    fallback = F.concat(
        F.lit("Job: "), F.coalesce(F.col(role).cast("string"), F.lit("None")), F.lit(" at "),
        F.coalesce(F.col(company).cast("string"), F.lit("None")),
        F.lit("\n\nLocation: "), F.coalesce(F.nullif(F.col(location), F.lit("")), F.lit("Not specified")),
    )
    return F.when(F.length(body) < 50, fallback).otherwise(body)


# --------------------------------------------------------------------------- B10
def truncate_text(col: str | Column, n: int = 2000) -> Column:
    """Strings longer than n → first n chars + ``... [truncated, total N chars]``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("... [truncated, total "),
                                            F.length(c).cast("string"), F.lit(" chars]"))).otherwise(c)


def truncated(value: Column, kind: DataType, n: int, items: int) -> Column:
    """``value`` with every string in it capped at ``n`` characters and every array at ``items``
    elements, at any depth of structs, arrays and maps."""
    if isinstance(kind, StringType):
        return truncate_text(value, n)
    if isinstance(kind, ArrayType):
        return F.transform(F.slice(value, 1, items), lambda x: truncated(x, kind.elementType, n, items))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: truncated(x, kind.valueType, n, items))
    if isinstance(kind, StructType):
        parts = [truncated(value[f.name], f.dataType, n, items).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    return value


def truncate_payload(df: DataFrame, cols: list[str], n: int = 2000, items: int = 10) -> DataFrame:
    """Cap long strings and arrays of the given columns (see ``truncated``)."""
    return df.withColumns({f.name: truncated(F.col(f.name), f.dataType, n, items)
                           for f in df.schema.fields if f.name in cols})


# --------------------------------------------------------------------------- B11
def payload_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per payload column: present count, text length min/avg/max, JSON objects/arrays, max keys.

    One scan: the columns are stacked into (column, value) rows and grouped by column.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("_s")).select("_s.*")
    v = F.col("value")
    # parse once per value; the checks below read the parsed flag and the first character
    parsed = stacked.select("column", "value", F.try_parse_json(v).isNotNull().alias("_ok"),
                            F.left(F.ltrim(v), F.lit(1)).alias("_c0"))
    is_obj = F.col("_ok") & (F.col("_c0") == "{")
    is_arr = F.col("_ok") & (F.col("_c0") == "[")
    return parsed.groupBy("column").agg(
        F.count(v).alias("present"),
        F.min(F.length(v)).alias("min_len"),
        F.round(F.avg(F.length(v)), 2).alias("avg_len"),
        F.max(F.length(v)).alias("max_len"),
        F.count_if(is_obj).alias("json_objects"),
        F.count_if(is_arr).alias("json_arrays"),
        F.max(F.when(is_obj, F.size(F.json_object_keys(v)))).alias("max_keys"),
        F.max(F.when(is_arr, F.json_array_length(v))).alias("max_items"),
    )


def payload_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, key, count): top-level keys of the JSON objects of each payload column, one scan."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("_s")).select("_s.*")
    objects = stacked.where(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    return objects.select("column", F.explode(F.json_object_keys("value")).alias("key")).groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("count"))
