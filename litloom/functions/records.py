"""Structured records as JSON: parsing, required keys, typed validation, list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions.text import clean_response

#: Fixed values of the data model: the list fields of a record, in order.
LIST_FIELDS = ("objectives", "methods", "datasets", "evaluation_metrics", "limitations", "future_directions")


def list_from_json(c: Column) -> Column:
    """JSON list of strings; null, malformed or not a list: empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def list_to_json(c: Column) -> Column:
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))


def validated(responses: DataFrame, response_col: str = "response") -> DataFrame:
    """All columns plus ``raw_json``, the six lists and ``reason`` (null where the record is valid).

    Reasons: ``not json``, ``not an object``, ``missing keys: ..``, ``bad field: ..``. Extra keys are
    kept in ``raw_json``. Keys given twice count as not JSON.
    """
    rows = responses.withColumn("raw_json", clean_response(F.col(response_col))).withColumn("__v", F.try_parse_json("raw_json"))
    keys = F.json_object_keys("raw_json")
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in LIST_FIELDS]), keys))
    for f in LIST_FIELDS:
        rows = rows.withColumn(f"__{f}", F.try_variant_get("__v", f"$.{f}", "variant")).withColumn(f, F.try_variant_get("__v", f"$.{f}", "array<string>"))
    kinds = {f: F.schema_of_variant(F.col(f"__{f}")) for f in LIST_FIELDS}
    good = {f: F.coalesce(kinds[f].isin("ARRAY<STRING>", "ARRAY<VOID>") & F.col(f).isNotNull() & ~F.exists(f, lambda x: x.isNull()), F.lit(False)) for f in LIST_FIELDS}
    bad = F.filter(F.array(*[F.when(~good[f], F.lit(f)) for f in LIST_FIELDS]), lambda x: x.isNotNull())
    reason = (
        F.when(F.col("__v").isNull(), "not json")
        .when(keys.isNull(), "not an object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ",")))
        .when(F.size(bad) > 0, F.concat(F.lit("bad field: "), F.array_join(bad, ",")))
    )
    return rows.withColumn("reason", reason).drop("__v", *[f"__{f}" for f in LIST_FIELDS])
