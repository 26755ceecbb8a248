"""Matching: each pay line against the declarations of its own scope.

Scope columns are part of every key, so one run covers all institutions,
regimes and quarters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paywarden.functions import formulas as fx
from paywarden.functions.money import total
from paywarden.functions.text import has_name, spread_key, usable_id
from paywarden.operators.ranking import first_line_ids
from paywarden.schema import MONEY, Rubric, SCOPE


class Match:
    OK_BY_ID = "OK_BY_ID"
    OK_BY_NAME = "OK_BY_NAME"
    DUPLICATE_ID = "DUPLICATE_ID"
    MISSING_ID = "MISSING_ID"
    PAID_NOT_DECLARED = "PAID_NOT_DECLARED"
    DECLARED_NOT_PAID = "DECLARED_NOT_PAID"
    CONFIRMED = (OK_BY_ID, OK_BY_NAME)
    PAY_STATUSES = (DUPLICATE_ID, OK_BY_ID, OK_BY_NAME, MISSING_ID, PAID_NOT_DECLARED)


def by_id(declared: DataFrame) -> DataFrame:
    """One declaration per scope and identifier."""
    return (
        declared.where(usable_id(F.col("staff_key")))
        .groupBy("staff_key", *SCOPE)
        .agg(F.min("declared_id").alias("id_match"))
    )


def by_name(declared: DataFrame) -> DataFrame:
    """One declaration per scope and name."""
    return (
        declared.where(has_name(F.col("name_key")))
        .groupBy("name_key", *SCOPE)
        .agg(F.min("declared_id").alias("name_match"))
    )


def with_spread_keys(lines: DataFrame) -> DataFrame:
    """Join keys under which lines without identifier or name do not pile up."""
    staff, name, line = F.col("staff_key"), F.col("name_key"), F.col("line_id")
    return lines.select(
        "*",
        spread_key(staff, usable_id(staff), line).alias("id_join"),
        spread_key(name, has_name(name), line).alias("name_join"),
    )


def link(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """Add the declaration found by identifier, the one found by name, and the first-line flag.

    First lines and declarations meet per identifier before the lines do, so the
    lines move twice: once by identifier, once by name.
    """
    keyed = with_spread_keys(lines)
    firsts = first_line_ids(lines, ["staff_key", *SCOPE])
    per_id = firsts.join(by_id(declared), ["staff_key", *SCOPE], "left")
    staff = F.col("staff_key")
    per_id = per_id.select(
        *SCOPE, spread_key(staff, usable_id(staff), F.col("first_line_id")).alias("id_join"), "first_line_id", "id_match"
    )
    per_name = by_name(declared).withColumnRenamed("name_key", "name_join")
    return (
        keyed.join(per_id, ["id_join", *SCOPE], "left")
        .withColumn("first_line", F.coalesce(F.col("line_id") == F.col("first_line_id"), F.lit(False)))
        .join(per_name, ["name_join", *SCOPE], "left")
        .drop("id_join", "name_join", "first_line_id")
    )


def match_status() -> Column:
    """First true wins."""
    staff = F.col("staff_key")
    return (
        F.when(~F.col("first_line") & usable_id(staff), Match.DUPLICATE_ID)
        .when(F.col("id_match").isNotNull(), Match.OK_BY_ID)
        .when(F.col("name_match").isNotNull(), Match.OK_BY_NAME)
        .when(~usable_id(staff), Match.MISSING_ID)
        .otherwise(Match.PAID_NOT_DECLARED)
    )


def classify(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """Status, method, score and declaration of every pay line."""
    found_by_id, found_by_name = F.col("id_match").isNotNull(), F.col("name_match").isNotNull()
    return (
        link(lines, declared)
        .withColumn("declared_id", F.coalesce("id_match", "name_match"))
        .withColumn("method", F.when(found_by_id, "ID").when(found_by_name, "NAME").otherwise("NONE"))
        .withColumn("score", F.when(found_by_id, 1.0).when(found_by_name, 0.8).otherwise(0.0))
        .withColumn("status", match_status())
    )


def declared_not_paid(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """Declarations that no pay line refers to.

    What lines refer to follows from their distinct identifiers and names; the lines themselves do not move for it.
    """
    staff, name = F.col("staff_key"), F.col("name_key")
    people = lines.select(*SCOPE, "staff_key", "name_key").distinct()
    keyed = people.withColumn("id_join", spread_key(staff, usable_id(staff), F.coalesce(name, F.lit(""))))
    found = keyed.join(by_id(declared).withColumnRenamed("staff_key", "id_join"), ["id_join", *SCOPE], "left")
    falls_back = F.col("id_match").isNull() & has_name(name)
    named = found.withColumn("name_join", spread_key(name, falls_back, F.coalesce(staff, F.lit(""))))
    both = named.join(by_name(declared).withColumnRenamed("name_key", "name_join"), ["name_join", *SCOPE], "left")
    used = both.select(F.coalesce("id_match", "name_match").alias("declared_id")).where("declared_id is not null").distinct()
    return declared.join(used, "declared_id", "left_anti")


def value_matches(classified: DataFrame, formulas: list[fx.Formula], forced: fx.Formula | None = None) -> DataFrame:
    """Controlled mass and potential impact. The mass never uses a forced formula."""
    known = [*formulas, *([forced] if forced and forced not in formulas else [])]
    if forced is None:
        rubric_formula = fx.resolve_by(formulas, "status", Match.PAY_STATUSES)
    else:
        rubric_formula = F.lit(forced.formula_id)
    resolved = classified.withColumns(
        {"formula_id": rubric_formula, "mass_formula_id": fx.resolve_id(formulas, Rubric.ANY)}
    )
    valued = fx.with_value(resolved, known, "impact", "formula_id", "first_line")
    return fx.with_value(valued, formulas, "mass", "mass_formula_id", "first_line").drop("mass_formula_id")


RESULT = [
    *SCOPE, "line_id", "declared_id", "method", "score", "status", "mass", "impact", "formula_id",
]


def matching(
    lines: DataFrame, declared: DataFrame, formulas: list[fx.Formula] = (), forced: fx.Formula | None = None
) -> DataFrame:
    """One row per pay line, and one per declaration without payment."""
    formulas = list(formulas)
    paid = value_matches(classify(lines, declared), formulas, forced).select(*RESULT)
    zero = F.lit(0).cast(MONEY)
    unpaid = declared_not_paid(lines, declared).select(
        *SCOPE,
        F.lit(None).cast("string").alias("line_id"),
        "declared_id",
        F.lit("NONE").alias("method"),
        F.lit(0.0).alias("score"),
        F.lit(Match.DECLARED_NOT_PAID).alias("status"),
        zero.alias("mass"),
        zero.alias("impact"),
        F.lit(None).cast("string").alias("formula_id"),
    )
    return paid.unionByName(unpaid)


def matching_summary(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows, mass, potential and confirmed impact per status. Confirmed impact starts at zero."""
    return results.groupBy(*keys, "status").agg(
        F.count(F.lit(1)).alias("row_count"),
        total(F.col("mass")).alias("mass"),
        total(F.col("impact")).alias("impact"),
        total(F.lit(0).cast(MONEY)).alias("confirmed_impact"),
    )
