"""Listing group: duplicates and multiple payments inside pay listings, without declarations.

One group per period. Counts per identifier, name and person are aggregates
joined back to the lines; only the rank of a line needs a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paywarden.functions import formulas as fx
from paywarden.functions.money import total
from paywarden.functions.text import full_name, has_name, person_key, spread_key, usable_id
from paywarden.operators.ranking import count_per, distinct_count, flag_first, ranked
from paywarden.schema import LINE_ORDER, MONEY, PERIOD, Rubric

PERSON_ORDER = ["regime", "institution_id", *LINE_ORDER]


class Group:
    UNUSABLE_ID = "UNUSABLE_ID"
    SEVERAL_REGIMES = "SEVERAL_REGIMES"
    SEVERAL_INSTITUTIONS = "SEVERAL_INSTITUTIONS"
    DUPLICATE_ID = "DUPLICATE_ID"
    DUPLICATE_NAME = "DUPLICATE_NAME"
    UNIQUE = "UNIQUE"


#: Rubric whose formula values a status; unique lines have no impact.
STATUS_RUBRICS = {
    Group.UNUSABLE_ID: Rubric.MISSING_ID,
    Group.SEVERAL_REGIMES: Rubric.PAID_ELSEWHERE,
    Group.SEVERAL_INSTITUTIONS: Rubric.PAID_ELSEWHERE,
    Group.DUPLICATE_ID: Rubric.DUPLICATE_ID,
    Group.DUPLICATE_NAME: Rubric.DUPLICATE_NAME,
}


def with_person(lines: DataFrame) -> DataFrame:
    return lines.withColumn("person_key", person_key(F.col("staff_key"), F.col("name_key"), F.col("line_id")))


def with_rank(lines: DataFrame, **sizes) -> DataFrame:
    """Rank of each line among the lines of its person in the period."""
    return ranked(with_person(lines), ["person_key", *PERIOD], PERSON_ORDER, "occurrence_rank", **sizes)


def person_figures(lines: DataFrame) -> DataFrame:
    """Lines, regimes and institutions per person and period."""
    return (
        with_person(lines)
        .groupBy("person_key", *PERIOD)
        .agg(
            F.count(F.lit(1)).alias("person_lines"),
            distinct_count("regime").alias("regimes"),
            distinct_count("institution_id").alias("institutions"),
        )
    )


def with_name_count(lines: DataFrame) -> DataFrame:
    """Lines with the same name in the period, 0 without a name."""
    name = F.col("name_key")
    keyed = lines.withColumn("name_join", spread_key(name, has_name(name), F.col("line_id")))
    counts = count_per(lines.where(has_name(name)), ["name_key", *PERIOD], "name_lines")
    counted = keyed.join(counts.withColumnRenamed("name_key", "name_join"), ["name_join", *PERIOD], "left")
    return counted.withColumn("name_lines", F.coalesce("name_lines", F.lit(0))).drop("name_join")


def occurrence_counts(lines: DataFrame) -> DataFrame:
    """Lines per identifier, lines per name, regimes and institutions per person."""
    keyed = with_person(with_name_count(lines))
    figures = keyed.join(person_figures(lines), ["person_key", *PERIOD], "left")
    # A usable identifier is the person key, so its lines are the person's lines.
    id_lines = F.when(usable_id(F.col("staff_key")), F.col("person_lines")).otherwise(F.lit(0))
    return figures.withColumn("id_lines", id_lines).drop("person_lines")


def group_status() -> Column:
    """First true wins."""
    return (
        F.when(~usable_id(F.col("staff_key")), Group.UNUSABLE_ID)
        .when(F.col("regimes") > 1, Group.SEVERAL_REGIMES)
        .when(F.col("institutions") > 1, Group.SEVERAL_INSTITUTIONS)
        .when(F.col("id_lines") > 1, Group.DUPLICATE_ID)
        .when(F.col("name_lines") > 1, Group.DUPLICATE_NAME)
        .otherwise(Group.UNIQUE)
    )


def with_first(lines: DataFrame) -> DataFrame:
    """The rank as far as sums need it: 1 for a person's first line in the period, 2 for every further one."""
    flagged = flag_first(with_person(lines), ["person_key", *PERIOD], PERSON_ORDER)
    return flagged.withColumn("occurrence_rank", F.when(F.col("first_line"), 1).otherwise(2).cast("long")).drop("first_line")


def listing_group(lines: DataFrame, formulas: list[fx.Formula] = (), rank: bool = True) -> DataFrame:
    """Every line with its counts, rank, single status, mass and impact.

    The rank comes first: its window is partitioned by person and slice, and a
    join by person before it would bring a large person back into one task. Without
    ``rank`` no window runs: further lines of a person all count as second.
    """
    formulas = list(formulas)
    placed = with_rank(lines) if rank else with_first(lines)
    counted = occurrence_counts(placed.drop("person_key")).withColumn("status", group_status())
    rubric = F.create_map(*[F.lit(x) for pair in STATUS_RUBRICS.items() for x in pair])[F.col("status")]
    formula = fx.resolve_by(formulas, "rubric", set(STATUS_RUBRICS.values()), fx.NO_FORMULA)
    resolved = counted.withColumn("rubric", rubric).withColumns({"formula_id": formula, "mass": F.col("gross_pay")})
    return fx.with_value(resolved, formulas, "impact", first="occurrence_rank = 1").drop("rubric")


def people_count(line_id: str = "line_id") -> Column:
    """Distinct persons by identifier, else name, else line. A missing-identifier mark counts as an identifier."""
    return F.countDistinct(F.coalesce(F.nullif("staff_key", F.lit("")), F.nullif("name_key", F.lit("")), F.col(line_id)))


def status_summary(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows, people, mass and impact per status."""
    return results.groupBy(*keys, "status").agg(
        F.count(F.lit(1)).alias("row_count"),
        people_count().alias("people"),
        total(F.col("mass")).alias("mass"),
        total(F.col("impact")).alias("impact"),
    )


def joined_list(column: str | Column) -> Column:
    """Distinct values in order, joined by a comma."""
    return F.concat_ws(", ", F.array_sort(F.collect_set(column)))


def unique_people(results: DataFrame, institutions: DataFrame) -> DataFrame:
    """One row per person of a period. Lines without identifier are grouped by name, an empty one included."""
    staff = F.col("staff_key")
    key = F.when(usable_id(staff), F.concat(F.lit("M:"), staff)).otherwise(F.concat(F.lit("N:"), "name_key"))
    named = results.join(institutions, "institution_id", "left")
    return named.groupBy(key.alias("person"), *PERIOD).agg(
        F.max("staff_key").alias("staff_key"),
        F.max(full_name(F.col("last_name"), F.col("first_name"))).alias("full_name"),
        F.max("name_key").alias("name_key"),
        F.max("status").alias("status"),
        joined_list("regime").alias("regimes"),
        joined_list("official_name").alias("institutions"),
        F.count(F.lit(1)).alias("row_count"),
        total(F.col("mass")).alias("mass"),
        total(F.col("impact")).alias("impact"),
    )


def listing_details(results: DataFrame, institutions: DataFrame) -> DataFrame:
    """The result lines with labels, as they are delivered."""
    return results.join(institutions, "institution_id", "left").select(
        "status", F.col("official_name").alias("institution"), "regime", *PERIOD, "line_id", "staff_key",
        full_name(F.col("last_name"), F.col("first_name")).alias("full_name"), "name_key", "id_lines", "name_lines",
        "regimes", "institutions", "occurrence_rank", "mass", "impact", "formula_id",
    )
