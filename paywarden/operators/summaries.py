"""Figures about imports, sources, components and the whole stock of data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paywarden.functions import formulas as fx
from paywarden.functions.filters import FilterRule, retained
from paywarden.functions.money import total
from paywarden.functions.text import has_name, usable_id
from paywarden.operators.matching import Match
from paywarden.operators.ranking import flag_first
from paywarden.schema import SCOPE


def institution_label(lines: DataFrame, institutions: DataFrame) -> DataFrame:
    """Official name of the institution, or its id."""
    named = lines.join(institutions, "institution_id", "left")
    return named.withColumn("institution", F.coalesce("official_name", "institution_id")).drop("official_name")


def import_files(journal: DataFrame) -> DataFrame:
    """One file per import, so that a repeated journal entry multiplies nothing."""
    return journal.groupBy("execution_id").agg(F.min("source_file").alias("source_file"))


def available_sources(lines: DataFrame, institutions: DataFrame, journal: DataFrame) -> DataFrame:
    """Lines per import, institution, regime and source table of each period."""
    counted = lines.groupBy("execution_id", *SCOPE, "source_table").agg(F.count(F.lit(1)).alias("row_count"))
    return institution_label(counted.join(import_files(journal), "execution_id", "left"), institutions)


def declaration_versions(declared: DataFrame, journal: DataFrame) -> DataFrame:
    """Imports of declarations per scope, newest first."""
    counted = declared.groupBy("execution_id", *SCOPE).agg(F.count(F.lit(1)).alias("row_count"))
    finished = journal.groupBy("execution_id", *SCOPE).agg(
        F.min("source_file").alias("source_file"), F.min("finished_on").alias("finished_on")
    )
    versions = counted.join(finished, ["execution_id", *SCOPE], "left")
    return versions.orderBy(F.col("finished_on").desc_nulls_last(), "execution_id", *SCOPE)


def one_version(versions: DataFrame, execution_id: str = "") -> DataFrame:
    """The declaration version to analyse per scope; it has to be named where there are several."""
    if execution_id:
        return versions.where(F.col("execution_id") == execution_id)
    several = versions.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not several.isEmpty():
        raise ValueError("Some scopes have several declaration versions. Name the one to analyse.")
    return versions


def source_diagnosis(lines: DataFrame, rules: list[FilterRule], keys: list[str] = ("execution_id", *SCOPE)) -> DataFrame:
    """Available and retained lines, usable identifiers and names, and what stands in the way of an analysis."""
    counted = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("available"),
        F.count_if(retained(rules)).alias("retained"),
        F.count_if(usable_id(F.col("staff_key"))).alias("usable_ids"),
        F.count_if(has_name(F.col("name_key"))).alias("usable_names"),
    )
    issues = [
        F.when(F.col("retained") == 0, "No line after filters"),
        F.when(F.col("usable_ids") + F.col("usable_names") == 0, "No usable identifier or name"),
    ]
    checked = counted.withColumn("issues", F.concat_ws("; ", *issues))
    return checked.withColumn("ready", F.col("issues") == "")


def filter_preview(lines: DataFrame, rules: list[FilterRule], keys: list[str] = ("execution_id",)) -> DataFrame:
    """Lines before and after the business filters."""
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("available"), F.count_if(retained(rules)).alias("retained")
    )


def dashboard(lines: DataFrame, declared: DataFrame, journal: DataFrame, results: DataFrame) -> DataFrame:
    """Institutions, finished imports, pay lines, declarations and open anomalies, one metric per row."""
    one = F.count(F.lit(1)).alias("value")
    institutions = (
        lines.select("institution_id").distinct().union(declared.select("institution_id").distinct())
        .agg(F.count_distinct("institution_id").alias("value"))
    )
    metrics = {
        "institutions": institutions,
        "imports": journal.where("status = 'DONE'").agg(one),
        "pay_lines": lines.agg(one),
        "declarations": declared.agg(one),
        "anomalies": results.where(~F.col("status").isin(list(Match.CONFIRMED))).agg(one),
    }
    rows = None
    for name, metric in metrics.items():
        row = metric.select(F.lit(name).alias("metric"), "value")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def component_availability(lines: DataFrame, mapped: list[str] = (), extra: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """Lines with an amount per pay component, from one aggregate. Components never mapped nor filled are left out."""
    filled: dict[str, Column] = {
        code: F.count_if(F.abs(F.coalesce(F.col(column), F.lit(0))) > 0)
        for code, column in fx.BUILT_IN_COMPONENTS.items()
        if column in lines.columns
    }
    for code in extra:
        filled[code] = F.count(F.try_element_at(F.col("extra_components"), F.lit(code)))
    counted = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *[c.alias(n) for n, c in filled.items()])
    long = counted.unpivot([*keys, "row_count"], list(filled), "component", "filled_rows")
    is_mapped = F.col("component").isin([m.upper() for m in mapped]) if mapped else F.lit(False)
    return long.withColumn("mapped", is_mapped).where(F.col("mapped") | (F.col("filled_rows") > 0))


def simulate_formula(lines: DataFrame, formula: fx.Formula, keys: list[str] = SCOPE) -> DataFrame:
    """Lines, total and mean impact of a draft formula."""
    key = "staff_key" if formula.rubric.endswith("_ID") else "name_key"
    first = None
    if formula.mode in fx.Mode.RANKED:
        lines, first = flag_first(lines, [key, *SCOPE]), "first_line"
    valued = fx.with_value(lines.withColumn("formula_id", F.lit(formula.formula_id)), [formula], "impact", first=first)
    summed = valued.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), total(F.col("impact")).alias("impact"))
    # The mean of the exact total does not depend on the order of the lines.
    return summed.withColumn("mean_impact", F.round(F.col("impact").cast("double") / F.col("row_count"), 6))


def usage(lines: DataFrame, results: DataFrame, line_id: str, keys: list[str]) -> DataFrame:
    """Runs whose results refer to the lines, per import or scope."""
    used = results.where(F.col(line_id).isNotNull()).select(line_id, "run_id").distinct()
    return lines.select(*keys, line_id).join(used, line_id).groupBy(*keys).agg(
        F.count_distinct("run_id").alias("runs")
    )


def declaration_imports(journal: DataFrame, declared: DataFrame, results: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Imports of declarations that are not withdrawn, with their lines and their use by analyses."""
    on = ["execution_id", *SCOPE]
    imports = journal.where("operation = 'IMPORT_DECLARED' and status <> 'DELETED'").select(*on, "source_file", "finished_on")
    counted = declared.groupBy(*on).agg(F.count(F.lit(1)).alias("row_count"))
    matching = usage(declared, results, "declared_id", on).withColumnRenamed("runs", "matching_runs")
    campaign_uses = campaigns.groupBy(*on).agg(F.count(F.lit(1)).alias("campaigns"))
    joined = imports.join(counted, on, "left").join(matching, on, "left").join(campaign_uses, on, "left")
    return joined.fillna(0, ["row_count", "matching_runs", "campaigns"])


