"""Multi-regime campaign: declarations against all pay listings of their period.

Several payments and several declarations may share a key, so a join of lines
would give their product. Payments are therefore reduced first, per key and
paying source: number, mass, impact, and how many payments and regimes the key
has in all. A declaration then meets one row per source that paid it. The
result rows carry the number of payments they stand for; ``payment_lines``
expands them for a chosen declaration version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from paywarden.functions import formulas as fx
from paywarden.functions.filters import FilterRule, retained
from paywarden.functions.money import total
from paywarden.functions.text import full_name, has_name, spread_key, usable_id
from paywarden.operators.ranking import ranked
from paywarden.schema import LINE_ORDER, MONEY, MONEY_SUM, Mode, PERIOD, Rubric, SCOPE

#: Order of the payments of a declaration inside one source.
PAYMENT_ORDER = ["regime", "institution_id", "source_row", "line_id"]
SOURCE = ["institution_id", "regime", "execution_id"]


class Campaign:
    DECLARED_NOT_PAID = "DECLARED_NOT_PAID"
    PAID_IN_SEVERAL_REGIMES = "PAID_IN_SEVERAL_REGIMES"
    PAID_OTHER_INSTITUTION_AND_REGIME = "PAID_OTHER_INSTITUTION_AND_REGIME"
    PAID_OTHER_REGIME = "PAID_OTHER_REGIME"
    PAID_OTHER_INSTITUTION = "PAID_OTHER_INSTITUTION"
    MULTIPLE_IN_SCOPE = "MULTIPLE_IN_SCOPE"
    PAID_IN_SCOPE = "PAID_IN_SCOPE"


def analysis_base(lines: DataFrame, executions: list[str] | None = None, rules: list[FilterRule] = ()) -> DataFrame:
    """The lines of the chosen imports that the filters of their own scope keep, in one scan."""
    if executions is not None:
        if not executions:
            raise ValueError("Choose at least one pay source.")
        lines = lines.where(F.col("execution_id").isin(list(executions)))
    return lines.where(retained(list(rules)))


def ranked_payments(base: DataFrame, key: str, out: str = "payment_rank", **sizes) -> DataFrame:
    """Rank of each payment among those of its key in one source import.

    Every declaration of a key sees the same payments, so the rank of a payment
    does not depend on the declaration.
    """
    able = usable_id(F.col(key)) if key == "staff_key" else has_name(F.col(key))
    order = ["regime", "institution_id", *LINE_ORDER]
    return ranked(base.where(able), [key, "execution_id", *PERIOD], order, out, **sizes)


def paying_sources(base: DataFrame, key: str, formulas: list[fx.Formula] = (), detail: list[str] = ()) -> DataFrame:
    """Payments per key and paying source, with the figures of the whole key.

    The first payment of a key in an import is found among the first payments of
    its sources, so no line needs a rank. The windows run over these sums: at
    most one row per source of the period. With a detail (spellings, say) a key
    may have any number of rows, so its figures are summed once more and come
    back by a join that Spark can split.
    """
    formulas = list(formulas)
    able = usable_id(F.col(key)) if key == "staff_key" else has_name(F.col(key))
    valued = base.where(able).withColumn("formula_id", fx.resolve_id(formulas, Rubric.PAID_ELSEWHERE))
    valued = fx.with_value(valued, formulas, "value")
    head = F.min(F.struct(*PAYMENT_ORDER, "value")).alias("head")
    sums = valued.groupBy(key, *PERIOD, *SOURCE, *detail, "formula_id").agg(
        F.count(F.lit(1)).alias("payments"),
        total(F.col("gross_pay")).alias("mass"),
        total(F.col("value")).alias("value"),
        head,
    )
    if detail:
        sums = with_key_figures(sums, key)
    else:
        whole_key, of_import = Window.partitionBy(key, *PERIOD), Window.partitionBy(key, "execution_id", *PERIOD)
        sums = sums.withColumns({
            "first": F.min("head").over(of_import), "occurrences": F.sum("payments").over(whole_key),
            "regimes": F.size(F.collect_set("regime").over(whole_key)).cast("long"),
        })
    mode = fx.mode_of("formula_id", formulas)
    head_value = F.when(F.col("head") == F.col("first"), F.col("head.value")).otherwise(F.lit(0).cast(MONEY))
    outside = (
        F.when(mode == Mode.EXTRA_LINES, F.col("value") - head_value)
        .when(mode == Mode.ONE_PER_PERSON, head_value)
        .otherwise(F.col("value"))
        .cast(MONEY_SUM)
    )
    return sums.select(
        *PERIOD,
        key,
        F.col("institution_id").alias("paying_institution"),
        F.col("regime").alias("paying_regime"),
        F.col("execution_id").alias("paying_execution"),
        *detail,
        "formula_id",
        "payments",
        "mass",
        outside.alias("outside_impact"),
        "occurrences",
        "regimes",
    )


def with_key_figures(sums: DataFrame, key: str) -> DataFrame:
    """Sums with the first payment of their key in the import, and the payments and regimes of the whole key."""
    of_source = sums.groupBy(key, *PERIOD, *SOURCE).agg(F.min("head").alias("head"), F.sum("payments").alias("payments"))
    of_import = of_source.groupBy(key, *PERIOD, "execution_id").agg(F.min("head").alias("first"))
    whole = of_source.groupBy(key, *PERIOD).agg(
        F.sum("payments").alias("occurrences"), F.size(F.collect_set("regime")).cast("long").alias("regimes")
    )
    figures = of_import.join(whole, [key, *PERIOD])
    return sums.join(figures, [key, *PERIOD, "execution_id"])


def source_struct(base: DataFrame, key: str, formulas, detail, join_key: str, out: str) -> DataFrame:
    """The paying sources of a key, each as one value."""
    sources = paying_sources(base, key, formulas, detail)
    figures = [c for c in sources.columns if c not in (*PERIOD, key)]
    return sources.select(*PERIOD, F.col(key).alias(join_key), F.struct(*figures).alias(out))


def without_id_hit(declared: DataFrame, base: DataFrame) -> DataFrame:
    """Declarations whose identifier occurs nowhere in the base of their period."""
    staff = F.col("staff_key")
    keyed = declared.withColumn("id_join", spread_key(staff, usable_id(staff), F.col("declared_id")))
    paid = base.where(usable_id(staff)).select(*PERIOD, F.col("staff_key").alias("id_join")).distinct()
    return keyed.join(paid, ["id_join", *PERIOD], "left_anti").drop("id_join")


def id_matches(declared: DataFrame, base: DataFrame, formulas: list[fx.Formula] = (), detail: list[str] = ()) -> DataFrame:
    sources = paying_sources(base, "staff_key", formulas, detail)
    return declared.join(sources, ["staff_key", *PERIOD]).withColumn("method", F.lit("ID"))


def name_matches(declared: DataFrame, base: DataFrame, formulas: list[fx.Formula] = (), detail: list[str] = ()) -> DataFrame:
    sources = paying_sources(base, "name_key", formulas, detail)
    fallback = without_id_hit(declared, base)
    return fallback.join(sources, ["name_key", *PERIOD]).withColumn("method", F.lit("NAME"))


def unpaid(declared: DataFrame, base: DataFrame) -> DataFrame:
    """Declarations that neither identifier nor name finds in the base of their period."""
    name = F.col("name_key")
    rest = without_id_hit(declared, base).withColumn("name_join", spread_key(name, has_name(name), F.col("declared_id")))
    paid = base.where(has_name(name)).select(*PERIOD, name.alias("name_join")).distinct()
    return rest.join(paid, ["name_join", *PERIOD], "left_anti").drop("name_join")


def campaign_status() -> Column:
    """First true wins."""
    other_regime = F.col("paying_regime") != F.col("regime")
    other_institution = F.col("paying_institution") != F.col("institution_id")
    return (
        F.when(F.col("payments") == 0, Campaign.DECLARED_NOT_PAID)
        .when(F.col("regimes") > 1, Campaign.PAID_IN_SEVERAL_REGIMES)
        .when(other_regime & other_institution, Campaign.PAID_OTHER_INSTITUTION_AND_REGIME)
        .when(other_regime, Campaign.PAID_OTHER_REGIME)
        .when(other_institution, Campaign.PAID_OTHER_INSTITUTION)
        .when(F.col("occurrences") > 1, Campaign.MULTIPLE_IN_SCOPE)
        .otherwise(Campaign.PAID_IN_SCOPE)
    )


def campaign(declared: DataFrame, base: DataFrame, formulas: list[fx.Formula] = (), detail: list[str] = ()) -> DataFrame:
    """One row per declaration and paying source, and one per unpaid declaration.

    The declarations meet the sources found by identifier, then those without a
    hit meet the sources found by name; the others pass the second join under a
    key of their own. A payment inside the declared institution and regime has no
    impact; any other is valued by the formula of the institution and regime that
    paid.
    """
    carried = ["declared_id", *SCOPE, "staff_key", "name_key"]
    staff, name, line = F.col("staff_key"), F.col("name_key"), F.col("declared_id")
    keyed = declared.select(*carried, spread_key(staff, usable_id(staff), line).alias("id_join"))
    found = keyed.join(source_struct(base, "staff_key", formulas, detail, "id_join", "by_id"), ["id_join", *PERIOD], "left")
    falls_back = F.col("by_id").isNull() & has_name(name)
    found = found.withColumn("name_join", spread_key(name, falls_back, line)).drop("id_join")
    found = found.join(source_struct(base, "name_key", formulas, detail, "name_join", "by_name"), ["name_join", *PERIOD], "left")
    method = F.when(F.col("by_id").isNotNull(), "ID").when(F.col("by_name").isNotNull(), "NAME").otherwise("NONE")
    source = F.coalesce("by_id", "by_name")
    inside = (F.col("paying_regime") == F.col("regime")) & (F.col("paying_institution") == F.col("institution_id"))
    zero, none = F.lit(0).cast(MONEY_SUM), F.lit(0).cast("long")
    return (
        found.select(*carried, method.alias("method"), source.alias("source"))
        .select(
            *carried,
            "method",
            *[F.col(f"source.{c}") for c in ("paying_institution", "paying_regime", "paying_execution", *detail)],
            *[F.coalesce(f"source.{c}", none).alias(c) for c in ("payments", "occurrences", "regimes")],
            F.coalesce("source.mass", zero).alias("mass"),
            F.col("source.formula_id").alias("source_formula"),
            F.coalesce("source.outside_impact", zero).alias("outside_impact"),
        )
        .select(
            *carried, "method", "paying_institution", "paying_regime", "paying_execution", *detail,
            "payments", "occurrences", "regimes", "mass",
            F.when(inside, zero).otherwise(F.col("outside_impact")).alias("impact"),
            F.when(inside, fx.NO_FORMULA).otherwise(F.coalesce("source_formula", F.lit(fx.NO_FORMULA))).alias("formula_id"),
        )
        .withColumn("status", campaign_status())
    )


def row_count() -> Column:
    """Reported rows a result row stands for: its payments, or one if unpaid."""
    return F.sum(F.greatest("payments", F.lit(1)))


def campaign_counts(results: DataFrame) -> DataFrame:
    """Payments and regimes found for each declaration."""
    return results.groupBy("declared_id").agg(
        F.sum("payments").alias("occurrences"), F.size(F.collect_set("paying_regime")).cast("long").alias("regimes")
    )


def campaign_summary(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows, people, mass and impact per status."""
    people = F.countDistinct(
        F.coalesce(F.nullif("staff_key", F.lit("")), F.nullif("name_key", F.lit("")), F.col("declared_id"))
    )
    return results.groupBy(*keys, "status").agg(
        row_count().alias("row_count"), people.alias("people"), total(F.col("mass")).alias("mass"),
        total(F.col("impact")).alias("impact"),
    )


def unique_people(declared: DataFrame, base: DataFrame, institutions: DataFrame, formulas: list[fx.Formula] = ()) -> DataFrame:
    """One row per declaration and spelling of the paid name.

    Declarations without identifier are found by a name that many others of their scope may share. They meet the
    sources once per scope and name, and the figures of that, one row per spelling, come back to each of them.
    """
    named = base.withColumn("paid_name", full_name(F.col("last_name"), F.col("first_name")))
    carried = ["declared_id", *SCOPE, "staff_key", "name_key"]
    identified = usable_id(F.col("staff_key"))
    key, person = ["declared_id", "staff_key", "name_key"], [*SCOPE, "staff_key", "name_key"]
    shared = declared.where(~identified)
    people = shared.select(*person).distinct().withColumn("declared_id", F.to_json(F.struct(*person)))
    alike = spellings(campaign(people, named, formulas, detail=["paid_name"]), institutions, person)
    alike = alike.withColumnsRenamed({c: f"_{c}" for c in person})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in person])
    unnamed = shared.select(*carried).join(alike, same)
    by_name = unnamed.groupBy(*key, "full_name").agg(*merged(F.flatten(F.collect_list("regimes")), F.flatten(F.collect_list("institutions"))))
    results = campaign(declared.where(identified), named, formulas, detail=["paid_name"])
    by_id = spellings(results, institutions, key)
    listed = [F.concat_ws(", ", F.array_sort(c)).alias(c) for c in ("regimes", "institutions")]
    return by_id.unionByName(by_name).select(*key, "full_name", "status", *listed, "occurrences", "mass", "impact")


def spellings(results: DataFrame, institutions: DataFrame, keys: list[str]) -> DataFrame:
    """Status, paying regimes and institutions, payments and money per key and spelling of the paid name."""
    labelled = results.join(
        institutions.withColumnRenamed("institution_id", "paying_institution"), "paying_institution", "left"
    )
    not_paid = F.lit("NOT PAID")
    return labelled.groupBy(*keys, F.coalesce("paid_name", "name_key").alias("full_name")).agg(
        *merged(F.collect_set(F.coalesce("paying_regime", not_paid)), F.collect_set(F.coalesce("official_name", not_paid)))
    )


def merged(regimes: Column, institutions: Column) -> list[Column]:
    """The figures of a spelling, from rows or from figures of some of them; lists are sets."""
    return [
        F.max("status").alias("status"), F.array_distinct(regimes).alias("regimes"),
        F.array_distinct(institutions).alias("institutions"), F.max("occurrences").alias("occurrences"),
        total(F.col("mass")).alias("mass"), total(F.col("impact")).alias("impact"),
    ]


def payment_lines(declared: DataFrame, base: DataFrame) -> DataFrame:
    """Every pair of a declaration and a payment it matches.

    As large as the declarations times the payments of each key. For the list of
    one declaration version; the other functions work on sums.
    """
    kept = declared.select("declared_id", *PERIOD, "staff_key", "name_key")
    columns = ["line_id", F.col("institution_id").alias("paying_institution"),
               F.col("regime").alias("paying_regime"), F.col("execution_id").alias("paying_execution"), "gross_pay"]
    by_id = base.where(usable_id(F.col("staff_key"))).select(*PERIOD, "staff_key", *columns)
    by_name = base.where(has_name(F.col("name_key"))).select(*PERIOD, "name_key", *columns)
    found = kept.join(by_id, ["staff_key", *PERIOD]).withColumn("method", F.lit("ID"))
    fallback = without_id_hit(kept, base).join(by_name, ["name_key", *PERIOD]).withColumn("method", F.lit("NAME"))
    return found.unionByName(fallback)
