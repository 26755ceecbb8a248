"""Formulas as a table: which one is in force for a scope and rubric, by an as-of join.

Institutions may bring many thousands of formulas. A slot is an institution (or
all), a rubric (or all) and a regime (or all). The latest formula of every slot
for every period is found in one ordered pass over formulas and periods together;
a scope then looks up its eight slots by equality and takes the best one. Neither
plans nor generated code grow with the number of formulas.

Among the formulas in force the own institution's go first, then those for just
this rubric, then the latest start, the latest version, those for one regime, and
the smaller id. Without any the default formula holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paywarden.functions import formulas as fx
from paywarden.schema import MONEY, Mode, Rubric, SCOPE

SLOT = ["slot_institution", "slot_rubric", "slot_regime"]
TERMS = "array<struct<code:string,coefficient:decimal(12,4)>>"


def period_of(quarter: str = "quarter", year: str = "year") -> Column:
    return F.col(year) * 4 + F.substring(quarter, 2, 1).cast("int")


def default_formula() -> Column:
    """The default formula as a struct."""
    terms = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(k).cast("decimal(12,4)").alias("coefficient"))
                      for code, k in fx.DEFAULT_FORMULA.terms])
    return F.struct(F.lit(fx.DEFAULT_FORMULA.formula_id).alias("formula_id"), F.lit(fx.DEFAULT_FORMULA.mode).alias("mode"),
                    terms.cast(TERMS).alias("terms"))


def starts(formulas: DataFrame) -> DataFrame:
    """(slot, period, formula): the active formula that holds from a period on, one per slot and start."""
    rows = formulas.where("active").select(
        F.coalesce("institution_id", F.lit("")).alias(SLOT[0]), F.col("rubric").alias(SLOT[1]), F.coalesce("regime", F.lit("")).alias(SLOT[2]),
        period_of().alias("period"), "version", "formula_id", F.struct("formula_id", "mode", F.col("terms").cast(TERMS).alias("terms")).alias("formula"),
    )
    return rows.groupBy(*SLOT, "period").agg(
        F.max("version").alias("version"),
        F.min_by(F.struct("version", "formula"), F.struct(-F.col("version"), "formula_id")).alias("best"),
    ).select(*SLOT, "period", F.struct(F.col("period").alias("start"), "version", F.col("best.formula").alias("formula")).alias("held"))


def in_force(scopes: DataFrame, formulas: DataFrame, rubrics=Rubric.ALL) -> DataFrame:
    """(scope, rubric, formula_id, mode, terms) for each of the scopes."""
    wanted = F.explode(F.array(*[F.lit(r) for r in rubrics])).alias("rubric")
    asked = scopes.select(*SCOPE).distinct().select(*SCOPE, wanted).withColumn("period", period_of())
    slot = lambda own, exact, regime: F.struct(
        F.lit(own).alias("own"), F.lit(exact).alias("exact"), F.lit(regime).alias("one_regime"),
        (F.col("institution_id") if own else F.lit("")).alias(SLOT[0]), (F.col("rubric") if exact else F.lit(Rubric.ANY)).alias(SLOT[1]),
        (F.col("regime") if regime else F.lit("")).alias(SLOT[2]),
    )
    slots = F.array(*[slot(own, exact, regime) for own in (True, False) for exact in (True, False) for regime in (True, False)])
    looked_up = asked.select(*SCOPE, "rubric", "period", F.inline(slots))
    # As-of: at every period that a slot is asked for, the formula that started last.
    ask = looked_up.select(*SLOT, "period").distinct().withColumn("held", F.lit(None).cast(starts(formulas).schema["held"].dataType))
    along = Window.partitionBy(*SLOT).orderBy("period", F.col("held").isNull())
    known = starts(formulas).unionByName(ask)
    latest = known.withColumn("latest", F.last("held", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    answers = latest.where("held is null and latest is not null").select(*SLOT, "period", "latest")
    found = looked_up.join(answers, [*SLOT, "period"], "left")
    rank = F.when(F.col("latest").isNotNull(), F.struct(
        F.col("own"), F.col("exact"), F.col("latest.start"), F.col("latest.version"), F.col("one_regime")))
    best = found.groupBy(*SCOPE, "rubric").agg(F.max_by("latest.formula", rank).alias("formula"))
    return best.withColumn("formula", F.coalesce("formula", default_formula())).select(*SCOPE, "rubric", "formula.*")


def amount(terms: str = "terms") -> Column:
    """The full amount of a line by the list of terms in a column."""
    components = ", ".join(f"'{code}', coalesce({column}, 0)" for code, column in fx.BUILT_IN_COMPONENTS.items())
    value = f"coalesce(try_element_at(map({components}), t.code), try_element_at(extra_components, t.code), 0)"
    return F.expr(f"cast(aggregate({terms}, cast(0 as decimal(38,6)), (a, t) -> cast(a + t.coefficient * {value} as decimal(38,6))) as decimal(18,2))")


def valued(lines: DataFrame, book: DataFrame, rubric: Column, out: str, first: str | None = None) -> DataFrame:
    """Lines with formula id and amount under the formula of their scope for a rubric, which may differ by line.

    ``first`` names a boolean: the line is the first of its person. Without it every line has its full amount.
    """
    keyed = lines.withColumn("rubric_of_line", rubric)
    offered = book.withColumnsRenamed({"rubric": "rubric_of_line", "formula_id": f"{out}_formula_id", "mode": "book_mode", "terms": "book_terms"})
    rows = keyed.join(offered, ["rubric_of_line", *SCOPE], "left")
    default = {f"{out}_formula_id": "formula_id", "book_mode": "mode", "book_terms": "terms"}
    rows = rows.withColumns({name: F.coalesce(name, default_formula()[part]) for name, part in default.items()})
    mode, money = F.col("book_mode"), amount("book_terms")
    counts = mode != Mode.NO_IMPACT
    if first:
        counts = F.when(F.col(first), mode.isin(Mode.ALL_LINES, Mode.ONE_PER_PERSON)).otherwise(mode.isin(Mode.ALL_LINES, Mode.EXTRA_LINES))
    value = F.when(counts, money).otherwise(F.lit(0).cast(MONEY))
    return rows.withColumn(out, value).drop("rubric_of_line", "book_mode", "book_terms")
