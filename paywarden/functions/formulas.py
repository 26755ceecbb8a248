"""Versioned impact formulas, compiled to Column expressions.

Formulas are configuration. In a fixed order of precedence, the formula of a
line is the first one whose rubric, institution, regime and starting period
fit: one CASE with a branch per formula. Its amount is another CASE with a
branch per distinct list of terms. There is no join, no shuffle and nothing to
broadcast, and the generated code does not grow with the product of formulas and
rubrics.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from paywarden.schema import GROSS_PARTS, MONEY_FIELDS, Mode, Rubric, SCOPE

BUILT_IN_COMPONENTS = {name.upper(): name for name in [*MONEY_FIELDS, "gross_pay"]}
COEFFICIENT = "decimal(12,4)"
QUARTERS = ("T1", "T2", "T3", "T4")


@dataclass(frozen=True)
class Formula:
    formula_id: str
    rubric: str = Rubric.ANY
    mode: str = Mode.ALL_LINES
    terms: tuple[tuple[str, float], ...] = ()
    institution_id: str | None = None
    regime: str | None = None
    quarter: str = "T1"
    year: int = 2020
    version: int = 1
    active: bool = True
    name: str = ""


DEFAULT_FORMULA = Formula("DEFAULT", terms=tuple((part.upper(), 1) for part in GROSS_PARTS), name="Default formula")
NO_FORMULA = "NO_IMPACT"


def period_number(quarter: str, year: int) -> int:
    return int(year) * 4 + int(quarter[1:])


def started_sql(quarter: str, year: int) -> str:
    """The period of a line is not before this one. Quarters compare as text, which keeps the test small."""
    if quarter == QUARTERS[0]:
        return f"year >= {int(year)}"
    return f"(year > {int(year)} or (year = {int(year)} and quarter >= {text_sql(quarter)}))"


def text_sql(value: str | None) -> str:
    """A string literal."""
    return "null" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def component_catalog(spark: SparkSession, extra: dict[str, str] | None = None) -> DataFrame:
    """Codes a formula may use: the money columns and the user's own components."""
    rows = [(code, column, True) for code, column in BUILT_IN_COMPONENTS.items()]
    rows += [(code.upper(), None, False) for code in (extra or {})]
    return spark.createDataFrame(rows, "code string, column string, built_in boolean")


def new_version(existing: list[Formula], formula: Formula, components=()) -> Formula:
    """Check a formula and give it the next version of its institution, regime and rubric."""
    if not formula.name.strip() or not (formula.regime or "").strip():
        raise ValueError("A formula needs a name and a regime.")
    if formula.rubric not in Rubric.ALL:
        raise ValueError(f"Unknown rubric {formula.rubric}.")
    if formula.mode not in Mode.ALL:
        raise ValueError(f"Unknown aggregation {formula.mode}.")
    if formula.quarter not in QUARTERS:
        raise ValueError(f"Unknown quarter {formula.quarter}.")
    known = {*BUILT_IN_COMPONENTS, *(code.upper() for code in components)}
    terms = []
    for code, coefficient in formula.terms:
        if code.upper() not in known:
            raise ValueError(f"Unknown component {code}.")
        if abs(coefficient) > 1000:
            raise ValueError("A coefficient lies between -1000 and 1000.")
        if coefficient:
            terms.append((code.upper(), coefficient))
    if formula.mode != Mode.NO_IMPACT and not terms:
        raise ValueError("A formula needs at least one component.")
    same = [
        f.version
        for f in existing
        if (f.institution_id or "", f.regime, f.rubric)
        == (formula.institution_id or "", formula.regime, formula.rubric)
    ]
    return replace(formula, terms=tuple(terms), version=max(same, default=0) + 1)


def applies_sql(formula: Formula) -> str:
    tests = []
    if formula.regime:
        tests.append(f"regime = {text_sql(formula.regime)}")
    if formula.institution_id:
        tests.append(f"institution_id = {text_sql(formula.institution_id)}")
    return " and ".join([*tests, started_sql(formula.quarter, formula.year)])


def precedence(formulas: list[Formula]) -> list[Formula]:
    """Active formulas, best first: own institution, exact rubric, latest start, latest version.

    Formulas for different rubrics exclude each other, so one order serves all rubrics.
    """
    return sorted(
        (f for f in formulas if f.active),
        key=lambda f: (bool(f.institution_id), f.rubric != Rubric.ANY, period_number(f.quarter, f.year), f.version),
        reverse=True,
    )


def case_sql(branches: list[tuple[str, str]], otherwise: str) -> str:
    if not branches:
        return otherwise
    return "case " + " ".join(f"when {test} then {value}" for test, value in branches) + f" else {otherwise} end"


def resolve_sql(formulas: list[Formula], rubric: str) -> str:
    able = [f for f in precedence(formulas) if f.rubric in (rubric, Rubric.ANY)]
    branches = [(applies_sql(f), text_sql(f.formula_id)) for f in able]
    return case_sql(branches, text_sql(DEFAULT_FORMULA.formula_id))


def resolve_id(formulas: list[Formula], rubric: str) -> Column:
    """Id of the formula that values a line under a rubric."""
    return F.expr(resolve_sql(formulas, rubric))


def resolve_by(formulas: list[Formula], rubric_column: str, rubrics, none: str | None = None) -> Column:
    """Formula id where the rubric itself is a column; ``none`` where that is none of the rubrics."""
    known = ", ".join(text_sql(r) for r in sorted(rubrics))
    branches = [(f"{rubric_column} is null or {rubric_column} not in ({known})", f"cast({text_sql(none)} as string)")]
    for formula in precedence(formulas):
        test = applies_sql(formula)
        if formula.rubric != Rubric.ANY:
            test = f"{rubric_column} = {text_sql(formula.rubric)} and {test}"
        branches.append((test, text_sql(formula.formula_id)))
    return F.expr(case_sql(branches, text_sql(DEFAULT_FORMULA.formula_id)))


def lookup_sql(values: list[str], number: str) -> str:
    """The value of a formula in an array with one constant per formula."""
    return f"get(array({', '.join(values)}), {number} - 1)"


def number_sql(formula_column: str, formulas: list[Formula]) -> str:
    ids = ", ".join(text_sql(f.formula_id) for f in [DEFAULT_FORMULA, *formulas])
    return f"cast(array_position(array({ids}), {formula_column}) as int)"


def term_sql(code: str, coefficient: float) -> str:
    column = BUILT_IN_COMPONENTS.get(code) or f"try_element_at(extra_components, {text_sql(code)})"
    value = f"coalesce({column}, 0)"
    # Adding money is quick; a product of decimals is not, so plain sums go without one.
    if coefficient in (1, -1):
        return value if coefficient == 1 else f"(- {value})"
    return f"cast({Decimal(str(coefficient))} as {COEFFICIENT}) * {value}"


def terms_sql(terms) -> str:
    return f"cast({' + '.join(term_sql(code, k) for code, k in terms) or '0'} as decimal(18,2))"


def counts_sql(modes: tuple[str, ...], book: list[Formula], number: str) -> str:
    return lookup_sql(["true" if f.mode in modes else "false" for f in book], number)


def with_value(
    rows: DataFrame, formulas: list[Formula], out: str, formula_column: str = "formula_id", first: str | None = None
) -> DataFrame:
    """Add the amount of each line under the formula whose id a column holds.

    ``first`` names a boolean: the line is the first of its person. Without it
    every line has its full amount, whatever the mode. The steps are projections
    of their own: the number of the formula, the number of its list of terms if
    the line counts, and one branch per list.
    """
    book = [DEFAULT_FORMULA, *formulas]
    sums = list(dict.fromkeys(f.terms for f in book))
    counts = counts_sql((Mode.ALL_LINES, *Mode.RANKED), book, "formula_number")
    if first:
        of_first = counts_sql((Mode.ALL_LINES, Mode.ONE_PER_PERSON), book, "formula_number")
        of_rest = counts_sql((Mode.ALL_LINES, Mode.EXTRA_LINES), book, "formula_number")
        counts = f"if({first}, {of_first}, {of_rest})"
    which = lookup_sql([str(sums.index(f.terms)) for f in book], "formula_number")
    amount = case_sql([(f"terms_number = {i}", terms_sql(t)) for i, t in enumerate(sums) if t], "cast(0 as decimal(18,2))")
    numbered = rows.select("*", F.expr(number_sql(formula_column, formulas)).alias("formula_number"))
    chosen = numbered.select("*", F.expr(f"if({counts}, {which}, null)").alias("terms_number"))
    return chosen.select(*[c for c in rows.columns if c != out], F.expr(amount).alias(out))


def mode_of(formula_column: str, formulas: list[Formula]) -> Column:
    modes = [text_sql(f.mode) for f in [DEFAULT_FORMULA, *formulas]]
    known = lookup_sql(modes, number_sql(formula_column, formulas))
    return F.expr(f"coalesce({known}, {text_sql(Mode.NO_IMPACT)})")


def any_ranked(formulas: list[Formula], rubrics) -> bool:
    """Whether some active formula for these rubrics needs the first line of a person."""
    return any(f.active and f.mode in Mode.RANKED and f.rubric in (*rubrics, Rubric.ANY) for f in formulas)


def selectable(formulas: list[Formula], institution: str, regime: str, quarter: str, year: int) -> list[Formula]:
    """Formulas that may be forced on a whole run: active, for every rubric, in force in the scope."""
    now = period_number(quarter, year)
    fitting = [
        f
        for f in formulas
        if f.active
        and f.rubric == Rubric.ANY
        and f.regime in (None, regime)
        and f.institution_id in (None, institution)
        and period_number(f.quarter, f.year) <= now
    ]
    return [DEFAULT_FORMULA, *fitting]


def forced(formulas: list[Formula], formula_id: str, institution: str, regime: str, quarter: str, year: int) -> Formula:
    for formula in selectable(formulas, institution, regime, quarter, year):
        if formula.formula_id == formula_id:
            return formula
    raise ValueError("The chosen formula is not in force for this institution, regime and period.")


def decimal_text(number: object) -> str:
    """All digits of a coefficient, without trailing zeros."""
    text = f"{Decimal(str(number)):f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def describe(formula: Formula) -> str:
    """The formula as text."""
    parts = [f"{decimal_text(coefficient)} × {code}" for code, coefficient in formula.terms]
    return " + ".join(parts) or "0"


FORMULA_ROW = T.StructType(
    [
        T.StructField("formula_id", T.StringType()),
        T.StructField("rubric", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField(
            "terms",
            T.ArrayType(
                T.StructType(
                    [T.StructField("code", T.StringType()), T.StructField("coefficient", T.DecimalType(12, 4))]
                )
            ),
        ),
        T.StructField("institution_id", T.StringType()),
        T.StructField("regime", T.StringType()),
        T.StructField("quarter", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("active", T.BooleanType()),
    ]
)


def formula_table(spark: SparkSession, formulas: list[Formula]) -> DataFrame:
    """The formulas as a small table."""
    rows = [
        (
            f.formula_id, f.rubric, f.mode, [(code, Decimal(str(c))) for code, c in f.terms],
            f.institution_id, f.regime, f.quarter, int(f.year), f.version, f.active,
        )
        for f in formulas
    ]
    return spark.createDataFrame(rows, FORMULA_ROW)


def resolve_table(lines: DataFrame, formulas: list[Formula], rubrics=Rubric.ALL) -> DataFrame:
    """Formula id of every scope present in the lines, for each rubric."""
    scopes = lines.select(*SCOPE).distinct()
    rubric = F.explode(F.array(*[F.lit(r) for r in rubrics])).alias("rubric")
    return scopes.select(*SCOPE, rubric).withColumn("formula_id", resolve_by(formulas, "rubric", rubrics))
