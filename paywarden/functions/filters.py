"""Business and exploration filters: configuration rows become one Column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from paywarden.schema import MONEY_FIELDS, PERIOD, SCOPE

TEXT_COLUMNS = [
    "source_table", "raw_id", "last_name", "first_name", "section", "category", "grade", "unit", "province",
]
NUMBER_COLUMNS = [*MONEY_FIELDS, "gross_pay"]
FILTER_COLUMNS = [*TEXT_COLUMNS, *NUMBER_COLUMNS]

COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


@dataclass(frozen=True)
class Condition:
    """One condition on a column of the listing."""

    column: str
    op: str
    value: str


@dataclass(frozen=True)
class FilterRule(Condition):
    """A condition that holds for one institution, for one regime or for all of them."""

    institution_id: str = ""
    regime: str | None = None


def number_literal(column: str, value: str) -> Column:
    text = str(value).replace(" ", "").replace(",", ".")
    try:
        float(text)
    except ValueError:
        raise ValueError(f"The filter on {column} needs a number, not {value!r}.") from None
    return F.lit(text).cast("decimal(38,6)")


def like_prefix(column: Column, value: str, anywhere: bool) -> Column:
    """Lower-cased LIKE. Percent and underscore in the value stay wildcards; a backslash is plain."""
    pattern = value.lower().replace("\\", "\\\\")
    return F.lower(column.cast("string")).like(f"%{pattern}%" if anywhere else f"{pattern}%")


def condition(rule: Condition) -> Column:
    if rule.column not in FILTER_COLUMNS:
        raise ValueError(f"Column {rule.column} cannot be filtered.")
    if not str(rule.value).strip():
        raise ValueError("A filter needs a value.")
    column, value = F.col(rule.column), str(rule.value).strip()
    if rule.op in COMPARE:
        literal = number_literal(rule.column, value) if rule.column in NUMBER_COLUMNS else F.lit(value)
        return COMPARE[rule.op](column, literal)
    if rule.op in ("contains", "prefix"):
        return like_prefix(column, value, rule.op == "contains")
    raise ValueError(f"Unknown filter operator {rule.op}.")


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def rule_predicate(rules: list[FilterRule], institution: str, regime: str | None = None) -> Column:
    """The conditions of one institution, with SQL's unknown for empty columns."""
    return all_of([condition(r) for r in rules if r.institution_id == institution and r.regime in (None, regime)])


def own_predicate(rules: list[FilterRule]) -> Column:
    """Whether a line passes the filters of its own scope; unknown where a filtered column is empty."""
    scopes = {}
    for rule in rules:
        scopes.setdefault((rule.institution_id, rule.regime), []).append(condition(rule))
    passes = F.lit(True)
    for (institution, regime), parts in scopes.items():
        here = F.col("institution_id") == institution
        if regime is not None:
            here &= F.col("regime") == regime
        passes &= F.when(here, all_of(parts)).otherwise(True)
    return passes


def retained(rules: list[FilterRule]) -> Column:
    """True for the lines that the filters of their own institution and regime keep."""
    return F.coalesce(own_predicate(rules), F.lit(False))


def in_scope(institution_id=None, regime=None, quarter=None, year=None) -> Column:
    """Any subset of the four scope columns."""
    wanted = dict(zip(SCOPE, (institution_id, regime, quarter, year)))
    return all_of([F.col(name) == value for name, value in wanted.items() if value not in (None, "")])


def in_period(quarter: str, year: int) -> Column:
    return (F.col(PERIOD[0]) == quarter) & (F.col(PERIOD[1]) == int(year))


def explore(column: str, op: str, value: str = "") -> Column:
    """Filter on any column of any table: text operators on its text form, comparisons as numbers."""
    text = F.col(column).cast("string")
    if op == "=":
        return text == str(value)
    if op == "!=":
        return text != str(value)
    if op == "contains":
        return text.ilike("%" + str(value).replace("\\", "\\\\") + "%")
    if op == "prefix":
        return text.ilike(str(value).replace("\\", "\\\\") + "%")
    if op == "empty":
        return F.col(column).isNull() | (text == "")
    if op == "not empty":
        return F.col(column).isNotNull() & (text != "")
    if op in COMPARE:
        return COMPARE[op](text.try_cast("double"), F.lit(str(value)).try_cast("double"))
    raise ValueError(f"Unknown operator {op}.")
