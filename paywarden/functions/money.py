"""Money expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from paywarden.schema import GROSS_PARTS, MONEY, MONEY_SUM


def parse_wide(value: Column) -> Column:
    """Text to an amount of up to 36 integer digits; null if it is no such number."""
    return F.trim(value.cast("string")).try_cast(MONEY_SUM)


def parse_money(value: Column) -> Column:
    """Text to money. What is not a number counts as nothing; a number that money cannot hold is an error."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    too_large = number.isNotNull() & ~F.isnan(number) & text.try_cast(MONEY).isNull()
    refused = F.raise_error(F.concat(F.lit("Amount out of range: "), text)).cast(MONEY)
    return F.when(too_large, refused).otherwise(F.coalesce(text.try_cast(MONEY), F.lit(0).cast(MONEY)))


def gross(parts: list[str] = GROSS_PARTS) -> Column:
    """Gross pay: the sum of the paid parts, without deductions and net pay."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0).cast(MONEY)) for p in parts]).cast(MONEY)


def total(value: Column) -> Column:
    """Sum of money, 0 where there is none."""
    return F.coalesce(F.sum(value), F.lit(0)).cast(MONEY_SUM)


def extra_components(columns: dict[str, Column]) -> Column:
    """Additional pay parts as a map from their code to the amount."""
    if not columns:
        return F.lit(None).cast("map<string,decimal(18,2)>")
    pairs = [part for code, value in sorted(columns.items()) for part in (F.lit(code.upper()), parse_money(value))]
    return F.create_map(*pairs)
