"""Column layout of the standard tables and the vocabulary of the results."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MONEY_SUM = T.DecimalType(38, 2)

PERIOD = ["quarter", "year"]
SCOPE = ["institution_id", "regime", *PERIOD]
# In the keys of joins and groups the person comes before the scope. Spark sorts by
# the first bytes of the first key, and few scopes differ in those.

#: Total order of the lines of a listing. Row numbers restart with every import,
#: so the import and the line id break ties.
LINE_ORDER = ["source_row", "execution_id", "line_id"]

GROSS_PARTS = ["base_pay", "transport", "bonus", "housing", "pension", "other_pay"]
MONEY_FIELDS = [*GROSS_PARTS, "deductions", "net_pay"]

PAY_LINE = T.StructType(
    [
        T.StructField("line_id", T.StringType()),
        T.StructField("execution_id", T.StringType()),
        T.StructField("institution_id", T.StringType()),
        T.StructField("regime", T.StringType()),
        T.StructField("quarter", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("source_table", T.StringType()),
        T.StructField("raw_id", T.StringType()),
        T.StructField("staff_key", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("name_key", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("grade", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("province", T.StringType()),
        *[T.StructField(name, MONEY) for name in MONEY_FIELDS],
        T.StructField("gross_pay", MONEY),
        T.StructField("extra_components", T.MapType(T.StringType(), MONEY)),
        T.StructField("source_row", T.LongType()),
    ]
)

DECLARED_LINE = T.StructType(
    [
        T.StructField("declared_id", T.StringType()),
        T.StructField("execution_id", T.StringType()),
        T.StructField("institution_id", T.StringType()),
        T.StructField("regime", T.StringType()),
        T.StructField("quarter", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_sheet", T.StringType()),
        T.StructField("raw_id", T.StringType()),
        T.StructField("staff_key", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("name_key", T.StringType()),
        T.StructField("grade", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField("declared_pay", MONEY),
        T.StructField("agent_status", T.StringType()),
        T.StructField("source_row", T.LongType()),
    ]
)

SCOPE_LAYOUT = T.StructType([PAY_LINE[name] for name in SCOPE])

# Normalised identifiers that stand for "no identifier".
UNUSABLE_KEYS = ["", "NU"]


class Rubric:
    """Rubrics an impact formula can be attached to."""

    ANY = "*"
    DUPLICATE_ID = "DUPLICATE_ID"
    DUPLICATE_NAME = "DUPLICATE_NAME"
    MISSING_ID = "MISSING_ID"
    PAID_NOT_DECLARED = "PAID_NOT_DECLARED"
    PAID_ELSEWHERE = "PAID_ELSEWHERE"
    OK_BY_ID = "OK_BY_ID"
    OK_BY_NAME = "OK_BY_NAME"
    ALL = (ANY, DUPLICATE_ID, DUPLICATE_NAME, MISSING_ID, PAID_NOT_DECLARED, PAID_ELSEWHERE, OK_BY_ID, OK_BY_NAME)


class Mode:
    """Which lines of a person count in a formula."""

    ALL_LINES = "ALL_LINES"
    EXTRA_LINES = "EXTRA_LINES"
    ONE_PER_PERSON = "ONE_PER_PERSON"
    NO_IMPACT = "NO_IMPACT"
    ALL = (ALL_LINES, EXTRA_LINES, ONE_PER_PERSON, NO_IMPACT)
    RANKED = (EXTRA_LINES, ONE_PER_PERSON)
