"""Regime against regime: who is paid on both sides, on one side only, and with which differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from paywarden.functions.filters import in_scope
from paywarden.functions.money import total
from paywarden.functions.text import full_name, has_name, usable_id
from paywarden.schema import MONEY_SUM, PERIOD

#: Smallest difference that counts when no threshold is set.
ANY_GAP = 1e-9

ADMIN_FIELDS = ["grade", "category", "unit", "province"]

SAME_NAME_MESSAGE = "Same name found with another identifier in the other regime"


class Gap:
    ONLY_B = "ONLY_B"
    ONLY_A = "ONLY_A"
    ID_NAME_CONFLICT = "ID_NAME_CONFLICT"
    MULTIPLE_PAYMENT = "MULTIPLE_PAYMENT"
    FINANCIAL_AND_ADMIN_GAP = "FINANCIAL_AND_ADMIN_GAP"
    FINANCIAL_GAP = "FINANCIAL_GAP"
    ADMIN_GAP = "ADMIN_GAP"
    IDENTICAL = "IDENTICAL"
    #: Not a status: everyone paid on both sides.
    PAID_TWICE = "PAID_TWICE"


@dataclass(frozen=True)
class Side:
    """One side of the comparison. Without an institution, each institution is compared with itself."""

    regime: str
    institution_id: str | None = None


@dataclass(frozen=True)
class Thresholds:
    """Gaps that count. When one is set the other is ignored; when none is set, any real gap counts."""

    amount: float = 0
    percent: float = 0

    def financial(self, gross_gap: Column, net_gap: Column, percent: Column) -> Column:
        if self.amount <= 0 and self.percent <= 0:
            return (F.abs(gross_gap) > ANY_GAP) | (F.abs(net_gap) > ANY_GAP)
        tests = []
        if self.amount > 0:
            limit = F.lit(str(self.amount)).cast(MONEY_SUM)
            tests += [F.abs(gross_gap) >= limit, F.abs(net_gap) >= limit]
        if self.percent > 0:
            tests.append(percent >= F.lit(float(self.percent)))
        found = tests[0]
        for test in tests[1:]:
            found = found | test
        return found


def match_key() -> Column:
    """Identifier if usable, else name."""
    staff, name = F.coalesce("staff_key", F.lit("")), F.coalesce("name_key", F.lit(""))
    return F.when(usable_id(F.col("staff_key")), F.concat(F.lit("M:"), staff)).otherwise(F.concat(F.lit("N:"), name))


PROFILE = {
    "raw_id": lambda: F.col("raw_id"),
    "staff_key": lambda: F.col("staff_key"),
    "full_name": lambda: full_name(F.col("last_name"), F.col("first_name")),
    "name_key": lambda: F.col("name_key"),
    **{name: (lambda n=name: F.coalesce(F.col(n), F.lit(""))) for name in ADMIN_FIELDS},
}


def comparable(lines: DataFrame) -> DataFrame:
    """Lines that have an identifier or a name."""
    return lines.where(usable_id(F.col("staff_key")) | has_name(F.col("name_key"))).withColumn("match_key", match_key())


def person_profile(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Description, number of payments and amounts per person."""
    return (
        comparable(lines)
        .groupBy("match_key", *keys)
        .agg(
            *[F.min(value()).alias(name) for name, value in PROFILE.items()],
            F.count(F.lit(1)).alias("payments"),
            total(F.col("gross_pay")).alias("gross"),
            total(F.col("net_pay")).alias("net"),
        )
    )


def check_sides(lines: DataFrame, a: Side, b: Side) -> None:
    """Refuse a comparison with itself or with an empty side."""
    if a == b:
        raise ValueError("Choose two different scopes.")
    for name, side in (("A", a), ("B", b)):
        if lines.where(in_scope(side.institution_id, side.regime)).isEmpty():
            raise ValueError(f"There are no pay lines for side {name}.")


def side_of(a: Side, b: Side) -> Column:
    return F.when(in_scope(a.institution_id, a.regime), "A").when(in_scope(b.institution_id, b.regime), "B")


def both_sides(lines: DataFrame, a: Side, b: Side, keys: list[str]) -> DataFrame:
    """Both profiles of each person on one row.

    Conditional aggregates in a single pass stand for the full outer join of two
    profiles: the lines are read once and move once.
    """
    sided = comparable(lines).withColumn("side", side_of(a, b)).where("side is not null")
    columns = []
    for side in ("A", "B"):
        here, suffix = F.col("side") == side, side.lower()
        columns += [F.min(F.when(here, value())).alias(f"{name}_{suffix}") for name, value in PROFILE.items()]
        columns += [
            F.count(F.when(here, 1)).alias(f"payments_{suffix}"),
            total(F.when(here, F.col("gross_pay"))).alias(f"gross_{suffix}"),
            total(F.when(here, F.col("net_pay"))).alias(f"net_{suffix}"),
        ]
    return sided.groupBy("match_key", *keys).agg(*columns)


def full_outer(profiles_a: DataFrame, profiles_b: DataFrame, keys: list[str]) -> DataFrame:
    """The same by a full outer join of two profiles, for sides that are separate tables."""
    on = ["match_key", *keys]
    left = profiles_a.select(*on, *[F.col(c).alias(f"{c}_a") for c in profiles_a.columns if c not in on])
    right = profiles_b.select(*on, *[F.col(c).alias(f"{c}_b") for c in profiles_b.columns if c not in on])
    joined = left.join(right, on, "full_outer")
    zero = F.lit(0).cast(MONEY_SUM)
    for side in ("a", "b"):
        joined = joined.withColumns(
            {
                f"payments_{side}": F.coalesce(f"payments_{side}", F.lit(0)),
                f"gross_{side}": F.coalesce(f"gross_{side}", zero),
                f"net_{side}": F.coalesce(f"net_{side}", zero),
            }
        )
    return joined


def with_gaps(pairs: DataFrame) -> DataFrame:
    a, b = F.col("gross_a").cast("double"), F.col("gross_b").cast("double")
    return pairs.withColumns(
        {
            "key_type": F.when(F.col("match_key").startswith("M:"), "ID").otherwise("NAME"),
            "gross_gap": (F.col("gross_a") - F.col("gross_b")).cast(MONEY_SUM),
            "net_gap": (F.col("net_a") - F.col("net_b")).cast(MONEY_SUM),
            "gap_percent": F.lit(100.0) * F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)),
            "paid_twice": (F.col("payments_a") > 0) & (F.col("payments_b") > 0),
        }
    )


def names_differ() -> Column:
    a, b = F.col("name_key_a"), F.col("name_key_b")
    return F.coalesce((F.col("key_type") == "ID") & has_name(a) & has_name(b) & (a != b), F.lit(False))


def with_status(pairs: DataFrame, thresholds: Thresholds) -> DataFrame:
    both = F.col("paid_twice")
    differs = [F.coalesce(f"{n}_a", F.lit("")) != F.coalesce(f"{n}_b", F.lit("")) for n in ADMIN_FIELDS]
    flagged = pairs.withColumns(
        {
            "financial_gap": both & thresholds.financial(F.col("gross_gap"), F.col("net_gap"), F.col("gap_percent")),
            "admin_gap": both & (differs[0] | differs[1] | differs[2] | differs[3]),
            "conflict": names_differ(),
        }
    )
    several_a, several_b = F.col("payments_a") > 1, F.col("payments_b") > 1
    status = (
        F.when(F.col("payments_a") == 0, Gap.ONLY_B)
        .when(F.col("payments_b") == 0, Gap.ONLY_A)
        .when(F.col("conflict"), Gap.ID_NAME_CONFLICT)
        .when(several_a | several_b, Gap.MULTIPLE_PAYMENT)
        .when(F.col("financial_gap") & F.col("admin_gap"), Gap.FINANCIAL_AND_ADMIN_GAP)
        .when(F.col("financial_gap"), Gap.FINANCIAL_GAP)
        .when(F.col("admin_gap"), Gap.ADMIN_GAP)
        .otherwise(Gap.IDENTICAL)
    )
    messages = [
        (several_a, "Several payments in regime A"),
        (several_b, "Several payments in regime B"),
        (F.col("financial_gap"), "Financial gap above the threshold"),
        (F.col("admin_gap"), "Administrative data differ"),
        (F.col("conflict"), "One identifier, different names"),
        (F.col("paid_twice"), "Paid in both regimes"),
    ]
    diagnosis = F.concat_ws(" ; ", *[F.when(test, text) for test, text in messages])
    return flagged.withColumns({"status": status, "diagnosis": diagnosis}).drop("conflict")


def own_name() -> Column:
    """Name of a result row: that of side A where there is one."""
    return F.coalesce(F.when(F.col("payments_a") > 0, F.col("name_key_a")).otherwise(F.col("name_key_b")), F.lit(""))


def same_name_other_id(results: DataFrame, keys: list[str]) -> DataFrame:
    """One-sided rows whose name occurs in another row paid on the other side.

    A set of names with the sides they are paid on is enough: the row itself is
    one-sided, so it never contributes its own name to the other side.
    """
    named = results.withColumn("name", own_name()).where("name <> ''")
    seen = named.groupBy("name", *keys).agg(
        F.max(F.col("payments_a") > 0).alias("seen_a"), F.max(F.col("payments_b") > 0).alias("seen_b")
    )
    one_sided = named.where(F.col("status").isin(Gap.ONLY_A, Gap.ONLY_B))
    other_side = F.when(F.col("status") == Gap.ONLY_A, F.col("seen_b")).otherwise(F.col("seen_a"))
    return one_sided.join(seen, ["name", *keys]).where(other_side).drop("name", "seen_a", "seen_b")


def with_same_name_note(results: DataFrame, keys: list[str]) -> DataFrame:
    on = ["match_key", *keys]
    noted = same_name_other_id(results, keys).select(*on, F.lit(SAME_NAME_MESSAGE).alias("note"))
    diagnosis = F.concat_ws(" ; ", F.nullif("diagnosis", F.lit("")), "note")
    return results.join(noted, on, "left").withColumn("diagnosis", diagnosis).drop("note")


def compare_regimes(lines: DataFrame, a: Side, b: Side, thresholds: Thresholds = Thresholds(),
                    keys: list[str] | None = None) -> DataFrame:
    """All persons of both sides, per period and, if the sides name none, per institution."""
    if a == b:
        raise ValueError("Choose two different scopes.")
    if keys is None:
        named = a.institution_id or b.institution_id
        keys = list(PERIOD) if named else ["institution_id", *PERIOD]
    results = with_status(with_gaps(both_sides(lines, a, b, keys)), thresholds)
    return with_same_name_note(results, keys)


def compare_summary(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    paid_a, paid_b = F.col("payments_a") > 0, F.col("payments_b") > 0
    return results.groupBy(*keys).agg(
        F.count_if(paid_a & paid_b).alias("common"),
        F.count_if(paid_a & ~paid_b).alias("only_a"),
        F.count_if(paid_b & ~paid_a).alias("only_b"),
        F.count_if("paid_twice").alias("paid_twice"),
        F.count_if("financial_gap").alias("financial"),
        F.count_if("admin_gap").alias("administrative"),
        total(F.col("gross_a")).alias("mass_a"),
        total(F.col("gross_b")).alias("mass_b"),
    )


def filter_results(results: DataFrame, status: str = "") -> DataFrame:
    if not status:
        return results
    return results.where("paid_twice" if status == Gap.PAID_TWICE else F.col("status") == status)


def result_order() -> list[Column]:
    """Differences first, large gaps first, then by name and key."""
    return [
        F.when(F.col("status") == Gap.IDENTICAL, 1).otherwise(0).asc(),
        F.abs("gross_gap").desc_nulls_last(),
        F.col("full_name_a").asc_nulls_last(),
        F.col("full_name_b").asc_nulls_last(),
        F.col("match_key").asc_nulls_last(),
    ]


def top_gaps(results: DataFrame, limit: int = 2000, status: str = "") -> DataFrame:
    """The first results in their order, 10 000 at most."""
    ties = [F.col(c).asc_nulls_last() for c in ("institution_id", *PERIOD) if c in results.columns]
    return filter_results(results, status).orderBy(*result_order(), *ties).limit(int(limit))
