"""Counts worked out on two engines before the first line of this package."""

import pytest
from pyspark.sql import functions as F

from helpers import counts
from paywarden.operators import annexes as ax, campaign as cp, compare as cm, listing as ls, matching as mt
from paywarden.plans.views import Views

MONEY = "decimal(18,2)"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, "/root/testdata/sf0.01")


def test_rows(v):
    assert (v.pay.count(), v.declared.count(), v.listing.count()) == (15000, 10402, 11011)


def test_matching(v):
    rows = mt.classify(v.pay, v.declared).groupBy("status").agg(F.count("*").alias("n"), F.sum("base_pay").alias("s"))
    assert {r.status: (r.n, str(r.s)) for r in rows.collect()} == {
        "OK_BY_ID": (8030, "1573263423.07"), "OK_BY_NAME": (1022, "146523172.09"), "DUPLICATE_ID": (162, "36186019.66"),
        "MISSING_ID": (623, "78602157.51"), "PAID_NOT_DECLARED": (5163, "1011009262.58")}
    assert mt.declared_not_paid(v.pay, v.declared).count() == 1479


def test_campaign(v):
    rows = cp.campaign_summary(cp.campaign(v.declared, v.pay))
    assert {r.status: r.row_count for r in rows.collect()} == {
        "DECLARED_NOT_PAID": 36, "MULTIPLE_IN_SCOPE": 601, "PAID_OTHER_INSTITUTION": 340,
        "PAID_OTHER_INSTITUTION_AND_REGIME": 73, "PAID_OTHER_REGIME": 1073, "PAID_IN_SCOPE": 5940, "PAID_IN_SEVERAL_REGIMES": 6697}


def test_listing_group(v):
    assert counts(ls.listing_group(v.pay)) == {
        "DUPLICATE_ID": 245, "DUPLICATE_NAME": 3732, "UNUSABLE_ID": 1533, "SEVERAL_INSTITUTIONS": 507,
        "SEVERAL_REGIMES": 3467, "UNIQUE": 5516}


def test_comparison_on_base_pay(v):
    lines = v.pay.withColumn("gross_pay", F.col("base_pay")).withColumn("net_pay", F.lit(0).cast(MONEY))
    results = cm.compare_regimes(lines, cm.Side("R1"), cm.Side("R2"))
    assert counts(results) == {
        "IDENTICAL": 11, "ADMIN_GAP": 8, "FINANCIAL_GAP": 52, "FINANCIAL_AND_ADMIN_GAP": 11, "ID_NAME_CONFLICT": 4,
        "MULTIPLE_PAYMENT": 1, "ONLY_A": 2833, "ONLY_B": 2869}
    noted = results.where(F.col("diagnosis").contains(cm.SAME_NAME_MESSAGE))
    assert counts(noted)["ONLY_A"] == 95


def test_annexes_without_filters(v):
    declared, key = v.declared, "staff_key"
    assert ax.validation(v.pay).count() == 1890
    assert ax.duplicates(v.pay, key).count() == 323 and ax.shared_once(v.pay, key).count() == 161
    assert ax.duplicates(v.pay, "name_key").count() == 795
    assert ax.present(v.pay, declared, key).count() == 8074 and ax.undeclared(v.pay, declared, key).count() == 6705
    missing = ax.missing_id(v.pay).agg(F.count("*").alias("n"), F.sum("gross_pay").alias("s")).first()
    assert (missing.n, str(missing.s)) == (1533, "201513112.60")
    assert v.pay.where("gross_pay <= 0").count() == 221
