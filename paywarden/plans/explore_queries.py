"""Queries of the exploration helpers, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paywarden.operators import explore as xp, ranking as rk
from paywarden.plans.registry import query
from paywarden.plans.views import Views

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def orders(v: Views):
    return v.table("orders")



# --- selection and filters -----------------------------------------------------------


@query("t_select", "SELECT * FROM events", raw=True)
def t_select(v):
    return v.table("events")


@query("t_project", "SELECT c_custkey, c_name, c_mktsegment FROM customer", raw=True)
def t_project(v):
    return v.table("customer").select("c_custkey", "c_name", "c_mktsegment")


@query("t_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY 1, 2", raw=True)
def t_distinct(v):
    return orders(v).select("o_orderstatus", "o_orderpriority").distinct().orderBy("o_orderstatus", "o_orderpriority")


@query("t_eq", f"SELECT {ORDERS} FROM orders WHERE o_orderstatus = 'P'", raw=True)
def t_eq(v):
    return orders(v).where(F.col("o_orderstatus") == "P").selectExpr(*ORDERS.split(", "))


@query("t_and", f"SELECT {ORDERS} FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000", raw=True)
def t_and(v):
    return orders(v).where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)).selectExpr(*ORDERS.split(", "))


@query("t_or", f"SELECT {ORDERS} FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 20000", raw=True)
def t_or(v):
    return orders(v).where((F.col("o_orderstatus") == "P") | (F.col("o_totalprice") < 20000)).selectExpr(*ORDERS.split(", "))


@query("t_between", f"SELECT {ORDERS} FROM orders WHERE o_totalprice BETWEEN 50000 AND 90000", raw=True)
def t_between(v):
    return orders(v).where(F.col("o_totalprice").between(50000, 90000)).selectExpr(*ORDERS.split(", "))


@query("t_in", f"SELECT {ORDERS} FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')", raw=True)
def t_in(v):
    return orders(v).where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).selectExpr(*ORDERS.split(", "))


@query("t_ilike", "SELECT doc_id, lang FROM documents WHERE cast(text AS varchar) ILIKE '%data%'", raw=True)
def t_ilike(v):
    return v.table("documents").where(xp.text("text").ilike("%data%")).select("doc_id", "lang")


@query("t_null", """
SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL""", raw=True)
def t_null(v):
    rows = v.table("documents").join(v.table("labels"), "doc_id", "left")
    return rows.where(F.col("quality").isNull()).select("doc_id", "lang")


@query("t_sort", f"SELECT {ORDERS} FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey", raw=True)
def t_sort(v):
    return orders(v).orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").selectExpr(*ORDERS.split(", "))


@query("t_top", f"SELECT {ORDERS} FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100", raw=True)
def t_top(v):
    return xp.top(orders(v), "o_totalprice", ["o_orderkey"]).selectExpr(*ORDERS.split(", "))


@query("page", f"SELECT {ORDERS} FROM orders ORDER BY o_custkey, o_orderkey LIMIT 200 OFFSET 700", raw=True)
def page(v):
    return xp.page(orders(v), ["o_custkey", "o_orderkey"], 200, 700).selectExpr(*ORDERS.split(", "))


@query("page_deep", f"""
SELECT {ORDERS} FROM orders ORDER BY o_custkey, o_orderkey LIMIT 200 OFFSET (SELECT 4 * count(*) // 5 FROM orders)""", raw=True)
def page_deep(v):
    """A page far down the table, by the index of its ranges."""
    index = xp.page_index(orders(v), ["o_custkey", "o_orderkey"])
    return index.page(200, 4 * orders(v).count() // 5).selectExpr(*ORDERS.split(", "))


@query("limited_query", """
SELECT o_orderkey, (SELECT count(*) FROM orders) > 1000 AS truncated FROM orders ORDER BY o_orderkey LIMIT 1000""", raw=True)
def limited_query(v):
    """The rows to show and whether there are more: one row more than the limit is looked at."""
    limit = 1000
    more = orders(v).limit(limit + 1).agg(F.count(F.lit(1))).scalar() > limit
    return orders(v).orderBy("o_orderkey").limit(limit).select("o_orderkey", more.alias("truncated"))


@query("set_ops", """
(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL (SELECT o_custkey FROM orders EXCEPT SELECT c_nationkey FROM customer)""", raw=True)
def set_ops(v):
    buyers = v.table("customer").select(F.col("c_nationkey").cast("long").alias("k"))
    sellers = v.table("supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    known = v.table("customer").select(F.col("c_nationkey").cast("long").alias("k"))
    either, both = buyers.union(sellers).distinct(), buyers.intersect(sellers)
    return either.union(both).union(orders(v).select(F.col("o_custkey").alias("k")).distinct().subtract(known))


# --- aggregates ----------------------------------------------------------------------


@query("t_count", "SELECT count(*) AS row_count FROM lineitem", raw=True)
def t_count(v):
    return xp.group_counts(v.table("lineitem"), [])


@query("t_count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem", raw=True)
def t_count_distinct(v):
    """Distinct values are counted by two aggregations, so that no task sees them all."""
    rows = v.table("lineitem")
    count = lambda c: rows.select(c).distinct().agg(F.count(c)).scalar()
    return v.spark.range(1).select(count("l_partkey").alias("parts"), count("l_suppkey").alias("suppliers"))


CENTS = "cast(round({0} * 100) AS bigint)"


@query("t_stats", f"""
SELECT sum({CENTS.format('l_extendedprice')}) AS total, round(avg(cast({CENTS.format('l_extendedprice')} AS double)), 6) AS mean,
  min({CENTS.format('l_extendedprice')}) AS minimum, max({CENTS.format('l_extendedprice')}) AS maximum
FROM lineitem""".replace("sum(", "cast(sum(", 1).replace(") AS total", ") AS bigint) AS total"), raw=True)
def t_stats(v):
    cents = v.table("lineitem").select(F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("cents"))
    return xp.stats(cents, "cents").withColumn("mean", F.round("mean", 6))


@query("t_group", """
SELECT l_returnflag, count(*) AS row_count, cast(sum(cast(round(l_quantity) AS bigint)) AS bigint) AS total
FROM lineitem GROUP BY l_returnflag ORDER BY total DESC""", raw=True)
def t_group(v):
    rows = v.table("lineitem").withColumn("quantity", F.expr("cast(round(l_quantity) as bigint)"))
    return xp.group_counts(rows, ["l_returnflag"], "quantity").orderBy(F.col("total").desc())


@query("t_having", """
SELECT l_orderkey, count(*) AS row_count FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5""", raw=True)
def t_having(v):
    return xp.group_counts(v.table("lineitem"), ["l_orderkey"], at_least=5)


@query("t_frequencies", """
SELECT user_id, count(*) AS row_count FROM events GROUP BY user_id ORDER BY row_count DESC, user_id LIMIT 100""", raw=True)
def t_frequencies(v):
    return xp.frequencies(v.table("events"), "user_id")


@query("t_null_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS nulls,
  count(*) FILTER (trim(cast({c} AS varchar)) = '') AS blanks FROM pages""" for c in ("page_id", "url", "html")), raw=True)
def t_null_profile(v):
    rows = v.table("pages").select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return xp.null_profile(rows, ["page_id", "url", "html"])


@query("t_numeric_profile", """
SELECT count(c) AS n, min(c) AS minimum, max(c) AS maximum, round(avg(c), 4) AS mean, median(c) AS median,
  round(stddev_samp(c), 4) AS deviation FROM (SELECT cast(l_extendedprice AS double) AS c FROM lineitem)""", raw=True)
def t_numeric_profile(v):
    profile = xp.numeric_profile(v.table("lineitem"), "l_extendedprice")
    return profile.withColumns({"mean": F.round("mean", 4), "deviation": F.round("deviation", 4)})


# --- joins ---------------------------------------------------------------------------

CUSTOMER_ORDER = "c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice"
OF_CUSTOMER = {"c_custkey": "o_custkey"}


def customer_orders(v: Views, how: str, extra=None):
    c, o = v.table("customer"), orders(v)
    extra = extra(o) if extra else None
    return xp.joined(c, o, OF_CUSTOMER, how, extra).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("t_inner", f"SELECT {CUSTOMER_ORDER} FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", raw=True)
def t_inner(v):
    return customer_orders(v, "inner")


@query("t_left", f"SELECT {CUSTOMER_ORDER} FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", raw=True)
def t_left(v):
    return customer_orders(v, "left")


@query("t_right", f"SELECT {CUSTOMER_ORDER} FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey", raw=True)
def t_right(v):
    return customer_orders(v, "right")


@query("t_full", """
SELECT c.c_custkey, s.s_suppkey, c.c_name, s.s_name FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey""", raw=True)
def t_full(v):
    rows = xp.joined(v.table("customer"), v.table("supplier"), {"c_custkey": "s_suppkey"}, "full_outer")
    return rows.select("c_custkey", "s_suppkey", "c_name", "s_name")


@query("t_multikey", """
SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey""", raw=True)
def t_multikey(v):
    keys = {"c_custkey": "s_suppkey", "c_nationkey": "s_nationkey"}
    return xp.joined(v.table("customer"), v.table("supplier"), keys).select("c_custkey", "s_suppkey")


@query("t_on_extra", f"""
SELECT {CUSTOMER_ORDER} FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'""", raw=True)
def t_on_extra(v):
    return customer_orders(v, "left", lambda o: o["o_orderstatus"] == "P")


@query("t_self", """
SELECT a.o_orderkey, a.o_custkey, count(*) AS partners
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY 1, 2""", raw=True)
def t_self(v):
    return xp.with_partners(orders(v).select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "o_custkey", "partners")


@query("t_join_agg", """
SELECT c.c_custkey, t.total_b FROM customer c LEFT JOIN (
  SELECT o_custkey, cast(sum(cast(o_totalprice AS decimal(18,2))) AS decimal(38,2)) AS total_b FROM orders GROUP BY o_custkey) t
  ON t.o_custkey = c.c_custkey""", raw=True)
def t_join_agg(v):
    priced = orders(v).select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    rows = xp.join_totals(v.table("customer"), priced, OF_CUSTOMER, "price")
    return rows.select("c_custkey", F.col("total_b").cast("decimal(38,2)").alias("total_b"))


@query("t_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", raw=True)
def t_semi(v):
    open_orders = orders(v).where("o_orderstatus = 'P'")
    return xp.joined(v.table("customer"), open_orders, OF_CUSTOMER, "left_semi").select("c_custkey")


@query("t_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", raw=True)
def t_anti(v):
    open_orders = orders(v).where("o_orderstatus = 'P'")
    return xp.joined(v.table("customer"), open_orders, OF_CUSTOMER, "left_anti").select("c_custkey")


@query("t_in_both", "SELECT c.c_custkey, c.c_name FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey", raw=True)
def t_in_both(v):
    return xp.joined(v.table("customer"), v.table("supplier"), {"c_custkey": "s_suppkey"}).select("c_custkey", "c_name")


@query("t_a_not_b", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", raw=True)
def t_a_not_b(v):
    return xp.joined(v.table("documents"), v.table("labels"), {"doc_id": "doc_id"}, "left_anti").select("doc_id")


@query("t_b_not_a", "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = s.s_suppkey)", raw=True)
def t_b_not_a(v):
    return xp.joined(v.table("supplier"), orders(v), {"s_suppkey": "o_custkey"}, "left_anti").select("s_suppkey")


@query("t_b_not_a_buyers", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", raw=True)
def t_b_not_a_buyers(v):
    """Customers who are not among the buyers of a large order."""
    large = orders(v).where("o_totalprice > 200000")
    return xp.joined(v.table("customer"), large, {"c_custkey": "o_custkey"}, "left_anti").select("c_custkey")


BALANCE = "cast({} AS decimal(18,2))"


@query("t_amount_gap", """
SELECT c_custkey, cast(c_acctbal AS decimal(18,2)) AS amount_a, cast(s_acctbal AS decimal(18,2)) AS amount_b,
  cast(coalesce(cast(c_acctbal AS decimal(18,2)), 0) - coalesce(cast(s_acctbal AS decimal(18,2)), 0) AS decimal(19,2)) AS gap
FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE coalesce(c_acctbal, 0) <> coalesce(s_acctbal, 0)
ORDER BY abs(gap) DESC, c_custkey""", raw=True)
def t_amount_gap(v):
    a = v.table("customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("amount_a"))
    b = v.table("supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(18,2)").alias("amount_b"))
    rows = xp.joined(a, b, {"c_custkey": "s_suppkey"})
    gap = xp.amount_gap(F.col("amount_a"), F.col("amount_b")).cast("decimal(19,2)")
    return rows.select("c_custkey", "amount_a", "amount_b", gap.alias("gap")).where("gap <> 0").orderBy(
        F.abs("gap").desc(), "c_custkey"
    )


@query("t_name_other_id", """
SELECT upper(trim(a.last_name)) AS name, a.raw_id AS person, count(DISTINCT a.line_id) AS row_count, b.other_rows
FROM pay a JOIN LATERAL (
  SELECT cast(sum(n) AS bigint) AS other_rows FROM (
    SELECT upper(trim(last_name)) AS name, raw_id, count(*) AS n FROM listing GROUP BY 1, 2) x
  WHERE x.name = upper(trim(a.last_name)) AND x.raw_id <> a.raw_id) b ON b.other_rows > 0
GROUP BY 1, 2, 4""")
def t_name_other_id(v):
    return xp.same_name_other_id(v.pay, v.listing, "last_name", "raw_id")


@query("ghost_agents", """
SELECT line_id, staff_key FROM pay p WHERE coalesce(trim(p.staff_key), '') <> ''
  AND NOT EXISTS (SELECT 1 FROM declared r WHERE r.year >= 2000 AND r.regime IN ('R1', 'R2') AND trim(r.staff_key) = trim(p.staff_key))""")
def ghost_agents(v):
    """Paid persons whom the late declarations of two regimes do not know by their identifier."""
    reference = v.declared.where("year >= 2000 and regime in ('R1', 'R2')")
    return xp.ghost_agents(v.pay, reference, "staff_key", "staff_key").select("line_id", "staff_key")


# --- subqueries and expressions ------------------------------------------------------


@query("t_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)", raw=True)
def t_in_subquery(v):
    large = orders(v).where("o_totalprice > 250000")
    return xp.joined(v.table("customer"), large, OF_CUSTOMER, "left_semi").select("c_custkey")


@query("t_from_subquery", "SELECT x.o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') x WHERE x.o_totalprice < 50000", raw=True)
def t_from_subquery(v):
    open_orders = orders(v).where("o_orderstatus = 'O'")
    return open_orders.where("o_totalprice < 50000").select("o_orderkey")


@query("t_scalar_subquery", """
SELECT s_suppkey, s_acctbal, (SELECT round(avg(s_acctbal), 6) FROM supplier) AS overall FROM supplier""", raw=True)
def t_scalar_subquery(v):
    overall = v.table("supplier").agg(F.round(F.avg("s_acctbal"), 6)).scalar()
    return v.table("supplier").select("s_suppkey", "s_acctbal", overall.alias("overall"))


@query("t_cte", "WITH base AS (SELECT * FROM events WHERE event_type = 'click') SELECT event_id, user_id FROM base WHERE value > 50", raw=True)
def t_cte(v):
    base = v.table("events").where("event_type = 'click'")
    return base.where("value > 50").select("event_id", "user_id")


@query("t_ctes", """
WITH a AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY user_id),
b AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT a.user_id, clicks, errors FROM a LEFT JOIN b ON a.user_id = b.user_id""", raw=True)
def t_ctes(v):
    """Two filtered counts of one table, from one scan."""
    kind = F.col("event_type")
    counts = v.table("events").where(kind.isin("click", "error")).groupBy("user_id").agg(
        F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "error").alias("errors")
    )
    return counts.where("clicks > 0").withColumn("errors", F.nullif("errors", F.lit(0)))


@query("t_case", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS class
FROM orders""", raw=True)
def t_case(v):
    price = F.col("o_totalprice")
    size = F.when(price > 300000, "large").when(price > 100000, "medium").otherwise("small")
    return orders(v).select("o_orderkey", size.alias("class"))


@query("t_coalesce", """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, nullif(d.lang, 'en') AS foreign_lang
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""", raw=True)
def t_coalesce(v):
    rows = v.table("documents").join(v.table("labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.nullif("lang", F.lit("en")).alias("foreign_lang"))


@query("t_cast", """
SELECT event_id, cast(user_id AS varchar) AS user_text, try_cast(props AS decimal(18,2)) AS not_a_number,
  try_cast(cast(value AS varchar) AS decimal(18,2)) AS amount FROM events""", raw=True)
def t_cast(v):
    return v.table("events").select(
        "event_id", xp.text("user_id").alias("user_text"), F.col("props").try_cast("decimal(18,2)").alias("not_a_number"),
        F.col("value").cast("string").try_cast("decimal(18,2)").alias("amount"),
    )


@query("t_text", """
SELECT c_custkey, trim(c_name) AS clean, upper(trim(c_name)) AS upper_name, lower(trim(c_name)) AS lower_name FROM customer""", raw=True)
def t_text(v):
    clean = F.trim("c_name")
    return v.table("customer").select(
        "c_custkey", clean.alias("clean"), F.upper(clean).alias("upper_name"), F.lower(clean).alias("lower_name")
    )


@query("t_gap_pct", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(CASE
  WHEN greatest(abs(coalesce(l_tax, 0)), abs(coalesce(l_discount, 0))) = 0 THEN 0
  ELSE 100.0 * abs(coalesce(l_tax, 0) - coalesce(l_discount, 0)) / greatest(abs(coalesce(l_tax, 0)), abs(coalesce(l_discount, 0)))
  END, 6) AS gap_percent FROM lineitem""", raw=True)
def t_gap_pct(v):
    gap = F.round(xp.gap_percent(F.col("l_tax"), F.col("l_discount")), 6)
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", gap.alias("gap_percent"))


# --- windows -------------------------------------------------------------------------


@query("t_row_number", """
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders""", raw=True)
def t_row_number(v):
    rows = orders(v).select("o_orderkey", "o_custkey")
    return rk.ranked(rows, ["o_custkey"], ["o_orderkey"], "place")


@query("t_rank", """
SELECT event_id, event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS rank,
  dense_rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS dense_rank FROM events""", raw=True)
def t_rank(v):
    rows = v.table("events").select("event_id", "event_type", "value")
    return rk.joined_on(rows, rk.ranked_values(rows, ["event_type"], "value"), ["event_type", "value"])


@query("t_sum_over", """
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_shipdate, cast(l_quantity AS bigint) AS quantity,
  cast(sum(cast(l_quantity AS bigint)) OVER w AS bigint) AS group_total, avg(cast(l_quantity AS double)) OVER w AS group_mean
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""", raw=True)
def t_sum_over(v):
    rows = v.table("lineitem").withColumn("quantity", F.col("l_quantity").cast("long"))
    return rk.with_group_totals(rows, ["l_returnflag"], "quantity").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate", "quantity", "group_total", "group_mean"
    )


@query("t_lag_lead", """
SELECT event_id, user_id, value, lag(value) OVER w AS previous, lead(value) OVER w AS next FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", raw=True)
def t_lag_lead(v):
    rows = v.table("events").select("event_id", "user_id", "value", "ts")
    return rk.neighbours(rows, ["user_id"], ["ts", "event_id"], "value").drop("ts")


# --- controls ------------------------------------------------------------------------


@query("t_dup_id", "SELECT raw_id, count(*) AS row_count FROM pay WHERE raw_id IS NOT NULL GROUP BY raw_id HAVING count(*) > 1")
def t_dup_id(v):
    return xp.group_counts(v.pay.where("raw_id is not null"), ["raw_id"], at_least=2)


@query("t_dup_name", """
SELECT upper(trim(last_name)) AS name, count(*) AS row_count FROM pay WHERE coalesce(trim(last_name), '') <> ''
GROUP BY 1 HAVING count(*) > 1""")
def t_dup_name(v):
    return xp.duplicates_by_name(v.pay, "last_name")


@query("t_missing_id", """
SELECT line_id, raw_id FROM pay WHERE raw_id IS NULL OR trim(raw_id) = '' OR upper(trim(raw_id)) IN ('NU', 'N.U')""")
def t_missing_id(v):
    return xp.missing_ids(v.pay, "raw_id").select("line_id", "raw_id")


@query("t_suspicious", """
SELECT doc_id, lang FROM documents WHERE upper(coalesce(text, '')) LIKE '%FICTIO%' OR upper(coalesce(source, '')) LIKE '%FICTIO%'
  OR upper(coalesce(lang, '')) IN ('FR', 'TEST')""", raw=True)
def t_suspicious(v):
    return xp.suspicious(v.table("documents"), ["text", "source"], "lang", "FICTIO", ["FR", "TEST"]).select("doc_id", "lang")


@query("t_non_positive", "SELECT line_id, gross_pay FROM pay WHERE coalesce(gross_pay, 0) <= 0")
def t_non_positive(v):
    return xp.non_positive(v.pay, "gross_pay").select("line_id", "gross_pay")


SAFE = """
SELECT n.n_name, count(*) AS suppliers, min(s.s_suppkey) AS first_supplier
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey  -- a comment; with a semicolon
GROUP BY n.n_name"""


@query("safe_sql", SAFE, raw=True)
def safe_sql(v):
    return xp.safe_sql(v.spark, SAFE + ";", {"supplier": v.table("supplier"), "nation": v.table("nation")})
