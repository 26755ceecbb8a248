"""Queries of reading, standardising, filtering, writing and withdrawing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from paywarden.functions import filters as fl, money as mn, text as tx
from paywarden.operators import explore as xp, matching as mt, summaries as sm
from paywarden.plans.controls import MATCHED, NAMES_SQL, USABLE
from paywarden.plans.registry import S, query, same_scope
from paywarden.plans.views import RULES, Views
from paywarden.schema import MONEY, SCOPE
from paywarden.session import scratch_path
from paywarden.sources import lifecycle as lc, mapping as mp, readers as rd, writers as wr
from paywarden.sources.commits import Tables

REGIMES = {f"R{n}": rf"Tab_R{n}_T[1-4]_\d{{4}}" for n in range(1, 6)}

# --- reading -------------------------------------------------------------------------


@query("scan_pay_raw", "SELECT line_id, raw_id, last_name, cast(base_pay AS varchar) AS base_pay FROM pay")
def scan_pay_raw(v):
    """The listing as CSV files, read back as text columns."""
    folder = scratch_path(v.spark, "pay_csv")
    wr.export_csv(v.raw_pay.select("line_id", "raw_id", "last_name", "base_pay"), folder)
    rows = rd.read_csv(v.spark, folder)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("line_id", blank("raw_id"), blank("last_name"), "base_pay")


@query("scan_declared_raw", "SELECT declared_id, staff_key, name_key, service FROM declared")
def scan_declared_raw(v):
    """Declarations as Parquet files, read back as text columns."""
    folder = scratch_path(v.spark, "declared")
    v.declared.select("declared_id", "staff_key", "name_key", "service").write.parquet(folder)
    return rd.read_parquet(v.spark, folder).drop(*rd.OWN_COLUMNS)


@query("source_row_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS source_row FROM orders", raw=True)
def source_row_number(v):
    rows = rd.read_parquet(v.spark, f"{v.folder}/orders.parquet")
    return rows.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "source_row")


@query("preview_rows", """
SELECT cast(o_orderkey AS varchar) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY orders.o_orderkey LIMIT 20""",
       raw=True)
def preview_rows(v):
    rows = rd.read_parquet(v.spark, f"{v.folder}/orders.parquet")
    return xp.preview(rows, ["source_row"], 20).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("detect_regime", r"""
SELECT source_table, CASE WHEN regexp_full_match(source_table, 'Tab_R[1-5]_T[1-4]_\d{4}')
  THEN 'R' || substr(source_table, 6, 1) END AS detected, count(*) AS row_count FROM pay GROUP BY 1, 2""")
def detect_regime(v):
    detected = rd.detect_regime(F.upper("source_table"), REGIMES).alias("detected")
    return v.pay.groupBy("source_table", detected).agg(F.count(F.lit(1)).alias("row_count"))


@query("detect_period", "SELECT line_id, quarter AS detected_quarter, year AS detected_year FROM pay")
def detect_period(v):
    name = F.lower("source_table")
    return v.pay.select(
        "line_id", rd.detect_quarter(name).alias("detected_quarter"), rd.detect_year(name).alias("detected_year")
    )


@query("raw_with_lineage", "SELECT line_id, raw_id, last_name, execution_id, quarter, year FROM pay")
def raw_with_lineage(v):
    """Raw rows written with import and period, one folder per period, and read back."""
    folder = scratch_path(v.spark, "raw")
    raw = v.raw_pay.select("line_id", "raw_id", "last_name", "execution_id", "quarter", "year")
    stamped = wr.with_lineage(raw, F.col("execution_id"), F.col("quarter"), F.col("year"))
    wr.write_raw(stamped, folder)
    return wr.read_raw(v.spark, folder).select(*raw.columns)


@query("append_by_name", """
SELECT line_id, grade, NULL AS service FROM pay UNION ALL SELECT declared_id, NULL, service FROM declared""")
def append_by_name(v):
    new = v.declared.select("service", F.col("declared_id").alias("line_id"))
    return wr.append_by_name(v.pay.select("line_id", "grade"), new)


@query("replace_scope", f"""
SELECT {S}, line_id, cast(CASE WHEN institution_id = 'IP' AND regime <> 'R5' THEN 2 * gross_pay ELSE gross_pay END AS decimal(18,2)) AS gross_pay
FROM pay WHERE NOT (institution_id = 'IP' AND regime = 'R5')""")
def replace_scope(v):
    """A table by scope in which one institution's scopes get new lines and those of one regime get none."""
    folder = scratch_path(v.spark, "pay_line")
    lines = v.pay.select(*SCOPE, "line_id", "gross_pay")
    wr.append_lines(lines, folder)
    mine = F.col("institution_id") == "IP"
    emptied = [r.asDict() for r in lines.where(mine & (F.col("regime") == "R5")).select(*SCOPE).distinct().collect()]
    new = lines.where(mine & (F.col("regime") != "R5")).withColumn("gross_pay", (F.col("gross_pay") * 2).cast(MONEY))
    wr.replace_scopes(new, folder, emptied)
    return wr.read_lines(v.spark, folder, lines.schema)


@query("import_journal", "SELECT 'IMPORT_PAY' AS operation, 'DONE' AS status, count(*) AS rows_loaded FROM pay")
def import_journal(v):
    """Journal entry of a load whose rows count themselves while they are written."""
    store = lc.Store(scratch_path(v.spark, "store"))
    lines, observed = wr.counted(v.pay.select(*SCOPE, "line_id", "gross_pay"), "pay_lines")
    lines.write.parquet(store.pay)
    rows = observed.get["rows"]
    lc.log(v.spark, store, execution_id="E", operation=lc.IMPORT_PAY, rows_read=rows, rows_loaded=rows, status="DONE")
    entries = wr.current_journal(wr.read_lines(v.spark, store.journal, wr.JOURNAL))
    return entries.select("operation", "status", "rows_loaded")


TABLES = """benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region
supplier""".split()


@query("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES), raw=True)
def table_row_counts(v):
    return xp.table_row_counts({t: v.table(t) for t in TABLES})


@query("sample_source", """
SELECT source_row, raw_id, last_name, first_name, category, grade, unit, province, gross_pay, net_pay
FROM listing WHERE execution_id = 'E3' ORDER BY listing.source_row LIMIT 50""")
def sample_source(v):
    return xp.sample_source(v.pay, "E3", RULES)


@query("export_csv", """
SELECT lang, count(*) AS row_count, min(md5(text)) AS least, max(md5(text)) AS most, cast(sum(length(text)) AS bigint) AS characters
FROM documents GROUP BY lang""", raw=True)
def export_csv(v):
    """Documents exported as CSV and read back: whole texts, line breaks included."""
    folder = scratch_path(v.spark, "documents_csv")
    wr.export_csv(v.table("documents"), folder, bom=True)
    digest = F.md5("text")
    return rd.read_csv(v.spark, folder, multi_line=True).groupBy("lang").agg(
        F.count(F.lit(1)).alias("row_count"), F.min(digest).alias("least"), F.max(digest).alias("most"),
        F.sum(F.length("text")).alias("characters"),
    )


@query("import_folder", """
SELECT count(*) AS lines, count(DISTINCT line_id) AS ids, count(DISTINCT staff_key) AS people FROM pay""")
def import_folder(v):
    """A listing that consists of many files, imported as one: every line keeps an id of its own."""
    folder = scratch_path(v.spark, "pay_files")
    wr.export_csv(v.raw_pay.select(F.col("raw_id").alias("Matricule"), F.col("last_name").alias("Noms")).repartition(5), folder)
    lines = mp.standardise_pay(rd.read_csv(v.spark, folder), {"execution_id": "E", "source_file": "pay_files"})
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("line_id").alias("ids"), F.count_distinct("staff_key").alias("people")
    )


# --- standardising -------------------------------------------------------------------


@query("normalize_identifier", "SELECT line_id, raw_id, staff_key FROM pay")
def normalize_identifier(v):
    return v.raw_pay.select("line_id", "raw_id", tx.normalise(F.col("raw_id")).alias("staff_key"))


@query("name_key", "SELECT line_id, last_name, name_key FROM pay")
def name_key(v):
    return v.raw_pay.select("line_id", "last_name", tx.normalise(F.concat("last_name", "first_name")).alias("name_key"))


@query("full_name", "SELECT line_id, trim(first_name || ' ' || last_name) AS full_name FROM pay")
def full_name(v):
    return v.pay.select("line_id", tx.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"))


@query("parse_money", """
SELECT event_id, coalesce(try_cast(cast(value AS varchar) AS decimal(18,2)), 0) AS amount,
  coalesce(try_cast(props AS decimal(18,2)), 0) AS not_a_number, coalesce(try_cast(event_type AS decimal(18,2)), 0) AS word,
  cast(try_cast('12345678901234567890' || cast(event_id AS varchar) || '.5' AS decimal(38,2)) AS varchar) AS wide
FROM events""", raw=True)
def parse_money(v):
    return v.table("events").select(
        "event_id", mn.parse_money(F.col("value").cast("string")).alias("amount"),
        mn.parse_money(F.col("props")).alias("not_a_number"), mn.parse_money(F.col("event_type")).alias("word"),
        mn.parse_wide(F.concat(F.lit("12345678901234567890"), F.col("event_id").cast("string"), F.lit(".5"))).cast("string").alias("wide"),
    )


@query("gross_pay", "SELECT line_id, gross_pay FROM pay")
def gross_pay(v):
    return v.pay.select("line_id", mn.gross().alias("gross_pay"))


@query("extra_components", """
SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS decimal(18,2)), 0) AS amount FROM events""", raw=True)
def extra_components(v):
    """An additional component by its code."""
    parts = F.from_json("props", "map<string,decimal(18,2)>")
    rows = v.table("events").select("event_id", mn.extra_components({"k": F.try_element_at(parts, F.lit("k"))}).alias("extra"))
    return rows.select("event_id", F.coalesce(F.try_element_at("extra", F.lit("K")), F.lit(0).cast(MONEY)).alias("amount"))


SOURCE_HEADERS = {
    "raw_id": "NumMatricule", "last_name": "Noms", "category": "Catégorie", "grade": "Grade", "unit": "UnitéAffectation",
    "province": "Province", "base_pay": "TraitementBase", "transport": "IndemniteTransport", "bonus": "PrimeTech",
    "deductions": "Retenues",
}


@query("standardize_pay", f"""
SELECT source_row, {S}, execution_id, source_table, raw_id, staff_key, last_name, name_key, category, grade, unit,
  base_pay, transport, deductions, cast(base_pay + transport AS decimal(18,2)) AS gross_pay, bonus AS technical
FROM pay""")
def standardize_pay(v):
    """Raw columns under foreign headers: aliases, an explicit mapping to an own component, text amounts."""
    renamed = [F.col(c).cast("string").alias(h) for c, h in SOURCE_HEADERS.items()]
    raw = v.raw_pay.select("source_row", "execution_id", *SCOPE, "source_table", *renamed)
    lines = mp.standardise_pay(raw, {}, {"PrimeTech": "component_TECHNICAL"})
    return lines.select(
        "source_row", *SCOPE, "execution_id", "source_table", "raw_id", "staff_key", "last_name", "name_key", "category",
        "grade", "unit", "base_pay", "transport", "deductions", "gross_pay",
        F.try_element_at("extra_components", F.lit("TECHNICAL")).alias("technical"),
    )


@query("standardize_declared", f"""
SELECT source_row, {S}, execution_id, staff_key, name_key, service, cast(source_row AS decimal(18,2)) AS declared_pay
FROM declared""")
def standardize_declared(v):
    raw = v.declared.select(
        "source_row", "execution_id", *SCOPE, F.col("staff_key").alias("Matricule"), F.col("name_key").alias("Noms"),
        F.col("service").alias("Service"), F.col("source_row").cast("string").alias("MontantDéclaré"),
    )
    lines = mp.standardise_declared(raw, {}, {"MontantDéclaré": "declared_pay"})
    return lines.select("source_row", *SCOPE, "execution_id", "staff_key", "name_key", "service", "declared_pay")


@query("declared_quality", f"""
SELECT {S}, count(*) AS row_count, count(*) FILTER ({USABLE}) AS usable_ids, count(*) FILTER (NOT {USABLE}) AS missing_ids,
  count(*) FILTER (name_key <> '') AS usable_names, count(*) FILTER (name_key = '') AS missing_names
FROM declared GROUP BY {S}""")
def declared_quality(v):
    return mp.declared_quality(v.declared, SCOPE)


CLEAN_SQL = r"regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]+', ' ', 'g')"


@query("sanitize_text", f"SELECT doc_id, length({CLEAN_SQL}) AS n, md5({CLEAN_SQL}) AS digest FROM documents", raw=True)
def sanitize_text(v):
    clean = tx.sanitise(F.col("text"))
    return v.table("documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("digest"))


# --- filters -------------------------------------------------------------------------

KEEP = "SELECT line_id FROM pay WHERE "


def kept(v: Views, column: str, op: str, value: str):
    return v.pay.where(fl.condition(fl.Condition(column, op, value))).select("line_id")


@query("business_filter", "SELECT line_id FROM listing")
def business_filter(v):
    return v.listing.select("line_id")


@query("filter_eq", KEEP + "province = 'NATION_7'")
def filter_eq(v):
    return kept(v, "province", "=", "NATION_7")


@query("filter_ne", KEEP + "base_pay <> 0 AND category <> 'BUILDING'")
def filter_ne(v):
    rules = [fl.Condition("base_pay", "!=", "0"), fl.Condition("category", "!=", "BUILDING")]
    return v.pay.where(fl.all_of([fl.condition(r) for r in rules])).select("line_id")


@query("filter_contains", KEEP + "lower(province) LIKE '%ation__1%'")
def filter_contains(v):
    return kept(v, "province", "contains", "ATION__1")


@query("filter_prefix", KEEP + "lower(last_name) LIKE 'agént x%'")
def filter_prefix(v):
    return kept(v, "last_name", "prefix", "Agént X")


@query("filter_range", KEEP + "gross_pay >= 1234.5 AND gross_pay < 200000 AND grade > 'G0'")
def filter_range(v):
    rules = [fl.Condition("gross_pay", ">=", "1 234,5"), fl.Condition("gross_pay", "<", "200 000"), fl.Condition("grade", ">", "G0")]
    return v.pay.where(fl.all_of([fl.condition(r) for r in rules])).select("line_id")


@query("explore_filter", """
SELECT event_id FROM events WHERE cast(event_type AS varchar) ILIKE '%LIC%' AND try_cast(value AS double) >= 10
  AND cast(user_id AS varchar) <> '8' AND cast(props AS varchar) ILIKE '{"K%'""", raw=True)
def explore_filter(v):
    tests = [("event_type", "contains", "LIC"), ("value", ">=", "10"), ("user_id", "!=", "8"), ("props", "prefix", '{"K')]
    return v.table("events").where(fl.all_of([fl.explore(*t) for t in tests])).select("event_id")


@query("explore_empty", KEEP + "last_name IS NULL OR last_name = ''")
def explore_empty(v):
    return v.pay.where(fl.explore("last_name", "empty")).select("line_id")


@query("explore_not_empty", KEEP + "last_name IS NOT NULL AND last_name <> ''")
def explore_not_empty(v):
    return v.pay.where(fl.explore("last_name", "not empty")).select("line_id")


@query("scope_filter", KEEP + "institution_id = 'IF' AND regime = 'R2' AND quarter = 'T3' AND year = 1997")
def scope_filter(v):
    return v.pay.where(fl.in_scope("IF", "R2", "T3", 1997)).select("line_id")


@query("filter_preview", """
SELECT p.execution_id, count(*) AS available, count(l.line_id) AS retained
FROM pay p LEFT JOIN listing l ON l.line_id = p.line_id GROUP BY p.execution_id""")
def filter_preview(v):
    return sm.filter_preview(v.pay, RULES)


# --- figures -------------------------------------------------------------------------


@query("label_join", """
SELECT line_id, coalesce(official_name, p.institution_id) AS institution FROM pay p LEFT JOIN names n ON n.institution_id = p.institution_id""",
       (NAMES_SQL,))
def label_join(v):
    return sm.institution_label(v.pay, v.institutions).select("line_id", "institution")


@query("available_sources", f"""
SELECT c.*, coalesce(official_name, c.institution_id) AS institution FROM (
  SELECT p.execution_id, {', '.join('p.' + c for c in SCOPE)}, source_table, count(*) AS row_count, min(j.source_file) AS source_file
  FROM pay p LEFT JOIN (SELECT execution_id, min(source_file) AS source_file FROM journal GROUP BY 1) j
    ON j.execution_id = p.execution_id
  GROUP BY p.execution_id, {', '.join('p.' + c for c in SCOPE)}, source_table) c
LEFT JOIN names n ON n.institution_id = c.institution_id""", (NAMES_SQL,))
def available_sources(v):
    return sm.available_sources(v.pay, v.institutions, v.journal)


@query("declaration_versions", f"""
SELECT d.execution_id, {', '.join('d.' + c for c in SCOPE)}, d.row_count, j.source_file, j.finished_on
FROM (SELECT execution_id, {S}, count(*) AS row_count FROM declared GROUP BY execution_id, {S}) d
LEFT JOIN journal j ON j.execution_id = d.execution_id AND {same_scope('j', 'd')}""")
def declaration_versions(v):
    return sm.declaration_versions(v.declared, v.journal)


@query("source_diagnosis", f"""
SELECT *, issues = '' AS ready FROM (
  SELECT p.execution_id, {', '.join('p.' + c for c in SCOPE)}, count(*) AS available, count(l.line_id) AS retained,
    count(*) FILTER (p.{USABLE}) AS usable_ids, count(*) FILTER (p.name_key <> '') AS usable_names,
    concat_ws('; ', CASE WHEN count(l.line_id) = 0 THEN 'No line after filters' END,
      CASE WHEN count(*) FILTER (p.{USABLE}) + count(*) FILTER (p.name_key <> '') = 0
        THEN 'No usable identifier or name' END) AS issues
  FROM pay p LEFT JOIN listing l ON l.line_id = p.line_id GROUP BY p.execution_id, {', '.join('p.' + c for c in SCOPE)})""")
def source_diagnosis(v):
    return sm.source_diagnosis(v.pay, RULES)


@query("dashboard", """
SELECT 'institutions' AS metric, count(DISTINCT institution_id) AS value
  FROM (SELECT institution_id FROM pay UNION ALL SELECT institution_id FROM declared)
UNION ALL SELECT 'imports', count(*) FROM journal WHERE status = 'DONE'
UNION ALL SELECT 'pay_lines', count(*) FROM pay
UNION ALL SELECT 'declarations', count(*) FROM declared
UNION ALL SELECT 'anomalies', count(*) FROM matched WHERE status NOT IN ('OK_BY_ID', 'OK_BY_NAME')""", MATCHED)
def dashboard(v):
    return sm.dashboard(v.pay, v.declared, v.journal, mt.matching(v.pay, v.declared))


FILLED = {"BASE_PAY": "base_pay", "TRANSPORT": "transport", "BONUS": "bonus", "DEDUCTIONS": "deductions",
          "NET_PAY": "net_pay", "GROSS_PAY": "gross_pay"}


@query("component_availability", " UNION ALL ".join(
    f"""SELECT {S}, count(*) AS row_count, '{code}' AS component, count(*) FILTER (abs({c}) > 0) AS filled_rows,
  {'true' if code == 'BONUS' else 'false'} AS mapped FROM pay GROUP BY {S}
  HAVING count(*) FILTER (abs({c}) > 0) > 0 OR '{code}' = 'BONUS'""" for code, c in FILLED.items()))
def component_availability(v):
    return sm.component_availability(v.pay, ["bonus"], [], SCOPE)


def used_by_matching(v: Views):
    """Matching results as one run per institution and regime."""
    results = mt.classify(v.pay, v.declared).select("line_id", "declared_id", "institution_id", "regime")
    return results.select("line_id", "declared_id", F.concat("institution_id", "regime").alias("run_id"))


@query("usage_guard", f"""
SELECT {', '.join('d.' + c for c in SCOPE)}, count(DISTINCT c.institution_id || c.regime) AS runs
FROM classified c JOIN declared d ON d.declared_id = c.declared_id GROUP BY {', '.join('d.' + c for c in SCOPE)}""", MATCHED)
def usage_guard(v):
    return sm.usage(v.declared, used_by_matching(v), "declared_id", SCOPE)


@query("replace_guard", """
SELECT 'matching' AS analysis, count(DISTINCT c.institution_id || c.regime) AS n
FROM classified c JOIN declared d ON d.declared_id = c.declared_id WHERE d.regime = 'R2' AND d.year >= 1999
UNION ALL SELECT 'campaign', 1""", MATCHED)
def replace_guard(v):
    """Runs that stand in the way of replacing the declarations of a regime."""
    target = v.declared.where((F.col("regime") == "R2") & (F.col("year") >= 1999))
    campaigns = v.declared.select("execution_id").distinct().where(F.col("execution_id") == "VIF")
    return lc.uses(target, "declared_id", used_by_matching(v), campaigns)


CAMPAIGNS_SQL = f"""
campaigns AS (SELECT DISTINCT execution_id, {S} FROM declared WHERE institution_id = 'IF'),
run_uses AS (
  SELECT {', '.join('d.' + c for c in SCOPE)}, count(DISTINCT c.institution_id || c.regime) AS matching_runs
  FROM classified c JOIN declared d ON d.declared_id = c.declared_id GROUP BY ALL)"""


@query("declaration_imports", f"""
SELECT j.execution_id, {', '.join('j.' + c for c in SCOPE)}, j.source_file, j.finished_on, j.rows_loaded AS row_count,
  coalesce(u.matching_runs, 0) AS matching_runs, CASE WHEN c.execution_id IS NULL THEN 0::bigint ELSE 1::bigint END AS campaigns
FROM journal j LEFT JOIN run_uses u ON {same_scope('u', 'j')}
LEFT JOIN campaigns c ON c.execution_id = j.execution_id AND {same_scope('c', 'j')}
WHERE j.operation = 'IMPORT_DECLARED' AND j.status <> 'DELETED'""", (*MATCHED, CAMPAIGNS_SQL))
def declaration_imports(v):
    campaigns = v.declared.where("institution_id = 'IF'").select("execution_id", *SCOPE).distinct()
    return sm.declaration_imports(v.journal, v.declared, used_by_matching(v), campaigns)


# --- withdrawals ---------------------------------------------------------------------


def stored(v: Views, **rows: DataFrame) -> Tables:
    """The given rows as tables of a new folder that change together."""
    tables = Tables(v.spark, scratch_path(v.spark, "tables"))
    with tables.change() as change:
        for name, own in rows.items():
            change.append(name, own)
    return tables


@query("delete_import", f"SELECT declared_id, {S} FROM declared WHERE execution_id <> 'VIP'")
def delete_import(v):
    """Withdraw one import from tables that change together, and read back what is left."""
    tables = stored(v, declared=v.declared, journal=v.full_journal)
    elsewhere = used_by_matching(v).where(~F.startswith("run_id", F.lit("IP")))
    lc.withdraw_import(tables, "VIP", elsewhere, v.declared.where("institution_id = 'IF'").select("execution_id").distinct())
    return tables.read("declared").select("declared_id", *SCOPE)


@query("withdrawn_journal", f"""
SELECT {S}, execution_id, operation, CASE WHEN execution_id = 'VIP' THEN 'DELETED' ELSE status END AS status,
  CASE WHEN execution_id = 'VIP' AND status <> 'DELETED' THEN 'Withdrawn (' || n || ' lines)' END AS message
FROM journal, (SELECT count(*) AS n FROM declared WHERE execution_id = 'VIP')""")
def withdrawn_journal(v):
    """The latest entry of each import after one was withdrawn; the journal itself only grows."""
    tables = stored(v, declared=v.declared, journal=v.full_journal)
    lc.withdraw_import(tables, "VIP")
    return wr.current_journal(tables.read("journal")).select(*SCOPE, "execution_id", "operation", "status", "message")


SCOPE_TEST = "institution_id = 'IO' AND regime = 'R3' AND quarter = 'T2' AND year = 1998"


@query("delete_scope", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) FILTER ({SCOPE_TEST}) AS deleted, count(*) FILTER (NOT ({SCOPE_TEST})) AS kept FROM {src}"
    for t, src in (("declared", "declared"), ("pay", "pay"), ("results", "matched"))), MATCHED)
def delete_scope(v):
    """Lines that emptying a scope removes from the pay, declaration and result tables, and what is left."""
    tables = stored(v, pay=v.pay.select(*SCOPE, "line_id"), declared=v.declared, results=mt.matching(v.pay, v.declared))
    deleted = lc.empty_scope(tables, dict(zip(SCOPE, ("IO", "R3", "T2", 1998))))
    rows = [tables.read(name).agg(F.count(F.lit(1)).alias("kept")).select(
        F.lit(name).alias("table_name"), F.lit(n).cast("long").alias("deleted"), "kept") for name, n in deleted.items()]
    return reduce(DataFrame.unionByName, rows)


@query("inspect_scope", f"""
SELECT s.*, coalesce(m.matching_runs, 0) AS matching_runs, s.executions AS campaigns,
  coalesce(g.listing_groups, 0) AS listing_groups
FROM (SELECT {S}, count(*) AS row_count, count(DISTINCT execution_id) AS executions FROM pay GROUP BY {S}) s
LEFT JOIN (SELECT {S}, count(DISTINCT institution_id || regime) AS matching_runs FROM classified GROUP BY {S}) m
  ON {same_scope('m', 's')}
LEFT JOIN (SELECT {S}, 1::bigint AS listing_groups FROM pay WHERE execution_id = 'E2' GROUP BY {S}) g ON {same_scope('g', 's')}""",
       MATCHED)
def inspect_scope(v):
    sources = v.pay.select("execution_id").distinct()
    return lc.inspect_scopes(v.pay, used_by_matching(v), sources, sources.where(F.col("execution_id") == "E2"))


@query("delete_pay_scope", f"SELECT {S}, line_id FROM pay WHERE NOT ({SCOPE_TEST})")
def delete_pay_scope(v):
    """A pay table by scope, rewritten without one scope, and read back."""
    folder = scratch_path(v.spark, "pay_line")
    lines = v.pay.select(*SCOPE, "line_id")
    wr.append_lines(lines, folder)
    lc.delete_rows(v.spark, folder, lines.schema, fl.in_scope("IO", "R3", "T2", 1998))
    return wr.read_lines(v.spark, folder, lines.schema)


@query("delete_rows", """
SELECT event_id FROM events WHERE NOT coalesce(cast(event_type AS varchar) = 'click' AND try_cast(value AS double) < 20, false)""",
       raw=True)
def delete_rows(v):
    """What deleting by two filters leaves of a table without any partitions."""
    tables = stored(v, events=v.table("events"))
    with tables.change() as change:
        change.delete("events", fl.explore("event_type", "=", "click") & fl.explore("value", "<", "20"))
    return tables.read("events").select("event_id")


@query("upsert_latest", """
SELECT custkey, version, status FROM (
  SELECT o_custkey AS custkey, o_orderkey AS version, o_orderstatus AS status,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""", raw=True)
def upsert_latest(v):
    """The newest entry per key of an old and a new table."""
    rows = v.table("orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status")
    )
    old, new = rows.where("version < 5000"), rows.where("version >= 5000")
    return lc.upsert_latest(old, new, ["custkey"], "version")


