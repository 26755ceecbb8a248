"""Queries of the annex pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from paywarden.functions import text
from paywarden.functions.formulas import Formula
from paywarden.operators import annex_totals as at, annexes as ax
from paywarden.plans.controls import ORDER, USABLE, money
from paywarden.plans.formula_sql import FORMULA_SQL, TERM_COLUMNS, join_formula, value_sql
from paywarden.plans.registry import S, query, same_scope
from paywarden.plans.views import FORMULAS, RULES, Views
from paywarden.schema import Mode, Rubric, SCOPE
from paywarden.session import scratch_path
from paywarden.sources.writers import export_parts

VALID = {"staff_key": "{}.staff_key NOT IN ('', 'NU')", "name_key": "{}.name_key <> ''"}
KINDS = {"id": "staff_key", "name": "name_key"}


def windowed(table: str, key: str, test: str, order: str = ORDER) -> str:
    return f"""SELECT * FROM {table} WHERE {VALID[key].format(table)}
      QUALIFY {test.format(n=f'count(*) OVER (PARTITION BY {S}, {key})',
                           rn=f'row_number() OVER (PARTITION BY {S}, {key} ORDER BY {order})')}"""


def elsewhere_sql(key: str) -> str:
    """The lines outside the filtered scope of every institution that declares and lists the person."""
    return f"""SELECT c.institution_id, o.* EXCLUDE (institution_id) FROM pay o JOIN (
        SELECT DISTINCT d.institution_id, d.regime, d.quarter, d.year, d.{key} FROM declared d
        WHERE {VALID[key].format('d')} AND EXISTS (SELECT 1 FROM listing l WHERE {same_scope('l', 'd')} AND l.{key} = d.{key})
      ) c ON c.regime = o.regime AND c.quarter = o.quarter AND c.year = o.year AND c.{key} = o.{key}
      WHERE NOT (o.institution_id = c.institution_id AND (o.institution_id <> 'IF' OR o.category = 'BUILDING'))"""


def declared_exists(key: str) -> str:
    return f"EXISTS (SELECT 1 FROM declared d WHERE {same_scope('d', 'l')} AND {VALID[key].format('d')} AND d.{key} = l.{key})"


ROWS_SQL = {
    "listing": "SELECT * FROM listing",
    "identifiers": "SELECT * FROM listing",
    "missing_id": f"SELECT * FROM listing WHERE NOT {USABLE}",
    "validation": f"SELECT * FROM listing WHERE NOT {USABLE} OR name_key = ''",
    "declared": "SELECT * FROM declared",
    "declared_missing_id": f"SELECT * FROM declared WHERE NOT {USABLE}",
}
DECLARED_SQL_ORDER = "source_row, execution_id, declared_id"
for kind, key in KINDS.items():
    ROWS_SQL[f"first_{kind}"] = windowed("listing", key, "{rn} = 1")
    ROWS_SQL[f"dup_{kind}"] = windowed("listing", key, "{n} > 1")
    ROWS_SQL[f"shared_{kind}"] = windowed("listing", key, "{n} > 1 AND {rn} = 1")
    ROWS_SQL[f"elsewhere_{kind}"] = elsewhere_sql(key)
    ROWS_SQL[f"elsewhere_{kind}_pos"] = elsewhere_sql(key) + " AND o.gross_pay > 0"
    ROWS_SQL[f"paid_elsewhere_{kind}"] = elsewhere_sql(key) + " AND o.gross_pay > 0"
    ROWS_SQL[f"declared_first_{kind}"] = windowed("declared", key, "{rn} = 1", DECLARED_SQL_ORDER)
    ROWS_SQL[f"declared_dup_{kind}"] = windowed("declared", key, "{n} > 1")
    ROWS_SQL[f"present_{kind}"] = (
        f"SELECT * FROM listing l WHERE gross_pay > 0 AND {VALID[key].format('l')} AND {declared_exists(key)}"
    )
    ROWS_SQL[f"undeclared_{kind}"] = f"SELECT * FROM listing l WHERE gross_pay > 0 AND NOT {declared_exists(key)}"

PERSON_SQL = "CASE WHEN {u} THEN 'M:' || staff_key WHEN name_key <> '' THEN 'N:' || name_key ELSE 'L:' || {line} END"


def annex_sql(annex: ax.Annex) -> str:
    """Lines of an annex with person and impact."""
    line = "declared_id" if annex.family == ax.DECLARED else "line_id"
    person = annex.person if annex.person != ax.PERSON else PERSON_SQL.format(u=USABLE, line=line)
    if annex.rubric is None:
        return f"""SELECT {S}, {line} AS line_id, staff_key, name_key, {person} AS concerned, 'NO_IMPACT' AS formula_id,
          cast(0 AS decimal(18,2)) AS impact FROM ({ROWS_SQL[annex.name]}) x"""
    return f"""SELECT x.institution_id, x.regime, x.quarter, x.year, x.line_id, x.staff_key, x.name_key,
        {person} AS concerned, f.formula_id, {value_sql('x', 'f', 'x.place')} AS impact
      FROM (SELECT r.*, row_number() OVER (PARTITION BY {S}, {annex.rank_key} ORDER BY {ORDER}) AS place
            FROM ({ROWS_SQL[annex.name]}) r) x {join_formula('x', 'f', f"'{annex.rubric}'")}"""


def register_annex(annex: ax.Annex):
    """One query per annex: its lines with formula and impact."""

    def build(v: Views):
        rows = ax.annex(annex.name, v.pay, v.declared, RULES, FORMULAS)
        line = "declared_id" if annex.family == ax.DECLARED else "line_id"
        return rows.select(*SCOPE, F.col(line).alias("line_id"), "staff_key", "name_key", "formula_id", "impact")

    query(f"annex_{annex.name}",
          f"SELECT {S}, line_id, staff_key, name_key, formula_id, impact FROM ({annex_sql(annex)}) a", (FORMULA_SQL,))(build)


#: Annexes whose lines are those of another one are left to it.
SAME_LINES = {"identifiers", "paid_elsewhere_id", "paid_elsewhere_name"}
for _annex in ax.ANNEXES:
    if _annex.name not in SAME_LINES:
        register_annex(_annex)

ENTRIES_SQL = "entries AS (" + "\n    UNION ALL ".join(
    f"SELECT {S}, '{a.name}' AS annex, '{a.family}' AS family, concerned, impact FROM ({annex_sql(a)}) a"
    for a in ax.ANNEXES
) + ")"
PACK = (FORMULA_SQL, ENTRIES_SQL)
FIGURES = f"count(*) AS row_count, count(DISTINCT concerned) AS people, {money('sum(impact)')} AS impact"
SUMMARY_SQL = f"summary AS (SELECT {S}, family, annex, {FIGURES} FROM entries GROUP BY {S}, family, annex)"


def summary(v: Views, names: list[str] = ()):
    return at.pack_summary(v.pay, v.declared, RULES, FORMULAS, names)


@query("annex_summary", f"SELECT {S}, family, annex, {FIGURES} FROM entries GROUP BY {S}, family, annex", PACK)
def annex_summary(v):
    return summary(v)


#: One formula in place of those of all rubrics; it counts the lines after the first one of a person.
FORCED = Formula("forced", Rubric.ANY, Mode.EXTRA_LINES, (("BASE_PAY", 1), ("BONUS", 0.5), ("DEDUCTIONS", -1)), name="Forced")


def forced_sql(annex: ax.Annex) -> str:
    """Entries of an annex under the forced formula."""
    if annex.rubric is None:
        return f"SELECT {S}, '{annex.name}' AS annex, '{annex.family}' AS family, concerned, impact FROM ({annex_sql(annex)}) a"
    person = annex.person if annex.person != ax.PERSON else PERSON_SQL.format(u=USABLE, line="line_id")
    amount = " + ".join(f"cast({k} AS decimal(12,4)) * {TERM_COLUMNS[code]}" for code, k in FORCED.terms)
    return f"""SELECT {S}, '{annex.name}' AS annex, '{annex.family}' AS family, {person} AS concerned,
      cast(CASE WHEN row_number() OVER (PARTITION BY {S}, {annex.rank_key} ORDER BY {ORDER}) = 1 THEN 0 ELSE {amount} END AS decimal(18,2)) AS impact
      FROM ({ROWS_SQL[annex.name]}) r"""


@query("annex_summary_forced", f"SELECT {S}, family, annex, {FIGURES} FROM entries GROUP BY {S}, family, annex",
       (FORMULA_SQL, "entries AS (" + "\n    UNION ALL ".join(map(forced_sql, ax.ANNEXES)) + ")"))
def annex_summary_forced(v):
    return at.pack_summary(v.pay, v.declared, RULES, FORMULAS, forced=FORCED)


TOTALS = "cast(sum(row_count) AS bigint) AS row_count, cast(sum(people) AS bigint) AS people, " + money("sum(impact)") + " AS impact"


@query("annex_overview", f"""
SELECT family, count(DISTINCT annex) AS annexes, {TOTALS} FROM summary GROUP BY family""", (*PACK, SUMMARY_SQL))
def annex_overview(v):
    return ax.annex_overview(summary(v))


FINDING = " ".join(f"WHEN '{name}' THEN '{label}'" for label, name in ax.FINDINGS.items())


@query("findings", f"""
SELECT {S}, CASE annex {FINDING} END AS finding, {TOTALS}
FROM summary WHERE annex IN ({', '.join(f"'{n}'" for n in ax.FINDINGS.values())}) GROUP BY {S}, annex""",
       (*PACK, SUMMARY_SQL))
def findings(v):
    return ax.findings(summary(v, list(ax.FINDINGS.values())), SCOPE)


@query("annex_people", f"""
SELECT {S}, line_id, {PERSON_SQL.format(u=USABLE, line='line_id')} AS concerned
FROM (SELECT * FROM listing WHERE NOT {USABLE} OR name_key = '')
QUALIFY row_number() OVER (PARTITION BY {S}, {PERSON_SQL.format(u=USABLE, line='line_id')} ORDER BY {ORDER}) = 1""")
def annex_people(v):
    """One representative line per person of the validation annex."""
    rows = ax.validation(v.listing)
    return ax.annex_people(rows, ax.BY_NAME["validation"]).select(*SCOPE, "line_id", "concerned")


#: Declarations of which some were handed in twice.
TWICE_SQL = f"""
twice AS (SELECT declared_id, execution_id, {S}, staff_key, name_key, source_row FROM declared
  UNION ALL SELECT 'S' || declared_id, execution_id, {S}, staff_key, name_key, source_row + 1 FROM declared WHERE agent_no % 10 = 4)"""


@query("annex_declared_twice", f"""
SELECT {S}, declared_id AS line_id, staff_key, name_key FROM ({windowed('twice', 'staff_key', '{n} > 1')}) x""", (TWICE_SQL,))
def annex_declared_twice(v):
    """Duplicates by identifier among declarations that were handed in twice."""
    columns = ["declared_id", "execution_id", *SCOPE, "staff_key", "name_key", "source_row"]
    again = v.declared.where("agent_no % 10 = 4").withColumns(
        {"declared_id": F.concat(F.lit("S"), "declared_id"), "source_row": F.col("source_row") + 1})
    rows = ax.annex("declared_dup_id", v.pay, v.declared.select(*columns).unionByName(again.select(*columns)), RULES, FORMULAS)
    return rows.select(*SCOPE, F.col("declared_id").alias("line_id"), "staff_key", "name_key")


def people_sql(annex: ax.Annex) -> str:
    """The first line of every person of an annex."""
    line = "declared_id" if annex.family == ax.DECLARED else "line_id"
    person = annex.person if annex.person != ax.PERSON else PERSON_SQL.format(u=USABLE, line=line)
    order = DECLARED_SQL_ORDER if annex.family == ax.DECLARED else ORDER
    return f"""SELECT {S}, '{annex.name}' AS annex, {person} AS concerned, {line} AS line_id FROM ({ROWS_SQL[annex.name]}) x
      QUALIFY row_number() OVER (PARTITION BY {S}, {person} ORDER BY {order}) = 1"""


@query("annex_people_all", "\nUNION ALL ".join(map(people_sql, ax.ANNEXES)))
def annex_people_all(v):
    """One representative line per person of each of the annexes."""
    return at.pack_people(v.pay, v.declared, RULES)


@query("annex_export", "SELECT annex, count(*) AS row_count FROM entries GROUP BY annex", PACK)
def annex_export(v):
    """The pack written as one folder per annex in a single pass; what the folders hold."""
    folder = scratch_path(v.spark, "annexes")
    export_parts(ax.pack_entries(v.pay, v.declared, RULES, FORMULAS), folder, "annex")
    return v.spark.read.parquet(folder).groupBy("annex").agg(F.count(F.lit(1)).alias("row_count"))


# --- the operators behind the annexes, without filters and impact ---------------------

LINE = f"SELECT {S}, line_id FROM"


def lines(rows):
    return rows.select(*SCOPE, "line_id")


for kind, key in KINDS.items():
    query(f"first_per_{kind}", f"{LINE} ({windowed('pay', key, '{rn} = 1')}) x")(
        lambda v, key=key: lines(ax.first_per(v.pay, key)))
    query(f"dup_rows_{kind}", f"{LINE} ({windowed('pay', key, '{n} > 1')}) x")(
        lambda v, key=key: lines(ax.duplicates(v.pay, key)))
    query(f"shared_once_{kind}", f"{LINE} ({windowed('pay', key, '{n} > 1 AND {rn} = 1')}) x")(
        lambda v, key=key: lines(ax.shared_once(v.pay, key)))


@query("paid_and_declared", f"{LINE} pay l WHERE gross_pay > 0 AND {VALID['staff_key'].format('l')} AND {declared_exists('staff_key')}")
def paid_and_declared(v):
    return lines(ax.present(v.pay, v.declared, "staff_key"))


@query("paid_not_declared", f"{LINE} pay l WHERE gross_pay > 0 AND NOT {declared_exists('staff_key')}")
def paid_not_declared(v):
    return lines(ax.undeclared(v.pay, v.declared, "staff_key"))


@query("paid_outside_scope", f"""
SELECT x.institution_id, x.regime, x.quarter, x.year, x.line_id, p.institution_id AS paying_institution
FROM ({elsewhere_sql('staff_key')}) x JOIN pay p ON p.line_id = x.line_id""")
def paid_outside_scope(v):
    rows = ax.elsewhere(v.pay, v.declared, RULES, "staff_key")
    return rows.select(*SCOPE, "line_id", "paying_institution")


@query("unusable_id", f"SELECT line_id, staff_key FROM pay WHERE NOT {USABLE}")
def unusable_id(v):
    return v.pay.where(~text.usable_id(F.col("staff_key"))).select("line_id", "staff_key")
