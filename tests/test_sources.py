import datetime

import pytest
from pyspark.sql import functions as F

from helpers import SCOPE, declared, pay, raw
from paywarden.functions.filters import in_scope
from paywarden.operators import explore as xp, summaries as sm
from paywarden.schema import DECLARED_LINE, PAY_LINE
from paywarden.session import scratch_path
from paywarden.sources import lifecycle as lc, mapping as mp, readers as rd, writers as wr


# --- reading -------------------------------------------------------------------------


def test_csv_rows_are_numbered_across_blocks_and_files(spark, conf, tmp_path):
    for name, n in (("a", 5000), ("b", 30)):
        text = "Matricule;Nom agent\n" + "".join(f"{name}{i};\"x;{i}\"\n" for i in range(n))
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    conf(spark__sql__files__maxPartitionBytes="8KB", spark__sql__files__openCostInBytes="1KB")
    rows = rd.read_csv(spark, str(tmp_path), sep=";")
    got = {r.Matricule: (r["Nom agent"], r.source_row) for r in rows.collect()}
    assert len(got) == 5030
    assert all(got[f"a{i}"] == (f"x;{i}", i + 2) for i in range(5000))
    assert all(got[f"b{i}"] == (f"x;{i}", i + 2) for i in range(30))


def test_header_on_a_later_line_and_preview(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("Ministry,,\n\nMatricule,Noms,Service\nA,Alpha,\nB,Beta,S1\n", encoding="utf-8")
    rows = rd.read_csv(spark, str(path), header_row=3)
    assert [(r.Matricule, r.Service, r.source_row) for r in rows.orderBy("source_row").collect()] == [("A", None, 2), ("B", "S1", 3)]
    assert rd.preview_csv(spark, str(path), 3, 1).first().Matricule == "A"
    with pytest.raises(ValueError):
        rd.read_csv(spark, str(path), header_row=0)


def test_parquet_rows_are_text_with_their_number(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(0, 50, 1, 1).select("id", F.lit(1.5).alias("x")).write.parquet(path)
    rows = rd.read_parquet(spark, path).orderBy("source_row").collect()
    assert [(r.id, r.x, r.source_row) for r in rows[:2]] == [("0", "1.5", 2), ("1", "1.5", 3)] and rows[-1].source_row == 51


def test_numbering_by_an_order(spark):
    rows = rd.number_by(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), ["k"])
    assert {r.k: r.source_row for r in rows.collect()} == {"a": 2, "b": 3, "c": 4}


def test_regime_and_period_of_table_names(spark):
    names = ["Tab_PNC_T1_2024", "tab_secope_ff_t3_2023", "Tab_SECOPE_T4_2022", "Tab_Other_T5_2024", "Tab_PNC_T1_2024_old"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    found = rows.select(rd.detect_regime(F.col("n")).alias("r"), rd.detect_quarter(F.col("n")).alias("q"), rd.detect_year(F.col("n")).alias("y"))
    assert [tuple(r) for r in found.collect()] == [
        ("PNC", "T1", 2024), ("SECOPE_FF", "T3", 2023), ("SECOPE", "T4", 2022), (None, None, None), (None, None, None)]


# --- mapping -------------------------------------------------------------------------


def test_aliases_and_gross(spark):
    lines = pay(spark, [("A-1", "Jean Test", 100, 20), ("straße", "Agent Test", 50, 0)], columns=("NumMatricule", "Noms", "TraitementBase", "Primes"))
    assert sorted((r.staff_key, r.name_key, float(r.gross_pay)) for r in lines.collect()) == [
        ("A1", "JEANTEST", 120), ("STRASSE", "AGENTTEST", 50)]
    assert lines.schema == PAY_LINE or [f.name for f in lines.schema] == [f.name for f in PAY_LINE]


def test_explicit_mapping_comes_first():
    assert mp.infer_mapping(["Nom", "Autre", "Base"], {"Autre": "last_name"}) == {"Autre": "last_name", "Base": "base_pay"}
    assert mp.infer_mapping(["prénom", "NOM POSTNOM"]) == {"NOM POSTNOM": "last_name", "prénom": "first_name"}
    with pytest.raises(ValueError):
        mp.infer_mapping(["Matricule", "MATRICULE "])
    assert mp.missing_columns(["a"], ["a", "b"]) == ["b"]


def test_structure_of_a_declaration(spark):
    good = mp.describe_structure(["Matricule", "Noms", "Service", "MontantDeclare", "StatutAgent", "Other"])
    assert good.ready and good.unmapped == ["Other"] and good.mapping["Service"] == "service"
    report = {r.field: (r.source_column, r.status) for r in mp.structure_report(spark, good).collect()}
    assert report["raw_id"] == ("Matricule", "required, present") and report["grade"] == ("", "optional, missing")
    assert len(report) == 9
    bad = mp.describe_structure(["Matricule"], {"X": "grade"}, ["X"])
    assert not bad.ready and len(bad.issues) == 2


def test_standard_declaration(spark):
    lines = declared(spark, [("A", "Alpha", "Dir", "1500.5", "Active")], columns=("Matricule", "Noms", "Service", "MontantDeclare", "StatutAgent"))
    row = lines.first()
    assert (row.service, row.unit, float(row.declared_pay), row.agent_status, row.source_row) == ("Dir", "", 1500.5, "Active", 2)
    assert [f.name for f in lines.schema] == [f.name for f in DECLARED_LINE]


def test_content_check(spark):
    mp.check_declared(mp.declared_quality(declared(spark, [("A", "")] + [("", "B")])).first())
    for rows in ([("", "B"), ("NU", "C")], [("A", "")], []):
        with pytest.raises(ValueError):
            mp.check_declared(mp.declared_quality(declared(spark, rows)).first())


# --- imports and withdrawals ---------------------------------------------------------


@pytest.fixture
def store(tmp_path):
    return lc.Store(str(tmp_path / "store"))


def listing(spark, rows):
    return raw(spark, ["Matricule", "NomPostnom", "Base"], rows)


def people(spark, rows):
    return raw(spark, ["Matricule", "Noms"], rows)


def test_import_replace_and_withdraw_pay(spark, store):
    other = {**SCOPE, "quarter": "T2"}
    first = lc.import_pay(listing(spark, [("A", "Alpha", 1), ("B", "Beta", 2)]), store, SCOPE, source_file="a.csv")
    lc.import_pay(listing(spark, [("C", "Gamma", 3)]), store, other)
    lines = lambda: wr.read_lines(spark, store.pay, PAY_LINE)
    assert lines().count() == 3
    lc.import_pay(listing(spark, [("D", "Delta", 4)]), store, SCOPE, mode="replace")
    assert {r.staff_key for r in lines().collect()} == {"C", "D"}
    journal = wr.current_journal(wr.read_lines(spark, store.journal, wr.JOURNAL))
    assert {(r.execution_id == first, r.rows_loaded, r.mode) for r in journal.collect()} == {(True, 2, "append"), (False, 1, "append"), (False, 1, "replace")}

    results = lines().where(in_scope(**SCOPE)).select("line_id", F.lit("run").alias("run_id"))
    with pytest.raises(ValueError, match="1 matching run"):
        lc.delete_pay_scope(spark, store, SCOPE, results)
    assert lc.delete_pay_scope(spark, store, SCOPE) == 1
    assert {r.staff_key for r in lines().collect()} == {"C"}
    assert wr.read_raw(spark, store.raw("PNC")).select("Matricule").collect()[0][0] in ("A", "B", "C")
    with pytest.raises(ValueError):
        lc.delete_pay_scope(spark, store, SCOPE)


def test_required_columns(spark, store):
    with pytest.raises(ValueError, match="Grade"):
        lc.import_pay(listing(spark, [("A", "a", 1)]), store, SCOPE, required=["Grade"])


def test_declaration_life(spark, store):
    execution = lc.import_declared(people(spark, [("A", "Alpha"), ("B", "Beta")]), store, SCOPE, source_file="d.csv")
    with pytest.raises(ValueError):
        lc.import_declared(raw(spark, ["Matricule"], [("A",)]), store, SCOPE)
    with pytest.raises(ValueError):
        lc.import_declared(people(spark, [("", "Alpha")]), store, SCOPE)
    lines = lambda: wr.read_lines(spark, store.declared, DECLARED_LINE)
    assert lines().count() == 2
    schema = {r.source_column: (r.field, r.required) for r in spark.read.parquet(store.schemas).collect()}
    assert schema["Matricule"] == ("raw_id", False)

    campaigns = spark.createDataFrame([(execution,)], "execution_id string")
    with pytest.raises(ValueError, match="1 campaign run"):
        lc.import_declared(people(spark, [("C", "Gamma")]), store, SCOPE, mode="replace", campaigns=campaigns)
    with pytest.raises(ValueError, match="used by"):
        lc.delete_declared_import(spark, store, execution, campaigns=campaigns)
    assert lc.delete_declared_import(spark, store, execution) == 2
    assert not wr.exists(spark, store.declared + "/institution_id=I1") or lines().count() == 0
    with pytest.raises(ValueError):
        lc.delete_declared_import(spark, store, execution)


def test_emptying_a_scope(spark, store):
    lc.import_pay(listing(spark, [("A", "Alpha", 1), ("B", "Beta", 2)]), store, SCOPE)
    lc.import_declared(people(spark, [("A", "Alpha")]), store, SCOPE)
    assert lc.delete_scope(spark, store, SCOPE) == {"results": 0, "pay": 2, "declared": 1}
    assert lc.delete_scope(spark, store, SCOPE)["pay"] == 0


def test_deleting_rows_by_condition(spark, tmp_path):
    rows = spark.createDataFrame([("A", "P", "T1", 1), ("B", "P", "T1", 1), ("C", "P", "T2", 1), ("D", "Q", "T1", 1)],
                                 "institution_id string, regime string, quarter string, year int").withColumn("x", F.col("institution_id"))
    path = str(tmp_path / "t")
    wr.append_lines(rows, path)
    assert lc.delete_rows(spark, path, rows.schema, (F.col("regime") == "P") & (F.col("quarter") == "T1")) == 2
    assert {r.x for r in wr.read_lines(spark, path, rows.schema).collect()} == {"C", "D"}
    assert lc.delete_rows(spark, path, rows.schema, F.lit(False)) == 0


def test_replacing_scopes(spark, tmp_path):
    layout = "institution_id string, regime string, quarter string, year int, x int"
    path = str(tmp_path / "t")
    table = lambda *rows: spark.createDataFrame(list(rows), layout)
    wr.append_lines(table(("A", "R", "T1", 1, 1), ("A", "R/2", "T1", 1, 2), ("B", "R", "T1", 1, 3)), path)
    empty = dict(institution_id="A", regime="R/2", quarter="T1", year=1)
    wr.replace_scopes(table(("A", "R", "T1", 1, 9)), path, [empty])
    assert {r.x for r in wr.read_lines(spark, path, table(("A", "R", "T1", 1, 1)).schema).collect()} == {9, 3}


def test_runs_without_header_do_not_exist(spark, tmp_path):
    path = str(tmp_path / "runs")
    lc.write_run(spark.range(3), path, "r1", "matching")
    spark.range(5).withColumn("run_id", F.lit("r2")).write.partitionBy("run_id").mode("append").parquet(f"{path}/results")
    assert lc.finished_runs(spark, path).count() == 3


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a\x01b", "s1", 1), ("c", "s2", 2)], "text string, status string, n int")
    wr.export_csv(wr.sanitised(rows), str(tmp_path / "csv"), single_file=True)
    files = list((tmp_path / "csv").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[:2] == ["text,status,n", "a b,s1,1"]
    wr.export_parts(rows, str(tmp_path / "parts"), "status")
    assert {p.name for p in (tmp_path / "parts").glob("status=*")} == {"status=s1", "status=s2"}


class FakeSession:
    """A session with a master and settings."""

    def __init__(self, master, **settings):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: settings.get("dir", default))})


def test_scratch_folder_follows_the_session():
    assert scratch_path(FakeSession("yarn", dir="hdfs://shared/"), "x").startswith("hdfs://shared/x-")
    assert "paywarden-" in scratch_path(FakeSession("local[2]"), "x")
    with pytest.raises(ValueError):
        scratch_path(FakeSession("yarn"), "x")


# --- figures and console -------------------------------------------------------------


def test_a_failed_replace_keeps_the_old_scope(spark, store):
    lc.import_pay(listing(spark, [("A", "Alpha", 1), ("B", "Beta", 2)]), store, SCOPE, source_file="a.csv")
    with pytest.raises(Exception, match="out of range"):
        lc.import_pay(listing(spark, [("C", "Gamma", "12345678901234567890")]), store, SCOPE, mode="replace", source_file="b.csv")
    assert {r.raw_id for r in wr.read_lines(spark, store.pay, PAY_LINE).collect()} == {"A", "B"}


def test_lines_of_several_files_have_ids_of_their_own(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("Matricule,Noms\nX1,One\nX2,Two\n", encoding="utf-8")
    lines = mp.standardise_pay(rd.read_csv(spark, str(tmp_path)), {**SCOPE, "execution_id": "E"})
    assert (lines.count(), lines.select("line_id").distinct().count()) == (4, 4)


def test_records_that_span_lines(spark, tmp_path):
    text = [("1", "two\nlines, \"quoted\" "), ("2", "  \r\n"), ("3", ""), ("4", None), ("5", "plain")]
    wr.export_csv(spark.createDataFrame(text, "id string, text string"), str(tmp_path / "c"), bom=True)
    with pytest.raises(Exception, match="spans lines"):
        rd.read_csv(spark, str(tmp_path / "c")).collect()
    rows = rd.read_csv(spark, str(tmp_path / "c"), multi_line=True)
    assert sorted((r.id, r.text) for r in rows.collect()) == sorted(text)
    assert rows.select("source_path", "source_row").distinct().count() == 5


def test_amounts_beyond_money_are_refused(spark):
    with pytest.raises(Exception, match="out of range"):
        pay(spark, [("A", "a", "12345678901234567.5")]).collect()


def test_pages_by_key(spark):
    rows = spark.range(10).selectExpr("id % 3 AS a", "id AS b")
    first = xp.page_after(rows, ["a", "b"], None, 4).collect()
    second = xp.page_after(rows, ["a", "b"], tuple(first[-1]), 4).collect()
    assert first + second == rows.orderBy("a", "b").limit(8).collect()


def test_repeated_journal_entries_multiply_nothing(spark):
    lines = pay(spark, [("A", "a", 1), ("B", "b", 1)])
    journal = spark.createDataFrame([("E1", "f1", "DONE"), ("E1", "f0", "DONE")], "execution_id string, source_file string, status string")
    names = spark.createDataFrame([("I9", "Nine")], "institution_id string, official_name string")
    row = sm.available_sources(lines, names, journal).first()
    assert (row.row_count, row.source_file, row.institution) == (2, "f0", "I1")


def test_several_declaration_versions_need_a_choice(spark):
    lines = declared(spark, [("A", "a")]).unionByName(declared(spark, [("A", "a")], "D2"))
    finished = [("D1", datetime.date(2024, 1, 1)), ("D2", datetime.date(2024, 2, 1))]
    journal = spark.createDataFrame([(e, *SCOPE.values(), "f", d) for e, d in finished],
                                    "execution_id string, institution_id string, regime string, quarter string, year int, source_file string, finished_on date")
    versions = sm.declaration_versions(lines, journal)
    assert [r.execution_id for r in versions.collect()] == ["D2", "D1"]
    with pytest.raises(ValueError):
        sm.one_version(versions)
    assert sm.one_version(versions, "D1").count() == 1


def test_diagnosis_of_sources(spark):
    lines = pay(spark, [("NU", "", 1)], "E1").unionByName(pay(spark, [("A", "a", 1)], "E2"))
    found = {r.execution_id: (r.ready, r.issues) for r in sm.source_diagnosis(lines, [], ["execution_id"]).collect()}
    assert found == {"E1": (False, "No usable identifier or name"), "E2": (True, "")}


def test_console_guard(spark):
    for good in ("SELECT 1", " with a as (select 1) select * from a; ", "-- c\nSHOW TABLES", "select replace('a','a','b')", "DESCRIBE t",
                 "SELECT '--x;y' AS a, 1 AS b", "SELECT 'reflect(' /* ; DROP */ AS a", "EXPLAIN SELECT 1"):
        xp.check_read_only(spark, good)
    for bad in ("", "-- only a comment", "DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "SET a=1",
                "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT TRANSFORM(a) USING 'cat' FROM t",
                "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM parquet.`/tmp/x`",
                "FROM t INSERT INTO a SELECT 1 INSERT INTO b SELECT 2", "CREATE TABLE a AS SELECT 1", "EXPLAIN DROP TABLE x",
                "SELECT (SELECT max(x) FROM other.t)"):
        with pytest.raises(ValueError):
            xp.check_read_only(spark, bad)
    spark.range(7).createOrReplaceTempView("secret")
    for bad in ("SELECT * FROM secret", "SELECT (SELECT count(*) FROM secret)", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret"):
        with pytest.raises(ValueError):
            xp.safe_sql(spark, bad, {"t": spark.range(5)})
    assert xp.safe_sql(spark, "WITH a AS (SELECT * FROM secret) SELECT '--x;y' AS m, count(*) AS n FROM a", {"secret": spark.range(2)}).first().n == 2
    assert spark.table("secret").count() == 7
    spark.catalog.dropTempView("secret")
    with pytest.raises(ValueError):
        xp.safe_sql(spark, "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", {})
    shown = xp.display(xp.safe_sql(spark, "SELECT * FROM t ORDER BY id", {"t": spark.range(5)}), 3)
    assert (shown.columns, len(shown.rows), shown.truncated) == (["id"], 3, True)
    assert not xp.display(spark.range(3), 3).truncated


def test_pages_need_an_order(spark):
    assert [r.id for r in xp.page(spark.range(10), ["id"], 3, 4).collect()] == [4, 5, 6]
    with pytest.raises(ValueError):
        xp.page(spark.range(10), [], 3)


def test_parts_are_written_where_the_rows_are(spark, tmp_path):
    """Every task adds to the folders; nothing moves, and the session's setting comes back."""
    rows = spark.range(0, 400, 1, 4).select("id", (F.col("id") % 2).alias("part"))
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    wr.export_parts(rows, str(tmp_path / "parts"), "part")
    assert spark.conf.get(name, None) == before
    assert [len(list((tmp_path / "parts" / f"part={i}").glob("*.parquet"))) for i in (0, 1)] == [4, 4]
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 400
