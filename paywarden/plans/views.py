"""Pay and declared lines derived from the given tables.

Each definition exists twice: as a DataFrame, and as a SQL common table
expression that an oracle starts from.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from paywarden.functions.filters import FilterRule, retained
from paywarden.functions.formulas import Formula
from paywarden.functions.text import normalise
from paywarden.schema import GROSS_PARTS, MONEY, Mode, PERIOD, Rubric, SCOPE
from paywarden.session import many_folders, scratch_path
from paywarden.sources.writers import JOURNAL

RULES = [FilterRule("category", "=", "BUILDING", institution_id="IF")]

FORMULAS = [
    Formula("f1", Rubric.ANY, Mode.ALL_LINES, (("BASE_PAY", 1),), None, "R1", "T1", 1995, 1, name="Base"),
    Formula("f2", Rubric.PAID_NOT_DECLARED, Mode.ALL_LINES, (("BASE_PAY", 1), ("DEDUCTIONS", -1)), None, "R1",
            "T1", 1997, 1, name="Base less deductions"),
    Formula("f3", Rubric.PAID_NOT_DECLARED, Mode.ALL_LINES, (("BASE_PAY", 1), ("BONUS", 0.5)), "IF", "R1",
            "T3", 1998, 1, name="Base and half the bonus"),
    Formula("f4", Rubric.PAID_NOT_DECLARED, Mode.ALL_LINES, (("BASE_PAY", 2),), "IF", "R1", "T3", 1998, 2,
            name="Twice the base"),
    Formula("f5", Rubric.DUPLICATE_ID, Mode.EXTRA_LINES, (("GROSS_PAY", 1),), None, "R2", "T1", 1995, 1,
            name="Gross of further lines"),
    Formula("f6", Rubric.MISSING_ID, Mode.ONE_PER_PERSON, (("BASE_PAY", 1),), None, "R2", "T1", 1995, 1,
            name="Base once"),
    Formula("f7", Rubric.ANY, Mode.NO_IMPACT, (), None, "R3", "T1", 1995, 1, name="None"),
    Formula("f8", Rubric.ANY, Mode.ALL_LINES, (("BASE_PAY", 5),), None, "R4", "T1", 2000, 1, active=False,
            name="Withdrawn"),
    Formula("f9", Rubric.PAID_ELSEWHERE, Mode.EXTRA_LINES, (("GROSS_PAY", 1),), None, "R5", "T1", 1996, 1,
            name="Gross of further payments"),
    Formula("f10", Rubric.DUPLICATE_NAME, Mode.ONE_PER_PERSON, (("NET_PAY", 1),), "IO", "R4", "T1", 1995, 1,
            name="Net once"),
]

INSTITUTION_NAMES = {"IF": "Institution F", "IO": "Institution O"}

UPPER_KEY = "regexp_replace(upper(strip_accents({})),'[^A-Z0-9]','','g')"

PAY_SQL = f"""
raw_pay AS (
  SELECT cast(o_orderkey AS varchar) AS line_id, o_orderkey AS source_row,
    'E' || cast(o_orderkey % 7 AS varchar) AS execution_id, 'I' || o_orderstatus AS institution_id,
    'R' || substr(o_orderpriority, 1, 1) AS regime, 'T' || cast(quarter(o_orderdate) AS varchar) AS quarter,
    cast(year(o_orderdate) AS integer) AS year, c_custkey AS agent_no,
    CASE WHEN c_custkey % 20 = 0 THEN 'N.U' WHEN c_custkey % 20 = 1 THEN ''
      WHEN c_custkey % 3 = 0 THEN 'mat-' || cast(c_custkey AS varchar)
      ELSE 'MAT ' || cast(c_custkey AS varchar) END AS raw_id,
    CASE WHEN c_custkey % 37 = 1 THEN ''
      WHEN c_custkey % 11 = 3 AND substr(o_orderpriority, 1, 1) = '2' THEN 'Agént X' || cast(c_custkey % 600 AS varchar)
      ELSE 'Agént ' || cast(c_custkey % 600 AS varchar) END AS last_name,
    c_mktsegment AS category, n_name AS province,
    'G' || cast(CASE WHEN c_custkey % 8 = 0 THEN o_orderkey % 3 ELSE c_custkey % 3 END AS varchar) AS grade,
    'U' || cast(c_custkey % 9 AS varchar) AS unit,
    'Tab_R' || substr(o_orderpriority, 1, 1) || '_T' || cast(quarter(o_orderdate) AS varchar) || '_' ||
      cast(year(o_orderdate) AS varchar) AS source_table,
    cast(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal ELSE o_totalprice END AS decimal(18,2)) AS base_pay,
    cast(c_custkey % 7 * 10 AS decimal(18,2)) AS transport, cast(c_custkey % 3 * 25 AS decimal(18,2)) AS bonus,
    cast(c_custkey % 5 * 5 AS decimal(18,2)) AS deductions
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
pay AS (
  SELECT *, '' AS first_name, {UPPER_KEY.format('raw_id')} AS staff_key, {UPPER_KEY.format('last_name')} AS name_key,
    cast(base_pay + transport + bonus AS decimal(18,2)) AS gross_pay,
    cast(base_pay + transport + bonus - deductions AS decimal(18,2)) AS net_pay
  FROM raw_pay),
declared AS (
  SELECT 'D' || cast(agent_no AS varchar) || institution_id || regime || quarter || cast(year AS varchar) AS declared_id,
    'V' || institution_id AS execution_id, agent_no, institution_id, regime, quarter, year,
    min(staff_key) AS staff_key, min(name_key) AS name_key, min(source_row) AS source_row,
    'U' || cast(agent_no % 9 AS varchar) AS service
  FROM (
    SELECT agent_no, institution_id, regime, quarter, year, staff_key, name_key, source_row
    FROM pay WHERE source_row % 10 < 6
    UNION ALL
    SELECT agent_no, institution_id, 'R' || cast(cast(substr(regime, 2, 1) AS integer) % 5 + 1 AS varchar),
      quarter, year, staff_key, name_key, source_row
    FROM pay WHERE source_row % 10 = 9)
  GROUP BY agent_no, institution_id, regime, quarter, year),
listing AS (SELECT * FROM pay WHERE institution_id <> 'IF' OR category = 'BUILDING'),
journal AS (
  SELECT execution_id, institution_id, regime, quarter, year, 'IMPORT_PAY' AS operation,
    'pay_' || execution_id || '.csv' AS source_file, count(*) AS rows_loaded, 'DONE' AS status,
    make_date(year, cast(substr(quarter, 2, 1) AS integer) * 3, 1) AS finished_on
  FROM pay GROUP BY ALL
  UNION ALL
  SELECT execution_id, institution_id, regime, quarter, year, 'IMPORT_DECLARED',
    'declared_' || institution_id || '.csv', count(*),
    CASE WHEN year = 1995 THEN 'DELETED' ELSE 'DONE' END,
    make_date(year, cast(substr(quarter, 2, 1) AS integer) * 3, 1)
  FROM declared GROUP BY ALL)
"""


def with_views(body: str, *more: str) -> str:
    """A SQL statement over the derived tables; ``more`` adds further table expressions."""
    return "WITH " + ",\n".join([PAY_SQL.strip(), *[m.strip() for m in more]]) + "\n" + body


#: Tables written in this session: (application, state of the source files, name) to path and layout.
WRITTEN: dict[tuple, tuple[str, T.StructType]] = {}


class Views:
    """The given tables of one folder and the lines derived from them.

    Listings are standardised once and analysed many times, so the standard
    tables are written once per session, one folder per period, and every
    analysis starts from a scan that reads only the columns and periods it needs.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def written(self, name: str, build: Callable[[], DataFrame], finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The finished rows of a build, one folder per period. What moves is the build; ``finish`` widens it in place."""
        key = (self.spark.sparkContext.applicationId, self.source_state(), name)
        if key not in WRITTEN:
            rows, path = finish(build().hint("rebalance", *PERIOD)), scratch_path(self.spark, name)
            with many_folders(self.spark):
                rows.write.partitionBy(*PERIOD).option("compression", "zstd").parquet(path)
            WRITTEN[key] = (path, rows.schema)
        path, schema = WRITTEN[key]
        return self.spark.read.schema(schema).parquet(path).select(*schema.names)

    def source_state(self) -> tuple:
        """Path, size and time of the files that pay and declared lines are derived from: changed files are read anew."""
        path_of, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        paths = [path_of(f"{self.folder}/{name}.parquet") for name in ("orders", "customer", "nation")]
        found = [status for path in paths for status in path.getFileSystem(conf).listStatus(path)]
        return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))

    @cached_property
    def pay(self) -> DataFrame:
        """Standard pay lines."""
        return self.written("pay_line", lambda: self.source_lines, lambda rows: self.standard_of(self.raw_of(rows)))

    @cached_property
    def declared(self) -> DataFrame:
        """Standard declared lines."""
        return self.written("declared_line", lambda: self.declared_people, self.declared_of)

    @cached_property
    def source_lines(self) -> DataFrame:
        """The columns of the given tables that a listing line is made of, with its period."""
        people = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return self.table("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "c_custkey", "c_mktsegment", "c_acctbal", "n_name",
            F.concat(F.lit("T"), F.quarter("o_orderdate").cast("string")).alias("quarter"), F.year("o_orderdate").alias("year"),
        )

    @cached_property
    def raw_pay(self) -> DataFrame:
        """Listing lines as they would arrive: text identifiers, names and amounts."""
        return self.raw_of(self.source_lines)

    def raw_of(self, rows: DataFrame) -> DataFrame:
        agent, text_of = F.col("c_custkey"), lambda c: c.cast("string")
        regime_no = F.substring("o_orderpriority", 1, 1)
        raw_id = (
            F.when(agent % 20 == 0, "N.U")
            .when(agent % 20 == 1, "")
            .when(agent % 3 == 0, F.concat(F.lit("mat-"), text_of(agent)))
            .otherwise(F.concat(F.lit("MAT "), text_of(agent)))
        )
        name_no = text_of(agent % 600)
        last_name = (
            F.when(agent % 37 == 1, "")
            .when((agent % 11 == 3) & (regime_no == "2"), F.concat(F.lit("Agént X"), name_no))
            .otherwise(F.concat(F.lit("Agént "), name_no))
        )
        money = lambda c: c.cast(MONEY)
        return rows.select(
            text_of(F.col("o_orderkey")).alias("line_id"),
            F.col("o_orderkey").alias("source_row"),
            F.concat(F.lit("E"), text_of(F.col("o_orderkey") % 7)).alias("execution_id"),
            F.concat(F.lit("I"), "o_orderstatus").alias("institution_id"),
            F.concat(F.lit("R"), regime_no).alias("regime"),
            "quarter",
            "year",
            agent.alias("agent_no"),
            raw_id.alias("raw_id"),
            last_name.alias("last_name"),
            F.lit("").alias("first_name"),
            F.col("c_mktsegment").alias("category"),
            F.col("n_name").alias("province"),
            F.concat(F.lit("G"), text_of(F.when(agent % 8 == 0, F.col("o_orderkey") % 3).otherwise(agent % 3))).alias("grade"),
            F.concat(F.lit("U"), text_of(agent % 9)).alias("unit"),
            F.concat(F.lit("Tab_R"), regime_no, F.lit("_"), "quarter", F.lit("_"), text_of(F.col("year"))).alias("source_table"),
            money(F.when(agent % 4 == 0, F.col("c_acctbal")).otherwise(F.col("o_totalprice"))).alias("base_pay"),
            money(agent % 7 * 10).alias("transport"),
            money(agent % 3 * 25).alias("bonus"),
            money(agent % 5 * 5).alias("deductions"),
        )

    def standard_of(self, raw: DataFrame) -> DataFrame:
        gross = (F.col("base_pay") + F.col("transport") + F.col("bonus")).cast(MONEY)
        zero = F.lit(0).cast(MONEY)
        columns = raw.columns
        absent = [zero.alias(c) for c in GROSS_PARTS if c not in columns]
        return raw.select(
            *columns,
            *absent,
            normalise(F.col("raw_id")).alias("staff_key"),
            normalise(F.concat("last_name", "first_name")).alias("name_key"),
            gross.alias("gross_pay"),
            (gross - F.col("deductions")).cast(MONEY).alias("net_pay"),
            F.lit(None).cast("map<string,decimal(18,2)>").alias("extra_components"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        """Pay lines that the business filters keep."""
        return self.pay.where(retained(RULES))

    @cached_property
    def declared_people(self) -> DataFrame:
        """One row per person and scope that is declared."""
        base = self.pay.select("agent_no", *SCOPE, "staff_key", "name_key", "source_row")
        slot = F.col("source_row") % 10
        next_regime = F.concat(F.lit("R"), (F.substring("regime", 2, 1).cast("int") % 5 + 1).cast("string"))
        kept = base.where((slot < 6) | (slot == 9)).withColumn(
            "regime", F.when(slot == 9, next_regime).otherwise(F.col("regime"))
        )
        return kept.groupBy("agent_no", *SCOPE).agg(
            F.min("staff_key").alias("staff_key"),
            F.min("name_key").alias("name_key"),
            F.min("source_row").alias("source_row"),
        )

    def declared_of(self, people: DataFrame) -> DataFrame:
        agent = F.col("agent_no").cast("string")
        return people.select(
            F.concat(F.lit("D"), agent, "institution_id", "regime", "quarter", F.col("year").cast("string")).alias(
                "declared_id"
            ),
            F.concat(F.lit("V"), "institution_id").alias("execution_id"),
            "agent_no",
            *SCOPE,
            "staff_key",
            "name_key",
            "source_row",
            F.concat(F.lit("U"), (F.col("agent_no") % 9).cast("string")).alias("service"),
        )

    @cached_property
    def journal(self) -> DataFrame:
        """One entry per import and scope; the imports of the first year are withdrawn."""
        finished = F.make_date("year", F.substring("quarter", 2, 1).cast("int") * 3, F.lit(1))
        entries = []
        for lines, operation, name in (
            (self.pay, "IMPORT_PAY", F.concat(F.lit("pay_"), "execution_id", F.lit(".csv"))),
            (self.declared, "IMPORT_DECLARED", F.concat(F.lit("declared_"), "institution_id", F.lit(".csv"))),
        ):
            withdrawn = (F.col("year") == 1995) if operation == "IMPORT_DECLARED" else F.lit(False)
            counted = lines.groupBy("execution_id", *SCOPE).agg(F.count(F.lit(1)).alias("rows_loaded"))
            entries.append(
                counted.select(
                    "execution_id", *SCOPE, F.lit(operation).alias("operation"), name.alias("source_file"), "rows_loaded",
                    F.when(withdrawn, "DELETED").otherwise("DONE").alias("status"), finished.alias("finished_on"),
                )
            )
        return entries[0].unionByName(entries[1])

    @cached_property
    def full_journal(self) -> DataFrame:
        """The journal in its stored layout."""
        entries = self.journal.withColumns({
            "mode": F.lit("append"), "rows_read": F.col("rows_loaded"), "message": F.lit(None).cast("string"),
            "logged_at": F.col("finished_on").cast("timestamp"),
        })
        return entries.select(*JOURNAL.names)

    @cached_property
    def formula_rows(self) -> DataFrame:
        """One formula per order, of a few named institutions, of all of them or of one per customer."""
        k = F.col("o_orderkey")
        pick = lambda values, number: F.get(F.array(*[F.lit(x) for x in values]), (number % len(values)).cast("int"))
        own = F.concat(F.lit("I"), F.col("o_custkey").cast("string"))
        term = lambda code, value: F.struct(F.lit(code).alias("code"), value.cast("decimal(12,4)").alias("coefficient"))
        return self.table("orders").select(
            F.concat(F.lit("B"), k.cast("string")).alias("formula_id"), pick(Rubric.ALL, F.floor(k / 3)).alias("rubric"),
            pick(Mode.ALL, F.floor(k / 7)).alias("mode"),
            F.array(term("BASE_PAY", (k % 400 - 200) / 100), term("BONUS", (k % 7) / 8), term("DEDUCTIONS", F.lit(-1))).alias("terms"),
            F.when(k % 5 == 4, own).otherwise(pick([None, "IF", "IO", "IP", None], k)).alias("institution_id"),
            F.when(k % 11 > 0, F.concat(F.lit("R"), (k % 5 + 1).cast("string"))).alias("regime"),
            F.concat(F.lit("T"), F.quarter("o_orderdate").cast("string")).alias("quarter"), F.year("o_orderdate").alias("year"),
            k.alias("version"), (k % 9 > 0).alias("active"),
        )

    @cached_property
    def institutions(self) -> DataFrame:
        """Official names; one institution has none."""
        return self.spark.createDataFrame(list(INSTITUTION_NAMES.items()), "institution_id string, official_name string")

