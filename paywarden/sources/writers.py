"""Tables partitioned by scope, exports, and the journal of imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F, types as T

from paywarden.functions.text import sanitise
from paywarden.schema import SCOPE
from paywarden.session import many_folders

JOURNAL = T.StructType(
    [
        T.StructField("execution_id", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("institution_id", T.StringType()),
        T.StructField("regime", T.StringType()),
        T.StructField("quarter", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("mode", T.StringType()),
        T.StructField("rows_read", T.LongType()),
        T.StructField("rows_loaded", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("logged_at", T.TimestampType()),
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def drop_partition(spark: SparkSession, path: str, scope: dict[str, object]) -> bool:
    """Remove the files of one scope."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = "/".join([path.rstrip("/"), *[f"{c}={escape(str(scope[c]))}" for c in SCOPE]])
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def by_scope(lines: DataFrame) -> DataFrame:
    """Lines of a scope together, so that it gets few files; Spark splits a scope too large for one task."""
    return lines.hint("rebalance", *SCOPE)


def append_lines(lines: DataFrame, path: str) -> None:
    """Add lines to a table, partitioned by scope."""
    by_scope(lines).write.partitionBy(*SCOPE).mode("append").parquet(path)


def append_by_name(table: DataFrame, lines: DataFrame) -> DataFrame:
    """Union by column name; columns only one side has are null in the other."""
    return table.unionByName(lines, allowMissingColumns=True)


def with_lineage(raw: DataFrame, execution_id: str | Column, quarter, year) -> DataFrame:
    """Raw lines with their import and period."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return raw.withColumns(
        {"execution_id": as_column(execution_id), "quarter": as_column(quarter), "year": as_column(year).cast("int")}
    )


def write_raw(raw: DataFrame, path: str) -> None:
    """Source columns as they came, one folder per period. New columns may come with later imports."""
    raw.hint("rebalance", "year", "quarter").write.partitionBy("year", "quarter").mode("append").parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def replace_scopes(lines: DataFrame, path: str, scopes: list[dict[str, object]] = ()) -> None:
    """Put lines in place of what their scopes hold.

    Spark moves the new files in place of the old ones when all of them are
    written, so a failure leaves the table as it was. That only touches scopes
    with new lines; scopes named in ``scopes`` that got none are emptied after it.
    """
    spark = lines.sparkSession
    filled = {tuple(map(str, row)) for row in lines.select(*SCOPE).distinct().collect()} if scopes else set()
    by_scope(lines).write.partitionBy(*SCOPE).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for scope in scopes:
        if tuple(str(scope[c]) for c in SCOPE) not in filled:
            drop_partition(spark, path, scope)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table by its fixed layout; scopes in the folder names are not guessed at."""
    return spark.read.schema(schema).parquet(path)


def counted(lines: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Lines that count themselves while they are written."""
    observation = Observation(name)
    return lines.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def journal_entry(spark: SparkSession, **values) -> DataFrame:
    row = Row(**{f.name: values.get(f.name) for f in JOURNAL.fields if f.name != "logged_at"})
    return spark.createDataFrame([row], T.StructType(JOURNAL.fields[:-1])).withColumn("logged_at", F.current_timestamp())


def current_journal(journal: DataFrame) -> DataFrame:
    """The latest entry of each import; the journal itself only grows."""
    latest = F.max_by(F.struct(*journal.columns), F.struct("logged_at", "status")).alias("entry")
    return journal.groupBy("execution_id", "institution_id", "regime", "quarter", "year").agg(latest).select("entry.*")


def sanitised(rows: DataFrame) -> DataFrame:
    """All text columns as sheet cells accept them."""
    return rows.select(
        *[sanitise(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
          for f in rows.schema.fields]
    )


def export_csv(rows: DataFrame, path: str, single_file: bool = False, bom: bool = False) -> None:
    """CSV with a header and the text as it is; null is an empty field, empty text a quoted one.

    One file only if asked for: it makes one task write everything. ``bom`` puts the mark that
    spreadsheets look for before the header of every file.
    """
    out = rows.coalesce(1) if single_file else rows
    if bom:
        out = out.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    options = {"header": True, "encoding": "UTF-8", "escape": '"', "emptyValue": '""', "nullValue": "",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    out.write.mode("overwrite").options(**options).csv(path)


def export_parts(rows: DataFrame, path: str, by: str, fmt: str = "parquet") -> None:
    """One folder per annex, status or other value, in a single pass: every task adds its rows to the folders.

    The rows neither move nor are sorted for it; a folder gets at most one file per task.
    """
    options = {"compression": "zstd"} if fmt == "parquet" else {}
    with many_folders(rows.sparkSession):
        rows.write.partitionBy(by).mode("overwrite").format(fmt).options(**options).save(path)
