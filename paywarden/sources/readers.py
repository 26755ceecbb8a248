"""Raw listings and declarations as all-text tables with their row number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from paywarden.session import scratch_path

#: First data line of a sheet: line 1 is the header.
FIRST_ROW = 2

# Regimes recognised by the name of their source table, in this order.
REGIME_PATTERNS = {
    "AUTRES_REGIMES": r"^Tab_AutresRegimes_T[1-4]_\d{4}$",
    "FARDC": r"^Tab_FARDC_T[1-4]_\d{4}$",
    "INSTITUTIONS_POLITIQUES": r"^Tab_InstitutionsPolitiques_T[1-4]_\d{4}$",
    "PNC": r"^Tab_PNC_T[1-4]_\d{4}$",
    "SECOPE_FF": r"^Tab_SECOPE_FF_T[1-4]_\d{4}$",
    "SECOPE": r"^Tab_SECOPE_T[1-4]_\d{4}$",
}
# Fixed value: quarter and year at the end of a source table name.
PERIOD_PATTERN = r"(?i)_(T[1-4])_(\d{4})$"


def detect_regime(name: Column, patterns: dict[str, str] = REGIME_PATTERNS) -> Column:
    """Regime of a table name; the first pattern that fits the whole name wins."""
    return F.coalesce(*[F.when(name.rlike(f"(?i)^(?:{p})$"), F.lit(code)) for code, p in patterns.items()])


def detect_quarter(name: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(name, PERIOD_PATTERN, 1)), F.lit(""))


def detect_year(name: Column) -> Column:
    return F.regexp_extract(name, PERIOD_PATTERN, 2).try_cast("int")


#: What readers add to the columns of a source: the row in its file, and the file.
OWN_COLUMNS = ["source_row", "source_path"]


def all_text(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet keeps the position of a row in its file."""
    rows = spark.read.parquet(path)
    own = [(F.col("_metadata.row_index") + FIRST_ROW).alias("source_row"), F.col("_metadata.file_path").alias("source_path")]
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns], *own)


def read_jdbc(spark: SparkSession, url: str, table: str, order: list[str], partition: dict | None = None, **options) -> DataFrame:
    """A table of an external database, numbered in a given order: a database keeps none.

    ``partition`` (partitionColumn, lowerBound, upperBound, numPartitions) lets several tasks read the table;
    without it a single one does.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options, **(partition or {}))
    return number_by(all_text(reader.load()), order)


def number_by(rows: DataFrame, order: list[str]) -> DataFrame:
    """Dense row numbers in the order of some columns.

    The rows are dealt out by ranges and written, so that both passes see the same ranges. A number is the
    place in the range plus the rows of the ranges before, of which there is one count each.
    """
    path = scratch_path(rows.sparkSession, "numbered")
    rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = placed.withColumn("_inside", inside).join(starts, "_range")
    return numbered.select(*rows.columns, (F.col("_start") + F.col("_inside") - 1 + FIRST_ROW).alias("source_row"))


def number_lines(lines: DataFrame, out: str) -> DataFrame:
    """Number the lines of each text file from 1, in file order, and keep the file as ``source_path``.

    Spark numbers the lines of a task; a task reads whole blocks of a file one
    after the other. So the number in the block is a difference, and the lines of
    earlier blocks are added from a table with one row per block. Both passes
    plan the same files under the same settings and so get the same blocks; a
    number that contradicts the count of its block stops the query.
    """
    block = ["source_path", "file_start"]
    placed = lines.select(
        "*",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("file_start"),
        F.monotonically_increasing_id().alias("position"),
    )
    blocks = placed.groupBy(*block).agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_path").orderBy("file_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*block, "first", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.col("position") - F.col("first")
    number = F.when((inside >= 0) & (inside < F.col("n")), inside + F.col("before") + 1).otherwise(
        F.raise_error(F.lit("The blocks of a text file changed while it was read."))
    )
    return placed.join(offsets, block).withColumn(out, number).drop("file_start", "position", "first", "n", "before")


def header_names(lines: DataFrame, header_row: int, sep: str) -> list[str]:
    header = lines.where(F.col("line_no") == header_row).select("value").first()
    if header is None:
        raise ValueError("The file has no header line.")
    layout = ", ".join(f"c{i} string" for i in range(header.value.count(sep) + 1))
    one = lines.sparkSession.createDataFrame([(header.value,)], "value string")
    names = one.select(F.from_csv("value", layout, {"sep": sep, "escape": '"'}).alias("h")).select("h.*").first()
    return [n.lstrip("\ufeff") for n in names if n is not None]


def read_csv(spark: SparkSession, path: str, header_row: int = 1, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """A CSV file or folder of files as text columns with their row number and file.

    The header may stand on any line; lines above it are left out. Every file
    has the same header. By default a record is a line, so that large files are
    read in blocks; a quoted line break then stops the query. With
    ``multi_line`` one task reads a whole file, records may span lines, and row
    numbers count records.
    """
    if header_row < 1:
        raise ValueError("The header row is 1 or more.")
    lines = number_lines(spark.read.text(path), "line_no")
    names = header_names(lines, header_row, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if multi_line:
        return read_records(spark, path, schema, sep)
    ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
    data = lines.where((F.col("line_no") > header_row) & (F.trim("value") != ""))
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    whole = F.when(quotes % 2 == 0, F.col("value")).otherwise(
        F.raise_error(F.lit("A quoted field spans lines. Read the file with multi_line=True."))
    )
    parsed = data.select(
        F.from_csv(whole, ddl, {"sep": sep, "escape": '"'}).alias("row"),
        (F.col("line_no") - header_row + 1).alias("source_row"), "source_path",
    )
    return parsed.select("row.*", *OWN_COLUMNS)


def read_records(spark: SparkSession, path: str, schema: T.StructType, sep: str) -> DataFrame:
    """Records behind the header, which is the first record that consists of the column names."""
    options = {"sep": sep, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
               "emptyValue": "", "nullValue": "\0", "header": False}
    rows = spark.read.options(**options).schema(schema).csv(path).select(
        "*", F.col("_metadata.file_path").alias("source_path"), F.monotonically_increasing_id().alias("position")
    )
    is_header = reduce(
        lambda a, b: a & b, [F.ltrim(F.col(f"`{n}`"), F.lit("\ufeff")).eqNullSafe(F.lit(n)) for n in schema.names]
    )
    headers = rows.where(is_header).groupBy("source_path").agg(F.min("position").alias("header"))
    data = rows.join(headers, "source_path").where(F.col("position") > F.col("header"))
    return data.select(*[F.col(f"`{n}`") for n in schema.names], (F.col("position") - F.col("header") + 1).alias("source_row"), "source_path")


def preview_csv(spark: SparkSession, path: str, header_row: int = 1, rows: int = 20) -> DataFrame:
    return read_csv(spark, path, header_row).orderBy("source_row").limit(rows)
