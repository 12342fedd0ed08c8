"""JSON-lines and JSON documents, canonical sinks, environment files and word tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, *, line_numbers: bool = False, allow_empty: bool = True) -> DataFrame:
    """One object per non-blank line (newline only); a line that isn't an object of the schema raises when it is read.

    line_numbers adds line_no: the place of the line in its file, from 1. Files are numbered apart, and a
    file's lines are numbered together, so it is for inputs of which each file fits one task.
    """
    if not line_numbers:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
        lines = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("_file").orderBy("_at"))).where(F.trim("value") != "")
        parsed = F.from_json("value", schema if isinstance(schema, str) else schema.json(), {"mode": "FAILFAST"})
        rows = lines.select("line_no", parsed.alias("r")).select("line_no", "r.*")
    if not allow_empty and rows.isEmpty():
        raise ValueError(f"no records in {path}")
    return rows


def read_variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """value (VARIANT) and is_object for lines of any shape."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.try_parse_json("value").alias("value")).withColumn("is_object", F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False)))


def read_json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A whole file as one object: typed columns with a schema, else one VARIANT column."""
    if schema is not None:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("value"))


def canonical_lines(rows: DataFrame) -> DataFrame:
    """value: each row as compact JSON with keys in order and nulls kept."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(rows: DataFrame, path: str, *, order: list[str] | None = None, single: bool = False) -> None:
    """Canonical lines, committed as a whole by the job committer; an existing path raises.

    order sorts the output over all files; single (for small reports) writes one file.
    """
    rows = rows.orderBy(*order) if order else rows
    lines = canonical_lines(rows)
    (lines.coalesce(1) if single else lines).write.mode("errorifexists").text(path)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row report as one JSON document."""
    write_jsonl(row.limit(1), path, single=True)


def write_metric_csv(long_rows: DataFrame, path: str) -> None:
    """Long metric rows with a header; an existing path raises."""
    long_rows.write.mode("errorifexists").option("header", True).csv(path)


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """name, value of KEY=value lines: blanks and comments skipped, `export ` and quotes dropped; other lines raise."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^export\s+", "").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    fine = F.when(~F.col("line").rlike(r"^[A-Za-z_][A-Za-z0-9_]*="), F.raise_error(F.concat(F.lit("not KEY=value: "), F.substring_index("line", "=", 1)))).otherwise(F.lit(True))
    parts = F.split("line", "=", 2)
    return lines.where(fine).select(parts[0].alias("name"), F.regexp_replace(F.trim(parts[1]), r"^([\"'])(.*)\1$", "$2").alias("value"))


def read_word_table(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words of a tab-separated table: text, x, y, w, h, line key; blanks and unreadable numbers dropped."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    number = lambda c: F.col(c).try_cast("int")
    rows = raw.select(
        F.trim("text").alias("text"), number("left").alias("x"), number("top").alias("y"), number("width").alias("w"), number("height").alias("h"),
        F.concat_ws("/", "block_num", "par_num", "line_num").alias("line_key"), number("word_num").alias("word_num"),
    )
    return rows.where("text <> '' AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL")


def append_events(events: DataFrame, path: str) -> None:
    """An append-only log: events gain logged_at."""
    events.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
