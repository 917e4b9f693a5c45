"""Raw tables: tab-separated text with bad-row quarantine, Parquet, inventories, schema checks, canonical columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """Every column as text, with a header line and no quoting; short rows are padded with nulls. Compressed files are read as they are."""
    reader = spark.read.option("sep", sep).option("header", columns is None).option("quote", "").option("escape", "").option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
    return reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path) if columns else reader.csv(path)


def parse_lines(lines: DataFrame, columns: list[str], sep: str = "\t", line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, bad rows): lines with more fields than columns are set apart; short ones are padded; empty fields are null."""
    parts = lines.withColumn("parts", F.split(F.col(line), sep, -1)).withColumn("fields", F.size("parts"))
    good = parts.filter(F.col("fields") <= len(columns))
    rows = good.select(*(F.nullif(F.get("parts", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)))
    return rows, parts.filter(F.col("fields") > len(columns)).select(line, "fields")


def strict_lines(lines: DataFrame, columns: list[str], sep: str = "\t", line: str = "value") -> DataFrame:
    """Like parse_lines, but a line with too many fields makes the job fail."""
    size = F.size(F.split(F.col(line), sep, -1))
    ok = F.when(size > len(columns), F.raise_error(F.concat(F.lit("too many fields: "), size.cast("string")))).otherwise(F.col(line))
    return parse_lines(lines.withColumn(line, ok), columns, sep, line)[0]


def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet with zstandard compression."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_small(df: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """One file of a small table, as CSV with a header or as JSON lines."""
    writer = df.coalesce(1).write.mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size and compression of each file under a folder, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.when(name.endswith(".gz"), "gzip").otherwise("none").alias("compression"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and schema of each table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), F.lit(",".join(df.columns)).alias("column_list")) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_schemas(found: DataFrame, expected: DataFrame) -> DataFrame:
    """ok, missing or column_mismatch for each expected table (table_name, column_list), columns in order."""
    j = expected.withColumnRenamed("column_list", "want").join(found.select("table_name", "column_list"), "table_name", "left")
    return j.select("table_name", F.when(F.col("column_list").isNull(), "missing").when(F.col("column_list") == F.col("want"), "ok").otherwise("column_mismatch").alias("status"))


def project(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns with their types; one that the table lacks is null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(F.col(have[c.lower()]).cast(t).alias(c) if c.lower() in have else F.lit(None).cast(t).alias(c) for c, t in wanted.items()))


def canonical(df: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """The first candidate column that exists for each role, under the role's name; exact names win over names that hold all parts of a candidate."""
    have = {c.lower(): c for c in df.columns}

    def find(candidates: list[str]) -> str | None:
        for c in candidates:
            if c.lower() in have:
                return have[c.lower()]
        for c in candidates:
            for low, name in have.items():
                if all(p in low for p in c.lower().split("_")):
                    return name
        return None

    found = {role: find(c) for role, c in roles.items()}
    return df.select(*((F.col(c) if c else F.lit(None).cast("string")).alias(role) for role, c in found.items()))
