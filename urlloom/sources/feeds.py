"""Feed readers: every row becomes (source, label, row_number, url_raw, error)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlloom.functions.seeds import draw_positions
from urlloom.functions.urls import strip

PARSED = "source string, label int, row_number bigint, url_raw string, error string"
#: Fixed order: which source stands for a URL that several have.
SOURCES = ("phishtank", "openphish", "tranco")
_MISSING = "missing URL"


def _parsed(df: DataFrame, source: str, label: int, url: Column, number: Column, error: Column | None = None) -> DataFrame:
    text = strip(url)
    usable = text.isNotNull() & (text != "")
    error = F.when(~F.coalesce(usable, F.lit(False)), _MISSING) if error is None else error
    return df.select(
        F.lit(source).alias("source"), F.lit(label).alias("label"), number.cast("bigint").alias("row_number"), F.when(error.isNull(), text).alias("url_raw"), error.alias("error")
    )


def numbered(rows: DataFrame, name: str = "number") -> DataFrame:
    """Rows of a scan (and of narrow steps on it) with their number from 0, in file order.

    Tasks count their rows, the counts (one a task) are summed up, and each task adds its start: two scans, no
    shuffle of rows.
    """
    local = rows.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = local.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(F.col("_task").alias("_t"), F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return local.join(F.broadcast(starts), F.col("_task") == F.col("_t")).select(*rows.columns, (F.col("_start") + F.col("_at")).alias(name))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number from 1, line) of a text file, blank lines included, without byte-order mark."""
    lines = numbered(spark.read.text(path).select(F.col("value").alias("line")))
    bare = F.when(F.col("number") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    return lines.select((F.col("number") + 1).alias("number"), bare.alias("line"))


def numbered_csv(spark: SparkSession, path: str, columns: list[str], header: bool) -> DataFrame:
    """Rows of a CSV file in file order with their number from 0; a file with quoted line breaks is one task's."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return numbered(spark.read.schema(schema).csv(path, header=header, multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=True))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.csv(path, header=False, multiLine=True, escape='"').first()
    return [] if first is None else [("" if x is None else x).removeprefix("﻿") for x in first]


def phishtank(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a url column (rows from 2), or JSON: an array, or an object with data or urls (rows from 1)."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        header = csv_header(spark, path)
        if "url" not in header:
            raise ValueError("the CSV feed needs a url column")
        rows = numbered_csv(spark, path, header, header=True)
        return _parsed(rows, "phishtank", 1, F.col("url"), F.col("number") + 2)
    if kind == "json":
        whole = spark.read.text(path, wholetext=True).select(F.parse_json(F.regexp_replace("value", "^﻿", "")).alias("v"))
        kept = whole.select(F.coalesce(F.try_variant_get("v", "$.data", "variant"), F.try_variant_get("v", "$.urls", "variant"), "v").alias("v"))
        if not kept.filter("schema_of_variant(v) LIKE 'ARRAY%'").head(1):
            raise ValueError("the JSON feed must be an array or hold one in data or urls")
        items = spark.sql("SELECT pos, value FROM {kept}, LATERAL variant_explode(v)", kept=kept)
        url = F.coalesce(F.try_variant_get("value", "$.url", "string"), F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string")))
        return _parsed(items, "phishtank", 1, url, F.col("pos") + 1)
    raise ValueError("the feed must be a .csv or .json file")


def openphish(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(numbered_lines(spark, path), "openphish", 1, F.col("line"), F.col("number"))


def tranco(spark: SparkSession, path: str) -> DataFrame:
    """Ranked domains; a first line rank,domain is a header; each domain becomes its https root."""
    lines = numbered_lines(spark, path)
    cells = lines.select("number", F.from_csv("line", F.lit("rank string, domain string")).alias("c"), "line").select("number", "c.rank", "c.domain", "line")
    header = (F.col("number") == 1) & (F.lower(F.trim("rank")) == "rank") & (F.lower(F.trim("domain")) == "domain")
    rows = cells.filter(~F.coalesce(header, F.lit(False)))
    good = F.coalesce(F.trim("rank").rlike(r"^\p{Nd}+$") & (F.trim("domain") != ""), F.lit(False))
    error = F.when(~good, "expected numeric rank and domain")
    return _parsed(rows, "tranco", 0, F.concat(F.lit("https://"), F.trim("domain"), F.lit("/")), F.col("number"), error)


def read_feeds(spark: SparkSession, phishtank_path: str, openphish_path: str, tranco_path: str) -> DataFrame:
    return phishtank(spark, phishtank_path).unionByName(openphish(spark, openphish_path)).unionByName(tranco(spark, tranco_path))


def ranked_candidates(spark: SparkSession, path: str, rank_min: int, rank_max: int, sample: int, seed: int | None = None) -> DataFrame:
    """(rank, domain) within a rank range, all or those that the standard library's generator draws with ``seed``.

    An error if there are fewer than the sample needs. Only positions reach the driver.
    """
    lines = spark.read.text(path).select(F.from_csv(F.regexp_replace("value", "^\ufeff", ""), F.lit("rank string, domain string")).alias("c")).select("c.*")
    found = lines.filter(F.trim("rank").rlike(r"^\d+$") & F.col("domain").isNotNull()).select(F.trim("rank").cast("int").alias("rank"), F.lower(F.trim("domain")).alias("domain"))
    found = found.filter(F.col("rank").between(rank_min, rank_max))
    n = found.count()
    if n < sample:
        raise ValueError("fewer candidates in the range than the sample needs")
    if seed is None:
        return found
    drawn = spark.createDataFrame([(x,) for x in draw_positions(seed, n, sample)], "number bigint")
    return numbered(found).join(F.broadcast(drawn), "number", "left_semi").drop("number")


def pinned_json_array(spark: SparkSession, path: str, sha256: str, source: str, label: int) -> DataFrame:
    """An array of strings whose bytes have the given SHA-256; rows from 1."""
    whole = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("digest"))
    if whole.select("digest").first()[0] != sha256.lower():
        raise ValueError("checksum of the source does not match")
    values = whole.select(F.from_json(F.decode("content", "UTF-8"), "array<string>").alias("urls"))
    if values.filter("urls IS NULL OR exists(urls, x -> x IS NULL)").head(1):
        raise ValueError("the source must be an array of strings")
    rows = values.select(F.posexplode("urls").alias("at", "url"))
    return _parsed(rows, source, label, F.col("url"), F.col("at") + 1)


def sha256_file(path: str) -> str:
    with open(path, "rb") as data:
        return hashlib.file_digest(data, "sha256").hexdigest()


DATASET = ["url_raw", "url_clean", "label", "source", "registered_domain"]


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A prepared dataset: exactly the five columns, in order, labels written 0 or 1."""
    if csv_header(spark, path) != DATASET:
        raise ValueError(f"the dataset must have exactly the columns {', '.join(DATASET)}")
    rows = spark.read.schema(", ".join(f"{c} string" for c in DATASET)).csv(path, header=True, multiLine=True, escape='"')
    if rows.filter(~F.coalesce(F.col("label").isin("0", "1"), F.lit(False))).head(1):
        raise ValueError("labels must be 0 or 1")
    return rows.withColumn("label", F.col("label").cast("int"))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = True) -> None:
    """A folder of CSV files with header, one for reports; refuses to overwrite."""
    rows = df.select(*(columns or df.columns))
    (rows.coalesce(1) if one_file else rows).write.mode("errorifexists").csv(path, header=True, escape='"')


def checksum_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
