"""From parsed feed rows to a balanced dataset and its reports.

Every input row gets one disposition: ``candidate`` rows stand for their URL, all others have
a reason. All reports are aggregates of that one table.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlloom.functions.seeds import derive_seed, draw_positions, unit, validate_seed
from urlloom.functions.suffixes import DEFAULT_RULES, SuffixRules
from urlloom.functions.urls import with_clean_urls
from urlloom.operators.draws import positioned, take_smallest
from urlloom.sources.feeds import DATASET, SOURCES, write_csv

#: Orders that pick the row that stands for a URL.
BY_PRIORITY = ("priority", "source", "url_raw", "row_number")
BY_INPUT = ("row_number",)
BY_SOURCE = ("source", "url_raw", "row_number")


def source_priority(source: Column) -> Column:
    known = F.array_position(F.array(*map(F.lit, SOURCES)), source)
    return F.when(known > 0, known - 1).otherwise(len(SOURCES)).cast("int")


def dispositions(rows: DataFrame, *, order: tuple[str, ...] = BY_PRIORITY, rules: SuffixRules = DEFAULT_RULES) -> DataFrame:
    """Parsed rows with url_clean, registered_domain and ``reason`` (null: candidate).

    Reasons: ``invalid: ...``, ``conflicting_label``, ``exact_duplicate``, ``normalized_duplicate``.
    One shuffle by clean URL (of valid rows only) carries all windows.
    """
    if dict(rows.dtypes)["label"] not in ("int", "bigint", "smallint", "tinyint"):
        raise ValueError("label must be integer 0 or 1")
    base = rows.select("source", "label", "row_number", "url_raw", "error", source_priority(F.col("source")).alias("priority"))
    parsed = with_clean_urls(base, rules=rules).select(*base.columns, F.col("reason").alias("url_reason"), "url_clean", "registered_domain")
    invalid = F.when(F.col("error").isNotNull() | F.col("url_raw").isNull(), F.coalesce("error", F.lit("missing URL"))).otherwise(F.col("url_reason"))
    parsed = parsed.withColumn("invalid", invalid)
    bad = parsed.filter("invalid IS NOT NULL").select(
        "source", "label", "row_number", "url_raw", F.lit(None).cast("string").alias("url_clean"), F.lit(None).cast("string").alias("registered_domain"), F.concat(F.lit("invalid: "), "invalid").alias("reason")
    )
    good = parsed.filter("invalid IS NULL")
    same, first = Window.partitionBy("url_clean"), Window.partitionBy("url_clean").orderBy(*order)
    raw = Window.partitionBy("url_clean", "url_raw").orderBy(*order)
    judged = good.select(
        "*",
        (F.min("label").over(same) != F.max("label").over(same)).alias("conflict"),
        F.row_number().over(first).alias("at"),
        F.row_number().over(raw).alias("raw_at"),
    )
    reason = F.when(F.col("conflict"), "conflicting_label").when(F.col("at") == 1, None).when(F.col("raw_at") > 1, "exact_duplicate").otherwise("normalized_duplicate")
    return judged.select("source", "label", "row_number", "url_raw", "url_clean", "registered_domain", reason.alias("reason")).unionByName(bad)


def conflicts(rows: DataFrame) -> DataFrame:
    """(url_clean, labels, sources, record_count) of URLs with both labels."""
    hit = rows.filter("reason = 'conflicting_label'")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ";")
    return hit.groupBy("url_clean").agg(joined("label").alias("labels"), joined("source").alias("sources"), F.count(F.lit(1)).alias("record_count"))


_POOL = ("url_clean", "source", "url_raw")


def sample_by_hash(rows: DataFrame, target: int, seed: int) -> DataFrame:
    """``selected`` for candidates: the k smallest of each class by a seeded hash of the URL.

    k is the smallest of the target and both class counts.
    """
    pool = rows.filter("reason IS NULL").select("label", "url_clean")
    counts = pool.groupBy().agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    limits = counts.select(F.least(F.lit(target), "n0", "n1").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    drawn = take_smallest(pool, ["label"], unit(seed, F.col("url_clean")), ["url_clean"], limits)
    return rows.join(drawn.withColumn("selected", F.lit(True)), ["label", "url_clean"], "left")


def sample_by_generator(rows: DataFrame, target: int, seed: int) -> DataFrame:
    """``selected`` for candidates: positions drawn on the driver from the class counts only.

    The 2 * ``target`` positions at most are broadcast; ``draws.positioned`` numbers the candidates.
    """
    pool = rows.filter("reason IS NULL")
    counts = {r["label"]: r["count"] for r in pool.groupBy("label").count().collect()}
    k = min(target, counts.get(0, 0), counts.get(1, 0))
    drawn = [(label, p) for label in (0, 1) for p in draw_positions(derive_seed(seed, f"class:{label}"), counts.get(label, 0), k)]
    positions = rows.sparkSession.createDataFrame(drawn, "label int, at long")
    chosen = positioned(pool, "label", list(_POOL)).join(F.broadcast(positions), ["label", "at"], "left_semi").select("label", "url_clean", F.lit(True).alias("selected"))
    return rows.join(chosen, ["label", "url_clean"], "left")


def balance(rows: DataFrame, target: int = 2000, seed: int = 42, mode: str = "parity") -> DataFrame:
    """Dispositions with ``selected``; candidates that are not drawn get the reason not_sampled.

    ``rows`` are persisted, as counts, draw and result all read them: URLs are parsed and dealt once.
    """
    if target < 1:
        raise ValueError("target per label must be at least 1")
    validate_seed(seed)
    rows = rows.persist()
    drawn = {"parity": sample_by_generator, "hash": sample_by_hash}[mode](rows, target, seed)
    selected = F.col("reason").isNull() & F.coalesce("selected", F.lit(False))
    return drawn.withColumn("candidate", F.col("reason").isNull()).withColumn("selected", selected).withColumn(
        "reason", F.when(F.col("reason").isNull() & ~F.col("selected"), "not_sampled").otherwise(F.col("reason"))
    )


def cleaning_summary(rows: DataFrame) -> DataFrame:
    """Counters for each source and a row ``total``; sources of the fixed order appear even without rows."""
    reason = lambda x: F.count_if(F.col("reason") == x)
    made = rows.rollup("source").agg(
        F.grouping("source").alias("is_total"),
        F.count(F.lit(1)).alias("raw_records"),
        F.count_if("selected").alias("accepted_records"),
        F.count_if(F.col("reason").isNotNull()).alias("invalid_or_rejected_records"),
        F.count_if(F.col("reason").startswith("invalid:")).alias("invalid_records"),
        reason("exact_duplicate").alias("exact_duplicates"),
        reason("normalized_duplicate").alias("normalized_duplicates"),
        reason("conflicting_label").alias("conflicting_label_records"),
        F.count_if(F.col("selected") & (F.col("label") == 1)).alias("final_phishing"),
        F.count_if(F.col("selected") & (F.col("label") == 0)).alias("final_legitimate"),
        F.count_distinct(F.when(F.col("selected"), F.col("registered_domain"))).alias("unique_registered_domains"),
    )
    named = made.withColumn("source", F.when(F.col("is_total") == 1, "total").otherwise(F.col("source"))).drop("is_total")
    every = rows.sparkSession.createDataFrame([(s,) for s in (*SOURCES, "total")], "source string")
    numbers = [c for c in named.columns if c != "source"]
    return named.join(every, "source", "full").na.fill(0, numbers).select("source", *numbers)


def source_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("raw_records"),
        F.count_if("candidate").alias("accepted_before_sampling"),
        F.count_if("selected").alias("selected_records"),
        F.count_distinct(F.when(F.col("selected"), F.col("registered_domain"))).alias("unique_registered_domains"),
    )


def sampling_manifest(rows: DataFrame, target: int, seed: int) -> dict:
    """Seeds, counts and the digest of the candidate pool, which is streamed in URL order."""
    pool = rows.filter("candidate")
    counts = {r["label"]: (r["n"], r["k"]) for r in pool.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("k")).collect()}
    digest, started = hashlib.sha256(b"["), False
    fields = ["url_raw", "url_clean", "label", "source", "registered_domain"]
    for r in pool.select(*fields).orderBy("url_clean").toLocalIterator():
        digest.update((", " if started else "").encode() + json.dumps(r.asDict(), sort_keys=True).encode())
        started = True
    digest.update(b"]")
    k = counts.get(0, (0, 0))[1]
    return {
        "sampling_seed": seed,
        "class_seeds": {str(label): derive_seed(seed, f"class:{label}") for label in (0, 1)},
        "candidate_pool_sha256": digest.hexdigest(),
        "target_per_label": target,
        "actual_per_label": k,
        "shortfall": k < target,
        "candidate_counts": {str(label): counts.get(label, (0, 0))[0] for label in (0, 1)},
    }


def first_wins(batches: list[DataFrame], names: list[str], key: str = "url_clean", cap_by: str | None = None, cap: int = 3) -> DataFrame:
    """Union of batches with their name and ``retained``: first batch wins for a key; at most ``cap`` by ``cap_by``."""
    parts = [b.select("*", F.lit(n).alias("batch"), F.lit(i).alias("batch_no")) for i, (b, n) in enumerate(zip(batches, names, strict=True))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rest = [c for c in batches[0].columns if c != key]
    out = out.withColumn("retained", F.row_number().over(Window.partitionBy(key).orderBy("batch_no", *rest)) == 1)
    if cap_by:
        at = F.row_number().over(Window.partitionBy(cap_by, "retained").orderBy("batch_no", key))
        out = out.withColumn("retained", F.col("retained") & (at <= cap))
    return out


def merge_supplement(original: DataFrame, supplement: DataFrame, key: str = "url_clean", group: str = "registered_domain", cap: int = 3) -> tuple[DataFrame, DataFrame]:
    """(merged rows, provenance of url_sha256, batch and retained); the original wins.

    Errors: different columns, a group that both batches have, more than ``cap`` retained rows of a group.
    """
    if original.dtypes != supplement.dtypes:
        raise ValueError("the batches have different columns")
    if original.select(group).distinct().join(supplement.select(group), group, "left_semi").head(1):
        raise ValueError("a group occurs in both batches")
    marked = first_wins([original, supplement], ["original", "supplement"], key)
    merged = marked.filter("retained")
    if merged.groupBy(group).count().filter(F.col("count") > cap).head(1):
        raise ValueError(f"a group has more than {cap} rows")
    return merged.select(*original.columns), marked.select(F.sha2(key, 256).alias("url_sha256"), "batch", "retained")


def rejected(rows: DataFrame) -> DataFrame:
    """(source, row_number, url_raw, reason) of all rows that are not in the dataset."""
    return rows.filter("reason IS NOT NULL").select("source", "row_number", "url_raw", "reason")


def write_outputs(rows: DataFrame, folder: str, target: int, seed: int) -> dict:
    """Balanced dispositions as five CSV tables and a manifest below ``folder``, which must not exist.

    urls (sorted by label and URL), cleaning_summary, source_summary, rejected_records, conflicting_labels. The
    manifest adds dataset_sha256 of the written dataset's bytes in file order, and is returned.
    """
    spark = rows.sparkSession
    dataset = rows.filter("selected").select(*DATASET).orderBy("label", "url_clean")
    tables = {"urls": dataset, "cleaning_summary": cleaning_summary(rows).orderBy("source"), "source_summary": source_summary(rows).orderBy("source", "label")}
    tables |= {"rejected_records": rejected(rows).orderBy("source", "row_number"), "conflicting_labels": conflicts(rows).orderBy("url_clean")}
    for name, table in tables.items():
        write_csv(table, f"{folder}/{name}", one_file=name != "urls")
    digest = hashlib.sha256()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{folder}/urls").orderBy("path")
    for r in files.select("content").toLocalIterator():
        digest.update(r.content)
    manifest = sampling_manifest(rows, target, seed) | {"dataset_sha256": digest.hexdigest()}
    spark.createDataFrame([(json.dumps(manifest, indent=2, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/sampling_manifest")
    return manifest


def read_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A written table again, with its types."""
    return spark.read.schema(schema).csv(f"{folder}/{name}", header=True, escape='"', multiLine=True, enforceSchema=False)
