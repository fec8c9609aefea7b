"""Line dedup by site-relative frequency, with DataFrame functions only.

A line of a page is boilerplate if more than ``ratio`` of the pages of the page's host
contain it. Boilerplate lines are dropped. A line that only one page has is no repetition:
it stays however small the host, which else would lose all its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlloom.llm.common import materialize

RATIO = 0.1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_key(line: Column) -> Column:
    """Identity of a line: its text without outer blanks, as 128 bits; null for blank lines."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.md5(bare))


def boilerplate_lines(
    pages: DataFrame,
    *,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
) -> DataFrame:
    """(host, line_key, line_pages, host_pages) of the lines over the ratio.

    A page counts once for a line however often it has it. Pages of a null host form one
    host of their own. The counts combine on the map side, so a host or a line that holds
    a third of all rows reaches the reducers as one row a task.
    """
    base = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = base.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _line_key), lambda k: k.isNotNull()))
    counts = (
        base.select("host", F.explode(keys).alias("line_key"))
        .groupBy("host", "line_key")
        .agg(F.count(F.lit(1)).alias("line_pages"))
        .filter("line_pages > 1")
    )
    joined = counts.alias("c").join(totals.alias("t"), F.expr("c.host <=> t.host"))
    return joined.filter(F.col("line_pages") > ratio * F.col("host_pages")).select("c.host", "line_key", "line_pages", "host_pages")


def _cut(pages: DataFrame, host: str, text: str, ratio: float, broadcast_lines: int, salts: int) -> DataFrame:
    """(_row, _n, _kept): the row, its number of lines, and the lines that stay (null: all)."""
    flagged = materialize(boilerplate_lines(pages, host=host, text=text, ratio=ratio), "boilerplate")
    arrays = flagged.groupBy(F.col("host").alias("_b_host")).agg(F.collect_set("line_key").alias("_b_keys"))
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"))
    same_host = F.col(f"_row.`{host}`").eqNullSafe(F.col("_b_host"))
    if flagged.limit(broadcast_lines + 1).count() <= broadcast_lines:
        joined = row.join(F.broadcast(arrays), same_host, "left")
    else:
        arrays = arrays.withColumn("_b_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = row.withColumn("_salt", F.pmod(F.xxhash64(F.col(f"_row.`{text}`")), F.lit(salts)).cast("int"))
        joined = salted.join(arrays.hint("shuffle_hash"), same_host & (F.col("_salt") == F.col("_b_salt")), "left")
    lines = _lines(F.col(f"_row.`{text}`"))
    kept = F.when(
        F.col("_b_keys").isNotNull(),
        F.filter(lines, lambda line: ~F.coalesce(F.array_contains(F.col("_b_keys"), _line_key(line)), F.lit(False))),
    )
    return joined.select("_row", F.size(lines).alias("_n"), kept.alias("_kept"))


def drop_boilerplate(
    pages: DataFrame,
    *,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    broadcast_lines: int = 100_000,
    salts: int = 64,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """Every row of ``pages`` with boilerplate lines cut out of ``text``; adds the two ``counts`` columns.

    All other columns stay as they are, whatever their names; an input column named like one of the counts
    gives way to it. A null text stays null, with no
    lines; an empty text has one (blank) line, and blank lines are always kept. Repeated rows
    count as separate pages. An empty table gives an empty table. A text is taken whole, however long.

    If at most ``broadcast_lines`` lines are to go (their number is counted first, their keys
    have a fixed length), the hosts' arrays of keys are broadcast and no text is shuffled.
    Beyond that, rows are dealt by host and one of ``salts`` salts, so a hot host meets its
    array of keys, whose size is bounded by mean lines a page / ratio, in many tasks.
    """
    old = F.col(f"_row.`{text}`")
    whole = old.isNull() | F.col("_kept").isNull()
    new = F.when(whole, old).otherwise(F.array_join("_kept", "\n"))
    n_lines, n_dropped = counts
    return _cut(pages, host, text, ratio, broadcast_lines, salts).select(
        *[(new if c == text else F.col(f"_row.`{c}`")).alias(c) for c in pages.columns if c not in counts],
        F.when(old.isNull(), 0).otherwise(F.col("_n")).cast("long").alias(n_lines),
        F.when(whole, 0).otherwise(F.col("_n") - F.size("_kept")).cast("long").alias(n_dropped),
    )


def without_boilerplate(
    pages: DataFrame,
    *,
    host: str = "source",
    text: str = "text",
    length: str | None = None,
    ratio: float = RATIO,
    broadcast_lines: int = 100_000,
    salts: int = 64,
) -> DataFrame:
    """``drop_boilerplate`` with the columns of ``pages``; ``length`` names the one that counts the text's characters, set where a line goes."""
    old, kept = F.col(f"_row.`{text}`"), F.col("_kept")
    changed = old.isNotNull() & kept.isNotNull() & (F.size(kept) < F.col("_n"))
    new = F.array_join(kept, "\n")
    values = {text: F.when(changed, new).otherwise(old)}
    if length is not None:
        was = F.col(f"_row.`{length}`")
        values[length] = F.when(changed, F.length(new).cast(pages.schema[length].dataType)).otherwise(was)
    return _cut(pages, host, text, ratio, broadcast_lines, salts).select(*[values.get(c, F.col(f"_row.`{c}`")).alias(c) for c in pages.columns])
