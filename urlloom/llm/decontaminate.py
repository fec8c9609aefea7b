"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a span of words; its hash covers the selected positions and
ignores the others, so substituted words there don't matter. Hashes of benchmark items and
of documents are joined; around each hit the whole item is laid over the document along the
hit's diagonal and compared word by word.

Four masks of weight 6 serve items of SPAN words and more: at a rate of 0.8 they find 97 % of overlaps
of 15 words and over 99 % of those of 16 and more (tests/llm measure it). An item of n < SPAN words has masks of its
own, which span all of it: its positions are dealt to s + 2 groups, where s = n // 5 words may
differ, and each mask ignores s of the groups, so one of them misses all substitutions.
"""

from __future__ import annotations

import math
import string
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlloom.llm.common import materialize, meet, minus, mix, slices, word_hashes

#: "1" selects a word.
MASKS = ("1111011", "11011011", "101100111", "1101001011")
#: Items of fewer words have masks that span them whole.
SPAN = 12
MIN_MATCHED = 13
IDENTITY = 0.8
#: Up to so many seeds, which are counted, are broadcast to the hits.
BROADCAST_SEEDS = 1_000_000
_FILTER_BITS = 26
EDGES = string.punctuation + "«»“”‘’…¿¡"


def tokens(text: str) -> np.ndarray:
    """Hashes of the lower-cased words of a whole text, without punctuation at their ends."""
    stripped = [w.strip(EDGES) for w in text.lower().split()]
    return word_hashes([w.encode("utf-8", "surrogatepass") for w in stripped if w])


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over a whole item of n words; whichever n // 5 words differ, one mask selects none of them."""
    ignored = n // 5
    if not ignored:
        return [tuple(range(n))]
    return [tuple(j for j in range(n) if j % (ignored + 2) not in out) for out in combinations(range(ignored + 2), ignored)]


def _hashes(h: np.ndarray, mask: tuple[int, ...], span: int) -> np.ndarray:
    n = len(h) - span + 1
    total = np.full(max(n, 0), (span << 32) + sum(1 << j for j in mask), np.uint64)
    for j in mask if n > 0 else ():
        total = mix(total + h[j : j + n])
    return total


def seeds(h: np.ndarray, short: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) for each mask, then for those of items of the ``short`` lengths.

    The latter may stick out of the text by as many words as can differ.
    """
    for m in MASKS:
        found = _hashes(h, tuple(j for j, x in enumerate(m) if x == "1"), len(m))
        yield np.arange(len(found)), found
    for n in short:
        pad = np.zeros(n // 5, np.uint64)
        padded = np.concatenate([pad, h, pad])
        for mask in short_masks(n):
            found = _hashes(padded, mask, n)
            yield np.arange(len(found)) - len(pad), found


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a fixed-size Bloom filter that a hash sets."""
    low = np.uint64((1 << _FILTER_BITS) - 1)
    return h & low, (h >> np.uint64(64 - _FILTER_BITS)) & low


def _list(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def item_table(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words): word hashes of each item; items without words go."""

    def run(batches):
        for batch in slices(batches):
            words = [tokens(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), _list(words)], ["item_id", "words"])

    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter("text is not null")
    return rows.mapInArrow(run, "item_id long, words array<long>").filter("size(words) > 0")


def seed_table(passages: DataFrame) -> DataFrame:
    """(passage, at, h) for all seeds of the passages (passage, words)."""

    def run(batches):
        for batch in batches:
            for passage, words in zip(batch.column("passage").to_pylist(), batch.column("words").to_pylist(), strict=True):
                h = np.array(words, np.int64).view(np.uint64)
                if len(h) < SPAN:
                    own = [(np.zeros(1, np.int64), _hashes(h, mask, len(h))) for mask in short_masks(len(h))]
                else:
                    own = seeds(h)
                for at, found in own:
                    yield pa.RecordBatch.from_arrays([pa.array([passage] * len(at), pa.int64()), pa.array(at), pa.array(found.view(np.int64))], ["passage", "at", "h"])

    return passages.select("passage", "words").mapInArrow(run, "passage long, at long, h long")


def _filter(seeded: DataFrame) -> np.ndarray:
    """A Bloom filter of all benchmark seeds: 8 MB, however many there are."""
    bits = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    low = (1 << _FILTER_BITS) - 1
    first = F.col("h").bitwiseAND(F.lit(low))
    second = F.shiftrightunsigned("h", 64 - _FILTER_BITS)
    each = seeded.select(F.explode(F.array(first, second)).alias("bit"))
    packed = each.groupBy(F.shiftright("bit", 3).cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("mask"))
    found = packed.toArrow()
    bits[found["byte"].to_numpy()] = found["mask"].to_numpy().astype(np.uint8)
    return bits


def candidate_table(docs: DataFrame, bits: np.ndarray, short: tuple[int, ...], *, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, words, at, h) of the documents with a seed that passes the filter; th is a hash of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        table = sent.value
        has = lambda b: table[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1
        for batch in slices(batches):
            kept, words, ats, hashes = [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                h = tokens(t)
                found_at, found = [], []
                for at, s in seeds(h, short):
                    first, second = _bits(s)
                    hit = np.flatnonzero(has(first))
                    hit = hit[has(second[hit]) == 1]
                    if len(hit):
                        found_at.append(at[hit])
                        found.append(s[hit].view(np.int64))
                if found:
                    kept.append(i)
                    words.append(h.view(np.int64))
                    ats.append(np.concatenate(found_at))
                    hashes.append(np.concatenate(found))
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), _list(words), _list(ats), _list(hashes)], ["doc_id", "th", "words", "at", "h"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).filter("text is not null")
    return rows.mapInArrow(run, "doc_id long, th long, words array<long>, at array<long>, h array<long>")


def best_overlap(same: list[bool], identity: float = IDENTITY) -> tuple[int, int, int]:
    """(start, length, matched) of the stretch with the most equal words at a rate of at least ``identity``.

    It starts and ends with an equal word; ties go to the shorter, then to the first. For each end the best
    start is the smallest at which the sum of (equal - identity) up to there is no larger than at the end; only new lows
    of that sum can be such a start.
    """
    lows, starts, matches = [0.0], [0], [0]  # falling sums, their positions, equal words before
    total, seen, best = 0.0, 0, (0, 0, 0)
    for i, x in enumerate(same):
        total += x - identity
        seen += x
        if x:
            at = bisect_left(lows, -total - 1e-9, key=lambda v: -v)
            if at < len(lows):
                start, matched = starts[at], seen - matches[at]
                while not same[start]:
                    start += 1
                best = max(best, (matched, start - i - 1, -start))
        if total < lows[-1] - 1e-9:
            lows.append(total)
            starts.append(i + 1)
            matches.append(seen)
    return (-best[2], -best[1], best[0]) if best[0] else (0, 0, 0)


def best_on_diagonals(words: np.ndarray, item: np.ndarray, shifts: list[int], min_matched: int, identity: float) -> tuple | None:
    """(matched, -words, -start, -item_start) of the best overlap on any of the diagonals that counts."""
    needed, best = min(min_matched, math.ceil(identity * len(item))), None
    for shift in shifts:
        start, skip = max(shift, 0), max(-shift, 0)
        d, b = words[start : start + len(item) - skip], item[skip:]
        same = d == b[: len(d)]
        if same.sum() < needed:
            continue
        at, n, matched = best_overlap(same.tolist(), identity)
        if matched >= needed:
            found = (matched, -n, -(start + at), -(skip + at))
            best = found if best is None else max(best, found)
    return best


def _verified(docs: DataFrame, items: DataFrame, doc_id: str, text: str, min_matched: int, identity: float) -> DataFrame:
    """(doc_id, th, passage, matched, n, start, item_start) of every contaminated pair of a text and a passage; the last three negated."""
    passages = items.groupBy("passage").agg(F.first("words").alias("item"))
    seeded = materialize(seed_table(passages.withColumnRenamed("item", "words")), "seeds")
    short = tuple(sorted(r[0] for r in items.select(F.size("words").alias("n")).filter(F.col("n") < SPAN).distinct().collect()))
    candidates = materialize(candidate_table(docs, _filter(seeded), short, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id()), "candidates")
    hits = candidates.select("row", F.explode(F.arrays_zip("at", "h")).alias("hit")).select("row", F.col("hit.h").alias("h"), F.col("hit.at").alias("doc_at"))
    by_passage = seeded.groupBy("h", "passage").agg(F.collect_list("at").alias("ats"))
    by_hash = by_passage.groupBy("h").agg(F.collect_list(F.struct("passage", "ats")).alias("places"))
    if seeded.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        joined = hits.join(F.broadcast(by_hash), "h")
    else:
        counts = materialize(hits.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(by_hash, "h"), "hits")
        joined = meet(hits, counts, ["h"], "n", counts.agg(F.sum("n")).first()[0] or 0)
    placed = joined.select("row", "doc_at", F.explode("places").alias("p")).select("row", "p.passage", F.transform("p.ats", lambda a: F.col("doc_at") - a).alias("shifts"))
    diagonals = placed.groupBy("row", "passage").agg(F.array_distinct(F.flatten(F.collect_list("shifts"))).alias("shifts"))
    laid = diagonals.join(candidates.select("row", "doc_id", "th", "words"), "row").join(passages, "passage")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            lists = [[x.values.to_numpy() for x in batch.column(c)] for c in ("words", "item", "shifts")]
            for i, (words, item, shifts) in enumerate(zip(*lists, strict=True)):
                best = best_on_diagonals(words, item, shifts.tolist(), min_matched, identity)
                if best:
                    out.append((i, *best))
            at, *found = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("doc_id", "th", "passage")], *found], ["doc_id", "th", "passage", "matched", "n", "start", "item_start"])

    return laid.select("doc_id", "th", "passage", "shifts", "words", "item").mapInArrow(verify, "doc_id long, th long, passage long, matched long, n long, start long, item_start long")


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return materialize(item_table(benchmark, item_id=item_id, text=item_text).withColumn("passage", F.xxhash64("words")), "items")


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_matched: int = MIN_MATCHED,
    identity: float = IDENTITY,
) -> DataFrame:
    """(doc_id, item_id, start, item_start, words, matched) of each contaminated pair, with its best overlap.

    A pair counts if, along one diagonal, a stretch has at least ``min_matched`` equal words
    (or identity * the item's words, if that is less), at a rate of at least ``identity``. Positions
    count words from 0. Null and empty texts on either side give no pair. Items with equal
    words are compared once and all reported; repeated ids make one pair, with the best overlap of
    their texts; rows with a null id count as one document. Ties go to the shorter overlap, then
    to the first in the document, then in the item. Texts are taken whole, however long: a text
    and an item that both repeat a word meet once, with the list of their diagonals.

    A Bloom filter of fixed size is broadcast, and the seeds of the items up to a counted number. Documents
    with a hit go on as word hashes; a passage that a third of them contain meets its few
    seeds in that broadcast or in a join that no hot key can hold up.
    """
    items = _items(benchmark, item_id, item_text)
    found = _verified(docs, items, doc_id, text, min_matched, identity)
    best = found.groupBy("doc_id", "passage").agg(F.max(F.struct("matched", "n", "start", "item_start")).alias("x")).join(items.select("item_id", "passage"), "passage")
    return best.select("doc_id", "item_id", *[(-F.col(f"x.{c}")).alias(name) for c, name in (("start", "start"), ("item_start", "item_start"), ("n", "words"))], F.col("x.matched").alias("matched"))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_matched: int = MIN_MATCHED,
    identity: float = IDENTITY,
) -> DataFrame:
    """The rows of ``docs`` whose text has no contaminated pair, with all columns as they are.

    Rows go by id and text: another text of the same id stays.
    """
    found = _verified(docs, _items(benchmark, item_id, item_text), doc_id, text, min_matched, identity)
    gone = materialize(found.select(F.col("doc_id").alias("_gone"), F.col("th").alias("_text")).distinct(), "contaminated")
    return minus(docs, gone, doc_id=doc_id, text=text)
