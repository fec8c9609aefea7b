"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams in order. A document's
own list is compared with each: every n-gram of the document adds the distance between its
two ranks, or the greatest distance if the profile lacks it. The smallest sum wins.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlloom.llm.common import slices

PROFILE = 400
LENGTHS = (1, 2, 3)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Code point -> lower-case code point for letters, 32 (a boundary) for all else."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Packed n-grams of a whole text and their counts; None if it has no letter.

    Runs of non-letters count as one boundary, which n-grams of two or more can contain at
    either end. An n-gram packs 21 bits a character.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[points]
    blank = c == 32
    if blank.all():
        return None
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    inner = c != 32
    grams = [c[inner]]
    packed = c
    for n in LENGTHS[1:]:
        packed = (packed[:-1] << np.uint64(21)) | c[n - 1 :]
        usable = np.ones(len(packed), bool)
        for j in range(1, n - 1):
            usable &= inner[j : len(inner) - n + 1 + j]
        grams.append(packed[usable])
    return np.unique(np.concatenate(grams), return_counts=True)


def _ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller packed value."""
    if len(grams) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


def train_profiles(labelled: DataFrame, *, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its ``size`` most frequent n-grams, over all rows with a language.

    Each task sums what it has read; the sums meet by language and n-gram. Only profiles
    reach the driver: languages x ``size`` numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            by_lang: dict[str, list] = {}
            for t, name in zip(texts, langs, strict=True):
                if (found := gram_counts(t)) is not None:
                    by_lang.setdefault(name, []).append(found)
            for name, parts in by_lang.items():
                if name in sums:
                    parts.append(sums[name])
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                sums[name] = grams, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
        for name, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    summed = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], *, doc_id: str = "doc_id", text: str = "text", size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; other columns are ignored.

    score is 1 - (smallest sum / next smallest) / 2 mapped so that 0.5 is a tie and 1 a sum of
    zero, or 1 for a single language. A null text, or one without any letter, gives ``und``
    with score 0, and so does every text if there is no profile. Equal sums go to the
    language that is first by name. Repeated rows give repeated results, and texts are taken whole, however long.
    """
    names = sorted(profiles)
    order = [np.array(profiles[n], np.int64).view(np.uint64) for n in names]
    sorted_grams = [np.argsort(o, kind="stable") for o in order]

    def one(t: str | None) -> tuple[str, float]:
        found = gram_counts(t) if t and names else None
        if found is None:
            return UNKNOWN, 0.0
        own = _ranked(*found, size)
        sums = []
        for o, s in zip(order, sorted_grams, strict=True):
            at = s[np.minimum(np.searchsorted(o, own, sorter=s), len(o) - 1)]
            sums.append(int(np.where(o[at] == own, np.abs(at - np.arange(len(own))), size).sum()))
        best = int(np.argmin(sums))
        second = min((x for i, x in enumerate(sums) if i != best), default=None)
        if second is None:
            return names[best], 1.0
        return names[best], 1.0 - 0.5 * sums[best] / second if second else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [one(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
