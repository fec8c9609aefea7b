"""Entropy to the last bit as the SQL of the catalogue gives it.

A sum of doubles depends on the order of its terms. The SQL adds over list_distinct, whose order is that of DuckDB's
hash table: a chained table that puts a new bucket before all others and a new key first in its bucket.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What DuckDB hashes short strings with, and the sizes that the table goes through (enough for all of Unicode).
_SEED, _LENGTH, _MIX, _MASK = 0xE17A1465, 0xC6A4A7935BD1E995, 0xD6E8FEB86659FD93, (1 << 64) - 1
_SIZES = (13, 29, 59, 127, 257, 541, 1109, 2357, 5087, 10273, 20753, 42043, 85229, 172933, 351061, 712697, 1447153)


def _made():
    """(distinct_order, shannon), made inside a function so that they travel to executors by value."""
    hashes: dict[str, int] = {}

    def hashed(char: str) -> int:
        if char not in hashes:
            data = char.encode()
            h = (_SEED ^ len(data) * _LENGTH & _MASK ^ int.from_bytes(data, "little")) * _MIX & _MASK
            h = (h ^ h >> 32) * _MIX & _MASK
            h = (h ^ h >> 32) * _MIX & _MASK
            hashes[char] = h ^ h >> 32
        return hashes[char]

    def distinct_order(chars: Iterable[str]) -> list[str]:
        """Distinct characters, given by first appearance, as list_distinct returns them."""
        rest, placed = iter(chars), []
        for size in _SIZES:
            more = list(islice(rest, size - len(placed)))
            if not more:
                break
            # A full table grows with the next key: those that it has enter the larger one in the order in which they stand.
            buckets: dict[int, list[str]] = {}
            for c in (*placed, *more):
                buckets.setdefault(hashed(c) % size, []).append(c)
            placed = [c for bucket in reversed(buckets.values()) for c in reversed(bucket)]
        return placed

    def shannon(text: str) -> float:
        counts, total = Counter(text), 0.0
        for c in distinct_order(counts):
            share = counts[c] / len(text)
            total += share * math.log2(share)
        return -total

    return distinct_order, shannon


distinct_order, shannon = _made()


def entropy(text: Column) -> Column:
    """``features.entropy`` with the SQL's order of terms and the C library's logarithm, in Arrow batches."""
    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else shannon(x) for x in values.to_pylist()], pa.float64())

    return run(text)
