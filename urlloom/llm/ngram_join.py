"""N-gram Jaccard self-join by T-occurrence search with DivideSkip.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
``percent`` / 100. The result is one row per document with its component under links.

Outline, all of it exact up to 64-bit hashes of shingles and 128-bit hashes of whole sets:

1. Equal sets form a class (key, key2: hash of the sorted set); only classes are compared.
2. A set of n shingles can miss at most floor(n * (100 - percent) / 100) of them in any
   partner. Over a content-defined quarter of the shingle space (all of it for short sets)
   we count the shingles that occur in one class only; a class with more of them than it may
   miss has no partner and goes. What is left is small.
3. Among these, a class lists only its miss + 1 rarest shingles (of the quarter, and of the
   whole space for short sets): two classes that link share one of those. A list names its
   smallest key as pivot; a block holds all classes that list a shingle of its pivot's. Any
   two classes that link meet in a block, and shingles of common passages stay out of it.
   In a block every class asks a T-occurrence query of an inverted index, until one component is left.
4. Blocks above ``block`` classes are dealt over tasks instead: first only the pivot asks;
   where its links and those of all other blocks join the block into one component, that
   settles it, else the classes outside the largest component ask all parts of the block.
   A task holds the members of one part, about ``block`` sets; those that ask pass by one at a time.
5. Components come from alternating large-star and small-star steps on written edges.

Joins on shingles, blocks, components and classes go through ``common.meet``, which broadcasts
the bounded number of hot keys. Work tables are deleted once nothing reads them any more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlloom.llm.common import column_bytes, discard, materialize, meet, minus, mix, slices, word_hashes

SHINGLE = 4
PERCENT = 85
#: Sets below SHORT, and those up to the largest partner of such a set, are listed whole.
SHORT = 256
BLOCK = 256
#: Up to so many class representatives, which are counted, are broadcast to the scan of the texts; more are shuffled.
BROADCAST_REPS = 500_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text, as int64.

    A-Z are lower-cased; words are runs of bytes other than blank and 0x09 to 0x0D. A text of
    1 to size - 1 words is one shingle; a text without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64).view(np.int64)
    h = word_hashes(words)
    total = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        total = mix(total + h[j : len(h) - size + 1 + j] * _ODD[j % 4])
    return np.unique(total.view(np.int64))


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit identity of a shingle set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())


def may_miss(n, percent: int = PERCENT):
    """How many of its n shingles a set can lack in a partner."""
    return n * (100 - percent) // 100


def _listed(s: np.ndarray, percent: int, short: int) -> np.ndarray:
    """The shingles of a set that go into inverted lists."""
    n = len(s)
    if n * percent < short * 100:
        return s
    quarter = s[(s & 3) == 0]
    return s if len(quarter) <= may_miss(n, percent) else quarter


def set_table(docs: DataFrame, *, doc_id="doc_id", text="text", size=SHINGLE, percent=PERCENT, short=SHORT) -> DataFrame:
    """(doc_id, th, n_shingles, key, key2, whole, listed): text hash, set size, class and the listed shingles.

    ``whole`` tells that a set is judged by all of its shingles, not by the quarter.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, size) for t in column_bytes(batch, "text")]
            listed = [_listed(s, percent, short) for s in sets]
            whole = [len(s) < short or int((s & 3 == 0).sum()) <= may_miss(len(s), percent) for s in sets]
            keys = np.array([class_key(s) for s in sets], np.int64).reshape(-1, 2)
            offsets = np.cumsum([0, *map(len, listed)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys[:, 0].copy()),
                    pa.array(keys[:, 1].copy()),
                    pa.array(whole, pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *listed]))),
                ],
                ["doc_id", "th", "n_shingles", "key", "key2", "whole", "listed"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(build, "doc_id long, th long, n_shingles long, key long, key2 long, whole boolean, listed array<long>")


def class_table(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, key2, rep, rows, n, stays) of every class; rep is the smallest doc id.

    ``stays`` tells the classes that may have a partner.
    """
    filled = sets.filter("n_shingles > 0")
    lists = filled.select("key", F.explode("listed").alias("t")).groupBy("t").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    alone = lists.filter("a = b").groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("alone"), F.count_if(F.expr("t & 3 = 0")).alias("alone_quarter"))
    quarter = F.size(F.filter("listed", lambda t: t.bitwiseAND(F.lit(3)) == 0))
    classes = filled.groupBy("key", "key2").agg(
        F.min("doc_id").alias("rep"),
        F.count(F.lit(1)).alias("rows"),
        F.first("n_shingles").alias("n"),
        F.first("whole").alias("whole"),
        F.first(F.size("listed")).alias("m"),
        F.first(quarter).alias("m_quarter"),
    )
    joined = classes.join(alone, "key", "left").na.fill(0, ["alone", "alone_quarter"])
    miss = F.expr(f"n * {100 - percent} div 100")
    # A long set listed whole has a quarter too thin to judge by: it stays if anything is shared.
    stays = (
        F.when(~F.col("whole"), (F.col("alone_quarter") <= miss) & (F.col("alone_quarter") < F.col("m_quarter")))
        .when(F.col("n") < SHORT, F.col("alone") <= miss)
        .otherwise(F.col("alone") < F.col("m"))
    )
    return joined.select("key", "key2", "rep", "rows", "n", (stays & F.col("rep").isNotNull()).alias("stays"))


def survivor_table(classes: DataFrame) -> DataFrame:
    """(node, key, key2, rep) of the classes that may have a partner; ``node`` is one number for each.

    It is the first half of the key, unless another class shares that.
    """
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key2"))
    numbered = classes.filter("stays").withColumn("nth", nth)
    return numbered.select(F.when(F.col("nth") == 1, F.col("key")).otherwise(F.xxhash64("key", "key2")).alias("node"), "key", "key2", "rep")


class InvertedIndex:
    """Inverted lists over a few sets, searched with DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate([np.empty(0, np.int64), *sets])
        member = np.repeat(np.arange(len(sets), dtype=np.int64), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.member = member[order]
        self.tokens, self.starts = np.unique(tokens[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(tokens))
        lists = np.repeat(np.arange(len(self.tokens), dtype=np.int64), self.ends - self.starts)
        self.entries = lists * max(1, len(sets)) + self.member  # ascending: by list, then member

    def search(self, query: np.ndarray, percent: int = PERCENT, wanted=lambda m: True) -> Iterator[tuple[int, int]]:
        """(member, overlap) for all ``wanted`` members that reach the similarity with the query.

        The overlap needed is at least T = ceil(percent / 100 * |query|). The T - 1 longest
        lists are set aside: a result occurs in at least one of the short ones. Short lists
        are heap-merged, counting each member; for members met, all long lists are probed by
        binary search (in one call over list and member) unless the bound is out of reach.
        """
        n = len(query)
        if not n or not len(self.tokens):
            return
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        least = -(-percent * n // 100)
        if len(at) < least:
            return
        at = at[np.argsort(self.ends[at] - self.starts[at], kind="stable")]
        n_short = len(at) - (least - 1)
        short = [self.member[self.starts[i] : self.ends[i]].tolist() for i in at[:n_short]]
        met = [(m, sum(1 for _ in run)) for m, run in groupby(heapq.merge(*short))]
        for m, count in met:
            size = int(self.sizes[m])
            if size * 100 < percent * n or n * 100 < percent * size or not wanted(m):
                continue
            # |a & b| * 100 >= percent * |a | b|  <=>  |a & b| * (100 + percent) >= percent * (|a| + |b|)
            needed = -(-percent * (n + size) // (100 + percent))
            if count + len(at) - n_short < needed:
                continue
            probes = at[n_short:] * len(self.sizes) + m
            hit = np.minimum(np.searchsorted(self.entries, probes), len(self.entries) - 1)
            count += int((self.entries[hit] == probes).sum())
            if count >= needed:
                yield m, count


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _search_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) found in blocks; rows: block, part, node, root, asks, member, s.

    Each (block, part) is one index over its members, asked by its ``asks`` rows. ``root`` is
    the component that a node is known to be in. Only links that join two components are put
    out, so there are fewer of them than rows. Members come first; the other rows stream by.
    """

    def links(group: Iterator[tuple[int, int, bool, bool, np.ndarray]]) -> Iterator[tuple[int, int]]:
        members, first = [], None
        for row in group:
            if not row[3]:
                first = row
                break
            members.append(row)
        if not members:
            return
        index, forest = InvertedIndex([s for *_, s in members]), _Forest()
        trees = len({root for _, root, *_ in members})
        for node, root, asks, member, s in chain(members, [first] if first else [], group):
            if not asks or (trees < 2 and (member or forest.root(root) == forest.root(members[0][1]))):
                continue
            apart = lambda m, root=root: forest.root(root) != forest.root(members[m][1])
            for m, _ in index.search(s, percent, apart):
                at = members[m][1]
                if forest.root(root) != forest.root(at):
                    known = {forest.root(r) for _, r, *_ in members}
                    trees -= forest.root(root) in known
                    forest.join(root, at)
                    yield node, members[m][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for batch in batches:
                lists = batch.column("s")
                values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
                cols = [batch.column(c).to_pylist() for c in ("block", "part", "node", "root", "asks", "member")]
                for i, (block, part, *row) in enumerate(zip(*cols, strict=True)):
                    yield (block, part), (*row, values[offsets[i] : offsets[i + 1]].copy())

        found: list[tuple[int, int]] = []
        for _, group in groupby(flat(), key=lambda x: x[0]):
            for pair in links(x for _, x in group):
                found.append(pair)
                if len(found) > 50_000:
                    yield _pairs(found)
                    found = []
        yield _pairs(found)

    dealt = rows.repartition("block", "part").sortWithinPartitions("block", "part", F.desc("member"))
    return dealt.mapInArrow(run, "u long, v long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["u", "v"])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for all nodes of the edges; root is the smallest node of the component.

    Alternates large-star and small-star steps, each written out, until nothing changes.
    Every step is a map-side combined minimum per node and a join with it.
    """
    edges = materialize(edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).filter("a < b").distinct(), "edges")
    known = None
    while True:
        before = edges
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))  # b < a
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("m").alias("a"), "b").filter("a < b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        edges = materialize(small, "edges")
        discard(before)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == known:
            break
        known = tuple(state)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _every_part(blocks: DataFrame) -> DataFrame:
    """Rows that ask every part of their block without being members there."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    return blocks.select("block", parts.alias("part"), "node", "root", F.lit(True).alias("asks"), F.lit(False).alias("member"))


def _found_components(docs: DataFrame, survivors: DataFrame, doc_id: str, text: str, size: int, percent: int, block: int) -> DataFrame:
    """(node, root) of all linked classes, written."""

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = zip(*[batch.column(c).to_pylist() for c in ("key", "key2")], strict=True)
            sets = [(node, s) for node, key, t in zip(batch.column("node").to_pylist(), keys, column_bytes(batch, "text"), strict=True) if class_key(s := shingle_set(t, size)) == key]
            offsets = np.cumsum([0, *[len(s) for _, s in sets]], dtype=np.int32)  # another text can have the same doc id
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *[s for _, s in sets]])))], ["node", "s"]
            )

    reps = survivors.withColumnRenamed("rep", "doc_id")
    reps = F.broadcast(reps) if reps.limit(BROADCAST_REPS + 1).count() <= BROADCAST_REPS else reps.hint("shuffle_hash")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(reps, "doc_id")
    made = texts.select("node", "key", "key2", "text").mapInArrow(whole_sets, "node long, s array<long>")
    whole = materialize(made.dropDuplicates(["node"]), "whole")

    # Any two sets that can link list in one of the spaces both: short sets and those up to their
    # largest partner in the whole, long ones in the quarter. A long set whose quarter is too thin
    # to be sure of a shared shingle with its like lists in both.
    sized = whole.select("node", "s", F.size("s").alias("n"), F.filter("s", lambda t: t.bitwiseAND(F.lit(3)) == 0).alias("quarter"))
    miss = F.expr(f"n * {100 - percent} div 100")
    none = F.slice("quarter", 1, 0)
    in_whole = F.when((F.col("n") * percent < SHORT * 100) | (F.size("quarter") <= miss), F.col("s")).otherwise(none)
    in_quarter = F.when(F.col("n") >= SHORT, F.col("quarter")).otherwise(none)
    spaces = F.explode(F.array(F.struct(F.lit(0).alias("space"), in_whole.alias("ts")), F.struct(F.lit(1).alias("space"), in_quarter.alias("ts")))).alias("x")
    listed = sized.select("node", miss.alias("miss"), spaces).select("node", "miss", "x.space", "x.ts")
    depth = F.when((F.col("space") == 1) & (F.size("ts") <= F.col("miss")), F.size("ts")).otherwise(F.col("miss") + 1)
    postings = listed.select("node", "space", depth.alias("depth"), F.explode("ts").alias("t"))
    shared = materialize(postings.groupBy("space", "t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    total = shared.agg(F.sum("df")).first()[0] or 0
    by_rarity = Window.partitionBy("node", "space").orderBy("df", "t")
    counted = meet(postings, shared, ["space", "t"], "df", total, "left").na.fill(1, ["df"])
    rare = materialize(counted.withColumn("r", F.row_number().over(by_rarity)).filter("r <= depth and df > 1").select("node", "space", "t"), "rare")
    pivots = materialize(rare.groupBy("space", "t").agg(F.min("node").alias("block"), F.max("node").alias("last"), F.count(F.lit(1)).alias("df")).filter("block < last").drop("last"), "pivots")
    members = materialize(meet(rare, pivots, ["space", "t"], "df", rare.count()).select("block", "node").distinct(), "members")
    discard(shared, rare, pivots)
    counts = members.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    parts = meet(members, counts, ["block"], "m", members.count()).withColumn("parts", F.expr(f"cast((m + {block - 1}) div {block} as int)"))
    parts = materialize(parts.select("block", "node", "parts", F.expr("pmod(xxhash64(node), parts)").alias("part")), "parts")
    discard(members)

    large = parts.filter("parts > 1")
    row = lambda x, asks: x.select("block", "part", "node", "root", F.lit(asks).alias("asks"), F.lit(True).alias("member"))
    small = row(parts.filter("parts = 1").withColumn("root", F.col("node")), True)
    pivot = _every_part(large.select("block", "parts").distinct().select("block", "parts", F.col("block").alias("node"), F.col("block").alias("root")))
    first = small.union(row(large.withColumn("root", F.col("node")), False)).union(pivot)
    links = materialize(_search_blocks(first.join(whole, "node"), percent), "links")
    roots = materialize(components(links), "roots")
    discard(links)

    if not large.isEmpty():
        labelled = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        by_root = labelled.groupBy("block", "root").agg(F.count(F.lit(1)).alias("n"))
        top = by_root.groupBy("block").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("m")).filter("roots > 1")
        top = materialize(top, "top")
        total = top.agg(F.sum("m")).first()[0] or 0
        open_blocks = materialize(meet(labelled, top, ["block"], "m", total).select("block", "parts", "part", "node", "root", (F.col("root") != F.col("top")).alias("rest")), "open")
        second = row(open_blocks, False).union(_every_part(open_blocks.filter("rest")))
        more = materialize(_search_blocks(second.join(whole, "node"), percent), "links")
        before = roots
        roots = materialize(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)), "roots")
        discard(before, top, open_blocks, more)
    discard(parts, whole)
    return roots


def _assigned(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, th, n_shingles, component_id, group) of every row, and the tables that it reads."""
    sets = materialize(set_table(docs, doc_id=doc_id, text=text, size=size, percent=percent), "sets")
    classes = materialize(class_table(sets, percent), "classes")
    rows = materialize(sets.select("doc_id", "th", "n_shingles", "key", "key2"), "rows")
    discard(sets)
    survivors = materialize(survivor_table(classes), "survivors")
    roots = _found_components(docs, survivors, doc_id, text, size, percent, block)

    named = survivors.join(roots, "node")
    first_id = materialize(named.groupBy("root").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("m")), "first")
    by_class = meet(named, first_id, ["root"], "m", first_id.agg(F.sum("m")).first()[0] or 0).select("key", "key2", "component", "root")
    final = materialize(
        classes.join(by_class, ["key", "key2"], "left").select("key", "key2", "rows", F.coalesce("component", "rep").alias("component_id"), F.coalesce("root", "key").alias("group")), "final"
    )
    discard(classes, survivors, roots, first_id)
    filled = meet(rows.filter("n_shingles > 0"), final, ["key", "key2"], "rows", rows.count())
    empty = rows.filter("n_shingles = 0").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    return filled.select("doc_id", "th", "n_shingles", "component_id", "group").union(empty), [rows, final]


def similarity_components(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, group) for every row of ``docs``.

    component_id is the smallest doc_id reachable by links, itself included; ``group`` tells
    components apart where repeated ids give two of them the same smallest id. A null or empty
    text has no shingles and links with nothing, not even with another empty text (its group is null); texts of
    fewer than ``size`` words link when their words are equal. Repeated rows are rows of one
    class. A null doc_id gives a row whose component is that of its class, or null. Texts are
    taken whole, however long; a set of shingles has to fit in a task. Other
    columns are ignored, so their names can clash with nothing.
    """
    found, _ = _assigned(docs, doc_id, text, size, percent, block)
    return found.select("doc_id", "n_shingles", "component_id", "group")


def one_per_component(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the document with its smallest id.

    Of several texts of that id in the component the one with the smallest hash stays, and of rows that
    repeat an id and a text one. Documents without words all stay, and so do rows with a null id.
    Rows go by id and text, so an id that also has another text loses only the copy. All
    columns of ``docs`` are kept as they are.
    """
    assigned, tables = _assigned(docs, doc_id, text, size, percent, block)
    found = materialize(assigned.filter("n_shingles > 0 and doc_id is not null"), "found")
    discard(*tables)
    own = found.filter("doc_id = component_id")
    several = own.groupBy("doc_id", "group").agg(F.min("th").alias("keep"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    rivals = materialize(own.join(F.broadcast(several) if several.limit(BROADCAST_REPS + 1).count() <= BROADCAST_REPS else several, ["doc_id", "group"]), "rivals")
    repeated = rivals.filter("th = keep").groupBy("doc_id", "th").count().filter("count > 1")
    repeated = materialize(repeated.select(F.col("doc_id").alias("_gone"), F.col("th").alias("_text")), "repeated")
    gone = found.filter("doc_id <> component_id").union(rivals.filter("th <> keep").select(*found.columns))
    gone = materialize(gone.select(F.col("doc_id").alias("_gone"), F.col("th").alias("_text")).distinct().union(repeated), "gone")
    discard(found, rivals)
    kept = minus(docs, gone, doc_id=doc_id, text=text)
    if repeated.isEmpty():
        return kept
    names = docs.columns
    same = (F.col("_id") == F.col("_gone")) & (F.col("_th") == F.col("_text"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{doc_id}`").cast("long").alias("_id"), F.xxhash64(f"`{text}`").alias("_th"))
    once = row.join(repeated, same, "left_semi").groupBy("_id", "_th").agg(F.first("_row").alias("_row"))
    return kept.union(once.select(*[F.col(f"_row.`{c}`").alias(c) for c in names]))
