"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, each made at a node (path of the bits so far) of a tree
whose contexts are the last 0 to ``depth`` bytes. Every node has a Krichevsky-Trofimov
estimate; weighting mixes, bottom-up, each node's own estimate with the product of its
children's. The tree is learnt once, from all training texts, and then stays fixed.

A unigram word model with additive smoothing comes along as a base line.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlloom.llm.common import column_bytes, materialize, mix, slices, word_hashes

DEPTH = 5
#: At most 2 ** SLOT_BITS types, those seen most often, are looked up in a broadcast table; 16 bytes each.
SLOT_BITS = 22
#: A word is frequent from a share of 2 ** -FREQUENT_BITS on: there are at most 2 ** FREQUENT_BITS.
FREQUENT_BITS = 21
_END = 0xFF  # occurs in no UTF-8 text: the end, and what precedes the start
_CHUNK = 1 << 19
_MEMO_BITS = 20
END_WORD = np.array([xxhash.xxh3_64_intdigest(b"")], np.uint64).view(np.int64)[0]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def types(texts: list[bytes], depth: int) -> np.ndarray:
    """(context of ``depth`` bytes, byte) of every byte of the texts and of their ends, packed."""
    lead = bytes([_END]) * depth
    buffer = np.frombuffer(lead + lead.join(t + bytes([_END]) for t in texts), np.uint8)
    packed = buffer[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        packed |= buffer[depth - j : len(buffer) - j].astype(np.uint64) << np.uint64(8 * j)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
    keep = np.ones(len(packed), bool)
    if depth:
        gaps = (starts[1:, None] - np.arange(1, depth + 1)).ravel()
        keep[gaps] = False
    return packed[keep]


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def count_table(train: DataFrame, *, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(kind, key, n) over all texts: kind 0 counts words by hash, kind 1 counts packed types.

    Each task sums what it reads before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = [[], []]
        for batch in slices(batches):
            texts = [t.lower() for t in column_bytes(batch, "text")]
            for a, b in _chunks(texts):
                words = [w for t in texts[a:b] for w in (*t.split(), b"")]
                for kind, values in ((0, word_hashes(words)), (1, types(texts[a:b], depth))):
                    parts[kind].append(np.unique(values, return_counts=True))
                    if len(parts[kind]) > 8:
                        parts[kind] = [_sum_up(parts[kind])]
        for kind in (0, 1):
            if parts[kind]:
                keys, n = _sum_up(parts[kind])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    counted = train.select(F.col(text).alias("text")).mapInArrow(run, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    g = lambda x: _lgamma(x.astype(float)).astype(float)
    return g(n0 + 0.5) + g(n1 + 0.5) - 2 * math.lgamma(0.5) - g(n0 + n1 + 1.0)


def _weigh(nodes: DataFrame, leaf: bool) -> DataFrame:
    """Adds log_w (log of the weighted probability) and stop (weight of the node's own estimate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n0, n1 = batch.column("n0").to_numpy(), batch.column("n1").to_numpy()
            own = log_kt(n0, n1)
            if leaf:
                log_w, stop = own, np.ones(len(own))
            else:
                log_w = math.log(0.5) + np.logaddexp(own, batch.column("below").to_numpy())
                stop = np.exp(math.log(0.5) + own - log_w)
            yield pa.RecordBatch.from_arrays([batch.column("context"), batch.column("path"), batch.column("n0"), batch.column("n1"), pa.array(log_w), pa.array(stop)], ["context", "path", "n0", "n1", "log_w", "stop"])

    return nodes.mapInArrow(run, "context long, path int, n0 long, n1 long, log_w double, stop double")


def _levels(counts: DataFrame, depth: int) -> list[DataFrame]:
    """(context, path, n0, n1, log_w, stop) of every level from 0 on, weighted from the leaves to the root."""
    bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")
    types_ = counts.filter("kind = 1").select(F.shiftrightunsigned("key", 8).alias("context"), F.expr("cast(key & 255 as int)").alias("byte"), "n", bits)
    steps = types_.select(
        "context",
        F.expr("(shiftleft(1, i) | shiftright(byte, 8 - i))").alias("path"),
        F.expr("if(shiftright(byte, 7 - i) & 1 = 0, n, 0L)").alias("n0"),
        F.expr("if(shiftright(byte, 7 - i) & 1 = 1, n, 0L)").alias("n1"),
    )
    nodes = steps.groupBy("context", "path").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    levels = []
    for level in range(depth, -1, -1):
        done = materialize(_weigh(nodes, level == depth), f"tree{level}")
        levels.append(done)
        parent = F.expr(f"context & {(1 << 8 * (level - 1)) - 1 if level else 0}L").alias("context")
        nodes = done.groupBy(parent, "path").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("below"))
    return levels[::-1]


def tree(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, context, path, n0, n1, log_w, stop): all nodes, weighted from the leaves to the root."""
    out = None
    for level, x in enumerate(_levels(counts, depth)):
        x = x.withColumn("level", F.lit(level))
        out = x if out is None else out.union(x)
    return out


def predictions(levels: list[DataFrame]) -> list[DataFrame]:
    """(context, path, p) of every level: the probability of a one where no deeper node is known.

    From the root down, ``above`` is what the shallower nodes add and ``left`` the weight that they pass on.
    """
    out, one = [], (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    for level, x in enumerate(levels):
        nodes = x.select("context", "path", one.alias("one"), "stop")
        if level:
            up = out[-1].select(F.col("context").alias("parent"), F.col("path").alias("up_path"), "above", "left")
            nodes = nodes.join(up, F.expr(f"(context & {(1 << 8 * (level - 1)) - 1}L) = parent AND path = up_path"))
        else:
            nodes = nodes.withColumns({"above": F.lit(0.0), "left": F.lit(1.0)})
        own = F.col("left") * F.col("one")
        nodes = nodes.select(
            "context", "path", (F.col("above") + own).alias("p"), (F.col("above") + own * F.col("stop")).alias("above"), (F.col("left") * (1.0 - F.col("stop"))).alias("left")
        )
        out.append(materialize(nodes, f"predictions{level}"))
    return [x.select("context", "path", "p") for x in out]


def _walk(keys: np.ndarray, p: np.ndarray, context: np.ndarray, key: np.ndarray, done: np.ndarray, log_p: np.ndarray) -> None:
    """Take each type's next decisions as far as the nodes (sorted by context and path) are known."""
    byte = key & np.uint64(255)
    for i in range(8 if len(keys) else 0):
        node = (context << np.uint64(8)) | np.uint64(1 << i) | (byte >> np.uint64(8 - i))
        at = np.minimum(np.searchsorted(keys, node), len(keys) - 1)
        go = np.flatnonzero((done == i) & (keys[at] == node))
        one = p[at[go]]
        log_p[go] += np.log10(np.where((byte[go] >> np.uint64(7 - i)) & np.uint64(1), one, 1.0 - one))
        done[go] += 1


_ASKED = "key long, done int, log_p double"


def _rows(key: np.ndarray, done: np.ndarray, log_p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(done), pa.array(log_p)], ["key", "done", "log_p"])


def _resolve(asked: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """One level's part of the types' decisions: types meet the nodes of their context in one sorted shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ps = np.empty(0, np.uint64), np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            context = batch.column("context").to_numpy().view(np.uint64)
            path, p = batch.column("path").to_numpy(), batch.column("p").to_numpy()
            node = path < 256
            keys = np.concatenate([keys, (context[node] << np.uint64(8)) | path[node].astype(np.uint64)])
            ps = np.concatenate([ps, p[node]])
            if not node.all():
                key, done = (batch.column(c).to_numpy()[~node].copy() for c in ("key", "done"))
                key, log_p = key.view(np.uint64), p[~node].copy()
                _walk(keys, ps, context[~node], key, done, log_p)
                yield _rows(key, done, log_p)
            kept = keys >= context[-1] << np.uint64(8)  # the last context may go on in the next batch
            keys, ps = keys[kept], ps[kept]

    context = F.expr(f"shiftrightunsigned(key, 8) & {(1 << 8 * level) - 1}L").alias("context")
    types_ = asked.select(context, F.lit(256).alias("path"), F.col("log_p").alias("p"), "key", "done")
    both = nodes.select("context", "path", "p", F.lit(0).cast("long").alias("key"), F.lit(0).alias("done")).union(types_)
    return both.repartition("context").sortWithinPartitions("context", "path").mapInArrow(run, _ASKED)


def log_probabilities(types_: DataFrame, predicted: list[DataFrame]) -> DataFrame:
    """(key, log_p): log10 probability by the whole tree of each of the distinct packed types ``key``.

    Types meet the nodes level by level, from the deepest; only those with decisions that a level
    doesn't know go on. Levels 0 and 1, which have at most 65,535 nodes, are broadcast.
    """
    depth = len(predicted) - 1
    asked = types_.select("key", F.lit(0).alias("done"), F.lit(0.0).alias("log_p"))
    finished = []
    for level in range(depth, 1, -1):
        asked = materialize(_resolve(asked, predicted[level], level), f"asked{level}")
        finished.append(asked.filter("done = 8").select("key", "log_p"))
        asked = asked.filter("done < 8")
    top = []
    for level in range(min(depth, 1), -1, -1):
        found = predicted[level].orderBy("context", "path").toArrow()
        keys = (found["context"].to_numpy().astype(np.uint64) << np.uint64(8)) | found["path"].to_numpy().astype(np.uint64)
        top.append((np.uint64((1 << 8 * level) - 1), keys, found["p"].to_numpy()))
    tables = types_.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, done, log_p = (batch.column(c).to_numpy().copy() for c in ("key", "done", "log_p"))
            key = key.view(np.uint64)
            for mask, keys, p in tables.value:
                _walk(keys, p, (key >> np.uint64(8)) & mask, key, done, log_p)
            yield _rows(key, done, log_p + (8 - done) * math.log10(0.5))

    out = asked.mapInArrow(run, _ASKED).select("key", "log_p")
    for x in finished:
        out = out.union(x)
    return out


def frequent_types(counts: DataFrame, limit: int) -> DataFrame:
    """(key): the types seen most often, at most ``limit``; those of about equal counts go together."""
    types_ = counts.filter("kind = 1").select("key", F.floor(F.log2("n") * 8).cast("int").alias("class"))
    total, least = 0, None
    for r in types_.groupBy("class").count().orderBy(F.desc("class")).collect():  # at most 8 * 63 rows
        total += r["count"]
        if total > limit:
            break
        least = r["class"]
    return types_.filter(F.lit(False) if least is None else F.col("class") >= least).select("key")


def _slot_hash(level: int | np.ndarray, context: np.ndarray, path: np.ndarray) -> np.ndarray:
    h = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + path.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(h + np.asarray(level).astype(np.uint64) * np.uint64(0x165667B19E3779F9))


class TreeTable:
    """The tree in a hash table of a fixed number of slots, an approximation for a look at single types; ``score`` uses the whole tree.

    Of nodes that share a slot the one seen most often has it; a 15-bit tag tells others
    apart, which then count as unseen. Where a context has no node of its own, the tree ends
    and the node above speaks for itself. Any content gives probabilities that sum to one.
    """

    def __init__(self, tag: np.ndarray, one: np.ndarray, stop: np.ndarray, depth: int):
        self.tag, self.one, self.stop, self.depth = tag, one, stop, depth

    def log10(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each packed type in its context."""
        context, byte = packed >> np.uint64(8), packed & np.uint64(255)
        low, total = np.uint64(len(self.tag) - 1), np.zeros(len(packed))
        for i in range(8):
            path = np.uint64(1 << i) | (byte >> np.uint64(8 - i))
            p, deeper = np.full(len(packed), 0.5), np.zeros(len(packed), bool)
            for level in range(self.depth, -1, -1):
                h = _slot_hash(level, context & np.uint64((1 << 8 * level) - 1), path)
                at = h & low
                known = self.tag[at] == (h >> np.uint64(49)).astype(np.uint16) + 1
                stop = np.where(deeper, self.stop[at], 1.0)
                p = np.where(known, stop * self.one[at] + (1.0 - stop) * p, 0.5)
                deeper = known
            bit = (byte >> np.uint64(7 - i)) & np.uint64(1)
            total += np.log10(np.where(bit == 1, p, 1.0 - p))
        return total


def tree_table(nodes: DataFrame, depth: int = DEPTH, slot_bits: int = SLOT_BITS) -> TreeTable:
    """Fill the slots: at most 2 ** slot_bits rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, context, path, n0, n1, stop = (batch.column(c).to_numpy() for c in ("level", "context", "path", "n0", "n1", "stop"))
            h = _slot_hash(level, context, path)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((h & np.uint64((1 << slot_bits) - 1)).astype(np.int32)),
                    pa.array(n0 + n1),
                    pa.array(((h >> np.uint64(49)) + np.uint64(1)).astype(np.int32)),
                    pa.array(((n1 + 0.5) / (n0 + n1 + 1.0)).astype(np.float32)),
                    pa.array(stop.astype(np.float32)),
                ],
                ["slot", "n", "tag", "one", "stop"],
            )

    rows = nodes.select("level", "context", "path", "n0", "n1", "stop").mapInArrow(run, "slot int, n long, tag int, one float, stop float")
    best = rows.groupBy("slot").agg(F.max(F.struct("n", "tag", "one", "stop")).alias("x")).select("slot", "x.tag", "x.one", "x.stop")
    found, size = best.toArrow(), 1 << slot_bits
    tag, one, stop = np.zeros(size, np.uint16), np.zeros(size, np.float32), np.zeros(size, np.float32)
    at = found["slot"].to_numpy()
    tag[at], one[at], stop[at] = found["tag"].to_numpy().astype(np.uint16), found["one"].to_numpy(), found["stop"].to_numpy()
    return TreeTable(tag, one, stop, depth)


def score(docs: DataFrame, train: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, slot_bits: int = SLOT_BITS) -> DataFrame:
    """Score every row of ``docs`` by models learnt from all rows of ``train``.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte (bytes
    count the end of the text). A-Z are lower-cased. Null counts as empty: one token, the end.
    Repeated rows give repeated results; other columns are ignored. An empty training table
    gives uniform models.

    Words with a share of training tokens of at least 2 ** -FREQUENT_BITS, whose number
    is bounded by that, are looked up in a broadcast table; the rest meet their counts in a join, in which no word
    can hold more than that share of the training rows. Types (contexts with their byte) do likewise: the
    2 ** slot_bits seen most often are broadcast with their probabilities, the rest meet the whole tree in
    joins. What is broadcast makes no difference to the scores.
    """
    spark = docs.sparkSession
    counts = materialize(count_table(train, text=text, depth=depth), "counts")
    words = counts.filter("kind = 0")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_train, distinct = int(total[0]), int(total[1])
    denominator = n_train + 0.1 * (distinct + 1)
    least = max(1, math.ceil(n_train / 2**FREQUENT_BITS))
    found = words.filter(F.col("n") >= least).select("key", "n").orderBy("key").toArrow()
    frequent = spark.sparkContext.broadcast((found["key"].to_numpy(), found["n"].to_numpy()))
    del found
    predicted = predictions(_levels(counts, depth))
    found = log_probabilities(frequent_types(counts, 1 << slot_bits), predicted).orderBy("key").toArrow()
    model = spark.sparkContext.broadcast((found["key"].to_numpy().view(np.uint64), found["log_p"].to_numpy()))
    del found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns = frequent.value
        logs = np.log10((ns + 0.1) / denominator)
        type_keys, type_logs = model.value
        memo_key = np.full(1 << _MEMO_BITS, np.iinfo(np.uint64).max, np.uint64)
        memo = np.zeros(1 << _MEMO_BITS)
        place = lambda t: (t * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMO_BITS)

        def look_up(t: np.ndarray) -> np.ndarray:
            if not len(type_keys):
                return np.full(len(t), np.nan)
            at = np.minimum(np.searchsorted(type_keys, t), len(type_keys) - 1)
            return np.where(type_keys[at] == t, type_logs[at], np.nan)

        def log10(t: np.ndarray) -> np.ndarray:
            at = place(t)
            out = memo[at]
            miss = np.flatnonzero(memo_key[at] != t)
            if len(miss):
                new, back = np.unique(t[miss], return_inverse=True)
                values = look_up(new)
                out[miss] = values[back]
                _, last = np.unique(place(new)[::-1], return_index=True)  # one type for each place
                last = len(new) - 1 - last
                memo_key[place(new[last])] = new[last]
                memo[place(new[last])] = values[last]
            return out

        for batch in slices(batches):
            ids = batch.column("doc_id")
            texts = [t.lower() for t in column_bytes(batch, "text")]
            for a, b in _chunks(texts):
                part = texts[a:b]
                split = [t.split() for t in part]
                sizes = np.array([len(s) + 1 for s in split])
                h = word_hashes([w for s in split for w in (*s, b"")]).view(np.int64)
                ends = np.cumsum(sizes)
                base, known, rare = np.zeros(len(h)), np.zeros(len(h), np.int64), np.ones(len(h), bool)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    rare = keys[at] != h
                    base = np.where(rare, 0.0, logs[at])
                    known = (~rare).astype(np.int64)
                starts = ends - sizes
                left = [h[x:y][rare[x:y]] for x, y in zip(starts, ends, strict=True)]
                offsets = np.cumsum([0, *map(len, left)], dtype=np.int32)
                packed = types(part, depth)
                bits = log10(packed)
                n_bytes = np.array([len(t) + 1 for t in part])
                missed = np.isnan(bits)
                rare_types = packed[missed].view(np.int64)
                type_offsets = np.concatenate([[0], np.cumsum(missed)[np.cumsum(n_bytes) - 1]]).astype(np.int32)
                bits[missed] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(np.add.reduceat(known, starts)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(bits, np.cumsum(n_bytes) - n_bytes)),
                        pa.array(n_bytes.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(left))),
                        pa.ListArray.from_arrays(pa.array(type_offsets), pa.array(rare_types)),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base", "score", "n_bytes", "rare", "rare_types"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, rare_types array<long>"
    scored = materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("key"))
    seen = words.filter(F.col("n") < least).select("key", "n")
    met = rare.join(seen, "key", "left").groupBy("row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(denominator))).alias("rare_base"), F.count("n").alias("rare_known")
    )
    rare_types = scored.select("row", F.explode("rare_types").alias("key"))
    values = log_probabilities(rare_types.select("key").distinct(), predicted)
    met_types = rare_types.join(values, "key").groupBy("row").agg(F.sum("log_p").alias("rare_score"))
    joined = scored.drop("rare", "rare_types").join(met, "row", "left").join(met_types, "row", "left")
    score_ = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        score_.alias("score"),
        "n_bytes",
        (-score_ * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
