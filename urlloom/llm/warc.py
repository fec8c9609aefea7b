"""WARC archives with revisit records, and their index merged by URL key and timestamp.

An archive is a sequence of gzip members, one a record, so an index entry's offset and length address a record in the
file. Between members stands an empty member, which the sink writes as its line separator. Archives
are read as a stream of records; each part of a file that a task reads gives a run of the index, sorted
by URL key and timestamp. Runs are dealt out by key range, and every range is merged from its
slices of the runs with a loser tree, which gives globally ordered capture histories.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlloom.llm.common import discard, materialize, meet, slices, work_dir

#: Bytes of payload that an archive holds at most, about; small tables make archives of SMALL_BYTES, up to the number of shuffle partitions.
ARCHIVE_BYTES, SMALL_BYTES = 1 << 30, 16 << 20
#: Entries of a key range, about, and of a run at most: what a task holds in the merge and when it reads.
RANGE_ENTRIES, RUN_ENTRIES = 200_000, 50_000
#: An empty gzip member.
_SEPARATOR = zlib.compressobj(wbits=31).flush()
MIN_PAYLOAD = 0
_EPOCH = "2024-01-01T00:00:00Z"
_INDEX = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits at a time to four digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n"))).otherwise(F.lit(""))


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    captured: Column | None = None,
    min_payload: int = MIN_PAYLOAD,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write one record for each row to WARC files below ``path``.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least
    ``min_payload`` bytes the one with the largest page id becomes a response and the others
    revisit it; rows that repeat that id with that payload are responses too. A null id is
    smaller than any other. ``captured`` defaults to a time that grows with the page id.

    Digests are counted in a map-side combined aggregate; ids meet the digests that occur several times with
    hot ones broadcast, so a payload that a third of the pages share holds up no task; the html is dealt out once, by page id.
    Members go through Spark's own text sink as bytes, with its commit protocol. A page is held whole, however long.
    """
    if captured is None:
        captured = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(_EPOCH))) + F.coalesce(F.col(page_id), F.lit(0)).cast("long"))
    payload, no_id = F.coalesce(F.col(html), F.lit("")), F.lit(-(2**63))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        base32_sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    )
    spark = pages.sparkSession
    small = materialize(rows.select("page_id", "digest", "bytes"), "digests")
    total = small.agg(F.sum(F.col("bytes") + 600)).first()[0] or 0
    several = small.filter(F.col("bytes") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 and kept is not null")
    several = materialize(several, "several")
    many = several.agg(F.sum("n")).first()[0] or 0
    revisits = (
        meet(small, several, ["digest"], "n", many)
        .filter(~F.col("page_id").eqNullSafe(F.col("kept")))
        .select(F.coalesce("page_id", no_id).alias("r_id"), F.col("digest").alias("r_digest"), F.col("kept").alias("refers_to"))
        .distinct()
    )
    revisits = materialize(revisits, "revisits")
    discard(small, several)
    n = max(1, -(-int(total) // archive_bytes), min(-(-int(total) // SMALL_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = rows.withColumn("key", F.coalesce("page_id", no_id)).repartition(n, "key", "digest")
    dealt = placed.join(revisits.hint("shuffle_hash"), (F.col("key") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("refers_to").isNotNull()
    body = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes"),
        F.lit("\r\n\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.col("captured")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("body"),
        F.lit("\r\n\r\n"),
        F.col("body"),
        F.lit("\r\n\r\n"),
    )
    members = dealt.withColumn("body", body).select(record.alias("record")).mapInArrow(_members, "value binary")
    sink = members.select(F.col("value").cast("string").alias("value")).write
    sink.option("lineSep", _SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    discard(revisits)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        packed = []
        for x in batch.column("record"):
            deflate = zlib.compressobj(wbits=31)
            packed.append(deflate.compress(x.as_py().encode()) + deflate.flush())
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["value"])


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower-cased; empty for none."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    port = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive; anything else is an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where it says")
        yield at, stop + 4 - at, headers, data[start:stop]
        at = stop + 4


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _entry(archive: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", head)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or size != len(payload):
            raise ValueError(f"payload of the record at {offset} of {archive} is damaged")
    url = headers.get("WARC-Target-URI")
    return (
        url_key(url),
        headers["WARC-Date"],
        _page(headers["WARC-Record-ID"]),
        url,
        headers["WARC-Type"],
        _page(headers.get("WARC-Refers-To")),
        size,
        digest,
        archive,
        offset,
        length,
    )


def _order(entry: tuple) -> tuple:
    """URL key and time first; then what tells records apart, so the order is total."""
    return entry[0], entry[1], -1 if entry[2] is None else entry[2], entry[8], entry[9]


def read_record(data: bytes) -> tuple[int, int, dict[str, str], bytes]:
    """The one record of a gzip member, as ``read_records`` gives it."""
    inflate = zlib.decompressobj(wbits=31)
    plain = inflate.decompress(data)
    if not inflate.eof or inflate.unused_data:
        raise ValueError("a member is cut off or followed by something else")
    found = list(read_records(plain))
    if len(found) != 1:
        raise ValueError(f"a member holds {len(found)} records")
    return found[0]


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index of all archives below ``path``, a sorted run after the other; offset and length address members in the file.

    Spark splits large archives; a task holds one record and the entries of one run. Payloads of responses are
    checked against their digests. Where a record stands follows from the lengths of those before it in its
    split, and from the sums of the splits before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at, entries = None, 0, []
        for batch in slices(batches):
            for name, block, data in zip(*[batch.column(c) for c in ("archive", "block", "data")], strict=True):
                if (name.as_py(), block.as_py()) != place or len(entries) >= RUN_ENTRIES:
                    if entries:
                        yield _local(entries)
                    at = at if (name.as_py(), block.as_py()) == place else 0
                    place, entries = (name.as_py(), block.as_py()), []
                member = data.as_buffer().to_pybytes()
                if member:
                    _, _, headers, block_ = read_record(member)
                    entries.append((*_entry(place[0], at, len(member), headers, block_), place[1]))
                at += len(member) + len(_SEPARATOR)
        if entries:
            yield _local(entries)

    files = spark.read.option("pathGlobFilter", "part-*").option("lineSep", _SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    parts = files.select(F.col("_metadata.file_name").alias("archive"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))
    local = materialize(parts.mapInArrow(run, f"{_INDEX}, block long"), "local")
    ends = local.groupBy("archive", "block").agg((F.max(F.col("offset") + F.col("length")) + len(_SEPARATOR)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("archive").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    starts = ends.select("archive", "block", before).filter("before > 0")
    if not starts.head(1):
        return local.drop("block")
    placed = local.join(starts, ["archive", "block"], "left").withColumn("offset", F.col("offset") + F.coalesce("before", F.lit(0)))
    return placed.select(*_NAMES)


def _local(entries: list[tuple]) -> pa.RecordBatch:
    entries.sort(key=_order)
    plain = _batch([e[:-1] for e in entries])
    return pa.RecordBatch.from_arrays([*plain.columns, pa.array([e[-1] for e in entries], pa.int64())], [*_NAMES, "block"])


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    columns = [pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*entries, strict=True), _INDEX.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


class LoserTree:
    """Merges sorted iterables: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: Iterable[Iterable], key):
        self._key, self._runs = key, [iter(r) for r in runs]
        self._width = 1
        while self._width < len(self._runs):
            self._width *= 2
        self._heads = [self._next(i) for i in range(len(self._runs))]
        self._losers = [0] * self._width
        winners = [*[0] * self._width, *range(self._width)]
        for node in range(self._width - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self._losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self._winner = winners[1]

    def _next(self, i: int):
        for item in self._runs[i]:
            return self._key(item), item
        return None

    def _beats(self, a: int, b: int) -> bool:
        head_a = self._heads[a] if a < len(self._heads) else None
        head_b = self._heads[b] if b < len(self._heads) else None
        if head_a is None or head_b is None:
            return head_a is not None or (head_b is None and a < b)
        return (head_a[0], a) < (head_b[0], b)

    def __iter__(self) -> Iterator:
        while self._heads and self._heads[self._winner] is not None:
            i = self._winner
            yield self._heads[i][1]
            self._heads[i] = self._next(i)
            node = (self._width + i) // 2
            while node:
                if self._beats(self._losers[node], i):
                    self._losers[node], i = i, self._losers[node]
                node //= 2
            self._winner = i


def sorted_runs(entries: Iterable[tuple], key=_order) -> list[list[tuple]]:
    """Cut a sequence where it falls: each piece is a sorted run."""
    runs: list[list[tuple]] = []
    last = None
    for e in entries:
        k = key(e)
        if last is None or k < last:
            runs.append([])
        runs[-1].append(e)
        last = k
    return runs


def merge_runs(runs: DataFrame) -> DataFrame:
    """Globally ordered captures: ``position`` is their place, from 1, and ``capture_no`` counts a URL key's captures.

    Ranges are cut by URL key, time and id, so a URL with very many captures takes several
    ranges, and hold about RANGE_ENTRIES entries, so a task's part stays small however many runs there are. Shuffled slices of
    runs arrive in pieces that are still sorted; a range is cut
    into the sorted pieces it got, in whatever order they came, and those are merged. Both numbers run through
    all ranges: a range adds how many captures the ones before it hold, in all and of its first key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        out, before, count = [], None, 0
        for at, entry in enumerate(LoserTree(sorted_runs(rows()), _order), 1):
            count = count + 1 if entry[0] == before else 1
            before = entry[0]
            out.append((*entry, count, at))
            if len(out) == 10_000:
                yield _numbered(out)
                out = []
        if out:
            yield _numbered(out)

    spark = runs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ENTRIES))
    dealt = runs.repartitionByRange(parts, "url_key", "captured", F.coalesce("page_id", F.lit(-1)), "archive", "offset")
    merged = materialize(dealt.mapInArrow(run, f"{_INDEX}, capture_no long, position long").withColumn("part", F.spark_partition_id()), "merged")
    by_part = merged.groupBy("part").agg(F.min("url_key").alias("url_key"), F.count(F.lit(1)).alias("n"))
    starts = by_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    firsts = by_part.select("url_key")
    held = merged.join(F.broadcast(firsts.distinct()), "url_key").groupBy("url_key", "part").agg(F.max("capture_no").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = held.select("url_key", "part", earlier.alias("carried")).filter("carried > 0")
    joined = merged.join(F.broadcast(carried), ["url_key", "part"], "left").join(F.broadcast(starts), "part")
    return joined.select(*_NAMES, (F.col("capture_no") + F.coalesce("carried", F.lit(0))).alias("capture_no"), (F.col("start") + F.col("position")).alias("position"))


def _numbered(entries: list[tuple]) -> pa.RecordBatch:
    plain = _batch([e[:-2] for e in entries])
    return pa.RecordBatch.from_arrays([*plain.columns, *[pa.array([e[i] for e in entries], pa.int64()) for i in (-2, -1)]], [*_NAMES, "capture_no", "position"])


def capture_histories(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives, read them back, and merge their index.

    One row for each row of ``pages``; ``position`` is the global order. An empty table
    gives an empty result. Columns other than id, url and html are ignored.
    """
    spark = pages.sparkSession
    path = path or work_dir(spark, "warc")
    write_archives(pages, path, **options)
    return merge_runs(index_runs(spark, path))
