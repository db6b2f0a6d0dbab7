"""WARC archives: writing with revisit records, reading back, and a merged capture index.

Archives are written by Spark's text writer with CRLF CRLF, the end of a WARC
record, as its line separator, so every part file is a plain WARC 1.1 file.
Reading a file gives a run of index entries, sorted by URL key and time where it
is read.  The runs are dealt by ranges of their whole key, down to file and offset,
so that captures of one URL and time can lie in several ranges and none is larger
than others.  Where a range arrives, its ascending stretches are the parts of the
runs, which the shuffle has kept in order; a loser tree merges them, and nothing is
sorted again.  The captures of all URLs come out in one global order, the history
of each URL in order of time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh_path, stored, table

#: Payloads of at least so many bytes are stored once.
REVISIT_FROM = 1000
#: Archives are cut at about so many payload bytes, and never above _MOST but for a single page.
FILE_BYTES = 16 << 20
#: Pages below these sizes share archives, those of each class apart, so that a run of large pages can't swell one.
_CLASSES, _MOST = (128 << 10, 4 << 20, 1 << 62), 1 << 30
#: A range of the merged index has about so many entries.
RANGE_ROWS = 50_000
EPOCH = 1_700_000_000
END = "\r\n\r\n"


def with_record_types(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """Adds payload (html, null as empty), payload_bytes, payload_digest, record_type and refers_to.

    Of the rows with equal payloads of at least ``least`` bytes the one with the
    largest page_id is the response and the others revisit it.  Rows that repeat
    that page_id are responses too; a null page_id is smaller than any.
    """
    p = pages.withColumn("payload", F.coalesce(html, F.lit("")))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    copied = p.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max(page_id).alias("last")).where("n > 1")
    copied = stored(copied.select(F.col("payload_digest").alias("digest"), "last"))  # Spark sees its true size: it broadcasts this side only if small
    p = p.join(copied, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("last").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("last")) & (F.col("payload_bytes") >= least)
    return p.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("last"))).drop("digest", "last")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", least: int = REVISIT_FROM, file_bytes: int = FILE_BYTES) -> None:
    """Writes one WARC record for each row of pages, into a folder for each class of sizes."""
    p = with_record_types(pages, page_id, least=least)
    bytes_ = F.coalesce(F.octet_length("html"), F.lit(0))
    kind = F.lit(len(_CLASSES) - 1)
    for k in range(len(_CLASSES) - 2, -1, -1):
        kind = F.when(bytes_ < _CLASSES[k], k).otherwise(kind)
    classes = pages.groupBy(kind.alias("k")).agg(F.avg(bytes_).alias("mean"), F.max(bytes_).alias("most")).collect()  # three rows at most
    line = F.lit("\r\n")
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")
    name = lambda x: F.concat(F.lit("<urn:x-page:"), x.cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    seconds = F.lit(EPOCH).cast("long") + F.coalesce(F.pmod(F.col(page_id).cast("long"), F.lit(31_536_000)), F.lit(0))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")  # by days and seconds, as dates know no zone
    part = lambda size, of: F.floor(seconds % of / size).cast("int")
    when = F.concat(day, F.format_string("T%02d:%02d:%02dZ", part(3600, 86_400), part(60, 3600), part(1, 60)))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), line,
        F.coalesce(F.concat(F.lit("WARC-Record-ID: "), name(F.col(page_id)), line), F.lit("")),
        F.lit("WARC-Date: "), when, line,
        F.lit("WARC-Target-URI: "), clean, line,
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers_to")), line)).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), line,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows = p.select(F.concat(head, block).alias("value"), F.col("payload_bytes"))
    for c in classes or [{"k": 0, "mean": 0, "most": 0}]:
        low, high = ([0, *_CLASSES][c["k"]], _CLASSES[c["k"]]) if len(classes) > 1 else (0, _CLASSES[-1])
        records_ = max(1, min(int(file_bytes / (c["mean"] + 600)), int(_MOST / (c["most"] + 600))))
        own = rows.where((F.col("payload_bytes") >= low) & (F.col("payload_bytes") < high)).select("value")
        own.write.option("lineSep", END).option("maxRecordsPerFile", records_).text(f"{path}/sizes-{c['k']}")


def url_key(url: str) -> str:
    """The URL with its host reversed, in lower case, without scheme, www and fragment: key order puts a site's pages together."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    if not host:
        return url
    query = f"?{parts.query.lower()}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path.lower() or '/'}{query}"


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, headers, block) of each record of a WARC file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield at, stop + 4 - at, fields, view[end + 4 : stop]
        at = stop + 4


INDEX = "url_key string, time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
_FIELDS = [f.split(" ") for f in INDEX.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _key(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[7], row[8]


def _read_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x[len("<urn:x-page:") : -1]) if x else None
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, rows, name = content.as_py(), [], "/".join(path.rsplit("/", 2)[1:])
            for offset, length, head, block in records(data):
                body = bytes(block)
                cut = body.find(b"\r\n\r\n") + 4
                size = int(body[:cut].rpartition(b"Content-Length: ")[2])
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if kind == "response":
                    got = hashlib.sha1(body[cut:]).hexdigest()
                    if got != digest or len(body) - cut != size:
                        raise ValueError(f"{path}: the payload at byte {offset} does not have its digest and length")
                rows.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], number(head.get("WARC-Record-ID")), size, digest, kind, number(head.get("WARC-Refers-To")), name, offset, length))
            rows.sort(key=_key)
            yield _batch(rows)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of all archives, each archive's sorted: a run for each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_read_run, INDEX)


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its game, so an item costs one comparison a level."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.k = len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int) -> None:
        at, winner = (i + self.k) // 2, i
        while at:
            other = self.tree[at]
            if other < 0:
                self.tree[at] = winner
                return
            if self._less(other, winner):
                self.tree[at], winner = winner, other
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            i = self.tree[0]
            head = self.heads[i]
            if head is None:
                return
            yield head
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(batches, schema=pa.schema([(n, _TYPES[t]) for n, t in _FIELDS]))
    columns = [whole.column(k).to_pylist() for k in (0, 1, 2, 7, 8)]
    keys = list(zip(columns[0], columns[1], (-1 if x is None else x for x in columns[2]), columns[3], columns[4], strict=True))
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]  # ascending stretches
    shard, place, order = TaskContext.get().partitionId(), 0, []
    merged = iter(LoserTree([((keys[i], i) for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]))
    while order := [i for _, i in islice(merged, 10_000)]:
        out = whole.take(pa.array(order, pa.int64())).combine_chunks().to_batches()[0]
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array([shard] * len(order), pa.int32()), pa.array(range(place, place + len(order)), pa.int64())], [*out.schema.names, "shard", "place"])
        place += len(order)


def merged_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The entries of all runs in the global order of (url_key, time): by shard, then by place in it.  A task holds one range."""
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    return runs.repartitionByRange(parts, "url_key", "time", "page_id", "file", "offset").mapInArrow(_merge, INDEX + ", shard int, place long")


def archive(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages as WARC archives below path (by default in the shared folder), reads them back and returns the merged capture index.

    One entry for each row of pages, repeated rows too.  A null html is an empty
    payload, a null url an empty one; null page_ids stay null.  An empty table
    gives an empty index.  Other columns are ignored.  An archive is read whole,
    so a page may be as large as a binary value (2 GB with its headers).
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), path)
    return merged_index(stored(read_runs(spark, path)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "time", "shard", "place")


ORACLE_COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
