"""WARC archives with payload dedup, and a globally ordered capture index (operator 9).

Method: pages become WARC/1.1 records, each a gzip member of its own, so that
the offset and length of a capture address its record.  Spark's text writer puts
them into files of about ``FILE_BYTES``, committed whole into the shared folder;
its line end is an empty gzip member, which decompresses to nothing.  Reading an
archive back, record by record, gives a run of captures sorted by URL key and
timestamp.  Runs are cut at common splitters; each range is merged from its
runs' pieces by a k-way loser tree, and the ranges follow each other, so that
capture histories are in global order.  The merge is external: Spark's sorter,
which spills, lays the pieces of a range one after another, a file of the task
mapped into memory holds them, and the tree keeps one row of each.  Splitters
go down to run and offset, hence one URL's history can span ranges.

Defined results: null html is an empty payload; a null url leaves the header out
and sorts first; of equal payloads of at least ``least`` bytes the record of
the largest page_id is the response, all others revisit it; repeated rows of that
page_id are all responses; rows with a null page_id never are what others refer
to; a record longer than ``FILE_BYTES`` is a file by itself; an empty table gives
an empty index; columns besides the named ones are not read.  Without a column
of dates, records are dated by page_id (seconds after the year 2000), so that
results can be repeated.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bytes of compressed records in an archive, captures to a range of the merge, about, and ranges at most.
FILE_BYTES, RANGE, MOST_RANGES = 32 << 20, 100_000, 20_000
#: What every gzip member begins with here, and an empty member.
MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
FIELDS = "run string, offset long, length long, urlkey string, timestamp string, url string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long"


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, date: str | None = None) -> DataFrame:
    """page_id, url, html, date, size, digest (SHA-1), record_type and refers_to of each row; date: a column of timestamps."""
    made_up = F.timestamp_seconds(F.lit(946684800) + F.pmod(F.coalesce(pages[f"`{key}`"].cast("long"), F.lit(0)), F.lit(1_000_000_000)))
    plain = pages.select(
        pages[f"`{key}`"].cast("long").alias("page_id"), pages[f"`{url}`"].cast("string").alias("url"), F.coalesce(pages[f"`{html}`"].cast("string"), F.lit("")).alias("html"),
        (F.coalesce(pages[f"`{date}`"].cast("timestamp"), made_up) if date else made_up).alias("date"),
    )
    sized = plain.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    seen = sized.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = sized.join(seen, "digest", "left")
    again = F.col("first").isNotNull() & (F.coalesce(F.col("page_id") != F.col("first"), F.lit(True))) & (F.col("size") >= least)
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def write(found: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the output of records() as WARC files into a folder, a gzip member to a record."""
    C.ship(found.sparkSession)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    when = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", when),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    whole = F.concat(head, line("Content-Length", F.octet_length("_block").cast("string")), F.lit("\r\n"), "_block", F.lit(END))
    out = found.withColumn("_block", block).select(whole.alias("value"))

    @C.lean
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size = 0, 0
        for b in batches:
            for i, j in C.slices(b.column(0), 4 << 20):
                made, of = [], []
                for record in b.column(0).slice(i, j - i):
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    made.append(pack.compress(record.as_buffer()) + pack.flush())
                    if size and size + len(made[-1]) > file_bytes:
                        file, size = file + 1, 0
                    size += len(made[-1])
                    of.append(file)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(made, pa.binary())], names=["archive", "value"])

    made = out.mapInArrow(members, "archive int, value binary").select("archive", F.col("value").cast("string").alias("value"))  # its bytes, unchanged
    made.write.partitionBy("archive").option("lineSep", MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def member(data: memoryview, at: int, step: int = 1 << 14) -> tuple[bytes, int]:
    """What the gzip member at a place holds, and where it ends."""
    unpack, parts, end = zlib.decompressobj(31), [], at
    while not unpack.eof:
        chunk = data[end : end + step]
        if not len(chunk):
            raise ValueError(f"the member at {at} is cut off")
        parts.append(unpack.decompress(chunk))
        end += len(chunk)
    return b"".join(parts), end - len(unpack.unused_data)


def parse(data: memoryview) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers (names in lower case) and block of each record of an archive, one after another."""
    at = 0
    while at < len(data):
        record, end = member(data, at)
        if record:
            yield at, end - at, *headers_and_block(record, at)
        at = end


def headers_and_block(record: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    cut = record.index(b"\r\n\r\n")
    first, *rest = record[:cut].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
    end = cut + 4 + int(headers["content-length"])
    if record[end:] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    return headers, record[cut + 4 : end]


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then the path; without scheme, port 80 and case of the host."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    host, slash, path = rest.partition("/")
    name = host.rpartition("@")[2].lower().removesuffix(":80").removesuffix(":443").removeprefix("www.")
    return ",".join(reversed(name.split("."))) + ")" + slash + path


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def capture(run: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> dict:
    """The index entry of a record; a response's digest and length are taken from its payload as read."""
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["warc-type"] == "revisit"
    stated = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest()
    url = headers.get("warc-target-uri")
    return {
        "run": run, "offset": offset, "length": length, "urlkey": url_key(url), "timestamp": "".join(c for c in headers["warc-date"] if c.isdigit()), "url": url,
        "page_id": _page(headers["warc-record-id"]), "record_type": headers["warc-type"], "refers_to": _page(headers.get("warc-refers-to")),
        "payload_digest": digest, "payload_bytes": stated if revisit else len(payload),
    }


def order(x: dict) -> tuple:
    return x["urlkey"], x["timestamp"], -1 if x["page_id"] is None else x["page_id"], x["run"], x["offset"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in a folder; those of one archive are a sorted run."""
    C.ship(spark)
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (f.split(" ") for f in FIELDS.split(", "))])

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = "/".join(name.split("/")[-2:])
                found = sorted((capture(own, *r) for r in parse(memoryview(content.as_buffer()))), key=order)
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, FIELDS)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator], key: Callable) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head: list = [None] * self.k
        self.keys: list = [None] * self.k  # None: the run has ended
        for i in range(self.k):
            self.advance(i)
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self.climb(i)

    def advance(self, i: int) -> None:
        self.head[i] = next(self.runs[i], None)
        self.keys[i] = None if self.head[i] is None else self.key(self.head[i])

    def beats(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        return ka is not None and (kb is None or (ka, a) < (kb, b))

    def climb(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the first to come waits for its match
                self.tree[node] = i
                return
            if self.beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.k and self.keys[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.head[i]
            self.advance(i)
            self.climb(i)


def merge(captures: DataFrame, size: int = RANGE) -> DataFrame:
    """The captures in global order of URL key, timestamp and page: ``part`` and ``place`` in it give the order."""
    spark = captures.sparkSession
    C.ship(spark)
    stored = C.table(captures, "captures")
    parts = min(C.pieces(stored.count(), size, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)
    keys = ["urlkey", "timestamp", F.coalesce("page_id", F.lit(-1))]
    dealt = stored.repartitionByRange(parts, *keys, "run", "offset").sortWithinPartitions("run", *keys, "offset")

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        # the task's own spill: it has no name any more when it is read
        with tempfile.NamedTemporaryFile() as f:
            rows, writer, ends, last = 0, None, [], None
            for b in batches:
                if not b.num_rows:
                    continue
                writer = writer or pa.ipc.new_file(f, b.schema)
                writer.write_batch(b)
                of = b.column(0).dictionary_encode()
                use, names = of.indices.to_numpy(), of.dictionary.to_pylist()
                new = np.flatnonzero(np.append(names[use[0]] != last, use[1:] != use[:-1]))
                ends += (rows + new).tolist()
                last, rows = names[use[-1]], rows + b.num_rows
            if writer is None:
                return
            writer.close()
            f.flush()
            source = pa.memory_map(f.name)
        with source:
            pieces = pa.ipc.open_file(source)
            held = [pieces.get_batch(i) for i in range(pieces.num_record_batches)]  # mapped, not read
            starts = np.cumsum([0, *(b.num_rows for b in held)])
            merged = LoserTree([captured(held, starts, i, j) for i, j in zip(ends, [*ends[1:], rows], strict=True)], lambda x: x[0])
            out: list[tuple[int, int]] = []
            place = 0
            for _, k, i in merged:
                out.append((k, i))
                if len(out) == MERGED:
                    yield gathered(held, out, me, place)
                    out, place = [], place + MERGED
            if out:
                yield gathered(held, out, me, place)

    return dealt.mapInArrow(run, f"{FIELDS}, part int, place long")


#: Captures that the merge returns at once.
MERGED = 8192


def captured(held: list[pa.RecordBatch], starts: np.ndarray, first: int, end: int) -> Iterator[tuple[tuple, int, int]]:
    """The order, batch and row of the captures of a run's piece."""
    k = int(np.searchsorted(starts, first, side="right")) - 1
    while first < end:
        i, j = first - int(starts[k]), min(end, int(starts[k + 1])) - int(starts[k])
        for low in range(i, j, 64):
            part = held[k].slice(low, min(64, j - low)).select(["urlkey", "timestamp", "page_id", "run", "offset"])
            for n, x in enumerate(part.to_pylist(), low):
                yield order(x), k, n
        first, k = int(starts[k + 1]), k + 1


def gathered(held: list[pa.RecordBatch], rows: list[tuple[int, int]], part: int, place: int) -> pa.RecordBatch:
    """The named rows of the batches, in the order given."""
    of, at = np.array(rows, np.int64).T
    own = np.unique(of)
    some = pa.Table.from_batches([held[k].take(pa.array(at[of == k])) for k in own.tolist()]).combine_chunks()
    back = np.empty(len(rows), np.int64)
    back[np.argsort(of, kind="stable")] = np.arange(len(rows))
    t = some.take(pa.array(back)).combine_chunks()
    columns = [c.chunk(0) for c in t.columns]
    names = [*t.column_names, "part", "place"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), part, np.int32)), pa.array(np.arange(place, place + len(rows)))], names=names)


def archive(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, date: str | None = None) -> DataFrame:
    """Write the pages, read the archives back and return the merged capture index."""
    spark = pages.sparkSession
    folder = path or C.scratch_path(spark, "warc")
    write(records(pages, key, url, html, least, date), folder)
    return merge(read(spark, folder))
