"""WARC archives of captured pages, and a two-level index over them.

Archives are WARC 1.1 files of one gzip member for each record, written through Spark's
own writer, so that any store that Spark reaches will do; a file ends with an empty
member. Records whose payload another record has (the one with the largest page_id)
are revisits that refer to it and carry no payload.

The index is made by reading the archives back, member by member. Its lines are keyed
by the URL with the host reversed and the page_id, sorted over all files, and packed into
compressed blocks; a sparse directory holds the first and last key of each block. A lookup
searches the directory by bisection, reads only the blocks in the range that it finds,
searches inside them by bisection again, and then reads the record's bytes at its offset.
Where the directory itself is long, every so many entries of it are held and the stretch
between two is read. Many keys are looked up at a time (``fetch``): they are dealt to
their blocks, searched there, and the places found are read in the order of files and
offsets, all of it on the executors. Bytes are read through ``pyarrow.fs``, or, where it
doesn't know the store, cut out of files that Spark reads.

Defined cases: null html is an empty payload; a null url has the empty key; rows with
the largest page_id of equal payloads are responses, all of them if they are repeated;
rows without page_id refer to the largest, or are responses where there is none; an empty
table gives empty archives and an empty index; equal rows are a record each; payloads of
any length are stored whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_path, small_batches, small_side, table

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 0
#: Bytes of an archive file after which the next one begins; lines of an index block.
FILE_BYTES = 24 << 20
BLOCK_LINES = 3000
#: Entries of the directory that a reader holds, besides the first of each partition of the index.
HELD = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A gzip member without content, which ends each file.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000" + "0000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "1970-01-01T00:00:00Z"
ENTRY = "surt string, page_id long, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hexadecimal digits for four letters."""
    digits = F.sha1(payload)
    letters = []
    for group in range(8):
        number = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def surt(url: str | None) -> str:
    """The URL with its host's labels reversed, without scheme, user and fragment."""
    if not url:
        return ""
    rest = url.split("#", 1)[0].split("://", 1)[-1]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + (path if path[0] == "/" else "/" + path)


def _head(lines: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed; a revisit if it refers to another page."""
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if refers_to is not None else http + payload
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", CAPTURED),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return b"WARC/1.1\r\n" + _head(lines) + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that has content."""
    view, at = memoryview(content), 0
    while at < len(view):
        d, fed, parts = zlib.decompressobj(31), at, []
        while not d.eof:
            if fed >= len(view):
                raise ValueError(f"an archive breaks off in the member at {at}")
            parts.append(d.decompress(view[fed : fed + 32768]))
            fed += 32768
        end = min(fed, len(view)) - len(d.unused_data)
        raw = b"".join(parts)
        if raw:
            yield at, end - at, raw
        at = end


def parse(raw: bytes) -> dict:
    """The fields of a record and its payload; a response's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record breaks off")
    out = {"type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI", ""), "payload": b"", "bytes": 0, "digest": "", "page_id": None, "refers_to": None}
    if out["type"] == "warcinfo":
        return out
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda uri: int(uri[len("<urn:page:") : -1]) if len(uri) > len("<urn:page:>") else None
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    out |= {"payload": payload, "bytes": size, "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "page_id": number(fields["WARC-Record-ID"])}
    if out["type"] == "revisit":
        out["refers_to"] = number(fields["WARC-Refers-To"])
    elif len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["digest"]:
        raise ValueError(f"the payload of page {out['page_id']} isn't what its digest says")
    return out


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Archives of page_id, url and html under ``path``."""
    rows = pages.select("page_id", "url", F.coalesce(pages["html"].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload"))
    leads = rows.groupBy("digest", "size").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n")).where((F.col("size") >= revisit_bytes) & (F.col("n") > 1))
    leads = cut(leads.select("digest", "size", "lead"), "leads")
    met = rows.join(small_side(leads, leads.count()), ["digest", "size"], "left")
    refers = F.when(~F.col("lead").eqNullSafe(F.col("page_id")), F.col("lead"))
    info = member(b"WARC/1.1\r\n" + _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:tidemark:warcinfo>"), ("WARC-Date", CAPTURED), ("Content-Type", "application/warc-fields"), ("Content-Length", "18")]) + b"\r\nformat: WARC 1.1\r\n\r\n\r\n")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [info], len(info)
        for batch in batches:
            for values in zip(*[batch.column(i) for i in range(5)], strict=True):
                m = member(record(*[v.as_py() for v in values]))
                held.append(m)
                size += len(m)
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [info], len(info)
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    files = small_batches(met.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))).mapInArrow(pack, "value binary")
    # each row is a file; the writer ends every row with its separator, here an empty member
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A line (``ENTRY``) for each response and revisit in the archives under ``path``; ``file`` is relative to it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                file, lines = name.as_py().rsplit("/", 1)[-1], []
                for offset, length, raw in members(content.as_py()):
                    r = parse(raw)
                    if r["type"] != "warcinfo":
                        lines.append((surt(r["url"]), r["page_id"], file, offset, length, r["bytes"], r["digest"], r["type"], r["refers_to"]))
                yield from _rows(lines)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, ENTRY)


_ARROW = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _rows(lines: list[tuple]) -> Iterator[pa.RecordBatch]:
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


_BLOCK = "block long, first string, first_page long, last string, last_page long, n long, lines binary"


def _key(surt_: str, page: int | None) -> tuple[str, bool, int]:
    """Orders as the index is: by URL, then by page_id, null first."""
    return surt_, page is not None, page or 0


def build_index(entries: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Sorted, compressed blocks of ``entries`` under ``path``: block (ascending in the order of keys), first and last key, n and lines."""
    n = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["surt", "page_id", "file", "offset"]
    ranged = entries.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        number = 0

        def block() -> pa.RecordBatch:
            part = held[0][-1]
            lines = zlib.compress("\n".join(json.dumps(x[:-1]) for x in held).encode())
            ends = [pa.array([held[k][c]], t) for k in (0, -1) for c, t in ((0, pa.string()), (1, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), *ends, pa.array([len(held)], pa.int64()), pa.array([lines], pa.binary())], names=["block", "first", "first_page", "last", "last_page", "n", "lines"])

        for batch in batches:
            for line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(list(line))
                if len(held) == block_lines:
                    yield block()
                    held.clear()
                    number += 1
        if held:
            yield block()

    ranged.mapInArrow(pack, _BLOCK).write.parquet(path)


def _unpacked(lines: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(lines).split(b"\n")]


def _found(lines: list[list], keys: list[tuple]) -> list[tuple]:
    """The lines of a block that have one of the keys, by bisection."""
    out: list[tuple] = []
    for key in keys:
        at = bisect.bisect_left(lines, key, key=lambda x: _key(x[0], x[1]))
        while at < len(lines) and _key(lines[at][0], lines[at][1]) == key:
            out.append(tuple(lines[at]))
            at += 1
    return out


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


#: A key and the number of a block, or of a held entry, that it may lie in.
_AT = (["at", "surt", "page_id"], [pa.int64(), pa.string(), pa.int64()])


class CaptureIndex:
    """Reads an index that ``build_index`` has written, and the archives that it points into."""

    def __init__(self, spark: SparkSession, path: str, archives: str, held: int = HELD) -> None:
        self.spark, self.archives = spark, archives
        self.blocks = spark.read.schema(_BLOCK).parquet(path)
        self.directory = self.blocks.select("block", "first", "first_page", "last", "last_page")
        total = self.directory.count()
        #: Of each partition of the index every ``stride``-th entry of the directory is held, from its first on.
        self.stride = -(-total // held) or 1
        kept = self.directory.where(F.pmod(F.col("block").bitwiseAND((1 << 32) - 1), F.lit(self.stride)) == 0)
        #: Key and number of each held block, ascending in both.
        self.held = sorted((_key(r["first"], r["first_page"]), r["block"]) for r in kept.select("first", "first_page", "block").collect())

    def _range(self, low: str, high: str | None) -> tuple[int, int]:
        """Numbers of the first and last block that may hold keys from ``low`` up to and without ``high`` (None: to ``low`` itself)."""
        firsts = [f[0] for f, _ in self.held]
        a = bisect.bisect_left(firsts, low) - 1
        b = bisect.bisect_right(firsts, low) if high is None else bisect.bisect_left(firsts, high)
        least = self.held[a][1] if a >= 0 else 0
        most = self.held[b][1] if b < len(self.held) else 1 << 62
        return least, most

    def lookup(self, low: str, high: str | None = None) -> DataFrame:
        """Entries of the URL key ``low``, or of those from ``low`` up to and without ``high`` (as for all of a host)."""
        least, most = self._range(low, high)
        last = F.col("first") <= low if high is None else F.col("first") < high
        near = self.blocks.where(F.col("block").between(least, most) & last & (F.col("last") >= low))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0):
                    lines = _unpacked(blob.as_py())
                    a = bisect.bisect_left(lines, low, key=lambda x: x[0])
                    b = bisect.bisect_right(lines, low, key=lambda x: x[0]) if high is None else bisect.bisect_left(lines, high, key=lambda x: x[0])
                    yield from _rows([tuple(x) for x in lines[a:b]])

        return near.select("lines").mapInArrow(search, ENTRY)

    def entries(self) -> DataFrame:
        """All lines of the index."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0):
                    yield from _rows([tuple(x) for x in _unpacked(blob.as_py())])

        return self.blocks.select("lines").mapInArrow(unpack, ENTRY)

    def _dealt(self, keys: DataFrame) -> DataFrame:
        """``at`` (a block that the key may lie in), surt and page_id of each key."""
        shared = self.spark.sparkContext.broadcast(self.held)  # bounded, see HELD
        as_long = "at long, surt string, page_id long"

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, numbers = [f for f, _ in shared.value], [b for _, b in shared.value]
            for batch in batches:
                rows = []
                for s, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    key = _key(s, page)
                    for k in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                        rows.append((numbers[k], s, page))
                yield from _table(rows, *_AT).to_batches()

        dealt = keys.select("surt", "page_id").mapInArrow(held, as_long)
        if self.stride == 1:
            return dealt

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = [b for _, b in shared.value]
            for batch in batches:
                own = [numbers[bisect.bisect_right(numbers, b) - 1] for b in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns], names=["held", *batch.schema.names])

        def narrow(asked: pa.Table, part: pa.Table) -> pa.Table:
            blocks = sorted((_key(r["first"], r["first_page"]), _key(r["last"], r["last_page"]), r["block"]) for r in part.to_pylist())
            firsts, rows = [b[0] for b in blocks], []
            for r in asked.to_pylist():
                key = _key(r["surt"], r["page_id"])
                k = bisect.bisect_right(firsts, key) - 1
                while k >= 0 and blocks[k][1] >= key:
                    rows.append((blocks[k][2], r["surt"], r["page_id"]))
                    k -= 1
            return _table(rows, *_AT)

        # the stretches between held entries, of ``stride`` entries each
        stretches = self.directory.mapInArrow(mark, "held long, block long, first string, first_page long, last string, last_page long")
        return dealt.groupBy("at").cogroup(stretches.groupBy("held")).applyInArrow(narrow, as_long)

    def find(self, keys: DataFrame) -> DataFrame:
        """Entries of the distinct keys (columns surt and page_id)."""

        def search(asked: pa.Table, block: pa.Table) -> pa.Table:
            found: list[tuple] = []
            if asked.num_rows:  # as many as the block has lines, at most
                wanted = sorted(_key(r["surt"], r["page_id"]) for r in asked.to_pylist())
                for blob in block.column("lines"):
                    found += _found(_unpacked(blob.as_py()), wanted)
            return _table(found, _ARROW.names, _ARROW.types)

        dealt = self._dealt(keys.select("surt", "page_id").distinct())
        return dealt.groupBy("at").cogroup(self.blocks.select("block", "lines").groupBy("block")).applyInArrow(search, ENTRY)

    def fetch(self, keys: DataFrame) -> DataFrame:
        """For each entry of the keys its record as it is read at its place: page_id, payload_bytes, payload_digest, record_type, refers_to and payload."""
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

        def checked(raw: bytes, line: dict) -> tuple:
            r = parse(next(members(raw))[2])
            own = (r["page_id"], r["bytes"], r["digest"], r["type"], r["refers_to"])
            if own != tuple(line[n] for n in names[:5]):
                raise ValueError(f"the record at {line['offset']} of {line['file']} isn't what the index says")
            return (*own, r["payload"])

        def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            yield from _table(rows, names, types).to_batches()

        archives, found = self.archives, self.find(keys)
        if _opened(archives) is None:

            def cut_out(lines: pa.Table, whole: pa.Table) -> pa.Table:
                rows = []
                for content in whole.column("content"):
                    raw = memoryview(content.as_buffer())
                    rows += [checked(bytes(raw[x["offset"] : x["offset"] + x["length"]]), x) for x in lines.to_pylist()]
                return _table(rows, names, types)

            files = self.spark.read.format("binaryFile").load(archives).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
            return found.groupBy("file").cogroup(files.groupBy("name")).applyInArrow(cut_out, schema)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = _opened(archives)
            name, stream = None, None
            for batch in batches:
                rows, held = [], 0
                for line in batch.to_pylist():
                    if line["file"] != name:
                        name, stream = line["file"], store.open_input_file(f"{base}/{line['file']}")
                    rows.append(checked(stream.read_at(line["length"], line["offset"]), line))
                    held += len(rows[-1][-1])
                    if held >= FETCH_BYTES:
                        yield from batches_of(rows)
                        rows, held = [], 0
                yield from batches_of(rows)

        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = found.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
        return small_batches(ordered).mapInArrow(read, schema)


#: Payload bytes that are handed on at a time.
FETCH_BYTES = 4 << 20


def _opened(path: str):
    """The store of ``path`` and the path in it as ``pyarrow.fs`` has them, or None where it doesn't know such stores."""
    from pyarrow import fs

    try:
        store, base = fs.FileSystem.from_uri(path)
        there = store.get_file_info(base).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return None
    return (store, base) if there else None


def archive(pages: DataFrame, path: str) -> CaptureIndex:
    """Archives and index of ``pages`` under ``path``."""
    spark = pages.sparkSession
    write_archives(pages, f"{path}/archives")
    build_index(read_archives(spark, f"{path}/archives"), f"{path}/index")
    return CaptureIndex(spark, f"{path}/index", f"{path}/archives")


def keys_of(pages: DataFrame) -> DataFrame:
    """surt and page_id of each of ``pages``, as its record has them in the index."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [surt(" ".join((u or "").split())) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0)], names=["surt", "page_id"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(made, "surt string, page_id long")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = archive(pages, scratch_path(spark, "warc"))
    return index.fetch(keys_of(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, html,
         array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}',
           CAST(((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
         max(page_id) OVER (PARTITION BY html) AS lead
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN lead IS NULL OR page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN lead IS NULL OR page_id = lead THEN NULL ELSE lead END AS refers_to
FROM d
"""
