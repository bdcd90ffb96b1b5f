"""Archives and index: round trips, revisits, lookups and range reads."""

import base64
import collections
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.common import scratch_path

SCHEMA = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://www.a.example/x?q=1#top", "<p>é</p>"),
    (2, "https://user@B.a.example:8080", "same"),
    (3, "http://b.a.example/", "same"),
    (3, "http://b.a.example/", "same"),
    (4, "not a url", None),
    (5, None, ""),
    (None, "http://b.a.example/\r\nX: y", "same"),
    (None, "http://z.example/only", "lone"),
    (7, "http://b.a.example/long", "line\r\n\r\nWARC/1.1 " * 20_000),
]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = scratch_path(spark, "warc")
    warc.write_archives(df, f"{path}/archives", file_bytes=400)
    warc.build_index(warc.read_archives(spark, f"{path}/archives"), f"{path}/index", block_lines=2)
    return warc.CaptureIndex(spark, f"{path}/index", f"{path}/archives")


def brute(rows):
    lead = collections.defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None:
            lead[h or ""] = max(lead[h or ""] or i, i)
    for i, _, h in rows:
        raw, first = (h or "").encode(), lead[h or ""]
        refers = None if first is None or i == first else first
        yield i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers


def test_rows(index):
    got = index.entries().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(ROWS), key=repr)


def test_query_on_real_pages(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.query(spark, sf).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_oracle_says_the_same(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(warc.ORACLE)
    assert want.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(want.fetchall(), key=repr) == sorted(map(tuple, warc.query(spark, sf).collect()), key=repr)


def test_lookup_and_range_read(spark, index):
    keys = [warc.surt(" ".join((u or "").split())) for _, u, _ in ROWS]
    for key in set(keys):
        assert index.lookup(key).count() == keys.count(key), key
    assert index.lookup("com,missing)/").count() == 0
    host = index.lookup("example,a,", "example,a-")
    assert host.count() == sum(k.startswith("example,a,") for k in keys)
    # a sparse directory gives the same entries
    sparse = warc.CaptureIndex(spark, index_path(index), index.archives, held=2)
    assert sparse.stride > 1
    for key in set(keys):
        assert sparse.lookup(key).count() == keys.count(key), key


@pytest.mark.parametrize(("held", "known"), [(1000, True), (2, True), (1000, False)])
def test_fetch(spark, index, monkeypatch, held, known):
    if not known:
        monkeypatch.setattr(warc, "_opened", lambda path: None)
    own = warc.CaptureIndex(spark, index_path(index), index.archives, held=held)
    assert (own.stride == 1) == (held == 1000)
    pages = spark.createDataFrame([*ROWS, (99, "http://missing/", ""), (1, None, "")], SCHEMA)
    got = own.fetch(warc.keys_of(pages)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(brute(ROWS), key=repr)
    for r in got:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
        else:
            assert r.payload == b""


def test_index_and_record_must_agree(spark, index, monkeypatch):
    whole = index.find
    monkeypatch.setattr(index, "find", lambda keys: whole(keys).withColumn("payload_bytes", F.col("payload_bytes") + 1))
    with pytest.raises(Exception, match="isn't what the index says"):
        index.fetch(warc.keys_of(spark.createDataFrame(ROWS[:1], SCHEMA))).collect()


def test_odd_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x", 5, 6)], SCHEMA + ", `a.b` int, digest int")
    assert warc.archive(pages, scratch_path(spark, "warc")).entries().count() == 1


def index_path(index):
    return index.archives.rsplit("/", 1)[0] + "/index"


def test_files_are_gzip_and_in_order(spark, index):
    files = spark.read.format("binaryFile").load(index.archives).collect()
    assert len(files) > 3  # the small limit cuts archives
    for f in files:
        text = gzip.decompress(f.content)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    firsts = index.held
    assert firsts == sorted(firsts)


def test_broken_archives_are_noticed():
    raw = warc.record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None)
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n\r\n", b"Payload\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.members(warc.member(raw)[:-3]))


@pytest.mark.parametrize(("url", "key"), [("http://www.A.com/p", "com,a,www)/p"), ("https://a.b:80?x", "b,a:80)/?x"), (None, ""), ("a.com", "com,a)/")])
def test_surt(url, key):
    assert warc.surt(url) == key


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    index = warc.archive(df, scratch_path(spark, "warc"))
    assert index.entries().count() == 0 and index.fetch(warc.keys_of(df)).count() == 0
