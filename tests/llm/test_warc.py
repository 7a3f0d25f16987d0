"""Archives written and read back, against the rows and against SQL; predicates; damaged payloads."""

import base64
import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from aislefix.llm import files, warc


def rows():
    same = "<p>same é</p>"
    made = [(7, "http://a/7", same, 1), (3, "http://a/3", same, 1), (9, None, same, 1), (1, "http://b/ 1\r\nX: y", None, 1), (2, "http://b/2", "", 1), (4, "http://c", "\r\n\r\n" * 400, 1), (5, "u" * 9000, "x" * 100_000, 1), (3, "http://a/3", same, 1), (None, "n", same, 1)]
    return made


def wanted(data, least=0):
    payloads = [(k, (p or "").encode()) for k, _, p, _ in data]
    for k, p in payloads:
        same = [i for i, q in payloads if q == p and i is not None]
        first = min(same) if len([1 for _, q in payloads if q == p]) > 1 and len(p) >= least else None
        revisit = first is not None and first != k
        yield (k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "page_id bigint, url string, html string, digest int").repartition(3)


@pytest.mark.parametrize("least", [0, 1, 50])
def test_round_trip(spark, df, least):
    folder = warc.write_warc(df, least_bytes=least)
    found = warc.read_warc(spark, folder, verify=True)
    got = found.select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted(rows(), least), key=str)
    pages = {k: p or "" for k, _, p, _ in rows()}
    responses = found.where("record_type = 'response'").collect()
    assert all(r.payload == pages[r.page_id] for r in responses)
    assert all(r.payload is None for r in found.where("record_type = 'revisit'").collect())
    of = {r.page_id: r.target_uri for r in found.collect()}
    assert of[1] == "http://b/ 1 X: y" and of[9] is None and len(of[5]) == 9000


def test_predicates_are_decided_from_heads(spark, df):
    folder = warc.write_warc(df)
    found = warc.read_warc(spark, folder, pushdown=True).where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a"))
    assert [r.page_id for r in found.collect()] == [7]
    assert "Filter" not in found._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    one = warc.read_warc(spark, folder, pushdown=True).where(F.col("page_id").isin(4, 5) & F.col("payload").startswith("x"))
    assert [(r.page_id, len(r.payload)) for r in one.collect()] == [(5, 100_000)]
    named = warc.read_warc(spark, folder, fields={"record_type": ["revisit"], "refers_to": [3]})
    assert sorted(r.page_id or 0 for r in named.collect()) == [0, 7, 9] and [r.page_id for r in named.where("page_id = 7").collect()] == [7]
    assert [r.page_id for r in warc.read_warc(spark, folder, pushdown=True).where("page_id IS NULL").collect()] == [None]


def test_files_are_plain_warc(spark, df):
    folder = warc.write_warc(df.where("page_id = 2"))
    system, path = files.place(folder)
    names = [f.path for f in system.get_file_info(__import__("pyarrow").fs.FileSelector(path)) if f.path.endswith(".gz") and f.size]
    (text,) = (gzip.decompress(open(n, "rb").read()) for n in names)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def test_splits_and_damage(spark, df):
    folder = warc.write_warc(df)
    reader = warc.WarcReader(spark.read.format("warc").option("path", folder).load().schema, {"path": folder, "split_bytes": "1"})
    splits = reader.partitions()
    assert len(splits) == len(rows())
    assert sum(b.num_rows for s in splits for b in reader.read(s)) == len(rows())
    member = warc.record(1, "u", b"abc", warc.bare_digest(b"abd"), None, None, "d")
    reader.verify = True
    with pytest.raises(ValueError, match="digest"):
        reader._row(gzip.compress(member))


def test_empty(spark, df):
    assert warc.read_warc(spark, warc.write_warc(df.limit(0))).count() == 0


def made(kind, name, block, content_type, *more, end="\r\n"):
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 2020-01-02T03:04:05Z", *more]
    fields += [f"Content-Type: {content_type}"] * bool(content_type) + [f"Content-Length: {len(block)}"]
    return ("WARC/1.0" + end + "".join(x + end for x in fields) + end).encode() + block + b"\r\n\r\n"


HTTP = "application/http; msgtype=response"


def others():
    """Records as crawlers write them, and of each what is to be read: type, id, target, bytes, digest, payload."""
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    page, latin, picture, long = "<p>é</p>\r\n\r\nmore".encode(), "où".encode("latin-1"), bytes(range(256)) * 9, b"x" * 3_000_000
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=%s\r\nX: 1\r\n\r\n"
    u = "urn:uuid:0-"
    return [
        (made("warcinfo", u + "1", b"software: x\r\n", "application/warc-fields", "WARC-Filename: a"), ("warcinfo", u + "1", None, 13, None, "software: x\r\n")),
        (made("request", u + "2", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request", "WARC-Target-URI: <http://a/>"), ("request", u + "2", "http://a/", 0, None, "")),
        (made("response", u + "3", head % b"UTF-8" + page, HTTP, "warc-target-uri: http://a/", f"WARC-Payload-Digest: SHA1:{sha(page)}"), ("response", u + "3", "http://a/", len(page), sha(page), page.decode())),
        (made("response", u + "4", head % b'"iso-8859-1"' + latin, HTTP, "WARC-Target-URI: http://b/", "WARC-Payload-Digest: md5:00", end="\n"), ("response", u + "4", "http://b/", len(latin), "md5:00", "où")),
        (made("response", u + "5", head % b"no-such" + page, HTTP, "WARC-Target-URI: http://c/", " /and/on"), ("response", u + "5", "http://c/ /and/on", len(page), None, page.decode())),
        (made("response", u + "6", b"HTTP/1.1 200 OK", HTTP), ("response", u + "6", None, 15, None, "HTTP/1.1 200 OK")),
        (made("response", u + "7", b"", HTTP), ("response", u + "7", None, 0, None, "")),
        (made("resource", u + "8", picture, "image/png", f"WARC-Payload-Digest: sha1:{sha(picture)}"), ("resource", u + "8", None, len(picture), sha(picture), picture.decode("utf-8", "replace"))),
        (made("revisit", u + "9", head % b"utf-8", HTTP, f"WARC-Refers-To: <{u}3>", f"WARC-Payload-Digest: sha1:{sha(page)}"), ("revisit", u + "9", None, None, sha(page), None)),
        (made("conversion", u + "a", long, None, "WARC-Target-URI: http://d/"), ("conversion", u + "a", "http://d/", len(long), None, long.decode())),
        (made("response", "urn:x-page:12", b"HTTP/1.1 200 OK\nContent-Type: a\n\nlast", HTTP), ("response", "urn:x-page:12", None, 4, None, "last")),
    ]


SEEN = ["record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "payload"]


@pytest.fixture(scope="module")
def foreign(tmp_path_factory):
    folder, records = tmp_path_factory.mktemp("foreign"), [r for r, _ in others()]
    (folder / "sub").mkdir()
    (folder / "plain.warc").write_bytes(b"".join(records))
    (folder / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (folder / "sub" / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (folder / "empty.warc").write_bytes(b"")
    (folder / "empty.warc.gz").write_bytes(b"")
    (folder / "notes.txt").write_bytes(b"no archive")
    return str(folder)


def key(row):
    return tuple(map(str, row))


def test_archives_of_others(spark, foreign):
    want = sorted((w for _, w in others()), key=key)
    for place, times in [(foreign, 3), (f"{foreign}/plain.warc", 1), (f"file://{foreign}/sub", 1)]:
        found = warc.read_archives(spark, place, verify=True)
        assert sorted(map(tuple, found.select(SEEN).collect()), key=key) == sorted(want * times, key=key)
        assert {r.page_id for r in found.collect()} == {None, 12}
        heads = warc.read_archives(spark, place, payload=False).select(SEEN[:-1]).collect()
        assert sorted(map(tuple, heads), key=key) == sorted((w[:-1] for w in want * times), key=key)
    named = warc.read_archives(spark, foreign, fields={"record_type": ["revisit", "resource"]})
    assert sorted(r.record_id[-1] for r in named.collect()) == [*"888999"]
    pushed = warc.read_archives(spark, foreign, pushdown=True).where("target_uri LIKE 'http://b%' AND content_type IS NOT NULL")
    assert [(r.payload, r.record_date) for r in pushed.collect()] == [("où", "2020-01-02T03:04:05Z")] * 3


def test_own_archives_are_read_without_manifest_and_index_alike(spark, df):
    folder = warc.write_warc(df)
    own, other = warc.read_warc(spark, folder, verify=True), warc.read_archives(spark, folder, verify=True)
    assert sorted(map(key, own.collect())) == sorted(map(key, other.collect())) and own.count() == len(rows())


@pytest.mark.parametrize("cut", [lambda x: x[:-3_100_000 // 2], lambda x: x[:40], lambda x: b"junk\r\n" + x])
@pytest.mark.parametrize("payload", [True, False])
def test_damaged_archives_of_others_fail(tmp_path, cut, payload):
    data = cut(b"".join(r for r, _ in others()))
    for name, content in [("x.warc", data), ("x.warc.gz", gzip.compress(data))]:
        (tmp_path / name).write_bytes(content)
        reader = reader_of(str(tmp_path / name), payload=payload, foreign=True)
        with pytest.raises(ValueError, match="cut off|no record"):
            [list(reader.read(split)) for split in reader.partitions()]


def reader_of(path, **options):
    from pyspark.sql.types import StructType

    return warc.WarcReader(StructType(), {"path": path} | {k: str(v) for k, v in options.items()})


def test_of_large_records_only_heads_are_fetched(spark, tmp_path, monkeypatch):
    noise = random.Random(1).randbytes(1_000_000).hex()
    df = spark.createDataFrame([(i, f"http://a/{i}", f"{i}{noise}") for i in range(4)], "page_id bigint, url string, html string")
    folder = warc.write_warc(df.coalesce(1))
    fetched, opened = [], files.open_read

    class Counting:
        def __init__(self, file):
            self.file = file

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n):
            fetched.append(n)
            return self.file.read(n)

    monkeypatch.setattr(warc.files, "open_read", lambda name: Counting(opened(name)) if name.endswith(".gz") else opened(name))
    for options, most in [({"payload": "false"}, 10_000), ({"fields": '{"page_id": [2]}'}, 1_300_000), ({}, 10_000_000)]:
        fetched.clear()
        reader = reader_of(folder, **options)
        found = [row for split in reader.partitions() for batch in reader.read(split) for row in batch.to_pylist()]
        assert sum(fetched) < most and len(found) == (1 if "fields" in options else 4)
        assert all((row["payload"] is None) == ("payload" in options) for row in found)
        assert all(row["payload"] in (None, f"{row['page_id']}{noise}") for row in found)


def test_query_equals_its_sql(spark, sf_dir):
    import __spark_entry__

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    df = __spark_entry__.queries()["op3_warc"](spark, sf_dir)
    want = con.execute(__spark_entry__.oracle_sql()["op3_warc"]).fetchall()
    assert sorted(map(tuple, df.select(COLUMNS).collect())) == sorted(want)
