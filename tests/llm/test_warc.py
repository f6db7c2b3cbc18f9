import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from skein.llm import warc


def brute(rows):
    first = {}
    for k, h in sorted(rows, key=lambda x: x[0]):
        first.setdefault((h or "").encode(), k)
    out = []
    for k, h in rows:
        p = (h or "").encode()
        mine = first[p] == k
        out.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if mine else "revisit", None if mine else first[p]))
    return sorted(out)


ROWS = [(3, "<p>é</p>"), (1, "<p>é</p>"), (9, None), (4, ""), (7, "x" * 300_000), (8, "x" * 300_000), (10, "a\r\n\r\nWARC/1.1\r\n")]


def pages(spark, rows):
    return spark.createDataFrame([(k, f"http://a/{k}\r\nX: y" if k == 3 else None if k == 4 else f"http://a/{k}", h, "z") for k, h in rows], "page_id long, url string, html string, record_type string")


def test_archive_and_back(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.archive(pages(spark, ROWS), path)
    assert sorted(tuple(r) for r in warc.records(spark, path).collect()) == brute(ROWS)
    rows = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    assert rows["<urn:page:3>"]["target_uri"] == "http://a/3%0D%0AX: y" and rows["<urn:page:4>"]["target_uri"] is None
    assert bytes(rows["<urn:page:10>"]["payload"]) == ROWS[-1][1].encode() and bytes(rows["<urn:page:8>"]["payload"]) == b""
    # the files are gzip members that other tools read
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("a/*.warc.gz"))
    assert whole.count(b"WARC-Type: revisit") == 3


def test_thresholds_and_empty_tables(spark, tmp_path):
    warc.archive(pages(spark, ROWS), f"{tmp_path}/b", least_bytes=100)
    got = {r["page_id"]: r["record_type"] for r in warc.records(spark, f"{tmp_path}/b").collect()}
    assert [k for k, v in got.items() if v == "revisit"] == [8]
    warc.archive(pages(spark, ROWS).limit(0), f"{tmp_path}/c")
    assert warc.records(spark, f"{tmp_path}/c").count() == 0
    twice = [(5, "same"), (5, "same"), (6, "same")]
    warc.archive(pages(spark, twice), f"{tmp_path}/d")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.records(spark, f"{tmp_path}/d").collect()) == [(5, "response", None), (5, "response", None), (6, "revisit", 5)]
    none = spark.createDataFrame([(None, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    warc.archive(none, f"{tmp_path}/e")
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.records(spark, f"{tmp_path}/e").collect()) == [("2", "response", None), ("None", "revisit", 2)]


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_files(spark, tmp_path, packed):
    one = warc.record({"record_type": "warcinfo", "record_id": "<urn:i>"}, b"software: x\r\n", True)
    two = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:r>\r\nWARC-Target-URI: http://long\r\n  er\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = one + two + one
    file = tmp_path / ("x.warc.gz" if packed else "x.warc")
    file.write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:]) if packed else data)
    rows = warc.read(spark, str(file)).collect()
    assert [r["record_type"] for r in rows] == ["warcinfo", "response", "warcinfo"] and rows[1]["target_uri"] == "http://long er" and bytes(rows[1]["payload"]) == b"hello"
    wanted = warc.read(spark, str(file)).filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http") & (F.col("content_length") > 3))
    assert wanted.count() == 1 and warc.read(spark, str(file)).filter("record_type in ('warcinfo')").count() == 2


def test_predicates_reach_the_source(spark, tmp_path):
    path = f"{tmp_path}/f"
    warc.archive(pages(spark, ROWS), path)
    # a broken payload only matters where it is wanted
    file = next(p for p in sorted(tmp_path.glob("f/*.warc.gz")) if b"" != p.read_bytes())
    plain = gzip.decompress(file.read_bytes()).replace(b"xxxx\r\n\r\n", b"xxxy\r\n\r\n")
    for p in tmp_path.glob("f/*"):
        p.unlink()
    (tmp_path / "f" / "g.warc").write_bytes(plain)
    reader = warc.Reader(path, warc.read(spark, path).schema)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == [] and len(reader.predicates) == 1
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == plain.count(b"WARC-Type: revisit")
    if b"xxxy" in plain:
        with pytest.raises(ValueError, match="digest"):
            list(warc.Reader(path, warc.read(spark, path).schema).read(reader.partitions()[0]))


def test_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        warc.Reader(str(tmp_path), spark.range(1).schema)
    with pytest.raises(FileNotFoundError):
        warc.Reader(str(tmp_path / "no"), warc.read(spark, str(tmp_path)).schema).partitions()
    (tmp_path / "cut.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc")
    reader = warc.Reader(str(tmp_path), warc.read(spark, str(tmp_path)).schema)
    with pytest.raises(warc.Malformed):
        list(reader.read(reader.partitions()[0]))


def test_append_and_overwrite(spark, tmp_path):
    path = f"{tmp_path}/g"
    for some, mode in ((ROWS[:2], "append"), (ROWS[2:4], "append")):
        warc.archive(pages(spark, some), path, mode=mode)
    assert sorted(r["page_id"] for r in warc.records(spark, path).collect()) == [1, 3, 4, 9]
    warc.archive(pages(spark, ROWS[4:]), path, mode="overwrite")
    assert sorted(r["page_id"] for r in warc.records(spark, path).collect()) == [7, 8, 10]
    left = sorted(p.name for p in tmp_path.glob("g/*.warc.gz"))
    assert left == sorted(n for names in warc.manifests(*warc.located(path)).values() for n in names)


def test_common_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT_PAYLOADS", 2)
    rows = [(k, ("a", "b", "c", "d", None)[k % 5] if k % 7 else f"own {k}") for k in range(300)]
    warc.archive(pages(spark, rows), f"{tmp_path}/h")
    assert sorted(tuple(r) for r in warc.records(spark, f"{tmp_path}/h").collect()) == brute(rows)


@pytest.mark.parametrize("form", ["plain", "stream", "sized"])
def test_malformed_records_are_skipped(spark, tmp_path, form):
    good = [warc.record({"record_type": "response", "record_id": f"<urn:{k}>"}, b"payload %d" % k, True) for k in range(4)]
    bad = [good[0].replace(b"Content-Length: 9", b"Content-Length: nine"), b"GARBAGE without a colon\r\n\r\nmore\r\n\r\n", good[1].replace(b"payload 1", b"payload x"), good[2].replace(b"Content-Length: 9\r\n", b"")]
    parts = [good[0], bad[0], good[1], bad[1], bad[2], good[2], bad[3], good[3]]
    file = tmp_path / ("x.warc" if form == "plain" else "x.warc.gz")
    file.write_bytes(b"".join(parts) if form == "plain" else gzip.compress(b"".join(parts)) if form == "stream" else b"".join(warc.member(p, 1) for p in parts[:4]) + b"\x1f\x8b\x08\x04zz" + b"".join(warc.member(p, 1) for p in parts[4:]))
    got = [r["record_id"] for r in warc.read(spark, str(file), malformed="skip").collect()]
    assert got == [f"<urn:{k}>" for k in range(4)]
    reader = warc.Reader(str(file), warc.read(spark, str(file)).schema)
    with pytest.raises(warc.Malformed):
        list(reader.read(reader.partitions()[0]))
