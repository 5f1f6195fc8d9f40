import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from siftstone.llm import warc

SCHEMA = "page_id long, url string, html string, rid long, shard int, z binary"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, 2, bytearray(b"x")) for i, u, h in rows], SCHEMA)


def plain(rows, least=0):
    """What is to be read back, by definition; of several rows of the largest id of a payload one is the response."""
    best = {}
    for i, _, h in rows:
        best.setdefault(h or "", []).append(-1 if i is None else i)
    out, told = [], set()
    for i, _, h in rows:
        data, keeper = (h or "").encode(), max(best[h or ""])
        mine = (-1 if i is None else i) == keeper and (h or "") not in told
        if mine:
            told.add(h or "")
        first = mine or len(data) < least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first or keeper < 0 else keeper))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ODD = [(3, "http://a/é x\r\n", "same"), (9, None, "same"), (9, "u", "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (None, "v", "alone"), (7, "u", "long " * 200_000), (8, "u", "\r\n\r\nWARC/1.1\r\n\x00 é"), (1, "u", "tiny"), (2, "u", "tiny")]


@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows(spark, least):
    assert rows_of(warc.round_trip(frame(spark, ODD).repartition(3), least)) == plain(ODD, least)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert rows_of(warc.round_trip(pages)) == plain([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_empty(spark):
    assert warc.round_trip(frame(spark, [])).isEmpty()


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 40_000)


def test_files_roll_and_are_the_same_again(spark, sf, tmp_path, small_shards):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    a = warc.write(pages, (tmp_path / "a").as_uri(), roll=3000).orderBy("path").collect()
    b = warc.write(pages.repartition(3), (tmp_path / "b").as_uri(), roll=3000).orderBy("path").collect()
    assert len({r.shard for r in a}) > 1 and max(r.sequence for r in a) > 0 and sum(r.records for r in a) == pages.count()
    assert all(r.bytes < 3000 + 20_000 for r in a)
    assert [r.path for r in a] == [r.path for r in b]
    assert not (tmp_path / "a" / "_temporary").exists()
    for r in a:
        data = (tmp_path / "a" / r.path).read_bytes()
        assert (hashlib.sha256(data).hexdigest(), len(data)) == (r.sha256, r.bytes)
    ids = [r.page_id for r in warc.read(spark, (tmp_path / "a").as_uri()).collect()]
    assert sorted(ids) == sorted(r.page_id for r in pages.collect())


def test_the_same_rows_give_the_same_bytes(spark, tmp_path):
    """However they are dealt out, rows that are equal in everything among them."""
    rows = frame(spark, [*ODD, *ODD, *ODD[:3]])
    for name, n in (("a", 1), ("b", 4)):
        rows.repartition(n).write.parquet(str(tmp_path / f"p{name}"))
        warc.write(spark.read.parquet(str(tmp_path / f"p{name}")), (tmp_path / name).as_uri())
    files = sorted(p.name for p in (tmp_path / "a").glob("*.gz"))
    assert files and all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files)


@pytest.mark.parametrize("least", [0, 5])
def test_hot_ids_and_equal_rows_are_split(spark, monkeypatch, tmp_path, least):
    monkeypatch.setattr(warc, "SHARD_BYTES", 5000)
    monkeypatch.setattr(warc, "COPIES", 7)
    monkeypatch.setattr(warc, "SENT", 2)
    rows = [(7, "u", "same")] * 60 + [(None, f"u{i}", f"page {i}") for i in range(40)] + [(i, "v", "same") for i in range(5)] + ODD
    folder = (tmp_path / "w").as_uri()
    files = warc.write(frame(spark, rows).repartition(3), folder, least).collect()
    assert len({f.shard for f in files}) > 8 and rows_of(warc.read(spark, folder)) == plain(rows, least)


def test_the_format(spark, tmp_path):
    warc.write(frame(spark, ODD[:3]), (tmp_path / "w").as_uri())
    (file,) = (tmp_path / "w").glob("*.gz")
    text = gzip.decompress(file.read_bytes()).decode()
    records = text.split("WARC/1.1\r\n")[1:]
    assert len(records) == 4 and "WARC-Type: warcinfo" in records[0] and all("WARC-Date: " in r and "Content-Length: " in r and r.endswith("\r\n\r\n") for r in records)
    assert "WARC-Target-URI: http://a/%C3%A9%20x%0D%0A\r\n" in text and text.count("WARC-Refers-To: ") == 2 and warc.IDENTICAL in text


def test_damage_is_noticed(spark, tmp_path):
    folder = (tmp_path / "w").as_uri()
    warc.write(frame(spark, ODD[:2]), folder)
    (file,) = (tmp_path / "w").glob("*.gz")
    data = file.read_bytes()
    (tmp_path / "w" / "shard-99999-00000.warc.gz").write_bytes(b"stray")  # not in the manifest
    assert warc.read(spark, folder).count() == 2
    members = list(warc.Members(Path(file).open("rb")))
    file.write_bytes(b"".join(gzip.compress(m.replace(b"same", b"fame")) for m in members))
    with pytest.raises(Exception, match="doesn't fit"):
        warc.read(spark, folder).collect()
    revisit = next(m for m in members if b"WARC-Type: revisit" in m)
    file.write_bytes(b"".join(gzip.compress(m.replace(b"sha1:", b"sha1:A", 1) if m is revisit else m) for m in members))
    with pytest.raises(Exception, match="doesn't fit its response"):
        warc.read(spark, folder).collect()
    file.write_bytes(data[:-30])
    with pytest.raises(Exception, match="ends within"):
        warc.read(spark, folder).collect()


def test_an_ordinary_shard_rolls(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, "u", r.randbytes(500_000).hex()) for i in range(12)]
    files = warc.write(frame(spark, rows), (tmp_path / "w").as_uri()).orderBy("path").collect()
    assert len({f.shard for f in files}) == 1 and [f.sequence for f in files] == list(range(len(files))) and len(files) > 1
    assert rows_of(warc.read(spark, (tmp_path / "w").as_uri())) == plain(rows)
