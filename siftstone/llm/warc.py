"""Deterministic sharded WARC writing and reading.

Records are range-sorted by page id into shards whose bounds depend on the data alone; an id that outgrows a shard is split by what its records hold. A
task writes its shard's records, each a gzip member of its own, and rolls to the next file once the compressed size passes a limit. Headers, record
ids and digests are regenerated from the data (rows that are equal in everything are told apart by a running number), and neither clock nor
place of a row is read, so the same rows give the same bytes however they are dealt out. A file is written under a temporary name of its own
attempt and renamed when it is complete; the manifest, a table that the job commits at its end, names the files that count. Readers follow the
manifest, verify every digest, take lengths from the blocks that they read, and hold every revisit against the response that it names.

Of records with equal payloads only one is stored in full, that with the largest page id; the others revisit it. Rows that are equal in everything
are counted before they are dealt out: a payload travels once a task, and its further records in chunks of COPIES.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import join_counted, shared_path, ship, written

MANIFEST = "path string, shard int, sequence int, records long, bytes long, sha256 string"
RECORD = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_record string, url string"
#: Bytes of a shard, about, and of a record besides its payload; files roll within a shard. A task writes some shards if there are more than MOST_TASKS.
SHARD_BYTES, RECORD_BYTES, MOST_TASKS = 16 << 20, 600, 100_000
#: Compressed bytes after which a file is closed; an ordinary shard, several times this when compressed, rolls.
ROLL_BYTES = 2 << 20
#: Ids that the bounds of shards are taken from, about, or so many a shard.
SAMPLED_IDS, IDS_A_SHARD = 20_000, 8
#: Records of equal rows that are written together, at most, and rows that a task remembers to have sent.
COPIES, SENT = 10_000, 200_000
#: The date in all headers; a parameter, as reruns must give the same bytes.
DATE = "2000-01-01T00:00:00Z"
#: Fixed value of the standard: the profile of a revisit of an identical payload.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Page(NamedTuple):
    """A record to be written: of `number`, counted from 0, of the rows that are equal to it."""

    page_id: int | None
    url: str | None
    sha: str
    sha1: str
    size: int
    number: int
    payload: bytes | None  # None where it isn't needed
    keeper: tuple[int | None, str | None] | None  # page_id and url of the payload's response; None if no other row has the payload


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, sha: str, number: int) -> str:
    name = json.dumps([page_id, url, sha, number])
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def header_value(text: str) -> str:
    """A header value in one line: control characters and what isn't ASCII percent-encoded."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member; the same input gives the same bytes."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(p: Page, date: str, least: int) -> bytes:
    digest = base64.b32encode(bytes.fromhex(p.sha1)).decode()
    revisit = p.size >= least and p.keeper is not None and (p.keeper != (p.page_id, p.url) or p.number > 0)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % p.size
    if not revisit and p.payload is None:
        raise ValueError("a response came without its payload")
    block = http if revisit else http + p.payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(p.page_id, p.url, p.sha, p.number)), ("WARC-Date", date), ("WARC-Target-URI", header_value(p.url or ""))]
    if revisit:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(*p.keeper, p.sha, 0)), ("WARC-Truncated", "length")]
    headers += [("X-Page-Id", str(p.page_id))] * (p.page_id is not None)
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return member(headers, block)


def info_record(name: str, date: str) -> bytes:
    block = b"software: siftstone\r\nformat: WARC File Format 1.1\r\n"
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'file:' + name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/warc-fields")], block)


class ShardWriter:
    """Writes one shard's records to files that roll by compressed size; yields a manifest row for each."""

    def __init__(self, folder: str, shard: int, attempt: str, roll: int, date: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.roll, self.date = shard, attempt, roll, date
        self.sequence, self.out = 0, None

    def _open(self) -> None:
        self.name = f"shard-{self.shard:05d}-{self.sequence:05d}.warc.gz"
        self.temporary = f"{self.root}/_temporary/{self.name}.{self.attempt}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self._put(info_record(self.name, self.date))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.sha.update(data)

    def write(self, p: Page, least: int) -> Iterator[tuple]:
        if self.out is None:
            self._open()
        self._put(page_record(p, self.date, least))
        self.records += 1
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        row = (self.name, self.shard, self.sequence, self.records, self.size, self.sha.hexdigest())
        self.sequence, self.out = self.sequence + 1, None
        return row


class Shards(NamedTuple):
    """Ranges of page ids: where each but the first begins, its first shard and its number of shards."""

    begins: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @property
    def count(self) -> int:
        return int(self.first[-1] + self.parts[-1])

    def of(self, page_id: int | None, sha: str, url: str | None, chunk: int) -> int:
        k = int(np.searchsorted(self.begins, LEAST_ID if page_id is None else page_id, side="right"))
        parts = int(self.parts[k])
        return int(self.first[k]) + (zlib.crc32(f"{sha} {chunk} {url}".encode("utf-8", "surrogatepass")) % parts if parts > 1 else 0)


#: Stands for a null id, which is smaller than all others.
LEAST_ID = -(1 << 63)


def shards_of(groups: DataFrame) -> Shards:
    """The same for the same rows, however they are read; what reaches the driver is of the order of the number of shards.

    An id that holds more than a shard has a range of its own, with as many shards as it fills.
    """
    weight = ((F.col("size") + RECORD_BYTES) * F.col("n")).cast("long")
    ids = groups.groupBy(F.coalesce("page_id", F.lit(LEAST_ID)).alias("id")).agg(F.sum(weight).alias("bytes"))
    n, total = ids.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    hot = {r["id"]: -(-r["bytes"] // SHARD_BYTES) for r in ids.where(F.col("bytes") > SHARD_BYTES).collect()}
    shards = max(1, -(-total // SHARD_BYTES))
    begins = {i for h in hot for i in (h, h + 1)}
    if shards > 1:
        one_in = max(1, n // max(SAMPLED_IDS, IDS_A_SHARD * shards))
        some = np.sort(ids.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("id").toArrow()["id"].to_numpy())
        begins |= {int(some[len(some) * i // shards]) for i in range(1, shards)} if len(some) else set()
    begins = np.array(sorted(begins), np.int64)
    parts = np.array([1, *(hot.get(i, 1) for i in begins.tolist())], np.int64)
    return Shards(begins, np.cumsum(parts) - parts, parts)


PLACED = "shard int, page_id long, sha string, url string, step int, chunk int, z binary, sha1 string, size long, n long, kept boolean, keeper_id long, keeper_url string"


def write(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write a record for each row of pages; returns the manifest, a committed table in the folder.

    pages has page_id, url, html; other columns are ignored. A null html is an empty payload, a null url an empty target. Of rows
    with equal payloads of at least `least` bytes, that with the largest page_id is the response (of several with it, that with the
    largest url; of equal rows one); null ids and urls are smaller than all others. Repeated rows are revisits. An empty table gives an
    empty manifest. Payloads are shuffled once, compressed; of the search for equal ones only digests are.
    """
    spark = pages.sparkSession
    ship(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    small = F.when(F.octet_length("payload") < least, F.col("payload")) if least else F.lit(None).cast("binary")
    brief = pages.select("page_id", "url", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha"), F.sha1("payload").alias("sha1"), small.alias("small"))
    groups = written(brief.groupBy("page_id", "url", "sha", "sha1", "size", "small").agg(F.count("*").alias("n")), "warc-groups")
    shards = shards_of(groups)
    keepers = groups.groupBy("sha").agg(F.count("*").alias("members"), F.sum("n").alias("copies"), F.max(F.struct("page_id", "url")).alias("k")).where("copies > 1").drop("copies")
    decided = join_counted(groups, keepers, "sha", "members", groups.count(), "left")
    chunks = decided.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    none = lambda kind: F.lit(None).cast(kind)
    notes = chunks.select(F.lit(0).alias("shard"), "page_id", "sha", "url", F.lit(1).alias("step"), (F.col("chunk") / COPIES).cast("int").alias("chunk"), F.col("small").alias("z"), "sha1", "size", F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("chunk")).alias("n"), F.col("k").isNotNull().alias("kept"), F.col("k.page_id").alias("keeper_id"), F.col("k.url").alias("keeper_url"))
    payloads = pages.select(F.lit(0).alias("shard"), "page_id", F.sha2("payload", 256).alias("sha"), "url", F.lit(0).alias("step"), F.lit(0).alias("chunk"), F.col("payload").alias("z"), none("string").alias("sha1"), none("long").alias("size"), none("long").alias("n"), none("boolean").alias("kept"), none("long").alias("keeper_id"), none("string").alias("keeper_url"))
    names = [c.split(" ")[0] for c in PLACED.split(", ")]
    tasks = min(shards.count, MOST_TASKS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gives each row its shard, compresses payloads, and lets one that this task has sent already pass by."""
        sent: set[tuple] = set()
        for batch in batches:
            cols = {c: batch.column(c) for c in names}
            keys = [cols[c].to_pylist() for c in ("page_id", "sha", "url", "chunk", "step")]
            keep, shard, z = [], [], []
            for i, (page_id, sha, url, chunk, step) in enumerate(zip(*keys, strict=True)):
                if step == 0:
                    if (page_id, sha, url) in sent:
                        continue
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add((page_id, sha, url))
                keep.append(i)
                shard.append(shards.of(page_id, sha, url, chunk))
                data = cols["z"][i].as_py()
                z.append(None if data is None else zlib.compress(data, 3))
            rest = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(pa.array(z, pa.binary()) if c == "z" else rest.column(c) for c in names[1:])], names=names)

    placed = notes.mapInArrow(place, PLACED).unionByName(payloads.mapInArrow(place, PLACED))
    dealt = placed.repartitionById(tasks, (F.col("shard").cast("long") * tasks / F.lit(shards.count)).cast("int")).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "sha", F.asc_nulls_first("url"), "step", "chunk")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = TaskContext.get()
        attempt, writer, held = f"{t.stageId()}-{t.taskAttemptId()}", None, (None, None)  # a row's identity and its payload
        out: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in names}
                key = (r["page_id"], r["sha"], r["url"])
                if r["step"] == 0:
                    held = (key, r["z"])
                    continue
                if writer is None or writer.shard != r["shard"]:
                    if writer is not None and writer.out is not None:
                        out.append(writer.close())
                    writer = ShardWriter(folder, r["shard"], attempt, roll, date)
                z = r["z"] if r["z"] is not None else held[1] if held[0] == key else None
                page = Page(r["page_id"], r["url"], r["sha"], r["sha1"], r["size"], 0, None if z is None else zlib.decompress(z), (r["keeper_id"], r["keeper_url"]) if r["kept"] else None)
                for number in range(r["chunk"] * COPIES, r["chunk"] * COPIES + r["n"]):
                    out += writer.write(page._replace(number=number), least)
        if writer is not None and writer.out is not None:
            out.append(writer.close())
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in MANIFEST.split(", ")])

    manifest = f"{folder}/_manifest"
    dealt.mapInArrow(store, MANIFEST).write.parquet(manifest)
    jvm = spark.sparkContext._jvm
    left = jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)  # files of attempts that didn't end
    return spark.read.schema(MANIFEST).parquet(manifest)


class Members:
    """The gzip members of a stream, one at a time."""

    def __init__(self, stream: io.RawIOBase, chunk: int = 1 << 20):
        self.stream, self.chunk, self.rest = stream, chunk, b""

    def more(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(self.chunk)
        return bool(self.rest)

    def __iter__(self) -> Iterator[bytes]:
        while self.more():
            inflate, parts = zlib.decompressobj(31), []
            while not inflate.eof:
                if not self.more():
                    raise ValueError("an archive ends within a record")
                parts.append(inflate.decompress(self.rest))
                self.rest = inflate.unused_data
            yield b"".join(parts)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises ValueError if a digest or a length is wrong."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("a block doesn't fit its header")
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{base32_sha1(block.partition(b'\r\n\r\n')[2])}":
        raise ValueError("a payload doesn't fit its digest")
    return headers, block


def records(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each page record as its block and headers have it; of a revisit the length isn't known, and the digest is its header's."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        source, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                out, n = [], 0
                with source.open_input_stream(f"{root}/{row['path']}", compression=None) as stream:
                    for record in Members(stream):
                        h, block = parsed(record)
                        kind = h["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        n += 1
                        payload = block.partition(b"\r\n\r\n")[2]
                        length, digest = (len(payload), base32_sha1(payload)) if kind == "response" else (None, h["WARC-Payload-Digest"].removeprefix("sha1:"))
                        page_id = int(h["X-Page-Id"]) if "X-Page-Id" in h else None
                        out.append((h["WARC-Record-ID"], page_id, length, digest, kind, h.get("WARC-Refers-To"), h["WARC-Target-URI"]))
                        if len(out) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out = []
                if n != row["records"]:
                    raise ValueError(f"{row['path']} holds {n} records, its manifest says {row['records']}")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return manifest.repartition(max(1, files)).mapInArrow(run, RECORD)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each page record of the archives that the folder's manifest names.

    A revisit has the length of the response that it names, as read; if there is none, or with another digest, reading fails.
    """
    ship(spark)
    found = written(records(spark, folder), "warc-records")
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes")
    asked = revisits.groupBy("refers_record").agg(F.count("*").alias("asking"))
    named = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_record"), F.struct("payload_bytes", "payload_digest", "page_id").alias("response")).join(asked, "refers_record")
    met = join_counted(revisits, named, "refers_record", "asking", revisits.count(), "left")
    fits = F.coalesce(F.col("response.payload_digest") == F.col("payload_digest"), F.lit(False))
    length = F.when(fits, F.col("response.payload_bytes")).otherwise(F.raise_error(F.lit("a revisit doesn't fit its response")).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(met.withColumn("payload_bytes", length).withColumn("refers_to", F.col("response.page_id")).select(*columns))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages into a new folder in the shared one, and read the archives back."""
    folder = shared_path(pages.sparkSession, "warc")
    write(pages, folder, least)
    return read(pages.sparkSession, folder).drop("url")
