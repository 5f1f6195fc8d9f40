"""Canonical exact fingerprints of documents.

A text is normalised (NFKC), case-folded, and its runs of white space become one space. The fingerprint is the 128-bit
xxh3 of these canonical bytes. Equal hashes are not trusted: within a bucket of equal hashes the canonical bytes of all different
texts are compared, and where they differ the fingerprint carries the number of the variant behind the hash. Copies are
collapsed by the SHA-256 of the raw text first, so a bucket of a million copies costs one comparison.

As the digest is exact, the likeness of two fingerprints is 1 or 0.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import ship, texts, with_rid, written

#: Buckets with differing raw texts up to which their members are sent to the readers; beyond it they are joined.
SEND_MEMBERS = 200_000
#: Hexadecimal digits of a hash; fewer make buckets of different texts, for tests.
DIGITS = 32
NEIGHBOURS = "rid long, doc_id long, n_chars long, hash string, sha string, edited_hash string, edited_sha string, next_hash string, next_sha string, part int, place string, first_sha string, z binary"
NAMES = [x.split(" ")[0] for x in NEIGHBOURS.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int32(), pa.string(), pa.string(), pa.binary()]


def canonical(text: str) -> bytes:
    """NFKC, case folded, runs of white space as one space, none at the ends."""
    folded = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def hashed(text: str, digits: int = DIGITS) -> tuple[str, str]:
    """xxh3 of the canonical bytes, cut to some hexadecimal digits, and SHA-256 of the raw bytes."""
    return xxhash.xxh3_128_hexdigest(canonical(text))[:digits], hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """rid, doc_id, compressed text, sha in range partitions by descending doc_id; ties by the text's SHA-256, then row id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            column = batch.column("text")
            raw = [column[i].as_py().encode("utf-8", "surrogatepass") for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary()), pa.array([squeeze.compress(r) for r in raw], pa.binary())], names=["rid", "doc_id", "sha", "z"])

    order = [F.desc_nulls_last("doc_id"), F.asc("sha"), F.asc("rid")]
    return docs.mapInArrow(run, "rid long, doc_id long, sha binary, z binary").repartitionByRange(*order).sortWithinPartitions(*order)


def paired(rows: Iterator[tuple[int, int | None, str]], digits: int) -> Iterator[tuple]:
    """Of each row but the last, what it gives together with its follower; (rid, doc_id, text) in."""
    held = None
    for rid, doc_id, text in rows:
        own = hashed(text, digits)
        if held:
            yield with_next(*held, text, own, digits)
        held = (rid, doc_id, text, own)


def with_next(rid: int, doc_id: int | None, text: str, own: tuple[str, str], following: str, theirs: tuple[str, str], digits: int) -> tuple:
    changed = hashed(edited(text, following), digits)
    return rid, doc_id, len(text), *own, *changed, *theirs


def ends_met(rows: DataFrame, close: Callable[[dict, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What close() gives for each partition's last row and the next one's first; behind the last partition comes the first.

    rows has part (its partition) and place ("first", "last" or null). The numbers of partitions that have rows reach the driver.
    """
    parts = sorted(r[0] for r in rows.where("place = 'first'").select("part").collect())
    before = rows.sparkSession.createDataFrame([(p, parts[i - 1]) for i, p in enumerate(parts)], "part int, before int")
    ends = rows.where(F.col("place").isNotNull()).join(F.broadcast(before), "part", "left")
    paired_ = ends.withColumn("pair", F.when(F.col("place") == "first", F.col("before")).otherwise(F.col("part"))).drop("before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for i in range(batch.num_rows):  # texts may be long, so one at a time
                r = batch.slice(i, 1).to_pylist()[0]
                if r["place"] == "last":
                    last = r
                else:
                    yield from close(last, r)

    return paired_.repartition("pair").sortWithinPartitions("pair", F.desc("place")).mapInArrow(run, schema)


def neighbours(docs: DataFrame, digits: int) -> DataFrame:
    """Hashes of each text, its edited text and the next document's, by one range shuffle.

    A partition's last text meets the next one's first by one more shuffle, of two rows a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow, part = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        last: list = []

        def rows() -> Iterator[tuple[int, int | None, str]]:
            for batch in batches:
                ids, docs_, zs = batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("z")
                for i, (rid, doc_id) in enumerate(zip(ids, docs_, strict=True)):
                    z = zs[i].as_py()
                    if not last:
                        first.append((rid, doc_id, z))
                    last[:] = [(rid, doc_id, z)]
                    yield rid, doc_id, grow.decompress(z).decode("utf-8", "surrogatepass")

        first: list = []
        out = []
        for row in paired(rows(), digits):
            out.append((*row, part, None, None, None))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)
                out = []
        for place, ends in (("first", first), ("last", last)):
            out += [(rid, doc_id, *[None] * 7, part, place, None, z) for rid, doc_id, z in ends]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

    def close(last: dict, first: dict) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        texts_ = [grow.decompress(r["z"]).decode("utf-8", "surrogatepass") for r in (last, first)]
        yield closing((last["rid"], last["doc_id"], texts_[0]), texts_[1], digits)

    most = written(in_order(docs).mapInArrow(run, NEIGHBOURS), "neighbours")
    ends = ends_met(most, close, NEIGHBOURS)
    return most.where(F.col("place").isNull()).unionByName(ends).drop("part", "place", "first_sha", "z")


def closing(row: tuple, following: str, digits: int) -> pa.RecordBatch:
    rid, doc_id, text = row
    out = (*with_next(rid, doc_id, text, hashed(text, digits), following, hashed(following, digits), digits), None, None, None, None)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, TYPES, strict=True)], names=NAMES)


def variants(docs: DataFrame, table: DataFrame, digits: int) -> DataFrame | None:
    """hash, sha, variant for texts that share a hash and whose canonical bytes differ from the first ones; None if there are none.

    Looked at are the buckets that hold different raw texts; of each such text one row is read again.
    """
    members = table.select("hash", "sha", "rid", F.lit(False).alias("of_edited")).unionByName(table.select(F.col("edited_hash").alias("hash"), F.col("edited_sha").alias("sha"), "rid", F.lit(True).alias("of_edited")))
    single = members.groupBy("hash", "sha").agg(F.min(F.struct("of_edited", "rid")).alias("at"))
    mixed = single.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    wanted = written(single.join(mixed, "hash", "left_semi").select("hash", "sha", "at.of_edited", "at.rid"), "variants")
    count = wanted.count()
    if not count:
        return None
    own = wanted.where(~F.col("of_edited")).select("rid")
    parts = docs.join(F.broadcast(own) if count <= SEND_MEMBERS else own, "rid", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            raw = [column[i].as_py() for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([pa.array([hashed(t, digits)[0] for t in raw], pa.string()), pa.array([hashed(t, digits)[1] for t in raw], pa.string()), pa.array([canonical(t) for t in raw], pa.binary())], names=["hash", "sha", "bytes"])

    seen = parts.mapInArrow(run, "hash string, sha string, bytes binary")
    if not wanted.where("of_edited").isEmpty():
        keep = {r["rid"] for r in wanted.where("of_edited").select("rid").limit(SEND_MEMBERS).collect()}
        if len(keep) < SEND_MEMBERS:
            seen = seen.unionByName(edited_members(docs, keep, digits))
        else:
            seen = seen.unionByName(edited_members(docs, None, digits))
    compared = seen.dropDuplicates(["hash", "sha"]).groupBy("hash", "bytes").agg(F.collect_set("sha").alias("shas"))
    many = compared.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("bytes")) - 1
    found = written(compared.join(many, "hash", "left_semi").select("hash", "shas", rank.alias("variant")).where("variant > 0").select("hash", F.explode("shas").alias("sha"), "variant"), "variants")
    return None if found.isEmpty() else found


def edited_members(docs: DataFrame, keep: set[int] | None, digits: int) -> DataFrame:
    """hash, sha, canonical bytes of edited texts, of the rows in keep or of all; the pairs at partitions' ends are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow, part = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        held, first = None, None
        for batch in batches:
            for r in batch.to_pylist():
                text = grow.decompress(r["z"]).decode("utf-8", "surrogatepass")
                if first is None:
                    first = text
                    yield end(part, "first", r["rid"], text)
                if held and (keep is None or held[0] in keep):
                    yield member(edited(held[1], text))
                held = (r["rid"], text)
        if held:
            yield end(part, "last", *held)

    def member(text: str) -> pa.RecordBatch:
        h, s = hashed(text, digits)
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([h]), pa.array([s]), pa.array([canonical(text)], pa.binary())], names=["part", "place", "rid", "hash", "sha", "bytes"])

    def end(part: int, place: str, rid: int, text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place]), pa.array([rid], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([text.encode("utf-8", "surrogatepass")], pa.binary())], names=["part", "place", "rid", "hash", "sha", "bytes"])

    def close(last: dict, first: dict) -> Iterator[pa.RecordBatch]:
        if keep is None or last["rid"] in keep:
            yield member(edited(*(r["bytes"].decode("utf-8", "surrogatepass") for r in (last, first))))

    schema = "part int, place string, rid long, hash string, sha string, bytes binary"
    rows = written(in_order(docs).mapInArrow(run, schema), "edited")
    ends = ends_met(rows, close, schema)
    return rows.where(F.col("place").isNull()).unionByName(ends).select("hash", "sha", "bytes")


def fingerprint(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Fingerprints of every whole text and of its edited text; a row for each row of docs.

    docs has doc_id and text; other columns are ignored. The edited text takes its second half from the next
    document by descending doc_id (null ids come last; equal ids are ordered by the SHA-256 of their texts), the last document's from
    the first. A null text is empty; an empty text has the fingerprint of nothing and an edited text that is empty. Repeated
    rows are neighbours and have equal fingerprints. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = with_rid(texts(docs))
    table = neighbours(docs, digits)
    differing = variants(docs, table, digits)
    if differing is None:
        print_of = {k: F.col(f"{k}hash") for k in ("", "edited_", "next_")}
    else:
        for k in ("", "edited_", "next_"):
            own = differing.select(F.col("hash").alias(f"{k}hash"), F.col("sha").alias(f"{k}sha"), F.col("variant").alias(f"{k}variant"))
            table = table.join(own, [f"{k}hash", f"{k}sha"], "left")
        print_of = {k: F.concat_ws("-", f"{k}hash", F.col(f"{k}variant").cast("string")) for k in ("", "edited_", "next_")}
    like = lambda k: (print_of[""] == print_of[k]).cast("double")
    return table.select("doc_id", "n_chars", F.col("edited_sha").alias("edited_sha256"), print_of[""].alias("fingerprint"), print_of["edited_"].alias("edited_fingerprint"), like("edited_").alias("near_edited"), like("next_").alias("near_next"))
