"""WARC archives: written as whole-file gzip, normalised to one member a record, read by offset.

Spark's text writer makes the archives: a record is a line, its end of two line breaks
is the line separator, and the file is one gzip stream.  Such a file can be read from
its start only.  The normaliser inflates each file once, as a stream, and writes
each record as a gzip member of its own, with a sidecar index of offsets beside the
archive.  Readers take runs of neighbouring records from the index, so one large
archive is read by many tasks.

Payloads that repeat are written once: the record with the smallest page id is the
``response``, the others are ``revisit`` records that name it and its digest.

Nulls: a null html is an empty payload, a null url becomes the page's own URN, a null page id is
written as ``null`` and revisits the smallest id of its payload.  Rows that repeat the
page id and the payload of a response are responses too.  Payloads may hold line breaks,
header lines or whole records: lengths alone tell where a record ends.  Only ``page_id``,
``url`` and ``html`` are read, whatever else a table holds.  No rows give no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.llm.common import batch_of, stage
from feedcore.session import shared_folder

VERSION = "WARC/1.1"
END = "\r\n\r\n"
URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes inflated or copied at once.
CHUNK = 1 << 20
#: Bytes of an archive that one reading task takes at least.
SPLIT = 8 << 20
#: Groups of repeated payloads up to this number are broadcast (about 100 bytes each); above, they are joined.
BROADCAST_ROWS = 100_000


def base32_sha1(data: str | Column) -> Column:
    """SHA-1 in upper-case base 32, from built-in functions: 40 bits are ten hex digits and eight of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_response(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html`` and, for a page whose payload another record holds, that ``refers_to``.

    Groups are found from digests.  Only those with several rows go back to the pages,
    so bodies are shuffled only if there are very many such groups.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("sha", F.sha2("html", 256))
    large = keyed.where(F.octet_length("html") >= min_bytes)
    groups = large.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = stage(groups.where("n > 1").select("sha", "first"), "payloads")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    later = F.col("page_id").isNull() & F.col("first").isNotNull() | (F.col("page_id") > F.col("first"))
    return keyed.join(groups, "sha", "left").select("page_id", "url", "html", F.when(later, F.col("first")).alias("refers_to"))


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column ``record``: a WARC record a row, without the two line breaks at its end."""
    revisit = F.col("refers_to").isNotNull()
    page = F.concat(F.lit(URN), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), page)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(END),
    )
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("html"))
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.concat(F.lit("<"), page, F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1("html"))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{URN}"), F.col("refers_to").cast("string"), F.lit(">")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", size.cast("string")),
    ]
    head = [F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")) for name, value in fields]
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    return pages.select(F.concat(F.lit(VERSION), *head, F.lit(END), http, body).alias("record"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, per_file: int = 50_000) -> None:
    """Archives of at most ``per_file`` records, each one gzip stream as a whole."""
    lines = records(with_response(pages, min_bytes)).write.option("lineSep", END).option("compression", "gzip")
    lines.option("maxRecordsPerFile", per_file).text(folder)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip stream, piece by piece; further members are read on."""
    inflate, data = zlib.decompressobj(31), b""
    started = False
    while True:
        if not data:
            data = source.read(CHUNK)
            if not data:
                break
        if inflate.eof:
            data = data.lstrip(b"\0")
            if not data:
                continue
            inflate = zlib.decompressobj(31)
        started = True
        piece = inflate.decompress(data, CHUNK)
        data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        if piece:
            yield piece
    if started and not inflate.eof:
        raise ValueError("the archive ends within a gzip member")


class RecordStream:
    """Records of an inflated archive: heads as fields, then their blocks in pieces."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.buffer = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buffer += piece
        return True

    def head(self) -> tuple[bytes, dict[str, str]] | None:
        """The next record's head, with its empty line, and its fields in lower case; None at the end."""
        while True:
            blank = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            del self.buffer[:blank]
            if self.buffer or not self._more():
                break
        if not self.buffer:
            return None
        seen = 0
        while (end := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buffer)
            if not self._more():
                raise ValueError("the archive ends within a record's head")
        raw = bytes(self.buffer[: end + 4])
        del self.buffer[: end + 4]
        return raw, fields_of(raw)

    def block(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record's block")
            piece = bytes(self.buffer[: min(size, CHUNK)])
            del self.buffer[: len(piece)]
            size -= len(piece)
            yield piece


def fields_of(head: bytes) -> dict[str, str]:
    version, *lines = head.decode("utf-8", "replace").strip().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    found = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in found}


def rewrite(source, target) -> Iterator[tuple[int, int, str, str]]:
    """Copy every record to ``target`` as its own member; ``(offset, length, type, id)`` of each."""
    stream, at = RecordStream(inflated(source)), 0
    while (found := stream.head()) is not None:
        raw, fields = found
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        length = target.write(deflate.compress(raw))
        for piece in stream.block(int(fields["content-length"])):
            length += target.write(deflate.compress(piece))
        length += target.write(deflate.compress(END.encode()) + deflate.flush())
        yield at, length, fields.get("warc-type", ""), fields.get("warc-record-id", "")
        at += length


def normalise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Rewrite all archives of a folder; one row ``(archive, records, bytes)`` a file.

    An archive is one task's stream, as a gzip stream has one beginning; memory is a few
    chunks, whatever its length.  Each attempt writes files of its own and then renames both,
    the index last, so a repeated task leaves the same pair.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    paths = files.where("length > 0").select("path")
    tasks = max(1, min(100_000, paths.count()))

    def run(batches):
        attempt = TaskContext.get().taskAttemptId()
        where, base = _opened(target)
        where.create_dir(base, recursive=True)
        for batch in batches:
            done = []
            for path in batch.column("path").to_pylist():
                system, name = _opened(path)
                own = hashlib.md5(path.encode()).hexdigest()
                final, part = f"{base}/{own}.warc.gz", f"{base}/{own}.{attempt}.part"
                n = size = 0
                with (
                    system.open_input_stream(name, compression=None) as source,
                    where.open_output_stream(part, compression=None) as out,
                    where.open_output_stream(f"{part}.idx", compression=None) as index,
                ):
                    for offset, length, kind, key in rewrite(source, out):
                        index.write(f"{own}.warc.gz\t{offset}\t{length}\t{kind}\t{key}\n".encode())
                        n, size = n + 1, offset + length
                for end in ("", ".idx"):
                    if where.get_file_info(final + end).type == fs.FileType.File:
                        where.delete_file(final + end)
                    where.move(part + end, final + end)
                done.append((f"{own}.warc.gz", n, size))
            if done:
                yield batch_of(_FILES, *zip(*done))

    return stage(paths.repartition(tasks).mapInArrow(run, "archive string, records long, bytes long"), "archives")


_FILES = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
INDEX = "archive string, offset long, length long, record_type string, record_id string"
_READ = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string())]
    + [("refers_to_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
READ = (
    "archive string, offset long, record_type string, record_id string, refers_to_id string, target_uri string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).option("sep", "\t").option("quote", "").csv(f"{folder}/*.warc.gz.idx")


def parsed(member: bytes) -> tuple:
    """Fields of one record, its digest checked against its payload.

    A revisit has no payload; its HTTP head still gives the length of the full one.
    """
    stream = RecordStream(iter([zlib.decompress(member, 31)]))
    _, fields = stream.head()
    block = b"".join(stream.block(int(fields["content-length"])))
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type", "")
    said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    size = int(said.group(1)) if said else len(payload)
    if kind == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and own != digest or size != len(payload):
            raise ValueError(f"record {fields.get('warc-record-id')}: payload and head disagree")
        digest = own
    named = [(fields.get(n) or "").strip("<>") or None for n in ("warc-record-id", "warc-refers-to", "warc-target-uri")]
    return kind, *named, digest, size, payload if kind == "response" else None


def read_archives(spark: SparkSession, folder: str, wanted: DataFrame | None = None, split: int = SPLIT) -> DataFrame:
    """Records of normalised archives: all, or those in ``wanted`` (rows of the index).

    Tasks get runs of neighbouring records of about ``split`` bytes.
    """
    index = wanted if wanted is not None else read_index(spark, folder)
    runs = index.withColumn("run", F.floor(F.col("offset") / split))
    total = runs.agg(F.sum("length").alias("n")).first().n or 0
    runs = runs.repartition(max(1, min(100_000, -(-total // split))), "archive", "run")
    runs = runs.sortWithinPartitions("archive", "offset").select("archive", "offset", "length")

    def run(batches):
        where, base = _opened(folder)
        name = source = None
        try:
            for batch in batches:
                out, size = [], 0
                for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if archive != name:
                        if source:
                            source.close()
                        name, source = archive, where.open_input_file(f"{base}/{archive}")
                    out.append((archive, offset, *parsed(source.read_at(length, offset))))
                    size += len(out[-1][-1] or b"")
                    if size > split:
                        yield batch_of(_READ, *zip(*out))
                        out, size = [], 0
                if out:
                    yield batch_of(_READ, *zip(*out))
        finally:
            if source:
                source.close()

    return runs.mapInArrow(run, READ)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """All pages written, normalised and read back, one row a record with its payload."""
    spark = pages.sparkSession
    raw, target = shared_folder(spark, "warc-raw"), shared_folder(spark, "warc")
    write_archives(pages, raw, min_bytes)
    if not normalise(spark, raw, target).agg(F.sum("records").alias("n")).first().n:
        return spark.createDataFrame([], READ)
    return read_archives(spark, target)


def page_of(record_id: str) -> Column:
    """The page id in a record's URN; null for the id ``null``."""
    return F.expr(f"try_cast(substring({record_id}, {len(URN) + 1}) as long)")
