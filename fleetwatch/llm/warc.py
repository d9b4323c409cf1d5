"""WARC archives of pages: a trained Zstandard dictionary in a leading skippable frame, each record its own frame."""

from __future__ import annotations

import hashlib
import struct
import uuid
import warnings
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetwatch.plans.orderstat import first_rows

from .common import saved, shared_dir, small_batches

#: Fixed value of the format: the little-endian magic number of a skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads shorter than this are always written in full.
LEAST_PAYLOAD = 100
#: The sample that a dictionary is trained on: so many different payloads, of each at most so many characters; the dictionary's size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 16_000, 64_000
#: An archive is closed after the record that takes it over this size.
ARCHIVE_BYTES = 128 << 20
LEVEL = 5


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded, seeded sample of the records to archive.

    The sample holds at most SAMPLE_RECORDS different payloads, those whose
    hash comes first, and of a long one a piece of SAMPLE_BYTES characters from
    a place that its hash tells. Only the sample comes to the driver. Without
    enough material there is no dictionary (empty), and a warning says so.
    """
    some = pages.where(F.octet_length("html") > 0).select(F.xxhash64("html").alias("h"), "html")
    last = first_rows(some.select("h").distinct(), SAMPLE_RECORDS, [F.col("h")]).agg(F.max("h")).first()[0]
    records = []
    if last is not None:
        start = F.pmod("h", F.greatest(F.length("html") - SAMPLE_BYTES, F.lit(0)) + 1) + 1
        piece = F.substr(F.col("html"), start.cast("int"), F.lit(SAMPLE_BYTES))
        drawn = some.where(F.col("h") <= last).select("h", piece.alias("piece")).groupBy("h").agg(F.min("piece").alias("piece")).collect()
        records = [r.piece.encode("utf-8", "replace") for r in sorted(drawn, key=lambda r: r.h)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError) as e:
        warnings.warn(f"archives are written without a dictionary: {len(records)} records are too little to train on ({e})", stacklevel=2)
        return b""


def roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to) with a null html where the record only refers to another."""
    kept = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kept = kept.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)})
    first = (kept.where(F.col("payload_bytes") >= LEAST_PAYLOAD).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies"))
    both = kept.join(first, "payload_digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return both.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "payload_bytes", "payload_digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, html: str | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. The page's id and payload size stand in extension fields."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    target = "".join(c for c in (url or "") if c > " " and c != "\x7f") or f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = head + (b"" if refers_to is not None else (html or "").encode("utf-8", "replace"))
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}",
              f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(fields).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write what :func:`roles` returns as archives; (path, records, bytes) of each.

    Every task writes files of its own names through the folder's file system
    and only those that the returned table lists count, so a repeated or lost
    task leaves nothing that is read.
    """

    def run(batches):
        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        made, out, path, n, size = [], None, "", 0, 0
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None:
                    path, n, size = f"{root}/pages-{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = place.open_output_stream(path, compression=None)
                    if dictionary:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                frame = pack.compress(record(*row, date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size > ARCHIVE_BYTES:
                    out.close()
                    made.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    small_batches(pages.sparkSession)
    return pages.mapInArrow(run, "path string, records long, bytes long")


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of one archive; the dictionary comes from its first frame, if that is skippable."""
    start, dictionary = stream.read(8), None
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_MAGIC:
        dictionary, start = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", start[4:])[0])), b""

    class Rest:
        def read(self, n=-1):
            nonlocal start
            if start:
                got, start = start, b""
                return got
            return stream.read(n)

    plain = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(Rest(), read_across_frames=True)
    have = b""

    def need(n):
        nonlocal have
        parts, size = [have], len(have)
        while size < n and (more := plain.read(max(1 << 16, n - size))):
            parts.append(more)
            size += len(more)
        have = b"".join(parts)
        return size >= n

    while need(1):
        while (end := have.find(b"\r\n\r\n")) < 0:
            if not need(len(have) + 1):
                raise ValueError("an archive ends within a record's fields")
        lines = have[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        if not need(end + 4 + size + 4):
            raise ValueError("an archive ends within a record's block")
        yield fields, have[end + 4 : end + 4 + size]
        have = have[end + 4 + size + 4 :]


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The pages' records of listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's payload is measured and hashed anew, and refused if its record
    says something else; a revisit's are those of the payload it refers to.
    """

    def run(batches):
        place, _ = fs.FileSystem.from_uri(folder)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        rows: list[tuple] = []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
            rows.clear()
            return out

        for paths in batches:
            for path in paths.column(0).to_pylist():
                with place.open_input_stream(path, compression=None) as stream:
                    for fields, block in read_records(stream):
                        size, digest, kind = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                                raise ValueError(f"payload of record {fields['warc-record-id']} doesn't match its digest")
                        page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
                        rows.append((page and int(page), size, digest, kind, refers and int(refers), fields["warc-target-uri"]))
                        if len(rows) >= 10_000:
                            yield batch()
        yield batch()

    n = max(archives.count(), 1)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return archives.select("path").repartition(n, "path").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page's record and read the archives back.

    ``pages`` has page_id (long), url and html. Of payloads of 100 bytes or
    more that are equal, the one with the smallest page_id is a response and
    the others revisit it; rows equal in payload and page_id to it are
    responses too. Null html is an empty payload; a null url becomes
    ``urn:page:<id>``; a null page_id revisits where it can and stays null;
    an empty table gives no archive and an empty result; other columns are
    ignored. Archives stay in ``folder``, by default under the shared one.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    written = saved(write_archives(roles(source), folder, train_dictionary(source)), "warc-list")
    return read_archives(written, folder)
