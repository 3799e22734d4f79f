"""WARC archives with revisit resolution.

Headers alone (digest, page id, url, place) meet in a shuffle by payload
digest; the page that keeps the payload is found by a partial aggregation, and
every header of a repeated payload is joined to it.  What a revisit refers to
is sent back to the input partition that its page lies in; that partition's
task then writes fresh records from its own rows: a response with the payload,
or a revisit that names the response.  Payloads are read where they lie and
cross no shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _files, _rows
from tessera.session import scratch, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads smaller than this are always stored.
MIN_PAYLOAD_BYTES = 0
#: An archive is closed once it holds this much; each file is read by one task.
ARCHIVE_BYTES = 32_000_000
#: Tasks that archives are dealt to for reading, at most.
READ_TASKS = 20_000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _clean(url: str | None) -> str:
    """A header value: control characters and spaces percent-encoded, null empty."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url or "")


def record_id(page_id: int | None, url: str, sha: str, place: int) -> str:
    """A record's name; the place keeps rows apart that agree in all else."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {sha} {place} {url}')}>"


def _record(page_id, url: str, sha: str, place: int, original, date: str, payload: bytes) -> bytes:
    kind = "response" if original is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, url, sha, place)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if original is not None:
        first_id, first_url, first_place = original
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(first_id, first_url, sha, first_place)}",
            f"WARC-Refers-To-Target-URI: {first_url}",
            f"WARC-Refers-To-Date: {date}",
            f"X-Refers-To-Page-ID: {first_id}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: Bits of ``monotonically_increasing_id`` below the partition's number.
_PART_BITS = 33


def _sent_back(decisions: str, part: int) -> dict[int, tuple[str, tuple]]:
    """place -> (digest, original) of the revisits among one input partition's rows."""
    system, path = _files.opened(f"{decisions}/part={part}")
    found = {}
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                rows = pq.ParquetFile(file).read().to_pydict()
            for place, sha, *original in zip(*(rows[c] for c in ("place", "sha", "first_id", "first_url", "first_place"))):
                found[place] = sha, tuple(original)
    return found


def _write(folder: str, decisions: str, limit: int, date: str):
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, size, records = None, None, 0, 0
        part, revisits = None, {}

        def manifest():
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": uri, "records": records, "bytes": size}], schema)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("place", "page_id", "url", "sha", "html"))):
                place, page_id, url, sha, html = (v.as_py() for v in row)
                if part != place >> _PART_BITS:
                    part = place >> _PART_BITS
                    revisits = _sent_back(decisions, part)
                found, original = revisits.get(place, (sha, None))
                if found != sha:
                    raise ValueError("pages changed between two reads; store the table first")
                if original is not None:
                    original = (original[0], _clean(original[1]), original[2])
                data = _member(_record(page_id, _clean(url), sha, place, original, date, (html or "").encode()))
                if out is None:
                    uri, out = _files.create(folder, ".warc.gz")
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= limit:
                    yield manifest()
                    out, size, records = None, 0, 0
        if out is not None:
            yield manifest()

    return write


def revisits(located: DataFrame, min_payload_bytes: int) -> DataFrame:
    """place, sha, first_id, first_url, first_place of every page whose payload another page keeps.

    ``located`` has place (unique), page_id, url, sha and size.  Of equal
    payloads the largest page_id keeps it, of rows that repeat that page_id
    the last place is named.
    """
    headers = located.where(F.col("size") >= min_payload_bytes).select("sha", "place", "page_id", "url")
    firsts = (
        headers.groupBy("sha")
        .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "place", "url")).alias("first"))
        .where("n > 1 AND first.page_id IS NOT NULL")
        .select("sha", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.place").alias("first_place"))
    )
    return headers.join(firsts, "sha").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).drop("page_id", "url")


def write_archives(
    pages: DataFrame,
    folder: str,
    min_payload_bytes: int = MIN_PAYLOAD_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and return the manifest (archive, records, bytes).

    Of the records with equal payloads of at least ``min_payload_bytes``, the
    one with the largest page_id is a response and the others revisit it;
    rows that repeat that page_id and payload are responses too.  Smaller
    payloads are always responses, and so are payloads all of whose page_ids
    are null.  A null html is an empty payload, a null url an empty target.
    Every record has a name of its own.  No rows give no archive.  Other
    columns are ignored.

    Pages are read twice and must be dealt alike both times, as a stored table
    is: where a shuffle makes them they are stored first.  A difference would
    be found by the digests and is an error.
    """
    pages = _rows.stored(pages.select("page_id", "url", "html"))
    payload = F.coalesce("html", F.lit(""))
    located = pages.select(
        F.monotonically_increasing_id().alias("place"), F.col("page_id").cast("long"), "url", "html", digest(payload).alias("sha")
    )
    sent = revisits(located.withColumn("size", F.octet_length(payload)), min_payload_bytes)
    sent = sent.withColumn("part", F.shiftright("place", _PART_BITS))
    decisions = scratch(pages.sparkSession, "revisits")
    sent.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(decisions)
    return written(
        located.mapInArrow(_write(folder, decisions, archive_bytes, date), "archive string, records long, bytes long"), "manifest"
    )


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record in a stream of gzip members; holds one record at a time."""
    data, members = b"", zlib.decompressobj(31)
    pending = bytearray()
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        pending += members.decompress(data)
        data = b""
        if members.eof:
            data = members.unused_data
            members = zlib.decompressobj(31)
            yield _parse(bytes(pending))
            pending.clear()
    if pending:
        raise ValueError("archive ends inside a record")


def _parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    end = raw.index(b"\r\n\r\n")
    version, *lines = raw[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = raw[end + 4 : end + 4 + int(headers["Content-Length"])]
    if "sha1:" + b32encode(hashlib.sha1(block).digest()).decode() != headers["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    return headers, block


_READ = "page_id long, url string, record_type string, payload_digest string, stored_bytes long, refers_to long, html string"


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        schema = pa.schema(list(zip(names, kinds)))
        for batch in batches:
            for uri in batch.column("archive"):
                out, held = [], 0
                with _files.read_stream(uri.as_py()) as stream:
                    for h, block in records(stream):
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        response = h["WARC-Type"] == "response"
                        sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if response and b32encode(hashlib.sha1(payload).digest()).decode() != sha:
                            raise ValueError("payload digest differs")
                        page, first = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        out.append((
                            page and int(page), h["WARC-Target-URI"], h["WARC-Type"], sha,
                            len(payload) if response else None, first and int(first),
                            payload.decode() if response and with_payload else None,
                        ))
                        held += len(payload) * with_payload + 200
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    return read


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the manifest's archives, as stored; digests are verified.

    page_id, url, record_type, payload_digest, stored_bytes (null for a
    revisit), refers_to (page_id of the response, null for one), html (null
    for a revisit or without ``with_payload``).
    """
    # a stated number, because a few bytes a file would otherwise be coalesced into one task
    tasks = max(1, min(manifest.count(), READ_TASKS))
    return manifest.repartition(tasks, "archive").mapInArrow(_read(with_payload), _READ)


def resolve(stored: DataFrame) -> DataFrame:
    """Join revisits to their responses: every row gets ``payload_bytes`` of the full payload."""
    sizes = (
        stored.where("record_type = 'response'")
        .groupBy("payload_digest")
        .agg(F.max("stored_bytes").alias("payload_bytes"))
    )
    revisits = stored.where("record_type = 'revisit'").join(sizes, "payload_digest", "left")
    responses = stored.where("record_type = 'response'").withColumn("payload_bytes", F.col("stored_bytes"))
    return responses.unionByName(revisits).drop("stored_bytes")


def round_trip(pages: DataFrame, min_payload_bytes: int = MIN_PAYLOAD_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and describe what is read back, one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url.
    """
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"), min_payload_bytes)
    stored = written(read_archives(manifest), "warc-index")
    return resolve(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
