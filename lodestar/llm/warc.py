"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader's tasks get byte ranges. A task looks for gzip magic from its range's start, takes a place for a
member only if it inflates to a WARC header, then goes from member to member; it owns the records that start
inside its range and reads past its end to finish the last. The member that follows a range's last record must
have a header too, so ranges leave no gap: damage is an error, never a record less.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, materialize, shared_dir, shuffle_partitions

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 2 << 20
CHUNK = 1 << 20
LEVEL = 4
MAX_HEADER = 64 << 10


def _header(kind: str, fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class Damage(ValueError):
    """An archive that doesn't hold the records it should."""


def record(page_id, url, payload: bytes | None, refers_to=None, digest: str | None = None, size: int | None = None) -> bytes:
    """One member. A revisit (``refers_to``) carries its payload's digest and size but not the payload."""
    clean = None if url is None else "".join(c for c in url if c not in "\r\n")
    revisit = refers_to is not None
    if payload is not None:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    fields = [
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size), ("X-Page-Id", page_id),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>" if revisit else None),
        ("X-Refers-To-Page-Id", refers_to), ("Content-Type", "application/http; msgtype=response"),
    ]
    body = http if revisit else http + payload
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(_header("revisit" if revisit else "response", fields, len(body)) + body + b"\r\n\r\n") + deflate.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000) -> DataFrame:
    """Write a record per row, an archive per task and a manifest (path, bytes, records), which is returned.

    Of rows with equal payloads of at least ``min_revisit`` bytes those with the largest id are responses and the
    others are revisits of it; null html is an empty payload. A row with a null id can't be referred to: it is
    written as a response. Repeated rows are each written. Only rows that may be revisits are joined, by their
    digests and without their payloads; payloads are dealt by id. A retried task writes a new file; only files of
    the manifest count. An empty table gives an empty manifest. Other columns aren't read.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    large = rows.filter((F.col("n") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "url", "sha", "n")
    copies = large.groupBy("sha").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("sha", "latest")
    revisits = materialize(large.join(copies, "sha").filter("page_id <> latest"), "warc-revisits")
    again = revisits.select("page_id", "sha").distinct()
    responses = rows.filter("page_id IS NOT NULL").join(again, ["page_id", "sha"], "left_anti").unionByName(rows.filter("page_id IS NULL"))
    columns = ["page_id", "url", "payload", "sha", "n", "refers_to"]
    records = responses.withColumn("refers_to", F.lit(None).cast(revisits.schema["latest"].dataType)).select(columns)
    records = records.unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")).withColumnRenamed("latest", "refers_to").select(columns))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        out, n, size = None, 0, 0
        for batch in batches:
            ids, refs = batch["page_id"].astype(object), batch["refers_to"].astype(object)
            for page_id, url, body, sha, length, ref in zip(ids, batch["url"], batch["payload"], batch["sha"], batch["n"], refs, strict=True):
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = record(_int(page_id), url, None if body is None else bytes(body), _int(ref), sha, int(length))
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    manifest = materialize(records.mapInPandas(put, "path string, bytes long, records long"), "warc-manifest")
    discard(revisits)
    return manifest


def _int(x):
    return None if x is None or x != x else int(x)


class _Source:
    """Bytes of a file from any offset on, kept only from where they are still needed."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.start, self.data, self.at = file, size, at, bytearray(), 0

    @property
    def offset(self) -> int:
        return self.start + self.at

    def more(self) -> bool:
        end = self.start + len(self.data)
        if end >= self.size:
            return False
        self.file.seek(end)
        got = self.file.read(min(CHUNK, self.size - end))
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at >= 2 * CHUNK:
            del self.data[: self.at]
            self.start, self.at = self.start + self.at, 0

    def done(self) -> bool:
        return self.at >= len(self.data) and not self.more()

    def find(self, mark: bytes) -> bool:
        """Go on to the mark; to the end if there is none."""
        while True:
            found = self.data.find(mark, self.at)
            if found >= 0:
                self.skip(found - self.at)
                return True
            self.skip(max(0, len(self.data) - len(mark) + 1 - self.at))
            if not self.more():
                return False


def _inflate(source: _Source, whole: bool = True) -> tuple[bytes, int] | None:
    """The member at the source's place: (content, member's size); None if it isn't one of a WARC record.

    At most MAX_HEADER bytes are inflated before they must hold a header. A member with a good header that can't
    be inflated to its end is damage. Without ``whole`` the header is enough.
    """
    gunzip, out, at, piece, tail, header = zlib.decompressobj(31), bytearray(), source.at, 4096, b"", None
    while not gunzip.eof:
        if not tail:
            if at >= len(source.data):
                start = source.start
                if not source.more():
                    if header:
                        raise Damage(f"member at {source.offset} ends too early")
                    return None
                at -= source.start - start
            tail = bytes(source.data[at : at + piece])
            at, piece = at + len(tail), min(4 * piece, CHUNK)
        try:
            out += gunzip.decompress(tail, CHUNK if header else MAX_HEADER)
        except zlib.error as e:
            if header:
                raise Damage(f"member at {source.offset}: {e}") from e
            return None
        tail = gunzip.unconsumed_tail
        if not header:
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
            end = out.find(b"\r\n\r\n")
            if end >= 0:
                header = fields_of(bytes(out[:end]))
            if header is None and (end >= 0 or len(out) >= MAX_HEADER):
                return None
            if header and not whole:
                return bytes(out), 0
    if header is None:
        return None
    return bytes(out), at - len(gunzip.unused_data) - source.at


def fields_of(head: bytes) -> dict[str, str] | None:
    """A record's header fields by lower-case name, or None if it isn't one of a WARC record."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    fine = lines[0].startswith("WARC/") and {"warc-type", "warc-record-id", "content-length"} <= fields.keys() and fields["content-length"].isdigit()
    return fields if fine else None


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block)"""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = fields_of(head)
    n = int(fields["content-length"])
    if len(rest) < n:
        raise Damage(f"record {fields['warc-record-id']} has {len(rest)} bytes of {n}")
    return fields, rest[:n]


def records_in(file, size: int, start: int, end: int, strict: bool = True) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records that start in [start, end).

    ``strict``: what follows a record, and what a file begins with, must be a record; else other bytes between
    records are passed over.
    """
    source, known = _Source(file, size, start), strict and start == 0
    while source.offset < end and not source.done():
        if not known and not source.find(MAGIC) or source.offset >= end:
            return
        member = _inflate(source)
        if member is None:
            if known:
                raise Damage(f"no record at {source.offset}")
            source.skip(1)
            continue
        fields, block = parse(member[0])
        yield source.offset, fields, block
        source.skip(member[1])
        known = strict
    if known and not source.done() and _inflate(source, whole=False) is None:
        raise Damage(f"no record at {source.offset}")


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True, strict: bool = True) -> DataFrame:
    """Records of the files of ``manifest`` (path, bytes), read by byte ranges of ``split_bytes``.

    Columns: path, offset, record_type, page_id, url, payload_bytes, payload_digest, refers_to, and the payload if
    asked for (null for revisits). Size and digest of a response are taken from its bytes; where they differ from
    the header's, the archive is damaged. Those of a revisit are the header's.
    """
    spark = manifest.sparkSession
    last = F.greatest(F.lit(0), F.col("bytes") - 1)
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0), last, F.lit(split_bytes))).alias("start"))
    ranges = ranges.repartition(shuffle_partitions(spark), "path", "start")
    names = ["path", "offset", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payload]

    def row(path: str, offset: int, f: dict[str, str], block: bytes) -> tuple:
        digest, size = f.get("warc-payload-digest", "").removeprefix("sha1:"), _number(f.get("x-payload-length"))
        body = None
        if f["warc-type"] != "revisit":
            body = block.partition(b"\r\n\r\n")[2]
            found = hashlib.sha1(body).hexdigest(), len(body)
            if digest and found[0] != digest or size is not None and found[1] != size:
                raise Damage(f"{path}: payload of the record at {offset} isn't what its header says")
            digest, size = found
        shown = path, offset, f["warc-type"], _number(f.get("x-page-id")), f.get("warc-target-uri"), size, digest, _number(f.get("x-refers-to-page-id"))
        return (*shown, body) if payload else shown

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path, size, start in batch.itertuples(index=False):
                store, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(inner) as file:
                    for offset, f, block in records_in(file, size, start, min(size, start + split_bytes), strict):
                        rows.append(row(path, offset, f, block))
                        held += len(block) if payload else 200
                        if held > 16 << 20:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    schema = "path string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"
    return ranges.mapInPandas(scan, schema + ", payload binary" * payload)


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, without the payloads.

    Ids are integers. An archive that gives another number of records than its manifest says is an error.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    manifest = write(pages, folder, id_col, url_col, html_col)
    found = materialize(read(manifest, split_bytes, payload=False), "warc-records")
    counts = found.groupBy("path").agg(F.count(F.lit(1)).alias("found"))
    short = manifest.join(counts, "path", "left").filter(F.coalesce("found", F.lit(0)) != F.col("records")).limit(1).collect()
    if short:
        raise Damage(f"{short[0]['path']}: {short[0]['found']} records of {short[0]['records']}")
    return found


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS latest FROM d
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM g
"""
