"""WARC archives: one gzip member per record, written and read by streaming tasks.

Archives live in a folder that all executors reach (any file system that pyarrow opens). A task writes its own
files under fresh names and reports them in its result rows; only files of committed rows are ever read,
so lost or repeated attempts leave at most unread files behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkframe.llm.common import durable, ensure_checkpoint_dir, map_batches

CHUNK = 1 << 20
# Fixed texts of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def _header_text(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), value)


def encode_record(key, url: str | None, payload: bytes, refers_to, is_revisit: bool, date: str, level: int = 6) -> bytes:
    """One record as a gzip member. A revisit carries the HTTP header only; its Content-Length and
    WARC-Payload-Digest are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block_digest = hashlib.sha1(http)
    if not is_revisit:
        block_digest.update(payload)
    head = [VERSION, f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(block_digest.digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if is_revisit else len(payload))}",
    ]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    parts = ["\r\n".join(head).encode() + b"\r\n\r\n", http, b"" if is_revisit else payload, b"\r\n\r\n"]
    return b"".join([*map(pack.compress, parts), pack.flush()])


class WarcError(ValueError):
    pass


class _Members:
    """Decompressed bytes of a file, member by member, a chunk at a time."""

    def __init__(self, source):
        self.source, self.raw, self.at = source, b"", 0

    def _fill(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(CHUNK)
        return bool(self.raw)

    def next_member(self) -> bool:
        """Start the next member; False at the end of the file."""
        self.buffer, self.unpack = b"", zlib.decompressobj(31)
        return self._fill()

    def _more(self) -> bool:
        """Decompress up to one more chunk of the member; False at its end."""
        if self.unpack.eof:
            return False
        if not self.unpack.unconsumed_tail and not self._fill():
            raise WarcError("the file ends within a member")
        given = self.unpack.unconsumed_tail or self.raw
        if not self.unpack.unconsumed_tail:
            self.raw = b""
            self.at += len(given)
        try:
            self.buffer += self.unpack.decompress(given, CHUNK)
        except zlib.error as e:
            raise WarcError(f"broken member: {e}") from None
        if self.unpack.eof:
            self.raw = self.unpack.unused_data + self.raw
            self.at -= len(self.unpack.unused_data)
        return True

    def line(self, most: int = CHUNK) -> bytes:
        while b"\r\n" not in self.buffer:
            if len(self.buffer) > most or not self._more():
                raise WarcError("a header line does not end")
        out, _, self.buffer = self.buffer.partition(b"\r\n")
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in parts."""
        while n:
            if not self.buffer and not self._more():
                raise WarcError("the member is shorter than its content length")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            if part:
                yield part

    def end(self) -> None:
        """The record's end: two line ends, then the member's checksum, and nothing else."""
        while self._more():
            if len(self.buffer) > 4:
                break
        if self.buffer != b"\r\n\r\n" or not self.unpack.eof:
            raise WarcError("the record does not end where its content length says")


def _headers(stream: _Members) -> dict[str, str]:
    out = {}
    while line := stream.line():
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise WarcError(f"no header line: {name[:80]}")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(source, keep_payload: bool = True) -> Iterator[dict]:
    """Records of one archive in order. Blocks pass through in chunks; digests are checked on the way.

    A record whose digests disagree has `ok` false. Broken framing raises WarcError at that record.
    """
    stream = _Members(source)
    while True:
        start = stream.at
        if not stream.next_member():
            return
        if not stream.line().startswith(b"WARC/"):
            raise WarcError("no WARC version line")
        head = _headers(stream)
        length = head.get("content-length", "")
        if not length.isdigit():
            raise WarcError("no content length")
        block, payload, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []
        http, in_payload = b"", False
        for part in stream.exactly(int(length)):
            block.update(part)
            if not in_payload:
                http += part
                cut = http.find(b"\r\n\r\n")
                if cut < 0:
                    continue
                in_payload, part, http = True, http[cut + 4 :], http[:cut]
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        stream.end()
        kind = head.get("warc-type")
        declared = {k: head.get(f"warc-{k}-digest", "").removeprefix("sha1:") for k in ("payload", "block")}
        found = {k: base64.b32encode(h.digest()).decode() for k, h in (("payload", payload), ("block", block))}
        ok = declared["block"] in ("", found["block"])
        full = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        if kind != "revisit":
            ok = ok and declared["payload"] in ("", found["payload"]) and (not full or int(full[1]) == size)
        yield {
            "record_type": kind,
            "record_id": head.get("warc-record-id"),
            "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"),
            "refers_to_id": head.get("warc-refers-to"),
            "payload_bytes": int(full[1]) if full and kind == "revisit" else size,
            "payload_digest": declared["payload"] or found["payload"],
            "payload": b"".join(kept) if keep_payload and kind != "revisit" else None,
            "start": start,
            "ok": ok,
        }


RECORD = (
    "path string, start long, record_type string, record_id string, target_uri string, date string, refers_to_id string, "
    "payload_bytes long, payload_digest string, payload binary, ok boolean, error string"
)


def decide_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with `_payload`, `_refers_to` and `_revisit`.

    Of pages with equal payloads of at least `least_bytes`, the largest page_id is the response; pages that
    share that id with it are responses too, all others revisit it. Null ids are below all others.
    The largest id per digest is found with partial aggregation before the shuffle; joining it back leaves one
    small row against a digest's pages, which adaptive execution splits where a digest is frequent.
    """
    rows = pages.select(
        F.col("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("_payload"),
    ).withColumn("_sha1", F.sha1("_payload"))
    long_enough = F.octet_length("_payload") >= least_bytes
    first = rows.where(long_enough).groupBy(F.col("_sha1").alias("_d")).agg(F.max("page_id").alias("_refers_to"))
    out = rows.join(first, (F.col("_sha1") == F.col("_d")) & long_enough, "left")
    return out.withColumn("_revisit", F.coalesce(F.col("_refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_refers_to")), F.lit(False)))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20, level: int = 6) -> DataFrame:
    """Write pages (page_id, url, html) as archives under `folder`; returns the committed files (path, records).

    Every row gives one record. Null html is an empty payload, a null url no target URI, a null id the
    bare URN. Other columns are ignored. An empty table gives no file.
    """
    decided = decide_records(pages, least_bytes)

    def write(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, path, size, done = None, None, 0, []
        records = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{base}/pages-{uuid.uuid4().hex}.warc.gz"
                    out, size, records = fs.open_output_stream(path, compression=None), 0, 0
                data = encode_record(row["page_id"], row["url"], row["_payload"], row["_refers_to"], row["_revisit"], date, level)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    columns = decided.select("page_id", "url", "_payload", "_refers_to", "_revisit")
    return durable(columns.mapInArrow(write, "path string, records long"))


def read_warc(files: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """Records of the archives named in column `path`, on the file system of `folder`; one task walks a file in order.

    A file that breaks off gives its whole records, then one row with `ok` false and `error`.
    """

    def read(columns):
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(folder)
        names = [f.split()[0] for f in RECORD.split(", ")]
        for path in columns["path"]:
            part = {n: [] for n in names}
            held = 0
            with fs.open_input_stream(path, compression=None) as source:
                try:
                    for record in read_records(source, keep_payload):
                        for n in names:
                            part[n].append(path if n == "path" else record.get(n))
                        held += 1 + len(record["payload"] or b"")
                        if len(part["ok"]) >= 5000 or held > 16 << 20:
                            yield part
                            part, held = {n: [] for n in names}, 0
                except WarcError as e:
                    for n in names:
                        part[n].append({"path": path, "ok": False, "error": str(e)}.get(n))
            yield part

    count = files.count()
    return map_batches(files.select("path").repartition(max(1, count)), read, RECORD)


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back, and return one row per record read; a broken record is an error."""
    folder = f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    records = read_warc(write_warc(pages, folder, least_bytes), folder, keep_payload=False)
    key = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")
    return records.select(
        F.when(F.col("ok"), key("record_id")).otherwise(F.raise_error(F.concat(F.lit("bad record in "), "path"))).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", key("refers_to_id")).alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
