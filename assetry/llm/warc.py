"""WARC archives as a table of chunks.

A payload is written and read in chunks: a reader gives rows (record, chunk
number, bytes) and carries the digest of the payload so far from chunk to chunk,
so no record is ever whole in memory, however long it is.  Equal payloads are
stored once: the page with the largest id has the response, the others revisit it.

An archive holds one gzip member per record.  A task writes its archives under
names of its own attempt, and the table of archives names those of committed
attempts only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetry.llm.common import arrow_schema, batch_of, give_back, new_folder, open_store, saved, slices

ARCHIVE_BYTES = 1 << 26  # an archive is closed after the record that reaches this
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
ARCHIVES = "path string, n_records long, bytes long"
CHUNKS = (
    "page_id long, record_id string, record_type string, refers_to long, url string, "
    "chunk_no int, data binary, payload_bytes long, payload_digest string, last boolean"
)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URLs


def base32_sha1(state) -> str:
    return base64.b32encode(state.digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {url}')}>"


def _field(text: str) -> str:
    """A header value on one line: control characters and % in percent form."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _text(field: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), field)


def _head(page_id, url, kind, refers_to, size: int, digest: str) -> bytes:
    """WARC and HTTP headers of a record with a payload of `size` bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if kind == 'response' else 0)}",
    ]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        fields.append(f"Page-ID: {page_id}")
    if kind == "revisit":
        fields += [f"WARC-Profile: {_PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(fields) + "\r\n\r\n" + http).encode()


def _originals(pages: DataFrame, least_bytes: int) -> DataFrame:
    """`pages` with `original`: the largest page_id of its payload where several
    rows have it, else null.  Only digests are grouped; a frequent payload is one row
    for each task."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        "page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1")
    )
    several = (
        keyed.where(F.octet_length("html") >= least_bytes)
        .groupBy("sha1")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("original"))
        .where("n > 1")
        .select("sha1", "original")
    )
    return keyed.join(several, "sha1", "left").select("page_id", "url", "html", "original")


def write(
    pages: DataFrame,
    folder: str | None = None,
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row of `pages` (page_id, url, html) below `folder`
    (default: a new one in the shared folder); returns the table of archives.

    The payload is the html in UTF-8; null counts as empty.  Of rows with equal
    payloads of at least `least_bytes` bytes, that with the largest page_id is the
    response and the others revisit it; rows that repeat this id are responses too.
    A null page_id or url has no header; where all ids of a payload are null, its
    rows are responses.  Other columns are not read; an empty table has no archive.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    arrow = arrow_schema(ARCHIVES)

    def run(batches):
        give_back()
        out, name, inner, records, size = None, "", "", 0, 0

        def close():
            nonlocal out
            out.close()
            out = None
            return batch_of(arrow, [(name, records, size)])

        for batch in batches:
            for part in slices(batch, 64):
                for page_id, url, html, original in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None:
                        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        store, inner = open_store(name)
                        store.create_dir(inner.rpartition("/")[0], recursive=True)
                        out, records, size = store.open_output_stream(inner, compression=None), 0, 0
                    payload = html.encode()
                    kind = "response" if original is None or original == page_id else "revisit"
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    digest = base32_sha1(hashlib.sha1(payload))
                    pieces = [member.compress(_head(page_id, url, kind, original, len(payload), digest))]
                    if kind == "response":
                        view = memoryview(payload)
                        for at in range(0, len(payload), CHUNK):
                            pieces.append(member.compress(view[at : at + CHUNK]))
                    pieces += [member.compress(b"\r\n\r\n"), member.flush()]
                    for p in pieces:
                        out.write(p)
                        size += len(p)
                    records += 1
                    if size >= archive_bytes:
                        yield close()
        if out is not None:
            yield close()

    return saved(_originals(pages, least_bytes).mapInArrow(run, ARCHIVES), "archives")


class _Stream:
    """Bytes of an archive, unpacked as they are asked for."""

    def __init__(self, file):
        self.file, self.member, self.data = file, None, bytearray()

    def _fill(self) -> bool:
        if self.member is None or self.member.eof:
            rest = self.member.unused_data if self.member else b""
            rest = rest or self.file.read(CHUNK)
            if not rest:
                return False
            self.member = zlib.decompressobj(31)
            self.data += self.member.decompress(rest, CHUNK)
            return True
        rest = self.member.unconsumed_tail or self.file.read(CHUNK)
        if not rest and not self.member.eof:
            raise ValueError("the archive ends within a record")
        self.data += self.member.decompress(rest, CHUNK)
        return True

    def line(self) -> bytes | None:
        while (end := self.data.find(b"\r\n")) < 0:
            if not self._fill():
                return None
        out = bytes(self.data[:end])
        del self.data[: end + 2]
        return out

    def upto(self, n: int) -> bytes:
        """At least one byte and at most n."""
        while not self.data:
            if not self._fill():
                raise ValueError("the archive ends within a record")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def headers(self) -> dict[str, str] | None:
        first = self.line()
        if first is None:
            return None
        out = {"": first.decode()}
        while line := self.line():
            name, _, value = line.decode().partition(": ")
            out[name] = value
        return out


def chunks_of(file, chunk: int = CHUNK):
    """Rows of CHUNKS of an archive; the digest of each is that of the payload up to
    its end.  A record's last row is checked against the record's own digest."""
    stream = _Stream(file)
    while (head := stream.headers()) is not None:
        http = stream.headers()
        page, refers = head.get("Page-ID"), head.get("Refers-To-Page-ID")
        url, stated = head.get("WARC-Target-URI"), head["WARC-Payload-Digest"].removeprefix("sha1:")
        row = (
            int(page) if page is not None else None, head["WARC-Record-ID"], head["WARC-Type"],
            int(refers) if refers is not None else None, None if url is None else _text(url),
        )
        size, done, number = int(http["Content-Length"]), 0, 0
        if head["WARC-Type"] == "revisit":
            yield (*row, 0, None, size, stated, True)
        else:
            state, data = hashlib.sha1(), b""
            while True:
                while len(data) < chunk and done + len(data) < size:
                    data += stream.upto(min(chunk - len(data), size - done - len(data)))
                state.update(data)
                done += len(data)
                digest = base32_sha1(state)
                if done == size and digest != stated:
                    raise ValueError(f"record {row[1]} has another digest than it states")
                yield (*row, number, data, done, digest, done == size)
                if done == size:
                    break
                data, number = b"", number + 1
        if stream.line() != b"" or stream.line() != b"":
            raise ValueError(f"record {row[1]} has no end")


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The chunk table of archives, in order within each record; without `payload`
    the bytes are left out, and each row has its digest and size all the same."""
    arrow = arrow_schema(CHUNKS)

    def run(batches):
        give_back()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = open_store(path)
                rows, held = [], 0
                with store.open_input_stream(inner, compression=None) as file:
                    for row in chunks_of(file):
                        held += len(row[6] or b"") if payload else 0
                        rows.append(row if payload else (*row[:6], None, *row[7:]))
                        if held >= 16 * CHUNK or len(rows) >= 1000:
                            yield batch_of(arrow, rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(arrow, rows)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(run, CHUNKS)
