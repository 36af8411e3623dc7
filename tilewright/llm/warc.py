"""WARC archives: one gzip member per record, written by tasks to shared storage and read back record by record."""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.scratch import new_folder, small_batches, stored

ARCHIVE_BYTES = 64 << 20
READ_BYTES = STEP_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
ENTRY = "archive string, offset long, stored_bytes long, page_id string, record_type string"
RECORD = "archive string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit holds the response's HTTP header, whose Content-Length is that of the
    full payload, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


class Members:
    """The gzip members of a stream, each decompressed step by step as its reader asks for bytes."""

    def __init__(self, stream: io.RawIOBase) -> None:
        self.stream, self.left, self.at = stream, b"", 0

    def __iter__(self) -> Iterator[tuple[int, Member]]:
        while self.left or self._more():
            member = Member(self)
            yield self.at, member
            member.skip()
            self.at += member.taken

    def _more(self) -> bool:
        self.left = self.stream.read(READ_BYTES)
        return bool(self.left)


class Member:
    def __init__(self, members: Members) -> None:
        self.members, self.inflate, self.held, self.taken, self.more = members, zlib.decompressobj(31), bytearray(), 0, False

    def _fill(self) -> bool:
        """Decompresses at most STEP_BYTES more; False at the member's end."""
        if self.inflate.eof:
            return False
        if not self.more and not self.members.left and not self.members._more():
            raise ValueError("the archive ends within a record")
        before = len(self.members.left)
        out = self.inflate.decompress(self.members.left, STEP_BYTES)
        self.more = len(out) == STEP_BYTES  # zlib may hold back what is beyond, even with nothing left to read
        self.members.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.held += out
        self.taken += before - len(self.members.left)
        return True

    def until(self, mark: bytes) -> bytes:
        while (end := self.held.find(mark)) < 0:
            if not self._fill():
                raise ValueError("a record has no end of header")
        return self._take(end + len(mark))

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._fill():
                raise ValueError("a record is shorter than its Content-Length")
        return self._take(n)

    def skip(self) -> None:
        while self._fill():
            self.held.clear()

    def _take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode("utf-8", "replace").rstrip("\r\n").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def _checked(data: bytes, stated: str | None, what: str, offset: int) -> str:
    """The base32 SHA-1 of data, which must be the stated one; digests of other kinds are not compared."""
    digest = base32_sha1(data)
    kind, _, value = (stated or "").partition(":")
    if kind.lower() == "sha1" and len(value) == len(digest) and value.upper() != digest:
        raise ValueError(f"{what} doesn't match its digest at {offset}")
    return digest


def read_records(stream: io.RawIOBase) -> Iterator[tuple]:
    """Records of any kind in order, as RECORD without its archive: framed by Content-Length, with the digests verified
    that they state (a revisit's payload digest is that of the full payload, which it doesn't hold). Records of HTTP
    messages have as payload what stands after the HTTP header, others their whole block. A revisit without a stated
    digest or length has null there; so have records without identifier or address."""
    for offset, member in Members(stream):
        version, head = headers(member.until(b"\r\n\r\n"))
        if not version.startswith("WARC/") or "content-length" not in head:
            raise ValueError(f"no WARC record at {offset}")
        block = member.exactly(int(head["content-length"]))
        if member.exactly(4) != b"\r\n\r\n":
            raise ValueError(f"a record's end is missing at {offset}")
        if "warc-block-digest" in head:
            _checked(block, head["warc-block-digest"], "a block", offset)
        kind, stated = head.get("warc-type"), head.get("warc-payload-digest")
        fields, payload = {}, block
        if head.get("content-type", "").startswith("application/http"):
            start, _, payload = block.partition(b"\r\n\r\n")
            fields = headers(start)[1]
        length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
        refers, record_id = head.get("warc-refers-to"), head.get("warc-record-id")
        if kind == "revisit":
            size, digest, payload = length, stated and stated.partition(":")[2], None
        else:
            if length is not None and kind == "response" and length != len(payload):
                raise ValueError(f"a payload doesn't match its length at {offset}")
            size, digest = len(payload), _checked(payload, None if "transfer-encoding" in fields else stated, "a payload", offset)
        yield offset, kind, record_id and record_id.strip("<>"), head.get("warc-target-uri"), refers and refers.strip("<>"), size, digest, payload


def record_urn(page_id: object) -> str:
    return f"urn:page:{page_id}"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record per row and returns the index of what was written (archive, offset, stored_bytes, page_id,
    record_type).

    Of rows with equal payloads of at least min_bytes bytes, that with the smallest id is the response and the others
    revisit it; all others are responses. Null html is the empty payload, a null url an empty one. Rows that repeat
    an identifier are one page if their payloads are equal: each is written as a response. A row without an
    identifier is a response that none refers to. Archives are named by stage, partition and attempt, and only those
    in the returned index count: a lost executor's half-written archive is never read. An empty table writes none.
    """
    from pyarrow import fs

    spark = pages.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "warc")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digests = stored(rows.select("page_id", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").alias("n")).where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()), "digests")
    firsts = stored(digests.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last"), "firsts")
    revisits = digests.join(firsts, ["digest", "n"]).where("page_id > first").select(F.col("page_id").alias("revisit_id"), F.col("first").alias("refers_to")).distinct()
    told = rows.join(revisits.hint("shuffle_hash"), F.col("page_id") == F.col("revisit_id"), "left").select(
        F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        context, k, out = TaskContext.get(), 0, None
        name = f"{base}/{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"
        try:
            for batch in batches:
                index = []
                for page_id, url, html, refers in batch.itertuples(index=False):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        at, archive = 0, f"{name}-{k}.warc.gz"
                        out, k = store.open_output_stream(archive, compression=None), k + 1
                    payload = html.encode("utf-8", "replace")
                    to = None if refers is None else record_urn(refers)
                    role = "revisit" if to else "response"
                    member = record_bytes(role, record_urn(page_id), " ".join(url.split()), payload, base32_sha1(payload), to)
                    out.write(member)
                    index.append((archive, at, len(member), page_id, role))
                    at += len(member)
                yield pd.DataFrame(index, columns=["archive", "offset", "stored_bytes", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    return stored(told.mapInPandas(write, ENTRY), "warc-index").withColumns({"page_id": F.col("page_id").cast(pages.schema[id_col].dataType), "folder": F.lit(folder)})


def read_archives(index: DataFrame) -> DataFrame:
    """The records (RECORD) of the archives named in the column archive, each archive read in order by one task."""
    from pyarrow import fs

    folder = (index.select("folder").first() or [""])[0]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
        for batch in batches:
            for archive in batch["archive"]:
                rows, held = [], 0
                with store.open_input_stream(archive, compression=None) as stream:
                    for record in read_records(stream):
                        rows.append((archive, *record))
                        held += len(record[-1] or b"") + 200
                        if held > READ_BYTES * 8:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    small_batches(index.sparkSession)
    archives = index.select("archive").distinct()
    tasks = max(1, archives.count())  # a number of its own: their names are so few bytes that all would become one task
    return archives.repartitionByRange(tasks, "archive").mapInPandas(read, RECORD)
