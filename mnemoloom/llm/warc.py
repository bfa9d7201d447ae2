"""WARC archives in Zstandard with a dictionary: writer, and a reader that trusts nothing.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; one frame for each record follows.
Writing: equal payloads share one response record, that of the least page id; the others become revisit records that
refer to it. A task writes archives of at most ``ROLL`` bytes, each under a name of its own, and returns a manifest row
once the file is complete; a lost or repeated task leaves files that no manifest names. The manifest is written before
anything reads it. Files go through pyarrow's file systems to the folder the cluster shares.
Reading: archives come by the manifest, or from Spark's binaryFile source, which reaches any store; each frame is decoded on its own, and version
line, mandatory headers, lengths, digests and the closing line feeds are validated; a faulty archive raises.

Which page answers for which payload comes from (id, digest) rows alone; the table of payloads that occur more than once is
broadcast if it has at most ``BROADCAST_ROWS`` rows, and payloads don't shuffle. Beyond that the pages are joined to it by
digest and salt, so that a payload on very many pages is dealt out to ``SALTS`` tasks.

Defined cases: a null payload is empty; a very long one is a record of up to ``MAX_RECORD`` bytes; null page ids are last in order and keep their rows; rows that repeat the least
page id of their payload are all responses; payloads below ``min_payload`` bytes are all responses; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.batches import by_bytes
from mnemoloom.session import remove_at_exit, shared_dir, stash

MAGIC = 0x184D2A5D
#: Bytes after which a task starts another archive; payloads and bytes from which a task trains its dictionary.
ROLL, TRAIN_PAYLOADS, TRAIN_BYTES, DICT_BYTES = 16 << 20, 128, 1 << 20, 16 << 10
BROADCAST_ROWS, SALTS = 500_000, 64
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: The most bytes that one record may unpack to, and compressed bytes that the decoder is fed at a time.
MAX_RECORD, FEED = 1 << 30, 2048


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(none|-?\d+)>", name)
    if not found:
        raise ValueError(f"no page id in {name!r}")
    return None if found[1] == "none" else int(found[1])


def _line(text: str | None) -> str:
    """``text`` fit for a header: no control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", " ", text or "").strip()


def build_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, which tells the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, payload length and digest of one record; ValueError if anything is amiss."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"malformed header {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [h for h in MANDATORY if h.lower() not in headers]:
        raise ValueError(f"missing headers {missing}")
    if not headers["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block has {len(rest) - 4} bytes, Content-Length says {size}")
    block = rest[:size]
    if (told := headers.get("warc-block-digest")) and told != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^content-length:\s*(\d+)\s*$", http.replace(b"\r\n", b"\n"))
    if not sep or not length:
        raise ValueError("no HTTP header with a length")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind == "response":
        if len(payload) != int(length[1]) or digest != f"sha1:{base32_sha1(payload)}":
            raise ValueError("payload differs from its length or digest")
    elif kind == "revisit":
        if payload or headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers or not digest.startswith("sha1:"):
            raise ValueError("malformed revisit")
    else:
        raise ValueError(f"unexpected record type {kind}")
    return {
        "page_id": page_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri", ""), "record_type": kind,
        "payload_bytes": int(length[1]), "payload_digest": digest[5:], "payload": payload if kind == "response" else None,
        "refers_to": page_of(headers["warc-refers-to"]) if kind == "revisit" else None,
    }


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(data)) + data


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive, frame by frame."""
    at, decompressor = 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise ValueError("dictionary frame is cut off")
        held = data[8 : 8 + size]
        if held[:4] == struct.pack("<I", 0xFD2FB528):  # the dictionary may itself be compressed
            held = zstandard.ZstdDecompressor().decompress(held, max_output_size=MAX_RECORD)
        if held:
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        at = 8 + size
    view = memoryview(data)
    while at < len(data):
        record, at = _frame(decompressor, view, at)
        yield parse_record(record)


def _frame(decompressor: zstandard.ZstdDecompressor, view: memoryview, at: int) -> tuple[bytes, int]:
    """(content, end) of the frame that begins at ``at``; fed in small steps, so that little is copied and its growth is seen early."""
    begin, frame, parts, size = at, decompressor.decompressobj(), [], 0
    while not frame.eof:
        if at >= len(view):
            raise ValueError(f"frame at {begin} is cut off")
        try:
            parts.append(frame.decompress(view[at : at + FEED]))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame at {begin}: {e}") from e
        at = min(at + FEED, len(view))
        if (size := size + len(parts[-1])) > MAX_RECORD:
            raise ValueError(f"frame at {begin} unpacks to more than {MAX_RECORD} bytes")
    return b"".join(parts), at - len(frame.unused_data)


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary from a few payloads; empty if they are too few or too small to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, payloads).as_bytes() if len(payloads) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Archives in ``folder``, rolled at ``roll`` bytes. Yields a manifest row from each finished one."""

    def __init__(self, folder: str, roll: int = ROLL):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.roll, self.out = folder, roll, None
        self.dictionary, self.compressor = None, None

    def begin(self, payloads: list[bytes]) -> None:
        self.dictionary = train_dictionary(payloads)
        extra = {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, **extra)

    def add(self, record: bytes) -> Iterator[tuple[str, int, int]]:
        if self.out is None:
            self.name, self.size, self.records = f"{uuid.uuid4().hex}.warc.zst", 0, 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self._put(dictionary_frame(self.dictionary))
        self._put(self.compressor.compress(record))
        self.records += 1
        if self.size >= self.roll:
            yield from self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> Iterator[tuple[str, int, int]]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield f"{self.folder}/{self.name}", self.size, self.records


def first_of_payload(pages: DataFrame, key: str, payload: Column, min_payload: int) -> DataFrame:
    """(digest, first) of the payloads that occur more than once."""
    rows = pages.select(F.col(key).alias("k"), payload.cast("binary").alias("p")).where(F.length("p") >= min_payload)
    counted = rows.select("k", F.sha2("p", 256).alias("digest")).groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").select("digest", "first")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_payload: int = 0, roll: int = ROLL) -> DataFrame:
    """Write a record for every row; the manifest (path, bytes, records) of complete archives."""
    from pyarrow import fs

    payload = F.coalesce(F.col(html), F.lit(""))
    twice = stash(first_of_payload(pages, key, payload, min_payload), "payloads")
    small = twice.count() <= BROADCAST_ROWS
    rows = pages.select(F.col(key).cast("bigint").alias("k"), F.col(url).alias("u"), payload.cast("binary").alias("p"))
    rows = rows.withColumn("digest", F.when(F.length("p") >= min_payload, F.sha2("p", 256)))
    if small:
        joined = rows.join(F.broadcast(twice), "digest", "left")
    else:
        salted = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    again = F.col("digest").isNotNull() & F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    ready = joined.select(F.col("k").cast("string").alias("k"), "u", "p", F.when(again, F.col("first")).cast("string").alias("first"), again.alias("again"))
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    remove_at_exit(pages.sparkSession, folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = ArchiveWriter(folder, roll)
        number = lambda x: None if x is None else int(x)
        for frame in frames:
            if writer.dictionary is None and len(frame):
                sample, total = [], 0
                for data in frame["p"].head(TRAIN_PAYLOADS):
                    if total + len(data) <= TRAIN_BYTES:
                        sample.append(bytes(data))
                        total += len(data)
                writer.begin(sample)
            done = []
            for k, u, p, first, is_again in zip(frame["k"], frame["u"], frame["p"], frame["first"], frame["again"]):
                done += writer.add(build_record(number(k), u, bytes(p), number(first), bool(is_again)))
            yield pd.DataFrame(done, columns=["path", "bytes", "records"])
        yield pd.DataFrame(list(writer.close()), columns=["path", "bytes", "records"])

    return stash(by_bytes(ready).mapInPandas(run, "path string, bytes bigint, records bigint"), "manifest")


RECORDS = "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"


def _records(contents) -> Iterator:
    """Arrow batches of the records in ``contents``, one archive after the other."""
    import pyarrow as pa

    names, kinds = zip(*[c.split() for c in RECORDS.split(", ")])
    schema = pa.schema([(n, pa.int64() if k == "bigint" else pa.string()) for n, k in zip(names, kinds)])
    text = lambda x: None if x is None else str(x)
    for data in contents:
        columns: dict[str, list] = {n: [] for n in names}
        for r in read_archive(data):
            for n in names:
                columns[n].append(text(r[n]) if n in ("page_id", "refers_to") else r[n])
        yield pa.RecordBatch.from_pydict(columns, schema=schema)


def _typed(records: DataFrame) -> DataFrame:
    return records.withColumn("page_id", F.col("page_id").cast("bigint")).withColumn("refers_to", F.col("refers_to").cast("bigint"))


def read_archives(archives: DataFrame) -> DataFrame:
    """The records in ``archives``, rows of Spark's binaryFile source, without their payloads."""
    run = lambda batches: _records(c.as_buffer() for batch in batches for c in batch.column(0))
    return _typed(archives.select("content").mapInArrow(run, RECORDS))


def read_manifest(manifest: DataFrame, task_bytes: int = 4 * ROLL) -> DataFrame:
    """The records of the archives that ``manifest`` names, read where the files are; contents never shuffle."""

    def run(batches):
        from pyarrow import fs

        def contents():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    system, at = fs.FileSystem.from_uri(path)
                    with system.open_input_stream(at, compression=None) as f:
                        yield f.read()

        return _records(contents())

    total = manifest.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    tasks = max(1, min(total[1], max(manifest.sparkSession.sparkContext.defaultParallelism, -(-(total[0] or 0) // task_bytes))))
    return _typed(manifest.select("path").repartition(tasks).mapInArrow(run, RECORDS))


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write all ``pages``, read the archives that the manifest names."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file:///{folder.lstrip('/').removeprefix('file:').lstrip('/')}"
    manifest = write_archives(pages, folder, min_payload=min_payload)
    return read_manifest(manifest)
