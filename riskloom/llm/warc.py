"""WARC archives with a Zstandard dictionary in front and one frame per record."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.keys import hash_of
from riskloom.sources.staging import new_path, stage

DICTIONARY_MAGIC = 0x184D2A5D  # fixed value: the skippable frame that holds the dictionary
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 65_536, 65_536
ARCHIVE_BYTES = 256 * 2**20
LEVEL = 3

FILES = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line: control characters and blanks as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record: a response, or a revisit of page ``first``, which has the HTTP header alone.

    The HTTP header states the length of the full payload in both.
    """
    name = "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_field(url) if url else f'urn:page:{name}'}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def _info(records: str) -> bytes:
    block = f"format: WARC File Format 1.1\r\nsoftware: {records}\r\n".encode()
    head = (
        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:warcinfo:{uuid.uuid5(uuid.NAMESPACE_URL, records)}>\r\n"
        f"WARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def build_dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of records of ``pages`` (page_id, url, payload).

    Built on the driver from ``SAMPLE_RECORDS`` records of payloads up to ``SAMPLE_BYTES``, those
    with the lowest hashes. Empty if there are too few to build one.
    """
    some = pages.where(F.octet_length("payload").between(1, SAMPLE_BYTES))
    place = hash_of(F.lit("dictionary"), F.col("page_id"), digits=8)
    # about four times as many as wanted leave their tasks, however many tasks there are
    some = some.where(place < min(1.0, 4 * SAMPLE_RECORDS / max(some.count(), 1)) * 16**8)
    some = some.orderBy(place, "page_id", F.xxhash64("payload")).limit(SAMPLE_RECORDS)
    samples = [record(r["page_id"], r["url"], bytes(r["payload"]), None) for r in some.select("page_id", "url", "payload").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop path and the path in it."""
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_archive(out: io.RawIOBase, records: Iterator[bytes], dictionary: bytes) -> Iterator[int]:
    """Write a dictionary frame and a frame for each record; yields the bytes so far after each."""
    done = 0
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if dictionary:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        done += 8 + len(packed)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
    for data in records:
        done += out.write(compressor.compress(data))
        yield done


def read_archive(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record. The dictionary, if there is one, is taken from the front."""
    start = data.read(8)
    known = None
    if len(start) == 8 and struct.unpack("<II", start)[0] == DICTIONARY_MAGIC:
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data.read(struct.unpack("<II", start)[1])))
    else:
        data.seek(0)
    reader = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data, read_across_frames=True)
    lines = io.BufferedReader(reader, 1 << 16)
    while True:
        version = lines.readline()
        if not version:
            return
        if version != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {version[:40]!r}")
        fields = {}
        while (line := lines.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = lines.read(int(fields["Content-Length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it says")
        yield fields, block


def _writer(folder: str, dictionary: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False))
        row = next(rows, None)
        system, base = _open(folder)
        system.create_dir(base)
        while row is not None:  # a new archive when the last one is full
            # an attempt that fails leaves a file that no list names
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            count = size = 0
            with system.open_output_stream(path, compression=None) as out:

                def records() -> Iterator[bytes]:
                    nonlocal row
                    yield _info("riskloom")
                    while row is not None and size < ARCHIVE_BYTES:
                        page = None if pd.isna(row.page_id) else int(row.page_id)
                        first = None if pd.isna(row.first) else int(row.first)
                        yield record(page, row.url, bytes(row.payload), first)
                        row = next(rows, None)

                for size in write_archive(out, records(), dictionary):
                    count += 1
            yield pd.DataFrame({"path": [f"{folder}/{path.rpartition('/')[2]}"], "records": [count - 1], "bytes": [size]})

    return run


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path in b["path"]:
            system, inner = _open(path)
            rows: list[tuple] = []
            with system.open_input_file(inner) as data:
                for fields, block in read_archive(data):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or digest(payload) != stated):
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} in {path} is not what its header says")
                    page, first = (
                        int(n) if (n := fields.get(f, "").removeprefix("<urn:page:").removesuffix(">")) else None
                        for f in ("WARC-Record-ID", "WARC-Refers-To")
                    )
                    rows.append((page, fields["WARC-Target-URI"], kind, first, length, stated))
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``folder``; the written table of archives: path, records, bytes.

    The payload is the html in UTF-8, empty for null. Of pages with equal payloads of at least
    ``least_bytes``, that with the smallest id is a response, the others revisit it; smaller
    payloads are all responses. Pages without an id come after those with one: they revisit a
    numbered page, or are all responses. Rows that repeat the id of a response are responses.

    A null url is replaced by a name from the id, control characters in it are escaped. Payloads are equal if
    their SHA-256 are. Each task streams its pages into archives of about ``ARCHIVE_BYTES``; joins on a payload that
    very many pages share are left to adaptive skew handling. Without pages there are no archives. Other columns are
    ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    dictionary = build_dictionary(rows)
    keyed = rows.withColumn("key", F.sha2("payload", 256))
    firsts = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("least"))
    first = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("least")), F.col("least"))
    decided = keyed.join(firsts, "key", "left_outer").select("page_id", "url", "payload", first.alias("first"))
    return stage(decided.mapInPandas(_writer(folder, dictionary), FILES), "warc-files")


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """The records of the archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest.

    An archive is read by one task, record by record; payloads of responses are checked against
    their digests.
    """
    files = archives.count()
    return archives.select("path").repartition(max(files, 1), "path").mapInPandas(_reader, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write the pages and read the archives back, see ``write`` and ``read``."""
    spark = pages.sparkSession
    return read(spark, write(pages, folder or new_path(spark, "warc"), least_bytes))
