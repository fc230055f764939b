"""Web archives: WARC files of compressed records, and an index of their captures in two levels.

``write_archives`` writes one file per partition, a gzip member per record, and a table of captures. Of records with
equal payloads the one with the largest page id is a response, the others revisit it. ``build_index`` sorts captures
by the reversed-host key of their address into compressed blocks and keeps a sparse directory: the first key and the
place of each block. ``look_up`` finds the file of an address by the files' first keys, binary-searches the file's
directory, and reads the one block by its range. ``read_archives`` reads whole files record by record, ``read_ranges``
single records.

Files go through ``pyarrow.fs`` to the folder that all executors share. A file's name holds a random part and only
names that a finished task returned are used, so repeated or lost tasks leave no wrong records.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from redpencil.session import materialize, new_path

LINES_PER_BLOCK = 500
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
#: One archive file holds about this many payload bytes.
FILE_BYTES = 64_000_000
CAPTURES = "page_id long, url string, key string, digest string, record_type string, file string, offset long, length long"


def surt(url: str | None) -> str:
    """The reversed-host key of an address: ``com,example,www)/path?query``; an address without host is its path."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")/" + (url or "")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")"
    return key + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: tuple[int, str | None] | None) -> bytes:
    """A WARC record: a response with its payload, or without one as a revisit of ``original``, id and address."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if original else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {json.dumps(url)[1:-1] if url is not None else ''}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if original:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{original[0]}>", f"WARC-Refers-To-Target-URI: {json.dumps(original[1])[1:-1] if original[1] is not None else ''}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[:int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def page_of(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:"):-1]
    return int(number) if number.lstrip("-").isdigit() else None


def _text(header: str | None) -> str | None:
    return json.loads(f'"{header}"') if header else None


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per page below ``folder`` and return the captures, one row per record.

    A null payload is empty. Repeated rows get a record each; rows that share id and payload with the response are
    responses too. A null id is never another record's response; a null address is empty.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    first = rows.groupBy("sha1").agg(F.max("page_id").alias("of"), F.max_by("url", "page_id").alias("of_url"))
    rows = rows.join(first, "sha1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for row in batch.to_pylist():
                if out is None or out.tell() > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                revisit = row["of"] is not None and row["page_id"] != row["of"]
                digest = base64.b32encode(row["sha1"]).decode()
                data = gzip.compress(record(row["page_id"], row["url"], row["payload"], digest,
                                            (row["of"], row["of_url"]) if revisit else None), LEVEL, mtime=0)
                values = (row["page_id"], row["url"], surt(row["url"]), digest, "revisit" if revisit else "response", name, out.tell(), len(data))
                out.write(data)
                for column, value in zip(columns, values):
                    column.append(value)
            if columns[0]:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in CAPTURES.split(", ")])
        if out is not None:
            out.close()
    return materialize(rows.select("page_id", "url", "payload", "sha1", "of", "of_url").mapInArrow(run, CAPTURES), "captures")


INDEX_FILES = "file string, first_key string, first_page long, last_key string, last_page long, directory long, directory_length long"


def _order(key: str, page: int | None) -> tuple[bytes, bool, int]:
    """The order of captures in the index: as Spark sorts, by UTF-8 bytes and nulls first."""
    return key.encode(), page is not None, page or 0


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted captures as compressed blocks with their directories; one row per index file.

    ``file, first_key, first_page, last_key, last_page, directory, directory_length``: the directory lies at the end of
    the file, as a compressed list of ``[first key, its page, offset, length]``. An address of many captures so has
    many entries, and a wanted one is in few blocks.
    """
    lines = captures.select("key", "page_id", "file", "offset", "length", "digest", "record_type")
    lines = lines.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, directory, out, last = [], [], None, None

        def flush() -> None:
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            directory.append([held[0][0], held[0][1], out.tell(), len(data)])
            out.write(data)
            held.clear()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{folder}/index-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.cdx.z"
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                held.append(row)
                last = row[:2]
                if len(held) == LINES_PER_BLOCK:
                    flush()
        if out is not None:
            if held:
                flush()
            at, data = out.tell(), zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_pylist([{
                "file": name, "first_key": directory[0][0], "first_page": directory[0][1], "last_key": last[0], "last_page": last[1],
                "directory": at, "directory_length": len(data)}])
    return materialize(lines.mapInArrow(run, INDEX_FILES), "index-files")


def look_up(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``key, page_id, file, offset, length`` of the wanted ``key, page_id`` that the index has.

    Every wanted row goes to the index files whose range of captures holds it; a task opens a file's directory once,
    searches it by key and page, and reads a block once for neighbouring captures.
    """
    # one short row per index file, of which there are as many as shuffle partitions
    files = sorted((_order(r.first_key, r.first_page), _order(r.last_key, r.last_page), r.file, r.directory, r.directory_length)
                   for r in index.collect())
    firsts = [x[0] for x in files]
    names = ["key", "page_id", "index", "directory", "directory_length"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist()):
                own = _order(key, page)
                k = bisect.bisect_right(firsts, own) - 1
                while k >= 0 and files[k][1] >= own:     # equal captures can begin in one file and go on in the next
                    rows.append((key, page, *files[k][2:]))
                    k -= 1
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    near = wanted.select("key", "page_id").mapInArrow(assign, "key string, page_id long, index string, directory long, directory_length long")
    near = near.repartition(max(1, len(files)), "index").sortWithinPartitions("index", "key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, keys, directory, file, at, block = None, [], [], None, None, {}
        for batch in batches:
            found = []
            for key, page, index_name, start, length in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "index", "directory", "directory_length"))):
                if index_name != name:
                    system, path = _open(index_name)
                    name, file, at = index_name, system.open_input_file(path), None
                    file.seek(start)
                    directory = json.loads(zlib.decompress(file.read(length)))
                    keys = [_order(*x[:2]) for x in directory]
                # the block before the first one that begins with the capture may end with it
                own = _order(key, page)
                k = max(bisect.bisect_left(keys, own) - 1, 0)
                while k < len(keys) and keys[k] <= own:
                    if at != k:
                        file.seek(directory[k][2])
                        at, block = k, {}
                        for line in zlib.decompress(file.read(directory[k][3])).decode().split("\n"):
                            x = json.loads(line)
                            block.setdefault((x[0], x[1]), []).append(x)
                    found += [{"key": key, "page_id": page, "file": x[2], "offset": x[3], "length": x[4]}
                              for x in block.get((key, page), []) if x[6] == "response"]
                    k += 1
            if found:
                yield pa.RecordBatch.from_pylist(found)
    return near.mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def _described(headers: dict[str, str], payload: bytes) -> dict:
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and sha1_base32(payload) != digest:
        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    return {"page_id": page_of(headers["warc-record-id"]), "url": _text(headers["warc-target-uri"]), "record_type": kind,
            "payload_digest": digest, "payload": payload if kind == "response" else None,
            "refers_to": page_of(headers.get("warc-refers-to")), "refers_to_key": surt(_text(headers.get("warc-refers-to-target-uri"))) if kind == "revisit" else None}


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                     ("payload", pa.binary()), ("refers_to", pa.int64()), ("refers_to_key", pa.string())])
RECORDS_SQL = ("page_id long, url string, record_type string, payload_digest string, payload binary, refers_to long, "
               "refers_to_key string")


def read_archives(files: DataFrame) -> DataFrame:
    """The records of the files in column ``file``, in one pass over each; revisits have no payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = _open(name)
                with system.open_input_stream(path, compression=None) as file:
                    held, size = [], 0
                    for data in members(file):
                        held.append(_described(*parse(data)))
                        size += len(data)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(held, RECORDS)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, RECORDS)
    return files.select("file").mapInArrow(run, RECORDS_SQL)


def members(file) -> Iterator[bytes]:
    """The unpacked gzip members of a stream."""
    left, end = b"", False
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not left:
                left = file.read(1 << 20)
                if not left:
                    if out:
                        raise ValueError("archive ends within a record")
                    return
            out.append(unpack.decompress(left))
            left = unpack.unused_data
        yield b"".join(out)


def read_ranges(places: DataFrame) -> DataFrame:
    """The single records at ``file, offset, length``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            held = []
            for own, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if own != name:
                    system, path = _open(own)
                    name, file = own, system.open_input_file(path)
                file.seek(offset)
                held.append(_described(*parse(gzip.decompress(file.read(length)))))
                if len(held) == 500:
                    yield pa.RecordBatch.from_pylist(held, RECORDS)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, RECORDS)
    return places.select("file", "offset", "length").mapInArrow(run, RECORDS_SQL)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back from archives just written.

    A revisit's payload is that of its response, found through the index and read by its range, once for all revisits.
    """
    folder = new_path(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/archive", page_id, url, html)
    index = build_index(captures, f"{folder}/index")
    # a task for each archive: their names say nothing of their sizes
    files = captures.select("file").distinct()
    archives = max(1, files.count())
    read = materialize(read_archives(files.repartitionByRange(archives, "file")).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        "refers_to_key"), "records")
    wanted = read.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), F.col("refers_to_key").alias("key")).distinct()
    places = look_up(wanted, index)
    originals = read_ranges(places.repartition(archives, "file").sortWithinPartitions("file", "offset"))
    sizes = originals.groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest")).agg(
        F.max(F.octet_length("payload")).cast("long").alias("of_bytes"))
    full = read.join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    return full.select("page_id", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
