"""WARC records in ZIP-packaged archives: a writer and a reader that works without extraction (operator 7).

An archive is a ZIP file of stored members: WARC files and their indexes. The reader parses the
end-of-directory record, its ZIP64 form, and the central directory, finds the stored members by their
names there, takes the records' places from the indexes (or from a scan of a WARC file that has none),
and reads each record by its range. Only directories, indexes and chunks of records are ever in memory.

The writer's archives hold archive/data.warc.gz, of one gzip member per record, and
indexes/index.jsonl. A null payload is empty. Of rows with equal payloads the smallest id is the
response and the others revisit it. Rows that repeat an id are written once each: one that repeats
the response's id and payload is a response too. Rows without an id are responses, and come back
without one. An empty table gives no archive and an empty result; extra columns are not read. A very
long payload closes the archive that it falls into.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches

#: Bytes from which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Bytes and records of a chunk that is read at once, and bytes read ahead from members without an index.
CHUNK_BYTES, CHUNK_RECORDS, AHEAD = 4 << 20, 1000, 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
WARC_NAMES, INDEX_NAMES = (".warc", ".warc.gz"), (".jsonl", ".cdxj", ".cdx", ".jsonl.gz", ".cdxj.gz", ".cdx.gz")
# Signatures and fixed sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
Read = Callable[[int, int], bytes]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 response or revisit record; ids and the payload's size are extension fields."""
    kind = "response" if refers_to is None else "revisit"
    identity = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}:{digest}')}>"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {identity(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {identity(refers_to)}", f"WARC-Refers-To-Target-URI: {refers_url}", f"X-Refers-To-Page-Id: {refers_to}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one record: what follows the HTTP header, or
    the whole block of a record without one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record does not end where its length says")
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; zip64 forces the 64-bit fields."""
    out, central, at = [], [], 0
    for name, data in members:
        wide = zip64 or len(data) >= MAX32 or at >= MAX32
        crc, key = zlib.crc32(data), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = MAX32 if wide else len(data)
        head = LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(key), len(extra)) + key + extra
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        central.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(key), len(extra), 0, 0, 0, 0, MAX32 if wide else at) + key + extra)
        out += [head, data]
        at += len(head) + len(data)
    directory = b"".join(central)
    end, n = b"", len(members)
    if zip64 or at >= MAX32 or n >= MAX16:
        end = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), at) + LOCATOR64 + struct.pack("<IQI", 0, at + len(directory), 1)
        last = END + struct.pack("<HHHHIIH", 0, 0, MAX16, MAX16, MAX32, MAX32, 0)
    else:
        last = END + struct.pack("<HHHHIIH", 0, 0, n, n, len(directory), at, 0)
    return b"".join([*out, directory, end, last])


def stored_members(read: Read, size: int) -> dict[str, tuple[int, int]]:
    """(offset, length) of the data of each stored member of an archive of `size` bytes, from the
    central directory; read(at, n) reads a range. A WARC file that is not stored is an error."""
    start = max(0, size - 22 - MAX16)
    tail = read(start, size - start)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    n, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if MAX16 == n or MAX32 in (length, offset):
        locator = read(start + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of the directory")
        n, length, offset = struct.unpack_from("<QQQ", end64, 32)
    directory, found, at = read(offset, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("no entry where the ZIP directory should have one")
        (method,) = struct.unpack_from("<H", directory, at + 10)
        packed, full, names, extras, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (begin,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode("utf-8", "replace")
        extra = directory[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            tag, width = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = next(wide) if full == MAX32 else full
                packed = next(wide) if packed == MAX32 else packed
                begin = next(wide) if begin == MAX32 else begin
            extra = extra[4 + width :]
        if method == 0:
            local = read(begin, 30)
            if local[:4] != LOCAL:
                raise ValueError("no local header where the ZIP directory says")
            a, b = struct.unpack_from("<HH", local, 26)
            found[name] = (begin + 30 + a + b, full)
        elif name.endswith(WARC_NAMES):
            raise ValueError(f"{name} is compressed by the archive, so its records have no ranges")
        at += 46 + names + extras + comment
    return found


def _pieces(read: Read, begin: int, length: int) -> Iterator[bytes]:
    for at in range(begin, begin + length, AHEAD):
        yield read(at, min(AHEAD, begin + length - at))


def _index_lines(read: Read, begin: int, length: int, packed: bool) -> Iterator[bytes]:
    unpack, rest = zlib.decompressobj(31), b""
    for piece in _pieces(read, begin, length):
        while piece:
            text = unpack.decompress(piece) if packed else piece
            piece = unpack.unused_data if packed else b""
            if piece:
                unpack = zlib.decompressobj(31)
            *lines, rest = (rest + text).split(b"\n")
            yield from lines
    yield rest


def _scanned(read: Read, begin: int, length: int, packed: bool) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of a WARC file without an index, which is read through once."""
    if packed:
        at, unpack, used = 0, zlib.decompressobj(31), 0
        for piece in _pieces(read, begin, length):
            while piece:
                unpack.decompress(piece)
                if not unpack.eof:
                    used += len(piece)
                    break
                used += len(piece) - len(unpack.unused_data)
                yield at, used
                piece, at, used, unpack = unpack.unused_data, at + used, 0, zlib.decompressobj(31)
        return
    at = 0
    while at < length:
        head = b""
        while b"\r\n\r\n" not in head and at + len(head) < length:
            head += read(begin + at + len(head), min(8192, length - at - len(head)))
        head = head.partition(b"\r\n\r\n")[0]
        n = re.search(rb"(?im)^content-length:\s*([0-9]+)", head)
        if not n:
            raise ValueError("a WARC record without a length")
        yield at, len(head) + 4 + int(n[1]) + 4
        at += len(head) + 4 + int(n[1]) + 4


def record_places(read: Read, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) in the archive of each record. Index lines are JSON, or end with it, and name
    an offset, a length and, where the archive has several WARC files, a filename."""
    members = stored_members(read, size)
    data = {name: place for name, place in members.items() if name.endswith(WARC_NAMES)}
    by_file = {name.rpartition("/")[2]: place for name, place in data.items()}
    indexed = set()
    for name, (begin, length) in members.items():
        if not name.endswith(INDEX_NAMES):
            continue
        for line in _index_lines(read, begin, length, name.endswith(".gz")):
            entry = json.loads(line[line.index(b"{") :]) if b"{" in line else {}
            file = entry.get("filename") or (next(iter(data)) if len(data) == 1 else None)
            place = data.get(file) or by_file.get(str(file).rpartition("/")[2])
            if place and "offset" in entry and "length" in entry:
                indexed.add(place)
                yield place[0] + int(entry["offset"]), int(entry["length"])
    for name, place in data.items():
        if place not in indexed:
            yield from ((place[0] + at, n) for at, n in _scanned(read, *place, name.endswith(".gz")))


def _reader(uri: str) -> tuple[Read, int]:
    """A range reader of a file that pyarrow can open (file, hdfs, s3, gs), and the file's size."""
    store, path = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    file = store.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        found = file.read(n)
        if len(found) != n:
            raise ValueError("an archive ends before a range of it")
        return found

    return read, file.size()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Write every row as a record into ZIP archives of one shared folder; gives (path, length) of each.

    Of rows with equal payloads of at least min_bytes, the smallest id is the response and the
    others revisit it. Only ids and digests are shuffled to find that; a digest that many rows share
    is counted in each task first, and its rows are split by the skew-join rule. A task's archives
    have names of their own and count only once folder/manifest lists them, which Spark commits, so
    what a lost or repeated task leaves is never read.
    """
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("key"))
    seen = rows.where(F.col("id").isNotNull() & (F.octet_length("payload") >= min_bytes)).select("id", "url", "key")
    firsts = seen.groupBy("key").agg(F.min(F.struct("id", "url")).alias("first"), F.max("id").alias("last")).where("last > first.id")
    again = seen.select("id", "key").join(firsts, "key").where("id <> first.id").groupBy("id", "key").agg(F.min("first").alias("first"))
    rows = rows.join(again, ["id", "key"], "left").select("id", "url", "payload", F.col("first.id").alias("refers_to"), F.col("first.url").alias("refers_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
        data, index, at = [], [], 0

        def archive() -> pa.RecordBatch:
            whole = zip_stored([(DATA, b"".join(data)), (INDEX, "".join(json.dumps(x) + "\n" for x in index).encode())], zip64)
            name = f"pages-{uuid.uuid4().hex}.zip"
            store.create_dir(f"{path}/archives", recursive=True)
            with store.open_output_stream(f"{path}/archives/{name}") as out:
                out.write(whole)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/archives/{name}"]), pa.array([len(whole)])], names=["path", "length"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to, refers_url = (batch.column(k)[i].as_py() for k in range(5))
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                url, refers_url = re.sub(r"[\r\n]", "", url), re.sub(r"[\r\n]", "", refers_url or "")
                raw = pack.compress(record(page_id, url, payload, base32_sha1(payload), refers_to, refers_url)) + pack.flush()
                data.append(raw)
                index.append({"url": url, "offset": at, "length": len(raw)})
                at += len(raw)
                if at >= archive_bytes:
                    yield archive()
                    data, index, at = [], [], 0
        if data:
            yield archive()

    map_batches(rows, run, "path string, length long").write.mode("append").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of every .zip file under a folder, whoever wrote it; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, intact, payload) of each
    record of the archives (path).

    A response's size and digest are those of the payload it holds, and intact tells whether its
    header gives the same digest (null if it gives none); a revisit's are its header's, and it has no
    payload. page_id and refers_to are null in records without the writer's fields. Archives are
    opened for their record places first, which are dealt out in chunks of bounded size, so that one
    large archive is read by many tasks.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found, held = [], 0

                def chunk(path: str, found: list) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[x[0] for x in found]], pa.list_(pa.int64())), pa.array([[x[1] for x in found]], pa.list_(pa.int64()))], names=["path", "at", "n"])

                for place in record_places(*_reader(path)):
                    found.append(place)
                    held += place[1]
                    if held >= CHUNK_BYTES or len(found) >= CHUNK_RECORDS:
                        yield chunk(path, found)
                        found, held = [], 0
                if found:
                    yield chunk(path, found)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "intact", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def parsed(raw: bytes) -> tuple:
        fields, payload = parse_record(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
        number = lambda name: int(fields[name]) if name in fields else None
        stated = fields.get("warc-payload-digest", "")
        stated = stated[5:] if stated.startswith("sha1:") else None
        kind = fields.get("warc-type")
        if kind == "revisit":
            return number("x-page-id"), fields.get("warc-target-uri"), kind, number("x-payload-length"), stated, number("x-refers-to-page-id"), None, None
        digest = base32_sha1(payload)
        return number("x-page-id"), fields.get("warc-target-uri"), kind, len(payload), digest, None, None if stated is None else stated == digest, payload

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                read, _ = _reader(batch.column(0)[i].as_py())
                at, n = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if all(x + y == z for x, y, z in zip(at, n, at[1:], strict=False)):  # one range
                    whole = read(at[0], sum(n))
                    rows = [parsed(whole[x - at[0] : x - at[0] + y]) for x, y in zip(at, n, strict=True)]
                else:
                    rows = [parsed(read(x, y)) for x, y in zip(at, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes, much work
    chunks = map_batches(archives.select("path").repartition(tasks, "path"), places, "path string, at array<long>, n array<long>")
    dealt = chunks.repartition(tasks, "path", F.element_at("at", 1))
    return map_batches(dealt, records, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean, payload binary")
