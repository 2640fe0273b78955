"""WARC records in ZIP packages: a writer, and a reader that fetches ranges.

Package.  A ZIP file whose members are stored, not deflated: WARC files
(``archive/*.warc.gz``, one gzip member a record) and an index (``indexes/index.cdxj``)
that gives member, offset and length of each record.

Reader.  The end of a package names its central directory (through the ZIP64 records
where numbers are too large for the plain ones); the directory names the members, a
member's local header says where its bytes start, and since they are stored, an index
entry is a byte range of the package itself.  So a task fetches the ranges of its
records, neighbouring ones together, and nothing is extracted.  WARC members that no index
names are walked record by record.

Packages are opened with ``pyarrow.fs``, by path or URI; they live in a folder that
all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import keep, read
from postlens.session import checkpoint_root

#: Bytes after which a member, and a package, is closed and a new one begun.
MEMBER_BYTES, PACKAGE_BYTES = 64 << 20, 256 << 20
#: Bytes fetched at once, and the widest gap between records fetched together.
FETCH_BYTES, GAP_BYTES = 4 << 20, 64 << 10
#: Bytes of a package that one reading task is dealt at a time, and of a task's share in all.
BLOCK_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: Parts that the copies of one payload are dealt over.
SALT = 16
PACKAGE_SCHEMA = "path string, bytes long, n_records long"
RANGE_SCHEMA = "path string, member string, start long, length long, whole boolean"
RECORD_SCHEMA = ("path string, member string, start long, page_id long, record_type string, target_uri string, "
                 "payload_bytes long, payload_digest string, refers_to long, intact boolean, payload binary")
#: Fixed values of the ZIP format: signatures and layouts of its records.
END, LOCATOR, END64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"
END_LAYOUT, LOCATOR_LAYOUT, END64_LAYOUT = "<4s4H2LH", "<4sLQL", "<4sQ2H2L4Q"
ENTRY_LAYOUT, LOCAL_LAYOUT = "<4s6H3L5H2L", "<4s5H3L2H"
ZIP64_EXTRA, FULL = 1, 0xFFFFFFFF


# --- records -------------------------------------------------------------------------

def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def page_of(name: str | None) -> int | None:
    """The page id in a record name, None if it has none."""
    part = (name or "").strip("<>").split(":")
    return int(part[2]) if part[:2] == ["urn", "page"] and part[2] else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: bool,
                refers_to: int | None, own: str, date: str) -> bytes:
    """A response record with the payload, or a revisit record with its HTTP headers only."""
    name = record_name(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    # a URI holds printable ASCII only
    head = {"WARC-Type": "response" if response else "revisit",
            "WARC-Record-ID": f"<{name}>" if response else f"<{name}:{own}>",
            "WARC-Date": date, "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else name,
            "WARC-Payload-Digest": f"sha1:{digest}",
            "WARC-Block-Digest": f"sha1:{bare_digest(block)}"}
    if not response:
        head |= {"WARC-Refers-To": f"<{record_name(refers_to, digest)}>",
                 "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Named fields below a first line, names in lower case."""
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def parsed(record: bytes) -> dict | None:
    """What the result rows say about a record; None for records that carry no page."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = headers(head)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    told = int(headers(http).get("content-length", len(payload)))
    whole = kind == "response"
    return {"page_id": page_of(fields["warc-record-id"]), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
            "payload_bytes": len(payload) if whole else told, "payload_digest": digest,
            "refers_to": None if whole else page_of(fields.get("warc-refers-to")),
            "intact": f"sha1:{bare_digest(block)}" == fields.get("warc-block-digest", f"sha1:{bare_digest(block)}")
            and (not whole or (told == len(payload) and bare_digest(payload) == digest)),
            "payload": payload if whole else None}


# --- writing -------------------------------------------------------------------------

def index_key(url: str) -> str:
    """Host parts from the right, then the path: neighbouring pages sort together."""
    try:
        host = urlsplit(url).hostname or ""
    except ValueError:
        host = ""
    return (",".join(reversed(host.split("."))) + ")" + quote(url.partition("//")[2].partition("/")[2])).replace(" ", "%20")


class Package:
    """A ZIP package in the making.  Records go straight to the file; the index lines are
    held until the package is closed."""

    def __init__(self, folder: str, member_bytes: int, level: int, date: str):
        self.name = uuid.uuid4().hex
        self.path, self.level, self.date, self.member_bytes = f"{folder}/pages-{self.name}.zip", level, date, member_bytes
        fs, place = FileSystem.from_uri(self.path)
        self.file = fs.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.lines, self.n, self.members = None, [], 0, 0
        self.at = 0

    def put(self, record: bytes) -> tuple[str, int, int]:
        if self.member is None or self.at >= self.member_bytes:
            if self.member:
                self.member.close()
            self.file_name = f"data-{self.members:05d}.warc.gz"
            self.member = self.zip.open(zipfile.ZipInfo(f"archive/{self.file_name}"), "w", force_zip64=True)
            self.members, self.at = self.members + 1, 0
            text = b"format: WARC File Format 1.1\r\n"
            info = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
                    f"WARC-Date: {self.date}\r\nContent-Type: application/warc-fields\r\n"
                    f"Content-Length: {len(text)}\r\n\r\n").encode() + text + b"\r\n\r\n"
            self.append(info)
        return self.append(record)

    def append(self, record: bytes) -> tuple[str, int, int]:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = z.compress(record) + z.flush()
        self.member.write(data)
        self.at += len(data)
        return self.file_name, self.at - len(data), len(data)

    def add(self, page_id, url, payload: bytes, response: bool, refers_to) -> None:
        digest = bare_digest(payload)
        record = warc_record(page_id, url, payload, digest, response, refers_to, f"{self.name}.{self.n}", self.date)
        name, offset, length = self.put(record)
        self.n += 1
        fields = {"url": url, "mime": "text/html" if response else "warc/revisit", "status": "200", "digest": f"sha1:{digest}",
                  "length": str(length), "offset": str(offset), "filename": name}
        stamp = "".join(c for c in self.date if c.isdigit())
        self.lines.append(f"{index_key(url or record_name(page_id, digest))} {stamp} {json.dumps(fields)}\n")

    def size(self) -> int:
        return self.file.tell()

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo("indexes/index.cdxj"), "w", force_zip64=True) as index:
            for line in sorted(self.lines):
                index.write(line.encode())
        self.zip.close()
        size = self.file.tell()
        self.file.close()
        return self.path, size, self.n


def write_packages(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", member_bytes: int = MEMBER_BYTES, package_bytes: int = PACKAGE_BYTES,
                   level: int = 6) -> DataFrame:
    """Write a WARC record for each page into ZIP packages in ``folder`` (a path or URI that all
    executors share) and return the packages: path, bytes, n_records.

    Payload: the html in UTF-8 (null: empty).  Of the records with one payload of at least ``least``
    bytes that with the largest page id is a response and the others are revisits of it; rows that
    repeat this id and payload are responses too, and where no row of a group has an id all are.
    Shorter payloads are all responses.  A null id is less than any other.  An empty table writes
    nothing and returns no rows.

    Every package has a name of its own and the returned table, written when all tasks have
    ended, names those of successful tasks only, so a lost executor's half-written file is
    never read.  Groups are found by an aggregate of digests; the pages are dealt once, each payload's
    copies over ``SALT`` parts, to the tasks that write them.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")) \
        .withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    groups = own.where(F.col("size") >= least).groupBy("sha1", "size") \
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response_id")) \
        .where("n > 1 AND response_id IS NOT NULL") \
        .select("sha1", "size", "response_id", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    dealt = own.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")) \
        .join(groups.hint("shuffle_hash"), ["sha1", "size", "part"], "left") \
        .select("page_id", "url", "payload", F.when(~F.col("response_id").eqNullSafe(F.col("page_id")),
                                                    F.col("response_id")).alias("refers_to"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        package = None
        for batch in batches:
            done = []
            for page_id, url, payload, refers_to in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]):
                package = package or Package(folder, member_bytes, level, date)
                package.add(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py() is None, refers_to.as_py())
                if package.size() >= package_bytes:
                    done.append(package.close())
                    package = None
            if done:
                yield as_batch(done, PACKAGE_SCHEMA)
        if package:
            yield as_batch([package.close()], PACKAGE_SCHEMA)

    FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(folder)[1], recursive=True)
    return keep(dealt.mapInArrow(write, PACKAGE_SCHEMA), "packages")


def as_batch(rows: list, schema: str) -> pa.RecordBatch:
    """Tuples or dicts as a record batch of a simple schema."""
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    get = (lambda r, k, name: r[name]) if rows and isinstance(rows[0], dict) else (lambda r, k, name: r[k])
    return pa.RecordBatch.from_arrays([pa.array([get(r, k, name) for r in rows], types[kind])
                                       for k, (name, kind) in enumerate(fields)], names=[f[0] for f in fields])


# --- reading -------------------------------------------------------------------------

class Directory:
    """The central directory of a ZIP package, read by ranges."""

    def __init__(self, file, size: int):
        self.file = file
        tail_size = min(size, 22 + 0xFFFF)
        tail = file.read_at(tail_size, size - tail_size)
        at = tail.rfind(END)
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") > len(tail):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP package")
        *_, self.n, self.size, self.start, _ = struct.unpack(END_LAYOUT, tail[at:at + 22])
        end = size - tail_size + at
        locator = file.read_at(20, end - 20) if end >= 20 else b""
        if locator[:4] == LOCATOR:
            told = struct.unpack(LOCATOR_LAYOUT, locator)[2]
            # the ZIP64 end record stands where it is told, or right before the locator if bytes were put in front
            for place in (told, end - 20 - 56):
                record = file.read_at(56, place)
                if record[:4] == END64:
                    *_, self.n, self.size, self.start = struct.unpack(END64_LAYOUT, record)
                    end = place
                    break
            else:
                raise ValueError("a ZIP64 locator without its end record")
        #: bytes put in front of the package
        self.before = end - self.size - self.start

    def __iter__(self) -> Iterator[tuple[str, int, int, int]]:
        """(member name, method, compressed size, place of its local header), block by block."""
        place, stop, held = self.start + self.before, self.start + self.before + self.size, b""
        for _ in range(self.n):
            while True:
                if len(held) >= 46:
                    sizes = struct.unpack_from("<3H", held, 28)
                    if len(held) >= 46 + sum(sizes):
                        break
                if place >= stop:
                    raise ValueError("the central directory ends early")
                more = self.file.read_at(min(1 << 20, stop - place), place)
                place, held = place + len(more), held + more
            fields = struct.unpack_from(ENTRY_LAYOUT, held)
            if fields[0] != ENTRY:
                raise ValueError("a central directory entry without its signature")
            flags, method, packed, unpacked, offset = fields[3], fields[4], fields[8], fields[9], fields[16]
            name, extra = held[46:46 + sizes[0]], held[46 + sizes[0]:46 + sizes[0] + sizes[1]]
            held = held[46 + sum(sizes):]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<2H", extra)
                if kind == ZIP64_EXTRA:
                    # only the numbers that did not fit, in this order
                    wide = iter(struct.unpack(f"<{length // 8}Q", extra[4:4 + length // 8 * 8]))
                    unpacked, packed, offset = [next(wide) if x == FULL else x for x in (unpacked, packed, offset)]
                extra = extra[4 + length:]
            if flags & 1:
                raise ValueError("an encrypted member")
            yield name.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, offset + self.before

    def data_start(self, header: int) -> int:
        """Where the bytes of a member start: behind its local header."""
        local = self.file.read_at(30, header)
        fields = struct.unpack(LOCAL_LAYOUT, local)
        if fields[0] != LOCAL:
            raise ValueError("a member without its local header")
        return header + 30 + fields[9] + fields[10]


def lines_of(file, start: int, size: int, block: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a stored member, fetched block by block."""
    held, at = b"", 0
    while at < size:
        more = file.read_at(min(block, size - at), start + at)
        at += len(more)
        *lines, held = (held + more).split(b"\n")
        yield from lines
    if held:
        yield held


def ranges_in(file, size: int) -> Iterator[tuple[str, int, int, bool]]:
    """(member, start, length, whole): the byte ranges of indexed records, and of WARC members
    that no index names (whole).  Deflated members have no ranges and are an error."""
    directory = Directory(file, size)
    archives, indexes = {}, []
    for name, method, packed, header in directory:
        archive, index = name.endswith((".warc", ".warc.gz")), name.endswith((".cdxj", ".cdx"))
        if (archive or index) and method:
            raise ValueError(f"member {name} is deflated: only stored members can be read by ranges")
        if archive:
            archives[name.rpartition("/")[2]] = name, directory.data_start(header), packed
        elif index:
            indexes.append((directory.data_start(header), packed))
    named = set()
    for start, packed in indexes:
        for line in lines_of(file, start, packed):
            at = line.find(b"{")
            if at < 0:
                continue
            entry = json.loads(line[at:])
            short = entry["filename"].rpartition("/")[2]
            if short in archives:
                named.add(short)
                yield archives[short][0], archives[short][1] + int(entry["offset"]), int(entry["length"]), False
    for short, (name, start, packed) in archives.items():
        if short not in named:
            yield name, start, packed, True


def record_at(data: bytes) -> bytes:
    """A record as fetched: one gzip member, or plain."""
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def walk(file, start: int, size: int, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, record) of a WARC member, one record in memory at a time."""
    at, held, here = 0, b"", start

    def more() -> bytes:
        nonlocal at
        data = file.read_at(min(block, size - at), start + at)
        at += len(data)
        return data

    held = more()
    packed = held[:2] == b"\x1f\x8b"
    while held or at < size:
        held = held or more()
        if packed:
            z, record, used = zlib.decompressobj(31), [], 0
            while not z.eof:
                if not held and at >= size:
                    raise ValueError("a record ends early")
                held = held or more()
                record.append(z.decompress(held))
                used += len(held) - len(z.unused_data)
                held = z.unused_data
            yield here, b"".join(record)
            here += used
        else:
            while (end := held.find(b"\r\n\r\n")) < 0 and at < size:
                held += more()
            if end < 0:
                raise ValueError("a record ends early")
            length = end + 4 + int(headers(held[:end])["content-length"]) + 4
            parts, have = [held], len(held)
            while have < length and at < size:
                parts.append(more())
                have += len(parts[-1])
            held = b"".join(parts)
            yield here, held[:length]
            here, held = here + length, held[length:]


def opened(path: str):
    fs, place = FileSystem.from_uri(path)
    return fs.open_input_file(place)


def record_ranges(packages: DataFrame) -> DataFrame:
    """(path, member, start, length, whole) of all records of the packages named in column ``path``."""

    def work(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with opened(path) as file:
                    for found in ranges_in(file, file.size()):
                        rows.append((path, *found))
                        if len(rows) >= 10_000:
                            yield as_batch(rows, RANGE_SCHEMA)
                            rows = []
                yield as_batch(rows, RANGE_SCHEMA)

    return packages.where("path IS NOT NULL").select("path").mapInArrow(work, RANGE_SCHEMA)


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """The page records of the packages named in column ``path``: path, member, start (place in
    the package), page_id, record_type, target_uri, payload_bytes and payload_digest (of the full
    payload, for revisits too), refers_to (a revisit's response), intact (lengths and digests of
    block and payload hold) and payload (null for revisits, or for all without ``with_payload``).

    Null paths name nothing, no packages give no rows; a file that is no ZIP package, or whose
    archive members are deflated, is an error.  Index entries are dealt over tasks by blocks of
    ``BLOCK_BYTES`` of a package, so one large package is read by many tasks; a task holds one
    fetched stretch at a time.
    """
    spark = packages.sparkSession
    total = packages.withColumn("size", F.col("bytes") if "bytes" in packages.columns else F.lit(0)) \
        .agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    dealt = record_ranges(packages).withColumn("block", F.floor(F.col("start") / BLOCK_BYTES)) \
        .repartition(tasks, "path", "block").sortWithinPartitions("path", "start").drop("block")

    def fetched(rows) -> Iterator[tuple[str, str, int, bytes]]:
        """(path, member, start, record) of sorted ranges; neighbours are fetched together."""
        path = file = None
        k = 0
        while k < len(rows):
            if rows[k][0] != path:
                if file:
                    file.close()
                path = rows[k][0]
                file = opened(path)
            _, member, start, length, whole = rows[k]
            if whole:
                for place, record in walk(file, start, length):
                    yield path, member, place, record
                k += 1
                continue
            stop, last = start + length, k + 1
            while last < len(rows) and rows[last][0] == path and not rows[last][4] \
                    and rows[last][2] <= stop + GAP_BYTES and rows[last][2] + rows[last][3] - start <= FETCH_BYTES:
                stop, last = max(stop, rows[last][2] + rows[last][3]), last + 1
            data = file.read_at(stop - start, start)
            for _, member, place, size, _ in rows[k:last]:
                yield path, member, place, record_at(data[place - start:place - start + size])
            k = last
        if file:
            file.close()

    def work(batches):
        for batch in batches:
            out, size = [], 0
            for path, member, start, record in fetched(list(zip(*[c.to_pylist() for c in batch.columns]))):
                row = parsed(record)
                if row is None:
                    continue
                out.append(row | {"path": path, "member": member, "start": start})
                if with_payload:
                    size += len(record)
                else:
                    row["payload"] = out[-1]["payload"] = None
                if size >= FETCH_BYTES or len(out) >= 10_000:
                    yield as_batch(out, RECORD_SCHEMA)
                    out, size = [], 0
            if out:
                yield as_batch(out, RECORD_SCHEMA)

    return dealt.mapInArrow(work, RECORD_SCHEMA)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark).rstrip('/')}/llm/warc-{uuid.uuid4().hex}"
    records = read_packages(write_packages(read(spark, sf_dir, "pages"), folder), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
