"""WARC archives with a two-level capture index.

Pages are written as WARC records, each a gzip member of its own. Their captures are sorted by reversed-host URL key and
page into blocks of lines, compressed; a sparse directory holds the first key of each block and where it lies. A lookup
searches the directory by halving, reads the range of one block, searches in it by halving, and gets the range of a record.

Index and directory are written in parts by key ranges, and all that the driver holds is the first and last key of each
part, one row a partition. Lookups come sorted in the same order, so that a task reads a block once, and what they find is
sorted by file and place before the records are read, so that neighbours come in one read.
"""

from __future__ import annotations

import base64
import bisect
import contextlib
import hashlib
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, shared_path, small, stored

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures of a block; most bytes of a WARC file before the next one is begun; bytes that are read at once.
LINES, FILE_BYTES, READ_BYTES = 2000, 1 << 30, 4 << 20
LEVEL = 1
_URL = re.compile(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(?:[^/?#@]*@)?([^/?#]*)([^#]*)")
_BLANK = re.compile(rb"[\x00-\x20\x7f]")
#: Sorts before every page.
NO_PAGE = -(1 << 63)
_CAPTURE = "key string, page_id long, name string, offset long, length long"
_PLACES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("name", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _escaped(text: str) -> str:
    return _BLANK.sub(lambda m: b"%%%02X" % m[0][0], text.encode()).decode()


def url_key(url: str | None) -> str:
    """Host labels in lower case from the last to the first, then path and query: http://Ab.example.org/x?y#z gives org,example,ab)/x?y.

    Scheme, user and fragment are left out; addresses keep their order; blanks and control characters are escaped. A URL
    without a scheme has no host; none at all gives ")/"."""
    scheme, host, rest = _URL.match(url or "").groups()
    if not scheme:
        host, rest = "", re.sub(r"(?s)#.*", "", url or "")
    name, colon, port = host.lower().partition(":") if not host.startswith("[") else (host.lower(), "", "")
    labels = name.split(".")
    if not (name.startswith("[") or all(x.isdigit() for x in labels)):
        name = ",".join(reversed(labels))
    return _escaped(f"{name}{colon}{port}){rest if rest[:1] in ('/', '?') else '/' + rest}")


@dataclass(frozen=True)
class Part:
    """First and last (key, page) of a part of the index."""

    first: tuple[str, int]
    last: tuple[str, int]
    name: str


def _code(key: str | None, page: int | None) -> tuple[bytes, int]:
    """Compares as Spark sorts: keys by their bytes, no page before all pages."""
    return (key or "").encode(), NO_PAGE if page is None else page


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, date: str) -> bytes:
    own = lambda p: f"<urn:page:{'' if p is None else p}:{digest}>"
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_escaped(url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {own(refers)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"".join(["WARC/1.1\r\n".encode(), "\r\n".join(head).encode(), b"\r\n\r\n", block, b"\r\n\r\n"])


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches, out: str, date: str, most: int):
    """Writes the records of a partition and yields their captures. A task that runs again writes to files of its own
    attempt; the captures that Spark keeps name the attempt that counts."""
    task, store, number, at = TaskContext.get(), None, 0, 0
    with contextlib.ExitStack() as files:
        for batch in batches:
            rows = []
            for page, url, payload, sha, refers, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "refers", "revisit")), strict=True):
                if store is None or at >= most:
                    files.close()
                    store, root = fs.FileSystem.from_uri(out)
                    store.create_dir(root, recursive=True)
                    name, number, at = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.gz", number + 1, 0
                    sink = files.enter_context(store.open_output_stream(f"{root}/{name}", compression=None))  # the name alone would compress it again
                data = _member(_record(page, url, payload, base64.b32encode(sha).decode(), refers, revisit, date))
                sink.write(data)
                rows.append((url_key(url), page, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _PLACES.types, strict=True)], schema=_PLACES)


def write_archive(pages: DataFrame, out: str, least: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the pages (page_id, url, html) to WARC files below `out` and returns their captures: key, page_id, name of the
    file, offset and length of the gzip member; a stored table.

    Of pages with one payload of `least` bytes or more, those with the largest page_id are responses, all others revisits that
    refer to it; shorter ones are all responses. A null html is empty, a null page_id is below all others, a null url is
    empty. Rows with one page_id each give a record. Equal payloads meet by digest, after partial aggregation; pages join what
    was found by a broadcast of checked size, or by digest.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"))
    long = rows.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("refers"), F.count(F.lit(1)).alias("n"))
    copies = small(stored(long.filter("n > 1").select("sha", "refers", F.lit(True).alias("copied")), "op11-copies"))
    kept = rows.join(copies, "sha", "left").withColumn("revisit", F.coalesce(F.col("copied") & ~F.col("refers").eqNullSafe(F.col("page_id")), F.lit(False)) & (F.octet_length("payload") >= least))
    made = kept.select("page_id", "url", "payload", "sha", "refers", "revisit").mapInArrow(lambda b: _write(b, out, date, file_bytes), _CAPTURE)
    return stored(made, "op11-captures")


def _index(batches, out: str, lines: int):
    """Writes a part of the index from sorted captures: blocks of lines, and the directory of the blocks."""
    task = TaskContext.get()
    name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}"
    store, root = fs.FileSystem.from_uri(out)
    held, directory, at, first, last = [], [], 0, None, None

    def flush(sink) -> None:
        nonlocal held, at
        data = zlib.compress("".join(line for _, _, line in held).encode())
        sink.write(data)
        directory.append(f"{held[0][0]}\t{held[0][1]}\t{at}\t{len(data)}\n")
        at, held = at + len(data), []

    with contextlib.ExitStack() as files:
        for batch in batches:
            for key, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = NO_PAGE if page is None else page
                if first is None:
                    store.create_dir(root, recursive=True)
                    sink, first = files.enter_context(store.open_output_stream(f"{root}/{name}.blocks")), (key, page)
                last = (key, page)
                held.append((key, page, f"{key}\t{page}\t{file}\t{offset}\t{length}\n"))
                if len(held) == lines:
                    flush(sink)
        if first is None:
            return
        if held:
            flush(sink)
        with store.open_output_stream(f"{root}/{name}.directory") as sink:
            sink.write("".join(directory).encode())
    yield pa.RecordBatch.from_pylist([{"name": name, "key": first[0], "page": first[1], "last_key": last[0], "last_page": last[1]}])


def build_index(captures: DataFrame, out: str, lines: int = LINES) -> list[Part]:
    """Writes the index of the captures (a stored table) below `out` and returns its parts in order, one a partition at most.
    Captures of one key are ordered by page, file and place, so a hot key spreads over blocks and parts."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.select("key", "page_id", "name", "offset", "length").repartitionByRange(n, "key", "page_id", "name", "offset").sortWithinPartitions("key", "page_id", "name", "offset")
    made = rows.mapInArrow(lambda b: _index(b, out, lines), "name string, key string, page long, last_key string, last_page long").collect()
    return sorted((Part((r.key, r.page), (r.last_key, r.last_page), r.name) for r in made), key=lambda p: (_code(*p.first), _code(*p.last)))


class Index:
    """Lookups in an index, best in ascending order: the last directory and the last block are kept."""

    def __init__(self, out: str, parts: list[Part]):
        self.store, self.root = fs.FileSystem.from_uri(out)
        self.parts, self.lasts = parts, [_code(*p.last) for p in parts]
        self.firsts = [_code(*p.first) for p in parts]
        self.part = self.at = -1

    def _open(self, part: int) -> None:
        if part != self.part:
            with self.store.open_input_file(f"{self.root}/{self.parts[part].name}.directory") as f:
                lines = [line.split("\t") for line in f.read().decode().split("\n")[:-1]]
            self.part, self.at = part, -1
            self.starts, self.ranges = [_code(k, int(p)) for k, p, *_ in lines], [(int(a), int(n)) for *_, a, n in lines]
            self.blocks = self.store.open_input_file(f"{self.root}/{self.parts[part].name}.blocks")

    def _block(self, at: int) -> None:
        if at != self.at:
            offset, length = self.ranges[at]
            lines = [line.split("\t") for line in zlib.decompress(self.blocks.read_at(length, offset)).decode().split("\n")[:-1]]
            self.at, self.keys, self.lines = at, [_code(k, int(p)) for k, p, *_ in lines], lines

    def find(self, key: str, page: int | None):
        """(file, offset, length) of the captures of the page under the key."""
        code = _code(key, page)
        for part in range(bisect.bisect_left(self.lasts, code), len(self.parts)):
            if self.firsts[part] > code:
                return
            self._open(part)
            for at in range(max(0, bisect.bisect_left(self.starts, code) - 1), len(self.starts)):
                if self.starts[at] > code:
                    break
                self._block(at)
                for i in range(bisect.bisect_left(self.keys, code), bisect.bisect_right(self.keys, code)):
                    *_, name, offset, length = self.lines[i]
                    yield name, int(offset), int(length)


def _find(batches, out: str, parts: list[Part]):
    index, before = Index(out, parts), None
    for batch in batches:
        rows = []
        for key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, page) != before:
                before = key, page
                rows += [(key, page, *place) for place in index.find(key, page)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _PLACES.types, strict=True)], schema=_PLACES)


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], names=["key", "page_id"])


def find_captures(requests: DataFrame, out: str, parts: list[Part]) -> DataFrame:
    """Captures of the requests (url, page_id), each once however often it is asked for; a stored table. Requests that the index
    lacks give none."""
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = requests.select("url", "page_id").mapInArrow(_keys, "key string, page_id long")
    asked = asked.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return stored(asked.mapInArrow(lambda b: _find(b, out, parts), _CAPTURE), "op11-found")


def _ranges(rows: list[tuple[str, int, int]]):
    """Neighbouring records of a file in one range of READ_BYTES, or of one record that is longer."""
    held: list[tuple[str, int, int]] = []
    for row in rows:
        if held and (row[0] != held[0][0] or row[1] != held[-1][1] + held[-1][2] or row[1] + row[2] - held[0][1] > READ_BYTES):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def parsed(data: bytes) -> dict:
    """What a record tells: page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to. A payload
    that doesn't have its digest raises an error."""
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, body = block[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    page = lambda name: int(x) if (x := fields[name].split(":")[2]) else None
    revisit, digest = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't have its digest")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload": None if revisit else body, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To") if revisit else None}


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches, out: str, payloads: bool):
    store, root = fs.FileSystem.from_uri(out)
    name = file = None
    for batch in batches:
        for held in _ranges(list(zip(*(batch.column(c).to_pylist() for c in ("name", "offset", "length")), strict=True))):
            if held[0][0] != name:
                name = held[0][0]
                file = store.open_input_file(f"{root}/{name}")
            start = held[0][1]
            data = memoryview(file.read_at(held[-1][1] + held[-1][2] - start, start))
            found = [parsed(zlib.decompress(data[a - start : a - start + n], 31)) for _, a, n in held]
            yield pa.RecordBatch.from_pylist(found if payloads else [x | {"payload": None} for x in found], _READ)


def read_records(captures: DataFrame, out: str, payloads: bool = True) -> DataFrame:
    """The records of the captures (a stored table), by ranges of the files in order of their places: page_id, url, payload (null for
    revisits, and where payloads is false), payload_bytes, payload_digest, record_type, refers_to."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.repartitionByRange(n, "name", "offset").sortWithinPartitions("name", "offset").select("name", "offset", "length")
    return rows.mapInArrow(lambda b: _read(b, out, payloads), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """Every page is written, looked up in the index by its URL, and read back."""
    pages, out = read(spark, sf_dir, "pages"), shared_path(spark, "op11-archive")
    parts = build_index(write_archive(pages, out), out)
    found = find_captures(pages, out, parts)
    return read_records(found, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a digest's hexadecimal d: five digits are four characters.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(d, i // 4 * 5 + 1, 5))::BIGINT >> (15 - i % 4 * 5)) & 31) + 1)::BIGINT, 1)), '')"
SQL = {
    "op11_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages), g AS (SELECT d, max(page_id) AS top FROM p GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p JOIN g USING (d)"""
}
