"""WARC archives with revisit records and a two-level capture index.

*Write.* Pages with equal payloads of at least ``LEAST_BYTES`` bytes share one response
record, that of the largest id; the others become revisit records that refer to it. Each
task writes one archive of gzip members into the shared folder under a name of its own
attempt, and returns where each record lies; only returned names count, so a task that is
run again does no harm.

*Index.* Captures are sorted by their key (host labels in reverse, then path, page and
digest) over ranges. Each range becomes one index file: compressed blocks of ``BLOCK``
keys, then a sparse directory with the first key of each block, then the directory's
place. The first keys of the files are the upper level.

*Read.* A lookup searches the upper level, the file's directory and the block by halving,
then reads the record's range from its archive.

Defined results: null html is an empty payload; a null or malformed url is filed under
itself. Repeated rows give equal rows. Extra columns are ignored. No pages, no files.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.shared import map_batches, shared_dir, staged

LEAST_BYTES = 1000
BLOCK = 512


def reversed_host(url: str | None) -> str:
    """``http://www.example.org/a?b`` as ``org,example,www)/a?b``."""
    url = url or ""
    try:
        parts = urlsplit(url.strip())
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
        if not host:
            return url
        return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return url


def capture_key(url: str | None, page_id: int | None, digest: str) -> str:
    return f"{reversed_host(url)} {page_id} {digest}".replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member."""
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    if refers_to is None:
        kind = "response"
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        more = ""
    else:
        kind = "revisit"
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        more = f"WARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Refers-To-Payload-Length: {len(payload)}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {safe}\r\n"
        f"WARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload) of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _place(folder: str, stem: str) -> str:
    task = TaskContext.get()
    return f"{folder}/{stem}-{task.partitionId():06d}-{task.taskAttemptId()}"


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _write_archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name, out, at = _place("", "pages") + ".warc.gz", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(base + name, compression=None)
            keys, starts, sizes = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for page, url, payload, digest, refers in zip(*columns, strict=True):
                member = record_bytes(page, url, payload, digest, refers)
                out.write(member)
                keys.append(capture_key(url, page, digest))
                starts.append(at)
                sizes.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([name] * len(keys)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["key", "archive", "start", "size"])
        if out is not None:
            out.close()

    return run


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name, out, at, directory, held = _place("", "index") + ".cdxz", None, 0, [], []

        def block(rows):
            nonlocal at
            data = zlib.compress("\n".join(rows).encode())
            directory.append(f"{rows[0].split(chr(9), 1)[0]}\t{at}\t{len(data)}")
            out.write(data)
            at += len(data)

        for batch in batches:
            if batch.num_rows and out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(base + name, compression=None)
            held += [f"{k}\t{a}\t{s}\t{n}" for k, a, s, n in zip(*(batch.column(c).to_pylist() for c in ("key", "archive", "start", "size")), strict=True)]
            while len(held) >= BLOCK:
                block(held[:BLOCK])
                held = held[BLOCK:]
        if out is not None:
            if held:
                block(held)
            data = zlib.compress("\n".join(directory).encode())
            out.write(data + at.to_bytes(8, "little") + len(data).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t", 1)[0]]), pa.array([name])], ["first_key", "index"])

    return run


class CaptureIndex:
    """Lookups in the files of one folder; keeps a few open files, directories and blocks."""

    def __init__(self, folder: str, upper: list[tuple[str, str]]):
        self.store, self.base = _open(folder)
        self.first_keys, self.names = [k for k, _ in upper], [n for _, n in upper]
        self.files, self.directories, self.blocks = OrderedDict(), OrderedDict(), OrderedDict()

    def _kept(self, cache: OrderedDict, key, make, most: int):
        if key not in cache:
            cache[key] = make()
            if len(cache) > most:
                _, old = cache.popitem(last=False)
                if cache is self.files:
                    old.close()
        cache.move_to_end(key)
        return cache[key]

    def read(self, name: str, start: int, size: int) -> bytes:
        file = self._kept(self.files, name, lambda: self.store.open_input_file(self.base + name), 32)
        return file.read_at(size, start)

    def _directory(self, name: str):
        end = self._kept(self.files, name, lambda: self.store.open_input_file(self.base + name), 32).size()
        at, size = (int.from_bytes(self.read(name, end - x, 8), "little") for x in (16, 8))
        rows = [r.split("\t") for r in zlib.decompress(self.read(name, at, size)).decode().split("\n")]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def _block(self, name: str, start: int, size: int):
        rows = [r.split("\t") for r in zlib.decompress(self.read(name, start, size)).decode().split("\n")]
        return [r[0] for r in rows], [(r[1], int(r[2]), int(r[3])) for r in rows]

    def find(self, key: str) -> tuple[str, int, int] | None:
        """(archive, start, size) of the capture with this key."""
        at = bisect.bisect_right(self.first_keys, key) - 1
        if at < 0:
            return None
        name = self.names[at]
        first, places = self._kept(self.directories, name, lambda: self._directory(name), 8)
        place = places[max(bisect.bisect_right(first, key) - 1, 0)]
        keys, rows = self._kept(self.blocks, (name, place), lambda: self._block(name, *place), 8)
        at = bisect.bisect_left(keys, key)
        return rows[at] if at < len(keys) and keys[at] == key else None


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _look_up(folder: str, upper: list[tuple[str, str]], with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, upper)
        for batch in batches:
            rows = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            payloads = []
            for page, key in zip(batch.column("page_id").to_pylist(), batch.column("key").to_pylist(), strict=True):
                place = index.find(key)
                if place is None:
                    raise LookupError(f"capture {key!r} is not in the index")
                fields, payload = parse_record(index.read(*place))
                revisit = fields["warc-type"] == "revisit"
                rows["page_id"].append(page)
                rows["record_type"].append(fields["warc-type"])
                rows["payload_bytes"].append(int(fields["warc-refers-to-payload-length"]) if revisit else len(payload))
                rows["payload_digest"].append(fields["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest())
                rows["refers_to"].append(int(fields["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")) if revisit else None)
                payloads.append(None if revisit else payload)
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
            arrays = [pa.array(v, kinds[c]) for c, v in rows.items()]
            names = list(rows)
            if with_payload:
                arrays, names = [*arrays, pa.array(payloads, pa.binary())], [*names, "payload"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [capture_key(u, p, d) for u, p, d in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), batch.column("digest").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(keys, pa.string())], ["page_id", "key"])


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: a response record)."""
    captured = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    captured = captured.withColumns({"digest": F.sha1("payload"), "content": F.sha2("payload", 256)})
    shared = captured.where(F.octet_length("payload") >= LEAST_BYTES).groupBy("content").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    # Only contents that recur are joined; rows are few and small, and adaptive execution may split a frequent one.
    joined = captured.join(staged(shared.select("content", "response")), "content", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("response"), F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame) -> tuple[str, list[tuple[str, str]]]:
    """Write archives and index; (folder, upper level of the index: one row per index file)."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    entries = staged(map_batches(with_record_types(pages), _write_archive(folder), "key string, archive string, start long, size long"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = entries.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    upper = staged(map_batches(in_order, _write_index(folder), "first_key string, index string"))
    return folder, [(r["first_key"], r["index"]) for r in upper.orderBy("first_key").collect()]  # a row per range


def look_up(pages: DataFrame, folder: str, upper: list[tuple[str, str]], *, with_payload: bool = False) -> DataFrame:
    """The captures of ``pages`` (page_id, url, html) as read from the archives."""
    wanted = pages.select("page_id", "url", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"))
    keyed = staged(map_batches(wanted, _keys, "page_id long, key string"))
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = keyed.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    return map_batches(near, _look_up(folder, upper, with_payload), FOUND + (", payload binary" if with_payload else ""))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return look_up(pages, *write_archives(pages))


OP7_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
             CASE WHEN strlen(coalesce(html, '')) >= 1000 THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) ELSE page_id END AS keep
      FROM pages)
"""
