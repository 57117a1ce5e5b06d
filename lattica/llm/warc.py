"""WARC archives, index first.

Every record is a gzip member of its own, so its offset and length in the archive are all that a reader needs. Each task
streams its pages into archives of its own, a new one after FILE_BYTES, and hands on a row of the index for each record:
file, offset, length, URL, digest. The index is written before anything is read, and it alone says which files count: names
are drawn anew by each attempt, so what a lost or repeated attempt left behind is named nowhere. Reading takes selected
rows of the index, sorts their byte ranges within files, coalesces neighbouring ones and fetches each run at once.

Payloads are not shuffled. Which records revisit another follows from digests and lengths alone; the payloads that several
records share come to the writers as a broadcast table if it is small, counted first, and else by a join on the digest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_if_null, full_address, new_path, open_store, table, written

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
#: A gap of up to GAP bytes is read over; a run of ranges is at most RUN bytes, unless one record is longer.
GAP, RUN = 64 << 10, 4 << 20
#: Compressed bytes that one task reads, about, and rows of repeats that may be broadcast, of about 100 bytes each.
READ_BYTES, BROADCAST_ROWS = 64 << 20, 300_000
LEVEL = 1
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "path string, offset long, length long, url string, payload_digest string, page_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(name: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A whole record: a response with its payload, or without it a revisit of another page's response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse_record(raw: bytes) -> dict:
    """Fields of one record, its block and, for a response, its payload."""
    head, _, rest = raw.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != END:
        raise ValueError("a record doesn't end where it should")
    return {"fields": fields, "block": block, "payload": block.partition(END)[2]}


def _repeats(slim: DataFrame) -> DataFrame:
    """The largest page_id of each payload that several records share."""
    long = slim.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    return long.filter("n > 1").drop("n")


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes an archive record for each page (page_id, url, html) under path and gives back the index.

    A null html is an empty payload, a null url an empty one, a null page_id stays null and yields to any other as the
    one that others refer to. Of repeated rows with the largest page_id, each is a response. Extra columns play no part.
    An empty table gives an empty index and no archive. Line ends in URLs are escaped.
    """
    payload = blank_if_null(F.col("html"))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(blank_if_null(F.col("url")), r"[\r\n]", "%0A").alias("url"), payload.alias("payload"))
    full = full.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    repeats = written(_repeats(full.select("page_id", "payload_bytes", "payload_digest")), "warc-repeats")
    if repeats.count() <= BROADCAST_ROWS:
        repeats = F.broadcast(repeats)
    typed = full.join(repeats, ["payload_digest", "payload_bytes"], "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    root = full_address(pages.sparkSession, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        out, name, at = None, "", 0
        for b in it:
            rows: list[list] = [[] for _ in range(6)]
            for page, url, html, digest, keeper in zip(*(b.column(i) for i in range(5)), strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                page, url, digest = page.as_py(), url.as_py(), digest.as_py()
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = pack.compress(record(f"{name}:{at}", page, url, html.as_py().encode(), digest, keeper.as_py())) + pack.flush()
                out.write(raw)
                for to, v in zip(rows, (f"{root}/{name}", at, len(raw), url, digest, page), strict=True):
                    to.append(v)
                at += len(raw)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return written(typed.select("page_id", "url", "payload", "payload_digest", refers_to.alias("refers_to")).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that rows of an index name, read back by coalesced byte ranges. Digests are those of the payloads read; a payload that doesn't match its header fails the task."""
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    rows = index.select("path", "offset", "length").withColumn("__run", F.floor(F.col("offset") / (2 * RUN))).repartition(parts, "path", "__run").sortWithinPartitions("path", "offset")
    schema = RECORD + (", payload string" if with_payload else "")
    number = lambda s: int(s) if s else None

    def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        path, held = "", []
        for b in it:
            for p, o, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (p != path or o - sum(held[-1]) > GAP or o + n - held[0][0] > RUN):
                    yield path, held
                    held = []
                path = p
                held.append((o, n))
        if held:
            yield path, held

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = "", None
        for path, held in ranges(it):
            if path != opened:
                if source is not None:
                    source.close()
                store, name = open_store(path)
                opened, source = path, store.open_input_file(name)
            lo = held[0][0]
            data = source.read_at(max(o + n for o, n in held) - lo, lo)
            out: list[list] = [[] for _ in range(6 + with_payload)]
            for o, n in held:
                r = parse_record(zlib.decompress(data[o - lo : o - lo + n], 31))
                f, kind = r["fields"], r["fields"]["WARC-Type"]
                digest, size = f["WARC-Payload-Digest"][5:], int(f["X-Payload-Length"])
                if kind == "response" and (hashlib.sha1(r["payload"]).hexdigest(), len(r["payload"])) != (digest, size):
                    raise ValueError(f"damaged record at {o} of {path}")
                values = [number(f["X-Page-ID"]), f["WARC-Target-URI"], size, digest, kind, number(f.get("X-Refers-To-Page-ID"))]
                for to, v in zip(out, values + [r["payload"].decode()] * with_payload, strict=True):
                    to.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])
        if source is not None:
            source.close()

    return rows.mapInArrow(run, schema)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back from them."""
    index = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_records(index).drop("url")
