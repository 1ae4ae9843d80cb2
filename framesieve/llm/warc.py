"""WARC archives, their capture index, and reading both.

Payloads that occur before are written as revisits; which ones is decided from digests alone, by a grouped maximum and a
join that adaptive execution can split at a hot payload.  Each task writes archives of its own, one gzip member per
record, and returns runs of index rows sorted by URL key and timestamp.  The runs are merged into globally ordered
capture histories: rows are dealt by ranges of (URL key, timestamp, page, place in the archives), as many as hold a task
to a bounded number of rows, and each range merges the slices of all runs through a loser tree.  The merged index is
stored, and every row gets its rank in the order of all captures from the ranges' sizes.  Reading takes the records where
they lie, file by file, and gives each its rank, so that the histories come back by it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .common import exclusive_prefix, new_folder, stored, text_bytes

INDEX = (
    "run long, pos long, urlkey string, captured string, page_id long, file string, at long, size long, kind string"
)
RECORDS = (
    "page_id long, url string, captured string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, capture_rank long"
)
#: Pages carry no capture time; page n counts as taken n seconds after this.
FIRST_CAPTURE = datetime(2000, 1, 1)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, all lower case."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


# -- which records are revisits ----------------------------------------------------------------------------------------


def resolved(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, raw, digest, n_bytes, refers_to): raw is null and refers_to set where an equal payload stands.

    Of payloads of at least least_bytes that are equal, the one with the largest page_id stays; rows without page_id, and
    rows that repeat the largest one, stay too.
    """
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("raw"))
    marked = raw.withColumn("digest", F.sha1("raw")).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    large = marked.where((F.col("n_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = large.join(groups.select("digest", "refers_to"), "digest").where("page_id < refers_to")
    again = again.groupBy(F.col("page_id").alias("_again"), F.col("digest").alias("_digest")).agg(F.max("refers_to").alias("refers_to"))
    same = (F.col("page_id") == F.col("_again")) & (F.col("digest") == F.col("_digest"))
    out = marked.join(again, same, "left")
    return out.select(
        "page_id",
        "url",
        F.when(F.col("refers_to").isNull(), F.col("raw")).alias("raw"),
        "digest",
        "n_bytes",
        "refers_to",
    )


# -- writing -----------------------------------------------------------------------------------------------------------


def _urn(page) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page, url: str, captured: datetime, raw: bytes | None, digest: str, n_bytes: int, refers_to) -> bytes:
    """One record of WARC 1.1, uncompressed."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if raw is not None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {captured:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if raw is None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    else:
        block += raw
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write(folder: str, file_bytes: int, run_rows: int, level: int):
    def run(batches):
        part, runs = TaskContext.get().partitionId(), 0
        out, uri, at = None, "", 0
        rows: list[tuple] = []

        def flush():
            nonlocal rows, runs
            rows.sort(key=lambda r: (r[0], r[1], r[2] if r[2] is not None else -1))
            name = (part << 24) + runs
            columns = [[name] * len(rows), list(range(len(rows))), *map(list, zip(*rows))] if rows else [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            rows, runs = [], runs + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _names(INDEX))

        for batch in batches:
            cells = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page, url, raw, digest, n_bytes, refers_to = (c[i].as_py() for c in cells)
                captured = FIRST_CAPTURE + timedelta(seconds=abs(page or 0) % 10**10)
                packed = _member(record(page, url or "", captured, raw, digest, n_bytes, refers_to), level)
                if out is not None and at + len(packed) > file_bytes:
                    out.close()
                    out = None
                if out is None:
                    (out, uri), at = storage.create(folder, f"pages-{part:06d}"), 0
                out.write(packed)
                kind = "response" if raw is not None else "revisit"
                rows.append((url_key(url or ""), f"{captured:%Y%m%d%H%M%S}", page, uri, at, len(packed), kind))
                at += len(packed)
                if len(rows) >= run_rows:
                    yield flush()
        if out is not None:
            out.close()
        yield flush()

    return run


def write(
    pages: DataFrame, least_bytes: int = 1000, file_bytes: int = 1 << 28, run_rows: int = 50_000, level: int = 1
) -> DataFrame:
    """Write a record per row of pages and return the stored index, in runs sorted by (urlkey, captured, page_id).

    pages needs page_id, url and html; other columns are left out.  Null html is an empty payload, a null url an empty
    one.  Repeated rows are written once each.  An empty table gives an empty index.
    """
    run = _write(new_folder(pages.sparkSession, "warc"), file_bytes, run_rows, level)
    return stored(resolved(pages, least_bytes).mapInArrow(run, INDEX), "warc-runs")


# -- merging the index -------------------------------------------------------------------------------------------------


class LoserTree:
    """Merges sorted sequences: each inner node holds the loser of its match, the root's winner comes out next.

    Taking a value replays only the matches on the path of the sequence it came from.
    """

    def __init__(self, runs: list):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * self.k
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self._play(i)

    def _head(self, i):
        if i < len(self.runs) and self.at[i] < len(self.runs[i]):
            return self.runs[i][self.at[i]]
        return None

    def _before(self, i, j) -> bool:
        a, b = self._head(i), self._head(j)
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _play(self, i):
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0:  # no one has come to this match yet
                self.losers[node] = i
                return
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.winner = i

    def __iter__(self):
        while self.winner >= 0 and self._head(self.winner) is not None:
            i = self.winner
            yield self._head(i)
            self.at[i] += 1
            self._play(i)


def _merge(batches):
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    table = pa.Table.from_batches(whole).combine_chunks()
    runs, names = [], table.column("run").to_pylist()
    pages = [-1 if p is None else p for p in table.column("page_id").to_pylist()]
    keys = list(zip(table.column("urlkey").to_pylist(), table.column("captured").to_pylist(), pages, range(len(names))))
    start = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[start]:
            runs.append(keys[start:i])
            start = i
    order = [key[3] for key in LoserTree(runs)]
    part = TaskContext.get().partitionId()
    ordered = table.take(pa.array(order)).drop_columns(["run", "pos"])
    ordered = ordered.append_column("part", pa.array([part] * len(order), pa.int32()))
    ordered = ordered.append_column("place", pa.array(range(len(order)), pa.int64()))
    yield from ordered.combine_chunks().to_batches()


def merged(index: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """The index, stored, with capture_rank: each row's place from 0 in the order (urlkey, captured, page_id).

    part and place number the rows range by range; a range holds about range_rows rows at any size of the index.  A hot
    URL key or a repeated page is no hot range, since ranges cut within it by time, page and place in the archives.  Null
    pages come first, equal rows in the order of their runs.  An empty index stays empty.
    """
    tasks = max(1, -(-index.count() // range_rows))
    ranged = index.repartitionByRange(tasks, "urlkey", "captured", "page_id", "run", "pos").sortWithinPartitions("run", "pos")
    schema = INDEX.removeprefix("run long, pos long, ") + ", part int, place long"
    ordered = stored(ranged.mapInArrow(_merge, schema), "warc-index")
    sizes = exclusive_prefix(ordered.groupBy("part").agg(F.count("*").alias("rows")), ["part"], "rows", "before")
    ranked = ordered.join(F.broadcast(sizes.drop("rows")), "part")
    return ranked.withColumn("capture_rank", F.col("before") + F.col("place")).drop("before")


# -- reading -----------------------------------------------------------------------------------------------------------


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers with lower-case names, HTTP header block, payload) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _page(urn: str):
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name == "none" else int(name)


def _read(with_payload: bool):
    def run(batches):
        source, uri = None, None
        for batch in batches:
            out: list[tuple] = []
            for file, at, size, rank in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if file != uri:
                    if source is not None:
                        source.close()
                    source, uri = storage.open_file(file), file
                source.seek(at)
                headers, http, payload = parse(zlib.decompress(source.read(size), 31))
                kind = headers["warc-type"]
                digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                n_bytes = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if kind == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"damaged record in {file} at {at}")
                refers_to = _page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                captured = re.sub(r"\D", "", headers["warc-date"])
                body = payload if with_payload and kind == "response" else None
                out.append((_page(headers["warc-record-id"]), headers["warc-target-uri"], captured, kind, refers_to, n_bytes, digest, body, rank))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
            columns = list(zip(*out)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _names(RECORDS))
        if source is not None:
            source.close()

    return run


def read(index: DataFrame, with_payload: bool = True, stretch: int = 1 << 23) -> DataFrame:
    """Every record that the merged index names, checked against its digest; revisits have no payload of their own.

    Each archive is read in stretches of stretch bytes (a power of two), in the order of the file; capture_rank orders the
    records by URL and time.  A page without an id comes back without one, and an empty index gives no record.
    """
    rows = index.select("file", "at", "size", "capture_rank").withColumn("stretch", F.col("at").bitwiseAND(F.lit(-stretch)))
    # Rows are short and what they name is long: a task per stretch of archive, not per size of its rows.
    total = index.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, min(-(-2 * total // stretch), 20_000))
    rows = rows.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "at").drop("stretch")
    return rows.mapInArrow(_read(with_payload), RECORDS)
