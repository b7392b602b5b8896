"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page_id; each is a gzip member of its own. A record's
file follows from the compressed bytes of all records before it (a revisit's within
a few), so files roll at about ``ROLL_BYTES`` whatever the partitions were, and
reruns write the same bytes. WARC
and HTTP headers, lengths and digests are made anew from url and payload. Of equal
payloads of at least ``least`` bytes, the record with the smallest page_id is the
response and the others are revisits without a body.

A first pass keeps only ids, urls, digests and compressed lengths, which decide types,
order and files; copies of one record have bytes, and so files, of their own. In the
second pass each task knows a record's file from the files' first keys (a row for each
file) and sends the body there once; decisions meet bodies in the file's task. It streams
the file under a temporary name and renames it; the manifest (a Parquet table that Spark
commits when every task has ended) names the files that count.

Defined cases: a null html is an empty payload, a null url leaves out the target
header, a null page_id sorts last and is null again when read; repeated rows are
records of their own, the first of them the response; an empty table gives an empty
manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from bisect import bisect
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import TEMPORARY, cut, filesystem, map_batches, new_dir, slices, sweep, with_sums

ROLL_BYTES = 64 << 20
LEVEL = 6
#: The date of every record: archives depend on their input alone.
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("9d6c3f80-58a5-5a54-9a0e-2f2f1c0f7a11")
READ_BYTES = 1 << 20
#: Payloads that a task remembers, so that it needn't send their later copies.
SEEN = 1 << 16


def gzip_member(data: bytes) -> bytes:
    """A gzip member without name or time."""
    packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def mark(url: str | None) -> int:
    """A 64-bit mark of a url, so that decisions need not carry it."""
    return 0 if url is None else int.from_bytes(hashlib.blake2b(url.encode(), digest_size=8).digest(), "big", signed=True)


def record_id(page_id: int | None, url_mark: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url_mark} {payload_digest}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, of: str, length: int, refers_to: tuple[int | None, int] | None) -> bytes:
    """A record, compressed; ``refers_to`` is the response's page_id and url mark for a revisit."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, mark(url), of + ' revisit' * (refers_to is not None))}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{of}")
    head.append(f"WARC-Block-Digest: sha1:{digest(block)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(*refers_to, of)}", f"X-Refers-To-Page: {'' if refers_to[0] is None else refers_to[0]}"]
    head += [f"X-Page: {'' if page_id is None else page_id}", f"X-Payload-Length: {length}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip_member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


#: Characters that stay as they are in a target URI; all others are percent-encoded.
_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def _revisit(page_id: int | None, url: str | None, sha1: bytes, length: int, first_page: int | None, first_mark: int) -> bytes:
    return _record(page_id, url, b"", base64.b32encode(sha1).decode(), length, (first_page, first_mark))


class _Seen:
    """Whether a task has had a payload with a smaller key, which then is no response; remembers the last ``SEEN``."""

    def __init__(self):
        self.least: OrderedDict[bytes, tuple] = OrderedDict()

    def smaller(self, sha1: bytes, key: tuple) -> bool:
        before = self.least.pop(sha1, None)
        self.least[sha1] = key if before is None else min(before, key)
        if len(self.least) > SEEN:
            self.least.popitem(last=False)
        return before is not None and before <= key


def _key(page_id: int | None, url_mark: int, sha1: bytes) -> tuple:
    """The place of a record in the order of all records; compares as Spark does."""
    return page_id is None, page_id or 0, url_mark, sha1


def _sizes(pages: DataFrame, least: int) -> DataFrame:
    """Per page what decisions need: ids, digest, length, and the compressed lengths as a response and as a revisit.

    A revisit's is that with a response of the longest id and mark. A payload's later
    copies in a task have no ``size``. Of payloads shorter than ``least``, which are all
    responses, the compressed record itself goes along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for piece in slices(batch, "html"):
                out = []
                for page_id, url, html in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    payload = b"" if html is None else html.encode()
                    sha1, url_mark, n = hashlib.sha1(payload).digest(), mark(url), len(payload)
                    copy = n >= least and seen.smaller(sha1, _key(page_id, url_mark, sha1))
                    record = None if copy else _record(page_id, url, payload, base64.b32encode(sha1).decode(), n, None)
                    size = None if copy else len(record)
                    out.append((page_id, url, url_mark, sha1, n, size, len(_revisit(page_id, url, sha1, n, None, -(1 << 63))), record if n < least else None))
                names = ["page_id", "url", "url_mark", "sha1", "length", "size", "revisit", "small"]
                types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return map_batches(pages, run, "page_id long, url string, url_mark long, sha1 binary, length long, size long, revisit long, small binary")


def _bodies(pages: DataFrame, least: int, starts) -> DataFrame:
    """(file_no, page_id, url_mark, sha1, record): each compressed response, of payloads of ``least`` bytes on.

    ``starts`` is the broadcast list of the files' first keys and numbers. What a task
    has had with a smaller key is no response and isn't sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for piece in slices(batch, "html"):
                out = []
                for page_id, url, html in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    payload = b"" if html is None else html.encode()
                    if len(payload) < least:
                        continue
                    sha1, url_mark = hashlib.sha1(payload).digest(), mark(url)
                    key = _key(page_id, url_mark, sha1)
                    if not seen.smaller(sha1, key):
                        file_no = starts.value[bisect(starts.value, key, key=lambda s: s[0]) - 1][1]
                        out.append((file_no, page_id, url_mark, sha1, _record(page_id, url, payload, base64.b32encode(sha1).decode(), len(payload), None)))
                if out:
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["file_no", "page_id", "url_mark", "sha1", "record"])

    return map_batches(pages, run, "file_no int, page_id long, url_mark long, sha1 binary, record binary")


def plan(pages: DataFrame, least: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Per distinct record (page_id, url, sha1) and file that holds some of its copies, what the writer needs.

    ``head`` tells that its first copy lies in the file, ``copies`` how many further ones;
    ``shared`` that payloads are shared, ``response`` that the first copy is the response.
    """
    sizes = cut(_sizes(pages, least).groupBy("page_id", "url", "url_mark", "sha1", "length", "revisit").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("small").alias("record")), "sizes")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("url_mark").alias("mark"))
    several = sizes.where(F.col("length") >= least).groupBy("sha1").agg(F.min(order).alias("first"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    shared = F.col("first").isNotNull()
    response = ~shared | (F.col("page_id").eqNullSafe(F.col("first.page")) & (F.col("url_mark") == F.col("first.mark")))
    decided = sizes.join(several, "sha1", "left").select(
        "page_id", "url", "url_mark", "sha1", "length", "n", "record", shared.alias("shared"), response.alias("response"), F.when(shared, F.col("first.page")).alias("first_page"), F.col("first.mark").alias("first_mark"),
        F.when(response, F.col("size")).otherwise(F.col("revisit")).alias("one"), F.when(shared, F.col("revisit")).otherwise(F.col("size")).alias("more"),
    )
    total = F.col("one") + (F.col("n") - 1) * F.col("more")
    summed = with_sums(decided.withColumn("total", total), [F.col("page_id").asc_nulls_last(), F.col("url_mark").asc(), F.col("sha1").asc()], "total", "position", "before")
    roll, more_from = F.lit(roll_bytes), F.col("before") + F.col("one")
    own = F.floor(F.col("before") / roll)
    last = F.when(F.col("n") > 1, F.floor((more_from + (F.col("n") - 2) * F.col("more")) / roll)).otherwise(own)

    def begun(file_no):
        """How many of the further copies begin before a file."""
        return F.least(F.greatest(F.ceil((file_no * roll - more_from) / F.col("more")), F.lit(0)), F.col("n") - 1)

    spread = summed.withColumn("own", own).withColumn("file_no", F.explode(F.sequence("own", last)))
    facts = ["page_id", "url", "url_mark", "sha1", "length", "shared", "response", "first_page", "first_mark", "record"]
    return spread.select(F.col("file_no").cast("int").alias("file_no"), *facts, (F.col("file_no") == F.col("own")).alias("head"), (begun(F.col("file_no") + 1) - begun(F.col("file_no"))).cast("long").alias("copies"))


def write_warc(pages: DataFrame, path: str, least: int = 0, roll_bytes: int = ROLL_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives of ``pages`` to ``path``; returns the manifest: file_no, name, n_records, bytes, sha1."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    decisions = cut(plan(rows, least, roll_bytes), "plan")
    key = F.struct(F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("page"), "url_mark", "sha1")
    files = decisions.groupBy("file_no").agg(F.min(F.when(F.col("head"), key)).alias("start")).orderBy("file_no").collect()  # a row for each file
    starts = [((r.start.none, r.start.page, r.start.url_mark, bytes(r.start.sha1)), r.file_no) for r in files if r.start is not None]
    bodies = _bodies(rows, least, pages.sparkSession.sparkContext.broadcast(starts))
    both = decisions.withColumn("kind", F.lit(0)).unionByName(bodies.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    n_files = files[-1].file_no + 1 if files else 1
    dealt = both.repartitionById(n_files, "file_no").sortWithinPartitions(F.col("page_id").asc_nulls_last(), "url_mark", "sha1", "kind")
    manifest = map_batches(dealt, _writer(path), "file_no int, name string, n_records long, bytes long, sha1 string")
    manifest.write.parquet(f"{path}/_manifest")
    sweep(path)
    return pages.sparkSession.read.parquet(f"{path}/_manifest")


def _writer(path: str):
    """A task's rows are those of one file: each record's decision, then its body where it has one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        temporary = f"{root}/{TEMPORARY}{uuid.uuid4().hex}"
        sink = file_no = waiting = None
        n, size, hashed = 0, 0, hashlib.sha1()

        def add(data: bytes, times: int = 1) -> None:
            nonlocal n, size
            for _ in range(times):
                sink.write(data)
                hashed.update(data)
            n, size = n + times, size + times * len(data)

        def copies(r: dict, data: bytes | None) -> None:
            if r["copies"]:
                add(_revisit(r["page_id"], r["url"], r["sha1"], r["length"], r["first_page"], r["first_mark"]) if r["shared"] else data, r["copies"])

        for batch in batches:
            for piece in slices(batch, "record"):
                for r in piece.to_pylist():
                    if sink is None:
                        fs.create_dir(root)
                        file_no, sink = r["file_no"], fs.open_output_stream(temporary, compression=None)
                    same = waiting and (waiting["page_id"], waiting["url_mark"], waiting["sha1"]) == (r["page_id"], r["url_mark"], r["sha1"])
                    if r["kind"]:
                        if same:
                            add(r["record"])
                            copies(waiting, r["record"])
                            waiting = None
                    elif waiting:
                        raise ValueError(f"page {waiting['page_id']} has no body")
                    elif r["head"] and r["response"] and r["record"] is None:
                        waiting = r
                    else:
                        if r["head"]:
                            add(r["record"] if r["response"] else _revisit(r["page_id"], r["url"], r["sha1"], r["length"], r["first_page"], r["first_mark"]))
                        copies(r, r["record"])
        if waiting:
            raise ValueError(f"page {waiting['page_id']} has no body")
        if sink is not None:
            sink.close()
            name = f"part-{file_no:08d}.warc.gz"
            fs.move(temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"file_no": file_no, "name": name, "n_records": n, "bytes": size, "sha1": hashed.hexdigest()}], schema=pa.schema([("file_no", pa.int32()), ("name", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    return write


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an open archive, one member in memory at a time."""
    left, out, packed = b"", [], zlib.decompressobj(31)
    while True:
        data = left or source.read(READ_BYTES)
        if not data:
            return
        out.append(packed.decompress(data))
        left = packed.unused_data if packed.eof else b""
        if packed.eof:
            head, _, rest = b"".join(out).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            yield headers, rest[: int(headers["content-length"])]
            out, packed = [], zlib.decompressobj(31)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archives that the manifest names: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    The digests of blocks and of a response's payload are compared with its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for h, block in records(source):
                        of = h["warc-payload-digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2]
                        if digest(block) != h["warc-block-digest"].removeprefix("sha1:") or h["warc-type"] == "response" and (digest(payload), len(payload)) != (of, int(h["x-payload-length"])):
                            raise ValueError(f"{name}: a record differs from its digest")
                        number = lambda k, h=h: int(h[k]) if h.get(k) else None
                        rows.append({"page_id": number("x-page"), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload_bytes": int(h["x-payload-length"]), "payload_digest": of, "refers_to": number("x-refers-to-page")})
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    manifest = spark.read.parquet(f"{path}/_manifest")
    files = manifest.select("name").repartition(max(1, manifest.count()))
    return map_batches(files, read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` to new archives in the shared folder and reads them back."""
    path = new_dir(pages.sparkSession, "warc")
    write_warc(pages, path, least)
    return read_warc(pages.sparkSession, path)
