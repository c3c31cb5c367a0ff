"""WARC archives of pages: gzip members, revisit records for equal payloads, and a splittable reader.

Writing: equal payloads of at least MIN_REVISIT bytes are found by their digest (summed per task first); the smallest
page_id keeps the payload, the others become revisit records that name it. Every task writes its own archives
to the shared folder under a name no other attempt uses, and reports them; only reported archives are read, so a
repeated task does no harm.

Reading: the archives are cut into byte ranges, whatever lies at their edges. A task looks in its range for gzip
magic, accepts a candidate once it inflates to a WARC header, and from there goes member by member. It owns the
records that start inside its range, and reads past the end to finish the last one. Digests and sizes come from the
payload bytes; a revisit names a response and its own payload's digest, and is resolved by both.

Damage is an error, not a loss: every archive must give as many records as its manifest says, every payload must have its
digest, and every revisit must find the response that it names.

Defined cases: null html is an empty payload; payloads below MIN_REVISIT are never revisits; rows that repeat a
page_id all get a record, and of several with the same payload and smallest page_id each is a response; page ids may be of any
type that Spark casts to a string and back; urls come back as they were, null ones and escapes included; a null page_id
is kept as null and comes last: among equal payloads it is a revisit of any other, and a response where all are null; an
empty table writes no archive and gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, scratch_path, sized, small, stage

MIN_REVISIT = 100
#: Archives are closed beyond so many bytes; a reading task takes ranges of SPLIT bytes.
ARCHIVE_BYTES, SPLIT = 256 << 20, 4 << 20
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_ESCAPE = re.compile("%(25|0D|0A)")


def _plain(value: str) -> str:
    """What _line was given."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), value)


def _line(name: str, value: str) -> bytes:
    clean = value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {clean}\r\n".encode("utf-8", "surrogatepass")


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member; ids are written as strings."""
    head = b"WARC/1.1\r\n"
    head += _line("WARC-Type", "response" if refers_to is None else "revisit")
    head += _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>")
    head += _line("WARC-Date", _DATE)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    head += _line("WARC-Payload-Digest", f"sha256:{digest}")
    if page_id is not None:
        head += _line("X-Page-Id", page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
    else:
        head += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += _line("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>")
        head += _line("X-Refers-To-Page-Id", refers_to)
    head += _line("Content-Type", "application/http; msgtype=response")
    head += _line("Content-Length", str(len(block)))
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """(path, n_bytes, n_records) of the archives written under `folder`, a URI."""
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    big = base.filter(F.octet_length("payload") >= MIN_REVISIT)
    groups = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    groups = stage(groups, "equal-payloads")
    marked = base.join(sized(groups, groups.count(), 128), "digest", "left")
    marked = marked.select("page_id", "url", "payload", "digest", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))
    marked = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, path, size, n = None, "", 0, 0
        for b in small(batches, 2):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = record(*r)
                out.write(member)
                size, n = size + len(member), n + 1
                if size > ARCHIVE_BYTES:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))], ["path", "n_bytes", "n_records"])

    return stage(marked.mapInArrow(run, "path string, n_bytes long, n_records long"), "manifest")


def _header(raw: bytes) -> dict[str, str] | None:
    """The header lines of an inflated record, if it is one."""
    if not raw.startswith(b"WARC/1."):
        return None
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    pairs = (x.split(b": ", 1) for x in raw[:end].split(b"\r\n")[1:])
    found = {k.decode("utf-8", "surrogatepass").lower(): v.decode("utf-8", "surrogatepass") for k, v in (p for p in pairs if len(p) == 2)}
    return found | {"": str(end + 4)} if "warc-type" in found and "content-length" in found else None


class _Window:
    """A moving view of a file from an offset on; `used` bytes of its data are behind it."""

    def __init__(self, source, at: int):
        self.source, self.start, self.data, self.used, self.ended = source, at, bytearray(), 0, False
        source.seek(at)

    @property
    def at(self) -> int:
        return self.start + self.used

    def more(self) -> bool:
        got = b"" if self.ended else self.source.read(_READ)
        self.ended = self.ended or not got
        if self.used >= _READ:  # what is behind goes once it is as long as a read
            del self.data[: self.used]
            self.start, self.used = self.start + self.used, 0
        self.data += got
        return bool(got)


def _inflate(w: _Window) -> tuple[bytes, int] | None:
    """(content, length of the member) of the gzip member at the window's place; None if there is none."""
    z, out, length = zlib.decompressobj(31), [], 0
    while True:
        if w.used + length >= len(w.data) and not w.more():
            return None
        part = bytes(w.data[w.used + length : w.used + length + 65536])
        try:
            # a candidate is judged by its first bytes
            out.append(z.decompress(part) if out else z.decompress(part, 64))
            if len(out) == 1:
                if len(out[0]) >= 7 and not out[0].startswith(b"WARC/1."):
                    return None
                if z.unconsumed_tail:
                    out.append(z.decompress(z.unconsumed_tail))
        except zlib.error:
            return None
        length += len(part)
        if z.eof:
            return b"".join(out), length - len(z.unused_data)


def records_from(source, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of the records that start at an offset in [start, end)."""
    w = _Window(source, start)
    while w.at < end:
        found = w.data.find(_MAGIC, w.used)
        if found < 0:
            w.used = max(w.used, len(w.data) - 2)
            if not w.more():
                return
            continue
        w.used = found
        if w.at >= end:
            return
        got = _inflate(w)
        head = _header(got[0]) if got else None
        if head is None:
            w.used += 1
            continue
        begin = int(head[""])
        yield head, got[0][begin : begin + int(head["content-length"])]
        w.used += got[1]


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """path, page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest of every record as stored; ids are strings."""
    ranges = manifest.filter("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, F.col("n_bytes")).alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(folder)[0]
        names = ["path", "page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(path) as source:
                    for head, block in records_from(source, start, stop):
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                        page, first, url = (_plain(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id", "warc-target-uri"))
                        if head["warc-type"] == "response":
                            digest = hashlib.sha256(payload).hexdigest()
                            if head["warc-payload-digest"] != f"sha256:{digest}":
                                raise ValueError(f"{path}: the payload of page {page} does not match its digest")
                            rows.append((path, page, url, "response", None, payload, len(payload), digest))
                        else:
                            rows.append((path, page, url, "revisit", first, None, None, head["warc-payload-digest"].removeprefix("sha256:")))
                        held += len(payload)
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield flush()
                            rows, held = [], 0
        yield flush()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ranges.repartition(n, "path", "start")
    return dealt.mapInArrow(run, "path string, page_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string")


def check_complete(read: DataFrame, manifest: DataFrame) -> None:
    """An error where an archive gave another number of records than its manifest says."""
    got = read.groupBy("path").agg(F.count("*").alias("got"))
    bad = manifest.filter("n_records > 0").join(got, "path", "left").filter(F.coalesce("got", F.lit(0)) != F.col("n_records")).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['path']}: {bad[0]['got'] or 0} of {bad[0]['n_records']} records can be read")


def round_trip(pages: DataFrame, split: int = SPLIT) -> DataFrame:
    """Writes the pages, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    if "://" not in folder:
        folder = "file://" + folder
    manifest = write_warc(pages, folder)
    read = stage(read_warc(spark, manifest, folder, split).drop("payload", "url"), "records")
    check_complete(read, manifest)
    drop_path(spark, folder)
    return resolved(read, pages.schema["page_id"].dataType.simpleString())


def resolved(read: DataFrame, kind: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records as read; ids of the given type.

    A revisit takes its size from the response with the page_id and the digest that it names; one without is an error.
    """
    own = read.filter("record_type = 'response'")
    again = read.filter("record_type = 'revisit'").drop("payload_bytes")
    asked = again.groupBy(F.col("refers_to").alias("first"), F.col("payload_digest").alias("digest")).agg(F.count("*").alias("n"))
    # several responses may have the page_id and the digest: they are the same payload
    first = own.join(asked, F.col("page_id").eqNullSafe(F.col("first")) & (F.col("payload_digest") == F.col("digest"))).groupBy("first", "digest").agg(F.min("payload_bytes").alias("payload_bytes"))
    full = again.join(sized(first, again.count(), 128), F.col("refers_to").eqNullSafe(F.col("first")) & (F.col("payload_digest") == F.col("digest")), "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce("page_id", F.lit("null")))).cast("long")
    full = full.withColumn("payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(lost))
    names = [F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")]
    return own.select(names).unionByName(full.select(names))
