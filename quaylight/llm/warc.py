"""WARC archives: a Spark-written archive and a Python data source to read it.

Files are plain WARC/1.1: a record is its header lines, a blank line, the
payload and two line ends, which is just what Spark's text writer makes with
those line ends as its separator, so any file system that Spark writes will do.
The reader plans a partition a file, takes filters on record type and headers,
parses headers first and passes over payloads that nobody asked for.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .common import shared_dir, small, stored, table

CRLF = "\r\n"
#: Revisits by equal payload digest, as in the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read from a file at a time.
BLOCK = 1 << 20

#: Column of the data source -> WARC header.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "date": "WARC-Date"}


class Payload(io.RawIOBase):
    """A file of records, plain or gzip (one member or many), as one byte stream."""

    def __init__(self, raw):
        self.raw, self.buf, self.pos, self.gz = raw, b"", 0, None
        if (head := raw.read(2)) == b"\x1f\x8b":
            self.gz = zlib.decompressobj(31)
        self.ahead = head

    def _more(self) -> bool:
        data, self.ahead = self.ahead + self.raw.read(BLOCK), b""
        if not data:
            return False
        out = b""
        if self.gz is None:
            out = data
        while self.gz is not None and data:
            out += self.gz.decompress(data)
            data = self.gz.unused_data
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
        self.buf, self.pos = self.buf[self.pos :] + out, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next mark, which is passed; None at the end."""
        seen = self.pos
        while (at := self.buf.find(mark, seen)) < 0:
            kept = max(0, len(self.buf) - self.pos - len(mark) + 1)
            if not self._more():
                return None
            seen = kept
        out, self.pos = self.buf[self.pos : at], at + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n > len(self.buf) - self.pos:
            parts.append(self.buf[self.pos :])
            n -= len(parts[-1])
            self.buf, self.pos = b"", 0
            if not self._more():
                raise ValueError("archive ends inside a record")
        parts.append(self.buf[self.pos : self.pos + n])
        self.pos += n
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Passes n bytes without keeping them; a plain file is sought."""
        held = len(self.buf) - self.pos
        if n <= held:
            self.pos += n
            return
        n -= held
        self.buf, self.pos = b"", 0
        if self.gz is None:
            self.raw.seek(n - len(self.ahead), 1)
            self.ahead = b""
            return
        while n:
            if not self._more():
                raise ValueError("archive ends inside a record")
            step = min(n, len(self.buf))
            self.pos, n = step, n - step


def records(stream: Payload, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records that ``wanted(headers)`` approves; it
    returns None to pass a record over, else whether to read its payload."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n, said = int(headers["content-length"]), wanted(headers)
        if said:
            yield headers, stream.take(n)
        else:
            stream.skip(n)
            if said is not None:
                yield headers, None
        stream.skip(4)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.path, self.mode = options["path"], options.get("payload", "digest")
        self.names = [f.name for f in schema.fields]
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                header = HEADERS[f.attribute[0]].lower()
                self.equal[header] = self.equal.get(header, asked) & asked
            else:
                yield f

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [_File(f"{self.path.rstrip('/')}{x.path[len(root.rstrip('/')) :]}") for x in sorted(found, key=lambda x: x.path) if x.is_file and x.size and not x.base_name.startswith(("_", "."))]

    def read(self, part):
        if part is None:  # no file, no partition
            return
        fs, path = pafs.FileSystem.from_uri(part.path)

        def wanted(headers):
            if any(headers.get(k) not in v for k, v in self.equal.items()):
                return None
            return self.mode != "none" and headers.get("warc-type") != "revisit"

        with fs.open_input_file(path) as f:
            rows, held = [], 0
            for headers, payload in records(Payload(f), wanted):
                # Fixed columns first: header values, then what comes of the payload.
                row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                row |= {"length": int(headers["content-length"]), "payload_bytes": None, "payload_sha256": None, "payload": None}
                if payload is not None:
                    body = payload.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else payload
                    row |= {"payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest()} | ({"payload": body} if self.mode == "bytes" else {})
                rows.append(tuple(row[n] for n in self.names))
                held += len(row["payload"] or b"") + 500
                if held > 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows):
        kinds = {"length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(self.names, cols, strict=True)], self.names)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "none|digest|bytes").load(path)``"""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return ", ".join(f"{c} string" for c in HEADERS) + ", length long, payload_bytes long, payload_sha256 string, payload binary"

    def reader(self, schema):
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, payload: str = "digest") -> DataFrame:
    """Records of the archives under a folder, on any file system that pyarrow
    opens. ``payload`` says whether payloads are passed over, digested or returned.
    An empty folder gives no rows; a truncated record fails the read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def write_warc(pages: DataFrame, path: str, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html).

    Of rows whose payloads of at least ``least`` bytes are equal, the one with the
    smallest page_id is a response and the others are revisits that refer to it,
    without the payload; repeated page_ids in such a group make one response each.
    Null html is an empty payload, a null url an empty target; a null page_id is
    named "null" and, last in order, refers like any other. Payload texts are
    never shuffled: digests are, and revisits alone are joined back.
    """
    spark = pages.sparkSession
    body = F.coalesce("html", F.lit(""))
    digest = F.sha2(body.cast("binary"), 256)
    keyed = pages.select(F.col("page_id"), body.alias("_body"), F.coalesce("url", F.lit("")).alias("_url"), digest.alias("_digest"), F.octet_length(body).alias("_n"))
    same = keyed.where(F.col("_n") >= least).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    same = stored(same.select("_digest", "_first"), "copies")
    all_ = keyed.join(small(same), "_digest", "left").withColumn("_revisit", F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")))
    uid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    none = F.lit("")
    clean = F.regexp_replace("_url", r"[\r\n]", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("_revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", uid(F.col("page_id"))),
        line("WARC-Target-URI", clean),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        F.when(F.col("_revisit"), F.concat(line("WARC-Refers-To", uid(F.col("_first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(none),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("_revisit"), F.lit(0)).otherwise(F.col("_n")).cast("string")),
        F.lit(CRLF),
    )
    all_.select(F.concat(head, F.when(F.col("_revisit"), none).otherwise(F.col("_body"))).alias("value")).write.option("lineSep", CRLF * 2).text(path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path).select("record_id", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload_sha256")
    own = found.where(F.col("record_type") == "response").select("record_id", "record_type", F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload_sha256")
    again = read_warc(spark, path, "none").where(F.col("record_type") == "revisit").select("record_id", "record_type", "refers_to", F.expr("substring_index(payload_digest, ':', -1)").alias("digest"))
    # A page_id may repeat, so a revisit is of an id and a digest. The join's key is another
    # than that of distinct: adaptive execution can split the revisits of one page.
    whole = own.select(F.col("record_id").alias("of"), "payload_bytes", F.col("payload_sha256").alias("sha")).distinct().withColumn("_key", F.reverse("sha"))
    again = again.withColumn("_key", F.reverse("digest")).join(whole, "_key").where("refers_to = of")
    both = own.unionByName(again.select("record_id", "record_type", "refers_to", "payload_bytes", F.col("sha").alias("payload_sha256")))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return both.select(as_id("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha256").alias("payload_digest"), "record_type", as_id("refers_to").alias("refers_to"))
