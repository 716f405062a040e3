"""WARC archives as a chunked record table.

Writing: each page becomes a WARC/1.1 record. Payloads over ``chunk`` bytes go out as segments (a first
record and continuation records with segment numbers), so no row holds more than a chunk. The text
writer's line separator is the record terminator, which makes its part files gzip-compressed WARC files
on any storage Spark can write.

Reading: the files are streamed back block by block into rows (record id, chunk number, bytes, bytes so
far, digest so far). The digest is carried from chunk to chunk, so no record is ever held whole; the row
marked last has the totals and is checked against the declared digest.

Equal payloads of at least ``least`` bytes are stored once, by the page with the largest id; others are
revisit records that refer to it. Equality is by SHA-1 and length.

Cases: a null html is an empty payload; a null url gives no target; a null page id is written as null and,
where its payload is shared, revisits the largest id; repeated rows are each written; an empty table gives
an archive without records. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionmatch.llm.staging import written
from regionmatch.session import scratch_path

CHUNK, LEAST = 1 << 20, 1000
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the archive format.
TERMINATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = TERMINATOR.encode()
_TABLE = ("page_id long, record_type string, refers_to long, chunk_no int, data binary, bytes_so_far long, digest_so_far string, "
          "last boolean, declared string")


def with_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with payload size, digest, and the page that an equal payload is stored under.

    The shared payloads are written out before the join, so that both of its sides are plain exchanges and
    a payload that very many pages have is split over tasks.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha1("html"))
    shared = p.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("many")).filter("many > 1").drop("many")
    shared = written(shared).hint("merge")
    kept = F.col("keeper").isNull() | F.col("page_id").eqNullSafe(F.col("keeper"))
    return p.join(shared, ["digest", "n"], "left").withColumn("refers_to", F.when(~kept, F.col("keeper")))


def _name(page) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block


def segments(page, url, html: bytes, digest: str, refers_to, chunk: int = CHUNK):
    """The records of one page, each with at most ``chunk`` bytes of payload."""
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _name(page)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    if refers_to is not None:
        yield _record([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))], http)
        return
    cuts, view = [0], memoryview(html)
    while cuts[-1] < len(html):
        end = min(len(html), cuts[-1] + chunk)
        while end < len(html) and html[end] & 0xC0 == 0x80 and end > cuts[-1] + 1:
            end -= 1
        cuts.append(end)
    if len(cuts) <= 2:
        yield _record(fields, http + html)
        return
    yield _record([*fields, ("WARC-Segment-Number", "1")], http + bytes(view[: cuts[1]]))
    for k in range(1, len(cuts) - 1):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{_name(page)[:-1]}:{k + 1}>"), ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", _name(page)), ("WARC-Segment-Number", str(k + 1))]
        if k == len(cuts) - 2:
            more.append(("WARC-Segment-Total-Length", str(len(http) + len(html))))
        yield _record(more, bytes(view[cuts[k]:cuts[k + 1]]))


def write_archive(pages: DataFrame, path: str, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Write ``pages`` as .gz part files of WARC records under ``path``."""

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for row in range(batch.num_rows):
                page, url, html, digest, refers = (batch.column(i)[row] for i in range(5))
                raw = html.as_buffer().to_pybytes() if hasattr(html, "as_buffer") else html.as_py().encode()
                for record in segments(page.as_py(), url.as_py(), raw, digest.as_py(), refers.as_py(), chunk):
                    out.append(record)
                    size += len(record)
                    if size > 4 * chunk:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary()).view(pa.string())})
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary()).view(pa.string())})

    rows = with_types(pages, least).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "value string")
    rows.write.option("lineSep", TERMINATOR).option("compression", "gzip").text(path)


class Parser:
    """Bytes of an archive in, chunk rows out. Holds a header, or the pieces of one chunk."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk, self.rows = chunk, []
        self.held, self.left, self.body, self.state = b"", 0, b"", "header"
        self.record = None

    def feed(self, piece: bytes) -> None:
        self.held += piece
        while self._step():
            pass

    def _step(self) -> bool:
        if self.state == "header":
            end = self.held.find(_END)
            if end < 0:
                return False
            self._open(self.held[:end].decode("utf-8", "replace"))
            self.held = self.held[end + 4:]
            return True
        if self.state == "block":
            take = self.held[: self.left]
            if take or not self.left:
                self.held, self.left = self.held[len(take):], self.left - len(take)
                self._payload(take)
            if self.left:
                return False
            self._close()
            self.state = "end"
            return True
        if len(self.held) < 4:
            return False
        self.held, self.state = self.held[4:], "header"
        return True

    def _open(self, head: str) -> None:
        f = dict(line.split(": ", 1) for line in head.split("\r\n")[1:] if ": " in line)
        self.left, self.state = int(f["Content-Length"]), "block"
        self.segment, self.final = int(f.get("WARC-Segment-Number", 0)), "WARC-Segment-Number" not in f or "WARC-Segment-Total-Length" in f
        if f["WARC-Type"] != "continuation":
            number = lambda name: int(m[1]) if (m := re.search(r"x-page:(-?\d+)>", f.get(name, ""))) else None
            self.record = {"page_id": number("WARC-Record-ID"), "record_type": f["WARC-Type"], "refers_to": number("WARC-Refers-To"),
                           "declared": f.get("WARC-Payload-Digest", "").removeprefix("sha1:")}
            self.sha, self.size, self.number, self.http, self.said = hashlib.sha1(), 0, 0, b"", 0
            self.in_http = True

    def _payload(self, piece: bytes) -> None:
        if self.in_http:
            self.http += piece
            end = self.http.find(_END)
            if end < 0:
                return
            said = re.search(rb"(?i)content-length: (\d+)", self.http[:end])
            self.said = int(said[1]) if said else 0
            piece, self.in_http = self.http[end + 4:], False
        self.body += piece
        while len(self.body) > self.chunk:
            self._emit(self.body[: self.chunk], False)
            self.body = self.body[self.chunk:]

    def _emit(self, data: bytes, last: bool) -> None:
        self.sha.update(data)
        self.size += len(data)
        revisit = self.record["record_type"] == "revisit"
        self.rows.append({**self.record, "chunk_no": self.number, "data": data, "bytes_so_far": self.said if revisit else self.size,
                          "digest_so_far": self.record["declared"] if revisit else self.sha.hexdigest(), "last": last})
        self.number += 1

    def _close(self) -> None:
        if self.final or self.body:
            self._emit(self.body, self.final)
            self.body = b""


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives under ``path``."""
    names = [c.split(" ")[0] for c in _TABLE.split(", ")]
    kind = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()),
                      ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("declared", pa.string())])

    def run(batches):
        parser, at = Parser(chunk), None
        for batch in batches:
            lines, files = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                name = files[k].as_py()
                if name != at:
                    parser, at = _ready(parser, chunk), name
                parser.feed(lines[k].as_buffer().to_pybytes() + _END)
                if len(parser.rows) >= 64:
                    yield pa.RecordBatch.from_pydict({n: [r[n] for r in parser.rows] for n in names}, schema=kind)
                    parser.rows.clear()
        if parser.rows:
            yield pa.RecordBatch.from_pydict({n: [r[n] for r in parser.rows] for n in names}, schema=kind)

    lines = spark.read.schema("value string").option("lineSep", TERMINATOR).text(path)
    return lines.select("value", F.input_file_name().alias("file")).mapInArrow(run, _TABLE)


def _ready(old: Parser, chunk: int) -> Parser:
    """A parser for the next file; rows that wait go along."""
    if old.state != "header" or old.held:
        raise ValueError("an archive ends inside a record")
    new = Parser(chunk)
    new.rows = old.rows
    return new


def records(chunks: DataFrame) -> DataFrame:
    """One row a record: the totals carried by its last chunk, checked against the declared digest."""
    same = F.col("digest_so_far") == F.col("declared")
    checked = F.when(same, F.col("digest_so_far")).otherwise(F.raise_error(F.concat(F.lit("digest differs for page "), F.col("page_id").cast("string"))))
    return chunks.filter("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and return the records read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    return records(read_chunks(spark, path))
