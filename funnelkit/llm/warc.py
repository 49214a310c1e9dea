"""WARC archives through a chunked record table.

1. *Chunked record table*: each page becomes rows (record, chunk number) of at
   most `chunk_bytes` payload bytes, cut in the JVM. The rows stream through one
   map that updates a SHA-1 and a content digest chunk by chunk; each row
   carries the digests and the length so far, so the last row of a record has
   those of its whole payload, and no task holds a whole payload in Python or in
   a shuffle row. The table is written once to the shared folder.
2. *Revisits*: the last rows alone (digests, no payload) are grouped by content;
   the smallest page_id of a group is its response. Contents with many records
   are joined from a broadcast list whose length is checked, the others by key.
3. *Archives*: every chunk row becomes one WARC 1.1 record, made by SQL
   functions: `response` (with an HTTP head), `revisit` (the head alone) or, from the
   second chunk on, `continuation` with segment number and origin. Spark's text
   sink writes them as gzip files: its commit protocol keeps one attempt of each
   file, and any store that Spark reaches will do.
4. *Reading back*: gzip files are not split, so a task sees the lines of whole
   archives in order; a parser follows Content-Length, joins segments, digests
   payloads as they pass and raises on a damaged record.

Defined results: a null html is an empty payload; a null or repeated page_id
keeps its records (ties go to the record read first, null ids come last); a
null url writes no target; line breaks, blanks and control characters in a url
are percent-encoded; other columns are ignored; an empty table gives empty
archives and an empty result. Payloads are taken as equal when length, SHA-1 and
SHA-256 agree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import join_by_group, saved
from funnelkit.session import scratch_path

CHUNK_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = ("rec bigint, page_id bigint, url string, chunk_no int, last boolean, data binary,"
          " so_far bigint, sha1 string, sha256 binary")
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


# ------------------------------------------------------------- chunk rows

def chunk_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(rec, page_id, url, chunk_no, last, data): payloads cut into chunks; an empty one has one empty chunk."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    whole = pages.select(F.monotonically_increasing_id().alias("rec"), F.col("page_id").cast("bigint").alias("page_id"),
                         F.col("url").cast("string").alias("url"), payload.alias("payload"))
    last = F.greatest(F.ceil(F.length("payload") / F.lit(chunk_bytes)) - 1, F.lit(0)).cast("int")
    cut = whole.withColumn("n_last", last).select("*", F.explode(F.sequence(F.lit(0), F.col("n_last"))).alias("chunk_no"))
    return cut.select(
        "rec", "page_id", "url", "chunk_no", (F.col("chunk_no") == F.col("n_last")).alias("last"),
        F.substring(F.col("payload"), F.col("chunk_no") * F.lit(chunk_bytes) + 1, F.lit(chunk_bytes)).alias("data"))


def _carry_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds length and digests so far; the chunks of a record follow each other."""
    sha1 = sha256 = None
    so_far = 0
    for batch in batches:
        lengths, short, full = [], [], []
        for chunk_no, data in zip(batch.column("chunk_no").to_pylist(), batch.column("data")):
            view = data.as_buffer()
            if chunk_no == 0:
                sha1, sha256, so_far = hashlib.sha1(), hashlib.sha256(), 0
            sha1.update(view)
            sha256.update(view)
            so_far += view.size
            lengths.append(so_far)
            short.append(base64.b32encode(sha1.digest()).decode())
            full.append(sha256.digest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(lengths, pa.int64()), pa.array(short, pa.string()), pa.array(full, pa.binary())],
            names=[*batch.schema.names, "so_far", "sha1", "sha256"])


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table, written to the shared folder."""
    return saved(chunk_rows(pages, chunk_bytes).mapInArrow(_carry_digests, CHUNKS), "warc-chunks", "zstd")


# ------------------------------------------------------------- responses and revisits

def decide(chunks: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(rec, n_bytes, digest, first_rec, first_page): the response a record revisits, null where it is one."""
    heads = chunks.where("last").select("rec", "page_id", F.col("so_far").alias("n_bytes"), "sha1", "sha256")
    contents = saved(
        heads.where(F.col("n_bytes") >= min_revisit_bytes).groupBy("n_bytes", "sha1", "sha256").agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rec")).alias("first"))
        .where("copies > 1"), "warc-contents")
    lookup = contents.select("n_bytes", "sha1", "sha256", "copies", F.col("first.rec").alias("first_rec"),
                             F.col("first.page_id").alias("first_page"))
    joined = join_by_group(heads, lookup, ["n_bytes", "sha1", "sha256"], "copies")
    again = F.col("first_rec") != F.col("rec")
    return joined.select("rec", "n_bytes", F.col("sha1").alias("digest"),
                         F.when(again, F.col("first_rec")).alias("first_rec"),
                         F.when(again, F.col("first_page")).alias("first_page"))


# ------------------------------------------------------------- records as SQL functions

def _urn(page: str, rec: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.col(rec).cast("string"), F.lit(":"),
                    F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column | str, when: Column | None = None) -> Column:
    line = F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))
    return F.coalesce(line if when is None else F.when(when, line), F.lit(""))


def _clean_url() -> Column:
    """The url without bytes that would end or break a header line."""
    out = F.col("url")
    for code in [*range(0x21), 0x7F]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def records(chunks: DataFrame, decisions: DataFrame, date: str = DATE) -> DataFrame:
    """(rec, chunk_no, value): one WARC record a row; the line feed that ends it is the text sink's."""
    rows = chunks.select("rec", "page_id", "url", "chunk_no", "last", "data").join(decisions, "rec")
    rows = rows.where(F.col("first_rec").isNull() | (F.col("chunk_no") == 0))
    revisit, first = F.col("first_rec").isNotNull(), F.col("chunk_no") == 0
    segmented = ~revisit & ~(first & F.col("last"))
    origin = _urn("page_id", "rec")
    http = F.when(first, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                                  F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))).otherwise(F.lit(""))
    data = F.when(revisit, F.lit(b"")).otherwise(F.col("data"))
    kind = F.when(revisit, F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation"))
    number = (F.col("chunk_no") + 1).cast("string")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.when(first, origin).otherwise(F.concat(F.rtrim(origin, F.lit(">")), F.lit(":"), number, F.lit(">")))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", _clean_url()),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        _line("WARC-Profile", PROFILE, revisit),
        _line("WARC-Refers-To", _urn("first_page", "first_rec"), revisit),
        _line("WARC-Segment-Number", number, segmented),
        _line("WARC-Segment-Origin-ID", origin, segmented & ~first),
        _line("WARC-Segment-Total-Length", F.col("n_bytes").cast("string"), segmented & F.col("last")),
        _line("Content-Type", "application/http; msgtype=response", first),
        _line("Content-Length", (F.length(http) + F.octet_length(data)).cast("string")),
        F.lit("\r\n"), http)
    value = F.concat(F.encode(head, "UTF-8"), data, F.lit(b"\r\n\r")).cast("string")
    return rows.select("rec", "chunk_no", value.alias("value"))


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = 0,
                   date: str = DATE) -> None:
    """Writes `pages` (page_id, url, html) as gzip WARC files into the folder `path`."""
    chunks = chunk_table(pages, chunk_bytes)
    rows = records(chunks, decide(chunks, min_revisit_bytes), date)
    (rows.sortWithinPartitions("rec", "chunk_no").select("value")
     .write.option("compression", "gzip").option("lineSep", "\n").text(path))


# ------------------------------------------------------------- reading back

class _Parser:
    """Follows the records of a byte stream; keeps a partial head, never a payload."""

    def __init__(self) -> None:
        self.rest, self.state, self.left = b"", "warc", 0
        self.fields: dict[str, str] = {}
        self.record: dict | None = None

    def feed(self, data: bytes) -> Iterator[tuple]:
        data, at = self.rest + data if self.rest else data, 0
        view = memoryview(data)
        while at < len(data) or (self.state == "payload" and self.left == 0):
            if self.state == "payload":
                n = min(self.left, len(data) - at)
                self.record["sha1"].update(view[at:at + n])
                self.record["bytes"] += n
                self.left, at = self.left - n, at + n
                if self.left:
                    break
                self.state = "end"
                continue
            if self.state == "end":
                if len(data) - at < 4:
                    break
                if data[at:at + 4] != b"\r\n\r\n":
                    raise ValueError(f"record {self.fields.get('WARC-Record-ID')} does not end where Content-Length says")
                at, self.state = at + 4, "warc"
                if row := self._ended():
                    yield row
                continue
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                break
            head, at = data[at:end], end + 4
            if self.state == "warc":
                self._begin(head.decode())
            else:  # the HTTP head of a response or revisit
                self.left -= len(head) + 4
                self.state = "payload"
                self.record["length"] = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
        self.rest = data[at:]

    def _begin(self, head: str) -> None:
        version, *lines = head.split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record starts with {version[:40]!r}")
        self.fields = dict(line.split(": ", 1) for line in lines)
        self.left = int(self.fields["Content-Length"])
        if self.fields["WARC-Type"] == "continuation":
            if self.record is None or self.record["id"] != self.fields["WARC-Segment-Origin-ID"]:
                raise ValueError(f"{self.fields['WARC-Record-ID']} continues no open record")
            self.state = "payload"
        else:
            if self.record is not None:
                raise ValueError(f"{self.record['id']} lacks its last segment")
            self.record = {"id": self.fields["WARC-Record-ID"], "sha1": hashlib.sha1(), "bytes": 0,
                           "digest": self.fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                           "type": self.fields["WARC-Type"], "refers": self.fields.get("WARC-Refers-To")}
            self.state = "http"
        if self.record["type"] == "revisit":
            self.state = "http"

    def _ended(self) -> tuple | None:
        if "WARC-Segment-Number" in self.fields and "WARC-Segment-Total-Length" not in self.fields:
            return None
        r, self.record = self.record, None
        if r["type"] == "revisit":
            return _page(r["id"]), r["length"], r["digest"], "revisit", _page(r["refers"])
        if r["bytes"] != r["length"]:
            raise ValueError(f"the payload of {r['id']} does not have its length")
        if base64.b32encode(r["sha1"].digest()).decode() != r["digest"]:
            raise ValueError(f"the payload of {r['id']} does not have its digest")
        return _page(r["id"]), r["bytes"], r["digest"], "response", None

    def close(self) -> None:
        if self.rest or self.record is not None:
            raise ValueError("the archive ends inside a record")


def _page(urn: str) -> int | None:
    page = urn.strip("<>").rsplit(":", 1)[1]
    return int(page) if page else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parser = _Parser()
    for batch in batches:
        lines = batch.column("value").cast(pa.binary()).to_pylist()
        rows = list(parser.feed(b"\n".join(lines) + b"\n")) if lines else []
        if rows:
            page, size, digest, kind, refers = zip(*rows)
            yield pa.record_batch({
                "page_id": pa.array(page, pa.int64()), "payload_bytes": pa.array(size, pa.int64()),
                "payload_digest": pa.array(digest, pa.string()), "record_type": pa.array(kind, pa.string()),
                "refers_to": pa.array(refers, pa.int64())})
    parser.close()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives in `path` (see RECORDS)."""
    lines = spark.read.option("lineSep", "\n").schema("value string").text(path)
    return lines.mapInArrow(_parse, RECORDS)


def roundtrip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the archives of `pages` to a fresh shared folder and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, chunk_bytes, min_revisit_bytes)
    return read_archives(pages.sparkSession, path)


ORACLE_SQL = """
WITH digests AS (
    SELECT page_id, COALESCE(html, '') AS body, sha1(COALESCE(html, '')) AS hex FROM pages),
coded AS (
    SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS INTEGER), 5) AS BIGINT)
                     >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31), 1) FOR k IN range(32)], '') AS payload_digest,
           MIN(page_id) OVER (PARTITION BY body) AS first_page
    FROM digests)
SELECT page_id, strlen(body) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM coded
"""
