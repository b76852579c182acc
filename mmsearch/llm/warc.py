"""WARC archives written through Spark's own file sinks and read from any writer, and revisit resolution.

Every task writes its records as one gzip-compressed WARC/1.1 file (the text sink: a record per row), so
archives are committed, retried and stored as any Spark output. A file begins with a warcinfo record, to whose
id its records refer.

The reader takes archives of any origin, wherever they have been moved: Spark's text source streams a file in
pieces that end where ``WARC/1.`` stands, in a payload too, and a task joins pieces until a record has its
Content-Length. What then isn't the end of a record, or a file that ends within one, is an error, never lost.

Revisits: headers alone are shuffled. The record with the largest page_id among equal payload digests
answers, the others refer to it. The deduplicated archives get fresh headers and ids; a revisit has no
payload.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_path, lookup_join, materialize

CRLF = "\r\n"
MARK = "WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a string's UTF-8 bytes: 160 bits are eight groups of 20 bits, four digits each."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def field(name: str) -> Column:
    """Value of a header of a record that was read, its name in any case; null where it is missing."""
    return F.col("fields")[name.lower()]


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for null. CR, LF and tabs in values are percent-encoded."""
    for mark, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        value = F.replace(value, F.lit(mark), F.lit(code))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_records(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write (headers, payload) rows, headers a block of CRLF-ended lines, as WARC files under path, each after a warcinfo record."""
    info = _record_id(F.lit(path), F.lit("warcinfo"), F.spark_partition_id().cast("string"))
    fields = f"format: WARC File Format 1.1{CRLF}"
    about = F.concat(F.lit(f"{MARK}1{CRLF}WARC-Type: warcinfo{CRLF}"), _line("WARC-Record-ID", info), F.lit(f"WARC-Date: {date}{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(fields)}{CRLF}{CRLF}{fields}{CRLF}{CRLF}"))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its task
    record = F.concat(F.lit(f"{MARK}1{CRLF}"), _line("WARC-Warcinfo-ID", info), F.col("headers"), F.lit(CRLF), F.col("payload"), F.lit(CRLF + "\r"))
    value = F.concat(F.when(first, about).otherwise(F.lit("")), record)
    records.select(value.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*$", re.I | re.M)


def _head(data: bytes) -> tuple[int, int] | None:
    """(where the payload begins, its length) of a record whose header block is whole."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    found = _LENGTH.search(data[:end].replace(b"\r\n", b"\n"))
    if not found:
        raise ValueError(f"a WARC record without Content-Length: {data[:200]!r}")
    return end + 4, int(found[1])


def _records(batches):
    """Whole records from pieces, in the order of their files."""
    mark, name, held, head, size = MARK.encode(), None, [], None, 0
    out: list[tuple] = []

    def done() -> None:
        """Take the record that is held, if it is whole; held pieces without one are an error."""
        data = mark.join(held)
        start, n = _head(data) or (0, -1)
        if n < 0 or start + n > len(data) or data[start + n :].strip(b"\r\n"):
            raise ValueError(f"{name}: a record is cut off, or bytes stand behind its end: {data[:200]!r}")
        fields: dict[str, str] = {}
        for line in data[: start - 4].decode(errors="replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            key, value = key.strip().lower(), value.strip(" \t")
            fields[key] = f"{fields[key]}, {value}" if key in fields else value
        out.append((name, list(fields.items()), data[start : start + n]))

    def flush():
        cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()))]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["file", "fields", "payload"])

    taken = 0
    for batch in batches:
        for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if file != name:
                if held:
                    done()
                name, held, head, size = file, [], None, 0
                if piece.strip():
                    raise ValueError(f"{file}: no WARC file, or one that was split: it begins with {piece[:50]!r}")
                continue
            if held and head is not None and size >= sum(head):  # the record had all its bytes: this piece begins the next
                done()
                held, head, size = [], None, 0
            size += len(piece) + len(mark) * bool(held)
            held.append(piece)
            if head is None:
                head = _head(mark.join(held))
            taken += len(piece)
            if taken > 4 << 20:
                yield flush()
                taken = 0
    if held:
        done()
    yield flush()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, fields, payload) of all records but warcinfo ones of the archives under path, of whichever writer.

    Gzip files (one member or a member a record) are streamed by one task each. Files that aren't compressed must not be larger
    than spark.sql.files.maxPartitionBytes: a file that Spark splits is an error, as is one that isn't a whole WARC file. fields:
    the headers by lower-cased name, repeated ones joined by a comma and a blank; payloads are bytes.
    """
    pieces = spark.read.option("lineSep", MARK).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    found = pieces.mapInArrow(_records, "file string, fields map<string, string>, payload binary")
    return found.filter(F.coalesce(field("WARC-Type") != "warcinfo", F.lit(True)))


def write_pages(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """A response record per row of pages (page_id, url, html). Null html is an empty payload, null url no target."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url, page = F.col("url").cast("string"), F.col("page_id").cast("string")
    size = F.octet_length(body).cast("string")
    headers = F.concat(
        F.lit(f"WARC-Type: response{CRLF}"), _line("WARC-Record-ID", _record_id(page, url, F.monotonically_increasing_id().cast("string"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", url), _line("X-Page-ID", page),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(body))), F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", size),
    )
    write_records(pages.select(headers.alias("headers"), body.alias("payload")), path, date)


def resolve_revisits(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds refers_to, refers_uri and answer_id to (record_id, page_id, uri, digest, bytes).

    Among records of one digest and at least ``least_bytes`` bytes the largest page_id answers (null is the
    smallest; ties by record id). Its refers_to is null. The digest table is pre-aggregated, so one payload in
    a third of all records is a third of one side of a join that Spark can split, never a group in one task.
    """
    own = F.struct(F.col("page_id"), F.col("record_id"), F.col("uri"))
    first = heads.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(own).alias("answer"), F.count("*").alias("n")).filter("n > 1")
    joined = heads.join(first.select("digest", "answer"), "digest", "left")
    revisit = (F.col("bytes") >= least_bytes) & F.col("answer").isNotNull() & (F.col("answer.record_id") != F.col("record_id"))
    return joined.select(*heads.columns, F.coalesce(revisit, F.lit(False)).alias("revisit"), F.when(revisit, F.col("answer.page_id")).alias("refers_to"), F.when(revisit, F.col("answer.uri")).alias("refers_uri"), F.when(revisit, F.col("answer.record_id")).alias("answer_id"))


def _heads(records: DataFrame) -> DataFrame:
    """The fields of each record; its id is unique."""
    return records.select(
        field("WARC-Record-ID").alias("record_id"), field("X-Page-ID").cast("long").alias("page_id"), field("WARC-Target-URI").alias("uri"),
        F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"), "payload",
    )


def deduplicate(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages to WARC, read them back, write deduplicated archives under path and return what these hold.

    Result per record of the deduplicated archives: page_id, payload_bytes, payload_digest (both of the full
    payload), record_type (response or revisit), refers_to (page_id of the response, for revisits).

    Null html or url: see ``write_pages``. Empty payloads count as equal when ``least_bytes`` is 0. Rows that
    repeat a page_id each get a record; with equal payloads one of them answers. Null page_id: a record without
    X-Page-ID. Further columns of pages are ignored. Empty table: no record.
    """
    spark = pages.sparkSession
    raw = fresh_path(spark, "warc")
    path = path or fresh_path(spark, "warc-deduplicated")
    write_pages(pages.select("page_id", "url", "html"), raw, date)
    records = _heads(read_records(spark, raw))
    heads = materialize(records.select("record_id", "page_id", "uri", "bytes", "digest"), "heads")
    gone = materialize(resolve_revisits(heads, least_bytes).filter("revisit").select("record_id", "refers_to", "refers_uri", "answer_id"), "revisits")
    out = lookup_join(records, gone, "record_id", "left")
    revisit = F.col("answer_id").isNotNull()
    page = F.col("page_id").cast("string")
    headers = F.concat(
        F.when(revisit, F.lit(f"WARC-Type: revisit{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")), _line("WARC-Record-ID", _record_id(F.lit("deduplicated"), F.col("record_id"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("uri")), _line("X-Page-ID", page),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), _line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}{CRLF}"), _line("WARC-Refers-To", _record_id(F.lit("deduplicated"), F.col("answer_id"))), _line("WARC-Refers-To-Target-URI", F.col("refers_uri")), _line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    )
    write_records(out.select(headers.alias("headers"), F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")).alias("payload")), path, date)
    return summary(read_records(spark, path))


def summary(records: DataFrame) -> DataFrame:
    """Header fields of deduplicated archives, one row a record."""
    return records.select(
        field("X-Page-ID").cast("long").alias("page_id"), field("X-Payload-Length").cast("long").alias("payload_bytes"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("WARC-Type").alias("record_type"), field("X-Refers-To-Page-ID").cast("long").alias("refers_to"), F.octet_length("payload").cast("long").alias("stored_bytes"),
    )
