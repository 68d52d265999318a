"""WARC archives: captures written as request, response and metadata records, read back and assembled.

Written: each page is one transaction of three records; the page's number stands in the metadata record
alone. A payload that an earlier page has is written once, as a response, and the others are revisits
that carry its digest. Spark's own text writer puts the records into files of any store, one transaction
a row, with the blank lines that end a record as the separator.

Read: a file is parsed in its task by the lengths that its records state, so what a payload holds cannot be
taken for a record, and every payload is hashed anew. Request, response and metadata records meet
through their concurrent-to identifiers in joins, wherever they lie.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import checkpoint, documents, folder, remove

END = "\r\n"
GAP = END + END
#: Payload bytes that leave a task at once; a larger record goes alone.
BATCH_BYTES = 4 << 20
PIECE = 1 << 20
RECORDS = (
    "archive string, offset long, warc_type string, record_id string, concurrent_to array<string>, target_uri string, warc_date string, refers_to_uri string, digest string,"
    " status int, http_headers map<string,string>, fields map<string,string>, payload binary, payload_bytes long, payload_sha256 string, error string"
)
_ARROW = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("warc_date", pa.string()), ("refers_to_uri", pa.string()), ("digest", pa.string()),
     ("status", pa.int32()), ("http_headers", pa.map_(pa.string(), pa.string())), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("error", pa.string())]
)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line breaks in the value are escaped."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(END)), F.lit(""))


def _record(kind: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    return F.concat(F.lit("WARC/1.1" + END), _line("WARC-Type", kind), *headers, _line("Content-Type", F.lit(content_type)), _line("Content-Length", F.octet_length(block)), F.lit(END), block)


def transactions(pages: DataFrame, least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row for each page: the text of its three records.

    Of pages with equal payloads of `least_bytes` or more, the least page_id is the response and
    larger ones revisit it; rows that repeat the least page_id are responses too, and a null page_id
    comes after all others. A null html is an empty payload, a null url leaves the target out.
    The first copies of repeated payloads are a small side; pages meet it by digest, so Spark may
    split the pages of a payload that very many share.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    first = pages.select("page_id", "url", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= least_bytes)
    first = first.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n")
    again = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    named = F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    rows = rows.join(first, "digest", "left").withColumn("again", again).withColumns({"_request": named, "_response": named, "_metadata": named})

    host = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    common = lambda own: [_line("WARC-Record-ID", F.col(own)), _line("WARC-Target-URI", F.col("url")), _line("WARC-Date", F.lit(date))]
    beside = _line("WARC-Concurrent-To", F.col("_response"))
    sum_line = _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    asked = F.concat(F.lit("GET "), F.when(F.coalesce(target, F.lit("")) == "", "/").otherwise(F.regexp_replace(target, r"\s", "%20")), F.lit(" HTTP/1.1" + END), _line("Host", F.coalesce(host, F.lit(""))), F.lit(END))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END), _line("Content-Length", F.octet_length("payload")), F.lit(END))
    earlier = [_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To-Target-URI", F.col("first_url")), _line("WARC-Refers-To-Date", F.lit(date))]
    only_again = [F.when(F.col("again"), c).otherwise(F.lit("")) for c in earlier]
    request = _record(F.lit("request"), [*common("_request"), beside], "application/http; msgtype=request", asked)
    response = _record(F.when(F.col("again"), "revisit").otherwise("response"), [*common("_response"), sum_line, *only_again], "application/http; msgtype=response", F.when(F.col("again"), head).otherwise(F.concat(head, F.col("payload"))))
    metadata = _record(F.lit("metadata"), [*common("_metadata"), beside], "application/warc-fields", _line("pageId", F.col("page_id")))
    return rows.select(F.concat(request, F.lit(GAP), response, F.lit(GAP), metadata).alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", **how: object) -> None:
    """Writes the transactions of (page_id, url, html) as WARC files; a file is one partition's."""
    transactions(pages, **how).write.option("lineSep", GAP).option("compression", compression).text(path)


def _headers(stream: io.BufferedIOBase, limit: int) -> tuple[list[tuple[str, str]], int]:
    """Header lines up to a blank one, at most `limit` bytes, and the bytes taken; folded lines are joined."""
    out, used = [], 0
    while used < limit:
        line = stream.readline(limit - used)
        used += len(line)
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not text:
            break
        if text[0] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out, used


def _first(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k == name), None)


def _body(stream: io.BufferedIOBase, size: int, keep: bool) -> tuple[bytes | None, int, str]:
    """Reads `size` bytes in pieces: the bytes if they are kept, how many there were, their SHA-256."""
    total, pieces, got = hashlib.sha256(), [], 0
    while got < size and (piece := stream.read(min(PIECE, size - got))):
        total.update(piece)
        got += len(piece)
        if keep:
            pieces.append(piece)
    return b"".join(pieces) if keep else None, got, total.hexdigest()


def parse_archive(archive: str, content: bytes | memoryview, payloads: bool = True) -> Iterator[dict]:
    """The records of one file, plain or gzip (by record or whole), in their order.

    A record whose head cannot be read or whose block is cut short gives a row with `error`; reading
    goes on at the next line that begins a record. Equal names of headers keep the first value, but for
    concurrent-to. Chunked or compressed bodies stay as they are stored.
    """
    view = memoryview(content)
    stream: io.BufferedIOBase = io.BytesIO(view)
    if bytes(view[:2]) == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), PIECE)  # type: ignore[arg-type]
    lost = False
    while True:
        at = stream.tell()
        try:
            line = stream.readline(PIECE)
        except (EOFError, OSError) as e:  # a gzip member that is cut or damaged
            yield dict.fromkeys(_ARROW.names) | {"archive": archive, "offset": at, "concurrent_to": [], "error": f"damaged file: {e}"}
            return
        if not line:
            return
        if not line.startswith(b"WARC/1."):
            if line.strip() and not lost:
                lost = True
                yield dict.fromkeys(_ARROW.names) | {"archive": archive, "offset": at, "concurrent_to": [], "error": "no record begins here"}
            continue
        lost = False
        row = dict.fromkeys(_ARROW.names) | {"archive": archive, "offset": at, "concurrent_to": []}
        try:
            heads, _ = _headers(stream, 1 << 30)
            kind, stated = _first(heads, "warc-type"), _first(heads, "content-length") or ""
            row |= {"warc_type": kind, "record_id": _first(heads, "warc-record-id"), "concurrent_to": [v for k, v in heads if k == "warc-concurrent-to"], "target_uri": _first(heads, "warc-target-uri"), "warc_date": _first(heads, "warc-date"), "refers_to_uri": _first(heads, "warc-refers-to-target-uri"), "digest": _first(heads, "warc-payload-digest")}
            if not stated.isascii() or not stated.isdigit():
                yield row | {"error": "no length"}
                continue
            left = int(stated)
            content_type = (_first(heads, "content-type") or "").lower()
            if content_type.startswith("application/http"):
                first = stream.readline(left)
                left -= len(first)
                words = first.split()
                if len(words) > 1 and words[0].startswith(b"HTTP/") and words[1].isdigit():
                    row["status"] = int(words[1][:4])
                inner, used = _headers(stream, left)
                left -= used
                row["http_headers"] = list(dict(reversed(inner)).items())
            elif content_type.startswith("application/warc-fields"):
                inner, used = _headers(stream, left)
                left -= used
                row["fields"] = list(dict(reversed(inner)).items())
            row["payload"], row["payload_bytes"], row["payload_sha256"] = _body(stream, left, payloads)
            if row["payload_bytes"] < left:
                row["error"] = "cut short"
            elif kind == "response" and (row["digest"] or "").startswith("sha256:") and row["digest"][7:] != row["payload_sha256"]:
                row["error"] = "payload differs from its digest"
        except (EOFError, OSError) as e:
            yield row | {"error": f"damaged file: {e}"}
            return
        yield row


def _parser(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_buffer()
                for row in parse_archive(batch.column(0)[i].as_py(), memoryview(content) if content is not None else b"", payloads):
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the WARC files under a path; without `payloads` only their sizes and hashes.

    A file is read whole by one task (2 GB at most as stored); its records are parsed as a stream.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_parser(payloads), RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response (or revisit), requests and metadata records.

    A record belongs to the response that its concurrent-to names, or that names it. Requests and metadata
    that no response is named for make a capture without response, by the identifier they
    name or else their own. Lists are in the order of identifiers; rows with an error and records of other types are left out.
    """
    sound = records.where("error is null")
    record = F.struct(*[c for c in records.columns if c not in ("error", "concurrent_to")])
    heads = sound.where("warc_type in ('response', 'revisit')")
    parts = sound.where("warc_type in ('request', 'metadata')").select("record_id", "warc_type", "concurrent_to", record.alias("record"))
    own = parts.select(F.explode(F.when(F.size("concurrent_to") > 0, F.col("concurrent_to")).otherwise(F.array("record_id"))).alias("capture_id"), "record_id", F.expr("size(concurrent_to) > 0").alias("linked"))
    named = heads.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"), F.lit(True).alias("linked"))
    links = own.unionByName(named).groupBy("record_id", "capture_id").agg(F.max("linked").alias("linked"))
    joined = parts.drop("concurrent_to").join(links, "record_id")
    claimed = named.select("record_id").distinct().withColumn("claimed", F.lit(True))  # a response names it: its own identifier makes no capture
    joined = joined.join(claimed, "record_id", "left").where("linked or claimed is null")
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    key = F.struct(F.col("record_id"), F.col("record.archive"), F.col("record.offset"))
    kind = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("warc_type") == t, F.struct(key.alias("key"), "record"))), by_key), lambda r: r["record"])
    sides = joined.groupBy("capture_id").agg(kind("request").alias("requests"), kind("metadata").alias("metadata"))
    response = heads.select(F.col("record_id").alias("capture_id"), record.alias("response"))
    none = lambda c: F.coalesce(F.col(c), F.array().cast(dict(sides.dtypes)[c]))
    return response.join(sides, "capture_id", "full").select("capture_id", "response", none("requests").alias("requests"), none("metadata").alias("metadata"))


def page_captures(found: DataFrame) -> DataFrame:
    """Pages of captures that carry a pageId: (page_id, url, payload_bytes, payload_digest, record_type, refers_to).

    A revisit takes size and number from the response with its digest that has the least page_id;
    both are null if no archive that was read holds it.
    """
    digest = F.when(F.col("response.warc_type") == "response", F.col("response.payload_sha256")).otherwise(F.regexp_replace("response.digest", "^sha256:", ""))
    rows = found.where("response is not null").select(F.explode_outer("metadata").alias("m"), F.col("response.target_uri").alias("url"), F.col("response.warc_type").alias("record_type"), digest.alias("payload_digest"), F.col("response.payload_bytes").alias("bytes"))
    rows = rows.select(F.element_at("m.fields", "pageid").cast("long").alias("page_id"), "url", "record_type", "payload_digest", "bytes")
    first = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.max("bytes").alias("first_bytes"))
    back = rows.where("record_type = 'revisit'").join(first, "payload_digest", "left").select("page_id", "url", F.col("first_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first_id").alias("refers_to"))
    return rows.where("record_type = 'response'").select("page_id", "url", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(back)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes pages as archives in the shared folder, reads these back, and drops them when the result is kept."""
    path = f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(documents(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = checkpoint(read_archives(spark, path, payloads=False))
    remove(spark, path)
    return page_captures(captures(records))


OP12_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS head FROM p)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN coalesce(page_id > head, head IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN coalesce(page_id > head, head IS NOT NULL) THEN head END AS refers_to
FROM q
"""
