"""WARC: round trips through real files, awkward payloads, records in any order, damaged files."""

import gzip
import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from courtline.llm.store import documents
from courtline.llm.warc import captures, op12_warc, page_captures, parse_archive, read_archives, write_archives

GAP = "\r\n\r\n"
LONG = "<p>" + "é𝄞" * 60 + "</p>"
PAGES = [
    (1, "https://a.example/x?y=1#top", LONG),
    (2, "https://a.example/x", LONG),
    (3, None, LONG),
    (None, "https://b.example", LONG),
    (4, "http://c.example/a b\r\nX-Evil: 1", ""),
    (5, "not a url", None),
    (6, "https://a.example/", "short"),
    (7, "https://a.example/", "short"),
    (8, "http://d.example/", GAP + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0" + GAP + "x" * 90),
    (9, "http://d.example/", "y" * 3_000_000),
    (10, "http://d.example/", "y" * 3_000_000),
    (1, "https://a.example/x?y=1#top", LONG),  # a repeated row
    (None, "https://n.example", "z" * 100),
    (None, "https://n.example", "z" * 100),
    (11, "http://e.example", "e" * 99),
    (12, "http://e.example", "e" * 99),
]


def brute(pages):
    first = {}
    for page, _, html in pages:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html in pages:
        data, head = (html or "").encode(), first.get(html)
        again = head is not None and (page is None or page > head)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", b"z") for p in PAGES], "page_id long, url string, html string, digest string, payload binary").repartition(3)


def pages_of(records):
    return sorted(map(tuple, page_captures(captures(records)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("payloads", [True, False])
def test_round_trip(spark, pages, compression, payloads):
    path = tempfile.mkdtemp() + "/warc"
    write_archives(pages, path, compression)
    records = read_archives(spark, path, payloads)
    assert records.where("error is not null").isEmpty() and records.count() == 3 * len(PAGES)
    assert pages_of(records) == brute(PAGES)
    nested = captures(records)
    assert nested.count() == len(PAGES) and nested.where("size(requests) <> 1 or size(metadata) <> 1 or response is null").isEmpty()
    assert records.select("record_id").distinct().count() == 3 * len(PAGES)
    if payloads:
        kept = nested.where("response.warc_type = 'response'").select(F.element_at("metadata", 1)["fields"]["pageid"].cast("long"), F.col("response.payload").cast("string"))
        first = {p[2]: p[0] for p in reversed(PAGES) if p[0] is not None}
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted(((p, h or "") for p, _, h in PAGES if len((h or "").encode()) < 100 or h not in first or p == first[h]), key=repr)
        at = {r[0]: r for r in nested.select(F.element_at("metadata", 1)["fields"]["pageid"].alias("p"), F.element_at("requests", 1)["http_headers"].alias("h"), "response.target_uri", "response.refers_to_uri", "response.status").collect()}
        assert at["2"].h == {"host": "a.example"} and at["2"].refers_to_uri == PAGES[0][1] and at["2"].status == 200
        assert at["4"].target_uri == "http://c.example/a b%0D%0AX-Evil: 1" and at["3"].target_uri is None


def test_query_reads_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in documents(spark, sf, "pages").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, op12_warc(spark, sf).drop("url").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(rows)


def test_empty_table(spark, pages):
    path = tempfile.mkdtemp() + "/warc"
    write_archives(pages.where("false"), path)
    assert pages_of(read_archives(spark, path)) == []


def record(kind, name, block=b"", **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *(f"{k.replace('_', '-')}: {v}" for k, vs in headers.items() for v in (vs if isinstance(vs, list) else [vs])), f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_meet_wherever_they_lie(spark):
    """Requests name the response or are named by it; several parts; parts without response; other types."""
    path = tempfile.mkdtemp()
    one = record("request", "q1", WARC_Concurrent_To="r1") + record("warcinfo", "i") + record("response", "r2", WARC_Concurrent_To=["q2", "m2"])
    two = record("response", "r1", b"HTTP/1.1 404 No\r\nA: b\r\n c\r\n\r\nbody", Content_Type="application/http") + record("metadata", "m2", b"a: 1\r\nb: 2\r\n", Content_Type="application/warc-fields") + record("metadata", "m1b", WARC_Concurrent_To="r1") + record("metadata", "m1a", WARC_Concurrent_To="r1")
    three = record("request", "q2") + record("request", "q9", WARC_Concurrent_To="gone") + record("metadata", "alone")
    for name, data in (("a.warc", one), ("b.warc.gz", b"".join(map(gzip.compress, (two[:100], two[100:])))), ("c.warc", three)):
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
    ids = lambda rows: [r.record_id for r in rows]
    out = {r.capture_id: (r.response.record_id if r.response else None, ids(r.requests), ids(r.metadata)) for r in captures(read_archives(spark, path)).collect()}
    assert out == {"r1": ("r1", ["q1"], ["m1a", "m1b"]), "r2": ("r2", ["q2"], ["m2"]), "gone": (None, ["q9"], []), "alone": (None, [], ["alone"])}
    r1 = read_archives(spark, path).where("record_id = 'r1'").first()
    assert (r1.status, r1.http_headers, bytes(r1.payload)) == (404, {"a": "b c"}, b"body")


def test_damaged_files():
    good = record("resource", "a", b"abc")
    assert [r["error"] for r in parse_archive("f", good + b"noise\r\nmore\r\n" + good)] == [None, "no record begins here", None]
    assert [r["error"] for r in parse_archive("f", good[:-6])] == ["cut short"]
    assert [r["error"] for r in parse_archive("f", good.replace(b"Content-Length: 3", b"Content-Length: x") + good)][0] == "no length"
    cut = gzip.compress(good * 50, mtime=0)
    assert [r["error"] for r in parse_archive("f", cut[: len(cut) - 4])][-1].startswith("damaged file")
    false = record("response", "r", b"HTTP/1.1 200\r\n\r\nx", Content_Type="application/http", WARC_Payload_Digest="sha256:00")
    assert [r["error"] for r in parse_archive("f", false)] == ["payload differs from its digest"]
    assert list(parse_archive("f", b"")) == []
