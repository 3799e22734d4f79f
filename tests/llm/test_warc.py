"""WARC round trips against a plain resolution."""

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from tessera.llm import _files, warc
from tessera.session import scratch

ROWS = [
    (1, "http://a/", "same"), (2, "http://b/x y\r\nz", "same"), (9, None, "same"), (3, "http://c/", None), (4, "", ""),
    (5, "http://d/", "WARC/1.1\r\n\r\nbody\r\n\r\n é日"), (None, "http://n/", "same"), (None, "u", "only null"), (None, None, "only null"),
    (7, "http://d/", "x" * 100_000), (8, "http://d/", "x" * 100_000), (8, "http://d/", "x" * 100_000), (6, "u", "single"),
]


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        h = html or ""
        if len(h.encode()) >= least and page is not None:
            first[h] = max(page, first.get(h, page))
    out = []
    for page, _, html in rows:
        h = html or ""
        b = h.encode()
        f = first.get(h) if sum((r[2] or "") == h for r in rows) > 1 else None
        revisit = f is not None and f != page
        sha = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((page, len(b), sha, "revisit" if revisit else "response", f if revisit else None))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, sha string")
    for least in (0, 5):
        got = [tuple(r)[:5] for r in warc.round_trip(pages, least).collect()]
        assert sorted(got, key=key) == sorted(expected(ROWS, least), key=key)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_hold_payloads_and_roll_over(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(pages, scratch(spark, "warc"), archive_bytes=300)
    files = manifest.collect()
    assert len(files) > 2 and sum(f.records for f in files) == len(ROWS)
    raw = gzip.decompress(_files.read_stream(files[0].archive).read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    stored = warc.read_archives(manifest, with_payload=True).where("record_type = 'response'")
    assert {r.html for r in stored.collect()} == {(r[2] or "") for r in ROWS}


def test_digest_is_base32(spark):
    row = spark.createDataFrame([("naïve",), ("",)], "s string").select(warc.digest(F.col("s"))).collect()
    assert [r[0] for r in row] == [base64.b32encode(hashlib.sha1(s.encode()).digest()).decode() for s in ("naïve", "")]


def test_every_record_has_a_name_and_revisits_name_one(spark):
    rows = [(1, "u", "a"), (1, "u", "b"), (1, "u", "b"), (0, "u", "b"), (0, "u", "b"), (None, "u", "b")]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch(spark, "warc"))
    heads = []
    for f in manifest.collect():
        with _files.read_stream(f.archive) as stream:
            heads += [h for h, _ in warc.records(stream)]
    names = [h["WARC-Record-ID"] for h in heads]
    assert len(set(names)) == len(rows)
    referred = {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"}
    assert len(referred) == 1 and referred <= {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}


def test_a_third_of_the_pages_empty(spark):
    rows = [(k, f"u{k}", None if k % 3 == 0 else f"<p>{k // 2}</p>" * (k % 50)) for k in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = [tuple(r)[:5] for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_no_payload_in_a_shuffle(spark, capfd):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    located = pages.select(F.monotonically_increasing_id().alias("place"), "page_id", "url", "html", warc.digest(F.col("html")).alias("sha"), F.length("html").alias("size"))
    warc.revisits(located, 0).explain("formatted")
    plan = capfd.readouterr().out
    exchanges = [part for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0] and "Input" in part]
    assert exchanges and not any("html" in part for part in exchanges)
