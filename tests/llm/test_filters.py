"""URL filter and license scan on small cases."""

import os
import random

import pytest

from tessera.llm import licenses, urlfilter


def plain_match(rules, host, path):
    fits = [
        (len(h.split(".")), len(p), v == "block", v, h + p)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[3:] if fits else None


def test_trie_is_the_plain_rule():
    rng = random.Random(6)
    hosts = ["net", "org", "a.net", "b.a.net", "example.com"]
    paths = ["/", "/en/", "/en", "/en/x", "/e", "", "/fr/1/"]
    for _ in range(300):
        rules = tuple((rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(rng.randrange(6)))
        trie = urlfilter.Trie(rules)
        for _ in range(20):
            host = rng.choice(["", "x.", "y.x.", "a."]) + rng.choice([*hosts, "", "nett", "anet"])
            path = rng.choice(["", "/", "/en", "/en/", "/en/x/y", "/ex", "/fr/1/2", "//", "/e/n"])
            assert trie.match(host, path) == plain_match(rules, host, path), (rules, host, path)


def test_urls_of_every_kind(spark):
    urls = [
        None, "", "no mark", "http://", "http://A.Example.NET/en/1?x", "https://example.net/en", "http://x.net", "ftp://x.org/fr/#a",
        "http://É.NET/", "a://b://c", "http://www.example.com/de/1", "http://net?x=/", "http://user@x.net:80/",
    ]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: tuple(r)[2:] for r in urlfilter.judge(pages).collect()}
    for k, u in enumerate(urls):
        host, path = urlfilter.split_url(u)
        found = plain_match(urlfilter.RULES, host, path)
        assert got[k] == (host, path, found and found[1], found[0] if found else "allow")
    assert got[4][3] == "allow" and got[5][3] == "block" and got[8][0] == "É.net" and got[0] == ("", "", None, "allow")
    assert urlfilter.judge(pages.limit(0)).collect() == []


def test_licenses_by_canonical_form(spark):
    mit = dict(licenses.KNOWN)["MIT"] and licenses.KNOWN[0][1]
    wrapped = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.replace(" copy, ", "\n   copy,\t").replace("sublicense", "SUBLICENCE")
    texts = [None, "", "...", mit, wrapped, mit + " and more", "text\n* licensed under CC-BY-NC 4.0\nmore", "Released under the MIT Licence", mit[:500]]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(3, mit, 0), (None, mit, 0)], "doc_id long, text string, unit int")
    got = licenses.scan(docs).collect()
    whole = [(r.doc_id, r.license_id) for r in got if r.unit == "document"]
    assert len(whole) == 11
    assert {x for x in whole if x[1]} == {(3, "MIT"), (4, "MIT"), (None, "MIT"), (7, "MIT")}
    assert sorted((r.doc_id, r.line_no, r.license_id) for r in got if r.unit == "line") == [(6, 1, "CC-BY-NC-4.0"), (7, 0, "MIT")]
    assert {r.digest for r in got if r.doc_id in (0, 1, 2)} == {licenses.digest_of("")}
    assert licenses.scan(docs.limit(0)).collect() == []


TEXTS = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(TEXTS), reason="no licence texts on this machine")
def test_whole_licences_match_by_digest(spark):
    want, rows = {}, []
    for k, (name, file) in enumerate([("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]):
        text = open(f"{TEXTS}/{file}", encoding="utf-8").read()
        # upper case, other punctuation and a copyright line make no difference; a word more does
        rows += [(3 * k, text), (3 * k + 1, "Copyright (c) 2024 Somebody\n" + text.upper().replace(",", ";")), (3 * k + 2, text + " once")]
        want |= {3 * k: name, 3 * k + 1: name, 3 * k + 2: None}
    rows.append((99, "word " * 400_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs).where("unit = 'document'").collect()}
    assert got == want | {99: None}


def test_odd_urls(spark):
    long = "http://a.example.net/" + "x/" * 50_000
    pages = spark.createDataFrame([(1, long), (1, long), (None, "http://x.net/")], "page_id long, url string")
    got = urlfilter.judge(pages).collect()
    assert sorted((r.verdict, len(r.path)) for r in got) == [("block", 1), ("block", 100_001), ("block", 100_001)]
