"""Links that a task finds in a block, against all pairs in plain Python."""

import difflib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from test_clusters import NAMES, all_pairs, made, plain, replay

from tessera.functions import text
from tessera.operators import resolve
from tessera.plans import blocks
from tessera.session import written


def test_matching_blocks_equal_difflib():
    rng = random.Random(8)
    for _ in range(4000):
        a, b = ("".join(rng.choices("abc d", k=rng.randrange(0, 14))) for _ in range(2))
        total = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        assert blocks.matched(a, b) == total


@pytest.mark.parametrize("counted", [48, 0])
@pytest.mark.parametrize("least,contained", [(0.6, True), (0.9, False)])
def test_a_block_s_links_give_the_groups_of_all_pairs(monkeypatch, counted, least, contained):
    """With few held rows and with many, titles that pass one way only, and rows that share a place."""
    monkeypatch.setattr(blocks, "COUNTED", counted)
    passes, rng = blocks.judge(least, contained), random.Random(9)
    words = ["grant", "grants", "fund", "sport", "sports", "arts", "a", "12", "2024"]
    for k in range(150):
        n, share = rng.randrange(2, 40), rng.choice([0, 0.1, 0.5])
        pos = sorted(rng.randrange(3 * n) for _ in range(n)) if k % 5 == 0 else list(range(n))
        published = {p: rng.random() < share for p in pos}
        held = [published[p] for p in pos]
        titles = [" ".join(rng.choices(words, k=rng.randrange(1, 4))) if rng.random() < 0.9 else rng.choice([None, "" if contained else "b"]) for _ in pos]
        every = [
            (x, y) for x, y in combinations(range(n), 2)
            if pos[x] != pos[y] and not (held[x] and held[y]) and (titles[x] == titles[y] or passes(titles[x], titles[y]))
        ]
        got = blocks.title_links(pos, held, titles, passes, least)
        assert set(got) <= set(every) and len(got) <= 2 * n
        rows = [{"pos": p, "published": h} for p, h in published.items()]
        as_links = lambda links: sorted((pos[x], pos[y], 1) for x, y in links)
        assert replay(rows, as_links(got)) == replay(rows, as_links(every))


@pytest.mark.parametrize("most", [(1 << 17, 1 << 12), (1 << 17, 2), (6, 2)])
def test_blocks_of_any_size_give_the_same_groups(spark, monkeypatch, most):
    """Blocks of more titles or rows than a task takes are joined."""
    monkeypatch.setattr(resolve, "MAX_ROWS", most[0])
    monkeypatch.setattr(resolve, "MAX_TITLES", most[1])
    rows = made(spark, 11, 70, False)
    frame = plain(rows)
    assert {r.pos: r.cluster for r in resolve.clusters(rows, resolve.edges(rows)).collect()} == replay(frame, all_pairs(frame)[0])


def test_titles_that_are_all_alike_cost_a_link_or_two_a_row(spark):
    """Pairs of titles of a key are not listed, as they were: there are 44,850 here."""
    data = [(k, k % 4 == 0, f"O{k}", f"Programme {k}", "F", "key", "https://hot.org/", "rolling", None, None) for k in range(300)]
    rows = spark.createDataFrame(data, NAMES)
    links = written(resolve.edges(rows), "links")
    assert links.count() <= 4 * len(data)
    frame = plain(rows)
    assert {r.pos: r.cluster for r in resolve.clusters(rows, links).collect()} == replay(frame, all_pairs(frame)[0])


def test_texts_in_ascii_are_not_looked_up(spark):
    given = ["Plain & Simple", "Ōtautahi", "Šport Ж", "", None, "áb"]
    rows = spark.createDataFrame([(t,) for t in given], "t string")
    got = [r[0] for r in rows.select(F.struct(text.normalise_title("t"), text.slug("t"), text.unaccent("t"))).collect()]
    assert [tuple(r) for r in got] == [
        ("plain and simple", "plain-simple", "Plain & Simple"), ("otautahi", "otautahi", "Otautahi"), ("sport zh", "sport-zh", "Sport Ж"),
        ("", "", ""), ("", "", ""), ("ab", "ab", "ab"),
    ]
