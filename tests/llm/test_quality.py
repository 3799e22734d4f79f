"""Quality ledger against a plain version, policies and ablation."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.session import written

LONG = " ".join(f"word{k}" for k in range(60))
TEXTS = [
    None, "", " \n\t", "one", "a b c a b c a b c", LONG, LONG + " # $ " * 9, "\n".join([LONG] * 4), "same line\nsame line\n\n \nsame line ",
    "É é\x0bü\x1cx \x85y", "x" * 70_000 + " y", "the " * 3000, LONG.upper() + "\n" + " ".join("ab" for _ in range(40)),
]


def plain(text):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    win = list(zip(w, w[1:], w[2:]))
    many = Counter(win)
    inside = {i + j for i, x in enumerate(win) if many[x] > 1 for j in range(3)}
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(inside))
    fails = [n[0] < 50, 100 * n[5] > 50 * n[0], 10 * n[2] > n[0], 100 * n[4] > 40 * n[3], n[1] < 2 * n[0] or n[1] > 14 * n[0]]
    return (*n, sum(1 << k for k, f in enumerate(fails) if f))


def test_ledger_policies_and_ablation(spark):
    rows = [(k if k != 2 else None, t, -1) for k, t in enumerate(TEXTS)] + [(0, None, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    entries = written(quality.ledger(docs), "ledger")
    got = quality.apply_policy(entries).collect()
    by_text = [(r.text, *(r[m] for m in quality.MEASURES), r.fail_bits) for r in got]
    key = lambda r: (r[0] is None, r[0] or "")
    assert sorted(by_text, key=key) == sorted(((t, *plain(t)) for _, t, _ in rows), key=key)
    for r in got:
        assert r.base_failed == bool(r.fail_bits & 3) and r.kept == (r.fail_bits == 0)
    bits = [r.fail_bits for r in got]
    table = {(r.policy, r.rule): (r.failed, r.only_this, r.also_without) for r in quality.ablation(entries).collect()}
    for policy, (_, rules) in quality.POLICIES.items():
        for rule in rules:
            b, all_bits = quality.mask([rule]), quality.mask(rules)
            failed = [x for x in bits if x & b]
            alone = [x for x in failed if x & all_bits == b]
            assert table[policy, rule] == (len(failed), len(alone), len(failed) - len(alone))
    assert quality.ledger(docs.limit(0)).collect() == []
    assert quality.ablation(entries.limit(0)).count() == len(table)


def test_bits_belong_to_a_rule_set(spark):
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    entries = quality.ledger(docs)
    assert [r.rule_set for r in entries.collect()] == ["r1"]
    bits = [bit for bit, _ in quality.RULES.values()]
    assert len(set(bits)) == len(bits) and quality.mask(["symbols", "few_words", "symbols"]) == 5
    old = entries.withColumn("rule_set", F.lit("r0"))
    with pytest.raises(Exception, match="rule set r1, the ledger has r0"):
        quality.apply_policy(old).collect()
    assert {r.failed for r in quality.ablation(old).collect()} == {0}


def test_a_filter_on_bits_measures_once(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    kept = quality.apply_policy(quality.ledger(docs)).where("kept")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate") and plan.count("Generate inline") == 1
    assert [r.doc_id for r in kept.collect()] == [k for k, t in enumerate(TEXTS) if plain(t)[-1] == 0]
