"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one failure bit a
rule and the measurements behind it.  Policies are named, versioned lists of
rules applied to the stored bits, so a new policy or an ablation never reads
a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Version of the rules below, stored beside the bits; a change of a condition or a bit takes a new one.
RULE_SET = "r1"
#: Rule -> (its bit, SQL condition over the measurements that means failure). Bits are never reused.
RULES = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "repeated_lines": (3, "100 * n_dup_lines > 40 * n_lines"),
    "word_length": (4, "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
}
BASE = ("few_words", "repeated_words")
#: Version -> (rule set it is written for, the rules that reject a document).
POLICIES = {
    "base": ("r1", BASE),
    "v1": ("r1", tuple(RULES)),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(rules: tuple[str, ...] | list[str]) -> int:
    """The bits of the named rules."""
    return sum(1 << RULES[r][0] for r in dict.fromkeys(rules))


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more; ``words`` has 3 or more.

    Windows are sorted by (hash, words, place), so equal windows stand side by
    side; where all hashes differ no window can repeat and nothing is sorted.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.transform(
        starts,
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
            F.get(words, i).alias("a"),
            F.get(words, i + 1).alias("b"),
            F.get(words, i + 2).alias("c"),
            i.alias("i"),
        ),
    )

    def found(ordered: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce(
                (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False)
            )

        repeats = F.filter(
            ordered,
            lambda x, k: same(x, F.get(ordered, k - 1)) | same(x, F.get(ordered, k + 1)),
        )
        covered = F.flatten(F.transform(repeats, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(covered))

    # a one-element transform names the sorted array, which is then built once
    by_sort = F.get(F.transform(F.array(F.array_sort(windows)), found), 0)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(words) - 2, F.lit(0)).otherwise(by_sort)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements (all long) to every row of ``docs``.

    Words are maximal runs without U+0020 and U+0009..U+000D over the whole
    text.  A null or blank text has no words and zeros throughout.  Rows are
    never dropped or merged; columns of the input that clash with a
    measurement's name are replaced.
    """
    kept = [c for c in docs.columns if c not in MEASURES]
    whole = docs.select(
        *kept,
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
        F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES)).alias("__trimmed"),
    )
    split = whole.select(
        *kept,
        "__text",
        F.when(F.col("__trimmed") == "", F.array().cast("array<string>"))
        .otherwise(F.split("__trimmed", SPACE_RUN))
        .alias("__words"),
        F.filter(F.split("__text", "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "").alias("__lines"),
    )
    words, lines = F.col("__words"), F.col("__lines")
    measures = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) < 3, F.lit(0)).otherwise(_repeat_words(words)).cast("long").alias("n_repeat_words"),
    )
    # a generator of one row: filters on the measurements stay above it, so that each is made once
    return split.select(*kept, F.inline(F.array(measures)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``measure`` plus ``fail_bits`` (long), a bit for each failed rule, and ``rule_set``, the version of the bits.

    Every rule is evaluated once a row, whether the ledger is stored or
    filtered at once.
    """
    bits = F.lit(0).cast("long")
    for bit, condition in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, text).withColumns({"fail_bits": bits, "rule_set": F.lit(RULE_SET)})


def _bits_of(names: tuple[str, ...], rule_set: str) -> Column:
    """The named bits of an entry; an error where it was written under another rule set."""
    other = F.raise_error(F.concat(F.lit(f"the policy is for rule set {rule_set}, the ledger has "), F.coalesce("rule_set", F.lit("none"))))
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(names)))
    return F.when(F.col("rule_set") == rule_set, bits).otherwise(other.cast("long"))


def apply_policy(entries: DataFrame, version: str = "v1") -> DataFrame:
    """Add ``base_failed`` and ``kept`` (booleans) for one policy version; reads stored bits only.

    Entries of another rule set than the policy's are an error: their bits
    mean other rules.
    """
    rule_set, names = POLICIES[version]
    failed = lambda rules: _bits_of(rules, rule_set) != 0
    return entries.withColumns({"base_failed": failed(BASE), "kept": ~failed((*BASE, *names))})


def ablation(entries: DataFrame) -> DataFrame:
    """(policy, rule, failed, only_this, also_without): what each rule does in each policy.

    ``failed``: documents whose bit is set; ``only_this``: documents the policy
    rejects for this rule alone, which leaving it out would keep;
    ``also_without``: those it rejects anyway.  One bitwise aggregation over
    the distinct bit patterns, at most 2 to the number of rules for each rule
    set; a policy counts the entries of its own.  An empty ledger gives zeros.
    """
    spark = entries.sparkSession
    patterns = entries.groupBy("rule_set", "fail_bits").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame(
        [(p, s, r, mask(names), mask([r])) for p, (s, names) in POLICIES.items() for r in names],
        "policy string, rule_set string, rule string, all_bits long, bit long",
    )
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.col("all_bits")) == F.col("bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        grid.join(F.broadcast(patterns), ["rule_set"], "left")
        .groupBy("policy", "rule")
        .agg(count(hit)("failed"), count(hit & alone)("only_this"), count(hit & ~alone)("also_without"))
    )
