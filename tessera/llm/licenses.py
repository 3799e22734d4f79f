"""License scans by canonical digest.

A text is brought to a canonical form (lower case, no punctuation, no
copyright lines, one spelling), hashed, and the digest of the whole text is
joined to the digests of known licences.  Lines are looked up the same way as
texts of their own, which finds licence notices inside documents.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.license_texts import DIGESTS, KNOWN, SPELLINGS

#: Known texts up to this many are broadcast; beyond, the digests are joined by a shuffle.
BROADCAST_ROWS = 50_000
COPYRIGHT_LINE = (
    r"^[^\p{L}\p{N}]*(copyright[^\p{L}\p{N}]*(\(c\)|©|[0-9]{4}|year)|\(c\)|©|all rights reserved[^\p{L}\p{N}]*$)"
)
PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty for a copyright line or one without letters and digits."""
    low = F.lower(line)
    words = F.btrim(F.regexp_replace(low, PUNCTUATION, " "))
    spelling = F.create_map(*(F.lit(w) for pair in SPELLINGS for w in pair))
    odd = F.array(*(F.lit(a) for a, _ in SPELLINGS))
    split = F.split(words, " ")
    respelt = F.array_join(F.transform(split, lambda w: F.coalesce(F.element_at(spelling, w), w)), " ")
    one = F.when(F.arrays_overlap(split, odd), respelt).otherwise(words)
    return F.when(F.rlike(low, F.lit(COPYRIGHT_LINE)), F.lit("")).otherwise(one)


def canonical_text(text: str) -> str:
    """The same form of a whole text, for building tables of known licences."""
    import regex

    spelling = dict(SPELLINGS)
    lines = []
    for line in text.lower().split("\n"):
        if regex.search(COPYRIGHT_LINE, line):
            continue
        words = regex.sub(PUNCTUATION, " ", line).strip(" ").split(" ")
        if words != [""]:
            lines.append(" ".join(spelling.get(w, w) for w in words))
    return " ".join(lines)


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def table_of(texts=KNOWN, digests=DIGESTS) -> list[tuple[str, str]]:
    """(license_id, digest) of (license_id, text) pairs and of texts known by their digest alone."""
    return sorted({*((k, digest_of(re.sub(r"\r\n?", "\n", t))) for k, t in texts), *digests})


def known_digests(spark: SparkSession, texts=KNOWN, digests=DIGESTS) -> DataFrame:
    """``table_of`` as a frame (license_id, digest)."""
    return spark.createDataFrame(table_of(texts, digests), "license_id string, digest string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, unit, line_no, digest, license_id.

    One row per row of ``docs`` with unit ``document`` for its whole text,
    license_id null unless the entire text is a known one, and one with unit
    ``line`` for every line (from 0) that is one.  Null, empty and
    punctuation-only texts have the digest of the empty form and match
    nothing, nor do such lines.  Texts are compared whole, never by prefix.
    Repeated rows give rows each, null doc_ids are kept, other columns are
    ignored; of several known ids with one digest the first by name is taken.
    An empty table gives no rows.

    The known table is small next to the documents: it is broadcast up to
    ``BROADCAST_ROWS`` rows and joined by a shuffle beyond.
    """
    if known is None:
        known = known_digests(docs.sparkSession)
    empty = hashlib.sha256(b"").hexdigest()
    known = known.where(F.col("digest") != empty).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if len(known.select("digest").take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    lines = docs.select(
        "doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), canonical_line).alias("__lines")
    )
    whole = F.struct(
        F.lit(-1).alias("line_no"),
        F.array_join(F.filter("__lines", lambda x: x != ""), " ").alias("form"),
    )
    each = F.filter(
        F.transform("__lines", lambda x, k: F.struct(k.alias("line_no"), x.alias("form"))), lambda s: s["form"] != ""
    )
    units = lines.select("doc_id", F.explode(F.concat(F.array(whole), each)).alias("u")).select(
        "doc_id", F.col("u.line_no").alias("line_no"), F.sha2(F.col("u.form"), 256).alias("digest")
    )
    return (
        units.join(known, "digest", "left")
        .where("line_no = -1 OR license_id IS NOT NULL")
        .select(
            "doc_id",
            F.when(F.col("line_no") == -1, "document").otherwise("line").alias("unit"),
            F.when(F.col("line_no") >= 0, F.col("line_no")).cast("long").alias("line_no"),
            "digest",
            "license_id",
        )
    )
