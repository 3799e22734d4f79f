"""Pages, evidence and answers to rows (SRC-11, STR-19, 20, 26, 28, 35, CLS-06, 10, 11, PRJ and AGG-16)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

_BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "section", "article", "main", "td", "th"}
_DROPPED = {"script", "style", "noscript", "svg"}
_FRAME = {"nav", "header", "footer", "aside", "form"}
MAIN_WORDS = 60


class _Page(HTMLParser):
    """Text, main text and links of one page."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.stack = url, []
        self.all, self.main, self.body = [], [], []
        self.links: list[list] = []
        self.link = None

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._put("\n")
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        self.stack.append(tag)
        if tag == "a":
            href = dict(attrs).get("href")
            if href:
                to = urldefrag(urljoin(self.url, href))[0]
                if to.startswith(("http://", "https://")):
                    self.link = [to, "", not self._inside(_FRAME)]
                    self.links.append(self.link)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag in _BLOCKS:
            self._put("\n")
        if tag == "a":
            self.link = None

    def handle_data(self, data):
        if not self._inside(_DROPPED):
            self._put(data)
            if self.link is not None:
                self.link[1] += data

    def _inside(self, tags) -> bool:
        return any(t in tags for t in self.stack)

    def _put(self, data: str) -> None:
        self.all.append(data)
        if self._inside({"main", "article"}):
            self.main.append(data)
        if not self._inside(_FRAME):
            self.body.append(data)


def _squeeze(parts: list[str]) -> str:
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


PAGE = "text string, links array<struct<href:string,text:string,content:boolean>>"


def pages(frame: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """SRC-11: add ``page``: struct(text, links) of every page.

    Scripts and styles go; the main or article part is the text when it holds
    ``MAIN_WORDS`` words, else everything outside navigation, header, footer,
    aside and forms.  Links are absolute and lose fragments; ``content`` tells
    those outside the frame.  A null page gives an empty text.
    """

    @F.pandas_udf(PAGE)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for urls, bodies in batches:
            rows = []
            for u, body in zip(urls, bodies):
                p = _Page(u or "")
                p.feed(body or "")
                p.close()
                main = _squeeze(p.main)
                chosen = main if len(main.split()) >= MAIN_WORDS else _squeeze(p.body)
                links = [{"href": h, "text": " ".join(t.split()), "content": c} for h, t, c in p.links]
                rows.append((chosen, links))
            yield pd.DataFrame(rows, columns=["text", "links"])

    return frame.withColumn("page", parse(url, html))


def page_links(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """SRC-11: one row a link: key, pos, href, text, content."""
    return parsed.select(key, F.posexplode("page.links").alias("pos", "l")).select(key, "pos", "l.href", "l.text", "l.content")


def labelled_blocks(evidence: DataFrame, labels: dict[str, tuple[str, ...]], key: str = "id", column: str = "content") -> DataFrame:
    """STR-19: (key, field, value) from ``Label: value`` lines; a value runs on until the next label.

    Lines are numbered and carry the last label seen above them; only lines of
    one text meet.
    """
    known = F.create_map(*(F.lit(x) for field, names in labels.items() for n in names for x in (n.lower(), field)))
    lines = evidence.select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n")).alias("n", "line"))
    bare = F.regexp_replace("line", "[*_#`]", "")
    named = F.element_at(known, F.lower(F.trim(F.regexp_extract(bare, "^\\s*([^:]{1,40}):", 1))))
    rows = lines.select(key, "n", named.alias("label"), F.when(named.isNotNull(), F.regexp_replace(bare, "^[^:]*:", "")).otherwise(bare).alias("said"))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("field", F.last("label", ignorenulls=True).over(upto)).where("field IS NOT NULL AND trim(said) <> ''")
    gathered = F.sort_array(F.collect_list(F.struct("n", F.trim("said").alias("s"))))
    return filled.groupBy(key, "field").agg(F.array_join(F.transform(gathered, lambda x: x["s"]), " ").alias("value"))


def json_answer(c: Column | str) -> Column:
    """STR-20: the JSON object inside a text, fenced, embedded or bare, as a variant; null without one."""
    t = F.col(c) if isinstance(c, str) else c
    braces = F.regexp_extract(F.coalesce(t, F.lit("")), "(?s)\\{.*\\}", 0)
    return F.try_parse_json(F.nullif(braces, F.lit("")))


def answer_rows(answers: DataFrame, fields: dict[str, str], path: str = "$.programmes", limit: int = 40) -> DataFrame:
    """PRJ-02, VER-06: claims of an answer's list, the first ``limit`` (a bound of the answer's format), typed by ``fields``."""
    items = F.try_variant_get(json_answer("answer"), path, "array<variant>")
    rows = answers.select(*(c for c in answers.columns if c != "answer"), F.posexplode(F.slice(items, 1, limit)).alias("claim_no", "v"))
    return rows.select("*", *(F.try_variant_get("v", f"$.{n}", t).alias(n) for n, t in fields.items())).drop("v")


_FIGURE = re.compile(r"(?<![\d.,])(\d{1,3}(?:[.\s ]\d{3})+|\d+)(?:,(\d{1,2}))?\s*(mii|mil\.?|тыс\.?|млн\.?|k|m)?(?!\w)", re.IGNORECASE)
_UNITS = {"mii": 1_000, "mil": 1_000_000, "тыс": 1_000, "млн": 1_000_000, "k": 1_000, "m": 1_000_000}


def figures(c: Column | str) -> Column:
    """STR-26: array of struct(value, start, end): figures with dots or spaces as thousands, a comma as decimal, and multipliers."""

    @F.pandas_udf("array<struct<value:double,start:int,end:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                rows = []
                for m in _FIGURE.finditer((t or "").lower()):
                    value = float(re.sub(r"[.\s ]", "", m[1]) + "." + (m[2] or "0"))
                    rows.append({"value": value * _UNITS.get((m[3] or "").rstrip("."), 1), "start": m.start(), "end": m.end()})
                out.append(rows)
            yield pd.Series(out)

    return found(c)


def money_evidence(claims: DataFrame, markers: dict[str, tuple[str, ...]], caps: dict[str, float]) -> DataFrame:
    """STR-28: add ``proven``: the claimed amount is a figure of the excerpt, its currency's marker stands there, no rival's does, and it is under the currency's cap."""
    low = F.lower(F.coalesce("excerpt", F.lit("")))
    rival, own, cap = F.lit(False), F.lit(False), F.lit(0.0)
    for currency, words in markers.items():
        here = F.rlike(low, F.lit("|".join(re.escape(w.lower()) for w in words)))
        own = F.when(F.col("currency") == currency, here).otherwise(own)
        rival = rival | ((F.col("currency") != currency) & here)
        cap = F.when(F.col("currency") == currency, F.lit(float(caps[currency]))).otherwise(cap)
    stated = F.exists(figures("excerpt"), lambda f: f["value"] == F.col("amount"))
    return claims.withColumn("proven", F.coalesce(stated & own & ~rival & (F.col("amount") <= cap), F.lit(False)))


# The closed list of entity types, in its order.
ENTITY_TYPES = (
    "incorporated-society", "charitable-trust", "marae", "school", "club",
    "informal", "company", "individual", "local-authority", "iwi-hapu",
)
# Words that name each of them in a text.
ENTITIES = {
    "incorporated-society": r"(?<!un)incorporated societ(?:y|ies)|(?<!unincorporated )societies",
    "charitable-trust": r"charit(?:y|ies|able trusts?)|trusts|foundations",
    "marae": r"marae",
    "school": r"schools?|kura|early (?:learning|childhood) centres?",
    "club": r"clubs?",
    "informal": r"unincorporated (?:groups?|societies|associations?)|(?:informal|unregistered) groups?",
    "company": r"business(?:es)?|compan(?:y|ies)",
    "individual": r"individuals?|sole traders?",
    "local-authority": r"(?:local )?councils?|local authorit(?:y|ies)",
    "iwi-hapu": r"iwi|hap[uū]",
}
_OPEN = re.compile(r"\b(?:any|all) (?:legal )?(?:entit(?:y|ies)|organisations?)\b")
_NOT = re.compile(r"\b(?:not|cannot|excluding|except|other than|no)\b")


def parse_entities(eligibility: str | None) -> list[str]:
    """CLS-10: closed list of entity types of one eligibility text; empty means unknown.

    Clauses are read on their own; a type in a negated clause is left out, an
    open-ended noun leaves the list open.
    """
    t = " ".join((eligibility or "").lower().split())
    if not t or _OPEN.search(t):
        return []
    found: list[str] = []
    for clause in re.split(r"[.;]|\bbut\b", t):
        if _NOT.search(clause):
            continue
        for name, words in ENTITIES.items():
            if name not in found and re.search(rf"\b(?:{words})\b", clause):
                found.append(name)
    return sorted(found)


def entities(listings: DataFrame, column: str = "eligibility") -> DataFrame:
    """CLS-10: add ``entities``; every distinct text is parsed once."""

    @F.pandas_udf("array<string>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([parse_entities(x) for x in s])

    distinct = listings.select(column).distinct().withColumn("entities", parse(column))
    # null-safe: a null text has its own entry
    renamed = distinct.withColumnRenamed(column, "__e")
    return listings.join(renamed, F.col(column).eqNullSafe(F.col("__e")), "left").drop("__e")


def need_mentioned(c: Column | str, words: tuple[str, ...]) -> Column:
    """CLS-11: one of the words, not negated within the 25 characters before it."""
    t = text.fold(c)
    return F.rlike(t, F.lit(f"(?<!\\b(?:not|no|never|exclud(?:es|ing)|except)\\b.{{0,20}})\\b(?:{'|'.join(words)})"))


def not_covered(c: Column | str, outside: tuple[str, ...], inclusive: tuple[str, ...]) -> Column:
    """CLS-06: names an area outside with no inclusive phrase before it."""
    t = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    before = F.regexp_extract(t, f"(?s)^(.*?)\\b(?:{'|'.join(outside)})\\b", 1)
    return F.rlike(t, F.lit(f"\\b(?:{'|'.join(outside)})\\b")) & ~F.rlike(before, F.lit("|".join(inclusive)))


def site_belongs(host: Column | str, name: Column | str, stop: tuple[str, ...]) -> Column:
    """STR-35: the host is the funder's: its acronym, a distinctive word, or the words run together."""
    h = F.regexp_replace(F.lower(F.col(host) if isinstance(host, str) else host), "^www\\.", "")
    label = F.substring_index(h, ".", 1)
    words = F.filter(F.split(F.trim(F.regexp_replace(text.to_ascii(name), "[^a-z0-9]+", " ")), " "), lambda w: (w != "") & ~w.isin(*stop))
    acronym = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    together = F.array_join(words, "")
    return ((F.length(acronym) >= 3) & (label == acronym)) | F.exists(words, lambda w: (F.length(w) >= 5) & F.contains(label, w)) | ((together != "") & (label == together))


def sections(reports: DataFrame, key: str = "id", column: str = "content") -> DataFrame:
    """PRJ-07: (key, section, n, line): the lines of a report below their heading."""
    lines = reports.select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n")).alias("n", "line"))
    heading = F.nullif(F.trim(F.regexp_extract("line", "^#+\\s*(.*)$", 1)), F.lit(""))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("h", heading).withColumn("section", F.last("h", ignorenulls=True).over(upto))
    return marked.where("h IS NULL AND section IS NOT NULL AND trim(line) <> ''").select(key, "section", "n", F.trim("line").alias("line"))


def public_record(listings: DataFrame, base: str) -> DataFrame:
    """PRJ-03: nested public record, field by field from an allow-list."""
    slug = text.slug("funder")
    return listings.select(
        "id",
        F.struct(
            F.col("id"),
            F.col("title"),
            F.struct(text.strip_parentheses("funder").alias("name"), slug.alias("slug"), F.when(slug != "", F.concat(F.lit(base + "/funders/"), slug)).alias("url")).alias("funder"),
            F.struct(F.col("deadline_state").alias("state"), F.when(F.col("deadline_state") == "dated", F.col("deadline")).alias("date")).alias("deadline"),
            F.struct(F.nullif("amount_min", F.lit(0)).alias("min"), F.nullif("amount_max", F.lit(0)).alias("max"), "currency").alias("amount"),
            text.http_url("source_url").alias("source_url"),
            F.when(F.col("status") == "stale", "not confirmed recently").alias("notice"),
        ).alias("record"),
    )


def brief(listings: DataFrame) -> DataFrame:
    """PRJ-04: legacy brief as JSON without empty members."""
    part = F.struct("id", "title", F.nullif("eligibility", F.lit("")).alias("eligibility"), F.col("amount_max").alias("budget"), F.nullif("deadline", F.lit("TBC")).alias("deadline"))
    return listings.select("id", F.to_json(part, {"ignoreNullFields": "true"}).alias("brief"))


def cited_urls(responses: DataFrame) -> DataFrame:
    """AGG-16: urls cited by a response in any of three shapes, in order."""
    v = F.try_parse_json("response")
    shapes = (
        F.try_variant_get(v, "$.citations", "array<string>"),
        F.transform(F.try_variant_get(v, "$.output.annotations", "array<struct<url:string>>"), lambda a: a["url"]),
        F.transform(F.try_variant_get(v, "$.content.citations", "array<struct<url:string>>"), lambda a: a["url"]),
    )
    return responses.withColumn("urls", F.coalesce(*shapes, F.array().cast("array<string>")))
