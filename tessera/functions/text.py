"""Names, titles, urls and free text (STR operators) as native column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic letters in Latin, one letter each ...
CYRILLIC = (
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("ё", "e"), ("з", "z"), ("и", "i"), ("й", "i"),
    ("к", "k"), ("л", "l"), ("м", "m"), ("н", "n"), ("о", "o"), ("п", "p"), ("р", "r"), ("с", "s"), ("т", "t"), ("у", "u"),
    ("ф", "f"), ("ы", "y"), ("э", "e"),
)
# ... several letters, or none
CYRILLIC_LONG = (
    ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ъ", ""), ("ь", ""), ("ю", "yu"), ("я", "ya"), ("ӂ", "dzh"),
)
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)


def _accents() -> tuple[str, str]:
    """Accented Latin letters whose compatibility form is one ASCII letter and marks."""
    pairs = []
    for code in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, UNACCENTED = _accents()
_MARKS = "[\\u0300-\\u036F]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _unless_ascii(c: Column | str, other: Column) -> Column:
    """``other`` where a text has a character beyond ASCII, which alone it changes, else the text: letters need not be looked up one by one."""
    whole = _text(c)
    return F.when(F.octet_length(whole) == F.char_length(whole), whole).otherwise(other)


def transliterate(c: Column | str) -> Column:
    """STR-01: Cyrillic letters to lower-case Latin, all other text untouched; null gives empty."""
    both = [(x, y) for pairs in (CYRILLIC,) for a, b in pairs for x, y in ((a, b), (a.upper(), b))]
    out = F.translate(_text(c), "".join(a for a, _ in both), "".join(b for _, b in both))
    many = [(x, b) for a, b in CYRILLIC_LONG for x in (a, a.upper())]
    long = reduce(lambda acc, ab: F.replace(acc, F.lit(ab[0]), F.lit(ab[1])), many, out)
    return _unless_ascii(c, F.when(F.rlike(out, F.lit("[\\u0400-\\u04FF]")), long).otherwise(out))


def unaccent(c: Column | str) -> Column:
    """Accented Latin letters to their base letters, combining marks dropped."""
    return _unless_ascii(c, F.regexp_replace(F.translate(_text(c), ACCENTED, UNACCENTED), _MARKS, ""))


def to_ascii(c: Column | str) -> Column:
    """STR-02: lower case, Cyrillic in Latin, accents folded."""
    return F.lower(unaccent(transliterate(F.lower(_text(c)))))


def fold(c: Column | str) -> Column:
    """STR-03: lower case without accents, one kind of dash and quote, single spaces."""
    out = F.translate(unaccent(F.lower(_text(c))), "‐‑‒–—―‘’ʼ“”", "------'''\"\"")
    return F.trim(F.regexp_replace(out, "(?U)\\s+", " "))


def slugify(c: Column | str) -> Column:
    """STR-04: folded text with underscores, slashes and spaces as hyphens and no apostrophes."""
    return F.regexp_replace(F.replace(fold(c), F.lit("'"), F.lit("")), "[_/\\s]+", "-")


def strip_parentheses(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(_text(c)), "\\s*\\([^)]*\\)\\s*", " "))


def slug(c: Column | str) -> Column:
    """STR-06 on a canonical name: ASCII letters and digits joined by hyphens."""
    return F.btrim(F.regexp_replace(to_ascii(c), "[^a-z0-9]+", "-"), F.lit("-"))


def normalise_title(c: Column | str) -> Column:
    """STR-07: ASCII, ``&`` as and, everything else a single space."""
    out = F.replace(F.lower(unaccent(transliterate(c))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def title_key(c: Column | str, folded: Column | bool) -> Column:
    """STR-08: key for one sweep; diacritics fold only where the country says so."""
    folded = F.lit(folded) if isinstance(folded, bool) else folded
    low = F.lower(transliterate(c))
    return F.trim(F.regexp_replace(F.when(folded, unaccent(low)).otherwise(low), "(?U)[^\\w]+|_", " "))


def title_stems(c: Column | str, stop: tuple[str, ...], letters: int = 6) -> Column:
    """STR-09: distinct words cut to ``letters``, hyphens closed, stopwords out."""
    words = F.split(F.trim(F.regexp_replace(F.replace(fold(c), F.lit("-"), F.lit("")), "[^a-z0-9]+", " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*stop))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, letters))))


def host(url: Column | str) -> Column:
    """Lower-case host of an absolute url, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(_text(url), "^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _after_host(url: Column | str) -> Column:
    return F.regexp_extract(F.trim(_text(url)), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(_after_host(url), "^[^?#]*", 0)


def query(url: Column | str) -> Column:
    return F.regexp_extract(_after_host(url), "^[^?#]*\\?([^#]*)", 1)


def normalise_url(url: Column | str) -> Column:
    """STR-10: host without ``www.`` and path without closing slashes, query kept, no scheme or fragment."""
    bare = F.regexp_replace(F.coalesce(host(url), F.lit("")), "^www\\.", "")
    asked = query(url)
    return F.concat(
        bare, F.regexp_replace(path(url), "/+$", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")
    )


def domain(url: Column | str) -> Column:
    """STR-11: bare host of anything url-like, empty if there is nothing."""
    bare = F.regexp_replace(F.lower(F.trim(_text(url))), "^[a-z]+://", "")
    return F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), "^www\\.", "")


def percent_decode(c: Column | str) -> Column:
    """STR-12: percent-decoded to a fixed point, three times at most; plus signs stay, bad escapes stay."""
    once = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    return once(once(once(_text(c))))


def same_page(a: Column | str, b: Column | str) -> Column:
    """STR-13: equal but for scheme, ``www.`` and a closing slash."""
    return normalise_url(a) == normalise_url(b)


def http_url(url: Column | str) -> Column:
    """STR-14: the url if it is absolute http(s) with a host and no control characters or spaces, else null."""
    c = F.col(url) if isinstance(url, str) else url
    ok = F.rlike(c, F.lit("^(?i)https?://(?:[^/?#@]*@)?[^/?#:@]+")) & ~F.rlike(c, F.lit("[\\x00-\\x20\\x7F]"))
    return F.when(ok, c)


def url_language(url: Column | str, languages: tuple[str, ...]) -> Column:
    """STR-15: language named by the query, then by the first two path parts, then by a ``_xx`` ending."""
    one = "|".join(languages)
    found = lambda text, pattern: F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit(""))
    return F.coalesce(
        found(query(url), f"(?i)(?:^|&)(?:lang|language|locale|hl)=({one})(?:[-_][a-z]+)?(?:&|$)"),
        found(path(url), f"(?i)^/({one})(?:/|$)"),
        found(path(url), f"(?i)^/[^/]*/({one})(?:/|$)"),
        found(path(url), f"(?i)_({one})(?:\\.[a-z]+)?$"),
    )


def language_key(url: Column | str, languages: tuple[str, ...]) -> Column:
    """STR-16: url with its language parts left out, so translated copies meet."""
    one = "|".join(languages)
    parts = F.filter(F.split(path(url), "/"), lambda p: (p != "") & ~F.lower(p).isin(*languages))
    kept = F.regexp_replace(F.array_join(parts, "/"), f"(?i)_({one})(\\.[a-z]+)?$", "$2")
    return F.concat(F.regexp_replace(F.coalesce(host(url), F.lit("")), "^www\\.", ""), F.lit("/"), kept)


def page_problem(
    url: Column | str, funding_words: tuple[str, ...], news_parts: tuple[str, ...], documents: tuple[str, ...] = ("pdf", "doc", "docx", "xls", "xlsx", "zip")
) -> Column:
    """STR-17: why a url is no funding page, null if it may be one.

    A document, a dated path, a news part, or a headline: ten words or more,
    or seven without a funding word.
    """
    low = F.lower(path(url))
    parts = F.filter(F.split(low, "/"), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    words = F.size(F.filter(F.split(F.regexp_replace(last, "\\.[a-z]+$", ""), "[-_]"), lambda w: w != ""))
    funding = F.rlike(last, F.lit("|".join(funding_words)))
    return (
        F.when(F.rlike(low, F.lit(f"\\.({'|'.join(documents)})$")), "document")
        .when(F.rlike(low, F.lit("/(19|20)[0-9]{2}/(0?[1-9]|1[0-2])(/|$)")), "dated path")
        .when(F.exists(parts, lambda p: p.isin(*news_parts)), "news")
        .when((words >= 10) | ((words >= 7) & ~funding), "headline")
    )


def has_word_start(c: Column | str, words: tuple[str, ...]) -> Column:
    """STR-18: some word of the text starts with one of ``words``."""
    return F.rlike(F.lower(_text(c)), F.lit(f"(?U)(?<!\\w)(?:{'|'.join(words)})"))


def _amounts(c: Column | str) -> Column:
    text = _text(c)
    pattern = "\\$?\\s*([0-9]{1,3}(?:[,\\s][0-9]{3})*|[0-9]+)(?:\\.[0-9]+)?\\s*([kKmM])?"
    numbers = F.regexp_extract_all(text, F.lit(pattern), 1)
    units = F.regexp_extract_all(text, F.lit(pattern), 2)
    value = F.zip_with(
        numbers,
        units,
        lambda n, u: F.try_multiply(
            F.regexp_replace(n, "[,\\s]", "").try_cast("bigint"),
            F.when(F.lower(u) == "k", F.lit(1_000)).when(F.lower(u) == "m", F.lit(1_000_000)).otherwise(F.lit(1)).cast("bigint"),
        ),
    )
    return F.filter(value, lambda v: v.between(100, 100_000_000))


def amount_range(c: Column | str) -> Column:
    """STR-21: struct(amount_min, amount_max) read from free text, null where it says nothing."""
    text, found = F.lower(_text(c)), _amounts(c)
    none = F.lit(None).cast("bigint")
    low, high = F.array_min(found), F.array_max(found)
    has = lambda *w: reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in w))
    up, down = has("up to", "maximum", "max "), has("from ", "minimum", "starts at", "at least")
    empty = F.size(found) == 0
    one = F.size(found) == 1
    return F.struct(
        F.when(empty | up, none).when(down, low).when(one, none).otherwise(low).alias("amount_min"),
        F.when(empty, none).when(up, high).when(down, none).when(one, F.get(found, 0)).otherwise(high).alias("amount_max"),
    )


def deadline_text(c: Column | str) -> Column:
    """STR-22: ``rolling``, an ISO date as written, a date from day, month name and year, else ``TBC``."""
    text = _text(c)
    low = F.lower(F.trim(text))
    pattern = "\\b([0-9]{1,2})\\s+([A-Za-z]{3,9})\\s+([0-9]{4})\\b"
    part = lambda k: F.regexp_extract_all(text, F.lit(pattern), k)
    names = F.create_map(*(F.lit(x) for n, m in enumerate(MONTHS, 1) for k in {m, m[:3], *(("sept",) if n == 9 else ())} for x in (k, f"{n:02d}")))
    dates = F.filter(
        F.transform(
            F.arrays_zip(part(1).alias("d"), part(2).alias("m"), part(3).alias("y")),
            lambda x: F.concat_ws("-", x["y"], F.element_at(names, F.lower(x["m"])), F.lpad(x["d"], 2, "0")),
        ),
        lambda s: F.length(s) == 10,
    )
    return (
        F.when(F.rlike(low, F.lit("rolling|open all year|continuous|no deadline")), "rolling")
        .when(F.rlike(text, F.lit("\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b")), F.regexp_extract(text, "\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b", 1))
        .otherwise(F.coalesce(F.get(dates, 0), F.lit("TBC")))
    )


def regions_in(c: Column | str, regions: tuple[str, ...], national: tuple[str, ...]) -> Column:
    """STR-23: regions named by slug or in words; a national synonym or nothing at all gives national."""
    text = F.lower(_text(c))
    every = F.array(*(F.lit(r) for r in regions))
    found = F.filter(every, lambda r: F.contains(text, r) | F.contains(text, F.replace(r, F.lit("-"), F.lit(" "))))
    wide = reduce(lambda a, b: a | b, (F.contains(text, F.lit(s.lower())) for s in national), F.lit(False))
    return F.when(wide | (F.size(found) == 0), F.array(F.lit("national"))).otherwise(found)


def valid_tags(tags: Column | str, vocabulary: tuple[str, ...]) -> Column:
    """STR-24: trimmed lower-case tags of the vocabulary, distinct in order."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t.isin(*vocabulary)))


def split_tags(c: Column | str, vocabulary: tuple[str, ...]) -> Column:
    return valid_tags(F.split(_text(c), "[,;|]"), vocabulary)


def labels_to_tags(labels: Column | str, mapping: dict[str, str]) -> Column:
    """STR-25: tags of known labels, distinct in order."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    known = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.array_distinct(F.filter(F.transform(labels, lambda v: F.element_at(known, v)), lambda t: t.isNotNull()))


def figures_in(excerpt: Column | str, *amounts: Column) -> Column:
    """STR-27: every stated amount occurs in the excerpt, in digits or as thousands with k."""
    bare = F.regexp_replace(F.lower(_text(excerpt)), "[,\\s]", "")

    def one(a: Column) -> Column:
        whole = a.cast("bigint")
        short = (whole % 1000 == 0) & F.contains(bare, F.concat((whole / 1000).cast("bigint").cast("string"), F.lit("k")))
        return a.isNull() | F.contains(bare, whole.cast("string")) | short

    return reduce(lambda a, b: a & b, map(one, amounts))


def best_keyword(c: Column | str, keywords: dict[str, tuple[str, ...]]) -> Column:
    """STR-29: the code with most keywords in the text, the first of equals; null without any."""
    text = F.lower(_text(c))
    scored = F.array(
        *(
            F.struct(
                reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words)).alias("n"),
                F.lit(-k).alias("k"),
                F.lit(code).alias("code"),
            )
            for k, (code, words) in enumerate(keywords.items())
        )
    )
    top = F.array_max(scored)
    return F.when(top["n"] > 0, top["code"])


def email(c: Column | str) -> Column:
    """STR-30: trimmed lower-case address, null unless it is a plain ASCII one with proper labels."""
    low = F.lower(F.trim(_text(c)))
    ok = F.rlike(low, F.lit("^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z][a-z0-9-]*[a-z0-9]$"))
    return F.when(ok & (F.length(low) <= 254) & (F.instr(low, "@") <= 65), low)


def api_prefix(c: Column | str) -> Column:
    """STR-33: ``/api/v1/<first segment>`` of a public path, file endings dropped."""
    parts = F.filter(F.split(_text(c), "/"), lambda p: p != "")
    head = F.substring_index(F.get(parts, 2), ".", 1)
    return F.when(F.size(parts) <= 2, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(F.concat(F.lit("/api/v1/"), head))


def names_on_page(page: Column | str, name: Column | str, stop: tuple[str, ...]) -> Column:
    """STR-36: every distinctive word of the name is a whole word of the page."""
    words = lambda c: F.split(F.trim(F.regexp_replace(to_ascii(c), "[^a-z0-9]+", " ")), " ")
    own = F.filter(F.array_distinct(words(name)), lambda w: (w != "") & ~w.isin(*stop))
    return (F.size(own) > 0) & (F.size(F.array_except(own, words(page))) == 0)


def strip_html(c: Column | str) -> Column:
    """SRC-12: text of an HTML page by tag stripping alone."""
    out = F.regexp_replace(_text(c), "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", " ")
    out = F.regexp_replace(out, "(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "\\s+", " "))
