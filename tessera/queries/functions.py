"""Queries of the column functions over listings, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import classify, dates, text
from tessera.operators import publish
from tessera.queries import query
from tessera.session import table
from tessera.sources.adapters import REGIONS, TODAY, view

ZONE = "Pacific/Auckland"
_ASOF = f"DATE '{TODAY}'"
STATUS_SQL = f"""CASE WHEN deadline_state = 'closed' THEN 'closed'
  WHEN deadline_state = 'dated' THEN CASE WHEN deadline::DATE < {_ASOF} THEN 'closed' ELSE 'live' END
  WHEN deadline_state IN ('rolling-confirmed', 'not-stated') AND {_ASOF} - timezone('{ZONE}', verified_at::TIMESTAMPTZ)::DATE <= 75 THEN 'live' ELSE 'stale' END"""


def today():
    return F.lit(TODAY).cast("date")


def with_status(listings, day=None):
    return listings.withColumn("status", dates.status_as_of("deadline_state", "deadline", "verified_at", today() if day is None else day, ZONE))


@query(f"SELECT id, {STATUS_SQL} AS status FROM v_opp")
def status_asof(spark, sf_dir):
    """DAT-01, STM-09."""
    return with_status(view(spark, sf_dir, "v_opp")).select("id", "status")


@query(f"SELECT id, timezone('{ZONE}', (deadline::DATE + 1)::TIMESTAMP) AT TIME ZONE 'UTC' AS closed_at FROM v_opp WHERE deadline_state = 'dated'")
def close_instants(spark, sf_dir):
    """DAT-02."""
    return view(spark, sf_dir, "v_opp").where("deadline_state = 'dated'").select("id", dates.closed_at("deadline", ZONE).alias("closed_at"))


@query(f"""WITH s AS (SELECT id, {STATUS_SQL} AS before, {STATUS_SQL.replace(_ASOF, f"({_ASOF} + 1)")} AS after FROM v_opp) SELECT * FROM s WHERE before <> after""")
def freshness_flips(spark, sf_dir):
    """STM-09: rows whose status changes at the next local midnight."""
    rows = view(spark, sf_dir, "v_opp")
    status = lambda day: dates.status_as_of("deadline_state", "deadline", "verified_at", day, ZONE)
    return rows.select("id", status(today()).alias("before"), status(F.date_add(today(), 1)).alias("after")).where("before <> after")


_DAYS = f"""days AS (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY))::DATE AS day),
e AS (SELECT id, day, {STATUS_SQL.replace(_ASOF, "(day - 1)")} AS before, {STATUS_SQL.replace(_ASOF, "day")} AS after FROM v_opp, days)"""
YEAR = ("1998-01-01", "1998-12-31")


@query(f"WITH {_DAYS} SELECT * FROM e WHERE before <> after")
def status_flips(spark, sf_dir):
    """STM-09: every change of status in a year; the SQL looks at each day."""
    first, last = (F.lit(d).cast("date") for d in YEAR)
    return publish.status_flips(view(spark, sf_dir, "v_opp"), first, last, ZONE)


@query(f"WITH {_DAYS}, c AS (SELECT day, after AS status, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT day, unnest(['live', 'closed', 'stale']) AS status FROM days) SELECT day, status, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (day, status)")
def status_days(spark, sf_dir):
    """STM-09: rows by status on every day of a year."""
    first, last = (F.lit(d).cast("date") for d in YEAR)
    return publish.status_days(view(spark, sf_dir, "v_opp"), first, last, ZONE)


@query(f"""WITH d AS (SELECT id, deadline_state AS s, try_cast(CASE WHEN deadline LIKE '____-__-__' THEN deadline END AS DATE) AS due FROM v_opp)
SELECT id, CASE WHEN s = 'closed' THEN 'closed' WHEN s = 'rolling-confirmed' THEN 'rolling-confirmed' WHEN s = 'unresolved' OR due IS NULL THEN 'unknown'
 WHEN due < {_ASOF} THEN 'closed' ELSE 'dated' END AS kind, CASE WHEN s NOT IN ('closed', 'rolling-confirmed', 'unresolved') AND due >= {_ASOF} THEN due - {_ASOF} END AS days FROM d""")
def deadline_kinds(spark, sf_dir):
    """DAT-06."""
    k = dates.deadline_kind("deadline_state", "deadline", today())
    return view(spark, sf_dir, "v_opp").select("id", k["kind"].alias("kind"), k["days"].alias("days"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m') AS next_due,
 [strftime(date_trunc('month', o_orderdate) - to_months(3 - i::INT), '%Y-%m') FOR i IN range(3)] AS earlier FROM orders""")
def month_arithmetic(spark, sf_dir):
    """DAT-05, CDC-04."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf_dir, "orders").select("o_orderkey", month.alias("month"), dates.add_months(month, 2).alias("next_due"), dates.months_before(month, 3).alias("earlier"))


@query("""SELECT event_id, t + INTERVAL 7 DAY AS expires_at, greatest(0, epoch(t + INTERVAL 7 DAY) - epoch(TIMESTAMP '2024-01-20'))::BIGINT AS remaining_seconds,
 t + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20' AS expired FROM (SELECT event_id, date_trunc('second', ts) AS t FROM v_hit)""")
def cooldowns(spark, sf_dir):
    """DAT-07."""
    rows = view(spark, sf_dir, "v_hit").withColumn("ts", F.date_trunc("second", "ts"))
    c = dates.cooldown("ts", F.lit("2024-01-20").cast("timestamp"))
    return rows.select("event_id", c["expires_at"].alias("expires_at"), c["remaining_seconds"].alias("remaining_seconds"), c["expired"].alias("expired"))


@query(r"SELECT id, trim(regexp_replace(replace(strip_accents(lower(title)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS title_norm FROM v_opp")
def normalise_titles(spark, sf_dir):
    """STR-01, 02, 07."""
    return view(spark, sf_dir, "v_opp").select("id", text.normalise_title("title").alias("title_norm"))


@query(r"SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS folded FROM documents WHERE lang IN ('fr', 'es', 'en')")
def fold_documents(spark, sf_dir):
    """STR-02, 03 over accented prose."""
    return table(spark, sf_dir, "documents").where("lang IN ('fr', 'es', 'en')").select("doc_id", text.normalise_title("text").alias("folded"))


_URL = r"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*(.*)$', 1)"


def _url_sql(u: str) -> str:
    rest = _URL.format(u=u)
    return rf"""regexp_replace(lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract({rest}, '^[^?#]*'), '/+$', '')
 || CASE WHEN regexp_extract({rest}, '^[^?#]*\?([^#]*)', 1) <> '' THEN '?' || regexp_extract({rest}, '^[^?#]*\?([^#]*)', 1) ELSE '' END"""


@query(f"SELECT page_id AS id, {_url_sql('url')} AS url_norm FROM pages UNION ALL SELECT pos, {_url_sql('source_url')} FROM v_opp")
def normalise_urls(spark, sf_dir):
    """STR-10."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.normalise_url("url").alias("url_norm"))
    return pages.unionByName(view(spark, sf_dir, "v_opp").select(F.col("pos").alias("id"), text.normalise_url("source_url").alias("url_norm")))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '^[^/?]*'), '^www\.', '') AS domain,
 CASE WHEN regexp_matches(url, '^https?://[^/?#:@]+') AND NOT regexp_matches(url, '[\x00-\x20\x7F]') THEN url END AS safe_url FROM pages""")
def url_domains(spark, sf_dir):
    """STR-11, STR-14."""
    return table(spark, sf_dir, "pages").select("page_id", text.domain("url").alias("domain"), text.http_url("url").alias("safe_url"))


@query(r"""SELECT page_id, nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/(en|de|fr|es)(?:/|$)', 1), '') AS language,
 regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '') || '/' ||
 array_to_string([p FOR p IN string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') IF p <> '' AND p NOT IN ('en', 'de', 'fr', 'es')], '/') AS language_key FROM pages""")
def url_languages(spark, sf_dir):
    """STR-15, STR-16."""
    languages = ("en", "de", "fr", "es")
    return table(spark, sf_dir, "pages").select("page_id", text.url_language("url", languages).alias("language"), text.language_key("url", languages).alias("language_key"))


@query(r"""SELECT id, CASE WHEN deadline_state = 'dated' THEN deadline WHEN k2 THEN 'rolling' ELSE 'TBC' END AS deadline_read FROM (SELECT *, deadline = 'rolling' AS k2 FROM v_opp) WHERE deadline_state <> 'unresolved' """)
def parse_deadlines(spark, sf_dir):
    """STR-22: deadlines read back from sentences in three forms."""
    rows = view(spark, sf_dir, "v_opp").where("deadline_state <> 'unresolved'")
    due = dates.strict_date("deadline")
    said = (
        F.when(due.isNotNull() & (F.col("pos") % 2 == 0), F.concat(F.lit("Closes "), F.date_format(due, "d MMMM yyyy"), F.lit(".")))
        .when(due.isNotNull(), F.concat(F.lit("Closes on "), F.col("deadline"), F.lit(" at noon")))
        .otherwise(F.concat(F.lit("Applications: "), F.col("deadline")))
    )
    return rows.select("id", text.deadline_text(said).alias("deadline_read"))


@query("""SELECT id, CASE WHEN amount_max IS NULL THEN NULL WHEN pos % 3 = 1 THEN amount_max WHEN pos % 3 = 2 THEN 5000 END AS amount_min,
 CASE WHEN amount_max IS NULL THEN NULL WHEN pos % 3 = 0 THEN amount_max WHEN pos % 3 = 2 THEN 20000 END AS amount_max
FROM v_opp WHERE amount_max IS NULL OR amount_max >= 100""")
def parse_amounts(spark, sf_dir):
    """STR-21: amounts read back from three kinds of sentence."""
    rows = view(spark, sf_dir, "v_opp").where("amount_max IS NULL OR amount_max >= 100")
    said = F.expr("""CASE WHEN amount_max IS NULL THEN 'varies' WHEN pos % 3 = 0 THEN concat('up to $', format_number(amount_max, 0))
      WHEN pos % 3 = 1 THEN concat('from ', format_number(amount_max, 0), ' dollars') ELSE 'between $5k and $20k' END""")
    a = text.amount_range(said)
    return rows.select("id", a["amount_min"].alias("amount_min"), a["amount_max"].alias("amount_max"))


@query(f"""SELECT id, CASE WHEN contains(lower(e), 'nationwide') OR len(f) = 0 THEN ['national'] ELSE f END AS regions FROM (
 SELECT id, e, [r FOR r IN {list(REGIONS)} IF contains(lower(e), r) OR contains(lower(e), replace(r, '-', ' '))] AS f
 FROM (SELECT id, CASE WHEN pos % 5 = 0 THEN 'Nationwide' ELSE 'Open in ' || replace(region[1], '-', ' ') END AS e FROM v_opp))""")
def parse_regions(spark, sf_dir):
    """STR-23."""
    said = F.when(F.col("pos") % 5 == 0, "Nationwide").otherwise(F.concat(F.lit("Open in "), F.replace(F.get("region", 0), F.lit("-"), F.lit(" "))))
    return view(spark, sf_dir, "v_opp").select("id", text.regions_in(said, REGIONS, ("nationwide",)).alias("regions"))


@query("""SELECT id, [t FOR t IN tags IF t IN ('arts', 'sport', 'health')] AS tags FROM v_opp""")
def validate_tags(spark, sf_dir):
    """STR-24."""
    said = F.array_join(F.transform("tags", lambda t: F.concat(F.lit(" "), F.upper(t))), ";")
    return view(spark, sf_dir, "v_opp").select("id", text.split_tags(said, ("arts", "sport", "health")).alias("tags"))


@query("""SELECT id, [CASE t WHEN 'arts' THEN 'culture' ELSE 'wellbeing' END FOR t IN tags IF t IN ('arts', 'sport')] AS mapped FROM v_opp""")
def map_labels(spark, sf_dir):
    """STR-25."""
    return view(spark, sf_dir, "v_opp").select("id", text.labels_to_tags("tags", {"arts": "culture", "sport": "wellbeing"}).alias("mapped"))


@query(r"""SELECT pos, trim(regexp_replace(trim(funder), '\s*\([^)]*\)\s*', ' ', 'g')) AS stripped,
 trim(regexp_replace(lower(funder), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM v_opp""")
def funder_slugs(spark, sf_dir):
    """STR-04, STR-06."""
    return view(spark, sf_dir, "v_opp").select("pos", text.strip_parentheses("funder").alias("stripped"), text.slug("funder").alias("slug"))


@query(r"""SELECT id, list_sort(list_distinct([substr(w, 1, 6) FOR w IN string_split(trim(regexp_replace(replace(lower(title), '-', ''), '[^a-z0-9]+', ' ', 'g')), ' ')
  IF w <> '' AND w NOT IN ('programme', 'the')])) AS stems FROM v_opp""")
def title_stems(spark, sf_dir):
    """STR-09."""
    return view(spark, sf_dir, "v_opp").select("id", text.title_stems("title", ("programme", "the")).alias("stems"))


@query("""SELECT id, contains(regexp_replace(lower(summary), '[,\\s]', '', 'g'), amount_max::VARCHAR) OR amount_max IS NULL AS stated FROM v_opp""".replace("\\\\", "\\"))
def figures_stated(spark, sf_dir):
    """STR-27."""
    return view(spark, sf_dir, "v_opp").select("id", text.figures_in("summary", F.col("amount_max")).alias("stated"))


@query("""WITH s AS (SELECT doc_id, (contains(t, 'the'))::INT + (contains(t, 'tion'))::INT AS a, (contains(t, 'que'))::INT + (contains(t, 'eau'))::INT AS b,
 (contains(t, 'der'))::INT + contains(t, 'sch')::INT AS c FROM (SELECT doc_id, lower(text) AS t FROM documents))
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END AS code FROM s""")
def sector_codes(spark, sf_dir):
    """STR-29: the code with most keywords, the first of equals."""
    words = {"A": ("the", "tion"), "B": ("que", "eau"), "C": ("der", "sch")}
    return table(spark, sf_dir, "documents").select("doc_id", text.best_keyword("text", words).alias("code"))


@query(r"""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'user.' || user_id || '@mail' || user_id % 3 || '.example.com' END AS email FROM events""")
def normalise_emails(spark, sf_dir):
    """STR-30: addresses in several spellings; broken ones give null."""
    raw = F.expr("""CASE WHEN user_id % 5 = 0 THEN concat('user', user_id, '@@mail.example') ELSE
      concat(' User.', user_id, '@MAIL', user_id % 3, '.Example.com ') END""")
    return table(spark, sf_dir, "events").select("event_id", text.email(raw).alias("email"))


@query("""SELECT pos, CASE WHEN pos % 4 = 1 THEN 'document' WHEN pos % 4 = 2 THEN 'dated path' WHEN pos % 4 = 3 AND pos % 8 = 3 THEN 'headline' WHEN pos % 4 = 3 THEN NULL
 WHEN pos % 8 = 0 THEN 'news' END AS problem FROM v_opp""")
def page_problems(spark, sf_dir):
    """STR-17: why a url is no funding page."""
    url = F.expr("""CASE pos % 4 WHEN 1 THEN 'https://x.org/files/form.PDF' WHEN 2 THEN 'https://x.org/2024/05/item' WHEN 3 THEN
      CASE WHEN pos % 8 = 3 THEN 'https://x.org/we-are-glad-to-say-hello-everyone' ELSE 'https://x.org/community-grant-fund-for-all-the-people' END
      ELSE CASE WHEN pos % 8 = 0 THEN 'https://x.org/news/item' ELSE 'https://x.org/grants' END END""")
    return view(spark, sf_dir, "v_opp").select("pos", text.page_problem(url, ("grant", "fund"), ("news", "media")).alias("problem"))


@query("""SELECT doc_id, regexp_matches(lower(text), '\\b(than|under)') AS hit FROM documents WHERE lang = 'en'""".replace("\\\\", "\\"))
def keyword_pages(spark, sf_dir):
    """STR-18: a word that starts with one of the keywords."""
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", text.has_word_start("text", ("than", "under")).alias("hit"))


@query("""SELECT pos, CASE pos % 3 WHEN 0 THEN 'a b/c' WHEN 1 THEN 'a+b%' ELSE 'x&y' END AS decoded FROM v_opp""")
def percent_decoded(spark, sf_dir):
    """STR-12."""
    raw = F.expr("CASE pos % 3 WHEN 0 THEN 'a%252520b%252Fc' WHEN 1 THEN 'a+b%' ELSE 'x%26y' END")
    return view(spark, sf_dir, "v_opp").select("pos", text.percent_decode(raw).alias("decoded"))


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'confirmed' WHEN 'error' THEN 'unsubscribed' ELSE 'pending' END AS state FROM events""")
def subscriber_state_of(spark, sf_dir):
    """CLS-08."""
    rows = table(spark, sf_dir, "events")
    at = lambda *kinds: F.when(F.col("event_type").isin(*kinds), F.col("ts"))
    return rows.select("event_id", classify.subscriber_state(at("click", "error"), at("error")).alias("state"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'stripe' WHEN c_custkey % 5 = 0 THEN 'licence' WHEN c_custkey % 5 = 1 THEN 'dev' ELSE 'unexplained' END AS origin FROM customer""")
def plan_origins(spark, sf_dir):
    """CLS-09, FLT-16: provenance of paid plans."""
    c = F.expr
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", classify.plan_source(
        c("CASE WHEN c_custkey % 4 = 0 THEN 'free' ELSE 'starter' END"), c("CASE c_custkey % 5 WHEN 0 THEN 'licence' WHEN 1 THEN 'dev' END"), c("CASE WHEN c_custkey % 3 = 0 THEN 'sub' END")
    ).alias("origin"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'watcher-empty' WHEN c_custkey % 2 = 0 OR c_custkey % 7 = 0 THEN 'reporter-blocked' ELSE 'OK' END AS health FROM customer""")
def cycle_health_of(spark, sf_dir):
    """CLS-07."""
    return table(spark, sf_dir, "customer").select("c_custkey", classify.cycle_health(F.expr("c_custkey % 3"), F.expr("c_custkey % 2"), F.expr("c_custkey % 7 = 0")).alias("health"))


@query("""SELECT pos, CASE WHEN pos % 9 = 0 THEN 'kind' WHEN pos % 4 = 0 THEN 'title' WHEN pos % 5 = 0 THEN 'summary' END AS reason FROM v_opp""")
def not_grants(spark, sf_dir):
    """CLS-05."""
    e = F.expr
    return view(spark, sf_dir, "v_opp").select("pos", classify.not_a_grant(
        e("CASE WHEN pos % 4 = 0 THEN 'Business loan' WHEN pos % 6 = 1 THEN 'Loans and grants' ELSE title END"),
        e("CASE WHEN pos % 9 = 0 THEN 'Tender' ELSE 'grant' END"), e("CASE WHEN pos % 5 = 0 THEN 'A loan for you' ELSE summary END"),
        ("loan", "tender"), ("grant",), ("tender", "job"),
    ).alias("reason"))


@query(f"""SELECT pos, pos % 7 = 0 OR coalesce(try_cast(CASE WHEN deadline LIKE '____-__-__' THEN deadline END AS DATE) < {_ASOF}, false) AS expired FROM v_opp""")
def expired_text(spark, sf_dir):
    """CLS-12."""
    said = F.expr("CASE WHEN pos % 7 = 0 THEN 'Now closed for applications' ELSE summary END")
    return view(spark, sf_dir, "v_opp").select("pos", classify.expired(said, "deadline", today(), ("now closed", "has closed")).alias("expired"))
