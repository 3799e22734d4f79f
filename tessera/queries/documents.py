"""Queries over pages, evidence, the link graph and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import extract, graph
from tessera.queries import query
from tessera.queries.functions import STATUS_SQL, with_status
from tessera.session import table
from tessera.sources.adapters import view
from tessera.streaming import counters, states


@query()
def page_text_links(spark, sf_dir):
    """SRC-11: text and links of every page; held against a plain parser by tests."""
    parsed = extract.pages(table(spark, sf_dir, "pages"))
    return parsed.select("page_id", "page.text", F.size("page.links").alias("links"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script)\b[^>]*>.*?</script\s*>|<(style)\b[^>]*>.*?</style\s*>', ' ', 'g'),
 '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def stripped_html(spark, sf_dir):
    """SRC-12."""
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html("html").alias("text"))


@query("""SELECT doc_id AS id, unnest(['title', 'funder', 'deadline']) AS field, unnest(['Programme ' || doc_id || ' second line', 'Funder ' || doc_id % 7, CASE WHEN doc_id % 2 = 0 THEN 'rolling' ELSE 'TBC' END]) AS value FROM documents""")
def labelled_evidence(spark, sf_dir):
    """STR-19, PRJ-01: labelled blocks put together from documents and read back."""
    content = F.expr("""concat('intro text\n**Programme:** Programme ', doc_id, '\n  second line\n', 'Organisation: Funder ', doc_id % 7, '\n\nClosing date: ', CASE WHEN doc_id % 2 = 0 THEN 'rolling' ELSE 'TBC' END)""")
    evidence = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), content.alias("content"))
    labels = {"title": ("Programme", "Title"), "funder": ("Organisation", "Funder"), "deadline": ("Closing date", "Deadline")}
    return extract.labelled_blocks(evidence, labels)


@query("""SELECT doc_id, i AS claim_no, 'Grant ' || i AS title, CASE WHEN i = 0 THEN doc_id * 10 END AS amount FROM documents, range(2) t(i) WHERE doc_id % 5 <> 0""")
def answer_claims(spark, sf_dir):
    """STR-20, PRJ-02, PRJ-08: claims of JSON answers, fenced, embedded, bare or broken."""
    answer = F.expr("""CASE WHEN doc_id % 5 = 0 THEN 'no json {broken' WHEN doc_id % 2 = 0 THEN concat('Here:\n```json\n{"programmes": [{"title": "Grant 0", "amount": ', doc_id * 10, '}, {"title": "Grant 1", "amount": "many"}]}\n```')
      ELSE concat('{"programmes": [{"title": "Grant 0", "amount": ', doc_id * 10, '}, {"title": "Grant 1"}]}') END""")
    rows = table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"))
    return extract.answer_rows(rows, {"title": "string", "amount": "bigint"}).withColumn("claim_no", F.col("claim_no").cast("long"))


@query("""SELECT pos, CASE pos % 4 WHEN 0 THEN [200000.0] WHEN 1 THEN [1500.0, 3000.0] WHEN 2 THEN [1.5] ELSE [5000.0] END::DOUBLE[] AS figures,
 pos % 4 = 0 OR pos % 4 = 3 AS proven FROM v_opp""")
def money_claims(spark, sf_dir):
    """STR-26, STR-28: figures of three notations and amounts with evidence for their currency."""
    e = F.expr
    rows = view(spark, sf_dir, "v_opp").select(
        "pos", e("CASE pos % 4 WHEN 0 THEN 'pana la 200.000 lei' WHEN 1 THEN 'from 1500 lei or 3000 euro' WHEN 2 THEN 'about 1,5 lei' ELSE '5 mii lei' END").alias("excerpt"),
        e("CASE pos % 4 WHEN 0 THEN 200000D WHEN 1 THEN 1500D WHEN 2 THEN 15D ELSE 5000D END").alias("amount"), F.lit("MDL").alias("currency"),
    )
    proven = extract.money_evidence(rows, {"MDL": ("lei",), "EUR": ("euro", "€")}, {"MDL": 1e7, "EUR": 1e6})
    return proven.select("pos", F.transform(extract.figures("excerpt"), lambda f: f["value"]).alias("figures"), "proven")


@query()
def eligible_entities(spark, sf_dir):
    """CLS-10: entity types of every listing; held against expected lists by tests."""
    return extract.entities(view(spark, sf_dir, "v_opp").select("id", "eligibility"))


@query("""SELECT pos, pos % 3 = 0 AS needed, pos % 4 = 1 AS outside FROM v_opp""")
def needs_and_areas(spark, sf_dir):
    """CLS-06, CLS-11."""
    said = F.expr("CASE pos % 3 WHEN 0 THEN 'Covers équipment costs' WHEN 1 THEN 'Does not fund equipment' ELSE 'Anything' END")
    area = F.expr("CASE pos % 4 WHEN 0 THEN 'All regions including Otago' WHEN 1 THEN 'Only in Otago' ELSE 'Everywhere' END")
    return view(spark, sf_dir, "v_opp").select("pos", extract.need_mentioned(said, ("equipment",)).alias("needed"), extract.not_covered(area, ("otago",), ("all regions", "including")).alias("outside"))


@query("""SELECT pos, pos % 3 <> 2 AS belongs FROM v_opp""")
def funder_sites(spark, sf_dir):
    """STR-35."""
    host = F.expr("CASE pos % 3 WHEN 0 THEN 'www.nzlc.org.nz' WHEN 1 THEN 'lotteries.govt.nz' ELSE 'facebook.com' END")
    return view(spark, sf_dir, "v_opp").select("pos", extract.site_belongs(host, F.lit("New Zealand Lotteries Commission"), ("the", "of")).alias("belongs"))


@query("""SELECT doc_id AS id, section, n, line FROM (SELECT doc_id, unnest(['High', 'High', 'Low']) AS section, unnest([1, 2, 5])::INT AS n, unnest(['item ' || doc_id, 'more', 'last']) AS line FROM documents)""")
def report_sections(spark, sf_dir):
    """PRJ-07."""
    content = F.concat(F.lit("# High\nitem "), "doc_id", F.lit("\n more \n\n## Low\nlast"))
    return extract.sections(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), content.alias("content")))


@query(f"""WITH s AS (SELECT *, {STATUS_SQL} AS status FROM v_opp), r AS (SELECT *, trim(regexp_replace(trim(funder), '\\s*\\([^)]*\\)\\s*', ' ', 'g')) AS nm, trim(regexp_replace(lower(funder), '[^a-z0-9]+', '-', 'g'), '-') AS sl FROM s)
SELECT id, title, nm AS funder_name, 'https://x.org/funders/' || sl AS funder_url, deadline_state AS state, CASE WHEN deadline_state = 'dated' THEN deadline END AS due,
 nullif(amount_max, 0) AS amount_max, source_url AS url, CASE WHEN status = 'stale' THEN 'not confirmed recently' END AS notice FROM r""")
def public_records(spark, sf_dir):
    """PRJ-03, SRC-20."""
    r = extract.public_record(with_status(view(spark, sf_dir, "v_opp")), "https://x.org")
    c = lambda p, n: F.col(f"record.{p}").alias(n)
    return r.select("id", c("title", "title"), c("funder.name", "funder_name"), c("funder.url", "funder_url"), c("deadline.state", "state"), c("deadline.date", "due"), c("amount.max", "amount_max"), c("source_url", "url"), c("notice", "notice"))


@query("""SELECT id, json_extract_string(b, '$.budget')::BIGINT AS budget, json_extract_string(b, '$.deadline') AS deadline, eligibility <> '' AS has_eligibility FROM (
 SELECT id, eligibility, json_object('budget', amount_max, 'deadline', nullif(deadline, 'TBC')) AS b FROM v_opp)""")
def legacy_briefs(spark, sf_dir):
    """PRJ-04."""
    b = extract.brief(view(spark, sf_dir, "v_opp"))
    got = lambda p: F.get_json_object("brief", f"$.{p}")
    return b.select("id", got("budget").cast("long").alias("budget"), got("deadline").alias("deadline"), got("eligibility").isNotNull().alias("has_eligibility"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN [] ELSE ['https://a' || conv_id || '.org', 'https://b.org'] END::VARCHAR[] AS urls FROM conversations""")
def cited_urls(spark, sf_dir):
    """AGG-16: urls out of three response shapes."""
    response = F.expr("""CASE turn % 4 WHEN 0 THEN concat('{"citations": ["https://a', conv_id, '.org", "https://b.org"]}')
      WHEN 1 THEN concat('{"output": {"annotations": [{"url": "https://a', conv_id, '.org"}, {"url": "https://b.org"}]}}')
      WHEN 2 THEN concat('{"content": {"citations": [{"url": "https://a', conv_id, '.org"}, {"url": "https://b.org"}]}}') ELSE 'nothing' END""")
    return extract.cited_urls(table(spark, sf_dir, "conversations").select("conv_id", "turn", response.alias("response"))).select("conv_id", "turn", "urls")


_LINKS = "l AS (SELECT page_id AS src, unnest([2 * page_id + 1, 2 * page_id + 2, page_id % 7]) AS dst, unnest([0, 1, 2]) AS rank FROM pages)"


def _graph(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    links = p.select(F.col("page_id").alias("src"), F.posexplode(F.expr("array(2 * page_id + 1, 2 * page_id + 2, page_id % 7)")).alias("rank", "dst"))
    stored = p.select("page_id", F.length("html").alias("chars"), (F.col("page_id") % 3 != 0).alias("funding"))
    seeds = p.where("page_id % 5 = 0").select(F.col("page_id").alias("root"), "page_id")
    return seeds, links, stored


@query(f"""WITH {_LINKS}, d0 AS (SELECT page_id AS root, page_id, 0 AS depth FROM pages WHERE page_id % 5 = 0), d1 AS (SELECT root, dst AS page_id, 1 AS depth FROM d0 JOIN l ON src = page_id),
d2 AS (SELECT root, dst AS page_id, 2 AS depth FROM d1 JOIN l ON src = page_id) SELECT root, page_id, min(depth) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY 1, 2""")
def bounded_bfs(spark, sf_dir):
    """GRA-01 without caps: every page within two links of a root."""
    return graph.bounded_bfs(*_graph(spark, sf_dir), kept=None, seen=None).select("root", "page_id", "depth")


@query()
def crawl_visits(spark, sf_dir):
    """GRA-01, GRA-02 with its caps (8 kept of 16 seen a root, the feature); held against a replay by tests."""
    return graph.bounded_bfs(*_graph(spark, sf_dir))


@query("""SELECT l_suppkey AS funder, min_by('u' || l_partkey, (l_linenumber % 4, l_orderkey, 'u' || l_partkey)) AS url, min(l_linenumber % 4) AS stage FROM lineitem GROUP BY 1""")
def funding_page_choice(spark, sf_dir):
    """GRA-03."""
    kind = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'listed' WHEN 1 THEN 'link' WHEN 2 THEN 'search' ELSE 'home' END")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("funder"), kind.alias("kind"), F.col("l_orderkey").alias("rank"), F.concat(F.lit("u"), "l_partkey").alias("url"))
    return graph.choose_page(rows)


@query("""SELECT page_id AS id FROM pages WHERE NOT (page_id IN (SELECT page_id // 2 FROM pages WHERE page_id > 1) AND page_id % 2 = 0)""")
def dedicated_pages(spark, sf_dir):
    """DED-08: index rows folded into the page below; only even pages leave their deadline unstated."""
    p = table(spark, sf_dir, "pages")
    e = F.expr
    rows = p.select(F.col("page_id").alias("id"), "page_id", F.lit("F").alias("funder"), F.lit("Grant").alias("title"), e("CASE WHEN page_id % 2 = 0 THEN NULL ELSE concat('d', page_id) END").alias("deadline"), F.lit(None).cast("long").alias("amount_max"))
    parents = p.select("page_id", e("CASE WHEN page_id > 1 THEN page_id DIV 2 END").alias("parent"))
    return graph.prefer_dedicated(rows, parents, 1).select("id")


@query("""WITH k AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') || '/' || array_to_string([p FOR p IN string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') IF p <> '' AND p NOT IN ('en', 'de', 'fr', 'es')], '/') AS k, url LIKE '%/en/%' AS own FROM pages)
SELECT page_id FROM k WHERE NOT own AND k NOT IN (SELECT k FROM k WHERE own)""".replace("\\\\", "\\"))
def untranslated_pages(spark, sf_dir):
    """DED-13."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    own = F.contains("url", F.lit("/en/"))
    return graph.untranslated(pages.where(~own), pages.where(own), lambda c: text.language_key(c, ("en", "de", "fr", "es"))).select("page_id")


def _sub_events(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id", F.lit("@example.com")).alias("email"),
        F.expr("CASE event_type WHEN 'signup' THEN 'subscribe' WHEN 'view' THEN 'subscribe' WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'unsubscribe' ELSE 'other' END").alias("event"),
        seconds.alias("ts"), "event_id",
    )


@query()
def subscriber_states(spark, sf_dir):
    """STM-04, STM-05, AGG-17: outcomes of every event by a replay in order; held against the stream by tests."""
    return states.lifecycles(_sub_events(spark, sf_dir)).select("email", "event_id", "event", "outcome")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id AS key, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT key, k, event_id, [t] AS log, true AS allowed FROM e WHERE k = 1
 UNION ALL SELECT e.key, e.k, e.event_id, CASE WHEN len(f) < 2 THEN list_append(f, e.t) ELSE f END, len(f) < 2 FROM
 (SELECT r.key, r.k, e.t, e.event_id, [x FOR x IN r.log IF x > e.t - 86400] AS f FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1) q JOIN e ON e.event_id = q.event_id)
SELECT event_id, key, allowed FROM r""")
def admission_log(spark, sf_dir):
    """STM-03: at most 2 admitted a key and 86,400 s."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return states.admission(rows, 2, 86_400).select("event_id", "key", "allowed")


@query("""WITH RECURSIVE e AS (SELECT l_suppkey AS run, l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem),
r AS (SELECT run, k, a <= 5000 AS admitted, CASE WHEN a <= 5000 THEN a ELSE 0 END AS s FROM e WHERE k = 1
 UNION ALL SELECT e.run, e.k, r.s + e.a <= 5000, CASE WHEN r.s + e.a <= 5000 THEN r.s + e.a ELSE r.s END FROM r JOIN e ON e.run = r.run AND e.k = r.k + 1)
SELECT run, l_orderkey, l_linenumber, admitted FROM r JOIN e USING (run, k)""")
def spend_cap(spark, sf_dir):
    """STM-08: every line reserves its quantity from its supplier's cap; later and smaller ones may still fit after a refusal."""
    order = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))
    calls = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run"), order.cast("double").alias("ts"), order.alias("event_id"), order.cast("string").alias("request"),
        F.lit("reserve").alias("kind"), F.col("l_quantity").cast("double").alias("amount"), "l_orderkey", "l_linenumber",
    )
    return states.spend_cap(calls, 5000.0).select("run", "l_orderkey", "l_linenumber", "admitted")


@query("""SELECT 'u' || user_id || '@example.com' AS email FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0)""")
def recipients(spark, sf_dir):
    """STM-06."""
    events = table(spark, sf_dir, "events")
    address = F.concat(F.lit("u"), "user_id", F.lit("@example.com")).alias("email")
    subscribers = events.where("user_id % 2 = 0").select(address, F.lit("2024-01-01").alias("confirmed_at"), F.lit(None).cast("string").alias("unsubscribed_at")).distinct()
    sent = events.where("event_type = 'purchase' AND user_id % 3 = 0").select(address, F.lit("p1").alias("publish_id"))
    return states.recipients(subscribers, sent, "p1").select("email")


@query("""SELECT date_trunc('week', ts) AS week_start, strftime(ts, '%Y-%m') AS month, CASE user_id % 12 WHEN 0 THEN 'human' WHEN 1 THEN 'gptbot' WHEN 2 THEN 'gptbot' WHEN 3 THEN 'claudebot' WHEN 4 THEN 'claudebot'
 WHEN 5 THEN 'perplexitybot' WHEN 6 THEN 'googlebot' WHEN 9 THEN 'bingbot' WHEN 10 THEN 'ccbot' ELSE 'other-bot' END AS agent, count(*) AS hits FROM v_hit WHERE kind = 'hit' GROUP BY 1, 2, 3""")
def counters_stream(spark, sf_dir):
    """STM-01, STM-02: hits by week, month and agent, counted by Structured Streaming over the events' files."""
    # a glob, because a streaming source takes no path of a single file
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    counts = counters.period_counts(counters.hit_log_stream(stream)).select(F.col("window.start").alias("week_start"), "month", "agent", "hits")
    return counters.run_to_table(counts, ["week_start", "month", "agent"], "counters")
