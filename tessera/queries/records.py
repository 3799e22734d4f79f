"""Queries over registers, evidence, cases and the cumulative publish."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ranking, records
from tessera.queries import query
from tessera.queries.documents import _sub_events
from tessera.queries.functions import ZONE, today
from tessera.queries.listings import _candidates
from tessera.session import table
from tessera.sources.adapters import view
from tessera.streaming import states


@query(r"""SELECT pos, CASE WHEN funder LIKE 'The %' THEN substr(funder, 5) WHEN funder LIKE '%(managed by Trust)' THEN CASE WHEN regexp_replace(funder, ' \(.*', '') = 'Customer#000000007' THEN 'Seven' ELSE regexp_replace(funder, ' \(.*', '') END
 WHEN funder = 'Customer#000000007' THEN 'Seven' ELSE funder END AS canonical FROM v_opp""")
def canonical_funders(spark, sf_dir):
    """STR-05."""
    rows = view(spark, sf_dir, "v_opp").select("pos", "funder")
    named = table(spark, sf_dir, "customer").select(F.concat(F.lit("the "), "c_name").alias("alias"), F.col("c_name").alias("name"))
    aliases = named.unionByName(spark.createDataFrame([("customer#000000007", "Seven")], "alias string, name string"))
    return records.canonical_funder(rows, aliases).select("pos", "canonical")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://(.*)$', 1), '^www\.', ''), '#.*', '') = regexp_replace(regexp_replace(regexp_extract(u2, '^[a-z]+://(.*)$', 1), '^www\.', ''), '#.*', '') AS same FROM (
 SELECT page_id, rtrim(regexp_replace(split_part(url, '#', 1), '[?].*', ''), '/') AS url, rtrim(regexp_replace(split_part(CASE WHEN page_id % 2 = 0 THEN 'https://www.' || regexp_replace(split_part(url, '://', 2), '^www\.', '') ELSE url || 'x' END, '#', 1), '[?].*', ''), '/') AS u2 FROM pages WHERE url NOT LIKE '%?%' AND url NOT LIKE '%#%')""")
def same_pages(spark, sf_dir):
    """STR-13: a page under another scheme and ``www.`` is the same; another path is not."""
    rows = table(spark, sf_dir, "pages").where("url NOT LIKE '%?%' AND url NOT LIKE '%#%'")
    other = F.expr(r"CASE WHEN page_id % 2 = 0 THEN concat('https://www.', regexp_replace(split_part(url, '://', 2), '^www\\.', '')) ELSE concat(url, 'x') END")
    return rows.select("page_id", text.same_page("url", other).alias("same"))


@query(r"""SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS sweep_key, pos % 3 <> 0 AS named FROM v_opp""")
def sweep_title_keys(spark, sf_dir):
    """STR-08, STR-36."""
    rows = view(spark, sf_dir, "v_opp")
    # every third page names the funder's other programme
    page = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("About programme "), F.col("pos") % 500 + 1, F.lit(" and more"))).otherwise(F.concat(F.lit("About "), F.upper("title"), F.lit(" and more")))
    return rows.select("id", text.title_key("title", F.col("pos") % 2 == 0).alias("sweep_key"), text.names_on_page(page, "title", ("and", "not")).alias("named"))


@query("""SELECT doc_id, source AS run, printf('EV-%04d', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS evidence_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS hash FROM documents""")
def sealed_evidence(spark, sf_dir):
    """SRC-17."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "run")
    return records.seal(docs, "run", ["doc_id"], ["n_chars", "doc_id", "lang"]).select("doc_id", "run", "evidence_id", "hash")


@query("""SELECT o_orderkey AS case_id, o_orderstatus AS status, count(DISTINCT l_returnflag) AS sections, count(*) AS uploads FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def case_summaries(spark, sf_dir):
    """SRC-19."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_set(F.struct("l_returnflag", F.lit("text")))).alias("sections"), F.collect_list("l_linenumber").alias("uploads")
    )
    cases = table(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    return records.case_summaries(cases.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"), "sections", "uploads"))


@query("""SELECT 'Customer ' || c_custkey || ' Trust' AS name, 'Customer ' || c_custkey AS known_name FROM customer WHERE c_custkey % 3 <> 0""")
def funder_identity(spark, sf_dir):
    """DED-10: names agree on a site of their own unless their kinds conflict."""
    c = table(spark, sf_dir, "customer")
    e = F.expr
    known = c.select(F.concat(F.lit("Customer "), "c_custkey").alias("name"), e("concat('https://site', c_custkey, '.org')").alias("url"), F.lit("council").alias("kind"), F.col("c_custkey").alias("pos"))
    new = c.select(F.concat(F.lit("Customer "), "c_custkey", F.lit(" Trust")).alias("name"), e("concat('http://www.site', c_custkey, '.org/about')").alias("url"), e("CASE c_custkey % 3 WHEN 0 THEN 'iwi' WHEN 1 THEN 'council' END").alias("kind"))
    return records.funder_matches(new, known, ("facebook.com",))


@query("""SELECT 'Customer ' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS tier, CASE WHEN c_custkey % 2 = 0 THEN ['alias', 'known'] ELSE ['known', 'site'] END AS matched_by FROM customer""")
def merged_register(spark, sf_dir):
    """DED-11."""
    c = table(spark, sf_dir, "customer")
    e = F.expr
    known = c.select(F.concat(F.lit("Customer "), "c_custkey").alias("name"), e("concat('https://site', c_custkey, '.org')").alias("url"), F.lit(None).cast("string").alias("kind"), F.col("c_custkey").alias("pos"), F.lit(2).alias("tier"))
    new = c.select(e("CASE WHEN c_custkey % 2 = 0 THEN concat('C', c_custkey) ELSE concat('Customer ', c_custkey, ' Trust') END").alias("name"), e("concat('https://site', c_custkey, '.org')").alias("url"), F.lit(None).cast("string").alias("kind"), e("CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END").alias("tier"))
    aliases = c.where("c_custkey % 2 = 0").select(e("concat('c', c_custkey)").alias("alias"), e("concat('Customer ', c_custkey)").alias("name"))
    return records.merge_register(new, known, aliases, ())


#: Seconds as of which subscribers are counted and ends are told: four days and six weeks after the last event.
COUNTED_AT, ENDED_BY = 1_707_000_000, 1_710_000_000


@query()
def subscriber_counts(spark, sf_dir):
    """AGG-17: counts as of a date over the outcomes of STM-04, records that have ended left out."""
    return states.subscriber_counts(states.lifecycles(_sub_events(spark, sf_dir)), F.lit(float(COUNTED_AT)))


@query()
def subscriber_ends(spark, sf_dir):
    """STM-05: records that have expired or were purged before a date, one row an end."""
    return states.ends(states.lifecycles(_sub_events(spark, sf_dir)), F.lit(float(ENDED_BY)))


@query()
def publish_cumulative(spark, sf_dir):
    """CDC-01, SRC-15's table: the dataset after a publish."""
    rows = _candidates(spark, sf_dir).drop("published")
    return records.publish_cumulative(rows.where("pos % 4 = 0"), rows.where("pos % 4 <> 0"), today(), ZONE)


@query("""WITH l AS (SELECT page_id, 'https://x' || page_id || '.org/' AS url, unnest(['https://x' || page_id || '.org/grants/fund', 'https://www.x' || page_id || '.org/apply-grant', 'https://y.org/grants', 'https://x' || page_id || '.org/news/grants']) AS href, unnest([6, 3, 0, 0]) AS score, unnest([1, 2, 0, 0]) AS rank FROM pages)
SELECT page_id, href, score, rank FROM l WHERE rank > 0""")
def ranked_links(spark, sf_dir):
    """TOP-06."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr("concat('https://x', page_id, '.org/')").alias("url"))
    made = F.expr("""array(named_struct('href', concat(url, 'grants/fund'), 'text', 'Grant fund'), named_struct('href', concat('https://www.x', page_id, '.org/apply-grant'), 'text', 'A grant'),
      named_struct('href', 'https://y.org/grants', 'text', 'Grants'), named_struct('href', concat(url, 'news/grants'), 'text', 'Grants'))""")
    links = p.select("page_id", "url", F.explode(made).alias("l")).select("page_id", "url", "l.href", "l.text")
    return ranking.rank_links(links, ("grant", "fund"), ("news",), 8).select("page_id", "href", "score", "rank")


@query("""SELECT o_orderkey AS pos, o_orderpriority AS priority FROM orders ORDER BY CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, o_orderkey LIMIT 50""")
def priority_buckets(spark, sf_dir):
    """TOP-09."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("shown"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'odd' END").alias("priority"))
    return ranking.by_priority(rows).limit(50).select("pos", F.col("shown").alias("priority"))
