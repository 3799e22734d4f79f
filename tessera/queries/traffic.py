"""Queries over hits and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import classify, dates
from tessera.operators import traffic
from tessera.queries import query
from tessera.sources.adapters import view

_LOG = r"""
c AS (
  SELECT *, lower(trim(user_agent)) AS ua, trim(referrer) AS rf, regexp_extract(path, '\?([^#]*)', 1) AS pq FROM v_hit
), d AS (
  SELECT *, CASE WHEN ua = '' THEN 'other-bot' WHEN ua LIKE '%gptbot%' OR ua LIKE '%oai-searchbot%' OR ua LIKE '%chatgpt-user%' THEN 'gptbot'
      WHEN ua LIKE '%claudebot%' OR ua LIKE '%claude-user%' OR ua LIKE '%claude-searchbot%' OR ua LIKE '%anthropic-ai%' THEN 'claudebot'
      WHEN ua LIKE '%perplexitybot%' OR ua LIKE '%perplexity-user%' THEN 'perplexitybot' WHEN ua LIKE '%google-extended%' THEN 'google-extended'
      WHEN ua LIKE '%ccbot%' THEN 'ccbot' WHEN ua LIKE '%googlebot%' THEN 'googlebot' WHEN ua LIKE '%bingbot%' THEN 'bingbot'
      WHEN regexp_matches(ua, 'bot|crawler|spider|^curl/|^wget/|python-requests') THEN 'other-bot' ELSE 'human' END AS agent,
    CASE WHEN regexp_matches(ua, 'chatgpt-user|claude-user|perplexity-user') THEN 'fetch'
      WHEN regexp_matches(ua, 'oai-searchbot|claude-searchbot|perplexitybot|googlebot|bingbot') THEN 'search'
      WHEN regexp_matches(ua, 'gptbot|claudebot|anthropic-ai|google-extended|ccbot') THEN 'training' END AS role_named,
    CASE WHEN rf = '' THEN '' ELSE lower(regexp_extract(CASE WHEN rf LIKE '%//%' THEN rf ELSE 'x://' || rf END, '^[A-Za-z]+://([^/?#:]*)', 1)) END AS h FROM c
), e AS (
  SELECT *, CASE WHEN rf = '' THEN 'direct' WHEN regexp_matches(rf, '[?&]utm_medium=email') THEN 'email'
      WHEN regexp_matches(h, '(^|\.)(chatgpt\.com|perplexity\.ai|claude\.ai)$') THEN 'assistant' WHEN regexp_matches(h, '(^|\.)mail\.google\.com$') THEN 'email'
      WHEN regexp_matches(h, '(^|\.)duckduckgo\.com$') OR regexp_matches(h, '^(www\.)?(google|yandex)\.([a-z]+|(co|com)\.[a-z]{2})$') THEN 'search'
      ELSE 'other' END AS ref0 FROM d
), log AS (
  SELECT event_id, ts, kind, surface, regexp_extract(path, '^[^?#]*') AS path, agent,
    CASE WHEN ref0 IN ('direct', 'other') AND pq = 'utm_source=chatgpt.com' THEN 'assistant' ELSE ref0 END AS ref,
    CASE WHEN ref0 IN ('direct', 'other') AND pq = 'utm_source=chatgpt.com' THEN 'chatgpt.com' WHEN ref0 IN ('assistant', 'search') THEN h END AS ref_host,
    CASE WHEN agent <> 'human' THEN user_agent END AS ua, CASE WHEN agent <> 'human' THEN role_named END AS role, opp_id, funder
  FROM e
)"""

_COUNTERS = """
counters AS (
  SELECT 'hits_by_surface' AS counter, surface AS key, NULL AS key2, count(*) AS n FROM log WHERE kind = 'hit' GROUP BY surface
  UNION ALL SELECT 'hits_by_agent', agent, NULL, count(*) FROM log WHERE kind = 'hit' GROUP BY agent
  UNION ALL SELECT 'hits_by_referrer', ref, NULL, count(*) FROM log WHERE kind = 'hit' GROUP BY ref
  UNION ALL SELECT 'hits_by_agent_role', agent, role, count(*) FROM log WHERE kind = 'hit' AND role IS NOT NULL GROUP BY agent, role
  UNION ALL SELECT 'api_calls_by_prefix', '/api/v1/' || split_part(split_part(path, '/', 4), '.', 1), NULL, count(*) FROM log WHERE kind = 'hit' AND surface = 'api' GROUP BY 2
  UNION ALL SELECT 'mcp_calls_by_tool', substr(path, 5), NULL, count(*) FROM log WHERE kind = 'hit' AND surface = 'mcp' AND path LIKE 'mcp:%' GROUP BY 2
  UNION ALL SELECT 'clickouts_total', 'all', NULL, count(*) FROM log WHERE kind = 'clickout' HAVING count(*) > 0
  UNION ALL SELECT 'clickouts_by_referrer', ref, NULL, count(*) FROM log WHERE kind = 'clickout' GROUP BY ref
  UNION ALL SELECT 'clickouts_by_agent', agent, NULL, count(*) FROM log WHERE kind = 'clickout' GROUP BY agent
  UNION ALL SELECT 'clickout_grants', opp_id, NULL, count(*) FROM log WHERE kind = 'clickout' GROUP BY opp_id
  UNION ALL SELECT 'clickout_funders', funder, NULL, count(*) FROM log WHERE kind = 'clickout' GROUP BY funder
)"""

_WEEKS = """
weeks AS (
  SELECT date_trunc('week', ts)::DATE AS week, count(*) FILTER (kind = 'hit') AS hits,
    count(*) FILTER (kind = 'hit' AND role = 'fetch') AS assistant_fetches, count(*) FILTER (kind = 'hit' AND role = 'training') AS training,
    count(*) FILTER (kind = 'hit' AND role = 'search') AS search,
    count(*) FILTER (kind = 'hit' AND agent = 'human' AND ref = 'assistant') AS assistant_referrals,
    count(*) FILTER (kind = 'hit' AND agent = 'human' AND surface = 'page') AS human_pages,
    count(*) FILTER (kind = 'hit' AND agent = 'human' AND ref = 'search') AS human_from_search,
    count(*) FILTER (kind = 'hit' AND agent = 'human' AND ref = 'email') AS human_from_email,
    count(*) FILTER (kind = 'clickout') AS clickouts, count(*) FILTER (kind = 'clickout' AND ref = 'assistant') AS assistant_clickouts,
    count(*) FILTER (kind = 'hit' AND surface = 'api') AS api_calls, count(*) FILTER (kind = 'hit' AND surface = 'mcp') AS mcp_calls
  FROM log GROUP BY 1
)"""


def _log(spark, sf_dir):
    return traffic.record(view(spark, sf_dir, "v_hit"))


@query(f"WITH {_LOG} SELECT strftime(ts, '%Y-%m') AS month, agent, count(*) AS hits FROM log WHERE kind = 'hit' GROUP BY 1, 2")
def hits_by_agent_month(spark, sf_dir):
    """SRC-02, CLS-01, AGG-01: the minimum slice, hits a month by agent."""
    hits = view(spark, sf_dir, "v_hit").where("kind = 'hit'")
    return hits.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), classify.agent("user_agent").alias("agent")).agg(F.count("*").alias("hits"))


@query(f"WITH {_LOG} SELECT * FROM log")
def hit_log(spark, sf_dir):
    """SRC-13, CLS-01..04: privacy-safe log lines."""
    return _log(spark, sf_dir)


@query(f"WITH {_LOG} SELECT agent, coalesce(role, 'none') AS role, count(*) AS n FROM log WHERE kind = 'hit' GROUP BY 1, 2")
def agent_role_matrix(spark, sf_dir):
    log = _log(spark, sf_dir).where("kind = 'hit'")
    return log.groupBy("agent", F.coalesce("role", F.lit("none")).alias("role")).agg(F.count("*").alias("n"))


@query(f"WITH {_LOG}, {_COUNTERS} SELECT * FROM counters")
def monthly_counters(spark, sf_dir):
    """AGG-01 and STR-33."""
    return traffic.monthly_counters(_log(spark, sf_dir))


@query(f"WITH {_LOG}, {_COUNTERS} SELECT key, n FROM counters WHERE counter = 'clickout_grants' ORDER BY n DESC, key LIMIT 10")
def top_clickouts(spark, sf_dir):
    """AGG-02."""
    return traffic.top(traffic.monthly_counters(_log(spark, sf_dir)), "clickout_grants")


@query(f"WITH {_LOG}, {_WEEKS} SELECT * FROM weeks")
def weekly_counts(spark, sf_dir):
    """AGG-03."""
    return traffic.weekly_counts(_log(spark, sf_dir))


@query(f"""WITH {_LOG}, {_WEEKS}, l AS (UNPIVOT weeks ON COLUMNS(* EXCLUDE week) INTO NAME metric VALUE n)
SELECT l.week, l.metric, l.n, coalesce(b.n, 0) AS before FROM l LEFT JOIN l b ON b.week + 7 = l.week AND b.metric = l.metric""")
def week_over_week(spark, sf_dir):
    """AGG-05."""
    return traffic.week_over_week(traffic.weekly_counts(_log(spark, sf_dir)))


@query(f"""WITH {_LOG} SELECT coalesce(bool_or(kind = 'hit' AND coalesce(role = 'fetch', false)), false) AS assistant_fetch,
 coalesce(bool_or(kind = 'hit' AND ref = 'assistant' AND agent = 'human'), false) AS assistant_referral,
 coalesce(bool_or(kind = 'clickout' AND ref = 'assistant'), false) AS assistant_clickout FROM log WHERE ts < TIMESTAMP '2024-01-02'""")
def first_ever_flags(spark, sf_dir):
    """AGG-04."""
    return traffic.first_ever(_log(spark, sf_dir), "2024-01-02 00:00:00")


@query(f"""WITH {_LOG}, {_COUNTERS}, dims(block, key) AS (VALUES ('surface', 'page'), ('surface', 'api'), ('surface', 'mcp'), ('surface', 'out'),
 ('referrer', 'assistant'), ('referrer', 'search'), ('referrer', 'email'), ('referrer', 'direct'), ('referrer', 'other'))
SELECT block, key, coalesce((SELECT sum(n) FROM counters c WHERE c.counter = 'hits_by_' || block AND c.key = dims.key), 0)::BIGINT AS n FROM dims
UNION ALL SELECT 'total', 'bots', coalesce(sum(n), 0)::BIGINT FROM counters WHERE counter = 'hits_by_agent' AND key <> 'human'
UNION ALL SELECT 'total', 'tools', coalesce(sum(n), 0)::BIGINT FROM counters WHERE counter = 'mcp_calls_by_tool'
UNION ALL SELECT 'total', 'clickouts', (CASE WHEN sum(n) >= 100 THEN sum(n) END)::BIGINT FROM counters WHERE counter = 'clickouts_total'""")
def public_usage_block(spark, sf_dir):
    """AGG-06."""
    return traffic.public_usage(traffic.monthly_counters(_log(spark, sf_dir)))


@query(f"WITH {_LOG} SELECT * FROM log WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def log_window(spark, sf_dir):
    """SRC-04: half-open time range."""
    return traffic.between(_log(spark, sf_dir), "2024-01-08", "2024-01-15")


_COST = """
p AS (SELECT u.*, CASE model WHEN 'model-O' THEN 3.00 WHEN 'model-F' THEN 0.80 ELSE 1.00 END::DECIMAL(10,2) AS pin,
        CASE model WHEN 'model-O' THEN 15.00 WHEN 'model-F' THEN 4.00 ELSE 5.00 END::DECIMAL(10,2) AS pout FROM v_usage u),
priced AS (SELECT * EXCLUDE (pin, pout), ((input_tokens * pin + output_tokens * pout)::DECIMAL(18,2) * 0.000001::DECIMAL(8,6))::DECIMAL(18,8) AS exact,
        round((input_tokens * pin + output_tokens * pout)::DECIMAL(18,2) * 0.000001::DECIMAL(8,6), 6)::DECIMAL(18,6) AS cost_usd FROM p)"""


@query(f"WITH {_COST} SELECT l_orderkey, l_linenumber, l_partkey, model, cost_usd FROM priced")
def call_cost(spark, sf_dir):
    """AGG-09."""
    return traffic.cost(view(spark, sf_dir, "v_usage")).select("l_orderkey", "l_linenumber", "l_partkey", "model", "cost_usd")


@query(f"""WITH {_COST} SELECT org_id, caller, sum(api_calls)::BIGINT AS api_calls, sum(input_tokens)::BIGINT AS input_tokens,
 sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd), 4)::DECIMAL(18,4) AS cost_usd FROM priced GROUP BY GROUPING SETS ((org_id, caller), (org_id))""")
def usage_rollup(spark, sf_dir):
    """AGG-07, SRC-08."""
    return traffic.usage_summary(traffic.cost(view(spark, sf_dir, "v_usage")))


@query("""WITH u AS (SELECT org_id, ts::DATE AS day, sum(api_calls)::BIGINT AS used FROM v_usage GROUP BY 1, 2)
SELECT *, greatest(0, 30 - used)::BIGINT AS "left", used < 30 AS allowed FROM u""")
def budget_days(spark, sf_dir):
    """AGG-08."""
    return traffic.budget_days(view(spark, sf_dir, "v_usage"), 30)


@query("""WITH u AS (SELECT *, ts::DATE AS day, coalesce(sum(api_calls) OVER (PARTITION BY org_id, ts::DATE ORDER BY ts, l_orderkey, l_linenumber, l_partkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM v_usage)
SELECT org_id, day, l_orderkey, l_linenumber, used_before, used_before < 30 AS allowed FROM u""")
def daily_quota(spark, sf_dir):
    """STM-07 as a batch: running calls against the quota of the day."""
    q = traffic.daily_quota(view(spark, sf_dir, "v_usage"), ["l_orderkey", "l_linenumber", "l_partkey"], 30)
    return q.select("org_id", "day", "l_orderkey", "l_linenumber", "used_before", "allowed")


@query("""SELECT event_id, (date_trunc('week', timezone('Pacific/Auckland', timezone('UTC', ts))) - INTERVAL 7 DAY) AS local_start FROM v_hit""")
def week_bounds_local(spark, sf_dir):
    """DAT-04: the last whole local week, given back in local time."""
    zone = "Pacific/Auckland"
    week = dates.last_week("ts", zone)
    return view(spark, sf_dir, "v_hit").select("event_id", F.from_utc_timestamp(week["week_start"], zone).alias("local_start"))
