"""Views over the given tables in the shape of the model: listings, profiles, hits, usage, evidence.

Pure projections; ``DUCKDB`` holds the same views for the SQL that queries are
held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

TAGS = ("arts", "sport", "health", "education", "environment", "heritage", "youth", "housing")
REGIONS = tuple(f"nation-{k}" for k in range(25))
ELIGIBILITY = (
    "Open to registered charities",
    "Schools and early learning centres only",
    "Any incorporated society may apply",
    "Local councils are not eligible",
    "Charities and community groups",
    "Individuals cannot apply",
    "Open to individuals and sole traders",
    "Sports clubs in the region",
    "Businesses with fewer than 20 staff",
    "Iwi and hapu organisations",
    "Any legal entity",
    "",
)
AGENTS = (
    "Mozilla/5.0 (X11; Linux) Firefox/128.0", "Mozilla/5.0 AppleWebKit GPTBot/1.1", "Mozilla/5.0 ChatGPT-User/1.0", "ClaudeBot/1.0",
    "Claude-User/1.0", "PerplexityBot/1.0", "Googlebot/2.1", "curl/8.5.0", "", "Mozilla/5.0 bingbot/2.0", "CCBot/2.0", "SomeSpider/3",
)
REFERRERS = (
    "", "https://chatgpt.com/c/1", "https://www.google.co.nz/search?q=grants", "https://mail.google.com/", "https://perplexity.ai/search",
    "https://example.org/links", "duckduckgo.com", "https://notgoogle.com/", "https://news.example/?utm_medium=email", "https://docs.google.com/d/1",
    "https://claude.ai/chat", "https://yandex.md/",
)
TODAY = "1998-06-30"


def _list(values, spark: bool) -> str:
    body = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"array({body})" if spark else f"[{body}]"


def _pick(values, index: str, spark: bool) -> str:
    return f"element_at({_list(values, True)}, cast({index} AS int) + 1)" if spark else f"({_list(values, False)})[({index}) + 1]"


def _v_opp(spark: bool) -> str:
    day = "to_date(o_orderdate)" if spark else "o_orderdate::DATE"
    text = lambda e: f"date_format({e}, 'yyyy-MM-dd')" if spark else f"strftime({e}, '%Y-%m-%d')"
    plus = lambda n: f"date_add({day}, cast({n} AS int))" if spark else f"({day} + ({n})::INTEGER)"
    div = lambda a, b: f"({a} DIV {b})" if spark else f"({a} // {b})"
    string = "string" if spark else "VARCHAR"
    three = f"{_pick(TAGS, 'k % 8', spark)}, {_pick(TAGS, f'(k + 1 + {div("k", 8)} % 3) % 8', spark)}, {_pick(TAGS, '(k + 5) % 8', spark)}"
    tags = f"slice(array({three}), 1, cast(1 + k % 3 AS int))" if spark else f"([{three}])[1:1 + k % 3]"
    region = "lower(replace(n_name, '_', '-'))"
    regions = (
        f"CASE WHEN k % 6 = 0 THEN array('national') ELSE array({region}) END"
        if spark
        else f"CASE WHEN k % 6 = 0 THEN ['national'] ELSE [{region}] END"
    )
    return f"""
SELECT k AS pos, 'OPP-' || lpad(cast(k AS {string}), cast(greatest(8, length(cast(k AS {string}))) AS int), '0') AS id, 'nz' AS country,
  CASE WHEN k % 11 = 0 THEN 'The ' || c_name WHEN k % 7 = 0 THEN c_name || ' (managed by Trust)' ELSE c_name END AS funder,
  'Programme ' || cast(k % 500 AS {string}) || ' & ' || lower(substr(o_orderpriority, 3)) AS title,
  CASE WHEN k % 37 = 0 THEN 'unresolved' WHEN k % 5 IN (0, 1) THEN 'dated' WHEN k % 5 = 2 THEN 'rolling-confirmed'
       WHEN k % 5 = 3 THEN 'not-stated' ELSE 'closed' END AS deadline_state,
  CASE WHEN k % 5 IN (0, 1) THEN {text(plus('k % 120'))} WHEN k % 5 = 2 THEN 'rolling' ELSE 'TBC' END AS deadline,
  CASE WHEN k % 41 <> 0 THEN {text(plus('k % 10'))} || 'T' || lpad(cast(k % 24 AS {string}), 2, '0') || ':00:00+00:00' END AS verified_at,
  CASE WHEN k % 3 = 0 THEN cast(floor(o_totalprice / 10) AS bigint) END AS amount_min,
  CASE WHEN k % 4 <> 0 THEN cast(floor(o_totalprice) AS bigint) END AS amount_max,
  CASE WHEN c_nationkey % 2 = 0 THEN 'NZD' ELSE 'MDL' END AS currency,
  {regions} AS region, {tags} AS tags,
  {_pick(ELIGIBILITY, 'k % 12', spark)} AS eligibility,
  'Support for ' || {_pick(TAGS, 'k % 8', spark)} || ' projects up to $' || cast(cast(floor(o_totalprice) AS bigint) AS {string}) AS summary,
  CASE WHEN k % 2 = 0 THEN 'https://' ELSE 'http://' END || CASE WHEN k % 4 = 0 THEN 'www.' ELSE '' END
    || 'Funder' || cast(o_custkey % 200 AS {string}) || '.example.org/'
    || CASE k % 3 WHEN 0 THEN 'grants' WHEN 1 THEN 'apply' ELSE 'about/us' END
    || CASE WHEN k % 5 = 0 THEN '/' ELSE '' END || CASE WHEN k % 9 = 0 THEN '?id=1#top' ELSE '' END AS source_url,
  {text(day)} AS first_seen, {text(plus('k % 30'))} AS last_seen,
  'EV-' || lpad(cast(k % 10000 AS {string}), 4, '0') AS evidence_id
FROM (SELECT *, o_orderkey AS k FROM orders) o
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def _v_hit(spark: bool) -> str:
    string = "string" if spark else "VARCHAR"
    k = "cast(get_json_object(props, '$.k') AS bigint)" if spark else "(props->>'$.k')::BIGINT"
    ts = "cast(ts AS timestamp)" if spark else "ts"
    return f"""
SELECT event_id, {ts} AS ts, user_id, CASE WHEN event_type = 'purchase' THEN 'clickout' ELSE 'hit' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'api' WHEN 2 THEN 'mcp' ELSE 'out' END AS surface,
  {_pick(AGENTS, 'user_id % 12', spark)} AS user_agent, {_pick(REFERRERS, f'{k} % 12', spark)} AS referrer,
  CASE event_id % 4 WHEN 1 THEN '/api/v1/' || event_type || '/' || cast(event_id AS {string}) || '.json'
       WHEN 2 THEN 'mcp:' || event_type ELSE '/' || event_type || '?utm_source=' || CASE WHEN event_id % 9 = 0 THEN 'chatgpt.com' ELSE 'x' END END AS path,
  CASE WHEN event_type = 'purchase' THEN 'OPP-' || cast(user_id % 50 AS {string}) END AS opp_id,
  CASE WHEN event_type = 'purchase' THEN 'Funder ' || cast(user_id % 7 AS {string}) END AS funder
FROM events"""


def _v_usage(spark: bool) -> str:
    string = "string" if spark else "VARCHAR"
    ts = "cast(l_shipdate AS timestamp)" if spark else "l_shipdate"
    return f"""
SELECT 'org-' || cast(l_suppkey AS {string}) AS org_id, l_returnflag AS caller, 'model-' || l_linestatus AS model, {ts} AS ts,
  cast(l_quantity * 100 AS bigint) AS input_tokens, l_partkey % 1000 AS output_tokens, cast(l_linenumber AS bigint) AS api_calls,
  l_orderkey, l_linenumber, l_partkey
FROM lineitem"""


def _v_profile(spark: bool) -> str:
    """Profiles are the query set of a search: every customer whose key is divisible by 100."""
    string = "string" if spark else "VARCHAR"
    tag = lambda i: _pick(TAGS, i, spark)
    sector = f"array({tag('q % 8')}, {tag('(q + 3) % 8')})" if spark else f"[{tag('q % 8')}, {tag('(q + 3) % 8')}]"
    return f"""
SELECT c_custkey AS profile_id, {sector} AS sector, CASE WHEN q % 5 <> 0 THEN 'nation-' || cast(c_nationkey AS {string}) END AS region,
  CASE q % 4 WHEN 0 THEN 'under-50k' WHEN 1 THEN '50k-250k' WHEN 2 THEN '250k-1m' END AS size,
  CASE q % 3 WHEN 0 THEN 'charitable-trust' WHEN 1 THEN 'school' END AS status,
  CASE q % 2 WHEN 0 THEN 'project' END AS need
FROM (SELECT *, {'c_custkey DIV 100' if spark else 'c_custkey // 100'} AS q FROM customer) c WHERE c_custkey % 100 = 0"""


_VIEWS = {"v_opp": _v_opp, "v_hit": _v_hit, "v_usage": _v_usage, "v_profile": _v_profile}
_SOURCES = {"v_opp": ("orders", "customer", "nation"), "v_hit": ("events",), "v_usage": ("lineitem",), "v_profile": ("customer",)}
#: View -> DuckDB SELECT over the same tables.
DUCKDB = {name: make(False) for name, make in _VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame; evaluated lazily, columns are pruned down to the scan."""
    return spark.sql(
        _VIEWS[name](True).replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}").replace("JOIN nation", "JOIN {nation}")
        .replace("FROM events", "FROM {events}").replace("FROM lineitem", "FROM {lineitem}").replace("FROM customer", "FROM {customer}"),
        **{t: table(spark, sf_dir, t) for t in _SOURCES[name]},
    )


def hits(events: DataFrame) -> DataFrame:
    """``v_hit`` over any table or stream of events."""
    return events.sparkSession.sql(_v_hit(True).replace("FROM events", "FROM {events}"), events=events)


def previous_listings(listings: DataFrame) -> DataFrame:
    """An earlier snapshot: four fifths of the listings, some with other amounts or states."""
    return listings.where("pos % 10 < 8").withColumns(
        {
            "amount_max": F.expr("CASE WHEN pos % 13 = 0 THEN amount_max + 500 ELSE amount_max END"),
            "title": F.expr("CASE WHEN pos % 17 = 0 THEN title || ' (old)' ELSE title END"),
        }
    )


DUCKDB_PREVIOUS = """SELECT * REPLACE (CASE WHEN pos % 13 = 0 THEN amount_max + 500 ELSE amount_max END AS amount_max,
  CASE WHEN pos % 17 = 0 THEN title || ' (old)' ELSE title END AS title) FROM v_opp WHERE pos % 10 < 8"""


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names as leading common table expressions."""
    needed = [n for n in ("v_opp", "v_prev", "v_hit", "v_usage", "v_profile") if n in sql]
    if "v_prev" in needed and "v_opp" not in needed:
        needed.insert(0, "v_opp")
    parts = [f"{n} AS ({DUCKDB_PREVIOUS if n == 'v_prev' else DUCKDB[n]})" for n in needed]
    body = sql.strip()
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + ("," + body[4:] if body.upper().startswith("WITH") else "\n" + body)
