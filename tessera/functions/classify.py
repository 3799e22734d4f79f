"""Who is asking, from where, and for what (CLS operators)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import host

# Tokens that name an agent, in order; the first that fits wins.
AGENTS = (
    ("gptbot", ("gptbot", "oai-searchbot", "chatgpt-user")),
    ("claudebot", ("claudebot", "claude-user", "claude-searchbot", "anthropic-ai")),
    ("perplexitybot", ("perplexitybot", "perplexity-user")),
    ("google-extended", ("google-extended",)),
    ("ccbot", ("ccbot",)),
    ("googlebot", ("googlebot",)),
    ("bingbot", ("bingbot",)),
)
# Tokens that tell a role, in order.
ROLES = (
    ("fetch", ("chatgpt-user", "claude-user", "perplexity-user")),
    ("search", ("oai-searchbot", "claude-searchbot", "perplexitybot", "googlebot", "bingbot")),
    ("training", ("gptbot", "claudebot", "anthropic-ai", "google-extended", "ccbot")),
)
# Pieces of other clients' names.
OTHER_BOT = "bot|crawler|spider|^curl/|^wget/|python-requests|python-httpx|python-urllib|aiohttp|go-http-client|node-fetch|axios/|okhttp"
# Hosts by kind, each with its subdomains.
ASSISTANTS = ("chatgpt.com", "chat.openai.com", "perplexity.ai", "claude.ai", "gemini.google.com", "copilot.microsoft.com")
WEBMAIL = (
    "mail.google.com", "outlook.live.com", "outlook.office.com", "outlook.office365.com", "mail.yahoo.com", "mail.proton.me",
    "mail.aol.com", "mail.ru", "mail.yandex.ru", "mail.yandex.com",
)
SEARCH = (
    "bing.com", "duckduckgo.com", "search.yahoo.com", "ecosia.org", "baidu.com", "search.brave.com", "startpage.com", "qwant.com", "kagi.com",
)
BRAND = "^(?:www\\.)?(?:google|yandex)\\.(?:[a-z]+|(?:co|com)\\.[a-z0-9]{2})$"


def _any(c: Column, tokens: tuple[str, ...]) -> Column:
    return F.rlike(c, F.lit("|".join(tokens)))


def _first(c: Column, table) -> Column | None:
    out = None
    for name, tokens in table:
        out = F.when(_any(c, tokens), name) if out is None else out.when(_any(c, tokens), name)
    return out


def agent(ua: Column | str) -> Column:
    """CLS-01: class of the client; an empty user agent is ``other-bot``."""
    low = F.lower(F.trim(F.coalesce(F.col(ua) if isinstance(ua, str) else ua, F.lit(""))))
    named = _first(low, AGENTS).when(F.rlike(low, F.lit(OTHER_BOT)), "other-bot").otherwise("human")
    return F.when(low == "", "other-bot").otherwise(named)


def role(ua: Column | str) -> Column:
    """CLS-02: fetch, search or training of a named bot, else null."""
    return _first(F.lower(F.trim(F.coalesce(F.col(ua) if isinstance(ua, str) else ua, F.lit("")))), ROLES)


def host_in(h: Column, domains: tuple[str, ...]) -> Column:
    """The host is one of the domains or below one, never merely similar."""
    return F.rlike(h, F.lit("(^|\\.)(" + "|".join(d.replace(".", "\\.") for d in domains) + ")$"))


def _referrer_host(c: Column) -> Column:
    with_scheme = F.when(F.contains(c, F.lit("//")), c).otherwise(F.concat(F.lit("x://"), c))
    return F.nullif(F.regexp_replace(host(with_scheme), "\\.+$", ""), F.lit(""))


def referrer(c: Column | str) -> Column:
    """CLS-03: assistant, search, email, direct or other, by the parsed host alone."""
    ref = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    h = _referrer_host(ref)
    return (
        F.when(ref == "", "direct")
        .when(email_tag(ref), "email")
        .when(h.isNull(), "other")
        .when(host_in(h, ASSISTANTS), "assistant")
        .when(host_in(h, WEBMAIL), "email")
        .when(host_in(h, SEARCH) | F.rlike(h, F.lit(BRAND)), "search")
        .otherwise("other")
    )


def _tagged(url: Column, name: str) -> Column:
    """Every value that the url's query gives ``name``: decoded, trimmed, in lower case."""
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    plain = lambda c: F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))
    pairs = F.filter(F.split(query, "&"), lambda p: plain(F.substring_index(p, "=", 1)) == name)
    values = F.transform(pairs, lambda p: F.lower(F.trim(plain(F.regexp_extract(p, "^[^=]*=(.*)$", 1)))))
    # a url without a query has nothing to look through
    return F.when(F.contains(url, F.lit("?")), values)


def email_tag(url: Column) -> Column:
    """A campaign medium of the url is email."""
    return F.coalesce(F.array_contains(_tagged(url, "utm_medium"), "email"), F.lit(False))


def assistant_tag(url: Column) -> Column:
    """The first assistant host among the url's campaign sources, without a closing dot; else null."""
    hosts = F.transform(_tagged(url, "utm_source"), lambda v: F.regexp_replace(v, "\\.+$", ""))
    return F.get(F.filter(hosts, lambda h: host_in(h, ASSISTANTS)), 0)


def source(landing: Column | str, ref: Column | str) -> Column:
    """CLS-04: referrer class with the landing url's campaign tags; email wins, assistants fill direct and other."""
    landing = F.coalesce(F.col(landing) if isinstance(landing, str) else landing, F.lit(""))
    base = referrer(ref)
    return (
        F.when(email_tag(landing), "email")
        .when(base.isin("direct", "other") & assistant_tag(landing).isNotNull(), "assistant")
        .otherwise(base)
    )


def surface(p: Column | str, prefixes: tuple[tuple[str, str], ...] = (("/api", "api"), ("/mcp", "mcp"), ("/out", "out"))) -> Column:
    """SRC-14: surface of a path by whole leading segments, ``page`` for the rest."""
    p = F.col(p) if isinstance(p, str) else p
    out = F.lit("page")
    for prefix, name in reversed(prefixes):
        out = F.when((p == prefix) | F.startswith(p, F.lit(prefix + "/")), name).otherwise(out)
    return out


def subscriber_state(confirmed: Column | str, unsubscribed: Column | str) -> Column:
    """CLS-08: unsubscribed, confirmed or pending."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(unsubscribed).isNotNull(), "unsubscribed").when(c(confirmed).isNotNull(), "confirmed").otherwise("pending")


def plan_source(plan: Column | str, source_: Column | str, subscription: Column | str) -> Column:
    """CLS-09: where a paid plan comes from; null for a free one."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    paid = F.coalesce(c(plan), F.lit("free")) != "free"
    known = F.when(c(subscription).isNotNull(), "stripe").when(c(source_).isin("licence", "dev"), c(source_)).otherwise("unexplained")
    return F.when(paid, known)


def cycle_health(evidence: Column | str, reports: Column | str, blocked: Column | str) -> Column:
    """CLS-07: OK, watcher-empty or reporter-blocked."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(evidence) == 0, "watcher-empty").when((c(reports) == 0) | c(blocked), "reporter-blocked").otherwise("OK")


def not_a_grant(title: Column | str, kind: Column | str, summary: Column | str, loan: tuple[str, ...], grant: tuple[str, ...], kinds: tuple[str, ...]) -> Column:
    """CLS-05: reason a claim is no grant, null if it may be one."""
    low = lambda x: F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))
    word = lambda c, w: F.rlike(c, F.lit(f"(?U)\\b(?:{'|'.join(w)})"))
    return (
        F.when(low(kind).isin(*kinds), "kind")
        .when(word(low(title), loan) & ~word(low(title), grant), "title")
        .when(word(low(summary), loan) & ~word(low(summary), grant), "summary")
    )


def expired(text: Column | str, deadline: Column | str, today: Column, phrases: tuple[str, ...]) -> Column:
    """CLS-12: the text says so, or its date in any common form is before ``today``."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    d = F.col(deadline) if isinstance(deadline, str) else deadline
    forms = ("yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "dd/MM/yyyy")
    when = F.coalesce(*(F.try_to_date(d, f) for f in forms))
    return F.rlike(t, F.lit("|".join(phrases))) | F.coalesce(when < today, F.lit(False))

