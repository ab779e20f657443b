"""URL filters whose decisions reach redirects and canonical links; DataFrame functions only.

Rules judge a url by host and path. Urls that redirect to each other or name
each other as canonical are one group (connected components of these links);
in a group without a rule of its own a url takes the group's decision: allow if
any member is allowed by a rule, else block if any is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .scratch import keep
from .skew import attach

#: (verdict, host, path): of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Most rules that a list may have; each is tried on each url.
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = "^utm_[A-Za-z]+="
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
#: Comments, scripts and styles, in which no tag is one.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
#: A tag with up to 60 quoted values, which may hold `>`; a name with its value.
TAG = r"""(?i)<(?:link|meta|base)\b[^'">]*(?:(?:"[^"]*"|'[^']*')[^'">]*){0,60}>"""
NAMED = r"""(?i)([a-z0-9:_-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
REFRESH = r"""(?i)\burl\s*=\s*["']?\s*([^"']*)"""
#: Character references that urls in attributes have; the ampersand's own comes last.
ENTITIES = {"&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&#x2f;": "/", "&#x2F;": "/", "&#47;": "/", "&#58;": ":", "&#x3a;": ":", "&#61;": "=", "&#63;": "?", "&#38;": "&", "&#x26;": "&", "&amp;": "&"}
#: What a path has if it has segments of one or two dots; ports that say no more than the scheme.
DOTS = r"/\.\.?(/|$)"
PORT = ":(80|443)$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fold(path: Column) -> Column:
    """The path without `.` and `..` segments (RFC 3986, 5.2.4)."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(DOTS), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def key_of(url: Column) -> Column:
    """The url as links name it: host without the schemes' own ports, path without dot segments, query without tracking; null without `://`."""
    query = F.regexp_extract(url, "://[^?#]*[?]([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(TRACKING) & (p != "")), "&")
    return F.when(url.contains("://"), F.concat(F.regexp_replace(host_of(url), PORT, ""), fold(path_of(url)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none; of equally long ones allow wins.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(v == "allow").alias("first"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    best = F.array_max(F.array(*fits)) if len(fits) > 1 else fits[0]
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def resolve(link: Column, base: Column) -> Column:
    """A link as it stands in a page, as a url: absolute, with the base's scheme, from its root, or relative to its folder or (`?`) itself; null where it is empty, a fragment or no url of a host."""
    root = F.concat(F.lit("http://"), host_of(base))
    folder = F.when(path_of(base) == "", "/").otherwise(F.regexp_replace(path_of(base), "[^/]*$", ""))
    return (
        F.when((link == "") | link.startswith("#") | link.rlike(SCHEME) & ~link.contains("://"), None)
        .when(link.rlike(SCHEME), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .otherwise(F.concat(root, folder, link))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes and white space around it, its references decoded; null without."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(NAMED), F.lit(1)), F.lower)
    at = F.array_position(names, name)
    value = F.regexp_replace(F.try_element_at(F.regexp_extract_all(tag, F.lit(NAMED), F.lit(2)), F.when(at > 0, at).cast("int")), "^[\"']|[\"']$", "")
    for coded, plain in ENTITIES.items():
        value = F.replace(value, F.lit(coded), F.lit(plain))
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's key and that of each of its canonical links and of the pages that it refreshes to.

    Tags inside comments, scripts and styles are none. A link is canonical if `canonical` is among the words of its
    rel; links are relative to the page's first base, if it has one, else to the page. Html of any length is read.
    """
    text = F.regexp_replace(F.col(html).cast("string"), HIDDEN, " ")
    kind = lambda t: F.lower(F.regexp_extract(t, "^<([A-Za-z]+)", 1))
    tags = F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), lambda t: F.struct(kind(t).alias("kind"), F.lower(_attribute(t, "rel")).alias("rel"), _attribute(t, "href").alias("href"), F.lower(_attribute(t, "http-equiv")).alias("equiv"), _attribute(t, "content").alias("content")))
    rows = pages.select(F.col(url).cast("string").alias("u"), tags.alias("tags")).where(F.size("tags") > 0)
    base = F.try_element_at(F.filter("tags", lambda t: (t["kind"] == "base") & (t["href"] != "")), F.lit(1))["href"]
    rows = rows.select("u", F.coalesce(resolve(base, F.col("u")), F.col("u")).alias("base"), F.explode("tags").alias("t"))
    canonical = (F.col("t.kind") == "link") & F.array_contains(F.split("t.rel", r"\s+"), "canonical")
    refresh = (F.col("t.kind") == "meta") & (F.col("t.equiv") == "refresh")
    link = F.when(canonical, F.col("t.href")).when(refresh, F.regexp_replace(F.regexp_extract("t.content", REFRESH, 1), r"\s+$", ""))
    return rows.select(key_of(F.col("u")).alias("a"), key_of(resolve(link, F.col("base"))).alias("b")).where("a <> b")


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z
    lower-cased; path goes on up to `?`, `#` or the end; both are empty without
    `://` or for a null url, and no rule fits then. rule is null where none fits; the verdict then is
    the group's (see above). `redirects` may add rows (src, dst) of urls. Null
    html has no links; html of any length is read whole, in the JVM; a null id stays null. Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    u = F.col(url).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), key_of(u).alias("key"))
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(key_of(F.col("src").cast("string")).alias("a"), key_of(F.col("dst").cast("string")).alias("b")).where("a <> b"))
    groups = keep(components(links, "a", "b"), "url-groups")
    # Members and their groups' decisions: the host and path of a member are in its key.
    as_url = F.concat(F.lit("x://"), F.col("node"))
    own = groups.withColumn("own", fitting(host_of(as_url), path_of(as_url), rules)["verdict"])
    says = own.groupBy("component").agg(F.max((F.col("own") == "allow").cast("int")).alias("allow"), F.max((F.col("own") == "block").cast("int")).alias("block"), F.count("*").alias("n"))
    blocked = says.where("coalesce(allow, 0) = 0 and block = 1").select("component", "n")
    # A written table: then a url that very many rows share is split by adaptive execution.
    blocked = keep(attach(groups, blocked, ["component"], "n", groups.count()).select(F.col("node").alias("key"), F.lit(True).alias("blocked")), "blocked-urls")
    out = rows.withColumn("fit", fitting(F.col("host"), F.col("path"), rules)).join(blocked, "key", "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def _sql() -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    low = lambda x: f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
    host = lambda x: low(f"regexp_extract({x}, '://([^/?#]*)', 1)")
    path = lambda x: f"coalesce(regexp_extract({x}, '://[^/?#]*([^?#]*)', 1), '')"
    query = lambda x: f"array_to_string(list_filter(string_split(regexp_extract({x}, '://[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}')), '&')"
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    # Segments as lists of one, put together from the left; a first empty one is dropped in the end.
    kept = lambda x: f"list_reduce(list_transform(list_prepend('', string_split({x}, '/')[2:]), lambda z: [z]), lambda a, z: CASE z[1] WHEN '.' THEN a WHEN '..' THEN CASE WHEN len(a) > 1 THEN a[:len(a) - 1] ELSE a END ELSE list_concat(a, z) END)"
    fold_ = lambda x: f"CASE WHEN regexp_matches({x}, {quote(DOTS)}) THEN '/' || array_to_string({kept(x)}[2:], '/') || CASE WHEN string_split({x}, '/')[-1] IN ('.', '..') AND len({kept(x)}) > 1 THEN '/' ELSE '' END ELSE {x} END"
    key = lambda x: f"CASE WHEN contains({x}, '://') THEN regexp_replace({host(x)}, '{PORT}', '') || {fold_(path(x))} || CASE WHEN {query(x)} <> '' THEN '?' || {query(x)} ELSE '' END END"

    def attribute(name: str) -> str:
        value = f"regexp_replace(vs[list_position(ns, '{name}')], '^[\"'']|[\"'']$', '', 'g')"
        for coded, plain in ENTITIES.items():
            value = f"replace({value}, {quote(coded)}, {quote(plain)})"
        return f"regexp_replace({value}, '^\\s+|\\s+$', '', 'g')"

    def resolved(t: str, u: str) -> str:
        root, folder = f"'http://' || {host(u)}", f"CASE WHEN {path(u)} = '' THEN '/' ELSE regexp_replace({path(u)}, '[^/]*$', '') END"
        return f"""CASE WHEN {t} = '' OR starts_with({t}, '#') OR (regexp_matches({t}, '{SCHEME}') AND NOT contains({t}, '://')) THEN NULL WHEN regexp_matches({t}, '{SCHEME}') THEN {t} WHEN starts_with({t}, '//') THEN 'http:' || {t}
  WHEN starts_with({t}, '/') THEN {root} || {t} WHEN starts_with({t}, '?') THEN {root} || {path(u)} || {t} ELSE {root} || {folder} || {t} END"""

    fit = lambda h, p, what: f"(SELECT {what} FROM rules r WHERE ({h} = r.h OR ends_with({h}, '.' || r.h)) AND starts_with({p}, r.p) ORDER BY length(r.h || r.p) DESC, r.v, r.h || r.p DESC LIMIT 1)"
    return f"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {values}),
pg AS (SELECT page_id, url, {host("url")} AS host, {path("url")} AS path, {key("url")} AS key, html FROM pages),
tag AS (SELECT url, key AS a, unnest(x) AS tag, unnest(range(1, len(x) + 1)) AS i FROM (SELECT url, key, regexp_extract_all(regexp_replace(html, {quote(HIDDEN)}, ' ', 'g'), {quote(TAG)}, 0) AS x FROM pg)),
att AS (SELECT *, lower(regexp_extract(tag, '^<([A-Za-z]+)', 1)) AS kind, list_transform(regexp_extract_all(tag, {quote(NAMED)}, 1), lambda n: lower(n)) AS ns, regexp_extract_all(tag, {quote(NAMED)}, 2) AS vs FROM tag),
val AS (SELECT url, a, i, kind, lower({attribute("rel")}) AS rel, {attribute("href")} AS href, lower({attribute("http-equiv")}) AS equiv, {attribute("content")} AS content FROM att),
base AS (SELECT url AS bu, min_by(href, i) AS bh FROM val WHERE kind = 'base' AND href <> '' GROUP BY url),
lnk AS (SELECT a, coalesce({resolved("bh", "url")}, url) AS u, CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(rel, '\\s+'), 'canonical') THEN href WHEN kind = 'meta' AND equiv = 'refresh' THEN regexp_replace(regexp_extract(content, {quote(REFRESH)}, 1), '\\s+$', '') END AS t FROM val LEFT JOIN base ON bu = url),
tgt AS (SELECT a, {resolved("t", "u")} AS t FROM lnk WHERE t IS NOT NULL),
edge AS (SELECT DISTINCT a, {key("t")} AS b FROM tgt), sym AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
node AS (SELECT DISTINCT a AS node FROM sym),
own AS (SELECT node, {fit("regexp_extract(node, '^[^/?#]*')", path("('x://' || node)"), "r.v")} AS v FROM node),
reach(node, v) AS (SELECT node, v FROM own WHERE v IS NOT NULL UNION SELECT s.b, r.v FROM reach r JOIN sym s ON s.a = r.node),
grp AS (SELECT node, min(v) AS v FROM reach GROUP BY node)
SELECT page_id, host, path, {fit("host", "path", "r.h || r.p")} AS rule,
       coalesce({fit("host", "path", "r.v")}, grp.v, 'allow') AS verdict
FROM pg LEFT JOIN grp ON grp.node = pg.key
"""


ORACLE = _sql()
