r"""URL filters over redirect-equivalent pages.

Rules (host and path prefix) judge a url; the longest that fits wins. Pages that redirect to, or name
as canonical, another url are the same thing under two names: connected components over these edges
carry a block to every alias. An explicit allow rule that fits a url itself always has precedence, so
an allowed alias of a blocked page stays allowed. Urls that only occur as targets take part.

Scale: only DataFrame functions. Pages are scanned where they lie; what is shuffled are edges, i.e.
pages that declare one, then two aggregations per round of the components, then blocked components. The
rules are a parameter, not data.

Defined results: null urls and urls without :// have an empty host and path, fit no rule and are
allowed; a null html declares no edge; an edge to the page itself links nothing; relative targets are
resolved against the page's scheme and host (and folder); fragments are no part of a node; repeated
rows are judged alike; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored, table
from .components import connected

#: (verdict, rule): the host up to the first slash, then the path prefix.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, _, rest = rule.partition("/")
        ok = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        fits.append(F.when(ok, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def _node(url: Column) -> Column:
    """A url as a node: scheme and host in lower case, no fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.substr(bare, F.length(head) + 1)))


def _resolved(base: Column, target: Column) -> Column:
    """target against the page it stands on."""
    t = F.trim(F.regexp_replace(target, "&amp;", "&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"(?s)[?#].*$", "")
    folder = F.when(F.length(page) > F.length(origin), F.regexp_replace(page, r"[^/]*$", "")).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(t == "", None).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(scheme, t))
        .when(t.startswith("/"), F.concat(origin, t)).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).otherwise(F.concat(folder, t))
    )


def declared_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of pages and of the canonical links and meta redirects in their html."""
    tags = F.concat(F.regexp_extract_all("html", F.lit(r"(?is)(<link\b[^>]*>)"), 1), F.regexp_extract_all("html", F.lit(r"(?is)(<meta\b[^>]*>)"), 1))
    quoted = lambda tag, name: F.coalesce(F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*\"([^\"]*)\"", 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*'([^']*)'", 1), F.lit("")), F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*([^\s\"'>]+)", 1))
    tag = F.col("tag")
    target = F.when(tag.rlike(r"(?is)^<link\b") & F.lower(quoted(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)"),
        quoted(tag, "href")).when(tag.rlike(r"(?is)^<meta\b") & (F.lower(F.trim(quoted(tag, "http-equiv"))) == "refresh"),
        F.trim(F.translate(F.regexp_extract(quoted(tag, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$", 1), "'\"", "")))
    some = pages.select("url", "html").where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|refresh"))
    found = some.select("url", F.explode(tags).alias("tag")).select("url", target.alias("target")).where("target is not null and target <> ''")
    return found.select(_node(F.col("url")).alias("a"), _node(_resolved(F.col("url"), F.col("target"))).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, inherited: a row per page. `edges` (a, b) adds known redirects."""
    links = declared_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(_node(F.col("a")).alias("a"), _node(F.col("b")).alias("b")))
    member = stored(connected(links), "urlfilter-members")
    url = F.col("node")
    blocked = member.where(rule_of(host_of(url), path_of(url), rules)["verdict"] == "block").select("component").distinct()
    # What inherits a block are the nodes of components with a blocked member.
    tainted = small(stored(member.join(blocked, "component", "left_semi").select("node"), "urlfilter-tainted"), 256)
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", _node(F.col("url")))
    judged = judged.join(tainted.select("node", F.lit(True).alias("hit")), "node", "left")
    inherited = F.col("r").isNull() & F.coalesce("hit", F.lit(False))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(inherited, "block").otherwise("allow")).alias("verdict"), inherited.alias("inherited"))


def op1_urlfilter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
with recursive rules(verdict, rule, rhost, rpath) as (values
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
tags as (
  select url, unnest(list_concat(regexp_extract_all(html, '(?is)<link\b[^>]*>'), regexp_extract_all(html, '(?is)<meta\b[^>]*>'))) as tag
  from pages where contains(url, '://')),
attrs as (
  select url, tag,
    lower(regexp_extract(tag, '(?is)\brel\s*=\s*["'']?([^"''>\s]*)', 1)) as rel, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1) as href,
    lower(regexp_extract(tag, '(?is)\bhttp-equiv\s*=\s*["'']?([^"''>\s]*)', 1)) as equiv, regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''>\s]*)', 1) as goal
  from tags),
raw as (
  select url, replace(case when starts_with(lower(tag), '<link') then href else goal end, '&amp;', '&') as t
  from attrs where (starts_with(lower(tag), '<link') and rel = 'canonical') or (starts_with(lower(tag), '<meta') and equiv = 'refresh')),
full_ as (
  select url, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when starts_with(t, '//') then regexp_extract(url, '^(.*?:)//', 1) || t
    when starts_with(t, '/') then regexp_extract(url, '^(.*?://[^/?#]*)', 1) || t
    else regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || t end as target
  from raw where t <> ''),
pair as (
  select lower(regexp_extract(url, '^(.*?://[^/?#]*)', 1)) || regexp_extract(regexp_replace(url, '#.*$', ''), '^.*?://[^/?#]*(.*)$', 1) as a,
    lower(regexp_extract(target, '^(.*?://[^/?#]*)', 1)) || regexp_extract(regexp_replace(target, '#.*$', ''), '^.*?://[^/?#]*(.*)$', 1) as b
  from full_),
edge as (select a, b from pair where a <> b union select b, a from pair where a <> b),
node as (
  select a as url from edge union
  select lower(regexp_extract(url, '^(.*?://[^/?#]*)', 1)) || regexp_extract(regexp_replace(url, '#.*$', ''), '^.*?://[^/?#]*(.*)$', 1) from pages where contains(url, '://')),
parts as (
  select url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(url,
      '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from (select url from node union select url from pages where url is not null)),
ruled as (
  select url, rule, verdict from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  qualify row_number() over (partition by url order by length(rule) desc) = 1),
reach(url) as (
  select edge.a from edge join ruled on edge.a = ruled.url and verdict = 'block'
  union select edge.b from reach join edge on edge.a = reach.url)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
  coalesce(verdict, case when lower(regexp_extract(pages.url, '^(.*?://[^/?#]*)', 1)) || regexp_extract(regexp_replace(pages.url, '#.*$', ''),
      '^.*?://[^/?#]*(.*)$', 1) in (select url from reach) then 'block' else 'allow' end) as verdict
from pages left join parts using (url) left join ruled using (url)
"""
