"""URL filtering with block decisions carried over redirect and canonical-link aliases.

A URL first gets the longest rule that fits its host and path. Addresses that redirect to one another,
or name one another as canonical, are one component; a URL without a rule is blocked if its component
has a blocked address and none that a rule explicitly allows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import pinned

Rule = tuple[str, str, str]

#: (verdict, host, path)
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_SENT = 100_000
_TRACKING = r"(?:utm_[^=&#]*|ref|fbclid|gclid)"


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """What tells addresses apart: host, path without a closing slash, and the query without tracking; null without a host.

    The fragment ends an address, whatever it holds.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{_TRACKING}(?:=|$)")), "&")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved; .. above the root is dropped."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    steps = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .when(step == ".", done)
        .otherwise(F.concat(done, F.array(step))),
    )
    return F.concat(F.array_join(steps, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def _target(url: Column, href: Column) -> Column:
    """The absolute URL of a link on a page: only a leading scheme makes it absolute, other links are read from the page's own
    address. Null for other schemes (mailto and the like), for a link within the page, and on a page without a host."""
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    way, rest = F.regexp_extract(href, r"(?s)^([^?#]*)", 1), F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    there = F.when(href.startswith("/"), way).when(way == "", path_of(url)).otherwise(F.concat(folder, way))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | href.startswith("#") | (href == "") | (host_of(url) == ""), None)
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), href))
        .otherwise(F.concat(origin, _without_dots(there), rest))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, or empty."""
    value = [F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*{form}", 1) for form in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")]
    return F.trim(F.regexp_replace(F.when(value[0] != "", value[0]).when(value[1] != "", value[1]).otherwise(value[2]), "&amp;", "&"))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): all canonical links and refresh redirects that pages state about themselves.

    ``rel`` may name canonical among other relations; relative links are resolved against the page's url.
    """
    u, h = F.col(url), F.col(html)
    links, metas = (F.regexp_extract_all(h, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0)) for tag in ("link", "meta"))
    canonical = F.filter(links, lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(metas, lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    hrefs = F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(refresh, lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"(?is)\burl\s*=\s*[\"']?([^\"']*)", 1))),
    )
    # Most pages have neither word, which is cheap to see.
    said = F.lower(h).contains("canonical") | F.lower(h).contains("http-equiv")
    found = pages.where(said).select(u.alias("url"), F.explode(hrefs).alias("href")).where(F.col("href") != "")
    return found.select("url", _target(F.col("url"), F.col("href")).alias("target")).where(F.col("target").isNotNull())


def with_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule (host and path of the rule, verdict) to rows with row, host and path; null where none fits.

    The longest rule wins, by host and path together, then by host; of equal ones an allowing rule.
    """
    rules = rules.select("verdict", _lower(F.col("host")).alias("_host"), F.coalesce("path", F.lit("/")).alias("_path"))
    by_host = rules.groupBy("_host").agg(F.collect_set(F.struct("_path", "verdict")).alias("_rules"))
    if rules.limit(_SENT + 1).count() <= _SENT:
        by_host = F.broadcast(by_host)
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = rows.where(F.col("host") != "").select("row", "path", F.explode(endings).alias("_host")).join(by_host, "_host")
    fitting = F.filter("_rules", lambda r: F.col("path").startswith(r["_path"]))
    ranked = F.transform(
        fitting,
        lambda r: F.struct(
            (F.length("_host") + F.length(r["_path"])).alias("size"), F.length("_host").alias("host_size"),
            (r["verdict"] == "allow").alias("allows"), F.concat("_host", r["_path"]).alias("rule"), r["verdict"].alias("verdict"),
        ),
    )
    best = met.select("row", F.array_max(ranked).alias("best")).groupBy("row").agg(F.max("best").alias("best"))
    return rows.join(best, "row", "left").select(
        *rows.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled")
    )


def judged_urls(
    pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, *, id: str = "page_id", url: str = "url", html: str | None = "html"
) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict (allow or block).

    redirects has url and target; with html, links that pages state are edges too. Targets need not be
    pages. A url that is null or has no ``://`` has an empty host and path, fits no rule, has no alias and
    is allowed. Repeated rows are judged apart and alike. Other columns are ignored.
    """
    links = redirects.select("url", "target") if redirects is not None else None
    if html:
        stated = page_links(pages, url, html)
        links = stated if links is None else links.unionByName(stated)

    def addresses(rows: DataFrame, id: Column, u: Column) -> DataFrame:
        return rows.select(
            id.alias("id"), host_of(u).alias("host"), path_of(u).alias("path"),
            F.xxhash64(address_of(u)).alias("node"), address_of(u).isNotNull().alias("known"),
        )

    # Ends of links have rules too, pages or not.
    page = F.struct(F.col(id).alias("id"))
    rows = addresses(pages, page, F.col(url).cast("string"))
    edges = None
    if links is not None:
        links = pinned(links)
        for end in ("url", "target"):
            rows = rows.unionByName(addresses(links, F.lit(None).cast(rows.schema["id"].dataType), F.col(end)))
        edges = links.select(address_of(F.col("url")).alias("a"), address_of(F.col("target")).alias("b")).where(
            F.col("a").isNotNull() & F.col("b").isNotNull()
        )
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("node", F.when(F.col("known"), F.col("node")))
    named = pinned(with_rule(pinned(rows.drop("known")), rules))
    if edges is not None:
        groups = components(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), "a", "b")
        groups = groups.select(F.col("node").alias("_node"), F.col("component").alias("_to"))
        named = named.join(groups, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("_to", "node"))
    else:
        named = named.withColumn("component", F.col("node"))
    # An allowing rule precedes a blocking one.
    decided = named.where(F.col("ruled").isNotNull()).groupBy(F.col("component").alias("_component")).agg(F.min("ruled").alias("inherited"))
    return named.where(F.col("id").isNotNull()).join(decided, F.col("component") == F.col("_component"), "left").select(
        F.col("id.id").alias(id), "host", "path", "rule", F.coalesce("ruled", "inherited", F.lit("allow")).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


SQL = r"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
),
seen AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
tagged AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM seen),
worded AS (
  SELECT url, lower(tag[2:5]) AS kind, list_transform(['rel', 'href', 'http-equiv', 'content'], lambda k: replace(trim(coalesce(
    nullif(regexp_extract(tag, '(?is)[\s"''/]' || k || '\s*=\s*"([^"]*)"', 1), ''),
    nullif(regexp_extract(tag, '(?is)[\s"''/]' || k || '\s*=\s*''([^'']*)''', 1), ''),
    regexp_extract(tag, '(?is)[\s"''/]' || k || '\s*=\s*([^\s"''>]+)', 1))), '&amp;', '&')) AS v
  FROM tagged
),
tags AS (
  SELECT url, v[2] AS href FROM worded WHERE kind = 'link' AND list_contains(regexp_split_to_array(lower(v[1]), '\s+'), 'canonical')
  UNION ALL
  SELECT url, trim(regexp_extract(v[4], '(?is)\burl\s*=\s*["'']?([^"'']*)', 1)) FROM worded WHERE kind = 'meta' AND lower(v[3]) = 'refresh'
),
aimed AS (
  SELECT url, href, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin, regexp_extract(href, '(?s)^[^?#]*(.*)$', 1) AS rest,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS here, regexp_extract(href, '(?s)^([^?#]*)', 1) AS way
  FROM tags WHERE href <> ''
),
placed AS (
  SELECT *, CASE WHEN starts_with(href, '/') THEN way WHEN way = '' THEN here
    ELSE coalesce(nullif(regexp_replace(here, '[^/]*$', ''), ''), '/') || way END AS there
  FROM aimed
),
links AS (
  SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(href, '#') OR regexp_extract(url, '://([^/?#]*)', 1) = '' THEN NULL
    WHEN starts_with(href, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || href
    ELSE origin || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(there, '/'), lambda x: [x])),
        lambda a, x: CASE WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN x[1] = '.' THEN a ELSE a || x END), '/')
      || CASE WHEN regexp_matches(there, '(?:^|/)\.\.?$') THEN '/' ELSE '' END || rest END AS target
  FROM placed
),
urls AS (SELECT url FROM seen UNION SELECT target FROM links WHERE target IS NOT NULL),
parts AS (
  SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
    array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=&#]*|ref|fbclid|gclid)(?:=|$)')), '&') AS query
  FROM urls
),
named AS (
  SELECT url, host, path, host || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS node
  FROM parts
),
edge AS (
  SELECT a.node AS x, b.node AS y FROM links JOIN named a ON a.url = links.url JOIN named b ON b.url = links.target
  WHERE a.host <> '' AND b.host <> ''
),
twoway AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
reach AS (
  SELECT DISTINCT node, node AS other FROM named WHERE host <> ''
  UNION SELECT reach.node, twoway.y FROM reach JOIN twoway ON reach.other = twoway.x
),
fit AS (
  SELECT url, verdict, rhost || rpath AS rule,
    row_number() OVER (PARTITION BY url ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, verdict) AS k
  FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
),
ruled AS (SELECT n.url, n.host, n.path, n.node, f.rule, f.verdict FROM named n LEFT JOIN (SELECT * FROM fit WHERE k = 1) f USING (url)),
inherited AS (
  SELECT reach.node, min(r.verdict) AS verdict
  FROM reach JOIN ruled r ON r.host <> '' AND r.node = reach.other GROUP BY reach.node
)
SELECT page_id, r.host, r.path, r.rule, coalesce(r.verdict, i.verdict, 'allow') AS verdict
FROM seen JOIN ruled r USING (url) LEFT JOIN inherited i ON r.host <> '' AND i.node = r.node"""
