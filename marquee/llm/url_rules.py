"""URL filter with redirect equivalence (operator 5), with DataFrame functions only.

Rules judge urls by host and path prefix. Redirect and canonical-link edges between urls make
equivalence classes (connected components, computed distributed); a url without a rule of its own
follows its class: allow if a member is allowed by a rule, else block if a member is blocked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import written

#: Fixed values of the contract: (rule, verdict). A bare top-level domain fits all its subdomains.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, or null. A rule fits its host and subdomains if the path starts with the rule's."""
    found = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if found is None else found


def node_of(url: Column) -> Column:
    """What two urls share if they are the same resource: host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^#]*)", 1))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value's expression once in the plan however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _without_dots(path: Column) -> Column:
    """A path that begins with / without its . and .. segments."""
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    end = lambda parts: F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    left = lambda parts: F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), end(parts)), "/"))
    return _let(path, lambda p: F.when(F.instr(p, "/.") > 0, _let(F.slice(F.split(p, "/", -1), F.lit(2), F.length(p) + 1), left)).otherwise(p))


def resolve(base: Column, target: Column) -> Column:
    """target as an absolute url: relative ones (//, /, ?, plain) against base. Null for empty ones, fragments, other schemes, or without an absolute base."""

    def resolved(x: Column) -> Column:
        b, t = x["base"], x["target"]
        scheme = F.when(F.instr(b, "://") > 0, F.substring_index(b, "://", 1))
        site = F.concat(scheme, F.lit("://"), F.regexp_extract(_after_scheme(b), r"(?s)^[^/?#]*", 0))
        own, rest = F.regexp_extract(t, r"(?s)^[^?#]*", 0), F.regexp_extract(t, r"(?s)^[^?#]*(.*)", 1)
        folder = F.concat(F.lit("/"), F.regexp_extract(path_of(b), r"(?s)^/(.*/)", 1))
        path = F.when(t.startswith("?"), path_of(b)).otherwise(_without_dots(F.when(t.startswith("/"), own).otherwise(F.concat(folder, own))))
        return (
            F.when((t == "") | t.startswith("#"), F.lit(None).cast("string"))
            .when(t.rlike("(?i)^[a-z][a-z0-9+.-]*://"), t)
            .when(t.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
            .otherwise(F.concat(site, path, rest))
        )

    return _let(F.struct(base.alias("base"), target.alias("target")), resolved)


def _decoded(target: Column) -> Column:
    """Character references of / and & in an attribute's value; & last, so that nothing is decoded twice."""
    return F.regexp_replace(F.regexp_replace(target, "(?i)&#(?:0*47|x0*2f);", "/"), "(?i)&(?:amp|#0*38|#x0*26);", "&")


def html_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of <link rel="canonical"> and of <meta http-equiv="refresh">; relative targets are resolved against the page's <base>, or its url."""
    tag = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["'\s][^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["'\s][^>]*>"""
    hinted = pages.filter(F.col(html).rlike(r"(?i)canonical|refresh"))
    href = r"""(?is)%s[\s"'/]href\s*=\s*["']?\s*([^"'\s>]+)"""
    based = F.regexp_extract(html, href % r"<base\b(?:[^>]*?)(?=[\s\"'/]href)", 1)
    base = F.coalesce(resolve(F.col(url), _decoded(based)), F.col(url))
    tags = hinted.select(F.col(url).alias("src"), base.alias("base"), F.explode(F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(0))).alias("tag"))
    of_link = F.regexp_extract("tag", href % "", 1)
    of_meta = F.regexp_extract("tag", r"""(?is)[\s;,"'=]url\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    target = _decoded(F.when(F.col("tag").rlike("(?i)^<link"), of_link).otherwise(of_meta))
    return tags.select("src", resolve(F.col("base"), target).alias("dst")).filter("dst <> ''")


def mirror_key(url: Column) -> Column:
    """What pages that mirror each other share: the path without a last / or .html; empty if there is none."""
    return F.regexp_replace(path_of(url), r"(/|\.html)$", "")


def mirror_edges(pages: DataFrame, url: str = "url") -> DataFrame:
    """(src, dst) that link every page with a node of its mirror_key(), for corpora whose hosts carry the same pages."""
    key = mirror_key(F.col(url))
    return pages.select(F.col(url).alias("src"), F.concat(F.lit("http://mirror"), key).alias("dst")).filter(key != "")


def judge(pages: DataFrame, edges: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url, html).

    edges: (src, dst) urls of redirects and canonical links; if None, those found in html. Urls that
    no page has can link pages and carry a rule's decision too. Null urls, or urls without ://, have
    empty host and path, fit no rule and no class, and get the default; so does a url whose class has no ruled member.
    Repeated rows are judged each; an empty table gives no rows; other columns are ignored. Very long urls and html are read whole.
    """
    edges = html_edges(pages) if edges is None else edges
    nodes = written(edges.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).filter("a <> '' and b <> ''").distinct())
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.lit(None).cast("map<string,string>")
    own = F.element_at(verdicts, F.col("rule"))
    if nodes.isEmpty():
        return base.select("page_id", "host", "path", "rule", F.coalesce(own, F.lit(default)).alias("verdict"))
    classes = components(nodes)
    # each member's own decision needs only its node: the first / ends the host
    host, path = F.regexp_extract("node", r"(?s)^[^/?#]*", 0), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)
    ruled = classes.withColumn("own", F.element_at(verdicts, rule_of(host, path, rules)))
    decided = ruled.groupBy("component").agg(F.min("own").alias("class_verdict"))  # allow sorts before block
    of_node = classes.join(decided, "component").select(F.col("node").alias("of"), "class_verdict")
    joined = base.join(of_node, F.col("node") == F.col("of"), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce(own, "class_verdict", F.lit(default)).alias("verdict"))


#: DuckDB SQL of judge(pages) where all targets are absolute and without character references.
URL_SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '') AS tail FROM u),
t AS (SELECT host || tail AS a, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical["''\s][^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh["''\s][^>]*>')) AS tag FROM p),
e0 AS (SELECT a, regexp_extract(tag, '(?is)(?:href\s*=\s*["'']?|url\s*=\s*[''"]?)([a-z][a-z0-9+.-]*://[^"''\s>]+)', 1) AS dst FROM t),
e1 AS (SELECT a, substr(dst, strpos(dst, '://') + 3) AS d FROM e0 WHERE dst <> ''),
e AS (SELECT DISTINCT a, translate(regexp_extract(d, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(d, '^[^/?#]*([^#]*)', 1) AS b FROM e1 WHERE a <> ''),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON r.other = x.a),
rules AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) r(rule, h, pre, verdict)),
n AS (SELECT DISTINCT other, regexp_extract(other, '^[^/?#]*') AS host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
nr AS (SELECT other, arg_max(verdict, length(rule)) AS own FROM n JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.pre) GROUP BY other),
cls AS (SELECT reach.node, min(nr.own) AS v FROM reach JOIN nr ON reach.other = nr.other GROUP BY reach.node),
pr AS (SELECT p.page_id, p.host, p.path, p.tail, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS own FROM p
       LEFT JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre) GROUP BY ALL)
SELECT pr.page_id, pr.host, pr.path, pr.rule, coalesce(pr.own, cls.v, 'allow') AS verdict FROM pr LEFT JOIN cls ON pr.host || pr.tail = cls.node
"""

#: DuckDB SQL of judge(pages, mirror_edges(pages)).
MIRROR_SQL = URL_SQL[: URL_SQL.index("t AS (SELECT host")] + r"""e AS (SELECT DISTINCT host || tail AS a, 'mirror' || regexp_replace(path, '(/|\.html)$', '') AS b FROM p WHERE host || tail <> '' AND regexp_replace(path, '(/|\.html)$', '') <> ''),
""" + URL_SQL[URL_SQL.index("both_ways AS") :]
