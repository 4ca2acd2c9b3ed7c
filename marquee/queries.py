"""The registered queries of the catalog engine, each with the SQL that gives the same rows.

Every query runs over whole tables; a limit stands only where it is the operator (pages, top lists).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract, parse, scalar, text
from .functions import vocab as V
from .operators import contain, engage, fuzzy, groups, mutate, rollup, search
from .plans.query import prepare
from .sources import catalog
from .sources import fixtures as X
from .sources.index import TextIndex
from .sources.store import once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ASKED, TIER_ASKED = "blue bolt", "red bolt 1999"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return s.replace("'", "''")


def _sub(x: str, pattern: str, by: str = " ", flags: str = "gi") -> str:
    return f"regexp_replace({x}, '{_q(pattern)}', '{by}', '{flags}')"


def _group(x: str, pattern: str, k: int) -> str:
    return f"nullif(regexp_extract({x}, '(?i){_q(pattern)}', {k}), '')::INT"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s{{2,}}', ' ', 'g'))"


def _first(x: str, table: tuple, default: object) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{k}') THEN {lit(v)}" for k, v in table) + f" ELSE {lit(default)} END"


def _collapse(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def _strip(x: str) -> str:
    t = _sub(_sub(f"lower({x})", r"s\d{1,2}e\d{1,3}"), r"s\d{1,2}\b")
    t = _sub(_sub(t, r"\b(19|20)\d{2}\b"), V.TECH_WORDS)
    return _squeeze(f"regexp_replace({t}, '[^a-z0-9 ]', ' ', 'g')")


def _se(x: str, k: int) -> str:
    alone = (V.SEASON, V.EPISODE)[k - 1]
    return f"coalesce(CASE WHEN regexp_matches({x}, '(?i){V.SEASON_EPISODE}') THEN {_group(x, V.SEASON_EPISODE, k)} WHEN regexp_matches({x}, '(?i){V.CROSS_EPISODE}') THEN {_group(x, V.CROSS_EPISODE, k)} ELSE {_group(x, alone, 1)} END, 0)"


def _web_se(x: str, k: int) -> str:
    if k == 2:
        return f"coalesce({_group(x, V.WEB_SEASON_EPISODE, 2)}, 0)"
    return f"coalesce(CASE WHEN regexp_matches({x}, '(?i){V.WEB_SEASON_EPISODE}') THEN {_group(x, V.WEB_SEASON_EPISODE, 1)} ELSE {_group(x, V.SEASON, 1)} END, 0)"


def _year(x: str) -> str:
    return f"coalesce(list_max(regexp_extract_all({x}, '{V.YEAR}', 1)::INT[]), 0)"


def _title(x: str) -> str:
    t = f"regexp_replace({_sub(x, V.WEB_EXTENSION, '')}, '{V.WEB_PUNCTUATION}', ' ', 'g')"
    t = f"CASE WHEN regexp_matches({t}, '(?i){V.WEB_SEASON_EPISODE}') THEN {_sub(t, '(?s)' + V.WEB_SEASON_EPISODE + '.*$', '', 'i')} ELSE {_sub(t, '(?s)' + V.SEASON + '.*$', '', 'i')} END"
    t = _sub(f"({t})", "(?s)" + V.WEB_YEAR + ".*$", "", "i")
    return _squeeze(_sub(_sub(t, V.WEB_JUNK, ""), V.WEB_LANGUAGES, ""))


SHOWN = "coalesce(nullif(caption, ''), file_name)"
BOTH = "(coalesce(file_name, '') || ' ' || coalesce(caption, ''))"
_CATEGORY = f"coalesce(nullif(category, ''), CASE WHEN regexp_matches(shown, '(?i){V.ANIME_WORDS}') THEN 'anime' WHEN season > 0 THEN 'series' ELSE 'movie' END)"
KEYED = f"""k0 AS (SELECT *, {SHOWN} AS shown FROM catalog), k1 AS (SELECT *, {_web_se("shown", 1)} AS season, {_web_se("shown", 2)} AS episode, lower({_title("shown")}) AS title_key FROM k0),
keyed AS (SELECT *, {_CATEGORY} AS content_type FROM k1)"""
CARDS = "cards AS (SELECT title_key, count(*) AS files, max(file_id) AS latest_id, arg_max(file_name, file_id) AS file_name, arg_max(content_type, file_id) AS content_type FROM keyed WHERE title_key <> '' GROUP BY title_key)"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return X.files(spark, sf)


def _fit(c: str, norm: str) -> str:
    """The search predicate for a query of several words."""
    words = " AND ".join(f"regexp_matches({c}, '(?i)\\b{w}\\b')" for w in norm.split() if len(w) > 1)
    title = prepare(norm).title
    return f"coalesce(contains({_collapse(c)}, '{title.replace(' ', '')}') OR ({words}) OR contains(lower({c}), '{norm}'), false)"


def _found(norm: str) -> str:
    return f"""{X.FILES}, hit AS (SELECT * FROM files WHERE {_fit("file_name", norm)} OR {_fit("caption", norm)}),
found AS (SELECT * FROM hit WHERE store = 'primary' UNION ALL SELECT * FROM hit WHERE store = 'secondary' AND file_id NOT IN (SELECT file_id FROM hit WHERE store = 'primary'))"""


def _tier(one: str, two: str) -> str:
    """The title tier for a query of two words, over (s: stripped text, raw: shown text)."""
    stop = ", ".join(f"'{w}'" for w in (*V.FILLER_WORDS, one, two))
    own = "list_distinct(w)"
    more = f"len(list_filter({own}, lambda x: x NOT IN ({stop})))"
    gap = f"list_min(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] = '{one}' AND list_position(w[i+1:], '{two}') > 0 THEN list_position(w[i+1:], '{two}') - 1 END), lambda g: g IS NOT NULL))"
    return f"""t0 AS (SELECT *, {_strip("raw")} AS s FROM r0), t1 AS (SELECT *, list_filter(string_split(s, ' '), lambda x: x <> '') AS w FROM t0),
t2 AS (SELECT *, {more} AS more, {gap} AS gap, replace(s, ' ', '') AS c FROM t1),
t3 AS (SELECT *, CASE WHEN c = '{one}{two}' OR {_collapse("raw")} = '{one}{two}' THEN 100 WHEN list_sort({own}) = list_sort(['{one}', '{two}']) THEN 95
  WHEN list_contains(w, '{one}') AND list_contains(w, '{two}') THEN CASE WHEN gap = 0 AND more = 0 THEN 90 WHEN gap = 0 THEN greatest(35, 65 - 5 * more)
  WHEN gap <= 2 THEN greatest(15, 40 - 6 * gap - 4 * more) ELSE greatest(1, 8 - coalesce(gap, 10) // 3) END
  WHEN starts_with(c, '{one}{two}') THEN 25 WHEN contains(c, '{one}{two}') THEN 15 ELSE 0 END AS tier FROM t2)"""


def _ranked(norm: str, year: int) -> str:
    one, two = prepare(norm).title.split()
    quality, resolution = _first("raw", V.QUALITY_SCORES, 0), _first("raw", V.RESOLUTION_SCORES, 0)
    lang = f"regexp_matches(raw, '(?i){V.FACET_LANGUAGE}')::INT"
    cap = f"CASE WHEN season > 0 AND year <> {year} THEN least(tier, 20) ELSE tier END" if year else "tier"
    return f"""{_found(norm)}, r0 AS (SELECT *, {SHOWN} AS raw FROM found), {_tier(one, two)},
t4 AS (SELECT *, {_se("raw", 1)} AS season, {_se("raw", 2)} AS ep, {_year("raw")} AS year FROM t3),
t5 AS (SELECT *, regexp_matches(raw, '(?i){V.EPISODE_RANGE}') AS ranged, season > 0 AND regexp_matches(raw, '(?i){V.SEASON_PACK}') AS pack FROM t4),
ranked AS (SELECT *, row_number() OVER (ORDER BY {cap} DESC, season DESC, CASE WHEN ranged OR pack THEN 0 ELSE 1 END DESC,
  CASE WHEN ranged THEN greatest({_group("raw", V.EPISODE_RANGE, 1)}, {_group("raw", V.EPISODE_RANGE, 2)}) WHEN pack THEN 9999 ELSE ep END DESC,
  {f"(year = {year})::INT" if year else "0"} DESC, year DESC, {lang} + (({quality}) > 0)::INT + (({resolution}) > 0)::INT DESC, -({quality}) DESC, -({resolution}) DESC,
  regexp_matches(raw, '(?i){V.MULTI_AUDIO}')::INT DESC, (list_contains(w, '{one}')::INT + list_contains(w, '{two}')::INT) / 2 DESC, file_id) AS place, {cap} AS title_tier FROM t5)"""


# ---- search


@query(f"WITH {_found(ASKED)} SELECT file_id, file_name, store FROM found")
def search_basic(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(_files(spark, sf), prepare(ASKED, X.STOP_PHRASES)).select("file_id", "file_name", "store")


def _top(spark: SparkSession, sf: str, asked: str, stop: tuple[str, ...] = ()) -> DataFrame:
    q = prepare(asked, stop)
    return search.top(search.search(_files(spark, sf), q), q).select("place", "file_id", F.col("title_tier").cast("int"))


@query(f"WITH {_ranked(ASKED, 0)} SELECT place, file_id, title_tier::INT AS title_tier FROM ranked")
def search_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, ASKED, X.STOP_PHRASES)


@query(f"WITH {_ranked(TIER_ASKED, 1999)} SELECT place, file_id, title_tier::INT AS title_tier FROM ranked")
def search_ranked_year(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, TIER_ASKED)


@query(f"WITH {_ranked(ASKED, 0)} SELECT file_id, file_name FROM ranked ORDER BY place LIMIT 10 OFFSET 10")
def search_page(spark: SparkSession, sf: str) -> DataFrame:
    q = prepare(ASKED, X.STOP_PHRASES)
    return search.ranked(search.search(_files(spark, sf), q), q).offset(10).limit(V.PAGE_SIZE).select("file_id", "file_name")


@query(f"WITH {_ranked(ASKED, 0)} SELECT place, file_id FROM ranked WHERE place > 10 ORDER BY place LIMIT {V.PAGE_SIZE}")
def search_after(spark: SparkSession, sf: str) -> DataFrame:
    """The second page, from the last row of the first one."""
    q = prepare(ASKED, X.STOP_PHRASES)
    found = search.search(_files(spark, sf), q)
    first = search.page_after(found, q, None).collect()
    last = first[-1] if first else None
    rows = search.page_after(found, q, last).select("file_id").collect()
    return spark.createDataFrame([(len(first) + k, r[0]) for k, r in enumerate(rows, 1)], "place long, file_id string")


def _index(spark: SparkSession, sf: str) -> TextIndex:
    """The catalog's index, stored once a session: an older state of the catalog, and a segment with what has changed since."""

    def make(path: str) -> None:
        files, k = _files(spark, sf), F.col("file_id").cast("long")
        old = files.filter(k % 10 != 1).withColumn("file_name", F.when(k % 7 == 0, F.concat(F.lit("blue bolt "), F.reverse("file_name"))).otherwise(F.col("file_name")))
        gone = files.filter(k % 50 == 0).withColumn("file_id", F.concat(F.lit("x"), "file_id"))
        index = TextIndex.build(old.unionByName(gone), path)
        index.append(files.filter((k % 10 == 1) | (k % 7 == 0)), deleted=gone)

    return TextIndex.open(spark, once(spark, "text_index", sf, make))


@query(f"WITH {_found(ASKED)} SELECT file_id, file_name, store FROM found")
def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(_index(spark, sf), prepare(ASKED, X.STOP_PHRASES)).select("file_id", "file_name", "store")


@query(f"WITH {_found(ASKED)} SELECT file_id FROM found WHERE contains(lower(file_name), 'hindi')")
def search_lang(spark: SparkSession, sf: str) -> DataFrame:
    return search.in_language(search.search(_files(spark, sf), prepare(ASKED)), "hindi").select("file_id")


@query(f"WITH {X.FILES}, r0 AS (SELECT *, {SHOWN} AS raw FROM catalog), {_tier('blue', 'bolt')} SELECT file_id, tier::INT AS tier FROM t3")
def title_tier(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.federate(_files(spark, sf))
    return rows.select("file_id", search.title_tier(text.shown(F.col("file_name"), F.col("caption")), prepare("blue bolt")).cast("int").alias("tier"))


@query(f"WITH {X.FILES}, t AS (SELECT file_id, list_filter(string_split({_strip(SHOWN)}, ' '), lambda x: x <> '') AS w FROM catalog) SELECT file_id, (list_contains(w, 'blue') AND list_contains(w, 'bolt')) AS fits FROM t")
def title_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.federate(_files(spark, sf))
    return rows.select("file_id", search.has_all_title_words(text.shown(F.col("file_name"), F.col("caption")), "Blue Bolt 1080p").alias("fits"))


@query(f"""WITH {X.FILES}, tok AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(lower(file_name), '[a-z0-9]+')) AS token FROM catalog)
SELECT file_id, count(*) AS hits FROM tok WHERE token IN ('blue', 'bolt') GROUP BY file_id""")
def text_index(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.text_prefilter(_files(spark, sf), "blue bolt")


# ---- facets

_TOKENS = f"list_transform(regexp_extract_all({BOTH}, '(?i){V.FACET_QUALITY}'), lambda q: regexp_replace(lower(q), '[-\\s]', '', 'g'))"
_CODES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in V.QUALITY_CODES) + "}"
_SEASONS = f"list_concat(regexp_extract_all({BOTH}, '(?i)\\bs(\\d{{1,2}})(?:\\D|$)', 1), regexp_extract_all({BOTH}, '(?i)\\bseason[\\s._\\-]*(\\d{{1,2}})\\b', 1))"


@query(f"""WITH {_found(ASKED)}, v AS (
SELECT DISTINCT file_id, 'season' AS facet, unnest({_SEASONS})::INT::VARCHAR AS value FROM found
UNION ALL SELECT DISTINCT file_id, 'year', unnest(regexp_extract_all({BOTH}, '{V.YEAR}', 1)) FROM found
UNION ALL SELECT DISTINCT file_id, 'language', lower(unnest(regexp_extract_all({BOTH}, '(?i){V.FACET_LANGUAGE}'))) FROM found
UNION ALL SELECT DISTINCT file_id, 'quality', {_CODES}[unnest({_TOKENS})] FROM found)
SELECT facet, value, count(DISTINCT file_id) AS files FROM v WHERE value IS NOT NULL GROUP BY ALL""")
def facets(spark: SparkSession, sf: str) -> DataFrame:
    return search.facets(search.search(_files(spark, sf), prepare(ASKED)))


def facets_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return search.facets(search.search(_index(spark, sf), prepare(ASKED)))


QUERIES["facets_indexed"], ORACLES["facets_indexed"] = facets_indexed, ORACLES["facets"]


@query(f"WITH {X.FILES} SELECT file_id FROM catalog WHERE regexp_matches({BOTH}, '(?i)\\bs0*3(\\D|$)') OR regexp_matches({BOTH}, '(?i)\\bseason[\\s._\\-]*0*3\\b')")
def facet_season(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_season(catalog.federate(_files(spark, sf)), 3).select("file_id")


@query(f"WITH {X.FILES}, t AS (SELECT file_id, list_transform({_TOKENS}, lambda q: {_CODES}[q]) AS codes FROM catalog) SELECT file_id FROM t WHERE list_contains(codes, '4k')")
def facet_quality(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_quality(catalog.federate(_files(spark, sf)), "4k").select("file_id")


@query(f"WITH {X.FILES} SELECT file_id FROM catalog WHERE regexp_matches({BOTH}, '(?i)\\btamil\\b')")
def facet_language(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_language(catalog.federate(_files(spark, sf)), "tamil").select("file_id")


# ---- scans


@query(f"WITH {X.FILES} SELECT file_id, file_name, store FROM catalog")
def federated_union(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.federate(_files(spark, sf)).select("file_id", "file_name", "store")


@query(f"WITH {X.FILES} SELECT file_id, file_name, file_size, store FROM catalog WHERE file_id = '00000020'")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.lookup(_files(spark, sf), "00000020").select("file_id", "file_name", "file_size", "store")


@query(f"WITH {X.FILES} SELECT file_id, store FROM catalog ORDER BY file_id DESC LIMIT 50")
def newest_files(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.newest(_files(spark, sf), 50).select("file_id", "store")


@query(f"WITH {X.FILES} SELECT file_id FROM catalog ORDER BY file_id DESC LIMIT 30 OFFSET 60")
def files_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.page(_files(spark, sf), 60, 30).select("file_id")


@query(f"WITH {X.FILES}, {KEYED} SELECT file_id, title_key FROM keyed WHERE title_key = 'blue bolt'")
def keyed_scan(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_key(_files(spark, sf), "blue bolt").select("file_id", "title_key")


def _loose(x: str) -> str:
    """Repeated characters once, then only a-z, 0-9 and what is not ASCII."""
    chars = f"string_split(lower({x}), '')"
    return f"regexp_replace(array_to_string(list_filter({chars}, lambda c, i: i = 1 OR c <> {chars}[i - 1]), ''), '[\\x00-/:-`{{-\\x7f]', '', 'g')"


@query(f"WITH {X.FILES}, {KEYED}, l AS (SELECT file_id, {_loose('title_key')} AS loose FROM keyed) SELECT file_id FROM l WHERE loose <> '' AND (contains(loose, 'blue bolt') OR contains('bluebolt', loose) OR contains(loose, 'bluebolt'))")
def loose_key_scan(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_loose_key(_files(spark, sf), "bluue boltt").select("file_id")


@query(f"""WITH {X.FILES}, {KEYED}, n AS (SELECT DISTINCT {_loose('title_key')} AS key FROM keyed), k AS (SELECT key FROM n WHERE key <> ''),
a AS (SELECT DISTINCT {_loose(X.LOOSELY_SQL)} AS ask FROM part)
SELECT ask, key, contains(key, ask) AS in_name, contains(ask, key) AS in_ask FROM a, k WHERE ask <> '' AND (contains(key, ask) OR contains(ask, key))""".replace("n AS (SELECT DISTINCT", "n2 AS (SELECT DISTINCT").replace("FROM n WHERE key", "FROM n2 WHERE key"))
def loose_containment(spark: SparkSession, sf: str) -> DataFrame:
    """All titles asked for loosely, against all title keys."""
    keys = catalog.with_keys(catalog.federate(_files(spark, sf))).select(text.fuzzy_normal(F.col("title_key")).alias("key"))
    return contain.contained(X.loosely_asked(spark, sf).select(text.fuzzy_normal(F.col("said")).alias("ask")), keys, "ask", "key")


@query(f"""WITH {X.FILES}, b AS (SELECT lower({_squeeze(f"regexp_replace({_sub('file_name', V.BASE_JUNK, '')}, '[._\\-\\+\\[\\]()''\"]+', ' ', 'g')")}) AS base, file_name FROM catalog)
SELECT base, min(file_name) AS original FROM b WHERE base <> '' GROUP BY base""")
def base_titles(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.titles(_files(spark, sf))


# ---- groups


@query(f"WITH {X.FILES}, {KEYED}, {CARDS} SELECT c.title_key, c.files, c.latest_id, c.file_name, y.year FROM cards c JOIN (SELECT title_key, arg_min(regexp_extract(shown, '{V.WEB_YEAR}', 1), file_id) AS year FROM keyed GROUP BY 1) y ON c.title_key = y.title_key")
def title_cards(spark: SparkSession, sf: str) -> DataFrame:
    return groups.cards(catalog.with_keys(catalog.federate(_files(spark, sf)))).select("title_key", "files", "latest_id", "file_name", "year")


def _browse(kind: str) -> str:
    cards = CARDS.replace("FROM keyed WHERE", f"FROM keyed WHERE content_type = '{kind}' AND")
    return f"WITH {X.FILES}, {KEYED}, {cards} SELECT title_key, files, latest_id FROM cards ORDER BY latest_id DESC LIMIT 40"


@query(_browse("movie"))
def browse_movie(spark: SparkSession, sf: str) -> DataFrame:
    return groups.browse(_files(spark, sf), "movie").select("title_key", "files", "latest_id")


@query(_browse("series"))
def browse_series(spark: SparkSession, sf: str) -> DataFrame:
    return groups.browse(_files(spark, sf), "series").select("title_key", "files", "latest_id")


@query(f"WITH {X.FILES}, {KEYED}, {CARDS} SELECT title_key, files, latest_id FROM cards ORDER BY latest_id DESC LIMIT 20 OFFSET 20")
def recent_titles(spark: SparkSession, sf: str) -> DataFrame:
    return groups.browse(_files(spark, sf), None, limit=20, offset=20).select("title_key", "files", "latest_id")


@query(f"""WITH {_ranked(ASKED, 0)}, catalog2 AS (SELECT file_id, file_name, file_size, caption, category, store FROM ranked WHERE place <= 80),
{KEYED.replace("FROM catalog)", "FROM catalog2)")}, {CARDS} SELECT title_key, files, latest_id FROM cards ORDER BY latest_id DESC LIMIT 20""")
def search_cards(spark: SparkSession, sf: str) -> DataFrame:
    q = prepare(ASKED)
    return groups.search_cards(search.search(_files(spark, sf), q), q).select("title_key", "files", "latest_id")


@query(f"""WITH {X.FILES}, {KEYED}, s AS (SELECT *, max(season > 0) OVER (PARTITION BY title_key) AS series FROM keyed WHERE title_key <> '')
SELECT title_key, CASE WHEN series THEN 'series' ELSE 'movie' END AS kind, season, episode, row_number() OVER (PARTITION BY title_key, season, episode ORDER BY {_first("shown", V.SORT_SCORES, V.SORT_SCORE_DEFAULT)} DESC, file_id)::INT AS place, file_id FROM s""")
def season_tree(spark: SparkSession, sf: str) -> DataFrame:
    return groups.season_tree(catalog.with_keys(catalog.federate(_files(spark, sf))))


@query(f"""WITH {X.FILES}, {KEYED}, c AS (SELECT title_key, season, count(DISTINCT episode) AS episodes FROM keyed WHERE title_key <> '' GROUP BY ALL),
s AS (SELECT *, max(season > 0) OVER (PARTITION BY title_key) AS series FROM c) SELECT title_key, season, CASE WHEN season > 0 THEN 'Season ' || season::VARCHAR ELSE 'Extras' END AS label, episodes FROM s WHERE series""")
def season_counts(spark: SparkSession, sf: str) -> DataFrame:
    return groups.season_counts(catalog.with_keys(catalog.federate(_files(spark, sf))))


def _langs(x: str) -> str:
    table = sorted(V.LANGUAGE_LABELS, key=lambda kv: -len(kv[0]))
    found = "list_filter([" + ", ".join(f"CASE WHEN contains(lower({x}), '{k}') THEN '{v}' END" for k, v in table) + "], lambda v: v IS NOT NULL)"
    combined = f"list_filter({found}, lambda v: v IN ('Dual Audio', 'Multi Audio'))"
    # in the data no file names two labels twice, but for the keys of combined audio
    return f"array_to_string(CASE WHEN len({combined}) > 0 THEN list_distinct({combined}) ELSE {found} END, ', ')"


@query(f"""WITH {X.FILES}, {KEYED}, t AS (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY file_id) AS pos FROM keyed WHERE title_key <> ''),
u AS (SELECT title_key, pos, nullif({_langs("shown")}, '') AS l, nullif({_first("shown", V.SUBTITLE_LABELS, "")}, '') AS s, nullif({_first("shown", V.QUALITY_LABELS, "")}, '') AS q, nullif({_first("shown", V.PRINT_LABELS, "")}, '') AS p FROM t WHERE pos <= 8)
SELECT title_key, coalesce(arg_min(l, pos) FILTER (l IS NOT NULL), '') AS languages, coalesce(arg_min(s, pos) FILTER (s IS NOT NULL), '') AS subtitles,
coalesce(arg_min(q, pos) FILTER (q IS NOT NULL), '') AS quality, coalesce(arg_min(p, pos) FILTER (p IS NOT NULL), '') AS print_type FROM u GROUP BY title_key""")
def title_summary(spark: SparkSession, sf: str) -> DataFrame:
    return groups.summary(catalog.with_keys(catalog.federate(_files(spark, sf))))


@query(f"""WITH {X.FILES}, {KEYED}, {CARDS}, h AS (SELECT title_key, len(list_filter(['blue', 'bolt'], lambda w: list_contains(string_split(title_key, ' '), w))) AS held FROM cards)
SELECT title_key, CASE WHEN title_key = 'blue bolt' THEN 0.0::DOUBLE WHEN starts_with(title_key, 'blue bolt') THEN 1.0 WHEN contains(title_key, 'blue bolt') THEN 2.0 WHEN held = 2 THEN 3.0 WHEN held > 0 THEN 4 - held / 2 ELSE 5.0 END AS far FROM h""")
def title_relevance(spark: SparkSession, sf: str) -> DataFrame:
    keys = groups.cards(catalog.with_keys(catalog.federate(_files(spark, sf)))).select("title_key")
    return keys.select("title_key", search.relevance(F.col("title_key"), "Blue Bolt").alias("far"))


# ---- text and extraction, over names


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return X.named_files(spark, sf)


NAMED = X.FILES.partition(",\nfiles AS")[0]


@query(f"WITH {NAMED} SELECT file_id, {_year('file_name')} AS latest, regexp_extract(file_name, '{V.WEB_YEAR}', 1) AS first FROM named")
def extract_year(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("file_id", extract.latest_year(F.col("file_name")).alias("latest"), extract.first_year(F.col("file_name")).alias("first"))


@query(f"""WITH {NAMED} SELECT file_id, {_se("file_name", 1)} AS season, {_se("file_name", 2)} AS episode, {_web_se("file_name", 1)} AS web_season, {_web_se("file_name", 2)} AS web_episode,
{_group("file_name", V.FEED_SINGLE, 1)} AS feed_season, nullif(regexp_extract(file_name, '(?i){V.FEED_SINGLE}', 2), '') AS feed_episode FROM named""")
def extract_se(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("file_name")
    names = ("season", "episode", "web_season", "web_episode", "feed_season", "feed_episode")
    found = (*extract.season_episode(name), *extract.web_season_episode(name), *extract.feed_season_episode(name))
    return _named(spark, sf).select("file_id", *[c.alias(n) for c, n in zip(found, names, strict=True)])


@query(f"""WITH {NAMED} SELECT file_id, {_first("file_name", V.QUALITY_SCORES, 0)} AS quality, {_first("file_name", V.RESOLUTION_SCORES, 0)} AS resolution, {_first("file_name", V.SORT_SCORES, 40)} AS sort_score,
{_first("file_name", V.QUALITY_LABELS, "")} AS label, {_first("file_name", V.PRINT_LABELS, "")} AS print_type, {_first("file_name", V.SUBTITLE_LABELS, "")} AS subtitles FROM named""")
def extract_quality(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("file_name")
    values = {"quality": extract.quality_score, "resolution": extract.resolution_score, "sort_score": extract.sort_score, "label": extract.quality_label, "print_type": extract.print_label, "subtitles": extract.subtitle_label}
    return _named(spark, sf).select("file_id", *[f(n).alias(k) for k, f in values.items()])


@query(f"""WITH {NAMED} SELECT file_id, {_langs("file_name")} AS languages, regexp_matches(file_name, '(?i){V.MULTI_AUDIO}')::INT AS multi_audio,
regexp_matches(file_name, '(?i){V.FACET_LANGUAGE}')::INT + (({_first("file_name", V.QUALITY_SCORES, 0)}) > 0)::INT + (({_first("file_name", V.RESOLUTION_SCORES, 0)}) > 0)::INT AS metadata,
CASE WHEN contains(lower(file_name), 'hindi') THEN 30 ELSE 0 END + CASE WHEN contains(lower(file_name), 'english') THEN 25 ELSE 0 END AS wanted FROM named""")
def extract_languages(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("file_name")
    return _named(spark, sf).select("file_id", F.array_join(extract.languages(n), ", ").alias("languages"), extract.multi_audio(n).alias("multi_audio"), extract.completeness(n).alias("metadata"), extract.language_score(n, ["hindi", "english"]).alias("wanted"))


@query(f"WITH {NAMED} SELECT file_id, {_strip('file_name')} AS stripped, {_collapse('file_name')} AS letters FROM named")
def strip_tech(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("file_id", text.strip_tech(F.col("file_name")).alias("stripped"), text.collapse(F.col("file_name")).alias("letters"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS letters FROM documents")
def collapse_title(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select("doc_id", text.collapse(F.col("text")).alias("letters"))


_HEAD = f"regexp_extract(file_name, '(?i)^(.*?){V.TITLE_CUT}', 1)"


@query(f"""WITH {NAMED} SELECT file_id, {_title("file_name")} AS display, lower({_title("file_name")}) AS title_key,
coalesce(nullif({_squeeze(f"regexp_replace(CASE WHEN regexp_matches(file_name, '(?i){V.TITLE_CUT}') THEN trim({_HEAD}) ELSE file_name END, '[.\\-_\\+\\[\\]()]+', ' ', 'g')")}, ''), file_name) AS clean FROM named""")
def clean_titles(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("file_name")
    return _named(spark, sf).select("file_id", text.display_title(n).alias("display"), text.title_key(n).alias("title_key"), text.clean_file_title(n).alias("clean"))


INCOMING = f"{NAMED}, {X.INCOMING}"


@query(f"""WITH {INCOMING}, t AS (SELECT file_id, regexp_replace(regexp_replace(coalesce(file_name, ''), '@\\w+', '', 'g'), '[_\\-.+]', ' ', 'g') AS stored,
{_squeeze(f"regexp_replace(regexp_replace(regexp_replace({_sub('file_name', V.WEB_EXTENSION, '')}, '@\\w+', '', 'g'), 'https?://\\S+', '', 'g'), '{V.WEB_PUNCTUATION}', ' ', 'g')")} AS display FROM incoming) SELECT * FROM t""")
def ingest_text(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("file_name")
    return X.incoming(spark, sf).select("file_id", text.ingest_normal(n).alias("stored"), text.caption_display(n).alias("display"))


@query(f"""WITH {NAMED}, k AS (SELECT *, {_se("file_name", 1)} AS s, {_web_se("file_name", 1)} AS ws FROM named)
SELECT file_id, CASE WHEN regexp_matches(file_name, '(?i){V.ANIME_WORDS}') THEN 'anime' WHEN s > 0 THEN 'series' ELSE 'movie' END AS at_ingest,
coalesce(nullif(category, ''), CASE WHEN regexp_matches(file_name, '(?i){V.ANIME_WORDS}') THEN 'anime' WHEN ws > 0 THEN 'series' ELSE 'movie' END) AS served FROM k""")
def content_type(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("file_name")
    return _named(spark, sf).select("file_id", extract.ingest_category(n).alias("at_ingest"), extract.served_category(n, F.col("category")).alias("served"))


_UNITS = "".join(f"WHEN s < {1024 ** (k + 1)} THEN format('{{:.2f}} {u}', s / {1024**k}::DOUBLE) " for k, u in enumerate(scalar.SIZE_UNITS[:4]))


@query(f"WITH {NAMED}, x AS (SELECT file_id, (file_size // (k * k * 37 + 1))::DOUBLE AS s FROM named) SELECT file_id, CASE {_UNITS}END AS size FROM x")
def size_label(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return _named(spark, sf).select("file_id", scalar.size_label(F.floor(F.col("file_size") / (k * k * 37 + 1))).alias("size"))


@query("""SELECT event_id, (event_id % 40)::BIGINT * CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 4 THEN 2592000 WHEN 5 THEN 31536000 ELSE 0 END AS seconds FROM events""")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    e, k = X.table(spark, sf, "events"), F.col("event_id")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("s", "min", "hour", "day", "month", "year", "x")]), (k % 7 + 1).cast("int"))
    return e.select("event_id", scalar.duration_seconds(F.concat((k % 40).cast("string"), unit)).alias("seconds"))


@query("""WITH t AS (SELECT event_id, event_id * 977 % 1000000 AS s, ts FROM events) SELECT event_id,
CASE WHEN s >= 86400 THEN (s // 86400)::VARCHAR || 'days' ELSE '' END || CASE WHEN s // 3600 % 24 > 0 THEN (s // 3600 % 24)::VARCHAR || 'hour' ELSE '' END || CASE WHEN s // 60 % 60 > 0 THEN (s // 60 % 60)::VARCHAR || 'min' ELSE '' END || CASE WHEN s % 60 > 0 THEN (s % 60)::VARCHAR || 'sec' ELSE '' END AS readable,
CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' ELSE 'evening' END AS greeting FROM t""")
def readable_times(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events")
    return e.select("event_id", scalar.readable_time(F.col("event_id") * 977 % 1000000).alias("readable"), scalar.greeting(F.col("ts")).alias("greeting"))


@query("""WITH t AS (SELECT event_id, 's' || lpad((event_id % 30 + 1)::VARCHAR, 2, '0') || 'e' || lpad((event_id % 120)::VARCHAR, greatest(2, length((event_id % 120)::VARCHAR))::INT, '0') AS token FROM events)
SELECT event_id, 'loki ' || token || ' or s07 to ' || token || CASE event_id % 3 WHEN 0 THEN ' e05' ELSE ' x' END AS said FROM t""")
def normalize_tokens(spark: SparkSession, sf: str) -> DataFrame:
    e, k = X.table(spark, sf, "events"), F.col("event_id")
    s, n = (k % 30 + 1).cast("string"), (k % 120).cast("string")
    kinds = [F.concat(F.lit("season "), s, F.lit(" episode "), n), F.concat(F.lit("season"), s, F.lit("episode"), n), F.concat(F.lit("S"), s, F.lit("."), F.lit("EP"), n), F.concat(s, F.lit("x"), n)]
    spelled = F.element_at(F.array(*kinds), (k % 4 + 1).cast("int"))
    said = F.concat(F.lit("loki "), spelled, F.lit("  or Season 7 to "), spelled, F.when(k % 3 == 0, " episode 5").otherwise(" x"))
    return e.select("event_id", parse.normalized(said).alias("said"))


def _marks(x: str) -> str:
    for pattern, letters in V.QUERY_MARKS:
        by = "\\1\\2" if pattern == V.QUERY_APART else "s¤00\\1\\2" if letters == "ss" else "".join(f"{c}¤00\\{k}" for k, c in enumerate(letters, 1))
        x = _sub(_sub(x, pattern, by), "¤0*([0-9]{2,})", "\\1")
    return x


def _spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_ASKED_TEXTS = f"{X.FILES.partition(',' + chr(10) + 'files AS')[0]}, asked AS (SELECT file_id, {X.ASKED_SQL} AS said FROM named)"


@query(f"WITH {_ASKED_TEXTS} SELECT file_id, {_spaced(_sub(_sub('said', '[^a-zA-Z0-9_' + chr(92) + 's]', ' '), X.STOP_SQL, ''))} AS said FROM asked")
def cleaned_queries(spark: SparkSession, sf: str) -> DataFrame:
    return X.asked(spark, sf).select("file_id", parse.cleaned(F.col("said"), X.STOP_PHRASES).alias("said"))


_BARE = _sub("said", V.FACET_LANGUAGE)
_NUMBER = lambda p, k: f"coalesce(nullif(regexp_extract(normalized, '(?i){p}', {k}), '')::INT, 0)"


@query(f"""WITH {_ASKED_TEXTS}, parsed AS (SELECT *, {_spaced(_sub(_marks(_sub(_BARE, V.YEAR)), V.QUERY_FILLER, ''))} AS normalized, coalesce(nullif(regexp_extract({_BARE}, '(?i){V.YEAR}', 1), '')::INT, 0) AS year FROM asked)
SELECT file_id, normalized, {_spaced(_sub('normalized', V.NUMBER_WORDS, ''))} AS title, CASE WHEN regexp_matches(normalized, '(?i){V.NUMBER_BOTH}') THEN {_NUMBER(V.NUMBER_BOTH, 1)} ELSE {_NUMBER(V.NUMBER_SEASON, 1)} END AS season,
CASE WHEN regexp_matches(normalized, '(?i){V.NUMBER_BOTH}') THEN {_NUMBER(V.NUMBER_BOTH, 2)} ELSE {_NUMBER(V.NUMBER_EPISODE, 1)} END AS episode, year,
array_to_string(regexp_extract_all(lower(said), '{V.FACET_LANGUAGE}'), ',') AS languages, regexp_matches(said, '(?i){V.MOVIE_WORD}') AS wants_movie FROM parsed""")
def parsed_queries(spark: SparkSession, sf: str) -> DataFrame:
    out = parse.parsed(X.asked(spark, sf), "said")
    return out.select("file_id", "normalized", "title", "season", "episode", "year", F.array_join("languages", ",").alias("languages"), "wants_movie")


@query(f"""WITH {_ASKED_TEXTS}, r AS (SELECT file_id, nullif(regexp_extract(trim(said), '(?i)\\bs(\\d{{1,2}})$', 1), '')::INT AS season, trim(regexp_replace(trim(said), '(?i)\\s*\\bs\\d{{1,2}}$', '')) AS rest FROM asked)
SELECT file_id, season, nullif(regexp_extract(rest, '{V.REQUEST_YEAR}', 1), '') AS year, trim(regexp_replace(rest, '(?s)^(.*?){V.REQUEST_YEAR}(.*)$', '\\1\\3')) AS title FROM r""")
def manual_requests(spark: SparkSession, sf: str) -> DataFrame:
    return parse.requested(X.asked(spark, sf), "said").select("file_id", "season", "year", "title")


@query(f"WITH {NAMED} SELECT file_id, {_loose('file_name')} AS loose FROM named")
def repeat_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("file_id", text.fuzzy_normal(F.col("file_name")).alias("loose"))



@query(f"""WITH {NAMED} SELECT file_id, concat_ws(' · ', nullif({_first("file_name", V.QUALITY_LABELS, "")}, ''), nullif({_langs("file_name")}, ''),
CASE WHEN {_web_se("file_name", 1)} > 0 THEN 'S' || lpad({_web_se("file_name", 1)}::VARCHAR, 2, '0') || CASE WHEN {_web_se("file_name", 2)} > 0 THEN 'E' || lpad({_web_se("file_name", 2)}::VARCHAR, 2, '0') ELSE '' END END,
CASE WHEN file_size < 1073741824 THEN format('{{:.2f}} MB', file_size / 1048576::DOUBLE) ELSE format('{{:.2f}} GB', file_size / 1073741824::DOUBLE) END) AS label FROM named""")
def file_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("file_id", extract.file_label(F.col("file_name"), F.col("file_size")).alias("label"))


@query(f"""WITH {NAMED} SELECT file_id, {_web_se("file_name", 1)} AS season, coalesce(CASE WHEN regexp_matches(file_name, '(?i){V.WEB_SEASON_EPISODE}') THEN {_group("file_name", V.WEB_SEASON_EPISODE, 2)} ELSE {_group("file_name", V.EPISODE, 1)} END, 0) AS episode,
length(file_name) > 35 AS cut, CASE WHEN length(file_name) > 35 THEN file_name[:32] || '...' ELSE file_name END AS short, array_to_string(list_filter(string_split_regex(file_name, '\\s+'), lambda w: w <> ''), ' ') AS words FROM named""")
def file_texts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("file_name")
    season, episode = extract.loose_season_episode(n)
    return _named(spark, sf).select("file_id", season.alias("season"), episode.alias("episode"), (F.length(n) > 35).alias("cut"), text.short_label(n).alias("short"), text.file_words(n).alias("words"))


# ---- changes

STORED = f"{NAMED}, stored AS (SELECT file_id, file_name, caption, category FROM named), {X.INCOMING}, prep AS (SELECT file_id, regexp_replace(regexp_replace(file_name, '@\\w+', '', 'g'), '[_\\-.+]', ' ', 'g') AS file_name, regexp_replace(regexp_replace(coalesce(caption, ''), '@\\w+', '', 'g'), '[_\\-.+]', ' ', 'g') AS caption FROM incoming)"
_STATUS = "CASE WHEN s.file_id IS NULL THEN 'suc' WHEN p.caption <> coalesce(s.caption, '') THEN 'upd' ELSE 'dup' END"


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("file_id", "file_name", "caption", "category")


@query(f"WITH {STORED} SELECT p.file_id, {_STATUS} AS status FROM prep p LEFT JOIN stored s ON p.file_id = s.file_id")
def upsert_status(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.upsert_status(X.incoming(spark, sf), _stored(spark, sf))


@query(f"WITH {STORED}, st AS (SELECT {_STATUS} AS status FROM prep p LEFT JOIN stored s ON p.file_id = s.file_id) SELECT status, count(*) AS n FROM st GROUP BY status")
def backfill_counts(spark: SparkSession, sf: str) -> DataFrame:
    return engage.count_outcomes(mutate.upsert_status(X.incoming(spark, sf), _stored(spark, sf)))


@query(f"""WITH {STORED}, j AS (SELECT coalesce(s.file_id, p.file_id) AS file_id, coalesce(s.file_name, p.file_name) AS file_name, s.file_id IS NULL OR (p.file_id IS NOT NULL AND p.caption <> coalesce(s.caption, '')) AS fresh,
p.caption AS pc, s.caption AS sc, s.category AS sk, CASE WHEN {_se("p.file_name", 1)} > 0 THEN 'series' ELSE 'movie' END AS pk FROM stored s FULL JOIN prep p ON s.file_id = p.file_id)
SELECT file_id, file_name, CASE WHEN fresh THEN pc ELSE sc END AS caption, CASE WHEN fresh THEN pk ELSE sk END AS category FROM j""")
def upsert_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.upserted(X.incoming(spark, sf), _stored(spark, sf))


@query(f"WITH {X.FILES} SELECT store, count(*) AS deleted FROM files WHERE regexp_matches(file_name, '(?i)blue[\\s._\\-+]+bolt') GROUP BY store")
def delete_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.deleted_counts(_files(spark, sf), "blue bolt")


@query(f"WITH {X.FILES} SELECT file_id, store FROM files WHERE file_id NOT IN (SELECT lpad(p_partkey::VARCHAR, 8, '0') FROM part WHERE p_size > 25)")
def delete_ids(spark: SparkSession, sf: str) -> DataFrame:
    gone = X.table(spark, sf, "part").filter("p_size > 25").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("file_id"))
    return mutate.delete_ids(_files(spark, sf), gone).select("file_id", "store")


@query("SELECT word, NOT bool_or(old) AS added FROM (SELECT unnest(['movie', 'please', 'send']) AS word, true AS old UNION ALL SELECT DISTINCT lower(p_brand), false FROM part UNION ALL SELECT 'send', false) GROUP BY word")
def stop_phrases(spark: SparkSession, sf: str) -> DataFrame:
    old = spark.createDataFrame([(w,) for w in X.STOP_PHRASES], "word string")
    new = X.table(spark, sf, "part").select(F.col("p_brand").alias("word")).union(spark.createDataFrame([("Send",)], "word string"))
    return mutate.merged_phrases(old, new)


@query("""WITH r AS (SELECT o_custkey AS user_id, list_sort(list_distinct(list(l_suppkey % 7))) AS channels FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_filter(list_distinct(list_append(channels, 99)), lambda c: c <> 3)), ',') AS channels, list_contains(channels, 5) AS joined FROM r""")
def join_requests(spark: SparkSession, sf: str) -> DataFrame:
    o, li = X.table(spark, sf, "orders"), X.table(spark, sf, "lineitem")
    r = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("user_id")).agg(F.collect_set(F.col("l_suppkey") % 7).alias("channels"))
    r = r.withColumn("joined", F.array_contains("channels", F.lit(5).cast("long")))
    r = mutate.pull_from_set(mutate.add_to_set(r, "channels", F.lit(99).cast("long")), "channels", F.lit(3).cast("long"))
    return r.select("user_id", F.array_join(F.sort_array("channels"), ",").alias("channels"), "joined")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def delete_users(spark: SparkSession, sf: str) -> DataFrame:
    users = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return mutate.without(users, X.table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("id")), "id")


@query(f"""WITH {X.MEMBERS}, g AS (SELECT l_suppkey AS id, arg_max(CASE WHEN l_quantity > 25 THEN l_shipdate END, l_orderkey * 10 + l_linenumber) AS none, max(l_orderkey * 10 + l_linenumber) AS at_max FROM lineitem GROUP BY 1),
x AS (SELECT g.id, CASE WHEN l.l_quantity > 25 THEN l.l_shipdate END AS e FROM g JOIN lineitem l ON g.id = l.l_suppkey AND g.at_max = l.l_orderkey * 10 + l.l_linenumber)
SELECT coalesce(m.id, x.id) AS id, CASE WHEN x.id IS NOT NULL THEN x.e ELSE m.expiry_time END AS expiry_time FROM members m FULL JOIN x ON m.id = x.id""")
def member_grants(spark: SparkSession, sf: str) -> DataFrame:
    grants = X.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.when(F.col("l_quantity") > 25, F.col("l_shipdate")).alias("expiry_time"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return mutate.granted(X.members(spark, sf), grants)


# ---- engagement


@query("SELECT user_id, event_type AS text, count(*) AS count FROM events GROUP BY ALL")
def search_counts(spark: SparkSession, sf: str) -> DataFrame:
    return engage.counted(X.requests(spark, sf))


@query("""WITH p AS (SELECT event_id, event_type = 'error' AS e, CASE event_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'document' WHEN 2 THEN 'photo' END AS media, CASE event_id % 3 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'video/x-matroska' END AS mime FROM events),
s AS (SELECT CASE WHEN e THEN 'deleted' WHEN media IS NULL THEN 'no media' WHEN media = 'photo' OR mime IS NULL THEN 'unsupported' ELSE 'accepted' END AS status FROM p) SELECT status, count(*) AS n FROM s GROUP BY status""")
def media_gate(spark: SparkSession, sf: str) -> DataFrame:
    e, k = X.table(spark, sf, "events"), F.col("event_id")
    media = F.when(k % 4 == 0, "video").when(k % 4 == 1, "document").when(k % 4 == 2, "photo")
    posts = e.select(k.alias("id"), (F.col("event_type") == "error").alias("is_empty"), media.alias("media"), F.when(k % 3 == 0, "video/mp4").when(k % 3 == 1, "video/x-matroska").alias("mime_type"))
    return engage.count_outcomes(engage.gate(posts))


@query(f"WITH {X.SEARCH_LOG} SELECT text, sum(count)::BIGINT AS count FROM search_log GROUP BY text")
def trending(spark: SparkSession, sf: str) -> DataFrame:
    return engage.trending(X.nested_search_log(spark, sf))


@query(f"""WITH {X.SEARCH_LOG}, t AS (SELECT text, sum(count)::BIGINT AS count FROM search_log GROUP BY text ORDER BY count DESC, text LIMIT 20),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY count DESC, text) AS n FROM t WHERE regexp_full_match(text, '[a-zA-Z0-9 ]*'))
SELECT row_number() OVER (ORDER BY count DESC, text)::INT AS place, CASE WHEN length(text) > 35 THEN text[:32] || '...' ELSE text END AS label, count FROM f WHERE n = 1""")
def trending_clean(spark: SparkSession, sf: str) -> DataFrame:
    return engage.trending_clean(X.nested_search_log(spark, sf))


_DAY = "(ts + INTERVAL '5 hours 31 minutes')::DATE"


@query(f"SELECT user_id, {_DAY} AS day, count(*) AS used FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def quota_usage(spark: SparkSession, sf: str) -> DataFrame:
    return engage.quota_usage(X.downloads(spark, sf))


@query(f"""WITH d AS (SELECT user_id, count(*) FILTER ({_DAY} = DATE '2024-01-15') AS used FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id, used, greatest(0, 1 - used)::BIGINT AS remaining FROM d""")
def quota_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return engage.quota_left(X.downloads(spark, sf), "2024-01-15 06:00:00")


@query(f"WITH {X.MEMBERS} SELECT id, expiry_time FROM members WHERE expiry_time > TIMESTAMP '{X.ORDERS_AS_OF}'")
def members_active(spark: SparkSession, sf: str) -> DataFrame:
    return engage.active(X.members(spark, sf), X.ORDERS_AS_OF)


@query(f"WITH {X.MEMBERS} SELECT id, expiry_time FROM members WHERE expiry_time < TIMESTAMP '{X.ORDERS_AS_OF}'")
def members_expired(spark: SparkSession, sf: str) -> DataFrame:
    return engage.expired(X.members(spark, sf), X.ORDERS_AS_OF)


@query(f"WITH {X.MEMBERS} SELECT id, CASE WHEN expiry_time >= TIMESTAMP '{X.ORDERS_AS_OF}' THEN expiry_time END AS expiry_time FROM members")
def expiry_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return engage.swept(X.members(spark, sf), X.ORDERS_AS_OF)


@query(f"""WITH {X.MEMBERS}, s AS (SELECT id, epoch(expiry_time)::BIGINT - epoch(TIMESTAMP '{X.ORDERS_AS_OF}')::BIGINT AS s FROM members WHERE expiry_time > TIMESTAMP '{X.ORDERS_AS_OF}')
SELECT id, s // 86400 AS days, s // 3600 % 24 AS hours, s // 60 % 60 AS minutes FROM s""")
def members_left(spark: SparkSession, sf: str) -> DataFrame:
    return engage.time_left(X.members(spark, sf), X.ORDERS_AS_OF)


@query(f"WITH {X.MEMBERS} SELECT id, c_name AS name, expiry_time FROM members JOIN customer ON id = c_custkey WHERE expiry_time IS NOT NULL")
def member_users(spark: SparkSession, sf: str) -> DataFrame:
    users = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return engage.user_members(users, X.members(spark, sf)).select("id", "name", "expiry_time")


_MIDNIGHT, _NOW = "TIMESTAMP '2024-01-29 18:30:00'", "TIMESTAMP '2024-01-30 12:00:00'"


def _due(a: str, b: str) -> str:
    return f"coalesce({a} >= {_MIDNIGHT}, false) AND {_NOW} - {a} > INTERVAL 8 HOUR AND coalesce({b} < {a}, true)"


_STATE = f"state AS (SELECT user_id, coalesce(first >= {_MIDNIGHT}, false) AS verified, coalesce({_due('first', 'second')}, false) AS second_due, coalesce({_due('second', 'third')}, false) AS third_due FROM verification)"


@query(f"WITH {X.VERIFICATION}, {_STATE} SELECT * FROM state")
def verification_due(spark: SparkSession, sf: str) -> DataFrame:
    return engage.verification_state(X.verification(spark, sf), "2024-01-30 12:00:00")


@query("WITH r AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, n * 10 % 100 AS points, n * 10 // 100 AS grants FROM r")
def referral_points(spark: SparkSession, sf: str) -> DataFrame:
    n = X.table(spark, sf, "events").filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("n"))
    return engage.referral_points(n)


@query(f"""WITH {X.MEMBERS}, {X.VERIFICATION}, {_STATE}, u AS (SELECT DISTINCT user_id FROM events), q AS (SELECT user_id, count(*) FILTER ({_DAY} = DATE '2024-01-30') AS used FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT u.user_id, CASE WHEN m.expiry_time > TIMESTAMP '{X.ORDERS_AS_OF}' THEN 'send' WHEN u.user_id % 4 = 3 THEN 'join' WHEN coalesce(q.used, 0) < 1 THEN 'send'
WHEN NOT coalesce(s.verified, false) OR coalesce(s.second_due, false) OR coalesce(s.third_due, false) THEN 'verify' ELSE 'send' END AS decision
FROM u LEFT JOIN members m ON u.user_id = m.id LEFT JOIN q ON u.user_id = q.user_id LEFT JOIN state s ON u.user_id = s.user_id""")
def entitlement(spark: SparkSession, sf: str) -> DataFrame:
    users = X.table(spark, sf, "events").select("user_id").distinct()
    usage = engage.quota_left(X.downloads(spark, sf), "2024-01-30 12:00:00")
    state = engage.verification_state(X.verification(spark, sf), "2024-01-30 12:00:00")
    return engage.entitlement(users, X.members(spark, sf), usage, state, users.filter("user_id % 4 <> 3"), X.ORDERS_AS_OF)


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 23 <> 0")
def ban_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    users = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return engage.without_banned(users, X.bans(spark, sf))


@query("""WITH d AS (SELECT n_nationkey::BIGINT AS id, unnest(['auto_delete', 'button', 'link', 'spell_check', 'welcome']) AS name FROM nation)
SELECT id, name, CASE WHEN name = 'button' AND id % 2 = 0 THEN 'false' WHEN name = 'welcome' THEN CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END ELSE 'true' END AS value FROM d""")
def settings_merge(spark: SparkSession, sf: str) -> DataFrame:
    return engage.merged_settings(X.group_settings(spark, sf))


@query(f"""WITH {X.FILES}, {X.MEMBERS} SELECT 'users' AS what, count(*)::BIGINT AS value FROM customer UNION ALL SELECT 'groups', count(*) FROM nation UNION ALL SELECT 'active members', count(*) FROM members WHERE expiry_time > TIMESTAMP '{X.ORDERS_AS_OF}'
UNION ALL SELECT 'files ' || store, count(*) FROM files GROUP BY store UNION ALL SELECT 'bytes ' || store, sum(file_size)::BIGINT FROM files GROUP BY store""")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return engage.store_stats(_files(spark, sf), X.table(spark, sf, "customer"), X.table(spark, sf, "nation"), X.members(spark, sf), X.ORDERS_AS_OF)


@query(f"""WITH {X.MESSAGES} SELECT id, CASE WHEN regexp_matches(lower(text), 'hindi|tamil|telugu|malayalam|kannada|english|gujarati') THEN 'search' WHEN starts_with(text, '/') THEN 'command'
WHEN regexp_matches(text, 'https?://\\S+|www\\.\\S+|t\\.me/\\S+') THEN 'link' WHEN contains(lower(text), '@admin') THEN 'admin' ELSE 'search' END AS route FROM messages""")
def text_routing(spark: SparkSession, sf: str) -> DataFrame:
    return engage.route(X.messages(spark, sf))


@query("WITH r AS (SELECT event_id, user_id, event_type AS text, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) SELECT event_id, user_id, text FROM r WHERE text IS DISTINCT FROM last")
def request_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return engage.new_requests(X.requests(spark, sf)).select("event_id", "user_id", "text")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM s) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY user_id, burst""")
def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    from .streaming.feeds import debounced

    rows = X.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = debounced(rows, "user_id", seconds=6 * 3600)
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query("""SELECT o.event_id, o.user_id FROM events o WHERE o.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = o.user_id AND c.ts >= o.ts AND c.ts <= o.ts + INTERVAL 7200 SECOND)""")
def unanswered_offers(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events")
    return engage.unanswered(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), seconds=7200).select("event_id", "user_id")


@query("SELECT sha256('code' || event_id::VARCHAR) AS code_hash, '1month' AS duration, CASE WHEN event_id % 3 = 0 THEN 'used' ELSE 'ok' END AS status FROM events WHERE event_id = 42")
def redeem_code(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events")
    codes = e.select(F.sha2(F.concat(F.lit("code"), F.col("event_id").cast("string")), 256).alias("code_hash"), F.lit("1month").alias("duration"), "event_id")
    return engage.redeem(codes.drop("event_id"), codes.filter("event_id % 3 = 0").select("code_hash"), "code42")


# ---- feeds


def _list(x: str, sep: str) -> str:
    return f"list_filter(list_transform(string_split(CASE WHEN coalesce({x}, 'N/A') = 'N/A' THEN '' ELSE {x} END, '{sep}'), lambda v: trim(v)), lambda v: v <> '')"


_UNION = lambda c: f"coalesce(nullif(array_to_string(list_sort(list_distinct(flatten(list({c})))), ', '), ''), 'N/A')"
_OLD = "coalesce(resolution, 'N/A') = 'N/A'"


@query(f"""WITH {NAMED}, {X.FEED}, d AS (SELECT DISTINCT ON (base_name, filename) * FROM feed), p AS (SELECT base_name, tag,
list_concat({_list("quality", ",")}, CASE WHEN {_OLD} THEN regexp_extract_all(quality, '(?i){V.FEED_SOURCE}') ELSE [] END) AS q, list_concat({_list("resolution", ",")}, CASE WHEN {_OLD} THEN regexp_extract_all(quality, '(?i){V.FEED_RESOLUTION}') ELSE [] END) AS r,
{_list("language", ",")} AS l, {_list("ott_platform", "|")} AS o FROM d)
SELECT base_name, count(*) AS files, CASE WHEN bool_or(tag = '#SERIES') THEN '#SERIES' ELSE '#MOVIE' END AS tag, {_UNION("q")} AS qualities, {_UNION("r")} AS resolutions, {_UNION("l")} AS languages, {_UNION("o")} AS platforms FROM p GROUP BY base_name""")
def rollup_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.title_rollup(X.feed(spark, sf))


@query(f"""WITH {NAMED}, {X.FEED}, s AS (SELECT DISTINCT base_name, season, episode FROM feed WHERE season > 0 AND episode IS NOT NULL),
nums AS (SELECT DISTINCT base_name, season, episode::INT AS n FROM s WHERE regexp_full_match(episode, '[0-9]+')), i AS (SELECT *, n - row_number() OVER (PARTITION BY base_name, season ORDER BY n) AS g FROM nums),
runs AS (SELECT base_name, season, 0 AS kind, min(n) AS pos, CASE WHEN min(n) = max(n) THEN min(n)::VARCHAR ELSE min(n)::VARCHAR || '-' || max(n)::VARCHAR END AS said FROM i GROUP BY base_name, season, g),
parts AS (SELECT * FROM runs UNION ALL SELECT base_name, season, 1, regexp_extract(episode, '^([0-9]+)', 1)::INT, episode FROM s WHERE NOT regexp_full_match(episode, '[0-9]+'))
SELECT base_name, season, 'S' || season::VARCHAR || ': ' || string_agg(said, ', ' ORDER BY kind, pos, said) AS episodes FROM parts GROUP BY base_name, season""")
def episode_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.episode_ranges(X.feed(spark, sf))


def _feed_said(x: str) -> str:
    """Languages of a text: a key that stands somewhere without a subtitle word behind it."""
    some = lambda k: f"len(regexp_extract_all({x}, '\\b{k}\\b')) > len(regexp_extract_all({x}, '\\b{k}\\b{V.FEED_SUBTITLE}'))"
    return "list_filter([" + ", ".join(f"CASE WHEN {some(k)} THEN '{v}' END" for k, v in V.FEED_LANGUAGES) + "], lambda v: v IS NOT NULL)"


def _feed_platforms(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '\\b{k}\\b') THEN '{v}' END" for k, v in V.FEED_PLATFORMS) + "], lambda v: v IS NOT NULL)"


_SERIES = " OR ".join(f"regexp_matches(file_name, '(?i){p}')" for p in (V.FEED_RANGE, V.FEED_SINGLE, V.FEED_NAMED, V.FEED_EPISODES_ONLY))


@query(f"""WITH {_found(ASKED)}, a AS (SELECT DISTINCT file_name, caption, concat_ws(' ', file_name, caption) AS said FROM found),
w AS (SELECT *, list_filter(string_split({_strip("said")}, ' '), lambda x: x <> '') AS w, lower(said) AS low, {_SERIES} AS series FROM a),
p AS (SELECT file_name, min(series) AS series, flatten(list(regexp_extract_all(low, '(?i){V.FEED_SOURCE}'))) AS q,
flatten(list(list_transform(regexp_extract_all(low, '(?i){V.FEED_RESOLUTION}'), lambda r: CASE WHEN r = '4k' THEN '4K' ELSE r END))) AS r, flatten(list({_feed_said("low")})) AS l, flatten(list({_feed_platforms("low")})) AS o
FROM w WHERE list_contains(w, 'blue') AND list_contains(w, 'bolt') GROUP BY file_name)
SELECT 'blue bolt' AS base_name, count(*) AS files, CASE WHEN bool_or(series) THEN '#SERIES' ELSE '#MOVIE' END AS tag, {_UNION("q")} AS qualities, {_UNION("r")} AS resolutions, {_UNION("l")} AS languages, {_UNION("o")} AS platforms FROM p HAVING count(*) > 0""")
def manual_rollup(spark: SparkSession, sf: str) -> DataFrame:
    found = search.search(_files(spark, sf), prepare(ASKED))
    return rollup.title_rollup(rollup.from_catalog(found, ASKED))


# ---- spelling

#: (a, b, common): the longest common subsequence of the pairs in a table `pairs` (a, b), a letter of a at a time.
_COMMON = """lcs AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda k: 0) AS row FROM pairs UNION ALL
SELECT a, b, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (SELECT a, b, i,
  list_transform(range(0, length(b) + 1), lambda k: CASE WHEN k > 0 AND substr(a, i + 1, 1) = substr(b, k, 1) THEN row[k] + 1 ELSE row[k + 1] END) AS c FROM lcs WHERE i < length(a)) x),
common AS (SELECT a, b, row[length(b) + 1] AS common FROM lcs WHERE i = length(a))"""
_BASE = f"""b AS (SELECT lower({_squeeze(f"regexp_replace({_sub('file_name', V.BASE_JUNK, '')}, '[._\\-\\+\\[\\]()''\"]+', ' ', 'g')")}) AS base, file_name FROM catalog),
titles AS (SELECT base, min(file_name) AS original, list_filter(string_split(base, ' '), lambda w: w <> '') AS words, {_collapse("base")} AS letters FROM b WHERE base <> '' GROUP BY base)"""
MISTYPED = "bluue bollt"


@query(f"""WITH RECURSIVE {X.FILES}, {_BASE}, wanted AS (SELECT unnest(string_split('{MISTYPED}', ' ')) AS a),
fitting AS (SELECT * FROM titles WHERE letters = '{MISTYPED.replace(" ", "")}' OR len(words) <= 3), own AS (SELECT DISTINCT base, unnest(words) AS b FROM fitting),
pairs AS (SELECT DISTINCT a, b FROM wanted, (SELECT DISTINCT b FROM own) x WHERE abs(length(a) - length(b)) <= 2), {_COMMON},
best AS (SELECT own.base, w.a, max(CASE WHEN {_collapse("own.b")} = w.a THEN 100 ELSE coalesce(round(200 * common / (length(w.a) + length(own.b))), 0) END) AS s
  FROM own CROSS JOIN wanted w LEFT JOIN common ON common.a = w.a AND common.b = own.b GROUP BY own.base, w.a),
scored AS (SELECT f.base, f.original, CASE WHEN letters = '{MISTYPED.replace(" ", "")}' THEN 100 ELSE coalesce((SELECT floor(sum(s) / 2) FROM best WHERE best.base = f.base), 0) END::INT AS score FROM fitting f)
SELECT base, original, score FROM scored WHERE score >= {V.SPELL_LEAST} ORDER BY score DESC, base LIMIT {V.SPELL_TRIED}""")
def spell_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy.spell_candidates(catalog.titles(_files(spark, sf)), prepare(MISTYPED))


@query(f"""WITH RECURSIVE {X.FILES}, {_BASE}, said AS (SELECT p_partkey AS id, {_strip(X.MISTYPED_SQL)} AS text FROM part), texts AS (SELECT DISTINCT text, list_filter(string_split(text, ' '), lambda w: w <> '') AS wanted, {_collapse("text")} AS letters FROM said WHERE text <> ''),
wanted AS (SELECT DISTINCT text, unnest(wanted) AS a FROM texts), own AS (SELECT DISTINCT base, unnest(words) AS b FROM titles),
pairs AS (SELECT a, b FROM (SELECT DISTINCT a FROM wanted), (SELECT DISTINCT b FROM own) WHERE abs(length(a) - length(b)) <= 2), {_COMMON},
alike AS (SELECT w.a, o.b, max(CASE WHEN {_collapse("o.b")} = {_collapse("w.a")} THEN 100 ELSE round(200 * common / (length(w.a) + length(o.b))) END) AS s FROM (SELECT DISTINCT a FROM wanted) w, (SELECT DISTINCT b FROM own) o
  LEFT JOIN common ON common.a = w.a AND common.b = o.b GROUP BY ALL HAVING s > 0),
each_word AS (SELECT t.text, o.base, w.i, max(s) AS s FROM texts t, (SELECT unnest(range(1, 9)) AS i) w JOIN alike ON alike.a = t.wanted[w.i] JOIN own o ON o.b = alike.b GROUP BY ALL),
sums AS (SELECT text, base, sum(s) AS s FROM each_word GROUP BY ALL),
scored AS (SELECT x.text, y.base, CASE WHEN x.letters = y.letters THEN 100 ELSE floor(s / len(x.wanted)) END::INT AS score FROM sums JOIN texts x USING (text) JOIN titles y USING (base) WHERE x.letters = y.letters OR len(y.words) <= len(x.wanted) + 1
  UNION SELECT x.text, y.base, 100 FROM texts x JOIN titles y ON x.letters = y.letters),
ranked AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, base) AS place FROM scored WHERE score >= {V.SPELL_LEAST})
SELECT said.id, base, score FROM said JOIN ranked USING (text) WHERE place = 1""")
def spell_all(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest title of every mistyped text, in one job."""
    said = X.mistyped(spark, sf).select("id", text.strip_tech(F.col("said")).alias("text"))
    best = fuzzy.corrections(said, catalog.titles(_files(spark, sf)), limit=1)
    return said.join(best, "text").select("id", "base", "score")


_WINDOWS = "unnest(list_transform(range(0, length(y) - length(x) + 1), lambda k: substr(y, k + 1, length(x))))"


def _alike(table: str) -> str:
    """CTEs that give scored (a, b, score) of the pairs (a, b) in a table: the whole ratio or the best window of the longer text."""
    return f"""sides AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM {table}),
cuts AS (SELECT a, b, x, y AS part FROM sides UNION SELECT a, b, x, {_WINDOWS} FROM sides WHERE x <> ''), pairs AS (SELECT DISTINCT x AS a, part AS b FROM cuts), {_COMMON},
scored AS (SELECT cuts.a, cuts.b, max(CASE WHEN cuts.a = '' OR cuts.b = '' THEN 0 WHEN {_collapse("cuts.a")} = {_collapse("cuts.b")} THEN 100 ELSE round_even(200 * common / (length(x) + length(part)), 0) END)::INT AS score
  FROM cuts JOIN common ON common.a = x AND common.b = part GROUP BY cuts.a, cuts.b)"""


_ONCE = f"""{X.OUTSIDE}, once AS (SELECT arg_min(title, place) AS title, min(place) AS place, {_strip("lower(title)")} AS a, 'blue bolt' AS b FROM outside GROUP BY lower(title))"""


@query(f"""WITH RECURSIVE {_ONCE}, {_alike("once")}
SELECT title, score FROM once JOIN scored USING (a, b) WHERE score >= {V.SUGGEST_LEAST} ORDER BY score DESC, place LIMIT {V.SUGGESTED}""")
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy.suggestions(X.outside(spark, sf), "blue bolt")


@query(f"""WITH RECURSIVE {X.FILES}, {KEYED}, {X.OUTSIDE}, s AS (SELECT DISTINCT title, {_strip("regexp_replace(title, '\\s*\\(\\d{{4}}\\)\\s*$', '')")} AS a FROM outside),
t AS (SELECT DISTINCT title_key AS b FROM keyed WHERE title_key <> ''), near AS (SELECT DISTINCT a, b FROM s, t WHERE abs(length(a) - length(b)) <= {V.IN_STORE_GAP}), {_alike("near")}
SELECT DISTINCT title FROM s WHERE {_collapse("a")} IN (SELECT {_collapse("b")} FROM t) OR a IN (SELECT a FROM scored WHERE score >= {V.IN_STORE_LEAST})""")
def suggestion_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Of all titles that an outside source has, those in the store."""
    titles = groups.cards(catalog.with_keys(catalog.federate(_files(spark, sf)))).select(F.col("title_key").alias("base"))
    return fuzzy.in_store(X.outside(spark, sf).select("title").distinct(), titles)


from . import queries_records  # noqa: E402, F401  it registers its own queries
