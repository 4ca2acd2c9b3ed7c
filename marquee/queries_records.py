"""Registered queries of record keeping: reads by key, sets and nested fields, pages, captions, outcomes, encoded ids, feeds and streams."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alphabets, extract, scalar, text
from .functions import vocab as V
from .operators import codes as codes_of
from .operators import engage, groups, mutate, rollup, stores
from .queries import _UNITS, NAMED, ORACLES, QUERIES, _feed_platforms, _feed_said, _first, _langs, _squeeze, _sub, _web_se, query
from .sources import catalog
from .sources import fixtures as X
from .sources.store import shared_folder, stored
from .streaming import feeds, history

# ---- reads by key


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def user_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query(f"""WITH {X.MEMBERS}, s AS (SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS own FROM nation)
SELECT 'user' AS kind, c_custkey::VARCHAR AS id, c_name AS value FROM customer WHERE c_custkey = 7
UNION ALL SELECT 'membership', id::VARCHAR, CASE WHEN expiry_time IS NULL THEN 'no' ELSE 'yes' END FROM members WHERE id = 7
UNION ALL SELECT 'settings', k::VARCHAR, CASE WHEN own THEN 'false' ELSE 'none' END FROM s WHERE k = 7""")
def records_by_key(spark: SparkSession, sf: str) -> DataFrame:
    users = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value"))
    members = X.members(spark, sf).select("id", F.when(F.col("expiry_time").isNull(), "no").otherwise("yes").alias("value"))
    settings = X.group_settings(spark, sf).select("id", F.coalesce(F.try_element_at("settings", F.lit("button")), F.lit("none")).alias("value"))
    return mutate.by_key({"user": users, "membership": members, "settings": settings}, 7)


# ---- sets, nested fields, whole stores


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'a,x' WHEN 1 THEN 'a,b,x' WHEN 2 THEN 'b,x' ELSE 'x' END AS added,
CASE WHEN c_custkey % 4 IN (1, 2) THEN 'b' ELSE '' END AS pulled, CASE WHEN c_custkey % 4 IN (1, 2) THEN 1 ELSE 0 END AS shared FROM customer""")
def set_updates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    lists = F.when(k % 4 == 0, F.array(F.lit("a"))).when(k % 4 == 1, F.array(F.lit("a"), F.lit("b"))).when(k % 4 == 2, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    rows = X.table(spark, sf, "customer").select(k.alias("id"), lists.alias("own"))
    out = mutate.add_to_set(rows.withColumn("added", F.col("own")), "added", F.lit("x"))
    out = mutate.pull_from_set(out.withColumn("pulled", F.col("own")), "pulled", F.lit("a"))
    return out.select("id", F.array_join("added", ",").alias("added"), F.array_join("pulled", ",").alias("pulled"), F.size(F.array_intersect("own", F.array(F.lit("b"), F.lit("c")))).alias("shared"))


@query("SELECT c_custkey AS id, c_custkey % 23 = 0 OR c_custkey = 5 AS is_banned, CASE WHEN c_custkey = 5 THEN 'links' WHEN c_custkey % 23 = 0 THEN 'spam' ELSE '' END AS ban_reason FROM customer")
def ban_user(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    status = F.struct((k % 23 == 0).alias("is_banned"), F.when(k % 23 == 0, "spam").otherwise("").alias("ban_reason"))
    rows = X.table(spark, sf, "customer").select(k.alias("id"), status.alias("ban_status"))
    set_to = lambda name, v: F.when(F.col("id") == 5, F.lit(v)).otherwise(F.col(f"ban_status.{name}"))
    rows = mutate.set_field(mutate.set_field(rows, "ban_status", "is_banned", set_to("is_banned", True)), "ban_status", "ban_reason", set_to("ban_reason", "links"))
    return rows.select("id", "ban_status.*")


@query(f"WITH {X.FILES} SELECT store, count(*) AS dropped, 0::BIGINT AS left FROM files GROUP BY store")
def drop_all(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    stores.create(X.files(spark, sf), path)
    return stores.drop_all(spark, path)


#: Capacities: what the stores hold and three, and two, tenths of what comes.
_SAVED = f"""{X.FILES}, {X.ARRIVALS}, came AS (SELECT file_id, seq, regexp_replace(regexp_replace(file_name, '@\\w+', '', 'g'), '[_\\-.+]', ' ', 'g') AS file_name, regexp_replace(regexp_replace(coalesce(caption, ''), '@\\w+', '', 'g'), '[_\\-.+]', ' ', 'g') AS caption FROM arrivals),
sized AS (SELECT *, strlen(file_name) + strlen(caption) AS size FROM came), all_new AS (SELECT sum(size) AS s FROM sized),
used AS (SELECT sum(strlen(file_name) + strlen(coalesce(caption, ''))) FILTER (store = 'primary') AS one, sum(strlen(file_name) + strlen(coalesce(caption, ''))) FILTER (store = 'secondary') AS two FROM files),
k1 AS (SELECT z.*, f.file_id IS NOT NULL AS known, coalesce(f.caption, '') AS held FROM sized z LEFT JOIN files f ON z.file_id = f.file_id AND f.store = 'primary'),
n1 AS (SELECT *, coalesce(sum(size) OVER (ORDER BY seq, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k1 WHERE NOT known), f1 AS (SELECT *, before + (SELECT one FROM used) < (SELECT one FROM used) + (SELECT s * 3 // 10 FROM all_new) AS fits FROM n1),
k2 AS (SELECT z.file_id, z.seq, z.file_name, z.caption, z.size, f.file_id IS NOT NULL AS known, coalesce(f.caption, '') AS held FROM f1 z LEFT JOIN files f ON z.file_id = f.file_id AND f.store = 'secondary' WHERE NOT fits),
n2 AS (SELECT *, coalesce(sum(size) OVER (ORDER BY seq, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k2 WHERE NOT known), f2 AS (SELECT *, before < (SELECT s * 2 // 10 FROM all_new) AS fits FROM n2),
saved AS (SELECT file_id, file_name, caption, CASE WHEN caption <> held THEN 'upd' ELSE 'dup' END AS status, 'primary' AS store FROM k1 WHERE known UNION ALL SELECT file_id, file_name, caption, 'suc', 'primary' FROM f1 WHERE fits
  UNION ALL SELECT file_id, file_name, caption, CASE WHEN caption <> held THEN 'upd' ELSE 'dup' END, 'secondary' FROM k2 WHERE known UNION ALL SELECT file_id, file_name, caption, CASE WHEN fits THEN 'suc' ELSE 'err' END, CASE WHEN fits THEN 'secondary' END FROM f2)"""


def _saved(spark: SparkSession, sf: str) -> DataFrame:
    came, files = X.arrivals(spark, sf), X.files(spark, sf)
    new = stores.arrived(came).agg(F.sum("size")).first()[0] or 0
    used = {r["store"]: r["n"] for r in files.groupBy("store").agg(F.sum(stores.size_of()).alias("n")).collect()}
    return stores.saved(came, files, used.get(stores.FIRST, 0) + new * 3 // 10, used.get(stores.SECOND, 0) + new * 2 // 10)


@query(f"WITH {_SAVED} SELECT file_id, status, store FROM saved")
def save_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Two stores that run full: what becomes of each arriving file."""
    return _saved(spark, sf).select("file_id", "status", "store")


@query(f"""WITH {_SAVED}, c AS (SELECT * FROM saved WHERE status IN ('suc', 'upd'))
SELECT coalesce(f.store, c.store) AS store, coalesce(f.file_id, c.file_id) AS file_id, coalesce(f.file_name, c.file_name) AS file_name, CASE WHEN c.file_id IS NOT NULL THEN c.caption ELSE f.caption END AS caption FROM files f FULL JOIN c ON f.file_id = c.file_id AND f.store = c.store""")
def saved_stores(spark: SparkSession, sf: str) -> DataFrame:
    """Both stores after that, merged into the buckets touched."""
    path = shared_folder(spark)
    stores.create(X.files(spark, sf), path)
    stores.merge(spark, path, stored(_saved(spark, sf)))
    return spark.read.parquet(path).select("store", "file_id", "file_name", "caption")


@query("""WITH r AS (SELECT user_id, max(ts) AS own FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT u.user_id, count(e.ts) AS count FROM u LEFT JOIN r ON u.user_id = r.user_id LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = 'purchase' AND e.ts > greatest(coalesce(r.own, TIMESTAMP '2024-01-10'), TIMESTAMP '2024-01-10') GROUP BY 1""")
def file_counters(spark: SparkSession, sf: str) -> DataFrame:
    """All users' counters: a sign-up resets one, and one time resets all."""
    e = X.table(spark, sf, "events")
    every = spark.sql("SELECT CAST(NULL AS BIGINT) AS user_id, TIMESTAMP_NTZ '2024-01-10' AS ts").select(*[F.col(c).cast(e.schema[c].dataType) for c in ("user_id", "ts")])
    return engage.counters(X.downloads(spark, sf), e.filter("event_type = 'signup'").select("user_id", "ts").union(every))


# ---- codes

_CLAIMS = """claims AS (SELECT event_id, user_id, event_id % 211 AS code, ts FROM events WHERE event_type = 'signup'), code AS (SELECT range AS code, CASE range % 3 WHEN 0 THEN 86400 WHEN 1 THEN 7 * 86400 ELSE 30 * 86400 END AS seconds FROM range(211) WHERE range % 10 <> 7),
member AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 9 = 0), c AS (SELECT claims.*, seconds, member.id IS NOT NULL AND ts < TIMESTAMP '2024-01-10' AS old, row_number() OVER (ORDER BY ts, event_id) AS i FROM claims LEFT JOIN code USING (code) LEFT JOIN member ON user_id = id),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, []::STRUCT(u BIGINT, t TIMESTAMP)[] AS given, NULL::BIGINT AS event_id, NULL::BIGINT AS user_id, NULL::BIGINT AS code, NULL::VARCHAR AS status
UNION ALL SELECT i, CASE WHEN status = 'ok' THEN list_append(used, code) ELSE used END, CASE WHEN status = 'ok' THEN list_append(given, struct_pack(u := user_id, t := ts + to_seconds(seconds))) ELSE given END, event_id, user_id, code, status FROM (
  SELECT c.*, r.used, r.given, CASE WHEN c.old OR len(list_filter(r.given, lambda g: g.u = c.user_id AND g.t > c.ts)) > 0 THEN 'member' WHEN seconds IS NULL THEN 'invalid' WHEN list_contains(r.used, c.code) THEN 'used' ELSE 'ok' END AS status FROM r JOIN c ON c.i = r.i + 1) x)"""


def _claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes of three durations, claims of them by signing up, and users that are members until a day."""
    e = X.table(spark, sf, "events").filter("event_type = 'signup'")
    code = lambda c: F.concat(F.lit("code"), c.cast("string"))
    seconds = F.when(F.col("id") % 3 == 0, 86400).when(F.col("id") % 3 == 1, 7 * 86400).otherwise(30 * 86400)
    codes = codes_of.added(spark.createDataFrame([], "code_hash string, seconds int"), spark.range(211).filter("id % 10 <> 7").select(code(F.col("id")).alias("code"), seconds.alias("seconds")))
    claims = e.select(F.col("event_id").alias("claim_id"), "user_id", F.sha2(code(F.col("event_id") % 211), 256).alias("code_hash"), F.col("ts").alias("at"))
    members = X.table(spark, sf, "events").filter("user_id % 9 = 0").select(F.col("user_id").alias("id")).distinct().withColumn("expiry_time", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return codes, claims, members


@query(f"WITH RECURSIVE {_CLAIMS} SELECT event_id AS claim_id, status FROM r WHERE i > 0")
def redeem_claims(spark: SparkSession, sf: str) -> DataFrame:
    codes, claims, members = _claims(spark, sf)
    return codes_of.claim_status(codes, claims, members, codes_of.granted(codes, claims, members))


@query(f"WITH RECURSIVE {_CLAIMS} SELECT sha256('code' || code.code::VARCHAR) AS code_hash, seconds, r.code IS NOT NULL AS used, r.user_id FROM code LEFT JOIN r ON code.code = r.code AND r.status = 'ok'")
def code_list(spark: SparkSession, sf: str) -> DataFrame:
    codes, claims, members = _claims(spark, sf)
    return codes_of.listed(codes, codes_of.granted(codes, claims, members))


# ---- texts of messages


@query(f"""WITH {X.FILES}, {X.INCOMING} SELECT file_id, regexp_replace(file_name, '@\\w+', '', 'g') AS person, CASE WHEN trim(caption) <> '' THEN trim(caption) ELSE file_name END AS shown,
CASE WHEN contains(file_name, '_S') THEN trim(string_split(file_name, '_S')[-1]) END AS asked_for, coalesce(nullif(array_to_string(regexp_extract_all(caption, '(?i){V.FEED_QUALITY}'), ', '), ''), 'N/A') AS qualities FROM incoming""")
def message_texts(spark: SparkSession, sf: str) -> DataFrame:
    name, caption = F.col("file_name"), F.col("caption")
    return X.incoming(spark, sf).select("file_id", text.person_name(name).alias("person"), text.shown_trimmed(name, caption).alias("shown"), text.after_marker(name, "_S").alias("asked_for"), extract.feed_qualities(caption).alias("qualities"))


@query("SELECT CASE WHEN c_custkey % 29 = 0 THEN 'blocked' WHEN c_custkey % 31 = 0 THEN 'deleted' ELSE 'success' END AS status, count(*) AS n FROM customer GROUP BY 1")
def broadcast_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    sent = X.table(spark, sf, "customer").select(F.when(k % 29 == 0, "blocked").when(k % 31 == 0, "deleted").otherwise("success").alias("status"))
    return engage.count_outcomes(sent)


@query("SELECT user_id, event_type AS text, count(*) AS searches FROM events GROUP BY ALL")
def search_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = engage.counted(X.requests(spark, sf).select("user_id", "text"))
    return rows.withColumnRenamed("count", "searches")


# ---- pages, ratings, records, captions


@query("SELECT c_custkey AS id, ceil(c_custkey / 10.0)::BIGINT AS pages, (c_custkey // 10 + 1)::BIGINT AS page, CASE WHEN c_custkey % 9 = 0 THEN 'N/A' ELSE format('{:.1f}', (c_custkey % 100) / 10.0::DOUBLE) END AS rating FROM customer")
def paging(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    votes = F.when(k % 9 != 0, (k % 100) / 10)
    return X.table(spark, sf, "customer").select(k.alias("id"), scalar.pages(k, 10).cast("long").alias("pages"), scalar.page_of(k, 10).cast("long").alias("page"), scalar.rating(votes).alias("rating"))


_SHOWN = "coalesce(nullif(caption, ''), file_name)"
_DISPLAY = _squeeze(f"regexp_replace(regexp_replace(regexp_replace({_sub('shown', V.WEB_EXTENSION, '')}, '@\\w+', '', 'g'), 'https?://\\S+', '', 'g'), '{V.WEB_PUNCTUATION}', ' ', 'g')")


@query(f"""WITH {NAMED}, x AS (SELECT file_id, {_SHOWN} AS shown, file_size::DOUBLE AS s FROM named)
SELECT file_id AS id, {_DISPLAY} AS caption, CASE {_UNITS}END AS size, {_first("shown", V.QUALITY_LABELS, "")} AS quality, {_first("shown", V.PRINT_LABELS, "")} AS print_type, {_langs("shown")} AS languages,
{_first("shown", V.SUBTITLE_LABELS, "")} AS subtitles, {_web_se("shown", 1)} AS season, {_web_se("shown", 2)} AS episode FROM x""")
def file_objects(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = X.named_files(spark, sf).select(extract.file_object(c("file_name"), c("caption"), c("file_size"), c("file_id")).alias("r")).select("r.*")
    return rows.withColumn("languages", F.array_join("languages", ", "))


@query(f"WITH {NAMED}, x AS (SELECT file_id, file_name, caption, file_size::DOUBLE AS s FROM named) SELECT file_id, '<b>' || file_name || '</b> {{size}} ' || CASE {_UNITS}END || ' ' || coalesce(caption, '') AS said FROM x")
def captions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    values = {"file_name": c("file_name"), "file_size": scalar.size_label(c("file_size")), "file_caption": c("caption")}
    return X.named_files(spark, sf).select("file_id", text.filled("<b>{file_name}</b> {{size}} {file_size} {file_caption}", values).alias("said"))


def _decorated_sql(name: str) -> str:
    (plain, fancy), (letters, mark) = alphabets.swaps(name), alphabets.marked(name)
    said = f"regexp_replace(s, '{letters}', '\\1{mark}', 'g')" if mark else "s"
    return f"translate({said}, '{plain}', '{fancy}') AS in_{name}" if plain else f"{said} AS in_{name}"


@query(f"WITH x AS (SELECT p_partkey AS id, p_name || ' ' || upper(p_name) || ' ' || p_partkey || ' AZ az 0123456789' AS s FROM part) SELECT id, {', '.join(map(_decorated_sql, alphabets.NAMES))} FROM x")
def decorated(spark: SparkSession, sf: str) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey")
    rows = catalog.dealt(X.table(spark, sf, "part"), "p_partkey").select(k.alias("id"), F.concat_ws(" ", name, F.upper(name), k.cast("string"), F.lit("AZ az 0123456789")).alias("s"))
    return rows.select("id", *[text.decorate(F.col("s"), a).alias(f"in_{a}") for a in alphabets.NAMES])


@query(f"""WITH m AS (SELECT p_name AS title, 1990 + p_partkey % 35 AS year, p_partkey % 3 <> 0 AS poster, p_partkey % 17 AS votes, p_partkey AS rank FROM part)
SELECT rank, title, year FROM m ORDER BY (year = 2001)::INT DESC, (regexp_replace(lower(title), '[^a-z0-9]', '', 'g') = 'bluebolt')::INT DESC, (poster AND votes > 5)::INT DESC, rank LIMIT 1""")
def metadata_pick(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    found = X.table(spark, sf, "part").select(F.col("p_name").alias("title"), (1990 + k % 35).alias("year"), F.when(k % 3 != 0, "poster").alias("poster"), (k % 17).alias("votes"), k.alias("rank"))
    return groups.pick_metadata(found, "Blue Bolt", 2001).select("rank", "title", "year")


# ---- ids, feeds

_HEX = "lpad(to_hex(p_partkey), 16, '0') || '0000' || lpad(to_hex(p_size), 8, '0') || '1604'"


@query(f"""WITH h AS (SELECT p_partkey, {_HEX} AS h FROM part), b AS (SELECT p_partkey, unnest(range(1, length(h) // 2 + 1)) AS i, h FROM h), y AS (SELECT p_partkey, i, h[2 * i - 1 : 2 * i] AS y FROM b),
g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, y = '00' ORDER BY i) AS g FROM y),
r AS (SELECT p_partkey, min(i) AS i, CASE WHEN y = '00' THEN '00' || lpad(to_hex(count(*)), 2, '0') ELSE string_agg(y, '' ORDER BY i) END AS said FROM g GROUP BY p_partkey, y = '00', CASE WHEN y = '00' THEN g ELSE i END, y)
SELECT p_partkey, rtrim(translate(to_base64(unhex(string_agg(said, '' ORDER BY i))), '+/', '-_'), '=') AS encoded FROM r GROUP BY p_partkey""")
def encode_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.hex("p_partkey")
    packed = F.unhex(F.concat(F.lpad(k, 16, "0"), F.lit("0000"), F.lpad(F.hex("p_size"), 8, "0")))
    return X.table(spark, sf, "part").select("p_partkey", extract.encode_id(packed).alias("encoded"))


def _feed_normal(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{V.FEED_SEPARATORS.replace(chr(39), chr(39) * 2)}', ' ', 'g'), '\\s+', ' ', 'g'))"


def _mentions(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{V.FEED_MENTION.replace(chr(39), chr(39) * 2)}', '', 'g'))"


_FEED_MARKS = (V.FEED_RANGE, V.FEED_SINGLE, V.FEED_NAMED, V.FEED_EPISODES_ONLY)
_hit = lambda p: f"regexp_matches(name, '(?i){p}')"
_part = lambda p, k: f"regexp_extract(name, '(?i){p}', {k})"
_at = lambda p: f"CASE WHEN {_hit(p)} THEN length(regexp_extract(name, '(?is)^(.*?)(?:{p})', 1)) + 1 END"
_free_year = lambda x: f"regexp_extract({x}, '(?:^|[^A-Za-z0-9])({V.FEED_YEAR})(?:[^A-Za-z0-9]|$)', 1)"
_IGNORED = ", ".join(f"'{w}'" for w in V.FEED_IGNORED)


def _first_spelled(x: str, pattern: str, said: str = "w") -> str:
    """All matches in a lower-cased text, each once, in their order; N/A without any."""
    found = f"regexp_extract_all({x}, '(?i){pattern}')"
    once = f"list_filter({found}, lambda w, i: list_position({found}, w) = i)"
    return f"coalesce(nullif(array_to_string(list_transform({once}, lambda w: {said}), ', '), ''), 'N/A')"


def _joined(x: str) -> str:
    return f"coalesce(nullif(array_to_string(list_sort(list_distinct({x})), ', '), ''), 'N/A')"


@query(f"""WITH {NAMED}, {X.INCOMING}, a AS (SELECT file_id AS id, {_feed_normal(f"array_to_string(list_transform(string_split({_mentions('file_name')}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")} AS name, lower({_mentions('caption')}) AS cap FROM incoming),
s AS (SELECT *, trim(cap || ' ' || lower(name)) AS all_, CASE WHEN {_hit(V.FEED_EPISODES_ONLY)} THEN 1 WHEN {_hit(V.FEED_RANGE)} THEN {_part(V.FEED_RANGE, 1)}::INT WHEN {_hit(V.FEED_SINGLE)} THEN {_part(V.FEED_SINGLE, 1)}::INT WHEN {_hit(V.FEED_NAMED)} THEN {_part(V.FEED_NAMED, 1)}::INT END AS season,
CASE WHEN {_hit(V.FEED_EPISODES_ONLY)} THEN {_part(V.FEED_EPISODES_ONLY, 1)}::INT::VARCHAR || '-' || {_part(V.FEED_EPISODES_ONLY, 2)}::INT::VARCHAR WHEN {_hit(V.FEED_RANGE)} THEN {_part(V.FEED_RANGE, 2)} || '-' || {_part(V.FEED_RANGE, 3)}
WHEN {_hit(V.FEED_SINGLE)} THEN {_part(V.FEED_SINGLE, 2)} WHEN {_hit(V.FEED_NAMED)} THEN {_part(V.FEED_NAMED, 2)} END AS episode FROM a),
y AS (SELECT *, CASE WHEN season IS NULL THEN nullif({_free_year("all_")}, '') END AS year, coalesce({", ".join(_at(p) for p in _FEED_MARKS)}) AS mark,
coalesce({", ".join(f"nullif(regexp_extract(name, '(?i){p}(.*)$', {g}), '')" for p, g in zip(_FEED_MARKS, (4, 3, 3, 3), strict=True))}) AS behind, {_at(V.FEED_QUALITY)} AS quality_at FROM s),
h AS (SELECT *, CASE WHEN season IS NOT NULL THEN concat_ws(' ', name[:greatest(mark - 1, 0)], nullif({_free_year("behind")}, ''))
WHEN year IS NOT NULL THEN CASE WHEN strpos(name, year) > 0 THEN name[:strpos(name, year) + 3] ELSE name END WHEN quality_at > 0 THEN name[:quality_at - 1] ELSE name END AS head FROM y),
b AS (SELECT *, {_feed_normal(f"array_to_string(list_filter(string_split_regex(trim({_feed_normal('head')}), '\\s+'), lambda w: lower(w) NOT IN ({_IGNORED})), ' ')")} AS base FROM h)
SELECT id, CASE WHEN year IS NOT NULL AND strpos(base, year) = 0 THEN base || ' ' || year ELSE base END AS base_name, CASE WHEN season IS NOT NULL THEN '#SERIES' ELSE '#MOVIE' END AS tag, season, episode, year,
{_first_spelled("cap", V.FEED_SOURCE)} AS quality, {_first_spelled("cap", V.FEED_RESOLUTION, "CASE WHEN w = '4k' THEN '4K' ELSE w END")} AS resolution, {_joined(_feed_platforms("all_"))} AS ott_platform,
{_joined(f"list_concat({_feed_said('cap')}, {_feed_said('lower(name)')})")} AS language FROM b""")
def media_info(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.media_info(X.incoming(spark, sf).withColumnRenamed("file_id", "id"))


# ---- streams: the batches of a folder, to its end; what they leave must be what one batch gives


def _arriving(rows: DataFrame, path: str, files: int = 3) -> DataFrame:
    """rows as a stream of several batches, in no order of time: late rows are among them."""
    rows.repartition(files).write.parquet(f"{path}/in")
    return feeds.read_stream(rows.sparkSession, f"{path}/in", rows.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=1)


def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    feeds.rollup_stream(_arriving(X.feed(spark, sf).drop("ts"), path), f"{path}/out", f"{path}/state").awaitTermination()
    return feeds.rollups(spark, f"{path}/out")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    rows = stores.bucketed(_stored(spark, sf))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/store")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/store")
    feeds.ingest(_arriving(X.incoming(spark, sf), path), f"{path}/out", f"{path}/state", stored, in_buckets=True).awaitTermination()
    return feeds.current(spark, f"{path}/out", stored).select("file_id", "file_name", "caption", "category")


def stream_deletes(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    gone = X.table(spark, sf, "part").filter("p_size > 25").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("file_id"))
    feeds.tombstones(_arriving(gone, path), f"{path}/out", f"{path}/state").awaitTermination()
    return feeds.alive(spark, f"{path}/out", X.files(spark, sf)).select("file_id", "store")


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.federate(X.files(spark, sf)).select("file_id", "file_name", "caption", "category")


def _until(rows: DataFrame, end: DataFrame, path: str) -> DataFrame:
    """As _arriving(), and after all others the rows `end`, whose time is past all that is waited for."""
    stream = _arriving(rows, path)
    time.sleep(0.1)  # files come in the order of their times
    end.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return stream


def _left(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """What a stream that was read to its end has put out."""
    feeds.append_to(rows, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def _events_until(spark: SparkSession, sf: str, path: str) -> DataFrame:
    """events as a stream, waited for as long as they are late here, and rows far behind them that end the wait."""
    e = X.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    end = spark.sql("SELECT CAST(-1 AS BIGINT) AS event_id, CAST(-1 AS BIGINT) AS user_id, kind AS event_type, TIMESTAMP_NTZ '2100-01-01' AS ts FROM VALUES ('view'), ('click') AS v(kind)")
    end = end.select(*[F.col(f.name).cast(f.dataType) for f in e.schema])
    return feeds.with_event_time(_until(e, end, path), lateness="100 days")


def stream_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """The bursts of each user, in whatever order the events come: session windows over the stream give what those of one batch give."""
    path = shared_folder(spark)
    out = _left(spark, feeds.debounced(_events_until(spark, sf, path), "user_id", 6 * 3600), path)
    return out.filter("not user_id <=> -1").select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def stream_unanswered(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    events = _events_until(spark, sf, path)
    out = _left(spark, feeds.unanswered_stream(events.filter("event_type = 'view'"), events.filter("event_type = 'click'"), seconds=7200), path)
    return out.filter("user_id >= 0")


@query(f"WITH {X.MEMBERS} SELECT id, e AS expiry_time FROM m0 WHERE e < TIMESTAMP '{X.ORDERS_AS_OF}'")
def stream_expiries(spark: SparkSession, sf: str) -> DataFrame:
    """Memberships that have ended when the watermark reaches the time asked at: each order is a grant, and the last grant of a member counts."""
    path, late = shared_folder(spark), 5000
    days = F.when(F.col("o_orderpriority").startswith("1"), 365).otherwise(30)
    grants = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), (F.col("o_orderdate") + F.make_dt_interval(days)).cast("timestamp_ntz").alias("expiry_time"))
    end = spark.sql(f"SELECT CAST(-1 AS BIGINT) AS id, TIMESTAMP_NTZ '{X.ORDERS_AS_OF}' + INTERVAL '{late}' DAY AS ts, CAST(NULL AS TIMESTAMP_NTZ) AS expiry_time")
    rows = feeds.with_event_time(_until(grants, end.select(*[F.col(f.name).cast(f.dataType) for f in grants.schema]), path), lateness=f"{late} days")
    out = _left(spark, feeds.expiries(rows.withColumn("expiry_time", F.col("expiry_time").cast("timestamp"))), path)
    return out.select("id", F.col("expiry_time").cast("timestamp_ntz").alias("expiry_time"))


def stream_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """A backfill in two runs: the second goes on where the first has stopped."""
    path, came = shared_folder(spark), X.arrivals(spark, sf)
    k = F.when(F.col("file_id").startswith("n"), F.substring("file_id", 2, 8)).otherwise(F.col("file_id")).cast("long")
    messages = came.select(k.alias("id"), "file_id", "file_name", "caption")
    last = messages.agg(F.max("id")).first()[0] or 0
    for upto in (last // 2, last):
        history.backfill(messages, 0, upto, path, f"{path}/state", _stored(spark, sf), step=1000).awaitTermination()
    return history.outcomes(spark, path)


def stream_joins(spark: SparkSession, sf: str) -> DataFrame:
    path, o, li = shared_folder(spark), X.table(spark, sf, "orders"), X.table(spark, sf, "lineitem")
    sent = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), (F.col("l_suppkey") % 7).alias("channel"))
    feeds.join_requests(_arriving(sent, path), f"{path}/out", f"{path}/state").awaitTermination()
    r = feeds.joined(spark, f"{path}/out", "user_id long, channel long").withColumn("joined", F.array_contains("channels", F.lit(5).cast("long")))
    r = mutate.pull_from_set(mutate.add_to_set(r, "channels", F.lit(99).cast("long")), "channels", F.lit(3).cast("long"))
    return r.select("user_id", F.array_join(F.sort_array("channels"), ",").alias("channels"), "joined")


def stream_unsubscribes(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    users = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    gone = X.table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("id"))
    feeds.unsubscribed(_arriving(gone, path), f"{path}/out", f"{path}/state").awaitTermination()
    return feeds.subscribed(spark, f"{path}/out", users)


for _name, _same in (("stream_joins", "join_requests"), ("stream_unsubscribes", "delete_users"), ("stream_backfill", "backfill_counts"), ("stream_rollup", "rollup_sets"), ("stream_ingest", "upsert_snapshot"), ("stream_deletes", "delete_ids"), ("stream_bursts", "debounce_sessions"), ("stream_unanswered", "unanswered_offers")):
    QUERIES[_name] = globals()[_name]
    ORACLES[_name] = ORACLES[_same]
