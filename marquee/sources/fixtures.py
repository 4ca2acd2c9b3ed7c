"""Relations of the catalog derived from the supplied tables, each with the SQL that derives the same rows.

Every relation is a deterministic expression over one scan: no row is invented on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times that queries are asked at: always a literal, never the clock.
EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-01-01 00:00:00"
STOP_PHRASES = ("movie", "please", "send")
STOP_SQL = r"\b(?:please|movie|send)\b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(k: Column, n: int, values: list[str | None]) -> Column:
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(k % n == i, F.lit(v)).otherwise(out)
    return out


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as files (file_id, file_name, file_size, caption, category), each once, with its number k."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    mark = F.when(k % 3 != 0, F.concat(F.lit(" S"), two(F.col("p_size") % 12 + 1), F.lit("E"), two(k % 24 + 1))).otherwise("")
    name = F.concat(
        "p_name", F.lit(" "), (1990 + k % 35).cast("string"), mark, F.lit(" "), _pick(k, 5, ["480p", "720p", "1080p", "2160p", ""]), F.lit(" "),
        _pick(k, 4, ["BluRay", "WEBRip", "HDRip", ""]), F.lit(" "), _pick(k, 7, ["Hindi", "English", "Tamil", "Dual", ""]),
    )
    named = part.select(k.alias("k"), F.lpad(k.cast("string"), 8, "0").alias("file_id"), name.alias("file_name"), (F.round("p_retailprice").cast("long") * (1 << 20)).alias("file_size"))
    caption = F.when(F.col("k") % 11 == 0, F.lit(None).cast("string")).when(F.col("k") % 13 == 0, "").otherwise(F.col("file_name"))
    return named.withColumn("caption", caption).withColumn("category", _pick(F.col("k"), 4, ["movie", "series", "anime", None]))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stores: ids that are in both come twice."""
    named = named_files(spark, sf_dir)
    stores = F.filter(F.array(F.when(F.col("k") % 3 != 2, "primary"), F.when((F.col("k") % 3 == 2) | (F.col("k") % 10 == 0), "secondary")), lambda s: s.isNotNull())
    return named.withColumn("store", F.explode(stores)).drop("k")


FILES = """n AS (SELECT p_partkey AS k, lpad(p_partkey::VARCHAR, 8, '0') AS file_id,
  p_name || ' ' || (1990 + p_partkey % 35)::VARCHAR || CASE WHEN p_partkey % 3 <> 0 THEN ' S' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') || 'E' || lpad((p_partkey % 24 + 1)::VARCHAR, 2, '0') ELSE '' END
  || ' ' || CASE p_partkey % 5 WHEN 0 THEN '480p' WHEN 1 THEN '720p' WHEN 2 THEN '1080p' WHEN 3 THEN '2160p' ELSE '' END
  || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'BluRay' WHEN 1 THEN 'WEBRip' WHEN 2 THEN 'HDRip' ELSE '' END
  || ' ' || CASE p_partkey % 7 WHEN 0 THEN 'Hindi' WHEN 1 THEN 'English' WHEN 2 THEN 'Tamil' WHEN 3 THEN 'Dual' ELSE '' END AS file_name,
  round(p_retailprice)::BIGINT * 1048576 AS file_size FROM part),
named AS (SELECT *, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '' ELSE file_name END AS caption,
  CASE k % 4 WHEN 0 THEN 'movie' WHEN 1 THEN 'series' WHEN 2 THEN 'anime' END AS category FROM n),
files AS (SELECT * EXCLUDE (k), 'primary' AS store FROM named WHERE k % 3 <> 2
  UNION ALL SELECT * EXCLUDE (k), 'secondary' AS store FROM named WHERE k % 3 = 2 OR k % 10 = 0),
catalog AS (SELECT * FROM files WHERE store = 'primary' UNION ALL SELECT * FROM files WHERE store = 'secondary' AND file_id NOT IN (SELECT file_id FROM files WHERE store = 'primary'))"""


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, text, count): what users searched for, some of it with marks and capitals."""
    e = table(spark, sf_dir, "events")
    bucket = F.floor("value").cast("long")
    text = F.concat("event_type", F.lit(" "), bucket.cast("string"))
    text = F.when(bucket % 7 == 0, F.concat(text, F.lit("!"))).when(bucket % 5 == 0, F.upper(text)).otherwise(text)
    return e.filter("value is not null and event_type is not null").select("user_id", text.alias("text")).groupBy("user_id", "text").agg(F.count("*").alias("count"))


SEARCH_LOG = """l0 AS (SELECT user_id, event_type || ' ' || floor(value)::BIGINT::VARCHAR AS t, floor(value)::BIGINT AS b FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
search_log AS (SELECT user_id, CASE WHEN b % 7 = 0 THEN t || '!' WHEN b % 5 = 0 THEN upper(t) ELSE t END AS text, count(*) AS count FROM l0 GROUP BY ALL)"""


def nested_search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, searches array<struct<text, count>>): the log as it is kept."""
    return search_log(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct("text", "count")).alias("searches"))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "ts")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, expiry_time): the latest expiry of each customer; null where the number is divisible by 17."""
    o = table(spark, sf_dir, "orders")
    days = F.when(F.col("o_orderpriority").startswith("1"), 365).otherwise(30)
    latest = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.col("o_orderdate") + F.make_dt_interval(days)).alias("expiry_time"))
    return latest.withColumn("expiry_time", F.when(F.col("id") % 17 != 0, F.col("expiry_time")))


MEMBERS = """m0 AS (SELECT o_custkey AS id, max(o_orderdate + CASE WHEN starts_with(o_orderpriority, '1') THEN INTERVAL 365 DAY ELSE INTERVAL 30 DAY END) AS e FROM orders GROUP BY 1),
members AS (SELECT id, CASE WHEN id % 17 <> 0 THEN e END AS expiry_time FROM m0)"""


def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, first, second, third): the latest view, click and signup of each user."""
    last = lambda kind, name: F.max(F.when(F.col("event_type") == kind, F.col("ts"))).alias(name)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last("view", "first"), last("click", "second"), last("signup", "third"))


VERIFICATION = """verification AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS first, max(ts) FILTER (event_type = 'click') AS second,
  max(ts) FILTER (event_type = 'signup') AS third FROM events GROUP BY user_id)"""


def bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.filter("c_custkey % 23 = 0").select(F.col("c_custkey").alias("id"), F.struct(F.lit(True).alias("is_banned"), F.lit("spam").alias("ban_reason")).alias("ban_status"))


def group_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, settings): what groups have set, sparse."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    own = F.map_filter(F.create_map(F.lit("button"), F.when(k % 2 == 0, "false"), F.lit("welcome"), F.when(k % 3 == 0, "true")), lambda _, v: v.isNotNull())
    return n.select(k.cast("long").alias("id"), own.alias("settings"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, file_name, caption): a batch to ingest, a third new, a third with another caption, a third as stored; some mentions and marks."""
    f = named_files(spark, sf_dir)
    k = F.col("k")
    new_id = F.when(k % 3 == 0, F.concat(F.lit("n"), "file_id")).otherwise(F.col("file_id"))
    name = F.concat(F.lit("@team "), F.regexp_replace("file_name", " ", "_"))
    caption = F.when(k % 3 == 1, F.concat(F.col("file_name"), F.lit(" v2"))).otherwise(F.col("caption"))
    return f.select(new_id.alias("file_id"), name.alias("file_name"), caption.alias("caption"))


INCOMING = """incoming AS (SELECT CASE WHEN k % 3 = 0 THEN 'n' || file_id ELSE file_id END AS file_id, '@team ' || replace(file_name, ' ', '_') AS file_name,
  CASE WHEN k % 3 = 1 THEN file_name || ' v2' ELSE caption END AS caption FROM named)"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incoming() with seq: the order in which its rows come."""
    k = F.when(F.col("file_id").startswith("n"), F.substring("file_id", 2, 8)).otherwise(F.col("file_id")).cast("long")
    return incoming(spark, sf_dir).withColumn("seq", k * 7919 % 100003)


ARRIVALS = INCOMING.replace("incoming AS (SELECT", "arrivals AS (SELECT k * 7919 % 100003 AS seq,", 1)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the live feed, one per file: (base_name, filename, season, episode, quality, resolution, language, ott_platform, tag, ts)."""
    f = named_files(spark, sf_dir)
    k = F.col("k")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("base_name"), "p_size")
    e = (F.col("p_size") % 9 + 1).cast("string")
    episode = F.when(k % 10 == 1, F.concat(e, F.lit("-"), (F.col("p_size") % 9 + 3).cast("string"))).when(k % 3 != 0, e)
    return f.join(p, "k").select(
        "base_name", F.col("file_name").alias("filename"), F.when(k % 3 != 0, (k % 3).cast("int")).alias("season"), episode.alias("episode"),
        _pick(k, 4, ["BluRay", "WEBRip, HEVC", "N/A", "1080p WEB-DL"]).alias("quality"), _pick(k, 5, ["480p", "720p", "1080p, 4K", "N/A", None]).alias("resolution"),
        _pick(k, 3, ["Hindi, Tamil", "English", "N/A"]).alias("language"), _pick(k, 6, ["Netflix | Aha", "Zee5", "N/A"]).alias("ott_platform"),
        F.when(k % 3 != 0, "#SERIES").otherwise("#MOVIE").alias("tag"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * 7 % 3600).cast("decimal(18,6)"))).alias("ts"),
    )


FEED = """feed AS (SELECT p_name AS base_name, file_name AS filename, CASE WHEN k % 3 <> 0 THEN (k % 3)::INT END AS season,
  CASE WHEN k % 10 = 1 THEN (p_size % 9 + 1)::VARCHAR || '-' || (p_size % 9 + 3)::VARCHAR WHEN k % 3 <> 0 THEN (p_size % 9 + 1)::VARCHAR END AS episode,
  CASE k % 4 WHEN 0 THEN 'BluRay' WHEN 1 THEN 'WEBRip, HEVC' WHEN 2 THEN 'N/A' ELSE '1080p WEB-DL' END AS quality,
  CASE k % 5 WHEN 0 THEN '480p' WHEN 1 THEN '720p' WHEN 2 THEN '1080p, 4K' WHEN 3 THEN 'N/A' END AS resolution,
  CASE k % 3 WHEN 0 THEN 'Hindi, Tamil' WHEN 1 THEN 'English' ELSE 'N/A' END AS language,
  CASE k % 6 WHEN 0 THEN 'Netflix | Aha' WHEN 1 THEN 'Zee5' ELSE 'N/A' END AS ott_platform,
  CASE WHEN k % 3 <> 0 THEN '#SERIES' ELSE '#MOVIE' END AS tag FROM named JOIN part ON k = p_partkey)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, said): what users might type for each named file, its marks in many spellings."""
    k, name = F.col("k"), F.col("file_name")
    spelled = _pick(k, 7, ["season 2 episode 3", "Season3Episode12", "s4 ep 5", "1x02", "season 6", "episode 7", "S01.E09"])
    ending = _pick(k, 5, [" all episodes", " movie", " 2019 please", " s08", ""])
    return named_files(spark, sf_dir).select("file_id", F.concat(name, F.lit("  "), spelled, F.lit(", "), ending).alias("said"))


ASKED_SQL = """(file_name || '  ' || ['season 2 episode 3', 'Season3Episode12', 's4 ep 5', '1x02', 'season 6', 'episode 7', 'S01.E09'][k % 7 + 1] || ', '
  || [' all episodes', ' movie', ' 2019 please', ' s08', ''][k % 5 + 1])"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, text): chat messages, some with links, mentions of the admin and language words."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    n = F.col("conv_id") * 100 + F.col("turn")
    text = F.when(n % 5 == 0, "see https://example.com/a").when(n % 5 == 1, "@admin please add this").when(n % 5 == 2, "hindi movie").when(n % 5 == 3, F.lit("iron man")).otherwise(F.concat(F.lit("title "), (F.col("conv_id") % 4).cast("string")))
    return c.select(n.alias("id"), F.col("conv_id").alias("user_id"), text.alias("text"))


MESSAGES = """messages AS (SELECT conv_id * 100 + turn AS id, conv_id AS user_id, CASE (conv_id * 100 + turn) % 5 WHEN 0 THEN 'see https://example.com/a' WHEN 1 THEN '@admin please add this'
  WHEN 2 THEN 'hindi movie' WHEN 3 THEN 'iron man' ELSE 'title ' || (conv_id % 4)::VARCHAR END AS text FROM conversations WHERE role = 'user')"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, event_id, text): the texts that users sent, in time."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", F.col("event_type").alias("text"))


def loosely_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, said): parts of titles, whole titles with doubled letters, and titles with more words; of each part one."""
    k, name = F.col("p_partkey"), F.col("p_name")
    piece = F.substr(name, (k % 4 + 1).cast("int"), (k % 9 + 1).cast("int"))
    said = F.when(k % 3 == 0, piece).when(k % 3 == 1, F.replace(name, F.lit("l"), F.lit("ll"))).otherwise(F.concat(F.lit("all of "), name, F.lit(" "), (k % 12).cast("string")))
    return table(spark, sf_dir, "part").select(k.alias("id"), said.alias("said"))


LOOSELY_SQL = """CASE p_partkey % 3 WHEN 0 THEN substr(p_name, p_partkey % 4 + 1, p_partkey % 9 + 1) WHEN 1 THEN replace(p_name, 'l', 'll') ELSE 'all of ' || p_name || ' ' || (p_partkey % 12)::VARCHAR END"""


def mistyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, said): titles with a letter left out, one doubled, without the space, or with two swapped words; of each part one."""
    k, name = F.col("p_partkey"), F.col("p_name")
    at = (k % F.length(name)).cast("int")
    cut = F.concat(F.substr(name, F.lit(1), at), F.substr(name, at + 2, F.length(name)))
    doubled = F.concat(F.substr(name, F.lit(1), at), F.substr(name, at, F.length(name)))
    swapped = F.concat(F.substring_index(name, " ", -1), F.lit(" "), F.substring_index(name, " ", 1))
    said = F.when(k % 4 == 0, cut).when(k % 4 == 1, doubled).when(k % 4 == 2, F.replace(name, F.lit(" "), F.lit(""))).otherwise(swapped)
    return table(spark, sf_dir, "part").select(k.alias("id"), said.alias("said"))


MISTYPED_SQL = """CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2)
  WHEN 1 THEN substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, greatest(p_partkey % length(p_name), 1)) WHEN 2 THEN replace(p_name, ' ', '') ELSE split_part(p_name, ' ', -1) || ' ' || split_part(p_name, ' ', 1) END"""


def outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, place): titles as an outside source may suggest them, in several spellings; of each part one."""
    k, name = F.col("p_partkey"), F.initcap("p_name")
    title = F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, F.concat(name, F.lit(" ("), (1990 + k % 7).cast("string"), F.lit(")"))).otherwise(name)
    return table(spark, sf_dir, "part").select(title.alias("title"), k.cast("int").alias("place"))


_CAPITALS = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
OUTSIDE = f"outside AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN {_CAPITALS} || ' (' || (1990 + p_partkey % 7)::VARCHAR || ')' ELSE {_CAPITALS} END AS title, p_partkey::INT AS place FROM part)"
