"""What users do: searches, quotas, memberships, verification, referrals, and the decision to send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vocab as V

#: Fixed value: the zone of days.
ZONE = "Asia/Kolkata"


def trending(log: DataFrame, limit: int | None = None) -> DataFrame:
    """(text, count) of a nested log (user_id, searches), from the most searched, ties by text."""
    flat = log.select(F.explode("searches").alias("s")).groupBy("s.text").agg(F.sum("s.count").alias("count"))
    return flat.orderBy(F.desc("count"), "text").limit(limit) if limit else flat


def trending_clean(log: DataFrame, limit: int = 20) -> DataFrame:
    """(place, label, count): of the top texts those of letters, digits and blanks, each once whatever its case, shortened.

    The limit comes before the rules, so fewer rows may be left.
    """
    top = trending(log, limit)
    first = Window.partitionBy(F.lower("text")).orderBy(F.desc("count"), "text")
    kept = top.filter(F.col("text").rlike(V.SEARCHABLE)).withColumn("n", F.row_number().over(first)).filter("n = 1")
    place = F.row_number().over(Window.orderBy(F.desc("count"), "text"))  # of at most `limit` rows
    return kept.select(place.alias("place"), text.short_label(F.col("text")).alias("label"), "count")


def quota_day(ts: Column, zone: str = ZONE) -> Column:
    """The day that a download counts for: days end at 23:59 in the zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone) + F.expr("INTERVAL 1 MINUTE"))


def quota_usage(downloads: DataFrame) -> DataFrame:
    return downloads.groupBy("user_id", quota_day(F.col("ts")).alias("day")).agg(F.count("*").alias("used"))


def quota_left(downloads: DataFrame, as_of: str, limit: int = V.FREE_FILES) -> DataFrame:
    """(user_id, used, remaining) on the quota day of as_of, of users that downloaded anything ever."""
    today = quota_day(F.lit(as_of).cast("timestamp"))
    used = F.count(F.when(quota_day(F.col("ts")) == today, 1))
    return downloads.groupBy("user_id").agg(used.alias("used")).withColumn("remaining", F.greatest(F.lit(0), limit - F.col("used")))


def counters(increments: DataFrame, resets: DataFrame) -> DataFrame:
    """(user_id, count): each user's increments (user_id, ts) after the last reset (user_id, ts) of that user or, with a null user, of all.

    Resets of all are a few times, of which the last counts; a user who was reset and has no later increment counts 0.
    """
    last = resets.filter("user_id is not null").groupBy("user_id").agg(F.max("ts").alias("own"))
    every = resets.filter("user_id is null").agg(F.max("ts")).first()[0]
    rows = increments.select("user_id", "ts").join(last, "user_id", "full_outer")
    since = F.greatest("own", F.lit(every).cast(increments.schema["ts"].dataType))
    return rows.groupBy("user_id").agg(F.count(F.when(since.isNull() | (F.col("ts") > since), F.col("ts"))).alias("count"))


def active(members: DataFrame, as_of: str) -> DataFrame:
    return members.filter(F.col("expiry_time") > F.lit(as_of).cast("timestamp_ntz"))


def expired(members: DataFrame, as_of: str) -> DataFrame:
    return members.filter(F.col("expiry_time") < F.lit(as_of).cast("timestamp_ntz"))


def time_left(members: DataFrame, as_of: str) -> DataFrame:
    """(id, days, hours, minutes) that active members have left."""
    s = F.unix_seconds(F.col("expiry_time").cast("timestamp")) - F.unix_seconds(F.lit(as_of).cast("timestamp"))
    return active(members, as_of).select("id", F.floor(s / 86400).alias("days"), (F.floor(s / 3600) % 24).alias("hours"), (F.floor(s / 60) % 60).alias("minutes"))


def swept(members: DataFrame, as_of: str) -> DataFrame:
    """The members after the sweep: who has expired has null."""
    return members.withColumn("expiry_time", F.when(F.col("expiry_time") >= F.lit(as_of).cast("timestamp_ntz"), F.col("expiry_time")))


def user_members(users: DataFrame, members: DataFrame) -> DataFrame:
    """Users with a membership and its expiry."""
    return users.join(members.filter("expiry_time is not null"), "id")


def verification_state(stamps: DataFrame, as_of: str, gap_seconds: int = V.VERIFY_GAP_SECONDS) -> DataFrame:
    """(user_id, verified, second_due, third_due) of (user_id, first, second, third) at as_of.

    A step counts until midnight in the zone; the next one is due when the gap has passed since and it
    is not done after it. A step that was never taken is older than all.
    """
    local = F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), ZONE)
    midnight = F.to_utc_timestamp(F.date_trunc("day", local), ZONE).cast("timestamp_ntz")
    now, gap = F.lit(as_of).cast("timestamp_ntz"), F.make_dt_interval(secs=F.lit(float(gap_seconds)).cast("decimal(18,6)"))
    done = lambda c: F.coalesce(F.col(c) >= midnight, F.lit(False))

    def due(before: str, after: str) -> Column:
        return done(before) & (now - F.col(before) > gap) & F.coalesce(F.col(after) < F.col(before), F.lit(True))

    return stamps.select("user_id", done("first").alias("verified"), due("first", "second").alias("second_due"), due("second", "third").alias("third_due"))


def referral_points(referrals: DataFrame) -> DataFrame:
    """(user_id, points, grants): ten points each; at a hundred they go back to 0 and grant thirty days."""
    n = F.col("n") * V.REFERRAL_POINTS
    return referrals.select("user_id", (n % V.REFERRAL_GOAL).alias("points"), F.floor(n / V.REFERRAL_GOAL).alias("grants"))


def entitlement(users: DataFrame, members: DataFrame, usage: DataFrame, state: DataFrame, joined: DataFrame, as_of: str, limit: int = V.FREE_FILES, verify: bool = True) -> DataFrame:
    """(user_id, decision): join, send or verify.

    users (user_id); members (id, expiry_time); usage (user_id, used); state from verification_state();
    joined (user_id): who is in the channels that are asked for. Paid users are sent all; others must have
    joined, are sent files while the quota lasts, then while they are verified.
    """
    paid = active(members, as_of).select(F.col("id").alias("user_id"), F.lit(True).alias("paid"))
    rows = users.join(paid, "user_id", "left").join(usage.select("user_id", "used"), "user_id", "left").join(state, "user_id", "left")
    rows = rows.join(joined.select("user_id", F.lit(True).alias("in_channel")), "user_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    ask = no("verified") | ~no("second_due") | ~no("third_due")
    decision = F.when(~no("paid"), "send").when(no("in_channel"), "join").when(F.coalesce("used", F.lit(0)) < limit, "send").when(ask if verify else F.lit(False), "verify").otherwise("send")
    return rows.select("user_id", decision.alias("decision"))


def without_banned(users: DataFrame, bans: DataFrame, key: str = "id") -> DataFrame:
    return users.join(bans.filter("ban_status.is_banned").select(key), key, "left_anti")


def merged_settings(groups: DataFrame, defaults: tuple[tuple[str, str], ...] = V.GROUP_DEFAULTS) -> DataFrame:
    """(id, name, value): each group's settings over the defaults, in long form."""
    base = F.create_map(*[F.lit(x) for kv in defaults for x in kv])
    own = F.coalesce("settings", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
    return groups.select("id", F.explode(merged).alias("name", "value"))


def store_stats(files: DataFrame, users: DataFrame, groups: DataFrame, members: DataFrame, as_of: str) -> DataFrame:
    """(what, value): counts of users, groups and active members, and files and bytes of each store."""
    one = lambda df, what: df.agg(F.count("*").alias("value")).select(F.lit(what).alias("what"), "value")
    sizes = files.groupBy("store").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))
    per = sizes.select(F.explode(F.array(F.struct(F.concat(F.lit("files "), "store").alias("what"), F.col("n").alias("value")), F.struct(F.concat(F.lit("bytes "), "store").alias("what"), F.col("bytes").alias("value")))).alias("x")).select("x.*")
    return one(users, "users").union(one(groups, "groups")).union(one(active(members, as_of), "active members")).union(per)


def count_outcomes(rows: DataFrame, outcome: str = "status") -> DataFrame:
    return rows.groupBy(F.col(outcome).alias("status")).agg(F.count("*").alias("n"))


def counted(events: DataFrame) -> DataFrame:
    """(user_id, text, count) of appended searches (user_id, text): what a counter per user and text would hold."""
    return events.groupBy("user_id", "text").agg(F.count("*").alias("count"))


#: Kinds of media and types of content that are kept.
MEDIA, TYPES = ("video", "document"), ("video/mp4", "video/x-matroska")


def gate(posts: DataFrame) -> DataFrame:
    """posts (id, is_empty, media, mime_type) with their status: deleted, no media, unsupported or accepted."""
    known = F.col("media").isin(*MEDIA) & F.coalesce(F.col("mime_type").isin(*TYPES), F.lit(False))
    status = F.when(F.col("is_empty"), "deleted").when(F.col("media").isNull(), "no media").when(~known, "unsupported").otherwise("accepted")
    return posts.withColumn("status", status)


def limit_of(said: str | None, default: int) -> int:
    """A limit that a user typed: the default without one, -1 for what is no number."""
    if said is None or not said.strip():
        return default
    return int(said) if said.strip().lstrip("-").isdigit() else -1


def route(messages: DataFrame) -> DataFrame:
    """(id, route) of chat messages: search, command, link, admin."""
    low = F.lower("text")
    named = F.lit(False)
    for lang in ("hindi", "tamil", "telugu", "malayalam", "kannada", "english", "gujarati"):
        named = named | low.contains(lang)
    kind = F.when(named, "search").when(F.col("text").startswith("/"), "command").when(F.col("text").rlike(r"https?://\S+|www\.\S+|t\.me/\S+"), "link")
    return messages.select("id", kind.when(low.contains("@admin"), "admin").otherwise("search").alias("route"))


def new_requests(requests: DataFrame) -> DataFrame:
    """The requests that differ from the last one of their user."""
    last = F.lag("text").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return requests.withColumn("last", last).filter(~F.col("text").eqNullSafe(F.col("last"))).drop("last")


def unanswered(offers: DataFrame, clicks: DataFrame, seconds: int = 120) -> DataFrame:
    """The offers (user_id, ts, event_id) without a click of their user in the seconds after; hours are the join's second key, so no user's rows all meet."""
    hour = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / (seconds * 1_000_000)).alias("slot")
    o = offers.select("user_id", "event_id", "ts", F.explode(F.array(hour(F.col("ts")), hour(F.col("ts")) + 1)).alias("slot"))
    c = clicks.select(F.col("user_id"), F.col("ts").alias("clicked"), hour(F.col("ts")))
    hit = o.join(c, ["user_id", "slot"]).filter((F.col("clicked") >= F.col("ts")) & (F.unix_micros(F.col("clicked").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= seconds * 1_000_000))
    return offers.join(hit.select("event_id").distinct(), "event_id", "left_anti")


def redeem(codes: DataFrame, used: DataFrame, code: str) -> DataFrame:
    """(code_hash, duration, status) of a code: ok, used or unknown rows none."""
    hashed = F.sha2(F.lit(code), 256)
    return codes.filter(F.col("code_hash") == hashed).join(used.withColumn("gone", F.lit(True)), "code_hash", "left").select("code_hash", "duration", F.when(F.col("gone"), "used").otherwise("ok").alias("status"))
