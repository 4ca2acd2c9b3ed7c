"""Redeem codes: claims resolved in the order of time, all codes and users at once.

A claim fails if its user is a member then, or if its code is used; both may follow from earlier claims.
A claim that is the first open one both of its code and of its user depends on nothing open, so it succeeds; then the code's
other claims and the user's claims during the new membership are closed. Rounds of this close all
claims. A round is two aggregations and two joins, and what it leaves is written, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored


def granted(codes: DataFrame, claims: DataFrame, members: DataFrame) -> DataFrame:
    """(claim_id, user_id, code_hash, at, until): the claims that succeed.

    codes: (code_hash, seconds), each once; claims: (claim_id, user_id, code_hash, at), in the order of at, then claim_id;
    members: (id, expiry_time) before all claims. Claims with a null user, code or time never succeed.
    """
    rows = claims.join(codes.filter("seconds > 0").select("code_hash", "seconds"), "code_hash")
    rows = rows.join(members.select(F.col("id").alias("user_id"), "expiry_time"), "user_id", "left").filter("user_id is not null and at is not null and (expiry_time is null or expiry_time <= at)")
    until = F.expr("at + make_dt_interval(0, 0, 0, seconds)")
    left = stored(rows.select("claim_id", "user_id", "code_hash", "at", until.alias("until")))
    done = left.limit(0)
    row = F.struct("at", "claim_id", "user_id", "code_hash", "until")
    while not left.isEmpty():
        of_code = left.groupBy("code_hash").agg(F.min(row).alias("r")).select("r.*")
        of_user = left.groupBy("user_id").agg(F.min(F.struct("at", "claim_id")).alias("r")).select("r.claim_id")
        won = stored(of_code.join(of_user, "claim_id").select(*left.columns))
        over = won.select("user_id", F.col("until").alias("closed"))
        left = left.join(won.select("code_hash"), "code_hash", "left_anti").join(over, "user_id", "left").filter("closed is null or at >= closed").select(*done.columns)
        left, done = stored(left), done.union(won)
    return stored(done)


def claim_status(codes: DataFrame, claims: DataFrame, members: DataFrame, won: DataFrame) -> DataFrame:
    """(claim_id, status) of every claim: member, invalid, used or ok, the first that fits. won: what granted() has."""
    w = won.select(F.col("user_id").alias("by"), F.col("at").alias("since"), F.col("until"), F.col("claim_id").alias("by_claim"))
    rows = claims.join(members.select(F.col("id").alias("user_id"), "expiry_time"), "user_id", "left")
    paid = rows.join(w, (F.col("user_id") == F.col("by")) & ((F.col("since") < F.col("at")) | (F.col("since") == F.col("at")) & (F.col("by_claim") < F.col("claim_id"))) & (F.col("until") > F.col("at")), "left_semi").select("claim_id", F.lit(True).alias("paid"))
    rows = rows.join(paid, "claim_id", "left").join(codes.filter("seconds > 0").select("code_hash", F.lit(True).alias("valid")), "code_hash", "left").join(won.select("claim_id", F.lit(True).alias("ok")), "claim_id", "left")
    status = F.when(F.coalesce("paid", F.lit(False)) | F.coalesce(F.col("expiry_time") > F.col("at"), F.lit(False)), "member").when(F.col("valid").isNull(), "invalid").when(F.col("ok").isNull(), "used").otherwise("ok")
    return rows.select("claim_id", status.alias("status"))


def listed(codes: DataFrame, won: DataFrame) -> DataFrame:
    """(code_hash, seconds, used, user_id): all codes, with who has used them."""
    return codes.join(won.select("code_hash", "user_id"), "code_hash", "left").select("code_hash", "seconds", F.col("user_id").isNotNull().alias("used"), "user_id")


def added(codes: DataFrame, new: DataFrame) -> DataFrame:
    """codes with new ones (code, duration in seconds), by their hashes; codes without a duration are none, and a code that is there stays as it is."""
    rows = new.filter("seconds > 0").select(F.sha2("code", 256).alias("code_hash"), "seconds").groupBy("code_hash").agg(F.max("seconds").alias("seconds"))
    return codes.select("code_hash", "seconds").unionByName(rows.join(codes.select("code_hash"), "code_hash", "left_anti"))
