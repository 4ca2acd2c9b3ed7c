"""Golden record survivorship by ignore-null first values (operator 12).

Two sorted windows over the records of a cluster, RECENT and TRUSTED, fill the fields: each field is the
first value over an unbounded frame that isn't null. Name and address rank records by a measure of their
own and reuse the place in TRUSTED to break ties.

A window holds all rows of its key in one task, so a cluster of more than group_rows records is first
reduced: its records are dealt over salted groups, the same windows run in each group, and only records
that supply some field there stay. What wins in the whole cluster wins in its group, so nothing is lost.
The reduction is repeated, on such clusters only, until each fits in one group. Rows are equal in all
fields only once per cluster then (copies are counted), so copies can't meet in one group either.
Nothing is broadcast: joins are by cluster, of two shuffled sides, which adaptive execution can split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import written

#: Sources by falling trust; all others, and none, come after them.
TRUST = ("partner", "store", "web", "crm")
STALE_AFTER = "INTERVAL '30' DAY"
#: Records of a cluster that one task sorts.
GROUP_ROWS = 128
#: The most records of a group that supply a field: by segment, email, name and address.
WINNERS = 4

BLANK = r"^[\x20\x09-\x0D]*$"
TEXTS = ("source", "name", "email", "city", "segment")
OTHERS = ("client_id", "updated_at", "nation_id", "balance")


def _cleaned(clients: DataFrame) -> DataFrame:
    """(cluster, r): the record r of each row, with null for blank strings and for balances that aren't finite."""
    col = lambda c: F.col(f"`{c}`")
    text = lambda c: F.when(~F.regexp_like(col(c), F.lit(BLANK)), col(c)).alias(c)
    rows = clients.select(F.coalesce(col("master_id"), col("client_id")).alias("cluster"), *[col(c) for c in OTHERS], *[text(c) for c in TEXTS])
    finite = F.abs("balance") < F.lit(math.inf)
    rows = rows.withColumn("balance", F.when(finite, F.col("balance").cast("double")))
    trust = F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for k, s in enumerate(TRUST)], F.lit(len(TRUST)))
    filled = F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")
    fields = [trust.alias("trust"), filled.alias("filled"), *[F.col(c) for c in (*OTHERS, *TEXTS) if c != "source"]]
    return rows.select("cluster", F.struct(*fields).alias("r"))


def _recent() -> list[Column]:
    """The order RECENT; the record itself makes it total."""
    return [F.col("r.updated_at").desc_nulls_last(), F.col("r.trust"), F.col("r.client_id").asc_nulls_last(), F.col("r")]


def _filled(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: the record that supplies each field, the first of TRUSTED, and sums of copies and stale copies."""
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    group = Window.partitionBy(*key)
    recent, trusted = group.orderBy(*_recent()), group.orderBy("stale", "r.trust", *_recent())
    first = lambda field, order: F.first(F.when(F.col(f"r.{field}").isNotNull(), F.col("r")), ignorenulls=True).over(order.rowsBetween(*whole))
    rows = rows.withColumns({"by_segment": first("segment", recent), "by_email": first("email", trusted), "place": F.row_number().over(trusted)})
    longest = F.when(F.col("r.name").isNotNull(), F.struct(-F.length("r.name"), F.col("place")))
    fullest = F.struct(-F.col("r.filled"), F.col("place"))
    sums = {f"{c}_all": F.sum(c).over(group) for c in ("copies", "stale_copies")}
    rows = rows.withColumns({"by_name": F.min_by("r", longest).over(group), "by_address": F.min_by("r", fullest).over(group), **sums})
    return rows.filter("place = 1").drop("place", "copies", "stale_copies").withColumnsRenamed({"copies_all": "copies", "stale_copies_all": "stale_copies"})


def _winners(rows: DataFrame) -> DataFrame:
    """The records of each salted group that supply a field, once each; the first carries the group's sums."""
    out = _filled(rows, ["cluster", "salt"])
    records = F.array_distinct(F.filter(F.array("by_segment", "by_email", "by_name", "by_address"), lambda r: r.isNotNull()))
    out = out.select("cluster", "latest", "n", "copies", "stale_copies", F.posexplode(records).alias("at", "r"))
    only = lambda c: F.when(F.col("at") == 0, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
    return _aged(out.select("cluster", "r", "latest", "n", only("copies"), only("stale_copies")))


def _aged(rows: DataFrame) -> DataFrame:
    """With stale: whether the record has no time, or one too long before its cluster's latest."""
    fresh = F.coalesce(F.col("r.updated_at") >= F.col("latest") - F.expr(STALE_AFTER), F.lit(False))
    return rows.withColumn("stale", ~fresh)


def _first_balance(rows: DataFrame, key: list[str]) -> DataFrame:
    order = Window.partitionBy(*key).orderBy("other", *_recent())
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def _reduced(rows: DataFrame, most: int, group_rows: int, step, winners: int) -> DataFrame:
    """rows, with the clusters of more than group_rows (n: an upper bound of their rows; most: the largest) reduced by step over salted groups until they have no more."""
    while most > group_rows:
        large = F.col("n") > group_rows
        pieces = F.ceil(F.col("n") / group_rows).cast("long")
        hot = rows.filter(large).withColumn("salt", F.pmod(F.xxhash64("r", F.lit(most)), pieces))
        less = step(hot).withColumn("n", F.ceil(F.col("n") / group_rows).cast("long") * winners)
        rows = written(rows.filter(~large).unionByName(less.select(*rows.columns)))
        most = -(-most // group_rows) * winners
    return rows


def golden_records(clients: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One record for each cluster_id (master_id, or client_id where that is null).

    clients: client_id, master_id, source, updated_at, name, email, city, nation_id, segment, balance;
    other columns are ignored. Blank strings are null, sources that aren't listed are trusted least, and
    a balance that is NaN or infinite is null. Rows with neither id are one cluster, whose id is null.
    Records that tie in an order (equal or null client_id) are ordered by all their fields; rows equal
    in all fields are counted each. An empty table gives no rows. group_rows: records that one task
    sorts, 2 * WINNERS at least; it doesn't change the result.
    """
    group_rows = max(group_rows, 2 * WINNERS)  # with fewer, a reduction might not reduce
    rows = _cleaned(clients)
    # both sides of the join are shuffled by cluster only, so adaptive execution can split a large cluster
    stats = written(rows.groupBy("cluster").agg(F.max("r.updated_at").alias("latest"), F.count("*").alias("n")))
    most = stats.agg(F.max("n")).first()[0] or 0
    records = rows.groupBy("cluster", "r").agg(F.count("*").alias("copies")).withColumnRenamed("cluster", "of")
    records = records.hint("merge").join(stats, F.col("of").eqNullSafe(F.col("cluster"))).drop("of")
    records = _aged(records).withColumn("stale_copies", F.when(F.col("stale"), F.col("copies")).otherwise(F.lit(0)).cast("long"))
    records = written(records)
    reduced = _reduced(records, most, group_rows, _winners, WINNERS)
    filled = written(_filled(reduced, ["cluster"]).withColumn("segment", F.col("by_segment.segment")).drop("r", "stale", "n", "latest"))
    priced = records.filter("r.balance is not null").select("cluster", "r", "n").withColumnRenamed("cluster", "of")
    chosen = filled.select("cluster", "segment")
    priced = written(priced.hint("merge").join(chosen, F.col("of").eqNullSafe(F.col("cluster"))).select("cluster", "r", "n", (~F.col("r.segment").eqNullSafe(F.col("segment"))).alias("other")))
    balances = _reduced(priced, most, group_rows, lambda hot: _first_balance(hot, ["cluster", "salt"]).drop("salt"), 1)
    balances = written(_first_balance(balances, ["cluster"]).select(F.col("cluster").alias("of"), F.col("r").alias("by_balance")))
    out = filled.hint("merge").join(balances, F.col("of").eqNullSafe(F.col("cluster")), "left")
    cents = F.floor(100 * F.col("by_balance.balance") + 0.5).cast("long")
    of_address = F.when(F.col("by_address.filled") > 0, F.col("by_address.client_id"))
    return out.select(
        F.col("cluster").alias("cluster_id"), F.col("copies").alias("n_records"), F.col("stale_copies").alias("n_stale"), F.col("by_name.name").alias("name"), F.col("by_email.email").alias("email"),
        "segment", F.col("by_address.city").alias("city"), F.col("by_address.nation_id").alias("nation_id"), cents.alias("balance_cents"), F.col("by_name.client_id").alias("name_from"),
        F.col("by_email.client_id").alias("email_from"), F.col("by_segment.client_id").alias("segment_from"), F.col("by_balance.client_id").alias("balance_from"), of_address.alias("address_from"),
    )


#: DuckDB SQL of op12.
GOLDEN_SQL = r"""
WITH c AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id, balance, CASE source WHEN 'partner' THEN 0 WHEN 'store' THEN 1 WHEN 'web' THEN 2 WHEN 'crm' THEN 3 ELSE 4 END AS trust,
  CASE WHEN NOT regexp_full_match(name, '[\x20\x09-\x0D]*') THEN name END AS name, CASE WHEN NOT regexp_full_match(email, '[\x20\x09-\x0D]*') THEN email END AS email,
  CASE WHEN NOT regexp_full_match(city, '[\x20\x09-\x0D]*') THEN city END AS city, CASE WHEN NOT regexp_full_match(segment, '[\x20\x09-\x0D]*') THEN segment END AS segment FROM clients),
l AS (SELECT *, max(updated_at) OVER (PARTITION BY cluster_id) AS latest FROM c),
s AS (SELECT *, updated_at IS NULL OR updated_at < latest - INTERVAL 720 HOUR AS stale FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY updated_at DESC NULLS LAST, trust, client_id NULLS LAST) AS recent FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY stale, trust, recent) AS trusted, (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS filled FROM r),
f AS (SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale, arg_min(struct_pack(v := segment, id := client_id), recent) FILTER (segment IS NOT NULL) AS s,
  arg_min(struct_pack(v := email, id := client_id), trusted) FILTER (email IS NOT NULL) AS e, arg_min(struct_pack(v := name, id := client_id), (-length(name), trusted)) FILTER (name IS NOT NULL) AS n,
  arg_min(struct_pack(c := city, n := nation_id, id := CASE WHEN filled > 0 THEN client_id END), (-filled, trusted)) AS a FROM t GROUP BY cluster_id),
b AS (SELECT t.cluster_id, arg_min(struct_pack(v := t.balance, id := t.client_id), ((t.segment IS DISTINCT FROM f.s.v)::INT, t.recent)) AS b FROM t JOIN f ON t.cluster_id IS NOT DISTINCT FROM f.cluster_id WHERE t.balance IS NOT NULL GROUP BY t.cluster_id)
SELECT f.cluster_id, n_records, n_stale, n.v AS name, e.v AS email, s.v AS segment, a.c AS city, a.n AS nation_id, floor(100 * b.b.v + 0.5)::BIGINT AS balance_cents, n.id AS name_from, e.id AS email_from, s.id AS segment_from, b.b.id AS balance_from, a.id AS address_from
FROM f LEFT JOIN b ON f.cluster_id IS NOT DISTINCT FROM b.cluster_id
"""
