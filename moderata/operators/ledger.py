"""Incident ledger: per-user counters, incident history, latest message, roll-ups.

All inputs are *scored* message DataFrames (message columns + seven class
scores, none NULL: apply ``routing.split_quarantine`` first).

Scale notes
* ``ledger`` is a plain hash aggregate (count + integer sums): Spark runs a
  partial aggregate before the shuffle, so a hot (guild, author) key sends one
  row per map task, not a third of the data.
* ``last_message`` finds the winners by one number per message and reads the
  texts of the winners only.
* roll-ups (``guild_stats``, ``user_stats_all_guilds``) read the ledger, never
  the messages again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import CLASSES, CLASSES_HUMAN, THRESHOLD
from ..functions.columns import argmax_name, fixed, max_score, over

ID_ROOM = 2 * 10 ** 19  # more than twice the largest message id
COUNTERS = ["incidents", "total_seen"] + CLASSES


def ledger(scored: DataFrame, keys: Sequence[str] = ("guild", "author"),
           threshold: float = THRESHOLD) -> DataFrame:
    """L1: total_seen, incidents (largest score over threshold), per-class hits."""
    aggs = [F.count_if(over(max_score(), threshold)).alias("incidents"),
            F.count(F.lit(1)).alias("total_seen")]
    aggs += [F.count_if(over(c, threshold)).alias(c) for c in CLASSES]
    return scored.groupBy(*keys).agg(*aggs)


def ledger_and_guilds(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """L1 and L6 in one aggregation: grouping sets (guild, author) and (guild)
    give rows per user (kind 'user') and per guild (kind 'guild', author
    NULL). One scan and one shuffle instead of two."""
    aggs = [F.count_if(over(max_score(), threshold)).alias("incidents"),
            F.count(F.lit(1)).alias("total_seen")]
    aggs += [F.count_if(over(c, threshold)).alias(c) for c in CLASSES]
    aggs += [F.grouping_id().alias("_gid")]
    r = scored.groupingSets([["guild", "author"], ["guild"]], "guild", "author").agg(*aggs)
    return (r.withColumn("kind", F.when(F.col("_gid") == 0, "user").otherwise("guild"))
            .drop("_gid"))


def history(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """L2: all seven scores of incident messages only (append-only table)."""
    return (scored.where(over(max_score(), threshold))
            .select(F.col("message_id").alias("id"), "guild", "author", *CLASSES))


def last_message(scored: DataFrame,
                 keys: Sequence[str] = ("guild", "author", "channel")) -> DataFrame:
    """L3: the latest text per (guild, author, channel), toxic or not.

    Order is (ts, message_id); ts NULL sorts first, so message_id decides
    among sources without time. The winners are found by a hash aggregate of
    one number per message, (microseconds, id) in a decimal, that never reads
    the text. Their ids, taken from that number, then select the texts: the
    winners are broadcast if they are few, and otherwise a runtime filter of
    their ids keeps the other texts out of the shuffle.
    """
    micros = F.coalesce(F.unix_micros("ts"), F.lit(-(10 ** 16))).cast("decimal(18,0)")
    room = F.lit(str(ID_ROOM)).cast("decimal(20,0)")
    order = (micros * room).cast("decimal(38,0)") + F.col("message_id").cast("decimal(19,0)")
    best = (scored.select(*keys, order.cast("decimal(38,0)").alias("_at"))
            .groupBy(*keys).agg(F.max("_at").alias("_at")))
    # |id| < ID_ROOM / 2, so the shifted quotient is never near a whole number
    whole = F.floor((F.col("_at") + F.lit(str(ID_ROOM // 2)).cast("decimal(20,0)")) / room).cast("decimal(18,0)")
    winners = best.select(*[F.col(k).alias(f"_{k}") for k in keys],
                          (F.col("_at") - (whole * room).cast("decimal(38,0)")).cast("long").alias("message_id"))
    same = None
    for k in keys:  # an id may occur in several places
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    return (scored.select(*keys, "message_id", "text").join(winners, "message_id").where(same)
            .select(*keys, "message_id", "text").distinct())


def guild_rollup(users: DataFrame) -> DataFrame:
    """L6 raw sums per guild, from the ledger."""
    return users.groupBy("guild").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def with_rate_and_favourite(df: DataFrame) -> DataFrame:
    """L7 incident rate (one decimal, NULL when nothing was seen) and L8 favourite."""
    rate = fixed(F.try_divide(F.lit(100.0) * F.col("incidents"), F.col("total_seen")), 1).cast("double")
    fav = argmax_name([F.col(c) for c in CLASSES], CLASSES_HUMAN)
    return df.withColumn("rate", rate).withColumn("favourite", fav)


def guild_stats(users: DataFrame) -> DataFrame:
    return with_rate_and_favourite(guild_rollup(users))


def user_stats_all_guilds(users: DataFrame) -> DataFrame:
    """True totals per author over all guilds (the reference returned one
    guild's row only; per-guild rows are the ledger itself)."""
    out = users.groupBy("author").agg(*[F.sum(c).alias(c) for c in COUNTERS],
                                      F.count(F.lit(1)).alias("n_guilds"))
    return with_rate_and_favourite(out)


def lookup(users: DataFrame, keys: DataFrame, on: Sequence[str] = ("guild", "author"),
           how: str = "inner") -> DataFrame:
    """Many point lookups at once, as a join with a key table.

    Null keys never match (the reference's null-argument guards).
    """
    return keys.join(users, list(on), how)


def category_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (key, class) with the human class name and count."""
    pairs = ", ".join(f"'{h}', `{c}`" for h, c in zip(CLASSES_HUMAN, CLASSES))
    key_cols = [F.col(k) for k in keys]
    return df.select(*key_cols, F.expr(f"stack({len(CLASSES)}, {pairs}) AS (category, n)"))


def stats_text(name: str | F.Column, stats: DataFrame | None = None) -> F.Column:
    """The stats message text for one row holding the counters."""
    nm = F.col(name) if isinstance(name, str) else name
    cats = F.concat_ws("\n\t\t", *[F.concat(F.lit(h + ": "), F.col(c).cast("string"))
                                   for h, c in zip(CLASSES_HUMAN, CLASSES)])
    pct = fixed(F.try_divide(F.lit(100.0) * F.col("incidents"), F.col("total_seen")), 1)
    return F.concat(
        F.lit("For "), nm, F.lit(" I found the following:\n\t Toxic incidents: "),
        F.col("incidents").cast("string"), F.lit("/"), F.col("total_seen").cast("string"),
        F.lit(", "), pct, F.lit("% toxic\n\tFavorite form of toxicity (unweighted... for now): "),
        argmax_name([F.col(c) for c in CLASSES], CLASSES_HUMAN),
        F.lit("\n\tIncidents by category:\n\t\t"), cats, F.lit("\n"))
