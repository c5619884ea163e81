"""Eligibility gates, routing, prompt extraction, quarantine, stats requests.

All of these are narrow (per-row) column expressions: they run before the
scorer so Catalyst can push them into the scan and prune columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import CLASSES, COMMAND_PREFIX, IMAGE_PREFIXES, THRESHOLD
from ..functions.columns import n_over, over


def gate_reason(bot_user_id: int | None = None, prefix: str = COMMAND_PREFIX,
                skip_bots: bool = True) -> Column:
    """why a message is not handled, NULL when it is. Order matters: the
    first failing gate is the reason reported."""
    is_self = (F.col("author") == F.lit(bot_user_id)) if bot_user_id is not None \
        else F.lit(False)
    is_bot = F.coalesce(F.col("author_is_bot"), F.lit(False)) if skip_bots else F.lit(False)
    return (F.when(is_self, "self")
            .when(is_bot, "bot")
            .when(F.col("guild").isNull(), "no_guild")
            .when(F.coalesce(F.col("text"), F.lit("")) == "", "empty")
            .when(F.substring("text", 1, 1) == F.lit(prefix), "command"))


IMAGE_RE = r"(?is)^toxic(bot)? show me (.*)$"


def is_image_prompt(text: str = "text") -> Column:
    """case-blind "toxic show me " / "toxicbot show me " prefix."""
    # the prefixes are ASCII, so the first characters decide
    low = F.lower(F.substring(F.col(text), 1, max(len(p) for p in IMAGE_PREFIXES)))
    return low.startswith(IMAGE_PREFIXES[0]) | low.startswith(IMAGE_PREFIXES[1])


def prompt_text(text: str = "text") -> Column:
    """the text after the prefix's "show me " (case-blind)."""
    return F.regexp_extract(F.col(text), IMAGE_RE, 2)


def route(messages: DataFrame, bot_user_id: int | None = None,
          prefix: str = COMMAND_PREFIX) -> DataFrame:
    """Adds ``route``: a gate reason, ``image`` or ``score``; and ``prompt``."""
    reason = gate_reason(bot_user_id, prefix)
    r = F.coalesce(reason, F.when(is_image_prompt(), "image").otherwise("score"))
    return (messages.withColumn("route", r)
            .withColumn("prompt", F.when(F.col("route") == "image", prompt_text())))


def eligible(messages: DataFrame, bot_user_id: int | None = None,
             prefix: str = COMMAND_PREFIX) -> DataFrame:
    return messages.where(gate_reason(bot_user_id, prefix).isNull())


def to_score(messages: DataFrame, bot_user_id: int | None = None,
             prefix: str = COMMAND_PREFIX) -> DataFrame:
    """Messages that go to the scorer: eligible and not an image prompt."""
    return route(messages, bot_user_id, prefix).where(F.col("route") == "score") \
        .drop("route", "prompt")


def score_status(scored: DataFrame) -> Column:
    """a failed score (NULL or NaN in any class) quarantines the message."""
    bad = None
    for c in CLASSES:
        b = F.col(c).isNull() | F.isnan(F.col(c))
        bad = b if bad is None else (bad | b)
    return F.when(bad, "quarantine").otherwise("scored")


def split_quarantine(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = scored.withColumn("_status", score_status(scored))
    return (s.where(F.col("_status") == "scored").drop("_status"),
            s.where(F.col("_status") == "quarantine").drop("_status"))


def class_flags(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """per message, classes over the (strict) threshold."""
    names = F.concat_ws(",", *[F.when(over(c, threshold), F.lit(c)) for c in CLASSES])
    return scored.select("message_id", n_over(CLASSES, threshold).alias("n_flags"),
                         (n_over(CLASSES, threshold) > 0).alias("is_incident"),
                         names.alias("flags"))


def stats_targets(requests: DataFrame) -> DataFrame:
    """F8: (request_id, guild, mentions ARRAY) -> one row per looked-up target.

    Mentioned users become ``kind = 'user'`` rows; a request without mentions
    becomes one ``kind = 'guild'`` row.
    """
    users = (requests.select("request_id", "guild",
                             F.posexplode("mentions").alias("pos", "author"))
             .withColumn("kind", F.lit("user")))
    guilds = (requests.where(F.coalesce(F.size("mentions"), F.lit(0)) <= 0)
              .select("request_id", "guild", F.lit(0).alias("pos"),
                      F.lit(None).cast("bigint").alias("author"), F.lit("guild").alias("kind")))
    return users.unionByName(guilds)
