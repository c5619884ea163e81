"""Threshold actions and reports.

Random choices of the reference (``random.choice``, ``uniform``) are replaced
by hashes of the message id: the same message always gets the same answer,
also when a task is retried after an executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import (APOLOGY_REPLIES, APOLOGY_SUBSTRING, APOLOGY_TOKEN,
                                 AWARD_EMOJIS, AWARD_PROBABILITY, AWARD_REPLY, CLASSES,
                                 CLASSES_HUMAN, IDENTITY_REACTION, PERSONA_P_DEFAULT,
                                 PLAIN_REACTION, THRESHOLD, TIER_REACT_MIN, TIER_REPLY_MIN,
                                 NOT_FOUND_PREFIX, NOT_FOUND_SUFFIX, TOXIC_REPLIES,
                                 WHY_CUT_CHARS, WHY_MAX_CHARS)
from ..functions.columns import SPLIT_PATTERN, hash_unit, n_over, over, pick, rate_lines, shorten
from .routing import score_status


def _lits(values: Sequence[str]):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tier(scored: DataFrame, threshold: float = THRESHOLD,
         replies: Sequence[str] = TOXIC_REPLIES) -> DataFrame:
    """A1: reply (>= 4 classes), identity reaction (>= 2 with identity attack),
    reaction (>= 2), else none. First match wins."""
    kind, payload = tier_columns(threshold, replies)
    return scored.select("message_id", n_over(CLASSES, threshold).alias("n_flags"), kind.alias("tier"),
                         payload.alias("payload"))


def tier_columns(threshold: float = THRESHOLD, replies: Sequence[str] = TOXIC_REPLIES):
    """The tier of a scored message and what is sent for it."""
    n = n_over(CLASSES, threshold)
    reply, react = n >= TIER_REPLY_MIN, n >= TIER_REACT_MIN
    identity = over("identity_attack", threshold)
    kind = (F.when(reply, "reply").when(react & identity, "react_identity").when(react, "react").otherwise("none"))
    payload = (F.when(reply, pick(_lits(replies), "message_id", "toxic_reply"))
               .when(react & identity, F.lit(IDENTITY_REACTION)).when(react, F.lit(PLAIN_REACTION)))
    return kind, payload


def is_apology(text: str = "text"):
    """A2: a whitespace token equal to "sorry" and "toxic" anywhere (lower-cased)."""
    low = F.lower(F.col(text))
    # a whitespace-delimited token equal to the word, without splitting the text
    token = low.rlike(rf"(^|{SPLIT_PATTERN}){APOLOGY_TOKEN}($|{SPLIT_PATTERN})")
    return low.contains(APOLOGY_SUBSTRING) & token


def apology(messages: DataFrame, replies: Sequence[str] = APOLOGY_REPLIES) -> DataFrame:
    a = is_apology()
    return messages.select("message_id", a.alias("apology"),
                           F.when(a, pick(_lits(replies), "message_id", "apology_reply"))
                           .alias("reply"))


def persona_reply(messages: DataFrame, personas: DataFrame, pool_all: Sequence[str] = (),
                  p_default: float = PERSONA_P_DEFAULT) -> DataFrame:
    """A4: users listed in the persona config may get a canned reply.

    ``personas`` (author, name, p, resps) comes from a configuration file.
    The planner broadcasts it when its measured bytes are below the session's
    threshold and shuffles otherwise. Unlisted users never fire (inner join);
    the general pool only adds to listed users' pools.
    """
    fired, reply = persona_columns(pool_all, p_default)
    return (messages.select("message_id", "author")
            .join(personas.select("author", "name", "p", "resps"), "author")
            .select("message_id", "author", "name", fired.alias("fired"), reply.alias("reply")))


def persona_columns(pool_all: Sequence[str] = (), p_default: float = PERSONA_P_DEFAULT):
    """Whether a message joined with its author's persona gets a reply, and which."""
    pool = F.concat(_lits(list(pool_all)), F.coalesce(F.col("resps"), _lits([])))
    p = F.coalesce(F.col("p"), F.lit(float(p_default)))
    fired = (F.size(pool) > 0) & (hash_unit("message_id", "persona") < p)
    return fired, F.when(fired, pick(pool, "message_id", "persona_pick"))


def award_reply(reactions: DataFrame, messages: DataFrame, bot_user_id: int) -> DataFrame:
    """A5: a gold-like emoji on one of the bot's own messages is thanked with
    probability 0.1. ``reactions``: (reaction_id, message_id, emoji)."""
    own = messages.where(F.col("author") == F.lit(bot_user_id)).select("message_id")
    u = hash_unit("reaction_id", "award")
    return (reactions.join(own, "message_id", "left_semi")
            .where(F.col("emoji").isin(*AWARD_EMOJIS) & (u < F.lit(AWARD_PROBABILITY)))
            .select("reaction_id", "message_id", F.lit(AWARD_REPLY).alias("reply")))


def why_report(last: DataFrame, scored_last: DataFrame) -> DataFrame:
    """The latest message per (guild, author, channel), re-scored, shown
    cut to 97 characters + "..." when longer than 100."""
    lines = rate_lines(CLASSES_HUMAN, CLASSES, "\n\t")
    shown = shorten("text", WHY_MAX_CHARS, WHY_CUT_CHARS)
    rep = F.concat(F.lit("Your last message, "), F.col("author").cast("string"), F.lit(" '"),
                   shown, F.lit("' was rated:\n\t"), lines)
    return scored_last.select("guild", "author", "channel", "message_id", rep.alias("report"))


def why_answers(requests: DataFrame, last: DataFrame, reports: DataFrame) -> DataFrame:
    """A6 per request (request_id, guild, author, channel, name): the report of
    the user's latest message there, or the answer that none was found."""
    found = last.select("guild", "author", "channel", "message_id").join(
        reports.select("guild", "author", "channel", "report"), ["guild", "author", "channel"])
    missing = F.concat(F.lit(NOT_FOUND_PREFIX), F.col("name"), F.lit(NOT_FOUND_SUFFIX))
    return (requests.join(found, ["guild", "author", "channel"], "left")
            .select("request_id", "message_id", F.coalesce("report", missing).alias("answer")))


def actions(scored: DataFrame, messages: DataFrame, personas: DataFrame | None = None,
            pool_all: Sequence[str] = (), p_default: float = PERSONA_P_DEFAULT,
            threshold: float = THRESHOLD, toxic_replies: Sequence[str] = TOXIC_REPLIES,
            apology_replies: Sequence[str] = APOLOGY_REPLIES) -> DataFrame:
    """Every reaction and reply as (message_id, action, payload) rows.

    ``scored``: messages with valid scores (tiers, apologies); ``messages``:
    the routed ones (persona replies need no scores). Reply lists come from
    the configuration.
    """
    t = (tier(scored, threshold, toxic_replies).where(F.col("tier") != "none")
         .select("message_id", F.col("tier").alias("action"), "payload"))
    a = (apology(scored, apology_replies).where("apology")
         .select("message_id", F.lit("apology").alias("action"), F.col("reply").alias("payload")))
    out = t.unionByName(a)
    if personas is not None:
        p = (persona_reply(messages, personas, pool_all, p_default).where("fired")
             .select("message_id", F.lit("persona").alias("action"),
                     F.col("reply").alias("payload")))
        out = out.unionByName(p)
    return out


def action_rows(judged: DataFrame, personas: DataFrame | None = None, pool_all: Sequence[str] = (),
                p_default: float = PERSONA_P_DEFAULT, threshold: float = THRESHOLD,
                toxic_replies: Sequence[str] = TOXIC_REPLIES,
                apology_replies: Sequence[str] = APOLOGY_REPLIES) -> DataFrame:
    """S9 in one pass over ``judged`` (``flow.process``): the rows of ``actions``.

    A stream is read once this way; tiers and apologies need valid scores,
    persona replies do not.
    """
    valid = score_status(judged) == "scored"
    kind, payload = tier_columns(threshold, toxic_replies)
    acted = [F.when(valid & (kind != "none"), F.struct(kind.alias("action"), payload.alias("payload"))),
             F.when(valid & is_apology(), F.struct(F.lit("apology").alias("action"),
                                                   pick(_lits(apology_replies), "message_id", "apology_reply").alias("payload")))]
    if personas is not None:
        listed = personas.select("author", "p", "resps", F.lit(True).alias("listed"))
        judged = judged.join(listed, "author", "left")
        fired, reply = persona_columns(pool_all, p_default)
        acted.append(F.when(F.col("listed") & fired, F.struct(F.lit("persona").alias("action"), reply.alias("payload"))))
    return (judged.select("message_id", F.explode(F.filter(F.array(*acted), lambda a: a.isNotNull())).alias("a"))
            .select("message_id", "a.action", "a.payload"))
