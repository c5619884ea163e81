"""Explicit schemas (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

from ..functions.classes import (CLASSES, IDENTITY_COLUMNS, REACTION_COLUMNS,
                                 TRAINING_TOXICITY_COLUMNS)

L, D, S, I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()


def _f(name, t, nullable=True):
    return T.StructField(name, t, nullable)


# A message as the library sees it. guild/author/channel are opaque keys:
# the reference uses 64-bit ids, the driver tables give strings for some.
MESSAGE = T.StructType([
    _f("message_id", L, False), _f("guild", S), _f("channel", S), _f("author", L),
    _f("author_is_bot", T.BooleanType()), _f("ts", T.TimestampType()), _f("text", S),
])

SCORES = T.StructType([_f(c, D) for c in CLASSES])

# Ledger tables (same columns as the reference's three tables).
USERS = T.StructType([_f("guild", S), _f("author", L),
                      _f("incidents", L), _f("total_seen", L)] + [_f(c, L) for c in CLASSES])
LAST_MESSAGES = T.StructType([_f("guild", S), _f("author", L), _f("channel", S),
                              _f("ts", T.TimestampType()), _f("message_id", L), _f("text", S)])
HISTORY = T.StructType([_f("id", L), _f("guild", S), _f("author", L)] + [_f(c, D) for c in CLASSES])
ACTIONS = T.StructType([_f("message_id", L), _f("action", S), _f("payload", S)])

# Training CSV: comment text, 7 soft toxicity labels, 24 nullable identity
# labels, 5 reaction counts (extra columns in the file are ignored by name).
TRAINING_CSV = T.StructType(
    [_f("id", L), _f("comment_text", S)]
    + [_f(c, D) for c in TRAINING_TOXICITY_COLUMNS]
    + [_f(c, D) for c in IDENTITY_COLUMNS]
    + [_f(c, I) for c in REACTION_COLUMNS])

PERSONA = T.StructType([_f("author", L, False), _f("name", S), _f("p", D),
                        _f("resps", T.ArrayType(S))])

IMAGE_REQUEST = T.StructType([
    _f("request_id", L, False), _f("prompt", S), _f("h", I), _f("w", I), _f("scale", D),
    _f("ddim_steps", I), _f("n", I), _f("cond_scale", D),
])

# Driver tables used as inputs.
DOCUMENTS = T.StructType([_f("doc_id", L), _f("text", S), _f("lang", S), _f("source", S),
                          _f("n_chars", L)])
EVENTS = T.StructType([_f("event_id", L), _f("ts", T.TimestampNTZType()), _f("user_id", L),
                       _f("event_type", S), _f("value", D), _f("props", S)])
