"""Independent DuckDB SQL for each registered query.

Each text runs on DuckDB with the driver tables registered as views and must
give the same rows as the Spark query of the same name. The SQL is written
from the operator's definition, not generated from the Spark plan.
"""

from __future__ import annotations

from ..functions.classes import CLASSES, CLASSES_HUMAN

SQL: dict[str, str] = {}


def sql(name: str):
    def deco(fn):
        SQL[name] = fn()
        return fn
    return deco


# --------------------------------------------------------------------------
# shared fragments
# --------------------------------------------------------------------------

def h_int(key: str, salt: str) -> str:
    return f"('0x'||substr(md5(CAST({key} AS VARCHAR)||':{salt}'),1,8))::BIGINT"


def h_unit(key: str, salt: str) -> str:
    return f"({h_int(key, salt)}/4294967296.0::DOUBLE)"


def _fixture(messages_sql: str) -> str:
    """``m``: the messages; ``tried``: with scores, NULL where scoring failed; ``scored``: the valid ones."""
    u = ",\n    ".join(f"{h_unit('message_id', c)} AS {c}" for c in CLASSES)
    sq = ", ".join(f"{c}*{c} AS {c}" for c in CLASSES)
    null = ", ".join(f"CASE WHEN NOT failed THEN {c} END AS {c}" for c in CLASSES)
    return f"""
m AS ({messages_sql}),
u AS (SELECT m.*, message_id % 25 = 11 AS failed,
    {u} FROM m),
v AS (SELECT * REPLACE ({sq}) FROM u),
w AS (SELECT * REPLACE ({sq}) FROM v),
tried AS (SELECT * REPLACE ({null}) FROM w),
scored AS (SELECT * FROM tried WHERE NOT failed)"""


DOC_MESSAGES = ("SELECT doc_id AS message_id, source AS guild, lang AS channel, "
                "doc_id % 7 AS author, false AS author_is_bot, "
                "CAST(NULL AS TIMESTAMP) AS ts, text FROM documents")
_KIND = f"{h_int('message_id', 'kind')} % 20"
CHAT = f"""SELECT message_id, CASE WHEN k <> 6 THEN guild END AS guild, channel, author, k = 5 AS author_is_bot, ts,
  CASE k WHEN 0 THEN '%' || text WHEN 1 THEN 'Toxic SHOW ME ' || text WHEN 2 THEN 'toxicbot show me ' || text
         WHEN 3 THEN '' WHEN 4 THEN text || ' Sorry, sorry for being Toxic' ELSE text END AS text
  FROM (SELECT *, {_KIND} AS k FROM ({DOC_MESSAGES}))"""
EVENT_MESSAGES = f"""SELECT message_id, guild, channel, author, k = 5 AS author_is_bot,
  CASE WHEN k = 7 THEN ts - INTERVAL 60 DAY ELSE ts END AS ts,
  CASE k WHEN 0 THEN '%' || text WHEN 1 THEN 'Toxic SHOW ME ' || text WHEN 3 THEN ''
         WHEN 4 THEN text || ' sorry for being Toxic' ELSE text END AS text
  FROM (SELECT *, {_KIND} AS k FROM (SELECT event_id AS message_id, event_type AS guild, 'events' AS channel,
    user_id AS author, CAST(ts AS TIMESTAMP) AS ts, props AS text FROM events))"""
CONV_MESSAGES = ("SELECT conv_id || ':' || turn AS message_id, CAST(conv_id AS VARCHAR) AS guild, "
                 "role AS channel, CASE WHEN role = 'user' THEN 1 WHEN role = 'assistant' "
                 "THEN 0 ELSE 2 END::BIGINT AS author, role = 'system' AS author_is_bot, "
                 "CAST(NULL AS TIMESTAMP) AS ts, text FROM conversations")


def _gate(bot_user: str = "NULL") -> str:
    return (f"CASE WHEN author = {bot_user} THEN 'self' "
            "WHEN coalesce(author_is_bot, false) THEN 'bot' "
            "WHEN guild IS NULL THEN 'no_guild' "
            "WHEN coalesce(length(text), 0) = 0 THEN 'empty' "
            "WHEN substr(text, 1, 1) = '%' THEN 'command' END")


IS_IMAGE = ("(starts_with(lower(text), 'toxic show me ') "
            "OR starts_with(lower(text), 'toxicbot show me '))")


def _routed(messages_sql: str, bot_user: str = "NULL") -> str:
    """Messages that reach the scorer: eligible and not an image prompt."""
    return f"SELECT * FROM ({messages_sql}) WHERE {_gate(bot_user)} IS NULL AND NOT {IS_IMAGE}"


BOT = "6"
CHAT_ROUTED = _routed(CHAT, BOT)
SCORED_DOCS = "WITH" + _fixture(CHAT_ROUTED)
SCORED_EVENTS = "WITH" + _fixture(_routed(EVENT_MESSAGES))

MAXS = "greatest(" + ", ".join(CLASSES) + ")"
NOVER = " + ".join(f"({c} > 0.5)::BIGINT" for c in CLASSES)
COUNTERS = ["incidents", "total_seen"] + CLASSES


def ledger_cte(src: str = SCORED_DOCS) -> str:
    cls = ", ".join(f"count_if({c} > 0.5)::BIGINT AS {c}" for c in CLASSES)
    return (src + f""",
users AS (SELECT guild, author, count_if({MAXS} > 0.5)::BIGINT AS incidents,
                 count(*) AS total_seen, {cls}
          FROM scored GROUP BY guild, author)""")


def favourite(prefix: str = "") -> str:
    names = "[" + ", ".join(f"'{h}'" for h in CLASSES_HUMAN) + "]"
    vals = "[" + ", ".join(prefix + c for c in CLASSES) + "]"
    return f"list_extract({names}, list_position({vals}, list_max({vals})))"


def rate(prefix: str = "") -> str:
    return (f"CASE WHEN {prefix}total_seen > 0 THEN printf('%.1f', "
            f"100.0::DOUBLE * {prefix}incidents / {prefix}total_seen)::DOUBLE END")


# --------------------------------------------------------------------------
# ledger
# --------------------------------------------------------------------------

@sql("ledger")
def _():
    return ledger_cte() + "\nSELECT * FROM users"


@sql("history")
def _():
    return SCORED_DOCS + f"\nSELECT message_id AS id, guild, author, {', '.join(CLASSES)} " \
                         f"FROM scored WHERE {MAXS} > 0.5"


@sql("last_message")
def _():
    return SCORED_DOCS + """
SELECT guild, author, channel, max(message_id) AS message_id,
       arg_max(text, message_id) AS text
FROM scored GROUP BY guild, author, channel"""


@sql("guild_stats")
def _():
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTERS)
    return ledger_cte() + f""",
g AS (SELECT guild, {sums} FROM users GROUP BY guild)
SELECT g.*, {rate()} AS rate, {favourite()} AS favourite FROM g"""


@sql("user_stats_all_guilds")
def _():
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTERS)
    return ledger_cte() + f""",
a AS (SELECT author, {sums}, count(*) AS n_guilds FROM users GROUP BY author)
SELECT a.*, {rate()} AS rate, {favourite()} AS favourite FROM a"""


@sql("category_counts")
def _():
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in CLASSES)
    unions = "\nUNION ALL ".join(
        f"SELECT guild, '{h}' AS category, {c} AS n FROM g" for h, c in zip(CLASSES_HUMAN, CLASSES))
    return ledger_cte() + f""",
g AS (SELECT guild, {sums} FROM users GROUP BY guild)
{unions}"""


# --------------------------------------------------------------------------
# routing
# --------------------------------------------------------------------------

NL, TAB = "chr(10)", "chr(9)"


PROMPT = "regexp_extract(text, '(?is)^toxic(bot)? show me (.*)$', 2)"


@sql("eligible")
def _():
    return f"WITH m AS ({CONV_MESSAGES})\nSELECT message_id, guild, author, {_gate('0')} AS reason FROM m"


@sql("route")
def _():
    return f"""WITH m AS ({CHAT}),
r AS (SELECT message_id, text, coalesce({_gate(BOT)}, CASE WHEN {IS_IMAGE} THEN 'image' ELSE 'score' END) AS route FROM m)
SELECT message_id, route, CASE WHEN route = 'image' THEN {PROMPT} END AS prompt FROM r"""


@sql("prompt_extract")
def _():
    return f"WITH m AS ({CHAT})\nSELECT message_id, {IS_IMAGE} AS is_image, {PROMPT} AS prompt FROM m"


@sql("score_quarantine")
def _():
    return SCORED_DOCS + ("\nSELECT CASE WHEN failed THEN 'quarantine' ELSE 'scored' END AS status, "
                          "count(*) AS n FROM tried GROUP BY 1")


@sql("score_replies")
def _():
    return SCORED_DOCS + """
SELECT message_id, CASE WHEN failed OR message_id % 10 IN (4, 5, 6) THEN 'quarantine' ELSE 'scored' END AS status,
  CASE WHEN NOT (failed OR message_id % 10 IN (4, 5, 6)) THEN round(insult, 6) END AS insult FROM tried"""


@sql("display_name")
def _():
    return "SELECT doc_id AS message_id, concat_ws('#', source, lpad((doc_id % 10000)::VARCHAR, 4, '0')) AS name FROM documents"


@sql("quarantine")
def _():
    return SCORED_DOCS + "\nSELECT message_id, guild, author, channel FROM tried WHERE failed"


@sql("class_flags")
def _():
    names = ", ".join(f"CASE WHEN {c} > 0.5 THEN '{c}' END" for c in CLASSES)
    return SCORED_DOCS + f"""
SELECT message_id, {NOVER} AS n_flags, ({NOVER}) > 0 AS is_incident,
       concat_ws(',', {names}) AS flags FROM scored"""


@sql("user_stats")
def _():
    return ledger_cte() + f"\nSELECT users.*, {rate()} AS rate, {favourite()} AS favourite FROM users"


STATS_REQUESTS = """SELECT doc_id AS request_id, source AS guild,
  CASE doc_id % 3 WHEN 0 THEN CAST([] AS BIGINT[])
                  WHEN 1 THEN [(doc_id // 3) % 7]
                  ELSE [(doc_id // 3) % 7, (doc_id // 3 + 2) % 7] END AS mentions
FROM documents"""


@sql("stats_requests")
def _():
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTERS)
    cols = ", ".join(COUNTERS)
    return ledger_cte() + f""",
req AS ({STATS_REQUESTS}),
ment AS (SELECT request_id, guild, unnest(mentions) AS author,
                unnest(generate_series(0, len(mentions) - 1)) AS pos FROM req),
g AS (SELECT guild, {sums} FROM users GROUP BY guild),
t AS (SELECT request_id, pos::BIGINT AS pos, 'user' AS kind, guild, author, {cols}
      FROM ment JOIN users USING (guild, author)
      UNION ALL
      SELECT request_id, 0::BIGINT AS pos, 'guild' AS kind, guild, NULL::BIGINT AS author, {cols}
      FROM req JOIN g USING (guild) WHERE len(mentions) = 0)
SELECT request_id, pos, kind, guild, author, incidents, total_seen,
       {rate()} AS rate, {favourite()} AS favourite FROM t"""


# --------------------------------------------------------------------------
# scoring
# --------------------------------------------------------------------------

def _lexicon_values() -> str:
    from ..operators.scoring import DEFAULT_LEXICON
    rows = []
    for term in sorted(DEFAULT_LEXICON):
        for c, w in DEFAULT_LEXICON[term].items():
            rows.append(f"('{term}', '{c}', {float(w)}::DOUBLE)")
    return ", ".join(rows)


def _bias(c: str) -> str:
    from ..operators.scoring import DEFAULT_BIAS
    return f"{float(DEFAULT_BIAS.get(c, 0.0))}::DOUBLE"


_WORD_CHARS = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}"
_BLANKS = r"\x09-\x0D\x20\x{85}\p{Z}"
TERM_RE = f"[{_WORD_CHARS}]+"
WORD_RE = f"[{_WORD_CHARS}]+|[^{_WORD_CHARS}{_BLANKS}]+"
SPLIT_RE = f"[{_BLANKS}\\x1C-\\x1F]+"


def _lexicon_sum_cte(variants: dict[str, str], source: str = "documents") -> str:
    """Per (doc, variant, class) sum of weights of matching tokens."""
    toks = "\n  UNION ALL ".join(
        f"SELECT doc_id, '{v}' AS variant, unnest(regexp_extract_all({expr}, '{TERM_RE}')) AS term "
        f"FROM {source}" for v, expr in variants.items())
    return f"""lex(term, cls, w) AS (VALUES {_lexicon_values()}),
toks AS ({toks}),
sums AS (SELECT doc_id, variant, cls, sum(w) AS s FROM toks JOIN lex USING (term)
         GROUP BY doc_id, variant, cls)"""


@sql("score_lexicon")
def _():
    cols = ",\n  ".join(
        f"round(1 / (1 + exp(-({_bias(c)} + coalesce(sum(s) FILTER (WHERE cls = '{c}'), 0)))), 6) AS {c}"
        for c in CLASSES)
    return f"""WITH {_lexicon_sum_cte({'low': 'lower(text)'})}
SELECT d.doc_id AS message_id,
  {cols}
FROM documents d LEFT JOIN sums USING (doc_id) GROUP BY d.doc_id"""


@sql("score_case_max")
def _():
    per_v = ", ".join(
        f"coalesce(sum(s) FILTER (WHERE cls = '{c}' AND variant = '{v}'), 0) AS {c}_{v}"
        for c in CLASSES for v in ("orig", "up", "low"))
    cols = ",\n  ".join(
        f"round(1 / (1 + exp(-({_bias(c)} + greatest({c}_orig, {c}_up, {c}_low)))), 6) AS {c}"
        for c in CLASSES)
    return f"""WITH {_lexicon_sum_cte({'orig': 'text', 'up': 'upper(text)', 'low': 'lower(text)'})},
p AS (SELECT d.doc_id, {per_v} FROM documents d LEFT JOIN sums USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id AS message_id,
  {cols}
FROM p"""


def _rate_lines(prefix: str = "") -> str:
    parts = [f"'{h}: ' || printf('%.2f%%', {prefix}{c} * 100.0)" for h, c in zip(CLASSES_HUMAN, CLASSES)]
    return f" || {NL} || {TAB} || ".join(parts)


@sql("rate_report")
def _():
    return f"""WITH {_fixture(DOC_MESSAGES)}
SELECT message_id, CASE WHEN failed THEN 'My brain hurts'
  ELSE 'I rate the message:' || {NL} || {TAB} || {_rate_lines()} END AS report FROM tried"""


@sql("token_list")
def _():
    return (f"SELECT doc_id AS message_id, array_to_string(regexp_extract_all(text, '{WORD_RE}'), ', ') "
            f"AS tokens, len(regexp_extract_all(text, '{WORD_RE}'))::BIGINT AS n_tokens FROM documents")


# --------------------------------------------------------------------------
# actions and reports
# --------------------------------------------------------------------------

def _list(values) -> str:
    esc = [v.replace("'", "''") for v in values]
    return "[" + ", ".join(f"'{v}'" for v in esc) + "]" if values else "CAST([] AS VARCHAR[])"


def _pick(lst: str, salt: str) -> str:
    return f"CASE WHEN len({lst}) > 0 THEN list_extract({lst}, ({h_int('message_id', salt)} % len({lst}) + 1)::INTEGER) END"


def _tier_sql(scored_src: str | None = None) -> str:
    from ..functions.classes import IDENTITY_REACTION, PLAIN_REACTION, TOXIC_REPLIES
    return (scored_src or SCORED_DOCS) + f""",
t AS (SELECT message_id, {NOVER} AS n_flags, identity_attack > 0.5 AS ia FROM scored),
t2 AS (SELECT message_id, n_flags, CASE WHEN n_flags >= 4 THEN 'reply'
            WHEN n_flags >= 2 AND ia THEN 'react_identity'
            WHEN n_flags >= 2 THEN 'react' ELSE 'none' END AS tier FROM t)
SELECT message_id, n_flags, tier,
  CASE tier WHEN 'reply' THEN {_pick(_list(TOXIC_REPLIES), 'toxic_reply')}
            WHEN 'react_identity' THEN '{IDENTITY_REACTION}'
            WHEN 'react' THEN '{PLAIN_REACTION}' END AS payload
FROM t2"""


@sql("tier")
def _():
    return _tier_sql()


def _apology_sql(scored_src: str | None = None) -> str:
    from ..functions.classes import APOLOGY_REPLIES
    return (scored_src or SCORED_DOCS) + f""",
a AS (SELECT message_id, list_contains(regexp_split_to_array(lower(text), '{SPLIT_RE}'), 'sorry')
                         AND contains(lower(text), 'toxic') AS apology FROM scored)
SELECT message_id, apology, CASE WHEN apology THEN {_pick(_list(APOLOGY_REPLIES), 'apology_reply')} END AS reply
FROM a"""


@sql("apology")
def _():
    return _apology_sql()


def _persona_sql(messages_sql: str | None = None) -> str:
    from ..sources.files import load_persona_config, persona_rows
    cfg = load_persona_config()
    vals = ", ".join(
        f"({a}::BIGINT, {repr(n) if n else 'NULL'}, {p if p is not None else 'NULL'}::DOUBLE, {_list(r)})"
        for a, n, p, r in persona_rows(cfg))
    pool_all = _list(cfg["user"].get("all", []))
    p_def = float(cfg["user"].get("p_default", 0.2))
    return f"""WITH m AS ({messages_sql or CHAT_ROUTED}),
per(author, name, p, resps) AS (VALUES {vals}),
j AS (SELECT m.message_id, m.author, per.name, coalesce(per.p, {p_def}::DOUBLE) AS p,
             list_concat({pool_all}, coalesce(per.resps, CAST([] AS VARCHAR[]))) AS pool
      FROM m JOIN per USING (author)),
f AS (SELECT *, len(pool) > 0 AND {h_unit('message_id', 'persona')} < p AS fired FROM j)
SELECT message_id, author, name, fired, CASE WHEN fired THEN {_pick('pool', 'persona_pick')} END AS reply
FROM f"""


@sql("persona_reply")
def _():
    return _persona_sql()


@sql("pad_batch")
def _():
    return """WITH r AS (SELECT doc_id AS message_id, LEAST(COALESCE(length(text), 0), 128) AS n,
  row_number() OVER (ORDER BY LEAST(COALESCE(length(text), 0), 128), doc_id) - 1 AS place FROM documents),
b AS (SELECT *, place // 32 AS batch FROM r)
SELECT message_id, batch, (((max(n) OVER (PARTITION BY batch) + 7) // 8) * 8)::INTEGER AS pad_to,
  (((max(n) OVER (PARTITION BY batch) + 7) // 8) * 8)::INTEGER AS n_input, n::INTEGER AS n_known FROM b"""


@sql("actions")
def _():
    return f"""WITH t AS ({_tier_sql()}),
a AS ({_apology_sql()}),
p AS ({_persona_sql()})
SELECT message_id, tier AS action, payload FROM t WHERE tier <> 'none'
UNION ALL SELECT message_id, 'apology', reply FROM a WHERE apology
UNION ALL SELECT message_id, 'persona', reply FROM p WHERE fired"""


def _why_sql() -> str:
    """CTEs ``last`` (latest scored message per key) and ``why`` (with its report)."""
    cols = ",\n  ".join(
        f"1 / (1 + exp(-({_bias(c)} + coalesce(sum(s) FILTER (WHERE cls = '{c}'), 0)))) AS {c}"
        for c in CLASSES)
    return SCORED_DOCS + f""",
last AS (SELECT guild, author, channel, max(message_id) AS message_id, arg_max(text, message_id) AS text
         FROM scored GROUP BY guild, author, channel),
lt AS (SELECT message_id AS doc_id, text FROM last),
{_lexicon_sum_cte({'low': 'lower(text)'}, 'lt')},
p AS (SELECT d.doc_id AS message_id, {cols}
      FROM lt d LEFT JOIN sums USING (doc_id) GROUP BY d.doc_id),
why AS (SELECT l.guild, l.author, l.channel, l.message_id,
  'Your last message, ' || CAST(l.author AS VARCHAR) || ' \'\'' ||
  CASE WHEN length(l.text) > 100 THEN substr(l.text, 1, 97) || '...' ELSE l.text END ||
  '\'\' was rated:' || {NL} || {TAB} || {_rate_lines('p.')} AS report
  FROM last l JOIN p USING (message_id))"""


@sql("why_report")
def _():
    return _why_sql() + "\nSELECT * FROM why"


WHY_REQUESTS = ("SELECT doc_id AS request_id, source AS guild, doc_id % 9 AS author, lang AS channel, "
                "'user' || (doc_id % 9) AS name FROM documents")


@sql("lookup_last")
def _():
    return _why_sql() + f"""
SELECT r.request_id, r.guild, r.author, r.channel, l.message_id, l.text
FROM ({WHY_REQUESTS}) r JOIN last l USING (guild, author, channel)"""


@sql("why_answers")
def _():
    return _why_sql() + f"""
SELECT r.request_id, w.message_id,
       coalesce(w.report, 'Sorry ' || r.name || ', I didn\'\'t find your last message here') AS answer
FROM ({WHY_REQUESTS}) r LEFT JOIN why w USING (guild, author, channel)"""


@sql("award_reply")
def _():
    from ..functions.classes import AWARD_EMOJIS, AWARD_REPLY
    from .catalog import REACTION_EMOJIS
    emoji = _pick(_list(REACTION_EMOJIS), "emoji").replace("message_id", "event_id")
    return f"""WITH r AS (SELECT event_id AS reaction_id, user_id AS message_id, {emoji} AS emoji FROM events),
own AS (SELECT DISTINCT message_id FROM ({CHAT}) WHERE author = {BOT})
SELECT reaction_id, message_id, '{AWARD_REPLY}' AS reply FROM r JOIN own USING (message_id)
WHERE list_contains({_list(AWARD_EMOJIS)}, emoji) AND {h_unit('reaction_id', 'award')} < 0.1::DOUBLE"""


@sql("stats_report")
def _():
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTERS)
    cats = f" || {NL} || {TAB} || {TAB} || ".join(
        f"'{h}: ' || CAST({c} AS VARCHAR)" for h, c in zip(CLASSES_HUMAN, CLASSES))
    return ledger_cte() + f""",
g AS (SELECT guild, {sums} FROM users GROUP BY guild)
SELECT guild, regexp_replace(
  'For ' || guild || ' I found the following:' || {NL} || {TAB} || ' Toxic incidents: ' ||
  CAST(incidents AS VARCHAR) || '/' || CAST(total_seen AS VARCHAR) || ', ' ||
  printf('%.1f', 100.0::DOUBLE * incidents / total_seen) || '% toxic' || {NL} || {TAB} ||
  'Favorite form of toxicity (unweighted... for now): ' || {favourite()} || {NL} || {TAB} ||
  'Incidents by category:' || {NL} || {TAB} || {TAB} || {cats} || {NL}, '\\s+$', '') AS report
FROM g"""


# --------------------------------------------------------------------------
# training data, losses, metrics
# --------------------------------------------------------------------------

def _training_cte() -> str:
    from ..functions.classes import IDENTITY_COLUMNS, REACTION_COLUMNS
    cols = ["d.doc_id AS id", "d.text AS comment_text", "l.toxic::DOUBLE AS toxic"]
    cols += [f"l.toxic::DOUBLE * {h_unit('d.doc_id', 'label:' + c)} AS {c}" for c in CLASSES[1:]]
    cols += [f"CASE WHEN {h_unit('d.doc_id', 'identity:' + c)} >= 0.6::DOUBLE THEN "
             f"({h_unit('d.doc_id', 'identity:' + c)} - 0.6::DOUBLE) / 0.4::DOUBLE END AS {c}"
             for c in IDENTITY_COLUMNS]
    cols += [f"({h_int('d.doc_id', 'reaction:' + c)} % 10)::INTEGER AS {c}" for c in REACTION_COLUMNS]
    return ("tf AS (SELECT " + ",\n  ".join(cols) +
            "\n  FROM documents d JOIN labels l USING (doc_id))")


def _logits_cte() -> str:
    """tl: training rows with the lexicon logit of every class."""
    lg = ",\n  ".join(
        f"{_bias(c)} + coalesce(sum(s) FILTER (WHERE cls = '{c}'), 0) AS logit_{c}" for c in CLASSES)
    return f"""{_training_cte()},
{_lexicon_sum_cte({'low': 'lower(text)'})},
lg AS (SELECT d.doc_id AS id,
  {lg}
  FROM documents d LEFT JOIN sums USING (doc_id) GROUP BY d.doc_id),
tl AS (SELECT tf.*, lg.* EXCLUDE (id) FROM tf JOIN lg USING (id))"""


def _class_long() -> str:
    return "\n  UNION ALL ".join(
        f"SELECT id, '{c}' AS class, logit_{c} AS logit, {c} AS y FROM tl" for c in CLASSES)


BCE = "(greatest(logit, 0.0::DOUBLE) - logit * y + ln(1 + exp(-abs(logit))))"


@sql("labels_binary")
def _():
    cols = ", ".join(f"{c}, ({c} > 0.5)::BIGINT AS {c}_bin" for c in CLASSES)
    return f"WITH {_training_cte()}\nSELECT id, {cols} FROM tf"


@sql("identity_mask")
def _():
    from ..functions.classes import IDENTITY_COLUMNS
    u = "\n  UNION ALL ".join(
        f"SELECT id, '{c}' AS identity, coalesce({c}, 0.0::DOUBLE) AS value, {c} IS NOT NULL AS known FROM tf"
        for c in IDENTITY_COLUMNS)
    return f"WITH {_training_cte()}\n{u}"


@sql("split_hash")
def _():
    return (f"WITH {_training_cte()}\nSELECT id, CASE WHEN {h_int('id', 'split')} % 10 < 1 "
            "THEN 'holdout' ELSE 'train' END AS split FROM tf")


def _bce(long_sql: str) -> str:
    return f"""lo AS ({long_sql}),
ls AS (SELECT class, {BCE} AS loss FROM lo)
SELECT class, round(avg(loss), 6) AS loss, count(*) AS n FROM ls GROUP BY class
UNION ALL SELECT 'all', round(avg(loss), 6), count(*) FROM ls"""


@sql("bce_loss")
def _():
    return f"WITH {_logits_cte()},\n{_bce(_class_long())}"


@sql("bce_masked")
def _():
    from ..functions.classes import IDENTITY_COLUMNS
    u = "\n  UNION ALL ".join(
        f"SELECT id, '{c}' AS class, logit_identity_attack AS logit, {c} AS y FROM tl WHERE {c} IS NOT NULL"
        for c in IDENTITY_COLUMNS)
    return f"WITH {_logits_cte()},\n{_bce(u)}"


@sql("eval_metrics")
def _():
    return f"""WITH {_logits_cte()},
lo AS (SELECT id, class, (y > 0.5)::INTEGER AS y_true, (logit > 0)::INTEGER AS y_pred
       FROM ({_class_long()})),
c AS (SELECT class, count_if(y_true = 1 AND y_pred = 1)::BIGINT AS tp,
             count_if(y_true = 0 AND y_pred = 1)::BIGINT AS fp,
             count_if(y_true = 1 AND y_pred = 0)::BIGINT AS fn,
             count_if(y_true = 0 AND y_pred = 0)::BIGINT AS tn
      FROM lo GROUP BY class),
m AS (SELECT class, tp, fp, fn, tn,
        CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
        (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy FROM c),
sub AS (SELECT avg(ok) AS accuracy FROM (SELECT id, min((y_true = y_pred)::INTEGER) AS ok FROM lo GROUP BY id))
SELECT class, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM m
UNION ALL
SELECT 'macro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(tn)::BIGINT,
       round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       round((SELECT accuracy FROM sub), 6) FROM m"""


# --------------------------------------------------------------------------
# features
# --------------------------------------------------------------------------

@sql("cyclic_encode")
def _():
    r = 16
    arg = f"value / pow(10000.0::DOUBLE, i::DOUBLE / {float(r)}::DOUBLE)"
    return (f"SELECT event_id, i::BIGINT AS i, round(CASE WHEN i % 2 = 0 THEN sin({arg}) "
            f"ELSE cos({arg}) END, 9) AS enc FROM events, range(0, {r}) t(i)")


@sql("vector_pool")
def _():
    return """WITH e AS (SELECT label, unnest(embedding) AS x,
                  unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings)
SELECT label, pos::BIGINT AS pos, round(avg(x::DOUBLE), 6) AS mean, max(x::DOUBLE) AS max
FROM e GROUP BY label, pos"""


# --------------------------------------------------------------------------
# image requests
# --------------------------------------------------------------------------

def _requests_cte() -> str:
    hh, hw = h_int("doc_id", "h"), h_int("doc_id", "w")
    hs, hc = h_int("doc_id", "steps"), h_int("doc_id", "scale")
    return f"""rq AS (SELECT doc_id AS request_id, text AS prompt,
  CASE WHEN {hh} % 5 <> 0 THEN (128 * ({hh} % 32 + 1))::INTEGER END AS h,
  CASE WHEN {hw} % 5 <> 0 THEN (128 * ({hw} % 32 + 1))::INTEGER END AS w,
  CASE WHEN {hc} % 3 <> 0 THEN ({hc} % 100) / 10.0::DOUBLE END AS scale,
  CASE WHEN {hs} % 7 <> 0 THEN ({hs} % 300 + 1)::INTEGER END AS ddim_steps
  FROM documents),
rv AS (SELECT request_id, prompt, coalesce(h, 256) AS h, coalesce(w, 256) AS w,
  coalesce(scale, 5.0::DOUBLE) AS scale, coalesce(ddim_steps, 30) AS ddim_steps,
  8 AS n, 10.0::DOUBLE AS cond_scale FROM rq),
rr AS (SELECT *, CASE WHEN h::BIGINT * w > 524288 THEN 'pixels'
                      WHEN ddim_steps > 250 THEN 'steps' END AS reason FROM rv)"""


@sql("request_validate")
def _():
    return (f"WITH {_requests_cte()}\nSELECT request_id, h, w, scale, ddim_steps, n, cond_scale, "
            "reason, reason IS NULL AS valid FROM rr")


@sql("best_of_n")
def _():
    return """WITH sc AS (SELECT c.vec_id // 8 AS prompt_id, c.vec_id AS cand_id,
         round(list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda t: t[1]::DOUBLE * t[2]::DOUBLE)), 6) AS score
       FROM embeddings c JOIN embeddings q ON q.vec_id = c.vec_id // 8)
SELECT prompt_id, arg_max(cand_id, struct_pack(a := score, b := -cand_id)) AS best_id,
       max(score) AS best_score, count(*) AS n_candidates FROM sc GROUP BY prompt_id"""


@sql("safety_gate")
def _():
    lg = " , ".join(
        f"round(1 / (1 + exp(-({_bias(c)} + coalesce(sum(s) FILTER (WHERE cls = '{c}'), 0)))), 6) AS {c}"
        for c in ("toxic", "obscene", "sexual_explicit"))
    return f"""WITH {_requests_cte()},
{_lexicon_sum_cte({'low': 'lower(text)'})},
p AS (SELECT d.doc_id AS request_id, {lg} FROM documents d LEFT JOIN sums USING (doc_id) GROUP BY d.doc_id),
f AS (SELECT rr.request_id, greatest(p.toxic, p.obscene, p.sexual_explicit) > 0.5 AS nsfw
      FROM rr JOIN p USING (request_id) WHERE rr.reason IS NULL)
SELECT request_id, CASE WHEN coalesce(nsfw, false) THEN 'withheld' ELSE 'shown' END AS status,
       CASE WHEN coalesce(nsfw, false) THEN '😳 Sorry but I can''t show you this!' END AS message FROM f"""


# --------------------------------------------------------------------------
# vocabulary
# --------------------------------------------------------------------------

@sql("word_counts")
def _():
    return (f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{WORD_RE}')) "
            "AS word FROM documents) GROUP BY word")


@sql("bpe_pairs")
def _():
    return f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{WORD_RE}'))
                  AS word FROM documents) GROUP BY word),
p AS (SELECT n, unnest(range(1, length(word))) AS i, word FROM w WHERE length(word) >= 2)
SELECT substr(word, i::BIGINT, 1) AS left, substr(word, i::BIGINT + 1, 1) AS right, sum(n)::BIGINT AS count
FROM p GROUP BY 1, 2"""


# --------------------------------------------------------------------------
# streaming: the final tables equal the batch operators on the same events
# --------------------------------------------------------------------------

@sql("stream_ledger")
def _():
    return ledger_cte(SCORED_EVENTS) + "\nSELECT * FROM users"


@sql("stream_last_message")
def _():
    return SCORED_EVENTS + """
SELECT guild, author, channel, arg_max(message_id, struct_pack(a := ts, b := message_id)) AS message_id,
       arg_max(text, struct_pack(a := ts, b := message_id)) AS text
FROM scored GROUP BY guild, author, channel"""


@sql("stream_history")
def _():
    return SCORED_EVENTS + f"\nSELECT message_id AS id, guild, author, {', '.join(CLASSES)} FROM scored WHERE {MAXS} > 0.5"


@sql("stream_quarantine")
def _():
    return SCORED_EVENTS + "\nSELECT message_id, guild, author, channel FROM tried WHERE failed"


@sql("split_exact")
def _():
    return f"""WITH {_training_cte()},
r AS (SELECT id, row_number() OVER (ORDER BY {h_int('id', 'split')}, id) AS rn,
             count(*) OVER () AS n FROM tf)
SELECT id, CASE WHEN rn <= n // 10 THEN 'holdout' ELSE 'train' END AS split FROM r"""


@sql("stats_request_report")
def _():
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTERS)
    cols = ", ".join(COUNTERS)
    cats = f" || {NL} || {TAB} || {TAB} || ".join(
        f"'{h}: ' || CAST({c} AS VARCHAR)" for h, c in zip(CLASSES_HUMAN, CLASSES))
    block = (f"'For ' || nm || ' I found the following:' || {NL} || {TAB} || ' Toxic incidents: ' || "
             f"CAST(incidents AS VARCHAR) || '/' || CAST(total_seen AS VARCHAR) || ', ' || "
             f"printf('%.1f', 100.0::DOUBLE * incidents / total_seen) || '% toxic' || {NL} || {TAB} || "
             f"'Favorite form of toxicity (unweighted... for now): ' || {favourite()} || {NL} || {TAB} || "
             f"'Incidents by category:' || {NL} || {TAB} || {TAB} || {cats} || {NL}")
    return ledger_cte() + f""",
req AS ({STATS_REQUESTS}),
ment AS (SELECT request_id, guild, unnest(mentions) AS author,
                unnest(generate_series(0, len(mentions) - 1)) AS pos FROM req),
g AS (SELECT guild, {sums} FROM users GROUP BY guild),
t AS (SELECT request_id, pos, CAST(author AS VARCHAR) AS nm, {cols}
      FROM ment JOIN users USING (guild, author)
      UNION ALL
      SELECT request_id, 0 AS pos, guild AS nm, {cols}
      FROM req JOIN g USING (guild) WHERE len(mentions) = 0)
SELECT request_id, regexp_replace(string_agg({block}, '' ORDER BY pos), '\\s+$', '') AS report
FROM t GROUP BY request_id"""


@sql("stream_actions")
def _():
    routed = _routed(EVENT_MESSAGES)
    return f"""WITH t AS ({_tier_sql(SCORED_EVENTS)}),
a AS ({_apology_sql(SCORED_EVENTS)}),
p AS ({_persona_sql(routed)})
SELECT message_id, tier AS action, payload FROM t WHERE tier <> 'none'
UNION ALL SELECT message_id, 'apology', reply FROM a WHERE apology
UNION ALL SELECT message_id, 'persona', reply FROM p WHERE fired"""


@sql("lookup_users")
def _():
    return ledger_cte() + f""",
req AS ({STATS_REQUESTS}),
ment AS (SELECT request_id, guild, unnest(mentions) AS author,
                unnest(generate_series(0, len(mentions) - 1)) AS pos FROM req)
SELECT m.request_id, m.pos::BIGINT AS pos, m.guild, m.author, u.* EXCLUDE (guild, author)
FROM ment m JOIN users u USING (guild, author)"""


@sql("reply_pick")
def _():
    from ..functions.classes import APOLOGY_REPLIES, TOXIC_REPLIES
    t = _pick(_list(TOXIC_REPLIES), "toxic_reply").replace("message_id", "doc_id")
    a = _pick(_list(APOLOGY_REPLIES), "apology_reply").replace("message_id", "doc_id")
    return f"SELECT doc_id AS message_id, {t} AS toxic_reply, {a} AS apology_reply FROM documents"


@sql("training_frame")
def _():
    return f"WITH {_training_cte()}\nSELECT * FROM tf"


@sql("scan_training")
def _():
    return f"WITH {_training_cte()}\nSELECT tf.* FROM tf WHERE id % 100 <> 7"
