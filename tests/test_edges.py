"""Edge cases on in-code rows (cases the driver tables do not reach)."""
from datetime import datetime

from pyspark.sql import functions as F

from moderata.functions.classes import (APOLOGY_REPLIES, CLASSES, IDENTITY_REACTION,
                                        PLAIN_REACTION, TOXIC_REPLIES)
from moderata.operators import actions as A
from moderata.operators import labels as LB
from moderata.operators import ledger as L
from moderata.operators import requests as RQ
from moderata.operators import routing as R
from moderata.sources import files as FI
from moderata.sources import schemas


def messages(spark, rows):
    """rows: (message_id, guild, channel, author, is_bot, text)"""
    full = [(i, g, c, a, b, datetime(2024, 1, 1, 0, 0, i % 60), t) for i, g, c, a, b, t in rows]
    return spark.createDataFrame(full, schemas.MESSAGE)


def scored(spark, rows):
    """rows: (message_id, guild, author, channel, text, [7 scores])"""
    data = [(i, g, c, a, False, None, t, *[None if v is None else float(v) for v in s])
            for i, g, a, c, t, s in rows]
    from pyspark.sql import types as T
    schema = T.StructType(list(schemas.MESSAGE.fields)
                          + [T.StructField(c, T.DoubleType()) for c in CLASSES])
    return spark.createDataFrame(data, schema)


def test_gate_order_and_routes(spark):
    m = messages(spark, [
        (1, "g", "c", 10, False, "hello"),
        (2, "g", "c", 10, False, ""),
        (3, "g", "c", 10, False, "%stats"),
        (4, "g", "c", 10, False, "Toxic SHOW ME a cat"),
        (5, "g", "c", 10, False, "toxicbot show me  x y"),
        (6, "g", "c", 10, False, "toxic show me"),
        (7, "g", "c", 99, True, "%bot and self"),
        (8, "g", "c", 11, True, "a bot"),
        (9, None, "c", 10, False, "no guild"),
    ])
    got = {r.message_id: (r.route, r.prompt)
           for r in R.route(m, bot_user_id=99).collect()}
    assert got[1] == ("score", None)
    assert got[2] == ("empty", None)
    assert got[3] == ("command", None)
    assert got[4] == ("image", "a cat")          # case-blind extraction
    assert got[5] == ("image", " x y")
    assert got[6] == ("score", None)             # no trailing space: scored
    assert got[7] == ("self", None)              # self wins over bot and prefix
    assert got[8] == ("bot", None)
    assert got[9] == ("no_guild", None)
    assert {r.message_id for r in R.to_score(m, 99).collect()} == {1, 6}


def test_apology_tokens(spark):
    m = messages(spark, [(1, "g", "c", 1, False, "sorry toxic bot"),
                         (2, "g", "c", 1, False, "I am SORRY ToxicBot"),
                         (3, "g", "c", 1, False, "Sorry, TOXIC"),
                         (4, "g", "c", 1, False, "  sorry\tnot toxic  ")])
    got = {r.message_id: (r.apology, r.reply) for r in A.apology(m).collect()}
    assert got[1][0] and got[2][0] and got[4][0]
    assert not got[3][0] and got[3][1] is None
    assert got[1][1] in APOLOGY_REPLIES


def test_threshold_and_tiers(spark):
    z = [0.0] * 7
    rows = [
        (1, "g", 1, "c", "t", [0.5] * 7),                       # exactly 0.5: nothing
        (2, "g", 1, "c", "t", [0.5000001] + [0.0] * 6),         # one class
        (3, "g", 1, "c", "t", [0.9, 0.9, 0.9, 0.9, 0, 0, 0]),   # 4 with identity: reply
        (4, "g", 1, "c", "t", [0.9, 0, 0, 0.9, 0, 0, 0]),       # 2 with identity
        (5, "g", 1, "c", "t", [0.9, 0.9, 0, 0, 0, 0, 0]),       # 2 without
        (6, "g", 2, "c", "t", z),
    ]
    s = scored(spark, rows)
    t = {r.message_id: (r.n_flags, r.tier, r.payload) for r in A.tier(s).collect()}
    assert t[1][:2] == (0, "none") and t[1][2] is None
    assert t[2][:2] == (1, "none")
    assert t[3][:2] == (4, "reply") and t[3][2] in TOXIC_REPLIES
    assert t[4] == (2, "react_identity", IDENTITY_REACTION)
    assert t[5] == (2, "react", PLAIN_REACTION)
    led = {(r.guild, r.author): r for r in L.ledger(s).collect()}
    u1 = led[("g", 1)]
    assert (u1.total_seen, u1.incidents, u1.toxic, u1.identity_attack) == (5, 4, 4, 2)
    assert led[("g", 2)].incidents == 0
    hist = L.history(s).collect()
    assert sorted(r.id for r in hist) == [2, 3, 4, 5]


def test_quarantine_null_scores(spark):
    rows = [(1, "g", 1, "c", "t", [0.9] * 7), (2, "g", 1, "c", "t", [None] + [0.9] * 6),
            (3, "g", 1, "c", "t", [float("nan")] + [0.1] * 6)]
    ok, bad = R.split_quarantine(scored(spark, rows))
    assert [r.message_id for r in ok.collect()] == [1]
    assert sorted(r.message_id for r in bad.collect()) == [2, 3]


def test_last_message_literal_text_and_cut(spark):
    long101 = "x" * 101
    rows = [(1, "g", 1, "c", 'say "hi"', [0.0] * 7), (2, "g", 1, "c", "guild", [0.0] * 7),
            (3, "g", 2, "c", "y" * 100, [0.0] * 7), (4, "g", 3, "c", long101, [0.0] * 7),
            (5, "g", 4, "c", "Straße 🎉", [0.0] * 7)]
    s = scored(spark, rows)
    last = {(r.author): r.text for r in L.last_message(s).collect()}
    assert last[1] == "guild"                    # stored literally, latest wins
    rep = {r.author: r.report for r in A.why_report(L.last_message(s), L.last_message(s).join(
        s.select("message_id", *CLASSES), "message_id")).collect()}
    assert "'" + "y" * 100 + "'" in rep[2]       # 100 characters: shown whole
    assert "'" + "x" * 97 + "...'" in rep[3]     # 101: cut to 97 + ...
    assert "Straße 🎉" in rep[4]


def test_favourite_ties_and_zero(spark):
    df = spark.createDataFrame(
        [("a", 3, 5, 2, 2, 2, 2, 2, 2, 2), ("b", 0, 5, 0, 0, 0, 0, 0, 0, 0),
         ("c", 1, 0, 0, 0, 1, 0, 1, 0, 0)],
        "guild string, incidents long, total_seen long, " + ", ".join(f"{c} long" for c in CLASSES))
    got = {r.guild: (r.favourite, r.rate) for r in L.with_rate_and_favourite(df).collect()}
    assert got["a"] == ("Toxic", 60.0)           # all equal: first class wins
    assert got["b"] == ("Toxic", 0.0)
    assert got["c"][0] == "Obscene" and got["c"][1] is None   # nothing seen: no rate


def test_persona_rules(spark):
    cfg = {"user": {"all": ["A"], "p_default": 1.0,
                    "1": {"_name_": "p-given", "p": 1.0, "resps": ["x"]},
                    "2": {"_name_": "default-p", "resps": ["y"]},
                    "3": {"_name_": "never", "p": 0.0, "resps": ["z"]}}}
    per = FI.personas(spark, cfg)
    m = messages(spark, [(i, "g", "c", a, False, "hi") for i, a in
                         [(1, 1), (2, 2), (3, 3), (4, 4)]])
    got = {r.author: (r.fired, r.reply) for r in
           A.persona_reply(m, per, cfg["user"]["all"], cfg["user"]["p_default"]).collect()}
    assert got[1][0] and got[1][1] in ("A", "x")
    assert got[2][0] and got[2][1] in ("A", "y")
    assert got[3] == (False, None)
    assert 4 not in got                          # unlisted users never fire
    empty = FI.personas(spark, {"user": {"all": [], "p_default": 1.0,
                                         "5": {"_name_": "e", "resps": []}}})
    m5 = messages(spark, [(9, "g", "c", 5, False, "hi")])
    assert A.persona_reply(m5, empty, [], 1.0).collect()[0].fired is False


def test_request_guard_boundaries(spark):
    rows = [(1, "p", 1024, 512, None, 30, None, None), (2, "p", 1024, 513, None, 30, None, None),
            (3, "p", 256, 256, 1.0, 250, None, None), (4, "p", 256, 256, 1.0, 251, None, None),
            (5, "p", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schemas.IMAGE_REQUEST)
    got = {r.request_id: r for r in RQ.validate(df).collect()}
    assert got[1].valid and got[3].valid
    assert got[2].reason == "pixels" and got[4].reason == "steps"
    r5 = got[5]
    assert (r5.h, r5.w, r5.scale, r5.ddim_steps, r5.n, r5.cond_scale) == (256, 256, 5.0, 30, 8, 10.0)


def test_identity_mask_values(spark):
    from moderata.functions.classes import IDENTITY_COLUMNS
    vals = [None, 0.0, 0.5, 0.51] + [None] * (len(IDENTITY_COLUMNS) - 4)
    df = spark.createDataFrame([(1, *vals)], "id long, " + ", ".join(
        f"{c} double" for c in IDENTITY_COLUMNS))
    got = {r.identity: (r.value, r.known) for r in LB.identity_mask(df).collect()}
    assert got[IDENTITY_COLUMNS[0]] == (0.0, False)
    assert got[IDENTITY_COLUMNS[1]] == (0.0, True)
    assert got[IDENTITY_COLUMNS[3]] == (0.51, True)


def test_award_reply(spark):
    m = messages(spark, [(1, "g", "c", 99, False, "bot text"), (2, "g", "c", 5, False, "user")])
    reacts = spark.createDataFrame(
        [(i, 1 if i % 2 else 2, "🥇" if i % 3 else "👍") for i in range(400)],
        "reaction_id long, message_id long, emoji string")
    got = A.award_reply(reacts, m, 99).collect()
    assert got and all(r.message_id == 1 for r in got)
    eligible = sum(1 for i in range(400) if i % 2 and i % 3)
    assert 0 < len(got) < eligible / 3           # about 10 %


def test_pad_mask(spark):
    df = spark.createDataFrame([([5, 6, 7],), (list(range(300)),), ([],)], "ids array<int>")
    padded, mask = LB.pad_mask(F.col("ids"), 8, 3)
    got = df.select(padded.alias("p"), mask.alias("m")).collect()
    assert got[0].p == [5, 6, 7, 3, 3, 3, 3, 3] and got[0].m == [1, 1, 1, 0, 0, 0, 0, 0]
    assert got[1].p == list(range(8)) and got[1].m == [1] * 8
    assert got[2].p == [3] * 8 and got[2].m == [0] * 8


def test_stats_targets_mentions(spark):
    req = spark.createDataFrame([(1, "g", [3, 4]), (2, "g", []), (3, "h", None)],
                                "request_id long, guild string, mentions array<long>")
    got = sorted((r.request_id, r.kind, r.author) for r in R.stats_targets(req).collect())
    assert got == [(1, "user", 3), (1, "user", 4), (2, "guild", None), (3, "guild", None)]


def test_scores_json_round_trip_by_name(spark):
    from moderata.operators import scoring as SC
    rows = [(1, "g", 1, "c", "t", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])]
    s = scored(spark, rows)
    js = s.select("message_id", SC.scores_to_json(s).alias("scores_json"))
    back = SC.scores_from_json(js).collect()[0]
    assert [back[c] for c in CLASSES] == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
    # keys in another order (a sorted JSON reply) still land in the right class
    reordered = spark.createDataFrame(
        [(2, '{"Identity Attack": 0.9, "Insult": 0.1, "Obscene": 0.2, "Severely Toxic": 0.3, '
             '"Sexually Explicit": 0.4, "Threat": 0.5, "Toxic": 0.6}'), (3, "not json")],
        "message_id long, scores_json string")
    got = {r.message_id: r for r in SC.scores_from_json(reordered).collect()}
    assert got[2].identity_attack == 0.9 and got[2].toxic == 0.6
    assert got[3].toxic is None
    ok, bad = R.split_quarantine(SC.scores_from_json(reordered))
    assert [r.message_id for r in ok.collect()] == [2]


def test_lookup_unknown_and_null_keys(spark):
    rows = [(1, "g", 1, "c", "t", [0.9] * 7), (2, "g", 2, "c", "t", [0.1] * 7)]
    users = L.ledger(scored(spark, rows))
    keys = spark.createDataFrame([("g", 1), ("g", 3), (None, 1), ("g", None)],
                                 "guild string, author long")
    got = L.lookup(users, keys).collect()
    assert [(r.guild, r.author, r.total_seen, r.incidents) for r in got] == [("g", 1, 1, 1)]


def test_lexicon_join_path_equals_inline(spark):
    from conftest import SF001
    from moderata.operators import scoring as SC
    from moderata.sources import tables as TB
    msgs = TB.messages_from_documents(TB.table(spark, SF001, "documents"))
    inline = SC.lexicon_scores(msgs).select("message_id", *CLASSES)
    joined = SC.lexicon_scores_join(msgs, SC.lexicon_table(spark, SC.DEFAULT_LEXICON)) \
        .select("message_id", *CLASSES)
    a = sorted(tuple(r) for r in inline.collect())
    b = sorted(tuple(r) for r in joined.collect())
    assert a == b and len(a) == msgs.count()
    # a lexicon over the inline limit takes the join path
    big = dict(SC.DEFAULT_LEXICON)
    big.update({f"zzterm{i}": {"toxic": 1.0} for i in range(SC.MAX_INLINE_TERMS)})
    c = sorted(tuple(r) for r in SC.lexicon_scores(msgs, big).select("message_id", *CLASSES).collect())
    assert c == a


def test_reference_intents_prediction_logits_and_one_message(spark):
    """The reference's three unit tests, by intent: a prediction gives seven
    values in [0, 1]; logits give seven values; one message gives one row."""
    from moderata.operators import scoring as SC
    m = messages(spark, [(1, "200", "100", 1234, False, "Hello world")])
    p = SC.case_max_scores(m).select(*CLASSES).collect()[0]
    assert len(p) == 7 and all(0.0 <= v <= 1.0 for v in p)
    lg = SC.case_max_scores(m, logits=True).select(*CLASSES).collect()[0]
    assert len(lg) == 7
    users = L.ledger(SC.lexicon_scores(m)).collect()
    assert len(users) == 1 and users[0].total_seen == 1 and users[0].guild == "200"


def test_case_max_join_path_equals_inline(spark):
    from conftest import SF001
    from moderata.operators import scoring as SC
    from moderata.sources import tables as TB
    msgs = TB.messages_from_documents(TB.table(spark, SF001, "documents"))
    inline = sorted(tuple(r) for r in SC.case_max_scores(msgs).select("message_id", *CLASSES).collect())
    big = dict(SC.DEFAULT_LEXICON)
    big.update({f"zzterm{i}": {"toxic": 1.0} for i in range(SC.MAX_INLINE_TERMS)})
    joined = sorted(tuple(r) for r in SC.case_max_scores(msgs, big).select("message_id", *CLASSES).collect())
    assert joined == inline


def test_numbers_print_as_the_exact_binary_value(spark):
    from moderata.functions.columns import fixed
    import random
    r = random.Random(1)
    values = [6.25, 0.125, 2.675, 0.0, 100.0, 1 / 3, 0.005, 0.015, 1.005, 99.995, 12.5, 0.045, 37.5]
    values += [100.0 * k / n for n in (8, 16, 32, 40, 7, 3) for k in range(n + 1)] + [r.random() * 100 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for x in df.select("v", fixed("v", 2).alias("two"), fixed("v", 1).alias("one")).collect():
        assert x.two == f"{x.v:.2f}" and x.one == f"{x.v:.1f}", x.v


def test_one_flow_for_all_sinks(spark):
    """Gated, image and failed messages reach no ledger, latest message or score-based action."""
    from moderata.operators.flow import process
    m = messages(spark, [(1, "g", "c", 1, False, "%cmd sorry toxic"), (2, "g", "c", 1, False, "sorry toxic"),
                         (3, "g", "c", 1, False, "sorry toxic failed"), (4, "g", "c", 1, False, "toxic show me x")])

    def scorer(x):
        return x.select("*", *[F.when(~F.col("text").contains("failed"), 0.9).alias(c) for c in CLASSES])
    flow = process(m, scorer)
    assert [r.message_id for r in flow.quarantine.collect()] == [3]
    assert [(r.total_seen, r.incidents) for r in L.ledger(flow.scored).collect()] == [(1, 1)]
    assert [r.message_id for r in L.last_message(flow.scored).collect()] == [2]
    acts = {(r.message_id, r.action): r.payload for r in A.actions(
        flow.scored, flow.routed, toxic_replies=["own"], apology_replies=["mine"]).collect()}
    assert acts == {(2, "reply"): "own", (2, "apology"): "mine"}


def test_every_outcome_occurs_in_the_checked_view(spark):
    import __spark_entry__ as E
    from conftest import SF01

    def values(name, col):
        return {r[0] for r in E.queries()[name](spark, SF01).select(col).distinct().collect()}
    assert values("route", "route") == {"score", "image", "command", "empty", "bot", "self", "no_guild"}
    assert values("apology", "apology") == {True, False}
    assert values("score_quarantine", "status") == {"scored", "quarantine"}
    assert values("safety_gate", "status") == {"shown", "withheld"}
    assert {"reply", "react", "react_identity", "apology", "persona"} == values("actions", "action")
    assert values("prompt_extract", "is_image") == {True, False}
