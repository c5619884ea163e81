"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables (or data Spark derives from them) in full;
nothing is sampled, capped or filtered to a subset to keep a check cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import CLASSES, IDENTITY_COLUMNS, TRAINING_TOXICITY_COLUMNS
from ..functions.columns import display_name
from ..operators import actions as A
from ..operators import features as FE
from ..operators import labels as LB
from ..operators import ledger as L
from ..operators import requests as RQ
from ..operators import routing as R
from ..operators import scoring as SC
from ..operators import training as TR
from ..operators import vocab as VO
from ..operators.flow import process
from ..session import scratch_path
from ..sources import files as FI
from ..sources import tables as TB
from ..streaming import ledger_stream as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _chat(spark, sf):
    """Messages of every kind (commands, prompts, bots, apologies, ...) derived from documents."""
    return TB.chat_from_documents(TB.table(spark, sf, "documents"))


def _flow(spark, sf):
    return process(_chat(spark, sf), TB.fixture_scores, TB.BOT_AUTHOR)


def _scored(spark, sf):
    return _flow(spark, sf).scored


def _users(spark, sf):
    return L.ledger(_scored(spark, sf))


# --------------------------------------------------------------------------
# ledger
# --------------------------------------------------------------------------

@query("ledger")
def q_ledger(spark, sf):
    return _users(spark, sf)


@query("history")
def q_history(spark, sf):
    return L.history(_scored(spark, sf))


@query("last_message")
def q_last_message(spark, sf):
    return L.last_message(_scored(spark, sf))


@query("guild_stats")
def q_guild_stats(spark, sf):
    return L.guild_stats(_users(spark, sf))


@query("user_stats_all_guilds")
def q_user_stats_all_guilds(spark, sf):
    return L.user_stats_all_guilds(_users(spark, sf))


@query("category_counts")
def q_category_counts(spark, sf):
    return L.category_counts(L.guild_rollup(_users(spark, sf)), ["guild"])


# --------------------------------------------------------------------------
# routing
# --------------------------------------------------------------------------


CONV_BOT_USER = 0  # the assistant's role code: its turns are the bot's own


def _docs(spark, sf):
    return TB.messages_from_documents(TB.text_table(spark, sf, "documents"))


@query("eligible")
def q_eligible(spark, sf):
    m = TB.messages_from_conversations(TB.table(spark, sf, "conversations"))
    return m.select("message_id", "guild", "author",
                    R.gate_reason(CONV_BOT_USER).alias("reason"))


@query("route")
def q_route(spark, sf):
    return R.route(_chat(spark, sf), TB.BOT_AUTHOR).select("message_id", "route", "prompt")


@query("prompt_extract")
def q_prompt_extract(spark, sf):
    return _chat(spark, sf).select("message_id", R.is_image_prompt().alias("is_image"),
                                   R.prompt_text().alias("prompt"))


@query("score_quarantine")
def q_score_quarantine(spark, sf):
    scored = TB.fixture_scores(_flow(spark, sf).routed)
    return (scored.select(R.score_status(scored).alias("status"))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


@query("score_replies")
def q_score_replies(spark, sf):
    """F4 on JSON replies keyed by class name: cut off, without a class, or absent ones go to quarantine."""
    scored = TB.fixture_scores(_flow(spark, sf).routed)
    reply, kind = SC.scores_to_json(scored), F.col("message_id") % 10
    sent = (F.when(kind == 4, F.substring(reply, 1, 40)).when(kind == 5, F.regexp_replace(reply, r',"[^"]*":[^,]*\}$', "}"))
            .when(kind != 6, reply))
    read = SC.scores_from_json(scored.select("message_id", sent.alias("scores_json")))
    status = R.score_status(read)
    return read.select("message_id", status.alias("status"), F.when(status == "scored", F.round("insult", 6)).alias("insult"))


@query("display_name")
def q_display_name(spark, sf):
    """Name and four-digit discriminator."""
    four = F.lpad((F.col("message_id") % 10_000).cast("string"), 4, "0")
    return _docs(spark, sf).select("message_id", display_name("guild", four).alias("name"))


@query("quarantine")
def q_quarantine(spark, sf):
    return _flow(spark, sf).quarantine.select("message_id", "guild", "author", "channel")


@query("class_flags")
def q_class_flags(spark, sf):
    return R.class_flags(_scored(spark, sf))


@query("user_stats")
def q_user_stats(spark, sf):
    return L.with_rate_and_favourite(_users(spark, sf))


def _stat_targets(spark, sf):
    """One aggregation gives user and guild rows (grouping sets), one
    join answers every request target (null-safe on author for guild rows).
    Unknown users match nothing (no row)."""
    stats = L.ledger_and_guilds(_scored(spark, sf))
    reqs = TB.stats_requests_from_documents(TB.table(spark, sf, "documents"))
    targets = R.stats_targets(reqs).withColumn("pos", F.col("pos").cast("bigint"))
    j = targets.join(stats, (targets["guild"] == stats["guild"])
                     & (targets["kind"] == stats["kind"])
                     & targets["author"].eqNullSafe(stats["author"]))
    return j.select(targets["request_id"], targets["pos"], targets["kind"], targets["guild"],
                    targets["author"], *[stats[c] for c in L.COUNTERS])


@query("stats_requests")
def q_stats_requests(spark, sf):
    out = L.with_rate_and_favourite(_stat_targets(spark, sf))
    return out.select("request_id", "pos", "kind", "guild", "author", "incidents",
                      "total_seen", "rate", "favourite")


@query("stats_request_report")
def q_stats_request_report(spark, sf):
    """A8 per request: one stats block per mentioned user in mention order, or
    the guild block without mentions, joined and right-stripped. A request's
    group is bounded by the mentions of one message."""
    rows = _stat_targets(spark, sf)
    name = F.when(F.col("kind") == "user", F.col("author").cast("string")).otherwise(F.col("guild"))
    per = rows.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", L.stats_text(name).alias("t")))).alias("b"))
    text = F.regexp_replace(F.array_join(F.transform("b", lambda x: x["t"]), ""), r"\s+$", "")
    return per.select("request_id", text.alias("report"))


# --------------------------------------------------------------------------
# scoring
# --------------------------------------------------------------------------

@query("score_lexicon")
def q_score_lexicon(spark, sf):
    return SC.lexicon_scores(_docs(spark, sf)).select("message_id", *CLASSES)


@query("score_case_max")
def q_score_case_max(spark, sf):
    return SC.case_max_scores(_docs(spark, sf)).select("message_id", *CLASSES)


@query("rate_report")
def q_rate_report(spark, sf):
    return SC.rate_report(TB.fixture_scores(_docs(spark, sf)))


@query("token_list")
def q_token_list(spark, sf):
    return SC.token_list(_docs(spark, sf))


# --------------------------------------------------------------------------
# actions and reports
# --------------------------------------------------------------------------

@query("tier")
def q_tier(spark, sf):
    return A.tier(_scored(spark, sf))


@query("apology")
def q_apology(spark, sf):
    return A.apology(_scored(spark, sf))


def _personas(spark):
    """The configuration (read through Spark) and its personas."""
    cfg = FI.load_persona_config()
    return cfg, FI.personas(spark, cfg)


def _pool(cfg):
    return cfg["user"].get("all", []), cfg["user"].get("p_default", 0.2)


@query("persona_reply")
def q_persona_reply(spark, sf):
    cfg, per = _personas(spark)
    return A.persona_reply(_flow(spark, sf).routed, per, *_pool(cfg))


@query("actions")
def q_actions(spark, sf):
    cfg, per = _personas(spark)
    flow = _flow(spark, sf)
    return A.actions(flow.scored, flow.routed, per, *_pool(cfg), **FI.reply_lists(cfg))


@query("award_reply")
def q_award_reply(spark, sf):
    """A5: reactions derived from events (emoji by a hash, target = user_id) on the bot's own messages."""
    emoji = A.pick(F.array(*[F.lit(e) for e in REACTION_EMOJIS]), "event_id", "emoji")
    reactions = TB.table(spark, sf, "events").select(
        F.col("event_id").alias("reaction_id"), F.col("user_id").alias("message_id"), emoji.alias("emoji"))
    return A.award_reply(reactions, _chat(spark, sf), TB.BOT_AUTHOR)


REACTION_EMOJIS = ["🎖", "🏅", "🥇", "👍", "👎"]


def _why(spark, sf):
    last = L.last_message(_scored(spark, sf))
    return last, A.why_report(last, SC.lexicon_scores(last, decimals=None))


@query("why_report")
def q_why_report(spark, sf):
    """The latest message per (guild, author, channel), re-scored by the
    lexicon scorer on its text."""
    return _why(spark, sf)[1]


def _why_requests(spark, sf):
    """A ``%why`` request per document; authors 7 and 8 have never written."""
    return TB.table(spark, sf, "documents").select(
        F.col("doc_id").alias("request_id"), F.col("source").alias("guild"), (F.col("doc_id") % 9).alias("author"),
        F.col("lang").alias("channel"), F.concat(F.lit("user"), (F.col("doc_id") % 9).cast("string")).alias("name"))


@query("lookup_last")
def q_lookup_last(spark, sf):
    """the latest message by (guild, author, channel) for every request; unknown keys give no row."""
    last = L.last_message(_scored(spark, sf))
    return L.lookup(last, _why_requests(spark, sf).drop("name"), ("guild", "author", "channel"))


@query("why_answers")
def q_why_answers(spark, sf):
    return A.why_answers(_why_requests(spark, sf), *_why(spark, sf))


@query("stats_report")
def q_stats_report(spark, sf):
    g = L.guild_rollup(_users(spark, sf))
    txt = F.regexp_replace(L.stats_text(F.col("guild")), r"\s+$", "")
    return g.select("guild", txt.alias("report"))


# --------------------------------------------------------------------------
# training data, losses, metrics
# --------------------------------------------------------------------------


def _train(spark, sf):
    return TB.training_frame(spark, sf)


def _with_logits(train):
    return SC.with_lexicon_logits(train, F.lower(F.col("comment_text")))


@query("labels_binary")
def q_labels_binary(spark, sf):
    return LB.labels_binary(_train(spark, sf))


@query("identity_mask")
def q_identity_mask(spark, sf):
    return LB.identity_mask(_train(spark, sf))


@query("split_hash")
def q_split_hash(spark, sf):
    return LB.split_hash(_train(spark, sf).select("id")).select("id", "split")


@query("bce_loss")
def q_bce_loss(spark, sf):
    return LB.bce_loss(_with_logits(_train(spark, sf)), CLASSES)


@query("bce_masked")
def q_bce_masked(spark, sf):
    t = _with_logits(_train(spark, sf))
    return LB.bce_loss(t, IDENTITY_COLUMNS, logit="logit_identity_attack")


@query("eval_metrics")
def q_eval_metrics(spark, sf):
    t = _with_logits(_train(spark, sf))
    wide = t.select(*[(F.col(c) > 0.5).cast("int").alias(f"y_{c}") for c in CLASSES],
                    *[(F.col(f"logit_{c}") > 0).cast("int").alias(f"p_{c}") for c in CLASSES])
    return LB.eval_metrics(wide, CLASSES)


# --------------------------------------------------------------------------
# features
# --------------------------------------------------------------------------

CYCLIC_RESOLUTION = 16


@query("cyclic_encode")
def q_cyclic_encode(spark, sf):
    ev = TB.table(spark, sf, "events")
    enc = FE.cyclic_encoding(F.col("value"), CYCLIC_RESOLUTION)
    return (ev.select("event_id", F.posexplode(enc).alias("i", "enc"))
            .select("event_id", F.col("i").cast("bigint").alias("i"),
                    F.round("enc", 9).alias("enc")))


@query("vector_pool")
def q_vector_pool(spark, sf):
    p = FE.vector_pool(TB.table(spark, sf, "embeddings"), ["label"])
    return p.select("label", "pos", F.round("mean", 6).alias("mean"), "max")


# --------------------------------------------------------------------------
# image requests
# --------------------------------------------------------------------------

def _requests(spark, sf, text=False):
    read = TB.text_table if text else TB.table  # the prompt is scored in safety_gate
    return TB.image_requests_from_documents(read(spark, sf, "documents"))


@query("request_validate")
def q_request_validate(spark, sf):
    return RQ.validate(_requests(spark, sf)).select(
        "request_id", "h", "w", "scale", "ddim_steps", "n", "cond_scale", "reason", "valid")


@query("best_of_n")
def q_best_of_n(spark, sf):
    """Eight candidates per prompt, all scored against the prompt's own query vector."""
    emb = TB.table(spark, sf, "embeddings")
    prompts = emb.select(F.col("vec_id").alias("prompt_id"), F.col("embedding").alias("query"))
    cands = (RQ.score_candidates(emb.withColumn("prompt_id", F.expr("vec_id div 8")), prompts, "prompt_id")
             .select("prompt_id", F.col("vec_id").alias("cand_id"), F.round("score", 6).alias("score")))
    return RQ.best_of_n(cands)


@query("safety_gate")
def q_safety_gate(spark, sf):
    v = RQ.validate(_requests(spark, sf, text=True)).where("valid")
    s = SC.lexicon_scores(v.select("request_id", F.col("prompt").alias("text")))
    flagged = s.select("request_id", (F.greatest("toxic", "obscene", "sexual_explicit") > 0.5).alias("nsfw"))
    return RQ.safety_gate(flagged).select("request_id", "status", "message")


# --------------------------------------------------------------------------
# vocabulary learning and encoding
# --------------------------------------------------------------------------


BPE_MERGES = 10_000    # merges learned by the registered queries, as many as the vocabulary of the own model
HEAD_IDS, TAIL_IDS, PAD_TO = 256, 128, 256


@query("word_counts")
def q_word_counts(spark, sf):
    return VO.word_counts(TB.text_table(spark, sf, "documents"))


@query("bpe_pairs")
def q_bpe_pairs(spark, sf):
    words = VO.word_counts(TB.text_table(spark, sf, "documents"))
    return VO.pair_counts(VO.initial_symbols(words))


_LEARNED: dict[tuple[str, str], tuple] = {}


def _learn(spark, sf):
    """Merges and alphabet, learned once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LEARNED:
        words = VO.word_counts(TB.text_table(spark, sf, "documents")).checkpoint(eager=True)
        merges = VO.learn_merges(spark, words, BPE_MERGES)
        alpha = [r["ch"] for r in VO.alphabet(words).collect()]  # bounded by the character set
        _LEARNED[key] = (words, merges, alpha)
    return _LEARNED[key]


@query("bpe_merges")
def q_bpe_merges(spark, sf):
    _, merges, _ = _learn(spark, sf)
    return VO.merges_frame(spark, merges)


def _encoded(spark, sf):
    _, merges, alpha = _learn(spark, sf)
    enc = VO.encoder(spark, alpha, merges)
    return _docs(spark, sf).select("message_id", enc(VO.pretokens(F.col("text"))).alias("ids"))


@query("encode_head")
def q_encode_head(spark, sf):
    e = _encoded(spark, sf)
    ids = VO.head_ids(F.col("ids"), HEAD_IDS)
    return e.select("message_id", F.size("ids").cast("bigint").alias("n_ids"), ids.alias("ids"))


@query("encode_tail")
def q_encode_tail(spark, sf):
    e = _encoded(spark, sf)
    ids = VO.tail_ids(F.col("ids"), TAIL_IDS)
    return e.select("message_id", F.size("ids").cast("bigint").alias("n_ids"), ids.alias("ids"))


@query("pad_mask")
def q_pad_mask(spark, sf):
    e = _encoded(spark, sf)
    padded, mask = LB.pad_mask(VO.head_ids(F.col("ids"), HEAD_IDS), PAD_TO, VO.pad_id())
    return e.select("message_id", padded.alias("input_ids"), mask.alias("attention_mask"))


TRAIN_BATCH = 32


@query("pad_batch")
def q_pad_batch(spark, sf):
    """Batches padded to their longest text; ids here are the last code points, which SQL can number too."""
    m = _docs(spark, sf).select("message_id", "text")
    points = F.transform(F.regexp_extract_all("text", F.lit("(?s)."), 0), lambda c: F.ascii(c))
    b = LB.pad_batches(m.select("message_id", VO.tail_ids(points, TAIL_IDS).alias("ids")), "ids", "message_id",
                       TRAIN_BATCH, VO.pad_id())
    return b.select("message_id", "batch", "pad_to", F.size("input_ids").alias("n_input"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_known"))


# --------------------------------------------------------------------------
# streaming (run to completion with availableNow, then read the sink)
# --------------------------------------------------------------------------


def _run_stream(spark, sf, output):
    """The events in three deliveries, some of them twice, each a micro-batch (of as many files as it has)."""
    base = scratch_path(spark, "stream")
    ev = TB.table(spark, sf, "events")
    part = TB.hash_int("event_id", "part") % 3
    for k in range(3):
        again = (F.col("event_id") % 10 == 0) & ((part + 1) % 3 == k)
        ev.where((part == k) | again).write.parquet(f"{base}/in/{k}")
    files = max(len(spark.read.schema(ev.schema).parquet(f"{base}/in/{k}").inputFiles()) for k in range(3))
    cfg, per = _personas(spark)
    files = min(max(files, 1), ST.MAX_FILES_PER_TRIGGER)
    messages = TB.chat_from_events(ST.event_source(spark, f"{base}/in", max_files_per_trigger=files))
    ST.run_to_end(ST.start(messages, base, output, personas=per, pool_all=_pool(cfg)[0],
                           p_default=_pool(cfg)[1], replies=FI.reply_lists(cfg)))
    return base


@query("stream_ledger")
def q_stream_ledger(spark, sf):
    return ST.current_users(spark, _run_stream(spark, sf, "users"))


@query("stream_last_message")
def q_stream_last_message(spark, sf):
    return ST.current_last_messages(spark, _run_stream(spark, sf, "last"))


@query("stream_history")
def q_stream_history(spark, sf):
    return ST.appended(spark, _run_stream(spark, sf, "history"), "history")


@query("stream_quarantine")
def q_stream_quarantine(spark, sf):
    return ST.appended(spark, _run_stream(spark, sf, "quarantine"), "quarantine").select("message_id", "guild", "author", "channel")


# --------------------------------------------------------------------------
# training and the learned scorer
# --------------------------------------------------------------------------


_SAVED: dict[tuple, str] = {}  # folders of models that this session has saved


def _saved(spark, sf, name, make):
    """The folder of a model, made and saved by the first query of the session that needs it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SAVED:
        folder = scratch_path(spark, name)
        make(folder)
        _SAVED[key] = folder
    return _SAVED[key]


def _split(spark, sf, part):
    return LB.split_hash(_train(spark, sf)).where(F.col("split") == part)


def _fit(spark, sf):
    def make(folder):
        TR.fit(_split(spark, sf, "train")).save(folder)
    return TR.MultiLabelModel.load(_saved(spark, sf, "model", make))


@query("train_eval")
def q_train_eval(spark, sf):
    return TR.evaluate(_fit(spark, sf), _split(spark, sf, "holdout"))


JOINT_EPOCHS = 3


def _joint(spark, sf):
    def make(folder):
        TR.train_epochs(TR.new_model(), _split(spark, sf, "train"), JOINT_EPOCHS, folder, _split(spark, sf, "holdout"))
    return _saved(spark, sf, "joint", make)


@query("train_joint")
def q_train_joint(spark, sf):
    """Losses of every epoch of the joint model, classes and masked identity targets."""
    rows = TR.load_joint(spark, _joint(spark, sf)).history
    return spark.createDataFrame(
        [(r["epoch"], r["train_loss"], r["holdout_classes"], r["holdout_identity"], r["holdout_sum"]) for r in rows],
        "epoch int, train_loss double, holdout_classes double, holdout_identity double, holdout_sum double")


@query("score_joint")
def q_score_joint(spark, sf):
    """M1/M2/M7: every message scored by the saved joint model, three case variants in a batch."""
    out = TR.batch_scorer(spark, _joint(spark, sf))(_docs(spark, sf).select("message_id", "text"))
    return out.select("message_id", *[F.round(c, 6).alias(c) for c in CLASSES])


@query("score_learned")
def q_score_learned(spark, sf):
    model = _fit(spark, sf)
    out = model.transform(_docs(spark, sf).select("message_id", "text"), text_col="text",
                          keep=("message_id",))
    return out.select("message_id", *[F.round(c, 6).alias(c) for c in CLASSES])


@query("split_exact")
def q_split_exact(spark, sf):
    return LB.split_exact(_train(spark, sf).select("id")).select("id", "split")


@query("stream_actions")
def q_stream_actions(spark, sf):
    return ST.appended(spark, _run_stream(spark, sf, "actions"), "actions")


@query("scan_training")
def q_scan_training(spark, sf):
    """The training rows written as CSV (other column order, an extra
    column, a malformed row per hundred) and read back by name."""
    path = scratch_path(spark, "training-csv")
    t = _train(spark, sf)
    for src, dst in zip(TRAINING_TOXICITY_COLUMNS, CLASSES):
        if src != dst:
            t = t.withColumnRenamed(dst, src)
    cols = [F.col(c).cast("string").alias(c) for c in reversed(t.columns) if c != "toxic"]
    bad = F.when(F.col("id") % 100 == 7, F.lit("n/a")).otherwise(F.col("toxic").cast("string"))
    (t.select(F.lit("x").alias("extra"), *cols, bad.alias("toxic")).write.option("header", True).option("escape", '"')
     .csv(path))
    return FI.read_training_csv(spark, path)


@query("lookup_users")
def q_lookup_users(spark, sf):
    """every mentioned (guild, author) looked up in the ledger at once
    (a join with the key table; unknown and NULL keys give no row)."""
    reqs = TB.stats_requests_from_documents(TB.table(spark, sf, "documents"))
    keys = (R.stats_targets(reqs).where(F.col("kind") == "user")
            .select("request_id", F.col("pos").cast("bigint").alias("pos"), "guild", "author"))
    return L.lookup(_users(spark, sf), keys)


@query("reply_pick")
def q_reply_pick(spark, sf):
    """A3: the repeatable choice from each reply list, for every message."""
    from ..functions.classes import APOLOGY_REPLIES, TOXIC_REPLIES
    from ..functions.columns import pick
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    return TB.table(spark, sf, "documents").select(
        F.col("doc_id").alias("message_id"),
        pick(lit(TOXIC_REPLIES), "doc_id", "toxic_reply").alias("toxic_reply"),
        pick(lit(APOLOGY_REPLIES), "doc_id", "apology_reply").alias("apology_reply"))


@query("training_frame")
def q_training_frame(spark, sf):
    """S1 stand-in: the training schema (text, 7 soft toxicity labels, 24
    nullable identity labels, 5 reaction counts) derived from the tables."""
    return _train(spark, sf)


@query("bpe_vocab")
def q_bpe_vocab(spark, sf):
    """T5 output: token -> id (special tokens, alphabet by code point, merges
    in creation order). Bounded by the vocabulary size parameter."""
    _, merges, alpha = _learn(spark, sf)
    vocab = VO.vocabulary(alpha, merges)
    return spark.createDataFrame(sorted(vocab.items(), key=lambda kv: kv[1]),
                                 "token string, id int")
