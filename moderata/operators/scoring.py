"""Scoring: text -> seven class probabilities, plus score formatting.

Two scorers:
* ``lexicon_scores`` (M4): logit = bias + sum of term weights, per class.
  Up to ``MAX_INLINE_TERMS`` terms the lexicon is inlined into the plan (a
  hash-set ``IN`` and map literals), so scoring is a per-row expression with
  the text tokenised once: no join, no shuffle. Larger lexicons go through
  ``lexicon_scores_join`` (an equi-join with the term table).
* ``case_max_scores`` (M2/M3): the same scorer on the text as is, upper- and
  lower-cased; the largest logit per class wins, then the sigmoid (monotone,
  so max before or after agrees). Three expressions + ``greatest``: no shuffle.
The learned model (M1) is in ``operators.training``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import CLASSES, CLASSES_HUMAN, FAILED_RATE
from ..functions.columns import TERM_PATTERN, WORD_PATTERN, rate_lines, sigmoid, tokens
from .routing import score_status

# Default lexicon (term -> {class: weight}) and per-class bias. A parameter,
# not reference data: the reference's scorer is a neural model whose weights
# are not part of it. Terms are lower-case.
DEFAULT_LEXICON: dict[str, dict[str, float]] = {
    "idiot": {"toxic": 3.0, "insult": 3.0},
    "moron": {"toxic": 3.0, "insult": 3.0},
    "stupid": {"toxic": 2.5, "insult": 2.0},
    "loser": {"toxic": 2.5, "insult": 2.5},
    "clown": {"toxic": 2.0, "insult": 2.0},
    "pathetic": {"toxic": 2.0, "insult": 1.5},
    "worthless": {"toxic": 2.5, "insult": 2.0, "severe_toxic": 1.0},
    "scum": {"toxic": 3.0, "insult": 2.5, "severe_toxic": 1.5},
    "trash": {"toxic": 2.0, "insult": 1.5},
    "disgusting": {"toxic": 2.0, "obscene": 1.5},
    "kill": {"threat": 3.5, "toxic": 1.5},
    "hate": {"toxic": 1.5, "identity_attack": 1.0},
}
DEFAULT_BIAS: dict[str, float] = {"toxic": -2.5, "severe_toxic": -4.0, "obscene": -3.5,
                                  "identity_attack": -4.0, "insult": -3.0, "threat": -4.5,
                                  "sexual_explicit": -4.5}
MAX_INLINE_TERMS = 5_000  # inlined as literals up to this size; a join beyond


def _class_map(lexicon: Mapping[str, Mapping[str, float]], c: str) -> Column | None:
    kv = []
    for term in sorted(lexicon):
        w = lexicon[term].get(c)
        if w:
            kv += [F.lit(term), F.lit(float(w))]
    return F.create_map(*kv) if kv else None


def _adder(m: Column):
    def add(acc, t):
        return acc + F.coalesce(F.try_element_at(m, t), F.lit(0.0))
    return add


def lexicon_hits(text: Column, lexicon: Mapping[str, Mapping[str, float]] = DEFAULT_LEXICON
                 ) -> Column:
    """Tokens of ``text`` that are lexicon terms (one regex pass; the term test
    is a hash-set ``IN``). Usually a handful per text, whatever its length."""
    if len(lexicon) > MAX_INLINE_TERMS:
        raise ValueError("lexicon too large to inline; use lexicon_scores_join")
    terms = sorted(lexicon)
    return F.filter(tokens(text, TERM_PATTERN), lambda t: t.isin(*terms))


def logits_from_hits(hits: Column, lexicon: Mapping[str, Mapping[str, float]] = DEFAULT_LEXICON,
                     bias: Mapping[str, float] = DEFAULT_BIAS) -> dict[str, Column]:
    out = {}
    for c in CLASSES:
        m = _class_map(lexicon, c)
        b = F.lit(float(bias.get(c, 0.0)))
        out[c] = b if m is None else b + F.aggregate(hits, F.lit(0.0), _adder(m))
    return out


def lexicon_logits(text: Column, lexicon: Mapping[str, Mapping[str, float]] = DEFAULT_LEXICON,
                   bias: Mapping[str, float] = DEFAULT_BIAS) -> dict[str, Column]:
    """Logit expressions per class for one text expression. Prefer
    ``with_lexicon_logits``, which tokenises once for all seven classes."""
    return logits_from_hits(lexicon_hits(text, lexicon), lexicon, bias)


def with_lexicon_logits(df: DataFrame, text: Column, prefix: str = "logit_",
                        lexicon=DEFAULT_LEXICON, bias=DEFAULT_BIAS,
                        tag: str = "") -> DataFrame:
    """Adds ``<prefix><class>`` logit columns; the text is tokenised once."""
    hits = f"_lex_hits{tag}"
    x = df.withColumn(hits, lexicon_hits(text, lexicon))
    lg = logits_from_hits(F.col(hits), lexicon, bias)
    return x.select("*", *[lg[c].alias(prefix + c) for c in CLASSES]).drop(hits)


def lexicon_table(spark, lexicon: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(term, class, weight) rows of a lexicon."""
    rows = [(t, c, float(w)) for t in sorted(lexicon) for c, w in lexicon[t].items() if w]
    return spark.createDataFrame(rows, "term string, class string, weight double")


def _join_sums(messages: DataFrame, lex: DataFrame, text: Column, key: str,
               prefix: str) -> DataFrame:
    """Adds ``<prefix><class>`` = summed weights of the text's terms (0 if none)."""
    toks = messages.select(key, F.explode(tokens(text, TERM_PATTERN)).alias("term"))
    sums = (toks.join(lex, "term")
            .groupBy(key).pivot("class", CLASSES).agg(F.sum("weight")))
    out = messages.join(sums.select(key, *[F.col(c).alias(prefix + c) for c in CLASSES]),
                        key, "left")
    for c in CLASSES:
        out = out.withColumn(prefix + c, F.coalesce(F.col(prefix + c), F.lit(0.0)))
    return out


def lexicon_scores_join(messages: DataFrame, lex: DataFrame, bias=DEFAULT_BIAS,
                        text: str = "text", decimals: int | None = 6,
                        key: str = "message_id") -> DataFrame:
    """M4 for lexicons too large to inline: tokens are exploded and equi-joined
    with the (term, class, weight) table -- AQE broadcasts it when its
    measured size allows, else shuffles both sides and splits skewed terms --
    then summed per message (partial aggregation) and joined back by key."""
    out = _join_sums(messages, lex, F.lower(F.col(text)), key, "_s_")
    cols = []
    for c in CLASSES:
        p = sigmoid(F.lit(float(bias.get(c, 0.0))) + F.col("_s_" + c))
        cols.append((F.round(p, decimals) if decimals is not None else p).alias(c))
    return out.select(*[F.col(c) for c in messages.columns if c not in CLASSES], *cols)


def lexicon_scores(messages: DataFrame, lexicon=DEFAULT_LEXICON, bias=DEFAULT_BIAS,
                   text: str = "text", decimals: int | None = 6) -> DataFrame:
    """M4: lower-cased word tokens matched against the lexicon. Small lexicons
    are inlined (narrow, no shuffle); larger ones go through a join."""
    if len(lexicon) > MAX_INLINE_TERMS:
        lex = lexicon_table(messages.sparkSession, lexicon)
        return lexicon_scores_join(messages, lex, bias, text, decimals)
    x = with_lexicon_logits(messages, F.lower(F.col(text)), "_lg_", lexicon, bias)
    cols = []
    for c in CLASSES:
        p = sigmoid(F.col("_lg_" + c))
        cols.append((F.round(p, decimals) if decimals is not None else p).alias(c))
    return x.select(*[F.col(c) for c in messages.columns if c not in CLASSES], *cols)


def case_max_scores(messages: DataFrame, lexicon=DEFAULT_LEXICON, bias=DEFAULT_BIAS,
                    text: str = "text", logits: bool = False,
                    decimals: int | None = 6) -> DataFrame:
    """M2 + M3: max logit over (text, upper(text), lower(text)); sigmoid unless
    ``logits`` is set. The lexicon is matched case-sensitively here, as the
    model sees each variant as it is."""
    t = F.col(text)
    x = messages
    variants = (("o", t), ("u", F.upper(t)), ("l", F.lower(t)))
    if len(lexicon) > MAX_INLINE_TERMS:  # join path, one join per case variant
        lex = lexicon_table(messages.sparkSession, lexicon)
        for tag, v in variants:
            x = _join_sums(x, lex, v, "message_id", f"_s{tag}_")
            for c in CLASSES:
                x = x.withColumn(f"_lg{tag}_{c}",
                                 F.lit(float(bias.get(c, 0.0))) + F.col(f"_s{tag}_{c}"))
    else:
        for tag, v in variants:
            x = with_lexicon_logits(x, v, f"_lg{tag}_", lexicon, bias, tag)
    cols = []
    for c in CLASSES:
        z = F.greatest(*[F.col(f"_lg{tag}_{c}") for tag in "oul"])
        z = z if logits else sigmoid(z)
        cols.append((F.round(z, decimals) if decimals is not None else z).alias(c))
    return x.select(*[F.col(c) for c in messages.columns if c not in CLASSES], *cols)


def rate_report(scored: DataFrame) -> DataFrame:
    """A7/M5: "I rate the message:" and one tab-indented line per class; a
    message whose scores failed gets the fixed answer."""
    lines = rate_lines(CLASSES_HUMAN, CLASSES, "\n\t")
    failed = score_status(scored) == "quarantine"
    return scored.select("message_id", F.when(failed, F.lit(FAILED_RATE)).otherwise(
        F.concat(F.lit("I rate the message:\n\t"), lines)).alias("report"))


def token_list(messages: DataFrame, text: str = "text") -> DataFrame:
    """M6: the tokens of a text joined by ", " (word-or-punctuation tokens)."""
    toks = tokens(F.col(text), WORD_PATTERN)
    return messages.select("message_id", F.array_join(toks, ", ").alias("tokens"),
                           F.size(toks).cast("bigint").alias("n_tokens"))


def scores_to_json(scored: DataFrame) -> Column:
    """Scores as the scorer service's JSON object {human class name: p}."""
    m = F.map_from_arrays(F.array(*[F.lit(h) for h in CLASSES_HUMAN]),
                          F.array(*[F.col(c) for c in CLASSES]))
    return F.to_json(m)


def scores_from_json(df: DataFrame, json_col: str = "scores_json") -> DataFrame:
    """Parse a scorer reply into the seven score columns, keyed by class name
    (never by position: JSON key order is not the class order). A reply that
    does not parse, or lacks a class, gives NULL scores (quarantine, F4)."""
    m = F.from_json(F.col(json_col), "map<string,double>")
    out = df.withColumn("_scores", m)
    for h, c in zip(CLASSES_HUMAN, CLASSES):
        out = out.withColumn(c, F.col("_scores").getItem(h))
    return out.drop("_scores")
