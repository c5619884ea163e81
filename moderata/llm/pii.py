"""Personal data by bootstrapped contextual extraction (operator 6), DataFrame functions only.

Base detectors find e-mail addresses, IP addresses, card numbers and phone
numbers. Every valid base match is a seed of the method, whatever its length
and digits; its lexical patterns are the word before it, the word after it and
the 2 to 24 characters before its first digit. Candidates for unseen
identifiers are runs of blank-separated tokens that hold a digit each (one
token or several, without punctuation around), with the same patterns. The graph of patterns
and instances is scored in rounds: a pattern's confidence is the smoothed mean
score of its instances, weighted by how often they occur in it; an instance's
score is the mean confidence of its patterns; seeds keep the score 1, and
candidates that touch a base match that failed its check (a number range, the
Luhn sum) keep the score 0. Other instances are found by two or more confident
patterns and a score of ``ACCEPT``; their occurrences become spans of kind
``id``. An identifier without a digit is no candidate.

Scale. Texts are read once; the result is one narrow row per document with its
spans and candidates. The graph is kept as counted (pattern, instance) edges, so
a frequent word is one row per instance, and each round is two joins and two
aggregates with partial sums; no pattern's or instance's rows are gathered. All
patterns of the regular expressions are linear: runs are possessive and start
only where a run starts.

Defined cases: null texts count as empty; rows that repeat both id and text are
one occurrence set and get the same spans; a match that fails its check
(number range, Luhn, digit count) is dropped and not retried; a candidate that
touches a valid base match is left to it; the neighbouring words of a match are looked for up to the
next match of its kind (of a candidate: the next candidate); the empty list of
spans is the empty string; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .lines import let

KINDS = ["email", "ip", "card", "phone", "id"]
ROUNDS = 3
SMOOTHING = 2.0
CONFIDENT = 0.5
ACCEPT = 0.6

_LOCAL = "A-Za-z0-9._%+-"
# leftmost matches start where a run starts, or where the last match ended
_EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_W = r"\x20\x09-\x0D"
_HELD = rf"[^{_W}0-9]*+[0-9][^{_W}]*+"  # the rest of a token that holds a digit
_RUN = rf"(?<![^{_W}]){_HELD}(?:[\x20\x09]++{_HELD})*+"
_N = r"\p{L}\p{N}"


def _found(text: Column, pattern: str, extra=None) -> Column:
    """Structs (start, stop, m) of all matches in order; ``extra`` adds fields from the parts around."""
    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                        F.split(text, pattern, -1).alias("p")), lambda x: _placed(x, extra))


def _placed(x: Column, extra) -> Column:
    empty = F.array().cast("array<int>")
    starts = F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")),
                         lambda a, i: F.struct(
                             (a["at"] + F.char_length(F.get(x["p"], i)) + F.char_length(F.get(x["m"], i))).alias("at"),
                             F.array_append(a["out"], a["at"] + F.char_length(F.get(x["p"], i))).alias("out")),
                         lambda a: a["out"])
    more = extra or (lambda x, i: [])
    return F.when(F.size(x["m"]) > 0, let(starts, lambda s: F.transform(x["m"], lambda m, i: F.struct(
        F.get(s, i).alias("start"), (F.get(s, i) + F.char_length(m)).alias("stop"), m.alias("m"), *more(x, i)))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def add(total, d, i):
        doubled = d * (1 + i % 2)
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)
    told = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(told, F.lit(0), lambda a, x: add(a, x["d"], x["i"])) % 10 == 0


def _small_parts(m: Column) -> Column:
    bare = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda x: F.when(F.length(x) <= 3, x.cast("int") <= 255).otherwise(F.lit(False)))


_MATCH = "array<struct<start:int,kind:int,stop:int,ok:boolean,inst:bigint,patterns:array<string>>>"


def _matches(text: Column) -> Column:
    """Base matches (start, kind number, stop, ok, instance, patterns); ``ok`` is false where the Luhn sum or a range fails.

    Matches with too few or too many digits are left out: they are just numbers.
    """
    def of(kind: int, sign: str, pattern: str, valid=None) -> Column:
        def told(x, i):
            m = F.get(x["m"], i)
            return [let(valid(m) if valid else F.lit(True), lambda ok: F.struct(
                ok.alias("ok"), F.when(ok, F.xxhash64(m)).alias("inst"), F.when(ok, _patterns(x, i, m)).alias("patterns"))).alias("e")]
        spans = F.transform(_found(text, pattern, told), lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), s["e"]["ok"].alias("ok"),
            s["e"]["inst"].alias("inst"), s["e"]["patterns"].alias("patterns")))
        spans = F.filter(spans, lambda s: s["ok"].isNotNull())
        return F.when(text.rlike(sign), F.coalesce(spans, F.array().cast(_MATCH))).otherwise(F.array().cast(_MATCH))
    size = lambda m: F.length(_digits(m))
    return F.sort_array(F.concat(
        of(0, "@", _EMAIL), of(1, "[0-9]", _IP, _small_parts),
        of(2, "[0-9]", _CARD, lambda m: F.when(size(m).between(14, 19), _luhn(m))),
        of(3, r"\+", _PHONE, lambda m: F.when(size(m).between(10, 15), F.lit(True)))))


def _patterns(x: Column, i: Column, m: Column) -> Column:
    """Lexical patterns of a match: the words beside it and what stands before its first digit."""
    left = F.lower(F.regexp_extract(F.get(x["p"], i), rf"(?<![{_N}])([{_N}]++)[^{_N}]*+$", 1))
    right = F.lower(F.regexp_extract(F.get(x["p"], i + 1), rf"^[^{_N}]*+([{_N}]++)", 1))
    prefix = F.regexp_extract(m, "^([^0-9]{2,24}+)[0-9]", 1)
    return F.array_compact(F.array(
        F.when(left != "", F.concat(F.lit("L "), left)), F.when(right != "", F.concat(F.lit("R "), right)),
        F.when(prefix != "", F.concat(F.lit("P "), prefix))))


def _candidates(text: Column) -> Column:
    """Runs of tokens with digits (start, stop, inst, patterns), the punctuation around them left out."""
    def told(x, i):
        m = F.get(x["m"], i)
        lead = F.char_length(F.regexp_extract(m, rf"^[^{_N}]*+", 0))
        tail = F.char_length(F.regexp_extract(m, rf"(?<=[{_N}])[^{_N}]*+$", 0))
        core = let(lead, lambda n: F.substring(m, n + 1, F.char_length(m) - n - tail))
        return [lead.alias("lead"), tail.alias("tail"), let(core, lambda c: F.struct(
            F.xxhash64(c).alias("inst"), _patterns(x, i, c).alias("patterns"))).alias("e")]
    return F.transform(_found(text, _RUN, told), lambda s: F.struct(
        (s["start"] + s["lead"]).alias("start"), (s["stop"] - s["tail"]).alias("stop"),
        s["e"]["inst"].alias("inst"), s["e"]["patterns"].alias("patterns")))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k (the row's key), base matches and candidates of each whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    tokens = F.when(F.col("t").rlike("[0-9]"), _candidates(F.col("t")))
    return rows.select("doc_id", F.xxhash64("doc_id", "t").alias("k"), _matches(F.col("t")).alias("matches"),
                       tokens.alias("tokens"))


def discovered(told: DataFrame) -> DataFrame:
    """k, start, stop of the candidates that the pattern graph accepts."""
    def touches(x: Column, ok: bool) -> Column:
        return F.exists("matches", lambda b: (b["start"] < x["stop"]) & (b["stop"] > x["start"]) & (b["ok"] == F.lit(ok)))

    def instance(x: Column, seed: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["inst"].alias("inst"),
                        x["patterns"].alias("patterns"), seed.alias("seed"))
    seeds = F.transform(F.filter("matches", lambda x: x["ok"]), lambda x: instance(x, F.lit(1)))
    free = F.transform(F.filter("tokens", lambda x: ~touches(x, True)), lambda x: instance(
        x, F.when(touches(x, False), -1).otherwise(0)))
    both = F.when(F.col("tokens").isNull(), seeds).otherwise(F.concat(seeds, free))
    token = written(told.where("tokens is not null or size(matches) > 0").dropDuplicates(["k"])
                    .select("k", F.explode(both).alias("x")).select("k", "x.*"), "tokens")
    every = written(token.select("inst", "seed", F.explode(F.array_distinct("patterns")).alias("p"))
                    .groupBy("inst", F.xxhash64("p").alias("p"))
                    .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seed") == 1).alias("seed")), "edges")
    induced = every.where("seed").select("p").distinct()
    edges = written(every.join(induced, "p", "left_semi").select("inst", "p", "n"), "edges")
    state = written(token.groupBy("inst").agg(F.when(F.max("seed") == 1, 1).otherwise(F.min("seed")).alias("seed"))
                    .withColumn("s", F.greatest("seed", F.lit(0)).cast("double")).withColumn("sure", F.lit(0).cast("long")), "state")
    for _ in range(ROUNDS):
        patterns = (edges.join(state.select("inst", "s"), "inst").groupBy("p")
                    .agg((F.sum(F.round(F.col("s") * 2 ** 20).cast("long") * F.col("n")) / 2.0 ** 20
                          / (F.sum("n") + SMOOTHING)).alias("conf")))
        scored = (edges.join(patterns, "p").groupBy("inst")
                  .agg((F.sum(F.round(F.col("conf") * 2 ** 20).cast("long")) / F.count(F.lit(1)) / 2.0 ** 20).alias("m"),
                       F.count_if(F.col("conf") >= CONFIDENT).alias("c")))
        state = written(state.select("inst", "seed").join(scored, "inst", "left").select(
            "inst", "seed", F.when(F.col("seed") != 0, F.greatest("seed", F.lit(0)).cast("double"))
            .otherwise(F.coalesce("m", F.lit(0.0))).alias("s"),
            F.coalesce("c", F.lit(0).cast("long")).alias("sure")), "state")
    good = state.where((F.col("seed") == 0) & (F.col("s") >= ACCEPT) & (F.col("sure") >= 2)).select("inst")
    return token.where("seed = 0").join(good, "inst", "left_semi").select("k", "start", "stop")


def _names(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def found(docs: DataFrame) -> DataFrame:
    """One row per document row: counts of base spans, their digest, all spans and their number."""
    told = written(described(docs), "spans").withColumn("base", F.transform(
        F.filter("matches", lambda s: s["ok"]), lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    more = (discovered(told).groupBy("k").agg(F.collect_list(F.struct(  # spans of one document
        "start", F.lit(4).alias("kind"), "stop")).alias("more")))
    every = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))))
    return (told.drop("tokens", "matches").join(more, "k", "left").select(
        "doc_id", *[_count(i).alias(f"n_{KINDS[i]}") for i in range(4)],
        F.sha2(_names(F.col("base")), 256).alias("base_sha256"), _names(every).alias("spans"), F.size(every).cast("long").alias("n_spans")))


def brute_base(text: str | None) -> list[tuple[int, int, int]]:
    """Plain version of the base detectors for tests: sorted (start, kind, end)."""
    import re

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, rx, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and (kind == 3 or luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def brute_spans(rows: list[tuple[int, str | None]]) -> dict[int, str]:
    """Plain version of the whole method for tests: id -> spans; ids must differ."""
    import regex as re
    from decimal import ROUND_HALF_UP, Decimal

    def fixed(x):
        return int(Decimal(x * 2 ** 20).quantize(Decimal(1), ROUND_HALF_UP))

    def patterns(found, t, k, m):
        low = found[k - 1].end() if k else 0
        high = found[k + 1].start() if k + 1 < len(found) else len(t)
        left = re.findall(r"[\p{L}\p{N}]+", t[low:found[k].start()])[-1:]
        right = re.findall(r"[\p{L}\p{N}]+", t[found[k].end():high])[:1]
        prefix = re.findall(r"^[^0-9]{2,24}(?=[0-9])", m)
        return {sign + x for sign, xs in (("L ", [x.lower() for x in left]), ("R ", [x.lower() for x in right]), ("P ", prefix)) for x in xs}
    rules = [(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), (1, r"[0-9]+(?:\.[0-9]+){3}"),
             (2, r"[0-9](?:[\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")]
    token = r"[^\s0-9]*[0-9]\S*"
    seen, seed = [], {}  # occurrences: (id, start, stop, text, patterns, seed)
    for i, t in rows:
        t = t or ""
        valid, failed = brute_base(t), []
        for kind, rule in rules:
            found = list(re.finditer(rule, t))
            for k, m in enumerate(found):
                n = len(re.sub("[^0-9]", "", m.group()))
                if (m.start(), kind, m.end()) in valid:
                    seen.append((i, m.start(), m.end(), m.group(), patterns(found, t, k, m.group()), 1))
                elif kind == 1 or kind == 2 and 14 <= n <= 19:
                    failed.append((m.start(), m.end()))
        found = list(re.finditer(rf"(?<!\S){token}(?:[ \t]+{token})*", t))
        for k, m in enumerate(found):
            core = re.search(r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", m.group(), re.S)
            a, b = m.start() + core.start(), m.start() + core.end()
            if not any(x < b and a < y for x, _, y in valid):
                sign = -1 if any(x < b and a < y for x, y in failed) else 0
                seen.append((i, a, b, core.group(), patterns(found, t, k, core.group()), sign))
    edges = {}
    for _, _, _, x, ps, sign in seen:
        seed[x] = 1 if 1 in (sign, seed.get(x)) else min(sign, seed.get(x, 0))
        for p in ps:
            edges[p, x] = edges.get((p, x), 0) + 1
    induced = {p for _, _, _, _, ps, sign in seen if sign == 1 for p in ps}
    edges = {e: n for e, n in edges.items() if e[0] in induced}
    score, sure = {x: float(max(v, 0)) for x, v in seed.items()}, {}
    for _ in range(ROUNDS):
        total, count, mean, sure = {}, {}, {}, {}
        for (p, x), n in edges.items():
            total[p] = total.get(p, 0) + fixed(score[x]) * n
            count[p] = count.get(p, 0) + n
        for p, x in edges:
            conf = total[p] / 2.0 ** 20 / (count[p] + SMOOTHING)
            mean.setdefault(x, []).append(fixed(conf))
            sure[x] = sure.get(x, 0) + (conf >= CONFIDENT)
        score = {x: float(max(v, 0)) if v else sum(mean[x]) / len(mean[x]) / 2.0 ** 20 if x in mean else 0.0 for x, v in seed.items()}
    good = {x for x, v in seed.items() if v == 0 and score[x] >= ACCEPT and sure.get(x, 0) >= 2}
    return {i: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(brute_base(t) + [
        (a, 4, b) for j, a, b, x, _, sign in seen if j == i and sign == 0 and x in good])) for i, t in rows}
