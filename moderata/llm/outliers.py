"""Quality rules by robust multivariate outliers (operator 4), DataFrame functions only.

Counts of each text are turned into a vector of six logarithms; within each
(language, source) group a minimum-covariance-determinant estimate gives the
centre and scatter of the most concentrated three quarters, and documents are
rejected whose squared Mahalanobis distance exceeds ``LIMIT``.

The estimate is the deterministic variant of the fast algorithm: start from
medians and interquartile ranges, then ``STEPS`` concentration steps (keep the
three quarters nearest to the current centre, re-estimate), each of which
lowers the determinant. ``TOLERANCE`` squared is added to the variances, so that
statistics which are equal in most documents do not make the rest infinitely
far. Distances are scaled by their median, as the subset's scatter is too
small for the whole.

Scale. The texts are read once; everything after works on narrow rows. Each
step is two aggregates with map-side partial sums: a histogram of distances
per group, whose running sum gives the cut, and sums of products. Vectors are
whole numbers (1/256), so sums are exact and no order of addition shows. A
group of any size is never gathered or sorted.

Defined cases: null or empty texts have no words and fail the base rules;
null languages and sources are groups of their own; documents that fail the
base rules take no part in the estimate; small groups are held by the
tolerance (a group of one keeps its document); repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .lines import let

UNIT = 256
FEATURES = 6
TOLERANCE = [0.5, 0.06, 0.7, 0.6, 0.7, 0.6]
SHARE = 0.75
STEPS = 3
LIMIT = 27.86    # 0.9999 quantile of chi-square with 6 degrees of freedom
MEDIAN = 5.348   # its median
BIN = 64         # distance bins per unit of ln(1 + d2)
_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\u000b\f\r"


def _repeated(words: Column) -> Column:
    """Words that lie in 8-word windows found twice or more in the text."""
    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - 8),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(8)]))

    def covered(keys):
        pairs = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        twice = let(pairs, lambda s: F.transform(s, lambda x, j: F.when(
            F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
            | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)), x["i"])))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("last"))
        return F.aggregate(F.sort_array(F.array_compact(twice)), start, lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(8), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return F.when(F.size(words) < 9, F.lit(0).cast("long")).otherwise(let(
        F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda keys: F.when(
            F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys)))))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, g (the group's key) and the counts of each whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = docs.select(F.col(id_col).alias("doc_id"), F.to_json(F.struct("lang", "source")).alias("g"), text.alias("t"))
    words = F.regexp_extract_all("t", F.lit(_WORD), F.lit(0))
    told = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))

    def gone(chars: str) -> Column:
        return F.char_length(F.translate("t", chars, "")).cast("long")
    size = F.char_length("t").cast("long")
    # the dot stands for any character but line ends, so a blank line has no word
    lines = let(F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(_SPACES)) != ""),
                lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return (row.select("doc_id", "g", told.alias("w"), gone(_SPACES).alias("word_chars"),
                       (size - gone("#*$%&|<>")).alias("n_symbols"), lines.alias("n_dup_lines"),
                       (size - gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"))
            .select("doc_id", "g", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_upper")
            .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))


def _vector() -> Column:
    """The transformed statistics in units of 1/256."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def share(name: str) -> Column:
        return F.log1p(F.lit(100.0) * F.col(name) / n)
    parts = [F.log1p("n_words"), F.log1p(F.col("word_chars") / n), share("n_symbols"), F.log1p("n_dup_lines"),
             share("n_repeat_words"), F.log1p(F.lit(100.0) * F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)))]
    return F.array(*[F.floor(p * UNIT + 0.5).cast("long") for p in parts])


def _quantile_rows(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the smallest value whose running count reaches each share of the rows (exact)."""
    hist = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = hist.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(whole))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * s), F.col(value))).alias(a)
                                       for a, s in shares.items()])


def _start(rows: DataFrame) -> DataFrame:
    """Per group the medians and the inverse spreads (on the diagonal of ``m``)."""
    flat = rows.select("g", F.posexplode("x").alias("f", "v"))
    told = _quantile_rows(flat, ["g", "f"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    by = told.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("f", "q1", "q2", "q3"))).alias("q"))  # six entries
    mean = F.transform("q", lambda q: q["q2"] / F.lit(float(UNIT)))
    cells = []
    for i in range(FEATURES):
        for j in range(i + 1):
            spread = F.greatest((F.get("q", F.lit(i))["q3"] - F.get("q", F.lit(i))["q1"]) / F.lit(UNIT * 1.349), F.lit(TOLERANCE[i]))
            cells.append(1.0 / spread if i == j else F.lit(0.0))
    return by.select("g", mean.alias("mean"), F.array(*cells).alias("m"))


def _distance() -> Column:
    """Squared length of m (x - mean), m lower triangular by rows."""
    diff = [F.get("x", F.lit(i)) / F.lit(float(UNIT)) - F.get("mean", F.lit(i)) for i in range(FEATURES)]
    out, at = F.lit(0.0), 0
    for i in range(FEATURES):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.get("m", F.lit(at)) * diff[j]
            at += 1
        out = out + z * z
    return out


def _binned(rows: DataFrame, model: DataFrame) -> DataFrame:
    return (rows.join(model, "g").withColumn("d2", _distance())
            .withColumn("bin", F.floor(F.log1p("d2") * BIN).cast("int")))


def _estimate(rows: DataFrame) -> DataFrame:
    """mean and m (inverse of the Cholesky factor of the scatter) of each group's rows."""
    x = [F.get("x", F.lit(i)) for i in range(FEATURES)]
    pairs = [(i, j) for i in range(FEATURES) for j in range(i + 1)]
    sums = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(FEATURES)],
                                 *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs])
    u = float(UNIT)
    out = sums.withColumns({f"u{i}": F.col(f"s{i}") / F.col("n") / u for i in range(FEATURES)})
    for i, j in pairs:  # Cholesky factor, then its inverse, entry by entry
        cov = F.col(f"s{i}_{j}") / F.col("n") / (u * u) - F.col(f"u{i}") * F.col(f"u{j}")
        if i == j:
            cov = F.greatest(cov, F.lit(0.0)) + TOLERANCE[i] ** 2
        for k in range(j):
            cov = cov - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        out = out.withColumn(f"l{i}_{j}", F.sqrt(cov) if i == j else cov / F.col(f"l{j}_{j}"))
    for i, j in pairs:
        if i == j:
            value = 1.0 / F.col(f"l{i}_{i}")
        else:
            value = F.lit(0.0)
            for k in range(j, i):
                value = value - F.col(f"l{i}_{k}") * F.col(f"m{k}_{j}")
            value = value / F.col(f"l{i}_{i}")
        out = out.withColumn(f"m{i}_{j}", value)
    return out.select("g", F.array(*[F.col(f"u{i}") for i in range(FEATURES)]).alias("mean"),
                      F.array(*[F.col(f"m{i}_{j}") for i, j in pairs]).alias("m"))


def judged(docs: DataFrame) -> DataFrame:
    """One row per document row: the counts, base_failed, distance and kept."""
    told = written(counts(docs).withColumn("x", _vector()), "counts")
    rows = told.where(~F.col("base_failed")).select("g", "x")
    model = written(_start(rows), "model")
    for _ in range(STEPS):
        cut = written(_quantile_rows(_binned(rows, model), ["g"], "bin", {"cut": SHARE}), "cut")
        inside = _binned(rows, model).join(cut, "g").where("bin <= cut")
        model = written(_estimate(inside.select("g", "x")), "model")
    middle = _quantile_rows(_binned(rows, model), ["g"], "bin", {"mid": 0.5})
    scale = written(model.join(middle, "g").withColumn(
        "scale", F.greatest(F.lit(1.0), F.expm1((F.col("mid") + 0.5) / BIN) / MEDIAN)).drop("mid"), "model")
    return (told.join(scale, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), F.round(_distance() / F.col("scale"), 6)))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.coalesce(F.col("distance") <= LIMIT, F.lit(True))).alias("kept"), "distance"))


def brute_force(rows: list[tuple]) -> dict:
    """Plain numpy version for tests: (id, text, lang, source) -> (counts..., base_failed, kept, distance)."""
    import math
    import re
    from collections import Counter, defaultdict

    import numpy as np
    out, groups = {}, defaultdict(list)
    for i, text, lang, source in rows:
        t = text or ""
        w = re.findall(_WORD, t)
        grams = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        seen = Counter(grams)
        hit = {p for k, gram in enumerate(grams) if seen[gram] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if re.search(_WORD, x)]
        c = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)]
        upper = len(re.findall("[A-Z]", t))
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        n = max(c[0], 1)
        v = [math.log1p(c[0]), math.log1p(c[1] / n), math.log1p(100 * c[2] / n), math.log1p(c[3]),
             math.log1p(100 * c[4] / n), math.log1p(100 * upper / max(c[1], 1))]
        out[i] = [*c, failed, not failed, None]
        if not failed:
            groups[lang, source].append((i, [math.floor(z * UNIT + 0.5) for z in v]))
    for members in groups.values():
        x = np.array([v for _, v in members], float) / UNIT
        n = len(x)
        rank = {s: math.ceil(n * s) - 1 for s in (0.25, 0.5, 0.75)}
        q = np.sort(x, 0)
        mean, spread = q[rank[0.5]], np.maximum((q[rank[0.75]] - q[rank[0.25]]) / 1.349, TOLERANCE)
        m = np.diag(1 / spread)

        def bins():
            d2 = (((x - mean) @ m.T) ** 2).sum(1)
            return d2, np.floor(np.log1p(d2) * BIN)
        for _ in range(STEPS):
            _, b = bins()
            inside = x[b <= np.sort(b)[rank[0.75]]]
            mean = inside.mean(0)
            cov = inside.T @ inside / len(inside) - np.outer(mean, mean)
            cov[np.diag_indices(FEATURES)] = np.maximum(cov.diagonal(), 0) + np.array(TOLERANCE) ** 2
            m = np.linalg.inv(np.linalg.cholesky(cov))
        d2, b = bins()
        d2 = d2 / max(1.0, math.expm1((np.sort(b)[rank[0.5]] + 0.5) / BIN) / MEDIAN)
        for (i, _), d in zip(members, d2):
            out[i][6], out[i][7] = bool(d <= LIMIT), float(d)
    return out


def oracle_sql() -> str:
    """``judged`` in DuckDB SQL: plain sorts for the quantiles, windows of words as rows."""
    f, pairs = range(FEATURES), [(i, j) for i in range(FEATURES) for j in range(i + 1)]
    w = r"[^\x20\x09-\x0D]+"

    def share(c: str) -> str:
        return f"ln(1 + 100.0::DOUBLE * {c} / greatest(n_words, 1))"
    vector = ["ln(1 + n_words)", "ln(1 + word_chars::DOUBLE / greatest(n_words, 1))", share("n_symbols"), "ln(1 + n_dup_lines)",
              share("n_repeat_words"), "ln(1 + 100.0::DOUBLE * n_upper / greatest(word_chars, 1))"]
    ctes = [f"""d AS (SELECT doc_id, (lang, source) AS g, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '{w}') AS ws,
  row_number() OVER () AS row FROM documents)""",
            """win AS (SELECT row, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT row, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) > 7))""",
            """hit AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS p FROM
  (SELECT *, count(*) OVER (PARTITION BY row, k) AS c FROM win) WHERE c > 1) GROUP BY row)""",
            f"""b AS (SELECT d.row, doc_id, g, len(ws) AS n_words, length(t) - length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS blanks,
  length(t) - blanks AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{w}')) AS ls, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  COALESCE(hit.n, 0) AS n_repeat_words, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
  len(ws) < 20 OR 100 * COALESCE(hit.n, 0) > 30 * len(ws) AS base_failed FROM d LEFT JOIN hit ON hit.row = d.row)""",
            "r AS (SELECT row, g, " + ", ".join(f"floor({v} * {UNIT} + 0.5)::BIGINT AS x{i}" for i, v in enumerate(vector))
            + " FROM b WHERE NOT base_failed)"]

    def at(c: str, q: float) -> str:
        return f"list_sort(list({c}))[ceil(count(*) * {q}::DOUBLE)::BIGINT]"
    cells = [f"{at(f'x{i}', 0.5)} / {float(UNIT)}::DOUBLE AS u{i}" for i in f]
    cells += [f"1.0::DOUBLE / greatest(({at(f'x{i}', 0.75)} - {at(f'x{i}', 0.25)}) / {UNIT * 1.349}::DOUBLE, {TOLERANCE[i]}::DOUBLE) AS m{i}_{i}"
              if i == j else f"0.0::DOUBLE AS m{i}_{j}" for i, j in pairs]
    ctes.append(f"model0 AS (SELECT g, {', '.join(cells)} FROM r GROUP BY g)")
    z = [" + ".join(f"m{i}_{j} * (x{j} / {float(UNIT)}::DOUBLE - u{j})" for j in range(i + 1)) for i in f]
    d2 = " + ".join(f"pow({x}, 2)" for x in z)
    for step in range(STEPS + 1):
        ctes.append(f"far{step} AS (SELECT r.*, {d2} AS d2, floor(ln(1 + d2) * {BIN}) AS bin FROM r JOIN model{step} USING (g))")
        q, name = (SHARE, "cut") if step < STEPS else (0.5, "mid")
        ctes.append(f"{name}{step} AS (SELECT g, {at('bin', q)} AS {name} FROM far{step} GROUP BY g)")
        if step == STEPS:
            break
        sums = [f"sum(x{i}) / count(*) / {float(UNIT)}::DOUBLE AS u{i}" for i in f]
        sums += [f"sum(x{i} * x{j}) / count(*) / {float(UNIT) ** 2}::DOUBLE - u{i} * u{j} AS c{i}_{j}" for i, j in pairs]
        ctes.append(f"est{step} AS (SELECT g, {', '.join(sums)} FROM far{step} JOIN cut{step} USING (g) WHERE bin <= cut GROUP BY g)")
        chol = []
        for i, j in pairs:
            less = "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            chol.append(f"sqrt(greatest(c{i}_{i}, 0) + {TOLERANCE[i] ** 2}::DOUBLE{less}) AS l{i}_{i}" if i == j
                        else f"(c{i}_{j}{less}) / l{j}_{j} AS l{i}_{j}")
        inv = [f"1.0::DOUBLE / l{i}_{i} AS m{i}_{i}" if i == j else
               f"(0.0{''.join(f' - l{i}_{k} * m{k}_{j}' for k in range(j, i))}) / l{i}_{i} AS m{i}_{j}" for i, j in pairs]
        ctes.append(f"model{step + 1} AS (SELECT *, {', '.join(chol)}, {', '.join(inv)} FROM est{step})")
    ctes.append(f"e AS (SELECT row, round(d2 / greatest(1.0::DOUBLE, (exp((mid + 0.5) / {BIN}) - 1) / {MEDIAN}::DOUBLE), 6) AS distance "
                f"FROM far{STEPS} JOIN mid{STEPS} USING (g))")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance,
  NOT base_failed AND COALESCE(distance <= {LIMIT}, true) AS kept FROM b LEFT JOIN e ON e.row = b.row"""
