"""Training-data preparation, losses and evaluation metrics.

Label preparation is per row (projections, ``stack`` to long form where a
table per label is wanted). Losses and metrics are one global aggregate over
wide rows (one row per example): a single pass with a partial aggregate per
task, no shuffle by example or class. The exact hold-out uses two bounded
histograms instead of a global window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.classes import CLASSES, IDENTITY_COLUMNS, THRESHOLD
from ..functions.columns import hash_int


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str,
            value: str) -> DataFrame:
    """Wide -> long: one row per (ids, column)."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return df.select(*ids, F.expr(f"stack({len(cols)}, {pairs}) AS (`{name}`, `{value}`)"))


def labels_binary(train: DataFrame, threshold: float = THRESHOLD,
                  id_col: str = "id") -> DataFrame:
    """Soft toxicity labels as DOUBLE and binarised (> threshold) as BIGINT."""
    out = [F.col(id_col)]
    for c in CLASSES:
        out.append(F.col(c).cast("double").alias(c))
        out.append((F.col(c) > F.lit(threshold)).cast("bigint").alias(f"{c}_bin"))
    return train.select(*out)


def identity_mask(train: DataFrame, cols: Sequence[str] = IDENTITY_COLUMNS,
                  id_col: str = "id") -> DataFrame:
    """Identity labels in long form: value with NULL -> 0 and a known mask."""
    long = unpivot(train, [id_col], cols, "identity", "raw")
    return long.select(id_col, "identity",
                       F.coalesce(F.col("raw"), F.lit(0.0)).alias("value"),
                       F.col("raw").isNotNull().alias("known"))


def split_hash(df: DataFrame, id_col: str = "id", holdout_buckets: int = 1,
               buckets: int = 10, salt: str = "split") -> DataFrame:
    """T4: stable random hold-out: hash bucket < holdout_buckets of ``buckets``.

    Size is about n * holdout/buckets; the split of a row never changes under
    retry or re-run, and both sides are disjoint.
    """
    b = hash_int(id_col, salt) % F.lit(buckets)
    return df.withColumn("split", F.when(b < holdout_buckets, "holdout").otherwise("train"))


def bce_with_logits(logit: Column, y: Column) -> Column:
    """Numerically stable binary cross entropy on a logit, soft target y."""
    return (F.greatest(logit, F.lit(0.0)) - logit * y
            + F.log1p(F.exp(-F.abs(logit))))


def _rows(structs: list[Column]) -> Column:
    return F.inline(F.array(*structs))


def bce_loss(wide: DataFrame, classes: Sequence[str], logit: str = "logit_{}",
             target: str = "{}", decimals: int = 6) -> DataFrame:
    """Mean soft-target BCE per class plus an ``all`` row (the mean over
    every known entry, as torch's mean). NULL targets are masked out (T10).

    One pass: a single global aggregate (partial per task, one row each), so
    the scored input is never materialised twice or shuffled by key.
    """
    aggs = []
    for c in classes:
        y = F.col(target.format(c))
        l = bce_with_logits(F.col(logit.format(c)), y)
        aggs += [F.sum(F.when(y.isNotNull(), l)).alias(f"s_{c}"), F.count(y).alias(f"n_{c}")]
    one = wide.agg(*aggs)
    s_all = sum((F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) for c in classes), F.lit(0.0))
    n_all = sum((F.col(f"n_{c}") for c in classes), F.lit(0))
    rows = [F.struct(F.lit(c).alias("class"), (F.col(f"s_{c}") / F.col(f"n_{c}")).alias("loss"),
                     F.col(f"n_{c}").alias("n")) for c in classes]
    rows.append(F.struct(F.lit("all").alias("class"), (s_all / n_all).alias("loss"),
                         n_all.alias("n")))
    out = one.select(_rows(rows)).where(F.col("n") > 0)
    return out.withColumn("loss", F.round("loss", decimals))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def eval_metrics(wide: DataFrame, classes: Sequence[str], truth: str = "y_{}",
                 pred: str = "p_{}", decimals: int = 6) -> DataFrame:
    """Per-class tp/fp/fn/tn, precision, recall, F1, accuracy, and a
    ``macro`` row: unweighted means over classes, and subset accuracy (a row
    counts when all its labels are right). Divisions by zero give 0.

    Input is wide (one row per example, 0/1 columns per class); everything
    comes from one global aggregate: no shuffle by example or class.
    """
    return _metric_rows(wide.agg(*_metric_counts(classes, truth, pred)), classes, decimals)


def observed_metrics(wide: DataFrame, classes: Sequence[str], truth: str = "y_{}", pred: str = "p_{}",
                     decimals: int = 6) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """T11 on the way: ``wide`` with its metrics counted while an action passes over it.

    Returns the observed rows and a function that gives the table of ``eval_metrics``
    after the first action on them (training, writing scores), without a job of its own.
    """
    seen = Observation()
    counted = wide.observe(seen, *_metric_counts(classes, truth, pred))

    def metrics() -> DataFrame:
        told = seen.get
        schema = ", ".join(f"{k} {'double' if k == 'subset' else 'long'}" for k in told)
        return _metric_rows(wide.sparkSession.createDataFrame([tuple(told.values())], schema), classes, decimals)
    return counted, metrics


def _metric_counts(classes: Sequence[str], truth: str, pred: str) -> list[Column]:
    aggs = []
    for c in classes:
        t, p = F.col(truth.format(c)) == 1, F.col(pred.format(c)) == 1
        aggs += [F.count_if(t & p).alias(f"tp_{c}"), F.count_if(~t & p).alias(f"fp_{c}"),
                 F.count_if(t & ~p).alias(f"fn_{c}"), F.count_if(~t & ~p).alias(f"tn_{c}")]
    all_ok = None
    for c in classes:
        ok = F.col(truth.format(c)) == F.col(pred.format(c))
        all_ok = ok if all_ok is None else (all_ok & ok)
    return [*aggs, F.avg(all_ok.cast("double")).alias("subset")]


def _metric_rows(one: DataFrame, classes: Sequence[str], decimals: int) -> DataFrame:
    def m(c):
        tp, fp, fn, tn = (F.col(f"{k}_{c}") for k in ("tp", "fp", "fn", "tn"))
        return {"tp": tp, "fp": fp, "fn": fn, "tn": tn,
                "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
                "f1": _ratio(2 * tp, 2 * tp + fp + fn),
                "accuracy": _ratio(tp + tn, tp + fp + fn + tn)}

    per = {c: m(c) for c in classes}
    keys = ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy"]
    rows = [F.struct(F.lit(c).alias("class"), *[per[c][k].alias(k) for k in keys])
            for c in classes]
    macro = {k: sum((per[c][k] for c in classes), F.lit(0)) for k in ("tp", "fp", "fn", "tn")}
    for k in ("precision", "recall", "f1"):
        macro[k] = sum((per[c][k] for c in classes), F.lit(0.0)) / F.lit(float(len(classes)))
    macro["accuracy"] = F.col("subset")
    rows.append(F.struct(F.lit("macro").alias("class"), *[macro[k].alias(k) for k in keys]))
    out = one.select(_rows(rows))
    for c in ("precision", "recall", "f1", "accuracy"):
        out = out.withColumn(c, F.round(c, decimals))
    return out


def pad_mask(ids: Column, length: int, pad_id: int) -> tuple[Column, Column]:
    """Pad an id array to ``length`` (cut longer ones) and its attention mask."""
    cut = F.slice(ids, 1, length)
    n = F.size(cut)
    padded = F.concat(cut, F.array_repeat(F.lit(pad_id), F.lit(length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
    return padded, mask


def round_up(n: Column, multiple: int) -> Column:
    """Length padded to a multiple (pad_to_multiple_of)."""
    return ((n + multiple - 1) / multiple).cast("int") * multiple


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """``df`` with exact row numbers from 0 in the order of the columns ``order`` (which tell rows apart).

    Rows are dealt by range and sorted where they lie; a row's number is its place there
    plus the sizes of the ranges before. Only one count a range reaches the driver: no
    task sees all rows, as a window without a partition would.
    """
    place = F.monotonically_increasing_id()  # task number in the upper bits, place in the lower 33
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place).checkpoint(eager=True)
    sizes = (local.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy("part").collect())
    if not sizes:
        return local.withColumn(name, F.col("_at")).drop("_at")
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    first = df.sparkSession.createDataFrame(starts, "_part long, _first long")  # a row a range
    return (local.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(first), "_part")
            .withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_first"))


def pad_batches(df: DataFrame, ids: str, key: str, batch_size: int, pad_id: int, multiple: int = 8) -> DataFrame:
    """Batches of rows of like length, each padded to its longest row, rounded up to ``multiple``.

    Rows are numbered by (length, ``key``), so batches are full and little is padded. Adds
    batch, pad_to, input_ids and attention_mask; NULL ids are an empty row.
    """
    own = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    rows = row_numbers(df.withColumn(ids, own).withColumn("_n", F.size(own)), ["_n", key])
    rows = rows.withColumn("batch", F.floor(F.col("row") / batch_size).cast("long"))
    longest = rows.groupBy("batch").agg(round_up(F.max("_n"), multiple).alias("pad_to"))
    out = rows.join(longest, "batch")
    more = F.col("pad_to") - F.col("_n")
    return (out.withColumn("input_ids", F.concat(ids, F.array_repeat(F.lit(pad_id), more)))
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), more)))
            .drop("_n", "row"))


def split_exact(df: DataFrame, id_col: str = "id", fraction_den: int = 10,
                salt: str = "split") -> DataFrame:
    """T4 (exact form): a hold-out of exactly n // fraction_den rows, the rows
    with the smallest (hash(id), id), without a single-partition window.

    The 32-bit hash is located in two steps by histograms of its high and low
    16 bits (at most 65,536 rows each reach the driver, whatever n is); the
    rows sharing the exact boundary hash are ranked by id with a top-k. Runs a
    few small jobs; the result is a lazy projection of ``df``.
    """
    h = hash_int(id_col, salt)
    x = df.withColumn("_h", h)
    n = x.count()
    k = n // fraction_den
    if k == 0:
        return df.withColumn("split", F.lit("train"))

    def locate(frame: DataFrame, bucket: Column, need: int) -> tuple[int, int]:
        hist = sorted((r["b"], r["c"]) for r in
                      frame.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect())
        cum = 0
        for b, c in hist:
            if cum + c >= need:
                return b, need - cum
            cum += c
        raise AssertionError("histogram smaller than requested rank")

    hi, need = locate(x, F.shiftright(F.col("_h"), 16), k)
    band = x.where(F.shiftright(F.col("_h"), 16) == hi)
    lo, need = locate(band, F.col("_h").bitwiseAND(0xFFFF), need)
    t_hash = (hi << 16) | lo
    same = x.where(F.col("_h") == t_hash).select(id_col)
    t_id = same.orderBy(F.col(id_col).asc()).limit(need).agg(F.max(id_col)).collect()[0][0]
    hold = (F.col("_h") < F.lit(t_hash)) | ((F.col("_h") == F.lit(t_hash))
                                            & (F.col(id_col) <= F.lit(t_id)))
    return x.withColumn("split", F.when(hold, "holdout").otherwise("train")).drop("_h")
