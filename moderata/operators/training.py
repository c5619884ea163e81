"""Multi-label classifier training and scoring.

Two models. ``fit`` / ``MultiLabelModel``: one Spark ML model per class (below).
``train_epochs`` / ``JointModel``: the reference's joint objective, classes plus
masked identity targets, by full gradients that the tasks add up, saved every epoch;
``batch_scorer`` scores messages from a saved model.

Re-aim of the reference's transformer fine-tuning: a distributed linear model
per class (binary relevance) on hashed TF-IDF features. Soft labels are kept
exactly: each example becomes two weighted rows (label 1 with weight y,
label 0 with weight 1 - y), which makes the logistic loss the soft-target
binary cross entropy of the reference. Gradients are tree-aggregated by
Spark ML; features are computed once and cached for the seven fits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import CLASSES, IDENTITY_COLUMNS
from ..functions.columns import TERM_PATTERN
from . import labels as LB

NUM_FEATURES = 1 << 16  # dense gradient per partition per iteration


def _few_parts(df: DataFrame) -> DataFrame:
    """At most twice as many partitions as cores: each sends a dense gradient in every step, however small its share."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


@dataclass
class MultiLabelModel:
    features: PipelineModel
    models: dict[str, LogisticRegressionModel]
    text_col: str = "comment_text"

    def transform(self, df: DataFrame, text_col: str | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
        """Adds one probability column per class (and ``logit_<class>``)."""
        tc = text_col or self.text_col
        x = df if tc == self.text_col else df.withColumn(self.text_col, F.col(tc))
        feats = self.features.transform(x)
        cols = [F.col(c) for c in (keep or df.columns)]
        out = feats.select(*cols, "features")
        for c, m in self.models.items():
            m = m.copy()
            m.setRawPredictionCol(f"_raw_{c}").setProbabilityCol(f"_prob_{c}") \
             .setPredictionCol(f"_pred_{c}")
            out = m.transform(out)
            out = (out.withColumn(f"logit_{c}", vector_to_array(f"_raw_{c}")[1])
                   .drop(f"_raw_{c}", f"_prob_{c}", f"_pred_{c}"))
        for c in self.models:
            out = out.withColumn(c, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(f"logit_{c}"))))
        return out.drop("features")

    def save(self, folder: str) -> None:
        """Spark ML's own persistence, in any storage that Spark writes."""
        self.features.write().overwrite().save(f"{folder}/features")
        for c, m in self.models.items():
            m.write().overwrite().save(f"{folder}/models/{c}")

    @staticmethod
    def load(folder: str, text_col: str = "comment_text") -> MultiLabelModel:
        models = {c: LogisticRegressionModel.load(f"{folder}/models/{c}") for c in CLASSES}
        return MultiLabelModel(PipelineModel.load(f"{folder}/features"), models, text_col)


def featurizer(text_col: str = "comment_text", num_features: int = NUM_FEATURES):
    tok = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=TERM_PATTERN,
                         gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    return tok, tf, idf


def fit(train: DataFrame, text_col: str = "comment_text", max_iter: int = 25,
        reg: float = 0.01, num_features: int = NUM_FEATURES,
        parallelism: int = 2) -> MultiLabelModel:
    """Fit the feature pipeline once, then one model per class.

    The per-class fits are independent, so they are submitted from a thread
    pool (as Spark ML's one-vs-rest does). Each running fit holds its own
    cached copy of the weighted rows, so only ``parallelism`` run at a time.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml import Pipeline
    tok, tf, idf = featurizer(text_col, num_features)
    fe = Pipeline(stages=[tok, tf, idf]).fit(train)
    feats = _few_parts(fe.transform(train).select("features", *CLASSES)).persist()

    def fit_one(c: str) -> LogisticRegressionModel:
        y = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        both = F.array(F.struct(F.lit(1.0).alias("label"), y.alias("w")), F.struct(F.lit(0.0).alias("label"), (1.0 - y).alias("w")))
        data = feats.select("features", F.explode(F.filter(both, lambda e: e["w"] > 0)).alias("e")).select("features", "e.*")
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w",
                                maxIter=max_iter, regParam=reg, standardization=False)
        return lr.fit(data)

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            fitted = list(pool.map(fit_one, CLASSES))
    finally:
        feats.unpersist()
    return MultiLabelModel(fe, dict(zip(CLASSES, fitted)), text_col)


def evaluate(model: MultiLabelModel, holdout: DataFrame, id_col: str = "id") -> DataFrame:
    """Held-out metrics: prediction = logit > 0, truth = label > 0.5.

    The truth labels are carried as ``y_<class>``: the model's output columns
    carry the class names."""
    truth = [F.col(c).alias(f"y_{c}") for c in CLASSES]
    x = holdout.select(id_col, model.text_col, *truth)
    scored = model.transform(x, keep=(id_col, *[f"y_{c}" for c in CLASSES]))
    wide = scored.select(*[(F.col(f"y_{c}") > 0.5).cast("int").alias(f"y_{c}") for c in CLASSES],
                         *[(F.col(f"logit_{c}") > 0).cast("int").alias(f"p_{c}") for c in CLASSES])
    return LB.eval_metrics(wide, CLASSES)


# ---------------------------------------------------------------------------
# joint training: seven classes and the masked identity targets, one objective
# ---------------------------------------------------------------------------

JOINT_FEATURES = 1 << 13  # with 31 outputs: 2 MB of gradient a task
LEARNING_RATE, MOMENTS = 0.05, (0.9, 0.999)
BLOCK = 256  # examples of a matrix: 17 MB with 8,192 features


@dataclass
class JointModel:
    """One linear layer with an output per class and identity group, and its training state.

    ``weights`` holds a row per output, the bias last; ``moments`` are the
    optimiser's running means, so training goes on where it stopped.
    """
    weights: np.ndarray
    outputs: list[str]
    epoch: int = 0
    moments: tuple[np.ndarray, np.ndarray] | None = None
    history: list[dict] = field(default_factory=list)

    @property
    def num_features(self) -> int:
        return self.weights.shape[1] - 1


def joint_outputs() -> list[str]:
    return [*CLASSES, *IDENTITY_COLUMNS]


def new_model(outputs: Sequence[str] | None = None, num_features: int = JOINT_FEATURES) -> JointModel:
    outputs = list(outputs or joint_outputs())
    shape = (len(outputs), num_features + 1)
    return JointModel(np.zeros(shape), outputs, 0, (np.zeros(shape), np.zeros(shape)))


def hashed_terms(text: str | Column = "text", num_features: int = JOINT_FEATURES) -> Column:
    """Places of a text's distinct terms, as written, among the features (none for a NULL text)."""
    text = F.coalesce(F.col(text), F.lit("")) if isinstance(text, str) else text
    terms = F.regexp_extract_all(text, F.lit(TERM_PATTERN), 0)
    return F.transform(F.array_distinct(terms), lambda w: F.pmod(F.xxhash64(w), F.lit(num_features)).cast("int"))


def _design(rows: Sequence[np.ndarray], num_features: int) -> np.ndarray:
    """Rows of feature places as a matrix: each place counts one over the root of the row's number of places; a bias last."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    width = num_features + 1
    out = np.zeros(len(rows) * width)
    if sizes.sum():
        at = np.repeat(np.arange(len(rows)) * width, sizes) + np.concatenate([r for r in rows if len(r)])
        places, times = np.unique(at, return_counts=True)
        out[places] = times / np.sqrt(sizes)[places // width]
    out[num_features::width] = 1.0
    return out.reshape(len(rows), width)


def _logits(weights: np.ndarray, rows: Sequence[np.ndarray]) -> np.ndarray:
    """Logits of rows of feature places: the places' mean direction, scaled by root of their number, and the bias."""
    return _design(rows, weights.shape[1] - 1) @ weights.T


def loss_and_gradient(weights: np.ndarray, rows: Sequence[np.ndarray], targets: np.ndarray, gradient: bool = True):
    """Sums of the masked soft-target cross entropy per output and of its gradient (None if not asked for).

    A target that is NaN is masked: it adds neither loss nor gradient.
    """
    x = _design(rows, weights.shape[1] - 1)
    z = x @ weights.T
    known = ~np.isnan(targets)
    y = np.where(known, targets, 0.0)
    loss = np.where(known, np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))), 0.0)
    error = np.where(known, 1 / (1 + np.exp(-z)) - y, 0.0) if gradient else None
    return loss.sum(axis=0), known.sum(axis=0), error.T @ x if gradient else None


def _examples(df: DataFrame, model: JointModel, text_col: str) -> DataFrame:
    targets = F.array(*[F.col(c).cast("double") for c in model.outputs])
    return df.select(hashed_terms(text_col, model.num_features).alias("x"), targets.alias("y"))


def _step(examples: DataFrame, weights: np.ndarray, gradient: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Loss, known targets and gradient over all examples, added up on the way (a tree of tasks)."""
    spark = examples.sparkSession
    sent = spark.sparkContext.broadcast(weights)  # outputs x features: bounded by the model
    shape = weights.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, known, total = np.zeros(shape[0]), np.zeros(shape[0]), np.zeros(shape if gradient else 0)
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                part = b.iloc[lo:lo + BLOCK]
                y = np.array([[np.nan if v is None else v for v in row] for row in part["y"]], float).reshape(-1, shape[0])
                a, k, g = loss_and_gradient(sent.value, [np.asarray(r, int) for r in part["x"]], y, gradient)
                loss += a
                known += k
                if gradient:
                    total += g
        yield pd.DataFrame({"s": [np.concatenate([loss, known, total.ravel()]).tobytes()]})
    sums = examples.mapInPandas(partial, "s binary").rdd.map(lambda r: np.frombuffer(r["s"]))
    total = sums.treeReduce(lambda a, b: a + b, depth=3)
    sent.unpersist()
    return total[:shape[0]], total[shape[0]:2 * shape[0]], total[2 * shape[0]:].reshape(shape) if gradient else None


def joint_loss(model: JointModel, df: DataFrame, text_col: str = "comment_text") -> dict[str, float]:
    """Mean loss of the classes, of the identity groups and of all known targets."""
    return _mean_losses(model, _examples(df, model, text_col))


def _mean_losses(model: JointModel, examples: DataFrame) -> dict[str, float]:
    loss, known, _ = _step(examples, model.weights, gradient=False)
    own = np.array([c in CLASSES for c in model.outputs])

    def mean(which):
        return float(loss[which].sum() / max(known[which].sum(), 1))
    return {"classes": mean(own), "identity": mean(~own), "sum": mean(own) + mean(~own)}


def train_epochs(model: JointModel, train: DataFrame, epochs: int, folder: str | None = None,
                 holdout: DataFrame | None = None, steps: int = 4, text_col: str = "comment_text") -> JointModel:
    """Train up to ``epochs`` epochs in all; each ends with an evaluation and, with ``folder``, a saved model.

    The objective is the mean loss of the classes plus the mean loss of the known
    identity targets. An epoch takes ``steps`` gradients over all examples: sums over
    the tasks, so the result does not depend on how the rows are dealt (but for rounding).
    """
    examples = _few_parts(_examples(train, model, text_col)).persist()
    held_out = None if holdout is None else _few_parts(_examples(holdout, model, text_col)).persist()
    own = np.array([c in CLASSES for c in model.outputs])
    try:
        while model.epoch < epochs:
            mean, square = model.moments
            weights = model.weights
            for k in range(steps):
                loss, known, gradient = _step(examples, weights)
                share = np.where(own, max(known[own].sum(), 1), max(known[~own].sum(), 1))
                gradient = gradient / share[:, None]
                t = model.epoch * steps + k + 1
                mean = MOMENTS[0] * mean + (1 - MOMENTS[0]) * gradient
                square = MOMENTS[1] * square + (1 - MOMENTS[1]) * gradient**2
                weights = weights - LEARNING_RATE * (mean / (1 - MOMENTS[0]**t)) / (
                    np.sqrt(square / (1 - MOMENTS[1]**t)) + 1e-8)
            told = {"epoch": model.epoch + 1, "train_loss": float((loss / share).sum())}
            model = JointModel(weights, model.outputs, model.epoch + 1, (mean, square), [*model.history, told])
            if held_out is not None:
                told.update({f"holdout_{k}": v for k, v in _mean_losses(model, held_out).items()})
            if folder:
                save_joint(train.sparkSession, model, folder)
    finally:
        examples.unpersist()
        if held_out is not None:
            held_out.unpersist()
    return model


def save_joint(spark: SparkSession, model: JointModel, folder: str) -> None:
    """One Parquet row a saved epoch, in any storage that Spark writes."""
    mean, square = model.moments
    row = [(model.epoch, json.dumps(model.outputs), json.dumps(model.history), model.num_features,
            model.weights.tobytes(), mean.tobytes(), square.tobytes())]
    schema = "epoch int, outputs string, history string, num_features int, weights binary, mean binary, square binary"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={model.epoch}")


def load_joint(spark: SparkSession, folder: str, epoch: int | None = None) -> JointModel:
    """The saved model of an epoch (the last one by default): scoring and training go on from it."""
    saved = spark.read.parquet(folder)
    if epoch is not None:
        saved = saved.where(F.col("epoch") == epoch)
    r = saved.orderBy(F.desc("epoch")).first()
    outputs = json.loads(r["outputs"])
    shape = (len(outputs), r["num_features"] + 1)
    weights, mean, square = (np.frombuffer(r[c]).reshape(shape).copy() for c in ("weights", "mean", "square"))
    return JointModel(weights, outputs, r["epoch"], (mean, square), json.loads(r["history"]))


# ---------------------------------------------------------------------------
# batch scoring from a saved model
# ---------------------------------------------------------------------------

def batch_scorer(spark: SparkSession, folder: str, epoch: int | None = None, text_col: str = "text",
                 case_variants: bool = True):
    """A scorer for ``flow.process``: the saved model, sent once and read once a worker.

    Each text is scored as it is, in lower and in upper case (with ``case_variants``) in
    one batch, and the largest logit of each class counts. A NULL text gets NULL scores.
    """
    model = load_joint(spark, folder, epoch)
    sent = spark.sparkContext.broadcast(model.weights[[model.outputs.index(c) for c in CLASSES]])
    variants = [F.col(text_col)] + ([F.lower(F.col(text_col)), F.upper(F.col(text_col))] if case_variants else [])

    @F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in CLASSES]))
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = sent.value
        for texts in batches:
            out = np.full((len(texts), len(CLASSES)), np.nan)
            for lo in range(0, len(texts), BLOCK // 4):
                part = texts.iloc[lo:lo + BLOCK // 4]
                at = [k for k, v in enumerate(part) if v is not None]
                rows = [np.asarray(x, int) for k in at for x in part.iloc[k]]
                if rows:
                    z = _logits(weights, rows).reshape(len(at), -1, len(CLASSES)).max(axis=1)
                    out[lo + np.array(at)] = 1 / (1 + np.exp(-z))
            yield pd.DataFrame(out, columns=CLASSES)  # NaN arrives as NULL

    def score(messages: DataFrame) -> DataFrame:
        features = F.when(F.col(text_col).isNotNull(), F.array(*[hashed_terms(v, model.num_features) for v in variants]))
        kept = [c for c in messages.columns if c not in CLASSES]
        return messages.select(*kept, scored(features).alias("_s")).select(*kept, "_s.*")
    return score

