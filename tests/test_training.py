"""Training: held-out metrics use the hold-out's own labels as truth."""
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from moderata.functions.classes import CLASSES
from moderata.operators import labels as LB
from moderata.operators import training as TR
from moderata.sources import tables as TB


def test_train_eval_truth_is_holdout_labels(spark):
    t = LB.split_hash(TB.training_frame(spark, SF01))
    train, hold = t.where(F.col("split") == "train"), t.where(F.col("split") == "holdout")
    model = TR.fit(train, max_iter=10)
    ev = {r["class"]: r for r in TR.evaluate(model, hold).collect()}
    truth = hold.select([F.count_if(F.col(c) > 0.5).alias(c) for c in CLASSES]).collect()[0]
    n = hold.count()
    for c in CLASSES:
        assert ev[c].tp + ev[c].fn == truth[c]
        assert ev[c].tp + ev[c].fp + ev[c].fn + ev[c].tn == n
    # the learned scorer gives probabilities in [0, 1] for every class
    out = model.transform(hold.select("id", "comment_text"), keep=("id",))
    lo_hi = out.select(*[F.min(c).alias(f"lo_{c}") for c in CLASSES],
                       *[F.max(c).alias(f"hi_{c}") for c in CLASSES]).collect()[0]
    assert all(0.0 <= lo_hi[f"lo_{c}"] and lo_hi[f"hi_{c}"] <= 1.0 for c in CLASSES)


# ---------------------------------------------------------------- joint training

@pytest.fixture(scope="module")
def frame(spark):
    t = TB.training_frame(spark, SF01)
    return t.withColumn("comment_text", F.when(F.col("id") % 50 != 3, F.col("comment_text"))).persist()


def test_gradient_equals_differences():
    r = np.random.default_rng(5)
    weights = r.standard_normal((4, 9)) * 0.3
    rows = [r.choice(8, k, replace=False) for k in (0, 1, 3, 8)]
    targets = r.random((4, 4))
    targets[r.random((4, 4)) < 0.4] = np.nan
    loss, known, gradient = TR.loss_and_gradient(weights, rows, targets)
    assert known.tolist() == (~np.isnan(targets)).sum(axis=0).tolist()
    for at in np.ndindex(weights.shape):
        up, down = weights.copy(), weights.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        slope = (TR.loss_and_gradient(up, rows, targets)[0].sum() - TR.loss_and_gradient(down, rows, targets)[0].sum()) / 2e-5
        assert abs(slope - gradient[at]) < 1e-6


def test_joint_loss_equals_bce_and_masked_bce(spark, frame):
    """The objective is the library's own losses on the fitted model's logits; training lowers it."""
    fresh = TR.new_model(num_features=256)
    model = TR.train_epochs(fresh, frame, 2, steps=3)
    names = TR.joint_outputs()
    rows = frame.select("id", TR.hashed_terms("comment_text", 256).alias("x"), *names).collect()
    z = TR._logits(model.weights, [np.asarray(r["x"], int) for r in rows])
    wide = spark.createDataFrame([(*[r[c] for c in names], *map(float, v)) for r, v in zip(rows, z)],
                                 ", ".join([f"{c} double" for c in names] + [f"logit_{c} double" for c in names]))
    groups = [c for c in names if c not in CLASSES]
    parts = {"classes": LB.bce_loss(wide, CLASSES), "identity": LB.bce_loss(wide, groups)}
    told = TR.joint_loss(model, frame)
    for name, table in parts.items():
        assert abs(table.where("class = 'all'").first()["loss"] - told[name]) < 1e-5
    assert told["sum"] == told["classes"] + told["identity"] < TR.joint_loss(fresh, frame)["sum"]


def test_stopped_training_resumes_to_the_same_model(spark, frame):
    folder = tempfile.mkdtemp(prefix="moderata-joint-", dir="/tmp")
    start = TR.new_model(num_features=128)
    straight = TR.train_epochs(start, frame, 2, steps=2)
    TR.train_epochs(start, frame, 1, folder, frame, steps=2)
    resumed = TR.train_epochs(TR.load_joint(spark, folder), frame, 2, folder, frame, steps=2)
    assert np.allclose(straight.weights, resumed.weights, atol=1e-9)
    saved = TR.load_joint(spark, folder)
    assert saved.epoch == 2 and [h["epoch"] for h in saved.history] == [1, 2]
    assert (saved.weights == resumed.weights).all()
    assert TR.load_joint(spark, folder, 1).epoch == 1
    # the batch scorer: largest logit of three case variants, NULL for a NULL text
    texts = [(1, "Some Toxic WORDS here"), (2, ""), (3, None)]
    out = {r.message_id: r for r in TR.batch_scorer(spark, folder)(
        spark.createDataFrame(texts, "message_id long, text string")).collect()}
    seven = saved.weights[:7]
    for i, text in texts[:2]:
        variants = spark.createDataFrame([(v,) for v in (text, text.lower(), text.upper())], "text string")
        x = [np.asarray(r["x"], int) for r in variants.select(TR.hashed_terms("text", 128).alias("x")).collect()]
        want = 1 / (1 + np.exp(-TR._logits(seven, x).max(axis=0)))
        assert np.allclose([out[i][c] for c in CLASSES], want)
    assert all(out[3][c] is None for c in CLASSES)


def test_saved_ml_model_scores_alike(spark, frame):
    folder = tempfile.mkdtemp(prefix="moderata-ml-", dir="/tmp")
    known = frame.where("comment_text is not null")
    model = TR.fit(known, max_iter=2, num_features=64)
    model.save(folder)
    few = known.select("id", "comment_text")
    a, b = (m.transform(few, keep=("id",)).orderBy("id").collect() for m in (model, TR.MultiLabelModel.load(folder)))
    assert a == b


# ---------------------------------------------------------------- padded batches

def test_batches_are_full_and_padded_to_their_longest_row(spark):
    r = np.random.default_rng(2)
    rows = [(i, list(range(int(n)))) for i, n in enumerate(r.integers(0, 90, 501))] + [(900, None)]
    df = spark.createDataFrame(rows, "key long, ids array<int>").repartition(9)
    out = LB.pad_batches(df, "ids", "key", 50, 3).collect()
    assert len(out) == 502
    order = sorted(((len(ids or []), key) for key, ids in rows))
    place = {key: k // 50 for k, (_, key) in enumerate(order)}
    for x in out:
        longest = max(n for n, key in order if place[key] == x.batch)
        assert x.batch == place[x.key] and x.pad_to == -(-longest // 8) * 8 == len(x.input_ids) == len(x.attention_mask)
        assert x.input_ids == x.ids + [3] * (x.pad_to - len(x.ids)) and sum(x.attention_mask) == len(x.ids)
    assert LB.pad_batches(df.where("false"), "ids", "key", 50, 3).count() == 0


def test_observed_metrics_equal_eval_metrics(spark):
    r = np.random.default_rng(6)
    rows = [tuple(int(v) for v in r.integers(0, 2, 6)) for _ in range(300)]
    names = [f"{k}_{c}" for c in CLASSES[:3] for k in "yp"]
    wide = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)).repartition(5)
    counted, metrics = LB.observed_metrics(wide, CLASSES[:3])
    counted.write.format("noop").mode("overwrite").save()
    assert metrics().collect() == LB.eval_metrics(wide, CLASSES[:3]).collect()


def test_steps_send_few_gradients_and_losses_send_none(spark):
    """Tasks per gradient are bounded by the cores; an evaluation makes no gradient; repeated places count each time."""
    many = spark.range(400).repartition(100)
    assert TR._few_parts(many).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    weights = np.arange(15.0).reshape(3, 5) / 10
    rows, y = [np.array([0, 0, 3]), np.array([], int)], np.array([[1.0, np.nan, 0.0], [0.0, 1.0, np.nan]])
    x = np.array([[2, 0, 0, 1, np.sqrt(3)], [0, 0, 0, 0, 1]]) / np.array([[np.sqrt(3)], [1]])
    error = np.where(np.isnan(y), 0, 1 / (1 + np.exp(-(x @ weights.T))) - y)
    loss, known, gradient = TR.loss_and_gradient(weights, rows, y)
    assert np.allclose(gradient, error.T @ x) and known.tolist() == [2, 1, 1]
    again = TR.loss_and_gradient(weights, rows, y, gradient=False)
    assert np.allclose(again[0], loss) and again[2] is None
