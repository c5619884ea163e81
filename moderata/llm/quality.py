"""Quality classifier: gated-attention multiple-instance learning (operator 3).

A document is a bag of passages of 64 words. Each passage is described by
numbers computed from its bytes (word lengths, letter cases, symbols,
repetition, hashed words), encoded by one tanh layer, weighted by a gated
attention layer and summed; a logistic layer scores the weighted sum. All
layers are learned together from document labels alone.

Training reads a bounded sample: at most ``max_docs`` labelled documents, those
with the smallest hash of the id, and at most ``max_passages`` evenly spaced
passages of each. Scoring reads every passage of every text.

Defined cases: a null or empty text is a bag with one passage of zeros and
gets a score like any other; a null id is scored and never learned from;
several labels of one document count by their mean (0.5 or more: label 1);
repeated rows are scored each; an empty label table or labels of one class
give the constant score of that class's share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, id_bucket, joined, mix64, slabs, word_hashes, word_spans, word_table

PASSAGE_WORDS = 64
HASHED = 24
HIDDEN = 16
THRESHOLD = 0.3
MAX_DOCS = 3000
MAX_PASSAGES = 32
_WORD = word_table(WHITE)
_CLASSES = ["upper", "lower", "digit", "high", "stop", "bang", "symbol"]


def _byte_classes() -> np.ndarray:
    out = np.zeros((len(_CLASSES), 256), dtype=np.float32)
    out[0, 65:91] = 1
    out[1, 97:123] = 1
    out[2, 48:58] = 1
    out[3, 128:] = 1
    out[4, list(b".,;:")] = 1
    out[5, list(b"!?")] = 1
    out[6, list(b"#*$%&|<>{}[]@=_~^")] = 1
    return out


_TABLE = _byte_classes()
N_FEATURES = len(_CLASSES) + 8 + HASHED


def passages(texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and the text number of each row."""
    rows, owners, n = [], [], 0
    for slab in slabs(texts):
        buf, offsets, owner = joined(slab)
        starts, ends = word_spans(buf, _WORD)
        if not len(starts):
            continue
        piece = np.searchsorted(offsets, starts, side="right") - 1
        first_of_piece = np.searchsorted(piece, np.arange(len(offsets)))
        passage = (np.arange(len(starts)) - first_of_piece[piece]) // PASSAGE_WORDS
        head = np.flatnonzero(np.concatenate(([True], (np.diff(piece) != 0) | (np.diff(passage) != 0))))
        rows.append(_describe(buf, starts, ends, head))
        owners.append(owner[piece[head]])
    if not rows:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, int)
    return np.concatenate(rows), np.concatenate(owners)


def _describe(buf, starts, ends, head) -> np.ndarray:
    sizes = (ends - starts).astype(np.float32)
    count = np.diff(np.append(head, len(starts))).astype(np.float32)
    of = np.repeat(np.arange(len(head)), count.astype(int))
    total = np.add.reduceat(sizes, head)
    feats = []
    # spans of bytes of a passage: from its first word's start to the next passage's
    edge = starts[head]
    for table in _TABLE:
        feats.append(np.add.reduceat(table[buf], edge) / total)
    mean = total / count
    feats.append(mean / 8)
    feats.append(np.sqrt(np.maximum(0, np.add.reduceat(sizes * sizes, head) / count - mean ** 2)) / 4)
    codes = word_hashes(buf, starts, ends, fold=False)
    same = np.zeros(len(codes), np.float32)
    same[1:] = codes[1:] == codes[:-1]
    same[head] = 0
    feats.append(np.add.reduceat(same, head) / count)
    order = np.lexsort((codes, of))
    fresh = np.ones(len(codes), np.float32)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (of[order][1:] != of[order][:-1])
    feats.append(np.bincount(of[order], weights=fresh, minlength=len(head)) / count)
    feats.append(np.add.reduceat((sizes == 1).astype(np.float32), head) / count)
    feats.append(np.log1p(count) / 4)
    feats.append(np.add.reduceat((_TABLE[0][buf[starts]]), head) / count)
    feats.append(np.add.reduceat((buf == 10).astype(np.float32), edge) / count * 4)
    mixed = mix64(codes)
    slot = (mixed % np.uint64(HASHED)).astype(int)
    sign = np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    bag = np.bincount(of * HASHED + slot, weights=sign, minlength=len(head) * HASHED)
    bag = bag.reshape(len(head), HASHED) / np.sqrt(count)[:, None] * 0.3
    return np.concatenate([np.stack(feats, 1), bag], 1).astype(np.float32)


def bags(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages ordered by text, one row of zeros for texts without a word; and each text's first row."""
    x, owner = passages(texts)
    missing = np.setdiff1d(np.arange(n), owner)
    x = np.concatenate([x, np.zeros((len(missing), N_FEATURES), np.float32)])
    owner = np.concatenate([owner, missing])
    order = np.argsort(owner, kind="stable")
    return x[order], np.searchsorted(owner[order], np.arange(n))


def _sigmoid(v):
    return 1.0 / (1.0 + np.exp(-np.clip(v, -30, 30)))


def forward(model: dict, x: np.ndarray, ptr: np.ndarray) -> dict:
    p = model
    of = np.repeat(np.arange(len(ptr)), np.diff(np.append(ptr, len(x))))
    h = np.tanh((x - p["mean"]) / p["scale"] @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, ptr)[of])
    a = e / np.add.reduceat(e, ptr)[of]
    z = np.add.reduceat(a[:, None] * h, ptr)
    return {"of": of, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ p["c"] + p["d"])}


def learn(x: np.ndarray, ptr: np.ndarray, y: np.ndarray, epochs: int = 160, rate: float = 0.03,
          decay: float = 1e-4, seed: int = 11) -> dict:
    """Full-batch Adam on the mean log loss; deterministic for the same rows."""
    rng = np.random.default_rng(seed)
    f, k = x.shape[1], HIDDEN
    model = {"W": rng.normal(0, f ** -0.5, (f, k)), "b": np.zeros(k), "V": rng.normal(0, k ** -0.5, (k, k)),
             "U": rng.normal(0, k ** -0.5, (k, k)), "w": rng.normal(0, k ** -0.5, k),
             "c": rng.normal(0, k ** -0.5, k), "d": np.zeros(1),
             "mean": x.mean(0), "scale": x.std(0) + 1e-3}
    model = {n: v.astype(np.float32) for n, v in model.items()}
    xs = (x - model["mean"]) / model["scale"]
    names = ["W", "b", "V", "U", "w", "c", "d"]
    m = {n: np.zeros_like(model[n]) for n in names}
    v = {n: np.zeros_like(model[n]) for n in names}
    for step in range(1, epochs + 1):
        r = forward(model, x, ptr)
        of, h, t, g, a = r["of"], r["h"], r["t"], r["g"], r["a"]
        dl = (r["p"] - y) / len(y)
        grad = {"c": r["z"].T @ dl, "d": np.array([dl.sum()])}
        dz = dl[:, None] * model["c"]
        dzr = dz[of]
        da = (dzr * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, ptr)[of])
        grad["w"] = (t * g).T @ de
        dtg = de[:, None] * model["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        grad["V"], grad["U"] = h.T @ dt, h.T @ dg
        dh = a[:, None] * dzr + dt @ model["V"].T + dg @ model["U"].T
        dh *= 1 - h * h
        grad["W"], grad["b"] = xs.T @ dh, dh.sum(0)
        for n in names:
            gn = (grad[n] + decay * model[n]).astype(np.float32)
            m[n] = 0.9 * m[n] + 0.1 * gn
            v[n] = 0.999 * v[n] + 0.001 * gn * gn
            model[n] -= np.float32(rate) * (m[n] / np.float32(1 - 0.9 ** step)) / (
                np.sqrt(v[n] / np.float32(1 - 0.999 ** step)) + np.float32(1e-8))
    return model


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES) -> dict:
    """Learn from rows whose id falls outside the held-out fold (crc32 mod 5 = 0)."""
    truth = (labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
             .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (id_bucket(F.col("id"), 5) != 0))
             .groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(max_docs))
    # at most max_docs small rows: a proven bound
    rows = (docs.select("doc_id", "text").join(F.broadcast(truth), F.col("doc_id") == F.col("id"))
            .select("id", "y", _sample_udf(max_passages)("text").alias("x")).collect())
    rows = sorted({r["id"]: r for r in sorted(rows, key=lambda r: (r["id"], r["x"]))}.values(), key=lambda r: r["id"])
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return {"constant": float(y[0]) if len(y) else 0.5}
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    ptr = np.cumsum([0] + [len(p) for p in parts[:-1]])
    return learn(np.concatenate(parts), ptr, y.astype(np.float32))


def _sample_udf(max_passages: int):
    @F.pandas_udf("binary")
    def sample(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            x, ptr = bags(texts, len(texts))
            out = []
            for lo, hi in zip(ptr, np.append(ptr[1:], len(x))):
                pick = np.unique(np.linspace(lo, hi - 1, min(hi - lo, max_passages)).astype(int))
                out.append(x[pick].tobytes())
            yield pd.Series(out, dtype=object)
    return sample


def scorer(model: dict):
    """A column function text -> probability of label 1 under ``model``."""
    @F.pandas_udf("double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            if "constant" in model:
                yield pd.Series(np.full(len(texts), model["constant"]))
                continue
            if not len(texts):
                yield pd.Series([], dtype=float)
                continue
            x, ptr = bags(texts, len(texts))
            yield pd.Series(forward(model, x, ptr)["p"].astype(float))
    return score


def score_quality(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    return (docs.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"),
                        scorer(model)(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts."""
    return docs.where(scorer(model)(F.col("text")) >= threshold)
