"""Image-request data work: defaults, guard, best-of-n ranking, safety gate.

Generation itself is model inference and not built; what is kept is the data
handling around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import IMAGE_DEFAULTS, IMAGE_MAX_PIXELS, IMAGE_MAX_STEPS, SAFETY_MESSAGE
from .features import dot


def with_defaults(req: DataFrame) -> DataFrame:
    """Fill missing request fields with the defaults."""
    out = req
    for k, v in IMAGE_DEFAULTS.items():
        if k in req.columns:
            out = out.withColumn(k, F.coalesce(F.col(k), F.lit(v)))
    return out


def validate(req: DataFrame, max_pixels: int = IMAGE_MAX_PIXELS,
             max_steps: int = IMAGE_MAX_STEPS) -> DataFrame:
    """Reject h*w > max_pixels or steps > max_steps (first rule wins)."""
    d = with_defaults(req)
    pixels = F.col("h").cast("bigint") * F.col("w").cast("bigint")
    reason = (F.when(pixels > max_pixels, "pixels")
              .when(F.col("ddim_steps") > max_steps, "steps"))
    return d.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def best_of_n(cands: DataFrame, prompt_col: str = "prompt_id", cand_col: str = "cand_id",
              score_col: str = "score") -> DataFrame:
    """The best-scoring candidate per prompt; ties go to the lowest id.

    ``max_by`` is a partial aggregate: a prompt with many candidates never
    lands whole in one task.
    """
    key = F.struct(F.col(score_col), (-F.col(cand_col)).alias("neg"))
    return (cands.groupBy(prompt_col)
            .agg(F.max_by(F.col(cand_col), key).alias("best_id"),
                 F.max(score_col).alias("best_score"),
                 F.count(F.lit(1)).alias("n_candidates")))


def score_candidates(cands: DataFrame, queries: DataFrame, on: str,
                     cand_vec: str = "embedding", query_vec: str = "query") -> DataFrame:
    """Similarity score = dot product of candidate and query vectors."""
    return cands.join(queries, on).withColumn("score", dot(F.col(cand_vec), F.col(query_vec)))


def safety_gate(results: DataFrame, flag_col: str = "nsfw") -> DataFrame:
    """I4: flagged results are withheld and answered with a fixed message."""
    flagged = F.coalesce(F.col(flag_col), F.lit(False))
    return (results.withColumn("status", F.when(flagged, "withheld").otherwise("shown"))
            .withColumn("message", F.when(flagged, F.lit(SAFETY_MESSAGE))))
