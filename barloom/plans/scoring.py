"""Scores from vectors, sequences and simple models (SC-01..04, VEC-05)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scores import rule_confidence, rule_direction, rule_score
from barloom.operators.joins import latest_per

c = F.col


def latest_vectors(df: DataFrame, as_of, cols: Sequence[str] = ("features",), key: str = "entity", ts: str = "date") -> DataFrame:
    """Each entity's newest vector at or before a date."""
    return latest_per(df.where(c(ts) <= as_of).select(key, ts, *cols), key, ts)


def score_by_rule(df: DataFrame, col: str = "features") -> DataFrame:
    v = c(col)
    return df.withColumn("pred_return", rule_score(v)).withColumns(
        {"direction": rule_direction(c("pred_return")), "confidence": rule_confidence(v)}
    )


Model = Callable[[np.ndarray], np.ndarray]


def score_sequences(df: DataFrame, model: Model, outputs: Sequence[str] = ("pred_1day",), limit: float = 15.0, col: str = "seq") -> DataFrame:
    """Run a user's model over (batch, length, features) arrays; one column per model output.

    The model travels with the task closure and sees one Arrow batch at a time, without copies or Python rows.  Non-finite outputs become 0
    and all are clamped to ±15.
    """
    ids = [n for n in df.columns if n != col]
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in ids), *(f"`{o}` double" for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            steps = b.column(len(ids)).flatten()
            flat = steps.flatten()
            if len(steps) % n or len(flat) % max(len(steps), 1):
                raise ValueError("sequences differ in length or width")
            # the values lie in one buffer, sequence after sequence
            x = flat.to_numpy(zero_copy_only=False).reshape(n, len(steps) // n, -1)
            y = np.asarray(model(x), dtype="float64").reshape(n, len(outputs))
            y = np.clip(np.where(np.isfinite(y), y, 0.0), -limit, limit)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(ids)], *(pa.array(v) for v in y.T)], [*ids, *outputs])

    return df.select(*ids, col).mapInArrow(run, schema)


def fit_base(df: DataFrame, features: Sequence[str], target: str, rounds: int = 20, depth: int = 4, seed: int = 42, fit_until=None, ts: str = "date"):
    """Gradient-boosted regression trees over named columns (null counts as 0); returns the fitted pipeline.

    ``fit_until``: rows with ``ts`` before it are fitted on, so that later rows stay unseen; by default all are.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = df.where(c(target).isNotNull()).fillna(0.0, subset=list(features))
    if fit_until is not None:
        data = data.where(c(ts) < F.lit(fit_until).cast("date"))
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"),
        GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="base_pred", maxIter=rounds, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(data)


def predict_base(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(df.fillna(0.0, subset=list(features))).drop("_x")


def fit_fusion(df: DataFrame, a: str, b: str, target: str) -> DataFrame:
    """Least-squares weights of two predictions plus intercept, and the mean squared error (one row).

    Normal equations from covariances: one aggregate, no iteration and nothing collected.
    """
    m = df.where(c(a).isNotNull() & c(b).isNotNull() & c(target).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(target).alias("mt"),
        F.var_pop(a).alias("vaa"), F.var_pop(b).alias("vbb"), F.var_pop(target).alias("vtt"),
        F.covar_pop(a, b).alias("vab"), F.covar_pop(a, target).alias("vat"), F.covar_pop(b, target).alias("vbt"),
    )
    det = c("vaa") * c("vbb") - c("vab") * c("vab")
    wa = F.try_divide(c("vat") * c("vbb") - c("vbt") * c("vab"), det)
    wb = F.try_divide(c("vbt") * c("vaa") - c("vat") * c("vab"), det)
    return (
        m.withColumns({"weight_a": wa, "weight_b": wb})
        .withColumn("intercept", c("mt") - c("weight_a") * c("ma") - c("weight_b") * c("mb"))
        .withColumn("mse", c("vtt") - c("weight_a") * c("vat") - c("weight_b") * c("vbt"))
        .select("n", "weight_a", "weight_b", "intercept", "mse")
    )


def fuse(df: DataFrame, weights: DataFrame, a: str, b: str, out: str = "fused") -> DataFrame:
    w = weights.select(F.struct("weight_a", "weight_b", "intercept")).scalar()
    return (
        df.withColumn("_w", w)
        .withColumn(out, c("_w.weight_a") * c(a) + c("_w.weight_b") * c(b) + c("_w.intercept"))
        .drop("_w")
    )
