"""Small models in one task for each fold: logistic regression, multiple-instance learning, leave-one-page-out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The training settings that scores are compared by.
EPOCHS, RATE, PENALTY, TEMPERATURE = 400, 0.08, 1e-4, 0.5
LEAST_DEVIATION = 1e-6
# End of the fixed values.
#: Rows that a fold's model is fitted to, about and at most; every row is scored.
SAMPLE_ROWS = 16_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Scaler:
    """Zero mean and unit deviation; a constant feature is only centred."""

    def __init__(self, x: np.ndarray):
        self.mean, deviation = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(deviation < LEAST_DEVIATION, 1.0, deviation)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale


def logistic_fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent."""
    beta, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        off = _sigmoid(x @ beta + bias) - y
        beta -= rate * (off @ x / len(y) + penalty * beta)
        bias -= rate * off.mean()
    return beta, bias


def bag_logits(x: np.ndarray, begin: np.ndarray, beta: np.ndarray, bias: float, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-mean-exp of each bag's instance logits at a temperature, each instance's share in its bag)."""
    z = (x @ beta + bias) / temperature
    top = np.maximum.reduceat(z, begin)
    size = np.diff(np.append(begin, len(z)))
    mass = np.exp(z - np.repeat(top, size))
    sums = np.add.reduceat(mass, begin)
    return temperature * (top + np.log(sums / size)), mass / np.repeat(sums, size)


def mil_fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY, temperature: float = TEMPERATURE) -> tuple[np.ndarray, float]:
    """Smooth-maximum multiple-instance learning over bags; classes weigh alike."""
    weight = np.where(y == 1, len(y) / (2 * max((y == 1).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))
    size = np.diff(np.append(begin, len(x)))
    beta, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        logit, share = bag_logits(x, begin, beta, bias, temperature)
        off = (_sigmoid(logit) - y) * weight
        beta -= rate * ((np.repeat(off, size) * share) @ x / len(y) + penalty * beta)
        bias -= rate * off.mean()
    return beta, bias


def leave_one_out(df: DataFrame, fold: str, features: list[str], target: str, key: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(fold, key, target, score): every row scored by a logistic model of other folds' rows.

    A fold's model is fitted in one task to about ``sample_rows`` rows of the other folds at most, those with the smallest
    hashes of their keys; up to that number it is fitted to all of them. Only the models (a few numbers for each fold) go to all tasks.
    """
    counts = {r[0]: r[1] for r in df.groupBy(fold).count().orderBy(fold).collect()}
    total = sum(counts.values())
    shares = [(k, name, min(1.0, sample_rows / max(total - n, 1))) for k, (name, n) in enumerate(counts.items())]
    place = lambda name: F.col(fold).eqNullSafe(F.lit(name))
    number = F.coalesce(*(F.when(place(name), F.lit(k)) for k, name, _ in shares), F.lit(-1))
    fraction = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = df.filter(fraction < max((share for *_, share in shares), default=1.0)).select(key, fold, F.col(target).cast("double").alias("_y"), *features, fraction.alias("_at"))
    taken = F.array_compact(F.array(*(F.when(~place(name) & (F.col("_at") < share), F.lit(k)) for k, name, share in shares)))
    taught = rows.withColumn("_fold", F.explode(taken.cast("array<int>"))).select("_fold", key, "_y", *features)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        x, y = part[features].to_numpy(dtype=float), part["_y"].to_numpy()
        scale = Scaler(x)
        alike = len(set(y)) < 2
        beta, bias = (np.zeros(x.shape[1]), 0.0) if alike else logistic_fit(scale(x), y)
        return pd.DataFrame({"_fold": part["_fold"].iloc[:1].to_numpy(), "_mean": [scale.mean], "_scale": [scale.scale], "_beta": [beta], "_bias": [float(bias)], "_same": [float(y.mean()) if alike else None]})

    models = taught.groupBy("_fold").applyInPandas(one, "_fold int, _mean array<double>, _scale array<double>, _beta array<double>, _bias double, _same double")
    each = df.select(F.col(fold).alias("fold"), F.col(key).alias("key"), F.col(target).cast("long").alias("target"), number.alias("_fold"), *(F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features)))
    z = F.col("_bias")
    for j in range(len(features)):
        z = z + (F.col(f"_x{j}") - F.get("_mean", F.lit(j))) / F.get("_scale", F.lit(j)) * F.get("_beta", F.lit(j))
    logistic = 1 / (1 + F.exp(-F.least(F.lit(40.0), F.greatest(F.lit(-40.0), z))))
    # a fold without others has no model
    score = F.when(F.col("_bias").isNull(), 0.5).otherwise(F.coalesce("_same", logistic))
    return each.join(F.broadcast(models), "_fold", "left").select("fold", "key", "target", score.alias("score"))
