"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are indicators of hashed n-grams: byte trigrams, and words and word pairs in lower case. Each is scaled by
its class log-count ratio; dual coordinate descent fits a linear hinge-loss model to the scaled vectors; a logistic
curve turns margins into scores. The fit uses a bounded sample of the labelled rows, those with the smallest hashes
of their ids (at most ``SAMPLE_ROWS`` of them and ``SAMPLE_BYTES`` of their texts); every row is scored.

Defined results: a null or empty text has no features and gets the score of the model's intercept; rows whose label is null
are not learned from; of documents that share a labelled id the one with the least hash of its text is learned from; without rows of both
classes all scores are the share of label 1 (0.5 without any row); with fewer than five rows in a class the curve is fitted to the
rows that the model learned from; a row's score depends on its text alone; repeated rows repeat their score. Extra columns stay; one
named like a computed column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.arrow_text import LOWER, mix, row_of, span_hashes, text_slices, word_bounds
from folioscope.llm.bpe import kept_columns, with_rows
from folioscope.llm.workspace import bounded_batches, discard, map_arrow, written

#: Labelled rows that the model is fitted to at most, and the bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 16_000, 1 << 27
#: Hash values of byte trigrams and of words and word pairs; together 2**16.
TRIGRAMS, WORDS = 1 << 15, 1 << 15
FEATURES = TRIGRAMS + WORDS
#: Rows and bytes in one matrix of indicators.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 19
SMOOTHING, COST, EPOCHS, SEED = 1.0, 0.05, 12, 11


def _word_feature(hashes: np.ndarray) -> np.ndarray:
    return TRIGRAMS + ((hashes >> np.uint64(32)) % np.uint64(WORDS)).astype(np.int64)


def indicators(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all rows, each row's first place and one more at the end); a row's features are distinct and ascending."""
    n = len(offs) - 1
    seen = np.zeros((n, FEATURES), dtype=bool)
    if len(raw) > 2:
        code = (raw[:-2].astype(np.uint32) << np.uint32(16)) | (raw[1:-1].astype(np.uint32) << np.uint32(8)) | raw[2:]
        code = ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
        row = row_of(offs)
        inside = row[:-2] == row[2:]
        seen[row[:-2][inside], code[inside]] = True
    low = LOWER[raw]
    starts, ends, first = word_bounds(low, offs)
    words = span_hashes(low, starts, ends)
    row = row_of(first)
    seen[row, _word_feature(words)] = True
    if len(words) > 1:
        pairs = mix(words[:-1] * np.uint64(3) + words[1:])
        inside = row[:-1] == row[1:]
        seen[row[:-1][inside], _word_feature(pairs[inside])] = True
    rows, features = np.nonzero(seen)
    return features.astype(np.uint16), np.searchsorted(rows, np.arange(n + 1))


def blocks(batch: pa.RecordBatch, text: str):
    """Rows with their bytes and offsets, few enough for a matrix of indicators."""
    for rows, raw, offs in text_slices(batch, text, BLOCK_BYTES):
        for a in range(0, rows.num_rows, BLOCK_ROWS):
            b = min(a + BLOCK_ROWS, rows.num_rows)
            yield rows.slice(a, b - a), raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


@dataclass
class Model:
    weights: np.ndarray  # of each feature, with its log-count ratio multiplied in
    intercept: float
    slope: float
    shift: float

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        features, first = indicators(raw, offs)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[features])])
        return 1 / (1 + np.exp(-np.clip(self.slope * (sums[first[1:]] - sums[first[:-1]] + self.intercept) + self.shift, -500, 500)))


def log_count_ratios(features: np.ndarray, first: np.ndarray, label: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of (smoothed share of a feature among class 1's indicators over that among class 0's)."""
    own = np.repeat(label.astype(np.int8), np.diff(first))
    counts = [smoothing + np.bincount(features[own == c], minlength=FEATURES) for c in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(features: np.ndarray, first: np.ndarray, label: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Least L2-regularised hinge loss over rows scaled by ``ratios``: (weights times ratios, intercept).

    The dual has a variable from 0 to ``cost`` for each row; each step minimises over one of them. Classes weigh alike.
    """
    squares = ratios * ratios
    product = np.zeros(FEATURES)
    intercept = 0.0
    sign = np.where(label == 1, 1.0, -1.0)
    share = np.array([np.mean(label == 0), np.mean(label == 1)])
    most = cost * 0.5 / share[label]
    parts = [features[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    diagonal = np.array([squares[p].sum() for p in parts]) + 1.0
    alpha = np.zeros(len(label))
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(label)):
            p = parts[i]
            gradient = sign[i] * (product[p].sum() + intercept) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                product[p] += step * squares[p]
                intercept += step
                moved = max(moved, abs(step))
        if moved < 1e-5 * cost:
            break
    return product, intercept


def logistic_curve(margin: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of the most likely logistic curve, with the targets drawn in from 0 and 1 (Newton's steps)."""
    ones, zeros = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = max(float(np.std(margin)), 1e-9)
    x = np.stack([margin / scale, np.ones(len(margin))])
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-4 * np.eye(2), x @ (p - target) + 1e-4 * at)
        at -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return at[0] / scale, at[1]


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray) -> Model:
    """The model of labelled rows; every fifth row of a class is held back for the logistic curve."""
    if len(set(label.tolist())) < 2:
        share = min(max(float(label.mean()) if len(label) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    place = np.zeros(len(label), dtype=np.int64)
    for c in (0, 1):
        place[label == c] = np.arange((label == c).sum())
    back = place % 5 == 4
    counts = np.diff(first)

    def part(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return features[np.repeat(keep, counts)], np.concatenate([[0], np.cumsum(counts[keep])])

    own, begin = part(~back)
    ratios = log_count_ratios(own, begin, label[~back])
    weights, intercept = dual_coordinate_descent(own, begin, label[~back], ratios)
    if len(set(label[back].tolist())) < 2:
        back = np.ones(len(label), dtype=bool)
    other, begin = part(back)
    sums = np.concatenate([[0.0], np.cumsum(weights[other])])
    slope, shift = logistic_curve(sums[begin[1:]] - sums[begin[:-1]] + intercept, label[back])
    return Model(weights, intercept, float(slope), float(shift))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents that are not held out, of ``most`` bytes of text together."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    # labels of documents that are not there take no place in the sample
    there = known.join(docs.select(F.col(doc_id).alias("_id")).distinct(), "_id", "left_semi")
    chosen = there.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # at most ``rows`` ids, a parameter; one text for each, and as many in the order of their hashes as the bytes allow
    found = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    single = found.groupBy("_id").agg(F.min("_label").alias("_label"), F.min(F.struct(F.xxhash64("_text").alias("hash"), F.col("_text").alias("text"))).alias("_least"))
    single = written(single.select("_id", "_label", F.col("_least.text").alias("_text")), "sample")
    so_far = F.sum(F.octet_length("_text").cast("long")).over(Window.orderBy(F.xxhash64("_id"), "_id"))
    # ids and sizes alone, at most ``rows`` of them, go through one task
    fits = single.select("_id", so_far.alias("_sum")).filter(F.col("_sum") <= most).select("_id")
    cut = single.join(F.broadcast(fits), "_id")

    def run(batches):
        for batch in batches:
            for part, raw, offs in blocks(batch, "_text"):
                features, first = indicators(raw, offs)
                data = pa.array([features[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.large_binary())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2).cast(pa.int32()), data.cast(pa.binary())], names=["id", "label", "features"])

    kept = map_arrow(cut.select("_id", "_text", "_label"), run, "id string, label int, features binary").toArrow().sort_by([("id", "ascending")])
    discard(single)
    data = [x.as_py() for x in kept.column("features")]
    first = np.concatenate([[0], np.cumsum([len(x) // 2 for x in data], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(data), np.uint16), first, np.array(kept.column("label").to_pylist(), dtype=np.int64)


def scored(docs: DataFrame, model: Model, text: str = "text", with_text: bool = False) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on)."""
    bounded_batches(docs.sparkSession)
    made = ["score", "predicted"]
    keep = kept_columns(docs, made, text, with_text)
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([source.schema[c] for c in keep]).add("score", "double").add("predicted", "integer")
    own = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for batch in batches:
            for rows, raw, offs in blocks(batch, text):
                score = own.value.scores(raw, offs)
                yield with_rows(rows, keep, {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return map_arrow(source, run, schema)


def classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled documents that are not held out."""
    return fit(*sample(docs, labels, label, doc_id, text, rows))
