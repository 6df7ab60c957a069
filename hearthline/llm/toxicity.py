"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a lower-cased text, hashed to ``2**BITS`` places. Each
feature's value is its log-count ratio between the classes; logistic regression over those values is
fitted by L-BFGS. Fitting uses a bounded, documented sample of labelled rows (``SAMPLE_ROWS`` rows of
each class in hash order, together at most ``SAMPLE_FEATURES`` features), and the bias is then set to
the classes' proportion among all training labels. Scoring reads every text whole, and the model
that is broadcast has a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm import kernel
from hearthline.llm.common import materialise

GRAMS = (4, 6, 8)
BITS = 22
SAMPLE_ROWS, SAMPLE_FEATURES = 3000, 24_000_000
RIDGE, SMOOTH, LEAST_COUNT, LEAST_RATIO, ITERATIONS = 0.002, 20.0, 8, 1.0, 40

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashed(code: np.ndarray) -> list[np.ndarray]:
    """The place of every n-gram that starts at each code point, by n (those at the end are fewer): polynomials, then mixed."""
    out, value = [], np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(code) < n:
            break
        value = value[: len(code) - n + 1] * _BASE + code[n - 1 :]
        if n in GRAMS:
            mixed = value ^ (value >> np.uint64(32))
            out.append(((mixed + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


class Features:
    """Distinct features of texts; the scratch table is reused from text to text."""

    def __init__(self):
        self.place = np.zeros(1 << BITS, np.int32)

    def of(self, code: np.ndarray) -> np.ndarray:
        """Each feature of a text, given as code points, once. Long texts go block by block, so only the distinct features are held."""
        if len(code) > kernel.BLOCK:
            step, lap = kernel.BLOCK - max(GRAMS) + 1, max(GRAMS) - 1
            parts = [self.of(code[k : k + step + lap]) for k in range(0, len(code), step)]
            return np.unique(np.concatenate(parts))
        parts = _hashed(code.astype(np.uint64))
        if not parts:
            return np.zeros(0, np.int32)
        all_ = np.concatenate(parts)
        order = np.arange(len(all_), dtype=np.int32)
        self.place[all_] = order
        return all_[self.place[all_] == order]


def _texts(column: pa.Array):
    """The code points of each lower-cased text."""
    raw, offsets = kernel.utf8(column)
    for k in range(len(offsets) - 1):
        text = raw[offsets[k] : offsets[k + 1]].tobytes()
        if text.isascii():
            yield np.frombuffer(text.lower(), np.uint8)
        else:
            yield np.frombuffer(text.decode().lower().encode("utf-32-le"), "<u4")


def train(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of every feature, bias) from the distinct features of each row and its label."""
    size = 1 << BITS
    if not len(rows) or toxic.all() or not toxic.any():
        return np.zeros(size, np.float32), float(np.log((toxic.sum() + 0.5) / ((~toxic).sum() + 0.5)))
    counts = np.array([len(r) for r in rows])
    feature = np.concatenate(rows)
    label = np.repeat(toxic, counts)
    pos = np.bincount(feature[label], minlength=size)
    neg = np.bincount(feature[~label], minlength=size)
    share = toxic.mean()
    # Both classes are smoothed by SMOOTH occurrences in the sample's own proportion, so few occurrences say little.
    ratio = np.log((pos + SMOOTH * share) / toxic.sum()) - np.log((neg + SMOOTH * (1 - share)) / (~toxic).sum())
    often = (pos + neg >= LEAST_COUNT) & (np.abs(ratio) >= LEAST_RATIO)
    kept = often[feature]
    used = np.flatnonzero(often)
    column = (np.cumsum(often) - 1)[feature[kept]]
    row = np.repeat(np.arange(len(rows)), counts)[kept]
    ratio_used = ratio[used]
    target = toxic.astype(float)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], x[-1]
        z = np.bincount(row, (ratio_used * w)[column], len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        value = np.logaddexp(0, z).sum() - (target * z).sum() + 0.5 * RIDGE * len(rows) * (w @ w)
        err = p - target
        grad = np.append(ratio_used * np.bincount(column, err[row], len(used)) + RIDGE * len(rows) * w, err.sum())
        return value, grad

    x = np.append(np.zeros(len(used)), np.log(target.mean() / (1 - target.mean())))
    x = _lbfgs(loss, x)
    weights = np.zeros(size, np.float32)
    weights[used] = ratio_used * x[:-1]
    return weights, float(x[-1])


def _lbfgs(loss, x: np.ndarray, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halving steps."""
    value, grad = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ITERATIONS):
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y, rho), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - rho * (y @ q)) * s
        step, slope = 1.0, grad @ q
        while step > 1e-6:
            new = x - step * q
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-5 * abs(value)
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; rows without an id are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> tuple[np.ndarray, float]:
    """The model from labelled rows that are not held out.

    A document with several labels is toxic if one says so; null labels do not count. Of several
    texts with one id, the one with the smallest hash is taken. Without rows of both classes the model
    is a bias alone.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    sizes = {r["__toxic"] > 0: r["n"] for r in known.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("__id"), F.col("__id"))
    known = known.where("__toxic > 0").orderBy(*order).limit(SAMPLE_ROWS).unionByName(known.where("__toxic <= 0").orderBy(*order).limit(SAMPLE_ROWS))
    rows = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("__text")).join(F.broadcast(known), F.col("__own") == F.col("__id"))
    rows = rows.select("__id", "__toxic", "__text", F.xxhash64("__text").alias("__version"))

    def featurise(batches):
        maker = Features()
        for batch in batches:
            found = [maker.of(t) for t in _texts(batch.column(2))]
            columns = [batch.column(0), batch.column(1), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "toxic", "n", "features", "version"])

    kind = docs.schema[id_col].dataType.simpleString()
    table = materialise(rows.mapInArrow(featurise, f"id {kind}, toxic int, n long, features binary, version long"), "toxic-rows")
    only = table.groupBy("id").agg(F.min("version").alias("version"))  # ids and hashes alone; features stay where they are
    table = materialise(table.join(F.broadcast(only), ["id", "version"]).dropDuplicates(["id"]), "toxic-sample")
    upto = 0
    chosen = []
    for key, n in table.orderBy(F.xxhash64("id"), "id").select("id", "n").toLocalIterator():  # at most 2 * SAMPLE_ROWS rows
        upto += n
        if upto > SAMPLE_FEATURES:
            break
        chosen.append(key)
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(k,) for k in chosen], f"id {kind}"))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        rows = [np.frombuffer(x.as_py(), np.int32) for x in table["features"]]
        toxic = table["toxic"].to_numpy() > 0
        weights, bias = train(rows, toxic)
        if toxic.any() and not toxic.all():  # from the sample's proportion to that of all labels
            bias += np.log(sizes[True] / sizes[False]) - np.log(toxic.sum() / (~toxic).sum())
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": pa.array([bias])})

    model = table.join(ids, "id").groupBy(F.lit(0).alias("all")).applyInArrow(learn, "weights binary, bias double").first()
    if model is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus score (0 to 1); null and empty texts score the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    spot, width = kept.index(text_col), len(kept)

    def rate(batches):
        maker = Features()
        weights, bias = shared.value
        for batch in batches:
            z = np.array([weights[maker.of(t)].sum(dtype=np.float64) for t in _texts(batch.column(spot))], np.float64) + bias
            columns = [batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*batch.schema.names, "score"])

    schema = docs.select(*kept).schema.add("score", "double")
    return docs.select(*kept).mapInArrow(rate, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
