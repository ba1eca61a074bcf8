"""Quality classifier by co-training of two views.

View one sees the text (shares of character kinds, repetition, word lengths and hashed words), view two the page metadata (source, language,
length). Each is a logistic regression. In every round each classifier rates all unlabelled rows, and those that it is surest of, SURE more of either
label each round, teach the other one (Blum and Mitchell, 1998). Labelled rows kept back calibrate each view, and the two views' log-odds together; the
calibrated score rates every document.

One pass over the texts writes each row's features; all else reads them. Fitting takes at most about sample_rows labelled rows, a documented bound: ids are
chosen by a hash, and of rows that share a labelled id the one with the smallest text hash is taken. A round's surest rows are found by a histogram of all
log-odds and then gathered: as many as the method asks for, whatever the input's size, and rows of equal features once. Only these features (no texts) reach
the driver. There is no shuffle of texts.

Cases: null and empty texts have zero features; null metadata are values of their own. Null and repeated ids pass through. Labels whose id
no document has are not used; several labels of an id count as their mean. With labels of one class only, or none, every score is
their smoothed share. Very long texts are one row of features each. Ties of log-odds (to 6 decimals) go by a hash of the features. An empty table gives an empty result. Only
the columns named are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast
from .ngram_join import text_slices, word_hashes

WORDS = 128
KINDS = 14
TEXT_DIMS = KINDS + 5 + WORDS
SOURCES, LANGS, LENGTHS = 64, 16, 24
META_DIMS = SOURCES + LANGS + LENGTHS
ROUNDS = 4
#: Rows of either label that a classifier adds for the other one in a round, the least log-odds of such a row (9 to 1), and its weight.
SURE, LEAST_ODDS, WEIGHT = 200, 2.2, 0.3
#: Histogram of log-odds: bins of 1 / BINS.
BINS = 20
#: Character kinds: other, lower, upper, digit, space, line end, then marks of their own, and non-ASCII.
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[10] = 1, 2, 3, 4, 5
for _i, _c in enumerate(b"!|*$%#&"):
    _KIND[_c] = 6 + _i
_KIND[128:] = 13


def text_features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row a document."""
    n = len(ends)
    size = np.diff(np.concatenate([[0], ends]))
    doc = np.repeat(np.arange(n), size)
    out = np.zeros((n, TEXT_DIMS))
    out[:, :KINDS] = np.bincount(doc * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS) / np.maximum(size, 1)[:, None]
    with np.errstate(over="ignore"):
        words, of = word_hashes(data, ends)
    many = np.bincount(of, minlength=n)
    if len(words):
        order = np.lexsort((words, of))
        w, d = words[order], of[order]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])
        first = np.flatnonzero(new)
        times = np.diff(np.concatenate([first, [len(w)]]))
        top = np.zeros(n)
        np.maximum.at(top, d[first], times)
        out[:, KINDS] = np.bincount(d[first], minlength=n) / np.maximum(many, 1)
        out[:, KINDS + 1] = top / np.maximum(many, 1)
        bag = np.bincount(of * WORDS + (words >> np.uint64(50)).astype(np.int64) % WORDS, minlength=n * WORDS).reshape(n, WORDS)
        out[:, KINDS + 5 :] = bag / np.maximum(many, 1)[:, None]
    out[:, KINDS + 2] = size / np.maximum(many, 1) / 10
    out[:, KINDS + 3] = np.log1p(size) / 10
    out[:, KINDS + 4] = size > 0
    return out


def meta_features(source: list, lang: list, chars: list) -> np.ndarray:
    out = np.zeros((len(source), META_DIMS))
    at = np.arange(len(source))
    slot = lambda v, m: zlib.crc32(b"\0" if v is None else str(v).encode()) % m
    out[at, [slot(v, SOURCES) for v in source]] = 1
    out[at, [SOURCES + slot(v, LANGS) for v in lang]] = 1
    out[at, [SOURCES + LANGS + min(LENGTHS - 1, int(max(v or 0, 0)).bit_length()) for v in chars]] = 1
    return out


class Logistic:
    """Ridge logistic regression by Newton's method on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = weight * np.maximum(p * (1 - p), 1e-4)
            step = np.linalg.solve((z.T * h) @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)


def kept_back(n: int) -> np.ndarray:
    """Which of n labelled rows are for the calibration."""
    return np.arange(n) % 4 == 3


def fitted(views: list[np.ndarray], y: np.ndarray, taught: list[list[tuple]]) -> list[Logistic]:
    """A classifier a view, of the labelled rows and of (features, label) that the other view has taught it."""
    use = ~kept_back(len(y))
    out = []
    for view, more in zip(views, taught, strict=True):
        x, labels = np.stack([f for f, _ in more]) if more else np.zeros((0, view.shape[1])), np.array([t for _, t in more])
        out.append(Logistic(np.concatenate([view[use], x]), np.concatenate([y[use], labels]), np.concatenate([np.ones(use.sum()), np.full(len(x), WEIGHT)])))
    return out


def _read(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), "f4") for x in column], float)


def surest(pool: DataFrame, models: list[Logistic], many: int) -> list[list[tuple]]:
    """For each view the (features, label) that the other view's classifier is surest of: many of either label at most."""
    spark = pool.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def rated(batches):
        for batch in batches:
            odds = [np.round(m.odds(_read(batch.column(k))), 6) for k, m in enumerate(shared.value)]  # rounded, so that equal features tie
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odds[0]), pa.array(odds[1])], names=["a", "b", "o0", "o1"])

    def histogram(batches):
        total: Counter = Counter()
        for batch in rated(batches):
            for k in (0, 1):
                bins, times = np.unique(np.floor(np.abs(batch.column(k + 2).to_numpy()) * BINS) * np.sign(batch.column(k + 2).to_numpy()), return_counts=True)
                total.update({(k, int(b)): int(n) for b, n in zip(bins, times, strict=True)})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([b for _, b in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["k", "bin", "n"])

    counts = {(r.k, r.bin): r.n for r in pool.select("a", "b").mapInArrow(histogram, "k int, bin int, n long").groupBy("k", "bin").agg(F.sum("n").alias("n")).collect()}
    rows = pool.select("a", "b").mapInArrow(rated, "a binary, b binary, o0 double, o1 double")
    taught: list[list[tuple]] = [[], []]
    for k in (0, 1):
        for label, sign in ((1.0, 1), (0.0, -1)):
            taken, least = 0, None
            for b in sorted((b for j, b in counts if j == k and b * sign > 0), key=lambda b: -b * sign):
                taken, least = taken + counts[k, b], abs(b) / BINS
                if taken >= many:
                    break
            if least is None:
                continue
            own = F.col(f"o{k}") * sign
            found = rows.where((own >= least) & (own > LEAST_ODDS)).select(F.col("ab"[1 - k]).alias("x"), F.col("ab"[k]).alias("y"), own.alias("o")).distinct()
            best = found.orderBy(F.desc("o"), F.xxhash64("x"), F.xxhash64("y")).limit(many).select("x").collect()
            taught[1 - k] += [(np.frombuffer(r.x, "f4").astype(float), label) for r in best]
    shared.unpersist()
    return taught


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", label_col: str = "quality", sample_rows: int = 8000, sure: int = SURE, rounds: int = ROUNDS, least: float = 0.5) -> DataFrame:
    """One row a document: id, score, text_score, meta_score (calibrated probabilities), kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    id_type = dict(docs.dtypes)[id_col]
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(chars_col).cast("long").alias("chars"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("x"))

    def features(batches):
        for batch in batches:
            for row, data, ends in text_slices(batch.column(1)):
                part = batch.slice(row, len(ends))
                a, b = text_features(data, ends), meta_features(*(part.column(k).to_pylist() for k in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), *(pa.array([x.tobytes() for x in v.astype("f4")], pa.binary()) for v in (a, b))], names=["id", "x", "a", "b"])

    table = scratch.stage(rows.mapInArrow(features, f"id {id_type}, x long, a binary, b binary"), "quality-features", compression="zstd")
    marks = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("double").alias("y")).where("lid is not null and y is not null").groupBy("lid").agg(F.avg("y").alias("y"))
    marks = scratch.stage(marks, "quality-labels")
    share = min(1.0, sample_rows / max(1, marks.count()))
    some = marks.where(F.pmod(F.xxhash64("lid"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)  # about sample_rows rows: a bounded broadcast
    known = table.join(F.broadcast(some), F.col("id") == F.col("lid")).groupBy("lid").agg(F.min(F.struct("x", "a", "b", "y")).alias("r")).select("r.a", "r.b", "r.y").collect()
    known.sort(key=lambda r: (zlib.crc32(r.a), r.a, r.b, r.y))  # an order that does not depend on tasks
    y = np.array([float(r.y >= 0.5) for r in known])
    back = kept_back(len(y))
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        flat = float((y.sum() + 1) / (len(y) + 2))
        return table.select(F.col("id").alias(id_col), *[F.lit(flat).alias(c) for c in ("score", "text_score", "meta_score")], F.lit(flat >= least).alias("kept"))
    views = [np.array([np.frombuffer(r[k], "f4") for r in known], float) for k in ("a", "b")]
    pool = table.join(maybe_broadcast(marks.select("lid"), 16 << 20), F.col("id") == F.col("lid"), "left_anti")
    models = fitted(views, y, [[], []])
    for k in range(rounds):
        models = fitted(views, y, surest(pool, models, sure * (k + 1)))
    odds = np.stack([m.odds(v[back]) for m, v in zip(models, views, strict=True)], 1)
    one = np.ones(back.sum())
    shared = spark.sparkContext.broadcast((models, Logistic(odds, y[back], one), [Logistic(odds[:, k : k + 1], y[back], one) for k in (0, 1)]))

    def score(batches):
        models_, both, each = shared.value
        squash = lambda x: pa.array(1 / (1 + np.exp(-x)))
        for batch in batches:
            found = np.stack([m.odds(_read(batch.column(k + 1))) for k, m in enumerate(models_)], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), squash(both.odds(found)), *(squash(each[k].odds(found[:, k : k + 1])) for k in (0, 1))], names=["id", "score", "text_score", "meta_score"])

    out = table.select("id", "a", "b").mapInArrow(score, f"id {id_type}, score double, text_score double, meta_score double")
    return out.withColumn("kept", F.col("score") >= least).withColumnRenamed("id", id_col)
