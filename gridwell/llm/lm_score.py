"""Language-model scores: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Words fall into classes: each of the most frequent words is its own, all others share CLASSES by their last three bytes. The model
predicts a token's class from the two classes before it: the predicted vector is R[c1] C1 + R[c2] C2, a class scores by its dot product
with Q[class] plus a bias (Mnih and Hinton, 2007; trained as in Mnih and Teh, 2012). Within a class, words have add-one smoothed corpus
frequencies with one place for unseen words, so that the token probabilities sum to 1 over words known and unknown.

1. Counts. Tasks count words in memory, flush (word, count) and Spark sums: all training rows, no cap.
2. Head. Words of WORD_BYTES at most above a count that a histogram of counts gives, HEAD at most, are broadcast; the bound does not grow with the input.
3. Training. Every training row is used once. In each of ROUNDS, every task trains a copy of the model on its rows of that round; copies are averaged by
   their number of tokens, FAN at a time.
4. Scores. The softmax's normaliser depends on the two context classes alone; tasks work it out for all pairs by batched matrix products. One pass
   adds up each row's class log-probabilities and its head words; the words that are not in the head leave as (row, word, frequency) and meet
   their counts in a join. So every word counts, whatever the vocabulary's size.

Cases: a null or empty text is the end token alone. Very long texts and words of any length are handled like others. Ties: words of one count come in
the order of their bytes. A null id trains (its text is empty) and stays null. Repeated rows each count. An
empty table gives an empty result. With no training row, every count is 0. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

HEAD = 1 << 17
WORD_BYTES = 64
OWN = 511
CLASSES = 512
DIM = 32
ROUNDS = 3
FAN = 64
NOISE = 32
BATCH = 1 << 11
FLUSH = 200_000
#: The end token: it holds white space, as no word does.
END = b" "
C = OWN + 1 + CLASSES
BOS = C


def suffix_class(word: bytes) -> int:
    return OWN + 1 + zlib.crc32(word[-3:]) % CLASSES


def _documents(batch: pa.RecordBatch, k: int):
    """(first row, words of each document) of runs of rows: bytes.lower() and bytes.split() know ASCII only."""
    column = batch.column(k)
    texts = [t.as_buffer() if t.is_valid else b"" for t in column]
    for a, b in slices([len(t) for t in texts], 1 << 20):
        yield a, [bytes(t).lower().split() for t in texts[a:b]]


class Model:
    """Parameters R, C1, C2, Q and the bias, as one vector each; trained with Adagrad."""

    SHAPES = {"R": (C + 1, DIM), "C1": (DIM, DIM), "C2": (DIM, DIM), "Q": (C, DIM), "b": (C,)}

    def __init__(self, unigram: np.ndarray, data: bytes | None = None):
        rng = np.random.default_rng(5)
        noise = unigram**0.75
        self.noise = noise / noise.sum()
        self.p = {"R": rng.normal(0, 0.3, (C + 1, DIM)), "C1": np.eye(DIM) * 0.7, "C2": np.eye(DIM) * 0.3, "Q": rng.normal(0, 0.02, (C, DIM)), "b": np.log(unigram)}
        if data:
            flat, at = np.frombuffer(data, np.float64), 0
            for k, shape in self.SHAPES.items():
                n = int(np.prod(shape))
                self.p[k] = flat[at : at + n].reshape(shape).copy()
                at += n
        self.square = {k: np.full(v.shape, 1e-2) for k, v in self.p.items()}
        self.cumulative = np.cumsum(self.noise)
        self.rng = np.random.default_rng(11)

    def dump(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES]).tobytes()

    @staticmethod
    def _sum(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Rows added up by at."""
        return np.bincount((at[:, None] * DIM + np.arange(DIM)).ravel(), rows.ravel(), n * DIM).reshape(n, DIM)

    def step(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray, rate: float = 0.1) -> None:
        """One step of noise-contrastive estimation; the noise classes are shared by the batch."""
        p, n = self.p, len(w)
        noise = np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]).clip(0, C - 1)
        hat = (p["R"] @ p["C1"])[c1] + (p["R"] @ p["C2"])[c2]
        qw, qn = p["Q"][w], p["Q"][noise]
        ln = math.log(NOISE)
        pos = np.einsum("nd,nd->n", hat, qw) + p["b"][w] - ln - np.log(self.noise[w])
        neg = hat @ qn.T + (p["b"][noise] - ln - np.log(self.noise[noise]))
        d_pos = 1 / (1 + np.exp(np.clip(pos, -40, 40))) / n
        d_neg = -1 / (1 + np.exp(-np.clip(neg, -40, 40))) / n
        d_hat = d_pos[:, None] * qw + d_neg @ qn
        by_1, by_2 = self._sum(d_hat, c1, C + 1), self._sum(d_hat, c2, C + 1)
        g = {"R": by_1 @ p["C1"].T + by_2 @ p["C2"].T, "C1": p["R"].T @ by_1, "C2": p["R"].T @ by_2, "Q": self._sum(d_pos[:, None] * hat, w, C), "b": np.bincount(w, d_pos, C)}
        np.add.at(g["Q"], noise, d_neg.T @ hat)
        np.add.at(g["b"], noise, d_neg.sum(0))
        for k, d in g.items():
            self.square[k] += d * d * n
            p[k] += rate * d * math.sqrt(n) / np.sqrt(self.square[k])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores by the class before, scores by the class two before, bias)."""
        return self.p["R"] @ self.p["C1"] @ self.p["Q"].T, self.p["R"] @ self.p["C2"] @ self.p["Q"].T, self.p["b"]


def log_normaliser(m1: np.ndarray, m2: np.ndarray, bias: np.ndarray, c: int) -> np.ndarray:
    """Of the contexts with the class c before, one for each class two before."""
    s = m2 + (m1[c] + bias)
    top = s.max(1)
    return np.log(np.exp(s - top[:, None]).sum(1)) + top


def _contexts(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two places before, BOS over a document's start. first: whether a token is its document's first."""
    c1, c2 = np.full(len(classes), BOS), np.full(len(classes), BOS)
    c1[1:] = np.where(first[1:], BOS, classes[:-1])
    c2[2:] = np.where(first[2:] | first[1:-1], BOS, classes[:-2])
    return c1, c2


class Lexicon:
    """The head: words' classes and counts, END among them."""

    def __init__(self, words: list[bytes], counts: list[int]):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        own = [i for i in order if words[i] != END][:OWN]
        rank = {i: k for k, i in enumerate(own)}
        self.index = {w: i for i, w in enumerate(words)}
        self.classes = np.array([OWN if w == END else rank.get(i, suffix_class(w)) for i, w in enumerate(words)] or [OWN], np.int64)
        self.counts = np.array(counts or [0], np.int64)

    def look_up(self, docs: list[list[bytes]]):
        """(head index or -1, class, whether first, document) of all tokens, ends included."""
        index, default = self.index.get, repeat(-1)
        ids, sizes = [], []
        end = self.index.get(END, -1)
        tail: list[bytes] = []
        for words in docs:
            got = list(map(index, words, default))
            if -1 in got:
                tail += [w for w, i in zip(words, got) if i < 0]
            got.append(end)
            ids += got
            sizes.append(len(got))
        at, size = np.array(ids, np.int64), np.array(sizes)
        doc = np.repeat(np.arange(len(docs)), size)
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        last = np.cumsum(size) - 1
        classes = self.classes[np.maximum(at, 0)]
        classes[last] = OWN
        miss = at < 0
        miss[last] = False
        classes[miss] = [suffix_class(w) for w in tail]
        return at, classes, first, doc, miss, tail, last


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, suffix class, count) of rows (text), the end of each text included."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([suffix_class(w) for w in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "k", "c"])
            counts.clear()
            return out

        for batch in batches:
            counts[END] += batch.num_rows
            for _, some in _documents(batch, 0):
                for words in some:
                    counts.update(words)
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, k int, c long").where("c > 0").groupBy("word", "k").agg(F.sum("c").alias("c"))


def average(copies: DataFrame, scratch: Scratch) -> bytes | None:
    """Weighted mean of the models of (part, weight, model), FAN at a time."""

    def mean(table: pa.Table) -> pa.Table:
        weight = np.array(table.column("weight").to_pylist(), float)
        total = sum(w * np.frombuffer(m, np.float64) for w, m in zip(weight, table.column("model").to_pylist(), strict=True))
        return pa.table({"part": table.column("part").slice(0, 1), "weight": pa.array([weight.sum()]), "model": pa.array([(total / weight.sum()).tobytes()], pa.binary())})

    while (n := copies.count()) > FAN:
        copies = scratch.stage(copies.withColumn("g", F.pmod("part", F.lit(-(-n // FAN)))).groupBy("g").applyInArrow(mean, "part long, weight double, model binary"), "lm-models")
    rows = copies.collect()
    if not rows:
        return None
    weight = sum(r.weight for r in rows)
    return (sum(r.weight * np.frombuffer(r.model, np.float64) for r in rows) / weight).tobytes()


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out_fold: int = 2, head: int = HEAD, rounds: int = ROUNDS, trained: list | None = None) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). trained: takes the lexicon, the model, and
    each class's tokens and words."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (key % folds == held_out_fold).alias("held_out"), key.alias("crc"))
    train = rows.where("not held_out")
    counts = scratch.stage(word_counts(train), "lm-counts")
    short = F.octet_length("word") <= WORD_BYTES
    histogram = counts.where(short).groupBy(F.floor(F.log2("c") * 16).alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()
    least, taken = 1 << 62, 0
    for r in histogram:
        taken += r.n
        if taken > head:
            break
        least = r.least
    in_head = short & (F.col("c") >= least) | (F.col("word") == F.lit(END))
    top = counts.where(in_head).select("word", "c").collect()
    lexicon = Lexicon([bytes(r.word) for r in top], [r.c for r in top])
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    n_all, v_all = totals[0] or 0, totals[1]
    own = spark.createDataFrame([(w, int(lexicon.classes[i])) for w, i in lexicon.index.items() if lexicon.classes[i] <= OWN], "word binary, own int")
    by_class = counts.join(F.broadcast(own), "word", "left").groupBy(F.coalesce("own", "k").alias("cls")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(C), np.zeros(C)
    for r in by_class:
        class_n[r.cls], class_v[r.cls] = r.n, r.v
    unigram = (class_n + 0.5) / (class_n + 0.5).sum()
    shared = spark.sparkContext.broadcast(lexicon)

    model = Model(unigram)
    for k in range(rounds):
        start = model.dump()

        def learn(batches, start=start):
            from pyspark import TaskContext

            own_, copy, held, seen = shared.value, Model(unigram, start), [], 0

            def steps(all_left: bool):
                nonlocal held
                c1, c2, w = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = len(w) if all_left else len(w) // BATCH * BATCH
                for a in range(0, whole, BATCH):
                    copy.step(c1[a : a + BATCH], c2[a : a + BATCH], w[a : a + BATCH])
                held = [(c1[whole:], c2[whole:], w[whole:])]

            for batch in batches:
                for _, some in _documents(batch, 0):
                    _, classes, first, *_ = own_.look_up(some)
                    held.append((*_contexts(classes, first), classes))
                    seen += len(classes)
                    if sum(len(x[2]) for x in held) >= BATCH:
                        steps(False)
            if held and sum(len(x[2]) for x in held):
                steps(True)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([copy.dump()], pa.binary())], names=["part", "weight", "model"])

        part = train.where(F.floor(F.col("crc") / folds) % rounds == k).select("text")
        mean = average(scratch.stage(part.mapInArrow(learn, "part long, weight double, model binary"), "lm-models"), scratch)
        model = Model(unigram, mean or start)

    if trained is not None:
        trained += [lexicon, model, class_n, class_v]
    m1, m2, bias = model.tables()
    parts = spark.sparkContext.broadcast((m1, m2, bias))

    def normalisers(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([log_normaliser(*parts.value, c).tobytes() for c in batch.column(0).to_pylist()], pa.binary())], names=["c", "z"])

    log_z = np.empty((C + 1, C + 1))  # C is a constant: 8 MB
    for r in spark.range(0, C + 1, 1, 32).selectExpr("id as c").mapInArrow(normalisers, "c long, z binary").collect():
        log_z[r.c] = np.frombuffer(r.z)
    tables = spark.sparkContext.broadcast((m1, m2, bias, log_z, np.log10(class_n + class_v + 1)))
    ln10 = math.log(10)

    def score(batches):
        own_, (m1, m2, bias, log_z, log_class) = shared.value, tables.value
        log_c = np.log10(own_.counts + 1.0)
        for batch in batches:
            for row, some in _documents(batch, 1):
                at, cls, first, doc, miss, tail, last = own_.look_up(some)
                c1, c2 = _contexts(cls, first)
                known = at >= 0
                lc = np.where(known, log_c[np.maximum(at, 0)], 0.0)
                model_part = (m1[c1, cls] + m2[c2, cls] + bias[cls] - log_z[c1, c2]) / ln10
                hashed = cls > OWN
                model_part += np.where(hashed, lc - log_class[cls], 0.0)
                n = len(some)
                per = lambda x: np.bincount(doc, x, n)
                counted: list[Counter] = [Counter() for _ in some]
                for d, w in zip(doc[miss].tolist(), tail, strict=True):
                    counted[d][w] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(2).slice(row, n), pa.array(np.bincount(doc, minlength=n)), pa.array(per(known & (log_c[np.maximum(at, 0)] > 0)).astype(np.int64)), pa.array(per(lc)), pa.array(per(model_part)),
                     pa.array([list(x) for x in counted], pa.list_(pa.binary())), pa.array([list(x.values()) for x in counted], pa.list_(pa.int64()))],
                    names=["id", "held_out", "n_tokens", "known", "base", "model", "words", "times"],
                )

    schema = f"id {dict(docs.dtypes)[id_col]}, held_out boolean, n_tokens long, known long, base double, model double, words array<binary>, times array<long>"
    scored = scratch.stage(rows.select("id", "text", "held_out").mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scores", compression="zstd")
    tail = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
    rest = tail.join(counts.where(~in_head).select("word", "c"), "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"))
    rest = scratch.stage(rest, "lm-tail")
    scratch.release(scored, rest)
    out = scored.drop("words", "times").join(rest, "row", "left").withColumn("logs", F.coalesce("logs", F.lit(0.0)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"), (F.col("model") + F.col("logs")).alias("score"),
    )
