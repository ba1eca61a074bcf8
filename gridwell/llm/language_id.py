"""Language identification by Bayesian evidence fusion.

Evidence of a document: its text (naive Bayes over hashed byte trigrams of letters), the language that its markup or record declares, the
suffix of its address, and its host.

1. Every declared language takes part, however many there are. The trigram model is fitted to a sample of rows, chosen by a hash of the id in
   each language apart: the share that makes about sample_rows rows in all, but at least about least_rows rows of the language, or all it has.
2. One pass gives every row the log-likelihood of each language. Trigrams overlap, so the sum counts as if effective of them were independent: a long text
   weighs as much as that many trigrams against the other evidence, of the share that its own trigrams have.
3. Grouped aggregations over all rows count the text's language by declared language, by suffix and by host. The host's prior is
   smoothed towards the suffix's, which is smoothed towards the whole corpus's: (n + weight * parent) / (total + weight). How often a language
   is declared as another one is estimated likewise. The counts are kept sparse. A hot host is one row after Spark's partial sums.
4. A second pass works the likelihoods out again: log posterior = text + declared given language + host prior. The counts join the rows by
   equi-joins (broadcast only if small).

The model is dense for block languages at a time. With more languages, rows are written with a key, each block yields its best language and its
share of the posterior's sum a row, and these are combined by key; so memory does not grow with the number of languages.

A row is rejected when its text has no letters or its best language's posterior is under least.

Cases: null and empty texts have flat likelihoods and are rejected. Null or unknown declared languages say nothing. Null hosts and
suffixes take the parent's prior. Null and repeated ids pass through. Ties go to the first language in alphabetical order. An empty table
gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, staged
from .ngram_join import text_slices

BUCKETS = 1 << 14
EFFECTIVE = 40
#: Languages whose model a worker holds at a time: 32 MB at most.
BLOCK = 256
#: From so many languages on, a document's trigrams are counted before they meet the model.
WIDE = 16
#: Letters stay, in lower case; anything else is a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of the trigrams with a letter in the middle."""
    x = _FOLD[data]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (x[:-2].astype(np.uint32) << 16) | (x[1:-1].astype(np.uint32) << 8) | x[2:]
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    use = (x[1:-1] != 32) & (doc[:-2] == doc[2:])
    code = code[use] * np.uint32(2654435761)
    return (code >> np.uint32(18)).astype(np.int64), doc[:-2][use]


def likelihoods(data: np.ndarray, ends: np.ndarray, model: np.ndarray, effective: float = EFFECTIVE) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams a document, log-likelihoods as documents x languages); model is log probabilities as buckets x languages."""
    bucket, doc = trigrams(data, ends)
    n = np.bincount(doc, minlength=len(ends))
    if model.shape[1] <= WIDE:
        sums = np.stack([np.bincount(doc, model[bucket, k], len(ends)) for k in range(model.shape[1])], 1)
    else:
        pair, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
        at = np.searchsorted(pair, np.arange(len(ends) + 1) * BUCKETS)
        sums = np.stack([times[i:j] @ model[pair[i:j] % BUCKETS] for i, j in zip(at[:-1], at[1:], strict=True)])
    return n, sums * (np.minimum(n, effective) / np.maximum(n, 1))[:, None]


def _spread(column: pa.Array, first: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, language, count) of lists of (language, count), for the block's languages, which start at first."""
    rows = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    inner = column.flatten()
    lang = inner.field("language").to_numpy(zero_copy_only=False) - first
    use = (lang >= 0) & (lang < width)
    return rows[use], lang[use], inner.field("count").to_numpy(zero_copy_only=False)[use].astype(float)


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str | None = "source", suffix_col: str | None = None, sample_rows: int = 20_000, least_rows: int = 200, least: float = 0.5, weight: float = 20.0, effective: float = EFFECTIVE, block: int = BLOCK) -> DataFrame:
    """One row a document: id, language, confidence, text_language, n_trigrams, rejected."""
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    name = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).alias("id"), name(text_col).alias("text"), name(declared_col).alias("declared"), name(host_col).alias("host"), name(suffix_col).alias("suffix"))
    total = rows.count()
    # a row is in the sample if its slot is under its language's limit; the smallest slot always is
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    share = F.least(F.lit(1.0), F.greatest(F.lit(sample_rows / max(total, 1)), F.lit(float(least_rows)) / F.count("*")))
    known = rows.where("declared <> ''").groupBy("declared").agg(F.greatest(F.floor(share * (1 << 20)) + 1, F.min(slot) + 1).alias("limit"))
    known = staged(known, "language-names")
    languages = sorted(r.declared for r in known.select("declared").collect()) or ["und"]
    k = len(languages)
    number = {x: i for i, x in enumerate(languages)}
    numbers = spark.sparkContext.broadcast(number)
    blocks = [(i, min(i + block, k)) for i in range(0, k, block)]
    if len(blocks) > 1:
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "language-rows", compression="zstd")
    limits = maybe_broadcast(known, 8 << 20)
    chosen = rows.join(limits, "declared").where(slot < F.col("limit"))

    def count(batches):
        for batch in batches:
            lang = np.array([numbers.value[x] for x in batch.column(1).to_pylist()], np.int64)
            for row, data, ends in text_slices(batch.column(0)):
                bucket, doc = trigrams(data, ends)
                pair, times = np.unique(lang[row + doc] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((pair // BUCKETS).astype(np.int32)), pa.array((pair % BUCKETS).astype(np.int32)), pa.array(times.astype(np.int64))], names=["l", "b", "n"])

    fitted = staged(chosen.select("text", "declared").mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")), "language-trigrams")
    models = []
    for first, stop in blocks:
        found = fitted.where((F.col("l") >= first) & (F.col("l") < stop)).toArrow()
        table = np.full((stop - first, BUCKETS), 0.5)
        table[found.column("l").to_numpy() - first, found.column("b").to_numpy()] += found.column("n").to_numpy()
        models.append(spark.sparkContext.broadcast(np.ascontiguousarray(np.log(table / table.sum(1, keepdims=True)).T)))

    def union(make):
        out = None
        for (first, _), model in zip(blocks, models, strict=True):
            out = make(first, model) if out is None else out.unionAll(make(first, model))
        return out

    def best_of(first, model):
        def run(batches):
            for batch in batches:
                for row, data, ends in text_slices(batch.column(1)):
                    n, sums = likelihoods(data, ends, model.value, effective)
                    part = batch.slice(row, len(ends))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(n), pa.array(sums.max(1)), pa.array((sums.argmax(1) + first).astype(np.int32))], names=["row", "declared", "host", "suffix", "n", "top", "best"])

        return rows.select("row", "text", "declared", "host", "suffix").mapInArrow(run, "row long, declared string, host string, suffix string, n long, top double, best int")

    texts = union(best_of).where("n > 0")
    if len(blocks) > 1:
        texts = texts.groupBy("row").agg(F.first("declared").alias("declared"), F.first("host").alias("host"), F.first("suffix").alias("suffix"), (-F.max(F.struct("top", (-F.col("best")).alias("best")))["best"]).alias("best"))
    counted = staged(texts.groupBy("declared", "host", "suffix", "best").agg(F.count("*").alias("n")), "language-counts")
    whole = np.zeros(k)
    for r in counted.groupBy("best").agg(F.sum("n").alias("n")).collect():
        whole[r.best] = r.n
    prior = (whole + 1) / (whole.sum() + k)
    # of the texts in a language, those that declare one
    spoken = np.zeros(k)
    for r in counted.where("declared <> ''").groupBy("best").agg(F.sum("n").alias("n")).collect():
        spoken[r.best] = r.n
    shared = spark.sparkContext.broadcast((prior, spoken))

    def sparse(where: str, out: str, *keys: str) -> DataFrame:
        """keys and a list of (language, count)."""
        found = counted.where(where).groupBy(*keys, "best").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.collect_list(F.struct(F.col("best").alias("language"), F.col("n").alias("count"))).alias(out))
        return maybe_broadcast(staged(found.select(*[F.col(x).alias(f"{out}_{x}") for x in keys], out), f"language-{out}"), 8 << 20)

    joined = (
        rows.join(sparse("host is not null", "hosts", "host", "suffix"), (F.col("host") == F.col("hosts_host")) & F.col("suffix").eqNullSafe(F.col("hosts_suffix")), "left")
        .join(sparse("suffix is not null", "suffixes", "suffix"), F.col("suffix") == F.col("suffixes_suffix"), "left")
        .join(sparse("declared <> ''", "said", "declared"), F.col("declared") == F.col("said_declared"), "left")
    )
    totals = [F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x["count"]), F.lit(0).cast("long")).alias(f"{c}_n") for c in ("hosts", "suffixes")]
    joined = joined.select("row", "id", "text", "declared", "hosts", "suffixes", "said", *totals)

    def fuse(first, model):
        def run(batches):
            width = model.value.shape[1]
            prior, spoken = (x[first : first + width] for x in shared.value)
            for batch in batches:
                for row, data, ends in text_slices(batch.column(2)):
                    n, sums = likelihoods(data, ends, model.value, effective)
                    part = batch.slice(row, len(ends))
                    odds = np.tile(prior, (len(ends), 1))
                    for lists, all_ in ((part.column(5), part.column(8)), (part.column(4), part.column(7))):
                        d, lang, times = _spread(lists, first, width)
                        odds *= weight
                        odds[d, lang] += times
                        odds /= all_.to_numpy()[:, None] + weight
                    # log P(declared | language), smoothed towards telling the truth half of the time
                    told = np.array([numbers.value.get(x, -1) for x in part.column(3).to_pylist()], np.int64)
                    given = np.full((len(ends), width), weight * 0.5 / k)
                    own = np.flatnonzero((told >= first) & (told < first + width))
                    given[own, told[own] - first] += weight * 0.5
                    d, lang, times = _spread(part.column(6), first, width)
                    given[d, lang] += times
                    given = np.where((told >= 0)[:, None], np.log(given / (spoken + weight)), 0.0)
                    post = sums + np.log(odds) + given
                    top = post.max(1)
                    mass = np.exp(post - top[:, None]).sum(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(top), pa.array(mass), pa.array((post.argmax(1) + first).astype(np.int32)), pa.array(sums.max(1)), pa.array((sums.argmax(1) + first).astype(np.int32))], names=["row", "id", "n", "top", "mass", "language", "text_top", "best"])

        return joined.mapInArrow(run, f"row long, id {id_type}, n long, top double, mass double, language int, text_top double, best int")

    fused = union(fuse)
    if len(blocks) > 1:
        first_of = lambda by, what: -F.max(F.struct(by, (-F.col(what)).alias("least")))["least"]
        most = F.aggregate(F.collect_list(F.struct("top", "mass")), F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("mass")), _add_mass)
        fused = fused.groupBy("row").agg(F.first("id").alias("id"), F.first("n").alias("n"), most["mass"].alias("mass"), first_of("top", "language").alias("language"), first_of("text_top", "best").alias("best"))
    fused = staged(fused, "language-fused")
    names = spark.createDataFrame(list(enumerate(languages)), "number int, name string")
    names = maybe_broadcast(staged(names, "language-numbers"), 8 << 20)
    out = fused.join(names.toDF("language", "name"), "language").join(names.toDF("best", "text_name"), "best")
    out = out.select(F.col("id").alias(id_col), F.col("name").alias("language"), (1 / F.col("mass")).alias("confidence"), F.col("text_name").alias("text_language"), F.col("n").alias("n_trigrams"))
    return out.withColumn("rejected", (F.col("n_trigrams") == 0) | (F.col("confidence") < least))


def _add_mass(acc, x):
    """Sums of exp(value - top) under a common top."""
    top = F.greatest(acc["top"], x["top"])
    return F.struct(top.alias("top"), (acc["mass"] * F.exp(acc["top"] - top) + x["mass"] * F.exp(x["top"] - top)).alias("mass"))


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with text, declared, host and suffix taken from the address and the markup."""
    host = F.lower(F.regexp_extract(url_col, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    body = F.regexp_replace(F.regexp_replace(html_col, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html_col, r"""(?i)<html[^>]*\blang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))
    none = lambda c: F.when(c != "", c)
    return pages.withColumns({"text": body, "declared": none(declared), "host": none(host), "suffix": none(F.regexp_extract(host, r"\.([a-z]+)$", 1))})
