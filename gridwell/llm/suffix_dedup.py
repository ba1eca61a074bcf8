"""Suffix-array deduplication: every byte covered by a string of `length` bytes that also starts elsewhere is removed.

1. Anchors. Of every string of `length` bytes the 96-byte gram with the smallest hash is its anchor (winnowing:
   Schleimer et al., SIGMOD 2003), so equal strings have equal anchors at equal offsets. An anchor's region is the
   stretch of the strings that it stands for; each string starts in just one region. One row of hashes a region, no text.
2. Pre-aggregation. Regions that are equal as a whole (gram hash, and two rolling hashes mixed to 64 bits) on two places are removed
   whole. Grams with one region have no repeat. What is left are grams with several distinct regions: one copy of each.
3. Search. The texts of those regions are laid end to end in blocks of grams. A block is sorted by its first `length` bytes
   (prefix doubling), and its Burrows-Wheeler transform is searched breadth first: intervals of the strings of length l
   are extended backward by one byte; each new interval's right end that no shorter string has set yet gets the common
   prefix l. So common prefixes come out by increasing value (Beller et al., "Computing the longest common prefix array
   based on the Burrows-Wheeler transform", 2013), and the search stops at `length`: ends never set are repeats.
4. A second, shorter length may be asked for (`passage`): then anchors stand for strings of that length, regions reach as far as the long strings do, and
   the same search is read at both lengths.
5. Grams with more than HOT distinct regions would outgrow a block. Their strings are counted by 128-bit hash instead, which Spark
   combines before the shuffle; the result is the same.
6. Spans of each document are gathered (no more than its bytes / the spacing of anchors) and cut from its text.

Cases: null and empty texts, and those shorter than `length`, are kept as they are. Rows with equal id and text are
rows of their own, and repeat each other. Null ids pass through. Very long texts are one row; a task that cuts regions from one holds it whole. Ties of
anchors go to the rightmost gram. Strings are bytes: a cut may split a character (the query digests bytes; suffix_clean() shrinks
cuts to whole characters). Empty tables give empty results. Columns other than id and text are not read by suffix_repeats().
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, slices, split_by_filter
from .ngram_join import SLICE_BYTES, mix, text_slices

_U = np.uint64
_rng = np.random.default_rng(7)
_BYTE = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2)]
_BASE = [0xD1342543DE82EF95, 0xAF251AF3B0F025B5]
GRAM = 96
#: Bytes of regions in a block, about, and distinct regions of a gram that a block takes.
BLOCK_BYTES = 500_000
HOT = 4096
TASK_BYTES = 6 << 20
SEPARATOR = 0xFF  # in no UTF-8 text
HEAD_BYTES = 5


@functools.cache
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    b = _BASE[which]
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, _U(x)))]).astype(np.uint64) for x in (b, pow(b, -1, 1 << 64)))


class Rolling:
    """Hashes of any substrings of one byte array from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        self.up, self.down = _powers(1 << max(12, len(data).bit_length()), which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[which][data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of each w consecutive 32-bit values, the rightmost of equal ones: prefix and suffix minima of blocks of w."""
    n = len(values)
    packed = (values.astype(np.uint64) << _U(32)) | (_U(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    pad = np.full(-n % w, ~_U(0))
    rows = np.concatenate([packed, pad]).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[: n - w + 1], left[w - 1 : n])
    return (_U(0xFFFFFFFF) - (best & _U(0xFFFFFFFF))).astype(np.int64)


def anchors(data: np.ndarray, ends: np.ndarray, length: int, reach: int):
    """Every string of length bytes of the documents belongs to one anchor, the gram with the smallest hash in it.

    (document, anchor, first string, last string, end of the region, gram hash, region hash), places counted in data. A region reaches to the end of the
    string of reach bytes that starts last, or to the document's end.
    """
    gram = min(GRAM, length)
    w = length - gram + 1
    empty = tuple(np.zeros(0, t) for t in (np.int64,) * 5 + (np.uint64,) * 2)
    if len(data) < length:
        return empty
    r = Rolling(data, 0)
    at = np.arange(len(data) - gram + 1)
    grams = mix(r.of(at, at + gram), 11)
    best = sliding_argmin((grams >> _U(32)).astype(np.uint32), w)
    begins = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ends)), np.maximum(ends - begins - length + 1, 0))
    if not len(doc):
        return empty
    skip = np.cumsum(np.concatenate([[0], np.maximum(ends - begins - length + 1, 0)]))[:-1]
    start = np.arange(len(doc)) - skip[doc] + begins[doc]
    place = best[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    lo, hi, p = start[first], start[last], place[first]
    stop = np.minimum(hi + reach, ends[doc[first]])
    r2 = Rolling(data, 1)
    shape = mix((p - lo).astype(np.uint64) * _U(1 << 42) + (hi - lo).astype(np.uint64) * _U(1 << 21) + (stop - lo).astype(np.uint64), 12)
    region = mix(mix(r.of(lo, stop), 13) ^ r2.of(lo, stop) ^ shape, 14)
    return doc[first], p, lo, hi, stop, grams[p], region


def sorted_strings(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Circular suffixes of text in the order of their first length bytes at least, and the sorted first HEAD_BYTES bytes of each, as a number."""
    n = len(text)
    bits = _U(n.bit_length())
    place = np.arange(n, dtype=np.uint64)

    def ordered(key: np.ndarray, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
        if key_bits + int(bits) <= 64:  # sorting keys that hold their place is several times as fast
            both = np.sort((key << bits) | place)
            return (both & ((_U(1) << bits) - _U(1))).astype(np.int64), both >> bits
        order = np.argsort(key)
        return order, key[order]

    key = np.zeros(n, np.uint64)
    for j in range(HEAD_BYTES):
        key = (key << _U(8)) | np.roll(text, -j)
    order, head = ordered(key, 8 * HEAD_BYTES)
    rank, done, group, found = np.empty(n, np.uint64), HEAD_BYTES, np.zeros(n, np.uint64), head
    while True:
        group[1:] = np.cumsum(found[1:] != found[:-1], dtype=np.uint64)
        if done >= length or group[-1] == n - 1:
            return order, head
        rank[order] = group
        order, found = ordered((rank << bits) | np.roll(rank, -done), 2 * int(bits))
        done *= 2


def repeats(text: np.ndarray, lengths: tuple[int, ...], owned: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each of the lengths (HEAD_BYTES at least, in rising order): of each place of text (circular), whether that many bytes from there on start at another place,
    too. owned: for each length, the places that count."""
    n, length = len(text), lengths[-1]
    if n < 2:
        return [np.zeros(n, bool) for _ in lengths]
    order, head = sorted_strings(text, length)
    bwt = text[order - 1]
    by_byte = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int32)
    lf[by_byte] = np.arange(n, dtype=np.int32)
    # intervals are read run by run of equal bytes, of which near copies have few; for each run the next and the one before of its byte
    new = np.ones(n, bool)
    new[1:] = bwt[1:] != bwt[:-1]
    run_of = (np.cumsum(new) - 1).astype(np.int32)
    begins = np.flatnonzero(new)
    stops, byte_of, runs = np.concatenate([begins[1:], [n]]), bwt[begins], len(begins)
    order_ = np.argsort(byte_of, kind="stable")
    same = byte_of[order_[1:]] == byte_of[order_[:-1]]
    next_begin, last_stop = np.full(runs, n), np.full(runs, -1)
    next_begin[order_[:-1][same]] = begins[order_[1:][same]]
    last_stop[order_[1:][same]] = stops[order_[:-1][same]]
    # ends whose common prefix is shorter follow from the first bytes; the search goes on from those one byte shorter
    cut = np.ones(n + 1, bool)
    diff = head[1:] ^ head[:-1]
    cut[1:n] = diff != 0
    cuts = np.flatnonzero(cut)
    longest = np.concatenate([[False], (diff[cuts[1:-1] - 1] < _U(256)), [True]])
    lo, hi = cuts[:-1][longest[1:]].astype(np.int64), cuts[1:][longest[1:]].astype(np.int64)
    cuts_at = {}
    for l in range(HEAD_BYTES - 1, length - 1):  # noqa: E741
        if not len(lo):
            break
        if l + 1 in lengths:
            cuts_at[l + 1] = cut.copy()
        size = run_of[hi - 1] - run_of[lo] + 1
        of = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(of)) + (run_of[lo] - np.cumsum(size) + size)[of]
        from_, to = lo[of], hi[of]
        last = next_begin[at] >= to
        end = lf[np.minimum(stops[at[last]], to[last]) - 1].astype(np.int64) + 1
        fresh = ~cut[end]
        if not fresh.any():
            break
        byte = byte_of[at].astype(np.int64)
        first = last_stop[at] <= from_
        key_first, key_last = of[first] * 256 + byte[first], (of[last] * 256 + byte[last])[fresh]
        rank = np.argsort(key_first)
        begin = lf[np.maximum(begins[at[first]], from_[first])[rank[np.searchsorted(key_first[rank], key_last)]]]
        lo, hi = begin.astype(np.int64), end[fresh]
        cut[hi] = True
    out = []
    for k, at in enumerate(lengths):
        ends = cuts_at.get(at, cut)
        group = np.cumsum(ends[:-1]) - 1
        mask, counts = np.zeros(n, bool), np.ones(n, bool) if owned is None else owned[k]
        counts = counts[order]
        mask[order] = (np.bincount(group, counts)[group] > 1) & counts
        out.append(mask)
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def repeated_in_block(items: list[tuple], lengths: tuple[int, ...]):
    """items: (gram, region, number of strings, text). Yields (gram, region, level, from, to): strings, counted from the region's first one, that are repeats."""
    sizes = [len(x[3]) + 1 for x in items]
    text = np.frombuffer(b"".join(x[3] + bytes([SEPARATOR]) for x in items), np.uint8)
    starts = np.cumsum(sizes) - sizes
    owned = []
    for length in lengths:  # a place that lies in two regions counts in the one where it is a string's start
        step = np.zeros(len(text) + 1, np.int32)
        many = np.array([max(0, min(x[2], len(x[3]) - length + 1)) for x in items])
        np.add.at(step, starts, 1)
        np.add.at(step, starts + many, -1)
        owned.append(np.cumsum(step[:-1]) > 0)
    for level, mask in enumerate(repeats(text, lengths, owned)):
        a, b = _runs(mask)
        of = np.searchsorted(starts, a, side="right") - 1
        for k, i, j in zip(of.tolist(), (a - starts[of]).tolist(), (b - starts[of]).tolist(), strict=True):
            yield items[k][0], items[k][1], level, i, j


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("x"), text.alias("text"))


def anchor_table(docs: DataFrame, length: int, reach: int, id_col: str, text_col: str) -> DataFrame:
    """(id, x, lo, hi, stop, anchor, gram, region): arrays of each row's anchors."""
    names = ["lo", "hi", "stop", "anchor", "gram", "region"]
    kinds = [f"{c} array<{'int' if i < 4 else 'long'}>" for i, c in enumerate(names)]

    def run(batches):
        for batch in batches:
            for row, data, ends in text_slices(batch.column(2)):
                with np.errstate(over="ignore"):
                    doc, p, lo, hi, stop, gram, region = anchors(data, ends, length, reach)
                begin = np.concatenate([[0], ends[:-1]])[doc]
                starts = pa.array(np.searchsorted(doc, np.arange(len(ends) + 1)).astype(np.int32))
                cols = [(x - begin).astype(np.int32) for x in (lo, hi, stop, p)] + [x.view(np.int64) for x in (gram, region)]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(row, len(ends)) for k in (0, 1)] + [pa.ListArray.from_arrays(starts, pa.array(c)) for c in cols], names=["id", "x", *names])

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, x long, " + ", ".join(kinds))


def spans(docs: DataFrame, length: int, id_col: str, text_col: str, scratch: Scratch, passage: int | None = None, hot: int = HOT) -> DataFrame:
    """(id, x, s): of rows with repeats, s of (a, b, long): [a, b) in bytes, not merged, of the strings of length bytes (long) and of passage bytes. x is a
    hash of the text."""
    lengths = (passage, length) if passage and passage < length else (length,)
    own = Scratch(docs.sparkSession)
    table = own.stage(anchor_table(docs, lengths[0], length, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "suffix-anchors", compression="zstd")
    flat = table.select("row", F.explode(F.arrays_zip("lo", "hi", "stop", "anchor", "gram", "region")).alias("a")).select("row", "a.*")
    # grams on one place only, which are most, stay out of the shuffle of whole rows by a filter of fixed size
    often = own.stage(flat.groupBy("gram").agg(F.count("*").alias("all")).where("all > 1").select("gram"), "suffix-grams")
    likely, _ = split_by_filter(flat, "gram", bit_filter(often, "gram", own))
    regions = likely.groupBy("gram", "region").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi", "stop", "anchor")).alias("rep"))
    grams = regions.groupBy("gram").agg(F.count("*").alias("distinct"), F.sum("n").alias("all")).where("all > 1")
    multi = own.stage(regions.join(grams, "gram").select("gram", "region", "n", "distinct", "rep.*"), "suffix-regions")
    own.sweep()
    mixed = multi.where("distinct > 1")
    total = mixed.agg(F.sum(F.col("stop") - F.col("lo") + 1)).first()[0] or 0
    wanted = mixed.groupBy("row").agg(F.collect_list(F.struct("gram", "region", "lo", "hi", "stop", "anchor", (F.col("distinct") > hot).alias("hot"))).alias("wanted"))
    wanted = own.stage(table.select("row", "id", "x").join(wanted, "row").groupBy("id", "x").agg(F.flatten(F.collect_list("wanted")).alias("wanted")), "suffix-wanted")
    # texts without wanted regions stay where they are: a filter of fixed size keeps most of them out of the join's shuffle; of equal rows one is enough
    likely, _ = split_by_filter(_keyed(docs, id_col, text_col), "x", bit_filter(wanted, "x", own))
    found = likely.dropDuplicates(["id", "x"]).join(wanted.select(F.col("id").alias("wid"), F.col("x").alias("wx"), "wanted").hint("merge"), F.col("id").eqNullSafe(F.col("wid")) & (F.col("x") == F.col("wx"))).select("text", "wanted")

    def cut_out(batches):
        for batch in batches:
            for text, items in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                rows = [(w["gram"], w["region"], w["hot"], w["hi"] - w["lo"] + 1, data[w["lo"] : w["stop"]]) for w in items]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()))], names=["gram", "region", "hot", "strings", "data"])

    pieces = own.stage(found.mapInArrow(cut_out, "gram long, region long, hot boolean, strings int, data binary"), "suffix-pieces", compression="zstd")
    own.sweep()
    tasks = max(1, -(-total // TASK_BYTES))
    names, kinds = ("gram", "region", "level", "a", "b"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def search(part: pa.Table) -> pa.Table:
        items = sorted(zip(*(part.column(c).to_pylist() for c in ("gram", "region", "strings", "data")), strict=True))
        out, block, size, last = [], [], 0, None
        with np.errstate(over="ignore"):
            for item in items:
                if size > BLOCK_BYTES and item[0] != last:
                    out += repeated_in_block(block, lengths)
                    block, size = [], 0
                block.append(item)
                size, last = size + len(item[3]) + 1, item[0]
            if block:
                out += repeated_in_block(block, lengths)
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(zip(names, kinds, strict=True))})

    result = "gram long, region long, level int, a int, b int"
    cold = pieces.where("not hot").withColumn("task", F.pmod(F.xxhash64("gram"), F.lit(tasks))).select("task", "gram", "region", "strings", "data").groupBy("task").applyInArrow(search, result)

    def strings(batches):
        for batch in batches:
            for gram, region, many, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                text = np.frombuffer(data, np.uint8)
                for level, n in enumerate(lengths):
                    with np.errstate(over="ignore"):
                        at = np.arange(max(0, min(many, len(text) - n + 1)))
                        h = [mix(Rolling(text, k).of(at, at + n), 20 + k).view(np.int64) for k in (0, 1)]
                    k = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([gram] * k, pa.int64()), pa.array([region] * k, pa.int64()), pa.array([level] * k, pa.int32()), pa.array(at.astype(np.int32)), pa.array(h[0]), pa.array(h[1])], names=["gram", "region", "level", "a", "h1", "h2"])

    single = pieces.where("hot").select("gram", "region", "strings", "data").mapInArrow(strings, "gram long, region long, level int, a int, h1 long, h2 long")
    twice = single.groupBy("level", "h1", "h2").agg(F.count("*").alias("k")).where("k > 1")
    warm = single.join(twice, ["level", "h1", "h2"]).select("gram", "region", "level", "a", (F.col("a") + 1).alias("b"))
    whole = multi.where("n > 1").select("gram", "region", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.least(F.col("hi") - F.col("lo") + 1, F.col("stop") - F.col("lo") - n + 1).alias("b")) for i, n in enumerate(lengths)])).alias("w"))
    whole = whole.where("w.b > 0").select("gram", "region", "w.level", F.lit(0).alias("a"), "w.b")
    partly = cold.unionAll(warm) if mixed.where(F.col("distinct") > hot).limit(1).count() else cold
    hits = own.stage(whole.unionAll(partly).groupBy("gram", "region").agg(F.collect_list(F.struct("level", "a", "b")).alias("hits")), "suffix-hits")
    own.sweep()
    reach = lambda h: F.when(h.level == len(lengths) - 1, length).otherwise(lengths[0])
    shifted = F.transform("hits", lambda h: F.struct((F.col("lo") + h.a).alias("a"), (F.col("lo") + h.b - 1 + reach(h)).alias("b"), (h.level == len(lengths) - 1).alias("long")))
    by_row = flat.join(hits, ["gram", "region"]).select("row", shifted.alias("s")).groupBy("row").agg(F.flatten(F.collect_list("s")).alias("s"))
    out = scratch.stage(table.select("row", "id", "x").join(by_row, "row").groupBy("id", "x").agg(F.first("s").alias("s")), "suffix-spans")
    own.release()
    return out


def merged(spans_: list) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    if not spans_:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = sorted((s["a"], s["b"]) for s in spans_)
    a, b = np.array(ends, np.int64).T
    reach = np.maximum.accumulate(b)
    first = np.concatenate([[True], a[1:] > reach[:-1]])
    return a[first], reach[np.concatenate([first[1:], [True]])]


def _with_spans(docs: DataFrame, key: str, id_: str, found: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (with the text's hash as key) and s: only rows whose text may have spans go through the join."""
    likely, rest = split_by_filter(docs, key, bit_filter(found, "x", scratch))
    side = found.select(F.col("id").alias("sid"), F.col("x").alias("sx"), "s").hint("merge")
    joined = likely.join(side, F.col(id_).eqNullSafe(F.col("sid")) & (F.col(key) == F.col("sx")), "left").drop("sid", "sx")
    return joined.unionByName(rest.withColumn("s", F.lit(None).cast(found.schema["s"].dataType)))


def suffix_repeats(docs: DataFrame, *, length: int = 400, passage: int | None = None, words: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (of the removed runs, in bytes), n_passages, passage_bytes.

    With passage, n_passages counts the maximal runs that strings of passage bytes cover which also start elsewhere and that hold over words words, and
    passage_bytes their bytes; without it, they are the removed runs of over words words. They remove nothing.
    """
    scratch = Scratch(docs.sparkSession)
    found = spans(docs, length, id_col, text_col, scratch, passage, hot)
    joined = _with_spans(_keyed(docs, id_col, text_col), "x", "id", found, scratch).select("id", "text", "s")

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for text, s in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                a, b = merged([x for x in s or [] if x["long"]])
                kept = b"".join(data[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)) if len(a) else data
                told = [(i, j) for i, j in zip(*(x.tolist() for x in merged(s or [])), strict=True) if len(data[i:j].split(None, words)) > words]
                for col, v in zip(rows, (len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), a.tolist(), b.tolist(), len(told), sum(j - i for i, j in told)), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "n_passages", "passage_bytes"])

    schema = f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>, n_passages long, passage_bytes long"
    return scratch.stage(joined.mapInArrow(run, schema), "suffix-results").withColumnRenamed("id", id_col)


def suffix_clean(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs, all columns, with the repeats cut from the text. Cuts shrink to whole characters; rows without repeats stay as they are."""
    scratch = Scratch(docs.sparkSession)
    found = spans(docs, length, id_col, text_col, scratch, hot=hot)
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{names.index(text_col)}")
    keyed = inner.withColumn("x", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    joined = _with_spans(keyed, "x", f"c{names.index(id_col)}", found, scratch).select(*inner.columns, "s")
    k = names.index(text_col)

    def cut(text: pa.Scalar, s: list) -> str:
        data = text.as_buffer().to_pybytes()
        a, b = merged(s)
        inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
        kept, at = [], 0
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            while inside(i):
                i += 1
            while inside(j):
                j -= 1
            kept.append(data[at:i])
            at = max(i, j)
        return b"".join([*kept, data[at:]]).decode()

    def run(batches):
        for batch in batches:
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(k)]
            for a, b in slices(sizes, SLICE_BYTES):  # few texts at a time, whatever the batch
                part = batch.slice(a, b - a)
                cols = [part.column(i) for i in range(len(names))]
                cols[k] = pa.array([cut(t, s) if s else t.as_py() for t, s in zip(part.column(k), part.column(len(names)).to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(names))])

    return joined.mapInArrow(run, inner.schema).toDF(*names)
