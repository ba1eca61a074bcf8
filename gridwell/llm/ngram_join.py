"""N-gram Jaccard join by T-occurrence search (DivideSkip), for connected groups of near copies.

A document's set holds 64-bit hashes of its distinct word n-grams. Documents with equal sets (128-bit set hash) are one class, and all
later steps see each class once, however many copies it has.

1. Order. Tasks count grams by Misra-Gries summaries, which Spark sums: grams with a share of about 1 / HEAVY of all or more, at most HEAVY of them,
   are known as heavy. The others fall on SLOTS counters, which are summed, too: a counter's level tells common grams from rare ones by far smaller shares,
   as what falls on it by chance grows with the input, but differs between counters by its square root only. Sets are ordered by (heavy count, level,
   hash), so common passages, lines and phrases come last, and few keys have long lists, whatever the size of the input.
2. Candidates. Two sets of n and m elements with Jaccard >= t share one of their first n - ceil(tn) + 1 and m - ceil(tm) + 1 elements in any common
   order. Each class emits these as keys. Keys of one class are of no use; each other key has a list of classes.
3. Clusters. Each class has a bitmap of its elements' parity (0.4 to 0.8 bits an element for Jaccard 0.9, 0.9 to 1.8 for 0.8; the bits in which two
   bitmaps differ are never more than the elements in which the sets differ). Within a list, classes link if sizes and bitmaps allow the similarity. Lists over
   LIST classes are not gathered: each member links the list's smallest one. Both say yes to every true link, so groups of near copies lie within clusters,
   the links' components; and as bitmaps say yes to little else, most clusters are such groups. Each class's longest list is compared first; of the other
   lists, which say much the same, only those go on whose members are not connected by then.
4. Search. Clusters are dealt to units of about BLOCK_BYTES of sets. In each unit an inverted index is searched with every class, in order of size, for
   smaller classes that it is not connected with yet. By the T-occurrence bound the longest lists are set aside; the short ones are merged on a heap that
   skips, and what occurs often enough there is binary-probed in the long ones (DivideSkip). Links are spanning edges; no pairs are emitted.
5. A cluster of several units has its smallest class in each of them, so most of it is one component now. Only classes outside its largest component
   are searched for once more, in its other units.
6. Components of the links give each document its component: its smallest id.

Hot keys: every grouping by key or class combines before its shuffle. No step takes all members of a key, class or cluster in one task.

Cases: a null or wordless text has the empty set (n_shingles 0) and stands alone. A text of fewer words than n is one
n-gram. A null id gets its class's or component's smallest id, null if all are null. Repeated rows share a class. Very long texts have long sets; a set larger
than a unit is a unit's only one, with what it is searched in. Ties: of equal sizes, the order in a unit decides who searches whom, not the links. An empty
table gives an empty result. Columns other than the id and the text are not read. Results are exact but for collisions of 64-bit hashes of words and
grams, which are not structured (xxh3).
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, connected_components, maybe_broadcast, slices, split_by_filter

#: Bytes of text that a worker handles at a time: its arrays take some hundred times that.
SLICE_BYTES = 1 << 19
#: Entries of a summary of frequent grams, and the least count that a task reports.
HEAVY, HEAVY_COUNT = 1 << 17, 8
#: Counters of grams, of which a row of the table of signatures holds CHUNK, and levels that a doubling of a count makes.
SLOTS, CHUNK, LEVELS = 1 << 20, 1 << 12, 64
#: Members of a key's list that are compared by bitmap.
LIST = 1000
#: Bytes of sets in a unit, and of sets or bitmaps that a task takes, about.
BLOCK_BYTES = 2 << 20
TASK_BYTES = 8 << 20
#: DivideSkip's constant: how many lists count as long.
MU = 0.01

_U = np.uint64
_rng = np.random.default_rng(20240607)
_STEP = [_U(int(x) * 2 + 1) for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64) // 2]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: multiply and shift."""
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word of the UTF-8 bytes of documents laid end to end; ends are the documents' ends. bytes.lower() and
    bytes.split() know ASCII only."""
    text, begin, words = data.tobytes().lower(), 0, []
    for end in ends.tolist():
        words.append(text[begin:end].split())
        begin = end
    count = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(count.sum())), np.repeat(np.arange(len(ends)), count)


def gram_sets(data: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each document, one after another; where each document's begin, with the end)."""
    docs = len(ends)
    words, of = word_hashes(data, ends)
    count = np.bincount(of, minlength=docs)
    first = np.cumsum(count) - count
    starts = np.flatnonzero(np.arange(len(words)) <= (first + np.maximum(count - n, 0))[of]) if len(words) else np.zeros(0, np.int64)
    doc = of[starts]
    grams = np.zeros(len(starts), np.uint64)
    whole = (count >= n)[doc]
    for j in range(n):
        has = whole | (count[doc] > j)
        if has.all():
            grams += words[starts + j] * _STEP[j]
        else:
            grams[has] += words[starts[has] + j] * _STEP[j]
    grams = mix(grams, 1)
    bounds = np.searchsorted(doc, np.arange(docs + 1)).tolist()
    for a, b in zip(bounds, bounds[1:]):
        grams[a:b].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[keep], np.searchsorted(doc[keep], np.arange(docs + 1))


def bits_needed(num: int, den: int) -> float:
    """Bits an element, 2 at most, with which the bitmaps of unrelated sets, which differ in half of their bits, differ in twice as many as those of sets with
    Jaccard num / den may."""
    return min(2, 8 * (den - num) / (den + num))


def parities(grams: np.ndarray, at: np.ndarray, per: float = 2) -> list[bytes]:
    """Of each set a bitmap: bit k tells whether an odd number of its elements fall on k. Its bits are a power of two, 64 at least and per an element."""
    spread, out = mix(grams, 2), []
    for a, b in zip(at.tolist(), at.tolist()[1:]):
        bits = max(64, 1 << max(0, math.ceil(per * (b - a)) - 1).bit_length())
        odd = np.bincount((spread[a:b] & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each) of fewer words: what falls together is added modulo 2."""
    while rows.shape[-1] > words:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def possible_links(size: np.ndarray, bitmaps: list[bytes], num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the graph that links sets whose sizes and bitmaps allow Jaccard >= num / den; sets of equal known are connected already."""
    known = np.arange(len(size)) if known is None else known
    width = np.array([len(b) // 8 for b in bitmaps])
    rows = {int(w): np.stack([np.frombuffer(bitmaps[i], np.uint64) for i in np.flatnonzero(width == w)]) for w in np.unique(width)}
    left = {w: np.flatnonzero(width == w) for w in rows}
    place = np.zeros(len(size), np.int64)
    for at in left.values():
        place[at] = np.arange(len(at))
    cache: dict = {}
    open_, edges = np.ones(len(size), bool), []
    for root in range(len(size)):
        if not open_[root]:
            continue
        open_[root], queue = False, [root]
        while queue:
            x = queue.pop()
            w, n = int(width[x]), size[x]
            same = np.flatnonzero(open_ & (known == known[x]))
            open_[same] = False
            queue += same.tolist()
            for v, at in left.items():
                at = left[v] = at[open_[at]]
                if not len(at):
                    continue
                at = at[(den * np.minimum(size[at], n) >= num * np.maximum(size[at], n))]
                if not len(at):
                    continue
                low = min(v, w)
                if (v, low) not in cache:
                    cache[v, low] = folded(rows[v], low)
                apart = np.bitwise_count(cache[v, low][place[at]] ^ folded(rows[w][place[x]], low)).sum(1, dtype=np.int64)
                near = at[apart * (den + num) <= (den - num) * (size[at] + n)]
                open_[near] = False
                edges += [(x, y) for y in near.tolist()]
                queue += near.tolist()
    return edges


class Frequent:
    """A Misra-Gries summary: counts of at most size values, each too low by at most a share of 1 / size of all that was counted."""

    def __init__(self, size: int = HEAVY):
        self.size, self.values, self.counts, self.waiting, self.held, self.total = size, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.held += len(values)
        if self.held >= 4 * self.size:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        new, times = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.total += self.held
        self.waiting, self.held = [], 0
        values, back = np.unique(np.concatenate([self.values, new]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([self.counts, times])).astype(np.int64)
        if len(values) > self.size:
            counts -= np.partition(counts, len(counts) - self.size - 1)[len(counts) - self.size - 1]
            values, counts = values[counts > 0], counts[counts > 0]
        self.values, self.counts = values, counts

    def often(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        keep = self.counts >= max(least, self.total // self.size)
        return self.values[keep], self.counts[keep]


class Counters:
    """Counts of values by counter: SLOTS of them, whatever is counted."""

    def __init__(self):
        self.counts = np.zeros(SLOTS, np.int32)

    def add(self, values: np.ndarray) -> None:
        np.add.at(self.counts, (values & _U(SLOTS - 1)).view(np.int64), np.int32(1))

    def chunks(self):
        """(number, bytes) of runs of CHUNK counts that are not all 0."""
        for k in range(0, SLOTS, CHUNK):
            if (part := self.counts[k : k + CHUNK]).any():
                yield k // CHUNK, part.tobytes()


def prefixes(grams: np.ndarray, at: np.ndarray, num: int, den: int, heavy: tuple[np.ndarray, np.ndarray], levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, document): the first n - ceil(tn) + 1 elements of each set, heavy ones last, the more frequent the later; the others by their counters' levels."""
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    if len(grams) and (len(heavy[0]) or levels is not None):
        weight = np.zeros(len(grams), np.int64) if levels is None else levels[grams & _U(SLOTS - 1)].astype(np.int64)
        if len(heavy[0]):
            slot = np.minimum(np.searchsorted(heavy[0], grams), len(heavy[0]) - 1)
            weight = np.where(heavy[0][slot] == grams, heavy[1][slot] + (1 << 16), weight)
        # grams are in order within a document, so that equal weights leave them ordered by hash
        grams = grams[np.lexsort((weight, doc))]
    length = np.where(size > 0, size - -(-num * size // den) + 1, 0)
    use = np.arange(len(grams)) < (at[:-1] + length)[doc]
    return grams[use], doc[use]


def text_slices(column: pa.Array):
    """(first row, UTF-8 bytes, ends) of runs of rows of a string column; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = column.type == pa.large_string()
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and len(buf) else np.zeros(0, np.uint8)
    for a, b in slices(np.diff(offsets).tolist(), SLICE_BYTES):
        yield a, data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def set_hashes(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(at)
    full = np.flatnonzero(size)
    h1, h2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    if len(full):
        h1[full], h2[full] = (np.add.reduceat(mix(grams, s), at[full]) for s in (5, 6))
    return h1, h2


def _sets_of(column: pa.Array, n: int):
    """(first row, grams, their begins, set hashes) of runs of rows of a string column."""
    for row, data, ends in text_slices(column):
        with np.errstate(over="ignore"):
            grams, at = gram_sets(data, ends, n)
            yield row, grams, at, *set_hashes(grams, at)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("x"), text.alias("text"))


def signatures(docs: DataFrame, n: int, per: float, id_col: str, text_col: str) -> DataFrame:
    """(id, x, n, h1, h2, parity) of each row: hash of the text, set size, 128-bit set hash and bitmap (per bits an element). Each task's last rows have the frequent grams instead (gram and count), then
    the counters (chunk and, as parity, its counts)."""
    schema = f"id {dict(docs.dtypes)[id_col]}, x long, n long, h1 long, h2 long, parity binary, gram long, times long, chunk int"
    names = ["id", "x", "n", "h1", "h2", "parity", "gram", "times", "chunk"]

    def run(batches):
        frequent, counters, id_type = Frequent(), Counters(), None
        for batch in batches:
            id_type = batch.column(0).type
            for row, grams, at, h1, h2 in _sets_of(batch.column(2), n):
                frequent.add(grams)
                counters.add(grams)
                size = np.diff(at)
                with np.errstate(over="ignore"):
                    bits = parities(grams, at, per)
                none = pa.nulls(len(size), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, len(size)) for k in (0, 1)), pa.array(size), _signed(h1), _signed(h2), pa.array(bits, pa.binary()), none, none, none.cast(pa.int32())], names=names)
        values, counts = frequent.often(HEAVY_COUNT)
        if len(values):
            none = pa.nulls(len(values), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(values), id_type), none, none, none, none, pa.nulls(len(values), pa.binary()), _signed(values), pa.array(counts), none.cast(pa.int32())], names=names)
        none = pa.nulls(1, pa.int64())
        for number, data in counters.chunks():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), none, none, none, none, pa.array([data], pa.binary()), none, none, pa.array([number], pa.int32())], names=names)

    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def heavy_grams(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of (gram, times), HEAVY at most, sorted by gram. The least count that they have follows from a histogram."""
    summed = counts.groupBy("gram").agg(F.sum("times").alias("times"))
    levels = summed.groupBy(F.floor(F.log2("times") * 16).alias("level")).agg(F.count("*").alias("k"), F.min("times").alias("least")).orderBy(F.desc("level")).collect()
    taken, least = 0, None
    for r in levels:
        taken += r.k
        if taken > HEAVY:
            break
        least = r.least
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = summed.where(F.col("times") >= least).toArrow()
    grams = found.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], found.column("times").to_numpy()[order]


def gram_levels(chunks: DataFrame, scratch: Scratch) -> np.ndarray:
    """The levels of the sums of (chunk, counts): a number for each counter, the larger the more falls on it. Each task sums what it reads, then each chunk is summed."""

    def read(batches):
        sums: dict = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[number] = sums.get(number, 0) + np.frombuffer(data, np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(data, np.int64) for data in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk")[:1], "level": pa.array([(np.log2(total + 1) * LEVELS).astype(np.uint16).tobytes()], pa.binary())})

    levels = np.zeros(SLOTS, np.uint16)
    found = scratch.stage(chunks.mapInArrow(read, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, level binary"), "ngram-levels").toArrow()
    for number, data in zip(found.column("chunk").to_pylist(), found.column("level").to_pylist()):
        levels[number * CHUNK : (number + 1) * CHUNK] = np.frombuffer(data, np.uint16)
    return levels


def occurring(lists: list[list[int]], least: int):
    """(member, times) of members of at least least of the sorted lists, in order, by merging on a heap that skips."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield top, len(popped)
            seek = top + 1
        else:  # no member before the next top can occur often enough: skip to it
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            seek = max(heap[0][0], top + 1)
        for _, i, k in popped:
            k = bisect_left(lists[i], seek, k)
            if k < len(lists[i]):
                heapq.heappush(heap, (lists[i][k], i, k))


def similar_links(sets: list[np.ndarray], num: int, den: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the graph that links sets (sorted distinct hashes) with Jaccard >= num / den; sets of equal known are connected already."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    own = [sets[i] for i in order]
    size = np.array([len(s) for s in own])
    grams, gram_of = np.unique(np.concatenate(own), return_inverse=True)
    of = np.repeat(np.arange(len(own)), size)
    by = np.argsort(gram_of, kind="stable")
    lists, off = of[by], np.searchsorted(gram_of[by], np.arange(len(grams) + 1))
    seen = np.zeros(len(grams), np.int64)
    begin = np.cumsum(size) - size
    comp = np.arange(len(own)) if known is None else np.unique([known[i] for i in order], return_inverse=True)[1]
    edges = []

    def link(x: int, y: int) -> None:
        comp[comp == comp[y]] = comp[x]
        edges.append((order[x], order[y]))

    def needed(x: int, y: int) -> int:
        return -(-num * int(size[x] + size[y]) // (den + num))

    for x in range(len(own)):
        mine = gram_of[begin[x] : begin[x] + size[x]]
        least = -(-num * int(size[x]) // den)
        low = int(np.searchsorted(size, least))
        # the neighbours in order of size are tried first: most near copies need no search
        for y in {low, (low + x) // 2, x - 1}:
            if low <= y < x and comp[y] != comp[x]:
                at = np.searchsorted(own[y], own[x])
                if (own[y][np.minimum(at, size[y] - 1)] == own[x]).sum() >= needed(x, y):
                    link(x, y)
        if low < x and (comp[low:x] != comp[x]).any():
            # the lists of its elements, without what is too small or connected with it already
            length = seen[mine]
            flat = lists[np.repeat(off[mine] - np.cumsum(length) + length, length) + np.arange(length.sum())]
            use = (flat >= low) & (comp[flat] != comp[x])
            which = np.repeat(np.arange(len(mine)), length)[use]
            cuts = np.searchsorted(which, np.arange(len(mine) + 1)).tolist()
            flat = flat[use].tolist()
            rows = sorted((flat[a:b] for a, b in zip(cuts, cuts[1:]) if b > a), key=len)
            if len(rows) >= least:
                aside = min(least - 1, int(least / (MU * math.log2(len(rows[-1]) + 1) + 1)))
                short, long = rows[: len(rows) - aside], rows[len(rows) - aside :]
                for y, hits in occurring(short, least - aside):
                    if comp[y] == comp[x]:
                        continue
                    need = needed(x, y)
                    for k, row in enumerate(long):
                        if hits >= need or hits + len(long) - k < need:
                            break
                        p = bisect_left(row, y)
                        hits += p < len(row) and row[p] == y
                    if hits >= need:
                        link(x, y)
                        if not (comp[low:x] != comp[x]).any():
                            break
        seen[mine] += 1
    return edges


def _clusters(docs: DataFrame, sig: DataFrame, order, n: int, num: int, den: int, text_col: str, scratch: Scratch, most: int) -> DataFrame:
    """(node, component) of classes, by h1: every similar pair of classes lies within one component."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(order)

    def keys(batches):
        known: set = set()
        for batch in batches:
            for _, grams, at, h1, _ in _sets_of(batch.column(0), n):
                key, doc = prefixes(grams, at, num, den, *shared.value)
                new = np.zeros(len(h1), bool)
                for i, h in enumerate(h1.tolist()):
                    if h not in known:  # a class emits its keys once a task
                        known.add(h)
                        new[i] = True
                use = new[doc]
                yield pa.RecordBatch.from_arrays([_signed(key[use]), _signed(h1[doc[use]])], names=["key", "h1"])

    own = Scratch(spark)
    keyed = own.stage(docs.selectExpr(f"cast(`{text_col}` as string) as text").mapInArrow(keys, "key long, h1 long"), "ngram-keys")
    ends = keyed.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("greatest"), F.count("*").alias("k")).where("least <> greatest")
    ends = own.stage(ends.select("key", "least", "k"), "ngram-shared-keys")
    likely, _ = split_by_filter(keyed, "key", bit_filter(ends, "key", own))
    members = own.stage(likely.join(ends.hint("merge"), "key"), "ngram-members")
    own.release(members)
    own.sweep()
    hot = own.stage(members.where((F.col("k") > most) & (F.col("h1") != F.col("least"))).select(F.col("h1").alias("src"), F.col("least").alias("dst")), "ngram-hot")
    lists = members.where(F.col("k") <= most).groupBy("key").agg(F.array_sort(F.collect_set("h1")).alias("list")).select("list").distinct()
    lists = own.stage(lists.withColumn("number", F.monotonically_increasing_id()), "ngram-lists")
    own.release(hot, lists)
    own.sweep()
    bits = own.stage(sig.where("n > 0").groupBy("h1").agg(F.first("n").alias("n"), F.first("parity").alias("parity")), "ngram-bitmaps")
    flat = lists.select("number", F.size("list").alias("k"), F.explode("list").alias("h1"))
    longest = own.stage(flat.groupBy("h1").agg(F.max(F.struct("k", "number")).alias("m")).select(F.col("m.number").alias("number")).distinct(), "ngram-longest")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        number, h1, size, known, parity = (table.column(c) for c in ("number", "h1", "n", "known", "parity"))
        number, h1, size, known, parity = number.to_numpy(), h1.to_numpy(), size.to_numpy(), known.to_numpy(), parity.to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])).tolist()
        src, dst = [], []
        for a, b in zip(cuts, cuts[1:]):
            found = possible_links(size[a:b], parity[a:b], num, den, known[a:b])
            src += [h1[a + i] for i, _ in found]
            dst += [h1[a + j] for _, j in found]
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    def compared(members: DataFrame, name: str) -> DataFrame:
        """(src, dst) of (number, h1, known): possible links within the lists."""
        inner = Scratch(members.sparkSession)
        listed = inner.stage(members.join(bits, "h1"), name, compression="zstd")
        inner.sweep()
        tasks = max(1, -(-(listed.agg(F.sum(F.octet_length("parity") + 64)).first()[0] or 0) // TASK_BYTES))
        dealt = listed.withColumn("task", F.pmod(F.xxhash64("number"), F.lit(tasks)))
        links = own.stage(dealt.groupBy("task").applyInArrow(compare, "src long, dst long"), f"{name}-links")
        inner.release()
        inner.sweep()
        return links

    near = hot.unionAll(first := compared(flat.join(longest, "number", "left_semi").select("number", "h1", F.col("h1").alias("known")), "ngram-first"))
    found = connected_components(near, scratch)
    others = flat.join(longest, "number", "left_anti").join(found, F.col("h1") == F.col("node"), "left").select("number", "h1", F.coalesce("component", "h1").alias("known"))
    others = own.stage(others, "ngram-others")
    apart = others.groupBy("number").agg(F.min("known").alias("least"), F.max("known").alias("greatest")).where("least <> greatest").select("number")
    apart = own.stage(others.join(apart, "number", "left_semi"), "ngram-apart")
    own.release(hot, bits, first, apart)
    own.sweep()
    if not apart.isEmpty():
        found = connected_components(near.unionAll(compared(apart, "ngram-second")), scratch)
    own.release()
    own.sweep()
    return found


def _searched(units: DataFrame, num: int, den: int, tasks: int) -> DataFrame:
    """(src, dst) of (unit, node, known, grams): links found in each unit."""

    def search(table: pa.Table) -> pa.Table:
        unit: dict = {}
        for number, node, known, data in zip(*(table.column(c).to_pylist() for c in ("unit", "node", "known", "grams")), strict=True):
            unit.setdefault(number, {})[node] = (known, data)
        out = []
        for members in unit.values():
            nodes = sorted(members)
            if len(nodes) > 1:
                out += [(nodes[i], nodes[j]) for i, j in similar_links([np.frombuffer(members[k][1], np.uint64) for k in nodes], num, den, [members[k][0] for k in nodes])]
        return pa.table({"src": pa.array([x[0] for x in out], pa.int64()), "dst": pa.array([x[1] for x in out], pa.int64())})

    return units.withColumn("task", F.pmod(F.xxhash64("unit"), F.lit(tasks))).select("task", "unit", "node", "known", "grams").groupBy("task").applyInArrow(search, "src long, dst long")


def _strays_linked(placed: DataFrame, parts: DataFrame, grams: DataFrame, links: DataFrame, num: int, den: int, block_bytes: int, scratch: Scratch) -> DataFrame:
    """parts, or the components with what links classes outside their cluster's largest component have in its other units."""
    wide = placed.where("blocks > 1").join(parts, "node", "left").withColumn("known", F.coalesce("component", "node"))
    wide = scratch.stage(wide.select("node", "cluster", "blocks", "block", "known", "n"), "ngram-wide")
    groups = wide.groupBy("cluster", "known").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("known", F.struct("k", "known")).alias("main"))
    strays = wide.join(groups, "cluster").where("known <> main")
    chunks = strays.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") * 8) / block_bytes).cast("int").alias("chunks"))
    strays = scratch.stage(strays.join(chunks, "cluster").select("node", "cluster", "blocks", "known", "chunks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int").alias("chunk")), "ngram-strays")
    if not strays.isEmpty():
        number = F.xxhash64("cluster", "block", "chunk").alias("unit")
        stray_units = strays.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "known", number)
        index = wide.join(strays.groupBy("cluster").agg(F.first("chunks").alias("chunks")), "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("node", "known", number)
        again = scratch.stage(stray_units.unionAll(index).join(grams, "node").select("unit", "node", "known", "grams"), "ngram-stray-units", compression="zstd")
        more = again.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
        found = scratch.stage(_searched(again, num, den, max(1, -(-more // TASK_BYTES))), "ngram-stray-links")
        return connected_components(links.unionAll(found), scratch)
    return parts


def ngram_jaccard_groups(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, list_members: int = LIST) -> DataFrame:
    """One row a document: id, n_shingles, component_id, class_id (smallest id with an equal set)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    id_type = dict(docs.dtypes)[id_col]
    first = scratch.stage(signatures(docs, n, bits_needed(num, den), id_col, text_col), "ngram-signatures", compression="zstd")
    sig = first.where("n is not null")
    order = heavy_grams(first.where("gram is not null").select("gram", "times")), gram_levels(first.where("chunk is not null").select("chunk", F.col("parity").alias("counts")), scratch)
    clusters = _clusters(docs, sig, order, n, num, den, text_col, scratch, list_members)
    classes = scratch.stage(sig.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min(F.struct("id", "x")).alias("at"), F.first("n").alias("n")), "ngram-classes")
    cands = scratch.stage(classes.join(clusters, F.col("h1") == F.col("node")).select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "rep", "at", "n", F.col("component").alias("cluster")), "ngram-candidates")
    sizes = cands.groupBy("cluster").agg(F.count("*").alias("members"), F.ceil(F.sum(F.col("n") * 8) / block_bytes).cast("int").alias("blocks"), F.min("node").alias("leader")).where("members > 1")
    placed = cands.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = scratch.stage(placed.select("node", "h1", "h2", "rep", "at.*", "n", "cluster", "blocks", "block", (F.col("node") == F.col("leader")).alias("leads")), "ngram-placed")
    total = placed.agg(F.sum(F.col("n") * 8)).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    # a filter of fixed size keeps the texts of other documents out of the join's shuffle; a class's text is fetched once
    likely, _ = split_by_filter(_texts(docs, id_col, text_col), "x", bit_filter(placed, "x", scratch))
    wanted = placed.select("node", F.col("id").alias("wid"), F.col("x").alias("wx")).hint("merge")
    texts = likely.dropDuplicates(["id", "x"]).join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("x") == F.col("wx"))).select("text", "node")

    def sets(batches):
        for batch in batches:
            for row, grams, at, _, _ in _sets_of(batch.column(0), n):
                begins = at.tolist()
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, len(begins) - 1), pa.array([grams[i:j].tobytes() for i, j in zip(begins, begins[1:])], pa.binary())], names=["node", "grams"])

    grams = scratch.stage(texts.mapInArrow(sets, "node long, grams binary"), "ngram-sets", compression="zstd")
    scratch.sweep()
    member = placed.select("node", "cluster", "blocks", "block", "leads").join(grams, "node")
    everywhere = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    units = member.withColumn("block", F.explode(everywhere)).select(F.xxhash64("cluster", "block").alias("unit"), "node", F.col("node").alias("known"), "grams")
    links = scratch.stage(_searched(units, num, den, tasks), "ngram-links")
    scratch.sweep()
    parts = connected_components(links, scratch)

    # of clusters of several units, those outside the largest component are searched for in the other units
    if not placed.where("blocks > 1").isEmpty():
        parts = _strays_linked(placed, parts, grams, links, num, den, block_bytes, scratch)
    joined = placed.select("node", "h1", "h2", "rep").join(parts, "node")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.stage(joined.join(least, "component").select("h1", "h2", "component_id"), "ngram-components")
    # bitmaps and candidates are of no more use: the result reads the sets' hashes, classes and components
    rows = scratch.stage(sig.select("id", "n", "h1", "h2"), "ngram-rows")
    groups_ = scratch.stage(classes.join(named, ["h1", "h2"], "left").select("h1", "h2", F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id")), "ngram-groups")
    scratch.release(rows, groups_)
    out = rows.join(groups_.hint("merge"), ["h1", "h2"], "left")
    alone = lambda c: F.when(F.col("n") == 0, F.col("id")).otherwise(F.col(c)).cast(id_type).alias(c)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone("component_id"), alone("class_id"))
