"""Mixture-controlled packing: deficit round-robin over source queues.

1. Tokenize (one pass, no shuffle): each row's ids, and its place on its source's line of tokens within the task's
   partition, are written to the shared folder.
2. The tokens of each (partition, source) are summed - one row per partition and source, not per document - and prefix
   sums over the partitions give each source's line its global places.
3. Target proportions (mixture) name sources and their shares of all tokens; sources without a name share the rest in proportion to their tokens. With no
   mixture all do. As every id is packed, a source that runs out early leaves its share to the others, in proportion to theirs (phases). The lines
   are cut into regions of about REGION_WINDOWS windows so that each region holds what the targets ask of each source there (what the cut rounds off
   goes in as the region's starting deficit). A hot source is cut like the others: its documents spread over all regions.
4. Each region is filled window by window. At every window each source's deficit grows by its share of the window; the
   source with the largest deficit sends from the head of its queue, LEAST_PIECE ids or what its deficit allows if that is more, until the window is full. What a source
   sent too much or too little stays in its deficit for the next window.
5. The ids left at a region's end, less than a window, meet those of other regions: the rests of REGION_WINDOWS regions are a region of the next level, and
   so on. Only the last level's last ids, less than a window in the whole corpus, fill sequences of falling powers of two, which need no padding.

A region has a fixed number of tokens, so a task's memory does not grow with the input. Ids keep 2 bytes when the
vocabulary allows, else 4.

Cases: a null or empty text is a document of the end id alone. Null sources are a queue of their own, which a mixture names by None. Null and
repeated document ids pass through; each row is packed by itself. A document may lie in many sequences and regions. Very long texts are cut like others.
Ties of deficits go to the source that came first in its region. A mixture's sources that the corpus lacks are left out. An
empty table gives no pieces. Columns other than id, text and source are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _texts
from .common import Memory, Scratch, maybe_broadcast

WINDOW = 4096
REGION_WINDOWS = 128
LEAST_PIECE = 256
#: Words that a worker remembers, with half as many parts of words.
MEMO_WORDS = 800_000
#: White space to str.split() but not to the tokenizer; such texts are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f]").search


#: Words of these characters alone are lower-cased and split by _PRETOKEN just as the tokenizer does it.
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
_LETTERS = re.compile("[a-z]+").fullmatch
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+").findall


class FileTokenizer:
    """A tokenizers file. If its pre-tokenizer drops white space, words are encoded once and remembered, and so are the parts that the
    file's own pattern splits new words into; each memory is bounded. Texts are encoded whole by any other file."""

    def __init__(self, path: str, memory_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        text = self.tokenizer.to_str()
        self.plain = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in text and "Lowercase" in text
        kind = (json.loads(text).get("pre_tokenizer") or {}).get("type")
        self.spaced = self.plain or kind in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer")
        # the same model for parts that are in lower case and split already: without normaliser and pattern
        self.bare = self.tokenizer
        if self.plain:
            form = json.loads(text)
            form["normalizer"] = None
            form["pre_tokenizer"]["pretokenizers"] = [x for x in form["pre_tokenizer"]["pretokenizers"] if x["type"] != "Split"]
            self.bare = Tokenizer.from_str(json.dumps(form))
        # where the model marks a word's last token by a suffix: which tokens bear it
        suffix = (json.loads(text).get("model") or {}).get("end_of_word_suffix")
        self.last = None
        if self.plain and suffix:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.words, self.parts = Memory(memory_words), Memory(memory_words // 2)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode(self, words: list[str]) -> list[bytes]:
        """Parts by themselves, some thousands a call, as the library's results are large."""
        out, width = [], self.dtype.itemsize
        for k in range(0, len(words), 4000):
            chunk = words[k : k + 4000]
            ids, cuts = self._marked(chunk) if self.last is not None else (None, None)
            if cuts is None:
                coded = self.bare.encode(chunk, is_pretokenized=True, add_special_tokens=False)
                ids, cuts = np.array(coded.ids, self.dtype), np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(chunk) + 1))
            data, cuts = ids.tobytes(), (cuts * width).tolist()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _marked(self, chunk: list[str]):
        """(ids, cuts) by the library's faster call, which does not tell words, but their last tokens do; (None, None) if not each part has one."""
        ids = np.array(self.bare.encode_batch_fast([chunk], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])
        return (ids, cuts) if len(cuts) == len(chunk) + 1 and cuts[-1] == len(ids) else (None, None)

    def _fold(self, text: str) -> str:
        """Lower case where that is surely what the tokenizer makes of it: it saves remembering both."""
        if not self.plain or "<|" in text:
            return text
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def _learn(self, wanted: list[str]) -> None:
        split, odd, simple = [], [], []
        if self.plain:  # ASCII letters alone are one part
            simple = list(filter(_LETTERS, wanted))
            wanted = list(itertools.filterfalse(_LETTERS, wanted))
        new = set(simple)
        for word in wanted:
            if self.plain and _PLAIN(word) and "<|" not in word:
                parts = _PRETOKEN(word.lower())
                split.append((word, parts))
                new.update(parts)
            else:
                odd.append(word)
        self.words.update(zip(odd, map(self._whole, odd), strict=True))
        self.parts.full(len(new))
        new = self.parts.recall(set(itertools.filterfalse(self.parts.__contains__, new)))
        self.parts.update(zip(new, self._encode(new), strict=True))
        parts_ = self.parts
        self.words.update((word, parts_[word]) for word in simple)
        self.words.update((word, b"".join([parts_[p] for p in parts])) for word, parts in split)

    def encode(self, texts: list[str]) -> list[bytes]:
        words_ = self.words
        split = [None if not self.spaced or _ODD_SPACE(text) else self._fold(text).split() for text in texts]
        # not by difference(), which passes over all that is remembered
        wanted = set(itertools.filterfalse(words_.__contains__, set().union(*(w for w in split if w))))
        if words_.full(len(wanted)):
            wanted = set().union(*(w for w in split if w))
        self._learn(words_.recall(wanted))
        coded = words_.__getitem__
        return [self._whole(text) if words is None else b"".join(map(coded, words)) for text, words in zip(texts, split, strict=True)]


@functools.cache
def file_tokenizer(path: str, memory_words: int = MEMO_WORDS) -> FileTokenizer:
    return FileTokenizer(path, memory_words)


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str, memory_words: int = MEMO_WORDS) -> DataFrame:
    """(part, row, id, source, local_start, n, width, ids): local_start counts the source's ids before it in the partition."""
    schema = f"id {dict(docs.dtypes)[id_col]}, source string, part int, row long, local_start long, n long, width int, ids binary"

    def run(batches):
        from pyspark import TaskContext

        own, part, row = file_tokenizer(path, memory_words), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], own.dtype).tobytes(), own.dtype.itemsize
        before: dict = {}
        for batch in batches:
            done = 0
            for key, texts in _texts(batch):
                coded = [x + end for x in own.encode(texts)]
                sources = batch.column(2).slice(done, len(texts)).to_pylist()
                done += len(texts)
                starts = []
                for s, x in zip(sources, coded, strict=True):
                    starts.append(before.get(s, 0))
                    before[s] = starts[-1] + len(x) // width
                k = len(coded)
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(sources, pa.string()), pa.array([part] * k, pa.int32()), pa.array(range(row, row + k), pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // width for x in coded], pa.int64()), pa.array([width] * k, pa.int32()), pa.array(coded, pa.binary())],
                    names=["id", "source", "part", "row", "local_start", "n", "width", "ids"],
                )
                row += k

    return docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text", f"cast(`{source_col}` as string) as source").mapInArrow(run, schema)


def fill(queues: dict, deficits: dict, shares: dict, window: int, least: int, last: bool = True):
    """Deficit round-robin over one region. queues: per source a list of [document, first id, ids]; yields (document, first, ids, sequence, offset).
    What is left in the end, less than a window, fills sequences of powers of two if last; else it comes with sequence -1."""
    heads = {s: 0 for s in queues}
    left = sum(n for q in queues.values() for _, _, n in q)
    live = {s: deficits.get(s, 0.0) for s, q in queues.items() if q}
    sequence = 0
    while left >= window or left and last:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        for s in live:
            live[s] += shares[s] * size
        at = 0
        while at < size:
            s = max(live, key=live.__getitem__)
            item = queues[s][heads[s]]
            n = min(item[2], size - at, max(least, int(live[s])))
            yield item[0], item[1], n, sequence, at
            at += n
            live[s] -= n
            item[1] += n
            item[2] -= n
            if not item[2]:
                heads[s] += 1
                if heads[s] == len(queues[s]):
                    del live[s]
        left -= size
        sequence += 1
    for s in live:
        for document, first, n in queues[s][heads[s] :]:
            yield document, first, n, -1, 0


def phases(shares: dict, totals: dict) -> dict:
    """Per group of sources the pieces of its course, each (share of the corpus that was packed before, share of the group's own line packed before, slope):
    groups go out in proportion to their shares, and the shares of those that have run out fall to the others."""
    whole = sum(totals.values())
    out: dict = {g: [] for g in totals}
    done, at = dict.fromkeys(totals, 0.0), 0.0
    live = {g for g, n in totals.items() if n > 0}
    while live:
        rate = {g: shares[g] / sum(shares[x] for x in live) for g in live}
        # tokens of the corpus until the next group runs out
        step = min((totals[g] - done[g]) / rate[g] for g in live)
        ended = {g for g in live if (totals[g] - done[g]) / rate[g] <= step * (1 + 1e-12) + 1e-9}
        for g in live:
            out[g].append((at / whole, done[g] / totals[g], rate[g] * whole / totals[g]))
            done[g] = totals[g] if g in ended else done[g] + rate[g] * step
        at += step
        live -= ended
    return out


def _course(pieces: list[tuple], x: Column) -> Column:
    """Share of a line that is packed when the share x of the corpus is."""
    out = F.lit(0.0)
    for k, (x0, f0, slope) in enumerate(pieces):
        most = pieces[k + 1][1] if k + 1 < len(pieces) else 1.0
        out = F.when(x >= x0, F.least(f0 + (x - x0) * slope, F.lit(most))).otherwise(out)
    return F.when(x >= 1, F.lit(1.0)).otherwise(out)


def _moment(pieces: list[tuple], f: Column) -> Column:
    """The share of the corpus that is packed when the share f of a line is."""
    out = F.lit(0.0)
    for x0, f0, slope in pieces:
        out = F.when(f >= f0, x0 + (f - f0) / slope).otherwise(out)
    return F.least(out, F.lit(1.0))


def pack(docs: DataFrame, *, path: str, end_id: int, window: int = WINDOW, region_windows: int = REGION_WINDOWS, least: int = LEAST_PIECE, mixture: dict[str | None, float] | None = None, with_ids: bool = True, memory_words: int = MEMO_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a piece: id, start, length, doc_tokens, sequence_id, offset, sequence_length, width, source, ids_crc32, ids (binary; null without with_ids).

    memory_words bounds the words that a worker remembers: fewer take less memory and more time."""
    if mixture is not None and (any(not v > 0 for v in mixture.values()) or sum(mixture.values()) > 1 + 1e-9):
        raise ValueError("a mixture has positive shares of at most 1 in all")
    scratch = Scratch(docs.sparkSession)
    tokens = scratch.stage(tokenize(docs, path, end_id, id_col, text_col, source_col, memory_words), "pack-tokens", compression="zstd")
    parts = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
    line = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lines = parts.withColumn("line_start", F.coalesce(F.sum("n").over(line), F.lit(0))).withColumn("line", F.sum("n").over(Window.partitionBy("source")))
    lines = scratch.stage(lines.select("part", F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), "line_start", "line", "n"), "pack-lines")
    counts = lines.agg(F.sum("n").alias("total"), F.count_distinct("key", "none").alias("sources")).first()
    total, regions = counts.total or 0, max(1, -(-(counts.total or 0) // (window * region_windows)))
    # groups of the course: each named source, and all others together (its number is that of the names)
    named = list(mixture or {})
    group = F.lit(len(named))
    for i, s in enumerate(named):
        group = F.when(F.col("none") if s is None else ~F.col("none") & (F.col("key") == s), i).otherwise(group)
    totals = {r.g: r.n for r in lines.groupBy(group.alias("g")).agg(F.sum("n").alias("n")).collect()}
    rest = max(0.0, 1 - sum(mixture.values())) if mixture else 1.0
    shares = {g: mixture[named[g]] if g < len(named) else rest or 1e-9 for g in totals}
    course = phases(shares, totals) if total else {}
    by_group = lambda f: reduce(lambda out, g: F.when(F.col("group") == g, f(course[g])).otherwise(out), course, F.lit(0.0))
    # region r holds places [floor(line * course(r / regions)), floor(line * course((r + 1) / regions))) of each line
    bound = lambda r: F.floor(F.col("line").cast("double") * by_group(lambda p: _course(p, r.cast("double") / regions))).cast("long")
    placed = (
        tokens.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
        .join(maybe_broadcast(lines.drop("n"), 16 << 20), ["part", "key", "none"])
        .withColumn("a", F.col("line_start") + F.col("local_start")).withColumn("b", F.col("a") + F.col("n")).withColumn("group", group)
    )
    near = lambda c: F.floor(by_group(lambda p: _moment(p, c / F.col("line"))) * regions)
    low, high = F.greatest(F.lit(0), near(F.col("a") + 1) - 2).cast("long"), F.least(F.lit(regions - 1), near(F.col("b")) + 1).cast("long")
    pieces = placed.withColumn("region", F.explode(F.sequence(low, high))).withColumn("from", bound(F.col("region"))).withColumn("to", bound(F.col("region") + 1))
    ahead = F.col("line").cast("double") * by_group(lambda p: _course(p, F.col("region").cast("double") / regions))
    pieces = (
        pieces.withColumn("p", F.greatest("a", "from")).withColumn("q", F.least("b", "to")).where("p < q")
        .select(
            "region", "id", "source", (F.col("to") - F.col("from")).cast("double").alias("share"), (ahead - F.col("from")).alias("carry"), "p", "part", "row", F.col("n").alias("doc_tokens"), (F.col("p") - F.col("a")).alias("start"),
            (F.col("q") - F.col("p")).alias("length"), "width", F.expr("substring(ids, cast(1 + width * (p - a) as int), cast(width * (q - p) as int))").alias("ids"),
        )
    )
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "width", "source", "ids_crc32", "ids", "place"]
    schema = f"id {dict(docs.dtypes)[id_col]}, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, width int, source string, ids_crc32 long, ids binary, place long"
    stride = -(-(window * region_windows + counts.sources) // window) + 64

    def filled(pieces: DataFrame, first: int, last: bool) -> DataFrame:
        """Pieces of sequences, numbered from first, and unless last those of the rests, with sequence -1; place is their region and order there."""

        def run(table: pa.Table) -> pa.Table:
            file_tokenizer.cache_clear()  # the words that this worker has remembered are of no more use
            order = pc.sort_indices(table, [(c, "ascending") for c in ("source", "p", "part", "row")]).to_numpy()
            source, share, carry = (table.column(c).to_pylist() for c in ("source", "share", "carry"))
            start, length, tokens_, width = (table.column(c).to_pylist() for c in ("start", "length", "doc_tokens", "width"))
            ids, region = table.column("ids").to_pylist(), table.column("region")[0].as_py()
            queues: dict = {}
            for k in order.tolist():
                queues.setdefault(source[k], []).append([k, 0, length[k]])
            held = {s: share[q[0][0]] or sum(n for _, _, n in q) for s, q in queues.items()}
            out = [[] for _ in names]
            sizes: dict = {}
            rows = list(fill(queues, {s: carry[q[0][0]] for s, q in queues.items()}, {s: n / sum(held.values()) for s, n in held.items()}, window, least, last))
            for _, _, n, sequence, _ in rows:
                sizes[sequence] = sizes.get(sequence, 0) + n
            for place, (k, a, n, sequence, offset) in enumerate(rows):
                w, rest_ = width[k], sequence < 0
                data = ids[k][w * a : w * (a + n)]
                full = data if w == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()
                number = -1 if rest_ else first + region * stride + sequence
                for col, v in zip(out, (k, start[k] + a, n, tokens_[k], number, offset, sizes[sequence], w, source[k], zlib.crc32(full), data if with_ids or rest_ else None, region * (1 << 20) + place), strict=True):
                    col.append(v)
            cols = [table.column("id").take(pa.array(out[0], pa.int64()))]
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
            return pa.Table.from_arrays(cols + [pa.array(v, t) for v, t in zip(out[1:], kinds, strict=True)], names=names)

        return pieces.groupBy("region").applyInArrow(run, schema)

    packed, first = [], 0
    while True:
        done = filled(pieces, first, regions == 1)
        if regions == 1:
            packed.append(done)
            break
        done = scratch.stage(done, "pack-level", compression="zstd")
        packed.append(done.where("sequence_id >= 0"))
        first, regions = first + regions * stride, -(-regions // region_windows)
        pieces = done.where("sequence_id < 0").select(
            F.floor(F.col("place") / (region_windows << 20)).cast("long").alias("region"), "id", "source", F.lit(0.0).alias("share"), F.lit(0.0).alias("carry"), F.col("place").alias("p"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("row"), "doc_tokens", "start", "length", "width", "ids",
        )
    return reduce(DataFrame.unionAll, packed).drop("place").withColumnRenamed("id", id_col)
