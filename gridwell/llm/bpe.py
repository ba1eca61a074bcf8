"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (token bytes and rank a line) becomes a tokenizers BPE model: each byte is mapped to a printable character,
and each pair of tokens whose bytes join to a third one is a merge at the third one's rank. Words are encoded once a
worker and remembered, as a text splits safely before each space that follows a character other than white space (no match
of the pattern runs over such a place). The memory of words is bounded (common.Memory).

Ranks and merges differ in one thing: of several pairs that join to one token, ranks merge the leftmost first, while a merge list has an order of its own
among them. Such a tie needs a token of three bytes or more at two places of a word, so words in which no three bytes occur twice are the
library's; the others are split by the library and merged here, by rank and place (merge_by_rank).

Decoding reverses the byte table: each token's characters become its bytes, and the bytes are joined; tokens that split a character need nothing
further, as characters are only formed from the joined bytes. offsets() gives each token's place in characters.

No row leaves its partition: there is no shuffle, and lost tasks are run anew from the input.

Cases: a null or empty text has no ids and decodes to no bytes. Null and repeated document ids pass through. Very long
texts are one row each. A text may hold the strings of special tokens; they are ordinary text. Ties: see above. Columns other than the id
and the text are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memory, slices

MEMO_WORDS = 300_000
#: Characters of text that are handled at a time.
SLICE_CHARS = 1 << 20
_SAFE = re.compile(r"(?<!\s) ")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def rank_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A tokenizers model that merges like the rank table."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    name = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        halves = [(token[:i], token[i:]) for i in range(1, len(token))]
        merges += sorted(((rank, ranks[a], ranks[b], name[a], name[b]) for a, b in halves if a in ranks and b in ranks))
    tok = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=[m[3:] for m in merges], ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: of all neighbours, those whose join has the smallest rank merge, the leftmost first, until no join is a token."""
    n = len(piece)
    stop, before = list(range(1, n + 1)), list(range(-1, n))
    whole = [True] * n

    def pair(i: int):
        """The join of the parts that start at i and after it."""
        j = stop[i]
        if j < n and (rank := ranks.get(piece[i : stop[j]])) is not None:
            yield rank, i, stop[j]

    heap = [x for i in range(n) for x in pair(i)]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not whole[i] or (j := stop[i]) >= n or stop[j] != end:
            continue
        whole[j], stop[i] = False, end
        before[end] = i
        for k in (i, before[i]):
            if k >= 0:
                for x in pair(k):
                    heapq.heappush(heap, x)
    return [ranks[piece[i : stop[i]]] for i in range(n) if whole[i]]


#: Words of more bytes are taken to have three bytes twice.
LONG_WORD = 1 << 12


def may_tie(word: bytes) -> bool:
    """Whether some three bytes occur twice."""
    return len(word) > 3 and (len(word) > LONG_WORD or len({word[i : i + 3] for i in range(len(word) - 2)}) < len(word) - 2)


class ByteCodec:
    """Encodes and decodes by one rank file. Ids are kept as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokenizer = rank_tokenizer(self.ranks, pattern)
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for name, rank in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[rank] = self._raw(name)
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.memo = Memory(MEMO_WORDS)

    def _raw(self, name: str) -> bytes:
        return bytes(map(self.byte_of.__getitem__, name))

    def _tied(self, word: str) -> list[int]:
        ids = []
        for name, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word):
            piece = self._raw(name)
            ids += [self.ranks[piece]] if piece in self.ranks else merge_by_rank(piece, self.ranks)
        return ids

    def _encode(self, words: list[str]) -> list[bytes]:
        """Words by themselves, some thousands a call, as the library's results are large."""
        out = []
        for k in range(0, len(words), 4000):
            chunk = words[k : k + 4000]
            tied = [may_tie(w.encode()) for w in chunk]
            coded = self.tokenizer.encode(["" if t else w for w, t in zip(chunk, tied, strict=True)], is_pretokenized=True, add_special_tokens=False)
            data = np.array(coded.ids, "<u4").tobytes()
            cuts = np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(chunk) + 1)).tolist()
            for word, t, a, b in zip(chunk, tied, cuts, cuts[1:]):
                out.append(np.array(self._tied(word), "<u4").tobytes() if t else data[4 * a : 4 * b])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """A bytes object of ids a text."""
        memo = self.memo
        split = [text.split(" ") for text in texts]
        for i, words in enumerate(split):
            if not all(words) or any(map(str.isspace, [w[-1] for w in words])):
                words = _SAFE.split(texts[i])
            split[i] = words
        heads = self._encode([words[0] for words in split])
        wanted = set().union(*(words[1:] for words in split)).difference(memo)
        if memo.full(len(wanted)):
            wanted = set().union(*(words[1:] for words in split))
        wanted = memo.recall(wanted)
        memo.update(zip(wanted, self._encode([" " + w for w in wanted]), strict=True))
        return [head + b"".join([memo[w] for w in words[1:]]) for head, words in zip(heads, split, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """(start of each token, its end, how many tokens begin or end inside a character), in characters; a token that holds a part of a character counts
        it whole."""
        raw = np.frombuffer(self.decode(ids), np.uint8)
        ends = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])
        starts = np.concatenate([ends[:0], [0], ends[:-1]])[: len(ends)]
        if not len(raw) or raw.max() < 128:
            return starts, ends, 0
        inside = np.concatenate([(raw & 0xC0) == 0x80, [False]])
        lead = np.concatenate([[0], np.cumsum(~inside[:-1])])
        return lead[starts + 1] - 1, lead[ends], int((inside[starts] | inside[ends]).sum())


@functools.cache
def codec(path: str, pattern: str) -> ByteCodec:
    return ByteCodec(path, pattern)


def _texts(batch: pa.RecordBatch):
    """(ids, texts) of runs of rows of a batch; null texts are empty."""
    ids, texts = batch.column(0), batch.column(1)
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
    for a, b in slices(sizes, SLICE_CHARS):
        yield ids.slice(a, b - a), [t or "" for t in texts.slice(a, b - a).to_pylist()]


def encode(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """id, n_tokens, ids (binary, little-endian unsigned 32-bit), and with with_offsets starts and ends in characters."""
    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids binary" + (", starts array<int>, ends array<int>" if with_offsets else "")

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for key, texts in _texts(batch):
                coded = own.encode(texts)
                cols = [key, pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(coded, pa.binary())]
                if with_offsets:
                    at = [own.offsets(x) for x in coded]
                    cols += [pa.array([x[k].tolist() for x in at], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids", "starts", "ends"][: len(cols)])

    return docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and data: the decoded bytes of ids."""
    schema = f"id {dict(coded.dtypes)[id_col]}, data binary"

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else own.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "data"])

    return coded.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, n_split (tokens that begin or end inside a character) and offsets_sha256 (of all starts, then all ends, as
    ids are): encode and decode in one pass, without sending the ids between processes."""
    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, offsets_sha256 string"

    def run(batches):
        own = codec(path, pattern)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for key, texts in _texts(batch):
                coded = own.encode(texts)
                at = [own.offsets(x) for x in coded]
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([digest(x) for x in coded]), pa.array([digest(own.decode(x)) for x in coded]),
                     pa.array([x[2] for x in at], pa.int64()), pa.array([digest(x[0].astype("<u4").tobytes() + x[1].astype("<u4").tobytes()) for x in at])],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "offsets_sha256"],
                )

    return docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text").mapInArrow(run, schema).withColumnRenamed("id", id_col)
