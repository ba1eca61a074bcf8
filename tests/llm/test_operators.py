"""Operators of the llm subpackage against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from gridwell.llm import bpe
from gridwell.llm.common import Memory, Scratch, connected_components
from gridwell.llm.embedding_dedup import embedding_groups
from gridwell.llm.exact_dedup import exact_dedup
from gridwell.llm.language_id import language_id, page_evidence
from gridwell.llm.license_scan import license_scan
from gridwell.llm.lm_score import BOS, C, OWN, Model, lm_scores, log_normaliser, suffix_class
from gridwell.llm.ngram_join import CHUNK, SLOTS, Counters, Frequent, bits_needed, gram_sets, ngram_jaccard_groups, occurring, parities, possible_links, prefixes, signatures, similar_links
from gridwell.llm.packing import FileTokenizer, fill, pack
from gridwell.llm.quality import quality_scores
from gridwell.llm.queries import language_of_pages
from gridwell.llm.suffix_dedup import repeats, suffix_clean, suffix_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, digest string, x string, s string, key string"
RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def make_rows():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, passage = say(60), say(90)
    rows = []
    add = lambda text, source="a": rows.append((len(rows), text, "en", source))
    for n in (0, 1, 2, 3, 5, 40):
        add(say(n))
    add(None)
    add("   \n ")
    for k in range(12):  # near copies of one text
        w = base.split()
        for _ in range(k % 4):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        add(" ".join(w), None if k == 3 else "hot")
    add(base.upper().replace("É", "é"))
    add(base)
    for _ in range(4):
        add(say(rnd.randint(5, 40)) + " " + passage + " " + say(rnd.randint(5, 40)), "hot")
    add("Licensed under the Apache License, Version 2.0. MIT-License mit  license CC BY cc\nby x")
    add("This work is licensed under the GNU General Public License, version 3. İ K ſ")
    add(say(9000), "hot")  # very long
    add("ab " * 900)  # periodic
    add("€😀  \x1c\x85 <|endoftext|> it's  12 \r\n\t x")
    rows.append((5, rows[5][1], "en", "a"))  # a repeated row
    rows.append((None, base, None, None))
    rows.append((None, None, None, None))
    return [(i, t, lang, s, len(t or ""), "c", "c", "c", "c", "c", "c") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    for keep in ("largest", "smallest"):
        got = exact_dedup(docs, keep=keep, rows_per_memtable=7).collect()
        groups = defaultdict(list)
        for r in rows:
            groups[lower(r[1])].append(r[0])
        assert len(got) == len(rows)
        for text, ids in groups.items():
            mine = [g for g in got if g.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
            known = [i for i in ids if i is not None]
            best = (max if keep == "largest" else min)(known) if known else None
            assert Counter(g.doc_id for g in mine) == Counter(ids)
            assert {(g.keep_id, g.group_size) for g in mine} == {(best, len(ids))}
            assert sum(g.kept for g in mine) == 1
    assert exact_dedup(empty).collect() == []


def test_license_scan(docs, rows, empty):
    got = license_scan(docs).collect()
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want = []
    for r in rows:
        w = word.findall(lower(r[1]))
        at = [(i, label) for phrase, label in base.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        want.append((r[0], len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({b for _, b in at}))))
    key = lambda x: tuple((v is None, v if v is not None else 0) if not isinstance(v, str) else (False, v) for v in x)
    assert sorted(((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got), key=key) == sorted(want, key=key)
    assert all(0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) for g in got)
    assert license_scan(empty).collect() == []


def test_license_passage_with_an_inserted_word(spark):
    text = "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software"
    got = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.labels == "mit" and got.base_labels == "" and 0.8 <= got.score < 1


@pytest.fixture(scope="module")
def exact():
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe(docs, rows, empty, exact):
    got = bpe.encode(docs, path=RANKS, pattern=P.PATTERN, with_offsets=True).collect()
    want = Counter((r[0], tuple(exact.encode_ordinary(r[1] or ""))) for r in rows)
    assert Counter((g.doc_id, tuple(np.frombuffer(g.ids, "<u4").tolist())) for g in got) == want
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1] or "")
    for g in got:
        assert g.n_tokens == len(g.starts) == len(g.ends) == len(g.ids) // 4
        if g.n_tokens:
            assert g.starts[0] == 0 and g.ends[-1] in {len(t) for t in texts[g.doc_id]}
    back = bpe.decode(bpe.encode(docs, path=RANKS, pattern=P.PATTERN), path=RANKS, pattern=P.PATTERN).collect()
    assert Counter((b.doc_id, bytes(b.data)) for b in back) == Counter((r[0], (r[1] or "").encode()) for r in rows)
    digests = bpe.round_trip(docs, path=RANKS, pattern=P.PATTERN).collect()
    u4 = lambda x: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
    want = Counter((r[0], u4(exact.encode_ordinary(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter((d.doc_id, d.ids_sha256, d.decoded_sha256) for d in digests) == want
    by_text = {d.decoded_sha256: d for d in digests}
    for r in rows:  # offsets by brute force
        data, at, starts, ends, split = (r[1] or "").encode(), 0, [], [], 0
        for i in exact.encode_ordinary(r[1] or ""):
            a, b = at, at + len(exact.decode_single_token_bytes(i))
            cut = [k for k in (a, b) if k < len(data) and data[k] & 0xC0 == 0x80]
            split += bool(cut)
            starts.append(sum(c & 0xC0 != 0x80 for c in data[: a + 1]) - 1)
            ends.append(sum(c & 0xC0 != 0x80 for c in data[:b]))
            at = b
            if len(data) > 3000:
                break
        if len(data) <= 3000:
            d = by_text[hashlib.sha256(data).hexdigest()]
            assert (d.n_split, d.offsets_sha256) == (split, u4(starts + ends))
    assert bpe.round_trip(empty, path=RANKS, pattern=P.PATTERN).collect() == []


def test_byte_bpe_splits_safely(exact):
    own = bpe.codec(RANKS, P.PATTERN)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab \n\t é😀'sll1.\x1c　") for _ in range(rnd.randrange(50))) for _ in range(1500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [exact.encode_ordinary(t) for t in texts]


def test_byte_bpe_ties(exact):
    """Runs and repeats, in which several pairs of neighbours join to one token, and a very long word."""
    own = bpe.codec(RANKS, P.PATTERN)
    rnd = random.Random(3)
    texts = [c * n for c in "a=-.tе中" for n in (*range(1, 40), 701)]
    for _ in range(3000):
        part = ["".join(rnd.choice("abcetnhисо") for _ in range(rnd.randint(1, 4))) for _ in range(3)]
        texts.append("".join(rnd.choice(part) for _ in range(rnd.randint(2, 12))))
    texts.append("".join(rnd.choice("etaoin") for _ in range(30_000)))
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [exact.encode_ordinary(t) for t in texts]


def test_word_tokenizer_is_the_library():
    own = FileTokenizer(WORDS)
    rnd = random.Random(1)
    parts = ["a", "B", " ", "\n", "é", "É", "ß", "😀", "'s", "'", "'LL", "1", "²", "!", "<|endoftext|>", "_", "İ", "é", "\x1c", "\x85", "中", "ﬁ", "Σ", "µ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_looks_words_up_without_passing_over_all_it_remembers():
    """Ids by the library's faster call, and by the one that tells words where a part has no last token, are those of whole texts."""

    class Remembered(Memory):
        def __iter__(self):
            raise AssertionError

    own = FileTokenizer(WORDS)
    own.words, own.parts = Remembered(1000), Remembered(1000)
    texts = ["Some words, some 12 numbers </w> and it's </W> caf\xe9", "some other words\x1c and 12 more"]
    whole = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, own.dtype).tobytes() for t in texts]
    assert own.encode(texts) == own.encode(texts) == whole
    assert own.last is not None and own._marked(["some", "words"])[1].tolist()[0] == 0
    own.last = np.zeros_like(own.last)
    own.words, own.parts = Memory(1000), Memory(1000)
    assert own._marked(["some"]) == (None, None) and own.encode(texts) == whole



def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    got = pack(docs, path=WORDS, end_id=2, window=256, region_windows=8, least=32).collect()
    want = Counter((r[0], *tok.encode(r[1] or "", add_special_tokens=False).ids, 2) for r in rows)
    ids = defaultdict(list)
    for g in got:
        data = np.frombuffer(g.ids, "<u2").astype("<u4")
        assert zlib.crc32(data.tobytes()) == g.ids_crc32 and len(data) == g.length
        ids[g.doc_id].append((g.start, g.length, g.doc_tokens, data.tolist()))
    for d, pieces in ids.items():
        texts = [x for x in want.elements() if x[0] == d]
        assert sum(p[1] for p in pieces) == sum(len(x) - 1 for x in texts)
        if len(texts) == 1:
            assert [i for p in sorted(pieces) for i in p[3]] == list(texts[0][1:]) and {p[2] for p in pieces} == {len(texts[0]) - 1}
    sequences = defaultdict(list)
    for g in got:
        sequences[g.sequence_id].append((g.offset, g.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0 and at < 256
    short = sorted(sum(n for _, n in parts) for parts in sequences.values() if sum(n for _, n in parts) < 256)
    assert len(short) == len(set(short)) and sum(short) == sum(g.length for g in got) % 256  # only the corpus's end
    assert pack(empty, path=WORDS, end_id=2).collect() == []


def spoken(n, source, words, first=0):
    """n documents of about words words."""
    rnd = random.Random(n)
    return [(first + i, " ".join(rnd.choice(["sun", "moon", "star", "sky"]) for _ in range(rnd.randint(words // 2, words * 3 // 2))), source) for i in range(n)]


@pytest.mark.parametrize("mixture", [None, {"a": 0.5, None: 0.2}, {"a": 0.1, "b": 0.8, "none such": 0.1}])
def test_packing_of_every_window_keeps_the_mixture(spark, mixture):
    rows = spoken(300, "a", 60) + spoken(500, "b", 40, 1000) + spoken(200, None, 50, 2000)
    random.Random(4).shuffle(rows)
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7), path=WORDS, end_id=2, window=512, region_windows=4, least=16, mixture=mixture).collect()
    have = Counter()
    for g in got:
        have[g.source] += g.length
    assert sum(have.values()) == sum(len(r[1].split()) + 1 for r in rows)
    whole = {s: n / sum(have.values()) for s, n in have.items()}
    named = {s: v for s, v in (mixture or {}).items() if s in have}
    rest = max(0.0, 1 - sum((mixture or {}).values())) if mixture else 1.0
    others = sum(whole[s] for s in have if s not in named)
    target = {s: named.get(s, max(rest, 1e-9) * whole[s] / others if s not in named else 0) for s in have}
    target = {s: v / sum(target.values()) for s, v in target.items()}
    lasts = min(have[s] / target[s] for s in have)  # ids until the first source runs out
    windows = defaultdict(Counter)
    for g in got:
        if g.sequence_length == 512:
            windows[g.sequence_id][g.source] += g.length
    stride = -(-(512 * 4 + len(have)) // 512) + 64
    first_level = [k for k in windows if (k // stride + 1) * 512 * 4 < lasts * 0.9]
    assert len(first_level) > 15
    for k in first_level:
        for s in have:
            assert abs(windows[k][s] - 512 * target[s]) <= 48, (k, s, windows[k], target)


def test_packing_keeps_the_mixture():
    queues = {"a": [[k, 0, 700] for k in range(30)], "b": [[100 + k, 0, 300] for k in range(30)]}
    share = {"a": 0.7, "b": 0.3}
    sent = Counter()
    source = {k: "a" if k < 100 else "b" for k in [*range(30), *range(100, 130)]}
    for doc, _, n, sequence, _ in fill(queues, {}, share, 1000, 50):
        sent[source[doc]] += n
        if sent.total() % 1000 == 0:
            assert abs(sent["a"] - 0.7 * sent.total()) <= 350
    assert sent == {"a": 21000, "b": 9000}


def brute_components(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check_ngram_groups(got, rows, n, num):
    word = re.compile("[^\x20\x09-\x0d]+")
    sets = []
    for r in rows:
        w = word.findall(lower(r[1]))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    part = brute_components(range(len(rows)), links)
    least = defaultdict(list)
    for i, p in part.items():
        if rows[i][0] is not None:
            least[p].append(rows[i][0])
    want = Counter((rows[i][0], len(sets[i]), min(least[p], default=None) if sets[i] else rows[i][0]) for i, p in part.items())
    assert Counter((g.doc_id, g.n_shingles, g.component_id) for g in got) == want
    return want


@pytest.mark.parametrize("n, num, block, most", [(3, 90, 2 << 20, 1000), (5, 80, 1500, 2)])
def test_ngram_groups(docs, rows, n, num, block, most):
    check_ngram_groups(ngram_jaccard_groups(docs, n=n, num=num, den=100, block_bytes=block, list_members=most).collect(), rows, n, num)


def test_ngram_groups_of_one_large_cluster(spark):
    """A chain and a crowd of near copies in one cluster, which many units share, with members that only others than the crowd's first link."""
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(vocab) for _ in range(120)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((k, " ".join(w)))
    for k in range(60):  # each differs from the one before by one word more
        base[2 * k] = f"x{k}"
        rows.append((100 + k, " ".join(base)))
    for k in range(40):  # a common passage in otherwise different texts
        rows.append((200 + k, " ".join([rnd.choice(vocab) for _ in range(60)] + [f"p{i}" for i in range(50)])))
    rows += [(None, rows[5][1]), (7, rows[7][1]), (7, rows[60][1])]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block, most in ((4000, 1000), (9000, 5)):
        got = ngram_jaccard_groups(docs, n=3, num=80, den=100, block_bytes=block, list_members=most).collect()
        want = check_ngram_groups(got, rows, 3, 80)
    assert len({c for _, _, c in want}) < 80


def test_passages_too_rare_to_be_heavy_link_nothing(spark, monkeypatch):
    """A passage in many texts, of which each task sees too few to report its grams: its keys' lists must not make one cluster of all that have it."""
    rows = [(k, " ".join([f"w{k}_{i}" for i in range(120)] + [f"p{i}" for i in range(60)])) for k in range(240)]
    rows += [(1000 + k, f"{rows[k][1]} x") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    sizes, stage = {}, Scratch.stage

    def counted(self, df, name, **options):
        out = stage(self, df, name, **options)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "stage", counted)
    got = {g.doc_id: g.component_id for g in ngram_jaccard_groups(docs, list_members=50).collect()}
    assert got == {k: k % 1000 for k, _ in rows}
    assert sizes["ngram-hot"] == 0 and sizes["ngram-candidates"] == 10


def test_structured_words_do_not_collide(spark):
    """Thue-Morse words, which polynomial hashes modulo a power of two cannot tell apart."""
    bits = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    docs = spark.createDataFrame([(1, bits), (2, "".join("ba"["ab".index(c)] for c in bits)), (3, bits)], "doc_id long, text string")
    assert {g.doc_id: g.component_id for g in ngram_jaccard_groups(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_ngram_groups_of_nothing(empty):
    assert ngram_jaccard_groups(empty).collect() == []


def test_similar_sets_share_a_key_and_a_list():
    rng = np.random.default_rng(3)
    for num in (80, 90):
        for size in (*range(1, 60, 3), 200, 900):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.sort(rng.choice(a, len(a) - int(size * (100 - num) / 100), replace=False))
            common = np.sort(rng.choice(a, size // 2, replace=False))
            for heavy in ((np.zeros(0, np.uint64), np.zeros(0, np.int64)), (common, rng.integers(1, 99, len(common)))):
                with np.errstate(over="ignore"):
                    grams, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                    keys, of = prefixes(grams, at, num, 100, heavy)
                    assert set(keys[of == 0]) & set(keys[of == 1])
                    assert possible_links(np.diff(at), parities(grams, at), num, 100) == [(0, 1)]


def test_counters_put_common_grams_last_and_lose_no_key():
    """In sets of op7's similarity, whatever the levels; a gram of many sets is no key of sets that have rarer ones."""
    rng = np.random.default_rng(5)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for size in (9, 10, 40, 300):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.sort(rng.choice(a, len(a) - size // 10, replace=False))
            keys, of = prefixes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 90, 100, none, rng.integers(0, 4, SLOTS).astype(np.uint16))
            assert set(keys[of == 0]) & set(keys[of == 1])
    common = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 30, dtype=np.uint64)])) for _ in range(200)]
    counters = Counters()
    for x in sets:
        counters.add(x)
    got = dict(counters.chunks())
    counts = np.concatenate([np.frombuffer(got.get(k, bytes(4 * CHUNK)), np.int32) for k in range(SLOTS // CHUNK)])
    assert counts.sum() == sum(map(len, sets)) and (counts[common & np.uint64(SLOTS - 1)] >= 200).all()
    keys, _ = prefixes(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), 90, 100, none, counts.astype(np.uint16))
    assert not set(keys) & set(common)


def test_possible_links_lose_none():
    rnd = random.Random(11)
    for num in (50, 80):
        sets = [np.array(sorted(rnd.sample(range(90), rnd.randint(5, 80))), np.uint64) for _ in range(70)]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        with np.errstate(over="ignore"):
            found = possible_links(np.diff(at), parities(np.concatenate(sets), at), num, 100)
        part = brute_components(range(70), found)
        assert all(part[i] == part[j] for i in range(70) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= num * len(set(sets[i]) | set(sets[j])))
        known = np.arange(70) % 9
        with np.errstate(over="ignore"):
            fewer = possible_links(np.diff(at), parities(np.concatenate(sets), at), num, 100, known)
        again = brute_components(range(70), fewer + [(i, i % 9) for i in range(70)])
        assert again == brute_components(range(70), found + [(i, i % 9) for i in range(70)]) and all(known[i] != known[j] for i, j in fewer)


def test_frequent_values():
    rng = np.random.default_rng(4)
    some = Frequent(50)
    values = np.concatenate([np.repeat(np.arange(20, dtype=np.uint64), 400), rng.integers(100, 1 << 40, 4000, dtype=np.uint64)])
    rng.shuffle(values)
    for part in np.array_split(values, 30):
        some.add(part)
    found, counts = some.often(1)
    assert set(range(20)) <= set(found.tolist()) and (counts <= 400).all() and len(found) <= 50


def test_skipping_merge_and_links():
    rnd = random.Random(5)
    for _ in range(200):
        lists = [sorted(rnd.sample(range(40), rnd.randint(0, 20))) for _ in range(rnd.randint(1, 7))]
        least = rnd.randint(1, 4)
        count = Counter(v for x in lists for v in x)
        assert dict(occurring(lists, least)) == {v: k for v, k in count.items() if k >= least}
    for num in (50, 80):
        sets = [np.array(sorted(rnd.sample(range(30), rnd.randint(5, 25))), np.uint64) for _ in range(60)]
        true = [(i, j) for i in range(60) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= num * len(set(sets[i]) | set(sets[j]))]
        assert brute_components(range(60), similar_links(sets, num, 100)) == brute_components(range(60), true)
        known = [i % 7 for i in range(60)]
        both = similar_links(sets, num, 100, known) + [(i, i % 7) for i in range(60)]
        assert brute_components(range(60), both) == brute_components(range(60), true + [(i, i % 7) for i in range(60)])


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 1), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == brute_components(nodes, [e for e in edges if None not in e and e[0] != e[1]])


def brute_runs(texts, length):
    count = Counter(d[i : i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for d in texts:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append([m.span() for m in re.finditer(b"\1+", bytes(gone))])
    return out


def brute_repeats(texts, length):
    count = Counter(d[i : i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for d in texts:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, passage", [(4096, None), (1, None), (4096, 100), (1, 100)])
def test_suffix_repeats(docs, rows, empty, hot, passage):
    texts = [(r[1] or "").encode() for r in rows]
    want = brute_repeats(texts, 120)
    got = suffix_repeats(docs, length=120, passage=passage, words=9, hot=hot).collect()
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == Counter((r[0], *w) for r, w in zip(rows, want))
    assert sum(w[1] for w in want) > 5000
    told = [[x for x in runs if len(d[slice(*x)].split()) > 9] for d, runs in zip(texts, brute_runs(texts, passage or 120))]
    assert Counter((g.doc_id, g.n_passages, g.passage_bytes) for g in got) == Counter((r[0], len(x), sum(b - a for a, b in x)) for r, x in zip(rows, told))
    if hot == 1:
        assert suffix_repeats(empty, passage=passage).collect() == []
        clean = suffix_clean(docs, length=120)
        assert clean.columns == docs.columns and clean.count() == len(rows)


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.integers(97, 100, 200).astype(np.uint8)
        parts = []
        for _ in range(12):
            a = rng.integers(0, 150)
            parts += [base[a : a + rng.integers(5, 50)], rng.integers(97, 101, rng.integers(1, 20)).astype(np.uint8), np.array([255], np.uint8)]
        text, length = np.concatenate(parts), int(rng.integers(9, 20))
        twice = text.tobytes() * 2
        count = Counter(twice[i : i + length] for i in range(len(text)))
        short = Counter(twice[i : i + 8] for i in range(len(text)))
        some = rng.random(len(text)) < 0.5
        few = Counter(twice[i : i + 8] for i in np.flatnonzero(some))
        assert repeats(text, (length,))[0].tolist() == [count[twice[i : i + length]] > 1 for i in range(len(text))]
        masks = repeats(text, (8, length))
        assert masks[0].tolist() == [short[twice[i : i + 8]] > 1 for i in range(len(text))] and (masks[1] == repeats(text, (length,))[0]).all()
        assert repeats(text, (8, length), [some, some])[0].tolist() == [bool(some[i]) and few[twice[i : i + 8]] > 1 for i in range(len(text))]


def test_embedding_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    vectors = [(centres[k % 12] + rng.normal(size=24) * 0.25).tolist() for k in range(150)] + [(rng.normal(size=24)).tolist() for _ in range(50)]
    vectors += [vectors[3], vectors[3], [x * 2 for x in vectors[5]]]
    odd = [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, [], [1.0, 2.0], [2.0, 4.0]]
    data = [(i, v, "x") for i, v in enumerate(vectors + odd)] + [(None, vectors[7], "x"), (4, vectors[4], "x")]
    got = embedding_groups(spark.createDataFrame(data, "vec_id long, embedding array<float>, node string"), tile=32).collect()
    units = {}
    for k, (_, v, _) in enumerate(data):
        if v and None not in v and all(map(math.isfinite, v)) and any(v):
            u = np.array(v, np.float32).astype(float)
            units[k] = u / np.linalg.norm(u)
    links = [(a, b) for a in units for b in units if b < a and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]
    degree = Counter(x for link in links for x in link)
    part = brute_components(range(len(data)), links)
    ids = defaultdict(list)
    for k, p in part.items():
        if data[k][0] is not None:
            ids[p].append(data[k][0])
    assert Counter((g.vec_id, g.n_links, g.component_id) for g in got) == Counter((data[k][0], degree[k], min(ids[p], default=None)) for k, p in part.items())
    assert all(g.kept == (g.vec_id == g.component_id) for g in got)
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("head", [1 << 17, 20])
def test_lm_scores(spark, rows, empty, head):
    rows = [*rows, (70, "long " + "x" * 50_000 + " word", "en", "a", 1, *"cccccc"), (71, "x" * 50_000, "en", "a", 1, *"cccccc")]
    trained: list = []
    got = lm_scores(spark.createDataFrame(rows, SCHEMA), head=head, trained=trained).collect()
    train = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2
    words = [((r[1] or "").encode().lower().split() + [b" "]) for r in rows]
    count = Counter(w for r, ws in zip(rows, words) if train(r[0]) for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((r[0], not train(r[0]), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for r, ws in zip(rows, words))
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    # the model's score, worked out token by token
    lexicon, model, class_n, class_v = trained
    own = {w: c for w, c in zip(lexicon.index, lexicon.classes.tolist()) if c <= OWN}
    class_of = lambda w: own.get(w, suffix_class(w) if w != b" " else OWN)
    p = {k: np.asarray(v) for k, v in model.p.items()}

    def token(c1, c2, w):
        c = class_of(w)
        s = p["Q"] @ (p["R"][c1] @ p["C1"] + p["R"][c2] @ p["C2"]) + p["b"]
        within = 1.0 if c <= OWN else (count[w] + 1) / (class_n[c] + class_v[c] + 1)
        return math.log10(math.exp(s[c] - s.max()) / np.exp(s - s.max()).sum() * within)

    scores = Counter()
    for r, ws in zip(rows, words):
        if len(ws) < 200:
            classes = [BOS, BOS, *map(class_of, ws)]
            scores[r[0], round(sum(token(classes[k + 1], classes[k], w) for k, w in enumerate(ws)), 5)] += 1
    assert not scores - Counter((g.doc_id, round(g.score, 5)) for g in got)
    # known words and one unknown word a class share the whole probability
    total = Counter({c: 1.0 / (class_n[c] + class_v[c] + 1) for c in range(OWN + 1, C)})
    for w in count:
        if class_of(w) > OWN:
            total[class_of(w)] += (count[w] + 1) / (class_n[class_of(w)] + class_v[class_of(w)] + 1)
    assert all(abs(v - 1) < 1e-9 for v in total.values())
    if head == 20:
        assert lm_scores(empty).collect() == []


def test_lm_normalises_and_learns():
    rng = np.random.default_rng(1)
    classes = np.zeros(60_000, np.int64)
    for i in range(1, len(classes)):  # a class follows from the one before, nine times of ten
        classes[i] = (classes[i - 1] * 7 + 3) % 50 if rng.random() < 0.9 else rng.integers(0, 50)
    unigram = (np.bincount(classes, minlength=C) + 0.5) / (len(classes) + 0.5 * C)
    model = Model(unigram)
    c1, c2, w = classes[1:-1], classes[:-2], classes[2:]
    for a in range(0, 50_000, 1024):
        model.step(c1[a : a + 1024], c2[a : a + 1024], w[a : a + 1024])
    m1, m2, b = model.tables()
    z = np.stack([log_normaliser(m1, m2, b, c) for c in range(60)])
    probabilities = np.exp(m1[3] + m2[7] + b - z[3, 7])
    assert abs(probabilities.sum() - 1) < 1e-9
    c1, c2, w = c1[50_000:], c2[50_000:], w[50_000:]
    assert (m1[c1, w] + m2[c2, w] + b[w] - z[c1, c2]).mean() > np.log(unigram[w]).mean() + 1


def language_rows(n=240):
    rnd = random.Random(9)
    syllables = {"en": ["th", "ing", "er", "on", "and"], "de": ["sch", "ung", "ei", "ber", "keit"], "fr": ["eau", "oi", "ment", "que", "è"]}
    out = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(20, 60)))
        out.append((i, text, lang, f"host{i % 3}" if i % 5 else "mixed", len(text), *"cccccc"))
    return out


def test_language_id(spark, empty):
    data = language_rows()
    wrong = {7, 50, 100}  # declared wrongly
    rows = [(r[0], r[1], {"en": "de", "de": "fr", "fr": "en"}[r[2]] if r[0] in wrong else r[2], *r[3:]) for r in data]
    rows += [(900, None, "en", "host0", 0, *"cccccc"), (901, "123 !!", None, None, 0, *"cccccc"), (902, data[1][1], None, None, 0, *"cccccc"), (902, data[1][1], "xx", "new", 0, *"cccccc"), (None, data[2][1], "fr", "host2", 0, *"cccccc")]
    got = language_id(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    assert sum(by[r[0]].language == r[2] for r in data) >= len(data) - 1
    assert by[900].rejected and by[901].rejected and not any(by[r[0]].rejected for r in data)
    assert {g.language for g in got if g.doc_id == 902} == {"de"}
    assert language_id(empty).collect() == []


def test_language_id_of_many_languages(spark):
    """More than 64 declared languages, the rarest with three rows; blocks of languages change nothing."""
    rnd = random.Random(12)
    rows = []
    for k in range(80):
        own = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)]
        for _ in range(3 if k % 4 == 0 else 6):
            text = " ".join("".join(rnd.choice(own) for _ in range(rnd.randint(1, 3))) for _ in range(40))
            rows.append((len(rows), text, f"l{k:02}", f"host{k % 3}", len(text), *"cccccc"))
    declared = {r[0]: r[2] for r in rows}
    # not declared, declared wrongly, and without letters
    rows += [(900, rows[0][1], None, None, 0, *"cccccc"), (901, rows[3][1], "l40", "host1", 0, *"cccccc"), (902, "12 !", "l40", "host1", 0, *"cccccc"), (None, None, "", None, 0, *"cccccc")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {g.doc_id: g for g in language_id(docs).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].language for i in declared} == declared and not any(got[i].rejected for i in declared)
    assert (got[900].language, got[901].text_language, got[902].rejected, got[None].rejected) == ("l00", "l01", True, True)
    for size in (7, 33):
        other = {g.doc_id: g for g in language_id(docs, block=size).collect()}
        assert len(other) == len(rows)
        for i, g in got.items():
            o = other[i]
            assert (o.language, o.text_language, o.n_trigrams, o.rejected) == (g.language, g.text_language, g.n_trigrams, g.rejected) and abs(o.confidence - g.confidence) < 1e-9


def test_language_sample_of_rare_languages(spark):
    """A rare language is fitted however few rows the sample has."""
    data = language_rows()
    rare = [(1000 + i, " ".join(["zzyx", "qoqx", "wvuz"][(i + j) % 3] for j in range(30)), "rare", "host0", 0, *"cccccc") for i in range(4)]
    got = {g.doc_id: g for g in language_id(spark.createDataFrame(data + rare, SCHEMA), sample_rows=20, least_rows=1).collect()}
    assert {got[r[0]].text_language for r in rare} == {"rare"}
    assert sum(got[r[0]].language == r[2] for r in data) >= len(data) - 1


def test_page_evidence(spark):
    html = '<!DOCTYPE html><html class=a lang="de-AT"><head><style>p{}</style><script>var t="</p>";</script></head><body>Guten Tag</body></html>'
    got = page_evidence(spark.createDataFrame([("https://www.Foo.example.at:80/x", html), (None, None)], "url string, html string")).collect()
    assert (got[0].declared, got[0].host, got[0].suffix, got[0].text.split()) == ("de", "www.foo.example.at", "at", ["Guten", "Tag"])
    assert got[1].host is None and got[1].declared is None


def brute_languages(pages, weight=20.0, least=0.5):
    """page_id: (language, confidence, text language, trigrams, rejected) of (page_id, text, declared, host, suffix), fitted on all."""
    langs = sorted({p[2] for p in pages if p[2]})
    k = len(langs)

    def grams(text):
        b = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in f" {text} ".lower().encode())
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(b) - 2) if b[i + 1] != 32]

    seen = {x: Counter() for x in langs}
    for p in pages:
        if p[2]:
            seen[p[2]].update(grams(p[1]))
    likely, best = {}, {}
    for p in pages:
        g = grams(p[1])
        likely[p[0]] = [sum(math.log((seen[x][b] + 0.5) / (sum(seen[x].values()) + 8192)) for b in g) * min(len(g), 40) / max(len(g), 1) for x in langs]
        best[p[0]] = max(range(k), key=lambda i: likely[p[0]][i])
    full = [p for p in pages if grams(p[1])]

    def lift(test, parent):
        n = Counter(best[p[0]] for p in full if test(p))
        return [(n[i] + weight * parent[i]) / (sum(n.values()) + weight) for i in range(k)]

    out = {}
    for p in pages:
        n = Counter(best[q[0]] for q in full)
        prior = [(n[i] + 1) / (len(full) + k) for i in range(k)]
        prior = lift(lambda q: p[4] and q[4] == p[4], prior)
        prior = lift(lambda q: p[3] and (q[3], q[4]) == (p[3], p[4]), prior)
        said = [0.0] * k
        if p[2]:
            for i, x in enumerate(langs):
                told = [q[2] for q in full if q[2] and best[q[0]] == i]
                said[i] = math.log((told.count(p[2]) + weight * ((0.5 if x == p[2] else 0) + 0.5 / k)) / (len(told) + weight))
        post = [a + math.log(b) + c for a, b, c in zip(likely[p[0]], prior, said, strict=True)]
        top = max(range(k), key=lambda i: post[i])
        sure = 1 / sum(math.exp(x - post[top]) for x in post)
        out[p[0]] = (langs[top], sure, langs[best[p[0]]], len(grams(p[1])), not grams(p[1]) or sure < least)
    return out


def test_language_of_pages(spark, tmp_path):
    """The registered query against brute force: markup language, address suffix and host, with wrong, foreign and missing ones."""
    rows = []
    for r in language_rows(90):
        i, text, lang = r[:3]
        declared = None if i % 7 == 0 else "fr" if i % 11 == 0 else lang
        suffix = {"en": "uk", "de": "at", "fr": "fr"}[lang] if i % 4 else "com"
        rows.append((i, text if i % 13 else " ".join(text.split()[:1]), declared, f"www{i % 5}.site.{suffix}", suffix))
    rows += [(100, "", "de", "www1.site.at", "at"), (101, "12 !", None, None, None), (102, "ing", None, None, None), (103, "que", "xx", "new.site.uk", "uk"), (104, "ei", None, "localhost", None), (105, "a", None, "www2.site.fr", "fr"), (106, "a", None, "www1.site.at", "at")]
    html = lambda t, d: "<html" + (f' lang="{d.upper()}-x"' if d else "") + f"><head><style>th ing</style></head><body><p>{t}</p></body></html>"
    pages = [(i, f"https://{h.upper()}/a?b=c.de" if h else None, html(t, d)) for i, t, d, h, _ in rows]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {g.page_id: g for g in language_of_pages(spark, str(tmp_path)).collect()}
    want = brute_languages(rows)
    assert set(got) == set(want)
    for i, (lang, sure, text_lang, n, rejected) in want.items():
        g = got[i]
        assert (g.language, g.text_language, g.n_trigrams, g.rejected) == (lang, text_lang, n, rejected) and abs(g.confidence - sure) < 1e-9
    assert any(w[0] != w[2] for w in want.values())  # evidence beside the text decides somewhere


def test_quality(spark, empty):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = rnd.random() < 0.6
        words = [rnd.choice(["reading", "the", "house", "walks", "under", "trees"]) for _ in range(40)]
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", "good" if good == (rnd.random() < 0.9) else "bad", len(text), *"cccccc"))
        if i % 2:
            labels.append((i, int(good), "z"))
    rows += [(None, None, None, None, None, *"cccccc"), (3, rows[3][1], "en", "good", 1, *"cccccc")]
    truth = {r[0]: "!!" not in r[1] for r in rows[:400]}
    marks = spark.createDataFrame([*labels, (7777, 1, "z"), (None, 1, "z"), (1, None, "z")], "doc_id long, quality int, text string")
    got = quality_scores(spark.createDataFrame(rows, SCHEMA), marks).collect()
    assert len(got) == len(rows)
    held = [g for g in got if g.doc_id is not None and g.doc_id % 2 == 0 and g.doc_id < 400]
    assert sum(g.kept == truth[g.doc_id] for g in held) / len(held) > 0.97
    assert quality_scores(empty, marks).collect() == []
    assert {g.score for g in quality_scores(spark.createDataFrame(rows, SCHEMA), marks.where("false")).collect()} == {0.5}


def brute_features(text, source, lang, chars):
    """Text and metadata features of one document, character by character and word by word."""
    kinds = {**{ord(c): 1 for c in "abcdefghijklmnopqrstuvwxyz"}, **{ord(c): 2 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): 3 for c in "0123456789"}, 32: 4, 10: 5, **{ord(c): 6 + i for i, c in enumerate("!|*$%#&")}}
    data = (text or "").encode()
    a = [0.0] * (14 + 5 + 128)
    for c in data:
        a[13 if c > 127 else kinds.get(c, 0)] += 1 / len(data)
    words = data.lower().split()
    if words:
        a[14], a[15] = len(set(words)) / len(words), max(Counter(words).values()) / len(words)
        for w in words:
            a[19 + (xxhash.xxh3_64_intdigest(w) >> 50) % 128] += 1 / len(words)
    a[16], a[17], a[18] = len(data) / max(len(words), 1) / 10, math.log1p(len(data)) / 10, float(len(data) > 0)
    b = [0.0] * (64 + 16 + 24)
    slot = lambda v, m: zlib.crc32(b"\0" if v is None else v.encode()) % m
    b[slot(source, 64)] = b[64 + slot(lang, 16)] = b[80 + min(23, max(chars or 0, 0).bit_length())] = 1.0
    return np.array(a, "f4"), np.array(b, "f4")


def brute_logistic(x, y, weight):
    """Function that gives log-odds, by Newton's method on standardised columns with a ridge of 1 (0.001 on the intercept)."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge, w = np.diag([1.0] * x.shape[1] + [1e-3]), np.zeros(x.shape[1] + 1)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ np.diag(weight * np.maximum(p * (1 - p), 1e-4)) @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return lambda q: np.clip(np.column_stack([(q - mean) / scale, np.ones(len(q))]) @ w, -30, 30)


def test_quality_against_brute_force(spark):
    rnd = random.Random(13)
    rows, labels = [], []
    for i in range(260):
        good = rnd.random() < 0.5
        words = [rnd.choice(["river", "stone", "walks", "under", "quiet"] if good or rnd.random() < 0.3 else ["BUY", "now!!", "$$$", "click"]) for _ in range(rnd.randint(5, 40))]
        rows.append((i, " ".join(words), rnd.choice(["en", "de", None]), ("calm" if good else "loud") if rnd.random() < 0.8 else None, rnd.choice([None, len(words), 7000])))
        if i % 3 == 0:
            labels.append((i, int(good)))
    rows += [(300, None, None, None, None), (301, "", "en", "calm", 0), (302, "x " * 40_000, "en", "calm", 80_000), (None, "river BUY", "en", "loud", 9), (303, rows[1][1], *rows[1][2:])]
    labels += [(0, 1 - labels[0][1]), (0, labels[0][1]), (0, labels[0][1])]
    got = quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int"), sure=5, rounds=3).collect()
    told = defaultdict(list)
    for i, q in labels:
        told[i].append(q)
    f = [brute_features(t, s, la, c) for _, t, la, s, c in rows]
    known = sorted((zlib.crc32(f[k][0].tobytes()), f[k][0].tobytes(), f[k][1].tobytes(), float(np.mean(told[r[0]]))) for k, r in enumerate(rows) if r[0] in told)
    y = np.array([float(v >= 0.5) for *_, v in known])
    views = [np.array([np.frombuffer(k[j], "f4") for k in known], float) for j in (1, 2)]
    free = [k for k, r in enumerate(rows) if r[0] not in told]
    pool = [np.array([f[k][j] for k in free], float) for j in (0, 1)]
    fit = np.arange(len(y)) % 4 != 3

    def train(taught):
        out = []
        for v, more in zip(views, taught):
            x = np.concatenate([v[fit], *[m[:1] for m in more]])
            out.append(brute_logistic(x, np.concatenate([y[fit], [m[1][0] for m in more]]), np.concatenate([np.ones(fit.sum()), np.full(len(more), 0.3)])))
        return out

    models = train([[], []])
    for r in range(3):
        taught = [[], []]
        for k, model in enumerate(models):
            odds = np.round(model(pool[k]), 6)
            tie = [tuple(struct.unpack("<q", xxhash.xxh64_intdigest(v[i].astype("f4").tobytes(), 42).to_bytes(8, "little"))[0] for v in (pool[1 - k], pool[k])) for i in range(len(odds))]
            for label, sign in ((1.0, 1), (0.0, -1)):
                best = {}
                for i in sorted(range(len(odds)), key=lambda i: (-odds[i] * sign, tie[i])):
                    key = (pool[0][i].tobytes(), pool[1][i].tobytes())
                    if odds[i] * sign > 2.2 and key not in best and len(best) < 5 * (r + 1):
                        best[key] = i
                taught[1 - k] += [np.array([pool[1 - k][i], np.full(pool[1 - k].shape[1], label)]) for i in best.values()]
        models = train(taught)
    odds = np.stack([m(v[~fit]) for m, v in zip(models, views)], 1)
    both, each = brute_logistic(odds, y[~fit], np.ones((~fit).sum())), [brute_logistic(odds[:, k : k + 1], y[~fit], np.ones((~fit).sum())) for k in (0, 1)]
    own = np.stack([m(np.array([x[j] for x in f], float)) for j, m in enumerate(models)], 1)
    squash = lambda v: 1 / (1 + np.exp(-v))
    want = sorted(zip([str(r[0]) for r in rows], squash(both(own)), squash(each[0](own[:, :1])), squash(each[1](own[:, 1:]))))
    have = sorted((str(g.doc_id), g.score, g.text_score, g.meta_score) for g in got)
    assert [h[0] for h in have] == [w[0] for w in want]
    assert np.abs(np.array([h[1:] for h in have]) - np.array([w[1:] for w in want])).max() < 1e-6


def test_tables_of_the_join_go_when_nothing_reads_them_any_more(spark, monkeypatch):
    held, stage = {}, Scratch.stage

    def watched(self, df, name, **options):
        held[name] = [path for _, path in self.tables]
        return stage(self, df, name, **options)

    monkeypatch.setattr(Scratch, "stage", watched)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 3, 60))) for i in range(9)], "doc_id long, text string")
    assert {r.component_id for r in ngram_jaccard_groups(docs, n=3, num=90, den=100).collect()} == {0}
    assert not [p for p in held["ngram-others"] if "ngram-keys" in p or "ngram-members" in p or "ngram-first-" in p and "links" not in p]


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_components_of_contracted_edges(spark, monkeypatch, most):
    """With few edges one task does it all and nothing is shuffled; else tasks have a few edges each."""
    plans, stage = [], Scratch.stage
    monkeypatch.setattr(Scratch, "stage", lambda self, df, name, **o: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(self, df, name, **o))
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] * 2 + [(2000 - i, 1999 - i) for i in range(90)] + [(9, None), (-3, -3), (-(1 << 62), 5)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(6), most=most).collect()
    kept = [e for e in edges if None not in e and e[0] != e[1]]
    assert {r.node: r.component for r in got} == brute_components({x for e in kept for x in e}, kept) and len(got) == len({r.node for r in got})
    assert ("Exchange hash" in "".join(plans[1:-1])) == (most == 40)


def test_shuffle_files_go_with_their_write(spark):
    """And the session's settings come back."""
    keys = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before, scratch = [spark.conf.get(k) for k in keys], Scratch(spark)
    files = lambda: {p for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*.data")}
    held = files()
    table = scratch.stage(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")), "counts")
    end = time.time() + 20
    while (left := files() - held) and time.time() < end:
        time.sleep(0.2)
    assert not left and table.count() == 1000 and [spark.conf.get(k) for k in keys] == before


def test_bitmaps_are_as_short_as_the_similarity_allows(spark):
    rng = np.random.default_rng(6)
    for num, bits in ((90, 512), (80, 1024), (50, 4096)):
        grams = [np.unique(rng.integers(0, 1 << 63, 1100, dtype=np.uint64)) for _ in range(30)]
        grams += [np.sort(rng.choice(g, -(-num * len(g) // 100), replace=False)) for g in grams]
        at = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        with np.errstate(over="ignore"):
            short = parities(np.concatenate(grams), at, bits_needed(num, 100))
        assert max(8 * len(b) for b in short) == bits
        assert sorted((min(e), max(e)) for e in possible_links(np.diff(at), short, num, 100)) == [(i, i + 30) for i in range(30)]
    texts = [(k, " ".join(f"w{k}x{j}" for j in range(1102))) for k in range(2)]
    rows = signatures(spark.createDataFrame(texts, "doc_id long, text string"), 3, bits_needed(90, 100), "doc_id", "text").where("n is not null").collect()
    assert [(r.n, len(r.parity)) for r in rows] == [(1100, 64)] * 2
