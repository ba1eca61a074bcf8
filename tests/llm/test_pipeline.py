"""The pipeline's stages against brute force."""

import re
from collections import defaultdict

import corpus_pipeline
from gridwell.llm.queries import oracle_sql, queries

from .test_operators import SCHEMA, brute_components, brute_repeats, language_rows, lower


def fixture():
    rows = language_rows(60)
    long = rows[0][1] + " " + rows[3][1] + " " + rows[6][1]
    passage = " ".join(f"word{i}" for i in range(70))
    add = lambda text, lang="en": rows.append((len(rows), text, lang, "host0", len(text or ""), *"cccccc"))
    add(long)
    add(long.upper())
    add(long.replace("ing", "th", 1))
    for k in (9, 12, 15):
        add(rows[k][1] + " " + passage + " " + rows[k + 3][1])
    add(None)
    add("1234 !!")
    return rows


def test_stages(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA)
    text = {r[0]: r[1] for r in rows}
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_jaccard", "suffix_dedup", "packing"]
    step = dict(corpus_pipeline.STAGES)

    out = step["language_id"](spark, docs, "")
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.collect()}
    assert set(text) - left == {r[0] for r in rows if r[1] in (None, "1234 !!")}

    one = docs.where("text is not null")
    kept = {r.doc_id for r in step["exact_dedup"](spark, one, "").collect()}
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            groups[lower(r[1])].append(r[0])
    assert kept == {max(g) for g in groups.values()}

    kept = {r.doc_id for r in step["ngram_jaccard"](spark, one, "").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in text.items() if t is not None for w in [re.findall("[^\x20\x09-\x0d]+", lower(t))]}
    links = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert kept == set(brute_components(sets, links).values()) and len(kept) < len(sets)

    cut = step["suffix_dedup"](spark, one, "")
    assert cut.columns == docs.columns
    got = {r.doc_id: r for r in cut.collect()}
    ids = sorted(sets)
    for i, want in zip(ids, brute_repeats([text[i].encode() for i in ids], corpus_pipeline.REPEAT_BYTES)):
        assert abs(len(got[i].text.encode()) - (want[0] - want[1])) <= 6  # cuts keep characters whole
        assert got[i].n_chars == len(got[i].text)

    one.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} <= set(sets) and len(pieces) > 0


def test_rows_without_ids_of_their_own(spark, tmp_path):
    """Repeated rows, ids shared by different texts, and null ids."""
    base = language_rows(12)
    x, y, z, w = (base[k][1] + " " + base[k + 3][1] for k in (0, 1, 2, 4))
    near = z + " mehr"
    row = lambda i, text, lang="en": (i, text, lang, "host0", len(text or ""), *"cccccc")
    rows = [row(1, w), row(1, w), row(5, x), row(5, y), row(9, x), row(None, x), row(None, z), row(None, z), row(20, near), row(21, near), row(20, w + " " + y), row(None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    step = dict(corpus_pipeline.STAGES)
    run = lambda name, data: sorted(((r.doc_id, r.text) for r in step[name](spark, data, "").collect()), key=repr)
    full = docs.where("text is not null")

    want = [(1, w), (5, y), (9, x), (None, z), (21, near), (20, w + " " + y)]
    assert run("exact_dedup", full) == sorted(want, key=repr)

    # keys of rows that are read from files, several of them
    full.repartition(3).write.parquet(f"{tmp_path}/rows")
    assert run("exact_dedup", spark.read.parquet(f"{tmp_path}/rows")) == sorted(want, key=repr)

    want = [(1, w), (5, x), (5, y), (20, near), (20, w + " " + y)]
    assert run("ngram_jaccard", full) == sorted(want, key=repr)

    # rows of one id get each its own language, and a null id does not save a text without letters
    known = spark.createDataFrame([*language_rows(60), (0, language_rows(60)[1][1], None, None, 0, *"cccccc"), (None, "12 !!", "en", None, 0, *"cccccc")], SCHEMA)
    out = step["language_id"](spark, known, "").collect()
    assert len(out) == 61 and all(r.doc_id is not None for r in out)
    assert {r.text: r.lang for r in out if r.doc_id == 0} == {language_rows(60)[k][1]: language_rows(60)[k][2] for k in (0, 1)}

    # a corpus that is loaded twice loses nothing
    once = spark.createDataFrame(language_rows(30), SCHEMA)
    assert run("exact_dedup", once.unionAll(once)) == run("exact_dedup", once)
    assert run("ngram_jaccard", once.unionAll(once)) == run("ngram_jaccard", once)


def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", k).group(1)) for k in queries() if k.startswith("op"))
    assert numbers == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
