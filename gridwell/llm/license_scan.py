"""License scan by diagonal voting (native: DataFrame operations only).

Words are maximal runs of a-z, 0-9 and non-ASCII characters of the text in lower case. Every rolling pair of words is
hashed and joined with the positions that the templates have of that hash; the pair's words are compared too, so a hit
is a true one. A hit votes for the diagonal (its place less the template's). Votes are kept as the set of template
positions, so one diagonal of one template is one row, however long the template. Neighbouring diagonals (at most GAP apart: words put in or left
out) merge, and the merged span is verified: the share of the template's pairs that it covers must reach COVERAGE.
All positions on one diagonal mean that the template's words stand there consecutively.

Cost: one pass over the texts. Only hits leave the map side; templates are a broadcast of fixed size (a few hundred
rows). Documents meet their own hits only, so no source or phrase makes a hot group.

Cases: a null or empty text has no words and no label. Rows with equal ids stay separate rows; a null id stays null.
Very long texts are one row of the scan each. Ties need no rule: all places count. Columns other than the id and the text
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The base phrases, and longer passages by which a license shows without its phrase.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "this program is free software you can redistribute it and or modify it under the terms of": "gpl",
    "unless required by applicable law or agreed to in writing software distributed under the license": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "mozilla public license version 2 0": "mpl",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = 2
COVERAGE = 0.8


def _grams(templates: dict[str, str]) -> list[tuple]:
    """(template, position, last position, first word, second word, label, whether a base phrase)."""
    out = []
    for phrase, label in templates.items():
        w = phrase.split()
        if len(w) < 2:
            raise ValueError(f"a template has two words at least: {phrase}")
        out += [(phrase, i, len(w) - 2, w[i], w[i + 1], label, phrase in BASE) for i in range(len(w) - 1)]
    return out


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    score is the best covered share over all merged spans of all templates, 0 without any hit. first_word and last_word
    are null without a base place.
    """
    spark = docs.sparkSession
    grams = spark.createDataFrame(_grams({**BASE, **(PASSAGES if templates is None else templates)}), "template string, tpos int, last int, w1 string, w2 string, label string, base boolean")
    pairs = sorted({(g[3], g[4]) for g in _grams({**BASE, **(PASSAGES if templates is None else templates)})})
    wanted = [r.h for r in spark.createDataFrame(pairs, "w1 string, w2 string").select(F.xxhash64("w1", "w2").alias("h")).collect()]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # lower() changes no word boundary, and of what it maps to ASCII only the Kelvin sign becomes a letter alone
    words = F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("é"))), F.lit(WORD), F.lit(0))
    hashed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("w")).withColumn(
        "h", F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    )
    some = F.arrays_overlap("h", F.array(*[F.lit(x) for x in wanted]))
    at = F.filter(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda s: s.h.isin(wanted))
    hits = hashed.select("row", "id", F.size("w").cast("long").alias("n_words"), "w", F.when(some, at).alias("at"))
    hits = hits.select("row", "id", "n_words", F.transform("at", lambda s: F.struct(s.i.alias("i"), F.get("w", s.i).alias("w1"), F.get("w", s.i + 1).alias("w2"))).alias("at"))
    votes = hits.select("row", "id", "n_words", F.explode_outer("at").alias("at")).select("row", "id", "n_words", "at.*")
    votes = votes.join(F.broadcast(grams), ["w1", "w2"], "left").withColumn("diag", F.col("i") - F.col("tpos"))
    diagonals = votes.repartition("row").groupBy("row", "id", "n_words", "template", "label", "base", "last", "diag").agg(F.collect_set("tpos").alias("at"))
    order = Window.partitionBy("row", "template").orderBy("diag")
    islands = diagonals.withColumn("new", (F.col("diag") - F.lag("diag").over(order) > gap).cast("int")).withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order))
    spans = islands.groupBy("row", "id", "n_words", "template", "label", "base", "last", "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("covered"),
        F.sum(F.when(F.size("at") == F.col("last") + 1, 1).otherwise(0)).alias("full"),
        F.min(F.when(F.size("at") == F.col("last") + 1, F.col("diag"))).alias("lo"),
        F.max(F.when(F.size("at") == F.col("last") + 1, F.col("diag"))).alias("hi"),
    )
    share = F.col("covered") / (F.col("last") + 1)
    base = F.col("base") & (F.col("full") > 0)
    own = ~F.col("base") & (share >= coverage)
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row", "id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.col("full"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("hi"))).cast("long").alias("last_word"),
        join(F.when(base, F.col("label"))).alias("base_labels"),
        join(F.when(base | own, F.col("label"))).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
        F.count(F.when(base | own, 1)).alias("n_spans"),
    ).drop("row").withColumnRenamed("id", id_col)


def license_scan_sql() -> str:
    """The same result in DuckDB's SQL, for documents with distinct ids."""
    values = ", ".join(f"('{t}', {i}, {last}, '{a}', '{b}', '{label}', {str(base).lower()})" for t, i, last, a, b, label, base in _grams({**BASE, **PASSAGES}))
    return f"""
WITH grams(template, tpos, last, w1, w2, label, base) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 1))) AS i FROM d),
v AS (SELECT doc_id, template, label, base, last, i - 1 - tpos AS diag, tpos FROM (SELECT doc_id, i, w[i] AS w1, w[i + 1] AS w2 FROM p) JOIN grams USING (w1, w2)),
g AS (SELECT doc_id, template, label, base, last, diag, bit_or(1::BIGINT << tpos) AS mask FROM v GROUP BY ALL),
l AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, template ORDER BY diag) > {GAP} THEN 1 ELSE 0 END AS fresh FROM g),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diag) AS island, bit_count(mask) = last + 1 AS whole FROM l),
s AS (SELECT doc_id, template, label, base, last, island, bit_or(mask) AS m, count(*) FILTER (whole) AS whole_n, min(diag) FILTER (whole) AS lo, max(diag) FILTER (whole) AS hi FROM n GROUP BY ALL),
t AS (SELECT *, bit_count(m) / (last + 1)::DOUBLE AS share, base AND whole_n > 0 AS b, NOT base AND bit_count(m) / (last + 1)::DOUBLE >= {COVERAGE} AS o FROM s)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, coalesce(sum(whole_n) FILTER (b), 0)::BIGINT AS n_base, (min(lo) FILTER (b))::BIGINT AS first_word, (max(hi) FILTER (b))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (b), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (b OR o), '') AS labels,
  coalesce(max(share), 0.0)::DOUBLE AS score, (count(*) FILTER (b OR o))::BIGINT AS n_spans
FROM d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id"""
