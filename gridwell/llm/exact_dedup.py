"""Exact deduplication with a log-structured merge index (native: DataFrame operations only).

1. Each row's normalised text becomes a SHA-256 digest. The digest table (row, id, digest; no text) is written.
2. Rows are dealt to memtables by a hash of the row. A memtable keeps one entry a digest: the identifier that stays and
   the row count. All memtables are flushed in one job as runs: Parquet files in one folder a run, sorted by digest, with
   Parquet's own Bloom filters on the digest for point lookups.
3. Each run also yields a filter: one bit of a hash a digest, as rows (run, word, bits). Folding the words of all
   runs gives the bits that two entries share. This table has at most FILTER_WORDS rows whatever the input, so it is broadcast.
4. Compaction merges, by digest, the entries whose bit is shared; the rest are alone and skip the merge. The
   identifier that stays is the smallest or the largest (keep).
5. Digests with two rows or more are hits. Their texts, and only theirs (found by the filter, then by a semi join), are
   compared byte by byte: grouped by digest and text. A digest with two texts fails the job rather than merging them.

Hot groups: every grouping combines before its shuffle, so a text that a third of the rows share is a row a task; the
last join, from rows to their digest, is a plain equi-join that adaptive execution splits.

Cases: a null text counts as empty; empty texts are one group. A null id loses against any other id. Rows with equal id
and text are in one group, of which one row stays. An empty table gives an empty result. Columns other than the id and the
text are not read, so their names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

#: 64-bit words of the folded filter: 2 MB at most. More digests than bits only make it less selective.
FILTER_WORDS = 1 << 18
BITS_PER_KEY = 16
MAX_RUNS = 1024


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))


def _slot(words: int):
    """Word and bit of a digest in the filters."""
    return F.expr(f"pmod(shiftrightunsigned(xxhash64(digest), 6), {words})").alias("word"), F.expr("shiftleft(1L, cast(xxhash64(digest) & 63 as int))").alias("bit")


class MergeIndex:
    """Runs of (digest, entry) over a digest table, their filters, and the compacted level."""

    def __init__(self, table: DataFrame, keep: str, rows_per_memtable: int):
        rows = table.count()
        self.runs = min(MAX_RUNS, max(1, math.ceil(rows / rows_per_memtable)))
        self.words = min(FILTER_WORDS, max(64, math.ceil(rows * BITS_PER_KEY / 64)))
        self.best = F.max if keep == "largest" else F.min
        entry = F.struct("id", "row")
        if keep != "largest":  # nulls lose: a struct with a flag in front
            entry = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))
        flushed = table.groupBy(F.pmod(F.xxhash64("row"), F.lit(self.runs)).cast("int").alias("run"), "digest").agg(self.best(entry).alias("entry"), F.count("*").alias("n"))
        self.level0 = staged(flushed.select("digest", "entry", "n", "run").sortWithinPartitions("run", "digest"), "lsm-runs", **{"parquet.bloom.filter.enabled#digest": "true"})

    def shared_bits(self) -> DataFrame:
        """(word, shared): the bits that two entries of any runs, or one entry with two rows, have set."""
        word, bit = _slot(self.words)
        single = self.level0.select("run", "n", word, bit)
        filters = single.groupBy("run", "word").agg(F.bit_or("bit").alias("bits"), F.bit_or(F.when(F.col("n") > 1, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("own"), F.sum(F.lit(1)).alias("entries"))
        # two entries of one run on one bit: fewer bits than entries; then all bits of that word count as shared
        filters = filters.withColumn("own", F.when(F.expr("bit_count(bits) < entries"), F.col("bits")).otherwise(F.col("own")))
        fold = F.aggregate(
            F.collect_list(F.struct("bits", "own")),
            F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice")),
            lambda acc, x: F.struct(acc.once.bitwiseOR(x.bits).alias("once"), acc.twice.bitwiseOR(acc.once.bitwiseAND(x.bits)).bitwiseOR(x.own).alias("twice")),
            lambda acc: acc.twice,
        )
        return filters.groupBy("word").agg(fold.alias("shared")).where("shared <> 0")

    def maybe_shared(self, rows: DataFrame, shared: DataFrame) -> DataFrame:
        """rows with a digest, and maybe: whether the filters allow a second entry."""
        word, bit = _slot(self.words)
        probed = rows.select("*", word, bit).join(F.broadcast(shared), "word", "left")
        return probed.withColumn("maybe", F.coalesce(F.col("shared").bitwiseAND(F.col("bit")) != 0, F.lit(False))).drop("word", "bit", "shared")

    def compact(self, shared: DataFrame) -> DataFrame:
        probed = self.maybe_shared(self.level0, shared)
        merged = probed.where("maybe").groupBy("digest").agg(self.best("entry").alias("entry"), F.sum("n").alias("n"))
        return probed.where("not maybe").select("digest", "entry", "n").unionAll(merged)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", rows_per_memtable: int = 1 << 16) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256, n_bytes. keep is "largest" or "smallest"."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep}")
    hashed = digests(docs, id_col, text_col)
    table = staged(hashed.select(F.monotonically_increasing_id().alias("row"), "id", "digest", F.octet_length("norm").cast("long").alias("n_bytes")), "lsm-digests")
    index = MergeIndex(table, keep, rows_per_memtable)
    shared = staged(index.shared_bits(), "lsm-filter")
    level1 = staged(index.compact(shared), "lsm-level1")
    hits = level1.where("n > 1").select("digest", "n")
    texts = index.maybe_shared(hashed.select("digest", "norm"), shared).where("maybe").drop("maybe")
    seen = texts.join(hits.select("digest"), "digest", "left_semi").groupBy("digest", "norm").agg(F.count("*").alias("m")).groupBy("digest").agg(F.count("*").alias("texts"), F.sum("m").alias("rows"))
    checked = level1.join(seen, "digest", "left").withColumn("n", F.when((F.col("n") > 1) & ~((F.col("texts") == 1) & (F.col("rows") == F.col("n"))).eqNullSafe(True), F.raise_error(F.lit("one digest for two texts")).cast("long")).otherwise(F.col("n")))
    out = table.join(checked.select("digest", "entry", "n"), "digest")
    return out.select(F.col("id").alias(id_col), F.col("entry.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("entry.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes")
