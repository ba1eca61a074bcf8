"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents; the last one returns the pieces of packed sequences.

Cases: each row counts by itself, by a key that the stage gives it, so repeated rows, ids shared by different texts and null ids lose or keep the right rows. Null
and empty texts have no language and go in the first stage; in the later ones equal ones are copies of each other in exact_dedup, stand alone in
ngram_jaccard, and stay as they are in the others. Very long texts are one row each. Ties: of copies with one id one row stays. Further columns, whatever their
names but _row_key, pass through all stages but the last. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwell.llm.common import Scratch, maybe_broadcast, staged
from gridwell.llm.exact_dedup import exact_dedup
from gridwell.llm.language_id import language_id
from gridwell.llm.ngram_join import ngram_jaccard_groups
from gridwell.llm.packing import pack
from gridwell.llm.suffix_dedup import suffix_clean

#: Shortest repeat that goes, in bytes. Passages of over 50 words of prose are longer; those of very short words (under about 2.9 bytes each, such as
#: number lists; 101 bytes at least) can be shorter, and then they are not caught.
REPEAT_BYTES = 200


#: Words that a worker remembers while it packs: fewer than in op2_packing, as executors still hold what the stages before left in their heaps.
MEMORY_WORDS = 250_000

#: The key that a stage gives each row of its input: ids may be null, repeated or shared by different texts.
KEY = "_row_key"


def with_key(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row: its file and its place in it, which every later read gives again. A frame that is not read from files is written
    first."""
    try:
        return docs.withColumn(KEY, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException:
        return with_key(staged(docs, "rows", compression="zstd"))


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs less the rows whose key is in gone."""
    return docs.join(maybe_broadcast(staged(gone.select(KEY), name), 16 << 20), KEY, "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the language found is written to lang."""
    rows = with_key(docs)
    found = staged(language_id(rows, id_col=KEY).select(KEY, "language", "rejected"), "languages")
    kept = without(rows, found.where("rejected"), "rejected")
    changed = found.where("not rejected").join(rows.select(KEY, "lang"), KEY).where(~F.col("language").eqNullSafe(F.col("lang"))).select(KEY, "language")
    fixed = kept.join(maybe_broadcast(staged(changed, "relabelled"), 16 << 20), KEY, "left").withColumn("lang", F.coalesce("language", "lang"))
    return fixed.select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of rows that share it, one. Null ids lose."""
    rows = with_key(docs)
    marked = exact_dedup(rows.select(F.struct("doc_id", KEY).alias("id"), "text"), id_col="id")
    return without(rows, marked.where("not kept").select(f"id.{KEY}"), "exact-copies").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: the row with the smallest id of each group stays; of rows that share it, one. Null ids lose."""
    rows = with_key(docs)
    groups = ngram_jaccard_groups(rows.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", KEY).alias("id"), "text"), n=5, num=80, den=100, id_col="id")
    return without(rows, groups.where("id <> component_id").select(f"id.{KEY}"), "near-copies").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand elsewhere go from the texts; n_chars follows."""
    cut = suffix_clean(docs, length=REPEAT_BYTES)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, path=public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False, memory_words=MEMORY_WORDS).drop("ids", "width")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL can express neither language models nor similarity joins nor tokenizers; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
        scratch.release(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
