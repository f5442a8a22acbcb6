"""The pipeline over ``documents``: language, lines, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; the last returns a row of token digests per document.

Cases, besides those that the operators state: null text, or text without a letter, goes in the first stage; a document
that is empty once its repeated lines are cut goes in the second, one that was blank before stays until the language
stage has dropped it; rows that repeat both doc_id and text are one document and one of them stays after the third
stage, also if the doc_id is null; rows that share a doc_id, or have none, but not the text are documents of their own;
of a group the row with the smallest doc_id stays (null last), of equal ones that with the smallest key of doc_id and
text; the decontamination knows documents by doc_id, so all rows of a contaminated doc_id go and rows without one stay;
very long texts are processed whole; other columns are carried along, whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bpe, decontaminate, jaccard, langid, lines
from trailmark.llm.queries import vocabulary_path
from trailmark.llm.shared import discard, written

#: Least cosine with a language; up to so many ids (8 bytes each) are broadcast to drop documents, more are joined by shuffle.
LEAST_SCORE, BROADCAST_IDS = 0.05, 2_000_000
#: Learned scores and MinHash have no SQL form.
ORACLE_SQL = None


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids``."""
    ids = written(ids.select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that resemble no learned language at all."""
    language = langid.predictor(docs)(F.col("text").cast("string"))
    predicted = docs.select(whole(docs), language.alias("language"))
    return predicted.where((F.col("language.lang_pred") != "und") & (F.col("language.score") >= LEAST_SCORE)).select("row.*")


def whole(docs: DataFrame) -> Column:
    """A row as one column, so that no name of its columns clashes with one that a stage adds."""
    return F.struct(*[docs[n] for n in docs.columns]).alias("row")


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines; documents that lose every line go. ``n_chars`` follows the text."""
    return lines.first_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document (by doc_id, null last, then key) of each component; of rows that repeat both doc_id and text, one.

    Rows are known by a key of doc_id and text, so rows that share a doc_id, or have none, are documents of their own; rows are equal
    if a second key agrees as well.
    """
    c = F.col
    both = ["_key", "_other"]
    key, other = F.xxhash64(c("doc_id").cast("long"), c("text").cast("string")), F.xxhash64(F.lit(1), c("text").cast("string"), c("doc_id").cast("long"))
    known = written(docs.select(key.alias("_key"), other.alias("_other")).groupBy(*both).agg(F.count("*").alias("n")), "known")
    repeated = written(known.where("n > 1").select(*both), "repeated")
    # Different rows with one key, if there are any, stay as they are.
    clashing = written(known.groupBy("_key").count().where("count > 1").select("_key"), "clashing")
    found = written(jaccard.components(docs.select(key.alias("doc_id"), "text")).select(c("doc_id").alias("_key"), "component_id"), "components")

    def among(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
        return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, on, how)

    linked = found.where("_key <> component_id").distinct()
    members = among(linked.union(linked.select(c("component_id").alias("_key"), "component_id").distinct()), clashing, ["_key"], "left_anti")
    order = F.struct(c("doc_id").isNull().alias("none"), c("doc_id").alias("id"), c("_key").alias("key"))
    ordered = written(docs.select("doc_id", key.alias("_key")).distinct().join(members, "_key").select("component_id", "_key", order.alias("order")), "members")
    first = ordered.groupBy("component_id").agg(F.min("order").alias("first")).select(c("first.key").alias("_key"))
    dropped = written(ordered.select("_key").join(first, "_key", "left_anti"), "dropped")

    kept = among(docs.select(whole(docs), key.alias("_key"), other.alias("_other")), dropped, ["_key"], "left_anti")
    once = among(kept, repeated, both, "left_semi").groupBy(*both).agg(F.min_by("row", F.hash("row")).alias("row"))
    return among(kept, repeated, both, "left_anti").select("row.*").unionByName(once.select("row.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised ones included."""
    return without(docs, decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("language_id", known_language),
    ("line_dedup", first_lines),
    ("ngram_jaccard", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table is deleted once the next one is written."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
            discard(*tables)
            tables = [docs]
    return docs
