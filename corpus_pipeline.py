"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``.  What each does with nulls, empty texts and repeated rows is said there; columns beyond those of
``documents`` are dropped at the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import decontaminate
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.packing import pack
from tidemark.llm.pii import find_personal_data
from tidemark.llm.quality import reject_outliers
from tidemark.llm.workspace import Workspace, maybe_broadcast

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _tkey():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _without(docs: DataFrame, gone: DataFrame, work: Workspace) -> DataFrame:
    """``docs`` less the rows that ``gone(doc_id, tkey)`` names; texts are not shuffled while the list is small."""
    gone = work.save(gone.select(F.col("doc_id").alias("i"), F.col("tkey").alias("k")).distinct(), "gone")
    gone = maybe_broadcast(gone, gone.count(), 40)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (_tkey() == F.col("k")), "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their group's robust ellipsoid go.

    Null and empty texts fail the rules; null languages and sources are groups; repeated rows are judged alike."""
    work = Workspace(spark, "stage-quality")
    judged = reject_outliers(docs.select("doc_id", "text", "lang", "source", _tkey().alias("tkey")), work)
    return _without(docs, judged.where("NOT kept"), work)


def _one_text_an_id(docs: DataFrame, work: Workspace) -> DataFrame:
    """``docs`` with ``node``: the id, or a number of its own above all ids for each text of an id that has several.

    Of rows that repeat an id and its text, one stays: the least in (lang, source, n_chars).  Rows with a null id stay as they are."""
    several = work.save(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    n = several.count()
    node = F.col("doc_id").cast("long").alias("node")
    if not n:
        return docs.select(*COLUMNS, node)
    several = maybe_broadcast(several, n, 24)
    rest = ["lang", "source", "n_chars"]
    once = docs.join(several, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "text", "r.*")
    texts = once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    own = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1))
    named = once.join(texts, "doc_id").select(*COLUMNS, F.when(F.col("_n") == 1, F.col("doc_id").cast("long")).otherwise(own).alias("node"))
    return docs.join(several, "doc_id", "left_anti").select(*COLUMNS, node).unionByName(named)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Texts that share an id are documents of their own, behind all others in the order; no text is lost for another's id.  Null and
    empty texts and null ids link with nothing and stay; an empty table gives an empty one."""
    work = Workspace(spark, "stage-jaccard")
    docs = _one_text_an_id(docs, work)
    join = Workspace(spark, "stage-jaccard-join")  # the operator clears its own folder
    member = jaccard_components(docs.select(F.col("node").alias("doc_id"), "text"), join, width=5, percent=80)
    gone = work.save(member.where("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("node")).distinct(), "gone")
    return docs.join(maybe_broadcast(gone, gone.count(), 24), "node", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts, and an empty benchmark, take nothing away."""
    work = Workspace(spark, "stage-winnow")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _without(docs, decontaminate(docs, bench, work).where("contaminated"), work)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the new text.  A null text stays null with its ``n_chars``."""
    return find_personal_data(docs.select(*COLUMNS), redact=True).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences; a null text is empty and has the end token only, a null source is a queue."""
    return pack(docs.select("doc_id", "source", "text"), Workspace(spark, "stage-packing"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("packing", mixture_packing),
]

#: A determinant search and a field with trained weights are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = work.save(docs, f"{i}-{name}")
            work.keep_only(f"{i}-")
    return docs
