"""A training corpus from raw documents: language, near-dedup, substring dedup, mixing and packing.

Every stage but the last takes and returns the columns of documents; further columns of its input are dropped. An empty
table gives an empty table in every stage, and very long texts are read whole. What each stage does with nulls, ties and
repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch
from scriptorium.llm.language import identify, train
from scriptorium.llm.lines import dedup_units
from scriptorium.llm.minhash import near_duplicates
from scriptorium.llm.mixing import mix_sources
from scriptorium.llm.packing import pack_documents
from scriptorium.llm.tokens import tokenizer_path

#: The columns that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; lang becomes the predicted one.

    Null and empty texts and those without a letter go, as no language is known for them. Repeated rows are judged alike.
    """
    out = identify(docs.select(*COLUMNS), train(docs))
    return out.filter("not rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with a row_no that is a row's own, whatever its doc_id; written, so that it stays."""
    return scratch.keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_no")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; rows without an id come last.

    Rows are told apart by a number of their own, so different texts of one id are different documents, and of rows
    equal in all columns one stays. Null and empty texts, and texts without words, are linked with nothing: all stay.
    """
    scratch = Scratch(spark)
    keyed = _numbered(docs, scratch)
    groups = near_duplicates(keyed.select(F.col("row_no").alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias("row_no"), "component_id")
    ranked = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_no")
    with Scratch(spark) as passing:
        named = passing.write(groups.join(keyed.select("row_no", "doc_id"), "row_no"))
        first = named.groupBy("component_id").agg(F.min(ranked)["row_no"].alias("stays"), F.count("*").alias("n"))
        # Written, so that a join alone deals out the groups and Spark can split a large one.
        first = passing.write(first.filter("n > 1").select("component_id", "stays"))
        gone = scratch.keep(named.join(first, "component_id").filter("row_no <> stays").select("row_no"))
    # Merged at every size: what goes grows with the documents, so it is never broadcast.
    return keyed.join(gone.hint("merge"), "row_no", "left_anti").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without units that an earlier document has; a document left without words goes.

    Null texts and texts that had no words before stay as they are. n_chars is counted anew, but kept for a null text.
    Rows of one doc_id and text are one occurrence.
    """
    out = dedup_units(docs.select(*COLUMNS))
    whole = "removed is null or size(removed) = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'"
    return out.filter(whole).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; copies share their doc_id.

    Each row is taken by its own number of copies, whatever its id, so repeated rows may be taken at different numbers.
    A null or empty text has no words and is taken at its source's rate too; a null source is a source.
    """
    keyed = _numbered(docs, Scratch(spark))
    copies = mix_sources(keyed, keys=("row_no",)).filter("copies > 0").select("row_no", F.col("copies").cast("int").alias("copies"))
    times = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    # Merged at every size: the copies' table grows with the documents, so it is never broadcast.
    return keyed.join(copies.hint("merge"), "row_no").select(*COLUMNS, times).drop("copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 ids, with their ids. A null text is an empty document."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned predictions, permutations and tokenizers are not SQL; the tests run each stage beside a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        before = None
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), rows=1024)
            if before is not None:
                scratch.drop(before)
            before = docs
        # The last stage keeps what its rows are read from, so no stage's table stays.
        return STAGES[-1][1](spark, docs, sf_dir)
