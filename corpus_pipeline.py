"""A corpus pipeline over ``documents``: toxic documents go, boilerplate lines go, one document of each group of near copies
stays, documents that hold a benchmark item go, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir), works on every row it is given, and returns the columns of documents (the last one:
pieces and their places). Null texts, empty texts, repeated rows and empty tables pass as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptrail.llm import contamination, lines, near_dups, packing, toxicity
from snaptrail.llm.common import cut, table
from snaptrail.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    network = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, network, COLUMNS).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sources carry; ``n_chars`` follows the text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id; rows are told apart by id and text.

    Of rows equal in both, the smallest in ``lang``, ``source``, ``n_chars`` stays.
    """
    stays = near_dups.representatives(docs).select("first_id", F.col("t1").alias("stays1"), F.col("t2").alias("stays2"))
    keyed = docs.select(*COLUMNS, *near_dups.text_keys(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("first_id")) & (F.col("t1") == F.col("stays1")) & (F.col("t2") == F.col("stays2"))
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = keyed.join(stays, same, "left_semi").groupBy("doc_id", "t1", "t2").agg(F.min(F.struct(*others, "text")).alias("row"))
    return one.select("doc_id", "row.*").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows are told apart by id and text."""
    found = contamination.found_texts(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found_id"), "t").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.xxhash64("text") == F.col("t"))
    return docs.join(found, same, "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_boilerplate),
    ("near dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
