"""A corpus through five stages: reject toxic documents, keep one of each near-duplicate class, mask secrets, mix sources, encode.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
kept; :func:`run` writes and rereads the table between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import catalog, mixing, secrets, simhash, toxicity
from barloom.llm.mixing import ROW
from barloom.llm.stages import released, small_batches, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model of the labelled rows among ``docs``.

    Null and empty texts score 0 and stay, as do rows with a null doc_id; labels
    of ids that ``docs`` lacks, null labels and repeated labels do no harm.
    Without labels, or with one kind only, all documents stay. Columns of the
    scorer's names come back as they were.
    """
    model = toxicity.fit(docs, small_batches(released(spark)).read.parquet(f"{sf_dir}/labels.parquet"))
    released(spark)  # of the training
    rest = F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c != "text"]).alias("_rest")
    kept = toxicity.scored(docs.select(rest, "text"), model).where(F.col("score") < toxicity.THRESHOLD)
    return kept.select(*["text" if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns])


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 and more): the smallest doc_id.

    Rows are told apart by a key of their own, so of rows that repeat an id and
    a text one stays, and a null doc_id gives way to any other. Null and empty
    texts are one class. Other columns do not matter, whatever their names.
    """
    small_batches(released(spark))
    held = written(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias(ROW)), "rows")
    others = simhash.near_copies(held.select("_doc.doc_id", "_doc.text", ROW), row=ROW).where("not kept").select(F.col("row").alias(ROW))
    return held.join(others, ROW, "left_anti").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secret spans replaced; null texts stay null, ``n_chars`` follows the text, repeats stay."""
    released(spark)
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once for each pass that takes words of them.

    Rows are the unit, so null and repeated ids count; a null source is one of
    its own. Documents without words give nothing to take and do not appear.
    """
    released(spark)
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text of the mix, row by row; null texts have no tokens."""
    small_batches(released(spark))
    return catalog.token_digests(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", keep_one_copy),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Toxicity, SimHash and BPE have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
