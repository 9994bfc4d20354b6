"""The numbered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, code_search, mixing, multi_index, periodic_runs, phrases, secrets, simhash, substring_dedup, toxicity, url_filter, warc
from .stages import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier too, over all documents; see :func:`substring_dedup.repeated_passages` for nulls, repeats and long texts."""
    docs = _table(spark, sf_dir, "documents")
    return substring_dedup.repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of each hundredth vector; vectors without a direction take no part, see :func:`multi_index.nearest`."""
    return multi_index.nearest(_table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; null texts have none and a null source is one of its own, see :func:`mixing.mixture`."""
    return mixing.mixture(_table(spark, sf_dir, "documents")).drop("taken_by_pass")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of each formatted conversation, read back from the output alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                turns = chat.parse(text)
                learnt = "".join(chat.unescape(text[s["start"] : s["stop"]]) for s in loss)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                for k, v in zip(rows, (conv, len(turns), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)), strict=True):
                    rows[k].append(v)
            kinds = {"turns_sha256": pa.string(), "loss_sha256": pa.string()}
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, kinds.get(k, pa.int64())) for k in rows]))

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, read back; null texts are empty and rows without a conversation stay alone, see :func:`chat.formatted`."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], table.schema)
    return chat_digests(chat.formatted(table.unionByName(more)))


def token_digests(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every text, by the public byte-level vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode(docs, path, public_tokenizers.PATTERN, packed=True, decoded=True)
    count = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text; null texts are empty, see :func:`bpe.encode`."""
    return token_digests(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text by a model of the labelled rows; null and empty texts score 0, see :func:`toxicity.scored`."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every whole text; null texts have none, see :func:`secrets.secret_spans`."""
    found = secrets.secret_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == kind), False)).cast("long").alias(f"n_{kind}") for kind, *_ in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and linked classes of all documents; texts without words have fingerprint 0, see :func:`simhash.near_duplicate_classes`."""
    return simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op9_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest sign codes of each fiftieth vector, exactly; see :func:`code_search.nearest_signs`."""
    return code_search.nearest_signs(_table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; null urls have empty hosts, see :func:`url_filter.judged`."""
    return url_filter.judged(_table(spark, sf_dir, "pages"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives in the shared folder, read back; null html is empty, see :func:`warc.page_records` for null and repeated ids."""
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language; null languages are ``und``, see :func:`phrases.collocations`."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal periodic runs of all documents, each tenth of which is looped first; see :func:`periodic_runs.collapsed_runs`."""
    docs = periodic_runs.looped(_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.collapsed_runs(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_multi_index, op3_mixing, op4_chat, op5_bpe, op6_toxicity, op7_secrets, op8_simhash, op9_code_search, op10_url_filter, op11_warc, op12_phrases, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op9_code_search": code_search.ORACLE, "op10_url_filter": url_filter.ORACLE, "op11_warc": warc.ORACLE, "op12_phrases": phrases.ORACLE}
