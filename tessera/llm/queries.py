"""The queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import avi, classifier, importance, langid, merkle, mixing, packing, pii, quality, simhash, spm, tokens, warc
from tessera.llm.common import held_out
from tessera.session import prepare, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(prepare(spark), sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(prepare(spark), sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(prepare(spark), sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(prepare(spark), sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_quality that SQL can state."""
    return quality.base_statistics(table(prepare(spark), sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    return classifier.classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers; workers open it by the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_round_trip(table(prepare(spark), sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_round_trip(table(prepare(spark), sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_spm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return spm.encode(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    model = langid.train(docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(prepare(spark), sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(prepare(spark), sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_classifier": op6_classifier,
    "op7_avi": op7_avi,
    "op8_tokens": op8_tokens,
    "op9_spm": op9_spm,
    "op10_langid": op10_langid,
    "op11_importance": op11_importance,
    "op12_packing": op12_packing,
    "op13_merkle": op13_merkle,
    "quality_base": quality_base,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.WARC_SQL, "op3_mixing": mixing.MIX_SQL, "op11_importance": importance.RESAMPLE_SQL, "op13_merkle": merkle.MERKLE_SQL, "quality_base": quality.BASE_SQL}
