"""Queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.session import table


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


#: Weights that the sources take in turn, in order of their names.
MIX_WEIGHTS = [5.0, 2.0, 1.0]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.pieces import encode

    return encode(table(spark, sf_dir, "documents"), check=True)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), words=4, distance=4)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.secretscan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs, model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from voxelloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelloom.llm.centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


QUERIES = (op1_mix_sources, op2_sentencepiece, op3_nearest, op4_simhash, op5_exact_dedup, op6_pii, op7_url_filter, op8_secrets, op9_language_id, op10_html_text, op11_resample, op12_pack, op13_centroids)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from voxelloom.llm import sql

    return dict(sql.ORACLES)
