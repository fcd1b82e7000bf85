"""The registered queries of the text operators and their SQL twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from returnwise.llm import (
    chat,
    decontaminate,
    language,
    licenses,
    lines,
    lm,
    manifest,
    neighbours,
    packing,
    phrases,
    quality,
    secrets_scan,
    simhash,
)
from returnwise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_scan.query(table(spark, folder, "documents"))


def op3_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.query(table(spark, folder, "documents"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op5_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm.query(table(spark, folder, "documents"))


def op6_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chat.query(table(spark, folder, "conversations"))


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.query(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.query(table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.query(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.query(table(spark, folder, "documents"))


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.query(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_secret_scan,
        op3_simhash_components,
        op4_best_fit_packing,
        op5_lm_score,
        op6_chat_windows,
        op7_benchmark_decontamination,
        op8_nearest_neighbours,
        op9_line_dedup,
        op10_quality,
        op11_phrase_collocations,
        op12_merkle_manifest,
        op13_license_scan,
    )
}

SQL: dict[str, str] = {
    "op11_phrase_collocations": phrases.SQL,
    "op12_merkle_manifest": manifest.SQL,
    "op13_license_scan": licenses.SQL,
    "op9_line_dedup": """
        with docs as (
            select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines
            from documents),
        each as (
            select rid, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from docs),
        keyed as (
            select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from each),
        crowded as (
            select key, max(doc_id) as largest from keyed
            where length(key) >= 20 and doc_id is not null
            group by key having count(distinct doc_id) >= 3),
        marked as (
            select k.*, coalesce(k.doc_id < c.largest, false) as gone
            from keyed k left join crowded c on k.key = c.key)
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
        from marked group by rid, doc_id
    """,
}
