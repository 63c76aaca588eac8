"""The queries of this subpackage: each operator over its whole table, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, media, mix, pii, secret_scan, sharding, simhash, token_counts
from .shared import table

#: The tokenizer of the token queries; a parameter, read where it is installed.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.planned(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scanned(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op5_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_media_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark passages as recordings, their bytes being 8-bit samples: no table here has real audio."""
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return media.aligned(docs, docs["text"].cast("binary"), known, known["text"].cast("binary"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.grouped(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.findings(table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together: only pages have markup and an address, only documents the labels of the models.

    doc_id is null for a page and page_id for a document.
    """
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    models = langid.TrigramModels.trained(langid.labelled_sample(docs))
    said = ("lang", "probability", "text_lang", "n_trigrams", "host_share", (F.col("lang") != langid.UND).alias("kept"))
    nothing = F.lit(None).cast("long")
    of_docs = langid.identified(langid.from_documents(docs), models).select("doc_id", nothing.alias("page_id"), *said)
    of_pages = langid.identified(langid.from_pages(pages), models).select(nothing.alias("doc_id"), F.col("doc_id").alias("page_id"), *said)
    return of_docs.unionByName(of_pages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_secret_scan, op3_token_counts, op4_exact_dedup, op5_bpe_encode, op6_media_prints, op7_simhash_groups, op8_sharding, op9_pii, op10_language_id)}


OP4_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id is not distinct from max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


OP8_SQL = """
with rows as (select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
                     ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
levels as (select doc_id, n_bytes, d, h >> (60 - d) as p from rows, range(0, 61) t(d)),
sized as (select *, sum(n_bytes) over b as shard_bytes, count(*) over b as shard_rows from levels window b as (partition by d, p)),
ranked as (select *, row_number() over (partition by doc_id order by d) as k from sized where shard_bytes <= 1048576 or d = 60)
select doc_id, n_bytes, case when d = 0 then '' else to_base(p, 2, d::integer) end as shard, d::bigint as depth,
       shard_bytes::bigint as shard_bytes, shard_rows, shard_bytes > 1048576 as oversized
from ranked where k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op8_sharding": OP8_SQL}
