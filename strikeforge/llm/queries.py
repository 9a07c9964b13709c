"""One registered query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strikeforge.llm import (
    decontaminate, lexical_search, line_dedup, lm_score, mixing, passages, repeats, secret_scan,
    simhash, token_alignment, topk, toxicity, url_filter,
)
from strikeforge.llm.oracle import ORACLE_SQL
from strikeforge.sources.bridge import table
from strikeforge.sources.tables import Stage

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]

#: Folder of public vocabulary files, there on every machine.
TOKENIZERS = "/opt/tokenizers"

#: Weights 5, 2 and 1 over all of training: steady, rising from half to one and a half, falling to none.
SCHEDULES = (
    ((0.0, 5.0), (1.0, 5.0)),
    ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)),
    ((0.0, 2.0), (1.0, 0.0)),
)

URL_RULES = (
    url_filter.SiteRule("net/", "block"),
    url_filter.SiteRule("example.net/en/", "allow"),
    url_filter.SiteRule("example.com/de/", "block"),
    url_filter.SiteRule("org/fr/", "allow"),
    url_filter.PatternRule("/ads/", "block"),
    url_filter.PatternRule("^track*.gif", "block"),
    url_filter.PatternRule("^casino^", "block"),
    url_filter.PatternRule("?page=*&ref=x^", "block"),
)


def mix_plan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Words are counted once; the plan then runs over ids, sources and sizes."""
    stage = Stage(spark)
    stage.write("sizes", mixing.with_size(docs).select("doc_id", "source", "size"))
    return mixing.mix_sources(stage.read("sizes"), SCHEDULES)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select("doc_id", "item_id", "coverage", "n_tokens", "n_matched")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest_lines(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_groups(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_secrets(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest_repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op12_remove_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest_passages(table(spark, sf_dir, "documents"))


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest_alignment(
        table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json",
        f"{TOKENIZERS}/piece_bpe_32k.model",
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_decontaminate, op3_line_dedup, op4_url_filter, op5_top_k, op6_simhash,
        op7_secret_scan, op8_lm_score, op9_remove_repeats, op10_toxicity, op11_lexical_search,
        op12_remove_passages, op13_align_tokens,
    )
}
