"""The operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm import alignment, bpe, decontaminate, html_extract, mixing, quality_rules, suffix_dedup, token_counts, topk, toxicity, url_rules, whitening
from cirrostrat.llm.jaccard_join import COMPONENTS_SQL, jaccard_components

#: Public vocabularies; every worker has the files.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY, BYTE_VOCABULARY, PIECE_MODEL = (f"/opt/tokenizers/{name}" for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
#: Host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def _hash_fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """The digest columns; as registered below, with the kept texts after them."""
    spans = suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"), least=400, keep_first=False)
    return suffix_dedup.removal_digest(spans, texts)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = _table(spark, sf_dir, "labels").where(_hash_fold(5) != 0)
    scored = toxicity.toxicity_scores(docs, learn)
    return scored.select("doc_id", (F.coalesce(_hash_fold(5), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = _table(spark, sf_dir, "labels").where(_hash_fold(4) != 2)
    scored = quality_rules.quality_scores(docs, learn)
    return scored.select("doc_id", (F.coalesce(_hash_fold(4), F.lit(-1)) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"), window=10)
    return decontaminate.hit_counts(found)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_totals(token_counts.length_histogram(_table(spark, sf_dir, "documents"), VOCABULARY))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)([^0-9/].*)?/?$', 1) as long)")
    labels = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    labelled = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", "blocked")
    return url_rules.judge(pages, URL_RULES, labelled).select("page_id", "host", "path", "rule", "verdict")


def url_rules_from_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mined part of op9 where labels do follow URLs: the given rules' verdicts on half of the URLs (by hash) teach it, and the other half is judged.

    ``expected`` is what the given rules say of a row, allow if none fits; ``taught`` marks the half that was learnt from.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    told = url_rules.judge(pages, URL_RULES, pages.select("url", F.lit(True).alias("blocked")).where("false")).select("page_id", "url", F.col("verdict").alias("expected"))
    taught = F.coalesce(F.crc32("url") % 2 == 0, F.lit(False))
    judged = url_rules.judge(told, (), told.where(taught).select("url", (F.col("expected") == "block").alias("blocked")), confidence=0.7)
    return judged.select("page_id", "host", "path", "expected", taught.alias("taught"), "verdict")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mix.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000)


def op12_bpe_encoding(spark: SparkSession, sf_dir: str, vocabulary: str = WORD_VOCABULARY) -> DataFrame:
    return bpe.encoding_digest(bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), vocabulary), vocabulary))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str, a: str = BYTE_VOCABULARY, b: str = PIECE_MODEL) -> DataFrame:
    return alignment.alignment_digest(_table(spark, sf_dir, "documents"), a, b)


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return found | {"url_rules_from_verdicts": url_rules_from_verdicts, "op2_suffix_array_dedup": partial(op2_suffix_array_dedup, texts=True)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


ORACLE_SQL: dict[str, str] = {
    "op4_benchmark_decontamination": decontaminate.CONTAMINATION_SQL,
    "op5_ngram_jaccard_join": COMPONENTS_SQL,
    "op6_exact_topk": topk.TOP_K_SQL,
}
