"""Model registry as a small broadcast table, and model scoping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The reference's registry (key, name, model id, dimension,
# category) in its own order; the position is the registry order used to
# break ties.
REGISTRY = [
    ("minilm-l6", "MiniLM-L6", "all-MiniLM-L6-v2", 384, "fast"),
    ("minilm-l3", "MiniLM-L3", "all-MiniLM-L3-v2", 384, "fast"),
    ("minilm-l12", "MiniLM-L12", "all-MiniLM-L12-v2", 384, "fast"),
    ("mpnet-base", "MPNet-Base", "all-mpnet-base-v2", 768, "balanced"),
    ("distilroberta", "DistilRoBERTa", "all-distilroberta-v1", 768, "balanced"),
    ("msmarco-distilbert", "MS-MARCO-DistilBERT", "msmarco-distilbert-base-v4", 768, "balanced"),
    ("msmarco-minilm", "MS-MARCO-MiniLM", "msmarco-MiniLM-L6-cos-v5", 384, "balanced"),
    ("roberta-large", "RoBERTa-Large", "all-roberta-large-v1", 1024, "quality"),
    ("instructor-large", "Instructor-Large", "hkunlp/instructor-large", 768, "quality"),
    ("instructor-xl", "Instructor-XL", "hkunlp/instructor-xl", 768, "quality"),
    ("gte-large", "GTE-Large", "thenlper/gte-large", 1024, "quality"),
    ("gte-base", "GTE-Base", "thenlper/gte-base", 768, "quality"),
    ("e5-large", "E5-Large", "intfloat/e5-large-v2", 1024, "quality"),
    ("e5-base", "E5-Base", "intfloat/e5-base-v2", 768, "quality"),
    ("bge-large", "BGE-Large", "BAAI/bge-large-en-v1.5", 1024, "quality"),
    ("bge-base", "BGE-Base", "BAAI/bge-base-en-v1.5", 768, "quality"),
    ("paraphrase-multilingual", "Paraphrase-Multilingual", "paraphrase-multilingual-MiniLM-L12-v2", 384, "multilingual"),
    ("paraphrase-multilingual-mpnet", "Paraphrase-Multilingual-MPNet", "paraphrase-multilingual-mpnet-base-v2", 768, "multilingual"),
    ("distiluse-multilingual", "DistilUSE-Multilingual", "distiluse-base-multilingual-cased-v2", 512, "multilingual"),
    ("labse", "LaBSE", "sentence-transformers/LaBSE", 768, "multilingual"),
    ("legal-bert", "Legal-BERT", "nlpaueb/legal-bert-base-uncased", 768, "balanced"),
    ("scibert", "SciBERT", "allenai/scibert_scivocab_uncased", 768, "balanced"),
    ("qwen3-0.6b", "Qwen3-Embedding-0.6B", "Qwen/Qwen3-Embedding-0.6B", 1024, "quality"),
]
# Category order used by grouped listings, and named model sets.
CATEGORY_ORDER = ["fast", "balanced", "quality", "multilingual"]
DEFAULT_SET = ["minilm-l6", "mpnet-base", "gte-base", "bge-base"]
COMPREHENSIVE_SET = ["minilm-l6", "mpnet-base", "gte-base", "gte-large",
                     "bge-base", "bge-large", "e5-base", "e5-large"]

REGISTRY_DDL = ("model_key string, model_name string, model_id string, dimension int, "
                "category string, registry_pos int, category_rank int")


def registry_rows() -> list[tuple]:
    return [(k, n, m, d, c, i, CATEGORY_ORDER.index(c)) for i, (k, n, m, d, c) in enumerate(REGISTRY)]


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a 23-row DataFrame (always safe to broadcast)."""
    return spark.createDataFrame(registry_rows(), REGISTRY_DDL)


def registry_sql() -> str:
    vals = ", ".join(f"('{k}', '{n}', '{m}', {d}, '{c}', {i}, {r})" for k, n, m, d, c, i, r in registry_rows())
    return ("SELECT * FROM (VALUES " + vals + ") AS r(model_key, model_name, model_id, dimension, "
            "category, registry_pos, category_rank)")


def registry_join(df: DataFrame, key: str = "model_key") -> DataFrame:
    """Attach model name, category, dimension and registry order."""
    reg = registry(df.sparkSession).select("model_key", "model_name", "dimension", "category",
                                           "registry_pos", "category_rank")
    if key != "model_key":
        reg = reg.withColumnRenamed("model_key", key)
    return df.join(F.broadcast(reg), key, "left")


def scope_keys(keys: list[str] | None = None, category: str | None = None,
               named: str | None = None) -> list[str]:
    """Resolve a scope to registry keys (driver-side, over the fixed registry)."""
    if named == "default":
        return list(DEFAULT_SET)
    if named == "comprehensive":
        return list(COMPREHENSIVE_SET)
    if category is not None:
        if category not in CATEGORY_ORDER:
            raise ValueError(f"unknown category {category!r}")
        return [k for k, _, _, _, c in REGISTRY if c == category]
    if keys is not None:
        known = {k for k, *_ in REGISTRY}
        lost = [k for k in keys if k not in known]
        if lost:
            raise ValueError(f"not in the registry: {', '.join(lost)}")
        return list(keys)
    return [k for k, *_ in REGISTRY]


def models_in_scope(scored: DataFrame, keys: list[str] | None = None, category: str | None = None,
                    named: str | None = None, key: str = "model_key") -> DataFrame:
    """Restrict scored rows to a key list, a category, a named set or all."""
    chosen = scope_keys(keys, category, named)
    sel = scored.sparkSession.createDataFrame([(k,) for k in chosen], f"{key} string")
    return scored.join(F.broadcast(sel), key, "left_semi")


def unknown_models(scored: DataFrame, key: str = "model_key") -> DataFrame:
    """Distinct model keys present in the data that the registry does not know."""
    reg = registry(scored.sparkSession).select(F.col("model_key").alias(key))
    return scored.select(key).distinct().join(F.broadcast(reg), key, "left_anti")
