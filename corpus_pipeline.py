"""Corpus pipeline: each stage applies one operator of ``nearhit.llm`` to what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``docs``. Stages are cut apart by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhit.llm import mixing, packing, pii, quality, simhash
from nearhit.llm.common import prepare, stash
from nearhit.llm.queries import PII_KEY, tokenizer_path


def _refreshed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` set to the length of the text, where the column is there and the text is not null."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), "n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    prepare(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of the smallest id, and of those rows the one of the smallest
    text hash. Rows that repeat both id and text are one document."""
    prepare(spark)
    marked = simhash.near_duplicates(docs, tag=F.xxhash64("text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
    keep = marked.groupBy("root").agg(first).select(F.xxhash64("first.doc_id").alias("doc"), F.col("first.tag").alias("tag"))
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long")).alias("doc"), F.xxhash64("text").alias("tag"))
    return keyed.join(keep, ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"]).select("row.*")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with validated personal data pseudonymised in its text."""
    return _refreshed(pii.pseudonymise(docs, key=PII_KEY))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row for each time a document is taken, dealt to shards and shuffled within them.

    A document that the mix cuts keeps its first words, joined by one space; all others keep their text."""
    prepare(spark)
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]  # what tells two rows apart
    tag = F.xxhash64(*[x for c in hashed for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    _, pieces = mixing.mix(docs, size=mixing.n_words(F.col("text")), tag=tag)
    dealt = pieces.select(F.xxhash64("doc_id").alias("doc"), "tag", "size", "length", "shard", "place")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long")).alias("doc"), tag.alias("tag"))
    taken = rows.dropDuplicates(["doc", "tag"]).join(dealt, ["doc", "tag"])
    words = F.expr("filter(split(row.text, '[\\\\x09-\\\\x0D ]'), w -> w <> '')")
    cut = F.when(F.col("length") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("length").cast("int")), " "))
    dealt_out = taken.repartition("shard").sortWithinPartitions("shard", "place")
    return _refreshed(dealt_out.select(F.col("row").withField("text", F.coalesce(cut, "row.text")).alias("row")).select("row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path=tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", pseudonyms),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Feistel pseudonyms, hash-ordered mixing and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, "pipeline")
    return docs
