"""Cache store as append-only Parquet logs.

A collection lives at ``<root>/<name>/`` with three append-only tables:
``entries``, ``touches`` (last access + hit count) and ``tombstones``
(deletes). The current state is a query:

    entries  LEFT ANTI  tombstones written after them
             LEFT JOIN  touches grouped to (max touched_at, count)

A tombstone hides entries stored up to its time, so an id can be added again
after a delete. Appends never rewrite files, so concurrent writers cannot
lose each other's updates (the reference's read-modify-write metadata update
can), and a failed task simply re-runs. Every function below is also usable on plain
DataFrames without a collection.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhit.functions.ids import make_entry_id
from nearhit.session import Scratch, remove
from nearhit.sources.tables import read_if_there

ENTRY_DDL = ("entry_id string, model_key string, text string, embedding array<float>, llm_response string, "
             "stored_at timestamp, seq long, extra map<string,string>")
TOUCH_DDL = "entry_id string, touched_at timestamp, query_id string, was_hit boolean, n long"
TOMB_DDL = "entry_id string, deleted_at timestamp"


#: Metadata keys of ``extra`` that override what an entry would store under them.
RESERVED = ("llm_response", "original_text", "timestamp_stored")


def build_entries(df: DataFrame, *, text: str = "text", embedding: str = "embedding",
                  response: str | None = "llm_response", model_key: str = "default",
                  stored_at=None, seq: str | None = None, id_col: str | None = None,
                  extra: str | None = None, expected_dim: int | None = None) -> DataFrame:
    """Rows in the entry schema. Without ``id_col`` the id is
    ``md5(model ':' text ':' stored_at ':' seq)`` (reproducible, unlike a
    salted hash); without ``seq`` the row's position in the batch stands for
    it, so equal texts of a batch get ids of their own. All rows share one
    storage time. A row needs a text and a vector, and ``expected_dim`` fails
    the job on a vector of another length. A missing response or metadata
    value is null; metadata under a reserved key overrides the column."""
    when = stored_at if stored_at is not None else datetime.now(timezone.utc).replace(tzinfo=None)
    ts = F.lit(when).cast("timestamp")
    sq = (F.col(seq) if seq else F.monotonically_increasing_id()).cast("long")
    emb = F.when(F.col(embedding).isNull() | F.col(text).isNull(), F.raise_error(F.lit("an entry needs both a text and a vector"))
                 ).otherwise(F.col(embedding).cast("array<float>"))
    if expected_dim is not None:
        emb = F.when(F.size(embedding) != expected_dim,
                     F.raise_error(F.concat(F.lit("vector of length "), F.size(embedding).cast("string"),
                                            F.lit(f" in a collection of {expected_dim} dimensions")))).otherwise(emb)
    meta = F.coalesce(F.col(extra), F.create_map().cast("map<string,string>")) if extra else F.create_map().cast("map<string,string>")
    out = df.select(
        F.lit(model_key).alias("model_key"), F.coalesce(F.element_at(meta, "original_text"), F.col(text)).alias("text"),
        emb.alias("embedding"),
        F.coalesce(F.element_at(meta, "llm_response"), (F.col(response) if response else F.lit(None)).cast("string")).alias("llm_response"),
        F.coalesce(F.element_at(meta, "timestamp_stored").cast("timestamp"), ts).alias("stored_at"), sq.alias("seq"),
        F.map_filter(meta, lambda k, v: ~k.isin(*RESERVED)).alias("extra"),
        *([F.col(id_col).cast("string").alias("_given")] if id_col else []))
    eid = F.col("_given") if id_col else make_entry_id("model_key", "text", "stored_at", "seq")
    out = out.withColumn("entry_id", eid)
    return out.select("entry_id", "model_key", "text", "embedding", "llm_response", "stored_at", "seq", "extra")


def touch_summary(touches: DataFrame) -> DataFrame:
    """Per entry: last access time and number of touches (nearest-neighbour hits, S4)."""
    n = F.coalesce(F.col("n"), F.lit(1)) if "n" in touches.columns else F.lit(1)
    return touches.groupBy("entry_id").agg(F.max("touched_at").alias("last_access"),
                                           F.sum(n).cast("long").alias("cache_hit_count"))


def current_entries(entries: DataFrame, touches: DataFrame | None = None,
                    tombstones: DataFrame | None = None) -> DataFrame:
    """Live entries with their access summary."""
    e = entries
    if tombstones is not None:
        gone = tombstones.groupBy("entry_id").agg(F.max("deleted_at").alias("_gone"))
        e = e.join(gone, "entry_id", "left").where(F.col("_gone").isNull() | (F.col("stored_at") > F.col("_gone"))).drop("_gone")
    if touches is None:
        return e.withColumn("last_access", F.col("stored_at")).withColumn("cache_hit_count", F.lit(0).cast("long"))
    t = touch_summary(touches)
    return (e.join(t, "entry_id", "left")
             .withColumn("last_access", F.greatest(F.col("stored_at"), F.col("last_access")))
             .withColumn("cache_hit_count", F.coalesce("cache_hit_count", F.lit(0)).cast("long")))


def get_by_ids(entries: DataFrame, ids: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """Entries whose id is in ``ids``; unknown ids are ignored (semi-join)."""
    return entries.join(ids.select(F.col(id_col).alias("entry_id")).distinct(), "entry_id", "left_semi")


def delete_by_ids(entries: DataFrame, ids: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """Entries minus the given ids (anti-join); an empty id set is a no-op."""
    return entries.join(ids.select(F.col(id_col).alias("entry_id")), "entry_id", "left_anti")


def collection_stats(entries: DataFrame, name: str, expected_dim: int | None) -> DataFrame:
    """name, count, expected dimension and observed min/max dimension."""
    return entries.agg(F.count(F.lit(1)).alias("total_embeddings"),
                       F.min(F.size("embedding")).alias("min_dimension"),
                       F.max(F.size("embedding")).alias("max_dimension")).select(
        F.lit(name).alias("collection_name"), "total_embeddings",
        F.lit(expected_dim).cast("int").alias("embedding_dimension"), "min_dimension", "max_dimension")


class Collection:
    """Append-only collection under ``root/name`` (``open_collection``)."""

    def __init__(self, spark: SparkSession, root: str, name: str = "semantic_cache",
                 expected_dim: int | None = None):
        self.spark, self.root, self.name, self.expected_dim = spark, root, name, expected_dim
        self.base = f"{root}/{name}"

    def _path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def _read(self, table: str, ddl: str) -> DataFrame:
        return read_if_there(self.spark, self._path(table), ddl)

    # -- writes -------------------------------------------------------------
    def add(self, df: DataFrame, **kw) -> DataFrame:
        """Append entries (ids computed if absent) and return (entry_id, text, seq) of
        all rows of the batch. Ids that are live already are not stored again;
        an id given twice in one batch is an error."""
        kw.setdefault("expected_dim", self.expected_dim)
        scratch = Scratch(self.spark, "store-add")
        built = scratch.keep(build_entries(df, **kw), "batch")
        twice = built.groupBy("entry_id").count().where("count > 1 OR entry_id IS NULL").first()
        if twice is not None:
            raise ValueError(f"entry id {twice['entry_id']!r} is not unique in the batch")
        new = built.join(self.entries().select("entry_id"), "entry_id", "left_anti")
        new.select(built.columns).write.mode("append").parquet(self._path("entries"))
        return built.select("entry_id", "text", "seq")

    def touch(self, ids: DataFrame, touched_at=None, query_id: str | None = None, was_hit: str | None = None) -> None:
        ts = F.current_timestamp() if touched_at is None else F.lit(touched_at).cast("timestamp")
        live = self.entries().select("entry_id")
        t = ids.join(live, "entry_id", "left_semi").select(
            "entry_id", ts.alias("touched_at"),
            (F.col(query_id) if query_id else F.lit(None)).cast("string").alias("query_id"),
            (F.col(was_hit) if was_hit else F.lit(None)).cast("boolean").alias("was_hit"),
            F.lit(1).cast("long").alias("n"))
        t.write.mode("append").parquet(self._path("touches"))

    def delete(self, ids: DataFrame, deleted_at=None) -> None:
        when = deleted_at if deleted_at is not None else datetime.now(timezone.utc).replace(tzinfo=None)
        ids.select("entry_id", F.lit(when).cast("timestamp").alias("deleted_at")).write.mode("append").parquet(self._path("tombstones"))

    def clear(self) -> None:
        """Remove all tables of the collection."""
        remove(self.spark, self.base)

    # -- reads --------------------------------------------------------------
    def entries(self) -> DataFrame:
        return current_entries(self._read("entries", ENTRY_DDL), self._read("touches", TOUCH_DDL),
                               self._read("tombstones", TOMB_DDL))

    def get(self, ids: DataFrame) -> DataFrame:
        return get_by_ids(self.entries(), ids)

    def stats(self) -> DataFrame:
        return collection_stats(self.entries(), self.name, self.expected_dim)


def open_collection(spark: SparkSession, root: str, name: str = "semantic_cache",
                    expected_dim: int | None = None) -> Collection:
    """Get-or-create: nothing is written until the first append."""
    return Collection(spark, root, name, expected_dim)
