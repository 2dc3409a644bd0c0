"""A content-addressed table of embeddings: each distinct text is embedded once per model, however often and in however many runs it occurs.

A text's address is the 128-bit digest of its bytes. ``ensure`` finds the
distinct addresses of a table of texts, takes those away that the store
already holds for a model (an anti-join on addresses, no text is compared),
embeds the rest and appends them. ``score_pairs`` joins pairs of addresses
with the stored vectors, so its cost in model calls is the number of new texts.

The table is append-only Parquet, one folder a model. One ``ensure`` runs on a
store at a time; a failed one leaves no rows behind, as Spark commits a write as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhit.functions.text import normalize_text
from nearhit.operators.embed import slices
from nearhit.session import exists

CELLS = 1 << 19  # buckets of the rows whose products are formed at a time
SCHEMA = "key binary, bucket array<int>, weight array<double>, model string"


def text_key(c) -> Column:
    """The 128-bit address of a text; null for null."""
    return F.unhex(F.md5(F.col(c) if isinstance(c, str) else c))


@dataclass(frozen=True)
class PredictEmbedder:
    """Any dense model as an embedder of the store: ``make_predict()`` gives a function from a list of texts to (n, dim) numbers.

    The model is loaded once a task; its vectors are scaled to unit length."""
    make_predict: Callable
    dim: int
    batch: int = 32
    normalize: bool = True
    _model: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_model"} | {"_model": {}}

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self._model:
            self._model["predict"] = self.make_predict()
        predict = self._model["predict"]
        known = [i for i, t in enumerate(texts) if t is not None]
        out = [np.asarray(predict([texts[i] for i in known[a:a + self.batch]]), float) for a in range(0, len(known), self.batch)]
        made = np.concatenate([*out, np.zeros((0, self.dim))])
        length = np.sqrt((made * made).sum(axis=1))
        some = length > 0
        made = made[some] / length[some][:, None]
        return np.repeat(np.array(known, np.int64)[some], self.dim), np.tile(np.arange(self.dim), len(made)), made.ravel()


class EmbeddingStore:
    """The embeddings kept under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        """(key, bucket, weight, model) of all stored embeddings; a text without an embedding has empty lists."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def ensure(self, texts: DataFrame, models: dict, text: str = "text") -> int:
        """Embeds what is not stored yet under each of the models; how many embeddings were added. Null texts are passed by."""
        for model in models:
            if not model or "/" in model or "=" in model:
                raise ValueError(f"model key {model!r} cannot name a folder")
        names = list(models)
        own = texts.select(text_key(text).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL")
        own = own.groupBy("key").agg(F.first("text").alias("text"))
        held = self.table().where(F.col("model").isin(names)).select("key", "model")
        had = held.groupBy("key").agg(F.collect_set("model").alias("had"))
        todo = own.join(had, "key", "left").select("key", "text", F.array_except(F.array(*map(F.lit, names)), F.coalesce("had", F.array().cast("array<string>"))).alias("todo"))
        todo = todo.where(F.size("todo") > 0)
        ways = sorted({bool(m.normalize) for m in models.values()})
        rows = todo.select("key", "todo", *[(normalize_text("text") if w else F.col("text")).alias(f"t{i}") for i, w in enumerate(ways)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wanted = batch.column(1).to_pylist()
                prepared = [batch.column(2 + i).to_pylist() for i in range(len(ways))]
                for name, model in models.items():
                    at = np.array([i for i, w in enumerate(wanted) if name in w], np.int64)
                    if not len(at):
                        continue
                    mine = [prepared[ways.index(bool(model.normalize))][i] for i in at.tolist()]
                    for a, z in slices(mine):
                        row, bucket, weight = model.counted(mine[a:z])
                        offsets = pa.array(np.searchsorted(row, np.arange(z - a + 1)).astype(np.int32))
                        yield pa.record_batch([batch.column(0).take(pa.array(at[a:z])), pa.ListArray.from_arrays(offsets, pa.array(bucket.astype(np.int32))),
                                               pa.ListArray.from_arrays(offsets, pa.array(weight)), pa.array([name] * (z - a), pa.string())],
                                              names=["key", "bucket", "weight", "model"])

        made = rows.mapInArrow(run, SCHEMA)
        before = self._count(names)
        made.write.mode("append").partitionBy("model").parquet(self.path)
        return self._count(names) - before

    def _count(self, names: list[str]) -> int:
        return self.table().where(F.col("model").isin(names)).count()

    def score_pairs(self, pairs: DataFrame, models: dict, q1: str = "question1", q2: str = "question2",
                    pair_id: str = "id", label: str | None = "is_duplicate") -> DataFrame:
        """(model_key, pair_id, similarity, label): cosines of stored embeddings, after embedding the texts that are new.

        0 without a shared bucket, null where a side is null or has no embedding."""
        sides = pairs.select(F.explode(F.array(F.col(q1), F.col(q2))).alias("text"))
        self.ensure(sides, models)
        carried = [F.col(pair_id).alias("_id"), *([F.col(label).alias("_label")] if label else [])]
        keyed = pairs.select(*carried, text_key(q1).alias("k1"), text_key(q2).alias("k2"))
        keyed = keyed.withColumn("model", F.explode(F.array(*map(F.lit, models))))
        held = self.table().where(F.col("model").isin(list(models)))
        one, two = (held.select("model", F.col("key").alias(f"k{i}"), F.col("bucket").alias(f"b{i}"), F.col("weight").alias(f"w{i}")) for i in (1, 2))
        both = keyed.join(one, ["model", "k1"], "left").join(two, ["model", "k2"], "left")
        rows = both.select("model", "_id", "b1", "w1", "b2", "w2", *(["_label"] if label else []))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = cosines(*(batch.column(i) for i in range(2, 6)))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(got, mask=np.isnan(got)), *[batch.column(i) for i in range(6, batch.num_columns)]],
                                      names=["model_key", pair_id, "similarity", *([label] if label else [])])

        kinds = dict(rows.dtypes)
        return rows.mapInArrow(run, f"model_key string, `{pair_id}` {kinds['_id']}, similarity double" + (f", `{label}` {kinds['_label']}" if label else ""))


def cosines(b1: pa.Array, w1: pa.Array, b2: pa.Array, w2: pa.Array) -> np.ndarray:
    """Dot products of rows of unit sparse vectors with ascending buckets; NaN where a side is null or empty.

    Rows of about ``CELLS`` buckets are compared at a time."""
    upto = sum(np.cumsum(pc.fill_null(x.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)) for x in (b1, b2))
    out, at = [np.zeros(0)], 0
    while at < len(b1):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, side="right")))
        out.append(_cosines(*(x.slice(at, end - at) for x in (b1, w1, b2, w2))))
        at = end
    return np.concatenate(out)


def _cosines(b1: pa.Array, w1: pa.Array, b2: pa.Array, w2: pa.Array) -> np.ndarray:

    def flat(bucket: pa.Array, weight: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = pc.fill_null(bucket.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return size, np.repeat(np.arange(len(size)), size), bucket.flatten().to_numpy(zero_copy_only=False), weight.flatten().to_numpy(zero_copy_only=False)

    n1, row1, at1, x1 = flat(b1, w1)
    n2, row2, at2, x2 = flat(b2, w2)
    width = int(max(at1.max(initial=0), at2.max(initial=0))) + 1
    cell1, cell2 = row1 * width + at1, row2 * width + at2
    _, i, j = np.intersect1d(cell1, cell2, assume_unique=True, return_indices=True)
    dots = np.bincount(row1[i], x1[i] * x2[j], len(n1))
    return np.where((n1 > 0) & (n2 > 0), dots, np.nan)
