"""Vectors: cosine similarity, brute-force top-k in blocks, and an embedding pass with a pluggable provider."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delvework.session import checkpointed

#: Queries compared in one task at a time.
QUERY_BLOCK = 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where lengths differ, one is empty or has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.coalesce(F.when(ok, dot(a, b) / norm), F.lit(0.0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    m = np.asarray(vectors, dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` nearest of ``corpus(id, vector)`` to each of ``queries(id, vector)``.

    Exact: a stated set of queries meets every row, in blocks. Both sides are packed into blocks of at most ``block``
    vectors of one length and each pair of blocks is one matrix product whose best ``k`` per query are kept, so what is
    shuffled after it is ``k`` rows per query and corpus block. The corpus is read once per block of queries, so the
    queries should be few beside it: their blocks are written once and their numbers, one per ``block`` queries, are
    sent. Vectors only meet vectors of their length; null ids, null and empty vectors are left out.
    """
    q = checkpointed(_blocks(queries, block).select(F.monotonically_increasing_id().alias("q_no"), "width", F.col("ids").alias("q_ids"), F.col("flat").alias("q")))
    c = _blocks(corpus, block).join(F.broadcast(q.select("q_no", "width")), "width")
    # blocks, not rows, are paired
    pairs = c.join(q.drop("width"), "q_no").select("q_ids", "q", "ids", "flat", "width")
    found = pairs.mapInArrow(_best(k, exclude_self), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """``width, ids, flat``: the rows of each batch packed into blocks of at most ``block`` vectors of one length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                for i in range(0, part.num_rows, block):
                    ids, vectors = part.column(0)[i : i + block], part.column(1)[i : i + block]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids.cast(pa.int64()), vectors.flatten().cast(pa.float32()))]
                    yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), *lists], names=["width", "ids", "flat"])

    return rows.where("id IS NOT NULL AND size(vector) > 0").select("id", "vector").mapInArrow(run, "width int, ids array<long>, flat array<float>")


def _best(k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                q_ids, q, ids, c = (batch.column(n)[j].values.to_numpy(zero_copy_only=False) for n in range(4))
                width = batch.column(4)[j].as_py()
                s = np.round(_unit(q.reshape(-1, width)) @ _unit(c.reshape(-1, width)).T, 6)
                if exclude_self:
                    s[q_ids[:, None] == ids[None, :]] = -2.0
                # ties by id: columns in the order of ids, then a stable order by score
                by_id = np.argsort(ids, kind="stable")
                order = by_id[np.argsort(-s[:, by_id], axis=1, kind="stable")[:, :k]]
                score = np.take_along_axis(s, order, axis=1)
                keep = score > -2.0
                row = np.broadcast_to(np.arange(len(q_ids))[:, None], order.shape)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[order[keep]]), pa.array(score[keep])], names=["query_id", "id", "score"])

    return run


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A deterministic stand-in for an embedding service: hashed words, signed and normalized."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]] = hashed_embedding, batch: int = 32, known: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, keep, vector`` of chunks that ``known(id)`` lacks, asked of ``provider`` in batches inside the tasks.

    A provider that returns another number of vectors than texts, or vectors of different lengths, raises.
    """
    todo = chunks.where("id IS NOT NULL AND content IS NOT NULL").select("id", "content", *keep).dropDuplicates(["id"])
    if known is not None:
        todo = todo.join(known.select("id"), "id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            vectors: list[list[float]] = []
            for i in range(0, len(texts), batch):
                got = provider(texts[i : i + batch])
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError(f"{len(got)} vectors for {len(texts[i : i + batch])} texts")
                vectors += got
            if len({len(v) for v in vectors}) > 1:
                raise ValueError("vectors of different lengths")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(b.column(c) for c in keep), pa.array(vectors, pa.list_(pa.float32()))], names=["id", *keep, "vector"])

    return todo.mapInArrow(run, ", ".join(["id string", *(f"{c} {todo.schema[c].dataType.simpleString()}" for c in keep), "vector array<float>"]))


def embed_query(text: str, provider: Callable[[list[str]], list[list[float]]] = hashed_embedding) -> list[float]:
    """The vector of one query."""
    (vector,) = provider([text])
    return [float(x) for x in vector]


def near(rows: DataFrame, vector: Column | list[float], limit: int, module: str | None = None) -> DataFrame:
    """``id, score, rank``: the rows of ``rows(id, vector, ...)`` nearest to one vector, of a module if it is given."""
    from delvework.operators import fusion

    if module is not None:
        rows = rows.where(F.col("module") == module)
    asked = vector if isinstance(vector, Column) else F.lit(vector)
    scored = rows.where("id IS NOT NULL AND vector IS NOT NULL").withColumn("_asked", asked)
    return fusion.top(scored.select("id", F.round(cosine(F.col("vector"), F.col("_asked")), 6).alias("score")), limit)
