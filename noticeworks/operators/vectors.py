"""Vectors: cosine top-k, centroids, k-means from given centres, a hashing encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from noticeworks.storage import spool


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)


def nearest(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, block: int = 2048) -> DataFrame:
    """(query_id, key, similarity, rank): for each query the k most similar other vectors by cosine, exact.

    The queries come in blocks of about ``block``, each a bounded broadcast; every task
    multiplies its vectors with the block and keeps k per query, so what is shuffled
    is k rows per query and task. Equal similarities go to the smaller key. Null
    vectors are left out.
    """
    spark = vectors.sparkSession
    clean = vectors.select(key, vector).where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    asked_for = queries.select(key, vector).where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    n_blocks = -(-asked_for.count() // block)
    numbered = asked_for.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(max(1, n_blocks))))
    parts = []
    for b in range(int(n_blocks)):
        part = numbered.where(F.col("_block") == b).orderBy(key).toPandas()
        if not len(part):
            continue
        sent = spark.sparkContext.broadcast((part[key].to_numpy(), unit(np.stack(part[vector].to_numpy()).astype(np.float64))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, asked = sent.value
            best: list = [(np.empty(0), np.empty(0, np.int64)) for _ in names]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(key).to_numpy(zero_copy_only=False)
                scores = asked @ unit(matrix(batch.column(vector))).T
                for q, name in enumerate(names):
                    row = np.where(ids == name, -np.inf, scores[q])
                    s, i = np.concatenate([best[q][0], row]), np.concatenate([best[q][1], ids])
                    top = np.lexsort((i, -s))[:k]
                    best[q] = s[top], i[top]
            rows = [(name, int(i), float(s)) for name, (ss, ii) in zip(names, best, strict=True) for s, i in zip(ss, ii, strict=True) if np.isfinite(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", key, "similarity"])

        parts.append(clean.mapInArrow(run, f"query_id long, `{key}` long, similarity double"))
    if not parts:
        return spark.createDataFrame([], f"query_id long, `{key}` long, similarity double, rank int")
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), key))).where(F.col("rank") <= k)


def coarse_index(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, centres: int = 256, sample: int = 20_000, rounds: int = 10, recall: float = 0.97) -> tuple[np.ndarray, int]:
    """(centres, probes) of an index, fitted on the ``sample`` vectors whose keys hash lowest; only the fit is bounded, every vector is indexed.

    ``probes`` is the number of cells that hold ``recall`` of the true neighbours of
    up to 500 of the sample's vectors among the sample.
    """
    drawn = vectors.select(key, vector).where(F.col(vector).isNotNull() & F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).toPandas()
    if not len(drawn):
        return np.zeros((0, 0)), 0
    x = unit(np.stack(drawn[vector].to_numpy()).astype(np.float64))
    found = x[: min(centres, max(1, len(x) // 32))].copy()
    for _ in range(rounds):
        near = (x @ found.T).argmax(1)
        for c in range(len(found)):
            own = x[near == c]
            if len(own):
                found[c] = unit(own.sum(0, keepdims=True))[0]
    cell = (x @ found.T).argmax(1)
    asked = x[:500]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ found.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, cell[true], axis=1).ravel())
    return found, int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def nearest_by_index(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, centres: int = 256, recall: float = 0.97, chunk: int = 50_000) -> DataFrame:
    """(query_id, key, similarity, rank): like ``nearest``, through an index of cells round centres.

    A query looks into as many of the nearest cells as the sample needed for
    ``recall``. Cells and queries meet in one shuffle by (cell, part); a cell is cut
    into parts of about ``chunk`` vectors, so a cell that a third of all vectors fill
    is spread over many tasks. Nothing but the centres is broadcast. Recall against
    ``nearest`` is measured in the tests.
    """
    found, most = coarse_index(vectors, key=key, vector=vector, k=k, centres=centres, recall=recall)
    spark = vectors.sparkSession
    out = f"query_id long, `{key}` long, similarity double"
    if not len(found):
        return spark.createDataFrame([], out + ", rank int")
    sent = spark.sparkContext.broadcast(found)

    def cells_of(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(-(unit(matrix(batch.column(vector))) @ sent.value.T), axis=1, kind="stable")[:, :n]
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, n), pa.int32()), pa.array(near.ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(vector), cells], [key, vector, "cells"])

        return run

    schema = f"`{key}` long, `{vector}` {vectors.schema[vector].dataType.simpleString()}, cells array<int>"
    clean = lambda rows: rows.select(key, vector).where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    placed = spool(clean(vectors).mapInArrow(cells_of(1), schema).select(key, vector, F.col("cells")[0].alias("cell")), "cells")
    # One row for each centre.
    parts = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")).limit(len(found)))
    held = placed.join(parts, "cell").select("cell", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), key, vector)
    asked = clean(queries).mapInArrow(cells_of(most), schema).select(F.col(key).alias("query_id"), F.col(vector).alias("q"), F.explode("cells").alias("cell"))
    asked = asked.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "q")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            ids, x = left[key].to_numpy(), unit(np.stack(left[vector].to_numpy()).astype(np.float64))
            for start in range(0, len(right), 512):
                some = right.iloc[start : start + 512]
                scores = unit(np.stack(some["q"].to_numpy()).astype(np.float64)) @ x.T
                for name, line in zip(some["query_id"], scores, strict=True):
                    line = np.where(ids == name, -np.inf, line)
                    top = np.lexsort((ids, -line))[:k] if len(ids) < 4 * k else (t := np.argpartition(-line, 2 * k)[: 2 * k])[np.lexsort((ids[t], -line[t]))][:k]
                    rows += [(name, ids[t], line[t]) for t in top if np.isfinite(line[t])]
        return pd.DataFrame(rows, columns=["query_id", key, "similarity"])

    met = held.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInPandas(search, out)
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), key))).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in generated code, doubles throughout."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, pos, mean, n): the mean vector of each group, one row for each component."""
    each = vectors.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(group, F.posexplode(vector).alias("pos", "x"))
    return each.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def assigned(vectors: DataFrame, centres: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, similarity): the most similar of a bounded set of centres, the first of equals."""
    sent = vectors.sparkSession.sparkContext.broadcast(unit(centres.astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = unit(matrix(batch.column(vector))) @ sent.value.T
                best = scores.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(best, pa.int32()), pa.array(scores[np.arange(len(best)), best])], [key, "cluster", "similarity"])

    return vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"`{key}` long, cluster int, similarity double")


def kmeans(vectors: DataFrame, start: list, *, key: str = "vec_id", vector: str = "embedding", rounds: int = 50, tolerance: float = 1e-4) -> tuple[DataFrame, np.ndarray]:
    """Cosine k-means from the vectors named in ``start``; an empty cluster keeps its centre. Each round is one scan that returns k sums."""
    rows = {r[key]: r[vector] for r in vectors.where(F.col(key).isin(*start)).select(key, vector).collect()}
    centres = unit(np.array([rows[s] for s in start], np.float64))
    for _ in range(rounds):
        sent = vectors.sparkSession.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pd.DataFrame]:
            c = sent.value
            sums, counts = np.zeros_like(c), np.zeros(len(c))
            for batch in batches:
                if batch.num_rows:
                    x = unit(matrix(batch.column(vector)))
                    best = (x @ c.T).argmax(1)
                    np.add.at(sums, best, x)
                    counts += np.bincount(best, minlength=len(c))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(counts.astype(np.int64)), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["cluster", "n", "total"])

        parts = vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, "cluster int, n long, total array<double>")
        each = parts.select("cluster", "n", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # k x dimensions
        new = centres.copy()
        sums = np.zeros_like(centres)
        counts = np.zeros(len(centres))
        for r in each:
            sums[r.cluster, r.pos] = r.x
            counts[r.cluster] = r.n
        new[counts > 0] = unit(sums[counts > 0] / counts[counts > 0, None])
        moved = np.abs(new - centres).max()
        centres = new
        if moved < tolerance:
            break
    return assigned(vectors, centres, key, vector), centres


@F.pandas_udf(ArrayType(FloatType()))
def hashed_encoding(texts: pd.Series) -> pd.Series:
    """A deterministic 64-dimensional encoding by signed word hashes, for use where no model is at hand."""

    def encode(text: str | None) -> list[float]:
        v = np.zeros(64)
        for w in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % 64] += 1 if h >> 63 else -1
        return (v / (np.linalg.norm(v) + 1e-9)).astype(np.float32).tolist()

    return texts.map(encode)
