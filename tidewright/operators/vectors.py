"""Vectors: deterministic embeddings, exact cosine search, and an index of cells for approximate search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.paths import locate

#: Components of an embedding, and the namespace of point ids. (fixed values)
SIZE = 384
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def embedding_text(entity_type: Column, value: Column, tags: Column | None = None, metadata: Column | None = None) -> Column:
    """Type, value, sorted tags and, if asked, metadata in one text; empty parts are left out."""
    parts = [F.nullif(entity_type, F.lit("")), F.nullif(value, F.lit(""))]
    if tags is not None:
        parts.append(F.nullif(F.array_join(F.array_sort(tags), " "), F.lit("")))
    if metadata is not None:
        calm = F.map_filter(metadata, lambda k, v: ~k.isin("enriched_at"))
        parts.append(F.nullif(F.array_join(F.transform(F.array_sort(F.map_entries(calm)), lambda e: F.concat_ws("=", e["key"], e["value"])), " "), F.lit("")))
    return F.concat_ws(" ", *parts)


def hash_embedding(text: Column, size: int = SIZE) -> Column:
    """Unit vector from SHA-256 of the lower-case text and a block number; null stays null."""
    return _embed(size)(F.lower(text))


def _embed(size: int):
    """The vectors of a batch at once; as one expression every component would compute all components again."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [t.encode() for t in texts.to_pylist() if t is not None]
        blocks = [str(i).encode() for i in range((size - 1) // 32 + 1)]
        raw = b"".join(hashlib.sha256(t + i).digest() for t in rows for i in blocks)
        v = np.frombuffer(raw, np.uint8).reshape(len(rows), 32 * len(blocks))[:, :size] / 127.5 - 1.0
        norm = np.sqrt(np.cumsum(v * v, axis=1)[:, -1:])
        v = np.divide(v, norm, out=v, where=norm > 0)
        ends = np.concatenate([[0], np.cumsum(~texts.is_null().to_numpy(zero_copy_only=False))]) * size
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.ravel()), mask=texts.is_null())

    return F.arrow_udf(run, "array<double>")


def point_id(entity_id: Column) -> Column:
    """Number of an id in the vector store: the low bits of its name-based UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(entity_id, "utf-8")))
    return F.pmod(F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)"), F.lit(2**62).cast("decimal(20,0)")).cast("bigint")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one is null, empty, zero or of another length."""
    d = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (d > 0), dot(a, b) / d)


def top_k(df: DataFrame, query: list[float], k: int = 10, vector: str = "embedding", key: str = "vec_id", **equal) -> DataFrame:
    """The ``k`` rows nearest to one query vector, with ``score``; ties go to the lower key, filters are equalities."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("score", cosine(F.col(vector), q)).where("score is not null").orderBy(F.desc("score"), key).limit(k)


#: Queries that are held against a task's rows at a time.
BLOCK = 1024
_FOUND = "query_id bigint, k bigint, score double"


def _matrix(column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows they are of): rows of another length than ``size``, or of none, are left out."""
    lengths = np.diff(column.offsets.to_numpy())
    fit = (lengths == (size or (lengths.max() if len(lengths) else 0))) & (lengths > 0)
    if not fit.any():
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    x = column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(fit.sum()), -1)
    norm = np.linalg.norm(x, axis=1)
    keep = norm > 0
    return x[keep] / norm[keep, None], np.flatnonzero(fit)[keep]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row of ``scores``; ties go to the lower id."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return ids[order], np.take_along_axis(scores, order, 1)


def _result(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["query_id", "k", "score"])


def _ranked(parts: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "k")
    return parts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("query_id", F.col("k").alias(key), "score", "rank")


def _plain(df: DataFrame, vector: str, key: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("i"), F.col(vector).cast("array<float>").alias("v")).where("i is not null and v is not null and size(v) > 0")


def search(df: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank): the ``k`` nearest rows of each query vector, exact.

    The queries are a table in the shared folder.  The rows are scanned once;
    a task holds one Arrow batch of them, reads the queries block by block and
    gives its best ``k`` per query, so nothing passes the driver and memory
    doesn't grow with either side.  A query finds itself if it is a row.
    Vectors of another length than the query, null or zero ones aren't found.
    """
    table = materialize(_plain(queries, vector, key), "queries")
    files = table.inputFiles()

    def run(batches):
        import pyarrow.parquet as pq

        for rows in batches:
            for path in files:
                system, at = locate(path)
                for block in pq.ParquetFile(at, filesystem=system).iter_batches(BLOCK, columns=["i", "v"]):
                    for size in np.unique(np.diff(block.column(1).offsets.to_numpy())):
                        q, which = _matrix(block.column(1), int(size))
                        x, own = _matrix(rows.column(1), int(size))
                        if len(q) and len(x):
                            ids = rows.column(0).to_numpy(zero_copy_only=False)[own]
                            yield _result(block.column(0).to_numpy(zero_copy_only=False)[which], *_best(ids, q @ x.T, k))

    return _ranked(_plain(df, vector, key).mapInArrow(run, _FOUND), k, key)


#: Rows the centres of an index are fitted on at most, a random choice; every row is indexed.
SAMPLE = 20_000
#: Rows of one cell that a task holds at a time.
SHARD = 20_000


def fit_cells(df: DataFrame, cells: int = 64, vector: str = "embedding", key: str = "vec_id", sample: int = SAMPLE, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of an index by spherical k-means on at most ``sample`` rows, those of the lowest hash."""
    rows = _plain(df, vector, key).orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    size = max(len(r[1]) for r in rows)
    x = np.array([r[1] for r in rows if len(r[1]) == size], np.float64)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((0, 0))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def _near(centres: np.ndarray, n: int):
    """Cells of each vector of a batch: the ``n`` nearest ones."""

    def run(batches):
        for b in batches:
            x, own = _matrix(b.column(1), centres.shape[1])
            at = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]
            take = pa.array(np.repeat(own, at.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel().astype(np.int32)), b.column(0).take(take), b.column(1).take(take)], names=["cell", "i", "v"])

    return run


def search_cells(df: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """As :func:`search`, looking only into the ``probes`` cells nearest to each query: approximate, the scores exact.

    Every row is indexed, in the cell of its nearest centre.  A cell is cut
    into shards of about ``SHARD`` rows by a hash of the key, so one that holds
    a third of all rows is many tasks; its queries go to each of its shards.
    """
    spark = df.sparkSession
    if not centres.size:
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, score double, rank bigint")
    schema = "cell int, i bigint, v array<float>"
    rows = materialize(_plain(df, vector, key).mapInArrow(_near(centres, 1), schema), "cells")
    # At most as many rows as centres.
    shards = rows.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    shards = F.broadcast(spark.createDataFrame(shards.collect(), "cell int, shards int"))
    rows = rows.join(shards, "cell").select("cell", F.pmod(F.xxhash64("i"), F.col("shards")).cast("int").alias("shard"), "i", "v")
    asked = _plain(queries, vector, key).mapInArrow(_near(centres, probes), schema).join(shards, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "i", "v")

    def run(left, right):
        x, own = _matrix(left.column("v").combine_chunks(), centres.shape[1])
        ids = left.column("i").to_numpy()[own]
        names = right.column("i").to_numpy()
        parts = []
        for start in range(0, right.num_rows, BLOCK):
            q, which = _matrix(right.column("v").slice(start, BLOCK).combine_chunks(), centres.shape[1])
            if len(q) and len(x):
                parts.append(_result(names[start:][which], *_best(ids, q @ x.T, k)))
        return pa.Table.from_batches(parts, pa.schema([("query_id", pa.int64()), ("k", pa.int64()), ("score", pa.float64())]))

    found = rows.groupBy("cell", "shard").cogroup(asked.groupBy("cell", "shard")).applyInArrow(run, _FOUND)
    return _ranked(found, k, key)


def recall(exact: DataFrame, found: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row (queries, recall): the part of the exact neighbours that were found."""
    hit = exact.select("query_id", key).join(found.select("query_id", key).withColumn("hit", F.lit(1)), ["query_id", key], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.coalesce(F.sum("hit") / F.count("*"), F.lit(1.0)).alias("recall"))


def index_report(df: DataFrame, text: str = "text") -> DataFrame:
    """One row (indexed, failed): a null or empty text can't be embedded."""
    ok = F.coalesce(F.trim(text) != "", F.lit(False))
    return df.agg(F.count_if(ok).alias("indexed"), F.count_if(~ok).alias("failed"))


def delete(df: DataFrame, gone: DataFrame, key: str = "vec_id") -> DataFrame:
    """Points without those whose key is in ``gone``."""
    return df.join(gone.select(key).distinct(), key, "left_anti").select(*df.columns)


def upsert(stored: DataFrame, new: DataFrame, key: str = "vec_id", at: str = "indexed_at") -> DataFrame:
    """The latest version of every point."""
    cols = stored.columns
    rows = stored.unionByName(new.select(*cols))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in cols if c != key]), at).alias("w")).select(key, "w.*").select(*cols)


def stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: points, points with a vector, dimension, whether all have it."""
    n = F.size(vector)
    return df.agg(F.count("*").alias("points"), F.count(vector).alias("indexed"), F.max(n).cast("bigint").alias("dimension"), F.coalesce(F.min(n) == F.max(n), F.lit(True)).alias("uniform"))
