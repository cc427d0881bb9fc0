"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order, and posted in the inverted files of the ``posted``
first of them. The index is cut into segments of bounded size, each with its own inverted files; queries come in
blocks, and a block meets each segment in one group. A query visits the files of its own nearest pivots, ranks what it
finds by footrule distance (the summed differences of a pivot's places in the two orders; a missing pivot stands at
place ``prefix``), reranks the best ``share`` of the segment, and all that is very near, by exact Euclidean distance, and hands on its
best k + 1.

Equal vectors form a class; only classes are posted, and a class keeps its smallest member ids, so copies neither fill
a file nor hide other neighbours, and ties are settled exactly. The pivots are spread rows of a bounded sample of the
classes; their number grows with the square root of the table up to ``MOST_PIVOTS``, and only they are broadcast.
A query that finds fewer than ``k`` is answered exactly, by a scan of all classes.

The given vectors are close to uniform on a sphere, where all distances are alike: hence the long orders and the large
share. Clustered vectors need less of either.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part.
Repeated rows of the same id and vector count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.tables import col
from matchloom.plans.scratch import materialise

#: Fitting: at most so many pivots, a sample of the classes.
MOST_PIVOTS = 2048
#: Pivots in an order, and the nearest of them in whose files a vector is posted.
PREFIX, POSTED = 96, 32
#: Part of a segment that is reranked, and the least number.
SHARE, LEAST = 0.15, 400
#: Whatever is nearer than this part of the median footrule distance is reranked too, however many these are.
NEAR = 0.5
SEGMENT_ROWS = 8_000
_QUERIES = 512


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` with v as doubles, of rows that take part; of an id's different vectors the least in order."""
    v = col(vector_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = rows.filter(col(id_col).isNotNull() & v.isNotNull() & good).select(col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    return kept.groupBy("id").agg(F.min("v").alias("v"))


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """``class, v, ids``: equal vectors together, with their k + 1 smallest ids.

    A task combines each batch first, so a class that holds a third of all rows sends k + 1 ids for each batch.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            order = np.argsort(batch.column("id").to_numpy())
            ids, x = batch.column("id").to_numpy()[order], _stack(batch.column("v"))[order] + 0.0
            for i, row in zip(ids.tolist(), x):
                mine = found.setdefault(row.tobytes(), [])
                if len(mine) <= k:
                    mine.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.frombuffer(r) for r in found], pa.list_(pa.float64())), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["v", "ids"]
            )

    packed = vectors.mapInArrow(combine, "v array<double>, ids array<long>")
    least = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1)
    return packed.groupBy("v").agg(least.alias("ids")).select(F.xxhash64("v").alias("class"), "v", "ids")


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the lower number."""
    near = (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    if prefix >= len(pivots):
        return np.argsort(near, axis=1, kind="stable").astype(np.int32)
    some = np.sort(np.argpartition(near, prefix - 1, axis=1)[:, :prefix], axis=1)
    within = np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, within, 1).astype(np.int32)


def footrule(query: np.ndarray, posted: np.ndarray, n_pivots: int) -> np.ndarray:
    """Distance of one order to many, over the pivots of either; a missing pivot stands at place ``prefix``."""
    prefix = len(query)
    place = np.full(n_pivots, prefix, np.int16)
    place[query] = np.arange(prefix)
    at = place[posted]
    # pivots that only the query has: all of its gaps, less those of the shared ones
    gap = prefix * (prefix + 1) // 2 - (prefix - at).sum(1, dtype=np.int32)
    return np.abs(at - np.arange(prefix, dtype=np.int16)).sum(1, dtype=np.int32) + gap


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of a sample that lie far apart: each next one is the farthest from those before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of x to y, every row by itself, in double precision."""
    return np.sqrt(((x - y) ** 2).sum(1))


def _orders(pivots, prefix: int):
    """Adds the order of the nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = orders(_stack(batch.column("v")), pivots.value, prefix).astype(np.int16)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int16()))], names=[*batch.schema.names, "order"])

    return run


def _visit(n_pivots: int, posted_prefix: int, share: float, least: int, k: int):
    """One segment of the index and one block of queries: visit the files, rank by footrule, rerank the best."""

    def run(table: pa.Table) -> pa.Table:
        is_query = table["query"].is_valid().to_numpy(zero_copy_only=False)
        out: dict[str, list] = {"query": [], "ids": [], "score": []}
        if is_query.any() and not is_query.all():
            segment, asked = table.filter(pa.array(~is_query)), table.filter(pa.array(is_query))
            x, order, ids = _stack(segment["v"]), _stack(segment["order"]), segment["ids"]
            first = np.array([i[0] for i in ids.to_pylist()])
            posts = order[:, :posted_prefix].ravel()
            by_pivot = np.argsort(posts, kind="stable")
            edges = np.searchsorted(posts[by_pivot], np.arange(n_pivots + 1))
            rows = (by_pivot // min(posted_prefix, order.shape[1])).astype(np.int64)
            keep = max(least, int(share * len(x)))
            for q, v, mine in zip(asked["query"].to_pylist(), _stack(asked["v"]), _stack(asked["order"])):
                met = np.zeros(len(x), bool)
                for p in mine[:posted_prefix]:
                    met[rows[edges[p] : edges[p + 1]]] = True
                found = np.flatnonzero(met)
                if len(found) > keep:
                    far = footrule(mine, order[found], n_pivots)
                    best = np.lexsort((first[found], far))
                    close = np.searchsorted(far[best], NEAR * np.median(far), side="right")
                    found = found[best[: max(keep, close)]]
                score = distances(x[found], v)
                best = np.lexsort((first[found], score))[: k + 1]
                out["query"] += [q] * len(best)
                out["ids"].append(ids.take(pa.array(found[best])).combine_chunks())
                out["score"] += score[best].tolist()
        lists = pa.concat_arrays(out["ids"]) if out["ids"] else pa.array([], pa.list_(pa.int64()))
        return pa.table([pa.array(out["query"], pa.int64()), lists, pa.array(out["score"], pa.float64())], names=list(out))

    return run


def _nearest(measured: DataFrame, k: int) -> DataFrame:
    """Members of the classes, without the query itself, ranked by distance and id. A query's rows are bounded."""
    rows = measured.select("query", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def _scan_all(classes: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """A few queries against all classes; each batch returns its best k + 1 classes for each query."""
    shared = classes.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, first = _stack(batch.column("v")), np.array([i[0] for i in batch.column("ids").to_pylist()])
            for query, v in shared.value:
                far = distances(x, np.array(v))
                best = pa.array(np.lexsort((first, far))[: k + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * len(best), pa.int64()), batch.column("ids").take(best), pa.array(far).take(best)], names=["query", "ids", "score"]
                )

    return classes.mapInArrow(run, "query long, ids array<long>, score double")


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    prefix: int = PREFIX,
    posted: int = POSTED,
    share: float = SHARE,
    most_pivots: int = MOST_PIVOTS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows where ``is_query`` (of the column ``id``), the k nearest others."""
    spark = rows.sparkSession
    valid = valid_vectors(rows, id_col, vector_col)
    size = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = materialise(valid.filter(F.size("v") == size["d"]), "vectors")
    classes = materialise(classes_of(vectors, k), "classes")
    n = classes.count()
    wanted = int(min(most_pivots, max(32, 2 * n**0.5), n))
    chosen = classes.orderBy(F.xxhash64("class", F.lit("pivot")), "class").limit(4 * wanted).select("v").collect()
    pivots = spark.sparkContext.broadcast(spread(np.array([r["v"] for r in chosen]), wanted))
    queries = materialise(vectors.filter(is_query).select(F.col("id").alias("query"), F.col("v").alias("qv")), "queries")

    segments, blocks = n // segment_rows + 1, queries.count() // _QUERIES + 1
    find = _orders(pivots, min(prefix, wanted))
    index = classes.mapInArrow(find, "class long, v array<double>, ids array<long>, order array<short>")
    asked = queries.select("query", F.col("qv").alias("v")).mapInArrow(find, "query long, v array<double>, order array<short>")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    posts = index.select(F.pmod(F.xxhash64("class"), F.lit(segments)).cast("int").alias("segment"), every(blocks).alias("block"), F.lit(None).cast("long").alias("query"), "ids", "v", "order")
    visits = asked.select(every(segments).alias("segment"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), "query", F.lit(None).cast("array<long>").alias("ids"), "v", "order")
    tiles = posts.unionAll(visits).repartition(max(segments * blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "segment", "block")
    found = tiles.groupBy("segment", "block").applyInArrow(_visit(wanted, min(posted, prefix, wanted), share, LEAST, k), "query long, ids array<long>, score double")
    near = materialise(_nearest(found, k), "nearest")

    most = min(k, vectors.count() - 1)
    got = near.groupBy("query").agg(F.count(F.lit(1)).alias("c"))
    lacking = materialise(queries.join(got, "query", "left").filter(F.coalesce("c", F.lit(0)) < most).select("query", "qv"), "lacking")
    out, block = near.join(lacking, "query", "left_anti"), []

    def flush(out: DataFrame) -> DataFrame:
        return out.unionByName(_nearest(_scan_all(classes, block, k), k))

    for row in lacking.toLocalIterator():
        block.append((row["query"], row["qv"]))
        if len(block) == _QUERIES:
            out, block = flush(out), []
    if block:
        out = flush(out)
    return out.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def report(rows: DataFrame) -> DataFrame:
    """Queries: ids divisible by 100; the 10 nearest others of each."""
    return search(rows, F.col("id") % 100 == 0)
