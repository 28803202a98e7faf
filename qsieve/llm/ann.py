"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and padded to unit length, so that the
largest inner product is the smallest distance.  A table hashes a vector with a
few Gaussian (2-stable) projections cut into cells of width `width`; a query
visits the buckets of a table in the order of their estimated success: each
cell's probability under a normal model of a near neighbour's projection given
the query's.  Candidates of all tables merge and are ranked by exact inner
products of the original vectors.

The index holds every vector.  What is fitted, on SAMPLE queries (a documented
bound): the model, and the fewest probes per table that reach TARGET recall
against a full scan for those queries.  Where MOST probes do not reach it, a
projection is dropped and both are fitted again; one projection always does.

Equal vectors are one index entry with their smallest `k + 1` ids (no query can
need more of them), and equal queries are one search.  A bucket beyond PART
entries is split into salted parts, each visited by the bucket's queries.

Defined results: vectors that are null, zero, hold null or non-finite
components, or have another length than most (smaller length on ties) take no
part, nor do rows without id; equal rows count once; ties go to the smaller id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import binary_parts, spread
from .frames import kept, salted

SAMPLE, TARGET = 96, 0.95
PART = 1 << 15     # entries of a bucket searched as one part
BLOCK = 256        # queries scored at once
BUCKET = 16384      # entries a bucket is meant for
CELLS = 6          # cells of a projection, the outer two unbounded
MOST = 1 << 12     # probes of a query per table


@dataclass
class Index:
    """Projections, cells, and the fitted probing model."""

    dim: int
    norm: float            # largest norm of all vectors
    axes: np.ndarray       # (tables, projections, dim + 1)
    shift: np.ndarray      # (tables, projections)
    width: float
    slope: float = 0.5     # of a neighbour's projection on the query's
    spread: float = 0.8    # its standard deviation
    probes: int = 1

    def project(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(rows, tables, projections), in cells."""
        if query:
            unit = np.hstack([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros((len(vectors), 1))])
        else:
            x = vectors / self.norm
            unit = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])
        return np.einsum("nd,tpd->ntp", unit, self.axes)

    def cells(self, projected: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((projected + self.shift) / self.width) + CELLS // 2, 0, CELLS - 1).astype(np.int64)

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket numbers."""
        out = np.zeros(cells.shape[:2], np.int64)
        for p in range(cells.shape[2]):
            out = out * CELLS + cells[:, :, p]
        return out

    def ranked(self, projected: np.ndarray, most: int) -> np.ndarray:
        """(rows, tables, up to `most`) buckets of queries, likeliest first.
        Sequences grow one projection at a time and keep the likeliest."""
        cdf = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
        edges = (np.arange(1, CELLS) - CELLS // 2) * self.width
        at = (edges[None, None, None, :] - self.shift[None, :, :, None] - self.slope * projected[..., None]) / self.spread
        below = np.concatenate([np.zeros((*projected.shape, 1)), cdf(at), np.ones((*projected.shape, 1))], axis=3)
        chance = np.log(np.maximum(np.diff(below, axis=3), 1e-300))
        n, t, _ = projected.shape
        number, total = np.zeros((n, t, 1), np.int64), np.zeros((n, t, 1))
        for p in range(projected.shape[2]):
            number = (number[..., None] * CELLS + np.arange(CELLS)).reshape(n, t, -1)
            total = (total[..., None] + chance[:, :, p, None, :]).reshape(n, t, -1)
            if number.shape[2] > most:
                order = np.argsort(-total, axis=2, kind="stable")[:, :, :most]
                number, total = np.take_along_axis(number, order, 2), np.take_along_axis(total, order, 2)
        order = np.argsort(-total, axis=2, kind="stable")
        return np.take_along_axis(number, order, 2)


def _unpack(col, dim: int) -> np.ndarray:
    return binary_parts(col)[0].copy().view("<f8").reshape(-1, dim)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, size, raw = [], [], []
        for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_pylist()):
            if i is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, "<f8") + 0.0
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                size.append(len(x))
                raw.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "dim", "vec"])


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: largest score, then smallest id."""
    if len(scores) > 4 * k:
        line = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= line)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _scan(queries: np.ndarray, k: int):
    """A full scan for a few queries: each batch's best per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unpack(batch["vec"], queries.shape[1])
            names = np.arange(len(v))
            s = queries @ v.T
            best = [_top(s[q], names, k) for q in range(len(queries))]
            pick = np.concatenate(best)
            q = np.repeat(np.arange(len(queries)), [len(b) for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(s[q, pick]), batch["cls"].take(pa.array(pick)), batch["vec"].take(pa.array(pick))], ["q", "score", "cls", "vec"])

    return run


def fit(classes: DataFrame, queries: DataFrame, dim: int, k: int, tables: int = 2, seed: int = 7) -> Index:
    """An index for classes(cls, vec); probes fitted on SAMPLE queries."""
    n, norm = classes.select(F.count(F.lit(1)), F.max("norm")).first()
    width_of = max(1, math.ceil(math.log(max(n / BUCKET, 1.01)) / math.log(CELLS)))
    rng = np.random.default_rng(seed)
    axes = rng.standard_normal((tables, width_of, dim + 1))
    index = Index(dim, norm or 1.0, axes, rng.uniform(-0.25, 0.25, (tables, width_of)), 0.8)
    sample = [r.vec for r in queries.orderBy("cls").limit(SAMPLE).select("vec").collect()]
    if not sample:
        return index
    q = np.frombuffer(b"".join(sample), "<f8").reshape(-1, dim)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    near = classes.select("cls", "vec").mapInArrow(_scan(q, k + 1), "q long, score double, cls string, vec binary")
    near = near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1).select("q", "vec").collect()
    of = np.array([r.q for r in near])
    v = np.frombuffer(b"".join(r.vec for r in near), "<f8").reshape(-1, dim)
    self_hit = (v == q[of]).all(1)
    of, v = of[~self_hit], v[~self_hit]
    if not len(of):
        return index
    for use in range(width_of, 0, -1):
        index.axes, index.shift = index.axes[:, :use], index.shift[:, :use]
        asked, there = index.project(q, True), index.project(v, False)
        index.slope = float((asked[of] * there).sum() / (asked[of] ** 2).sum())
        index.spread = max(0.05, float((there - index.slope * asked[of]).std()))
        most = min(CELLS ** use, max(CELLS, MOST))
        order, bucket = index.ranked(asked, most), index.buckets(index.cells(there))
        place = np.where(order[of] == bucket[..., None], np.arange(order.shape[2]), most).min(axis=2).min(axis=1)
        recall = np.cumsum(np.bincount(place, minlength=most + 1)[:most]) / len(place)
        if (recall >= TARGET).any():
            index.probes = int(np.argmax(recall >= TARGET)) + 1
            break
    return index


def _entries(index, query: bool):
    """Index rows or probe rows: (bucket, role, cls, vec, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                v = x.project(_unpack(part["vec"], x.dim), query)
                number = x.ranked(v, x.probes)[:, :, :x.probes] if query else x.buckets(x.cells(v))[:, :, None]
                table = np.broadcast_to(np.arange(v.shape[1])[None, :, None], number.shape)
                row = np.repeat(np.arange(len(v)), number.shape[1] * number.shape[2])
                bucket = (number + (table << 52)).ravel()
                take = pa.array(row)
                ids = part["ids"].take(take) if not query else pa.array([None] * len(row), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(row), int(query), np.int32)), part["cls"].take(take), part["vec"].take(take), ids],
                                                 ["bucket", "role", "cls", "vec", "ids"])

    return run


ENTRY = "bucket long, role int, cls string, vec binary, ids array<bigint>"


def _rank(dim: int, k: int):
    """Rows sorted by (bucket, salt, role): entries (role 0), then queries.
    Each query's best k + 1 of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            bucket, salt, role = (x[c].to_numpy() for c in ("bucket", "salt", "role"))
            head = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])))
            ends = np.append(head[1:], len(bucket))
            vec = _unpack(x["vec"], dim)
            out_q, out_id, out_s = [], [], []
            names = x["cls"].to_pylist()
            for a, z in zip(head, ends):
                m = a + int(np.searchsorted(role[a:z], 1))
                if m == a or m == z:
                    continue
                ids = x["ids"].slice(a, m - a)
                owner = np.repeat(np.arange(m - a), [len(i) for i in ids])
                flat = np.array(list(itertools.chain.from_iterable(ids.to_pylist())))
                for b in range(m, z, BLOCK):
                    score = vec[b:min(b + BLOCK, z)] @ vec[a:m].T
                    for q in range(len(score)):
                        best = _top(score[q][owner], flat, k + 1)
                        out_q += [names[b + q]] * len(best)
                        out_id.append(flat[best])
                        # one order of summing for every pair, whatever the part's shape
                        out_s.append((vec[a:m][owner[best]] * vec[b + q]).sum(axis=1))
            last = ends[-1] - head[-1]
            m = int(np.searchsorted(role[head[-1]:], 1))
            held = x.slice(head[-1], m) if m else None
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(out_q), pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_s))], ["cls", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = 2) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row of
    vectors(vec_id, embedding) for which the condition `is_query` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(_valid, "vec_id long, dim int, vec binary")
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = common.dim if common else 1
    rows = kept(rows.filter(F.col("dim") == dim).select("vec_id", "vec", F.md5("vec").alias("cls")).distinct())
    first = Window.partitionBy("cls").orderBy("vec_id")
    classes = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).groupBy("cls").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _unpack(b["vec"], dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.linalg.norm(v, axis=1))], [*b.schema.names, "norm"])

    classes = kept(classes.mapInArrow(norms, "cls string, vec binary, ids array<bigint>, norm double"))
    asking = rows.filter(is_query)
    queries = asking.groupBy("cls").agg(F.first("vec").alias("vec"))
    index = spark.sparkContext.broadcast(fit(classes, queries, dim, k, tables))
    entries = salted(classes.select("cls", "vec", "ids").mapInArrow(_entries(index, False), ENTRY), ["bucket"], PART, "cls")
    sizes = entries.select("bucket", "salts").distinct()
    probes = queries.select("cls", "vec").mapInArrow(_entries(index, True), "bucket long, role int, cls string, vec binary, ids array<bigint>")
    probes = probes.join(sizes, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    cols = ["bucket", "salt", "role", "cls", "vec", "ids"]
    found = (entries.select(*cols).union(probes.select(*cols)).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "role")
             .mapInArrow(_rank(dim, k), "cls string, vec_id long, score double"))
    best = Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("cls", "vec_id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    # without the query's own row; what stands behind it moves up
    mine = asking.select(F.col("vec_id").alias("query_id"), "cls").join(found, "cls").filter("query_id <> vec_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
