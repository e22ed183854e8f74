"""Centroid clustering of whole-number vectors with Hamerly's bounds.

Each vector keeps its cluster, an upper bound of the distance to that centroid and a lower bound of the distance to
the second nearest.  After centroids have moved, the upper bound grows by the own centroid's drift and the
lower bound shrinks by the largest drift of the others.  While the upper bound is strictly below the lower one (or below
half the distance from the own centroid to its nearest neighbour), no other centroid can be as near, so
ties can't arise either, and the vector keeps its cluster.  Else the upper bound is made exact; if
that doesn't settle it, the vector is ambiguous and gets a full scan of all centroids in whole numbers.
Roots are rounded outwards, so bounds are true bounds.

A round is one pass over a table (vectors with their states), written to scratch with the new states, and one
aggregation by cluster with partial sums before the shuffle; a cluster that holds most vectors is summed where they lie.  Only
centroids (k x d numbers), drifts and sums by cluster reach the driver.

Vectors that are null, hold null or non-finite entries, or haven't exactly ``dimension`` of them are left out.
Rows without id can't be starting centroids; with fewer ids than ``k``, there are fewer centroids, with none no result rows.
Of repeated ids the starting hash ties; smaller vectors come first.  Repeated rows are rows of their own.
Entries beyond 2^26 once scaled are refused (ValueError): squared distances must fit 64 bits.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .whitening import usable, whole

LARGEST = 1 << 26
BLOCK = 4096  # vectors scanned at once


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers, one column a centroid."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def root_above(square: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(np.nextafter(square.astype(float), np.inf)), np.inf)


def root_below(square: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(np.maximum(np.nextafter(square.astype(float), -np.inf), 0.0)), -np.inf), 0.0)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, upper, lower) by full scans; of equal distances the smaller number."""
    cluster, best, second = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for a in range(0, len(x), BLOCK):
        d = distances(x[a : a + BLOCK], centroids)
        at = d.argmin(axis=1)
        cluster[a : a + BLOCK], best[a : a + BLOCK] = at, d[np.arange(len(d)), at]
        if len(centroids) > 1:
            d[np.arange(len(d)), at] = np.iinfo(np.int64).max
            second[a : a + BLOCK] = root_below(d.min(axis=1))
    return cluster, best, root_above(best), second


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, full scans) after centroids have moved from ``before`` to ``centroids``."""
    k = len(centroids)
    drift = root_above(((centroids - before) ** 2).sum(axis=1))
    drift[(centroids == before).all(axis=1)] = 0.0
    order = np.argsort(-drift)
    others = np.where(np.arange(k) == order[0], drift[order[1]] if k > 1 else 0.0, drift[order[0]])
    between = np.full((k, k), np.inf)
    for i in range(k):
        between[i] = root_below(((centroids - centroids[i]) ** 2).sum(axis=1)) / 2
        between[i, i] = np.inf
    apart = np.nextafter(between.min(axis=1), -np.inf)
    cluster = cluster.astype(np.int64)
    upper, lower = np.nextafter(upper + drift[cluster], np.inf), np.nextafter(lower - others[cluster], -np.inf)
    edge = np.maximum(lower, apart[cluster])
    loose = np.flatnonzero(upper >= edge)
    upper[loose] = root_above(((x[loose] - centroids[cluster[loose]]) ** 2).sum(axis=1))
    open_ = loose[upper[loose] >= edge[loose]]
    if len(open_):
        cluster[open_], _, upper[open_], lower[open_] = scan(x[open_], centroids)
    return cluster, upper, lower, len(open_)


def _vectors(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _round(centroids: np.ndarray, before: np.ndarray | None, last: bool):
    """A pass: new states after every vector; the last one gives exact distances and no vectors."""
    d = centroids.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch, d)
            if before is None:
                cluster, best, upper, lower = scan(x, centroids)
                full = len(x)
            else:
                state = [batch.column(c).to_numpy() for c in ("cluster", "_upper", "_lower")]
                cluster, upper, lower, full = reassign(x, *[s.copy() for s in state], centroids, before)
            scans = np.zeros(len(x), np.int64)
            scans[0] = full
            if last:
                best = ((x - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.record_batch([batch.column("_id"), pa.array(cluster.astype(np.int32)), pa.array(best), pa.array(scans)], ["_id", "cluster", "distance", "_scans"])
            else:
                yield pa.record_batch([batch.column("_id"), batch.column("_x"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scans)], ["_id", "_x", "cluster", "_upper", "_lower", "_scans"])

    return each


def starting(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    got = rows.where(F.col("_id").isNotNull()).select(key.alias("_key"), "_x").orderBy("_key", "_x").limit(k).collect()  # k rows
    return np.array([r["_x"] for r in got], np.int64)


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids as floors of exact means; those of empty clusters stay."""
    d = centroids.shape[1]
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_x")[i].cast("long")).alias(f"s{i}") for i in range(d)]).collect()  # k rows
    out = centroids.copy()
    for r in sums:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    return out


def cluster_vectors(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", k: int = 16, rounds: int = 3, scale: float = 64.0, dimension: int = 64, seed: str = "1") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(rows _id, cluster, distance (squared); final centroids; full scans of each pass)."""
    entries = F.transform(F.col(vector_col).cast("array<double>"), lambda c: whole(c, scale))
    fits = usable(F.col(vector_col)) & (F.size(vector_col) == dimension)
    rows = df.where(fits).select(F.col(id_col).alias("_id"), entries.alias("_x"))
    large = rows.agg(F.max(F.array_max(F.transform("_x", F.abs))).alias("m")).first()["m"]
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    out = f"_id {id_type}, cluster int, distance long, _scans long"
    if large is not None and large >= LARGEST:
        raise ValueError(f"a scaled entry is {large}; entries must stay below 2^26")
    centroids = starting(rows, k, seed) if large is not None else np.zeros((0, dimension), np.int64)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], "_id long, cluster int, distance long"), centroids, []
    state = rows.withColumn("_x", F.col("_x").cast("array<int>"))
    schema = f"_id {id_type}, _x array<int>, cluster int, _upper double, _lower double, _scans long"
    before, scans = None, []
    for r in range(rounds):
        state = scratch(state.mapInArrow(_round(centroids, before, False), schema), f"clusters-{r}")
        before, centroids = centroids, moved(state, centroids)
        scans.append(state.agg(F.sum("_scans")).first()[0])
    found = scratch(state.mapInArrow(_round(centroids, before, True), out), "clusters-last")
    scans.append(found.agg(F.sum("_scans")).first()[0])
    return found.drop("_scans"), centroids, scans


def op13(embeddings: DataFrame) -> DataFrame:
    found, centroids, _ = cluster_vectors(embeddings)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"), F.sum("distance").alias("d"))
    sums = {r["cluster"]: int(r["cluster_inertia"]) for r in by.collect()}  # 16 rows at most
    numbers = range(len(centroids))
    own = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in numbers]) if names else F.array().cast("array<bigint>")
    name = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return found.select(F.col("_id").alias("vec_id"), "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(name, F.col("cluster")).alias("centroid_sha256"))


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """Full scans in SQL, round by round, over (row, dimension, value)."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)",
        "e AS MATERIALIZED (SELECT r, generate_subscripts(x, 1) AS i, unnest(x) AS a FROM v)",
        f"s0 AS (SELECT x, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS k FROM v WHERE vec_id IS NOT NULL QUALIFY k < {k})",
        "c0 AS MATERIALIZED (SELECT k, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM s0)",
    ]
    for t in range(rounds + 1):
        parts.append(f"d{t} AS (SELECT r, k, sum((a - c) * (a - c)) AS d FROM e JOIN c{t} USING (i) GROUP BY r, k)")
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, min(k) AS k, d FROM (SELECT r, k, d, min(d) OVER (PARTITION BY r) AS m FROM d{t}) WHERE d = m GROUP BY r, d)")
        if t < rounds:
            mean = "(sum(a) - ((sum(a) % count(*)) + count(*)) % count(*)) // count(*)"
            parts.append(f"m{t} AS (SELECT k, i, {mean} AS c FROM a{t} JOIN e USING (r) GROUP BY k, i)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT o.k, o.i, CAST(coalesce(m.c, o.c) AS BIGINT) AS c FROM c{t} o LEFT JOIN m{t} m ON m.k = o.k AND m.i = o.i)")
    parts.append(f"h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return "WITH " + ", ".join(parts) + (
        f" SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN h ON h.k = a.k"
    )


ORACLE = _oracle()
