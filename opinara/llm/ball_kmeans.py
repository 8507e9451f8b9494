"""Ball k-means on integer vectors, exact to the last tie.

A cluster is a ball: its centroid and a radius that holds all its members.  Only centroids within twice the radius of a
ball's own can take members from it: its neighbours.  A member nearer to its centroid than half the way to the nearest
neighbour is in the stable core and is not compared at all; the others fall into annuli by half the distances to the
sorted neighbours, and a member of the i-th annulus is compared with the i nearest of them.  All comparisons are of
integers, so the result equals that of a comparison with every centroid, ties included.

The vectors are stored once a round, with their cluster and distance.  A task reduces its rows to one count, radius and
sum of vectors for each cluster, so that what is shuffled and what the driver gets (k * dims sums) doesn't depend on the
number of rows; equal vectors, however many, cost no more than others.

Edge cases: null vectors, null or non-finite components and other numbers of components leave out the row; rows with a
null id take part and come last among the seeds, as do, among rows of one id, larger vectors; repeated rows count each
time; fewer than k vectors give as many clusters; no vectors give no rows; other columns are ignored, whatever their
names.  Components are held within 2**25 (see ``vectors``).  An inertia that no long can hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.vectors import integer_vectors, matrix
from opinara.session import Scratch

#: Rows of one numpy step.
STEP = 2048


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.einsum("ij,ij->i", d, d)


class Balls:
    """Centroids with the sorted neighbours of each ball; ``radii`` are None before the first assignment."""

    def __init__(self, centroids: np.ndarray, radii: list[int] | None):
        self.centroids, self.k = centroids, len(centroids)
        self.near: list[np.ndarray] = []
        self.edges: list[np.ndarray] = []
        for i in range(self.k):
            apart = distances(centroids, centroids[i])
            # 4 * d >= apart is d >= ceil(apart / 4): a member at the squared distance d may be as near to the other centroid.
            half = -(-apart // 4)
            order = np.lexsort((np.arange(self.k), half))
            order = order[order != i]
            if radii is not None:
                order = order[half[order] <= radii[i] ** 2]
            self.near.append(order)
            self.edges.append(half[order])

    def first(self, x: np.ndarray) -> np.ndarray:
        """A first cluster for vectors that have none: any is right, a near one saves comparisons."""
        guess = np.zeros(len(x), np.int64)
        best = distances(x, self.centroids[0])
        for j in range(1, self.k):
            d = distances(x, self.centroids[j])
            nearer = d < best
            guess[nearer], best[nearer] = j, d[nearer]
        return guess

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (of equally near ones the first) and the squared distance to it."""
        out, best = cluster.copy(), np.zeros(len(x), np.int64)
        for i in np.unique(cluster):
            members = np.flatnonzero(cluster == i)
            own = distances(x[members], self.centroids[i])
            best[members] = own
            annulus = np.searchsorted(self.edges[i], own, "right")
            for t in range(int(annulus.max(initial=0))):
                j = self.near[i][t]
                asked = members[annulus > t]
                d = distances(x[asked], self.centroids[j])
                nearer = (d < best[asked]) | ((d == best[asked]) & (j < out[asked]))
                out[asked[nearer]], best[asked[nearer]] = j, d[nearer]
        return out, best


def assigned(rows: DataFrame, balls: Balls, keep_vectors: bool) -> DataFrame:
    """``rows`` (id, v[, cluster]) with their nearest centroid and their squared distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                x = matrix(part.column(1))
                before = part.column(2).to_numpy().astype(np.int64) if part.num_columns > 2 else balls.first(x)
                cluster, distance = balls.assign(x, before)
                found = [pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
                names = ["id", *(["v"] if keep_vectors else []), "cluster", "distance"]
                yield pa.RecordBatch.from_arrays([part.column(0), *([part.column(1)] if keep_vectors else []), *found], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    columns = ["id", "v", *(["cluster"] if "cluster" in rows.columns else [])]
    return rows.select(*columns).mapInArrow(run, f"id {kind}, {'v array<int>, ' if keep_vectors else ''}cluster int, distance long")


def ball_sums(rows: DataFrame, k: int, dims: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Count, largest squared distance and sum of vectors of each of the k clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            cluster = b.column(1).to_numpy()
            n += np.bincount(cluster, minlength=k)
            np.maximum.at(far, cluster, b.column(2).to_numpy())
            order = np.argsort(cluster, kind="stable")
            at = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            if len(order):
                total[cluster[order][at]] += np.add.reduceat(matrix(b.column(0), dims)[order], at, axis=0)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen]), pa.array(far[seen]), pa.array(list(total[seen]), pa.list_(pa.int64()))], names=["cluster", "n", "far", "total"])

    parts = rows.select("v", "cluster", "distance").mapInArrow(run, "cluster int, n long, far long, total array<long>")
    each = parts.select("cluster", "n", "far", F.posexplode("total").alias("pos", "x"))
    found = each.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("x").alias("x")).collect()
    n, far, total = [0] * k, [0] * k, [[0] * dims for _ in range(k)]
    for r in found:
        n[r.cluster], far[r.cluster], total[r.cluster][r.pos] = r.n, r.far, r.x
    return n, far, total


def ball_kmeans(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of ``dims`` components.

    Seeds are the k vectors of smallest SHA-256 of ``salt:id``.  Each round assigns all vectors and moves each centroid that
    has some to the floor of their mean; a last assignment follows."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = scratch.store(integer_vectors(df, F.col(f"`{vector}`"), scale, dims, id=F.col(f"`{id_col}`")), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    seeds = rows.orderBy(hashed.asc_nulls_last(), "id", "v").limit(k).select("v").collect()
    if not seeds:
        return rows.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    centroids = np.array([s.v for s in seeds], np.int64)
    radii: list[int] | None = None
    for _ in range(rounds):
        before, rows = rows, scratch.store(assigned(rows, Balls(centroids, radii), True), "assigned")
        scratch.drop(before)
        n, far, total = ball_sums(rows, len(centroids), dims)
        moved = np.array([[x // c for x in t] if c else own.tolist() for own, c, t in zip(centroids, n, total, strict=True)], np.int64)
        # A ball around the new centroid that holds what the old one held: one is added for each root that is rounded down.
        radii = [isqrt(f) + 1 + isqrt(int(s)) + 1 for f, s in zip(far, np.square(moved - centroids).sum(1), strict=True)]
        centroids = moved
    before, last = rows, scratch.store(assigned(rows, Balls(centroids, radii), False), "clusters")
    scratch.drop(before)
    inertia = {r.cluster: r.s for r in last.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    whole = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    clusters = spark.createDataFrame([(j, s, whole, digest[j]) for j, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = last.join(F.broadcast(clusters), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1", table: str = "embeddings") -> str:
    """DuckDB SQL for ``ball_kmeans(embeddings)`` by comparing every vector with every centroid."""
    square = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assign(r: int) -> str:
        return f"""a{r} AS (SELECT i, vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT i, vec_id, v, j, {square} AS d FROM x, c{r}) GROUP BY i, vec_id, v)"""

    def move(r: int) -> str:
        return f"""m{r} AS (SELECT j, list(q ORDER BY p) AS q FROM (SELECT j, p, floor(sum(e)::DOUBLE / count(*))::BIGINT AS q FROM (SELECT j, generate_subscripts(v, 1) AS p, unnest(v) AS e FROM a{r - 1}) GROUP BY j, p) GROUP BY j),
c{r} AS (SELECT c{r - 1}.j, coalesce(q, c) AS c FROM c{r - 1} LEFT JOIN m{r} USING (j))"""

    steps = ",\n".join([assign(0), *[f"{move(r)},\n{assign(r)}" for r in range(1, rounds + 1)]])
    return f"""
WITH x AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM {table}
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM x QUALIFY j < {k}),
{steps},
s AS (SELECT j, sum(d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY j)
SELECT vec_id, a.j::INT AS cluster, d::BIGINT AS distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM s) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN s USING (j) JOIN c{rounds} USING (j)"""
