"""Centroid clustering with ns-bounds: Lloyd's rounds that look only at the centroids that may have come nearer.

Per vector there is an upper bound of the distance to its own centroid and a lower bound for every other one, each
with the round in which it was exact. All earlier centroids are kept, so a bound is loosened by the norm of its
centroid's *total* displacement since that round, which is at most the sum of the drifts in between and often far
less, as centroids move to and fro. A vector whose bounds still tell its centroid from all others costs no distance;
otherwise the centroids that fail the bound, and only these, are measured again.

Components are whole numbers, and so are squared distances, sums and centroids, so every decision is exact. The
bounds are floating point; they are widened by more than their rounding error before they may spare a distance.

Every round writes one table (vector, cluster, bounds) and reads it back; rows stay in their partition, so no round
shuffles vectors. The sums of the clusters are kept on the driver (as many numbers as the centroids have) and
follow from the vectors that changed sides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, ship

SLACK = 1e-12  # more than the relative rounding error of a norm or a square root of a 64-bit number


def widest(dims: int) -> int:
    """The largest component whose squared distances are sure to fit a long."""
    return int((2**62 / dims) ** 0.5 / 2)


def matrix(column, kind=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """``[round, centroid]``: how far each centroid is now from where it was in that round, rounded up."""
    moved = np.stack(history).astype(float) - history[-1]
    return np.sqrt((moved * moved).sum(axis=2)) * (1 + SLACK)


class Bounds:
    """The bounds of a batch of vectors, brought to the round of the last centroids."""

    def __init__(self, vectors, cluster=None, upper=None, upper_at=None, lower=None, lower_at=None):
        self.vectors, self.cluster = vectors, cluster
        self.upper, self.upper_at, self.lower, self.lower_at = upper, upper_at, lower, lower_at
        self.measured = 0  # distances

    def measure(self, rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        self.measured += len(rows)
        return squares(self.vectors[rows], centroid)

    def first(self, centroids: np.ndarray) -> None:
        everyone = np.arange(len(self.vectors))
        exact = np.stack([self.measure(everyone, c) for c in centroids], axis=1)
        self.cluster = exact.argmin(axis=1)  # the first of equals
        self.lower = np.sqrt(exact.astype(float))
        self.lower_at = np.zeros(exact.shape, np.int32)
        self.upper = self.lower[everyone, self.cluster]
        self.upper_at = np.zeros(len(everyone), np.int32)

    def follow(self, history: list[np.ndarray]) -> None:
        now, centroids = len(history) - 1, history[-1]
        far = displacements(history)
        numbers = np.arange(len(centroids))
        low = self.lower * (1 - SLACK) - far[self.lower_at, numbers]
        high = self.upper * (1 + SLACK) + far[self.upper_at, self.cluster]
        others = numbers != self.cluster[:, None]
        unsure = np.flatnonzero(((low <= high[:, None]) & others).any(axis=1))
        if not len(unsure):
            return
        own = np.empty(len(unsure), np.int64)
        for c in numbers:
            mine = self.cluster[unsure] == c
            own[mine] = self.measure(unsure[mine], centroids[c])
        before = self.cluster[unsure]
        self.upper[unsure], self.upper_at[unsure] = np.sqrt(own.astype(float)), now
        failing = (low[unsure] <= self.upper[unsure][:, None] * (1 + SLACK)) & others[unsure]
        best, nearest = own.copy(), before.copy()
        for c in numbers:
            mine = np.flatnonzero(failing[:, c])
            if not len(mine):
                continue
            exact = self.measure(unsure[mine], centroids[c])
            self.lower[unsure[mine], c], self.lower_at[unsure[mine], c] = np.sqrt(exact.astype(float)), now
            nearer = (exact < best[mine]) | ((exact == best[mine]) & (c < nearest[mine]))
            best[mine[nearer]], nearest[mine[nearer]] = exact[nearer], c
        left = nearest != before  # what was the upper bound is now exact as a lower bound
        self.lower[unsure[left], before[left]], self.lower_at[unsure[left], before[left]] = self.upper[unsure[left]], now
        self.cluster[unsure] = nearest
        self.upper[unsure] = np.sqrt(best.astype(float))


def assigning(history: list[np.ndarray], last: bool):
    """Batches of vectors with their bounds, one round on."""

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                vectors = matrix(batch.column("v"))
                if len(history) == 1:
                    before = np.full(len(vectors), -1)
                    bounds = Bounds(vectors)
                    bounds.first(history[0])
                else:
                    before = batch.column("cluster").to_numpy().astype(np.int64)
                    bounds = Bounds(
                        vectors,
                        before.copy(),
                        batch.column("upper").to_numpy().copy(),
                        batch.column("upper_at").to_numpy().copy(),
                        matrix(batch.column("lower"), float),
                        matrix(batch.column("lower_at"), np.int32),
                    )
                    bounds.follow(history)
                names, columns = ["vec_id", "cluster"], [batch.column("vec_id"), pa.array(bounds.cluster, pa.int32())]
                if last:
                    names += ["distance"]
                    columns += [pa.array(squares(vectors, history[-1][bounds.cluster]), pa.int64())]
                else:
                    names += ["v", "before", "upper", "upper_at", "lower", "lower_at"]
                    columns += [
                        batch.column("v"),
                        pa.array(before, pa.int32()),
                        pa.array(bounds.upper, pa.float64()),
                        pa.array(bounds.upper_at, pa.int32()),
                        pa.array(list(bounds.lower), pa.list_(pa.float64())),
                        pa.array(list(bounds.lower_at), pa.list_(pa.int32())),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return work


def gains(k: int, dims: int):
    """What the vectors that changed sides add to each cluster: one row per task and cluster."""

    def work(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors = matrix(batch.column("v"))
            to, of = batch.column("cluster").to_numpy(), batch.column("before").to_numpy()
            for c in range(k):
                sums[c] += vectors[to == c].sum(axis=0) - vectors[of == c].sum(axis=0)
                counts[c] += (to == c).sum() - (of == c).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array(counts, pa.int64()), pa.array(list(sums), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    return work


def written(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of an earlier round, which nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024,
              seed: str = "3") -> DataFrame:
    """Per usable row of ``vectors``: ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``
    and ``centroid_sha256``, after ``rounds`` of Lloyd's algorithm and one more assignment.

    Usable are embeddings of ``dims`` components, none null or not finite; other rows are left out. Components count
    as ``floor(scale * x)``; one whose squared distances might not fit a long is an error. The first centroids are
    the ``k`` rows with the smallest SHA-256 of ``<seed>:<vec_id>``, in that order, then by their components; rows
    without an id come last. With fewer than ``k`` usable rows all are centroids. Equal distances go to the smaller number, and an
    empty cluster keeps its centroid. Each repeated row counts; other columns are ignored; an empty table gives an
    empty result. Once no vector changes sides, further rounds would repeat the last one and are not run.
    """
    spark = vectors.sparkSession
    ship(spark)
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    large = F.exists("v", lambda x: F.abs(x) > widest(dims))
    rows = (
        vectors.select("vec_id", "embedding")
        .where((F.size("embedding") == dims) & finite)
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
        .withColumn("v", F.when(large, F.raise_error(F.lit("component too large for exact distances"))).otherwise(F.col("v")))
        .select("vec_id", F.col("v").cast("array<int>").alias("v"))
    )
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(name.asc_nulls_last(), "v").limit(k).collect()
    kind = dict(vectors.dtypes)["vec_id"]
    end = f"vec_id {kind}, cluster int, distance long"
    if not chosen:
        return spark.createDataFrame([], f"{end}, cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(chosen)
    history = [np.array([r["v"] for r in chosen], np.int64)]
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    schema = f"vec_id {kind}, cluster int, v array<int>, before int, upper double, upper_at int, lower array<double>, lower_at array<int>"
    state, old = rows, None
    for _ in range(rounds):
        state, path = written(state.mapInArrow(assigning(history, False), schema))
        if old:
            discard(spark, old)
        old = path
        parts = (
            state.where("cluster != before")
            .select("cluster", "before", "v")
            .mapInArrow(gains(k, dims), "cluster int, n long, sums array<long>")
        )
        moved = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(
            F.sum("n").alias("n"), F.sum("s").alias("s")
        )
        for r in moved.collect():  # k times dims rows
            sums[r["cluster"]][r["i"]] += r["s"]
            counts[r["cluster"]] += r["n"] if r["i"] == 0 else 0
        following = history[-1].copy()
        for c in range(k):
            if counts[c]:
                following[c] = [s // counts[c] for s in sums[c]]  # floor, also below zero
        history.append(following)
        if (following == history[-2]).all():
            break
    final, _ = written(state.mapInArrow(assigning(history, True), end))
    discard(spark, old)
    spread = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    labels = spark.createDataFrame(
        [
            (c, spread.get(c), sum(spread.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest())
            for c, x in enumerate(history[-1])
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return final.join(F.broadcast(labels), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_ns_bounds(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def lloyd_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """Lloyd's algorithm in SQL: every distance in every round."""
    apart = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    steps = [
        f"""
points as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where len(embedding) = {dims} and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
c0 as materialized (
  select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c, v from points
  qualify c < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""
d{r} as materialized (
  select vec_id, any_value(p.v) as v, arg_min(c, ({apart}, c)) as c, min({apart}) as distance
  from points p, c{r} c group by vec_id)"""
        )
        if r < rounds:
            steps.append(
                f"""
c{r + 1} as materialized (
  select c, coalesce(new.v, old.v) as v from c{r} old left join (
    select c, list(m order by i) as v from (
      select c, i, floor_div as m from (
        select c, i, (s - ((s % n) + n) % n) // n as floor_div
        from (select c, i, sum(x)::bigint as s, count(*) as n
              from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from d{r}) group by c, i)))
    group by c) new using (c))"""
            )
    return f"""with {",".join(steps)}
select vec_id, c::integer as cluster, distance, sum(distance) over (partition by c)::bigint as cluster_inertia,
       sum(distance) over ()::bigint as inertia, sha256(list_aggregate(cc.v, 'string_agg', ',')) as centroid_sha256
from d{rounds} join c{rounds} cc using (c)
"""


OP12_SQL = lloyd_sql()
