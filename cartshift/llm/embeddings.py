"""Embedding near-dedup by cross-polytope hashing with multiprobe buckets.

A vector is turned by three rounds of random sign flips and a fast Hadamard transform; the axis it then lies
nearest to, with its sign, is its hash. A table joins two such hashes, and a vector also looks into the
buckets of the next nearest axes (``probes`` per hash). Two vectors are candidates if one of them finds the
other in its home bucket in any table, and every candidate pair is verified by its cosine in double precision.

Rows are dealt by class, table and first hash, so a vector is sent ``tables * probes`` times, and the second
hash narrows the pairs within a group. The few groups that hold very many rows are cut into slices of homes and
slices of visitors. Each verified pair is counted in one group only: the first table in which it meets, so
neither links nor counts need a list of all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ship, stored

HOMES, VISITORS = 4096, 16384  # most rows of a slice
SPREAD_GROUPS = 20_000  # at most so many groups are cut into slices, whatever the number of rows


@dataclass(frozen=True)
class PolytopeIndex:
    """At cosine 0.93 and 64 dimensions a pair meets in one table with probability 0.83, so four tables miss
    one pair in a thousand; at 0.97 one in a hundred thousand."""

    tables: int = 4
    probes: int = 3
    seed: int = 17

    def width(self, dims: int) -> int:
        return 1 << max(2, (dims - 1).bit_length())

    def signs(self, dims: int) -> np.ndarray:
        shape = (self.tables, 2, 3, self.width(dims))
        return np.random.default_rng([self.seed, dims]).choice(np.array([-1.0, 1.0]), size=shape)

    def hashes(self, vectors: np.ndarray) -> np.ndarray:
        """``[vector, table, hash, probe]``: the nearest axes, home first."""
        n, dims = vectors.shape
        width, probes = self.width(dims), min(self.probes, 2 * self.width(dims))
        padded = np.zeros((n, width))
        padded[:, :dims] = vectors
        out = np.empty((n, self.tables, 2, probes), np.int32)
        for t, functions in enumerate(self.signs(dims)):
            for f, rounds in enumerate(functions):
                x = padded
                for flips in rounds:
                    x = hadamard(x * flips)
                both = np.concatenate([-x, x], axis=1)
                near = np.argpartition(both, probes - 1, axis=1)[:, :probes]
                rank = np.argsort(np.take_along_axis(both, near, 1), axis=1, kind="stable")
                out[:, t, f] = np.take_along_axis(near, rank, 1)
        return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of every row, scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, width) / np.sqrt(width)


def visits(home: np.ndarray, visitor: np.ndarray) -> np.ndarray:
    """``[pair, table]``: whether the visitor looks into the home's bucket; hashes of either side of a pair."""
    return (home[..., :1] == visitor).any(axis=-1).all(axis=-1)


def owned(home: np.ndarray, visitor: np.ndarray, table: int, home_first: np.ndarray) -> np.ndarray:
    """Whether a pair is to be counted where it was met as (home, visitor) in ``table``: it meets in no earlier
    table, and in this one either not the other way round or the home is the first of the two."""
    one, other = visits(home[:, : table + 1], visitor[:, : table + 1]), visits(visitor[:, : table + 1], home[:, : table + 1])
    earlier = (one[:, :table] | other[:, :table]).any(axis=1)
    return ~earlier & (~other[:, table] | home_first)


def slices(count: int, most: int) -> int:
    return max(1, -(-count // most))


def group_key(kind: str, table: int, axis: int, s: int, r: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}|{table}|{axis}|{s}|{r}") >> 1


def dealt(index: PolytopeIndex, spread: dict, parts: int, kind):
    """Rows of ``(_class, node, copies, v)`` sent to the groups that they live in or look into.

    Small groups share a part; every slice of a large one is a part of its own.
    """

    def work(batches):
        for whole in batches:
            for batch in by_length(whole):
                vectors = as_matrix(batch.column("v"))
                nodes = batch.column("node").to_numpy()
                classes = batch.column("_class").to_pylist()
                hashes = index.hashes(vectors)
                keys: dict[tuple, int] = {}
                rows, part, key, tables, live = [], [], [], [], []
                for t in range(index.tables):
                    for p in range(hashes.shape[3]):
                        for i, axis in enumerate(hashes[:, t, 0, p].tolist()):
                            cut = spread.get((classes[i], t, axis))
                            homes, others = cut or (1, 1)
                            mine, other = int(nodes[i] % homes), int((nodes[i] // 7919) % others)
                            places = [(x, other, False) for x in range(homes)]  # looks into every slice of homes
                            if p == 0:
                                places += [(mine, x, True) for x in range(others)]
                            for x, y, is_home in places:
                                name = (classes[i], t, axis, x, y)
                                k = keys.get(name)
                                if k is None:
                                    k = keys[name] = group_key(*name)
                                rows.append(i)
                                part.append(-k if cut else k % parts)
                                key.append(k)
                                tables.append(t)
                                live.append(is_home)
                taken = pa.array(rows, pa.int64())
                small = vectors.astype(kind)
                codes = hashes.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.int64()),
                        pa.array(key, pa.int64()),
                        pa.array(tables, pa.int32()),
                        pa.array(live, pa.bool_()),
                        batch.column("node").take(taken),
                        batch.column("copies").take(taken),
                        pa.array([x.tobytes() for x in small], pa.binary()).take(taken),
                        pa.array([x.tobytes() for x in codes], pa.binary()).take(taken),
                    ],
                    ["part", "key", "t", "home", "node", "copies", "v", "h"],
                )

    return work


def by_length(batch: pa.RecordBatch):
    """Pieces of a batch whose vectors are of one length."""
    lengths = np.array([len(v) for v in batch.column("v")])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for at in range(0, len(rows), 1024):
            yield batch.take(pa.array(rows[at : at + 1024]))


def as_matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Spans:
    """Links that connect what is linked: a forest over the nodes of a part."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, x: int, y: int) -> None:
        p, q = self.root(x), self.root(y)
        if p != q:
            self.parent[q] = p
            self.links.append((x, y))


def group_links(index: PolytopeIndex, least: float, kind):
    """Verified pairs of the groups of one part: what each node gains in links, and links that span them."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        keys, home = part["key"].to_numpy(), part["home"].to_numpy()
        tables, nodes, copies = part["t"].to_numpy(), part["node"].to_numpy(), part["copies"].to_numpy()
        shape = (-1, index.tables, 2, len(part["h"].iloc[0]) // (8 * index.tables))
        gained, spans = np.zeros(len(part), np.int64), Spans()
        order = np.argsort(keys, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            homes, others = group[home[group]], group[~home[group]]
            if not len(homes) or not len(others):
                continue
            table = int(tables[group[0]])
            a, b = (np.frombuffer(b"".join(part["v"].iloc[i]), kind).reshape(len(i), -1).astype(np.float64) for i in (homes, others))
            hash_a, hash_b = (np.frombuffer(b"".join(part["h"].iloc[i]), np.int32).reshape(shape) for i in (homes, others))
            length_a, length_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            node_a, node_b, copies_a, copies_b = nodes[homes], nodes[others], copies[homes], copies[others]
            second = hash_a[:, table, 1, 0]
            for axis in np.unique(second):
                here = np.flatnonzero(second == axis)
                looks = np.flatnonzero((hash_b[:, table, 1] == axis).any(axis=1))
                for at in range(0, len(here), 64):
                    rows = here[at : at + 64]
                    cosines = (a[rows] @ b[looks].T) / (length_a[rows][:, None] * length_b[looks])
                    x, y = np.nonzero(cosines >= least)
                    x, y = rows[x], looks[y]
                    other = node_a[x] != node_b[y]
                    x, y = x[other], y[other]
                    if not len(x):
                        continue
                    mine = owned(hash_a[x], hash_b[y], table, node_a[x] < node_b[y])
                    x, y = x[mine], y[mine]
                    np.add.at(gained, homes[x], copies_b[y])
                    np.add.at(gained, others[y], copies_a[x])
                    for i, j in zip(node_a[x].tolist(), node_b[y].tolist()):
                        spans.add(i, j)
        gains = pd.Series(gained).groupby(nodes).sum()
        gains = gains[gains > 0]
        return pd.DataFrame(
            {
                "a": np.array([*gains.index, *(s[0] for s in spans.links)], np.int64),
                "b": np.array([*gains.index, *(s[1] for s in spans.links)], np.int64),
                "links": np.array([*gains, *(0 for _ in spans.links)], np.int64),
            }
        )

    return work


def near_vectors(vectors: DataFrame, least: float = 0.93, index: PolytopeIndex = PolytopeIndex(),
                 most: tuple[int, int] = (HOMES, VISITORS)) -> DataFrame:
    """Per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Rows with the same ``label`` and vectors of one length are compared. A null label, a null, empty or
    zero vector, and one with null or non-finite components link with nothing. Rows of equal vectors are
    links of each other; they meet before anything is hashed. Each repeated row is a vector of its own. A row
    without an id has one only if it is linked to one that has; without an id it is never kept. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    value = F.col("embedding")
    finite = F.forall(
        value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    ) & F.exists(value, lambda x: F.coalesce(x != 0, F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    kind = F.concat_ws("|", F.col("label").cast("string"), F.size(value).cast("string"))
    rows = vectors.select(
        "vec_id",
        F.when(usable, kind).alias("_class"),
        F.when(usable, F.xxhash64(kind, value)).alias("node"),
        F.when(usable, value).alias("v"),
    )
    distinct = stored(
        rows.where("node is not null")
        .groupBy("_class", "node")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.any_value("v").alias("v"))
    )

    def homes_and_visitors(batches):
        for whole in batches:
            for batch in by_length(whole):
                hashes = index.hashes(as_matrix(batch.column("v")))
                classes = batch.column("_class").to_pylist()
                table = pd.DataFrame(
                    [
                        (classes[i], t, axis, int(p == 0))
                        for t in range(index.tables)
                        for p in range(hashes.shape[3])
                        for i, axis in enumerate(hashes[:, t, 0, p].tolist())
                    ],
                    columns=["_class", "t", "axis", "homes"],
                )
                sums = table.groupby(["_class", "t", "axis"], as_index=False)["homes"].agg(["sum", "count"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sums["_class"], pa.string()),
                        pa.array(sums["t"], pa.int32()),
                        pa.array(sums["axis"], pa.int32()),
                        pa.array(sums["sum"], pa.int64()),
                        pa.array(sums["count"], pa.int64()),
                    ],
                    ["_class", "t", "axis", "homes", "others"],
                )

    n = distinct.count()
    sizes = (
        distinct.select("_class", "v")
        .mapInArrow(homes_and_visitors, "_class string, t int, axis int, homes long, others long")
        .groupBy("_class", "t", "axis")
        .agg(F.sum("homes").alias("homes"), F.sum("others").alias("others"))
    )
    # at most SPREAD_GROUPS rows: each has at least that share of all
    large = sizes.where(
        (F.col("others") >= n * index.tables * index.probes / SPREAD_GROUPS)
        & ((F.col("homes") > most[0]) | (F.col("others") > most[1]))
    )
    spread = {
        (r["_class"], r["t"], r["axis"]): (slices(r["homes"], most[0]), slices(r["others"], most[1]))
        for r in large.toLocalIterator()
    }
    kind = np.float32 if "float" in dict(vectors.dtypes)["embedding"] else np.float64
    parts = max(1, n * index.tables * (index.probes + 1) // VISITORS)
    found = stored(
        distinct.select("_class", "node", "copies", "v")
        .mapInArrow(
            dealt(index, spread, parts, kind),
            "part long, key long, t int, home boolean, node long, copies long, v binary, h binary",
        )
        .groupBy("part")
        .applyInPandas(group_links(index, least, kind), "a long, b long, links long")
    )
    gained = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.where("a != b").select("a", "b")).withColumnRenamed("component", "part")
    named = (
        distinct.select("node", "copies", "least")
        .join(gained, "node", "left")
        .join(joined, "node", "left")
        .withColumn("part", F.coalesce("part", "node"))
    )
    smallest = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "part").select(
        "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = rows.where("node is not null").select("vec_id", "node").join(named, "node")
    alone = rows.where("node is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        linked.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
