"""SimHash near-dedup through counts of set bits per segment.

A fingerprint is cut into segments of two bits, and each segment is replaced by its number of set
bits. The Manhattan distance of two such count vectors never exceeds the number of differing bits, so
fingerprints within ``max_bits`` lie within a Manhattan ball of that radius. The range join lays a
grid of unit cells over projections of the counts: with the segments dealt into ``2 * max_bits`` bands,
two vectors within the radius agree on at least half of the bands, so each choice of that many bands
is one projection, and every pair shares a cell of at least one. Pairs that share a cell are held
against the Manhattan bound and then compared bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, components, row_digest, ship, stored

ODD = 0x5555555555555555
#: Cells with more distinct fingerprints than this are joined through balls of bit flips instead.
LARGE_CELL = 2048
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of a whole text as a signed 64-bit number."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    total, ones = len(words) - k + 1, np.zeros(64, np.int64)
    pairs = list(zip(starts[: total].tolist(), ends[k - 1 :].tolist()))
    for at in range(0, total, 1 << 16):  # bounded memory for very long texts
        part = pairs[at : at + (1 << 16)]
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return signed(sum(1 << int(i) for i in np.flatnonzero(2 * ones > total)))


def fingerprints(docs: DataFrame, keep: tuple[str, ...], shingle: int, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``_fp`` for every row of ``docs``."""
    ship(docs.sparkSession)
    given = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in given.dtypes[:-1]) + ", _fp long"

    def work(batches):
        for batch in batches:
            found = pa.array([fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, found], [*batch.schema.names[:-1], "_fp"])

    return given.mapInArrow(work, schema)


def segment_counts(fp: Column) -> Column:
    """Set bits of every two-bit segment, packed into the segment's own two bits."""
    shifted = F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(shifted).bitwiseAND(F.lit(ODD))
    one = fp.bitwiseXOR(shifted).bitwiseAND(F.lit(ODD))
    return F.shiftleft(both, 1).bitwiseOR(one)


def projections(max_bits: int) -> list[int]:
    """One mask per choice of bands; within the radius, two vectors agree under at least one."""
    bands = max(1, 2 * max_bits)
    edges = [round(i * 32 / bands) for i in range(bands + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [signed(sum(c)) for c in combinations(masks, bands - max_bits)]


def cell_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``max_bits`` among the members of a cell: a spanning set,
    so that their number is below the number of members."""
    n = len(fps)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    x = np.sort(fps.astype(np.int64)).view(np.uint64)
    odd = np.uint64(ODD)
    shifted = x >> np.uint64(1)
    packed = ((x & shifted & odd) << np.uint64(1)) | ((x ^ shifted) & odd)
    counts = (packed[:, None] >> (2 * np.arange(32, dtype=np.uint64))).astype(np.uint8) & 3
    links = []
    for i in range(n - 1):
        near = i + 1 + np.flatnonzero(
            np.abs(counts[i + 1 :].view(np.int8) - counts[i].view(np.int8)).sum(axis=1) <= max_bits
        )
        near = near[np.bitwise_count(x[near] ^ x[i]) <= max_bits]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((int(x[i].view(np.int64)), int(x[j].view(np.int64))))
    return links


def ball(radius: int) -> list[int]:
    """All masks of at most ``radius`` set bits."""
    return [signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(range(64), r)]


def links_through_balls(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among ``_fp`` where cells are too large for pairs, in a number of rows that is linear.

    Two values differ in at most ``max_bits`` bits if and only if some value is within half of
    that (rounded down) of one and half (rounded up) of the other. Around every such value stand at
    most as many fingerprints as the larger ball has members; all of them link to the smallest one
    that stands in the smaller ball.
    """
    small, large = max_bits // 2, max_bits - max_bits // 2

    def around(radius, near):
        masks = F.array(*[F.lit(m) for m in ball(radius)])
        return fps.select("_fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("_fp")))).alias("_x"), F.lit(near).alias("_near"))

    met = (
        around(small, True)
        .unionAll(around(large, False))
        .groupBy("_x")
        .agg(F.min(F.when(F.col("_near"), F.col("_fp"))).alias("a"), F.collect_set("_fp").alias("_all"))
        .where("a is not null and size(_all) > 1")
    )
    return met.select("a", F.explode("_all").alias("b")).where("a != b").distinct()


def fingerprint_links(fps: DataFrame, max_bits: int, large_cell: int = LARGE_CELL) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that connect all that are within ``max_bits``."""
    if max_bits == 0:
        return fps.select(F.col("_fp").alias("a"), F.col("_fp").alias("b")).where("false")
    ship(fps.sparkSession)
    masks = projections(max_bits)
    cells = F.array(
        *[F.struct(F.lit(i).alias("p"), F.col("_e").bitwiseAND(F.lit(m)).alias("c")) for i, m in enumerate(masks)]
    )
    keyed = fps.withColumn("_e", segment_counts(F.col("_fp"))).select("_fp", F.explode(cells).alias("_cell")).select("_fp", "_cell.*")
    shared = stored(
        keyed.withColumn("n", F.count("*").over(Window.partitionBy("p", "c"))).where("n > 1")
    )
    lists = shared.where(F.col("n") <= large_cell).groupBy("p", "c").agg(F.collect_list("_fp").alias("f")).select("f")

    def work(batches):
        for batch in batches:
            found = [e for f in batch.column(0) for e in cell_links(f.values.to_numpy(zero_copy_only=False), max_bits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    near = lists.mapInArrow(work, "a long, b long")
    crowded = shared.where(F.col("n") > large_cell).select("_fp").distinct()
    return near.unionByName(links_through_balls(crowded, max_bits))


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3, keep: tuple[str, ...] = ("doc_id",),
                large_cell: int = LARGE_CELL) -> DataFrame:
    """Every row of ``docs`` as the columns ``keep`` (``doc_id`` first), ``_fp``, ``component_id`` and
    ``_part`` (the component's smallest fingerprint).

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``max_bits`` bits; null
    only where no reachable row has an id. Null and empty texts have fingerprint zero, which links like
    any other. Repeated rows each get a row; other columns are ignored; an empty table gives an empty
    result. Copies meet in one distinct fingerprint before anything is paired.
    """
    marked = stored(fingerprints(docs, keep, shingle))
    distinct = stored(marked.groupBy("_fp").agg(F.min(keep[0]).alias("_least")))
    links = fingerprint_links(distinct.select("_fp"), max_bits, large_cell)
    parts = components(links).select(F.col("node").alias("_fp"), F.col("component").alias("_part"))
    named = distinct.join(parts, "_fp", "left").withColumn("_part", F.coalesce("_part", "_fp"))
    least = named.groupBy("_part").agg(F.min("_least").alias("component_id"))
    return marked.join(named.join(least, "_part").select("_fp", "_part", "component_id"), "_fp")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when every group of near copies keeps one: the row of the
    smallest ``doc_id``; among rows of one id the one with the smallest digest of all its columns."""
    given = docs.withColumn("_row", row_digest(docs))
    groups = near_groups(given, shingle, max_bits, ("doc_id", "_row"))
    alive = (
        groups.groupBy("_part")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first"))
        .select("_first.doc_id", "_first._row")
    )
    alive = alive.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_kept_row"))
    kept = given.join(
        alive, (F.col("_row") == F.col("_kept_row")) & given["doc_id"].eqNullSafe(alive["_id"]), "left_semi"
    )
    return kept.dropDuplicates(["_row", "doc_id"]).drop("_row")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
