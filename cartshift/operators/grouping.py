"""Ranking, de-duplication and per-key facts that stand a very large group.

One key may hold a third of all rows, so nothing here puts a whole group into one
task: per-key facts are aggregates (combined map-side), rows get them back by a join
AQE can split, and positions come from slices with literal bounds and their offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from cartshift.session import checkpointed

# A group up to this size is numbered by one window task.
HOT_GROUP_ROWS = 1_000_000


def all_present(*keys: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def join_side(facts: DataFrame) -> DataFrame:
    """``facts`` without a known partitioning, to be joined to possibly skewed rows.

    AQE splits a hot key only between two shuffles that were made for the join. Facts
    fresh from an aggregate on the join key would be joined where they are, and the
    hot key's rows with them; this narrow no-op makes the join shuffle both sides.
    Small facts are still broadcast, by Spark's own check of their size.
    """
    return facts.coalesce(2**20)


# The largest list of keys that is sent to every executor.
BROADCAST_ROWS = 500_000


def key_list(keys: DataFrame, stored: bool = False) -> DataFrame:
    """A list of keys to look up from very wide rows: broadcast if it is counted small.

    AQE would also see that it is small, but only after the wide rows were shuffled.
    A larger list is joined by a shuffle of both sides. The list is computed once: unless
    it comes from ``stored`` rows it is stored here, and its size is that of the stored rows.
    """
    keys = keys if stored else checkpointed(keys)
    small = keys.count() <= BROADCAST_ROWS
    return F.broadcast(keys) if small else join_side(keys)


def attach(rows: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """Left join of per-key ``facts`` (one row per key) onto ``rows``.

    Rows with a NULL key match nothing; AQE splits the partition they meet in like that of
    any other hot key, so ``rows`` are read once.
    """
    return rows.join(join_side(facts), list(keys), "left").select(
        *rows.columns, *[c for c in facts.columns if c not in keys]
    )


def duplicate_report(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count; NULL is one group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def flag_repeated(rows: DataFrame, *keys: str, name: str) -> DataFrame:
    """True where the key occurs on more than one row; a NULL key is never repeated."""
    repeated = duplicate_report(rows.where(all_present(*keys)), *keys)
    marked = attach(rows, repeated.select(*keys, F.lit(True).alias(name)), *keys)
    return marked.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def collated(rows: DataFrame, columns: list[str], collation: str | None) -> list[Column]:
    """``columns``, texts compared by ``collation``; without one the order is binary."""
    texts = {f.name for f in rows.schema if isinstance(f.dataType, StringType)}
    return [
        F.collate(F.col(c), collation) if collation and c in texts else F.col(c) for c in columns
    ]


def keep_on_smallest(
    rows: DataFrame, key: str, order: str, collation: str | None = None
) -> DataFrame:
    """Blank ``key`` on every row whose ``order`` is above the key's smallest one.

    Ties on the smallest keep the key, and so does a NULL ``order``. Under a
    ``collation`` texts that compare as equal are ties.
    """
    [place] = collated(rows, [order], collation)
    shared = (
        rows.where(all_present(key))
        .groupBy(key)
        .agg(F.count("*").alias("n"), F.min(place).alias("smallest"))
        .where("n > 1")
        .select(key, "smallest")
    )
    kept = F.when(place > F.col("smallest"), F.lit(None)).otherwise(F.col(key))
    return attach(rows, shared, key).withColumn(key, kept).select(*rows.columns)


def first_per_key(rows: DataFrame, *keys: str, order_by: list[str]) -> DataFrame:
    """One whole row per key, the smallest by ``order_by`` then by all other columns."""
    rest = [c for c in rows.columns if c not in order_by]
    smallest = F.min(F.struct(*order_by, *rest)).alias("row")
    return rows.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(smallest).select(
        *[F.col(f"row.{c}").alias(c) for c in rows.columns]
    )


# Rows of a slice, and rows that the sample has for each.
SLICE_ROWS, SAMPLED = 1_000_000, 100


def with_global_index(
    rows: DataFrame,
    order_by: list[str],
    name: str = "row_index",
    slices: int | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Exact zero-based position in the global order, without a one-task window and without storing rows.

    A seeded sample of bounded size, of the ordering columns only, gives the bounds of slices, which are literals. One
    more pass over these columns counts the rows of each slice. The position is the slice's start plus
    the rank inside the slice, so rows are shuffled once. Bounds only shape the slices; positions
    do not depend on the sample.

    All other columns break ties, so the positions are the same in every run. Only where one value of the
    ordering columns fills a slice are these columns read for the bounds too. Rows that are equal in every
    column and fill a slice are not sorted at all: one stands for them, and their positions are counted out.
    """
    spark = rows.sparkSession
    counted = rows.select(*order_by).count()
    if not counted:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    slices = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), counted // SLICE_ROWS)
    share = min(1.0, SAMPLED * slices / counted)
    binary = order_by if collation else []  # texts that are equal under the collation
    ties = [c for c in rows.columns if c not in order_by]
    plain = [c for c in ties if not isinstance(rows.schema[c].dataType, (ArrayType, MapType, StructType))]
    if plain != ties:  # bounds are literals of the first columns in order
        plain = ties[: next(i for i, c in enumerate(ties) if c not in plain)]
    order = [*collated(rows, order_by, collation), *map(F.col, binary)]
    cut = _Cut(rows, order_by, collation, binary)
    runs = _sampled(rows, cut, share)
    fill = max(2, sum(n for _, n in runs) // slices)
    if any(n >= fill for _, n in runs):
        cut = _Cut(rows, order_by, collation, [*binary, *plain])
        runs = _sampled(rows, cut, share)
    cut.choose(runs, fill, whole=plain == ties)
    sizes = {r["_slice"]: r["n"] for r in rows.select(cut.slice().alias("_slice")).groupBy("_slice").agg(F.count("*").alias("n")).collect()}
    starts = [0]
    for i in range(len(cut.bounds)):
        starts.append(starts[-1] + sizes.get(i, 0))
    marked = rows.withColumn("_slice", cut.slice())
    in_slice = Window.partitionBy("_slice").orderBy(*order, *ties)
    start = F.get(F.array(*[F.lit(n).cast("bigint") for n in starts]), F.col("_slice"))
    copies = [i for i in cut.copies if sizes.get(i)]
    sorted_rows = marked.where(~F.col("_slice").isin(copies)) if copies else marked
    placed = sorted_rows.withColumn(name, start + F.row_number().over(in_slice) - 1).select(*rows.columns, name)
    if not copies:
        return placed
    one_each = marked.where(F.col("_slice").isin(copies)).groupBy("_slice").agg(F.any_value(F.struct(*rows.columns)).alias("row"))
    positions = [spark.range(starts[i], starts[i] + sizes[i]).select(F.col("id").alias(name), F.lit(i).alias("_slice")) for i in copies]
    counted_out = reduce(DataFrame.unionAll, positions).join(F.broadcast(one_each), "_slice")  # a row per slice
    return placed.unionByName(counted_out.select(*[F.col("row")[c].alias(c) for c in rows.columns], name))


def sample_bounds(
    rows: DataFrame, order_by: list[str], slices: int, collation: str | None = None
) -> list[tuple]:
    """Up to ``slices - 1`` different values of ``order_by``, in order, that share the rows out alike."""
    counted = rows.select(*order_by).count()
    if not counted or slices < 2:
        return []
    cut = _Cut(rows, order_by, collation, order_by if collation else [])
    runs = _sampled(rows, cut, min(1.0, SAMPLED * slices / counted))
    total, seen, bounds = sum(n for _, n in runs), 0, []
    for value, n in runs:
        if seen and seen * slices >= (len(bounds) + 1) * total:
            bounds.append(value[: len(order_by)])
        seen += n
    return bounds[: slices - 1]


def slice_number(rows: DataFrame, column: str, bounds: list[str], collation: str | None = None) -> Column:
    """How many of the sorted ``bounds`` lie below ``column``; texts that a collation takes for equal are in one slice."""
    cut = _Cut(rows, [column], collation, [])
    cut.bounds = [((b,), 1) for b in bounds]
    return cut.slice()


class _Cut:
    """Slices by literal bounds on the first columns of an order."""

    def __init__(self, rows: DataFrame, order_by: list[str], collation: str | None, more: list[str]):
        self.names = [*order_by, *more]
        self.types = [rows.schema[c].dataType for c in self.names]
        self.collations = [collation] * len(order_by) + [None] * len(more)
        self.bounds: list[tuple[tuple, int]] = []
        self.copies: list[int] = []

    def place(self, values: list[Column], after: int) -> Column:
        """Values as they compare; ``after`` 1 is just behind all rows that have them."""
        texts = [
            F.collate(v, c) if c and isinstance(t, StringType) else v
            for v, t, c in zip(values, self.types, self.collations, strict=True)
        ]
        return F.struct(*[t.alias(f"c{i}") for i, t in enumerate(texts)], F.lit(after).alias("after"))

    def row(self) -> Column:
        return self.place([F.col(c) for c in self.names], 0)

    def choose(self, runs: list[tuple[tuple, int]], fill: int, whole: bool) -> None:
        """Bounds after every ``fill`` rows of the sample; a run that long gets a slice of its own, and if the bounds
        cover ``whole`` rows it holds copies of one row."""
        gathered = 0
        for value, n in runs:
            if n >= fill:
                self.bounds.append((value, 0))
                if whole:
                    self.copies.append(len(self.bounds))
                self.bounds.append((value, 1))
                gathered = 0
            else:
                gathered += n
                if gathered >= fill:
                    self.bounds.append((value, 1))
                    gathered = 0

    def slice(self) -> Column:
        """How many bounds are not above the row, by halving."""
        if not self.bounds:
            return F.lit(0)
        literals = F.array(
            *[self.place([F.lit(v).cast(t) for v, t in zip(values, self.types, strict=True)], after) for values, after in self.bounds]
        )
        row, steps = self.row(), [1 << i for i in reversed(range(len(self.bounds).bit_length()))]
        return F.aggregate(
            F.lit(steps),
            F.lit(0),
            lambda at, step: F.when(F.get(literals, at + step - 1) <= row, at + step).otherwise(at),
        )


def _sampled(rows: DataFrame, cut: _Cut, share: float) -> list[tuple[tuple, int]]:
    """Values of a seeded sample in order, each with how often it was drawn; some 100 for a slice."""
    drawn = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cut.names)]).sample(share, seed=7)
    place = cut.place([F.col(f"c{i}") for i in range(len(cut.names))], 0)
    found: list[tuple[tuple, int]] = []
    for r in drawn.orderBy(place).collect():
        value = tuple(r)
        if found and found[-1][0] == value:
            found[-1] = (value, found[-1][1] + 1)
        else:
            found.append((value, 1))
    return found


def flag_later(rows: DataFrame, *keys: str, order: str, name: str) -> DataFrame:
    """True where an earlier row by ``order`` has the same ``keys``; NULL is a value like any other.

    By an aggregate that comes back in a join that AQE can split, for groups of any size.
    """
    first = (
        rows.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys])
        .agg(F.count("*").alias("n"), F.min(order).alias("first"))
        .where("n > 1")
    )
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    later = F.coalesce(F.col(order) > F.col("first"), F.lit(False))
    return rows.join(join_side(first), same, "left").select(*rows.columns, later.alias(name))


# So many keys that are treated apart are compared as literals, so that the filter reaches the tables; more are joined.
LITERAL_KEYS = 100


def number_within(
    rows: DataFrame,
    *keys: str,
    order_by: list[str],
    name: str,
    hot_rows: int = HOT_GROUP_ROWS,
    again: str | None = None,
    laid_by: tuple[str, ...] = (),
) -> DataFrame:
    """Exact 1-based position of every row within its key.

    Groups up to ``hot_rows`` go through a window. Larger ones, if there are any, are
    numbered from the global index, so they are sorted by many tasks. A key is hot only
    with that many rows, so a trillion rows have at most a million hot keys. Hot rows are stored first, as the index
    reads them several times.

    ``again`` names a column; the rows then also get ``again``, which is true where an earlier row of the key has the
    same value there. That takes no further shuffle, but for hot keys.

    ``laid_by`` names columns by which the rows lie together already. Keys that stand under one value of these only
    are then numbered without a shuffle, all others by their key.
    """
    rest = [c for c in rows.columns if c not in (*keys, *order_by)]  # ties, as in the global index
    counted = rows.groupBy(*keys, *[c for c in laid_by if c not in keys]).agg(F.count("*").alias("n"))
    if laid_by:
        counted = counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("places"))
        apart = counted.where((F.col("n") > hot_rows) | (F.col("places") > 1))
    else:
        apart = counted.where(F.col("n") > hot_rows)

    def in_windows(some: DataFrame) -> DataFrame:
        group = list(dict.fromkeys([*keys, *laid_by]))
        position = F.row_number().over(Window.partitionBy(*group).orderBy(*order_by, *rest))
        placed = some.withColumn(name, position.cast("bigint"))
        if again is None:
            return placed
        copy = F.row_number().over(Window.partitionBy(*group, again).orderBy(name))
        return placed.withColumn("again", copy > 1)

    parts = _parted(rows, apart.select(*keys), keys)
    if parts is None:
        return in_windows(rows)
    usual, others = parts
    if laid_by:
        numbered = number_within(others, *keys, order_by=order_by, name=name, hot_rows=hot_rows, again=again)
        return in_windows(usual).unionByName(numbered)
    others = checkpointed(others)
    same = [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in keys]
    indexed = with_global_index(others, [*keys, *order_by], name="place_in_all")
    firsts = indexed.groupBy(*[F.col(k).alias(f"hot_{k}") for k in keys]).agg(
        F.min("place_in_all").alias("first_place")
    )
    numbered = indexed.join(F.broadcast(firsts), same).select(  # a row per hot key
        *rows.columns, (F.col("place_in_all") - F.col("first_place") + 1).alias(name)
    )
    if again is not None:
        numbered = flag_later(numbered, *keys, again, order=name, name="again")
    return in_windows(usual).unionByName(numbered)


def _parted(rows: DataFrame, found: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame] | None:
    """Rows without and with the ``found`` keys, NULL being a key like any other; nothing if there is no such key."""
    few = found.take(LITERAL_KEYS + 1)
    if not few:
        return None
    if len(few) <= LITERAL_KEYS:
        def is_key(key) -> Column:
            return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(key[k]).cast(rows.schema[k].dataType)) for k in keys])

        among = reduce(lambda a, b: a | b, map(is_key, few))
        return rows.where(~among), rows.where(among)
    listed = key_list(found.select(*[F.col(k).alias(f"of_{k}") for k in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return rows.join(listed, same, "left_anti"), rows.join(listed, same, "left_semi")
