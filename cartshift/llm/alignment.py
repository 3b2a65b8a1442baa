"""Cross-tokenizer alignment by an associative fragment monoid.

Two tokenizers cut the same bytes. Offsets where a token of either ends are cuts; between two cuts next to each
other lies a group, the smallest run of tokens on both sides that spells the same bytes.

A fragment is what a byte range of a text knows of this: the *open prefix* (tokens that end up to the range's
first cut, whose group may have begun before), the *closed groups* between its first and its last cut, and the *open
suffix* (tokens after the last cut). A range without a cut is all prefix. Two neighbours compose: the suffix of the left
and the prefix of the right make one more group if the right one has a cut, and go on as an open end if not. That
is associative with the empty fragment as its unit, so fragments of a long text may be made apart and composed as a tree.

Jobs: texts are encoded, and texts above one range yield a fragment per range. Those are composed by Spark in groups of
neighbours, level by level, until each text has one. The links (overlapping pairs of tokens) of closed groups are counted
per block of texts first, then by pair. A block asks for the counts of its distinct pairs, once each, and its
texts add up the answers; no link is shuffled on its own.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import byte_names
from .common import ship, stored

RANGE_BYTES = 1 << 15  # of a fragment
SEGMENT_CHARS = 1 << 16  # encoded at once, where a text can be cut without changing its tokens
BLOCK_LINKS, BLOCK_PAIRS = 1 << 23, 1 << 18  # a block is closed when it reaches either
FAN_IN = 8  # fragments composed by one step of the tree
# A space between these belongs to what follows it in both tokenizers, and no token reaches across.
SAFE_CUT = regex.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


class Vocabularies:
    """Both encoders, with the bytes of every token."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        with open(byte_path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, ids = byte_names(), spec["model"]["vocab"]
        added = {t["id"] for t in spec["added_tokens"]}
        labels = {i: bytes(letters[c] for c in token) for token, i in ids.items() if i not in added}
        self.a_bytes = [labels.get(i, b"") for i in range(max(ids.values()) + 1)]
        self.a_encode, joined = byte_encoder(byte_path, spec, labels, ids)
        self.a_joined = joined or (lambda found: b"".join(map(self.a_bytes.__getitem__, found)))
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = [self.piece_bytes(i) for i in range(self.pieces.vocab_size())]
        self.most = None if any(regex.search(rb"[A-Za-z0-9] ", x) for x in self.b_bytes) else SEGMENT_CHARS
        self.a_lengths = np.array([len(x) for x in self.a_bytes])
        self.b_lengths = np.array([len(x) for x in self.b_bytes])
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.between, self.middle, self.end = (np.array([f"{i}{mark}" for i in range(most)], object) for mark in ",|;")

    def piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        if self.pieces.is_control(i) or self.pieces.is_unknown(i):
            return b""
        return piece.replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and the text by both; none if either does not spell these bytes."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        a, b = [], []
        for segment in segments(text, self.most or len(text)):
            raw = b" " + segment.encode()
            one, other = self.a_encode(" " + segment), self.pieces.encode(segment, num_threads=1)
            if self.a_joined(one) != raw or b"".join(map(self.b_bytes.__getitem__, other)) != raw:
                return none
            a.append(np.array(one, np.int64))
            b.append(np.array(other, np.int64))
        return np.concatenate(a), np.concatenate(b)


def byte_encoder(path: str, spec: dict, labels: dict[int, bytes], ids: dict[str, int]):
    """Two functions, the second may be None: text to ids, strings of special tokens being plain text, and ids to bytes.

    Where ids rise with the rank of their merges and texts are split in the usual way, the ids are ranks, and the
    faster of two libraries gives the same ids.
    """
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [ids[a + b] for a, b in merges]
    first = spec["pre_tokenizer"] or {}
    if (
        made == sorted(made)
        and spec["normalizer"] is None
        and (first.get("type"), first.get("add_prefix_space"), first.get("use_regex")) == ("ByteLevel", False, True)
        and not spec["model"].get("ignore_merges")
    ):
        import public_tokenizers
        import tiktoken

        ranks = {label: i for i, label in labels.items()}
        ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return ranked.encode_ordinary, ranked.decode_bytes
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    return (lambda text: coder.encode(text, add_special_tokens=False).ids), None


def segments(text: str, most: int) -> list[str]:
    """The text in parts that can be encoded apart, each without the space before it."""
    found, start = [], 0
    while len(text) - start > most:
        cut = SAFE_CUT.search(text, start + most)
        if not cut:
            break
        found.append(text[start : cut.start()])
        start = cut.end()
    return [*found, text[start:]]


VOCABULARIES: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(byte_path: str, piece_path: str) -> Vocabularies:
    """One per worker and pair of files."""
    key = byte_path, piece_path
    if key not in VOCABULARIES:
        VOCABULARIES[key] = Vocabularies(*key)
    return VOCABULARIES[key]


NO_TOKENS = np.zeros(0, np.int64)


class Fragment(NamedTuple):
    """``a``/``b``: ids of the open prefix; ``cut``: whether there is a cut, after which there are the closed groups
    and the open suffix ``a_tail``/``b_tail``. ``pairs`` are the links of the closed groups, as ``a << 32 | b``."""

    a: np.ndarray = NO_TOKENS
    b: np.ndarray = NO_TOKENS
    cut: bool = False
    text: str = ""
    n_groups: int = 0
    pairs: np.ndarray = NO_TOKENS
    a_tail: np.ndarray = NO_TOKENS
    b_tail: np.ndarray = NO_TOKENS


def closed(words: Vocabularies, a: np.ndarray, b: np.ndarray) -> tuple[str, int, np.ndarray]:
    """Groups of tokens that begin and end at cuts: as text, their number, and their links."""
    if not len(a) and not len(b):
        return "", 0, NO_TOKENS
    ends_a, ends_b = np.cumsum(words.a_lengths[a]), np.cumsum(words.b_lengths[b])
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)  # the other's token at an end
    cut_a, cut_b = ends_b[over_a] == ends_a, ends_a[over_b] == ends_b
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    # a group's tokens of the first tokenizer come before those of the second
    place_a = np.arange(len(a)) + np.append(0, np.flatnonzero(cut_b) + 1)[group_a]
    place_b = np.arange(len(b)) + (np.flatnonzero(cut_a) + 1)[group_b]
    shown = np.empty(len(a) + len(b), object)
    shown[place_a] = np.where(cut_a, words.middle[a], words.between[a])
    shown[place_b] = np.where(cut_b, words.end[b], words.between[b])
    # one token of either side lies over the bytes before every end; ends that both have count once
    pairs = np.concatenate([a << 32 | b[over_a], (a[over_b] << 32 | b)[~cut_b]])
    return "".join(shown.tolist()), int(cut_a.sum()), pairs


def fragment(words: Vocabularies, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of a range, from the tokens that end in it and their offsets."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(cuts):
        return Fragment(a, b)
    (i, j), (k, m) = np.searchsorted(ends_a, cuts[[0, -1]]) + 1, np.searchsorted(ends_b, cuts[[0, -1]]) + 1
    return Fragment(a[:i], b[:k], True, *closed(words, a[i:j], b[k:m]), a[j:], b[m:])


def composed(words: Vocabularies, left: Fragment, right: Fragment) -> Fragment:
    join = np.concatenate
    if not left.cut:
        return Fragment(join([left.a, right.a]), join([left.b, right.b]), right.cut, right.text, right.n_groups,
                        right.pairs, right.a_tail, right.b_tail)
    a, b = join([left.a_tail, right.a]), join([left.b_tail, right.b])
    if not right.cut:
        return Fragment(left.a, left.b, True, left.text, left.n_groups, left.pairs, a, b)
    text, n, pairs = closed(words, a, b)
    return Fragment(left.a, left.b, True, left.text + text + right.text, left.n_groups + n + right.n_groups,
                    join([left.pairs, pairs, right.pairs]), right.a_tail, right.b_tail)


def single(words: Vocabularies, a: np.ndarray, b: np.ndarray) -> Fragment:
    """A text of one range, which begins and ends with a cut."""
    return Fragment(NO_TOKENS, NO_TOKENS, True, *closed(words, a, b))


def whole(words: Vocabularies, inner: Fragment) -> Fragment:
    """A text's last fragment: its beginning and its end are cuts, so nothing stays open."""
    return composed(words, Fragment(cut=True), inner)


def ranges(words: Vocabularies, a: np.ndarray, b: np.ndarray, size: int) -> list[Fragment]:
    """The fragments of a text's ranges of ``size`` bytes; a token is in the range that it ends in."""
    ends_a, ends_b = np.cumsum(words.a_lengths[a]), np.cumsum(words.b_lengths[b])
    if not len(a) or ends_a[-1] <= size:
        return [single(words, a, b)]
    edges = np.arange(size, ends_a[-1] + size, size)
    at_a = [0, *np.searchsorted(ends_a, edges, side="right").tolist()]
    at_b = [0, *np.searchsorted(ends_b, edges, side="right").tolist()]
    return [
        fragment(words, a[i:j], b[k:m], ends_a[i:j], ends_b[k:m])
        for i, j, k, m in zip(at_a, at_a[1:], at_b, at_b[1:])
    ]


ENTRY = (
    "block long, row long, doc_id long, part int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " places binary, times binary"
)
OPEN = "cut boolean, a binary, b binary, text string, a_tail binary, b_tail binary"
TABLE = f"{ENTRY}, {OPEN}, pairs array<long>, counts array<long>"


def packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def unpacked(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", "<u4").astype(np.int64)


class Block:
    """Entries of some texts and the distinct pairs that they hold."""

    def __init__(self, number: int):
        self.number, self.entries, self.links, self.size = number, [], [], 0
        self.distinct = NO_TOKENS

    def add(self, entry: dict, pairs: np.ndarray) -> bool:
        """Whether the block is full."""
        found, times = np.unique(pairs, return_counts=True)
        self.entries.append(entry)
        self.links.append((found, times))
        self.size += len(pairs)
        if len(self.links) % 256 == 0 or len(found) > 4096:
            self.merge()
        return self.size >= BLOCK_LINKS or len(self.distinct) >= BLOCK_PAIRS

    def merge(self) -> None:
        self.distinct = np.unique(np.concatenate([self.distinct, *(x[0] for x in self.links[-256:])]))

    def rows(self):
        """Record batches of :data:`TABLE`: one row of pairs with their numbers, and the entries."""
        pairs = np.unique(np.concatenate([NO_TOKENS, *(x[0] for x in self.links)]))
        counts = np.zeros(len(pairs), np.int64)
        for entry, (found, times) in zip(self.entries, self.links):
            places = np.searchsorted(pairs, found)
            counts[places] += times
            entry |= {"block": self.number, "places": packed(np.diff(places, prepend=0)), "times": packed(times)}
        if len(pairs):
            yield table([{"block": self.number, "pairs": pairs.tolist(), "counts": counts.tolist()}])
        for at in range(0, len(self.entries), 512):
            yield table(self.entries[at : at + 512])


def names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(",")]


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
         "array<long>": pa.list_(pa.int64())}


def table(rows: list[dict], ddl: str = TABLE) -> pa.RecordBatch:
    fields = [field.split() for field in ddl.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], KINDS[t]) for n, t in fields], names(ddl))


def blocks_of(work, first: int = 0):
    """``work`` yields ``(entry, pairs)`` per row; the rows of this task in blocks."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()

    def run(batches):
        number = first + (task << 24)
        block = Block(number)
        for entry, pairs in work(batches, task):
            if block.add(entry, pairs):
                yield from block.rows()
                number += 1
                block = Block(number)
        yield from block.rows()

    return run


def encoding(paths: tuple[str, str], size: int):
    """Texts to entries: whole ones with their results, long ones as a fragment per range."""

    def texts(batches, task):
        from cartshift.llm.alignment import vocabularies  # the worker's own copy, kept from task to task

        words, row = vocabularies(*paths), task << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b = words.encode(text.as_py())
                found = ranges(words, a, b, size)
                row += 1
                for part, one in enumerate(found):
                    entry = {"row": row, "doc_id": doc_id, "n_groups": one.n_groups, "n_links": len(one.pairs)}
                    entry |= {"n_a": len(a) if part == 0 else 0, "n_b": len(b) if part == 0 else 0}
                    if len(found) == 1:
                        entry["groups_sha256"] = digest(one.text, len(a))
                    else:
                        entry |= {"part": part, "cut": one.cut, "text": one.text}
                        entry |= {k: packed(getattr(one, k)) for k in ("a", "b", "a_tail", "b_tail")}
                    yield entry, one.pairs

    def work(batches):
        yield from blocks_of(texts)(batches)

    return work


def digest(text: str, tokens: int) -> str:
    return hashlib.sha256(text.removesuffix(";").encode()).hexdigest() if tokens else ""


PARTIAL = f"row long, part int, n_groups long, pairs array<long>, {OPEN}"


def composing(paths: tuple[str, str], last: bool):
    """Neighbouring fragments of one text into one; ``n_groups`` and ``pairs`` are what composition has closed."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        from cartshift.llm.alignment import vocabularies

        words = vocabularies(*paths)
        out = None
        for r in part.sort_values("part").itertuples():
            ends = [unpacked(getattr(r, k)) for k in ("a", "b")], [unpacked(getattr(r, k)) for k in ("a_tail", "b_tail")]
            one = Fragment(*ends[0], bool(r.cut), r.text, int(r.n_groups), np.array(r.pairs, np.int64), *ends[1])
            out = one if out is None else composed(words, out, one)
        if last:
            out = whole(words, out)
        row = {"row": part["row"].iloc[0], "part": int(part["part"].min()) // FAN_IN}
        row |= {"n_groups": out.n_groups, "pairs": out.pairs.tolist(), "cut": out.cut, "text": out.text}
        row |= {k: packed(getattr(out, k)) for k in ("a", "b", "a_tail", "b_tail")}
        return pd.DataFrame([row])[names(PARTIAL)]

    return work


def reduced(parts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One fragment per long text, by a tree over neighbours; each level is stored."""
    count = (parts.agg(F.max("part")).first()[0] or 0) + 1
    partial = parts.select(
        "row", "part", F.lit(0).cast("long").alias("n_groups"), F.array().cast("array<long>").alias("pairs"), *names(OPEN)
    )
    while True:
        last = count <= FAN_IN
        partial = stored(
            partial.groupBy("row", F.expr(f"part div {FAN_IN}").alias("_step")).applyInPandas(composing(paths, last), PARTIAL)
        )
        if last:
            return partial
        count = -(-count // FAN_IN)


def seams(batches):
    """The links that composition closed, as entries in blocks of their own."""

    def entries(batches, _):
        for batch in batches:
            for r in batch.to_pylist():
                pairs = np.array(r["pairs"], np.int64)
                entry = {"row": r["row"], "part": -1, "n_a": 0, "n_b": 0}
                yield entry | {"n_groups": r["n_groups"], "n_links": len(pairs), "groups_sha256": digest(r["text"], 1)}, pairs

    yield from blocks_of(entries, 1 << 62)(batches)


RESULT = "row long, doc_id long, part int, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def adding(key, entries: pa.Table, answers: pa.Table) -> pa.Table:
    """The entries of a block with what its pairs were answered."""
    order = np.argsort(answers.column("place").to_numpy())
    count = answers.column("count").to_numpy()[order]
    best = answers.column("best").to_numpy()[order].astype(np.int64)
    n_best, total = [], []
    for places, times in zip(entries.column("places").to_pylist(), entries.column("times").to_pylist()):
        at, times = np.cumsum(unpacked(places)), unpacked(times)
        n_best.append(int((best[at] * times).sum()))
        total.append(int((count[at] * times).sum()))
    for name, values in (("n_best", n_best), ("count_sum", total)):
        entries = entries.append_column(name, pa.array(values, pa.int64()))
    return entries.select(names(RESULT))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and
    ``groups_sha256``.

    Both encode a space and the whole text: ``byte_path`` is a byte-level BPE file, ``piece_path`` a sentencepiece model
    that adds the space; every executor can open them. Null and empty texts and those whose bytes either does not
    give back have no tokens: zeros and an empty digest. Equal texts and repeated rows each get a row, also with a
    null id, and count as often as they stand there; ties for the highest count of an id are all counted. Other columns
    are ignored; an empty table gives an empty result. The result does not depend on ``range_bytes``.
    """
    paths = byte_path, piece_path
    ship(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    coded = stored(given.mapInArrow(encoding(paths, range_bytes), TABLE))
    parts = reduced(coded.where("part is not null").drop("pairs"), paths)
    closed_later = stored(parts.select("row", "n_groups", "pairs", "text").mapInArrow(seams, TABLE))

    def both(*columns):
        return coded.select(*columns).unionByName(closed_later.select(*columns))

    lists = both("block", "pairs", "counts").where("pairs is not null")
    totals = stored(
        lists.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.counts").alias("count"))
        .withColumn("b", F.expr("pair & 4294967295"))
    )
    highest = totals.groupBy("b").agg(F.max("count").alias("most"))
    known = stored(totals.join(highest, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))
    asked = lists.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(known, "pair").select(F.col("block").alias("asker"), "place", "count", "best")
    answered = (
        both(*names(ENTRY))
        .where("row is not null")
        .groupBy("block")
        .cogroup(answers.groupBy("asker"))
        .applyInArrow(adding, RESULT)
    )
    columns = names(RESULT)[3:-1]
    answered = stored(answered)
    long = answered.where("part is not null").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in columns], F.max("groups_sha256").alias("groups_sha256")
    )
    return answered.where("part is null").select("doc_id", *columns, "groups_sha256").unionByName(long.drop("row"))


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
