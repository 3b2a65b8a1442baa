"""Katz back-off language model, learned from and applied to a whole corpus.

    P(w | h) = d(c(h w)) c(h w) / c(h)     if h w was seen
             = alpha(h) P(w | h')          otherwise, h' being h without its first token

d(r) are Good-Turing discounts; alpha(h) is what they leave over, divided by the lower order's mass of
the words that never followed h, so that every distribution sums to one exactly. The lowest order gives
its leftover to one unknown word.

How it runs: texts become blocks of some million tokens, stored once, whose tokens are numbers of the
block's own dictionary. For each order a block sends every distinct n-gram once to the part
that owns the n-gram's context; the part adds up, stores its totals and sends back those that the block
asked about. Parts number what they own, common ones first, and these numbers name words and contexts from then on: an
n-gram is a context's number and a word's, exact and of a few bytes. A message lists its contexts and its words in
order of their numbers, by the steps between them, and an n-gram is a place in the list of words; what a part needs to
know of a word stands there once. What a block sends depends on the block
alone, so the messages grow with the corpus and no faster. So the n-gram tables are stored by part, a very common word, pair or context is one row per
block before it is shuffled, and nothing but a few sums per part reaches the driver. Contexts with more
than a thousandth of all tokens (a thousand at most, whatever the corpus) are spread over all parts, and
their sums are put together from them.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, ship, stored

BLOCK_TOKENS = 1_000_000
PART_TOKENS = 1_500_000  # tokens of the corpus for each part of an n-gram table
HOT_SHARE = 1000  # a context is spread if it has more than one in so many tokens
LOW = 5  # counts up to this are discounted by Good-Turing
HELD_BACK = 1e-3  # of one count, taken from higher counts, so that no context leaves nothing over
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))  # no word holds a space
START = 0  # number of the context before the first token; parts number from 1 on


def mix(a: np.ndarray, b) -> np.ndarray:
    """Spreads pairs of numbers evenly."""
    a, b = a.astype(np.uint64), np.asarray(b, np.uint64)
    with np.errstate(over="ignore"):
        x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def planes(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers by byte, the lowest bytes of all first, without the bytes that none needs."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    data = np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(data.T).ravel()


def joined(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        found = data.reshape(-1, n)
        out[:, : len(found)] = found.T
    return out.view(np.int64).ravel()


def steps_of(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers that hardly differ from one to the next, by the steps between them; see :func:`planes`."""
    steps = np.diff(numbers.astype(np.int64), prepend=0)
    return planes((steps << 1) ^ (steps >> 63))


def walked(data: np.ndarray, n: int) -> np.ndarray:
    steps = joined(data, n)
    return np.cumsum((steps >> 1) ^ -(steps & 1))


def packed(*arrays) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    return zstandard.compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as one byte each, nearly all of which are the same few, and those that need more."""
    return np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.int64)


def large(low: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[out == 255] = rest
    return out


COUNTS = np.uint8, np.int64  # kinds of :func:`small`


def listed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of which many are equal, as a list of the different ones and places in it, low and high halves."""
    different, at = np.unique(values, return_inverse=True)
    return different, (at & 0xFFFF).astype(np.uint16), (at >> 16).astype(np.uint16)


def unlisted(different: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return different[low.astype(np.int64) | high.astype(np.int64) << 16] if len(low) else np.empty(0)


LISTED = np.float64, np.uint16, np.uint16  # kinds of :func:`listed`


def summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by index (exact: they stay below 2**53)."""
    return np.bincount(index, weights=values, minlength=n).astype(np.int64)


# ---------------------------------------------------------------- blocks


def block_row(number: int, texts: pa.Array, ids: pa.Array, held: np.ndarray):
    """One block: token numbers by falling frequency, with the end of each text as a token."""
    tokens = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    lengths = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
    words = tokens.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    text_of = np.repeat(np.arange(len(lengths)), lengths)[real]
    lengths = np.bincount(text_of, minlength=len(lengths)).astype(np.int64)
    coded = words.filter(pa.array(real)).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    digest = xxhash.xxh3_64_intdigest
    names = np.fromiter((digest(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    names = np.append(names, END)
    with_end = np.insert(codes, np.cumsum(lengths), len(names) - 1)
    order = np.argsort(-np.bincount(with_end, minlength=len(names)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    return {
        "block": number,
        "ids": ids,
        "n_tokens": int(len(with_end)),
        "data": packed(rank[with_end], names[order], lengths + 1, held.astype(np.uint8)),
    }


def text_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of ``docs`` (``_id``, ``_text``, ``_held``): whole texts, to some ``block_tokens`` tokens."""
    kind = dict(docs.dtypes)["_id"]

    def work(batches):
        part, number, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            table = pa.Table.from_batches(waiting).combine_chunks()
            texts = table["_text"].combine_chunks()
            if pa.types.is_large_string(texts.type):
                texts = texts.cast(pa.string())
            ids = table["_id"].combine_chunks()
            row = block_row((part << 32) + number, texts, ids, table["_held"].to_numpy())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([row["block"]], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([row["n_tokens"]], pa.int64()),
                    pa.array([row["data"]], pa.binary()),
                ],
                ["block", "ids", "n_tokens", "data"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                waiting.append(piece)
                size += pc.sum(pc.binary_length(pc.fill_null(piece.column(1), ""))).as_py() or 0
                if size >= 6 * block_tokens:
                    yield flush()
                    waiting, size, number = [], 0, number + 1
        if waiting:
            yield flush()

    return docs.select("_id", "_text", "_held").mapInArrow(
        work, f"block long, ids array<{kind}>, n_tokens long, data binary"
    )


def in_buckets(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` stored in ``n`` buckets of ``key``, so that later joins on it do not move it again."""
    name = f"blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("path", scratch(df.sparkSession)).option("compression", "none").saveAsTable(name)
    return df.sparkSession.table(name)


# ---------------------------------------------------------------- model sums


@dataclass(frozen=True)
class Order:
    """What is known of one order after its counts are summed."""

    total: int  # training n-grams
    distinct: int
    discounts: tuple[float, ...]  # for counts 0 .. LOW
    hot: dict  # number of a very common n-gram -> nothing; of the next order's contexts
    spread: dict  # number of a spread context -> (numbers of counts 1 .. LOW and above, lower mass)


def good_turing(n: list[int]) -> tuple[float, ...]:
    """Discount factors for counts 0 .. LOW from the numbers of n-grams seen 1, 2, ... LOW + 1 times.

    Where these numbers are too few or too uneven for the estimate (a factor not between zero and one),
    half a count is taken off instead.
    """
    out = [0.0]
    a = (LOW + 1) * n[LOW] / n[0] if n[0] else 1.0
    for r in range(1, LOW + 1):
        d = None
        if n[r - 1] and n[r] and a < 1:
            d = ((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a)
        out.append(d if d is not None and 0 < d < 1 else (r - 0.5) / r)
    return tuple(out)


def kept_counts(c: np.ndarray, order: Order) -> np.ndarray:
    """Discounted counts d(c) c."""
    d = np.array(order.discounts)
    return np.where(c <= LOW, d[np.minimum(c, LOW)] * c, c - HELD_BACK)


def word_p(counts: np.ndarray, order: Order) -> np.ndarray:
    """Probabilities of seen words, given the lowest order."""
    return kept_counts(counts, order) / max(order.total, 1)


def left_over(histogram: np.ndarray, order: Order) -> np.ndarray:
    """What discounting takes from n-grams, given their numbers by count (1 .. LOW, above), as counts."""
    r = np.arange(1, LOW + 1)
    taken = np.append((1 - np.array(order.discounts[1:])) * r, HELD_BACK)
    return histogram @ taken


def histogram(counts: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Numbers of counts 1 .. LOW and above by index."""
    seen = counts > 0
    flat = np.bincount(index[seen] * (LOW + 1) + np.minimum(counts[seen], LOW + 1) - 1, minlength=n * (LOW + 1))
    return flat.reshape(n, LOW + 1).astype(np.int64)


def count_stats(counts: np.ndarray) -> dict:
    seen = counts[counts > 0]
    few = np.bincount(np.minimum(seen, LOW + 2), minlength=LOW + 3)[1 : LOW + 2]
    return {"total": int(seen.sum()), "distinct": len(seen), "few": few.tolist(), "hot": [], "spread": []}


def read_order(rows) -> Order:
    """The parts' sums put together; rows hold a part's few numbers and its share of the spread contexts."""
    total = distinct = 0
    few, hot, spread = np.zeros(LOW + 1, np.int64), {}, {}
    for row in rows:
        s = json.loads(row["answer"])
        total, distinct, few = total + s["total"], distinct + s["distinct"], few + np.array(s["few"])
        hot.update((k, None) for k in s["hot"])
        for key, numbers, mass in s["spread"]:
            was = spread.get(key, (np.zeros(LOW + 1, np.int64), 0.0))
            spread[key] = (was[0] + np.array(numbers), was[1] + mass)
    return Order(total, distinct, good_turing(few.tolist()), hot, spread)


# ---------------------------------------------------------------- what a block knows


class Block:
    """A block's n-grams and, order by order, the totals that the parts sent back."""

    def __init__(self, data: bytes):
        self.codes, self.names, self.lengths, held = unpacked(data, np.uint32, np.uint64, np.int64, np.uint8)
        self.held = held.astype(bool)
        self.text_of = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.trained = ~self.held[self.text_of]
        self.gram = self.codes  # which of the block's n-grams ends at each token
        self.count_own(len(self.names))

    def count_own(self, n: int) -> None:
        self.local = np.bincount(self.gram, weights=self.trained, minlength=n).astype(np.int64)
        self.local_all = np.bincount(self.gram, minlength=n).astype(np.int64)

    def first_order(self, order: Order, counts: np.ndarray, numbers: np.ndarray) -> None:
        self.counts, self.numbers, self.word_numbers = counts, numbers, numbers
        self.word_counts = counts
        if order.total:
            unknown = left_over(np.array(self.unigram_histogram(order)), order) / order.total
        else:
            unknown = 1.0
        self.p = np.where(counts > 0, word_p(counts, order), unknown)

    @staticmethod
    def unigram_histogram(order: Order) -> list[int]:
        return order.spread[""][0]

    def next_order(self, starts: int) -> None:
        """The n-grams one longer: distinct pairs of a context (what ended one token earlier) and a word, sorted by number.
        ``starts``: how many training texts there are, the count of the context before the first token."""
        n = len(self.numbers)
        pairs = np.empty(len(self.gram), np.int64)
        pairs[1:] = self.gram[:-1]
        pairs[self.first] = n  # before the first token
        pairs *= len(self.names)
        pairs += self.codes
        pairs, where, inverse = np.unique(pairs, return_index=True, return_inverse=True)
        context, word = ((f(pairs, len(self.names))).astype(np.int32) for f in (np.floor_divide, np.remainder))
        contexts, words = np.append(self.numbers, START)[context], self.word_numbers[word]
        order = np.lexsort((words, contexts))
        self.context, self.word, self.contexts, self.words = context[order], word[order], contexts[order], words[order]
        self.context_counts = np.append(self.counts, starts)
        self.lower = self.p[self.gram[where[order]]]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.gram = rank[inverse]
        self.count_own(len(pairs))

    def owners(self, parts: int, hot: dict) -> np.ndarray:
        """The part that owns each n-gram."""
        spread = np.isin(self.contexts, np.array([int(k) for k in hot], np.int64))
        return (mix(self.contexts, np.where(spread, self.words, 0)) % np.uint64(parts)).astype(np.int64)

    def settle(self, order: Order, owner: np.ndarray, answers: dict, hot: dict) -> None:
        """Probabilities of this order, from the parts' answers."""
        self.counts, self.numbers = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        left, mass = np.zeros(len(owner)), np.zeros(len(owner))  # of the contexts of unseen n-grams
        by_part = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[by_part], np.arange(owner.max(initial=0) + 2))
        for part, data in answers.items():
            asked = by_part[edges[part] : edges[part + 1]]
            low, rest, numbers, unseen, lower = unpacked(data, *COUNTS, np.uint8, np.uint8, np.float64)
            counts = large(low, rest)
            self.counts[asked] = counts
            if len(numbers):
                self.numbers[asked] = joined(numbers, len(counts))
            new = asked[counts == 0]
            _, context = np.unique(self.contexts[new], return_inverse=True)
            left[new] = left_over(joined(unseen, len(lower) * (LOW + 1)).reshape(-1, LOW + 1), order)[context]
            mass[new] = lower[context]
        unseen = np.flatnonzero(self.counts == 0)
        for key in hot:
            if key in order.spread:
                here = unseen[self.contexts[unseen] == int(key)]
                left[here], mass[here] = left_over(order.spread[key][0], order), order.spread[key][1]
        c = self.context_counts[self.context].astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.p = kept_counts(self.counts, order) / c
            c, mass = c[unseen], mass[unseen]
            alpha = np.where(c > 0, left[unseen] / c / np.maximum(1 - mass, 1e-300), 1.0)
        self.p[unseen] = alpha * self.lower[unseen]

    def scores(self) -> np.ndarray:
        return np.bincount(self.text_of, weights=np.log10(self.p)[self.gram], minlength=len(self.lengths))


# ---------------------------------------------------------------- exchanges

SENT = "block long, part int, sent binary"
ANSWERED = "block long, part int, answer binary"


def word_requests(blocks: DataFrame, parts: int) -> DataFrame:
    def one(number, data):
        block = Block(data)
        owner = (block.names % np.uint64(parts)).astype(np.int64)
        return sent_batch(number, owner, lambda i: packed(block.names[i], *small(block.local[i]), *small(block.local_all[i])))

    def work(batches):
        for batch in batches:
            for row, number in enumerate(batch.column(0).to_pylist()):
                yield one(number, batch.column(1)[row].as_py())

    return blocks.select("block", "data").mapInArrow(work, SENT)


def sent_batch(number: int, owner: np.ndarray, payload) -> pa.RecordBatch:
    order = np.argsort(owner, kind="stable")
    which, at = np.unique(owner[order], return_index=True)
    rows = [(number, int(p), payload(i)) for p, i in zip(which, np.split(order, at[1:]))]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))],
        ["block", "part", "sent"],
    )


def numbered(counts: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Numbers of what a part owns, which no other part gives: small ones for what is common."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return rank * parts + part + 1


def word_totals(requests: DataFrame, hot_above: int, parts: int) -> DataFrame:
    """Totals and numbers of the words of each part, sent back to the blocks that asked; block -1 holds the sums."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s in group["sent"]:
            names, *counts = unpacked(s, np.uint64, *COUNTS, *COUNTS)
            rows.append((names, large(*counts[:2]), large(*counts[2:])))
        keys, index = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        counts = summed(index, np.concatenate([r[1] for r in rows]), len(keys))
        counts_all = summed(index, np.concatenate([r[2] for r in rows]), len(keys))
        numbers = numbered(counts_all, int(group["part"].iloc[0]), parts)
        stats = count_stats(counts)
        stats["hot"] = [str(k) for k in numbers[counts_all > hot_above]]
        stats["spread"] = [("", histogram(counts, np.zeros(len(keys), np.int64), 1)[0].tolist(), 0.0)]
        edges = np.cumsum([len(r[0]) for r in rows])[:-1]
        answers = [packed(*small(counts[i]), planes(numbers[i])) for i in np.split(index, edges)]
        return answer_frame(group, answers, stats)

    return requests.groupBy("part").applyInPandas(work, ANSWERED)


def answer_frame(group: pd.DataFrame, answers: list[bytes], stats: dict) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "block": [*group["block"], -1],
            "part": [*group["part"], group["part"].iloc[0]],
            "answer": [*answers, json.dumps(stats).encode()],
        }
    )


def gram_totals(
    requests: DataFrame, hot_above: int, spread: dict, last: bool, parts: int, words_of: Order | None
) -> DataFrame:
    """As :func:`word_totals` for longer n-grams, with what unseen ones need to know of their context. Of pairs,
    ``words_of`` and the counts of words give the lower order's probabilities; of longer n-grams they are sent."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s in group["sent"]:
            a, b, contexts, c, d, places, words, known, e, f, x, y, z = unpacked(
                s, *COUNTS, np.uint8, *COUNTS, np.uint8, np.uint8, np.uint8, *COUNTS, *LISTED
            )
            runs, local = large(a, b), large(c, d)
            at = joined(places, len(local))
            n = int(at.max()) + 1
            lower = word_p(walked(known, n), words_of)[at[local > 0]] if words_of else unlisted(x, y, z)
            rows.append((np.repeat(walked(contexts, len(runs)), runs), walked(words, n)[at], local, large(e, f), lower))
        context, word, local, local_all, lower = (np.concatenate([r[i] for r in rows]) for i in range(5))
        asked = [len(r[1]) for r in rows]
        del rows
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        first = np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]))
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(first) - 1
        context = context[first]
        del order, word, first
        counts = summed(index, local, len(context))
        below = np.zeros(len(context))
        below[index[local > 0]] = lower  # equal in all blocks
        contexts, context_of = np.unique(context, return_inverse=True)
        unseen = histogram(counts, context_of, len(contexts))
        mass = np.bincount(context_of, weights=np.where(counts > 0, below, 0), minlength=len(contexts))
        stats, numbers = count_stats(counts), np.zeros(0, np.int64)
        if not last:
            counts_all = summed(index, local_all, len(context))
            numbers = numbered(counts_all, int(group["part"].iloc[0]), parts)
            stats["hot"] = [str(k) for k in numbers[counts_all > hot_above]]
        del local, local_all, lower
        shared = np.isin(contexts, np.array([int(k) for k in spread], np.int64))
        stats["spread"] = [
            (str(k), n.tolist(), float(m)) for k, n, m in zip(contexts[shared], unseen[shared], mass[shared])
        ]
        answers = []
        for i in np.split(index, np.cumsum(asked)[:-1]):
            new = np.unique(context_of[i[counts[i] == 0]])  # contexts, as numbered
            own = planes(numbers[i]) if not last else np.zeros(0, np.uint8)
            answers.append(packed(*small(counts[i]), own, planes(unseen[new].ravel()), mass[new]))
        return answer_frame(group, answers, stats)

    return requests.groupBy("part").applyInPandas(work, ANSWERED)


@dataclass
class Step:
    """An order whose totals are stored: its sums and the parts' answers by block."""

    order: Order
    hot: dict  # the contexts that were spread
    answers: DataFrame


def with_answers(blocks: DataFrame, steps: list[Step]) -> DataFrame:
    """Each block with the answers to it, order by order."""
    for i, step in enumerate(steps):
        mine = (
            step.answers.where("block >= 0")
            .groupBy("block")
            .agg(F.collect_list(F.struct("part", "answer")).alias(f"answers_{i}"))
        )
        blocks = blocks.join(mine, "block", "left")
    return blocks


def restored(batch: pa.RecordBatch, row: int, known: list[tuple[Order, dict]], parts: int, first: int) -> tuple[Block, int]:
    """The block of ``row`` with the orders in ``known`` settled; ``first``: column of the first answers."""
    block = Block(batch.column("data")[row].as_py())
    order, _ = known[0]
    owner = (block.names % np.uint64(parts)).astype(np.int64)
    counts, numbers = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    for part, data in answers_of(batch.column(first)[row]).items():
        asked = np.flatnonzero(owner == part)
        low, rest, given = unpacked(data, *COUNTS, np.uint8)
        counts[asked], numbers[asked] = large(low, rest), joined(given, len(asked))
    block.first_order(order, counts, numbers)
    end = int(counts[block.names == END][0])
    block.known = counts
    for k, (order, hot) in enumerate(known[1:], 1):
        block.next_order(end)
        block.settle(order, block.owners(parts, hot), answers_of(batch.column(first + k)[row]), hot)
    return block, end


def answers_of(scalar) -> dict:
    return {a["part"]: a["answer"] for a in scalar.as_py() or ()}


def gram_requests(blocks: DataFrame, steps: list[Step], hot: dict, parts: int, last: bool) -> DataFrame:
    known = [(s.order, s.hot) for s in steps]
    pairs = len(steps) == 1

    def one(batch, row, number):
        block, end = restored(batch, row, known, parts, 2)
        block.next_order(end)

        def payload(i):  # sorted by context, as n-grams are
            contexts = block.contexts[i]
            starts = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
            runs = np.diff(np.append(starts, len(i)))
            words, one_of, places = np.unique(block.words[i], return_index=True, return_inverse=True)
            known = block.word_counts[block.word[i[one_of]]] if pairs else np.zeros(0, np.int64)
            all_ = np.zeros(0, np.int64) if last else block.local_all[i]
            lower = np.zeros(0) if pairs else block.lower[i[block.local[i] > 0]]
            return packed(
                *small(runs), steps_of(contexts[starts]), *small(block.local[i]), planes(places), steps_of(words),
                steps_of(known), *small(all_), *listed(lower),
            )

        return sent_batch(number, block.owners(parts, hot), payload)

    def work(batches):  # a block's arrays are gone before the next one's are made
        for batch in batches:
            for row, number in enumerate(batch.column("block").to_pylist()):
                yield one(batch, row, number)

    return with_answers(blocks.select("block", "data"), steps).mapInArrow(work, SENT)


def score_texts(docs: DataFrame, held_out, order: int = 2, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Scores of all texts of ``docs`` under a model of the given order, learned from those not held out.

    Per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (seen in
    training), ``train_tokens``, ``base_score`` (unigrams with 0.1 added to every count) and ``score``
    (log10 of the text's probability). ``held_out`` is a boolean column expression; null counts as true.
    Null and empty texts are the end token alone. Repeated rows are learned and scored as often as they
    stand there; other columns are ignored; an empty table gives an empty result. Without a training text
    every token is the unknown word, of probability one.
    """
    given = docs.select(
        F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.coalesce(held_out, F.lit(True)).alias("_held")
    )
    spark = docs.sparkSession
    ship(spark)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = in_buckets(text_blocks(given, block_tokens), "block", width)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, math.ceil(tokens / part_tokens))
    hot_above = tokens // HOT_SHARE

    def step(answers, hot):
        answers = stored(answers)
        return Step(read_order(answers.where("block < 0").select("answer").toLocalIterator()), hot, answers)

    steps = [step(word_totals(word_requests(blocks, parts), hot_above, parts), {})]
    for k in range(2, order + 1):
        hot = dict(steps[-1].order.hot) | {str(START): None}
        sent = gram_requests(blocks, steps, hot, parts, k == order)
        words_of = steps[0].order if k == 2 else None
        steps.append(step(gram_totals(sent, hot_above, hot, k == order, parts, words_of), hot))
    known = [(s.order, s.hot) for s in steps]
    total, distinct = known[0][0].total, known[0][0].distinct
    base = total + 0.1 * (distinct + 1)
    kind = dict(docs.dtypes)["doc_id"]

    def one(batch, row):
        block, _ = restored(batch, row, known, parts, 3)
        n = len(block.lengths)
        seen, base_p = block.known > 0, np.log10((block.known + 0.1) / base)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("ids")[row].values,
                pa.array(block.held),
                pa.array(block.lengths),
                pa.array(np.bincount(block.text_of, weights=seen[block.codes], minlength=n).astype(np.int64)),
                pa.array(np.full(n, total, np.int64)),
                pa.array(np.bincount(block.text_of, weights=base_p[block.codes], minlength=n)),
                pa.array(block.scores()),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield one(batch, row)

    return with_answers(blocks.select("block", "ids", "data"), steps).mapInArrow(
        work,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def op7_katz(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return score_texts(docs, held)
