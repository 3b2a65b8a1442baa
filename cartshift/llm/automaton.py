"""Byte-pair encoding by a deterministic automaton, and decoding by its arc labels.

The automaton's arcs carry tokens; a path spells a word, and the one path that spells it is the word's
encoding. It is built by one gadget per merge, in order. At first one state has an arc for every byte to
itself. The gadget of the merge (a, b) -> ab

* gives the arcs of a a target of their own: the state reached by b's arcs where it starts, less the arc b;
* adds an arc ab wherever there is an arc a, to a copy of the state that b's arcs lead to; none if a's state has
  no arc b by then, because earlier gadgets never let the two meet.

So every token has one target state, all arcs of a token lead there, and a state is a copy of an earlier
state less the arcs that later gadgets took. That is how the table is kept: for each token the states
and arcs that its gadget copied (``born``, ``left``, ``right``) and for each gadget the arc it took away
(``taken``), which is one entry per merge instead of one per state and token. ``has_arc`` reads a table
entry through the copies; entries that have been used are kept.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Fixed value: how byte-level vocabularies split text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS_KEPT = 150_000  # of pieces, of runs and of table entries: a worker keeps twice as many at most
LONG = 40  # pieces and runs of so many characters or more are not kept
START = 1 << 20  # above all tokens: the empty prefix of labels
PACKS = [struct.Struct(f"<{n}I").pack for n in range(LONG)]
WIDE = ("  ", " \n", "\n ")  # most texts where a space meets other white space have one of these
TOGETHER = 1 << 20  # characters of texts whose runs are looked up at once


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 characters for
    themselves, the other bytes in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            names[chr(256 + len(names) - len(plain))] = b
    return names


class Kept(dict):
    """What was looked up lately: once ``WORDS_KEPT`` entries have come, those that were not used meanwhile go."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def again(self, key):
        """An older entry, from now on a new one; None if there is none."""
        found = self.older.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def keep_all(self, entries: dict) -> None:
        if len(self) + len(entries) <= WORDS_KEPT:
            self.update(entries)
        else:
            for key, value in entries.items():
                self.keep(key, value)


class Automaton:
    """Built from a byte-level BPE vocabulary file (its vocabulary, merges and added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = byte_names()
        ids = spec["model"]["vocab"]
        self.labels: dict[int, bytes] = {i: bytes(names[c] for c in token) for token, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: text.encode() for text, i in self.added.items()}
        self.arcs: dict[bytes, int] = {bytes([b]): ids[c] for c, b in names.items()}
        self.born = {i: 0 for i in self.arcs.values()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.taken: dict[tuple[int, int], int] = {}
        for gadget, (a, b) in enumerate(map(self.parts, spec["model"]["merges"]), 1):
            self.merge(gadget, ids[a], ids[b], ids[a + b])
        self.longest = max(map(len, self.arcs))
        self.size = {token: len(label) for label, token in self.arcs.items()}
        self.step: dict[int, int] = {}
        self.threes: dict[bytes, tuple[int, int | None]] = {}
        self.shorter: dict[int, int | None] = {}
        self.read_labels()
        self.table = Kept()

    @staticmethod
    def parts(merge) -> list[str]:
        return merge.split(" ") if isinstance(merge, str) else merge

    def merge(self, gadget: int, a: int, b: int, ab: int) -> None:
        if a not in self.born or b not in self.born or ab in self.born:
            raise ValueError("merges must come after their parts and make each token once")
        reached = self.labels[a] in self.arcs and self.labels[b] in self.arcs and self.entry(a, b)
        self.taken[a, b] = gadget
        self.born[ab], self.left[ab], self.right[ab] = gadget, a, b
        if reached:
            self.arcs[self.labels[ab]] = ab

    def read_labels(self) -> None:
        """How labels are read byte by byte: ``step`` leads from a prefix of labels (shifted by eight bits) and
        a byte to the next prefix, which is the token if it is a label itself; ``threes`` are the prefixes of
        three bytes with the longest token in each; ``shorter`` is the longest other token that a token's
        label begins with."""
        prefixes = dict(self.arcs)
        for label, token in self.arcs.items():
            at, longest, self.shorter[token] = START, None, None
            for end in range(1, len(label) + 1):
                to = prefixes.setdefault(label[:end], START + len(prefixes))
                self.step[at << 8 | label[end - 1]] = to
                if to < START:
                    if to != token:
                        self.shorter[token] = to
                    longest = to
                if end == 3:
                    self.threes[label[:3]] = to, longest
                at = to

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state that ``state``'s arcs lead to has an arc ``token``."""
        place = state << 20 | token
        known = self.table.get(place)
        if known is None:
            known = self.table.again(place)
        if known is None:
            known = self.entry(state, token)
            self.table.keep(place, known)
        return known

    def entry(self, state: int, token: int) -> bool:
        before = len(self.taken) + 1  # gadgets that count
        while True:
            if self.taken.get((state, token), before) < before:
                return False
            older, newer = self.born[state], self.born[token]
            if not older and not newer:
                return True
            if older > newer:  # the state was copied before its gadget took the arc
                before, state = older, self.right[state]
            else:  # the arc was added after its gadget took the arc b from a's state
                before, token = newer + 1, self.left[token]

    def tokens(self, word: bytes) -> list[int]:
        """The tokens on the path that spells ``word``.

        Every prefix is spelt by one path at most, so the state at a place does not depend on how it was reached
        and a place that leads nowhere is tried once. Longer arcs are tried first: the longest one is found by
        one pass over the bytes, the others are known from it.
        """
        n = len(word)
        whole = self.arcs.get(word)
        if whole is not None or not n:
            return [whole] if n else []
        threes, step, size, shorter = self.threes, self.step, self.size, self.shorter
        table, has_arc = self.table, self.has_arc
        path: list[int] = []  # tokens
        dead: set[int] = set()
        at, last = 0, None
        while at < n:
            begun = threes.get(word[at : at + 3])
            if begun is None:
                prefix, token, ahead = START, None, word[at : at + 2]
            else:
                prefix, token = begun
                ahead = word[at + 3 : at + self.longest]
            for byte in ahead:
                prefix = step.get(prefix << 8 | byte)
                if prefix is None:
                    break
                if prefix < START:
                    token = prefix
            while True:
                if token is None:  # nothing goes on from here: back to the place before, and on with shorter arcs
                    dead.add(at)
                    token = path.pop()
                    at -= size[token]
                    last = path[-1] if path else None
                elif at + size[token] not in dead:
                    if last is None:
                        break
                    known = table.get(last << 20 | token)
                    if known or known is None and has_arc(last, token):
                        break
                token = shorter[token]
            path.append(token)
            last = token
            at += size[token]
        return path


class Codec(Kept):
    """Pieces to their ids as little-endian bytes, kept; the pieces of a text are looked up at once.

    Most texts part at single spaces, and a space before other characters always begins a piece; so a run between
    two spaces is looked up as a whole, with the space before it, and the new runs of many texts are learnt
    together. A text where a space meets other white space is split by the pattern alone.
    """

    def __init__(self, path: str):
        super().__init__()
        self.automaton = Automaton(path)
        self.pieces = regex.compile(PIECES).findall
        self.runs = Runs(self)
        added = sorted(self.automaton.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in self.automaton.added.items()}

    def __missing__(self, word: str) -> bytes:
        found = self.again(word)
        if found is None:
            found = self.runs.get(word[1:]) if word[0] == " " else None
        if found is None:
            found = self.ids(word)
            if len(word) < LONG:
                self.keep(word, found)
        return found

    def ids(self, word: str) -> bytes:
        tokens = self.automaton.tokens(word.encode("utf-8"))
        if len(tokens) < len(PACKS):
            return PACKS[len(tokens)](*tokens)
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def joined(self, text: str, runs: list[str]) -> bytes:
        if len(runs) > 1 and not irregular(runs[0]):
            try:
                return self.split(runs[0]) + b"".join(map(self.runs.__getitem__, runs[1:]))
            except TypeError:  # a run that cannot be looked up alone
                pass
        return self.split(text)

    def split(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def marked(self, text: str) -> bytes:
        """The ids of a text with added tokens."""
        return b"".join(self.special_ids.get(p) or self.joined(p, p.split(" ")) for p in self.special.split(text))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; runs that are new are learnt at once for texts of ``TOGETHER`` characters."""
        near: list[str] = []
        size = 0
        for text in texts:
            near.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self.encode_near(near)
                near, size = [], 0
        yield from self.encode_near(near)

    def encode_near(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []  # None: with added tokens; empty: not to be looked up by runs
        for text in texts:
            if any(s in text for s in self.special_ids):
                split.append(None)
            else:
                split.append([] if any(s in text for s in WIDE) else text.split(" "))
        self.runs.learn(set().union(*(runs[1:] for runs in split if runs)))
        return [self.marked(t) if runs is None else self.joined(t, runs) for t, runs in zip(texts, split)]

    def decode(self, ids: bytes) -> str:
        labels = self.automaton.labels
        return b"".join(map(labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def irregular(run: str) -> bool:
    return not run or run[0].isspace() or run[-1].isspace()


class Runs(Kept):
    """Runs between single spaces to the ids of the run with the space before it; None for irregular ones."""

    def __init__(self, pieces: Codec):
        super().__init__()
        self.codec = pieces

    def __missing__(self, run: str) -> bytes | None:
        if irregular(run):
            return None
        found = self.again(run)
        if found is None:
            found = self.ids(self.codec.pieces(" " + run))
            if len(run) < LONG:
                self.keep(run, found)
        return found

    def ids(self, pieces: list[str]) -> bytes:
        if len(pieces) == 1:
            return self.codec.get(pieces[0]) or self.codec.ids(pieces[0])  # kept here alone
        return b"".join(map(self.codec.__getitem__, pieces))

    def learn(self, runs: set[str]) -> None:
        """Keeps those of ``runs`` that are not known. They are split by the pattern as one text, where the
        piece that begins with a space begins a run; in order, as words that begin alike read the same
        entries of the automaton."""
        older = self.older
        fresh = [run for run in runs if run not in self]
        new = sorted(run for run in fresh if run not in older and len(run) < LONG and not irregular(run))
        self.keep_all({run: older[run] for run in fresh if run in older})
        if not new:
            return
        pieces = self.codec.pieces(" " + " ".join(new))
        begins = [i for i, piece in enumerate(pieces) if piece[0] == " "]
        ends = [*begins[1:], len(pieces)]
        self.keep_all({
            run: self.ids(pieces[begin:end]) for run, begin, end in zip(new, begins, ends, strict=True)
        })


CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker and file."""
    if path not in CODECS:
        CODECS[path] = Codec(path)
    return CODECS[path]


def encoded(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` per row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file that every executor can open. Whole texts are
    encoded; null and empty ones have no ids and decode to the empty text. Strings of added tokens in a
    text are those tokens. Repeated rows each get a row; other columns are ignored; an empty table gives
    an empty result. ``decoded`` is made from the ids alone.
    """
    ship(docs.sparkSession)
    given = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in given.dtypes[:-1]) + ", ids binary, decoded string"

    def work(batches):
        from cartshift.llm.automaton import codec  # the worker's own copy, kept from task to task

        coder = codec(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = list(coder.encode_all([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]))
                columns = [
                    *(batch.column(i) for i in range(batch.num_columns - 1)),
                    pa.array(ids, pa.binary()),
                    pa.array([coder.decode(i) for i in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "ids", "decoded"])

    return given.mapInArrow(work, schema)


def digests(coded: DataFrame, *keep: str) -> DataFrame:
    return coded.select(
        *keep,
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encoded(docs, public_tokenizers.path("byte_bpe_50k.json")), "doc_id")
