"""Token ids in files that give any token without decoding a block: directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the next
chunk of the ids that have one, and so on. A level's continuation bitmap has a set bit for each entry that
goes on in the next level, and its rank directory holds the number of set bits before every 512 entries, so
the place of an id's next chunk is one directory entry plus a count within one small block.

A file set is a Parquet table of shards in ascending order of documents; a row is one shard. A shard
(``data``) is, in little-endian 64-bit numbers: magic, documents, ids, levels, then per level the number of
its entries; the start of every document and the end; per level the rank directory; per level the bitmap and
then the chunks as bytes. The document ids, ``n_tokens`` and the shard's place are columns beside it, so
totals are read without the codes.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .automaton import byte_names
from .common import scratch, ship

MAGIC = 0x31434144
BLOCK = 512  # entries per rank directory entry
SHARD_IDS = 1_000_000
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch  # letters with one code point each in normal form
CLOSING = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe, which may start a piece
CHUNKS_KEPT = 1_200_000  # runs whose ids a worker keeps, some 200 bytes each


def shard_bytes(documents: list[np.ndarray]) -> bytes:
    """One shard of the ids of some documents."""
    starts = np.zeros(len(documents) + 1, np.int64)
    np.cumsum([len(d) for d in documents], out=starts[1:])
    rest = np.concatenate(documents).astype(np.uint32) if documents else np.empty(0, np.uint32)
    sizes, directories, levels = [], [], []
    while True:
        goes_on = rest >> 8 > 0
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK), dtype=np.int64)))) if len(rest) else np.zeros(1, np.int64)
        sizes.append(len(rest))
        directories.append(ranks.astype("<i8").tobytes())
        levels.append(np.packbits(goes_on, bitorder="little").tobytes() + (rest & 255).astype(np.uint8).tobytes())
        if not goes_on.any():
            break
        rest = rest[goes_on] >> 8
    head = np.array([MAGIC, len(documents), starts[-1], len(sizes), *sizes], "<i8")
    return head.tobytes() + starts.astype("<i8").tobytes() + b"".join(directories) + b"".join(levels)


class Shard:
    """Random access to a shard's ids."""

    def __init__(self, data: bytes):
        magic, documents, self.size, levels = np.frombuffer(data, "<i8", 4).tolist()
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        sizes = np.frombuffer(data, "<i8", levels, 32).tolist()
        at = 32 + 8 * levels
        self.starts = np.frombuffer(data, "<i8", documents + 1, at)
        at += 8 * (documents + 1)
        self.ranks, self.bits, self.chunks = [], [], []
        for n in sizes:
            count = -(-n // BLOCK) + 1
            self.ranks.append(np.frombuffer(data, "<i8", count, at))
            at += 8 * count
        for n in sizes:
            self.bits.append(np.frombuffer(data, np.uint8, -(-n // 8), at))
            at += -(-n // 8)
            self.chunks.append(np.frombuffer(data, np.uint8, n, at))
            at += n

    def rank(self, level: int, place: int) -> int:
        """Set bits before ``place`` in a level's bitmap."""
        block = place // BLOCK
        first = block * BLOCK
        bits = np.unpackbits(self.bits[level][first // 8 : -(-place // 8)], count=place - first, bitorder="little")
        return int(self.ranks[level][block]) + int(bits.sum())

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``; only their chunks are touched."""
        out = np.zeros(stop - start, np.uint32)
        among = np.arange(stop - start)
        for level in range(len(self.chunks)):
            if stop <= start:
                break
            out[among] |= self.chunks[level][start:stop].astype(np.uint32) << np.uint32(8 * level)
            first = start // 8
            bits = np.unpackbits(self.bits[level][first : -(-stop // 8)], bitorder="little")
            goes_on = bits[start - 8 * first : stop - 8 * first].astype(bool)
            among = among[goes_on]
            start = self.rank(level, start)
            stop = start + len(among)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class ChunkEncoder(dict):
    """Encodes texts with the tokenizers library, each run of other characters than ASCII white space once.

    That is exact for byte-level vocabularies that lower-case, whose pieces never hold white space, and that part
    letters from punctuation after them: nothing then reaches across such a place. Runs are kept with their ids.
    A-Z are lower-cased beforehand, unless the text may hold an added token; ASCII punctuation after plain letters
    is looked up by itself; and plain letters, which are one piece already in normal form, go to the library's
    model without its normalising and splitting.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.shown = {byte: char for char, byte in byte_names().items()}

    def piece(self, letters: str) -> list[int]:
        if not letters.isascii():
            letters = "".join(map(self.shown.__getitem__, letters.encode("utf-8")))
        return [t.id for t in self.model.tokenize(letters)]

    def __missing__(self, run: bytes) -> bytes:
        if len(self) > CHUNKS_KEPT:
            self.clear()
        head = run.rstrip(CLOSING)
        text = head.decode("utf-8")
        if not PLAIN(text):
            ids = self.tokenizer.encode(run.decode("utf-8"), add_special_tokens=False).ids
        elif len(head) < len(run):
            self[run] = found = self[head] + self[run[len(head) :]]
            return found
        else:
            ids = self.piece(text.lower())
        found = struct.pack(f"<{len(ids)}I", *ids)
        self[run] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8")
        if b"<|" not in data:
            data = data.lower()  # bytes: A-Z only
        return np.frombuffer(b"".join(map(self.__getitem__, data.split())), "<u4")


ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = ChunkEncoder(path)
    return ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode all texts of ``docs`` and write them to ``path`` in ascending ``doc_id`` order.

    Null and empty texts are ``end_id`` alone. Rows without an id come first; rows of one id stand
    together, in the order of their texts' digests. Other columns are ignored. An empty table gives a file
    set without shards. Documents are dealt by ranges of id and digest, so no id gathers in one task; a
    shard is closed when it holds ``shard_ids`` ids.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    ordered = (
        docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_digest"), F.col("text").alias("_text"))
        .repartitionByRange("_id", "_digest")
        .sortWithinPartitions("_id", "_digest")
        .select("_id", "_text")
    )

    def work(batches):
        from cartshift.llm.tokenfiles import chunk_encoder

        encoder, part, number = chunk_encoder(vocabulary), TaskContext.get().partitionId(), 0
        end, ids, documents, size = np.array([end_id], "<u4"), [], [], 0

        def flush():
            row = [(part << 32) + number], [size], [shard_bytes(documents)]
            all_ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(row[0], pa.int64()),
                    pa.array(row[1], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
                    pa.array(row[2], pa.binary()),
                ],
                ["shard", "n_tokens", "doc_ids", "data"],
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids.append(batch.column(0))
                for text in batch.column(1).to_pylist():
                    found = encoder.encode(text)
                    documents.append(np.concatenate((found, end)))
                    size += len(found) + 1
                if size >= shard_ids:
                    yield flush()
                    ids, documents, size, number = [], [], 0, number + 1
        if documents:
            yield flush()

    ordered.mapInArrow(
        work, f"shard long, n_tokens long, doc_ids array<{kind}>, data binary"
    ).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, per_document=None, schema: str = "ids array<long>") -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and what ``per_document`` makes of a
    document's ids: a function from an array to a tuple, of the columns in ``schema``. By default the ids."""
    ship(spark)
    table = spark.read.parquet(path)
    kind = dict(table.dtypes)["doc_ids"].removeprefix("array<")[:-1]
    before = table.select("shard", F.col("n_tokens").alias("_n")).select(
        "shard",
        F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
        F.col("_n"),
    )  # a row per million ids
    shards = table.join(before.select("shard", (F.col("_upto") - F.col("_n")).alias("before")), "shard")
    make = per_document or (lambda ids: (ids.astype(np.int64).tolist(),))
    full = f"doc_id {kind}, start long, n_tokens long, {schema}"
    names = spark.createDataFrame([], full).schema

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(names)
        for batch in batches:
            for row in range(batch.num_rows):
                shard, ids = Shard(batch.column("data")[row].as_py()), batch.column("doc_ids")[row].values
                made = [make(shard.document(i)) for i in range(len(ids))]
                base = batch.column("before")[row].as_py()
                columns = [ids, pa.array(base + shard.starts[:-1]), pa.array(np.diff(shard.starts))]
                columns += [pa.array([m[k] for m in made], f.type) for k, f in enumerate(list(target)[3:])]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in target])

    return shards.select("doc_ids", "data", "before").mapInArrow(work, full)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark)
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(
        spark, path, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long"
    )
