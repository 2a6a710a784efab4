"""Token-id files in patched frame-of-reference blocks.

A file holds the documents of one id range in ascending doc_id order. Its ids are cut into blocks of 256; a block keeps
its least id, packs the differences at a width that a chosen percentile of them fits, and lists the outliers' high parts
as (position, high part) exceptions. An index of block starts lets a reader open any block alone.

Layout, little-endian: magic, counts (documents, ids, blocks, exceptions); doc ids; ids per document; per block: least
id, width, first payload byte, first exception; packed payload; exception positions; exception high parts.

Files are written by the tasks that encode, through a file system opened from the shared folder's own URI, under a
temporary name and then renamed, so that a task that is run again replaces its file with an equal one. They are read
back by Spark's binary reader.

Defined cases: null text is empty and yields the end id alone; rows of one doc_id stand in order of a hash of
their text; null doc_ids come first; ids that aren't integers stand in the files (of 64-bit ids) as numbers in their order, and
come back as they were; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, settle, texts
from .pieces import PartMemory

VOCABULARY = "byte_bpe_50k.json"
MAGIC = b"PFOR0001"
BLOCK, PERCENTILE, END = 256, 90, 0
#: Bytes of parts that a worker remembers.
MEMORY = 100 << 20
#: A file is closed when it holds so many ids, so its size is bounded however large a partition is.
FILE_IDS = 4_000_000
#: Partitions whose files make one stretch when ids before a file are added up.
STRETCH = 4096


def pack(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids -> least, width, payload start and exception start of each block, payload, exception positions and high parts."""
    n = -(-len(ids) // BLOCK)
    padded = np.zeros(n * BLOCK, np.int64 if len(ids) and ids.max() >> 31 else np.int32)
    padded[: len(ids)] = ids
    if len(ids) % BLOCK:
        padded[len(ids) :] = ids[-1]
    rows = padded.reshape(n, BLOCK)
    least = rows.min(axis=1) if n else np.zeros(0, np.int64)
    diffs = rows - least[:, None]
    at = np.partition(diffs, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100] if n else least
    width = np.ceil(np.log2(at + 1)).astype(np.int64)
    high = diffs >> width[:, None]
    where, position = np.nonzero(high)
    first = np.searchsorted(where, np.arange(n))
    payload_at = np.concatenate([[0], np.cumsum(width * (BLOCK // 8))])
    payload = np.zeros(payload_at[-1], np.uint8)
    wide = 32 if n and width.max() > 16 else 16
    low = (diffs & ((1 << width) - 1)[:, None]).astype(f"<u{wide // 8}")
    for w in np.unique(width[width > 0]):
        chosen = np.nonzero(width == w)[0]
        bits = np.unpackbits(low[chosen].view(np.uint8).reshape(len(chosen), BLOCK, wide // 8), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(chosen), -1), axis=1, bitorder="little")
        payload[payload_at[chosen][:, None] + np.arange(packed.shape[1])] = packed
    return least.astype("<u4"), width.astype(np.uint8), payload_at[:-1].astype("<u8"), first.astype("<u4"), payload, position.astype(np.uint8), high[where, position].astype("<u4")


def unpack(n_ids: int, least, width, payload_at, first, payload, position, high) -> np.ndarray:
    n = len(least)
    diffs = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        chosen = np.nonzero(width == w)[0]
        packed = payload[payload_at[chosen].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(chosen), BLOCK, w)
        full = np.zeros((len(chosen), BLOCK, 16 if w <= 16 else 32), np.uint8)
        full[:, :, :w] = bits
        diffs[chosen] = np.packbits(full, axis=2, bitorder="little").view("<u2" if w <= 16 else "<u4")[:, :, 0]
    where = np.repeat(np.arange(n), np.diff(np.append(first, len(position)).astype(np.int64)))
    diffs[where, position] |= high << width[where]
    return (diffs + least[:, None]).reshape(-1)[:n_ids]


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    parts = pack(ids)
    counts = np.array([len(doc_ids), len(ids), len(parts[0]), len(parts[5])], "<u8")
    return b"".join([MAGIC, counts.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), *(p.tobytes() for p in parts)])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, ids per document, all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n_ids, blocks, exceptions = np.frombuffer(data, "<u8", 4, 8).tolist()
    at, out = 40, []
    for kind, n in (("<i8", docs), ("<u8", docs), ("<u4", blocks), ("u1", blocks), ("<u8", blocks), ("<u4", blocks), ("u1", None), ("u1", exceptions), ("<u4", exceptions)):
        n = len(data) - at - exceptions * 5 if n is None else n
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out[0], out[1], unpack(n_ids, *out[2:])


@lru_cache(maxsize=1)
def encoder(path: str | None = None, most: int = MEMORY) -> PartMemory:
    """The tokenizers library on each distinct part of the texts; parts met before come from memory, which serves all tasks
    of a Python worker. Parts of letters alone need no cutting, so only the library's model runs on them; all others, and
    whole texts that hold one of the vocabulary's added tokens (<|endoftext|>), go through the library as it is."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    gc.set_threshold(200_000, 20, 100)  # the memory is large and long-lived
    library = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
    tokenize, added = library.model.tokenize, [t.content for t in library.get_added_tokens_decoder().values()]
    # how the library spells bytes: visible ones as themselves, the others from 256 on
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    space = letters[32]

    def parts(strings: list[str], plain: bool) -> list[list[int]]:
        if plain:
            spelled = (x.replace(" ", space) if x.isascii() else x.encode("utf-8").decode("latin-1").translate(letters) for x in strings)
            return [[t.id for t in tokenize(x)] for x in spelled]
        return [e.ids for at in range(0, len(strings), 10_000) for e in library.encode_batch_fast(strings[at : at + 10_000], add_special_tokens=False)]

    return PartMemory(parts, most, tuple(added))


def _writer(folder: str, path: str | None, file_ids: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, encode_all = TaskContext.get().partitionId(), encoder(path).encode_all
        store, root = fs.FileSystem.from_uri(folder)
        held: list[tuple[int | None, np.ndarray]] = []
        n_held = seq = 0

        def close() -> pd.DataFrame:
            nonlocal held, n_held, seq
            doc_ids = np.array([-(1 << 63) if pd.isna(d) else d for d, _ in held], np.int64)
            data = to_bytes(doc_ids, np.array([len(x) for _, x in held]), np.concatenate([x for _, x in held]))
            name = f"part-{part:06d}-{seq:04d}.pfor"
            draft = f"{root}/_draft-{name}-{uuid.uuid4().hex}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, f"{root}/{name}")
            row = pd.DataFrame({"file": [name], "part": [part], "seq": [seq], "n_docs": [len(held)], "n_ids": [n_held]})
            held, n_held, seq = [], 0, seq + 1
            return row

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], encode_all(batch["text"].tolist()), strict=True):
                ids = np.append(ids, np.uint32(END))
                held.append((doc_id, ids))
                n_held += len(ids)
                if n_held >= file_ids:
                    yield close()
        if held:
            yield close()

    return run


def write_files(docs: DataFrame, folder: str, path: str | None = None, file_ids: int = FILE_IDS, part_bytes: int = 24 << 20) -> DataFrame:
    """Writes the token files of ``docs`` (doc_id integer, text) to ``folder``; one row per file. Partitions are ranges of
    doc_id, so files in order of (part, seq) hold ascending ids; texts are dealt before they are encoded, so that is done once. Rows of
    one id are dealt on by a hash of their text and, where that is equal too, by where they are read, so that no id is too
    large for a task."""
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    order = ["doc_id", "hash_", "read_"]
    read = texts(docs).withColumns({"hash_": F.xxhash64("text"), "read_": F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("short")})
    dealt = read.repartitionByRange(max(1, -(-size // part_bytes)), *order).sortWithinPartitions(*order)
    return settle(dealt.select("doc_id", "text").mapInPandas(_writer(folder, path, file_ids), "file string, part long, seq long, n_docs long, n_ids long"), "token-file-list")


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, data in zip(batch["path"], batch["content"], strict=True):
            doc_ids, lengths, ids = from_bytes(data)
            starts = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, starts[1:], strict=False)]
            yield pd.DataFrame({
                "file": file.rsplit("/", 1)[-1], "doc_id": pd.array([None if d == -(1 << 63) else d for d in doc_ids.tolist()], "Int64"),
                "within": starts[:-1], "n_tokens": lengths.astype(np.int64), "ids_crc32": np.array(crc, np.int64),
            })


def offsets_of(files: DataFrame) -> DataFrame:
    """named, before: each file and the ids of all files before it."""
    # running totals within stretches of files, then over the stretches
    files = files.withColumn("stretch", F.floor(F.col("part") / STRETCH))
    earlier = lambda of, window: F.coalesce(F.sum(of).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = files.groupBy(F.col("stretch").alias("of")).agg(F.sum("n_ids").alias("n")).select("of", earlier("n", Window.orderBy("of")).alias("base"))
    within = files.select("stretch", F.col("file").alias("named"), earlier("n_ids", Window.partitionBy("stretch").orderBy("part", "seq")).alias("inside"))
    return within.join(totals, F.col("stretch") == F.col("of")).select("named", (F.col("base") + F.col("inside")).alias("before"))


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Reads the token files back: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    spark = files.sparkSession
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # the reader deals files out by size: one or a few to a task
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.pfor").load(folder).select("path", "content")
    rows = raw.mapInPandas(_reader, "file string, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(offsets_of(files), F.col("file") == F.col("named")).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids other than integers stand in the files as their rows' numbers in order of the id, and are joined to what is read back."""
    folder = new_path(docs.sparkSession, "token-files")
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        out = read_files(write_files(docs.withColumn("doc_id", F.col("doc_id").cast("long")), folder, path), folder)
        return out if isinstance(kind, T.LongType) else out.withColumn("doc_id", F.col("doc_id").cast(kind))
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = settle(texts(docs).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number_", F.monotonically_increasing_id()), "token-numbers")
    got = read_files(write_files(rows.select(F.col("number_").alias("doc_id"), "text"), folder, path), folder)
    return got.withColumnRenamed("doc_id", "number_").join(rows.select("number_", "doc_id"), "number_").select("doc_id", "start", "n_tokens", "ids_crc32")
