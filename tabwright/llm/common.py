"""Helpers the operators share: shared-folder tables, byte-level words and hashes, streamed sums, components.

Text work inside tasks is numpy over the UTF-8 bytes of an Arrow batch, a few hundred kilobytes at a time,
so memory follows the longest single text and not the size of a batch or a group.
"""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import checkpointed  # noqa: F401

#: Bytes of text handled at once inside a task.
CHUNK = 1 << 19
#: Bytes of an Arrow batch at most.
BATCH = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``; a local master may use its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tabwright-shared-")
    return f"{base.rstrip('/')}/tabwright-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 16 MB at most: a batch of texts stays in memory on both sides, once for each core."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH:
        spark.conf.set(key, str(BATCH))


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: lineage ends there and lost executors cost nothing."""
    bounded_batches(df.sparkSession)
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished rounds: it does so when the driver collects their plans, which short rounds put off.

    Arrow's free memory goes back as well.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``shared_table`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- bytes, words, hashes

_M = 0x9E3779B97F4A7C15 | 1
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word: white space only, or every ASCII byte that is neither letter nor digit.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x30] = NON_ALNUM[0x3A:0x61] = NON_ALNUM[0x7B:0x80] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the byte-hash multiplier and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, m in enumerate((_MULTIPLIER, _INVERSE)):
            step = np.full(size, m, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums over bytes: any substring's hash is a difference times an inverse power."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column with their bytes and offsets (null: empty), at most ``limit`` bytes or one row."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, n)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def find_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and hash of every word of the texts in ``data``, A-Z lower-cased."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    low = LOWER[data]
    inside = ~breaks[low]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    return start, end, text, substring_hash(prefix_hash(low), start, end)


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_M)) | np.uint64(1)


def shingles(words: np.ndarray, text: np.ndarray, n_texts: int, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of every run of ``width`` words; with ``short`` a shorter text is one run."""
    size = max(0, len(words) - width + 1)
    total = np.zeros(size, np.uint64)
    for j in range(width):
        total += words[j : j + size] * _STEPS[j]
    first = np.flatnonzero(text[:size] == text[width - 1 : width - 1 + size]) if size else np.zeros(0, np.int64)
    value, owner = mix(total[first]), text[first]
    if short and len(words):
        counts = np.bincount(text, minlength=n_texts)
        few = np.flatnonzero((counts > 0) & (counts < width))
        if len(few):
            at = np.cumsum(counts) - counts
            extra = np.array([mix(np.atleast_1d((words[at[t] : at[t] + counts[t]] * _STEPS[: counts[t]]).sum(dtype=np.uint64) + np.uint64(counts[t])))[0] for t in few], np.uint64)
            value, owner, first = np.concatenate([value, extra]), np.concatenate([owner, few]), np.concatenate([first, at[few]])
            order = np.argsort(owner, kind="stable")
            value, owner, first = value[order], owner[order], first[order]
    return value, owner, first


def sorted_within(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``value`` sorted inside each text's run; texts are in order."""
    value = value.copy()
    edges = np.flatnonzero(owner[1:] != owner[:-1]) + 1 if len(owner) else np.zeros(0, np.int64)
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(value)], strict=True):
        value[start:end].sort()
    return value


def distinct(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different values, in order of (text, value)."""
    value = sorted_within(value, owner)
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], owner[keep]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


# ---------------------------------------------------------------- bounded tables summed over all tasks

BLOCK = 4096


def summed_blocks(parts: DataFrame, dtype: str, fold: str, size: int) -> np.ndarray:
    """Fold rows (block int, data binary) into one dense array of ``size`` numbers; at most ``size`` numbers reach the driver.

    Each task streams over its blocks and holds one accumulator per block, whatever the number of rows.
    """
    spark = parts.sparkSession
    count = max(1, min(partitions(spark), -(-size // BLOCK)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, dtype)
                if block not in held:
                    held[block] = part.copy()
                elif fold == "sum":
                    held[block] += part
                else:
                    held[block] |= part
        if held:
            yield pa.record_batch({"block": pa.array(list(held), pa.int32()), "data": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    out = np.zeros(-(-size // BLOCK) * BLOCK, dtype)
    for block, data in parts.repartition(count, "block").mapInArrow(add, "block int, data binary").collect():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bytes(data), dtype)
    return out[:size]


def dense_blocks(array: np.ndarray) -> pa.RecordBatch:
    """The non-empty blocks of a dense array as rows for ``summed_blocks``."""
    pad = np.zeros(-len(array) % BLOCK, array.dtype)
    rows = np.concatenate([array, pad]).reshape(-1, BLOCK)
    used = np.flatnonzero(rows.any(axis=1))
    return pa.record_batch({"block": pa.array(used.astype(np.int32)), "data": pa.array([rows[k].tobytes() for k in used], pa.binary())})


def dense_batches(array: np.ndarray, blocks: int = 256) -> Iterator[pa.RecordBatch]:
    """``dense_blocks`` of a long array, ``blocks`` at a time, so that it is not copied whole."""
    for first in range(0, len(array), blocks * BLOCK):
        batch = dense_blocks(array[first : first + blocks * BLOCK])
        if len(batch):
            yield pa.record_batch({"block": pa.array(batch.column(0).to_numpy() + np.int32(first // BLOCK)), "data": batch.column(1)})


class Bits:
    """A bitmap of 2^``bits`` bits over scrambled 64-bit values: a filter of fixed size with false positives only.

    It travels compressed, so that few keys cost little, and unfolds once in each process.
    """

    def __init__(self, data: np.ndarray, bits: int):
        self.bits, self.blob = bits, zlib.compress(data.tobytes(), 1)

    @functools.cached_property
    def data(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.blob), np.uint8)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "blob": self.blob}

    def hit(self, values: np.ndarray) -> np.ndarray:
        at = mix(values) >> np.uint64(64 - self.bits)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(rows: DataFrame, bits: int, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> Bits:
    """The values of the long column ``key``, or of the batches that ``keys`` makes of the rows' in the same worker; 2^``bits`` bits at most reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (bits - 3), np.uint8)
        for batch in keys(batches) if keys else batches:
            at = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - bits)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        yield from dense_batches(held)

    return Bits(summed_blocks((rows if keys else rows.select("key")).mapInArrow(mark, "block int, data binary"), "uint8", "or", 1 << (bits - 3)), bits)


#: Pairs of ids that may be broadcast: 4 MB at most.
FEW_PAIRS = 200_000


def with_both(pairs: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b and more) with the named columns of ``table`` for either, as a_* and b_*.

    The pairs go to the table where their counted number allows it, so the columns of the side with more different keys reach their
    pairs without a shuffle; these are then dealt once to the other side's rows, of which each named one is sent once and not with every pair.
    """
    count, firsts, seconds = pairs.agg(F.count(F.lit(1)), F.approx_count_distinct("a"), F.approx_count_distinct("b")).first()
    few, many = ("a", "b") if firsts <= seconds else ("b", "a")
    small = count <= FEW_PAIRS
    sent = F.broadcast(pairs) if small else pairs
    named = pairs.select(F.col(few)).distinct()
    side = lambda name: table.select(F.col(key).alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return sent.join(side(many), many).join(side(few).join(F.broadcast(named) if small else named, few, "left_semi"), few)


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph in columns ``a`` and ``b``: root is the smallest node that edges reach.

    Minimum labels spread over edges, then labels follow labels, until nothing changes; each round is checkpointed.
    Nodes and edges stay distributed; copies of a hub's edges are combined map-side by the minimum. Labels of few edges go to all tasks,
    which leaves one shuffle a round.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    send = F.broadcast if both.count() <= FEW_PAIRS else lambda df: df
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = both.join(send(labels.select(F.col("node").alias("b"), "root")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(send(near), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = checkpointed(step.join(send(jump), "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = step.select("node", "root")
        release(edges.sparkSession)
        if step.where("root <> was").limit(1).count() == 0:
            return labels


def ids_only(df: DataFrame, function: Callable, schema: str, *columns: str) -> DataFrame:
    """``function`` over Arrow batches of the named columns alone, so that other columns can have any name."""
    return df.select(*columns).mapInArrow(function, schema)


def boxed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, row): the whole row as one column, with its id and two hashes of its text, so that no column name can clash."""
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"), whole.alias("row"))
