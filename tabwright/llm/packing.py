"""Best-fit packing of tokenised documents with Martello-Toth dominance reduction (operator 7).

Documents become token ids and an end id; only documents longer than the capacity are cut, into full pieces after a
shorter first one. Which piece goes where depends on lengths alone, so the packing problem is the histogram of lengths:
at most ``capacity`` numbers, whatever the corpus. On it,

1. sets that provably dominate every other set with their largest item are fixed for good: an item that nothing fits
   beside; an item and its exact complement; the only possible partner; a partner at least as long as every
   pair that fits; an exact pair that no other pair escapes. Each is fixed as often as its items allow;
2. what is left is packed best-fit in order of falling length, equal bins at once.

The plan is a list of bin patterns with multiplicities. Pieces are numbered within their length (counts of hashed parts
give each part its first number, so no length is ranked in one task) and find their place by binary search.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import shared_table, text_chunks

CAPACITY = 1024
END_ID = 2
#: Pieces that one ranking task orders, about.
RANKED = 500_000


@functools.cache
def encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """The byte-level BPE of a public vocabulary; special strings in a text become their ids."""
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@dataclass(frozen=True)
class Vocabulary:
    """Where the vocabulary lies on every machine, how text is cut before merging, and the ids of special strings."""

    ranks_path: str
    pattern: str
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)

    def encode(self, text: str) -> list[int]:
        own = encoder(self.ranks_path, self.pattern, self.special)
        if any(name in text for name, _ in self.special):
            return own.encode(text, allowed_special="all", disallowed_special=())
        return own.encode_ordinary(text)


def public_vocabulary() -> Vocabulary:
    """The 50k byte-level BPE that is installed beside the library."""
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pieces(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; a null or empty text is its end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for first, last, _, _ in text_chunks(texts):
                out: list[list] = [[], [], [], [], []]
                for row in range(first, last):
                    ids = np.array([*vocabulary.encode(texts[row].as_py() or ""), end_id], "<u4")
                    head = len(ids) % capacity or capacity
                    starts = [0, *range(head, len(ids), capacity)] if len(ids) > capacity else [0]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        for column, value in zip(out, (row, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                            column.append(value)
                yield pa.record_batch([batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, t) for x, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the plan, on counts by length

Pattern = tuple[tuple[int, int], ...]


def dominance(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Fixed patterns with multiplicities; takes their items out of ``counts``."""
    fixed: list[tuple[Pattern, int]] = []

    def fix(*items: int) -> None:
        need = {x: items.count(x) for x in items}
        times = min(int(counts[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                counts[x] -= n * times
            fixed.append((tuple(sorted(need.items(), reverse=True)), times))

    changed = True
    while changed:
        before = len(fixed)
        for j in range(capacity, 0, -1):
            while counts[j]:
                step = len(fixed)
                room = capacity - j
                counts[j] -= 1
                rest = np.flatnonzero(counts[: room + 1])
                few = np.repeat(rest[:3], np.minimum(counts[rest[:3]], 3))[:3]
                counts[j] += 1
                if not len(rest):
                    fix(j)
                elif rest[-1] == room or few[:2].sum() > room or len(few) == 1:
                    fix(j, int(rest[-1]))
                elif few.sum() > room or len(few) == 2:
                    best, low = 0, 0
                    for b in rest.tolist():
                        mates = rest[: np.searchsorted(rest, room - b, "right")]
                        mates = mates[mates >= b]
                        if len(mates) and int(mates[-1]) == b and counts[b] - (b == j) < 2:
                            mates = mates[:-1]
                        if len(mates) and b + int(mates[-1]) > best:
                            best, low = b + int(mates[-1]), b
                    over = rest[rest > low]
                    two = np.repeat(over[:2], np.minimum(counts[over[:2]], 2))[:2]
                    if rest[-1] >= best:
                        fix(j, int(rest[-1]))
                    elif best == room and best - low == rest[-1] and (len(two) < 2 or two.sum() > room):
                        fix(j, int(rest[-1]), low)
                if len(fixed) == step:
                    break
        changed = len(fixed) > before
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing; bins of one pattern are filled together."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, bins: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append((pattern, bins))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, pattern, bins = capacity, (), left
            each = room // length
            used = min(bins, left // each)
            if used:
                put(room - each * length, (*pattern, (length, each)), used)
                left -= used * each
            elif left:
                used = 1
                put(room - left * length, (*pattern, (length, left)), 1)
                left = 0
            if pattern and bins > used:
                put(room, pattern, bins - used)
    return [(pattern, bins) for group in open_bins.values() for pattern, bins in group]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: bins that any packing needs."""
    sizes = np.arange(len(counts))
    least = -(-int((counts * sizes).sum()) // capacity)
    for k in range(0, capacity // 2 + 1):
        large, middle = counts[capacity - k + 1 :].sum(), slice(capacity // 2 + 1, capacity - k + 1)
        spare = int(counts[middle].sum()) * capacity - int((counts * sizes)[middle].sum())
        small = int((counts * sizes)[k : capacity // 2 + 1].sum())
        least = max(least, int(large) + int(counts[middle].sum()) + max(0, -(-(small - spare) // capacity)))
    return least


def plan(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of (length, times in a bin) with the number of such bins: all items, in fixed sets and best-fit bins."""
    left = counts.astype(np.int64).copy()
    return [*dominance(left, capacity), *best_fit(left, capacity)]


def places(patterns: list[tuple[Pattern, int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first number) with the first sequence id, the offset and the first number of each range."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for pattern, bins in patterns:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                rows.append((length, int(used[length]), sequence, offset))
                used[length] += bins
                offset += length
        sequence += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return (table[:, 0] << 48) + table[:, 1], table[:, 2], table[:, 3], table[:, 1]


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (any columns, ``length`` among them) with ``sequence_id`` and ``offset``; sequences have no gaps from 0."""
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    keys, sequences, offsets, firsts = places(plan(counts, capacity), capacity)
    sent = spark.sparkContext.broadcast((keys, sequences, offsets, firsts))
    parts = max(1, int(counts.max()) // RANKED + 1) * 8
    names = cut.columns
    marked = cut.withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
    sizes = marked.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = sizes.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), F.coalesce("_first", F.lit(0)).alias("_first"))
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*names)) - 1)
    ranked = ranked.join(starts, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        keys, sequences, offsets, firsts = sent.value
        length, number = length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, (length << 48) + number, "right") - 1
        return pa.StructArray.from_arrays([pa.array(sequences[at] + number - firsts[at]), pa.array(offsets[at])], names=["sequence_id", "offset"])

    placed = ranked.withColumn("_place", place(F.col("length"), F.col("_first") + F.col("_rank")))
    return placed.select(*names, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row, repeated rows and null ids included."""
    return packed(shared_table(pieces(docs, vocabulary, capacity=capacity)), capacity)
