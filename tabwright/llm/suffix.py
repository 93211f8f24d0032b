"""Exact removal of repeated byte strings by bucket-pointer refinement (operator 4).

A byte goes if a string of 200 bytes that covers it starts anywhere else too, in any text. Texts are UTF-8 bytes (null: empty),
and every string is judged on the input.

Sorting every position of every text would move many times the input. Buckets hold *anchors* instead: of a string's 32-byte grams
the one with the smallest hash (the leftmost, if equal) depends on the string alone, so equal strings have equal anchors at equal offsets. An
anchor stands for the run of strings whose anchor it is; there is one per 85 bytes, about.

1. *Initial buckets*: anchors with one gram (q = 32). A bucket of one anchor is settled: its strings are unique.
2. *Refinement on the whole neighbourhood*: anchors that agree in every byte that their strings touch are one class. A class of two or
   more is settled (all its strings repeat), and one member stands for it where its bucket has other classes.
3. *Refinement on later offsets*: what is left is cut into cells of eight neighbouring offsets. A cell's bucket is (gram, cell,
   identifier of the 193 bytes that all its strings share); within it, classes by all bytes as before.
4. *Refinement to single strings*: cells that still share a bucket with another class are cut into their strings.

All identifiers are differences of one running polynomial sum, so each offset reuses the sums of those before it; gram and
string hashes together have 128 bits. Each class sends one member to the next round: a passage in a third of all texts costs
as many rows as it has surroundings, not pairs. Equal texts are one text with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Bits, bitmap, mix, prefix_hash, release, shared_table, substring_hash, text_chunks

LENGTH = 200
GRAM = 32
CELL = 8
FILTER_BITS = 27
_PLACE = np.uint64((1 << 30) - 1)
UNITS = "bucket long, class long, mark long, k1 long, k2 long, first int, last int"


class Anchors:
    """Anchors of a chunk of texts: gram hash, place, first and last string that they stand for, and the running sums."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.gram = np.zeros(0, np.uint64)
        self.place = self.first = self.last = self.text = np.zeros(0, np.int64)
        inside = np.zeros(n + 1, np.int8)
        long = np.flatnonzero(np.diff(offsets) >= LENGTH)
        if not len(long):
            return
        inside[offsets[long]] = 1
        np.add.at(inside, offsets[long + 1] - LENGTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside[:-1]))
        self.sums = prefix_hash(data)
        grams = substring_hash(self.sums, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        span, width = LENGTH - GRAM + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        anchor = (np.minimum(low[starts], low[starts + span - width]) & _PLACE).astype(np.int64)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]
        head = np.flatnonzero(new)
        self.place, self.first, self.last = anchor[head], starts[head], starts[np.r_[head[1:], len(starts)] - 1]
        self.gram = grams[self.place]
        self.text = np.searchsorted(offsets, self.place, "right") - 1

    def identifier(self, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of all bytes of the strings from ``first`` to ``last``, and of how these lie about the anchor."""
        return mix(substring_hash(self.sums, first, last + LENGTH) + mix(((place - first) * LENGTH + place - last).astype(np.uint64)))


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the range and value, for every whole number of every range."""
    counts = high - low + 1
    which = np.repeat(np.arange(len(low)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]


def _marks(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix(place.astype(np.uint64)))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0)):
            yield pa.record_batch({"gram": pa.array(Anchors(data, offsets).gram.view(np.int64))})


def _units(keyed: DataFrame, filters: list[Bits]) -> DataFrame:
    """Units of the level that the number of filters names: whole neighbourhoods, cells of offsets, single strings."""
    sent = [keyed.sparkSession.sparkContext.broadcast(x) for x in filters]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for row, _, data, offsets in text_chunks(batch.column(0)):
                a = Anchors(data, offsets)
                live = np.flatnonzero(sent[0].value.hit(a.gram))
                gram, place, first, last, text = a.gram[live], a.place[live], a.first[live], a.last[live], a.text[live]
                if not len(live):
                    continue
                bucket, mark = gram, _marks(keys[text + row], place - offsets[text])
                if len(sent) > 1:
                    keep = sent[1].value.hit(mark)
                    gram, place, first, last, text = gram[keep], place[keep], first[keep], last[keep], text[keep]
                    which, cell = _expanded((place - last) // CELL, (place - first) // CELL)
                    gram, place, text = gram[which], place[which], text[which]
                    first, last = np.maximum(first[which], place - CELL * cell - CELL + 1), np.minimum(last[which], place - CELL * cell)
                    core = substring_hash(a.sums, place - CELL * cell, place - CELL * cell - CELL + 1 + LENGTH) if len(place) else gram
                    bucket = mix(gram + core * np.uint64(3) + mix(cell.astype(np.uint64)))
                    mark = _marks(keys[text + row], (place - offsets[text]) * LENGTH + cell)
                if len(sent) > 2:
                    keep = sent[2].value.hit(mark)
                    which, start = _expanded(first[keep], last[keep])
                    bucket, place, text, mark = bucket[keep][which], place[keep][which], text[keep][which], mark[keep][which]
                    first = last = start
                same = a.identifier(first, last, place) if len(place) else np.zeros(0, np.uint64)
                rows, base = pa.array(text + row), offsets[text]
                yield pa.record_batch([
                    pa.array(bucket.view(np.int64)), pa.array(same.view(np.int64)), pa.array(mark.view(np.int64)), batch.column(1).take(rows), batch.column(2).take(rows),
                    pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)),
                ], names=["bucket", "class", "mark", "k1", "k2", "first", "last"])

    return shared_table(keyed.mapInArrow(emit, UNITS))


def _refined(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled units that repeat, marks of the classes' members that go on); equal texts have equal marks and count once."""
    classes = units.groupBy("bucket", "class").agg(F.min("mark").alias("mark"), F.max("mark").alias("other"))
    repeat = units.join(classes.where("mark <> other").select("bucket", "class"), ["bucket", "class"], "left_semi")
    mixed = classes.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("bucket")
    return repeat.select("k1", "k2", "first", "last"), classes.join(mixed, "bucket", "left_semi").select(F.col("mark").alias("key"))


def repeated_spans(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(k1, k2, cuts array<struct<first,end>>): byte spans that go, by text (two 64-bit hashes); spans may touch and overlap."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_column).alias("text")).where(F.octet_length(text_column) >= LENGTH)
    keyed = texts.select("text", *_keys("text"))
    grams = texts.mapInArrow(_grams, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    filters = [bitmap(grams.select(F.col("gram").alias("key")), FILTER_BITS)]
    release(spark)
    cuts = None
    for level in range(3):
        repeat, on = _refined(_units(keyed, filters))
        repeat = shared_table(repeat.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", (F.col("last") + LENGTH).alias("end"))).alias("part")))
        cuts = repeat if cuts is None else cuts.union(repeat)
        if level < 2:
            filters.append(bitmap(on, FILTER_BITS))
        release(spark)
    cuts = cuts.groupBy("k1", "k2").agg(F.flatten(F.collect_list("part")).alias("cuts"))
    copies = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.max(F.octet_length("text")).alias("n")).where("rows > 1")
    whole = copies.select("k1", "k2", F.array(F.struct(F.lit(0).alias("first"), F.col("n").alias("end"))).alias("whole"))
    spans = shared_table(cuts.join(whole, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("whole", "cuts").alias("cuts")))
    release(spark)
    return spans


def _keys(text: str) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), F.col(text)).alias("k2")


def kept_runs(n: int, cuts: list[dict]) -> tuple[np.ndarray, int]:
    """Which of ``n`` bytes stay, and the number of maximal runs that go."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, [c["first"] for c in cuts], 1)
    np.add.at(depth, [c["end"] for c in cuts], -1)
    gone = np.cumsum(depth[:n]) > 0
    return ~gone, int((gone & ~np.r_[False, gone[:-1]]).sum()) if n else 0


CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    rows = []
    for text, spans in zip(texts, cuts, strict=True):
        data = (text.as_py() or "").encode()
        kept, runs = data, 0
        if spans.is_valid:
            keep, runs = kept_runs(len(data), spans.as_py())
            kept = np.frombuffer(data, np.uint8)[keep].tobytes()
        rows.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` may end inside a character, hence binary."""
    spans = repeated_spans(docs, text_column)
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = named.select("*", *_keys("text")).join(spans, ["k1", "k2"], "left")
    return found.select("doc_id", F.arrow_udf(_cut, CUT)("text", "cuts").alias("c")).select("doc_id", "c.*")
