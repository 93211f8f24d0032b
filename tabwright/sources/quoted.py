"""CSV records from splits of a file, also where quoted values hold line feeds.

Spark's reader splits a file at any line feed (``multiLine`` off) or not at all (on: one task per file, whatever its
size). Here the file is read as text in splits, and what a split cannot know, whether it begins inside a quoted value, is
found first: each split reports where it would end if it began outside and if it began inside a quoted value, and these
two answers are combined from the first split of each file to the last. With the beginnings known, every task joins the lines of its
records; a record that a split border cuts is put together from its parts.

A quote opens a value only at the start of a field; quotes elsewhere are text. Doubled quotes stand for one. Lines end at a
line feed, with or without a carriage return before it. Compressed files are one split each, as ever.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.session import shared_path

CLOSING = re.compile(rb'[^"]*(?:""[^"]*)*"(?!")')
RECORD, HEAD, TAIL = 0, 1, 2
NAMES = ["file", "start", "part", "first", "text"]
KINDS = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line, begun inside a quoted value or outside any, ends inside one."""
    at = 0
    if not inside:
        at = 0 if line.startswith(b'"') else line.find(b',"') + 1
        if not line.startswith(b'"', at):
            return False
        at += 1
    while True:
        close = CLOSING.match(line, at)
        if close is None:
            return True
        comma = line.find(b",", close.end())
        if comma < 0:
            return False
        at = comma + 1 if line.startswith(b'"', comma + 1) else line.find(b',"', comma + 1) + 1
        if not at:
            return False
        at += 1


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, start): lines as bytes, in file order within each split; ``start`` is the split's first byte."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Lines of a batch by split."""
    files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    lines = batch.column(0).to_pylist()
    first = 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or files[k] != files[first] or starts[k] != starts[first]:
            yield (files[first], starts[first]), lines[first:k]
            first = k


def split_ends(lines: DataFrame) -> DataFrame:
    """(file, start, outside, inside, open): for each split, whether it ends inside a quoted value if it begins outside or
    inside one, and whether any of its lines does so if it begins outside."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for split, run in _runs(batch):
                state = found.setdefault(split, [False, True, False])
                for line in run:
                    if b'"' in line:
                        one = ends_inside(line, state[0])
                        state[1] = one if state[0] == state[1] else ends_inside(line, state[1])
                        state[0] = one
                        state[2] |= one
        if found:
            yield pa.RecordBatch.from_pylist([{"file": f, "start": s, "outside": a, "inside": b, "open": c} for (f, s), (a, b, c) in found.items()])

    return lines.mapInArrow(scan, "file string, start long, outside boolean, inside boolean, open boolean")


def begun_inside(ends: list) -> set[tuple[str, int]]:
    """The splits that begin inside a quoted value, from the rows of ``split_ends``: one for each split, as many as the scan has tasks' inputs."""
    out, file, inside = set(), None, False
    for row in sorted(ends, key=lambda r: (r["file"], r["start"])):
        if row["file"] != file:
            file, inside = row["file"], False
        if inside:
            out.add((file, row["start"]))
        inside = row["inside"] if inside else row["outside"]
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def record_parts(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """(file, start, part, first, text): whole records, and of records cut by a border the ends that a split has.

    HEAD closes, or goes on with, the record that earlier splits began; TAIL is what a split's last record has here.
    ``first`` marks the file's first record.
    """
    known = lines.sparkSession.sparkContext.broadcast(inside)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, state, head, first = None, [], False, False, False
        out: list[tuple] = []

        def emit(part: int) -> None:
            text = b"\n".join(held)
            if part != RECORD or text.strip():
                out.append((split[0], split[1], part, first, text))

        for batch in batches:
            for key, run in _runs(batch):
                if key != split:
                    if held:
                        emit(HEAD if head else TAIL)
                    split, held, state, first = key, [], key in known.value, key[1] == 0
                    head = state
                for line in run:
                    held.append(line)
                    state = ends_inside(line, state) if b'"' in line else state
                    if not state:
                        emit(HEAD if head else RECORD)
                        first = first and not b"".join(held).strip()
                        held, head = [], False
            if out:
                yield _batch(out)
                out = []
        if held:
            emit(HEAD if head else TAIL)
        if out:
            yield _batch(out)

    return lines.mapInArrow(join, "file string, start long, part int, first boolean, text binary")


def _stitched(parts: DataFrame) -> DataFrame:
    """(first, text) of the records that borders cut: a tail and the heads up to the next tail of the file."""
    w = Window.partitionBy("file").orderBy("start", "part")  # two rows at most for each split
    cut = parts.where(F.col("part") != RECORD).withColumn("n", F.sum((F.col("part") == TAIL).cast("int")).over(w))
    whole = F.array_sort(F.collect_list(F.struct("start", "part", F.col("text").cast("string").alias("text"))))
    return cut.groupBy("file", "n").agg(F.max("first").alias("first"), F.array_join(F.transform(whole, lambda x: x["text"]), "\n").alias("text"))


def quoted_records(spark: SparkSession, path: str) -> DataFrame | None:
    """(first, text): every record of the files, in no order, or None if no record spans lines, so that any reader may split them."""
    lines = text_lines(spark, path)
    if not lines.where(F.contains("line", F.lit(b'"'))).limit(1).count():
        return None
    ends = split_ends(lines).collect()
    if not any(row["open"] for row in ends):
        return None
    place = shared_path(spark, "records")
    record_parts(lines, begun_inside(ends)).write.option("compression", "zstd").parquet(place)
    parts = spark.read.parquet(place)
    return parts.where(F.col("part") == RECORD).select("first", F.col("text").cast("string").alias("text")).unionByName(_stitched(parts).select("first", "text"))


def parsed(records: DataFrame, names: list[str], options: dict) -> DataFrame:
    """The records but for the headers, as text columns; too few values leave nulls, more than there are names are left out."""
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    spelled = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"} | {"multiLine": "true"}
    rows = records.where(~F.col("first")).select(F.from_csv(F.regexp_replace("text", "\r$", ""), schema, spelled).alias("r"))
    return rows.select("r.*").toDF(*names)
