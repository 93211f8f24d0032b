"""Benchmark decontamination with DataFrame functions only (operator 10).

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is ten consecutive words of a
benchmark item (all of a shorter item that has any). Every occurrence of a window of ten covers four words from a place that is a multiple of seven,
so a training text is looked up at every seventh word only: its four words are hashed to 64 bits and joined with the hashes of
the four words at each of the first seven places of each window (broadcast when their number is counted and small, else shuffled).
Where they meet, the whole window is hashed and then compared word by word, so a collision of hashes can't remove anything.

Texts are joined on 128 bits of their content and never on an id: repeated rows, equal texts and null ids need no rule of
their own. Null and empty texts have no words and are never hit. Word order, spans and item lists are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import boxed, shared_table

WINDOW = 10
#: Words that are looked up together.
GRAM = 4
#: Hashed rows that may be broadcast: about 40 bytes each, 20 MB.
BROADCAST_ROWS = 1 << 19
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words as they are written; empty array for null."""
    return F.coalesce(F.filter(F.split(text, BREAKS), lambda w: w != ""), F.array().cast("array<string>"))


def folded(words: Column) -> Column:
    """Words with A-Z in lower case and all other characters as they are."""
    return F.transform(words, lambda w: F.translate(w, UPPER, SMALL))


def text_key(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text's content."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, length, window): distinct windows of each item; ``window`` holds its words joined by spaces."""
    items = benchmark.select(F.col(id_column).alias("item_id"), folded(words_of(F.col(text_column))).alias("words")).where("size(words) > 0 and item_id is not null")
    length = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    cut = items.select("item_id", length.alias("length"), "words", F.explode(starts).alias("at"))
    return cut.select("item_id", "length", F.array_join(F.expr("slice(words, at, length)"), " ").alias("window")).distinct()


def _lookup(words: str, at: str, gram: int) -> Column:
    """Hash of ``gram`` words from place ``at`` (from 1), in lower case."""
    return F.expr(f"xxhash64(lower(array_join(slice({words}, {at}, {gram}), ' ')))")


def find_hits(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k1, k2, at, length, window): verified occurrences, ``at`` counted in words from 0, once for equal texts."""
    windows = shared_table(benchmark_windows(benchmark, item_column, item_text))
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # ten values at most
    k1, k2 = text_key(F.col("text"))
    texts = docs.select(F.col(text_column).alias("text")).where("text is not null").select(k1.alias("k1"), k2.alias("k2"), words_of(F.col("text")).alias("words"))
    found = None
    for length in sorted(lengths):
        gram = min(GRAM, length)
        stride = length - gram + 1
        own = windows.where(F.col("length") == length).select("window").distinct().select(F.split("window", " ").alias("w"), F.xxhash64("window").alias("whole"))
        known = own.select("w", "whole", F.explode(F.sequence(F.lit(0), F.lit(stride - 1))).alias("shift")).select(_lookup("w", "shift + 1", gram).alias("hash"), "shift", "whole").distinct()
        if known.count() <= BROADCAST_ROWS:
            known = F.broadcast(known)
        places = F.expr(f"transform(sequence(1, size(words) - {gram - 1}, {stride}), i -> xxhash64(lower(array_join(slice(words, i, {gram}), ' '))))")
        rows = texts.where(F.size("words") >= length).select("k1", "k2", "words", F.posexplode(places).alias("step", "hash"))
        met = rows.join(known, "hash").withColumn("at", F.col("step") * stride - F.col("shift")).where(f"at >= 0 and at + {length} <= size(words)")
        met = met.withColumn("window", F.array_join(folded(F.expr(f"slice(words, at + 1, {length})")), " ")).where(F.xxhash64("window") == F.col("whole"))
        met = met.select("k1", "k2", "at", F.lit(length).alias("length"), "window").distinct()
        found = met if found is None else found.union(met)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "k1 long, k2 long, at int, length int, window string")
    return shared_table(found.join(windows.select("length", "window").distinct(), ["length", "window"], "left_semi").select("k1", "k2", "at", "length", "window"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: (doc_id, n_words, n_hit, items, spans).

    ``items`` are the ids of items with an occurring window, as sorted strings; ``spans`` the maximal runs of hit words
    as (first, end), counted in words from 0.
    """
    hits = find_hits(docs, benchmark, text_column, item_column, item_text)
    windows = benchmark_windows(benchmark, item_column, item_text)
    items = hits.select("k1", "k2", "window", "length").distinct().join(windows.select("window", "length", "item_id"), ["window", "length"])
    items = items.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    spans = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("length")).alias("end")))).alias("cuts"))
    start = F.array().cast("array<struct<first:int,end:int>>")

    def joined(done: Column, cut: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        grown = F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], cut["end"]).alias("end")))
        return F.when(last["end"] >= cut["first"], F.concat(F.slice(done, 1, F.size(done) - 1), grown)).otherwise(F.concat(done, F.array(cut)))

    found = items.join(spans.select("k1", "k2", F.aggregate("cuts", start, joined).alias("spans")), ["k1", "k2"])
    found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"]))
    k1, k2 = text_key(F.col("text"))
    every = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).select("doc_id", k1.alias("k1"), k2.alias("k2"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.col("text").isNotNull().alias("real"))
    every = every.withColumn("k1", F.when(F.col("real"), F.col("k1"))).drop("real")
    none = F.array().cast("array<string>")
    return every.join(found, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", start).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with their columns as they are, whatever they are called."""
    bad = find_hits(docs, benchmark).select("k1", "k2").distinct()
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    rows = boxed(docs)
    rows = rows.withColumn("k1", F.when(F.col("row.text").isNotNull(), F.col("k1")))
    return rows.join(bad, ["k1", "k2"], "left_anti").select("row.*")
