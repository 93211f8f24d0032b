"""Ranked lexical search by presence masks (operator 12).

Items are short queries; every document is ranked for every item. Terms are runs of ASCII letters and digits and of all
non-ASCII characters, A-Z lower-cased; null has none. N documents have a term, L is the number of all their terms.
A term in df documents weighs w = floor(1000 ln((2N+2)/(2df+1))); a document of n terms has m = 75 + (25 n N) div L, and
its score is the sum of w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included, in 64-bit integers.

1. *Postings.* One pass over the texts keeps, of each document, its length and the items' terms in it with their counts.
   The items' terms are broadcast as sorted hashes; they are counted first, and many items are searched in groups.
2. *Statistics* (N, L, df) are Spark aggregates over the postings, so they cover every document; one number per term returns.
3. *Masks.* A task takes its documents block by block. For an item, the block's presence bits of the item's terms are packed
   into one mask per document and documents are grouped by equal masks. A mask's score is at most what its terms give at
   the largest counts of the block for the shortest document of the group. Masks are evaluated from the highest of these
   downwards, all documents of a mask at once, until the next bound lies below the item's current last place: then no
   document left can enter. That place is carried from block to block, so later blocks evaluate few masks.
4. *Merge.* Each task returns the best of its documents for each item; they are merged in two steps, salted first.

Results are exact up to collisions of a term with another word in a 64-bit hash. Equal scores go by ascending id (null last),
equal ids by text hash. Repeated rows are ranked each for itself. Items that have equal text and id are one item; an item
without terms, or null, has no results, and neither has an empty table. Columns other than the named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabwright.llm.common import NON_ALNUM, find_words, list_array, partitions, release, shared_table, text_chunks

BEST = 20
#: About so many item terms (20 bytes each) and items are sent to the tasks at once; more are searched in groups.
TERMS, ITEMS = 1 << 17, 1 << 12
#: Cells (documents x terms) of a block, and masks evaluated between two looks at the last place.
CELLS, MASKS = 1 << 23, 256
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _term_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk of texts: their number, and text number and hash of each term."""
    for row, last, data, offsets in text_chunks(column):
        _, _, text, words = find_words(data, offsets, NON_ALNUM)
        yield last - row, text, words


def item_terms(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item, item_id, term, q): a distinct item's number by its content, its terms' hashes and their repeats."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for n, text, words in _term_hashes(batch.column(2)):
                yield pa.record_batch({"item": batch.column(0).take(pa.array(row + text)), "item_id": batch.column(1).take(pa.array(row + text)), "term": pa.array(words.view(np.int64))})
                row += n

    rows = items.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text")).where("text is not null").distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(hashed, f"item long, item_id {kind}, term long").groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("q"))


def postings(docs: DataFrame, terms: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, n, terms, counts) of each document with a term: which of the sorted hashes it holds, how often each."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        for batch in batches:
            row = 0
            for n_texts, text, words in _term_hashes(batch.column(2)):
                n = np.bincount(text, minlength=n_texts)
                at = np.minimum(np.searchsorted(wanted, words), max(len(wanted) - 1, 0))
                hit = wanted[at] == words if len(wanted) else np.zeros(len(words), bool)
                pair, count = np.unique(text[hit] * len(wanted) + at[hit], return_counts=True)
                owner, which = np.divmod(pair, max(len(wanted), 1))
                size = np.bincount(owner, minlength=n_texts)
                full = np.flatnonzero(n)
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(row, n_texts).take(pa.array(full)), "key": batch.column(1).slice(row, n_texts).take(pa.array(full)), "n": pa.array(n[full]),
                    "terms": list_array(which.astype(np.int32), size[full], pa.int32()), "counts": list_array(count.astype(np.int32), size[full], pa.int32()),
                })
                row += n_texts

    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("key"), F.col(text_column).alias("text")).where("text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {kind}, key long, n long, terms array<int>, counts array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def mask_groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (rows) grouped by their mask of presence bits: order by group, start of each group, first row of each."""
    bits = np.packbits(present, axis=1)
    masks = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)
    order = np.lexsort(masks.T)
    ranked = masks[order]
    starts = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])) if len(order) else np.zeros(0, np.int64)
    return order, starts, order[starts]


def evaluate(tf: np.ndarray, m: np.ndarray, worth: np.ndarray, floor: int, best: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows that can be among the best of an item, with their scores, and the number of rows evaluated.

    ``tf`` has the counts of the item's terms (columns) in each document of the block, ``worth`` weight times repeats. Masks
    are taken by descending bound until the bound is below the last place; equal bounds are taken too, as ids break ties.
    """
    order, starts, first = mask_groups(tf > 0)
    if not len(order):
        return order, order, 0
    shortest = np.minimum.reduceat(m[order], starts)
    highest = np.broadcast_to(tf.max(axis=0), (len(first), tf.shape[1]))
    bound = (np.where(tf[first] > 0, part(highest, shortest[:, None]), 0) * worth).sum(axis=1)
    turn = np.argsort(-bound, kind="stable")
    ends = np.append(starts[1:], len(order))
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = 0
    for at in range(0, len(turn), MASKS):
        group = turn[at : at + MASKS]
        group = group[(bound[group] >= floor) & (bound[group] > 0)]
        if not len(group):
            break
        size = ends[group] - starts[group]
        new = order[np.repeat(starts[group] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        seen += len(new)
        score = (part(tf[new], m[new, None]) * worth).sum(axis=1)
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, score])
        if len(scores) >= best:
            floor = max(floor, int(np.partition(scores, len(scores) - best)[len(scores) - best]))
            keep = scores >= floor
            rows, scores = rows[keep], scores[keep]
    keep = (scores >= floor) & (scores > 0)
    return rows[keep], scores[keep], seen


def _dense(batch: pa.RecordBatch, n_terms: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of documents as matrices of counts, CELLS cells at most (or one document)."""
    step = max(1, CELLS // max(n_terms, 1))
    for first in range(0, batch.num_rows, step):
        block = batch.slice(first, step)
        terms, counts = block.column(3), block.column(4)
        size = terms.value_lengths().to_numpy(zero_copy_only=False)
        tf = np.zeros((block.num_rows, n_terms), np.int32)
        tf[np.repeat(np.arange(block.num_rows), size), terms.flatten().to_numpy()] = counts.flatten().to_numpy()
        yield first, block.num_rows, tf


def _ranked(rows: DataFrame, best: int) -> DataFrame:
    """The best rows of each item in two steps: inside salted parts, then over what they leave."""
    place = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key").asc(), F.col("copy").asc()]
    inside = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "copy"), F.lit(max(1, partitions(rows.sparkSession)))))
    inside = inside.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*place))).where(F.col("rank") <= best)
    return inside.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*place))).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    queries = shared_table(item_terms(items, item_column, item_text))
    item_type = queries.schema["item_id"].dataType.simpleString()
    doc_type = docs.schema[id_column].dataType.simpleString()
    out = spark.createDataFrame([], f"item long, rank int, doc_id {doc_type}, score long")
    groups = max(-(-queries.select("item").distinct().count() // ITEMS), -(-queries.count() // TERMS))
    for group in range(groups):
        mine = queries.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group)
        out = out.unionByName(_search(docs, mine, best, id_column, text_column, doc_type))
    names = queries.select("item", "item_id").distinct()
    return out.join(F.broadcast(names) if groups <= 1 else names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search(docs: DataFrame, queries: DataFrame, best: int, id_column: str, text_column: str, doc_type: str) -> DataFrame:
    """(item, rank, doc_id, score) for items few enough to be sent to every task."""
    spark = docs.sparkSession
    asked = queries.select("item", "term", "q").orderBy("item", "term").toPandas()  # about TERMS rows
    hashes = np.unique(asked["term"].to_numpy(np.int64).view(np.uint64))
    held = shared_table(postings(docs, hashes, id_column, text_column))
    totals = held.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    df = np.zeros(len(hashes), np.int64)
    for term, count in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # TERMS rows at most
        df[term] = count
    id_type = to_arrow_type(held.schema["doc_id"].dataType)
    n_docs, length = totals["N"], totals["L"] or 1
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    plan = []
    for item, rows in asked.groupby("item", sort=False):
        at = np.searchsorted(hashes, rows["term"].to_numpy(np.int64).view(np.uint64))
        plan.append((int(item), at, weights[at] * rows["q"].to_numpy(np.int64)))
    sent = spark.sparkContext.broadcast((plan, len(hashes)))
    longest = (2**63 - 1) // (25 * max(n_docs, 1))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, n_terms = sent.value
        top: dict[int, tuple[list, np.ndarray, np.ndarray, np.ndarray]] = {}
        serial = 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            m = np.array([75 + (25 * int(x) * n_docs) // length for x in n], np.int64) if len(n) and n.max() > longest else 75 + (25 * n * n_docs) // length
            key = batch.column(1).to_numpy()
            for first, size, tf in _dense(batch, n_terms):
                ids = batch.column(0).slice(first, size)
                for item, at, worth in plan:
                    held = top.get(item)
                    full = held is not None and len(held[1]) >= best
                    rows, scores, _ = evaluate(tf[:, at].astype(np.int64), m[first : first + size], worth, int(held[1][-1]) if full else 1, best)
                    if not len(rows):
                        continue
                    names = ids.take(pa.array(rows)).to_pylist()
                    keys, copies = key[first + rows], serial + rows
                    if held is not None:
                        names, scores = [*held[0], *names], np.concatenate([held[1], scores])
                        keys, copies = np.concatenate([held[2], keys]), np.concatenate([held[3], copies])
                    order = sorted(range(len(names)), key=lambda i: (-scores[i], names[i] is None, names[i] if names[i] is not None else 0, keys[i], copies[i]))[:best]
                    top[item] = ([names[i] for i in order], scores[order], keys[order], copies[order])
                serial += size
        for item, (names, scores, keys, copies) in top.items():
            yield pa.record_batch({"item": pa.array([item] * len(names), pa.int64()), "doc_id": pa.array(names, id_type), "score": pa.array(scores), "key": pa.array(keys), "copy": pa.array(copies)})

    result = shared_table(_ranked(held.mapInArrow(rank, f"item long, doc_id {doc_type}, score long, key long, copy long"), best).select("item", "rank", "doc_id", "score"))
    release(spark)
    return result
