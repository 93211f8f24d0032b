"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters (operator 5).

A text's set holds its distinct five-word shingles (A-Z lower-cased, words split at ASCII white space; a text of fewer
words is one shingle; null, empty and word-free texts have the empty set and link with nothing). Two sets link when
their Jaccard similarity is at least 3/4. Equal sets form a class and are joined once.

1. *Order.* Every shingle of every text is counted in a table of 2^20 cells; shingles are ordered by (cell count, hash).
2. *Prefix.* A set of n shingles has at most n - ceil(3n/4) that a partner lacks. Of its n - ceil(3n/4) + n/16 rarest it
   therefore shares at least n/16 (at least one) with the partner. Prefix shingles of two classes or more are found by a group-by
   and marked in a bitmap. Classes with too few of them leave.
3. *Pairs.* In each prefix shingle's bucket some members are hubs, those with most shared
   prefix shingles first; hub and member become a pair once if they are not
   yet known to be connected and pass the length filter, the positional filter (the shingle can be the first that they
   share; only from the second round on, as early links spare later pairs) and the prefix-count filter. Hubs then leave the bucket and the
   next round takes eight times as many, until no bucket holds two unconnected classes: no link is lost, and a bucket of near
   copies costs as many pairs as it has members, not their square.
4. *Verification.* Each new pair that passes the suffix filter has its sets intersected exactly, once.

The result does not name every link: it has one row per document with its component, and ``links`` has those pairs
of classes whose links span the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import (
    FEW_PAIRS,
    SPACES,
    bitmap,
    boxed,
    checkpointed,
    components,
    dense_blocks,
    distinct,
    find_words,
    list_array,
    mix,
    release,
    shared_table,
    shingles,
    sorted_within,
    summed_blocks,
    text_chunks,
    with_both,
)

WIDTH = 5
CELL_BITS = 20
FILTER_BITS = 26
HISTOGRAM = 32


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of texts: distinct shingles, their text number, and each text's set size."""
    for row, last, data, offsets in text_chunks(column):
        _, _, text, words = find_words(data, offsets, SPACES)
        value, owner, _ = shingles(words, text, last - row, width)
        value, owner = distinct(value, owner)
        yield value, owner, np.bincount(owner, minlength=last - row)


def class_keys(value: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits per set, as two columns: sums of scrambled members."""
    out = np.zeros((len(sizes), 2), np.uint64)
    starts = np.cumsum(sizes) - sizes
    full = sizes > 0
    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        if len(value):
            out[full, k] = np.add.reduceat(mix(value ^ np.uint64(salt)), starts[full])
    return mix(out + sizes[:, None].astype(np.uint64))


def spare(n):
    """Shingles of a set of ``n`` that a partner may lack, and shared ones that the prefix has beyond."""
    return n - (3 * n + 3) // 4, (n + 15) // 16


def prefix_of(value: np.ndarray, owner: np.ndarray, sizes: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rare-first prefixes: token, text number. A token is 12 bits of rank by cell count (equal for like counts) and 52 of the hash."""
    rank = cells[(value >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
    token = sorted_within((rank << np.uint64(52)) | (value & np.uint64((1 << 52) - 1)), owner)
    position = np.arange(len(value)) - (np.cumsum(sizes) - sizes)[owner]
    lacked, shared = spare(sizes)
    keep = position < np.minimum(lacked + shared, sizes)[owner]
    return token[keep], owner[keep]


def shingle_cells(texts: DataFrame) -> np.ndarray:
    """Counts of all shingles of all texts, in 2^20 cells by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for value, _, _ in shingle_sets(batch.column(0)):
                np.add.at(cells, (value >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        yield dense_blocks(cells)

    return summed_blocks(texts.select("text").mapInArrow(count, "block int, data binary"), "int64", "sum", 1 << CELL_BITS)


def ngram_jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, k1, k2, n_shingles, class_key, class, component_key), links (a, b, overlap, union) between classes.

    ``k1`` and ``k2`` hash the row's text. ``class_key`` has 128 bits and says which sets are equal; ``class``, its first half, names sets where links are sought.

    Repeated rows, equal texts and null ids are kept row by row; ``component_key`` is null for the empty set.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    texts = texts.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"))
    cells = spark.sparkContext.broadcast(np.minimum(32 * np.log2(shingle_cells(texts) + 1.0), 4095).astype(np.uint16))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for value, owner, sizes in shingle_sets(batch.column(1)):
                keys = class_keys(value, owner, sizes)
                token, text = prefix_of(value, owner, sizes, cells.value)
                yield pa.record_batch({
                    **{name: batch.column(k).slice(row, len(sizes)) for name, k in (("doc_id", 0), ("k1", 2), ("k2", 3))}, "n": pa.array(sizes.astype(np.int64)), "class_key": pa.array([x.tobytes() for x in keys.astype(">u8")], pa.binary()),
                    "class": pa.array(keys[:, 0].view(np.int64)), "tokens": list_array(token.view(np.int64), np.bincount(text, minlength=len(sizes)), pa.int64()),
                })
                row += len(sizes)

    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = shared_table(texts.mapInArrow(prefixes, f"doc_id {id_type}, k1 long, k2 long, n long, class_key binary, class long, tokens array<long>"))
    tokens = rows.select(F.explode("tokens").alias("token"), "class")
    shared = tokens.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    shared_bits = spark.sparkContext.broadcast(bitmap(shared.select(F.col("token").alias("key")), FILTER_BITS))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens that two classes may have, with their positions, of sets that have enough of them."""
        for batch in batches:
            lists = batch.column(2)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(counts)), counts)
            hit = shared_bits.value.hit(flat.view(np.uint64))
            enough = np.bincount(owner[hit], minlength=len(counts)) >= spare(batch.column(1).to_numpy())[1]
            hit &= enough[owner]
            at = np.arange(len(flat)) - (np.cumsum(counts) - counts)[owner]
            yield pa.record_batch({
                "class": batch.column(0).take(pa.array(owner[hit])), "n": batch.column(1).take(pa.array(owner[hit])).cast(pa.int32()),
                "token": pa.array(flat[hit]), "at": pa.array(at[hit].astype(np.int32)),
            })

    bucket_rows = rows.where("n > 0").select("class", "n", "tokens").mapInArrow(marked, "class long, n int, token long, at int")
    bucket_rows = shared_table(_shared_tokens(bucket_rows.distinct()))
    sets = _sets(texts, bucket_rows)
    release(spark)
    links, roots = _link(bucket_rows, sets)
    members = rows.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_key")).alias("class_key"), "class")
    members = members.join(roots.select(F.col("node").alias("class"), F.col("root").cast("string").alias("root")), "class", "left")
    return members.select("doc_id", "k1", "k2", "n_shingles", "class_key", "class", F.coalesce("root", F.hex("class_key")).alias("component_key")), links


def _shared_tokens(bucket_rows: DataFrame) -> DataFrame:
    live = bucket_rows.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("token")
    return bucket_rows.join(live, "token", "left_semi")


def _sets(texts: DataFrame, bucket_rows: DataFrame) -> DataFrame:
    """(class, n, members, histogram) of the classes that share a prefix shingle with another."""
    spark = texts.sparkSession
    wanted = bucket_rows.select("class").distinct()
    bits = spark.sparkContext.broadcast(bitmap(wanted.select(F.col("class").alias("key")), FILTER_BITS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, owner, sizes in shingle_sets(batch.column(0)):
                keys = class_keys(value, owner, sizes)
                hit = bits.value.hit(keys[:, 0]) & (sizes > 0)
                inside = hit[owner]
                table = np.zeros((len(sizes), HISTOGRAM), np.int32)
                np.add.at(table, (owner, (value >> np.uint64(59)).astype(np.int64)), 1)
                yield pa.record_batch({
                    "class": pa.array(keys[hit, 0].view(np.int64)), "n": pa.array(sizes[hit].astype(np.int64)),
                    "members": list_array(value[inside].view(np.int64), sizes[hit], pa.int64()),
                    "histogram": list_array(table[hit].ravel(), np.full(int(hit.sum()), HISTOGRAM), pa.int32()),
                })

    found = texts.select("text").mapInArrow(emit, "class long, n long, members array<long>, histogram array<int>")
    return shared_table(found.join(wanted, "class", "left_semi").dropDuplicates(["class"]))


def _link(bucket_rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rounds of hubs until no bucket holds two classes with different best hubs; (links, roots of classes)."""
    spark = bucket_rows.sparkSession
    links = spark.createDataFrame([], "a long, b long, overlap long, union long, a_order int, b_order int")
    roots, send = spark.createDataFrame([], "node long, root long"), F.broadcast
    prefixes = shared_table(bucket_rows.groupBy("class").agg(F.collect_list("token").alias("tokens"), F.first("n").alias("n")))
    waiting = _shared_tokens(bucket_rows.where("at <= n - floor((3 * n + 3) / 4)")).withColumn("root", F.col("class"))
    waiting = shared_table(waiting.join(prefixes.select("class", (-F.size("tokens")).alias("order")), "class"))
    hubs_per_bucket = 1
    while True:
        salt = F.pmod(F.xxhash64("class"), F.lit(hubs_per_bucket))
        hubs = waiting.groupBy("token", salt.alias("salt")).agg(F.min(F.struct("order", "n", "class", "at", "root")).alias("hub"))
        hubs = checkpointed(hubs.select("token", F.col("hub.n").alias("hub_n"), F.col("hub.class").alias("hub_class"), F.col("hub.at").alias("hub_at"), F.col("hub.root").alias("hub_root")))
        most = F.col("n") + F.col("hub_n") - F.ceil(3 * (F.col("n") + F.col("hub_n")) / 7)  # shingles of both sets together at most
        met = waiting.join(hubs, "token").where("root <> hub_root")
        met = met.where(4 * F.least("n", "hub_n") >= 3 * F.greatest("n", "hub_n"))
        if hubs_per_bucket > 1:
            met = met.where((F.col("at") <= most - F.col("hub_n")) & (F.col("hub_at") <= most - F.col("n")))
        pairs = met.select(F.least("class", "hub_class").alias("a"), F.greatest("class", "hub_class").alias("b")).distinct()
        pairs = shared_table(_plausible(pairs, prefixes))
        if pairs.limit(1).count():
            new = shared_table(_verified(pairs, sets))
            if new.limit(1).count():
                links = shared_table(links.unionByName(new))
                roots = _nearest_hub(links)
                send = F.broadcast if links.count() <= FEW_PAIRS else lambda df: df
        waiting = waiting.drop("root").join(hubs.select("token", F.col("hub_class").alias("class")), ["token", "class"], "left_anti")
        waiting = waiting.join(send(roots.select(F.col("node").alias("class"), "root")), "class", "left").withColumn("root", F.coalesce("root", "class"))
        live = waiting.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
        waiting = checkpointed(waiting.join(live, "token", "left_semi"))
        release(spark)
        if waiting.limit(1).count() == 0:
            return links.select("a", "b", "overlap", "union"), components(links)
        hubs_per_bucket *= 8


def _nearest_hub(links: DataFrame) -> DataFrame:
    """(node, root): the best hub among a class and its partners, a cheap stand-in for its component between rounds."""
    both = links.select(F.col("a").alias("node"), "a_order", F.col("b").alias("other"), "b_order").union(links.select("b", "b_order", "a", "a_order"))
    best = both.groupBy("node").agg(F.min(F.least(F.struct(F.col("a_order").alias("order"), F.col("node").alias("class")), F.struct(F.col("b_order").alias("order"), F.col("other").alias("class")))).alias("best"))
    return best.select("node", F.col("best.class").alias("root"))


def _plausible(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs with enough common prefix tokens: all their other common shingles lie behind the prefix that ends first."""
    behind = lambda n: F.expr(f"{n} - least({n} - floor((3 * {n} + 3) / 4) + floor(({n} + 15) / 16), {n})")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    enough = common + F.greatest(behind("a_n"), behind("b_n")) >= F.ceil(3 * (F.col("a_n") + F.col("b_n")) / 7)
    return with_both(shared_table(pairs), prefixes, "class", ["n", "tokens"]).where(enough).select("a", "b", (-F.size("a_tokens")).alias("a_order"), (-F.size("b_tokens")).alias("b_order"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets truly reach 3/4; the suffix filter (sizes of 32 hash ranges) spares hopeless intersections."""
    joined = with_both(pairs, sets, "class", ["n", "members", "histogram"])
    most = F.aggregate(F.zip_with("a_histogram", "b_histogram", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    joined = joined.where(7 * most >= 3 * (F.col("a_n") + F.col("b_n")))
    joined = joined.withColumn("overlap", F.size(F.array_intersect("a_members", "b_members")).cast("long"))
    joined = joined.withColumn("union", F.col("a_n") + F.col("b_n") - F.col("overlap"))
    return joined.where("100 * overlap >= 75 * union").select("a", "b", "overlap", "union", "a_order", "b_order")


def document_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach; the document's own for the empty set.

    A null doc_id never is the smallest unless its whole component has no other.
    """
    members, _ = ngram_jaccard_join(docs, id_column, text_column)
    low = members.where("component_key is not null").groupBy("component_key").agg(F.min("doc_id").alias("low"))
    return members.join(low, "component_key", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of linked documents: the smallest doc_id, of rows that share it the one of smallest text hash, and of rows repeated whole one.

    Rows that share an id are judged each by its own text. Documents of the empty set and rows without a doc_id stay. Columns may have any names.
    """
    members, _ = ngram_jaccard_join(docs)
    linked = members.where("component_key is not null and doc_id is not null")
    first = linked.groupBy("component_key").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("first"))
    same = linked.groupBy("component_key", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("rows")).join(first, "component_key")
    same = same.select("doc_id", "k1", "k2", "rows", (F.struct("doc_id", "k1", "k2") != F.col("first")).alias("gone")).where("gone or rows > 1")
    marked = boxed(docs).join(same, ["doc_id", "k1", "k2"], "left").where("gone is null or not gone")
    once, more = marked.where("rows is null"), marked.where("rows > 1")
    return once.select("row.*").unionByName(more.select("row.*").dropDuplicates())
