"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text (operator 1).

*Dictionaries.* Of at most ``TOXIC`` toxic and ``ORDINARY`` other labelled texts (the smallest by hash of doc_id), words are counted by label,
once for each word before them, so that copies of a text don't count again. The toxic dictionary holds the words that toxic texts have far
more often, the ordinary one the commonest words of the others, each with its most telling words last, where matches are
cheapest. Both end with one preamble.

*Windows.* Every word of a text, between spaces and constant bytes, is one window; both dictionaries compress it. A window's cell is its
length and its two compressed lengths. A cell's weight is the log-odds of toxic and other texts that have it, from the sample; a
word that shares no five bytes with the toxic dictionary has no weight. A text's raw value is the sum of its three largest weights
over different words.

*Thresholds.* Raw values of all labelled training texts are counted by label; a monotone fit (pool adjacent violators) gives the
probability at each value, and 1/2 is the threshold. Texts without words (null, empty) have raw value 0. Labels other than 0 and
1, and null ids, teach nothing; of several labels of one id the largest counts. Without toxic labels all scores are 0.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import NON_ALNUM, find_words, shared_table, text_chunks

TOXIC = 5_000
ORDINARY = 10_000
DICTIONARY = 32_768
MARKERS = 4_096
#: Surroundings that a marker must have in toxic texts, and its log-odds at least.
SUPPORT, ODDS = 5, 2.5
LEVEL, MATCH, SHARED = 12, 4, 5
TOP = 3
STEP = 0.25
#: Around every window: the first, which both dictionaries have, makes each window compressible; behind the second no match can begin, so
#: without it short words would never be looked up.
PREAMBLE, POSTAMBLE = bytes(range(128, 160)), bytes(range(160, 170))
LONGEST = 24


@dataclass
class Compressor:
    """The two dictionaries, and the weights of cells once they are known."""

    toxic: bytes
    ordinary: bytes
    weights: dict[int, float] | None = None

    def __getstate__(self) -> dict:
        return {"toxic": self.toxic, "ordinary": self.ordinary, "weights": self.weights}

    @functools.cached_property
    def both(self) -> tuple:
        import zstandard

        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, strategy=zstandard.STRATEGY_BTOPT, **plain)
        out = []
        for content in (self.ordinary, self.toxic):
            known = zstandard.ZstdCompressionDict(content + PREAMBLE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=known).compress)
        return tuple(out)

    @functools.cached_property
    def grams(self) -> frozenset[bytes]:
        return frozenset(self.toxic[k : k + SHARED] for k in range(len(self.toxic) - SHARED + 1))

    @functools.cached_property
    def memory(self) -> dict[bytes, int]:
        return {}

    def cell(self, word: bytes) -> int:
        """Length and both compressed lengths in one number; 0 for a word that shares nothing with the toxic dictionary."""
        known = self.memory.get(word)
        if known is None:
            if len(self.memory) > 1_000_000:
                self.memory.clear()
            window = b" " + word + b" "
            known = 0
            if any(window[k : k + SHARED] in self.grams for k in range(len(window) - SHARED + 1)):
                ordinary, toxic = (len(c(PREAMBLE + window + POSTAMBLE)) for c in self.both)
                known = (min(len(window), LONGEST) * 256 + min(ordinary, 255)) * 256 + min(toxic, 255)
            self.memory[word] = known
        return known


def words_of_texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(texts in the chunk, text number, word) of the different words of every text, A-Z lower-cased."""
    for row, last, data, offsets in text_chunks(column):
        start, end, text, value = find_words(data, offsets, NON_ALNUM)
        _, first = np.unique(value ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        first.sort()
        raw = data.tobytes()
        yield last - row, text[first], [raw[a:b].lower() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]


def labelled(labels: DataFrame, id_column: str = "doc_id", label_column: str = "toxic") -> DataFrame:
    """(doc_id, toxic) with one 0 or 1 for each id."""
    named = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("toxic"))
    return named.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, known: DataFrame, text_column: str = "text") -> Compressor | None:
    """Dictionaries and cell weights from a bounded sample of ``known`` (doc_id, toxic); None without toxic texts."""
    ranked = known.withColumn("h", F.xxhash64("doc_id"))
    chosen = ranked.where("toxic = 1").orderBy("h").limit(TOXIC).union(ranked.where("toxic = 0").orderBy("h").limit(ORDINARY)).select("doc_id", "toxic")
    texts = docs.select("doc_id", F.col(text_column).alias("text")).join(F.broadcast(chosen), "doc_id")  # 15,000 ids at most
    texts = shared_table(texts.where("text is not null").select("toxic", "text"))
    sizes = dict(texts.groupBy("toxic").count().collect())
    if not sizes.get(1):
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Different (word, word before it) of each chunk: copies of a text add nothing."""
        for batch in batches:
            for row, _, data, offsets in text_chunks(batch.column(1)):
                start, end, text, value = find_words(data, offsets, NON_ALNUM)
                before = np.r_[np.zeros(1, np.uint64), value[:-1]][: len(value)] * np.r_[False, text[1:] == text[:-1]][: len(value)]
                raw = data.tobytes()
                yield pa.record_batch([batch.column(0).take(pa.array(text + row)), pa.array([raw[a:b].lower() for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()), pa.array(before.view(np.int64))], names=["toxic", "word", "before"])

    by_word = texts.mapInArrow(words, "toxic int, word binary, before long").distinct().groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).cache()
    odds = F.log((F.col("a") + 0.5) / sizes[1]) - F.log((F.col("b") + 0.5) / sizes.get(0, 1))
    markers = by_word.where((F.col("a") >= SUPPORT) & (odds > ODDS)).orderBy(F.desc("a"), "word").limit(MARKERS).select("word").collect()
    common = by_word.orderBy(F.desc("b"), "word").limit(MARKERS).select("word").collect()
    by_word.unpersist()
    toxic, ordinary = (b" " + b" ".join(bytes(r[0]) for r in reversed(rows)) + b" " for rows in (markers, common))
    model = Compressor(toxic[-DICTIONARY:], ordinary[-DICTIONARY:])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, at = batch.column(0), 0
            for n, owner, found in words_of_texts(batch.column(1)):
                pairs = np.unique(np.stack([owner, np.array([sent.value.cell(w) for w in found], np.int64)]), axis=1) if found else np.zeros((2, 0), np.int64)
                yield pa.record_batch([toxic.take(pa.array(pairs[0] + at)), pa.array(pairs[1])], names=["toxic", "cell"])
                at += n

    counted = texts.mapInArrow(cells, "toxic int, cell long").where("cell > 0").groupBy("cell").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).collect()
    model.weights = {r["cell"]: w for r in counted if (w := math.log((r["a"] + 0.5) / (sizes[1] + 1)) - math.log((r["b"] + 0.5) / (sizes.get(0, 0) + 1))) > 0}
    return model


def raw_values(docs: DataFrame, model: Compressor | None, text: Column) -> Column:
    """Sum of the largest weights over a text's different words."""
    if model is None:
        return F.lit(0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def value(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for n, owner, found in words_of_texts(texts):
            own = np.zeros((n, TOP))
            weights = np.array([sent.value.weights.get(sent.value.cell(w), 0.0) for w in found])
            for k in np.flatnonzero(weights > 0):
                row = own[owner[k]]
                low = int(row.argmin())
                row[low] = max(row[low], weights[k])
            out.append(own.sum(axis=1))
        return pa.array(np.concatenate(out))

    return value(text)


def monotone(steps: np.ndarray, toxic: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Probabilities that don't fall with the step: neighbours that would are pooled."""
    blocks: list[list[float]] = []
    for a, n in zip(toxic, total, strict=True):
        blocks.append([float(a), float(n), 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), a / n) for a, n, k in blocks]) if blocks else np.zeros(0)


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, raw) of every row; ``learn`` says of which ids labels may be used."""
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    known = shared_table(labelled(labels).where(learn))
    model = fit(named, known)
    values = shared_table(named.select("doc_id", raw_values(named, model, F.col("text")).alias("raw")))
    step = F.round(F.col("raw") / STEP).cast("int")
    counts = sorted(tuple(r) for r in values.join(known, "doc_id").groupBy(step.alias("step")).agg(F.sum("toxic"), F.count(F.lit(1))).collect())  # a few hundred steps
    steps, toxic, total = (np.array([c[k] for c in counts], float) for k in range(3))
    chance = monotone(steps, toxic, total)
    if not len(steps):
        return values.select("doc_id", F.lit(0.0).alias("score"), "raw")

    @F.arrow_udf("double")
    def probability(raw: pa.Array) -> pa.Array:
        at = np.round(raw.to_numpy(zero_copy_only=False) / STEP)
        # equal probabilities keep the order of raw values: a thousandth at most
        return pa.array(np.clip(0.999 * np.interp(at, steps, chance) + 0.001 * at / (1 + at), 0, 1))

    return values.select("doc_id", probability("raw").alias("score"), "raw")


def training_ids() -> Column:
    """Ids whose crc32 modulo 5 isn't 0."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0
