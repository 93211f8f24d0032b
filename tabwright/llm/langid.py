"""Language identification: interpolated Kneser-Ney character models in sorted arrays (operator 3).

*Fit.* All texts of known language are cut into character 5-grams (lower-cased, digits alike, white space alike, four
boundary marks in front; characters fold into 4,096 classes, so a gram is one 60-bit number). Tasks combine counts
before they are shuffled. Lower orders count distinct left neighbours; absolute discounts come from counts of counts.
Every gram is kept, whatever the language and its share of the corpus. So the model that reaches the driver and the tasks grows with the
distinct grams of the corpus: a float for each language, and some 30 bytes, a gram and order.

*Score.* A gram known in any language has its interpolated log-probability for all languages stored in one row;
others back off through context weights. The language with the lowest cross-entropy per character wins.

*Rejection.* The mean and deviation of each language's per-character loss over all training characters follow from the
same counts. A text is rejected if it has no letter, or if its loss lies above that mean by ``Z`` standard errors plus
``SLACK`` of the way to a model that finds all characters of the corpus alike.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import mix, shared_table, text_chunks

ORDER = 5
BITS = 12
UNKNOWN = "und"
Z = 8.0
SLACK = 0.5
#: Characters at most that sharpen the score; beyond, more text doesn't change it.
EVIDENCE = 40
#: Distinct grams a task holds before it hands its partial counts on.
HELD = 1 << 20


@functools.cache
def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point (1: white space, 2: digit, from 3: others by lower case), and whether it is a letter."""
    points = np.arange(0x110000, dtype=np.int64)
    low = points.copy()
    letter = np.zeros(0x110000, bool)
    classes = np.zeros(0x110000, np.int64)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            letter[p] = True
            if len(x := c.lower()) == 1:
                low[p] = ord(x)
        elif c.isspace():
            classes[p] = 1
        elif c.isdigit():
            classes[p] = 2
    folded = np.where(low < 1 << BITS, low, (low * 2654435761 >> 9) & ((1 << BITS) - 1))
    return np.where(classes > 0, classes, np.maximum(folded, 3)), letter


def grams_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of texts: first row, 5-gram of every character, characters of each text, letters of each text."""
    classes, letter = character_tables()
    for row, _, data, offsets in text_chunks(column):
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        sizes = np.diff(heads[offsets])
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        if len(points) != sizes.sum():  # bytes that are no UTF-8
            points = np.resize(points, sizes.sum())
        text = np.repeat(np.arange(len(sizes)), sizes)
        padded = np.zeros(len(points) + (ORDER - 1) * len(sizes), np.int64)
        at = np.arange(len(points)) + (ORDER - 1) * (text + 1)
        padded[at] = classes[points]
        grams = np.zeros(len(points), np.int64)
        for k in range(ORDER):
            grams |= padded[at - k] << (BITS * k)
        yield row, grams, sizes, np.bincount(text[letter[points]], minlength=len(sizes))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        grams, counts = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        return grams[first], np.add.reduceat(counts, first)

    def rows():
        for lang, parts in held.items():
            grams, counts = merged(parts)
            yield pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams), "n": pa.array(counts)})

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for row, grams, sizes, _ in grams_of(batch.column(0)):
            own = langs[row : row + len(sizes)]
            names, codes = np.unique(own.astype(str), return_inverse=True)
            of = np.repeat(codes, sizes)
            for k, name in enumerate(names):
                part = grams[of == k]
                if len(part):
                    held.setdefault(str(name), []).append(np.unique(part, return_counts=True))
                    size += len(held[str(name)][-1][0])
        if size > HELD:
            held = {k: [merged(v)] for k, v in held.items()}
            size = sum(len(v[0][0]) for v in held.values())
            if size > HELD:
                yield from rows()
                held, size = {}, 0
    yield from rows()


@dataclass
class LanguageModel:
    """Per order: sorted grams with log-probabilities by language, sorted contexts with log back-off weights."""

    langs: list[str]
    floor: float = -float(np.log(1 << BITS))
    uniform: float = 0.0
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None

    def log_prob(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Interpolated log-probabilities, texts' characters by languages; a gram that no language has backs off."""
        if order == 0:
            return np.full((len(grams), len(self.langs)), self.floor, np.float32)
        keys = self.grams[order - 1]
        at = np.minimum(np.searchsorted(keys, grams), max(0, len(keys) - 1))
        known = keys[at] == grams if len(keys) else np.zeros(len(grams), bool)
        out = np.empty((len(grams), len(self.langs)), np.float32)
        out[known] = self.logs[order - 1][at[known]]
        if not known.all():
            rest = grams[~known]
            out[~known] = self.back_off(order, rest >> BITS) + self.log_prob(order - 1, rest & ((1 << BITS * (order - 1)) - 1))
        return out

    def back_off(self, order: int, contexts: np.ndarray) -> np.ndarray:
        keys = self.contexts[order - 1]
        at = np.minimum(np.searchsorted(keys, contexts), max(0, len(keys) - 1))
        known = keys[at] == contexts if len(keys) else np.zeros(len(contexts), bool)
        return np.where(known[:, None], self.weights[order - 1][at] if len(keys) else np.float32(0), np.float32(0))

    @functools.cached_property
    def index(self) -> np.ndarray:
        """Row of the highest order by hash slot: one step in place of a binary search, but for grams that share a slot."""
        rows = np.full(1 << self.index_bits, -1, np.int32)
        rows[slots(self.grams[-1], self.index_bits)] = np.arange(len(self.grams[-1]))
        return rows

    @property
    def index_bits(self) -> int:
        """Two slots a gram at least."""
        return max(16, (2 * len(self.grams[-1])).bit_length())

    def losses(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Cross-entropy per character, texts by languages; 0 for an empty text."""
        out = np.zeros((len(sizes), len(self.langs)))
        if not len(grams):
            return out
        at = self.index[slots(grams, self.index_bits)]
        miss = np.flatnonzero((at < 0) | (self.grams[-1][at] != grams))
        extra = self.log_prob(ORDER, grams[miss])
        full, starts = sizes > 0, (np.cumsum(sizes) - sizes)[sizes > 0]
        for k in range(len(self.langs)):
            values = self.logs[-1][:, k][at]
            values[miss] = extra[:, k]
            out[full, k] = -np.add.reduceat(values.astype(np.float64), starts) / sizes[full]
        return out


def slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return (mix(grams.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """The model of all rows with a language; rows without one, and texts that are null or empty, teach nothing."""
    known = docs.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("lang is not null and text is not null")
    counted = known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    level = shared_table(counted)
    levels = [level]
    for order in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << BITS * order) - 1)
        level = shared_table(level.groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
        levels.insert(0, level)
    entries, ones = None, None
    for order, level in enumerate(levels, 1):
        context = level.groupBy("lang", F.shiftright("gram", BITS).alias("context")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        part = level.withColumn("context", F.shiftright("gram", BITS)).join(context, ["lang", "context"]).select(F.lit(order).alias("order"), "lang", "gram", "c", "total", "kinds")
        few = level.groupBy("lang").agg(F.lit(order).alias("order"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two"))
        entries, ones = (part, few) if entries is None else (entries.union(part), ones.union(few))
    return _assembled(entries.toArrow(), ones.toPandas())


def _assembled(kept: pa.Table, ones) -> LanguageModel:
    """Probabilities of every kept gram for every language, lowest order first."""
    langs = sorted(set(ones["lang"]))
    model = LanguageModel(langs)
    column = {n: kept.column(n).to_numpy() for n in ("order", "gram", "c", "total", "kinds")}
    lang = np.searchsorted(np.array(langs), kept.column("lang").to_pylist()) if len(kept) else np.zeros(0, np.int64)
    discount = {(r.order, r.lang): max(0.05, r.one / (r.one + 2 * r.two)) if r.one else 0.5 for r in ones.itertuples()}
    model.uniform = float(np.log(max(2, len(np.unique(column["gram"][column["order"] == 1])))))
    for order in range(1, ORDER + 1):
        own = column["order"] == order
        gram, who = column["gram"][own], lang[own]
        d = np.array([discount.get((order, x), 0.5) for x in langs])[who] if len(gram) else np.zeros(0)
        contexts = np.unique(gram >> BITS)
        weights = np.zeros((len(contexts), len(langs)), np.float32)
        weights[np.searchsorted(contexts, gram >> BITS), who] = np.log(d * column["kinds"][own] / column["total"][own])
        model.contexts.append(contexts)
        model.weights.append(weights)
        keys = np.unique(gram)
        lower = model.log_prob(order - 1, keys & ((1 << BITS * (order - 1)) - 1)).astype(np.float64) + model.back_off(order, keys >> BITS)
        at = np.searchsorted(keys, gram)
        lower[at, who] = np.logaddexp(lower[at, who], np.log(np.maximum(column["c"][own] - d, 1e-12) / column["total"][own]))
        model.grams.append(keys)
        model.logs.append(np.asfortranarray(lower.astype(np.float32)))
    loss = -model.logs[-1][at, who] if len(langs) else np.zeros(0)
    weight = column["c"][own].astype(float)
    total = np.maximum(np.bincount(who, weight, len(langs)), 1)
    model.mean = np.bincount(who, weight * loss, len(langs)) / total
    model.deviation = np.sqrt(np.maximum(np.bincount(who, weight * loss**2, len(langs)) / total - model.mean**2, 0))
    return model


def identified(docs: DataFrame, model: LanguageModel, text: Column) -> Column:
    """Struct (lang, score, loss, rejected) of a text column; ``und`` with score 0 for null texts and texts without a letter.

    The score is the softmax of the losses, each counted for at most ``EVIDENCE`` characters. Ties go to the first language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, loss double, rejected boolean")
    def judge(texts: pa.Array) -> pa.Array:
        known = sent.value
        n = len(texts)
        name, score, loss, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        if known.langs:
            for row, grams, sizes, letters in grams_of(texts):
                losses = known.losses(grams, sizes)
                best = losses.argmin(axis=1)
                low = losses[np.arange(len(sizes)), best]
                odds = np.exp(-(losses - low[:, None]) * np.minimum(sizes, EVIDENCE)[:, None])
                limit = known.mean[best] + Z * known.deviation[best] / np.sqrt(np.maximum(sizes, 1)) + SLACK * (known.uniform - known.mean[best])
                real = letters > 0
                rows = np.flatnonzero(real) + row
                name[rows] = np.array(known.langs, object)[best[real]]
                score[rows], loss[rows], rejected[rows] = (1 / odds.sum(axis=1))[real], low[real], (low > limit)[real]
        return pa.StructArray.from_arrays([pa.array(name.tolist(), pa.string()), pa.array(score), pa.array(loss, from_pandas=True), pa.array(rejected)], names=["lang", "score", "loss", "rejected"])

    return judge(text)


def training_rows(docs: DataFrame) -> Column:
    """Documents whose crc32(doc_id) mod 4 isn't 2; a null id teaches nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected by a model of all rows with a language, with their columns as they are."""
    model = fit(docs)
    return docs.where(~identified(docs, model, F.col("text"))["rejected"])
