"""Spelling variants grouped by asymmetric q-chunks (operator 13).

Words are counted once over all texts; everything after works on the table of distinct words. Two words are near if they
differ by one inserted, deleted or replaced code point.

1. *Chunks.* The longer word of a pair (either, if they are equally long) is cut into two disjoint chunks. One edit leaves
   one chunk whole, so the pair agrees there; what that chunk leaves over holds the edit and is cut into two chunks again.
   The word thus gives four rows: a quarter that may hold the edit, and all the letters around it.
2. *Grams.* The other word gives its positional grams of the same sizes. A chunk meets a gram within shift one: before the
   edit at the same place, behind it one place earlier if the word is one letter shorter. Only grams at such places are
   sent; the others could not meet anything.
3. *Join and verification.* Rows meet on a 64-bit hash of length, quarter and letters, and the edit distance is then
   computed. A deleted letter of a run of equal letters could lie in two quarters: the last one counts, so a pair comes out
   once and no ``distinct`` over pairs is needed.

A word's form is its near word with the largest count, if that is at least ``RATIO`` times its own; forms are followed to
the root by pointer jumping (counts grow tenfold with each step, so a handful of rounds suffice).

Null and empty texts have no words. Rows are not merged: a repeated row counts again. A null id is written as nothing
before the colon. Equal counts: the word first in code-point order is the form. Letters are those of Latin-1, and only A-Z
are lower-cased. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import release, shared_table

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shortest word and least number of occurrences.
SHORTEST, LEAST = 7, 2
#: A form is at least so many times as frequent.
RATIO = 10
#: Joins of distinct words are never left to Spark's estimate: it takes a compressed file for its rows, and rows of ``explode`` for those before it,
#: and would collect in the driver what is many times larger.
SHUFFLED = "merge"
#: One of so many (document, run) pairs loses a letter before words are counted.
THINNED = 31


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", thinned: int | None = THINNED, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): words of ``shortest`` code points or more that occur ``least`` times or more in all texts.

    With ``thinned`` = k, a run loses the code point h % length where k divides h, the crc32 of ``<id>:<run>``.
    Runs too short to become a word are never taken out of the text.
    """
    runs = F.expr(rf"regexp_extract_all(text, '[{LETTERS}]{{{shortest},}}', 0)")
    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column).alias("text"))
    rows = rows.select("id", F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, SMALL).alias("run"))
    word = F.col("run")
    if thinned:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        at = F.expr("cast(h % length(run) as int)")
        rows = rows.withColumn("h", h)
        word = F.when(F.col("h") % thinned == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    words = rows.select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _cuts(size: Column) -> list[tuple[Column, Column]]:
    """Start and end of the four quarters of a word of that length: two chunks, each cut in two."""
    half = F.floor(size / 2).cast("int")
    edges = [F.lit(0), F.floor(half / 2).cast("int"), half, F.floor((half + size) / 2).cast("int"), size]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _row(size: Column, quarter: int, start: Column, end: Column, shift: int) -> Column:
    """The key of a word as seen with an edit in [start, end) of the longer word; ``shift`` letters are missing behind it."""
    around = F.concat(F.substring("word", F.lit(1), start), F.lit(" "), F.substring("word", end - shift + 1, F.length("word")))
    return F.struct(F.xxhash64(size, F.lit(quarter), around).alias("key"), end.alias("end"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words at edit distance one, once; ``a`` is the longer, or the first of equal length."""
    size = F.length("word")
    chunks = [_row(size, k, s, e, 0) for k, (s, e) in enumerate(_cuts(size))]
    grams = chunks + [_row(size + 1, k, s, e, 1) for k, (s, e) in enumerate(_cuts(size + 1))]
    longer = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(F.array(*chunks)).alias("c")).select("a", "a_n", "c.key", "c.end")
    other = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(*grams)).alias("g")).select("b", "b_n", "g.key")
    a, b = F.length("a"), F.length("b")
    met = longer.join(other.hint(SHUFFLED), "key").where(((a == b) & (F.col("a") < F.col("b"))) | ((a == b + 1) & (F.substring("a", F.lit(1), F.col("end")) != F.substring("b", F.lit(1), F.col("end")))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row (word, form): the last word that following forms reaches. Forms must not run in a circle."""
    step = shared_table(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = shared_table(step.join(ahead.hint(SHUFFLED), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            return step


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", thinned: int | None = THINNED, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts."""
    words = shared_table(count_words(docs, id_column, text_column, thinned))
    pairs = near_pairs(words)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    sides = pairs.select(F.explode(ends).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    known = words.join(best.hint(SHUFFLED), "word", "left").withColumn("top_n", -F.col("best.less"))
    good = F.col("top_n") >= ratio * F.col("n")
    known = shared_table(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, F.col("top_n")).alias("form_n")))
    release(docs.sparkSession)
    ends_at = roots(known.where("form is not null"))
    return known.join(ends_at.hint(SHUFFLED), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
