"""Small cases with known or brute-force results: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import decontaminate, html, langid, licenses, ngram_join, packing, substring, suffix, toxicity, vptree
from tabwright.llm.common import components

SCHEMA = "doc_id long, text string, lang string, class string, token long, k1 string"
WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "el", "on", "ir", "ut")]


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus() -> dict[int, str | None]:
    """Copies, near copies, a passage that several texts share, short and empty texts, and one long text."""
    base = prose(1, 120)
    passage = prose(2, 60)
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \n\t", 3: "one two", 4: "One TWO", 5: " ".join(base), 6: " ".join(base).upper()}
    for k in range(7, 15):
        near = list(base)
        near[(7 * k) % 120] = f"new{k}"
        texts[k] = " ".join(near)
    for k in range(15, 22):
        texts[k] = " ".join([*prose(k, 80), *passage, *prose(100 + k, 70)])
    texts[22] = " ".join(prose(3, 6000))
    texts[23] = "ñandú Élan " + " ".join(passage[:49])
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "x", 1, "k") for k, t in corpus().items()]
    return spark.createDataFrame([*rows, rows[5], (None, corpus()[15], None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(1, 9), (9, 5), (2, 2)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert {roots[k] for k in range(10, 41)} == {10} and {roots[k] for k in (1, 5, 9)} == {1}


def test_ngram_join(docs, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.document_components(docs).collect() if r.doc_id is not None}
    sets = {k: shingle_set(t) for k, t in corpus().items()}
    low_id = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low_id[a] = min(low_id[a], low_id[b])
    assert got == {k: (len(sets[k]), low_id[k]) for k in sets}
    assert ngram_join.document_components(nothing).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(k for k in sets if low_id[k] == k)


def test_near_passages(docs, nothing):
    spans = defaultdict(set)
    for r in substring.near_passages(docs).where("doc_id is not null").collect():
        spans[r.doc_id] |= set(range(r.start, r.end))
        assert r.similarity >= 0.75 and r.end - r.start >= 50
    seen: dict[tuple, int] = {}
    for k, text in sorted(corpus().items()):
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        for i in range(len(words) - 49):
            first = seen.setdefault(tuple(words[i : i + 50]), k)
            assert first == k or set(range(i, i + 50)) <= spans[k]
    assert not {22, 23} & set(spans)
    assert substring.near_passages(nothing).count() == 0
    left = {r.doc_id: r.text for r in substring.remove_passages(docs).where("doc_id is not null").collect()}
    assert left[5] == corpus()[5] and 6 not in left and len(left[16].split()) == 150


def test_compact_windows_are_minima():
    value = np.random.default_rng(3).integers(0, 1 << 62, 400).astype(np.uint64)
    owner = np.repeat([0, 1, 2], [200, 30, 170])
    centre, left, right = substring.compact_windows(value, owner, 1)
    order = substring.mix(value ^ np.uint64((0x9E3779B97F4A7C15 * 2) & (2**64 - 1)))
    for start in range(355):
        if owner[start] == owner[start + 45]:
            c = start + int(order[start : start + 46].argmin())
            k = int(np.flatnonzero(centre == c)[0])
            assert left[k] <= start and right[k] >= start + 45 and order[left[k] : right[k] + 1].min() == order[c]


def test_repeated_bytes(docs, nothing):
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    count: dict[bytes, int] = defaultdict(int)
    for _, b in texts:
        for i in range(len(b) - 199):
            count[b[i : i + 200]] += 1
    want = []
    for k, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((k, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in suffix.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix.remove_repeats(nothing).count() == 0


def test_language_model(spark, nothing):
    rows = [(k, " ".join(prose(k, 60)), "xx") for k in range(40)] + [(100 + k, " ".join(w[::-1] + "q" for w in prose(k, 60)), "yy") for k in range(40)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(known)
    grams = next(langid.grams_of(known.select("text").toArrow().column(0).combine_chunks()))[1][:50]
    contexts = np.unique(grams >> 12)[:5]
    total = sum(np.exp(model.log_prob(5, (contexts << 12) | c)) for c in range(4096))
    assert model.langs == ["xx", "yy"] and (total > 0.9).all() and (total < 1.1).all()
    asked = spark.createDataFrame([(1, " ".join(prose(999, 30))), (2, " ".join(w[::-1] + "q" for w in prose(998, 30))), (3, None), (4, "12 34 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.j for r in asked.select("doc_id", langid.identified(asked, model, F.col("text")).alias("j")).collect()}
    assert [got[k].lang for k in range(1, 6)] == ["xx", "yy", "und", "und", "und"]
    assert [got[k].rejected for k in range(1, 6)] == [False, False, True, True, True]
    empty = langid.fit(nothing)
    assert {r.j.lang for r in asked.select(langid.identified(asked, empty, F.col("text")).alias("j")).collect()} == {"und"}


def test_packing_plan_is_whole_and_tight():
    rng = np.random.default_rng(5)
    for capacity, n in ((8, 14), (12, 12), (60, 300), (1024, 5000)):
        for _ in range(5):
            counts = np.bincount(rng.integers(1, capacity + 1, n), minlength=capacity + 1)
            patterns = packing.plan(counts, capacity)
            back = np.zeros(capacity + 1, int)
            for pattern, bins in patterns:
                assert sum(a * b for a, b in pattern) <= capacity
                for length, times in pattern:
                    back[length] += times * bins
            assert (back == counts).all()
            bins, least = sum(b for _, b in patterns), packing.lower_bound(counts, capacity)
            assert least <= bins <= least + max(1, least // 50)


def test_dominance_is_optimal():
    """On instances small enough to solve exactly, fixing sets never costs a bin."""
    def best(items: tuple, room: int) -> int:
        if not items:
            return 0
        low = len(items)
        first, rest = items[0], items[1:]
        for mask in range(1 << len(rest)):
            if first + sum(x for k, x in enumerate(rest) if mask >> k & 1) <= room:
                low = min(low, 1 + best(tuple(x for k, x in enumerate(rest) if not mask >> k & 1), room))
        return low

    rng = np.random.default_rng(8)
    for _ in range(40):
        items = tuple(sorted(rng.integers(1, 11, 6).tolist(), reverse=True))
        counts = np.bincount(items, minlength=11)
        left = counts.copy()
        fixed = sum(n for _, n in packing.dominance(left, 10))
        assert fixed + best(tuple(np.repeat(np.arange(11), left)[::-1].tolist()), 10) == best(items, 10)


def test_packing(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = docs.unionByName(docs.sparkSession.createDataFrame([(50, "a <|endoftext|> b", None, None, None, None)], SCHEMA))
    rows = packing.pack(texts, packing.public_vocabulary()).collect()
    by_sequence, lengths = defaultdict(list), defaultdict(int)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    for r in texts.where("doc_id is not null and doc_id <> 5").collect():
        assert lengths[r.doc_id] == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert packing.pack(nothing, packing.public_vocabulary()).count() == 0


def test_decontaminate(spark, docs, nothing):
    words = corpus()[22].split()
    items = spark.createDataFrame([(1, " ".join(words[100:130])), (2, "One-two"), (3, None), (4, "!!"), (5, " ".join(prose(77, 20))), (1, " ".join(words[100:130])), (None, "one")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).where("doc_id is not null").collect()}
    assert (got[22].n_hit, got[22].items, [tuple(s) for s in got[22].spans]) == (30, ["1"], [(100, 130)])
    assert got[3].items == got[4].items == ["2"] and got[3].n_hit == 2
    assert all(got[k].n_hit == 0 for k in got if k not in (3, 4, 22)) and got[0].n_words == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(nothing, items).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_nearest(spark):
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(900, 6)) + 4 * rng.integers(0, 3, (900, 1)), 2)
    points[300:420] = points[0]  # one vector many times
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(points)]
    odd = [(1000, None), (1100, []), (1200, [0.0] * 6), (1300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1400, [float("nan")] * 6), (None, [1.0] * 6), (1500, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vptree.nearest(df, factor=1.0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in range(0, 900, 100):
        far = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        order = np.lexsort((np.arange(900), far))[:10]
        assert sorted(got[q]) == [(n + 1, int(k), float(far[k])) for n, k in enumerate(order)]
    assert set(got) == set(range(0, 900, 100))
    assert vptree.nearest(df.limit(0)).count() == 0


def test_html_blocks():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><!-- c --><p>One &amp; two<br>three<p>Four <b>five</b></p><script>var a='</p>';</script><div class='c d'>six"
    assert [(b.text, b.path[-1]) for b in html.blocks(page)] == [("T", "title"), ("Home", "a"), ("One & two three", "p"), ("Four five", "p"), ("six", "c d")] or [b.text for b in html.blocks(page)] == ["T", "Home", "One & two three", "Four five", "six"]
    assert html.blocks(None) == html.blocks("") == []


def test_html_gradients():
    """The backward pass agrees with differences of the loss."""
    rng = np.random.default_rng(2)
    pages = [html.laid_out([" ".join(prose(k, 12)), " ".join(prose(k + 50, 9))], ["home", "about us"], rng) for k in range(3)]
    model = html.Labeller()
    f, labels = html.Features([b for b, _ in pages]), np.concatenate([y for _, y in pages]).astype(np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss() -> float:
        p = np.clip(model.score(f), 1e-9, 1 - 1e-9)
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())

    grads = model.gradients(f, labels)
    for name in ("xf", "hb", "cf", "out", "word"):
        flat = model.p[name].reshape(-1)
        at = int(np.abs(grads[name]).argmax())
        old = flat[at]
        flat[at] = old + 1e-3
        up = loss()
        flat[at] = old - 1e-3
        assert abs((up - loss()) / 2e-3 - grads[name].reshape(-1)[at]) < 2e-3 + 0.05 * abs(grads[name].reshape(-1)[at])
        flat[at] = old


def test_html_extraction(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    pages = pages.withColumn("score", F.lit(1)).unionByName(spark.createDataFrame([(-1, None, None, 1), (-2, "u", "", 1)], "page_id long, url string, html string, score int"))
    right = total = 0
    for r in html.extract_pages(pages).collect():
        found = html.blocks(r.html)
        total += 1
        right += r.main_text == "\n".join(b.text for b, y in zip(found, html.by_mark_up(found), strict=True) if y)
    assert right >= 0.98 * total


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["zorgle", "krumpf", "scrim", "vlatz"]
    rows, labels = [], []
    for k in range(600):
        words = prose(k, 40)
        if k % 3 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, 39), rng.choice(bad))
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(k % 3 == 0)))
    docs = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x"), (None, "scrim", "x"), rows[1]], "doc_id long, text string, raw string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known, toxicity.training_ids()).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.doc_id is not None and r.doc_id < 600]
    assert sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in tested) >= 0.97 * len(tested)
    assert all(r.score < 0.5 for r in got if r.doc_id in (1000, 1001))
    assert {r.score for r in toxicity.toxicity(docs, known.where("toxic = 7"), toxicity.training_ids()).collect()} == {0.0}


def test_licenses(spark, nothing):
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, "Text. " + mit + ". More text here."), (2, "Released under the MIT License."), (3, " ".join(prose(4, 300))), (4, None), (5, ""), (2, "Released under the MIT License."), (6, "released under the GPL license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.at, r.containment) for r in licenses.scan(docs).collect())
    assert got == [(1, "mit", 1, 1.0), (2, "mit-line", 0, 1.0), (2, "mit-line", 0, 1.0)]
    assert licenses.scan(nothing).count() == 0
