"""WARC archives, ranked search and spelling variants against plain statements of what they do."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabwright.llm import lexical, spelling, warc

# ---------------------------------------------------------------- WARC

PAGES = "page_id long, url string, html string, id string, digest string, low string, payload string"


@pytest.fixture(scope="module")
def pages(spark):
    long = "".join(random.Random(1).choices("abcdefgh <>/é\n", k=60_000))
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/4\nx y", "<p>one</p>"), (5, "", long), (6, "http://a/6", "ñandú"), (6, "http://b/6", "ñandú"), (7, "u", "ñandú"), (None, "n", "<p>one</p>"), (None, "m", "only"), (None, "m2", "only")]
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)


def expected(rows) -> Counter:
    low = defaultdict(list)
    for r in rows:
        low[r.html or ""].append(r.page_id)
    out = Counter()
    for r in rows:
        first = min((i for i in low[r.html or ""] if i is not None), default=None)
        data = (r.html or "").encode()
        again = first is not None and r.page_id != first
        out[(None if r.page_id is None else str(r.page_id), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", str(first) if again else None)] += 1
    return out


@pytest.mark.parametrize("step", [9999, 1 << 20])
def test_archives_come_back_whole(spark, pages, tmp_path, step):
    warc.write_archives(pages.repartition(2, "page_id"), str(tmp_path))
    back = warc.read_archives(spark, str(tmp_path), range_bytes=step).where("record_type <> 'warcinfo'").collect()
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == expected(pages.collect())
    payloads = Counter(bytes(r.payload) for r in back if r.record_type == "response")
    assert set(payloads) == {(r.html or "").encode() for r in pages.collect()}
    urls = Counter(r.url for r in back)
    assert urls["http://a/4%0Ax%20y"] == 1 and urls[None] == 1 and urls[""] == 1


def test_files_are_ordinary_gzip(spark, pages, tmp_path):
    warc.write_archives(pages.coalesce(1), str(tmp_path))
    (name, size), = warc.archive_files(str(tmp_path))
    text = gzip.decompress((tmp_path / name).read_bytes())
    assert text.count(b"WARC/1.1\r\n") == pages.count() + 1 and size == (tmp_path / name).stat().st_size


def test_smaller_payloads_are_responses(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path), min_bytes=7)
    rows = warc.read_archives(spark, str(tmp_path), payload=False).where("record_type = 'revisit'").collect()
    assert sorted((r.id or "", r.refers_to) for r in rows) == [("", "1"), ("4", "1"), ("7", "6")]


def test_more_copied_payloads_than_a_broadcast_may_hold(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FEW", 1)
    warc.write_archives(pages, str(tmp_path))
    back = warc.read_archives(spark, str(tmp_path), payload=False).where("record_type <> 'warcinfo'").collect()
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == expected(pages.collect())


def nested(level: int) -> bytes:
    """A record that stores, uncompressed, an archive of whole records and bytes that look like magic."""
    inner = b"".join(warc.page_record(f"in{k}", "u", b"inner %d" % k, "A" * 32, None) for k in range(40))
    payload = warc.MAGIC * 50 + inner + b"\x1f\x1f\x8b\x1f\x8b\x08" * 20
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = warc.base32(hashlib.sha1(payload).digest())
    return warc.encode_record("response", http + payload, [("WARC-Record-ID", warc.record_id("outer", digest)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")], level)


@pytest.mark.parametrize("step", [200, 3000, 1 << 20])
def test_archives_inside_archives_are_not_read(spark, tmp_path, step):
    members = [warc.page_record(str(k), "u", b"page %d" % k, warc.base32(hashlib.sha1(b"page %d" % k).digest()), None) for k in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*members[:2], nested(0), *members[2:]]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members))
    rows = warc.read_archives(spark, str(tmp_path), range_bytes=step).collect()
    assert Counter(r.id for r in rows) == Counter({"outer": 1} | {str(k): 2 for k in range(5)})
    assert all(r.offset + r.stored_bytes <= r.file_bytes for r in rows)


def test_every_cut_gives_each_record_to_one_range(tmp_path):
    data = b"".join(warc.page_record(str(k), None, random.Random(k).randbytes(k * 40), warc.base32(hashlib.sha1(random.Random(k).randbytes(k * 40)).digest()), None) for k in range(12))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    with path.open("rb") as handle:
        whole = [(at, n) for at, n, _, _ in warc.records_in(handle, len(data), 0, len(data))]
        assert len(whole) == 12 and sum(n for _, n in whole) == len(data)
        for cut in range(0, len(data), 37):
            parts = [*warc.records_in(handle, len(data), 0, cut), *warc.records_in(handle, len(data), cut, len(data))]
            assert [(at, n) for at, n, _, _ in parts] == whole


def test_damaged_and_empty_archives(spark, pages, tmp_path):
    good = warc.page_record("1", "u", b"x", warc.base32(hashlib.sha1(b"x").digest()), None)
    (tmp_path / "a.warc.gz").write_bytes(good + good[:-5])
    with pytest.raises(ValueError, match="damaged"):
        warc.read_archives(spark, str(tmp_path))
    none = tmp_path / "none"
    warc.write_archives(pages.where("false"), str(none))
    assert warc.read_archives(spark, str(none)).count() == 0


# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, best=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    full = [(i, b) for i, b in bags if b]
    n_docs, length = len(full), sum(sum(b.values()) for _, b in full)
    df = Counter(t for _, b in full for t in b)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for i, b in full:
            m = 75 + (25 * sum(b.values()) * n_docs) // length
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, q in asked.items() if b[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=lambda r: (r[0], r[1]))


def search_cases():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["élan", "Ünder", "日本"]
    docs = [(k, " ".join(rng.choices(vocabulary, weights=range(63, 0, -1), k=rng.choice([1, 3, 10, 40, 200])))) for k in range(300)]
    docs += [(400 + k, "W1 w2, w3; ÉLAN élan w50") for k in range(60)]  # copies
    docs += [(500, None), (501, ""), (502, " ,;"), (None, "w50 w51 w52"), (503, " ".join(["w59"] * 20_000 + ["w58"])), (7, docs[7][1])]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 6, 30])))) for k in range(12)]
    items += [(20, None), (21, ""), (22, "unknown word"), (23, "w1 w1 W1 w58"), (24, " ".join(vocabulary))]
    return docs, items


@pytest.mark.parametrize("cells", [64, 1 << 23])
def test_search_is_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    docs, items = search_cases()
    frame = spark.createDataFrame([(*d, "x", 1, 1) for d in docs], "doc_id long, text string, item_id string, key long, n long").repartition(3)
    got = lexical.search(frame, spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id long")).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=lambda r: (r[0], r[1])) == plain_search(docs, items)


def test_search_in_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 5)
    docs, items = search_cases()
    docs = docs[:80]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), best=4).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=lambda r: (r[0], r[1])) == plain_search(docs, items, 4)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "w1")], "doc_id long, text string"), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_masks_below_the_last_place_are_left_out():
    rng = np.random.default_rng(0)
    tf = (rng.random((5000, 12)) < 0.3).astype(np.int64)
    m, worth = np.full(5000, 100), np.arange(1, 13) * 100
    rows, scores, seen = lexical.evaluate(tf, m, worth, 1, 20)
    every = (lexical.part(tf, m[:, None]) * worth).sum(axis=1)
    assert sorted(scores)[-20:] == sorted(every)[-20:] and seen < 2500
    assert lexical.evaluate(tf, m, worth, int(every.max()) + 1, 20)[2] == 0


# ---------------------------------------------------------------- spelling variants

def plain_variants(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c > 1}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in others.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n[w], len(others[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def variant_texts():
    rng = random.Random(9)
    base = ["recommend", "separate", "aaaaaaaa", "bookkeeper", "ñandúes", "straßenbahn", "abababab", "commitment", "naïvetés", "mississippi"]
    docs = []
    for k in range(400):
        words = rng.choices(base, weights=[400, 300, 50, 60, 40, 40, 30, 25, 15, 30], k=12)
        for j in range(12):
            w = words[j]
            for _ in range(rng.choice([0] * 8 + [1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + w[at] + w[at:], w[:at] + rng.choice("aeé") + w[at + 1 :]])
            words[j] = rng.choice([w, w, w.upper(), w + "9x"])
        docs.append((k, " ".join(words)))
    long = "x" * 3000
    return [*docs, docs[3], (None, docs[4][1]), (900, None), (901, ""), (902, "short 12 _"), (903, f"{long} {long} y{long} {long[1:]}z {long[1:]}z"), (904, long)]


def test_spelling_variants_against_all_pairs(spark):
    docs = variant_texts()
    frame = spark.createDataFrame([(*d, "w", 1, "f") for d in docs], "doc_id long, text string, word string, n long, form string")
    got = spelling.spelling_variants(frame).collect()
    want = plain_variants(docs)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(r.form is not None for r in got) > 20 and any(r.form is not None and r.root != r.form for r in got)


def test_pairs_come_out_once(spark):
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaaa", "abcdefg", "abcdefgh", "abdefgh", "xbcdefg", "abcdefx", "abcxefg"]
    pairs = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs))
    assert ("aaaaaaa", "aaaaaaaa") in pairs and ("abcdefgh", "abdefgh") in pairs and ("abcdefg", "xbcdefg") in pairs


def test_no_words(spark):
    frame = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert spelling.spelling_variants(frame).count() == 0
    assert spelling.spelling_variants(frame.where("false")).columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(17)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w17"}
