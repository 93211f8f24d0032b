"""Main text of HTML pages by a recurrent block labeller (operator 6).

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with the path of open tags (names, class and id
words), its decoded text and how much of it is link text. Scripts, styles, comments and other mark-up have no text.
A block's vector is the mean of learnt vectors for hashed path parts and for hashed words, and a few numbers. A bidirectional
LSTM in numpy reads the whole sequence and says for every block whether it is main text.

*Training* takes ``PAGES`` pages at most (the smallest by hash of their content): their blocks inside article or main
elements are labelled by mark-up, and their texts are also laid out anew in ``LAYOUTS`` page designs with menus,
headers, side bars, adverts, notices, forms, comments and footers under many names, so that labels follow from the whole page and
not from one template. The driver trains on this bounded sample; every page is labelled whole, in batches.

Null and empty pages have empty text. Blocks keep page order; nothing is cut or dropped by length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import NON_ALNUM, find_words

PAGES = 300
LAYOUTS = 900
BUCKETS = 4096
SIZE = 16
HIDDEN = 16
EPOCHS = 10
SEED = 11

#: Names of HTML elements by what they do to the text flow.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CLOSES_PARAGRAPH = BLOCK - frozenset("body button caption dd dt head html iframe label legend li noscript optgroup option select tbody td tfoot th thead title tr".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|textarea|noembed|noframes|svg|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_share: float


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks with text, in order."""
    stack: list[tuple[str, str]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(tuple(x for pair in stack for x in pair if x), text, min(1.0, linked / max(1, len(raw.strip())))))
            parts.clear()
        linked = 0

    for m in TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            parts.append(text)
            if any(name == "a" for name, _ in stack):
                linked += len(text.strip())
        elif (tag := m["tag"]) is not None:
            tag = tag.lower()
            if tag in BLOCK:
                flush()
            elif tag == "br":
                parts.append(" ")
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                stops = CLOSES_ITSELF.get(tag)
                for k in range(len(stack) - 1, -1, -1):
                    name = stack[k][0]
                    if (stops and name == tag) or (name == "p" and tag in CLOSES_PARAGRAPH):
                        del stack[k:]
                        break
                    if stops and name in stops or not stops and name in BLOCK and name != "p":
                        break
                if tag not in VOID and not m["attrs"].endswith("/"):
                    names = " ".join(v.lower() for a in ATTRIBUTE.finditer(m["attrs"]) for v in a.groups()[1:] if v)
                    stack.append((tag, names))
    flush()
    return out


# ---------------------------------------------------------------- vectors

def _hashed(items: list[str]) -> list[int]:
    """Buckets of short strings, from the bytes alone, so alike in every process."""
    data = np.frombuffer("\n".join(items).encode("utf-8", "replace"), np.uint8)
    _, _, _, values = find_words(data, np.array([0, len(data)]), NON_ALNUM)
    return (values % np.uint64(BUCKETS)).astype(np.int64).tolist()


class Features:
    """Path buckets, word buckets and numbers of a list of pages' blocks."""

    def __init__(self, pages: list[list[Block]]):
        flat = [b for page in pages for b in page]
        self.sizes = np.array([len(p) for p in pages], np.int64)
        self.path, self.path_at = self._bags([" ".join(f"d{min(9, len(b.path) - k)}{part.replace('-', ' ').replace('_', ' ')} {part.replace('-', ' ').replace('_', ' ')}" for k, part in enumerate(b.path)) for b in flat])
        self.word, self.word_at = self._bags([b.text for b in flat])
        size = np.array([len(b.text) for b in flat], float)
        stops = np.array([sum(b.text.count(c) for c in ".,;:!?") for b in flat], float)
        place = np.concatenate([np.arange(n) / max(1, n - 1) for n in self.sizes]) if flat else np.zeros(0)
        self.numbers = np.stack([np.log1p(size) / 8, 20 * stops / np.maximum(size, 1), np.array([b.link_share for b in flat]), place, np.array([len(b.path) for b in flat]) / 20], axis=1).astype(np.float32) if flat else np.zeros((0, 5), np.float32)

    @staticmethod
    def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [t.encode("utf-8", "replace") for t in texts]
        offsets = np.zeros(len(data) + 1, np.int64)
        np.cumsum([len(d) for d in data], out=offsets[1:])
        _, _, owner, values = find_words(np.frombuffer(b"".join(data), np.uint8), offsets, NON_ALNUM)
        return (values % np.uint64(BUCKETS)).astype(np.int64), np.asarray(owner, np.int64)


def _mean(table: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(ids):
        counts = np.bincount(owner, minlength=n)
        starts = (np.cumsum(counts) - counts)[counts > 0]
        out[counts > 0] = np.add.reduceat(table[ids], starts, axis=0) / counts[counts > 0, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bag vectors, a bidirectional LSTM and a logistic output, all in numpy."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        width = 2 * SIZE + 5
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"path": 0.3 * draw(BUCKETS, SIZE) * np.sqrt(BUCKETS, dtype=np.float32), "word": 0.3 * draw(BUCKETS, SIZE) * np.sqrt(BUCKETS, dtype=np.float32), "out": draw(2 * HIDDEN + width, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p[f"x{side}"], self.p[f"h{side}"], self.p[f"c{side}"] = draw(width, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1

    def inputs(self, f: Features) -> np.ndarray:
        n = len(f.numbers)
        return np.hstack([_mean(self.p["path"], f.path, f.path_at, n), _mean(self.p["word"], f.word, f.word_at, n), f.numbers])

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States of one direction over pages by steps by inputs, with what the backward pass needs."""
        pages, steps, _ = x.shape
        gates_in = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        states, kept = np.zeros((pages, steps, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates_in[:, t] + h @ self.p[f"h{side}"]
            i, forget, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = forget * c + i * g
            m = mask[:, t, None]
            kept.append((t, h, c, i, forget, o, g, new))
            h, c = np.where(m, o * np.tanh(new), h), np.where(m, new, c)
            states[:, t] = h
        return states, kept

    def _padded(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps = int(sizes.max())
        mask = np.arange(steps) < sizes[:, None]
        wide = np.zeros((len(sizes), steps, x.shape[1]), np.float32)
        wide[mask] = x
        return wide, mask, np.flatnonzero(mask.ravel())

    def score(self, f: Features, together: int = 4096) -> np.ndarray:
        """Probability of main text for every block; pages of like length are read together."""
        x = self.inputs(f)
        out = np.zeros(len(x))
        begin = np.cumsum(f.sizes) - f.sizes
        order = np.argsort(f.sizes, kind="stable")
        order = order[f.sizes[order] > 0]
        while len(order):
            take = max(1, min(len(order), together // max(1, int(f.sizes[order[min(len(order), 64) - 1]]))))
            some, order = order[:take], order[take:]
            rows = np.concatenate([np.arange(begin[p], begin[p] + f.sizes[p]) for p in some])
            wide, mask, _ = self._padded(x[rows], f.sizes[some])
            states = np.concatenate([self._run(wide, mask, "f")[0], self._run(wide, mask, "b")[0], wide], axis=2)[mask]
            out[rows] = _sigmoid(states @ self.p["out"] + self.p["bias"])[:, 0]
        return out

    def gradients(self, f: Features, labels: np.ndarray) -> dict[str, np.ndarray]:
        x = self.inputs(f)
        wide, mask, _ = self._padded(x, f.sizes)
        (sf, kf), (sb, kb) = self._run(wide, mask, "f"), self._run(wide, mask, "b")
        top = np.concatenate([sf, sb, wide], axis=2)
        error = np.zeros(mask.shape, np.float32)
        error[mask] = (_sigmoid(top[mask] @ self.p["out"] + self.p["bias"])[:, 0] - labels) / len(labels)
        grads = {"out": top[mask].T @ error[mask][:, None], "bias": np.array([error.sum()], np.float32)}
        back = error[:, :, None] * self.p["out"][:, 0]
        dx = back[:, :, 2 * HIDDEN :].copy()
        for side, kept, ds in (("f", kf, back[:, :, :HIDDEN]), ("b", kb, back[:, :, HIDDEN : 2 * HIDDEN])):
            dh, dc = np.zeros((len(mask), HIDDEN), np.float32), np.zeros((len(mask), HIDDEN), np.float32)
            gx, gh, gc = (np.zeros_like(self.p[k + side]) for k in "xhc")
            for t, h, c, i, forget, o, g, new in reversed(kept):
                m = mask[:, t, None]
                dh = dh + ds[:, t]
                squash = np.tanh(new)
                inner = np.where(m, dc + dh * o * (1 - squash**2), 0)
                dz = np.hstack([inner * g * i * (1 - i), inner * c * forget * (1 - forget), np.where(m, dh * squash, 0) * o * (1 - o), inner * i * (1 - g**2)])
                gx += wide[:, t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(axis=0)
                dx[:, t] += dz @ self.p[f"x{side}"].T
                dh, dc = np.where(m, dz @ self.p[f"h{side}"].T, dh), np.where(m, inner * forget, dc)
            grads |= {f"x{side}": gx, f"h{side}": gh, f"c{side}": gc}
        flat = dx[mask]
        for k, (ids, owner) in enumerate(((f.path, f.path_at), (f.word, f.word_at))):
            grads[("path", "word")[k]] = table = np.zeros((BUCKETS, SIZE), np.float32)
            counts = np.maximum(np.bincount(owner, minlength=len(flat)), 1)
            np.add.at(table, ids, flat[owner, k * SIZE : (k + 1) * SIZE] / counts[owner, None])
        return grads

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.01) -> Labeller:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(SEED)
        pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
        groups = [(Features([b for b, _ in pages[k : k + batch]]), np.concatenate([y for _, y in pages[k : k + batch]]).astype(np.float32)) for k in range(0, len(pages), batch)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                step += 1
                for k, grad in self.gradients(*groups[g]).items():
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad**2
                    self.p[k] = self.p[k] - np.float32(rate) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


# ---------------------------------------------------------------- training pages

#: Words that page designs use in class and id names, by part of the page.
NAMES = {
    "main": "content article post entry story text body main article-body post-content entry-content page-content".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topnav main-menu tabs".split(),
    "header": "header masthead site-header top branding banner-top".split(),
    "side": "sidebar side widget related related-posts rail recommended popular tags".split(),
    "advert": "ad ads advert advertisement sponsored promo banner sponsor".split(),
    "notice": "cookie cookies notice consent gdpr alert banner popup modal newsletter paywall".split(),
    "form": "form search subscribe login signup contact".split(),
    "comment": "comments comment discussion replies reply responses disqus comment-list".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
}
EXCLUDED = frozenset("nav header footer aside form script style button select head title noscript iframe dialog menu".split())


def by_mark_up(page: list[Block]) -> list[int]:
    """Labels of a page as it is: inside an article or main element, and in no part that the mark-up names otherwise."""
    other = {x for k, v in NAMES.items() if k != "main" for x in v}
    out = []
    for b in page:
        at = max((k for k, x in enumerate(b.path) if x in ("article", "main")), default=-1)
        out.append(int(at >= 0 and not (set(b.path) & EXCLUDED - {"header"}) and not any(w in other for x in b.path[at + 1 :] for w in x.split())))
    return out


def laid_out(paragraphs: list[str], short: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """One page in a design of its own: the article's paragraphs among other parts, with each block's label."""
    pick = lambda items: items[int(rng.integers(len(items)))]
    esc = lambda s: entities.escape(s, quote=False)
    mark = "\ue000"  # begins main blocks; taken off again

    def named(part: str, tags: list[str], inner: str) -> str:
        tag = pick(tags)
        name = pick(NAMES[part]) if rng.random() < 0.85 or tag == "div" and part != "main" else f"c{int(rng.integers(1000))}"
        attr = f' {pick(["class", "class", "id"])}="{name}"' if tag in ("div", "section", "ul") or rng.random() < 0.4 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    few = lambda low, high: [pick(short) for _ in range(int(rng.integers(low, high)))]
    links = lambda low, high: "<ul>" + "".join(f'<li><a href="/x">{esc(w)}</a></li>' for w in few(low, high)) + "</ul>"
    parts = {
        "menu": lambda: named("menu", ["nav", "nav", "div", "ul"], links(2, 9)),
        "header": lambda: named("header", ["header", "div"], f"<{pick(['h1', 'div', 'p'])}>{esc(pick(short))}</div><p>{esc(pick(short))}</p>"),
        "side": lambda: named("side", ["aside", "aside", "div", "section"], f"<h3>{esc(pick(short))}</h3>" + (links(2, 7) if rng.random() < 0.6 else f"<p>{esc(pick(paragraphs))}</p>")),
        "advert": lambda: named("advert", ["div", "aside", "section"], f"<{pick(['p', 'span', 'div'])}>{esc(pick(short + paragraphs[:1]))}</p>"),
        "notice": lambda: named("notice", ["div", "dialog", "section"], f"<p>{esc(pick(short + paragraphs))}</p><button>{esc(pick(short))}</button>"),
        "form": lambda: f"<form{pick(['', ' class=search', ' id=subscribe'])}><label>{esc(pick(short))}</label><input name=q><p>{esc(pick(short))}</p><button>{esc(pick(short))}</button></form>",
        "comment": lambda: named("comment", ["div", "section", "ol", "aside"], "".join(f'<{pick(["div", "li", "article"])} class="{pick(["comment", "reply", "response", "comment-body"])}"><b>{esc(pick(short))}</b><p>{esc(pick(paragraphs))}</p></div>' for _ in range(int(rng.integers(1, 5))))),
        "footer": lambda: named("footer", ["footer", "footer", "div"], f"<p>&copy; {esc(pick(short))}</p>" + (links(1, 5) if rng.random() < 0.4 else "")),
    }
    body = [f"<{pick(['h1', 'h1', 'h2'])}>{mark}{esc(pick(short))}</h1>"] if rng.random() < 0.85 else []
    for text in paragraphs:
        kind = rng.random()
        tag = "p" if kind < 0.8 else pick(["h2", "h3", "blockquote", "li", "div", "pre"])
        body.append(f"<ul><li>{mark}{esc(text)}</li></ul>" if tag == "li" else f"<{tag}>{mark}{esc(text)}</{tag}>")
        if rng.random() < 0.06:
            body.append(parts[pick(["advert", "form", "side", "notice"])]())
    main = named("main", ["article", "article", "main", "div", "div", "section"], "".join(body))
    if rng.random() < 0.3:
        main = f"<div class={pick(['wrapper', 'container', 'row', 'page', 'layout'])}>{main}</div>"
    before = [parts[k]() for k in ("menu", "header", "notice", "advert", "side", "form") if rng.random() < 0.45]
    after = [parts[k]() for k in ("comment", "side", "advert", "form", "notice", "menu") if rng.random() < 0.4]
    rng.shuffle(before)
    page = f"<html><head><title>{esc(pick(short))}</title></head><body>{''.join(before)}{main}{''.join(after)}{parts['footer']() if rng.random() < 0.8 else ''}</body></html>"
    found = blocks(page)
    labels = [int(b.text.startswith(mark)) for b in found]
    for b in found:
        b.text = b.text.removeprefix(mark).strip()
    return found, labels


def fit(pages: DataFrame, html_column: str = "html", sample: int = PAGES, layouts: int = LAYOUTS) -> Labeller:
    """A labeller trained on ``sample`` pages at most; the same pages make the same labeller."""
    known = pages.select(F.col(html_column).alias("html")).where("length(html) > 0")
    rows = known.select("html", F.xxhash64("html").alias("h")).orderBy("h").limit(sample).select("html").collect()
    real = [blocks(r[0]) for r in rows]
    examples = [(b, by_mark_up(b)) for b in real]
    rng = np.random.default_rng(SEED)
    texts = [[x.text for x, y in zip(b, lab, strict=True) if y] for b, lab in examples]
    texts = [t for t in texts if t] or [["Some text of a page."]]
    short = [x.text for b, lab in examples for x, y in zip(b, lab, strict=True) if not y] or ["Home"]
    short += [t[0] for t in texts if len(t[0]) < 200]
    for k in range(layouts):
        examples.append(laid_out(texts[k % len(texts)][: int(rng.integers(1, 12))], short, rng))
    return Labeller().train(examples)


def main_text(pages: DataFrame, model: Labeller, html: Column, threshold: float = 0.5) -> Column:
    """Main blocks of each page, joined by line feeds."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def extract(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            out: list[str] = []
            for row in range(0, len(batch), 128):
                parsed = [blocks(p.as_py()) for p in batch[row : row + 128]]
                scores = sent.value.score(Features(parsed)) >= threshold
                at = 0
                for page in parsed:
                    out.append("\n".join(b.text for b, keep in zip(page, scores[at : at + len(page)], strict=True) if keep))
                    at += len(page)
            yield pa.array(out, pa.string())

    return extract(html)


def extract_pages(pages: DataFrame, model: Labeller | None = None, html_column: str = "html") -> DataFrame:
    """All columns of ``pages`` and ``main_text``, which replaces a column of that name. Repeated rows are extracted each; an empty table needs no model."""
    return pages.withColumn("main_text", main_text(pages, model or fit(pages, html_column), F.col(html_column)))
