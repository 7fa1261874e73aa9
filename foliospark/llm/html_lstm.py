"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the runs of text between block-level tags, each with its path of open elements. A block's vector
holds the hashed path (tags with their class, id and role names), its hashed words and a few counts. A bidirectional
LSTM, written in numpy, reads the vectors of a page from both ends, so that a block is judged with all of the page before and
after it; a logistic output marks the blocks of the main text, which are joined in page order.

Training: there are no labels, so pages are made whose parts are known: the texts of a bounded sample of pages (`SAMPLE`)
are put into drawn layouts with menus, headers, footers, sidebars, notices, adverts, forms and reader comments, under many
usual names and in plain and semantic markup. The draw is seeded; the model is the same for the same sample.

Scale: fitting reads the sample only; extraction is a narrow map without a shuffle, pages of a batch are labelled in
step, sorted by their number of blocks; the model (some 60,000 numbers) is broadcast.

Defined cases: null or empty pages and pages without main text give the empty string; text outside any element is a block;
unclosed and stray tags, quoted attributes with angle brackets and a head without its end are read as browsers do; repeated pages give repeated rows; all columns are kept, columns named like
an output are replaced; an empty table gives an empty result (and an untrained model is never asked).
"""

from __future__ import annotations

import html
import io
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_long_rows, mapped
from .markup import attributes, shown

#: Pages whose words are used for training, at most; layouts drawn; passes over them.
SAMPLE, LAYOUTS, EPOCHS, SEED = 200, 3000, 7, 11
PATH, WORDS, COUNTS, HIDDEN = 256, 32, 8, 24
FEATURES = PATH + WORDS + COUNTS
#: Blocks of a chunk of pages that are labelled in step.
STEP_BLOCKS = 40_000

#: Fixed values of HTML. Other content that isn't shown is left out by markup.shown.
UNSHOWN = ("head", "noscript", "template", "svg", "object")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr".split())
NAMED = frozenset(("class", "id", "role", "aria-label"))
PART = re.compile(r"[a-z]+")


def blocks_of(page: str | None) -> list[tuple[str, np.ndarray, int]]:
    """(text, path counts, characters inside links) of the leaf blocks in page order; white space is one space, no block is empty.

    The counts of the open elements are kept up tag by tag, so that the work is linear in the page, however deep it is.
    """
    out: list[tuple[str, np.ndarray, int]] = []
    stack: list[tuple[str, list[int]]] = []
    open_tags: Counter[str] = Counter()
    counts = np.zeros(PATH, np.int32)
    pieces: list[str] = []
    linked = depth = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append((text, np.minimum(counts, 2).astype(np.uint8), min(linked, len(text))))
        pieces.clear()
        linked = 0

    def pop() -> str:
        tag, buckets = stack.pop()
        open_tags[tag] -= 1
        for k in buckets:
            counts[k] -= 1
        return tag

    for text, tag, rest in shown(page, UNSHOWN):
        if text:
            pieces.append(text)
            linked += len(text) if depth else 0
        if not tag:
            continue
        ends, tag = tag[0] == "/", tag.lstrip("/")
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                depth = max(0, depth + (-1 if ends else 1))
            continue
        close()
        if ends:
            if open_tags[tag]:
                while pop() != tag:
                    pass
        elif tag not in VOID and not rest.endswith("/"):
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and (stack[-1][0] == tag or tag != "li" and stack[-1][0] == "p"):
                pop()
            names = [tag, *(f"{tag}.{part}" for name, value in attributes(rest) if name in NAMED for part in PART.findall(value.lower()))]
            stack.append((tag, path_buckets(names)))
            open_tags[tag] += 1
            for k in stack[-1][1]:
                counts[k] += 1
        depth = depth if tag == "li" else 0
    close()
    return out


class _Buckets(dict):
    """Word to its hashed bucket and sign."""

    def __init__(self, size: int, seed: str):
        super().__init__()
        self.size, self.seed = size, seed

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = zlib.crc32((self.seed + word).encode()) % self.size
        return found


_PATHS, _NAMES, _WORDS = _Buckets(PATH, "path "), _Buckets(PATH, "name "), _Buckets(WORDS, "word ")


def path_buckets(names) -> list[int]:
    """The buckets that tag and class names count in: a name with its tag, and alone."""
    return [k for name in names for k in ((_PATHS[name], _NAMES[name.partition(".")[2]]) if "." in name else (_PATHS[name],))]


def vectors(blocks: list[tuple[str, np.ndarray, int]]) -> np.ndarray:
    """(blocks, FEATURES) of one page."""
    out = np.zeros((len(blocks), FEATURES), np.float32)
    n = len(blocks)
    for k, (text, path, linked) in enumerate(blocks):
        row = out[k]
        row[:PATH] = path
        words = text.split()
        row[PATH : PATH + WORDS] = np.bincount(list(map(_WORDS.__getitem__, words)), minlength=WORDS) / len(words)
        size = len(text)
        row[PATH + WORDS :] = (np.log1p(size) / 8, np.log1p(len(words)) / 6, linked / size, (text.count(".") + text.count(",")) / len(words), k / n, 1 - k / n, size / len(words) / 10, text[-1] in ".!?:")
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs over a page's blocks, one from each end, and a logistic output. Sequences are padded and masked."""

    def __init__(self, rng: np.random.Generator | None = None, weights: dict[str, np.ndarray] | None = None):
        if weights is not None:
            self.w = weights
            return
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {f"{d}{k}": v for d in "fb" for k, v in (("x", draw(FEATURES, 4 * HIDDEN)), ("h", draw(HIDDEN, 4 * HIDDEN)), ("c", np.zeros(4 * HIDDEN, np.float32)))}
        for d in "fb":
            self.w[d + "c"][HIDDEN : 2 * HIDDEN] = 1
        self.w |= {"out": draw(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: (steps, pages, FEATURES) in reading order of this direction."""
        steps, pages, _ = x.shape
        projected = (x.reshape(-1, FEATURES) @ self.w[d + "x"] + self.w[d + "c"]).reshape(steps, pages, -1)
        h = c = np.zeros((pages, HIDDEN), np.float32)
        states, memory = np.empty((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            z = projected[t] + h @ self.w[d + "h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            before = (h, c)
            c = np.where(on, f * c + i * g, c)
            tc = np.tanh(c)
            h = np.where(on, o * tc, h)
            states[t] = h
            if keep:
                memory.append((before, i, f, o, g, tc, on))
        return states, memory

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of main text, (steps, pages); padding stands at the end."""
        ahead, _ = self._run("f", x, mask, False)
        back, _ = self._run("b", x[::-1], mask[::-1], False)
        return _sigmoid(np.concatenate([ahead, back[::-1]], 2) @ self.w["out"] + self.w["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, by backpropagation through time."""
        ahead, seen = self._run("f", x, mask, True)
        back, seen_back = self._run("b", x[::-1], mask[::-1], True)
        both = np.concatenate([ahead, back[::-1]], 2)
        error = ((_sigmoid(both @ self.w["out"] + self.w["bias"]) - y) * mask / mask.sum()).astype(np.float32)
        grads = {"out": np.tensordot(error, both, ((0, 1), (0, 1))), "bias": error.sum(keepdims=True)[0]}
        to_state = error[:, :, None] * self.w["out"]
        for d, memory, xs, dh_out in (("f", seen, x, to_state[:, :, :HIDDEN]), ("b", seen_back, x[::-1], to_state[::-1, :, HIDDEN:])):
            wh = self.w[d + "h"]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros_like(memory[0][0][0])
            gh = np.zeros_like(wh)
            for t in range(len(memory) - 1, -1, -1):
                (h0, c0), i, f, o, g, tc, on = memory[t]
                dh = dh + dh_out[t]
                dct = np.where(on, dc + dh * o * (1 - tc * tc), 0)
                dz = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), np.where(on, dh * tc, 0) * o * (1 - o), dct * i * (1 - g * g)], 1)
                dz_all[t] = dz
                gh += h0.T @ dz
                dh, dc = np.where(on, dz @ wh.T, dh), np.where(on, dct * f, dc)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grads |= {d + "x": xs.reshape(-1, FEATURES).T @ flat, d + "h": gh, d + "c": flat.sum(0)}
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), FEATURES), np.float32), np.zeros((steps, len(pages)), bool)
    for k, v in enumerate(pages):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


#: Usual names of page parts, for the drawn layouts.
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav tabs pagination toc",
    "header": "header masthead banner topbar site branding logo",
    "footer": "footer bottom colophon copyright legal sitefooter",
    "aside": "sidebar aside related widget recommended popular trending more teaser",
    "notice": "cookie notice consent gdpr alert newsletter popup modal privacy subscribe",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner adsbox",
    "form": "form search login signup contact",
    "comments": "comments comment discussion replies reply responses disqus",
    "main": "content main article post entry story body text",
}
_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "notice": "div", "ad": "div", "form": "form", "comments": "section"}


def draw_layout(rng: np.random.Generator, texts: list[list[str]]) -> list[tuple[tuple[str, ...], str, int, bool]]:
    """(path, text, characters in links, is main) of the blocks of one made page."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    name = lambda part: pick(NAMES[part].split())
    source = pick(texts)
    words = " ".join(pick(texts)).split() or ["text"]

    def some(low: int, high: int) -> str:
        n, at = int(rng.integers(low, high)), int(rng.integers(len(words)))
        return " ".join(words[at : at + n]) or words[0]

    def named(tag: str, part: str, sure: bool = False) -> tuple[str, ...]:
        return (tag, f"{tag}.{name(part)}", *((f"{tag}.{name(part)}",) if rng.random() < 0.3 else ())) if sure or rng.random() < 0.4 else (tag,)

    outer = ("html", "body", *(named("div", "main")[:1] * int(rng.integers(0, 3))))
    wrap = outer + pick([("article",), ("main", "article"), named("div", "main", True), ("main",), named("article", "main", True), ("section", *named("div", "main", True)), ("div", "article")])

    def part(kind: str, inside: tuple[str, ...]) -> list:
        semantic = rng.random() < 0.6 and _TAGS[kind] not in ("div",)
        path = inside + (named(_TAGS[kind], kind) if semantic else named(pick(["div", "section", "ul", "p"]) if kind != "form" else "form", kind, True))
        if kind == "nav":
            return [(path + ("ul", "li"), t, len(t), False) for t in (some(1, 4) for _ in range(int(rng.integers(2, 9))))]
        if kind == "aside":
            rows = [(path + ("h3",), some(1, 4), 0, False)] if rng.random() < 0.5 else []
            for _ in range(int(rng.integers(1, 5))):
                t = some(2, 30)
                rows.append((path + pick([("ul", "li"), ("p",), ("div",), ()]), t, len(t) if rng.random() < 0.6 else 0, False))
            return rows
        if kind == "comments":
            return [(path + pick([("p",), ("div", "div.comment", "p"), ("ul", "li"), ("article", "p"), ("h3",)]), some(2, 60), 0, False) for _ in range(int(rng.integers(1, 6)))]
        n = int(rng.integers(1, 4 if kind in ("footer", "header", "form") else 2))
        return [(path + pick([(), ("p",), ("div",), ("ul", "li")]), some(1, 40), 0, False) for _ in range(n)]

    rows = []
    for kind, odds in (("notice", 0.25), ("header", 0.4), ("nav", 0.8), ("form", 0.15), ("ad", 0.5), ("aside", 0.2)):
        if rng.random() < odds:
            rows += part(kind, outer)
    body = [t for t in source if t]
    if rng.random() < 0.15:  # worn and broken pages: very short blocks, the same words again and again
        body = [some(1, 3) if rng.random() < 0.6 else " ".join([some(1, 2)] * int(rng.integers(1, 60))) for _ in range(int(rng.integers(1, 25)))]
    if rng.random() < 0.85:
        title = some(1, 14)
        rows.append((wrap + pick([("h1",), ("h2",), ("header", "h1")]), title, 0, True))
    for k, t in enumerate(body):
        rows.append((wrap + pick([("p",)] * 12 + [("blockquote", "p"), ("ul", "li"), ("h2",), ("div",), ("table", "tr", "td"), ("pre",), ("h3",)]), t, len(t) if rng.random() < 0.02 else 0, True))
        if rng.random() < 0.05 and k < len(body) - 1:
            rows += part(pick(["ad", "aside", "notice", "form"]), wrap)
    if rng.random() < 0.25:
        rows += part("comments", pick([outer, wrap]))
    for kind, odds in (("aside", 0.35), ("ad", 0.2), ("comments", 0.2), ("form", 0.1), ("nav", 0.15), ("footer", 0.85), ("notice", 0.1)):
        if rng.random() < odds:
            rows += part(kind, outer)
    return rows


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE, layouts: int = LAYOUTS, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights of a BiLstm, from at most `sample` pages (the first by the hash of id_col)."""
    chosen = pages.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(html_col).alias("page")).orderBy("h", "page").limit(sample)
    for_long_rows(pages.sparkSession)

    def train(batches):
        texts = []
        for batch in batches:
            texts += [found for p in batch.column("page").to_pylist() if (found := [t for t, _, linked in blocks_of(p) if len(t) > 20 and not linked][:40])]
        held = io.BytesIO()
        np.savez(held, **fit_texts(texts or [["some text of a page."]], layouts, epochs, seed))
        yield pa.RecordBatch.from_pydict({"weights": [held.getvalue()]})

    done = chosen.coalesce(1).mapInArrow(train, "weights binary").first()  # the sample is bounded: one task, one row
    return dict(np.load(io.BytesIO(done.weights)).items())


def fit_texts(texts: list[list[str]], layouts: int = LAYOUTS, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(layouts):
        rows = draw_layout(rng, texts)
        if rows:
            made.append((vectors([(t, np.minimum(np.bincount(path_buckets(p), minlength=PATH), 2), n) for p, t, n, _ in rows]), np.array([m for *_, m in rows], np.float32)))
    made.sort(key=lambda r: len(r[0]))
    model = BiLstm(rng)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    batches = [made[k : k + 25] for k in range(0, len(made), 25)]
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            x, mask = padded([v for v, _ in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, labels) in enumerate(batches[k]):
                y[: len(labels), j] = labels
            step += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for name, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.w[name] = (model.w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model.w


def extract_batch(model: BiLstm, pages: list[str | None]) -> list[str]:
    cut = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if cut[k]), key=lambda k: len(cut[k]))
    while order:
        group, size = [], 0
        while order and (not group or (len(group) + 1) * len(cut[order[-1]]) <= STEP_BLOCKS and len(group) < 512):
            group.append(order.pop(0))
            size = len(cut[group[-1]])
            if order and (len(group) + 1) * len(cut[order[0]]) > STEP_BLOCKS:
                break
        x, mask = padded([vectors(cut[k]) for k in group])
        marks = model.scores(x, mask)
        for j, k in enumerate(group):
            out[k] = "\n".join(text for (text, _, _), p in zip(cut[k], marks[:, j], strict=False) if p >= 0.5)
    return out


_MODELS: dict[str, BiLstm] = {}


def _model(name: str, sent) -> BiLstm:
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = BiLstm(weights=sent.value)
    return _MODELS[name]


def extract(pages: DataFrame, weights: dict[str, np.ndarray], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col: the main text of the whole page."""
    sent, name = pages.sparkSession.sparkContext.broadcast(weights), uuid.uuid4().hex
    return mapped(pages, html_col, text_col, "string", lambda values: extract_batch(_model(name, sent), values))
