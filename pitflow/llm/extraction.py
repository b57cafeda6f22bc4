"""Main text of HTML pages by a recurrent block labeller.

A bidirectional LSTM in numpy reads each page's blocks in order, every block as
its hashed tag path, its hashed words and a few measures, and labels all of
them with the whole page in view. Nobody labels pages by hand: the network
learns from synthetic pages, whose parts are known, and from real ones whose
elements say what they are.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitflow.llm.pages import Block, Node, blocks_of

PATH, WORDS, MEASURES = 256, 32, 8
INPUT = PATH + WORDS + MEASURES
HIDDEN = 16
#: Real pages that the network learns from at most, and the longest of them.
TRAIN_PAGES, TRAIN_LENGTH = 200, 200_000
SYNTHETIC, EPOCHS, BATCH, RATE, SEED = 700, 14, 32, 0.01, 11
#: Blocks of a training sequence; longer pages give several.
TRAIN_BLOCKS = 120
#: Blocks that a task labels at once; a longer page comes alone, in stretches.
LABEL_BLOCKS = 8192

# Names on tag paths that tell what a part of a page is.
ASIDE_NAMES = (
    "nav menu navbar navigation breadcrumb breadcrumbs header masthead banner topbar footer bottom copyright "
    "aside sidebar widget related recommended ad ads advert advertisement sponsor sponsored promo promotion "
    "notice cookie cookies consent gdpr alert popup modal overlay form search login signup subscribe newsletter "
    "comment comments respond reply replies discussion disqus share social toolbar pagination pager tags "
    "legal disclaimer contentinfo complementary"
).split()
ASIDE_TAGS = "nav header footer aside form button select option textarea label noscript template title dialog iframe".split()
MAIN_TAGS = {"tag article", "tag main"}
MAIN_NAMES = "content article post entry story main body text maincontent prose page".split()


@lru_cache(1 << 16)
def _path_slots(name: str) -> tuple[int, int]:
    h = zlib.crc32(name.encode("utf-8", "replace"))
    return h % PATH, (h >> 12) % PATH


class PathSlots:
    """The slots of the names on an element's path, as the bits of one number. An
    element adds its own names to its parent's number, so a deep path costs no
    more than a short one."""

    def __init__(self):
        self.known: dict[int, int] = {}

    def of(self, element: Node | None) -> np.ndarray:
        pending = []
        while element is not None and id(element) not in self.known:
            pending.append(element)
            element = element.parent
        bits = self.known[id(element)] if element is not None else 0
        for node in reversed(pending):
            for name in node.names:
                for slot in _path_slots(name):
                    bits |= 1 << slot
            self.known[id(node)] = bits
        return np.unpackbits(np.frombuffer(bits.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")


def features(blocks: Sequence[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """One row of INPUT numbers for each of ``blocks[start:stop]``, a page's blocks."""
    n, paths = len(blocks), PathSlots()
    part = blocks[start:stop]
    out = np.zeros((len(part), INPUT), dtype=np.float32)
    for i, block in enumerate(part, start):
        row, text = out[i - start], block.text
        row[:PATH] = paths.of(block.element)
        row[list(_path_slots(block.leaf))] = 1
        words = text.split(" ")
        slots = np.fromiter(
            (zlib.crc32(w.lower().encode("utf-8", "replace")) for w in words), np.uint32, len(words)
        )
        row[PATH : PATH + WORDS] = np.bincount(slots % WORDS, minlength=WORDS) / len(words)
        size = len(text)
        row[PATH + WORDS :] = (
            np.log1p(len(words)) / 4,
            np.log1p(size) / 8,
            block.link_share,
            (text.count(".") + text.count(",")) * 10 / size,
            text[-1] in ".!?:",
            i / n,
            i == 0,
            i == n - 1,
        )
    return out


class BiLSTM:
    """Two LSTMs over a sequence, one in each direction, and a logistic output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["W" + d] = (r.standard_normal((INPUT, 4 * HIDDEN)) / np.sqrt(24)).astype(np.float32)
            self.p["U" + d] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.p["b" + d] = np.zeros(4 * HIDDEN, np.float32)
            self.p["b" + d][HIDDEN : 2 * HIDDEN] = 1
        self.p["V"] = (r.standard_normal((2 * HIDDEN, 1)) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool, state=None) -> tuple[np.ndarray, list, tuple]:
        """Outputs (n, t, HIDDEN), and the state after them; x and mask already in
        reading order. Padding carries the state on unchanged."""
        p, h_ = self.p, HIDDEN
        n, t, _ = x.shape
        z_in = x @ p["W" + d] + p["b" + d]
        h, c = state or (np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32))
        out, trace = np.empty((n, t, h_), np.float32), []
        for s in range(t):
            z = z_in[:, s] + h @ p["U" + d]
            gate = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h_], -30, 30)))
            i, f, o = gate[:, :h_], gate[:, h_ : 2 * h_], gate[:, 2 * h_ :]
            g = np.tanh(z[:, 3 * h_ :])
            m = mask[:, s, None]
            new_c = f * c + i * g
            tc = np.tanh(new_c)
            if keep:
                trace.append((h, c, i, f, o, g, tc, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[:, s] = h
        return out, trace, (h, c)

    def _back(self, d: str, x: np.ndarray, trace: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        p, h_ = self.p, HIDDEN
        n, t, _ = x.shape
        dz_all = np.zeros((n, t, 4 * h_), np.float32)
        du = np.zeros_like(p["U" + d])
        dh, dc = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
        for s in range(t - 1, -1, -1):
            h, c, i, f, o, g, tc, m = trace[s]
            dh = dh + d_out[:, s]
            dh_new, dc_new = dh * m, dc * m
            dc_in = dc_new + dh_new * o * (1 - tc * tc)
            dz = np.concatenate(
                [dc_in * g * i * (1 - i), dc_in * c * f * (1 - f), dh_new * tc * o * (1 - o), dc_in * i * (1 - g * g)],
                axis=1,
            )
            dz_all[:, s] = dz
            du += h.T @ dz
            dh = dz @ p["U" + d].T + dh * (1 - m)
            dc = dc_in * f + dc * (1 - m)
        flat = dz_all.reshape(n * t, -1)
        return {"W" + d: x.reshape(n * t, -1).T @ flat, "U" + d: du, "b" + d: flat.sum(axis=0)}

    @staticmethod
    def _padded(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(map(len, rows))
        x = np.zeros((len(rows), t, INPUT), np.float32)
        mask = np.zeros((len(rows), t), np.float32)
        for k, r in enumerate(rows):
            x[k, : len(r)], mask[k, : len(r)] = r, 1
        return x, mask

    def outputs(self, rows: Sequence[np.ndarray], keep: bool = False):
        x, mask = self._padded(rows)
        forward, trace_f, _ = self._run("f", x, mask, keep)
        backward, trace_b, _ = self._run("b", x[:, ::-1], mask[:, ::-1], keep)
        both = np.concatenate([forward, backward[:, ::-1]], axis=2)
        logit = (both @ self.p["V"])[:, :, 0] + self.p["c"]
        return logit, (x, mask, both, trace_f, trace_b)

    def label(self, rows: Sequence[np.ndarray]) -> list[np.ndarray]:
        """True for main text, per block of each sequence."""
        logit, _ = self.outputs(rows)
        return [logit[k, : len(r)] > 0 for k, r in enumerate(rows)]

    def label_page(self, blocks: Sequence[Block]) -> np.ndarray:
        """The same for one page of any length, its features made stretch by
        stretch, once in each direction, with the state carried over."""
        starts = range(0, len(blocks), LABEL_BLOCKS)
        logit = np.full(len(blocks), self.p["c"][0], np.float32)
        for d, weight, stretches in (("f", self.p["V"][:HIDDEN], starts), ("b", self.p["V"][HIDDEN:], reversed(starts))):
            state, turn = None, 1 if d == "f" else -1
            for start in stretches:
                x = features(blocks, start, start + LABEL_BLOCKS)[None, ::turn]
                out, _, state = self._run(d, x, np.ones(x.shape[:2], np.float32), False, state)
                logit[start : start + LABEL_BLOCKS] += (out[0, ::turn] @ weight)[:, 0]
        return logit > 0

    def fit(self, rows: Sequence[np.ndarray], truth: Sequence[np.ndarray], epochs: int = EPOCHS) -> None:
        """Adam on the mean log loss of the blocks of each batch."""
        r = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, step = np.argsort([len(x) for x in rows], kind="stable"), 0
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + RATE / 50
            for k in r.permutation(len(batches)):
                picked = batches[k]
                logit, (x, mask, both, trace_f, trace_b) = self.outputs([rows[i] for i in picked], keep=True)
                y = np.zeros_like(logit)
                for j, i in enumerate(picked):
                    y[j, : len(truth[i])] = truth[i]
                d_logit = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * mask / mask.sum())[:, :, None]
                grads = {"V": np.einsum("nth,nto->ho", both, d_logit), "c": d_logit.sum(axis=(0, 1))}
                d_both = d_logit @ self.p["V"].T
                grads |= self._back("f", x, trace_f, d_both[:, :, :HIDDEN])
                grads |= self._back("b", x[:, ::-1], trace_b, d_both[:, ::-1, HIDDEN:])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                for name, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    fixed = np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8
                    self.p[name] -= (rate * first[name] / (1 - 0.9**step) / fixed).astype(np.float32)


def known_labels(blocks: Sequence[Block]) -> np.ndarray | None:
    """What the elements of a page themselves say, None if they don't: inside
    article or main and in no aside part of it is main text, all else is not."""
    aside = {f"is {n}" for n in ASIDE_NAMES} | {f"tag {t}" for t in ASIDE_TAGS}
    paths = [set(b.element.path()) if b.element else set() for b in blocks]
    if not any(MAIN_TAGS & path for path in paths):
        return None
    return np.array([bool(MAIN_TAGS & path) and not aside & path for path in paths], dtype=np.float32)


def written(text: str, path: tuple[str, ...], link_share: float) -> Block:
    """A block below the names of ``path``, the last of which is its leaf."""
    tag = path[-1][len("leaf ") :]
    return Block(text, Node(tag, path[:-1]) if tag else None, link_share)


class _Writer:
    """Synthetic pages: parts in usual and unusual elements, with their labels."""

    def __init__(self, texts: Sequence[str], seed: int):
        self.random, self.texts = random.Random(seed), list(texts)

    def words(self, low: int, high: int) -> str:
        n = self.random.randint(low, high)
        if self.texts and self.random.random() < 0.7:
            words = self.random.choice(self.texts).split()
            at = self.random.randrange(len(words))
            words = (words[at:] + words)[:n]
        else:
            words = ["".join(self.random.choices("etaoinshrdlu", k=self.random.randint(1, 9))) for _ in range(n)]
        return " ".join(words)

    def sentences(self) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.random.choice(". . . . ! ?".split()) for _ in range(self.random.randint(1, 5)))

    def names(self, name: str) -> tuple[str, ...]:
        pick = self.random.random()
        extra = self.random.choice(["box", "wrap", "inner", "site", "block", "list", "item", "top", "col", "row"])
        return (f"is {name}",) if pick < 0.5 else (f"is {name}", f"is {extra}") if pick < 0.85 else (f"is {extra}", f"is {name}")

    def aside(self, path: tuple[str, ...]) -> list[tuple[Block, int]]:
        r = self.random
        if r.random() < 0.45:
            tag = r.choice(["nav", "header", "footer", "aside", "form", "noscript", "button"])
            own = (f"tag {tag}",) + (self.names(r.choice(ASIDE_NAMES)) if r.random() < 0.4 else ())
        else:
            own = (f"tag {r.choice(['div', 'section', 'div', 'ul', 'p'])}",) + self.names(r.choice(ASIDE_NAMES))
        base, out = path + own, []
        for _ in range(r.choice([1, 1, 2, 4, 7])):
            kind = r.random()
            if kind < 0.4:
                at, text, link = base + ("tag ul", "tag li", "leaf li"), self.words(1, 4), r.choice([1.0, 1.0, 0.0])
            elif kind < 0.75:
                at, text, link = base + ("tag p", "leaf p"), self.sentences(), 0.0
            else:
                at, text, link = base + ("leaf " + own[0][4:],), r.choice([self.words(2, 12), self.sentences()]), r.choice([0.0, 0.3])
            out.append((written(text, at, link), 0))
        return out

    def main(self, path: tuple[str, ...]) -> list[tuple[Block, int]]:
        r = self.random
        pick = r.random()
        if pick < 0.08:
            own = ()
        elif pick < 0.5:
            own = ("tag article",)
        elif pick < 0.65:
            own = ("tag main",) + (("tag article",) if r.random() < 0.4 else ())
        else:
            own = (f"tag {r.choice(['div', 'section', 'td'])}",) + self.names(r.choice(MAIN_NAMES))
        if r.random() < 0.2:
            own += ("tag div",) + self.names(r.choice(MAIN_NAMES))
        base, out = path + own, []
        if r.random() < 0.8:
            out.append((written(self.words(2, 12), base + ("tag h1", "leaf h1"), 0.0), 1))
        for _ in range(r.choice([1, 2, 3, 5, 9, 20])):
            tag = r.choices(["p", "h2", "li", "blockquote", "pre", "td", "figcaption"], [12, 1, 1, 1, 0.5, 0.5, 0.5])[0]
            text = self.words(1, 8) if tag == "h2" else self.words(1, 40) if r.random() < 0.3 else self.sentences()
            inner = ("tag ul",) if tag == "li" else ("tag table", "tag tr") if tag == "td" else ()
            out.append((written(text, base + inner + (f"tag {tag}", f"leaf {tag}"), r.choice([0.0] * 6 + [0.2, 0.9])), 1))
            if r.random() < 0.05:
                out += self.aside(base)
        return out

    def page(self) -> tuple[list[Block], np.ndarray]:
        r = self.random
        if r.random() < 0.04:  # text with hardly any markup
            tags = r.choice([(), ("tag p",)])
            leaf = f"leaf {tags[0][4:]}" if tags else "leaf"
            blocks = [written(self.sentences(), (*tags, leaf), 0.0) for _ in range(r.choice([1, 1, 2, 4]) if tags else 1)]
            return blocks, np.ones(len(blocks), dtype=np.float32)
        body = ("tag html", "tag body") + (("tag div",) + self.names("page") if r.random() < 0.2 else ())
        parts = [(written(self.words(2, 12), ("tag html", "tag head", "tag title", "leaf title"), 0.0), 0)]
        for _ in range(r.choice([0, 1, 2, 3])):
            parts += self.aside(body)
        parts += self.main(body)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            parts += self.aside(body)
        return [b for b, _ in parts], np.array([y for _, y in parts], dtype=np.float32)


def learned(real: Sequence[str]) -> BiLSTM:
    """The network that these pages and the synthetic ones teach."""
    pages = []
    for page in real:
        blocks = blocks_of(page)
        truth = known_labels(blocks)
        if truth is not None:
            pages.append((blocks, truth))
    texts = [b.text for blocks, truth in pages for b, y in zip(blocks, truth) if y]
    writer = _Writer(texts[:5000], SEED)
    pages += [writer.page() for _ in range(SYNTHETIC)]
    rows, labels = [], []
    for blocks, truth in pages:
        x = features(blocks)
        for a in range(0, len(x), TRAIN_BLOCKS):
            rows.append(x[a : a + TRAIN_BLOCKS])
            labels.append(truth[a : a + TRAIN_BLOCKS])
    network = BiLSTM()
    network.fit(rows, labels)
    return network


def main_texts(network: BiLSTM, pages: Sequence[str | None]) -> list[str]:
    """The main text of each page: its blocks labelled so, with two \\n between."""
    blocks = [blocks_of(p) for p in pages]
    found = [""] * len(blocks)
    order = [i for i in np.argsort([len(b) for b in blocks], kind="stable") if blocks[i]]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(blocks[order[end]]) <= LABEL_BLOCKS:
            end += 1
        batch = order[at:end]
        if len(blocks[batch[0]]) > LABEL_BLOCKS:
            kept = [network.label_page(blocks[batch[0]])]
        else:
            kept = network.label([features(blocks[i]) for i in batch])
        for i, keep in zip(batch, kept):
            found[i] = "\n\n".join(b.text for b, k in zip(blocks[i], keep) if k)
        at = end
    return found


def extracted(network: BiLSTM) -> Callable[[Column], Column]:
    """A column function: html -> main text."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series(main_texts(network, pages.tolist()), dtype=object)

    return extract


def learn(pages: DataFrame) -> BiLSTM:
    """Learned from TRAIN_PAGES different pages at most, those with the lowest
    hash of their html among pages of up to TRAIN_LENGTH characters. Hashes are
    picked first, so no task sends the driver pages that are not learned from."""
    short = pages.where((F.col("html") != "") & (F.length("html") <= TRAIN_LENGTH)).select(
        "html", F.xxhash64("html").alias("h")
    )
    lowest = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).collect()]
    if not lowest:
        return learned([])
    picked = short.where(F.col("h") <= lowest[-1]).groupBy("h").agg(F.min("html").alias("html"))
    return learned([r["html"] for r in picked.orderBy("h").collect()])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null html counts as empty; a page without main text gets an empty text.
    Repeated rows and null ids or urls come back as they are. Empty tables give
    no rows; other columns are not read.
    """
    found = pages.select("page_id", "url", extracted(learn(pages))("html").alias("text"))
    return found.select("*", F.char_length("text").cast("long").alias("n_chars"))
