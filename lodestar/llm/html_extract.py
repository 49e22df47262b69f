"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is read as the mean vector of its tag path (tags, and words of classes and ids), the mean vector of its
hashed words, and a few lengths. A bidirectional LSTM in numpy runs over the whole page and labels
every block as text or chrome, so a block is judged with all others in view. The labeller is trained on the
driver on a fixed number of made-up pages (``TRAIN_PAGES``, a documented bound) and sent to the tasks; its size is fixed by ``Shape``.

Scripts, styles, comments and the head hold no blocks. Character references are decoded, white space inside a block becomes one space (``br`` too), and blocks are joined
by one newline. Null or empty html gives an empty text. Repeated rows and null ids keep a row each; other columns don't matter. An empty table gives none.
Pages are worked on in chunks of bounded size, a longer one alone; besides its blocks it takes about 400 bytes for each of them.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .html_blocks import Block, PageMaker, blocks

TRAIN_PAGES, EPOCHS, BATCH, SEED = 1500, 6, 25, 11
#: Words whose hash is remembered.
KNOWN_WORDS = 1 << 19
NUMBERS = 8
#: Blocks, padding included, that are run together; and steps whose input is multiplied at a time.
PLACES, STEPS = 4096, 256
#: Characters of pages that are cut into blocks at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Shape:
    paths: int = 1024
    words: int = 4096
    wide: int = 16
    hidden: int = 24


class _Slots(dict):
    """Slot of a word; remembered."""

    def __init__(self, slots: int):
        super().__init__()
        self.slots = slots

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = n = zlib.crc32(word.encode()) % self.slots
        return n


def numbers(page: list[Block]) -> np.ndarray:
    """Lengths and shares of each block."""
    out = np.zeros((len(page), NUMBERS), np.float32)
    for i, b in enumerate(page):
        n, words = len(b.text), b.text.count(" ") + 1
        ends = b.text.count(". ") + b.text.count(", ") + (b.text[-1] in ".!?")
        out[i] = (np.log1p(n) / 5, np.log1p(words) / 4, min(1.0, b.linked / n), min(1.0, ends / words), b.text[-1] in ".!?", "©" in b.text, i / len(page), len(b.path) / 8)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTMs and a logistic layer, with training by back-propagation through time."""

    def __init__(self, shape: Shape = Shape(), seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, h = 2 * shape.wide + NUMBERS, shape.hidden
        self.shape, self.paths, self.words, self.known = shape, _Slots(shape.paths), _Slots(shape.words), {}
        make = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.w = {"path": rng.normal(0, 0.3, (shape.paths, shape.wide)).astype(np.float32), "word": rng.normal(0, 0.3, (shape.words, shape.wide)).astype(np.float32), "out": make(2 * h, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        for k in "fb":
            self.w |= {f"x{k}": make(d, 4 * h), f"h{k}": make(h, 4 * h), f"b{k}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}

    def __getstate__(self):
        return {"shape": self.shape, "w": self.w}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.paths, self.words, self.known = _Slots(self.shape.paths), _Slots(self.shape.words), {}

    def slots(self, page: list[Block]) -> tuple[np.ndarray, ...]:
        """Slots of path marks and of words, with the end of each block in either."""
        marks = [self._path(b.path) for b in page]
        words = [list(map(self.words.__getitem__, b.text.split())) for b in page]
        return tuple(x for part in (marks, words) for x in (np.array([s for p in part for s in p], np.int64), np.cumsum([len(p) for p in part])))

    def _path(self, path: tuple[str, ...]) -> list[int]:
        if len(self.known) > KNOWN_WORDS // 16:
            self.known.clear()
        if path not in self.known:
            self.known[path] = [self.paths[m] for m in (*path, "/".join(path[-2:]))]
        return self.known[path]

    @staticmethod
    def _means(table: np.ndarray, slot: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], ends[:-1]])
        return np.add.reduceat(table[slot], starts, axis=0) / (ends - starts)[:, None]

    def inputs(self, page: list[Block], slots: tuple[np.ndarray, ...]) -> np.ndarray:
        a, b, c, d = slots
        return np.concatenate([self._means(self.w["path"], a, b), self._means(self.w["word"], c, d), numbers(page)], axis=1)

    def _run(self, x: np.ndarray, k: str, learn: bool) -> tuple[np.ndarray, list]:
        """One direction over (time, page, input); padding stands at the end of its time. Gates are kept only to learn from them."""
        n, h = x.shape[1], self.shape.hidden
        state, cell, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((len(x), n, h), np.float32), []
        for t in range(len(x)):
            if t % STEPS == 0:
                drive = x[t : t + STEPS] @ self.w[f"x{k}"] + self.w[f"b{k}"]
            z = drive[t % STEPS] + state @ self.w[f"h{k}"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            past, state = state, o * np.tanh(cell)
            out[t] = state
            if learn:
                kept.append((i, f, o, g, before, cell, past))
        return out, kept

    @staticmethod
    def _flipped(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each page in reverse, padding still at the end."""
        t = np.arange(len(x))[:, None]
        at = np.where(t < lengths, lengths - 1 - t, t)
        return x[at, np.arange(x.shape[1])[None]]

    def _forward(self, x: np.ndarray, lengths: np.ndarray, learn: bool = False) -> tuple[np.ndarray, tuple]:
        ahead, kept_f = self._run(x, "f", learn)
        back, kept_b = self._run(self._flipped(x, lengths), "b", learn)
        both = np.concatenate([ahead, self._flipped(back, lengths)], axis=2)
        return _sigmoid(both @ self.w["out"] + self.w["bias"]), (both, kept_f, kept_b)

    def _back(self, x: np.ndarray, grad_out: np.ndarray, kept: list, k: str, grads: dict) -> np.ndarray:
        h, wx, wh = self.shape.hidden, self.w[f"x{k}"], self.w[f"h{k}"]
        dz = np.empty((len(x), x.shape[1], 4 * h), np.float32)
        ds, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        dh = np.zeros_like(wh)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, cell, past = kept[t]
            ds = ds + grad_out[t]
            tc = np.tanh(cell)
            dc = dc + ds * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dh += past.T @ dz[t]
            ds, dc = dz[t] @ wh.T, dc * f
        flat = dz.reshape(-1, 4 * h)
        grads |= {f"x{k}": x.reshape(-1, x.shape[2]).T @ flat, f"h{k}": dh, f"b{k}": flat.sum(axis=0)}
        return (flat @ wx.T).reshape(x.shape)

    def gradients(self, pages: list[list[Block]], labels: list[np.ndarray]) -> tuple[float, dict]:
        slots = [self.slots(p) for p in pages]
        rows = [self.inputs(p, s) for p, s in zip(pages, slots, strict=True)]
        lengths = np.array([len(r) for r in rows])
        x = np.zeros((lengths.max(), len(rows), rows[0].shape[1]), np.float32)
        y = np.zeros(x.shape[:2], np.float32)
        for j, (r, target) in enumerate(zip(rows, labels, strict=True)):
            x[: len(r), j], y[: len(r), j] = r, target
        real = np.arange(len(x))[:, None] < lengths
        p, (both, kept_f, kept_b) = self._forward(x, lengths, learn=True)
        d = np.where(real, p - y, 0).astype(np.float32) / lengths.sum()
        grads = {"out": np.einsum("tnh,tn->h", both, d), "bias": d.sum(keepdims=True).reshape(1)}
        db, h = d[:, :, None] * self.w["out"], self.shape.hidden
        dx = self._back(x, db[:, :, :h], kept_f, "f", grads)
        flipped = self._flipped(x, lengths)
        dx += self._flipped(self._back(flipped, self._flipped(db[:, :, h:], lengths), kept_b, "b", grads), lengths)
        grads |= {"path": np.zeros_like(self.w["path"]), "word": np.zeros_like(self.w["word"])}
        w = self.shape.wide
        for j, (a, b, c, e) in enumerate(slots):
            for name, slot, ends, part in (("path", a, b, slice(0, w)), ("word", c, e, slice(w, 2 * w))):
                size = np.diff(ends, prepend=0)
                np.add.at(grads[name], slot, np.repeat(dx[: len(ends), j, part] / size[:, None], size, axis=0))
        loss = -np.where(real, y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7), 0).sum() / lengths.sum()
        return float(loss), grads

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Chance that each block is text; pages of like length are run together, as long as the places of all don't exceed a bound."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            many = next((n for n in range(1, min(64, len(order))) if (n + 1) * len(pages[order[n]]) > PLACES), min(64, len(order)))
            some, order = order[:many], order[many:]
            rows = [self.inputs(pages[i], self.slots(pages[i])) for i in some]
            lengths = np.array([len(r) for r in rows])
            x = np.zeros((lengths.max(), len(rows), rows[0].shape[1]), np.float32)
            for j, r in enumerate(rows):
                x[: len(r), j] = r
            p, _ = self._forward(x, lengths)
            for j, i in enumerate(some):
                out[i] = p[: lengths[j], j]
        return out


def made_pages(n: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Made-up pages as blocks with labels; a page whose blocks don't match its leaves is passed over."""
    maker, pages, labels = PageMaker(seed), [], []
    for _ in range(n):
        page, leaves = maker.page()
        found = blocks(page)
        if [b.text for b in found] == [t for t, _ in leaves]:
            pages.append(found)
            labels.append(np.array([y for _, y in leaves], np.float32))
    return pages, labels


@functools.cache
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Adam over made-up pages; the same arguments give the same labeller."""
    model, rng = Labeller(seed=seed), np.random.default_rng(seed)
    data, labels = made_pages(pages, seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            _, grads = model.gradients([data[i] for i in some], [labels[i] for i in some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.01 * 0.6**epoch
                model.w[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    out, held, size = [], [], 0
    for k, page in enumerate(pages):
        held.append(blocks(page) if page else [])
        size += len(page or "")
        if size > CHUNK or k == len(pages) - 1:
            out += ["\n".join(b.text for b, p in zip(bs, ps, strict=True) if p >= 0.5) for bs, ps in zip(held, model.label(held), strict=True)]
            held, size = [], 0
    return out


def html_extract(pages: DataFrame, model: Labeller | None = None, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    spark = pages.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = sent.value
        for batch in batches:
            texts = main_texts(labeller, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    held = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return held.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
