"""Benchmark decontamination by template canonicalisation.

Words are stripped of punctuation and lower-cased; numbers, quantities, units and names become typed placeholders whose values are
kept as slots. Windows of five template words of the benchmark are hashed; whole documents are probed window by window. An item is found where
some stretch of the document, at most twice as long as the item, holds 80 % of its windows or more and the slots are consistent: each value of the item
stands for one value of the document and no two for the same one. Every longest stretch is tried, aligned by its most common shift and by each other one, and an item's own values come before others.
The first word of an item matches the same word in a document whether or not it counts as a name there. The values may be others than the item's: a re-parameterised question.
An item with fewer than three ordinary words must come with its own values. Windows of placeholders only are looked up by their values, so rows of numbers don't meet all items that
have some; items with more words are found by their other windows, and then aligned word by word.

The benchmark is probed in blocks of a bounded number of windows, each broadcast; documents are never shuffled, and every item meets every document.
Null or empty items are never found; null or empty texts hold none. Repeated rows and null ids keep a row each. An item shorter than a window is one window. A text of any length is probed whole, its
windows at once; what it holds beside them is one entry for each window that it shares with an item. Other columns don't matter, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

WINDOW, SHARE = 5, 0.8
#: Windows of the benchmark in one broadcast: about 32 bytes each.
BLOCK_WINDOWS = 1_000_000
KNOWN_WORDS = 1 << 19
LITERAL, NUMBER, QUANTITY, UNIT, NAME = range(5)

# Words of number and of measure.
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
UNITS = frozenset(
    "mm cm dm km m kg g mg t lb lbs oz ml cl l ft in inch inches feet foot yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters gram grams kilogram kilograms ton tons pound pounds ounce ounces liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit kelvin volt volts watt watts joule joules newton newtons hz khz mhz mph kmh kph kb mb gb tb".split()
) - {"in", "t", "l", "g", "m", "min", "sec"}
ATTACHED = UNITS | {"m", "g", "l", "t", "s", "h", "in", "min", "sec", "%", "°", "°c", "°f", "$", "€", "£"}

EDGES = re.compile(r"^[^\w$€£%°+-]+|[^\w%°€£$]+$")
NUMERIC = re.compile(r"^[+-]?[$€£]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?$")
AMOUNT = re.compile(r"^[+-]?[$€£]?\d+(?:[.,]\d+)*-?([^\d\W]+|%|°[cf]?|[$€£])$")


def classify(raw: str) -> tuple[int, str, bool, bool]:
    """Kind and form of a word, whether it is capitalised, and whether a sentence ends with it."""
    core = raw.rstrip(".,!?")
    if core.isalpha() and (form := core.lower()) not in NUMBER_WORDS and form not in UNITS:
        return LITERAL, form, core[0].isupper() and not core.isupper(), raw[-1] in ".!?"
    ends = raw.rstrip("\"')]»”’*%$&#")[-1:] in (".", "!", "?", ":", ";", "") or raw[-1:] in (".", "!", "?")
    word = EDGES.sub("", raw)
    form = word.lower()
    if NUMERIC.match(form) or form in NUMBER_WORDS:
        return NUMBER, form, False, ends
    if (amount := AMOUNT.match(form)) and amount[1] in ATTACHED:
        return QUANTITY, form, False, ends
    if form in UNITS:
        return UNIT, form, False, ends
    form = re.sub(r"^[\W_]+|[\W_]+$", "", form)
    return LITERAL, form, word[:1].isupper() and not word.isupper(), ends


class _Known(dict):
    """Numbers raw words and keeps what is known of each in arrays that double as they fill."""

    def __init__(self):
        super().__init__()
        self.form: list[str] = []
        self.kind, self.hash, self.value, self.capital, self.ends = (np.zeros(1 << 12, t) for t in (np.int8, np.uint64, np.uint64, bool, bool))

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        if n == len(self.kind):
            self.kind, self.hash, self.value, self.capital, self.ends = (np.concatenate([a, np.zeros_like(a)]) for a in (self.kind, self.hash, self.value, self.capital, self.ends))
        kind, form, self.capital[n], self.ends[n] = classify(word)
        self.form.append(form)
        self.kind[n] = kind if form else -1
        self.value[n] = xxhash.xxh3_64_intdigest(form.encode())
        self.hash[n] = self.value[n] if kind == LITERAL else kind
        return n


class Templates:
    """Turns texts into template words, kinds and values."""

    def __init__(self):
        self.known = _Known()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = text.split()
        if len(self.known) > KNOWN_WORDS:
            self.known = _Known()
        ids = np.fromiter(map(self.known.__getitem__, raw), np.int64, len(raw))
        kind, code = self.known.kind[ids], self.known.hash[ids]
        name = self.known.capital[ids] & (kind == LITERAL) & ~np.concatenate([[True], self.known.ends[ids[:-1]]])[: len(ids)]
        kind, code = np.where(name, np.int8(NAME), kind), np.where(name, np.uint64(NAME), code)
        real = kind >= 0
        return code[real], kind[real], ids[real]

    def value(self, i: int) -> str:
        return self.known.form[i]

    def windows(self, code: np.ndarray, kind: np.ndarray, ids: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of five template words, or of all where there are fewer, and whether a word is among them; where none is, values are hashed."""
        out, n = windows(code, width), min(width, len(code))
        upto = np.concatenate([[0], np.cumsum(kind == LITERAL)])
        worded = upto[n:] > upto[: len(out)]
        if not worded.all():
            out = np.where(worded, out, ~windows(self.known.value[ids], width))
        return out, worded


def windows(code: np.ndarray, width: int = WINDOW) -> np.ndarray:
    n = min(width, len(code))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ code[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Item:
    """An item's template words, their kinds and values; its windows by code, and which of them hold a word."""

    item_id: int
    code: np.ndarray
    kinds: list[int]
    values: list[str]
    windows: np.ndarray
    worded: np.ndarray

    def __post_init__(self):
        self.length, self.width = len(self.code), min(WINDOW, len(self.code))
        self.few = sum(k == LITERAL for k in self.kinds) < 3
        self.distinct = len(np.unique(self.windows))
        #: Windows that count: all, or those with a word.
        self.need = SHARE * (self.distinct if self.few else len(np.unique(self.windows[self.worded])))

    def aligned(self, shifts: np.ndarray, code: np.ndarray, kind: np.ndarray, ids: np.ndarray, templates: Templates) -> bool:
        """Whether enough windows of any sort stand in the document at one of these shifts."""
        there = np.zeros(len(self.windows), bool)
        for s in shifts.tolist():
            low, high = max(0, -s), min(self.length, len(code) - s)
            same = np.zeros(self.length, np.int64)
            same[low:high] = self.code[low:high] == code[low + s : high + s]
            if not low and self.kinds[0] == LITERAL and kind[s] == NAME and templates.value(ids[s]) == self.values[0]:
                same[0] = 1
            there |= np.convolve(same, np.ones(self.width, np.int64), "valid") == self.width
        return len(np.unique(self.windows[there])) >= SHARE * self.distinct


class Benchmark:
    """A block of items, ready to be probed."""

    def __init__(self, items: list[tuple[int, str]]):
        templates, hashes, owner, place = Templates(), [], [], []
        self.items: list[Item] = []
        for item_id, text in items:
            code, kind, ids = templates(text or "")
            if not len(code):
                continue
            w, worded = templates.windows(code, kind, ids)
            told = np.flatnonzero(worded) if (kind == LITERAL).sum() >= 3 else np.arange(len(w))
            owner += [len(self.items)] * len(told)
            place += told.tolist()
            hashes.append(w[told])
            if kind[0] == LITERAL:  # a first word that is capitalised inside a document's sentence counts as a name there
                owner.append(len(self.items))
                place.append(-1)
                named = slice(0, WINDOW)
                hashes.append(templates.windows(np.concatenate([np.array([NAME], np.uint64), code[1:WINDOW]]), np.concatenate([np.array([NAME], np.int8), kind[1:WINDOW]]), ids[named])[0])
            self.items.append(Item(item_id, code, kind.tolist(), [templates.value(i) for i in ids], windows(code), worded))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], np.array(owner, np.int64)[order], np.array(place, np.int64)[order]
        self.short = sorted({i.length for i in self.items if i.length < WINDOW})

    def found(self, text: str, templates: Templates) -> list[tuple[int, bool]]:
        """Items in the text, and whether their values are others."""
        code, kind, ids = templates(text)
        if not len(code) or not len(self.hashes):
            return []
        hits: dict[int, list[tuple[int, int]]] = {}
        for n in [WINDOW, *self.short]:
            if n > len(code) and n < WINDOW:
                continue
            w, _ = templates.windows(code, kind, ids, n)
            low = np.searchsorted(self.hashes, w, "left")
            there = np.flatnonzero((low < len(self.hashes)) & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == w))
            for at in there:
                j = low[at]
                while j < len(self.hashes) and self.hashes[j] == w[at]:
                    item = self.items[self.owner[j]]
                    if item.width == min(n, len(code)):
                        place = int(self.place[j])
                        if place >= 0 or kind[at] == NAME and templates.value(ids[at]) == item.values[0]:
                            hits.setdefault(int(self.owner[j]), []).append((int(at), max(place, 0)))
                    j += 1
        out = []
        for i, pairs in hits.items():
            if (other := self._verdict(self.items[i], pairs, code, kind, ids, templates)) is not None:
                out.append((self.items[i].item_id, other))
        return out

    def _verdict(self, item: Item, pairs: list[tuple[int, int]], code: np.ndarray, kind: np.ndarray, ids: np.ndarray, templates: Templates) -> bool | None:
        kinds, values, width, few = item.kinds, item.values, item.width, item.few
        if len({p for _, p in pairs}) < item.need:
            return None
        pairs.sort()
        at, place = np.array(pairs, np.int64).T
        shift, found = at - place, None
        # An item that needs its own values is tried where some window has them.
        same = {a - p for a, p in pairs if all(kinds[p + k] == LITERAL or templates.value(ids[a + k]) == values[p + k] for k in range(width))} if few else set()
        for low, high in self._stretches(pairs, 2 * item.length, item.need):
            a, p, s = at[low:high], place[low:high], shift[low:high]
            shifts, which, often = np.unique(s, return_inverse=True, return_counts=True)
            if not few and not item.worded.all() and not item.aligned(shifts, code, kind, ids, templates):
                continue
            ranks = [-often[which]]
            if len(shifts) > 1:
                ranks += [np.abs(s - x) for x in shifts[np.argsort(-often, kind="stable")] if not few or int(x) in same]
            for rank in ranks:
                order = np.argsort(rank, kind="stable")
                words, first = np.unique((p[order, None] + np.arange(width)).ravel(), return_index=True)
                match = zip(words.tolist(), (a[order, None] + np.arange(width)).ravel()[first].tolist(), strict=True)
                slots = [(kinds[x], values[x], templates.value(ids[y])) for x, y in match if kinds[x] != LITERAL and kind[y] == kinds[x]]
                other = self._consistent(slots, few)
                if other is False:
                    return False
                found = found or other
        return found

    @staticmethod
    def _stretches(pairs: list[tuple[int, int]], span: int, need: float) -> Iterator[tuple[int, int]]:
        """Each longest run of sorted pairs that spans no more words and holds enough windows."""
        low, inside = 0, Counter()
        for high, (at, place) in enumerate(pairs):
            if at - pairs[low][0] > span:
                if len(inside) >= need:
                    yield low, high
                while at - pairs[low][0] > span:
                    inside[pairs[low][1]] -= 1
                    if not inside[pairs[low][1]]:
                        del inside[pairs[low][1]]
                    low += 1
            inside[place] += 1
        if len(inside) >= need:
            yield low, len(pairs)

    @staticmethod
    def _consistent(slots: list[tuple[int, str, str]], few: bool) -> bool | None:
        """Whether values are others; None where they contradict each other, or are others where the item's own are asked for."""
        other = any(v != d for _, v, d in slots)
        if few:
            return None if other else False
        votes, forward, back = Counter(slots), {}, {}
        agree = 0
        for (k, v, d), n in votes.most_common():
            if forward.setdefault((k, v), d) == d and back.setdefault((k, d), v) == v:
                agree += n
        return other if agree >= SHARE * len(slots) else None


def decontamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", block_windows: int = BLOCK_WINDOWS, key: Column | None = None) -> DataFrame:
    """``doc_id, items, reparameterised, contaminated`` for every row of ``docs``: the ``item_id`` of the items it holds, and of those with other values; and ``key`` where one is given: a binary column to carry along. ``benchmark`` has ``item_id, text``."""
    spark = docs.sparkSession
    text_batches(spark)
    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("array<long>").alias("items"), F.lit(None).cast("array<long>").alias("other"), (F.lit(None).cast("binary") if key is None else key).alias("key"))
    block, size = [], 0

    def probe(before: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Benchmark(items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            templates, table = Templates(), sent.value
            for batch in batches:
                items, other = [], []
                for t, i, o in zip(*(batch.column(c).to_pylist() for c in ("text", "items", "other")), strict=True):
                    new = table.found(t, templates)
                    items.append((i or []) + [x for x, _ in new])
                    other.append((o or []) + [x for x, changed in new if changed])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64())), batch.column(4)], ["doc_id", "text", "items", "other", "key"])

        return before.mapInArrow(run, "doc_id long, text string, items array<long>, other array<long>, key binary")

    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").alias("t")).filter("t is not null").toLocalIterator():
        block.append(tuple(row))
        size += 1 + row.t.count(" ")
        if size >= block_windows:
            held, block, size = probe(held, block), [], 0
    if block:
        held = probe(held, block)
    tidy = lambda c: F.sort_array(F.array_distinct(F.coalesce(c, F.array().cast("array<long>"))))
    out = held.select("doc_id", tidy(F.col("items")).alias("items"), tidy(F.col("other")).alias("reparameterised"), (F.size(tidy(F.col("items"))) > 0).alias("contaminated"), "key")
    return out if key is not None else out.drop("key")
