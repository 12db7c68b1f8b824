"""Benchmark passages in documents: SimHash of item-sized windows, found through multi-index Hamming blocks.

Every item has a SimHash of BITS bits over its weighted five-word shingles. In a document, windows of as many words as an
item are fingerprinted; the fingerprints are split into blocks of 16 bits, and since two fingerprints within RADIUS bits of
each other differ by at most RADIUS / blocks bits in one block at least, looking up each block's value among the items'
within that many bits finds all items within RADIUS. Those are compared exactly by weighted Jaccard similarity of shingles.

A window can be similar to an item only if the item's shingles that stand anywhere in the document have at least that share of
the item's weight; only windows around such shingles are fingerprinted, and this loses none. Items are taken in blocks of
ITEMS, so that what is broadcast has a fixed bound whatever the size of the benchmark.

Cases: null and empty texts, and items without words, match nothing. Items of one to four words are one shingle and match
where the same words stand in a row. Repeated items and rows each give their own results. A null id stays null. Columns
besides those named are ignored by find_leaks; clean keeps them all, whatever their names.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.filters import keep_rows
from quirelab.llm.rows import map_rows
from quirelab.llm.words import SHINGLE, Shingler, inverse_frequencies, mix, similarity, words_of

SIMILARITY = 0.8
BITS = 256
#: At a weighted Jaccard similarity of 0.8 the cosine is about 0.89, so that 39 of 256 bits differ on average, with a
#: standard deviation below 6; this is over three and a half of them more.
RADIUS = 60
BLOCKS = BITS // 16
#: Items whose index is broadcast at once, and items of one size up to which no table is kept.
ITEMS, FEW = 20_000, 64

_PLANES = np.random.default_rng(7_007).integers(0, 1 << 63, BITS // 64, np.uint64)


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 and -1 for each shingle and bit."""
    words = mix(h[:, None] ^ _PLANES[None, :])
    return np.unpackbits(words.view(np.uint8).reshape(len(h), BITS // 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u2")


def _bag(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = h.argsort(kind="stable")
    h, w = h[order], w[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(w, first)


class Index:
    """The items' shingles and fingerprints."""

    def __init__(self, items: list[tuple[Any, str | None]], frequencies, wanted: float):
        self.wanted, self.shingler = wanted, Shingler(frequencies)
        self.ids, self.sizes, self.bags = [], [], []
        prints, hashes, owners = [], [], []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            h, w = self.shingler.places(words)
            prints.append(_pack((_signs(h) * w[:, None]).sum(0, keepdims=True))[0])
            self.bags.append(_bag(h, w))
            hashes.append(self.bags[-1][0])
            owners.append(np.full(len(hashes[-1]), len(self.ids)))
            self.ids.append(item)
            self.sizes.append(len(words))
        self.size = np.array(self.sizes, np.int64)
        self.prints = np.array(prints, np.uint16).reshape(len(self.ids), BLOCKS)
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = every.argsort(kind="stable")
        self.hashes, self.owner = every[order], owner[order]
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[self.hashes >> np.uint64(42)] = True
        # A similar window shares at least this weight with the item, which the item's own weights of shared shingles bound.
        self.least = np.array([wanted * w.sum() - 1e-6 for _, w in self.bags])
        self.short = sorted({n for n in self.sizes if n < SHINGLE})
        self.by_size = {n: np.flatnonzero(self.size == n) for n in set(self.sizes)}
        self.tables: dict[tuple[int, int, int], np.ndarray] = {}

    def _near_block(self, size: int, block: int, value: int) -> np.ndarray:
        found = self.tables.get((size, block, value))
        if found is None:
            if len(self.tables) > 200_000:
                self.tables.clear()
            own = self.by_size[size]
            found = self.tables[size, block, value] = own[np.bitwise_count(self.prints[own, block] ^ np.uint16(value)) <= RADIUS // BLOCKS]
        return found

    def candidates(self, prints: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(window, item of `size` words) of all fingerprints within RADIUS."""
        own = self.by_size[size]
        if len(own) <= FEW:
            # So few that the blocks of all are compared at once.
            bits = np.bitwise_count(prints[:, None, :] ^ self.prints[own][None, :, :])
            rows, items = np.nonzero((bits <= RADIUS // BLOCKS).any(2) & (bits.sum(2) <= RADIUS))
            return list(zip(rows.tolist(), own[items].tolist()))
        found = set()
        for block in range(BLOCKS):
            values, which = np.unique(prints[:, block], return_inverse=True)
            for k, v in enumerate(values.tolist()):
                items = self._near_block(size, block, v)
                if len(items):
                    rows = np.flatnonzero(which == k)
                    near = np.bitwise_count(prints[rows][:, None, :] ^ self.prints[items][None, :, :]).sum(2) <= RADIUS
                    found.update((int(rows[i]), int(items[j])) for i, j in zip(*np.nonzero(near)))
        return sorted(found)

    def find(self, text: str | None) -> list[tuple[Any, int, int, float]]:
        """(item id, first word, words, similarity) of the passages; of overlapping windows of an item the most similar."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        out = []
        if len(words) >= SHINGLE:
            out += self._find(*self.shingler.places(words), SHINGLE)
        for k in self.short:
            if len(words) >= k and (k < SHINGLE):
                out += self._find(*self._short_places(words, k), k)
        return out

    def _short_places(self, words: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.shingler.places(words[i : i + k]) for i in range(len(words) - k + 1)]
        return np.concatenate([h for h, _ in parts]), np.concatenate([w for _, w in parts])

    def _find(self, h: np.ndarray, w: np.ndarray, k: int) -> list[tuple[Any, int, int, float]]:
        places = np.flatnonzero(self.bitmap[h >> np.uint64(42)])
        if not len(places):
            return []
        low, high = np.searchsorted(self.hashes, h[places]), np.searchsorted(self.hashes, h[places], "right")
        counts = high - low
        if not counts.any():
            return []
        at = np.repeat(places, counts)
        own = self.owner[np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        fits = (self.size[own] >= SHINGLE) if k == SHINGLE else self.size[own] == k
        at, own = at[fits], own[fits]
        best: list[tuple[float, int, int]] = []
        by_size: dict[int, list[np.ndarray]] = {}
        for item in np.unique(own).tolist():
            hit = at[own == item]
            different, weights = self.bags[item]
            if weights[np.isin(different, h[hit])].sum() >= self.least[item]:
                by_size.setdefault(self.sizes[item], []).append(hit)
        for size, hits in by_size.items():
            n = size - k + 1
            near = np.zeros(len(h) + 1, np.int64)
            for hit in hits:
                np.add.at(near, np.maximum(hit - n + 1, 0), 1)
                np.add.at(near, hit + 1, -1)
            starts = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (np.arange(len(h)) <= len(h) - n))
            if len(h) < n:
                starts, n = np.array([0]), len(h)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for part in range(0, len(run), 4096):
                    s = run[part : part + 4096]
                    if not len(s):
                        continue
                    a, b = int(s[0]), int(s[-1]) + n
                    sums = np.zeros((b - a + 1, BITS), np.float32)
                    np.cumsum(_signs(h[a:b]) * w[a:b, None], axis=0, out=sums[1:])
                    prints = _pack(sums[s - a + n] - sums[s - a])
                    for row, item in self.candidates(prints, size):
                        start = int(s[row])
                        sim = similarity(_bag(h[start : start + n], w[start : start + n]), self.bags[item])
                        if sim >= self.wanted:
                            best.append((-sim, start, item))
        out, taken = [], {}
        for sim, start, item in sorted(best):
            size = self.sizes[item]
            if all(abs(start - s) >= size for s in taken.get(item, ())):
                taken.setdefault(item, []).append(start)
                out.append((self.ids[item], start, size, -sim))
        return out


def _blocks(items: DataFrame, item_col: str, item_text_col: str):
    """The items in blocks of bounded size, in the order of their hashes."""
    rows = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    n = -(-rows.count() // ITEMS)
    for k in range(n):
        yield [(r["item"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", wanted: float = SIMILARITY) -> DataFrame:
    """One row for each passage: id, item id, first_word, n_words, similarity."""
    frequencies = inverse_frequencies(docs, text_col)
    named = lambda df, c, name: T.StructField(name, df.schema[c].dataType)
    schema = T.StructType([named(docs, id_col, id_col), named(items, item_col, item_col), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_col, item_text_col):

        def make(block=block):
            index = Index(block, frequencies, wanted)

            def call(ids, texts):
                rows = [(i, *leak) for i, t in zip(ids, texts) for leak in index.find(t)]
                return tuple(map(list, zip(*rows))) if rows else None

            return call

        out = out.union(map_rows(docs, [id_col, text_col], schema, make))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", wanted: float = SIMILARITY) -> DataFrame:
    """docs without the rows that hold a passage."""
    frequencies = inverse_frequencies(docs, text_col)
    for block in _blocks(items, item_col, item_text_col):

        def make(block=block):
            index = Index(block, frequencies, wanted)
            return lambda texts: [not index.find(t) for t in texts]

        docs = keep_rows(docs, text_col, make)
    return docs
