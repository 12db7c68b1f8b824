"""Words of texts, and their five-word shingles with weights."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.rows import map_rows
from quirelab.session import discard, materialise

#: Words of a shingle, and how much more a rare one weighs than one that all documents hold.
SHINGLE, RANGE = 5, 0.5
#: Shingles in fewer than this share of the documents all weigh as much as those in this share.
RARE = 1e-3
#: Document frequencies are kept by this many buckets of the shingles' hashes, whatever the corpus: one byte for each is
#: broadcast. A shingle's bucket overstates its frequency by (shingles of a mean document) / BUCKETS of the documents, which
#: is below RARE up to 2,000 shingles.
BUCKETS = 1 << 21
#: Buckets in a row of counts, and rows of a part that are summed in one task before parts are summed.
PART, FIRST = 1 << 16, 64
#: Words whose hashes a worker keeps.
KEPT = 200_000

#: A-Z become lower case; what is neither an ASCII letter or digit nor beyond ASCII separates words.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_SHIFT = np.uint64(64 - (BUCKETS - 1).bit_length())


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mixture of 64 bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of counts with the largest n, `limit` at most: those above the lowest sixteenth of a doubling that still
    leaves no more. Only a histogram of these steps comes to the driver, and nothing is sorted."""
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, least = 0, None
    for s, k in sizes:
        total += k
        if total > limit:
            break
        least = s
    return counts.where(step >= least) if least is not None else counts.limit(0)


class Numbers(dict):
    """Numbers words as they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.fresh.append(word)
        return k


class Hasher:
    """Hashes of texts' shingles; what is known of a word is looked up once while the worker keeps it."""

    def __init__(self):
        self.known = Numbers()
        self.h = np.empty(KEPT, np.uint64)

    def _look(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) + len(words) > len(self.h):
            self.known = Numbers()
            if len(words) > len(self.h):
                self.h = np.empty(len(words), np.uint64)
        known = self.known
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.fresh:
            self.h[len(known) - len(known.fresh) : len(known)] = np.array(list(map(xxhash.xxh64_intdigest, known.fresh)), np.uint64)
            known.fresh = []
        return self.h[at]

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Of the shingle that starts at each word. A text of one to four words is one shingle; one without words has none."""
        if not words:
            return np.empty(0, np.uint64)
        h = self._look(words)
        n = max(1, len(words) - SHINGLE + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(SHINGLE, len(words))):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
        return mix(out)


def _summed(rows: pa.Table) -> np.ndarray:
    total = np.zeros(PART, np.int64)
    for data in rows["counts"]:
        total += np.frombuffer(zlib.decompress(data.as_py()), np.int64)
    return total


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The weight of each bucket of shingles, from 0 to 255 for 0 to 1: ln(documents / documents that hold a shingle of the
    bucket) / ln(1 / RARE), 1 at most. Counted over all documents; a document counts once for each of its shingles.

    Tasks count in arrays and pass them on in parts, compressed; parts are summed by task number first, so that no task sums
    more than about the square root of all, and BUCKETS bytes come to the driver."""

    def make():
        hasher, counts, total = Hasher(), np.zeros(BUCKETS, np.int64), [0]

        def call(texts):
            for t in texts:
                h = hasher.hashes(words_of(t))
                if len(h):
                    h = h >> _SHIFT
                    h.sort()
                    counts[h[np.concatenate(([True], h[1:] != h[:-1]))]] += 1
            total[0] += len(texts)

        def finish():
            task = TaskContext.get().partitionId()
            for k in range(0, BUCKETS, PART):
                part = counts[k : k + PART]
                if part.any():
                    yield [k // PART], [task // FIRST], [zlib.compress(part.tobytes(), 1)], [0]
            yield [None], [task // FIRST], [None], total

        call.finish = finish
        return call

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("batch", T.IntegerType()), T.StructField("counts", T.BinaryType()), T.StructField("n", T.LongType())])
    counted = materialise(map_rows(docs, [text_col], schema, make), "shingle-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0

    def add(rows: pa.Table) -> pa.Table:
        return pa.table({"part": rows["part"][:1], "counts": pa.array([zlib.compress(_summed(rows).tobytes(), 1)])})

    def weigh(rows: pa.Table) -> pa.Table:
        n = np.maximum(_summed(rows), 1)
        w = np.clip(np.log(total / n) / np.log(1 / RARE), 0, 1)
        return pa.table({"part": rows["part"][:1], "weights": pa.array([np.rint(255 * w).astype(np.uint8).tobytes()])})

    some = counted.where("part IS NOT NULL")
    batches = some.groupBy("part", "batch").applyInArrow(add, "part int, counts binary")
    out = np.full(BUCKETS, 255, np.uint8)
    for r in batches.groupBy("part").applyInArrow(weigh, "part int, weights binary").collect():
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["weights"], np.uint8)
    discard(counted)
    return out


#: Weights with which every shingle counts as rare.
ALL_RARE = np.full(BUCKETS, 255, np.uint8)


class Shingler(Hasher):
    """TF-IDF shingles of texts: a shingle weighs its number of places times (1 + RANGE times its inverse document frequency,
    scaled to 0 to 1). The bound below keeps large groups of copies together: their shared shingles are frequent and would
    weigh almost nothing beside the words in which two copies differ."""

    def __init__(self, frequencies: np.ndarray):
        super().__init__()
        self.frequencies = frequencies
        self.scale = 1 + RANGE / 255 * np.arange(256)

    def places(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and weight of the shingle that starts at each word."""
        h = self.hashes(words)
        return h, self.scale[self.frequencies[h >> _SHIFT]]

    def bag(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The different shingles, ascending, and their weights."""
        h, w = self.places(words)
        if not len(h):
            return h, w
        order = h.argsort(kind="stable")
        h, w = h[order], w[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], np.add.reduceat(w, first)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 if both are empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    shared = float(np.minimum(a[1][both], b[1][at[both]]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared)
