"""Language-model scores from a log-frequency Bloom filter.

All unigrams and bigrams of the training texts are counted in Spark. Those that occur LEAST times or more, however large the
corpus, go into a Bloom filter with their counts on a logarithmic scale: an n-gram of level q is put in once for each level
from 1 to q, so that a count is read back by asking for level after level until one is missing. The filter grows with the
corpus: it consists of segments of about SEGMENT entries each by their hashes, which tasks build and write into the shared
folder. A task reads one segment after the other and asks it for the n-grams of up to PASS tokens.

The probabilities add up to 1. With l(x) and u(x) the least and the greatest count of a level, a bigram's share of its context
is P(w | c) = l(c w) / u(c) + rest(c) P(w), where rest(c) is what the kept bigrams of c leave: 1 - sum of l(c w) / u(c), which
is above 0. It is in the filter, too, on a finer scale of its own. P(w) = l(w) / Z for kept unigrams; the others share equally,
with one place for words never seen, what occurrences they have in training. Two things differ from this by a bounded amount:
rest(c) is read back within a factor of REST, and each pair of kept tokens that is not in the filter is found in it with
the filter's share of false positives (below 0.0005) as a pair of the lowest level.

The base score needs every token's exact count. Counts of the HEAD most frequent tokens are broadcast; each text's other
tokens are joined with the table of all counts by shuffle and summed.

Tokens are what stands between ASCII white space, A-Z lower-cased, and one end for each text. Tokens are told apart by 64-bit
hashes. Cases: a null or empty text is its end alone. Rows whose train condition is null or false teach nothing; without
training texts every count is 0. A null id stays null, repeated rows teach and are scored as often as they stand. Columns
besides those named are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.rows import map_rows
from quirelab.llm.token_files import _get, _open, _put
from quirelab.llm.words import Numbers, mix, most_frequent
from quirelab.session import _delete, discard, fresh_path, materialise, ship

#: Occurrences from which an n-gram is kept.
LEAST = 2
#: Most frequent tokens whose exact counts are broadcast (16 bytes each).
HEAD = 1 << 18
#: Entries in a segment of the filter, tokens that are scored in one pass over the segments, bigrams that a task counts at once.
SEGMENT, PASS, COUNTED = 1 << 20, 1 << 21, 1 << 21
#: Bits of the filter for each entry, bits that an entry sets in its word of 64; the scale's base, and that of what contexts leave.
BITS, HASHES, BASE, REST = 32, 8, 1.5, 1.1
#: Words that a worker keeps.
KEPT = 400_000

END = xxhash.xxh64_intdigest(b"", 1) - (1 << 63)


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h").agg(F.sum("n").alias("n"))


_COUNT = T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])
_PAIRS = T.StructType([*_COUNT, T.StructField("c", T.LongType())])


def unigram_counts(texts: DataFrame) -> DataFrame:
    """(h, n) of every token."""

    def make():
        seen: Counter = Counter()
        ends = [0]

        def flush():
            out = list(map(_hash, seen)), list(seen.values())
            seen.clear()
            return out

        def call(texts):
            for t in texts:
                seen.update(tokens_of(t))
            ends[0] += len(texts)
            return flush() if len(seen) > 1_000_000 else None

        call.finish = lambda: [flush(), ([END], ends)]
        return call

    return _sums(map_rows(texts, ["text"], _COUNT, make)).where("n > 0")


def bigram_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.astype(np.uint64)) + b.astype(np.uint64)).astype(np.int64)


class Hashes(dict):
    """Hashes of words as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = _hash(word)
        return h


def bigram_counts(texts: DataFrame) -> DataFrame:
    """(h, n, c) of the pairs of neighbouring tokens, c the first one's hash; before the first stands an end."""

    def make():
        known = Hashes()
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            before = np.concatenate([c for _, c in kept]) if kept else np.empty(0, np.int64)
            pairs, first, n = np.unique(np.concatenate([h for h, _ in kept]) if kept else before, return_index=True, return_counts=True)
            kept.clear()
            return pa.array(pairs), pa.array(n), pa.array(before[first])

        def call(texts):
            if len(known) > KEPT:
                known.clear()
            known[None] = END
            words = [tokens_of(t) for t in texts]
            flat = chain((None,), chain.from_iterable(chain(w, (None,)) for w in words))
            x = np.fromiter(map(known.__getitem__, flat), np.int64, 1 + sum(map(len, words)) + len(words))
            kept.append((bigram_key(x[:-1], x[1:]), x[:-1]))
            return flush() if sum(len(h) for h, _ in kept) > COUNTED else None

        call.finish = lambda: [flush()]
        return call

    return map_rows(texts, ["text"], _PAIRS, make).groupBy("h").agg(F.sum("n").alias("n"), F.first("c").alias("c"))


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for counts from LEAST, one more for each factor BASE."""
    return 1 + np.floor(np.log(np.maximum(np.asarray(counts) / LEAST, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def least_of(levels: np.ndarray) -> np.ndarray:
    """The least count of each level; 0 for level 0."""
    return np.where(levels > 0, LEAST * BASE ** (np.maximum(levels, 1) - 1.0), 0.0)


def rest_key(h: np.ndarray) -> np.ndarray:
    return mix(h.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).astype(np.int64)


class LogFrequencyFilter:
    """A Bloom filter of (key, level) for levels 1 to the key's own. An entry sets HASHES bits of one word of 64, so that a
    question reads one word."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        self.levels = int(levels.max(initial=0))
        self.words = np.zeros(max(1, -(-int(levels.sum()) * BITS // 64)), np.uint64)
        for q in range(1, self.levels + 1):
            at, mask = self._places(keys[levels >= q], q)
            np.bitwise_or.at(self.words, at, mask)

    @classmethod
    def stored(cls, levels: int, words: bytes) -> LogFrequencyFilter:
        out = cls.__new__(cls)
        out.levels, out.words = levels, np.frombuffer(words, np.uint64)
        return out

    def _places(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * level & (1 << 64) - 1))
        bits, mask = mix(h), np.zeros(len(h), np.uint64)
        for k in range(HASHES):
            mask |= np.uint64(1) << (bits >> np.uint64(6 * k) & np.uint64(63))
        return ((h >> np.uint64(32)) * np.uint64(len(self.words)) >> np.uint64(32)).astype(np.int64), mask

    def read(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level, 0 for keys that are not in."""
        out = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        for q in range(1, self.levels + 1):
            at, mask = self._places(keys[live], q)
            live = live[self.words[at] & mask == mask]
            if not len(live):
                break
            out[live] = q
        return out


@dataclass
class Segments:
    """The filter in the shared folder: `total` parts of the range of hashes, and the levels of those that hold entries."""

    folder: str
    total: int
    levels: dict[int, int]

    def read(self, *asked: np.ndarray) -> list[np.ndarray]:
        """For arrays of keys, their levels; one segment is held at a time."""
        out = [np.zeros(len(keys), np.int64) for keys in asked]
        orders, places = [], []
        for keys in asked:
            of = (keys.astype(np.uint64) >> np.uint64(32)) * np.uint64(self.total) >> np.uint64(32)
            orders.append(of.argsort(kind="stable"))
            places.append(np.searchsorted(of[orders[-1]], np.arange(self.total + 1, dtype=np.uint64)))
        for k, levels in self.levels.items():
            at = [order[place[k] : place[k + 1]] for order, place in zip(orders, places)]
            if any(map(len, at)):
                part = LogFrequencyFilter.stored(levels, _get(self.folder, f"{k}.bits"))
                for keys, found, i in zip(asked, out, at):
                    found[i] = part.read(keys[i])
        return out


def build_segments(entries: DataFrame) -> Segments:
    """entries: (h, level), written; one row for each key, levels from 1."""
    ship(entries.sparkSession)
    folder = fresh_path(entries.sparkSession, "filter")
    total = max(1, -(-(entries.agg(F.sum("level")).first()[0] or 0) // SEGMENT))

    def build(rows: pa.Table) -> pa.Table:
        k = rows["segment"][0].as_py()
        part = LogFrequencyFilter(rows["h"].to_numpy(), rows["level"].to_numpy().astype(np.int64))
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        _put(folder, f"{k}.bits", part.words.tobytes())
        return pa.table({"segment": [k], "levels": [part.levels]})

    segment = F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(total).cast("long"), 32)
    built = entries.withColumn("segment", segment).groupBy("segment").applyInArrow(build, "segment long, levels long").collect()
    return Segments(folder, total, {r["segment"]: r["levels"] for r in sorted(built)})


@dataclass
class Model:
    filter: Segments
    head: np.ndarray
    head_counts: np.ndarray
    n: int
    v: int
    #: Sum of what kept unigrams count and the occurrences of the others, and each other token's part of it.
    z: float
    other: float

    def probabilities(self, before: np.ndarray, own: np.ndarray, pair: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """P(own | before) from the levels of both tokens, of the pair and of what the context leaves."""
        p = np.where(own > 0, least_of(own), self.other) / self.z
        # A pair that is kept has kept tokens, and its context at least its count.
        pair = np.where((before > 0) & (own > 0), np.minimum(pair, before), 0)
        return np.where(before > 0, least_of(pair) / (least_of(before) * BASE) + REST ** -(rest + 0.5 * (rest > 0)) * p, p)


def _level(n) -> Column:
    """level_of in Spark."""
    return (1 + F.floor(F.log(F.greatest(n / float(LEAST), F.lit(1.0))) / float(np.log(BASE)) + 1e-9)).cast("int")


def _least(level) -> Column:
    return LEAST * F.pow(F.lit(float(BASE)), level - 1)


def train(texts: DataFrame, counts: DataFrame) -> Model:
    """counts: those of unigram_counts(texts), written. To the driver come HEAD counts and the levels of the segments."""
    often = F.col("n") >= LEAST
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    n, v, n_kept, v_kept, kept = counts.agg(total(F.col("n")), F.count(F.lit(1)), total(F.when(often, F.col("n"))), F.count_if(often), total(F.when(often, _least(_level(F.col("n")))))).first()
    top = most_frequent(counts, HEAD).select("h", "n").toArrow()
    h, c = top["h"].to_numpy(), top["n"].to_numpy()
    unigrams = counts.where(often).select("h", _level(F.col("n")).alias("level"))
    bigrams = materialise(bigram_counts(texts).where(often).select("h", "c", _level(F.col("n")).alias("level")), "bigrams")
    shares = bigrams.groupBy(F.col("c").alias("h")).agg(F.sum(_least(F.col("level"))).alias("kept")).join(unigrams, "h")
    # Of a context that loses more than rounding allows, next to nothing is left; l and u make this impossible but for rounding.
    left = F.greatest(1 - F.col("kept") / (_least(F.col("level")) * BASE), F.lit(1e-6))
    rests = shares.select("h", F.floor(-F.log(left) / float(np.log(REST))).cast("int").alias("level")).where("level > 0")
    keyed = map_rows(rests, ["h", "level"], _ENTRY, lambda: lambda h, level: (pa.array(rest_key(np.array(h, np.int64))), level))
    entries = materialise(unigrams.unionByName(bigrams.select("h", "level")).unionByName(keyed), "ngrams")
    filter = build_segments(entries)
    discard(entries)
    discard(bigrams)
    others = float(max(1, n - n_kept))
    order = h.argsort()
    return Model(filter, h[order], c[order], n, v, float(kept) + others, others / (v - v_kept + 1))


_ENTRY = T.StructType([T.StructField("h", T.LongType()), T.StructField("level", T.IntegerType())])


class Scorer:
    """Scores texts; what is known of a word is looked up once while the worker keeps it. Slices wait for a pass over the
    filter's segments."""

    def __init__(self, model: Model):
        self.m = model
        self._reset(KEPT)
        self.waiting: list[tuple] = []
        self.tokens = 0

    def _reset(self, size: int) -> None:
        self.known = Numbers()
        self.h, self.c, self.log_c = np.empty(size, np.int64), np.empty(size, np.int64), np.empty(size)
        # Number 0 is the end, which no word can be.
        self.known[None] = 0
        self._put(0, np.array([END], np.int64))

    def _put(self, at: int, h: np.ndarray) -> None:
        """Hash and exact count (-1: not in the head)."""
        m, end = self.m, at + len(h)
        self.h[at:end] = h
        c = np.full(len(h), -1, np.int64)
        if len(m.head):
            k = np.minimum(np.searchsorted(m.head, h), len(m.head) - 1)
            c = np.where(m.head[k] == h, m.head_counts[k], -1)
        self.c[at:end], self.log_c[at:end] = c, np.where(c >= 0, np.log10(np.maximum(c, 0) + 1), 0)

    def add(self, ids: list, texts: list[str | None]) -> None:
        """Keeps for each text: id, tokens, known tokens and sum of log10(count + 1) in the head, the other tokens' hashes and
        numbers; and the hashes of all tokens."""
        words = [tokens_of(t) for t in texts]
        total = sum(map(len, words))
        if len(self.known) + total > len(self.h):
            self._reset(max(KEPT, total + 1))
        known = self.known
        flat = chain.from_iterable(chain(w, (None,)) for w in words)
        at = np.fromiter(map(known.__getitem__, flat), np.int64, total + len(words))
        if known.fresh:
            self._put(len(known) - len(known.fresh), np.array(list(map(_hash, known.fresh)), np.int64))
            known.fresh = []
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        c = self.c[at]
        rest = np.flatnonzero(c < 0)
        text, h = np.repeat(np.arange(len(words)), sizes)[rest], self.h[at[rest]]
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.empty(0, np.int64)
        numbers = np.diff(np.append(first, len(h)))
        offsets = np.concatenate(([0], np.cumsum(np.bincount(text[first], minlength=len(words))))).astype(np.int32)
        tail = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(h[first]), pa.array(numbers)], ["h", "n"]))
        add = lambda x: np.add.reduceat(x, starts)
        self.waiting.append((ids, sizes, add((c > 0).astype(np.int64)), add(self.log_c[at]), tail, self.h[at]))
        self.tokens += len(at)

    def score(self) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """What add() has kept, with the model's log10 probability of each text before the other tokens."""
        ids, sizes, known, log_c, tail, h = zip(*self.waiting)
        self.waiting, self.tokens = [], 0
        sizes, h, m = np.concatenate(sizes), np.concatenate(h), self.m
        # Every text ends with an end, so that one also stands before the next text's first token.
        keys, pair = np.unique(bigram_key(np.concatenate(([END], h[:-1])), h), return_inverse=True)
        tokens, token = np.unique(h, return_inverse=True)
        one, two, left = m.filter.read(tokens, keys, rest_key(tokens))
        own, left = one[token], left[token]
        # The last text's end stands before the first token.
        shifted = lambda x: np.concatenate((x[-1:], x[:-1]))
        p = m.probabilities(shifted(own), own, two[pair], shifted(left))
        score = np.add.reduceat(np.log10(p), np.concatenate(([0], np.cumsum(sizes)[:-1])))
        return list(chain.from_iterable(ids)), sizes, np.concatenate(known), np.concatenate(log_c), score, pa.concat_arrays(tail)


def score_texts(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, n_tokens, n_known, train_tokens, base_score, score. train_rows: which rows to learn from."""
    texts = docs.where(train_rows).select(F.col(text_col).alias("text"))
    counts = materialise(unigram_counts(texts), "unigrams")
    model = train(texts, counts)
    tail = T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("known", T.LongType()),
            T.StructField("log_c", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("tail", T.ArrayType(tail)),
        ]
    )

    def make():
        scorer, row = Scorer(model), [TaskContext.get().partitionId() << 36]

        def flush():
            ids, *found, tail = scorer.score()
            rows = range(row[0], row[0] + len(ids))
            row[0] += len(ids)
            return list(rows), ids, *map(pa.array, found), tail

        def call(ids, texts):
            scorer.add(ids, texts)
            return flush() if scorer.tokens > PASS else None

        call.finish = lambda: [flush()] if scorer.waiting else []
        return call

    scored = materialise(map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id", "text"], schema, make), "scored")
    _delete(docs.sparkSession, model.filter.folder)
    rest = scored.select("row", F.explode("tail").alias("t")).select("row", F.col("t.h").alias("h"), F.col("t.n").alias("k"))
    rest = rest.join(counts, "h").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"), F.sum("k").alias("more_known"))
    each = np.log10(model.n + 1 * (model.v + 1))
    out = scored.drop("tail").join(rest, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("log_c") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(each)).alias("base_score"),
        "score",
    )
