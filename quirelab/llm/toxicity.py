"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words and word beginnings, each hashed into one of DIMENSIONS places. A place weighs in by
its association with the label, chi / (chi + HALF) of its chi-square, so that words that say nothing or stand in one text only
are not learnt by heart, and no word is left out. In labelled texts,
each sentence that names a group is copied with the identity term swapped for each other term of its kind, and training
penalises the squared difference between the log-odds of the two sentences, so that naming one group rather than another
changes a score as little as the labels allow.

The model is fitted on at most about SAMPLE labelled rows, chosen by a hash of the id; scoring covers all texts. Cases:
null and empty texts score what a text without words scores. Label rows with a null label or id, or without a
document, teach nothing; a document with several labels counts as toxic if any of them says so. If the labels hold one
class only, or none, every score is that class's smoothed share (0 without labels). Repeated rows teach and are scored as
often as they stand. Columns besides those named are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.filters import keep_rows
from quirelab.llm.rows import map_rows
from quirelab.session import discard, materialise

#: Labelled rows to fit on, places of features, letters of a word's beginning, words that a worker keeps.
SAMPLE, DIMENSIONS, STEM, KEPT = 20_000, 1 << 17, 5, 200_000
#: Chi-square at which a place weighs half; L2 penalty of all rows together, counterfactual penalty; rounds over the rows, rows
#: of a step, Adam's step and the gradient below which steps shrink.
HALF, RIDGE, FAIRNESS, ROUNDS, BATCH, RATE, SMALL = 15.0, 0.3, 1.0, 20, 512, 0.5, 0.01

#: Terms of one kind that may stand for each other.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("musulmán", "cristiano", "judío", "hindú", "ateo"),
    ("musulman", "chrétien", "juif", "hindou", "athée"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "atheistisch"),
    ("mujeres", "hombres"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
)
_SWAPS = {w: tuple(x for x in kind if x != w) for kind in IDENTITY for w in kind}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_in(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def counterfactuals(text: str | None) -> list[tuple[list[str], list[str]]]:
    """The words of each sentence that names a group, and of that sentence with one term swapped, for each swap."""
    out = []
    for sentence in _SENTENCE.split(text or ""):
        words = words_in(sentence)
        for term in sorted(_SWAPS.keys() & set(words)):
            out += [(words, [other if w == term else w for w in words]) for other in _SWAPS[term]]
    return out


class Features:
    """The places of texts' features; what is known of a word is looked up once while the worker keeps it."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, words: list[str]) -> np.ndarray:
        """Different places, ascending."""
        known = self.known
        if len(known) > KEPT:
            known.clear()
        words = set(words)
        for w in words.difference(known):
            word = xxhash.xxh64_intdigest(w) % DIMENSIONS
            known[w] = word, xxhash.xxh64_intdigest(f"{w[:STEM]}*") % DIMENSIONS if len(w) > STEM else word
        return np.unique(np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int64))


@dataclass
class Model:
    bias: float
    weights: np.ndarray | None = None
    constant: float | None = None

    def scorer(self):
        """A function from texts to scores."""
        features = Features()

        def of(text: str | None) -> float:
            if self.constant is not None:
                return self.constant
            z = self.bias + float(self.weights[features.of(words_in(text))].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return lambda texts: [of(t) for t in texts]


class _Lists:
    """Lists of places one after another."""

    def __init__(self, lists: list[np.ndarray]):
        self.flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For these lists, the number of the list and the place of each entry."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        row = np.repeat(np.arange(len(rows)), sizes)
        return row, self.flat[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.ends[rows], sizes)]


def association(y: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """chi / (chi + HALF) for each place, of the chi-square of its presence against the label."""
    n1, n0 = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for label, x in zip(y, rows):
        (n1 if label else n0)[x] += 1
    ones, n = y.sum(), len(y)
    both, held = n1 * (n - ones - n0) - n0 * (ones - n1), n0 + n1
    chi = n * both * both / np.maximum(held * (n - held) * ones * (n - ones), 1e-9)
    return chi / (chi + HALF)


def train(y: np.ndarray, rows: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Adam on mean logistic loss + ridge + FAIRNESS * mean squared log-odds differences of the pairs, by small steps in an
    order that is fixed; the weights of the second half of the steps are averaged."""
    share = association(y, rows)
    own = _Lists(rows)
    plus, minus = _Lists([np.setdiff1d(b, a) for a, b in pairs]), _Lists([np.setdiff1d(a, b) for a, b in pairs])
    rng = np.random.default_rng(8)
    steps = -(-len(y) // BATCH)
    w, b = np.zeros(DIMENSIONS), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    mean, total, done = np.zeros(DIMENSIONS + 1), ROUNDS * steps, 0
    add = lambda row, at, e: np.bincount(at, e[row], DIMENSIONS)
    for _ in range(ROUNDS):
        for batch, some in zip(np.array_split(rng.permutation(len(y)), steps), np.array_split(rng.permutation(len(pairs)), steps)):
            done += 1
            row, at = own.part(batch)
            scaled = w * share
            e = (1 / (1 + np.exp(-np.clip(b + np.bincount(row, scaled[at], len(batch)), -40, 40))) - y[batch]) / len(batch)
            g = add(row, at, e)
            if len(some):
                (prow, pat), (mrow, mat) = plus.part(some), minus.part(some)
                d = 2 * FAIRNESS / len(some) * (np.bincount(prow, scaled[pat], len(some)) - np.bincount(mrow, scaled[mat], len(some)))
                g += add(prow, pat, d) - add(mrow, mat, d)
            g = np.append(g * share + RIDGE / len(y) * w, e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = RATE * (1 - 0.9 * done / total) * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + SMALL)
            w, b = w - move[:-1], b - move[-1]
            if done > total // 2:
                mean += np.append(w, b)
    mean /= total - total // 2
    return Model(float(mean[-1]), mean[:-1] * share)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """labels: id_col and label_col (0 or 1). What comes to the driver: the places of about `sample` rows' features."""
    clean = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    one = clean.groupBy("_id").agg(F.max((F.col("_y") > 0).cast("int")).alias("_y"))
    n = one.count()
    share = min(1.0, sample / max(1, n))
    chosen = one.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The chosen rows are about `sample` at most, whatever the input.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_y", F.col("_text"))
    rows = materialise(texts, "toxic-sample")

    places = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", places), T.StructField("own", T.ArrayType(places)), T.StructField("other", T.ArrayType(places))])

    def make():
        features = Features()

        def call(ys, texts):
            pairs = [[(features.of(a), features.of(b)) for a, b in counterfactuals(t)] for t in texts]
            return ys, [features.of(words_in(t)) for t in texts], [[a for a, _ in p] for p in pairs], [[b for _, b in p] for p in pairs]

        return call

    found = map_rows(rows, ["_y", "_text"], schema, make).toArrow()
    discard(rows)
    y = found["y"].to_numpy().astype(np.float64)
    n1 = int(y.sum())
    if n1 in (0, len(y)):
        return Model(0.0, constant=n1 / (len(y) + 1))
    lists = lambda column: [np.asarray(x, np.int64) for x in column.to_numpy()]
    x = lists(found["x"])
    # Partitions come in any order.
    order = sorted(range(len(y)), key=lambda i: (y[i], x[i].tobytes()))
    pairs = [(np.array(a, np.int64), np.array(b, np.int64)) for i in order for a, b in zip(found["own"][i].as_py(), found["other"][i].as_py())]
    return train(y[order], [x[i] for i in order], pairs)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each text: id, the columns in keep, score."""
    fields = [docs.schema[c] for c in (id_col, *keep)]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("score", T.DoubleType())])
    text = F.col(text_col).alias("_quire_text")

    def make():
        of = model.scorer()
        return lambda *columns: (*columns[:-1], of(columns[-1]))

    return map_rows(docs.select(*(docs[c] for c in (id_col, *keep)), text), [id_col, *keep, "_quire_text"], schema, make)


def keep_below(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """docs without the texts that score `limit` or more."""

    def make():
        of = model.scorer()
        return lambda texts: [x < limit for x in of(texts)]

    return keep_rows(docs, text_col, make)
