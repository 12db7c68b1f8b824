"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each rotated
by the letter's place in the n-gram; a text's vector bundles (adds) those of its n-grams. A language's prototype bundles
its training texts, each with the same weight. A text gets the language whose prototype has the largest cosine with it;
of equal cosines, the least language by name.

Letters are what str.isalpha() says, lower-cased; anything else between letters counts as one space, and one stands at
either end. Cases: a null text, or one without letters, is `und` with score 0; so is every text if there is nothing to
learn from. Training rows with a null language or without letters teach nothing. A null id stays null. Repeated rows
teach and are labelled as often as they stand. Columns besides those named are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.filters import add_columns
from quirelab.llm.rows import map_rows
from quirelab.session import materialise

NGRAM, DIMENSIONS, SEED = 3, 1024, 20_240_607
#: n-gram vectors that a worker keeps (int8, so at most 40 MB), and codes of n-grams that it counts at once.
KEPT = 40_000
UNKNOWN = "und"
#: keep_known: the share of a language's own texts that stand for its least typical ones, by what factor a text may lie below
#: them, the texts that a size needs for a limit of its own, and steps of the cosine.
LEAST_TYPICAL, FACTOR, ENOUGH, STEPS = 0.005, 0.6, 50, 500

_LOWER_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else 32."""
    global _LOWER_LETTER
    if _LOWER_LETTER is None:
        _LOWER_LETTER = np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)
    return _LOWER_LETTER


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a letter) of a text's n-grams, ascending, and how often each stands."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not text:
        return none
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    letter = points != 32
    if not letter.any():
        return none
    padded = np.full(len(points) + 2, 32, np.uint32)
    padded[1:-1] = points
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    x = padded[keep].astype(np.uint64)
    if len(x) < NGRAM:
        return none
    codes = x[: len(x) - NGRAM + 1].copy()
    for k in range(1, NGRAM):
        codes = codes << np.uint64(21) | x[k : len(x) - NGRAM + 1 + k]
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


class Space:
    """The random vectors; they depend on SEED and the letters only, so that every worker has the same."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, DIMENSIONS), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng((SEED, point)).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1
        return self.letters[point]

    def ngram(self, code: int) -> np.ndarray:
        bound = np.ones(DIMENSIONS, np.int8)
        for k in range(NGRAM):
            bound = bound * np.roll(self.letter(code >> 21 * (NGRAM - 1 - k) & 0x1FFFFF), k)
        return bound

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIMENSIONS)
        for at in range(0, len(codes), 2048):
            part = codes[at : at + 2048].tolist()
            rows = self.rows
            if len(rows) + len(part) > KEPT:
                rows.clear()
            index = []
            for c in part:
                r = rows.get(c)
                if r is None:
                    r = rows[c] = len(rows)
                    if r >= len(self.vectors):
                        self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                    self.vectors[r] = self.ngram(c)
                index.append(r)
            total += counts[at : at + 2048].astype(np.float32) @ self.vectors[index].astype(np.float32)
        return total


_SPACE: Space | None = None


def _space() -> Space:
    global _SPACE
    if _SPACE is None:
        _SPACE = Space()
    return _SPACE


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Each language's prototype, of unit length. Per partition and language, n-gram shares are summed and bundled once;
    DIMENSIONS sums a language come to the driver."""

    def make():
        shares: dict[str, dict[int, float]] = {}
        vectors: dict[str, np.ndarray] = {}

        def settle():
            for lang, share in shares.items():
                codes = np.fromiter(share.keys(), np.uint64, len(share))
                vectors[lang] = vectors.get(lang, 0) + _space().bundle(codes, np.fromiter(share.values(), np.float64, len(share)))
            shares.clear()

        def call(langs, texts):
            for lang, text in zip(langs, texts):
                codes, counts = ngram_counts(text)
                if not len(codes):
                    continue
                share = shares.setdefault(lang, {})
                for c, v in zip(codes.tolist(), (counts / np.sqrt((counts * counts).sum())).tolist()):
                    share[c] = share.get(c, 0.0) + v
            if sum(map(len, shares.values())) > 200_000:
                settle()

        def finish():
            settle()
            for lang, v in vectors.items():
                yield [lang] * DIMENSIONS, list(range(DIMENSIONS)), np.round(v * 1024).astype(np.int64).tolist()

        call.finish = finish
        return call

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("v", T.LongType())])
    sums = map_rows(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL"), ["lang", "text"], schema, make)
    found: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["v"]
    return {k: found[k] / n for k in sorted(found) if (n := np.linalg.norm(found[k]))}


def _best(matrix: np.ndarray, names: list[str], text: str | None) -> tuple[str, float]:
    codes, counts = ngram_counts(text)
    if not len(codes) or not names:
        return UNKNOWN, 0.0
    v = _space().bundle(codes, counts)
    cosines = matrix @ v / max(np.linalg.norm(v), 1e-12)
    k = int(cosines.argmax())
    return names[k], min(1.0, max(0.0, float(cosines[k])))


def _matrix(profiles: dict[str, np.ndarray]) -> tuple[np.ndarray, list[str]]:
    names = list(profiles)
    return np.array([profiles[k] for k in names]).reshape(len(names), DIMENSIONS), names


def limits(counts: list[tuple[int, int, int]]) -> list[float]:
    """counts: (size, step of the cosine, texts) of labelled texts. The least cosine for each size up to the largest: FACTOR
    times what LEAST_TYPICAL of its texts stay below; for sizes with few texts that of the next smaller size, or 0."""
    by_size: dict[int, dict[int, int]] = {}
    for size, step, n in counts:
        by_size.setdefault(size, {})[step] = n
    out, last = [], 0.0
    for size in range(max(by_size, default=-1) + 1):
        steps = by_size.get(size, {})
        total = sum(steps.values())
        if total >= ENOUGH:
            below = 0
            for step in sorted(steps):
                below += steps[step]
                if below > LEAST_TYPICAL * total:
                    last = FACTOR * step / STEPS
                    break
        out.append(last)
    return out


def keep_known(docs: DataFrame, profiles: dict[str, np.ndarray], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """docs without texts that have no letters and texts that are in none of the languages: their best cosine is below a limit
    that all texts with a language teach, by the doubling of their number of different n-grams, so that short texts are judged
    like short texts and a text that repeats itself like a short one. Without languages, only texts without letters go."""
    matrix, names = _matrix(profiles)
    cosine, size = (f"{name}_{'_'.join(docs.columns)}" for name in ("cosine", "size"))

    def make():
        def call(texts):
            found = [_best(matrix, names, t)[1] for t in texts]
            return found, [len(ngram_counts(t)[0]).bit_length() - 1 for t in texts]

        return call

    told = materialise(add_columns(docs, text_col, [T.StructField(cosine, T.DoubleType()), T.StructField(size, T.IntegerType())], make), "languages")
    step = F.floor(F.col(f"`{cosine}`") * STEPS).cast("int")
    counted = told.where(F.col(f"`{lang_col}`").isNotNull() & (F.col(f"`{size}`") >= 0)).groupBy(F.col(f"`{size}`").alias("size"), step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    least = limits([tuple(r) for r in counted.collect()]) if names else []
    # A size beyond all labelled ones has the limit of the largest.
    limit = F.element_at(F.array(*map(F.lit, least)), F.least(F.col(f"`{size}`") + 1, F.lit(len(least)))) if least else F.lit(0.0)
    return told.where((F.col(f"`{size}`") >= 0) & (F.col(f"`{cosine}`") >= limit)).select(*(F.col(f"`{c}`") for c in docs.columns))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each text: id, the columns in keep, lang_pred, score (the cosine, 0 if it is negative)."""
    matrix, names = _matrix(profiles)
    fields = [docs.schema[c] for c in (id_col, *keep)]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        def call(*columns):
            found = [_best(matrix, names, text) for text in columns[-1]]
            return *columns[:-1], [lang for lang, _ in found], [score for _, score in found]

        return call

    text = F.col(text_col).alias("_quire_text")
    return map_rows(docs.select(*(docs[c] for c in (id_col, *keep)), text), [id_col, *keep, "_quire_text"], schema, make)
