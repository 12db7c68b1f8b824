"""Audit of how far the sources of a language differ in their words.

Texts are cut by bytes: a lookup table over the concatenated UTF-8 buffer of many texts lower-cases and finds the borders of
terms, xxhash groups the slices, and every slice is compared byte by byte with its group's first one, so that a collision
splits the group instead of joining two terms. Counts are kept as sparse rows (source by term). Distances between sources
are sums over stored cells only, by reduceat over rows; terms that neither source has are told in closed form.

A language keeps the terms in at least min_docs of its documents. Every source of it, and the language as a whole, gives each
kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)), with N its occurrences of kept terms and V their number. All arithmetic
is in whole numbers.

Cases: null texts, languages and sources count as the empty string. A source without kept terms has equal p for all terms; a
language without kept terms has distances of 0 and no term rows; a language with one source has no pairs. Every row is a
document, repeated rows and ids too. Texts of any length are read whole. Ties rank by the item's bytes. An empty table gives
no rows. Columns besides the three named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.rows import settle, slices
from quirelab.session import discard, materialise, ship

#: Bytes of text in one pass of the tokenizer; a longer text stands alone.
PASS = 2 << 20
#: Terms and cells that a task holds before it hands them on.
HELD_TERMS, HELD_CELLS = 400_000, 1_500_000
#: Cells of a bucket of terms, sources on a side of a tile, and groups up to which their numbers are broadcast.
BUCKET, TILE, BROADCAST_GROUPS = 20_000, 512, 100_000
#: The fixed values of p.
SCALE, PRIOR = 1_000_000_000, 5

#: A byte's lower-case form if it belongs to terms, else 0.
TABLE = np.zeros(256, np.uint8)
TABLE[0x80:] = np.arange(0x80, 0x100)
TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)

_STEP = 1 << 16


class Terms:
    """The terms of concatenated texts: which document each stands in, its number, and the bytes of each number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest):
        """data: bytes of all texts; offsets: where each begins, and the end."""
        low = TABLE[data]
        inside = low != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        # Texts that touch are borders, too.
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        raw = low.tobytes()
        self.doc = np.searchsorted(offsets[1:], start, "right")
        hashes = np.empty(len(start), np.uint64)
        for at in range(0, len(start), _STEP):
            some = slice(at, at + _STEP)
            hashes[some] = [digest(raw[a:b]) for a, b in zip(start[some].tolist(), end[some].tolist())]
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        wrong = self._differing(low, start, end - start, first[number])
        if len(wrong):
            extra: dict[bytes, int] = {}
            for k in wrong.tolist():
                number[k] = len(self.words) + extra.setdefault(raw[start[k] : end[k]], len(extra))
            self.words += extra
        self.number = number

    @staticmethod
    def _differing(low: np.ndarray, start: np.ndarray, length: np.ndarray, model: np.ndarray) -> np.ndarray:
        """Terms whose bytes are not those of their model."""
        out = []
        for at in range(0, len(start), _STEP):
            s, n, m = start[at : at + _STEP], length[at : at + _STEP], model[at : at + _STEP]
            same = n == length[m]
            s, n, m = s[same], n[same], m[same]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            off = low[np.repeat(s, n) + within] != low[np.repeat(start[m], n) + within]
            place = np.flatnonzero(same)
            out += [at + np.flatnonzero(~same), at + place[np.unique(np.repeat(np.arange(len(n)), n)[off])]]
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)

    def cells(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows by the documents' groups: group, term, occurrences, documents."""
        docs, terms = int(self.doc.max(initial=0)) + 1, max(1, len(self.words))
        order = np.sort((group[self.doc] * terms + self.number) * docs + self.doc)
        cell = order // docs
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        new_doc = (np.diff(order, prepend=-1) != 0).astype(np.int64)
        occurrences = np.diff(at, append=len(order))
        return cell[at] // terms, cell[at] % terms, occurrences, np.add.reduceat(new_doc, at) if len(at) else occurrences


class _Counter:
    """Sums cells over passes, and gives them out before there are too many."""

    def __init__(self, held_terms: int, held_cells: int):
        self.held_terms, self.held_cells = held_terms, held_cells
        self.clear()

    def clear(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, langs: list[str | None], sources: list[str | None], terms: Terms) -> None:
        groups = self.groups
        group = np.array([groups.setdefault((a or "", b or ""), len(groups)) for a, b in zip(langs, sources)], np.int64)
        g, t, n, d = terms.cells(group)
        known = self.terms
        number = np.fromiter((known.setdefault(w, len(known)) for w in terms.words), np.int64, len(terms.words))
        self.parts.append(np.stack([g << 32 | number[t], n, d]) if len(g) else np.empty((3, 0), np.int64))
        self.held += len(g)
        if self.held > self.held_cells:
            self.sum_up()

    def sum_up(self) -> None:
        key, n, d = np.concatenate(self.parts, axis=1) if self.parts else np.empty((3, 0), np.int64)
        order = key.argsort(kind="stable")
        key = key[order]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        self.parts = [np.stack([key[at], np.add.reduceat(n[order], at), np.add.reduceat(d[order], at)])] if len(at) else []
        self.held = len(at)

    def full(self) -> bool:
        return len(self.terms) > self.held_terms or self.held > self.held_cells

    def give(self) -> Iterator[pa.RecordBatch]:
        self.sum_up()
        if self.parts:
            key, n, d = self.parts[0]
            words = pa.array(list(self.terms), pa.binary()).view(pa.string())
            langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
            for at in range(0, len(key), _STEP):
                some = slice(at, at + _STEP)
                g, t = pa.array(key[some] >> 32), pa.array(key[some] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), words.take(t), pa.array(n[some]), pa.array(d[some])], names=["lang", "source", "term", "n", "docs"])
        self.clear()


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text begins."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def term_cells(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents); a cell may stand in several rows, whose numbers add up."""
    ship(docs.sparkSession)
    schema = "lang string, source string, term string, n long, docs long"
    limits = HELD_TERMS, HELD_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(*limits)
        for batch in batches:
            for part in slices(batch, rows=4096, size=PASS):
                counter.add(part.column(0).to_pylist(), part.column(1).to_pylist(), Terms(*_buffer(part.column(2))))
                if counter.full():
                    yield from counter.give()
        yield from counter.give()
        settle()

    return docs.select(*(docs[c].cast("string") for c in (lang_col, source_col, text_col))).mapInArrow(run, schema)


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR v)) exactly, also beyond 64 bits."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.when(v > 0, F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + PRIOR), whole(total + PRIOR * v)) + 1).otherwise(F.lit(0)).cast("long")


def _tile(table: pa.Table, tile: int) -> pa.Table:
    """For each pair of sources of a tile: the sum over this bucket's terms of what |p - q| is over |z - z'| of terms that
    neither has. Rows without a term tell the z of every source of the tile."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    lang = table["lang"][0]
    at, p, side = table["at"].to_numpy(), table["p"].to_numpy(), table["at"].to_numpy() // tile
    zero = table["term"].is_null().to_numpy()
    term = table["term"].combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy(zero_copy_only=False)
    terms = int(term.max(initial=0)) + 1

    def rows(block: int):
        """Sources of the block in order, their z, and their cells as sparse rows."""
        of_z, of_cells = np.flatnonzero(zero & (side == block)), np.flatnonzero(~zero & (side == block))
        of_z = of_z[at[of_z].argsort(kind="stable")]
        of_cells = of_cells[at[of_cells].argsort(kind="stable")]
        return at[of_z], p[of_z], np.searchsorted(at[of_cells], at[of_z]), np.searchsorted(at[of_cells], at[of_z], "right"), term[of_cells], p[of_cells]

    left, z, begin, end, columns, values = rows(i)
    right, z_right, begin_right, end_right, columns_right, values_right = rows(j)
    filled = begin < end
    of_row = np.repeat(np.arange(len(left)), end - begin)
    a, b, sums = [], [], []
    for k in range(len(right)):
        own, at_terms = values_right[begin_right[k] : end_right[k]], columns_right[begin_right[k] : end_right[k]]
        dense = np.full(terms, z_right[k])
        dense[at_terms] = own
        total = np.zeros(len(left), np.int64)
        if len(values):
            other = dense[columns]
            total[filled] = np.add.reduceat(np.abs(values - other) - np.abs(z[of_row] - other), begin[filled])
        if len(own):
            # The sum of |p - z| over own cells for every z at once, from sorted values and their running sums.
            order = np.sort(own)
            running = np.concatenate([[0], np.cumsum(order)])
            below = np.searchsorted(order, z)
            total += z * below - running[below] + (running[-1] - running[below]) - z * (len(order) - below) - len(order) * np.abs(z - z_right[k])
        keep = np.flatnonzero((left < right[k]) & (total != 0))
        a.append(left[keep])
        b.append(np.full(len(keep), right[k]))
        sums.append(total[keep])
    join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
    found = join(a)
    return pa.table({"lang": pa.array([lang.as_py()] * len(found), pa.string()), "a": found, "b": join(b), "part": join(sums)})


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: for each source its distance from every other one of the language (part pair)
    and the top terms that it uses more than the language does (part term)."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    cells = materialise(term_cells(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "cells")
    terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs).drop("docs")
    kept = materialise(cells.drop("docs").join(terms, ["lang", "term"]), "kept-terms")
    discard(cells)
    # V and N of a language from its kept terms, N of a source from its cells.
    by_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = groups.withColumn("z", _share(F.lit(0), F.col("total"), F.col("v"))).withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = materialise(groups, "groups")
    size = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("at").alias("last")).first()
    last = size["last"] or 0
    small = F.broadcast(groups) if size["groups"] <= BROADCAST_GROUPS else groups
    rows = kept.join(small, ["lang", "source"])
    rows = rows.select("lang", "source", "term", "at", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    said = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    said = said.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    blocks = last // TILE + 1
    count = kept.count()
    buckets = max(1, count // max(BUCKET, min(last + 1, TILE) ** 2))
    dealt = rows.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "at", "term", "p")
    zeros = groups.where("v > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), "at", F.lit(None).cast("string").alias("term"), F.col("z").alias("p"))
    both = dealt.union(zeros)
    block = F.floor(F.col("at") / TILE).cast("int")
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("lang", "bucket", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), "at", "term", "p")
    ship(spark)
    tile = TILE
    sums = both.groupBy("lang", "bucket", "i", "j").applyInArrow(lambda table: _tile(table, tile), "lang string, a long, b long, part long").groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    sums = materialise(sums, "distances")
    one = groups.select("lang", "source", F.col("at").alias("x"), F.col("z").alias("zx"), "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("y"), F.col("z").alias("zy"))
    pairs = one.join(two, "lang").where("x <> y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce("part", F.lit(0)) + F.col("v") * F.abs(F.col("zx") - F.col("zy"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(best))
    return pairs.union(said)


#: The same rows by DuckDB.
SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
 df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
 c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM (SELECT lang, source, unnest(ws) AS term FROM d) w JOIN df ON df.lang = w.lang AND df.term = w.term GROUP BY ALL),
 lc AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
 l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM lc GROUP BY lang),
 g AS (SELECT x.lang, x.source, coalesce(y.total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) y USING (lang, source)),
 p AS (SELECT g.lang, g.source, lc.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (lc.n + 5)) // (l.total + 5 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN lc USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = lc.term),
 e AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(e.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""
