"""Matching, snippets, vectors and rank fusion."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.session import materialise, ship

#: Words that say nothing about a claim. Fixed values of this library's own.
COMMON = ("the", "and", "for", "that", "with")
RRF_K = 60


def normalised_query(raw: str) -> str:
    found = " ".join(raw.split())
    if not 1 <= len(found) <= 200:
        raise ValueError("a query has 1 to 200 characters")
    return found


def normalised_queries(raw: Column) -> Column:
    """normalised_query for a column; null where it would raise an error."""
    found = F.trim(F.regexp_replace(raw, r"\s+", " "))
    return F.when(F.length(found).between(1, 200), found)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, in order. Operators in a query are never interpreted."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def query_tokens(raw: str) -> list[str]:
    """The different tokens of a query, which are cut like a text's."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", normalised_query(raw).lower())))


def match(rows: DataFrame, text_col: str, raw_query: str) -> DataFrame:
    """Rows that hold every word of the query, with score: how often its words stand there. A query of marks matches nothing."""
    words = query_tokens(raw_query)
    if not words:
        return rows.where(F.lit(False)).withColumn("score", F.lit(0).cast("long"))
    # The substring test is cheap and lets few rows through to tokenising.
    maybe = reduce(lambda a, b: a & b, (F.contains(F.lower(F.col(text_col)), F.lit(w)) for w in words))
    found = rows.where(maybe).withColumn("_tokens", tokens(F.col(text_col)))
    every = reduce(lambda a, b: a & b, (F.array_contains("_tokens", w) for w in words))
    return found.where(every).withColumn("score", F.size(F.filter("_tokens", lambda t: t.isin(words))).cast("long")).drop("_tokens")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def snippet(text: Column, keyword: str, before: int = 60, size: int = 160) -> Column:
    """The text around the keyword's first place, escaped, with the keyword marked and an ellipsis where it is cut."""
    start = F.greatest(F.lit(1), F.locate(keyword.lower(), F.lower(text)) - before)
    quoted = "".join(c if c.isalnum() else f"\\{c}" for c in keyword)
    marked = F.regexp_replace(escape_html(F.substring(text, start, F.lit(size))), f"(?i){quoted}", "<mark>$0</mark>")
    return F.concat(F.when(start > 1, "…").otherwise(""), marked, F.when(F.length(text) >= start + size, "…").otherwise(""))


def paired_messages(messages: DataFrame) -> DataFrame:
    """pair_turn: of an assistant's message the nearest earlier user message of its thread, else the message itself."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return messages.withColumn("pair_turn", F.coalesce(F.when(F.col("role") == "assistant", asked), F.col("turn")))


def lexical_candidates(claims: DataFrame, claim_id: str, chunks: DataFrame, chunk_id: str, text_col: str, top_n: int) -> DataFrame:
    """For each claim the chunks with the most words in common, over the square root of both sizes' product.

    Joined through the words, so that chunks without a common word are never paired."""

    def words(rows: DataFrame, id_col: str, size: str) -> DataFrame:
        found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z_][a-z0-9_]{2,})"), 1), lambda t: ~t.isin(*COMMON)))
        return rows.select(id_col, found.alias("_w")).select(id_col, F.size("_w").alias(size), F.explode("_w").alias("_word"))

    pairs = words(claims, claim_id, "_a").join(words(chunks, chunk_id, "_b"), "_word")
    scored = pairs.groupBy(claim_id, chunk_id, "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    scored = scored.select(claim_id, chunk_id, F.round(F.col("_n") / F.sqrt(F.col("_a") * F.col("_b")), 6).alias("score"))
    w = Window.partitionBy(claim_id).orderBy(F.desc("score"), chunk_id)
    return scored.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_n).drop("_k")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


#: Vectors and queries on the two sides of a tile, and how many vectors of it are multiplied at once.
ROWS, QUERIES, AT_ONCE = 8192, 2048, 1024
#: What a product of matrices can differ from a sum in order, of vectors of length one.
ROUNDING = 1e-9


def _units(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: places of the vectors without nulls, and these vectors over their lengths, in rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[sizes >= 0]).tolist():
        places = np.nonzero(sizes == n)[0]
        flat = pc.list_flatten(column.take(pa.array(places))).cast(pa.float64())
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n).any(axis=1) if n else np.ones(len(places), bool)
        v = flat.to_numpy(zero_copy_only=False).reshape(len(places), n)[whole]
        norm = np.sqrt(_in_order(v, v))
        out[n] = places[whole], v / np.where(norm == 0, 1.0, norm)[:, None]
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added from the first component to the last, so that equal vectors have equal products everywhere."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _tile_nearest(queries: pa.Table, rows: pa.Table, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score, scored) by places: the tile's top_k rows of each query, with scores of pairs that have one first.

    A product of matrices finds what may be among them; their scores are then added in order."""
    rank = np.empty(rows.num_rows, np.int64)
    rank[pc.sort_indices(rows["id"].combine_chunks()).to_numpy()] = np.arange(rows.num_rows)
    by_rank = np.argsort(rank)
    ids, own = rows["id"].to_pylist(), {}
    query_ids = queries["id"].to_pylist()
    for k, i in enumerate(query_ids):
        own.setdefault(i, []).append(k)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    held = _units(rows["v"])
    size = np.full(queries.num_rows, -1)
    for n, (q_at, q) in _units(queries["v"]).items():
        size[q_at] = n
        x_at, x = held.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
        place = {int(p): k for k, p in enumerate(q_at)}
        least = np.full(len(q), -np.inf)
        for at in range(0, len(x), AT_ONCE):
            part, part_at = x[at : at + AT_ONCE], x_at[at : at + AT_ONCE]
            s = q @ part.T
            odd = ~np.isfinite(s)
            s[odd] = -np.inf
            allowed = np.ones(s.shape, bool)
            for j, p in enumerate(part_at.tolist()):
                for k in own.get(ids[p], ()):
                    if k in place:
                        allowed[place[k], j] = False
            s[~allowed] = -np.inf
            if s.shape[1] >= top_k:
                least = np.maximum(least, np.partition(s, -top_k, axis=1)[:, -top_k])
            i, j = np.nonzero(((s >= least[:, None] - ROUNDING) | odd) & allowed)
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                found.append(_best(q_at[a], part_at[b], _in_order(q[a], part[b]), rank, top_k))
        found = [_best(*(np.concatenate(c) for c in zip(*found)), rank, top_k)]
    i, j, s = found[0] if len(found) == 1 else _best(*(np.concatenate(c) for c in zip(*found)), rank, top_k)
    # Pairs without a score come last, by id.
    lengths = np.full(rows.num_rows, -1)
    for n, (x_at, _) in held.items():
        lengths[x_at] = n
    counts = np.bincount(i, minlength=queries.num_rows)
    more = []
    for k in np.nonzero(counts < top_k)[0].tolist():
        unscored = (p for p in by_rank.tolist() if (size[k] < 0 or lengths[p] != size[k]) and ids[p] != query_ids[k])
        more += [(k, p) for p in islice(unscored, top_k - int(counts[k]))]
    more = np.array(more, np.int64).reshape(-1, 2)
    scored = np.concatenate([np.ones(len(i), bool), np.zeros(len(more), bool)])
    return np.concatenate([i, more[:, 0]]), np.concatenate([j, more[:, 1]]), np.concatenate([s, np.zeros(len(more))]), scored


def _best(i: np.ndarray, j: np.ndarray, s: np.ndarray, rank: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, row, score) the top_k of each query: scores that are no numbers first, as Spark sorts them, ties by rank."""
    order = np.lexsort((rank[j], -s, ~np.isnan(s), i))
    i, j, s = i[order], j[order], s[order]
    starts = np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0)) if len(i) else i
    keep = np.arange(len(i)) - starts < top_k
    return i[keep], j[keep], s[keep]


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, top_k: int) -> DataFrame:
    """(query_id, id, similarity, rank): exact neighbours of each query vector, itself excluded, ties by id.

    All pairs are compared, in tiles of bounded size that are dealt to tasks; what a tile gives is its top_k of each query. A zero
    vector has cosine 0 with all. Pairs with a null vector or component, or of different numbers of components, have no cosine
    and come last. Null ids are in no pair."""
    ship(rows.sparkSession)
    sides = [r.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")) for r in (queries, rows)]
    n, m = (max(1, -(-side.count() // size)) for side, size in zip(sides, (QUERIES, ROWS)))
    own = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left, right = sides[0].select("id", "v", own(n).alias("i"), every(m).alias("j")), sides[1].select("id", "v", own(m).alias("j"), every(n).alias("i"))

    def compare(asking: pa.Table, held: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            i, j, s, scored = _tile_nearest(asking, held, top_k)
        return pa.table([asking["id"].take(pa.array(i)), held["id"].take(pa.array(j)), pa.array(s, pa.float64(), mask=~scored)], names=["query_id", id_col, "_s"])

    schema = f"query_id {queries.schema[id_col].dataType.simpleString()}, `{id_col}` {rows.schema[id_col].dataType.simpleString()}, _s double"
    out = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(compare, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("_s"), id_col)
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k).select("query_id", id_col, F.round("_s", 6).alias("similarity"), "rank")


def ranked(rows: DataFrame, id_col: str, order: Sequence[Column]) -> DataFrame:
    """(id, rank from 0) of a result list of any length: sorted by ranges, each range counted on from those before it."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("_at"))
    dealt = materialise(dealt, "ranked").select("id", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row"))
    counts = dealt.groupBy("_range").agg((F.max("_row") + 1).alias("_n"))
    # A row for each range, so as many as there are shuffle partitions at most.
    earlier = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    return dealt.join(F.broadcast(earlier), "_range").select("id", (F.col("_n") + F.col("_row")).alias("rank"))


def fuse(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank + 1) over the lists; a repeated id counts once, at its best rank."""
    parts = []
    for rows, weight in zip(lists, weights or [1.0] * len(lists)):
        best = rows.groupBy("id").agg(F.min("rank").alias("rank"))
        parts.append(best.select("id", (F.lit(weight) / (F.col("rank") + k + 1)).alias("part")))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("score"))


def match_types(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    a, b = lexical.select("id", F.lit(1).alias("_l")), semantic.select("id", F.lit(1).alias("_s"))
    kind = F.when(F.col("_l").isNull(), "semantic").when(F.col("_s").isNull(), "lexical").otherwise("both")
    return a.join(b, "id", "full").select("id", kind.alias("match_type"))


def searched(streams: Sequence[DataFrame], raw_query: str, near: DataFrame | None = None) -> DataFrame:
    """Items that any of the streams (kind, item, id, text) holds the query for, or that are near by meaning (item, rank from 0):
    item, fused, score, hits, top, match_type, the best first.

    An item's lexical rank is that of its best hit, ties by item; both rankings are fused. Items that are only near have score 0
    and no hits. Without `near` the lexical ranking decides alone."""
    hits = match(reduce(DataFrame.unionByName, streams), "text", raw_query)
    top = F.max_by("kind", F.struct("score", "kind")).alias("top")
    groups = hits.groupBy("item").agg(F.max("score").cast("double").alias("score"), F.count(F.lit(1)).alias("hits"), top)
    lexical = ranked(groups, "item", [F.desc("score"), F.col("item")])
    semantic = (near if near is not None else lexical.limit(0).withColumnRenamed("id", "item")).select(F.col("item").alias("id"), "rank")
    fused = fuse([lexical, semantic]).join(match_types(lexical, semantic), "id").select(F.col("id").alias("item"), F.round("score", 9).alias("fused"), "match_type")
    found = fused.join(groups, "item", "left")
    score, hits = F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits")
    return found.select("item", "fused", score, hits, "top", "match_type").orderBy(F.desc("fused"), "item")
