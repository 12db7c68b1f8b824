"""Near copies among texts by improved consistent weighted sampling over TF-IDF shingles.

Texts with the same words in the same order are one class from the start. Each class has SAMPLES consistent weighted samples
(Ioffe's improved scheme: two texts agree in a sample with a probability that is their weighted Jaccard similarity), banded
by ROWS: at a similarity of 0.8, fewer than 3 in 100,000 pairs agree in no band. Classes that agree in a band share a bucket.

In a first round each member of a bucket is compared with the bucket's most central member only, the one that meets the most
others over all its buckets; a large group of copies is mostly linked by that. In a second round, buckets that still hold
several components compare their members across components, in tiles of sketches, and texts are sent only for members whose
sketches agree. Pairs whose samples agree too rarely are left out in
both rounds; at 0.8 that takes an agreement over three and a half standard deviations below the mean. All others are
compared exactly by weighted Jaccard similarity. Components of the links are the groups; every text in a group has its id.

Cases: null and empty texts and texts without words are copies of nothing, each a group of its own. Texts of one to four
words are one shingle. A group's id is its least id that is not null; of a group's rows, one with that id is kept (of rows
with equal ids and texts also one). A row with a null id and no copies is kept, too. Columns besides the two named are
ignored by near_copies; drop_copies keeps them all, whatever their names.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.graph import components
from quirelab.llm.rows import map_rows
from quirelab.llm.words import Shingler, inverse_frequencies, mix, similarity, words_of
from quirelab.session import discard, materialise, ship

SIMILARITY = 0.8
ROWS, BANDS = 4, 20
SAMPLES = ROWS * BANDS
#: Standard deviations of the sampled agreement below the wanted similarity at which a pair is not compared.
DEVIATIONS = 3.5
#: Rows of a bucket on either side of a tile.
TILE = 1000
#: Shingles that a tile holds at once (16 bytes each).
TILE_SHINGLES = 2_000_000
#: Texts whose shingles a worker keeps while it compares.
KEPT = 64

_TABLE = 1 << 16
#: Weights up to 2 are taken to the nearest of these steps of a doubling, so that the scheme's values can be looked up.
_STEPS = 24


def _tables() -> tuple[np.ndarray, ...]:
    """r, ln c and beta of the scheme, by 16 bits of a shingle's and a sample's hash; ln a and the level by weight step, too."""
    rng = np.random.default_rng(20_100)
    r, log_c, beta = np.maximum(rng.gamma(2, 1, _TABLE), 1e-6), np.log(rng.gamma(2, 1, _TABLE)), rng.random(_TABLE)
    level = np.floor(np.arange(_STEPS + 1)[:, None] * np.log(2) / _STEPS / r + beta)
    return r, log_c, beta, (log_c - r * (level - beta + 1)).astype(np.float32).ravel(), level.astype(np.int32).ravel()


_R, _LOG_C, _BETA, _LOG_A, _LEVEL = _tables()
_ODD = np.random.default_rng(20_101).integers(1 << 62, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)


def samples(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """SAMPLES consistent weighted samples, each a 64-bit hash of the shingle and the level that were drawn."""
    h, w = bag
    best = np.full(SAMPLES, np.inf)
    out = np.zeros(SAMPLES, np.uint64)
    rows = np.arange(SAMPLES)
    light = w <= 2
    for looked_up, every, weight in ((True, h[light], w[light]), (False, h[~light], w[~light])):
        for at in range(0, len(every), 2048):
            part, log_w = every[at : at + 2048], np.log(weight[at : at + 2048])
            k = ((part[None, :] * _ODD[:, None]) >> np.uint64(48)).view(np.int64)
            if looked_up:
                k += np.rint(log_w * (_STEPS / np.log(2))).astype(np.int64) * _TABLE
                a = _LOG_A.take(k)
                least = a.argmin(1)
                level = _LEVEL.take(k[rows, least])
            else:
                level = np.floor(log_w / _R[k] + _BETA[k])
                a = _LOG_C[k] - _R[k] * (level - _BETA[k] + 1)
                least = a.argmin(1)
                level = level[rows, least]
            value = a[rows, least]
            drawn = mix(part[least] ^ mix(level.astype(np.int64).astype(np.uint64) + _ODD))
            out = np.where(value < best, drawn, out)
            best = np.minimum(value, best)
    return out


def _bands(drawn: np.ndarray) -> list[int]:
    x = np.arange(BANDS, dtype=np.uint64)
    for column in drawn.reshape(BANDS, ROWS).T:
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + column)
    return x.astype(np.int64).tolist()


def _text_hash(col: str) -> Column:
    return F.xxhash64(F.col(col))


def _sketches(docs: DataFrame, frequencies) -> DataFrame:
    """id, text_hash, class (16 bytes, null without words), short (2 bytes of each sample) and bands."""
    schema = T.StructType([docs.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("short", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def make():
        shingler = Shingler(frequencies)
        seen: OrderedDict[bytes, tuple[bytes, list[int]]] = OrderedDict()

        def call(ids, hashes, texts):
            classes, short, bands = [], [], []
            for text in texts:
                words = words_of(text)
                if not words:
                    classes.append(None)
                    short.append(None)
                    bands.append(None)
                    continue
                name = xxhash.xxh3_128_digest(b" ".join(words))
                if name not in seen:
                    drawn = samples(shingler.bag(words))
                    seen[name] = (drawn & np.uint64(0xFFFF)).astype("<u2").tobytes(), _bands(drawn)
                    if len(seen) > 2000:
                        seen.popitem(last=False)
                classes.append(name)
                short.append(seen[name][0])
                bands.append(seen[name][1])
            return ids, hashes, classes, short, bands

        return call

    return map_rows(docs, ["id", "text_hash", "text"], schema, make)


def _floor(wanted: float) -> int:
    """Agreeing samples below which a pair is not compared."""
    return int(np.floor(SAMPLES * wanted - DEVIATIONS * np.sqrt(SAMPLES * wanted * (1 - wanted))))


def _agreeing(pairs: DataFrame, sketches: DataFrame, floor: int) -> DataFrame:
    """The pairs (a, b) that agree in at least `floor` samples."""
    pairs = pairs.join(sketches.select(F.col("node").alias("a"), F.col("short").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("short").alias("sb")), "b")

    def make():
        def call(a, b, sa, sb):
            x, y = (np.frombuffer(b"".join(s), "<u2").reshape(-1, SAMPLES) for s in (sa, sb))
            keep = np.flatnonzero((x == y).sum(1) >= floor).tolist()
            return [a[k] for k in keep], [b[k] for k in keep]

        return call

    return map_rows(pairs, ["a", "b", "sa", "sb"], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]), make)


def _tiles(placed: DataFrame) -> DataFrame:
    """placed: (h, band, node, component). Rows (h, i, j, band, node, component, chunk) of the tiles in which members of a bucket
    from different components meet. A bucket's largest component need not meet itself: its members are dealt into chunks of
    their own, and only the other members meet all chunks, so that a bucket costs (other members) x (members) at most."""
    parts = placed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("h").agg(F.sum("n").alias("n"), F.max(F.struct("n", F.col("component").alias("main"))).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    chunks = lambda n: F.ceil(n / TILE).cast("int")
    sizes = sizes.select("h", F.col("top.main").alias("main"), chunks(F.col("n") - F.col("top.n")).alias("others"), chunks(F.col("top.n")).alias("mains"))
    # Written first, so that Spark can split the bucket that holds very many members.
    sizes = materialise(sizes, "open")
    main = F.col("component") == F.col("main")
    chunk = F.when(main, F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    dealt = placed.join(sizes, "h").withColumn("chunk", chunk).withColumn("other", F.explode(meets))
    return dealt.select("h", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "band", "node", "component", "chunk")


def _meetings(table: pa.Table, floor: int):
    """For members of a tile in the order of the left side: (left member, right members that it meets, their agreeing
    samples); those of other components that agree in `floor` samples, in the first band in which the two meet."""
    i, j, band = (table[c][0].as_py() for c in ("i", "j", "band"))
    node, component, chunk = (table[c].to_numpy() for c in ("node", "component", "chunk"))
    short = np.frombuffer(b"".join(table["short"].to_pylist()), "<u2").reshape(-1, SAMPLES)
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    for x in left.tolist():
        ys = right[component[right] != component[x]]
        if i == j:
            ys = ys[node[ys] > node[x]]
        if len(ys):
            same = short[ys] == short[x]
            agree = same.sum(1)
            near = np.flatnonzero(agree >= floor)
            near = near[same[near].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]
            if len(near):
                yield x, ys[near], agree[near]


_TILE_KEY = ["h", "i", "j"]


def _across(tiles: DataFrame, sketches: DataFrame, texts: DataFrame, frequencies, floor: int, wanted: float) -> DataFrame:
    """Links between members of tiles that are in different components.

    Tiles of sketches alone tell which members meet another; only those come together again with their texts. A tile compares
    its pairs exactly, the likeliest first; a pair that links of the same tile already connect needs no comparison."""
    ship(tiles.sparkSession)
    tiles = tiles.join(sketches.select("node", "short"), "node")

    def members(table: pa.Table) -> pa.Table:
        met = np.zeros(table.num_rows, bool)
        for x, ys, _ in _meetings(table, floor):
            met[x] = True
            met[ys] = True
        return table.select([*_TILE_KEY, "band", "node", "component", "chunk", "short"]).filter(pa.array(met))

    kept = tiles.groupBy(*_TILE_KEY).applyInArrow(members, "h long, i int, j int, band int, node long, component long, chunk int, short binary")
    kept = materialise(kept, "meeting")

    def run(table: pa.Table) -> pa.Table:
        node, component = (table[c].to_numpy() for c in ("node", "component"))
        pairs = [np.column_stack([-agree, np.full(len(ys), x), ys]) for x, ys, agree in _meetings(table, floor)]
        every = np.concatenate(pairs) if pairs else np.empty((0, 3), np.int64)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        shingler = _shingler(frequencies)
        texts = table["text"]
        bags: OrderedDict[int, tuple] = OrderedDict()
        held = 0

        def bag(k: int) -> tuple:
            nonlocal held
            if k not in bags:
                bags[k] = shingler.bag(words_of(texts[k].as_py()))
                held += len(bags[k][0])
                while held > TILE_SHINGLES and len(bags) > 2:
                    held -= len(bags.popitem(last=False)[1][0])
            return bags[k]

        root = {c: c for c in np.unique(component).tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b, sims = [], [], []
        for _, x, y in every.tolist():
            p, q = find(int(component[x])), find(int(component[y]))
            if p != q and (sim := similarity(bag(x), bag(y))) >= wanted:
                root[max(p, q)] = min(p, q)
                a.append(int(node[x]))
                b.append(int(node[y]))
                sims.append(sim)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(sims, pa.float64())})

    return kept.join(texts, "node").groupBy(*_TILE_KEY).applyInArrow(run, "a long, b long, similarity double")


@lru_cache(maxsize=1)
def _shingler_of(frequencies: bytes) -> Shingler:
    return Shingler(np.frombuffer(frequencies, np.uint8))


def _shingler(frequencies) -> Shingler:
    """One for a worker, so that tiles share what it knows of words."""
    return _shingler_of(frequencies.tobytes())


def _compared(pairs: DataFrame, texts: DataFrame, frequencies, wanted: float) -> DataFrame:
    """The pairs (a, b) with a weighted Jaccard similarity of at least `wanted`."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def make():
        shingler = Shingler(frequencies)
        kept: OrderedDict[int, tuple] = OrderedDict()

        def bag(node, text):
            if node not in kept:
                kept[node] = shingler.bag(words_of(text))
                if len(kept) > KEPT:
                    kept.popitem(last=False)
            return kept[node]

        def call(a, b, ta, tb):
            sims = [similarity(bag(y, u), bag(x, t)) for x, y, t, u in zip(a, b, ta, tb)]
            keep = [k for k, s in enumerate(sims) if s >= wanted]
            return [a[k] for k in keep], [b[k] for k in keep], [sims[k] for k in keep]

        return call

    return map_rows(both, ["a", "b", "ta", "tb"], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())]), make, rows=64)


def _grouped(docs: DataFrame, wanted: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text_hash, class) and, for each class in a group of several rows, (class, group_id, keep_hash)."""
    floor = _floor(wanted)
    frequencies = inverse_frequencies(docs)
    rows = materialise(_sketches(docs, frequencies), "sketches")
    known = rows.where("class IS NOT NULL")
    # The row whose text stands for the class: its first by (id, text), null ids last.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first")
    classes = known.groupBy("class").agg(first, F.count(F.lit(1)).alias("copies"), F.first("short").alias("short"), F.first("bands").alias("bands"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    banded = classes.select("node", F.posexplode("bands").alias("band", "h"))
    # Written first: a join of two written tables can be split where one bucket holds very many classes.
    banded = materialise(banded, "banded")
    several = materialise(banded.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    buckets = materialise(banded.join(several, "h"), "buckets")
    central = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = materialise(buckets.join(central, "node").groupBy("h").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("hub")), "hubs")
    star = buckets.join(hubs, "h").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    star = materialise(_agreeing(star, classes, floor), "star")

    # Texts of all that share a bucket, fetched once.
    rows_of = classes.join(buckets.select("node").distinct(), "node").select("node", F.col("first.id").alias("k"), F.col("first.text_hash").alias("text_hash"))
    texts = docs.join(rows_of, docs["id"].eqNullSafe(rows_of["k"]) & (docs["text_hash"] == rows_of["text_hash"]))
    texts = materialise(texts.select("node", "text").dropDuplicates(["node"]), "texts")

    links = materialise(_compared(star, texts, frequencies, wanted), "links")
    reached = components(links.select("a", "b"))
    placed = buckets.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialise(placed.select("h", "band", "node", "component"), "placed")
    tiles = _tiles(placed)
    more = materialise(_across(tiles, classes, texts, frequencies, floor, wanted), "links")
    all_reached = components(links.select("a", "b").union(more.select("a", "b")))

    grouped = classes.select("class", "node", "first", "copies").join(all_reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = materialise(grouped, "grouped")
    heads = grouped.groupBy("component").agg(F.min("first").alias("head"), F.sum("copies").alias("rows")).where("rows > 1")
    told = grouped.join(heads, "component").select("class", F.col("head.id").alias("group_id"), F.col("head.text_hash").alias("keep_hash"))
    told = materialise(told, "told")
    for used in (classes, banded, several, placed, buckets, hubs, star, texts, links, reached, more, all_reached, grouped):
        discard(used)
    return rows, told


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _text_hash(text_col).alias("text_hash"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: float = SIMILARITY) -> DataFrame:
    """One row for each row: id, class_id (the group's least id), kept (whether the row is its group's first)."""
    rows, told = _grouped(_prepared(docs, id_col, text_col), wanted)
    out = rows.join(told, "class", "left")
    alone = F.col("keep_hash").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("group_id")).alias("class_id"),
        (alone | (F.col("id").eqNullSafe(F.col("group_id")) & (F.col("text_hash") == F.col("keep_hash")))).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group, and all rows that are in no group."""
    rows, told = _grouped(_prepared(docs, id_col, text_col), wanted)
    # Rows to drop are told by id and text, so that the documents' other columns need not travel with the comparison.
    out = rows.join(told, "class").withColumn("first", F.col("id").eqNullSafe(F.col("group_id")) & (F.col("text_hash") == F.col("keep_hash")))
    gone = out.where(~F.col("first")).select(F.col("id").alias("_quire_id"), F.col("text_hash").alias("_quire_hash")).distinct()
    keep = docs.join(gone, docs[id_col].eqNullSafe(gone["_quire_id"]) & (F.xxhash64(docs[text_col]) == gone["_quire_hash"]), "left_anti")
    # Of several rows with the first one's id and text, one stays.
    again = out.where("first").groupBy(F.col("id").alias("_quire_id"), F.col("text_hash").alias("_quire_hash")).agg(F.count(F.lit(1)).alias("_quire_n")).where("_quire_n > 1")
    again = materialise(again, "again")
    if again.isEmpty():
        return keep
    match = docs[id_col].eqNullSafe(again["_quire_id"]) & (F.xxhash64(docs[text_col]) == again["_quire_hash"])
    single = keep.join(again, match, "left_anti")
    several = keep.join(again, match, "left_semi")
    return single.unionByName(several.withColumn("_quire_hash", F.xxhash64(F.col(text_col))).dropDuplicates([id_col, "_quire_hash"]).drop("_quire_hash"))
