"""Search over positional postings in files.

An index has, for each segment, a table of rows (numbered; kind, item, id, at) and postings in folders by a hash of the term. A
row of postings has up to TERMS neighbouring terms of a folder and a block of rows: the terms, for each its largest count and
the sizes of what follows, the rows that hold it (steps from row to row, then how often), and its places (for each row the
first place and the gaps to the next ones); all whole numbers stand in seven bits a byte, terms and sizes are compressed. hits() reads the folders of its
query's words, of them the rows whose first and last term lie around a word, and no places. top() first reads the largest counts, which bound what a block can
score, and then the postings of those blocks that can still reach the k best. Items are replaced by writing another segment:
rows of an item in older segments are no hits any more.

Matching and scores are those of search.match: every word of the query must stand in the text, and the score says how often
its words do.

Cases: null and empty texts match nothing, but a replaced item whose new rows hold nothing is gone. Repeated rows are hits
each. A query of marks matches nothing. Null items are an item of their own, which replace() leaves as it is. Texts of any
length are read whole. An index of an empty table finds nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelab.operators import search
from quirelab.session import discard, fresh_path, materialise, ship

#: Rows of a block are 2^BLOCK; postings lie in so many folders of a segment.
BLOCK, BUCKETS = 10, 64
#: Tokens that are grouped at once, about.
TOKENS = 1 << 19
MADE = "block long, first string, last string, terms binary, sizes binary, coded binary, gaps binary"
POSTINGS = f"{MADE}, segment int, bucket int"
#: Terms of a row of postings.
TERMS = 64
#: Which kinds of hits a facet counts.
FACETS = {"body": ("source", "translation", "semantic"), "notes": ("note", "annotation"), "chat": ("chat", "question"), "article": ("article",)}
FACET_ITEMS = 20


@dataclass
class Index:
    spark: SparkSession
    path: str
    segments: int
    bits: int = BLOCK

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def postings(self, words: Sequence[str]) -> DataFrame:
        """Rows of postings that may have these terms: folders, row groups and rows of others are not read."""
        held = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        some = [(F.col("bucket") == zlib.crc32(w.encode()) % BUCKETS) & (F.col("first") <= w) & (F.col("last") >= w) for w in words]
        return held.where(reduce(lambda a, b: a | b, some, F.lit(False)))

    def alive(self, rows: DataFrame) -> DataFrame:
        """Of rows (segment, item) those of the newest segment that has the item."""
        if self.segments == 1:
            return rows
        newest = self.rows().groupBy("item").agg(F.max("segment").alias("_newest"))
        return rows.join(newest, rows["item"].eqNullSafe(newest["item"]), "left").where(rows["item"].isNull() | (F.col("segment") == F.col("_newest"))).select(rows["*"])


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of whole numbers from 0, and where each number's begin (and the end)."""
    longest = max(1, -(-int(values.max(initial=0)).bit_length() // 7))
    sizes = np.ones(len(values), np.int64)
    for k in range(1, longest):
        sizes += values >= 1 << 7 * k
    start = np.zeros(len(values) + 1, np.int64)
    np.cumsum(sizes, out=start[1:])
    out = np.empty(int(start[-1]), np.uint8)
    out[start[:-1]] = (values & 0x7F) | (sizes > 1) * 0x80
    for k in range(1, longest):
        more = np.flatnonzero(sizes > k)
        out[start[more] + k] = values[more] >> 7 * k & 0x7F | np.where(sizes[more] > k + 1, 0x80, 0)
    return out, start


def unpacked(data: bytes | np.ndarray) -> np.ndarray:
    """The whole numbers of packed bytes."""
    data = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(data < 0x80)
    start = np.append(0, last[:-1] + 1)[: len(last)]
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        more = np.flatnonzero(last - start >= k)
        out[more] |= (data[start[more] + k] & 0x7F).astype(np.int64) << 7 * k
    return out


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column of the bytes from each start to the next."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _blocks(numbers: np.ndarray, tokens: pa.ListArray, bits: int) -> pa.RecordBatch:
    """Postings of consecutive rows: for each block and folder its terms in order, TERMS of them a row."""
    lengths = np.diff(tokens.offsets.to_numpy())
    coded = tokens.flatten().dictionary_encode()
    words = coded.dictionary
    folder = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(words)) % BUCKETS
    order = pc.sort_indices(pa.table({"folder": folder, "word": words}), [("folder", "ascending"), ("word", "ascending")]).to_numpy()
    words, folder = words.take(pa.array(order)), folder[order]
    code = np.empty(len(order), np.int64)
    code[order] = np.arange(len(order))
    # Tokens by block and term, those of a term as they stand: the place in the batch is the low part of what is sorted.
    low = max(1, len(coded)).bit_length()
    block = np.repeat(np.cumsum(np.diff(numbers >> bits, prepend=numbers[:1] >> bits) != 0), lengths)
    order = (block * max(1, len(words)) + code[coded.indices.to_numpy()]) << low | np.arange(len(coded))
    order.sort()
    cells = order >> low
    order &= (1 << low) - 1
    row = np.repeat(np.arange(len(lengths)), lengths)[order]
    place = order - (np.cumsum(lengths) - lengths)[row]
    new_cell, new_row = np.ones(len(order), bool), np.ones(len(order), bool)
    new_cell[1:] = cells[1:] != cells[:-1]
    new_row[1:] = new_cell[1:] | (row[1:] != row[:-1])
    posting = np.flatnonzero(new_row)
    gaps = np.diff(place, prepend=0)
    gaps[posting] = place[posting]
    n = np.diff(posting, append=len(order))
    cell = np.flatnonzero(new_cell[posting])
    size = np.diff(cell, append=len(posting))
    first = posting[cell]
    inside = numbers[row[posting]] & ((1 << bits) - 1)
    steps = np.diff(inside, prepend=0)
    steps[cell] = inside[cell]
    # Each term's steps from row to row, then its counts.
    at = np.arange(len(posting)) + np.repeat(cell, size)
    both = np.empty(2 * len(posting), np.int64)
    both[at], both[at + np.repeat(size, size)] = steps, n
    most = np.maximum.reduceat(n, cell) if len(cell) else n
    term, block = cells[first] % max(1, len(words)), numbers[row[first]] >> bits
    group = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (folder[term[1:]] != folder[term[:-1]]))[: len(cell)])
    rank = np.arange(len(cell)) - np.repeat(group, np.diff(group, append=len(cell)))
    chunk = np.flatnonzero(rank % TERMS == 0)
    said = words.take(pa.array(term))
    said_at = np.frombuffer(said.buffers()[1], np.int32)[: len(said) + 1] if len(said) else np.zeros(1, np.int32)
    rows_data, rows_at = packed(both)
    gaps_data, gaps_at = packed(gaps)
    rows_at, gaps_at = np.append(rows_at[2 * cell], len(rows_data)), np.append(gaps_at[first], len(gaps_data))
    sizes_data, sizes_at = packed(np.stack([np.diff(said_at), most, np.diff(rows_at), np.diff(gaps_at)], 1).ravel())
    ends = np.append(chunk[1:], len(cell)) - 1 if len(chunk) else chunk
    columns = [
        pa.array(folder[term[chunk]].astype(np.int32)),
        pa.array(block[chunk]),
        said.take(pa.array(chunk)),
        said.take(pa.array(ends)),
        _squeezed(memoryview(said.buffers()[2] or b""), said_at[chunk]),
        _squeezed(memoryview(sizes_data), sizes_at[4 * chunk]),
        _binary(rows_data, rows_at[chunk]),
        _binary(gaps_data, gaps_at[chunk]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "first", "last", "terms", "sizes", "coded", "gaps"])


def _squeezed(data: memoryview, starts: np.ndarray) -> pa.Array:
    """A binary column of the bytes from each start to the next, compressed."""
    return pa.array([zlib.compress(data[a:b], 1) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(data)])], pa.binary())


def spelled_out(terms: bytes, sizes: bytes, wanted: set[bytes]) -> Iterator[tuple[bytes, int, slice, slice]]:
    """Of a row of postings those of the wanted terms: term, largest count, and where its rows and its gaps stand."""
    terms, table = zlib.decompress(terms), unpacked(zlib.decompress(sizes)).reshape(-1, 4)
    ends = np.cumsum(table[:, [0, 2, 3]], 0).tolist()
    at = (0, 0, 0)
    for end, most in zip(ends, table[:, 1].tolist()):
        if (word := terms[at[0] : end[0]]) in wanted:
            yield word, most, slice(at[1], end[1]), slice(at[2], end[2])
        at = end


def rows_of(block: int, coded: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and counts of a term's coded postings in a block."""
    numbers = unpacked(coded)
    steps, counts = numbers[: len(numbers) // 2], numbers[len(numbers) // 2 :]
    return (block << bits) + np.cumsum(steps), counts


def _write(rows: DataFrame, path: str, segment: int, bits: int) -> None:
    spark = rows.sparkSession
    ship(spark)
    # Numbers are fixed once the table is written; it goes when the postings are there.
    numbered = materialise(rows.select("kind", "item", "id", "at", "text").withColumn("row", F.monotonically_increasing_id()), "numbered", "zstd")
    numbered.drop("text").write.parquet(f"{path}/rows/segment={segment}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            ends = np.cumsum(np.diff(batch.column("tokens").offsets.to_numpy()))
            # Cut where a block ends if one does.
            border = np.flatnonzero(np.diff(batch.column("row").to_numpy() >> bits)) + 1
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
                whole = border[(border > at) & (border <= to)]
                to = int(whole[-1]) if len(whole) and to < batch.num_rows else to
                part = batch.slice(at, to - at)
                yield _blocks(part.column("row").to_numpy(), pa.ListArray.from_arrays(*_rebased(part.column("tokens"))), bits)
                at = to

    postings = numbered.where("text <> ''").select("row", search.tokens(F.col("text")).alias("tokens")).mapInArrow(run, f"bucket int, {MADE}")
    # A folder's blocks are dealt to several tasks where there are more tasks than folders, those of a frequent term, too.
    spread = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS))
    dealt = postings.repartition(F.col("bucket"), F.pmod(F.xxhash64("block"), F.lit(spread))).sortWithinPartitions("bucket", "first", "block")
    dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    discard(numbered)


def _rebased(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Offsets from 0 and values of a list column that may be a slice."""
    offsets = lists.offsets.to_numpy()
    return pa.array((offsets - offsets[0]).astype(np.int32)), lists.flatten()


def _scored(postings: DataFrame, words: Sequence[str], bits: int) -> DataFrame:
    """segment, row, score of the rows that hold every word."""
    wanted = {w.encode() for w in words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, rows, counts = [], [], []
            for segment, block, terms, sizes, coded in zip(*(c.to_pylist() for c in batch.columns)):
                for _, _, where, _ in spelled_out(terms, sizes, wanted):
                    r, n = rows_of(block, coded[where], bits)
                    segments.append(np.full(len(r), segment, np.int32))
                    rows.append(r)
                    counts.append(n)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (segments, rows, counts)], names=["segment", "row", "n"])

    each = postings.select("segment", "block", "terms", "sizes", "coded").mapInArrow(run, "segment int, row long, n long")
    return each.groupBy("segment", "row").agg(F.count(F.lit(1)).alias("_words"), F.sum("n").alias("score")).where(F.col("_words") == len(words)).drop("_words")


def _largest(postings: DataFrame, words: Sequence[str]) -> DataFrame:
    """segment, block, term, most: the largest counts of the words, without reading rows."""
    wanted = {w.encode() for w in words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(segment, block, word.decode(), most) for segment, block, terms, sizes in zip(*(c.to_pylist() for c in batch.columns)) for word, most, _, _ in spelled_out(terms, sizes, wanted)]
            if out:
                segments, blocks, terms, most = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int32()), pa.array(blocks, pa.int64()), pa.array(terms, pa.string()), pa.array(most, pa.int64())], names=["segment", "block", "term", "most"])

    return postings.select("segment", "block", "terms", "sizes").mapInArrow(run, "segment int, block long, term string, most long")


def build(rows: DataFrame, path: str | None = None, bits: int = BLOCK) -> Index:
    """An index of rows (kind, item, id, at, text) at path, a folder of the shared one if none is given; 2^bits rows a block."""
    path = path or fresh_path(rows.sparkSession, "postings")
    _write(rows, path, 0, bits)
    return Index(rows.sparkSession, path, 1, bits)


def replace(index: Index, rows: DataFrame) -> Index:
    """The index after all rows of the items that rows have are replaced by them (an item's new revision)."""
    _write(rows, index.path, index.segments, index.bits)
    return Index(index.spark, index.path, index.segments + 1, index.bits)


def hits(index: Index, raw_query: str) -> DataFrame:
    """kind, item, id, at, score, segment, row: as search.match finds them, without reading a text."""
    words = search.query_tokens(raw_query)
    # Without words no folder is asked for.
    return index.alive(index.rows().join(_scored(index.postings(words), words, index.bits), ["segment", "row"]))


def top(index: Index, raw_query: str, k: int) -> tuple[DataFrame, dict[str, int]]:
    """The k best hits (score descending, newest first, then id), and how many blocks there were and were read.

    A block can score no more than the sum of its words' largest counts. The k most promising blocks give a score that the
    k-th best hit has at least; only blocks that can reach it are read after them.
    """
    words = search.query_tokens(raw_query)
    order = [F.desc("score"), F.desc_nulls_last("at"), F.col("id"), F.col("kind")]
    postings = index.postings(words)
    # Parts of a block that two tasks have written count as one.
    bounds = _largest(postings, words).groupBy("segment", "block", "term").agg(F.max("most").alias("most")).groupBy("segment", "block").agg(F.count(F.lit(1)).alias("_words"), F.sum("most").alias("bound"))
    bounds = materialise(bounds.where(F.col("_words") == len(words)).drop("_words"), "bounds")

    def read(blocks: DataFrame) -> DataFrame:
        found = _scored(postings.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi"), words, index.bits)
        return index.alive(index.rows().join(found, ["segment", "row"])).orderBy(*order).limit(k)

    first = read(bounds.orderBy(F.desc("bound"), "segment", "block").limit(k)).collect()
    least = first[-1]["score"] if len(first) == k else 0
    left = bounds.where(F.col("bound") >= least)
    counts = bounds.agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("bound") >= least).alias("read")).first()
    return read(left).select("kind", "item", "id", "at", "score"), counts.asDict()


@dataclass
class Page:
    """totals: (hits, items). facets: (facet, n). items: the FACET_ITEMS items with most hits (item, n). groups: (item, place,
    value, score, at, n, match_type) of the page. best: (item, place, kind, id, score) of each group's best hits."""

    totals: DataFrame
    facets: DataFrame
    items: DataFrame
    groups: DataFrame
    best: DataFrame


def search_page(index: Index, raw_query: str, near: DataFrame | None = None, facet: str | None = None, item: object = None, sort: str = "relevance", after: object = None, limit: int = 20, best: int = 5) -> Page:
    """One page of a search. near: items that are near by meaning (item, rank from 0), which are fused with the ranking by words.
    facet, item: only these hits (totals and facets are of all). sort: relevance or recency. after: the item that the last page
    ended with; a page begins at the top if it isn't there. An item that is only near has score 0 and the time 0."""
    spark = index.spark
    found = hits(index, raw_query).select("kind", "item", "id", "at", F.col("score").cast("double").alias("score"))
    if near is not None:
        # Words first, so that the anti join reads a written table.
        found = materialise(found, "hits")
        only = near.join(found.select("item").distinct(), "item", "left_anti")
        found = found.unionByName(only.select(F.lit("semantic").alias("kind"), "item", F.lit(None).cast(found.schema["id"].dataType).alias("id"), F.timestamp_seconds(F.lit(0)).alias("at"), F.lit(0.0).alias("score")))
    found = materialise(found, "hits")
    of = F.coalesce(*(F.when(F.col("kind").isin(*kinds), name) for name, kinds in FACETS.items()))
    totals = found.agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("item").alias("items"))
    known = spark.createDataFrame([(name,) for name in FACETS], "facet string")
    facets = F.broadcast(known).join(found.groupBy(of.alias("facet")).agg(F.count(F.lit(1)).alias("n")), "facet", "left").select("facet", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    items = found.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(FACET_ITEMS)

    kept = found
    if facet:
        kept = kept.where(F.col("kind").isin(*FACETS[facet]))
    if item is not None:
        kept = kept.where(F.col("item") == item)
    groups = kept.groupBy("item").agg(F.max("score").alias("score"), F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))
    value = F.col("score")
    if near is not None:
        by_words = found.where("kind <> 'semantic'").groupBy("item").agg(F.max(F.struct("score", "at")).alias("top")).select("item", "top.score", "top.at")
        by_words = search.ranked(by_words, "item", [F.desc("score"), F.desc("at"), F.col("item")])
        by_meaning = near.select(F.col("item").alias("id"), "rank")
        types = search.match_types(by_words, by_meaning)
        fused = search.fuse([by_words, by_meaning]).join(types, "id").select(F.col("id").alias("item"), F.round("score", 9).alias("fused"), "match_type")
        groups, value = groups.join(fused, "item"), F.col("fused")
    else:
        groups = groups.withColumn("match_type", F.lit("lexical"))
    order = [F.col("value").desc(), F.col("item")] if near is not None else [F.col("value").desc(), F.col("at").desc(), F.col("item")]
    if sort == "recency":
        order = [F.col("at").desc(), F.col("item")]
    groups = materialise(groups.withColumn("value", value).select("item", "value", "score", "at", "n", "match_type"), "groups")
    page = groups
    last = groups.where(F.col("item") == after).first() if after is not None else None
    if last is not None:
        later = F.col("item") > last["item"]
        for name, more in reversed([("value", True), ("at", True)] if near is None and sort != "recency" else [("at", True)] if sort == "recency" else [("value", True)]):
            later = (F.col(name) < F.lit(last[name])) | ((F.col(name) == F.lit(last[name])) & later)
        page = groups.where(later)
    page = materialise(page.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order))), "page")  # limit rows at most
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.desc("at"), "kind", "id")
    shown = kept.join(F.broadcast(page.select("item")), "item").withColumn("place", F.row_number().over(w)).where(F.col("place") <= best)
    return Page(totals, facets, items, page, shown.select("item", "place", "kind", "id", "score"))
