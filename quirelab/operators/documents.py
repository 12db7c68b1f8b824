"""Blocks of documents: ordinals, ids, plain text, revisions, quality, duplicates."""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.session import discard, materialise, ship

#: Thresholds of the fuzzy rules, and the sizes of a batch.
FUZZY_TITLE, CARRY_OVER, PDF_SYNC, QUOTE = 0.92, 0.90, 0.85, 0.8
BATCH_BLOCKS, BATCH_TOKENS = 8, 2800
#: Titles in a tile of comparisons, and their characters, about.
TITLES, TITLE_CHARS = 16_000, 4_000_000
#: Tasks that tiles are dealt to at most.
MOST_TASKS = 20_000
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sanitised(text: Column) -> Column:
    """Without control characters, except tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\t\n\r]]", "")


def without_markdown(text: Column) -> Column:
    """Plain text of simple Markdown: code fences, images, links, emphasis, headings, quotes and list marks."""
    for pattern, with_ in ((r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s{0,3}>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"[*_`~]", "")):
        text = F.regexp_replace(text, pattern, with_)
    return collapsed(text)


def block_text(kind: Column, number: Column, title: Column, body: Column, caption: Column) -> Column:
    """Plain text of a block for search: headings by number and title, figures and tables by caption, others by body."""
    found = F.when(kind == "heading", F.concat_ws(" ", number, title)).when(kind.isin("figure", "table"), caption).otherwise(body)
    return collapsed(F.coalesce(found, F.lit("")))


def paragraph_ordinals(blocks: DataFrame) -> DataFrame:
    """ordinal: 1, 2, 3 … over the paragraphs of a section, null for other blocks."""
    w = Window.partitionBy("doc_id", "section").orderBy("position")
    is_paragraph = F.col("kind") == "paragraph"
    return blocks.withColumn("ordinal", F.when(is_paragraph, F.sum(is_paragraph.cast("int")).over(w)))


@F.pandas_udf(T.StringType())
def xxh64_hex(text: pd.Series) -> pd.Series:
    """xxHash64 with seed 0; Spark's own function has another seed."""
    import xxhash

    return text.map(lambda t: None if t is None else xxhash.xxh64_hexdigest(t.encode("utf-8", "surrogatepass")))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def block_ids(blocks: DataFrame) -> DataFrame:
    """block_id: blk-<section>-<first letter of the kind><ordinal in section and kind>-<4 hash digits>, with -2, -3 … where
    a section has the same id again."""
    kind = Window.partitionBy("doc_id", "section", "kind").orderBy("position")
    base = F.concat_ws("-", F.lit("blk"), F.col("section").cast("string"), F.concat(F.substring("kind", 1, 1), F.row_number().over(kind).cast("string")), F.substring(xxh64_hex(collapsed(nfkc("text"))), 1, 4))
    found = blocks.withColumn("_base", base)
    again = F.row_number().over(Window.partitionBy("doc_id", "section", "_base").orderBy("position"))
    return found.withColumn("_n", again).withColumn("block_id", F.when(F.col("_n") > 1, F.concat_ws("-", "_base", F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_n")


def first_heading(blocks: DataFrame) -> DataFrame:
    """(doc_id, section, heading): a section's first heading."""
    return blocks.where("kind = 'heading'").groupBy("doc_id", "section").agg(F.min_by("text", "position").alias("heading"))


def readable_prefix(sections: DataFrame) -> DataFrame:
    """Of (doc_id, section, done): the last section of the leading run of done ones, null if the first is not done."""
    w = Window.partitionBy("doc_id").orderBy("section")
    run = sections.withColumn("_run", F.min(F.col("done").cast("int")).over(w))
    return run.groupBy("doc_id").agg(F.max(F.when(F.col("_run") == 1, F.col("section"))).alias("readable_upto"))


def progress_percent(done: Column, total: Column) -> Column:
    """Rounded down, 100 at most, 100 where there is nothing to do."""
    return F.when(total == 0, F.lit(100)).otherwise(F.least(F.lit(100), F.floor(done * 100 / total))).cast("long")


def completeness(text_chars: Column, other_chars: Column, paragraphs: Column, headings: Column) -> Column:
    """accepted, short (35 % of the source were not recovered, for sources of 1000 characters or more) or bare."""
    total = text_chars + other_chars
    return F.when((total >= 1000) & (text_chars < total * 0.35), "short").when((paragraphs < 2) & (headings == 0), "bare").otherwise("accepted")


def quality_flags(source: Column, target: Column) -> Column:
    """Which checks a translation fails: the numbers as a multiset, the length ratio (sources of 60 characters or more), equality."""
    numbers = lambda t: F.array_sort(F.regexp_extract_all(F.regexp_replace(t, ",", ""), F.lit("([0-9]+)"), 1))
    ratio = F.length(target) / F.length(source)
    return F.array_compact(
        F.array(
            F.when(F.array_join(numbers(source), " ") != F.array_join(numbers(target), " "), F.lit("number_mismatch")),
            F.when((F.length(source) >= 60) & ~ratio.between(0.30, 1.10), F.lit("length_outlier")),
            F.when((source == target) & (F.length(source) > 0), F.lit("untranslated")),
        )
    )


def token_bag_difference(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """(id, token, a, b): tokens that stand more or less often on one side. Both sides have id and an array `tokens`."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(id_col, F.explode("tokens").alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias(name))

    zero = F.lit(0).cast("long")
    both = counted(left, "a").join(counted(right, "b"), [id_col, "token"], "full").select(id_col, "token", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    return both.where("a <> b")


def repeated_lines(lines: DataFrame, group: str, page: str, text: str, share: float = 0.6) -> DataFrame:
    """(group, text, pages): texts on at least ceil(share x pages) different pages of their group."""
    pages = lines.groupBy(group).agg(F.countDistinct(page).alias("_all"))
    found = lines.groupBy(group, text).agg(F.countDistinct(page).alias("pages"))
    return found.join(pages, group).where(F.col("pages") >= F.ceil(F.col("_all") * share)).drop("_all")


def unique_matches(old: DataFrame, new: DataFrame, doc: str, key: str) -> DataFrame:
    """(doc, key, old_position, new_position) of keys that stand once on either side."""
    once = lambda rows, name: rows.groupBy(doc, key).agg(F.count(F.lit(1)).alias("_n"), F.min("position").alias(name)).where("_n = 1").drop("_n")
    return once(old, "old_position").join(once(new, "new_position"), [doc, key])


def revision_diff(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, change): added, removed, changed or unchanged blocks by id and content."""
    a, b = old.select(*keys, F.col(content).alias("_a"), F.lit(1).alias("_in_a")), new.select(*keys, F.col(content).alias("_b"), F.lit(1).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def sequence_diff(pairs: DataFrame) -> DataFrame:
    """Of (doc_id, old array, new array): how many blocks an alignment of the two sequences leaves equal, removes and adds."""

    @F.pandas_udf("equal int, removed int, added int")
    def diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(old, new):
            a, b = list(a if a is not None else ()), list(b if b is not None else ())
            same = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            out.append((same, len(a) - same, len(b) - same))
        return pd.DataFrame(out, columns=["equal", "removed", "added"])

    return pairs.select("doc_id", diff("old", "new").alias("d")).select("doc_id", "d.*")


#: Quotes that are broadcast at once.
KEYLESS = 1000


def contained_quotes(quotes: DataFrame, quote_id: str, quote: str, rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, quote_id, at): quotes that stand in a text, whole words or not, with their first place. Null and empty quotes
    stand nowhere.

    Joined through a quote's first 24 characters that begin a word inside it, which then begin a word of the text, too; texts
    come in only for the pairs found. Quotes without such a stretch are tried on all texts, KEYLESS of them at a time."""
    size = 24
    starts = F.regexp_extract_all(F.col(text), F.lit(r"(?s)(?=((?<![\p{L}\p{N}])[\p{L}\p{N}].{%d}))" % (size - 1)), 1)
    key = F.regexp_extract(F.col(quote), r"(?s)(?<=[^\p{L}\p{N}])([\p{L}\p{N}].{%d})" % (size - 1), 1)
    given = quotes.where(F.length(quote) > 0).select(F.col(quote_id).alias("_id"), F.col(quote).alias("_quote"), key.alias("_key"))
    keyed = rows.select(F.col(row_id).alias("_row"), F.explode(F.array_distinct(starts)).alias("_key"))
    pairs = keyed.join(given.where("_key <> ''"), "_key").select("_row", "_id", "_quote").distinct()
    hits = rows.select(row_id, F.col(text).alias("_text")).join(pairs, F.col(row_id).eqNullSafe(F.col("_row")))
    found = hits.where(F.contains("_text", F.col("_quote"))).select(row_id, "_id", "_quote", "_text")
    short = given.where("_key = ''")
    parts = -(-short.count() // KEYLESS)
    for k in range(parts):
        some = short.where(F.pmod(F.xxhash64("_quote"), F.lit(parts)) == k).select("_id", "_quote")
        tried = rows.select(row_id, F.col(text).alias("_text")).join(F.broadcast(some), F.contains("_text", F.col("_quote")))
        found = found.unionByName(tried.select(row_id, "_id", "_quote", "_text"))
    return found.select(row_id, F.col("_id").alias(quote_id), F.expr("instr(_text, _quote)").cast("long").alias("at")).distinct()


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), "^www\\.", "")


def normalised_url(url: Column) -> Column:
    """Scheme and host in lower case, no www., no trailing slash, no tracking parameters, the others sorted, no fragment."""
    query = F.parse_url(url, F.lit("QUERY"))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~F.substring_index(p, "=", 1).isin(*TRACKING) & (p != "")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.concat(F.lower(F.parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), url_host(url), path, F.coalesce(tail, F.lit("")))


def url_kind(url: Column) -> Column:
    host, path = url_host(url), F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    return (
        F.when((host == "github.com") & path.rlike("^/[^/]+/[^/]+"), "github")
        .when(host.isin("youtube.com", "m.youtube.com") & ((path == "/watch") | F.startswith(path, F.lit("/live/"))), "youtube")
        .when(host == "youtu.be", "youtube")
        .when(F.lower(path).endswith(".pdf") | host.isin("speakerdeck.com", "slideshare.net"), "slides")
        .otherwise("article")
    )


def reference_fields(text: Column) -> dict[str, Column]:
    """arXiv id without version, DOI, year and quoted title of a reference; null where there is none."""
    some = lambda pattern, group=1: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return {
        "arxiv_id": some(r"(?i)arxiv[:\s/]*(?:abs/)?(\d{4}\.\d{4,5})"),
        "doi": some(r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+[^\s\"<>.,;])"),
        "year": some(r"\b((?:19|20)\d{2})\b").cast("int"),
        "title": some("[\"“]([^\"”]{3,})[\"”]"),
    }


def _common_at_least(masks: dict[str, int], full: int, b: str, least: float) -> bool:
    """Whether the longest common subsequence of b and the text of the masks has `least` characters; bit-parallel, and given up
    as soon as what is left of b cannot make up for what is missing. With so many in common the first k characters of b have
    theirs among the first k of the text and as many more as the text may leave out."""
    v, out, get = full, int(full.bit_length() - least), masks.get
    for k, c in enumerate(b, 1):
        u = v & get(c, 0)
        v = (v + u | v - u) & full
        if not k & 15:
            reach = full >> max(0, full.bit_length() - k - out)
            if (reach ^ v & reach).bit_count() + len(b) - k < least:
                return False
    return (full ^ v).bit_count() >= least


def _counts(texts: list[str]) -> np.ndarray:
    return np.array([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=128) for t in texts], np.int32).reshape(len(texts), 128)


def _levels(counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A column of zeros and ones for each character and level from low to high, so that the product of two texts' rows is the sum
    of the lesser counts between them."""
    columns = [counts[:, c, None] > np.arange(low[c], high[c]) for c in np.flatnonzero(high > low).tolist()]
    return np.concatenate(columns, axis=1).astype(np.float32) if columns else np.zeros((len(counts), 0), np.float32)


#: Neighbouring characters that are counted together.
GRAM = 4


def _grams(texts: list[str], places: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place of each GRAM neighbouring characters, hashed into a power of two of places."""
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.uint32)
    text = np.repeat(np.arange(len(texts)), lengths)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    start = np.flatnonzero(inside + GRAM <= np.repeat(lengths, lengths))
    code = np.zeros(len(start), np.uint32)
    for k in range(GRAM):
        code = code << np.uint32(8) | data[start + k]
    return text[start], (code * np.uint32(0x9E3779B1) >> np.uint32(33 - places.bit_length())).astype(np.int64)


def first_near(titles: list[str], candidates: list[str], fits: Callable[[int, int], bool], wanted: float) -> list[tuple[int, int, float]]:
    """(title, candidate, ratio) by their places: for each title the first other candidate in the given order that fits and is alike.

    SequenceMatcher matches a common subsequence, so that neither lengths, nor counts of characters, nor the longest common
    subsequence may fall short of wanted. Nor may counts of GRAM neighbouring characters: what is common stands in one run more
    than characters are not, at most, and a run of r characters has r - GRAM + 1 of them. In a candidate of 200 characters or more
    SequenceMatcher begins no run at a character that makes up more than a hundredth of it (autojunk), but for one run at the
    very beginning, so that runs are no more than the rarer characters in common and one. Hashed places can only add to what
    seems common. Only what passes all is given to it. Counts of characters are compared by a product of matrices."""
    out: list[tuple[int, int, float]] = []
    if not titles or not candidates:
        return out
    by_length = sorted(range(len(candidates)), key=lambda k: len(candidates[k]))
    places = np.array(by_length)
    texts = [candidates[k] for k in by_length]
    sizes = np.array([len(t) for t in texts])
    held = _counts(texts)
    # Levels that nearly all candidates reach are taken as reached; what few have beyond the highest ones counts as a sum.
    low, high = (np.partition(held, k, axis=0)[k] for k in (len(held) // 50, len(held) - 1 - len(held) // 50))
    beyond_y = np.maximum(held - high, 0).sum(1).astype(np.float32)
    short = (wanted / 2 * sizes).astype(np.float32)
    y = np.concatenate([_levels(held, low, high), np.ones((len(held), 1), np.float32), -short[:, None]], axis=1)
    spread = 1 << min(15, max(11, int(26 * sizes.mean()).bit_length()))
    text, gram = _grams(texts, spread)
    grams = np.zeros((spread, len(texts)), np.uint8)
    np.add.at(grams, (gram, text), 1)
    if int(grams.sum(dtype=np.int64)) != len(gram):
        grams = np.zeros((spread, len(texts)), np.int32)
        np.add.at(grams, (gram, text), 1)
    used = np.flatnonzero(held.any(0))
    rarer = held[:, used]
    rarer = np.where((rarer <= sizes[:, None] // 100 + 1) | (sizes[:, None] < 200), rarer, 0)
    order = sorted(range(len(titles)), key=lambda k: len(titles[k]))
    for at in range(0, len(order), 256):
        part = [titles[k] for k in order[at : at + 256]]
        n = np.array([len(t) for t in part])
        lo, hi = np.searchsorted(sizes, [int(n[0] * wanted / (2 - wanted)) - 1, int(n[-1] * (2 - wanted) / wanted) + 2])
        if lo >= hi:
            continue
        asked = _counts(part)
        base = np.minimum(asked, low).sum(1) - wanted / 2 * n
        x = np.concatenate([_levels(asked, low, high), base[:, None].astype(np.float32), np.ones((len(part), 1), np.float32)], axis=1)
        slack = x @ y[lo:hi].T
        beyond_x = np.maximum(asked - high, 0).sum(1).astype(np.float32)
        for row in np.flatnonzero(beyond_x).tolist():
            slack[row] += np.minimum(beyond_x[row], beyond_y[lo:hi])
        # Single precision: far less than this for titles of any length.
        enough = slack >= -0.01 - 1e-6 * sizes[hi - 1]
        text, gram = _grams(part, spread)
        ends = np.searchsorted(text, np.arange(len(part) + 1))
        for row, p in enumerate(part):
            found = np.flatnonzero(enough[row])
            found = found[2 * np.minimum(n[row], sizes[lo + found]) >= wanted * (n[row] + sizes[lo + found]) - 1e-6]
            # A title itself, and titles too short to have so many grams, pass without a count.
            both = n[row] + sizes[lo + found]
            runs = np.minimum((1 - wanted) * both, np.minimum(asked[row, used], rarer[lo + found]).sum(1)) + 1
            least = wanted / 2 * both - (GRAM - 1) * runs - 1e-6
            if len(found) and least.max() > 0:
                kinds, times = np.unique(gram[ends[row] : ends[row + 1]], return_counts=True)
                common = np.zeros(len(found), np.int64)
                for k in range(0, len(kinds), 512):
                    some = grams[kinds[k : k + 512, None], (lo + found)[None, :]]
                    common += np.minimum(some, times[k : k + 512, None].astype(np.int32) if grams.dtype != np.uint8 else np.minimum(times[k : k + 512, None], 255).astype(np.uint8)).sum(0, dtype=np.int64)
                found = found[common >= least]
            masks: dict[str, int] = {}
            for j in np.sort(places[lo + found]).tolist():
                q = candidates[j]
                if p == q or not fits(order[at + row], j):
                    continue
                if not masks:
                    for k, c in enumerate(p):
                        masks[c] = masks.get(c, 0) | 1 << k
                if _common_at_least(masks, (1 << len(p)) - 1, q, wanted * (len(p) + len(q)) / 2 - 1e-6) and (r := SequenceMatcher(None, p, q).ratio()) >= wanted:
                    out.append((order[at + row], j, r))
                    break
    return out


def fuzzy_duplicates(rows: DataFrame, id_col: str, title: str, surname: str, year: str, wanted: float = FUZZY_TITLE) -> DataFrame:
    """(id, first_id, ratio) of every row: the row of the least id that it is a duplicate of, null without one, and how alike
    their titles are. Duplicates have one surname, years at most one apart or unknown, and titles whose sorted tokens have a
    ratio of `wanted` or more, the row's own title first.

    Rows of equal surname, title and year are one class, so that copies are never compared. The titles of a surname are looked
    for within bands of length between which the ratio cannot reach `wanted`; bands of many titles are dealt to tiles of about
    TITLES or TITLE_CHARS, in which a title's search ends with the first hit. There are as many tasks as tiles of cut bands, so
    that more titles make more tasks, not longer ones. A row without a surname or title has no duplicate; titles
    without letters or digits are all equal. Ids are taken to be unique; a null id is nobody's first one."""
    spark = rows.sparkSession
    ship(spark)
    normal = F.trim(F.regexp_replace(F.lower(nfkc(title)), "[^a-z0-9]+", " "))
    sorted_tokens = F.array_join(F.array_sort(F.split(normal, " ")), " ")
    base = rows.select(F.col(id_col).alias("id"), sorted_tokens.alias("t"), F.lower(surname).alias("s"), F.col(year).cast("int").alias("y"))
    base = materialise(base.withColumn("h", F.md5(F.col("t").cast("binary"))), "titles")
    known = base.where("s IS NOT NULL AND t IS NOT NULL")
    # Of each class its title and its two least ids; a task keeps its own two before they meet.
    key = ["s", "h", "y"]
    least = known.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("id").asc_nulls_last()))).where("k <= 2")
    classes = least.groupBy(*key).agg(F.first("t").alias("t"), F.min("id").alias("first"), F.max(F.when(F.col("k") == 2, F.col("id"))).alias("second"))
    classes = materialise(classes, "title-classes")

    band = F.floor(F.log(F.length("t")) / math.log((2 - wanted) / wanted * 1.0001)).cast("int")
    titles = classes.where("t <> ''").withColumn("band", band)
    sides = lambda c: F.explode(F.array(*(c + F.lit(k) for k in (-1, 0, 1))))
    sizes = titles.groupBy("s", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("c")).select("s", "n", "c", sides(F.col("band")).alias("g"))
    sizes = materialise(sizes.groupBy("s", "g").agg(F.ceil(F.greatest(F.sum("n") / TITLES, F.sum("c") / TITLE_CHARS)).cast("int").alias("k")), "title-bands")
    cut = sizes.where("k > 1").agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0
    tasks = min(MOST_TASKS, max(cut, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # A band's titles search their own band and the two beside it.
    role = lambda shift, asks: F.struct((F.col("band") + shift).alias("g"), F.lit(asks).alias("asks"))
    placed = titles.select(*key, "t", "first", F.explode(F.array(role(0, True), *(role(k, False) for k in (-1, 0, 1)))).alias("r")).select(*key, "t", "first", "r.*").join(sizes, ["s", "g"])
    own, other = F.pmod(F.xxhash64("t"), F.col("k")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    placed = placed.select(*key, "g", "t", "first", "asks", own.alias("own"), other.alias("other"))
    asks = F.col("asks")
    tiles = placed.select(*key, "g", F.when(asks, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(asks, F.col("other")).otherwise(F.col("own")).alias("j"), "t", "first", "asks")
    id_type = base.schema["id"].dataType.simpleString()

    def compare(tile: pa.Table) -> pa.Table:
        asking = tile.filter(tile["asks"])
        held = tile.filter(pa.compute.and_(pa.compute.invert(tile["asks"]), pa.compute.is_valid(tile["first"]))).sort_by("first")
        a, b = asking["y"].to_pylist(), held["y"].to_pylist()
        near = lambda i, j: a[i] is None or b[j] is None or abs(a[i] - b[j]) <= 1
        found = first_near(asking["t"].to_pylist(), held["t"].to_pylist(), near, wanted)
        left, right = pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())
        return pa.table([*(asking[c].take(left) for c in key), held["first"].take(right), pa.array([x[2] for x in found], pa.float64())], names=[*key, "other", "ratio"])

    hits = tiles.repartition(tasks, "s", "g", "i", "j").groupBy("s", "g", "i", "j").applyInArrow(compare, f"s string, h string, y int, other {id_type}, ratio double")
    # Equal titles of other years.
    b = classes.select(F.col("s").alias("b_s"), F.col("h").alias("b_h"), F.col("y").alias("b_y"), F.col("first").alias("other"))
    beside = F.col("y").isNull() | F.col("b_y").isNull() | (F.abs(F.col("y") - F.col("b_y")) <= 1)
    within = classes.join(b, (F.col("s") == F.col("b_s")) & (F.col("h") == F.col("b_h")) & beside & ~F.col("y").eqNullSafe(F.col("b_y"))).where("other IS NOT NULL")
    hits = hits.union(within.select(*key, "other", F.lit(1.0).alias("ratio"))).groupBy(*key).agg(F.min("other").alias("other"), F.min_by("ratio", "other").alias("ratio"))
    renamed = {k: f"_{k}" for k in key}
    equal = (F.col("s") == F.col("_s")) & (F.col("h") == F.col("_h")) & F.col("y").eqNullSafe(F.col("_y"))
    told = classes.drop("t").join(hits.withColumnsRenamed(renamed), equal, "left").drop(*renamed.values()).withColumnsRenamed(renamed)
    told = materialise(told, "title-hits")
    out = base.join(told, equal, "left")
    twin = F.when(F.col("id").eqNullSafe(F.col("first")), F.col("second")).otherwise(F.col("first"))
    nearer = F.col("twin").isNotNull() & (F.col("other").isNull() | (F.col("twin") < F.col("other")))
    out = out.withColumn("twin", twin).select(F.col("id").alias(id_col), F.when(nearer, F.col("twin")).otherwise(F.col("other")).alias("first_id"), F.when(nearer, F.lit(1.0)).otherwise(F.round("ratio", 6)).alias("ratio"))
    discard(classes)
    discard(sizes)
    return out


def greedy_batches(blocks: DataFrame) -> DataFrame:
    """batch: a new one at BATCH_BLOCKS blocks or where BATCH_TOKENS estimated tokens would be passed, in order of position.

    One pass over each document's sizes in order, of which a task keeps the running batch only. Null texts count as empty;
    blocks of equal position come in any order."""
    ship(blocks.sparkSession)
    tokens = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4 * 1.1).cast("int")
    rows = blocks.select("doc_id", "position", tokens.alias("tokens")).repartition("doc_id").sortWithinPartitions("doc_id", "position")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, position {rows.schema['position'].dataType.simpleString()}, batch int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, batch, n, total = object(), 0, 0, 0
        for rows in batches:
            out = []
            for d, t in zip(rows.column("doc_id").to_pylist(), rows.column("tokens").to_pylist()):
                if d != doc:
                    doc, batch, n, total = d, 0, 0, 0
                elif n >= BATCH_BLOCKS or total + t > BATCH_TOKENS:
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + t
                out.append(batch)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("position"), pa.array(out, pa.int32())], names=["doc_id", "position", "batch"])

    return rows.mapInArrow(run, schema)


def budget_cut(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """The newest rows of each group within the budget, the very newest in any case."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return rows.withColumns({"_sum": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_k": F.row_number().over(w)}).where((F.col("_sum") <= budget) | (F.col("_k") == 1)).drop("_sum", "_k")


def glossary(terms: DataFrame) -> DataFrame:
    """Of (term, translation, scope, id): per lower-cased term the paper's row before the user's before the global one."""
    rank = F.when(F.col("scope") == "paper", 0).when(F.col("scope") == "user", 1).otherwise(2)
    return terms.groupBy(F.lower("term").alias("term")).agg(F.min_by(F.struct("translation", "scope"), F.struct(rank, F.col("id"))).alias("x")).select("term", "x.*")


def carry_over(pairs: DataFrame) -> DataFrame:
    """Of (doc_id, old, new), arrays of (position, text): which old block each new one continues, by equal text that stands
    once on either side, by order between those, and by likeness of CARRY_OVER or more. An old block is given once. A null
    array is an empty one, a null text the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, old, new in zip(batch["doc_id"], batch["old"], batch["new"]):
                both = ([(r["position"], r["text"] or "") for r in (side if side is not None else ())] for side in (old, new))
                out += [(doc, *x) for x in _continued(*both)]
            yield pd.DataFrame(out, columns=["doc_id", "new_position", "old_position", "how"])

    return pairs.mapInPandas(run, "doc_id long, new_position int, old_position int, how string")


def _likely(news: list[int], olds: list[int], old: list[tuple[int, str]], new: list[tuple[int, str]]) -> Iterator[tuple[int, int, float]]:
    """(new, old, ratio) of the pairs of unequal texts of CARRY_OVER or more. What SequenceMatcher matches cannot be more than the shorter text or
    the lesser counts of characters; of 200 characters or more in the new text, it comes in one run more than characters in
    common that make up no more than a hundredth of it (see first_near), so that a piece of the old text stands in the new one."""
    by_length = sorted(olds, key=lambda k: len(old[k][1]))
    sizes = [len(old[k][1]) for k in by_length]
    counts: dict[int, Counter] = {}
    for n in news:
        b = new[n][1]
        lo, hi = bisect_left(sizes, len(b) * CARRY_OVER / (2 - CARRY_OVER) - 1), bisect_right(sizes, len(b) * (2 - CARRY_OVER) / CARRY_OVER + 1)
        if lo >= hi:
            continue
        held, matcher = Counter(b), None
        rare = {c: k for c, k in held.items() if k <= len(b) // 100 + 1} if len(b) >= 200 else held
        for o in sorted(by_length[lo:hi]):
            a = old[o][1]
            if a == b:
                continue
            least = CARRY_OVER * (len(a) + len(b)) / 2 - 1e-9
            if min(len(a), len(b)) < least:
                continue
            mine = counts.get(o)
            if mine is None:
                mine = counts[o] = Counter(a)
            if sum(min(k, held[c]) for c, k in mine.items()) < least:
                continue
            # So many runs at most, of which one is that long; of a piece of the text half as long one stands in it whole.
            runs = min(len(a) + len(b) - 2 * least, sum(min(k, mine[c]) for c, k in rare.items())) + 1
            piece = (math.ceil(least / runs - 1e-6) + 1) // 2
            if piece > 1 and not any(a[k : k + piece] in b for k in range(0, len(a) - piece + 1, piece)):
                continue
            matcher = matcher or SequenceMatcher(None, "", b)
            matcher.set_seq1(a)
            if (r := matcher.ratio()) >= CARRY_OVER:
                yield n, o, r


def _continued(old: list[tuple[int, str]], new: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    def once(rows):
        seen: dict[str, list[int]] = {}
        for k, (_, text) in enumerate(rows):
            seen.setdefault(text, []).append(k)
        return {t: ks[0] for t, ks in seen.items() if len(ks) == 1}

    a, b = once(old), once(new)
    found = {b[t]: (a[t], "hash") for t in b.keys() & a.keys()}
    # Anchors that keep the order cut both sides into segments; equally long segments continue one by one.
    anchors, last = [(-1, -1)], -1
    for k in sorted(found):
        if found[k][0] > last:
            last = found[k][0]
            anchors.append((k, last))
    anchors.append((len(new), len(old)))
    used = {o for o, _ in found.values()}
    for (n0, o0), (n1, o1) in zip(anchors, anchors[1:]):
        news, olds = [k for k in range(n0 + 1, n1) if k not in found], [k for k in range(o0 + 1, o1) if k not in used]
        if len(news) == len(olds):
            for n, o in zip(news, olds):
                found[n] = (o, "order")
                used.add(o)
    # Equal texts have the best ratio, 1, and no others have: each continues the next one that is left.
    left: dict[str, deque[int]] = {}
    for o, (_, text) in enumerate(old):
        if o not in used:
            left.setdefault(text, deque()).append(o)
    for n, (_, text) in enumerate(new):
        if n not in found and left.get(text):
            found[n] = (left[text].popleft(), "fuzzy")
            used.add(found[n][0])
    scored = [(-r, n, o) for n, o, r in _likely([k for k in range(len(new)) if k not in found], [k for k in range(len(old)) if k not in used], old, new)]
    for _, n, o in sorted(scored):
        if n not in found and o not in used:
            found[n] = (o, "fuzzy")
            used.add(o)
    return [(new[n][0], old[o][0], how) for n, (o, how) in sorted(found.items())]
