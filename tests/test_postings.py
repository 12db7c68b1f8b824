"""The index of postings against matching by reading every text."""

import cProfile
import pstats
import random
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelab.operators import postings as ops
from quirelab.operators import search
from quirelab.plans.records import hit_streams

ROWS = "kind string, item long, id long, at timestamp, text string"


def made(spark, data):
    return spark.createDataFrame(data, "kind string, item long, id long, text string").withColumn("at", F.timestamp_seconds("id")).select("kind", "item", "id", "at", "text")


def listed(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_hits_are_those_of_match(spark, sf):
    rows = reduce(DataFrame.unionByName, hit_streams(spark, sf)).withColumn("at", F.timestamp_seconds("id"))
    index = ops.build(rows)
    for raw in ("from that", "that", "theation", "The  the", "src1 (AND)", "--", "nowhere_in_it"):
        assert listed(ops.hits(index, raw), "kind", "item", "id", "score") == listed(search.match(rows, "text", raw), "kind", "item", "id", "score"), raw
    plan = ops.hits(index, "from that")._jdf.queryExecution().toString()
    # Only the folders of the words' hashes, only rows around them, and no places.
    assert "PartitionFilters: [bucket" in plan.replace("((", "").replace("[(", "[") and "LessThanOrEqual(first,from)" in plan and "gaps" not in plan.split("ReadSchema")[1].split("\n")[0]
    for raw, k in (("that", 5), ("from that", 3), ("the", 1), ("the", 10_000), ("none_at_all", 4)):
        best, counts = ops.top(index, raw, k)
        wanted = sorted(((-r["score"], -r["at"].timestamp(), r["id"], r["kind"]) for r in search.match(rows, "text", raw).collect()))[:k]
        assert [(-r["score"], -r["at"].timestamp(), r["id"], r["kind"]) for r in best.collect()] == wanted, raw
        assert counts["read"] <= counts["blocks"]


def test_blocks_are_skipped(spark):
    rng = random.Random(4)
    index = ops.build(made(spark, [("source", k, k, " ".join(["word"] * (1 + (k % 400 == 7) * 9 + rng.randint(0, 2)) + ["x"])) for k in range(4000)]), bits=6)
    best, counts = ops.top(index, "word", 5)
    assert best.count() == 5 and counts["blocks"] >= 60 and counts["read"] <= 12


def test_places_are_kept(spark):
    texts = ["a b a  a-c", "c", "b a"]
    index = ops.build(made(spark, [("source", k, k, t) for k, t in enumerate(texts)]).coalesce(1))
    found = {}
    for r in index.postings(["a", "b", "c"]).distinct().collect():
        for word, most, where, there in ops.spelled_out(bytes(r["terms"]), bytes(r["sizes"]), {b"a", b"b", b"c"}):
            gaps = iter(ops.unpacked(bytes(r["gaps"])[there]).tolist())
            rows, counts = ops.rows_of(r["block"], bytes(r["coded"])[where], index.bits)
            for row, n in zip(rows.tolist(), counts.tolist()):
                at, places = 0, []
                for _ in range(n):
                    at += next(gaps)
                    places.append(at)
                found[word.decode(), row] = places
            assert most == max(counts)
    assert found == {("a", 0): [0, 2, 3], ("b", 0): [1], ("c", 0): [4], ("c", 1): [0], ("b", 2): [0], ("a", 2): [1]}


def test_numbers_are_packed():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(0, 1 << b, 200) for b in (1, 7, 8, 14, 21, 28, 31)] + [[0, 127, 128, (1 << 31) - 1]])
    data, at = ops.packed(values)
    assert ops.unpacked(data).tolist() == values.tolist() and at[-1] == len(data)
    assert len(ops.unpacked(ops.packed(np.empty(0, np.int64))[0])) == 0
    rows, counts = ops.rows_of(9, ops.packed(np.array([5, 1, 40, 3, 1, 200]))[0].tobytes(), 6)
    assert rows.tolist() == [581, 582, 622] and counts.tolist() == [3, 1, 200]


def test_postings_are_made_without_a_call_for_each_term():
    rng = random.Random(8)
    texts = [[rng.choice(["a", "b", "日本", "ñ", f"w{k}x{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 200))] for k in range(300)]
    # Rows of several files in one batch: numbers jump, and may go down.
    numbers = np.arange(300) + np.repeat([5 << 33, 1 << 33, 1 << 53], 100)
    profile = cProfile.Profile()
    made = profile.runcall(ops._blocks, numbers, pa.array(texts, pa.list_(pa.string())), 4)
    terms = {w for t in texts for w in t}
    assert pstats.Stats(profile).total_calls - 2 * made.num_rows < len(terms) / 2
    found = {}
    for r in made.to_pylist():
        for word, _, where, there in ops.spelled_out(r["terms"], r["sizes"], {w.encode() for w in terms}):
            assert r["bucket"] == ops.zlib.crc32(word) % ops.BUCKETS and r["first"] <= word.decode() <= r["last"]
            gaps = ops.unpacked(r["gaps"][there])
            rows, counts = ops.rows_of(r["block"], r["coded"][where], 4)
            for row, own in zip(rows.tolist(), np.split(gaps, np.cumsum(counts)[:-1])):
                found[row, word.decode()] = np.cumsum(own).tolist()
    assert found == {(n, w): [k for k, x in enumerate(t) if x == w] for n, t in zip(numbers.tolist(), texts) for w in t}


def test_replaced_items_and_odd_rows(spark):
    old = [("source", k, k, f"alpha beta {'alpha ' * (k % 3)}") for k in range(200)] + [("note", 1, 1000, "alpha"), ("note", None, 1001, "alpha beta"), ("note", 2, 1002, None), ("note", 2, 1003, ""), ("chat", 3, None, "ALPHA-beta"), ("source", 5, 5, "alpha beta"), ("source", 6, 6, "日本 alpha ñ")]
    new = [("source", 1, 1, "gamma beta"), ("source", 2, 2, ""), ("note", 300, 1, "beta alpha alpha"), ("note", None, 7, "alpha")]
    index = ops.replace(ops.build(made(spark, old)), made(spark, new))
    stays = [r for r in old if r[1] not in (1, 2)] + new
    for i in (index, ops.build(made(spark, stays))):
        for raw in ("alpha", "alpha beta", "gamma", "日本"):
            assert listed(ops.hits(i, raw), "kind", "item", "id", "score") == listed(search.match(made(spark, stays), "text", raw), "kind", "item", "id", "score"), raw
            got, _ = ops.top(i, raw, 4)
            assert listed(got, "score") == [(s,) for s in sorted(sorted((r["score"] for r in search.match(made(spark, stays), "text", raw).collect()), reverse=True)[:4])]
    empty = ops.build(made(spark, []))
    assert ops.hits(empty, "alpha").count() == 0 and ops.top(empty, "alpha", 3)[0].count() == 0


@pytest.mark.parametrize("sort", ["relevance", "recency"])
def test_pages_follow_each_other(spark, sort):
    rng = random.Random(9)
    data = [(rng.choice(["source", "note", "chat", "article"]), rng.randint(0, 30), k, " ".join(["alpha"] * rng.randint(0, 3) + ["beta"])) for k in range(300)]
    index = ops.build(made(spark, data))
    hits = [(kind, item, i, text.count("alpha")) for kind, item, i, text in data if "alpha" in text]
    groups = {}
    for kind, item, i, s in hits:
        if kind == "note":
            score, at = groups.get(item, (0, 0))
            groups[item] = (max(score, s), max(at, i))
    wanted = [k for k, (s, at) in sorted(groups.items(), key=lambda g: (-g[1][0], -g[1][1], g[0]) if sort == "relevance" else (-g[1][1], g[0]))]
    seen, after = [], None
    while True:
        page = ops.search_page(index, "alpha", facet="notes", sort=sort, after=after, limit=7, best=2)
        rows = page.groups.orderBy("place").collect()
        if not rows:
            break
        seen += [r["item"] for r in rows]
        after = seen[-1]
        for r in rows:
            own = sorted((-s, -i) for kind, item, i, s in hits if item == r["item"] and kind == "note")
            assert [(-b["score"], -b["id"]) for b in page.best.where(F.col("item") == r["item"]).orderBy("place").collect()] == own[:2] and r["n"] == len(own)
        assert page.totals.first().asDict() == {"hits": len(hits), "items": len({h[1] for h in hits})}
        assert {r["facet"]: r["n"] for r in page.facets.collect()} == {f: sum(h[0] in kinds for h in hits) for f, kinds in ops.FACETS.items()}
    assert seen == wanted
    assert [r["item"] for r in ops.search_page(index, "alpha", facet="notes", sort=sort, after=12345, limit=3).groups.orderBy("place").collect()] == wanted[:3]
    assert {r["item"] for r in ops.search_page(index, "alpha", item=4).groups.collect()} == {4}
