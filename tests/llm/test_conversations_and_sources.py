"""Chat formats, source divergence and the prefix trie against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelab.llm import chat, divergence, prefix_trie, queries, sequences

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    result = con.execute(queries.SQL[name])
    assert [d[0] for d in result.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(result.fetchall(), key=str)


def odd_turns(spark):
    """Nulls in any column, no texts, repeated turns, marks in texts and roles, a clashing column for each name used inside."""
    rng = random.Random(5)
    marks = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", "<\\s>", " ", "a", "\n", "é", "🎉"]
    data = [(k % 40, k // 40 if k % 11 else None, rng.choice(["user", "assistant", "system", "tool", "", "a\nb", " [/ROLE]", "<s>[INST] ", None]), "".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) if k % 13 else None) for k in range(400)]
    data += [(5, 3, "user", "same"), (5, 3, "user", "same"), (None, 1, "user", "no id"), (100, None, None, None), (-3, 0, "user", "x" * 200_000), (-3, 1, "assistant", "y z " * 50_000)]
    df = spark.createDataFrame(data, TURNS)
    for c in ("key", "order", "at", "piece", "layout", "payload", "conv", "place", "name", "words", "depth", "digest", "_value"):
        df = df.withColumn(c, F.lit("x"))
    return data, df


def ordered(data):
    """Turns of each conversation: by turn (null first), then by what is asked of ties."""
    groups = collections.defaultdict(list)
    for c, t, r, x in data:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    return groups


# chat formats


def test_formats_can_be_read_back(spark):
    data, df = odd_turns(spark)
    groups = {c: sorted(v, key=lambda t: (t[0], t[1], sha(f"{t[2]}\n{t[3]}"))) for c, v in ordered(data).items()}
    groups[-7] = [(1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    formatted = chat.format_conversations(df)
    found = {r["conv_id"]: r for r in chat.digest(formatted, "conv_id").collect()}
    assert found.keys() == groups.keys()
    for c, turns in groups.items():
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(said), sha(said)), c
    # No text opens or closes a turn: the marks of a whole conversation are those of its turns.
    pieces = collections.defaultdict(list)
    for r in formatted.orderBy("conv_id", "order").collect():
        pieces[r["conv_id"]].append(r["piece"])
    for c, parts in pieces.items():
        whole = "".join(parts)
        assert re.findall(r"<s>.*?</s>", whole, re.S) == parts and whole.count("<s>") == whole.count("</s>") == len(parts)
        assert found[c]["formatted_chars"] == len(whole)
        assert len(re.findall(re.escape("[INST]"), whole)) == sum(t[2] == "user" for t in groups[c])
    assert [r["conv_id"] for r in chat.digest(chat.format_conversations(df.limit(0)), "conv_id").collect()] == [-7]


def test_layouts_become_turns(spark):
    wanted = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": None, "output": "a"},
        {"prompt": "q", "completion": "a", "meta": {"messages": 1}},
        {"prompt": "q", "response": "a"},
        {"question": "q", "answer": "a"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records * 2)], "k long, payload string")
    rows = collections.defaultdict(list)
    for r in chat.canonical_turns(df, "payload", ["k"]).orderBy("k", "at").collect():
        rows[r["k"]].append((r["role"], r["text"]))
    assert [rows[k] for k in range(14)] == [wanted] * 14
    more = {"instruction": "i", "input": "x", "output": "o", "system": "s"}
    odd = spark.createDataFrame([(0, json.dumps(more)), (1, "not json"), (2, None), (3, "[1]"), (4, '{"other": 1}'), (5, '{"messages": []}'), (6, '{"messages": [{"role": null, "content": null}]}'), (7, '{"prompt": 7, "completion": {"b": [1]}}')], "k long, payload string")
    found = sorted((r["k"], r["layout"], r["at"], r["role"], r["text"]) for r in chat.canonical_turns(odd, "payload", ["k"]).where("layout IS NOT NULL").collect())
    assert found == [(0, "instruction", 0, "system", "s"), (0, "instruction", 1, "user", "i\n\nx"), (0, "instruction", 2, "assistant", "o"), (6, "messages", 0, "", ""), (7, "prompt and completion", 0, "user", "7"), (7, "prompt and completion", 1, "assistant", '{"b": [1]}')]
    assert chat.canonical_turns(odd, "payload", ["k"]).where("layout IS NULL").count() == 5
    assert chat.format_turns(chat.canonical_turns(odd, "payload", ["k"]), "k").count() == 6


def test_equal_paths_have_equal_fingerprints():
    a = {"b": [{"c": 1}, {"d": 2}], "e": {"f": None}}
    assert chat.fingerprint(a) == chat.fingerprint({"e": {"f": "x"}, "b": [{"d": 0, "c": 0}]}) != chat.fingerprint({"b": {"c": 1, "d": 2}, "e": {"f": 1}})
    assert set(chat.field_paths(a)) == {"b", "b[].c", "b[].d", "e", "e.f"}


# divergence


def plain_audit(data, least, top):
    words = [(d[2] or "", d[3] or "", re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d[1] or ""))) for d in data]
    out = []
    for lang in {w[0] for w in words}:
        docs = collections.Counter(t for l, _, ws in words if l == lang for t in set(ws))
        kept = sorted(t for t, n in docs.items() if n >= least)
        counts = {s: collections.Counter() for l, s, _ in words if l == lang}
        for l, s, ws in words:
            if l == lang:
                counts[s].update(t for t in ws if docs[t] >= least)
        whole = sum(counts.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s))
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["alpha", "Beta", "gamma", "ÄÖ", "日本", "x", "Zz", "don", "ñandú", "e" * 300, "W🎉w"]
    data = [(k, "".join(rng.choice(vocabulary[: 3 + k % 9]) + rng.choice([" ", "\n", "1", "-", "\x7f", "", "\x00"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "s3", "s4"])) for k in range(150)]
    data += [(1, None, None, None), (2, "", "fr", "only"), (3, "12 3", "xx", "p"), (4, "!", "xx", "q"), (data[0][0], *data[0][1:])]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    for c in ("term", "n", "docs", "at", "p", "total", "bucket"):
        df = df.withColumn(c, F.lit("x"))
    wanted = plain_audit(data, 4, 3)
    sizes = divergence.TILE, divergence.BUCKET, divergence.BROADCAST_GROUPS, divergence.HELD_CELLS
    assert sorted(map(tuple, divergence.audit(df, 4, 3).collect())) == wanted and len(wanted) > 100
    # Tiles of two sources, several buckets, no broadcast, cells given out early.
    divergence.TILE, divergence.BUCKET, divergence.BROADCAST_GROUPS, divergence.HELD_CELLS = 2, 4, 0, 50
    try:
        assert sorted(map(tuple, divergence.audit(df, 4, 3).collect())) == wanted
    finally:
        divergence.TILE, divergence.BUCKET, divergence.BROADCAST_GROUPS, divergence.HELD_CELLS = sizes
    assert divergence.audit(df.limit(0)).count() == 0


def test_colliding_slices_are_told_apart():
    texts = ["aa bb", "", "bb cc aa aaa", "Bb", "b"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for digest in (lambda b: 7, len, lambda b: hash(b) & 0xFFFF):
        terms = divergence.Terms(data, offsets, digest)
        assert [terms.words[k].decode() for k in terms.number] == ["aa", "bb", "bb", "cc", "aa", "aaa", "bb", "b"]
        assert terms.doc.tolist() == [0, 0, 2, 2, 2, 2, 3, 4]
        assert len(set(terms.words)) == len({terms.words[k] for k in terms.number})


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 3 * 10**15 + 1, 7 * 10**16, 9
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    assert df.select(divergence._share(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)


# the trie


def plain_trie(data):
    turns = {c: sorted(v, key=lambda t: (t[0], t[1], sha(f"{len(t[2])}:{t[2]}{t[3]}"))) for c, v in ordered(data).items() if c is not None}
    turns = {c: [t[2:] for t in v] for c, v in turns.items()}
    rem = lambda c: c - int(c / 20) * 20
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - rem(c), [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    words = lambda p: len(re.findall("[^\\x20\\x09-\\x0D]+", p[-1][1])) if p else 0
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * words(p)
    return sorted(((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p)))))) for p, cs in members.items()), key=str)


def test_trie_against_brute_force(spark):
    data, df = odd_turns(spark)
    assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=str) == plain_trie(data)
    rng = random.Random(8)
    # Few different turns, long conversations, many copies, families without a first one and conversations without turns.
    data = [(c, t, rng.choice("ua"), rng.choice(["x y", "z", ""])) for c in [*range(0, 30), *range(45, 60)] for t in range(rng.choice([1, 2, 3, 7, 8, 9]))]
    data += [(c, t, "u", "t" + "w " * (t % 3)) for c in range(60, 100) for t in range(33)] + [(200, t, "a", str(t)) for t in range(100)]
    small = spark.createDataFrame(data, TURNS)
    assert sorted(map(tuple, prefix_trie.trie(small).collect()), key=str) == plain_trie(data)
    assert prefix_trie.trie(small.limit(0)).count() == 0


def test_running_sums_and_digests_over_ranges(spark):
    data = [(k, i, (k * 7 + i) % 5) for k, n in ((1, 3), (2, 5000), (3, 1), (4, 700)) for i in range(n)]
    df = spark.createDataFrame(data, "k long, i long, v long").repartition(7)
    found = {(r["k"], r["i"]): r["s"] for r in sequences.in_order(df, "k", [F.col("i")], F.col("v"), "s").collect()}
    wanted = {}
    for k, rows in itertools.groupby(sorted(data), key=lambda r: r[0]):
        total = 0
        for _, i, v in rows:
            wanted[k, i] = total
            total += v
    assert found == wanted
    size, sequences.CHUNK = sequences.CHUNK, 50
    try:
        made = {r["k"]: r["h"] for r in sequences.hashed(df, ["k"], "i", F.col("v").cast("string"), "h", between=",").collect()}
    finally:
        sequences.CHUNK = size
    assert made == {k: sha(",".join(str(r[2]) for r in rows)) for k, rows in itertools.groupby(sorted(data), key=lambda r: r[0])}
