"""Best fragments against every window."""

import html
import random
import re

from quirelab.operators import fragments as ops


def test_fragments_by_hand(spark):
    assert ops.fragment(None, ["a"]) == ops.fragment("", ["a"]) == ""
    assert ops.fragment("A <b> cat", ["cat"]) == "…A &lt;b&gt; <mark>cat</mark>…"
    assert ops.fragment("no hit & " + "x" * 400, ["cat"]) == "…no hit &amp; " + "x" * 291 + "…"
    assert ops.fragment("Cat CAT", ["cat", ""]) == "…<mark>Cat</mark> <mark>CAT</mark>…"
    assert ops.fragment("y" * 1000, ["y" * 900]) == "…<mark>" + "y" * 300 + "</mark>…"
    df = spark.createDataFrame([(1, "one two"), (2, None)], "id int, text string")
    assert [r[0] for r in df.orderBy("id").select(ops.best_fragment(df["text"], ["two"])).collect()] == ["…one <mark>two</mark>…", ""]


def test_fragments_hold_the_most_matches():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["cat ", "é", "日本", "a & b ", "<i>", "dog", "xyz " * 8, "w" * 90]) for _ in range(rng.randint(1, 60)))
        matches = [m.span() for m in re.finditer("cat|dog", text, re.I)]
        shown = ops.fragment(text, ["cat", "dog"])
        assert len(shown) <= ops.CLIP + len(ops.CLOSE) and shown.startswith("…") and shown.endswith("…")
        assert shown.count(ops.OPEN) == shown.count(ops.CLOSE)
        plain = html.unescape(shown.replace(ops.OPEN, "").replace(ops.CLOSE, "").strip("…"))
        if not matches:
            assert text[:300].startswith(plain)
            continue
        start, end = ops.best_span(text, matches)
        assert len(text[start:end].encode()) <= ops.FRAGMENT
        inside = sum(a >= start and b <= end for a, b in matches)
        most = max(sum(c >= a and d <= len(text) and len(text[a:d].encode()) <= ops.FRAGMENT for c, d in matches) for a, _ in matches)
        assert inside >= most, text
        assert text[start:end].startswith(plain)


def test_clipping_closes_marks():
    shown = ops.fragment("<cat>" * 60, ["cat"])
    assert len(shown) <= ops.CLIP + len(ops.CLOSE) and shown.count(ops.OPEN) == shown.count(ops.CLOSE) and not re.search(r"<(?!/?mark>)|&(?!lt;|gt;)", shown)
