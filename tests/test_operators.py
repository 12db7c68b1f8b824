"""Hand-computed cases, and random cases against plain restatements."""

import datetime as dt
import itertools
import json
import math
import random
import re
import time
import unicodedata
from difflib import SequenceMatcher

import pytest
import xxhash
from pyspark.sql import functions as F

from quirelab.operators import anchors, documents, library, records, revisions, search, threads, timeseries
from quirelab.operators import nested as nested_ops
from quirelab.operators import texts as texts_ops
from quirelab.sources import exports, html, papers
from quirelab.streaming import streams


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_fusion_by_hand(spark):
    lists = [spark.createDataFrame(list(zip(ids, range(3))), "id string, rank int") for ids in ("abc", "bca")]
    found = rows(search.fuse(lists).orderBy(F.desc("score"), "id"))
    assert [r[0] for r in found] == ["b", "a", "c"]
    assert found[0][1] == pytest.approx(1 / 62 + 1 / 61)


def test_fusion_counts_a_repeated_id_once(spark):
    twice = spark.createDataFrame([("a", 0), ("a", 5), ("b", 1)], "id string, rank int")
    assert rows(search.fuse([twice], k=60), "id")[0][1] == pytest.approx(1 / 61)


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, round(math.sqrt(0.5), 6)]


def test_query_length():
    assert search.normalised_query("  a   b ") == "a b"
    for bad in ("", "   ", "x" * 201):
        with pytest.raises(ValueError):
            search.normalised_query(bad)


@pytest.mark.parametrize("descending", [True, False])
def test_keyset_pages_cover_all_rows_once(spark, descending):
    rng = random.Random(3)
    data = [(i, rng.choice([None, 1, 2, 3, 3, 3, 4])) for i in range(40)]
    df = spark.createDataFrame(data, "id int, k int").coalesce(1)
    seen, cursor = [], None
    while True:
        got = [tuple(r) for r in library.page(df, "k", "id", 7, cursor, descending).collect()]
        seen += got[:7]
        if len(got) <= 7:
            break
        cursor = library.decode_cursor(library.encode_cursor(got[6][1], got[6][0]))
    wanted = sorted(data, key=lambda r: (r[1] is None, (-1 if descending else 1) * (r[1] or 0), (-1 if descending else 1) * r[0]))
    assert seen == wanted


def test_review_replay_against_restatement(spark):
    rng = random.Random(5)
    cases = [[rng.random() < 0.75 for _ in range(rng.randint(0, 14))] for _ in range(60)]

    def plainly(results):
        stage, mastered = 1, False
        for good in results:
            if not good:
                stage, mastered = 1, False
            elif mastered or stage >= 5:
                stage, mastered = 5, True
            else:
                stage += 1
        return stage, mastered, len(results)

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, r array<boolean>")
    found = rows(df.select("i", timeseries.replay_reviews(F.col("r")).alias("s")).select("i", "s.*"), "i")
    assert [r[1:] for r in found] == [plainly(c) for c in cases]


def test_next_review(spark):
    df = spark.createDataFrame([(1, False), (5, False), (5, True)], "s int, m boolean")
    found = df.select(timeseries.next_review(F.lit("2024-02-01").cast("date"), F.col("s"), F.col("m"))).collect()
    assert [r[0] for r in found] == [dt.date(2024, 2, 2), dt.date(2024, 3, 2), None]


def test_hours_are_rounded_half_to_even(spark):
    df = spark.createDataFrame([("2024-01-03 10:00:00", 900)], "t string, seconds int").select(F.col("t").cast("timestamp").alias("ts"), "seconds")
    found = rows(timeseries.weekly_hours(df, "2024-01-10", 3), "week")
    assert found == [(dt.date(2023, 12, 25), 0.0), (dt.date(2024, 1, 1), 0.2), (dt.date(2024, 1, 8), 0.0)]


def test_greedy_batches_against_restatement(spark):
    rng = random.Random(7)
    data = [(d, p, "x" * rng.choice([10, 400, 2500, 9000])) for d in range(12) for p in range(rng.randint(1, 30))]
    found = {(r[0], r[1]): r[2] for r in rows(documents.greedy_batches(spark.createDataFrame(data, "doc_id long, position int, text string")))}
    for d in range(12):
        batch = n = total = 0
        for _, p, t in sorted(x for x in data if x[0] == d):
            size = math.ceil(len(t) / 4 * 1.1)
            if n and (n >= 8 or total + size > 2800):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + size
            assert found[d, p] == batch


def test_budget_cut_keeps_the_newest_in_any_case(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 900), (2, 1, 30), (2, 2, 30)], "g int, o int, n int")
    assert [r[:2] for r in rows(documents.budget_cut(df, "g", "o", "n", 100), "g", "o")] == [(1, 3), (2, 1), (2, 2)]


def test_readable_prefix(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 1, True), (1, 2, False), (1, 3, True), (2, 0, False)], "doc_id int, section int, done boolean")
    assert rows(documents.readable_prefix(df), "doc_id") == [(1, 1), (2, None)]


def test_block_ids_are_unique_and_stable(spark):
    data = [(1, p, 0, "paragraph", t) for p, t in enumerate(["same", "same", "ｆull  width", "other"])]
    df = spark.createDataFrame(data, "doc_id long, position int, section int, kind string, text string")
    ids = [r["block_id"] for r in documents.block_ids(df).orderBy("position").collect()]
    assert len(set(ids)) == 4
    assert ids[2].endswith(xxhash.xxh64_hexdigest("full width")[:4])


def test_carry_over_by_hand():
    old = [(0, "alpha beta gamma"), (1, "second block of text here"), (2, "third"), (3, "fourth")]
    new = [(0, "alpha beta gamma"), (1, "inserted"), (2, "second block of text hero"), (3, "fourth")]
    found = {n: (o, how) for n, o, how in documents._continued(old, new)}
    assert found[0] == (0, "hash") and found[3] == (3, "hash")
    assert found[1] == (1, "order") and found[2] == (2, "order")
    moved = {n: (o, how) for n, o, how in documents._continued(old, new[:3] + [(3, "x"), (4, "fourth")])}
    assert moved[2] == (1, "fuzzy") and 1 not in moved


def test_carry_over_scores_few_pairs(monkeypatch):
    rng = random.Random(4)
    words = ["the", "of", "model", "graph", "is", "deep", "and", "loss", "0.25", "ünï"]
    scored = []

    class Counted(SequenceMatcher):
        def ratio(self):
            scored.append(1)
            return super().ratio()

    monkeypatch.setattr(documents, "SequenceMatcher", Counted)
    for size in (3, 12, 60):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(size // 2, size))) for _ in range(25)]
        old = list(enumerate([rng.choice(texts) for _ in range(50)] + ["", ""]))
        new = [rng.choice(texts) for _ in range(50)] + [""]
        new = list(enumerate(t + "!" if rng.random() < 0.2 else t[:40] + t[43:] if rng.random() < 0.2 else t for t in new))
        found = documents._continued(old, new)
        fixed = {n: o for n, o, how in found if how != "fuzzy"}
        ratios = sorted((-r, n, o) for n, t in new if n not in fixed for o, u in old if o not in fixed.values() and (r := SequenceMatcher(None, u, t).ratio()) >= 0.9)
        wanted, used = {}, set()
        for _, n, o in ratios:
            if n not in wanted and o not in used:
                wanted[n] = o
                used.add(o)
        assert {n: o for n, o, how in found if how == "fuzzy"} == wanted and wanted
    del scored[:]
    same = list(enumerate(["same line of text"] * 40))
    assert documents._continued(same, same + [(40, "another")]) == [(k, k, "fuzzy") for k in range(40)] and not scored


def test_sequence_diff(spark):
    df = spark.createDataFrame([(1, list("abcd"), list("abxd")), (2, [], ["a"]), (3, None, None)], "doc_id int, old array<string>, new array<string>")
    assert rows(documents.sequence_diff(df), "doc_id") == [(1, 3, 1, 1), (2, 0, 0, 1), (3, 0, 0, 0)]


def _plain_duplicates(data):
    """(first_id, ratio) of each id, of rows (id, title, surname, year)."""
    normal = lambda t: " ".join(sorted(re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKC", t).lower()).split()))
    data = [(i, normal(t) if t is not None else None, s and s.lower(), y) for i, t, s, y in data]
    ratios, out = {}, {}
    for i, x, s, y in data:
        links = []
        for j, z, u, v in data:
            if i != j and None not in (x, z, s) and s == u and (y is None or v is None or abs(y - v) <= 1):
                if (x, z) not in ratios:
                    ratios[x, z] = SequenceMatcher(None, x, z).ratio()
                if ratios[x, z] >= 0.92:
                    links.append((j, round(ratios[x, z], 6)))
        out[i] = min(links) if links else (None, None)
    return out


def _duplicates(df):
    return {r[0]: (r["first_id"], r["ratio"]) for r in df.collect()}


def test_fuzzy_duplicates(spark):
    data = [(1, "Attention Is All You Need", "Vaswani", 2017), (2, "All you need is attention!", "vaswani", 2018), (3, "Attention Is All You Need", "Other", 2017), (4, "Attention is all you need", "Vaswani", 2020), (5, None, "Vaswani", 2017), (6, "Attention is all you need", None, 2017), (7, "attention is all we need", "VASWANI", None), (8, "--", "x", 1), (9, "", "x", 2), (10, "??", "x", 9)]
    found = _duplicates(documents.fuzzy_duplicates(spark.createDataFrame(data, "id int, t string, s string, y int"), "id", "t", "s", "y"))
    assert found == _plain_duplicates(data) and found[1] == (2, 1.0) and found[4] == found[5] == found[6] == (None, None) and found[8] == (9, 1.0)


def test_fuzzy_duplicates_against_all_pairs(spark, sf, monkeypatch):
    from quirelab.plans import catalog

    docs = [(r["doc_id"], r["text"].split("\n")[0], r["source"], 2020) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _duplicates(catalog.QUERIES["fuzzy_duplicates"](spark, sf)) == _plain_duplicates(docs)
    rng = random.Random(3)
    data = []
    for i in range(250):
        words = [rng.choice(["deep", "nets", "of", "graph", "models", "x1"]) for _ in range(rng.choice([1, 2, 3, 8, 40]))]
        data.append((i, " ".join(words), "s", rng.choice([2019, 2020, 2021, 2022, None])))
        data.append((i + 1000, "".join(c for c in " ".join(reversed(words)) if rng.random() > 0.03), "S", 2020))
    monkeypatch.setattr(documents, "TITLES", 150)
    rows_ = spark.createDataFrame(data, "id int, t string, s string, y int").withColumn("n", F.lit("x")).withColumn("h", F.lit("x"))
    assert _duplicates(documents.fuzzy_duplicates(rows_, "id", "t", "s", "y")) == _plain_duplicates(data)
    assert documents.fuzzy_duplicates(rows_.limit(0), "id", "t", "s", "y").count() == 0


def test_few_titles_of_one_vocabulary_are_compared_in_full(monkeypatch):
    rng = random.Random(5)
    syllables = ["th", "er", "ing", "on", "an", "ti", "re", "ed", "ou", "ha", "ble", "wh", "st", "nd", "en"]
    titles = [" ".join(sorted("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(100))) for _ in range(120)]
    titles += [t[:-9] for t in titles[:5]] + [t[:190] for t in titles[:5]] + [t[:93] + t[96:190] for t in titles[:5]] + ["a" * 600, "a" * 599 + "b", "abc", "abcd"]
    wanted = {}
    for i, t in enumerate(titles):
        for j, u in enumerate(titles):
            if t != u and i not in wanted and (m := SequenceMatcher(None, t, u)).quick_ratio() >= 0.92 and m.ratio() >= 0.92:
                wanted[i] = (j, m.ratio())
    calls, whole = [], documents._common_at_least
    monkeypatch.setattr(documents, "_common_at_least", lambda *x: calls.append(1) or whole(*x))
    found = documents.first_near(titles, titles, lambda i, j: True, 0.92)
    assert {i: (j, r) for i, j, r in found} == wanted and len(wanted) >= 12
    assert len(calls) < 0.05 * len(titles) ** 2


def test_page_positions_of_every_block(spark, sf):
    from quirelab.plans import catalog

    alnum = lambda t: "".join(c for c in t.lower() if c.isalnum())
    found = {r["doc_id"]: r["pages"] for r in catalog.QUERIES["page_positions"](spark, sf).collect()}
    docs = {r["doc_id"]: r["text"].split("\n") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert found.keys() == docs.keys() and any(len(b) > 20 for b in docs.values())
    for i, lines in docs.items():
        pages = [alnum(" ".join(lines[k : k + 5])) for k in range(0, len(lines), 5)]
        at, wanted = 0, []
        for line in lines:
            head = alnum(line)[:80]
            # Each block stands on a page of its own text, so that it is found by containment or an earlier likeness.
            hits = [k for k in range(at, len(pages)) if head and (head in pages[k] or max((m := SequenceMatcher(None, head, pages[k])).find_longest_match(0, len(head), 0, len(pages[k])).size / len(head), m.ratio()) >= 0.85)]
            wanted.append(hits[0] if hits else None)
            at = hits[0] if hits else at
        assert found[i] == wanted


def test_page_positions_reads_rows_of_bounded_size(spark):
    size = texts_ops.PIECE
    # Texts of several rows, cut inside words, between a sigma and the end of its word, and beside characters of four bytes.
    long = ["x" * (size - 1) + "\u03a3" + "y" * size + " end", "\U0001f600" * size + "beta gamma", "-" * (3 * size) + "Tail\n\u03a3", "a" * size]
    data = [(1, long, [" ".join(long[:2]), " ".join(long[2:])]), (1, ["tail\u03c3", "none of them", None], ["", *long]), (None, [], ["a"]), (2, None, None), (3, ["b", "a"], ["a", "b"]), (4, ["b" * 90] + ["\u03a3"] * 12, ["a"] * 9 + ["b" * 80])]
    schema = "doc_id int, blocks array<string>, pages array<string>"
    wanted = [(1, [0, 0, 1, 1]), (1, [3, None, None]), (None, []), (2, []), (3, [1, None]), (4, [9] + [None] * 12)]
    for n in ("1", "4", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            found = texts_ops.page_positions(spark.createDataFrame(data, schema).coalesce(1))
            assert list(map(tuple, found.collect())) == wanted
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Rows of arrays would hold ten thousand documents of any length at once.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan and "Generate explode" in plan
    assert found.schema == texts_ops.StructType.fromDDL("doc_id int, pages array<int>")


def test_quality_flags(spark):
    data = [("a 1,000 and 2", "b 1000 und 2"), ("x" * 80, "y" * 10), ("same 5", "same 5"), ("3 4", "4 4")]
    found = spark.createDataFrame(data, "s string, t string").select(documents.quality_flags(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in found] == [[], ["length_outlier"], ["untranslated"], ["number_mismatch"]]


def test_markdown_and_controls(spark):
    df = spark.createDataFrame([("# T\n> q\n- **b** [l](u) `c`\x07",)], "t string")
    r = df.select(documents.without_markdown(documents.sanitised(F.col("t"))), documents.sanitised(F.lit("a\x00b\tc"))).first()
    assert r[0] == "T q b l c" and r[1] == "ab\tc"


def test_html_blocks():
    page = "<html><head><title>x</title></head><body><nav><p>menu</p></nav><h1>A &amp; B</h1><p>one<br>two<p>three<ul><li>i</li></ul><script>var p='<p>';</script></body>"
    assert [(k, t) for _, _, k, t in html.blocks_of(page)] == [("heading", "A & B"), ("paragraph", "one two"), ("paragraph", "three"), ("list", "i")]
    assert html.blocks_of(None) == []


def test_bibtex_suffixes(spark):
    df = spark.range(1, 31).select(F.col("id"), F.lit("Müller").alias("s"), F.lit(2020).alias("y"))
    keys = [r["cite_key"] for r in exports.bibtex_keys(df, "id", "s", "y").orderBy("id").collect()]
    assert keys[:3] == ["muller2020", "muller2020a", "muller2020b"] and keys[26:29] == ["muller2020z", "muller2020aa", "muller2020ab"]


def test_csv_file_begins_with_a_byte_order_mark(spark, tmp_path):
    exports.write_csv(spark.createDataFrame([(1, ["x", "y"], 1.5)], "id int, a array<string>, h double").coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert text.startswith(b'"\xef\xbb\xbfid"') and b'"x; y","1.50"' in text


def test_dump_and_restore(spark, tmp_path):
    df = spark.createDataFrame([(1, 7), (2, 8)], "id int, user_id int")
    exports.dump({"items": df}, str(tmp_path))
    back = spark.read.json(str(tmp_path / "items"))
    assert back.count() == 2
    assert dict(rows(exports.restore(df, spark.createDataFrame([(1,), (3,), (None,)], "id int"), ["id"]))) == {"skipped": 1, "created": 1, "failed": 1}


def test_capped_log_and_replay(spark):
    log = spark.createDataFrame([(i, 1) for i in range(5)], "event_id int, user_id int")
    kept = streams.capped_log(log, spark.createDataFrame([(5, 1), (4, 1)], "event_id int, user_id int"), 3)
    assert [r[0] for r in rows(streams.replayed(kept, 1, 3))] == [4, 5]


def test_plans_push_down_and_prune(spark, sf):
    from quirelab.plans import catalog

    plan = catalog.QUERIES["list_filtered"](spark, sf)._jdf.queryExecution().toString()
    assert "o_custkey" not in plan.split("ReadSchema")[1]


def test_jats_and_latex_bodies():
    from quirelab.sources import papers

    xml = "<article><body><sec><title>A</title><p>one <b>two</b></p><sec><p>inner</p></sec></sec></body><back><ref-list><ref>r 1</ref></ref-list></back></article>"
    assert [(s, k, t) for _, s, k, t in papers.jats_body(xml)] == [("s1", "heading", "A"), ("s1", "paragraph", "one two"), ("s1/s1", "paragraph", "inner"), ("back", "reference_entry", "r 1")]
    assert papers.jats_body("<!DOCTYPE x [<!ENTITY a 'b'>]><article/>") == [] == papers.jats_body("<article>") == papers.jats_body(None)
    tex = r"""\documentclass{article}\newcommand{\us}{our method}
\begin{document} % note
\section{Intro} We show \us{} \cite{a}.

Second \emph{part}.
\begin{equation}a = b\end{equation}
\subsection{More}
\begin{itemize}\item one \item two\end{itemize}
\end{document} after"""
    assert [(s, k, t) for _, s, k, t in papers.latex_body(tex)] == [("s1", "heading", "Intro"), ("s1", "paragraph", "We show our method ."), ("s1", "paragraph", "Second part."), ("s1", "equation", "a = b"), ("s1/s1", "heading", "More"), ("s1/s1", "list", "one two")]
    assert papers.main_tex({"a/x.tex": tex, "b.tex": tex, "c.tex": "no"}) == "b.tex" and papers.main_tex({}) is None


def test_archives_are_bounded(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    from quirelab.sources import papers

    def tar(files):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, data in files:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    assert papers.unpacked("x", tar([("a.tex", b"hi"), ("../up", b"no"), ("/abs", b"no")])) == [("a.tex", b"hi", ""), ("../up", b"", "outside"), ("/abs", b"", "outside")]
    assert papers.unpacked("x", tar([("bomb", b"0" * 5_000_000)]))[-1][2] == "too large"
    assert papers.unpacked("x", b"nothing")[-1][2] == "damaged"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/f.py", "print()")
    (tmp_path / "f.zip").write_bytes(out.getvalue())
    found = papers.read_archives(spark.read.format("binaryFile").load(str(tmp_path)))
    assert [(r["path"], bytes(r["content"])) for r in found.collect()] == [("d/f.py", b"print()")]


def test_layout_by_hand(spark):
    from quirelab.operators import layout

    lines = [(1, 0, 0, 40.0, 50.0, 10.0, "First line of a para-"), (1, 1, 0, 52.0, 50.0, 10.0, "graph goes on"), (1, 2, 0, 90.0, 50.0, 10.0, "New one"), (1, 3, 0, 102.0, 62.0, 10.0, "indented"), (1, 4, 1, 40.0, 50.0, 10.0, "next page")]
    df = spark.createDataFrame(lines, "doc_id long, position int, page int, y double, x double, height double, text string")
    assert [r["paragraph"] for r in layout.paragraphs(df).orderBy("position").collect()] == [0, 0, 1, 2, 3]
    assert spark.range(1).select(layout.joined(F.array(F.lit("para-"), F.lit("graph A-"), F.lit("Bee  ")))).first()[0] == "paragraph A- Bee"
    boxes = [F.lit(float(x)) for x in (0, 0, 2, 2)], [F.lit(float(x)) for x in (1, 1, 3, 3)]
    assert spark.range(1).select(layout.intersection_over_union(*boxes)).first()[0] == pytest.approx(1 / 7)
    rows_ = [(1, 0, 0, "Ends here."), (1, 1, 0, "goes on without"), (1, 2, 1, "a break here"), (1, 3, 1, "Last")]
    merged = layout.continued_paragraphs(spark.createDataFrame(rows_, "doc_id int, paragraph int, page int, text string"))
    assert [r["merged"] for r in merged.orderBy("paragraph").collect()] == [0, 1, 1, 2]
    refs = spark.createDataFrame([(1, 0, "References"), (1, 1, "[1] A. One,"), (1, 2, "Title."), (1, 3, "[2] B. Two")], "doc_id int, position int, text string")
    assert [tuple(r) for r in layout.grouped_references(refs).orderBy("reference").collect()] == [(1, 0, "References"), (1, 1, "[1] A. One, Title."), (1, 2, "[2] B. Two")]


def test_greedy_assignment_and_evidence(spark):
    from quirelab.operators import anchors

    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.95), (1, 2, 2, 0.94), (1, 2, 1, 0.5)], "doc_id int, a int, b int, score double")
    assert sorted((r["a"], r["b"]) for r in anchors.assigned_pairs(pairs).collect()) == [(1, 2), (2, 1)]
    known = spark.range(1).select(anchors.known_evidence(F.array(*map(F.lit, "bxab")), F.array(*map(F.lit, "ab"))))
    assert known.first()[0] == ["b", "a"]


def test_published_blocks_keep_titles_only(spark):
    from quirelab.operators import views

    row = ([{"kind": "text", "text": "t", "evidence": [{"title": "T", "quote": "secret"}]}, {"kind": "private", "text": "p", "evidence": []}],)
    df = spark.createDataFrame([row], "b array<struct<kind: string, text: string, evidence: array<struct<title: string, quote: string>>>>")
    assert [x.asDict() for x in df.select(views.published(F.col("b"), ("text",))).first()[0]] == [{"kind": "text", "text": "t", "evidence": ["T"]}]


def test_written_tables_can_be_deleted(spark):
    from pathlib import Path

    from quirelab import session

    a, b = (session.materialise(spark.range(3).toDF("x"), "t") for _ in range(2))
    paths = [Path(t._quirelab_path.removeprefix("file://")) for t in (a, b)]
    assert a.count() == 3 and all(p.exists() for p in paths)
    session.discard(a)
    assert [p.exists() for p in paths] == [False, True]
    session.cleanup(spark)
    assert not any(p.exists() for p in paths)


def test_search_tokens_of_any_script(spark):
    data = [(1, "Un café noir"), (2, "state-of-the-art methods"), (3, "cafe"), (4, "日本 語 test"), (5, None), (6, "the state art")]
    df = spark.createDataFrame(data, "id int, t string")
    ids = lambda q: sorted(r["id"] for r in search.match(df, "t", q).collect())
    assert ids("café") == [1] and ids("CAFÉ noir") == [1] and ids("state-of-the-art") == [2] and ids("日本") == [4] and ids("!!!") == []


def test_quotes_of_any_length_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gam", "de", "(x)", "“so", "it”", "—", "été", "a.b"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(60, None), (61, ""), (7, "alpha beta")]
    quotes = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for k in range(60)]
    for k in range(40):
        t = rng.choice(texts[:60])[1]
        at = rng.randrange(max(1, len(t)))
        quotes.append((100 + k, t[at : at + rng.choice([1, 5, 23, 24, 30, 80])]))
    quotes += [(200, None), (201, "")]
    found = documents.contained_quotes(spark.createDataFrame(quotes, "q int, quote string"), "q", "quote", spark.createDataFrame(texts, "id int, t string"), "id", "t")
    wanted = {(i, q, t.index(quote) + 1) for i, t in texts if t for q, quote in quotes if quote and quote in t}
    assert {tuple(r) for r in found.collect()} == wanted and len(wanted) > 100


def test_time_to_live_slides(spark):
    day = "2024-01-%02d 12:00:00"
    data = [("a", day % 6, 1), ("a", "2024-01-06 14:00:00", 2), ("a", day % 12, 3), ("a", day % 13, 4), ("a", day % 14, 5), ("b", day % 13, 6), (None, day % 1, 7), (None, day % 2, 8), ("b", None, 9), ("b", day % 13, 6)]
    df = spark.createDataFrame(data, "k string, ts string, id int")
    kept = sorted(r["id"] for r in timeseries.ttl_deduplicated(df, ["k"], "ts", 7, "id").collect())
    assert kept == [1, 4, 6, 7]
    assert timeseries.ttl_deduplicated(df.limit(0), ["k"], "ts", 7).count() == 0


def test_jats_with_an_external_document_type():
    article = "<article><body><sec><title>T</title><p>Text here.</p></sec></body></article>"
    external = '<!DOCTYPE article PUBLIC "-//NLM//DTD JATS 1.2//EN" "JATS-archivearticle1.dtd">'
    assert papers.jats_body(external + article) == papers.jats_body(article) != []
    assert papers.jats_body('<!DOCTYPE article [<!ENTITY x "y">]>' + article) == []


def test_placeholders_against_a_walk(spark):
    texts = ["plain", "a $x_1$ b `code` c [1, 2] d", "$$ open [x] [12]", "", "two\nlines $a\nb$ end", "`a``b`"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("e", anchors.with_placeholders(F.col("t")))
    for r in df.withColumn("back", anchors.restored(F.col("e.text"), F.col("e.values"))).collect():
        values = re.findall(r"(\$[^$]+\$|`[^`]+`|\[[0-9, ]+\])", r["t"])
        out = r["t"]
        for k, v in enumerate(values):
            out = out.replace(v, f"⟦{k}⟧", 1)
        assert (r["e"]["text"], r["e"]["values"], r["back"]) == (out, values, r["t"])


def test_records_by_hand(spark):
    notes = spark.createDataFrame([(1, "yellow", "hi", 5, "note"), (1, "blue", " ", None, "note"), (1, None, None, None, "x"), (None, "pink", "y", 1, "note")], "item int, colour string, comment string, block_id int, kind string")
    counts = {r["item"]: r for r in records.annotation_counts(notes, "item").collect()}
    assert (counts[1]["total"], counts[1]["yellow"], counts[1]["blue"], counts[1]["with_comment"], counts[1]["unplaced"]) == (3, 1, 1, 1, 2) and counts[None]["pink"] == 1
    assert records.filtered_annotations(notes).count() == 4 and records.filtered_annotations(notes, has_comment=False).count() == 2
    jobs = spark.createDataFrame([(1, "q", "queued", 3), (2, "q", "queued", 1), (3, "q", "running", 0), (4, "r", "queued", 9)], "job int, queue string, status string, since int")
    assert {r["job"]: r["status"] for r in records.claimed(jobs, 1, "queue", "since").collect()} == {1: "queued", 2: "running", 3: "running", 4: "running"}
    tries = spark.createDataFrame([(1, 1, "a", False, 5), (1, 2, "a", False, 6), (1, 3, "a", True, 7), (1, 4, "b", True, 8), (1, 5, "b", True, 9)], "r int, n int, provider string, ok boolean, tokens int")
    assert sorted((r["attempt"], r["provider"], r["tokens"]) for r in records.attempt_usage(tries, "r", "n", 2).collect()) == [(1, "a", 5), (2, "a", 6), (3, "b", 8)]
    nested = spark.createDataFrame([(1, '{"a":[{"asset_key":"k1"},{"b":{"asset_key":"k2"}}],"asset_key":"k1"}'), (2, None), (3, "{}")], "id int, j string")
    assert [(r["id"], r["value"]) for r in nested_ops.key_strings(nested, "id", "j", ["asset_key"]).collect()] == [(1, "k1"), (1, "k2")]


def test_repeated_batches_write_once(spark, sf):
    from quirelab.streaming import streams

    found = streams.run_once(streams.read_events(spark, sf), "repeat")
    again = streams.run_once(streams.read_events(spark, sf), "repeat")
    assert found.count() == again.count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_running_lines_and_column_order(spark):
    from quirelab.operators import layout

    schema = "doc_id int, position int, page int, x0 double, x1 double, y0 double, y1 double, width double, height double, text string"
    line = lambda position, page, x0, x1, y0, text: (1, position, page, x0, x1, y0, y0 + 10, 600.0, 800.0, text)
    data = [line(0, 0, 50.0, 550.0, 20.0, "Journal 1"), line(10, 1, 50.0, 200.0, 20.0, "Journal 2"), line(11, 1, 290.0, 310.0, 770.0, " 12 "), line(12, 1, 50.0, 200.0, 400.0, "Journal 3"), line(13, 1, 50.0, 200.0, 30.0, None)]
    data += [line(k, 0, 50.0 if k % 2 else 320.0, 280.0 if k % 2 else 550.0, 30.0 + 12 * k, f"t{k}") for k in range(1, 8)]
    df = spark.createDataFrame(data, schema)
    assert {r["position"] for r in layout.running_lines(df, df["text"]).where("running").collect()} == {0, 10, 11}
    found = layout.column_order(df.where("page = 0")).orderBy("order").collect()
    assert [r["position"] for r in found] == [0, 1, 3, 5, 7, 2, 4, 6] and found[0]["two_columns"]
    # One column: by y, whatever the side.
    assert [r["position"] for r in layout.column_order(df.where("page = 1")).orderBy("order").collect()] == [10, 13, 12, 11]
    assert layout.running_lines(df.limit(0), df["text"]).count() == layout.column_order(df.limit(0)).count() == 0


def test_included_tex_and_bodies(spark):
    from quirelab.sources import papers

    files = {"main.tex": "\\documentclass{a}\\begin{document}\\input{one}\\include{two.tex}\\input{none}% \\input{one}\n\\end{document}", "one.tex": "First \\input{main} \\input{two}", "two.tex": "second"}
    assert papers.whole_tex(files) == "\\documentclass{a}\\begin{document}First  secondsecond\n\\end{document}"
    assert papers.whole_tex({"a.tex": "no"}) is None
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<article"), (4, "<article><body><p>x</p></body></article>")], "id int, t string")
    assert [tuple(r) for r in papers.bodies(df, "id", "t", "jats").collect()] == [(4, 0, "", "paragraph", "x")]
    assert papers.bodies(df.limit(0), "id", "t", "latex").count() == 0


def test_restored_marks_of_the_text_itself(spark):
    texts = ["⟦0⟧ $x$ ⟦1⟧", "⟦1⟧ `a` ⟦0⟧ [3]", "⟦99999999999999⟧ $y$", "⟦", "⟦a⟧ $z$ ⟧", "$⟦0⟧$"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("e", anchors.with_placeholders(F.col("t")))
    for r in df.withColumn("back", anchors.restored(F.col("e.text"), F.col("e.values"))).collect():
        assert r["back"] == r["t"] and re.findall("⟦([0-9]+)⟧", r["e"]["text"]) == [str(k) for k in range(len(r["e"]["values"]))]
    swapped = spark.createDataFrame([("⟦1⟧ und ⟦0⟧ ⟦7⟧", ["a⟦1⟧", "b"])], "t string, v array<string>")
    assert swapped.select(anchors.restored(F.col("t"), F.col("v"))).first()[0] == "b und a⟦1⟧ ⟦7⟧"


def test_null_arrays_of_blocks(spark):
    schema = "doc_id long, old array<struct<position: int, text: string>>, new array<struct<position: int, text: string>>"
    df = spark.createDataFrame([(1, None, [(0, "a")]), (2, [(0, "a")], None), (3, [(0, None)], [(0, None)]), (4, None, None)], schema)
    assert rows(documents.carry_over(df), "doc_id") == [(3, 0, 0, "hash")]
    pages = spark.createDataFrame([(1, None, ["a"]), (2, ["a"], None), (3, ["alpha", None], [None, "alpha beta"])], "doc_id long, blocks array<string>, pages array<string>")
    assert {r["doc_id"]: r["pages"] for r in texts_ops.page_positions(pages).collect()} == {1: [], 2: [None], 3: [1, None]}


def test_long_documents_are_batched_in_one_pass(spark):
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("position"), F.repeat(F.lit("x"), (F.col("id") % 2000).cast("int")).alias("text"))
    began = time.time()
    assert documents.greedy_batches(df).agg(F.max("batch")).first()[0] >= 100_000 / 8 - 1
    assert time.time() - began < 60


def test_threads_by_pointer_jumping(spark):
    rng = random.Random(2)
    parents = {(t, m): rng.choice([None, rng.randrange(60), rng.randrange(60), 1000]) for t in range(4) for m in range(60)}
    data = [(t, m, p) for (t, m), p in parents.items()] + [(9, 1, 2), (9, 2, 3), (9, 3, 1), (9, 4, 3), (9, 5, 5), (None, 1, None), (9, None, 1), (8, 1, None), (8, 1, 7)]
    parents |= {(9, 1): 2, (9, 2): 3, (9, 3): 1, (9, 4): 3, (9, 5): 5, (8, 1): 7}
    wanted = {}
    for t, m in parents:
        at, depth, seen = m, 0, set()
        while parents.get((t, at)) is not None and (t, parents[t, at]) in parents and at not in seen:
            seen.add(at)
            at, depth = parents[t, at], depth + 1
        p = parents[t, m]
        wanted[t, m] = (None, None, "cycle") if at in seen else (at, depth, "root" if p is None else "orphan" if (t, p) not in parents else "reply")
    df = spark.createDataFrame(data, "t int, m int, p int")
    assert {(r["t"], r["m"]): (r["root"], r["depth"], r["how"]) for r in threads.threads(df, "t", "m", "p").collect()} == wanted
    chain = spark.range(100_000).select(F.lit(1).alias("t"), F.col("id").alias("m"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    far = threads.threads(chain, "t", "m", "p").agg(F.max("depth"), F.max("root"), F.count(F.lit(1))).first()
    assert tuple(far) == (99_999, 0, 100_000)
    assert threads.threads(df.limit(0), "t", "m", "p").count() == 0


def test_nested_json(spark):
    texts = ['{"asset_key": "k1"}', '{"a": [{"asset_key": "k2"}, {"b": {"asset_key": ["k3", "k2", 7, {"c": "no"}], "x": {"asset_key": "k4"}}}]}', '{"asset_key": "\\u00e9\\"\\\\/"}', "{", None, "[]", '"asset_key"', '{"z": {"thumbnail_key": "t"}, "asset_key": ""}', "[" * 5000 + "]" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    found = sorted((r["id"], r["place"], r["value"]) for r in nested_ops.key_strings(df, "id", "j", ["asset_key", "thumbnail_key"]).collect())
    assert found == [(0, 0, "k1"), (1, 0, "k2"), (1, 1, "k3"), (1, 2, "k4"), (2, 0, 'é"\\/'), (7, 0, "t")]
    pairs = [('{"a": {"b": 1, "n": null}, "c": [1]}', '{"a": {"b": 2, "d": {"e": 3}, "n": 4}, "c": [1, 2], "f": "é"}'), (None, '{"a": 1}'), ('{"a": 1}', None), (None, None), ("[1]", '{"a": 1}'), ("{bad", '{"a": 1.50}'), ('{"a": 1}', '{"a": {"b": 1}}')]
    merged = spark.createDataFrame(pairs, "t string, s string").select(nested_ops.filled_json(F.col("t"), F.col("s")).alias("m"))
    assert [json.loads(r["m"]) if r["m"] else None for r in merged.collect()] == [{"a": {"b": 1, "n": None, "d": {"e": 3}}, "c": [1], "f": "é"}, {"a": 1}, {"a": 1}, None, [1], {"a": 1.5}, {"a": 1}]


def _longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_revisions_are_aligned(spark):
    rng = random.Random(6)
    old, new = {}, {}
    for d in range(30):
        ids = [f"b{k}" for k in range(rng.randint(0, 40))]
        old[d] = list(ids)
        for _ in range(rng.randint(0, 5)):
            if ids:
                at, n = rng.randrange(len(ids)), rng.randint(1, 6)
                moved = ids[at : at + n]
                del ids[at : at + n]
                to = rng.randint(0, len(ids))
                ids[to:to] = moved
        new[d] = [x for x in ids if rng.random() > 0.1] + ([f"new{d}"] if d % 3 else [])
    del new[7], old[8]
    table = lambda side, tag: spark.createDataFrame([(d, b, k, f"{b}{tag if hash((d, k)) % 5 == 0 else ''}") for d, bs in side.items() for k, b in enumerate(bs)], "doc int, block string, position int, text string").withColumn("change", F.lit("x"))
    a, b = table(old, "!"), table(new, "?")
    changes = revisions.aligned_diff(a, b, "doc", "block", "text").collect()
    texts = [{(r["doc"], r["block"]): r["text"] for r in t.collect()} for t in (a, b)]
    for d in range(30):
        own, x, y = [r for r in changes if r["doc"] == d], old.get(d, []), new.get(d, [])
        kept = sorted(((r["old_position"], r["new_position"]) for r in own if r["change"] in ("changed", "unchanged")))
        assert len(kept) == _longest_common(x, y) and all(p[1] < q[1] for p, q in zip(kept, kept[1:])), d
        assert sorted([p for p, _ in kept] + [r["old_position"] for r in own if r["change"] == "removed"]) == list(range(len(x)))
        assert sorted([q for _, q in kept] + [r["new_position"] for r in own if r["change"] == "added"]) == list(range(len(y)))
        for r in own:
            if r["change"] in ("changed", "unchanged"):
                assert x[r["old_position"]] == y[r["new_position"]] == r["block"]
                assert (r["change"] == "unchanged") == (texts[0][d, r["block"]] == texts[1][d, r["block"]])
    odd = spark.createDataFrame([(1, None, 0, "a"), (1, "d", 1, "x"), (1, "d", 2, "x"), (None, "n", 0, "y")], "doc int, block string, position int, text string")
    assert sorted((r["doc"], r["block"], r["change"]) for r in revisions.aligned_diff(odd, odd.where("block IS NOT NULL"), "doc", "block", "text").where("doc IS NOT NULL").collect() if r["block"]) == [(1, "d", "added")] * 2 + [(1, "d", "removed")] * 2
    assert [r["change"] for r in revisions.aligned_diff(odd, odd, "doc", "block", "text").where("doc IS NULL").collect()] == ["unchanged"]
    assert revisions.aligned_diff(odd.limit(0), odd.limit(0), "doc", "block", "text").count() == 0


def test_stretches_are_solved_in_batches(spark):
    rng = random.Random(6)
    orders = {d: rng.sample(range(n), n) for d, n in enumerate((1, 2, 3, 7, 8, 20, 41))}
    old = spark.createDataFrame([(d, f"b{k}", k) for d, o in orders.items() for k in range(len(o))], "doc int, block string, position int")
    new = spark.createDataFrame([(d, f"b{k}", at) for d, o in orders.items() for at, k in enumerate(o)], "doc int, block string, position int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = revisions.aligned(old, new, "doc", "block")
        rows_ = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for d, o in orders.items():
        kept = sorted((r["old_position"], r["new_position"]) for r in rows_ if r["doc"] == d)
        longest = []
        for k in o:
            longest.append(1 + max((n for j, n in zip(o, longest) if j < k), default=0))
        assert len(kept) == max(longest) and [y for _, y in kept] == sorted(y for _, y in kept)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_long_revisions_are_aligned_fast(spark):
    old = spark.range(100_000).select(F.lit(1).alias("doc"), F.col("id").alias("block"), F.col("id").alias("position"), F.lit("t").alias("text"))
    new = old.withColumn("position", (F.col("position") + 50_000) % 100_000)
    counts = {r["change"]: r["count"] for r in revisions.aligned_diff(old, new, "doc", "block", "text").groupBy("change").count().collect()}
    assert counts == {"unchanged": 50_000, "removed": 50_000, "added": 50_000}


def test_symbol_chunks_cover_every_line_once(spark):
    py = "import os\n\nX = 1\n@deco\n@other\nclass A(B):\n    def m(self):\n        return {\n}\n\n# note\ndef f(a,\n      b):\n    pass\nasync def g():\n    pass\nprint(1)\nprint(2)"
    js = 'import x from "{";\nexport default class C {\n  m() { return "}"; }\n}\nfunction f()\n{\n  // {\n}\nlet y = 1;\nfn big() {\n' + "  a;\n" * 25 + "}"
    files = spark.createDataFrame([("a.py", py), ("b.JS", js), ("c.txt", "1\n2\n3"), ("d.py", ""), ("e.py", None), ("f.py", "    x\n  y")], "path string, text string")
    found = papers.symbol_chunks(files, 20).orderBy("path", "first_line").collect()
    of = lambda path: [(r["first_line"], r["last_line"], r["symbol"]) for r in found if r["path"] == path]
    assert of("a.py") == [(1, 3, None), (4, 11, "A"), (12, 14, "f"), (15, 16, "g"), (17, 18, None)]
    assert of("b.JS") == [(1, 1, None), (2, 4, "C"), (5, 8, "f"), (9, 9, None), (10, 29, "big"), (30, 36, "big")]
    assert of("c.txt") == [(1, 3, None)] and of("d.py") == [(1, 1, None)] and of("e.py") == [] and of("f.py") == [(1, 2, None)]
    for path, text in (("a.py", py), ("b.JS", js)):
        assert "\n".join(r["text"] for r in found if r["path"] == path) == text
    assert papers.symbol_chunks(files.limit(0)).count() == 0
