"""Licence scan with a positional rare-token index.

Every licence template is a list of words. The index holds postings (template, place in it) of each template's words of the
highest inverse document frequency over all scanned files. A file's words that are in the index are looked up; a word at place
p of the file and place q of a template proposes that the template starts at p - q. The proposals of different words are
intersected by this relative position: words of a phrase must propose the same start, words of a long template starts within
2 x DRIFT of each other. What is left is verified. A phrase must stand word for word. Of a long template a share COVER of the
words must each stand within DRIFT words of its place, and so must each of its mandatory key phrases, whole. Of neighbouring
starts of a template the one that covers most is reported.

The intersection loses nothing that verification would pass: at most a share 1 - COVER of a long template's words may be away,
and so many more than that are in the index that AGREE of them propose a start near each other.

Cases: a null or empty text has no words and no labels (counts 0, places null, score 0). Words of any length count.
A null id stays null. Repeated rows give repeated results. Columns besides the two named are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.rows import map_rows
from quirelab.llm.words import words_of

@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases of the template that a file must hold near their places; none: the whole template must stand word for word.
    keys: tuple[str, ...] = ()
    base: bool = False


BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)

TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2.0"),
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-nc-sa", "cc by nc sa"),
    Template("cc-by-nc-nd", "cc by nc nd"),
    Template("cc0-1.0", "creative commons zero"),
    Template("cc", "creative commons attribution"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2.0", "mozilla public license"),
    Template("isc", "isc license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unencumbered software", "public domain")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted", "without restriction")),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("substantial portions of the software", "without warranty of any kind")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee", "appear in all copies")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistribution and use in source and binary forms", "must retain the above copyright notice", "must reproduce the above copyright notice")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms", "following conditions")),
    Template("apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license", "in compliance with the license")),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("applicable law", "without warranties or conditions")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("free software foundation", "general public license", "any later version")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("in no event will the authors be held liable", "redistribute it freely")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at", ("source code form", "mozilla public license")),
    Template("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("to the extent possible under law", "related or neighboring rights")),
)

#: Of a long template: the share of words that must be there, the words by which each may be away from its place, and the words
#: that must propose a start together. Of a phrase: the words that are looked up.
COVER, DRIFT, AGREE, PHRASE = 0.75, 8, 3, 2


class Index:
    """Postings of the templates' rarest words; idf: of the words of all templates."""

    def __init__(self, templates: Sequence[Template], idf: dict[bytes, float]):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        #: The key phrases and their places in the template.
        self.keys = [[(_first(words, k), k) for k in map(words_of, t.keys)] for t, words in zip(templates, self.words)]
        self.idf = idf
        self.looked_up: list[int] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            by_rarity = sorted(range(len(words)), key=lambda q: (-idf.get(words[q], math.inf), q))
            may_lack = len(words) - math.ceil(COVER * len(words)) if self.keys[t] else 0
            chosen = by_rarity[: may_lack + AGREE if self.keys[t] else PHRASE]
            self.looked_up.append(len(chosen))
            for q in chosen:
                self.postings[words[q]].append((t, q))
        self.postings = dict(self.postings)

    def proposals(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """Template -> (start, place of the word that proposes it)."""
        postings = self.postings
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in postings:
                for t, q in postings[w]:
                    out[t].append((p - q, q))
        return out

    def intersected(self, t: int, proposed: list[tuple[int, int]]) -> list[int]:
        """Starts, ascending, that enough different words propose."""
        n = self.looked_up[t]
        if not self.keys[t]:
            places: dict[int, set[int]] = defaultdict(set)
            for s, q in proposed:
                places[s].add(q)
            return sorted(s for s, qs in places.items() if s >= 0 and len(qs) == n)
        need = min(AGREE, n)
        proposed = sorted(proposed)
        starts: set[int] = set()
        inside: Counter = Counter()
        low = different = 0
        for s, q in proposed:
            different += inside[q] == 0
            inside[q] += 1
            # The shortest stretch of proposals up to here with enough different words.
            while inside[last := proposed[low][1]] > 1 or different > need:
                inside[last] -= 1
                different -= inside[last] == 0
                low += 1
            if different == need and proposed[low][0] >= s - 2 * DRIFT:
                starts.update(range(s - DRIFT, proposed[low][0] + DRIFT + 1))
        return sorted(s for s in starts if s > -DRIFT)

    def cover(self, t: int, words: list[bytes], s: int) -> tuple[float, int]:
        """Share of a long template's words that stand near their places if it starts at s, 0 if a key phrase does not; and how
        many stand right there."""
        for at, key in self.keys[t]:
            low = max(0, s + at - DRIFT)
            if not any(words[p : p + len(key)] == key for p in range(low, max(low, s + at + DRIFT + 1))):
                return 0.0, 0
        template = self.words[t]
        hits = sum(w in words[max(0, s + q - DRIFT) : max(0, s + q + DRIFT + 1)] for q, w in enumerate(template))
        return hits / len(template), sum(0 <= s + q < len(words) and words[s + q] == w for q, w in enumerate(template))

    def scan(self, words: list[bytes]) -> tuple[dict[int, list[int]], float]:
        """Template -> its starts, ascending, and the best share of a template's words that was found."""
        found, best = {}, 0.0
        for t, proposed in self.proposals(words).items():
            starts = self.intersected(t, proposed)
            if not self.keys[t]:
                template = self.words[t]
                ok = [s for s in starts if words[s : s + len(template)] == template]
                best = max(best, 1.0 if ok else 0.0)
            else:
                covers = {s: c for s in starts if (c := self.cover(t, words, s))[0] >= COVER}
                ok = _tops(covers, len(self.words[t]))
                best = max([best, *(c for c, _ in covers.values())])
            if ok:
                found[t] = ok
        return found, best


def _first(words: list[bytes], phrase: list[bytes]) -> int:
    return next(p for p in range(len(words)) if words[p : p + len(phrase)] == phrase)


def _tops(covers: dict[int, tuple[float, int]], size: int) -> list[int]:
    """Of starts less than a template's size apart the one that covers most, of equal ones with most words right in place, then the first."""
    taken: list[int] = []
    for s in sorted(covers, key=lambda s: (-covers[s][0], -covers[s][1], s)):
        if all(abs(s - x) >= size for x in taken):
            taken.append(s)
    return [max(0, s) for s in sorted(taken)]


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many files each word of the templates stands; one row for each such word comes to the driver."""

    def make():
        seen: Counter = Counter()

        def call(texts):
            for t in texts:
                seen.update(vocabulary.intersection(words_of(t)))
            seen[b""] += len(texts)

        call.finish = lambda: [([w.decode() for w in seen], list(seen.values()))]
        return call

    counted = map_rows(docs, [text_col], T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]), make)
    return {r["word"].encode(): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = BASE + TEMPLATES) -> DataFrame:
    """One row for each file: id, n_words, matches (label, base, start, words), labels, score."""
    vocabulary = frozenset(w for t in templates for w in words_of(t.text))
    seen = document_frequencies(docs, text_col, vocabulary)
    n = seen.get(b"", 0)
    idf = {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1 for w in vocabulary}
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType())]))),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def make():
        index = Index(templates, idf)

        def call(ids, texts):
            counts, matches, scores = [], [], []
            for text in texts:
                words = words_of(text)
                found, best = index.scan(words)
                counts.append(len(words))
                matches.append([{"label": templates[t].label, "base": templates[t].base, "start": s, "n_words": len(index.words[t])} for t, starts in sorted(found.items()) for s in starts])
                scores.append(best)
            return ids, counts, matches, scores

        return call

    return map_rows(docs, [id_col, text_col], schema, make)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        "score",
    )
