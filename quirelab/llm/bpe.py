"""BPE encoding and decoding by speculation and verification.

A text is cut into words as the vocabulary's pre-tokenizer does. Greedy longest match proposes each new word's tokens; a
vectorised check asks of every adjacent pair whether merging in rank order could have produced it, that is whether no
merge across the border would have come before the merges that made the two tokens. If all pairs of a word hold, its
proposal is the encoding; only the other words are merged exactly.

Cases: a null or empty text has no ids and decodes to the empty text. Texts and words of any length are encoded whole (long
words with a heap, in n log n). A special token's string in a text is that token, as in the tokenizers library. In decoding,
null ids and ids outside the vocabulary are skipped; bytes that are not UTF-8 become U+FFFD. A null id column stays null,
repeated rows give repeated results, and columns besides those named are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.rows import map_rows

#: Words whose tokens a worker keeps; beyond it new words are encoded without being kept.
KEPT = 400_000
#: Of words so long that merging by scanning for the lowest rank would be quadratic.
LONG = 48

_NEVER = 1 << 62

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts with these go to the library's pre-tokenizer: white space that libraries define differently, and letters that Unicode versions may.
_RARE = re.compile("[\x00\x1c-\x1fɐ-\U0010ffff]")
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x85\xa0]")


def byte_characters() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        to_byte = byte_characters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.of_bytes = {b: i for i, b in enumerate(self.bytes) if b and i not in self.specials.values()}
        self.longest = max(map(len, self.of_bytes))
        self.single = [self.of_bytes[bytes([b])] for b in range(256)]
        # rank[t]: of the merge that makes t, -1 for single bytes; left, right: what it merges.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = vocab[a], vocab[b], vocab[a + b]
            self.merge[a, b] = (r, t)
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, a, b
        keys = np.array([a << 20 | b for a, b in self.merge], np.int64)
        order = keys.argsort()
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.packed = {a << 20 | b: r << 20 | t for (a, b), (r, t) in self.merge.items()}
        self.tokens = list(range(size))
        #: 1 where merging a token's own bytes gives the token, 0 where not, -1 where nobody has asked.
        self.whole = np.full(size, -1, np.int8)
        self.words: dict[str | bytes, tuple[int, ...]] = {}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b together would end with exactly these two tokens.

        The two sides are taken apart merge by merge, latest first. At each point the symbols that face each other at the
        border must not have a merge of an earlier rank than the merges still standing next to the border.
        """
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        # The rank of the earliest merge undone so far at the border: a merge across it loses to it unless it is earlier.
        # An equal rank cannot face itself here unless both sides repeat, when the left place wins.
        limit = np.full(len(a), np.iinfo(np.int64).max)
        from_right = np.zeros(len(a), bool)
        while len(live):
            x, y = a[live], b[live]
            across = self.pair_rank(x, y)
            # Undone on the right: the border stands left of it, so it wins at equal rank. Undone on the left: it loses.
            early = np.where(from_right[live], across <= limit[live], across < limit[live])
            early &= across != np.iinfo(np.int64).max
            out[live[early]] = False
            live = live[~early]
            x, y = a[live], b[live]
            rx, ry = self.rank[x], self.rank[y]
            more = (rx >= 0) | (ry >= 0)
            live, rx, ry = live[more], rx[more], ry[more]
            # The later merge is undone first; of equal ranks the right one, for the left place merges first.
            right = ry >= rx
            i, j = live[~right], live[right]
            limit[i], from_right[i] = self.rank[a[i]], False
            a[i] = self.right[a[i]]
            limit[j], from_right[j] = self.rank[b[j]], True
            b[j] = self.left[b[j]]
        return out

    def exact(self, word: bytes) -> tuple[int, ...]:
        """Merges in rank order, leftmost first."""
        ids = [self.single[b] for b in word]
        if len(ids) > LONG:
            return self._exact_long(ids)
        # next_to[k]: rank and token of the merge of ids[k] with ids[k + 1], in one number.
        packed = self.packed
        next_to = [packed.get(a << 20 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while next_to and (least := min(next_to)) != _NEVER:
            k = next_to.index(least)
            ids[k] = t = self.tokens[least & 0xFFFFF]
            del ids[k + 1], next_to[k]
            if k:
                next_to[k - 1] = packed.get(ids[k - 1] << 20 | t, _NEVER)
            if k < len(next_to):
                next_to[k] = packed.get(t << 20 | ids[k + 1], _NEVER)
        return tuple(ids)

    def _exact_long(self, ids: list[int]) -> tuple[int, ...]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := self.merge.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        gone = -1
        while heap:
            _, k, a, b, t = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = t, gone
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (m := self.merge.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right], m[1]))
        return tuple(i for i in ids if i != gone)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, of, longest = [], 0, len(word), self.of_bytes, self.longest
        whole = of.get(word)
        if whole is not None:
            return [whole]
        while at < n:
            end = min(n, at + longest)
            while word[at:end] not in of:
                end -= 1
            out.append(of[word[at:end]])
            at = end
        return out

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Speculate, verify, and merge exactly what failed."""
        proposed = list(map(self.propose, words))
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        for t in np.unique(flat[self.whole[flat] < 0]).tolist():
            self.whole[t] = self.exact(self.bytes[t]) == (t,)
        failed = np.zeros(len(words), bool)
        failed[word[self.whole[flat] == 0]] = True
        inner = word[1:] == word[:-1]
        pairs, which = np.unique((flat[:-1] << 20 | flat[1:])[inner], return_inverse=True)
        failed[word[1:][inner][~self.compatible(pairs >> 20, pairs & 0xFFFFF)[which]]] = True
        return [self.exact(w) if bad else tuple(ids) for w, ids, bad in zip(words, proposed, failed.tolist())]

    def _keys(self, text: str) -> list[str | bytes]:
        """What the word table is asked for: a word after a space by itself, "\\n" + a word after a line feed, "\\0" + a
        word that stands first (texts with U+0000 take no such key), and as bytes, which equal no string, a piece of a text
        that needs the pattern as a whole."""
        if _RARE.search(text):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
            return [text[a:b].encode("utf-8", "replace") for _, (a, b) in pieces]
        if _OTHER_SPACE.search(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return [p.encode() for p in _PIECES.findall(text)]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\0" + keys[0]
        return keys

    @staticmethod
    def _pieces(key: str | bytes) -> list[bytes]:
        if isinstance(key, bytes):
            return [key]
        first = key[0]
        if first > "\n":
            if key.isalpha():
                return [b" " + key.encode()]
            if key[-1] in ".," and key[:-1].isalpha():
                return [b" " + key[:-1].encode(), key[-1:].encode()]
            return [p.encode() for p in _PIECES.findall(" " + key)]
        found = [p.encode() for p in _PIECES.findall(key[1:] if first in "\0\n" else " " + key)]
        return [b"\n", *found] if first == "\n" else found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known, asked, missing = self.words, [], {}
        for text in texts:
            parts = []
            for part in self.split.split(text) if text and self.split and "<|" in text else [text] if text else []:
                if part in self.specials:
                    parts.append(part)
                elif part:
                    keys = self._keys(part)
                    parts.append(keys)
                    for k in keys:
                        if k not in known:
                            missing[k] = None
            asked.append(parts)
        if missing:
            pieces = {k: self._pieces(k) for k in missing}
            unique = list(dict.fromkeys(chain.from_iterable(pieces.values())))
            tokens = dict(zip(unique, self.encode_words(unique)))
            missing = {k: tuple(chain.from_iterable(tokens[p] for p in ps)) for k, ps in pieces.items()}
            if len(known) < KEPT:
                known.update((k, v) for k, v in missing.items() if len(k) < 64)
        look = lambda k: known[k] if k in known else missing[k]
        return [list(chain.from_iterable((self.specials[p],) if isinstance(p, str) else chain.from_iterable(map(look, p)) for p in parts)) for parts in asked]

    def decode(self, ids: list[int | None] | None) -> str:
        table, n = self.bytes, len(self.bytes)
        return b"".join(table[i] for i in ids or () if i is not None and 0 <= i < n).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    """Where the installed public vocabulary lies; asked for on each worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ids_array(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))))


def _fields(df: DataFrame, columns: tuple[str, ...]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in columns]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | Callable[[], str] = default_path, with_decoded: bool = False) -> DataFrame:
    """One row for each text: id, n_tokens, ids; with_decoded adds decoded, the text that these ids decode to."""
    extra = [T.StructField("decoded", T.StringType())] if with_decoded else []
    schema = T.StructType([*_fields(docs, (id_col,)), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), *extra])

    def make():
        v = vocabulary(path() if callable(path) else path)

        def call(keys, texts):
            ids = v.encode(texts)
            decoded = [[v.decode(x) for x in ids]] if with_decoded else []
            return keys, [len(x) for x in ids], _ids_array(ids), *decoded

        return call

    return map_rows(docs, [id_col, text_col], schema, make, rows=256)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | Callable[[], str] = default_path) -> DataFrame:
    """One row for each row: id, decoded."""
    schema = T.StructType([*_fields(encoded, (id_col,)), T.StructField("decoded", T.StringType())])

    def make():
        v = vocabulary(path() if callable(path) else path)
        return lambda keys, ids: (keys, [v.decode(x) for x in ids])

    return map_rows(encoded, [id_col, ids_col], schema, make, rows=256)


def digest(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(id_col, "n_tokens", F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
