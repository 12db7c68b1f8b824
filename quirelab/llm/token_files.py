"""Token ids in raw binary shards with keyed access through minimal perfect hashing.

A folder holds manifest.json and, for each shard of the ascending ids:

    NAME.ids    the documents' token ids one after another, little-endian unsigned, 16 or 32 bits as the manifest says
    NAME.keys   an Arrow IPC file with the documents' ids in the order of the payload
    NAME.idx    the index, little-endian: the sizes of LEVELS levels of bits (64 bits each, 0 beyond the last); for each 512 bits
                of all levels the number of bits set before them (64 bits) and the bits; for each slot fingerprint and count
                (32 bits each) and offset in the payload (64 bits)

Shards are ranges of the ids in ascending order (null first), so a shard's documents all stand before those of the next one; a
shard is closed at SHARD_DOCS documents or SHARD_BYTES of payload. A document's key is its id and the number of equal ids before
it in its shard. A look-up hashes the key, reads 72 bytes of the index for each level that it probes (LEVELS at most, two on
average), 16 bytes for the slot, compares the stored fingerprint and reads one stretch of the payload, whatever the number of
documents in the shard.

Cases: a null or empty text is the end id alone. Null ids are one key. Equal ids are all kept, in an order that depends on
their texts only, and a look-up returns all of them. An empty table makes a manifest without shards. Texts of any length are
encoded whole. Columns besides the two named are ignored, whatever their names.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema, to_arrow_type

from quirelab.llm.rows import slices
from quirelab.session import fresh_path, ship

#: Words whose ids a worker keeps.
KEPT = 1_000_000
#: Bits of a level for each key that it gets, levels, and keys from which a level is worth its bits.
SPREAD, LEVELS = 2, 40
#: Documents and payload bytes at which a shard is closed.
SHARD_DOCS, SHARD_BYTES = 1 << 20, 1 << 28
_BLOCK = np.dtype([("before", "<u8"), ("bits", "u1", 64)])
_SLOT = np.dtype([("fingerprint", "<u4"), ("count", "<u4"), ("offset", "<u8")])
#: Beyond these characters, or with these, a text goes to the library as a whole: normalisation or white space could differ.
_RARE = re.compile("[\x00\x1c-\x1fİɐ-\U0010ffff]")
_MARKS = ".,!?;:%&$*#|"
#: A full stop or comma next to another mark, with which it would be one piece.
_TIGHT = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s].)|(?<=_.))")


class _Words(dict):
    """Words and their numbers; a word that is not there gets the next number and is noted as fresh."""

    def __init__(self):
        super().__init__()
        self.ids: list[bytes] = []
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self.ids) + len(self.fresh)
        self.fresh.append(word)
        return k


class WordEncoder:
    """The library's encoding, asked once for each word: its pre-tokenizer never crosses white space, so words between
    spaces are independent, and letters are independent of the marks that follow them."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.words = _Words()

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words, whole, numbers = self.words, [], []
        for k, text in enumerate(texts):
            if text and ("<|" in text or _RARE.search(text)):
                whole.append(k)
                text = None
            if text:
                text = text.lower()
                if not _TIGHT.search(text):
                    # Stops and commas become words of their own.
                    text = text.replace(",", " ,").replace(".", " .")
            numbers.append(list(map(words.__getitem__, text.split())) if text else [])
        fresh, ids = words.fresh, words.ids
        known = len(ids)
        parts: dict[str, tuple[str, str]] = {}
        asked: dict[str, None] = {}
        for w in fresh:
            body = w.rstrip(_MARKS)
            if len(body) < len(w) and body.isalpha():
                parts[w] = body, w[len(body) :]
                asked.update((p, None) for p in parts[w] if words.get(p, known) >= known)
            else:
                asked[w] = None
        new = dict(zip(asked, self._ask(list(asked))))
        look = lambda p: new[p] if p in new else ids[words[p]]
        ids.extend([new[w] if w in new else look(parts[w][0]) + look(parts[w][1]) for w in fresh])
        out = [b"".join(map(ids.__getitem__, ns)) for ns in numbers]
        for k, found in zip(whole, self._ask([texts[k] for k in whole])):
            out[k] = found
        # What is kept are words that the library was asked for, while there is room.
        del ids[known:]
        for w in fresh:
            del words[w]
        words.fresh = []
        if known < KEPT:
            for w, found in new.items():
                if len(w) < 64:
                    words[w] = len(ids)
                    ids.append(found)
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_path() -> str:
    """Where the installed public vocabulary lies; asked for on each worker."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def key_hashes(keys: list[tuple[Any, int]]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each (id, number among equal ids)."""
    raw = b"".join(xxhash.xxh3_128_digest((b"\0" if i is None else b"\1" + str(i).encode("utf-8", "replace")) + b"\0%d" % k) for i, k in keys)
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 + h2 * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


class PerfectHash:
    """Levels of bits: a level holds the keys that no other key of the level meets, the next one gets the rest. A key's slot
    is the number of bits before its own over all levels, so n keys have the slots 0 to n - 1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        counts = np.unpackbits(bits, bitorder="little").reshape(-1, 512).sum(1) if len(bits) else np.zeros(0, np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        left = np.arange(len(h1))
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, SPREAD * len(left))
            at = (_mixed(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            sizes.append(size)
            levels.append(hits == 1)
            left = left[hits[at] != 1]
        if len(left):
            raise ValueError(f"{len(left)} keys without a slot: two of them have equal 128-bit hashes")
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        flat = np.concatenate([flat, np.zeros(-len(flat) % 512, bool)])
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little"))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not put in, any slot or -1."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.starts[level] + (_mixed(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            hit = (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
            here = at[hit]
            # Bits before it: whole blocks of 512, and what its own block has before it.
            block = np.unpackbits(self.bits.reshape(-1, 64)[here >> 9], axis=1, bitorder="little") if len(here) else np.zeros((0, 512), np.uint8)
            own = np.cumsum(block, axis=1, dtype=np.int64)
            out[left[hit]] = self.before[here >> 9] + own[np.arange(len(here)), here & 511] - 1
            left = left[~hit]
            if not len(left):
                break
        return out


def _indexed(perfect: PerfectHash, h2: np.ndarray, slot: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    """The index file of documents in payload order, whose keys have these slots."""
    sizes = np.zeros(LEVELS, "<u8")
    sizes[: len(perfect.sizes)] = perfect.sizes
    blocks = np.zeros(len(perfect.bits) // 64, _BLOCK)
    blocks["before"], blocks["bits"] = perfect.before[:-1], perfect.bits.reshape(-1, 64)
    slots = np.zeros(len(slot), _SLOT)
    slots["fingerprint"][slot], slots["count"][slot], slots["offset"][slot] = h2 >> np.uint64(32), counts, starts
    return sizes.tobytes() + blocks.tobytes() + slots.tobytes()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (pafs.LocalFileSystem(), uri)


def _put(folder: str, name: str, data: bytes) -> None:
    """Written under the attempt's own name first, so that a lost or repeated task leaves no half file under the final one."""
    fs, path = _open(folder)
    context = TaskContext.get()
    part = f"{path}/.{name}.{context.taskAttemptId() if context else 'driver'}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    _settle(fs, part, f"{path}/{name}")


def _settle(fs: pafs.FileSystem, part: str, final: str) -> None:
    """Give a written file its final name; where an earlier attempt of the same task has left one, it has the same content."""
    try:
        fs.move(part, final)
    except OSError:
        if fs.get_file_info(final).type != pafs.FileType.File:
            raise
        fs.delete_file(final)
        fs.move(part, final)


def _get(folder: str, name: str) -> bytes:
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def _numbered(ids: list[Any]) -> list[tuple[Any, int]]:
    seen: dict[Any, int] = {}
    out = []
    for i in ids:
        seen[i] = k = seen.get(i, -1) + 1
        out.append((i, k))
    return out


def _bound(i: Any) -> str:
    """An id as the manifest compares it: null first."""
    return json.dumps([i is not None, i if isinstance(i, int | float | str) else str(i)])


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | Callable[[], str] = default_path, end_id: int = 2, shard_docs: int = SHARD_DOCS) -> dict:
    """Encode, append end_id, write the shards, and the manifest, which is returned. To the driver comes a row for each shard."""
    spark = docs.sparkSession
    ship(spark)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    fs, where = _open(folder)
    fs.create_dir(where, recursive=True)
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("bits", T.IntegerType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path() if callable(path) else path)
        end = np.array([end_id], encoder.dtype).tobytes()
        row = lambda w: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(w.close(), arrow)], schema=arrow)
        number, writer = 0, None
        for batch in batches:
            for part in slices(batch, 256):
                writer = writer or _Writer(folder, f"shard-{TaskContext.get().partitionId():06d}-{number:04d}", encoder.dtype, id_type, shard_docs)
                writer.add(part.column(0).to_pylist(), [e + end for e in encoder.encode(part.column(1).to_pylist())])
                if writer.full:
                    yield row(writer)
                    number, writer = number + 1, None
        if writer:
            yield row(writer)

    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    # Equal ids are split by their texts' hash, so that one frequent id cannot fill a shard alone unless the texts are equal, too.
    sharded = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = sorted(tuple(r) for r in sharded.mapInArrow(run, schema).collect())
    manifest = {"bits": shards[0][3] if shards else 32, "end_id": end_id, "id_type": str(id_type), "shards": []}
    start = 0
    for name, n_docs, n_ids, _, first, last in shards:
        manifest["shards"].append({"name": name, "n_docs": n_docs, "n_ids": n_ids, "start": start, "first": json.loads(first), "last": json.loads(last)})
        start += n_ids
    _put(folder, "manifest.json", json.dumps(manifest).encode())
    return manifest


class Shard:
    """A shard that is open for look-ups, which read stretches of fixed size."""

    def __init__(self, folder: str, name: str, bits: int):
        self.folder, self.name, self.dtype = folder, name, np.dtype(f"<u{bits // 8}")
        self.fs, path = _open(folder)
        self.index, self.payload = self.fs.open_input_file(f"{path}/{name}.idx"), self.fs.open_input_file(f"{path}/{name}.ids")
        sizes = np.frombuffer(self._read(self.index, 0, 8 * LEVELS), "<u8").astype(np.int64)
        self.sizes = sizes[sizes > 0]
        self.blocks = -(-int(self.sizes.sum()) // 512)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    @staticmethod
    def _read(file, at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    def keys(self) -> list[Any]:
        return pa.ipc.open_file(pa.BufferReader(_get(self.folder, f"{self.name}.keys"))).read_all().column("id").to_pylist()

    def locate(self, key: tuple[Any, int]) -> tuple[int, int] | None:
        """Offset and count of a key, None where the shard has no such key."""
        h1, h2 = key_hashes([key])
        for level, size in enumerate(self.sizes.tolist()):
            at = int(self.starts[level]) + int(_mixed(h1, h2, level)[0] % np.uint64(size))
            block = np.frombuffer(self._read(self.index, 8 * LEVELS + (at >> 9) * _BLOCK.itemsize, _BLOCK.itemsize), _BLOCK)[0]
            bits = np.unpackbits(block["bits"], bitorder="little")
            if bits[at & 511]:
                slot = int(block["before"]) + int(bits[: at & 511].sum())
                found = np.frombuffer(self._read(self.index, 8 * LEVELS + self.blocks * _BLOCK.itemsize + slot * _SLOT.itemsize, _SLOT.itemsize), _SLOT)[0]
                return (int(found["offset"]), int(found["count"])) if found["fingerprint"] == h2[0] >> np.uint64(32) else None
        return None

    def locate_all(self, keys: list[tuple[Any, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and counts of keys that the shard has; the index is read once."""
        data = self._read(self.index, 8 * LEVELS, self.blocks * _BLOCK.itemsize + len(keys) * _SLOT.itemsize)
        bits = np.frombuffer(data, _BLOCK, self.blocks)["bits"].ravel()
        slots = np.frombuffer(data, _SLOT, len(keys), self.blocks * _BLOCK.itemsize)
        h1, h2 = key_hashes(keys)
        found = slots[PerfectHash(self.sizes, bits).slots(h1, h2)]
        if (found["fingerprint"] != h2 >> np.uint64(32)).any():
            raise ValueError(f"{self.name}: the index does not have all keys")
        return found["offset"].astype(np.int64), found["count"].astype(np.int64)

    def ids(self, offset: int, count: int) -> np.ndarray:
        size = self.dtype.itemsize
        return np.frombuffer(self._read(self.payload, offset * size, count * size), self.dtype).astype("<u4")


class _Writer:
    """A shard that is being written."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, id_type: pa.DataType, most: int):
        self.folder, self.name, self.dtype, self.id_type, self.most = folder, name, dtype, id_type, most
        self.fs, self.base = _open(folder)
        self.part = f"{self.base}/.{name}.ids.{TaskContext.get().taskAttemptId()}"
        self.out = self.fs.open_output_stream(self.part)
        self.docs: list[Any] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, docs: list[Any], encoded: list[bytes]) -> None:
        self.docs += docs
        self.counts += [len(e) // self.dtype.itemsize for e in encoded]
        self.bytes += sum(map(len, encoded))
        self.out.write(b"".join(encoded))

    @property
    def full(self) -> bool:
        return len(self.docs) >= self.most or self.bytes >= SHARD_BYTES

    def close(self) -> tuple:
        """Write keys and index; the shard's row of the manifest."""
        self.out.close()
        _settle(self.fs, self.part, f"{self.base}/{self.name}.ids")
        keys = pa.table({"id": pa.array(self.docs, self.id_type)})
        sink = io.BytesIO()
        with pa.ipc.new_file(sink, keys.schema) as w:
            w.write_table(keys)
        _put(self.folder, f"{self.name}.keys", sink.getvalue())
        h1, h2 = key_hashes(_numbered(self.docs))
        perfect = PerfectHash.build(h1, h2)
        counts = np.array(self.counts, np.int64)
        _put(self.folder, f"{self.name}.idx", _indexed(perfect, h2, perfect.slots(h1, h2), np.cumsum(counts) - counts, counts))
        return self.name, len(self.docs), int(counts.sum()), 8 * self.dtype.itemsize, _bound(self.docs[0]), _bound(self.docs[-1])


def lookup(folder: str, wanted: Any) -> list[np.ndarray]:
    """The ids of every document with this id, in shard order; only shards whose range holds the id are opened. Fingerprints
    have 32 bits: an absent id within a range is found by mistake once in four thousand million look-ups."""
    manifest = json.loads(_get(folder, "manifest.json"))
    out, key = [], json.loads(_bound(wanted))
    shards = manifest["shards"]
    for s in shards[bisect_left(shards, key, key=lambda s: s["last"]) :]:
        if s["first"] > key:
            break
        shard, k = Shard(folder, s["name"], manifest["bits"]), 0
        while at := shard.locate((wanted, k)):
            out.append(shard.ids(*at))
            k += 1
    return out


def read(spark: SparkSession, folder: str, manifest: dict | None = None, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32; with_ids
    adds ids. Every document is looked up through its shard's index."""
    ship(spark)
    manifest = manifest or json.loads(_get(folder, "manifest.json"))
    shards, bits = manifest["shards"], manifest["bits"]
    id_type = next((t for t in (pa.int64(), pa.int32(), pa.int16(), pa.int8(), pa.string(), pa.date32(), pa.float64()) if str(t) == manifest["id_type"]), pa.string())
    fields = [T.StructField(id_col, from_arrow_type(id_type)), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                shard = Shard(folder, shards[n]["name"], bits)
                keys = _numbered(shard.keys())
                offsets, counts = shard.locate_all(keys)
                for at in range(0, len(keys), 512):
                    part, offset, count = (x[at : at + 512] for x in (keys, offsets, counts))
                    ids = [shard.ids(o, c) for o, c in zip(offset.tolist(), count.tolist())]
                    crc = [zlib.crc32(x.tobytes()) for x in ids]
                    columns = [pa.array([k for k, _ in part], id_type), pa.array(offset + shards[n]["start"]), pa.array(count), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))] if with_ids else []), names=schema.names)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, schema)


def write_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder = fresh_path(docs.sparkSession, "tokens")
    return read(docs.sparkSession, folder, write(docs, folder, id_col, text_col), id_col)
