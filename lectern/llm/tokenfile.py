"""Token-id files with a minimal perfect hash index (operator 5).

Documents are range-partitioned by id, so that shard after shard holds them in ascending order. Each task encodes its
share with the tokenizers library and writes one shard: the raw ids of all documents, each with its end id, and beside it
an index. The index is a minimal perfect hash over the shard's document keys: levels of bit arrays in which a key that
meets no other one settles, ranks of the bits as slots, and for each slot a fingerprint of its key, the offset and the
number of ids. A manifest with each shard's first key and ids finds the shard; the hash finds the place in constant time.

A task writes under names of its own; the manifest, of which Spark commits one attempt's row for each shard, tells which
count, so that a lost or repeated task does no harm.
"""

from __future__ import annotations

import array
import json
import re
import string
import sys
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import _byte_letters, vocabulary
from .common import map_batches, mix, new_folder, sliced

END_ID = 0
#: Entries of a worker's memo of encoded chunks; once it is full, further chunks are remembered for their batch only.
MEMO = 1_000_000
#: Bytes of text of a shard, about.
SHARD_BYTES = 64 << 20
#: Bits of a level for each key that is still unsettled.
GAMMA = 2

_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Memo(dict):
    """Ids of chunks that were met early, mostly the frequent ones; `extra` has those of the present batch."""

    def __init__(self):
        self.extra: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        return self.extra[chunk]


class LibraryEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk of a batch once.

    A text is cut at every single space between two other characters, which stays with the chunk it leads. The pattern of
    the byte-level pre-tokenizer always starts a word there, so the chunks' ids joined are the text's ids. A chunk of
    letters is one word of that pattern, so the library's model alone encodes it, and so it is with one mark after letters.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.lengths = vocabulary(path).lengths
        self.kind = np.dtype("<u2" if len(self.lengths) <= 1 << 16 else "<u4")
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.marks = {m: self._pack(self.library.encode(m, add_special_tokens=False).ids) for m in string.punctuation}
        self.memo = _Memo()

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes() if sys.byteorder == "big" else array.array(self.kind.char, ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a blank and a run of letters."""
        found = self.memo.get(word)
        if found is None:
            form = self.letters[0x20] + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
            found = self._pack([t.id for t in self.model.tokenize(form)])
        return found

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks with the space that leads them. What has several words goes through the whole library, in runs whose ids part where the bytes do."""
        target = self.memo if len(self.memo) < MEMO else self.memo.extra
        odd, rest = self.memo.extra, []
        for c in chunks:
            if c.isalpha():
                target[c] = self._word(c)
            elif c[-1:] in self.marks and c[:-1].isalpha():
                target[c] = self._word(c[:-1]) + self.marks[c[-1]]
            else:
                rest.append(c)
        runs = [rest[at : at + 100] for at in range(0, len(rest), 100)]
        for run, found in zip(runs, self.library.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.int64)
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([1 + len(c.encode()) for c in run]), side="right")
            raw, last = ids.astype(self.kind).tobytes(), 0
            for chunk, end in zip(run, cuts.tolist(), strict=True):
                (odd if chunk[-1].isspace() else target)[chunk] = raw[last * self.kind.itemsize : end * self.kind.itemsize]
                last = end

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        memo.extra.clear()
        parts = [t.split(" ") if t else [""] for t in texts]
        new = {c for p in parts for c in p[1:] if c not in memo}
        # a space beside other white space is no cut; such pieces are never remembered, so they are among the new ones
        wrong = {c for c in new if not c or c[0].isspace() or c[-1].isspace()}
        uneven = [i for i, p in enumerate(parts) if (len(p) > 1 and (not p[0] or p[0][-1].isspace())) or (wrong and not wrong.isdisjoint(p))]
        new -= wrong
        for i in uneven:
            parts[i] = _CUT.split(texts[i])
            new.update(c for c in parts[i][1:] if c not in memo)
        self._learn(list(new))
        heads = self.library.encode_batch_fast([p[0] for p in parts], add_special_tokens=False)
        return [self._pack(h.ids) + b"".join([memo[c] for c in p[1:]]) for h, p in zip(heads, parts, strict=True)]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> LibraryEncoder:
    """One encoder for a worker's life, so that its memo serves task after task."""
    return LibraryEncoder(path)


def keys_of(ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64-bit keys of (document id, number of the copy among rows that repeat the id)."""
    return mix(mix(ids.view(np.uint64)) + copies.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """levels: bit arrays as bytes (0 or 1); slots count their ones from the first level on."""

    levels: list[np.ndarray]

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """keys must be distinct."""
        levels = []
        while len(keys):
            size = max(1, GAMMA * len(keys))
            place = _level(keys, len(levels), size)
            count = np.bincount(place, minlength=size)
            levels.append((count == 1).astype(np.uint8))
            keys = keys[count[place] > 1]
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot of its own for each key of the build; for other keys any slot or -1."""
        out, rest, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for k, bits in enumerate(self.levels):
            if not len(rest):
                break
            rank = np.cumsum(bits, dtype=np.int64)
            place = _level(keys[rest], k, len(bits))
            hit = bits[place] == 1
            out[rest[hit]] = base + rank[place[hit]] - 1
            rest = rest[~hit]
            base += int(rank[-1])
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def pack(parts: dict[str, np.ndarray]) -> bytes:
    """A line of JSON with names, types and sizes, then the arrays."""
    head = json.dumps({n: [a.dtype.str, len(a)] for n, a in parts.items()}).encode() + b"\n"
    return head + b"".join(a.tobytes() for a in parts.values())


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    at = raw.index(b"\n") + 1
    out = {}
    for name, (kind, size) in json.loads(raw[:at]).items():
        out[name] = np.frombuffer(raw, np.dtype(kind), size, at)
        at += out[name].nbytes
    return out


class ShardIndex:
    """Where each document of a shard lies."""

    def __init__(self, raw: bytes):
        self.parts = unpack(raw)
        self.hash = PerfectHash([np.unpackbits(self.parts[f"level{k}"], count=int(n)) for k, n in enumerate(self.parts["sizes"])])

    @staticmethod
    def pack(ids: np.ndarray, known: np.ndarray, copies: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> bytes:
        keys = keys_of(ids, copies)
        found = PerfectHash.build(keys)
        order = np.argsort(found.slots(keys))
        parts = {"sizes": np.array([len(b) for b in found.levels], np.int64)}
        parts |= {f"level{k}": np.packbits(b) for k, b in enumerate(found.levels)}
        parts |= {"print": fingerprints(keys)[order], "offset": offsets[order], "count": counts[order]}
        return pack(parts | {"ids": ids, "known": known, "copies": copies})

    def find(self, ids: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, count) of each document, -1 where the fingerprint says that the shard doesn't hold it."""
        keys = keys_of(ids, copies)
        slot = self.hash.slots(keys)
        held = (slot >= 0) & (self.parts["print"][slot] == fingerprints(keys)) if len(self.parts["print"]) else np.zeros(len(keys), bool)
        take = lambda name: np.where(held, self.parts[name][slot], -1) if len(self.parts[name]) else np.full(len(keys), -1)
        return take("offset"), take("count")


def _writer(path: str, folder: str):
    def run(batches):
        encoder = encoder_of(path)
        task = TaskContext.get()
        fs, where = pafs.FileSystem.from_uri(folder)
        fs.create_dir(where, recursive=True)
        shard = task.partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        own = f"{where}/{name}"
        end = np.array([END_ID], encoder.kind).tobytes()
        ids, known, counts = array.array("q"), array.array("b"), array.array("q")
        with fs.open_output_stream(f"{own}.{encoder.kind.str[1:]}") as out:
            for batch in sliced(batches, "text"):
                for raw in encoder.encode([t or "" for t in batch.column("text").to_pylist()]):
                    out.write(raw + end)
                    counts.append(len(raw) // encoder.kind.itemsize + 1)
                ids.extend(batch.column("doc_id").fill_null(0).to_pylist())
                known.extend(batch.column("doc_id").is_valid().to_pylist())
        ids, known, counts = np.array(ids, np.int64), np.array(known, np.uint8), np.array(counts, np.int64)
        # equal ids follow each other; a row without an id is a copy of a key of its own
        same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (known[1:] == known[:-1])]) if len(ids) else np.zeros(0, bool)
        place = np.arange(len(ids))
        copies = place - np.maximum.accumulate(np.where(same, 0, place)) if len(ids) else place
        copies = np.where(known == 1, copies, -1 - copies)
        with fs.open_output_stream(f"{own}.mph") as out:
            out.write(ShardIndex.pack(ids, known, copies, np.cumsum(counts) - counts, counts))
        real = ids[known == 1]
        first, last = (int(real[0]), int(real[-1])) if len(real) else (None, None)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "docs": len(ids), "ids": int(counts.sum()), "first": first, "last": last, "kind": encoder.kind.str[1:]}], _MANIFEST)

    return run


_MANIFEST = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("kind", pa.string())])


def write_tokens(docs: DataFrame, path: str, folder: str, shards: int | None = None) -> DataFrame:
    """Writes ids of every whole text (null as empty) in ascending doc_id order and returns the manifest, a row for each shard.

    The manifest lies beside the shards; it is as long as there are shards.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), "text")
    size = own.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    count = shards or max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    # an id that very many rows repeat may go over several shards; rows of one id lie in the order of their texts, whatever the attempt
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = own.repartitionByRange(count, *order[:2]).sortWithinPartitions(*order)
    map_batches(dealt, _writer(path, folder), "shard int, name string, docs long, ids long, first long, last long, kind string").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _reader(folder: str):
    def run(batches):
        fs, where = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{where}/{row['name']}"
                with fs.open_input_file(f"{name}.mph") as f:
                    index = ShardIndex(f.read())
                ids, known, copies = (index.parts[n] for n in ("ids", "known", "copies"))
                offset, count = index.find(ids, copies)
                crc, kind = np.empty(len(ids), np.int64), np.dtype(f"<{row['kind']}")
                with fs.open_input_file(f"{name}.{row['kind']}") as f:
                    for k, (at, n) in enumerate(zip(offset.tolist(), count.tolist(), strict=True)):
                        f.seek(at * kind.itemsize)
                        crc[k] = zlib.crc32(np.frombuffer(f.read(n * kind.itemsize), kind).astype("<u4").tobytes())
                doc = pa.array(ids, mask=known == 0)
                yield pa.RecordBatch.from_arrays([doc, pa.array(offset + row["start"]), pa.array(count), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, each found by its key in its shard's index and read from the shard."""
    shards = sorted(spark.read.parquet(f"{folder}/manifest").collect(), key=lambda r: r.shard)  # a row for each shard
    start, rows = 0, []
    for r in shards:
        rows.append((r.shard, r.name, start, r.kind))
        start += r.ids
    listed = spark.createDataFrame(rows, "shard int, name string, start long, kind string").repartition(max(1, len(rows)), "shard")
    return listed.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, doc_id: int, copy: int = 0) -> list[int] | None:
    """The ids of one document: the manifest's ranges tell its shard, the perfect hash its place; None where it isn't held.

    copy tells rows that repeat the id apart, in the order of the files, which may hold some of them each.
    """
    fs, where = pafs.FileSystem.from_uri(folder)
    found = spark.read.parquet(f"{folder}/manifest").filter((F.col("first") <= doc_id) & (F.col("last") >= doc_id)).collect()
    for r in sorted(found, key=lambda r: r.shard):
        with fs.open_input_file(f"{where}/{r.name}.mph") as f:
            index = ShardIndex(f.read())
        offset, count = index.find(np.array([doc_id], np.int64), np.array([copy]))
        if count[0] < 0:
            copy -= int(((index.parts["ids"] == doc_id) & (index.parts["known"] == 1)).sum())
            continue
        if count[0] >= 0:
            kind = np.dtype(f"<{r.kind}")
            with fs.open_input_file(f"{where}/{r.name}.{r.kind}") as f:
                f.seek(int(offset[0]) * kind.itemsize)
                return np.frombuffer(f.read(int(count[0]) * kind.itemsize), kind).tolist()
    return None


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Writes the token files of all documents to the shared folder and returns what read_tokens() finds there.

    A null or empty text has the end id only; rows without an id come first; rows that repeat an id are told apart by their
    number; texts of any length are encoded whole; an empty table gives empty files and no rows. Other columns are ignored.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, folder)
    return read_tokens(docs.sparkSession, folder)
