"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon (operator 7).

Frequent words (pre-tokens) are compiled into a minimal acyclic automaton: equal suffixes share states, every arc carries
the number of words that precede it, so the sum along a word's path is its number, and the number leads to its ids. The
arrays lie in one file in the shared folder that every Python worker maps into memory. All words of an Arrow batch walk
the automaton together, one byte at a time. Words that it doesn't hold are merged exactly by rank, again all together.
The lexicon only saves work: ids never depend on it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import cut, drop, map_batches, most_frequent, new_folder, sliced, span_hashes

#: Words of the lexicon: its size bound.
LEXICON_WORDS = 1 << 16
#: Words of more bytes are not put into the lexicon.
LEXICON_BYTES = 32
#: Longer unseen words are merged one by one with a heap instead of in rounds.
LONG_WORD = 128
#: A task's count table is sent on at this many words, so that it stays small.
COUNT_FLUSH = 400_000

SPACE, LETTER, NUMBER, OTHER = range(4)
_NONE = np.int64(1 << 40)


#: The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point, as the byte-level pattern tells them apart.

    Code points that are newer than Python's Unicode tables are put to the tokenizers library's own pattern.
    """
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    major = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    letters = np.frombuffer(major.encode(), np.uint8)
    table[letters == ord("L")] = LETTER
    table[letters == ord("N")] = NUMBER
    table[WHITE_SPACE] = SPACE
    pattern, newer = ByteLevel(add_prefix_space=False), regex.compile(r"[\p{L}\p{N}]")
    for c in np.flatnonzero(letters == ord("C")).tolist():
        if not 0xD800 <= c < 0xE000 and newer.match(chr(c)):
            for kind, before in ((LETTER, "a"), (NUMBER, "1")):
                if len(pattern.pre_tokenize_str(before + chr(c))) == 1:
                    table[c] = kind
    return table


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class HashTable:
    """Open addressing over int64 keys (>= 0), looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int | None = None):
        bits = bits or max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        place, rest = self._home(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[place[rest]] < 0
            self.keys[place[rest[free]]] = keys[rest[free]]
            won = self.keys[place[rest]] == keys[rest]
            self.values[place[rest[won]]] = values[rest[won]]
            rest = rest[~won]
            place[rest] = (place[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        place = self._home(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.values[place], missing)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            place[rest] = (place[rest] + 1) & self.mask
            held = self.keys[place[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[place[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... for each (start, count), one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Vocabulary:
    """Ids, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        size = max([*vocab.values(), *self.special.values()]) + 1
        forms: list[bytes] = [b""] * size
        for token, i in vocab.items():
            forms[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.special.items():
            forms[i] = token.encode()
        self.pool = np.frombuffer(b"".join(forms), np.uint8)
        self.lengths = np.array([len(f) for f in forms], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.byte_id = np.array([vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.merges = HashTable(keys, np.arange(len(keys), dtype=np.int64) << 20 | made)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """The text cut at special tokens; these stand at odd places."""
        return self.split.split(text) if self.split and any(s in text for s in self.special) else [text]

    def merge_long(self, word: bytes) -> np.ndarray:
        """Merges one long word: a heap of (rank, place) over a linked list."""
        ids = [int(self.byte_id[b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(places: list[int]) -> None:
            places = [p for p in places if p >= 0 and after[p] < len(ids)]
            found = self.merges.get(np.array([ids[p] << 20 | ids[after[p]] for p in places], np.int64), -1)
            for p, v in zip(places, found.tolist(), strict=True):
                if v >= 0:
                    heapq.heappush(heap, (v, p, ids[p], ids[after[p]]))

        offer(list(range(len(ids) - 1)))
        while heap:
            v, p, a, b = heapq.heappop(heap)
            q = after[p]
            if ids[p] != a or q >= len(ids) or ids[q] != b:
                continue
            ids[p], ids[q] = v & 0xFFFFF, -1
            after[p] = after[q]
            if after[p] < len(ids):
                before[after[p]] = p
            offer([before[p], p])
        return np.array([i for i in ids if i >= 0], np.int64)

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte spans, merged by rank: (ids, counts). Each round joins the best pair of every word, leftmost first."""
        lengths = ends - starts
        counts, parts = np.zeros(len(starts), np.int64), []
        for w in np.flatnonzero(lengths > LONG_WORD):
            found = self.merge_long(data[starts[w] : ends[w]].tobytes())
            counts[w] = len(found)
            parts.append((np.full(len(found), w), found))
        live = np.flatnonzero((lengths <= LONG_WORD) & (lengths > 0))
        ids = self.byte_id[data[ragged(starts[live], lengths[live])]]
        word = np.repeat(live, lengths[live])
        while len(ids):
            value = np.full(len(ids), _NONE)
            same = np.flatnonzero(word[:-1] == word[1:])
            value[same] = self.merges.get(ids[same] << 20 | ids[same + 1], _NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(value, first), size)
            done = best == _NONE
            if done.any():
                parts.append((word[done], ids[done]))
                heads = done[first]
                counts[word[first[heads]]] = size[heads]
            at = np.flatnonzero((value == best) & ~done)
            if not len(at):
                break
            fresh = np.concatenate([[True], np.diff(at) > 1])
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = value[at] & 0xFFFFF
            keep = ~done
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        if not parts:
            return np.zeros(0, np.int64), counts
        whose, out = (np.concatenate(x) for x in zip(*parts, strict=True))
        return out[np.argsort(whose, kind="stable")], counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, one token after another."""
        return self.pool[ragged(self.starts[ids], self.lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pre_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, bounds, first): UTF-8 bytes of all texts, the bounds of their words, and each text's first word, with the total at the end.

    Words: 's 't 're 've 'm 'll 'd | optional space and a run of letters, of numbers or of others | white space, without the
    last character before a word.
    """
    joined = "".join(texts)
    data = np.frombuffer(joined.encode(), np.uint8)
    n = len(joined)
    limits = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    points = data if len(data) == n else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    head = np.zeros(n + 1, bool)
    head[limits] = True
    space = kind == SPACE
    last = np.concatenate([[OTHER + 1], kind[:-1]])
    last[head[:-1]] = OTHER + 1
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:] & ~head[1:-1]
    glue = np.zeros(n, bool)
    glue[1:] = (points[:-1] == 0x20) & ~head[1:-1]
    start = np.where(space, (last != SPACE) | follows, (last != kind) & ~glue)
    short = np.flatnonzero((points == 0x27) & start)
    short = short[short + 1 < n]
    short = short[~head[short + 1]]
    if len(short):
        one = points[short + 1]
        two = np.where(short + 2 < n, points[np.minimum(short + 2, n - 1)], 0)
        two[head[np.minimum(short + 2, n)]] = 0
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, size in ((short[single], 2), (short[double], 3)):
            start[found + 1] = False
            rest = found + size
            rest = rest[rest < n]
            start[rest[(kind[rest] == LETTER) & ~head[rest]]] = True
    begins = np.flatnonzero(start)
    first = np.searchsorted(begins, limits)
    if len(data) != n:
        width = np.ones(n, np.int64)
        for bound in (0x7F, 0x7FF, 0xFFFF):
            width += points > bound
        place = np.concatenate([[0], np.cumsum(width)])
        begins = place[begins]
    return data, np.append(begins, len(data)), first


def minimal_automaton(sorted_words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of ascending distinct words. Arc (state, byte) -> state, with the number of words before it."""
    arcs: list[dict[int, int]] = [{}]
    final, known, below = [False], {}, {}

    def freeze(path: list[int], keep: int) -> None:
        while len(path) > keep:
            state = path.pop()
            shape = (final[state], tuple(arcs[state].items()))
            parent = path[-1]
            byte = next(reversed(arcs[parent]))
            if shape in known:
                arcs[parent][byte] = known[shape]
            else:
                known[shape] = state
                below[state] = final[state] + sum(below[t] for t in arcs[state].values())

    path, last = [0], b""
    for word in sorted_words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        freeze(path, same + 1)
        for byte in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    freeze(path, 1)
    keys, to, skips = [], [], []
    number, queue = {0: 0}, [0]
    for state in queue:
        skip = int(final[state])
        for byte, target in sorted(arcs[state].items()):
            if target not in number:
                number[target] = len(number)
                queue.append(target)
            keys.append(number[state] << 8 | byte)
            to.append(number[target])
            skips.append(skip)
            skip += below[target]
    ends = np.zeros(len(number), np.int64)
    for state, k in number.items():
        ends[k] = final[state]
    table = HashTable(np.array(keys, np.int64), np.array(to, np.int64) << 32 | np.array(skips, np.int64))
    return {"arc": table.keys, "target": table.values, "final": ends}


class Lexicon:
    """The automaton with the ids of its words, as arrays in one file that is mapped into memory."""

    NAMES = ("arc", "target", "final", "pool", "starts", "size")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.table = HashTable.__new__(HashTable)
        bits = int(len(self.arc)).bit_length() - 1
        self.table.shift, self.table.mask, self.table.keys, self.table.values = np.uint64(64 - bits), (1 << bits) - 1, self.arc, self.target
        self.longest = int(self.size[0])

    @staticmethod
    def compile(found: list[bytes], vocab: Vocabulary) -> bytes:
        """The file's bytes: a line of JSON with each array's place, then the arrays."""
        found = sorted(set(found))
        arrays = minimal_automaton(found)
        lengths = np.array([len(w) for w in found], np.int64)
        ends = np.cumsum(lengths)
        arrays["pool"], counts = vocab.merge(np.frombuffer(b"".join(found), np.uint8), ends - lengths, ends)
        arrays["starts"] = np.concatenate([[0], np.cumsum(counts)])
        arrays["size"] = np.array([max(lengths, default=0)], np.int64)
        head = json.dumps({n: len(arrays[n]) for n in Lexicon.NAMES}).encode()
        return (head + b" " * (-len(head) % 8 + 7) + b"\n") + b"".join(arrays[n].astype(np.int64).tobytes() for n in Lexicon.NAMES)

    @staticmethod
    @lru_cache(maxsize=1)
    def load(uri: str) -> Lexicon:
        if urlparse(uri).scheme in ("", "file"):
            raw = np.asarray(np.memmap(urlparse(uri).path, np.uint8, "r"))
        else:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        at = int(np.flatnonzero(raw[:4096] == 10)[0]) + 1
        arrays = {}
        for name, size in json.loads(raw[: at - 1].tobytes()).items():
            arrays[name] = raw[at : at + 8 * size].view(np.int64)
            at += 8 * size
        return Lexicon(arrays)

    def find(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        lengths = np.diff(bounds)
        out = np.full(len(lengths), -1, np.int64)
        live = np.flatnonzero((lengths <= self.longest) & (lengths > 0))
        state, number = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for step in range(self.longest):
            if not len(live):
                break
            value = self.table.get(state << 8 | data[bounds[live] + step], -1)
            number += value & 0xFFFFFFFF
            state = value >> 32
            on = value >= 0
            over = on & (lengths[live] == step + 1)
            hit = over & (self.final[np.maximum(state, 0)] == 1)
            out[live[hit]] = number[hit]
            on &= ~over
            live, state, number = live[on], state[on], number[on]
        return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number of each distinct word, which of them each word is). Words of equal hashes are compared byte by byte."""
    _, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, like = ends - starts, one[which]
    other = size != size[like]
    live = np.flatnonzero(~other & (like != np.arange(len(size))) & (size > 0))
    if len(live):
        differ = data[ragged(starts[live], size[live])] != data[ragged(starts[like[live]], size[live])]
        other[live] = np.logical_or.reduceat(differ, np.cumsum(size[live]) - size[live])
    found: dict[bytes, int] = {}
    for i in np.flatnonzero(other).tolist():  # none, but for collisions
        word = data[starts[i] : ends[i]].tobytes()
        if word not in found:
            found[word] = len(one)
            one = np.append(one, i)
        which[i] = found[word]
    return one, which


def encode(texts: list[str], vocab: Vocabulary, lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of whole texts: bounds[i] is where text i's ids start, with the total at the end."""
    pieces, owner, special = [], [], []
    for i, text in enumerate(texts):
        for k, piece in enumerate(vocab.pieces(text)):
            special.append(vocab.special[piece] if k % 2 else -1)
            pieces.append("" if k % 2 else piece)
            owner.append(i)
    data, bounds, first = pre_tokens(pieces)
    starts, ends = bounds[:-1], bounds[1:]
    number = lexicon.find(data, bounds) if lexicon else np.full(len(starts), -1, np.int64)
    unseen = np.flatnonzero(number < 0)
    one, which = distinct_words(data, starts[unseen], ends[unseen])
    made, counts = vocab.merge(data, starts[unseen[one]], ends[unseen[one]])
    pool = np.concatenate([lexicon.pool, made]) if lexicon else made
    base = len(pool) - len(made)
    place, size = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
    seen = np.flatnonzero(number >= 0)
    if len(seen):
        place[seen] = lexicon.starts[number[seen]]
        size[seen] = lexicon.starts[number[seen] + 1] - place[seen]
    place[unseen], size[unseen] = (base + np.cumsum(counts) - counts)[which], counts[which]
    ids = pool[ragged(place, size)]
    limits = np.concatenate([[0], np.cumsum(size)])[first]
    special = np.array(special, np.int64)
    marks = np.flatnonzero(special >= 0)
    if len(marks):
        ids = np.insert(ids, limits[marks], special[marks])
        limits = limits + np.concatenate([[0], np.cumsum(special >= 0)])
    owner = np.array(owner, np.int64)
    return ids, limits[np.searchsorted(owner, np.arange(len(texts) + 1))]


def _counter(path: str):
    def run(batches):
        def send():
            words = [w for w, c in table.items() if c > 1]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([table[w] for w in words], pa.int64())], names=["word", "n"])
            table.clear()
            return out

        table: dict[bytes, int] = {}
        vocab = vocabulary(path)
        for batch in sliced(batches, "text"):
            texts = [p for t in batch.column("text").to_pylist() if t for p in vocab.pieces(t)[::2]]
            data, bounds, _ = pre_tokens(texts)
            starts, ends = bounds[:-1], bounds[1:]
            fit = ends - starts <= LEXICON_BYTES
            starts, ends = starts[fit], ends[fit]
            _, one, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
            raw = data.tobytes()
            for a, b, c in zip(starts[one].tolist(), ends[one].tolist(), n.tolist(), strict=True):
                w = raw[a:b]
                table[w] = table.get(w, 0) + c
            if len(table) > COUNT_FLUSH:
                yield send()
        yield send()

    return run


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> str:
    """Counts the words of all texts and compiles the `size` most frequent; returns the file's place in the shared folder.

    A word seen once in a task's share isn't sent on, so any word more frequent than there are shares is counted.
    At most `size` words of LEXICON_BYTES bytes come to the driver.
    """
    spark = docs.sparkSession
    counted = map_batches(docs.select("text"), _counter(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted.filter("n > 1"), "words")
    top = [bytes(r.word) for r in counted.filter(most_frequent(counted, size, "word")).select("word").collect()]
    drop(counted)
    uri = new_folder(spark, "lexicon")
    folder, name = uri.rsplit("/", 1)
    fs, where = pafs.FileSystem.from_uri(folder)
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(f"{where}/{name}") as f:
        f.write(Lexicon.compile(top, vocabulary(path)))
    return uri


def _codec(path: str, lexicon: str | None):
    def run(batches):
        vocab, lex = vocabulary(path), lexicon and Lexicon.load(lexicon)
        for batch in sliced(batches, "text"):
            ids, bounds = encode([t or "" for t in batch.column("text").to_pylist()], vocab, lex)
            size = vocab.lengths[ids]
            at = np.concatenate([[0], np.cumsum(size)])[bounds]
            text, raw = memoryview(vocab.pool[ragged(vocab.starts[ids], size)]), memoryview(ids.astype("<u4"))
            own = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            back = [hashlib.sha256(bytes(text[a:b]).decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoder(path: str, lexicon: str | None):
    def run(batches):
        vocab, lex = vocabulary(path), lexicon and Lexicon.load(lexicon)
        for batch in sliced(batches, "text"):
            ids, bounds = encode([t or "" for t in batch.column("text").to_pylist()], vocab, lex)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoder(path: str):
    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode_documents(docs: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """(doc_id, ids): ids of each whole text, null as empty. `lexicon` is what build_lexicon returned; without it the same ids take longer."""
    return map_batches(docs.select("doc_id", "text"), _encoder(path, lexicon), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), special tokens written out; bytes that aren't UTF-8 become U+FFFD."""
    return map_batches(encoded.select("doc_id", "ids"), _decoder(path), "doc_id long, text string")


def code_documents(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Encodes and decodes every whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A null text counts as empty (no ids); a null doc_id is passed through; texts of any length are read whole; repeated
    rows each get their row; an empty table gives an empty result. Other columns are ignored. The strings of special
    tokens inside a text become their ids, as the tokenizers library does by default.
    """
    lexicon = build_lexicon(docs, path, lexicon_words)
    return map_batches(docs.select("doc_id", "text"), _codec(path, lexicon), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
