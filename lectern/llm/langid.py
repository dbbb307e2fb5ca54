"""Language identification by interpolated Kneser-Ney character models (operator 10).

A text is its words: runs of letters, lowered, each with an end mark; characters before a word's start count as blank.
Spark counts the 4-grams of all learning rows for each language, and from them the lower orders' continuation counts, as
Kneser-Ney smoothing has it, the contexts' totals and the counts of counts that discounts rest on. The counts of all
n-grams and contexts go to files in the shared folder, each a run of hashes in ascending order with the languages that have
the n-gram; tasks map them into memory, so neither the driver nor a broadcast holds them. A probability is put together
order by order when a text is read. A text goes to the language of the lowest cross-entropy per character. The score is
a softmax of the cross-entropies whose temperature is calibrated on learning rows that weren't counted, and `rejected`
marks texts below the score from which on accepted texts reach the target accuracy.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, _classes, ragged
from .common import bucket_of, cut, drop, map_batches, mix, new_folder, sliced

ORDER = 4
#: A task's counts are sent on at this many n-grams.
FLUSH = 1_000_000
#: Characters of a pass over long texts, and numbers of a table of probabilities.
PASS, CELLS = 1 << 20, 1 << 22
#: Rows of a file of counts, about.
FILE_ROWS = 4_000_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """One learning row in `share`, `sample` at most, calibrates and isn't counted, of languages that have `enough` rows."""

    sample: int = 2000
    share: int = 20
    enough: int = 200
    accuracy: float = 0.99


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): 16-bit codes of all texts' letters with one 0 after each word and before each text, and each text's first code after its mark, with the total at the end.

    A letter beyond the first 65,536 code points shares one of 8,192 codes that no other letter has.
    """
    lowered = [t.lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    parts = []
    for at in range(0, len(joined), PASS):
        points = np.frombuffer(joined[at : at + PASS].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(points < 0x10000, points, 0xD800 + points % 8192).astype(np.uint16)
        parts.append(np.where(_classes()[points] == LETTER, code, 0).astype(np.uint16))
    code = np.concatenate(parts)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    place = np.cumsum(keep, dtype=np.int32)
    limits = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])]).astype(np.int64)
    return code[keep], place[limits].astype(np.int64)


def packed(code: np.ndarray, a: int, b: int) -> np.ndarray:
    """4-grams (16 bits a character) that end at the places a to b; what precedes a word is 0."""
    own = np.zeros(b - a + 3, np.uint64)
    low = max(0, a - 3)
    own[3 - (a - low) :] = code[low:b]
    one = own[2:-1]
    two = np.where(one != 0, own[1:-2], 0)
    three = np.where(two != 0, own[:-3], 0)
    return three << np.uint64(48) | two << np.uint64(32) | one << np.uint64(16) | own[3:]


def _add(table: dict, lang: str, keys: np.ndarray, counts: np.ndarray) -> None:
    if lang in table:
        keys, counts = np.concatenate([table[lang][0], keys]), np.concatenate([table[lang][1], counts])
        keys, where = np.unique(keys, return_inverse=True)
        counts = np.bincount(where, counts).astype(np.int64)
    table[lang] = keys, counts


def _count(batches):
    def send():
        for lang, (keys, counts) in table.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])
        table.clear()

    table: dict = {}
    for batch in sliced(batches, "text"):
        code, first = codes([t or "" for t in batch.column("text").to_pylist()])
        langs = np.array(batch.column("lang").to_pylist())
        whose = np.searchsorted(first, np.arange(len(code)), "right") - 1
        for a in range(0, len(code), PASS):
            b = min(len(code), a + PASS)
            grams, lang = packed(code, a, b), whose[a:b]
            for name in np.unique(langs[lang[lang >= 0]]) if len(langs) else ():
                own = np.isin(lang, np.flatnonzero(langs == name)) & (lang >= 0)
                _add(table, str(name), *np.unique(grams[own], return_counts=True))
        if sum(len(k) for k, _ in table.values()) > FLUSH:
            yield from send()
    yield from send()


def key_of(kind: int, grams: np.ndarray) -> np.ndarray:
    """Hashes of n-grams. kind: 2 * order - 2 for an n-gram, 2 * order - 1 for its context."""
    return mix(grams ^ mix(np.array([kind + 1], np.uint64))).view(np.int64)


def _hashed(batches):
    for b in batches:
        kind, gram = np.asarray(b.column("kind")), np.asarray(b.column("gram")).view(np.uint64)
        key = np.empty(len(kind), np.int64)
        for k in np.unique(kind).tolist():
            key[kind == k] = key_of(k, gram[kind == k])
        yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(c) for c in ("lang", "n", "kinds"))], names=["key", "lang", "n", "kinds"])


_ARRAYS = (("keys", np.int64), ("starts", np.int64), ("lang", np.int32), ("n", np.int64), ("kinds", np.int64))


def _writer(folder: str, names: list[str]):
    number = {name: k for k, name in enumerate(names)}

    def run(batches):
        parts = [(np.asarray(b.column("key")), [number[x] for x in b.column("lang").to_pylist()], np.asarray(b.column("n")), np.asarray(b.column("kinds"))) for b in batches if b.num_rows]
        if not parts:
            return
        key, lang, n, kinds = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        arrays = {"keys": key[starts], "starts": np.append(starts, len(key)), "lang": lang, "n": n, "kinds": kinds}
        head = json.dumps({k: len(v) for k, v in arrays.items()}).encode()
        fs, where = pafs.FileSystem.from_uri(folder)
        fs.create_dir(where, recursive=True)
        name = uuid.uuid4().hex  # the attempt's own; the table of names is what is committed
        with fs.open_output_stream(f"{where}/{name}") as out:
            out.write(head + b" " * (-len(head) % 8 + 7) + b"\n")
            for k, kind in _ARRAYS:
                out.write(arrays[k].astype(kind).tobytes() + b"\0" * (-arrays[k].astype(kind).nbytes % 8))
        yield pa.RecordBatch.from_pylist([{"file": name, "first": int(key[0]), "last": int(key[-1])}])

    return run


class CountFile:
    """One file of counts, mapped into memory."""

    def __init__(self, uri: str):
        if urlparse(uri).scheme in ("", "file"):
            raw = np.asarray(np.memmap(urlparse(uri).path, np.uint8, "r"))
        else:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        at = int(np.flatnonzero(raw[:4096] == 10)[0]) + 1
        sizes = json.loads(raw[: at - 1].tobytes())
        for name, kind in _ARRAYS:
            size = sizes[name] * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + -size % 8


@lru_cache(maxsize=1)
def _opened(files: tuple[str, ...]) -> list[CountFile]:
    return [CountFile(f) for f in files]


@dataclass
class Models:
    """What tasks need besides the files: languages, discounts for each order and language, the log of a letter's chance before any count, the files and their first keys."""

    languages: list[str]
    discounts: np.ndarray
    floor: float
    files: tuple[str, ...]
    firsts: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def _table(self, kind: int, grams: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """For each name, the numbers of all languages for each of the ascending n-grams; 0 where a language hasn't it."""
        out = [np.zeros((len(grams), len(self.languages))) for _ in names]
        key = key_of(kind, grams)
        order = np.argsort(key)
        key = key[order]
        limits = [0, *np.searchsorted(key, self.firsts[1:]).tolist(), len(key)] if len(self.files) else [0]
        for file, a, b in zip(_opened(self.files), limits[:-1], limits[1:], strict=False):
            if a == b:
                continue
            at = np.minimum(np.searchsorted(file.keys, key[a:b]), len(file.keys) - 1)
            hit = np.flatnonzero(file.keys[at] == key[a:b])
            starts, counts = file.starts[at[hit]], file.starts[at[hit] + 1] - file.starts[at[hit]]
            entry = ragged(starts, counts)
            row, lang = np.repeat(order[a + hit], counts), file.lang[entry]
            for table, name in zip(out, names, strict=True):
                table[row, lang] = getattr(file, name)[entry]
        return out

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities of the last character of each 4-gram after the others, for all languages."""
        p = np.full((len(grams), len(self.languages)), np.exp(self.floor))
        for order in range(1, ORDER + 1):
            own, back = np.unique(grams & np.uint64((1 << 16 * order) - 1), return_inverse=True)
            heads, head = np.unique(own >> np.uint64(16), return_inverse=True)
            (n,) = self._table(2 * order - 2, own, ("n",))
            total, kinds = self._table(2 * order - 1, heads, ("n", "kinds"))
            off = self.discounts[order - 1]
            whole = np.maximum(total, 1)
            found = (np.maximum(n - off, 0) / whole[head])[back]
            # a context that a language hasn't leaves all to the order below
            left = np.where(total > 0, off * kinds / whole, 1.0)[head][back]
            p = found + left * p
        return np.log(p)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character for each language, number of characters) of each text."""
        code, first = codes(texts)
        n = np.diff(first)
        total = np.zeros((len(texts), len(self.languages)))
        step = max(1, CELLS // len(self.languages))
        for a in range(1, len(code), PASS):
            b = min(len(code), a + PASS)
            grams, which, count = np.unique(packed(code, a, b), return_inverse=True, return_counts=True)
            text = np.searchsorted(first, np.arange(a, b), "right") - 1
            rows = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            for c in range(0, len(grams), step):
                logp = self.log_probabilities(grams[c : c + step])
                if len(grams) <= step:
                    for j in range(len(self.languages)):
                        total[text[rows], j] += np.add.reduceat(logp[which, j], rows)
                else:  # many languages: a part of the n-grams at a time
                    own = np.flatnonzero((which >= c) & (which < c + step))
                    for j in range(len(self.languages)):
                        total[:, j] += np.bincount(text[own], logp[which[own] - c, j], len(texts))
        return -total / np.maximum(n, 1)[:, None], n

    def score(self, entropy: np.ndarray, n: np.ndarray, temperature: float | None = None) -> np.ndarray:
        """Softmax over languages of the cross-entropies; more characters make it surer."""
        z = -entropy * np.sqrt(n)[:, None] / (temperature or self.temperature)
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, langs: list[str], accuracy: float) -> None:
        """Sets the temperature of the best log-likelihood, and the least score from which on accepted texts are right often enough."""
        use = np.flatnonzero(n > 0)
        if not len(use):
            return
        place = {name: k for k, name in enumerate(self.languages)}
        entropy, n, truth = entropy[use], n[use], np.array([place[langs[i]] for i in use])
        loss = lambda t: -np.log(np.maximum(self.score(entropy, n, t)[np.arange(len(use)), truth], 1e-6)).mean()
        self.temperature = min(2.0 ** np.arange(-4, 5.5, 0.5), key=loss)
        p = self.score(entropy, n)
        best, right = p.max(1), entropy.argmin(1) == truth
        order = np.argsort(-best)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= accuracy)
        self.least = float(best[order[good[-1]]]) if len(good) else 1.0


def _entropies(shared):
    def run(batches):
        for batch in sliced(batches, "text"):
            entropy, n = shared.value.entropies([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n), pa.array(entropy.tolist(), pa.list_(pa.float64()))], names=["lang", "n", "entropy"])

    return run


def count(known: DataFrame) -> list[DataFrame]:
    """Tables (lang, gram, n) of the orders 1 to ORDER: counts of the longest n-grams, continuation counts of the others."""
    top = map_batches(known.select("text", "lang"), _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    tables = [cut(top, "grams")]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("gram")
        tables.insert(0, cut(tables[0].groupBy("lang", shorter).agg(F.count("*").alias("n")), "grams"))
    return tables


def model_of(known: DataFrame) -> Models | None:
    """The models of (text, lang) rows, their counts in files of the shared folder; None without any n-gram. Numbers for each language and order come to the driver."""
    spark = known.sparkSession
    tables = count(known)
    stats, entries = None, None
    for order, table in enumerate(tables, 1):
        own = table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"), F.count("*").alias("rows")).withColumn("order", F.lit(order))
        stats = own if stats is None else stats.unionAll(own)
        grams = table.select(F.lit(2 * order - 2).alias("kind"), "lang", "gram", "n", F.lit(0).cast("long").alias("kinds"))
        head = F.shiftrightunsigned("gram", 16).alias("gram")
        contexts = table.groupBy("lang", head).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).select(F.lit(2 * order - 1).alias("kind"), "lang", "gram", "n", "kinds")
        entries = grams.unionAll(contexts) if entries is None else entries.unionAll(grams).unionAll(contexts)
    found = stats.collect()
    if not found:
        return None
    names = sorted({r.lang for r in found})
    discounts = np.full((ORDER, len(names)), 0.5)  # where no n-gram was met once, or none twice
    for r in found:
        if r.ones and r.twos:
            discounts[r.order - 1, names.index(r.lang)] = r.ones / (r.ones + 2 * r.twos)
    letters = tables[0].select("gram").distinct().count()
    folder = new_folder(spark, "languages")
    files = max(1, -(-sum(r.rows for r in found) // FILE_ROWS))
    hashed = map_batches(entries, _hashed, "key long, lang string, n long, kinds long")
    written = map_batches(hashed.repartitionByRange(files, "key").sortWithinPartitions("key"), _writer(folder, names), "file string, first long, last long")
    manifest = cut(written, "manifest")
    listed = sorted(manifest.collect(), key=lambda r: r.first)  # a row for each file
    drop(*tables, manifest)
    return Models(names, discounts, -np.log(1 + letters), tuple(f"{folder}/{r.file}" for r in listed), np.array([r.first for r in listed], np.int64))


def fit(docs: DataFrame, s: Settings = Settings()) -> Models | None:
    """Learns from all rows with crc32(doc_id) mod 4 not 2, lang and text not null; None without any.

    The rows that calibrate are those with the least hashed ids among one in s.share, s.sample at most.
    """
    spark = docs.sparkSession
    known = docs.filter((bucket_of("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # numbers for each language
    large = [r.lang for r in known.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= s.enough).collect()]
    apart = known.filter((F.pmod(F.xxhash64("doc_id"), F.lit(s.share)) == 0) & F.col("lang").isin(large)).select("doc_id").distinct() if large else known.select("doc_id").limit(0)
    # one column of at most s.sample rows; numbers for each come back
    picked = F.broadcast(cut(apart.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample), "picked"))
    models = model_of(known.join(picked, "doc_id", "left_anti"))
    if models is None:
        return None
    rows = map_batches(known.join(picked, "doc_id", "left_semi").dropDuplicates(["doc_id"]).filter(F.col("lang").isin(models.languages)), _entropies(spark.sparkContext.broadcast(models)), "lang string, n long, entropy array<double>").collect()
    if rows:
        models.calibrate(np.array([r.entropy for r in rows]), np.array([r.n for r in rows]), [r.lang for r in rows], s.accuracy)
    return models


def _predictor(shared):
    def run(batches):
        models = shared.value
        for batch in sliced(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if models is None:
                best, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                entropy, n = models.entropies(texts)
                best = [models.languages[k] if c else UNKNOWN for k, c in zip(entropy.argmin(1).tolist(), n.tolist(), strict=True)]
                score = np.where(n > 0, models.score(entropy, n).max(1), 0.0)
                rejected = (score < models.least) | (n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify_languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document.

    A text that is null or has no letter gets `und`, score 0 and rejected; a null doc_id is passed through with held_out
    null; long texts are read whole; repeated rows each get their row; equal entropies go to the first language by name;
    without learning rows every text gets `und`. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, settings))
    out = map_batches(docs.select("doc_id", "text"), _predictor(shared), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
