"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification (operator 3).

The CGK walk reads a text from a start: at step i it puts out the character under it, then moves on or stays as a random
table says for (i, character). Walks over texts that differ by few edits fall into step again after each edit, so edit
distance turns into Hamming distance of the outputs. Every word of a document and of an item starts a window of STRETCHES
stretches, and so do places inside text without blanks; so an item is sampled over its whole length, whatever it is. Each
repetition of the LSH samples SAMPLED of the SPAN outputs of one stretch of the walk.
Windows that share a repetition's sample with an item are hits. The NEAR bytes of the item around a hit are compared with
the text first, which leaves few hits of common phrases. Then the whole item is verified: its least edit distance to any
part of the text around must be at most MAX_EDITS of its length. An edit spoils at most GRAM of the item's n-grams, so
parts that lack more of them than all edits can spoil are left without working the distance out.

Walks of one text never cross: once two stand on one character at the same step, they stay together. So after each
stretch the windows that met are carried on as one, which leaves a small share of them after the first stretches. A hit
is placed by where its stretch starts in the text and in the item. A window ends with its row, so what is found in a row
does not depend on the rows beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import ragged
from .common import _LOWER, _SPACE, map_batches, mix, sliced, text_column

SPAN, SAMPLED = 32, 20
STRETCHES = 12
WALKS = 2
#: Share of an item's length that may be edited.
MAX_EDITS = 0.2
#: Shorter items (bytes) have no whole stretch; they are cut into one piece more than edits may hit, and each place of a piece is verified.
LEAST_ITEM = 48
#: From so many bytes on, the share of edits up to which an item is found with a probability of 0.95 or more; shorter items are always found.
ASSURED = {48: 0.05, 72: 0.1, 96: 0.12, 144: 0.15, 224: MAX_EDITS}
#: Bytes without a blank after which windows start inside a word too.
RUN = 16
#: A hit is looked at closely first: so many bytes of the item around it must be in the text within so many edits, twice the share of whole items.
NEAR, NEAR_EDITS = 64, 26
#: Bytes of the n-grams that are counted before a distance is worked out.
GRAM = 3
#: Bytes within which equal windows of text that repeats itself count as one.
STEP = 8
#: Hits that are looked at in one go.
PAIRS = 1 << 18
#: Distances that are worked out side by side.
LANES = 1024
#: Items of one pass over the documents; more items take more passes, so what is sent to the tasks stays bounded.
ITEMS_PER_PASS = 50_000
#: The same for the bytes of their texts, as each word of an item has walks.
BYTES_PER_PASS = 4 << 20



def assured_edits(size: int) -> float:
    """Share of edits up to which items of so many bytes are found with a probability of 0.95 or more. Up to MAX_EDITS they may be found, too, but less often: a short item has few stretches."""
    return next((share for least, share in reversed(ASSURED.items()) if size >= least), MAX_EDITS)


_SEED = np.random.default_rng(20240229)
#: A step's random table: a character c moves on if the top bit of factor * c + shift (in a byte) is set.
_FACTOR = _SEED.integers(0, 128, (WALKS, STRETCHES * SPAN), dtype=np.uint8) * np.uint8(2) + np.uint8(1)
_SHIFT = _SEED.integers(0, 256, (WALKS, STRETCHES * SPAN), dtype=np.uint8)
_PICKED = np.array([[np.isin(np.arange(SPAN), _SEED.choice(SPAN, SAMPLED, replace=False)) for _ in range(STRETCHES)] for _ in range(WALKS)])
_STEP = np.uint32(0x9E3779B1)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lowered, white space runs as one blank; with new offsets."""
    space = _SPACE[data]
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = ~(space[1:] & space[:-1])
        heads = offsets[:-1][np.diff(offsets) > 0]
        keep[heads] = True
    out = np.where(space, np.uint8(0x20), _LOWER[data])[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[offsets]


def window_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where windows of normalised texts start: at words, and inside of text without blanks at some of its places.

    Which ones, the bytes around them tell (RUN bytes before and four after without a blank), so that a passage and its
    copy have the same ones.
    """
    blank = data == 0x20
    head = np.ones(len(data), bool)
    head[1:] = blank[:-1]
    head[offsets[:-1][np.diff(offsets) > 0]] = True
    head &= ~blank
    # bytes since the last blank or start of a row
    place = np.arange(len(data), dtype=np.int32)
    since = place - np.maximum.accumulate(np.where(blank | head, place, np.int32(0)))
    inside = np.flatnonzero((since[:-3] >= RUN) & ~blank[3:]) if len(data) > 3 else place[:0]
    if len(inside):
        inside = inside[(since[inside + 3] == since[inside] + 3)]
        code = np.zeros(len(inside), np.uint32)
        for k in range(4):
            code = (code ^ data[inside + k]) * np.uint32(0x01000193)
        head[inside[(code * _STEP >> np.uint32(29)) < 2]] = True
    return np.flatnonzero(head)


def gram_codes(data: np.ndarray) -> np.ndarray:
    """16-bit codes of the n-grams at each place; equal n-grams have equal codes."""
    size = max(0, len(data) - GRAM + 1)
    code = np.zeros(size, np.uint32)
    for k in range(GRAM):
        code = code * np.uint32(0x01000193) + data[k : k + size]
    return (code * _STEP >> np.uint32(16)).astype(np.uint16)


def walk(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, turn: int):
    """For each stretch: (hashes of the samples, first window of each group, its place at the stretch's start, whether it stayed in its text).

    ends are where the windows' texts end. data needs STRETCHES * SPAN bytes after the last start.
    """
    at, lead = starts.astype(np.int64), np.arange(len(starts), dtype=np.int32)
    for s in range(STRETCHES):
        read, move = np.empty(len(at), np.uint8), np.empty(len(at), np.uint8)
        begin = at.copy()
        key = np.zeros(len(at), np.uint32)
        for k in range(SPAN):
            np.take(data, at, out=read, mode="clip")
            if _PICKED[turn, s, k]:
                key *= _STEP
                key += read
            np.multiply(read, _FACTOR[turn, s * SPAN + k], out=move)
            move += _SHIFT[turn, s * SPAN + k]
            move >>= np.uint8(7)
            np.add(at, move, out=at, casting="unsafe")
        inside = at < ends[lead]
        yield key * _STEP, lead, begin, inside
        at, lead = at[inside], lead[inside]
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1]
        at, lead = at[fresh], lead[fresh]


def _first(key: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of neighbouring windows of one owner with equal samples, the first one of each STEP bytes; the slack of what follows covers the others."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] // STEP != place[:-1] // STEP)
    return fresh


@dataclass
class Items:
    """Normalised items, and for each walk and stretch the (ascending hashes, items, places in them) of those whose walk stays inside the item."""

    ids: list[int]
    texts: list[bytes]
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    short: list[int]
    grams: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        texts = []
        for _, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            texts.append(normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" "))
        tables = []
        long = [k for k, t in enumerate(texts) if len(t) >= LEAST_ITEM]
        raw = np.frombuffer(b"".join(texts[k] for k in long), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(texts[k]) for k in long])]).astype(np.int64)
        data = np.concatenate([raw, np.zeros(STRETCHES * SPAN + 1, np.uint8)])
        starts = window_starts(raw, offsets)
        item_of = np.searchsorted(offsets, starts, "right") - 1
        for turn in range(WALKS):
            tables.append([])
            for key, lead, begin, stays in walk(data, starts, offsets[1:][item_of], turn):
                inside = np.flatnonzero(stays)
                item, place = item_of[lead[inside]], begin[inside] - offsets[item_of[lead[inside]]]
                order = np.lexsort((place, item, key[inside]))
                order = order[_first(key[inside][order], item[order], place[order])]
                tables[-1].append((key[inside][order], np.array(long, np.int32)[item[order]], place[order].astype(np.int32)))
        return Items([i for i, _ in rows], texts, tables, [k for k, t in enumerate(texts) if 0 < len(t) < LEAST_ITEM], [gram_codes(np.frombuffer(t, np.uint8)) for t in texts])


def least_distance(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """(least edit distance of item to any part of text, where that part ends); beyond `most` the distance may be too high.

    Bit-parallel: one word of len(item) bits holds a column of the distance table.
    """
    at = text.find(item)
    if at >= 0:
        return 0, at + len(item)
    n = len(item)
    masks: dict[int, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | x) & full
        up, down = minus | ~(d | plus) & full, plus & d
        score += 1 if up & top else -1 if down & top else 0
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(x | up) & full, up & x
        # the row above the table is 0 everywhere: the part may start at any place
        if score < best:
            best, end = score, j + 1
    return best, end


def pieces(item: bytes) -> list[tuple[int, bytes]]:
    """(place, bytes) of the pieces of a short item, of which one at least is in every text that holds the item within MAX_EDITS."""
    n = int(MAX_EDITS * len(item)) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def least_distances(tasks: list[tuple[bytes, bytes]]) -> list[tuple[int, int]]:
    """least_distance() of many (item, text), side by side: a number of each array belongs to one of them.

    A column of the table takes one 64-bit word for each 64 bytes of the item; what leaves a word enters the next.
    """
    out: list[tuple[int, int]] = [(0, 0)] * len(tasks)
    words = lambda i: len(tasks[i][0]) + 63 >> 6
    order = sorted(range(len(tasks)), key=lambda i: (words(i), len(tasks[i][1])))
    at = 0
    while at < len(order):
        width = words(order[at])
        own = [i for i in order[at : at + max(8, min(LANES, (1 << 16) // width))] if words(i) == width]
        at += len(own)
        if len(own) < 8:
            for i in own:
                out[i] = least_distance(*tasks[i], 0)
            continue
        found, ends = _columns([tasks[i] for i in own], width)
        for i, b, e in zip(own, found.tolist(), ends.tolist(), strict=True):
            out[i] = b, e
    return out


def _columns(tasks: list[tuple[bytes, bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ends) of tasks whose items all take `width` words."""
    number: dict[bytes, int] = {}
    base = np.array([number.setdefault(item, len(number)) for item, _ in tasks], np.int64) * 256
    masks = np.zeros((width, len(number) * 256), np.uint64)
    for item, k in number.items():
        place = np.arange(len(item))
        codes = k * 256 + np.frombuffer(item, np.uint8).astype(np.int64)
        np.bitwise_or.at(masks, (place >> 6, codes), np.uint64(1) << (place & 63).astype(np.uint64))
    sizes, lengths = (np.array([len(t[j]) for t in tasks], np.int64) for j in (0, 1))
    text = np.zeros((int(lengths.max()), len(tasks)), np.uint8)
    for lane, (_, part) in enumerate(tasks):
        text[: len(part), lane] = np.frombuffer(part, np.uint8)
    last = np.uint64(1) << (sizes - 1 & 63).astype(np.uint64)
    one, high = np.uint64(1), np.uint64(63)
    plus, minus = np.full((width, len(tasks)), ~np.uint64(0)), np.zeros((width, len(tasks)), np.uint64)
    eq, x, d, up, down = (np.empty(len(tasks), np.uint64) for _ in range(5))
    score, best, end = sizes.copy(), sizes.copy(), np.zeros(len(tasks), np.int64)
    for j in range(len(text)):
        code = base + text[j]
        # what comes in from the row above, which is 0 everywhere: the part may start at any place
        up_in = down_in = None
        for w in range(width):
            p, m = plus[w], minus[w]
            masks[w].take(code, out=eq, mode="clip")
            np.bitwise_or(eq, m, out=x)
            if down_in is not None:
                eq |= down_in
            np.bitwise_and(eq, p, out=d)
            d += p
            d ^= p
            d |= eq
            np.bitwise_or(d, p, out=up)
            np.invert(up, out=up)
            up |= m
            np.bitwise_and(p, d, out=down)
            if w == width - 1:
                score += (up & last) != 0
                score -= (down & last) != 0
                up_out = down_out = None
            else:
                up_out, down_out = up >> high, down >> high
            up <<= one
            down <<= one
            if up_in is not None:
                up |= up_in
                down |= down_in
            np.bitwise_or(x, up, out=p)
            np.invert(p, out=p)
            p |= down
            np.bitwise_and(up, x, out=m)
            up_in, down_in = up_out, down_out
        less = (score < best) & (j < lengths)
        if less.any():
            best[less], end[less] = score[less], j + 1
    return best, end


def _distinct(hits: np.ndarray) -> np.ndarray:
    """Of hits (row, item, place in the text, place in the item) that nearly agree in where the item starts and where in it they lie, one each: text that repeats itself would have very many."""
    row, item, at, place = hits.astype(np.uint64)
    size = np.uint64(SPAN)
    start = at + (size << np.uint64(32)) - place
    code = mix(row << np.uint64(32) | item) + mix(start // np.uint64(8) + np.uint64(1)) * np.uint64(3) + mix(place // size + np.uint64(1)) * np.uint64(5)
    return hits[:, np.unique(code, return_index=True)[1]]


def _near(hits: list[tuple[int, int, int, int]], items: Items, text: bytes, offsets: list[int]):
    """(row, item, place of the item's start) of hits (row, item, place in the text, place in the item) that the bytes around bear out."""
    tasks, wanted = [], set()
    for row, k, at, place in hits:
        item = items.texts[k]
        low = max(0, min(place - NEAR // 4, len(item) - NEAR))
        begin = at - place + low
        tasks.append((item[low : low + NEAR], text[max(offsets[row], begin - NEAR // 4) : max(offsets[row], min(offsets[row + 1], begin + NEAR * 5 // 4))]))
    for (row, k, at, place), (distance, _) in zip(hits, least_distances(tasks), strict=True):
        if distance <= NEAR_EDITS:
            wanted.add((row, k, at - place))
    return wanted


def _regions(wanted: set[tuple[int, int, int]], items: Items, offsets: np.ndarray):
    """(row, item, from, to) of the parts to verify for (row, item, place of the item's start); parts that overlap are one, up to a length."""
    open_: list[int] = []
    for row, k, start in sorted(wanted):
        size = len(items.texts[k])
        # edits shift the item, and two walks may agree before they are in step
        slack = int(MAX_EDITS * size) + SPAN
        low, high = max(int(offsets[row]), start - slack), min(int(offsets[row + 1]), start + size + slack)
        if open_ and open_[:2] == [row, k] and low <= open_[3] and high - open_[2] <= 4 * (size + 2 * slack):
            open_[3] = max(open_[3], high)
            continue
        if open_:
            yield tuple(open_)
        open_ = [row, k, low, high]
    if open_:
        yield tuple(open_)


def _finder(shared, drop: bool = False):
    """Yields the hits, or, with drop, the rows that have none."""

    def run(batches):
        items: Items = shared.value
        filters = []
        for turn in items.tables:
            filters.append([])
            for keys, *_ in turn:
                seen = np.zeros(1 << 20, bool)
                seen[keys >> np.uint32(12)] = True
                filters[-1].append(seen)
        for batch in sliced(batches, "text", 1 << 20):
            raw, offsets = normalised(*text_column(batch, "text"))
            data = np.concatenate([raw, np.zeros(STRETCHES * SPAN + 1, np.uint8)])
            starts = window_starts(raw, offsets)
            rows_of = np.searchsorted(offsets, starts, "right") - 1
            found = []
            for turn in range(WALKS):
                for s, (key, lead, begin, inside) in enumerate(walk(data, starts, offsets[1:][rows_of], turn)):
                    keys, who, place = items.tables[turn][s]
                    if not len(keys):
                        break
                    hit = np.flatnonzero(filters[turn][s].take(key >> np.uint32(12)) & inside)
                    hit = hit[_first(key[hit], rows_of[lead[hit]], begin[hit])]
                    lo, hi = np.searchsorted(keys, key[hit]), np.searchsorted(keys, key[hit], "right")
                    some = hi > lo
                    hit, lo, many = hit[some], lo[some], (hi - lo)[some]
                    parts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), PAIRS), "right").tolist()
                    for a, b in zip(parts, [*parts[1:], len(hit)], strict=False):
                        group = np.repeat(hit[a:b], many[a:b])
                        entry = ragged(lo[a:b], many[a:b])
                        found.append(_distinct(np.stack([rows_of[lead[group]], who[entry], begin[group], place[entry]])))
            hits = _distinct(np.concatenate(found, 1)) if found else np.zeros((4, 0), np.int64)
            text = raw.tobytes()
            wanted = _near(list(zip(*hits.tolist(), strict=True)), items, text, offsets.tolist())
            best: dict[tuple[int, int], tuple[int, int]] = {}
            codes, present = gram_codes(raw), np.zeros(1 << 16, bool)
            for k in items.short:
                for begin, piece in pieces(items.texts[k]):
                    at = text.find(piece)
                    while at >= 0:
                        row = int(np.searchsorted(offsets, at, "right")) - 1
                        if at + len(piece) <= offsets[row + 1]:
                            wanted.add((row, k, at - begin))
                        at = text.find(piece, at + 1)
            parts = []
            for row, k, low, high in _regions(wanted, items, offsets):
                near = codes[low : max(low, high - GRAM + 1)]
                present[near] = True
                if np.count_nonzero(present[items.grams[k]]) >= len(items.grams[k]) - GRAM * int(MAX_EDITS * len(items.texts[k])):
                    parts.append((row, k, low, text[low:high]))
                present[near] = False
            for (row, k, low, _), (distance, end) in zip(parts, least_distances([(items.texts[k], part) for _, k, _, part in parts]), strict=True):
                if distance < best.get((row, k), (int(MAX_EDITS * len(items.texts[k])) + 1, 0))[0]:
                    best[row, k] = distance, low + end - int(offsets[row])
            rows = sorted(best)
            if drop:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _ in rows]] = False
                yield batch.filter(pa.array(clean))
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array([r for r, _ in rows], pa.int64())),
                    pa.array([items.ids[k] for _, k in rows], pa.int64()),
                    pa.array([best[r][0] for r in rows], pa.int32()),
                    pa.array([len(items.texts[k]) for _, k in rows], pa.int32()),
                    pa.array([best[r][1] for r in rows], pa.int64()),
                ],
                names=["doc_id", "item_id", "distance", "item_bytes", "end_byte"],
            )

    return run


def _passes(docs: DataFrame, benchmark: DataFrame):
    """Broadcasts of at most ITEMS_PER_PASS items and about BYTES_PER_PASS bytes each; at least one."""
    sent, some, size = False, [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        some.append((r.item_id, r.text))
        size += len(r.text)
        if len(some) == ITEMS_PER_PASS or size >= BYTES_PER_PASS:
            yield docs.sparkSession.sparkContext.broadcast(Items.of(some))
            sent, some, size = True, [], 0
    if some or not sent:
        yield docs.sparkSession.sparkContext.broadcast(Items.of(some))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_bytes, end_byte): every document that holds an item within MAX_EDITS of the item's length.

    distance is in bytes of the normalised texts (A-Z lowered, white space runs as one blank); end_byte is where the part
    nearest to the item ends there. Null or blank texts and items match nothing; a null doc_id is passed through; texts
    are read whole; repeated rows and repeated items are each reported; items of under LEAST_ITEM bytes are
    found without fail; empty tables give no rows. Other columns are ignored.
    """
    out = None
    for shared in _passes(docs, benchmark):
        own = map_batches(docs.select("doc_id", "text"), _finder(shared), "doc_id long, item_id long, distance int, item_bytes int, end_byte long")
        out = own if out is None else out.unionAll(own)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that contaminated() finds nothing in."""
    for shared in _passes(docs, benchmark):
        docs = map_batches(docs, _finder(shared, drop=True), docs.schema)
    return docs
