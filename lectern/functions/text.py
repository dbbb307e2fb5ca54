"""Text normalisation, tokens and legacy charsets, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that normalisation collapses.
WHITESPACE = "\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"

# Fixed values of the fold, by rule: (first, last, step, distance).
FOLD_RANGES = [
    (0x41, 0x5A, 1, 0x20),
    (0xC0, 0xD6, 1, 0x20),
    (0xD8, 0xDE, 1, 0x20),
    (0x100, 0x12E, 2, 1),
    (0x132, 0x136, 2, 1),
    (0x139, 0x147, 2, 1),
    (0x14A, 0x176, 2, 1),
    (0x179, 0x17D, 2, 1),
    (0x1DE, 0x1EE, 2, 1),
    (0x1F8, 0x21E, 2, 1),
    (0x222, 0x232, 2, 1),
    (0x391, 0x3A1, 1, 0x20),
    (0x3A3, 0x3AB, 1, 0x20),
    (0x400, 0x40F, 1, 0x50),
    (0x410, 0x42F, 1, 0x20),
    (0x460, 0x4FE, 2, 1),
    (0x500, 0x52E, 2, 1),
]
# Fixed values of the fold that follow no range.
FOLD_SINGLES = {"İ": "i", "Ÿ": "ÿ", "Ǳ": "ǳ", "ǲ": "ǳ", "Ά": "ά", "Έ": "έ", "Ή": "ή", "Ί": "ί", "Ό": "ό", "Ύ": "ύ", "Ώ": "ώ", "ς": "σ", "Ё": "е", "ё": "е", "ẞ": "ß"}


@lru_cache(maxsize=1)
def fold_pairs() -> tuple[str, str]:
    """(from, to) of the fold, for translate()."""
    table = {chr(c): chr(c + d) for first, last, step, d in FOLD_RANGES for c in range(first, last + 1, step)} | FOLD_SINGLES
    return "".join(table), "".join(table.values())


def fold(c: Column) -> Column:
    """Case fold of Latin, Greek and Cyrillic letters; sharp s becomes ss. Not lower(): that one keeps the final sigma and splits a dotted capital i."""
    return F.replace(F.translate(c, *fold_pairs()), F.lit("ß"), F.lit("ss"))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one blank; none stays at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WHITESPACE}]+", " "))


def normalize(c: Column) -> Column:
    """The key under which equal names meet. Null stays null."""
    return fold(collapse(c))


def normalize_bytes(c: Column) -> Column:
    """The key of a binary name: as normalize() for UTF-8, else a key that no valid text has."""
    return F.when(F.is_valid_utf8(c.cast("string")), normalize(c.cast("string"))).otherwise(F.concat(F.lit("\x00invalid:"), F.hex(c)))


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Latin letters with a mark, and the letters without."""
    table = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        form = unicodedata.normalize("NFD", chr(c))
        if len(form) > 1 and form[0].isascii():
            table[chr(c)] = form[0]
    return "".join(table), "".join(table.values())


# Fixed values of the tokeniser: marks that continue a word and leave no trace, in hex.
DROPPED_MARKS = "300-304 306-30C 30F 311 31B 323-328 32D-32E 330-331"
# Symbols and marks that Unicode took in after version 6.1; the tokeniser knows that version and takes all it doesn't know as letters.
LATER_SYMBOLS = (
    "58D-58E 605 61C-61D 7FD-7FF 888-8E3 8FF 9FD-9FE A76 AFA-AFF B55 C00 C04-C3C C77 C81 C84 CF3-D01 D3B-D3C D4F D81 EBA ECE 1715 180F-1886 "
    "1AB0-1ACE 1B7D-1B7E 1CF7-1CF9 1DE7-1DFB 2066-2069 20BA-20C0 218A-218B 23F4-23FF 2700 2B4D-2B4F 2B5A-2BFF 2E3C-2E5D 2FFC-2FFF 31EF 32FF "
    "A69E A82C A8C5 A8FC-A8FF A9E5 AA7C-AA7D AB5B-AB6B FBC2 FD40-FDCF FDFE-FDFF FE27-FE2F 1018C-1018E 1019C-101A0 102E0-1037A 1056F "
    "10877-10878 10AC8-10AF6 10B99-10F89 11070-1107F 110C2-110CD 11145-11175 111C9-1166C 116B9-11FFF 12474-16F4F 16F7F-16F87 16FE2-1CFC3 "
    "1D1DE-1D1EA 1D800-1ED2E 1F0BF 1F0E0-1F10F 1F12F 1F16C-1F16F 1F19B-1F1AD 1F23B 1F260-1F265 1F321-1F32F 1F336 1F37D-1F37F 1F394-1F39F "
    "1F3C5 1F3CB-1F3DF 1F3F1-1F3FF 1F43F 1F441 1F4F8 1F4FD-1F4FF 1F53E-1F53F 1F544-1F54F 1F568-1F5FA 1F641-1F644 1F650-1F67F 1F6C6-1F6FC "
    "1F774-1FBCA"
)
# Letters that Unicode took in after version 6.1, or whose other case it did; the tokeniser doesn't fold them.
LATER_LETTERS = (
    "37F 528 52A 52C 52E 13F8-13FD 1C80-1C88 1C90-1CBA 1CBD-1CBF 2C2F A698 A69A A796 A798 A79A A79C A79E A7AB-A7AE A7B0-A7B4 A7B6 A7B8 A7BA "
    "A7BC A7BE A7C0 A7C2 A7C4-A7C7 A7C9 A7D0 A7D6 A7D8 A7F5 AB70-ABBF 104B0-104D3 10570-1057A 1057C-1058A 1058C-10592 10594-10595 "
    "10C80-10CB2 118A0-118BF 16E40-16E5F 1E900-1E921"
)
# Letters of today that were none in that version, and two that are no characters.
EARLIER_SYMBOLS = "19B0-19C0 19C8-19C9 1CF2-1CF3 FFFE-FFFF"


def _points(ranges: str) -> set[int]:
    edges = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return {c for e in edges for c in range(e[0], e[-1] + 1)}


@lru_cache(maxsize=1)
def token_table() -> tuple[dict[str, str], str, str]:
    """(letters that change and what they become, separators, marks that are dropped) of SQLite's unicode61 tokeniser.

    A separator is what Unicode 6.1 has that is no letter, number or private-use character; what it doesn't have is a
    letter. Letters lose their case, and those that are an ASCII letter with one of the marks lose it.
    """
    dropped, symbols, plain, earlier = map(_points, (DROPPED_MARKS, LATER_SYMBOLS, LATER_LETTERS, EARLIER_SYMBOLS))
    folds, separators = {}, []
    for c in [*range(0xD800), *range(0xE000, 0x110000)]:
        x = chr(c)
        kind = unicodedata.category(x)
        if c in dropped or kind in ("Cn", "Co") and c not in earlier:
            continue
        if c in earlier or kind[0] not in "LN":
            if c in earlier or c not in symbols:
                separators.append(x)
                continue
        if c in plain:
            continue
        low = next((y for y in (x.casefold(), x.lower()) if len(y) == 1), x) if x != "İ" else "i"
        form = unicodedata.normalize("NFD", low)
        if len(form) == 2 and form[0].isascii() and form[0].isalpha() and ord(form[1]) in dropped:
            low = form[0]
        if low != x:
            folds[x] = low
    return folds, "".join(separators), "".join(map(chr, sorted(dropped)))


@lru_cache(maxsize=1)
def token_pairs() -> tuple[str, str]:
    """The fold of normalize() and the tokeniser's table after it, for one translate(): separators become blanks, dropped marks nothing."""
    folds, separators, dropped = token_table()
    then = folds | dict.fromkeys(separators, " ") | dict.fromkeys(dropped, "")
    table = {x: then.get(y, y) for x, y in zip(*fold_pairs(), strict=True)}
    table = then | table
    kept = {x: y for x, y in table.items() if y}
    return "".join(kept) + "".join(table.keys() - kept.keys()), "".join(kept.values())


def tokens(c: Column) -> Column:
    """Words of a text as SQLite's full-text index has them: the tokens of its unicode61 tokeniser in the normalised text."""
    return F.filter(F.split(F.replace(F.translate(c, *token_pairs()), F.lit("ß"), F.lit("ss")), " "), lambda x: x != "")


#: In code_points(): no character.
DROPPED = 0xFFFFFFFF


@lru_cache(maxsize=1)
def code_points(pairs: tuple[str, str]) -> np.ndarray:
    """What each code point becomes by pairs, as translate() has them; line feeds stay."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[list(map(ord, pairs[0]))] = [*map(ord, pairs[1]), *[DROPPED] * (len(pairs[0]) - len(pairs[1]))]
    table[ord("\n")] = ord("\n")
    return table


def arrow_tokens(texts: pa.Array | pa.ChunkedArray, pairs: tuple[str, str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, row of each token, its number among the distinct ones) of tokens() of a string array, in no order. pairs: token_pairs().

    What ASCII white space parts never is one token, so the texts are cut there and only distinct pieces are looked at
    character by character.
    """
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    rows, coded = pc.list_parent_indices(lists).to_numpy(), lists.flatten().dictionary_encode()
    if not len(rows):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    # a piece is a line; bytes that are no text become separators, as in a column
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), pa.scalar("\n", pa.large_string()))[0]
    found = code_points(pairs)[np.frombuffer(lines.as_buffer().to_pybytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    folded = found[found != DROPPED].astype("<u4").tobytes().decode("utf-32-le").replace("ß", "ss")
    split = pc.split_pattern(pc.split_pattern(pa.array([folded], pa.large_string()), "\n").flatten(), " ")
    words, piece = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(words, "")
    own = words.filter(real).dictionary_encode()
    number, piece = own.indices.to_numpy(), piece[real.to_numpy(zero_copy_only=False)]
    # the tokens of a piece lie together from first on; nearly all pieces have one
    count = np.bincount(piece, minlength=len(coded.dictionary))
    first, pieces = np.cumsum(count) - count, coded.indices.to_numpy()
    single = (count == 1)[pieces]
    rest = np.flatnonzero(~single)
    times = count[pieces[rest]]
    ends = np.cumsum(times)
    at = np.repeat(first[pieces[rest]] - (ends - times), times) + np.arange(times.sum())
    return own.dictionary.cast(pa.string()), np.concatenate([rows[single], np.repeat(rows[rest], times)]), number[np.concatenate([first[pieces[single]], at])]


def is_valid_utf8(c: Column) -> Column:
    return F.is_valid_utf8(c.cast("string"))


#: Hex of the first bytes of a character that has more, by their number.
_STARTS = {1: "C[2-9A-F]|D.|E.|F[0-4]", 2: "(E.|F[0-4])[89AB].", 3: "F[0-4]([89AB].){2}"}


def trim_incomplete_utf8(c: Column) -> Column:
    """A binary value without the first bytes of one character that is cut off at its end; null if that isn't what makes it invalid."""
    n = F.octet_length(c)
    whole = F.when(is_valid_utf8(c), c)
    cut = [(F.hex(F.substring(c, n - k + 1, F.lit(k))).rlike(f"^({start})$"), F.when(n >= k, F.substring(c, F.lit(1), n - k))) for k, start in _STARTS.items()]
    return F.coalesce(whole, *[F.when(starts & is_valid_utf8(rest), rest) for starts, rest in cut])


def latin(c: Column) -> Column:
    """A character for each byte, the one of its number. Bytes are looked at in this form, which every byte sequence has."""
    return F.decode(c, "ISO-8859-1")


def _body(c: Column, mark: str) -> Column:
    """A binary value without the mark, in hex, at its start."""
    size = len(mark) // 2
    return F.when(F.hex(F.substring(c, 1, size)) == mark, F.substring(c, F.lit(size + 1), F.octet_length(c))).otherwise(c)


def decode_utf16(c: Column, big_endian: bool) -> Column:
    """Text of UTF-16 bytes without the mark at its start. An odd number of bytes or half of a surrogate pair gives null, never an error."""
    body = _body(c, "FEFF" if big_endian else "FFFE")
    # a unit's upper byte alone tells what it is
    upper = F.regexp_replace(latin(body), "(?s)(.).", "$1") if big_endian else F.regexp_replace(latin(body), "(?s).(.)", "$1")
    alone = "[\\x{D8}-\\x{DB}](?![\\x{DC}-\\x{DF}])|(?<![\\x{D8}-\\x{DB}])[\\x{DC}-\\x{DF}]"
    sound = (F.octet_length(body) % 2 == 0) & ~upper.rlike(alone)
    return F.when(sound, F.decode(body, "UTF-16BE" if big_endian else "UTF-16LE"))


@lru_cache(maxsize=4)
def _upper_half(charset: str) -> str:
    """The characters of the bytes 0x80 to 0xFF of a single-byte charset; a byte that it lacks is U+FFFD."""
    return bytes(range(0x80, 0x100)).decode(charset, errors="replace")


def decode_single_byte(c: Column, charset: str) -> Column:
    """Text of bytes in a single-byte charset, by its table; no byte is an error and no setting of the session is needed."""
    return F.translate(latin(c), "".join(map(chr, range(0x80, 0x100))), _upper_half(charset))


# Fixed values of the score by which a decoding of Cyrillic text is judged.
CYRILLIC = "А-яЁё"
VOWELS = "АаЕеЁёИиОоУуЫыЭэЮюЯя"


def cyrillic_score(c: Column) -> Column:
    """How likely a decoding is Russian text: letters count for it, box drawing, control and replacement characters against.

    A word of three letters or more without a vowel costs 5; one of five or more with a fifth of vowels earns 2.
    """
    words = F.regexp_extract_all(c, F.lit(f"[{CYRILLIC}]{{3,}}"), 0)
    vowels = lambda w: F.length(F.regexp_replace(w, f"[^{VOWELS}]", ""))
    word = lambda w: F.when(vowels(w) == 0, F.lit(-5)).when((F.length(w) >= 5) & (vowels(w) * 5 >= F.length(w)), F.lit(2)).otherwise(F.lit(0))
    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    single = 4 * count(f"[{CYRILLIC}]") + count(f"[Ѐ-ԯ&&[^{CYRILLIC}]]") - 9 * count("[─-▟]") - 6 * count("[\\x{80}-\\x{9F}\\x{FFFD}]")
    return single + F.aggregate(words, F.lit(0), lambda a, w: a + word(w))


def decode_legacy(c: Column) -> Column:
    """Text of bytes in CP1251 or CP866: the better score wins; null if both differ and score alike. Byte 0x98, which CP1251 lacks, is U+FFFD in it."""
    windows, dos = decode_single_byte(c, "cp1251"), decode_single_byte(c, "cp866")
    a, b = cyrillic_score(dos), cyrillic_score(windows)
    return F.when(a > b, dos).when((a < b) | (dos == windows), windows)


#: Why bytes have no text.
ODD_UTF16, AMBIGUOUS = "utf16-broken", "charset-ambiguous"


def decode_segment(c: Column) -> Column:
    """struct<text, problem> of a catalogue segment: by its mark as UTF-8 or UTF-16, else as UTF-8, else in a Cyrillic charset. One of the two is null."""
    head = F.hex(F.substring(c, 1, 3))
    body = _body(c, "EFBBBF").cast("string")
    wide = head.startswith("FFFE") | head.startswith("FEFF")
    text = (
        F.when(head == "EFBBBF", F.when(F.is_valid_utf8(body), body).otherwise(F.make_valid_utf8(body)))
        .when(head.startswith("FFFE"), decode_utf16(c, False))
        .when(head.startswith("FEFF"), decode_utf16(c, True))
        .otherwise(F.coalesce(F.when(is_valid_utf8(c), c.cast("string")), decode_legacy(c)))
    )
    return F.struct(text.alias("text"), F.when(c.isNotNull() & text.isNull(), F.when(wide, ODD_UTF16).otherwise(AMBIGUOUS)).alias("problem"))


def decode_declared(c: Column) -> Column:
    """Text of an XML payload: a UTF-8 mark is taken off; then a UTF-16 mark, then a declared Cyrillic charset, then UTF-8, then UTF-8 cut at its end, then a guess.

    struct<text, warnings>; text is null where nothing fits. A cut, a guess, and a byte that CP1251 lacks are a warning
    each. Other declared names aren't believed: one of UTF-16 could be read as ASCII.
    """
    body = _body(c, "EFBBBF")
    head = F.hex(F.substring(body, 1, 2))
    name = F.lower(F.regexp_extract(latin(F.substring(body, 1, 512)), "encoding\\s*=\\s*[\"']([^\"']+)[\"']", 1))
    windows, dos, wide = name.isin("windows-1251", "cp1251"), name.isin("cp866", "ibm866"), head.isin("FFFE", "FEFF")
    utf8 = F.when(is_valid_utf8(body), body.cast("string"))
    text = (
        F.when(head == "FFFE", decode_utf16(body, False))
        .when(head == "FEFF", decode_utf16(body, True))
        .when(windows, decode_single_byte(body, "cp1251"))
        .when(dos, decode_single_byte(body, "cp866"))
        .otherwise(F.coalesce(utf8, trim_incomplete_utf8(body).cast("string"), decode_legacy(body)))
    )
    warned = F.when(wide | dos, F.lit(0)).when(windows, F.contains(latin(body), F.lit("\x98")).cast("int")).otherwise(utf8.isNull().cast("int"))
    return F.struct(text.alias("text"), F.coalesce(warned, F.lit(0)).alias("warnings"))


# --- the same in SQL, for the oracle -----------------------------------------------------------------------------


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_normalize(x: str) -> str:
    """normalize() in DuckDB; for texts whose only white space is ASCII."""
    a, b = fold_pairs()
    return f"replace(translate(trim(regexp_replace({x}, '[\\t-\\r ]+', ' ', 'g')), {sql_text(a)}, {sql_text(b)}), 'ß', 'ss')"


def sql_tokens(x: str) -> str:
    """tokens() in DuckDB."""
    a, b = _plain_letters()
    return f"list_filter(regexp_split_to_array(translate({sql_normalize(x)}, {sql_text(a)}, {sql_text(b)}), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda w: w <> '')"
