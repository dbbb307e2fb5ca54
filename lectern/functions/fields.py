"""Field rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize, trim_incomplete_utf8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ends_with_ascii(c: Column, suffix: str) -> Column:
    """Whether c ends with suffix, A-Z and a-z being equal."""
    return lower_ascii(c).endswith(suffix.translate(str.maketrans(UPPER, LOWER)))


def trim_ascii(c: Column) -> Column:
    """Without characters up to U+0020 at the ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_ascii(c), F.lit(""))


# Names and codes of languages, and the code each stands for.
LANGUAGE_ALIASES = {
    "": ["", "und"],
    "ru": ["ru", "rus", "russian", "русский", "ру"],
    "en": ["en", "eng", "english"],
    "uk": ["uk", "ukr", "ua", "ukrain", "ukrian", "urkain"],
    "bg": ["bg", "bul", "български"],
    "be": ["be", "bel"],
    "es": ["es", "spa", "sp"],
    "fr": ["fr", "fra", "fre"],
    "de": ["de", "deu", "ger"],
    "it": ["it", "ita"],
    "nl": ["nl", "nld", "dut"],
    "pl": ["pl", "pol"],
    "cs": ["cs", "ces", "cze", "cz"],
    "da": ["da", "dan"],
    "zh": ["zh", "zho", "chi", "chinese"],
    "ja": ["ja", "jpn", "jp"],
    "id": ["id", "ind", "in"],
    "kk": ["kk", "kaz", "kz"],
    "pt": ["pt", "por"],
    "ro": ["ro", "ron", "rum"],
    "tk": ["tk", "tuk", "turkmen"],
    "pa": ["pa", "pan", "pentjab"],
}
# Primary codes that a tag is cut down to although they have no alias.
PRIMARY_CODES = (
    "ab ang ar as az ba be bg ca cs cu cv da de el en eo es et eu fa fi fr frm ga gd he hi hr hu hy ia id is it ja ka kk la lt lv "
    "mn nl no pa pl pt ro ru sa sh sk sq sr sv tg tk tr tt uk uz vi zh"
).split()


def language_map() -> dict[str, str]:
    """Every name and code with the code that it stands for."""
    return {c: c for c in PRIMARY_CODES} | {name: code for code, names in LANGUAGE_ALIASES.items() for name in names}


def normalize_language(c: Column) -> Column:
    """Folded, first of a list, known names as codes, else the known code before a hyphen, else as it is."""
    first = F.split(F.translate(normalize(c), "_", "-"), "[,;/+]")[0]
    first = F.translate(normalize(first), "_", "-")
    known = F.create_map(*[F.lit(x) for pair in language_map().items() for x in pair])
    primary = F.when(first.contains("-"), F.substring_index(first, "-", 1))
    return F.coalesce(F.try_element_at(known, first), F.try_element_at(known, primary), first)


def normalize_isbn(c: Column) -> Column:
    """Digits and X of a valid ISBN-10 or ISBN-13, else null."""
    s = F.upper(F.regexp_replace(c, "[^0-9xX]", ""))
    digit = lambda i: F.when(F.substring(s, i + 1, 1) == "X", F.lit(10)).otherwise(F.substring(s, i + 1, 1).try_cast("int"))
    ten = sum((digit(i) * (10 - i) for i in range(10)), F.lit(0))
    thirteen = sum((digit(i) * (1 if i % 2 == 0 else 3) for i in range(13)), F.lit(0))
    return F.when(s.rlike("^[0-9]{9}[0-9X]$"), F.when(ten % 11 == 0, s)).when(s.rlike("^[0-9]{13}$"), F.when(thirteen % 10 == 0, s))


def genre_candidates(c: Column) -> list[Column]:
    """Forms of a genre code in the order in which they are looked up; null where a form doesn't apply."""
    space = r"[ \t\r\n\x0B\f]"
    trim = lambda x: F.regexp_replace(x, f"^{space}+|{space}+$", "")
    trimmed = trim(c)
    bounded = F.regexp_replace(trimmed, rf"^({space}*[/(])+{space}*|{space}*(\){space}*)+$", "")
    chosen = F.when(bounded == "", trimmed).otherwise(bounded)
    ascii_part = trim(F.regexp_extract(chosen, r"^([\x00-\x7F]+)[^\x00-\x7F]", 1))
    first_word = lambda x: F.nullif(F.regexp_extract(x, f"^([^ \\t\\r\\n\\x0B\\f]+){space}", 1), F.lit(""))
    return [c, trimmed, bounded, F.when(chosen.contains("-"), F.translate(chosen, "-", "_")), first_word(chosen), F.nullif(ascii_part, F.lit("")), first_word(ascii_part)]


def resolve_genre(c: Column, names: Column) -> Column:
    """struct<name, known>: the display name of a genre code. names: map of codes to display names. Blank gives ''; unknown stays as it is."""
    found = F.coalesce(*[F.try_element_at(names, x) for x in genre_candidates(c)])
    blank = genre_candidates(c)[1] == ""
    return F.struct(F.when(blank, F.lit("")).otherwise(F.coalesce(found, c)).alias("name"), (blank | found.isNotNull()).alias("known"))


def split_genres(xs: Column) -> Column:
    """Every element cut at commas, trimmed, blanks left out, order kept."""
    return F.filter(F.transform(F.flatten(F.transform(xs, lambda x: F.split(x, ","))), trim_ascii), lambda x: x != "")


def author_from_inpx(c: Column) -> Column:
    """struct<display, last, first, middle> of `Last,First,Middle`; display is first, middle, last. Null with over three parts."""
    parts = F.split(c, ",")
    part = lambda i: blank_to_null(F.get(parts, i))
    display = F.concat_ws(" ", part(1), part(2), part(0))
    return F.when(F.size(parts) <= 3, F.struct(display.alias("display"), part(0).alias("last"), part(1).alias("first"), part(2).alias("middle")))


#: Fixed value: the name of an author without a name.
ANONYMOUS = "Аноним"


def author_name(first: Column, middle: Column, last: Column, nickname: Column) -> Column:
    """First, middle and last name and nickname, those that aren't blank; null if all are."""
    return F.nullif(F.concat_ws(" ", *[blank_to_null(x) for x in (first, middle, last, nickname)]), F.lit(""))


def author_from_xml(first: Column, middle: Column, last: Column, nickname: Column) -> Column:
    """An author's name, or else the anonymous one."""
    return F.coalesce(author_name(first, middle, last, nickname), F.lit(ANONYMOUS))


def has_replacement(c: Column) -> Column:
    return c.contains("\ufffd")


def is_anonymous(authors: Column) -> Column:
    return (F.size(authors) == 1) & (authors[0] == ANONYMOUS)


def annotation_text(markup: Column) -> Column:
    """First text of each direct child of an annotation, trimmed, blanks left out, one a line. markup: what is inside of it.

    Tags are gone through in order with the depth they leave; a text counts where it is the first one right inside a child.
    """
    parts = F.regexp_extract_all(F.regexp_replace(markup, r"(?s)<!--.*?-->|<\?.*?\?>", ""), F.lit(r"(?s)<([^<>]*)>([^<]*)"), 0)
    tag = lambda x: F.regexp_extract(x, r"(?s)^<([^<>]*)>", 1)
    after = lambda x: trim_ascii(F.regexp_replace(x, r"(?s)^<[^<>]*>", ""))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("lines"))

    def step(state: Column, part: Column) -> Column:
        name = tag(part)
        depth = (state["depth"] + F.when(name.startswith("/"), -1).when(name.endswith("/"), 0).otherwise(1)).cast("int")
        waits = ((depth == 1) & (state["depth"] == 0)) | state["open"]
        found = (depth == 1) & waits & (after(part) != "")
        return F.struct(depth.alias("depth"), (waits & ~found).alias("open"), F.when(found, F.concat(state["lines"], F.array(after(part)))).otherwise(state["lines"]).alias("lines"))

    text = F.aggregate(parts, start, step, lambda s: F.array_join(s["lines"], "\n"))
    for mark, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{mark};"), F.lit(c))
    return text


def strict_int(c: Column, kind: str = "int") -> Column:
    """The whole text as an integer: digits with a minus at most, 32 bytes in all; else null."""
    return F.when(c.rlike("^-?[0-9]+$") & (F.octet_length(c) <= 32), c.try_cast(kind))


def strict_double(c: Column) -> Column:
    """The whole text as a number, without blanks, plus or names; else null."""
    return F.when(c.rlike(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"), c.try_cast("double"))


def strict_base64(c: Column) -> Column:
    """Bytes of canonical base64, white space aside; null if it isn't."""
    s = F.regexp_replace(c, r"[ \t\r\n\x0B\f]", "")
    body = "([A-Za-z0-9+/]{4})*"
    return F.when(s.rlike(f"^{body}([A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{{2}}[AEIMQUYcgkosw048]=)?$"), F.try_to_binary(s, F.lit("base64")))


def cover_extension(mime: Column, binary_id: Column) -> Column:
    """File extension by MIME type, exactly as it is written, else by what follows the id's last dot, unless that is its first character."""
    suffix = F.nullif(lower_ascii(F.regexp_extract(binary_id, r"(?s)^.+\.([^.]+)$", 1)), F.lit(""))
    return F.when(mime.isin("image/jpeg", "image/jpg"), "jpg").when(mime == "image/png", "png").when(mime == "image/gif", "gif").otherwise(suffix)


def archive_name(entry: Column) -> Column:
    """An entry's name without folders and `.inp`, with `.zip` if it hasn't."""
    base = F.regexp_replace(F.regexp_replace(entry, r"^.*[/\\]", ""), r"(?i)\.inp$", "")
    return F.when(ends_with_ascii(base, ".zip"), base).otherwise(F.concat(base, F.lit(".zip")))


def entry_name(file: Column, ext: Column) -> Column:
    return F.concat(file, F.lit("."), F.coalesce(F.nullif(lower_ascii(ext), F.lit("")), F.lit("fb2")))


def is_safe_path(c: Column) -> Column:
    """A relative path that stays below its root once `.` and `..` are worked out; a backslash is a character like others."""
    parts = F.split(c, "/")
    step = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    # a `..` with nothing before it stays, whatever follows
    low = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), lambda s, p: F.struct((s["depth"] + step(p)).alias("depth"), F.least(s["least"], s["depth"] + step(p)).alias("least")), lambda s: s["least"])
    return (c != "") & ~c.startswith("/") & (low >= 0)


def is_content_path(c: Column) -> Column:
    """`ab/abcd....ext`: two hex digits, then a 64-digit hash that starts with them."""
    return c.rlike(r"^([0-9a-f]{2})/\1[0-9a-f]{62}\.[^./]+$")


def fingerprint(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def normalize_fingerprint(c: Column) -> Column:
    return F.when(c.rlike("^sha256:[0-9a-fA-F]{64}$"), lower_ascii(c))


def parse_time(c: Column) -> Column:
    """`YYYY-MM-DDTHH:MM:SSZ` exactly, else null."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def format_time(c: Column) -> Column:
    return F.date_format(F.date_trunc("second", c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def safe_file_name(c: Column, most: int, fallback: str) -> Column:
    """Reserved and control characters as `_`, no blanks at the end, at most so many bytes, else the fallback."""
    tail = r"[ \t\r\n\x0B\f]+$"
    s = F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1F]', "_"), tail, "")
    cut = F.regexp_replace(F.decode(trim_incomplete_utf8(F.substring(s.cast("binary"), 1, most)), "UTF-8"), tail, "")
    return F.coalesce(F.nullif(F.when(F.octet_length(s) > most, cut).otherwise(s), F.lit("")), F.lit(fallback))


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0)).otherwise(F.least(F.lit(99), F.floor(done * 100 / total)).cast("int"))


def warning_message(archive: Column, entry: Column, message: Column) -> Column:
    return F.coalesce(F.concat(F.coalesce(entry, archive), F.lit(": "), message), message)


def warning_label(archive: Column, entry: Column) -> Column:
    return F.coalesce(F.concat(archive, F.lit("!"), entry), entry, archive, F.lit("<inpx>"))


def warning_text(archive: Column, entry: Column, message: Column) -> Column:
    where = F.concat_ws(" :: ", F.nullif(archive, F.lit("")), F.nullif(entry, F.lit("")))
    return F.when(where == "", message).otherwise(F.concat(where, F.lit(" — "), message))


def fit_size(width: Column, height: Column, boxes: tuple[tuple[int, int], ...] = ((456, 684), (400, 600))) -> Column:
    """struct<width, height> after fitting into each box in turn; a picture that fits stays as it is."""
    for w, h in boxes:
        scale = F.least(F.lit(float(w)) / width, F.lit(float(h)) / height)
        fits = (width <= w) & (height <= h)
        side = lambda x, fits=fits, scale=scale: F.when(fits, x).otherwise(F.greatest(F.lit(1), F.floor(x * scale + 0.5).cast("int")))
        width, height = side(width), side(height)
    return F.struct(width.alias("width"), height.alias("height"))
