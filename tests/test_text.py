import pytest
from pyspark.sql import functions as F

from lectern.functions import fields as X
from lectern.functions import text as T
from lectern.operators.lookup import resolve_aliases
from lectern.plans import ingest
from lectern.storage import cut


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "key"),
    [("  Ёлка\u00a0 и\u2003Ёж ", "елка и еж"), ("ΣΑΣ ς", "σασ σ"), ("İstanbul", "istanbul"), ("Straße ẞ", "strasse ss"), ("ÀÉ Ž Ǳ", "àé ž ǳ"), ("ІЇЄ", "ії\u0454"), (None, None), ("", "")],
)
def test_normalize(spark, raw, key):
    assert one(spark, T.normalize, raw) == key


def test_fold_follows_its_rules():
    a, b = T.fold_pairs()
    table = dict(zip(a, b, strict=True))
    assert len(a) == len(b) and table["Я"] == "я" and table["Ѐ"] == "ѐ" and table["Ā"] == "ā" and table["Ĺ"] == "ĺ" and "×" not in table


def test_tokens(spark):
    assert one(spark, T.tokens, "Lantern—Harbour, Ёж! café 12") == ["lantern", "harbour", "еж", "cafe", "12"]
    assert one(spark, T.tokens, "... — ;;") == []


def test_charsets(spark):
    text = "Фонарь над гаванью"
    assert one(spark, T.decode_legacy, text.encode("cp1251"), "binary") == text
    assert one(spark, T.decode_legacy, text.encode("cp866"), "binary") == text
    assert one(spark, lambda c: T.decode_utf16(c, False), b"\xff\xfe" + text.encode("utf-16-le"), "binary") == text
    assert one(spark, lambda c: T.decode_utf16(c, True), b"\x04", "binary") is None
    assert bytes(one(spark, T.trim_incomplete_utf8, "яб".encode()[:3], "binary")) == "я".encode()
    assert one(spark, T.is_valid_utf8, b"\xff", "binary") is False
    assert one(spark, T.normalize_bytes, b"\xff", "binary") == "\x00invalid:FF"


def test_segment_charsets(spark):
    """Marks, UTF-8, the likelier Cyrillic charset, bytes that CP1251 lacks, and bytes that have no text."""
    text = "Школа книги"
    cases = {
        "utf8": (text.encode(), text, None),
        "utf8 with its mark": (b"\xef\xbb\xbf" + text.encode(), text, None),
        "mark and a broken end": (b"\xef\xbb\xbfab\xff", "ab\ufffd", None),
        "cp866 with 0x98": (text.encode("cp866"), text, None),
        "cp1251": (text.encode("cp1251"), text, None),
        "cp1251 with 0x98": ("Большая книга ".encode("cp1251") + b"\x98", "Большая книга \ufffd", None),
        "utf16 le": (b"\xff\xfe" + (text + "😀").encode("utf-16-le"), text + "😀", None),
        "utf16 be": (b"\xfe\xff" + (text + "😀").encode("utf-16-be"), text + "😀", None),
        "odd": (b"\xff\xfea", None, "utf16-broken"),
        "half a pair": (b"\xff\xfe" + b"a\0\x3d\xd8b\0", None, "utf16-broken"),
        "other half": (b"\xfe\xff" + b"\xde\0\0a", None, "utf16-broken"),
        "pairs without a gap": (b"\xfe\xff" + "😀😀a".encode("utf-16-be"), "😀😀a", None),
        "tie": (b"\xe0", None, "charset-ambiguous"),
        "empty": (b"", "", None),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, c binary").select("name", T.decode_segment(F.col("c")).alias("d")).collect()
    assert {r.name: (r.d.text, r.d.problem) for r in rows} == {k: v[1:] for k, v in cases.items()}
    every = bytes(range(256))
    assert one(spark, lambda c: T.decode_single_byte(c, "cp866"), every, "binary") == every.decode("cp866")
    assert one(spark, lambda c: T.decode_single_byte(c, "cp1251"), every, "binary") == every.decode("cp1251", errors="replace")


def test_declared_charsets(spark):
    text = "<?xml version='1.0' encoding='{}'?>Шар"
    own = lambda name, raw, lead=b"": lead + text.format(name).encode(raw)
    cases = [
        (own("windows-1251", "cp1251"), 0), (own("CP866", "cp866"), 0), (own("windows-1251", "cp1251") + b"\x98", 1), (own("utf-8", "utf-8", b"\xef\xbb\xbf"), 0), (own("windows-1251", "cp1251", b"\xef\xbb\xbf"), 0),
        (own("utf-8", "utf-8") + "я".encode()[:1], 1), (own("utf-8", "cp1251"), 1), (own("koi8-r", "cp866"), 1), (own("utf-16", "utf-8"), 0), (own("utf-16", "utf-16-be", b"\xfe\xff"), 0),
    ]
    for raw, warnings in cases:
        d = one(spark, T.decode_declared, raw, "binary")
        assert d.text.rstrip("\ufffd").endswith("Шар") and d.warnings == warnings, raw


def test_tokens_equal_full_text_index(spark):
    """Over all code points, alone and inside of words, the tokens are those of SQLite's index over the normalised text."""
    sqlite3 = pytest.importorskip("sqlite3")
    index = sqlite3.connect(":memory:")
    try:
        index.execute("create virtual table f using fts5(x, tokenize = 'unicode61', content = '', columnsize = 0)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index")
    index.execute("create virtual table v using fts5vocab(f, 'instance')")
    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x110000)]]
    # sixteen to a row: between letters, at the start and end of a word, and alone
    rows = [(i, " ".join(f"q{x}z x{x} {x}w {x}" for x in points[i : i + 16])) for i in range(0, len(points), 16)]
    rows += [(-1, "cafe\u0301x"), (-2, "\u0301abc d\u0301"), (-3, "ǈ Ⅷ Ɐ Ё ß ẞ İ ς")]
    df = spark.createDataFrame(rows, "i int, x string").repartition(8)
    found = df.select("i", T.normalize(F.col("x")).alias("n"), T.tokens(F.col("x")).alias("t")).collect()
    index.executemany("insert into f(rowid, x) values (?, ?)", [(r.i, r.n) for r in found])
    theirs = {}
    for term, doc, place in index.execute("select term, doc, offset from v"):
        theirs.setdefault(doc, {})[place] = term
    for r in found:
        assert r.t == [w for _, w in sorted(theirs.get(r.i, {}).items())], r.n
    assert one(spark, T.tokens, "a\0b") == ["a", "b"]


@pytest.mark.parametrize(("raw", "code"), [("ru-RU", "ru"), ("EN_us", "en"), (" Русский ", "ru"), ("ukr, rus", "uk"), ("und", ""), ("", ""), ("xx-yy", "xx-yy"), ("sr-Latn", "sr"), ("klingon", "klingon")])
def test_language(spark, raw, code):
    assert one(spark, X.normalize_language, raw) == code


@pytest.mark.parametrize(("raw", "isbn"), [("0-306-40615-2", "0306406152"), ("978-3-16-148410-0", "9783161484100"), ("978-3-16-148410-1", None), ("0-8044-2957-x", "080442957X"), ("12", None), (None, None)])
def test_isbn(spark, raw, isbn):
    assert one(spark, X.normalize_isbn, raw) == isbn


@pytest.mark.parametrize(
    ("raw", "name", "known"),
    [("gn", "Gnomes", True), (" gn ", "Gnomes", True), ("(gn)", "Gnomes", True), ("/gn", "Gnomes", True), ("sea-lore", "Sea lore", True), ("gn Моря", "Gnomes", True), ("gnЩ", "Gnomes", True), ("nix", "nix", False), ("  ", "", True)],
)
def test_genre(spark, raw, name, known):
    names = F.create_map(*[F.lit(x) for x in ("gn", "Gnomes", "sea_lore", "Sea lore")])
    r = one(spark, lambda c: X.resolve_genre(c, names), raw)
    assert (r.name, r.known) == (name, known)


def test_genres_by_a_table_equal_those_by_a_map(spark):
    """Every code with noise around it, one of them in half of all rows, blanks, nulls, unknown codes and an alias that occurs twice."""
    noise = ["{}", " {} ", "({})", "/{}", "{} Моря", "{}Щ", "-{}", "{}("]
    codes = [n.format(c) for n in noise for c in ("gn", "sea_lore", "sea-lore", "nix", "")] + [None, "Ж"]
    lists = [[c, "gn"] for c in codes for _ in range(3)] + [[], None]
    books = spark.createDataFrame([(k, 1, k, x) for k, x in enumerate(lists)], "book_id long, segment_order long, line_no int, genres array<string>")
    table = spark.createDataFrame([("gn", "Gnomes", 1), ("gn", "Zed", 2), ("sea_lore", "Sea lore", 3)], "alias string, name string, n int")
    names = F.create_map(*[F.lit(x) for x in ("gn", "Gnomes", "sea_lore", "Sea lore")])
    found = cut(resolve_aliases(books.select(F.explode("genres").alias("code")), "code", X.genre_candidates(F.col("code")), ingest.genre_table(spark, table)), "codes")
    got = ingest.named_genres(books, found)
    plain = books.select("book_id", F.posexplode("genres").alias("pos", "code")).select("book_id", "pos", X.resolve_genre(F.col("code"), names).alias("g"))
    expected = {(r.book_id, r.pos): (r.g.name, r.g.known) for r in plain.collect() if lists[r.book_id][r.pos] is not None}
    rows = got.collect()
    assert {(r.book_id, r.pos): (r.name, r.known) for r in rows if lists[r.book_id][r.pos] is not None} == expected
    assert len(rows) == sum(len(x or []) for x in lists) and all(r.name is None for r in rows if lists[r.book_id][r.pos] is None)
    assert "map(" not in got._jdf.queryExecution().optimizedPlan().toString() and found.filter("code = 'gn'").first().n > len(codes) * 3
    nothing = cut(resolve_aliases(books.limit(0).select(F.explode("genres").alias("code")), "code", X.genre_candidates(F.col("code")), ingest.genre_table(spark, None)), "codes")
    assert ingest.named_genres(books.limit(0), nothing).count() == 0


def test_fields(spark):
    assert one(spark, X.strict_int, "+7") is None and one(spark, X.strict_int, "-7") == -7
    assert one(spark, X.strict_double, "1.5") == 1.5 and one(spark, X.strict_double, " 1.5") is None
    assert bytes(one(spark, X.strict_base64, "aGVs\nbG8=")) == b"hello" and one(spark, X.strict_base64, "aGVsbG9=") is None and one(spark, X.strict_base64, "aGV") is None
    for path, safe in (("a/../b", True), ("a/b.zip", True), ("../b", False), ("a/../../b", False), ("/a", False), ("", False), ("./a", True), ("a\\..\\b", True), ("..", False)):
        assert one(spark, X.is_safe_path, path) is safe, path
    assert one(spark, X.strict_int, "0" * 31 + "7") == 7 and one(spark, X.strict_int, "0" * 32 + "7") is None
    assert one(spark, X.is_content_path, "ab/ab" + "0" * 62 + ".jpg") is True and one(spark, X.is_content_path, "ab/cd" + "0" * 62 + ".jpg") is False
    assert one(spark, lambda c: X.safe_file_name(c, 5, "book"), "яяя ?") == "яя" and one(spark, lambda c: X.safe_file_name(c, 5, "book"), "   ") == "book"
    assert one(spark, X.parse_time, "2024-02-30T00:00:00Z") is None and one(spark, X.normalize_fingerprint, "sha256:" + "A" * 64) == "sha256:" + "a" * 64
    assert one(spark, lambda c: X.author_from_xml(c, c, c, F.lit("nick")), " ") == "nick" and one(spark, lambda c: X.author_from_xml(c, c, c, c), "") == X.ANONYMOUS
    assert one(spark, lambda c: X.author_from_xml(c, F.lit(None), F.lit("Last"), F.lit("nick")), "First") == "First Last nick"
    for mime, name, ext in (("other", "x.PNG", "png"), ("image/jpeg", "x.png", "jpg"), ("IMAGE/PNG", "x", None), ("image/webp", ".png", None), ("image/webp", "a.b.webp", "webp"), ("image/gif", "a", "gif")):
        assert one(spark, lambda c, name=name: X.cover_extension(c, F.lit(name)), mime) == ext
    for markup, text in (("<p> One <b>two</b> three</p><p></p><p><i>x</i> Four</p>", "One\nFour"), ("plain <p>a</p>", "a"), ("<p><q>deep</q></p>", ""), ("<br/><p>a &amp; b<br/>c</p>", "a & b")):
        assert one(spark, X.annotation_text, markup) == text
