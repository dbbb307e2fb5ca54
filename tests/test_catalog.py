"""A small invented library from end to end: segments, payloads, scans, search, stream, export."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import quality
from lectern.operators.quality import Rejected
from lectern.operators.search import CatalogQuery, Cursor, StaleCursor
from lectern.plans import ingest
from lectern.plans import snapshot as store
from lectern.plans.catalog import Catalog, export
from lectern.sources import archives, fb2, inpx
from lectern.streaming.rescan import watch

GENRES = {"tale": "Tales", "sea_lore": "Sea lore"}


def line(lib_id, title, author="Ferris,Nadia,", lang="en", size=0, deleted="0", file=None, ext="fb2"):
    return "\u0004".join([author, "tale:sea", title, "", "", file or f"b{lib_id}", str(size), str(lib_id), deleted, ext, "2024-01-01", lang, "", "", ""])


def payload(title, first="Nadia", last="Ferris", lang="en", genre="tale", extra="", tail=""):
    return f"""<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="urn:x-books" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info>
<genre>{genre}, sea-lore</genre><author><first-name>{first}</first-name><last-name>{last}</last-name></author><book-title>{title}</book-title><lang>{lang}</lang>{extra}</title-info>
<document-info><id>doc-{title}</id></document-info><publish-info><publisher>Quay</publisher><year>1972</year><isbn>0-306-40615-2</isbn></publish-info></description><body><p>broken{tail}""".encode()


def archive(folder, name, books, stamp=None):
    with zipfile.ZipFile(f"{folder}/{name}.zip", "w") as z:
        for lib_id, content in books.items():
            z.writestr(zipfile.ZipInfo(f"b{lib_id}.fb2", (2024, 1, 1, 0, 0, 0)), content)
    if stamp:
        os.utime(f"{folder}/{name}.zip", (stamp, stamp))


def source(folder, name, segments):
    inpx.write_inpx(f"{folder}/{name}.inpx", {f"{k}.inp": "\r\n".join(v).encode() for k, v in segments.items()})
    return f"{folder}/{name}.inpx"


@pytest.fixture
def drop(folder):
    folder = f"{folder}/drop"
    os.mkdir(folder)
    return folder


@pytest.fixture
def catalogue(drop):
    archive(drop, "a", {1: payload("Фонарь над гаванью", "Вера", "Полынина", "rus"), 2: payload("Lantern Harbour")})
    archive(drop, "b", {3: payload("A Map of Salt", lang="")})
    return drop, source(drop, "one", {"a": [line(1, "Фонарь", lang="ru"), line(2, "Lantern")], "b": [line(3, "Salt", lang="en"), line(9, "Gone", deleted="1")]})


class Scans:
    """Scans of one folder, numbered."""

    def __init__(self, spark, folder, mode="failfast"):
        self.spark, self.folder, self.root, self.mode, self.n = spark, folder, f"{folder}/root", mode, 0

    def run(self, segments, mode=None):
        self.n += 1
        path = source(self.folder, "library", segments)
        counters = ingest.scan(self.spark, path, self.folder, self.root, f"s{self.n}", F.lit(f"2024-{self.n:02d}-01").cast("timestamp"), mode or self.mode, GENRES)
        return counters.first()

    @property
    def catalog(self):
        return Catalog(self.spark, self.root)

    def states(self):
        return {r.lib_id: r.availability for r in self.catalog.availability().collect()}

    def rows(self):
        return {r.lib_id: (r.book_id, r.added_at.month) for r in self.catalog.books().collect()}


def test_first_scan_search_and_pages(spark, catalogue):
    folder, path = catalogue
    ingest.initial(spark, path, folder, f"{folder}/root", "s1", F.lit("2024-05-01").cast("timestamp"), genres=GENRES)
    c = Catalog(spark, f"{folder}/root")
    assert c.snapshot == "s1"
    titles = lambda **k: [r.title for r in c.search(CatalogQuery(**k)).orderBy("pos").collect()]
    assert titles() == ["A Map of Salt", "Lantern Harbour", "Фонарь над гаванью"]
    assert titles(text="фона") == ["Фонарь над гаванью"]
    assert titles(text="Ferris", fields=("title",)) == []
    assert titles(text="Ferris", fields=("authors",)) == ["A Map of Salt", "Lantern Harbour"]
    assert titles(text="Harbour—Lant") == ["Lantern Harbour"] and titles(text="lantern fer") == ["Lantern Harbour"]
    assert titles(text="... — %%") == []
    assert titles(languages=("ru",)) == ["Фонарь над гаванью"]
    assert titles(genres=("TALES",), sort="author", ascending=False)[0] == "Фонарь над гаванью"
    assert titles(sort="added", limit=1, offset=1) == ["Lantern Harbour"]
    q = CatalogQuery(languages=("ru",))
    assert [(r.language, r.n) for r in c.facet_languages(q).orderBy("pos").collect()] == [("en", 2), ("ru", 1)]
    assert [(r.genre, r.n) for r in c.facet_genres(q).orderBy("pos").collect()] == [("Sea lore", 1), ("Tales", 1)]
    q = CatalogQuery(limit=2)
    first = c.page(q, genres=False)
    second = c.page(q, first.cursor)
    assert [r.title for r in first.rows.collect()] + [r.title for r in second.rows.collect()] == titles()
    assert first.total == 3 and first.genres is None and first.languages.count() == 2
    assert second.cursor is None and second.total is None and second.languages is None
    with pytest.raises(StaleCursor):
        c.page(q, Cursor("s0", q.fingerprint(), 2))
    with pytest.raises(StaleCursor):
        c.page(CatalogQuery(text="x"), first.cursor)
    stats = c.statistics().first()
    assert (stats.books, stats.unavailable) == (3, 0) and stats.source_bytes > 1000
    assert c.count(CatalogQuery(text="lant")) == 1
    book = c.details(1).first()
    assert (book.isbn, book.year, book.publisher, book.authors, book.genres) == ("0306406152", 1972, "Quay", ["Вера Полынина"], ["Tales", "Sea lore"])
    assert (book.label, book.is_available) == ("Available", True)
    row = c.source_overview().first()
    assert (row.total, row.available) == (3, 3)


def test_export_guards(spark, catalogue):
    folder, path = catalogue
    ingest.initial(spark, path, folder, f"{folder}/root", "s1", F.lit("2024-05-01").cast("timestamp"))
    c = Catalog(spark, f"{folder}/root")
    ids = spark.createDataFrame([("1",), ("3",), ("none",)], "lib_id string")
    out = {r.lib_id: r for r in export(c, ids, path, folder).collect()}
    assert set(out) == {"1", "3"} and out["1"].export_status == out["3"].export_status == "ready" and bytes(out["1"].content).startswith(b"<?xml")
    archive(folder, "b", {3: payload("Another", lang="")})
    out = {r.lib_id: (r.export_status, r.content is None) for r in export(c, ids, path, folder).collect()}
    assert out == {"1": ("ready", False), "3": ("archive-changed", True)}
    source(folder, "one", {"a": [line(1, "x")]})
    assert {r.export_status for r in export(c, ids, path, folder).collect()} == {"source-changed"}


def test_rescans(spark, drop):
    """Several books go through the cases side by side: a removed segment (3), a tombstone in a new later segment (4), segments that change places (5), a record left out (2), an upgrade by an archive of two (6, 7)."""
    scans = Scans(spark, drop)
    archive(drop, "a", {1: payload("One"), 2: payload("Two")}, 1_700_000_000)
    for name, k in (("b", 3), ("c", 4), ("o", 5)):
        archive(drop, name, {k: payload(f"Book {k}")}, 1_700_000_000)
    live, dead = {"o": [line(5, "5")]}, {"d": [line(5, "5", deleted="1")]}
    first = {"a": [line(1, "1"), line(2, "2")], "b": [line(3, "3")], "c": [line(4, "4")]} | live | dead
    r = scans.run(first)
    assert (r.segments_total, r.segments_added, r.records_parsed, r.records_added, r.archives_opened) == (5, 5, 5, 5, 4)
    on, off = "available", "missing_from_index"
    assert scans.states() == {"1": on, "2": on, "3": on, "4": on, "5": off}
    assert {x.segment_id: x.requires_archive for x in scans.catalog.table("segments").collect()} == {"a.inp": True, "b.inp": True, "c.inp": True, "o.inp": True, "d.inp": False}
    before = scans.rows()

    archive(drop, "e", {6: payload("Added Six"), 7: payload("Added Seven")})
    archive(drop, "c", {4: payload("Book 4")}, 1_700_000_900)  # another time, the same entries: not parsed again
    second = {"a": [line(1, "1")], "c": [line(4, "4")], "x": [line(4, "4", deleted="1")]} | dead | live | {"e": [line(6, "6"), line(7, "7")]}
    r = scans.run(second)
    assert (r.segments_added, r.segments_changed, r.segments_unchanged, r.segments_removed) == (2, 1, 3, 1)
    assert (r.records_parsed, r.records_added, r.records_updated, r.records_reused) == (3, 2, 1, 3)
    assert (r.archives_opened, r.archives_skipped, r.marked_unavailable, r.restored) == (3, 2, 3, 1)
    assert scans.states() == {"1": on, "2": off, "3": off, "4": off, "5": on, "6": on, "7": on}
    assert {k: v for k, v in scans.rows().items() if k < "6"} == before
    c = scans.catalog
    assert {x.lib_id: x.present_in_segment for x in c.table("locations").collect()} == {"1": True, "2": False, "3": True, "4": True, "5": True, "6": True, "7": True}
    assert (c.statistics().first().books, c.statistics().first().unavailable) == (7, 3) and c.table("deletions").count() == 2
    assert c.count(CatalogQuery(text="added")) == 2 and c.count(CatalogQuery(text="two")) == 1
    assert {x.title: x.label for x in c.search(CatalogQuery(text="book")).collect()} == {"Book 3": "Missing from index", "Book 4": "Missing from index", "Book 5": "Available"}

    r = scans.run(first)  # everything as it was
    assert (r.segments_changed, r.segments_unchanged, r.segments_removed, r.records_parsed, r.records_updated) == (2, 3, 2, 3, 3)
    assert scans.states() == {"1": on, "2": on, "3": on, "4": on, "5": off, "6": off, "7": off}
    assert {k: v for k, v in scans.rows().items() if k < "6"} == before and (r.marked_unavailable, r.restored) == (3, 3)

    archive(drop, "a", {1: payload("One"), 2: payload("Two and more")})
    r = scans.run(first)
    assert (r.segments_changed, r.segments_unchanged, r.segments_removed, r.records_parsed, r.records_updated, r.archives_opened) == (1, 4, 0, 2, 2, 1)
    assert [x.title for x in scans.catalog.search(CatalogQuery(text="more")).collect()] == ["Two and more"]
    assert scans.catalog.table("scans").count() == 4


def test_refused_snapshots_leave_the_old_one(spark, drop):
    scans = Scans(spark, drop)
    archive(drop, "a", {1: payload("One"), 2: payload("Two")})
    archive(drop, "b", {1: payload("One")})
    size = len(payload("One"))
    scans.run({"a": [line(1, "1", size=size), line(2, "2")]})
    refused = [
        {"a": [line(1, "1", size=size), line(2, "2")], "b": [line(1, "1")]},  # one id active in two segments
        {"a": [line(1, "1", size=size + 1)]},  # another size than declared
        {"a": ["too few fields"]},
        {"none": [line(7, "7")]},  # no such archive
        {},
    ]
    for segments in refused:
        with pytest.raises(Rejected):
            scans.run(segments)
    assert store.current(spark, scans.root) == "s1" and scans.states() == {"1": "available", "2": "available"}


def test_duplicate_entry_names_are_refused(spark, drop):
    with zipfile.ZipFile(f"{drop}/a.zip", "w") as z, pytest.warns(UserWarning):
        z.writestr("b1.fb2", payload("One"))
        z.writestr("b1.fb2", payload("Two"))
    with pytest.raises(Rejected, match="more than once"):
        Scans(spark, drop).run({"a": [line(1, "1")]})


def test_fallbacks_covers_and_warnings(spark, drop):
    scans = Scans(spark, drop, "permissive")
    art = '<coverpage><image l:href="#c.png"/></coverpage>'
    body = '</p></body><binary id="c.png" content-type="image/png">aGVsbG8=</binary></FictionBook>'
    archive(drop, "a", {1: payload("\ufffd?", lang="", extra=art, tail=body), 2: payload(" ", extra=art, tail=body), 3: b"<x/>", 4: payload("Four", extra=art)})
    lines = [line(1, "First title"), line(2, "Second title"), line(3, "3"), line(4, "4"), line(5, "5", ext="pdf"), "bad"]
    r = scans.run({"a": lines})
    # replacement characters are a fallback; a missing title is a parser's warning, as are genres without a name
    assert (r.records_parsed, r.records_skipped, r.title_fallbacks, r.language_fallbacks, r.books_with_fallback) == (3, 1, 1, 1, 1)
    assert r.parser_warnings == 1
    c = scans.catalog
    assert {x.title for x in c.books().collect()} == {"First title", "Second title", "Four"}
    cover = c.table("covers").first()
    assert (cover.reference_count, cover.size_bytes) == (2, 5) and bytes(c.table("cover_contents").first().content) == b"hello"
    found = {(x.warning_code, x.entry_name) for x in c.warnings().collect()}
    assert found == {("record-rejected", None), ("unsupported-format", "b5.pdf"), ("payload-rejected", "b3.fb2"), ("cover", "b4.fb2")}


def test_warnings_are_capped_and_retained(spark, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_WARNINGS", 3)
    none = "segment_id string, line_no int, archive_name string"
    parsed = spark.createDataFrame([("a", k, "a.zip", "bad" if k % 2 else None, None, ["bad"] if k % 2 else [], None) for k in range(20)], none + ", reject_reason string, record struct<entry_name:string,deleted:boolean,ext:string>, warnings array<string>, x string")
    refused = spark.createDataFrame([], none + ", entry string, payload_reject string")
    placed = spark.createDataFrame([], none + ", entry_name string, cover_diagnostic string")
    log = spark.createDataFrame([], ingest.SCHEMAS["scan_warnings"])
    for n in range(1, 13):
        rows = ingest._warnings(log, parsed, refused, placed, f"s{n}", n).collect()
        log = spark.createDataFrame(rows, ingest.SCHEMAS["scan_warnings"])
    assert {r.scan_id for r in rows} == {f"s{n}" for n in range(3, 13)} and len(rows) == 30
    assert sorted(r.id for r in rows)[:3] == [10, 11, 12] and rows[0].message == "a.zip: bad"


def test_stream_publishes_each_source_once(spark, catalogue, folder):
    drop, _ = catalogue
    for _ in range(2):
        watch(spark, drop, drop, f"{folder}/root", f"{folder}/checkpoint").awaitTermination()
    c = Catalog(spark, f"{folder}/root")
    assert c.count(CatalogQuery()) == 3 and c.table("scans").count() == 1


def test_schema_differences(spark):
    schema = lambda ddl: spark.createDataFrame([], ddl).schema
    found = quality.schema_differences(spark, schema("a int, b string, d long"), schema("a long, b string not null, c int"))
    assert {tuple(r) for r in found.collect()} == {("a", "type"), ("b", "nullability"), ("c", "missing"), ("d", "unexpected")}
    assert quality.schema_differences(spark, schema("a int"), schema("a int")).isEmpty()


def test_roots_and_folders(spark):
    listing = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("z", "c")], "candidate string, archive string")
    candidates = spark.createDataFrame([("x", 2), ("y", 1), ("z", 0)], "candidate string, ord int")
    sample = spark.createDataFrame([("a",), ("b",), ("q",)], "archive string")
    assert tuple(archives.best_root(sample, candidates, listing).first()) == ("y", 2)
    names = spark.createDataFrame([("c", 5), ("a", 7), ("b", 6), ("a", 1), ("d", 9)], "archive string, o int")
    assert [tuple(r) for r in archives.first_names(names, "o", 3).orderBy("pos").collect()] == [("a", 1), ("c", 2), ("b", 3)]
    folders = spark.createDataFrame([("", "a"), ("z", "a"), ("y", "b"), ("x", "b")], "folder string, archive string")
    assert {tuple(r) for r in archives.resolve_archives(sample, folders).collect()} == {("a", ""), ("b", "x"), ("q", None)}


def test_bounds_of_sources_and_archives(spark, drop):
    path = source(drop, "big", {"a": [line(1, "1")], "b": [line(2, "2")]})
    spark.dataSource.register(inpx.InpxSource)
    assert spark.read.format("inpx").option("entries", '["b.inp"]').load(path).first().inp_entry_name == "b.inp"
    for option in ("maxEntryBytes", "maxSourceBytes"):
        with pytest.raises(Exception, match="bytes"):
            spark.read.format("inpx").option(option, 20).load(path).count()
    archive(drop, "a", {1: b"x" * 1000, 2: b""})
    spark.dataSource.register(archives.ZipManifest)
    for option in ("maxEntries", "maxBytes"):
        with pytest.raises(Exception, match="has over"):
            spark.read.format("zip_manifest").option(option, 1).load(f"{drop}/a.zip").count()


def test_malformed_lines_give_a_reason(spark, folder):
    good = line(1, "ok")
    parts = good.split("\u0004")

    def with_field(i, value):
        return "\u0004".join([*parts[:i], value, *parts[i + 1 :]])

    bad = ["a\u0004b", with_field(5, " "), with_field(6, "1x"), with_field(8, "no"), with_field(9, "e" * 33), with_field(0, ":" * 256), with_field(0, "a,b,c,d"), with_field(1, ":" * 512), with_field(13, ":" * 512)]
    path = source(folder, "bad", {"s": [good, "", *bad, with_field(4, "x"), with_field(2, " "), with_field(4, "0" * 33), with_field(6, "0" * 32), with_field(6, "0" * 33)]})
    rows = inpx.parse_all(spark, path).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [1, *range(3, 17)]
    assert [r.reject_reason is None for r in rows] == [True, *[False] * 9, True, True, True, True, False]
    assert len({r.reject_reason for r in rows[1:10]}) == 9
    assert rows[10].warnings == ["series-number-ignored"] and rows[10].record.series_no is None
    assert rows[11].record.title == "b1" and rows[0].record.authors[0].display == "Nadia Ferris"
    total = inpx.summary(inpx.parse_all(spark, path)).first()
    assert (total.records, total.skipped) == (15, 10)


def test_manifest_and_damage(spark, folder):
    archive(folder, "a", {1: b"x" * 1000, 2: b""})
    rows = {r.name: r for r in archives.manifests(spark, [f"{folder}/a.zip"], validate=True).collect()}
    assert rows["b1.fb2"].size == 1000 and rows["b1.fb2"].payload_bytes == 1000 and all(r.payload_ok for r in rows.values())
    assert archives.file_states(spark, folder).count() == 1
    raw = bytearray(open(f"{folder}/a.zip", "rb").read())
    raw[raw.index(b"xxxx")] ^= 1  # a stored payload is damaged
    with open(f"{folder}/a.zip", "wb") as f:
        f.write(raw)
    assert {r.name: r.payload_ok for r in archives.manifests(spark, [f"{folder}/a.zip"], validate=True).collect()} == {"b1.fb2": False, "b2.fb2": True}
    with pytest.raises(Exception, match="has no entry"):
        archives.payloads(spark.createDataFrame([(f"{folder}/a.zip", "none")], "archive string, entry string")).collect()


def test_payload_cases(spark):
    cover = "<coverpage><image l:href=\"#c.png\"/></coverpage><sequence name=\"Tides\" number=\"1.5\"/><annotation><p> One </p><p></p><p>Two</p></annotation>"
    whole = payload("T", extra=cover) + b'</p></body><binary id="c.png" content-type="image/png">aGVsbG8=</binary></FictionBook>'
    cases = [("whole", whole), ("cp1251", payload("Тест").decode().replace("utf-8", "windows-1251").encode("cp1251")), ("utf16", b"\xff\xfe" + payload("Wide").decode().encode("utf-16-le")), ("none", b"<x/>"), ("untitled", payload(" ")), ("prefixed", payload("P").replace(b"<", b"<f:").replace(b"<f:/", b"</f:").replace(b"<f:?", b"<?")), ("cut", payload("Cut") + "я".encode()[:1])]
    one = b"<author><first-name>Nadia</first-name><last-name>Ferris</last-name></author>"
    blank = b"<author><first-name> </first-name><last-name/></author>"
    cases += [("nobody", payload("N").replace(one, b"")), ("blank", payload("N").replace(one, blank * 2)), ("some", payload("N").replace(one, blank + one))]
    rows = {r.name: r for r in fb2.covers(fb2.parse(spark.createDataFrame(cases, "name string, content binary"))).collect()}
    b = rows["whole"].book
    assert (b.title, b.series, b.series_index, b.description, b.genres, b.authors) == ("T", "Tides", 1.5, "One\nTwo", ["tale", "sea-lore"], ["Nadia Ferris"])
    assert bytes(rows["whole"].cover) == b"hello" and rows["whole"].cover_ext == "png" and rows["whole"].cover_diagnostic is None
    assert rows["cp1251"].book.title == "Тест" and rows["utf16"].book.title == "Wide" and rows["prefixed"].book.title == "P"
    assert rows["cut"].book.title == "Cut" and rows["cut"].book.warning_count == 1
    assert rows["nobody"].book.authors == ["Аноним"] and rows["nobody"].book.warning_count == 1 and rows["blank"].book.authors == ["Аноним"] and rows["some"].book.authors == ["Nadia Ferris"]
    assert rows["none"].reject_reason == "no description" and rows["untitled"].reject_reason == "no title"
