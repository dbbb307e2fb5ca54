"""Versions of a catalogue: what scans write, who may publish, and the index in blocks."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.operators.quality import Rejected
from lectern.operators.search import CatalogQuery
from lectern.plans import ingest
from lectern.plans import snapshot as store
from lectern.plans.catalog import Catalog
from lectern.sources import inpx

from .test_catalog import Scans, archive, drop, line, payload  # noqa: F401


def size(folder):
    return sum(os.path.getsize(os.path.join(top, f)) for top, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def folders(root):
    return {f: size(f"{root}/data/{f}") for f in os.listdir(f"{root}/data")}


def words(seed, n=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))


def test_a_rescan_writes_what_changed(spark, drop):  # noqa: F811
    """One segment of sixteen changes: the new version's files are a small part of the first one's, and say the same as a first scan of the same source."""
    scans = Scans(spark, drop)
    segments = {}
    for k in range(16):
        ids = range(k * 10 + 1, k * 10 + 11)
        archive(drop, f"a{k:02d}", {i: payload(f"Book {i}", extra=f"<annotation><p>{words(i)}</p></annotation>") for i in ids}, 1_700_000_000)
        segments[f"a{k:02d}"] = [line(i, f"Book {i}") for i in ids]
    scans.run(segments)
    first = folders(scans.root)
    archive(drop, "a07", {i: payload(f"New {i}", extra=f"<annotation><p>{words(1000 + i)}</p></annotation>") for i in range(71, 81)}, 1_700_000_500)
    r = scans.run(segments)
    assert (r.segments_changed, r.records_parsed, r.records_updated) == (1, 10, 10)
    (written,) = (n for f, n in folders(scans.root).items() if f not in first)
    assert written < 0.2 * sum(first.values()), (written, first)
    names = store.opened(spark, scans.root).tables
    assert len(names["books"]["parts"]) == 2 and len(names["postings"]["parts"]) == 2
    again = Scans(spark, drop)
    again.root += "-again"
    again.run(segments)
    for name in ingest.SCHEMAS:
        if name in ("sources", "scans", "scan_warnings"):
            continue
        if name == "postings":
            flat = [{(r.token, r.field, r.lib_id) for r in c.catalog.table(name).select("token", "field", F.explode("ids").alias("book_id")).join(c.catalog.table("locations"), "book_id").collect()} for c in (scans, again)]
            assert flat[0] == flat[1]
            continue
        hidden = [c for c in ("book_id", "added_at", "last_seen_scan_id", "ids", "block") if c in scans.catalog.table(name).columns]
        one, other = (sorted(map(str, c.catalog.table(name).drop(*hidden).collect())) for c in (scans, again))
        assert one == other, name
    c = scans.catalog
    assert c.count(CatalogQuery(text="new")) == 10 and c.count(CatalogQuery(text="book")) == 150
    assert c.count(CatalogQuery(text=f"new {words(1075, 1)}")) == 1 and c.count(CatalogQuery(text=words(75, 1))) == 0
    # nothing changes: neither does any table but the scans' own
    before = names["books"]
    scans.run(segments)
    assert store.opened(spark, scans.root).tables["books"] == before
    assert len(store.numbers(spark, scans.root)) == 3
    gone = store.expire(spark, scans.root, 1)
    assert gone and store.numbers(spark, scans.root) == [3] and scans.catalog.count(CatalogQuery(text="new")) == 10


def test_parts_merge_and_are_written_anew(spark, folder):
    rows = lambda pairs: spark.createDataFrame(pairs, "k long, v string")
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "k long")
    want = {k: f"v{k}" for k in range(1000)}
    draft = store.Draft(spark, folder, "s0")
    draft.change("t", "k", rows(sorted(want.items())))
    draft.commit()
    for n in range(1, 12):
        draft = store.Draft(spark, folder, f"s{n}")
        draft.change("t", "k", rows([(n, f"new {n}"), (2000 + n, "more")]), keys([500 + n, 2000 + n - 1]))
        want |= {n: f"new {n}", 2000 + n: "more"}
        want.pop(500 + n), want.pop(2000 + n - 1, None)
        draft.commit()
        assert len(store.opened(spark, folder).tables["t"]["parts"]) <= store.MOST_PARTS
    assert {r.k: r.v for r in store.table(spark, folder, "t").collect()} == want
    draft = store.Draft(spark, folder, "large")
    draft.change("t", "k", rows([(k, "other " * 20) for k in range(900)]))
    draft.commit()
    assert len(store.opened(spark, folder).tables["t"]["parts"]) == 1 and store.table(spark, folder, "t").count() == len(want.keys() | set(range(900)))
    # an older version still reads as it was
    assert store.opened(spark, folder, 1).table("t").count() == 1000


def test_of_two_scans_one_is_refused(spark, drop, monkeypatch):  # noqa: F811
    scans = Scans(spark, drop)
    archive(drop, "a", {1: payload("One")})
    scans.run({"a": [line(1, "1")]})
    inner, done = ingest.broken_rules, []

    def meanwhile(tables):
        if not done:
            done.append(store.Draft(spark, scans.root, "other"))
            done[0].commit()
        return inner(tables)

    monkeypatch.setattr(ingest, "broken_rules", meanwhile)
    with pytest.raises(store.Conflict):
        scans.run({"a": [line(1, "1")]})
    assert store.current(spark, scans.root) == "other" and len(os.listdir(f"{scans.root}/data")) == 1


def test_names_are_created_once(spark, folder):
    made = []
    threads = [threading.Thread(target=lambda k=k: made.append(store.create(spark, f"{folder}/v/1.json", b"%d" % k))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [False] * 7 + [True] and [f for f in os.listdir(f"{folder}/v") if f.endswith("json")] == ["1.json"]


def test_an_archive_that_changes_meanwhile_refuses_the_scan(spark, drop, monkeypatch):  # noqa: F811
    scans = Scans(spark, drop)
    archive(drop, "a", {1: payload("One"), 2: payload("Two")}, 1_700_000_000)
    inner = ingest._warnings

    def touched(*args):
        archive(drop, "a", {1: payload("One"), 2: payload("Too")}, stamp[0])
        return inner(*args)

    monkeypatch.setattr(ingest, "_warnings", touched)
    for stamp in ([1_700_000_900], [1_700_000_000]):  # seen by its time; by its manifest alone, as size and time are the same
        with pytest.raises(Rejected, match="archive a.zip changed"):
            scans.run({"a": [line(1, "1"), line(2, "2")]})
        archive(drop, "a", {1: payload("One"), 2: payload("Two")}, 1_700_000_000)
    assert store.current(spark, scans.root) is None


def test_segments_in_other_charsets(spark, drop):  # noqa: F811
    """Through a scan: UTF-16 and both Cyrillic charsets are read; a segment without a text refuses the scan in any mode, so no book is marked missing."""
    scans = Scans(spark, drop, "permissive")
    segments = {}
    for k, (charset, mark) in enumerate((("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("cp866", b""), ("cp1251", b"")), 1):
        archive(drop, charset, {k: payload("�", "�")})
        segments[f"{charset}.inp"] = mark + line(k, f"Школьная книга {k}", "Шишкин,Олег,", "ru").encode(charset)
    path = f"{drop}/library.inpx"
    run = lambda n: ingest.scan(spark, path, drop, scans.root, n, F.lit("2024-01-01").cast("timestamp"), "permissive")
    inpx.write_inpx(path, segments)
    run("s1")
    assert {(r.title, *r.authors) for r in scans.catalog.listed(scans.catalog.books()).collect()} == {(f"Школьная книга {k}", "Олег Шишкин") for k in range(1, 5)}
    for broken in (b"\xff\xfea", b"\xe0\n"):
        inpx.write_inpx(path, segments | {"cp866.inp": broken})
        with pytest.raises(Rejected, match="cp866.inp has no text"):
            run("s2")
    assert set(scans.states().values()) == {"available"} and store.current(spark, scans.root) == "s1"


def test_blocks_of_postings(spark, folder):
    """A token of every book is spread over blocks, tasks and files; a search finds what a look at every text finds."""
    rng = random.Random(3)
    rows = [(i, " ".join(["the", *(rng.choice(["alpha", "alps", "beta", "betel", "gamma"]) for _ in range(2))]), "the" if i % 7 else "rare") for i in range(0, 60_000, 2)]
    books = spark.createDataFrame(rows, "book_id long, title string, description string").repartition(8)
    fields = ["title", "description"]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as an index of this size would be one task
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        search.write_postings(search.postings(books, "book_id", fields), "book_id", folder + "/index")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    index = spark.read.parquet(folder + "/index")
    assert index.agg(F.max(F.size("ids"))).first()[0] <= 1 << search.SPAN_BITS
    assert index.filter("token = 'the'").count() == 2 * -(-60_000 // (1 << search.SPAN_BITS))
    assert len([f for f in index.inputFiles() if spark.read.parquet(f).filter("token = 'the'").count()]) > 1
    flat = index.select("token", "field", F.explode("ids").alias("book_id"))
    assert flat.exceptAll(search.postings(books, "book_id", fields)).isEmpty() and flat.count() == search.postings(books, "book_id", fields).count()
    for text in ("the", "al be", "alpha alps", "rare", "rare gam", "the the", "zz", "al zz"):
        ours = search.search_postings(index, "book_id", text.split(), fields)
        theirs = search.match_tokens(books, text, fields).select("book_id")
        assert sorted(r.book_id for r in ours.collect()) == sorted(r.book_id for r in theirs.collect()), text


def test_a_page_reads_the_index_once(spark, drop, monkeypatch):  # noqa: F811
    scans = Scans(spark, drop)
    archive(drop, "a", {k: payload(f"Lantern {k}", lang="en" if k % 2 else "de", genre="tale" if k % 3 else "x") for k in range(1, 10)})
    scans.run({"a": [line(k, str(k)) for k in range(1, 10)]})
    c, asked, inner = scans.catalog, [], search.search_postings
    monkeypatch.setattr(search, "search_postings", lambda *a: asked.append(a) or inner(*a))
    q = CatalogQuery(text="lantern", languages=("de",), genres=("Tales",), sort="author")
    page = c.page(q)
    assert len(asked) == 1 and page.total == c.count(q)
    assert sorted(map(tuple, page.languages.collect())) == sorted(map(tuple, c.facet_languages(q).collect()))
    assert sorted(map(tuple, page.genres.collect())) == sorted(map(tuple, c.facet_genres(q).collect()))
    assert [r.book_id for r in page.rows.collect()] == [r.book_id for r in c.search(q).orderBy("pos").collect()]
