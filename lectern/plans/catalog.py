"""What a user of a published catalogue calls (2.11)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.operators import model, search, stats
from lectern.operators.search import CatalogQuery
from lectern.sources import archives, inpx
from lectern.storage import cut, drop

from . import snapshot as store
from .ingest import archive_states


@dataclass(frozen=True)
class Page:
    """A page of results. The total and the facets come with the first page only; they are None on later ones."""

    rows: DataFrame
    cursor: search.Cursor | None
    total: int | None = None
    languages: DataFrame | None = None
    genres: DataFrame | None = None


class Catalog:
    """One snapshot of a catalogue: the pointer is resolved once, when it is opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.version = store.opened(spark, root)
        if self.version is None:
            raise LookupError(f"{root} has no published snapshot")
        self.snapshot = self.version.snapshot

    def table(self, name: str) -> DataFrame:
        return self.version.table(name)

    def _names(self, kind: str) -> DataFrame:
        return self.table(f"book_{kind}").join(self.table(kind), "normalized_name")

    def books(self) -> DataFrame:
        """Books that have a location (F12), with its state: availability, is_available, can_download, label."""
        placed = self.table("locations").select("book_id", "lib_id", "archive_name", "entry_name", "file_size_bytes", "availability")
        on = F.col("availability") == "available"
        label = F.when(on, "Available").otherwise("Missing from index")
        return self.table("books").join(placed, "book_id").withColumns({"is_available": on, "can_download": on, "label": label})

    def _lists(self, books: DataFrame) -> DataFrame:
        for kind in ("authors", "genres"):
            books = books.join(search.ordered_names(self._names(kind).join(books.select("book_id"), "book_id", "left_semi"), "book_id", ["ord"], "display_name", kind), "book_id", "left")
        return books

    def listed(self, books: DataFrame) -> DataFrame:
        """What a list shows of books (P1); other columns of books, such as pos, stay in front."""
        extra = [c for c in ("pos",) if c in books.columns]
        return self._lists(books).select(*extra, "book_id", "title", "authors", "genres", "language", "series", "series_index", "year", "cover_path", "added_at", "availability", "is_available", "can_download", "label")

    def details(self, book_id: int) -> DataFrame:
        """All that is known of one book."""
        if book_id <= 0:
            raise ValueError("ids are greater than 0")
        return self._lists(self.books().filter(F.col("book_id") == book_id))

    def _found(self, text: str, fields: tuple[str, ...]) -> DataFrame:
        """Books that the text finds: keys come from the stored index, and its hits alone are joined with the books."""
        if text == "":
            return self.books()
        wanted = self.spark.range(1).select(tokens(F.lit(text)).alias("t")).first().t
        hits = search.search_postings(self.table("postings"), "book_id", wanted, list(fields or search.FIELDS))
        return self.books().join(hits, "book_id", "left_semi")

    def _book_genres(self) -> DataFrame:
        return self._names("genres").select("book_id", F.col("display_name").alias("genre"))

    def _matched(self, q: CatalogQuery, languages: bool = True, genres: bool = True) -> DataFrame:
        """Books that the query finds."""
        found = self._found(q.text, q.fields)
        if languages:
            found = search.filter_languages(found, list(q.languages))
        if genres:
            found = search.filter_genres(found, self._book_genres(), list(q.genres))
        return found

    def _sorted(self, found: DataFrame, q: CatalogQuery) -> tuple[DataFrame, list]:
        if q.sort == "author":  # the join is made only when it is needed
            found = found.join(search.author_keys(self._names("authors"), name="display_name"), "book_id", "left")
        return search.with_title_key(found), search.order_of(q.sort, q.ascending)

    def search(self, q: CatalogQuery) -> DataFrame:
        """The rows of a page, with `pos`; only its books get their names."""
        found, order = self._sorted(self._matched(q), q)
        return self.listed(search.page(found, order, q.offset, q.limit))

    def count(self, q: CatalogQuery) -> int:
        return self._matched(q).count()

    def facet_languages(self, q: CatalogQuery) -> DataFrame:
        return search.facet(self._matched(q, languages=False), "language", "book_id")

    def facet_genres(self, q: CatalogQuery) -> DataFrame:
        return search.facet(self._book_genres().join(self._matched(q, genres=False).select("book_id"), "book_id", "left_semi"), "genre", "book_id")

    def page(self, q: CatalogQuery, cursor: search.Cursor | None = None, languages: bool = True, genres: bool = True) -> Page:
        """The first call ranks and publishes the order, counts, and works out the facets that are asked for; later ones slice the order."""
        path = f"{self.root}/rankings"
        first = cursor is None
        facets: list[DataFrame | None] = [None, None]
        if first:
            # what the text finds, once: order, total and facets differ in the other conditions only
            hits = cut(self._flagged(q), "hits")
            found, order = self._sorted(hits.filter("in_language and in_genre"), q)
            total = search.publish_ranking(found, order, "book_id", self.snapshot, q, path)
            cursor = search.Cursor(self.snapshot, q.fingerprint(), min(q.offset, total))
            if languages:
                facets[0] = search.facet(hits.filter("in_genre"), "language", "book_id")
            if genres:
                own = hits.filter("in_language").select("book_id")
                facets[1] = search.facet(self._book_genres().join(own, "book_id", "left_semi"), "genre", "book_id")
            drop(hits)
        else:
            if cursor.snapshot != self.snapshot or cursor.query != q.fingerprint():
                raise search.StaleCursor("the cursor doesn't belong to this snapshot and query")
            total = self.spark.read.parquet(f"{path}/snapshot_id={self.snapshot}/query={cursor.query}").count()
        slice_ = search.read_slice(self.spark, path, cursor, self.snapshot, q, q.limit, total)
        rows = self.listed(search.fetch(slice_, self.books())).orderBy("pos")
        at = min(total, cursor.position + q.limit)
        after = replace(cursor, position=at) if at < total else None
        return Page(rows, after, total, *facets) if first else Page(rows, after)

    def _flagged(self, q: CatalogQuery) -> DataFrame:
        """(book_id, title, language, added_at, in_language, in_genre) of the books that the query's text finds; the flags say whether its other conditions hold."""
        own = self._found(q.text, q.fields).select("book_id", "title", "language", "added_at")
        own = own.withColumn("in_language", F.col("language").isin(list(q.languages)) if q.languages else F.lit(True))
        if not q.genres:
            return own.withColumn("in_genre", F.lit(True))
        held = search.filter_genres(self._book_genres().select("book_id").distinct(), self._book_genres(), list(q.genres)).withColumn("_in", F.lit(True))
        return own.join(held, "book_id", "left").withColumn("in_genre", F.col("_in").isNotNull()).drop("_in")

    def availability(self) -> DataFrame:
        return self.table("locations").select("lib_id", "availability")

    def statistics(self) -> DataFrame:
        return self.table("statistics")

    def source_overview(self) -> DataFrame:
        return stats.source_overview(self.availability().withColumn("source", F.lit(1)), "source")

    def counters(self) -> DataFrame:
        """The counters of the scan that published this snapshot."""
        return self.table("scans").filter(F.col("scan_id") == self.snapshot)

    def warnings(self, most: int = 50) -> DataFrame:
        return stats.latest(self.table("scan_warnings"), "id", most)


def export(catalog: Catalog, lib_ids: DataFrame, source: str, archive_root: str) -> DataFrame:
    """(lib_id, export_status, content): payloads of available books; others say why not.

    The source's hash, each archive's place, size and time, its manifest, and the payload's size must be as published.
    """
    spark = catalog.spark
    own = catalog.table("locations").join(lib_ids.select("lib_id").distinct(), "lib_id", "left_semi").select("lib_id", "segment_id", "entry_name", "file_size_bytes", "availability")
    published = catalog.table("segments").select("segment_id", F.col("archive_name").alias("archive"), F.col("resolved_archive_path").alias("_path"), F.col("archive_size").alias("_size"), F.col("archive_modified").alias("_time"), F.col("manifest").alias("_manifest"))
    own = own.join(published, "segment_id")
    same_source = inpx.source_fingerprint(source) == catalog.table("sources").first().source_fingerprint
    now = archive_states(spark, archive_root, own)
    same_file = (F.col("resolved_archive_path") == F.col("_path")) & (F.col("archive_size") == F.col("_size")) & (F.col("archive_modified") == F.col("_time"))
    checked = own.join(now, "archive", "left").withColumns({"source_ok": F.lit(same_source), "archive_ok": F.coalesce(same_file, F.lit(False))})
    paths = [r.p for r in checked.filter("availability = 'available' and source_ok and archive_ok").select(F.col("_path").alias("p")).distinct().collect()]  # names of archives
    if paths:
        entries = archives.manifests(spark, paths)
        prints = stats.manifest_fingerprint(entries, "archive", "name", "size", "crc").select(F.col("archive").alias("_path"), "fingerprint")
        checked = checked.join(prints, "_path", "left").withColumn("manifest_ok", F.col("fingerprint") == F.col("_manifest"))
    else:
        checked = checked.withColumn("manifest_ok", F.lit(False))
    wanted = checked.filter("availability = 'available' and source_ok and archive_ok and manifest_ok").select(F.col("_path").alias("archive"), F.col("entry_name").alias("entry")).distinct()
    read = archives.payloads(wanted).select(F.col("archive").alias("_path"), F.col("entry").alias("entry_name"), "content")
    joined = checked.join(read, ["_path", "entry_name"], "left").withColumn("size_ok", (F.col("file_size_bytes") == 0) | (F.octet_length("content") == F.col("file_size_bytes")))
    status = model.export_status(joined)
    return joined.select("lib_id", status.alias("export_status"), F.when(status == "ready", F.col("content")).alias("content"))
