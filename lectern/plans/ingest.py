"""From a source's segments and payloads to the catalogue's tables, first and next scans alike (S4, S9-S13, J9, K2-K10, A11-A13, Q1-Q11, ST1-ST6)."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.fields import archive_name, fingerprint, genre_candidates, has_replacement, is_anonymous, normalize_language, warning_message
from lectern.functions.text import normalize
from lectern.operators import lookup, model, quality, reconcile, search, stats
from lectern.operators.quality import Rejected
from lectern.sources import archives, fb2, inpx
from lectern.storage import folders

from . import snapshot as store

AVAILABLE, MISSING = "available", "missing_from_index"
#: Archives that are looked for when a source's folder is inferred.
ROOT_SAMPLE = 16
#: Warnings that a scan keeps, and scans whose warnings are kept.
MOST_WARNINGS, WARNING_SCANS = 1000, 10
COUNTERS = (
    "segments_total segments_added segments_changed segments_unchanged segments_removed archives_opened archives_skipped records_total records_reused records_parsed "
    "records_added records_updated records_skipped marked_unavailable restored title_fallbacks author_fallbacks language_fallbacks books_with_fallback parser_warnings"
).split()

#: The tables of a snapshot and their columns, which publishing checks.
SCHEMAS = {
    "sources": "id int, source_fingerprint string, scan_id string, scan_time timestamp",
    "segments": "segment_id string, archive_name string, segment_order long, inp_fingerprint string, availability string, requires_archive boolean, resolved_archive_path string, archive_size long, archive_modified timestamp, manifest string, record_count long, active_record_count long, deleted_record_count long",
    "deletions": "segment_id string, lib_id string",
    "books": "book_id long, title string, normalized_title string, language string, identifier string, series string, series_index double, publisher string, year int, isbn string, description string, cover_path string, added_at timestamp",
    "locations": "book_id long, lib_id string, segment_id string, archive_name string, entry_name string, file_size_bytes long, present_in_segment boolean, availability string, last_seen_scan_id string",
    "authors": "normalized_name string, display_name string",
    "genres": "normalized_name string, display_name string",
    "book_authors": "book_id long, normalized_name string, ord int",
    "book_genres": "book_id long, normalized_name string, ord int",
    "postings": "token string, field string, block long, ids array<long>",
    "covers": "cover_path string, reference_count long, size_bytes long",
    "cover_contents": "cover_path string, content binary",
    "scan_warnings": "id long, scan_id string, warning_code string, archive_name string, entry_name string, message string",
    "scans": "scan_no long, scan_id string, scan_time timestamp, " + ", ".join(f"{c} long" for c in COUNTERS),
    "statistics": "books long, unavailable long, source_bytes long, cover_bytes long, store_bytes long, total_bytes long",
}


def stored_metadata(joined: DataFrame) -> DataFrame:
    """One book of a record and its payload: the payload's fields, the record's where they are unusable, with flags.

    A fallback of the title is one for replacement characters; a payload without a title is a parser's warning. Genres are codes still.
    """
    b, r = F.col("book"), F.col("record")
    clean = F.filter(F.transform(r["authors"], lambda a: a["display"]), lambda x: (x != "") & ~has_replacement(x))
    no_title = b["title"].isNull()
    bad_title = F.coalesce(has_replacement(b["title"]), F.lit(False)) & (r["title"] != "") & ~has_replacement(r["title"])
    bad_authors = (F.size(clean) > 0) & ((F.size(b["authors"]) == 0) | F.exists(b["authors"], has_replacement) | is_anonymous(b["authors"]))
    bad_language = (b["language"] == "") & (r["language"] != "")
    return joined.select(
        "segment_id",
        r["lib_id"].alias("lib_id"),
        "line_no",
        F.when(bad_title | no_title, r["title"]).otherwise(b["title"]).alias("title"),
        F.when(bad_authors, clean).otherwise(b["authors"]).alias("authors"),
        normalize_language(F.when(bad_language, r["language"]).otherwise(b["language"])).alias("language"),
        F.coalesce(F.nullif(b["identifier"], F.lit("")), r["lib_id"]).alias("identifier"),
        *[b[c].alias(c) for c in ("series", "series_index", "publisher", "year", "isbn", "description")],
        b["genres"].alias("genres"),
        b["warning_count"].alias("parser_warnings"),
        r["size"].cast("long").alias("declared_size"),
        "actual_size",
        "archive_name",
        r["entry_name"].alias("entry_name"),
        "cover",
        F.when(F.col("cover").isNotNull(), F.concat(F.substring(F.sha2("cover", 256), 1, 2), F.lit("/"), F.sha2("cover", 256), F.lit("."), "cover_ext")).alias("cover_path"),
        "cover_diagnostic",
        bad_title.alias("title_fallback"),
        bad_authors.alias("author_fallback"),
        bad_language.alias("language_fallback"),
    )


def genre_table(spark: SparkSession, genres: Mapping[str, str] | DataFrame | None) -> DataFrame:
    """(alias, name) of a mapping of codes to display names, or of a table whose first two columns are those."""
    if isinstance(genres, DataFrame):
        return genres.toDF("alias", "name", *genres.columns[2:]).select("alias", "name")
    return spark.createDataFrame(list((genres or {}).items()), "alias string, name string")


def named_genres(books: DataFrame, names: DataFrame) -> DataFrame:
    """(book_id, line, pos, name, known) for each genre of books: its display name, '' for a blank code, the code itself if it has none.

    names is the stored table of lookup.resolve_aliases(); a code that a third of the books have is looked up without a shuffle.
    """
    each = books.select("book_id", F.struct("segment_order", "line_no").alias("line"), F.posexplode("genres").alias("pos", "code"))
    blank = genre_candidates(F.col("code"))[1] == ""
    found = lookup.look_up(each, names, "code")
    return found.select("book_id", "line", "pos", F.when(blank, F.lit("")).otherwise(F.coalesce("name", "code")).alias("name"), (blank | F.col("name").isNotNull()).alias("known"))


def archive_states(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """(archive, resolved_archive_path, archive_size, archive_modified) of the archives of names that lie under root."""
    base = F.regexp_replace("path", r"^file:/+", "/")
    below = F.substring(base, F.lit(len(root.rstrip("/")) + 2), F.length(base))
    files = archives.file_states(spark, root).select(
        F.regexp_extract(below, r"^(.*?)/?[^/]*$", 1).alias("folder"), F.regexp_extract(below, "([^/]*)$", 1).alias("archive"), base.alias("resolved_archive_path"), F.col("size").alias("archive_size"), F.col("modified").alias("archive_modified")
    )
    found = archives.resolve_archives(names.select("archive").distinct(), files.select("folder", "archive")).filter("folder is not null")
    return found.join(files, ["archive", "folder"]).drop("folder")


def infer_root(spark: SparkSession, source: str) -> str:
    """The folder of a source's archives (S12): the source's own or one in it, whichever has most of the first ROOT_SAMPLE archives, the first of equals; its own if none has any."""
    parent = source.rsplit("/", 1)[0] or "/"
    names = spark.createDataFrame(list(enumerate(inpx.segment_names(source))), "o int, name string").select("o", archive_name(F.col("name")).alias("archive"))
    sample = archives.first_names(names, "o", ROOT_SAMPLE)
    candidates = spark.createDataFrame([(name, k) for k, name in enumerate(["", *folders(spark, parent)])], "candidate string, ord int")
    base = F.regexp_replace("path", r"^file:/+", "/")
    below = F.substring(base, F.lit(len(re.sub("^file:/+", "/", parent).rstrip("/")) + 2), F.length(base))
    listing = archives.file_states(spark, parent).select(F.regexp_extract(below, "^(?:([^/]*)/)?[^/]*$", 1).alias("candidate"), F.regexp_extract(below, "([^/]*)$", 1).alias("archive"), below.alias("b")).filter(~F.col("b").rlike("/.*/"))
    best = archives.best_root(sample, candidates, listing).first()
    return f"{parent.rstrip('/')}/{best.candidate}" if best.candidate else parent


def plan_segments(spark: SparkSession, source: str, archive_root: str, old: DataFrame | None) -> DataFrame:
    """Segments of the source with what is known of their archives, and what is to be done with each (ST2): change, step.

    Manifests are read only where the text of a segment is new or its archive's size or time has changed.
    """
    segments = inpx.read_segments(spark, source).select(F.col("inp_entry_name").alias("segment_id"), archive_name(F.col("inp_entry_name")).alias("archive"), "segment_order", F.col("fingerprint").alias("inp_fingerprint"))
    if twice := quality.duplicates(segments, ["segment_id"]).head(1):
        raise Rejected(f"segment {twice[0].segment_id} occurs more than once")
    segments = segments.join(archive_states(spark, archive_root, segments), "archive", "left")
    stat = lambda p="": F.concat_ws("|", f"{p}resolved_archive_path", F.col(f"{p}archive_size").cast("string"), F.col(f"{p}archive_modified").cast("string"))
    new = segments.withColumns({"inp": F.col("inp_fingerprint"), "archive_stat": stat()})
    if old is None:
        before = segments.select("segment_id", F.lit("").alias("inp"), F.lit("").alias("availability"), F.lit(False).alias("requires_archive"), F.lit("").alias("archive_stat"), F.lit("").alias("manifest")).limit(0)
    else:
        before = old.select("segment_id", F.col("inp_fingerprint").alias("inp"), "availability", "requires_archive", stat().alias("archive_stat"), "manifest")
    first = reconcile.reuse_plan(before, new.withColumn("manifest", F.lit(None).cast("string")), "segment_id")
    wanted = new.join(first.filter("step = 'parse'"), "segment_id", "left_semi").filter("resolved_archive_path is not null")
    paths = [r.p for r in wanted.select(F.col("resolved_archive_path").alias("p")).distinct().collect()]  # a name for each archive
    if paths:
        entries = archives.manifests(spark, paths)
        if twice := quality.duplicates(entries, ["archive", "name"]).head(1):
            raise Rejected(f"archive {twice[0].archive} has entry {twice[0].name} more than once")
        prints = stats.manifest_fingerprint(entries, "archive", "name", "size", "crc").select(F.col("archive").alias("resolved_archive_path"), F.col("fingerprint").alias("manifest"))
        new = new.join(prints, "resolved_archive_path", "left")
    else:
        new = new.withColumn("manifest", F.lit(None).cast("string"))
    steps = reconcile.reuse_plan(before, new, "segment_id")
    kept = before.select("segment_id", F.col("manifest").alias("_manifest"))
    out = new.join(steps, "segment_id").join(kept, "segment_id", "left").withColumn("manifest", F.coalesce("manifest", "_manifest"))
    return out.select("segment_id", F.col("archive").alias("archive_name"), "segment_order", "inp_fingerprint", "resolved_archive_path", "archive_size", "archive_modified", "manifest", "change", "step")


def read_payloads(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Active records with the book of their payload, or the reason why it has none: payloads are read archive by archive and joined to their records."""
    active = records.filter(~F.col("record.deleted") & (F.col("record.ext") == "fb2")).drop("archive_name")
    wanted = active.join(segments.select("segment_id", "archive_name", F.col("resolved_archive_path").alias("archive")), "segment_id").withColumn("entry", F.col("record.entry_name"))
    read = archives.payloads(wanted.select("archive", "entry").distinct())
    parsed = fb2.covers(fb2.parse(read, require_title=False)).select("archive", "entry", "book", F.col("reject_reason").alias("payload_reject"), "cover_ext", "cover", "cover_diagnostic", F.octet_length("content").cast("long").alias("actual_size"))
    return wanted.select("segment_id", "line_no", "archive_name", "record", "archive", "entry").join(parsed, ["archive", "entry"])


def _numbered(books: DataFrame, known: DataFrame, scan_time: Column) -> DataFrame:
    """books with book_id, added_at and is_new: known ones keep theirs, new ones are numbered in the source's order (K4)."""
    start = known.agg(F.coalesce(F.max("book_id"), F.lit(0)).alias("m")).first().m
    fresh = model.number_new(books.join(known, "lib_id", "left_anti"), "lib_id", ["segment_order", "line_no"], start).withColumnRenamed("id", "book_id").withColumns({"added_at": scan_time, "is_new": F.lit(True)})
    return books.join(known, "lib_id").withColumn("is_new", F.lit(False)).unionByName(fresh)


def broken_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, key) of what a written snapshot must not hold: other columns than declared, keys without a row, a key twice, bad rows (Q1-Q7)."""
    spark = tables["books"].sparkSession
    wrong = []
    for name, ddl in SCHEMAS.items():
        wrong += [(f"{name}: {problem}", column) for column, problem in quality.schema_problems(tables[name].schema, T._parse_datatype_string(ddl))]
    found = [spark.createDataFrame(wrong, "rule string, key string")] if wrong else []

    def keys() -> DataFrame:
        # every id of the index, a row each
        own = tables | {"postings": tables["postings"].select(F.explode("ids").alias("book_id"))}
        pairs = [("book_authors", "book_id", "books", "book_id"), ("book_genres", "book_id", "books", "book_id"), ("book_authors", "normalized_name", "authors", "normalized_name"), ("book_genres", "normalized_name", "genres", "normalized_name")]
        pairs += [("locations", "book_id", "books", "book_id"), ("books", "book_id", "locations", "book_id"), ("locations", "segment_id", "segments", "segment_id"), ("deletions", "segment_id", "segments", "segment_id"), ("postings", "book_id", "books", "book_id"), ("books", "cover_path", "cover_contents", "cover_path")]
        return quality.foreign_keys([quality.dangling(own[c], k, own[p], q, f"{c}.{k}") for c, k, p, q in pairs])

    found.append(keys().withColumnRenamed("relation", "rule"))
    found.append(quality.singleton(tables["sources"], "id", ["source_fingerprint", "scan_id"]).filter("not ok").select(F.lit("sources: one row").alias("rule"), F.col("n").cast("string").alias("key")))
    for t, k in (("books", "book_id"), ("locations", "lib_id"), ("locations", "book_id"), ("segments", "segment_id"), ("authors", "normalized_name"), ("genres", "normalized_name")):
        found.append(quality.duplicates(tables[t], [k]).select(F.lit(f"{t}.{k}: twice").alias("rule"), F.col(k).cast("string").alias("key")))
    found.append(quality.violations(tables["books"], "book_id", {"books: id": F.col("book_id") > 0, "books: title": F.col("title") != ""}))
    return reduce(DataFrame.unionByName, found)


def scan(spark: SparkSession, source: str, archive_root: str | None, root: str, snapshot: str, scan_time: Column, mode: str = "failfast", genres: Mapping[str, str] | DataFrame | None = None, cover_budget: int | None = None) -> DataFrame:
    """Brings the catalogue under root to the state of a source and publishes it as `snapshot`; returns the scan's counters, one row.

    Only segments whose text or archive is new are parsed; books that the source no longer offers stay, as
    missing_from_index, with their id and time, and come back when it offers them again. genres maps codes to display
    names, or is a table of the two. A rejected record or payload fails the scan unless mode is permissive; what may not be published never is.
    Without archive_root it is inferred from the source's place. cover_budget bounds the bytes of covers that books name.
    The scan writes what it changes; all else is named again by the new version. It is refused if another scan published
    meanwhile, or if the source or an archive that it relied on is no longer as it was.
    """
    draft = store.Draft(spark, root, snapshot)
    try:
        return _scan(draft, source, archive_root or infer_root(spark, source), scan_time, mode, genres, cover_budget)
    except BaseException:
        draft.drop()
        raise


def _scan(draft: store.Draft, source: str, archive_root: str, scan_time: Column, mode: str, genres: Mapping[str, str] | DataFrame | None, cover_budget: int | None) -> DataFrame:
    spark, snapshot, stage = draft.spark, draft.snapshot, draft.stage
    old = None if draft.base is None else {n: draft.old(n) for n in SCHEMAS}
    empty = {n: T._parse_datatype_string(ddl) for n, ddl in SCHEMAS.items()}
    was = old or {n: spark.createDataFrame([], s) for n, s in empty.items()}
    source_print = inpx.source_fingerprint(source)

    plan = stage("plan", plan_segments(spark, source, archive_root, None if old is None else was["segments"]))
    touched = [r.segment_id for r in plan.filter("step = 'parse'").select("segment_id").collect()]  # names of segments
    if plan.isEmpty():
        raise Rejected("the source has no segments")
    again = [r.p for r in plan.filter("step = 'same-manifest'").select(F.col("resolved_archive_path").alias("p")).distinct().collect()]
    if again and (bad := archives.manifests(spark, again, validate=True).filter("not payload_ok").head(1)):
        raise Rejected(f"archive {bad[0].archive} is damaged at {bad[0].name}")

    # what the source says anew
    parsed = stage("records", inpx.parse_all(spark, source, touched).withColumn("segment_id", F.col("inp_entry_name")))
    if bad := inpx.unreadable(parsed).head(1):
        raise Rejected(f"segment {bad[0].inp_entry_name} has no text: {bad[0].reject_reason}")
    quality.strict(parsed.filter("reject_reason is not null").select("segment_id", "line_no", "reject_reason"), mode, "records were rejected")
    records = parsed.filter("reject_reason is null")
    live = ~F.col("record.deleted") & (F.col("record.ext") == "fb2")
    counts = parsed.groupBy("segment_id").agg(
        F.count("*").alias("record_count"), F.count_if(F.col("reject_reason").isNull() & live).alias("active_record_count"), F.count_if(F.col("reject_reason").isNull() & F.col("record.deleted")).alias("deleted_record_count")
    )
    fresh_segments = plan.filter("step = 'parse'").join(counts, "segment_id", "left").fillna(0, ["record_count", "active_record_count", "deleted_record_count"])
    if gone := fresh_segments.filter("active_record_count > 0 and resolved_archive_path is null").head(1):
        raise Rejected(f"segment {gone[0].segment_id} has no archive {gone[0].archive_name}")
    offered = records.filter(live).select(F.col("record.lib_id").alias("lib_id"))
    reused = was["locations"].join(plan.filter("step <> 'parse'").select("segment_id"), "segment_id", "left_semi").filter("present_in_segment")
    if twice := quality.duplicates(offered.unionAll(reused.select("lib_id")), ["lib_id"]).head(1):
        raise Rejected(f"library id {twice[0].lib_id} has more than one active record")
    payloads = stage("payloads", read_payloads(records, plan))
    books = stage("books", stored_metadata(payloads.filter("book is not null")).join(plan.select("segment_id", "segment_order"), "segment_id"))
    refused = payloads.filter("book is null").select("segment_id", "line_no", "archive_name", "entry", "payload_reject")
    quality.strict(refused, mode, "payloads were rejected")
    if bad := books.filter("declared_size <> 0 and declared_size <> actual_size").head(1):
        raise Rejected(f"{bad[0].entry_name} is declared as {bad[0].declared_size} bytes and has {bad[0].actual_size}")

    # merged with what was known
    known = was["locations"].select("lib_id", "book_id").join(was["books"].select("book_id", "added_at"), "book_id")
    placed = stage("placed", _numbered(books, known, scan_time))
    changed, known_books = placed.select("book_id"), placed.filter("not is_new").select("book_id")
    books_now = draft.change("books", "book_id", placed.withColumn("normalized_title", normalize(F.col("title"))).select(empty["books"].names))
    codes = stage("genre_codes", lookup.resolve_aliases(placed.select(F.explode("genres").alias("code")), "code", genre_candidates(F.col("code")), genre_table(spark, genres)))
    each_genre = stage("each_genre", named_genres(placed, codes))
    each_author = placed.select("book_id", F.struct("segment_order", "line_no").alias("line"), F.posexplode("authors").alias("pos", "name"))
    for name, each in (("authors", each_author), ("genres", each_genre)):
        draft.change(name, "normalized_name", model.new_names(was[name], each.select("name", F.struct("line", "pos").alias("order")), "order"), replaces=False)
        draft.change(f"book_{name}", "book_id", model.bridge_rows(each, "book_id"), known_books)

    segment_fields = empty["segments"].names
    fresh_segments = fresh_segments.withColumns({"availability": F.lit(AVAILABLE), "requires_archive": F.col("active_record_count") > 0}).select(segment_fields)
    same = plan.filter("step <> 'parse'").withColumn("availability", F.lit(AVAILABLE)).join(was["segments"].select("segment_id", "requires_archive", "record_count", "active_record_count", "deleted_record_count"), "segment_id").select(segment_fields)
    removed = was["segments"].join(plan.select("segment_id"), "segment_id", "left_anti")
    segments = fresh_segments.unionByName(same).unionByName(removed.withColumn("availability", F.lit(MISSING)).select(segment_fields))
    segments = draft.change("segments", "segment_id", reconcile.changed_rows(was["segments"], segments, "segment_id"))
    tombstones = records.filter(F.col("record.deleted")).select("segment_id", F.col("record.lib_id").alias("lib_id")).distinct()
    silent = was["deletions"].select("segment_id").distinct().join(same.select("segment_id"), "segment_id", "left_anti")
    deletions = draft.change("deletions", "segment_id", tombstones, silent)

    location_fields = empty["locations"].names
    seen = placed.withColumns({"file_size_bytes": F.col("actual_size"), "present_in_segment": F.lit(True), "availability": F.lit(MISSING), "last_seen_scan_id": F.lit(snapshot)}).select(location_fields)
    # records that a parsed segment no longer has are absent; those of other segments stay as they were (ST5)
    marks = plan.filter("step = 'parse'").select("segment_id", F.lit("changed").alias("change"))
    present = reconcile.mark_absent(was["locations"], seen, marks).select("lib_id", F.col("present_in_segment").alias("_still"))
    stays = was["locations"].join(placed.select("lib_id"), "lib_id", "left_anti").join(present, "lib_id").withColumn("present_in_segment", F.col("present_in_segment") & F.col("_still")).select(location_fields)
    located = seen.unionByName(stays)
    state = reconcile.availability(located, deletions, segments)
    located = located.drop("availability").join(state, "lib_id").select(location_fields)
    locations = draft.change("locations", "lib_id", reconcile.changed_rows(was["locations"], located, "lib_id"))

    fresh = _searchable(books_now.join(changed, "book_id", "left_semi"), draft.table("book_authors"), draft.table("authors"))
    draft.change("postings", "block", search.in_token_order(search.text_blocks(fresh, "book_id", list(search.FIELDS))), search.ids_by_block(known_books, "book_id"), blocks=True)

    pictures = placed.filter("cover is not null").select("cover_path", F.col("cover").alias("content")).dropDuplicates(["cover_path"]).join(was["cover_contents"].select("cover_path"), "cover_path", "left_anti")
    unused = was["cover_contents"].select("cover_path").join(books_now.select("cover_path"), "cover_path", "left_anti")
    contents = draft.change("cover_contents", "cover_path", pictures, unused, replaces=False)
    sized = books_now.join(contents.select("cover_path", F.octet_length("content").cast("long").alias("size_bytes")), "cover_path")
    references = stats.cover_references(sized, "cover_path", "size_bytes").select("cover_path", "reference_count", "size_bytes")
    covers = draft.change("covers", "cover_path", reconcile.changed_rows(was["covers"], references, "cover_path"), unused)

    if cover_budget is not None and not (used := stats.budget(covers, cover_budget).first()).within:
        raise Rejected(f"covers need {used.used} bytes, {cover_budget} are allowed")

    scan_no = was["scans"].agg(F.coalesce(F.max("scan_no"), F.lit(0)).alias("m")).first().m + 1
    draft.put("sources", spark.range(1).select(F.lit(1).alias("id"), F.lit(source_print).alias("source_fingerprint"), F.lit(snapshot).alias("scan_id"), scan_time.alias("scan_time")))
    warnings = stage("warnings", _warnings(was["scan_warnings"], parsed, refused, placed, snapshot, scan_no))
    forgotten = was["scan_warnings"].select("scan_id").distinct().join(warnings.select("scan_id"), "scan_id", "left_anti")
    draft.change("scan_warnings", "scan_id", warnings.filter(F.col("scan_id") == snapshot), forgotten, replaces=False)
    counters = stage("counters", _counters(was, plan, removed, parsed, placed, each_genre, segments, locations, scan_no, snapshot, scan_time))
    draft.change("scans", "scan_no", counters, replaces=False)
    draft.put("statistics", stats.catalogue_statistics(locations, covers.select("size_bytes")))
    if inpx.source_fingerprint(source) != source_print:
        raise Rejected("the source changed while it was scanned")
    check_archives(spark, archive_root, plan.join(segments.select("segment_id", "requires_archive"), "segment_id"))
    version = draft.commit([broken_rules])
    return version.table("scans").filter(F.col("scan_no") == scan_no)


def check_archives(spark: SparkSession, archive_root: str, plan: DataFrame) -> None:
    """Refuses a scan whose archives aren't what it read (Q11): segments of one archive must agree on it, and its place, size and time must still be the same, and the manifest of archives that were opened."""
    needed = plan.filter("requires_archive")
    if bad := quality.disagreement(needed, "resolved_archive_path", ["archive_size", "archive_modified", "manifest"]).head(1):
        raise Rejected(f"segments don't agree on archive {bad[0].resolved_archive_path}")
    own = needed.groupBy(F.col("archive_name").alias("archive"), "resolved_archive_path", "archive_size", "archive_modified", "manifest").agg(F.bool_or(F.col("step").isin("parse", "same-manifest")).alias("opened"))
    now = archive_states(spark, archive_root, own).select("archive", *[F.col(c).alias(f"_{c}") for c in ("resolved_archive_path", "archive_size", "archive_modified")])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("resolved_archive_path", "archive_size", "archive_modified")])
    if bad := own.join(now, "archive", "left").filter(~same).head(1):
        raise Rejected(f"archive {bad[0].archive} changed while it was scanned")
    paths = [r.p for r in own.filter("opened").select(F.col("resolved_archive_path").alias("p")).distinct().collect()]  # a name for each archive
    if paths:
        prints = stats.manifest_fingerprint(archives.manifests(spark, paths), "archive", "name", "size", "crc").select(F.col("archive").alias("resolved_archive_path"), F.col("fingerprint").alias("_now"))
        if bad := own.filter("opened").join(prints, "resolved_archive_path", "left").filter(~F.col("manifest").eqNullSafe(F.col("_now"))).head(1):
            raise Rejected(f"archive {bad[0].archive} changed while it was scanned")


#: A first scan and a next one differ in what is known before only.
initial = rescan = scan


def _searchable(books: DataFrame, book_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """books with their authors' names in one column."""
    names = search.ordered_names(book_authors.join(authors, "normalized_name"), "book_id", ["ord"], "display_name", "author_names")
    return books.join(names, "book_id", "left").withColumn("authors", F.array_join("author_names", " "))


def _warnings(old: DataFrame, parsed: DataFrame, refused: DataFrame, placed: DataFrame, scan_id: str, scan_no: int) -> DataFrame:
    """Warnings of the latest scans: the first MOST_WARNINGS of each, of WARNING_SCANS scans."""
    entry = F.col("record.entry_name")
    # rejected records bring their reason among their warnings
    lines = parsed.select("segment_id", "line_no", F.when(F.col("reject_reason").isNull(), "record-warning").otherwise("record-rejected").alias("warning_code"), "archive_name", entry.alias("entry_name"), F.explode("warnings").alias("text"))
    other = parsed.filter("reject_reason is null and not record.deleted and record.ext <> 'fb2'").select("segment_id", "line_no", F.lit("unsupported-format").alias("warning_code"), "archive_name", entry.alias("entry_name"), F.lit("format isn't supported").alias("text"))
    payloads = refused.select("segment_id", "line_no", F.lit("payload-rejected").alias("warning_code"), "archive_name", F.col("entry").alias("entry_name"), F.col("payload_reject").alias("text"))
    art = placed.filter("cover_diagnostic is not null").select("segment_id", "line_no", F.lit("cover").alias("warning_code"), "archive_name", "entry_name", F.col("cover_diagnostic").alias("text"))
    every = lines.unionByName(other).unionByName(payloads).unionByName(art)
    first = every.withColumns({"message": warning_message(F.col("archive_name"), F.col("entry_name"), F.col("text")), "scan_id": F.lit(scan_id)}).orderBy("segment_id", "line_no", "warning_code", "text").limit(MOST_WARNINGS)
    own = model.cap_log(first.withColumn("_o", F.struct("segment_id", "line_no", "warning_code", "text")), "scan_id", "_o", MOST_WARNINGS, place="_n")
    own = own.select((F.lit(scan_no * MOST_WARNINGS) + F.col("_n")).cast("long").alias("id"), "scan_id", "warning_code", "archive_name", "entry_name", "message")
    kept = stats.retain_latest(old.unionByName(own), "scan_id", "id", WARNING_SCANS)
    return kept.select("id", "scan_id", "warning_code", "archive_name", "entry_name", "message")


def _counters(was: dict[str, DataFrame], plan: DataFrame, removed: DataFrame, parsed: DataFrame, placed: DataFrame, each_genre: DataFrame, segments: DataFrame, locations: DataFrame, scan_no: int, scan_id: str, scan_time: Column) -> DataFrame:
    """One row of counters of a scan."""
    change = lambda kind: F.count_if(F.col("change") == kind)
    requires = segments.select("segment_id", "requires_archive", "record_count")
    planned = plan.join(requires, "segment_id").agg(
        F.count("*").alias("_now"), change("added").alias("segments_added"), change("changed").alias("segments_changed"), change("unchanged").alias("segments_unchanged"),
        F.count_if(F.col("requires_archive") & F.col("step").isin("parse", "same-manifest")).alias("archives_opened"), F.count_if(F.col("requires_archive") & (F.col("change") == "unchanged")).alias("archives_skipped"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("records_total"), F.coalesce(F.sum(F.when(F.col("change") == "unchanged", F.col("record_count"))), F.lit(0)).alias("records_reused"),
    )
    gone = removed.agg(F.count_if(F.col("availability") == AVAILABLE).alias("segments_removed"))
    nameless = each_genre.agg(F.count_if(~F.col("known")).alias("_nameless"))
    read = placed.agg(F.coalesce(F.sum("parser_warnings"), F.lit(0)).alias("_mended"), F.count("*").alias("records_parsed"), F.count_if("is_new").alias("records_added"), F.count_if(~F.col("is_new")).alias("records_updated"))
    skipped = parsed.agg(F.count_if(F.col("reject_reason").isNotNull()).alias("records_skipped"))
    flips = reconcile.flips(was["locations"].select("lib_id", "availability"), locations.select("lib_id", "availability")).select(F.col("retired").alias("marked_unavailable"), "restored")
    fallbacks = stats.fallback_counters(placed, {n: F.col(f"{n}_fallback") for n in ("title", "author", "language")})
    row = reduce(DataFrame.crossJoin, [planned, gone, read, nameless, skipped, flips, fallbacks])  # one row each
    row = row.withColumns({"parser_warnings": F.col("_mended") + F.col("_nameless"), "segments_total": F.col("_now") + F.col("segments_removed"), "scan_no": F.lit(scan_no).cast("long"), "scan_id": F.lit(scan_id), "scan_time": scan_time})
    return row.select("scan_no", "scan_id", "scan_time", *[F.col(c).cast("long").alias(c) for c in COUNTERS])
