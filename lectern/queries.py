"""Registered queries of the catalogue engine, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import fields as X
from lectern.functions.text import normalize, sql_normalize, sql_text, sql_tokens, tokens
from lectern.operators import model, quality, reconcile, search, stats
from lectern.plans.views import Tables, with_views
from lectern.sources import archives
from lectern.storage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *views: str):
    """Registers a function of Tables under its own name, with its SQL over the named views."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


UP, LOW = sql_text(X.UPPER), sql_text(X.LOWER)
WORDS = sql_tokens("description")
TITLE_WORDS = sql_tokens("title")


def _has(words: str, start: str) -> str:
    return f"list_bool_or(list_transform({words}, lambda w: starts_with(w, '{start}')))"


NORM_TITLE = sql_normalize("title")

# --- filters and search ------------------------------------------------------------------------------------------


@query(f"select book_id, title, language from v_books where {_has(WORDS, 'th')} and {_has(WORDS, 'er')}", "books")
def search_scan(t: Tables) -> DataFrame:
    """prefix search by reading the texts."""
    return search.match_tokens(t.books, "th er", ["description"]).select("book_id", "title", "language")


@query(f"select book_id from v_books where {_has(WORDS, 'th')} and {_has(WORDS, 'er')}", "books")
def search_postings(t: Tables) -> DataFrame:
    """Prefix search by the stored inverted index."""
    return search.search_postings(t.postings(), "book_id", ["th", "er"], ["description"])


@query(f"select book_id from v_books where ({_has(TITLE_WORDS, 'an')} or {_has(sql_tokens('publisher'), 'an')}) and ({_has(TITLE_WORDS, 'src1')} or {_has(sql_tokens('publisher'), 'src1')})", "books")
def search_scopes(t: Tables) -> DataFrame:
    """each token may match in another column."""
    return search.match_tokens(t.books, "an, SRC1", ["title", "publisher"]).select("book_id")


@query(f"select book_id, '' as asked from v_books union all select book_id, 'sol' from v_books where {_has(TITLE_WORDS, 'sol')}", "books")
def search_no_tokens(t: Tables) -> DataFrame:
    """no text matches all, a text without tokens nothing, any other what it says."""
    asked = {"": "", "none": "; ... — %", "sol": " SÖL!"}
    found = [search.match_tokens(t.books, text, ["title"]).select("book_id", F.lit(name).alias("asked")) for name, text in asked.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query(f"select book_id, len({WORDS}) as n, md5(array_to_string({WORDS}, ' ')) as digest from v_books", "books")
def tokenise(t: Tables) -> DataFrame:
    """F2."""
    own = t.books.select("book_id", tokens(F.col("description")).alias("w"))
    return own.select("book_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query("select book_id, language from v_books where language in ('de', 'fr')", "books")
def filter_language(t: Tables) -> DataFrame:
    """F3."""
    return search.filter_languages(t.books, ["de", "fr"]).select("book_id", "language")


@query("select book_id, title from v_parts where lower(genre) in ('standard', 'promo')", "parts")
def filter_genre(t: Tables) -> DataFrame:
    """By normalised genre name, through the bridge."""
    return search.filter_genres(t.parts, t.book_genres, ["Standard", " PROMO "]).select("book_id", "title")


@query(f"select book_id from v_books where {_has(WORDS, 'th')} and language in ('en') and publisher in ('src1', 'src2')", "books")
def filter_all(t: Tables) -> DataFrame:
    """text, language and publisher together."""
    own = search.filter_languages(search.match_tokens(t.books, "th", ["description"]), ["en"])
    return own.filter(F.col("publisher").isin("src1", "src2")).select("book_id")


@query(f"select conv_id, array_to_string(list_sort(list_distinct(list(distinct {sql_normalize('role')}))), ',') as roles from conversations group by conv_id")
def canonical_lists(t: Tables) -> DataFrame:
    """Value lists normalised, each value once, ascending."""
    lists = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return lists.select("conv_id", F.array_join(search.canonical_values(F.col("r")), ",").alias("roles"))


@query("select book_id, title, language, publisher, size_bytes from v_books where book_id = 7", "books")
def point_lookup(t: Tables) -> DataFrame:
    """F9, P1."""
    return t.books.filter("book_id = 7").select("book_id", "title", "language", "publisher", "size_bytes")


@query("select i.pos, b.book_id, b.title from (select row_number() over (order by l_orderkey desc, l_linenumber, l_partkey) as pos, l_partkey as book_id from lineitem) i join v_parts b using (book_id)", "parts")
def batch_fetch(t: Tables) -> DataFrame:
    """books of a list, in its order."""
    asked = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("book_id"))
    ids = search.ranked(asked, [F.desc("l_orderkey"), F.asc("l_linenumber"), F.asc("book_id")]).select("pos", "book_id")
    return search.fetch(ids, t.parts).select("pos", "book_id", "title")


@query("select l_orderkey, l_linenumber, case when lower(l_returnflag) = 'n' then 'data' else 'unsupported-format' end as kind from lineitem where l_linestatus <> 'F'")
def active_records(t: Tables) -> DataFrame:
    """records that aren't deleted, and warnings for other formats."""
    kind = F.when(X.lower_ascii(F.col("l_returnflag")) == "n", "data").otherwise("unsupported-format")
    return t.lineitem.filter("l_linestatus <> 'F'").select("l_orderkey", "l_linenumber", kind.alias("kind"))


@query("select b.book_id, b.title from v_parts b where exists (select 1 from v_locations l where l.lib_id = b.book_id)", "parts", "locations")
def attached_books(t: Tables) -> DataFrame:
    """a book without a location is invisible."""
    return t.parts.join(t.locations.select(F.col("lib_id").alias("book_id")), "book_id", "left_semi").select("book_id", "title")


@query("select l.lib_id, s.availability, s.availability = 'available' as is_available, s.availability = 'available' and l.size > 1000 as can_download, case when s.availability = 'available' then 'Available' else 'Missing from index' end as label from v_locations l join v_segments s using (segment_id)", "locations", "segments")
def derived_flags(t: Tables) -> DataFrame:
    """P2."""
    on = F.col("availability") == "available"
    own = t.locations.join(t.segments.select("segment_id", "availability"), "segment_id")
    return own.select("lib_id", "availability", on.alias("is_available"), (on & (F.col("size") > 1000)).alias("can_download"), F.when(on, "Available").otherwise("Missing from index").alias("label"))


# --- joins -------------------------------------------------------------------------------------------------------


@query("select l.lib_id, l.segment_id, s.name, s.availability from v_locations l join v_segments s using (segment_id)", "locations", "segments")
def join_location_segment(t: Tables) -> DataFrame:
    """J1."""
    return t.locations.join(t.segments, "segment_id").select("lib_id", "segment_id", "name", "availability")


@query(f"select p.book_id, p.title, s.author_sort from v_parts p left join (select book_id, min({sql_normalize('author')}) as author_sort from v_book_authors join v_authors using (author_id) group by 1) s using (book_id)", "parts", "book_authors", "authors")
def join_author_sort(t: Tables) -> DataFrame:
    """Left join to the least author name."""
    keys = search.author_keys(t.book_authors.join(t.authors, "author_id"))
    return t.parts.join(keys, "book_id", "left").select("book_id", "title", "author_sort")


@query("select p.book_id, l.segment_id, s.availability, a.authors from v_parts p left join v_locations l on l.lib_id = p.book_id left join v_segments s using (segment_id) left join (select book_id, string_agg(author, '|' order by author_order, author) as authors from v_book_authors join v_authors using (author_id) group by 1) a on a.book_id = p.book_id", "parts", "locations", "segments", "book_authors", "authors")
def join_chain(t: Tables) -> DataFrame:
    """Book, location, segment and ordered authors in a chain of left joins."""
    named = search.ordered_names(t.book_authors.join(t.authors, "author_id"), "book_id", ["author_order"], "author", "a")
    own = t.parts.join(t.locations.withColumnRenamed("lib_id", "book_id"), "book_id", "left").join(t.segments, "segment_id", "left").join(named, "book_id", "left")
    return own.select("book_id", "segment_id", "availability", F.array_join("a", "|").alias("authors"))


@query("select s_suppkey, s_name from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R')")
def semi_join(t: Tables) -> DataFrame:
    """J5."""
    return t.supplier.join(t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti_join(t: Tables) -> DataFrame:
    """J6, J10."""
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("select distinct l.lib_id from v_locations l join v_segments s using (segment_id) where exists (select 1 from v_deletions d join v_segments x on x.segment_id = d.segment_id where d.lib_id = l.lib_id and x.availability = 'available' and x.segment_order > s.segment_order)", "locations", "segments", "deletions")
def later_tombstones(t: Tables) -> DataFrame:
    """J7."""
    return reconcile.suppressed(t.locations, t.deletions, t.segments)


DIFF = "select coalesce(o.segment_id, n.segment_id) as segment_id, case when o.segment_id is null then 'added' when n.segment_id is null then 'removed' when o.fingerprint = n.fingerprint then 'unchanged' else 'changed' end as change from v_old_segments o full join v_new_segments n on o.segment_id = n.segment_id"


@query(DIFF, "old_segments", "new_segments")
def segment_diff(t: Tables) -> DataFrame:
    """J8."""
    return reconcile.segment_changes(t.old_segments, t.new_segments, "segment_id", "fingerprint")


@query("select d.doc_id, case when d.text like '%!!%' and p.p_name not like '%!!%' then p.p_name else d.text end as title, coalesce(nullif(d.lang, 'en'), p.p_type) as language, d.text like '%!!%' as title_fallback, d.lang = 'en' as language_fallback from documents d join part p on p.p_partkey = d.doc_id")
def field_fallback(t: Tables) -> DataFrame:
    """A payload's field, or the record's where it is unusable, with flags."""
    both = t.documents.join(t.part, F.col("p_partkey") == F.col("doc_id"))
    bad = F.contains("text", F.lit("!!"))
    title = F.when(bad & ~F.contains("p_name", F.lit("!!")), F.col("p_name")).otherwise(F.col("text"))
    return both.select("doc_id", title.alias("title"), F.coalesce(F.nullif("lang", F.lit("en")), "p_type").alias("language"), bad.alias("title_fallback"), (F.col("lang") == "en").alias("language_fallback"))


@query("select w.id, w.source from v_warnings w where w.scan_id = (select max(scan_id) from v_warnings)", "warnings")
def latest_scan_warnings(t: Tables) -> DataFrame:
    """Warnings of the last scan."""
    return t.warnings.join(F.broadcast(t.warnings.agg(F.max("scan_id").alias("scan_id"))), "scan_id").select("id", "source")  # one row


# --- aggregations ------------------------------------------------------------------------------------------------


@query(f"select count(*) as n from v_books where {_has(WORDS, 'un')}", "books")
def result_count(t: Tables) -> DataFrame:
    """A1."""
    return search.search_postings(t.postings(), "book_id", ["un"], ["description"]).agg(F.count("*").alias("n"))


@query(f"select language, count(*) as n, row_number() over (order by translate(language, {UP}, {LOW}), language) as pos from v_books where {_has(WORDS, 'on')} and language <> '' group by language", "books")
def language_facet(t: Tables) -> DataFrame:
    """A2, O7."""
    return search.facet(search.search_postings(t.postings(), "book_id", ["on"], ["description"]).join(t.books.select("book_id", "language"), "book_id"), "language", "book_id")


@query(f"select genre, count(distinct book_id) as n, row_number() over (order by translate(genre, {UP}, {LOW}), genre) as pos from v_parts where {_has(TITLE_WORDS, 's')} group by genre", "parts")
def genre_facet(t: Tables) -> DataFrame:
    """A3."""
    return search.facet(search.match_tokens(t.parts, "s", ["title"]), "genre", "book_id")


@query(f"select 'total' as kind, '' as value, count(*) as n from v_books where {_has(WORDS, 'th')} and publisher in ('src1') and language in ('en') union all select 'language', language, count(*) from v_books where {_has(WORDS, 'th')} and publisher in ('src1') group by 2 union all select 'publisher', publisher, count(*) from v_books where {_has(WORDS, 'th')} and language in ('en') group by 2", "books")
def facet_bundle(t: Tables) -> DataFrame:
    """A4: the total and each facet without its own filter, over one text match."""
    found = search.search_postings(t.postings(), "book_id", ["th"], ["description"]).join(t.books.select("book_id", "language", "publisher"), "book_id")
    one, two = F.col("publisher") == "src1", F.col("language") == "en"
    counts = cut(found.groupBy("language", "publisher").agg(F.count("*").alias("n")), "facets")
    total = counts.agg(F.lit("total").alias("kind"), F.lit("").alias("value"), F.coalesce(F.sum(F.when(one & two, F.col("n"))), F.lit(0)).cast("long").alias("n"))
    first = counts.filter(one).groupBy(F.lit("language").alias("kind"), F.col("language").alias("value")).agg(F.sum("n").alias("n"))
    return total.unionAll(first).unionAll(counts.filter(two).groupBy(F.lit("publisher").alias("kind"), F.col("publisher").alias("value")).agg(F.sum("n").alias("n")))


@query("select count(*) as books, count(*) filter (s.availability <> 'available') as unavailable, sum(round(l.size)::bigint)::bigint as source_bytes, (select sum(p_size)::bigint from part) as cover_bytes, 0::bigint as store_bytes, (sum(round(l.size)::bigint) + (select sum(p_size) from part))::bigint as total_bytes from v_locations l join v_segments s using (segment_id)", "locations", "segments")
def catalogue_statistics(t: Tables) -> DataFrame:
    """A6."""
    placed = t.locations.join(t.segments.select("segment_id", "availability"), "segment_id").withColumn("file_size_bytes", F.round("size").cast("long"))
    return stats.catalogue_statistics(placed, t.part.select(F.col("p_size").alias("size_bytes")))


@query("select name, count(*) as total, count(*) filter (availability = 'available') as available, count(*) filter (availability <> 'available') as unavailable from v_segments group by name", "segments")
def source_overview(t: Tables) -> DataFrame:
    """A7."""
    return stats.source_overview(t.segments, "name")


@query("select count(*) as files, sum(s)::bigint as bytes from (select p_name, max(p_size) as s from part group by 1)")
def distinct_archives(t: Tables) -> DataFrame:
    """A8, A21."""
    return stats.distinct_files(t.part, "p_name", "p_size")


@query("select p_brand, count(*) as reference_count, max(p_size) as size_bytes from part group by 1")
def cover_references(t: Tables) -> DataFrame:
    """A9."""
    return stats.cover_references(t.part, "p_brand", "p_size")


@query("select sum(p_size)::bigint as used, sum(p_size) <= 100000 as within from part")
def cover_budget(t: Tables) -> DataFrame:
    """A10."""
    return stats.budget(t.part.select(F.col("p_size").alias("size_bytes")), 100_000)


@query("select l_orderkey, count(*) as records, count(*) filter (l_quantity >= 5) as parsed, count(*) filter (l_quantity >= 5 and l_returnflag = 'R') as deleted, count(*) filter (l_quantity < 5) as skipped from lineitem group by 1")
def segment_counts(t: Tables) -> DataFrame:
    """A11."""
    return stats.segment_counts(t.lineitem, "l_orderkey", F.col("l_returnflag") == "R", F.col("l_quantity") < 5)


ORIGIN = "r as (select l_orderkey as segment_id, case when d.change = 'unchanged' then 'reused' else 'parsed' end as origin from lineitem join d on d.segment_id = l_orderkey where d.change <> 'removed')"


@query(f", d as ({DIFF}), {ORIGIN} select (select count(*) from d where change = 'added') as segments_added, (select count(*) from d where change = 'changed') as segments_changed, (select count(*) from d where change = 'unchanged') as segments_unchanged, (select count(*) from d where change = 'removed') as segments_removed, (select count(*) from r where origin = 'reused') as records_reused, (select count(*) from r where origin = 'parsed') as records_parsed", "old_segments", "new_segments")
def scan_counters(t: Tables) -> DataFrame:
    """A12."""
    changes = reconcile.segment_changes(t.old_segments, t.new_segments, "segment_id", "fingerprint")
    lines = t.lineitem.select(F.col("l_orderkey").alias("segment_id")).join(changes.filter("change <> 'removed'"), "segment_id")
    return reconcile.scan_counters(changes, lines.select("segment_id", F.when(F.col("change") == "unchanged", "reused").otherwise("parsed").alias("origin")))


@query("select count(*) filter (text like '%!!%') as title_fallbacks, count(*) filter (lang = 'en') as language_fallbacks, count(*) filter (text like '%!!%' or lang = 'en') as books_with_fallback from documents")
def fallback_counters(t: Tables) -> DataFrame:
    """A13."""
    flags = {"title": F.contains("text", F.lit("!!")), "language": F.col("lang") == "en"}
    return stats.fallback_counters(t.documents, flags)


@query("select l_orderkey, sha256(string_agg(strlen(name)::varchar || ':' || name || ':' || l_quantity::bigint::varchar || ':' || l_suppkey::varchar || chr(10), '' order by name, l_quantity::bigint, l_suppkey)) as fingerprint from (select *, 'entry' || l_linenumber::varchar as name from lineitem) group by 1")
def manifest_fingerprint(t: Tables) -> DataFrame:
    """A14."""
    rows = t.lineitem.select("l_orderkey", F.concat(F.lit("entry"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_quantity").cast("long").alias("size"), F.col("l_suppkey").alias("crc"))
    return stats.manifest_fingerprint(rows, "l_orderkey", "name", "size", "crc")


@query(f"select conv_id, string_agg({sql_normalize('text')}, ' ' order by turn) as document from conversations where {sql_normalize('text')} <> '' group by 1")
def search_documents(t: Tables) -> DataFrame:
    """A15."""
    return stats.search_document(t.conversations, "conv_id", "text", F.col("turn"))


@query("select stage, count(*) as calls, round(sum(elapsed_ms), 2) as total_ms, round(sum(elapsed_ms) / count(*), 2) as mean_ms, rank() over (order by sum(elapsed_ms) desc, stage)::int as rank from v_stages group by 1", "stages")
def stage_timing(t: Tables) -> DataFrame:
    """A16."""
    own = stats.stage_timing(t.stages, [], "stage", "elapsed_ms")
    return own.select("stage", "calls", F.round("total_ms", 2).alias("total_ms"), F.round("mean_ms", 2).alias("mean_ms"), "rank")


@query("select stage, count(*) as items, round(case when epoch_us(max(ts)) > epoch_us(min(ts)) then count(*) * 1000000 / (epoch_us(max(ts)) - epoch_us(min(ts))) else 0 end, 6) as per_second, (sum(round(elapsed_ms)::bigint) * 100 // sum(sum(round(elapsed_ms)::bigint)) over ())::int as percent from v_stages group by 1", "stages")
def stage_throughput(t: Tables) -> DataFrame:
    """Items a second, and the whole percent of the time."""
    shares = stats.stage_timing(t.stages.withColumn("elapsed_ms", F.round("elapsed_ms").cast("long")), [], "stage", "elapsed_ms").select("stage", "percent")
    return stats.throughput(t.stages, ["stage"], "ts").withColumn("per_second", F.round("per_second", 6)).join(shares, "stage")


@query("select archive, stage, count(*) as calls, sum(round(elapsed_ms)::bigint)::bigint as total_ms, (sum(round(elapsed_ms)::bigint) * 100 // sum(sum(round(elapsed_ms)::bigint)) over (partition by archive))::int as percent, rank() over (partition by archive order by sum(round(elapsed_ms)::bigint) desc, stage)::int as rank from v_stages group by 1, 2 having sum(round(elapsed_ms)::bigint) > 0", "stages")
def archive_stage_timing(t: Tables) -> DataFrame:
    """A17."""
    own = t.stages.withColumn("elapsed_ms", F.round("elapsed_ms").cast("long"))
    out = stats.stage_timing(own, ["archive"], "stage", "elapsed_ms").drop("mean_ms")
    return out.filter("total_ms > 0")


@query("select event_id, stage, elapsed_ms from v_stages where elapsed_ms >= 400", "stages")
def slow_items(t: Tables) -> DataFrame:
    """A18."""
    return stats.outliers(t.stages, "elapsed_ms", 400).select("event_id", "stage", "elapsed_ms")


@query("select distinct p_type as name, dense_rank() over (order by p_type) as pos from part")
def known_genres(t: Tables) -> DataFrame:
    """A19."""
    return search.ranked(t.part.select(F.col("p_type").alias("name")).distinct(), [F.col("name")])


AVAILABLE = "select l.lib_id, case when l.present_in_segment and s.availability = 'available' and coalesce(m.last, -1) <= s.segment_order then 'available' else 'missing_from_index' end as availability from v_locations l left join v_segments s using (segment_id) left join (select d.lib_id, max(x.segment_order) as last from v_deletions d join v_segments x on x.segment_id = d.segment_id where x.availability = 'available' group by 1) m on m.lib_id = l.lib_id"


@query(f", a as ({AVAILABLE}), o as (select l.lib_id, s.availability as old from v_locations l join v_segments s using (segment_id)) select count(*) filter (old = 'available' and availability <> 'available') as retired, count(*) filter (old <> 'available' and availability = 'available') as restored, count(*) filter (old <> availability) as changed from o join a using (lib_id)", "locations", "segments", "deletions")
def availability_flips(t: Tables) -> DataFrame:
    """A20."""
    old = t.locations.join(t.segments, "segment_id").select("lib_id", "availability")
    return reconcile.flips(old, reconcile.availability(t.locations, t.deletions, t.segments))


# --- orders and pages --------------------------------------------------------------------------------------------


@query(f"select book_id, row_number() over (order by {NORM_TITLE}, title, book_id) as pos from v_books", "books")
def sort_title(t: Tables) -> DataFrame:
    """O1."""
    return search.ranked(search.with_title_key(t.books.select("book_id", "title")), search.order_of("title"), keep=["book_id"]).select("book_id", "pos")


@query(f"select p.book_id, row_number() over (order by s.author_sort desc nulls last, {sql_normalize('p.title')}, p.book_id) as pos from v_parts p left join (select book_id, min({sql_normalize('author')}) as author_sort from v_book_authors join v_authors using (author_id) group by 1) s using (book_id)", "parts", "book_authors", "authors")
def sort_author(t: Tables) -> DataFrame:
    """O2."""
    own = t.parts.join(search.author_keys(t.book_authors.join(t.authors, "author_id")), "book_id", "left")
    return search.ranked(search.with_title_key(own.select("book_id", "title", "author_sort")), search.order_of("author", False), keep=["book_id"]).select("book_id", "pos")


@query("select o_orderkey as book_id, row_number() over (order by o_orderdate desc, lower(o_orderpriority), o_orderkey) as pos from orders")
def sort_added(t: Tables) -> DataFrame:
    """O3."""
    own = t.orders.select(F.col("o_orderkey").alias("book_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("added_at"))
    return search.ranked(search.with_title_key(own), search.order_of("added", False), keep=["book_id"]).select("book_id", "pos")


@query(f"select * from (select book_id, title, row_number() over (order by {NORM_TITLE}, title, book_id) as pos from v_books) where pos > 50 and pos <= 100", "books")
def page_offset(t: Tables) -> DataFrame:
    """The second page of fifty."""
    return search.page(search.with_title_key(t.books.select("book_id", "title")), search.order_of("title"), 50, 50).withColumn("pos", F.col("pos").cast("long"))


@query(f"select * from (select book_id, row_number() over (order by {NORM_TITLE} desc, title, book_id) as pos from v_books where language = 'en') where pos > 100 and pos <= 150", "books")
def page_cursor(t: Tables) -> DataFrame:
    """A slice of the ranking; operators.search publishes it for a snapshot."""
    own = search.ranked(search.with_title_key(t.books.filter("language = 'en'").select("book_id", "title")), search.order_of("title", False), keep=["book_id"])
    return own.filter("pos > 100 and pos <= 150").select("book_id", "pos")


@query("select conv_id, string_agg(role, '>' order by turn) as roles from conversations group by 1")
def ordered_relation(t: Tables) -> DataFrame:
    """O6."""
    own = search.ordered_names(t.conversations, "conv_id", ["turn"], "role", "r")
    return own.select("conv_id", F.array_join("r", ">").alias("roles"))


@query("select id, source, row_number() over (order by id desc)::int as pos from v_warnings qualify pos <= 5", "warnings")
def latest_warnings(t: Tables) -> DataFrame:
    """A report of five."""
    return stats.latest(t.warnings, "id", 5).select("id", "source", "pos")


@query("select id, scan_id from v_warnings where scan_id in (select scan_id from v_warnings group by 1 order by max(id) desc limit 10)", "warnings")
def retained_warnings(t: Tables) -> DataFrame:
    """The ten latest scans' warnings stay."""
    return stats.retain_latest(t.warnings, "scan_id", "id").select("id", "scan_id")


@query("select l_orderkey, l_linenumber, l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber)::int as step from lineitem")
def work_order(t: Tables) -> DataFrame:
    """Work dealt by archive, in order within it."""
    step = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", step.alias("step"))


@query("select segment_id from v_old_segments except select segment_id from v_new_segments", "old_segments", "new_segments")
def removed_segments(t: Tables) -> DataFrame:
    """U1."""
    return t.old_segments.select("segment_id").join(t.new_segments, "segment_id", "left_anti")


# --- sinks and merges --------------------------------------------------------------------------------------------


@query("select segment_id, fingerprint from v_new_segments union all select segment_id, fingerprint from v_old_segments where segment_id not in (select segment_id from v_new_segments)", "old_segments", "new_segments")
def upsert_segments(t: Tables) -> DataFrame:
    """K2, K3."""
    return model.upsert(t.old_segments, t.new_segments, ["segment_id"])


@query("select coalesce(o.o_orderkey, n.o_orderkey) as segment_id, coalesce(o.o_orderdate, timestamp '2026-01-01') as added_at, o.o_orderkey is null as is_new, coalesce(n.o_totalprice, o.o_totalprice) as price from (select * from orders where o_orderkey % 10 <> 0) o full join (select o_orderkey, o_totalprice * 2 as o_totalprice from orders where o_orderkey % 10 <> 1) n on o.o_orderkey = n.o_orderkey")
def merge_books(t: Tables) -> DataFrame:
    """K4."""
    base = t.orders.select(F.col("o_orderkey").alias("segment_id"), F.col("o_orderdate").alias("added_at"), F.col("o_totalprice").alias("price"))
    new = base.filter("segment_id % 10 <> 1").select("segment_id", (F.col("price") * 2).alias("price"))
    return model.merge_books(base.filter("segment_id % 10 <> 0"), new, "segment_id", ["price"], F.lit("2026-01-01").cast("timestamp"))


@query(f"select n as normalized_name, arg_min(text, doc_id) as display_name from (select text, doc_id, {sql_normalize('text')} as n from documents) where n <> '' group by 1")
def resolve_dimension(t: Tables) -> DataFrame:
    """K5: the first display name of each key wins."""
    names = t.documents.select(F.col("text").alias("name"), "doc_id")
    old = names.select(F.lit("").alias("normalized_name"), F.lit("").alias("display_name")).limit(0)
    return model.resolve_dimension(old, names, "doc_id")


@query(f"select doc_id, normalized_name, min(ord)::int as ord from (select doc_id, {sql_normalize('w.name')} as normalized_name, w.ord - 1 as ord from (select doc_id, unnest(list_zip(string_split(text, ' '), range(1, 1 + len(string_split(text, ' ')))), recursive := false) as z from documents) x, lateral (select z[1] as name, z[2] as ord) w) where normalized_name <> '' group by 1, 2")
def bridge_rows(t: Tables) -> DataFrame:
    """K6: names of the list of a text's words."""
    return model.bridge(t.documents.select("doc_id", F.split("text", " ").alias("names")), "doc_id", "names")


@query("select book_id, author_id from v_book_authors where book_id % 3 <> 0 union all select book_id, author_id + 1000000 from v_book_authors where book_id % 3 = 0", "book_authors")
def replace_relations(t: Tables) -> DataFrame:
    """K7."""
    own = t.book_authors.select("book_id", "author_id")
    changed = t.part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("book_id"))
    fresh = own.filter("book_id % 3 = 0").select("book_id", (F.col("author_id") + 1000000).alias("author_id"))
    return model.replace_owned(own, fresh, "book_id", changed)


@query("select id, scan_id from v_warnings qualify row_number() over (partition by scan_id order by id) <= 50", "warnings")
def capped_warnings(t: Tables) -> DataFrame:
    """K8: the cap is the feature."""
    return model.cap_log(t.warnings, "scan_id", "id", 50).select("id", "scan_id")


@query("select sha[1:2] || '/' || sha || '.' || min(lang) as path, sha, max(strlen(text))::bigint as size_bytes from (select sha256(text) as sha, lang, text from documents) group by sha")
def content_store(t: Tables) -> DataFrame:
    """K9, T25."""
    return model.content_store(t.documents, "text", F.col("lang"))


@query("select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity = 50)")
def cover_collection(t: Tables) -> DataFrame:
    """Contents that a book still names."""
    used = t.lineitem.filter("l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return model.referenced(t.supplier, used, "s_suppkey").select("s_suppkey", "s_name")


@query("""select book_id, '{"book_id":' || book_id::varchar || ',"language":' || case when language = 'en' then 'null' else '"' || language || '"' end || ',"publisher":"' || publisher || '"}' as document from v_books""", "books")
def json_documents(t: Tables) -> DataFrame:
    """Explicit nulls."""
    return t.books.withColumn("language", F.nullif("language", F.lit("en"))).select("book_id", model.to_document(["book_id", "language", "publisher"]).alias("document"))


@query("select l.lib_id, case when s.availability <> 'available' then 'unavailable' when l.lib_id % 11 = 0 then 'source-changed' when l.lib_id % 7 = 0 then 'archive-changed' when l.lib_id % 5 = 0 then 'manifest-changed' when l.size < 2000 then 'size-mismatch' else 'ready' end as status from v_locations l join v_segments s using (segment_id)", "locations", "segments")
def export_status(t: Tables) -> DataFrame:
    """Guards in the order of their checks."""
    own = t.locations.join(t.segments.select("segment_id", "availability"), "segment_id")
    own = own.withColumns({"source_ok": F.col("lib_id") % 11 != 0, "archive_ok": F.col("lib_id") % 7 != 0, "manifest_ok": F.col("lib_id") % 5 != 0, "size_ok": F.col("size") >= 2000})
    return own.select("lib_id", model.export_status(own).alias("status"))


@query("select archive_no, string_agg(line, chr(10) order by rn) as content, count(*) as n from (select *, ((rn + 99) // 100)::bigint as archive_no from (select row_number() over (order by p_name, p_partkey) as rn, p_name || chr(4) || p_type || chr(4) || p_partkey::varchar as line from part)) group by 1")
def inp_lines(t: Tables) -> DataFrame:
    """K13."""
    return model.inp_lines(t.part, ["p_name", "p_partkey"], [F.col("p_name"), F.col("p_type"), F.col("p_partkey").cast("string")], 100)


# --- lines and fields --------------------------------------------------------------------------------------------


@query("select doc_id, (i - 1)::int + 1 as line_no, md5(line) as digest from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where line <> ''")
def text_lines(t: Tables) -> DataFrame:
    """Numbered lines, empty ones left out."""
    from lectern.sources.inpx import lines

    own = lines(t.documents.select("doc_id", "text"), "text")
    return own.select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("digest"))


@query("select event_type as archive_name, row_number() over (order by min(event_id))::int as pos from events group by 1 qualify pos <= 3")
def archive_sample(t: Tables) -> DataFrame:
    """The first three distinct names, in order."""
    return archives.first_names(t.events.select(F.col("event_type").alias("archive"), "event_id"), "event_id", 3).select(F.col("archive").alias("archive_name"), "pos")


@query("select c.n_nationkey as candidate, count(distinct s_suppkey % 50) filter (s_suppkey % 50 in (select p_size from part)) as found from nation c left join supplier s on s.s_nationkey = c.n_nationkey group by 1 order by found desc, candidate limit 1")
def candidate_roots(t: Tables) -> DataFrame:
    """The candidate that holds most of the samples; the first of equals."""
    samples = t.part.select(F.col("p_size").cast("long").alias("archive")).distinct()  # fifty sizes
    candidates = t.nation.select(F.col("n_nationkey").alias("candidate"), F.col("n_nationkey").alias("ord"))
    return archives.best_root(samples, candidates, t.supplier.select(F.col("s_nationkey").alias("candidate"), (F.col("s_suppkey") % 50).alias("archive")))


@query("select p_partkey as archive, (select min(case when l_linenumber = 1 then '' else 'f' || l_suppkey end) from lineitem where l_partkey = p_partkey) as folder from part")
def archive_resolution(t: Tables) -> DataFrame:
    """The root's own file first, else the first folder in order."""
    folder = F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")))
    return archives.resolve_archives(t.part.select(F.col("p_partkey").alias("archive")), t.lineitem.select(F.col("l_partkey").alias("archive"), folder.alias("folder")))


@query(f"select doc_id, md5({sql_normalize('text')}) as digest from documents")
def normalised_text(t: Tables) -> DataFrame:
    """T1-T3."""
    return t.documents.select("doc_id", F.md5(normalize(F.col("text")).cast("binary")).alias("digest"))


@query(f"select page_id, translate(url, {UP}, {LOW}) as lowered, ends_with(translate(url, {UP}, {LOW}), 'top') as top from pages")
def ascii_case(t: Tables) -> DataFrame:
    """T9."""
    return t.pages.select("page_id", X.lower_ascii(F.col("url")).alias("lowered"), X.ends_with_ascii(F.col("url"), "TOP").alias("top"))


@query("select conv_id, turn, md5(regexp_replace(text, '^[\\x01-\\x20]+|[\\x01-\\x20]+$', '', 'g')) as digest, nullif(regexp_replace(substr(text, 3, 1), '^[\\x01-\\x20]+|[\\x01-\\x20]+$', '', 'g'), '') as third from conversations")
def trimmed_text(t: Tables) -> DataFrame:
    """T10."""
    return t.conversations.select("conv_id", "turn", F.md5(X.trim_ascii(F.col("text")).cast("binary")).alias("digest"), X.blank_to_null(F.substring("text", 3, 1)).alias("third"))


def _language_sql(x: str) -> str:
    table = "map {" + ", ".join(f"{sql_text(k)}: {sql_text(v)}" for k, v in X.language_map().items()) + "}"
    first = f"translate({sql_normalize(f'regexp_extract(translate({sql_normalize(x)}, chr(95), chr(45)), {sql_text("^[^,;/+]*")})')}, '_', '-')"
    return f"coalesce({table}[{first}], case when contains({first}, '-') then {table}[split_part({first}, '-', 1)] end, {first})"


@query(f"select doc_id, {_language_sql('raw')} as language from (select doc_id, case doc_id % 5 when 0 then upper(lang) || '_XX' when 1 then ' ' || lang || ', en' when 2 then 'Rus' when 3 then 'qqq-' || lang else lang end as raw from documents)")
def language_codes(t: Tables) -> DataFrame:
    """T11."""
    lang, k = F.col("lang"), F.col("doc_id") % 5
    raw = F.when(k == 0, F.concat(F.upper(lang), F.lit("_XX"))).when(k == 1, F.concat(F.lit(" "), lang, F.lit(", en"))).when(k == 2, "Rus").when(k == 3, F.concat(F.lit("qqq-"), lang)).otherwise(lang)
    return t.documents.select("doc_id", X.normalize_language(raw).alias("language"))


_TEN = " + ".join(f"(case when s[{i + 1}] = 'X' then 10 else try_cast(s[{i + 1}] as int) end) * {10 - i}" for i in range(10))
_THIRTEEN = " + ".join(f"try_cast(s[{i + 1}] as int) * {1 if i % 2 == 0 else 3}" for i in range(13))


@query(f"select id, case when regexp_full_match(s, '[0-9]{{9}}[0-9X]') then case when ({_TEN}) % 11 = 0 then s end when regexp_full_match(s, '[0-9]{{13}}') then case when ({_THIRTEEN}) % 10 = 0 then s end end as isbn from (select event_id as id, upper(regexp_replace(case when event_id % 2 = 0 then '978-' || lpad((event_id * 7919 % 10000000000)::varchar, 10, '0') else lpad((event_id * 104729 % 1000000000)::varchar, 9, '0') || case when event_id % 3 = 0 then 'x' else (event_id % 10)::varchar end end, '[^0-9xX]', '', 'g')) as s from events)")
def isbn_numbers(t: Tables) -> DataFrame:
    """T12."""
    i = F.col("event_id")
    long = F.concat(F.lit("978-"), F.lpad((i * 7919 % 10000000000).cast("string"), 10, "0"))
    short = F.concat(F.lpad((i * 104729 % 1000000000).cast("string"), 9, "0"), F.when(i % 3 == 0, "x").otherwise((i % 10).cast("string")))
    return t.events.select(i.alias("id"), X.normalize_isbn(F.when(i % 2 == 0, long).otherwise(short)).alias("isbn"))


GENRES = {"standard": "Standard fiction", "promo": "Promotion", "small_poetry": "Poetry"}
_NAMES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in GENRES.items()) + "}"


@query(f"select p_partkey, case p_partkey % 4 when 0 then {_NAMES}[lower(p_type)] when 1 then {_NAMES}[lower(p_type)] when 2 then 'Poetry' else {_NAMES}[lower(p_type)] end is not null as known, coalesce(case when p_partkey % 4 = 2 then 'Poetry' else {_NAMES}[lower(p_type)] end, case p_partkey % 4 when 0 then '  ' || lower(p_type) || ' ' when 1 then '(' || lower(p_type) || ')' else lower(p_type) || ' История' end) as genre from part")
def genre_names(t: Tables) -> DataFrame:
    """Codes with noise around them."""
    low, k = F.lower("p_type"), F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("  "), low, F.lit(" "))).when(k == 1, F.concat(F.lit("("), low, F.lit(")"))).when(k == 2, "small-poetry").otherwise(F.concat(low, F.lit(" История")))
    names = F.create_map(*[F.lit(x) for pair in GENRES.items() for x in pair])
    return t.part.select("p_partkey", X.resolve_genre(raw, names).alias("g")).select("p_partkey", F.col("g.known").alias("known"), F.col("g.name").alias("genre"))


@query("select doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> ''), '|') as genres from documents")
def split_genres(t: Tables) -> DataFrame:
    """T14."""
    return t.documents.select("doc_id", F.array_join(X.split_genres(F.array("text")), "|").alias("genres"))


@query("select c_custkey, case when c_custkey % 4 = 3 then null else concat_ws(' ', 'First', case when c_custkey % 4 = 2 then 'Middle' end, c_name) end as display from customer")
def inpx_authors(t: Tables) -> DataFrame:
    """T15."""
    k = F.col("c_custkey") % 4
    raw = F.concat(F.col("c_name"), F.when(k == 2, ",First, Middle").when(k == 3, ",First,Middle,More").when(k == 1, ", First , ").otherwise(",First"))
    return t.customer.select("c_custkey", X.author_from_inpx(raw).getField("display").alias("display"))


@query("select doc_id, contains(text, '###') as has_mark, lang = 'en' as is_anonymous from documents")
def replacement_marks(t: Tables) -> DataFrame:
    """U+FFFD put for ### first."""
    marked = F.replace("text", F.lit("###"), F.lit("�"))
    authors = F.array(F.when(F.col("lang") == "en", X.ANONYMOUS).otherwise("someone"))
    return t.documents.select("doc_id", X.has_replacement(marked).alias("has_mark"), X.is_anonymous(authors).alias("is_anonymous"))


@query("select event_id, case when regexp_full_match(raw, '-?[0-9]+') then try_cast(raw as int) end as n from (select event_id, case event_id % 4 when 0 then event_id::varchar when 1 then '-' || event_id::varchar when 2 then ' 7 ' else '+7' end as raw from events)")
def strict_numbers(t: Tables) -> DataFrame:
    """T19."""
    i = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, i).when(F.col("event_id") % 4 == 1, F.concat(F.lit("-"), i)).when(F.col("event_id") % 4 == 2, " 7 ").otherwise("+7")
    return t.events.select("event_id", X.strict_int(raw).alias("n"))


@query("select page_id, regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '\\.inp$', '', 'i') || '.zip' as archive, page_id::varchar || '.fb2' as entry from pages")
def archive_names(t: Tables) -> DataFrame:
    """T23."""
    return t.pages.select("page_id", X.archive_name(F.col("url")).alias("archive"), X.entry_name(F.col("page_id").cast("string"), F.lit("")).alias("entry"))


@query("select page_id, not contains(url, '..') and page_id % 4 <> 0 as safe from pages")
def safe_paths(t: Tables) -> DataFrame:
    """What leaves the root isn't safe; what goes up and stays below it is."""
    lead = F.when(F.col("page_id") % 4 == 0, "../").when(F.col("page_id") % 4 == 1, "a/../").when(F.col("page_id") % 4 == 2, "./b/../c/").otherwise("a/")
    path = F.concat(lead, F.regexp_replace("url", "^https?://", ""))
    return t.pages.select("page_id", X.is_safe_path(path).alias("safe"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp, date_trunc('second', ts) as parsed from events")
def timestamps(t: Tables) -> DataFrame:
    """T28."""
    stamp = X.format_time(F.col("ts"))
    return t.events.select("event_id", stamp.alias("stamp"), X.parse_time(stamp).alias("parsed"))


_SAFE = "regexp_replace(regexp_replace(text, '[\\\\/:*?\"<>|\\x01-\\x1F]', '_', 'g'), ' +$', '')"
_CUT = ", ".join(f"try(decode(encode(s)[1:{n}]))" for n in (240, 239, 238, 237))


@query(f"select doc_id, coalesce(nullif(regexp_replace(case when strlen(s) > 240 then coalesce({_CUT}) else s end, ' +$', ''), ''), 'book') as name from (select doc_id, {_SAFE} as s from documents)")
def file_names(t: Tables) -> DataFrame:
    """The cut at 240 bytes is the feature."""
    return t.documents.select("doc_id", X.safe_file_name(F.col("text"), 240, "book").alias("name"))


@query("select l_orderkey, l_linenumber, case when l_linenumber = 7 then 0 else least(99, floor(l_linenumber * 100 / 6))::int end as percent from lineitem")
def progress_percent(t: Tables) -> DataFrame:
    """T30."""
    total = F.when(F.col("l_linenumber") == 7, 0).otherwise(6)
    return t.lineitem.select("l_orderkey", "l_linenumber", X.percent(F.col("l_linenumber"), total).alias("percent"))


@query("select event_id, coalesce(coalesce(e, a) || ': ' || event_type, event_type) as message, coalesce(a || '!' || e, e, a, '<inpx>') as label, case when a is null and e is null then event_type else concat_ws(' :: ', a, e) || ' — ' || event_type end as line from (select *, case when event_id % 2 = 0 then 'archive' end as a, case when event_id % 3 = 0 then 'entry' end as e from events)")
def warning_texts(t: Tables) -> DataFrame:
    """T31."""
    a, e, m = F.when(F.col("event_id") % 2 == 0, "archive"), F.when(F.col("event_id") % 3 == 0, "entry"), F.col("event_type")
    return t.events.select("event_id", X.warning_message(a, e, m).alias("message"), X.warning_label(a, e).alias("label"), X.warning_text(a, e, m).alias("line"))


@query("select p_partkey, case when w <= 400 and h <= 600 then w else greatest(1, floor(w * least(400.0::double / w, 600.0::double / h) + 0.5)::int) end as width, case when w <= 400 and h <= 600 then h else greatest(1, floor(h * least(400.0::double / w, 600.0::double / h) + 0.5)::int) end as height from (select p_partkey, case when w <= 456 and h <= 684 then w else greatest(1, floor(w * least(456.0::double / w, 684.0::double / h) + 0.5)::int) end as w, case when w <= 456 and h <= 684 then h else greatest(1, floor(h * least(456.0::double / w, 684.0::double / h) + 0.5)::int) end as h from (select p_partkey, p_size * 31 as w, p_size * 17 + 100 as h from part))")
def cover_sizes(t: Tables) -> DataFrame:
    """T33."""
    return t.part.select("p_partkey", X.fit_size(F.col("p_size") * 31, F.col("p_size") * 17 + 100).alias("s")).select("p_partkey", "s.width", "s.height")


# --- quality -----------------------------------------------------------------------------------------------------


@query("select 'orders.customer' as relation, o_custkey::varchar as key from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0) group by 2 union all select 'lineitem.part', l_partkey::varchar from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 7 <> 0) group by 2")
def foreign_key_check(t: Tables) -> DataFrame:
    """Q2."""
    customers, parts = t.customer.filter("c_custkey % 10 <> 0"), t.part.filter("p_partkey % 7 <> 0")
    return quality.foreign_keys([quality.dangling(t.orders, "o_custkey", customers, "c_custkey", "orders.customer"), quality.dangling(t.lineitem, "l_partkey", parts, "p_partkey", "lineitem.part")])


@query("select 'book.location' as relation, p_partkey::varchar as key from part where p_partkey not in (select l_partkey from lineitem where l_linenumber = 1)")
def location_check(t: Tables) -> DataFrame:
    """Q3."""
    return quality.dangling(t.part, "p_partkey", t.lineitem.filter("l_linenumber = 1"), "l_partkey", "book.location")


@query("select count(*) as n, min(r_regionkey) as least, max(r_regionkey) as most, count(*) filter (trim(r_name) = '') as blank, coalesce(count(*) = 1 and min(r_regionkey) = 1 and max(r_regionkey) = 1 and count(*) filter (trim(r_name) = '') = 0, false) as ok from region")
def singleton_check(t: Tables) -> DataFrame:
    """Q4."""
    return quality.singleton(t.region, "r_regionkey", ["r_name"])


@query("select 'quantity' as rule, l_orderkey::varchar as key from lineitem where l_quantity > 45 union all select 'flag', l_orderkey::varchar from lineitem where l_returnflag not in ('A', 'N')")
def row_checks(t: Tables) -> DataFrame:
    """Q5, Q8."""
    return quality.violations(t.lineitem, "l_orderkey", {"quantity": F.col("l_quantity") <= 45, "flag": F.col("l_returnflag").isin("A", "N")})


@query("select p_name, p_brand, count(*) as n from part group by 1, 2 having count(*) > 1")
def unique_keys(t: Tables) -> DataFrame:
    """Q6, Q9."""
    return quality.duplicates(t.part, ["p_name", "p_brand"])


@query("select l_partkey as lib_id, count(*) as n from lineitem where l_returnflag <> 'R' group by 1 having count(*) > 1")
def duplicate_active_ids(t: Tables) -> DataFrame:
    """Q7."""
    return quality.duplicates(t.lineitem.filter("l_returnflag <> 'R'").select(F.col("l_partkey").alias("lib_id")), ["lib_id"])


@query("select o_custkey, count(distinct o_orderstatus || o_orderpriority) as states from orders group by 1 having count(distinct o_orderstatus || o_orderpriority) > 1")
def archive_guards(t: Tables) -> DataFrame:
    """Q11."""
    return quality.disagreement(t.orders, "o_custkey", ["o_orderstatus", "o_orderpriority"])


# --- incremental -------------------------------------------------------------------------------------------------


@query(f", d as ({DIFF}) select l_orderkey as segment_id, l_linenumber, case when d.change = 'unchanged' then 'reused' else 'parsed' end as origin from lineitem join d on d.segment_id = l_orderkey where d.change <> 'removed'", "old_segments", "new_segments")
def rescan(t: Tables) -> DataFrame:
    """ST1, U2: rows of unchanged segments are kept, those of added and changed ones read again."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("segment_id"), "l_linenumber")
    changes = reconcile.segment_changes(t.old_segments, t.new_segments, "segment_id", "fingerprint")
    return reconcile.reconcile(rows, rows, changes)


@query("select n.segment_id, case when o.segment_id is null then 'added' when step = 'parse' then 'changed' else 'unchanged' end as change, step from (select n.o_orderkey as segment_id, case when o.o_orderkey is null or n.inp <> o.o_orderstatus or o.o_orderstatus = 'P' then 'parse' when o.o_orderkey % 3 = 0 then 'same-text' when o.o_orderkey % 5 <> 0 then 'same-stat' when o.o_orderkey % 2 = 0 then 'same-manifest' else 'parse' end as step from (select *, case when o_orderkey % 7 = 0 then 'x' else o_orderstatus end as inp from orders where o_orderkey % 10 <> 1) n left join (select * from orders where o_orderkey % 10 <> 0) o on o.o_orderkey = n.o_orderkey) n left join (select o_orderkey as segment_id from orders where o_orderkey % 10 <> 0) o using (segment_id)")
def reuse_ladder(t: Tables) -> DataFrame:
    """ST2."""
    k = F.col("o_orderkey")
    old = t.orders.filter("o_orderkey % 10 <> 0").select(k.alias("segment_id"), F.col("o_orderstatus").alias("inp"), F.when(F.col("o_orderstatus") == "P", "missing_from_index").otherwise("available").alias("availability"), (k % 3 != 0).alias("requires_archive"), F.lit(1).alias("archive_stat"), F.lit(1).alias("manifest"))
    new = t.orders.filter("o_orderkey % 10 <> 1").select(k.alias("segment_id"), F.when(k % 7 == 0, "x").otherwise(F.col("o_orderstatus")).alias("inp"), F.when(k % 5 == 0, 2).otherwise(1).alias("archive_stat"), F.when(k % 2 == 0, 1).otherwise(2).alias("manifest"))
    return reconcile.reuse_plan(old, new, "segment_id")


@query(AVAILABLE, "locations", "segments", "deletions")
def availability(t: Tables) -> DataFrame:
    """ST3."""
    return reconcile.availability(t.locations, t.deletions, t.segments)


@query(f", d as ({DIFF}) select l.l_orderkey as segment_id, l.l_partkey as lib_id, not (d.change = 'changed' and not exists (select 1 from lineitem m where m.l_orderkey = l.l_orderkey and m.l_partkey = l.l_partkey and m.l_quantity > 20)) as present_in_segment from lineitem l join d on d.segment_id = l.l_orderkey where d.change <> 'added'", "old_segments", "new_segments")
def omitted_records(t: Tables) -> DataFrame:
    """ST5: of a changed segment, records that are gone."""
    changes = reconcile.segment_changes(t.old_segments, t.new_segments, "segment_id", "fingerprint")
    rows = t.lineitem.select(F.col("l_orderkey").alias("segment_id"), F.col("l_partkey").alias("lib_id"), "l_quantity")
    old = rows.join(changes.filter("change <> 'added'").select("segment_id"), "segment_id").select("segment_id", "lib_id")
    return reconcile.mark_absent(old, rows.filter("l_quantity > 20"), changes)


@query(f"select token, book_id from (select book_id, unnest(list_distinct({sql_tokens('title')})) as token from v_parts where book_id % 4 <> 0 union all select book_id, unnest(list_distinct({sql_tokens('genre')})) from v_parts where book_id % 4 = 0)", "parts")
def index_maintenance(t: Tables) -> DataFrame:
    """ST6: a changed book's postings are replaced."""
    index = search.postings(t.parts, "book_id", ["title"]).select("token", "book_id")
    changed = t.parts.filter("book_id % 4 = 0")
    return reconcile.update_index(index, changed, search.postings(changed, "book_id", ["genre"]).select("token", "book_id"), "book_id").select("token", "book_id")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_progress(t: Tables) -> DataFrame:
    """ST7."""
    return reconcile.latest_per_job(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f"select book_id, title, language, pos, (select count(*) from v_books where {_has(WORDS, 'th')} and language in ('en', 'de')) as total from (select *, row_number() over (order by {NORM_TITLE}, title, book_id) as pos from v_books where {_has(WORDS, 'th')} and language in ('en', 'de')) where pos <= 50", "books")
def search_page(t: Tables) -> DataFrame:
    """Flagship: a page of search results with the total."""
    hits = search.search_postings(t.postings(), "book_id", ["th"], ["description"])
    found = cut(search.filter_languages(t.books, ["en", "de"]).select("book_id", "title", "language").join(hits, "book_id"), "found")
    total = F.broadcast(found.agg(F.count("*").alias("total")))  # one row
    top = search.page(search.with_title_key(found), search.order_of("title"), 0, 50)
    return top.crossJoin(total).select("book_id", "title", "language", F.col("pos").cast("long").alias("pos"), "total")
