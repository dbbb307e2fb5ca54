"""Book payloads in XML: metadata from the description element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.fields import ANONYMOUS, annotation_text, author_name, blank_to_null, cover_extension, normalize_isbn, split_genres, strict_base64, strict_double, strict_int, trim_ascii
from lectern.functions.text import decode_declared

# Limits of the metadata part.
MAX_BYTES, MAX_NODES, MAX_ATTRIBUTES = 8 << 20, 100_000, 200_000

_PERSON = "struct<`first-name`:string,`middle-name`:string,`last-name`:string,nickname:string>"
_TITLE = f"struct<genre:array<string>,author:array<{_PERSON}>,`book-title`:string,lang:string,coverpage:struct<image:array<struct<_href:string>>>,sequence:array<struct<_name:string,_number:string>>>"
SCHEMA = f"struct<`title-info`:{_TITLE},`document-info`:struct<id:string>,`publish-info`:struct<publisher:string,year:string,isbn:string>>"


def description(text: Column) -> Column:
    """The description element alone, so that a broken or huge body does no harm."""
    return F.nullif(F.regexp_extract(text, r"(?s)<(?:[\w.-]+:)?description[\s>].*?</(?:[\w.-]+:)?description\s*>", 0), F.lit(""))


def limit_reason(part: Column) -> Column:
    return (
        F.when(F.octet_length(part) > MAX_BYTES, "metadata exceeds 8 MiB")
        .when(F.regexp_count(part, F.lit("<[A-Za-z]")) > MAX_NODES, "metadata has too many nodes")
        .when(F.regexp_count(part, F.lit(r"\s[\w:.-]+\s*=\s*[\"']")) > MAX_ATTRIBUTES, "metadata has too many attributes")
    )


def parse(payloads: DataFrame, content: str = "content", require_title: bool = True) -> DataFrame:
    """payloads with book, a struct of metadata, and reject_reason; one of them is null. Without require_title a book's title may be null.

    A book without a named author has the anonymous one. warning_count counts what was mended: the text's decoding, the
    missing author or title, an unusable year or number in a series.
    """
    decoded = payloads.withColumn("_d", decode_declared(F.col(content)))
    own = decoded.withColumns({"_text": F.col("_d.text"), "_part": description(F.col("_d.text"))}).withColumn("_limit", limit_reason(F.col("_part")))
    bare = F.regexp_replace(F.regexp_replace("_part", r"<(/?)[\w.-]+:", "<$1"), r"\s[\w.-]+:(\w+)\s*=", " $1=")
    own = own.withColumn("_x", F.from_xml(F.when(F.col("_limit").isNull(), bare), SCHEMA, {"attributePrefix": "_", "ignoreNamespace": "true"}))
    info, published = F.col("_x.title-info"), F.col("_x.publish-info")
    title = blank_to_null(info["book-title"])
    lead = F.get(info["sequence"], F.lit(0))
    year, number = blank_to_null(published["year"]), blank_to_null(lead["_number"])
    named = F.transform(info["author"], lambda a: author_name(a["first-name"], a["middle-name"], a["last-name"], a["nickname"]))
    people = F.array_compact(F.coalesce(named, F.array().cast("array<string>")))
    nobody = F.size(people) == 0
    note = F.nullif(F.regexp_extract("_part", r"(?s)<(?:[\w.-]+:)?annotation[^>]*>(.*?)</(?:[\w.-]+:)?annotation\s*>", 1), F.lit(""))
    ref = F.regexp_replace(F.get(info["coverpage"]["image"], F.lit(0))["_href"], "^#", "")
    warn = lambda bad: F.when(bad, 1).otherwise(0)
    warnings = F.col("_d.warnings") + warn(year.isNotNull() & strict_int(year).isNull()) + warn(number.isNotNull() & strict_double(number).isNull()) + warn(nobody) + warn(title.isNull())
    book = F.struct(
        title.alias("title"),
        F.when(nobody, F.array(F.lit(ANONYMOUS))).otherwise(people).alias("authors"),
        F.coalesce(blank_to_null(info["lang"]), F.lit("")).alias("language"),
        blank_to_null(lead["_name"]).alias("series"),
        strict_double(number).alias("series_index"),
        blank_to_null(published["publisher"]).alias("publisher"),
        strict_int(year).alias("year"),
        normalize_isbn(published["isbn"]).alias("isbn"),
        F.coalesce(split_genres(info["genre"]), F.array().cast("array<string>")).alias("genres"),
        F.nullif(annotation_text(note), F.lit("")).alias("description"),
        blank_to_null(F.col("_x.document-info")["id"]).alias("identifier"),
        ref.alias("cover_ref"),
        warnings.alias("warning_count"),
    )
    reason = (
        F.when(F.col("_text").isNull(), "text can't be decoded")
        .when(F.col("_part").isNull(), "no description")
        .otherwise(F.coalesce("_limit", F.when(F.col("_x").isNull() | info.isNull(), "metadata is not well formed"), F.when(title.isNull() & F.lit(require_title), "no title")))
    )
    out = own.withColumn("reject_reason", reason)
    return out.withColumn("book", F.when(F.col("reject_reason").isNull(), book)).drop("_d", "_part", "_limit", "_x")


def covers(parsed: DataFrame) -> DataFrame:
    """parsed with cover_ext, cover (bytes) and cover_diagnostic, null without a trouble."""
    ref = F.col("book.cover_ref")
    every = F.regexp_extract_all("_text", F.lit(r"(?s)<(?:[\w.-]+:)?binary\s([^>]*)>([^<]*)</"), 0)
    own = F.filter(every, lambda b: F.regexp_extract(b, r"\bid\s*=\s*[\"']([^\"']*)[\"']", 1) == ref)
    first = F.get(own, F.lit(0))
    mime = F.regexp_extract(first, r"content-type\s*=\s*[\"']([^\"']*)[\"']", 1)
    data = strict_base64(F.regexp_extract(first, r"(?s)>([^<]*)<", 1))
    ext = cover_extension(mime, ref)
    trouble = (
        F.when(ref.isNull() | (trim_ascii(ref) == ""), None)
        .when(F.size(own) == 0, "cover binary is missing")
        .when(data.isNull(), "cover binary is not valid base64")
        .when(F.octet_length(data) == 0, "cover binary is empty")
        .when(ext.isNull(), "cover type is unknown")
    )
    good = trouble.isNull() & data.isNotNull()
    return parsed.withColumns({"cover_ext": F.when(good, ext), "cover": F.when(good, data), "cover_diagnostic": trouble})
