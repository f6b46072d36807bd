"""Cover images: header parsing, rules, quality, duplicates.

Only the headers of JPEG, PNG and WEBP files are parsed, in a vectorised function; the rules are column expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The limits of the rules.
SMALLEST_SIDE = 300
ASPECT = (1.1, 2.2)
BYTES = (100, 20 * 1024 * 1024)
FULL_QUALITY_PIXELS = 1000 * 1500
HEADER = "width int, height int, format string"


def image_header(data: bytes) -> tuple[int, int, str] | None:
    """(width, height, format), or nothing for what is none of the formats or is cut off."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return (*struct.unpack(">II", data[16:24]), "PNG")
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, "WEBP"
            if kind == b"VP8L":
                bits = struct.unpack("<I", data[21:25])[0]
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "WEBP"
            if kind == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF, "WEBP"
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(data):
                if data[at] != 0xFF:
                    return None
                marker = data[at + 1]
                if marker == 0xFF:
                    at += 1
                elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return width, height, "JPEG"
                elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
                    at += 2
                else:
                    at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except (struct.error, IndexError):
        pass
    return None


def _headers():
    @F.pandas_udf(HEADER)
    def headers(content: pd.Series) -> pd.DataFrame:
        found = [image_header(bytes(c)) if c is not None else None for c in content]
        return pd.DataFrame({"width": [f and f[0] for f in found], "height": [f and f[1] for f in found], "format": [f and f[2] for f in found]}).astype({"width": "Int32", "height": "Int32"})

    return headers


def quality() -> Column:
    """Pixels against those of a usual cover, from 0 to 100."""
    pixels = F.col("width").cast("double") * F.col("height")
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(pixels / FULL_QUALITY_PIXELS * 100))).cast("int")


def shape_issues() -> Column:
    """What is wrong with width and height."""
    ratio = F.col("height") / F.col("width")
    zero = (F.col("width") == 0) | (F.col("height") == 0)
    low = (F.col("width") < SMALLEST_SIDE) | (F.col("height") < SMALLEST_SIDE)
    return F.array_compact(F.array(
        F.when(zero, F.lit("Zero-dimension image")),
        F.when(~zero & low, F.concat(F.lit("Resolution too low: "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(f" (minimum {SMALLEST_SIDE}x{SMALLEST_SIDE})"))),
        F.when(~zero & ~ratio.between(*ASPECT), F.concat(F.lit("Unusual aspect ratio for a book cover: "), F.format_string("%.2f", F.bround(ratio, 2)))),
    ))


def examined(images: DataFrame) -> DataFrame:
    """``images`` (with ``content``) with size, width, height, format, quality, issues, digest and is_valid."""
    out = images.withColumn("size_bytes", F.length("content")).withColumn("_h", _headers()("content")).select("*", "_h.width", "_h.height", "_h.format").drop("_h")
    small = F.col("size_bytes") < BYTES[0]
    large = F.when(F.col("size_bytes") > BYTES[1], F.concat(F.lit("File too large ("), F.format_number("size_bytes", 0), F.lit(" bytes)")))
    rest = F.when(F.col("format").isNull(), F.array(F.lit("Corrupt or unreadable image"))).otherwise(shape_issues())
    issues = F.when(small, F.array(F.concat(F.lit("File too small ("), F.col("size_bytes").cast("string"), F.lit(" bytes)")))).otherwise(F.concat(F.array_compact(F.array(large)), rest))
    score = F.when(small | F.col("format").isNull(), 0).otherwise(quality())
    return out.withColumn("issues", issues).withColumn("quality", score).withColumn("is_valid", F.size("issues") == 0).withColumn("digest", F.sha2("content", 256))


def downloaded_covers(spark: SparkSession, candidates: DataFrame, fetch) -> DataFrame:
    """(book_id, source, origin, content, failure) of candidates (id, source, cover_url) with an address.

    ``fetch`` takes an address and gives bytes; it runs in tasks.  What it raises for a network fault is the candidate's
    failure, the other candidates are not affected.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["origin"]:
                try:
                    rows.append((fetch(url), ""))
                except TimeoutError as error:
                    rows.append((None, f"Download timed out: {error}"))
                except OSError as error:  # what the standard library raises for an address that can't be read
                    rows.append((None, f"Download failed: {error}"))
            yield batch.assign(content=[r[0] for r in rows], failure=[r[1] for r in rows])

    asked = candidates.filter("cover_url <> ''").select(F.col("id").alias("book_id"), "source", F.col("cover_url").alias("origin"))
    return asked.mapInPandas(load, "book_id bigint, source string, origin string, content binary, failure string")


def gathered(folder: DataFrame | None, downloaded: DataFrame | None) -> DataFrame:
    """Examined candidates of both kinds; a failed download is an issue, and the only one."""
    parts = []
    if downloaded is not None:
        parts.append(downloaded)
    if folder is not None:
        parts.append(folder.select("book_id", F.lit("user").alias("source"), "origin", "content", F.lit("").alias("failure")))
    if not parts:
        raise ValueError("no covers to look at")
    every = examined(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    failed = F.col("failure") != ""
    return every.withColumn("issues", F.when(failed, F.array("failure")).otherwise(F.col("issues"))).withColumn("is_valid", F.col("is_valid") & ~failed)


def present_covers(spark: SparkSession, books: DataFrame, library: str) -> DataFrame:
    """(book_id, content) of cover.jpg in the folders of books (id, path); books without one have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "cover.jpg").load(library)
    inside = F.regexp_extract(F.col("path"), "([^/]+/[^/]+)/cover\\.jpg$", 1)
    return files.select(inside.alias("path"), "content").join(books.select(F.col("id").alias("book_id"), "path"), "path").select("book_id", "content")


def user_folder_covers(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, origin, content) of the files <book id>.jpg, .jpeg, .png or .webp in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").load(folder)
    number = F.regexp_extract("path", r"/([0-9]+)\.(jpe?g|png|webp)$", 1)
    return files.filter(number != "").select(number.cast("bigint").alias("book_id"), F.col("path").alias("origin"), "content")


def flag_duplicates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (examined, with book_id) that are the cover the book has: ``existing`` is (book_id, content)."""
    have = existing.select("book_id", F.sha2("content", 256).alias("digest")).distinct().withColumn("is_duplicate", F.lit(True))
    return candidates.join(have, ["book_id", "digest"], "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def best_covers(candidates: DataFrame, order: str = "origin") -> DataFrame:
    """Of each book the valid new candidate of greatest quality, on a tie the first."""
    good = candidates.filter("is_valid and not is_duplicate")
    return good.groupBy("book_id").agg(F.min(F.struct((-F.col("quality")).alias("q"), F.col(order).alias("o"))).alias("b")).select("book_id", (-F.col("b.q")).alias("quality"), F.col("b.o").alias(order))


def numbered(candidates: DataFrame) -> DataFrame:
    """Candidates of each book with the number that the preview shows, downloads first, then by origin."""
    return candidates.withColumn("number", F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("source") == "user", "source", "origin")))


def candidate_lines(candidates: DataFrame) -> DataFrame:
    """(book_id, line): one line of text for each candidate."""
    state = F.when(F.col("is_duplicate"), "same as the present cover").when(F.col("is_valid"), "ok").otherwise(F.array_join("issues", "; "))
    kept = [c for c in ("number",) if c in candidates.columns]
    return candidates.select("book_id", *kept, F.format_string("%s: %dx%d %s, quality %d - %s", "origin", F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0)), F.coalesce("format", F.lit("?")), "quality", state).alias("line"))
