"""Column-level data quality profile, from footers and dictionary pages where they suffice and from a scan elsewhere.

The unit is a column chunk, one column of one row group, and all of it happens in tasks (``sources/chunks.py``):

* the footer gives rows and nulls, and settles a chunk whose rows are all null or whose two bounds are equal.  Bounds of
  texts may be cut short and need not be values, so no other use is made of them; bounds of integers, dates and moments
  are values;
* the dictionary page holds the different values of a chunk, if no page of data went without it; it gives distinct counts
  and extrema without the pages of data, and settles a chunk with one value;
* any other chunk is scanned: files of nothing but such chunks by Spark's reader, of other files the single chunks, texts as
  indices into their dictionary, so that a value is looked at once and counted.

``load_histogram`` ends in (load_id, value, n), from which all metrics of a load follow; ``column_profile`` has the null
rate, the distinct count and the range of every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookwarp.sources.chunks import Chunks, opened, over_chunks
from bookwarp.stage import blank, cut

#: A calendar date, alone or with a time of day at UTC.
DATE_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\+00:00)?$"
YEARS = (1450, 2026)
HISTOGRAM = "tbl string, col string, file string, chunk int, load_id bigint, value string, n bigint, how string"
PROFILE = "tbl string, col string, place int, kind string, rows bigint, nulls bigint, value string, low_i bigint, high_i bigint, low_d double, high_d double, how string"


def valid_date(column) -> F.Column:
    """The date of a text in one of the accepted forms, else null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.rlike(DATE_FORM), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def in_range(date) -> F.Column:
    return F.year(date).between(*YEARS)


def as_text(kind: str, value) -> str | None:
    """A value as text, as a cast gives it; moments are whole microseconds."""
    return None if value is None else str(value).lower() if kind == "b" else str(value)


def _counted(values, loads) -> Iterator[tuple[int | None, object, int]]:
    """(load, value, n) of a scanned chunk; nulls are counted too."""
    import pyarrow as pa

    coded = values if pa.types.is_dictionary(values.type) else values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    at = coded.indices.fill_null(len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
    loads = loads.dictionary_encode()
    known = loads.dictionary.to_pylist()
    of = loads.indices.fill_null(len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
    cells, n = np.unique(of * (len(words) + 1) + at, return_counts=True)
    for cell, count in zip(cells.tolist(), n.tolist(), strict=True):
        load, value = divmod(cell, len(words) + 1)
        yield known[load] if load < len(known) else None, words[value] if value < len(words) else None, count


def settled_chunks(spark: SparkSession, paths: dict[str, str], columns: dict[str, list[str]], load: str = "load_id") -> DataFrame:
    """(tbl, col, file, chunk, load_id, value, n, how): value counts of the chunks that a footer or a dictionary page settles;
    of every other chunk one row with ``how`` = ``scan`` and its number of rows.

    Columns of a type that isn't profiled have no rows, nor has a file that lacks the column.
    """

    def each(tbl: str, chunk: Chunks) -> Iterator[tuple]:
        loaded, the_load = chunk.constant(load) if load in chunk.place and chunk.nulls(load) == 0 else (False, None)
        for c in columns[tbl]:
            kind = chunk.kind(c)
            if not kind or not chunk.rows:
                continue
            nulls = chunk.nulls(c)
            one, value = chunk.constant(c)
            how = "footer"
            if loaded and nulls is not None and nulls < chunk.rows and not one and kind != "d":
                held = chunk.distinct(c)
                one, value, how = (True, held[0], "dictionary") if held is not None and len(held) == 1 else (False, None, "")
            at = (tbl, c, chunk.file, chunk.number)
            if kind == "d" or not (loaded and nulls is not None and (one or nulls == chunk.rows)):  # real numbers have other texts here
                yield *at, None, None, chunk.rows, "scan"
                continue
            if nulls:
                yield *at, the_load, None, nulls, how
            if nulls < chunk.rows:
                yield *at, the_load, as_text(kind, value), chunk.rows - nulls, how

    return over_chunks(spark, paths, each, HISTOGRAM)


def chunk_histograms(spark: SparkSession, paths: dict[str, str], columns: dict[str, list[str]], load: str = "load_id") -> DataFrame:
    """(tbl, col, load_id, value, n, how) for all chunks: value counts by load, and whether a footer, a dictionary page, a scan
    of the chunk or one of its whole file gave them.

    Per column the list of files that need a whole scan is made on the driver, which holds it for that scan anyway.
    """
    known = cut(settled_chunks(spark, paths, columns, load))
    scans = F.count_if(F.col("how") == "scan")
    files = known.groupBy("tbl", "col", "file").agg(scans.alias("open"), F.count_if(F.col("how") != "scan").alias("settled"))
    mixed = files.filter("open > 0 and settled > 0").select("tbl", "col", "file")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tbl, c, file, number in zip(batch["tbl"], batch["col"], batch["file"], batch["chunk"], strict=True):
                with opened(file) as handle:
                    chunk = Chunks(file, handle, int(number))
                    held = chunk.scan([c, load])
                    rows = [(tbl, c, at, as_text(chunk.kind(c), value), n, "scan") for at, value, n in _counted(held[c], held[load])]
                yield pd.DataFrame(rows, columns=["tbl", "col", "load_id", "value", "n", "how"]).astype({"load_id": "Int64"})

    schema = "tbl string, col string, load_id bigint, value string, n bigint, how string"
    out = known.filter("how <> 'scan'").select("tbl", "col", "load_id", "value", "n", "how")
    if not mixed.isEmpty():
        alone = known.filter("how = 'scan'").join(mixed, ["tbl", "col", "file"], "left_semi").select("tbl", "col", "file", "chunk")
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        out = out.unionByName(alone.repartition(tasks).mapInPandas(scan, schema))
    whole: dict[tuple[str, str], list[str]] = {}
    for r in files.filter("settled = 0").select("tbl", "col", "file").toLocalIterator():
        whole.setdefault((r.tbl, r.col), []).append(r.file)
    for (tbl, c), names in sorted(whole.items()):
        df = spark.read.parquet(*sorted(names))
        rows = df.groupBy(F.col(load).cast("bigint").alias("load_id"), _number(c, dict(df.dtypes)[c]).cast("string").alias("value")).agg(F.count("*").alias("n"))
        out = out.unionByName(rows.select(F.lit(tbl).alias("tbl"), F.lit(c).alias("col"), "load_id", "value", "n", F.lit("file").alias("how")))
    return out


def _number(column: str, kind: str) -> F.Column:
    """Dates as days and moments as microseconds since 1970, as files hold them; other values as they are."""
    if kind == "date":
        return F.unix_date(column)
    if kind == "timestamp":
        return F.unix_micros(column)
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)") if kind == "timestamp_ntz" else F.col(column)


def load_histogram(spark: SparkSession, paths: dict[str, str], columns: dict[str, list[str]], load: str = "load_id") -> DataFrame:
    """(tbl, col, load_id, value, n): how often each load has each exact value (as text; null is a value)."""
    return chunk_histograms(spark, paths, columns, load).filter("load_id is not null").groupBy("tbl", "col", "load_id", "value").agg(F.sum("n").alias("n"))


def chunk_profiles(spark: SparkSession, paths: dict[str, str], distinct: bool = True) -> DataFrame:
    """Rows of a profile for each column chunk: one with its rows and nulls, one for each different value.

    Without ``distinct`` the footers suffice for integers, dates and moments, and texts and floating-point numbers are
    looked at as before, since their footers don't tell their extrema.
    """

    def each(tbl: str, chunk: Chunks) -> Iterator[tuple]:
        names = [c for c in chunk.types if chunk.kind(c)]
        held, how, scanned = {}, {}, []
        for c in names:
            kind, nulls = chunk.kind(c), chunk.nulls(c)
            one, value = chunk.constant(c)
            s = chunk.stated(c)
            if nulls is not None and (nulls == chunk.rows or one):
                held[c], how[c] = [] if nulls == chunk.rows else [value], "footer"
            elif nulls is not None and not distinct and kind == "i" and s.has_min_max:
                held[c], how[c] = list(chunk.bounds(c)), "footer"
            elif nulls is not None and (values := chunk.distinct(c)) is not None:
                held[c], how[c] = values, "dictionary"
            else:
                scanned.append(c)
        if scanned:
            for c, values in chunk.scan(scanned).items():
                found = values.unique().drop_null().to_pylist() if not hasattr(values.type, "value_type") else values.dictionary_encode().dictionary.to_pylist()
                held[c], how[c] = found, "scan"
        for place, c in enumerate(names):
            kind = chunk.kind(c)
            nulls = chunk.nulls(c) if how[c] != "scan" else None
            yield tbl, c, place, kind, chunk.rows, nulls if nulls is not None else values_missing(chunk, c), None, None, None, None, None, how[c]
            for value in dict.fromkeys(held[c]):
                number = value if kind == "i" else int(value) if kind == "b" else None
                real = float(value) if kind == "d" and value == value else None
                yield tbl, c, place, kind, 0, 0, as_text(kind, value), number, number, real, real, how[c]

    def values_missing(chunk: Chunks, column: str) -> int:
        known = chunk.nulls(column)
        return known if known is not None else chunk.scan([column])[column].null_count

    return over_chunks(spark, paths, each, PROFILE)


def column_profile(spark: SparkSession, paths: dict[str, str], distinct: bool = True) -> DataFrame:
    """(tbl, col, rows, nulls, null_rate, distinct_values, low, high) of every column of every table (name to path).

    Texts are compared byte by byte.  Dates are days and moments microseconds since 1970.  NaN is a value but no extremum.
    Nested, decimal and binary columns are left out, and so are tables without files.  A column without values has null
    extrema.  ``distinct_values`` is null without ``distinct``.
    """
    found = chunk_profiles(spark, paths, distinct)
    # values are reduced before they meet, each of a column in a group of its own; extrema of numbers need no texts
    values = found.groupBy("tbl", "col", "value").agg(
        F.min("place").alias("place"), F.min("kind").alias("kind"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.min("low_i").alias("low_i"), F.max("high_i").alias("high_i"), F.min("low_d").alias("low_d"), F.max("high_d").alias("high_d"),
    )
    per = values.groupBy("tbl", "col").agg(
        F.min("kind").alias("kind"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.count("value").alias("d"), F.min("value").alias("low_s"), F.max("value").alias("high_s"),
        F.min("low_i").alias("low_i"), F.max("high_i").alias("high_i"), F.min("low_d").alias("low_d"), F.max("high_d").alias("high_d"),
    )
    extreme = lambda e: F.when(F.col("kind") == "s", F.col(e + "_s")).when(F.col("kind") == "b", F.col(e + "_i").cast("boolean").cast("string")).when(F.col("kind") == "d", F.col(e + "_d").cast("string")).otherwise(F.col(e + "_i").cast("string")).alias(e)
    rate = F.when(F.col("rows") > 0, F.round(F.col("nulls") / F.col("rows"), 6))
    return per.select("tbl", "col", "rows", "nulls", rate.alias("null_rate"), (F.col("d") if distinct else F.lit(None).cast("bigint")).alias("distinct_values"), extreme("low"), extreme("high"))


def load_metrics(histogram: DataFrame) -> DataFrame:
    """(tbl, col, load_id, metric, value) of all metrics from a histogram; a metric without rows to count is left out.

    ``absent`` counts over all rows; ``true_share``, ``invalid`` and ``top_share`` over the rows that are not absent;
    ``out_of_range`` over valid dates; ``new_share`` is left out for the first load.
    """
    column = ["tbl", "col"]
    h = histogram.withColumn("first_load", F.min("load_id").over(Window.partitionBy(*column, "value")))  # as many rows as loads
    h = h.withColumn("_absent", blank(F.col("value"))).withColumn("_day", valid_date("value"))
    there = F.when(~F.col("_absent"), F.col("n"))
    per = h.groupBy(*column, "load_id").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("_absent"), F.col("n"))).alias("n_absent"), F.sum(there).alias("n_there"), F.max(there).alias("n_top"),
        F.sum(F.when(~F.col("_absent") & F.col("_day").isNull(), F.col("n"))).alias("n_invalid"),
        F.sum(F.when(~F.col("_absent") & F.col("_day").isNotNull(), F.col("n"))).alias("n_valid"),
        F.sum(F.when(~F.col("_absent") & ~in_range(F.col("_day")), F.col("n"))).alias("n_out"),
        F.sum(F.when(F.col("value") == "true", F.col("n"))).alias("n_true"),
        F.sum(F.when(~F.col("_absent") & (F.col("first_load") == F.col("load_id")), F.col("n"))).alias("n_new"),
    ).withColumn("start", F.min("load_id").over(Window.partitionBy(*column)))
    share = lambda a, b: F.coalesce(F.col(a), F.lit(0)) / F.when(F.col(b) > 0, F.col(b))
    values = {
        "absent": share("n_absent", "n"), "invalid": share("n_invalid", "n_there"), "out_of_range": share("n_out", "n_valid"), "true_share": share("n_true", "n_there"),
        "top_share": share("n_top", "n_there"), "new_share": F.when(F.col("load_id") > F.col("start"), share("n_new", "n_there")),
    }
    row = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])).alias("_m")
    return per.select(*column, "load_id", row).select(*column, "load_id", "_m.metric", "_m.value").filter("value is not null")


def profile(spark: SparkSession, sources: list[tuple[str, str, str, tuple[str, ...]]]) -> DataFrame:
    """(tbl, col, load_id, metric, value) for each (tbl, path, column, metrics)."""
    paths = {tbl: path for tbl, path, _, _ in sources}
    columns: dict[str, list[str]] = {}
    for tbl, _, column, _ in sources:
        columns.setdefault(tbl, []).append(column)
    wanted = [f"(tbl = '{t}' and col = '{c}' and metric in ({', '.join(repr(m) for m in metrics)}))" for t, _, c, metrics in sources]
    return load_metrics(load_histogram(spark, paths, columns)).filter(" or ".join(wanted))


def departures(profiled: DataFrame, distance: float) -> DataFrame:
    """Rows of a profile that lie more than ``distance`` from the metric's median over all loads."""
    usual = F.percentile("value", F.lit(0.5)).over(Window.partitionBy("tbl", "col", "metric"))  # as many rows as loads
    return profiled.withColumn("usual", usual).filter(F.abs(F.col("value") - F.col("usual")) > distance)
