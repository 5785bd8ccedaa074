"""Index statistics, document-conversion state and completeness, as joins over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions.text import basename, common_directory, dirname, extension, stem

# The formats that can be converted to Markdown.
CONVERTIBLE = frozenset(
    ".doc .docx .docm .odt .rtf .epub .ppt .pps .pot .pptx .pptm .ppsx .ppsm .odp .xls .xlsx .xlsm .xlsb .ods .csv .pdf".split()
)


def index_stats(files: DataFrame, chunks: DataFrame, vectors: int | None = None, last_build: str | None = None) -> DataFrame:
    """One row: ``total_files, total_chunks, total_tokens, embedded_count, vector_coverage_pct, last_build``.

    Without a count of vectors, the chunks of embedded files count as embedded.
    """
    f = files.agg(F.count("*").alias("total_files"))
    c = chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    if vectors is None:
        embedded = files.where("embedded").select(F.col("path").alias("file_path")).distinct()
        v = chunks.join(embedded, "file_path", "left_semi").agg(F.count("*").alias("embedded_count"))
    else:
        v = files.sparkSession.range(1).select(F.lit(vectors).cast("long").alias("embedded_count"))
    one = f.crossJoin(c).crossJoin(v)  # three single rows
    return one.withColumn("vector_coverage_pct", percentage(F.col("embedded_count"), F.col("total_chunks"))).withColumn(
        "last_build", F.lit(last_build).cast("string")
    )


def percentage(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing is 0."""
    return F.when(whole == 0, 0).otherwise(F.floor(part * 100 / whole + 0.5)).cast("int")


def is_stale(last_build: Column, now: Column) -> Column:
    """Older than 24 hours; an empty or unreadable time is not."""
    at = last_build.try_cast("timestamp")
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(at) > 24 * 3600 * 1_000_000, F.lit(False))


def files_by_extension(files: DataFrame, limit: int = 8) -> DataFrame:
    """``ext, files``: the most frequent extensions; ties by name."""
    counts = files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"))
    return counts.orderBy(F.col("files").desc(), "ext").limit(limit)


def newest_files(files: DataFrame) -> DataFrame:
    """The newest row of each path of an append-only state; ties by the greater row."""
    from sedgework.operators.incremental import instant

    rest = [c for c in files.columns if c != "path"]
    row = F.struct(instant(F.col("indexed")).alias("_at"), *rest)
    return files.where("path is not null").groupBy("path").agg(F.max(row).alias("r")).select("path", *(f"r.{c}" for c in rest))


def conversion_targets(docs: DataFrame) -> DataFrame:
    """``path`` with where its Markdown and checksum are expected: ``md, checksum`` and the legacy ``md_ocr, checksum_ocr``."""
    path = F.col("path")
    folder, name = dirname(path), stem(path)
    def inside(directory: Column, file: Column) -> Column:
        return F.concat_ws("/", directory, file)

    named, legacy = F.concat_ws("/", folder, name), F.concat_ws("/", folder, F.concat(name, F.lit("_ocr")))
    md, sidecar = F.concat(name, F.lit(".md")), F.concat(basename(path), F.lit(".sha256"))
    return docs.select(
        "*",
        inside(named, md).alias("md"),
        inside(named, sidecar).alias("checksum"),
        inside(legacy, md).alias("md_ocr"),
        inside(legacy, sidecar).alias("checksum_ocr"),
    )


def sidecar_checksum(text: Column) -> Column:
    """The 64 hex digits at the start of the first line in lower case, else null."""
    first = F.trim(F.element_at(F.split(text, "\n", -1), 1))
    return F.nullif(F.lower(F.regexp_extract(first, r"(?i)^([0-9a-f]{64})", 1)), F.lit(""))


def conversion_state(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """``path, target_md, state, reason`` of ``docs(path, sha256, real)`` against ``listing(path, text)``.

    ``listing`` holds all files, with the text of checksum files. Documents with
    the same real path count once, the first by path. Without Markdown in either
    layout: needs_convert, no_markdown. Without a readable checksum:
    checksum_missing. Otherwise up_to_date or needs_convert, checksum_changed.
    """
    one = Window.partitionBy("real").orderBy("path")
    docs = docs.withColumn("real", F.coalesce("real", "path")).withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    targets = conversion_targets(docs)
    there = listing.select(F.col("path").alias("_p"), F.col("text").alias("_t"))

    def found(df: DataFrame, column: str, keep: str) -> DataFrame:
        side = there.select(F.col("_p").alias(column), F.lit(True).alias(f"has_{keep}"), F.col("_t").alias(f"text_{keep}"))
        return df.join(side, column, "left")

    rows = found(found(found(found(targets, "md", "md"), "md_ocr", "md_ocr"), "checksum", "sum"), "checksum_ocr", "sum_ocr")
    md = F.when(F.col("has_md"), F.col("md")).when(F.col("has_md_ocr"), F.col("md_ocr"))
    recorded = sidecar_checksum(F.when(F.col("has_md"), F.col("text_sum")).otherwise(F.col("text_sum_ocr")))
    reason = (
        F.when(md.isNull(), "no_markdown")
        .when(recorded.isNull(), "checksum_missing")
        .when(recorded == F.lower("sha256"), "ok")
        .otherwise("checksum_changed")
    )
    rows = rows.select("path", F.coalesce(md, "md").alias("target_md"), reason.alias("reason"))
    state = F.when(F.col("reason") == "ok", "up_to_date").when(F.col("reason") == "checksum_missing", "checksum_missing")
    return rows.withColumn("state", state.otherwise("needs_convert"))


def coverage(listing: DataFrame, index: DataFrame) -> DataFrame:
    """``path, state`` (indexed, modified, missing) of the Markdown files of ``listing(path, real, hash)``.

    A file is looked up by its real path, else by its path below the deepest common
    directory, which stays the same when a whole tree is moved. A file of the index
    without a hash is never modified.
    """
    listing = listing.withColumn("real", F.coalesce("real", "path"))
    index = index.select(F.col("path").alias("db_path"), F.col("hash").alias("db_hash"), *(["real"] if "real" in index.columns else []))
    index = index.withColumn("db_real", F.coalesce("real", "db_path") if "real" in index.columns else F.col("db_path"))
    here = listing.agg(common_directory(F.col("path")).alias("here"))
    there = index.agg(common_directory(F.col("db_path")).alias("there"))
    below = lambda path, root: F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.char_length(root) + 2))
    by_real = index.groupBy(F.col("db_real").alias("real")).agg(F.min(F.struct("db_path", "db_hash")).alias("a"))
    by_rel = (
        index.crossJoin(there)  # one row
        .withColumn("rel", below(F.col("db_path"), F.col("there")))
        .where("rel is not null")
        .groupBy("rel")
        .agg(F.min(F.struct("db_path", "db_hash")).alias("b"))
    )
    rows = listing.crossJoin(here).withColumn("rel", below(F.col("path"), F.col("here")))  # one row
    rows = rows.join(by_real, "real", "left").join(by_rel, "rel", "left").withColumn("m", F.coalesce("a", "b"))
    state = F.when(F.col("m").isNull(), "missing").when(F.col("m.db_hash") != F.col("hash"), "modified").otherwise("indexed")
    return rows.select("path", state.alias("state"))


def verdict(needs_convert: Column, needs_checksum: Column, needs_index: Column, stale: Column) -> Column:
    return (
        F.when(needs_convert, "needs_convert")
        .when(needs_checksum, "needs_checksum")
        .when(needs_index, "needs_index")
        .when(stale, "stale")
        .otherwise("complete")
    )
