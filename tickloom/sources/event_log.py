"""Day-sliced JSON event logs: decode, flatten to book and meta rows, compact, audit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.staging import stage

# Event types that carry book rows, and the row kinds they become.
BOOK_TYPES = {"WsBookEvent": "book", "WsPriceChange": "pchange", "RestBook": "restbook",
              "WsLastTrade": "trade"}

_LEVELS = "array<struct<price:string,size:string>>"
_SIDES = "map<string,string>"


def log_date(path: Column) -> Column:
    """UTC date of a day-sliced file: ``YYYY-MM-DD_<stream>.jsonl``, or any file in a folder ``date=YYYY-MM-DD``; else ''."""
    named = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})_[^/]*$", 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(path, r"date=(\d{4}-\d{2}-\d{2})/[^/]*$", 1))


def _get(value: Column, path: str, as_type: str = "string") -> Column:
    return F.try_variant_get(value, path, as_type)


def decode_event_log(lines: DataFrame, line: str = "line", file_name: str = "file_name"
                     ) -> DataFrame:
    """Parse each line once, into ``record`` (VARIANT), from which every later column is read.

    Broken lines (no JSON object, a repeated field) stay, flagged ``is_bad``, so they can be counted.
    """
    df = lines.withColumn("_r", F.try_parse_json(line)).withColumn("date", log_date(F.col(file_name)))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    good = F.coalesce(F.col("_r").isNotNull() & F.col(line).rlike(r"^\s*\{"), F.lit(False))
    df = df.withColumns({"is_bad": ~good, "record": F.when(good, F.col("_r"))})
    record = F.col("record")
    kind = F.when(is_object(_get(record, "$.event", "variant")), _kind(_get(record, "$.type")))
    return df.select(
        *lines.columns, "date", "is_bad",
        F.try_to_timestamp(_get(record, "$.recv_ts")).alias("ts"),
        F.when(good, F.coalesce(_get(record, "$.type"), F.lit("?"))).alias("type"), kind.alias("kind"), "record")


def _kind(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in BOOK_TYPES.items():
        out = F.when(event_type == name, F.lit(kind)).otherwise(out)
    return out


def read_event_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All daily files under a path, or the files of a list, decoded."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_name"))
    return decode_event_log(lines)


def _row(kind: str, side: Column, price: Column, size: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), side.alias("side"),
                    price.try_cast("double").alias("price"), size.try_cast("double").alias("size"))


def book_rows() -> Column:
    """Array of book rows of a decoded line; NULL for meta and broken lines."""
    kind, record = F.col("kind"), F.col("record")
    field = lambda name: _get(record, f"$.event.{name}")

    def pushed(name: str, side: str) -> Column:
        levels = F.coalesce(_get(record, f"$.event.{name}", _LEVELS), F.array().cast(_LEVELS))
        return F.transform(levels, lambda x: _row("book", F.lit(side), x["price"], x["size"]))

    def mapped(name: str, side: str) -> Column:
        levels = F.coalesce(_get(record, f"$.event.{name}", _SIDES), F.create_map().cast(_SIDES))
        return F.transform(F.map_entries(levels),
                           lambda x: _row("restbook", F.lit(side), x["key"], x["value"]))

    delta_side = F.when(F.upper(field("side")) == "BUY", F.lit("bid")).otherwise(F.lit("ask"))
    return (
        F.when(kind == "book", F.concat(pushed("bids", "bid"), pushed("asks", "ask")))
        .when(kind == "restbook", F.concat(mapped("bids", "bid"), mapped("asks", "ask")))
        .when(kind == "pchange", F.array(_row("pchange", delta_side, field("price"), field("size"))))
        .when(kind == "trade", F.array(_row("trade", F.coalesce(field("side"), F.lit("")), field("price"), field("size")))))


def event_rows(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line with all it becomes: ``asset_id``, ``market``, ``rows`` (book rows) or ``payload`` (meta).

    Both tables and the audit are read from this, so a staged copy means that no line is decoded twice.
    """
    named = lambda c: F.coalesce(_get(F.col("record"), f"$.event.{c}"), F.lit("")).alias(c)
    fields = _get(F.col("record"), "$", "map<string,variant>")
    rest = F.to_json(F.map_filter(fields, lambda k, _: ~k.isin("recv_ts", "type")))
    payload = F.when(~F.col("is_bad") & F.col("kind").isNull(), rest)
    return log.select(*keep, "date", "ts", "is_bad", "type", named("asset_id"), named("market"),
                      book_rows().alias("rows"), payload.alias("payload"))


def book_of(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    # of a plain column Spark would infer a filter and push it, with the decoding, below the decoding
    levels = F.when(F.col("rows").isNotNull(), F.col("rows"))
    return rows.select(*keep, "date", "ts", "asset_id", "market", F.inline(levels)).select(
        *keep, "date", "ts", "kind", "asset_id", "market", "side", "price", "size")


def meta_of(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    # as an array, because a filter would be pushed below the decoding and read every line twice
    row = F.array(F.struct(F.col("ts").alias("ts"), F.col("type").alias("type"), F.col("payload").alias("payload")))
    return rows.select(*keep, "date", F.inline(F.when(F.col("payload").isNotNull(), row)))


def flatten_book(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Book table: one row per level, delta or trade. One scan, no union."""
    return book_of(event_rows(log, keep), keep)


def flatten_meta(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Meta table: every other valid event, its remaining fields kept as JSON text."""
    return meta_of(event_rows(log, keep), keep)


def log_files(spark: SparkSession, src: str) -> DataFrame:
    """path, date, bytes of every day-sliced file below ``src``; the files are listed, not opened."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(src)
              .select("path", log_date(F.col("path")).alias("date"), F.col("length").alias("bytes")))
    return listed.filter(F.col("date") != "")


def sealed(dated: DataFrame, today: str, done: DataFrame | None = None, *,
           force: bool = False, include_today: bool = False) -> DataFrame:
    """Rows of ``dated`` ready for compaction: before today (UTC) and, unless forced, not written yet."""
    if not include_today:
        dated = dated.filter(F.col("date") < today)
    if done is not None and not force:
        dated = dated.join(done.select(F.col("date").cast("string").alias("date")).distinct(), "date", "left_anti")
    return dated


def _written(spark: SparkSession, path: str) -> DataFrame:
    """Dates and rows already at a path, or an empty table when nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "date string")


def compact_days(spark: SparkSession, src: str, dst: str, today: str, *, force: bool = False,
                 include_today: bool = False) -> DataFrame:
    """Write sealed days to ``dst/book`` and ``dst/meta`` (sorted, zstd, by date); return the audit of all days.

    The audit under ``dst/meta_done`` is the manifest: only files of days it does not list reach the reader, so a run costs
    what is new. Their lines are decoded once, into a staged table. Rows are range-partitioned by (date, ts,
    asset), so one heavy day becomes many files. Only the dates written are replaced and the audit comes last, which makes
    a repeated or restarted run harmless. A file that comes late for a listed day needs ``force``.
    """
    files = sealed(log_files(spark, src), today, _written(spark, f"{dst}/meta_done"), force=force, include_today=include_today)
    paths = [r.path for r in files.select("path").toLocalIterator()]  # names of the new files only
    if paths:
        _compact(event_rows(read_event_log(spark, paths)), dst)
    return _written(spark, f"{dst}/meta_done")


def _compact(rows: DataFrame, dst: str) -> None:
    spark, rows = rows.sparkSession, stage(rows)
    dates = rows.select("date").distinct()
    for name, df, order in (("book", book_of(rows), ["ts", "asset_id", "side", "price"]),
                            ("meta", meta_of(rows), ["ts", "type"])):
        (df.repartitionByRange("date", *order[:2]).sortWithinPartitions("date", *order)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy("date").parquet(f"{dst}/{name}"))
    fresh = lambda name: _written(spark, f"{dst}/{name}").withColumn(
        "date", F.col("date").cast("string")).join(dates, "date", "left_semi")
    audit = audit_rows(rows, fresh("book"), fresh("meta"))
    # the audit row is the mark that a date is complete; it is written last
    (audit.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(f"{dst}/meta_done"))


def compaction_audit(log: DataFrame, book: DataFrame, meta: DataFrame) -> DataFrame:
    """:func:`audit_rows` of a decoded log."""
    return audit_rows(event_rows(log), book, meta)


def audit_rows(rows: DataFrame, book: DataFrame, meta: DataFrame) -> DataFrame:
    """Per date: rows written equal rows produced, and every line is accounted for.

    The source of a date may be deleted only when it is verified and has no broken line. One union, one shuffle: lines
    and written rows are counted before it.
    """
    n_rows = F.greatest(F.coalesce(F.size("rows"), F.lit(0)), F.lit(0))
    as_text = F.col("date").cast("string").alias("date")
    counts = {"n_lines": F.lit(1), "n_bad": F.col("is_bad").cast("int"), "book_rows_made": n_rows,
              "book_events": (n_rows > 0).cast("int"), "meta_events": F.col("payload").isNotNull().cast("int")}
    made = rows.select(as_text, *[c.alias(n) for n, c in counts.items()])
    both = made.unionByName(book.select(as_text, F.lit(1).alias("book_rows")), allowMissingColumns=True).unionByName(
        meta.select(as_text, F.lit(1).alias("meta_rows")), allowMissingColumns=True)
    names = [*counts, "book_rows", "meta_rows"]
    j = both.groupBy("date").agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names]).filter("n_lines > 0")
    verified = ((F.col("book_rows") == F.col("book_rows_made")) & (F.col("meta_rows") == F.col("meta_events"))
                & (F.col("book_events") + F.col("meta_events") + F.col("n_bad") == F.col("n_lines")))
    return j.select("date", "n_lines", "n_bad", "book_rows", "meta_rows", "book_events", "meta_events",
                    verified.alias("verified"), (verified & (F.col("n_bad") == 0)).alias("deletable"))
