"""Statement CSV files of any known layout.

Files are read as lines by one text scan, whatever their number and layouts. Each file's header and encoding are
reduced to one row, its field positions are worked out there, and the rows meet them in a join. Nothing
about single files reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.feed import numbered

# Header names by field, in order of preference, compared trimmed and in lower case.
ALIASES = {
    "account": ("posted account", "account", "masked account"),
    "date": ("posted transactions date", "transaction date", "date"),
    "debit": ("debit amount", "debit"),
    "credit": ("credit amount", "credit"),
    "currency": ("posted currency", "currency"),
    "type": ("transaction type", "type"),
    "balance": ("balance",),
}
DESCRIPTIONS = ("description1", "description2", "description3", "description")
REQUIRED = ("account", "date", "debit", "credit")

# A cell is quoted, with quotes doubled inside, or plain, up to the next comma. Possessive, so long cells need no stack.
CELL = r'("(?:[^"]|"")*+"|[^,]*+),'


def cells_of(line: Column) -> Column:
    """The cells of a CSV record, unquoted."""
    ended = F.concat(F.regexp_replace(line, "\r$", ""), F.lit(","))
    return F.transform(F.regexp_extract_all(ended, F.lit(CELL), F.lit(1)), lambda cell: F.when(
        cell.startswith('"'), F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell))


def from_latin1(text: Column) -> Column:
    """Windows-1252 text that was decoded as ISO-8859-1: only the bytes 80 to 9F differ."""
    codes = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", errors="ignore")]
    return F.translate(text, "".join(map(chr, codes)), bytes(codes).decode("cp1252"))


def _records(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    """Records as text with their file and order."""
    meta = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_path").alias("batch_id")]
    lines = spark.read.text(path, lineSep="\n" if multi_line else None).select(
        F.col("value").alias("line"), *meta, F.col("_metadata.file_block_start").alias("block_start"))
    if not multi_line:
        return numbered(lines)
    return joined_lines(numbered(lines.withColumn("split", F.col("block_start")))).filter(F.rtrim("line") != "")


def joined_lines(lines: DataFrame) -> DataFrame:
    """Records of lines: a line break inside quotes ends none.

    `lines` has line, file_path, batch_id, split (the part of the file that a task has read) and batch_ord. A line lies inside quotes
    if the number of quotes before it in its file is odd. Quotes are counted for each split, of which a file has few, and then
    from line to line within a split, so a file of any size is read by many tasks. A record begins at the last line that is not
    inside quotes, be it in an earlier split. A quote that is never closed makes one record of the rest of the file.
    """
    by_split = Window.partitionBy("file_path", "split").orderBy("batch_ord")
    before_line = by_split.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_split.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.regexp_count("line", F.lit('"'))

    splits = lines.groupBy("file_path", "split").agg(F.sum(quotes).alias("_quotes")).select(
        "file_path", "split", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)).alias("_ahead"))
    inside = (F.col("_ahead") + F.coalesce(F.sum(quotes).over(before_line), F.lit(0))) % 2 == 1
    marked = lines.join(splits, ["file_path", "split"]).withColumn("_begins", F.when(~inside, F.col("batch_ord")))
    last = marked.groupBy("file_path", "split").agg(F.max("_begins").alias("_last")).select(
        "file_path", "split", F.max("_last").over(earlier).alias("_carried"))
    placed = marked.withColumn("_own", F.max("_begins").over(so_far)).join(last, ["file_path", "split"])
    record = F.coalesce("_own", "_carried")
    return placed.groupBy("file_path", "batch_id", record.alias("_record")).agg(
        F.array_sort(F.collect_list(F.struct("batch_ord", "line"))).alias("_lines")).select(
            "file_path", "batch_id", F.col("_record").alias("batch_ord"),
            F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("line"))


def file_profiles(records: DataFrame) -> DataFrame:
    """Per file: where its header is, whether all of it is UTF-8, and the position of each field in it."""
    first = records.groupBy("file_path").agg(
        F.min("batch_ord").alias("header_at"), F.min_by("line", "batch_ord").alias("header"),
        F.bool_and(F.is_valid_utf8("line")).alias("utf8"))
    names = F.transform(cells_of(F.regexp_replace("header", "^\ufeff", "")), lambda cell: F.lower(F.trim(cell)))

    def place(*aliases: str) -> Column:
        return F.coalesce(*[F.nullif(F.array_position(F.col("names"), alias), F.lit(0)) for alias in aliases]).cast("int")

    descriptions = F.array_compact(F.array(*[place(name) for name in DESCRIPTIONS]))
    return first.withColumn("names", names).select(
        F.col("file_path").alias("profile_of"), "header_at", "header", "utf8",
        *[place(*aliases).alias(f"at_{field}") for field, aliases in ALIASES.items()], descriptions.alias("at_descriptions"))


def read_statements(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """All statement files under `path` as text columns with file and row order.

    A file that is not UTF-8 throughout is read as Windows-1252 throughout. A header that lacks a required
    field fails the read and is shown. Set `multi_line` when quoted fields contain line breaks (see `joined_lines`); files are
    split over tasks either way. Empty files give no rows.
    """
    records = _records(spark, path, multi_line)
    profiles = file_profiles(records)
    rows = records.join(profiles, records["file_path"] == profiles["profile_of"]).filter(
        (F.col("batch_ord") > F.col("header_at")) & (F.trim("line") != ""))
    text = F.when(F.col("utf8"), F.col("line")).otherwise(from_latin1(F.decode(F.col("line").cast("binary"), "ISO-8859-1")))
    lacking = F.concat(F.lit("statement header lacks a required field; header found: "), F.col("header"))
    complete = F.concat(*[F.col(f"at_{field}").isNull().cast("string") for field in REQUIRED]) == "false" * len(REQUIRED)
    cells = F.when(complete, cells_of(text)).otherwise(F.raise_error(lacking).cast("array<string>"))
    parsed = rows.select("*", F.explode(F.array(cells)).alias("cells"))
    return parsed.select(
        *[F.get("cells", F.col(f"at_{field}") - 1).alias(field) for field in ALIASES],
        F.transform("at_descriptions", lambda at: F.coalesce(F.get("cells", at - 1), F.lit(""))).alias("descriptions"),
        "file_path", "batch_id", "batch_ord")
