"""Line dedup by winnowing over line hashes, in DataFrame operations only.

The lines of a text that are not blank form a sequence. GRAM neighbouring lines make a hash, of every
WINDOW neighbouring hashes the smallest is kept as a fingerprint, and every run of RUN = GRAM + WINDOW - 1 lines
so holds one. Fingerprints met at one place only are dropped; around the others the runs are laid open to
both sides and compared. A run that occurs earlier, by doc_id and then by line, is deleted where it occurs
later; longer repeats are deleted whole because their runs overlap. A line of LONG_WORDS words or more is a run by
itself: its own hash is its fingerprint. So every repeat of RUN lines goes, however short, and every long line, however few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import row_of, saved

GRAM = 2
WINDOW = 2
RUN = GRAM + WINDOW - 1
LONG_WORDS = 20
BLANKS = " \t\r"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value worked out once however often it is used, in lambdas above all."""
    return F.get(F.transform(F.array(value), use), 0)


def _starts(hashes: Column, length: int) -> Column:
    """Positions (from 1) at which `length` neighbours begin."""
    last = F.size(hashes) - (length - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def fingerprints(lines: Column) -> Column:
    """Array of (fp, runs): each kept minimum with the runs whose minimum it is.

    A run has its content hash and the numbers of its lines in the text. Equal minima of a window count as the first.
    """
    marked = F.filter(F.transform(lines, lambda line, i: F.struct(
        i.alias("line"), F.trim(line, F.lit(BLANKS)).alias("text"))), lambda x: x["text"] != "")
    hashed = F.transform(marked, lambda x: F.struct(
        x["line"].alias("line"), F.xxhash64(x["text"]).alias("h"),
        (F.regexp_count(x["text"], F.lit(f"[^{BLANKS}]+")) >= LONG_WORDS).alias("long")))

    def long_lines(seq: Column) -> Column:
        return F.transform(F.filter(seq, lambda x: x["long"]), lambda x: F.struct(
            F.xxhash64(x["h"], F.lit(2)).alias("fp"), x["line"].cast("long").alias("at"), x["h"].alias("content"),
            F.array(x["line"]).alias("lines")))

    def runs(seq: Column, hashes: Column, grams: Column) -> Column:
        return F.concat(long_lines(seq), F.transform(_starts(hashes, RUN), lambda i: once(F.slice(grams, i, WINDOW), lambda window: F.struct(
            F.array_min(window).alias("fp"), (i + F.array_position(window, F.array_min(window)) - 1).alias("at"),
            F.xxhash64(F.slice(hashes, i, RUN), F.lit(1)).alias("content"),
            F.transform(F.slice(seq, i, RUN), lambda x: x["line"]).alias("lines")))))

    def grams_of(hashes: Column) -> Column:
        return F.transform(_starts(hashes, GRAM), lambda i: F.xxhash64(F.slice(hashes, i, GRAM)))

    return once(hashed, lambda seq: once(F.transform(seq, lambda x: x["h"]), lambda hashes: once(
        grams_of(hashes), lambda grams: runs(seq, hashes, grams))))


def repeated_lines(rows: DataFrame) -> DataFrame:
    """row_no and the numbers (from 0) of the lines to delete. `rows` has row_no, doc_id and runs."""
    prints = rows.select("row_no", "doc_id", F.inline("runs"))
    spot = F.struct("row_no", "at")
    shared = prints.groupBy("fp").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).filter("low <> high").select("fp")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no", F.element_at("lines", 1).alias("line"))
    runs = saved(prints.join(saved(shared, "shared"), "fp")
                 .select("fp", "content", "row_no", place.alias("place"), "lines"), "runs")
    first = saved(runs.groupBy("fp", "content").agg(F.min("place").alias("first"), F.count("*").alias("n"))
                  .filter("n > 1").drop("n"), "first")
    later = runs.join(first, ["fp", "content"]).filter(F.col("place") > F.col("first"))
    return later.groupBy("row_no").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("deleted"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, with later repeated runs of lines cut from `text`.

    Adds n_lines and n_removed. Blank lines neither match nor are deleted. Null stays null (no lines), empty
    stays empty (one blank line). Rows that share an id are told apart by their place in the table; a row
    without an id comes after all others. A text that repeats another as a whole becomes empty if it has RUN lines or more, or only long ones.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = saved(docs.select(F.monotonically_increasing_id().alias("row_no"), row_of(docs).alias("doc"),
                             fingerprints(lines).alias("runs")), "lines")
    deleted = repeated_lines(kept.select("row_no", F.col("doc.doc_id").alias("doc_id"), "runs"))
    joined = kept.select("row_no", "doc").join(deleted, "row_no", "left")
    text = F.col("doc.text")

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("deleted"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    cut = F.when(F.col("deleted").isNull(), text).otherwise(once(F.split(text, "\n"), rest))
    n_lines = F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1)
    return joined.select(
        *[(cut if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_removed"))


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text_sha256 of what is left (null counts as empty)."""
    return without_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, text IS NULL AS missing FROM documents),
seq AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS norm,
  len(regexp_extract_all(line, '[^ \\t\\r]+')) >= {LONG_WORDS} AS long, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
runs AS (SELECT doc_id, s, norm || chr(10) || lead(norm, 1) OVER d || chr(10) || lead(norm, {RUN - 1}) OVER d AS content
  FROM seq WINDOW d AS (PARTITION BY doc_id ORDER BY s)),
later AS (SELECT doc_id, s, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS place FROM runs
  WHERE content IS NOT NULL),
long_later AS (SELECT doc_id, s, row_number() OVER (PARTITION BY norm ORDER BY doc_id, s) AS place FROM seq WHERE long),
gone AS (SELECT doc_id, s + k AS s FROM later, generate_series(0, {RUN - 1}) g(k) WHERE place > 1
 UNION SELECT doc_id, s FROM long_later WHERE place > 1),
deleted AS (SELECT doc_id, i FROM gone JOIN seq USING (doc_id, s))
SELECT l.doc_id, CASE WHEN bool_or(missing) THEN 0 ELSE count(*) END AS n_lines, count(d.i) AS n_removed,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (d.i IS NULL), '')) AS text_sha256
FROM lines l LEFT JOIN deleted d ON l.doc_id = d.doc_id AND l.i = d.i GROUP BY l.doc_id"""
