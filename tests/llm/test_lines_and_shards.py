import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from llm_cases import counted, documents, empty_like
from pyspark.sql import functions as F

from ledgerloom.llm import linerun, sharding


def brute_lines(rows):
    """The definition: a line goes if it, or RUN lines that it lies in, occur before, in order of doc_id and line; alone only if long."""
    seen, gone = set(), defaultdict(set)
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0, i))
    for i in order:
        lines = (rows[i].text or "").split("\n")
        kept = [n for n, line in enumerate(lines) if line.strip(" \t\r")]
        for s in range(len(kept) - linerun.RUN + 1):
            run = tuple(lines[n].strip(" \t\r") for n in kept[s:s + linerun.RUN])
            if run in seen:
                gone[i].update(kept[s:s + linerun.RUN])
            seen.add(run)
        for n in kept:
            line = lines[n].strip(" \t\r")
            if len(re.findall("[^ \t\r]+", line)) >= linerun.LONG_WORDS:
                if line in seen:
                    gone[i].add(n)
                seen.add(line)
    for i, r in enumerate(rows):
        lines = (r.text or "").split("\n")
        left = "\n".join(line for n, line in enumerate(lines) if n not in gone[i])
        yield r.doc_id, 0 if r.text is None else len(lines), len(gone[i]), hashlib.sha256(left.encode()).hexdigest()


@pytest.fixture(scope="module")
def lined(spark):
    """Documents whose lines repeat in runs, inside and across texts, with blank lines between."""
    block = "first line\nsecond line \n\n third line\nfourth line"
    rows = [(50, "a\nb\n" + block + "\nc"), (51, block), (52, "second line\nthird line\nfourth line\nz"), (53, "first line\nsecond line"),
            (54, "q\r\n" + block.replace("\n", "\r\n")), (None, block + "\nown"), (49, "third line\nfourth line\n\n"), (55, "\n\n\n\n")]
    long = "  " + "long words " * 25 + "\r"
    rows += [(60, "own\n" + long), (61, long + "\nother\n" + "long  words " * 25), (62, long + "\n" + long), (63, "few words " * 9 + "x"), (64, "few words " * 9 + "x")]
    extra = spark.createDataFrame([(i, t, "en", "s", 0, "r", "d", 1, "z") for i, t in rows], documents(spark).schema)
    return documents(spark).unionByName(extra)


def test_lines_equal_the_definition(spark, lined):
    """Rows that share an id and a text are interchangeable, so counting rows is enough."""
    want = counted(brute_lines(lined.collect()))
    assert counted(linerun.line_digests(lined).collect()) == want
    assert sum(row[2] for row in want) > 50
    assert linerun.line_digests(empty_like(lined)).count() == 0


def test_cut_texts_keep_columns(lined):
    cut = linerun.without_repeats(lined.withColumnRenamed("source", "runs"))
    assert cut.columns == [*["runs" if c == "source" else c for c in lined.columns], "n_lines", "n_removed"]
    assert cut.filter("doc_id = 901").first().text is None
    assert cut.filter("doc_id = 907").first().text == "same line"


def test_line_dedup_uses_no_python(spark, lined):
    plan = linerun.without_repeats(lined)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_lines_equal_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(f"SELECT doc_id, n_lines, n_removed, text_sha256 FROM ({linerun.ORACLE})").fetchall()
    got = linerun.line_digests(spark.read.parquet(path)).select("doc_id", "n_lines", "n_removed", "text_sha256")
    assert counted(got.collect()) == counted(want)


@pytest.mark.parametrize("limit", [300, 5_000, 1 << 20])
def test_shards_keep_to_the_limit_and_no_more_are_split(spark, limit):
    docs = documents(spark)
    sizes = {}
    for r in docs.collect():
        sizes[r.doc_id, len((r.text or "").encode())] = sizes.get((r.doc_id, len((r.text or "").encode())), 0) + 1
    rows = sharding.assign_shards(docs, limit).collect()
    assert len(rows) == docs.count()
    total, count = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.depth == len(r.shard) and set(r.shard) <= {"0", "1"}
        total[r.shard], count[r.shard] = r.shard_bytes, r.shard_docs
    assert all(total[s] <= limit or count[s] == 1 for s in total)
    assert sum(total.values()) == sum(size * n for (_, size), n in sizes.items()) and sum(count.values()) == len(rows)
    for shard in total:
        below = sum(total[s] for s in total if s.startswith(shard[:-1]))
        assert shard == "" or below > limit and sum(count[s] for s in total if s.startswith(shard[:-1])) > 1
        assert not any(other != shard and other.startswith(shard) for other in total)


def test_rows_equal_in_all_columns_are_parted(spark):
    same = spark.range(200).selectExpr("cast(null AS long) AS doc_id", "repeat('x', 100) AS text")
    rows = sharding.assign_shards(same, 1_000).collect()
    assert len(rows) == 200 and max(r.shard_bytes for r in rows) <= 1_000
    assert min(r.depth for r in rows) > sharding.HASH_BITS
    assert sharding.assign_shards(empty_like(same), 1_000).count() == 0


def test_written_shards_hold_everything(spark, tmp_path):
    docs = documents(spark)
    sharding.write_shards(docs, str(tmp_path / "shards"), 5_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert counted(back.select("doc_id", "text").collect()) == counted(docs.select("doc_id", "text").collect())
    assert set(back.columns) == set(docs.columns)


def test_written_shards_are_the_assigned_ones_whatever_the_partitions(spark, tmp_path):
    docs = documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    want = {(r.doc_id, r.shard) for r in sharding.assign_shards(docs, 5_000).collect()}
    for parts in (1, 7):
        folder = str(tmp_path / f"shards{parts}")
        sharding.write_shards(docs.repartition(parts), folder, 5_000)
        assert {(r.doc_id, r.shard[1:]) for r in spark.read.parquet(folder).collect()} == want


def test_a_third_of_all_rows_equal_and_odd_column_names(spark, tmp_path):
    rows = [(i % 200 if i % 3 else None, f"text {i} " + "y" * (i % 90) if i % 3 else "x" * 100, i, "s") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, shard string").repartition(3)
    sharding.write_shards(docs, str(tmp_path / "shards"), 2_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert counted(back.select("doc_id", "text", "`a.b`").collect()) == counted(docs.select("doc_id", "text", "`a.b`").collect())
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n"), F.max(F.length("shard")).alias("depth")).collect()
    assert max(r.n for r in sizes) <= 2_000 and max(r.depth for r in sizes) > sharding.HASH_BITS
    sharding.write_shards(empty_like(docs), str(tmp_path / "none"), 2_000)


def test_the_sharding_query_reports_files(spark):
    from ledgerloom.llm.queries import op3_sharding

    sf = "/root/testdata/sf0.001"
    rows = op3_sharding(spark, sf)
    columns = ["doc_id", "shard", "depth", "shard_bytes", "shard_docs"]
    want = sharding.assign_shards(spark.read.parquet(f"{sf}/documents.parquet"))
    assert counted(rows.select(columns).collect()) == counted(want.select(columns).collect())
    assert any("/shards-" in f and "/shard=s" in f for f in rows.inputFiles())
