import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
import xxhash
from llm_cases import Groups, counted, documents, empty_like, lower_ascii
from pyspark.sql import functions as F

from ledgerloom.llm import buckets, contentsort, simhash
from ledgerloom.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    groups = Groups(len(prints))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                groups.join(i, j)
    lowest = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            lowest[groups.find(i)] = min(doc, lowest.get(groups.find(i), doc))
    return [lowest.get(groups.find(i)) for i in range(len(ids))]


def test_near_duplicates_equal_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    prints = [brute_print(r.text) for r in rows]
    lowest = brute_components([r.doc_id for r in rows], prints)
    want = counted((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, lowest))
    assert counted(simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty_like(docs)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = documents(spark).filter("doc_id IS NOT NULL")
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    left = simhash.one_of_each_group(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(groups)


@pytest.mark.parametrize("block", [2048, 5])
def test_dense_groups_keep_all_links(spark, monkeypatch, block):
    """Walks of a few flipped bits: most links are between neighbours of one dense group."""
    rng = random.Random(block)
    prints = set()
    for _ in range(4):
        value = rng.getrandbits(64)
        for _ in range(40):
            for _ in range(rng.randint(1, 4)):
                value ^= 1 << rng.randrange(64)
            prints.add(value)
    prints = sorted(prints)
    monkeypatch.setattr(buckets.bucket_links, "__defaults__", ((), block))
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.fp % (1 << 64): r.lowest for r in simhash.print_components(rows, F.col("doc_id")).collect()}
    assert [got[p] for p in prints] == brute_components(list(range(len(prints))), prints)


def test_chain_filter_never_drops_a_link():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        ring = [((a ^ b) >> (8 * i) & 255).bit_count() for i in range(8)]
        chains = [all(sum((ring * 2)[i:i + n]) <= 3 * n // 8 for n in range(1, 9)) for i in range(8)]
        assert any(chains)
        start = chains.index(True)
        group = pa.table({"member": pa.array([a, b], pa.uint64()).view(pa.int64()), "key": pa.array([3 * start << 32] * 2)})
        assert simhash.within_budget(group).all()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(7, 7), (200, 201), (200, 201)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = defaultdict(set)
    for node, component in found.items():
        groups[component].add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(1, 50)), list(range(100, 161)), [200, 201]]


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    for norm, group in groups.items():
        group.sort(key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for place, r in enumerate(group):
            yield r.doc_id, group[0].doc_id, len(group), place == 0, hashlib.sha256(norm.encode()).hexdigest()


def test_exact_duplicates_equal_brute_force(spark):
    docs = documents(spark)
    assert counted(contentsort.exact_duplicates(docs).collect()) == counted(brute_exact(docs.collect()))
    assert contentsort.exact_duplicates(empty_like(docs)).count() == 0


def test_a_group_over_many_ranges(spark):
    """A third of the rows are one text, dealt over many ranges that each hold a piece of the group."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.concat(F.lit("same text"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")))
    ).otherwise(F.concat(F.lit("t"), (F.col("id") % 200).cast("string"))).alias("text"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for part in (docs, docs.filter("doc_id % 3 = 0")):
            assert counted(contentsort.exact_duplicates(part).collect()) == counted(brute_exact(part.collect()))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
