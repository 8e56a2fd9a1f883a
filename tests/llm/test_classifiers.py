import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from llm_cases import counted, documents, empty_like, prose
from pyspark.sql import functions as F

from ledgerloom.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int"
RUDE = ["scoundrel", "nitwit", "buffoon", "blockhead"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Prose; toxic texts hold rude words, poor ones shout or repeat themselves."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(700):
        words = prose(rng, rng.randint(20, 60)).split(" ")
        toxic, poor = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        text = " ".join(words)
        if poor:
            text = text.upper() + "!! @@ ##" if rng.random() < 0.5 else " ".join(words[:1] * 30)
        docs.append((i, text, rng.choice(["en", "fr"]), "s"))
        labels.append((i, int(not poor), int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").cache(),
            spark.createDataFrame(labels, LABELS).cache())


def accuracy(rows, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    assert held and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    return np.mean([truth[r.doc_id] == r.predicted for r in held])


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = toxicity.toxicity(docs, labels).collect()
    assert {r.doc_id for r in rows if r.held_out} == {i for i in range(700) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert accuracy(rows, labels.filter(F.col("quality") == 1).unionByName(labels.filter(F.col("quality") == 0)), "toxic") > 0.85


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = quality.quality(docs, labels).collect()
    assert {r.doc_id for r in rows if r.held_out} == {i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert accuracy(rows, labels, "quality") > 0.95


def test_scores_look_at_nothing_but_the_text(labelled):
    docs, labels = labelled
    net, _ = toxicity.fit(docs, labels)
    model = quality.fit(quality.with_statistics(docs), labels)
    moved = docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.lit("de").alias("lang"), F.lit("t").alias("source"))

    def scores(rows):
        toxic = {r.text: r.score for r in toxicity.score(rows, net).collect()}
        texts = {r.doc_id: r.text for r in rows.collect()}
        good = quality.with_statistics(rows).select("doc_id", model.column().alias("score")).collect()
        return toxic, {texts[r.doc_id]: r.score for r in good}

    assert scores(docs) == scores(moved)


def test_held_out_labels_teach_nothing(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumns({
        "toxic": F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")),
        "quality": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))})
    for run in (toxicity.toxicity, quality.quality):
        left, right = ({r.doc_id: r.score for r in run(docs, given).collect()} for given in (labels, flipped))
        assert left == pytest.approx(right)


def test_odd_rows_and_empty_tables(spark, labelled):
    _, labels = labelled
    docs, none = documents(spark), spark.createDataFrame([], LABELS)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 1, 0), (5, 0, 1)], LABELS))
    for run in (toxicity.toxicity, quality.quality):
        rows = run(docs, odd).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in run(docs, none).collect()}) == 1
        assert run(empty_like(docs), none).count() == 0
        assert run(docs, labels.withColumns({"toxic": F.lit(0), "quality": F.lit(1)})).count() == docs.count()


def test_stage_drops_toxic_rows_only(labelled):
    docs, labels = labelled
    left = toxicity.without_toxic(docs.withColumn("score", F.lit("x")), labels)
    rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.rejected}
    assert {r.doc_id for r in left.collect()} == set(range(700)) - rejected
    assert left.columns == ["doc_id", "text", "lang", "source", "score"] and 0 < len(rejected) < 350


def test_logits_equal_pooling_text_by_text():
    rng = np.random.default_rng(2)
    words = [rng.integers(1, 1 << toxicity.BUCKET_BITS, (n, toxicity.KINDS)).astype(np.int32) for n in [0, 1, 2, 3, 50, 0, 7, 1]]
    net = toxicity._initial([*words, *words], np.array([0, 1] * 8), rng)
    net.out = rng.normal(0, 1, net.out.shape)
    laid, firsts = toxicity._laid(words, net.row_numbers(), np.arange(len(words)))
    best, _ = net.pooled(laid, firsts)
    assert np.allclose(net.logits(laid, firsts), net.out_bias + np.einsum("dwf,wf->d", best, net.out), atol=1e-5)


def test_rules_are_the_paths_of_a_tree():
    tree = """DecisionTreeClassificationModel: depth=2
  If (feature 3 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 1.0
   Else (feature 1 > 2.0)
    Predict: 0.0
  Else (feature 3 > 0.5)
   Predict: 0.0"""
    low, high = (3, "<=", 0.5), (3, ">", 0.5)
    assert quality.rules_of(tree) == [(low,), (low, (1, "<=", 2.0)), (low, (1, ">", 2.0)), (high,)]


def test_statistics_of_a_text(spark):
    row = spark.createDataFrame([("AB ab ab.\n#1!",)], "text string").select(
        *[c.alias(name) for name, c in quality.statistics(F.col("text")).items()]).first()
    assert quality.FEATURES == row.__fields__
    assert (row.upper, row.digits, row.symbols, row.exclaims, row.stops) == pytest.approx([2 / 13, 1 / 13, 1 / 13, 1 / 13, 1 / 13])
    assert (row.distinct_words, row.distinct_lines, row.line_words, row.same_next) == (1.0, 1.0, 2.0, 0.0)


def test_the_learning_sample_is_bounded(spark, labelled):
    """An id that repeats gives one text whatever the order, and the words have a bound as well as the rows."""
    docs, labels = labelled
    learned = next(r.doc_id for r in labels.orderBy("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    again = spark.range(400).selectExpr(
        f"cast({learned} AS long) AS doc_id", "if(id = 0, null, concat('copy ', id)) AS text", "'en' AS lang", "'s' AS source")
    repeated = docs.unionByName(again)
    samples = [counted(toxicity.learning_sample(d, labels).select("label", "lang", "words").collect())
               for d in (repeated, repeated.repartition(7), again.unionByName(docs))]
    n = toxicity.learning_sample(docs, labels).count()
    assert samples[0] == samples[1] == samples[2] and sum(samples[0].values()) == n > 400
    few = toxicity.learning_sample(docs, labels, n_words=4_000).collect()
    words = [len(r.words) // (4 * toxicity.KINDS) for r in few]
    assert 3_000 < sum(words) <= 4_000 and max(words) <= 4_000 / toxicity.LONGEST_SHARE


def test_everything_labelled_is_learned_from(spark):
    """More rows than a sample had, over several shards, and a text longer than a sample took: all counted, none left out."""
    docs = spark.range(12_000).selectExpr(
        "id AS doc_id", "concat('w', id div 3, ' v', id % 50, if(id % 7 = 0, ' nitwit', '')) AS text", "'en' AS lang")
    docs = docs.unionByName(spark.range(12_000, 12_002).selectExpr("id AS doc_id", "repeat('long text ', 80000) AS text", "'en' AS lang"))
    labels = docs.selectExpr("doc_id", "1 AS quality", "cast(doc_id % 7 = 0 AS int) AS toxic")
    folder, shards = toxicity.learning_rows(docs, labels)
    learned = spark.read.parquet(folder)
    assert learned.select("doc_id").distinct().count() == learned.count() == labels.filter("crc32(cast(doc_id AS string)) % 4 <> 2").count() > 8_900
    assert shards == learned.select("shard").distinct().count() == 2 and learned.filter("size(words) = 160000").count() >= 1
    met = [np.unique(toxicity._unpacked(np.array(r.words))) for r in learned.filter("NOT aside").collect()]
    buckets, times = np.unique(np.concatenate(met), return_counts=True)
    assert toxicity.fit(docs, labels)[0].buckets.tolist() == buckets[times >= 2].tolist()


def test_what_is_learned_from_goes_once_it_is_learned(spark, labelled, monkeypatch):
    """The words of all labelled rows take disk in proportion to the documents; no later stage has to make room for them."""
    docs, labels = labelled
    made, plain = [], toxicity.work_folder

    def noted(session, name):
        made.append(plain(session, name))
        return made[-1]

    monkeypatch.setattr(toxicity, "work_folder", noted)
    for some in (labels, labels.filter("toxic = 0")):
        kept = toxicity.without_toxic(docs, some)
        assert not Path(made[-1]).exists()
        assert 0 < kept.count() <= docs.count()
    assert len(made) == 2


def test_shards_learn_as_well(labelled, monkeypatch):
    """Networks averaged over many shards tell as much, and the same whatever order rows come in."""
    docs, labels = labelled
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    rows = toxicity.toxicity(docs, labels).collect()
    assert accuracy(rows, labels, "toxic") > 0.85
    again = toxicity.toxicity(docs.repartition(7), labels.repartition(5)).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx({r.doc_id: r.score for r in again})


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    words = [rng.integers(1, 1 << toxicity.BUCKET_BITS, (n, toxicity.KINDS)).astype(np.int32) for n in [0, 70, 2, 41, 20, 1, 22, 19]]
    net = toxicity._initial([*words, *words], np.array([0, 1] * 8), rng)
    net.out = rng.normal(0, 1, net.out.shape)
    laid, firsts = toxicity._laid(words, net.row_numbers(), np.arange(len(words)))
    whole = net.logits(laid, firsts), *net.pooled(laid, firsts)
    monkeypatch.setattr(toxicity, "SPAN_WORDS", 20)
    assert max(stop - start for _, _, start, stop in toxicity.spans(firsts)) == 20
    assert np.allclose(whole[0], net.logits(laid, firsts), atol=1e-5)
    best, place = net.pooled(laid, firsts)
    assert np.allclose(whole[1], best, atol=1e-5) and (whole[2] == place)[best > 0].all()
