"""Toxicity by a convolutional text classifier, trained in numpy by Spark tasks on all labelled rows.

Words are hashed to buckets with an embedding each; filters over one, two and three neighbouring words are
followed by their maximum over the text and a logistic output. Embeddings start from how much oftener a
bucket occurs in toxic texts, so that the maxima look at telling words from the first step; buckets
never seen have the zero vector. The score is calibrated on a part of the learning rows that the filters
have not seen, and on that part a rejection threshold is chosen for each language.

Learning rows are dealt to shards by a hash of their ids. In every epoch each shard goes on from the same network in
a task of its own, and the networks are averaged: an embedding over the shards that moved it, all else over all shards.
The averages are sums of whole numbers, so they do not depend on the order in which tasks end. How often buckets
occur, the calibration and the thresholds are aggregates over all rows. Only the network, whose size
BUCKET_BITS bounds, and sums pass through the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.decontam import STEP, mixed, word_hashes, words_of
from ledgerloom.llm.labelled import held_out, training_labels
from ledgerloom.llm.shared import chunked, in_tasks, opened, removed, saved, shuffles_removed, text_buffer, work_folder
from ledgerloom.plans.shapes import running_totals

#: There are as many shards as give each about so many labelled documents and bytes of them; none is left out.
SHARD_ROWS = 8_000
SHARD_BYTES = 1 << 25
SLOTS = 1 << 20
#: Bounds of `learning_sample` only, which nothing is learned from.
LEARNED_ROWS = 8_000
LEARNED_WORDS = 1 << 23
LONGEST_SHARE = 64
BUCKET_BITS = 20
#: A word's vector is the sum of those of the word and of its first so many bytes.
BEGINNINGS = (4, 7)
KINDS = 1 + len(BEGINNINGS)
SIZE = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
TAPS = [(width, tap) for width in WIDTHS for tap in range(width)]
EPOCHS = 5
BATCH = 32
SMOOTHING = 10.0
RATE = 0.03
CALIBRATION_SHARE = 5
HELD_PARTS, HELD_PART = 4, 2
PREDICTED_FROM = 0.3
SCORED_BYTES = 1 << 19
#: Filters are laid over so many words at once; longer texts go in pieces that overlap by what the widest filter needs.
SPAN_WORDS = 1 << 16
SEED = 7
#: Parameters are averaged as whole numbers of this unit.
UNIT = 1 << 36
LEAST_ROWS, LEAST_TOXIC = 30, 5


def bucket_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word of all texts (the word, then its beginnings), and the first word number of each text."""
    lower, starts, stops, firsts = words_of(*text_buffer(texts))
    kinds = [word_hashes(lower, starts, np.minimum(stops, starts + length)) + np.full(1, length, np.uint64) * STEP
             for length in BEGINNINGS]
    words = np.stack([word_hashes(lower, starts, stops), *(mixed(k) for k in kinds)], axis=1)
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), firsts


@dataclass
class Network:
    """`rows` maps a bucket to its row of `embeddings`; row 0 is the zero vector of unseen words."""

    buckets: np.ndarray
    embeddings: np.ndarray
    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0

    def row_numbers(self) -> np.ndarray:
        rows = np.zeros(1 << BUCKET_BITS, np.int32)
        rows[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return rows

    def vectors(self, words: np.ndarray) -> np.ndarray:
        return sum(self.embeddings[words[:, kind]] for kind in range(KINDS))

    def maps(self, words: np.ndarray) -> list[np.ndarray]:
        """The filter outputs of each width at every word, before the maximum."""
        n = len(words)
        product = self.vectors(words) @ self.taps.reshape(SIZE, -1)
        product = product.reshape(n, len(TAPS), FILTERS)
        found = []
        for number, width in enumerate(WIDTHS):
            first = TAPS.index((width, 0))
            total = product[: n - width + 1 if n >= width else 0, first].copy()
            for tap in range(1, width):
                total += product[tap: tap + len(total), first + tap]
            found.append(total + self.bias[number])
        return found

    def maxima(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple]:
        """For each span and width: which texts have a window, how many, the outputs, their bounds and maxima by text.

        The spans between the chosen bounds also hold windows that cross into the next text; they are skipped.
        """
        for first, last, start, stop in spans(firsts):
            low = np.maximum(firsts[first:last], start) - start
            for number, (width, values) in enumerate(zip(WIDTHS, self.maps(words[start:stop]))):
                high = np.minimum(firsts[first + 1:last + 1], stop) - start - width + 1
                full = high > low
                if full.any():
                    bounds = np.stack([low[full], high[full]], axis=1).ravel()
                    cut = bounds[:-1] if bounds[-1] >= len(values) else bounds
                    yield number, np.flatnonzero(full) + first, start, values, bounds, np.maximum.reduceat(values, cut, axis=0)[::2]

    def pooled(self, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest output per text and filter (zero where a text is too short), and where it is first."""
        docs = len(firsts) - 1
        best = np.zeros((docs, len(WIDTHS), FILTERS), np.float32)
        place = np.full((docs, len(WIDTHS), FILTERS), -1)
        for number, here, start, values, bounds, most in self.maxima(words, firsts):
            better = most > best[here, number]
            sizes = np.diff(bounds)[::2]
            at = np.arange(sizes.sum()) + np.repeat(bounds[::2] - (np.cumsum(sizes) - sizes), sizes)
            row, column = np.nonzero(values[at] == np.repeat(np.where(better, most, np.inf), sizes, axis=0))
            owner = np.repeat(here, sizes)[row]
            place[owner[::-1], number, column[::-1]] = start + at[row[::-1]]
            best[here, number] = np.where(better, most, best[here, number])
        return best, place

    def logits(self, words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        best = np.zeros((len(firsts) - 1, len(WIDTHS), FILTERS), np.float32)
        for number, here, _, _, _, most in self.maxima(words, firsts):
            best[here, number] = np.maximum(best[here, number], most)
        total = np.full(len(best), self.out_bias)
        for number in range(len(WIDTHS)):
            total += best[:, number] @ self.out[number]
        return total * self.scale + self.shift


def spans(firsts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First and last text, first and last word of stretches of at most SPAN_WORDS words: whole texts, or overlapping pieces of one."""
    first, docs, most = 0, len(firsts) - 1, SPAN_WORDS
    while first < docs:
        last = max(first + 1, int(np.searchsorted(firsts, firsts[first] + most, "right")) - 1)
        start, end = int(firsts[first]), int(firsts[last])
        while end - start > most:
            yield first, last, start, start + most
            start += most - max(WIDTHS) + 1
        yield first, last, start, end
        first = last


def _sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def _initial(words: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Network:
    return _started(*occurrences(zip(words, labels)), labels.mean(), rng)


def occurrences(texts: Iterable[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """In how many toxic and how many clean texts every bucket occurs."""
    toxic, clean = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for text, label in texts:
        (toxic if label else clean)[np.unique(text)] += 1
    return toxic, clean


def _started(toxic: np.ndarray, clean: np.ndarray, share: float, rng: np.random.Generator) -> Network:
    odds = np.log((toxic + SMOOTHING * share) / (clean + SMOOTHING * (1 - share))) - np.log(share / (1 - share))
    buckets = np.flatnonzero(toxic + clean >= 2)
    embeddings = rng.normal(0, 0.05, (len(buckets) + 1, SIZE)).astype(np.float32)
    embeddings[1:, 0] = odds[buckets]
    embeddings[0] = 0
    taps = rng.normal(0, 0.2, (SIZE, len(TAPS), FILTERS)).astype(np.float32)
    taps[0] = np.abs(taps[0])
    return Network(buckets, embeddings, taps, np.zeros((len(WIDTHS), FILTERS), np.float32),
                   rng.uniform(0, 0.2, (len(WIDTHS), FILTERS)), float(np.log(share / (1 - share))))


def _step(net: Network, words: np.ndarray, firsts: np.ndarray, labels: np.ndarray, memory: dict[str, np.ndarray]) -> None:
    """One step of Adagrad on a few texts; gradients flow through the maxima only."""
    best, place = net.pooled(words, firsts)
    error = _sigmoid(net.out_bias + np.einsum("dwf,wf->d", best, net.out)) - labels
    grads = {"out": np.einsum("d,dwf->wf", error, best), "taps": np.zeros_like(net.taps), "bias": np.zeros_like(net.bias)}
    back = error[:, None, None] * net.out * (best > 0)
    touched, pulls = [], []
    for number, width in enumerate(WIDTHS):
        doc, filters = np.nonzero((place[:, number] >= 0) & (back[:, number] != 0))
        at, pull = place[doc, number, filters], back[doc, number, filters]
        np.add.at(grads["bias"][number], filters, pull)
        for tap in range(width):
            column = TAPS.index((width, tap))
            rows = words[at + tap]
            np.add.at(grads["taps"][:, column].T, filters, net.vectors(rows) * pull[:, None])
            touched.append(rows.ravel())
            pulls.append(np.repeat(net.taps[:, column, filters].T * pull[:, None], KINDS, axis=0))
    for name, grad in grads.items():
        grad = grad / len(labels)
        memory[name] += grad ** 2
        getattr(net, name)[...] -= RATE * grad / np.sqrt(memory[name] + 1e-8)
    net.out_bias -= RATE * float(error.mean())
    rows, pulled = np.concatenate(touched), np.concatenate(pulls) / len(labels)
    seen, where = np.unique(rows, return_inverse=True)
    total = np.zeros((len(seen), SIZE))
    np.add.at(total, where, pulled)
    total[seen == 0] = 0
    memory["embeddings"][seen] += (total ** 2).mean(axis=1)
    net.embeddings[seen] -= (RATE * total / np.sqrt(memory["embeddings"][seen] + 1e-6)[:, None]).astype(np.float32)


def _laid(words: list[np.ndarray] | dict[int, np.ndarray], rows: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    firsts = np.concatenate([[0], np.cumsum([len(words[i]) for i in picked])]).astype(np.int64)
    flat = np.concatenate([words[i] for i in picked]) if len(picked) else np.zeros((0, KINDS), np.int32)
    return rows[flat], firsts


def _state(net: Network) -> tuple:
    return net.buckets, net.embeddings, net.taps, net.bias, net.out, net.out_bias, net.scale, net.shift


def _constant(share: float) -> Network:
    """The network that gives every text the same score."""
    return Network(np.zeros(0, np.int64), np.zeros((1, SIZE), np.float32), np.zeros((SIZE, len(TAPS), FILTERS), np.float32),
                   np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros((len(WIDTHS), FILTERS)),
                   float(np.log(share / (1 - share))))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in chunked(batches, "text"):
        words, firsts = bucket_words(piece.column("text"))
        packed = sum(words[:, kind].astype(np.int64) << BUCKET_BITS * kind for kind in range(KINDS))
        columns = {name: piece.column(name) for name in ("doc_id", "label", "lang", "aside", "shard")}
        columns["words"] = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(packed, pa.int64()))
        yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])


LEARNED = "doc_id long, label double, lang string, aside boolean, shard int, words array<long>"


def _unpacked(words: np.ndarray) -> np.ndarray:
    buckets = np.empty((len(words), KINDS), np.int32)
    for kind in range(KINDS):
        buckets[:, kind] = (words >> BUCKET_BITS * kind) & ((1 << BUCKET_BITS) - 1)
    return buckets


def learning_rows(docs: DataFrame, labels: DataFrame) -> tuple[str, int]:
    """Write the words of all labelled documents that are not held out, a folder for each shard; its path and the number of shards.

    An id that repeats gives one text, the smallest that is not null. A word's buckets are packed into one long, of which
    files then hold each only once. A fifth of the rows, `aside`, only serves calibration. Texts meet their labels in one shuffle, for which
    a bounded table of the labels' hash slots spares most texts without a label.
    """
    picked = saved(training_labels(labels, "toxic", HELD_PARTS, HELD_PART), "picked")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    texts = docs.select("doc_id", "text", "lang").withColumn("slot", slot) \
        .join(F.broadcast(picked.select(slot.alias("slot")).distinct()), "slot", "left_semi").drop("slot")
    rows, size = picked.count(), texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-rows // SHARD_ROWS), -(-size // SHARD_BYTES))
    one = F.struct(F.col("text").isNull().alias("missing"), "text", F.coalesce("lang", F.lit("")).alias("lang")).alias("doc")
    both = texts.select("doc_id", one, F.lit(None).cast("double").alias("label")).unionByName(
        picked.select("doc_id", "label"), allowMissingColumns=True)
    dealt = both.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition("shard") \
        .groupBy("shard", "doc_id").agg(F.min("doc").alias("doc"), F.max("label").alias("label")) \
        .filter("doc IS NOT NULL AND label IS NOT NULL")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(CALIBRATION_SHARE)) == 0
    folder = work_folder(docs.sparkSession, "learned")
    with shuffles_removed(docs.sparkSession):
        dealt.select("doc_id", "label", "doc.lang", "doc.text", aside.alias("aside"), "shard") \
            .mapInArrow(in_tasks(_packed), LEARNED).write.partitionBy("shard") \
            .option("parquet.dictionary.page.size", 1 << 23).parquet(folder)
    return folder, shards


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def texts():
        for batch in batches:
            words, bounds = batch.column("words").flatten().to_numpy(), np.asarray(batch.column("words").offsets)
            bounds = bounds - bounds[0]
            for a, b, label in zip(bounds, bounds[1:], batch.column("label").to_pylist()):
                yield _unpacked(words[a:b]), label

    toxic, clean = occurrences(texts())
    met = np.flatnonzero(toxic + clean)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(toxic[met]), pa.array(clean[met])], ["bucket", "toxic", "clean"])


def _dense(net: Network, memory: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [net.out, net.taps, net.bias, np.array([net.out_bias]), memory["out"], memory["taps"], memory["bias"]]


#: An embedding and its memory, by row of the table; the other parameters one after the other, under negative numbers.
MOVED = ["place", *[f"v{i}" for i in range(SIZE + 1)]]


def _keep(net: Network, memory: dict[str, np.ndarray], folder: str) -> None:
    """Put the network where tasks read it; a broadcast for each epoch would leave a copy with every executor."""
    system, root = opened(folder)
    with system.open_output_stream(f"{root}/_network") as out:
        out.write(pickle.dumps((_state(net), memory)))


def _kept(folder: str) -> tuple[Network, dict[str, np.ndarray]]:
    system, root = opened(folder)
    with system.open_input_file(f"{root}/_network") as file:
        state, memory = pickle.loads(file.read())
    return Network(*state), memory


def _learn(folder: str, epoch: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One epoch over each of the shards named in `batches`, always from the same network: what has moved."""
    system, root = opened(folder)
    for shard in (number for batch in batches for number in batch.column("shard").to_pylist()):
        if system.get_file_info(f"{root}/shard={shard}").type == fs.FileType.NotFound:  # a shard without rows
            continue
        found = dataset.dataset(f"{root}/shard={shard}", filesystem=system, format="parquet") \
            .to_table(["doc_id", "label", "words"], filter=~dataset.field("aside"), use_threads=False).combine_chunks()
        if not found.num_rows:
            continue
        net, memory = _kept(folder)
        before = memory["embeddings"].copy()
        rows, labels = net.row_numbers(), found["label"].to_numpy()
        lists = found["words"].chunk(0)
        packed, bounds = lists.flatten().to_numpy(), np.asarray(lists.offsets)
        bounds = bounds - bounds[0]
        words = [packed[a:b] for a, b in zip(bounds, bounds[1:])]
        order = np.random.default_rng([SEED, shard, epoch]).permutation(np.argsort(found["doc_id"].to_numpy()))
        del found, lists
        for start in range(0, len(order), BATCH):  # unpacked by batch: all of a shard would take half as much again as packed
            picked = order[start: start + BATCH]
            _step(net, *_laid({i: _unpacked(words[i]) for i in picked}, rows, picked), labels[picked], memory)
        moved = np.flatnonzero(memory["embeddings"] != before)
        dense = np.concatenate([part.ravel() for part in _dense(net, memory)])
        dense = np.pad(dense, (0, -len(dense) % (SIZE + 1))).reshape(-1, SIZE + 1)
        values = np.concatenate([dense, np.column_stack([net.embeddings[moved], memory["embeddings"][moved]])])
        places = np.concatenate([np.arange(len(dense)) - len(dense), moved])
        whole = np.rint(values * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(places), *[pa.array(column) for column in whole.T.copy()]], MOVED)


def _averaged(net: Network, memory: dict[str, np.ndarray], moved: DataFrame) -> None:
    """Take over the means of what the shards have made of the network."""
    found = moved.groupBy("place").agg(*[F.sum(v).alias(v) for v in MOVED[1:]], F.count("*").alias("n")).toArrow().sort_by("place")
    place = found["place"].to_numpy()
    values = np.column_stack([found[v].to_numpy() for v in MOVED[1:]]) / found["n"].to_numpy()[:, None] / UNIT
    flat, rows = values[place < 0].ravel(), place[place >= 0]
    for part in _dense(net, memory):
        if len(part.ravel()) == 1:
            net.out_bias = float(flat[0])
        else:
            part[...] = flat[: part.size].reshape(part.shape)
        flat = flat[part.size:]
    net.embeddings[rows] = values[place >= 0, :SIZE]
    memory["embeddings"][rows] = values[place >= 0, SIZE]


def _rated(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    net, _ = _kept(folder)
    rows = net.row_numbers()
    for batch in batches:
        words, bounds = batch.column("words").flatten().to_numpy(), np.asarray(batch.column("words").offsets).astype(np.int64)
        bounds = bounds - bounds[0]
        found = [np.zeros(0)]
        for first, last in sorted({(a, b) for a, b, _, _ in spans(bounds)}):
            laid = rows[_unpacked(words[bounds[first]:bounds[last]])]
            found.append(net.logits(laid, bounds[first:last + 1] - bounds[first]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in ("doc_id", "label", "lang")), pa.array(np.concatenate(found))], ["doc_id", "label", "lang", "logit"])


def _calibrate(net: Network, rated: DataFrame) -> None:
    """Scale and shift of the logits by logistic regression, held near the identity where rows are few."""
    scale, shift = 1.0, 0.0
    for _ in range(50):
        at = F.greatest(F.least(F.lit(scale) * F.col("logit") + F.lit(shift), F.lit(30.0)), F.lit(-30.0))
        p = 1 / (1 + F.exp(-at))
        pull, weight = F.col("p") - F.col("label"), F.col("p") * (1 - F.col("p"))
        sums = rated.withColumn("p", p).agg(*[F.coalesce(F.sum(value), F.lit(0.0)) for value in (
            pull * F.col("logit"), pull, weight * F.col("logit") * F.col("logit"), weight * F.col("logit"), weight)]).first()
        gradient = np.array([sums[0] + (scale - 1), sums[1] + shift])
        change = np.linalg.solve(np.array([[sums[2] + 1, sums[3]], [sums[3], sums[4] + 1]]), gradient)
        before, (scale, shift) = (scale, shift), (max(0.1, scale - change[0]), shift - change[1])
        if abs(scale - before[0]) + abs(shift - before[1]) < 1e-10:
            break
    net.scale, net.shift = float(scale), float(shift)


def _thresholds(net: Network, rated: DataFrame) -> dict[str, float]:
    """Per language the threshold with the best F1, midway to the next lower score, within 0.2 to 0.8.

    "" is the one for languages with too few rows, from the rows of all. Places and hits are running totals along the logit.
    """
    rows = rated.select("label", "doc_id", (-F.col("logit")).alias("down"), F.floor(-64 * F.col("logit")).alias("piece"),
                        F.explode(F.array_distinct(F.array(F.lit(""), F.col("lang")))).alias("lang"))
    placed = running_totals(rows, ["lang"], ["piece"], ["down", "doc_id"], {"place": F.lit(1), "hits": F.col("label")})
    sums = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    enough = sums.filter(F.when(F.col("lang") == "", F.col("toxic") > 0).otherwise(
        (F.col("n") >= LEAST_ROWS) & (F.col("toxic") >= LEAST_TOXIC)))
    ranked = saved(placed.join(enough, "lang").select(
        "lang", "place", "down", (2 * F.col("hits") / (F.col("place") + F.col("toxic"))).alias("f1")), "ranked")
    best = ranked.groupBy("lang").agg(F.max(F.struct("f1", (-F.col("place")).alias("back"), "down")).alias("top"))
    after = ranked.select("lang", (1 - F.col("place")).alias("back"), F.col("down").alias("next"))
    chosen = best.select("lang", "top.back", "top.down").join(after, ["lang", "back"], "left").orderBy("lang").collect()

    def score(down: float | None) -> float:
        return 0.0 if down is None else float(_sigmoid(-down * net.scale + net.shift))

    return {"": 0.5} | {r.lang: float(np.clip((score(r.down) + score(r.next)) / 2, 0.2, 0.8)) for r in chosen}


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in chunked(batches, "text"):
        words, firsts = bucket_words(piece.column("text"))
        packed = [words[a:b].tobytes() for a, b in zip(firsts, firsts[1:])]
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("label"), piece.column("lang"), pa.array(packed, pa.binary())],
            ["doc_id", "label", "lang", "words"])


def learning_sample(docs: DataFrame, labels: DataFrame, rows: int = LEARNED_ROWS, n_words: int = LEARNED_WORDS) -> DataFrame:
    """label, lang and words of at most `rows` labelled documents, in the order of a hash of their ids, to look at.

    Nothing is learned from it: `fit` takes all `learning_rows`.
    An id that repeats gives one text, the smallest that is not null. Together the texts have at most `n_words` words; one
    that alone has over a LONGEST_SHARE-th of them is left out, so that it does not displace the others.
    """
    picked = training_labels(labels, "toxic", HELD_PARTS, HELD_PART).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = F.min(F.struct(F.col("text").isNull().alias("missing"), "text", F.coalesce("lang", F.lit("")).alias("lang"))).alias("doc")
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id") \
        .groupBy("doc_id").agg(one, F.max("label").alias("label"))
    found = saved(texts.select("doc_id", "label", "doc.lang", "doc.text").mapInArrow(
        in_tasks(_bucketed), "doc_id long, label double, lang string, words binary"), "learned")
    size = F.octet_length("words") / (4 * KINDS)
    in_order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = found.select("doc_id", size.alias("size")).filter(F.col("size") <= n_words / LONGEST_SHARE) \
        .withColumn("total", F.sum("size").over(in_order)).filter(F.col("total") <= n_words)
    return found.join(F.broadcast(kept.select("doc_id")), "doc_id").select("label", "lang", "words")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Network, dict[str, float]]:
    """A network learned from all labelled documents that are not held out, and a rejection threshold per language.

    With a single class the score is its smoothed share. The words learned from grow with the documents that have labels;
    they are deleted once the network is learned.
    """
    folder, shards = learning_rows(docs, labels)
    try:
        return _fitted(docs.sparkSession, folder, shards)
    finally:
        removed(docs.sparkSession, folder)


def _fitted(spark: SparkSession, folder: str, shards: int) -> tuple[Network, dict[str, float]]:
    rows = spark.read.schema(LEARNED).parquet(folder)
    n, toxic, least, most, share = rows.agg(
        F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0)), *[f(F.when(~F.col("aside"), F.col("label"))) for f in (F.min, F.max, F.avg)]).first()
    if least == most:
        return _constant((toxic + 0.5) / (n + 1)), {"": 0.5}
    counts = rows.filter(~F.col("aside")).select("label", "words").mapInArrow(in_tasks(_counted), "bucket long, toxic long, clean long") \
        .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    met = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    met[:, counts["bucket"].to_numpy()] = counts["toxic"].to_numpy(), counts["clean"].to_numpy()
    net = _started(*met, share, np.random.default_rng(SEED))
    memory = {name: np.zeros_like(getattr(net, name), dtype=float) for name in ("out", "taps", "bias")}
    memory["embeddings"] = np.zeros(len(net.embeddings))
    numbers = spark.range(shards, numPartitions=shards).select(F.col("id").alias("shard"))
    for epoch in range(EPOCHS):
        _keep(net, memory, folder)
        moved = numbers.mapInArrow(in_tasks(_learn, folder, epoch), ", ".join(f"{c} long" for c in MOVED))
        _averaged(net, memory, moved)
    _keep(net, memory, folder)
    rated = saved(rows.filter("aside").select("doc_id", "label", "lang", "words").mapInArrow(
        in_tasks(_rated, folder), "doc_id long, label double, lang string, logit double"), "rated")
    _calibrate(net, rated)
    return net, _thresholds(net, rated)


def _score(net: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = Network(*net)
    rows = parts.row_numbers()
    for piece in chunked(batches, "text", SCORED_BYTES):
        words, firsts = bucket_words(piece.column("text"))
        scores = _sigmoid(parts.logits(rows[words], firsts))
        yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores)], [*piece.schema.names, "score"])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """`docs` with the column score (0 to 1), from the text alone. Null and empty texts get the score of no words."""
    from pyspark.sql.types import DoubleType, StructType

    picked = docs.drop("score")
    return picked.mapInArrow(in_tasks(_score, _state(net)), StructType([*picked.schema.fields]).add("score", DoubleType()))


def threshold_of(thresholds: dict[str, float]):
    """The rejection threshold as a column of lang."""
    column = F.lit(thresholds[""])
    for lang, value in thresholds.items():
        if lang:
            column = F.when(F.col("lang") == lang, value).otherwise(column)
    return column


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (score of 0.3 or more), rejected (by the language's threshold).

    doc_id is a long; columns but doc_id, text and lang are not read, whatever their names. A text is scored whole, whatever its length.
    """
    net, thresholds = fit(docs, labels)
    return score(docs.select("doc_id", "lang", "text"), net).select(
        "doc_id", held_out(F.col("doc_id"), HELD_PARTS, HELD_PART).alias("held_out"), "score",
        (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"),
        (F.col("score") >= threshold_of(thresholds)).alias("rejected"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with their own columns, whose score stays below the threshold of their language.

    Columns have names by their place on the way, so that a text goes to Python and back once, and names may be of any kind.
    """
    net, thresholds = fit(docs, labels)
    placed = docs.toDF(*[c if c in ("text", "lang") else f"_{i}" for i, c in enumerate(docs.columns)])
    return score(placed, net).filter(F.col("score") < threshold_of(thresholds)).drop("score").toDF(*docs.columns)
