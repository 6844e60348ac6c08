"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions. For every context of 0 to 3 bytes each decision has its two counts and
a Krichevsky-Trofimov estimate; contexts of all depths are mixed by weighting: a node's probability is
half its own estimate's and half the product of its longer contexts'. A context is the bytes themselves
(A-Z in lower case) and the start of the text; none are put together. All training texts are counted.

Counts are shuffled by context. Trees are weighted in groups of the nearest byte and a range of the byte
before it, at most 16 * 257 contexts of 256 bytes each; the driver sees what lies above them, contexts of
one byte at most. Log probabilities are worked out for the places that texts hold: those of the most
frequent places are broadcast, a bounded number, and all others are joined.

Words of the base score are counted over all training texts and scored in the same way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkproof.llm.common import LOWER_BYTES, arrow_rows, keep, partition_id, remainder, text_bytes, texts_of

HELD_OUT = 2
FOLDS = 7
DEPTH = 3
#: Bytes, and the start of a text.
CLASSES = 257
#: Bytes before the nearest one that a group of contexts holds.
RANGE = 16
#: Most frequent places (a context and the byte after it) that every worker holds; the rest are joined.
BROADCAST_PLACES = 500_000
#: Most frequent words that every worker holds; the rest are joined.
BROADCAST_WORDS = 100_000
#: Distinct words a task gathers before it hands them on.
TASK_WORDS = 200_000
#: Distinct places a task gathers before it hands them on.
TASK_PLACES = 2_000_000
END = b" "


#: Number of each byte as a context; 0 is the start of a text.
BYTE_CLASSES = np.arange(1, CLASSES)


def contexts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Context numbers (nearest byte first) and bytes of a text in lower case."""
    b = np.frombuffer(data.translate(LOWER_BYTES), np.uint8)
    c = BYTE_CLASSES[b]
    key = np.zeros(len(b), np.int64)
    for d in range(1, DEPTH + 1):
        key *= CLASSES
        key[d:] += c[:-d] if d < len(b) else 0
    return key, b


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    from math import lgamma

    top = int(max(zeros.max(initial=0), ones.max(initial=0), (zeros + ones).max(initial=0)))
    if top <= 100_000:
        half = np.concatenate([[0.0], np.cumsum(np.log(np.arange(top) + 0.5))])
        whole = np.concatenate([[0.0], np.cumsum(np.log(np.arange(top) + 1.0))])
        return half[zeros] + half[ones] - whole[zeros + ones]
    gamma = np.vectorize(lgamma, otypes=[float])
    return (
        gamma(zeros + 0.5) + gamma(ones + 0.5) - gamma(zeros + ones + 1.0) - 2 * lgamma(0.5)
    )


def decision_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 decisions from counts of the 256 bytes (last axis). Decision 1 is the
    highest bit; decision i is followed by 2i after a zero and 2i + 1 after a one."""
    sums = np.zeros((*counts.shape[:-1], 512), np.int64)
    sums[..., 256:] = counts
    for w in (128, 64, 32, 16, 8, 4, 2, 1):
        sums[..., w : 2 * w] = sums[..., 2 * w : 4 * w : 2] + sums[..., 2 * w + 1 : 4 * w : 2]
    inner = np.arange(256)
    zeros, ones = sums[..., 2 * inner], sums[..., 2 * inner + 1]
    ones[..., 0] = 0  # there is no decision 0
    return zeros, ones


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def own_share(kt: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate against its longer contexts'."""
    return np.exp(np.minimum(kt - np.log(2) - weighted, 0.0))


def byte_logs(one: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from those of a one at every decision (last axis)."""
    out = np.zeros((*one.shape[:-1], 512))
    for w in (1, 2, 4, 8, 16, 32, 64, 128):
        out[..., 2 * w : 4 * w : 2] = out[..., w : 2 * w] + np.log10(1 - one[..., w : 2 * w])
        out[..., 2 * w + 1 : 4 * w : 2] = out[..., w : 2 * w] + np.log10(one[..., w : 2 * w])
    return out[..., 256:]


def rows_in(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted name among ordered names, or -1."""
    if not len(names):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, at, -1)


class Subtree:
    """Contexts of DEPTH and of DEPTH - 1 bytes of a group: what they hold, the shorter ones weighted."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, n: np.ndarray):
        """One row for each context and byte."""
        self.long, row = np.unique(context, return_inverse=True)
        counts = np.zeros((len(self.long), 256), np.int64)
        np.add.at(counts, (row, byte), n)
        zeros, ones = decision_counts(counts)
        self.long_estimate = estimate(zeros, ones)
        self.short, row = np.unique(self.long // CLASSES, return_inverse=True)
        self.counts = np.zeros((len(self.short), 256), np.int64)
        np.add.at(self.counts, row, counts)
        below = np.zeros((len(self.short), 256))
        np.add.at(below, row, log_kt(zeros, ones))
        zeros, ones = decision_counts(self.counts)
        kt = log_kt(zeros, ones)
        self.short_estimate = estimate(zeros, ones)
        self.weighted = np.logaddexp(kt, below) - np.log(2)
        self.share = own_share(kt, self.weighted)

    def ones_after(self, context: np.ndarray) -> np.ndarray:
        """What these contexts say of a one at every decision; those that were not seen are even."""
        longer, out = np.full((len(context), 256), 0.5), np.full((len(context), 256), 0.5)
        at = rows_in(self.long, context)
        longer[at >= 0] = self.long_estimate[at[at >= 0]]
        at = rows_in(self.short, context // CLASSES)
        seen = at[at >= 0]
        out[at >= 0] = self.share[seen] * self.short_estimate[seen] + (1 - self.share[seen]) * longer[at >= 0]
        return out


#: Group of a place: its nearest byte and the range of the byte before.
GROUP = f"place div {256 * CLASSES**2} * {CLASSES} + place div {256 * CLASSES} % {CLASSES} div {RANGE}"
SUMS_DDL = "first int, counts binary, weighted binary"
LOGS_DDL = "place long, log double"


def subtree_of(rows: pd.DataFrame) -> Subtree:
    seen = rows[rows["n"] > 0]
    place = seen["place"].to_numpy()
    return Subtree(place // 256, place % 256, seen["n"].to_numpy())


def subtree_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """What a group adds to the context of its nearest byte."""
    tree = subtree_of(rows)
    first = int(tree.short[0]) // CLASSES
    sums = (first, tree.counts.sum(axis=0).tobytes(), tree.weighted.sum(axis=0).tobytes())
    return pd.DataFrame([sums], columns=["first", "counts", "weighted"])


def place_logs(top: object) -> Callable:
    """log10 probabilities of the places of a group that are asked for."""

    def logs(rows: pd.DataFrame) -> pd.DataFrame:
        place = rows["place"][rows["asked"]].to_numpy()
        if not len(place):
            return pd.DataFrame({"place": place, "log": np.zeros(0)})
        context, row = np.unique(place // 256, return_inverse=True)
        first = int(context[0]) // CLASSES ** (DEPTH - 1)
        ones = top.value.given(first, subtree_of(rows).ones_after(context))
        return pd.DataFrame({"place": place, "log": byte_logs(ones)[row, place % 256]})

    return logs


class Top:
    """Contexts of one byte and of none: a one's probability there is a part of their own and a share of
    what longer contexts say. `table`: log10 probabilities of the bytes where no longer context is known."""

    def __init__(self, sums: pa.Table):
        counts, below = np.zeros((CLASSES, 256), np.int64), np.zeros((CLASSES, 256))
        for first, c, w in zip(*[sums[k].to_pylist() for k in ("first", "counts", "weighted")], strict=True):
            counts[first] += np.frombuffer(c, np.int64)
            below[first] += np.frombuffer(w, float)
        zeros, ones = decision_counts(counts)
        kt = log_kt(zeros, ones)
        weighted = np.logaddexp(kt, below) - np.log(2)
        share = own_share(kt, weighted)
        root_zeros, root_ones = zeros.sum(axis=0), ones.sum(axis=0)
        root_kt = log_kt(root_zeros, root_ones)
        root = own_share(root_kt, np.logaddexp(root_kt, weighted.sum(axis=0)) - np.log(2))
        self.own = root * estimate(root_zeros, root_ones) + (1 - root) * share * estimate(zeros, ones)
        self.rest = (1 - root) * (1 - share)
        self.table = byte_logs(self.own + 0.5 * self.rest)

    def given(self, first: int, longer: np.ndarray) -> np.ndarray:
        return self.own[first] + self.rest[first] * longer


class Model:
    """Counts of all places (place, n) of the training texts, and the top of their tree."""

    def __init__(self, counts: DataFrame):
        self.counts = counts
        groups = counts.withColumn("group", F.expr(GROUP)).groupBy("group")
        self.top = Top(groups.applyInPandas(lambda rows: subtree_sums(rows), SUMS_DDL).toArrow())
        self.table = self.top.table
        self.held = counts.sparkSession.sparkContext.broadcast(self.top)

    def logs(self, places: DataFrame) -> DataFrame:
        """place, log: log10 probability of the byte of each of these distinct places, seen or not."""
        asked = places.select("place", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
        rows = self.counts.select("place", "n", F.lit(False).alias("asked")).union(asked)
        return rows.withColumn("group", F.expr(GROUP)).groupBy("group").applyInPandas(place_logs(self.held), LOGS_DDL)

    def frequent(self) -> Places:
        top = self.counts.orderBy(F.desc("n"), "place").limit(BROADCAST_PLACES)
        found = self.logs(keep(top, "frequent")).join(self.counts, "place").toArrow()
        return Places(*[found[c].to_numpy() for c in ("place", "log", "n")])


class Places:
    """Log probabilities of some places, found by a table of hashes."""

    def __init__(self, place: np.ndarray, log: np.ndarray, n: np.ndarray):
        order = np.argsort(place)
        self.place, self.log = place[order], log[order]
        self.shift = np.uint64(64 - max(10, (4 * len(place)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        # Of places that share a slot the most frequent has it; others are searched for.
        often = np.lexsort((place[order], n[order]))
        self.slots[self.slot(self.place[often])] = often

    def slot(self, place: np.ndarray) -> np.ndarray:
        return (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def score(self, text: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        """Sum of the known places of a text; its other places and how often each stands there."""
        key, b = contexts(text)
        place = key * 256 + b
        if not len(self.place):
            return 0.0, *np.unique(place, return_counts=True)
        at = self.slots[self.slot(place)]
        known = self.place[at] == place
        total = float(self.log[at[known]].sum())
        if known.all():
            return total, place[:0], place[:0]
        others, times = np.unique(place[~known], return_counts=True)
        at = rows_in(self.place, others)
        total += float((self.log[at] * times)[at >= 0].sum())
        return total, others[at < 0], times[at < 0]


GATHERED = pa.schema([("word", pa.binary()), ("place", pa.int64()), ("n", pa.int64())])
GATHERED_DDL = "word binary, place long, n long"


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of bytes in their contexts, from a task's training texts."""
    words: Counter = Counter()
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def word_rows() -> pa.RecordBatch:
        m = len(words)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.binary()), pa.nulls(m, pa.int64()), pa.array(list(words.values()), pa.int64())],
            schema=GATHERED,
        )

    def place_rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n)], schema=GATHERED)

    for batch in batches:
        found: list[np.ndarray] = []
        pending = 0
        for text in texts_of(batch):
            text = text or b""
            # The end is counted as the blank, which is no word.
            words.update(text.translate(LOWER_BYTES).split())
            words[END] += 1
            key, b = contexts(text)
            found.append(key * 256 + b)
            pending += len(b)
            if pending > 4_000_000:
                keys, n = merge_counts(keys, n, found)
                found, pending = [], 0
        keys, n = merge_counts(keys, n, found)
        if len(words) > TASK_WORDS:
            yield word_rows()
            words.clear()
        if len(keys) > TASK_PLACES:
            yield place_rows()
            keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if words:
        yield word_rows()
    if len(keys):
        yield place_rows()


def merge_counts(keys: np.ndarray, n: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return keys, n
    new, times = np.unique(np.concatenate(found), return_counts=True)
    union, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
    return union, np.bincount(at, weights=np.concatenate([n, times]).astype(float), minlength=len(union)).astype(np.int64)


SCORED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("logs", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("place", pa.int64()), ("times", pa.int64()),
])
SCORED_DDL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, word binary, place long, times long"


def scorer(held: object) -> Callable:
    """A row for each text, with what frequent words and places give; and rows for its others."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, frequent = held.value
        row = partition_id() << 40
        for batch in batches:
            rows, tokens, known, logs, scores = [], [], [], [], []
            rare_rows, rare_words, rare_times = [], [], []
            other_rows, others, other_times = [], [], []
            for text in texts_of(batch):
                text = text or b""
                words = [*text.translate(LOWER_BYTES).split(), END]
                found = [c for w in words if (c := frequent.get(w)) is not None]
                if len(found) < len(words):
                    for word, times in Counter(w for w in words if w not in frequent).items():
                        rare_rows.append(row)
                        rare_words.append(word)
                        rare_times.append(times)
                rows.append(row)
                tokens.append(len(words))
                known.append(len(found))
                logs.append(sum(found))
                score, unknown, times = places.score(text)
                scores.append(score)
                if len(unknown):
                    other_rows.append(np.full(len(unknown), row))
                    others.append(unknown)
                    other_times.append(times)
                row += 1
            m = len(rare_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()),
                    pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(scores, pa.float64()),
                    pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()),
                ],
                schema=SCORED,
            )
            if m:
                empty = [pa.nulls(m, SCORED.field(k).type) for k in range(1, 7)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rare_rows, pa.int64()), *empty, pa.array(rare_words, pa.binary()), pa.nulls(m, pa.int64()),
                        pa.array(rare_times, pa.int64()),
                    ],
                    schema=SCORED,
                )
            if others:
                columns = {"row": np.concatenate(other_rows), "place": np.concatenate(others), "times": np.concatenate(other_times)}
                yield arrow_rows(SCORED, columns)

    return scored


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the counts of all words (word, n) of training documents."""
    texts = docs.where(~F.col("held_out")).select("text")
    gathered = keep(texts.mapInArrow(gather, GATHERED_DDL), "gathered")
    words = gathered.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    counts = gathered.where("word IS NULL").groupBy("place").agg(F.sum("n").alias("n"))
    return Model(keep(counts, "places")), keep(words, "words")


def score_documents(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """log10 probabilities of every whole text by the model and by the base.

    Input: doc_id, text; other columns are ignored. Null and empty texts have one token, the end, and
    score 0. Documents whose crc32(doc_id as text) modulo `folds` is `held_out` aren't learned from;
    null ids count as the empty text there. Repeated rows give repeated rows, an empty table none. With
    nothing to learn from, every decision is even, and the base is that of no words. Output: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (remainder(folds) == held_out).alias("held_out"), text_bytes().alias("text")
    )
    model, words = train(rows)
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = words.orderBy(F.desc("n"), "word").limit(BROADCAST_WORDS).toArrow()
    frequent = dict(zip(top["word"].to_pylist(), np.log10(top["n"].to_numpy() + 1.0).tolist(), strict=True))
    held = spark.sparkContext.broadcast((model.frequent(), frequent))
    scored = keep(rows.mapInArrow(scorer(held), SCORED_DDL), "scored")
    rare = scored.where("word IS NOT NULL").select("row", "word", "times").join(words, "word")
    more = rare.groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs")
    )
    others = scored.where("place IS NOT NULL").select("row", "place", "times")
    logs = keep(model.logs(others.select("place").distinct()), "logs")
    longer = others.join(logs, "place").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    total = float(np.log10(float(facts["n"]) + facts["v"] + 1.0))
    found = scored.where("word IS NULL AND place IS NULL").join(more, "row", "left").join(longer, "row", "left")
    return found.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(facts["n"])).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
