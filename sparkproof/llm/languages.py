"""Language identification in two steps: the family, then one-versus-one linear support vector machines.

A text's features are counts of its byte n-grams of one to three letters, hashed to fixed places, square
roots taken, scaled to length one. The machines are fitted by dual coordinate descent on a bounded sample
of labelled documents; predictions read every text whole, where it lies, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkproof.llm.common import remainder, text_bytes, texts_of

HELD_OUT = 2
FOLDS = 4
#: Different labelled texts of each language that the machines are fitted on (about; they are chosen by hash),
#: and of all languages together: more than ROWS / SAMPLE languages share ROWS, one text each at least.
SAMPLE = 400
ROWS = 20_000
#: Number of hash values by which texts are chosen.
SPAN = 1 << 31
UNKNOWN = "und"
# Families of languages by code. A language that isn't named is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi bn mr ne pa gu ur",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Places of n-grams of one, two and three bytes.
PLACES = (256, 1024, 4096)
WIDTH = sum(PLACES)
CHUNK = 500

#: Bytes of letters in lower case; all others are one blank.
LETTERS = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)
)
ASCII_LETTER = re.compile(rb"[A-Za-z]")
LETTER = regex.compile(r"\p{L}")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or LETTER.search(text.decode()) is not None)


def features(text: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
    out = np.sqrt(np.concatenate([
        np.bincount(b, minlength=PLACES[0]),
        np.bincount(two >> np.uint32(22), minlength=PLACES[1]),
        np.bincount(three >> np.uint32(20), minlength=PLACES[2]),
    ]).astype(np.float32))
    return out / np.linalg.norm(out)


def fit(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 25) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss (y is -1 or 1), by dual coordinate descent."""
    rng = np.random.default_rng(0)
    diagonal = 1 / (2 * cost)
    square = (x * x).sum(axis=1) + diagonal
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * float(x[i] @ w) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w


class Machines:
    """One-versus-one machines between classes; a class's support is its mean chance against the others."""

    def __init__(self, x: np.ndarray, names: list[str]):
        labels = np.array(names)
        self.classes = sorted(set(names))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = np.zeros((x.shape[1], len(self.pairs)), np.float32)
        for j, (a, b) in enumerate(self.pairs):
            rows = (labels == self.classes[a]) | (labels == self.classes[b])
            self.weights[:, j] = fit(x[rows], np.where(labels[rows] == self.classes[a], 1.0, -1.0))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best class of each row, ties to the first, and its support."""
        support = np.ones((len(x), len(self.classes)))
        if self.pairs:
            support[:] = 0
            chance = 1 / (1 + np.exp(-4 * (x @ self.weights).astype(float)))
            for j, (a, b) in enumerate(self.pairs):
                support[:, a] += chance[:, j]
                support[:, b] += 1 - chance[:, j]
            support /= len(self.classes) - 1
        best = support.argmax(axis=1)
        return best, support[np.arange(len(x)), best]


class Model:
    """Machines between families, and within each family between its languages."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        families = [FAMILY_OF.get(lang, f"= {lang}") for lang in languages]
        self.families = Machines(x, families)
        self.within = []
        for family in self.families.classes:
            rows = [i for i, f in enumerate(families) if f == family]
            self.within.append(Machines(x[rows], [languages[i] for i in rows]))

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        family, score = self.families.decide(x)
        names = np.empty(len(x), object)
        for f, machines in enumerate(self.within):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, support = machines.decide(x[rows])
                names[rows] = [machines.classes[b] for b in best]
                score[rows] = score[rows] * support
        return names.tolist(), score.tolist()


def with_bias(rows: list[np.ndarray]) -> np.ndarray:
    x = np.ones((len(rows), WIDTH + 1), np.float32)
    if rows:
        x[:, :WIDTH] = rows
    return x


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            (lang.as_py(), features(text).astype(np.float16).tobytes())
            for lang, text in zip(batch.column("lang"), texts_of(batch), strict=True)
            if has_letter(text)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())],
            names=["lang", "x"],
        )


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on about `sample` different texts of each language (lang, text, mark: the text's hash), or None
    without any. Copies count once, whatever their number; every language has a text at least."""
    labelled = labelled.where(F.col("text").cast("string").rlike(r"\p{L}"))
    place = F.pmod("mark", F.lit(SPAN))
    distinct = labelled.select("lang", "mark").distinct()
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).collect()
    if not counts:
        return None
    each = max(1, min(sample, ROWS // len(counts)))
    most = [max(r["least"], int(min(1.0, each / r["n"]) * SPAN) - 1) for r in counts]
    limits = pa.table({"lang": pa.array([r["lang"] for r in counts], pa.string()), "most": pa.array(most, pa.int64())})
    # A row for each language, whose size Spark knows.
    chosen = labelled.join(labelled.sparkSession.createDataFrame(limits), "lang").where(place <= F.col("most"))
    texts = chosen.groupBy("lang", "mark").agg(F.first("text").alias("text"))
    got = texts.select("lang", "text").mapInArrow(sample_features, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    order = sorted(set(zip(got["lang"].to_pylist(), got["x"].to_pylist(), strict=True)))
    return Model(with_bias([np.frombuffer(row, np.float16) for _, row in order]), [lang for lang, _ in order])


def predictor(model) -> Callable:
    """Adds to rows of row, text the language, its score, and whether the text has a letter."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, letters = [], [], []
            for start in range(0, batch.num_rows, CHUNK):
                texts = [*texts_of(batch.slice(start, CHUNK))]
                has = [has_letter(t) for t in texts]
                lettered = [i for i, letter in enumerate(has) if letter and model.value is not None]
                out, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if lettered:
                    for i, lang, s in zip(lettered, *model.value.predict(with_bias([features(texts[i]) for i in lettered])), strict=True):
                        out[i], score[i] = lang, s
                names += out
                scores += score
                letters += has
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())],
                names=["row", "lang_pred", "score", "letter"],
            )

    return predict


def predict(docs: DataFrame, carry: list[str], folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """row (a struct of the carried columns), held_out, lang_pred, score, letter (whether the text has one)."""
    fold = remainder(folds)
    labelled = docs.where((fold != held_out) & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), text_bytes().alias("text"), F.xxhash64("text").alias("mark")
    )
    model = docs.sparkSession.sparkContext.broadcast(train(labelled))
    fields = [F.col(f"`{c}`") for c in carry]
    rows = docs.select(F.struct(F.struct(*fields).alias("row"), (fold == held_out).alias("held_out")).alias("row"), text_bytes().alias("text"))
    schema = T.StructType([
        rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("letter", T.BooleanType()),
    ])
    return rows.mapInArrow(predictor(model), schema).select("row.row", "row.held_out", "lang_pred", "score", "letter")


def identify(docs: DataFrame) -> DataFrame:
    """The language of every whole text.

    Input: doc_id, text, lang; other columns are ignored. Texts that are null or hold no letter are `und`
    with score 0; so are all where nothing can be learned. Learned from are texts with a language whose
    crc32(doc_id as text) modulo 4 isn't 2; null ids count as the empty text there. Repeated rows give
    repeated rows, an empty table none. Output: doc_id, held_out, lang_pred, score (support of the family
    times that of the language)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return predict(ids, ["doc_id"]).select("row.doc_id", "held_out", "lang_pred", "score")
