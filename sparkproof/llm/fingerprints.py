"""Document fingerprints of closed syncmers.

A k-mer of code points is an anchor if the smallest of its inner s-mers is the first or the last of them.
That depends on the k-mer alone, so texts that share a passage share its anchors wherever it stands. A
fingerprint keeps all distinct anchors of the whole text, each with its first position, so two texts are
compared by anchors that lie at one common shift.

Each document meets the next one by id. Ids are dealt into ranges of known bounds, and a copy of each
range's first row goes, as a guest, to the end of the range before it. So one shuffle of the texts brings
all neighbours together, and nothing is written down but the result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkproof.llm.common import texts_of

K = 20
S = 9
#: An anchor takes eight bytes: 40 bits of hash and 24 of position (texts beyond 2^24 code points wrap).
POSITION = 24
#: Shifts are told apart in units of so many code points.
UNIT = 32
#: Ranges of ids: so many by quantiles, each cut evenly into at most so many, of about so many rows.
QUANTILES, MOST_CUTS, RANGE_ROWS = 64, 300, 2000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    h = (h ^ (h >> np.uint64(29))) * MIX[2]
    return h ^ (h >> np.uint64(32))


def syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of a text's closed syncmers; points are its code points."""
    n = len(points) - s + 1
    inner = np.zeros(n, np.uint64)
    for j in range(s):
        inner = inner * MIX[0] + points[j : j + n]
    inner = mixed(inner)
    width = k - s + 1
    least, done = inner, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    m = len(least)
    at = np.flatnonzero((inner[:m] == least) | (inner[width - 1 : width - 1 + m] == least))
    # Inner s-mers that cover all of a k-mer.
    h = np.zeros(len(at), np.uint64)
    for offset in [*range(0, k - s, s), k - s]:
        h = mixed(h * MIX[0] + inner[at + offset])
    return at, h


def fingerprint(text: str) -> str:
    """Anchors as base64, eight bytes each: 40 bits of hash, 24 of first position, in order of their hashes.

    A text shorter than a k-mer is one anchor, the empty text none."""
    if not text:
        return ""
    if len(text) < K:
        at, h = np.zeros(1, np.int64), np.array([xxhash.xxh64_intdigest(text)], np.uint64)
    else:
        at, h = syncmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64))
    h, first = np.unique(h >> np.uint64(POSITION), return_index=True)
    packed = (h << np.uint64(POSITION)) | (at[first] % 2**POSITION).astype(np.uint64)
    return base64.b64encode(packed.astype("<u8").tobytes()).decode()


def anchors(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending, distinct) and positions that `fingerprint` packed."""
    held = np.frombuffer(base64.b64decode(fingerprint), "<u8")
    return held >> np.uint64(POSITION), (held % np.uint64(2**POSITION)).astype(np.int64)


def likeness(a: str, b: str) -> float:
    """Of the anchors that could match, which are as many as the text with fewer has, the share that both
    hold at one shift (give or take a unit), 0 to 1."""
    if a == b:
        return 1.0
    (x, x_at), (y, y_at) = anchors(a), anchors(b)
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    shifts, votes = np.unique((x_at[i] - y_at[j]) // UNIT, return_counts=True)
    total = np.concatenate([[0], np.cumsum(votes)])
    near = total[np.searchsorted(shifts, shifts + 1, "right")] - total[np.searchsorted(shifts, shifts - 1)]
    return float(near.max()) / min(len(x), len(y))


def edited_text(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q] if q else text


COLUMNS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(doc_id: int | None, text: str, own: str, following: str, following_print: str) -> tuple:
    edited = edited_text(text, following)
    edited_print = own if edited == text else fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own, edited_print, likeness(own, edited_print), likeness(own, following_print)


def compare_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted ranges against their next; a guest is the next of its range's last row."""
    part = waiting = None
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("part", "guest", "doc_id"))
        for now, guest, doc_id, text in zip(*columns, texts_of(batch), strict=True):
            if now != part:
                part, waiting = now, None
            elif guest and waiting is None:
                continue  # all guests have the same text as far as they are wanted: only the first counts
            own = fingerprint(text)
            if waiting is not None:
                out.append(compared(*waiting, text, own))
            waiting = None if guest else (doc_id, text, own)
        found = zip(*out, strict=True) if out else [[] for _ in COLUMNS]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, COLUMNS, strict=True)], schema=COLUMNS)


def with_range(rows: DataFrame) -> DataFrame:
    """Rows with `part`, which rises with (doc_id, mark), and `key`, whose smallest value a part's first row
    has. Quantiles of the ids are cut evenly; an id that fills a quantile is cut by its marks.

    There are at most about 2 QUANTILES * MOST_CUTS parts, whatever the table."""
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.percentile_approx("doc_id", [i / QUANTILES for i in range(1, QUANTILES)], 10 * QUANTILES).alias("q"),
    ).first()
    cuts = min(max(facts["n"] // (QUANTILES * RANGE_ROWS), 1), MOST_CUTS)
    q = facts["q"] or []
    full = {a for a, b in zip(q, q[1:]) if a == b}
    bounds = sorted({*q, facts["low"], *full, *(x + 1 for x in full)} - {None})
    at, widths = F.array(*[F.lit(b).cast("long") for b in bounds]), [b - a for a, b in zip(bounds, bounds[1:])]
    if bounds:
        widths.append(facts["high"] - bounds[-1] + 1)
    wide = F.array(*[F.lit(float(w)) for w in widths])
    segment = F.size(F.filter(at, lambda b: b <= F.col("doc_id")))
    rows = rows.withColumn("segment", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(segment))
    one_id = F.col("doc_id").isNull() | (F.try_element_at(wide, F.col("segment")) == 1)
    # A difference of longs may overflow, of doubles not; both keep the order.
    share = F.when(one_id, F.col("mark") / F.lit(2.0**64) + 0.5).otherwise(
        (F.col("doc_id").cast("double") - F.try_element_at(at, F.col("segment")).cast("double")) / F.try_element_at(wide, F.col("segment"))
    )
    cut = F.greatest(F.lit(0), F.least(F.floor(share * cuts), F.lit(cuts - 1)))
    return rows.withColumns({
        "part": (F.col("segment") * cuts + cut).cast("int"), "key": F.when(one_id, F.col("mark")).otherwise(F.col("doc_id")),
    }).drop("segment")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    Input: doc_id, text; other columns are ignored. A null text is empty. The next document is that with
    the next larger id; null ids come last, rows of one id stand by a hash of their text, then the text.
    After the last comes the first, so a single document is its own next. Repeated rows give repeated
    rows, an empty table none. Empty fingerprints are alike only to each other. Output: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_range(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")))
    heads = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    # The number of parts is bounded, so this table is; each first row goes to the part before its own.
    before = [(part, key, heads[i - 1][0]) for i, (part, key) in enumerate(heads)]
    guests = rows.join(F.broadcast(spark.createDataFrame(before, "part int, key long, host int")), ["part", "key"])
    columns = ["doc_id", "mark", "text"]
    both = rows.select("part", F.lit(False).alias("guest"), *columns).unionByName(
        guests.select(F.col("host").alias("part"), F.lit(True).alias("guest"), *columns)
    )
    order = ["part", "guest", F.asc_nulls_last("doc_id"), "mark", "text"]
    ranges = both.repartitionByRange("part").sortWithinPartitions(*order)
    return ranges.select("part", "guest", "doc_id", "text").mapInArrow(compare_ranges, DDL)
