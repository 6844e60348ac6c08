"""Harmonic packing of token pieces into sequences of fixed capacity.

A piece of n tokens belongs to class k = capacity // n, and k pieces of class k always fit one
sequence. Documents may be cut, so each is cut where the pieces (nearly) equal capacity / k for a
whole k: full sequences first, then the largest reciprocal that leaves little unused. Sequences of a
class are filled with exactly k pieces by number, so workers need no common state: a piece's number is
its place in its task plus the pieces of that class in earlier tasks. What is left of each class, fewer
than k pieces, is packed together by best fit; those are a bounded number whatever the input.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkproof.llm.common import (
    ChunkCache,
    arrow_rows,
    blank_chunks,
    byte_letters,
    global_offsets,
    keep,
    limit_threads,
    partition_id,
    text_bytes,
    texts_of,
    vocabulary_path,
)

CAPACITY = 4096
#: A piece may leave this share of its slot unused; beyond it the piece is cut once more.
SLACK = 64
END_ID = 2


def cut_lengths(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths into which a document of n tokens is cut, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        slot = capacity // k
        if (slot - n) * slack <= slot:
            out.append(n)
            break
        out.append(capacity // (k + 1))
        n -= out[-1]
    return out


class TokenIds(ChunkCache):
    """Token ids (little-endian unsigned 32 bit) of strings between blanks, as the library gives them.

    White space ends a token in this vocabulary, so a text's ids are those of its chunks in a row.
    Plain words go straight to the library's merge model, all others through its whole encoder."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.encoder = Tokenizer.from_file(vocabulary_path(name))
        self.model = self.encoder.model
        self.letters = byte_letters()

    def compute(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if max(chunk) < "ɐ" and len(chunk) <= self.longest:
            core = chunk.rstrip(".,;:!?|$%&*#")
            if core.isalpha() and unicodedata.is_normalized("NFC", core):
                if len(core) < len(chunk):
                    return self[core] + self[chunk[len(core) :]]
                word = core.lower()
                if len(word) == len(core):
                    letters = self.letters
                    ids = self.model.tokenize("".join([letters[b] for b in word.encode()]))
                    return np.array([t.id for t in ids], "<u4").tobytes()
        ids = self.encoder.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def of_text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, blank_chunks(text)))


_CACHES: dict[str, TokenIds] = {}


def token_ids(name: str) -> TokenIds:
    """The worker's own cache, kept from task to task."""
    limit_threads()
    if name not in _CACHES:
        _CACHES[name] = TokenIds(name)
    return _CACHES[name]


PIECES = pa.schema([
    ("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("k", pa.int32()), ("place", pa.int64()),
])
PIECES_DDL = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, place long"


def piece_cutter(name: str, capacity: int, slack: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids(name)
        end = np.array([END_ID], "<u4").tobytes()
        part, taken = partition_id(), defaultdict(int)
        for batch in batches:
            out = {f.name: [] for f in PIECES}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = (ids_of.of_text(text.decode()) if text else b"") + end
                start, n = 0, len(ids) // 4
                for length in cut_lengths(n, capacity, slack):
                    k = capacity // length
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    row = (part, doc_id, start, length, crc, n, k, taken[k])
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                    taken[k] += 1
                    start += length
            if out["part"]:
                yield arrow_rows(PIECES, out)

    return cut


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], int]:
    """Bin of each length, largest first into the fullest bin that takes it; the number of bins."""
    bins = [0] * len(lengths)
    room: list[tuple[int, int]] = []
    count = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, count = capacity, count, count + 1
        bins[i] = b
        if left > lengths[i]:
            insort(room, (left - lengths[i], b))
    return bins, count


def pack(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, slack: int = SLACK
) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    Input: doc_id, text; other columns are ignored. A null or empty text is its end id alone. Rows
    that repeat, null ids included, are packed as documents of their own. An empty table gives no
    rows. Output: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    pieces = keep(rows.mapInArrow(piece_cutter(vocabulary, capacity, slack), PIECES_DDL), "pieces")
    counts = pieces.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = keep(global_offsets(counts, "k", "part", "n"), "offsets")
    # At most `capacity` classes: this window and the tables below it are bounded by the parameter.
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    classes = offsets.groupBy("k").agg(F.sum("n").alias("total")).select(
        "k",
        F.expr("total div k").alias("full"),
        F.coalesce(F.sum(F.expr("total div k")).over(before), F.lit(0)).alias("base"),
    )
    numbered = (
        pieces.join(offsets.select("k", "part", "offset"), ["k", "part"])
        .join(F.broadcast(classes), "k")
        .withColumn("number", F.col("offset") + F.col("place"))
        .withColumn("bin", F.expr("number div k"))
    )
    facts = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    filled = numbered.where("bin < full").withColumn("sequence_id", F.col("base") + F.col("bin"))
    inside = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))

    def pack_rest(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["k", "number"], ignore_index=True)
        bins, _ = best_fit(rest["length"].tolist(), capacity)
        rest["bin"] = bins
        rest = rest.sort_values(["bin", "k", "number"], ignore_index=True)
        rest["offset"] = rest.groupby("bin")["length"].cumsum() - rest["length"]
        rest["sequence_id"] = rest["bin"] + rest["first"]
        return rest[[*facts, "sequence_id", "offset"]]

    # Fewer than k pieces of each class k are left: a bounded number, packed by one task.
    first = F.broadcast(classes.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("first")))
    rest = (
        numbered.where("bin >= full")
        .select(*facts, "k", "number", F.lit(0).alias("one"))
        .join(first.withColumn("one", F.lit(0)), "one")
        .groupBy("one")
        .applyInPandas(
            pack_rest,
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )
    return filled.select(*facts, "sequence_id", "offset").unionByName(rest)
