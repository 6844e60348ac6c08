"""Benchmark decontamination by a prefix-filtered join of document words with item windows.

A window is 10 consecutive words of an item; containment of a window is exact only if all its words
occur, so by the prefix principle one word suffices to find it: its rarest, by the words' counts over all
documents. Document words that are such a prefix give candidates; the window's length and the word's
place in it say where it would have to start and end, and only then are all its words compared.

Items go by blocks of a bounded number of windows. A block's index is broadcast and every document row
is looked up where it lies, so documents are never shuffled; each further block adds its hits to the
row. Reading goes on with one pass for each block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkproof.llm.common import WORD_BYTES, arrow_rows, keep, text_bytes, texts_of

WINDOW = 10
#: Windows of one block: its index takes about 1 KB each in a worker.
BLOCK_WINDOWS = 100_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    """All runs of `size` words; a shorter text, if it has words, is one window."""
    n = len(words)
    for i in range(max(n - size + 1, min(n, 1))):
        yield tuple(words[i : i + size])


class WindowIndex:
    """Windows by their rarest word and its place: one lookup for each place of a candidate."""

    def __init__(self, items: list[tuple[str, bytes]], counts: dict[bytes, int], size: int):
        self.items: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        self.places: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for item, text in items:
            for window in windows_of(words_of(text), size):
                self.items[window].add(item)
        for window in self.items:
            # Ties go to the smaller word, so that equal windows have one prefix everywhere.
            at = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i]))
            self.places[window[at]].add((at, len(window)))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Half-open word ranges of occurring windows, in order of their find, and their items."""
        places, items, n = self.places, self.items, len(words)
        ranges, found = [], set()
        for i in [i for i, w in enumerate(words) if w in places]:
            for at, length in places[words[i]]:
                start = i - at
                if start >= 0 and start + length <= n:
                    of = items.get(tuple(words[start : start + length]))
                    if of:
                        ranges.append((start, start + length))
                        found |= of
        return ranges, found


def covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges, as ordered ranges that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = {
    "n_words": pa.int64(), "ranges": pa.list_(pa.int32()), "items": pa.list_(pa.string()),
}


def word_counter(wanted: frozenset) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in texts_of(batch):
                for w in filter(wanted.__contains__, words_of(text)):
                    counts[w] += 1
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        if counts:
            yield arrow_rows(schema, {"word": list(counts), "n": list(counts.values())})

    return count


def block_finder(index, last: bool) -> Callable:
    """Adds a block's hits to rows of row, text, ranges, items; the text goes once it isn't needed."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in HITS}
            old = zip(batch.column("ranges"), batch.column("items"), strict=True)
            for text, (ranges, items) in zip(texts_of(batch), old, strict=True):
                words = words_of(text)
                more, found = index.value.hits(words)
                flat = ranges.as_py()
                union = covered([*zip(flat[::2], flat[1::2], strict=True), *more])
                out["n_words"].append(len(words))
                out["ranges"].append([x for r in union for x in r])
                out["items"].append(sorted(found | set(items.as_py())))
            arrays = {"row": batch.column("row")} | ({} if last else {"text": batch.column("text")})
            arrays |= {name: pa.array(out[name], type=kind) for name, kind in HITS.items()}
            yield pa.RecordBatch.from_pydict(arrays)

    return find


def item_blocks(benchmark: DataFrame, size: int, most: int) -> list[DataFrame]:
    """Items in blocks of at most about `most` windows, by hash. A window never needs two items' words."""
    words = F.size(F.split(F.col("text").cast("string"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    n = max(1, -(-int(total) // most))
    if n == 1:
        return [benchmark]
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [benchmark.where(block == i) for i in range(n)]


def find_hits(
    docs: DataFrame, benchmark: DataFrame, carry: list[str], size: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """row (a struct of the carried columns), n_words, ranges (flat, half-open word ranges that are hit),
    items (sorted)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text_bytes().alias("text"),
        F.array().cast("array<int>").alias("ranges"), F.array().cast("array<string>").alias("items"),
    )
    texts = docs.select(text_bytes().alias("text"))
    # A null id is written as the empty string; a null text has no windows.
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text")
    ).where(F.col("text").isNotNull())
    blocks = item_blocks(items, size, block_windows)
    row = T.StructField("row", rows.schema["row"].dataType)
    text = T.StructField("text", T.BinaryType())
    hits = [
        T.StructField("n_words", T.LongType()), T.StructField("ranges", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    for i, block in enumerate(blocks):
        last = i + 1 == len(blocks)
        held = [(r["item"], bytes(r["text"])) for r in block.collect()]
        wanted = frozenset(w for _, item in held for w in words_of(item))
        counts = texts.mapInArrow(word_counter(wanted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        # At most the words of one block.
        rarity = {bytes(r["word"]): r["n"] for r in counts.collect()}
        index = spark.sparkContext.broadcast(WindowIndex(held, rarity, size))
        rows = rows.mapInArrow(block_finder(index, last), T.StructType([row, *([] if last else [text]), *hits]))
        if not last:
            rows = keep(rows, "hits")
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Words of every document that lie in an occurrence of an item's window.

    Input: documents with doc_id and text, items with item_id and text; other columns are ignored. Null
    and empty texts have no words; items without words have no windows; items that repeat under one id
    are one item. Repeated documents give repeated rows, an empty table none, an empty benchmark no hits.
    Output: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = find_hits(ids, benchmark, ["doc_id"], size)
    length = F.aggregate(
        F.sequence(F.lit(0), F.size("ranges") - 1, F.lit(1)),
        F.lit(0).cast("long"),
        lambda n, i: n + F.element_at("ranges", i + 1) * F.when(i % 2 == 1, 1).otherwise(-1),
    )
    return hits.select(
        "row.doc_id", "n_words", F.when(F.size("ranges") > 0, length).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )
