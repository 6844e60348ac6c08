"""JOIN-4: which copy blocks occur inside which texts, in one pass over the texts.

The blocks' distinct texts are the patterns of an automaton, which finds all of them in one scan of a
text, however many there are and wherever they overlap. Patterns are taken in parts of bounded size: each
part is sent to the workers once and every text is scanned for it once, in Arrow batches. What is found
is exact, so nothing is verified afterwards, and the texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkproof.operators.skew import spread
from sparkproof.sources.tables import kept

#: Blocks shorter than this match nothing.
LEAST = 3
#: Bytes of patterns in a part, which the driver sends on at once; a longer pattern is a part of its own.
PART_BYTES = 8_000_000


def searcher(held: object) -> Callable:
    """Rows (text_id, number) for each pattern that a text contains."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, pattern in held.value:
            automaton.add_word(pattern, number)
        automaton.make_automaton()
        for batch in batches:
            at, numbers = [], []
            for i, text in enumerate(batch.column("text")):
                if text.is_valid:
                    found = {number for _, number in automaton.iter(text.as_py())}
                    at += [i] * len(found)
                    numbers += found
            ids = batch.column("text_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int64())], names=["text_id", "number"])

    return search


def parts_of(patterns: DataFrame, most: int) -> int:
    """Number of parts in which patterns (block) are sent, of about so many bytes each."""
    size = patterns.agg(F.sum(F.octet_length("block"))).first()[0] or 0
    return max(-(-size // most), 1) if size else 0


def blocks_in_texts(blocks: DataFrame, texts: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Pairs where `text` of texts (text_id, text) contains `block` of blocks (block_id, block).

    Both are normalised; blocks below three characters match nothing, null texts
    hold nothing. Repeated rows of either side give their pairs once for each."""
    usable = blocks.where(F.length("block") >= LEAST)
    patterns = kept(usable.select("block").distinct().withColumn("number", F.monotonically_increasing_id()), "patterns")
    texts = spread(texts.select("text_id", "text"))
    parts = parts_of(patterns, part_bytes)
    kind = texts.select("text_id").schema.add("number", "long")
    found = []
    for part in range(parts):
        rows = patterns.where(F.pmod(F.xxhash64("block"), F.lit(parts)) == part).collect()
        if rows:
            held = texts.sparkSession.sparkContext.broadcast([(r["number"], r["block"]) for r in rows])
            found.append(texts.mapInArrow(searcher(held), kind))
    if not found:
        return usable.select("block_id").join(texts.select("text_id"), F.lit(False))
    pairs = reduce(DataFrame.unionByName, found)
    named = usable.select("block_id", "block").join(patterns, "block").select("block_id", "number")
    return pairs.join(named, "number").select("block_id", "text_id")
