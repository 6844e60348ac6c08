"""Token counts by byte-pair merging with a heap and a linked list.

The vocabulary's merge ranks are read from its file; no token identifiers are made. A word's symbols
form a linked list, its adjacent pairs a heap by rank; the lowest pair is merged until none is left.
The count is the number of first symbols less the number of merges.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkproof.llm.common import (
    ChunkCache,
    arrow_rows,
    blank_chunks,
    byte_letters,
    text_bytes,
    texts_of,
    vocabulary_path,
)

TOKEN_LIMIT = 2048


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges, lowest rank first and leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return n
    heap = [
        (rank, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None
    ]
    if not heap:
        return n
    heapify(heap)
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = [False] * n
    merges = 0
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        # A stale entry: its left symbol was merged away, or the pair is another one by now.
        if gone[i] or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        gone[j] = True
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get((symbols[i], symbols[k]))
            if rank is not None:
                heappush(heap, (rank, i))
        k = before[i]
        if k >= 0:
            rank = ranks.get((symbols[k], symbols[i]))
            if rank is not None:
                heappush(heap, (rank, k))
    return n - merges


class WordCounts(ChunkCache):
    """Number of tokens of strings between blanks, for byte-level vocabularies with word ends.

    Added tokens count as one wherever their string stands. Between them the text is composed (NFC),
    put in lower case letter by letter and cut by the vocabulary's own pattern."""

    def __init__(self, name: str):
        super().__init__()
        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        if kinds != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or not self.end:
            raise ValueError(f"{name} is not a byte-level vocabulary of lower-case words with word ends")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        added = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added)) or r"(?!)")
        self.letters = byte_letters()
        self.ranks = {
            (a, b): i
            for i, merge in enumerate(spec["model"]["merges"])
            for a, b in [merge.split(" ") if isinstance(merge, str) else merge]
        }

    def word(self, piece: str) -> int:
        letters = self.letters
        symbols = [letters[b] for b in piece.encode()]
        symbols[-1] += self.end
        return merged_length(symbols, self.ranks)

    def compute(self, chunk: str) -> int:
        if not chunk:
            return 0
        if max(chunk) < "ɐ" and len(chunk) <= self.longest:
            core = chunk.rstrip(".,;:!?|$%&*#")
            if core.isalpha():
                if len(core) < len(chunk):
                    return self[core] + self[chunk[len(core) :]]
                if len(word := core.lower()) == len(core):
                    return self[word] if word != chunk else self.word(word)
        n = len(self.added.findall(chunk))
        for part in self.added.split(chunk) if n else [chunk]:
            lower = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
            n += sum(map(self.word, self.pieces.findall(lower)))
        return n

    def of_text(self, text: str) -> int:
        return sum(map(self.__getitem__, blank_chunks(text)))


_COUNTERS: dict[str, WordCounts] = {}
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def counter(name: str) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTERS:
            _COUNTERS[name] = WordCounts(name)
        of_text = _COUNTERS[name].of_text
        for batch in batches:
            texts = [t or b"" for t in texts_of(batch)]
            if texts:
                yield arrow_rows(COUNTS, {
                    "doc_id": batch.column("doc_id").to_pylist(),
                    "n_bytes": [len(t) for t in texts],
                    "n_tokens": [of_text(t.decode()) for t in texts],
                })

    return count


def count_tokens(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """Tokens of every whole text, without begin, end or padding.

    Input: doc_id, text; other columns are ignored. Null and empty texts have no tokens; repeated
    rows give repeated rows, an empty table none. No shuffle: a row's count needs that row alone.
    Output: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    out = rows.mapInArrow(counter(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
