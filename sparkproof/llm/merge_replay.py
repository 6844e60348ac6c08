"""Byte-level BPE encoding and decoding by replaying the vocabulary's merges over many words at once.

A text is cut into words by the vocabulary's pattern, and the distinct words of a collection are laid end
to end as symbols, one for each byte. An inverted index holds for each merge the positions where its
pair stands. Merges are applied in rank order, over all words; a merge touches only the index entries of
its two neighbours. A pair is named by the rank of the token that it makes, so pairs that make the same
token are applied together, from left to right.

What stands between blanks is counted over the whole corpus first. The words of its most frequent chunks
(a bounded number) are replayed once, in Spark tasks, and every worker holds their tokens; all others are
replayed in blocks, where they occur, by the same index. No text is shuffled.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkproof.llm.common import keep, text_bytes, texts_of, vocabulary_path

#: Chunks that are replayed once for the whole corpus and held by every worker.
FREQUENT_CHUNKS = 100_000
#: Longer chunks are left to the blocks, so that what workers hold is bounded in bytes too.
FREQUENT_LENGTH = 32
#: Different chunks that a task counts before it hands them on.
TASK_CHUNKS = 200_000
#: Bytes of texts whose words are replayed together.
BLOCK_BYTES = 2_000_000
#: Chunks whose tokens a worker remembers beside the frequent words'; longer ones are not kept.
CACHED_CHUNKS, CACHED_LENGTH = 300_000, 64
#: Pairs whose rank a worker remembers.
CACHED_PAIRS = 1_000_000
#: Where a text can be cut: a word never reaches over a blank that something else than white space follows.
CUT = regex.compile(r" (?=\S)")
SPACE = regex.compile(r"\s")


class Vocabulary:
    """Ranks of a byte-level vocabulary, the bytes of each token, and the pattern that cuts words."""

    loaded: dict[str, Vocabulary] = {}

    def __init__(self, name: str):
        import public_tokenizers

        with open(vocabulary_path(name), "rb") as f:
            lines = (line.split() for line in f)
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.made: list[dict[int, int]] = [{} for _ in range(max(self.tokens) + 1)]
        self.pairs = 0
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.prepare()

    def prepare(self) -> None:
        """Ranks of what two bytes make, by 256 * first + second."""
        pairs = (self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256))
        self.byte_pairs = np.fromiter(pairs, np.int64, 65536)

    def merged(self, a: int, b: int) -> int:
        """Rank of the token that two tokens make, -1 if there is none; remembered in `made`."""
        self.pairs += 1
        if self.pairs > CACHED_PAIRS:
            for found in self.made:
                found.clear()
            self.pairs = 1
        rank = self.made[a][b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    @classmethod
    def of(cls, name: str) -> Vocabulary:
        if name not in cls.loaded:
            cls.loaded[name] = cls(name)
        return cls.loaded[name]


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Token ids of each word.

    The next merge is always that of the lowest rank that stands anywhere, at its leftmost place, so a
    merge that makes a pair of lower rank is followed by that pair. Words share no pair, hence each
    gets what it would get alone. A word that is a token itself is that token."""
    ranks, made, merged = vocabulary.ranks, vocabulary.made, vocabulary.merged
    out: list[list[int]] = [[]] * len(words)
    left = [k for k, word in enumerate(words) if word and word not in ranks]
    for k, word in enumerate(words):
        if word in ranks:
            out[k] = [ranks[word]]
    # A symbol for each byte, and -1 behind each word, which pairs with nothing.
    places = np.frombuffer(b" ".join([words[k] for k in left]) + b" ", np.uint8).astype(np.int64)
    ends = np.cumsum([len(words[k]) + 1 for k in left], dtype=np.int64) - 1
    rank_of = vocabulary.byte_pairs[places[:-1] * 256 + places[1:]]
    rank_of[ends[:-1]] = rank_of[ends - 1] = -1
    single = np.array(vocabulary.single)[places]
    single[ends] = -1
    symbols, n = single.tolist(), len(single)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    order = np.argsort(rank_of, kind="stable")[int((rank_of < 0).sum()) :]
    found, first = np.unique(rank_of[order], return_index=True)
    index = {rank: at.tolist() for rank, at in zip(found.tolist(), np.split(order, first[1:]))} if len(found) else {}
    waiting = list(index)
    heapify(waiting)
    while waiting:
        rank = heappop(waiting)
        places = index.pop(rank)
        places.sort()
        held, blocked = [], -1
        for i in places:
            a = symbols[i]
            if a < 0:
                continue  # stale: merged away since
            if i < blocked:
                held.append(i)
                continue
            j = after[i]
            b = symbols[j]
            if b < 0:
                continue
            now = made[a].get(b)
            if now is None:
                now = merged(a, b)
            if now != rank:
                continue  # stale: another pair stands here now
            symbols[i], symbols[j] = rank, -1
            after[i] = k = after[j]
            before[k] = i
            lower = False
            b = symbols[k]
            if b >= 0:
                new = made[rank].get(b)
                if new is None:
                    new = merged(rank, b)
                if new >= 0:
                    lower = new < rank
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        heappush(waiting, new)
            k = before[i]
            if k >= 0 and (a := symbols[k]) >= 0:
                new = made[a].get(rank)
                if new is None:
                    new = merged(a, rank)
                if new >= 0:
                    lower = lower or new < rank
                    if new in index:
                        index[new].append(k)
                    else:
                        index[new] = [k]
                        heappush(waiting, new)
            if lower:  # the rest of this word waits for the pair of lower rank
                blocked = int(ends[np.searchsorted(ends, i)])
        if held:
            index[rank] = held
            heappush(waiting, rank)
    for k, end in zip(left, ends.tolist(), strict=True):
        i, ids = end - len(words[k]), []
        while symbols[i] >= 0:
            ids.append(symbols[i])
            i = after[i]
        out[k] = ids
    return out


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if numbers.itemsize != 4 or sys.byteorder != "little":
        return np.array(ids, "<u4").tobytes()
    return numbers.tobytes()


COUNTED = pa.schema([("chunk", pa.string()), ("n", pa.int64())])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's texts with their numbers."""
    found: Counter = Counter()

    def rows() -> pa.RecordBatch:
        short = {chunk: n for chunk, n in found.items() if len(chunk) <= FREQUENT_LENGTH}
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(short), pa.string()), pa.array(list(short.values()), pa.int64())], schema=COUNTED)

    for batch in batches:
        for text in texts_of(batch):
            found.update((text or b"").decode().split(" "))
            if len(found) > TASK_CHUNKS:
                yield rows()
    if found:
        yield rows()


REPLAYED = pa.schema([("chunk", pa.string()), ("ids", pa.binary())])


def replayer(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ChunkTokens(Vocabulary.of(name), {})
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            tokens.learn(set(chunks), {})
            ids = [tokens.known[c] for c in chunks]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(ids, pa.binary())], schema=REPLAYED)

    return run


def frequent_chunks(texts: DataFrame, vocabulary: str, most: int = FREQUENT_CHUNKS) -> dict[str, bytes]:
    """Tokens of the corpus's most frequent chunks, at most so many. Counts cover all texts; chunks are
    taken by steps of their counts (a quarter of a power of two), so no task sorts them all."""
    counted = keep(texts.mapInArrow(gather, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")), "chunks")
    step = F.floor(F.log2("n") * 4).cast("int")
    steps = sorted(counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, total = None, 0
    for s in steps:
        total += s["n"]
        if total > most:
            break
        least = s["step"]
    if least is None:
        return {}
    top = counted.where(step >= least).select("chunk").repartition(16, "chunk")
    table = top.mapInArrow(replayer(vocabulary), "chunk string, ids binary").where("ids IS NOT NULL").toArrow()
    return dict(zip(table["chunk"].to_pylist(), table["ids"].to_pylist(), strict=True))


class ChunkTokens:
    """Packed token ids of chunks, which are what stands between blanks; a chunk's ids are those of the
    blank before it too. The unseen words of a block are replayed together."""

    def __init__(self, vocabulary: Vocabulary, frequent: dict[str, bytes]):
        self.vocabulary, self.base = vocabulary, frequent
        self.known: dict[str, bytes | None] = dict(frequent)
        self.long: list[str] = []

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if len(self.known) > len(self.base) + CACHED_CHUNKS:
            self.known = dict(self.base)
        known = self.known
        cut = [text.split(" ") for text in texts]
        firsts = {chunks[0]: None for chunks in cut}
        self.learn({c for chunks in cut for c in set(chunks[1:]).difference(known)}, firsts)
        out, odd = [], []
        for k, chunks in enumerate(cut):
            first, chunks[0] = firsts[chunks[0]], ""
            try:
                out.append(first + b"".join(map(known.__getitem__, chunks[1:])))
            except TypeError:  # white space follows a blank somewhere
                odd.append(k)
                out.append(b"")
        if odd:
            cut = [CUT.split(texts[k]) for k in odd]
            firsts = {chunks[0]: None for chunks in cut}
            self.learn({c for chunks in cut for c in set(chunks[1:]).difference(known)}, firsts)
            for k, chunks in zip(odd, cut, strict=True):
                out[k] = firsts[chunks[0]] + b"".join(map(known.__getitem__, chunks[1:]))
        for chunk in self.long:
            known.pop(chunk, None)
        self.long.clear()
        return out

    def learn(self, unseen: set[str], firsts: dict[str, bytes | None]) -> None:
        """Fill in the ids of unseen chunks and of chunks without a blank before them. A chunk that
        begins with white space, or is empty, can't be cut off from what precedes: it becomes None."""
        findall, known = self.vocabulary.pattern.findall, self.known
        self.long += [c for c in unseen if len(c) > CACHED_LENGTH]
        words: dict[str, list[str]] = {}
        for chunk in unseen:
            if chunk.isascii() and chunk.isalpha():
                words[chunk] = [" " + chunk]
            elif not chunk or SPACE.match(chunk):
                known[chunk] = None
            else:
                words[chunk] = findall(" " + chunk)
        starts = {chunk: findall(chunk) for chunk in firsts}
        tokens: dict[str, bytes] = {}
        new = []
        for found in (words, starts):
            for ws in found.values():
                for w in ws:
                    if w not in tokens:
                        # A word behind a blank may be a known chunk.
                        tokens[w] = ids = (known.get(w[1:]) if w[0] == " " else None) or b""
                        if not ids:
                            new.append(w)
        for w, ids in zip(new, replay([w.encode() for w in new], self.vocabulary), strict=True):
            tokens[w] = packed(ids)
        for found, into in ((words, known), (starts, firsts)):
            for chunk, ws in found.items():
                into[chunk] = tokens[ws[0]] if len(ws) == 1 else b"".join([tokens[w] for w in ws])


def in_blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes in a column; one value may be longer."""
    start = size = 0
    for i, value in enumerate(batch.column(column)):
        size += value.as_buffer().size if value.is_valid else 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def encoder(name: str, columns: list[str], held: object) -> Callable:
    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ChunkTokens(Vocabulary.of(name), held.value)
        for batch in batches:
            for block in in_blocks(batch, "text"):
                ids = tokens.of_texts([(text or b"").decode() for text in texts_of(block)])
                kept = [block.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary())], names=[*columns, "ids"])

    return encode_batches


def encode(docs: DataFrame, columns: list[str], vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The named columns and `ids`: the text's token ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Each word of the vocabulary's pattern is encoded alone; strings of
    special tokens are ordinary text. Repeated rows give repeated rows, an empty table none."""
    spark = docs.sparkSession
    rows = docs.select(*columns, text_bytes().alias("text"))
    held = spark.sparkContext.broadcast(frequent_chunks(rows.select("text"), vocabulary))
    kind = docs.select(*columns).schema.add("ids", "binary")
    return rows.mapInArrow(encoder(vocabulary, columns, held), kind)


def decoded(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join(itemgetter(*ids)(tokens)) if len(ids) > 1 else b"".join([tokens[i] for i in ids])


def decoder(name: str, columns: list[str]) -> Callable:
    def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [token for _, token in sorted(Vocabulary.of(name).tokens.items())]
        for batch in batches:
            for block in in_blocks(batch, "ids"):
                texts = [decoded(np.frombuffer(ids or b"", "<u4").tolist(), tokens) for ids in texts_of(block, "ids")]
                kept = [block.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary())], names=[*columns, "decoded"])

    return decode_batches


def decode(encoded: DataFrame, columns: list[str], vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The named columns and `decoded`: the bytes that a row's ids stand for. Null ids are no bytes; an id
    that the vocabulary lacks stops the job."""
    kind = encoded.select(*columns).schema.add("decoded", "binary")
    return encoded.select(*columns, "ids").mapInArrow(decoder(vocabulary, columns), kind)


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Digests of every whole text's token ids and of what they decode to.

    Input: doc_id, text; other columns are ignored. Output: doc_id, n_tokens, ids_sha256 (of the ids as
    `encode` packs them), decoded_sha256. A null text is an empty one."""
    encoded = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], vocabulary)
    facts = encoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids"
    )
    decoded = decode(facts, ["doc_id", "n_tokens", "ids_sha256"], vocabulary)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
