"""N-gram Jaccard join: links between documents whose sets of word shingles are alike, and their groups.

A set is its distinct shingles as 64-bit hashes; equal sets are one class, whatever the number of copies.
Shingles are ordered rare-first by the load of counters that cover all documents; their number follows
the corpus up to a bound. Two sets of Jaccard similarity t share one of their first n - ceil(t n) + 1
shingles, so only those prefixes are shuffled. Candidates pass a length, a positional and a suffix filter
(the sets' sizes in 64 ranges of hashes bound their overlap) and are then verified on the whole sets, once
for each pair.

Only components are wanted, so a group of near copies isn't spread into all its pairs. Members of a
prefix group are first compared with the group's smallest set and with their neighbours, in the order of
size and then in orders that put like sets together. All candidates that still lie in different
components are verified after that: no link between components is lost, and links inside one add nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkproof.llm.common import LOWER_BYTES, keep, text_bytes, texts_of
from sparkproof.llm.components import connected

WORDS = 5
PERCENT = 75
#: Counters of the frequency order: about one for so many shingles, and the bound of what is broadcast.
SHINGLES_PER_COUNTER = 64
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 24
#: Counters are summed in blocks.
BLOCK = 4096
PARTS = 64
#: Numbers that are equal for two sets as often as their shingles are; they only order neighbours.
SKETCH = 6
#: Neighbours in such an order that each class meets.
NEAR = 12
#: Rows of a shingle that one task orders at most (about).
ROWS_PER_SALT = 50_000
#: Bytes that are hashed at once.
CHUNK_BYTES = 1 << 20
#: Bits of the filter of wanted classes: at most 16 MB.
MOST_BITS = 1 << 27


def mark() -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64("text")


ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
IS_SPACE = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])
#: A random number for each byte at each place of a word; none for white space.
PLACES = np.random.default_rng(1).integers(1, 1 << 63, (64, 256), dtype=np.uint64)
PLACES[:, IS_SPACE] = 0


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words: sums of their bytes' numbers."""
    b = np.frombuffer(data.translate(LOWER_BYTES), np.uint8)
    space = IS_SPACE[b]
    start = ~space
    start[1:] &= space[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    first = np.zeros(len(b), np.int32)
    first[starts] = starts
    place = np.arange(len(b), dtype=np.int32) - np.maximum.accumulate(first)
    values = PLACES[place & 63, b]
    if place.max() >= 64:
        values *= ODD ** (place >> 6).astype(np.uint64)
    return starts, mixed(np.add.reduceat(values, starts))


def joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words."""
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= ODD
        out ^= out >> np.uint64(29)
        out += hashes[j : j + n]
    return mixed(out + np.uint64(size))


def shingle_sets(texts: list[bytes | None], size: int = WORDS) -> Iterator[np.ndarray]:
    """Distinct shingles of each text as ordered unsigned hashes. Texts are hashed many at a time."""
    at = 0
    while at < len(texts):
        chunk, held = [], 0
        while at < len(texts) and (not chunk or held + len(texts[at] or b"") <= CHUNK_BYTES):
            chunk.append(texts[at] or b"")
            held += len(chunk[-1])
            at += 1
        # A line end between texts keeps their words apart.
        starts, hashes = word_hashes(b"\n".join(chunk))
        ends = np.cumsum([len(t) + 1 for t in chunk])
        borders = [0, *np.searchsorted(starts, ends).tolist()]
        runs = joined(hashes, size) if len(hashes) >= size else hashes[:0]
        for first, last in zip(borders, borders[1:]):
            n = last - first
            if n >= size:
                yield np.unique(runs[first : last - size + 1])
            else:
                yield joined(hashes[first:last], n) if n else hashes[:0]


def class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def required(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any similar one."""
    return -(-percent * n // 100)


FACTS = pa.schema([
    ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("parts", pa.binary()),
    ("sketch", pa.list_(pa.int64())), ("block", pa.int32()), ("loads", pa.binary()),
])
FACTS_DDL = "doc_id long, mark long, n long, id long, parts binary, sketch array<long>, block int, loads binary"


def set_facts(size: int, counters: int) -> Callable:
    """Size, class, part sizes and sketch of each document's set; after a task's rows, its counters."""
    odd = [int(x) | 1 for x in np.random.default_rng(2).integers(1, 1 << 62, SKETCH)]

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(counters, np.uint32)
        for batch in batches:
            n, ids, parts, sketch, waiting = [], [], [], [], []
            for s in shingle_sets([*texts_of(batch)], size):
                n.append(len(s))
                ids.append(class_id(s) if len(s) else None)
                sizes = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS)
                parts.append(np.minimum(sizes, 255).astype(np.uint8).tobytes())
                sketch.append([int((s * np.uint64(x)).min() >> np.uint64(1)) for x in odd] if len(s) else None)
                waiting.append(s)
                if len(waiting) == 1000:
                    count_loads(loads, waiting)
            count_loads(loads, waiting)
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()),
                    pa.array(parts, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
                ],
                schema=FACTS,
            )
        blocks = loads.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        if len(used):
            nulls = [pa.nulls(len(used), FACTS.field(i).type) for i in range(6)]
            rows = pa.array([blocks[i].tobytes() for i in used], pa.binary())
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(used, pa.int32()), rows], schema=FACTS)

    return facts


def count_loads(loads: np.ndarray, sets: list[np.ndarray]) -> None:
    """Count the shingles of some sets, which are then forgotten."""
    if sets:
        places = (np.concatenate(sets) % np.uint64(len(loads))).astype(np.int64)
        at, times = np.unique(places, return_counts=True)
        loads[at] += times.astype(np.uint32)
        sets.clear()


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of counters that a task reads, one row after another."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, loads in zip(batch.column("block").to_pylist(), texts_of(batch, "loads"), strict=True):
            sums.setdefault(block, np.zeros(BLOCK, np.int64))
            sums[block] += np.frombuffer(loads, np.uint32)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "loads"]
        )


def prefix_rows(loads, size: int, percent: int) -> Callable:
    """The rare-first prefix of each class, once for each task: shingle, salt, salts, id, n, pos.

    Salts divide the rows of a shingle whose counter has many, for what is done along an order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = loads.value
        seen: set[int] = set()
        for batch in batches:
            shingles, ids, lengths, counts, salts, divided = [], [], [], [], [], []
            for s in shingle_sets([*texts_of(batch)], size):
                n = len(s)
                if not n or (i := class_id(s)) in seen:
                    continue
                seen.add(i)
                p = n - required(n, percent) + 1
                of = load[(s % np.uint64(len(load))).astype(np.int64)]
                rare = np.lexsort((s, of))[:p]
                shingles.append(s[rare])
                divided.append(1 + of[rare] // ROWS_PER_SALT)
                salts.append((i & 0x7FFFFFFF) % divided[-1])
                ids.append(i)
                lengths.append(n)
                counts.append(p)
            if ids:
                pos = np.concatenate([np.arange(p, dtype=np.int32) for p in counts])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(np.concatenate(divided).astype(np.int32)),
                        pa.array(np.repeat(np.array(ids, np.int64), counts)), pa.array(np.repeat(np.array(lengths, np.int32), counts)), pa.array(pos),
                    ],
                    names=["shingle", "salt", "salts", "id", "n", "pos"],
                )

    return rows


def alike(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Length and positional filter of two prefix rows of one shingle."""
    need = F.ceil(percent * (na + nb) / (100 + percent) - 1e-9)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - pa_, nb - pb) >= need)


def suffix_filter(percent: int) -> Callable:
    """Drops pairs whose part sizes differ by more than similar sets' can."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16)
                for c in ("parts_a", "parts_b")
            )
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            keep_rows = pa.array(np.abs(a - b).sum(axis=1) <= most)
            out = pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])
            yield out.filter(keep_rows)

    return passed


def verifier(percent: int) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(texts_of(batch, "set_a"), texts_of(batch, "set_b"), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield out.filter(pa.array(good, pa.bool_()))

    return verify


def wanted_sets(wanted, size: int) -> Callable:
    """Whole sets of the classes that a filter of bits lets pass, once for each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for s in shingle_sets([*texts_of(batch)], size):
                if len(s) and (i := class_id(s)) not in seen and all(
                    bits[p >> 6] >> np.uint64(p & 63) & np.uint64(1) for p in bit_places(i, 64 * len(bits))
                ):
                    seen.add(i)
                    ids.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return rows


def bit_places(i: int, bits: int) -> tuple[int, int]:
    """Two bits of a class; `bits` is a power of two of at most 2^32."""
    return i & (bits - 1), (i >> 32) & (bits - 1)


def bit_filter(ids: DataFrame) -> np.ndarray:
    """Bits of all ids, combined by an aggregate: as many words as `MOST_BITS` allows, whatever the ids."""
    n = ids.count()
    bits = min(max(1 << 16, 1 << (16 * n).bit_length()), MOST_BITS)
    place = F.explode(F.array(
        F.col("id").bitwiseAND(F.lit(bits - 1)), F.shiftright("id", 32).bitwiseAND(F.lit(bits - 1))
    )).alias("place")
    words = (
        ids.select(place)
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


class Join:
    """The join of one table of documents: what all its rounds share."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.context = docs.sparkSession.sparkContext
        self.texts = docs.select(text_bytes().alias("text"))
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), text_bytes().alias("text"))
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        wanted = total // (6 * SHINGLES_PER_COUNTER)
        counters = min(max(LEAST_COUNTERS, 1 << int(wanted).bit_length()), MOST_COUNTERS)
        facts = keep(ids.mapInArrow(set_facts(size, counters), FACTS_DDL), "sets")
        self.docs = facts.where("block IS NULL").select("doc_id", "mark", "n", "id")
        blocks = facts.where("block IS NOT NULL").select("block", "loads").repartition("block")
        sums = blocks.mapInArrow(add_blocks, "block int, loads binary").toArrow()
        load = np.zeros((counters // BLOCK, BLOCK), np.int64)
        for block, values in zip(sums["block"].to_pylist(), sums["loads"].to_pylist(), strict=True):
            load[block] = np.frombuffer(values, np.int64)
        self.loads = self.context.broadcast(load.reshape(-1))
        classes = facts.where("id IS NOT NULL").groupBy("id").agg(F.first("parts").alias("parts"), F.first("sketch").alias("sketch"))
        self.parts = keep(classes, "parts")
        self.hits = self.prefix_hits()
        # Small groups are compared whole in the end; orders are for those that would give many pairs.
        sizes = self.hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > NEAR)
        rows = self.hits.select("shingle", "salt", "id", "n", "pos").join(sizes.select("shingle"), "shingle")
        self.large = keep(rows.join(self.parts.select("id", "sketch"), "id"), "large")

    def prefix_hits(self) -> DataFrame:
        """Prefix rows of shingles that several classes share, with the group's first row and the row before."""
        rows = self.texts.mapInArrow(
            prefix_rows(self.loads, self.size, self.percent), "shingle long, salt int, salts int, id long, n int, pos int"
        )
        group = Window.partitionBy("shingle", "salt")
        ordered = group.orderBy("n", "id")
        row = F.struct("id", "n", "pos")
        shared = rows.select(
            "*", F.lag(row).over(ordered).alias("before"), F.first(row).over(ordered).alias("hub"),
            F.last("id").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"),
        )
        # A class that several tasks have sent stands in neighbouring rows.
        once = F.col("before").isNull() | (F.col("before.id") != F.col("id"))
        # Other classes of a divided shingle may stand under its other salts.
        alone = (F.col("hub.id") == F.col("last")) & (F.col("salts") == 1)
        return keep(shared.where(~alone & once).drop("last", "salts"), "prefixes")

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a < b, na, nb) that pass the suffix filter."""
        left = self.parts.select(F.col("id").alias("a"), F.col("parts").alias("parts_a"))
        right = self.parts.select(F.col("id").alias("b"), F.col("parts").alias("parts_b"))
        return pairs.join(left, "a").join(right, "b").mapInArrow(
            suffix_filter(self.percent), "a long, b long, na int, nb int"
        )

    @staticmethod
    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def sets_of(self, pairs: DataFrame) -> DataFrame:
        wanted = self.context.broadcast(bit_filter(keep(self.ends(pairs), "wanted")))
        sets = self.texts.mapInArrow(wanted_sets(wanted, self.size), "id long, shingles binary")
        return keep(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), "shingles")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
        found = pairs.select("a", "b").join(left, "a").join(right, "b")
        return keep(found.mapInArrow(verifier(self.percent), "a long, b long"), "verified")

    def best_edges(self, rows: DataFrame, other: str) -> DataFrame:
        """For each class the partner that most of its shingles propose in column `other`: a, b, na, nb."""
        o = F.col(other)
        fit = alike(o["n"], o["pos"], F.col("n"), F.col("pos"), self.percent)
        x, y = F.struct(o["id"].alias("id"), o["n"].alias("n")), F.struct("id", "n")
        times = (
            rows.where((o["id"] != F.col("id")) & fit)
            .select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
            .groupBy("x", "y").agg(F.count(F.lit(1)).alias("times"))
        )
        pair = F.struct(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        of = times.select(pair.alias("pair"), "times", F.explode(F.array("x.id", "y.id")).alias("of"))
        best = of.groupBy("of").agg(F.max_by("pair", F.struct("times", "pair")).alias("pair"))
        return best.select("pair.*").distinct()

    def sketch_edges(self) -> DataFrame:
        """Partners among neighbours of the same groups, in orders that put like sets together."""
        found = []
        for k in range(0, SKETCH, 2):
            ordered = Window.partitionBy("shingle", "salt").orderBy(F.get("sketch", k), F.get("sketch", k + 1), "n", "id")
            near = self.large.select("id", "n", "pos", F.lag(F.struct("id", "n", "pos")).over(ordered).alias("before"))
            found.append(self.best_edges(near, "before"))
        return found[0].union(found[1]).union(found[2]).distinct()

    @staticmethod
    def across(hits: DataFrame, labels: DataFrame) -> DataFrame:
        """Prefix rows of groups that hold several components, with the row's component."""
        rows = hits.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = rows.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        return keep(rows.join(mixed.select("shingle"), "shingle"), "mixed")

    def neighbours(self, rows: DataFrame, k: int) -> DataFrame:
        """Pairs of each row with those of the next NEAR of its group, in an order that puts like sets
        together, that lie in other components."""
        group = Window.partitionBy("shingle", "salt").orderBy(F.get("sketch", k), F.get("sketch", k + 1), "n", "id")
        last = F.collect_list(F.struct("id", "n", "pos", "label")).over(group.rowsBetween(-NEAR, -1))
        met = rows.select("id", "n", "pos", "label", last.alias("last"))
        met = met.withColumn("o", F.explode(F.filter("last", lambda x: x["label"] != F.col("label")))).drop("last")
        met = met.where(alike(F.col("o.n"), F.col("o.pos"), F.col("n"), F.col("pos"), self.percent))
        x, y = F.struct(F.col("o.id").alias("id"), F.col("o.n").alias("n")), F.struct("id", "n")
        return (
            met.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        )

    def between(self, rows: DataFrame) -> DataFrame:
        """All candidates between different components. One side leaves out the largest component of each
        group, which no pair needs on both sides."""
        counts = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("times"))
        largest = counts.groupBy("shingle").agg(F.max_by("label", F.struct("times", "label")).alias("largest"))
        minor = rows.join(largest, "shingle").where("label <> largest").drop("largest")
        x, y = (side.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "pos", "label")]) for k, side in (("x", minor), ("y", rows)))
        fit = alike(F.col("n_x"), F.col("pos_x"), F.col("n_y"), F.col("pos_y"), self.percent)
        pairs = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("label_x") != F.col("label_y")) & fit)
        a, b = F.struct(F.col("id_x").alias("id"), F.col("n_x").alias("n")), F.struct(F.col("id_y").alias("id"), F.col("n_y").alias("n"))
        return (
            pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        )

    def components(self) -> DataFrame:
        """Component of every class that has a link: id, label."""
        near = self.best_edges(self.hits, "hub").union(self.best_edges(self.hits, "before")).distinct()
        near = keep(self.filtered(near), "pairs")
        pairs = ["a", "b", "na", "nb"]
        more = keep(self.filtered(self.sketch_edges().join(near.select("a", "b"), ["a", "b"], "left_anti")), "pairs")
        sets = self.sets_of(near.union(more))
        links = self.verified(near, sets)
        labels = connected(links)

        more = keep(self.apart(more, labels).select(*pairs), "pairs")
        links = links.union(self.verified(more, sets))
        labels = connected(links)
        done = near.select("a", "b").union(more.select("a", "b"))

        # A class may be like many of a large component but not like those that it has met by now.
        for k in range(0, SKETCH, 2):
            more = self.neighbours(self.across(self.large, labels), k).join(done, ["a", "b"], "left_anti")
            for end in ("a", "b"):
                more = more.join(sets.select(F.col("id").alias(end)), end, "left_semi")
            more = keep(self.filtered(more.select(*pairs)), "pairs")
            if more.isEmpty():
                break
            links = links.union(self.verified(more, sets))
            labels = connected(links)
            done = done.union(more.select("a", "b"))

        hits = self.hits.select("shingle", "id", "n", "pos")
        rest = self.between(self.across(hits, labels)).join(done, ["a", "b"], "left_anti")
        rest = keep(self.filtered(rest), "pairs")
        if not rest.isEmpty():
            if not self.ends(rest).join(sets, "id", "left_anti").isEmpty():
                sets = self.sets_of(rest)
            links = links.union(self.verified(rest, sets))
            labels = connected(links)
        return labels

    @staticmethod
    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends lie in different components."""
        left = labels.select(F.col("id").alias("a"), F.col("label").alias("label_a"))
        right = labels.select(F.col("id").alias("b"), F.col("label").alias("label_b"))
        rows = pairs.join(left, "a", "left").join(right, "b", "left")
        return rows.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))


def grouped_documents(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, mark, n and label: the group of a document, null if it has no words."""
    found = Join(docs, size, percent)
    labels = found.components()
    # Tables that are joined on an often repeated class are kept before, so that the joins can be split.
    grouped = found.docs.join(labels, "id", "left")
    return keep(grouped.select("doc_id", "mark", "n", F.coalesce("label", "id").alias("label")), "groups")


def join_documents(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Set size and group of every document.

    Input: doc_id, text; other columns are ignored. Null texts and texts without words have no set and
    are linked with nothing; fewer than `size` words are one shingle. Documents with equal sets are
    linked; repeated rows give repeated rows, an empty table none. Rows with a null id take part: their
    group is named by its smallest id, null if there is none. Classes and shingles are told apart by 64-bit
    hashes. Output: doc_id, n_shingles, component_id."""
    grouped = grouped_documents(docs, size, percent)
    first = keep(grouped.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("first")), "firsts")
    return grouped.join(first, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of docs without those whose group has a document of smaller id (then smaller hash of its text).

    Documents without words stay. Rows that agree in id and text are one document; null ids come last."""
    grouped = grouped_documents(docs, size, percent)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    first = grouped.where("label IS NOT NULL").groupBy("label").agg(F.min(place).alias("first")).select("first.doc_id", "first.mark")
    stay = first.union(grouped.where("label IS NULL").select("doc_id", "mark")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"))
    once = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("mark"))
    stay = stay.select(F.col("doc_id").alias("stay_id"), F.col("mark").alias("stay_mark"))
    held = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("mark") == F.col("stay_mark")), "left_semi")
    return held.withColumn("once", once).where("once = 1").select("row.*")
