"""Minimax contiguous partition of documents into shards, by bytes.

Equal texts are one atomic group. The groups stand in one order: large ones first, by falling size, then
all others by the hash of their text. The smallest capacity for which greedy filling needs no more shards
than asked is found by binary search, and the order is cut there. A group that is larger than an even
share of what is left has a shard of its own, so that it doesn't set the capacity of the others.

The driver never sees all groups. It searches over cells: sums of the sizes of ranges of hashes. A cell
in which a cut may lie is refined by another aggregate, until those are single groups; every level sends
a bounded number of cells. Large groups are bounded too: each has more than 1/`FINE` of a shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkproof.llm.common import keep

SHARDS = 8
#: A group of more than total / (shards * FINE) bytes is large.
FINE = 1000
#: Each level of cells reads so many more bits of the hash.
LEVEL_BITS = 12
KEY_BITS = 60
#: Rows numbered by one task; only their number of cells depends on it.
ROWS_PER_CELL = 20_000


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (prefix sums) of the shards when each takes all that fits, or None if something is left."""
    cuts, at = [], 0
    while at < ends[-1]:
        i = bisect_right(ends, at + capacity) - 1
        if len(cuts) == shards or i < 0 or ends[i] <= at:
            return None
        at = ends[i]
        cuts.append(at)
    return cuts


def smallest_capacity(ends: list[int], shards: int) -> int:
    """Binary search: sizes are whole numbers, and what fits a capacity fits every larger one."""
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


class Order:
    """The order of groups as far as it is known: large (hash, bytes), then (low hash, bits, bytes).

    A cell with KEY_BITS bits is a single group; others hold several of unknown sizes."""

    def __init__(self, large: list[tuple[int, int]], cells: list[tuple[int, int, int]]):
        self.large, self.cells = large, sorted(cells)
        self.ends = list(accumulate([n for _, n in self.large] + [n for _, _, n in self.cells]))

    def single(self, i: int) -> bool:
        return i < len(self.large) or self.cells[i - len(self.large)][1] == KEY_BITS

    def uncertain(self, shards: int) -> list[int]:
        """Cells of several groups in which a cut may lie, whatever those groups' sizes.

        The capacity is between total / shards and that of whole cells. A cut lies after that of whole
        cells at the former and before that of cells which may be cut anywhere at the latter."""
        ends = self.ends
        high, low = smallest_capacity(ends, shards), -(-ends[-1] // shards)
        found: set[int] = set()
        first = last = 0
        for _ in range(shards - 1):
            i = bisect_right(ends, first + low) - 1
            first = max(first, ends[i]) if i >= 0 else first
            last = min(last + high, ends[-1])
            i = bisect_left(ends, last)
            if ends[i] > last and self.single(i):
                last = ends[i - 1] if i else 0
            found.update(range(bisect_right(ends, first), min(bisect_left(ends, last) + 1, len(ends))))
        return sorted(i - len(self.large) for i in found if not self.single(i))


def prefix(bits: int) -> Column:
    """The first bits of a hash, the rest zero."""
    return F.shiftleft(F.shiftright("key", KEY_BITS - bits), KEY_BITS - bits)


def known_order(groups: DataFrame, border: float, large: list, shards: int) -> Order:
    """Refine cells until every cut lies between single groups."""
    small = groups.where(F.col("bytes") <= border)

    def level(rows: DataFrame, bits: int) -> list[tuple[int, int, int]]:
        sums = rows.groupBy(prefix(bits).alias("low")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("key")
        )
        return [(r["key"], KEY_BITS, r["bytes"]) if r["n"] == 1 else (r["low"], bits, r["bytes"]) for r in sums.collect()]

    found = Order(large, level(small, LEVEL_BITS))
    while found.ends and (open_cells := found.uncertain(shards)):
        # Coarsest first, so that each aggregate serves one level.
        bits = min(found.cells[i][1] for i in open_cells)
        chosen = {i for i in open_cells if found.cells[i][1] == bits}
        lows = [found.cells[i][0] for i in sorted(chosen)]
        finer = level(small.where(prefix(bits).isin(lows)), min(bits + LEVEL_BITS, KEY_BITS))
        found = Order(large, [c for i, c in enumerate(found.cells) if i not in chosen] + finer)
    return found


def shard_column(found: Order, alone: list[int], shards: int) -> Column:
    """The shard of a row from its group's hash; groups that stand alone come first."""
    out, base = F.lit(0), len(alone)
    if found.ends:
        cuts = greedy(found.ends, smallest_capacity(found.ends, shards), shards)
        shard_of = [base + bisect_left(cuts, e) for e in found.ends]
        n = len(found.large)
        out = F.lit(shard_of[min(n, len(shard_of) - 1)])
        for i in range(n + 1, len(shard_of)):
            if shard_of[i] != shard_of[i - 1]:
                out = F.when(F.col("key") >= found.cells[i - n][0], shard_of[i]).otherwise(out)
        for s in sorted(set(shard_of[:n])):
            keys = [k for (k, _), of in zip(found.large, shard_of, strict=False) if of == s]
            out = F.when(F.col("key").isin(keys), s).otherwise(out)
    for s, key in enumerate(alone):
        out = F.when(F.col("key") == key, s).otherwise(out)
    return out.cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shard of every document, and its place there.

    Input: doc_id, text; other columns are ignored. A null text has no bytes, so size 1, and groups with
    the empty text. Repeated rows and null ids are placed as rows of their own. An empty table gives no
    rows; fewer groups than shards leave shards empty. Groups aren't cut,
    however large. Output: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            # Of the 64-bit hash 60 bits, so that a key is never negative. Texts that share one are one group.
            F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key"),
        ),
        "sizes",
    )
    groups = keep(slim.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    facts = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    border = facts["bytes"] / (shards * FINE)
    large = [(r["key"], r["bytes"]) for r in groups.where(F.col("bytes") > border).collect()]
    large.sort(key=lambda x: (-x[1], x[0]))
    alone, rest = [], facts["bytes"]
    while large and len(alone) < shards - 1 and large[0][1] * (shards - len(alone)) >= rest:
        key, n = large.pop(0)
        alone.append(key)
        rest -= n
    found = known_order(groups, border, large, shards - len(alone))
    cells = -(-facts["n"] // ROWS_PER_CELL)
    placed = slim.withColumn("shard", shard_column(found, alone, shards - len(alone))).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(max(cells, 1)))
    )
    # Places are counted in cells of ids, so that copies of one text are spread, then shifted.
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return placed.join(offsets, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
