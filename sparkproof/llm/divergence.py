"""Divergence of sources by products of one-hot level matrices.

Within a language a term's price in a group (language and source) depends only on how often the group
has it: its count level. How far two groups lie apart is therefore a sum over their joint table: how many
terms stand at level a in one and at level b in the other. Terms are rows, (group, level) pairs are
indicator columns, and the product of that matrix with its transpose holds the joint tables of all pairs
of groups. It is made in blocks of terms and of groups, each an exact product of small whole numbers; its
entries are priced where they are made, and prices of blocks are added up.

Texts are read once, and counted in each task before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkproof.llm.common import keep, text_bytes, texts_of

#: A term is kept by a language that has it in so many of its documents at least.
LEAST_DOCUMENTS = 10
#: Terms reported for each group.
TOP_TERMS = 10
#: Different terms a task gathers before it hands its counts on.
TASK_TERMS = 400_000
#: About so many terms and groups to a task of the product, and terms to one matrix product.
BLOCK_TERMS, BLOCK_GROUPS, TILE_TERMS = 4096, 32, 256

#: Bytes of UTF-8 text to terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+ in lower case: all else becomes a blank.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

COUNTED = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64()),
])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group of a task; every group has a row without term."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in found.items():
            terms = list(times)
            m = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * m), pa.array([source] * m), pa.array([None, *terms], pa.binary()),
                    pa.array([0, *times.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, terms)], pa.int64()),
                ],
                schema=COUNTED,
            )
        found.clear()

    for batch in batches:
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for group, text in zip(groups, texts_of(batch), strict=True):
            if group not in found:
                found[group] = Counter(), Counter()
            times, docs = found[group]
            words = (text or b"").translate(TERM_BYTES).split()
            held -= len(times)
            times.update(words)
            held += len(times)
            docs.update(set(words))
            if held > TASK_TERMS:
                yield from rows()
                held = 0
    yield from rows()


def price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), in whole numbers; null where nothing is kept."""
    whole = lambda c, digits=19: c.cast(f"decimal({digits},0)")
    over = F.lit(1_000_000_000).cast("decimal(10,0)") * (whole(n) + whole(F.lit(2), 1))
    under = F.when(terms > 0, whole(total) + whole(F.lit(2), 1) * whole(terms, 17))
    return (F.lit(1) + F.call_function("div", over, under)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, kept, entries): lang, source and its total; lang, term, lang_n; and the groups' counts."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_bytes().alias("text"),
    )
    gathered = rows.mapInArrow(gather, "lang string, source string, term binary, n long, docs long")
    counted = keep(
        gathered.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "terms",
    )
    kept = keep(
        counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least).drop("docs"),
        "kept-terms",
    )
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    counts = counted.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"])
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = keep(
        counted.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("total", "v", "lang_total")}),
        "groups",
    )
    entries = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "v",
        price(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        price(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
    )
    return groups, kept, keep(entries, "entries")


def one_hot(counts: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator columns of the (group, level) pairs of a tile, with each column's group and price.

    counts and prices: a row for each term, a column for each group."""
    rows, groups = counts.shape
    found = [np.unique(counts[:, g], return_index=True, return_inverse=True) for g in range(groups)]
    starts = np.cumsum([0, *(len(levels) for levels, _, _ in found)])
    matrix = np.zeros((rows, starts[-1]), np.float32)
    for g, (_, _, level) in enumerate(found):
        matrix[np.arange(rows), starts[g] + level] = 1
    group = np.repeat(np.arange(groups), np.diff(starts))
    return matrix, group, np.concatenate([prices[first, g] for g, (_, first, _) in enumerate(found)])


def priced_tables(counts: np.ndarray, prices: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum of the divergences of all terms, for each pair of a left and a right group.

    A tile's product counts at most TILE_TERMS terms in an entry, so that it is exact in float32."""
    out = np.zeros((len(left), len(right)), np.int64)
    # Terms of like frequency share levels, so that a tile has few columns.
    order = np.argsort(counts.max(axis=1, initial=0), kind="stable")
    for start in range(0, len(order), TILE_TERMS):
        tile = order[start : start + TILE_TERMS]
        a, a_group, a_price = one_hot(counts[np.ix_(tile, left)], prices[np.ix_(tile, left)])
        b, b_group, b_price = one_hot(counts[np.ix_(tile, right)], prices[np.ix_(tile, right)])
        joint = a.T @ b
        i, j = np.nonzero(joint)
        p, q = a_price[i], b_price[j]
        value = joint[i, j].astype(np.int64) * ((p - q) ** 2 // (p + q))
        np.add.at(out, (a_group[i], b_group[j]), value)
    return out


PARTS = "lang string, source string, item string, value long, covered long, rest long, v long"


def block_product(key: tuple, entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Priced joint tables of two blocks of groups over one block of terms.

    `covered` terms occur in some group of the blocks; every other term has the divergence `rest`."""
    lang, i, j, _ = key
    names = groups["source"].tolist()
    at = {name: g for g, name in enumerate(names)}
    none = groups["p"].fillna(1).to_numpy(np.int64)
    term, seen = pd.factorize(entries["term"])
    column = entries["source"].map(at).to_numpy(np.int64)
    counts = np.zeros((len(seen), len(names)), np.int64)
    prices = np.tile(none, (len(seen), 1))
    counts[term, column] = entries["n"].to_numpy(np.int64)
    prices[term, column] = entries["p"].to_numpy(np.int64)
    block = groups["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    value = priced_tables(counts, prices, left, right)
    rest = (none[left][:, None] - none[right]) ** 2 // (none[left][:, None] + none[right])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
    ways = [(left[a], right[b])] if i == j else [(left[a], right[b]), (right[b], left[a])]
    source = np.array(names, object)
    out = [
        pd.DataFrame({
            "lang": lang, "source": source[x], "item": source[y], "value": value[a, b], "covered": len(seen),
            "rest": rest[a, b], "v": int(groups["v"].iloc[0]) if len(groups) else 0,
        })[x != y]
        for x, y in ways
    ]
    return pd.concat(out)


def divided(n: Column, size: int) -> Column:
    return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")


def pair_divergences(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of different sources of a language."""
    sizes = groups.groupBy("lang").agg(
        divided(F.count(F.lit(1)), BLOCK_GROUPS).alias("blocks"), divided(F.max("v"), BLOCK_TERMS).alias("parts")
    )
    with_blocks = keep(
        groups.join(sizes, "lang").select(
            "lang", "source", "v", "blocks", "parts", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"),
            price(F.lit(0), F.col("total"), F.col("v")).alias("p"),
        ),
        "blocks",
    )
    # Each block of groups meets every other one, itself included.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    left = (
        entries.drop("v", "q").join(with_blocks.drop("v", "p"), ["lang", "source"])
        .withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
        .select("*", other).select("lang", *pair, "part", "source", "term", "n", "p")
    )
    right = (
        with_blocks.select("*", other).select("lang", *pair, "parts", "source", "p", "v", "block")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    )
    keys = ["lang", "i", "j", "part"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block_product, PARTS)
    return parts.groupBy("lang", "source", "item").agg(
        (F.sum("value") + (F.max("v") - F.sum("covered")) * F.max("rest")).alias("value")
    )


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Divergence of each source of a language from its others, and the terms that tell it from its language.

    Input: text, lang, source; nulls are empty strings, other columns are ignored. Terms are runs of
    letters and non-ASCII characters. A language keeps the terms of at least `least` of its documents
    (rows; repeated rows are documents of their own). Output: lang, source, part, item, value, rank. Part
    `pair`: item is another source, value sums (p - q)^2 / (p + q), rounded down, over all kept terms;
    nothing kept gives 0. Part `term`: the first `top` kept terms that the source has more often than its
    language does. Ties go by the item's bytes. An empty table gives no rows."""
    groups, _, entries = term_counts(docs, least)
    pairs = pair_divergences(groups, entries).withColumn("part", F.lit("pair"))
    terms = entries.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")]
    return pairs.select(*columns).unionByName(terms.select(*columns).where(F.col("rank") <= top))
