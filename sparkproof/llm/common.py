"""Helpers shared by the operators: kept tables, words, row numbers, Arrow tables from columns."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkproof.session import shared_dir

A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Bytes of UTF-8 text to words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower case: all else becomes a blank.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
    for b in range(256)
)
#: Only A-Z to lower case; bytes.split() then gives the words [^\x20\x09-\x0D]+.
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sparkproof-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, *A_TO_Z)


def text_bytes(c: Column | str = "text") -> Column:
    """UTF-8 bytes of a text; null stays null."""
    return (F.col(c) if isinstance(c, str) else c).cast("binary")


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def arrow_rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A record batch of the schema; columns that are missing are null."""
    n = len(next(iter(columns.values())))
    arrays = [
        pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type)
        for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """Values of a binary column, one at a time."""
    return (v.as_py() for v in batch.column(name))


def global_offsets(counts: DataFrame, group: str, part: str, n: str) -> DataFrame:
    """Rows of each (group, part) and how many rows of the group lie in earlier parts.

    `counts` has one row for each group and task, so a group's window holds as many rows as there
    were tasks, whatever its size."""
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(n).over(earlier), F.lit(0)))


class ChunkCache(dict):
    """What `compute` gives for a string, in bounded memory: the younger of two generations takes what
    is used, the older is dropped when the younger fills. Long strings are not kept."""

    words = 250_000
    longest = 64

    def __init__(self) -> None:
        self.old: dict = {}

    def compute(self, chunk):
        raise NotImplementedError

    def __missing__(self, chunk):
        out = self.old.get(chunk)
        if out is None:
            out = self.compute(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.words:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out


def blank_chunks(text: str) -> list[str]:
    """Strings between blanks. Other white space stays inside them and is left to the tokenizer."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return [out[b] for b in range(256)]


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer's file; the folder is a parameter of the environment's package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def limit_threads() -> None:
    """One thread for each Python worker: Spark runs as many workers as there are cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
