"""Scans and sinks: document collections, mail files, pasted tables, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkproof.functions.names import content_hash
from sparkproof.operators.skew import latest, rank_in_group
from sparkproof.sources import tables


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """SRC-1: documents of a collection, and those that can't be read.

    A file is one JSON document, or one on each line. Unreadable ones are rows of the second table (path,
    text) instead of being lost; `quarantine` writes and counts them."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    corrupt = "_unreadable"
    kept = T.StructType([*fields.fields, T.StructField(corrupt, T.StringType())])
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path)
    rows = rows.withColumn("_path", F.col("_metadata.file_path"))
    # Spark refuses a plan that reads the text of unreadable rows alone, as it would parse nothing then: all
    # fields take part in the choice.
    read = F.xxhash64(*fields.fieldNames()) >= F.lit(-(2**63))
    good = rows.where(F.col(corrupt).isNull()).select(*fields.fieldNames())
    bad = rows.where(read & F.col(corrupt).isNotNull()).select(F.col("_path").alias("path"), F.col(corrupt).alias("text"))
    return good, bad


def quarantine(bad: DataFrame, path: str, run: str) -> DataFrame:
    """Write unreadable documents of a run, once however often it is retried, and count them by file."""
    spark = bad.sparkSession
    tables.write_buckets(bad, path, ["path"], run)
    held = tables.read_buckets(spark, path, bad.schema).where(F.col("writer") == run)
    return held.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def current_documents(log: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """SNK-1, read side of a log that is no `tables.Collection`: last write wins."""
    return latest(log, [key], [F.col(order)])


def read_mails(spark: SparkSession, raw_glob: str | None, html_glob: str | None, pasted: DataFrame | None) -> DataFrame:
    """SRC-3: raw messages, HTML files and pasted HTML (campaign_id, path, content, received_at) as mail rows.

    Files lie in a folder named by their campaign. Output: campaign_id, path, received_at, name, source, html, raw.
    A file's name is its last path segment; a raw message's name is its subject, if it has one."""
    none = F.lit(None).cast("string")

    def files(glob: str) -> DataFrame:
        read = spark.read.text(glob, wholetext=True).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("received_at"), "value"
        )
        parts = F.split("path", "/")
        return read.select(
            F.element_at(parts, -2).alias("campaign_id"), "path", "received_at", F.try_url_decode(F.element_at(parts, -1)).alias("file"), "value"
        )

    found = []
    if raw_glob:
        # The subject ends where a line begins that does not continue it.
        head = F.regexp_extract("value", r"(?s)^(.*?)(?:\r?\n\r?\n|$)", 1)
        subject = F.regexp_extract(head, r"(?im)^subject:[ \t]*(.*(?:\r?\n[ \t].*)*)", 1)
        subject = F.trim(F.regexp_replace(subject, r"\r?\n[ \t]+", " "))
        found.append(files(raw_glob).select(
            "campaign_id", "path", "received_at", F.when(subject != "", subject).alias("name"), F.lit("upload").alias("source"), none.alias("html"), F.col("value").alias("raw")
        ))
    if html_glob:
        found.append(files(html_glob).select(
            "campaign_id", "path", "received_at", F.col("file").alias("name"), F.lit("upload").alias("source"), F.col("value").alias("html"), none.alias("raw")
        ))
    if pasted is not None:
        # A paste without content is refused, as there is nothing to check.
        found.append(pasted.where(F.length("content") > 0).select(
            F.col("campaign_id").cast("string").alias("campaign_id"), "path", "received_at", none.alias("name"), F.lit("colle").alias("source"),
            F.col("content").alias("html"), none.alias("raw"),
        ))
    return reduce(DataFrame.unionByName, found)


def label_versions(mails: DataFrame, held: DataFrame) -> DataFrame:
    """SRC-3: `label` v{n+1} of new mails (campaign_id, received_at, path) in order of arrival, then path,
    behind the versions that a campaign has already: `held` (campaign_id, n)."""
    ranked = rank_in_group(mails, ["campaign_id"], "received_at", ["path"], "_rank")
    base = F.coalesce("n", F.lit(0))
    return ranked.join(held.select("campaign_id", "n"), "campaign_id", "left").withColumn(
        "label", F.concat(F.lit("v"), (base + F.col("_rank")).cast("string"))
    ).drop("n", "_rank")


UNTRIMMED = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: SRC-5: a workbook's cells; rows and columns are counted from 0.
CELLS = "workbook long, sheet string, row int, col int, text string, link string"


def read_cells(spark: SparkSession, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """SRC-5: cells of brief workbooks as the grid operators read them, and rows that name no cell.

    `kind` is parquet or csv (with a header, every cell quoted, \\N for null). Text keeps its line ends. A
    row without workbook, sheet, row or column, or with a negative one, comes back in the second table."""
    if kind == "csv":
        rows = spark.read.schema(CELLS).options(**UNTRIMMED, header=True, multiLine=True, quote='"', escape='"', nullValue="\\N", emptyValue="").csv(path)
    else:
        rows = spark.read.schema(CELLS).parquet(path)
    names = F.col("workbook").isNotNull() & F.col("sheet").isNotNull() & F.coalesce((F.col("row") >= 0) & (F.col("col") >= 0), F.lit(False))
    return rows.where(names), rows.where(~names)


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells as the CSV that `read_cells` reads."""
    wanted = cells.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(CELLS)])
    wanted.write.options(**UNTRIMMED, header=True, quoteAll=True, quote='"', escape='"', nullValue="\\N", emptyValue="").csv(path)


TSV_ROWS = (
    # A cell is quoted (with doubled quotes inside) or runs to the next tab or line end.
    r"(?s)(?:\"((?:[^\"]|\"\")*)\"([^\t\r\n]*)|([^\t\r\n]*))(\t|\r\n|\r|\n|$)"
)


def tsv_cells(pasted: DataFrame) -> DataFrame:
    """SRC-4: rows (paste_id, text) to cells (paste_id, row, col, text).

    Quoted cells may hold tabs and line ends, a quote inside a cell is literal, ragged rows are kept
    and a final line end adds no row. One paste is one row, so pastes are parsed in parallel."""
    t = F.col("text")
    quoted, tail, plain, end = (F.regexp_extract_all(t, F.lit(TSV_ROWS), i) for i in (1, 2, 3, 4))
    cells = F.transform(
        F.arrays_zip(quoted.alias("q"), tail.alias("t"), plain.alias("p"), end.alias("e")),
        lambda x: F.struct(
            F.concat(F.replace(x["q"], F.lit('""'), F.lit('"')), x["t"], x["p"]).alias("text"), x["e"].alias("e")
        ),
    )
    rows = pasted.select("paste_id", F.posexplode(cells).alias("i", "c"))
    w = Window.partitionBy("paste_id").orderBy("i")
    breaks = F.col("c.e").isin("\n", "\r", "\r\n").cast("int")
    rows = rows.withColumn("row", F.coalesce(F.sum(breaks).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("prev_end", F.lag("c.e").over(w))
    # The pattern matches once more, empty, at the end of the text: no cell unless a tab came before.
    ghost = (F.col("c.text") == "") & (F.col("c.e") == "") & (F.col("i") > 0) & (F.col("prev_end") != "\t")
    rows = rows.where(~ghost)
    inside = Window.partitionBy("paste_id", "row").orderBy("i")
    return rows.select(
        "paste_id", F.col("row").cast("int").alias("row"),
        (F.row_number().over(inside) - 1).alias("col"), F.col("c.text").alias("text"),
    )


def write_reports(reports: DataFrame, path: str, run: str) -> None:
    """SNK-5: reports with their content hash, once for each (version_id, content_hash).

    A run that is retried replaces what its first attempt left, and a report that an earlier run wrote
    for the same inputs is not written again. Within a run the first report id counts."""
    keys = ["version_id", "content_hash"]
    once = latest(reports, keys, [-F.xxhash64("report_id"), F.col("report_id")])
    tables.write_once(once, path, keys, run)


def with_content_hash(reports: DataFrame, config_version: int) -> DataFrame:
    """SCL-23: hash of the inputs of an analysis; campaigns are bucketed, as there may be millions."""
    return reports.withColumn(
        "content_hash", content_hash(F.col("html"), F.col("brief"), F.lit(str(config_version)))
    ).withColumn("campaign_bucket", F.pmod(F.xxhash64("campaign_id"), F.lit(64)))
