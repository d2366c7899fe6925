"""One report file of several sections, written by the tasks that have the rows.

Tasks write the lines of their rows aside; the commit joins these pieces, in order of section and of first line, into one
file and puts it in place by a rename.  Lines never pass through the driver's memory all at once: pieces are copied in
blocks.  A write that fails leaves no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

COPY_BYTES = 1 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Pieces(WriterCommitMessage):
    """(section, first line's order, path) of what a task has written."""

    found: list[tuple[int, int, str]]


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.aside = path, f"{path}.{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Pieces:
        """rows: (section, place, line), sorted within the task; lines of one section in a row are one piece."""
        fs, folder = _open(self.aside)
        fs.create_dir(folder, recursive=True)
        found, out, section = [], None, None
        try:
            for r in rows:
                if r["section"] != section:
                    if out is not None:
                        out.close()
                    section, name = r["section"], f"{folder}/{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name)
                    found.append((r["section"], r["place"], name))
                out.write(f"{r['line']}\n".encode())
        finally:
            if out is not None:
                out.close()
        return Pieces(found)

    def commit(self, messages: list[Pieces | None]) -> None:
        fs, folder = _open(self.aside)
        _, place = _open(self.path)
        fs.create_dir(folder, recursive=True)
        whole = f"{folder}/whole"
        with fs.open_output_stream(whole) as out:
            for *_, piece in sorted(x for m in messages if m is not None for x in m.found):
                with fs.open_input_stream(piece) as part:
                    while block := part.read(COPY_BYTES):
                        out.write(block)
        fs.move(whole, place)
        fs.delete_dir(folder)

    def abort(self, messages: list[Pieces | None]) -> None:
        fs, folder = _open(self.aside)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sectioned_report"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"])


def quoted(c) -> F.Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def write_report(spark: SparkSession, sections: list[tuple[str, str, DataFrame, list[str]]], path: str, title: str) -> None:
    """sections: (heading, header line, rows, columns to sort by); rows have one text column `line` besides.  The file has the
    title, and of each section the heading, the header and the lines in order, with an empty line before it."""
    heads, every = [(0, -1, f"# {title}")], None
    for i, (heading, header, rows, order) in enumerate(sections, 1):
        heads += [(i, -4 + k, x) for k, x in enumerate(["", f"## {heading}", header])]
        # Range parts follow each other, so their numbers order the pieces, and the place within orders their lines.
        ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
        placed = ranged.select(F.lit(i).alias("section"), F.monotonically_increasing_id().alias("place"), "line")
        every = placed if every is None else every.unionByName(placed)
    top = spark.createDataFrame(heads, "section int, place bigint, line string")
    spark.dataSource.register(ReportSource)
    lines = top.coalesce(1).sortWithinPartitions("section", "place").unionByName(every) if every is not None else top
    lines.write.format("sectioned_report").mode("append").option("path", path).save()


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(section, line): the lines of a report under their headings, without headings, headers and empty lines.

    The file is read in blocks, line by line; a block's lines have the last heading before them in the block, or else the
    last one of the blocks before it.  So no task holds more of a section than its block.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    ends = lines.groupBy("_block").agg(F.max_by("value", "_at").alias("_last"))
    every = Window.orderBy("_block")  # one row for each block
    before = ends.select("_block", F.lag("_last").over(every).alias("_last"))
    within = Window.partitionBy("_block").orderBy("_at")
    # A heading follows an empty line, which may be the last one of the block before; its header follows it.
    value, above = F.col("value"), F.coalesce(F.lag("value").over(within), "_last")
    told = lines.join(F.broadcast(before), "_block").withColumn("_head", F.when(value.startswith("## ") & (above == ""), F.substr(value, F.lit(4))))
    told = told.select("_block", "_at", "value", "_head", F.last("_head", ignorenulls=True).over(within).alias("_section"), F.lag("_head").over(within).alias("_header"), (F.row_number().over(within) == 1).alias("_first"))
    last = told.groupBy("_block").agg(F.max_by("_section", "_at").alias("_carried"), F.max_by("_head", "_at").alias("_open"))
    carried = last.select("_block", F.last("_carried", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"), F.lag("_open").over(every).alias("_open"))
    whole = told.join(F.broadcast(carried), "_block").withColumn("section", F.coalesce("_section", "_carried"))
    header = F.col("_header").isNotNull() | (F.col("_first") & F.col("_open").isNotNull())
    return whole.where(F.col("section").isNotNull() & F.col("_head").isNull() & ~header & (F.col("value") != "")).select("section", F.col("value").alias("line"))
