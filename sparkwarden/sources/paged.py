"""A paginated source that filters by itself: a partition for each page, and only pages that may have what is asked for.

An endpoint answers `fetch(page, filters)` with rows and how many match in all; here it is a folder of blocks of pages, each
page with a list of what its rows hold of the columns that the endpoint can filter by.  Filters on these columns are pushed
to it.

What the driver knows grows with the blocks, not with the pages: each block has a list of its own pages beside it, and the
tasks read these.  Where there are few pages each is a partition, else each block.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sparkwarden.sources.reports import _open


#: Pages of a block, pages that are partitions of their own, and values of a filter column that are listed for a block (one
#: with more may hold any).
BLOCK_PAGES, FEW_PAGES, LISTED = 2000, 1000, 1000


@dataclass
class Page(InputPartition):
    """A block, or one page of it (number from 0)."""

    path: str
    wanted: dict[str, list]
    page: int | None = None


def _may(holds: dict[str, list | None], wanted: dict[str, list]) -> bool:
    return all(holds[c] is None or set(holds[c]) & set(values) for c, values in wanted.items())


def _pages(block: str) -> list[dict]:
    """(at, size, holds) of each page of a block."""
    fs, at = _open(block)
    with fs.open_input_stream(f"{at}.pages") as f:
        return json.loads(f.read())


class PagedReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns
        fs, at = _open(path)
        with fs.open_input_stream(f"{at}/index.json") as f:
            self.index = json.loads(f.read())  # one entry for each block
        self.wanted: dict[str, list] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else None
            if column in self.index["filters"]:
                values = list(f.value) if isinstance(f, In) else [f.value]
                held = self.wanted.get(column)
                self.wanted[column] = values if held is None else [v for v in held if v in values]
            else:
                yield f

    def partitions(self) -> list[Page]:
        blocks = [(f"{self.path}/{b['name']}", b["pages"]) for b in self.index["blocks"] if _may(b["holds"], self.wanted)]
        if sum(n for _, n in blocks) <= FEW_PAGES:
            found = [Page(b, self.wanted, i) for b, _ in blocks for i, p in enumerate(_pages(b)) if _may(p["holds"], self.wanted)]
        else:
            found = [Page(b, self.wanted) for b, _ in blocks]
        return found or [Page("", {})]

    def read(self, part: Page) -> Iterator[tuple]:
        if not part.path:
            return
        fs, at = _open(part.path)
        pages = _pages(part.path)
        with fs.open_input_file(at) as f:
            for page in pages if part.page is None else [pages[part.page]]:
                if not _may(page["holds"], part.wanted):
                    continue
                for row in json.loads(f.read_at(page["size"], page["at"]))["data"]:
                    named = dict(zip(self.columns, row, strict=False))
                    if all(named.get(c) in values for c, values in part.wanted.items()):
                        yield tuple(named.get(c) for c in self.columns)


class PagedSource(DataSource):
    """Options: path (the endpoint), columns (names by position)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["path"], self.options["columns"].split(","))


def write_pages(rows: DataFrame, path: str, page: F.Column, columns: list[str], filters: list[str]) -> None:
    """Rows as pages of an endpoint: page numbers them; a page's rows are few."""
    fs, folder = _open(path)
    fs.create_dir(folder, recursive=True)
    paged = rows.select(page.cast("int").alias("_page"), F.array(*[F.col(c).cast("string") for c in columns]).alias("_row"))
    pages = paged.groupBy("_page").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    places = {c: columns.index(c) for c in filters}

    def write(batches):
        import pyarrow as pa

        fs, entries = _open(path)[0], []
        each = (rows for b in batches for rows in b.column(b.schema.get_field_index("_rows")).to_pylist())
        while block := list(itertools.islice(each, BLOCK_PAGES)):
            name, listed, at = f"block-{uuid.uuid4().hex}.json", [], 0  # a task that runs again has blocks of its own
            with fs.open_output_stream(f"{folder}/{name}") as f:
                for rows in block:
                    body = json.dumps({"recordsTotal": len(rows), "data": rows}).encode()
                    f.write(body)
                    listed.append({"at": at, "size": len(body), "holds": {c: sorted({r[i] for r in rows if r[i] is not None}) for c, i in places.items()}})
                    at += len(body)
            with fs.open_output_stream(f"{folder}/{name}.pages") as f:
                f.write(json.dumps(listed).encode())
            every = {c: sorted({v for p in listed for v in p["holds"][c]}) for c in places}
            entries.append(json.dumps({"name": name, "pages": len(block), "holds": {c: v if len(v) <= LISTED else None for c, v in every.items()}}))
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string())], names=["entry"])

    blocks = [json.loads(r[0]) for r in pages.mapInArrow(write, "entry string").collect()]  # one for each block
    with fs.open_output_stream(f"{folder}/index.json") as f:
        f.write(json.dumps({"filters": filters, "blocks": sorted(blocks, key=lambda e: e["name"])}).encode())


def read_pages(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("path", path).option("columns", ",".join(columns)).load()
