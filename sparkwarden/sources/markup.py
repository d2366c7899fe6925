"""Elements of nested markup, one row each, from a scan with a stack of open tags.

Column expressions cut flat text; they cannot tell a table inside a table's cell from the next row.  The scan gives every
element its place, its parent, its depth and path, and its own text, so that nesting is a matter of joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements without an end, and elements that end where another of their kind (or of the second list) begins (fixed values).
EMPTY = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
CLOSED_BY = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "option": ["option"], "p": ["p", "table", "ul", "ol", "dl", "div", "section", "h1", "h2", "h3", "h4"]}
#: Elements that may stand inside a word; all others part what stands before and behind them (fixed values).
INLINE = ["a", "abbr", "b", "em", "i", "mark", "small", "span", "strong", "sub", "sup", "u"]
#: Where the search for an element to close ends.
_BOUNDS = ["table", "ul", "ol", "dl", "section", "details", "div"]


class _Scan(HTMLParser):
    """place, parent, depth, path, tag, id, class, href, own text and the whole text of each element, in order of their begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.parts: list[str] = []  # all text; an element has what comes while it is open

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = [t for t, by in CLOSED_BY.items() if tag in by]
        while closes and (k := next((k for k in range(len(self.open) - 1, -1, -1) if self.rows[self.open[k]]["tag"] in [*closes, *_BOUNDS]), None)) is not None and self.rows[self.open[k]]["tag"] in closes:
            self._close(k)
        self._part(tag)
        at, parent = dict(attrs), self.open[-1] if self.open else None
        path = f"{self.rows[parent]['path']}/{tag}" if parent is not None else tag
        self.rows.append({"place": len(self.rows), "parent": parent, "depth": len(self.open), "path": path, "tag": tag, "id": at.get("id"), "class": at.get("class"), "href": at.get("href"), "own": [], "text": (len(self.parts), None)})
        if tag not in EMPTY:
            self.open.append(len(self.rows) - 1)
        else:
            self.rows[-1]["text"] = (0, 0)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def _part(self, tag: str) -> None:
        if tag not in INLINE and self.open:
            self.rows[self.open[-1]]["own"].append(" ")
            self.parts.append(" ")

    def _close(self, k: int) -> None:
        for i in self.open[k:]:
            self.rows[i]["text"] = (self.rows[i]["text"][0], len(self.parts))
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        self._part(tag)
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]]["tag"] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.rows[self.open[-1]]["tag"] not in ("script", "style"):
            self.rows[self.open[-1]]["own"].append(data)
            self.parts.append(data)


def scan(html: str | None) -> list[dict]:
    x = _Scan()
    x.feed(html or "")
    x.close()
    x._close(0)
    squeeze = lambda parts: " ".join("".join(parts).split())
    return [r | {"own": squeeze(r["own"]), "text": squeeze(x.parts[slice(*r["text"])])} for r in x.rows]


SCHEMA = "place int, parent int, depth int, path string, tag string, id string, class string, href string, own string, text string"


@F.udtf(returnType=SCHEMA)
class Elements:
    """SQL: SELECT * FROM pages, LATERAL elements(html)."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        for r in scan(html):
            yield tuple(r[c.split()[0]] for c in SCHEMA.split(", "))


def elements(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """The columns keep of each page with every element of it (a page is scanned once; null and empty pages have none)."""
    page = df.select(*[F.col(c).alias(f"page_{c}") for c in keep], F.col(html).cast("string").alias("_html"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    heads = [*page.columns[:-1], *names]

    def work(batches):
        for b in batches:
            of, found, pages = [], [], b.column(b.num_columns - 1)
            for i in range(b.num_rows):
                rows = scan(pages[i].as_py())
                found += rows
                of += [i] * len(rows)
                if len(found) >= 10_000 or i == b.num_rows - 1:  # so many elements and those of one page at once
                    columns = [b.column(k).take(pa.array(of, pa.int64())) for k in range(b.num_columns - 1)]
                    columns += [pa.array([r[n] for r in found], pa.int32() if n in ("place", "parent", "depth") else pa.string()) for n in names]
                    yield pa.RecordBatch.from_arrays(columns, names=heads)
                    of, found = [], []

    schema = [*(f"`page_{c}` {page.schema[f'page_{c}'].dataType.simpleString()}" for c in keep), SCHEMA]
    return page.mapInArrow(work, ", ".join(schema))


def table_cells(found: DataFrame, keep: list[str]) -> DataFrame:
    """found: see elements().  One row for each cell of each table: the table's, row's and cell's number and the cell's own
    text, without what tables inside the cell hold (their cells are rows of their own)."""
    ids = [f"page_{c}" for c in keep]
    at = lambda x, name: F.col(f"{x}.{name}")
    cells, rows = found.where("tag in ('td', 'th')").alias("c"), found.where("tag = 'tr'").alias("r")
    met = cells.join(rows, [at("c", i).eqNullSafe(at("r", i)) for i in ids] + [at("c", "parent") == at("r", "place")])
    # A row's table is its parent, or the parent of the body or head that holds it.
    bodies = found.where("tag in ('tbody', 'thead', 'tfoot')").alias("b")
    placed = met.join(bodies, [at("r", i).eqNullSafe(at("b", i)) for i in ids] + [at("r", "parent") == at("b", "place")], "left")
    table = F.coalesce(at("b", "parent"), at("r", "parent"))
    flat = placed.select(*[at("c", i) for i in ids], table.alias("table"), at("r", "place").alias("_row"), at("c", "place").alias("_cell"), at("c", "own").alias("own"), at("c", "text").alias("text"), at("c", "depth").alias("depth"))
    within = Window.partitionBy(*ids, "table").orderBy("_row")  # one table of one page
    return flat.withColumn("row", F.dense_rank().over(within)).withColumn("cell", F.row_number().over(Window.partitionBy(*ids, "table", "_row").orderBy("_cell"))).drop("_row", "_cell")


def under_headings(found: DataFrame, keep: list[str], levels: list[str], of: Column) -> DataFrame:
    """The elements where `of` holds, each with the text of the last heading of each level before it (column named as the
    level); a heading of a level ends the headings of the levels below."""
    ids = [f"page_{c}" for c in keep]
    before = Window.partitionBy(*ids).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # one page
    out, above = found, F.lit(-1)
    for level in levels:
        last = F.max(F.when(F.col("tag") == level, F.struct("place", "text"))).over(before)
        out = out.withColumn(f"_{level}", last)
        out = out.withColumn(level, F.when(F.col(f"_{level}.place") > above, F.col(f"_{level}.text")))
        above = F.greatest(above, F.coalesce(F.col(f"_{level}.place"), F.lit(-1)))
    return out.where(of).drop(*[f"_{x}" for x in levels])
