"""HTML tables: rows and cells, placement on a grid, confidence, cell lookup."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

CELL = "struct<row:int, column:int, row_span:int, column_span:int, header:boolean, text:string>"


class _Reader(HTMLParser):
    """Collects (header, row span, column span, text) by row; text of nested tables goes to the cell around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.cell = None
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            a = dict(attrs)
            self.cell = [tag == "th", _span(a.get("rowspan")), _span(a.get("colspan")), ""]
            self.rows[-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell[3] += "\n"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[3] += data


def _span(value: str | None) -> int:
    return int(value) if value and value.strip().isdigit() and 0 < int(value) <= 1000 else 1


def place_cells(html: str | None) -> list[tuple]:
    """Cells of a table with their place from 1: a cell takes the first free column of its row; spans keep later places taken."""
    if not html:
        return []
    reader = _Reader()
    reader.feed(html)
    reader.close()
    taken: set[tuple[int, int]] = set()
    out = []
    for r, cells in enumerate([row for row in reader.rows if row], 1):
        c = 1
        for header, rows, columns, text in cells:
            while (r, c) in taken:
                c += 1
            taken.update((r + i, c + j) for i in range(rows) for j in range(columns))
            out.append((r, c, rows, columns, header or r == 1, text.strip()))
            c += columns
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("row", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("row_span", T.IntegerType()), T.StructField("column_span", T.IntegerType()), T.StructField("header", T.BooleanType()), T.StructField("text", T.StringType())])))
def _cells(html: pd.Series) -> pd.Series:
    names = ("row", "column", "row_span", "column_span", "header", "text")
    return html.map(lambda h: [dict(zip(names, c)) for c in place_cells(h)], na_action=None)


def table_cells(rows: DataFrame, row_id: str, html: str) -> DataFrame:
    """(row_id, row, column, row_span, column_span, header, text) of every cell; null or empty markup has none."""
    return rows.select(row_id, F.explode(_cells(F.col(html))).alias("c")).select(row_id, "c.*")


def table_shape(cells: DataFrame, row_id: str) -> DataFrame:
    """(row_id, rows, columns, cells, confidence): 0.9 if the column spans of every row add up to the column count, else 0.5."""
    per = cells.groupBy(row_id, "row").agg(F.sum("column_span").alias("wide"), F.max(F.expr("column + column_span - 1")).alias("end"), F.count("*").alias("n"))
    out = per.groupBy(row_id).agg(F.max("row").alias("rows"), F.max("end").alias("columns"), F.sum("n").alias("cells"), F.min("wide").alias("a"), F.max("wide").alias("b"))
    return out.withColumn("confidence", F.when((F.col("a") == F.col("columns")) & (F.col("b") == F.col("columns")), 0.9).otherwise(0.5)).drop("a", "b")


def cell_box(x: Column, y: Column, w: Column, h: Column, rows: Column, columns: Column, row: Column, column: Column, row_span: Column, column_span: Column) -> Column:
    """Estimated box of a cell in a table that is divided evenly."""
    cw, ch = w / columns, h / rows
    return F.struct((x + (column - 1) * cw).alias("x"), (y + (row - 1) * ch).alias("y"), (cw * column_span).alias("width"), (ch * row_span).alias("height"))


def cell_at(cells: DataFrame, places: DataFrame, row_id: str) -> DataFrame:
    """Places (row_id, at_row, at_column) with the cell that covers them, merged cells included; null text where none does."""
    met = places.join(cells, row_id, "left").where("row is null or (at_row >= row and at_row < row + row_span and at_column >= column and at_column < column + column_span)")
    found = met.where("row is not null").select(row_id, "at_row", "at_column", "row", "column", "text")
    return places.join(found, [row_id, "at_row", "at_column"], "left")
