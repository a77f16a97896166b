"""A report as a folder: one table per folder and a manifest, with listing, extraction and a one-file summary."""

from __future__ import annotations

import base64
import gzip
import html
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import scope
from strandloom.sources.formats import from_bed12, write_lines

MANIFEST = "manifest"
#: Rows of a table that a one-file summary can hold; of a larger one it has the number of rows and a link to the folder.
INLINE_ROWS = 5000


def write_report(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], path: str, params: dict[str, object] | None = None) -> None:
    """Write every table as parquet under ``path`` and the manifest (name, columns) and parameters beside them.

    Tables are made one by one, so that what each of them needs in between is dropped once it is written.
    """
    rows = []
    for name, make in tables.items():
        with scope():
            df = make()
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            rows.append((name, json.dumps(df.dtypes)))
    spark.createDataFrame(rows, "name string, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/{MANIFEST}")
    spark.createDataFrame([(k, str(v)) for k, v in (params or {}).items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/params")


def list_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, columns string").json(f"{path}/{MANIFEST}").orderBy("name")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of a report by its name."""
    if not [r for r in list_tables(spark, path).collect() if r["name"] == name]:
        raise KeyError(f"{path} has no table {name}")
    return spark.read.parquet(f"{path}/{name}")


def extract_lines(spark: SparkSession, path: str, name: str, out: str, compress: bool = False, genepred: bool = False) -> None:
    """One table as tab-separated lines; with ``genepred``, a table of BED12 columns as genePred lines."""
    df = read_table(spark, path, name)
    write_lines(from_bed12(df) if genepred else df, out, compress)


def write_partitioned(df: DataFrame, path: str, kind: str) -> None:
    """One pass over ``df`` into one folder per value of ``kind``."""
    df.write.mode("overwrite").partitionBy(kind).parquet(path)


def _cell(value: object) -> str:
    return "" if value is None else str(value)


def _summary_of(df: DataFrame, path: str, name: str, links: bool) -> str:
    """A table's part of the summary: all of its rows in order of its columns, or where they are."""
    title, n = html.escape(name), df.count()
    if n > INLINE_ROWS:
        return f'<h3>{title}</h3><p>{n} rows: <a href="{html.escape(path)}/{title}">{title}</a></p>'
    rows = df.orderBy(*[c for c, t in df.dtypes if not t.startswith("map")]).collect()
    lines = ["\t".join(map(_cell, row)) for row in rows]
    data = base64.b64encode(gzip.compress("\n".join(lines).encode(), mtime=0)).decode()
    link = f'<a download="{title}.txt.gz" href="data:application/gzip;base64,{data}">{title}.txt.gz</a>' if links else ""
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in row) + "</tr>" for row in rows)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    return f"<h3>{title}</h3>{link}<table><tr>{head}</tr>{body}</table>"


def write_summary(spark: SparkSession, path: str, out: str, links: bool = True, sections: dict[str, list[str]] | None = None) -> None:
    """One XHTML file that shows the report's tables by section and, with ``links``, holds each as gzipped lines in a data URI.

    A section is there if the report has one of its tables; tables of no section come last.
    A table of more than INLINE_ROWS rows is named with its number of rows and a link to its
    folder, as a file can't hold it; no rows are left out otherwise.
    """
    names = [r["name"] for r in list_tables(spark, path).collect()]
    named = {t for tables in (sections or {}).values() for t in tables}
    parts = []
    for title, tables in {**(sections or {}), "Tables": [n for n in names if n not in named]}.items():
        here = [t for t in tables if t in names]
        if here:
            parts.append(f"<h2>{html.escape(title)}</h2>" + "".join(_summary_of(read_table(spark, path, t), path, t, links) for t in here))
    text = f'<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>Report</title></head><body>{"".join(parts)}</body></html>'
    tmp = f"{out}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, out)


def summary_tables(spark: SparkSession, summary: str) -> DataFrame:
    """(name, line) of every table held in a one-file summary."""
    text = spark.read.option("wholetext", True).text(summary)
    link = 'download="([^"]+)" href="data:[^,]*base64,([^"]*)"'
    parts = F.arrays_zip(*[F.regexp_extract_all("value", F.lit(link), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "data"))])
    found = text.select(F.explode(parts).alias("x")).select("x.name", "x.data")

    def unpack(batches):
        for pdf in batches:
            for name, data in zip(pdf["name"], pdf["data"]):
                lines = gzip.decompress(base64.b64decode(data)).decode().split("\n")
                yield type(pdf)({"name": [name] * len(lines), "line": lines})

    return found.mapInPandas(unpack, "name string, line string")
