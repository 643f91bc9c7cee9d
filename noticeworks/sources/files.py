"""Tables from and to files: tolerant and strict JSON, dated feeds, upserts."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.operators.ranking import last_wins

AD_SCHEMA = """id string, institution_id string, ad_number string, title string, department string, discipline string, post_type string, contract_status string,
category_breakdown struct<ur:int,sc:int,st:int,obc:int,ews:int,pwbd:int>, number_of_posts int, pay_scale string, publication_date date, closing_date date, original_url string, apply_url string,
snapshot_fetched_at timestamp, parse_confidence double, raw_text_excerpt string, pdf_excerpt string, _source_method string, _source_note string, extras map<string,string>"""

#: Fixed value: the rows of a sheet, its head included.
SHEET_ROWS = 1_048_576
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def read_json(spark: SparkSession, path: str, schema: str, *, lines: bool = True, strict: bool = False) -> DataFrame:
    """JSON lines or one JSON array with a given schema. Malformed lines are dropped, or fail if ``strict``."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, **options: bool) -> DataFrame:
    """Like ``read_json``; a missing or empty path gives an empty table."""
    try:
        return read_json(spark, path, schema, **options)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON files of a folder with the name each row came from; order is by name where it matters, never by reading."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{path}/*.json").withColumn("file_name", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modificationTime, content, sha256) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).withColumn("sha256", F.sha2("content", 256))


def feed_rows(spark: SparkSession, path: str) -> DataFrame:
    """The ads of a feed document {generated_at, ad_count, ads: [...]}, with its head in columns."""
    doc = spark.read.schema(f"generated_at timestamp, ad_count int, ads array<struct<{_struct(AD_SCHEMA)}>>").option("multiLine", True).json(path)
    return doc.select("generated_at", "ad_count", F.posexplode("ads").alias("seq", "ad")).select("generated_at", "ad_count", "seq", "ad.*")


def _struct(schema: str) -> str:
    return schema.replace("\n", " ").replace(" string", ":string").replace(" int", ":int").replace(" double", ":double").replace(" date", ":date").replace(" timestamp", ":timestamp").replace(" struct<", ":struct<").replace(" map<", ":map<")


def valid_overrides(rows: DataFrame) -> DataFrame:
    """Manual records that can be used: with id, institution and title."""
    filled = F.lit(True)
    for c in ("id", "institution_id", "title"):
        filled = filled & F.col(c).isNotNull() & (F.trim(c) != "")
    return rows.where(filled)


def write_feed(ads: DataFrame, path: str, day: str = "snapshot_date") -> None:
    """The feed as a table by day; only the days present are replaced."""
    ads.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("overwrite").json(path)


def export_feed(ads: DataFrame, path: str, generated_at: str) -> int:
    """One JSON document of a feed small enough to be published; returns the number of ads. Streams rows, nothing is held whole."""
    n = ads.count()
    with Path(path).open("w", encoding="utf-8") as out:
        out.write(f'{{"generated_at": "{generated_at}", "ad_count": {n}, "ads": [')
        for k, row in enumerate(ads.select(F.to_json(F.struct(*ads.columns)).alias("j")).toLocalIterator()):
            out.write(("," if k else "") + "\n" + row.j)
        out.write("]}\n")
    return n


def export_sheet(rows: DataFrame, path: str | BinaryIO, name: str = "Sheet1") -> int:
    """A spreadsheet of a table small enough for one sheet, heads in the first row; returns the number of rows. More rows than a sheet holds are refused."""
    n = rows.count()
    if n > SHEET_ROWS - 1:
        raise ValueError(f"a sheet holds {SHEET_ROWS - 1} rows")
    office = "http://schemas.openxmlformats.org"
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub("", str(v)))}</t></is></c>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'<Types xmlns="{office}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{office}/package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{office}/package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{office}/spreadsheetml/2006/main" xmlns:r="{office}/officeDocument/2006/relationships"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<worksheet xmlns="{office}/spreadsheetml/2006/main"><sheetData>'.encode())
            out.write(("<row>" + "".join(map(cell, rows.columns)) + "</row>").encode())
            for r in rows.toLocalIterator():
                out.write(("<row>" + "".join(map(cell, r)) + "</row>").encode())
            out.write(b"</sheetData></worksheet>")
    return n


def read_sheet(path: str | BinaryIO) -> list[list[str | None]]:
    """The rows of a sheet that ``export_sheet`` wrote, as text."""
    tag = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as book, book.open("xl/worksheets/sheet1.xml") as sheet:
        return [["".join(c.itertext()) if len(c) else None for c in row.iter(f"{tag}c")] for _, row in ElementTree.iterparse(sheet) if row.tag == f"{tag}row"]


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Old and new rows, the last of each key; a key keeps the place where it first stood (``first_seq``)."""
    return last_wins(old.unionByName(new, allowMissingColumns=True), [key], [seq])


def unique_files(files: DataFrame, name: str, order: str) -> DataFrame:
    """One row for each base name, the first by ``order``."""
    base = files.withColumn("basename", F.regexp_extract(name, r"([^/]+)$", 1))
    payload = [c for c in base.columns if c not in ("basename", order)]
    kept = base.groupBy("basename").agg(F.min(F.struct(order, *payload)).alias("f"))
    return kept.select("basename", f"f.{order}", *[F.col(f"f.{c}").alias(c) for c in payload])


def new_files(found: DataFrame, known: DataFrame, digest: str = "sha256") -> DataFrame:
    """Files whose content is not known yet, one of each content, the first by path."""
    fresh = found.join(known.select(digest).distinct(), digest, "left_anti")
    return fresh.groupBy(digest).agg(F.min("path").alias("path"))


def markdown_table(rows: DataFrame, order: list[str]) -> str:
    """A small aggregate as a Markdown table."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.orderBy(*order).collect()]
    return "\n".join(lines)
