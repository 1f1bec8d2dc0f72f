"""Paragraphs, pages and glossaries from files.

Text, CSV and JSON are read by Spark. DOCX and XLSX files are parsed from their XML (``office``). PDF files are listed as
binaryFile, so the cluster spreads them, and parsed where their parser is installed; without it only that reader fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import norm_key

# --- fixed values: header names of a source column, keys of a client's file ------------------------------------------------
SOURCE_NAMES = ("source", "英文", "原文", "源语", "english", "en", "term")
ABOUT_FILE = ("project", "description", "version", "name")  # keys of a client's file that are no terms
GENERAL = "通用"

PARAGRAPH = "path string, para_index int, text string, style string, is_table_cell boolean"


#: Tables of fewer bytes a core are dealt out: what little they have may all be in one row group, which is one task.
SMALL = 32 << 20


def spread(table: DataFrame) -> DataFrame:
    """A table as read, its rows dealt over all cores if it is small; a large one has row groups enough and stays."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return table.repartition(cores) if size < cores * SMALL else table


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-blank lines, trimmed, with their place in the text from 1 (blank ones count)."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("para_index", "text")).withColumns({"para_index": F.col("para_index") + 1, "text": F.trim("text")}).filter("text <> ''")


def paragraph_texts(lines: DataFrame, least: int = 2) -> DataFrame:
    """Lines of ``least`` characters or more; shorter ones are marks."""
    return lines.filter(F.char_length("text") >= least)


def page_chars(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, chars, plain)``: characters of each page, and of its text without tags."""
    plain = F.regexp_replace(html, "<[^>]*>", "")
    return pages.select(key, F.length(html).cast("long").alias("chars"), F.length(plain).cast("long").alias("plain"))


def term_index(texts: DataFrame, column: str = "value", file: str = "file") -> DataFrame:
    """``(file, source_term, target, count, first_para, intra_file_conflict)`` from JSON {file, terms: {source: {...}}}, a text per file.

    A text without a file of its own goes by the name in column ``file``; texts that are no such JSON have no terms.
    """
    entry = "struct<target:string,count:bigint,first_para:bigint,intra_file_conflict:boolean>"
    parsed = F.from_json(column, f"struct<file:string,terms:map<string,{entry}>>")
    d = texts.select(F.col(file).alias("_name"), parsed.alias("j")).select(F.coalesce("j.file", "_name").alias("file"), F.explode("j.terms").alias("source_term", "t"))
    return d.select("file", "source_term", "t.*")


def term_index_files(spark: SparkSession, path: str) -> DataFrame:
    """:func:`term_index` of files term_index_*.json under ``path``."""
    d = spark.read.option("pathGlobFilter", "term_index_*.json").text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"term_index_(.*)\.json$", 1)
    return term_index(d.select("value", name.alias("file")))


def split_paragraphs(texts: DataFrame, key: list[str], column: str = "value") -> DataFrame:
    """``(key, para_index, text, style, heading_level, is_table_cell, table_index, row, col, page)`` of split documents in JSON.

    Three shapes: {"chapters": [{"paragraphs": [...], "tables": [...]}]}, where cells that are not blank follow their
    chapter's paragraphs; {"pages": [{"page_num", "text"}]}, a paragraph per line that is not blank; and a list of
    paragraphs. Paragraphs keep the index they have, others are counted. Cells may be texts or objects with a text.
    """
    para = "struct<index:int,text:string,style:string,heading_level:int>"
    table = "struct<table_index:int,data:array<array<string>>,rows:array<array<string>>>"
    whole = F.from_json(column, f"struct<chapters:array<struct<paragraphs:array<{para}>,tables:array<{table}>>>,pages:array<struct<page_num:int,text:string>>>")
    listed = F.from_json(column, f"array<{para}>")
    kind = "array<struct<index:int,text:string,style:string,heading_level:int,table_index:int,row:int,col:int,page:int>>"
    null = lambda t="int": F.lit(None).cast(t)
    row = lambda i, t, s, h, ti=None, r=None, c=None, p=None: F.struct(i.alias("index"), t.alias("text"), s.alias("style"), h.alias("heading_level"), *[(x if x is not None else null()).cast("int").alias(n) for x, n in ((ti, "table_index"), (r, "row"), (c, "col"), (p, "page"))])
    plain = lambda p: row(p["index"], F.coalesce(p["text"], F.lit("")), F.coalesce(p["style"], F.lit("Normal")), p["heading_level"])
    said = lambda c: F.trim(F.when(c.startswith("{"), F.coalesce(F.get_json_object(c, "$.text"), F.lit(""))).otherwise(F.coalesce(c, F.lit(""))))
    cells = lambda t: F.flatten(F.transform(F.coalesce(t["data"], t["rows"]), lambda r, i: F.transform(r, lambda c, j: row(null(), said(c), F.lit("TABLE_CELL"), null(), F.coalesce(t["table_index"], F.lit(0)), i + 1, j + 1))))
    of_table = lambda t: F.filter(F.coalesce(cells(t), F.array().cast(kind)), lambda c: c["text"] != "")
    many = lambda a: F.coalesce(a, F.array().cast(kind))
    chapters = F.flatten(F.transform(whole["chapters"], lambda c: F.concat(many(F.transform(c["paragraphs"], plain).cast(kind)), many(F.flatten(F.transform(c["tables"], lambda t: of_table(t).cast(kind)))))))
    of_page = lambda p: F.filter(F.transform(F.split(F.coalesce(p["text"], F.lit("")), "\n"), lambda t: row(null(), F.trim(t), F.lit("Normal"), null(), p=p["page_num"])), lambda x: x["text"] != "")
    pages = F.flatten(F.transform(whole["pages"], lambda p: of_page(p).cast(kind)))
    rows = F.transform(listed, lambda p, i: row(i + 1, F.coalesce(p["text"], F.lit("")), F.coalesce(p["style"], F.lit("Normal")), p["heading_level"])).cast(kind)
    found = F.when(F.col(column).rlike(r"^\s*\["), rows).otherwise(F.coalesce(chapters, pages))
    d = texts.select(*key, F.posexplode(found).alias("_n", "p"))
    return d.select(*key, F.coalesce("p.index", F.col("_n") + 1).alias("para_index"), "p.text", "p.style", "p.heading_level", (F.col("p.style") == "TABLE_CELL").alias("is_table_cell"), "p.table_index", "p.row", "p.col", "p.page")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files under ``path``."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return lines(d, "path")


def find_column(header: list[str], names: tuple[str, ...]) -> int | None:
    """Index of the header that equals a name, else of one that contains or is contained in one."""
    low = [(h or "").strip().lower() for h in header]
    exact = next((i for n in names for i, h in enumerate(low) if h == n.lower()), None)
    return exact if exact is not None else next((i for n in names for i, h in enumerate(low) if h and (n.lower() in h or h in n.lower())), None)


def glossary_csv(spark: SparkSession, path: str, domain: str = GENERAL) -> DataFrame:
    """source, target, domain from CSV files with a header: the first three columns; ``domain`` where there is no third."""
    d = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    col = lambda i: F.trim(F.coalesce(F.col(f"`{d.columns[i]}`"), F.lit("")))
    third = col(2) if len(d.columns) > 2 else F.lit(domain)
    return d.select(col(0).alias("source"), col(1).alias("target"), third.alias("domain")).filter("source <> '' and target <> ''")


def _client_terms(value: Column) -> Column:
    """Array of (source, target, note) of a client's JSON text."""
    term = lambda s, t, n: F.struct(s.alias("source"), t.alias("target"), F.coalesce(n, F.lit("")).alias("note"))
    item = lambda e, *names: F.coalesce(*[F.nullif(e[n], F.lit("")) for n in names])
    listed = F.from_json(value, "array<struct<source:string,src:string,en:string,target:string,tgt:string,zh:string,note:string,`备注`:string>>")
    of_list = F.transform(listed, lambda e: term(item(e, "source", "src", "en"), item(e, "target", "tgt", "zh"), item(e, "note", "备注")))
    inner = F.get_json_object(value, "$.terms")
    inside = lambda e, path: F.get_json_object(e["value"], path)
    entries = lambda text: F.map_entries(F.from_json(text, "map<string,string>"))
    of_map = F.transform(entries(inner), lambda e: term(F.coalesce(inside(e, "$.source"), e["key"]), F.coalesce(inside(e, "$.target"), e["value"]), inside(e, "$.note")))
    flat = F.filter(entries(value), lambda e: ~e["key"].isin(*ABOUT_FILE) & ~e["value"].rlike(r"^\s*[\[{]"))
    return F.when(value.rlike(r"^\s*\["), of_list).when(inner.isNotNull(), of_map).otherwise(F.transform(flat, lambda e: term(e["key"], e["value"], F.lit(""))))


def client_glossary_json(texts: DataFrame, column: str = "value", key: list[str] | None = None) -> DataFrame:
    """source, target, note from JSON in any of three shapes: {"terms": {...}}, a list, or a flat map.

    With ``key``, columns of ``texts`` that come first in the result, the last of a key's sources with equal normal forms
    counts. Texts that are null or no JSON have no terms.
    """
    keys = key or []
    d = texts.select(*keys, F.posexplode(_client_terms(F.col(column))).alias("_pos", "t")).select(*keys, "_pos", "t.*").filter("source <> '' and target <> ''")
    if not keys:
        return d.drop("_pos")
    last = d.groupBy(*keys, norm_key(F.col("source")).alias("_norm")).agg(F.max_by(F.struct("source", "target", "note"), "_pos").alias("t"))
    return last.select(*keys, "t.*")


def sheet_chunks(rows: DataFrame, size: int = 200, order: list | None = None, key: str = "sheet") -> DataFrame:
    """Data rows of a sheet in chunks of ``size``; chunk_id has a suffix only if there are several."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["row"])))
    d = rows.withColumn("chunk_no", F.floor((nth - 1) / F.lit(size)) + 1)
    chunks = rows.groupBy(key).agg(F.ceil(F.count("*") / F.lit(size)).alias("chunks"))
    return d.join(chunks, key).withColumn("chunk_id", F.when(F.col("chunks") > 1, F.concat(F.col(key), F.lit("_"), F.col("chunk_no").cast("string"))).otherwise(F.col(key)))


def ocr_text(payload: Column) -> Column:
    """The text of an OCR answer: payload.ocr_output or payload.result, a text or an object with content or text, payload.text, or
    payload itself; '' for an answer with an error code. Answers of other shapes are looked through for text, data.text,
    result.markdown and blocks."""
    inner = lambda path: F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.payload.{path}.{c}"), F.lit("")) for c in ("content", "text")], F.get_json_object(payload, f"$.payload.{path}"))
    code = F.coalesce(F.get_json_object(payload, "$.header.code").try_cast("int"), F.lit(0))
    known = F.coalesce(inner("ocr_output"), inner("result"), F.get_json_object(payload, "$.payload.text"), F.get_json_object(payload, "$.payload"))
    blocks = F.array_join(F.from_json(F.coalesce(F.get_json_object(payload, "$.blocks[*].text"), F.lit("[]")), "array<string>"), "\n")
    return F.when(code != 0, "").otherwise(F.coalesce(known, F.get_json_object(payload, "$.text"), F.get_json_object(payload, "$.data.text"), F.get_json_object(payload, "$.result.markdown"), F.nullif(blocks, F.lit(""))))


def _parse_pdf(data: bytes) -> list[tuple]:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as d:
        return [(i, p.get_text(), "PAGE", False) for i, p in enumerate(d, 1)]


def _pdf_files(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, data in zip(f["path"], f["content"], strict=True) for r in _parse_pdf(bytes(data))]
            yield pd.DataFrame(rows, columns=["path", "para_index", "text", "style", "is_table_cell"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    return files.filter(~F.col("path").rlike(r"/~\$")).select("path", "content").mapInPandas(run, PARAGRAPH)


def office_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Paragraphs, rows or pages of all files of a kind under ``path``; temporary files are left out.

    Cells of a sheet's row are joined by " | "; its style is ROW. Rows of all sheets are numbered in the sheets' order.
    """
    from lexiloom.sources import office

    if kind == "pdf":
        return _pdf_files(spark, path)
    if kind == "docx":
        return office.docx_paragraphs(spark, path).drop("outline")
    rows = office.xlsx_rows(spark, path)
    said = F.array_join("cells", " | ", "")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("sheet_index", "row_index"))
    return rows.select("path", nth.alias("para_index"), said.alias("text"), F.lit("ROW").alias("style"), F.lit(False).alias("is_table_cell"))
