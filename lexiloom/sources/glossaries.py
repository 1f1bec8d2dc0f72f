"""Glossaries from XLSX and SQLite files, and the files of a folder: ``source``, ``target``, ``domain``; blank terms go."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.office import xlsx_rows
from lexiloom.sources.readers import GENERAL, find_column

# --- fixed values: header names, actions that leave a term as it is, names of client files --------------
SHEET_SOURCE = ("英文术语", "source", "en", "english", "原文", "source_term", "term")
SHEET_TARGET = ("中文译法", "中文术语", "target", "zh", "chinese", "译文", "target_term", "synonym", "translation")
SHEET_DOMAIN = ("领域", "domain", "field", "category", "分类")
SHEET_ACTION = ("处理方式", "action", "type")
TABLE_SOURCE = ("source", "en", "english", "src", "source_term", "英文术语")
TABLE_TARGET = ("target", "zh", "chinese", "tgt", "target_term", "中文术语")
TABLE_DOMAIN = ("domain", "field", "category", "领域")
KEEP_AS_IS = ("保留原文", "keep", "keep original", "retain")
CLIENT_FILES = ("_术语要求.xlsx", "_术语要求.xls", "client_terms.json", "_client_terms.json", "术语要求.xlsx", "client_glossary.json")
GLOSSARY_KINDS = ("xlsx", "xls", "csv", "db")

TERMS = "path string, source string, target string, domain string"


def glossary_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Terms of the first sheet of XLSX files; columns by header, else the first two; terms to be kept as they are go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at, cells in zip(f["path"], f["rows"], strict=True):
                rows = [["" if c is None else str(c).strip() for c in r["cells"]] for r in cells]
                header = rows[0]
                s, t = find_column(header, SHEET_SOURCE), find_column(header, SHEET_TARGET)
                s, t = (0, 1) if s is None or t is None else (s, t)
                d, a = find_column(header, SHEET_DOMAIN), find_column(header, SHEET_ACTION)
                get = lambda r, i: r[i] if i is not None and i < len(r) else ""
                out += [(at, get(r, s), get(r, t), get(r, d) or GENERAL) for r in rows[1:] if get(r, a) not in KEEP_AS_IS and get(r, s) and get(r, t)]
            yield pd.DataFrame(out, columns=["path", "source", "target", "domain"])

    first = xlsx_rows(spark, path).filter("sheet_index = 0")
    return first.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("row_index", "cells"))).alias("rows")).mapInPandas(run, TERMS)  # one file's sheet, parsed whole before


def glossary_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """Terms of every table with a source and a target column in SQLite files (``*.db``); other tables are passed over."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, data in zip(f["path"], f["content"], strict=True):
                db, out = sqlite3.connect(":memory:"), []
                db.deserialize(bytes(data))
                quoted = lambda n: '"' + n.replace('"', '""') + '"'
                for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY rowid").fetchall():
                    columns = [c[1] for c in db.execute(f"PRAGMA table_info({quoted(table)})")]
                    s, t, d = (find_column(columns, names) for names in (TABLE_SOURCE, TABLE_TARGET, TABLE_DOMAIN))
                    if s is None or t is None:
                        continue
                    picked = ", ".join(quoted(columns[i]) if i is not None else "NULL" for i in (s, t, d))
                    said = ([str(v).strip() if v is not None else "" for v in r] for r in db.execute(f"SELECT {picked} FROM {quoted(table)}"))
                    out += [(at, a, b, c or GENERAL) for a, b, c in said if a and b]
                db.close()
                yield pd.DataFrame(out, columns=["path", "source", "target", "domain"])

    return _files(spark, path, ("db",)).select("path", "content").mapInPandas(run, TERMS)


def _files(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> DataFrame:
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(path)
    return d.filter(r"path not rlike '/~[$]'")


def scan_glossaries(spark: SparkSession, path: str) -> DataFrame:
    """Glossary files of a folder, ``(path, kind)``, sorted by kind and then by name; temporary files are left out."""
    kind = F.substring_index("path", ".", -1)
    rank = F.array_position(F.array(*[F.lit(k) for k in GLOSSARY_KINDS]), kind)
    return _files(spark, path, GLOSSARY_KINDS).select("path", kind.alias("kind")).orderBy(rank, "path")


def client_file(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """The client's glossary of each folder: of the known names that it holds the one that comes first."""
    rank = F.array_position(F.array(*[F.lit(n) for n in CLIENT_FILES]), F.col(name))
    return files.filter(rank > 0).groupBy(folder).agg(F.min_by(name, rank).alias(name))
