"""Files as documents: content type by suffix, text by format, errors as rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules

MAX_BYTES = 100 << 20
PARSED = "full_text string, pages array<struct<page:int,text:string>>, tables array<array<array<string>>>, segments array<struct<start:double,end:double,text:string>>, ocr array<struct<text:string,confidence:double,bbox:array<array<double>>>>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"

#: What a parser returns: any of the fields of PARSED.
Parser = Callable[[bytes], dict]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def files(spark: SparkSession, path: str) -> DataFrame:
    """file_path, file_name, file_type, file_hash, size, modified, content; listing and reading are Spark's, which leaves out empty files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("file_path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), extension(F.col("path")).alias("file_type"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def parse_text(data: bytes) -> dict:
    return {"full_text": data.decode()}


def parse_docx(data: bytes) -> dict:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    paragraphs = [t for p in body.findall(f"{_W}p") if (t := said(p)).strip()]
    tables = [[[said(c) for c in row.findall(f"{_W}tc")] for row in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    return {"full_text": "\n".join(paragraphs), "tables": tables}


def parse_pptx(data: bytes) -> dict:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    pages = []
    for i, n in enumerate(names, 1):
        paragraphs = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in ElementTree.fromstring(z.read(n)).iter(f"{_A}p")]
        if text := "\n".join(p for p in paragraphs if p.strip()):
            pages.append({"page": i, "text": text})
    return {"full_text": "\n\n".join(p["text"] for p in pages), "pages": pages}


def parse_pdf(data: bytes) -> dict:
    """Non-blank pages, from 1; needs the optional library pypdf."""
    from pypdf import PdfReader

    pages = [{"page": i, "text": t} for i, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1) if (t := p.extract_text() or "").strip()]
    return {"full_text": "\n\n".join(p["text"] for p in pages), "pages": pages}


def needs_model(data: bytes) -> dict:
    raise ValueError("a recogniser for this kind of file must be given")


#: Images, audio and video need a recogniser: pass {".png": parser, ...} to parsed().
PARSERS: dict[str, Parser] = {".txt": parse_text, ".md": parse_text, ".docx": parse_docx, ".pptx": parse_pptx, ".pdf": parse_pdf} | dict.fromkeys((".jpg", ".jpeg", ".png", ".mp3", ".wav", ".mp4"), needs_model)


def parsed(found: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """found (from files()) with the parsed fields in place of content. What fails to parse has full_text '' and an error."""
    known = PARSERS | (parsers or {})
    names = T.StructType.fromDDL(PARSED).names
    rest = [f for f in found.schema.fields if f.name != "content"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for kind, data in zip(f["file_type"], f["content"], strict=True):
                try:
                    if kind not in known:
                        raise ValueError(f"unsupported file type: {kind}")
                    got = {"full_text": ""} | known[kind](bytes(data))
                except Exception as e:
                    got = {"full_text": "", "error": f"{type(e).__name__}: {e}"}
                rows.append([got.get(n) for n in names])
            yield pd.concat([f.drop(columns="content").reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=object)], axis=1)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), PARSED])
    return found.mapInPandas(run, ddl)


def upload_gate(uploads: DataFrame, name: str = "file_name", size: str = "size", text: str | None = None) -> DataFrame:
    """uploads with `rejected`: why a file isn't taken, null if it is. Sort out by filtering on it."""
    reason = F.when(~F.coalesce(extension(F.col(name)), F.lit("")).isin(*rules.EXTENSIONS), "file type").when(F.coalesce(F.col(size), F.lit(0)) == 0, "empty file").when(F.col(size) > MAX_BYTES, "too large")
    if text:
        reason = reason.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "no text")
    return uploads.withColumn("rejected", reason)


def question_file(spark: SparkSession, path: str) -> DataFrame:
    """id, type, question, expected_keywords of a JSON array."""
    return spark.read.schema("id string, type string, question string, expected_keywords array<string>").json(path, multiLine=True)
