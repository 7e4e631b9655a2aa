"""Readers of DOCX and RTF files as markdown, one row a file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_RTF = re.compile(
    r"\\uc(?P<count>\d+) ?|\\u(?P<unit>-?\d+) ?|\\'(?P<byte>[0-9a-fA-F]{2})|\\(?P<line>par|line)(?![a-zA-Z]) ?|\\(?P<sign>[\\{}])"
    r"|\{\\(?:\*|fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|\\[a-zA-Z]+-?\d* ?|[{}\r\n]|(?P<text>[^\\{}\r\n]+)"
)


def docx_markdown(data: bytes) -> str:
    """Paragraphs of a DOCX file; a style HeadingN gives a header of level N + 1, other headings level 2."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out = []
    for p in body.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        if text and name.startswith("Heading"):
            level = name.removeprefix("Heading").strip()
            text = "#" * (int(level) + 1 if level.isdigit() else 2) + " " + text
        if text:
            out.append(text)
    return "\n\n".join(out)


def _code_page(number: str | None) -> str:
    name = f"cp{number or 1252}"
    try:
        "".encode(name)
    except LookupError:
        return "cp1252"
    return name


def rtf_text(data: bytes) -> str:
    """The text of an RTF file: control words go, paragraphs end lines, escapes are decoded. Bytes, escaped or plain, are
    in the code page that the file names (cp1252 without one); after a \\u, as many fallbacks as \\uc says are left out."""
    source = data.decode("latin-1")
    page = re.search(r"\\ansicpg(\d+)", source)
    page, fallbacks, left = _code_page(page[1] if page else None), 1, 0
    out, held = [], bytearray()

    def flush() -> None:
        out.append(held.decode(page, "replace"))
        held.clear()

    for m in _RTF.finditer(source):
        kind, said = m.lastgroup, m[m.lastgroup] if m.lastgroup else ""
        if kind == "unit":
            flush()
            out.append(chr(int(said) % 65536))
            left = fallbacks
        elif kind == "count":
            fallbacks = int(said)
        elif kind == "byte":
            if left:
                left -= 1
            else:
                held.append(int(said, 16))
        elif kind == "text":
            held += said[left:].encode("latin-1")
            left = max(0, left - len(said))
        elif kind in ("line", "sign"):
            held += b"\n" if kind == "line" else said.encode()
            left = 0
    flush()
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def read_office(spark: SparkSession, folder: str) -> DataFrame:
    """(path, markdown, problem) of the .docx and .rtf files below a folder; a file that can't be read has a problem."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data in zip(part["path"], part["content"], strict=True):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    body = docx_markdown(data) if path.lower().endswith(".docx") else rtf_text(data)
                    rows.append((path, f"# {stem}\n\n{body}", None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    rows.append((path, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "markdown", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,rtf,DOCX,RTF}").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, markdown string, problem string")


def converted(spark: SparkSession, folder: str) -> DataFrame:
    """(source, markdown, problem) of all files of a folder: text and markdown as they are, office files converted, and
    a problem for what is neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    plain = files.where(kind.isin("txt", "md")).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("markdown"))
    plain = plain.withColumn("problem", F.when(F.col("markdown").isNull(), "UnicodeDecodeError"))
    other = files.where(~kind.isin("txt", "md", "docx", "rtf")).select("path", F.lit(None).cast("string").alias("markdown"), F.concat(F.lit("unsupported: "), kind).alias("problem"))
    rows = plain.unionByName(read_office(spark, folder)).unionByName(other)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("source"), "markdown", "problem")
