"""Texts of documents: markup of word-processor files, tables, binary files; requirements that texts state."""

from __future__ import annotations

import io
import lzma
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that tell text from binary, and the share of control bytes of the latter.
HEAD, CONTROL = 8192, 0.1
#: Bytes of one packed part of a file that are taken at most: more is an error, not a cut.
PART = 256 << 20
PACKED = ("docx", "xlsx")
#: Bytes of a file that is taken whole; larger ones have an error.
MOST = 512 << 20
#: Byte-order marks and their encodings; bytes that are no control bytes.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
TEXT_BYTES = bytes([9, 10, 11, 12, 13, *range(32, 256)])
#: What a damaged, encrypted or strangely packed archive raises.
BROKEN = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, ElementTree.ParseError, ValueError, KeyError, IndexError, RuntimeError, NotImplementedError, EOFError, OSError)
CELLS = "path string, sheet string, row int, column int, value string"
READ = "path string, kind string, text string, error string"


def entities(c: Column) -> Column:
    """Named and numeric entities decoded; the ampersand last."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    pieces = F.split(c, "&#", -1)

    def decoded(p: Column) -> Column:
        hexa, deci = F.regexp_extract(p, "^[xX]([0-9a-fA-F]{1,6});", 1), F.regexp_extract(p, "^([0-9]{1,7});", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).cast("int")
        rest = F.regexp_replace(p, "^[xX]?[0-9a-fA-F]+;", "")
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.between(1, 0x10FFFF), F.concat(sign, rest)).otherwise(F.concat(F.lit("&#"), p))

    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.replace(F.concat(pieces[0], F.array_join(tail, "")), F.lit("&amp;"), F.lit("&"))


def strip_markup(xml: Column) -> Column:
    """Paragraphs as lines, tabs, no tags, at most one empty line in a row."""
    c = F.regexp_replace(F.regexp_replace(xml, "</w:p>", "\n"), "<w:tab/>", "\t")
    return F.trim(F.regexp_replace(entities(F.regexp_replace(c, "<[^>]+>", "")), "\n{3,}", "\n\n"))


def is_binary(head: Column) -> Column:
    """Whether the first bytes of a file, as text of Latin-1, are not those of a text."""
    control = F.length(F.regexp_replace(head, r"[^\x01-\x08\x0e-\x1f]", ""))
    return F.contains(head, F.lit("\0")) | (control >= CONTROL * F.length(head)) & (F.length(head) > 0)


def decoded(content: bytes, fallback: str) -> str:
    """Text by its byte-order mark, as UTF-8 if it is that, or else in the code page ``fallback``; unmapped bytes are marked."""
    for mark, page in MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(page, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode(fallback, "replace")


def looks_binary(content: bytes) -> bool:
    """The rule of :func:`is_binary` on bytes; files with a byte-order mark are text."""
    head = content[:HEAD]
    if any(head.startswith(mark) for mark, _ in MARKS):
        return False
    return b"\0" in head or bool(head) and len(head.translate(None, TEXT_BYTES)) >= CONTROL * len(head)


def _part(packed: zipfile.ZipFile, name: str) -> bytes:
    if packed.getinfo(name).file_size > PART:
        raise ValueError(f"{name} is larger than {PART} bytes")
    return packed.read(name)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _said(node: ElementTree.Element) -> str:
    """The text of a rich string, without its phonetic reading."""
    if _local(node.tag) == "rPh":
        return ""
    return (node.text or "" if _local(node.tag) == "t" else "") + "".join(map(_said, node))


def workbook_cells(packed: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of the filled cells of a workbook, from 1; shared and inline strings are resolved."""
    names = packed.namelist()
    shared = [_said(si) for si in ElementTree.fromstring(_part(packed, "xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = {}
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(_part(packed, "xl/_rels/workbook.xml.rels"))}
        for node in ElementTree.fromstring(_part(packed, "xl/workbook.xml")).iter():
            if _local(node.tag) == "sheet":
                key = next((v for k, v in node.attrib.items() if _local(k) == "id"), None)
                target = targets.get(key, "")
                titles[target.lstrip("/") if target.startswith("/") else f"xl/{target}"] = node.get("name", "")
    if shared and not any(n.startswith("xl/worksheets/") for n in names):  # strings without a sheet: a column of them
        yield from (("", row, 1, value) for row, value in enumerate(shared, 1))
    sheets = [n for n in titles if n in names] or sorted(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml"))
    for name in sheets:
        title, at_row = titles.get(name, name.rpartition("/")[2].removesuffix(".xml")), 0
        for row in ElementTree.fromstring(_part(packed, name)).iter():
            if _local(row.tag) != "row":
                continue
            at_row, at_column = int(row.get("r") or at_row + 1), 0
            for c in row:
                letters = re.match("[A-Z]*", c.get("r") or "").group()
                at_column = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) or at_column + 1
                inside = {_local(x.tag): x for x in c}
                value = inside["v"].text or "" if "v" in inside else ""
                kind = c.get("t")
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "inlineStr" and "is" in inside:
                    value = _said(inside["is"])
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                if value != "":
                    yield title, at_row, at_column, value


def _files(spark: SparkSession, path: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Files up to ``most`` bytes with their content, and the larger ones, whose content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind")
    return files.where(F.col("length") <= most).select("path", kind, "content"), files.where(F.col("length") > most).select("path", kind)


def _rows(path: str, kind: str, content: bytes, fallback: str) -> tuple[str | None, str | None]:
    """The markup or text of a file, or why there is none."""
    try:
        if kind in PACKED:
            with zipfile.ZipFile(io.BytesIO(content)) as packed:
                if kind == "docx":
                    return _part(packed, "word/document.xml").decode("utf-8", "replace"), None
                lines: dict[tuple[str, int], list[str]] = {}
                for sheet, row, _, value in workbook_cells(packed):
                    lines.setdefault((sheet, row), []).append(value)
                return "\n".join("\t".join(v) for v in lines.values()), None
        if looks_binary(content):
            return None, "binary"
        return decoded(content, fallback), None
    except BROKEN as e:
        return None, f"{type(e).__name__}: {e}"


def read(spark: SparkSession, path: str, fallback: str = "windows-1251", most: int = MOST) -> DataFrame:
    """(path, kind, text, error) of the files of a folder, one row each; a file that cannot be read has an error, not the job.

    Word-processor files give their paragraphs, workbooks a line a row with cells a tab apart, drawings (svg) their texts, others
    their text as :func:`decoded`. Archives that are broken, encrypted or packed by a method that is not
    here, parts and files beyond their bound, and binary files have an error. Empty files have no row: the file source passes over them.
    """
    files, large = _files(spark, path, most)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, content in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "content"))):
                text, error = _rows(path, kind, content, fallback)
                yield pa.RecordBatch.from_pydict({"path": [path], "kind": [kind], "text": pa.array([text], pa.string()), "error": pa.array([error], pa.string())})

    found = files.mapInArrow(texts, READ)
    marked = F.col("kind").isin("docx", "svg")
    found = found.withColumn("text", F.when(marked, strip_markup(F.col("text"))).otherwise(F.col("text")))
    return found.unionByName(large.select("path", "kind", F.lit(None).cast("string").alias("text"), F.lit(f"larger than {most} bytes").alias("error")))


def cells(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """(path, sheet, row, column, value) of the filled cells of the workbooks of a folder; unreadable ones give none (see :func:`read`)."""
    files, _ = _files(spark, path, most)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as packed:
                        rows = list(workbook_cells(packed))
                except BROKEN:
                    continue
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())],
                    ["path", "sheet", "row", "column", "value"],
                )

    return files.where(F.col("kind") == "xlsx").mapInArrow(found, CELLS)


def requirements(text: Column) -> Column:
    """What a text states: dimensions (a x b, a x b x c), fire classes (EI 60), diameters (DN 50, 20 mm after a sign)."""
    found = [
        ("dims", r"[0-9]+(?:[.,][0-9]+)?(?:\s?[x×х*]\s?[0-9]+(?:[.,][0-9]+)?){1,2}"),
        ("fire", r"\b(?:REI|EI|RE|R|E)\s?[0-9]{2,3}\b"),
        ("diameter", r"(?:DN|Ø|⌀)\s?[0-9]+"),
    ]
    return F.struct(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(n) for n, p in found))


def stations(json: Column) -> Column:
    """Scanner stations of a JSON text: an array of them, or an object that holds one; empty otherwise."""
    one = "struct<name:string,x:double,y:double,z:double>"
    plain = F.from_json(json, f"array<{one}>")
    held = F.from_json(json, f"struct<stations:array<{one}>>")["stations"]
    return F.coalesce(F.when(F.trim(json).startswith("["), plain).otherwise(held), F.array().cast(f"array<{one}>"))
