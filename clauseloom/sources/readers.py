"""Document readers over Spark's binaryFile source: sniffing in Columns, formats by small helpers.

Each helper turns one file's bytes into text in the engine's line protocol (``[row n] a | b``,
``[table]`` … ``[/table]``, ``### SHEET: name``).  A file that cannot be read becomes an error
row, never an exception.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "docx", "xlsx", "pptx", "html", "htm", "txt", "csv", "eml", "rtf", "msg", "doc", "xls", "ppt", "jpg", "jpeg", "png")
SCHEMA = "path string, name string, kind string, text string, error string, part int, parent string"
MAX_CHARS, MAX_PARTS, MAX_DEPTH, BODY_CHARS = 4_000_000, 12, 3, 400


def sniff(content: Column, suffix: Column) -> Column:
    """The kind of a file by its first bytes, else by its suffix."""
    head = F.hex(F.substring(content, 1, 4))
    office = F.when(suffix.isin("docx", "xlsx", "pptx"), suffix).otherwise("docx")
    return (
        F.when(head == "25504446", "pdf").when(head == "504B0304", office)
        .when(head == "D0CF11E0", F.when(suffix.isin("doc", "xls", "ppt", "msg"), suffix).otherwise("doc"))
        .when(F.substring(head, 1, 6) == "FFD8FF", F.when(suffix.isin("jpg", "jpeg"), suffix).otherwise("png"))
        .when(head == "89504E47", F.lit("png")).otherwise(suffix)
    )


def table_row(number: int, cells: list[str]) -> str:
    """``[row n]`` and the cells that are not blank."""
    return f"[row {number}] " + " | ".join(" ".join(c.split()) for c in cells if c and c.strip())


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = [""]
        self.tables: list[list[list[str]]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "article", "nav", "body"):
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.tables:
            rows = [r for r in self.tables.pop() if any(c.strip() for c in r)]
            if self.tables and self.tables[-1] and self.tables[-1][-1]:  # nested: layout
                self.tables[-1][-1][-1] += " " + " ".join(c for r in rows for c in r)
            elif len(rows) >= 2:
                self.lines += ["[table]", *(table_row(i, r) for i, r in enumerate(rows, 1)), "[/table]", ""]
            else:
                self.lines += [" ".join(c for r in rows for c in r), ""]
        elif tag in ("p", "div", "li", "h1", "h2", "h3"):
            self.lines.append("")

    def handle_data(self, data):
        if self.hidden:
            return
        if self.tables and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1] += data
        else:
            self.lines[-1] += data


def html_text(raw: str) -> str:
    p = _Html()
    p.feed(raw)
    p.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in p.lines) if x)


def read_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def read_html(raw: bytes) -> str:
    return html_text(read_text(raw))


def read_rtf(raw: bytes) -> str:
    return re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", read_text(raw))


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def read_docx(raw: bytes) -> str:
    """Paragraphs and tables in document order; content controls are entered, contents lists skipped."""
    out: list[str] = []

    def walk(parent):
        for e in parent:
            kind = _local(e)
            if kind == "p":
                style = next((x for x in e.iter() if _local(x) == "pStyle"), None)
                if style is None or not any(v.upper().startswith("TOC") for v in style.attrib.values()):
                    out.extend([_texts(e), ""])
            elif kind == "tbl":
                rows = [[_texts(c) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
                out.extend(["[table]", *(table_row(i, r) for i, r in enumerate(rows, 1)), "[/table]", ""])
            elif kind in ("sdt", "sdtContent"):
                walk(e)

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        walk(_xml(z, "word/document.xml")[0])
    return "\n".join(out)


def read_xlsx(raw: bytes) -> str:
    """Every sheet, rows by their own numbers."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = [_texts(x) for x in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        titles = [x.attrib.get("name", "") for x in _xml(z, "xl/workbook.xml").iter() if _local(x) == "sheet"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for k, name in enumerate(sheets):
            out.append(f"### SHEET: {titles[k] if k < len(titles) else name}")
            for n, row in enumerate((x for x in _xml(z, name).iter() if _local(x) == "row"), 1):
                cells = []
                for c in row:
                    value = next((x.text or "" for x in c if _local(x) == "v"), "")
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value or _texts(c))
                if any(v.strip() for v in cells):
                    out.append(table_row(int(row.attrib.get("r", n)), cells))
    return "\n".join(out)


def read_pptx(raw: bytes) -> str:
    """Slides in order, shapes by (top, left), then the notes."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for k, name in enumerate(slides, 1):
            out.append(f"### SLIDE {k}")
            shapes = []
            for s in (x for x in _xml(z, name).iter() if _local(x) in ("sp", "graphicFrame")):
                off = next((x for x in s.iter() if _local(x) == "off"), None)
                at = (int(off.attrib.get("y", 0)), int(off.attrib.get("x", 0))) if off is not None else (0, 0)
                rows = [[_texts(c) for c in r if _local(c) == "tc"] for r in s.iter() if _local(r) == "tr"]
                text = ["[table]", *(table_row(i, r) for i, r in enumerate(rows, 1)), "[/table]"] if rows else [_texts(p) for p in s.iter() if _local(p) == "p"]
                shapes.append((at, text))
            out += [line for _, text in sorted(shapes, key=lambda x: x[0]) for line in text if line.strip()]
            notes = f"ppt/notesSlides/notesSlide{k}.xml"
            if notes in names:
                out.append("Notes: " + _texts(_xml(z, notes)))
    return "\n".join(out)


def read_eml(raw: bytes) -> str:
    """Header lines and the plain body, or the HTML body if there is none or it holds a table."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    plain, page = m.get_body(("plain",)), m.get_body(("html",))
    rich = html_text(page.get_content()) if page is not None else ""
    body = plain.get_content() if plain is not None and "[table]" not in rich else rich
    return "\n".join([f"Subject: {m['subject'] or ''}", f"From: {m['from'] or ''}", f"Date: {m['date'] or ''}", "", body])


def parts_of(kind: str, raw: bytes) -> list[tuple[str, bytes]]:
    """Attachments of a mail, or documents embedded in an office file (the first twelve)."""
    if kind == "eml":
        m = email.message_from_bytes(raw, policy=email.policy.default)
        return [(a.get_filename() or "part", a.get_payload(decode=True) or b"") for a in m.iter_attachments()]
    if kind in ("docx", "xlsx", "pptx"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return [(n, z.read(n)) for n in z.namelist() if "/embeddings/" in n][:MAX_PARTS]
    return []


READERS: dict[str, Callable[[bytes], str]] = {
    "txt": read_text, "csv": read_text, "html": read_html, "htm": read_html, "rtf": read_rtf, "docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx, "eml": read_eml,
}


def _kind(name: str, raw: bytes) -> str:
    suffix = name.rpartition(".")[2].lower()
    if raw[:4] == b"PK\x03\x04":
        return suffix if suffix in ("docx", "xlsx", "pptx") else "docx"
    return "pdf" if raw[:4] == b"%PDF" else suffix


def _read(path: str, name: str, kind: str, raw: bytes, depth: int, parent: str | None) -> Iterator[tuple]:
    text, error = "", None
    try:
        if not raw:
            error = "the file is empty"
        elif kind not in READERS:
            error = f"no reader for {kind}"
        else:
            text = READERS[kind](raw)[:MAX_CHARS]
    except Exception as e:  # noqa: BLE001  the reason is the row's result
        error = f"could not be read: {type(e).__name__}"
    yield path, name, kind, text, error, depth, parent
    if error is None and depth < MAX_DEPTH:
        for child, content in parts_of(kind, raw):
            yield from _read(path, child, _kind(child, content), content, depth + 1, name)


#: Only files of known kinds are opened; names that begin with a dot or ~$ are left out by the source or below.
WANTED = "*.{" + ",".join(v for s in SUFFIXES for v in (s, s.upper())) + "}"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file in ``folder`` and each document inside it (SCHEMA)."""
    return read_contents(spark.read.format("binaryFile").option("pathGlobFilter", WANTED).load(folder))


def read_contents(files: DataFrame) -> DataFrame:
    """The same for rows (path, content) of files, of a table or a stream."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    wanted = files.select("path", name.alias("name"), suffix.alias("suffix"), "content").where(~F.col("name").rlike(r"^(\.|~\$)") & F.col("suffix").isin(*SUFFIXES))
    typed = wanted.select("path", "name", sniff(F.col("content"), F.col("suffix")).alias("kind"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in zip(pdf["path"], pdf["name"], pdf["kind"], pdf["content"], strict=True):
                yield pd.DataFrame(list(_read(*row[:3], bytes(row[3]), 0, None)), columns=["path", "name", "kind", "text", "error", "part", "parent"])

    return typed.mapInPandas(run, SCHEMA)


def mail_documents(rows: DataFrame) -> DataFrame:
    """Drop a mail's own text if it is short and something was attached: the note is no document."""
    attached = rows.where("part > 0").groupBy("path").agg(F.count("*").alias("children"))
    body = F.length("text") >= BODY_CHARS
    return rows.join(attached, "path", "left").where((F.col("kind") != "eml") | (F.col("part") > 0) | body | F.col("children").isNull()).drop("children")


def page_lines(pages: DataFrame) -> DataFrame:
    """Rows (page_id, text) of raw pages (page_id, html)."""

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: html_text(x or ""))

    return pages.select("page_id", text("html").alias("text"))
