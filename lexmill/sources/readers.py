"""Readers of documents: engines by name, their order by file size, and fallback from one to the next."""

from __future__ import annotations

import importlib.util
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from lexmill.sources import pdf

ENGINES = ("pymupdf", "unstructured", "pdfminer", "azure_document_intelligence")
SMALL, LARGE = 1_000_000, 10_000_000
PAGE_SIZE = (612.0, 792.0)


@dataclass(frozen=True)
class ReaderConfig:
    """endpoint and key of a service that recognises text; ocr_fallback tells whether it may be tried after others."""

    endpoint: str | None = None
    key: str | None = None
    ocr_fallback: bool = True


#: What an engine tells of a file beside its pages' texts.
METADATA = "page_count int, processor string, title string, author string, creation_date string, confidence double, element_count int, element_types array<string>"
#: An engine takes a file's bytes and gives its pages' texts, or those and metadata by name, or raises.
Engine = Callable[[bytes], "list[str] | tuple[list[str], dict]"]


class _Visible(HTMLParser):
    _HIDDEN = frozenset(("script", "style", "head", "noscript", "template"))
    _BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav body html title pre".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self._HIDDEN
        if tag in self._BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self._HIDDEN and self.hidden > 0
        if tag in self._BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    """Visible text of a page, a line for each block element."""
    if html is None:
        return None
    parser = _Visible()
    parser.feed(html)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


class _Elements(_Visible):
    """Block elements with their types; what stands in several belongs to the innermost."""

    _TYPES = {"title": "Title", "li": "ListItem", "table": "Table", "tr": "Table", "td": "Table", "th": "Table", "header": "Header", "footer": "Footer", **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "Title")}  # noqa: RUF012

    def __init__(self):
        super().__init__()
        self.open: list[str] = []
        self.found: list[tuple[str, str]] = []

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.found.append((next((self._TYPES[t] for t in reversed(self.open) if t in self._TYPES), "NarrativeText"), text))

    def handle_starttag(self, tag, attrs):
        if tag in ("td", "th"):
            self.parts.append(" ")
        if tag in self._BLOCK:
            self._flush()
            if tag not in ("br", "hr"):
                self.open.append(tag)
        self.hidden += tag in self._HIDDEN

    def handle_endtag(self, tag):
        if tag in self._BLOCK:
            self._flush()
            if tag in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        self.hidden -= tag in self._HIDDEN and self.hidden > 0


def html_elements(html: str | None) -> list[tuple[str, str]]:
    """(type, text) of a page's visible block elements: Title, ListItem, Table, Header, Footer or NarrativeText."""
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.found


def elements(html: Column) -> Column:
    """array<struct<type, text>>; see html_elements."""

    @F.arrow_udf("array<struct<type:string,text:string>>")
    def run(pages: pa.Array) -> pa.Array:
        rows = [None if p is None else [{"type": k, "text": t} for k, t in html_elements(p)] for p in pages.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())])))

    return run(html)


def visible_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([html_text(p) for p in pages.to_pylist()], pa.string())

    return run(html)


def _plain(data: bytes) -> tuple[list[str], dict]:
    """Plain text, whose pages form feeds divide, and HTML, with its types of elements."""
    text = data.decode("utf-8")
    if "\x00" in text or text.startswith("%PDF-"):
        raise ValueError("not a text")
    if text.lstrip()[:15].lower().startswith(("<!doctype html", "<html")):
        found = html_elements(text)
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
        return [html_text(text)], {"element_count": len(found), "element_types": sorted({k for k, _ in found}), "title": unescape(" ".join(title[1].split())) if title else None}
    pages = text.split("\f")
    return pages, {"element_count": sum(bool(p.strip()) for page in pages for p in page.split("\n\n")), "element_types": ["NarrativeText"]}


def _pdf(data: bytes) -> tuple[list[str], dict]:
    about, pages = pdf.read(data)
    return ["\n\n".join(text for _, text in p.blocks) for p in pages], about


def _mupdf(data: bytes) -> tuple[list[str], dict]:
    import pymupdf

    with pymupdf.open(stream=data) as doc:
        about = {"title": doc.metadata.get("title"), "author": doc.metadata.get("author"), "creation_date": doc.metadata.get("creationDate")}
        return [page.get_text() for page in doc], about


def _pdfminer(data: bytes) -> list[str]:
    import io

    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(data)).split("\f")


def recognise(data: bytes, config: ReaderConfig, model: str = "prebuilt-layout", version: str = "2024-11-30", wait: float = 1.0, patience: float = 300.0) -> dict:
    """What a text recognition service finds in a file: sent to config.endpoint, then asked for until it is done."""
    headers = {"Ocp-Apim-Subscription-Key": config.key, "Content-Type": "application/octet-stream"}
    url = f"{config.endpoint.rstrip('/')}/documentintelligence/documentModels/{model}:analyze?api-version={version}"
    with urlopen(Request(url, data, headers), timeout=60) as answer:
        place = answer.headers["Operation-Location"]
    ends = time.monotonic() + patience
    while True:
        with urlopen(Request(place, headers=headers), timeout=60) as answer:
            state = json.load(answer)
        if state["status"] == "succeeded":
            return state["analyzeResult"]
        if state["status"] == "failed" or time.monotonic() > ends:
            raise ValueError(f"recognition {state['status']}: {state.get('error', '')}")
        time.sleep(wait)


def _remote(config: ReaderConfig) -> Engine:
    def run(data: bytes) -> tuple[list[str], dict]:
        pages = recognise(data, config)["pages"]
        sure = [w["confidence"] for p in pages for w in p.get("words", ()) if "confidence" in w]
        return ["\n".join(x["content"] for x in p.get("lines", ())) for p in pages], {"confidence": sum(sure) / len(sure) if sure else None}

    return run


def recognised_lines(files: DataFrame, config: ReaderConfig) -> DataFrame:
    """(doc_id, page, line_idx, text, polygon, height, confidence, error) of files (path, content), for ocr_blocks and ocr_documents.

    A file that can't be recognised has one row, which says why.
    """
    schema = "doc_id string, page int, line_idx int, text string, polygon array<struct<x:double,y:double>>, height double, confidence double, error string"
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    for p in recognise(data or b"", config)["pages"]:
                        sure = [w["confidence"] for w in p.get("words", ()) if "confidence" in w]
                        for n, x in enumerate(p.get("lines", ())):
                            flat = x.get("polygon") or []
                            points = [{"x": float(a), "y": float(b)} for a, b in zip(flat[::2], flat[1::2], strict=True)]
                            rows.append({"doc_id": path, "page": p["pageNumber"], "line_idx": n, "text": x["content"], "polygon": points, "height": p.get("height"), "confidence": sum(sure) / len(sure) if sure else None})
                except (OSError, ValueError, KeyError) as problem:
                    rows.append({"doc_id": path, "error": str(problem)})
            yield pa.RecordBatch.from_pylist(rows, kind)

    return files.select("path", "content").mapInArrow(run, schema)


def available(config: ReaderConfig | None = None) -> dict[str, Engine]:
    """The engines that can be used here, in no order.

    Plain text and HTML need no library and serve as the multi-format engine; for PDF
    files a parser of this package stands in where the library can't be imported. The
    recognition service is there if config has its endpoint and key.
    """
    out: dict[str, Engine] = {"unstructured": _plain, "pymupdf": _mupdf if importlib.util.find_spec("pymupdf") else _pdf}
    if importlib.util.find_spec("pdfminer"):
        out["pdfminer"] = _pdfminer
    if config and config.endpoint and config.key and config.ocr_fallback:
        out["azure_document_intelligence"] = _remote(config)
    return out


def engine_order(length: Column) -> Column:
    """Engines in the order in which they are tried, by file size."""
    names = lambda *x: F.array(*map(F.lit, x))
    small = names("pymupdf", "unstructured", "pdfminer")
    large = names("azure_document_intelligence", "unstructured", "pymupdf")
    return F.when(length < SMALL, small).when(length > LARGE, large).otherwise(names(*ENGINES))


def extract(files: DataFrame, engines: dict[str, Engine] | None = None, preferred: str | None = None, fallback: bool = True, config: ReaderConfig | None = None) -> DataFrame:
    """(path, page_texts, engine, error, metadata) from files (path, length, content).

    The preferred engine, then those by size are tried; the first that doesn't raise wins.
    Engines that aren't registered are passed over. Where all fail, error says so; without
    fallback it is the first one's.
    """
    engines = available(config) if engines is None else engines
    ordered = files.select("path", "content", engine_order(F.col("length")).alias("order"))
    schema = f"path string, page_texts array<string>, engine string, error string, metadata struct<{METADATA.replace(' ', ':').replace(',:', ',')}>"
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data, order in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "order")), strict=True):
                pages, about, used, error = None, {}, None, None
                for name in dict.fromkeys([preferred, *order] if preferred else order):
                    if name not in engines:
                        continue
                    try:
                        pages, used, error = engines[name](data or b""), name, None
                        pages, about = pages if isinstance(pages, tuple) else (pages, {})
                        break
                    except Exception as problem:  # an engine may fail in any way; the next one is tried
                        error = f"{name}: {problem}"
                        if not fallback:
                            break
                if pages is None:
                    rows.append({"path": path, "error": error if not fallback else f"All processors failed; {error}"})
                else:
                    rows.append({"path": path, "page_texts": pages, "engine": used, "metadata": about | {"page_count": len(pages), "processor": used}})
            yield pa.RecordBatch.from_pylist(rows, kind)

    return ordered.mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """Documents of a folder, in one piece each: text with a line that numbers each page, page_texts, engine, error, metadata."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    out = extract(files, **options)
    numbered = F.transform("page_texts", lambda t, i: F.concat(F.lit("\n--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), t))
    return out.withColumn("text", F.concat_ws("", numbered))


def pdf_documents(files: DataFrame) -> DataFrame:
    """Documents in blocks from PDF files (path, content): sizes, metadata, and blocks with their places from the top left corner.

    A file that can't be read has an error and no blocks. height and width are the first page's.
    """
    block = "page:int,bbox:array<double>,height:double,text:string"
    schema = f"path string, filename string, filename_without_ext string, processor string, extension string, pages int, title string, author string, creation_date string, height double, width double, blocks array<struct<{block}>>, error string"
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                stem, dot, ending = name.rpartition(".")
                row = {"path": path, "filename": name, "filename_without_ext": stem if dot else name, "processor": "pymupdf", "extension": dot + ending if dot else ""}
                try:
                    about, pages = pdf.read(data or b"")
                    found = [{"page": n, "bbox": box, "height": p.height, "text": text} for n, p in enumerate(pages, 1) for box, text in p.blocks]
                    row |= about | {"pages": len(pages), "height": pages[0].height, "width": pages[0].width, "blocks": found}
                except ValueError as problem:
                    row["error"] = str(problem)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, kind)

    return files.select("path", "content").mapInArrow(run, schema)


def read_pdf_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, block_idx, page, bbox, height, text) of the PDF files of a folder, doc_id being the path."""
    docs = pdf_documents(spark.read.format("binaryFile").load(path))
    rows = docs.select(F.col("path").alias("doc_id"), F.posexplode("blocks").alias("block_idx", "b"))
    return rows.select("doc_id", "block_idx", "b.page", "b.bbox", "b.height", "b.text")


def blocks_from_pages(docs: DataFrame, key: str = "path") -> DataFrame:
    """(doc_id, block_idx, page, bbox, height, text): a block for each paragraph of page_texts, without a place on the page."""
    rows = docs.select(F.col(key).alias("doc_id"), F.posexplode("page_texts").alias("page", "body"))
    rows = rows.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", "\n\n")).alias("n", "text")).where("trim(text) <> ''")
    order = Window.partitionBy("doc_id").orderBy("page", "n")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("block_idx"), "page", F.array(*(F.lit(x) for x in (0.0, 100.0, 0.0, 100.0))).alias("bbox"), F.lit(PAGE_SIZE[1]).alias("height"), "text")


def polygon_bbox(polygon: Column) -> Column:
    """[x0, y0, x1, y1] of an array of (x, y); zeros for none."""
    x, y = F.transform(polygon, lambda p: p["x"].cast("double")), F.transform(polygon, lambda p: p["y"].cast("double"))
    box = F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))
    return F.when(F.coalesce(F.size(polygon), F.lit(0)) > 0, box).otherwise(F.array(*(F.lit(0.0),) * 4))


def ocr_blocks(lines: DataFrame) -> DataFrame:
    """Blocks from recognised lines (doc_id, page, line_idx, text, polygon, height): a block each, numbered through the document."""
    order = Window.partitionBy("doc_id").orderBy("page", "line_idx")
    height = F.coalesce(F.first("height", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(PAGE_SIZE[1]))
    return lines.select("doc_id", (F.row_number().over(order) - 1).alias("block_idx"), "page", polygon_bbox(F.col("polygon")).alias("bbox"), height.alias("height"), "text")


def ocr_documents(lines: DataFrame) -> DataFrame:
    """(doc_id, text, page_texts, confidence_scores) from recognised lines (doc_id, page, line_idx, text, confidence)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"])
    pages = lines.groupBy("doc_id", "page").agg(F.concat_ws("\n", ordered).alias("text"), F.avg("confidence").alias("confidence"))
    sorted_ = F.array_sort(F.collect_list(F.struct("page", "text", "confidence")))
    rows = pages.groupBy("doc_id").agg(sorted_.alias("p"))
    texts = F.transform("p", lambda s: s["text"])
    return rows.select("doc_id", F.concat_ws("\n", texts).alias("text"), texts.alias("page_texts"), F.transform("p", lambda s: s["confidence"]).alias("confidence_scores"))


def ocr_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, tables) from recognised cells (doc_id, table_idx, row, column, content)."""
    order = F.array_sort(F.collect_list(F.struct("row", "column", "content")))
    tables = cells.groupBy("doc_id", "table_idx").agg(order.alias("cells"))
    return tables.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "cells"))), lambda t: t["cells"]).alias("tables"))
