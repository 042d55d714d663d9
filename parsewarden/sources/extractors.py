"""Parser libraries as extractor plug-ins: each file becomes one row of nested raw tables, which the adapters select from.

Libraries are imported by the worker that needs one, so none is needed to plan a job, and a missing or failing library
fails its files and not the job. A file is written to a temporary file of the worker, as the libraries want a path.
``extract`` gives the rows; store them (``sinks.write_table``) before ``raw_tables``, as each raw table is a pass over them.
"""

from __future__ import annotations

import importlib
import json
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parsewarden.schema import BBOX, IMAGES, ROWS
from parsewarden.sources import adapters

PROVENANCE = f"array<struct<page_no:int,bbox:{BBOX}>>"
HEAD = "source_file string, success boolean, error string, warnings array<string>, processing_time_seconds double"
PLUMBER_PAGE = f"page_number:int,text:string,plain_text:string,width:double,height:double,char_objects:int,images:{IMAGES},lines:int,rects:int,curves:int"
PDF_TABLE = f"page_number:int,table_index:int,rows:{ROWS},bbox:{BBOX}"
#: Columns that each parser adds to HEAD: those of the file, and its raw tables as arrays.
COLUMNS = {
    "pdfplumber": f"pdf_metadata map<string,string>, pages array<struct<{PLUMBER_PAGE}>>, words array<struct<word_index:int,page_number:int,text:string,x0:double,top:double,x1:double,bottom:double>>, chars array<struct<page_number:int,text:string,fontname:string,size:double,x0:double,top:double>>, tables array<struct<{PDF_TABLE}>>",
    "pymupdf": f"pdf_metadata map<string,string>, pages array<struct<page_number:int,text:string,width:double,height:double,image_count:int>>, blocks array<struct<page_number:int,block_index:int,fields:array<string>>>, tables array<struct<{PDF_TABLE}>>",
    "docling": f"document_name string, conversion_status string, text string, markdown string, json string, pages array<struct<page_number:int,text:string,markdown:string>>, items array<struct<item_index:int,label:string,text:string,level:int,provenance:{PROVENANCE}>>, tables array<struct<table_index:int,header:array<string>,rows:{ROWS},provenance:{PROVENANCE},html:string,markdown:string>>",
    "unstructured": "strategy string, languages array<string>, raw array<struct<element_index:int,class_name:string,text:string,page_number:int,points:array<array<double>>,text_as_html:string,metadata:map<string,string>>>",
}
ADAPTERS = {
    "pdfplumber": lambda files, raw: adapters.adapt_pdfplumber(files, raw["pages"], raw["words"], raw["tables"]),
    "pymupdf": lambda files, raw: adapters.adapt_pymupdf(files, raw["pages"], raw["blocks"], raw["tables"]),
    "docling": lambda files, raw: adapters.adapt_docling(files, raw["pages"], raw["items"], raw["tables"]),
    "unstructured": lambda files, raw: adapters.adapt_unstructured(files, raw["raw"]),
}


def plain(value: object) -> object:
    """A library's value as plain data: by its own conversion if it has one, else as it is, else as a string."""
    for method, arguments in (("model_dump", {"mode": "json"}), ("to_dict", {})):
        if hasattr(value, method):
            return getattr(value, method)(**arguments)
    return value if value is None or isinstance(value, (str, int, float, bool, list, dict)) else str(value)


def label_text(label: object) -> str:
    """A label, or the value of one that is an enumeration's."""
    return str(getattr(label, "value", label))


def strings(values: dict | None) -> list[tuple[str, str | None]]:
    own = {str(k): plain(v) for k, v in (values or {}).items()}
    return [(k, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)) for k, v in own.items()]


def number(value: object) -> float | None:
    return None if value is None else float(value)


def box(values: object) -> list[float] | None:
    return None if values is None else [float(v) for v in values]


def cells(rows: object) -> list[list[str | None]]:
    return [[None if c is None else str(c) for c in r] for r in rows or ()]


def tried(warnings: list[str], what: str, make: Callable[[], object], otherwise: object = None) -> object:
    """What make gives; a failure is a warning."""
    try:
        return make()
    except Exception as e:
        warnings.append(f"{what} failed: {e}")
        return otherwise


def by_pdfplumber(path: str, warnings: list[str]) -> dict:
    pages, words, chars, tables = [], [], [], []
    with importlib.import_module("pdfplumber").open(path) as pdf:
        info = strings(pdf.metadata)
        for n, page in enumerate(pdf.pages, 1):
            images = [{k: number(i.get(k)) for k in ("x0", "x1", "top", "bottom")} for i in page.images]
            one_glyph = page.dedupe_chars()
            pages.append({
                "page_number": n, "text": page.extract_text(layout=True) or "", "plain_text": one_glyph.extract_text() or "", "width": float(page.width), "height": float(page.height),
                "char_objects": len(page.chars), "images": images, "lines": len(page.lines), "rects": len(page.rects), "curves": len(page.curves),
            })
            for w in page.extract_words() or ():
                words.append({"word_index": len(words), "page_number": n, "text": str(w.get("text", "")), **{k: float(w[k]) for k in ("x0", "top", "x1", "bottom")}})
            chars += [{"page_number": n, "text": c.get("text"), "fontname": c.get("fontname"), **{k: number(c.get(k)) for k in ("size", "x0", "top")}} for c in page.chars]
            found = tried(warnings, f"Page {n}: table extraction", lambda page=page: [(cells(t.extract()), box(getattr(t, "bbox", None))) for t in page.find_tables()], [])
            tables += [{"page_number": n, "table_index": k, "rows": rows, "bbox": b} for k, (rows, b) in enumerate(found)]
    return {"pdf_metadata": info, "pages": pages, "words": words, "chars": chars, "tables": tables}


def by_pymupdf(path: str, warnings: list[str]) -> dict:
    pages, blocks, tables = [], [], []
    with importlib.import_module("pymupdf").open(path) as pdf:
        info = strings(pdf.metadata)
        for n, page in enumerate(pdf, 1):
            pages.append({"page_number": n, "text": page.get_text("text", sort=True) or "", "width": float(page.rect.width), "height": float(page.rect.height), "image_count": len(page.get_images(full=True))})
            for b in page.get_text("blocks", sort=True):
                blocks.append({"page_number": n, "block_index": len(blocks), "fields": [None if x is None else str(x) for x in b]})
            found = tried(warnings, f"Page {n}: table extraction", lambda page=page: [(cells(t.extract()), box(getattr(t, "bbox", None))) for t in page.find_tables().tables], [])
            tables += [{"page_number": n, "table_index": k, "rows": rows, "bbox": b} for k, (rows, b) in enumerate(found)]
    return {"pdf_metadata": info, "pages": pages, "blocks": blocks, "tables": tables}


def provenance(item: object) -> list[dict]:
    return [{"page_no": p.page_no, "bbox": box(p.bbox.as_tuple()) if p.bbox else None} for p in getattr(item, "prov", None) or ()]


def by_docling(path: str, warnings: list[str]) -> dict:
    """The converter is made once for each worker."""
    converted = made("docling.document_converter", "DocumentConverter").convert(path)
    doc = converted.document
    pages = [{"page_number": n, "text": doc.export_to_text(page_no=n), "markdown": doc.export_to_markdown(page_no=n)} for n in range(1, doc.num_pages() + 1)]
    items = []
    for k, (item, level) in enumerate(doc.iterate_items()):
        label = label_text(getattr(item, "label", type(item).__name__))
        items.append({"item_index": k, "label": label, "text": getattr(item, "text", None), "level": level, "provenance": provenance(item)})
    tables = []
    for k, t in enumerate(doc.tables):
        frame = tried(warnings, f"Table {k}: DataFrame export", lambda t=t: t.export_to_dataframe(doc=doc).fillna(""))
        tables.append({
            "table_index": k, "header": None if frame is None else [str(c) for c in frame.columns], "rows": [] if frame is None else cells(frame.to_numpy().tolist()), "provenance": provenance(t),
            "html": tried(warnings, f"Table {k}: HTML export", lambda t=t: t.export_to_html(doc=doc)), "markdown": tried(warnings, f"Table {k}: Markdown export", lambda t=t: t.export_to_markdown(doc=doc)),
        })
    stored = json.dumps(doc.export_to_dict(), ensure_ascii=False)
    return {"document_name": doc.name, "conversion_status": label_text(converted.status), "text": doc.export_to_text(), "markdown": doc.export_to_markdown(), "json": stored, "pages": pages, "items": items, "tables": tables}


def by_unstructured(path: str, warnings: list[str], strategy: str = "fast", languages: list[str] | None = None) -> dict:
    partition = importlib.import_module("unstructured.partition.pdf").partition_pdf
    raw = []
    for k, e in enumerate(partition(filename=path, strategy=strategy, infer_table_structure=strategy == "hi_res", languages=languages, include_page_breaks=False)):
        info = e.metadata.to_dict()
        points = (info.get("coordinates") or {}).get("points")
        page = info.get("page_number")
        raw.append({
            "element_index": k, "class_name": type(e).__name__, "text": str(getattr(e, "text", "") or ""), "page_number": None if page is None else int(page),
            "points": None if points is None else [[float(c) for c in p] for p in points], "text_as_html": info.get("text_as_html"), "metadata": strings(info),
        })
    return {"strategy": strategy, "languages": languages, "raw": raw}


EXTRACTORS: dict[str, Callable[..., dict]] = {"pdfplumber": by_pdfplumber, "pymupdf": by_pymupdf, "docling": by_docling, "unstructured": by_unstructured}
_made: dict[tuple[str, str], object] = {}


def made(module: str, name: str) -> object:
    """An object of a library, one for each worker."""
    if (module, name) not in _made:
        _made[module, name] = getattr(importlib.import_module(module), name)()
    return _made[module, name]


def extract_one(parser: str, path: str, content: bytes, options: dict) -> dict:
    """One row of HEAD and the parser's columns. A failure is kept as type and message."""
    warnings: list[str] = []
    began = time.perf_counter()
    try:
        with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
            f.write(content)
            f.flush()
            got = EXTRACTORS[parser](f.name, warnings, **options)
        error = None
    except Exception as e:
        got, error = {}, f"{type(e).__name__}: {e}"
    return {"source_file": path, "success": error is None, "error": error, "warnings": warnings, "processing_time_seconds": time.perf_counter() - began, **got}


def extract(files: DataFrame, parser: str, **options) -> DataFrame:
    """A row for each of files (relative_path, content): HEAD and the columns of the parser. Failed files have null tables."""
    if parser not in EXTRACTORS:
        raise ValueError(f"parser is one of {', '.join(EXTRACTORS)}")
    schema = f"{HEAD}, {COLUMNS[parser]}"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row = extract_one(parser, path, content.as_py() or b"", options)
                yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in arrow.names}], schema=arrow)

    return files.select("relative_path", "content").mapInArrow(run, schema)


def raw_tables(extracted: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """files, and a flat table for each array of structs, of stored rows of extract."""
    nested = [f.name for f in extracted.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    flat = {n: extracted.select("source_file", F.explode(n).alias("__x")).select("source_file", "__x.*") for n in nested}
    return extracted.drop(*nested), flat


def adapted(parser: str, extracted: DataFrame) -> adapters.Parsed:
    """The contract tables of stored rows of extract."""
    return ADAPTERS[parser](*raw_tables(extracted))


def docling_parser() -> Callable[[str, bytes], dict]:
    """A parser plug-in for ingestion: what it stores of a document."""

    def parse(path: str, content: bytes) -> dict:
        row = extract_one("docling", path, content, {})
        if row["error"]:
            raise RuntimeError(row["error"])
        return {"json": row["json"], "markdown": row["markdown"], "text": row["text"], "page_count": len(row["pages"]), "table_count": len(row["tables"]), "conversion_status": row["conversion_status"]}

    return parse


def stored_pages(parsed: DataFrame) -> DataFrame:
    """directory, error and pages (page_number, text) of stored documents (directory, json); nothing is parsed again."""
    schema = "directory string, error string, pages array<struct<page_number:int,text:string>>"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for directory, stored in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    doc = importlib.import_module("docling_core.types.doc").DoclingDocument.model_validate_json(stored)
                    rows.append({"directory": directory, "error": None, "pages": [{"page_number": n, "text": doc.export_to_text(page_no=n) or ""} for n in range(1, doc.num_pages() + 1)]})
                except Exception as e:
                    rows.append({"directory": directory, "error": f"{type(e).__name__}: {e}", "pages": []})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return parsed.select("directory", "json").mapInArrow(run, schema)


def reference_pages(extracted: DataFrame) -> DataFrame:
    """What validation reads of a PDF by itself, of stored pdfplumber rows: a row for each page, keyed by relative_path.

    Text without doubled glyphs, the number of glyphs with them, images, and how many tables were found.
    """
    files, raw = raw_tables(extracted)
    found = raw["tables"].groupBy("source_file", "page_number").agg(F.count("*").cast("int").alias("tables"))
    pages = raw["pages"].select("source_file", "page_number", F.col("plain_text").alias("text"), "char_objects", "width", "height", "images")
    return pages.join(found, ["source_file", "page_number"], "left").withColumnRenamed("source_file", "relative_path").withColumn("tables", F.coalesce("tables", F.lit(0)))
