"""Stands in for the library in tests; see pdfplumber here. A document is stored as it is given, with what is read of it."""

import enum
import json


class Label(enum.Enum):
    TEXT = "text"


class Box:
    def as_tuple(self):
        return (1, 2, 3, 4)


class Provenance:
    def __init__(self, page):
        self.page_no, self.bbox = page, Box()


class Item:
    label = Label.TEXT

    def __init__(self, text, page):
        self.text, self.prov = text, [Provenance(page)]


class Frame:
    def __init__(self, rows):
        self.columns, self.rows = rows[0], rows[1:]

    def fillna(self, _):
        return self

    def to_numpy(self):
        return self

    def tolist(self):
        return self.rows


class Table:
    def __init__(self, rows, page):
        self.rows, self.prov = rows, [Provenance(page)] if page else []

    def export_to_dataframe(self, doc):
        return Frame(self.rows)

    def export_to_html(self, doc):
        raise ValueError("no html")

    def export_to_markdown(self, doc):
        return "md"


class DoclingDocument:
    name = "name"

    def __init__(self, pages):
        self.own = pages
        self.tables = [Table(t, n) for n, p in enumerate(pages, 1) for t in p.get("tables", [])]

    def num_pages(self):
        return len(self.own)

    def export_to_text(self, page_no=None):
        return "\n".join(p.get("parsed", p["text"]) for n, p in enumerate(self.own, 1) if page_no in (None, n))

    export_to_markdown = export_to_text

    def iterate_items(self):
        return [(Item(p["text"], n), 1) for n, p in enumerate(self.own, 1)] + [(Item("", 1), 1)]

    def export_to_dict(self):
        tables = [{"prov": [{"page_no": t.prov[0].page_no}]} for t in self.tables]
        return {"pages": {str(n): {"page_no": n} for n in range(1, self.num_pages() + 1)}, "tables": tables, "own": self.own}

    @classmethod
    def model_validate_json(cls, stored):
        return cls(json.loads(stored)["own"])
