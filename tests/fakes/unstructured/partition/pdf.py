"""Stands in for the library in tests."""

import pdfplumber


class Metadata:
    def __init__(self, **own):
        self.own = own

    def to_dict(self):
        return self.own


class Element:
    def __init__(self, text, **own):
        self.text, self.metadata = text, Metadata(**own)


class NarrativeText(Element):
    pass


class Table(Element):
    pass


def partition_pdf(filename, strategy, infer_table_structure, languages, include_page_breaks):
    out = []
    for n, p in enumerate(pdfplumber.load(filename), 1):
        out.append(NarrativeText(p["text"], page_number=n, coordinates={"points": ((0, 0), (0, 2), (3, 2), (3, 0))}, filetype="pdf"))
        out += [Table("t", page_number=n, text_as_html="<table><tr><td>a</td><td>b</td></tr></table>") for _ in p.get("tables", [])]
    return out
