"""Stands in for the library in tests."""

import pdfplumber
from docling_core.types.doc import DoclingDocument


class Status:
    value = "success"


class Converted:
    status = Status()

    def __init__(self, document):
        self.document = document


class DocumentConverter:
    def convert(self, path):
        return Converted(DoclingDocument(pdfplumber.load(path)))
