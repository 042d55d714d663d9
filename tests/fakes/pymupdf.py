"""Stands in for the library in tests; see pdfplumber here."""

import pdfplumber


class Rect:
    width, height = 600, 800


class Found:
    def __init__(self, tables):
        self.tables = tables


class Page:
    rect = Rect()

    def __init__(self, page):
        self.page = page

    def get_text(self, kind, sort=False):
        text = self.page["text"]
        return text if kind == "text" else [(0, 0, 1, 1, text, 7, 0), (1, 1), (0, 0, 1, 1, "  ")]

    def get_images(self, full=False):
        return self.page.get("images", [])

    def find_tables(self):
        return Found(pdfplumber.Page(self.page).find_tables())


class Document(pdfplumber.Document):
    def __iter__(self):
        return iter(Page(p.page) for p in self.pages)


def open(path):  # noqa: A001
    return Document(pdfplumber.load(path))
