"""Texts as numbered pieces, each distinct piece being encoded once a worker.

A tokenizer whose tokens never reach across certain places gives a text the tokens of its pieces, one after another.
``boundaries`` tells from a tokenizer's own description whether white space is such a place, and whether a stop or comma
behind an ASCII letter is one too; where it can't be told, whole texts are encoded.

Pieces are told apart by their bytes, by Arrow's dictionary encoding and a table of bytes: no hash decides. What a worker
remembers is bounded: beyond ``most`` pieces, or as many times 16 bytes, it starts anew.

New pieces go to the library ``TOGETHER`` in a text, apart by a mark of one id, as a text of its own costs more than its tokens. A
text in which that id stands more often than the mark was put there is encoded again piece by piece, so this is exact.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from parsewarden.llm.shingles import SPACE

THREADS = 2
#: Bytes of pieces that go to the library in one call.
BYTES_A_CALL = 1 << 20
#: Pieces that make one text, and what stands between them.
TOGETHER = 256
MARK = "\x7f"
LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])
STOP = np.isin(np.arange(256), [44, 46])
#: Patterns of words whose matches hold no white space, and none a letter next to a stop or comma.
WORD_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
NORMALIZERS = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")


def library():
    """The tokenizers library, with so many threads in every worker, whichever operator comes first."""
    os.environ["RAYON_NUM_THREADS"] = str(THREADS)
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    import tokenizers

    return tokenizers


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """One tokenizer for each worker and file, without truncation or padding."""
    tok = library().Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _steps(part: dict | None, inner: str) -> list[dict]:
    if part is None:
        return []
    return [x for p in part[inner] for x in _steps(p, inner)] if part["type"] == "Sequence" else [part]


def boundaries(tok) -> str:
    """Where texts may be cut: "stops" (white space, and stops behind letters), "spaces" or "none"."""
    own = json.loads(tok.to_str())
    for n in _steps(own["normalizer"], "normalizers"):
        if n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " ":
            continue
        if n["type"] not in NORMALIZERS:
            return "none"
    added = own["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added):
        return "none"
    if own["model"].get("dropout"):
        return "none"
    first, *rest = _steps(own["pre_tokenizer"], "pretokenizers") or [{"type": ""}]
    if any(p["type"] not in ("ByteLevel", "Digits", "Punctuation", "Split") or p.get("add_prefix_space") for p in rest):
        return "none"
    words = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in WORD_PATTERNS
    marks = {c for t in added for c in t["content"]} & {".", ","}
    if (words or first["type"] == "BertPreTokenizer") and not marks and all(p["type"] == "ByteLevel" for p in rest):
        return "stops"
    return "spaces" if words or first["type"] in ("BertPreTokenizer", "Whitespace", "WhitespaceSplit") else "none"


def word_spans(data: np.ndarray, stops: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data begin and end: maximal runs without ASCII white space, cut before stops if asked."""
    space = SPACE[data]
    begins = ~space
    begins[1:] &= (space[:-1] | (LETTER[data[:-1]] & STOP[data[1:]])) if stops else space[:-1]
    last = ~space
    last[:-1] &= space[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(last) + 1


def by_bytes(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about most bytes each."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def flat_ids(encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all one after another, and the number of ids of each."""
    n = np.fromiter(map(len, encoded), np.int64, len(encoded))
    return np.fromiter(chain.from_iterable(encoded), np.int32, int(n.sum())), n


class PieceTable:
    """Numbers of the pieces that a worker has met, and their ids.

    encode: ids of each of a list of texts; encode_flat: those of a list of pieces as flat_ids gives them, if there is a faster way.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 1 << 20, encode_flat: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.encode, self.most = encode, most
        self.encode_flat = encode_flat or (lambda texts: flat_ids(encode(texts)))
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.sizes = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def learn(self, pieces: list[bytes]) -> None:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # calls hold pieces of like length, so that threads get equal work
        order = np.argsort(lengths, kind="stable")
        parts = [self.encode_flat([pieces[k].decode() for k in order[i:j]]) for i, j in by_bytes(lengths[order], BYTES_A_CALL)]
        n = np.concatenate([p[1] for p in parts])
        starts = len(self.flat) + np.cumsum(n) - n
        base = len(self.sizes)
        for k, i in enumerate(order.tolist()):
            self.number[pieces[i]] = base + k
        self.held += int(lengths.sum())
        self.sizes, self.starts = np.concatenate([self.sizes, n]), np.concatenate([self.starts, starts])
        self.flat = np.concatenate([self.flat, *[p[0] for p in parts]])

    def numbers(self, joined: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each piece. joined: the bytes of all pieces, one after another."""
        if not len(lengths):
            return np.empty(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        # a piece's place in Arrow is 32 bits wide, as is that of a batch's whole column
        pieces = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(joined))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = list(map(self.number.get, distinct))
        new = [p for p, k in zip(distinct, known, strict=True) if k is None]
        if new:
            if self.number and (len(self.number) + len(new) > self.most or self.held + sum(map(len, new)) > 16 * self.most):
                self.clear()
                new = distinct
            self.learn(new)
            known = list(map(self.number.__getitem__, distinct))
        return np.array(known, np.int64)[coded.indices.to_numpy()]

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered pieces one after another, and the number of ids of each."""
        n = self.sizes[numbers]
        stop = np.cumsum(n)
        if not len(n):
            return np.empty(0, np.int32), n
        return self.flat[np.repeat(self.starts[numbers] - (stop - n), n) + np.arange(stop[-1])], n


class TextTokens:
    """Token counts and ids of whole texts as a tokenizer gives them, without added special tokens."""

    def __init__(self, tok, most: int = 1 << 20):
        self.encode = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        self.cut = boundaries(tok)
        mark, unknown = self.encode([MARK, "\ue000"])
        self.mark = mark[0] if len(mark) == 1 and mark != unknown else None
        self.table = PieceTable(self.encode, most, self._together if self.mark is not None else None)

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """flat_ids of pieces, TOGETHER of them in a text."""
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        parts = []
        for own, found in zip(groups, self.encode([f" {MARK} ".join(g) for g in groups]), strict=True):
            ids = np.array(found, np.int32)
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(own) - 1:
                parts.append((np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1))
            else:
                parts.append(flat_ids(self.encode(own)))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and offsets of the texts among them."""
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if not len(data):
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        starts, ends = word_spans(data, self.cut == "stops")
        numbers = self.table.numbers(data[~SPACE[data]], ends - starts)
        return numbers, np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))

    def counts(self, texts: list[bytes]) -> np.ndarray:
        if self.cut == "none":
            return self.ids(texts)[1]
        numbers, at = self._pieces(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.table.sizes[numbers])])[at])

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if self.cut == "none":
            return flat_ids(self.encode([t.decode() for t in texts]))
        numbers, at = self._pieces(texts)
        ids, n = self.table.ids(numbers)
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[at])


@lru_cache(maxsize=2)
def text_tokens(path: str) -> TextTokens:
    return TextTokens(load_tokenizer(path))
