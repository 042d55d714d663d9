"""SentencePiece models on the tokenizers library: encoding and decoding without the sentencepiece library.

The model file is parsed as protobuf (``read_model``), and the tokenizer is rebuilt from it (``build``): the compiled
normaliser where the model has one, removal of extra white space, the metaspace marker with its dummy prefix, Unigram
scores or the merges that BPE scores stand for, user-defined pieces, and byte fallback. Control pieces never match text.

BPE scores give an order of pieces, and the library wants an order of pairs: each piece takes the rank of its score for
all pairs that make it up. Runs of the marker share one score, which SentencePiece breaks from the left; ranking pairs
with the longer left part first does the same.

Where no piece has the marker behind another character, no token reaches across the start of a run of markers. Each
worker then encodes a distinct stretch once, by ``encode_batch`` on several threads, and puts ids together by number
(``pieces``); else whole texts are encoded. Decoding takes the bytes of each id from a table and joins them; texts with
unknown or control ids, or bytes that are no UTF-8, are decoded one by one. ``verify`` holds ids and decoded texts against the
sentencepiece library (which sums Unigram scores in single precision: where two paths tie but for rounding, as over runs
of spaces, it may take the other); a codec is verified on ``PROBES`` when a worker makes it, and one that isn't at parity is refused.

Defined results: a null text counts as empty, which has no ids and decodes to the empty text; repeated rows are each
encoded; an empty table gives an empty result; other columns are passed on if named in ``keep``, and a clash with the
added names raises ValueError. Long texts are split into stretches, so memory is bounded by a batch of texts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsewarden.llm.common import handing_back, sliced, table
from parsewarden.llm.pieces import PieceTable, by_bytes, flat_ids, library
from parsewarden.llm.token_files import crc32_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A character that Unicode keeps out of texts.
NO_TEXT = "\ufdd0"
#: What SentencePiece decodes an unknown id to.
UNKNOWN_TEXT = " \u2047 "
PROBES = ("Hello world", " two  spaces ", "\ttab\n\nlines\n", "a▁b ▁", "x\u3000y \u3000", "ﬁ ① ½ é é 日本語 😀", "don't 3.14, <s> </s> <0x0A>", "aaaaaaaaa 000000", "   ", "qqzz \x00\x7f")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix_mark: bool = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        if size is None:
            if key & 7 != 2:
                raise ValueError(f"wire type {key & 7} is not known")
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            m.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:
            t = dict(_fields(value))
            m.kind, m.suffix_mark, m.byte_fallback, m.unk_id = t.get(3, UNIGRAM), bool(t.get(24, 0)), bool(t.get(35, 0)), t.get(40, 0)
        elif number == 3:
            n = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.remove_extra, m.escape = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
    if m.kind not in (UNIGRAM, BPE) or m.suffix_mark or not m.escape:
        raise ValueError("only Unigram and BPE models with escaped white space before words are supported")
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """Pairs in the order in which SentencePiece would merge them."""
    score = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER)}
    ranked = []
    for whole, s in score.items():
        run = not whole.strip(MARK)
        for i in range(1, len(whole)):
            left, right = whole[:i], whole[i:]
            if left in score and right in score:
                ranked.append((-s, -i if run else 0, whole, i))
    ranked.sort(key=lambda x: (x[0], x[1], score[x[2]], x[3]))
    return [(w[:i], w[i:]) for _, _, w, i in ranked]


class Codec:
    """Encodes and decodes like the model file that it was built from."""

    def __init__(self, path: str, most: int = 1 << 20):
        t = library()
        from tokenizers import AddedToken, Regex, models, normalizers, pre_tokenizers

        m = self.model = read_model(path)
        unk = m.pieces[m.unk_id][0]
        if m.kind == BPE:
            own = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=merges_of(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            # other pieces must not match text: they get names that no text has; bytes come from unknown stretches, see _encode
            own = models.Unigram([(p, s) if kind in (NORMAL, USER) else (f"{NO_TEXT}{i}", 0.0) for i, (p, s, kind) in enumerate(m.pieces)], m.unk_id, False)
        usable = [p for p, _, kind in m.pieces if kind in (NORMAL, USER)]
        # unknown characters in a row share an id, so a run of them must not reach across a marker
        self.stretches = MARK in usable and not any(MARK in p.lstrip(MARK) for p in usable)
        before = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra:
            before += [normalizers.Replace(Regex(r"\A +"), ""), normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(rf"[ {MARK}]+\z"), "")]
        self.before = normalizers.Sequence(before) if before else None
        self.plain = t.Tokenizer(own)
        if self.stretches:
            self.plain.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
        self.plain.add_tokens([AddedToken(p, normalized=False, special=False) for p, _, kind in m.pieces if kind == USER])
        self.table = PieceTable(self._encode, most)
        self.id_of_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
        self.bytes_of = pa.array([self._bytes(p, kind) for p, _, kind in m.pieces], pa.binary())
        # a text loses the marker that it begins with; of a marker alone more may go, see decode_slowly
        strips = m.dummy_prefix or m.remove_extra
        self.marked = np.array([strips and kind not in (BYTE, UNKNOWN, CONTROL) and p[:1] == MARK for p, _, kind in m.pieces])
        self.bare = np.array([m.remove_extra and p == MARK for p, _, _ in m.pieces])
        self.slow = np.array([kind in (UNKNOWN, CONTROL) for _, _, kind in m.pieces])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        marked = [x.replace(" ", MARK) for x in texts]
        if self.model.kind == BPE or not self.model.byte_fallback:
            return [e.ids for e in self.plain.encode_batch_fast(marked, add_special_tokens=False)]
        out = []
        for x, e in zip(marked, self.plain.encode_batch(marked, add_special_tokens=False), strict=True):
            each = [[i] if i != self.model.unk_id else [self.id_of_byte[b] for b in x[s:t].encode()] for i, (s, t) in zip(e.ids, e.offsets, strict=True)]
            out.append([i for ids in each for i in ids])
        return out

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {CONTROL: "", UNKNOWN: UNKNOWN_TEXT}.get(kind, piece.replace(MARK, " ")).encode()

    def _prepared(self, text: str | None) -> bytes:
        """What the model sees, with spaces for markers."""
        text = self.before.normalize_str(text) if text and self.before else text
        return ((" " if self.model.dummy_prefix else "") + text).replace(MARK, " ").encode() if text else b""

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets of the texts."""
        prepared = [self._prepared(t) for t in texts]
        if not self.stretches:
            ids, n = flat_ids(self._encode([p.decode() for p in prepared]))
            return ids, np.concatenate([[0], np.cumsum(n)])
        data = np.frombuffer(b"".join(prepared), np.uint8)
        begin = np.cumsum([0, *map(len, prepared)])
        space = data == 0x20
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[begin[:-1][begin[:-1] < len(data)]] = True
        starts = np.flatnonzero(starts)
        ids, n = self.table.ids(self.table.numbers(data, np.diff(np.append(starts, len(data)))))
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, begin)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the ids between the offsets at."""
        values = self.bytes_of.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
        data = values.buffers()[2].to_pybytes() if len(values) else b""
        slow = np.concatenate([[0], np.cumsum(self.slow[ids])])[at]
        first = np.append(ids, 0)[at[:-1]]
        marked, bare = self.marked[first] & (np.diff(at) > 0), self.bare[first]
        out = []
        for k, (i, j) in enumerate(zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist(), strict=True)):
            own = data[i:j]
            if slow[k + 1] == slow[k] and not bare[k]:
                try:
                    out.append(own[1 if marked[k] else 0 :].decode())
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(self.decode_slowly(ids[at[k] : at[k + 1]].tolist()))
        return out

    def decode_slowly(self, ids: list[int]) -> str:
        """Byte pieces in a row make characters, and U+FFFD for each byte that belongs to none."""
        out: list[str] = []
        held, seen = b"", False

        def flush() -> None:
            nonlocal held
            while held:
                n = next((n for n in (1, 2, 3, 4) if is_character(held[:n])), 0)
                out.append(held[:n].decode() if n else "\ufffd")
                held = held[max(1, n) :]

        for i in ids:
            piece, _, kind = self.model.pieces[i]
            if kind == BYTE:
                held += self._bytes(piece, kind)
                continue
            flush()
            if kind == CONTROL:
                continue
            # at the beginning a piece loses one marker; only where extra spaces go, the next one may lose one too
            if self.marked[i] and not seen and not any(out):
                piece, seen = piece[1:], not self.model.remove_extra
            out.append(UNKNOWN_TEXT if kind == UNKNOWN else piece.replace(MARK, " "))
        flush()
        return "".join(out)


def is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def differing(own: Codec, path: str, texts: list[str]) -> list[str]:
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, at = own.encode(texts)
    lists = [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)]
    return [t for t, i, d in zip(texts, lists, own.decode(ids, at), strict=True) if i != theirs.encode(t) or d != theirs.decode(i)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    own = Codec(path)
    if wrong := differing(own, path, list(PROBES)):
        raise ValueError(f"the model in {path} is not rebuilt faithfully: {wrong[:3]!r}")
    return own


def verify(path: str, texts: list[str]) -> list[str]:
    """The texts whose ids or decoded text differ from those of the sentencepiece library."""
    return differing(codec(path), path, texts)


def encode_and_decode(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1 << 21) -> DataFrame:
    """keep, ids (array), n_tokens, ids_crc32 and decoded text of every row. No shuffle."""
    added = ("ids", "n_tokens", "ids_crc32", "decoded")
    if set(keep) & set(added):
        raise ValueError(f"columns {sorted(set(keep) & set(added))} clash with those added")
    own = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*own.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for whole in sliced(batches):
            sizes = pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
            for start, end in by_bytes(sizes, batch_bytes):
                b = whole.slice(start, end - start)
                ids, at = c.encode(b.column(b.num_columns - 1).to_pylist())
                cut = [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                decoded = c.decode(ids, at)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(np.diff(at)), pa.array([crc32_of(x) for x in cut], pa.int64()), pa.array(decoded, pa.string())], names=[*keep, *added])
        # an idle worker would keep its pieces beside all other work of its executor; the next task learns its own
        c.table.clear()

    return own.mapInArrow(handing_back(run), schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 and round_trip (the decoded text is the text) of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))
