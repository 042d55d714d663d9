from __future__ import annotations

import glob
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from parsewarden.llm import pieces
from parsewarden.llm import sentencepiece_codec as sp
from parsewarden.llm import token_counts as tc
from parsewarden.llm import token_files as tf
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def ids_of(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [PATH, BYTES])
def test_counts_are_those_of_whole_texts(spark, path):
    docs = cases.documents(spark)
    tok = Tokenizer.from_file(path)
    n = [len(tok.encode(r[1] or "", add_special_tokens=False).ids) for r in cases.rows()]
    want = [(r[0], len((r[1] or "").encode()), k, k > 2048) for r, k in zip(cases.rows(), n, strict=True)]
    for size in (1 << 22, 200):
        assert cases.sorted_rows(tc.token_counts(docs, path, batch_bytes=size)) == sorted(want, key=repr)
    assert tc.token_counts(cases.empty(spark), path).count() == 0
    with pytest.raises(ValueError):
        tc.token_counts(docs.withColumnRenamed("lang", "n_tokens"), path, keep=("doc_id", "n_tokens"))


def test_counting_query_takes_whole_tables(spark, tmp_path):
    d = cases.write(spark, tmp_path, documents=cases.documents(spark))
    want = [(r[0], len((r[1] or "").encode()), len(i), len(i) > 2048) for r, i in zip(cases.rows(), ids_of([r[1] for r in cases.rows()]), strict=True)]
    assert cases.sorted_rows(tc.op4_token_counts(spark, d)) == sorted(want, key=repr)


def test_pieces_join_to_the_text():
    for text in (b"a b  c\n\nd", b" " * 30, b"x" * 99 + b" y", b"", "é ü ".encode() * 9):
        for most in (1, 4, 50):
            parts = tc.split_safely(text, most)
            assert b"".join(parts) == text and all(x[:1].isspace() for x in parts[1:])
            assert all(len(x) <= most or not x[1:].strip() or b" " not in x[1:most] for x in parts)
    # parts are held to bytes, whatever the script
    assert max(map(len, tc.split_safely(("日本語 " * 1000).encode(), 100))) <= 100


def test_batches_are_held_to_bytes():
    sizes = np.array([5, 200, 3, 3, 3, 90, 10, 0, 0])
    ranges = list(pieces.by_bytes(sizes, 100))
    assert ranges == [(0, 1), (1, 2), (2, 6), (6, 9)] and list(pieces.by_bytes(np.array([], int), 5)) == []


def test_boundaries_are_told_from_the_tokenizer():
    assert pieces.boundaries(Tokenizer.from_file(PATH)) == "stops"
    assert pieces.boundaries(Tokenizer.from_file(BYTES)) == "none"
    from tokenizers import AddedToken, models, normalizers, pre_tokenizers

    def made(pre, normal=None, added=()):
        tok = Tokenizer(models.WordLevel({"a": 0, "Apple": 1, "apple": 2, "?": 3}, "?"))
        tok.pre_tokenizer, tok.normalizer = pre, normal
        tok.add_tokens(list(added))
        return pieces.boundaries(tok)

    assert made(pre_tokenizers.Whitespace()) == "spaces" and made(pre_tokenizers.WhitespaceSplit(), normalizers.NFKC()) == "spaces"
    assert made(pre_tokenizers.BertPreTokenizer(), normalizers.Lowercase()) == "stops"
    assert made(pre_tokenizers.Metaspace()) == made(pre_tokenizers.WhitespaceSplit(), normalizers.Prepend("x")) == "none"
    assert made(pre_tokenizers.WhitespaceSplit(), None, [AddedToken("a b", normalized=False)]) == "none"


def test_case_stays_where_the_tokenizer_keeps_it(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"Apple": 1, "apple": 2, "?": 3}, "?"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "t.json"))
    tf.write_tokens(spark.createDataFrame([(1, "Apple apple")], "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "t.json"), end_id=9)
    assert tf.read_tokens(spark, str(tmp_path / "out")).first()["ids"] == [1, 2, 9]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, tmp_path, encoding):
    docs = cases.documents(spark)
    path = str(tmp_path / "tokens")
    tf.write_tokens(docs, path, PATH, encoding=encoding, row_group_rows=4, page_rows=2)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in tf.read_tokens(spark, path).collect())
    own = sorted((-1 if r[0] is None else r[0], [*i, 1]) for r, i in zip(cases.rows(), ids_of([r[1] for r in cases.rows()]), strict=True))
    assert got == own
    assert {r["doc_id"] for r in tf.read_tokens(spark, path, 4, 6).collect()} == {4, 5, 6}
    # what the files hold
    seen = set()
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            column = next(group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema.startswith("ids"))
            assert group.num_rows <= 4 and column.has_column_index and column.has_offset_index and column.compression == "ZSTD"
            seen |= set(column.encodings)
    assert ("RLE_DICTIONARY" in seen or "PLAIN_DICTIONARY" in seen) if encoding == "dictionary" else ("DELTA_BINARY_PACKED" in seen and "RLE_DICTIONARY" not in seen)


def test_starts_follow_the_order_of_ids(spark, tmp_path):
    d = cases.write(spark, tmp_path, documents=cases.documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]))
    got = sorted(map(tuple, tf.op10_token_files(spark, d).collect()))
    texts = dict(sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()))
    want, start = [], 0
    for doc, ids in zip(texts, ids_of(list(texts.values())), strict=True):
        ids = [*ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert got == want
    assert tf.op10_token_files(spark, cases.write(spark, tmp_path / "none", documents=cases.empty(spark))).count() == 0


def test_piece_table_gives_the_ids_of_whole_texts():
    texts = ["it's a.b .,x ,y.. don't. ́e a.́b É", "İstanbul. ΑΣ. x½ ＡＢ 　 z x.Σ", "l'.x 'S 'll. <|endoftext|>.a", "", " ", "A a. A."]
    own = pieces.TextTokens(pieces.load_tokenizer(PATH), most=5)
    for _ in range(2):
        ids, n = own.ids([t.encode() for t in texts])
        assert ids.tolist() == [i for x in ids_of(texts) for i in x] and n.tolist() == [len(x) for x in ids_of(texts)]
        assert own.counts([t.encode() for t in texts]).tolist() == n.tolist()


def test_pieces_go_to_the_library_many_in_a_text(monkeypatch):
    own = pieces.TextTokens(pieces.load_tokenizer(PATH))
    calls, encode = [], own.encode
    own.encode = lambda texts: calls.append(len(texts)) or encode(texts)
    own.table.encode = own.encode
    # the mark is a piece, a part of one, and part of a long one; then pieces without it
    for texts in (["a \x7f b", "x\x7fy it's \x7f\x7f.", cases.words(4, 400)], [cases.words(5, 2000), "́e <|endoftext|> Σ ½"]):
        calls.clear()
        ids, n = own.ids([t.encode() for t in texts])
        assert ids.tolist() == [i for x in ids_of(texts) for i in x] and n.tolist() == [len(x) for x in ids_of(texts)]
    assert 0 < sum(calls) <= 2000 // pieces.TOGETHER + 1


def test_many_rows_of_one_id_spread_over_files(spark, tmp_path):
    df = spark.range(4000).selectExpr("if(id < 3000, null, 7) as doc_id", "concat('word ', id) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tf.write_tokens(df, str(tmp_path / "t"), PATH)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = tf.read_tokens(spark, str(tmp_path / "t"))
    assert own.count() == 4000 and own.select("_metadata.file_name").distinct().count() > 2


def test_sentencepiece_parity():
    texts = [r[1] for r in cases.rows() if r[1]] + ["", " a  b ", "\n\nx\t y", "a▁b", "\x00z", " " * 40 + "x", "ﬁ①", "<s> hi </s> <0x0A>", "a" * 50, "0" * 33]
    assert sp.verify(MODEL, texts) == []


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


@pytest.mark.parametrize("fallback", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("extra", [0, 1])
@pytest.mark.parametrize("marker", [True, False])
def test_unigram_models_are_rebuilt(tmp_path, fallback, prefix, extra, marker):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("a", -3.0, 1), ("b", -3.1, 1), ("▁ab", -1.0, 1), ("ab", -2.5, 1), ("\t", -4.0, 1)] + [("▁", -2.0, 1)] * marker
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] * fallback
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, 1), (35, fallback)))) + message((3, message((3, prefix), (4, extra), (5, 1))))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    r = random.Random(8)
    texts = ["".join(r.choice(["a", "b", "ab", " ", "  ", "\t", "\n", "c", "▁", "é", "　", "日"]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    assert sp.verify(str(path), ["ab ab", "\tab", "ab\n", "　ab", "cc", "", " ab  b ", *texts]) == []


def test_any_ids_decode_as_in_the_library():
    import sentencepiece

    theirs, own, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), sp.codec(MODEL), random.Random(2)
    for _ in range(500):
        ids = [r.choice([0, 1, 2, 3 + r.randrange(256), r.randrange(32_000), 29_871, 259, 35]) for _ in range(r.randint(0, 12))]
        assert own.decode(np.array(ids, np.int32), np.array([0, len(ids)])) == [theirs.decode(ids)]


def test_a_model_that_is_not_rebuilt_faithfully_is_refused(monkeypatch):
    monkeypatch.setattr(sp, "merges_of", lambda m: [])
    sp.codec.cache_clear()
    with pytest.raises(ValueError):
        sp.codec(MODEL)
    monkeypatch.undo()
    sp.codec.cache_clear()


def test_sentencepiece_query(spark, tmp_path):
    import hashlib

    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    d = cases.write(spark, tmp_path, documents=cases.documents(spark))
    want = [(r[0], len(i), zlib.crc32(np.array(i, "<u4")), hashlib.sha256(theirs.decode(i).encode()).hexdigest(), theirs.decode(i) == (r[1] or "")) for r in cases.rows() for i in [theirs.encode(r[1] or "")]]
    assert cases.sorted_rows(sp.op9_sentencepiece(spark, d)) == sorted(want, key=repr)


def test_a_worker_keeps_no_pieces_after_its_task(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for k in range(200)) for i in range(50)]
    df, tasks = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: tasks.append(run) or self)
    sp.encode_and_decode(df, MODEL)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts)], names=["doc_id", "__text"])
    for _ in range(2):
        assert [t for b in tasks[0](iter([batch])) for t in b.column(4).to_pylist()] == texts
        assert not sp.codec(MODEL).table.number and not len(sp.codec(MODEL).table.flat)


def test_encode_and_decode_rows(spark):
    docs = cases.documents(spark)
    out = sp.encode_and_decode(docs, MODEL, keep=("doc_id", "text", "lang"))
    assert out.filter("decoded <> coalesce(text, '')").count() == 0 and out.count() == docs.count()
    assert sp.encode_and_decode(cases.empty(spark), MODEL).count() == 0
    with pytest.raises(ValueError):
        sp.encode_and_decode(docs.withColumnRenamed("lang", "ids"), MODEL, keep=("ids",))
