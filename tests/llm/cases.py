"""Small inputs that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ki", "zo", "té", "ru", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    long, shared = words(1, 4000), words(2, 70)
    texts = [None, "", " \n\t ", "one two", long, long, words(3, 90), words(3, 90).replace(" ", "  "), shared + " " + words(4, 60), words(5, 60) + "\n" + shared, "a" * 5000, "x. y, <|endoftext|> it's 12", "Üb̈er ﬁ ① 日本 😀"]
    out = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    # a row without id, a repeated row, and a second text of one id
    return [*out, (None, shared, None, None, None), out[6], (3, words(6, 80), "en", "s", 1)]


def documents(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def write(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def sorted_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
