"""Small tables for the operators of the llm package."""

import zlib

import numpy as np

CLASH = "n_tokens string, score string, uid string, n string, rep string, length string, rate string, token string, label string"


def documents(spark, rows, clash=True):
    """Rows (doc_id, text, source) as a table, with columns whose names operators use inside."""
    extra = CLASH if clash else ""
    schema = "doc_id long, text string, source string" + (", " + extra if extra else "")
    more = tuple("x" for _ in extra.split(",")) if extra else ()
    return spark.createDataFrame([(*r, *more) for r in rows], schema)


EDGE_TEXTS = [None, "", " ", "\n\n", "a", "  two  words ", "x" * 5000, "naïve café ÉTÉ don't", "日本語 текст 🙂", "tab\tand\x0bvt nbsp",
              "<|endoftext|> inside <|startoftext|>", "same text here", "same text here"]


def edge_rows():
    """Null and repeated ids, null, empty, odd and long texts, rows that repeat."""
    rows = [(k, t, "s%d" % (k % 3)) for k, t in enumerate(EDGE_TEXTS)]
    long = " ".join(f"word{k % 97}, and" for k in range(12_000))
    return rows + [(None, "no id", None), (None, None, None), (3, "same id, other text", "s1"), (20, long, "s0"), (11, "same text here", "s2"),
                   (11, "same text here", "s2")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))
