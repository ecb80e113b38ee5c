"""Inputs every operator must stand: nulls, empty and very long texts, ties, repeated
rows, extra columns with clashing names, empty tables."""

import hashlib
import zlib

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "kept", "label", "run", "digest", "block", "words", "size", "row", "pass", "known", "root",
            "_row_key", "_dropped_key", "_key", "_id", "_c0", "_text", "_known", "_words", "_best", "key", "order", "shard", "slot", "before"]
LONG = " ".join(f"word{i % 9973}x{i % 31}" for i in range(60_000))


def edge_rows():
    base = "one two three four five six seven eight nine ten eleven twelve"
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, "  " + base + "\n", "en", None),
        (4, None, "en", "a"), (5, "", "fr", "b"), (6, " \t\n", None, "b"), (7, LONG, "en", "b"), (8, LONG, None, None),
        (9, "12 34 !!", "de", "c"), (None, base, "en", "a"), (None, "alone", None, None), (10, "été über ñandú", "fr", "c"),
        (11, "a", "en", "c"), (12, "tie", "en", "c"), (13, "tie", "en", "c"),
    ]


def documents(spark, rows, extra=True):
    full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    docs = spark.createDataFrame(full, SCHEMA)
    if extra:
        for n, name in enumerate(CLASHING):
            docs = docs.selectExpr("*", f"{n} as {name}")
    return docs


def empty(spark):
    return documents(spark, [])


def remainder(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def words(text):
    return (text or "").encode().split()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def texts(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
