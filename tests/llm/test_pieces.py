import struct

import pytest
import sentencepiece
from cases import SMALL, documents, edge_rows, empty
from tokenizers import Tokenizer  # noqa: F401

from patronly.llm import pieces
from patronly.llm.queries import PIECE_MODEL


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(prefix=1, squeeze=1):
    """A model file written by hand: unigram pieces, byte fallback, white space rules."""
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    listed += [(p, -float(i + 1) / 3, 1) for i, p in enumerate("▁the ▁a ▁ab abc ab bc a b c d ▁ th he e t h ▁c ca".split())]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in listed)
    return out + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, prefix) + field(4, squeeze) + field(5, 1))


TEXTS = ["the abc cab", "  the   abcd  ", "a", "", " ", "abcabcabc dcba", "héé the \n\t x", "日本 the", "the▁a", "ab" * 500]


@pytest.mark.parametrize("prefix, squeeze", [(1, 1), (1, 0), (0, 1), (0, 0)])
def test_unigram_models_agree_with_the_library(prefix, squeeze):
    data = unigram_model(prefix, squeeze)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Codec(data, 1)
    full = pieces.build(codec.model)
    for text in TEXTS:
        ids, same = next(codec.encode([text]))
        assert ids == library.encode(text), text
        assert full.encode(text, add_special_tokens=False).ids == ids, text
        assert same, text
        assert codec.decode(ids) == library.decode(ids), text


def test_large_model_agrees_on_whole_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    done = pieces.encode(docs, PIECE_MODEL, keep=("doc_id", "text"))
    for r in done.collect():
        assert r["ids"] == library.encode(r["text"]) and r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["ids"])
    back = pieces.decode(done, PIECE_MODEL, keep=("doc_id",)).join(docs.select("doc_id", docs["text"].alias("was")), "doc_id")
    assert back.filter("text <> was").count() == 0


def test_edges(spark):
    done = pieces.encode(documents(spark, edge_rows()), PIECE_MODEL, keep=("doc_id", "text")).collect()
    assert len(done) == len(edge_rows())
    for r in done:
        assert r["parity"] and r["round_trip"] and (r["ids"] is None) == (r["text"] is None)
        assert r["n_tokens"] == len(r["ids"] or [])
    assert pieces.encode(empty(spark), PIECE_MODEL).count() == 0
    assert pieces.decode(pieces.encode(empty(spark), PIECE_MODEL), PIECE_MODEL).count() == 0


def test_odd_texts_agree():
    with open(PIECE_MODEL, "rb") as file:
        data = file.read()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Codec(data, 1)
    for text in TEXTS + ["<s>", "</s> <unk>", "<0x41>", "\x00\x01", "á", "🙂 🙂", "\r\n", "   x", "x   "]:
        ids, same = next(codec.encode([text]))
        assert ids == library.encode(text) and same, text


def test_a_different_normaliser_breaks_parity():
    with open(PIECE_MODEL, "rb") as file:
        codec = pieces.Codec(file.read(), 1)
    texts = ["Hello  World", " été\n", "", " ", "plain"]
    assert all(same for _, same in codec.encode(texts))
    right = codec.normalise
    codec.normalise = lambda text: right(text.lower())
    assert [same for _, same in codec.encode(texts)] == [False, True, True, True, True]
