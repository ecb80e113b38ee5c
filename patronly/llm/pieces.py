"""SentencePiece models run by the tokenizers library: read, rebuilt, verified."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .text import tidy

MARK = "▁"  # stands for a space inside pieces
GROUP_BYTES = 4 << 20  # of texts encoded together
JOINED = 100           # short segments encoded as one text
AT_ONCE = 200          # such texts given to a library at once
ROWS_OUT = 1_000       # rows that leave a worker at once

# Fixed values of the model file: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message; nested ones stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            length = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at:at + length], at + length
            if kind == 5:
                value = struct.unpack("<f", value)[0]
        yield key >> 3, value


class Model:
    """What a SentencePiece model file says: pieces with scores and kinds, the kind of
    model, and how it normalises."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.charsmap = UNIGRAM, False, b""
        self.dummy_prefix = self.squeeze = self.escape = True
        for number, value in _fields(data):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append((part[1].decode(), part.get(2, 0.0), part.get(3, NORMAL)))
            elif number == 2:
                part = dict(_fields(value))
                self.kind, self.byte_fallback = part.get(3, UNIGRAM), bool(part.get(35, 0))
            elif number == 3:
                part = dict(_fields(value))
                self.charsmap = part.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(part.get(n, 1)) for n in (3, 4, 5))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def splittable(self) -> bool:
        """Whether no piece reaches over the start of a word, so that words, each with the
        marks before it, are encoded independently."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))


def merges(model: Model) -> list[tuple[str, str]]:
    """Merge list of a BPE model: every way to make a piece of two pieces, best piece first."""
    number = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind in (NORMAL, USER):
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((-score, i, left, right))
    return [(model.pieces[left][0], model.pieces[right][0]) for _, _, left, right in sorted(found)]


def build(model: Model):
    """The model as a tokenizers.Tokenizer: normaliser, word split, pieces, decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model),
                          unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram (1) nor BPE (2)")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.splittable():
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "removed", invert=True)
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


class Codec:
    """Encodes and decodes with the rebuilt tokenizer and checks it against the
    SentencePiece library. It remembers nothing between calls."""

    def __init__(self, data: bytes, threads: int):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece
        from tokenizers import Tokenizer

        self.model = Model(data)
        full = build(self.model)
        self.normalizer = full.normalizer
        # segments are normalised and split already
        self.core = Tokenizer(full.model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        # the library would strip the space that starts a segment if it adds none itself
        self.alone = self.model.splittable() and (self.model.dummy_prefix or not self.model.squeeze)
        self.threads = threads
        self.marked = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else
                      b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode()
                      for p, _, kind in self.model.pieces]

    def normalise(self, text: str) -> str:
        if self.model.charsmap or self.model.squeeze:
            return self.normalizer.normalize_str(text)
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def _segments(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Where each text starts among the segments of all, which distinct segment stands
        there, and the distinct segments: words with the marks before them, or whole texts
        where pieces can span words."""
        texts = pa.array(normal, pa.large_string())
        if not self.alone:
            found = texts.dictionary_encode()
            some = np.array([t != "" for t in normal], bool)
            starts = np.concatenate(([0], some.cumsum()))
            return starts, found.indices.to_numpy()[some], found.dictionary.to_pylist()
        cut = next((c for c in map(chr, range(1, 32)) if not any(c in t for t in normal)), None)
        if cut:
            words = pc.split_pattern(pc.replace_substring_regex(texts, f"([^{MARK}]){MARK}", rf"\1{cut}{MARK}"), cut)
        else:  # the texts hold every character that could stand between segments
            pattern = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
            words = pa.array([pattern.findall(t) or [""] for t in normal], pa.large_list(pa.large_string()))
        found = words.flatten().dictionary_encode()
        return words.offsets.to_numpy(), found.indices.to_numpy(), found.dictionary.to_pylist()

    def _plain(self, text: str) -> str:
        """The text the library is given so that it sees these segments."""
        text = text.replace(MARK, " ") if self.model.escape else text
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def _both(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids by the rebuilt tokenizer and by the library, a few texts at a time."""
        for start in range(0, len(texts), AT_ONCE):
            part = texts[start:start + AT_ONCE]
            mine = self.core.encode_batch_fast(part, add_special_tokens=False)
            theirs = self.library.encode([self._plain(t) for t in part], num_threads=self.threads)
            for a, b in zip(mine, theirs):
                yield np.array(a.ids, np.int32), np.array(b, np.int32)

    def _learn(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, size, ids, right) of the distinct segments: where the ids of each stand.

        Segments with one mark are encoded ``JOINED`` at a time as one text: no piece reaches
        over a mark, so a segment's ids begin where a piece with a mark stands. If the number
        of marks is not that of the segments, or the library differs, each is encoded alone.
        """
        first, size = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        ids, total, right, single = [], 0, np.ones(len(segments), bool), np.ones(len(segments), bool)
        some = self.alone and self.model.kind == BPE
        joined = [i for i, s in enumerate(segments) if some and len(s) > 1 and s[0] == MARK != s[1]]
        groups = [joined[i:i + JOINED] for i in range(0, len(joined), JOINED)]
        for group, (mine, theirs) in zip(groups, self._both(["".join([segments[i] for i in g]) for g in groups])):
            starts = np.flatnonzero(self.marked[mine])
            if len(starts) == len(group) and np.array_equal(mine, theirs):
                single[group] = False
                first[group], size[group] = total + starts, np.diff(starts, append=len(mine))
                ids.append(mine)
                total += len(mine)
        rest = [i for i in np.flatnonzero(single) if segments[i]]
        for i, (mine, theirs) in zip(rest, self._both([segments[i] for i in rest])):
            first[i], size[i], right[i] = total, len(mine), np.array_equal(mine, theirs)
            ids.append(mine)
            total += len(mine)
        return first, size, np.concatenate(ids) if ids else np.zeros(0, np.int32), right

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ids, same): the ids of all texts after one another, where each text's
        start, and whether the library normalises the whole text to the same string and
        gives the same ids for all its segments. Each distinct segment is encoded once."""
        normal = [self.normalise(t) for t in texts]
        same = np.array([n == self.library.normalize(t) for t, n in zip(texts, normal)], bool)
        starts, segment, distinct = self._segments(normal)
        first, size, ids, right = self._learn(distinct)
        length = size[segment]
        ends = np.concatenate(([0], length.cumsum()))
        picked = ids[np.repeat(first[segment] - ends[:-1], length) + np.arange(ends[-1])]
        wrong = np.concatenate(([0], (~right[segment]).cumsum()))
        return ends[starts], picked, same & (wrong[starts[1:]] == wrong[starts[:-1]])

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], bool]]:
        """The same, text by text."""
        starts, ids, same = self.encode_batch(texts)
        for a, b, s in zip(starts[:-1], starts[1:], same):
            yield ids[a:b].tolist(), bool(s)

    def comes_back(self, texts: list[str], starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each text, whether its ids decode to it."""
        return np.array([self.decode(ids[a:b].tolist()) == t for t, a, b in zip(texts, starts[:-1], starts[1:])], bool)

    def decode(self, ids) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids))
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_CODECS: dict[bytes, Codec] = {}


def _codec(data: bytes, threads: int) -> Codec:
    """The worker's codec, read once for all its tasks."""
    key = hashlib.sha256(data).digest() + bytes([threads])
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


def _broadcast(df: DataFrame, path: str):
    """The model file as a broadcast: one file, read by the driver, a few MB at most."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _kinds(df: DataFrame, columns) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _text_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, in tables of about ``GROUP_BYTES`` of texts (column ``_text``), or one
    row where a text alone is longer."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < len(batch):
            end = start + max(int(not size), int(np.searchsorted(size + lengths[start:].cumsum(), GROUP_BYTES, "right")))
            held.append(batch.slice(start, end - start))
            size += int(lengths[start:end].sum())
            if end < len(batch):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            start = end
    if held:
        yield pa.Table.from_batches(held)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threads: int = 2) -> DataFrame:
    """Encode every whole text, decode it again and compare.

    Returns the ``keep`` columns and ids array<int>, n_tokens, parity (the SentencePiece
    library gives the same ids) and round_trip (decoding gives the text back; a model that
    normalises may lose white space or the like). A null text has null ids and zero
    tokens; an empty one has no ids; both count as right. For parity the library normalises
    every whole text, which must give the rebuilt normaliser's string, and encodes every
    distinct segment of the texts: as no piece spans two segments (read off the model; else
    the segment is the whole text), the parts decide about the whole. Texts are encoded in
    groups of a few million bytes, each distinct segment of a group once, by ``threads``
    threads; a worker holds one group. Repeated rows each get a row; other columns go; an
    empty table gives an empty result.
    """
    model = _broadcast(docs, path)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_text"))
    out = StructType([*[docs.schema[c] for c in keep], StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()),
                      StructField("parity", BooleanType()), StructField("round_trip", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, threads)
        for group in _text_groups(batches):
            column = group.column("_text")
            texts = [t or "" for t in column.to_pylist()]
            starts, ids, same = codec.encode_batch(texts)
            back = codec.comes_back(texts, starts, ids)
            null = pc.is_null(column).to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
            kept = [group.column(c) for c in range(len(keep))]
            done = pa.Table.from_arrays([*kept, lists, pa.array(np.diff(starts)), pa.array(same), pa.array(back)], names=out.names)
            yield from done.to_batches(max_chunksize=ROWS_OUT)

    return rows.mapInArrow(tidy(run), out)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The texts of id lists, as column ``text``; null for null."""
    model = _broadcast(rows, path)
    rows = rows.select(*keep, F.col(ids_col).alias("_ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(model.value, 1)
        for batch in batches:
            yield batch.drop(columns="_ids").assign(text=[None if ids is None else codec.decode(ids) for ids in batch["_ids"]])

    return rows.mapInPandas(run, f"{_kinds(rows, keep)}, text string")
