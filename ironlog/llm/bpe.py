"""Byte-level BPE over Arrow batches with the ``tokenizers`` library: ids, offsets, and decoding."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from ironlog.llm.common import only, slices

#: Encoded pieces that a worker remembers; beyond that, it starts to remember anew.
MEMORY = 400_000
#: New pieces that are handed to the tokenizer at a time: what it returns takes many times a piece's own length.
PIECES = 4096
#: Finds characters from U+0800 on; none before that are open.
_BEYOND = re.compile("[\u0800-\U0010ffff]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others get the characters from U+0100 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """The rank file as a ``tokenizers`` model that takes one piece of text at a time.

    A pair may be merged whenever the joined bytes are a token; the joined token's rank decides which pair is first,
    and a piece that is itself a token stays whole.  Nothing is learned.
    """
    chars = byte_characters()
    text = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((rank, ranks[left], ranks[right], text(left), text(right)))
    merges.sort()
    model = models.BPE({text(t): r for t, r in ranks.items()}, [m[3:] for m in merges], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


def _later_characters() -> regex.Pattern:
    """Characters that this Python's Unicode tables leave open: pattern libraries may class them differently."""
    out, begun = [], None
    for point in range(0x800, 0x110001):
        is_open = point < 0x110000 and unicodedata.category(chr(point)) == "Cn"
        if is_open and begun is None:
            begun = point
        elif not is_open and begun is not None:
            out.append(f"\\U{begun:08x}-\\U{point - 1:08x}")
            begun = None
    return regex.compile("[" + "".join(out) + "]")


class Codec:
    """Encoder and decoder of one worker task; made of plain values that a driver can send.

    Texts are cut by the pattern, and each distinct piece is encoded once and remembered.  A text with a character
    that is newer than Python's Unicode tables is cut by the ``tokenizers`` library's own copy of the pattern.
    """

    def __init__(self, model: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model, self.pattern = model, pattern
        self.tokenizer = Tokenizer.from_str(model)
        self.whole: Tokenizer | None = None  # a second vocabulary in memory, made for the first text that needs it
        self.split = regex.compile(pattern).findall
        self.later: regex.Pattern | None = None
        value = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab()
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in token)
        self.known: dict[str, bytes] = {}

    def _is_later(self, text: str) -> bool:
        if text.isascii() or _BEYOND.search(text) is None:
            return False
        if self.later is None:
            self.later = _later_characters()
        return self.later.search(text) is not None

    def _whole_ids(self, text: str) -> np.ndarray:
        if self.whole is None:
            self.whole = Tokenizer.from_str(self.model)
            self.whole.pre_tokenizer = pre_tokenizers.Sequence(
                [
                    pre_tokenizers.Split(Regex(self.pattern), "isolated"),
                    pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
                ]
            )
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, each match of the pattern encoded by itself."""
        apart = [self._is_later(t) for t in texts]
        pieces = [[] if x else self.split(t) for t, x in zip(texts, apart, strict=True)]
        new = set().union(*pieces).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = set().union(*pieces)
        names = list(new)
        for at in range(0, len(names), PIECES):
            some = names[at : at + PIECES]
            for piece, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[piece] = array("i", found.ids).tobytes()
        known = self.known.__getitem__
        return [
            self._whole_ids(t)
            if x
            else np.frombuffer(b"".join(map(known, p)), np.int32)
            for t, x, p in zip(texts, apart, pieces, strict=True)
        ]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that the ids stand for; unlike text, they may begin or end inside a character."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character that each token touches.

        A token that holds only a part of a character's bytes counts as touching the whole character.
        """
        data = np.frombuffer(self.decode(ids), np.uint8)
        lengths = np.array([len(self.bytes_of[i]) for i in ids], np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        return character[begins], character[ends - 1] + 1


def decode_stream(codec: Codec, ids: Iterable[int]) -> Iterator[str]:
    """Text piece by piece: bytes of a character that a token splits wait until the character is whole."""
    rest = b""
    for i in ids:
        rest += codec.bytes_of[i]
        cut = len(rest)
        for back in range(1, min(4, len(rest)) + 1):
            lead = rest[-back]
            if lead >= 0xC0:  # a lead byte: is its character complete?
                cut -= back if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else 0
                break
            if lead < 0x80:
                break
        if cut:
            yield rest[:cut].decode("utf-8", "replace")
            rest = rest[cut:]
    if rest:
        yield rest.decode("utf-8", "replace")


def _clean(text: str | None) -> str:
    return text or ""


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_name: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>, ends array<int>): tokens and the characters they touch.

    Every row gives one row; null counts as empty and gives empty lists.  Whole texts are encoded in the task that
    reads them: nothing is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        for batch in slices(rows, 64):
            ids = codec.encode([_clean(t) for t in batch.column(1).to_pylist()])
            spans = [codec.offsets(x) for x in ids]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, kind), pa.array([s[0] for s in spans], kind), pa.array([s[1] for s in spans], kind)],
                [id_name, "ids", "starts", "ends"],
            )

    of = docs.schema[id_name].dataType.simpleString()
    return only(docs, id_name, "text").mapInArrow(run, f"{id_name} {of}, ids array<int>, starts array<int>, ends array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_name: str = "doc_id") -> DataFrame:
    """(doc_id, data binary, text): the bytes of each row's ``ids``, and the text they spell.

    Null counts as no ids.  Bytes that are not UTF-8 (ids cut inside a character) become U+FFFD in the text only.
    """
    model = encoded.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        for batch in slices(rows, 64):
            data = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            text = [d.decode("utf-8", "replace") for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(text, pa.string())], [id_name, "data", "text"])

    of = encoded.schema[id_name].dataType.simpleString()
    return only(encoded, id_name, "ids").mapInArrow(run, f"{id_name} {of}, data binary, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, then decoded from the ids alone.

    ``keep_ids`` adds the ids themselves as ``ids``.

    Null and empty texts have no tokens and the digests of nothing.  Rows are independent, so repeated rows give
    equal results and an empty table an empty one.
    """
    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
    ]
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        names = [str(i) for i in range(len(codec.bytes_of))].__getitem__
        for batch in slices(rows):
            counts, marks, texts = [], [], []
            found = codec.encode([_clean(t) for t in batch.column(1).to_pylist()])
            for ids in found:
                ids = ids.tolist()
                counts.append(len(ids))
                marks.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                texts.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(marks, pa.string()), pa.array(texts, pa.string())]
            if keep_ids:
                columns.append(pa.array(found, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return only(docs, "doc_id", "text").mapInArrow(run, T.StructType(fields))
