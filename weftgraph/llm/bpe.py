"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, at places where the pre-splitting pattern always ends a match
and where no match looks across: between a character that isn't white space and an ASCII space or
line feed. Long runs of white space, over which the library's pattern engine would run out of
stack, are cut out too: the pattern takes such a run as one match, all of it at the end of the text
and all but its last character elsewhere, and that match is encoded without the pattern. So the ids
are those of the whole text, while the pattern sees bounded pieces; a run without white space of
any length stays one piece, which the pattern takes without a stack.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more characters than this are cut.
LONG = 1 << 16
#: Runs of more white space than this are encoded without the pattern.
LONG_SPACE = 1 << 12
_SAFE = regex.compile(r"(?<=\S)(?=[ \n])")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file, or of a byte-level vocabulary in JSON whose ids are its merge order."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    with open(path, encoding="utf-8") as source:
        spec = json.load(source)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a JSON vocabulary, which its library finds in texts; none in a .tiktoken file."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as source:
        return {t["content"]: t["id"] for t in json.load(source)["added_tokens"]}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path.rpartition("/")[2], pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens=added_tokens(path))


def safe_pieces(text: str, long: int = LONG) -> Iterator[str]:
    """Pieces of about ``long`` characters that are encoded one by one with the result of the whole."""
    start = 0
    while len(text) - start > long:
        cut = _SAFE.search(text, start + long)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def parts_of(text: str, long_space: int = LONG_SPACE) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match of white space): parts that are encoded one by one with the result of the whole."""
    start = 0
    for run in regex.finditer(rf"\p{{White_Space}}{{{long_space},}}+", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    yield text[start:], False


def segments(codec: tiktoken.Encoding, text: str) -> Iterator[tuple[str, int | None]]:
    """(text, None) between the vocabulary's added tokens and (token, id) for each that stands in the text."""
    start = 0
    if added := sorted(codec.special_tokens_set, key=len, reverse=True):
        for hit in regex.finditer("|".join(map(regex.escape, added)), text):
            yield text[start : hit.start()], None
            yield hit[0], codec.encode_single_token(hit[0])
            start = hit.end()
    yield text[start:], None


def encode(codec: tiktoken.Encoding, text: str, long: int = LONG, long_space: int = LONG_SPACE) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers; added tokens of the vocabulary that stand in the text are found as such."""
    ids: list[int] = []
    for segment, added in segments(codec, text):
        if added is not None:
            ids.append(added)
        elif len(segment) <= min(long, long_space):
            ids += codec.encode_ordinary(segment)
        else:
            for part, space in parts_of(segment, long_space):
                if space:
                    ids += codec._encode_single_piece(part.encode())
                else:
                    for piece in safe_pieces(part, long):
                        ids += codec.encode_ordinary(piece)
    return np.array(ids, dtype="<u4")


def decode(codec: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    """The raw bytes; they need not be valid UTF-8."""
    return codec.decode_bytes(ids.tolist())


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, round_trip: a row for each row of ``docs``.

    A null text counts as empty: no ids, and the digests of nothing. Texts of any length are encoded
    whole. Repeated rows give repeated rows, an empty table none. Other columns are ignored. The rank file is read on each executor;
    its path must be valid there.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(path, pattern)
        for b in batches:
            n, ids_sha, out_sha, size, same = [], [], [], [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                ids = encode(codec, text, long)
                out = decode(codec, ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                out_sha.append(hashlib.sha256(out).hexdigest())
                size.append(len(out))
                same.append(out == text.encode())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string()), pa.array(size, pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "round_trip"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean")


def encode_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the ids themselves, for use by other operators. Nulls as in ``encode_texts``."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(path, pattern)
        for b in batches:
            ids = [encode(codec, t.as_py() or "").astype("<i4") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(coded, "doc_id long, ids array<int>")
