"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints link at two or fewer differing bits. A fingerprint is cut into three segments; two
errors leave one of them whole, so for each segment a key joins its exact bits with a Golay index
of the 23 bits that follow it (cyclically). The perfect (23, 12) Golay code maps each 23-bit word
to the one codeword within three errors; a word's indices are those of itself and of its 23
neighbours, one or six of them. Words at distance two have a neighbour in common, so they share an
index: the keys lose no link. Candidates are verified by counting bits.

Rows with equal fingerprints are one class from the start. Keys that more than ``pair_limit``
classes share are resolved without pairs: each of their fingerprints is sent to itself and its 64
neighbours, and two fingerprints at distance two or less meet at a neighbour, where at most 65
can meet. So no group of any size gives more than a bounded number of rows for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import forget, write_out

SEED = 42
SHINGLE = 3
PAIR_LIMIT = 64
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_PARTS = ((0, 22), (22, 21), (43, 21))  # lowest bit and width of the exact segments
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; fewer words are one shingle, none give none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    stops, starts = (ends[k - 1 :] - 1).tolist(), [0, *ends[: len(words) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    seen = hashes.view(np.uint8).reshape(n, 8)
    if n < 64:
        votes = np.unpackbits(seen, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.bincount((seen + (np.arange(8, dtype=np.int64) << 8)).ravel(), minlength=2048).reshape(8, 256)
        votes = (counts @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= _GENERATOR << (i - 11)
    return word


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error of each syndrome (three bits at most)."""
    one = [_remainder(1 << i) for i in range(23)]

    def syndromes(bits: list[int]) -> np.ndarray:
        table = np.zeros(1, dtype=np.int32)
        for s in bits:
            table = np.concatenate([table, table ^ s])
        return table

    errors = np.zeros(2048, dtype=np.int32)
    for a in range(23):
        errors[one[a]] = 1 << a
        for b in range(a):
            errors[one[a] ^ one[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[one[a] ^ one[b] ^ one[c]] = 1 << a | 1 << b | 1 << c
    return syndromes(one[:12]), syndromes(one[12:]), errors


_LOW, _HIGH, _ERRORS = _golay_tables()


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    return (words ^ _ERRORS[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each key of each unsigned 64-bit fingerprint."""
    rows, keys = [], []
    flips = np.array([0, *(1 << i for i in range(23))], dtype=np.int32)
    for part, (low, width) in enumerate(_PARTS):
        exact = (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
        turn = (low + width) % 64
        turned = (prints >> np.uint64(turn)) | (prints << np.uint64(64 - turn)) if turn else prints
        word = (turned & np.uint64((1 << 23) - 1)).astype(np.int32)
        found = np.sort(golay_index(word[:, None] ^ flips), axis=1)
        new = np.ones(found.shape, dtype=bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        row, at = np.nonzero(new)
        rows.append(row)
        keys.append((np.int64(part) << 34) | (found[row, at].astype(np.int64) << 22) | exact[row].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each row of ``docs``."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(shingle_hashes(t.as_py(), shingle)) for t in b.column("text")], dtype="<u8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view("<i8"))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(printed, "doc_id long, fp long")


def _near(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2


def links(classes: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """a, b: links between distinct fingerprints, enough of them for every component.

    classes: distinct fingerprints ``fp``, written out.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column("fp").to_numpy(zero_copy_only=False)
            row, key = fuzzy_keys(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row])], ["key", "fp"])

    keys = write_out(classes.select("fp").mapInArrow(keyed, "key long, fp long"), "simhash-keys")
    sizes = write_out(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    shared = write_out(keys.join(sizes, "key"), "simhash-shared")

    few = shared.filter(F.col("n") <= pair_limit).groupBy("key").agg(F.collect_list("fp").alias("held"))  # at most pair_limit each
    pairs = few.select(F.explode("held").alias("a"), "held").select("a", F.explode("held").alias("b"))
    near = pairs.filter((F.col("a") < F.col("b")) & _near("a", "b"))

    many = shared.filter(F.col("n") > pair_limit).select("fp").distinct()
    one = F.lit(1).cast("long")
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i))))
    meets = many.select("fp", F.explode(around).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("held")).filter(F.size("held") > 1)
    stars = meets.select(F.array_min("held").alias("a"), F.explode("held").alias("b")).filter("a < b")
    found = write_out(near.union(stars).distinct(), "simhash-found")
    forget(keys, sizes, shared)
    return found


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id: a row for each row of ``docs``.

    Texts without words, null texts among them, have fingerprint zero and are linked like any
    other. A text of any length is one row of one task, whose memory holds some ten times its
    bytes; nothing is cut off. Repeated rows share a class. Null ids never name a component,
    unless it has no other. An empty table gives no rows. Other columns are ignored.
    """
    printed = write_out(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    classes = write_out(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    linked = write_out(links(classes, pair_limit), "simhash-links")
    placed = classes.join(components(linked), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # written, so that both sides of the join with all rows are dealt for it alone and AQE may split a hot fingerprint
    by_print = write_out(placed.join(named, "root").select("fp", "component_id"), "simhash-named")
    forget(classes, linked)
    return printed.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
