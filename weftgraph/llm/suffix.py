"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Which suffixes. A 400-byte window is found by its anchor: the leftmost smallest, by its upper bits,
of the hashes of the 32-byte grams in it. Equal windows have equal anchors at equal offsets, so only anchors whose
hash occurs twice matter, and suffixes that start equal windows lie in one bucket, named by the
anchor's hash and the offset. For each such anchor occurrence the bytes of its windows are cut out
(a context); equal contexts are collapsed before anything is sorted.

Blocks. The contexts of some anchors make a block of bounded size. In it, ranks are computed for
the suffixes at a difference cover modulo 13 (Colbourn and Ling's {0, 1, 4, 6}), by doubling, up
to 208 bytes. Then the suffixes of the buckets are sorted by their first 16 bytes, and ties, which
here are long, are resolved by the ranks of the cover's suffixes that follow both: at the next
place in the cover and at the last one that still fits, then by the last 16 bytes. Contexts are
laid out with their anchors at multiples of 13, so both suffixes of a pair meet the cover at the
same distance. Neighbours that are equal throughout share a prefix of 400 bytes.

An anchor of more than ``most_contexts`` different contexts would make a block too large. Its
contexts are cropped to ranges of offsets, and a bucket is named by the bytes that all windows of
a range share, too: equal windows have them in common. Crops of near copies mostly become equal,
and collapse, or part. What is still too large is a passage's edge; its windows are counted by a
128-bit digest of their bytes, in a shuffled aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import forget, small_enough, write_out
from .substring import anchors, mix, rolling, with_lists

WINDOW = 400
GRAM = 32
COVER_MODULUS = 13
COVER = (0, 1, 4, 6)  # every difference modulo 13 occurs in it
BLOCK_BYTES = 512 << 10
MOST_CONTEXTS = 2048
RANGES = 12  # of offsets, for the crops of an anchor with more contexts
_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_GRAM_BASE = 0x9E3779B97F4A7C15
_DIGEST_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    return rolling(_BYTE_HASH[data], gram, _GRAM_BASE)


def anchor_entries(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """hash, doc_id, times for each different anchor of each row of (doc_id, text)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, ids, times = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                data = np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)
                if len(data) < window:
                    continue
                grams = gram_hashes(data, gram)
                at = anchors(grams, window - gram + 1)
                own, n = np.unique(grams[at[np.concatenate([[True], at[1:] != at[:-1]])]], return_counts=True)
                hashes.append(own)
                times.append(n)
                ids.append(np.full(len(own), doc, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(times))], ["hash", "doc_id", "times"])

    return docs.mapInArrow(found, "hash long, doc_id long, times long")


_CONTEXT = "hash long, high long, low long, anchor int, windows int, doc_id long, start long, context binary"


def contexts(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each run of windows with one anchor whose hash is in ``hashes``, of (doc_id, text, hashes).

    high, low: digest of the context and the anchor's place in it; start: place of the first window.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CONTEXT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            rows, held = [], 0
            for doc, text, wanted in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("hashes"), strict=True):
                raw = (text.as_py() or "").encode()
                if len(raw) < window:
                    continue
                grams = gram_hashes(np.frombuffer(raw, dtype=np.uint8), gram)
                at = anchors(grams, window - gram + 1)
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                last = np.concatenate([first[1:], [len(at)]])
                own = grams[at[first]].view(np.int64)
                take = np.isin(own, wanted.values.to_numpy(zero_copy_only=False))
                for h, a, lo, hi in zip(own[take].tolist(), at[first[take]].tolist(), first[take].tolist(), last[take].tolist(), strict=True):
                    body = raw[lo : hi - 1 + window]
                    digest = xxhash.xxh3_128_digest(body, seed=a - lo)
                    rows.append((h, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), a - lo, hi - lo, doc, lo, body))
                    held += len(body)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return texts.mapInArrow(cut, _CONTEXT)


def cover_tables(modulus: int = COVER_MODULUS, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """For each pair of residues the distance at which both meet the cover."""
    out = np.full((modulus, modulus), -1, dtype=np.int64)
    for d in range(modulus - 1, -1, -1):
        held = np.array([(r + d) % modulus in cover for r in range(modulus)])
        out[np.ix_(held, held)] = d
    return out


_MEET = cover_tables()


def words_at(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number that sorts as they do."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[places].copy().view(">u8").ravel().astype(np.uint64)


class CoverRanks:
    """Ranks of the suffixes at the difference cover, by their first 208 bytes."""

    def __init__(self, text: np.ndarray, modulus: int = COVER_MODULUS, cover: tuple[int, ...] = COVER, doublings: int = 4):
        """text must end with 8 bytes that no suffix needs."""
        n = len(text) - 8
        self.modulus, self.per = modulus, len(cover)
        self.slot = np.full(modulus, -1, dtype=np.int64)
        self.slot[list(cover)] = np.arange(len(cover))
        rounds = -(-n // modulus)
        places = (np.arange(rounds)[:, None] * modulus + np.array(cover)).ravel()
        inside = np.minimum(places, n - 1)
        # 13 bytes: eight, and five that overlap none of them
        tail = words_at(text, np.minimum(inside + 5, n - 1))
        order = np.lexsort((tail, words := words_at(text, inside)))
        new = np.concatenate([[0], (words[order[1:]] != words[order[:-1]]) | (tail[order[1:]] != tail[order[:-1]])])
        ranks = np.empty(len(places), dtype=np.int64)
        ranks[order] = np.cumsum(new)
        size = modulus
        for _ in range(doublings):
            step = size // modulus * self.per
            after = np.zeros_like(ranks)
            after[:-step] = ranks[step:] + 1 if step < len(ranks) else 0
            ranks = np.unique(ranks * (len(ranks) + 2) + after, return_inverse=True)[1].astype(np.int64)
            size *= 2
        self.ranks, self.size = ranks, size

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ranks at places of the cover."""
        return self.ranks[places // self.modulus * self.per + self.slot[places % self.modulus]]


def sort_buckets(text: np.ndarray, places: np.ndarray, buckets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by bucket and first ``window`` bytes, and whether each shares all of them with the one before it.

    The suffixes of a bucket must start at the same place modulo the cover's modulus. window: 221
    at least and 429 at most.
    """
    ranks = CoverRanks(text)
    residue = places % ranks.modulus
    near = places + _MEET[residue, residue]
    far = near + (places + window - ranks.size - near) // ranks.modulus * ranks.modulus
    keys = [buckets, words_at(text, places), words_at(text, places + 8), ranks.at(near), ranks.at(far), words_at(text, places + window - 16), words_at(text, places + window - 8)]
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(places), dtype=bool)
    if len(places):
        same[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    return order, same


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def repeats_in_block(block: list[tuple[int, int, bytes]], window: int = WINDOW) -> list[np.ndarray]:
    """For each (anchor number, anchor's place, context), which of its windows occur in another context too."""
    gap = COVER_MODULUS
    parts, starts, at = [], [], 0
    for _, anchor, body in block:
        pad = -(at + anchor) % gap
        parts += [bytes(pad), body]
        starts.append(at + pad)
        at += pad + len(body)
    text = np.frombuffer(b"".join([*parts, bytes(16)]), dtype=np.uint8)
    counts = np.array([len(body) - window + 1 for _, _, body in block])
    owner = np.repeat(np.arange(len(block)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = np.array(starts)[owner] + inner
    anchor_number, anchor = (np.array([x[i] for x in block])[owner] for i in (0, 1))
    buckets = anchor_number * window + (anchor - inner)
    order, same = sort_buckets(text, places, buckets, window)
    again = same.copy()
    again[:-1] |= same[1:]
    flags = np.zeros(len(places), dtype=bool)
    flags[order[again]] = True
    return np.split(flags, np.cumsum(counts)[:-1])


_FOUND = "high long, low long, first int, last int"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["high", "low", "first", "last"])


def sort_blocks(several: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """high, low, first, last: runs of windows that other contexts of the same anchor repeat."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        block, held, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("hash", "high", "low", "anchor", "context")), strict=True):
                if row[0] != last and held >= block_bytes:
                    yield block
                    block, held = [], 0
                last = row[0]
                block.append(row)
                held += len(row[4])
        if block:
            yield block

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            numbers = np.unique([r[0] for r in block], return_inverse=True)[1].tolist()
            flags = repeats_in_block([(k, r[3], r[4]) for k, r in zip(numbers, block, strict=True)], window)
            if rows := [(r[1], r[2], lo, hi) for r, f in zip(block, flags, strict=True) for lo, hi in _runs(f)]:
                yield _found(rows)

    return several.repartition("hash").sortWithinPartitions("hash").mapInArrow(sort, _FOUND)


def count_windows(several: DataFrame, window: int) -> DataFrame:
    """The same for anchors of very many contexts, by digests of the windows."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for high, low, body in zip(b.column("high").to_pylist(), b.column("low").to_pylist(), b.column("context").to_pylist(), strict=True):
                one, two = (rolling(_BYTE_HASH[np.frombuffer(body, dtype=np.uint8)], window, base).view(np.int64) for base in _DIGEST_BASES)
                n = len(one)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(n, high)), pa.array(np.full(n, low)), pa.array(np.arange(n, dtype=np.int32))], ["one", "two", "high", "low", "first"])

    windows = several.mapInArrow(explode, "one long, two long, high long, low long, first int")
    again = windows.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return windows.join(again, ["one", "two"]).select("high", "low", "first", F.col("first").alias("last"))


_CROP = "hash long, high long, low long, anchor int, windows int, context binary, up_high long, up_low long, shift int"


def crop(large: DataFrame, window: int, gram: int, ranges: int) -> DataFrame:
    """A row for each context and range of offsets that it has windows in; shift: the crop's first window in the context."""
    most = window - gram
    wide = -(-(most + 1) // ranges)
    names = [x.split()[0] for x in _CROP.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]

    def cropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for key, high, low, a, body in zip(*(b.column(c).to_pylist() for c in ("hash", "high", "low", "anchor", "context")), strict=True):
                for r in range(ranges):
                    least, largest = r * wide, min((r + 1) * wide - 1, most)
                    first, last = max(0, a - largest), min(len(body) - window, a - least)
                    if first > last:
                        continue
                    own = body[first : last + window]
                    core = xxhash.xxh3_64_intdigest(body[a - least : a - largest + window], seed=r) ^ (key & 0xFFFFFFFFFFFFFFFF)
                    digest = xxhash.xxh3_128_digest(own, seed=(a - first) * ranges + r)
                    two = (int.from_bytes(digest[i : i + 8], "big", signed=True) for i in (0, 8))
                    rows.append((core - (1 << 64) if core >> 63 else core, *two, a - first, last - first + 1, own, high, low, first))
                    held += len(own)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return large.mapInArrow(cropped, _CROP)


def distinct_contexts(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of contexts that occur twice; and the distinct contexts of anchors with several, with their number ``kinds``."""
    kinds = write_out(cut.groupBy("hash", "high", "low", "windows").agg(F.count("*").alias("n")), "suffix-kinds")
    by_anchor = write_out(kinds.groupBy("hash").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "suffix-several")
    several = cut.join(by_anchor, "hash").groupBy("hash", "high", "low", "anchor", "context", "kinds").agg(F.count("*").alias("n")).drop("n")
    whole = kinds.filter("n > 1").select("high", "low", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    return whole, write_out(several, "suffix-several")


def runs_of_large(large: DataFrame, window: int, gram: int, block_bytes: int, most_contexts: int, ranges: int) -> DataFrame:
    """high, low, first, last for the contexts of anchors that have too many for a block."""
    crops = write_out(crop(large, window, gram, ranges), "suffix-crops")
    whole, several = distinct_contexts(crops.drop("up_high", "up_low", "shift"))
    runs = whole.union(sort_blocks(several.filter(F.col("kinds") <= most_contexts), window, block_bytes)).union(count_windows(several.filter(F.col("kinds") > most_contexts), window))
    back = crops.select("high", "low", "up_high", "up_low", "shift").join(runs, ["high", "low"])
    return back.select(F.col("up_high").alias("high"), F.col("up_low").alias("low"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, most_contexts: int = MOST_CONTEXTS, ranges: int = RANGES) -> DataFrame:
    """doc_id, spans: runs (first and last place) of windows that also start anywhere else. ids of ``texts`` are unique and not null."""
    entries = write_out(anchor_entries(texts, window, gram), "suffix-anchors")
    # written first, so that AQE may split the join by skew
    again = write_out(entries.groupBy("hash").agg(F.sum("times").alias("n")).filter("n > 1").select("hash"), "suffix-again")
    per_doc = write_out(entries.select("hash", "doc_id").join(again, "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("hashes")), "suffix-hashes")
    ids = per_doc.select("doc_id")
    meeting = texts.join(small_enough(ids), "doc_id", "left_semi").join(per_doc, "doc_id")
    cut = write_out(contexts(meeting.select("doc_id", "text", "hashes"), window, gram), "suffix-contexts")

    whole, several = distinct_contexts(cut.select("hash", "high", "low", "anchor", "windows", "context"))
    sorted_runs = sort_blocks(several.filter(F.col("kinds") <= most_contexts), window, block_bytes)
    large = runs_of_large(several.filter(F.col("kinds") > most_contexts), window, gram, block_bytes, most_contexts, ranges)
    runs = write_out(whole.union(sorted_runs).union(large), "suffix-runs")
    forget(entries, again, per_doc, several)

    placed = cut.select("high", "low", "doc_id", "start").join(runs, ["high", "low"])
    span = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    return placed.groupBy("doc_id").agg(F.collect_list(span).alias("spans"))


def without(raw: bytes, first: np.ndarray, last: np.ndarray, window: int) -> tuple[bytes, int]:
    """What is left of a text, and how many maximal runs were removed."""
    fits = last <= len(raw) - window
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(edge, first[fits], 1)
    np.add.at(edge, last[fits] + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(raw, dtype=np.uint8)[~covered].tobytes(), len(_runs(covered))


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, most_contexts: int = MOST_CONTEXTS, with_text: bool = True, with_row: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``.

    with_text adds ``kept_text``: the bytes left as text, without characters of which a part was
    removed; null for a null text. with_row adds ``row``: the row's other columns as a struct.

    Every byte goes that lies in a ``window``-byte string which also starts anywhere else, in the
    first place and all others. A null text is empty. Texts of fewer bytes lose nothing. A text of
    any length is read whole by one task, whose memory holds some fifty times its bytes; what is
    sorted is cut into contexts of bounded size. A
    repeated row is an occurrence of its own, so rows that repeat lose what they share. Rows with
    a null id are returned whole and never compared. An empty table gives no rows. Other columns
    don't matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.struct(*(c for c in docs.columns if c != text_col)).alias("row")] * with_row)
    spans = repeated_spans(rows.select("doc_id", "text").filter("doc_id is not null"), window, gram, block_bytes, most_contexts)
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    if with_row:
        schema.add("row", rows.schema["row"].dataType)
    names = schema.names

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, own in zip(b.column("text"), b.column("spans"), strict=True):
                raw = (text.as_py() or "").encode()
                left, n = raw, 0
                if own.is_valid:
                    first, last = (own.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    left, n = without(raw, first, last, window)
                out.append((len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest()) + ((left.decode(errors="ignore") if text.is_valid else None,) if with_text else ()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * (4 + with_text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), *([b.column("row")] if with_row else [])], names)

    return with_lists(rows, write_out(spans, "suffix-spans"), "spans").select("doc_id", "text", "spans", *["row"] * with_row).mapInArrow(kept, schema)
