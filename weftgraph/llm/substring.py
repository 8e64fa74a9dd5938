"""Incremental substring dedup with a log-structured index of window hashes.

Fingerprints. A text's words are hashed, and 8-word grams by a polynomial of them. Of the 13 grams
in a 20-word window the leftmost smallest is its anchor, so equal windows have equal anchors at
equal places. The windows of a text that share an anchor are a context: a row (hash of the anchor,
128-bit digest of all words of the context, doc_id, first place, number of windows). There is about
one for every seven words.

Runs. Documents come in batches by ascending doc_id. The contexts of a batch are written once and
never changed. Beside them goes a run: the different hashes of the batch with their numbers, in one
sorted file for each bucket of hashes. A batch's run is merge-joined with the
earlier runs, bucket by bucket as they lie, without an exchange or a sort; hashes found twice are
its candidates. When ``fan_in`` runs have gathered they are merged into one, in the same way, and
later batches read the merged run. A run has one row for a hash, however many places it has; the
places are joined with the candidates in a join that AQE may split.

Verification. Of equal contexts the first stays, the others go whole. Where an anchor has contexts
that differ, the texts with the first of each are read again, and the contexts are taken apart into
windows, each with a 128-bit digest of its twenty words; the first place of each digest is kept. So
a window is removed only if all of its words were seen before.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import CLEANUP, delete, forget, fresh_path, is_small, settings, small_enough, write_out

WINDOW = 20
GRAM = 8
BATCHES = 4
FAN_IN = 2
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of each ``width`` consecutive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, part, power, size = None, 0, values, base, 1
    while True:
        if width & size:
            shifted = part[done : done + n]
            out = shifted.copy() if out is None else out * np.uint64(power) + shifted
            done += size
        if 2 * size > width:
            return mix(out)
        part = part[:-size] * np.uint64(power) + part[size:]
        power, size = power * power & 0xFFFFFFFFFFFFFFFF, 2 * size


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) of each ``width`` consecutive values."""
    part, size = values, 1
    while 2 * size <= width:
        part, size = pick(part[:-size], part[size:]), 2 * size
    return pick(part[: len(part) - (width - size)], part[width - size :]) if width > size else part


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each ``width`` consecutive values."""
    at = np.arange(len(values), dtype=np.int64)

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    size = 1
    while 2 * size <= width:
        at, size = better(at[:-size], at[size:]), 2 * size
    return better(at[: len(at) - (width - size)], at[width - size :]) if width > size else at


_PLACE_BITS = np.uint64((1 << 24) - 1)


def anchors(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost of those with the smallest upper 40 bits among each ``width`` consecutive values."""
    upper = values & ~_PLACE_BITS
    if len(values) > int(_PLACE_BITS):
        return leftmost_least(upper, width)
    return (sliding(upper | np.arange(len(values), dtype=np.uint64), width, np.minimum) & _PLACE_BITS).astype(np.int64)


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Joined:
    """The words of several texts laid end to end: two hashes of each, the text that it is in, and where texts start."""

    def __init__(self, texts: list[str | None], window: int):
        held = [words_in(t) for t in texts]
        counts = np.array([len(w) for w in held], dtype=np.int64)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, itertools.chain.from_iterable(held))), dtype="<u8").reshape(-1, 2)
        self.one, self.two = (np.ascontiguousarray(digests[:, i]) for i in (0, 1))
        self.owner, self.starts, self.window = np.repeat(np.arange(len(held)), counts), np.cumsum(counts) - counts, window

    def whole(self) -> np.ndarray:
        """Places of the windows that lie in one text."""
        return np.flatnonzero(self.owner[: max(0, len(self.owner) - self.window + 1)] == self.owner[self.window - 1 :])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the window at each place."""
        return rolling(self.one, self.window, _BASES[0]), rolling(self.two, self.window, _BASES[1])


CONTEXT = "hash long, high long, low long, doc_id long, place int, n int"


def contexts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each run of windows with one leftmost anchor, of (doc_id, text): its hash, digest, first place and length."""
    width, (one, two) = window - gram + 1, (np.uint64(b) for b in _BASES)
    names = [x.split()[0] for x in CONTEXT.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = Joined(b.column("text").to_pylist(), window)
            places = held.whole()
            if not len(places):
                continue
            grams = rolling(held.one, gram, _BASES[0])
            at = anchors(grams, width)[places]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            n = np.diff(np.concatenate([first, [len(at)]]))
            at, first = at[first], places[first]
            # the first and the last window hold all words of the run between them
            digests = (mix(x[first] * one + x[first + n - 1] * two + n.astype(np.uint64)).view(np.int64) for x in held.digests())
            own = held.owner[first]
            columns = (grams[at].view(np.int64), *digests, b.column("doc_id").to_numpy(zero_copy_only=False)[own], (first - held.starts[own]).astype(np.int32), n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return docs.mapInArrow(found, CONTEXT)


#: A file of a bucket counts as sorted if it is the only one.
_SORTED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
#: A task of the aggregation is a bucket, so that a bucket is one file.
_WHOLE = {"spark.sql.adaptive.coalescePartitions.enabled": "false", CLEANUP: "true"}


class WindowIndex:
    """The runs, newest last, and the batches' contexts. A run is a table of (hash, n), in buckets and sorted by hash, never changed."""

    def __init__(self, spark: SparkSession, address: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.address, self.fan_in = spark, address or fresh_path(spark, "window-index"), fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.batches: list[DataFrame] = []
        self.merges = 0

    def _write(self, hashes: DataFrame) -> str:
        name = f"window_run_{uuid.uuid4().hex}"
        with settings(self.spark, _SORTED | _WHOLE):
            hashes.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.address}/{name}").saveAsTable(name, format="parquet")
        return name

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name).hint("merge")

    def add(self, found: DataFrame) -> DataFrame:
        """Add a batch of contexts; returns those, old and new, whose hash is in the batch and occurs twice or more."""
        self.batches.append(write_out(found, "window-contexts"))
        old = list(self.runs)
        self.runs.append(self._write(self.batches[-1].groupBy("hash").agg(F.count("*").alias("n"))))
        again, known = self.run(self.runs[-1]), F.lit(False)
        for i, name in enumerate(old):
            again = again.join(self.run(name).select("hash", F.lit(True).alias(f"known{i}")), "hash", "left")
            known = known | F.coalesce(f"known{i}", F.lit(False))
        with settings(self.spark, _SORTED):
            again = write_out(again.filter((F.col("n") > 1) | known).select("hash"), "window-again")
        held = self.spark.read.schema(CONTEXT).parquet(*(b.scratch_path for b in self.batches))
        out = write_out(held.join(small_enough(again), "hash"), "window-candidates")
        forget(again)
        return out

    def compact(self) -> None:
        """Merge all runs into one if there are ``fan_in`` or more."""
        if len(self.runs) < max(2, self.fan_in):
            return
        first, *rest = (self.run(name) for name in self.runs)
        for r in rest:
            first = first.withColumnRenamed("n", "m").join(r, "hash", "full").select("hash", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
        merged = self._write(first)
        self._drop(self.runs)
        self.runs = [merged]
        self.merges += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.address}/{name}")

    def drop(self) -> None:
        """Delete the index."""
        self._drop(self.runs)
        forget(*self.batches)
        self.runs, self.batches = [], []


def _texts_with(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc_id, text, own) of the documents in ``lists`` (doc_id, own), a written table. Other texts aren't shuffled if the ids are few."""
    return texts.join(small_enough(lists.select("doc_id")), "doc_id", "left_semi").join(lists, "doc_id").select("doc_id", "text", "own")


def with_lists(rows: DataFrame, lists: DataFrame, own: str = "own") -> DataFrame:
    """``rows`` with the list of their doc_id, or null. If the ids in ``lists``, a written table, are few, only their rows are shuffled."""
    none = F.lit(None).cast(lists.schema[own].dataType).alias(own)
    if not is_small(lists.select("doc_id")):
        return rows.join(lists, "doc_id", "left")
    ids = F.broadcast(lists.select("doc_id"))
    return rows.join(ids, "doc_id", "left_semi").join(lists, "doc_id").unionByName(rows.join(ids, "doc_id", "left_anti").select("*", none))


def windows_in(texts: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """high, low, doc_id, place for each window of the runs in ``firsts`` (doc_id, place, n)."""
    per_doc = write_out(firsts.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("own")), "window-runs")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = Joined(b.column("text").to_pylist(), window)
            high, low = held.digests()
            runs, owner = pc.list_flatten(b.column("own")), pc.list_parent_indices(b.column("own")).to_numpy(zero_copy_only=False)
            place, n = (runs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            at = np.repeat(place + held.starts[owner], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            inside = at < len(high)  # a text of repeated rows may be shorter than the one that the run was found in
            at, owner = at[inside], np.repeat(owner, n)[inside]
            one_text = (held.owner[at] == owner) & (held.owner[at + window - 1] == owner)
            at = np.unique(at[one_text])
            own = held.owner[at]
            columns = (high[at].view(np.int64), low[at].view(np.int64), b.column("doc_id").to_numpy(zero_copy_only=False)[own], (at - held.starts[own]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["high", "low", "doc_id", "place"])

    return _texts_with(texts, per_doc).mapInArrow(found, "high long, low long, doc_id long, place int")


_PLACE = ("doc_id", "place")


def later_places(texts: DataFrame, held: DataFrame, low: int, window: int) -> DataFrame:
    """doc_id, own: runs (place, n) of windows, in documents from ``low`` on, whose words also start earlier; ``held`` are the contexts of candidates."""
    kinds = write_out(held.groupBy("hash", "high", "low").agg(F.min(F.struct(*_PLACE, "n")).alias("first"), F.count("*").alias("times")), "window-kinds")
    again = kinds.filter("times > 1").select("hash", "high", "low", "first")
    whole = held.filter(F.col("doc_id") >= low).join(again, ["hash", "high", "low"]).filter(F.struct(*_PLACE) != F.struct("first.doc_id", "first.place"))
    whole = write_out(whole.select(*_PLACE, "n"), "window-whole")
    forget(held)

    # written, so that AQE may split the join of a hot hash
    differing = write_out(kinds.groupBy("hash").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("hash"), "window-differing")
    windows = write_out(windows_in(texts, kinds.join(differing, "hash").select("first.*"), window), "windows")
    first = windows.groupBy("high", "low").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    single = windows.filter(F.col("doc_id") >= low).join(first, ["high", "low"]).filter(F.struct(*_PLACE) != F.col("first"))
    runs = whole.unionByName(single.select(*_PLACE, F.lit(1).alias("n")))
    out = write_out(runs.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("own")), "window-later")
    forget(kinds, whole, differing, windows)
    return out


def repeated_windows(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: WindowIndex | None = None) -> DataFrame:
    """doc_id, own: runs (place, n) of the windows of each text whose words also start earlier; one row for each document.

    texts: (doc_id, text) without null ids. They go into the index in ``batches`` ranges of doc_id.
    """
    own = index or WindowIndex(texts.sparkSession)
    ends = texts.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if ends.a is None:
        return texts.sparkSession.createDataFrame([], "doc_id long, own array<struct<place:int,n:int>>")
    bounds = [ends.a + (ends.b - ends.a + 1) * i // batches for i in range(batches + 1)]
    found = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = texts.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        held = own.add(contexts(part, window, gram))
        # texts of the batch and the older ones that they meet; what goes from the latter was settled by their own batch
        found.append(later_places(texts.filter(F.col("doc_id") < high), held, low, window))
        if high < bounds[-1]:
            own.compact()  # the next batch reads the merged run
    if index is None:
        own.drop()
    return texts.sparkSession.read.schema(found[0].schema).parquet(*(f.scratch_path for f in found))


def without(words: list[bytes], place: np.ndarray, n: np.ndarray, window: int) -> list[bytes]:
    """The words that no window of the runs covers."""
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    fits = place + n + window - 1 <= len(words)
    np.add.at(edge, place[fits], 1)
    np.add.at(edge, (place + n + window - 1)[fits], -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: WindowIndex | None = None, with_text: bool = True
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text: the kept words with one space between): a row for each row of ``docs``.

    A window is removed if its words also start in a document of smaller id, or earlier in its
    own. Null texts have no words. Texts of fewer than ``window`` words lose nothing. A text of any
    length is read whole by one task, whose memory holds some twenty times its bytes. Rows that
    repeat an id are one document: a repeated row isn't held against its like, each is returned,
    and the places to remove are those found in any of them. Rows with a null id are returned
    whole and never compared. An empty table gives no rows. Other columns are ignored. An ``index``
    that is given keeps its runs for later calls; otherwise it is deleted at the end.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = repeated_windows(rows.filter("doc_id is not null"), window, gram, batches, index)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, at in zip(b.column("text"), b.column("own"), strict=True):
                words = words_in(text.as_py())
                left = without(words, *(at.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)), window) if at.is_valid else words
                body = b" ".join(left)
                out.append((len(words), len(words) - len(left), hashlib.sha256(body).hexdigest()) + ((body.decode(),) if with_text else ()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * (3 + with_text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], [x.split()[0] for x in schema.split(", ")])

    return with_lists(rows, found).mapInArrow(kept, schema)
