"""SimHash near-dedup at a stated similarity: fuzzy keys, join, and verification by the shingles themselves.

The similarity of two texts is that of their sets of word shingles, which are held as sorted 64-bit
hashes: shared shingles over all shingles of both. Texts with equal sets are one class.

Candidates come from two kinds of keys. The first are those of ``simhash``: a 64-bit SimHash of the
shingles, a Golay index for each segment, so that all pairs of two differing bits or fewer meet.
Most pairs at a similarity of 0.8 differ in more (13 of 64 bits are expected), and longer
fingerprints either meet by chance or lose pairs as the corpus grows. So there are MinHash keys of
the same shingles, too: a key is the hash of ``ROWS`` minima, and a document has ``BANDS`` of them.
Two documents of similarity s share one with the probability 1 - (1 - s^6)^32, which is 0.99994 at
0.8 and doesn't depend on the number of documents. Those keys have 64 bits, so documents without
common shingles meet by chance in a corpus of no practical size.

Every candidate is confirmed by its similarity before it is a link. Buckets with the same members
are looked at once. Keys are counted alone first, and only rows whose key came twice are shuffled with
their members; texts are read again only for those. A bucket of up to ``block`` members is compared as one group, which gives at
most one link for each member, enough for its components. The members of a larger one are first
held against one of them. Mostly that joins nearly all into one component; those outside of it are
then compared with all members, block by block. So a group of near copies costs rows in proportion
to its size, and still no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import forget, perhaps_in, write_out
from .simhash import fingerprint, fuzzy_keys
from .substring import mix, rolling, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 6
BANDS = 32
BLOCK = 1024
_BASE = 0x9E3779B97F4A7C15
_SCALES, _SHIFTS = ((mix(np.arange(i, i + ROWS * BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1) for i in (1, 1 << 20))
_CLASS = ["d0", "d1"]


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """A hash of each shingle of lower-cased words, repeats included, by a polynomial of the words' hashes; fewer words are one shingle, none give none."""
    words = (text or "").encode().lower().split()
    return rolling(word_hashes(words, 0), min(shingle, len(words)), _BASE) if words else np.empty(0, dtype="<u8")


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different word shingles of a text as sorted hashes."""
    return np.unique(shingle_hashes(text, shingle)).astype("<u8")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The MinHash key of each band; none without shingles."""
    if not len(hashes):
        return np.empty(0, dtype="<u8")
    half = (hashes >> np.uint64(32)).astype(np.uint32)  # numbers of 32 bits are multiplied several at a time
    least = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, dtype=np.uint32)
    room = np.empty((128, ROWS * BANDS), dtype=np.uint32)
    for i in range(0, len(half), 128):
        part = half[i : i + 128, None]
        own = np.multiply(part, _SCALES, out=room[: len(part)])
        own += _SHIFTS
        np.minimum(least, own.min(axis=0), out=least)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for row in least.reshape(ROWS, BANDS).astype(np.uint64):
        key = mix(key ^ row)
    return key.astype("<u8")


def keys_of(texts: list[np.ndarray], sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each text the Golay keys of the SimHash of its shingles, repeats included, and the MinHash keys of their set; none without shingles.

    A Golay key has 36 bits, and one in 2^28 MinHash keys no more; such a chance partner is refused when it is confirmed.
    """
    row, key = fuzzy_keys(np.array([fingerprint(h) for h in texts], dtype=np.uint64))
    order = np.argsort(row, kind="stable")
    golay = np.split(key[order].astype("<u8"), np.searchsorted(row[order], np.arange(1, len(texts))))
    return [np.concatenate([g, band_keys(s)]) if len(s) else np.empty(0, dtype="<u8") for g, s in zip(golay, sets, strict=True)]


def overlaps(held: list[np.ndarray]):
    """A function of a member's number that gives the similarity of its set to each of the sets held; none may be empty."""
    sizes = np.array([len(h) for h in held])
    ends = np.cumsum(sizes)
    found, codes = np.unique(np.concatenate(held), return_inverse=True)

    def similarity(k: int) -> np.ndarray:
        mark = np.zeros(len(found), dtype=bool)
        mark[codes[ends[k] - sizes[k] : ends[k]]] = True
        shared = np.add.reduceat(mark[codes], ends - sizes, dtype=np.int64)
        return shared / (sizes + sizes[k] - shared)

    return similarity


def group_links(nodes: np.ndarray, held: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """At most one link for each member, enough for the group's components."""
    similarity = overlaps(held)
    waiting = np.ones(len(nodes), dtype=bool)
    out = []
    for i in range(len(nodes)):
        if not waiting[i]:
            continue
        # grow the component of i breadth-first over those that aren't placed yet
        front = [i]
        waiting[i] = False
        while front and waiting.any():
            k = front.pop()
            hit = np.flatnonzero(waiting & (similarity(k) >= least))
            waiting[hit] = False
            front += hit.tolist()
            out += [(int(nodes[k]), int(nodes[h])) for h in hit]
    return out


def cross_links(nodes: np.ndarray, labels: np.ndarray, held: list[np.ndarray], odd: np.ndarray, least: float) -> list[tuple[int, int]]:
    """For each odd member a link to each component that it is near to."""
    similarity = overlaps(held)
    out = []
    for k in np.flatnonzero(odd):
        hit = np.flatnonzero((labels != labels[k]) & (similarity(k) >= least))
        first = np.unique(labels[hit], return_index=True)[1]
        out += [(int(nodes[k]), int(nodes[h])) for h in hit[first]]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of ``group``, by which the batches are sorted."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        own = b.column("group").to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, z in zip(bounds, bounds[1:], strict=False):
            if waiting and waiting[0].column("group")[0].as_py() != own[a]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(b.slice(a, z - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in column.to_pylist()]


_LINK = "a long, b long"


def _ordered(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    two = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(two[:, i])) for i in (0, 1)], ["a", "b"])


def _linked_in_groups(rows: DataFrame, of_group) -> DataFrame:
    """Links that ``of_group`` finds among the rows of each ``group``; groups are streamed, one at a time in memory."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for group in _groups(batches):
            pairs += of_group(group)
            if len(pairs) >= 4096:
                yield _batch(pairs)
                pairs = []
        yield _batch(pairs)

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(linked, _LINK)


def links_of_small(sets: DataFrame, least: float) -> DataFrame:
    """Links within buckets that are one group each, named by the ``groups`` of the sets."""

    def of_group(group: pa.Table) -> list[tuple[int, int]]:
        return group_links(group["node"].to_numpy(), _sets(group["held"]), least)

    return _linked_in_groups(sets.select(F.explode("groups").alias("group"), "node", "held"), of_group)


def links_to_leaders(large: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Each member of a large bucket with that of the smallest hash, if they are near.

    The hash is the same in all buckets, so a group that shares many of them has few leaders, and
    a member few different pairs.
    """

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column("held").to_pylist(), b.column("lead_held").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared / (len(x) + len(y) - shared) >= least)
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    pairs = write_out(large.filter(F.col("node") != F.col("lead")).select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "similar-pairs")
    first, second = (perhaps_in(sets.select(F.col("node").alias(e), F.col("held").alias(h)), e, pairs) for e, h in (("a", "held"), ("b", "lead_held")))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "held", "lead_held").mapInArrow(confirmed, _LINK)


def links_of_odd(large: DataFrame, sets: DataFrame, roots: DataFrame, least: float, block: int) -> DataFrame:
    """Links of the members outside of their bucket's largest component with all others of the bucket."""
    labelled = write_out(large.join(roots, "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("label")), "similar-labelled")
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("held"))
    top = counts.groupBy("key").agg(F.max_by("label", F.struct("held", "label")).alias("top"), F.max("held").alias("most"))
    marked = labelled.join(write_out(top, "similar-top"), "key").filter(F.col("most") < F.col("n"))
    odd = F.col("label") != F.col("top")
    blocks, odd_blocks = F.ceil(F.col("n") / block), F.ceil((F.col("n") - F.col("most")) / block)
    own = lambda count: F.pmod(F.xxhash64("node", "key"), count)
    every = lambda count: F.sequence(F.lit(0).cast("long"), count - 1)
    # group (i, j): odd members of part i, all members of part j
    first = marked.filter(odd).select("key", own(odd_blocks).alias("i"), F.explode(every(blocks)).alias("j"), "node", "label", F.lit(True).alias("asks"))
    second = marked.select("key", F.explode(every(odd_blocks)).alias("i"), own(blocks).alias("j"), "node", "label", F.lit(False).alias("asks"))
    both = first.unionByName(second).select(F.xxhash64("key", "i", "j").alias("group"), "node", "label", "asks")

    def of_group(group: pa.Table) -> list[tuple[int, int]]:
        return cross_links(group["node"].to_numpy(), group["label"].to_numpy(), _sets(group["held"]), group["asks"].to_numpy(), least)

    return _linked_in_groups(both.join(sets, "node").select("group", "node", "label", "asks", "held"), of_group)


def sets_of(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, held, groups: the shingles of the wanted classes (node, d0, d1, groups), made again from one text of each, so that no table holds those of all texts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [shingle_set(t, shingle).tobytes() for t in b.column("text").to_pylist()]
            own = [xxhash.xxh3_128_digest(r) == np.array(d, dtype="<i8").tobytes() for r, d in zip(raws, zip(*(b.column(c).to_pylist() for c in _CLASS), strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(raws, pa.binary()), b.column("groups")], ["node", "held", "groups"]).filter(pa.array(own, pa.bool_()))

    one = perhaps_in(texts.withColumnRenamed("doc_id", "node"), "node", wanted).join(wanted, "node").dropDuplicates()
    return one.mapInArrow(made, "node long, held binary, groups array<long>")


def similar_components(texts: DataFrame, classes: DataFrame, keyed: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """node, root of each class that is linked to another.

    texts: (doc_id, text); classes: (node, d0, d1); keyed: (node, d0, keys) of the same, deleted here. Both were written out.
    """
    keys = keyed.select(F.explode("keys").alias("key"), "node", "d0")
    again = write_out(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "similar-again")
    met = write_out(perhaps_in(keys, "key", again).join(again, "key"), "similar-met")
    forget(keyed, again)
    # buckets with the same members have the same count and digests; one of them stays
    sizes = met.groupBy("key", "n").agg(F.bit_xor("d0").alias("x"), F.bit_xor(F.xxhash64("d0")).alias("y"), F.min_by("node", F.xxhash64("node")).alias("lead"))
    sizes = sizes.groupBy("n", "x", "y").agg(F.min_by(F.struct("key", "lead"), "key").alias("k"))
    sizes = write_out(sizes.select("k.key", "k.lead"), "similar-sizes")
    shared = write_out(met.join(sizes, "key").select("key", "n", "lead", "node"), "similar-shared")
    forget(met, sizes)
    groups = shared.groupBy("node").agg(F.collect_set(F.when(F.col("n") <= block, F.col("key"))).alias("groups"))
    wanted = write_out(groups.join(classes, "node").select("node", *_CLASS, "groups"), "similar-wanted")
    sets = write_out(sets_of(texts, wanted, shingle), "similar-sets")
    found = links_of_small(sets, similarity).unionByName(links_to_leaders(shared.filter(F.col("n") > block), sets, similarity))
    found = write_out(_ordered(found), "similar-links")
    roots = write_out(components(found), "similar-roots")
    odd = write_out(_ordered(links_of_odd(shared.filter(F.col("n") > block), sets, roots, similarity, block)), "similar-odd")
    forget(shared, wanted, sets, found)
    if odd.isEmpty():
        return roots
    # the links of the odd members join components, which stand for their members
    end = lambda e: F.coalesce(F.col(f"r{e}"), F.col(e)).alias(e)
    ends = odd
    for e in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(e), F.col("root").alias(f"r{e}")), e, "left")
    above = write_out(components(ends.select(end("a"), end("b"))), "similar-above")
    below = roots.select("node", F.col("root").alias("up")).join(above.select(F.col("node").alias("up"), "root"), "up", "left")
    return below.select("node", F.coalesce("root", "up").alias("root")).unionByName(above.join(roots.select("node"), "node", "left_anti"))


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, component_id: a row for each row of ``docs``; component_id is the smallest id reachable.

    Null and empty texts have no shingles and are one class. A text of any length is one row of one
    task, whose memory holds some ten times its bytes. Rows with a null id are returned with a null
    component and never compared. Repeated rows share a class. An empty table gives no rows. Other
    columns are ignored.
    """

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            hashes = [shingle_hashes(text.as_py(), shingle) for text in b.column("text")]
            sets = [np.unique(h).astype("<u8") for h in hashes]
            two = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
            keys = [k.view("<i8") for k in keys_of(hashes, sets)]
            columns = [*(pa.array(np.ascontiguousarray(two[:, i])) for i in (0, 1)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *_CLASS, "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = write_out(rows.mapInArrow(printed, "doc_id long, d0 long, d1 long, keys array<long>"), "similar-prints")
    keyed = prints.filter("doc_id is not null").groupBy(*_CLASS).agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"))
    keyed = write_out(keyed.select("node", *_CLASS, "keys"), "similar-keys")
    # the keys are most of these tables, so they go as soon as they were matched
    prints, wide = write_out(prints.select("doc_id", *_CLASS), "similar-ids"), prints
    classes = write_out(keyed.select("node", *_CLASS), "similar-classes")
    forget(wide)
    roots = similar_components(rows, classes, keyed, shingle, similarity, block)
    placed = write_out(classes.join(roots, "node", "left").select(*_CLASS, F.coalesce("root", "node").alias("component_id")), "similar-placed")
    forget(classes)
    alone = prints.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id"))
    return prints.filter("doc_id is not null").join(placed, _CLASS).select("doc_id", "component_id").unionByName(alone)
