"""URL filter on a sorted digest array.

A rule is a host with all its subdomains and a prefix of the path, written ``host/path``. The
index is a few files in the shared folder: 64-bit xxhash keys in ascending order, the offsets of
the rules' strings, the strings, their verdicts, and the pairs of host and path lengths that occur.
Tasks memory-map them, so that processes of one machine share the pages; from a shared folder that
isn't a mounted one, Spark brings the files to each executor first. A url gives at most one
candidate for each pair of lengths among the rules; the candidates of a batch are probed by one
vectorised binary search for every so many, and every hit is confirmed by comparing the stored
string, so a collision can't match.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_system, write_whole
from .shared import fresh_path

ALLOW, BLOCK = "allow", "block"
PROBES = 1 << 16  # candidates that are looked up together


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "#?":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


def digest(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode())


def write_index(spark: SparkSession, rules: Iterable[tuple[str, str]], address: str | None = None, hash_fn=digest) -> str:
    """Write the index of (verdict, rule) pairs; a rule given twice keeps its last verdict. Returns its folder."""
    address = (address or fresh_path(spark, "url-index")).rstrip("/")
    known = {rule: verdict for verdict, rule in rules}
    order = sorted(known, key=lambda r: (hash_fn(r), r))
    blob = [r.encode() for r in order]
    parts = {
        "keys": np.array([hash_fn(r) for r in order], dtype="<u8"),
        "offsets": np.cumsum([0, *map(len, blob)], dtype="<i8"),
        "blocked": np.array([known[r] == BLOCK for r in order], dtype="u1"),
        "lengths": np.array(sorted({(r.index("/"), len(r) - r.index("/")) for r in order}), dtype="<i8"),
        "strings": np.frombuffer(b"".join(blob), dtype="u1"),
    }
    for name, data in parts.items():
        write_whole(part_address(address, name), data.tobytes())
        if open_system(address)[0].type_name != "local":
            spark.sparkContext.addFile(part_address(address, name))
    return address


def part_address(address: str, name: str) -> str:
    """A file of an index; its own name is unique too, as Spark brings files to executors under it."""
    return f"{address}/{address.rpartition('/')[2]}-{name}.bin"


class DigestArray:
    def __init__(self, address: str, hash_fn=digest):
        def load(name: str, kind: str) -> np.ndarray:
            system, path = open_system(part_address(address, name))
            if system.type_name != "local":
                path = SparkFiles.get(path.rpartition("/")[2])
            return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, kind)

        self.keys, self.offsets, self.blocked, self.strings = (load(*x) for x in (("keys", "<u8"), ("offsets", "<i8"), ("blocked", "u1"), ("strings", "u1")))
        self.lengths = defaultdict(list)
        for host, path in load("lengths", "<i8").reshape(-1, 2).tolist():
            self.lengths[host].append(path)
        self.hash_fn = hash_fn

    def find(self, candidates: list[str]) -> np.ndarray:
        """Place of each candidate in the index, or -1."""
        keys = np.fromiter(map(self.hash_fn, candidates), dtype=np.uint64, count=len(candidates))
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = np.full(len(candidates), -1, dtype=np.int64)
        for i in np.flatnonzero(first < last):
            for k in range(first[i], last[i]):  # more than one only where keys collide
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == candidates[i].encode():
                    out[i] = k
        return out

    def candidates(self, host: str, path: str) -> Iterator[str]:
        """Suffixes of the host's labels with prefixes of the path, of the lengths that rules have."""
        for n, paths in self.lengths.items():
            if n == len(host) or 0 < n < len(host) and host[-n - 1] == ".":
                own = host[len(host) - n :]
                yield from (own + path[:k] for k in paths if k <= len(path))

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str | None, bool | None]]:
        """Rule and whether it blocks, for each (host, path); the longest rule wins, then that with the longer host."""
        best: list[tuple[str | None, bool | None]] = [(None, None)] * len(parts)
        rank = lambda r: (len(r), r.index("/"))
        probes, owner = [], []

        def probe() -> None:
            found = self.find(probes)
            for i in np.flatnonzero(found >= 0):
                n, rule = owner[i], probes[i]
                if best[n][0] is None or rank(rule) > rank(best[n][0]):
                    best[n] = (rule, bool(self.blocked[found[i]]))
            probes.clear()
            owner.clear()

        for n, (host, path) in enumerate(parts):
            if host:
                own = list(self.candidates(host, path))
                probes += own
                owner += [n] * len(own)
            if len(probes) >= PROBES:
                probe()
        probe()
        return best


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, hash_fn=digest) -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each row of ``pages``.

    rules: (verdict, ``host/path``) pairs; each must hold a slash. A url that is null or has no
    ``://`` has an empty host and path, fits no rule and gets ``default``, as does any url that no
    rule fits. A url of any length is taken whole, and costs no more probes than rules have
    different lengths. Repeated rows are judged alike; an empty table gives no rows. Other columns are
    ignored.
    """
    address = write_index(pages.sparkSession, rules, hash_fn=hash_fn)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(address, hash_fn)
        for b in batches:
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            best = index.judge(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([r for r, _ in best], pa.string()),
                    pa.array([default if blocks is None else BLOCK if blocks else ALLOW for _, blocks in best], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")
