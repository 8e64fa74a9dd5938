"""SimHash, exact, substring and suffix dedup against their plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import text
from weftgraph.llm import simhash, substring, suffix
from weftgraph.llm.components import components
from weftgraph.llm.exact import build_directory, chains, depth_for, exact_dedup
from weftgraph.llm.shared import is_small, settings, shared_folder, write_out
from weftgraph.llm.simhash import near_dedup
from weftgraph.llm.substring import WindowIndex, substring_dedup
from weftgraph.llm.suffix import suffix_dedup


def got(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# ---- SimHash ----

SIMHASH = ("doc_id", "fingerprint", "component_id")


@pytest.mark.parametrize("limit", [64, 1])
def test_simhash(docs, rows, limit):
    assert set(got(near_dedup(docs, pair_limit=limit), *SIMHASH)) == brute.simhash(rows)


def test_golay_keys_lose_no_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(400):
        for bit in rng.choice(64, i % 3, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [set() for _ in range(800)]
    for row, key in zip(*simhash.fuzzy_keys(np.concatenate([a, b])), strict=True):
        keys[row].add(int(key))
    assert all(keys[i] & keys[400 + i] for i in range(400))
    assert max(map(len, keys)) <= 18


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int32)[:: 997]
    index = simhash.golay_index(words)
    assert index.min() >= 0 and index.max() < 4096
    errors = simhash._ERRORS
    assert sorted(np.bitwise_count(errors).tolist()).count(3) == 1771 and len(set(errors.tolist())) == 2048


def test_hot_fingerprint_ball(spark):
    """Very many fingerprints in one bucket: resolved without pairs."""
    fps = [(1 << i | 1 << j) for i in range(40) for j in range(i)] + [1 << 62 | 1 << 61 | 1 << 60]
    classes = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(classes, pair_limit=8)).collect()}
    assert len({roots[x] for x in fps[:-1]}) == 1 and fps[-1] not in roots


def test_simhash_nulls_and_empty(nulls, empty):
    assert near_dedup(empty).count() == 0
    found = got(near_dedup(nulls), *SIMHASH)
    assert len(found) == 5 and sum(f == "0" * 16 for _, f, _ in found) == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (100, 102), (5, 5), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- exact ----

EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact(docs, rows):
    assert set(got(exact_dedup(docs), *EXACT)) == brute.exact(rows)


def test_exact_with_colliding_keys(docs, rows):
    """Keys say little: chains are told apart by their texts."""
    assert set(got(exact_dedup(docs, capacity=4, key=lambda c: F.length(c) % 3), *EXACT)) == brute.exact(rows)


def test_exact_splits_buckets(docs, rows):
    found = exact_dedup(docs, capacity=4)
    assert set(got(found, *EXACT)) == brute.exact(rows)


def test_directory():
    rng = np.random.default_rng(0)
    prefixes, counts = np.unique(rng.integers(0, 1 << 8, 300) // 3, return_counts=True)
    histogram = dict(zip(prefixes.tolist(), counts.tolist(), strict=True))
    depth, directory = build_directory(histogram, 10, 8)
    assert sorted(directory) == list(range(1 << depth))
    held: dict[int, int] = {}
    for p, n in histogram.items():
        bucket = directory[p >> (8 - depth)]
        held[bucket] = held.get(bucket, 0) + n
        assert bucket == 1 << (bucket.bit_length() - 1) | p >> (8 - (bucket.bit_length() - 1))
    assert all(n <= 10 or b.bit_length() - 1 == 8 for b, n in held.items())
    assert build_directory({}, 10, 8) == (0, {0: 1})


def test_directory_deepens_with_the_keys():
    assert depth_for(10, 100) == 4 and depth_for(10**9, 100_000) == 18 and depth_for(10**13, 100_000) == 31
    rng = np.random.default_rng(1)
    deepest = depth_for(200_000, 100)
    prefixes, counts = np.unique(rng.integers(0, 1 << deepest, 200_000), return_counts=True)
    histogram = dict(zip(prefixes.tolist(), counts.tolist(), strict=True))
    depth, directory = build_directory(histogram, 100, deepest)
    held: dict[int, int] = {}
    for p, n in histogram.items():
        held[directory[p >> (deepest - depth)]] = held.get(directory[p >> (deepest - depth)], 0) + n
    assert 10 < depth < deepest and max(held.values()) <= 100


def test_owners_take_ranges_of_buckets(spark):
    """Chains of a key lie in one partition, in ranges; a hot text comes as one row of each task."""
    rows = [(b, 10 * b + k, f"text {k}" if i else "hot", 100 * b + i) for b in range(8) for k in range(2) for i in range(5)]
    several = spark.createDataFrame(rows, "bucket long, k long, body string, doc_id long").repartition(3)
    found = chains(several)
    assert {(r.bucket, r.k, r.sha, r.keep_id, r.group_size) for r in found.collect()} == {
        (b, 10 * b + k, brute.sha256(t.encode()), 100 * b + (0 if t == "hot" else 4), n) for b in range(8) for k in range(2) for t, n in (("hot", 1), (f"text {k}", 4))
    }
    top = next(line for line in plan_of(found).split("\n") if "Exchange" in line)  # what the last aggregation reads
    assert "rangepartitioning(bucket" in top


def test_small_tables_are_measured(spark):
    table = write_out(spark.createDataFrame([(1, "x" * 1000)] * 20, "a long, b string"), "sizes")
    assert is_small(table, 30_000) and not is_small(table, 20_000) and is_small(table.select("a"), 500)


def test_no_folder_of_one_machine_on_a_cluster():
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Far)


def test_exact_nulls_and_empty(nulls, empty):
    assert exact_dedup(empty).count() == 0
    found = got(exact_dedup(nulls), *EXACT)
    assert sorted((d, k, n, kept) for d, k, n, kept, _ in found if d) == [(7, 7, 2, True)] * 2
    assert [n for d, _, n, _, _ in found if d is None].count(2) == 2


# ---- substrings ----

SUB = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings(docs, rows, batches):
    assert set(got(substring_dedup(docs, batches=batches), *SUB)) == brute.substrings(rows)


def test_substring_index_grows_between_calls(spark, docs, rows):
    """A later batch is held against the merged runs of earlier ones."""
    index = WindowIndex(spark, fan_in=2)
    ids = [d for d, _ in rows]
    bounds = [0, ids[len(ids) // 3], ids[2 * len(ids) // 3], ids[-1] + 1]
    parts = [substring.contexts(docs.select("doc_id", "text").filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)), 20, 8) for a, b in zip(bounds, bounds[1:])]
    seen = []
    for k, part in enumerate(parts):
        found = index.add(part)
        own = [r.hash for r in part.collect()]
        again = {h for h in own if own.count(h) > 1 or h in seen}
        assert sorted(r.hash for r in found.collect()) == sorted(h for h in seen + own if h in again)
        seen += own
        index.compact()
        assert len(index.runs) == 1 and index.merges == k
    counts = {r.hash: r.n for r in spark.table(index.runs[0]).collect()}
    assert counts == {h: seen.count(h) for h in set(seen)}
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("window_run")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_merged_as_they_lie(spark, docs):
    """Neither an exchange nor a sort stands below the merge of two runs."""
    index = WindowIndex(spark, fan_in=2)
    found = substring.contexts(docs.select("doc_id", "text"), 20, 8)
    index.add(found)
    index.add(found)
    with settings(spark, substring._SORTED):
        plan = plan_of(index.run(index.runs[1]).join(index.run(index.runs[0]).withColumnRenamed("n", "m"), "hash", "left"))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    index.drop()


def test_two_passes_of_the_index_are_read_by_later_batches(spark, docs, rows):
    index = WindowIndex(spark, fan_in=2)
    assert set(got(substring_dedup(docs, batches=4, index=index), *SUB)) == brute.substrings(rows)
    assert index.merges == 2
    index.drop()


def test_substring_nulls_and_empty(nulls, empty):
    assert substring_dedup(empty).count() == 0
    assert sorted(got(substring_dedup(nulls), "n_words", "n_removed")) == [(0, 0), (0, 0), (80, 0), (80, 0), (80, 0)]


def test_substring_kept_text(spark):
    a = text(1, 30)
    docs = spark.createDataFrame([(1, a), (2, f"new {a}  more")], "doc_id long, text string")
    assert dict(got(substring_dedup(docs), "doc_id", "kept_text")) == {1: a, 2: "new more"}


def test_anchors_and_rolling_hashes():
    rng = np.random.default_rng(2)
    for n in (5, 13, 14, 60):
        v = rng.integers(0, 9, n).astype(np.uint64)
        if n >= 13:
            want = [p + int(v[p : p + 13].argmin()) for p in range(n - 12)]
            assert substring.leftmost_least(v, 13).tolist() == want
            assert substring.anchors(v << np.uint64(24) | rng.integers(0, 1 << 24, n).astype(np.uint64), 13).tolist() == want
    v = rng.integers(0, 2**63, 50).astype(np.uint64)
    for width in (1, 2, 7, 20, 32):
        plain = [sum(int(v[p + k]) * pow(0x9E3779B97F4A7C15, width - 1 - k, 1 << 64) for k in range(width)) % (1 << 64) for p in range(50 - width + 1)]
        assert substring.rolling(v, width, 0x9E3779B97F4A7C15).tolist() == substring.mix(np.array(plain, dtype=np.uint64)).tolist()


# ---- suffixes ----

SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1000}, {"most_contexts": 1}, {"most_contexts": 3}])
def test_suffixes(docs, rows, options):
    assert sorted(got(suffix_dedup(docs, **options), *SUFFIX)) == sorted(brute.suffixes(rows))


@pytest.mark.parametrize("most", [2048, 6, 2, 1])
def test_suffixes_of_near_copies(spark, most):
    """A passage in unlike surroundings, and copies that differ in single bytes."""
    rng = np.random.default_rng(5)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    base, passage, rows = noise(1500), noise(700), []
    for i in range(12):
        own = list(base)
        for k in rng.choice(1500, 3, replace=False):
            own[k] = "#"
        rows += [(2 * i, "".join(own)), (2 * i + 1, noise(300) + passage + noise(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    assert sorted(got(suffix_dedup(docs, most_contexts=most), *SUFFIX)) == sorted(brute.suffixes(rows))


def test_suffix_sort_order():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw[1500:2500] = raw[:1000]
    data = np.concatenate([raw, np.zeros(16, np.uint8)])
    places = np.arange(0, 2600, 13)
    order, same = suffix.sort_buckets(data, places, np.zeros(len(places), dtype=np.int64))
    keys = [raw[p : p + 400].tobytes() for p in places]
    assert [keys[i] for i in order] == sorted(keys)
    assert same.tolist() == [False] + [a == b for a, b in zip(sorted(keys), sorted(keys)[1:], strict=False)]


def test_cover_meets_every_pair():
    table = suffix.cover_tables()
    assert table.min() >= 0
    for a in range(13):
        for b in range(13):
            assert (a + table[a, b]) % 13 in suffix.COVER and (b + table[a, b]) % 13 in suffix.COVER


def test_suffix_nulls_rows_and_empty(nulls, empty):
    assert suffix_dedup(empty).count() == 0
    found = sorted(got(suffix_dedup(nulls, with_row=True), "doc_id", "n_removed", "row.source"), key=str)
    assert [f for f in found if f[0] == 7] == [(7, len(text(2)), "h")] * 2 if len(text(2)) >= 400 else True
    assert sum(n for d, n, _ in found if d is None) == 0
