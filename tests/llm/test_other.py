"""Archives, rules, classifier, url filter, packing and tokens."""

import io
import os

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.conftest import text
from weftgraph.llm import bpe, packing, quality, warc
from weftgraph.llm.hostrules import host_rules, host_verdicts
from weftgraph.llm.queries import URL_RULES, tokenizer
from weftgraph.llm.urls import DigestArray, filter_urls, split_url, write_index

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def got(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# ---- WARC ----


@pytest.fixture(scope="module")
def pages(spark):
    long, hot = "<p>é" * 400, "x" * 1200
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, "short"), (4, "u\r\nv", "short"), (5, "http://b", None), (6, "", ""), (7, "http://c", "\r\n\r\n" * 300), (8, "http://c", "y" * 200_000)]
    rows += [(100 + i, f"http://h/{i}", hot) for i in range(40)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3, "page_id")


COLUMNS = ("row_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archives(pages):
    found = warc.archive_pages(pages)
    want = brute.warc([(r.page_id, r.html) for r in pages.collect()])
    assert set(got(found, *COLUMNS)) == want and found.count() == pages.count()
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.payload) == (html[r.row_id] if r.record_type == "response" else b"") for r in found.collect())


def test_archives_roll_over(pages, tmp_path):
    listed = warc.write_archives(warc.plan_records(pages.coalesce(1)), str(tmp_path), archive_bytes=1000).collect()
    assert len(listed) > 1 and sum(r.records for r in listed) == pages.count()
    assert all(os.path.getsize(r.path) == r.bytes for r in listed)


def test_archive_nulls_and_empty(spark, pages):
    assert warc.archive_pages(spark.createDataFrame([], pages.schema)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None), (None, None, "z" * 1500, None), (9, None, "z" * 1500, None), (9, None, "z" * 1500, None)], pages.schema)
    assert sorted(got(warc.archive_pages(nulls), "row_id", "record_type", "refers_to"), key=str) == sorted([(9, "response", None), (9, "response", None), (None, "response", None), (None, "revisit", 9)], key=str)


def archive(*records, dictionary=None, compressed=True):
    d = dictionary or zstandard.ZstdCompressionDict(b"WARC/1.1 some bytes", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    body = zstandard.ZstdCompressor().compress(d.as_bytes()) if compressed else d.as_bytes()
    head = warc.SKIPPABLE.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    return io.BytesIO(head + b"".join(zstandard.ZstdCompressor(dict_data=d).compress(r) for r in records))


GOOD = warc.record_bytes(1, "http://a", b"payload", __import__("hashlib").sha1(b"payload").hexdigest())


@pytest.mark.parametrize("compressed", [True, False])
def test_dictionary_frame(compressed):
    assert [d for _, d in warc.frames(archive(GOOD, GOOD, compressed=compressed))] == [GOOD, GOOD]
    assert warc.parse_record(GOOD)["payload"] == b"payload"


@pytest.mark.parametrize(
    "record",
    [GOOD[:-1], GOOD + b"x", GOOD.replace(b"WARC/1.1", b"WARC/9.9"), GOOD.replace(b"WARC-Date", b"X-Date"), GOOD.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"), GOOD + GOOD, b"", GOOD.replace(b"Content-Length: 7", b"Content-Length: 8")],
)
def test_invalid_records(record):
    with pytest.raises(warc.WarcError):
        warc.parse_record(record)


def test_broken_archives():
    whole = archive(GOOD).getvalue()
    for cut in (2, 6, 20, len(whole) - 3):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.frames(io.BytesIO(whole[:cut])))
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(b"12345678")))


# ---- host rules ----

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(docs, rows):
    assert set(got(host_rules(docs), *BASE)) == brute.base_counts(rows)


def test_bad_host_is_rejected(spark):
    rows = [(i, "bad" if i % 40 else text(i), "bad.com") for i in range(400)] + [(1000 + i, text(i) if i % 10 else "no", "good.com") for i in range(400)] + [(5000, text(1), "small.com"), (5001, "no", "tiny.com"), (5002, text(2), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in host_rules(docs).filter("kept").collect()}
    assert kept == {1000 + i for i in range(400) if i % 10} | {5000, 5002}


def test_a_host_s_verdict_differs_from_the_base_rules(spark):
    """Documents that pass the base rules go with a host of which nearly all fail."""
    rows = [(i, text(i) if i % 20 == 0 else "no", "bad.com") for i in range(400)] + [(1000 + i, text(i), "good.com") for i in range(400)]
    found = host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in found if not r.base_failed and not r.kept} == set(range(0, 400, 20))


def test_prior_shrinks_small_hosts(spark):
    hosts = spark.createDataFrame([("a", 1000, 100), ("b", 1000, 140), ("c", 1, 1), ("d", 1000, 960)], "host string, n long, failed long")
    rate = {r.host: r.rate for r in host_verdicts(hosts).collect()}
    assert 0.3 < rate["c"] < 0.9 and rate["d"] > 0.9 and rate["a"] < 0.11


def test_rules_nulls_and_empty(nulls, empty):
    assert host_rules(empty).count() == 0
    assert sorted(got(host_rules(nulls), "n_words", "kept")) == [(0, False), (0, False), (80, True), (80, True), (80, True)]


# ---- classifier ----


@pytest.fixture(scope="module")
def marked(spark):
    good = [(i, text(i, 60), 1) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "###" for w in text(i, 60).split()), 0) for i in range(60)]
    return spark.createDataFrame([(d, t, q, "clash") for d, t, q in good + bad], "doc_id long, text string, quality int, score string")


def test_held_out_accuracy(marked):
    found = quality.classify(marked, marked.select("doc_id", "quality"), epochs=3).join(marked.select("doc_id", "quality"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 20 and (held.predicted == held.quality).mean() >= 0.95
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_held_out_labels_teach_nothing(marked):
    turned = marked.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.classify(marked, m, epochs=1).collect()} for m in (marked, turned))
    assert a == b


def test_gradients():
    net = quality.ByteNet.fresh(1)
    for w in net.weights():
        w += 0.05
    docs, y, weight = [quality.chunks_of(t.encode()) for t in (text(1, 300), "short", "")], np.array([1, 0, 1], dtype=np.float32), np.ones(3, dtype=np.float32)

    def loss():
        p = net.score([text(1, 300).encode(), b"short", b""])
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    for w, g in zip(net.weights(), net.gradients(docs, y, weight), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.15, abs=2e-4)


def test_chunks_cover_all():
    for n in (0, 1, 1023, 1024, 1025, 1920, 1921, 5000):
        own = quality.chunks_of((bytes(range(256)) * 20)[:n])
        flat = np.concatenate([own[0], *(c[quality.OVERLAP :] for c in own[1:])])
        assert bytes(flat[:n].astype(np.uint8)) == (bytes(range(256)) * 20)[:n] and (flat[n:] == quality.PAD).all()


def test_repeated_ids_teach_once_and_long_texts_by_passages(spark):
    rows = [(i % 20, text(i, 30), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(1000, text(1, 30_000))], "doc_id long, text string")
    marks = spark.createDataFrame([(d, q) for d, _, q in rows[:20]] + [(1000, 1)], "doc_id long, quality int")
    taken = []
    real, quality.fit = quality.fit, lambda texts, *a: taken.extend(texts) or real(texts, *a)
    try:
        quality.fit_on(docs, marks, "doc_id", "text", "quality", 1000, 1, 1600)
    finally:
        quality.fit = real
    whole = text(1, 30_000)
    assert len(taken) <= 21 and sum(len(t) == 1600 for t in taken) <= 1
    long = next((t.decode() for t in taken if len(t) == 1600), None)
    assert long is None or (long[:100] == whole[:100] and long[-100:] == whole[-100:] and all(long[i : i + 100] in whole for i in range(0, 1600, 100)))


def test_accuracy_on_real_labels(spark):
    """On the marked documents that taught nothing."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out and quality in (0, 1)").toPandas()
    good, bad = (found.score[found.quality == k].to_numpy() for k in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    assert (good[:, None] > bad[None, :]).mean() >= 0.9  # the area under the curve
    assert (found.predicted == found.quality).mean() >= 0.85


def test_classifier_without_labels(spark, marked, nulls, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(marked, none).collect()} == {0.5}
    assert quality.classify(empty, none).count() == 0 and quality.classify(nulls, none).count() == 5


# ---- urls ----

URLS = [None, "", "nothing", "http://a.com", "http://A.COM/x", "https://example.com/en/1", "http://www.example.com/en/", "http://b.www.example.com/en/x?y#z", "http://com/", "http://xcom/", "http://q.net/es/", "http://q.net/es", "http://net/fr/x", "ftp://q.net?/fr/", "http://a.com#/x", "http://É.com/é", "x://y://z.com/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    assert set(got(filter_urls(pages, URL_RULES), "page_id", "host", "path", "rule", "verdict")) == {(i, *brute.url(u, URL_RULES)) for i, u in enumerate(URLS)}
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert set(got(filter_urls(pages, []), "verdict")) == {("allow",)}


def test_colliding_digests_are_told_apart(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    same = lambda s: len(s) % 2
    assert set(got(filter_urls(pages, URL_RULES, hash_fn=same), "page_id", "host", "path", "rule", "verdict")) == {(i, *brute.url(u, URL_RULES)) for i, u in enumerate(URLS)}


def test_hosts_of_very_many_labels(spark):
    """A host of any length costs no more probes than rules have different lengths."""
    index = DigestArray(write_index(spark, URL_RULES))
    host = "a." * 200_000 + "net"
    assert list(index.candidates(host, "/es/")) == ["net/", "net/es/"] or len(list(index.candidates(host, "/es/"))) <= 12
    pages = spark.createDataFrame([(1, f"http://{host}/es/x"), (2, "http://" + "x" * 500_000 + ".com/" + "y" * 500_000)], "page_id long, url string")
    assert sorted(got(filter_urls(pages, URL_RULES), "page_id", "rule", "verdict")) == [(1, "net/es/", "block"), (2, "com/", "allow")]


def test_index_of_a_remote_folder_is_mapped_from_a_local_copy(spark, tmp_path, monkeypatch):
    """Where the shared folder isn't a mounted one, Spark's copies are mapped."""
    from weftgraph.llm import urls

    class Remote:
        type_name = "remote"

    address = write_index(spark, URL_RULES, str(tmp_path / "far"))
    for name in ("keys", "offsets", "blocked", "lengths", "strings"):
        spark.sparkContext.addFile(urls.part_address(address, name))
    real = urls.open_system
    monkeypatch.setattr(urls, "open_system", lambda a: (Remote(), real(a)[1]))
    index = DigestArray(address)
    assert isinstance(index.keys, np.memmap) and not str(index.keys.filename).startswith(str(tmp_path))
    assert index.judge([("q.net", "/es/1")]) == [("net/es/", True)]


def test_long_prefixes_and_ties(spark, tmp_path):
    rules = [("block", "b.com/ad"), ("allow", "b.com/adm"), ("block", "a.b.com/"), ("block", "b.com/x")]
    index = DigestArray(write_index(spark, rules, str(tmp_path / "i")))
    urls = ("http://b.com/admin", "http://b.com/adx", "http://a.b.com/x", "http://a.b.com/adx", "http://b.com/")
    assert index.judge([split_url(u) for u in urls]) == [("b.com/adm", False), ("b.com/ad", True), ("a.b.com/", True), ("a.b.com/", True), (None, None)]


# ---- packing ----


def test_packing(docs, rows):
    path, pattern = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [2] for d, x in rows}
    found = packing.pack(docs, path, pattern, with_ids=True)
    pieces = got(found, "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    brute.check_packing(pieces, ids)
    assert all(r.ids == ids[r.doc_id][r.start : r.start + r.length] for r in found.collect())


def test_packing_nulls_and_empty(nulls, empty):
    args = tokenizer("byte_bpe_50k.json")
    assert packing.pack(empty, *args).count() == 0
    assert sorted(r.length for r in packing.pack(nulls, *args).filter("doc_id is null").collect())[:2] == [1, 1]


def test_small_partitions_are_packed_together(spark):
    """As many tasks as cores at most pack a table of many small partitions."""
    rows = spark.range(0, 600, 1, 60).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    assert packing.whole_tasks(rows, 1 << 40).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert packing.whole_tasks(rows, 1).rdd.getNumPartitions() == 60


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(0)
    for most in (1, 3, 50):
        bins, open_bins, names = packing.BestFit(100, most), {}, 0
        for n in rng.integers(1, 101, 2000).tolist():
            fits = [f for f in open_bins.values() if f >= n]
            found, offset = bins.place(n)
            if fits:
                assert open_bins[found] == min(fits) == 100 - offset
            else:
                assert (found, offset) == (names, 0)
                names += 1
            left = 100 - offset - n
            open_bins.pop(found, None)
            if left:
                if len(open_bins) == most:
                    fullest = min(open_bins.values())
                    closed = [k for k, f in open_bins.items() if f == fullest]
                    still = {b for held in bins.by_free for b in held}
                    open_bins.pop(next(k for k in closed if k not in still))
                open_bins[found] = left
            assert {b for held in bins.by_free for b in held} == set(open_bins)


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2048) == [(0, 1024), (1024, 1024)] and packing.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)]


# ---- tokens ----


def test_bpe_round_trip(docs, rows):
    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken")
    codec = bpe.encoding(path, pattern)
    ids = {d: codec.encode_ordinary(x or "") for d, x in rows}
    sha = lambda v: brute.sha256(np.array(v, dtype="<u4").tobytes())
    for long in (1 << 16, 50):
        found = bpe.encode_texts(docs, path, pattern, long=long)
        assert set(got(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")) == {(d, len(ids[d]), sha(ids[d]), brute.sha256((x or "").encode()), True) for d, x in rows}
    assert {r.doc_id: r.ids for r in bpe.encode_ids(docs, path, pattern).collect()} == ids


def test_cuts_are_safe():
    codec = bpe.encoding(*tokenizer("byte_bpe_multi_50k.tiktoken"))
    rng = np.random.default_rng(4)
    letters = list("ab1'. \n\t\u00a0éS漢-") + ["'s", "  ", "'ll"]
    for _ in range(300):
        x = "".join(rng.choice(letters, 60))
        for long in (1, 5, 17):
            assert "".join(bpe.safe_pieces(x, long)) == x
            assert bpe.encode(codec, x, long).tolist() == codec.encode_ordinary(x)


def test_json_vocabulary_is_that_of_the_library():
    path, pattern = tokenizer("byte_bpe_50k.json")
    codec, t = bpe.encoding(path, pattern), Tokenizer.from_file(path)
    for x in ("", "a", text(1), "é漢 \n\n  x'll", "\x00\x7f"):
        assert codec.encode_ordinary(x) == bpe.encode(codec, x).tolist() == t.encode(x, add_special_tokens=False).ids


SPACES = (" ", "\n", "\t", "\u00a0", "\u3000", "\r\n ")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"])
def test_long_white_space_is_cut_safely(name):
    """Runs that go past the pattern have the ids of the whole text, at the start, within, before added tokens and at the end."""
    codec = bpe.encoding(*tokenizer(name))
    whole = (lambda x: codec.encode(x, allowed_special="all")) if codec.special_tokens_set else codec.encode_ordinary
    for run in (x * n for x in SPACES for n in (3, 4, 9)):
        for x in (f"a{run}b", run, f"{run}b", f"a{run}", f"a {run}'s{run}{run}x1{run}!", f"a{run}<|endoftext|>{run}b", f"\x1c{run}\x1c"):
            for long in (1, 5, 1 << 16):
                assert bpe.encode(codec, x, long, long_space=4).tolist() == whole(x)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"])
def test_millions_of_spaces(spark, name):
    """The pattern's engine would end the process with an overflow of its stack."""
    path, pattern = tokenizer(name)
    codec = bpe.encoding(path, pattern)
    for x in ("x" + " " * 2_000_000 + "y", "\n" * 2_000_000, " \t" * 1_000_000 + "z", "q" * 1_000_000):
        assert bpe.decode(codec, bpe.encode(codec, x)) == x.encode()
    docs = spark.createDataFrame([(1, "x" + " " * 2_000_000 + "y"), (2, "a")], "doc_id long, text string")
    assert [r.round_trip for r in bpe.encode_texts(docs, path, pattern).collect()] == [True, True]
    assert packing.pack(docs, path, pattern).filter("doc_id = 1").agg(F.sum("length")).first()[0] == len(bpe.encode(codec, "x" + " " * 2_000_000 + "y")) + 1


def test_spaces_as_the_library_of_the_vocabulary():
    path, pattern = tokenizer("byte_bpe_50k.json")
    codec, t = bpe.encoding(path, pattern), Tokenizer.from_file(path)
    for x in ("x" + " " * 50_000 + "y", "\n" * 50_000, "a" + "\u00a0 " * 9_000 + "\n<|endoftext|>" + " " * 9_000 + "'ll"):
        assert bpe.encode(codec, x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_bpe_nulls_and_empty(nulls, empty):
    args = tokenizer("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode_texts(empty, *args).count() == 0
    assert [r.n_tokens for r in bpe.encode_texts(nulls, *args).collect()].count(0) == 2


def test_added_tokens_in_texts():
    """A text that holds an added token gets the ids of tokenizers in its default setting, in long texts too."""
    path, pattern = tokenizer("byte_bpe_50k.json")
    codec, t = bpe.encoding(path, pattern), Tokenizer.from_file(path)
    for x in ("<|endoftext|> x", "a<|endoftext|>b", "one <|endoftext|>  two\n<|endoftext|>", "plain", "word <|endoftext|> " * 40):
        want = t.encode(x, add_special_tokens=False).ids
        assert bpe.encode(codec, x).tolist() == want
        assert bpe.encode(codec, x, long=50).tolist() == want
