"""Very long texts: every operator takes them whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import text
from weftgraph.llm import bpe, packing, quality, warc
from weftgraph.llm.exact import exact_dedup
from weftgraph.llm.hostrules import host_rules
from weftgraph.llm.queries import tokenizer
from weftgraph.llm.simhash import near_dedup
from weftgraph.llm.similar import similar_dedup
from weftgraph.llm.substring import substring_dedup
from weftgraph.llm.suffix import suffix_dedup


@pytest.fixture(scope="module")
def long_rows():
    base = text(7, 9000) + " " + text(900, 9000, "v")
    words = base.split()
    words[9000] = "new"
    return [(1, base), (2, " ".join(words)), (3, base), (4, "y" * 150_000), (5, text(3)), (6, text(8, 200, "u") + "\n" + text(7, 9000)[-1500:]), (7, "\n" * 100_000 + "end")]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame([(d, t, "h") for d, t in long_rows], "doc_id long, text string, source string")


def got(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_dedup(long_docs, long_rows):
    assert got(near_dedup(long_docs), "doc_id", "fingerprint", "component_id") == brute.simhash(long_rows)
    assert got(exact_dedup(long_docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(long_rows)
    assert got(substring_dedup(long_docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substrings(long_rows)
    assert got(similar_dedup(long_docs), "doc_id", "component_id") == {(d, 1 if d in (2, 3) else d) for d, _ in long_rows}


def test_suffixes(spark, long_rows):
    rows = [(d, t[:60_000]) if d != 4 else (d, "yz" * 700) for d, t in long_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == set(brute.suffixes(rows))


def test_rules_and_scores(long_docs, long_rows):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(host_rules(long_docs), *columns) == brute.base_counts(long_rows)
    found = quality.classify(long_docs, long_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).filter("doc_id = 5"))
    assert found.filter("score between 0 and 1").count() == len(long_rows)


def test_archives(long_docs, long_rows):
    pages = long_docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a").alias("url"), F.col("text").alias("html"))
    assert got(warc.archive_pages(pages), "row_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute.warc(long_rows)


def test_tokens(long_docs, long_rows):
    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken")
    codec = bpe.encoding(path, pattern)
    ids = {d: codec.encode_ordinary(t) for d, t in long_rows}
    assert got(bpe.encode_texts(long_docs, path, pattern), "doc_id", "n_tokens", "ids_sha256") == {(d, len(x), brute.sha256(np.array(x, dtype="<u4").tobytes())) for d, x in ids.items()}
    pieces = packing.pack(long_docs, path, pattern).collect()
    brute.check_packing([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in pieces], {d: [*x, 2] for d, x in ids.items()})
