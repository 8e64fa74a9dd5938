"""The similarity stage, and the pipeline against a plain version of its stages."""

import os
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import text
from weftgraph.llm import shared, similar
from weftgraph.llm.queries import tokenizer

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def shingles(t, n=5):
    words = [w.decode() for w in brute.WORD.findall((t or "").encode().lower())]
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_similar(rows, least=0.8):
    """Smallest id reachable over pairs whose five-word shingles have the similarity, all pairs compared."""
    own, label = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in own:
        for b in own:
            if a < b and (own[a] == own[b] or len(own[a] & own[b]) >= least * len(own[a] | own[b])):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d in own}


def edited(base, *places):
    words = base.split()
    for p in places:
        words[p] = f"new{p}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_rows():
    out = [text(k, 200) for k in range(6)]
    out += [edited(text(k, 200), 10 + 30 * k) for k in range(6)] + [edited(text(0, 200), 5), edited(text(1, 200), 199), edited(text(2, 200), 0)]
    out += [edited(text(3, 200), *range(0, 200, 4)), "", None, "a b", text(9, 60)]
    out += [edited(text(50, 300), k) for k in range(40)]
    return [(2 * i + 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("block", [1024, 4])
def test_similar(spark, near_rows, block):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in near_rows], "doc_id long, text string, node string, f0 int")
    found = {r.doc_id: r.component_id for r in similar.similar_dedup(docs, block=block).collect()}
    assert found == plain_similar(near_rows)
    assert len(set(found.values())) < len(near_rows) - 40


def test_similar_nulls_and_empty(nulls, empty):
    assert similar.similar_dedup(empty).count() == 0
    assert sorted(((r.doc_id, r.component_id) for r in similar.similar_dedup(nulls).collect()), key=str) == sorted([(None, None)] * 3 + [(7, 7)] * 2, key=str)


def test_simhash_keys_are_among_the_keys():
    """Texts whose fingerprints differ in two bits or fewer share a Golay key."""
    found = 0
    for k in range(200):
        texts = [text(k, 600), edited(text(k, 600), 599)]
        hashes = [similar.shingle_hashes(t, 5) for t in texts]
        bits = (similar.fingerprint(hashes[0]) ^ similar.fingerprint(hashes[1])).bit_count()
        keys = [set(x.tolist()) for x in similar.keys_of(hashes, [np.unique(h) for h in hashes])]
        bands = [set(similar.band_keys(np.unique(h)).tolist()) for h in hashes]
        found += bits <= 2
        assert bits > 2 or (keys[0] - bands[0]) & (keys[1] - bands[1])
        assert bands[0] <= keys[0]
    assert found > 50


def test_pipeline(spark, tmp_path, rows, near_rows):
    table = [(d, t, "en", f"host{d % 3}", len(t or "")) for d, t in [*rows, *((1000 + d, t) for d, t in near_rows)]]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    failed = {c[0]: c[-1] for c in brute.base_counts([(d, t) for d, t, *_ in table])}
    by_host = defaultdict(list)
    for d, *_ in table:
        by_host[f"host{d % 3}"].append(failed[d])
    assert all(sum(v) / len(v) < 0.7 for v in by_host.values())  # no host is rejected here
    kept = [(d, t or "") for d, t, *_ in table if not failed[d]]
    last = {t: d for d, t in sorted(kept)}
    kept = [(d, t) for d, t in kept if last[t] == d]
    component = plain_similar(kept)
    kept = [(d, t) for d, t in kept if component[d] == d]
    left = {}
    for (d, *_), t in zip(brute.suffixes(kept), [t for _, t in kept], strict=True):
        left[d] = t
    counts = {}
    raws = [(d, t.encode()) for d, t in kept]
    for _, r in raws:
        for i in range(len(r) - 399):
            counts[r[i : i + 400]] = counts.get(r[i : i + 400], 0) + 1
    for d, r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - 399):
            if counts[r[i : i + 400]] > 1:
                gone[i : i + 400] = True
        left[d] = np.frombuffer(r, dtype=np.uint8)[~gone].tobytes().decode(errors="ignore")
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")[0])
    ids = {d: t.encode(x, add_special_tokens=False).ids + [2] for d, x in left.items()}
    brute.check_packing([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in found], ids)
    assert {r.doc_id for r in found} == set(ids)


def test_stages_keep_columns_and_bear_nulls(spark, nulls):
    docs = nulls.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_words AS n_chars", "hash")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), "").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "suffix-array dedup", "best-fit packing"]


def test_recall_of_keys_at_any_size():
    """Of pairs at a similarity of 0.8 all but one in ten thousand share a key, however many documents there are: keys don't depend on their number."""
    hit, close = 0, 0
    for k in range(300):
        base = text(k, 300, f"q{k}w").split()
        # each replaced word changes five shingles: 6 of 300 words give a similarity of about 0.82
        other = edited(" ".join(base), *range(20 + k % 7, 290, 46))
        a, b = (similar.shingle_hashes(t, 5) for t in (" ".join(base), other))
        jaccard = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        close += 0.8 <= jaccard < 0.85
        hit += bool(set(similar.band_keys(a).tolist()) & set(similar.band_keys(b).tolist()))
    assert close == 300
    assert hit == 300


@pytest.mark.parametrize("block", [1024, 3])
def test_links_need_the_similarity(spark, block):
    """Components are those of the true similarity of 0.8 over all pairs from 0.6 to 0.95, and none below links."""
    rng, rows = np.random.default_rng(1), []
    for k in range(60):
        base = text(k, 300, f"p{k}w")
        rows += [(10 * k, base)] + [(10 * k + i, edited(base, *rng.choice(300, n, replace=False).tolist())) for i, n in enumerate(rng.integers(2, 16, 3).tolist(), 1)]
    own = {d: shingles(t) for d, t in rows}
    sims = [len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b and a // 10 == b // 10]
    assert sum(0.6 <= s < 0.8 for s in sims) > 50 and sum(0.8 <= s < 0.95 for s in sims) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in similar.similar_dedup(docs, block=block).collect()}
    assert found == plain_similar(rows)


def test_near_duplicates_against_true_similarity(spark, rows, near_rows):
    """The stage keeps the smallest id of each component of the true similarity; a text and four fifths of it (0.74) both stay."""
    table = [(d, t) for d, t in [*rows, *((1000 + d, t) for d, t in near_rows)]]
    label = plain_similar(table)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    found = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert found == {d for d in label if label[d] == d}
    whole, part = (next(d for d, t in table if t == x) for x in (text(9), text(9, 60)))
    assert {whole, part} <= found


def shuffled(spark):
    """Bytes that the session's executors have written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_near_dedup_shuffles_only_texts_that_meet(spark):
    """With no small table broadcast of itself, unlike texts aren't shuffled, and a row of a key costs little."""
    unlike = [(k, " ".join(f"{x:016x}" for x in np.random.default_rng(k).integers(0, 2**62, 400).tolist())) for k in range(1500)]
    rows = [*unlike, *((5000 + k, edited(t, 200)) for k, t in unlike[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = shuffled(spark)
    with shared.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        found = {r.doc_id: r.component_id for r in similar.similar_dedup(docs).collect()}
    assert found == {d: d - 5000 if d >= 5000 else d for d, _ in rows}
    # 42 keys of a text, most of random bits, are held at once as an array and counted alone
    assert shuffled(spark) - before < 1500 * 42 * 32 < sum(len(t) for _, t in rows) / 4


@pytest.mark.parametrize("slots", [1 << 24, 64, 1])
def test_perhaps_in_loses_none(spark, slots):
    df = spark.createDataFrame([(k, "x") for k in range(-1000, 1000)] + [(None, "y")], "node long, text string")
    wanted = shared.write_out(df.filter("node % 50 = 0 or node < -995").select("node"), "wanted")
    found = [r.node for r in shared.perhaps_in(df, "node", wanted, slots).collect()]
    assert set(found) >= {r.node for r in wanted.collect()} and len(found) == len(set(found))
    assert len(found) < 60 if slots > 64 else len(found) <= 2001
    assert shared.perhaps_in(df, "node", shared.write_out(wanted.limit(0), "none"), slots).count() == 0
