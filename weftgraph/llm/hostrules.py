"""Quality rules by host: rule failures by domain, shrunk with an empirical beta prior. Built-in functions only.

Each document gets its counts in one pass without a shuffle. Failures are then summed by host
(partial sums first, so a host with a third of all documents costs one row a task), the prior is
fitted to the hosts' rates by moments, and each host's verdict goes back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_enough, words_of, write_out

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: A host is rejected with all its documents if its shrunk failure rate is over this.
HOST_RATE = 0.8
#: Strength of the prior, in documents, where the hosts' rates differ no more than by chance.
STRONGEST = 1e6


def _beside(items: Column, join) -> Column:
    """Each item joined with the one after it (null after the last)."""
    return F.zip_with(items, F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), join)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of (doc_id, host, body).

    For n_repeat_words, a text's 3-word windows are sorted by 64-bit hash with their positions; a
    window repeats if a neighbour in that order has its hash. The positions found then ascend, and
    each adds the words that the one before it doesn't cover.
    """
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(
        "doc_id", "host", words_of(F.col("body")).alias("words"), lines.alias("lines"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    window = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p"))
    windows = F.when(F.size("words") > 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window)))
    step = step.select(
        "doc_id", "host", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    pair = lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))
    twice = F.array_sort(F.array_distinct(F.flatten(F.filter(_beside(F.col("windows"), pair), lambda x: x.isNotNull()))))
    step = step.select("doc_id", "host", "n_symbols", "n_words", "word_chars", "n_dup_lines", twice.alias("starts"))
    gains = _beside(F.col("starts"), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gains, F.lit(0), lambda total, x: total + x)
    return step.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def host_verdicts(by_host: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """host, n, failed, rate, host_ok from (host, n, failed). The prior is one row, fitted to all hosts."""
    share = F.sum("failed") / F.sum("n")
    mean = by_host.agg(share.alias("m")).first().m
    if mean is None:
        mean = 0.0
    spread = by_host.agg(
        (F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.lit(mean), 2)) / F.sum("n")).alias("seen"),
        (F.count("*") / F.sum("n")).alias("hosts_by_docs"),
    ).first()
    noise = mean * (1 - mean)
    between = (spread.seen or 0.0) - noise * (spread.hosts_by_docs or 0.0)
    strength = min(STRONGEST, max(1.0, noise / between - 1)) if between > 0 else STRONGEST
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return by_host.select("host", "n", "failed", rate.alias("rate"), (rate <= F.lit(host_rate)).alias("host_ok"))


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: a row for each row of ``docs``.

    A null text has no words, so it fails. Documents without a host are judged by the base rules
    alone. Repeated rows count as often as they occur. An empty table gives no rows. Other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = write_out(base_counts(rows).withColumn("base_failed", failed), "host-counts")
    by_host = counted.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    verdicts = host_verdicts(write_out(by_host, "host-failures"), host_rate).filter("not host_ok").select("host", "host_ok")
    return counted.join(small_enough(verdicts), "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"),
    )
