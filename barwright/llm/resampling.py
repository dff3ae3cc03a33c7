"""Importance resampling: documents whose hashed n-grams are more usual in a target than in the corpus are drawn first.

Every n-gram falls into one of ``buckets`` classes; a class gains what its smoothed share among the target's n-grams is
over that among the corpus', as a logarithm. A document's weight is the mean gain of its n-grams, and seeded Gumbel noise
makes the highest sums a draw without replacement by weight.

Texts are cut and counted by Arrow kernels in tasks. What tasks send on is one count per class, and what comes back to them is
one gain per class, whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, running_totals

#: What separates words, after lower-casing: ASCII characters that are no digits or letters.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Bytes of text that kernels take at a time, about; a longer text is taken alone.
TEXT_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, text: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``size`` (TEXT_BYTES) bytes of text each, a single longer text as a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + (size or TEXT_BYTES), "right")))
        yield batch.slice(start, stop - start)
        start = stop


def ngrams(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each n-gram, its class, words of each row) of texts; a null text has none. Rows of n-grams needn't be in order.

    Words are numbered by dictionary; an n-gram is the pair of the (n - 1)-gram before its last word and that word. Only
    distinct pairs are hashed, each on from the hash of what it extends.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), APART)
    rows, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    whole = pc.not_equal(flat, "")  # splitting leaves an empty string at either end of a text
    coded = flat.filter(whole).dictionary_encode()
    rows = rows.filter(whole).to_numpy(zero_copy_only=False)
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [w.encode() for w in coded.dictionary.to_pylist()]
    words = np.bincount(rows, minlength=len(texts))
    gram, crc = word, np.array([zlib.crc32(w) for w in spelled], np.int64)
    all_rows, classes = [rows], [(crc % buckets)[gram] if len(gram) else gram]
    for n in range(2, longest + 1):
        at = np.arange(len(rows) - n + 1) if len(rows) >= n else np.arange(0)
        at = at[rows[at] == rows[at + n - 1]]
        pairs, found = np.unique(gram[at] * max(1, len(spelled)) + word[at + n - 1], return_inverse=True)
        before, last = np.divmod(pairs, max(1, len(spelled)))
        crc = np.array([zlib.crc32(b" " + spelled[w], int(crc[g])) for g, w in zip(before, last)], np.int64)
        gram = np.full(len(rows), -1, np.int64)
        gram[at] = found
        all_rows.append(rows[at])
        classes.append((crc % buckets)[found] if len(found) else found)
    return np.concatenate(all_rows), np.concatenate(classes), words


def class_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all ``texts`` (one string column) fall into each class: ``buckets`` numbers on the driver."""
    name = texts.columns[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, name):
                total += np.bincount(ngrams(part.column(name), longest, buckets)[1], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["class", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the ratio of smoothed shares, rounded down, per class."""
    k, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log(((target + 1.0) * (s + k)) / ((corpus + 1.0) * (t + k)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of ``docs`` (doc_id, text): the floored mean gain of its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, classes, words = ngrams(part.column("text"), longest, len(gain))
                order = np.argsort(rows, kind="stable") if longest > 1 else slice(None)
                n = np.bincount(rows, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.int64)
                full = np.flatnonzero(n)
                if len(full):  # sums of the runs of a row's gains
                    total[full] = np.add.reduceat(gain.take(classes[order]), (np.cumsum(n) - n)[full])
                weight = total // np.maximum(n, 1)
                yield pa.record_batch([part.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate from the id, rounded down; a null id is hashed as the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def rank(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Adds ``score`` and ``rank`` (1, 2, ... in the order drawn, null where not drawn) to rows of ``weigh``.

    Drawn are ``percent`` of the rows with at least ``least_words`` words, rounded down: those of the highest scores,
    ties to the smaller id, null ids last. Repeated rows are drawn each; which of rows equal in all has which rank is open. The
    order is a sort in ranges, so no task sees more than its range.
    """
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    fit = scored.where(F.col("n_words") >= least_words).withColumn("one", F.lit(1))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features"), F.col("n_words")]
    drawn = percent * fit.count() // 100
    placed = running_totals(fit, order, "one", "before").drop("one")
    ranked = placed.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1)).drop("before")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def weigh_against(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``weigh`` with the gains of ``target`` (text) over all ``docs`` (doc_id, text, ...). Null texts have no n-grams and weight 0."""
    corpus, wanted = (class_counts(t.select(column(t, "text").cast("string").alias("text")), longest, buckets) for t in (docs, target))
    return weigh(docs, gains(wanted, corpus), longest)


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that are drawn, columns as they were; rows that share a drawn id are drawn together."""
    ids = rank(weigh_against(docs, target, longest, buckets), percent, least_words, seed).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, column(docs, "doc_id").cast("long").eqNullSafe(F.col("drawn_id")), "left_semi")
