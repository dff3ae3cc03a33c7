"""SimHash near-duplicates, candidate pairs found by covering the Hamming space with anchor points.

Fingerprints have 64 bits. Two of them that differ in at most ``threshold`` bits differ in at most half of that in
one of two 31-bit blocks. In a block the anchors are the words of the binary Hamming code of length 31: its covering
radius is 1, so the block value half-way between two linked ones has an anchor one step away, and both ends lie
within that radius plus half the distance. Each fingerprint is replicated to every anchor within covering radius plus
(half the block's) threshold; linked ones therefore meet at an anchor, and are compared there over all 64 bits. For a
threshold of 4 that is 15.5 anchors a block on average, out of 2^26, so the table grows in proportion to the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_by_run, column, materialise
from .components import components

BLOCK_BITS = 31
#: Runs up to this length are compared pair by pair, longer ones yield a spanning forest of their links.
SHORT_RUN = 8
#: Anchors with more fingerprints are compared in pairs of parts of at most this size, each pair a row group of its own.
PART = 8192


# ---- fingerprints


def shingle_hashes(text: bytes | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` lower-cased words (A-Z only), repeats included."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the hashes have it; no hashes: 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """Table (id_col, fingerprint long: the 64 bits as a signed number) with one row per row of ``docs``.

    Whole texts; null and empty texts and texts of white space alone have the fingerprint 0. Ids of any type,
    null and repeated ones included, pass as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(shingle_hashes(t.as_py(), words, seed)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fingerprint", T.LongType())])
    source = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


# ---- anchors


@cache
def ball(radius: int) -> list[np.ndarray]:
    """For each syndrome of the Hamming code of length 31 the flips of at most ``radius`` bits that lead to a codeword."""
    found: list[list[int]] = [[] for _ in range(32)]
    for n in range(radius + 1):
        for bits in combinations(range(1, BLOCK_BITS + 1), n):
            s = mask = 0
            for b in bits:
                s, mask = s ^ b, mask | 1 << (b - 1)
            found[s].append(mask)
    return [np.array(x, np.int64) for x in found]


def syndromes(blocks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(blocks), np.int64)
    for b in range(1, BLOCK_BITS + 1):
        out ^= (blocks >> (b - 1) & 1) * b
    return out


def anchor_radius(threshold: int) -> int:
    """Covering radius 1 plus half of what one of the two blocks differs in at most."""
    return 1 + (threshold // 2 + 1) // 2


def anchor_rows(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys (block number above the codeword) and the fingerprint of each."""
    flips, keys, owners = ball(anchor_radius(threshold)), [], []
    bits = prints.view(np.uint64)
    for block in range(2):
        x = (bits >> np.uint64(block * BLOCK_BITS) & np.uint64(2**BLOCK_BITS - 1)).astype(np.int64)
        s = syndromes(x)
        for syndrome in range(32):
            own = np.flatnonzero(s == syndrome)
            keys.append(((x[own][:, None] ^ flips[syndrome]) | block << BLOCK_BITS).ravel())
            owners.append(np.repeat(prints[own], len(flips[syndrome])))
    return np.concatenate(keys), np.concatenate(owners)


# ---- comparing at an anchor


def forest(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints; one edge at most for each of them."""
    bits, left = prints.view(np.uint64), np.ones(len(prints), bool)
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    for start in range(len(prints)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            i = queue.pop()
            open_ = np.flatnonzero(left)
            near = open_[np.bitwise_count(bits[open_] ^ bits[i]) <= threshold]
            left[near] = False
            queue.extend(near.tolist())
            us.append(np.full(len(near), prints[i]))
            vs.append(prints[near])
    none = np.empty(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def run_links(keys: np.ndarray, prints: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (u, v) in runs of equal keys."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
    sizes = ends - starts
    bits, run_size = prints.view(np.uint64), np.repeat(sizes, sizes)
    short = run_size <= SHORT_RUN
    for lag in range(1, SHORT_RUN):
        i = np.flatnonzero((keys[lag:] == keys[:-lag]) & short[lag:])
        if not len(i):
            break
        i = i[np.bitwise_count(bits[i] ^ bits[i + lag]) <= threshold]
        yield prints[i], prints[i + lag]
    for a, b in zip(starts[sizes > SHORT_RUN].tolist(), ends[sizes > SHORT_RUN].tolist()):
        yield forest(prints[a:b], threshold)


def _compared(rows: DataFrame, key: str, threshold: int) -> DataFrame:
    """Rows (key long, print long) to links (u, v) between rows of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_by_run(batches, key):
            keys, prints = (table.column(c).to_numpy() for c in (key, "print"))
            for u, v in run_links(keys, prints, threshold):
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return rows.repartition(key).sortWithinPartitions(key, "print").mapInArrow(run, "u long, v long")


def links(prints: DataFrame, threshold: int = 4, part: int = PART) -> DataFrame:
    """Links (u long, v long) between distinct fingerprints of ``prints`` (column print long, no repeats).

    Every two fingerprints within ``threshold`` bits are connected by the rows; inside a crowded anchor these are a
    spanning forest instead of all pairs. No anchor is capped: anchors are counted first (partial aggregates), and one
    with more than ``part`` fingerprints is dealt out as pairs of parts, each compared by itself.
    """

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 4096):
                keys, owners = anchor_rows(np.ascontiguousarray(own[at : at + 4096]), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], ["anchor", "print"])

    at_anchor = prints.select("print").mapInArrow(replicate, "anchor long, print long")
    parts = at_anchor.groupBy("anchor").agg((F.floor(F.count("*") / F.lit(part // 2)) + 1).cast("int").alias("n")).where("n > 2")
    parts = materialise(parts, "crowded-anchors")
    if parts.isEmpty():
        return materialise(_compared(at_anchor, "anchor", threshold).distinct(), "links")
    done = _compared(at_anchor.join(parts, "anchor", "left_anti"), "anchor", threshold)
    dealt = at_anchor.join(parts, "anchor").withColumn("own", F.pmod(F.xxhash64("print"), F.col("n")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    keyed = pairs.select(F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("anchor"), "print")
    # Hashed keys that meet by chance are only compared needlessly; a part pair is about ``part`` rows.
    return materialise(done.unionByName(_compared(keyed.distinct(), "anchor", threshold)).distinct(), "links")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, threshold: int = 4, seed: int = 42
) -> DataFrame:
    """Table (id_col, fingerprint long, component_id): the class of each row of ``docs``.

    ``component_id`` is the smallest id in the row's component of fingerprints linked at ``threshold`` or fewer
    differing bits (null only if all of the component's ids are null). Rows with equal fingerprints are one node, so
    copies are never expanded into pairs. Empty table: empty result. Repeated rows stay repeated.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    nodes = materialise(prints.groupBy(F.col("fingerprint").alias("print")).agg(F.min(id_col).alias("first")), "prints")
    found = components(links(nodes, threshold))
    rooted = nodes.join(found, nodes["print"] == found["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    rooted = materialise(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("print", "component_id"), "components")
    return prints.join(named, prints["fingerprint"] == named["print"]).select(id_col, "fingerprint", "component_id")
