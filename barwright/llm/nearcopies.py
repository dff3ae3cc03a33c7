"""One document of each group of near copies, by SimHash components and an exact join on rare shingles.

First the components of SimHash fingerprints (anchor-point covering, ``simhash``) are settled: inside one, a text goes if
it is similar to an earlier one. Two fingerprints at a similarity of 0.8 differ in some ten bits, which no anchor covering
with a bearable number of anchors bridges. So what is left is joined exactly on rare shingles: texts that are similar share
so many shingles of their prefixes. Pairs that do are verified, and of each component of similar texts one stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, column, free_name, materialise
from .components import components
from .simhash import fingerprint, links, shingle_hashes

#: Texts a shingle's frequency is estimated on, and the most frequent shingles known by name; both only order shingles.
SAMPLE, COMMON = 20_000, 200_000
#: Texts of a group that one row group settles in order, about; larger groups are dealt out by hash.
GROUP = 256
#: Share of a text's shingles by which its prefix is longer than the shortest possible one. Similar texts share that many
#: shingles of their prefixes, and one more, which pairs with a passage in common seldom do.
MORE = 0.1
#: Texts with a prefix shingle in common up to which each pair is looked at by itself.
PAIRED = 32


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets of hashes is ``similarity`` or more; that of two empty ones is 1."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def wanted(n: np.ndarray) -> np.ndarray:
    """How many shingles of its prefix a text of ``n`` shingles shares with a similar one of as many or more at least."""
    return 1 + (MORE * n).astype(np.int64)


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The rarest of the distinct ``hashes``: so many that similar sets share ``wanted`` of them in both prefixes.

    A similar set shares ``similarity`` of the hashes at least; in any order that all sets agree on, the first k of the
    shared ones are then among each set's first n - ceil(similarity n) + k. ``common`` (sorted) come last, by ``seen``.
    """
    n = len(hashes)
    keep = n - math.ceil(similarity * n - 1e-9) + int(wanted(np.array(n)))
    if keep >= n or not len(common):
        return hashes[:keep]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    often = np.where(common[at] == hashes, seen[at], 0)
    return hashes[np.lexsort((hashes, often))[:keep]]


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a text; texts without a word, null included, are one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    text = F.when(text.rlike(WORD), text).otherwise("")
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def _common_shingles(docs: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that a sample of about ``SAMPLE`` of the texts has often, and how often."""
    texts = docs.select("a").distinct().count()
    share = min(1.0, SAMPLE / max(texts, 1))
    # Texts are drawn by the hash of their key, and each one counts once.
    some = docs.where(F.xxhash64("b") / F.lit(2.0**64) + 0.5 <= share).groupBy("a").agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), words, seed)).view(np.int64))], ["token"])

    counts = some.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("seen"))
    table = counts.where("seen >= 4").orderBy(F.desc("seen"), "token").limit(COMMON).toArrow()
    common, seen = table.column("token").to_numpy().view(np.uint64), table.column("seen").to_numpy()
    order = np.argsort(common)
    return np.ascontiguousarray(common[order]), np.ascontiguousarray(seen[order])


def _sketches(docs: DataFrame, words: int, seed: int, similarity: float) -> DataFrame:
    """(a, b, id, print, n, prefix) for rows (a, b, id, text): fingerprint, number of shingles and the rare ones, as bytes."""
    order = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, words, seed))  # at most COMMON shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = order.value
        for batch in batches:
            prints, sizes, rare = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32), []
            for i, t in enumerate(batch.column(3).cast(pa.binary())):
                h = shingle_hashes(t.as_py(), words, seed)
                distinct = np.unique(h)
                prints[i], sizes[i] = fingerprint(h), len(distinct)
                rare.append(prefix(distinct, similarity, common, seen).tobytes() if len(h) else b"")
            made = [pa.array(prints.view(np.int64)), pa.array(sizes), pa.array(rare, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["a", "b", "id", "print", "n", "prefix"])

    added = T._parse_datatype_string("print long, n int, prefix binary").fields
    return docs.mapInArrow(run, T.StructType([*docs.drop("text").schema.fields, *added]))


def _with_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (a, b, id, ...) with the text of their row in ``docs``."""
    named = keys.withColumnsRenamed({"a": "a_", "b": "b_", "id": "id_"})
    same = (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")) & F.col("id").eqNullSafe(F.col("id_"))
    return docs.join(named, same).drop("a_", "b_", "id_")


def _settle(docs: DataFrame, members: DataFrame, similarity: float, words: int, seed: int) -> DataFrame:
    """Rows (a, b, id) of ``members`` (a, b, id, grp) that are similar to an earlier one that stays, of the same group.

    Groups of more than ``GROUP`` rows are dealt out by hash and settled part by part; that is done again with what is
    left of them as long as a tenth of the rows goes. Inside a part the smallest id comes first (null last). Rows go into a part one by
    one, and only the texts that stay are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stay = None, []
        for batch in batches:
            gone = np.zeros(batch.num_rows, bool)
            keys = zip(batch.column("grp").to_pylist(), batch.column("part").to_pylist())
            for i, (key, text) in enumerate(zip(keys, batch.column("text").cast(pa.binary()))):
                if key != now:
                    now, stay = key, []
                own = np.unique(shingle_hashes(text.as_py(), words, seed))
                gone[i] = any(similar(own, x, similarity) for x in stay)
                if not gone[i]:
                    stay.append(own)
            yield batch.select(["a", "b", "id"]).filter(pa.array(gone))

    rounds: list[DataFrame] = []
    while True:
        sizes = materialise(members.groupBy("grp").agg(F.count("*").alias("rows")).where("rows > 1"), "group-sizes")
        open_rows = sizes.agg(F.sum("rows")).first()[0]
        if not open_rows:
            break
        parts = F.ceil(F.col("rows") / GROUP)
        dealt = members.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64(F.lit(len(rounds)), "a"), parts).cast("int"))
        rows = _with_texts(docs, materialise(dealt.select("a", "b", "id", "grp", "part"), "dealt"))
        order = ["grp", "part", F.col("id").asc_nulls_last(), "a", "b"]
        schema = members.select("a", "b", "id").schema
        gone = materialise(rows.repartition("grp", "part").sortWithinPartitions(*order).mapInArrow(run, schema), "gone")
        rounds.append(gone)
        if gone.count() * 10 < open_rows:
            break
        large = members.join(sizes.where(F.col("rows") > GROUP).select("grp"), "grp")
        members = materialise(large.join(gone.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "id", "grp"), "members")
    none = members.select("a", "b", "id").limit(0)
    return materialise(reduce(DataFrame.unionByName, rounds, none).distinct(), "gone")


def _meetings(texts: DataFrame) -> DataFrame:
    """(token, own, n) for each prefix shingle of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rare = part.column(2).to_pylist()
                counts = np.array([len(x) // 8 for x in rare])
                tokens = np.frombuffer(b"".join(rare), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), *(pa.array(np.repeat(part.column(c).to_numpy(), counts)) for c in (0, 1))], ["token", "own", "n"])

    return texts.select(F.col("a").alias("own"), "n", "prefix").mapInArrow(run, "token long, own long, n int")


def _pairs_and_crowds(texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v, null) of texts that may be similar by their sizes and their shared prefix shingles; and rows
    (own, null, token) of shingles that more than ``PAIRED`` texts share, the crowded ones.

    A pair shares no more crowded shingles than either text has, so pairs need that many fewer others. Only a text with so
    many crowded ones that all it has to share may be among them is compared at these, and only at its first few: in any
    order two such texts share one of them.
    """

    names = ["u", "v", "token", "wanted"]

    def compared(token: np.ndarray, own: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(token)) + 1
        sizes = np.diff(np.concatenate([[0], edges, [len(token)]]))
        size = np.repeat(sizes, sizes)
        crowd = size > PAIRED
        if crowd.any():
            yield crowded(token[crowd], own[crowd], n[crowd])
        for lag in range(1, min(PAIRED, int(size.max()))):
            i = np.flatnonzero((token[lag:] == token[:-lag]) & ~crowd[lag:] & (n[:-lag] >= similarity * n[lag:] - 1e-9))
            if len(i):  # n[i] is the smaller of the two
                ends = [pa.array(f(own[i], own[i + lag])) for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays([*ends, pa.nulls(len(i), pa.int64()), pa.array(wanted(n[i]).astype(np.int32))], names)

    def crowded(token: np.ndarray, own: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        least = wanted(similarity * n).astype(np.int32)  # what a similar text of the smallest possible size shares
        return pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(token), pa.array(least)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the last, still open run no more than PAIRED rows are held; rows of a run known to be crowded pass at once.
        held, crowd = [np.empty(0, np.int64)] * 2 + [np.empty(0, np.int32)], None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in range(3)]
            if crowd is not None and len(now[0]):
                more = int(np.searchsorted(now[0], crowd, "right"))
                if more:
                    yield crowded(*(x[:more] for x in now))
                now = [x[more:] for x in now]
            now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                held = now
                continue
            crowd, cut = None, int(np.searchsorted(now[0], now[0][-1]))
            if len(now[0]) - cut > PAIRED:
                crowd = now[0][-1]
                yield crowded(*(x[cut:] for x in now))
                held = [x[:0] for x in now]
            else:
                held = [x[cut:] for x in now]
            if cut:
                yield from compared(*(x[:cut] for x in now))
        if len(held[0]):
            yield from compared(*held)

    rows = _meetings(texts).repartition("token").sortWithinPartitions("token", "n", "own")
    met = rows.mapInArrow(run, "u long, v long, token long, wanted int")
    counted = met.groupBy("u", "v", "token").agg(F.count("*").alias("shared"), F.any_value("wanted").alias("wanted"))
    counted = materialise(counted, "meetings")
    at_crowds = counted.where("token IS NOT NULL")
    counts = materialise(at_crowds.groupBy(F.col("u").alias("x")).agg(F.count("*").alias("c"), F.min("wanted").alias("least")), "crowd-counts")
    own = {side: counts.select(F.col("x").alias(side), F.col("c").alias(f"c{side}")) for side in "uv"}
    pairs = counted.where("token IS NULL").join(own["u"], "u", "left").join(own["v"], "v", "left")
    pairs = pairs.where(F.col("shared") >= F.col("wanted") - F.least(F.coalesce("cu", F.lit(0)), F.coalesce("cv", F.lit(0))))
    heavy = at_crowds.join(counts.where("c >= least"), F.col("u") == F.col("x"))
    nth = F.row_number().over(Window.partitionBy("u").orderBy("token"))  # no more rows than a prefix has
    heavy = heavy.withColumn("nth", nth).where("nth <= c - least + 1")
    return materialise(pairs.select("u", "v", "token").unionByName(heavy.select("u", "v", "token")), "candidates")


def _sets(docs: DataFrame, keys: DataFrame, words: int, seed: int) -> DataFrame:
    """(own, shingles): sorted distinct shingle hashes of the texts of ``keys`` (a, b, id), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words, seed)).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["own", "shingles"])

    rows = _with_texts(docs, keys).select(F.col("a").alias("own"), "text")
    return materialise(rows.mapInArrow(run, "own long, shingles binary"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array([similar(x, y, similarity) for x, y in zip(*sides)], pa.bool_()))

    first = pairs.join(sets.select(F.col("own").alias("u"), F.col("shingles").alias("x")), "u")
    both = first.join(sets.select(F.col("own").alias("v"), F.col("shingles").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _crowd_links(crowds: DataFrame, sets: DataFrame, similarity: float, part: int = GROUP) -> DataFrame:
    """Links (u, v) that connect all similar texts of crowds (u, token): pairs of parts, each verified in one row group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for key, u, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    now, held = key, []
                own, linked = np.frombuffer(raw, np.uint64), {u}
                for x, y, with_x in held:
                    if x not in linked and similar(own, y, similarity):
                        out.append((u, x))
                        linked |= with_x
                held = [(x, y, linked if x in linked else with_x) for x, y, with_x in held] + [(u, own, linked)]
            if out:
                u, v = (pa.array(x, pa.int64()) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])
                out = []

    parts = crowds.groupBy("token").agg((F.floor(F.count("*") / F.lit(part // 2)) + 1).cast("int").alias("parts"))
    dealt = crowds.join(materialise(parts, "crowd-parts"), "token").withColumn("own", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = spread.select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "u").distinct()
    rows = keyed.join(sets.select(F.col("own").alias("u"), "shingles"), "u").select("key", "u", "shingles")
    return rows.repartition("key").sortWithinPartitions("key", "u").mapInArrow(run, "u long, v long")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 4,
    similarity: float = 0.8, seed: int = 42,
) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they were.

    Two texts are similar if the Jaccard similarity of their sets of ``words``-word shingles is ``similarity`` or more (told
    apart by 64-bit hashes). No two rows that stay are similar, and every row that goes is linked by similar ones, one
    after the other, to one that stays; by and large those with small ids stay (null ids last). Texts without words, null
    ones included, are copies of each other. Equal rows are one; rows with null or repeated ids are told apart by their
    text. Empty table: empty result. Columns may have any names.
    """
    docs, keys = _once(docs, id_col, text_col)
    a, b = text_keys(column(docs, text_col))
    rows = docs.select(a.alias("a"), b.alias("b"), column(docs, id_col).alias("id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    # One row of each text takes part in what follows.
    texts = _sketches(rows, words, seed, similarity).groupBy("a", "b").agg(F.min("id").alias("id"), *(F.any_value(c).alias(c) for c in ("print", "n", "prefix")))
    texts = materialise(texts, "texts")
    first = texts.select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.col("id").alias("first"))
    copies = keys.join(first, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))).where(~F.col("id").eqNullSafe(F.col("first"))).select("a", "b", "id")

    prints = materialise(texts.select("print").distinct(), "prints")
    found = components(links(prints, threshold))
    roots = texts.groupBy("print").agg(F.count("*").alias("texts")).join(found, F.col("print") == F.col("node"), "left")
    roots = roots.where("root IS NOT NULL OR texts > 1").select(F.col("print").alias("print_"), F.coalesce("root", "print").alias("grp"))
    members = texts.select("a", "b", "id", "print").join(materialise(roots, "roots"), F.col("print") == F.col("print_")).select("a", "b", "id", "grp")
    gone = _settle(rows, materialise(members, "members"), similarity, words, seed)
    texts = texts.join(gone.select("a", "b"), ["a", "b"], "left_anti")

    met = _pairs_and_crowds(texts, similarity)
    crowds = met.where("token IS NOT NULL").select("u", "token")
    if not crowds.isEmpty():
        # Texts that crowd a shingle are mostly near copies: each text's smallest crowded shingle groups them.
        named = texts.select("a", "b", "id").join(crowds.groupBy(F.col("u").alias("a")).agg(F.min("token").alias("grp")), "a")
        more = _settle(rows, materialise(named.select("a", "b", "id", "grp"), "members"), similarity, words, seed)
        gone = gone.unionByName(more)
        texts = texts.join(more.select("a", "b"), ["a", "b"], "left_anti")
        met = met.join(more.select(F.col("a").alias("u")), "u", "left_anti").join(more.select(F.col("a").alias("v")), "v", "left_anti")
        met = materialise(met.select("u", "v", "token"), "meetings")
        crowds = met.where("token IS NOT NULL").select("u", "token")
    pairs = met.where("token IS NULL").select("u", "v")
    taking_part = met.select("u").unionByName(met.where("v IS NOT NULL").select(F.col("v").alias("u"))).distinct()
    looked_at = texts.select("a", "b", "id").join(materialise(taking_part.withColumnRenamed("u", "a"), "verified"), "a")
    sets = _sets(rows, materialise(looked_at.select("a", "b", "id"), "looked-at"), words, seed)
    similar_pairs = _verified(pairs, sets, similarity)
    if not crowds.isEmpty():
        similar_pairs = similar_pairs.unionByName(_crowd_links(crowds, sets, similarity))
    linked = components(materialise(similar_pairs, "similar")).withColumnRenamed("node", "a")
    linked = materialise(linked.join(texts.select("a", "b", "id"), "a"), "linked")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")
    best = linked.groupBy("root").agg(F.min(order).alias("best"))
    others = linked.join(best, "root").where("a <> best.a OR b <> best.b").select("a", "b", "id")

    # All rows of a text that goes, and the other rows of one that stays.
    lost = gone.select("a", "b", "id").unionByName(others).withColumnsRenamed({"a": "a_", "b": "b_"}).drop("id")
    of_lost = keys.join(lost.distinct(), (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))).select("a", "b", "id")
    named = [free_name(docs, c) for c in ("a_", "b_", "id_")]
    removed = copies.unionByName(of_lost).distinct().select(*[F.col(c).alias(n) for c, n in zip(("a", "b", "id"), named)])
    same = (a == F.col(named[0])) & (b == F.col(named[1])) & column(docs, id_col).eqNullSafe(F.col(named[2]))
    return docs.join(materialise(removed, "removed"), same, "left_anti")


def _once(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with one row for each id and text, and the keys (a, b, id) of these rows."""
    a, b = text_keys(column(docs, text_col))
    named = [free_name(docs, c) for c in ("a_", "b_", "id_")]
    own = [x.alias(n) for x, n in zip((a, b, column(docs, id_col)), named)]
    counted = materialise(docs.select(*own).groupBy(*named).agg(F.count("*").alias("rows")), "keys")
    keys = counted.select(*[F.col(n).alias(c) for n, c in zip(named, ("a", "b", "id"))])
    repeated = materialise(counted.where("rows > 1").select(*named), "repeated")
    if repeated.isEmpty():
        return docs, keys
    same = (a == F.col(named[0])) & (b == F.col(named[1])) & column(docs, id_col).eqNullSafe(F.col(named[2]))
    row = F.struct(*[column(docs, c) for c in docs.columns])
    # Partial aggregates take one row of each key before anything is shuffled.
    one = docs.join(repeated, same).select(*named, row.alias("row")).groupBy(*named).agg(F.any_value("row").alias("row"))
    back = one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return materialise(docs.join(repeated, same, "left_anti").unionByName(back), "rows"), keys
