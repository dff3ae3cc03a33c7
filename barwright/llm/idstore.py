"""Token ids as binary shards, with a minimal perfect hash index from document keys to their place.

A shard is two files. ``*.ids`` holds raw little-endian ids, one document after the other. ``*.idx`` holds what
locates them: the records' offsets and keys, and a minimal perfect hash over the distinct keys. The hash is a cascade
of bit arrays: a key sets the bit its level's hash points at if no other key does, and goes to the next level if one
does; the rank of its bit is its slot. A slot stores a fingerprint of the key and the key's first record and number
of records, so a lookup reads one slot and tells unknown keys but for one in 2^32.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_run, column, fresh_folder, materialise, running_totals
from .files import make_folder, open_store
from .tokens import encoder

MAGIC = b"IDSTORE1"
#: Texts encoded at a time.
SLICE = 2048
#: Bytes of text a shard holds, about, the most shards of a store, and rows that balance them.
SHARD_BYTES, MAX_SHARDS, SAMPLE = 16 << 20, 100_000, 1_000_000
#: Ids that a reader holds at a time.
READ_IDS = 1 << 21


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit words for each seed: two rounds of multiplying and folding (splitmix64)."""
    z = x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(at + np.cumsum(bits) - bits)
            at += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        """``keys`` must be distinct. Expected time and space are linear in their number."""
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            size = max(8, int(gamma * len(left)))
            at = (mix(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; for keys not built in a slot of another key or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for i, bits in enumerate(self.levels):
            at = (mix(keys[open_], i + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[i][at[hit]]
            open_ = open_[~hit]
        return out


def _marks(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0x51ED) >> np.uint64(32)).astype(np.uint32)


class ShardIndex:
    """What ``*.idx`` holds. Records stand in key order; null keys first, outside the hash."""

    def __init__(self, keys: np.ndarray, n_null: int, offsets: np.ndarray, hash_: PerfectHash, marks, firsts, counts, wide: bool):
        self.keys, self.n_null, self.offsets, self.hash = keys, n_null, offsets, hash_
        self.marks, self.firsts, self.counts, self.wide = marks, firsts, counts, wide

    @classmethod
    def build(cls, keys: np.ndarray, n_null: int, sizes: np.ndarray, wide: bool) -> ShardIndex:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        distinct, firsts, counts = np.unique(keys[n_null:], return_index=True, return_counts=True)
        hash_ = PerfectHash.build(distinct.view(np.uint64))
        slots = hash_.slots(distinct.view(np.uint64))
        marks, first, count = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        marks[slots], first[slots], count[slots] = _marks(distinct.view(np.uint64)), firsts + n_null, counts
        return cls(keys, n_null, offsets, hash_, marks, first, count, wide)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; unknown keys: 0 records."""
        slots = self.hash.slots(keys.view(np.uint64))
        known = slots >= 0
        known[known] = self.marks[slots[known]] == _marks(keys.view(np.uint64)[known])
        safe = np.where(known, slots, 0)
        if not len(self.firsts):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return self.firsts[safe], np.where(known, self.counts[safe], 0)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = [self.keys, self.offsets, self.marks, self.firsts, self.counts, *(np.packbits(b) for b in self.hash.levels)]
        head = [int(self.wide), self.n_null, len(self.hash.levels), *(len(b) for b in self.hash.levels), *(a.nbytes for a in arrays)]
        out.write(MAGIC + np.array([len(head), *head], "<i8").tobytes())
        for a in arrays:
            out.write(a.astype(a.dtype.newbyteorder("<")).tobytes())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> ShardIndex:
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not an id shard index")
        n = int(np.frombuffer(raw, "<i8", 1, len(MAGIC))[0])
        head = np.frombuffer(raw, "<i8", n, len(MAGIC) + 8).tolist()
        wide, n_null, n_levels = head[:3]
        sizes, lengths, at, arrays = head[3 : 3 + n_levels], head[3 + n_levels :], len(MAGIC) + 8 + 8 * n, []
        for k, length in enumerate(lengths):
            kind = ["<i8", "<i8", "<u4", "<i8", "<i8"][k] if k < 5 else "u1"
            arrays.append(np.frombuffer(raw, kind, length // np.dtype(kind).itemsize, at))
            at += length
        levels = [np.unpackbits(a, count=s).astype(bool) for a, s in zip(arrays[5:], sizes)]
        return cls(arrays[0], n_null, arrays[1], PerfectHash(levels), *arrays[2:5], bool(wide))


def text_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


SHARDS = "part int, path string, n_docs long, n_ids long, n_null long, first_key long, last_key long"


def split_points(source: DataFrame) -> tuple[np.ndarray, int]:
    """Where shards begin, as columns (flag, key, place) in order, and the number of shards; null keys have the flag 0.

    ``source``: (id, place, text). Shards hold about ``SHARD_BYTES`` of text each, or more where that would be over
    ``MAX_SHARDS`` of them. The points come from a sample of some hundred rows a shard, at most ``SAMPLE``, weighed by
    the length of their texts; they only balance the shards. Equal keys are told apart by place, so that no shard has to
    hold all of them.
    """
    rows, size = source.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = min(MAX_SHARDS, int((size or 0) // SHARD_BYTES) + 1)
    if shards == 1:
        return np.empty((3, 0), np.int64), 1
    share = min(1.0, min(SAMPLE, 100 * shards) / rows)
    some = source.where(F.xxhash64("place") / F.lit(2.0**64) + 0.5 < share)
    drawn = some.select(F.col("id").isNotNull().cast("long"), F.coalesce("id", F.lit(0)), "place", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).toArrow()
    flag, key, place, weight = (c.to_numpy() for c in drawn.columns)
    order = np.lexsort((place, key, flag))
    heavy = np.cumsum(weight[order])
    at = np.unique(np.searchsorted(heavy, heavy[-1] * np.arange(1, shards) / shards)) if len(heavy) else np.empty(0, np.int64)
    return np.array([flag[order][at], key[order][at], place[order][at]]), len(at) + 1


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write shards in ascending key order below ``folder``.

    Returns the manifest, which also stands in ``folder``: the shards (part, path, n_docs, n_ids, n_null, first_key,
    last_key); part numbers ascend with the keys. Texts are encoded where they are read, and only ids are shuffled. Null
    texts are empty, null keys come first, and rows with equal keys follow each other in the table's order. A task that
    is run again writes under a new name, and only the names of tasks that Spark counts are returned.
    """
    make_folder(folder)
    source = docs.select(column(docs, id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("place"), column(docs, text_col).cast("string").alias("text"))
    points, shards = split_points(source)
    shared = docs.sparkSession.sparkContext.broadcast(points)  # at most MAX_SHARDS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = "<u4" if enc.tokenizer.get_vocab_size() > 65536 or end_id > 65535 else "<u2"
        for part in text_slices(batches):
            ids, lengths = enc.encode(part.column(2))
            raw = np.insert(ids, np.cumsum(lengths), end_id).astype(kind).tobytes()
            ends = np.concatenate([[0], np.cumsum(lengths + 1)]) * np.dtype(kind).itemsize
            keys = [np.asarray(part.column(0).is_valid()).astype(np.int64), part.column(0).fill_null(0).to_numpy(), part.column(1).to_numpy()]
            flag, key, place = (np.concatenate([p, k]) for p, k in zip(shared.value, keys))
            order = np.lexsort((np.arange(len(key)), place, key, flag))  # a point comes before the row it was drawn from
            begun = np.cumsum(order < len(points[0]))
            number = np.empty(len(order), np.int32)
            number[order] = begun
            coded = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(number[len(points[0]) :]), part.column(0), part.column(1), coded], ["part", "id", "place", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name, keys, sizes, n_null, out, wide = uuid.uuid4().hex, [], [], 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                number = batch.column(0)[0].as_py()
                name = f"{number:06d}-{name}"
                out = store.open_output_stream(f"{root}/{name}.ids")
            coded = batch.column(3)
            lengths = pc.binary_length(coded).to_numpy()
            raw = np.frombuffer(coded.buffers()[2], np.uint8) if lengths.sum() else np.empty(0, np.uint8)
            begin = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset]
            out.write(raw[begin : begin + lengths.sum()].tobytes())
            n_null += batch.column(1).null_count
            keys.append(batch.column(1).fill_null(0).to_numpy().astype(np.int64))
            sizes.append(lengths)
        if out is None:
            return
        out.close()
        enc = encoder(tokenizer)
        wide = enc.tokenizer.get_vocab_size() > 65536 or end_id > 65535
        index = ShardIndex.build(np.concatenate(keys), n_null, np.concatenate(sizes) // (4 if wide else 2), wide)
        with store.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(index.to_bytes())
        own = index.keys[n_null:]
        ends = (own[0], own[-1]) if len(own) else (None, None)
        values = [number, f"{folder}/{name}", len(index.keys), int(index.offsets[-1]), n_null, *ends]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["part", "path", "n_docs", "n_ids", "n_null", "first_key", "last_key"])

    coded = source.mapInArrow(encode, "part int, id long, place long, ids binary")
    ordered = coded.repartitionById(shards, F.col("part")).sortWithinPartitions(F.col("id").asc_nulls_first(), "place")
    ordered.mapInArrow(write, SHARDS).write.parquet(f"{folder}/manifest")
    return open_shards(docs.sparkSession, folder)


def open_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a store that ``write_shards`` wrote."""
    return spark.read.schema(SHARDS).parquet(f"{folder}/manifest")


def lookup(shards: DataFrame, keys: DataFrame, key_col: str = "id") -> DataFrame:
    """(id, record, ids array<int>): the records of each key, each found by one probe of its shard's perfect hash.

    The manifest's key ranges (at most ``MAX_SHARDS`` of them) route a key to the shards that may hold it. Repeated keys
    are one, null and absent ones have no rows; a key with several records has a row for each, numbered within their
    shard. Only shards that are asked for are opened.
    """
    spark = shards.sparkSession
    known = sorted(tuple(r) for r in shards.where("first_key IS NOT NULL").select("part", "first_key", "last_key", "path").collect())
    first, last = (np.array([k[c] for k in known], np.int64) for c in (1, 2))
    ranges = spark.sparkContext.broadcast((first, last, [k[3] for k in known]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, _ = ranges.value
        for batch in batches:
            key = batch.column(0).to_numpy()
            lo, hi = np.searchsorted(last, key), np.searchsorted(first, key, "right")
            n = np.maximum(hi - lo, 0)
            place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(np.repeat(key, n))], ["shard", "id"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_by_run(batches, "shard"):
            at, key = (table.column(c).to_numpy() for c in ("shard", "id"))
            for shard in np.unique(at).tolist():
                store, path = open_store(ranges.value[2][shard])
                with store.open_input_stream(f"{path}.idx") as f:
                    index = ShardIndex.from_bytes(f.read())
                own = key[at == shard]
                firsts, counts = index.find(own)
                counts[counts > 0] *= index.keys[firsts[counts > 0]] == own[counts > 0]  # the fingerprint errs once in 2^32
                kind = np.dtype("<u4" if index.wide else "<u2")
                with store.open_input_file(f"{path}.ids") as f:
                    for k, a, n in zip(own.tolist(), firsts.tolist(), counts.tolist()):
                        for r in range(a, a + n):
                            f.seek(int(index.offsets[r]) * kind.itemsize)
                            ids = np.frombuffer(f.read(int(index.offsets[r + 1] - index.offsets[r]) * kind.itemsize), kind)
                            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([r]), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["id", "record", "ids"])

    asked = keys.select(column(keys, key_col).cast("long").alias("id")).dropna().distinct()
    routed = asked.mapInArrow(route, "shard int, id long").repartition("shard").sortWithinPartitions("shard", "id")
    return routed.mapInArrow(find, "id long, record long, ids array<int>")


def read_shards(shards: DataFrame) -> DataFrame:
    """Read shards back: (id, start, n_tokens, ids_crc32) per record, each found through its shard's hash index.

    ``start`` counts the ids of all records before it in the whole store, ``ids_crc32`` is the checksum of the ids as
    little-endian unsigned 32-bit integers.
    """
    based = materialise(running_totals(shards.select("part", "path", "n_ids"), [F.col("part")], "n_ids", "base"), "bases")
    n = max(1, min(10_000, based.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_stream(f"{path}.idx") as f:
                    index = ShardIndex.from_bytes(f.read())
                keys = np.unique(index.keys[index.n_null :])
                firsts, counts = index.find(keys)
                if counts.sum() + index.n_null != len(index.keys):
                    raise ValueError(f"index of {path} does not cover its records")
                records = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                records = np.concatenate([np.arange(index.n_null), records]).astype(np.int64)
                owner = np.concatenate([np.zeros(index.n_null, np.int64), np.repeat(keys, counts)])
                kind = np.dtype("<u4" if index.wide else "<u2")
                crcs = np.zeros(len(records), np.int64)
                with store.open_input_file(f"{path}.ids") as f:
                    at = 0
                    while at < len(records):
                        low = index.offsets[records[at]]
                        to = max(at + 1, int(np.searchsorted(index.offsets[records], low + READ_IDS)))
                        high = index.offsets[records[to - 1] + 1]
                        f.seek(int(low) * kind.itemsize)
                        ids = np.frombuffer(f.read(int(high - low) * kind.itemsize), kind).astype("<u4")
                        for k in range(at, to):
                            r = records[k]
                            crcs[k] = zlib.crc32(ids[index.offsets[r] - low : index.offsets[r + 1] - low])
                        at = to
                null = np.arange(len(records)) < index.n_null
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(owner, mask=null),
                        pa.array(row["base"] + index.offsets[records]),
                        pa.array(np.diff(index.offsets)[records]),
                        pa.array(crcs),
                    ],
                    ["id", "start", "n_tokens", "ids_crc32"],
                )

    return based.repartition(n).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as id shards in the shared folder and return what reading them gives, one row per document.

    Columns id_col, start, n_tokens, ids_crc32. Empty table: no shard and no row.
    """
    folder = fresh_folder(docs.sparkSession, "ids")
    return read_shards(write_shards(docs, tokenizer, end_id, folder, id_col, text_col)).withColumnRenamed("id", id_col)
