import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from barwright.llm import idstore, packing
from barwright.llm.q06_idstore import op6_idstore
from barwright.llm.q10_packing import op10_packing
from barwright.llm.tokens import PieceEncoder, default_tokenizer


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cut_texts_encode_as_whole_ones(plain):
    rng = random.Random(7)
    alphabet = list(" \n\t\r ab'1.é$ｗ\x1c\x00") + ["  ", "’s", "'s", " ", " ", "​", "　", "<|endoftext|>", "🙂", "\n\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(20000)]
    ids, sizes = PieceEncoder(default_tokenizer(), max_pieces=100).encode(pa.array(texts))
    got = np.split(ids, np.cumsum(sizes)[:-1])
    assert all(g.tolist() == plain(t) for g, t in zip(got, texts))
    ids, sizes = PieceEncoder(default_tokenizer()).encode(pa.array([None, "", "a b"]).slice(1))
    assert ids.tolist() == plain("a b") and sizes.tolist() == [0, 2]


def test_special_tokens_encode_as_the_library_has_them(plain):
    texts = ["a <|endoftext|> b", "foo  <|endoftext|>  bar.x", "<|endoftext|>", "no <|endof text|>", "x\n<|endoftext|><|endoftext|>\ny z", ""]
    ids, sizes = PieceEncoder(default_tokenizer()).encode(pa.array(texts))
    assert [g.tolist() for g in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(t) for t in texts]
    assert plain(texts[0]) == [64, 220, 50256, 275]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20000, dtype=np.int64))
    h = idstore.PerfectHash.build(keys.view(np.uint64))
    assert sorted(h.slots(keys.view(np.uint64)).tolist()) == list(range(len(keys)))
    index = idstore.ShardIndex.from_bytes(idstore.ShardIndex.build(keys, 0, np.ones(len(keys), np.int64), False).to_bytes())
    first, n = index.find(keys)
    assert first.tolist() == list(range(len(keys))) and set(n.tolist()) == {1}
    assert index.find(keys + 1)[1].sum() == int(np.isin(keys + 1, keys).sum())
    empty = idstore.ShardIndex.build(np.empty(0, np.int64), 0, np.empty(0, np.int64), False)
    assert empty.find(keys[:3])[1].tolist() == [0, 0, 0]


def test_id_store_query_equals_plain_encoding(spark, sf_dir, plain):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    at, want = 0, []
    for i, text in docs:
        ids = [*plain(text), 0]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in op6_idstore(spark, sf_dir).collect()) == want


EDGE = [(3, "b"), (None, "n"), (1, None), (2, ""), (3, "a a"), (3, "b"), (4, "long " * 20000), (-5, "neg")]


def test_id_store_edge_rows(spark, plain):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS part")
    rows = idstore.token_store(docs, default_tokenizer()).collect()
    assert sorted(((r.doc_id, r.ids_crc32) for r in rows), key=str) == sorted(((i, crc([*plain(t), 0])) for i, t in EDGE), key=str)
    by_start = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, -5, 1, 2, 3, 3, 3, 4]
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start[:-1])]).tolist()
    assert idstore.token_store(docs.limit(0), default_tokenizer()).collect() == []


def test_keyed_access_equals_brute_force(spark, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(idstore, "SHARD_BYTES", 2000)
    rng = random.Random(3)
    rows = [(rng.choice([None, 7, rng.randrange(-500, 500)]), "word " * rng.randrange(30)) for _ in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    idstore.write_shards(docs, default_tokenizer(), 0, f"file://{tmp_path}/store")
    shards = idstore.open_shards(spark, f"file://{tmp_path}/store")
    manifest = sorted((r.asDict() for r in shards.collect()), key=lambda r: r["part"])
    assert len(manifest) > 20 and sum(m["n_docs"] for m in manifest) == len(rows)
    ranges = [(m["first_key"], m["last_key"]) for m in manifest if m["first_key"] is not None]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:])) and sum(a == (7, 7) for a in ranges) > 2  # a hot key is split
    asked = [*range(-520, 520, 3), 7, 7, None, 2**62]
    got = idstore.lookup(shards, spark.createDataFrame([(k,) for k in asked], "id long")).collect()
    want = sorted((i, [*plain(t), 0]) for i, t in rows if i in set(asked) - {None})
    assert sorted((r.id, r.ids) for r in got) == want
    back = idstore.read_shards(shards).collect()
    assert sorted(((r.id, r.ids_crc32) for r in back), key=str) == sorted(((i, crc([*plain(t), 0])) for i, t in rows), key=str)


def check_packing(rows, docs, plain, capacity=1024):
    own, places = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    assert own.keys() == docs.keys()
    for i, text in docs.items():
        ids, got = [*plain(text), 2], sorted(own[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // capacity)))
        assert all(r.length == capacity for r in got[1:])
        for r in got:
            assert crc(ids[r.start : r.start + r.length]) == r.ids_crc32
        assert sum(r.length for r in got) == len(ids)
    return len(places), sum(r.length for r in rows)


def test_packing_query(spark, sf_dir, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    bins, total = check_packing(op10_packing(spark, sf_dir).collect(), docs, plain)
    assert bins <= 1.03 * -(-total // 1024) + 2


def test_packing_edge_rows(spark, plain):
    docs = {3: "b", 1: None, 2: "", 4: "long " * 20000, 5: "word " * 1022}
    frame = spark.createDataFrame([*docs.items()], "doc_id long, text string").selectExpr("*", "1 AS lot", "2 AS piece")
    check_packing(packing.pack(frame, default_tokenizer()).collect(), docs, plain)
    assert packing.pack(frame.limit(0), default_tokenizer()).collect() == []
    twice = packing.pack(spark.createDataFrame([(None, "a"), (7, "a"), (7, "a")], "doc_id long, text string"), default_tokenizer(), lot=1).collect()
    assert sorted(str(r.doc_id) for r in twice) == ["7", "7", "None"] and len({(r.sequence_id, r.offset) for r in twice}) == 3


def test_sum_of_squares_follows_its_rule():
    rng, capacity = random.Random(2), 20
    sizes = [rng.randint(1, capacity) for _ in range(400)]
    number, offset = packing.sum_of_squares(np.array(sizes), capacity)
    level: dict[int, int] = {}
    for s, k, at in zip(sizes, number.tolist(), offset.tolist()):
        assert level.get(k, 0) == at

        def total(after):
            gaps = defaultdict(int)
            for v in after.values():
                if 0 < v < capacity:
                    gaps[capacity - v] += 1
            return sum(v * v for v in gaps.values())

        options = [total(level | {j: v + s}) for j, v in [*level.items(), (-1, 0)] if v + s <= capacity]
        level[k] = at + s
        assert total(level) == min(options)
