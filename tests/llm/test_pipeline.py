import random
from collections import Counter, defaultdict

import corpus_pipeline
from barwright.llm.simhash import shingle_hashes


def jaccard(a, b):
    x, y = (set(shingle_hashes(t.encode(), 5, 42).tolist()) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(6)
    words = [a + b + c for a in ("ba", "lo", "mi") for b in ("ren", "dol", "sta") for c in ("n", "r", "sk", "lm")]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    clean = [text(300) for _ in range(30)]
    near = clean[0].split(" ")
    near[5] = "changed"
    secret = text(120) + ' token = "0123456789abcdef0123456789abcdef01234567" ' + text(30)
    rows = [*clean, clean[0], " ".join(near), "too short", "spam spam spam " * 40, secret]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        kept[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
    ids = {k: Counter(r.doc_id for r in v) for k, v in kept.items()}
    assert set(ids["quality"]) == {*range(32), 34} and set(ids["near_duplicates"]) == {*range(30), 34}
    texts = {r.doc_id: r for r in kept["secrets"]}
    assert "[SECRET]" in texts[34].text and "0123456789abcdef" not in texts[34].text and texts[34].n_chars == len(texts[34].text)
    assert all(texts[i].text == rows[i] for i in range(30))
    assert max(ids["mixing"].values()) <= 3 and set(ids["mixing"]) <= set(texts)
    size = Counter()
    for r in kept["mixing"]:
        size[r.source] += len(r.text.split())
    assert size["s0"] > size["s1"] > size["s2"]
    fill = defaultdict(int)
    for r in kept["packing"]:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and set(ids["packing"]) == set(ids["mixing"])


def test_stages_on_edge_rows(spark, tmp_path):
    rng = random.Random(9)
    text = " ".join(f"{rng.choice('bdgklm')}a{rng.choice('nrst')}{i}" for i in range(90))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (None, text + " more", None, None, None), (3, None, None, None, 0), (4, "", "en", "", 0), (5, None, "xx", "s", None), (6, "word " * 20000, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS `row`", "2 AS `a.b`", "3 AS mix_id_", "4 AS key_", "5 AS piece")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {"quality": [1, 1, None], "near_duplicates": [1, 3, 6], "secrets": [1, 1, 3, 4, 5, 6, None]}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path)).collect()
        if name in want:
            assert sorted((r.doc_id for r in got), key=str) == sorted(want[name], key=str), name
        if name != "packing":
            assert list(got[0].asDict()) == docs.columns
        else:
            assert {r.doc_id for r in got} == {1, None, 3, 4, 5, 6} and max(r.offset + r.length for r in got) <= 1024
        if name == "mixing":
            assert {r.doc_id for r in got} >= {1, 6} and max(Counter((r.doc_id, r.text, r.source) for r in got).values()) <= 6
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name


def test_run_leaves_no_near_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, docs, sf_dir), sf_dir).collect()
    texts = [r.text for r in kept]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert packed and {r.doc_id for r in packed} <= {r.doc_id for r in kept}
