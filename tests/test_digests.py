"""Canonical text, order-sensitive digests and repeated files."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from barwright.operators import digests


def test_canonical_text_is_the_same_for_equal_values(spark):
    rows = spark.sql("""SELECT named_struct('b', 2.0D, 'a', 'say "hi"\\n', 'm', map('z', 1, 'k', CAST(NULL AS INT)), 'l', array(1.5D, CAST('NaN' AS DOUBLE), -0.0D), 'n', CAST(NULL AS STRING), 't', true) AS s""")
    got = rows.select(digests.canonical(F.col("s"), rows.schema["s"].dataType).alias("j")).first().j
    assert json.loads(got) == {"a": 'say "hi"\n', "b": 2, "l": [1.5, None, 0], "m": {"k": None, "z": 1}, "n": None, "t": True}
    assert got.index('"a"') < got.index('"b"') < got.index('"l"') and " :" not in got and '"k":null,"z":1' in got
    same = spark.sql("""SELECT named_struct('t', true, 'l', array(1.5D, CAST('NaN' AS DOUBLE), 0.0D), 'a', 'say "hi"\\n', 'n', CAST(NULL AS INT), 'm', map('k', CAST(NULL AS INT), 'z', 1), 'b', 2L) AS s""")
    assert same.select(digests.canonical(F.col("s"), same.schema["s"].dataType).alias("j")).first().j == got


def merkle(rows, fan):
    level = [hashlib.sha256(r.encode()).hexdigest() for r in rows]
    while True:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("fan", [3, 1024])
def test_digest_sees_order_and_not_partitions(spark, fan, monkeypatch):
    monkeypatch.setattr(digests, "FAN", fan)
    rows = [(g, i, f"v{i * 7 % 11}") for g, n in (("a", 100), ("b", 3), ("c", 1), ("d", 10)) for i in range(n)]
    frame = lambda r: spark.createDataFrame(r, "g string, i long, v string")
    run = lambda df: {r.g: (r.n, r.digest) for r in digests.ordered_digest(df, ["g"], "i", ["v"]).collect()}
    want = {g: (n, merkle([f'{{"v":"v{i * 7 % 11}"}}' for i in range(n)], fan)) for g, n in (("a", 100), ("b", 3), ("c", 1), ("d", 10))}
    assert run(frame(rows)) == want
    assert run(frame(random.Random(1).sample(rows, len(rows))).repartition(7)) == want
    swapped = [(g, {4: 5, 5: 4}.get(i, i) if g == "a" else i, v) for g, i, v in rows]
    got = run(frame(swapped))
    assert got["a"] != want["a"] and all(got[k] == want[k] for k in "bcd")
    assert run(frame([])) == {}


def test_repeated_and_begun_files_are_found(spark):
    files = {1: "abcd", 2: "abcd", 3: "ab", 4: "abx", 5: "abcdef", 6: "zz", 7: "zzz", 8: "q", 9: "ba", 10: "abcd"}
    lines = spark.createDataFrame([(k, i, c) for k, v in files.items() for i, c in enumerate(v)], "file int, at int, line string").repartition(5)
    got = {r.file: (r.n, r.same_as, r.prefix_of) for r in digests.prefix_duplicates(lines, "file", "at", ["line"]).collect()}
    assert got == {1: (4, None, 5), 2: (4, 1, 5), 10: (4, 1, 5), 3: (2, None, 1), 6: (2, None, 7)}
    assert digests.prefix_duplicates(lines.limit(0), "file", "at", ["line"]).collect() == []


def test_levels_end_where_they_are_told_to(spark, monkeypatch):
    monkeypatch.setattr(digests, "FAN", 2)
    df = spark.createDataFrame([("long", i) for i in range(9)] + [("short", 0), ("short", 1), ("one", 5)], "k string, i int")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = [sha(f'{{"i":{i}}}') for i in range(9)]
    pairs = [sha("".join(rows[i : i + 2])) for i in range(0, 9, 2)]
    fours = [sha("".join(pairs[i : i + 2])) for i in range(0, 5, 2)]
    found = lambda levels: {r.k: (r.n, r.digest) for r in digests.ordered_digest(df, ["k"], "i", ["i"], levels).collect()}
    assert found(2) == {"long": (9, sha("".join(pairs))), "short": (2, pairs[0]), "one": (1, sha(rows[5]))}
    assert found(3)["long"] == (9, sha("".join(fours))) and found(1)["long"] == (9, sha("".join(rows)))
