import math
import re
import zlib

import numpy as np
import pytest

from barwright.llm import langid
from barwright.llm.q08_langid import op8_langid


def brute(word, vocabulary, p):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        k = vocabulary.get(word[:n], 0 if n == 1 else None)
        if k is not None:
            total += p[k] * brute(word[n:], vocabulary, p)
    return total


def test_forward_sums_all_segmentations():
    names = ["a", "ab", "b", "▁", "▁a", "bab"]
    number, known = {w: i + 1 for i, w in enumerate(names)}, langid.Vocabulary(names)
    table = np.random.default_rng(0).random((8, 2)) / 4
    table[-1] = 0
    words = ["▁abab", "ab", "x", "babx", "▁", "▁" + "abxbab" * 3]
    got = langid.word_scores(words, known, table)
    for w, row in zip(words, got):
        assert row == pytest.approx([math.log(brute(w, number, table[:, k])) for k in range(2)])
    counts = langid.expected_counts(["ab"], np.array([[2.0, 1.0]]), known, table)
    for k, weight in enumerate((2.0, 1.0)):
        apart, whole = table[1, k] * table[3, k], table[2, k]
        assert counts[2, k] == pytest.approx(weight * whole / (apart + whole)) and counts[1, k] == pytest.approx(weight * apart / (apart + whole))


def test_words_of_any_length_are_scored_whole():
    names = ["a", "ab", "b", "▁", "▁a", "bab"]
    known, table = langid.Vocabulary(names), np.full((8, 2), 1e-7)
    table[1:7, 0] = np.arange(1, 7) / 30
    table[-1] = 0
    word = "▁" + "abbab" * 2000
    number, logs = {w: i + 1 for i, w in enumerate(names)}, []
    for k in range(2):  # the same sums in logarithms, letter by letter
        sums = [0.0]
        for j in range(len(word)):
            terms = [sums[i] + math.log(table[p, k]) for i in range(max(0, j - 2), j + 1) if (p := number.get(word[i : j + 1], 0 if i == j else None)) is not None]
            sums.append(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))
        logs.append(sums[-1])
    assert langid.word_scores([word], known, table)[0] == pytest.approx(logs)
    # Expected letters of a word are its letters, however they are cut.
    counts = langid.expected_counts([word], np.ones((1, 2)), known, table)
    assert (counts[:7] * np.array([1, 1, 2, 1, 1, 2, 3])[:, None]).sum(axis=0) == pytest.approx([len(word)] * 2)


def test_query_against_brute_force(spark, sf_dir):
    """Predictions of all documents, each word's sums taken by recursion over all its cuts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    learn = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", "text", "lang").where("coalesce(crc32(string(doc_id)) % 3 <> 1, true)")
    model = langid.train(learn, langid.default_vocabulary())
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model.path)
    number: dict = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i).lower()
        if piece == "▁" or piece.removeprefix("▁").isalpha():
            number.setdefault(piece, len(number) + 1)
    longest, scores = max(map(len, number)), {}

    def score(word):
        if word not in scores:
            sums = [np.ones(len(model.languages))]
            for j in range(len(word)):
                cuts = ((i, number.get(word[i : j + 1], 0 if i == j else None)) for i in range(max(0, j + 1 - longest), j + 1))
                sums.append(sum(sums[i] * model.table[p] for i, p in cuts if p is not None))
            scores[word] = np.log(sums[-1])
        return scores[word]

    want = {}
    for d in docs:
        words = ["▁" + w for w in re.findall(r"[^\W\d_]+", (d.text or "").lower())]
        total = sum((score(w) for w in words), np.zeros(len(model.languages)))
        want[d.doc_id] = model.languages[int(total.argmax())] if words else "und"
    got = {r.doc_id: r.lang_pred for r in op8_langid(spark, sf_dir).collect()}
    assert got == want


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_langid(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_edge_rows(spark):
    rows = [(1, "the cat", "en"), (2, "der hund", "de"), (3, None, "en"), (4, "12 _ ½ ²", "en"), (None, "the dog", None), (6, "the " * 50000, "en"), (2, "der hund", "de"), (7, "x" * 100000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS word")
    learn = docs.selectExpr("doc_id AS id", "text", "lang")
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(learn, langid.default_vocabulary())).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, None, 6)] == ["en", "de", "und", "und", "en", "en"] and got[3].score == 0
    none = langid.predict(docs, langid.train(learn.limit(0), langid.default_vocabulary())).collect()
    assert len(none) == len(rows) and {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), langid.train(learn, langid.default_vocabulary())).collect() == []
