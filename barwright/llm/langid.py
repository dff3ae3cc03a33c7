"""Language of texts by unigrams of vocabulary pieces, all segmentations of a word summed.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over
all ways to cut it into pieces, of the products of their probabilities: a forward pass over the word's letters. The
probabilities are trained by expectation maximisation, whose expected piece counts weigh all segmentations too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialise

#: Words are runs of letters and marks, lower-cased.
APART = r"[^\pL\pM]+"
PIECE = re.compile(r"[^\W\d_]+")
#: Documents per language that the models are trained on at most, and rounds of training.
TRAIN_DOCS, ROUNDS = 800, 3
#: Added to each expected count.
SMOOTH = 0.05
#: Distinct words whose scores a worker remembers, if they are no longer than this.
REMEMBERED, SHORT = 400_000, 40
#: Bytes of text and rows taken at a time, about, and cells of a table of pieces.
TEXT_BYTES, TEXT_ROWS, CELLS = 16 << 20, 4096, 1 << 21
UNDECIDED = "und"


class Vocabulary:
    """Lower-cased letter pieces of a sentencepiece vocabulary, numbered from 1; 0 is any single letter it lacks.

    Pieces are the marked nodes of a trie whose edges are one sorted array of (node, letter).
    """

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        nodes, number = {"": 0}, {p: i + 1 for i, p in enumerate(pieces)}
        for p in pieces:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        edges = sorted((nodes[x[:-1]] << 21 | ord(x[-1]), n, number.get(x, -1)) for x, n in nodes.items() if x)
        self.edges, self.to, self.piece = (np.array([e[c] for e in edges] or [2**62 if c == 0 else -1], np.int64) for c in range(3))

    def grid(self, letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the piece of k + 1 letters that starts at letter i, at [i, k]; -1 where there is none.

        ``letters`` are code points of words one after the other, ``ends`` where each letter's word ends.
        """
        out = np.full((len(letters), self.longest), -1, np.int32)
        at, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        for k in range(self.longest):
            inside = at + k < ends[at]
            at, node = at[inside], node[inside]
            key = node << 21 | letters[at + k]
            e = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[e] == key
            at, e = at[hit], e[hit]
            node, out[at, k] = self.to[e], self.piece[e]
            if not len(at):
                break
        out[:, 0] = np.where(out[:, 0] < 0, 0, out[:, 0])
        return out


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    named = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return Vocabulary(list(dict.fromkeys(p for p in named if p == "▁" or PIECE.fullmatch(p.removeprefix("▁")))))


def text_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in parts of bounded rows and bytes; a text is never cut."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right"))
        to = min(len(texts), at + TEXT_ROWS, max(at + 1, full))
        yield texts.slice(at, to - at)
        at = to


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of whole texts, each led by the vocabulary's mark of a word's start; the number of the word at
    each place, all texts one after the other; and where each text ends there. Texts without a letter have no words."""
    texts = pc.fill_null(texts, "")
    lower = pc.if_else(pc.match_substring_regex(texts, r"\pL"), pc.utf8_lower(texts), "")
    split = pc.split_pattern_regex(lower, APART)
    coded = split.flatten().dictionary_encode()
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    index = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    if "" in names:  # before a first and behind a last word
        real = index != names.index("")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        index = index[real]
    return ["▁" + w for w in names], index, ends[1:]


def _batches(words: list[str], known: Vocabulary, languages: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length together: which ones, and the numbers of their pieces as [word, first letter, letters - 1]."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        n = int(sizes[order[at]])
        same = int(np.searchsorted(sizes[order], n, "right")) - at
        own = order[at : at + min(same, max(1, CELLS // (n * max(known.longest, languages))))]
        at += len(own)
        letters = np.frombuffer("".join(words[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        yield own, known.grid(letters, np.repeat(np.arange(1, len(own) + 1) * n, n)).reshape(len(own), n, -1)


def _forward(grid: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all cuts up to each place, [place, word, language], each place's as a share of exp(its logarithm).

    ``table`` has a last row of zeros, which -1 picks. The shares keep words of any length from underflowing.
    """
    n, length, longest = grid.shape
    alpha, log = np.zeros((length + 1, n, table.shape[1])), np.zeros((length + 1, n, table.shape[1]))
    alpha[0] = 1
    for j in range(length):
        total = alpha[j] * table[grid[:, j, 0]]
        for i in range(max(0, j + 1 - longest), j):
            ids = grid[:, i, j - i]
            if (ids >= 0).any():
                total += alpha[i] * table[ids] * np.exp(log[i] - log[j])
        log[j + 1], alpha[j + 1] = log[j], total
        if j % 8 == 7:
            alpha[j + 1], log[j + 1] = 1.0, log[j] + np.log(total)
    return alpha, log


def word_scores(words: list[str], known: Vocabulary, table: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language."""
    out = np.zeros((len(words), table.shape[1]))
    for own, grid in _batches(words, known, table.shape[1]):
        alpha, log = _forward(grid, table)
        out[own] = np.log(alpha[-1]) + log[-1]
    return out


def expected_counts(words: list[str], weights: np.ndarray, known: Vocabulary, table: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece in each language; ``weights`` are the words' counts in each language."""
    out = np.zeros_like(table)
    for own, grid in _batches(words, known, table.shape[1]):
        n, length, longest = grid.shape
        alpha, up = _forward(grid, table)
        # Sums over all cuts of what lies behind each place, in shares too.
        beta, down = np.zeros_like(alpha), np.zeros_like(up)
        beta[length] = 1
        whole, log = alpha[length], up[length]
        for i in range(length - 1, -1, -1):
            total = 0.0
            for j in range(i, min(length, i + longest)):
                total = total + table[grid[:, i, j - i]] * beta[j + 1] * np.exp(down[j + 1] - down[i + 1])
            down[i], beta[i] = down[i + 1], total
            if i % 8 == 0:
                beta[i], down[i] = 1.0, down[i + 1] + np.log(total)
        for i in range(length):
            for j in range(i, min(length, i + longest)):
                ids = grid[:, i, j - i]
                if (ids >= 0).any():
                    share = alpha[i] * table[ids] * beta[j + 1] / whole * np.exp(up[i] + down[j + 1] - log)
                    np.add.at(out, ids, share * weights[own])
    out[-1] = 0
    return out


class Model:
    """Languages in order, and a table of piece probabilities (pieces and a last row of zeros) x languages."""

    def __init__(self, path: str, languages: list[str], table: np.ndarray):
        self.path, self.languages, self.table = path, languages, table
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(languages)))

    def of(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words; a worker's later tasks find those of short ones."""
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        out = self.scores[at]
        if len(new):
            fresh = [words[i] for i in new]
            out[new] = word_scores(fresh, vocabulary(self.path), self.table)
            short = [i for i in new.tolist() if len(words[i]) <= SHORT]
            if len(self.known) + len(short) > REMEMBERED:
                self.known = {}
            n, short = len(self.known), short[:REMEMBERED]
            if n + len(short) > len(self.scores):
                self.scores = np.resize(self.scores, (2 * (n + len(short)), self.scores.shape[1]))
            self.scores[n : n + len(short)] = out[short]
            self.known.update(zip((words[i] for i in short), range(n, n + len(short))))
        return out


def _examples(known: DataFrame, docs: int) -> DataFrame:
    """(text, lang) of the ``docs`` rows of each language with the smallest hashes; equal rows are one.

    Counts give a hash below which a language has little more than that, so no task ranks more.
    """
    hashed = known.select("lang", "text", F.xxhash64("id", "text").alias("h")).where("text IS NOT NULL")
    counts = hashed.groupBy("lang").agg(F.count("*").alias("rows")).withColumnRenamed("lang", "lang_")
    # 1.5 times the wanted rows and 50 more are expected below the cut, where a language has that many.
    share = F.least(F.lit(1.0), (1.5 * docs + 50) / F.col("rows"))
    some = hashed.join(materialise(counts, "languages"), F.col("lang") == F.col("lang_")).where(F.col("h") / F.lit(2.0**64) + 0.5 <= share)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return some.dropDuplicates(["lang", "h", "text"]).withColumn("nth", nth).where(F.col("nth") <= docs).select("text", "lang")


def train(examples: DataFrame, path: str, docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit a model to ``examples`` (id, text, lang), rows with a null language left out.

    Per language the ``docs`` documents with the smallest hashes are used, whole (a bounded sample). Their words
    are counted, and each round's expected counts are summed, by Spark; what reaches the driver is one number per
    piece and language. Words with capitals count as their lower-cased forms.
    """
    spark = examples.sparkSession
    known = examples.where("lang IS NOT NULL")
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not languages:
        return Model(path, [], np.zeros((1, 0)))
    table = np.zeros((vocabulary(path).size + 1, len(languages)))
    number = {x: i for i, x in enumerate(languages)}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, group in zip(batch.column(1).to_pylist(), (batch.column(0).slice(i, 1) for i in range(batch.num_rows))):
                names, index, _ = words_of(group)
                if names:
                    counts = np.bincount(index, minlength=len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), number[lang], np.int32)), pa.array(counts)], ["word", "lang", "n"])

    counts = _examples(known, docs).mapInArrow(split, "word string, lang int, n long").where("n > 0")
    counts = counts.groupBy("word").pivot("lang", list(range(len(languages)))).sum("n").na.fill(0)
    counts = materialise(counts, "words")
    table[:-1] = 1 / (len(table) - 1)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(table)  # vocabulary times languages

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                weights = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(languages))]).astype(float)
                part = expected_counts(batch.column(0).to_pylist(), weights, vocabulary(path), now.value)
                total = part if total is None else total + part
            if total is not None:
                p, lang = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(lang), pa.array(total[p, lang])], ["piece", "lang", "n"])

        sums = counts.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        fresh = np.full_like(table, SMOOTH)
        fresh[-1] = 0
        fresh[sums["piece"], sums["lang"]] += sums["n"]
        table = fresh / fresh.sum(axis=0)
        now.unpersist()
    return Model(path, languages, table)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score): the likeliest language of each whole text, all as likely beforehand.

    ``score`` is its posterior probability. Texts that are null or have no letter, and all texts if the model has no
    language, are ``und`` with score 0; of equally likely languages the first in code point order counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tags = np.array([*m.languages, UNDECIDED], object)
        for batch in batches:
            pred, sure = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            at = 0
            for part in text_parts(batch.column(1)) if m.languages else ():
                names, index, ends = words_of(part)
                scores = m.of(names)
                sums = np.zeros((len(part), len(m.languages)))
                some = np.flatnonzero(np.diff(ends, prepend=0))
                starts = np.concatenate([[0], ends[:-1]])[some]
                for k in range(len(m.languages) if len(some) else 0):
                    sums[some, k] = np.add.reduceat(scores[index, k], starts)
                own, best = sums[some], sums[some].argmax(axis=1)
                pred[at + some] = best
                sure[at + some] = 1 / np.exp(own - own.max(axis=1, keepdims=True)).sum(axis=1)
                at += len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tags[pred], pa.string()), pa.array(sure)], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
