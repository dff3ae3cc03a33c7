"""Log-probability of texts by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words, each ended by a space, and an end byte of its own. Bytes are coded in bits by prefix codes made
from the corpus' counts of bytes after one another, so a usual letter is few decisions. For each bit several predictors look up the context they see
(the last bytes of the word, the whole of it so far, either with the leader of the text so far) in hashed tables of how often the bit
was 0 and 1 in the training words, as a logit. The leader is the most frequent yet of a few very common words: it tells languages
and kinds of text apart. A mixer adds the logits by weights and squashes the sum; its set of weights is gated by how often the word
so far was seen, or else how many contexts are known, and by how far into the byte the bit stands. The first weights are learned from all
occurrences of all training words, each looked up in counts without itself, and every document refines its own copy as it goes: what a
bit costs is settled before the weights learn from it, so a document's bits add up to a proper probability of the whole text. Letters of
other words are no context; that makes the inputs of a word the same wherever it stands under one leader, and they are looked up once
for each distinct pair of a chunk of texts.

Texts are cut into words once, in chunks, and kept as numbers of the chunk's words. The predictors add up over all training words in
Spark, in ranges of slots; the tables grow with the words' letters up to a fixed size and are broadcast. Counts of words, which grow
with the corpus, meet the chunks' words in a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, column, materialise, partition_id
from .resampling import slices

#: What the predictors see: bytes of the word, 0 for all since its start, and whether they see the leader; which one's counts gate.
CONTEXTS = [(2, False), (3, False), (5, False), (3, True), (0, False), (0, True)]
SURE = CONTEXTS.index((0, True))
#: Common words of which one leads a text.
LEADERS = 16
#: Slots of a predictor's table as a power of two: at least, at most.
FEWEST, MOST = 14, 22
#: Slots of one context lie this near, as a power of two, so that they share cache lines.
NEAR = 10
#: The sums of a table are taken in so many ranges, as a power of two.
RANGES = 4
#: Logits are kept in sixteenths of a byte's range.
SCALE = 16.0
#: Weight that learning starts from, rate of learning in a document, and samples at which a block's step is halved.
FIRST, OWN_RATE, HALF = 0.25, 0.002, 100.0
#: Bytes of text that a task scores at a time, about; a longer text is taken alone.
TEXT_BYTES = 1 << 20
#: Bytes of text whose words are listed together, and what a text counts beside its own.
CHUNK_BYTES, ROW_BYTES = 10 << 20, 100
#: Letters looked up together, about, and those of a word that are compared with the word before.
LOOKED_UP, WIDE = 1 << 16, 24
#: Letters of words whose (slot, pair of bytes) counts a task adds up before it sends them on, and the bits of a pair's number.
PAIR_BYTES, PAIR_BITS = 1 << 20, 17
MOST_COUNTED = (1 << 24) - 1
#: Bits mixed at a time, about.
STEP_BITS = 1 << 15
#: The mixer's gate: how often the word so far was seen (LEVELS: from so many times on), or else how many of the last contexts are
#: known, with the bit's depth in its byte (0, 1, more).
LEVELS = [1, 2, 4, 16, 256]
GATES = 3 * (len(LEVELS) + 4)
END_BYTE, UPPER = 0xFF, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for the end of a text among words; no word holds a space.
END = " "
#: log10((c + ADDED) / (N + ADDED (V + 1))) is the base's probability of a word.
ADDED = 0.1
_M1, _M2, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x100000001B3


def code_paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each byte the (inner node, bit) decisions of the prefix code of the fewest bits; one is added to each count, so every byte has a code."""
    heap = [(int(n) + 1, i, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    children, fresh = {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[fresh] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    paths, open_ = {}, [(heap[0][2], [])]
    while open_:
        node, path = open_.pop()
        if node < 256:
            paths[node] = path
        else:
            open_ += [(child, [*path, (node - 256, bit)]) for bit, child in enumerate(children[node])]
    return [paths[i] for i in range(256)]


class Code:
    """A prefix code of bytes for each byte before them in the word (0: none), from counts (256 x 256) of such pairs.

    Pairs are numbered ``row[before]`` * 256 + byte; a pair has a ``length``, and an inner ``node`` and a ``bit`` at each depth. Bytes
    that nothing was seen after share the code of all bytes.
    """

    def __init__(self, counts: np.ndarray):
        own = np.flatnonzero(counts.sum(1))
        self.row = np.zeros(256, np.int64)
        self.row[own] = np.arange(1, len(own) + 1)
        paths = [path for c in [counts.sum(0), *counts[own]] for path in code_paths(c)]
        self.length = np.array([len(path) for path in paths], np.int64)
        self.node, self.bit = np.zeros((len(paths), self.length.max()), np.int16), np.zeros((len(paths), self.length.max()), np.int8)
        for i, path in enumerate(paths):
            self.node[i, : len(path)], self.bit[i, : len(path)] = zip(*path)

    def pairs(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The pair of each byte of words of such sizes."""
        before = np.zeros(len(letters), np.int64)
        before[1:] = letters[:-1]
        before[np.cumsum(sizes) - sizes] = 0
        return self.row[before] * 256 + letters

    def bits(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair's place, depth) of every bit of the pairs, in order."""
        n = self.length[pairs]
        at = np.repeat(np.arange(len(pairs), dtype=np.int32), n)
        return at, np.arange(len(at), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)


def near(node: np.ndarray) -> np.ndarray:
    """What a node adds (exclusive or) to its context's slot."""
    return (node * 389 + 1) & ((1 << NEAR) - 1)


def spelled(words: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, each with the space after it, and how many each has; END is the end byte alone."""
    words = pa.array(words, pa.large_string()).cast(pa.large_binary())
    raw = pc.binary_join_element_wise(words, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    raw = pc.if_else(pc.equal(words, pa.scalar(END.encode(), pa.large_binary())), pa.scalar(bytes([END_BYTE]), pa.large_binary()), raw)
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    return np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(raw) else np.zeros(0, np.uint8), np.diff(ends)


def hashes(letters: np.ndarray, sizes: np.ndarray, leader: np.ndarray) -> Iterator[np.ndarray]:
    """For each of CONTEXTS, one after the other, the 64-bit hash of what a byte's predictor sees before it in its word; ``leader`` is one number a word."""
    n = len(letters)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(n) - start
    seen, window = [], np.zeros(n, np.uint64)
    used = {k for k, _ in CONTEXTS}
    for k in range(1, max(used) + 1):
        back = np.zeros(n, np.uint64)
        back[k:] = letters[:-k]
        back[place < k] = 0
        window |= back << np.uint64(8 * (k - 1))
        seen.append(window.copy() if k in used else None)
    # The word so far as a polynomial: differences of running sums, taken back to the word's start by the inverse power.
    powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _P, np.uint64)], dtype=np.uint64)
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_P, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)]
    seen.append((sums[:n] - sums[start]) * inverse[start])
    led = np.repeat(leader.astype(np.uint64) + np.uint64(1), sizes) * _M2
    for i, (k, with_leader) in enumerate(CONTEXTS):
        h = (seen[k - 1] + np.uint64(i + 1) + (led if with_leader else np.uint64(0))) * _M1
        h ^= h >> np.uint64(29)
        yield h * _M2


def parts_of(sizes: np.ndarray) -> Iterator[slice]:
    """Words of such sizes in runs of about LOOKED_UP bytes: what stays in a processor's cache while it is looked up."""
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // LOOKED_UP)) + 1, len(sizes)]
    yield from (slice(x, y) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if x < y)


def shared(letters: np.ndarray, sizes: np.ndarray, leader: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the letters that are no part of a beginning shared with the word before, for each letter which of these it equals).

    All that a predictor sees of a letter are the leader and the word's letters up to it. Beginnings are compared up to WIDE letters.
    """
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    near_ = np.flatnonzero(place < WIDE)
    cell = word[near_] * WIDE + place[near_]
    grid = np.zeros((len(sizes), WIDE), np.uint8)
    grid.ravel()[cell] = letters[near_]
    same = np.zeros(grid.shape, bool)
    same[1:] = (grid[1:] == grid[:-1]) & (grid[1:] != 0) & (leader[1:] == leader[:-1])[:, None]
    same = np.logical_and.accumulate(same, axis=1)
    new = np.ones(len(letters), bool)
    new[near_] = ~same.ravel()[cell]
    number = np.cumsum(new, dtype=np.int32) - np.int32(1)
    last = np.zeros(grid.shape, np.int32)
    last.ravel()[cell] = np.where(new[near_], number[near_], 0)
    number[near_] = np.maximum.accumulate(last, axis=0).ravel()[cell]
    return np.flatnonzero(new), number


class Model:
    """What a scorer holds: the code, a table of logits per context, levels of the last one, leaders and first weights (gates x 8)."""

    def __init__(self, code: Code, tables: list[np.ndarray], sure: np.ndarray, leaders: list[str], weights: np.ndarray | None = None):
        self.code, self.tables, self.sure, self.leaders = code, tables, sure, leaders
        if weights is None:
            weights = np.full((GATES, 8), FIRST / SCALE, np.float32)
            weights[:, 7] = 0
        self.weights = weights

    def looked_up(self, letters: np.ndarray, sizes: np.ndarray, leader: np.ndarray, fresh: np.ndarray, coded: np.ndarray, left_out: bool = False) -> np.ndarray:
        """Rows of inputs as 64 bits, one for each bit of the letters that are ``fresh``, with pairs ``coded``.

        A row's bytes are the logits, at most seven, and 2 x gate + the bit itself. ``left_out``: the model's tables and levels are
        those without the bit itself, for a slot and the bit at 2 x slot + bit.
        """
        at, depth = self.code.bits(coded)
        cell = coded.astype(np.int32).take(at) * np.int32(self.code.node.shape[1]) + depth
        apart, bit = near(self.code.node.astype(np.int32)).take(cell), self.code.bit.take(cell)
        rows, known = np.zeros((len(at), 8), np.int8), np.zeros(len(at), np.int8)
        for i, (h, table) in enumerate(zip(hashes(letters, sizes, leader), self.tables)):
            power = len(table).bit_length() - 1 - left_out
            slot = (h[fresh] >> np.uint64(64 - power)).astype(np.int32).take(at)
            slot ^= apart
            if left_out:
                slot = 2 * slot + bit
            logit = table.take(slot)
            rows[:, i] = logit
            if i < 3:
                known += logit != 0
            if i == SURE:
                level = self.sure.take(slot)
        gate = np.where(level, level + np.int8(3), known)
        rows[:, 7] = 2 * (3 * gate + np.minimum(depth, 2).astype(np.int8)) + bit
        return rows.view(np.uint64).ravel()

    def inputs(self, words: pa.Array, leader: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of inputs as ``looked_up`` gives them, first row of each word, rows of each word) of words under leaders.

        Letters that a word has in common with the one before it are looked up once; sorted words share the most.
        """
        letters, sizes = spelled(words)
        coded = self.code.pairs(letters, sizes)
        stop, ends = np.cumsum(sizes), np.r_[0, np.cumsum(self.code.length[coded])]
        first = ends[stop - sizes]
        rows = np.empty(ends[-1], np.uint64)
        for w in parts_of(sizes):
            part = slice(stop[w.start] - sizes[w.start], stop[w.stop - 1])
            fresh, same = shared(letters[part], sizes[w], leader[w])
            found = self.looked_up(letters[part], sizes[w], leader[w], fresh, coded[part][fresh])
            n = self.code.length[coded[part]]
            own = n[fresh]
            at = np.repeat(((np.cumsum(own) - own)[same] - (np.cumsum(n) - n)).astype(np.int32), n)
            at += np.arange(len(at), dtype=np.int32)
            rows[ends[part.start] : ends[part.stop]] = found.take(at)
        return rows, first, ends[stop] - first

    def step(self, rows: np.ndarray, lane: np.ndarray, weights: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Mix a block of rows, then learn from it: (lane of each bit, its log-probability), in some order.

        ``weights`` (lanes x gates, 8) are changed in place; within a lane's block each set of weights moves once, by the sum of
        its bits' gradients, damped where these are many.
        """
        gate = rows.view(np.uint8).reshape(-1, 8)[:, 7] >> 1
        order = np.argsort(gate, kind="stable")
        rows, lane = rows.take(order), lane.take(order)
        tag = rows.view(np.uint8).reshape(-1, 8)[:, 7]
        key = lane * np.int32(GATES) + gate.take(order)
        starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        sets, n = key[starts], np.diff(np.r_[starts, len(key)])
        x = rows.view(np.int8).reshape(-1, 8).astype(np.float32)
        x[:, 7] = SCALE
        sign = (tag & 1).astype(np.float32) * 2 - 1
        odds = (x * np.repeat(weights[sets], n, axis=0)) @ np.ones(8, np.float32)
        odds *= -sign
        np.exp(np.clip(odds, -15, 20, out=odds), out=odds)
        whole = 1 + odds
        odds /= whole
        x *= (odds * sign)[:, None]
        weights[sets] += (rate / SCALE / (1 + n / HALF))[:, None].astype(np.float32) * np.add.reduceat(x, starts, axis=0) / np.float32(SCALE)
        return lane, -np.log(whole)

    def score(self, rows: np.ndarray, first: np.ndarray, sizes: np.ndarray, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural logarithm of each text's probability. ``words`` are the texts' word numbers one after the other, ``ends`` where each text ends.

        All texts go on side by side, block by block, each with weights of its own; blocks grow from 256 to 8192 bits.
        """
        n = sizes[words]
        stream = np.repeat((first[words] - (np.cumsum(n) - n)).astype(np.int32), n)
        stream += np.arange(len(stream), dtype=np.int32)
        stop = np.r_[0, np.cumsum(n)][ends]
        start = np.r_[0, stop[:-1]] if len(stop) else stop
        bits, out = stop - start, np.zeros(len(stop))
        weights = np.tile(self.weights, (len(stop), 1))
        done, block = 0, 256
        while (live := np.flatnonzero(bits > done)).size:
            take = np.minimum(bits[live] - done, block)
            for part in np.split(np.arange(len(live)), np.flatnonzero(np.diff(np.cumsum(take) // STEP_BITS)) + 1):  # what stays in a processor's cache
                n, own = take[part], live[part].astype(np.int32)
                at = np.repeat((start[own] + done - (np.cumsum(n) - n)).astype(np.int32), n)
                at += np.arange(len(at), dtype=np.int32)
                lane, cost = self.step(rows.take(stream.take(at)), np.repeat(own, n), weights, OWN_RATE)
                out[own] += np.bincount(lane - own[0], cost, own[-1] - own[0] + 1)[own - own[0]]
            done, block = done + block, min(8192, block if done == 0 else 2 * block)
        return out


def cut(texts: pa.Array, ordered: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word numbers of all texts one after the other, where each text ends); END closes each text.

    Words are lower-cased (A-Z) and cut at ASCII white space; a null text has none but its end.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    rows, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    whole = pc.not_equal(flat, "")
    coded = flat.filter(whole).dictionary_encode()
    spelled_, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    if ordered:  # words with one beginning together, as their predictors' slots are
        order = pc.sort_indices(spelled_)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        spelled_, number = spelled_.take(order), place[number]
    n = np.bincount(rows.filter(whole).to_numpy(zero_copy_only=False), minlength=len(texts))
    words, ends = pa.concat_arrays([spelled_, pa.array([END], spelled_.type)]), np.cumsum(n + 1)
    numbers = np.full(int(ends[-1]) if len(ends) else 0, len(words) - 1, np.int64)
    inner = np.ones(len(numbers), bool)
    inner[ends - 1] = False
    numbers[inner] = number
    return words, numbers, ends


def led(words: pa.Array, numbers: np.ndarray, ends: np.ndarray, leaders: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, their leaders, numbers in these of all words of the texts): what ``cut`` gives, told apart by leader.

    A word's leader is the one of ``leaders`` that its text has most often before it, of equally frequent ones the first
    listed, as a number from 1; 0 before there is any.
    """
    kind = pc.fill_null(pc.index_in(words, pa.array(leaders, words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    at = np.flatnonzero(kind[numbers] >= 0)
    seen = np.zeros((len(at) + 1, max(1, len(leaders))), np.int32)
    seen[np.arange(1, len(at) + 1), kind[numbers[at]]] = 1
    seen = np.cumsum(seen, axis=0, dtype=np.int32)
    before = np.searchsorted(text[at], text[at], "left")  # how many stand in texts before the own one
    lead = np.r_[0, (seen[1:] - seen[before]).argmax(1) + 1]
    last = np.cumsum(np.r_[0, kind[numbers[:-1]] >= 0]) if len(numbers) else numbers
    own = (last > 0) & (np.r_[-1, text[at]][last] == text) if len(numbers) else np.zeros(0, bool)
    key = np.where(own, lead[last], 0) * len(words) + numbers
    met = np.zeros((len(leaders) + 1) * len(words), bool)
    met[key] = True
    leader, word = np.divmod(np.flatnonzero(met), len(words))
    return words.take(pa.array(word)), leader, (np.cumsum(met) - 1)[key]


def tokenised(docs: DataFrame) -> DataFrame:
    """Chunks of about CHUNK_BYTES of the texts of ``docs`` (doc_id, text, held_out), cut into words once, in the shared folder.

    Of each chunk: its ``words``, the most frequent first, how often each is in its texts that aren't held out, and of each of its
    texts the id, whether it is held out and how many words it has; ``ids`` are the numbers of all these words one after the other.
    """

    def chunk(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        words, numbers, ends = cut(pa.concat_arrays(rows.column("text").chunks), ordered=True)
        tokens = np.diff(np.r_[0, ends])
        order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        numbers = rank[numbers]
        counted = np.repeat(~rows.column("held_out").to_numpy(), tokens)
        lists = [*[rows.column(c).chunk(0) for c in ("doc_id", "held_out")], pa.array(tokens, pa.int32()), words.take(pa.array(order)), pa.array(np.bincount(numbers[counted], minlength=len(words)))]
        planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # bytes of one weight together: most are small
        arrays = [pa.array([number], pa.int64()), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]]
        return pa.record_batch([*arrays, pa.array([pa.compress(planes, "zstd", asbytes=True)], pa.binary())], ["chunk", "doc_id", "held_out", "tokens", "words", "counted", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = partition_id() << 32, [], 0
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                held.append(part)
                size += (pc.sum(pc.binary_length(part.column("text"))).as_py() or 0) + ROW_BYTES * part.num_rows
                if size > CHUNK_BYTES:
                    yield chunk(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield chunk(number, held)

    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").cast("string").alias("text"), column(docs, "held_out").alias("held_out"))
    kinds = "chunk long, doc_id array<long>, held_out array<boolean>, tokens array<int>, words array<string>, counted array<long>, ids binary"
    return materialise(rows.mapInArrow(run, kinds), "texts")


def unpacked(chunk: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A row of ``tokenised`` as ``cut`` gives it, and which texts are held out."""
    tokens, words, held = (chunk.column(c)[0].values for c in ("tokens", "words", "held_out"))
    ends = np.cumsum(tokens.to_numpy(), dtype=np.int64)
    planes = np.frombuffer(pa.decompress(chunk.column("ids")[0].as_buffer(), 4 * int(ends[-1]), "zstd"), np.uint8)
    return words, planes.reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64), ends, held.to_numpy(zero_copy_only=False)


def listed(texts: DataFrame) -> DataFrame:
    """(token, chunk, id, n, first): every word of every chunk with its number there and how often all texts that aren't held out have it; ``first`` holds of one row of each word."""
    words = texts.select("chunk", F.posexplode(F.arrays_zip("words", "counted")).alias("id", "word")).select("chunk", "id", F.col("word.words").alias("token"), F.col("word.counted").alias("own"))
    own = Window.partitionBy("token")
    rows = words.select("token", "chunk", "id", F.sum("own").over(own).alias("n"), (F.row_number().over(own.orderBy("chunk")) == 1).alias("first"))
    return materialise(rows, "words")


def count_words(texts: DataFrame, leaders: list[str]) -> DataFrame:
    """(leader, token, counted): how often each word is in all ``texts`` (``tokenised``) that aren't held out, under each leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, numbers, ends, held = unpacked(batch.slice(i, 1))
                own = np.repeat(~held, np.diff(np.r_[0, ends]))
                words, leader, numbers = led(words, numbers, ends, leaders)
                n = np.bincount(numbers[own], minlength=len(words))
                seen = np.flatnonzero(n)
                yield pa.record_batch([pa.array(leader[seen].astype(np.int32)), words.take(pa.array(seen)), pa.array(n[seen])], ["leader", "token", "counted"])

    seen = texts.select("held_out", "tokens", "words", "ids").mapInArrow(run, "leader int, token string, counted long")
    counts = seen.groupBy("leader", "token").agg(F.sum("counted").alias("counted"))
    return materialise(counts.sortWithinPartitions("leader", "token"), "words")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Rows of ``count_words`` as (words, leaders, counts), about PAIR_BYTES of words at a time."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "token", PAIR_BYTES):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("token"))).as_py() or 0
            if size > PAIR_BYTES:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(held)
    return pa.concat_arrays(table.column("token").chunks), table.column("leader").to_numpy().astype(np.int64), table.column("counted").to_numpy()


def code_of(counts: DataFrame) -> tuple[Code, int]:
    """The code of the counted words' bytes after one another, and how many bytes the distinct words have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            letters, sizes = spelled(batch.column("token"))
            before = np.r_[np.uint8(0), letters[:-1]].astype(np.int64)
            before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
            total += np.bincount(before << 8 | letters, np.repeat(batch.column("counted").to_numpy(), sizes), 1 << 16).astype(np.int64)
            distinct += len(letters)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array([*seen.tolist(), -1]), pa.array([*total[seen].tolist(), distinct])], ["pair", "n"])

    sums = dict(counts.select("token", "counted").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect())
    pairs = np.zeros(1 << 16, np.int64)
    for pair, n in sums.items():
        if pair >= 0:
            pairs[pair] = n
    return Code(pairs.reshape(256, 256)), sums.get(-1, 0)


def tables_of(counts: DataFrame, code: Code, powers: list[int]) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """(the predictors' logits from all counted words, 2 ** powers[i] bytes for context i, the last one's levels), and both without one zero or one one (at 2 x slot + bit), on the driver.

    Each task adds up equal (slot, byte) pairs of its words and sends them, sorted and packed, to their range of slots, where
    their bits are counted.
    """

    def packed(words: pa.Array, leader: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        letters, sizes = spelled(words)
        fresh, same = shared(letters, sizes, leader)
        n = np.bincount(same, n.repeat(sizes), len(fresh)).astype(np.int64)
        times = n // MOST_COUNTED + 1  # a count that needs more bits is given in several entries
        at = np.repeat(np.arange(len(n)), times)
        part = np.full(len(at), MOST_COUNTED, np.uint64)
        part[np.cumsum(times) - 1] = n % MOST_COUNTED
        coded, fresh = code.pairs(letters, sizes)[fresh[at]].astype(np.uint64), fresh[at]
        for i, h in enumerate(hashes(letters, sizes, leader)):
            # Slot and pair of bytes in one number, then the count where it is small: sorted, equal ones stand together.
            both = np.sort((h[fresh] >> np.uint64(64 - powers[i]) << np.uint64(PAIR_BITS + 24)) | coded << np.uint64(24) | part)
            pair = both >> np.uint64(24)
            starts = np.r_[0, np.flatnonzero(pair[1:] != pair[:-1]) + 1]
            keys, times = pair[starts].astype(np.int64), np.add.reduceat(both & np.uint64(0xFFFFFF), starts).astype(np.int64)
            cuts = np.searchsorted(keys, np.arange((1 << RANGES) + 1) << powers[i] - RANGES + PAIR_BITS)
            parts = [p for p in range(1 << RANGES) if cuts[p] < cuts[p + 1]]
            lists = [[pa.compress(f(cuts[p], cuts[p + 1]).tobytes(), "zstd", asbytes=True) for p in parts] for f in (lambda x, y: np.diff(keys[x:y], prepend=0), lambda x, y: times[x:y])]
            yield pa.record_batch(
                [pa.array([i] * len(parts), pa.int32()), pa.array(parts, pa.int32()), pa.array((np.diff(cuts)[parts]).astype(np.int64)), *[pa.array(x, pa.binary()) for x in lists]], ["context", "part", "size", "keys", "times"]
            )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in gathered(batches):
            yield from packed(*words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                i, size = r["context"], 1 << powers[r["context"]] - RANGES
                key = np.cumsum(np.frombuffer(pa.decompress(r["keys"], 8 * r["size"], "zstd", asbytes=True), np.int64))
                n, coded = np.frombuffer(pa.decompress(r["times"], 8 * r["size"], "zstd", asbytes=True), np.int64), key & (1 << PAIR_BITS) - 1
                at, depth = code.bits(coded)
                slot = (key >> PAIR_BITS)[at] ^ near(code.node[coded[at], depth].astype(np.int64))
                total = sums.setdefault((i, r["part"]), np.zeros(2 * size))
                total += np.bincount((slot - r["part"] * size) * 2 + code.bit[coded[at], depth], n[at], 2 * size)
        for (i, r), total in sums.items():
            zero, one = total[::2], total[1::2]
            less = np.stack([logits(np.maximum(zero - 1, 0), one), logits(zero, np.maximum(one - 1, 0))], 1)
            levels = [level(zero + one).tobytes(), np.repeat(level(zero + one - 1), 2).tobytes()] if i == SURE else [None, None]
            found = [logits(zero, one).tobytes(), less.tobytes(), *levels]
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([r], pa.int32()), *[pa.array([x], pa.binary()) for x in found]], ["context", "part", "logits", "less", "levels", "levels_less"])

    def logits(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.rint(SCALE * np.log((one + 0.4) / (zero + 0.4))).clip(-127, 127).astype(np.int8)

    def level(n: np.ndarray) -> np.ndarray:
        return np.searchsorted(LEVELS, n, "right").astype(np.int8)

    kinds = "context int, part int, size long, keys binary, times binary"
    dealt = counts.mapInArrow(pairs, kinds).repartition("context", "part")
    out, sure = [[np.zeros(k << p, np.int8) for p in powers] for k in (1, 2)], [np.zeros(k << powers[SURE], np.int8) for k in (1, 2)]
    for r in dealt.mapInArrow(count, "context int, part int, logits binary, less binary, levels binary, levels_less binary").toLocalIterator():
        size = 1 << powers[r[0]] - RANGES
        for k, tables, levels in zip((1, 2), out, sure):
            own = slice(r[1] * k * size, (r[1] + 1) * k * size)
            tables[r[0]][own] = np.frombuffer(r[1 + k], np.int8)
            if r[0] == SURE:
                levels[own] = np.frombuffer(r[3 + k], np.int8)
    return [(tables, levels) for tables, levels in zip(out, sure)]


def first_weights(counts: DataFrame, model: Model) -> np.ndarray:
    """The first weights: one Newton step of logistic regression over every occurrence of every counted word, from FIRST, which they are drawn to as normal ones of that spread.

    ``model`` has the tables without the bit itself: each occurrence is weighed as one that the predictors haven't seen. What an
    occurrence's bits are worth depends on the word alone, so words are gone through once, times their counts; sums of slopes and
    curvatures, 72 numbers a gate, are all that tasks send on.
    """
    shared_model = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared_model.value, np.zeros((GATES, 9, 8))
        for words, leaders, counted in gathered(batches):
            all_letters, all_sizes = spelled(words)
            stop = np.cumsum(all_sizes)
            for w in parts_of(all_sizes):
                letters, sizes, leader = all_letters[stop[w.start] - all_sizes[w.start] : stop[w.stop - 1]], all_sizes[w], leaders[w]
                fresh, same = shared(letters, sizes, leader)
                coded = own.code.pairs(letters, sizes)[fresh]
                n = np.bincount(same, counted[w].repeat(sizes), len(fresh)).repeat(own.code.length[coded])
                rows = own.looked_up(letters, sizes, leader, fresh, coded, left_out=True)
                gate = rows.view(np.uint8).reshape(-1, 8)[:, 7] >> 1
                order = np.argsort(gate, kind="stable")
                rows, n, starts = rows.take(order).view(np.int8).reshape(-1, 8), n.take(order), np.r_[0, np.cumsum(np.bincount(gate, minlength=GATES))]
                bit, x = rows[:, 7] & 1, rows.astype(np.float32)
                x[:, 7] = SCALE
                for g in np.flatnonzero(np.diff(starts)):
                    at = slice(starts[g], starts[g + 1])
                    p = 1 / (1 + np.exp(-np.clip(x[at] @ own.weights[g], -30, 30)))
                    total[g, 0] += (n[at] * (bit[at] - p)).astype(np.float32) @ x[at]
                    total[g, 1:] += x[at].T @ (x[at] * (n[at] * p * (1 - p)).astype(np.float32)[:, None])
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at])], ["at", "x"])

    sums = np.zeros(GATES * 72)
    for at, x in counts.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x")).collect():
        sums[at] = x
    sums = sums.reshape(GATES, 9, 8)
    return (model.weights + np.stack([np.linalg.solve(h + np.eye(8) * (SCALE / FIRST) ** 2, s) for s, h in zip(sums[:, 0], sums[:, 1:])])).astype(np.float32)


def learned(texts: DataFrame, words: DataFrame) -> tuple[DataFrame, Model]:
    """(word counts, the model learned) from all ``texts`` (``tokenised``) that aren't held out, whose ``words`` are ``listed``.

    The leaders are their most frequent words.
    """
    tokens = words.where("first AND n > 0").select("token", "n")
    leaders = [r[0] for r in tokens.where(F.col("token") != END).orderBy(F.desc("n"), "token").limit(LEADERS).collect()]
    counts = count_words(texts, leaders)
    code, size = code_of(counts)
    power = max(FEWEST, min(MOST, (2 * size).bit_length()))
    whole, less = tables_of(counts, code, [min(power, 16 + 2 * k) if k else power for k, _ in CONTEXTS])
    return tokens, Model(code, *whole, leaders, first_weights(counts, Model(code, *less, leaders)))


def train(docs: DataFrame) -> tuple[DataFrame, Model]:
    """(word counts of all ``docs`` (doc_id, text), the model learned from them)."""
    texts = tokenised(docs.select("doc_id", "text", F.lit(False).alias("held_out")))
    return learned(texts, listed(texts))


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) for every row of ``docs`` (doc_id, text, held_out).

    ``counts`` (token, n) and ``model`` are what ``train`` gives. Scores are log10. A null text is an empty one; repeated rows are
    scored each.
    """
    texts = tokenised(docs)
    return scored(texts, listed(texts).select("token", "chunk", "id").join(counts, "token", "left"), counts, model)


def scored(texts: DataFrame, known: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """``score`` of ``texts`` (``tokenised``), with the count in training texts ``known`` (chunk, id, n) of each word of each chunk."""
    shared_model = texts.sparkSession.sparkContext.broadcast(model)
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = sums[0] or 0, sums[1]
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"

    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        own, row = shared_model.value, chunk.combine_chunks().to_batches()[0]
        words, numbers, ends, _ = unpacked(row)
        n = np.zeros(len(words), np.int64)
        n[known.column("id").to_numpy()] = known.column("n").to_numpy()
        starts = np.r_[0, ends[:-1]]
        logs = np.log10((n + ADDED) / (total + ADDED * (distinct + 1)))
        of_word = [n > 0, logs, spelled(words)[1]]
        n_known, base, n_bytes = (np.add.reduceat(x[numbers].astype(float if x is logs else np.int64), starts) for x in of_word)
        order = pc.sort_indices(words).to_numpy()  # words with one beginning together, as their predictors' slots are
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        under, leader, places = led(words.take(pa.array(order)), place[numbers], ends, own.leaders)
        rows, first, sizes = own.inputs(under, leader)
        cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n_bytes + ROW_BYTES) // TEXT_BYTES)) + 1, len(ends)]
        found = [own.score(rows, first, sizes, places[starts[x] : ends[y - 1]], ends[x:y] - starts[x]) for x, y in zip(cuts[:-1], cuts[1:]) if x < y]
        columns = [*[row.column(c)[0].values for c in ("doc_id", "held_out", "tokens")], n_known, np.full(len(ends), total), base, np.concatenate(found) / np.log(10), n_bytes]
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        names, types = zip(*(c.split() for c in result.split(", ")))
        return pa.table([pa.array(x).cast(kinds[t]) for x, t in zip(columns, types)], names)

    counted = known.select(F.col("chunk").alias("of"), "id", F.coalesce("n", F.lit(0)).alias("n"))
    return texts.drop("counted").groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(run, result)


def score_documents(docs: DataFrame) -> DataFrame:
    """``score`` of all ``docs`` (doc_id, text) by a model trained on those whose crc32(doc_id) leaves no 0 modulo 10.

    Rows without an id are trained on. Empty table: empty result; other columns may have any names.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").cast("string").alias("text")).withColumn("held_out", held)
    texts = tokenised(rows)
    words = listed(texts)
    counts, model = learned(texts, words)
    return scored(texts, words, counts, model)
