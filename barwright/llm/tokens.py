"""Token ids of whole texts with a public tokenizer, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GRAPHIC, LETTER, MARK = (np.zeros(256, bool) for _ in range(3))
GRAPHIC[0x21:0x7F] = True
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[[ord(c) for c in ".,!?;:"]] = True


class PieceEncoder:
    """Ids of texts as ``tokenizers`` gives them, at a fraction of its time.

    The word splitter of byte-level BPE looks at no more than the white space ahead, so what a text encodes to is
    the same cut at a space before a visible character, at a line end between visible characters, and between a
    letter and a full stop or the like. Texts are cut there, and only pieces not seen before are encoded. Texts that
    hold the string of a special token, and with a tokenizer of another kind all texts, are encoded whole. At most about ``max_pieces`` pieces are remembered; then
    it forgets them all.
    """

    def __init__(self, path: str, max_pieces: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.splits = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec["normalizer"] is None and all(t["special"] for t in spec["added_tokens"])
        )
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.max_pieces = max_pieces
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.store, self.used = np.zeros(4096, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        ids = [array("I", x) for x in self._whole(pieces)]
        n, sizes = len(self.known), np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.frombuffer(b"".join(ids), np.uint32)
        while n + len(ids) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(flat) > len(self.store):
            self.store = np.resize(self.store, 2 * len(self.store))
        self.starts[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(ids)] = sizes
        self.store[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(pieces, range(n, n + len(ids))))

    @staticmethod
    def _cuts(buf: np.ndarray) -> np.ndarray:
        """True at each byte that starts a piece, besides the texts' first bytes."""
        cut = np.zeros(len(buf), bool)
        seen = GRAPHIC[buf]
        ahead = np.append(seen[1:] | (buf[1:] == 0xC3), False)  # the Latin letters behind 0xC3 are visible too
        cut |= (buf == 0x20) & ahead
        cut[1:] |= MARK[buf[1:]] & LETTER[buf[:-1]]
        line = np.flatnonzero(buf[1:-1] == 0x0A) + 1
        line = line[seen[line - 1] & ahead[line]]
        cut[line] = cut[line + 1] = True
        return cut

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.max_pieces:
            self._forget()
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        buf = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.empty(0, np.uint8)
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        cut = self._cuts(buf)
        bounds = at - at[0]
        cut[bounds[:-1][bounds[:-1] < len(buf)]] = True  # an empty text's start is the next one's
        starts = np.flatnonzero(cut).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(len(buf)))), pa.py_buffer(buf))
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        slots = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        sizes = self.sizes[slots]
        ends = np.append(0, np.cumsum(sizes))
        flat = self.store[np.repeat(self.starts[slots] - ends[:-1], sizes) + np.arange(ends[-1])]
        return flat, np.diff(ends[np.searchsorted(starts, bounds)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other (uint32), and the number of each text's ids; null: none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.splits:
            whole = np.zeros(len(texts), bool)
            for token in self.special:
                whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
            if not whole.any():
                return self._split(texts)
            flat, sizes = self._split(pc.if_else(pa.array(whole), "", texts))
            ids = self._whole(texts.filter(pa.array(whole)).to_pylist())
            places = np.repeat((np.cumsum(sizes) - sizes)[whole], list(map(len, ids)))
            sizes[whole] = list(map(len, ids))
            return np.insert(flat, places, np.array([i for x in ids for i in x], np.uint32)), sizes
        ids = self._whole(texts.to_pylist())
        return np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The worker's own encoder for a tokenizer file; later tasks in the same worker find its pieces."""
    return PieceEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
