"""Operator 9: hierarchical multi-length packing of tokenised documents.

Every document becomes the ids of its text, then one end id. Documents are
routed by length: whole windows of the largest size are cut off first, and what
is left goes to the smallest of ``TIERS`` that holds it. Each tier opens a
window with its longest document. The gap is filled with the longest waiting
documents that fit, of this or a shorter tier. What still remains is filled by
cutting the shortest waiting document, whose rest waits again. So every window is full but the last of
a partition, and a window's size is a power of two. Windows of one tier form
step groups of equal token counts (``STEP_TOKENS``).

A partition packs its own documents as they stream by, with a bounded buffer of
waiting documents, so there is no shuffle and a lost task packs its part
again from its own rows. Sequence ids hold the partition's number.

The tokenizer drops white space and never merges across it. So the distinct
words between ASCII white space are encoded once and then kept in a bounded cache per
worker. Null or empty text: only the end id. Null ids, repeated rows and very
long texts are packed like others. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_TOKENS = 16384
#: tokens of documents that wait for a window, and words in a worker's cache
WAITING = 1 << 20
CACHE_WORDS = 1_000_000
#: words encoded in one call; an encoding takes far more memory than its ids
ENCODE_WORDS = 8192

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class _Encoder:
    """ids of texts; the ids of a word are found once per worker."""

    _open: dict[str, _Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.clear()

    @classmethod
    def at(cls, path: str) -> _Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted word hashes
        self.where = np.zeros(0, np.int64)  # number of the word
        self.first = np.zeros(1, np.int64)  # its first id
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHE_WORDS and len(self.keys):
            self.clear()
        got = []
        for k in range(0, len(texts), ENCODE_WORDS):
            got.extend(np.array(e.ids, np.uint32) for e in self.tok.encode_batch(texts[k:k + ENCODE_WORDS], add_special_tokens=False))
        n = len(self.first) - 1
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, *got])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.where = np.insert(self.where, at, n + np.arange(len(keys)))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, boundaries) of the rows."""
        starts, ends, first = T.words(buf, off)
        h = T.span_hash(buf, starts, ends)
        uniq, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == uniq[at < len(self.keys)]
        if not known.all():
            if len(self.keys) + (~known).sum() > CACHE_WORDS:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            raw = buf.tobytes()
            self._learn(uniq[new], [raw[starts[k]:ends[k]].decode("utf-8") for k in one[new]])
            at = np.searchsorted(self.keys, uniq)
        word = self.where[at][inverse] if len(uniq) else np.zeros(0, np.int64)
        size = self.first[word + 1] - self.first[word]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.first[word] - total[:-1], size) + np.arange(total[-1])] if len(word) else np.zeros(0, np.uint32)
        return ids, total[first]


class _Packer:
    def __init__(self, partition: int, tiers, step_tokens: int):
        self.tiers, self.step = tuple(tiers), step_tokens
        self.base = partition << 33
        self.seq = self.waiting_tokens = 0
        self.waiting: list[tuple] = []  # (length, order, id, ids, start, document's length), by length
        self.filled = dict.fromkeys(self.tiers, 0)
        self.order = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        top, n, start = self.tiers[-1], len(ids), 0
        while n - start >= top:
            self._close([(doc_id, ids, start, top, n)], top)
            start += top
        if start < n:
            self._wait(doc_id, ids, start, n)
        while self.waiting_tokens > WAITING:
            self._window()

    def _wait(self, doc_id, ids, start, n) -> None:
        self.order += 1
        bisect.insort(self.waiting, (n - start, self.order, doc_id, ids, start, n), key=lambda x: x[:2])
        self.waiting_tokens += n - start

    def _take(self, k: int) -> tuple:
        got = self.waiting.pop(k)
        self.waiting_tokens -= got[0]
        return got

    def _window(self) -> None:
        size, _, doc_id, ids, start, n = self._take(-1)
        tier = next(t for t in self.tiers if t >= size)
        pieces, room = [(doc_id, ids, start, size, n)], tier - size
        while room and self.waiting:
            k = bisect.bisect_right(self.waiting, room, key=lambda x: x[0]) - 1
            got, _, doc_id, ids, start, n = self._take(max(k, 0))
            use = min(got, room)
            pieces.append((doc_id, ids, start, use, n))
            room -= use
            if use < got:
                self._wait(doc_id, ids, start + use, n)
        self._close(pieces, tier)

    def _close(self, pieces, tier: int) -> None:
        """Pieces of a document that come to lie side by side are joined."""
        offset, seq = 0, self.base + self.seq
        group = self.base + (self.filled[tier] // (max(1, self.step // tier))) * len(self.tiers) + self.tiers.index(tier)
        for doc_id, ids, start, size, n in pieces:
            crc = zlib.crc32(ids[start:start + size].astype("<u4").tobytes())
            self.rows.append((doc_id, start, size, crc, n, seq, offset, tier, group))
            offset += size
        self.seq += 1
        self.filled[tier] += 1

    def flush(self) -> None:
        while self.waiting:
            self._window()

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [f.split()[0] for f in _PIECES.split(", ")]
        kinds = [pa.int32() if n == "tier" else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def pack(docs: DataFrame, tokenizer_path: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier, step_group."""
    path = tokenizer_path or default_tokenizer()
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("window sizes must be powers of two")

    def run(batches):
        encoder, packer = _Encoder.at(path), _Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for b in batches:
            ids = b.column(0).to_pylist()
            buf, off = T.flat(b.column(1))
            for i, j in T.slices(off):
                got, first = encoder.encode(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                for k in range(i, j):
                    packer.add(ids[k], np.append(got[first[k - i]:first[k - i + 1]], np.uint32(END_ID)))
                if len(packer.rows) > 10_000:
                    yield packer.batch()
        packer.flush()
        yield packer.batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _PIECES)
