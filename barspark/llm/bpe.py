"""Byte-level BPE by tree reduction.

A text is cut by the pattern; each match ("piece") is encoded on its own. A
piece of up to ``LEAF`` bytes is merged directly by rank (new pieces of a chunk of
texts all at once, one merge of each a step). A longer one is halved
recursively; two encoded neighbours are joined by re-encoding a window of tokens
around the boundary, which grows until the tokens next to it provably stay.

Why they stay: a token sequence is the encoding of its bytes exactly when every
two adjacent tokens are the encoding of their own concatenation. Inside both
halves and inside the re-encoded window this holds already, so only the two
seams of the window need a look; if one fails, that side of the window grows.
With the pieces' order kept, encoding is a homomorphism on pieces and decoding
one on tokens, so both are folds over a tree of concatenations.

Defined results: null and empty texts have no tokens; repeated rows and extra
columns do not matter; very long texts and pieces cost n log n; empty tables
give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship

LEAF = 24
#: Distinct pieces (of up to ``MEMO_CHARS`` characters) a task remembers, twice.
MEMO, MEMO_CHARS = 60_000, 64
#: Characters of the texts that are cut into pieces and encoded together.
CHUNK_CHARS = 1 << 18


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # in the pattern's original dialect \s is the White_Space property
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")
                                  .replace(r"\s", r"\p{White_Space}"), regex.V0).findall
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.byte_ids = [ranks[bytes([x])] for x in range(256)]
        #: left id << 32 | right id -> id of their concatenation, for every token and cut
        self.pairs = {a << 32 | b: r for t, r in ranks.items() for i in range(1, len(t))
                      if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self._keys, self._ids = keys[order], np.fromiter(self.pairs.values(), np.int64, len(keys))[order]
        self._first = self._lookup(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._stable: dict[int, bool] = {}

    @classmethod
    def parse(cls, vocabulary: bytes, pattern: str) -> "Codec":
        pairs = (line.split() for line in vocabulary.splitlines() if line)
        return cls({base64.b64decode(t): int(r) for t, r in pairs}, pattern)

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data)

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def leaf(self, data: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, leftmost first, until none is a token."""
        if len(data) > 4 * LEAF:
            return self.leaf_by_heap(data)
        get = self.pairs.get
        part = [self.byte_ids[x] for x in data]
        rank = [get(a << 32 | b, _NONE) for a, b in zip(part, part[1:])]
        while rank:
            low = min(rank)
            if low == _NONE:
                break
            i = rank.index(low)
            part[i] = low
            del part[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(low << 32 | part[i + 1], _NONE)
            if i:
                rank[i - 1] = get(part[i - 1] << 32 | low, _NONE)
        return part

    def leaf_by_heap(self, data: bytes) -> list[int]:
        """The same merges for long windows: a heap of (rank, position), stale entries skipped."""
        get, n = self.pairs.get, len(data)
        part = [self.byte_ids[x] for x in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(part[i] << 32 | part[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or get(part[i] << 32 | part[j], _NONE) != r:
                continue
            part[i], part[j] = r, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get(r << 32 | part[k], _NONE)) != _NONE:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := get(part[h] << 32 | r, _NONE)) != _NONE:
                heapq.heappush(heap, (x, h))
        return [p for p in part if p is not None]

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their concatenation."""
        ok = self._stable.get(a << 32 | b)
        if ok is None:
            if len(self._stable) >= MEMO:
                self._stable.clear()
            ok = self._stable[a << 32 | b] = self.leaf(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j, grow = len(left), 0, 1
        while True:
            i, j = max(0, i - grow), min(len(right), j + grow)
            grow *= 2
            window = left[i:] + right[:j]
            middle = self.leaf(b"".join(map(self.tokens.__getitem__, window)))
            fits_left = i == 0 or self.stable(left[i - 1], middle[0])
            fits_right = j == len(right) or self.stable(middle[-1], right[j])
            if fits_left and fits_right:
                return left[:i] + middle + right[j:]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the concatenations, ``_NONE`` where they are no token."""
        key = (np.asarray(left, np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ids[at], _NONE)

    def leaves(self, pieces: list[bytes]) -> list[bytes]:
        """``leaf`` of many short pieces, packed: step by step, the least pair of every piece."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(n.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = np.array(self.byte_ids, np.int64)[raw]
        column = np.arange(width)
        alive = column < n[:, None]
        rank = np.full((len(pieces), width), _NONE)
        if width > 1:
            rank[:, :-1] = np.where(alive[:, 1:], self._first[raw[:, :-1], raw[:, 1:]], _NONE)
        after = np.broadcast_to(column + 1, rank.shape).copy()
        before = np.broadcast_to(column - 1, rank.shape).copy()
        rows = np.arange(len(pieces))
        while len(rows):
            i = rank[rows].argmin(axis=1)
            low = rank[rows, i]
            some = low != _NONE
            rows, i, low = rows[some], i[some], low[some]
            if not len(rows):
                break
            j = after[rows, i]
            ids[rows, i], alive[rows, j], rank[rows, j] = low, False, _NONE
            k = after[rows, i] = after[rows, j]
            more = k < n[rows]
            before[rows[more], k[more]] = i[more]
            rank[rows, i] = _NONE
            rank[rows[more], i[more]] = self._lookup(low[more], ids[rows[more], k[more]])
            h = before[rows, i]
            more = h >= 0
            rank[rows[more], h[more]] = self._lookup(ids[rows[more], h[more]], low[more])
        flat = ids[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def forget(self) -> None:
        self.memo, self.old, self._stable = {}, {}, {}

    def learn(self, pieces: set[str]) -> None:
        """Put the packed ids of ``pieces`` into the memo."""
        short: list[tuple[str, bytes]] = []
        for p in pieces:
            ids = self.old.get(p)
            if ids is None:
                data = p.encode("utf-8", "surrogatepass")
                if len(data) <= LEAF and data not in self.ranks:
                    short.append((p, data))
                    continue
                found = self.piece(data)
                ids = struct.pack(f"<{len(found)}I", *found)
            self.memo[p] = ids
        short.sort(key=lambda x: len(x[1]))
        for k in range(0, len(short), 4096):
            part = short[k:k + 4096]
            self.memo.update(zip((p for p, _ in part), self.leaves([d for _, d in part]), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        cut = [self.find(t) for t in texts]
        new: set[str] = set()
        for pieces in cut:
            new.update(pieces)
        new.difference_update(self.memo)
        self.learn(new)
        out = [b"".join(map(self.memo.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > MEMO_CHARS:
                del self.memo[p]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text or ""])[0]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens; longer lists are halved and the halves concatenated."""
        if len(ids) <= 1 << 16:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_NONE = 1 << 40


#: The last vocabulary of a worker. What its tasks remember is freed when they end.
_CODECS: dict[tuple, Codec] = {}


def _codec(vocabulary: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(vocabulary).digest(), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec.parse(vocabulary, pattern)
    return _CODECS[key]


def _chunks(texts: pa.Array):
    """(first row, texts) of runs of about ``CHUNK_CHARS`` characters, null as empty; one output batch each."""
    group, size, first = [], 0, 0
    for k, t in enumerate(texts):
        group.append(t.as_py() or "")
        size += len(group[-1])
        if size >= CHUNK_CHARS:
            yield first, group
            group, size, first = [], 0, k + 1
    if group:
        yield first, group


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, intact (and token_ids if ``tokens``).

    The rank file (under 1 MB) is read once and sent to the workers.
    """
    ship(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "intact"] + ["token_ids"] * tokens
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, intact boolean" + ", token_ids array<int>" * tokens

    def run(batches):
        codec = _codec(vocabulary.value, pattern)
        for b in batches:
            for at, texts in _chunks(b.column(1)):
                n, ids_sha, bytes_sha, intact, lists = [], [], [], [], []
                for text, packed in zip(texts, codec.encode_all(texts), strict=True):
                    ids = np.frombuffer(packed, "<u4")
                    back = codec.decode(ids.tolist())
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    bytes_sha.append(hashlib.sha256(back).hexdigest())
                    intact.append(back == text.encode("utf-8", "surrogatepass"))
                    if tokens:
                        lists.append(ids)
                cols = [b.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string()), pa.array(intact, pa.bool_())]
                if tokens:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    flat = np.concatenate([np.empty(0, np.uint32), *lists]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names=names)
        codec.forget()
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
