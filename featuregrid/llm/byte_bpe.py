"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

A piece is merged by taking, again and again, the leftmost pair of least rank. A segment
tree over the byte positions keeps that pair at its root: a leaf holds the rank of the pair
that starts there, and each merge changes three leaves, so a piece of n bytes takes
O(n log n) steps whatever it looks like. Short pieces of a batch are merged together, their
trees in one array. Texts are first cut before every blank that a non-blank follows; no match
of the pattern crosses such a cut and none looks behind it, so the chunks are matched alone
and the ids of chunks met lately are remembered.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Chunks remembered by one task, and the longest chunk that is remembered.
CACHE_CHUNKS, CACHE_CHARS = 100_000, 64
#: Pieces merged at once.
GROUP = 8192

#: The characters that \s means in the pattern (the property White_Space).
WHITE_SPACE = "\t-\r \x85\xa0  -     　"

_NONE = 1 << 62


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. Ranks and positions share one integer, so min() is leftmost-least."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get = ranks.get
    leaves = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * leaves)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[leaves + i] = rank << 32 | i
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1)) + [n]
    before = list(range(-1, n))

    def put(i: int, value: int) -> None:
        k = leaves + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    def pair(i: int) -> int:
        """The leaf of the token at i: its rank with the live token after it."""
        j = after[i]
        if j >= n:
            return _NONE
        rank = get(piece[i : after[j]])
        return _NONE if rank is None else rank << 32 | i

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        put(j, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class PairTable:
    """Ranks of pairs of tokens, by id: every way to cut a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int64)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


def merge_pieces(pieces: list[bytes], pairs: PairTable, leaves: int) -> list[bytes]:
    """Ids of many pieces of 2 to ``leaves`` bytes (a power of two, 64 at most), as 32-bit bytes.

    One segment tree for each piece, all stored in one array; a step merges the root's pair of
    every piece that still has one, with point updates from three leaves upwards.
    """
    count = len(pieces)
    size = np.array([len(p) for p in pieces])
    padded = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(count, leaves)
    ids = np.concatenate([pairs.bytes[padded], np.zeros((count, 1), np.int64)], 1)
    places = np.arange(leaves)
    after = np.tile(np.arange(1, leaves + 2), (count, 1))
    before = np.tile(np.arange(-1, leaves), (count, 1))
    tree = np.full((count, 2 * leaves), _NONE, np.int64)
    first = pairs.rank(ids[:, :-2].ravel(), ids[:, 1:-1].ravel()).reshape(count, leaves - 1)
    real = (first >= 0) & (places[None, :-1] + 1 < size[:, None])
    tree[:, leaves : 2 * leaves - 1] = np.where(real, first << 8 | places[:-1], _NONE)
    level = leaves
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        node = at + leaves
        tree[rows, node] = values
        for _ in range(leaves.bit_length() - 1):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        rank = pairs.rank(ids[rows, i], ids[rows, np.minimum(j, leaves)])
        return np.where((rank >= 0) & (j < size[rows]), rank << 8 | i, _NONE)

    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        root = tree[live, 1]
        i = root & 255
        j = after[live, i]
        k = after[live, j]
        ids[live, i] = root >> 8
        after[live, i] = k
        before[live, np.minimum(k, leaves)] = i
        put(live, j, np.full(len(live), _NONE))
        put(live, i, pair(live, i, k))
        h = before[live, i]
        left = h >= 0
        put(live[left], h[left], pair(live[left], h[left], i[left]))
        live = live[tree[live, 1] != _NONE]
    alive = np.zeros((count, leaves + 2), bool)
    at, rows = np.zeros(count, np.int64), np.arange(count)
    while len(rows):
        alive[rows, at] = True
        at = after[rows, at]
        go = at < size[rows]
        rows, at = rows[go], at[go]
    flat = ids[:, :leaves][alive[:, :leaves]].astype("<u4").tobytes()
    ends = np.cumsum(alive[:, :leaves].sum(1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Remembered:
    """A bounded table of two generations: what was used lately survives when it is full."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def known(self, keys: set[str]) -> dict[str, bytes]:
        """What is remembered of ``keys``."""
        old, found = self.old, {k: self.young[k] for k in keys & self.young.keys()}
        for k in (keys - found.keys()) & old.keys():
            found[k] = old[k]
            self.put(k, old[k])
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class ByteBpe:
    """Encoder and decoder of one vocabulary; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        space = f"[{WHITE_SPACE}]"
        # The classes are spelled out, since \s differs between regex libraries.
        spelled = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", space)
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs = PairTable(ranks)
        self.match = regex.compile(spelled).findall
        self.odd = re.compile(f" (?:{space}|\\Z)").search
        self.cut = re.compile(f" (?=[^{WHITE_SPACE}])").split
        self.chunks = Remembered(CACHE_CHUNKS)

    def _pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces: whole tokens by look-up, the rest in groups of like size."""
        out, groups = {}, {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > 64:
                out[piece] = array("I", merge_piece(raw, self.ranks)).tobytes()
            else:
                groups.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for leaves, group in groups.items():
            for s in range(0, len(group), GROUP):
                part = group[s : s + GROUP]
                out.update(zip([p for p, _ in part], merge_pieces([r for _, r in part], self.pairs, leaves)))
        return out

    def _fresh(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that are not remembered. A blank and letters are one piece as they are."""
        cut = [[c] if c[:1] == " " and c[1:].isalpha() else self.match(c) for c in chunks]
        ids = self._pieces({p for pieces in cut for p in pieces})
        get = ids.__getitem__
        return [get(pieces[0]) if len(pieces) == 1 else b"".join(map(get, pieces)) for pieces in cut]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Later chunks are remembered without the blank before them."""
        split = [self.cut(text) if self.odd(text) else text.split(" ") for text in texts]
        firsts = [parts[0] for parts in split]
        wanted: set[str] = set()
        for parts in split:
            wanted.update(parts[1:])
        known = self.chunks.known(wanted)
        wanted.difference_update(known)
        for part, ids in zip(fresh := list(wanted), self._fresh([" " + p for p in fresh])):
            known[part] = ids
            if len(part) <= CACHE_CHARS:
                self.chunks.put(part, ids)
        get = known.__getitem__
        return [head + b"".join(map(get, parts[1:])) for head, parts in zip(self._fresh(firsts), split)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


@functools.lru_cache(maxsize=4)
def coder(ranks_path: str, pattern: str) -> ByteBpe:
    """One coder in each Python worker, with what it remembers from task to task."""
    return ByteBpe(load_ranks(ranks_path), pattern)


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids, decoded`` for each row: ids as little-endian 32-bit bytes,
    decoded as the bytes that those ids stand for.

    A null or empty text has no ids and empty decoded bytes; null ids of rows are passed on;
    equal rows give equal rows; an empty table gives no rows; texts of any length are encoded whole;
    other columns are not read and may have any names.
    """

    def make():
        import pyarrow as pa

        bpe = coder(ranks_path, pattern)

        def work(batch):
            ids = bpe.encode_all([t or "" for t in batch.column(1).to_pylist()])
            back = [bpe.decode(x) for x in ids]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[id_col, "n_tokens", "ids", "decoded"])

        return work

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df, [id_col, text_col], f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary", make, batch_bytes=1 << 20)


def decode_documents(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded`` for ids as ``encode_documents`` writes them; null ids decode to nothing."""

    def make():
        import pyarrow as pa

        bpe = coder(ranks_path, r"\s+")

        def work(batch):
            back = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=[id_col, "decoded"])

        return work

    return map_arrow(df, [id_col, ids_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, decoded binary", make)


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded bytes."""
    out = encode_documents(df, ranks_path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    return digests(table(spark, sf_dir, "documents"), default_ranks(), default_pattern())
