"""Token counts: batch encoding in Arrow functions that returns lengths only.

Texts are cut at blanks and line feeds, which are safe boundaries for a tokenizer that drops
white space and merges inside words only; whether a file is one is read from its own rules. Texts
for other files are not cut. Each task keeps the lengths of pieces it has met in two bounded
tables, of which the older one goes when the younger is full; unknown pieces go to the library in
batches of about equal bytes. No ids leave the worker, only counts.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Pieces remembered by one task in each of two tables, and the longest piece that is remembered.
CACHE_PIECES, CACHE_CHARS = 150_000, 64
#: UTF-8 bytes handed to the library at once.
BATCH_BYTES = 1 << 20
#: A text counts as over the limit with more tokens than this.
TOKEN_LIMIT = 2048


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts_at_blanks(rules: dict) -> bool:
    """Whether a tokenizer file drops white space and looks at one word at a time, so that texts may
    be cut at blanks and line feeds. What isn't known to be safe counts as unsafe."""
    listed = lambda part, name: part.get(name, []) if part and part.get("type") == "Sequence" else [part] if part else []
    normal = listed(rules.get("normalizer"), "normalizers")
    before = listed(rules.get("pre_tokenizer"), "pretokenizers")
    if not before or any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or set(" \n") & set(a["content"]) for a in rules.get("added_tokens", [])):
        return False
    # Normalizers of single characters and their marks, and runs of white space made one blank.
    safe = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
    if not all(n["type"] in safe or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in normal):
        return False
    first = before[0]
    words = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (
        # Only matches stay, and none of the pattern's alternatives takes white space.
        first["type"] == "Split" and first.get("invert") and first.get("behavior") == "Removed" and _takes_no_space(first["pattern"].get("Regex", r"\s"))
    )
    return words and all(p["type"] in ("ByteLevel", "Digits", "Punctuation", "Whitespace", "WhitespaceSplit") and not p.get("add_prefix_space") for p in before[1:])


def _takes_no_space(pattern: str) -> bool:
    """Whether each alternative is plain letters after a quote, one class of letters or digits, or a
    negated class with white space in it."""
    return all(re.fullmatch(r"'[a-z]+|\[?\\p\{[LN]\}\]?\+?|\[\^\\s(\\p\{[LN]\})*\]\+?", x) for x in pattern.split("|"))


class PieceCounter:
    """Token counts of whole texts from counts of their pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        with open(path, encoding="utf-8") as f:
            self.cut = cuts_at_blanks(json.load(f))

    def _encode(self, pieces: list[str]) -> list[int]:
        """Lengths of ``pieces``; the library sees batches balanced by UTF-8 bytes."""
        out: list[int] = []
        start = size = 0
        for i, piece in enumerate(pieces):
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= BATCH_BYTES or i + 1 == len(pieces):
                encode = self.tokenizer.encode_batch_fast
                out += [len(e.ids) for e in encode(pieces[start : i + 1], add_special_tokens=False)]
                start, size = i + 1, 0
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        if not self.cut:
            return self._encode([t or "" for t in texts])
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        fresh: set[str] = set()
        for pieces in split:
            fresh.update(pieces)
        known = {p: self.young[p] for p in fresh & self.young.keys()}
        fresh.difference_update(known)
        again = {p: self.old[p] for p in fresh & self.old.keys()}
        fresh.difference_update(again)
        new = list(fresh)
        again.update(zip(new, self._encode(new)))
        for piece, n in again.items():
            if len(piece) <= CACHE_CHARS:
                if len(self.young) >= CACHE_PIECES:
                    self.old, self.young = self.young, {}
                self.young[piece] = n
        known.update(again)
        return [sum(map(known.__getitem__, pieces)) for pieces in split]


@functools.lru_cache(maxsize=4)
def counter_of(path: str) -> PieceCounter:
    """One counter in each Python worker, with the lengths it remembers from task to task."""
    return PieceCounter(path)


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` for each row of ``df``.

    A null or empty text has 0 bytes and 0 tokens; null ids are passed on; equal rows give
    equal rows; an empty table gives no rows; texts of any length are counted whole; other columns
    are not read and may have any names. Begin, end and added special tokens are not
    counted, but special strings inside a text are one token each, as the library takes them
    by default.
    """

    def make():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = counter_of(tokenizer_path)

        def work(batch):
            counts = counter.count(batch.column(1).to_pylist())
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

        return work

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df, [id_col, text_col], f"`{id_col}` {kind}, n_bytes long, n_tokens long", make)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    out = count_tokens(table(spark, sf_dir, "documents"), default_tokenizer())
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
