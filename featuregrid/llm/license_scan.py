"""Licence scans by conditional compression.

The words around a keyword, whatever the lines they stand on, form candidate blocks that reach
beyond it on both sides by more than the longest template. Blocks are read in slices of bounded
length that overlap by as much. Each slice is compressed alone and with templates as raw
zstandard dictionaries; the bytes that a template saves, against those it could save, rank the
templates. All whose words the slice has are confirmed by their exact wording: a short notice
must occur word by word, a long one may lose few words, and none that tells licences apart.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .license_templates import KEYWORDS, TEMPLATES

#: Words of a block on either side of a keyword, in hundredths of the longest template's words. The
#: rest is for words between those of a notice, such as comment leaders of wrapped lines.
AROUND = 150
#: Characters of a word that a slice keeps; no template has one as long.
LONGEST_WORD = 64
#: Templates of up to so many words must occur word by word; longer ones may miss this share.
SHORT, MISSING = 20, 0.08

# Hyphens part words, since a line may be wrapped behind one.
_WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")
_KEYWORD = re.compile("|".join(map(re.escape, KEYWORDS)))
_TELLING = re.compile(r"\d|^(?:mit|apache|bsd|isc|gnu|lesser|affero|mozilla|neither|cc|sa|nc|nd)$")


def _lower(text: str) -> str:
    """Lower case of the same length; the few letters that change theirs stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return _WORD.findall(_lower(text))


class Scanner:
    """All templates, each with a compressor that knows it."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)):
        import zstandard

        def squeezer(raw: bytes | None = None):
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if raw else None
            return zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.plain = squeezer()
        self.templates = []
        for name, wording in templates:
            words = words_of(wording)
            raw = " ".join(words).encode()
            informed = squeezer(raw)
            own = len(self.plain.compress(raw)) - len(informed.compress(raw))
            self.templates.append((name, words, informed, max(own, 1)))
        self.around = AROUND * max(len(words) for _, words, _, _ in self.templates) // 100
        self.needs = [Counter(words) for _, words, _, _ in self.templates]
        self.may_lose = [0 if len(words) <= SHORT else int(MISSING * len(words)) for _, words, _, _ in self.templates]
        # The longer wordings of other licences that contain a template whole.
        longer = lambda k, j: len(self.templates[j][1]) > len(self.templates[k][1]) and self.templates[j][0] != self.templates[k][0]
        every = range(len(self.templates))
        self.inside = [{j for j in every if longer(k, j) and self.missing(self.templates[j][1], k) is not None} for k in every]

    def possible(self, words: list[str]) -> list[int]:
        """Templates that lack no more words than they may, in whatever order; ``missing`` refuses all others."""
        have = Counter(words)
        out = []
        for k, need in enumerate(self.needs):
            lost = {w: n - have[w] for w, n in need.items() if n > have[w]}
            if sum(lost.values()) <= self.may_lose[k] and not any(map(_TELLING.search, lost)):
                out.append(k)
        return out

    def ranked(self, words: list[str]) -> list[tuple[float, int]]:
        """(share of the template's saving, template), best first, among those whose words are there."""
        found = self.possible(words)
        if not found:
            return []
        raw = " ".join(w[:LONGEST_WORD] for w in words).encode()
        alone = len(self.plain.compress(raw))
        shares = [(max(min((alone - len(informed.compress(raw))) / own, 1.0), 0.0), -k) for k in found for _, _, informed, own in [self.templates[k]]]
        return [(s, -k) for s, k in sorted(shares, reverse=True)]

    def place(self, block: list[str], k: int) -> tuple[int, int, int] | None:
        """First word, end and words missing of template k in a block, or None if it is another wording."""
        from difflib import SequenceMatcher

        words = self.templates[k][1]
        n = len(words)
        if n <= SHORT:
            first = words[0]
            return next(((i, i + n, 0) for i, w in enumerate(block) if w == first and block[i : i + n] == words), None)
        pieces = [p for p in SequenceMatcher(None, words, block, autojunk=False).get_matching_blocks() if p.size]
        kept = set()
        for p in pieces:
            kept.update(range(p.a, p.a + p.size))
        lost = [words[i] for i in range(n) if i not in kept]
        if len(lost) > MISSING * n or any(map(_TELLING.search, lost)):
            return None
        return pieces[0].b, pieces[-1].b + pieces[-1].size, len(lost)

    def missing(self, block: list[str], k: int) -> int | None:
        """Words of template k that the block lacks, or None if it is another wording."""
        found = self.place(block, k)
        return found and found[2]

    def places(self, words: list[str], k: int) -> list[tuple[int, int, int]]:
        """Every place of template k: the one found first, and those before and behind it."""
        out, todo = [], [(0, len(words))]
        while todo:
            a, b = todo.pop()
            if b - a >= len(self.templates[k][1]) - self.may_lose[k] and (found := self.place(words[a:b], k)):
                i, j, lost = found
                out.append((a + i, a + j, lost))
                todo += [(a, a + i), (a + j, b)]
        return out

    def confirmed(self, words: list[str]) -> list[tuple[int, int, str, float, int]]:
        """Licences of a block: first word, end, name, share saved and words missing. Where places
        overlap, a licence counts once, by its longest wording, and a template that is part of
        another one counts for nothing of its own."""
        hits: dict[tuple[int, int, int], tuple[float, int]] = {}
        for at in range(0, max(1, len(words) - self.around), self.around):
            part = words[at : at + 2 * self.around]
            for share, k in self.ranked(part):
                for a, b, lost in self.places(part, k):
                    hits[k, at + a, at + b] = max(hits.get((k, at + a, at + b), (0.0, lost)), (share, lost))
        best = sorted((-len(self.templates[k][1]), lost, a, b, k, share) for (k, a, b), (share, lost) in hits.items())
        out: list[tuple[int, int, int, float, int]] = []
        for _, lost, a, b, k, share in best:
            name = self.templates[k][0]
            if not any(a < y and x < b and (self.templates[j][0] == name or j in self.inside[k]) for x, y, j, _, _ in out):
                out.append((a, b, k, share, lost))
        return sorted((a, b, self.templates[k][0], share, lost) for a, b, k, share, lost in out)

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Spans (code points) of candidate blocks: all words within ``around`` of a keyword."""
        low = _lower(text)
        if not any(all(part in low for part in k.split()) for k in KEYWORDS):
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        begins, at = [], 0
        for a, b in spans:
            begins.append(at)
            at += b - a + 1
        out: list[tuple[int, int]] = []
        for m in _KEYWORD.finditer(" ".join(low[a:b] for a, b in spans)):
            i = bisect_right(begins, m.start()) - 1
            a, b = max(0, i - self.around), min(len(spans), i + self.around + 1)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return [(spans[a][0], spans[b - 1][1]) for a, b in out]

    def scan(self, text: str) -> list[tuple[int, int, str, float, int]]:
        """(start, end, licence, share, missing) of every confirmed licence of a text."""
        out = []
        for a, b in self.blocks(text):
            spans = [m.span() for m in _WORD.finditer(_lower(text[a:b]))]
            out += [(a + spans[i][0], a + spans[j - 1][1], *hit) for i, j, *hit in self.confirmed(words_of(text[a:b]))]
        return out


@functools.lru_cache(maxsize=2)
def scanner(more: tuple[tuple[str, str], ...] = ()) -> Scanner:
    """One scanner in each Python worker."""
    return Scanner((*TEMPLATES, *more))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``id_col, n_blocks, matches`` of each row; matches holds (start, end, license, saving, missing).

    ``more`` holds further pairs of licence and wording, such as whole licence texts; a wording without
    one of ``KEYWORDS`` is never looked for.

    A null or empty text has no blocks. Positions are code points from the first word of the
    notice, the end exclusive; saving is the share of the template's own saving in thousandths. Equal rows give equal rows; an empty table
    gives no rows; long texts are read whole; other columns are not read and may have any names.
    """
    kind = dict(df.dtypes)[id_col]

    def make():
        import pyarrow as pa

        scan = scanner(more)
        match = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saving", pa.int64()), ("missing", pa.int64())]))

        def work(batch):
            blocks, matches = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                blocks.append(len(scan.blocks(text)))
                matches.append([{"start": a, "end": b, "license": name, "saving": int(1000 * share), "missing": lost} for a, b, name, share, lost in scan.scan(text)] if blocks[-1] else [])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.int64()), pa.array(matches, match)], names=[id_col, "n_blocks", "matches"])

        return work

    schema = f"`{id_col}` {kind}, n_blocks long, matches array<struct<start:long,end:long,license:string,saving:long,missing:long>>"
    return map_arrow(df, [id_col, text_col], schema, make)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document: their sorted names, and all matches with spans."""
    out = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    each = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), m["missing"].cast("string"))), ",")
    return out.select("doc_id", "n_blocks", names.alias("licenses"), each.alias("matches"))
