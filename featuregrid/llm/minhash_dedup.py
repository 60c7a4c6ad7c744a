"""MinHash near-dedup over word shingles.

1. One pass over the texts gives each document its shingle set's size, a 128-bit class of
   equal sets, a signature of universal hash minima (low bytes) and one key per band. One node
   stands for each class.
2. Nodes meet in band buckets. The members of a bucket are compared with its head, the least one:
   candidates pass a size bound and signature verification, then the full sets of both texts
   decide, for each node with its likeliest head first and with others only where that has not
   joined them. Alternating stars give components. Large buckets whose members still lie in
   several components get further heads while that joins many of them.
3. What is left is compared in blocks of bounded size, by signature alone: the members outside the
   main component of a bucket against all others, each pair in the first band that it shares. A
   block proposes the likeliest pairs that span its components in a few forests, which are
   confirmed on full sets. The members of pairs that it withholds meet again in blocks with their
   texts, where all pairs between components that are still apart are decided on full sets.
   So no group is expanded into all its pairs, few texts travel with a bucket, and no candidate
   that could join two components is left unchecked.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, join_by_key, map_arrow, table
from .components import connected_components

#: Bands and rows of each: a pair of similarity 0.8 shares no band with probability 5e-6.
BANDS, ROWS = 40, 6
#: Minima of a signature; the bands take the first of them.
HASHES = 440
#: Signature agreement may fall so many standard deviations below the threshold, which a pair at the
#: threshold does with probability 1e-6.
SLACK = 4.75
#: Rows of one side of a block, and shingles of its texts; buckets of more rows get further heads first.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Forests of pairs that a block proposes.
FORESTS = 4
#: Pairs that are confirmed beside one copy of their common text.
CHUNK_PAIRS = 256
#: Buckets and node ids (a few integers each) are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 500_000
#: Texts handled at once, in shingles.
CHUNK = 1 << 18

_SEED = 1811


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hashes of 32 bits."""
    rng = np.random.Generator(np.random.PCG64(_SEED))
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(sets: list[np.ndarray], family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of minima for each set; no set may be empty."""
    out = np.empty((len(sets), len(family[0])), np.uint32)
    done = 0
    while done < len(sets):
        size, end = 0, done
        while end < len(sets) and (end == done or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        values = (np.concatenate(sets[done:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[done : end - 1]], dtype=np.int64)]).astype(np.int64)
        hashed = np.empty_like(values)
        for k, (a, b) in enumerate(zip(*family)):
            np.multiply(values, a, out=hashed)
            np.add(hashed, b, out=hashed)
            out[done:end, k] = np.minimum.reduceat(hashed, starts)
        done = end
    return out


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, n_shingles, class, signature, bands`` of each row; no words: the last three are null."""

    def make():
        import pyarrow as pa

        from .shingles import mix, shingle_sets, text_bytes

        family = hash_family(HASHES)

        def work(batch):
            sets = shingle_sets(*text_bytes(batch.column(1)), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = minima([sets[i] for i in full], family) if full else np.zeros((0, HASHES), np.uint32)
            keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(full), BANDS))
            for r in range(ROWS):
                keys = mix(keys ^ sig[:, r : BANDS * ROWS : ROWS].astype(np.uint64)) * np.uint64(3)
            keys = keys.view(np.int64)
            low = sig.astype(np.uint8)
            classes, sigs, bands = ([None] * len(sets) for _ in range(3))
            for k, i in enumerate(full):
                classes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                sigs[i] = low[k].tobytes()
                bands[i] = keys[k]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "class", "signature", "bands"])

        return work

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(slim, ["id", "text"], "id long, n_shingles long, class binary, signature binary, bands array<long>", make, batch_bytes=1 << 19)


def _agreement_floor(threshold: float) -> int:
    """Least number of equal signature bytes of a pair at the threshold, with slack."""
    n = HASHES
    p = threshold + (1 - threshold) / 256
    return int(n * p - SLACK * np.sqrt(n * p * (1 - p)))


def _sized(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def agreeing(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, sig_u, sig_v) whose signatures agree often enough, with ``agree``."""
    floor = _agreement_floor(percent / 100)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            agree = (a == b).sum(1)
            keep = pa.array(agree >= floor)
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (batch.column(0), batch.column(1), pa.array(agree, pa.int32()))], names=["u", "v", "agree"])

    return pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long, agree int")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, work: Workspace) -> DataFrame:
    """The pairs (u, v), a saved table, whose full shingle sets overlap by at least ``percent``.

    The texts of rows (node, text) of ``docs`` go to the pairs' chunks: the text of u once for each
    chunk, followed by the texts of at most about ``CHUNK_PAIRS`` partners. So a node with many
    partners is spread over many chunks, and a task holds the sets of one u and of a slice.
    """
    ends = work.save(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    texts = docs.join(broadcast_if_small(ends, BROADCAST_ROWS), "node")
    sizes = work.save(pairs.groupBy("u").agg(F.count("*").alias("partners")))
    chunks = F.ceil(F.col("partners") / CHUNK_PAIRS).cast("int")
    left = texts.withColumnRenamed("node", "u").join(broadcast_if_small(sizes, BROADCAST_ROWS), "u")
    left = left.select("u", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(None).cast("long").alias("v"), "text")
    dealt = join_by_key(pairs, sizes, "u", "partners", BROADCAST_ROWS)
    dealt = dealt.select("u", F.pmod(F.xxhash64("v"), chunks).cast("int").alias("chunk"), "v")
    dealt = work.save(dealt)
    few = dealt.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = texts.withColumnRenamed("node", "v").join(F.broadcast(dealt) if few else dealt, "v").select("u", "chunk", "v", "text")
    rows = left.unionByName(right).repartition("u", "chunk").sortWithinPartitions("u", "chunk", F.asc_nulls_first("v"))

    def run(batches):
        import pyarrow as pa

        from .shingles import shingle_sets, text_bytes

        key, heads = None, []
        for whole in batches:
            step = max(1, int(whole.num_rows * (1 << 20) / max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                us, chunk, vs = (batch.column(i).to_pylist() for i in range(3))
                keep = []
                for i, found in enumerate(shingle_sets(*text_bytes(batch.column(3)), width)):
                    if (us[i], chunk[i]) != key:
                        key, heads = (us[i], chunk[i]), []
                    if vs[i] is None and not any(np.array_equal(found, h) for h in heads):  # repeated rows add nothing
                        heads.append(found)
                    keep.append(vs[i] is not None and any(_linked(h, found, percent) for h in heads))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], names=["u", "v"])

    out = work.save(rows.mapInArrow(run, "u long, v long"))
    work.drop(ends, sizes, dealt)
    return out


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets overlap by at least ``percent``."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def spanning(pairs: list[tuple[int, int]], forests: int) -> list[int]:
    """Places of the pairs (of components) that join trees of one of so many forests, taken in order."""
    roots: list[dict[int, int]] = [{} for _ in range(forests)]

    def root(of: dict[int, int], c: int) -> int:
        while (up := of.get(c, c)) != c:
            of[c] = of.get(up, up)
            c = up
        return c

    out = []
    for i, (a, b) in enumerate(pairs):
        for of in roots:
            x, y = root(of, a), root(of, b)
            if x != y:
                of[max(x, y)] = min(x, y)
                out.append(i)
                break
    return out


def _in_blocks(rows: DataFrame, schema: str, decide) -> DataFrame:
    """What ``decide`` returns, as lists for the columns of ``schema``, for each block of ``rows``: its
    bucket, then for its rows the columns from the fourth on, as NumPy arrays or lists."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        key, block = None, []

        def out():
            columns = decide(key[0], [np.concatenate(c) if isinstance(c[0], np.ndarray) else sum(c, []) for c in zip(*block)])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if tuple(keys[a].tolist()) != key:
                    if block:
                        yield out()
                    key, block = tuple(keys[a].tolist()), []
                part = [batch.column(i).slice(a, b - a) for i in range(3, batch.num_columns)]
                flags, *numbers = (x.to_numpy(zero_copy_only=False) for x in part[:4])
                sigs = np.frombuffer(b"".join(part[4].to_pylist()), np.uint8).reshape(b - a, -1)
                bands = np.array(part[5].flatten(), np.int32).reshape(b - a, -1)
                block.append((flags, *numbers, sigs, bands, *(x.cast("binary").to_pylist() for x in part[6:])))
        if block:
            yield out()

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, schema)


def _likely(bucket: int, flags, comp, n, sig, bands, percent: int, floor: int):
    """Pairs of a block as rows (agreement, outside row, other row), likeliest first: of different
    components, of fitting sizes, with enough agreement, and in no earlier bucket together. Buckets and
    bands are compared by 32 bits; a pair is missed by this with probability 1e-8."""
    outer, inner = np.flatnonzero(flags), np.flatnonzero(~flags)
    comps, sizes, sigs, own = comp[inner], n[inner], sig[inner], np.int32(bucket >> 32)
    found = [np.zeros((3, 0), np.int64)]
    for r in outer if len(inner) else ():
        fits = np.flatnonzero((comps != comp[r]) & (100 * np.minimum(sizes, n[r]) >= percent * np.maximum(sizes, n[r])))
        agree = (sigs[fits] == sig[r]).sum(1)
        close = np.flatnonzero(agree >= floor)
        if len(close):
            shared = bands[inner[fits[close]]] == bands[r]
            close = close[bands[r][shared.argmax(1)] == own]
            found.append(np.stack([agree[close], np.full(len(close), r), inner[fits[close]]]))
    found = np.concatenate(found, 1)
    return found[:, np.lexsort((found[2], found[1], -found[0]))]


def proposed_in_blocks(rows: DataFrame, percent: int, forests: int) -> DataFrame:
    """Pairs (u, v) to confirm from blocks of (bucket, i, j, outside, node, component, n, signature,
    bands), and the members of withheld pairs as rows (bucket, u, null)."""
    floor = _agreement_floor(percent / 100)

    def decide(bucket, block):
        flags, node, comp, n, sig, bands = block
        _, a, b = _likely(bucket, flags, comp, n, sig, bands, percent, floor)
        chosen = spanning(list(zip(comp[a].tolist(), comp[b].tolist())), forests)
        u, v = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        left = np.ones(len(a), bool)
        left[chosen] = False
        held = np.unique(np.concatenate([u[left], v[left]])).tolist()
        u, v = u[chosen].tolist() + held, v[chosen].tolist() + [None] * len(held)
        return [bucket] * len(u), u, v

    return _in_blocks(rows, "bucket long, u long, v long", decide)


def linked_in_blocks(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) from blocks as above with the texts of their rows. Two components that a link has
    joined are not compared again in a block, so it has fewer links than components."""
    floor = _agreement_floor(percent / 100)

    def decide(bucket, block):
        import pyarrow as pa

        from .shingles import shingle_sets, text_bytes

        flags, node, comp, n, sig, bands, texts = block
        sets: dict[int, np.ndarray] = {}
        joined: dict[int, int] = {}
        us, vs = [], []

        def root(c):
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        def set_of(i):
            if i not in sets:
                sets[i] = shingle_sets(*text_bytes(pa.array([texts[i]], pa.binary()).cast(pa.string())), width)[0]
            return sets[i]

        _, first, second = _likely(bucket, flags, comp, n, sig, bands, percent, floor)
        for a, b in zip(first.tolist(), second.tolist()):
            x, y = root(int(comp[a])), root(int(comp[b]))
            if x != y and _linked(set_of(a), set_of(b), percent):
                joined[max(x, y)] = min(x, y)
                us.append(int(min(node[a], node[b])))
                vs.append(int(max(node[a], node[b])))
        return us, vs

    return _in_blocks(rows, "u long, v long", decide)


class _Links:
    """Confirmed links so far, as components, and the tables that finding more of them needs."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, members: DataFrame, width: int, percent: int, work: Workspace):
        self.nodes, self.docs, self.members = nodes, docs, members
        self.width, self.percent, self.work = width, percent, work
        self.parts = work.save(nodes.select("node", F.col("node").alias("component")).where("1 = 0"))

    def confirm(self, pairs: DataFrame) -> None:
        """Confirm proposed pairs whose ends lie in different components, and join these."""
        work = self.work
        for end in ("u", "v"):
            part = self.parts.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
            pairs = pairs.join(broadcast_if_small(part, BROADCAST_ROWS), end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
        apart = work.save(pairs.where("c_u <> c_v").select("u", "v").distinct())
        if not apart.isEmpty():
            self.join(confirmed(apart, self.docs, self.width, self.percent, work))
        work.drop(apart)

    def join(self, links: DataFrame) -> None:
        """Take confirmed links (a saved table) into the components."""
        if not links.isEmpty():
            edges = links.union(self.parts.where("node <> component"))
            old, self.parts = self.parts, self.work.save(connected_components(edges, self.work))
            self.work.drop(old)
        self.work.drop(links)

    def star(self, pairs: DataFrame) -> None:
        """Confirm what passes of pairs (u, v): for each v its likeliest u first, then the others."""
        work = self.work
        pairs = work.save(pairs.distinct())
        ends = self.nodes.select("node", "n", "signature")
        heads = work.save(ends.toDF("u", "n_u", "sig_u").join(pairs.groupBy("u").agg(F.count("*").alias("partners")), "u"))
        joined = pairs.join(ends.toDF("v", "n_v", "sig_v"), "v")
        joined = join_by_key(joined, heads, "u", "partners", BROADCAST_ROWS // 8)
        close = work.save(agreeing(joined.where(_sized("n_u", "n_v", self.percent)), self.percent).distinct())
        best = close.groupBy("v").agg(F.max(F.struct("agree", (-F.col("u")).alias("u"))).alias("best"))
        best = work.save(best.select((-F.col("best.u")).alias("u"), "v"))
        self.confirm(best)
        self.confirm(close.join(broadcast_if_small(best, BROADCAST_ROWS), ["u", "v"], "left_anti"))
        work.drop(pairs, heads, close, best)

    def open_rows(self) -> DataFrame:
        """The members of buckets that still have several components: ``bucket, node, n, component,
        head, members, main, main_of, outside``, main being the component of the least node."""
        placed = self.members.where("members > 2").join(self.parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sums = placed.groupBy("bucket").agg(F.min_by("component", "node").alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        sums = self.work.save(sums.where("lo <> hi").join(self.members.select("bucket", "members").distinct(), "bucket").select("bucket", "main", F.col("members").alias("size")))
        out = self.work.save(join_by_key(placed, sums, "bucket", "size", BROADCAST_ROWS).withColumn("outside", F.col("component") != F.col("main")).drop("size"))
        self.work.drop(sums)
        return out

    def further_heads(self) -> DataFrame:
        """Give large open buckets new heads while that joins a quarter of what lies outside; the
        rows that are still open."""
        heads, before = None, None
        while True:
            rows = self.open_rows()
            large = rows.where(F.col("members") > BLOCK)
            outside = large.where("outside").count()
            if not outside or (before is not None and 4 * outside > 3 * before):
                return rows
            before = outside
            left = large.where("outside")
            if heads is not None:  # heads ascend, so none comes twice
                left = left.join(broadcast_if_small(heads.select("bucket", F.col("next").alias("last")), BROADCAST_ROWS), "bucket").where("node > last")
            chosen = self.work.save(left.groupBy("bucket").agg(F.min("node").alias("next"), F.min_by("component", "node").alias("c_next"), F.max("members").alias("size")))
            met = join_by_key(large, chosen, "bucket", "size", BROADCAST_ROWS).where("component <> c_next")
            self.star(met.select(F.col("next").alias("u"), F.col("node").alias("v")))
            self.work.drop(rows, *([] if heads is None else [heads]))
            heads = chosen

    def dealt(self, rows: DataFrame, carried: list[str]) -> DataFrame:
        """Blocks of the rows of open buckets: each side split by rows and by shingles."""
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("size_n"), F.sum(F.col("outside").cast("long")).alias("out"), F.sum(F.when(F.col("outside"), F.col("n"))).alias("out_n"))
        sizes = self.work.save(sizes.where("out > 0"))
        parts = lambda count, n: F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(n) / BLOCK_SHINGLES)).cast("int")
        full = join_by_key(rows, sizes, "bucket", "size", BROADCAST_ROWS)
        full = full.withColumns({"m": parts("size", "size_n"), "o": parts("out", "out_n"), "salt": F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int")})
        ends = self.nodes.select("node", "signature", F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("bands"))
        full = full.join(ends, "node")
        if "text" in carried:
            full = full.join(self.docs.join(broadcast_if_small(rows.select("node").distinct(), BROADCAST_ROWS), "node", "left_semi"), "node")
        inner = full.select("bucket", F.explode(F.sequence(F.lit(0), F.col("o") - 1)).alias("i"), (F.col("salt") % F.col("m")).alias("j"), F.lit(False).alias("outside"), *carried)
        outer = full.where("outside").select("bucket", (F.col("salt") % F.col("o")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), F.lit(True).alias("outside"), *carried)
        return inner.unionByName(outer)

    def blocks(self, rows: DataFrame) -> None:
        """Compare what is open in blocks, and what these withhold in blocks with texts."""
        work, carried = self.work, ["node", "component", "n", "signature", "bands"]
        if rows.isEmpty():
            return
        found = work.save(proposed_in_blocks(self.dealt(rows, carried), self.percent, FORESTS))
        self.confirm(found.where("v is not null").select("u", "v").distinct())
        held = work.save(found.where("v is null").select("bucket", F.col("u").alias("node")).distinct())
        if not held.isEmpty():
            rows = work.save(self.open_rows().join(broadcast_if_small(held, BROADCAST_ROWS), ["bucket", "node"], "left_semi"))
            self.join(work.save(linked_in_blocks(self.dealt(rows, [*carried, "text"]), self.width, self.percent)))


def near_duplicates(df: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for each row of ``df``.

    Documents are linked when 100 * common >= percent * united shingles, A-Z read as a-z.
    component_id is the least id reachable over links; kept marks the document that bears it.
    Texts without words (null, empty, blanks) have 0 shingles and are linked with nothing.
    Rows that repeat an id and text get equal results; rows that repeat an id with another text
    are documents of their own, whose texts count as one when links are confirmed. A row with
    a null id is linked with nothing, has a null component_id and is kept. An empty table gives
    no rows. Only the id and text columns are read, so other columns may have any names. Ids are
    integers. ``df`` is read once for the fingerprints and again for each round of confirmations,
    so a costly plan should be saved before.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = work.save(fingerprints(slim, "id", "text", width).withColumn("row", F.monotonically_increasing_id()))
    # One row stands for each class of equal sets: the first one of its least id.
    known = prints.where("class is not null and id is not null")
    classes = work.save(known.groupBy("class").agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("copies")).select("class", "copies", F.col("least.id").alias("node"), F.col("least.row").alias("row")))
    firsts = broadcast_if_small(classes.select("row", "node"), BROADCAST_ROWS)
    nodes = work.save(known.join(firsts, "row").select("node", F.col("n_shingles").alias("n"), "signature", "bands"))

    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    heads = work.save(buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("members")).where("members > 1"))
    members = work.save(join_by_key(buckets, heads, "bucket", "members", BROADCAST_ROWS))
    work.drop(heads)
    docs = slim.where("id is not null").select(F.col("id").alias("node"), "text")
    links = _Links(nodes, docs, members, width, percent, work)
    links.star(members.where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")))
    links.blocks(links.further_heads())

    named = classes.join(links.parts, "node", "left").select("class", "copies", F.coalesce("component", "node").alias("component_id"))
    found = join_by_key(known.select("id", "n_shingles", "class"), work.save(named), "class", "copies", BROADCAST_ROWS)
    alone = prints.where("class is null or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = found.select("id", "n_shingles", "component_id").union(alone)
    out = work.save(out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
    work.drop_others(out)
    return out.withColumnRenamed("id", id_col)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents over two-word shingles at similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "minhash"), width=2, percent=80)
