"""N-gram Jaccard join by parity sketches.

Each distinct shingle set is a node. A node's tokens are dealt to m blocks by a hash, and each block
holds the XOR of its tokens' codes, a linear parity sketch: a token in one set but not in the other
changes one block, so the blocks that differ are at most the symmetric difference. Sets of a size band
that reach the threshold differ in at most D tokens, so at least m - D blocks agree (pigeonhole). Nodes
are joined on (band, block, content).

A key that more than HOT nodes share is hot and gives no pairs. A node that has more than D blocks that
are neither empty nor hot loses nothing by that: one of them must agree. Pairs are counted over their
keys, and only those that agree on as many as that leaves necessary are verified on their sets. The
other nodes ("lacking": members of large families of near copies, and some very small sets) are
compared among themselves by band, exactly, in blocks of nodes, with an inverted index and a
breadth-first search that compares each node only with nodes not reached yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dealt, saved, tasks_for, text_bytes
from .shingles import mix, shingle_sets

#: Keys that more nodes share give no pairs; nodes compared in one task at most, twice.
HOT, BLOCK = 16, 2048
#: Bytes of text for each bucket of keys, and of keys held back in a task before they are sent.
BUCKET_BYTES, HELD_BYTES = 12 << 20, 4 << 20
#: Keys of a bucket beyond which it is thinned in slices of its nodes first; only hot keys make a bucket so large.
MOST_KEYS = 1 << 20
_SKETCH = np.uint64(0xD1B54A32D192ED03)


@lru_cache(1 << 16)
def band(n: int, percent: int = 80) -> tuple[int, int, int]:
    """Number of the band that holds sets of n tokens, its greatest size and that of the band below: 1, 2-3, 4-6, 7-10, ...

    A band reaches so far that the greatest partner of the band below is in it: partners are one band apart at most.
    """
    g, below, high = 0, 0, 1
    while n > high:
        g, below, high = g + 1, high, max(high + 1, (high + 1) * 3 // 2, high * 100 // percent)
    return g, high, below


def limits(high: int, percent: int) -> tuple[int, int, int]:
    """Of the band up to `high`: the greatest partner's size, the greatest difference D, and the blocks m."""
    partner = high * 100 // percent
    differ = (high + partner) * (100 - percent) // (100 + percent)
    return partner, differ, differ + 1 + max(6, (differ + 1) // 4)


def blocks_of(tokens: np.ndarray, g: int, m: int) -> np.ndarray:
    """Keys of a set's blocks that are not empty."""
    code = mix(tokens ^ _SKETCH)
    block = (code >> np.uint64(33)) % np.uint64(m)
    order = np.argsort(block, kind="stable")
    block = block[order]
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    content = np.bitwise_xor.reduceat(code[order], starts)
    return mix(content + block[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(g))


@lru_cache(1 << 16)
def contexts(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, D, m) for each band in which a set of n tokens is compared: its own, and the one below if that reaches so far."""
    g, high, below = band(n, percent)
    found = [(g, *limits(high, percent)[1:])]
    if below and n <= limits(below, percent)[0]:
        found.append((g - 1, *limits(below, percent)[1:]))
    return found


def signature(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    facts = np.array([tokens.sum(), np.bitwise_xor.reduce(tokens), len(tokens)], np.uint64)
    return int(mix(mix(facts * np.uint64(2) + np.uint64(1)).cumsum()).view(np.int64)[-1])


SKETCHED = "doc_id bigint, text_hash bigint, n bigint, sig bigint, c0 int, d0 int, c1 int, d1 int, bucket int, sigs binary, sizes binary, keys binary, n_keys int"


def _sketch(batches: Iterator[pa.RecordBatch], n_buckets: int, percent: int, width: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows of keys by bucket: signatures, number of keys of each, keys (seven bytes each)."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    seen: set[int] = set()
    n_held = 0
    names = [x.split()[0] for x in SKETCHED.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 5 + [pa.binary()] * 3 + [pa.int32()]

    def rows(docs: list[list], blobs: list[tuple]) -> pa.RecordBatch:
        columns = [d + [None] * len(blobs) for d in docs] + [[None] * len(docs[0]) + [b[k] for b in blobs] for k in range(5)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def flush() -> list[tuple]:
        # an entry a node and band was held, so memory does not grow with the buckets; one a node and bucket is made here
        sizes = np.array([len(k) for _, k, _ in held])
        sigs = np.array([s for s, _, _ in held], np.int64)
        keys, to = np.concatenate([k for _, k, _ in held]), np.concatenate([t for _, _, t in held])
        held.clear()
        seen.clear()
        order = np.argsort(to, kind="stable")
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        keys, to = keys[order], to[order]
        starts = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (owner[1:] != owner[:-1])])
        sizes, sigs, of = np.diff(np.r_[starts, len(to)]).astype(np.uint16), sigs[owner[starts]], to[starts]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        packed = keys.view(np.uint8).reshape(-1, 8)[:, :7]
        out = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
            x, y = int(starts[a]), int(starts[b]) if b < len(of) else len(to)
            out.append((int(of[a]), sigs[a:b].tobytes(), sizes[a:b].tobytes(), packed[x:y].tobytes(), y - x))
        return out

    for batch in batches:
        ids = batch.column(0).to_pylist()
        docs: list[list] = [[] for _ in range(8)]
        blobs: list[tuple] = []
        for doc_id, text_hash, tokens in zip(ids, batch.column(2).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
            n, facts, sig = len(tokens), [None] * 4, None
            if n and doc_id is not None:
                sig = signature(tokens)
                fresh = sig not in seen
                seen.add(sig)
                for g, differ, m in contexts(n, percent):
                    keys = blocks_of(tokens, g, m)
                    facts[2 * (g % 2) : 2 * (g % 2) + 2] = [len(keys), differ]
                    if fresh:
                        # the lowest bit tells the node's two bands apart; the bucket is in the eighth byte
                        to = ((keys >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int32)
                        keys = keys & ~np.uint64(1) | np.uint64(g % 2)
                        for at in range(0, len(keys), 60_000):  # sizes are of 16 bits
                            held.append((sig, keys[at : at + 60_000], to[at : at + 60_000]))
                        n_held += 7 * len(keys)
            for column, value in zip(docs, [doc_id, text_hash, n, sig, *facts], strict=True):
                column.append(value)
            if n_held > HELD_BYTES:
                blobs += flush()
                n_held = 0
        yield rows(docs, blobs)
    if held:
        yield rows([[] for _ in range(8)], flush())


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Signature and key of each key in rows of packed keys."""
    sigs, keys = [], []
    for s, z, k in zip(*(table.column(c).to_pylist() for c in ("sigs", "sizes", "keys")), strict=True):
        sigs.append(np.repeat(np.frombuffer(s, np.int64), np.frombuffer(z, np.uint16)))
        raw = np.frombuffer(k, np.uint8).reshape(-1, 7)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :7] = raw
        keys.append(wide.view(np.uint64).ravel())
    return np.concatenate(sigs), np.concatenate(keys)


def _pack(sig: np.ndarray, key: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return sig.tobytes(), np.ones(len(sig), np.uint16).tobytes(), np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, slices, packed keys) dealt to slices by signature, so that a node's keys of a bucket are in one slice."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            sig, key = _unpack(pa.Table.from_batches([one]))
            at = (mix(sig.view(np.uint64)) % np.uint64(one.column(1)[0].as_py())).astype(np.int64)
            order = np.argsort(at, kind="stable")
            sig, key, at = sig[order], key[order], at[order]
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            columns = [[one.column(0)[0].as_py()] * len(spans), [int(at[x]) for x, _ in spans], *zip(*(_pack(sig[x:y], key[x:y]) for x, y in spans), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.int32()] * 2 + [pa.binary()] * 3, strict=True)], names=["bucket", "slice", "sigs", "sizes", "keys"])


def _thin(table: pa.Table) -> pa.Table:
    """Of a slice of a bucket: all its keys but those of hot ones, of which HOT + 1 nodes go on and tell that the key is hot; the others' are counted here as _meet would."""
    sig, key = _unpack(table)
    order = np.lexsort((sig, key))
    sig, key = sig[order], key[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])]
    sig, key = sig[fresh], key[fresh]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    place = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
    go = place <= HOT
    counted = pd.DataFrame({"kind": (2 + (key[~go] & np.uint64(1))).astype(np.int32), "a": sig[~go]}).groupby(["kind", "a"], as_index=False).size()
    n, packed = len(counted), _pack(sig[go], key[go])
    a = pa.array(counted["a"].tolist() + [None], pa.int64())
    blank = [None] * n
    return pa.table({
        "kind": pa.array([*counted["kind"].tolist(), None], pa.int32()), "a": a, "b": a, "n": pa.array([*counted["size"].tolist(), None], pa.int64()), "bucket": pa.array([*blank, table.column("bucket")[0].as_py()], pa.int32()),
        "sigs": pa.array([*blank, packed[0]], pa.binary()), "sizes": pa.array([*blank, packed[1]], pa.binary()), "keys": pa.array([*blank, packed[2]], pa.binary()),
    })


def _meet(table: pa.Table) -> pa.Table:
    """Of a bucket's keys: pairs (0 or 1: band's parity, a, b, number of keys) and the hot keys of nodes (2 or 3, node, null, number of keys)."""
    sig, key = _unpack(table)
    order = np.lexsort((sig, key))
    sig, key = sig[order], key[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])]
    sig, key = sig[fresh], key[fresh]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    out = []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= HOT)]).tolist():
        at = starts[sizes == size]
        for i in range(size):
            for j in range(i + 1, size):
                out.append((key[at] & np.uint64(1), sig[at + i], sig[at + j]))
    hot = np.repeat(sizes > HOT, sizes)
    out.append((2 + (key[hot] & np.uint64(1)), sig[hot], sig[hot]))
    frame = pd.DataFrame({"kind": np.concatenate([x[0] for x in out]).astype(np.int32), "a": np.concatenate([x[1] for x in out]), "b": np.concatenate([x[2] for x in out])})
    counted = frame.groupby(["kind", "a", "b"], as_index=False).size()
    return pa.table({"kind": counted["kind"].astype(np.int32), "a": counted["a"], "b": counted["b"], "n": counted["size"]})


def _search(table: pa.Table, percent: int) -> pa.Table:
    """Links that span the components among a group's sets (null sets do not occur; a node may be repeated)."""
    nodes = table.column("sig").to_numpy()
    nodes, first = np.unique(nodes, return_index=True)
    column = table.column("tokens").combine_chunks()
    lists = [np.asarray(column[int(i)].values) for i in first]
    sizes = np.array([len(x) for x in lists], np.int64)
    token = np.concatenate(lists)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    waiting = np.ones(len(nodes), bool)
    left, right = [], []
    for seed in range(len(nodes)):
        if not waiting[seed]:
            continue
        waiting[seed], queue = False, [seed]
        while queue and waiting.any():
            x = queue.pop()
            lo, hi = np.searchsorted(token, lists[x], "left"), np.searchsorted(token, lists[x], "right")
            hits = np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            both = np.bincount(hits, minlength=len(nodes))
            found = np.flatnonzero(waiting & (100 * both >= percent * (sizes[x] + sizes - both)) & (both > 0))
            waiting[found] = False
            queue += found.tolist()
            left += [nodes[x]] * len(found)
            right += nodes[found].tolist()
        if len(token) and np.count_nonzero(waiting) * 2 < len(np.unique(owner)):
            keep = waiting[owner]  # nodes that were reached need not be counted any more
            token, owner = token[keep], owner[keep]
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _tokens(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # texts under one doc_id and hash are told apart by their sets
        pairs = zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True)
        sets = [(sig, x.view(np.int64)) for sig, x in pairs if len(x) and signature(x) == sig]
        offsets = np.r_[0, np.cumsum([len(x) for _, x in sets])].astype(np.int32)
        values = np.concatenate([x for _, x in sets]) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([sig for sig, _ in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["sig", "tokens"])


def _met(packed: DataFrame, n_buckets: int) -> DataFrame:
    """_meet() of all buckets. A bucket with more than MOST_KEYS keys is dealt by its nodes to slices and thinned there, so a key of any number of
    nodes sends HOT + 1 of each slice to its bucket."""
    kinds, keys = "kind int, a bigint, b bigint, n bigint", ["bucket", "sigs", "sizes", "keys"]
    slices = F.ceil(F.sum("n_keys") / MOST_KEYS).cast("int")
    heavy = saved(packed.groupBy("bucket").agg(slices.alias("slices")).where("slices > 1"), "heavy")
    if not heavy.take(1):
        return packed.select(*keys).transform(dealt, n_buckets, "bucket").groupBy("bucket").applyInArrow(_meet, kinds)
    sliced = packed.join(heavy, "bucket").select("bucket", "slices", *keys[1:]).mapInArrow(_by_slice, "bucket int, slice int, sigs binary, sizes binary, keys binary")
    thin = saved(sliced.groupBy("bucket", "slice").applyInArrow(_thin, f"{kinds}, bucket int, sigs binary, sizes binary, keys binary"), "thin")
    rest = packed.join(heavy, "bucket", "left_anti").select(*keys).unionByName(thin.where("bucket IS NOT NULL").select(*keys))
    met = rest.transform(dealt, n_buckets, "bucket").groupBy("bucket").applyInArrow(_meet, kinds)
    return met.unionByName(thin.where("kind IS NOT NULL").select("kind", "a", "b", "n"))


def _labelled(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, text_hash, n (shingles), sig (of their set) and first (doc_id and text_hash of its component's first row)."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text", "xxhash64(text) AS text_hash")
    n_buckets = tasks_for(spark, text_bytes(docs), BUCKET_BYTES)
    sketched = saved(docs.mapInArrow(partial(_sketch, n_buckets=n_buckets, percent=percent, width=width), SKETCHED), "sketches")
    rows = sketched.where("n IS NOT NULL").select("doc_id", "text_hash", "n", "sig", "c0", "d0", "c1", "d1")
    met = saved(_met(sketched.where("bucket IS NOT NULL").select("bucket", "sigs", "sizes", "keys", "n_keys"), n_buckets), "met")

    # blocks of each node and band that are left for the pigeonhole; a node without enough is lacking
    nodes = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), *(F.first(c).alias(c) for c in ("c0", "d0", "c1", "d1")))
    hot = met.where("kind >= 2").groupBy(F.col("a").alias("sig"), (F.col("kind") - 2).alias("parity")).agg(F.sum("n").alias("hot"))
    by_band = (
        nodes.select("sig", F.expr("stack(2, 0, c0, d0, 1, c1, d1) AS (parity, blocks, differ)"))
        .where("blocks IS NOT NULL")
        .join(hot, ["sig", "parity"], "left")
        .select("sig", "parity", (F.col("blocks") - F.coalesce("hot", F.lit(0)) - F.col("differ")).alias("need"), "differ")
    )
    by_band = saved(by_band, "bands")
    pairs = met.where("kind < 2").groupBy("a", "b", F.col("kind").alias("parity")).agg(F.sum("n").alias("n"))
    for end in ("a", "b"):
        pairs = pairs.join(by_band.select(F.col("sig").alias(end), "parity", "need"), [end, "parity"]).where("n >= need").drop("need")
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    lacking = by_band.where("need <= 0")

    # sets of the nodes in question only, computed from one text of each
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sig")).unionByName(lacking.select("sig")).distinct()
    texts = docs.join(asked.join(nodes.select("sig", "least.*"), "sig"), ["doc_id", "text_hash"]).select("sig", "text")
    sets = saved(texts.mapInArrow(partial(_tokens, width=width), "sig bigint, tokens array<bigint>"), "sets")
    side = lambda x: sets.select(F.col("sig").alias(x), F.col("tokens").alias(f"t{x}"))
    both = F.size(F.array_intersect("ta", "tb"))
    links = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", both.alias("both"), (F.size("ta") + F.size("tb") - both).alias("any"))
        .where(100 * F.col("both") >= percent * F.col("any"))
        .select("a", "b")
    )

    # lacking nodes by band, in blocks; a pair of blocks is a group
    groups = lacking.groupBy("parity", "differ").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = (
        lacking.join(groups, ["parity", "differ"])
        .withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("sig", "parity", "differ", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    families = (
        placed.join(sets, "sig")
        .groupBy("parity", "differ", "i", "j")
        .applyInArrow(lambda nodes: _search(nodes, percent), "a bigint, b bigint")
    )
    reached = components(links.unionByName(families))
    least = (
        nodes.select(F.col("sig").alias("node"), "least")
        .join(reached, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = saved(least, "least")  # read twice; else its joins are planned, broadcast and run twice
    label = least.join(least.groupBy("component").agg(F.min("least").alias("first")), "component").select(F.col("node").alias("sig"), "first")
    return rows.select("doc_id", "text_hash", "n", "sig").join(label, "sig", "left")


def jaccard_classes(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable by links. No link is lost at any percent from 1 to 100, and no cap drops one. A null or
    empty text, or one without words, has no shingles and is linked with nothing. A doc_id may repeat: each row is
    judged by its own text. A row with a null doc_id is compared with nothing and has a null component. Other columns
    are left out, whatever their names.
    """
    rows = _labelled(docs, percent, width)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), copies and kept for each different row of docs that has words and an id.

    kept is one row of each component: that with the smallest doc_id, and of several texts under it the one with the
    smallest hash. copies counts rows equal in both. Rows that are not here are like nothing else.
    """
    rows = _labelled(docs, percent, width).where("sig IS NOT NULL")
    kept = F.struct("doc_id", "text_hash") == F.col("first")
    return rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.max(kept).alias("kept"))
