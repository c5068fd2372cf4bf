"""Removal of bytes that repeat earlier: per-shard suffix arrays, Kasai common prefixes, merging by binary search.

1. Winnowing. Of every window of `length` bytes the smallest of its k-gram hashes is its anchor, so equal
   windows have equal anchors. Anchor hashes are gathered by bucket; one that occurs once in the corpus
   proves its windows unique. What follows works on the other windows alone, which loses nothing.
2. Shards (documents by a hash of doc_id, a few MB each). The windows left are sorted by a suffix array
   (Larsson-Sadakane: groups of suffixes with equal prefixes are refined by the ranks at doubled depth, sorted
   groups are left alone), Kasai's common prefixes cut it into classes of equal windows, and all but a
   class's first window are repeats.
3. Merging. Of each class that may occur in other shards its first window goes on, in the order of its shard's array, so
   a passage of a third of all documents is one window a shard. By bucket of anchor the shards' lists are merged in a
   tree: the windows of one list are found in another by binary search on their bytes, among those of their anchor.
   Of equal windows the later one is a repeat and leaves. An anchor that very many shards have is merged by groups of
   shards first, so no task holds them all.
4. Spans of a document are united, and its other bytes are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, other_columns, saved, tasks_for, text_bytes
from .shingles import buffers, mix

#: Bytes of text for each shard and for each bucket of anchors, and of a run, which should fit the CPU's cache.
SHARD_BYTES, BUCKET_BYTES, RUN = 3 << 20, 12 << 20, 256 << 10
#: Anchors held back in a task before they are sent.
HELD = 1 << 20
#: Lists of an anchor that are merged in one task at most.
FAN = 1024
#: Anchors of a bucket beyond which it is thinned in slices of its shards first; one document in SAMPLED tells how many a bucket gets.
MOST_ANCHORS, SAMPLED = 2 << 20, 64
LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place, by doubling; places with fewer bytes are left out."""
    def shift(n: int) -> np.uint64:
        return np.uint64(pow(_BASE, n, 1 << 64))

    out, done = None, 0
    part, width = _TABLE[data], 1
    while True:
        if size & width:
            if out is None:
                out, done = part, width
            else:
                n = len(data) - done - width + 1
                out, done = (out[:n] * shift(width) + part[done : done + n] if n > 0 else out[:0]), done + width
        if 2 * width > size:
            break
        n = max(0, len(part) - width)
        part, width = part[:n] * shift(width) + part[width : width + n], 2 * width
    return out[: max(0, len(data) - size + 1)]


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor of the texts in data (ends: of each byte's text): its hash, its first and last window, and its place."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    h = mix(hashes(data, gram))
    bits = np.uint64(max(20, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    value = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost is the smallest
    count, width = length - gram + 1, 1
    best = value
    while 2 * width <= count:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < count:
        best = np.minimum(best[: n - length + 1], best[count - width : count - width + n - length + 1])
    place = (best & low).astype(np.int64)
    whole = np.arange(len(place)) + length <= ends[: len(place)]
    starts = np.flatnonzero(whole & np.r_[True, (place[1:] != place[:-1]) | ~whole[:-1]])
    stops = np.flatnonzero(whole & np.r_[(place[1:] != place[:-1]) | ~whole[1:], True])
    return h[place[starts]], starts, stops, place[starts]


def text_runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN, "right")) - 1))
        yield at, end
        at = end


def run_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of all texts, run by run: hash, first and last window as places in data, row, and place in the first window."""
    for first, end in text_runs(offsets):
        start = int(offsets[first])
        sizes = np.diff(offsets[first : end + 1])
        ends = np.repeat(offsets[first + 1 : end + 1] - start, sizes)
        h, lo, hi, at = anchors(data[start : int(offsets[end])], ends, length, gram)
        if len(h):
            yield h, lo + start, hi + start, np.searchsorted(offsets, lo + start, "right") - 1, at - lo


def _gather(batches: Iterator[pa.RecordBatch], n_buckets: int, n_shards: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Anchor hashes by bucket and shard, each at most twice for each time they are sent."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0

    def send() -> pa.RecordBatch:
        h, shard = (np.concatenate(x) for x in zip(*held, strict=True))
        group = (h % np.uint64(n_buckets)).astype(np.int64) * n_shards + shard
        order = np.lexsort((h, group))
        h, group = h[order], group[order]
        third = np.r_[False, False, (h[2:] == h[:-2]) & (group[2:] == group[:-2])][: len(h)]
        h, group = h[~third], group[~third]
        # a row a bucket, with the sizes of its shards' lists inside
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        bucket, shard, sizes = group[cuts[:-1]] // n_shards, (group[cuts[:-1]] % n_shards).astype(np.int32), np.diff(cuts)
        ends = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        columns = [
            pa.array(bucket[ends[:-1]], pa.int32()),
            pa.array([shard[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([sizes[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
            pa.array([h[cuts[a] : cuts[b]].tobytes() for a, b in spans], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "shards", "sizes", "hashes"])

    for batch in batches:
        shards = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = buffers(batch.column(1))
        for h, _, _, row, _ in run_anchors(data, offsets, length, gram):
            held.append((h, shards[row]))
            n_held += len(h)
            if n_held > HELD:
                yield send()
                held, n_held = [], 0
    if held:
        yield send()


def _loads(batches: Iterator[pa.RecordBatch], n_buckets: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(bucket, n): anchors of the texts by bucket."""
    for batch in batches:
        for h, *_ in run_anchors(*buffers(batch.column(0)), length, gram):
            bucket, n = np.unique(h % np.uint64(n_buckets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])


def _anchors_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    unpack = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    return unpack("hashes", np.uint64), np.repeat(unpack("shards", np.int32), unpack("sizes", np.int32))


SLICED = "bucket int, slice int, shards binary, sizes binary, hashes binary"


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, slices, shards, sizes, hashes) dealt to slices by shard."""
    for batch in batches:
        out: list[tuple] = []
        for row in range(batch.num_rows):
            one = pa.Table.from_batches([batch.slice(row, 1)])
            bucket, n = one.column("bucket")[0].as_py(), one.column("slices")[0].as_py()
            h, shard = _anchors_of(one)
            at = shard % n
            out += [(bucket, k, shard[at == k].tobytes(), np.ones(np.count_nonzero(at == k), np.int32).tobytes(), h[at == k].tobytes()) for k in np.unique(at).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int32() if k < 2 else pa.binary()) for k in range(5)], names=[x.split()[0] for x in SLICED.split(", ")])


def _thin(table: pa.Table, fan: int) -> pa.Table:
    """Of a slice of a bucket: each anchor twice a shard at most. Of one that more than `fan` of its shards have, fan + 1 go on, which tells
    that it is spread wide; the other shards get it from here, as from _repeated."""
    h, shard = _anchors_of(table)
    order = np.lexsort((shard, h))
    h, shard = h[order], shard[order]
    third = np.r_[False, False, (h[2:] == h[:-2]) & (shard[2:] == shard[:-2])][: len(h)]
    h, shard = h[~third], shard[~third]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    nth = np.cumsum(fresh)
    place = nth - np.repeat(nth[starts], np.diff(np.r_[starts, len(h)]))  # of the anchor's shards, from 0
    go = place <= fan
    rest = ~go & fresh
    own = [(int(s), 2, h[rest & (shard == s)].tobytes()) for s in np.unique(shard[rest]).tolist()]
    passed = (table.column("bucket")[0].as_py(), shard[go].tobytes(), np.ones(np.count_nonzero(go), np.int32).tobytes(), h[go].tobytes())
    columns = [[x[0] for x in own] + [None], [x[1] for x in own] + [None], [None] * len(own) + [passed[0]], [None] * len(own) + [passed[1]], [None] * len(own) + [passed[2]], [x[2] for x in own] + [passed[3]]]
    return pa.table({n: pa.array(c, pa.int32() if n in ("shard", "spread", "bucket") else pa.binary()) for n, c in zip(("shard", "spread", "bucket", "shards", "sizes", "hashes"), columns, strict=True)})


def _repeated(table: pa.Table, fan: int) -> pa.Table:
    """Of a bucket: for each shard its anchor hashes that occur twice or more, by spread: 0 in it alone, 1 in up to `fan` shards, 2 in more."""
    h, shard = _anchors_of(table)
    order = np.lexsort((shard, h))
    h, shard = h[order], shard[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = np.diff(np.r_[starts, len(h)])
    fresh = np.r_[True, (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])]
    n_shards = np.add.reduceat(fresh.astype(np.int64), starts)
    wide = np.repeat((n_shards > 1).astype(np.int32) + (n_shards > fan), sizes)
    again = np.repeat(sizes > 1, sizes) & fresh
    h, shard, wide = h[again], shard[again], wide[again]
    order = np.lexsort((h, wide, shard))
    h, shard, wide = h[order], shard[order], wide[order]
    group = shard.astype(np.int64) * 3 + wide
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(h) else np.zeros(1, np.int64)
    found = [(int(group[a]) // 3, int(group[a]) % 3, h[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.table({"shard": pa.array([x[0] for x in found], pa.int32()), "spread": pa.array([x[1] for x in found], pa.int32()), "hashes": pa.array([x[2] for x in found], pa.binary())})


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts like them; beyond the end they are zero."""
    wide = np.zeros(len(data) + 8, np.uint64)
    wide[: len(data)] = data
    out = wide[: len(data)].copy()
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= wide[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of data sorted by their first `depth` bytes or more (Larsson-Sadakane), and the eight-byte words.

    Suffixes that agree that far stay in one group, in no certain order. Beyond the end bytes are zero.
    """
    word = words_at(data)
    n, h = len(data), 8
    order = np.argsort(word, kind="stable")
    sorted_word = word[order]
    fresh = np.r_[True, sorted_word[1:] != sorted_word[:-1]] if n else np.zeros(0, bool)
    while h < depth and n:
        head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # a group's number: where it starts
        rank = np.zeros(n + h, np.int64)
        rank[order] = head + 1
        open_ = ~(fresh & np.r_[fresh[1:], True])  # in groups of two suffixes or more
        at = np.flatnonzero(open_)
        if not len(at):
            break
        key = head[at] << 32 | rank[order[at] + h]
        turn = np.argsort(key, kind="stable")
        key, order[at] = key[turn], order[at][turn]
        fresh[at] = np.r_[True, key[1:] != key[:-1]]
        h *= 2
    return order, word


def common_prefixes(word: np.ndarray, order: np.ndarray, most: int, lane: int = 64) -> np.ndarray:
    """Kasai: for each suffix in the array the prefix it shares with the one before it, up to `most` bytes.

    In text order a suffix shares at least one byte less than the suffix one place before it did; where that one
    shares `most` bytes the array may not be sorted further, and this holds only if both their forerunners are
    neighbours in the text too (they mostly are, as such suffixes stay in text order). The text is cut into lanes that walk side by side, each with its own count; eight bytes are compared at a time.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    wide = np.r_[word, np.zeros(most + 8, np.uint64)]
    shared = np.zeros(n, np.int32)
    first = np.arange(0, n, lane)
    count, other = np.zeros(len(first), np.int64), np.full(len(first), -2)
    for step in range(lane):
        here = first + step
        here = here[here < n]
        count, last, other = np.maximum(count[: len(here)] - 1, 0), other[: len(here)], before[here]
        count[(other < 0) | ((count >= most - 1) & (other != last + 1))] = 0
        at = np.flatnonzero((other >= 0) & (count < most))
        while len(at):
            differ = wide[here[at] + count[at]] ^ wide[other[at] + count[at]]
            same = np.zeros(len(at), np.int64)
            for k in range(8):
                same += differ < np.uint64(1 << (8 * k)) if k else differ == 0
            count[at] += same
            at = at[(same == 8) & (count[at] < most)]
        np.minimum(count, most, out=count)
        shared[here] = count
    return shared[order]


def by_order(docs: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Documents by doc_id, null last, then by a hash of the text and the text; and their ids with null as the greatest."""
    keys = [(k, "ascending") for k in ("doc_id", "tie", "text")]
    docs = docs.take(pc.sort_indices(docs, sort_keys=keys)).combine_chunks()
    return docs, pc.fill_null(docs.column("doc_id"), LAST).to_numpy()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


#: Rows of repeats (bucket null: shard, row, lo, hi) and sorted lists of windows: for each run of windows of one anchor the
#: anchor, first and last window, document (row in shard, id, tie) and the anchor's place in the first window; equal windows
#: have their anchor at the same place, and ranks order the windows of an anchor and place, `wide` bytes each. bytes are packed.
LISTS = "shard int, bucket int, part int, lo binary, hi binary, row binary, anchors binary, inside binary, ids binary, ties binary, shards binary, ranks binary, wide int, size int, bytes binary"
PACKER = pa.Codec("zstd", 1)
_KINDS = {"int": pa.int32(), "binary": pa.binary()}
_FIELDS = [(x.split()[0], _KINDS[x.split()[1]]) for x in LISTS.split(", ")]


def _lists(rows: list[dict]) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], kind) for n, kind in _FIELDS})


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: each item's group and its place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def _ranked(ranks: np.ndarray) -> dict:
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if not len(ranks) or ranks.max() <= np.iinfo(k).max)
    return {"ranks": ranks.astype(kind).tobytes(), "wide": np.dtype(kind).itemsize}


def _dense(anchor: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Each item's place among the different values of its anchor."""
    order = np.lexsort((value, anchor))
    a, v = anchor[order], value[order]
    head = np.r_[True, a[1:] != a[:-1]]
    step = np.cumsum(head | np.r_[True, v[1:] != v[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = step - np.maximum.accumulate(np.where(head, step, 0))
    return out


def _shard(docs: pa.Table, found: pa.Table, n_buckets: int, length: int, gram: int, fan: int) -> pa.Table:
    """Of a shard: a row with the windows that repeat in it, and by bucket its sorted first windows of anchors that are elsewhere too."""
    rows: list[dict] = []
    if not docs.num_rows or not found.num_rows:
        return _lists(rows)
    shard = docs.column("shard")[0].as_py()
    docs, ids = by_order(docs)
    ties = docs.column("tie").to_numpy()
    data, offsets = buffers(_one(docs.column("text")))
    lists = [np.frombuffer(x, np.uint64) for x in found.column("hashes").to_pylist()]
    known = np.concatenate(lists)
    known_spread = np.repeat(found.column("spread").to_numpy(zero_copy_only=False), [len(x) for x in lists])
    order = np.argsort(known)
    known, known_spread = known[order], known_spread[order]
    parts = []
    for h, lo, hi, row, inside in run_anchors(data, offsets, length, gram):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        parts.append((h[hit], lo[hit], hi[hit], row[hit], known_spread[at[hit]], inside[hit]))
    if not parts or not sum(len(p[0]) for p in parts):
        return _lists(rows)
    h, lo, hi, row, elsewhere, inside = (np.concatenate(x) for x in zip(*parts, strict=True))

    # copy out the text of these windows; neighbours in one document share their bytes
    joined = np.r_[False, (lo[1:] <= hi[:-1] + length) & (row[1:] == row[:-1])]
    first = np.flatnonzero(~joined)
    begin, stop = lo[first], np.r_[hi[first[1:] - 1], hi[-1]] + length
    at = np.r_[0, np.cumsum(stop - begin)]
    local = lo + (at[:-1] - begin)[np.cumsum(~joined) - 1]  # where an anchor's first window lies in the copy
    n_windows = hi - lo + 1
    copy = np.concatenate([data[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
    each, within = spread(n_windows)
    here = local[each] + within
    window = np.zeros(len(copy), bool)
    window[here] = True

    order, word = suffix_array(copy, length)
    new = common_prefixes(word, order, length) < length
    if len(new):
        new[0] = True
    group = np.cumsum(new) - 1
    keep = window[order]
    order, group = order[keep], group[keep]
    class_of = np.zeros(len(copy), np.int64)  # numbers of classes are in the array's order
    class_of[order] = group
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    is_first = np.zeros(len(copy), bool)
    is_first[np.minimum.reduceat(order, starts)] = True

    again = window & ~is_first
    # runs of windows that repeat in the shard, as places in data
    back = np.zeros(len(copy), np.int64)
    back[here] = lo[each] + within
    places = back[again]
    if len(places):
        owner = np.searchsorted(offsets, places, "right") - 1
        cut = np.flatnonzero(np.r_[True, (places[1:] != places[:-1] + 1) | (owner[1:] != owner[:-1])])
        a, b, own = places[cut], places[np.r_[cut[1:] - 1, len(places) - 1]], owner[cut]
        rows.append({"shard": shard, "lo": (a - offsets[own]).tobytes(), "hi": (b - offsets[own]).tobytes(), "row": own.tobytes()})

    # first windows of anchors that other shards have too, as runs without gaps
    go = is_first[here] & (elsewhere > 0)[each]
    if go.any():
        e, w = each[go], within[go]
        head = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (w[1:] != w[:-1] + 1)])
        run, a, b = e[head], w[head], w[np.r_[head[1:] - 1, len(w) - 1]]
        far = elsewhere[run] > 1
        rows += _runs(
            data, length, h[run], inside[run] - a, lo[run] + a, lo[run] + b, row[run], offsets, ids[row[run]], ties[row[run]], np.full(len(run), shard, np.int32),
            class_of[here[go]], (h[run] % np.uint64(n_buckets)).astype(np.int64), np.where(far, shard // fan, -1),
        )
    return _lists(rows)


def _runs(data, length, anchor, inside, a, b, row, offsets, ids, ties, shards, value, bucket, part) -> list[dict]:  # noqa: ANN001
    """Lists of windows by bucket and part. a, b: first and last window of each run, as places in data; value orders the windows."""
    n = b - a + 1
    turn = np.lexsort((anchor, part, bucket))
    start = np.cumsum(n) - n
    each, within = spread(n[turn])
    value = value[start[turn][each] + within]
    anchor, inside, a, b, row, ids, ties, shards, bucket, part, n = (x[turn] for x in (anchor, inside, a, b, row, ids, ties, shards, bucket, part, n))
    group = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])[each] * length + (inside[each] - within)
    base = offsets[row] if offsets is not None else np.zeros(len(row), np.int64)
    cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]), True])
    ends = np.r_[0, np.cumsum(n)]
    out = []
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = slice(x, y)
        size = (b[own] - a[own] + length).astype(np.int64)
        _, place = spread(size)
        raw = data[np.repeat(a[own], size) + place]
        ranks = _dense(group[ends[x] : ends[y]], value[ends[x] : ends[y]])
        out.append(
            {
                "bucket": int(bucket[x]), "part": int(part[x]), "lo": (a[own] - base[own]).astype(np.int32).tobytes(), "hi": (b[own] - base[own]).astype(np.int32).tobytes(),
                "row": row[own].astype(np.int32).tobytes(), "anchors": anchor[own].tobytes(), "inside": inside[own].astype(np.int16).tobytes(), "ids": ids[own].tobytes(), "ties": ties[own].tobytes(), "shards": shards[own].astype(np.int32).tobytes(),
                "bytes": PACKER.compress(raw, asbytes=True), "size": len(raw), **_ranked(ranks),
            }
        )
    return out


def search(word: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of windows in sorted ones, by their bytes, eight at a time.

    word: the eight bytes from each place, first byte lowest; a, b: places of the windows; those of a are sorted from low
    to high for each window of b. Returns for each of b its place in a, and whether an equal window is there.
    """
    low, high = low.copy(), high.copy()
    equal = np.zeros(len(b), bool)
    alone = [np.flatnonzero(high - low == 1)]  # with one window left: it is compared to its end
    steps = [*range(0, length - 8, 8), length - 8]
    live = np.flatnonzero(high - low > 1)
    for k in steps:
        if not len(live):
            break
        x = word[b[live] + k].byteswap()
        lo, end = low[live], high[live]

        def first(lo: np.ndarray, hi: np.ndarray, beyond: bool, k: int = k, x: np.ndarray = x) -> np.ndarray:
            """The first window that is not less, or greater."""
            lo, hi, open_ = lo.copy(), hi.copy(), np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                v = word[a[mid] + k].byteswap()
                less = v <= x[open_] if beyond else v < x[open_]
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            return lo

        low[live] = start = first(lo, end, False)
        high[live] = stop = first(start, end, True)
        alone.append(live[stop - start == 1])
        live = live[stop - start > 1]
    equal[live] = True
    live = np.concatenate(alone)
    there, mine = a[low[live]], b[live]
    for k in steps:
        v, x = word[there + k], word[mine + k]
        same = v == x
        if not same.all():
            other = ~same
            low[live[other]] += v[other].byteswap() < x[other].byteswap()
            live, there, mine = live[same], there[same], mine[same]
    equal[live] = True
    return low, equal


def _merge(table: pa.Table, length: int, fan: int) -> pa.Table:
    """Of a bucket (and part): windows of which an equal one starts earlier in another list, and for a part what is left as one list.

    Lists are merged in pairs, then the pairs' results, and so on: the windows of one are searched in the other, among
    those of their anchor. Of equal ones the later is a repeat and leaves, so hot passages shrink at each turn.
    """
    unpack = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    anchors = unpack("anchors", np.uint64)
    anchor = np.concatenate(anchors)
    lo, hi, row, shard = (np.concatenate(unpack(x, np.int32)).astype(np.int64) for x in ("lo", "hi", "row", "shards"))
    ids, ties = (np.concatenate(unpack(x, np.int64)) for x in ("ids", "ties"))
    ranks = np.concatenate([np.frombuffer(r, f"u{w}").astype(np.int64) for r, w in zip(table.column("ranks").to_pylist(), table.column("wide").to_pylist(), strict=True)])
    packed = zip(table.column("bytes").to_pylist(), table.column("size").to_pylist(), strict=True)
    data = np.concatenate([np.frombuffer(PACKER.decompress(x, n), np.uint8) for x, n in packed])
    inside = np.concatenate(unpack("inside", np.int16)).astype(np.int64)
    source = np.repeat(np.arange(len(anchors)), [len(x) for x in anchors])
    n_windows = hi - lo + 1
    size = n_windows + length - 1
    run, within = spread(n_windows)
    place = (np.cumsum(size) - size)[run] + within
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    # the order of the corpus: by document and place
    order = np.lexsort((lo, row, shard, ties, ids))
    start = np.empty(len(order), np.int64)
    start[order] = np.cumsum(n_windows[order]) - n_windows[order]
    time = start[run] + within

    names, number = np.unique(anchor, return_inverse=True)
    turn = np.lexsort((source, number))  # the lists of an anchor are numbered from 0
    head = np.r_[True, number[turn][1:] != number[turn][:-1]]
    step = np.cumsum(head | np.r_[True, source[turn][1:] != source[turn][:-1]])
    own = np.empty(len(turn), np.int64)
    own[turn] = step - np.maximum.accumulate(np.where(head, step, 0))
    left = np.zeros(len(names), np.int64)
    np.maximum.at(left, number, own + 1)

    number, own = number[run], own[run]
    group = number * length + inside[run] - within  # an anchor at a place in the window
    w = np.lexsort((ranks, own, group))
    own = own[w]
    repeats = np.zeros(len(run), bool)
    done = []
    while len(w):
        waiting = left[number[w]] > 1
        done.append(w[~waiting])
        w, own = w[waiting], own[waiting]
        if not len(w):
            break
        odd = (own & 1).astype(bool)
        a, b = w[~odd], w[odd]
        pair = lambda at, lists: group[at] << 24 | lists >> 1
        pair_a, pair_b = pair(a, own[~odd]), pair(b, own[odd])
        at, equal = search(word, place[a], place[b], np.searchsorted(pair_a, pair_b, "left"), np.searchsorted(pair_a, pair_b, "right"), length)
        twin = at[equal]
        mine, other = b[equal], a[twin]
        later = time[mine] > time[other]
        repeats[np.where(later, mine, other)] = True
        a[twin] = np.where(later, other, mine)
        rest = ~equal
        turn = np.argsort(np.r_[2 * np.arange(len(a)) + 1, 2 * at[rest]], kind="stable")
        w, own = np.r_[a, b[rest]][turn], (np.r_[own[~odd], own[odd][rest]] >> 1)[turn]
        left = (left + 1) >> 1

    rows = []
    at = np.flatnonzero(repeats)
    if len(at):
        turn = at[np.lexsort((lo[run[at]] + within[at], row[run[at]], shard[run[at]]))]
        s, r, x = shard[run[turn]], row[run[turn]], lo[run[turn]] + within[turn]
        cut = np.flatnonzero(np.r_[True, (x[1:] > x[:-1] + 1) | (r[1:] != r[:-1]) | (s[1:] != s[:-1])])
        a, b, r, s = x[cut], x[np.r_[cut[1:] - 1, len(x) - 1]], r[cut], s[cut]
        cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
        rows += [{"shard": int(s[x]), "lo": a[x:y].tobytes(), "hi": b[x:y].tobytes(), "row": r[x:y].tobytes()} for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    part = table.column("part")[0].as_py()
    if part >= 0:
        place_in_order = np.zeros(len(run), np.int64)
        place_in_order[np.concatenate(done)] = np.arange(sum(map(len, done)))
        go = np.flatnonzero(~repeats)
        e, v = run[go], within[go]
        head = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (v[1:] != v[:-1] + 1)])
        r, a, b = e[head], v[head], v[np.r_[head[1:] - 1, len(v) - 1]]
        base = (np.cumsum(size) - size)[r]
        kept = _runs(data, length, anchor[r], inside[r] - a, base + a, base + b, row[r], None, ids[r], ties[r], shard[r], place_in_order[go], np.full(len(r), table.column("bucket")[0].as_py()), np.full(len(r), part // fan))
        for out in kept:  # places in the texts again, in the order of the list
            turn = np.argsort(anchor[r], kind="stable")
            out |= {"lo": (lo[r] + a)[turn].astype(np.int32).tobytes(), "hi": (lo[r] + b)[turn].astype(np.int32).tobytes()}
        rows += kept
    return _lists(rows)


def _cut(docs: pa.Table, found: pa.Table, length: int, schema: pa.Schema, whole: bool) -> pa.Table:
    """Of a shard: its documents without the bytes of windows that repeat earlier ones."""
    docs, _ = by_order(docs)
    data, offsets = buffers(_one(docs.column("text")))
    base = int(offsets[0])
    edges = np.zeros(int(offsets[-1]) - base + 1, np.int32)
    for lo, hi, row in zip(*(found.column(x).to_pylist() for x in ("lo", "hi", "row")), strict=True):
        lo, hi, row = (np.frombuffer(x, np.int64) for x in (lo, hi, row))
        np.add.at(edges, lo + offsets[row] - base, 1)
        np.add.at(edges, hi + length + offsets[row] - base, -1)
    gone = np.cumsum(edges[:-1]) > 0
    if whole and gone.any():
        # a character of which a byte goes goes whole
        begins = (data[base : int(offsets[-1])] & 0xC0) != 0x80
        begins[(offsets - base)[:-1][np.diff(offsets) > 0]] = True
        character = np.cumsum(begins) - 1
        gone = (np.bincount(character, gone) > 0)[character]
    cuts = (offsets - base).tolist()
    spans, kept = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mask = gone[a:b]
        if mask.any():
            change = np.diff(np.r_[False, mask, False].astype(np.int8))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True)])
            kept.append(data[base + a : base + b][~mask].tobytes())
        else:
            spans.append([])
            kept.append(data[base + a : base + b].tobytes())
    results = {"n_bytes": pa.array(np.diff(offsets), pa.int64()), "spans": pa.array(spans, schema.field("spans").type), "kept": pa.array(kept, pa.binary())}
    return pa.Table.from_arrays([results[f.name] if f.name in results else _one(docs.column(f.name)).cast(f.type) for f in schema], names=schema.names)


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32, whole_characters: bool = False, with_text: bool = True, fan: int = FAN) -> DataFrame:
    """docs (doc_id, text, ...) with n_bytes, spans (array of start, end) and kept (binary).

    spans are the maximal runs of bytes covered by a string of `length` bytes that also starts earlier: in a
    document with a smaller doc_id, or earlier in the same one. kept are the other bytes. Strings are
    judged on the input and never cross documents. whole_characters: a character of which a byte goes goes whole, so kept
    is UTF-8 again. A null text counts as empty; texts shorter than `length` keep everything. A null doc_id is larger
    than any other; rows with equal doc_id are ordered by xxhash64 of the text, then by the text, and of equal rows
    one comes first. Other columns pass, text too if with_text; those named like a result, in any case, are replaced.
    Rows that are equal in doc_id and text meet in one task, all others spread, whatever their id.
    An anchor that more than `fan` shards have is merged in parts of `fan` shards first, then their results, and so on.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    others = other_columns(docs, "n_bytes", "spans", "kept", "doc_id", "text")
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.struct(*others).alias("other") if others else F.lit(None).cast("int").alias("other"))
    total = text_bytes(given)
    n_shards, n_buckets = tasks_for(spark, total, SHARD_BYTES), tasks_for(spark, total, BUCKET_BYTES)
    given = given.withColumns({"tie": F.xxhash64("text"), "shard": F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)).cast("int")})

    gathered = given.select("shard", "text").mapInArrow(partial(_gather, n_buckets=n_buckets, n_shards=n_shards, length=length, gram=gram), "bucket int, shards binary, sizes binary, hashes binary")
    some = given.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(SAMPLED)) == 0).select("text")
    loads = some.mapInArrow(partial(_loads, n_buckets=n_buckets, length=length, gram=gram), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    heavy = saved(loads.select("bucket", F.ceil(F.col("n") * SAMPLED / MOST_ANCHORS).cast("int").alias("slices")).where("slices > 1"), "heavy")
    repeated = "shard int, spread int, hashes binary"
    if heavy.take(1):
        # buckets of hot anchors are thinned by shard first; which buckets those are changes the way, not the result
        sliced = gathered.join(heavy, "bucket", "left").select("bucket", "slices", "shards", "sizes", "hashes")
        hot = sliced.where("slices IS NOT NULL").mapInArrow(_by_slice, SLICED).groupBy("bucket", "slice").applyInArrow(lambda x: _thin(x, fan), "shard int, spread int, bucket int, shards binary, sizes binary, hashes binary")
        hot = saved(hot, "thin")
        gathered = sliced.where("slices IS NULL").select("bucket", "shards", "sizes", "hashes").unionByName(hot.where("bucket IS NOT NULL").select("bucket", "shards", "sizes", "hashes"))
        again = dealt(gathered, n_buckets, "bucket").groupBy("bucket").applyInArrow(lambda x: _repeated(x, fan), repeated).unionByName(hot.where("bucket IS NULL").select("shard", "spread", "hashes"))
    else:
        again = dealt(gathered, n_buckets, "bucket").groupBy("bucket").applyInArrow(lambda x: _repeated(x, fan), repeated)
    found = saved(
        dealt(given.select("shard", "doc_id", "tie", "text"), n_shards, "shard").groupBy("shard").cogroup(dealt(again, n_shards, "shard").groupBy("shard")).applyInArrow(lambda x, y: _shard(x, y, n_buckets, length, gram, fan), LISTS),
        "windows",
    )
    repeats = found.where("bucket IS NULL").select("shard", "lo", "hi", "row")
    lists, n_parts = found.where("bucket IS NOT NULL"), -(-n_shards // fan)
    while True:
        # parts of a bucket go to different partitions
        placed = lists.withColumn("at", F.pmod(F.col("bucket") + (F.col("part") + 1) * 7919, F.lit(n_buckets)).cast("int"))
        merged = dealt(placed, n_buckets, "at").groupBy("at", "bucket", "part").applyInArrow(lambda x: _merge(x, length, fan), LISTS)
        if n_parts == 1:
            repeats = repeats.unionByName(merged.where("bucket IS NULL").select("shard", "lo", "hi", "row"))
            break
        merged = saved(merged, "merged")
        repeats = repeats.unionByName(merged.where("bucket IS NULL").select("shard", "lo", "hi", "row"))
        lists, n_parts = merged.where("bucket IS NOT NULL"), -(-n_parts // fan)
    fields = [f for f in given.schema if f.name in ("doc_id", "other") or (with_text and f.name == "text")]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    result = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    arrow = to_arrow_schema(result)
    out = dealt(given, n_shards, "shard").groupBy("shard").cogroup(dealt(repeats, n_shards, "shard").groupBy("shard")).applyInArrow(lambda x, y: _cut(x, y, length, arrow, whole_characters), result)
    return out.select("doc_id", *(["text"] if with_text else []), *(["other.*"] if others else []), "n_bytes", "spans", "kept")
