"""The trie of conversations that share their first turns, by a mergesort that knows common prefixes.

A turn is a token of 16 bytes (a digest of role and text), a conversation the string of its tokens. Spark deals the strings
by ranges of their order, equal ones by their conversation, so that a hot start or a large group of copies is spread over
many tasks. In a range each piece that arrives is sorted to a run in which every string carries the length of the prefix it
shares with the one before it (LCP). A loser tree merges the runs: of two heads the one with the longer LCP to the last winner is
the smaller, and only equal LCPs need a look at tokens, from there on. A stack of the open path reads the merged stream: an
LCP shorter than the stack closes nodes, which are finished then.

Nodes on a range's first and last path may go on in other ranges; their sums are partial and are added up by node in Spark.
Strings are cut into pieces of `width` tokens. A later piece is sorted, in a later round, below the node
at which the piece before it ended, and only if several conversations go through that node: the rest of any other
conversation is a chain that is written down without sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, tasks_for

#: Bytes of a token, tokens in a piece, strings in a run, bytes of strings in a range, ids in a piece of a list of ends.
TOKEN, WIDTH, RUN, RANGE_BYTES, ENDS = 16, 64, 4096, 4 << 20, 4096
ROOT = bytes(TOKEN)
NODE, PARTIAL, END, NEXT = range(4)
FIELDS = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "chars", "n_more")]
    + [("ends", pa.string()), ("path", pa.list_(pa.binary()))]
)
SCHEMA = "kind int, part int, node binary, parent binary, depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, chars bigint, n_more bigint, ends string, path array<binary>"

#: (string with its context's token in front, conv_id, its turns' code points, the context's conv_id, whether more pieces follow)
Item = tuple[bytes, int, list[int], int, bool]


def common(a: bytes, b: bytes, at: int) -> int:
    """Bytes of the tokens that a and b share at their start, if the first `at` bytes are known to be equal."""
    end = min(len(a), len(b))
    while at < end and a[at : at + TOKEN] == b[at : at + TOKEN]:
        at += TOKEN
    return at


def run_of(items: list[Item]) -> list[tuple[Item, int]]:
    """The items in order, each with the LCP to the one before it; 0 for the first."""
    items.sort(key=lambda x: x[:2])
    return [(x, common(items[k - 1][0], x[0], 0) if k else 0) for k, x in enumerate(items)]


def merged(runs: list[list[tuple[Item, int]]]) -> Iterator[tuple[Item, int]]:
    """All items of the runs in order, each with the LCP to the one before it, by a loser tree."""
    size = 1 << max(0, len(runs) - 1).bit_length()
    rest = [iter(r) for r in runs] + [iter(())] * (size - len(runs))
    heads: list[Item | None] = [None] * size
    lcps = [0] * size

    def advance(k: int) -> None:
        heads[k], lcps[k] = next(rest[k], (None, 0))

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's LCP becomes that to the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (i, j) if b is None else (j, i)
        if lcps[i] != lcps[j]:
            return (i, j) if lcps[i] > lcps[j] else (j, i)
        at = common(a[0], b[0], lcps[i])
        if (a[0][at : at + TOKEN], a[1]) <= (b[0][at : at + TOKEN], b[1]):
            lcps[j] = at
            return i, j
        lcps[i] = at
        return j, i

    for k in range(size):
        advance(k)
    winners, losers = [0] * size + list(range(size)), [0] * size
    for k in range(size - 1, 0, -1):
        winners[k], losers[k] = play(winners[2 * k], winners[2 * k + 1])
    best = winners[1]
    while (item := heads[best]) is not None:
        yield item, lcps[best]
        advance(best)
        at = (best + size) >> 1
        while at:
            best, losers[at] = play(best, losers[at])
            at >>= 1


class Open:
    """A node of the open path. first: it is on the path of the range's first string, so that it may have begun before."""

    __slots__ = ("id", "chars", "first", "conv", "top", "n_convs", "n_children", "n_leaves", "saved", "n_more", "ends", "children")

    def __init__(self, own: bytes, chars: int, first: bool, top: int | None):
        self.id, self.chars, self.first, self.top = own, chars, first, top
        self.conv: int | None = None
        self.n_convs = self.n_children = self.n_leaves = self.saved = self.n_more = 0
        self.ends: list[int] = []
        self.children: list[list] = []

    def take(self, conv: int, n_convs: int) -> None:
        self.conv = conv if self.conv is None else min(conv, self.conv)
        self.n_convs += n_convs


def digest_of(ids: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def finished(stream: Iterable[tuple[Item, int]], part: int, width: int) -> Iterator[list]:
    """Rows of FIELDS: nodes as they close, partial ones on the range's edges with their ends, and conversations that go on below the piece."""
    path: list[Open] = []

    def close(last: bool) -> Iterator[list]:
        node = path.pop()
        above = path[-1] if path else None
        depth, partial, own = len(path), last or node.first, (node.n_convs - 1) * node.chars
        ids = [n.id for n in path] + [node.id]
        if above:
            above.take(node.conv, node.n_convs)
        if not partial:
            node.n_leaves = node.n_leaves or 1
            node.saved += own
        known = node.top if depth == 1 else None
        trail = ids if partial or (depth == width and node.n_more) else None
        row = [PARTIAL if partial else NODE, part, node.id, above.id if above else None, depth, node.conv, known, node.n_convs, node.n_children, node.n_leaves, node.saved, node.chars, node.n_more, None if partial else digest_of(node.ends), trail]
        for child in node.children:
            if child[6] is None and not partial:
                child[6] = node.conv
            yield child
        if partial or not above:
            yield row
        else:
            above.children.append(row)
            above.n_children += 1
            above.n_leaves += node.n_leaves
            above.saved += node.saved
        if partial:
            for at in range(0, len(node.ends), ENDS):
                yield [END, part, node.id, None, at, None, None, *[0] * 6, ",".join(map(str, node.ends[at : at + ENDS])), None]

    begun = False
    for (string, conv, chars, top, more), lcp in stream:
        while len(path) > lcp // TOKEN:
            yield from close(False)
        for at in range(len(path), len(string) // TOKEN):
            token = string[at * TOKEN : (at + 1) * TOKEN]
            own = hashlib.sha256(path[-1].id + token).digest()[:TOKEN] if at else token
            path.append(Open(own, chars[at - 1] if at else 0, not begun, top))
        begun = True
        path[-1].take(conv, 1)
        path[-1].ends.append(conv)
        if more:
            path[-1].n_more += 1
            path[-1].ends.pop()
            yield [NEXT, part, path[-1].id, None, None, conv, None, *[0] * 6, None, None]
    while path:
        yield from close(True)


def _batches(rows: Iterator[list], size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), FIELDS, strict=True)], schema=FIELDS)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), FIELDS, strict=True)], schema=FIELDS)


def _round(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """One round: all nodes of items (string, conv_id, chars, top, more), with their contexts at depth 0, and the conversations that go on."""
    spark = items.sparkSession
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("string") + 16), F.lit(0))).first()[0]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = TaskContext.get().partitionId(), []
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                runs.append(run_of(list(zip(*(c.to_pylist() for c in batch.slice(at, RUN).columns), strict=True))))
        if runs:
            yield from _batches(finished(merged(runs), part, width))

    ranges = items.repartitionByRange(tasks_for(spark, n_bytes, RANGE_BYTES), "string", "conv_id")
    out = saved(ranges.mapInArrow(walk, SCHEMA), "trie")
    parts = out.where(F.col("kind") == PARTIAL)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_more")]
    joints = saved(parts.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "depth", "chars", "path", "parent_conv_id")), F.min("conv_id").alias("conv_id"), *sums), "joints")
    below = joints.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more_children"))
    whole = joints.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more_children", F.lit(0)))
    own = whole.select(F.explode("path").alias("node"), (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    under = own.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = joints.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    done = whole.drop("n_leaves", "saved_tokens", "more_children").join(under, "node").join(above, "parent", "left").join(_digests(out.where(F.col("kind") == END)), "node", "left")
    names = ["node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_more", "ends", "path"]
    done = done.withColumns({"parent_conv_id": F.coalesce("parent_conv_id", "above"), "ends": F.coalesce("ends", F.sha2(F.lit(""), 256))}).select(*names)
    # closed children of partial nodes get their parent's conv_id: by range, so that no parent is hot
    places = parts.select("part", "node").join(joints.select("node", F.col("conv_id").alias("above")), "node").withColumnRenamed("node", "parent")
    closed = out.where(F.col("kind") == NODE)
    known = closed.where("parent_conv_id IS NOT NULL OR parent IS NULL")
    others = closed.where("parent_conv_id IS NULL AND parent IS NOT NULL").join(places, ["part", "parent"]).withColumn("parent_conv_id", F.col("above"))
    nodes = saved(known.select(*names).unionByName(others.select(*names)).unionByName(done), "nodes")
    return nodes, out.where(F.col("kind") == NEXT).select("conv_id", "node")


def _digests(pieces: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of each node's ids in order. A task reads the pieces one after the other and holds one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends"])

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select("node", "ends", "part", "depth").repartition(n, "node").sortWithinPartitions("node", "part", "depth")
    return dealt.select("node", "ends").mapInArrow(run, "node binary, ends string")


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, k, token, chars) of turns (conv_id, turn, role, text): the k-th turn of its conversation, from 1.

    Turns are in order of turn, null first; of equal ones by role, then text. Null roles and texts are empty, rows with a
    null conv_id are left out, repeated rows are turns of their own. A conversation of any length is numbered by
    ranges: those of ranges before are added as one row a range.
    """
    spark = turns.sparkSession
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *(c.alias(n) for n, c in text.items())).where("conv_id IS NOT NULL")
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    sorted_rows = rows.repartitionByRange(tasks_for(spark, n_bytes, 32 << 20), *order).sortWithinPartitions(*order)
    token = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * TOKEN))
    placed = saved(sorted_rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), token.alias("token"), F.length("text").alias("chars")), "turns")
    counts = placed.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    edges = placed.groupBy("part").agg(F.array_distinct(F.array(F.min("conv_id"), F.max("conv_id"))).alias("edges"))
    # a conversation in several ranges is the first or last of each: two rows a range at most
    spans = counts.join(F.broadcast(edges.select("part", F.explode("edges").alias("conv_id"))), ["part", "conv_id"])
    before = spans.select("part", "conv_id", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("part", "conv_id").orderBy("place"))
    numbered = placed.withColumn("own", own).join(F.broadcast(before), ["part", "conv_id"], "left")
    return numbered.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias("k"), "token", "chars")


def shared_starts(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Every conversation of turns (conv_id, k, token, chars) rebuilt; a row with a null k for each conversation as well.

    Conversation c becomes the first h turns of conversation c - c % block (all if fewer, none if absent), then its own after the
    first h; h is the unsigned CRC-32 of c in decimal, modulo most. So some have no turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % block
    convs = turns.select("conv_id").distinct().withColumns({"h": h, "base": base})
    first = turns.where((F.col("conv_id") % block == 0) & (F.col("k") < most)).withColumnRenamed("conv_id", "base")
    starts = convs.join(first, "base").where("k <= h").select("conv_id", "k", "token", "chars")
    sizes = first.groupBy("base").agg(F.max("k").alias("size"))
    missing = convs.join(sizes, "base", "left").select("conv_id", (F.col("h") - F.least("h", F.coalesce("size", F.lit(0)))).alias("missing")).where("missing > 0")
    own = turns.where(F.col("k") > h).join(missing, "conv_id", "left").select("conv_id", (F.col("k") - F.coalesce("missing", F.lit(0))).alias("k"), "token", "chars")
    alone = convs.select("conv_id", F.lit(None).cast("long").alias("k"), F.lit(None).cast("binary").alias("token"), F.lit(None).cast("int").alias("chars"))
    return starts.unionByName(own).unionByName(alone)


def nodes(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of turns (conv_id, k from 1 without gaps, token, chars); rows with a null k name conversations that may have none.

    A row for each different start of a conversation, the empty one (the root, depth 0) included, unless there are no conversations:
    conv_id, its smallest member, names it together with depth; parent_conv_id (null for the root); n_convs, members; n_children;
    n_leaves, childless nodes of its subtree, itself included; saved_tokens, over its subtree each node's members but one times the code
    points of its last turn; ends_sha256, the digest of the conversations that end there, ascending in decimal, joined by commas.
    A task holds a range of about RANGE_BYTES; a round is as many tokens deep as `width`, and there are as many
    as the longest start that several conversations share needs.
    """
    spark = turns.sparkSession
    turns = saved(turns, "rebuilt")
    piece = F.coalesce(F.floor((F.col("k") - 1) / width), F.lit(0))
    one = F.struct("k", F.hex("token").alias("token"), "chars")
    grouped = turns.groupBy("conv_id", piece.alias("piece")).agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), one))).alias("own"))
    tokens = F.unhex(F.array_join(F.transform("own", lambda t: t["token"]), ""))
    pieces = saved(grouped.select("conv_id", "piece", tokens.alias("tokens"), F.transform("own", lambda t: t["chars"]).alias("chars")), "pieces")
    everyone = pieces.agg(F.min("conv_id")).first()[0]
    empty = spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    if everyone is None:
        return empty
    levels: list[DataFrame] = []
    tails: list[DataFrame] = []
    here = pieces.where("piece = 0").select("conv_id", "tokens", "chars").withColumns({"context": F.lit(ROOT), "top": F.lit(everyone).cast("long")})
    while True:
        after = pieces.where(F.col("piece") == len(levels) + 1).select("conv_id", F.lit(True).alias("more"))
        items = here.join(after, "conv_id", "left").select(F.concat("context", "tokens").alias("string"), "conv_id", "chars", "top", F.coalesce("more", F.lit(False)).alias("more"))
        found, going = _round(saved(items, "strings"), width)
        edge = found.where("n_more > 0").select("node", F.col("conv_id").alias("top"), "n_convs")
        going = saved(going.join(edge, "node"), "going")
        tails.append(going.where("n_convs = 1").select("conv_id", F.lit(width * (len(levels) + 1)).alias("start")))
        levels.append(found.withColumn("n_children", F.when((F.col("n_more") > 0) & (F.col("n_convs") == 1), 1).otherwise(F.col("n_children"))))
        shared = going.where("n_convs > 1").select("conv_id", F.col("node").alias("context"), "top")
        if not shared.take(1):
            break
        here = pieces.where(F.col("piece") == len(levels)).select("conv_id", "tokens", "chars").join(shared, "conv_id")
    for k in range(len(levels) - 1, 0, -1):  # what lies below a piece's end belongs to all nodes above it
        below = levels[k].where("depth = 0").select("node", *(F.col(c).alias(f"{c}_below") for c in ("n_children", "n_leaves", "saved_tokens")))
        ends = levels[k - 1].where("n_more > 0").select("node", "path").join(below, "node")
        added = ends.select(F.explode("path").alias("above"), "node", "n_children_below", "n_leaves_below", "saved_tokens_below")
        added = added.groupBy(F.col("above").alias("node")).agg(
            F.sum(F.when(F.col("above") == F.col("node"), F.col("n_children_below")).otherwise(0)).alias("children"), F.sum(F.col("n_leaves_below") - 1).alias("leaves"), F.sum("saved_tokens_below").alias("saved")
        )
        more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        kept = [c for c in levels[k - 1].columns if c not in ("n_children", "n_leaves", "saved_tokens")]
        levels[k - 1] = saved(levels[k - 1].join(added, "node", "left").select(*kept, more("n_children", "children"), more("n_leaves", "leaves"), more("saved_tokens", "saved")), "nodes")
    out = empty
    for k, level in enumerate(levels):
        out = out.unionByName(level.where(f"depth > 0 OR {k} = 0").select("conv_id", (F.col("depth") + k * width).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")))
    sizes = turns.groupBy("conv_id").agg(F.max("k").alias("size"))
    starts = tails[0]
    for tail in tails[1:]:
        starts = starts.unionByName(tail)
    chains = turns.join(starts.join(sizes, "conv_id"), "conv_id").where("k > start")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.sha2(F.when(F.col("k") == F.col("size"), F.col("conv_id").cast("string")).otherwise(""), 256)
    return out.unionByName(
        chains.select("conv_id", F.col("k").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("k") < F.col("size"), one).otherwise(none).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"))
    )


def prefix_trie(turns: DataFrame, rebuild: bool = False, width: int = WIDTH) -> DataFrame:
    """nodes() of turns (conv_id, turn, role, text) in their order, with rebuild of shared_starts()."""
    placed = ordered(turns)
    return nodes(shared_starts(saved(placed, "ordered")) if rebuild else placed, width)
