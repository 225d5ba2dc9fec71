"""Prefix trie of conversations in balanced parentheses, built by shards.

Every conversation is rebuilt as a sequence of turn digests. Sorted, the sequences of a subtree lie next to each
other, so the sorted rows are cut into range-partitioned shards of bounded size, whatever shares a first turn. A
shard writes its trie as a string of parentheses, in preorder. Over it stand the excess, its smallest and largest
value by block, and block ranges upwards; ``findclose`` walks those to the end of a subtree. Between an open and its
close, the rank of leaf pairs ``()`` counts leaves, and running sums over the preorder give members and bytes.

Nodes on the path of a shard's first or last sequence (its spines) may go on in the neighbours; all others are
final. Spines are few: two paths a shard. How far the last path of one shard and the first of the next agree is found
by a join on the nodes' digests. A node that two shards have counts as new in the later one never, and a childless
node counts as a leaf only in the last shard that has it; after that all figures add up by node in one aggregation.

Members that end at a node are hashed where they lie. Only the first and the last group of a shard can be parts
of a longer one; they leave as pieces of text, which one task per such node digests in order without keeping them.

Defined cases. Null role or text: empty. Null turn: before all others; equal turns: by role, then by digest of the
text. Null conv_id: no conversation, left out. Repeated rows are turns of their own. A conversation left without
turns ends at the root. ``%`` keeps the sign of the dividend. Empty table: empty result. Other columns are ignored. A
conversation is one row of 24 bytes a turn and must fit a task; texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.llm.common import named, parallelism
from pulsetrace.session import materialise


@dataclass(frozen=True)
class Trie:
    #: Conversations c and c - c % group share their start, of crc32(c) % most turns.
    group: int = 5
    most: int = 9
    #: Turns of a shard.
    shard_turns: int = 1 << 19
    #: Positions of a block of the excess, and bytes of a piece of ids.
    block: int = 64
    piece: int = 1 << 18


DIGEST = 16
#: SHA-256 of no members.
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- parentheses


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with range min-max blocks over the excess."""

    def __init__(self, bits: np.ndarray, block: int = 64) -> None:
        self.bits, self.block = bits, block
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        self.opens = np.flatnonzero(bits)
        #: Leaf pairs that begin at or before a position.
        self.leaves = np.cumsum((bits == 1) & (np.append(bits[1:], 1) == 0))
        n = max(1, -(-len(bits) // block))
        padded = np.full(n * block, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.rows = padded.reshape(n, block)
        low = self.rows.min(axis=1)
        high = np.where(self.rows == np.iinfo(np.int64).max, np.iinfo(np.int64).min, self.rows).max(axis=1)
        self.low, self.high = [low], [high]
        while len(self.low[-1]) > 1:  # each range covers two below
            odd = len(self.low[-1]) % 2
            below = np.append(self.low[-1], [np.iinfo(np.int64).max] * odd).reshape(-1, 2)
            above = np.append(self.high[-1], [np.iinfo(np.int64).min] * odd).reshape(-1, 2)
            self.low.append(below.min(axis=1))
            self.high.append(above.max(axis=1))

    def first_in(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place in the block, beyond column ``after``, whose excess is ``target``; -1 for none."""
        hit = (self.rows[block] == target[:, None]) & (np.arange(self.block) > after[:, None])
        return np.where(hit.any(axis=1), block * self.block + hit.argmax(axis=1), -1)

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing place of each opening one: the next where the excess is one lower."""
        out = np.empty(len(opens), np.int64)
        for lo in range(0, len(opens), 8192):
            some = opens[lo: lo + 8192]
            target = self.excess[some] - 1
            found = self.first_in(some // self.block, some % self.block, target)
            for i in np.flatnonzero(found < 0):
                found[i] = self.beyond(int(some[i]) // self.block, int(target[i]))
            out[lo: lo + 8192] = found
        return out

    def beyond(self, at: int, target: int) -> int:
        """The same, from the block after ``at`` on: up over ranges that lie above, then down into the first that holds it."""
        level = 0
        while True:
            if at % 2 == 0 and at + 1 < len(self.low[level]) and self.low[level][at + 1] <= target <= self.high[level][at + 1]:
                at += 1
                break
            at, level = at // 2, level + 1
        while level:
            at, level = 2 * at, level - 1
            if not self.low[level][at] <= target <= self.high[level][at]:
                at += 1
        return int(self.first_in(np.array([at]), np.array([-1]), np.array([target]))[0])


# --- one shard


NODE = pa.schema([
    ("shard", pa.int32()), ("slot", pa.int32()), ("up", pa.int32()), ("left", pa.int32()), ("right", pa.int32()),
    ("key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("heavy", pa.int64()),
    ("light", pa.int64()), ("path", pa.int64()), ("ends_sha256", pa.string()), ("piece", pa.int32()), ("ids", pa.binary())])
#: Columns of ``NODE`` as Spark reads them. ``slot``: number of a spine node, null elsewhere; ``up``: its parent's slot;
#: ``left``, ``right``: lies on the first, last path; ``heavy``, ``light``: bytes of last texts in the subtree, times
#: members and once; ``path``: bytes once from the root down to the node; rows with a ``piece`` carry ids only.
SCHEMA = ("shard int, slot int, up int, left int, right int, key binary, depth long, conv_id long, parent_conv_id long, "
          "n_convs long, n_children long, n_leaves long, heavy long, light long, path long, ends_sha256 string, piece int, ids binary")


def agreement(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    return int((x != y).argmax()) // DIGEST


def chained(sequence: bytes) -> list[bytes]:
    """Digest of each prefix, the empty one first."""
    out = [b"\0" * DIGEST]
    for i in range(0, len(sequence), DIGEST):
        out.append(hashlib.blake2b(out[-1] + sequence[i: i + DIGEST], digest_size=DIGEST).digest())
    return out


def pieces(ids: np.ndarray, size: int) -> Iterator[bytes]:
    """Decimal ids joined by commas, in parts of about ``size`` bytes that join to the whole."""
    step = max(1, size // 20)
    for lo in range(0, len(ids), step):
        text = ",".join(map(str, ids[lo: lo + step].tolist()))
        yield (text if lo == 0 else "," + text).encode()


def shard_rows(shard: int, convs: np.ndarray, sequences: list[bytes], sizes: list[np.ndarray], settings: Trie) -> pa.Table:
    """Nodes of one shard; ``sequences`` are sorted, equal ones by id, and ``sizes`` are the bytes of each turn."""
    bits: list[np.ndarray] = []
    depth_of: list[np.ndarray] = []
    bytes_of: list[np.ndarray] = []
    first_of: list[np.ndarray] = []
    ends: list[int] = []  # preorder number of the node at which each conversation ends
    path: list[int] = []
    n_nodes, last, group_starts = 0, b"", []
    for i, (sequence, size) in enumerate(zip(sequences, sizes)):
        depth = len(sequence) // DIGEST
        if i == 0:
            new, closed = depth + 1, 0
            shared = -1
        else:
            shared = agreement(last, sequence)
            closed, new = len(path) - 1 - shared, depth - shared
        if closed or new or i == 0:
            group_starts.append(i)
            bits.append(np.concatenate([np.zeros(closed, np.uint8), np.ones(new, np.uint8)]))
            depths = np.arange(shared + 1, depth + 1)
            depth_of.append(depths)
            bytes_of.append(np.where(depths == 0, 0, np.append(0, size)[depths]))
            first_of.append(np.full(new, i))
            del path[shared + 1:]
            path.extend(range(n_nodes, n_nodes + new))
            n_nodes += new
        ends.append(path[-1])
        last = sequence
    bits.append(np.zeros(len(path), np.uint8))
    tree = Parentheses(np.concatenate(bits), settings.block)
    depth, weight, first = np.concatenate(depth_of), np.concatenate(bytes_of).astype(np.int64), np.concatenate(first_of)
    close = tree.find_close(tree.opens)
    size = (close - tree.opens + 1) // 2
    stop = np.arange(n_nodes) + size
    run = lambda x: np.concatenate([[0], np.cumsum(x)])
    ending = np.bincount(np.array(ends), minlength=n_nodes)
    members = run(ending)
    members = members[stop] - members[:-1]
    heavy, light = run(members * weight), run(weight)
    heavy, light = heavy[stop] - heavy[:-1], light[stop] - light[:-1]
    leaves = tree.leaves[close] - np.where(tree.opens > 0, tree.leaves[tree.opens - 1], 0)
    parent = parents(depth)
    children = np.bincount(parent[1:], minlength=n_nodes)
    bounds = np.column_stack([first, first + members]).ravel()
    least = np.minimum.reduceat(np.append(convs, np.iinfo(np.int64).max), bounds)[::2]

    keys_left, keys_right = chained(sequences[0]), chained(sequences[-1])
    on_left = np.arange(len(keys_left))
    on_right = np.array(path)  # the last sequence's path
    spine = np.unique(np.concatenate([on_left, on_right]))
    slot = np.full(n_nodes, -1)
    slot[spine] = np.arange(len(spine))
    key: list[bytes | None] = [None] * n_nodes
    down = np.zeros(n_nodes, np.int64)
    for nodes, keys in ((on_left, keys_left), (on_right, keys_right)):
        down[nodes] = np.cumsum(weight[nodes])
        for node, k in zip(nodes.tolist(), keys):
            key[node] = k
    left, right = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
    left[on_left], right[on_right] = 1, 1

    starts = np.array(group_starts)
    stops = np.append(starts[1:], len(convs))
    sha: list[str | None] = [NO_ENDS] * n_nodes
    for node in spine.tolist():
        sha[node] = None
    open_pieces: list[tuple[int, int, bytes]] = []
    for a, b in zip(starts.tolist(), stops.tolist()):
        node = ends[a]
        if a == 0 or b == len(convs):
            open_pieces += [(node, n, part) for n, part in enumerate(pieces(convs[a:b], settings.piece))]
        else:
            digest = hashlib.sha256()
            for part in pieces(convs[a:b], settings.piece):
                digest.update(part)
            sha[node] = digest.hexdigest()

    number = lambda x, kind=pa.int64(), mask=None: pa.array(x, kind, mask=mask)
    inner = slot < 0
    above = slot[np.maximum(parent, 0)]
    no_up = (above < 0) | (parent < 0)
    nodes = pa.table([
        number(np.full(n_nodes, shard), pa.int32()), number(slot, pa.int32(), inner), number(above, pa.int32(), no_up),
        number(left, pa.int32()), number(right, pa.int32()), pa.array(key, pa.binary()), number(depth), number(least),
        number(least[np.maximum(parent, 0)], mask=parent < 0), number(members), number(children), number(leaves),
        number(heavy), number(light), number(down), pa.array(sha, pa.string()), pa.nulls(n_nodes, pa.int32()),
        pa.nulls(n_nodes, pa.binary())], schema=NODE)
    if not open_pieces:
        return nodes
    n = len(open_pieces)
    own = {"shard": pa.array([shard] * n, pa.int32()), "key": pa.array([key[x] for x, _, _ in open_pieces], pa.binary()),
           "piece": pa.array([x for _, x, _ in open_pieces], pa.int32()), "ids": pa.array([x for *_, x in open_pieces], pa.binary())}
    return pa.concat_tables([nodes, pa.table([own.get(f.name, pa.nulls(n, f.type)) for f in NODE], schema=NODE)])


def parents(depth: np.ndarray) -> np.ndarray:
    """Preorder number of each node's parent, -1 for the root: the last node before it that is one less deep."""
    order = np.lexsort((np.arange(len(depth)), depth))
    out = np.full(len(depth), -1)
    bounds = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    for d in range(1, len(bounds) - 1):
        above, mine = order[bounds[d - 1]: bounds[d]], order[bounds[d]: bounds[d + 1]]
        out[mine] = above[np.searchsorted(above, mine) - 1]
    return out


# --- Spark


def rebuilt(conversations: DataFrame, settings: Trie = Trie()) -> DataFrame:
    """conv_id, seq (turn digests end to end) and sizes (bytes of each turn's text) of the rebuilt conversations."""
    role, text = (F.coalesce(named(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.select(
        named("conv_id").cast("long").alias("conv_id"), named("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("mark"),
        F.octet_length(text).cast("long").alias("size")).where("conv_id IS NOT NULL")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "mark", "size")
    own = materialise(slim.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t.mark.alias("mark"), t.size.alias("size"))).alias("turns")))
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(settings.most)).cast("int")
    start = F.col("conv_id") - F.col("conv_id") % settings.group
    # No more than group - 1 conversations ask for one start on either side of zero, and a start is at most ``most`` turns.
    starts = own.where(F.col("conv_id") % settings.group == 0).select(
        F.col("conv_id").alias("start"), F.slice("turns", 1, settings.most).alias("head"))
    both = own.select("conv_id", "turns", shared.alias("h"), start.alias("start")).join(starts, "start", "left")
    head = F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("h"))
    whole = both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t.mark), "")).alias("seq"),
                        F.transform("turns", lambda t: t.size).alias("sizes"))


def shards(sequences: DataFrame, turns: int, settings: Trie) -> DataFrame:
    """Rows of ``SCHEMA`` of all shards; the sort and the build are one stage."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        rows = pa.Table.from_batches(parts) if parts else None
        if rows is None or not rows.num_rows:
            return
        sizes = rows.column("sizes").combine_chunks()
        values, cuts = sizes.flatten().to_numpy(), np.cumsum(np.asarray(pa.compute.list_value_length(sizes)))
        built = shard_rows(TaskContext.get().partitionId(), rows.column("conv_id").to_numpy(), rows.column("seq").to_pylist(),
                           np.split(values, cuts[:-1]), settings)
        yield from built.to_batches(max_chunksize=1 << 16)

    n = max(parallelism(sequences), math.ceil(turns / settings.shard_turns))
    return sequences.repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(run, SCHEMA)


def digests(parts: DataFrame) -> DataFrame:
    """key, sha: SHA-256 of a node's pieces in order of shard and piece; a task streams them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        shard_now = None
        for batch in batches:
            for key, shard, part in zip(*(batch.column(c).to_pylist() for c in ("key", "shard", "ids"))):
                if key != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, shard_now = key, hashlib.sha256(), shard
                elif shard != shard_now:
                    shard_now = shard
                    digest.update(b",")
                digest.update(part)
        if now is not None:
            done.append((now, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())],
                                         names=["key", "sha"])

    sorted_parts = parts.select("key", "shard", "piece", "ids").repartition(parallelism(parts), "key").sortWithinPartitions("key", "shard", "piece")
    return sorted_parts.mapInArrow(run, "key binary, sha string")


def nodes(conversations: DataFrame, settings: Trie = Trie()) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations."""
    sequences = materialise(rebuilt(conversations, settings))
    turns = sequences.agg(F.sum(F.size("sizes"))).first()[0] or 0
    built = materialise(shards(sequences, turns, settings))
    spines = materialise(built.where("slot IS NOT NULL").drop("piece", "ids"))
    order = [r.shard for r in spines.select("shard").distinct().orderBy("shard").collect()]  # one number per shard
    follows = F.broadcast(spines.sparkSession.createDataFrame(list(zip(order, order[1:])), "shard int, next int"))
    ends = spines.where("right = 1").join(follows, "shard")
    agreed = materialise(ends.alias("a").join(spines.where("left = 1").alias("b"), F.expr("a.next = b.shard AND a.key = b.key"))
                         .groupBy(F.col("a.shard").alias("before"), F.col("b.shard").alias("after"))
                         .agg(F.max("a.depth").alias("shared"), F.max("a.path").alias("path")))
    depths = spines.where("right = 1").groupBy("shard").agg(F.max("depth").alias("deepest"))
    known = (spines.join(agreed.select(F.col("after").alias("shard"), F.col("shared").alias("l"), F.col("path").alias("l_path")), "shard", "left")
             .join(agreed.select(F.col("before").alias("shard"), F.col("shared").alias("r")), "shard", "left").join(depths, "shard"))
    # Nodes down to depth l are an earlier shard's; the last path's end is no leaf here where a later shard has it.
    old = F.expr("left = 1 AND depth <= coalesce(l, -1)")
    goes_on = F.expr("right = 1 AND coalesce(r, -1) = deepest")
    above = spines.select("shard", F.col("slot").alias("up"), F.col("path").alias("up_path"))
    added = known.join(above, ["shard", "up"], "left")
    merged = materialise(added.groupBy("key").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - F.expr("int(left = 1 AND depth + 1 <= coalesce(l, -1))")).alias("n_children"),
        F.sum(F.col("n_leaves") - F.when(goes_on, 1).otherwise(0)).alias("n_leaves"),
        F.sum(F.col("heavy") - F.col("light") + F.when(old, F.col("l_path") - F.coalesce("up_path", F.lit(0))).otherwise(0)).alias("saved_tokens"),
        F.max("ends_sha256").alias("sha_here")))
    places = materialise(spines.select("shard", "slot", "up", "key"))
    lowest = materialise(places.join(merged.select("key", F.col("conv_id").alias("least")), "key").select("shard", "slot", "key", "least"))
    up_of = lowest.select("shard", F.col("slot").alias("up"), F.col("least").alias("above"))
    parent = places.join(up_of, ["shard", "up"], "left").groupBy("key").agg(F.min("above").alias("parent_conv_id"))
    hashed = digests(built.where("piece IS NOT NULL"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = merged.join(parent, "key").join(hashed, "key", "left").withColumn(
        "ends_sha256", F.coalesce("sha", "sha_here", F.lit(NO_ENDS))).select(*columns)
    inside = built.where("slot IS NULL AND piece IS NULL").withColumn("saved_tokens", F.col("heavy") - F.col("light"))
    below_spine = inside.where("up IS NOT NULL").drop("parent_conv_id", "key", "slot").join(
        up_of.withColumnRenamed("above", "parent_conv_id"), ["shard", "up"])
    return top.union(inside.where("up IS NULL").select(*columns)).union(below_spine.select(*columns))
