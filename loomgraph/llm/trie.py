"""Prefix trie of conversations, by an external mergesort that carries longest common prefixes.

A conversation is the sequence of its turns. A turn is known by 128 bits of the
SHA-256 of its place, role and text, so turns compare in constant time however
long their texts are. Sequences are cut into *blocks* of ``BLOCK`` turns, each with
the key of what stands before it: sums of its turns' hashes, which add up over any
split, so a conversation of any length is spread over tasks. What shares a key
stands below the same node.

*Runs*: tasks sort pieces of bounded size and write them, each row with the
length of the prefix that it shares with the row before it, in turns. *Merge*: the
runs are dealt to ranges of the order and merged there by a loser tree, whose
players meet on the lengths first and compare turns only behind a shared prefix of
equal length. *Emission*: the merged stream keeps a stack of the nodes on the path
of the last row; a node that the next row leaves is finished. Nodes that a range
can't finish alone, those on the paths of its first and last row and at the borders
of blocks, are *open*: each range says what it knows of them, which adds up by key.
Sums over subtrees of open nodes take the logarithm of their depth in joins.

Equal sequences are told apart by conversation, so a group of copies is spread
over ranges too. Their ids are hashed in order from bounded pieces, not from a list.

Defined cases: ids divide as in SQL, towards zero; turns of one number are ordered by their hash, repeated rows are
turns of their own; a null role or text is empty; rows without a conversation's id
are left out; an empty table has no nodes; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked, running
from ..operators.skew import frequent, salted_join
from ..session import materialise
from .memory import tidy

#: Turns of a block, bytes of a turn's hash.
BLOCK, WIDTH = 16, 16
#: Rows of a run, and of a range of the merge.
RUN, RANGE = 20_000, 100_000
#: Ids in a piece of the list of a node's ends.
PIECE = 2_000
ROOT = bytes(WIDTH)

RUNS = "run long, seq long, path binary, conv long, block int, ends boolean, bytes array<long>, shared int"
OUT = "kind int, key binary, parent binary, depth long, conv long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, n_bytes long, first_end long, ends string"


# Turns ----------------------------------------------------------------------------------------


def _part(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def own_turns(table: DataFrame) -> DataFrame:
    """conv, turn, hash (hexadecimal, of role and text), n_bytes of every turn."""
    role = F.encode(_part("role"), "UTF-8")
    whole = F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b"|"), role, F.encode(_part("text"), "UTF-8"))
    slim = table.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", "role", "text")
    return slim.select("conv", "turn", F.sha2(whole, 256).alias("hash"), F.octet_length(_part("text")).cast("bigint").alias("n_bytes"))


def fork(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, place (from 1), hash, n_bytes of the turns of each rebuilt conversation; and conv, n of all conversations.

    A conversation gets at most eight turns of another, and gives them to at most four.
    """
    spark = turns.sparkSession
    own = materialise(spark, ranked(turns, ["turn", "hash"], ["conv"], "place"), "turns")
    sizes = own.groupBy("conv").agg(F.count("*").alias("had"))
    base = sizes.select(F.col("conv").alias("base"), F.col("had").alias("base_had"))
    convs = sizes.withColumn("h", fork(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % 5).join(base, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_had", F.lit(0))))
    convs = materialise(spark, convs.withColumn("n", F.col("taken") + F.greatest(F.col("had") - F.col("h"), F.lit(0))), "convs")
    first = own.where((F.col("conv") % 5 == 0) & (F.col("place") <= 8)).withColumnRenamed("conv", "base")
    taken = convs.where("taken > 0").select("conv", "base", "taken").join(first, "base").where("place <= taken").select("conv", "place", "hash", "n_bytes")
    hot = frequent(sizes, "conv", "had", own.count())
    kept = salted_join(own, convs.select("conv", "h", "taken"), ["conv"], hot, ["place"]).where("place > h")
    kept = kept.select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "hash", "n_bytes")
    return taken.unionByName(kept), convs.select("conv", "n")


# Blocks ---------------------------------------------------------------------------------------


def _word(token: Column, k: int) -> Column:
    return F.conv(F.substring(token, 8 * k + 1, 8), 16, 10).cast("bigint")


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """path (the key before the block and its turns' hashes), conv, block, ends (whether the conversation ends in it), bytes of the turns.

    A group is a block, so it has at most ``BLOCK`` rows.
    """
    token = F.substring(F.sha2(F.concat_ws("|", F.col("place").cast("string"), "hash").cast("binary"), 256), 1, 2 * WIDTH)
    rows = turns.select("conv", "place", F.floor((F.col("place") - 1) / BLOCK).cast("int").alias("block"), token.alias("token"), "n_bytes")
    words = [F.sum(_word(F.col("token"), k)).alias(f"w{k}") for k in range(4)]
    per = rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("place", "token", "n_bytes"))).alias("t"), *words)
    per = per.select("conv", "block", F.array_join(F.col("t.token"), "").alias("tokens"), F.col("t.n_bytes").alias("bytes"), "w0", "w1", "w2", "w3")
    per = materialise(turns.sparkSession, per, "blocks")
    # what stands before a block: only conversations of several blocks need it
    several = per.join(convs.where(f"n > {BLOCK}").select("conv"), "conv", "left_semi").select("conv", "block", "w0", "w1", "w2", "w3")
    upto = running(several, ["block"], {f"s{k}": F.col(f"w{k}") for k in range(4)}, ["conv"])
    before = F.concat(*[F.lpad(F.hex((F.col(f"s{k}") - F.col(f"w{k}")) % (1 << 32)), 8, "0") for k in range(4)])
    later = upto.where("block > 0").select("conv", "block", before.alias("before"))
    full = per.select("conv", "block", "tokens", "bytes").join(later, ["conv", "block"], "left")
    last = full.join(convs.select("conv", "n"), "conv").withColumn("ends", (F.col("block") + 1) * BLOCK >= F.col("n")).drop("n")
    # a conversation without turns is a block without turns
    bare = convs.where("n = 0").select("conv", F.lit(0).alias("block"), F.lit("").alias("tokens"), F.array().cast("array<bigint>").alias("bytes"), F.lit(None).cast("string").alias("before"), F.lit(True).alias("ends"))
    every = last.select(bare.columns).unionByName(bare)
    path = F.unhex(F.concat(F.coalesce("before", F.lit("0" * 2 * WIDTH)), "tokens"))
    return every.select(path.alias("path"), "conv", "block", "ends", "bytes")


# Runs -----------------------------------------------------------------------------------------


def shared_from(a: bytes, b: bytes, at: int) -> int:
    """How many hashes two paths share, of which ``at`` are known to be."""
    most = min(len(a), len(b)) // WIDTH
    while at < most and a[at * WIDTH : (at + 1) * WIDTH] == b[at * WIDTH : (at + 1) * WIDTH]:
        at += 1
    return at


def runs(rows: DataFrame) -> DataFrame:
    """Sorted runs of bounded size; shared: the hashes a row has in common with the row before it."""

    def make(batches):
        task, made, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def written():
            t = pa.Table.from_batches(held)
            path, conv = t.column("path").to_pylist(), t.column("conv").to_pylist()
            order = sorted(range(len(path)), key=lambda k: (path[k], conv[k]))
            shared = [0] + [shared_from(path[a], path[b], 0) for a, b in zip(order, order[1:])]
            t = t.take(pa.array(order)).combine_chunks()
            n, (b,) = len(order), t.to_batches()
            own = {"run": pa.array(np.full(n, (task << 20) + made)), "seq": pa.array(np.arange(n))} | {c: b.column(c) for c in ("path", "conv", "block", "ends", "bytes")}
            return pa.RecordBatch.from_arrays([*own.values(), pa.array(shared, pa.int32())], names=[*own, "shared"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= RUN:
                yield written()
                held, rows, made = [], 0, made + 1
        if rows:
            yield written()

    return rows.mapInArrow(tidy(make), RUNS)


# Merge ----------------------------------------------------------------------------------------


class Player:
    """A run in the loser tree: its next row, and how much of it the last winner shares."""

    __slots__ = ("rows", "path", "conv", "block", "ends", "bytes", "shared")

    def __init__(self, rows: Iterator[tuple]):
        self.rows = rows
        self.path: bytes | None = None
        self.shared = 0
        self.next()

    def next(self) -> None:
        row = next(self.rows, None)
        if row is None:
            self.path = None
        else:
            self.path, self.conv, self.block, self.ends, self.bytes, self.shared = row

    def beats(self, other: Player) -> bool:
        """Who comes first. Both know what they share with the last winner: who shares more does; the loser keeps what it shares with the winner of this game."""
        if self.path is None or other.path is None:
            return other.path is None
        if self.shared != other.shared:
            return self.shared > other.shared
        at = shared_from(self.path, other.path, self.shared)
        cut = slice(at * WIDTH, (at + 1) * WIDTH)
        mine, its = self.path[cut], other.path[cut]
        won = (self.conv <= other.conv) if mine == its else mine < its
        (other if won else self).shared = at
        return won


def merged(sources: list[Iterator[tuple]]) -> Iterator[Player]:
    """The winner of each round; it is read before the next round. Its ``shared`` is what it has in common with the winner before it."""
    players = [Player(s) for s in sources]
    k = 1 << max(0, len(players) - 1).bit_length()
    players += [Player(iter(())) for _ in range(k - len(players))]
    losers: list[Player] = [None] * k  # type: ignore[list-item]
    for p in players:
        p.shared = 0
    # the first round, from the leaves up
    level = players
    size = k
    while size > 1:
        size //= 2
        winners = []
        for j in range(size):
            a, b = level[2 * j], level[2 * j + 1]
            won = a if a.beats(b) else b
            losers[size + j] = b if won is a else a
            winners.append(won)
        level = winners
    best, seat = level[0], {id(p): j for j, p in enumerate(players)}
    while best.path is not None:
        yield best
        at = (seat[id(best)] + k) // 2
        best.next()
        while at:
            if not best.beats(losers[at]):
                best, losers[at] = losers[at], best
            at //= 2


# Emission -------------------------------------------------------------------------------------


class Node:
    __slots__ = ("key", "depth", "n_bytes", "conv", "n_convs", "n_children", "n_leaves", "saved", "ends", "open", "children")

    def __init__(self, key: bytes, depth: int, n_bytes: int, open_: bool):
        self.key, self.depth, self.n_bytes, self.open = key, depth, n_bytes, open_
        self.conv: int | None = None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.ends: list[int] = []
        self.children: list[tuple] = []


def finished_nodes(stream: Iterator[Player]) -> Iterator[tuple]:
    """Rows of ``OUT``: 0 a finished node (parent_conv is null below an open one), 1 what is known of an open node, 2 a piece of its ends."""
    stack: list[Node] = []
    out: list[tuple] = []

    def close() -> None:
        n = stack.pop()
        out.extend((*c[:5], None if n.open else n.conv, *c[6:]) for c in n.children)  # their parent's smallest member is known now
        parent = stack[-1] if stack else None
        if n.open:
            out.append((1, n.key, parent.key if parent else None, n.depth, n.conv, None, n.n_convs, n.n_children, n.n_leaves, n.saved, n.n_bytes, None, None))
            for k in range(0, len(n.ends), PIECE):
                out.append((2, n.key, None, n.depth, None, None, 0, 0, 0, 0, 0, n.ends[k], ",".join(map(str, n.ends[k : k + PIECE]))))
            return
        n.n_leaves += n.n_children == 0
        n.saved += (n.n_convs - 1) * n.n_bytes
        parent.n_children += 1
        parent.n_leaves += n.n_leaves
        parent.saved += n.saved
        ends = hashlib.sha256(",".join(map(str, n.ends)).encode()).hexdigest()
        parent.children.append((0, n.key, parent.key, n.depth, n.conv, None, n.n_convs, n.n_children, n.n_leaves, n.saved, n.n_bytes, None, ends))
        if parent.open and len(parent.children) >= RUN:
            out.extend(parent.children)
            parent.children = []

    first = True
    for row in stream:
        while len(stack) > row.shared:
            close()
        path = row.path
        for j in range(len(stack), len(path) // WIDTH):
            token = path[j * WIDTH : (j + 1) * WIDTH]
            if j == 0:  # the node that the block stands below
                stack.append(Node(token, row.block * BLOCK, 0, True))
            else:
                key = (np.frombuffer(stack[-1].key, ">u4") + np.frombuffer(token, ">u4")).astype(">u4")  # modulo 2 ** 32
                stack.append(Node(key.tobytes(), row.block * BLOCK + j, row.bytes[j - 1], first))
        for k, n in enumerate(stack):
            n.n_convs += k > 0 or row.block == 0  # elsewhere the block above counts the members of its border
            n.conv = row.conv if n.conv is None else min(n.conv, row.conv)
            n.open |= not row.ends
        if row.ends:
            stack[-1].ends.append(row.conv)
        first = False
        if len(out) >= RUN:
            yield from out
            out.clear()
    for n in stack:
        n.open = True
    while stack:
        close()
    yield from out


def slices(table: pa.Table) -> list[Iterator[tuple]]:
    """The rows of each run, in its order; a row whose predecessor lies in another range shares nothing that is known."""
    t = table.sort_by([("run", "ascending"), ("seq", "ascending")])
    run, seq = (t.column(c).to_numpy() for c in ("run", "seq"))
    known = np.zeros(len(run), bool)
    known[1:] = (run[1:] == run[:-1]) & (seq[1:] == seq[:-1] + 1)
    shared = np.where(known, t.column("shared").to_numpy(), 0).tolist()
    rows = list(zip(*[t.column(c).to_pylist() for c in ("path", "conv", "block", "ends", "bytes")], shared, strict=True))
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])).tolist()
    return [iter(rows[a:b]) for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]


def merge_ranges(written: DataFrame) -> DataFrame:
    """``OUT`` rows of each range of the order; a range holds a bounded number of rows."""
    spark = written.sparkSession

    def merge(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = []
        for row in finished_nodes(merged(slices(pa.Table.from_batches(held)))):
            rows.append(row)
            if len(rows) >= RUN:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // RANGE))
    return written.repartitionByRange(n, "path", "conv").mapInArrow(tidy(merge), OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    i, l, b, s = pa.int32(), pa.int64(), pa.binary(), pa.string()
    kinds = dict(zip(("kind", "key", "parent", "depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "n_bytes", "first_end", "ends"), (i, b, b, l, l, l, l, l, l, l, l, l, s), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


# Open nodes -----------------------------------------------------------------------------------


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes: key, parent, n_leaves, saved; returns key and the sums over each subtree.

    Round k adds what lies 2 ** k to 2 ** (k + 1) levels below, so there are as many rounds as the depth has bits.
    """
    spark = nodes.sparkSession
    now = materialise(spark, nodes.select("key", F.col("parent").alias("up"), "n_leaves", "saved"), "open")
    while now.where("up IS NOT NULL").take(1):
        add = now.where("up IS NOT NULL").groupBy("up").agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("up", "key")
        above = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        more = now.join(add, "key", "left").select("key", "up", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        now = materialise(spark, more.join(above, "up", "left").select("key", F.col("next").alias("up"), "n_leaves", "saved"), "open")
    return now.select("key", F.col("n_leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))


def hashed_ends(pieces: DataFrame) -> DataFrame:
    """key, ends_sha256 of the pieces of each node in order; they pass through the hash one by one."""

    def run(batches):
        key, digest, rows = None, None, []
        for b in batches:
            for k, ends in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    if digest:
                        rows.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "ends_sha256"])
                rows = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    own = pieces.select("key", "first_end", "ends").repartition("key").sortWithinPartitions("key", "first_end")
    return own.mapInArrow(tidy(run), "key binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the conversations ``convs`` (conv, n) with ``turns`` (conv, place from 1, hash, n_bytes).

    Returns conv_id (the smallest member) and depth, which name a node, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    spark = turns.sparkSession
    written = materialise(spark, runs(blocks(turns, convs)), "runs")
    found = materialise(spark, merge_ranges(written), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    part = found.where("kind = 1").groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.max("n_bytes").alias("n_bytes"), *sums)
    part = materialise(spark, part, "open")
    below = part.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    whole = part.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    whole = whole.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("n_bytes"))
    whole = materialise(spark, whole.drop("more"), "open")
    known = whole.select("key", "parent", "conv", "depth", "n_convs", "n_children").join(subtree_sums(whole), "key").join(hashed_ends(found.where("kind = 2")), "key", "left")
    ids = whole.select(F.col("key").alias("parent"), F.col("conv").alias("open_conv"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    result = lambda df, conv, leaves, saved, ends: df.select(F.col("conv").alias("conv_id"), "depth", conv.alias("parent_conv_id"), "n_convs", "n_children", F.col(leaves).alias("n_leaves"), F.col(saved).alias("saved_tokens"), ends.alias("ends_sha256"))
    opened = result(known.join(ids, "parent", "left"), F.col("open_conv"), "all_leaves", "all_saved", F.coalesce("ends_sha256", none))
    closed = found.where("kind = 0").select("parent", "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends")
    closed = result(closed.join(ids, "parent", "left"), F.coalesce("parent_conv", "open_conv"), "n_leaves", "saved", F.col("ends"))
    return opened.unionByName(closed)


def rebuilt_trie(table: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table conv_id, turn, role, text."""
    return trie(*rebuilt(own_turns(table)))


def plain_trie(table: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = materialise(table.sparkSession, ranked(own_turns(table), ["turn", "hash"], ["conv"], "place"), "turns")
    return trie(turns, turns.groupBy("conv").agg(F.count("*").alias("n")))
