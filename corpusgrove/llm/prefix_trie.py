"""Operator 11: the prefix trie of conversations, its subtree totals by parallel tree contraction.

A node is a distinct sequence of the first d turns (role, text) of a
conversation; the root (d = 0) has no text. Its members are the conversations
that start with that sequence.

1. A turn is the MD5 of its role and text, so whole texts never leave the scan.
   A conversation's prefixes are polynomial hashes modulo 2**61 - 1 under two
   bases. They come from a prefix sum over the rows sorted by conversation and
   turn: each task sums what it holds, and what the tasks before it hold of its
   first conversation (one row per task) is added afterwards. So a conversation
   may spread over any number of tasks.
2. Equal (depth, prefix) is one node, named by its smallest member and depth.
3. Tree contraction (Miller and Reif): a round compresses every maximal chain of
   nodes with one child onto its lower end (pointer doubling over joins) and
   then rakes all leaves into their parents. No node has one child after
   a compress, so each rake takes at least half of the nodes: the rounds are
   logarithmic in the number of leaves, the joins of one compress in its longest
   chain. Rounds are then undone in reverse: a chain node's total is its part
   of the chain plus the total of the chain's lower end.

Turns are ordered by ``turn`` (null first), ties by the MD5. Null role or text
counts as empty. Rows without conv_id belong to no conversation and are left out.
Repeated rows are turns of their own. Columns other than conv_id, turn, role and
text are ignored, whatever their names. An empty table has no node. Very long texts
are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import materialize

P = np.uint64((1 << 61) - 1)
BASES = (1_181_783_497_276_652_981, 2_011_658_903_277_546_203)
#: bytes of a run of ids that is hashed at once
CHUNK = 8192
MAX_ROUNDS = 64


# ------------------------------------------------------------ hashes modulo 2**61 - 1
def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & P) + (x >> np.uint64(61))
    return np.where(x >= P, x - P, x)


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 for a, b below it."""
    low = np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    mid = al * bh + ah * bl
    return _fold(ah * bh * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + al * bl)


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** e modulo 2**61 - 1, by squaring."""
    out = np.ones(len(exponents), np.uint64)
    square, e = np.uint64(base), exponents.astype(np.uint64)
    while len(e) and e.max():
        out = np.where(e & np.uint64(1), _mul(out, np.full(len(out), square)), out)
        square = _mul(np.array([square]), np.array([square]))[0]
        e = e >> np.uint64(1)
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums modulo 2**61 - 1."""
    low = np.uint64((1 << 31) - 1)
    return _fold(_mul(_fold(np.cumsum(x >> np.uint64(31))), np.full(len(x), np.uint64(1 << 31))) + _fold(np.cumsum(x & low)))


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int64))


# ------------------------------------------------------------ ranks and prefixes
def _scan(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(conv_id, ..., k0, k1) with, for each row, its position in its
    conversation from 1 (``pos``), the hashes of the turns before it (q0, q1) and up
    to it (p0, p1), and whether it is the last one (``last``).

    The sort deals rows by (conv_id, order, arrival), so no conversation and no
    run of equal rows is bound to one task. The driver sees two rows per task."""
    names = [c for c in rows.columns]
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    schema = "pid int, " + ", ".join(kept) + ", pos long, q0 long, q1 long, p0 long, p1 long, last boolean"
    dealt = (rows.withColumn("_arrival", F.monotonically_increasing_id())
             .orderBy("conv_id", *[F.col(c).asc_nulls_first() for c in order], "_arrival").drop("_arrival")
             .select(F.spark_partition_id().alias("pid"), *names))

    def run(batches):
        conv, n, sums, held = None, 0, [0, 0], None
        for b in batches:
            if not b.num_rows:
                continue
            c = np.asarray(b.column("conv_id"))
            first = np.empty(len(c), bool)
            first[0], first[1:] = c[0] != conv, c[1:] != c[:-1]
            if held is not None:
                yield closed(held, bool(first[0]))
            seg = np.cumsum(first)  # 0: goes on from the batch before
            starts = np.flatnonzero(first)
            base = np.concatenate([[0], starts])[seg]
            rank = np.arange(len(c)) - base + np.where(seg == 0, n, 0)
            cols = [rank + 1]
            for k in (0, 1):
                x = _fold(np.asarray(b.column(f"k{k}")).astype(np.uint64))
                run_sum = np.concatenate([np.zeros(1, np.uint64), _sums(_mul(x, _powers(BASES[k], rank)))])
                off = np.where(seg == 0, np.uint64(sums[k]), P - run_sum[base])  # minus what other conversations added
                cols += [_fold(run_sum[:-1] + off), _fold(run_sum[1:] + off)]
            conv, n, sums = c[-1], int(rank[-1]) + 1, [int(cols[2][-1]), int(cols[4][-1])]
            last = np.append(first[1:], True)
            held = (b, cols, last)
        if held is not None:
            yield closed(held, True)

    def closed(held, ends):
        b, (pos, q0, p0, q1, p1), last = held
        last[-1] = ends
        return pa.RecordBatch.from_arrays([*b.columns, _long(pos), _long(q0), _long(q1), _long(p0), _long(p1), pa.array(last)],
                                          names=["pid", *names, "pos", "q0", "q1", "p0", "p1", "last"])

    local = materialize(dealt.mapInArrow(run, schema))
    tails = (local.where("last").groupBy("pid").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos", "p0", "p1")).alias("tail"))
             .orderBy("pid").collect())
    before: dict[int, tuple[int, int, int, int]] = {}  # pid: what its first conversation has in the tasks before
    on = {}  # pid: position of a last row there that is none, as the conversation goes on
    carry, prev = None, None
    for r in tails:
        pid, (conv, pos, p0, p1) = r["pid"], r["tail"]
        if carry is not None and r["first"] == carry[0]:
            before[pid] = carry
            on[prev] = carry[0]
        if carry is not None and conv == carry[0]:
            p0, p1 = ((carry[2 + k] + pow(BASES[k], carry[1], int(P)) * p) % int(P) for k, p in ((0, p0), (1, p1)))
            pos += carry[1]
        carry, prev = (conv, pos, p0, p1), pid
    out = local.select(*names, "pos", "q0", "q1", "p0", "p1", "last")
    if not before:
        return out

    def mend(batches):
        for b in batches:
            if not b.num_rows:
                continue
            pid, c, pos = (np.asarray(b.column(x)) for x in ("pid", "conv_id", "pos"))
            got = {x: np.array(b.column(x)) for x in ("pos", "q0", "q1", "p0", "p1", "last")}
            for p in np.unique(pid):
                if int(p) in on:
                    # a task's conversations end where the next begins; its own last one goes on
                    got["last"] &= ~((pid == p) & (c == on[int(p)]))
                if int(p) in before:
                    conv, n, *s = before[int(p)]
                    at = np.flatnonzero((pid == p) & (c == conv))
                    got["pos"][at] += n
                    for k in (0, 1):
                        shift = np.full(len(at), pow(BASES[k], n, int(P)), np.uint64)
                        for x in (f"q{k}", f"p{k}"):
                            got[x][at] = _fold(_mul(got[x][at].astype(np.uint64), shift) + np.uint64(s[k])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], *[pa.array(v) for v in got.values()]], names=[*names, *got])

    return local.mapInArrow(mend, ", ".join(kept) + ", pos long, q0 long, q1 long, p0 long, p1 long, last boolean")


def turn_keys(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, md5, k0, k1, bytes): each turn by the hash of its role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("md5"), F.octet_length(text).cast("long").alias("bytes"))
    half = lambda a: F.conv(F.substring("md5", a, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    return rows.select("conv_id", "turn", "md5", half(1).alias("k0"), half(16).alias("k1"), "bytes")


def ranked_turns(convs: DataFrame) -> DataFrame:
    """turn_keys with each turn's position in its conversation, from 1."""
    return materialize(_scan(materialize(turn_keys(convs)), ["turn", "md5"]).select("conv_id", "pos", "k0", "k1", "bytes"))


def with_shared_heads(turns: DataFrame, base: Callable[[Column], Column], followers: Column, length: Callable[[Column], Column], most: int) -> DataFrame:
    """Conversations rebuilt on a shared head: the first ``length(c)`` (at most
    ``most``) turns of conversation ``base(c)``, then c's own turns after its first
    ``length(c)``. ``followers`` lists the ids that may have ``conv_id`` as their base."""
    convs = turns.where("pos = 1").select("conv_id")
    c = F.col("conv_id")
    heads = (turns.where((F.col("pos") <= most) & (base(c) == c)).withColumn("conv_id", F.explode(followers))
             .where(F.col("pos") <= length(c)).join(convs, "conv_id", "left_semi"))
    return heads.select(*turns.columns).unionByName(turns.where(F.col("pos") > length(c)))


# ------------------------------------------------------------ contraction
_ID, _UP = ["c", "d"], ["pc", "pd"]


def _on(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in names.items()], *more)


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(c, d, values): the sums of the values (long) over each node's subtree.

    ``nodes(c, d, pc, pd, values)`` is a forest: (c, d) names a node, (pc, pd) its
    parent, null for a root. See the module's text, point 3. A state row
    carries what has been raked into the node, and in ``e_`` columns what has been
    compressed away between the node and its present parent."""
    e = [f"e_{v}" for v in values]
    state = materialize(nodes.select(*_ID, *_UP, *values, *[F.lit(0).cast("long").alias(x) for x in e]))
    raked, chains = [], []
    for _ in range(MAX_ROUNDS):
        size = state.where("pc is not null").groupBy(*_UP).agg(F.count(F.lit(1)).alias("n"))
        # no node has been cut off above a root, so a root is kept even with one child
        now = materialize(state.join(_on(size, {"pc": "c", "pd": "d"}, "n"), _ID, "left")
                          .withColumn("n", F.coalesce("n", F.lit(0)))
                          .withColumn("unary", (F.col("n") == 1) & F.col("pc").isNotNull()))
        chain = _chains(now, values, e)
        kept = now.where("not unary")
        if chain is not None:
            chains.append(chain)
            tops = chain.where("top").select(F.col("bc").alias("c"), F.col("bd").alias("d"), F.col("pc").alias("_pc"), F.col("pd").alias("_pd"),
                                             *[(F.col(v) + F.col(x)).alias(f"_{x}") for v, x in zip(values, e)])
            up = F.col("_pc").isNotNull()
            kept = kept.join(tops, _ID, "left").select(
                *_ID, F.when(up, F.col("_pc")).otherwise(F.col("pc")).alias("pc"), F.when(up, F.col("_pd")).otherwise(F.col("pd")).alias("pd"),
                *values, *[F.when(up, F.col(f"_{x}")).otherwise(F.col(x)).alias(x) for x in e], "n")
            kept = materialize(kept)
        leaf = kept.where("n = 0")
        chain_sums = {v: F.sum(F.col(v) + F.col(x)) for v, x in zip(values, e)}
        gain = leaf.where("pc is not null").groupBy(*_UP).agg(*[s.alias(f"_{v}") for v, s in chain_sums.items()])
        raked.append(leaf.select(*_ID, *values))
        state = materialize(kept.where("n > 0").select(*_ID, *_UP, *values, *e)
                            .join(_on(gain, {"pc": "c", "pd": "d"}, *[f"_{v}" for v in values]), _ID, "left")
                            .select(*_ID, *_UP, *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values], *e))
        if chain is None:
            chains.append(None)
        if not state.limit(1).count():
            break
    else:
        raise RuntimeError(f"the tree is not contracted after {MAX_ROUNDS} rounds")
    known = None
    for leaf, chain in zip(reversed(raked), reversed(chains)):
        known = leaf if known is None else known.unionByName(leaf)
        if chain is not None:
            low = known.select(F.col("c").alias("bc"), F.col("d").alias("bd"), *[F.col(v).alias(f"_{v}") for v in values])
            known = materialize(known.unionByName(chain.join(low, ["bc", "bd"]).select(*_ID, *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])))
    return known


def _chains(now: DataFrame, values: list[str], e: list[str]) -> DataFrame | None:
    """Each node with one child, by the lower end of its chain (bc, bd): the sums
    from the node down to above that end, its own parent and ``e_`` columns, and
    whether it is the top of its chain. None if there is none.

    A pointer skips as far as the one it points at does, so the joins are
    logarithmic in the chain's length. Rows that have reached the end leave the loop."""
    unary = now.where("unary")
    child = now.where("pc is not null").select(F.col("pc").alias("c"), F.col("pd").alias("d"), F.col("c").alias("bc"), F.col("d").alias("bd"),
                                               *[F.col(x).alias(f"_{x}") for x in e], F.col("unary").alias("more"))
    above = unary.select(F.col("c").alias("pc"), F.col("d").alias("pd"), F.lit(True).alias("_inner"))
    first = (unary.join(child, _ID).join(above, _UP, "left")
             .select(*_ID, "bc", "bd", *_UP, *[(F.col(v) + F.col(f"_{x}")).alias(v) for v, x in zip(values, e)], *e,
                     F.col("_inner").isNull().alias("top"), "more"))
    live, done = materialize(first), []
    if not live.limit(1).count():
        return None
    active = None  # settled rows of chains that still have others on the way
    for _ in range(MAX_ROUNDS):
        new = live.where("not more")
        done.append(new)
        if not live.where("more").limit(1).count():
            break
        # after k joins the rows 2**(k-1)+1 to 2**k above an end arrive, so an end at which none arrived is done with
        active = new if active is None else materialize(active.unionByName(new).join(new.select("bc", "bd").distinct(), ["bc", "bd"], "left_semi").select(*new.columns))
        at = live.where("more").unionByName(active)
        at = at.select(F.col("c").alias("bc"), F.col("d").alias("bd"), F.col("bc").alias("_bc"), F.col("bd").alias("_bd"),
                       *[F.col(v).alias(f"_{v}") for v in values], F.col("more").alias("_more"))
        live = materialize(live.where("more").join(at, ["bc", "bd"])
                           .select(*_ID, F.col("_bc").alias("bc"), F.col("_bd").alias("bd"), *_UP, *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values],
                                   *e, "top", F.col("_more").alias("more")))
    else:
        raise RuntimeError(f"chains longer than 2**{MAX_ROUNDS}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("more")


# ------------------------------------------------------------ member lists
def _digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """SHA-256 of each key's conv_ids in ascending order, joined by commas.

    A global sort by (key, conv_id) deals one key's ids to several tasks, which
    write them as runs of at most CHUNK bytes. The runs of a key are then hashed
    in order as a stream: no list is ever held whole."""
    dealt = ends.orderBy(*key, "conv_id").select(F.spark_partition_id().cast("long").alias("pid"), *key, "conv_id")
    types = ", ".join(f"{k} long" for k in key)

    def pack(batches):
        seq = 0
        for b in batches:
            if not b.num_rows:
                continue
            k = np.column_stack([np.asarray(b.column(x)) for x in key])
            ids = b.column("conv_id").to_pylist()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            rows = []
            for i, j in zip([0, *cuts], [*cuts, len(ids)]):
                for at in range(i, j, CHUNK // 20):
                    rows.append((at, ",".join(map(str, ids[at:min(j, at + CHUNK // 20)]))))
            at = np.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays([*[pa.array(k[at, x]) for x in range(len(key))], pa.array(np.asarray(b.column("pid"))[at]),
                                              pa.array(np.arange(seq, seq + len(rows))), pa.array([r[1] for r in rows])], names=[*key, "pid", "seq", "ids"])
            seq += len(rows)

    runs = dealt.mapInArrow(pack, types + ", pid long, seq long, ids string").repartition(*key).sortWithinPartitions(*key, "pid", "seq")

    def digest(batches):
        at, state = None, None
        for b in batches:
            keys, out = list(zip(*[b.column(x).to_pylist() for x in key])), []
            for k, ids in zip(keys, b.column("ids").to_pylist()):
                if k != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield batch(out)
        if at is not None:
            yield batch([(*at, state.hexdigest())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in zip(*rows)]], names=[*key, "ends_sha256"])

    return runs.mapInArrow(digest, types + ", ends_sha256 string")


# ------------------------------------------------------------ the operator
def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The trie of conversations ``turns(conv_id, pos, k0, k1, bytes)`` over all of
    ``members(conv_id)``, turnless ones included.

    One row per node: conv_id (smallest member), depth, parent_conv_id (null at the
    root), n_convs (members), n_children, n_leaves (childless nodes of its subtree),
    saved_tokens (summed over its subtree: (n_convs - 1) * bytes of the last text)
    and ends_sha256 (of the members that end there)."""
    rows = materialize(_scan(turns.select("conv_id", "pos", "k0", "k1", "bytes").withColumnRenamed("pos", "at"), ["at"]))
    members = members.select("conv_id")
    key = ["d", "p0", "p1"]
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("c")).where("n_convs > 0")
    root = root.select("c", F.lit(0).cast("long").alias("d"), *[F.lit(0).cast("long").alias(x) for x in ("p0", "p1", "q0", "q1")], "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = (rows.groupBy(F.col("pos").alias("d"), "p0", "p1")
             .agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("q0").alias("q0"), F.max("q1").alias("q1")))
    nodes = materialize(root.unionByName(nodes.select(*root.columns)))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("c").alias("pc"))
    nodes = (nodes.join(parents, ["d", "q0", "q1"], "left")
             .select(*_ID, "pc", F.when(F.col("pc").isNotNull(), F.col("d") - 1).alias("pd"), "p0", "p1", "n_convs", "bytes"))
    nodes = materialize(nodes)
    children = nodes.where("pc is not null").groupBy(*_UP).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(_on(children, {"pc": "c", "pd": "d"}, "n_children"), _ID, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    totals = subtree_sums(nodes.select(*_ID, *_UP, (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                                       ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    turnless = members.join(rows.where("pos = 1").select("conv_id"), "conv_id", "left_anti")
    ends = rows.where("last").select(F.col("pos").alias("d"), "p0", "p1", "conv_id").unionByName(
        turnless.select(*[F.lit(0).cast("long").alias(x) for x in key], "conv_id"))
    digests = _digests(ends, key)
    return (nodes.join(totals, _ID).join(digests, key, "left")
            .select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def conversation_trie(convs: DataFrame) -> DataFrame:
    """The trie of ``convs(conv_id, turn, role, text)`` as they are."""
    turns = ranked_turns(convs)
    return prefix_trie(turns, turns.where("pos = 1").select("conv_id"))


#: turns of the shared head that the query rebuilds conversations on
MOST_SHARED, FAMILY = 8, 5


def rebuilt_trie(convs: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt in families of five: conversation c gets the
    first crc32(c) % 9 turns of conversation c - c % 5, then its own later turns."""
    turns = ranked_turns(convs)
    base = lambda c: c - c % FAMILY
    length = lambda c: F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)
    c = F.col("conv_id")
    near = F.array(*[F.try_add(c, F.lit(k).cast("long")) for k in range(1 - FAMILY, FAMILY)])
    followers = F.filter(near, lambda x: x.isNotNull() & (x - x % FAMILY == c))
    return prefix_trie(with_shared_heads(turns, base, followers, length, MOST_SHARED), turns.where("pos = 1").select("conv_id"))
