"""The prefix tree of conversations: padded matrices of turn ids, sorted and compared column by column, in ranges.

A turn is known by the first 16 bytes of the SHA-256 of its role and text, a conversation by its path, the bytes of its
turns one after the other; equal paths are counted before anything is sorted. Distinct paths are dealt to ranges in their
own order, so a node's conversations are neighbours. A range numbers its turns and fills matrices of 64 turns a row
(-1 where a path has ended; rows that go on fill another one): np.lexsort orders the rows, an OR along the columns of
what differs from the row before marks where nodes start, and np.add.reduceat sums every depth. Each range also gets the
last path before it and the first one after it. A node that these share is emitted in parts, which are added up by key; what
a node sums over its subtree is written as a sum over conversations less one for each node that starts, so parts add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .blocks import batch_of, by_key

WIDTH = 64
KEY = 16
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (key in hex, words) in the order of turn, null first, then role and text; rows without an id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    key = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * KEY)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    placed = rows.select("conv_id", F.struct(F.row_number().over(order).alias("pos"), key.alias("key"), words.alias("words")).alias("t"))
    return placed.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """own (conv_id, turns) with the first h turns taken from conversation c - c % every, if there is one; h = crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads.hint("merge"), "base", "left")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return both.select("conv_id", F.concat(F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h)), rest).alias("turns"))


def _ends(members: DataFrame) -> DataFrame:
    """k and the SHA-256 of its conv_ids, ascending and joined by commas: a stream through sorted rows."""
    schema = pa.schema([("k", pa.string()), ("ends", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            keys, ids = batch.column(0), batch.column(1).to_pylist()
            coded = keys.dictionary_encode()
            codes = coded.indices.to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
            for lo, hi in zip(edge, edge[1:], strict=False):
                key = keys[lo].as_py()
                if key != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest, comma = key, hashlib.sha256(), ""
                digest.update((comma + ",".join(map(str, ids[lo:hi]))).encode())
                comma = ","
            yield batch_of(out, schema)
        if digest is not None:
            yield batch_of([(now, digest.hexdigest())], schema)

    return members.repartition("k").sortWithinPartitions("k", "conv_id").select("k", "conv_id").mapInArrow(run, "k string, ends string")


def _numbered(paths: list[bytes]) -> np.ndarray:
    """A number for every turn of the paths, in the order of the turns' bytes."""
    raw = np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2)
    by = np.lexsort((raw[:, 1], raw[:, 0]))
    new = np.ones(len(by), dtype=np.int64)
    new[1:] = (raw[by[1:]] != raw[by[:-1]]).any(axis=1)
    ids = np.empty(len(by), dtype=np.int64)
    ids[by] = np.cumsum(new) - 1
    return ids


def order_and_shared(ids: np.ndarray, lengths: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their turns, and how many turns each shares with the one before it (0 for the first)."""
    n, start = len(lengths), np.cumsum(lengths) - lengths
    order = np.argsort(lengths > 0, kind="stable")
    shared, group = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    place = np.arange(n)  # of the rows that reach the block, in order
    for lo in range(0, int(lengths.max(initial=0)), width):
        on = lengths[order[place]] > lo
        place, group = place[on], group[on]
        rows = order[place]
        size = np.minimum(lengths[rows] - lo, width)
        matrix = np.full((len(rows), width), -1, dtype=np.int64)
        inside = np.arange(width) < size[:, None]
        matrix[inside] = ids[(start[rows, None] + lo + np.arange(width))[inside]]
        by = np.lexsort((lengths[rows] > lo + width, *matrix.T[::-1], group))
        order[place], matrix, group = rows[by], matrix[by], group[by]
        differs = np.ones((len(by), width), dtype=bool)
        differs[1:] = matrix[1:] != matrix[:-1]
        differs[1:, 0] |= group[1:] != group[:-1]
        changed = np.logical_or.accumulate(differs, axis=1)
        same = np.zeros(len(by), dtype=bool)
        same[1:] = group[1:] == group[:-1]
        shared[place[same]] = lo + (~changed[same]).sum(axis=1)
        group = np.cumsum(changed[:, -1])
    return order, shared


_NODE = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
_NODES = "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _prefix_keys(path: bytes, deepest: int) -> list[bytes]:
    h = hashlib.sha256()
    out = [h.digest()]
    for d in range(deepest):
        h.update(path[KEY * d : KEY * (d + 1)])
        out.append(h.copy().digest())
    return out


def nodes_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Nodes of a range's distinct paths, rows of (side, path, words, copies, smallest conversation, hash of the ids).

    side: -1 and 1 for the paths next to the range, of which only the path counts. Nodes shared with these are kind 2; the
    children of such are kind 1 if they aren't shared themselves, with their parent's key; all others are kind 0.
    """
    lengths = np.array([len(r[1]) // KEY for r in rows], dtype=np.int64)
    order, shared = order_and_shared(_numbered([r[1] for r in rows]), lengths)
    sides = np.array([r[0] for r in rows])[order]
    before, after = sides[0] == -1, sides[-1] == 1
    own = order[int(before) : len(order) - int(after)]
    first_shared = int(shared[1]) if before else -1
    last_shared = int(shared[-1]) if after else -1
    rows, n, length = [rows[i] for i in own], len(own), lengths[own]
    lcp = shared[int(before) : len(order) - int(after)].copy()
    lcp[0] = first_shared
    copies, conv = (np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 4))
    leaf = np.ones(n, dtype=np.int64)
    leaf[:-1] = lcp[1:] != length[:-1]
    leaf[-1] = last_shared != length[-1]
    begin = np.concatenate([[0], np.cumsum(length)])
    words = np.array([w for r in rows for w in r[2]], dtype=np.int64)
    owner = np.repeat(np.arange(n), length)
    depth = np.arange(len(words)) - begin[owner] + 1
    gained = np.concatenate([[0], np.cumsum((copies[owner] - (depth > lcp[owner])) * words)])
    keys_first, keys_last = _prefix_keys(rows[0][1], max(first_shared, 0)), _prefix_keys(rows[-1][1], max(last_shared, 0))
    at, above, out, held = np.arange(n), None, [], 0
    for d in range(int(length.max()) + 1):
        at = at[length[at] >= d]
        new = lcp[at] < d
        new[0] = True
        seg = np.flatnonzero(new)
        top = at[seg]
        n_convs, smallest = np.add.reduceat(copies[at], seg), np.minimum.reduceat(conv[at], seg)
        children = np.add.reduceat(((length[at] > d) & (lcp[at] <= d)).astype(np.int64), seg)
        leaves, saved = np.add.reduceat(leaf[at], seg), np.add.reduceat(gained[begin[at + 1]] - gained[begin[at] + max(d - 1, 0)], seg)
        keys: dict[int, bytes] = {}
        if at[0] == 0 and d <= first_shared:
            keys[0] = keys_first[d]
        if at[-1] == n - 1 and d <= last_shared:
            keys[len(seg) - 1] = keys_last[d]
        parent = np.searchsorted(above[0], top, side="right") - 1 if above else np.zeros(len(seg), dtype=np.int64)
        for i in range(len(seg)):
            p, key, up = int(parent[i]), keys.get(i), None
            if above and p in above[2]:
                up = above[2][p]
            kind = 2 if key is not None else 1 if up is not None else 0
            ends = rows[top[i]][5] if length[top[i]] == d else None
            out.append((kind, key, up, int(smallest[i]), d, int(above[1][p]) if above and up is None else None, int(n_convs[i]), int(children[i]), int(leaves[i]), int(saved[i]), ends))
        held += len(seg)
        if held > 50_000:
            yield batch_of(out, _NODE)
            out, held = [], 0
        above = (top, smallest, keys)
    yield batch_of(out, _NODE)


def nodes(paths: DataFrame, shard_turns: int = 500_000) -> DataFrame:
    """A row for each node of the tree of conversations (conv_id and turns as from turns()): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A conversation's own turns fit into a row; no rows, no tree."""
    spark = paths.sparkSession
    joined = F.array_join(F.transform("turns", lambda t: t["key"]), "")
    members = common.saved(paths.select("conv_id", F.substring(F.sha2(joined, 256), 1, 2 * KEY).alias("k"), F.unhex(joined).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")), "conversations")
    distinct = members.groupBy("k").agg(F.any_value("path").alias("path"), F.any_value("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    known = common.saved(distinct.join(_ends(members.select("k", "conv_id")).hint("merge"), "k"), "paths")
    n_shards = max(1, -(-int(known.agg(F.sum(F.size("words") + 1)).first()[0] or 0) // shard_turns))
    ranged = common.saved(known.repartitionByRange(n_shards, "path").sortWithinPartitions("path").withColumn("shard", F.spark_partition_id().cast("long")), "ranges")
    # a row for each range: its edges go to the ranges next to it
    edges = ranged.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    beside = Window.orderBy("shard")
    edges = edges.select("shard", F.lag("high").over(beside).alias("high"), F.lead("low").over(beside).alias("low"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("words", "array<bigint>"), ("n", "bigint"), ("conv", "bigint"), ("ends", "string"))]
    rows = ranged.select("shard", F.lit(0).alias("side"), "path", "words", "n", "conv", "ends")
    for side, c in ((-1, "high"), (1, "low")):
        rows = rows.unionByName(edges.where(F.col(c).isNotNull()).select("shard", F.lit(side).alias("side"), F.col(c).alias("path"), *none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches):
            yield from nodes_of(group)
        common.trim()

    found = common.saved(rows.repartition("shard").sortWithinPartitions("shard", "path").mapInArrow(run, _NODES), "nodes", "kind")
    numbers = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    whole = common.saved(found.where("kind = 2").groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *(F.sum(c).alias(c) for c in numbers), F.max("ends_sha256").alias("ends_sha256")), "shared-nodes")
    columns = ["conv_id", "depth", "parent_conv_id", *numbers, F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")]
    orphans = found.where("kind = 1").select("parent_key", "conv_id", "depth", *numbers, "ends_sha256").unionByName(whole.drop("key"))
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return found.where("kind = 0").select(*columns).unionByName(orphans.join(parents.hint("merge"), "parent_key", "left").select(*columns))


def prefix_trie(conversations: DataFrame, shard_turns: int = 500_000) -> DataFrame:
    """nodes() of conversations as they are: columns conv_id, turn, role, text; null role and text count as empty, rows
    without a conv_id go, rows that repeat are turns each, other columns are ignored."""
    return nodes(common.saved(turns(conversations), "turns"), shard_turns)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all rebuilt conversations; odd input as in prefix_trie()."""
    return nodes(rebuilt(common.saved(turns(common.load(spark, sf_dir, "conversations")), "turns")))
