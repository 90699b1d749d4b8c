"""The prefix trie of conversations by truncation peeling.

A conversation is the path of its turns' digests.  Equal paths become one row
with their members' number, smallest id and digest of ids; rows are sorted by
path over range partitions.  A batch of neighbouring rows is peeled from its
greatest depth: rows that end at a depth join the nodes that survived from
below, equal prefixes (neighbours, as rows are sorted) are one node and are
aggregated, then the last turn is stripped and the rest regrouped.  Nodes off
the batch's first and last path are whole.  Nodes on them may go on in the
neighbouring batch: there are at most two a batch and depth, they are merged by
the digest of their prefix, and what they add to the subtrees above is summed
over their ancestors, which all are such nodes too.  So every node is found and
aggregated in one pass, a prefix that a third of all conversations share is cut over many
tasks, and the number of Spark jobs doesn't depend on the depth.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import WORD, stage

#: Digests of a turn, and of a prefix, in bytes.
DIGEST = 16
#: Ids of members are put in order by ranges of 2 to this power ids before they are joined.
RANGE_BITS = 12
#: The head that query conversations get: of this many neighbouring ids the first one's first turns, fewer than HEADS.
NEIGHBOURS, HEADS = 20, 4


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns array<struct<turn, digest, words>>)`` in the order of turn (null first), then of the digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_heads(convs: DataFrame) -> DataFrame:
    """The query's test cases: the first h turns come from the first of NEIGHBOURS ids, h by the id's CRC-32."""
    own = convs.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % NEIGHBOURS).withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int"))
    heads = convs.filter(F.col("conv_id") % NEIGHBOURS == 0).select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, HEADS - 1).alias("head"))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(heads, "first_id", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def ends(convs: DataFrame) -> DataFrame:
    """Equal paths as one row: ``(path, words, n, first, ids_sha256)`` with the members' number, smallest id and digest of ids.

    Ids are gathered by ranges of ids, at most 2**RANGE_BITS to a row; a path's ranges are then read in order
    into one running digest, so memory doesn't grow with a path's members (a digest can't be split).
    """
    path = F.transform("turns", lambda t: t["digest"])
    rows = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = rows.withColumn("node", F.sha2(F.array_join(F.transform("path", F.hex), ""), 256))
    some = (rows.groupBy("node", F.shiftright("conv_id", RANGE_BITS).alias("range"))
            .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("path").alias("path"), F.first("words").alias("words")))
    some = some.select("node", "range", "path", "words", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"),
                       F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches):
        held = None
        for b in batches:
            node, _, path, words, n, first, ids = (b.column(i) for i in range(7))
            out = []
            for i, (x, n_i, ids_i) in enumerate(zip(node.to_pylist(), n.to_pylist(), ids.to_pylist())):
                if held and held[0] == x:
                    held[5].update(b"," + ids_i.encode())
                    held[3] += n_i
                    continue
                if held:
                    out.append(held)
                held = [x, path[i].as_py(), words[i].as_py(), n_i, first[i].as_py(), hashlib.sha256(ids_i.encode())]
            if out:
                yield _end_batch(out)
        if held:
            yield _end_batch([held])

    return (some.repartition("node").sortWithinPartitions("node", "range")
            .mapInArrow(run, "path array<binary>, words array<int>, n long, first long, ids_sha256 string"))


def _end_batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[1] for r in rows], pa.list_(pa.binary())), pa.array([r[2] for r in rows], pa.list_(pa.int32())),
         pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
         pa.array([r[5].hexdigest() for r in rows], pa.string())], ["path", "words", "n", "first", "ids_sha256"])


NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = ("depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "parent_conv_id long, node binary, parent binary, above array<binary>, words long")
KINDS = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64()]
NAMES = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id", "node", "parent", "above", "words"]


def _prefixes(path: list[bytes]) -> list[bytes]:
    """Digests of all prefixes, the empty one first."""
    h = hashlib.sha256()
    out = [h.digest()[:DIGEST]]
    for d in path:
        h.update(d)
        out.append(h.copy().digest()[:DIGEST])
    return out


def peel(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The nodes of a batch of sorted paths.

    Whole nodes have their result; ``parent`` is null where the parent is whole too.  Nodes on the first or last path
    ("open") have ``node`` and ``above`` (prefix digests), and sums over the whole nodes below them.
    """
    paths, counts = batch.column(0), batch.column(2).to_numpy()
    first_id, sha = batch.column(3).to_numpy(), batch.column(4).to_pylist()
    off = paths.offsets.to_numpy()
    size, off = np.diff(off), off[:-1] - off[0]
    flat = np.frombuffer(b"".join(paths.flatten().to_pylist()) + bytes(DIGEST), np.uint64).reshape(-1, 2)
    words = np.r_[batch.column(1).flatten().to_numpy(), 0].astype(np.int64)
    # turns in common with the row before, with the first row and with the last
    common = np.zeros(len(size), np.int64)
    alive = np.arange(1, len(size))
    for d in range(int(size.max())):
        alive = alive[(size[alive] > d) & (size[alive - 1] > d)]
        alive = alive[(flat[off[alive] + d] == flat[off[alive - 1] + d]).all(axis=1)]
        if not len(alive):
            break
        common[alive] = d + 1
    shared = [np.minimum.accumulate(np.r_[size[0], common[1:]]), np.minimum.accumulate(np.r_[size[-1], common[:0:-1]])[::-1]]
    keys = [_prefixes(paths[i].as_py()) for i in (0, len(size) - 1)]
    common[0] = -1

    columns: list[list] = [[] for _ in NAMES]
    # survivors of the depth below, by row of their smallest path: children, leaves, saved tokens of whole nodes
    row = conv = convs = children = leaves = saved = np.zeros(0, np.int64)
    below: tuple | None = None  # whole children that wait for their parent's conv_id
    for depth in range(int(size.max()), -1, -1):
        ended = np.flatnonzero(size == depth)
        rows = np.r_[row, ended]
        by = np.argsort(rows)
        rows, is_end, z = rows[by], by >= len(row), np.zeros(len(ended), np.int64)
        conv_, convs_, children_, leaves_, saved_ = (np.r_[a, b][by] for a, b in
                                                     ((conv, first_id[ended]), (convs, counts[ended]), (children, z), (leaves, z), (saved, z)))
        new = common[rows] < depth
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        node_row = rows[at]
        conv, convs = np.minimum.reduceat(conv_, at), np.add.reduceat(convs_, at)
        n_children, leaves, saved = np.add.reduceat(children_, at), np.add.reduceat(leaves_, at), np.add.reduceat(saved_, at)
        end_row = np.full(len(at), -1)
        end_row[group[is_end]] = rows[is_end]
        is_open = np.zeros(len(at), bool)
        which = np.zeros(len(at), np.int64)
        for i in (1, 0):
            on = shared[i][node_row] >= depth
            is_open |= on
            which[on] = i
        n_words = words[off[node_row] + depth - 1] if depth else np.zeros(1, np.int64)
        whole = ~is_open
        leaves = leaves + (whole & (n_children == 0))
        saved = saved + np.where(whole, (convs - 1) * n_words, 0)

        if below is not None:  # a survivor stood for each child, in the order of the children
            child, child_group = below, group[~is_end]
            parent_open = is_open[child_group]
            child[7] = [None if o else c for o, c in zip(parent_open.tolist(), conv[child_group].tolist())]
            child[9] = [keys[w][depth] if o else None for o, w in zip(parent_open.tolist(), which[child_group].tolist())]
            for c, values in zip(columns, child):
                c.extend(values)
        n = len(at)
        hexes = [sha[e] if e >= 0 else NO_IDS for e in end_row.tolist()]
        opened = is_open.tolist()
        below = [[depth] * n, conv.tolist(), convs.tolist(), n_children.tolist(), leaves.tolist(), saved.tolist(), hexes, [None] * n,
                 [keys[w][depth] if o else None for o, w in zip(opened, which.tolist())], [None] * n,
                 [keys[w][:depth] if o else None for o, w in zip(opened, which.tolist())], n_words.tolist()]
        row, children = node_row, whole.astype(np.int64)
        # what an open child has below it counts for itself, where it is merged, and for the nodes above
    for c, values in zip(columns, below):
        c.extend(values)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], NAMES)


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``convs(conv_id, turns)`` (see ``conversations``).

    ``depth, conv_id`` (smallest member), ``parent_conv_id`` (null at the root), ``n_convs, n_children``,
    ``n_leaves`` and ``saved_tokens`` over the subtree, ``ends_sha256`` of the members that end there.  No
    conversations give no nodes.
    """
    rows = stage(ends(convs), "paths")
    peeled = stage(rows.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(lambda it: (peel(b) for b in it if b.num_rows), NODE), "nodes")
    whole, parts = peeled.filter("node is null"), peeled.filter("node is not null")
    merged = parts.groupBy("node").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NO_IDS, F.col("ends_sha256"))), F.lit(NO_IDS)).alias("ends_sha256"),
        F.first("above").alias("above"), F.first("words").alias("words"))
    merged = stage(merged.withColumn("parent", F.try_element_at("above", F.lit(-1))), "open-nodes")
    kids = merged.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    adds = merged.select(F.explode(F.concat("above", F.array("node"))).alias("node"), (F.col("n_children") == 0).cast("long").alias("leaf"),
                         ((F.col("n_convs") - 1) * F.col("words")).alias("saves"))
    adds = adds.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("saves").alias("saves"))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    known = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_id"))
    opened = (merged.join(adds, "node").withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("saves"))
              .join(known, "parent", "left").withColumn("parent_conv_id", F.col("parent_id")))
    inner = whole.filter("parent is null").select(*result)
    outer = whole.filter("parent is not null").drop("parent_conv_id").join(known, "parent").withColumn("parent_conv_id", F.col("parent_id")).select(*result)
    return opened.select(*result).unionByName(inner).unionByName(outer)
