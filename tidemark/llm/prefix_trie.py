"""A trie of conversations by chained prefix digests.

Conversations are first rebuilt: a conversation c takes over the first h turns of conversation c - c % 5, with h of its own id, and goes on
with its own turns behind its first h. Turns then are digests of role and text. The digest of a prefix is chained, SHA-256 over the
digest of the prefix before it and the next turn, so equal prefixes and no others share one; every conversation is exploded to
its prefixes, and those of equal (depth, digest) are a node.

No conversation is too long for a task: digests are chained within stretches of ``STRETCH`` turns, and the stretches' own digests are chained
along the conversation, a row for each stretch. A prefix of r turns beyond k whole stretches has the digest H(P(k), C(k, r)), where C is the chain
within the stretch and P(k) the digest of the prefix up to it.

Sums over subtrees: runs of nodes with one child each are one segment first, and segments are exploded to all segments above them, so the
explosion grows with the branchings on a path and not with its depth. A node's sum is its segment's, less what the segment holds above the
node; a prefix sum along a conversation through the node tells that. The ids of conversations that end at a node are hashed as a stream of
sorted stretches of text, so a node at which a third of all conversations end is never a list.

Defined cases: null roles and texts count as empty; rows of one turn number (or without one, which come first) are ordered by role, then by the
digest of role and text; repeated rows are turns each; rows without a conversation id belong to no conversation and are left out; an empty
table has no nodes, not even a root; very long texts are digested whole; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import storage
from tidemark.operators import ordered

#: Turns whose digests are chained by one task, and ids that are one stretch of text.
STRETCH, IDS = 1_024, 8_192
#: Conversations that share a head, and heads' greatest length plus one.
FAMILY, HEADS = 5, 9
EMPTY = bytes(32)


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, pos, digest, size)``: each conversation's turns in order from 1, with a digest of role and text and the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    # the role's length keeps role and text apart
    digest = _sha(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary"))
    rows = conversations.where(F.col(conv_col).isNotNull())
    rows = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return ordered.numbered(rows, ["conv"], ["turn", "role", "digest"], "pos").select("conv", "pos", "digest", "size")


def head_length(conv: Column) -> Column:
    """How many turns a conversation takes over."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv)`` of all conversations, and the turns ``(conv, depth, digest, size)`` that they have once heads are taken over."""
    counts = own.groupBy("conv").agg(F.count("*").alias("n"))
    convs = counts.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("source"), head_length(F.col("conv")).alias("h"))
    there = counts.select(F.col("conv").alias("source"), F.col("n").alias("there"))
    convs = convs.join(there, "source", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = storage.written(convs.select("conv", "source", "h", "taken"), "trie-conversations")
    first = own.where((F.col("pos") < HEADS) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("source"), "pos", "digest", "size")
    heads = convs.join(first, "source").where("pos <= h").select("conv", F.col("pos").alias("depth"), "digest", "size")
    rest = own.join(convs, "conv").where("pos > h").select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "size")
    return convs.select("conv"), heads.unionByName(rest)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(conv, stretch, depth, digest, size)``, sorted, with the chained digest up to each row and the one before it."""
    key, last = None, None
    for batch in batches:
        links, before = [], []
        for conv, stretch, digest in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (conv, stretch) != key:
                key, last = (conv, stretch), None
            before.append(last)
            last = hashlib.sha256((last or EMPTY) + digest).digest()
            links.append(last)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(links, pa.binary()), pa.array(before, pa.binary())], ["conv", "stretch", "depth", "size", "link", "before"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(conv, stretch, link)`` of whole stretches, sorted, to ``(conv, stretch, start)``: the digest of the prefix up to each next stretch."""
    key, last = None, EMPTY
    for batch in batches:
        starts = []
        for conv, link in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if conv != key:
                key, last = conv, EMPTY
            last = hashlib.sha256(last + link).digest()
            starts.append(last)
        following = pa.array([x + 1 for x in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), following, pa.array(starts, pa.binary())], ["conv", "stretch", "start"])


def prefixes(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``(conv, stretch, depth, digest, parent, size)`` of every prefix of the turns ``(conv, depth, digest, size)``; parent is the digest of the prefix before."""
    dealt = rows.select("conv", F.floor((F.col("depth") - 1) / stretch).alias("stretch"), "depth", "digest", "size")
    dealt = dealt.repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", "depth")
    chained = storage.written(dealt.mapInArrow(_chain, "conv long, stretch long, depth long, size long, link binary, before binary"), "trie-chains")
    ends = chained.where(F.col("depth") % stretch == 0).select("conv", "stretch", "link")
    starts = ends.repartition("conv").sortWithinPartitions("conv", "stretch").mapInArrow(_starts, "conv long, stretch long, start binary")
    none = F.lit(EMPTY)
    first = chained.where("stretch = 0").withColumn("start", none)
    later = chained.where("stretch > 0").join(starts, ["conv", "stretch"])
    parent = F.when(F.col("before").isNull(), F.col("start")).otherwise(_sha(F.col("start"), F.col("before")))
    found = first.unionByName(later.select(first.columns))
    return found.select("conv", "stretch", "depth", _sha(F.col("start"), F.col("link")).alias("digest"), parent.alias("parent"), "size")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``(digest, conv)`` to ``(digest, first, ids)``: ids of one node, comma-joined, ``IDS`` at most."""
    key, held = None, []

    def told() -> tuple[bytes, int, str]:
        return key, held[0], ",".join(map(str, held))

    for batch in batches:
        out = []
        for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (digest != key or len(held) >= IDS):
                out.append(told())
                held.clear()
            key = digest
            held.append(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], ["digest", "first", "ids"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(told(), (pa.binary(), pa.int64(), pa.string()))], ["digest", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``(digest, first, ids)`` to ``(digest, ends_sha256)``, one text after the other."""
    key, running = None, None
    for batch in batches:
        out = []
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if digest != key:
                if running is not None:
                    out.append((key, running.hexdigest()))
                key, running = digest, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.string()))], ["digest", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["digest", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """``(digest, ends_sha256)``: SHA-256 of the ids ``conv`` that end at each node ``digest``, ascending and comma-joined.

    Ids are sorted in ranges, joined to texts there, and only the texts of a node meet: a row for each ``IDS`` ids.
    """
    sorted_ids = rows.select("digest", "conv").repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv")
    texts = sorted_ids.mapInArrow(_texts, "digest binary, first long, ids string")
    return texts.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashes, "digest binary, ends_sha256 string")


def _along(rows: DataFrame) -> DataFrame:
    """``rows`` with ``top``, the digest of the segment's first node, and ``path``, the sum of ``own`` from the root on, along each conversation.

    Windows hold a stretch of a conversation; what comes before a stretch is one row for each stretch.
    """
    inside = Window.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    top = F.when(F.col("starts"), F.struct("digest", "depth"))
    rows = rows.withColumn("_top", top).withColumn("_path", F.sum("own").over(inside))
    rows = rows.withColumn("_top", F.when(F.col("_top").isNotNull(), F.struct("_top.digest", "_top.depth", (F.col("_path") - F.col("own")).alias("above"))))
    rows = rows.withColumn("_held", F.last("_top", ignorenulls=True).over(inside))
    stretches = rows.groupBy("conv", "stretch").agg(F.sum("own").alias("sum"), F.max_by("_top", F.when(F.col("_top").isNotNull(), F.col("depth"))).alias("last"))
    # a top of an earlier stretch counts from that stretch's start
    stretches = stretches.withColumn("earlier", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    stretches = stretches.withColumn("last", F.when(F.col("last").isNotNull(), F.struct("last.digest", "last.depth", (F.col("last.above") + F.col("earlier")).alias("above"))))
    stretches = stretches.withColumn("came", F.last("last", ignorenulls=True).over(before)).select("conv", "stretch", "earlier", "came").where("stretch > 0")
    later = rows.where("stretch > 0").join(stretches, ["conv", "stretch"])
    own = F.when(F.col("_held").isNotNull(), F.struct("_held.digest", "_held.depth", (F.col("_held.above") + F.col("earlier")).alias("above")))
    later = later.withColumn("seg", F.coalesce(own, "came")).withColumn("path", F.col("_path") + F.col("earlier"))
    first = rows.where("stretch <= 0").withColumn("seg", F.col("_held")).withColumn("path", F.col("_path"))
    kept = [*(c for c in rows.columns if not c.startswith("_")), "seg", "path"]
    return first.select(kept).unionByName(later.select(kept))


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """A row for each node: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    conv_id is the node's smallest member, which with the depth tells nodes apart; saved_tokens is what the subtree's nodes would save if each
    were computed once and not for every member.
    """
    convs, rows = rebuilt(storage.written(turns(conversations, conv_col, turn_col, role_col, text_col), "trie-turns"))
    root = convs.select("conv", F.lit(0).cast("long").alias("stretch"), F.lit(0).cast("long").alias("depth"), F.lit(EMPTY).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"))
    paths = storage.written(root.unionByName(prefixes(rows, stretch)), "trie-prefixes")

    nodes = paths.groupBy("depth", "digest").agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("size").alias("size"))
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("size")).drop("size")
    nodes = storage.written(nodes, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = storage.written(nodes, "trie-children")
    above = nodes.select(F.col("digest").alias("parent"), F.col("rep").alias("parent_rep"), F.col("n_children").alias("siblings"))
    nodes = nodes.join(above, "parent", "left").withColumn("starts", F.coalesce(F.col("siblings") != 1, F.lit(True))).drop("siblings")
    nodes = storage.written(nodes, "trie-parents")

    # paths of the conversations that stand for nodes
    standing = nodes.select(F.col("rep").alias("conv")).distinct()
    held = paths.select("conv", "stretch", "depth", "digest").join(standing, "conv", "left_semi").join(nodes.select("digest", "rep", "own", "starts"), "digest")
    along = storage.written(_along(held), "trie-paths")
    mine = along.where("conv = rep").select("digest", "seg", "path")
    nodes = storage.written(nodes.join(mine, "digest"), "trie-segments")

    bottom = (F.col("n_children") == 0).cast("long")
    segments = nodes.groupBy(F.col("seg.digest").alias("digest")).agg(F.sum("own").alias("saved"), F.sum(bottom).alias("leaves"))
    tops = nodes.where("starts").select("digest", "rep", "depth").join(segments, "digest")
    ancestors = along.where("starts").select(F.col("conv").alias("rep"), F.col("digest").alias("top"), F.col("depth").alias("at"))
    exploded = tops.join(ancestors, "rep").where("at <= depth")
    sums = storage.written(exploded.groupBy("top").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves")), "trie-sums")

    deepest = paths.groupBy("conv").agg(F.max("depth").alias("last"))
    ended = paths.select("conv", "depth", "digest").join(deepest, "conv").where("depth = last")
    told = ends(storage.written(ended.select("digest", "conv"), "trie-ends"))
    out = nodes.join(sums, F.col("seg.digest") == F.col("top")).join(told, "digest", "left")
    saved = F.col("saved") - (F.col("path") - F.col("own") - F.col("seg.above"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent_rep").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
