"""Trie of conversation prefixes by truncation peeling.

A node is a distinct sequence of a conversation's first turns. The work descends
from the greatest depth: at each depth the conversations that end there are merged
with the surviving nodes, whose last turn was stripped one level below; rows with
the same prefix are one node; its totals are complete at that moment (every deeper
node has been stripped into it), so it is written out, and stripped in turn. Every
node is discovered and aggregated once.

A prefix is known by its depth and a 128-bit key: the exclusive or of a hash of every
(position, role, text) in it. The key of a whole conversation is therefore a plain
aggregate, whatever its length, and stripping a turn takes that turn's hash out
again. Texts are hashed before anything moves.

How it is laid out: conversations with equal turns collapse to one row by their key
before the first level, and every level's grouping combines on the map side, so
copies, a shared first turn or the root never meet in a task. Depths are worked on in
bands. A row carries only the hashes of its turns inside the band (from a stored
table of one row a conversation and band). The band next to the root regroups by an
exchange a level. A deeper band is dealt by the key of the prefix at its upper edge,
under which all its levels group without moving, as long as no such prefix holds
more than ``GROUP_TURNS`` turns; a band with a larger group is regrouped level by level like
the first. Bands grow with the depth, where few conversations are left. The state
between two bands is written to the shared folder, so a lost executor repeats a band at most.

Turns of one conversation are numbered by blocks of ``BLOCK`` turn numbers and a running
count over the blocks, so a conversation that holds a third of all rows is spread.

Defined results: a null role or text is empty; rows with a null conv_id belong to no
conversation and are ignored; null turn numbers come first; turns with equal numbers
are ordered by a digest of role and text, so repeated rows are two equal turns;
extra columns are ignored; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, ship, stored

BLOCK = 1024
#: Depths of the first band, growth of the others' width and its greatest value.
FIRST, GROWTH, WIDEST = 4, 3, 4096
#: Most turns under one prefix that a task may hold while it peels a band.
GROUP_TURNS = 500_000
#: Ids of ended conversations are joined to text in blocks of so many possible ids.
IDS = 4096

NODE = ["depth", "k1", "k2", "conv_id", "n", "children", "leaves", "saved"]
PATH = "array<struct<pos: bigint, x1: bigint, x2: bigint, bytes: bigint>>"


def edges(deepest: int) -> list[int]:
    """Upper edges of the bands, from 0, up to one beyond ``deepest``."""
    out, width = [0, FIRST], FIRST
    while out[-1] < deepest:
        width = min(width * GROWTH, WIDEST)
        out.append(out[-1] + width)
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), a1 and a2 (digest of role and text), bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint").alias("turn"), digest.alias("_md5"), F.octet_length(text).cast("bigint").alias("bytes"))
    rows = rows.select("conv_id", "turn", "bytes", *[F.conv(F.substring("_md5", at, 15), 16, 10).cast("bigint").alias(c) for c, at in (("a1", 1), ("a2", 16))],
                       F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("_block"))
    inside = Window.partitionBy("conv_id", "_block").orderBy(F.asc_nulls_first("turn"), "a1", "a2")
    rows = rows.withColumn("_at", F.row_number().over(inside))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "_block").agg(F.max("_at").alias("_n"))
    blocks = blocks.select("conv_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(blocks, ["conv_id", "_block"]).select("conv_id", (F.col("_before") + F.col("_at") - 1).alias("pos"), "a1", "a2", "bytes")


def spliced(rows: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``taken`` (at most ``most``) turns are those of conversation ``base``: (turns, conv_ids).

    ``base`` and ``taken`` are columns over conv_id. A base that is absent or shorter gives what it has.
    """
    ids = rows.groupBy("conv_id").agg(F.count("*").alias("_n")).select("conv_id", base.alias("_base"), taken.alias("_h"))
    heads = rows.where(F.col("pos") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "a1", "a2", "bytes"))).alias("_head"))
    ids = ids.join(heads.select(F.col("conv_id").alias("_base"), "_head"), "_base", "left")
    ids = ids.select("conv_id", "_h", F.expr("slice(coalesce(_head, array()), 1, cast(_h as int))").alias("_head"))
    taken_rows = ids.select("conv_id", F.explode("_head").alias("_t")).select("conv_id", "_t.*")
    own = rows.join(ids.select("conv_id", "_h", F.size("_head").alias("_m")), "conv_id").where("pos >= _h")
    own = own.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_m")).alias("pos"), "a1", "a2", "bytes")
    return taken_rows.unionByName(own), ids.select("conv_id")


def peel(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of ``rows`` (conv_id, pos, a1, a2, bytes); ``conversations`` also names those without turns.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select("conv_id", "pos", "bytes", F.xxhash64("pos", "a1", "a2").alias("x1"), F.xxhash64(F.lit(7), "pos", "a1", "a2").alias("x2"))
    rows = stored(rows)
    deepest = rows.agg(F.max("pos")).first()[0]
    cuts = edges(0 if deepest is None else deepest + 1)
    band = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda e: e <= F.col("pos"))) - 1
    paths = stored(rows.withColumn("band", band).groupBy("conv_id", "band").agg(
        F.array_sort(F.collect_list(F.struct("pos", "x1", "x2", "bytes"))).cast(PATH).alias("path"),
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.count("*").alias("n")))
    whole = paths.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))
    none = F.lit(0).cast("bigint")
    members = stored(conversations.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, none).alias(c) for c in ("depth", "k1", "k2")]))
    ended = stored(members.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).select(
        *NODE[:5], none.alias("children"), none.alias("leaves"), none.alias("saved")))
    reps = paths.join(ended.select("conv_id"), "conv_id", "left_semi").select("conv_id", "band", "path")

    found, upper = [], None
    for k in reversed(range(len(cuts) - 1)):
        lo, hi = cuts[k], cuts[k + 1]
        here = ended.where((F.col("depth") > lo) & (F.col("depth") <= hi))
        here = here if upper is None else here.unionByName(upper)
        here = here.join(reps.where(F.col("band") == k).select("conv_id", "path"), "conv_id")
        levels = _band(here, lo, hi)
        found.append(levels.where("not up"))
        upper = levels.where("up").select(*NODE)
    root = ended.where("depth = 0").unionByName(upper)
    root = root.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in NODE[4:]])
    nodes = root.withColumns({"p1": F.lit(None).cast("bigint"), "p2": F.lit(None).cast("bigint"), "up": F.lit(False), "bytes": none})
    for f in found:
        nodes = nodes.unionByName(f)
    nodes = stored(nodes.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves"))))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(_ends(members), ["depth", "k1", "k2"], "left").join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    out = stored(out)
    drop(rows, paths, members, ended, nodes, *found)
    return out


def _band(here: DataFrame, lo: int, hi: int) -> DataFrame:
    """Nodes of depths lo + 1 to hi (not ``up``) and what is left of them at depth lo (``up``), stored.

    ``here`` are ended conversations and survivors, with the ``path`` of their turns from lo on.
    """
    here = stored(here)
    if lo > 0:
        whole = here
        flat = "aggregate(transform(filter(path, t -> t.pos < depth), t -> t.{0}), 0L, (a, x) -> a ^ x)"
        here = stored(here.select("*", *[F.expr(f"{k} ^ {flat.format(x)}").alias(g) for k, x, g in (("k1", "x1", "g1"), ("k2", "x2", "g2"))]))
        largest = here.groupBy("g1", "g2").agg(F.sum(F.size("path")).alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) <= GROUP_TURNS:
            dealt = here.repartition("g1", "g2").sortWithinPartitions("g1", "g2")
            out = stored(dealt.mapInArrow(lambda batches: _local(batches, lo, hi), _SCHEMA))
            drop(here, whole)
            return out
        here = here.drop("g1", "g2")
    out, done = [], None
    for top in range(hi, lo, -FIRST):
        part = here.where((F.col("depth") > max(lo, top - FIRST)) & (F.col("depth") <= top))
        got = _levels(part if done is None else part.unionByName(done), max(lo, top - FIRST), top)
        out.append(got.where("not up").drop("path"))
        done = got.where("up").select(*here.columns)
    up = done.drop("path").withColumns({"p1": F.col("k1"), "p2": F.col("k2"), "up": F.lit(True), "bytes": F.lit(0).cast("bigint")})
    for f in out:
        up = up.unionByName(f)
    return up


def _levels(cur: DataFrame, lo: int, hi: int) -> DataFrame:
    """Peel a few depths, one exchange each; stored."""
    keep = [*NODE, "path"]
    out, survivors = [], None
    for d in range(hi, lo, -1):
        level = cur.where(F.col("depth") == d).select(*keep)
        level = level if survivors is None else level.unionByName(survivors)
        level = level.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in NODE[4:]], F.first("path").alias("path"))
        # a path reaches to the end of its band, the node may end before
        level = level.withColumn("_t", F.expr("element_at(filter(path, t -> t.pos = depth - 1), 1)"))
        level = level.select(*NODE[:-1], (F.col("saved") + (F.col("n") - 1) * F.col("_t.bytes")).alias("saved"), "path",
                             F.col("k1").bitwiseXOR(F.col("_t.x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("_t.x2")).alias("p2"), F.col("_t.bytes").alias("bytes"))
        out.append(level.withColumn("up", F.lit(False)))
        survivors = level.select(
            (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", "n", F.lit(1).cast("bigint").alias("children"),
            F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).alias("leaves"), "saved", F.expr(f"filter(path, t -> t.pos < {d - 1})").alias("path"))
    nodes = survivors.withColumns({"p1": F.col("k1"), "p2": F.col("k2"), "up": F.lit(True), "bytes": F.lit(0).cast("bigint")})
    for f in out:
        nodes = nodes.unionByName(f)
    return stored(nodes)


_SCHEMA = ", ".join(f"{c} bigint" for c in [*NODE, "p1", "p2", "bytes"]) + ", up boolean"


def _local(batches, lo: int, hi: int):
    """Peel the depths hi to lo + 1 of rows that are sorted by (g1, g2), complete groups at a time."""
    held, size, last = [], 0, None
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in [*NODE, "g1", "g2"]), b.column(b.schema.get_field_index("path")), strict=True):
            group = row[len(NODE):-1]
            if group != last and size > GROUP_TURNS:
                yield from _peeled(held, lo, hi)
                held, size = [], 0
            last = group
            turns = row[-1].values
            held.append((row[:len(NODE)], [turns.field(c).to_pylist() for c in ("x1", "x2", "bytes")]))
            size += len(turns)
    yield from _peeled(held, lo, hi)


def _peeled(held: list, lo: int, hi: int):
    new: dict[int, list] = {}
    for node, path in held:
        new.setdefault(node[0], []).append((node, path))
    held.clear()
    out: list[tuple] = []
    below: dict[tuple[int, int], list] = {}       # survivors: conv_id, n, children, leaves, saved, path
    for d in range(hi, lo, -1):
        cur, below = below, {}
        for (_, k1, k2, conv, n, children, leaves, saved), path in new.pop(d, ()):
            _merge(cur, (k1, k2), conv, n, children, leaves, saved, path)
        for (k1, k2), (conv, n, children, leaves, saved, path) in cur.items():
            x1, x2, size = (p[d - 1 - lo] for p in path)
            saved += (n - 1) * size
            up = k1 ^ x1, k2 ^ x2
            out.append((d, k1, k2, conv, n, children, leaves, saved, *up, size, False))
            _merge(below, up, conv, n, 1, leaves if children else 1, saved, path)
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    out += [(lo, *k, *s[:-1], *k, 0, True) for k, s in below.items()]
    yield _batch(out)


def _merge(into: dict, key, conv, n, children, leaves, saved, path) -> None:
    old = into.get(key)
    if old is None:
        into[key] = [conv, n, children, leaves, saved, path]
    else:
        old[0] = min(old[0], conv)
        old[1] += n
        old[2] += children
        old[3] += leaves
        old[4] += saved


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [*NODE, "p1", "p2", "bytes", "up"]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if name == "up" else pa.int64()) for name, c in zip(names, cols, strict=True)], names=names)


def _ends(members: DataFrame) -> DataFrame:
    """ends_sha256 by node at which conversations end: of their ids in ascending order, joined by commas.

    Ids are joined to texts by block first. A node of one block is done; for the others a
    task streams the blocks of its nodes in order, as the digest is sequential.
    """
    key = ["depth", "k1", "k2"]
    blocks = members.groupBy(*key, F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select(*key, "block", F.array_join("ids", ",").alias("ids"))
    count = blocks.groupBy(*key).agg(F.count("*").alias("_blocks"), F.first("ids").alias("ids"))
    small = count.where("_blocks = 1").select(*key, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    large = blocks.join(count.where("_blocks > 1").select(*key), key, "left_semi").repartition(*key).sortWithinPartitions(*key, "block")

    def run(batches):
        last, digest = None, None
        for b in batches:
            done = []
            for *node, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        done.append((*last, digest.hexdigest()))
                    last, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            yield _digests(done)
        yield _digests([(*last, digest.hexdigest())] if last is not None else [])

    return small.unionByName(large.mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())], names=["depth", "k1", "k2", "ends_sha256"])
