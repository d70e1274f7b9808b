"""Near-duplicate components by bottom-k sketches of one hash function.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``); a shorter text is one shingle of all its words, a
text without words has the empty set and is linked with nothing. Two documents
are linked when ``|A n B| / |A u B| >= 0.75``; components are over all links.

* ``sketch``: one pass over whole texts gives each document its set size, a
  128-bit digest of the set and the ``K`` smallest shingle hashes.
* Equal sets collapse to one class (aggregation, so copies never meet in a task).
* Inverted lists: two sets with similarity >= 0.75 share at least ``m`` of their
  ``k`` retained values (exact for sets up to ``0.75 k``; beyond it the bound fails
  with probability below 1e-7 a pair). First, with ``K`` = 48, a document stays a
  candidate only when ``m`` = 20 of its values occur in other documents; nearly
  all documents go here. The candidates are sketched again from their full sets,
  with ``K2`` = 256 and ``m`` = 144, and enter the lists of only those values that
  are rarest among candidates, ``k - m + 1`` less the ones nobody shares: two
  similar sets meet in at least one of them. A passage that many otherwise
  different documents share is frequent and, unless it makes up more than half
  of a document, never becomes a list.
* A list does not emit all its pairs. Its most central member (the one whose
  values are shared most) is its hub, and every document is checked exactly
  against the hub ``L`` that it meets in most of its lists. Documents similar to
  their hub are one component. For a document ``x`` that is not, with ``c = |x n L|``,
  a similar ``y`` either shares with ``x`` a shingle outside ``L``, or has
  ``3 |y| <= 7 c - 3 |x|``: otherwise ``|x n y| <= c`` and the similarity stays below
  0.75. So within a hub's documents the shingles outside the hub are matched, all of
  them, and the few pairs small enough are added. Lists whose members have different
  hubs (a passage that makes up most of many short documents) go through the same
  a second time, now with the most central hub of all their lists; what shares
  neither hub meets in the lists. No pair that could be a link is left out, and a
  group of near copies costs about its size, not its square.
* The union sketch of a pair estimates its similarity; far pairs go, and the
  full sets of the rest are intersected.

Defined results: null text or no words: ``n_shingles`` 0, own component.
Rows with a null id take part; ids are compared as nulls last, so a class of
null ids only has a null component. Repeated rows are one class. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_split, drop, shingle_hashes, ship, signed, stored, text_input, text_slices, word_hashes, words

#: Retained values, and how many of them two similar sets share at least when both
#: are larger than 0.75 times that; for all documents and for candidates.
K, MIN_SHARED = 48, 20
K2, MIN_SHARED2 = 256, 144
NUM, DEN = 75, 100
#: Union-sketch estimates below this are dropped (0.75 less five standard errors).
EST_FLOOR = 0.61


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes below 2^63, so that signed and unsigned order agree."""
    return np.unique(shingle_hashes(word_hashes(words(text))) >> np.uint64(1))


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _long_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.ascontiguousarray(flat))))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_shingles, cls (set digest, null when empty), sk (smallest hashes)."""
    def run(batches):
        for b in text_slices(batches, 1):
            n, cls, sk = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py())
                n.append(len(s))
                cls.append(digest(s) if len(s) else None)
                sk.append(s[:k].copy())            # a slice would keep the whole set
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), _long_lists(sk)],
                names=["doc_id", "n_shingles", "cls", "sk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_shingles bigint, cls binary, sk array<bigint>")


def _least_shared(k: int, shared: int) -> "F.Column":
    n = F.col("n")
    return F.when(n <= int(k * NUM / DEN), F.ceil(n * NUM / DEN).cast("int")).otherwise(shared)


def _shared_values(classes: DataFrame) -> DataFrame:
    """(value, cls, n, df) of the retained values that occur in several classes."""
    values = classes.select("cls", "n", F.explode("sk").alias("value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return values.join(counts, "value")


def candidates(classes: DataFrame) -> DataFrame:
    """(cls) of classes that share enough retained values with others to be linked at all."""
    found = _shared_values(classes).groupBy("cls", "n").agg(F.count(F.lit(1)).alias("shared"))
    return found.where(F.col("shared") >= _least_shared(K, MIN_SHARED)).select("cls")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(value, cls, n, weight) of every retained value that can prove a link (see module
    text); ``weight`` sums over a class's values how many classes share each."""
    own = Window.partitionBy("cls")
    least = _least_shared(K2, MIN_SHARED2)
    return (_shared_values(classes)
            .withColumn("rarity", F.row_number().over(own.orderBy("df", "value")))
            .withColumn("shared", F.count(F.lit(1)).over(own))
            .withColumn("weight", F.sum("df").over(own))
            .where((F.col("shared") >= least) & (F.col("rarity") <= F.col("shared") - least + 1))
            .select("value", "cls", "n", "weight"))


def _sized(a: str, b: str) -> "F.Column":
    """Sizes that allow similarity >= 0.75."""
    x, y = F.col(a), F.col(b)
    return (x * DEN >= y * NUM) & (y * DEN >= x * NUM)


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Keep pairs whose union sketch (K2 smallest of both) lies mostly in both."""
    s = classes.select("cls", "sk")
    a, b = s.toDF("a", "sa"), s.toDF("b", "sb")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K2)
    both = F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))
    return (pairs.join(a, "a").join(b, "b").withColumn("u", union)
            .where(F.size(both) >= F.lit(EST_FLOOR) * F.size("u")).select("a", "b"))


def _similar(common, a, b) -> "F.Column":
    return common * DEN >= (a + b - common) * NUM


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact Jaccard on full sets."""
    a, b = sets.select(F.col("cls").alias("a"), F.col("full").alias("fa")), sets.select(F.col("cls").alias("b"), F.col("full").alias("fb"))
    common = F.size(F.array_intersect("fa", "fb"))
    return pairs.join(a, "a").join(b, "b").where(_similar(common, F.size("fa"), F.size("fb"))).select("a", "b")


def hubs(lists: DataFrame, widest: bool = False) -> DataFrame:
    """(cls, n, hub): of the hubs of its lists, the one that a class meets most often, or
    (``widest``) the most central one; ties go to the largest digest."""
    heads = lists.groupBy("value").agg(F.max(F.struct("weight", "cls")).alias("h")).select("value", F.col("h.weight").alias("hw"), F.col("h.cls").alias("hub"))
    met = lists.join(heads, "value").groupBy("cls", "n", "hub", "hw").agg(F.count(F.lit(1)).alias("times"))
    best = F.struct("hw", "hub") if widest else F.struct("times", "hub")
    return met.groupBy("cls", "n").agg(F.max(best).alias("h")).select("cls", "n", F.col("h.hub").alias("hub"))


def compared_with_hubs(chosen: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, n, hub, common, linked, rest): ``rest`` holds the shingles that the hub lacks."""
    x = sets.select("cls", F.col("full").alias("fx"))
    h = sets.select(F.col("cls").alias("hub"), F.col("full").alias("fh"))
    both = chosen.join(x, "cls").join(h, "hub").select("cls", "n", "hub", F.size("fh").alias("hn"), F.array_except("fx", "fh").alias("rest"))
    common = F.col("n") - F.size("rest")
    return both.withColumn("common", common).withColumn("linked", _similar(common, F.col("n"), F.col("hn"))).drop("hn")


def shared_outside(rows: DataFrame) -> DataFrame:
    """(cls, value) of the shingles that a hub lacks and several of its documents have."""
    rest = rows.select("cls", "hub", F.explode("rest").alias("value"))
    often = rest.groupBy("hub", "value").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("hub", "value")
    return rest.join(often, ["hub", "value"]).select("cls", "value")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame, "F.Column"]:
    """(x: not linked with its hub; y: all; condition for a pair of one hub that may be a link)."""
    slim = rows.select("cls", "n", "hub", "common", "linked", "root")
    x = slim.where(~F.col("linked")).select(F.col("cls").alias("x"), F.col("n").alias("xn"), "hub", F.col("common").alias("xc"), F.col("root").alias("xr"))
    y = slim.select(F.col("cls").alias("y"), F.col("n").alias("yn"), "hub", F.col("common").alias("yc"), F.col("linked").alias("yl"), F.col("root").alias("yr"))
    return x, y, (F.col("xr") != F.col("yr")) & _sized("xn", "yn")


def outside_pairs(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """(x, y) of one hub but of different components (``root``) with a shared shingle that the hub lacks."""
    x, y, apart = _sides(rows)
    return x.join(shared.withColumnRenamed("cls", "x"), "x").join(
        y.join(shared.withColumnRenamed("cls", "y"), "y"), ["hub", "value"]).where(apart).select("x", "y")


def inside_pairs(rows: DataFrame) -> DataFrame:
    """(x, y) of one hub but of different components, small enough to lie inside the hub's part."""
    x, y, apart = _sides(rows)
    small = 3 * F.col("yn") <= 7 * F.col("xc") - 3 * F.col("xn")
    back = F.col("yl") | (3 * F.col("xn") <= 7 * F.col("yc") - 3 * F.col("yn"))
    wide = x.where(7 * F.col("xc") * DEN >= 3 * F.col("xn") * (DEN + NUM))
    return wide.join(y, "hub").where(apart & small & back).select("x", "y")


def same_hub_pairs(rows: DataFrame) -> list[DataFrame]:
    """Written tables (x, y) of all pairs of one hub but of different components that may still be links."""
    shared = stored(shared_outside(rows))
    found = [stored(outside_pairs(rows, shared)), stored(inside_pairs(rows))]
    drop(shared)
    return found


def mixed_lists(lists: DataFrame, rows: DataFrame) -> DataFrame:
    """The lists whose members have different hubs, with ``hub1``, the hub of each member."""
    listed = lists.join(rows.select("cls", F.col("hub").alias("hub1")), "cls")
    return listed.join(listed.groupBy("value").agg(F.min("hub1").alias("h0"), F.max("hub1").alias("h1")).where("h0 <> h1").select("value"), "value")


def list_pairs(mixed: DataFrame, second: DataFrame) -> DataFrame:
    """(x, y) that share a list but neither their first nor their second hub."""
    listed = mixed.select("value", "cls", "hub1").join(second.select("cls", "n", "hub", "root"), "cls")
    p = listed.select("value", F.col("cls").alias("x"), F.col("n").alias("xn"), F.col("hub1").alias("x1"), F.col("hub").alias("x2"), F.col("root").alias("xr"))
    q = listed.select("value", F.col("cls").alias("y"), F.col("n").alias("yn"), F.col("hub1").alias("y1"), F.col("hub").alias("y2"), F.col("root").alias("yr"))
    apart = (F.col("x1") != F.col("y1")) & (F.col("x2") != F.col("y2")) & (F.col("xr") != F.col("yr"))
    return p.join(q, "value").where((F.col("x") < F.col("y")) & apart & _sized("xn", "yn")).select("x", "y")


def _rooted(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return stored(rows.join(comp.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))


def _close(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("linked") & (F.col("cls") != F.col("hub"))).select(F.col("cls").alias("a"), F.col("hub").alias("b"))


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, full set) of the wanted classes, recomputed from their first document's text."""
    def run(batches):
        for b in text_slices(batches, 0):
            full = [shingle_set(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in full], pa.binary()), _long_lists(full)], names=["cls", "full"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = wanted.select(F.col("first_id").alias("w"))
    may, _ = bloom_split(texts, "doc_id", ids)
    picked = may.join(ids, F.col("doc_id").eqNullSafe(F.col("w")), "left_semi")
    return (picked.select("text").mapInArrow(run, "cls binary, full array<bigint>")
            .join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (a, b); root is the least node.

    Alternating large-star and small-star steps, each written to the shared
    folder, until the edges stop changing.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .where("u <> v").distinct())
        drop(pairs)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pairs = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop(large)
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def links(docs: DataFrame, sketches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cls, root) of classes linked with a smaller class."""
    classes = stored(sketches.where(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sk").alias("sk")))
    wanted = stored(classes.join(candidates(classes), "cls", "left_semi").select("cls", "first_id"))
    drop(classes)
    sets = stored(full_sets(docs, wanted, id_col, text_col))
    shared = sets.select("cls", F.size("full").alias("n"), F.slice("full", 1, K2).alias("sk"))
    lists = stored(inverted_lists(shared))
    first = stored(compared_with_hubs(hubs(lists), sets))
    mixed = stored(mixed_lists(lists, first))
    again = stored(compared_with_hubs(hubs(mixed, widest=True), sets))
    comp = components(_close(first).union(_close(again)))
    one, two = _rooted(first, comp), _rooted(again, comp)
    # each step is written: one plan of all of them keeps dozens of exchanges, with all their tasks, on the driver at once
    parts = [*same_hub_pairs(one), *same_hub_pairs(two), stored(list_pairs(mixed, two))]
    pairs = stored(reduce(DataFrame.union, parts).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    near = stored(_estimated(pairs, shared))
    late = stored(_verified(near, sets))
    drop(*parts, pairs, near)
    if not late.isEmpty():
        comp, early = components(comp.toDF("a", "b").union(late)), comp
        drop(early)
    drop(late)
    for used in (first, again, one, two, mixed, sets, lists, wanted):
        drop(used)
    return comp


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, cls; classes: cls, root, component_id)."""
    ship(docs.sparkSession)
    rows = stored(sketch(docs, id_col, text_col))
    comp = links(docs, rows, id_col, text_col)
    rows = rows.select("doc_id", "n_shingles", "cls")
    classes = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(comp.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = classes.groupBy("root").agg(F.min("component_id").alias("component_id"))
    return rows, classes.select("cls", "root").join(least, "root").select("cls", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    rows, classes = resolve(docs, id_col, text_col)
    linked = rows.where(F.col("cls").isNotNull()).join(classes, "cls").select("doc_id", "n_shingles", "component_id")
    alone = rows.where(F.col("cls").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Rows with equal id and equal text are one document. Of components with null
    ids only, one row stays. Texts without words all stay. Most rows are settled
    by a fixed-size filter of the dropped ids and never shuffled.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows, classes = resolve(docs, id_col, text_col)
    classes = stored(classes)
    judged = rows.where(F.col("doc_id").isNotNull()).join(classes.select("cls", "component_id"), "cls", "left").select(
        "doc_id", (F.coalesce("component_id", "doc_id") != F.col("doc_id")).alias("gone"))
    # an id may come with several texts: it goes when one of them duplicates a smaller id
    marked = stored(judged.groupBy("doc_id").agg(F.max("gone").alias("gone"), F.count(F.lit(1)).alias("times")).where("gone or times > 1"))
    may, rest = bloom_split(docs.where(F.col(id_col).isNotNull()), id_col, marked.select("doc_id"))
    mark = marked.select(F.col("doc_id").alias("_id"), F.col("gone").alias("_gone"))
    met = may.join(mark, F.col(id_col) == F.col("_id"), "left")
    single = met.where(F.col("_id").isNull()).select(*cols)
    repeated = met.where(F.col("_id").isNotNull() & ~F.col("_gone")).select(*cols).dropDuplicates([id_col, text_col])
    out = rest.union(single).union(repeated)
    nameless = docs.where(F.col(id_col).isNull())
    if nameless.isEmpty():
        return out
    with_cls = _with_class(nameless, text_col).join(classes.toDF("_cls", "_root", "_least"), "_cls", "left").where(F.col("_least").isNull())
    return (out.union(with_cls.where(F.col("_root").isNull()).select(*cols))
            .union(with_cls.where(F.col("_root").isNotNull()).dropDuplicates(["_root"]).select(*cols)))


def _with_class(docs: DataFrame, text_col: str) -> DataFrame:
    names = docs.columns

    def run(batches):
        for b in text_slices(batches, at):
            cls = [digest(s) if len(s) else None for s in (shingle_set(t.as_py()) for t in b.column(at))]
            yield pa.RecordBatch.from_arrays(b.columns[:len(names)] + [pa.array(cls, pa.binary())], names=names + ["_cls"])

    given, at = text_input(docs, text_col, names)
    return given.mapInArrow(run, docs.select("*").schema.add("_cls", "binary"))
