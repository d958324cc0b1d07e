"""Near-duplicate classes by min-max hashing, with links confirmed on whole shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum,
so a signature costs half the hash evaluations. Bands of ``ROWS`` values (half minima, half
maxima) propose candidates; at a similarity of 0.8 a pair misses all ``BANDS`` bands with
probability (1 - 0.8^4)^32, about 5e-8.

No bucket is expanded into pairs. Texts with one shingle set are one node. In each bucket all
nodes are first compared with its most central node, and links join into components; only
nodes that a bucket still holds in different components are compared on, each with the nodes
outside its component. A link inside one component cannot change the classes, so none is lost.

Defined cases: null or wordless text has an empty set and is linked with nothing; fewer words
than ``words`` make one shingle; rows that repeat a doc_id are one document with the union of
their links; rows without a doc_id link like others, are named by the smallest doc_id they reach
(null if there is none) and are always kept; doc_ids may have any ordered type; an empty table
gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgraph.distributed import materialize
from tabgraph.llm.bitmap import bitmap, has, without
from tabgraph.llm.bytescan import Chunk, chunks, mix, span_hashes
from tabgraph.llm.components import components

BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS // 2
#: A shingle with at most so many holders names its pairs itself.
RARE = 6
#: Classes into which the other shingles are counted, to bound intersections.
CLASSES = 96
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
_ODD = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(chunk: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk's texts (A-Z lowered), and their text offsets."""
    data = chunk.lowered()
    starts, ends, of_text = chunk.words(data)
    single = span_hashes(chunk.prefix(data), starts, ends)
    counts = np.diff(of_text)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    text = np.repeat(np.arange(chunk.n), sizes)
    first = of_text[:-1][text] + np.arange(offsets[-1]) - offsets[:-1][text]
    length = np.minimum(counts, words)[text]
    made = length.astype(np.uint64)
    for k in range(words):
        here = k < length
        at = np.minimum(first + k, max(len(single) - 1, 0))
        made = np.where(here, mix(made * np.uint64(0xD6E8FEB86659FD93) + (single[at] if len(single) else 0)), made)
    return made, offsets


def distinct_sets(made: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and their offsets."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((made, text))
    made, text = made[order], text[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (text[1:] != text[:-1])
    made, text = made[new], text[new]
    return made, np.searchsorted(text, np.arange(len(offsets)))


def signatures(made: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Band hashes (texts x BANDS) of nonempty sets."""
    values = np.empty((len(offsets) - 1, 2 * PERMUTATIONS), np.uint64)
    for p, odd in enumerate(_ODD):
        permuted = (made ^ (made >> np.uint64(29))) * odd
        values[:, 2 * p] = np.minimum.reduceat(permuted, offsets[:-1])
        values[:, 2 * p + 1] = np.maximum.reduceat(permuted, offsets[:-1])
    bands = np.zeros((len(values), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(0x9FB21C651E98DF25) + values[:, r::ROWS])
    return bands


def set_keys(made: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit names of each text's set (2 x texts), 0 for empty ones."""
    full, keys = np.diff(offsets) > 0, np.zeros((2, len(offsets) - 1), np.int64)
    if full.any():
        for k, salt in enumerate((np.uint64(0x1234567), np.uint64(0x89ABCDE))):
            keys[k, full] = mix(np.add.reduceat(mix(made + salt), offsets[:-1][full])).view(np.int64)
    return keys


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            made, offsets = distinct_sets(*shingle_hashes(chunk, words))
            size = np.diff(offsets)
            full = size > 0
            keys = set_keys(made, offsets)
            bands = np.zeros((chunk.n, BANDS), np.uint64)
            if full.any():
                bands[full] = signatures(made, np.append(offsets[:-1][full], len(made)))
            flat = np.ascontiguousarray(bands[full]).reshape(-1).view(np.int64)
            at = np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, chunk.n), pa.array(size.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["doc_id", "n_shingles", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], words: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(k1, k2, shingles) of the rows (text, h) whose h is wanted."""
    for batch in batches:
        keep = has(wanted, batch.column(1).to_numpy(zero_copy_only=False))
        batch = batch.filter(pa.array(keep))
        for chunk in chunks(batch.column(0)):
            made, offsets = distinct_sets(*shingle_hashes(chunk, words))
            keys = set_keys(made, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0]), pa.array(keys[1]),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(made.view(np.int64)))],
                ["k1", "k2", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose sets are similar enough. Both sets meet in one row per pair."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    common = F.size(F.array_intersect("_sa", "_sb"))
    return pairs.join(left, "a").join(right, "b").withColumn("_i", common).filter(
        100 * F.col("_i") >= PERCENT * (F.col("na") + F.col("nb") - F.col("_i"))).select("a", "b")


def _possible(n: str, m: str):
    """Sizes alone allow the similarity."""
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    A class is named by its smallest doc_id, and the row of that doc_id is the one kept.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    sketch = materialize(texts.mapInArrow(
        lambda b: _sketch(b, words), f"doc_id {id_type}, n_shingles long, k1 long, k2 long, bands array<long>"))
    # One numbered node per distinct set. Copies combine before the shuffle; ``rep`` is a row to read the set from.
    nodes = materialize(sketch.filter("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands")).withColumn(
        "node", F.monotonically_increasing_id()))
    member = sketch.select("doc_id", "n_shingles", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left")
    rows = nodes.select("node", "n", F.explode(F.array_distinct("bands")).alias("band"))
    crowded = rows.groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    live = materialize(rows.join(crowded, "band"))
    # The most central node of a bucket is the one that meets most others over all its bands.
    degree = live.groupBy("node").agg(F.sum("crowd").alias("degree"))
    live = materialize(live.join(degree, "node").drop("crowd"))
    named = nodes.join(live.select("node").distinct(), "node", "left_semi").select("k1", "k2", "node", "rep")
    wanted = bitmap(named.select(F.xxhash64("rep").alias("h")), "h")
    sets = materialize(texts.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(
        lambda b: _sets(b, words, wanted), "k1 long, k2 long, shingles array<long>").join(
        named.drop("rep"), ["k1", "k2"]).dropDuplicates(["node"]).select("node", "shingles"))

    # Rows that repeat a doc_id tie their sets together whatever these hold.
    repeated = materialize(member.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min("node").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 and first is not null").select("doc_id", "first"))
    links = materialize(repeated.join(member, "doc_id").filter("node > first").select(
        F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    tested, component = None, None
    for whole in (False, False, True):
        placed = live.withColumn("component", F.col("node")) if component is None else live.join(
            component, live.node == component.id, "left").withColumn("component", F.coalesce("component", "node")).drop("id")
        proposed = _rest_pairs(placed, sets) if whole else _star_pairs(placed)
        if tested is not None:
            proposed = proposed.join(tested, ["a", "b"], "left_anti")
        proposed = materialize(proposed)
        found = materialize(_confirmed(proposed, sets))
        tested = proposed.select("a", "b") if tested is None else tested.union(proposed.select("a", "b"))
        links = links.union(found)
        component = components(links)
    member = member.join(repeated, "doc_id", "left").withColumn("node", F.coalesce("node", "first"))
    named = member.join(component, member.node == component.id, "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(smallest, "component", "left")
    # A text without words is a class of its own.
    return classes.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return without(docs, near_duplicates(docs, words).filter("not kept").select("doc_id").distinct())


def _star_pairs(placed: DataFrame) -> DataFrame:
    """Each bucket's most central node with one node of every other component there."""
    top = placed.groupBy("band", "component").agg(
        F.max(F.struct("degree", F.negate("node").alias("_"), "node", "n")).alias("best"))
    centre = top.groupBy("band").agg(
        F.max("best").alias("centre"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    pairs = top.join(centre, "band").filter("best.node <> centre.node").select(
        F.col("best.node").alias("x"), F.col("best.n").alias("nx"), F.col("centre.node").alias("y"), F.col("centre.n").alias("ny"))
    return _ordered(pairs)


def _rest_pairs(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """In buckets of several components: every node outside the largest one, with the nodes of other components.

    Sets bound the pairs before any is made. A shingle that at most ``RARE`` of these nodes hold
    joins few pairs, and those are taken from the shingle itself. All other pairs share no rare
    shingle, so what is not rare, counted by hash class, bounds their intersection from above:
    copies with changes at different places meet no one, however many share their bucket.
    """
    parts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("band").agg(
        F.max(F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = materialize(placed.join(main.select("band", F.col("main.component").alias("main")), "band"))
    nodes = mixed.groupBy("node").agg(F.min("n").alias("n"), F.min("component").alias("component"))
    held = sets.join(nodes.select("node"), "node").select("node", F.explode("shingles").alias("s"))
    few = held.groupBy("s").agg(F.count(F.lit(1)).alias("holders")).filter(F.col("holders") <= RARE)
    rare = materialize(held.join(few, "s"))
    # What is not rare, counted by hash class: an intersection holds at most the smaller count of each.
    common = held.join(few, "s", "left_anti").groupBy("node").agg(
        F.collect_list(F.pmod(F.col("s"), F.lit(CLASSES)).cast("int")).alias("_c"))
    count = lambda i: F.size(F.filter("_c", lambda c: c == i))
    counted = common.select("node", F.size("_c").alias("shared"), F.transform(
        F.sequence(F.lit(0), F.lit(CLASSES - 1)), count).alias("counts"))
    # A node whose shingles are all rare has no counts; its pairs come from the shingles alone.
    bound = materialize(nodes.join(counted, "node", "left").select(
        "node", "n", "component", F.coalesce("shared", F.lit(0)).alias("shared"),
        F.coalesce("counts", F.array_repeat(F.lit(0), CLASSES)).alias("counts")))
    side = lambda t: bound.select(
        F.col("node").alias(t), F.col("n").alias(f"n{t}"), F.col("shared").alias(f"s{t}"),
        F.col("counts").alias(f"h{t}"), F.col("component").alias(f"c{t}"))
    reaches = lambda most: (100 + PERCENT) * most >= PERCENT * (F.col("nx") + F.col("ny"))
    most = F.aggregate(F.zip_with("hx", "hy", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)

    named = rare.filter("holders > 1")
    met = named.select("s", F.col("node").alias("x")).join(
        named.select("s", F.col("node").alias("y")), "s").filter("x < y").groupBy("x", "y").agg(
        F.count(F.lit(1)).cast("int").alias("k")).join(side("x"), "x").join(side("y"), "y").filter(
        (F.col("cx") != F.col("cy")) & reaches(F.least("sx", "sy") + F.col("k"))).filter(reaches(most + F.col("k")))
    able = bound.filter(100 * F.col("shared") >= PERCENT * F.col("n")).select("node", "shared", "counts")
    left = mixed.join(able, "node")
    odd = left.filter("component <> main").select(
        "band", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("shared").alias("sx"),
        F.col("counts").alias("hx"), F.col("component").alias("cx"))
    every = left.select(
        "band", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("shared").alias("sy"),
        F.col("counts").alias("hy"), F.col("component").alias("cy"))
    apart = (F.col("cx") != F.col("cy")) & reaches(F.least("sx", "sy"))
    near = odd.join(every, (odd.band == every.band) & apart & reaches(most))
    columns = ["x", "nx", "y", "ny"]
    return _ordered(met.select(*columns).union(near.select(*columns)))


def _ordered(pairs: DataFrame) -> DataFrame:
    turned = F.col("x") > F.col("y")
    pick = lambda yes, no: F.when(turned, F.col(yes)).otherwise(F.col(no))
    return pairs.filter(_possible("nx", "ny")).select(
        pick("y", "x").alias("a"), pick("x", "y").alias("b"), pick("ny", "nx").alias("na"), pick("nx", "ny").alias("nb")).distinct()
