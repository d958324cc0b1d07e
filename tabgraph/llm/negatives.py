"""Hard negatives from Hilbert-ordered candidate blocks with zone maps.

Candidates lie along a Hilbert curve through the vector space, so rows near each other in a block
are near each other in space. A block is one Parquet row: ids, labels, a packed integer matrix, and
its zone map, the least and greatest value of every dimension. For an anchor, interval arithmetic
on a zone map bounds every inner product inside the block from both sides; a block is read only if
those bounds, its labels and the scores already found leave room for a result.

Anchors go in blocks too, so pages of zone maps meet blocks of anchors, never rows meeting rows.
Each search reads an anchor's own stretch of the curve first, and then only blocks whose bounds still
beat what was found there. Scores are exact: double arithmetic where every sum stays below 2^53,
Python integers beyond.

Two searches: an anchor's positives are its best rows of the same label; then, for each of them,
the best rows of other labels whose score lies in the window from ``low`` to ``high`` percent of
the positive's score.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no
part; vectors of other lengths are only compared among themselves; an anchor's own row is no
candidate, while rows that repeat its id or vector are; rows that repeat an id are rows of their
own, also as anchors, whose results then repeat; equal scores go to the smaller id; a window is
empty for positives below 0; scores beyond 64 bits are clipped to them; empty tables give an empty
result; extra columns are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgraph.distributed import materialize, ordered_index

#: Rows of a candidate block and of an anchor block, zone maps of a directory page, blocks a task call reads.
BLOCK_ROWS, ANCHOR_ROWS, PAGE, LANE = 1024, 2048, 256, 8
#: Blocks on either side of an anchor's own that are read before bounds are compared with results.
NEAR = 1
#: Bits of each dimension on the curve.
CURVE_BITS = 4
#: Whole numbers below it are exact in doubles.
EXACT = float(1 << 53)


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Position on the Hilbert curve of each row of ``cells`` (whole numbers below 2 ** bits), as sortable bytes.

    Skilling's transform: from the highest bit down, each dimension's bit says whether the lower
    bits of the first dimension are inverted or exchanged with its own; a Gray code ends it.
    """
    x = cells.astype(np.int64).T.copy()
    dims, rows = x.shape
    if not dims:
        return [b""] * rows
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            high = (x[d] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap if d else 0
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flips = np.zeros(rows, np.int64)
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flips
    # The key reads the highest bit of every dimension, then the next.
    planes = np.stack([(x[d] >> bit) & 1 for bit in range(bits - 1, -1, -1) for d in range(dims)], axis=1)
    return [row.tobytes() for row in np.packbits(planes.astype(np.uint8), axis=1)]


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * component) of every component, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _curve(batches: Iterator[pa.RecordBatch], low: float, high: float) -> Iterator[pa.RecordBatch]:
    span = max(high - low, 1.0)
    for batch in batches:
        vectors, keys = batch.column("v"), np.full(batch.num_rows, b"", object)
        dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            cells = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
            cells = np.clip((cells - low) / span * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            keys[rows] = hilbert_keys(cells, CURVE_BITS)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "key"])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder of the checkpoints, which all executors share."""
    materialize(df.limit(0))  # sets the folder where the session has none
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def on_curve(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (id, label, v) with ``dim``, ``place``, their dense position along the curve, and ``block``.

    Ties go by id, so copies of one vector that fill a third of the table still spread over places.
    """
    # One pair of numbers scales the curve for all dimensions.
    span = rows.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    low, high = (span.lo, span.hi) if span.lo is not None else (0.0, 1.0)
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in rows.columns)
    curve = rows.mapInArrow(lambda b: _curve(b, low, high), f"{kinds}, key binary").withColumn("dim", F.size("v"))
    return ordered_index(curve, ["dim", "key", "id"], "place").drop("key").withColumn("block", F.floor(F.col("place") / block_rows))


def candidate_blocks(placed: DataFrame) -> DataFrame:
    """Blocks (dim, block, page, ids, places, labels, values, lo, hi, kinds) in curve order, written as Parquet."""
    packed = placed.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("place", "id", "label", "v"))).alias("r"))
    part = lambda name: F.transform("r", lambda x: x[name])
    along = F.when(F.col("dim") > 0, F.sequence(F.lit(1), F.col("dim"))).otherwise(F.array().cast("array<int>"))
    zone = lambda pick: F.transform(along, lambda d: pick(F.transform(F.col("r"), lambda x: F.try_element_at(x["v"], d))))
    return written(packed.select(
        "dim", "block", F.floor(F.col("block") / PAGE).alias("page"), part("id").alias("ids"), part("place").alias("places"),
        part("label").alias("labels"), F.flatten(part("v")).alias("values"), zone(F.array_min).alias("lo"),
        zone(F.array_max).alias("hi"), F.array_distinct(part("label")).alias("kinds")), "blocks")


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector of each zone (zones x dims)."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    if not anchors.size or not rows.size or float((np.abs(anchors).sum(axis=1).max()) * np.abs(rows).max()) < EXACT:
        return np.rint(anchors @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in a] for a in anchors], object) @ np.array([[int(x) for x in r] for r in rows], object).T
    return np.array([[min(max(x, -(1 << 63)), (1 << 63) - 1) for x in line] for line in exact], np.int64).reshape(len(anchors), len(rows))


class Asks:
    """The asks of a block of anchors: per ask its anchor, whether it wants the anchor's label, and its score range."""

    def __init__(self, anchors: pd.DataFrame):
        self.vectors = np.stack(anchors["v"].to_numpy()).astype(np.float64) if len(anchors) else np.zeros((0, 0))
        self.places, self.own_block = anchors["place"].to_numpy(), anchors["block"].to_numpy()
        self.labels = anchors["label"].to_numpy()
        self.of = np.repeat(np.arange(len(anchors)), [len(a) for a in anchors["asks"]])
        flat = [x for a in anchors["asks"] for x in a]
        self.no, self.low, self.high = (np.array([x[f] for x in flat], np.int64) for f in ("no", "low", "high"))

    def near(self, block: int) -> np.ndarray:
        return np.abs(self.own_block[self.of] - block) <= NEAR


def _wanted_blocks(same: bool):
    """Blocks of a page that some ask has to read, by bounds, labels and the scores found so far."""
    def run(page: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"dim": [], "anchors": [], "block": []}, dtype=np.int64)
        if not len(page) or not len(anchors):
            return out
        asks = Asks(anchors)
        least, most = bounds(asks.vectors, np.stack(page["lo"].to_numpy()), np.stack(page["hi"].to_numpy()))
        blocks = page["block"].to_numpy()
        # Sums of doubles beyond 2^53 are rounded; the bounds give way by more than that.
        slack = np.abs(most) * 1e-12 + np.abs(least) * 1e-12
        reach = ((most + slack)[asks.of] >= asks.low[:, None]) & ((least - slack)[asks.of] <= asks.high[:, None])
        for z, kinds in enumerate(page["kinds"]):
            kinds = np.asarray(kinds)
            fits = np.isin(asks.labels, kinds) if same else (len(kinds) > 1) | ~np.isin(asks.labels, kinds)
            reach[:, z] &= fits[asks.of] & ~asks.near(blocks[z])
        chosen = blocks[reach.any(axis=0)]
        return pd.DataFrame({"dim": page["dim"].iloc[0], "anchors": anchors["anchors"].iloc[0], "block": chosen})

    return run


def _read_blocks(same: bool, k: int, near: bool):
    """The ``k`` best rows of each ask among a lane's blocks."""
    def run(anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = {"place": [], "no": [], "id": [], "score": []}
        if len(anchors) and len(blocks):
            asks = Asks(anchors)
            low = asks.low.copy()
            kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)
            for row in blocks.itertuples():
                ids, places, labels = np.asarray(row.ids), np.asarray(row.places), np.asarray(row.labels)
                scores = products(asks.vectors, np.asarray(row.values, np.float64).reshape(len(ids), -1))
                for a in np.flatnonzero(asks.near(row.block) == near):
                    at, s = asks.of[a], scores[asks.of[a]]
                    ok = (s >= low[a]) & (s <= asks.high[a]) & ((labels == asks.labels[at]) == same) & (places != asks.places[at])
                    if not ok.any():
                        continue
                    s, i = np.append(kept[a][0], s[ok]), np.append(kept[a][1], ids[ok])
                    best = np.lexsort((i, -s))[:k]
                    kept[a] = s[best], i[best]
                    if len(best) == k:
                        low[a] = max(low[a], s[best[-1]])
            for a, (s, i) in enumerate(kept):
                out["place"].append(np.full(len(s), asks.places[asks.of[a]]))
                out["no"].append(np.full(len(s), asks.no[a]))
                out["id"].append(i)
                out["score"].append(s)
        return pd.DataFrame({name: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64) for name, parts in out.items()})

    return run


def _read(anchors: DataFrame, requests: DataFrame, blocks: DataFrame, same: bool, k: int, near: bool) -> DataFrame:
    """(place, no, id, score): what the asks of ``anchors`` find in the blocks of ``requests`` (dim, anchors, block)."""
    lanes = requests.withColumn("lane", F.floor(F.col("block") / LANE))
    held = lanes.join(blocks.select("dim", "block", "ids", "places", "labels", "values"), ["dim", "block"])
    asked = anchors.join(lanes.select("dim", "anchors", "lane").distinct(), ["dim", "anchors"])
    key = ["dim", "anchors", "lane"]
    # Both sides descend from one frame; new column ids tell them apart.
    return asked.groupBy(*key).cogroup(held.toDF(*held.columns).groupBy(*key)).applyInPandas(
        _read_blocks(same, k, near), "place long, no long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place", "no").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(anchors: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """(place, no, rank, id, score): the ``k`` best rows of every ask of ``anchors``
    (dim, anchors, place, block, label, v, asks), asks being (no, low, high)."""
    around = F.sequence(F.col("block") - NEAR, F.col("block") + NEAR)
    first = materialize(_best(_read(
        anchors, anchors.select("dim", "anchors", F.explode(around).alias("block")).distinct(), blocks, same, k, True), k))
    # Where an ask has k results, only scores from the last of them on still matter.
    reached = first.filter(F.col("rank") == k).select("place", "no", F.col("score").alias("_least"))
    flat = anchors.select("place", F.inline("asks")).join(reached, ["place", "no"], "left").groupBy("place").agg(
        F.collect_list(F.struct("no", F.greatest("low", "_least").alias("low"), "high")).alias("asks"))
    left = materialize(anchors.drop("asks").join(flat, "place").select(*anchors.columns))
    groups = left.agg(F.max("anchors")).first()[0]
    if groups is None:
        return first.select("place", "no", "rank", "id", "score")
    pages = blocks.select("dim", "page", "block", "lo", "hi", "kinds", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(groups).cast("long"))).alias("anchors"))
    listed = left.join(pages.select("dim", "anchors", "page").distinct(), ["dim", "anchors"])
    key = ["dim", "anchors", "page"]
    requests = materialize(pages.groupBy(*key).cogroup(listed.toDF(*listed.columns).groupBy(*key)).applyInPandas(
        _wanted_blocks(same), "dim int, anchors long, block long"))
    rest = _read(left, requests, blocks, same, k, False)
    return _best(first.select("place", "no", "id", "score").unionByName(rest), k).select("place", "no", "rank", "id", "score")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` (id, label, vector); ``is_anchor`` is a condition on ``id``. Scores are inner products of
    the vectors' components times ``scale``, rounded down. ``low`` and ``high`` are percents.
    """
    clean = rows.filter("id is not null and label is not null").filter(usable(F.col("vector"))).select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole(F.col("vector"), scale).alias("v"))
    placed = materialize(on_curve(clean, block_rows))
    blocks = candidate_blocks(placed)
    chosen = ordered_index(placed.filter(is_anchor), ["dim", "place"], "_no").withColumn(
        "anchors", F.floor(F.col("_no") / ANCHOR_ROWS)).drop("_no")
    chosen = materialize(chosen.select("dim", "anchors", "place", "block", "id", "label", "v"))
    asking = ["dim", "anchors", "place", "block", "label", "v", "asks"]
    everything = F.struct(F.lit(0).cast("long").alias("no"), F.lit(-(1 << 63)).cast("long").alias("low"), F.lit((1 << 63) - 1).cast("long").alias("high"))
    near = materialize(_search(chosen.withColumn("asks", F.array(everything)).select(*asking), blocks, True, positives))
    share = lambda percent: F.col("score").cast("decimal(20,0)") * percent / 100
    windows = near.select(
        "place", F.col("rank").cast("long").alias("no"), F.ceil(share(low)).cast("long").alias("low"),
        F.floor(share(high)).cast("long").alias("high")).filter("low <= high").groupBy("place").agg(
        F.collect_list(F.struct("no", "low", "high")).alias("asks"))
    far = _search(materialize(chosen.join(windows, "place").select(*asking)), blocks, False, negatives)
    pairs = near.select("place", F.col("rank").cast("long").alias("no"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["place", "no"]).join(
        chosen.select("place", F.col("id").alias("anchor_id")), "place").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
