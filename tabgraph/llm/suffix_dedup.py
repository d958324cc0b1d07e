"""Removal of long repeated byte strings with a sparse, range-partitioned suffix array.

A byte goes if any ``LENGTH``-byte string that covers it also starts anywhere else.

Only suffixes at anchors are sorted. The anchor of a ``LENGTH``-byte window is its smallest
``GRAM``-byte hash (the leftmost of equals): a function of the window's bytes alone, so equal
windows have equal anchors at equal offsets, and no repeat is missed. Neighbouring windows share
anchors, about one in 77 bytes. All windows of one anchor form its context, under 400 bytes.

1. Grams that occur once, nearly all, end there. Where a repeated gram has a single context,
   every window of it repeats, and nothing more is compared.
2. The other distinct contexts become suffixes, range-partitioned by sampled splitters over
   their leading bytes. A gram with more than ``RUN_MAX`` contexts, such as the edge of a
   passage shared by a third of all texts, is dealt over many buckets by what precedes it and, behind
   a header that all share, by what follows.
3. A bucket sorts its suffixes by multikey quicksort, and what precedes them, read backwards, as
   well. A window that begins ``o`` bytes before two anchors is the same where the suffixes share
   ``LENGTH - o`` bytes and their left sides ``o``: cutting either order wherever neighbours have a
   shorter common prefix leaves classes, and a window repeats if another one is in both of its
   classes. So repeats come from the common prefixes of neighbours, byte by byte.
4. A run dealt over several buckets compares across their boundaries by a shuffle on its distinct
   windows, named by hashes modulo two primes.

Texts whose rows no repeat touches are never shuffled (a fixed-size bitmap sorts them out).

Defined cases: null text counts as empty; texts under ``LENGTH`` bytes lose nothing; rows equal
in doc_id and text are copies of each other, so both lose what they share; null doc_ids are
rows like others; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgraph.distributed import materialize
from tabgraph.llm.bitmap import bitmap, thinned
from tabgraph.llm.bytescan import Chunk, chunks, mix, powers, span_hashes

LENGTH, GRAM = 200, 48
WINDOW = LENGTH - GRAM + 1
#: Runs of more contexts are dealt over several buckets; either way all windows are compared.
RUN_MAX = 4096
#: Suffixes of a bucket, about; each takes some 400 bytes.
BUCKET = 1 << 18
#: Long texts are anchored in pieces of this many windows.
PIECE = 1 << 18
_POSITION = np.uint64((1 << 24) - 1)
_TOKEN = 8


def _pieces(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text offsets, text numbers, position of each text's first byte); pieces overlap."""
    if chunk.n > 1 or len(chunk.data) <= 2 * PIECE:
        yield chunk.data, chunk.offsets, np.arange(chunk.n), np.zeros(chunk.n, np.int64)
        return
    for at in range(0, len(chunk.data) - LENGTH + 1, PIECE):
        part = chunk.data[at: at + PIECE + LENGTH - 1]
        yield part, np.array([0, len(part)]), np.zeros(1, int), np.array([at])


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(keys) - width + 1
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def _anchors(data: np.ndarray, offsets: np.ndarray):
    """(text, anchor, first window, last window, gram hash, context hash) of a buffer of texts."""
    if len(data) < LENGTH:
        return None
    prefix = np.zeros(len(data) + 1, np.uint64)
    up, down = powers(len(data) + 1)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    # Gram hashes only pick anchors and bring contexts together; what is equal is decided elsewhere.
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(data) - GRAM + 1])
    keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    least = (_sliding_min(keys, WINDOW) & _POSITION).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not counts.any():
        return None
    text = np.repeat(np.arange(len(counts)), counts)
    window = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][text]
    anchor = least[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    first, last = window[begin], window[np.append(begin[1:], len(window)) - 1]
    anchor = anchor[begin]
    context = span_hashes(Chunk(0, data, offsets).prefix(), first, last + LENGTH)
    place = ((anchor - first) << 8 | (anchor - last)).astype(np.uint64)
    return text[begin], anchor, first, last, grams[anchor], mix(context + place)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column(1)):
            for data, offsets, texts, origin in _pieces(chunk):
                found = _anchors(data, offsets)
                if found is None:
                    continue
                text, anchor, first, last, gram, context = found
                at = (anchor - offsets[:-1][text] + origin[text]) << 16 | (anchor - first) << 8 | (anchor - last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[chunk.first + texts[text]]), pa.array(gram.view(np.int64)),
                     pa.array(context.view(np.int64)), pa.array(at)], ["key", "gram", "context", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts as (gram, context, copies, back, near, right, left, dealt); ``left`` runs backwards."""
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        rows = batch.to_pydict()
        out = {name: [] for name in _CUT.names}
        for text, wanted in zip(rows["text"], rows["wanted"]):
            for w in wanted:
                anchor, back, near = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                for name, value in (("gram", w["gram"]), ("context", w["context"]), ("copies", w["copies"]),
                                    ("back", back), ("near", near), ("right", text[anchor: anchor + LENGTH - near]),
                                    ("left", text[anchor - back: anchor][::-1]), ("dealt", w["dealt"])):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, _CUT)


_CUT = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("copies", pa.int64()), ("back", pa.int32()),
                  ("near", pa.int32()), ("right", pa.binary()), ("left", pa.binary()), ("dealt", pa.bool_())])
_FOUND = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("copies", pa.int64()), ("low", pa.int32()),
                    ("high", pa.int32()), ("window", pa.int64())])


def multikey_quicksort(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows of a (suffix x token) array: three-way splits, one token deeper on ties."""
    order = np.arange(len(tokens))
    work = [(0, len(tokens), 0)]
    while work:
        low, high, depth = work.pop()
        if high - low < 2 or depth == tokens.shape[1]:
            continue
        part = order[low:high]
        if high - low <= 64:
            order[low:high] = part[np.lexsort(tokens[part, depth:].T[::-1])]
            continue
        column = tokens[part, depth]
        pivot = np.partition(column[:: max(1, len(column) // 9)], 4)[4] if len(column) >= 9 else column[0]
        less, same = column < pivot, column == pivot
        split = [part[less], part[same], part[~less & ~same]]
        order[low:high] = np.concatenate(split)
        a, b = low + len(split[0]), low + len(split[0]) + len(split[1])
        work += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column as rows of ``width``, zero-padded, and their sizes."""
    parts = list(chunks(column))
    size = np.concatenate([np.diff(c.offsets) for c in parts])
    rows = np.zeros((len(size), width), np.uint8)
    rows[np.arange(width) < size[:, None]] = np.concatenate([c.data for c in parts])
    return rows, size


def _shared(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it; the first has none."""
    out = np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeated_windows(right: np.ndarray, left: np.ndarray, back: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset at which each context's window stands in another context as well (255, -1: none).

    ``right`` (contexts x bytes) in suffix order, ``left`` reads backwards from the anchors; a context has
    the windows that begin ``near`` to ``back`` bytes before its anchor.
    """
    shared = _shared(right)
    by_left = multikey_quicksort(left.view(">u8").astype(np.uint64))
    behind = _shared(left[by_left])
    low, high = np.full(len(right), 255), np.full(len(right), -1)
    left_class = np.empty(len(right), np.int64)
    for offset in range(int(near.min(initial=0)), int(back.max(initial=-1)) + 1):
        have = np.flatnonzero((near <= offset) & (back >= offset))
        # Neighbours with a shorter common prefix part the classes.
        left_class[by_left] = np.cumsum(behind < offset)
        pair = np.cumsum(shared < LENGTH - offset)[have] * (len(right) + 1) + left_class[have]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twin = np.zeros(len(have), bool)
        twin[1:] |= same
        twin[:-1] |= same
        hit = have[order[twin]]
        low[hit] = np.minimum(low[hit], offset)
        high[hit] = offset
    return low, high


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that repeat inside the bucket, and the distinct windows of dealt runs for comparison across buckets."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    gram, context, copies, back, near = (table.column(i).to_numpy() for i in range(5))
    dealt = table.column(7).to_numpy(zero_copy_only=False)
    right, _ = _padded(table.column(5).combine_chunks(), -(-LENGTH // _TOKEN) * _TOKEN)
    left, _ = _padded(table.column(6).combine_chunks(), -(-WINDOW // _TOKEN) * _TOKEN)
    order = multikey_quicksort(right.view(">u8").astype(np.uint64))
    # A run: neighbours in suffix order that agree on the whole gram.
    bounds = np.flatnonzero(_shared(right[order]) < GRAM)
    whole = copies[order] >= 2
    # Whole runs at a time, about 2^14 suffixes.
    at = 0
    while at < len(order):
        to = int(np.searchsorted(bounds, at + (1 << 14), "left"))
        to = int(bounds[to]) if to < len(bounds) else len(order)
        rows = order[at:to]
        low, high = repeated_windows(right[rows], np.ascontiguousarray(left[rows]), back[rows], near[rows])
        full = whole[at:to]
        low[full], high[full] = near[rows][full], back[rows][full]
        yield _found(gram[rows], context[rows], copies[rows], low, high, high >= 0, None)
        across = rows[dealt[rows]]
        for part in (across[i: i + 4096] for i in range(0, len(across), 4096)):
            windows, owner, offset = _windows(right[part], left[part], back[part], near[part])
            # The same gram, offset and bytes. One row stands for all equal windows here, with their number.
            windows = mix(mix(gram[part][owner].view(np.uint64) + offset.astype(np.uint64)) + windows)
            _, one, group = np.unique(windows, return_index=True, return_inverse=True)
            times = np.bincount(group, copies[part][owner]).astype(np.int64)
            keep = np.ones(len(one), bool)
            yield _found(gram[part][owner[one]], context[part][owner[one]], times, offset[one], offset[one], keep, windows[one].view(np.int64))
        at = to


def _found(gram, context, copies, low, high, keep, window) -> pa.RecordBatch:
    none = pa.nulls(int(keep.sum()), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(gram[keep]), pa.array(context[keep]), pa.array(copies[keep]), pa.array(low[keep].astype(np.int32)),
         pa.array(high[keep].astype(np.int32)), none if window is None else pa.array(window[keep])], schema=_FOUND)


def _windows(right: np.ndarray, left: np.ndarray, back: np.ndarray, near: np.ndarray):
    """Hash, owner and offset of every window of some contexts."""
    width = left.shape[1]
    joined = np.concatenate([left[:, ::-1], right], axis=1)
    prefix = Chunk(0, joined.reshape(-1), np.array([0, joined.size])).prefix()
    counts = (back - near + 1).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    offset = back[owner].astype(np.int64) - (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    first = owner * joined.shape[1] + width - offset
    return span_hashes(prefix, first, first + LENGTH), owner, offset


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
        columns = batch.to_pydict()
        removed, spans, digests, kept = [], [], [], []
        for text, starts in zip(columns["text"], columns["spans"]):
            runs = merged(starts or [])
            rest = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(text)]))
            removed.append(len(text) - len(rest))
            spans.append(len(runs))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t) for t in columns["text"]], pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def merged(packed: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of intervals packed as start << 16 | length."""
    runs: list[list[int]] = []
    for start, end in sorted((p >> 16, (p >> 16) + (p & 0xFFFF)) for p in packed):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(s, e) for s, e in runs]


def in_buckets(suffixes: DataFrame, parts: int) -> DataFrame:
    """Suffixes range-partitioned by sampled splitters: runs stay whole, dealt ones split by left and right."""
    split = lambda side: F.when(F.col("dealt"), F.col(side))
    return suffixes.repartitionByRange(parts, F.substring("right", 1, GRAM), split("left"), split("right"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(key, span) of every repeated stretch of ``texts`` (key long, text binary); span is start << 16 | length."""
    sketch = texts.mapInArrow(_sketch, "key long, gram long, context long, at long")
    grams = sketch.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).filter("n > 1")
    # Written first, so that the join has two plain exchanges and a hot gram is split.
    grams = materialize(grams.select("gram", (F.col("low") < F.col("high")).alias("several")))
    several = materialize(sketch.join(grams, "gram"))
    contexts = several.filter("several").groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"), F.min_by("at", "key").alias("at"))
    dealt = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("run")).filter(F.col("run") > RUN_MAX).select(
        "gram", F.lit(True).alias("dealt"))
    contexts = contexts.join(dealt, "gram", "left").withColumn("dealt", F.coalesce("dealt", F.lit(False)))
    wanted = materialize(contexts.groupBy("key").agg(
        F.collect_list(F.struct("gram", "context", "copies", "at", "dealt")).alias("wanted")))
    suffixes = thinned(texts, "key", bitmap(wanted, "key")).dropDuplicates(["key"]).join(wanted, "key").select(
        "text", "wanted").mapInArrow(_cut, "gram long, context long, copies long, back int, near int, right binary, left binary, dealt boolean")
    # A bucket is held whole by one task, so their number follows that of the suffixes.
    number = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-number // BUCKET))
    found = materialize(in_buckets(suffixes, parts).mapInArrow(
        _sort_bucket, "gram long, context long, copies long, low int, high int, window long"))
    across = found.filter("window is not null")
    shared = across.groupBy("window").agg(F.sum("copies").alias("n")).filter("n > 1").select("window")
    stretch = found.filter("window is null").select("gram", "context", "low", "high").union(
        across.join(shared, "window").select("gram", "context", "low", "high")
    ).groupBy("gram", "context").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    stretch = materialize(stretch)
    anchor = F.shiftright("at", 16)
    back, near = F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    span = lambda low, high: (F.shiftleft(anchor - high, 16) + (high - low + LENGTH)).alias("span")
    simple = several.filter("not several").select("key", span(near, back))
    return simple.union(several.filter("several").join(stretch, ["gram", "context"]).select(
        "key", span(F.col("low").cast("long"), F.col("high").cast("long"))))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs`` (doc_id, text).

    ``kept`` is binary: cuts need not fall between characters.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))
    spans = materialize(repeated_spans(rows.select("key", "text")).groupBy("key").agg(F.collect_set("span").alias("spans")))
    touched = bitmap(spans, "key")
    none = F.lit(0).cast("long")
    clean = thinned(rows, "key", touched, inverse=True).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = thinned(rows, "key", touched).join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(
        _removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return clean.union(cut)
