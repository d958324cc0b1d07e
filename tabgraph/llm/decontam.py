"""Benchmark decontamination by spaced seeds.

Each mask reads ``SPAN`` consecutive words and ignores fixed positions, so a hit survives
substituted words at the ignored places. Seeds of test items and of documents are joined; every
hit fixes an alignment (document position minus item position), along which whole texts are
compared word by word. An alignment counts where, between its outermost agreeing words, a
stretch of the item has at least ``LEAST`` agreeing words and ``PERCENT`` percent agreement (an
item shorter than ``LEAST`` words must agree on ``PERCENT`` percent of all its words).

Words are maximal runs of letters, digits and bytes beyond ASCII, with A-Z lowered. Documents'
seeds are thinned by a fixed-size bitmap of the items' seeds before anything is shuffled; the
join decides. Items of any number are handled: only their seeds' bitmap is broadcast.

Defined cases: null and empty texts hold nothing; items under four words match nothing (a word or
two would be found in clean documents everywhere); equal items are reported each; rows without a doc_id are reported with a null one; repeated doc_ids are compared as one row each and reported once; empty
tables give empty results; extra columns are dropped by ``overlaps``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgraph.distributed import materialize
from tabgraph.llm.bitmap import bitmap, has, thinned, without
from tabgraph.llm.bytescan import LOWER, Chunk, chunks, mix, span_hashes

LEAST, PERCENT = 13, 80
#: Word positions each mask reads; 0 marks an ignored position. Fixed values. The first four serve
#: items of any length, the others only those under ``LEAST`` words.
MASKS = ("1101011", "1110101", "1011101", "1111", "11011", "10111", "11101")


def masks_for(words: int) -> list[int]:
    """Numbers of the masks that an item of so many words is looked for with."""
    if words >= LEAST:
        return [0, 1, 2, 3]
    return [i for i, mask in enumerate(MASKS) if len(mask) <= words]


@lru_cache(maxsize=None)
def least_hits(words: int) -> int:
    """The fewest seeds that any overlap that counts has on its alignment, for an item of so many words.

    By enumeration: a longer overlap holds a stretch of ``LEAST`` agreeing words at ``PERCENT`` percent,
    which begins and ends with an agreeing word.
    """
    need = LEAST if words >= LEAST else -(-PERCENT * words // 100)
    longest = 100 * need // PERCENT if words >= LEAST else words
    fewest = 1 << 30
    for size in range(need, longest + 1):
        for gone in combinations(range(size), size - need):
            same = [i not in gone for i in range(size)]
            hits = sum(all(same[at + k] for k, read in enumerate(MASKS[m]) if read == "1")
                       for m in masks_for(words) for at in range(size - len(MASKS[m]) + 1))
            fewest = min(fewest, hits)
    return fewest


#: Bytes that separate words.
_BREAK = np.ones(256, bool)
for _range in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAK[slice(*_range)] = False
_BLANK = np.where(_BREAK, 32, LOWER).astype(np.uint8)


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's words, and word offsets of its texts."""
    data = _BLANK[chunk.data]
    starts, ends, of_text = chunk.words(data)
    return span_hashes(chunk.prefix(data), starts, ends), of_text


def seeds(words: np.ndarray, of_text: np.ndarray, masks: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per mask its number, the seed hashes and their word positions; no seed crosses texts."""
    text = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))
    for number in masks:
        mask = MASKS[number]
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        made = np.full(n, np.uint64(number + 1))
        for k, read in enumerate(mask):
            if read == "1":
                made = made * np.uint64(0xD6E8FEB86659FD93) + words[k: k + n]
                made ^= made >> np.uint64(32)
        inside = np.flatnonzero(text[:n] == text[len(mask) - 1:])
        yield number, mix(made[inside]), inside


def _seed_rows(batches: Iterator[pa.RecordBatch], masks: list[int], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, seed, at): the documents' seeds that some item may have."""
    for batch in batches:
        key = batch.column(0)
        for chunk in chunks(batch.column(1)):
            words, of_text = word_hashes(chunk)
            for _, made, at in seeds(words, of_text, masks):
                keep = has(wanted, made)
                made, at = made[keep], at[keep]
                text = np.searchsorted(of_text, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(chunk.first + text)), pa.array(made.view(np.int64)), pa.array(at - of_text[text])],
                    ["key", "seed", "at"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seed, at, mask, words): the seeds of items by the masks that fit their length."""
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            hashes, of_text = word_hashes(chunk)
            size = np.diff(of_text)
            for number, made, at in seeds(hashes, of_text, list(range(len(MASKS)))):
                text = np.searchsorted(of_text, at, "right") - 1
                fits = np.array([number in masks_for(n) for n in size[text].tolist()], bool)
                made, at, text = made[fits], at[fits], text[fits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(chunk.first + text)), pa.array(made.view(np.int64)), pa.array(at - of_text[text]),
                     pa.array(np.full(len(at), number)), pa.array(size[text])], ["key", "seed", "at", "mask", "words"])


def agreeing_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, agreeing) of the stretch with most agreeing words among those with
    ``PERCENT`` percent agreement; the leftmost of equals."""
    hits = np.flatnonzero(same)
    if not len(hits):
        return 0, 0, 0
    # A stretch begins and ends at hits; hit i to hit j agrees in j - i + 1 of hits[j] - hits[i] + 1
    # words. With v = 100 * rank - PERCENT * place, it qualifies where v[j] - v[i] >= PERCENT - 100.
    v = 100 * np.arange(len(hits)) - PERCENT * hits
    # The earliest i for each j: the first running minimum that is low enough.
    low = np.minimum.accumulate(v)
    first = np.searchsorted(-low, -(v + 100 - PERCENT), "left")
    counts = np.arange(len(hits)) - first + 1
    j = int(counts.argmax())
    return int(hits[first[j]]), int(hits[j]) + 1, int(counts[j])


def _words_of(text: bytes) -> np.ndarray:
    chunk = next(chunks(pa.array([text], pa.binary())))
    return word_hashes(chunk)[0]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64).to_pydict()
            out = {"key": [], "item": [], "begin": [], "end": [], "agreeing": [], "item_words": []}
            for key, text, wanted in zip(rows["key"], rows["text"], rows["wanted"]):
                words, items = _words_of(text), {}
                for w in wanted:
                    if w["item"] not in items:
                        items[w["item"]] = _words_of(w["item_text"])
                    item = items[w["item"]]
                    best = (0, 0, 0, 0)
                    for shift in w["shifts"]:
                        low, high = max(0, -shift), min(len(item), len(words) - shift)
                        if high <= low:
                            continue
                        begin, end, agreeing = agreeing_stretch(words[low + shift: high + shift] == item[low:high])
                        best = max(best, (agreeing, -(begin + low + shift), end + low + shift, len(item)))
                    need = LEAST if len(item) >= LEAST else -(-PERCENT * len(item) // 100)
                    if best[0] >= max(need, 1):
                        for name, value in zip(out, (key, w["item"], -best[1], best[2], best[0], best[3])):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([(n, pa.int64()) for n in out]))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, begin, end, agreeing, item_words): the best overlap of each document and item.

    ``docs`` (doc_id, text), ``items`` (item_id, text); begin and end are word positions in the
    document. Nothing that counts is missed: with one disagreement in five words at most, 13
    agreeing words hold four in a row, which a mask reads, and shorter items have masks of their
    own. An alignment with fewer seeds than any overlap that counts has (:func:`least_hits`) goes
    before a text is joined, so a phrase that many items and documents share costs its seeds only.
    """
    tests = materialize(items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn(
        "item", F.xxhash64("item_id", "text")))
    item_seeds = materialize(tests.select("item", "text").dropDuplicates(["item"]).mapInArrow(
        _item_seeds, "key long, seed long, at long, mask long, words long").select(
        F.col("key").alias("item"), "seed", F.col("at").alias("item_at"), "mask", "words"))
    masks = sorted(r[0] for r in item_seeds.select("mask").distinct().collect())
    wanted = bitmap(item_seeds, "seed")
    enough = F.create_map(*[F.lit(x) for n in range(4, LEAST + 1) for x in (n, least_hits(n))])[F.least("words", F.lit(LEAST).cast("long")).cast("int")]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))
    hits = texts.select("key", "text").mapInArrow(lambda b: _seed_rows(b, masks, wanted), "key long, seed long, at long")
    # Alignments of a pair combine before the shuffle.
    pairs = hits.join(item_seeds, "seed").groupBy("key", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.count(F.lit(1)).alias("n"), F.min("words").alias("words")).filter(F.col("n") >= enough)
    shifts = pairs.groupBy("key", "item").agg(F.collect_list("shift").alias("shifts"))
    named = shifts.join(tests.select("item", F.col("text").alias("item_text")).dropDuplicates(["item"]), "item")
    due = materialize(named.groupBy("key").agg(F.collect_list(F.struct("item", "item_text", "shifts")).alias("wanted")))
    met = thinned(texts, "key", bitmap(due, "key"))
    found = met.select("key", "text").dropDuplicates(["key"]).join(due, "key").select("key", "text", "wanted").mapInArrow(
        _verified, "key long, item long, begin long, end long, agreeing long, item_words long")
    back = met.select("key", "doc_id").distinct()
    return found.join(back, "key").join(tests.select("item", "item_id"), "item").select(
        "doc_id", "item_id", "begin", "end", "agreeing", "item_words")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with all their columns."""
    return without(docs, overlaps(docs, items).select("doc_id").distinct())
