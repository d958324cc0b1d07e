"""Ranked lexical search: every document is scanned with an automaton of all the items' terms.

The items' distinct terms make one Aho-Corasick automaton. Each term stands in it between guards
(spaces), and a document's separators become spaces, so a hit is a whole term and never a part of
one. A document is scanned once per pass over its whole text: term frequencies come straight from
the automaton, no document is indexed, and each term's postings lead from a hit to the items that
ask for it.

Pass one counts documents, terms and the documents that hold each item term; from these come the
weights. Pass two scores, and every task keeps only the best ``k`` documents of each item, so what
is shuffled does not grow with the documents a task reads.

Items are dealt to blocks of about ``BLOCK_CHARS`` characters. A block's automaton is what is
broadcast, and that size is its bound; each block scans all documents.

Terms are the maximal runs of letters, digits and characters beyond ASCII; only A-Z are lowered.
For an item, a term of weight w that it holds c times and the document tf times adds
``c * w * ((10^9 * tf) div (1000 * tf + 8 * m))``, with m = 25 + (75 * n * N) div L.

Defined cases: null texts have no terms, and documents without terms count nowhere; rows that
repeat an item_id are one item with all their terms; each row of ``docs`` is a document of its own,
also when its doc_id repeats or is null (nulls come last among equal scores); an item none of whose
terms occurs has no result; empty tables give an empty result; extra columns are dropped.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabgraph.distributed import materialize, running_totals
from tabgraph.llm.bytescan import chunks

#: Characters of item text per automaton; an item is never cut.
BLOCK_CHARS = 1 << 22
#: Lanes over which the tasks' best rows of one item are ranked first.
LANES = 64
#: Bytes to their scanned form: separators become spaces, A-Z become small, all else stays.
_SCANNED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): the terms of each item with their repeats."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    words = F.split(lowered, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    return items.select("item_id", F.explode(words).alias("term")).filter("term <> ''").groupBy("item_id", "term").agg(
        F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Terms:
    """A block's distinct terms, and flat postings: term t leads to items[starts[t]:starts[t + 1]]."""

    terms: tuple[str, ...]
    starts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray
    n_items: int

    @classmethod
    def of(cls, rows: list[tuple[int, str, int]]) -> "Terms":
        """From rows (item number, term, repeats)."""
        terms = tuple(sorted({t for _, t, _ in rows}))
        place = {t: i for i, t in enumerate(terms)}
        at = np.array([place[t] for _, t, _ in rows], np.int64)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(terms) + 1))
        items = np.array([i for i, _, _ in rows], np.int64)
        repeats = np.array([n for _, _, n in rows], np.int64)
        return cls(terms, starts, items[order], repeats[order], int(items.max(initial=-1)) + 1)


@lru_cache(maxsize=1)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Guarded terms; text and terms are UTF-8 bytes read as Latin-1, a character for a byte."""
    made = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        made.add_word(f" {term.encode().decode('latin-1')} ", number)
    made.make_automaton()
    return made


def _scanned(batches: Iterator[pa.RecordBatch], terms: tuple[str, ...]) -> Iterator[tuple[pa.Array, int, int, np.ndarray, np.ndarray]]:
    """Per document with terms: its id array and row, its number of terms, and its hits as term numbers and frequencies."""
    automaton = _automaton(terms) if terms else None
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for chunk in chunks(texts):
            data = chunk.data.tobytes().translate(_SCANNED)
            bounds = chunk.offsets.tolist()
            for k in range(chunk.n):
                text = data[bounds[k]: bounds[k + 1]]
                n = len(text.split())
                if not n:
                    continue
                hits = Counter(map(itemgetter(1), automaton.iter(f" {text.decode('latin-1')} "))) if automaton else {}
                count = len(hits)
                yield (ids, chunk.first + k, n, np.fromiter(hits.keys(), np.int64, count), np.fromiter(hits.values(), np.int64, count))


def _count(batches: Iterator[pa.RecordBatch], terms: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A task's statistics: a row per term it met (term, documents, 0), and one (-1, documents, terms)."""
    held, documents, total = np.zeros(len(terms), np.int64), 0, 0
    for _, _, n, found, _ in _scanned(batches, terms):
        held[found] += 1
        documents, total = documents + 1, total + n
    met = np.flatnonzero(held)
    yield pa.RecordBatch.from_pydict({
        "term": pa.array(np.append(met, -1)), "documents": pa.array(np.append(held[met], documents)),
        "terms": pa.array(np.append(np.zeros(len(met), np.int64), total))})


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each item, by score, then doc_id."""
    rows = rows.take(pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
    item = rows["item"].to_numpy()
    place = np.arange(len(item)) - np.searchsorted(item, item, "left")
    return rows.filter(pa.array(place < k))


def _score(batches: Iterator[pa.RecordBatch], block: Terms, weights: np.ndarray, n_documents: int, n_terms: int,
           k: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A task's ``k`` best documents of each item: (item, score, doc_id)."""
    schema = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("doc_id", id_type)])
    kept, least = schema.empty_table(), np.ones(block.n_items, np.int64)
    pending: list[tuple[np.ndarray, np.ndarray, pa.Array, int]] = []
    size = 0

    def settle() -> None:
        """Merge what is pending into the best rows, and learn each item's least score that still matters."""
        nonlocal kept, size
        if pending:
            items = pa.array(np.concatenate([p[0] for p in pending]))
            scores = pa.array(np.concatenate([p[1] for p in pending]))
            ids = pa.chunked_array([p[2].take(pa.array(np.full(len(p[0]), p[3]))) for p in pending], id_type)
            kept = _best(pa.concat_tables([kept, pa.table([items, scores, ids], schema=schema)]).combine_chunks(), k)
            item, score = kept["item"].to_numpy(), kept["score"].to_numpy()
            full = np.bincount(item, minlength=block.n_items) == k
            lowest = np.full(block.n_items, np.iinfo(np.int64).max)
            np.minimum.at(lowest, item, score)
            least[full] = lowest[full]
        pending.clear()
        size = 0

    for ids, row, n, found, tf in _scanned(batches, block.terms):
        if not len(found):
            continue
        m = 25 + (75 * n * n_documents) // n_terms
        gain = weights[found] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        sizes = block.starts[found + 1] - block.starts[found]
        at = np.arange(sizes.sum()) + np.repeat(block.starts[found] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        scores = np.zeros(block.n_items, np.int64)
        np.add.at(scores, block.items[at], block.repeats[at] * np.repeat(gain, sizes))
        items = np.flatnonzero(scores >= least)
        if len(items):
            pending.append((items, scores[items], ids, row))
            size += len(items)
            if size > 200_000 or len(pending) > 2_000:
                settle()
    settle()
    yield from kept.to_batches()


def _search_block(texts: DataFrame, rows: list[tuple[int, str, int]], k: int) -> DataFrame:
    """(item, score, doc_id) of one block's items; rows (item number, term, repeats) within the block's bound."""
    spark = texts.sparkSession
    block = Terms.of(rows)
    held = spark.sparkContext.broadcast(block)
    # At most one row per term of the block comes back.
    stats = texts.mapInArrow(lambda b: _count(b, held.value.terms), "term long, documents long, terms long").groupBy("term").agg(
        F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()
    n_documents, n_terms = next(((r.documents, r.terms) for r in stats if r.term < 0), (0, 0))
    weights = np.zeros(len(block.terms), np.int64)
    for r in stats:
        if r.term >= 0:
            weights[r.term] = math.floor(1000 * math.log((2 * n_documents + 2) / (2 * r.documents + 1)))
    id_type = texts.schema["doc_id"].dataType
    arrow = to_arrow_type(id_type)
    best = texts.mapInArrow(
        lambda b: _score(b, held.value, weights, n_documents, n_terms, k, arrow),
        f"item long, score long, doc_id {id_type.simpleString()}")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # The tasks' best rows of an item meet in lanes first, so no task ranks what all tasks kept.
    lane = Window.partitionBy("item", "_lane").orderBy(*order)
    best = best.withColumn("_lane", F.spark_partition_id() % LANES).withColumn(
        "_r", F.row_number().over(lane)).filter(F.col("_r") <= k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(
        F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents (doc_id, text) that score highest for each item (item_id, text)."""
    texts = docs.select("doc_id", "text")
    asked = materialize(item_terms(items.select("item_id", "text")))
    sizes = asked.groupBy("item_id").agg(F.sum(F.length("term") + 1).alias("size"))
    numbered = materialize(running_totals(sizes, ["item_id"], {"upto": F.col("size"), "item": F.lit(1)}).select(
        "item_id", (F.col("item") - 1).alias("item"), F.floor((F.col("upto") - F.col("size")) / block_chars).alias("block")))
    first = {r.block: r.item for r in numbered.groupBy("block").agg(F.min("item").alias("item")).collect()}
    found = None
    for block, offset in sorted(first.items()):
        rows = [(r.item - offset, r.term, r.n) for r in numbered.filter(F.col("block") == block).alias("i").join(
            asked.alias("a"), F.col("i.item_id").eqNullSafe(F.col("a.item_id"))).select("item", "term", "n").collect()]
        part = _search_block(texts, rows, k).withColumn("item", F.col("item") + offset)
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], none)
    return found.join(numbered.select("item_id", "item"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
