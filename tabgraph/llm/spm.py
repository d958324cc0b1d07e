"""Piece encoding with seeded merge-dropout, and lossless decoding.

Merges run by an agenda: the best-ranked neighbouring pair first, the leftmost of equals. Every
candidate that comes up is skipped with probability ``dropout``, decided by a keyed hash of
(seed, variant, word, place, piece), so an encoding is reproducible and another seed gives
another segmentation. With more than one variant, a document's variant is a keyed hash of its doc_id, so
one word is cut in several ways inside one pass too. Without dropout the ids are the standard
encoding of the vocabulary.

Pieces never reach over a white-space mark or a character outside the vocabulary, so a text is
cut there into words and each word's ids are remembered by the worker, in a store of bounded
size. Characters outside the vocabulary (and a literal mark) become byte pieces.

Defined cases: null and empty texts have no ids and decode to the empty text; rows repeat as
they are; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgraph.llm.bytescan import give_back

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
DROPOUT, SEED, VARIANTS = 0.1, 17, 2
MARK = "▁"
#: A worker forgets its words before it learns those of another part of texts, once they have more characters.
STORE_CHARACTERS = 2_000_000
#: A part of texts ends with the text that fills so many bytes, or with so many texts.
PART_BYTES, PART_TEXTS = 500_000, 512
#: Words of more characters keep their agenda in a heap.
SHORT = 48
INFINITE = float("inf")
_M64 = (1 << 64) - 1


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or its values at the beginning of one twice as long as asked for."""
    return array if size <= len(array) else np.concatenate((array, np.zeros(2 * size - len(array), array.dtype)))


class Codec:
    def __init__(self, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS):
        from sentencepiece import SentencePieceProcessor

        vocabulary = SentencePieceProcessor(model_file=model)
        self.ids, self.rank, self.bytes, self.byte_id = {}, {}, [], {}
        for i in range(vocabulary.get_piece_size()):
            piece = vocabulary.id_to_piece(i)
            if vocabulary.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            elif vocabulary.is_control(i) or vocabulary.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.ids[piece] = i
                self.rank[piece] = -vocabulary.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        newline = "" if "\n" in self.ids else "\n"
        self.cut = re.compile(f" *[^ {newline}]+|\n| +")
        self._tables()
        self.limit, self.seed = int(dropout * (1 << 32)), seed
        self.variants = variants
        self.forget()

    def _tables(self) -> None:
        """Arrays for encoding many words at once: symbol of each character, merges by their two symbols, ranks."""
        size = len(self.bytes)
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        # Texts hold spaces for marks; a literal mark is no symbol.
        self.symbol[ord(" ")], self.symbol[ord(MARK)] = self.ids.get(MARK, -1), -1
        found = sorted((self.ids[piece[:k]] * size + self.ids[piece[k:]], i) for piece, i in self.ids.items()
                       for k in range(1, len(piece)) if piece[:k] in self.ids and piece[k:] in self.ids)
        self.pair_keys, self.pair_made = (np.array([f[c] for f in found] + [-1][:not found], np.int64) for c in (0, 1))
        # Ranks of a vocabulary are whole numbers or floats of 32 bits.
        self.order = np.full(size + 1, INFINITE, np.float32)
        for piece, i in self.ids.items():
            self.order[i] = self.rank[piece]

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols make; the vocabulary's size for none."""
        keys = left.astype(np.int64) * len(self.bytes) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_made[at], len(self.bytes))

    def many(self, words: list[str], variant: int = 0) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of every word, as ``_word`` gives them."""
        for part, sizes, ids in self._encoded_words(words, variant):
            ends, flat = np.cumsum(sizes).tolist(), ids.tolist()
            yield from zip(part, [flat[a:b] for a, b in zip([0, *ends], ends)])

    def _encoded_words(self, words: Iterable[str], variant: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Some of the words, how many ids each has, and the ids, by array arithmetic over words of like length."""
        rest = []
        short = sorted((w for w in words if len(w) <= SHORT or rest.append(w)), key=len)
        for at in range(0, len(short), 8192):
            part = short[at: at + 8192]
            lengths = np.array([len(w) for w in part])
            points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            symbols = np.full((len(part), int(lengths[-1]) + 1), -1, np.int32)
            inside = np.arange(symbols.shape[1]) < lengths[:, None]
            symbols[inside] = self.symbol[points]
            known = ~((symbols < 0) & inside).any(axis=1)
            if not known.all():
                rest += [w for w, k in zip(part, known) if not k]
                part, symbols, lengths = [w for w, k in zip(part, known) if k], symbols[known], lengths[known]
            if part:
                yield part, *self._many(part, symbols, lengths, variant)
        if rest:
            made = [self._word(w, variant) for w in rest]
            yield rest, np.array([len(ids) for ids in made]), np.array([i for ids in made for i in ids], np.int32)

    def _many(self, words: list[str], symbols: np.ndarray, lengths: np.ndarray, variant: int) -> tuple[np.ndarray, np.ndarray]:
        seed = (self.seed * 4096 + variant) & 0xFFFFFFFF
        key = np.array([zlib.crc32(w.encode(), seed) for w in words], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        n, width = symbols.shape
        none = len(self.bytes)
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1))
        after[np.arange(width) >= lengths[:, None] - 1] = width - 1  # the last column is the end of every word
        before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))
        made = np.full((n, width), none, np.int32)
        pairs = np.arange(width - 1) < lengths[:, None] - 1
        row, at = np.nonzero(pairs)
        made[row, at] = self._merged(symbols[row, at], symbols[row, at + 1])
        orders = self.order[made]
        # From here on cells are numbered through, and only words that still merge are kept.
        ended, who, first = np.empty_like(symbols), np.arange(n), np.arange(n) * width
        symbols, after, before, made, orders = (x.ravel() for x in (symbols, after, before, made, orders))
        while len(who):
            cell = first[: len(who)] + orders.reshape(-1, width).argmin(axis=1)
            live = np.flatnonzero(orders.take(cell) < INFINITE)
            if 2 * len(live) <= len(who):
                ended[who] = symbols.reshape(-1, width)
                who, key = who[live], key[live]
                symbols, after, before, made, orders = (x.reshape(-1, width)[live].ravel() for x in (symbols, after, before, made, orders))
                continue
            i, start = cell.take(live), first.take(live)
            piece = made.take(i)
            if self.limit:
                place = (i - start).astype(np.uint64)
                mixed = key.take(live) + place * np.uint64(0xC2B2AE3D27D4EB4F) + piece.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                skipped = (mixed >> np.uint64(32)).astype(np.int64) < self.limit
                orders[i[skipped]] = INFINITE
                i, start, piece = i[~skipped], start[~skipped], piece[~skipped]
            j = start + after.take(i)
            next_ = after.take(j)
            k = start + next_
            symbols[i], symbols[j] = piece, -1
            after[i] = next_
            orders[j] = INFINITE
            before[k] = i - start
            wider = np.full(len(i), none)
            inner = np.flatnonzero(next_ < width - 1)
            wider[inner] = self._merged(piece.take(inner), symbols.take(k.take(inner)))
            made[i], orders[i] = wider, self.order.take(wider)
            back = before.take(i)
            held = np.flatnonzero(back >= 0)
            h = start.take(held) + back.take(held)
            wider = self._merged(symbols.take(h), piece.take(held))
            made[h], orders[h] = wider, self.order.take(wider)
        kept = ended >= 0
        return kept.sum(axis=1), ended[kept]

    def learn(self, texts: list[list[str]], variants: list[int]) -> None:
        """Puts the words of some texts that are not remembered into the store, all at once."""
        if self.held > STORE_CHARACTERS:
            self.forget()
        wanted: list[set[str]] = [set() for _ in range(self.variants)]
        for words, variant in zip(texts, variants):
            wanted[variant].update(words)
        for variant, words in enumerate(wanted):
            place = self.place[variant]
            for part, n, made in self._encoded_words(words.difference(place), variant):
                count, used = self.count + len(part), self.used + len(made)
                place.update(zip(part, range(self.count, count)))
                self.sizes, self.starts = (_room(x, count) for x in (self.sizes, self.starts))
                self.ids_of_words = _room(self.ids_of_words, used)
                self.sizes[self.count: count] = n
                self.starts[self.count: count] = self.used + np.cumsum(n) - n
                self.ids_of_words[self.used: used] = made
                self.count, self.used = count, used
                self.held += sum(map(len, part))

    def forget(self) -> None:
        """Empties the word store."""
        self.place: list[dict[str, int]] = [{} for _ in range(self.variants)]
        self.sizes, self.starts, self.ids_of_words = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.count = self.used = self.held = 0

    def words(self, text: str) -> list[str]:
        return self.cut.findall(" " + text) if text else []

    def encode(self, text: str, variant: int = 0) -> list[int]:
        return self.encode_texts([self.words(text)], [variant])[0].tolist()

    def encode_texts(self, texts: list[list[str]], variants: list[int]) -> list[np.ndarray]:
        """The ids of texts that are cut into words."""
        self.learn(texts, variants)
        at, ends = [], []
        for words, variant in zip(texts, variants):
            at.extend(map(self.place[variant].__getitem__, words))
            ends.append(len(at))
        at = np.array(at, np.int64)
        sizes, starts = self.sizes.take(at), self.starts.take(at)
        upto = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.ids_of_words.take(np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1]))
        return np.split(flat, upto[ends[:-1]])

    def _word(self, word: str, variant: int) -> list[int]:
        # A literal mark may not be read as white space, so no piece may hold it.
        symbols = [MARK if c == " " else "\0" + c if c == MARK else c for c in word]
        key = zlib.crc32(word.encode(), (self.seed * 4096 + variant) & 0xFFFFFFFF) * 0x9E3779B97F4A7C15
        out = []
        for symbol in (self._short if len(symbols) <= SHORT else self._long)(symbols, key):
            if symbol in self.ids:
                out.append(self.ids[symbol])
            else:
                out += [self.byte_id[b] for b in symbol.lstrip("\0").encode() or b"\0"]
        return out

    def _skipped(self, pair: str, i: int, key: int) -> bool:
        """Whether dropout skips the merge to ``pair`` that begins at place ``i``; the place and piece decide alone."""
        mixed = (key + i * 0xC2B2AE3D27D4EB4F + self.ids[pair] * 0x165667B19E3779F9) & _M64
        return ((mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & _M64) >> 32 < self.limit

    def _short(self, symbols: list[str], key: int) -> list[str]:
        """Symbols after all merges. The agenda of a short word is the list of its candidates' ranks: the
        least comes up next, the leftmost of equals."""
        rank, limit, skipped = self.rank.get, self.limit, self._skipped
        starts = list(range(len(symbols)))
        orders = [rank(a + b, INFINITE) for a, b in zip(symbols, symbols[1:])]
        while orders:
            least = min(orders)
            if least == INFINITE:
                break
            at = orders.index(least)
            pair = symbols[at] + symbols[at + 1]
            if limit and skipped(pair, starts[at], key):
                orders[at] = INFINITE
                continue
            symbols[at] = pair
            del symbols[at + 1], orders[at], starts[at + 1]
            if at < len(orders):
                orders[at] = rank(pair + symbols[at + 1], INFINITE)
            if at:
                orders[at - 1] = rank(symbols[at - 1] + pair, INFINITE)
        return symbols

    def _long(self, symbols: list[str], key: int) -> list[str]:
        """As ``_short``, by a heap: n log n for words of any length."""
        n, rank = len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, str]] = []

        def propose(i: int, pair: str) -> None:
            if (order := rank(pair)) is not None:
                heapq.heappush(agenda, (order, i, pair))

        for i in range(n - 1):
            propose(i, symbols[i] + symbols[i + 1])
        merged: list[str | None] = list(symbols)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left, j = merged[i], after[i]
            if left is None or j >= n or left + merged[j] != pair or self.limit and self._skipped(pair, i, key):
                continue
            merged[i], merged[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                propose(i, pair + merged[k])
            if before[i] >= 0:
                propose(before[i], merged[before[i]] + pair)
        return [s for s in merged if s is not None]

    def decode(self, ids) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids])[1:].decode()


_codecs: dict[tuple, Codec] = {}


def codec(model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS) -> Codec:
    """The worker's codec; one per setting."""
    if (key := (model, dropout, seed, variants)) not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of the parts of a column of texts without nulls; what a part takes of a worker's memory
    does not grow with the length of its texts, save for a single longer text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < len(texts):
        after = min(int(np.searchsorted(ends, done + PART_BYTES)) + 1, first + PART_TEXTS, len(texts))
        yield first, after - first
        first, done = after, int(ends[after - 1])


def _encoded(batches: Iterator[pa.RecordBatch], setting: tuple) -> Iterator[pa.RecordBatch]:
    give_back()
    own = codec(*setting)
    for batch in batches:
        for at, n in parts(batch.column("text")):
            yield _encoded_part(own, batch.slice(at, n))
        del batch
        give_back()
    own.forget()
    give_back()


def _encoded_part(own: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
    texts, variants = part.column("text").to_pylist(), part.column("variant").to_pylist()
    ids = own.encode_texts([own.words(text) for text in texts], variants)
    same, digests = [], []
    for text, made in zip(texts, ids):
        same.append(own.decode(made.tolist()) == text)
        digests.append(hashlib.sha256(made.astype("<i4").tobytes()).hexdigest())
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
         pa.array(np.diff(offsets).astype(np.int64)), pa.array(digests), pa.array(same)],
        ["doc_id", "ids", "n_tokens", "ids_sha256", "lossless"])


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED,
           variants: int = VARIANTS) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, lossless) for every row of ``docs`` (doc_id, text).

    ``ids_sha256`` is taken over little-endian 32-bit ids; ``lossless`` says that decoding the
    ids gave back the text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(variants)).cast("int").alias("variant"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lambda b: _encoded(b, (model, dropout, seed, variants)),
        f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, lossless boolean")


def _decoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    own = codec(model, 0.0, 0)
    for batch in batches:
        texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decoded(b, model), f"doc_id {kind}, text string")
