"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words. The probabilities come from expectation-maximisation
(forward-backward expected counts) over the words of a bounded sample of labelled texts.

Words are split at white space and lower-cased. No piece of the vocabulary is left out and no word
is cut: the forward state runs through words of any length (only its last columns are kept, as many
as the longest piece has characters, and scaled as they shrink), so texts without white space are
scored whole as well.

Defined cases: a null text or one without a letter is ``und`` with score 0; null labels train
nothing; without any label every text is ``und``; ties go to the language first in order;
rows repeat as they are and may lack a doc_id (those draw as one id in the sample); an empty table
gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabgraph.distributed import materialize
from tabgraph.llm.bytescan import mix

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Training reads whole texts of at most this many labelled rows of each language.
SAMPLE = 600
ROUNDS = 3
#: Words of more characters are trained on in logarithms, which no length can make vanish.
SHORT = 28
#: Columns between two scalings of the forward state.
SCALED = 16
#: Mass added to every piece, and the probability of a character outside the vocabulary.
SMOOTH, UNSEEN = 0.02, 1e-8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


class Pieces:
    """Piece numbers of all substrings of many words at once, through a two-choice hash table."""

    def __init__(self, model: str = MODEL):
        from sentencepiece import SentencePieceProcessor

        vocabulary = SentencePieceProcessor(model_file=model)
        found = sorted({p for i in range(vocabulary.get_piece_size())
                        if not (vocabulary.is_byte(i) or vocabulary.is_control(i) or vocabulary.is_unknown(i))
                        and (p := vocabulary.id_to_piece(i).lower())})
        self.size = len(found)
        self.longest = max(map(len, found), default=1)
        self.pieces = found
        keys = np.zeros(len(found), np.uint64)
        for i, piece in enumerate(found):
            h = 0
            for c in piece:
                h = (h * int(_MULTIPLIER) + ord(c) + 1) & ((1 << 64) - 1)
            keys[i] = h
        keys = mix(keys)
        self.keys = np.append(keys, np.uint64(0))
        self.first = np.full(1 << _SLOTS, self.size, np.int32)
        self.second = np.full(1 << _SLOTS, self.size, np.int32)
        for i in range(self.size - 1, -1, -1):
            a, b = self._slots(keys[i: i + 1])
            if self.first[a[0]] == self.size:
                self.first[a[0]] = i
            else:
                self.second[b[0]] = i

    @staticmethod
    def _slots(keys):
        return (keys >> np.uint64(64 - _SLOTS)).astype(np.int64), (keys >> np.uint64(10)).astype(np.int64) & ((1 << _SLOTS) - 1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers, ``size`` for none."""
        a, b = self._slots(keys)
        got = self.first[a]
        wrong = np.flatnonzero(self.keys[got] != keys)
        if len(wrong):
            other = self.second[b[wrong]]
            got[wrong] = np.where(self.keys[other] == keys[wrong], other, self.size)
        return got

    def ending(self, letters: np.ndarray, end: int):
        """Yields (length, piece numbers) of every span of the words (words x characters) that ends there."""
        key = np.zeros(len(letters), np.uint64)
        step = np.uint64(1)
        for length in range(1, min(end, self.longest) + 1):
            # The hash of the span, built from its last character backwards.
            key = key + (letters[:, end - length].astype(np.uint64) + np.uint64(1)) * step
            step = np.uint64((int(step) * int(_MULTIPLIER)) & ((1 << 64) - 1))
            yield length, self.of(mix(key))

    def lattice(self, letters: np.ndarray):
        """Yields (end, length, piece numbers) for every span of the words (words x characters)."""
        for end in range(1, letters.shape[1] + 1):
            for length, found in self.ending(letters, end):
                yield end, length, found


_pieces: dict[str, Pieces] = {}


def pieces(model: str = MODEL) -> Pieces:
    if model not in _pieces:
        _pieces[model] = Pieces(model)
    return _pieces[model]


def _by_length(words: list[str]):
    """Blocks of equally long words, marked: (word numbers, code points as words x characters)."""
    marked = ["▁" + word for word in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(group):
            length = int(lengths[group[0]])
            size = max(1, min(20_000, 2_000_000 // length))
            for at in range(0, len(group), size):
                part = group[at: at + size]
                letters = np.frombuffer("".join(marked[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
                yield part, letters.reshape(len(part), length)


def log_likelihoods(words: list[str], probability: np.ndarray, model: str = MODEL) -> np.ndarray:
    """log of the summed probability of all segmentations: words x languages."""
    total = np.zeros((len(words), probability.shape[1]))
    vocabulary = pieces(model)
    for group, letters in _by_length(words):
        total[group] = _summed(vocabulary, letters, probability)
    return total


def _summed(vocabulary: Pieces, letters: np.ndarray, probability: np.ndarray) -> np.ndarray:
    size = len(probability) - 1
    state = deque([np.ones((len(letters), probability.shape[1]))], vocabulary.longest)
    scale = np.zeros_like(state[0])
    for end in range(1, letters.shape[1] + 1):
        made = np.zeros_like(scale)
        for span, found in vocabulary.ending(letters, end):
            if span == 1:
                made += state[-1] * np.where((found < size)[:, None], probability[found], UNSEEN)
            else:
                at = np.flatnonzero(found < size)
                if len(at):
                    made[at] += state[-span][at] * probability[found[at]]
        state.append(made)
        if end % SCALED == 0:
            state = deque((x / made for x in state), vocabulary.longest)
            scale += np.log(made)
    return np.log(np.maximum(state[-1], 1e-300)) + scale


def expected_counts(words: list[str], counts: np.ndarray, probability: np.ndarray, model: str = MODEL) -> np.ndarray:
    """Expected uses of every piece in words of one language (forward-backward)."""
    vocabulary = pieces(model)
    uses = np.zeros(len(probability))
    for group, letters in _by_length(words):
        step = _uses_short if letters.shape[1] <= SHORT + 1 else _uses_long
        step(vocabulary, letters, counts[group], probability, uses)
    return uses


def _uses_short(vocabulary: Pieces, letters: np.ndarray, counts: np.ndarray, probability: np.ndarray, uses: np.ndarray) -> None:
    n, length = letters.shape
    spans = [(end, span, probability[found] if span > 1 else np.where(found < vocabulary.size, probability[found], UNSEEN), found)
             for end, span, found in vocabulary.lattice(letters)]
    forward = [np.ones(n)] + [np.zeros(n) for _ in range(length)]
    for end, span, p, _ in spans:
        forward[end] += forward[end - span] * p
    backward = [np.zeros(n) for _ in range(length)] + [np.ones(n)]
    weight = counts / np.maximum(forward[length], 1e-300)
    for end, span, p, found in reversed(spans):
        through = p * backward[end]
        backward[end - span] += through
        uses += np.bincount(found, weight * forward[end - span] * through, len(uses))


def _uses_long(vocabulary: Pieces, letters: np.ndarray, counts: np.ndarray, probability: np.ndarray, uses: np.ndarray) -> None:
    """As ``_uses_short`` in logarithms; spans are found again on the way back, not held."""
    n, length = letters.shape
    with np.errstate(divide="ignore"):
        logs = np.log(probability)
    of = lambda span, found: np.where(found < vocabulary.size, logs[found], np.log(UNSEEN) if span == 1 else -np.inf)
    forward = [np.zeros(n)]
    for end in range(1, length + 1):
        forward.append(np.logaddexp.reduce([forward[end - span] + of(span, found) for span, found in vocabulary.ending(letters, end)]))
    backward = {length: np.zeros(n)}
    for end in range(length, 0, -1):
        rest = backward.pop(end)
        for span, found in vocabulary.ending(letters, end):
            through = of(span, found) + rest
            backward[end - span] = np.logaddexp(backward.get(end - span, -np.inf), through)
            uses += np.bincount(found, counts * np.exp(forward[end - span] + through - forward[length]), len(uses))


def _words_of(column: pa.Array) -> pa.Array:
    return pc.utf8_split_whitespace(pc.utf8_lower(column.fill_null("").cast(pa.large_string())))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = _words_of(batch.column("text"))
        flat = words.flatten()
        table = pa.table({"lang": batch.column("lang").take(pc.list_parent_indices(words)), "word": flat.cast(pa.string())})
        table = table.filter(pc.not_equal(table["word"], "")).group_by(["lang", "word"]).aggregate([([], "count_all")])
        yield from table.rename_columns(["lang", "word", "n"]).to_batches()


def _uses(batches: Iterator[pa.RecordBatch], languages: list[str], probability: np.ndarray, model: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(probability.shape)
    for batch in batches:
        for i, language in enumerate(languages):
            own = batch.filter(pc.equal(batch.column("lang"), language))
            if own.num_rows:
                total[:, i] += expected_counts(
                    own.column("word").to_pylist(), own.column("n").to_numpy().astype(float), probability[:, i], model)
    piece, language = np.nonzero(total[:-1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(language.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, language])],
        ["language", "piece", "uses"])


def train(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, model: str = MODEL) -> tuple[list[str], np.ndarray]:
    """Languages in order, and probabilities (pieces + 1 x languages) from ``labelled`` (doc_id, text, lang).

    Reads the ``sample`` rows of each language with the smallest hashes of doc_id. The driver
    holds one number per piece and language.
    """
    draw = F.struct(F.xxhash64("doc_id"), "doc_id")
    ranked = labelled.filter("lang is not null").select("doc_id", "lang").withColumn(
        "_r", F.row_number().over(Window.partitionBy("lang").orderBy(draw))).filter(F.col("_r") <= sample)
    # At most `sample` rows per language.
    texts = labelled.join(F.broadcast(ranked.select("doc_id", "lang")), ["doc_id", "lang"]).select("lang", "text")
    words = materialize(texts.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")))
    languages = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
    size = pieces(model).size
    probability = np.full((size + 1, len(languages)), 1.0 / max(size, 1))
    for _ in range(rounds if languages else 0):
        found = words.mapInArrow(
            lambda b, p=probability: _uses(b, languages, p, model), "language int, piece int, uses double"
        ).groupBy("language", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.full((size, len(languages)), SMOOTH)
        uses[found["piece"].to_numpy(), found["language"].to_numpy()] += found["uses"].to_numpy()
        probability = np.vstack([uses / uses.sum(axis=0), np.zeros(len(languages))])
    return languages, probability


def _scored(batches: Iterator[pa.RecordBatch], languages: list[str], probability: np.ndarray, model: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            text = part.column("text").fill_null("")
            lists = _words_of(text)
            coded = lists.flatten().dictionary_encode()
            each = log_likelihoods(coded.dictionary.to_pylist(), probability, model)
            index, parent = coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
            total = np.zeros((part.num_rows, len(languages)))
            for i in range(len(languages)):
                total[:, i] = np.bincount(parent, each[index, i], part.num_rows)
            best = total.argmax(axis=1) if languages else np.zeros(part.num_rows, int)
            score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if languages else np.zeros(part.num_rows)
            spoken = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False) & bool(languages)
            names = np.array([*languages, "und"], object)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names[np.where(spoken, best, len(languages))], pa.string()),
                 pa.array(np.where(spoken, score, 0.0))], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, languages: list[str], probability: np.ndarray, model: str = MODEL) -> DataFrame:
    """(doc_id, lang_pred, score) from doc_id and text alone; the score is the posterior of the prediction."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: _scored(b, languages, probability, model), f"doc_id {kind}, lang_pred string, score double")
