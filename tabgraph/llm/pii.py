"""Personal data by fixed patterns plus a character-level bidirectional LSTM with a CRF layer.

The patterns give the base spans. The network adds spans of the same kinds where a pattern has
none, such as written-out addresses or numbers set in unusual ways. It is trained in numpy from
labelled spans: the base spans of a bounded sample of documents, and variants of them made by
rule (see ``varied``), in windows of text without other personal data around them.

Every value holds a digit, an at-sign, or the word "at" or "dot" (in any case, plain or in
brackets): the cues of written-out addresses. Windows are laid wherever one of these lies within
reach, over the whole of every text. Spans other than e-mail also have to hold a digit. Windows overlap;
a character takes its label from the window in which it lies farthest from an edge, and labels
of the whole text are then read as spans together.

Defined cases: null and empty texts have no spans; rows repeat as they are; without training
windows only base spans are reported; an empty table gives an empty result; extra columns are
dropped by ``spans`` and kept by ``masked``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgraph.llm.bytescan import give_back

KINDS = ("email", "ip", "card", "phone")
#: A number in an ip begins where a run of digits begins and takes all of it, so one try a run is enough.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: An e-mail's characters before the at-sign, and what begins with it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Characters of which any match holds one; only texts with a trigger meet the patterns.
TRIGGER = "[0-9@]"
#: Words of written-out addresses; brackets are no letters. Texts with a trigger or a cue meet the network.
CUE = "(?<![A-Za-z])(?:[Aa][Tt]|[Dd][Oo][Tt])(?![A-Za-z])"
#: Training reads at most this many documents that hold a trigger, and of each at most so many of its
#: spans, plain triggers and plain cues, drawn by seed from the whole text.
SAMPLE = 1500
SPANS, PLAIN, CUES = 4, 5, 2
WINDOW, STEP, REACH = 96, 48, 24
EMBED, HIDDEN = 12, 16
STEPS, BATCH, RATE, SEED = 900, 32, 0.01, 11
#: Mean margin, over a span, of the best label above plain text that an added span needs.
MARGIN = 2.0
LABELS = 1 + 2 * len(KINDS)  # 0 plain; 1 + 2k begins kind k, 2 + 2k continues it
_CODES = 64
CASED = re.compile(r"(?<=[ \[(])(?:at|dot)(?=[ \])])")
WRITTEN_AT = (" at ", " at ", " at ", " [at] ", "[at]", " (at) ", "(at)")
WRITTEN_DOT = (" dot ", " dot ", " dot ", " [dot] ", "[dot]", " (dot) ", "(dot)", ".", ".")
#: Written-out forms without digits that each e-mail address of the training texts gives.
DIGITLESS = 12


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def _holds(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.split("."))
    if kind == "email":
        return True
    digits = re.sub("[^0-9]", "", match)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in linear time: a match needs its at-sign, and starts as far
    left of it as its characters and the match before allow."""
    least, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at) if start < at else None
        least = host.end() if host else at
        if host:
            yield start, least
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the patterns' matches; failing ones are dropped, not retried."""
    found = []
    for number, kind in enumerate(KINDS):
        if kind == "email":
            found += [(number, *span) for span in emails(text)]
            continue
        if kind == "phone" and "+" not in text:
            continue
        found += [(number, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _holds(kind, m.group())]
    return found


def codes(text: str) -> np.ndarray:
    """Character classes: punctuation singly; lower, upper, digit, white space and others as classes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 128)]


_CLASS = np.zeros(129, np.int64)
_CLASS[128] = 1
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 3, 4
_CLASS[[9, 10, 11, 12, 13]] = 5
for _number, _c in enumerate(" !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[ord(_c)] = 6 + _number
# The letters of written-out "at" and "dot" keep classes of their own, small and large.
for _number, _c in enumerate("atdoATDO"):
    _CLASS[ord(_c)] = 42 + _number
_LETTER = np.zeros(_CODES, bool)
_LETTER[[3, 4, *range(42, 50)]] = True
#: Which of "atdo" a class is, in either case.
_WRITTEN = np.full(_CODES, -1)
_WRITTEN[42:50] = np.tile(np.arange(4), 2)
_CORE = np.zeros(_CODES, bool)
_CORE[[2, _CLASS[ord("@")]]] = True


class Tagger:
    """Bidirectional LSTM with CRF transitions; all batches are (window, time) arrays."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": draw(_CODES, EMBED) * 2, "out": draw(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS, np.float32),
                  "step": np.zeros((LABELS, LABELS), np.float32)}
        for d in "fb":
            self.p |= {"x" + d: draw(EMBED, 4 * HIDDEN), "h" + d: draw(HIDDEN, 4 * HIDDEN), "c" + d: np.zeros(4 * HIDDEN, np.float32)}
            self.p["c" + d][HIDDEN: 2 * HIDDEN] = 1

    # -- forward -----------------------------------------------------------

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states (time, window, HIDDEN) of one direction over codes (time, window)."""
        table = self.p["embed"] @ self.p["x" + d] + self.p["c" + d]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, saved = np.empty((*x.shape, HIDDEN), np.float32), []
        times = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in times:
            z = table[x[t]] + h @ self.p["h" + d]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN: 2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            if keep:
                saved.append((t, h, before, i, f, o, g, squashed))
            h = o * squashed
            states[t] = h
        return states, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        forward, saved_f = self._run(x, "f", keep)
        backward, saved_b = self._run(x, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, saved_f, saved_b)

    # -- training ----------------------------------------------------------

    def gradient(self, x: np.ndarray, y: np.ndarray):
        """Mean loss over windows of (time, window) codes and labels, and its gradient."""
        score, (both, saved_f, saved_b) = self.emissions(x, keep=True)
        score = score.astype(np.float64)
        step, (n, m) = self.p["step"].astype(np.float64), x.shape
        add = lambda a, axis: (top := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis=axis))
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[0] = score[0]
        for t in range(1, n):
            ahead[t] = score[t] + add(ahead[t - 1][:, :, None] + step, 1)
        for t in range(n - 2, -1, -1):
            behind[t] = add(step + (score[t + 1] + behind[t + 1])[:, None, :], 2)
        total = add(ahead[-1], 1)
        d_score = np.exp(ahead + behind - total[None, :, None])
        d_step = np.zeros_like(step)
        for t in range(1, n):
            d_step += np.exp(ahead[t - 1][:, :, None] + step + (score[t] + behind[t])[:, None, :] - total[:, None, None]).sum(axis=0)
            np.add.at(d_step, (y[t - 1], y[t]), -1)
        times, windows = np.indices(y.shape)
        loss = total.sum() - score[times, windows, y].sum() - sum(step[y[t - 1], y[t]].sum() for t in range(1, n))
        d_score[times, windows, y] -= 1
        d_score, g = (d_score / m).astype(np.float32), {k: np.zeros_like(v) for k, v in self.p.items()}
        g["step"] = (d_step / m).astype(np.float32)
        g["out"], g["bias"] = np.einsum("tmh,tml->hl", both, d_score), d_score.sum(axis=(0, 1))
        d_both = d_score @ self.p["out"].T
        self._back(x, "f", saved_f, d_both[:, :, :HIDDEN], g)
        self._back(x, "b", saved_b, d_both[:, :, HIDDEN:], g)
        return loss / m, g

    def _back(self, x, d, saved, d_states, g):
        d_h = d_c = np.zeros((x.shape[1], HIDDEN), np.float32)
        weights, per_code = self.p["h" + d], np.zeros((_CODES, 4 * HIDDEN), np.float32)
        for t, h, before, i, f, o, new, squashed in reversed(saved):
            d_h = d_h + d_states[t]
            d_o = d_h * squashed
            d_c = d_c + d_h * o * (1 - squashed ** 2)
            z = np.concatenate([d_c * new * i * (1 - i), d_c * before * f * (1 - f), d_o * o * (1 - o), d_c * i * (1 - new ** 2)], axis=1)
            g["h" + d] += h.T @ z
            np.add.at(per_code, x[t], z)
            d_h, d_c = z @ weights.T, d_c * f
        g["c" + d] += per_code.sum(axis=0)
        g["x" + d] += self.p["embed"].T @ per_code
        g["embed"] += per_code @ self.p["x" + d].T

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> "Tagger":
        """About ``steps`` Adam steps over shuffled batches of (window, time) codes and labels."""
        rng, step = np.random.default_rng(seed), 0
        epochs = max(1, round(steps * BATCH / len(x)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at: at + BATCH]
                _, g = self.gradient(x[rows].T, y[rows].T)
                size, step = np.sqrt(sum(float((a * a).sum()) for a in g.values())), step + 1
                rate, clip = RATE * (1 - 0.8 * epoch / max(epochs - 1, 1)), min(1.0, 5.0 / max(size, 1e-9))
                for k, a in g.items():
                    a = a * clip
                    m[k] += 0.1 * (a - m[k])
                    v[k] += 0.001 * (a * a - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    # -- decoding ----------------------------------------------------------

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels and their margin over plain text, for codes (window, time)."""
        score, _ = self.emissions(x.T)
        step = self.p["step"] + _ALLOWED
        best, back = score[0] + _FIRST, np.zeros(score.shape, np.int8)
        for t in range(1, len(score)):
            paths = best[:, :, None] + step
            back[t] = paths.argmax(axis=1)
            best = np.take_along_axis(paths, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + score[t]
        labels = np.zeros(score.shape[:2], np.int64)
        labels[-1] = best.argmax(axis=1)
        rows = np.arange(score.shape[1])
        for t in range(len(score) - 1, 0, -1):
            labels[t - 1] = back[t][rows, labels[t]]
        margin = np.take_along_axis(score, labels[:, :, None], 2)[:, :, 0] - score[:, :, 0]
        return labels.T, margin.T


# A kind is continued only after its beginning or continuation.
_ALLOWED = np.zeros((LABELS, LABELS), np.float32)
_FIRST = np.zeros(LABELS, np.float32)
for _k in range(len(KINDS)):
    _ALLOWED[:, 2 + 2 * _k] = -1e4
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0
    _FIRST[2 + 2 * _k] = -1e4


def varied(kind: int, text: str, rng: np.random.Generator) -> str:
    """A rule-made variant of a labelled value that its pattern need not match."""
    pick = int(rng.integers(4))
    if KINDS[kind] == "email":
        name, _, host = text.partition("@")
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."))[pick]
        return name + at + host.replace(".", dot)
    if KINDS[kind] == "ip":
        return text.replace(".", (" . ", "[.]", "(.)", ". ")[pick])
    digits = re.sub("[^0-9]", "", text)
    if KINDS[kind] == "card":
        return (".", " . ", "_", "/")[pick].join(digits[i: i + 4] for i in range(0, len(digits), 4))
    return (f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}",
            f"00{digits[:-10]} {digits[-10:-7]} {digits[-7:-4]} {digits[-4:]}", f"+{digits[:-10]}/{digits[-10:-7]}/{digits[-7:]}")[pick]


def digitless(address: str, rng: np.random.Generator) -> str:
    """An e-mail address written out, with letters for its digits; its name has one to three parts."""
    letters = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9))))
    name, _, host = address.partition("@")
    name = re.split(r"[._%+-]+", re.sub("[0-9]", "", name))[0] or letters()
    name = "._-"[int(rng.integers(3))].join([name, *(letters() for _ in range(int(rng.integers(3))))])
    labels = [re.sub("[0-9]", "", x) or letters() for x in host.split(".")]
    labels[0] = letters() if rng.integers(2) else labels[0]
    at, dot = WRITTEN_AT[int(rng.integers(len(WRITTEN_AT)))], WRITTEN_DOT[int(rng.integers(len(WRITTEN_DOT)))]
    written = name + at + dot.join(labels[-2:] if rng.integers(2) else labels)
    return written if rng.integers(4) else CASED.sub(lambda m: m.group().upper(), written)


def _drawn(choices: list, most: int, rng: np.random.Generator) -> list:
    """At most ``most`` of the choices, in their order."""
    return choices if len(choices) <= most else [choices[i] for i in np.sort(rng.choice(len(choices), most, replace=False))]


def training_windows(text: str, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled windows around the base spans of a text, as they stand and varied, and one without any."""
    spans, made = sorted(base_spans(text), key=lambda s: s[1]), []
    clear = [s for i, s in enumerate(spans) if all(s[2] <= o[1] or o[2] <= s[1] for j, o in enumerate(spans) if j != i)]
    for kind, start, end in _drawn(clear, SPANS, rng):
        values = [text[start:end], varied(kind, text[start:end], rng)]
        if KINDS[kind] == "email":
            values += [digitless(text[start:end], rng) for _ in range(DIGITLESS)]
        for value in values:
            lead = int(rng.integers(4, max(5, WINDOW - len(value) - 4)))
            left, right = text[max(0, start - lead): start], text[end: end + WINDOW]
            if any(o[1] < start and o[2] > start - lead or o[1] < end + WINDOW and o[2] > end for o in spans if o[1] != start):
                left, right = re.sub(r"[0-9@+]", "x", left), re.sub(r"[0-9@+]", "x", right)
            if KINDS[kind] == "email" and not rng.integers(3):
                left, right = left[-int(rng.integers(1, 24)):].lstrip(), "" if rng.integers(2) else right
            window = (left + value + right)[:WINDOW]
            label = np.zeros(len(window), np.int64)
            label[len(left): len(left) + len(value)] = 2 + 2 * kind
            label[len(left): len(left) + 1] = 1 + 2 * kind
            made.append((codes(window), label))
    plain = [_drawn([m.start() for m in re.finditer(mark, text)], most, rng) for mark, most in ((TRIGGER, PLAIN), (CUE, CUES))]
    for place in sum(plain, []):
        low = max(0, place - WINDOW // 2)
        if not any(s[1] < low + WINDOW and s[2] > low for s in spans):
            window = text[low: low + WINDOW]
            made.append((codes(window), np.zeros(len(window), np.int64)))
    return made


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng, made = np.random.default_rng(SEED), []
    texts = sorted(t for batch in batches for t in batch.column(0).to_pylist())
    for text in texts:
        made += training_windows(text, rng)
    if not made:
        return
    x, y = np.full((len(made), WINDOW), _CLASS[32]), np.zeros((len(made), WINDOW), np.int64)
    for i, (code, label) in enumerate(made):
        x[i, : len(code)], y[i, : len(label)] = code, label
    tagger = Tagger().train(x, y)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(tagger.p)), pa.array([v.astype(np.float32).tobytes() for v in tagger.p.values()], pa.binary())], ["name", "value"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A tagger trained in one task on the ``sample`` distinct texts with triggers whose hashes are smallest.

    The draw moves hashes only; texts follow for what was drawn.
    """
    texts = docs.select("text", F.xxhash64("text").alias("h")).filter(F.col("text").rlike(TRIGGER))
    # At most `sample` hashes.
    drawn = texts.select("h").distinct().orderBy("h").limit(sample)
    held = texts.join(F.broadcast(drawn), "h").dropDuplicates(["h"]).select("text")
    rows = held.coalesce(1).mapInArrow(_trained, "name string, value binary").collect()
    if not rows:
        return None
    tagger = Tagger()
    for row in rows:
        tagger.p[row["name"]] = np.frombuffer(bytes(row["value"]), np.float32).reshape(tagger.p[row["name"]].shape).copy()
    return tagger


def cue_places(code: np.ndarray) -> np.ndarray:
    """Where the matches of ``CUE`` begin."""
    around = np.concatenate(([0], code, [0, 0, 0]))
    letter, written, n = _LETTER[around], _WRITTEN[around], len(code)
    at = (written[1: n + 1] == 0) & (written[2: n + 2] == 1) & ~letter[3: n + 3]
    dot = (written[1: n + 1] == 2) & (written[2: n + 2] == 3) & (written[3: n + 3] == 1) & ~letter[4: n + 4]
    return np.flatnonzero((at | dot) & ~letter[:n])


def window_starts(code: np.ndarray) -> np.ndarray:
    """Starts of the windows of a text: every step whose window lies within reach of a trigger or a cue."""
    core = np.union1d(np.flatnonzero(_CORE[code]), cue_places(code))
    steps = np.arange(0, max(len(code) - STEP, 1), STEP)
    near = np.searchsorted(core, steps + WINDOW + REACH) > np.searchsorted(core, steps - REACH)
    return steps[near]


def tagged(codes_of: list[np.ndarray], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans the network sees in each text (as character codes)."""
    places = [(i, int(s)) for i, code in enumerate(codes_of) for s in window_starts(code)]
    labels = [np.zeros(len(c), np.int64) for c in codes_of]
    margin = [np.zeros(len(c), np.float32) for c in codes_of]
    depth = [np.full(len(c), -1, np.int64) for c in codes_of]
    inside = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for at in range(0, len(places), 512):
        part = places[at: at + 512]
        x = np.full((len(part), WINDOW), _CLASS[32])
        for row, (i, s) in enumerate(part):
            window = codes_of[i][s: s + WINDOW]
            x[row, : len(window)] = window
        found, sure = tagger.decode(x)
        for row, (i, s) in enumerate(part):
            n = min(WINDOW, len(codes_of[i]) - s)
            own = inside[:n].copy()
            # The text's own ends are no window edges.
            if s == 0:
                own = np.maximum(own, np.arange(WINDOW)[::-1][:n])
            if s + WINDOW >= len(codes_of[i]):
                own = np.maximum(own, np.arange(WINDOW)[:n])
            better = np.flatnonzero(own > depth[i][s: s + n])
            depth[i][s + better] = own[better]
            labels[i][s + better], margin[i][s + better] = found[row][better], sure[row][better]
    return [_read(labels[i], margin[i], codes_of[i]) for i in range(len(codes_of))]


def _read(labels: np.ndarray, margin: np.ndarray, code: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of a text's labels that are sure enough; all kinds but e-mail hold a core character."""
    held = np.flatnonzero(labels)
    spans, at = [], 0
    while at < len(held):
        start = held[at]
        kind, end = (labels[start] - 1) // 2, start + 1
        while end < len(labels) and labels[end] == 2 + 2 * kind:
            end += 1
        if (KINDS[kind] == "email" or _CORE[code[start:end]].any()) and margin[start:end].mean() >= MARGIN:
            spans.append((int(kind), int(start), int(end)))
        at = np.searchsorted(held, end)
    return spans


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """For each text its base spans and the added ones that touch no base span."""
    base = [base_spans(t) for t in texts]
    seen = tagged([codes(t) for t in texts], tagger) if tagger else [[] for _ in texts]
    return [(b, [s for s in extra if all(s[2] <= o[1] or o[2] <= s[1] for o in b)]) for b, extra in zip(base, seen)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _span_rows(batches: Iterator[pa.RecordBatch], tagger: Tagger | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            both = all_spans(part.column("text").to_pylist(), tagger)
            counts = [[sum(s[0] == k for s in base) for base, _ in both] for k in range(len(KINDS))]
            digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 pa.array([_joined(base + extra) for base, extra in both], pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
        give_back()


def spans(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs`` (doc_id, text)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    held = texts.filter(F.col("text").rlike(f"{TRIGGER}|{CUE}")).mapInArrow(
        lambda b: _span_rows(b, tagger),
        f"doc_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string")
    empty = texts.filter(~F.col("text").rlike(f"{TRIGGER}|{CUE}")).select(
        "doc_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return held.union(empty)


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], s[0])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _masked(batches: Iterator[pa.RecordBatch], tagger: Tagger | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column("text").to_pylist()
            clean = pa.array([mask(t, base + extra) for t, (base, extra) in zip(texts, all_spans(texts, tagger))], pa.string())
            yield part.set_column(part.schema.get_field_index("text"), "text", clean)
        give_back()


def masked(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; all other columns and rows stay."""
    held = F.coalesce(F.col("text").rlike(f"{TRIGGER}|{CUE}"), F.lit(False))
    return docs.filter(held).mapInArrow(lambda b: _masked(b, tagger), docs.schema).union(docs.filter(~held))
