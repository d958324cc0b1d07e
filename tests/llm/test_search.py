"""Lexical search, quality rules and hard negatives against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabgraph.llm import lexical, negatives, rules
from tests.llm.conftest import SF_DIR

# --- lexical search ---------------------------------------------------------


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked(docs, items, k=10):
    """{item: [(doc_id, score)]}; a null doc_id comes last among equals."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(terms(text))
    out = {}
    for item, wanted in asked.items():
        found = []
        for doc, bag, n in bags:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t, c in wanted.items() if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        if found:
            out[item] = [(d, -s) for s, _, _, d in sorted(found, key=lambda x: x[:3])[:k]]
    return out


def searched(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return dict(out)


ITEMS = [(1, "the Word ünïcödé 日本語 a"), (2, None), (3, ""), (None, "word WORD x"), (5, "no-such-term-here"), (6, "a a long"), (6, "1234567890"),
         (7, "... !!"), (8, "😀😀 mark ▁")]


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, score int")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert searched(lexical.search(odd_docs, items)) == ranked(docs, ITEMS)
    assert searched(lexical.search(odd_docs.repartition(7), items, k=2, block_chars=4)) == ranked(docs, ITEMS, 2)
    assert lexical.search(no_docs, items).count() == 0
    empty = lexical.search(odd_docs, items.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_of_the_driver_table(spark, documents):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    want = ranked([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in benchmark.collect()])
    assert searched(lexical.search(documents.repartition(5), benchmark, block_chars=3000)) == want


def test_ties_go_to_the_smaller_id_and_common_terms_fill_their_lists(spark):
    rows = [(i, "same words here") for i in range(400)] + [(1000 + i, "other text") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    items = [(0, "words"), (1, "text same")]
    assert searched(lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"))) == ranked(rows, items)


# --- quality rules ----------------------------------------------------------


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i: i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


REPEATING = ["a b c a b c", "a b c d", "x x x", "x x x x", "a b a b a b", "one two\none two\n\none two\n \n", "p q r s p q r t", "\v\fa b\r\nc"]


def test_counts_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(100 + i, t) for i, t in enumerate(REPEATING)]
    docs = odd_docs.select("doc_id", "text", "n", "score").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = rules.judged(docs).collect()
    want = [(r.doc_id, *base_counts(r.text)) for r in docs.collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert rules.judged(no_docs).count() == 0


def test_counts_of_the_driver_table(documents):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.judged(documents).collect()}
    assert got == {r.doc_id: base_counts(r.text) for r in documents.collect()}


def test_equal_hashes_do_not_make_words_equal(spark, monkeypatch):
    """With all windows in one hash class, the words themselves decide."""
    monkeypatch.setattr(rules.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    frame = spark.createDataFrame([("a b c d a b c e f",), ("a b c d e f",)], "t string")
    assert [r[0] for r in frame.select(rules.repeated_words(F.split("t", " "))).collect()] == [6, 0]


def fitted(votes, counts, steps=rules.STEPS):
    """The label model by plain numpy."""
    n_rules = votes.shape[1]
    good, keep, drop = rules.START_GOOD, np.full(n_rules, rules.START_KEEP), np.full(n_rules, rules.START_DROP)
    lean = lambda start, part, whole: (rules.PSEUDO * start + part) / (rules.PSEUDO + whole)
    for _ in range(steps):
        odds = np.log(good / (1 - good)) + ((votes > 0) * np.log(keep / (1 - drop)) + (votes < 0) * np.log((1 - keep) / drop)).sum(1)
        p = 1 / (1 + np.exp(-odds))
        g, b = (counts * p)[:, None], (counts * (1 - p))[:, None]
        good = lean(rules.START_GOOD, g.sum(), counts.sum())
        keep = lean(rules.START_KEEP, (g * (votes > 0)).sum(0), (g * (votes != 0)).sum(0))
        drop = lean(rules.START_DROP, (b * (votes < 0)).sum(0), (b * (votes != 0)).sum(0))
    return good, keep, drop


def test_the_fit_is_expectation_maximisation(spark, documents):
    voted = rules.votes(rules.counts(documents))
    names = [f"v_{r.name}" for r in rules.RULES]
    rows = np.array([[r[n] for n in names] for r in voted.filter("not base_failed").collect()])
    got = rules.fit(voted).first()
    good, keep, drop = fitted(rows, np.ones(len(rows)))
    assert got.good == pytest.approx(good) and got["keep"] == pytest.approx(list(keep)) and got["drop"] == pytest.approx(list(drop))


def test_rules_agree_with_the_labels(spark, documents):
    """The labels take no part in the fit; they only say whether it found what they mean."""
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = rules.judged(documents).join(labels, "doc_id").filter("not base_failed").collect()
    clean, poor = [r.kept for r in rows if r.label == 1], [r.kept for r in rows if r.label == 0]
    assert np.mean(clean) >= 0.97 and np.mean(poor) <= 0.1


# --- hard negatives ---------------------------------------------------------


def mined(rows, anchors, positives=5, n_negatives=10):
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), by brute force."""
    held = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, lab, v) in enumerate(held):
        if not anchors(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for n, (i, other, w) in enumerate(held) if n != at and len(w) == len(v)]
        for s, i, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            fits = sorted(x for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s)[:n_negatives]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fits)]
    return sorted(out)


def got_rows(frame):
    return sorted(tuple(r) for r in frame.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


KIND = "id long, label int, vector array<float>, doc_id string, score double, block int"


def clustered(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    made = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * spread
    made /= np.linalg.norm(made, axis=1)[:, None]
    return [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in v]) for i, v in enumerate(made)]


@pytest.mark.parametrize("dims,spread", [(3, 0.1), (8, 0.3)])
def test_mining_reads_enough_blocks(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(negatives, "PAGE", 4)
    monkeypatch.setattr(negatives, "LANE", 3)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 7)
    rows = clustered(dims, 420, dims, spread)
    rows += [(1000 + i, r[1], rows[3][2]) for i, r in enumerate(rows[:60])]  # copies of one vector
    frame = spark.createDataFrame([(*r, "x", 0.0, 1) for r in rows], KIND).repartition(6)
    assert got_rows(negatives.mine(frame, F.col("id") % 10 == 0, block_rows=16)) == mined(rows, lambda i: i % 10 == 0)


def test_bounds_leave_blocks_unread(spark):
    """On clustered vectors most blocks are out of reach of an anchor whose list is full."""
    rows = clustered(1, 3000, 4, 0.02)
    placed = negatives.on_curve(spark.createDataFrame(rows, "id long, label int, vector array<float>").select(
        "id", F.col("label").cast("long").alias("label"), negatives.whole(F.col("vector"), 256).alias("v")), 64)
    blocks = negatives.candidate_blocks(placed).toPandas()
    anchor = np.array(rows[0][2])[None, :] * 256
    least, most = negatives.bounds(anchor, np.stack(blocks["lo"]), np.stack(blocks["hi"]))
    scores = negatives.products(np.floor(anchor), np.stack([np.floor(256 * np.array(r[2])) for r in rows]))[0]
    assert (most[0] >= np.sort(scores)[-6]).mean() < 0.5
    for row, low, high in zip(blocks.itertuples(), least[0], most[0]):
        own = np.floor(anchor) @ np.asarray(row.values).reshape(len(row.ids), -1).T
        assert (own >= low - 256 * 4).all() and (own <= high + 256 * 4).all()


def test_mining_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (2, 2, [0.4, 0.3]), (3, 2, [0.4, 0.3]), (None, 1, [0.5, 0.5]),
            (4, None, [0.5, 0.5]), (5, 1, None), (6, 1, [nan, 0.1]), (7, 2, [inf, 0.1]), (8, 2, [None, 0.1]), (9, 2, [0.3]), (10, 1, [0.9]),
            (11, 1, [0.8]), (12, 1, []), (13, 2, []), (14, 1, []), (15, 1, [-0.5, -0.5]), (16, 1, [0.0, 0.0]), (17, 2, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x", 0.0, 1) for r in rows], KIND)
    assert got_rows(negatives.mine(frame, F.col("id") >= 0, block_rows=3)) == mined(rows, lambda i: True)
    assert negatives.mine(frame.limit(0), F.col("id") >= 0).count() == 0
    assert negatives.mine(frame, F.col("id") > 100).count() == 0


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[float(1 << 45), 3.0]]), np.array([[float(1 << 20), 1.0], [float(1 << 40), 1.0]])
    assert negatives.products(a, b).tolist() == [[(1 << 63) - 1 if (1 << 65) + 3 > (1 << 63) - 1 else (1 << 65) + 3, (1 << 63) - 1]]
    assert negatives.products(a, b[:, ::-1] * 0 + 1.0).tolist() == [[(1 << 45) + 3] * 2]


def test_the_curve_visits_neighbours():
    """Every cell once, and each step to an adjacent cell."""
    for dims, bits in [(2, 4), (3, 3), (5, 2)]:
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = negatives.hilbert_keys(grid, bits)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        assert len(set(keys)) == len(keys)
        assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_quality_rules", "op13_hard_negatives"])
def test_query_matches_oracle(name, spark, duck):
    from tabgraph.catalog.compare import differences
    from tabgraph.llm.queries import ORACLES, QUERIES

    assert differences(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) == ""
