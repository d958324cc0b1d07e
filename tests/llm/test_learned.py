"""Operators that learn: held-out accuracy, gradients, and defined cases."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabgraph.llm import langid, pii, quality
from tabgraph.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR

SMALL = "/root/testdata/sf0.01"


# --- language ---------------------------------------------------------------


def segmentations(word, probability, index):
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(len(word), langid.pieces().longest) + 1):
        i = index.get(word[:n])
        p = probability[i] if i is not None else (langid.UNSEEN if n == 1 else 0.0)
        total += p * segmentations(word[n:], probability, index) if p else 0.0
    return total


def test_forward_sums_all_segmentations():
    vocabulary = langid.pieces()
    index = {p: i for i, p in enumerate(vocabulary.pieces)}
    rng = np.random.default_rng(0)
    probability = np.append(rng.random(vocabulary.size), 0.0)[:, None]
    words = ["a", "the", "straße", "🙂x", "ende", "\0", "x" * 9]
    got = langid.log_likelihoods(words, probability)[:, 0]
    want = [np.log(segmentations("▁" + w, probability[:, 0], index)) for w in words]
    assert np.allclose(got, want)


def by_columns(word, probability, index):
    """log of the forward sum of one marked word, in plain Python."""
    state = [0.0]
    for end in range(1, len(word) + 1):
        parts = []
        for n in range(1, min(end, langid.pieces().longest) + 1):
            i = index.get(word[end - n: end])
            if i is not None or n == 1:
                parts.append(state[end - n] + np.log(probability[i] if i is not None else langid.UNSEEN))
        state.append(np.logaddexp.reduce(parts))
    return state[-1]


def test_no_piece_and_no_word_is_cut():
    vocabulary = langid.pieces()
    index = {p: i for i, p in enumerate(vocabulary.pieces)}
    rng = np.random.default_rng(5)
    probability = np.append(rng.random(vocabulary.size) / 100, 0.0)[:, None]
    thirteen = [p for p in vocabulary.pieces if len(p) >= 13 and "▁" not in p][:3]
    longest = max(vocabulary.pieces, key=len)
    assert thirteen and len(longest) == vocabulary.longest > 13
    words = [*thirteen, longest.strip("▁"), "".join(thirteen) * 2, ("unter" + thirteen[0]) * 4, "z" * 60, "日本" * 700, "ab" * 20]
    got = langid.log_likelihoods(words, probability)[:, 0]
    assert np.allclose(got, [by_columns("▁" + w, probability[:, 0], index) for w in words])
    few = np.full_like(probability, 1e-9)
    few[index[thirteen[0]]] = 0.5
    assert langid.log_likelihoods([thirteen[0]], few)[0, 0] > np.log(0.5) + np.log(1e-9) - 0.1


def test_long_words_train_like_short_ones():
    vocabulary = langid.pieces()
    rng = np.random.default_rng(6)
    probability = np.append(rng.random(vocabulary.size), 0.0)
    for word in ["undsoweiter", "x", "straßenbahn"]:
        letters = next(langid._by_length([word]))[1]
        one, two = np.zeros(len(probability)), np.zeros(len(probability))
        langid._uses_short(vocabulary, letters, np.array([3.0]), probability, one)
        langid._uses_long(vocabulary, letters, np.array([3.0]), probability, two)
        assert np.allclose(one, two)
    length = np.array([len(p) for p in vocabulary.pieces])
    uses = langid.expected_counts(["a" * 300, "straße" * 30], np.array([1.0, 2.0]), probability)
    assert np.isclose((uses[:-1] * length).sum() + uses[-1], 301 + 2 * 181)


def test_expected_counts_add_up_to_characters():
    vocabulary = langid.pieces()
    probability = np.append(np.full(vocabulary.size, 1.0 / vocabulary.size), 0.0)
    uses = langid.expected_counts(["hello", "worlds"], np.array([2.0, 3.0]), probability)
    length = np.array([len(p) for p in vocabulary.pieces])
    assert np.isclose((uses[:-1] * length).sum(), 2 * 6 + 3 * 7)


def test_held_out_languages_are_right(spark):
    got = QUERIES["op2_language_id"](spark, SMALL)
    lang = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").filter("held_out and lang_pred <> 'und'").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert rows[0] >= 0.98 and rows[1] > 150
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_languages_of_odd_rows(spark, odd_docs, no_docs):
    languages, probability = langid.train(odd_docs)
    got = langid.predict(odd_docs, languages, probability).collect()
    assert languages == ["en"] and len(got) == odd_docs.count()
    letters = [bool(re.search(r"[^\W\d_]", r.text or "")) for r in odd_docs.collect()]
    assert [r.lang_pred for r in got] == ["en" if x else "und" for x in letters]
    languages, probability = langid.train(no_docs)
    assert languages == [] and {r.lang_pred for r in langid.predict(odd_docs, languages, probability).collect()} == {"und"}
    assert langid.predict(no_docs, languages, probability).count() == 0


# --- quality ----------------------------------------------------------------


def test_cumulative_link_gradient_finds_the_order():
    rng = np.random.default_rng(3)
    n = 600
    grade = rng.integers(0, 3, n)
    bucket = np.concatenate([np.array([5 + g, 50 + int(rng.integers(30))]) for g in grade])
    words, shapes, cuts = quality.fit(grade, bucket, np.arange(n + 1) * 2, np.ones((n, quality.SHAPES)) * 0.1)
    score = words[bucket].reshape(n, 2).sum(axis=1) + 0.1 * shapes.sum()
    assert cuts[0] < cuts[1]
    assert (np.digitize(score, cuts) == grade).mean() > 0.97


def test_held_out_grades(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = quality.train(docs, labels.filter(~fold))
    rows = quality.score(docs, model).join(quality.grades(labels.filter(fold)), "doc_id").groupBy("grade").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.grade: r.kept for r in rows}
    assert kept[0] <= 0.15 and kept[1] <= 0.15 and kept[2] >= 0.95


def test_only_drawn_features_meet_in_one_task(spark):
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    plan = quality._drawn_features(read("documents"), read("labels"), 50)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan
    assert 0 < plan.index("Exchange SinglePartition") < plan.index("MapInArrow")


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (2, None, None), (3, None, 0), (4, 0, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.grades(labels).collect()} == {1: 0, 3: 2, 4: 1, 99: 2}
    model = quality.train(odd_docs, labels)
    scored = quality.score(odd_docs, model)
    assert scored.count() == odd_docs.count() and scored.filter("tail_probability is null or isnan(tail_probability)").count() == 0
    good = quality.good_documents(odd_docs, model)
    assert good.schema == odd_docs.schema and good.count() == scored.filter("kept").count()
    assert quality.train(no_docs, labels) is None and quality.train(odd_docs, labels.limit(0)) is None
    assert quality.score(odd_docs, None).filter("kept").count() == odd_docs.count()
    assert quality.score(no_docs, model).count() == 0 and quality.good_documents(no_docs, model).count() == 0


# --- personal data ----------------------------------------------------------


def test_tagger_gradient_is_the_derivative():
    rng = np.random.default_rng(2)
    tagger = pii.Tagger()
    tagger.p = {k: v.astype(np.float64) + 0.05 * rng.standard_normal(v.shape) for k, v in tagger.p.items()}
    x, y = rng.integers(0, 40, (7, 3)), rng.integers(0, pii.LABELS, (7, 3))
    _, g = tagger.gradient(x, y)
    for name, value in tagger.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), value.shape)
        kept, step = value[at], 1e-2
        value[at] = kept + step
        up, _ = tagger.gradient(x, y)
        value[at] = kept - step
        down, _ = tagger.gradient(x, y)
        value[at] = kept
        assert np.isclose((up - down) / (2 * step), g[name][at], rtol=0.05), name


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_network_finds_held_out_variants_and_leaves_prose_alone(spark, tagger):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id >= 5000")
    texts = [r.text for r in docs.filter(F.col("text").rlike(pii.TRIGGER)).limit(300).collect()]
    rng, found, total = np.random.default_rng(9), 0, 0
    for text in texts:
        for kind, start, end in pii.base_spans(text)[:2]:
            value = pii.varied(kind, text[start:end], rng)
            near = re.sub(r"[0-9@+]", "x", text[max(0, start - 60): start]), re.sub(r"[0-9@+]", "x", text[end: end + 60])
            if pii.base_spans(near[0] + value + near[1]):
                continue
            seen = pii.tagged([pii.codes(near[0] + value + near[1])], tagger)[0]
            inside = [s for s in seen if s[0] == kind and s[1] < len(near[0]) + len(value) and s[2] > len(near[0])]
            found, total = found + bool(inside), total + 1
    assert total > 100 and found >= 0.75 * total
    plain = ["the of and " * 40, "Licensed under CC BY-NC 4.0.", "version 3 of the licence, chapter 12"]
    assert all(not s for s in pii.tagged([pii.codes(t) for t in plain], tagger))


def test_cues_are_found_in_codes_as_in_text():
    for text in ["at", "AT dot", "x at", "cat", "[at] (DOT)", "Dota at", "atdot", "é at", "do t", "a", "", "dot at dot"]:
        assert pii.cue_places(pii.codes(text)).tolist() == [m.start() for m in re.finditer(pii.CUE, text)], text


def test_network_finds_addresses_without_digits(spark, tagger):
    lead, tail = "the and of with from that this or by as please write to ", " for the rest of it and thank you"
    found = total = 0
    for at, dot in ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), ("[at]", ".")):
        for name in ("jane.doe", "jdoe", "anna_maria", "info", "m.dubois"):
            for host in ("example.org", "mail.example.com", "firma.de"):
                text = lead + name + at + host.replace(".", dot) + tail
                seen = pii.all_spans([text], tagger)[0][1]
                found += any(k == 0 and a < len(text) - len(tail) and b > len(lead) for k, a, b in seen)
                total += 1
    print(f"written-out addresses without digits: {found} of {total}")
    assert found >= 0.75 * total
    docs = spark.createDataFrame([(1, lead + "jane.doe [at] example [dot] org" + tail)], "doc_id long, text string")
    assert "email:" in pii.spans(docs, tagger).first().spans
    assert "<email>" in pii.masked(docs, tagger).first().text


def test_windows_do_not_change_a_span(tagger):
    """A span reads the same wherever the window steps fall."""
    lead = "the and of with from that this or by as "
    for shift in range(0, 60, 7):
        text = lead * 3 + "x" * shift + " write to hans.muster42 [at] mail7 [dot] example [dot] com " + lead * 3
        spans = pii.all_spans([text], tagger)[0][1]
        assert len(spans) <= 2 and all(text[a:b].strip() for _, a, b in spans)


def test_personal_data_of_odd_rows(odd_docs, no_docs, tagger):
    rows = pii.spans(odd_docs, tagger)
    assert rows.count() == odd_docs.count() and rows.filter("spans is null").count() == 0
    clean = pii.masked(odd_docs, tagger)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert pii.spans(no_docs, tagger).count() == 0 and pii.masked(no_docs, tagger).count() == 0
    assert pii.train(no_docs) is None
    text = "mail a.b@c.de now, call +1 (203) 555-8282."
    assert pii.mask(text, pii.base_spans(text)) == "mail <email> now, call <phone>."
