"""The pipeline's stages, each on its predecessor's output, against brute force."""

import corpus_pipeline
from tabgraph.llm import pii, spm
from tests.llm.conftest import SF_DIR, texts_of
from tests.llm.test_exact import best_overlap, classes, item_words


def test_stages_and_run(spark, documents):
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = documents
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, SF_DIR).persist()
        old, new = texts_of(before), {r.doc_id: r for r in docs.collect()}
        assert docs.columns == documents.columns or number == 4
        if name == "quality":
            labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
            clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0 and d in old]
            bad = [d for d, r in labels.items() if (r.quality == 0 or r.toxic == 1) and d in old]
            assert sum(d in new for d in clean) >= 0.95 * len(clean) and sum(d in new for d in bad) <= 0.15 * len(bad)
        elif name == "near_duplicates":
            assert set(new) == {d for d, (_, _, kept) in classes(old, 5).items() if kept}
        elif name == "decontamination":
            for d in set(old) - set(new):
                assert any(best_overlap(item_words(old[d]), item_words(i)) >= 13 for i in items)
            grams = {tuple(w[k: k + 13]) for w in map(item_words, items) for k in range(len(w) - 12)}
            for d in new:
                w = item_words(old[d])
                assert not any(tuple(w[k: k + 13]) in grams for k in range(len(w) - 12))
        elif name == "personal_data":
            assert set(new) == set(old)
            assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in new.values())
        else:
            decode = spm.codec().decode
            assert set(new) == set(old) and all(decode(r.ids) == old[d] for d, r in new.items())
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count()


def test_stages_take_odd_repeated_and_no_rows(spark, odd_docs, no_docs):
    """Nulls in every column, empty and long texts, repeated rows, clashing names: a defined result from every stage."""
    rows = odd_docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, SF_DIR)
        if name != "pieces":
            assert out.columns == odd_docs.columns, name
        kept = out.collect()
        if name in ("personal_data", "pieces"):
            assert len(kept) == rows, name
        elif name == "near_duplicates":
            # Rows without an id stay; each text of two words or more is kept once, the repeated rows with their id.
            assert sum(r.doc_id is None for r in kept) == odd_docs.filter("doc_id is null").count()
            assert {r.doc_id for r in kept} >= {1, 2, 3, 4, 7, 8, 9, 11, 12, 13, 14}
        else:
            assert len(kept) <= rows, name
        assert stage(spark, no_docs, SF_DIR).count() == 0, name
