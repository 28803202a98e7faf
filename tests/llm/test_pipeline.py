"""The pipeline's stages against the operators' brute-force versions."""

import public_tokenizers
import pytest

import corpus_pipeline
from qsieve.llm import quality

from . import brute
from .data import SF, frame, odd_rows, table


def test_stages(spark):
    """Stage by stage over the smallest documents: what stays, and its columns."""
    docs = corpus_pipeline.table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    model = quality.fit(docs, corpus_pipeline.table(spark, SF, "labels"))
    want = {r.doc_id for r in quality.score(docs, model, "s").filter("s >= 0.3").collect()}
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        rows = {r.doc_id: r for r in after.collect()}
        if name == "quality classifier":
            assert set(rows) == want and len(rows) < len(before)
        elif name == "SimHash near-dedup":
            assert set(rows) == {d for d, _, c in brute.simhash(list(before.items())) if d == c} and len(rows) < len(before)
        elif name == "benchmark decontamination":
            assert set(rows) == {d for d, *_, bad in brute.contamination(list(before.items()), items) if not bad} and len(rows) < len(before)
        else:
            assert set(rows) == set(before)
            for d, t in before.items():
                spans = brute.base_pii(t)
                assert bool(spans) <= (rows[d].text != t) and rows[d].n_chars == (len(rows[d].text) if rows[d].text != t else rows[d].n_chars)
                assert not any(t[a:z] in rows[d].text for k, a, z in spans if k == "email")
        docs = spark.createDataFrame(after.collect(), after.schema)
    last = corpus_pipeline.encode_tokens(spark, docs, SF).collect()
    import tiktoken
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=brute.ranks(), special_tokens={})
    assert all(r.decoded == (r.text or "") and r.ids == coder.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) for r in last)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_cases(spark, stage):
    docs = frame(spark, odd_rows())
    out = stage(spark, docs, SF)
    assert set(docs.columns) <= set(out.columns) and out.count() <= docs.count()
    assert stage(spark, frame(spark, [], empty=True), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
