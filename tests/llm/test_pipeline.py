import corpus_pipeline
from fpengine.llm import jaccard, pieces, pii
from tests.conftest import SF001


def test_pipeline_keeps_clean_documents_and_applies_decisions(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = docs
    seen = {}
    for name, fn in corpus_pipeline.STAGES:
        nxt = fn(spark, out, SF001).cache()
        if name != "sentencepiece":
            assert nxt.columns == docs.columns
        seen[name] = (out, nxt)
        out = nxt
    before, after = seen["near_duplicates"]
    comp = {r.doc_id: r.component_id for r in jaccard.similar_components(before).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, c in comp.items() if d == c}
    before, after = seen["pii"]
    assert after.count() == before.count() and pii.pseudonymise(before).exceptAll(after.drop("n_chars").join(before.select("doc_id", "n_chars"), "doc_id")
                                                                                .select(*before.columns)).count() == 0
    texts = {r.doc_id: r.text for r in seen["mixing"][1].collect()}
    v = pieces.load_vocabulary()
    assert all(pieces.decode_ids(v, r.ids) == texts[r.doc_id] for r in out.collect())
