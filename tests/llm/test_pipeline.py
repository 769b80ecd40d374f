"""The pipeline's stages on the smallest documents."""

import corpus_pipeline
from tradewind.llm.common import read

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = read(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns, name
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    ids = [r["doc_id"] for r in out]
    assert len(set(ids)) == len(ids) and 100 < len(ids) <= docs.count()
    assert {r["copies"] for r in out} <= {1, 2}
