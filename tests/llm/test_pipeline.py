from __future__ import annotations

import corpus_pipeline
import numpy as np
from cases import DOCUMENT, SF, awkward, empty
from test_decontamination import brute_force as contaminated
from test_jaccard_join import brute_force as classes
from test_secret_scan import brute_force as secrets


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after_rows = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after_rows.columns == docs.columns
            after = {r.doc_id: r.text for r in after_rows.collect()}
        if name == "language_id":
            assert len(after) >= 0.99 * len(before) and all(after[d] == before[d] for d in after)
        if name == "jaccard_join":
            assert after.keys() == {c for c, _ in classes(list(before.items())).values()}
        if name == "decontamination":
            hits = contaminated(list(before.items()), items)
            assert all(after[d] == before[d] for d in before if not hits[d][4])
            assert all(hits[d][0] == hits[d][1] for d in before if d not in after)
            assert any(h[4] for h in hits.values())
        if name == "secret_scan":
            assert after.keys() == before.keys() and not any(secrets(t) for t in after.values())
            assert all(after[d] == before[d] or secrets(before[d]) for d in before)
        if name == "packing":
            rows = after_rows.collect()
            assert {r.doc_id for r in rows} == before.keys()
            lengths = np.zeros(1 + max(before), int)
            for r in rows:
                lengths[r.doc_id] += r.length
            assert (lengths[list(before)] > 0).all()
        docs, before = after_rows, after
        seen.append(name)
    assert seen == ["language_id", "jaccard_join", "decontamination", "secret_scan", "packing"]


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 0


def test_awkward_rows(spark):
    for frame in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.schema.simpleString() == spark.createDataFrame([], DOCUMENT).schema.simpleString()
            out.collect()
