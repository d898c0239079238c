"""Each stage of the pipeline against a plain version on its own input."""

import re

import corpus_pipeline
from flowlucid.llm.jaccard import one_of_each
from flowlucid.llm.queries import op1_benchmark_decontamination, op5_quality_resampling

from .test_packing import check
from .test_secrets import plain as plain_secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stored = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, stored[-1], SF).write.parquet(str(tmp_path / name))
        stored.append(spark.read.parquet(str(tmp_path / name)))
    raw, good, single, clean, safe, packed = stored
    assert all(f.columns == docs.columns for f in stored[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in stored]
    assert ids[1] == {r.doc_id for r in op5_quality_resampling(spark, SF).filter("kept").collect()}

    sets = {}
    for r in good.collect():
        w = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    up = {d: d for d in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if a < b and up[a] != up[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    assert ids[2] == set(up.values())
    leaks = {r.doc_id for r in op1_benchmark_decontamination(spark, SF).collect()}
    assert ids[3] == ids[2] - leaks
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        assert not plain_secrets(r.text) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or "<SECRET>" in r.text
    assert ids[4] == ids[3]
    check(packed.collect(), {r.doc_id: r.text for r in safe.collect()}, 2048)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_one_of_each_edge_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "only null"), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in one_of_each(docs).collect())
    assert got == [("1", "a b c d e f"), ("3", ""), ("3", ""), ("4", "None"), ("None", "only null")]
    assert one_of_each(docs.limit(0)).count() == 0
