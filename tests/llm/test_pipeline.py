"""The pipeline's stages, one by one and together."""

from collections import Counter

import corpus_pipeline
from authspan.llm import mixing, quality, simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    counts = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts[name] = docs.count()
        if i < 4:
            assert docs.columns == columns
        if name == "quality_rules":
            assert counts[name] == quality.judge(before).where("kept").count()
        if name == "near_dedup":
            assert counts[name] == simhash.similar(before).select("component_id").distinct().count()
        if name == "mix":
            assert counts[name] == mixing.mix(before).agg({"times": "sum"}).first()[0]
        if name == "sentencepiece":
            assert docs.select("text").exceptAll(before.select("text")).isEmpty() and before.select("text").exceptAll(docs.select("text")).isEmpty()
    assert corpus_pipeline.run(spark, DATA).count() == counts["sentencepiece"]


def test_near_dedup_finds_what_brute_force_finds(spark):
    """Documents linked by all pairs of exact Jaccard similarity, against the groups of the stage."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: simhash.shingle_set((r.text or "").encode(), 5).tolist() for r in rows}
    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    both = Counter((a, b) for ids in held.values() for a in ids for b in ids if a < b)
    links = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert len(links) > 10 and sum(got[a] == got[b] for a, b in links) >= 0.98 * len(links)
    near = {i: i for i in sets}

    def root(i):
        while near[i] != i:
            i = near[i]
        return i

    for a, b in links:
        near[root(b)] = root(a)
    assert all(root(i) == root(got[i]) for i in sets)  # nothing is grouped that isn't linked


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
