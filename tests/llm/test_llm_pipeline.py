"""The pipeline's stages against what each must do with all that the stage before kept."""

import collections
import hashlib
import re

from compare import DATA
from test_llm_queries import brute_classes, brute_targets, lower_az

import corpus_pipeline

SF = f"{DATA}/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            kept.append(docs.collect())
    start = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good, exact, near, mixed = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum((d.doc_id in {g.doc_id for g in good}) == (labels[d.doc_id] == 1) for d in start if d.doc_id in labels) >= 0.98 * len(labels)
    last = {}
    for d in good:
        key = hashlib.sha256(lower_az(d.text).encode()).hexdigest()
        last[key] = max(last.get(key, -1), d.doc_id)
    assert sorted(d.doc_id for d in exact) == sorted(last.values())
    assert {d.doc_id for d in near} == set(brute_classes([(d.doc_id, d.text) for d in exact]).values())
    times, sizes, taken = collections.Counter(d.doc_id for d in mixed), collections.Counter(), collections.Counter()
    assert set(times.values()) <= {1, 2} and set(times) <= {d.doc_id for d in near}
    for d in near:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", d.text))
        sizes[d.source] += size
        taken[d.source] += size * times[d.doc_id]
    targets = brute_targets(sizes)
    assert sum(abs(taken[s] - targets[s]) for s in sizes) <= 0.02 * sum(targets.values())
    tokens = docs.collect()
    assert collections.Counter(t.doc_id for t in tokens) == times and all(t.round_trip for t in tokens)


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "source", "n_tokens", "token_ids", "round_trip"]
