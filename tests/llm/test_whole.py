"""The whole job where a narrower one was done before: each test failed on the code of round 1."""

import random

from test_llm import SCHEMA, SF, brute_components, frame, shingles


def test_near_stage_against_brute_force(spark):
    import corpus_pipeline

    r = random.Random(11)
    texts = []
    for k in range(40):
        w = [f"w{r.randrange(10**6)}" for _ in range(200)]
        v = w[:]
        for i in range(4 + k % 3):  # each new word takes five of 196 shingles: similarities from about 0.73 to 0.82
            v[10 + 30 * i] = "new"
        texts += [" ".join(w), " ".join(v)]
    for docs in (frame(spark, texts), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
        sets = [shingles(x.text) for x in rows]
        similar = lambda i, j: bool(sets[i] and sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
        want = [x.doc_id for i, (x, c) in enumerate(zip(rows, brute_components(len(rows), similar))) if i == c]
        assert sorted(x.doc_id for x in corpus_pipeline.near_stage(spark, docs, SF).collect()) == want
        assert len(want) < len(rows)
