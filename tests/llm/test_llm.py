"""The training-data operators against brute force, libraries and round trips, on small fixtures with awkward rows."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lodestrata.llm import bpe_codec, components, embedding_dedup, exact_dedup, language_id, minhash_dedup, packing, quality, token_count, token_records, url_filter
from lodestrata.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double"  # extra columns with clashing names
ODD = [None, "", " ", "\n\t ", "a", "a b", "A  b\tc", "a b c d e", "a b c d e", "x " * 5000, "日本語 テキスト ÉÈ <|endoftext|> don't  stop\n\n end ", "'s 12 34 5!!! …", "<|STARTOFTEXT|>a<|startoftext|>"]


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", 0, True, 0.0) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120").withColumn("kept", F.lit(True)).withColumn("score", F.lit(0.0))
    return d.unionByName(frame(spark, ODD, range(1000, 1000 + len(ODD)))).cache()


def near_texts():
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(120)) for _ in range(6)]
    out = []
    for b in base:
        w = b.split()
        for k in range(14):
            v = w[:]
            for _ in range(k % 5):
                v[r.randrange(len(v))] = f"new{r.randrange(9)}"
            out.append(" ".join(v))
    return out + ODD


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_minhash_finds_all_links(spark):
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    want = brute_components(len(texts), lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    nulls = minhash_dedup.near_duplicates(frame(spark, ["a b", "a b"], [None, 4])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in nulls) == [(-1, None, True), (4, 4, True)]


def test_minhash_estimate_corrects_collisions():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 62, 4000).astype(np.uint64))
    b = np.concatenate([a[:3000], r.integers(0, 1 << 62, 1000).astype(np.uint64)])
    low = minhash_dedup.minima([a, np.unique(b)]) & 15
    same = (low[0] == low[1]).mean()
    assert abs((same - 1 / 16) / (1 - 1 / 16) - 0.6) < 0.2


def test_components_over_many_tasks(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long"), task_edges=40).collect()}
    pairs = {(a, b) for a, b in edges if a is not None} | {(b, a) for a, b in edges if a is not None}
    nodes = sorted({a for a, b in pairs if a != b})
    want = brute_components(len(nodes), lambda i, j: (nodes[i], nodes[j]) in pairs)
    assert got == {n: nodes[w] for n, w in zip(nodes, want)}


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = token_count.count_tokens(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    assert token_count.count_tokens(frame(spark, [])).count() == 0


def test_codec(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe_codec.GPT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe_codec.round_trip_digests(docs).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe_codec.decode(bpe_codec.encode(docs)).collect()
    assert all(bytes(r.content).decode() == texts[r.doc_id] for r in back)


def library_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 1]


def test_packing(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    from collections import defaultdict

    rows = packing.pack_documents(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d in [*range(0, 120, 11), *range(1000, 1000 + len(ODD))]:
        ids, at = library_ids(texts[d]), 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            own = ids[at : at + 4096]
            assert (r.piece, r.start, r.length) == (k, at, len(own))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += 4096
        assert at >= len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    least = -(-sum(r.length for r in rows) // 4096)
    assert len(by_sequence) <= 1.03 * least + 1
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_sum_of_squares_rule():
    lengths = np.random.default_rng(2).integers(1, 30, 300)
    bins, offsets, gaps = packing.sum_of_squares(lengths, 30)
    filled: dict[int, int] = {}
    for s, b in zip(lengths.tolist(), bins.tolist()):
        now = [30 - v for v in filled.values() if v < 30]
        cost = lambda gs: sum(gs.count(g) ** 2 for g in set(gs) if g)
        options = [cost([x for i, x in enumerate(now) if i != k] + [g - s]) for k, g in enumerate(now) if g >= s] + [cost([*now, 30 - s])]
        filled[b] = filled.get(b, 0) + s
        assert cost([30 - v for v in filled.values() if v < 30]) == min(options)
    assert sorted(30 - v for v in filled.values()) == sorted(gaps.tolist())


def test_exact_dedup(spark, docs):
    import re

    texts = {r.doc_id: re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in docs.collect()}
    from collections import defaultdict

    groups = defaultdict(list)
    for d, t in texts.items():
        groups[t].append(d)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        own = groups[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    twice = exact_dedup.exact_duplicates(frame(spark, ["a", "a"], [3, 3])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in twice] == [(3, 2, True)] * 2


@pytest.mark.parametrize("share,pivots", [(4096, 1), (40, 8)])
def test_embedding_dedup(spark, share, pivots):
    r = np.random.default_rng(5)
    base = r.normal(size=(12, 8))
    x = np.concatenate([base[i % 12 : i % 12 + 1] + r.normal(size=(1, 8)) * 0.25 for i in range(150)] + [base[:1], base[:1] * 3, base[:1]])
    rows = [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0, float("nan")] + [0.0] * 6, 0), (903, [1.0, None] + [0.0] * 6, 0), (904, [1.0, 2.0], 0), (905, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    u = np.array([row for _, row, _ in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    want = brute_components(len(u), lambda i, j: s[i, j] >= 0.9)
    got = {q.vec_id: q for q in embedding_dedup.near_vectors(df, share=share, max_pivots=pivots).collect()}
    assert len(got) == len(rows) + len(odd)
    assert [got[i].n_links for i in range(len(u))] == ((s >= 0.9).sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(u))] == want
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _, _ in odd)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://A.example.net/en/1?x#y", "https://net/", "http://example.com/de/2", "x.org/fr/3", None, "http://m.ab.org/fr/9", "http://example.net", "http://bad.example.com/shop/5", "http://bad.example.com/en/6"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    train = spark.createDataFrame([(100 + i, f"http://{'bad' if i % 2 else 'good'}.example.com/{'shop' if i % 3 else 'en'}/{i}") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not (i % 2 and i % 3)), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages.union(train), labels, min_confidence=0.9).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert [got[i].rule for i in range(1, 7)] == ["net/", "example.com/de/", None, None, "org/fr/", None]
    assert (got[3].host, got[3].path, got[3].verdict) == ("", "", "allow") and (got[4].host, got[4].path) == ("", "")
    assert (got[7].verdict, got[8].verdict) == ("block", "allow")
    assert {r.verdict for r in url_filter.filter_urls(pages, None).collect() if r.rule is None} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language_id.document_languages(docs.unionByName(frame(spark, ["", None, "12 !!"], [5000, 5001, 5002]).select(*docs.columns))).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(got[d].lang == x for d, x in truth.items()) >= 0.98 * len(truth)
    assert all(not got[d].accepted and got[d].lang == "und" for d in (5000, 5001, 5002))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = language_id.page_languages(pages, docs).collect()
    assert len(rows) == pages.count() and sum(r.lang == r.declared for r in rows) >= 0.95 * len(rows)
    assert language_id.document_languages(docs.limit(0)).count() == 0


def test_token_records(spark, docs, tmp_path):
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    manifest = token_records.write_records(docs, str(tmp_path / "r"))
    got = sorted(token_records.read_records(spark, manifest).collect())
    start = 0
    for (d, t), r in zip(texts, got, strict=True):
        assert (r.doc_id, r.start) == (d, start)
        if d >= 1000 or d % 13 == 0:
            ids = library_ids(t)
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += r.n_tokens
    one = manifest.first()
    with open(f"{one.path.removeprefix('file:')}.rec", "r+b") as f:
        f.seek(30)
        f.write(b"\xff")
    with pytest.raises(OSError):
        list(token_records.iterate_shard(one.path))
    assert token_records.token_records(frame(spark, [])).count() == 0


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    truth = [(got[r.doc_id], r.quality) for r in labels.collect()]
    held = [(r.predicted, y) for r, y in truth if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    none = quality.score_documents(frame(spark, ODD), labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "exact dedup", "MinHash near-dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        if name == "exact dedup":
            kept = {r.doc_id for r in exact_dedup.exact_duplicates(docs).collect() if r.kept}
        else:
            kept = {r.doc_id for r in minhash_dedup.near_duplicates(docs, percent=corpus_pipeline.NEAR_PERCENT).collect() if r.kept}
        assert {r.doc_id for r in out.select("doc_id").collect()} == kept
        docs = out.cache()
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} <= {r.doc_id for r in docs.collect()}
