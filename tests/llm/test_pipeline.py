"""The corpus pipeline against its stages' own rules, applied one after the other in plain Python."""

import hashlib

import numpy as np
import pytest

from biblioflow.llm import decontaminate, secrets, simhash, toxicity
from tests.llm.test_operators import brute_components

P = pytest.importorskip("public_tokenizers")


def first_of_groups(ids, texts):
    """The ids of which no smaller one is reached by links of a Jaccard similarity of five-word shingles of 0.8 or more."""
    sets, parent, holders = {i: set(simhash.shingle_bytes(texts[i], 5)) for i in ids}, {i: i for i in ids}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        near = {j for p in sets[i] for j in holders.get(p, ())} if sets[i] else {j for j in parent if j < i and not sets[j]}
        for j in near:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for p in sets[i]:
            holders.setdefault(p, []).append(i)
    return [i for i in ids if find(i) == i]


def test_pipeline(spark, sf_dir):
    import sentencepiece

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, toxicity.fit(docs, toxicity.training(labels))).collect()}
    left = sorted(i for i in data if score[i] < 0.3)
    left = first_of_groups(left, {i: data[i]["text"] for i in left})
    flat = lambda t: " ".join(t.encode().lower().decode().split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = lambda x, t: decontaminate.edit_distance_within(x, t) <= len(x) // 5
    left = [i for i in left if not any(held(x, flat(data[i]["text"])) for x in items)]
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {i: hashlib.sha256(",".join(map(str, model.encode(masked[i]))).encode()).hexdigest() for i in left}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert len(brute_components(np.zeros(2, np.uint64), 0)) == 2
