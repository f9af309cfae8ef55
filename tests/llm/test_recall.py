"""Near duplicates on whole tables by brute force: documents whose id is divisible by 50 against all, every vector against all.

RECALL_DIR names other tables; the README's figure is of sf 0.1.
"""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from siftline.llm import embedding, minhash

DATA, CHECK = os.environ.get("RECALL_DIR", "/root/testdata/sf0.01"), "/root/testdata/check_s"


def test_recall_of_near_duplicates(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(docs, k=4).collect()}
    sets, holders = {}, defaultdict(list)
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    asked = [i for i in sets if i % 50 == 0]
    wanted = set().union(*(sets[i] for i in asked))
    for i, s in sets.items():
        for x in s & wanted:
            holders[x].append(i)
    pairs = 0
    for i in asked:
        common = Counter(j for x in sets[i] for j in holders[x])
        for j, n in common.items():
            if j != i and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                pairs += 1
                assert got[i][0] == got[j][0], (i, j)
    assert pairs > 0 and all(got[i][1] == len(s) for i, s in sets.items())
    print(f"recall 1.0 on {pairs} pairs of {len(asked)} documents against {len(sets)}")


@pytest.mark.skipif(not os.path.isdir(CHECK), reason="the sf tables hold no near vectors")
def test_recall_of_near_vectors(spark):
    df = spark.read.parquet(f"{CHECK}/embeddings.parquet")
    rows = df.collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_vectors(df, per_cell=256).collect()}
    x = np.array([r.embedding for r in rows], np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x, label, ids = x / np.where(norm > 0, norm, 1), np.array([-1 if r.label is None else r.label for r in rows]), np.array([r.vec_id for r in rows])
    pairs = 0
    for k in range(len(ids)):
        near = np.flatnonzero((x @ x[k] >= 0.98) & (label == label[k]) & (label >= 0))
        near = near[near != k]
        assert got[int(ids[k])][0] == len(near)
        assert all(got[int(ids[j])][1] == got[int(ids[k])][1] for j in near)
        pairs += len(near)
    assert pairs > 20
    print(f"recall 1.0 on {pairs} links of {len(ids)} vectors")
