"""Queries against brute force where the SQL definition does less than the whole job."""

import numpy as np
import pandas as pd

from loomlight.operators import vectors
from loomlight.plans import registry

DATA = "/root/testdata/sf0.001"


def brute_nearest(ids, matrix, asked):
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    out = {}
    for q in asked:
        near = np.floor(unit @ unit[ids == q][0] * 1e6 + 0.5) / 1e6
        out[int(q)] = [(int(ids[i]), float(near[i])) for i in np.lexsort((ids, -near)) if ids[i] != q][:5]
    return out


def test_cosine_looks_at_every_label(spark, monkeypatch):
    raw = pd.read_parquet(f"{DATA}/embeddings.parquet")
    ids, matrix = raw["vec_id"].to_numpy(), np.stack(raw["embedding"]).astype(float)
    want = brute_nearest(ids, matrix, ids[ids % 50 == 0])
    for block in (vectors.BLOCK, 3):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {}
        for r in registry.queries()["sim_cosine_topk"](spark, DATA).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["similarity"]))
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1.5e-6)


def test_cosine_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000, 0, -1)] + [(0, [2.0, 4.0]), (5000, None), (5001, [0.0, 0.0]), (5002, [1.0, None]), (5003, [1.0]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = vectors.nearest(frame, frame.where("vec_id in (0, 5003)")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, i, 1.0, i) for i in range(1, 6)]


def test_recap_holds_briefing_and_errors(spark):
    """Timeline and chunks against the steps of the reference over its parts."""
    rows = lambda name, by: {d: sorted(g, key=lambda r: r[by]) for d, g in grouped_rows(registry.queries()[name](spark, DATA)).items()}
    events, brief, errors, turns = rows("recap_events", "idx"), rows("recap_briefing", "nth"), rows("digest_errors", "rank"), rows("recap_relevance", "idx")
    timeline, groups, chunks = rows("recap_timeline_whole", "place"), rows("recap_chunk_groups", "grp"), rows("recap_chunks_by_chars", "place")
    by_count, highlights = rows("recap_chunks_by_count", "chunk"), rows("recap_highlights", "grp")
    assert any(errors.values()) and any(brief.values())
    for d in turns:
        first = [(r["nth"] - 1, 0, "briefing", r["summary"].strip()) for r in brief.get(d, [])]
        spoken = lambda r: r["idx"] % 4 == 0 or r["idx"] < 2
        said = [r for r in events.get(d, []) if spoken(r)]
        slots = max(400, min(2400, len(turns[d]) * 3 // 4)) - len(first) - len(said)
        others = [r for r in events.get(d, []) if not spoken(r)][-slots:] if slots > 0 else []
        want = [x[2:] for x in sorted(first + [(r["idx"], 1, r["kind"], r["summary"]) for r in said + others], key=lambda x: x[:2])]
        want += [("error", f"Error {r['signature']}: {r['message']}") for r in errors.get(d, [])[:5]]
        assert [(r["kind"], r["summary"]) for r in timeline.get(d, [])] == want
        assert ("briefing" in {r["grp"] for r in groups.get(d, [])}) == bool(first) == ("briefing" in {r["grp"] for r in highlights.get(d, [])})
        assert sum(r["n_events"] for r in by_count.get(d, [])) == len(want) and all(r["n_events"] <= 80 for r in by_count.get(d, []))
        chunk, n, chars = 0, 0, 0
        for (kind, summary), r in zip(want, chunks.get(d, []), strict=True):
            size = len(f"[{kind}] {summary}")
            if n >= 80 or (n and chars + size > 18_000):
                chunk, n, chars = chunk + 1, 0, 0
            n, chars = n + 1, chars + size
            assert r["chunk"] == chunk


def grouped_rows(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out
