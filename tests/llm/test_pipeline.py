"""The pipeline, stage by stage, against plain versions."""

import collections

import corpus_pipeline
import numpy as np
import public_tokenizers
from modewave.llm import bpe
from modewave.llm.common import stash
from test_text_operators import DATA, empty, odd, plain_components, plain_counts, plain_cover


def test_stages(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, now = d.columns, d
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stash(stage(spark, now, DATA), name)
        assert now.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in now.collect()})
    start = {r["doc_id"]: r["text"] for r in d.collect()}
    rules, exact, near, cut = kept
    # 1: base failures go; with as few labels no cutoff can take much more
    passed = {i for i, t in start.items() if (c := plain_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert set(rules) <= passed and len(rules) >= 0.8 * len(passed) and all(rules[i] == start[i] for i in rules)
    # 2: the largest id of equal texts
    last = {}
    for i in sorted(rules):
        last[rules[i]] = i
    assert set(exact) == set(last.values())
    # 3: the smallest id of each component
    parts = collections.defaultdict(list)
    for i, (_, c) in plain_components(exact, 5, 80).items():
        parts[c].append(i)
    assert set(near) == {min(v) for v in parts.values()}
    # 4: no passage of 50 words stands in two documents, others are untouched
    cover = plain_cover(near)
    assert all(cut[i] == t for i, t in near.items() if not cover[i])
    assert not any(plain_cover(cut).values())
    # 5: every id in one piece
    out = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: r["start"]):
        got[r["doc_id"]] += np.frombuffer(r["ids"], dtype="<u4").tolist()
    assert got == {i: [*enc.encode_ordinary(t), 0] for i, t in cut.items()}


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert "sequence_id" in out.columns and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_duplicates", "near_duplicates", "repeated_passages", "packed_sequences"]


def test_stages_on_odd_tables(spark):
    for make in (odd, empty):
        now = make(spark).select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            now = stash(stage(spark, now, DATA), "odd")
        now.count()
