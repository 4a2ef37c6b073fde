"""Every stage of the pipeline against a plain version, each on what its predecessor kept."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from factloom.llm import mixing, queries, toxicity
from factloom.llm.common import stage, table
from tests.llm.test_operators import SF, brute_contamination, roots, rows_of, shingles, texts


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = [docs]
    for name, run in corpus_pipeline.STAGES:
        kept.append(stage(run(spark, kept[-1], SF), name))
    assert all(sorted(k.columns) == sorted(columns) for k in kept[:-1])

    model = toxicity.fit(docs, table(spark, SF, "labels"))
    good = {d for d, score in rows_of(toxicity.score(docs, model), "doc_id", "score") if score < toxicity.THRESHOLD}
    assert {d for d, _ in texts(kept[1])} == good

    sets = {d: shingles(t) for d, t in texts(kept[1])}
    links = [(a, b) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    assert {d for d, _ in texts(kept[2])} == {d for d in sets if root[d] == d}

    bench = rows_of(table(spark, SF, "benchmark"), "item_id", "text")
    clean = {row[0] for row in brute_contamination(kept[2], bench) if not row[-1]}
    assert {d for d, _ in texts(kept[3])} == clean and len(clean) > 50

    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(kept[3]).collect()}
    assert Counter(d for d, _ in texts(kept[4])) == Counter({d: c for d, c in copies.items() if c})

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want, start = [], 0
    for doc, text in sorted(texts(kept[4])):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows_of(kept[5], "doc_id", "start", "n_tokens", "ids_crc32")) == want


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50
