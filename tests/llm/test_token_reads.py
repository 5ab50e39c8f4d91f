"""Single documents of token segments."""

from __future__ import annotations

import numpy as np

from gleanery.llm import token_files


def test_picked_documents(spark):
    r = np.random.default_rng(8)
    sizes = np.array([1, 128, 129, 1000, 1, 300])
    ids = np.where(r.random(sizes.sum()) < 0.01, 49000, r.integers(0, 900, sizes.sum()))
    lists = token_files.pack(ids, sizes) | {"ids": np.arange(6), "known": np.ones(6, np.uint8), "sizes": sizes}
    at = np.concatenate([[0], np.cumsum(sizes)])
    for docs in ([0], [3], [1, 2, 5], [4], list(range(6))):
        part = token_files.picked(token_files.from_segment(token_files.to_segment(lists)), np.array(docs))
        assert (token_files.unpack(part, part["sizes"]) == np.concatenate([ids[at[d] : at[d + 1]] for d in docs])).all()
        assert sum(len(part[n]) for n in ("least",)) == sum(-(-sizes[d] // 128) for d in docs)


def test_reading_some_documents(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * (40 * i)) for i in range(9)] + [(None, "none")], "doc_id long, text string")
    path = token_files.write(docs, n_parts=2)
    whole = {x.doc_id: x for x in token_files.read(spark, path).collect()}
    assert sorted(token_files.read(spark, path, only=[2, 7, 99]).collect()) == [whole[2], whole[7]]
