"""Near copies where one id stands on rows of different texts."""

from __future__ import annotations

from gleanery.llm import ngram_join


def test_links_of_each_text_of_an_id(spark):
    long = [f"w{i}" for i in range(4000)]
    relative = [f"v{i}" if i % 12 == 0 else w for i, w in enumerate(long)]
    short = [f"s{i}" for i in range(40)]
    rows = [(7, long), (7, short), (9, [*short, "end"]), (12, relative)]
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_groups(docs, 5, 85).collect()}
    assert got == {(7, 3996): 7, (7, 36): 7, (9, 37): 7, (12, 3996): 12}
