"""Pages with more links than a page's range of node numbers, and pages whose links stand in long texts."""

from __future__ import annotations

import itertools
import threading

from pyspark.sql import functions as F

from gleanery.functions import arrays as A
from gleanery.plans import catalog, graphs


def _page(i, hrefs):
    return (i, f"http://x/{i}", "".join(f'<a href="{h}">t</a>' for h in hrefs))


def test_paths_of_wide_pages_are_parted(spark, tmp_path):
    wide = [f"/w{k}" for k in range(4000)]
    pages = [_page(0, wide), _page(1, ["/n0", "/n1"]), _page(2, ["/o"]), _page(3, ["/w3999"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    nodes, edges = graphs._graph(spark, str(tmp_path))
    assert nodes.count() == nodes.distinct().count() == 4 + 4003 and edges.count() == 4004
    degrees = {r.node: r for r in catalog.QUERIES["agg02_degrees"](spark, str(tmp_path)).collect()}
    assert len(degrees) == 4007 and sorted(r.indegree for r in degrees.values())[-2:] == [1, 2] and degrees[0].outdegree == 4000
    assert [degrees[p * 2048 + r * 2 + 1].indegree for p, r in ((0, 1), (0, 1024), (1, 1), (1, 2), (2, 1))] == [1] * 5
    component = {r.node: r.component for r in catalog.QUERIES["set13_connected_components"](spark, str(tmp_path)).collect()}
    assert len(set(component.values())) == 3 and component[3 * 2048] == component[0] and component[2048] != component[0] != component[4096]


def test_scored_links_of_a_long_page(spark, tmp_path):
    """Text behind the last link, brackets that begin none, and many links: time grows with the page, not with its square."""
    n = 2000
    html = "".join(f'<p>born in <a href="/P_{i}">Place {i}</a></p>' for i in range(n)) + "[" * 100_000 + "x" * 100_000
    spark.createDataFrame([(7, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = []
    run = threading.Thread(target=lambda: got.extend(catalog.QUERIES["txt09_txt12_scored_links"](spark, str(tmp_path)).collect()), daemon=True)
    run.start()
    run.join(60)
    assert [(r.page_id, r.rank, r.url) for r in sorted(got, key=lambda r: r.rank)] == [(7, i + 1, f"https://en.wikipedia.org/wiki/P_{i}") for i in range(n)]
    assert {r.rank: round(r.score, 9) for r in got if r.rank in (30, 31, 101)} == {30: 4.6, 31: 4.0, 101: 3.6}


def test_running_sums(spark):
    xs = [i % 7 for i in range(1000)]
    rows = spark.createDataFrame([([],), ([3],), (xs[:128],), (xs[:129],), (xs,), (None,)], "x array<int>")
    for x, s in rows.select("x", A.running_sum(F.col("x"))).collect():
        assert s == (None if x is None else list(itertools.accumulate(x)))
