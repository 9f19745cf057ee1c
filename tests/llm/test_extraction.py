"""DOM extraction: the model against enumeration, pages whose article is known, other layouts, edges."""

import html
import itertools
import random
import re

import numpy as np

from clipweave.llm import extraction
from clipweave.llm.dom import Tree
from clipweave.llm.queries import QUERIES


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        unary, edge = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        weight, want = 0.0, np.zeros(n)
        for s in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(unary[i, s[i]] for i in range(n)) + sum(edge[s[parent[i]], s[i]] for i in range(1, n)))
            weight += p
            want += p * np.array(s)
        assert np.allclose(extraction.marginals(parent, unary, edge), want / weight)


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", "\n"))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_query_gives_the_marked_articles(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op4_dom_tree_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    right = sum(r["text"] == article(pages[r["page_id"]]["html"]) for r in rows)
    assert right / len(rows) >= 0.99
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in rows)


def test_held_out_layouts(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    model = extraction.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    texts = [article(p) for p in pages[:60]]
    rng, good, kept, wanted = random.Random(99), 0, 0, 0
    for page in pages[100:200]:
        for tree, y in extraction.variants(page, texts, rng, 3)[1:]:
            found = extraction.blocks_of(tree, model.content(tree) >= 0.5)
            truth = extraction.blocks_of(tree, y == 1)
            good += sum(len(b) for b in found if b in truth)
            kept += sum(map(len, found))
            wanted += sum(map(len, truth))
    assert good / kept > 0.95 and good / wanted > 0.95


def test_tree_of_broken_markup():
    tree = Tree('<ul><li>a<li>b</ul><p>x<b>y<p>z<!-- <p>no --><script>var t="</p>";</script><a title="a>b">q</a></i>')
    assert [t for t in tree.tag if t in ("li", "p")] == ["li", "li", "p", "p"]
    assert tree.parent[tree.tag.index("li") + 1] == tree.tag.index("ul")
    said = "".join(t for _, _, t in tree.texts)
    assert said == "abxyzq"
    assert extraction.blocks_of(tree, np.ones(len(tree.tag), bool)) == ["a", "b", "xy", "zq"]


def test_edges(spark):
    base = [(r["page_id"], r["url"], r["html"], "x") for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    odd = [None, "", "plain &amp; text", "<", "<p", "</p></p>", "<article><p>" + "long text. " * 200000, "<div>" * 3000 + "deep"]
    rows = base + [(10**6 + i, None, h, "x") for i, h in enumerate(odd)] + [(10**6, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = [r for r in extraction.extract(df).collect() if r["page_id"] >= 10**6]
    by = {r["page_id"] - 10**6: r["text"] for r in found}
    assert len(found) == len(odd) + 1 and by[0] == "" and by[1] == ""
    assert by[6] == ("long text. " * 200000).strip()
    assert extraction.extract(df.limit(0)).count() == 0
    bare = spark.createDataFrame([(1, "u", "<p>a&nbsp; b</p><script>x</script>", "x")], df.schema)
    assert extraction.extract(bare).first()["text"] == "a b"
