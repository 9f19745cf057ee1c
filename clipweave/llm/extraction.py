"""Main text of web pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.dom import Tree, clean
from clipweave.llm.linear import train_logistic

#: Elements whose text is never shown as reading matter.  A form is not among them: it may wrap a whole page.
HIDDEN = frozenset(
    "head script style noscript template iframe object svg canvas title textarea select option button label input legend "
    "xmp noembed noframes audio video map datalist dialog".split()
)
_BAD = regex.compile(
    r"nav|menu|foot|header|masthead|side|(?<![a-z])ads?(?![a-z])|advert|banner|sponsor|promo|cookie|consent|notice|popup|modal|alert|"
    r"comment|discuss|reply|respond|disqus|share|social|related|recommend|subscribe|newsletter|signup|login|search|breadcrumb|"
    r"pagin|widget|toolbar|copyright|legal|tags?(?![a-z])|meta(?![a-z])|skip"
)
_GOOD = regex.compile(r"article|content|(?<![a-z])main|post(?!ed)|entry|story|body|text|page")
_TAGS = ("p", "h1", "h2", "h3", "li", "ul", "div", "section", "article", "main", "aside", "nav", "header", "footer", "a", "b", "span", "table", "td", "blockquote", "pre", "body", "html", "form", "figure", "#root")
_LIKE = {"ol": "ul", "dl": "ul", "dd": "li", "dt": "li", "h4": "h3", "h5": "h3", "h6": "h3", "th": "td", "code": "pre", "i": "b", "em": "b", "strong": "b", "hgroup": "header"}
_AT = {t: i for i, t in enumerate(_TAGS)} | {t: _TAGS.index(like) for t, like in _LIKE.items()}
_ASIDE = frozenset("nav aside footer".split())
_N = len(_TAGS) + 27


def features(tree: Tree) -> np.ndarray:
    """One row per element: tag, name hints, amounts of text, links and sentences below it, and the same around it."""
    n = len(tree.tag)
    own, sentences, linked = np.zeros(n), np.zeros(n), np.zeros(n)
    in_link = np.zeros(n, bool)
    x = np.zeros((n, _N), np.float32)
    base, depth = len(_TAGS), np.zeros(n)
    for i in range(1, n):
        p = tree.parent[i]
        in_link[i] = in_link[p] or tree.tag[i] == "a"
        depth[i] = depth[p] + 1
        k = _AT.get(tree.tag[i])
        if k is not None:
            x[i, k] = 1
        if tree.attrs[i]:
            named = tree.attributes(i)
            hint = " ".join(named.get(a, "") for a in ("class", "id", "role", "itemprop")).lower()
            if hint.strip():
                x[i, base] = bool(_BAD.search(hint))
                x[i, base + 1] = bool(_GOOD.search(hint))
                x[i, base + 2] = 1
                x[i, base + 14] = x[i, base] and x[i, base + 1]
            x[i, base + 3] = "hidden" in named or "display:none" in named.get("style", "").replace(" ", "")
    for node, _, text in tree.texts:
        size = len(text.strip())
        own[node] += size
        linked[node] += size * in_link[node]
        sentences[node] += text.count(". ") + text.count(".\n") + text.rstrip().endswith((".", "!", "?", "…", "。"))
    total, links, full = own.copy(), linked.copy(), sentences.copy()
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        total[p] += total[i]
        links[p] += links[i]
        full[p] += full[i]
    page = max(total[0], 1.0)
    x[:, base + 4] = np.log1p(own) / 6
    x[:, base + 5] = np.log1p(total) / 8
    x[:, base + 6] = links / np.maximum(total, 1)
    x[:, base + 7] = total / page
    x[:, base + 8] = np.log1p(full) / 3
    x[:, base + 9] = total == 0
    x[:, base + 10] = np.minimum(depth, 12) / 12
    x[:, base + 11] = (own > 0) & (own < 40)
    x[:, base + 12] = [t in HIDDEN for t in tree.tag]
    x[:, base + 13] = (full == 0) & (total > 0)
    x[0, _AT["#root"]] = 1
    # What lies around: hints of the elements above, and how much text, links and sentences the parent holds.
    for i in range(1, n):
        p = tree.parent[i]
        bad = x[i, base] and not x[i, base + 1]
        x[i, base + 15] = x[p, base + 15] or bad or tree.tag[i] in _ASIDE
        x[i, base + 16] = x[p, base + 16] or (x[i, base + 1] and not x[i, base]) or tree.tag[i] in ("article", "main")
        x[i, base + 17] = x[p, base + 4]
    up = np.maximum(np.array(tree.parent), 0)
    x[:, base + 18] = x[up, base + 5]
    x[:, base + 19] = x[up, base + 6]
    x[:, base + 20] = x[up, base + 8]
    x[:, base + 21] = total / np.maximum(total[up], 1)
    # Sentences beside the element, and its text without sentences: a short heading or item near much prose.
    beside = np.log1p(np.maximum(full[up] - full, 0)) / 3
    x[:, base + 22] = beside
    x[:, base + 23] = beside * x[:, base + 13] * (1 - x[:, base + 6])
    # Own prose as a share of the page's, where nothing above is named as a side matter; a side matter inside an article.
    prose = max((own - linked).sum(), 1.0)
    x[:, base + 24] = np.sqrt((own - linked) / prose) * (1 - x[:, base + 15])
    x[:, base + 25] = x[:, base + 15] * x[:, base + 16]
    x[:, base + 26] = x[:, base + 15] * (own > 0)
    return x


def marginals(parent: list[int], unary: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Probability of state 1 for each node of a tree, by sum-product up and down.

    ``unary``: (n, 2) log potentials; ``edge[s, t]``: log potential of a parent in state s with a
    child in state t.  Parents come before their children.
    """
    n = len(parent)
    e = np.exp(edge - edge.max())
    own = np.exp(unary - unary.max(1, keepdims=True))
    up = [(1.0, 1.0)] * n  # message of a node to its parent
    a, b = own[:, 0].tolist(), own[:, 1].tolist()
    (e00, e01), (e10, e11) = e.tolist()
    for i in range(n - 1, 0, -1):
        m0, m1 = e00 * a[i] + e01 * b[i], e10 * a[i] + e11 * b[i]
        s = m0 + m1
        up[i] = (m0 / s, m1 / s)
        p = parent[i]
        a[p] *= up[i][0]
        b[p] *= up[i][1]
        s = a[p] + b[p]
        a[p], b[p] = a[p] / s, b[p] / s
    out = np.empty(n)
    down = [(1.0, 1.0)] * n
    for i in range(n):
        f0, f1 = a[i] * down[i][0], b[i] * down[i][1]
        out[i] = f1 / (f0 + f1)
        if i + 1 < n:
            # Belief of the parent without what this child said, passed through the edge.
            c = i + 1
            p = parent[c]
            g0 = a[p] * down[p][0] / max(up[c][0], 1e-300)
            g1 = b[p] * down[p][1] / max(up[c][1], 1e-300)
            d0, d1 = e00 * g0 + e10 * g1, e01 * g0 + e11 * g1
            s = d0 + d1
            down[c] = (d0 / s, d1 / s)
    return out


class TreeModel:
    """Node potentials from logistic regression, edge potentials from counted label pairs."""

    def __init__(self, pages: list[tuple[Tree, np.ndarray]]):
        x = np.concatenate([features(t) for t, _ in pages])
        y = np.concatenate([v for _, v in pages])
        # Pages weigh alike, and so do the classes.
        w = np.concatenate([np.full(len(v), 1 / len(v)) for _, v in pages])
        w = w * np.where(y == 1, 0.5 / (w * y).sum(), 0.5 / (w * (1 - y)).sum())
        self.w, self.b = train_logistic(x, y.astype(float), w, l2=1e-4, rounds=400)
        counts = np.ones((2, 2))
        for tree, v in pages:
            p = np.array(tree.parent[1:], np.intp)
            np.add.at(counts, (v[p], v[1:]), 1)
        self.edge = np.log(counts / counts.sum(1, keepdims=True))

    def content(self, tree: Tree) -> np.ndarray:
        z = np.clip(features(tree) @ self.w + self.b, -12, 12)
        return marginals(tree.parent, np.stack([np.zeros(len(z)), z], 1), self.edge)


def blocks_of(tree: Tree, chosen: np.ndarray) -> list[str]:
    """Texts of the chosen elements in page order; a block ends where a block element begins or ends."""
    hidden = [False] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        hidden[i] = hidden[tree.parent[i]] or tree.tag[i] in HIDDEN
    out, pieces, last = [], [], -1
    for node, place, text in tree.texts:
        if hidden[node] or not chosen[node]:
            continue
        if place != last and pieces:
            out.append(clean(pieces))
            pieces = []
        pieces.append(text)
        last = place
    if pieces:
        out.append(clean(pieces))
    return [b for b in out if b]


def _labels(tree: Tree) -> np.ndarray | None:
    """Labels of the nodes: a ``data-label`` mark holds for all below it, else ``article`` is content."""
    marked = any("data-label" in a for a in tree.attrs)
    y = np.zeros(len(tree.tag), np.int64)
    for i in range(1, len(tree.tag)):
        y[i] = y[tree.parent[i]]
        if marked:
            y[i] = int(tree.attributes(i).get("data-label", y[i])) if tree.attrs[i] else y[i]
        elif tree.tag[i] == "article":
            y[i] = 1
        if tree.tag[i] in HIDDEN:
            y[i] = 0
    return y if y.any() else None


_WRAPS = (
    '<article>', '<main>', '<div class="content">', '<div id="post-body">', '<section class="entry">', '<div>', '<div itemprop="articleBody">',
    '<div class="mw-body sidebar-open">', '<div class="page-content has-sidebar">', '<article class="post comments-open">', '<td>', '<section>',
)
_PARTS = regex.compile(r"</?(?:p|h1)\b[^>]*>", regex.I)


def _enriched(body: str, say, rng: random.Random) -> str:
    """The article with more of what articles hold: headings, lists, tables, code, quotes, figures, links; and labelled noise."""
    link = lambda: f'<a href="/y">{say(rng.randint(1, 4))}</a>'
    some = lambda make, lo, hi: "".join(make() for _ in range(rng.randint(lo, hi)))
    rows = lambda: "<tr>" + some(lambda: f"<td>{say(rng.randint(1, 4))}</td>", 2, 4) + "</tr>"
    items = lambda k: some(lambda: f"<li>{say(rng.randint(1, k))}{'.' if k > 8 else ''}</li>", 2, 6)
    content = [
        lambda: f"<h2>{say(rng.randint(1, 6))}</h2>",
        lambda: f"<h3>{say(rng.randint(1, 6))}</h3>",
        lambda: f"<ul>{items(6)}</ul>",
        lambda: f"<ol>{items(25)}</ol>",
        lambda: f"<ul><li><p>{say(20)}.</p></li><li>{link()} {say(9)}</li></ul>",
        lambda: f"<table><tr><th>{say(1)}</th><th>{say(2)}</th></tr>{some(rows, 1, 4)}</table>",
        lambda: f"<pre><code>{say(rng.randint(2, 20))}</code></pre>",
        lambda: f"<blockquote><p>{say(rng.randint(4, 30))}.</p></blockquote>",
        lambda: f"<figure><img src='a.png'><figcaption>{say(rng.randint(2, 10))}</figcaption></figure>",
        lambda: f"<dl><dt>{say(2)}</dt><dd>{say(rng.randint(3, 15))}</dd></dl>",
        lambda: f"<p>{say(8)} {link()} {say(8)}.</p>",
        lambda: f"<p>{say(rng.randint(1, 5))}</p>",
        lambda: f"<section><h2>{say(3)}</h2><p>{say(20)}.</p><p>{say(12)}.</p></section>",
        lambda: f"<div><p>{say(25)}. {say(6)}.</p></div>",
    ]
    bad = lambda names: f'<div class="{rng.choice(names)}" data-label="0">'
    noise = [
        lambda: f'{bad(["ad", "advert", "promo-box"])}<p>{say(rng.randint(4, 40))}</p></div>',
        lambda: f'{bad(["notice", "cookie-banner", "newsletter"])}{say(rng.randint(4, 20))}.</div>',
        lambda: f'{bad(["share", "social-links", "tags"])}<ul>{some(lambda: f"<li>{link()}</li>", 2, 5)}</ul></div>',
        lambda: f'{bad(["related", "recommended"])}<h3>{say(2)}</h3><ul>{some(lambda: f"<li>{link()}</li>", 2, 5)}</ul></div>',
        lambda: f'<section class="comments" data-label="0"><h2>{say(1)}</h2><p>{say(20)}.</p><p>{say(9)}!</p></section>',
        lambda: f'<aside data-label="0"><p>{say(15)}.</p></aside>',
        lambda: f'<form data-label="0"><p>{say(5)}</p><input name="e"><button>{say(1)}</button></form>',
    ]
    ends = [m.end() for m in regex.finditer(r"</p>", body)]
    for at in sorted(rng.sample(ends, min(len(ends), rng.randint(0, 4))), reverse=True):
        more = "".join(rng.choice(content)() for _ in range(rng.randint(1, 3)))
        body = body[:at] + more + (rng.choice(noise)() if rng.random() < 0.5 else "") + body[at:]
    return body


def variants(page: str, others: list[str], rng: random.Random, n: int) -> list[tuple[Tree, np.ndarray]]:
    """The page itself and ``n`` pages in other layouts around the same article, with labels by construction."""
    tree = Tree(page)
    y = _labels(tree)
    m = regex.search(r"<article\b[^>]*>(.*?)</article>", page, regex.S | regex.I)
    if y is None or m is None:
        return []
    out = [(tree, y)]
    say = lambda k: html.escape(" ".join(rng.choice(others).split()[:k]))
    for _ in range(n):
        links = lambda: "".join(f'<li><a href="/x">{say(rng.randint(1, 3))}</a></li>' for _ in range(rng.randint(3, 9)))
        extras = [
            f"<header><a href='/'>{say(3)}</a><nav><ul>{links()}</ul></nav></header>",
            f"<nav>{links()}</nav>",
            f'<div class="{rng.choice(["menu", "navbar", "top-menu"])}"><ul>{links()}</ul></div>',
            f'<div class="{rng.choice(["ad", "advert", "sponsored", "promo"])}"><p>{say(rng.randint(4, 40))}</p></div>',
            f'<div class="{rng.choice(["cookie-notice", "notice", "banner", "alert"])}"><p>{say(rng.randint(6, 30))}.</p></div>',
            f'<aside class="{rng.choice(["sidebar", "related", ""])}"><h2>{say(3)}</h2><ul>{links()}</ul><p>{say(rng.randint(5, 40))}.</p></aside>',
            f'<div id="sidebar"><h3>{say(2)}</h3><p>{say(rng.randint(8, 60))}.</p></div>',
            f'<form action="/s"><p>{say(3)}</p><input name="q"><button>{say(1)}</button></form>',
        ]
        after = [
            f'<{rng.choice(["section", "div"])} class="{rng.choice(["comments", "comment-list", "responses"])}"><h3>{say(2)}</h3>'
            + "".join(f'<div class="comment"><b>{say(1)}</b><p>{say(rng.randint(5, 80))}.</p></div>' for _ in range(rng.randint(1, 6)))
            + "</section></div>",
            f"<footer><p>&copy; {say(4)}</p><ul>{links()}</ul></footer>",
            f'<div class="footer"><p>{say(rng.randint(4, 30))}.</p></div>',
        ]
        body = _enriched(m[1], say, rng) if rng.random() < 0.7 else m[1]
        kind = rng.random()
        if kind < 0.08:  # no markup but the text's own
            text = " ".join(_PARTS.split(m[1]))
            inside = f"{text[:rng.randint(40, 4000)]}"
            made = Tree(rng.choice([inside, f"<body data-label='1'>{inside}</body>"]))
            label = np.ones(len(made.tag), np.int64)
            if made.tag[1:2] == ["body"]:
                label[0] = 0
            out.append((made, label))
            continue
        before = "".join(rng.sample(extras, rng.randint(0, 4)))
        behind = "".join(rng.sample(extras[3:], rng.randint(0, 2)) + rng.sample(after, rng.randint(0, 3)))
        if kind < 0.3:  # no element of its own around the article; now and then a single paragraph
            parts = regex.split(r"(?<=</p>)", body)
            body = "".join(parts[: rng.randint(1, max(1, len(parts)))]) if rng.random() < 0.4 else body
            if rng.random() < 0.35:
                body = f"<p>{' '.join(' '.join(_PARTS.split(m[1])).split()[: rng.randint(20, 200)])}</p>"
            inside = regex.sub(r"<(p|h[1-6]|ul|ol|table|pre|blockquote|figure|dl|section|div)\b(?![^>]*data-label)", r'<\1 data-label="1"', body)
        else:
            wrap = rng.choice(_WRAPS)
            name = wrap[1:-1].split()[0]
            inside = f'{wrap[:-1]} data-label="1">{body}</{name}>'
            if name == "td":
                inside = f"<table><tr><td>{links()}</td>{inside}</tr></table>"
        whole = f"{before}{inside}{behind}"
        if rng.random() < 0.2:  # a form around the whole page
            whole = f'<form id="page" action="/">{whole}</form>'
        if rng.random() < 0.3:
            whole = f'<div class="{rng.choice(["wrapper", "page", "site sidebar-left", "container"])}">{whole}</div>'
        made = Tree(f"<html><head><title>{say(4)}</title></head><body>{whole}</body></html>")
        label = _labels(made)
        if label is not None:
            out.append((made, label))
    return out


def train(pages: DataFrame, sample: int = 120, layouts: int = 5, seed: int = 3, longest: int = 100_000) -> TreeModel | None:
    """Fit on at most ``sample`` pages that mark their article, each also in ``layouts`` other layouts.

    Pages of ``longest`` characters or more and pages without an id are not learned from (they are extracted).  Ids are
    chosen first, by a hash; html is fetched for the chosen ids only, once for a repeated id.
    """
    wanted = pages.where(F.col("html").rlike("(?i)<article[ >]") & (F.length("html") < longest))
    known = wanted.select("page_id").where("page_id is not null").distinct()
    ids = [r[0] for r in known.orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    chosen = wanted.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html"))
    rows = sorted(chosen.collect(), key=lambda r: ids.index(r["page_id"]))
    texts = [clean([t for _, _, t in Tree(r["html"]).texts]) for r in rows]
    texts = [t for t in texts if t]
    rng, made = random.Random(seed), []
    for r in rows if texts else []:
        made += variants(r["html"], texts, rng, layouts)
    return TreeModel(made) if made else None


def main_text(page: str | None, model: TreeModel | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    chosen = model.content(tree) >= 0.5 if model is not None else np.ones(len(tree.tag), bool)
    return "\n\n".join(blocks_of(tree, chosen))


def extract(pages: DataFrame, sample: int = 120) -> DataFrame:
    """Main text of each page, from its whole html.

    Every DOM element is a binary variable (content or not).  Its own potential comes from tag,
    names, and amounts of text, links and sentences; parent and child share a potential; messages
    go up and down the tree and give content marginals.  Trained on a bounded sample of pages
    whose article is marked (shorter than 100,000 characters, see ``train``), each also set in other
    layouts (menus, side bars, notices, adverts, forms, comments; articles with headings, lists, tables,
    code, quotes, figures; no element around the article, a form around the page) with the labels known.
    The model (about 50 numbers) is sent to the tasks.

    Text of elements with a marginal of one half or more is kept, but for scripts, styles, controls
    and the like; blocks are joined by two line breaks.  Null or empty html: empty text.  Broken
    markup is read as far as it goes.  Without any marked page all visible text is kept.
    Repeated rows repeat their result.  Empty input: no rows.

    Returns page_id, url, text, n_chars.
    """
    narrow = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    model = train(narrow, sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), model) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return narrow.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        read, "page_id long, url string, text string, n_chars long"
    )
