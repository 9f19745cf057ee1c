"""Pages written by hand, each with the text it should give."""

import pytest

from clipweave.llm import extraction

P = [
    "The river rose for three days before the town noticed it. Nobody had measured the level since spring.",
    "By noon the lower road was closed. Farmers moved their animals to the hill and waited for news.",
    "On the fourth day the rain stopped. The water went back slowly, and the first shops opened again in the evening.",
]
H = "<h1>A river rises</h1>"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 Valley Press. All rights reserved.</p></footer>"
SIDE = '<div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">One story</a></li><li><a href="/2">Another story</a></li></ul></div>'
COMMENTS = '<div class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I saw it from my window. It was awful.</p></div></div>'
ps = "".join(f"<p>{p}</p>" for p in P)
T = ["A river rises", *P]


def page(body):
    return f"<html><head><title>x</title></head><body>{body}</body></html>"


def mid(extra):
    """An article with an element after its second paragraph."""
    return page(f"{NAV}<article>{H}<p>{P[0]}</p><p>{P[1]}</p>{extra}<p>{P[2]}</p></article>{FOOT}")


def want(*extra):
    return [T[0], P[0], P[1], *extra, P[2]]


CASES = {
    "plain article": (mid(""), want()),
    "h2": (mid("<h2>What comes next</h2>"), want("What comes next")),
    "h3": (mid("<h3>Next</h3>"), want("Next")),
    "short list": (mid("<ul><li>Boats</li><li>Sand bags</li><li>Lamps</li></ul>"), want("Boats", "Sand bags", "Lamps")),
    "sentence list": (mid("<ol><li>Call the office first.</li><li>Then move to the hill.</li></ol>"), want("Call the office first.", "Then move to the hill.")),
    "table": (mid("<table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>2 m</td></tr></table>"), want("Day", "Level", "Monday", "2 m")),
    "pre": (mid("<pre>level = 3\nprint(level)</pre>"), want("level = 3 print(level)")),
    "quote": (mid("<blockquote><p>We did not sleep at all.</p></blockquote>"), want("We did not sleep at all.")),
    "figure": (mid('<figure><img src="a.png"><figcaption>The bridge on Monday</figcaption></figure>'), want("The bridge on Monday")),
    "link": (mid('<p>Read the <a href="/r">report of the council</a> for more. It is long.</p>'), want("Read the report of the council for more. It is long.")),
    "definition list": (mid("<dl><dt>Crest</dt><dd>The highest point of a flood.</dd></dl>"), want("Crest", "The highest point of a flood.")),
    "all together": (
        mid("<h2>Facts</h2><ul><li>Boats</li></ul><table><tr><td>Day</td><td>One</td></tr></table><pre>x = 1</pre><blockquote>Nobody slept.</blockquote>"),
        want("Facts", "Boats", "Day", "One", "x = 1", "Nobody slept."),
    ),
    "advert inside": (mid('<div class="ad"><p>Buy new boots today.</p></div>'), want()),
    "notice inside": (mid('<div class="notice">We use cookies on this site.</div>'), want()),
    "share inside": (mid('<div class="share"><a href="/f">Share</a> <a href="/m">Mail</a></div>'), want()),
    "comments inside": (mid(f'<section class="comments"><p>I saw it too. It was awful.</p></section>'), want()),
    "script and style": (mid("<script>var a = 1;</script><style>p {}</style>"), want()),
    "form inside": (mid('<form><p>Your mail</p><input name="m"><button>Send</button></form>'), want()),
    "bare body": (page(H + ps), T),
    "bare body after menu": (page(NAV + H + ps + FOOT), T),
    "bare body with side bar": (page(NAV + SIDE + H + ps + COMMENTS + FOOT), T),
    "one paragraph after menu": (page(f"{NAV}<p>{P[0]} {P[1]} {P[2]}</p>"), [" ".join(P)]),
    "plain text": (" ".join(P), [" ".join(P)]),
    "body text": (f"<body>{' '.join(P)}</body>", [" ".join(P)]),
    "name with both hints": (page(f'{NAV}<div class="mw-body sidebar-open">{H}{ps}</div>{FOOT}'), T),
    "form around the page": (page(f'<form id="f">{NAV}<div class="content">{H}{ps}</div>{FOOT}</form>'), T),
    "form around a bare page": (page(f'<form id="f">{NAV}{H}{ps}</form>'), T),
    "main": (page(f"<header><a href='/'>Valley Press</a></header><main>{H}{ps}</main>{SIDE}{FOOT}"), T),
    "nameless div": (page(f"{NAV}<div>{H}{ps}</div>{FOOT}"), T),
    "side bar first": (page(f"{NAV}{SIDE}<div id='content'>{H}{ps}</div>{COMMENTS}{FOOT}"), T),
    "wrapper and sections": (page(f"<div class='wrapper'>{NAV}<article>{H}<section><h2>Start</h2><p>{P[0]}</p></section><section><h2>End</h2><p>{P[1]}</p></section></article></div>"), [T[0], "Start", P[0], "End", P[1]]),
    "cookie banner first": (page(f'<div class="cookie-banner"><p>We use cookies. You may refuse them.</p></div><article>{H}{ps}</article>'), T),
    "entities and breaks": (page(f"{NAV}<article>{H}<p>Salt &amp; bread,<br>three &euro; each. It was cheap.</p><p>{P[1]}</p></article>"), [T[0], "Salt & bread, three € each. It was cheap.", P[1]]),
}


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", CASES)
def test_page(model, name):
    html, wanted = CASES[name]
    assert extraction.main_text(html, model) == "\n\n".join(wanted)
