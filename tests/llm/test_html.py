import re
import time
from collections import Counter
from html import unescape

import numpy as np

from hearth.llm import html, layouts
from hearth.llm.queries import op9_html


def test_pages_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = op9_html(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:  # these pages hold their text in one article of headings and paragraphs
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
        assert r.text == want and r.n_chars == len(want) and r.url == pages[r.page_id].url


def accuracy(model, pages):
    right = total = 0
    for page, m in zip(pages, model.marginals(pages)):
        for b in {b for b, t in page.text if b >= 0 and t.strip()}:
            right += (m[b] >= 0.5) == page.label[b]
            total += 1
    return right / total


def words_of(page, keep):
    return [w for b, t in page.text if b >= 0 and keep[b] for w in t.split()]


def test_held_out_accuracy(monkeypatch):
    pages = [html.parse(s, labelled=True) for s in layouts.labelled_pages(3, seed=99)]
    assert accuracy(html.model(), pages) > 0.99  # new text in known layouts
    scores, hit, found, wanted = [], 0, 0, 0
    every = layouts.LAYOUTS
    for k in range(0, len(every), 3):  # layouts never seen
        monkeypatch.setattr(layouts, "LAYOUTS", every[:k] + every[k + 1:])
        trained = html.Model.train(layouts.labelled_pages(6))
        monkeypatch.setattr(layouts, "LAYOUTS", every[k:k + 1])
        test = [html.parse(s, labelled=True) for s in layouts.labelled_pages(4, seed=5)]
        scores.append(accuracy(trained, test))
        for page, m in zip(test, trained.marginals(test)):
            mine, right = words_of(page, m >= 0.5), words_of(page, page.label)
            common = sum((Counter(mine) & Counter(right)).values())
            hit, found, wanted = hit + common, found + len(mine), wanted + len(right)
    assert np.mean(scores) > 0.9
    assert hit > 0.95 * found and hit > 0.95 * wanted, (hit / found, hit / wanted)


TEXT = "This is a long enough sentence of the main text. It goes on, and ends here."


def test_attributes_are_read_whole():
    """Names that end like those of features or labels, and coordinates, are neither."""
    for attr in ('data-key="abc"', 'property="articleBody"', 'category="news"', 'y="10.5"', 'y="50%"', "y", 'data-id="comments"',
                 'data-class="ad"', 'data-role="navigation"', "=y=x", 'y="', "y='1"):
        page = f"<body><div class='menu'><a href='/'>menu</a></div><article {attr}><p>{TEXT}</p></article></body>"
        assert TEXT in html.extract_many([page], html.model())[0], attr
    page = f'<body><svg><rect y="50%" x="1"/><text y="10.5">no</text></svg><article><p y="0">{TEXT}</p></article></body>'
    assert html.extract_many([page], html.model()) == [TEXT]
    assert html.attributes(' data-id=a ID="b" id=c y') == {"data-id": "a", "id": "b", "y": ""}


def test_pages_without_a_container():
    pages = [f"<body>{TEXT}</body>", f"<html><head><title>t</title></head><body>{TEXT}</body></html>", f"<body><pre>{TEXT}</pre></body>",
             f"<body><h1>A heading</h1><p>{TEXT}</p></body>", f"<body><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></body>",
             f'<body><form id="aspnetForm"><div class="content"><p>{TEXT}</p></div></form></body>', f"<p>{TEXT}</p>",
             f"<html><body><h1>A heading</h1>" + f"<p>{TEXT}</p>" * 5 + "</body></html>", TEXT,
             *(f"<body><{t}><p>{TEXT}</p></{t}></body>" for t in ("div", "main", "section", "article")),
             f"<body><table><tr><td><p>{TEXT}</p></td></tr></table></body>"]
    for page in pages:
        want = " ".join(re.sub(r"<title>.*</title>|<[^>]*>", " ", page).split())
        assert html.extract_many([page], html.model()) == [want], page
    form = f"<body><article><p>{TEXT}</p></article><form class='search'><label>Search</label><input></form></body>"
    assert html.extract_many([form], html.model()) == [TEXT]


def test_broken_markup_takes_linear_time():
    n = 20_000
    for page in ("<font>" * n + "<h1>x" * n, "<b>" + "<div>" * n + "</b>" * n, "<li>" * n + "</ul>" * n, "<p><i>" * n, "</x>" * n,
                 "<td><tr>" * n, "<a href='" * n, "<div " * n):
        start = time.time()
        html.parse(page)
        assert time.time() - start < 3, page[:20]  # about a quarter second each on a free machine


def test_marginals_are_exact():
    page = html.parse("<body><div><p>a</p><p>b <b>c</b></p></div><nav><a>d</a></nav></body>")
    trees = html.Trees([page])
    rng = np.random.default_rng(0)
    n = len(page.tag)
    own, pair = rng.normal(size=n), rng.normal(size=(2, 2))
    one, both = trees.sum_product(own, pair)
    weight = np.zeros((n, 2))
    total = 0.0
    for state in np.ndindex(*[2] * n):
        w = np.exp(sum(own[k] * s for k, s in enumerate(state))
                   + sum(pair[state[page.parent[k]], state[k]] for k in range(1, n)))
        total += w
        for k, s in enumerate(state):
            weight[k, s] += w
    assert np.allclose(one, weight[:, 1] / total)
    assert np.allclose(both[1:].sum(axis=1)[:, 1], one[1:])


def test_awkward_pages(spark):
    text = "This is a long enough sentence of the main text. It goes on, and ends here."
    cases = {
        None: "", "": "", "   ": "", "<": "",
        f"<article><p>{text}<p><b>{text}<br>x &amp;amp; y&nbsp;z</article>": f"{text} {text} x &amp; y z",
        f"<article><p>{text}</p><!-- <p>no</p> --><script>if (a<b) '</p>'</script><p>a<i>b</i>c {text}</p></article><footer>f":
            f"{text} abc {text}",
        f"<nav><ul><li><a href='x'>m</a></ul></nav><article><p>{text}</p><div class='comments'><p>{text}</p></div></article>": text,
    }
    rows = [(i, f"u{i}", s, "x") for i, s in enumerate(cases)] + [(0, "u0", None, "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html.extract(df).collect()
    assert len(out) == len(rows)
    want = list(cases.values())
    for r in out:
        if r.page_id is not None:
            assert r.text == want[r.page_id], (r.text, want[r.page_id])
    long_ = "<div>" * 3000 + f"<article><p>{text}</p></article>" + "<p>" + "w " * 100_000
    assert text in html.extract_many([long_], html.model())[0]
    assert html.extract(df.limit(0)).count() == 0


def test_only_hidden_blocks_are_hidden():
    text = "This is a long enough sentence of the main text. It goes on, and ends here."
    visible = ['style="overflow:hidden"', 'class="overflow-hidden"', "class='hidden-print'", 'title="The hidden valley"',
               'aria-hidden="false"', "data-hidden=true", "class=hidden", 'style="display:block; overflow: hidden"',
               'style="display:none; display:block"', 'title="display:none"', 'style="/* display:none */ color:red"']
    gone = ["hidden", "HIDDEN", 'hidden=""', "class=x hidden", 'title="a" hidden', 'aria-hidden="true"', "aria-hidden=true",
            'style="display:none"', "style='color:red; DISPLAY : None !important; display:block'", 'style="visibility: hidden;"']
    for attr in visible + gone:
        shown = attr in visible
        assert html.hidden(html.attributes(" " + attr)) != shown, attr
        page = f"<body><article><p>{text}</p><p {attr}>Another sentence, that may be seen or not. It ends.</p></article></body>"
        assert ("Another" in html.extract_many([page], html.model())[0]) == shown, attr
        if shown:
            assert html.extract_many([f"<article {attr}><p>{text}</p><p>{text}</p></article>"], html.model()) == [f"{text} {text}"]
