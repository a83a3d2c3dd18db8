"""Labelled pages that the HTML model is trained on.

Each layout is a page whose elements carry ``y="1"`` (main text) or ``y="0"``; other
elements inherit the label of their parent. ``{p}`` stands for a paragraph, ``{h}`` for
a heading, ``{s}`` for a short line, ``{k}`` for a linked line.
"""

from __future__ import annotations

import random

HEAD = '<head y="0"><title>{h}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
MENU = '<ul><li>{k}</li><li>{k}</li><li>{k}</li><li>{k}</li><li>{k}</li></ul>'
TEXT = '<p>{p}</p><p>{p}</p><p>{p}</p>'

# Layouts and their labels.
LAYOUTS = (
    '<body y="0"><nav>' + MENU + '</nav><article y="1"><h1>{h}</h1>' + TEXT + '</article><footer>&copy; {s}</footer></body>',
    '<body y="0"><nav>' + MENU + '</nav><div class="ad">{s}</div><article y="1"><h1>{h}</h1><p>{p}</p><p>{s}</p></article>'
    '<footer>{s}</footer></body>',
    '<body y="0"><header><h2>{s}</h2><nav>' + MENU + '</nav></header><main y="1"><h1>{h}</h1>' + TEXT
    + '</main><aside><h3>{s}</h3>' + MENU + '</aside><footer><p>{s}</p></footer></body>',
    '<body y="0"><div id="header">{s}</div><div class="menu">' + MENU + '</div><div id="content" y="1"><h1>{h}</h1>' + TEXT
    + '</div><div class="sidebar">' + MENU + '</div><div id="footer">{s}</div></body>',
    '<body y="0"><div class="banner notice"><p>{s}</p></div><div class="post" y="1"><h2>{h}</h2>' + TEXT
    + '<blockquote>{p}</blockquote></div><div class="comments"><h3>{s}</h3><div class="comment"><p>{p}</p></div>'
    '<div class="comment"><p>{s}</p></div></div></body>',
    '<body y="0"><div class="cookie-notice"><p>{p}</p><button>{s}</button></div><article y="1"><header><h1>{h}</h1></header>'
    + TEXT + '<ul><li>{s}</li><li>{s}</li></ul></article><section id="comments" class="comments"><article class="comment">'
    '<p>{p}</p></article><article class="comment"><p>{p}</p></article></section><footer>{s}</footer></body>',
    '<body y="0"><article y="1"><h1>{h}</h1><p>{p}</p><div class="ad" y="0">{s}</div><p>{p}</p>'
    '<aside class="related" y="0"><h4>{s}</h4>' + MENU + '</aside><p>{p}</p><section class="comments" y="0"><h3>{s}</h3>'
    '<p>{p}</p><p>{p}</p></section></article><footer>{s}</footer></body>',
    '<body y="0"><form class="search"><label>{s}</label><input><button>{s}</button></form><div class="article-body" y="1">'
    '<h1>{h}</h1>' + TEXT + '<table><tr><td>{s}</td><td>{s}</td></tr></table></div><form class="newsletter"><p>{s}</p>'
    '<input></form></body>',
    '<body y="0"><div class="page"><div class="nav">' + MENU + '</div><div class="entry-content" y="1">' + TEXT
    + '<h2>{h}</h2>' + TEXT + '</div><div class="widget">' + MENU + '</div></div></body>',
    '<body y="0"><div class="wrapper"><div class="top-bar">{s}</div><main><article class="post" y="1"><h1>{h}</h1>'
    '<p>{p}<br>{p}</p><pre>{s}</pre><p>{s}</p></article><div class="share">' + MENU + '</div></main></div></body>',
    '<body y="0"><div role="navigation">' + MENU + '</div><div role="main" y="1"><h1>{h}</h1><div>{p}</div><div>{p}</div>'
    '</div><div role="complementary">{s}</div><div role="contentinfo">{s}</div></body>',
    '<body y="0"><aside class="promo advert"><p>{p}</p></aside><section class="story" y="1"><h1>{h}</h1>' + TEXT
    + '<figure><figcaption>{s}</figcaption></figure></section><div class="advertisement"><p>{s}</p></div></body>',
    '<body y="0"><div class="notice">{p}</div><nav class="breadcrumb">' + MENU + '</nav><article y="1"><h1>{h}</h1><section>'
    '<h2>{h}</h2>' + TEXT + '</section><section><h2>{h}</h2>' + TEXT + '</section></article><nav class="pagination">'
    + MENU + '</nav></body>',
    '<body y="0"><div class="alert">{s}</div><div class="text" y="1"><p>{p}</p><p>{s}</p><ol><li>{p}</li><li>{s}</li></ol>'
    '</div><div class="copyright">{s}</div></body>',
    '<body y="0"><header class="site-header">{s}</header><article y="1"><p>{p}</p></article><div class="reply">'
    '<p>{p}</p><form><textarea></textarea></form></div><footer class="site-footer">' + MENU + '</footer></body>',
    '<body y="0"><div class="sponsored"><p>{p}</p></div><article y="1"><h1>{h}</h1><p>{s}</p><p>{s}</p><p>{s}</p></article>'
    '<aside>{p}</aside></body>',
    '<body y="0"><article y="1"><h1>{h}</h1><div class="body"><p>{p}</p><p>{p}</p></div><div class="newsletter" y="0">'
    '<p>{s}</p></div><form y="0"><p>{s}</p><input></form><nav y="0">' + MENU + '</nav><footer y="0">{s}</footer></article>'
    '<div id="disqus_thread"><p>{p}</p></div></body>',
    '<body y="0"><dialog><p>{p}</p></dialog><noscript>{s}</noscript><article y="1"><h1>{h}</h1>' + TEXT
    + '<p>{s}</p></article><aside class="sidebar"><p>{p}</p>' + MENU + '</aside></body>',
    '<body y="0"><table class="layout"><tr><td class="left">' + MENU + '</td><td class="main-text" y="1"><p>{p}</p><p>{p}</p>'
    '</td></tr></table><center><small>{s}</small></center></body>',
    '<body y="0"><nav>' + MENU + '</nav><div class="comment-list"><div class="comment"><p>{p}</p></div></div>'
    '<article y="1"><h1>{h}</h1><p>{p}</p><dl><dt>{s}</dt><dd>{p}</dd></dl></article><div class="ads">{p}</div></body>',
    # pages without a container, short and bare ones
    '<body y="1">{p}</body>',
    '<body y="1">{p}<br><br>{p}</body>',
    '<body y="1"><h1>{h}</h1>{p}<p>{p}<div class="footer" y="0">{s}</div></body>',
    '<body y="1"><h1>{h}</h1><p>{p}</p></body>',
    '<body y="1"><h2>{h}</h2><p>{s}</p><p>{p}</p></body>',
    '<body y="1">' + TEXT + '</body>',
    '<body y="1"><p>{p}</p></body>',
    '<body y="1"><pre>{p}</pre></body>',
    '<body y="1"><h3>{h}</h3><pre>{p} {p}</pre><p>{p}</p></body>',
    '<body y="1"><div>{p}</div><div>{p}</div></body>',
    '<body y="1"><nav y="0">' + MENU + '</nav><h2>{h}</h2>' + TEXT + '<footer y="0">{s}</footer></body>',
    '<body y="1"><div id="menu" y="0">' + MENU + '</div><p>{p}</p><p>{s}</p><form y="0"><label>{s}</label><input></form></body>',
    '<h1 y="1">{h}</h1><p y="1">{p}</p><p y="1">{p}</p>',
    '<div y="1"><p>{p}</p><p>{p}</p></div>',
    '<main y="1"><p>{p}</p></main>',
    '<body y="0"><section y="1"><p>{p}</p></section></body>',
    '<body y="0"><blockquote y="1"><p>{p}</p></blockquote></body>',
    '<body y="1"><ul><li>{p}</li><li>{p}</li></ul></body>',
    '<body y="1"><h1>{h}</h1>{p}<br>{p}</body>',
    '<body y="1">{p}<p>{p}</p></body>',
    '<body y="0"><div y="1"><h1>{h}</h1><p>{p}</p></div><div class="footer">{s}</div></body>',
    '<body y="0"><div y="1">{p}</div></body>',
    '<body y="0"><div class="container"><div y="1"><p>{p}</p><p>{p}</p></div></div></body>',
    '<body y="0"><div class="container"><div class="row" y="1"><p>{p}</p></div><div class="row footer"><p>{s}</p></div></div></body>',
    # what doesn't belong to the text, within it and beside it
    '<body y="0"><article y="1"><p>{p}</p><div class="advert" y="0"><p>{p}</p></div><p>{p}</p><div class="comments" y="0">'
    '<h3>{s}</h3><p>{p}</p></div></article></body>',
    '<body y="0"><div class="content" y="1"><p>{p}</p><aside y="0"><p>{p}</p></aside><div class="ad" y="0">{p}</div><p>{p}</p>'
    '<section id="comments" y="0"><p>{p}</p><p>{p}</p></section></div></body>',
    '<body y="0"><main y="1"><h1>{h}</h1><p>{p}</p><section class="comments" y="0"><h2>{s}</h2><div><p>{p}</p></div></section>'
    '</main><aside class="sponsored"><p>{p}</p></aside></body>',
    '<body y="0"><aside><p>{p}</p></aside><div class="sponsored promo">{p}</div><main y="1"><p>{p}</p><p>{s}</p></main></body>',
    '<body y="0"><div class="notice"><p>{p}</p></div><div id="article" y="1"><p>{p}</p><div class="ad sponsored" y="0"><p>{s}</p></div>'
    '<p>{p}</p></div><aside class="ads">{p}</aside><section class="comments"><p>{p}</p></section></body>',
    # a form around the whole page, and forms within it
    '<body y="0"><form id="aspnetForm" action="/"><div class="content" y="1"><p>{p}</p></div></form></body>',
    '<body y="0"><form id="form1"><div class="header">{s}</div><div id="content" y="1"><h1>{h}</h1>' + TEXT
    + '</div><div class="footer">{s}</div></form></body>',
    '<body y="0"><form id="theForm"><div id="main" y="1"><h1>{h}</h1><p>{p}</p></div></form></body>',
    '<body y="0"><form name="main"><table><tr><td class="nav">' + MENU + '</td><td y="1"><p>{p}</p><p>{p}</p></td></tr></table></form></body>',
    '<body y="0"><article y="1"><h1>{h}</h1>' + TEXT + '</article><form class="contact"><p>{p}</p><label>{s}</label><textarea>'
    '</textarea><button>{s}</button></form></body>',
    '<body y="0"><form><label>{s}</label><input></form><div class="content" y="1"><p>{p}</p></div><form id="subscribe"><p>{s}</p>'
    '<div>{s}</div><input></form></body>',
    # further names of containers
    '<body y="0"><div id="top">{s}</div><div id="article-text" y="1"><p>{p}</p><p>{p}</p></div><div id="bottom">{s}</div></body>',
    '<body y="0"><div class="header">{s}</div><div class="main-content" id="main" y="1"><h1>{h}</h1><p>{p}</p><div class="ad" y="0">'
    '<p>{s}</p></div><p>{p}</p></div><div class="sidebar">{s}</div></body>',
    '<body y="0"><div class="post article" y="1"><h2>{h}</h2><p>{p}</p><aside class="promo" y="0"><p>{p}</p></aside><p>{s}</p></div>'
    '<section class="comments"><p>{p}</p><p>{s}</p></section><form class="reply"><p>{s}</p><input></form></body>',
    '<body y="0"><div class="story-body" y="1"><p>{p}</p><p>{p}</p></div><div id="comments"><p>{p}</p></div></body>',
    '<body y="0"><div id="article" y="1"><h1>{h}</h1><p>{p}</p><p>{p}</p></div></body>',
    '<body y="0"><div class="page-content" y="1"><p>{p}</p><div class="comments" y="0"><p>{p}</p></div></div></body>',
    '<body y="1">{s}<br>{p}<br>{p}</body>',
    '<body y="1"><pre>{p} {p}</pre><hr><pre>{s}</pre></body>',
    '<body y="0"><div class="content" y="1"><div class="ad" y="0">{s}</div><p>{p}</p><p>{p}</p><aside y="0">{p}</aside></div></body>',
    '<body y="0"><div class="notice">{s}</div><div class="article" y="1"><p>{p}</p><section y="1"><h2>{h}</h2><p>{p}</p></section></div>'
    '<section class="comments"><p>{p}</p></section></body>',
    '<nav>' + MENU + '</nav><article y="1"><p>{p}</p><p>{p}</p></article><footer>{s}</footer>',
    '<nav><ul><li>{k}</li></ul></nav><article y="1"><p>{p}</p><div class="comments" y="0"><p>{p}</p></div></article>',
    '<body y="0"><article y="1"><p>{p}</p><section class="comment-list" y="0"><p>{p}</p></section></article></body>',
    '<article y="1"><p>{p}</p></article>',
)


def labelled_pages(copies: int = 8, seed: int = 7) -> list[str]:
    """The layouts filled in with invented words, ``copies`` times each."""
    rng = random.Random(seed)

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(1, 9))) for _ in range(n))

    def fill(layout: str) -> str:
        out, rest = [], (HEAD if rng.random() < 0.7 else "") + layout
        rest = rest.replace("{{", "\x00").replace("}}", "\x01")
        while True:
            head, mark, tail = rest.partition("{")
            out.append(head)
            if not mark:
                break
            kind, rest = tail[0], tail[2:]
            if kind == "p":
                out.append(". ".join(words(rng.randint(4, 18)).capitalize() for _ in range(rng.randint(1, 9))) + ".")
            elif kind == "h":
                out.append(words(rng.randint(2, 12)).capitalize())
            elif kind == "s":
                out.append(words(rng.randint(1, 12)).capitalize() + rng.choice(["", "."]))
            else:
                out.append(f'<a href="/{words(1)}">{words(rng.randint(1, 4))}</a>')
        return "<html>" + "".join(out).replace("\x00", "{").replace("\x01", "}") + "</html>"

    return [fill(x) for _ in range(copies) for x in LAYOUTS]
