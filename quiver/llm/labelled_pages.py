"""Labelled pages for the main-text model.

Small pages of common layouts. ``main`` opens the article (its element and everything below is main text),
``skip`` marks an element that is not part of it although it lies inside. The marks are labels only, the
model never sees them.
"""

import random

_P = "Long running text of the article with several clauses, and a full stop. It goes on for another sentence."
_S = "Short one."
_LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li><li><a href="/c">About</a></li></ul>'

PAGES = [
    f'<html><body><nav>{_LINKS}</nav><div class="ad">Buy now for less.</div><article main><h1>Title words here</h1><p>{_P}</p><p>{_S}</p><p>{_P}</p></article><footer>&copy; example. All rights.</footer></body></html>',
    f'<body><nav>{_LINKS}</nav><div class="ad">{_P}</div><article main><h1>Title</h1><p>{_S}</p><p>{_S}</p><p>Of.</p></article><footer>&copy; site. {_S}</footer>',
    f'<body><header><h1>Site name</h1><nav>{_LINKS}</nav></header><main><div class="content" main><h2>Heading</h2><p>{_P}</p><p>{_S}</p><ul><li>First point of the list.</li><li>Second point.</li></ul></div></main><aside class="sidebar"><h3>Latest</h3>{_LINKS}<p>{_S}</p></aside><footer><p>Contact us. {_S}</p></footer></body>',
    f'<body><div id="wrapper"><div id="header">Site name and slogan</div><div id="menu">{_LINKS}</div><div id="main"><div class="post" main><h1>Title</h1><p>{_P}</p><p>{_P}</p><div>{_S}</div><div class="comments" skip><h3>Comments</h3><div class="comment"><p>{_P}</p></div><div class="comment"><p>{_S}</p></div></div></div></div><div id="sidebar"><p>{_S}</p>{_LINKS}</div><div id="footer">Imprint. {_S}</div></div></body>',
    f'<body><div class="cookie-banner"><p>We use cookies to improve this site. {_P}</p><button>OK</button></div><article main><section><h2>Part</h2><p>{_P}</p><blockquote>{_P}</blockquote></section><section><h2>Part</h2><p>{_S}</p></section></article><section class="related"><h2>Related</h2>{_LINKS}</section><form class="newsletter"><p>Subscribe to our letter.</p><label>Mail</label></form></body>',
    f'<body><table><tr><td class="nav">{_LINKS}</td><td><div class="article-body" main><h1>Title</h1><p>{_P}</p><p>{_P}</p></div></td><td class="ads"><p>Great offer. {_S}</p></td></tr></table></body>',
    f"<body main><p>{_P}</p><p>{_S}</p><p>{_P}</p></body>",
    f"<body main>{_P} {_P}</body>",
    f'<body><article main><header><h1>Title</h1></header><p>{_P}</p><div class="advertisement" skip><p>{_S}</p></div><p>{_P}</p><figure><figcaption>What the picture shows.</figcaption></figure><p>{_S}</p><section id="reader-comments" skip><h2>Reader comments</h2><p>{_P}</p><p>{_S}</p></section><footer skip><p>Share this. Tags. {_S}</p></footer></article></body>',
    f'<body><div class="top-bar">{_LINKS}</div><div class="entry-content" main><h1>Title</h1><p>{_P}</p><pre>code line</pre><p>{_S}</p><ul><li><a href="/x">A source that is cited</a></li><li>{_S}</li></ul></div><ol class="commentlist"><li><p>{_P}</p></li><li><p>{_S}</p></li></ol><div class="footer-links">{_LINKS}</div></body>',
    f'<body><div class="notice">Please enable scripts. {_S}</div><div role="banner">Name</div><div role="navigation">{_LINKS}</div><div role="main" main><h1>Title</h1><p>{_P}</p><table><tr><th>Name</th><td>Value of it</td></tr></table><p>{_P}</p></div><div role="complementary"><p>{_P}</p></div><div role="contentinfo"><p>{_S}</p></div></body>',
    f'<body><div class="page"><div class="masthead"><h1>Paper</h1></div><div class="story" main><h1>Title</h1><div>{_P}</div><div>{_P}</div><h2>Sub heading</h2><div>{_S}</div></div><div class="promo"><p>{_S}</p></div><div class="social-share">{_LINKS}</div><div class="comments-area"><p>{_P}</p><form><p>Leave a reply</p></form></div></div></body>',
    f'<body><main main><h1>Title</h1><p>{_P}</p><p>{_P}</p><nav class="toc" skip>{_LINKS}</nav><p>{_S}</p><aside skip><p>{_P}</p></aside><p>{_P}</p></main><div class="popup"><p>Sign up now. {_P}</p></div></body>',
    f'<body><div><div>{_LINKS}</div><div main><h1>Title</h1><p>{_P}</p><p>{_P}</p><p>{_P}</p></div><div><p><a href="/t">Terms of use</a> <a href="/p">Privacy</a></p></div></div></body>',
    f'<body><header><p>{_S}</p></header><section main><h1>Title</h1><p>{_P}</p><p>{_S}</p></section><section class="discussion"><h2>Discussion</h2><article class="comment"><p>{_P}</p></article><article class="comment"><p>{_S}</p></article></section><footer>{_S}</footer></body>',
    f'<body><div class="alert">{_P}</div><div id="content" main><p>{_P}</p><dl><dt>Term</dt><dd>What it means.</dd></dl><p>{_S}</p><div class="disclaimer notice" skip>{_S}</div></div><div id="disqus_thread"><p>{_P}</p></div><div class="widget"><p>{_S}</p></div></body>',
    f'<body><nav>{_LINKS}</nav><div class="ad">{_S}</div><article main><h1>Title</h1><p><b>Title</b></p></article><footer>&copy; site. {_S}</footer></body>',
    f'<body><nav>{_LINKS}</nav><div class="ad">{_P}</div><article main><h1>Title words</h1><p>{_S}</p></article><footer>&copy; {_P}</footer></body>',
    f'<body><nav>{_LINKS}</nav><article class="post" main><h1>Title</h1><p>{_P}</p></article><aside>{_P}</aside><footer>{_P}</footer></body>',
    f'<body><header>{_P}</header><main main><article><h1>Title</h1><p>{_S}</p><div><p>{_P}</p></div><figure><figcaption>{_S}</figcaption></figure></article></main><div class="comments"><h2>Comments</h2><p>{_P}</p><p>{_P}</p></div></body>',
    f'<body><div class="header"><p>{_P}</p></div><article main><p>{_S}</p><div class="ad" skip><p>{_P}</p></div><p>{_P}</p><div class="comments" skip><div><p>{_P}</p></div></div></article><div class="sidebar"><p>{_P}</p></div></body>',
    f'<body><article main><h1>Title</h1><p>{_P}</p><aside skip><p>{_P}</p></aside><form skip><p>{_P}</p></form><div class="notice" skip>{_P}</div><ul><li>{_S}</li></ul><footer skip>{_S}</footer></article></body>',
    f'<body main><h1>Title</h1><p>{_P}</p><p>{_S}</p></body>',
    f'<body main>{_S}</body>',
    f'<body main><div>{_P}</div><div>{_S}</div></body>',
    f'<body><div><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div><div main><h1>Title</h1><p>{_P}</p><p>{_S}</p></div><div><a href="/t">Terms</a></div></body>',
    f'<body><div class="container"><div class="row"><div class="col main-column"><div class="article-text" main><h2>Title</h2><p>{_P}</p><p>{_S}</p></div></div><div class="col side-column"><p>{_P}</p><p>{_S}</p></div></div></div></body>',
]

# Words of parts on wrappers, on long-running sections, on the article itself, and article headers
PAGES += [
    f'<body class="page has-sidebar"><nav>{_LINKS}</nav><article main><h1>Title</h1><p>{_P}</p><p>{_S}</p></article><aside class="sidebar"><p>{_P}</p></aside><footer>{_S}</footer></body>',
    f'<body><div class="layout with-sidebar"><nav>{_LINKS}</nav><article main><p>{_P}</p><p>{_P}</p></article><div class="sidebar"><p>{_P}</p></div></div><footer>{_S}</footer></body>',
    f'<body class="comments-open"><header>Site</header><main main><h1>Title</h1><p>{_P}</p><section class="social-policy"><h2>Part</h2><p>{_P}</p><p>{_P}</p></section><section class="widget-design"><h2>Part</h2><p>{_P}</p><p>{_P}</p></section></main><footer>{_S}</footer></body>',
    f'<body><nav>{_LINKS}</nav><article main><section class="social-history"><h2>Part</h2><p>{_P}</p><p>{_P}</p></section><section class="author-notes"><h2>Part</h2><p>{_P}</p><p>{_P}</p></section></article><footer>{_S}</footer></body>',
    f'<body><nav>{_LINKS}</nav><article main><header><h1>Title</h1></header><p>{_P}</p><p>{_P}</p></article><footer>{_S}</footer></body>',
    f'<body><header>{_LINKS}</header><article main><header><h1>Title words</h1><p>By a name</p></header><p>{_P}</p><p>{_S}</p><section class="comments" skip><p>{_P}</p><p>{_P}</p></section></article><footer>{_S}</footer></body>',
    f'<body><header><h1>Site</h1>{_LINKS}</header><article main><header><h2>Title</h2></header><p>{_S}</p></article><footer>{_S}</footer></body>',
    f'<body><nav>{_LINKS}</nav><article class="post featured-related" main><p>{_P}</p></article><footer>{_S}</footer></body>',
    f'<body><nav>{_LINKS}</nav><article class="entry sponsored" main><h1>Title</h1><p>{_S}</p></article><footer>{_P}</footer></body>',
    f'<body><nav>{_LINKS}</nav><article main><h1>Title</h1><p>{_P}</p><section class="reader-comments" skip><h2>Comments</h2><p>{_P}</p><p>{_P}</p><p>{_P}</p></section></article><footer>{_S}</footer></body>',
]

# Parts from which more labelled pages are put together by rule
_ARTICLES = ["<article main>{}</article>", "<main main>{}</main>", '<div class="content" main>{}</div>', '<div id="content" main>{}</div>', '<div class="post-body" main>{}</div>',
             '<section class="story" main>{}</section>', '<div role="main" main>{}</div>', '<div class="entry" main>{}</div>', "<div main>{}</div>", '<article class="post" main>{}</article>',
             '<div class="article-text" main>{}</div>', '<div class="text" main>{}</div>']
_BODIES = [f"<h1>Title</h1><p>{_P}</p><p>{_S}</p>", f"<h1>Title</h1><p>{_S}</p>", f"<p>{_P}</p><p>{_P}</p>", f"<h1>Title words</h1><p><b>Title words</b> {_P}</p><p>{_P}</p><p>{_S}</p>",
           f"<h2>Title</h2><p>{_P}</p><ul><li>{_S}</li><li>{_S}</li></ul><p>{_S}</p>", f"<h1>Title</h1><blockquote>{_P}</blockquote><p>{_P}</p>", f"<h1>Title</h1><div>{_P}</div><div>{_S}</div>",
           f"<h1>Title</h1><section><h2>Part</h2><p>{_P}</p></section><section><h2>Part</h2><p>{_S}</p></section>", f"<h1>Title</h1><p>{_P}</p><table><tr><td>{_S}</td><td>Cell</td></tr></table><p>{_P}</p>"]
_INSIDE = ["", "", "", f'<div class="ad" skip><p>{_S}</p></div>', f'<div class="comments" skip><h3>Comments</h3><p>{_P}</p></div>', f"<aside skip><p>{_P}</p></aside>", f'<div class="notice" skip><p>{_P}</p></div>',
           f"<form skip><p>{_S}</p><label>Name</label></form>", f"<footer skip><p>{_S}</p></footer>", f'<div class="share" skip>{_LINKS}</div>', f'<nav skip>{_LINKS}</nav>', f'<section id="comments" skip><p>{_P}</p><p>{_S}</p></section>']
_BEFORE = [f"<nav>{_LINKS}</nav>", f'<div id="top-nav">{_LINKS}</div>', f"<header><h1>Site</h1><p>{_S}</p></header>", f'<div class="header">{_S}</div>', f'<div class="ad">{_P}</div>', f'<div class="cookie-notice"><p>{_P}</p></div>',
           f'<div class="menu">{_LINKS}</div><div class="banner">{_S}</div>', f'<div role="banner"><p>{_S}</p></div>', "<header>Site</header>", f'<div class="alert"><p>{_S}</p></div>']
_AFTER = [f"<footer>&copy; {_S}</footer>", f"<footer><p>{_P}</p></footer>", f'<div class="footer">{_S}</div>', f'<div class="sidebar"><p>{_P}</p></div>', f"<aside><p>{_P}</p>{_LINKS}</aside>", f'<div class="comments"><p>{_P}</p><p>{_P}</p></div>',
          f'<section class="related"><h2>More</h2>{_LINKS}</section>', f"<form><p>{_S}</p></form>", f'<div id="reader-comments"><div class="comment"><p>{_P}</p></div></div>', f'<div class="newsletter"><p>{_P}</p></div>']


def composed(n: int) -> list[str]:
    """n pages: parts before and after an article, with a part in it that does not belong, in or without a wrapper."""
    out = []
    for k in range(n):
        rng = random.Random(k)
        body, inside = rng.choice(_BODIES), rng.choice(_INSIDE)
        article = rng.choice(_ARTICLES).format(inside + body if rng.random() < 0.2 else body + inside)
        before, after = rng.sample(_BEFORE, rng.randrange(1, 4)), rng.sample(_AFTER, rng.randrange(1, 4))
        page = "".join(before) + article + "".join(after)
        out.append(f"<body>{page}</body>" if rng.random() < 0.7 else f'<body><div class="page">{page}</div></body>')
    return out


PAGES += composed(90)
