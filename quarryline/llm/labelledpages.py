"""Labelled pages: layouts written here, filled with made-up words. data-main="1" marks main text, "0" what is not.

Each layout is filled several times with texts of differing lengths; in some fillings names and elements that tell what a
block is become plain ones, so that the model also learns from the shape of a page.
"""

from __future__ import annotations

import random
import re

SEED, FILLINGS = 11, 12

# In a layout [p 2 5] is two to five paragraphs, [s 30] sentences of about 30 words, [t 5] about 5 words, [l 4] four linked
# list items and [a 3] three links in a row. Main text is marked 1; marks hold for what is inside.
LAYOUTS = [
    '<html><head><title>[t 5]</title><style>p{margin:0}</style></head><body data-main="0"><header class="site-header"><a class="logo" href="/">[t 2]</a><nav><ul>[l 5]</ul></nav></header><main><article class="post" data-main="1"><h1>[t 7]</h1><div class="byline">[t 4]</div>[p 3 9]<ul><li>[s 8]</li><li>[s 12]</li></ul>[p 1 3]</article><aside class="sidebar"><h3>[t 2]</h3><ul>[l 6]</ul></aside></main><footer><p>&copy; 2020 [t 4]. All rights reserved.</p></footer></body></html>',
    '<body data-main="0"><div id="wrapper"><div class="top-bar">[a 4]</div><div class="masthead"><h2>[t 2]</h2></div><ul class="menu">[l 7]</ul><div id="content" data-main="1"><h1>[t 8]</h1>[p 2 4]<div class="ad-slot" data-main="0">[s 12]</div>[p 2 5]<div class="related-links" data-main="0"><h4>[t 2]</h4><ul>[l 4]</ul></div><div class="share-buttons" data-main="0">[a 4]</div></div><div id="comments"><h3>[t 2]</h3><ol class="comment-list"><li class="comment"><span class="author">[t 1]</span><p>[s 20]</p></li><li class="comment"><span class="author">[t 1]</span><p>[s 35]</p><p>[s 15]</p></li></ol><form><textarea>x</textarea><input type="submit"></form></div><div class="footer">[a 3] &copy; [t 3]</div></div></body>',
    '<html><body data-main="0"><table><tr><td class="left-nav">[a 8]</td><td class="main" data-main="1"><h2>[t 5]</h2>[p 3 7]</td><td class="right">[s 9]<br>[a 3]</td></tr></table><center>Copyright [t 3]</center></body></html>',
    '<body data-main="0"><div id="navigation"><ul>[l 6]</ul></div><div id="main-content" role="main" data-main="1"><h1 class="heading">[t 3]</h1><div id="toc" class="toc" data-main="0"><ul>[l 5]</ul></div>[p 2 4]<h2>[t 3]</h2>[p 2 4]<table><tr><th>[t 1]</th><td>[t 3]</td></tr><tr><th>[t 2]</th><td>[t 4]</td></tr></table>[p 1 3]<div class="navbox" data-main="0"><table><tr><td>[a 9]</td></tr></table></div></div><div id="catlinks">[a 4]</div><div id="footer"><ul>[l 3]</ul></div></body>',
    '<body data-main="0"><div class="layout"><nav class="sidebar-nav"><ul>[l 9]</ul></nav><div class="doc-body" data-main="1"><h1>[t 4]</h1>[p 1 4]<pre>[t 12]</pre><h2>[t 3]</h2>[p 1 4]<ul><li>[s 6]</li><li>[t 3]</li><li>[s 9]</li></ul></div><div class="pagination">[a 2]</div></div><footer>[a 4]</footer></body>',
    '<body data-main="0"><div id="cookie-banner" class="notice"><p>We use cookies. [s 14]</p><button>[t 1]</button></div><div role="banner"><a href="/">[t 2]</a></div><div role="main" data-main="1"><h1>[t 6]</h1>[p 2 8]</div><div class="newsletter"><h3>Subscribe</h3><p>[s 9]</p><form><input name="email"><button>x</button></form></div><div role="contentinfo"><p>[t 5]</p>[a 3]</div></body>',
    '<html><body><h1>[t 5]</h1>[p 1 8]</body></html>',
    '<h2>[t 4]</h2>[p 1 3]',
    '<body data-main="1"><center><h1>[t 4]</h1></center>[s 40]<br><br>[s 60]<br>[s 9]<hr data-main="0"><address data-main="0">[t 3] &copy;</address></body>',
    '<body data-main="0"><div><ul>[l 8]</ul></div><div data-main="1">[p 3 9]</div><div>[t 4] &copy; [t 2]</div></body>',
    '<body data-main="0"><form id="aspnetForm"><div id="header">[a 4]</div><div class="search-box"><label>[t 2]</label><input></div><div id="page" data-main="1"><h1>[t 4]</h1>[p 3 6]</div><div id="foot">[t 6]</div></form></body>',
    '<body data-main="0"><div class="promo">[s 10]</div><div class="story-body" data-main="1"><h1>[t 9]</h1>[p 2 4]<div class="sponsored" data-main="0"><p>Sponsored: [s 14]</p></div>[p 2 4]<p class="alert" data-main="0">[s 8]</p></div><div class="paywall"><p>[s 12]</p><a href="#">[t 2]</a></div><div class="recommended"><div class="teaser"><h4>[t 5]</h4><p>[s 12]</p></div><div class="teaser"><h4>[t 5]</h4><p>[s 14]</p></div></div></body>',
    '<body data-main="0"><nav><ul>[l 6]</ul></nav><div class="ad">[s 9]</div><article data-main="1"><h1>[t 8]</h1>[p 3 9]</article><footer>&copy; [t 2] &middot; [s 5]</footer></body>',
    '<body data-main="0"><article class="entry"><header data-main="1"><h1>[t 6]</h1><time>[t 3]</time></header><div class="entry-content" data-main="1">[p 2 4]<figure><img><figcaption>[t 6]</figcaption></figure>[p 2 4]<blockquote><p>[s 16]</p></blockquote><p>[s 9] <a href="/x">[t 2]</a> [s 8]</p></div><aside data-main="0"><h4>[t 2]</h4>[a 3]</aside><footer class="entry-footer">[a 4]</footer><section id="disqus_thread" class="comments"><h2>[t 2]</h2><div class="comment-body"><p>[s 18]</p></div><div class="comment-body"><p>[s 30]</p></div></section></article></body>',
    '<body data-main="0"><header><h2>[t 2]</h2></header><article data-main="1"><h1>[t 6]</h1><ol><li><a href="/1">[t 5]</a> [t 4]</li><li><a href="/2">[t 6]</a></li><li><a href="/3">[t 4]</a> [s 8]</li></ol><p>[s 14]</p></article><section class="reader-comments"><div>[s 14]</div><div>[s 22]</div></section></body>',
    '<body data-main="0"><div id="kopf"><h2>[t 2]</h2></div><div id="menue">[a 5]</div><div id="inhalt" data-main="1"><h1>[t 4]</h1>[p 2 6]<div class="werbung" data-main="0">[s 11]</div>[p 1 3]</div><div id="kommentare"><p>[s 15]</p><p>[s 22]</p></div><div id="fusszeile">[t 5]</div></body>',
    '[s 30]',
    '[t 2]',
    '<div>[s 20]</div><div>[s 5]</div>',
    '<body data-main="0"><header><a href="/">[t 2]</a></header><div class="hero banner"><p>[s 6]</p></div><main data-main="1"><section><h2>[t 3]</h2>[p 1 3]</section><section><h2>[t 3]</h2>[p 1 4]</section><section class="related" data-main="0"><h3>[t 2]</h3><ul>[l 3]</ul></section></main><div class="cookie-consent"><p>[s 16]</p></div><div class="popup modal"><p>[s 9]</p><form><input></form></div><footer><div class="col">[a 4]</div><div class="col">[a 3]</div></footer></body>',
    '<body data-main="0"><header><p>[s 6]</p></header><div class="breadcrumbs">[a 3]</div><div class="widget-area"><div class="widget"><h3>[t 2]</h3><p>[s 18]</p></div><div class="widget">[a 5]</div></div><div class="article-body" data-main="1"><h1>[t 5]</h1>[p 2 8]</div><div class="author-comments comments-area"><div class="comment"><p>[s 25]</p></div></div><footer><p>[s 9]</p></footer></body>',
    '<body data-main="0"><nav>[a 5]</nav><form class="login"><label>[t 2]</label><input><label>[t 1]</label><input></form><article data-main="1"><h1>[t 6]</h1><p>[s 3]</p><p>[t 1]</p>[p 2 9]<div class="advert" data-main="0"><p>[s 25]</p><p>[s 12]</p></div>[p 1 4]<form class="subscribe" data-main="0"><p>[s 10]</p><input></form><p>[t 2]</p></article><aside><p>[s 24]</p><p>[s 16]</p></aside><div class="notice"><p>[s 20]</p></div><footer><p>[s 22]</p><p>[s 9]</p></footer></body>',
    '<body data-main="0"><header class="site-head"><p class="site-name">[t 2]</p></header><div class="site-content"><main id="main"><article class="post hentry" data-main="1"><header class="entry-header"><h1 class="entry-title">[t 4]</h1></header><div class="entry-content">[p 2 6]</div><footer class="entry-footer" data-main="0">[a 2]</footer></article><nav class="post-navigation">[a 2]</nav><div id="comments" class="comments-area"><ol><li class="comment"><article class="comment-body"><p>[s 25]</p></article></li></ol></div></main></div><aside class="widget-area"><section class="widget"><h2>[t 1]</h2><ul>[l 4]</ul></section></aside><footer class="site-footer">[t 3]</footer></body>',
    '<body data-main="0"><article data-main="1"><header><h1>[t 5]</h1><p>[t 4]</p></header>[p 1 6]</article><form action="/s"><input name="q"><label>[t 3]</label></form></body>',
    '<html><body data-main="0"><table><tr><td colspan="2"><font>[t 2]</font></td></tr><tr><td>[a 4]</td><td data-main="1">[p 2 6]</td></tr><tr><td colspan="2">[t 3]</td></tr></table></body></html>',
    '<body data-main="0"><div class="top"><form><label>[t 2]</label><input></form></div><div class="text" data-main="1"><h1><span class="headline">[t 3]</span></h1><p>[s 14] <span class="note">[t 2]</span> [s 7]</p>[p 1 5]<form data-main="0"><p>[s 6]</p><input></form>[p 1 2]</div></body>',
    '<body data-main="0"><header class="top">[a 3]</header><article data-main="1"><h1>[t 4]</h1>[p 1 2]<div id="ad_top" class="ads" data-main="0"><p>[s 40]</p></div>[p 1 2]<div class="banner promo" data-main="0">[s 30]</div><p>[s 8]</p><div class="advertisement" data-main="0"><p>[s 12]</p></div></article><footer>[s 6]</footer></body>',
]
_SYLLABLES = "an be co da el fi go ha in ju ka lo mi no or pa qu re so ta un va we xi yo ze th st er en ch sch tion eau".split()
_FIELD = re.compile(r"\[(\w) (\d+)(?: (\d+))?\]")


def _filled(layout: str, r: random.Random, stretch: float, beside: float) -> str:
    """stretch and beside make paragraphs and sentences longer, the latter mostly beside the main text."""
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.choice([1, 1, 2, 2, 3])))
    words = lambda n: " ".join(word() for _ in range(n))

    def sentences(n: int) -> str:
        out = []
        while n > 0:
            k = min(n, r.randint(1, 18))
            out.append(words(k).capitalize() + r.choice(".....?!"))
            n -= k
        return " ".join(out)

    def one(m: re.Match) -> str:
        kind, n = m[1], int(m[2])
        some = max(1, round(n * r.uniform(0.5, 1.6)))
        if kind == "t":
            return words(some)
        if kind == "s":
            return sentences(max(1, round(some * beside)))
        if kind == "l":
            return "".join(f'<li><a href="/{i}">{words(r.randint(1, 3))}</a></li>' for i in range(some))
        if kind == "a":
            return " ".join(f'<a href="/{i}">{words(r.randint(1, 2))}</a>' for i in range(some))
        sizes = [max(1, round(r.choice([1, 3, 8, 20, 40, 40, 80, 120]) * stretch)) for _ in range(r.randint(n, int(m[3])))]
        return "".join(f"<p>{sentences(k)}{r.choice(['</p>', '</p>', '</p> ', ''])}" for k in sizes)

    return _FIELD.sub(one, layout)


def plain(html: str) -> str:
    """The page with plain elements for those that tell what a block is, and without names. Marks stay."""
    html = re.sub(r"(</?)(?:article|main|section|nav|header|footer|aside)\b", r"\1div", html)
    return re.sub(r"\s(?:class|id|role)=\"[^\"]*\"", "", html)


def pages() -> list[str]:
    """All fillings of all layouts; plain ones only of layouts that can be told by their shape."""
    r = random.Random(SEED)
    out = []
    for layout in LAYOUTS:
        by_shape = "omment" not in layout and "[s 1" not in layout and "[s 2" not in layout
        for k in range(FILLINGS):
            html = _filled(layout, r, r.choice([0.1, 0.3, 1.0, 1.0, 2.0]), r.choice([0.5, 1.0, 1.0, 4.0]) if not by_shape else 1.0)
            out.append(plain(html) if by_shape and k % 3 == 2 else html)
    return out
