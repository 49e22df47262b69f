"""Pages labelled by hand, of layouts that the made-up pages don't have."""

from lodestar.llm.html_blocks import blocks
from lodestar.llm.html_extract import trained

P1 = "The council met on Tuesday evening to discuss the new bridge, which has been planned for more than ten years."
P2 = "Several residents spoke against the plan; they said that the noise, the dust and the closed roads would harm small shops."
P3 = "A final vote is expected in March, once the engineers have handed in their report and the costs are known."
H = "Council delays vote on the new bridge"
NAV = ["Home", "World", "Sport", "Weather", "Contact us"]

#: (html, texts of the article).
LAYOUTS = [
    # an old table layout with a menu cell
    (f"<table width=760><tr><td width=150><a href=/>{NAV[0]}</a><br><a href=/w>{NAV[1]}</a><br><a href=/s>{NAV[2]}</a></td><td><h2>{H}</h2><p>{P1}<p>{P2}<p>{P3}</td></tr><tr><td colspan=2><font size=1>Copyright 2003 Town Gazette. All rights reserved.</font></td></tr></table>", [H, P1, P2, P3]),
    # no article element, utility classes
    (f'<div class="flex gap-4"><div class="w-64"><ul><li><a href=/>{NAV[0]}</a></li><li><a href=/w>{NAV[1]}</a></li><li><a href=/x>{NAV[3]}</a></li></ul></div><div class="flex-1"><h1 class="text-3xl">{H}</h1><p class="mt-4">{P1}</p><p class="mt-4">{P2}</p><p class="mt-4">{P3}</p></div></div><div class="text-xs">© 2023 Gazette Ltd.</div>', [H, P1, P2, P3]),
    # documentation with a side navigation and code
    (f'<header class="navbar"><a href=/>Docs</a><a href=/api>API</a></header><nav class="toc"><ul><li><a href=#a>Install</a></li><li><a href=#b>Usage</a></li></ul></nav><main role="main"><h1>How to install the tool</h1><p>{P1}</p><pre>pip install tool --upgrade</pre><p>{P2}</p></main><footer class="footer"><p>Built with a site maker. Edit this page.</p></footer>', ["How to install the tool", P1, "pip install tool --upgrade", P2]),
    # a forum-like question with replies below
    (f'<div id="nav"><a href=/>{NAV[0]}</a> | <a href=/faq>FAQ</a></div><div class="post"><h1>{H}</h1><div class="post-text"><p>{P1}</p><p>{P3}</p></div></div><div class="comments"><div class="comment"><p>Anna: I do not agree with this at all, the bridge is needed.</p></div><div class="comment"><p>Ben: well said</p></div></div>', [H, P1, P3]),
    # a recipe with lists
    ('<nav class="menu"><ul><li><a href=/>Recipes</a></li><li><a href=/v>Videos</a></li></ul></nav><article><h1>Plain bread</h1><p>This bread needs little work, but some patience, as the dough has to rest twice.</p><h2>You need</h2><ul><li>500 g of flour</li><li>a spoon of salt</li><li>some yeast</li></ul><ol><li>Mix the flour, the salt and the yeast with warm water.</li><li>Let the dough rest for two hours, then bake it until it is brown.</li></ol></article><aside class="related"><h3>You may also like</h3><ul><li><a href=/1>Rye bread</a></li><li><a href=/2>Buns</a></li></ul></aside>', ["Plain bread", "This bread needs little work, but some patience, as the dough has to rest twice.", "You need", "500 g of flour", "a spoon of salt", "some yeast", "Mix the flour, the salt and the yeast with warm water.", "Let the dough rest for two hours, then bake it until it is brown."]),
    # a newsletter box and an advert inside the article
    (f'<header id="masthead"><div class="logo">The Gazette</div></header><article class="story"><h1>{H}</h1><p>{P1}</p><div class="ad-slot">Advertisement</div><p>{P2}</p><div class="newsletter"><p>Subscribe to our newsletter</p><form><label>Email address</label></form></div><p>{P3}</p></article><footer><p>Privacy policy</p><p>Terms of use</p></footer>', [H, P1, P2, P3]),
    # bare page
    (f"<h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>", [H, P1, P2, P3]),
    # article with quotation, figure and caption; share bar and breadcrumb
    (f'<ol class="breadcrumb"><li><a href=/>{NAV[0]}</a></li><li><a href=/w>{NAV[1]}</a></li></ol><div class="entry-content"><h1>{H}</h1><div class="social"><a href=/f>Share</a> <a href=/t>Tweet</a></div><p>{P1}</p><blockquote><p>{P2}</p></blockquote><figure><img src=x><figcaption>The old bridge in winter, seen from the mill.</figcaption></figure><p>{P3}</p></div><div id="sidebar"><h4>Most read</h4><ul><li><a href=/9>Fire in the mill</a></li></ul></div>', [H, P1, P2, "The old bridge in winter, seen from the mill.", P3]),
    # other languages
    ('<nav><ul><li><a href=/>Startseite</a></li><li><a href=/k>Kontakt</a></li></ul></nav><main><h1>Neue Brücke verzögert sich</h1><p>Der Gemeinderat hat am Dienstag über die neue Brücke beraten, die seit mehr als zehn Jahren geplant ist.</p><p>Eine Entscheidung wird im März erwartet, wenn das Gutachten vorliegt.</p></main><div class="cookie-hinweis cookie">Wir verwenden Cookies. <a href=/d>Mehr</a></div><footer>Impressum und Datenschutz</footer>', ["Neue Brücke verzögert sich", "Der Gemeinderat hat am Dienstag über die neue Brücke beraten, die seit mehr als zehn Jahren geplant ist.", "Eine Entscheidung wird im März erwartet, wenn das Gutachten vorliegt."]),
    ('<div class="menu"><a href=/>Accueil</a> <a href=/c>Contact</a></div><div class="article"><h1>Le pont attendra encore</h1><p>Le conseil municipal s\'est réuni mardi soir pour parler du nouveau pont, prévu depuis plus de dix ans.</p><p>Un vote final est attendu en mars, quand le rapport des ingénieurs sera connu.</p></div><div class="pied footer">Mentions légales</div>', ["Le pont attendra encore", "Le conseil municipal s'est réuni mardi soir pour parler du nouveau pont, prévu depuis plus de dix ans.", "Un vote final est attendu en mars, quand le rapport des ingénieurs sera connu."]),
    # definition list and data table
    ('<header><nav><a href=/>Index</a></nav></header><section class="content"><h1>Terms of the trade</h1><dl><dt>Span</dt><dd>The part of a bridge between two supports.</dd><dt>Pier</dt><dd>A support that stands in the water.</dd></dl><table><tr><th>Bridge</th><th>Length</th></tr><tr><td>North</td><td>120 m</td></tr></table></section><footer><ul><li><a href=/a>About</a></li></ul></footer>', ["Terms of the trade", "Span", "The part of a bridge between two supports.", "Pier", "A support that stands in the water.", "Bridge", "Length", "North", "120 m"]),
    # login form and notice before, pager behind
    (f'<div class="alert">Please enable JavaScript</div><form class="login"><label>Name</label><label>Password</label><button>Log in</button></form><div id="main-content"><h1>{H}</h1><p>{P1}</p><p>{P2}</p></div><div class="pagination"><a href=/1>1</a> <a href=/2>2</a> <a href=/3>Next</a></div><div class="footer">© Gazette</div>', [H, P1, P2]),
]


def test_labels():
    right = total = 0
    for page, article in LAYOUTS:
        found = blocks(page)
        assert [b.text for b in found if b.text in article] == article
        for b, p in zip(found, trained().label([found])[0], strict=True):
            total += 1
            right += (p >= 0.5) == (b.text in article)
    assert right / total > 0.93
