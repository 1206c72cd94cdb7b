"""What belongs to an article and what doesn't, on pages written by hand that the model was not trained on."""

import pytest

from feedlake.llm import pages

PROSE = "The river rose for three days, and on the fourth the people of the lower town moved their boats into the square. " * 2
KEPT = {
    "links": ("<ul><li><a href='a'>Boats of the square</a></li><li><a href='b'>Maps of the town</a></li><li><a href='c'>Tide tables</a></li></ul>", "Boats of the square Maps of the town Tide tables"),
    "one link": ("<p><a href='a'>The whole report as a file</a></p>", "The whole report as a file"),
    "table": ("<table><tr><td><a href='a'>Monday</a></td><td><a href='b'>two metres</a></td></tr></table>", "Monday two metres"),
    "tabs": ("<div class='tabs'><p>Levels by hour are given below in metres.</p></div>", "Levels by hour are given below in metres."),
    "rail": ("<div class='rail'><p>By rail the town could still be reached.</p></div>", "By rail the town could still be reached."),
    "section": (f"<section><header><h2>After the flood</h2></header><p>{PROSE}</p></section>", "After the flood " + PROSE.strip()),
    "inline": ("<p>See <a class='related' href='x'>this</a> work, <span class='ad'>too</span>.</p>", "See this work, too."),
    "script": ("<script>a('</scripty>'); hidden()</script><p>Shown again.</p>", "Shown again."),
    "advert": ("<div class='ad'>Buy a boat today.</div>", ""),
    "sidebar": (f"<div class='sidebar'><p>{PROSE}</p></div>", ""),
    "related": ("<div class='related'><h2>More</h2><ul><li><a href='x'>Other floods</a></li></ul></div>", ""),
    "comments": (f"<section id='comments'><h3>Comments</h3><p>{PROSE}</p></section>", ""),
    "form": ("<form><label>Your name</label><button>Send</button></form>", ""),
}


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='content'>{}</div>", "<main>{}</main>", "<div id='top'><div class='post'>{}</div></div>"])
@pytest.mark.parametrize("name", list(KEPT))
def test_parts_of_an_article(name, wrap):
    part, text = KEPT[name]
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>{wrap.format(f'<h1>High water</h1><p>{PROSE}</p>{part}<p>{PROSE}</p>')}<footer>&copy; the paper</footer></body></html>"
    want = " ".join(f"High water {PROSE} {text} {PROSE}".split())
    assert pages.default_model().text(page) == want
