"""Main text: no bytes break the parser, names are evidence that a whole page overrules."""

from __future__ import annotations

import random

import pytest

from depmatrix.llm.html_extract import extract

STORY = "".join(f"<p>The river rose slowly over field {k} in spring, and the people of the valley moved their herds to the hills.</p>" for k in range(6))
SAID = extract(f"<html><body>{STORY}</body></html>")


@pytest.mark.parametrize(
    "around",
    [
        "<form id='aspnetForm'>{}</form>",
        "<form><article>{}</article></form>",
        "<div class='site comments-open'>{}</div>",
        "<article class='post comments-closed'>{}</article>",
        "<main><article class='post comments-open'>{}</article></main>",
        "<div class='cookie-recipe'>{}</div>",
        "<div id='menu'>{}</div>",
        "<form><div class='comments-open'><div class='sidebar'><p>Latest posts of other people</p></div>{}</div></form>",
    ],
)
def test_a_wrapper_with_a_telling_name_keeps_the_story(around):
    page = f"<html><body><nav>Home</nav>{around.format(STORY)}<footer>Imprint</footer></body></html>"
    assert extract(page) == SAID


def test_named_parts_beside_a_story_go():
    long_comments = f"<div class='comments'>{STORY.replace('river', 'reader')}</div>"
    assert extract(f"<body><article>{STORY}</article>{long_comments}</body>") == SAID
    assert extract(f"<body><article><p>Short story here.</p></article>{long_comments}</body>") == "Short story here."
    form = "<form><label>Your mail address and the name of your town, please</label><input></form>"
    assert extract(f"<body><div>{STORY}</div>{form}<div class='newsletter'><p>Subscribe to our weekly letter now.</p></div></body>") == SAID


def test_marked_sections_are_comments():
    assert extract("<p>Before the mark there is text.</p><![if !IE]><p>And after it too.</p><![endif]>").count("\n\n") == 1
    for odd in ("<p>a story<![foo</p>", "<![mso 9]>", "<!", "<![", "<![CDATA[ x ]]>", "<!ELEMENT x [", "<?php", "&#99999999999;"):
        extract(f"<p>text</p>{odd}")
        extract(odd)


def test_no_bytes_break_the_parser():
    rng = random.Random(5)
    bits = ["<!", "<![", "<![mso 9]>", "<!--", "-->", "]]>", "<", ">", "</", "&#x", "\x00", '"', "'", "<a b='", "<form>", "<![foo</p>"]
    page = f"<html><head><title>x</title></head><body><div class='a b'>{STORY}</div><footer>f</footer></body></html>"
    for _ in range(3000):
        at = [rng.randrange(len(page)) for _ in range(rng.randint(1, 4))]
        odd = page
        for a in at:
            odd = odd[:a] + rng.choice(bits) + odd[a + rng.randint(0, 3) :]
        raw = bytearray(odd.encode())
        raw[rng.randrange(len(raw))] = rng.randrange(256)
        extract(raw.decode("utf8", "replace"))
