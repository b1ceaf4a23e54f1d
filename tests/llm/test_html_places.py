"""Places beside the article: wrappers stand, side bars go; the two passes against a plain version."""

import random
import re

import pytest
from quillgraph.llm import html

PROSE = "The river was high in the spring and it had flooded the lower fields of the valley, so that the farmers could not go out to their work for"
ARTICLE = "".join(f"<p>{PROSE} {i}.</p>" for i in ("days", "weeks", "months"))
PLAIN = "\n".join(f"{PROSE} {i}." for i in ("days", "weeks", "months"))
OTHER = "This is the text that is not of the article and that was put here by those who run the page for all of us to read."
WRAPPERS = [
    '<div class="page-wrapper has-sidebar">', '<div class="layout-with-sidebar">', '<div class="header-fixed">', '<div class="ad-free-article">', '<div class="no-comments">', '<div class="notice-board">',
    '<section id="signup-guide">', '<form id="aspnetForm">', '<div class="has-sidebar"><main>', '<div class="header-fixed"><div class="nav-open"><form>', '<div class="sidebar"><main>',
]
ASIDES = ["sidebar", "left-sidebar", "sidebar-left", "comment-list", "comments", "site-footer", "cookie-bar", "related-posts", "newsletter", "share-buttons", "notice", "menu"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_stand_and_side_bars_go(wrapper):
    sides = "".join(f'<div class="{a}"><p>{OTHER} {a}</p></div>' for a in ASIDES) + f"<nav><p>{OTHER}</p></nav><form><p>{OTHER}</p></form><footer><p>{OTHER}</p></footer>"
    assert html.extract(f"<body>{ARTICLE}</body>") == PLAIN
    for page in (f"<body>{wrapper}{ARTICLE}</body>", f"<body>{wrapper}{ARTICLE}{sides}</body>", f"<body>{wrapper}{sides}{ARTICLE}</body>"):
        assert html.extract(page) == PLAIN
    assert html.extract(f"<body>{sides}{ARTICLE}</body>") == PLAIN


@pytest.mark.parametrize("place", ["comments", "comment-list", "related-posts", "site-footer", "cookie-notice"])
def test_sure_places_go_however_long(place):
    assert html.extract(f'<body><div>{ARTICLE}</div><div class="{place}">{f"<p>{OTHER}</p>" * 40}</div></body>') == PLAIN


def plainly(labels, headings, ends, homes):
    """Pass 2 from each block to the left and to the right, one step after the other."""
    out = []
    if ends == html.BAD and html.GOOD not in labels:
        return [x != html.BAD for x in labels]
    for i, x in enumerate(labels):
        if x in (html.GOOD, html.BAD):
            out.append(x == html.GOOD)
            continue
        sides = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(labels) and labels[j] not in (html.GOOD, html.BAD):
                j += step
            inside = 0 <= j < len(labels)
            sides.append((labels[j], abs(j - i), homes[j]) if inside else (ends, abs(j - i) + 1, -1))  # an end stands a block further off
        (before, a, one), (after, b, two) = sides
        same = [s for s, _, h in sides if h == homes[i]]
        if before == after or headings[i] and after == html.GOOD:
            out.append(after == html.GOOD)
        elif len(same) == 1:
            out.append(same[0] == html.GOOD)
        else:
            out.append((before if a < b else after) == html.GOOD if a != b else x == html.NEAR)
    return out


def test_second_pass_against_plain_version():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randrange(14)
        labels = [rng.choice([html.GOOD, html.BAD, html.NEAR, html.SHORT_BLOCK, html.SHORT_BLOCK]) for _ in range(n)]
        args = labels, [rng.random() < 0.2 for _ in range(n)], rng.choice([html.GOOD, html.BAD]), [rng.randrange(3) for _ in range(n)]
        assert html.inherited(*args) == plainly(*args), args


def test_first_pass_against_plain_version():
    rng = random.Random(3)
    words = [*sorted(html.STOP_WORDS)[:40], *(f"word{chr(97 + i)}" for i in range(26))]
    for _ in range(1000):
        text = " ".join(rng.choice(words[: rng.choice([20, 40, 66])]) for _ in range(rng.randrange(60)))
        block = html.Block()
        block.linked = rng.choice([0, len(text.replace(" ", "")) * 3 // 10, len(text)])
        n, stops = len(re.findall(r"[^\W\d_]+", text)), sum(w in html.STOP_WORDS for w in re.findall(r"[^\W\d_]+", text))
        if block.linked > 0.3 * len(text.replace(" ", "")):
            want = "bad"
        elif n >= 10 and stops >= 0.2 * n:
            want = "good" if n >= 25 else "near"
        else:
            want = "near" if n >= 10 and stops >= 0.12 * n else "short"
        assert html.label(text, block) == want
