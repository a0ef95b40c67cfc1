"""Small labelled pages, made by rule, for tables whose own pages mark no article up.

Each page is built once with its article marked, which labels its nodes. Its variants rename tags and take class names
away without moving a node, so the labels hold for them too: an article in a div, menus and footers in divs with or
without telling class names. Words are drawn letters, as their meaning is no feature.
"""

from __future__ import annotations

import random
import re

_LETTERS = "aeinrstlodcm"


def _words(rng: random.Random, least: int, most: int) -> str:
    return " ".join("".join(rng.choice(_LETTERS) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(least, most)))


def _sentences(rng: random.Random, least: int, most: int) -> str:
    return " ".join(_words(rng, 4, 18).capitalize() + rng.choice("....?!") for _ in range(rng.randint(least, most)))


def _links(rng: random.Random) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_words(rng, 1, 3)}</a></li>' for i in range(rng.randint(3, 9))) + "</ul>"


def _article(rng: random.Random) -> str:
    parts = [f"<h1>{_words(rng, 3, 12)}</h1>"] if rng.random() < 0.9 else []
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.75:
            text = _sentences(rng, 1, 6)
            parts.append(f"<p>{text[:40]}<b>{text[40:60]}</b>{text[60:]}</p>" if rng.random() < 0.2 else f"<p>{text}</p>")
        elif kind < 0.83:
            parts.append(f"<h2>{_words(rng, 2, 7)}</h2>")
        elif kind < 0.9:
            parts.append("<ul>" + "".join(f"<li>{_sentences(rng, 1, 2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.95:
            parts.append(f"<blockquote>{_sentences(rng, 1, 3)}</blockquote>")
        else:
            parts.append(f"<div>{_sentences(rng, 1, 4)}</div>")
    return "".join(parts)


def page(rng: random.Random) -> str:
    """A page whose main text is all in one article element."""
    before, after = [], []
    if rng.random() < 0.7:
        before.append(f'<header class="masthead"><div>{_words(rng, 1, 4)}</div></header>')
    if rng.random() < 0.9:
        before.append(f'<nav class="menu">{_links(rng)}</nav>')
    if rng.random() < 0.6:
        before.append(f'<div class="{rng.choice(("ad", "banner", "promo"))}">{_sentences(rng, 1, 2)}</div>')
    if rng.random() < 0.3:
        before.append(f'<div class="cookie"><p>{_words(rng, 4, 14)}.</p><button>{_words(rng, 1, 2)}</button></div>')
    if rng.random() < 0.5:
        after.append(f'<aside class="sidebar">{_links(rng)}<p>{_words(rng, 2, 8)}</p></aside>')
    if rng.random() < 0.4:
        after.append('<div class="comments">' + "".join(f'<div class="comment"><p>{_words(rng, 1, 3)}</p><p>{_sentences(rng, 1, 2)}</p></div>' for _ in range(rng.randint(1, 4))) + "</div>")
    if rng.random() < 0.9:
        after.append(f'<footer class="footer">&copy; {rng.choice(_LETTERS)}.example.net &middot; {_words(rng, 2, 8)}.</footer>')
    return f"<html><body>{''.join(before)}<article>{_article(rng)}</article>{''.join(after)}</body></html>"


def variants(html: str, rng: random.Random) -> list[str]:
    """The page itself, and copies of other markup with the same nodes."""
    plain = re.sub(r' class="[^"]*"', "", html)
    as_div = lambda h: re.sub(r"<(/?)(?:article|main)\b", r"<\1div", h)
    named = html.replace("<article>", f'<div class="{rng.choice(("content", "post", "entry", "story"))}">').replace("</article>", "</div>")
    frames = lambda h: re.sub(r"<(/?)(?:nav|header|footer|aside)\b", r"<\1div", h)
    return [html, as_div(html), as_div(plain), frames(named), frames(as_div(html))]


def labelled(n: int = 60, seed: int = 6) -> list[tuple[str, list[str]]]:
    """Pages with a marked article, and their variants."""
    rng = random.Random(seed)
    return [(h, variants(h, rng)) for h in (page(rng) for _ in range(n))]
