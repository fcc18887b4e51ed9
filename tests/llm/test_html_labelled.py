"""Main text against pages whose article is known, and with the scores taken away."""

import random
from collections import Counter

import numpy as np
import pytest

from tarnflow.llm.html_extraction import main_text

WORDS = "river market council season harbour winter teacher engine garden letter valley museum bridge village doctor".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def links(rng: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{rng.choice(WORDS)}</a></li>' for k in range(n)) + "</ul>"


def page(k: int) -> tuple[str, str]:
    """A page of one of eight shapes, and its article."""
    rng = random.Random(k)
    blocks = [sentence(rng, 4)] + [sentence(rng, rng.randint(25, 70)) for _ in range(rng.randint(2, 6))]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{x}</p>" for x in blocks[1:])
    name = rng.choice(["share-post", "post-header", "banner-story", "page", "text"])
    named = f"<h1>{blocks[0]}</h1>" + f'<div class="{name}">' + "".join(f"<p>{x}</p>" for x in blocks[1:]) + "</div>"
    remarks = '<div class="comments"><p>' + "</p><p>".join(sentence(rng, 30) for _ in range(4)) + "</p></div>"
    advert = f'<div class="ad">{sentence(rng, 12)}</div>'
    top = f"<nav>{links(rng, 6)}</nav>{advert}"
    unnamed = f"<div>{links(rng, 9)}</div><div><a>{rng.choice(WORDS)}</a> <a>{rng.choice(WORDS)}</a></div>"
    foot = f"<footer>{sentence(rng, 8)}</footer>"
    shapes = [
        f"{top}<article>{body}</article>{remarks}{foot}",
        f"{top}<article>{named}</article>{unnamed}{foot}",
        f"{unnamed}<div>{body}</div>{unnamed}{foot}",
        f"{unnamed}<div id='x1'>{named}</div><div>{links(rng, 5)}</div>{foot}",
        f"<table><tr><td>{links(rng, 7)}</td><td>{body}</td><td>{links(rng, 4)}</td></tr></table>",
        f"{top}<main>{body}<aside>{links(rng, 3)}</aside></main>{remarks}",
        f"{unnamed}<section>{body}{advert}</section>{remarks}{unnamed}",
        f"{top}<div class='post'>{named}</div>{unnamed}<article class='teaser'>{sentence(rng, 6)}</article>{foot}",
    ]
    return f"<html><head><title>{blocks[0]}</title><script>var x = 1;</script></head><body>{shapes[k % len(shapes)]}</body></html>", "\n".join(blocks)


def agreement(score=None) -> float:
    """F1 of words over all pages."""
    both = got = want = 0
    for k in range(320):
        html, truth = page(k)
        found = main_text(html) if score is None else main_text(html, score=score)
        a, b = Counter(found.split()), Counter(truth.split())
        both, got, want = both + (a & b).total(), got + a.total(), want + b.total()
    return 2 * both / max(1, got + want)


def test_labelled_pages():
    assert agreement() >= 0.98


@pytest.mark.parametrize(("level", "most"), [(0.0, 0.01), (1.0, 0.97)])
def test_scores_matter(level, most):
    """Without the scores no text is found; with equal ones the wrong regions come along."""
    assert agreement(lambda lines, _: np.full(len(lines.lines), level)) <= most


@pytest.mark.parametrize("name", ["share-post", "post-header", "banner-story", "page"])
def test_names_are_only_hints(name):
    words = "A paragraph that holds a good part of what the article has to say. " * 4
    html = f'<body><nav><a>x</a></nav><article><h1>A title</h1><div class="{name}"><p>{words}</p></div></article></body>'
    assert words.strip() in main_text(html)
