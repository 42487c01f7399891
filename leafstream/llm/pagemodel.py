"""The page classifier's training: labelled pages from a generator of layouts, and a logistic regression.

A layout is a function of a random generator that returns html; content texts begin with MARK, which
isn't part of any other text, so every block's label is known.  fit() takes PAGES pages of the training
layouts; the held-out layouts are for tests.
"""

from __future__ import annotations

import random

import numpy as np

from .pagetext import WEIGHTS, blocks, features, nodes

MARK, PAGES, SEED, RIDGE = "", 600, 5, 3.0


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeinorstlu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def _said(rng: random.Random, least: int = 3, most: int = 60) -> str:
    """Sentences of a text."""
    return " ".join(_words(rng, rng.randint(least, most // 2)) + rng.choice((".", ".", "!", "?")) for _ in range(rng.randint(1, 3)))


def _links(rng: random.Random, tag: str = "li") -> str:
    return "".join(f"<{tag}><a href='/{i}'>{_words(rng, rng.randint(1, 3))}</a></{tag}>" for i in range(rng.randint(2, 8)))


def _body(rng: random.Random, names: bool = True) -> str:
    """The blocks of an article."""
    out = [f"<h1>{MARK}{_words(rng, rng.randint(2, 9))}</h1>"] if rng.random() < 0.85 else []
    topic = rng.choice(("copyright-law", "legal-history", "related-work", "search-results-study", "methods", "p2", "header-files", "notice")) if names else "x"
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.6:
            inner = _said(rng)
            if rng.random() < 0.3:
                inner = inner.replace(" ", rng.choice((" <b>", " <a href='#'>", " <span class='notice'>", " <em>")), 1)
            out.append(f"<p>{MARK}{inner}</p>" if rng.random() < 0.8 else f"<p>{MARK}{inner}")
        elif kind < 0.7:
            out.append(f"<h2 id='{topic}'>{MARK}{_words(rng, rng.randint(1, 5))}</h2>")
        elif kind < 0.8:
            out.append("<ul>" + "".join(f"<li>{MARK}{_words(rng, rng.randint(1, 15))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
        elif kind < 0.86:
            out.append("<table><tr>" + "".join(f"<td>{MARK}{_words(rng, rng.randint(1, 3))}</td>" for _ in range(rng.randint(2, 6))) + "</tr></table>")
        elif kind < 0.92:
            out.append(f"<section id='{topic}'><p>{MARK}{_said(rng)}</p></section>")
        elif kind < 0.96:
            out.append(f"<blockquote>{MARK}{_said(rng)}</blockquote>")
        else:
            out.append(f"<div class='{rng.choice(('ad', 'ad-slot', 'newsletter-signup', 'share-buttons', 'sponsored'))}'><p>{_said(rng, 2, 20)}</p></div>")
    return "".join(out)


def _extras(rng: random.Random, where: str) -> str:
    """What stands before (menus, notices) or behind (comments, footers) an article."""
    said = lambda most=24: f"<p>{_said(rng, 2, most)}</p>"
    before = [
        f"<nav><ul>{_links(rng)}</ul></nav>", f"<div class='menu'>{_links(rng, 'span')}</div>", f"<header><a href='/'>{_words(rng, 2)}</a>{said()}</header>", f"<div id='cookie-notice'>{said()}</div>",
        f"<div class='ad'>{_said(rng, 3, 20)}</div>", f"<div class='topbar'>{_links(rng, 'span')}</div>", f"<form><label>{_words(rng, 1)}</label>{said()}</form>", f"<div class='alert alert-info'>{said(40)}</div>", f"<ul>{_links(rng)}</ul>",
    ]
    behind = [
        f"<footer>{said(30)}</footer>", f"<aside>{said(50)}</aside>", f"<div class='sidebar widget-area'>{said(50)}<ul>{_links(rng)}</ul></div>", f"<section id='comments'><h2>{_words(rng, 2)}</h2><article>{said(60)}</article>{said(60)}</section>",
        f"<div class='related-posts'>{said(40)}</div>", f"<div id='footer'>{_said(rng, 2, 20)}</div>", f"<div class='newsletter'>{said()}<button>{_words(rng, 1)}</button></div>", f"<ul>{_links(rng)}</ul>", f"<p><a href='/'>{_words(rng, 4)}</a></p>",
    ]
    some = before if where == "before" else behind
    return "".join(rng.sample(some, rng.randint(1, 5)))


def _page(rng: random.Random, inner: str) -> str:
    return f"<html><head><title>{_words(rng, 3)}</title></head><body class='{rng.choice(('', 'home', 'has-sidebar'))}'>{inner}</body></html>"


TRAINING = {
    "article": lambda r: _page(r, f"{_extras(r, 'before')}<article>{_body(r)}</article>{_extras(r, 'behind')}"),
    "main": lambda r: _page(r, f"{_extras(r, 'before')}<main><div>{_body(r)}</div></main>{_extras(r, 'behind')}"),
    "content": lambda r: _page(r, f"{_extras(r, 'before')}<div id='wrap'><div class='content'>{_body(r, False)}</div>{_extras(r, 'behind')}</div>"),
    "entry": lambda r: _page(r, f"{_extras(r, 'before')}<div class='entry-content post'>{_body(r, False)}</div>{_extras(r, 'behind')}"),
    "inside": lambda r: _page(r, f"{_extras(r, 'before')}<article><section>{_body(r)}</section>{_extras(r, 'behind')}</article>{_extras(r, 'behind')}"),
}
HELD_OUT = {
    "role": lambda r: _page(r, f"{_extras(r, 'before')}<div role='main'><section>{_body(r)}</section></div>{_extras(r, 'behind')}"),
    "nested": lambda r: _page(r, f"{_extras(r, 'before')}<div><div><article class='story-text'><div class='p-inner'>{_body(r)}</div>{_extras(r, 'behind')}</article></div></div>{_extras(r, 'behind')}"),
    "story": lambda r: _page(r, f"{_extras(r, 'before')}<section class='story'><header><h1>{MARK}{_words(r, 4)}</h1></header>{_body(r, False)}</section>{_extras(r, 'behind')}"),
}


def pages(layouts: dict, n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    kinds = list(layouts.values())
    return [kinds[i % len(kinds)](rng) for i in range(n)]


def labelled(page: str) -> list[tuple[list[float], bool]]:
    """(features, is it content) of a marked page's nodes; the mark itself is taken out first."""
    marked = blocks(page)
    out = []
    for i, aside, text in nodes(marked):
        out.append((list(features(marked[i], aside, text.replace(MARK, "") or "x").values()), MARK in text))
    return out


def fit(n: int = PAGES, seed: int = SEED, ridge: float = RIDGE, rounds: int = 30) -> dict[str, float]:
    """Weights of the logistic regression of the labels on the features, by Newton's method with a ridge."""
    rows = [row for page in pages(TRAINING, n, seed) for row in labelled(page)]
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return {k: round(float(v), 2) for k, v in zip(WEIGHTS, w, strict=True)}
