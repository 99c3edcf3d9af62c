"""Main text of pages whose names, containers and order vary, each with one exact answer."""

import numpy as np
import pytest

from quillrank.llm import html_text

LONG = "Some plain words of the text stand here to be read. " * 4
P, T = f"<p>{LONG}</p>", LONG.strip()
TEASER = "<p>Some short teaser of another story that is told elsewhere.</p>"


@pytest.fixture(scope="module")
def tree():
    return html_text.grow(np.array(html_text.LABELLED, float))


BODY, TEXT = f"<h1>A title of it</h1>{P}{P}", f"A title of it {T} {T}"


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "page has-header", "layout header-fixed", "main search-results", "container modal-open", "cookie-accepted", "post-content legal", "no-comments", "text form-page", "site-content social-enabled", "sidebar", "widget", "left", "header", "comment", "menu-open"])
@pytest.mark.parametrize("around", ["{}", "<nav><a>Home</a></nav>{}<footer>© 2024 Us, all rights reserved</footer>", "<div><a>Home</a></div><div><a>News</a></div>{}"])
def test_names_alone_decide_nothing(tree, name, around):
    """All of a page's text in a container, whatever it is called."""
    assert html_text.main_text(around.format(f'<div class="{name}">{BODY}</div>'), tree) == TEXT


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="wrap no-sidebar"><article>{BODY}</article></div>', TEXT), (f'<main class="has-comments">{BODY}</main>', TEXT), (f'<body class="login page">{BODY}</body>', TEXT),
        (f"<div><h1>Law</h1><p>Copyright law changed this year, and the reform will be felt by all who write for a living.</p>{P}</div>", f"Law Copyright law changed this year, and the reform will be felt by all who write for a living. {T}"),
        (f"<div>{P}</div><div>Copyright 2024 by us</div>", T), (f"<div>{P}</div><div>(c) Us and ours</div>", T), (f"<article>{P}<p>© means copyright.</p></article>", f"{T} © means copyright."),
        (f"<article>{P}<ul><li><a>One</a></li><li><a>Two</a></li></ul></article>", f"{T} One Two"), (f"<article>{P}<ul>{'<li><a>More</a></li>' * 7}</ul></article>", T),
        ("<p>Hello</p>", "Hello"), ("<h1>Hello</h1>", "Hello"), ("<article>Hi</article>", "Hi"),
        (f'<div class="article-header"><h1>The title</h1></div><article>{P}</article>', f"The title {T}"), (f"<div><h1>The title</h1></div><main>{P}{P}</main>", f"The title {T} {T}"),
        (f'<article>{P}</article><div class="user-feedback">{TEASER}</div>', T), (f'<div>{P}<div class="user-feedback">{TEASER}</div></div>', T),
        (f'<div class="ccbar">We use cookies to make this site better for all of you.</div><article>{P}</article>', T), (f'<article>{P}</article><div id="x7">{TEASER}</div>', T),
        (f'<div id="left"><h3>News</h3>{TEASER}</div><div id="c">{P}{P}</div>', f"{T} {T}"), (f'<div id="left"><h3>News</h3>{TEASER}</div><article>{P}</article>', T),
        (f'<div id="left">{P}{P}</div><div id="right">{TEASER}</div>', f"{T} {T}"),
        # Comments longer than the article, and an advert longer than a short one.
        (f"<article>{P}</article><div class='comments'>{P * 6}</div>", T), (f"<article><p>Short news.</p></article><div class='ad'>{P}</div>", "Short news."), (f"<div class='post'>{P}{P}</div><div id='disqus'>{P * 4}</div>", f"{T} {T}"),
        (f"<article>{P}<div class='related-posts'><h2>More</h2>{TEASER}{TEASER}</div>{P}</article>", f"{T} {T}"), (f"<form class='search'><div class='content'>{BODY}</div></form>", TEXT),
        (f"<nav>{P}</nav><footer>{P}</footer>", ""), (f"<footer>{P}{P}</footer><article><p>One line.</p></article>", "One line."),
    ],
)
def test_exact_answers(tree, page, want):
    assert html_text.main_text(page, tree) == want


def page_of(rng):
    """A second kind of random page: names from site builders, nested wrappers, text and boxes in any order."""
    def words(low, high):
        return " ".join("".join(rng.choice(list("gkolmnatr"), 6)) for _ in range(int(rng.integers(low, high))))

    def links(n):
        return "".join(f"<li><a href=/>{words(1, 3)}</a></li>" for _ in range(n))

    kept, inner = [], ""
    if rng.random() < 0.8:
        kept.append(title := words(3, 12))
        inner += f"<h1 class=title>{title}</h1>"
    for k in range(int(rng.integers(3, 9))):
        kind = rng.choice(["p", "p", "p", "quote", "table", "pre", "list", "box"]) if k else "p"
        t = words(15, 70)
        if kind == "box":
            box, name = (t, rng.choice(["advert-slot", "newsletter-box", "share-buttons", "related-stories", "promo"]))
            inner += f"<div class='{name}'><p>{box}</p></div>"
            continue
        kept.append(t)
        inner += {"p": f"<p>{t}</p>", "quote": f"<blockquote><p>{t}</p></blockquote>", "table": f"<table><tr><td>{t}</td></tr></table>", "pre": f"<pre>{t}</pre>", "list": f"<ol><li>{t}</li></ol>"}[kind]
    kept.append(end := words(20, 50))
    inner += f"<p>{end}</p>"
    holder = rng.choice(["article", "section class='post-body'", "div class='entry-content no-sidebar'", "div id=page", "div class='td-main-content has-comments'", "main role=main"])
    text = f"<{holder}>{inner}</{holder.split()[0]}>"
    for _ in range(int(rng.integers(0, 4))):
        text = f"<div class='{rng.choice(['wrap', 'container header-fixed', 'site modal-open', 'row', 'grid cookie-accepted'])}'>{text}</div>"
    before = rng.choice([f"<header><a href=/>{words(1, 3)}</a><p>{words(3, 9)}</p></header>", f"<div id=topbar>{words(5, 20)}</div>", f"<ul class=site-nav>{links(6)}</ul>", f"<div><ul>{links(7)}</ul></div>", f"<div class=breadcrumbs><a>{words(1, 2)}</a> / <a>{words(1, 2)}</a></div>"])
    after = rng.choice([f"<section id=comments><h2>{words(1, 3)}</h2><p>{words(20, 200)}</p></section>", f"<div class=site-footer><p>{words(5, 60)}</p></div>", f"<aside>{words(10, 60)}</aside>", f"<div class='sidebar-primary'><h4>{words(1, 3)}</h4><p>{words(10, 30)}</p><ul>{links(4)}</ul></div>", f"<div>{links(9)}</div>"])
    return f"<!doctype html><html><head><title>x</title></head><body class='single post-template'>{before}{text}{after}<footer>&copy; 2023 {words(2, 6)}</footer></body></html>", " ".join(kept)


def test_layouts_the_table_has_not_seen(tree):
    rng = np.random.default_rng(77)
    pages = [page_of(rng) for _ in range(500)]
    wrong = [(p, want) for p, want in pages if html_text.main_text(p, tree) != want]
    assert not wrong, (len(wrong), wrong[0])
