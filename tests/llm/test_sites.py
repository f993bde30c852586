"""Main text of generated sites whose articles are known, on hosts of one page and more."""

import random

import pytest

from flowkeel.llm import template

WORDS = [f"word{i}" for i in range(400)]


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def site(host, pages, rng):
    """Pages of one host as (url, html, article)."""
    out = []
    for k in range(pages):
        title, paragraphs = sentence(rng, 5), [sentence(rng, rng.randrange(15, 60)) for _ in range(rng.randrange(2, 7))]
        note = sentence(rng, 8)
        remarks = "".join(
            f'<div class="comment"><span class="author">{rng.choice(WORDS)}</span><p>{sentence(rng, rng.randrange(3, 40))}</p>'
            f'<div class="replies"><p>{sentence(rng, 6)}</p></div></div>' for _ in range(rng.randrange(0, 6)))
        inner = "".join(f"<p>{p}</p>" for p in paragraphs)
        extras = [
            f'<div class="share-buttons">Share this {rng.choice(WORDS)}</div>' if rng.random() < 0.5 else "",
            f'<p class="ad">Buy {rng.choice(WORDS)} now</p>' if rng.random() < 0.5 else "",
            f'<div class="notice">{sentence(rng, 4)}</div>' if rng.random() < 0.3 else "",
            f'<ul class="related-posts"><li>{sentence(rng, 5)}</li></ul>' if rng.random() < 0.5 else ""]
        inside = rng.random() < 0.5
        comments = f'<section class="user-comments"><h3>Comments</h3>{remarks}<form><textarea>Say it</textarea></form></section>' if remarks else ""
        html = (f'<html><head><title>{title} - {host}</title></head><body><header><a href="/">{host}</a></header>'
                f'<nav><ul><li>Home</li><li>News</li></ul></nav><div class="cookie-notice">We use cookies</div>'
                f'<article><h1>{title}</h1>{extras[0]}{inner}{extras[1]}<h2 id="related-work">Related work</h2>'
                f'<div id="comments-on-{title.split()[0].lower()}"><p>{note}</p></div>{extras[2]}{extras[3]}'
                f'{comments if inside else ""}</article>{"" if inside else comments}'
                f'<aside class="sidebar">Latest news</aside><footer>All rights reserved</footer></body></html>')
        out.append((f"http://{host}/{k}", html, "\n\n".join([title, *paragraphs, "Related work", note])))
    return out


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(12)
    pages = [p for n, count in enumerate([1, 1, 1, 2, 2, 3, 5, 8, 20]) for p in site(f"h{n}.example.com", count, rng)]
    rows = [(i, url, html) for i, (url, html, _) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in template.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [(article, got[i]) for i, (_, _, article) in enumerate(pages)]


def test_words_of_the_articles_and_no_others(found):
    """Each page by itself; generated words repeat, so the texts are compared block by block."""
    for article, text in found:
        want, have = article.split("\n\n"), text.split("\n\n")
        common = set(want) & set(have)
        size = lambda blocks: sum(len(b.split()) for b in blocks)
        assert size(b for b in have if b in common) >= 0.98 * size(have)
        assert size(b for b in want if b in common) >= 0.98 * size(want)
    assert sum(a == t for a, t in found) >= 0.95 * len(found)


@pytest.mark.parametrize("html, text", [
    ("<article><h1>A</h1><p>one two three</p><div class='comments'><p>four five six seven eight nine</p></div></article>", "A\n\none two three"),
    ("<article><div class='widget'><h1>A</h1><p>one two three</p></div></article>", "A\n\none two three"),
    ("<article><p>one</p><div class='notice'>a long part of the article itself</div></article>", "one\n\na long part of the article itself"),
    ("<body><div class='main sidebar-right'><p>one two</p></div></body>", "one two"),
    ("<article><div class='comments'>only remarks</div></article>", "only remarks"),
    ("<article><p>one two</p><p class='notice-period'>three months</p></article>", "one two\n\nthree months"),
])
def test_parts_by_the_page_itself(html, text):
    assert template.Page(html).main(None) == text
