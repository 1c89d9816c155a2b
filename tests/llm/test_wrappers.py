"""Main text by inferred wrappers: generated templates with known text, order of pages, size, and odd pages."""

import json
import random

import pytest

from driftgate.llm import wrappers

SYLLABLES = ["ka", "mo", "ri", "tu", "sel", "bran", "do", "vi"]


def words(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def template_page(rng, host):
    """A page of one of four hosts whose names say nothing, and its main text."""
    paragraphs = [words(rng, rng.randint(25, 60)) for _ in range(rng.randint(2, 7))]
    title, links = words(rng, 5), "".join(f"<li><a href='/{k}'>{words(rng, 2)}</a></li>" for k in range(6))
    body = "".join(f"<p>{p}" + "</p>" * rng.randint(0, 1) for p in paragraphs)
    if rng.random() < 0.3:
        quote = words(rng, 30)
        at = rng.randint(0, len(paragraphs))
        paragraphs.insert(at, quote)
        body = "".join(f"<blockquote>{p}</blockquote>" if p == quote else f"<p>{p}</p>" for p in paragraphs)
    terms, note = "<div class='x7'>Our terms have changed, read them before you go on</div>", f"<div class='x8'>{words(rng, 4)}</div>"
    inner = [
        f"<div class='x1'><ul>{links}</ul></div><div class='x2'><h1>{title}</h1>{body}{terms}</div>{note}",
        f"{note}<section><div class='x3'><div class='x4'><h2>{title}</h2>{body}</div><ul class='x9'>{links}</ul></div></section>",
        f"<table><tr><td><ul>{links}</ul></td></tr></table><div class='x5'><h1>{title}</h1>{terms}{body}</div><p>{words(rng, 5)}</p>",
        f"<div class='x6'><article><h1>{title}</h1>{body}</article></div>{note}",
    ][host]
    return f"<html><head><title>{title}</title></head><body class='p{rng.randint(1, 99)}'>{inner}</body></html>", "\n".join([title, *paragraphs])


def host_pages(host, n, seed=1):
    rng = random.Random(seed * 10 + host)
    return [template_page(rng, host) for _ in range(n)]


def wrapper_of(pages):
    whole = wrappers.page_wrapper(pages[0])
    for page in pages[1:]:
        whole = wrappers.merge(whole, wrappers.page_wrapper(page))
    return whole


@pytest.mark.parametrize("host", range(4))
def test_main_text_of_generated_templates(host, monkeypatch):
    monkeypatch.setattr(wrappers, "FURNITURE_NAMES", frozenset())
    pages = host_pages(host, 40)
    decision = wrappers.decide(wrapper_of([p for p, _ in pages]))
    assert [wrappers.main_text(p, decision) for p, _ in pages] == [t for _, t in pages]


def test_the_wrapper_decides():
    pages = host_pages(0, 40)
    decision = wrappers.decide(wrapper_of([p for p, _ in pages]))
    assert all(wrappers.main_text(p, decision) == t for p, t in pages)
    alone = [wrappers.main_text(p) for p, _ in pages]
    assert all("Our terms" in text for text in alone)  # a single page can't tell what all pages share
    assert all("Our terms" not in wrappers.main_text(p, decision) for p, _ in pages)


def test_the_order_of_pages_and_tasks_has_no_influence():
    pages = [p for p, _ in host_pages(1, 60)]
    decision = wrappers.decide(wrapper_of(pages))
    rng = random.Random(3)
    for _ in range(5):
        rng.shuffle(pages)
        parts = [wrapper_of(pages[a : a + 13]) for a in range(0, len(pages), 13)]
        whole = json.loads(json.dumps(parts[0]))
        for part in parts[1:]:
            whole = wrappers.merge(whole, json.loads(json.dumps(part)))
        assert wrappers.decide(whole) == decision and whole["n"] == 60


@pytest.mark.parametrize("host", range(4))
def test_a_wrapper_is_as_large_as_its_template(host):
    pages = [p for p, _ in host_pages(host, 1200)]
    few, many = wrapper_of(pages[:50]), wrapper_of(pages)
    assert wrappers.expression(many) == wrappers.expression(few)
    assert len(json.dumps(many)) <= len(json.dumps(few)) + 200


def test_children_in_any_order_become_one_repeated_group():
    assert wrappers.placed([], [["a"], ["b"], ["a"]]) == [["a", "b"]]
    assert wrappers.placed([["a"], ["b"], ["c"]], [["a"], ["c"]]) == [["a"], ["b"], ["c"]]
    assert wrappers.placed([["a"], ["b"], ["c"]], [["c"], ["a"]]) == [["a", "b", "c"]]
    assert wrappers.placed([["a"], ["c"]], [["a"], ["b"], ["c"]]) == [["a"], ["b"], ["c"]]
    rng = random.Random(1)
    order = []
    for _ in range(300):
        order = wrappers.placed(order, [[k] for k in rng.sample("abcdefgh", rng.randint(1, 8))])
        assert sorted(k for group in order for k in group) == sorted({k for group in order for k in group})


def test_the_expression_of_a_host_can_be_read():
    pages = ["<body><h1>A</h1><p>x</p><p>y</p></body>", "<body><h1>A</h1><ul><li>z</li></ul><p>w</p></body>"]
    assert wrappers.expression(wrapper_of(pages)) == "<><body><h1>constant</h1> <ul><li>#</li></ul>? (<p>#</p>)+</body></>".replace(
        "<li>#</li>", "<li>constant</li>"
    )


def test_furniture_inside_the_main_part():
    text = words(random.Random(1), 60)
    page = (
        f"<body><main><header><h1>T</h1></header><nav>menu</nav><p>{text} <span class='share'>Share</span> end</p>"
        f"<div class='comments'><p>{text}</p></div><aside>{text}</aside><form><label>Name</label></form>"
        "<script>var p = '<p>no</p>';</script><!-- <p>no</p> --><p>A &amp; b&nbsp;&lt;c&gt;<br>d</p></main><footer>f</footer></body>"
    )
    assert wrappers.main_text(page) == f"T\n{text} end\nA & b <c> d"


def test_odd_pages(spark):
    rows = [
        (1, "http://h/1", "<html><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; b</h1><p>One\n two</p></article></body></html>", "w"),
        (2, "http://h/2", None, "w"), (3, None, "", "w"), (4, "http://h/4", "no markup at all", "w"), (5, "http://h/5", "<p>open <b>end", "w"),
        (6, "http://g/6", "<body><p>" + "long " * 100_000 + "</p></body>", "w"), (6, "http://g/6", "</div></p><<>", "w"), (None, "x", "<p>t</p>", "w"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, wrapper string")
    found = {(r["page_id"], r["n_chars"]): r["text"] for r in wrappers.extract(pages).collect()}
    assert found[1, 13] == "A & b\nOne two" and found[2, 0] == "" and found[3, 0] == "" and found[4, 16] == "no markup at all"
    assert found[5, 8] == "open end" and found[6, 499_999] == ("long " * 100_000).strip() and found[None, 1] == "t"
    assert len(found) == 8
    assert wrappers.extract(spark.createDataFrame([], pages.schema)).count() == 0
