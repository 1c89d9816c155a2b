"""Main text of web pages, with wrappers inferred per host.

A wrapper is a union-free regular expression over the blocks of a host's pages. Each element has its children in order;
a child that some pages lack is optional, one that stands several times in a row is repeated, and children whose order
differs between pages or within one become a repeated group of optional ones. So a child stands in one place of its
parent, and a wrapper is as large as the template, not as the number of pages. What differs between pages in an element's
own text makes that text a slot; what all pages share stays a constant. Pages are aligned with the wrapper one after
another, wrappers of different tasks are aligned with each other in the same way, and what a wrapper counts (pages,
characters, links) adds up, so the result doesn't depend on the order of pages.

The wrapper decides what is main text. Slots that hold running text, outside links, give each element a weight. From the
top, the way leads down into the child with `SHARE` of the weight of all children as long as it is one element that holds
others; where it ends is the main part of the host's pages. Inside it, elements that are mostly links and constant lines are furniture, as
is everything outside. Lists of tags and names only help: an article around the main part is taken whole, and what calls
itself navigation, notice or comments is furniture inside the main part too. A page without the main part of its host is
decided by a wrapper of its own.

A block's white space becomes single blanks, blocks are joined by line feeds. Null html counts as empty and gives an empty
text; pages without a url are a host of their own. Texts of any length are read whole. Repeated pages get equal results.
Of children with equal weight the way takes the first by name. Extra columns are ignored, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import map_batches

#: Pages of a host that must share a text before it counts as the host's own.
SUPPORT = 3
#: Part of the running text that the way down follows.
SHARE = 0.6
#: Characters that an element's text has on average if it is running text.
RUNNING = 40
#: Part of the characters, and how many, that make an element a list of links.
LINKED = 0.6
LINKS = 3
#: Hosts whose wrappers a task holds at once.
HOSTS = 500
SALTS = 16
EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)>"
    r"|([^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold blocks without being one.
CONTAINERS = frozenset("label option button menu title html body".split())
FURNITURE_TAGS = frozenset("head title nav header footer aside form button menu dialog label option".split())
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement sponsor sponsored promo "
    "banner notice notices alert cookie cookies consent newsletter subscribe popup modal comment comments reply replies "
    "respond share sharing social related breadcrumb breadcrumbs pagination pager widget toolbar login signup search".split()
)
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose names describe the page rather than a part of it.
WHOLE = frozenset(("html", "body", "article", "main"))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes); kind is open, close or text. Scripts, styles and comments are left out."""
    for m in TOKEN.finditer(page):
        if m[8] is not None:
            yield "text", m[8], ""
        elif m[3] or m[6]:
            yield ("close" if m[2] or m[5] else "open"), (m[3] or m[6]).lower(), m[4] or m[7] or ""


def names_of(attributes: str) -> list[str]:
    if not attributes:
        return []
    return [w for m in NAMES.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()) if w]


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def digest(text: str) -> str:
    """Stands for a text in a wrapper, so that wrappers stay small whatever the pages hold."""
    return xxhash.xxh3_64_hexdigest(text)


def block_name(tag: str, attributes: str) -> str:
    """An element's name in a wrapper: its tag and the words of its class, without numbers. Those of a page as a whole don't count."""
    names = sorted({n for n in names_of(attributes) if not n.isdigit()}) if attributes and tag not in WHOLE else ()
    return ".".join((tag, *names)) if names else tag


def furniture_by_name(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element calls itself furniture. A header inside the main part is the article's own."""
    if tag in FURNITURE_TAGS and not (tag == "header" and inside):
        return True
    return tag not in WHOLE and bool(attributes) and not FURNITURE_NAMES.isdisjoint(names_of(attributes))


def blocks(page: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """What a page holds, in order: ("open", path, attributes) for a block, ("text", path, text), ("link", path, text).

    A path is the names of the blocks around, from the top. Elements inside a line belong to their block. A new block ends
    an open paragraph, and a closing tag ends everything that was opened after its element. An element inside a line that
    calls itself furniture is left out up to its end, or to the end of a block around it.
    """
    stack: list[tuple[str, tuple[str, ...]]] = []
    linked, muted, nested = 0, None, 0
    for kind, name, attributes in tokens(page):
        path = stack[-1][1] if stack else ()
        if muted:
            if name == muted and kind != "text":
                nested += 1 if kind == "open" else -1
                muted = muted if nested else None
                continue
            if kind != "close" or name not in BLOCKS:
                continue
            muted = None
        if kind == "text":
            yield ("link" if linked else "text"), path, name
        elif name == "a":
            linked = int(kind == "open")
        elif name == "br":
            yield "text", path, " "
        elif name not in BLOCKS and name not in CONTAINERS:
            if kind == "open" and attributes and name not in VOID and not FURNITURE_NAMES.isdisjoint(names_of(attributes)):
                muted, nested = name, 1
        elif kind == "close":
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] != name:
                depth -= 1
            if depth >= 0:
                del stack[depth:]
            yield "close", stack[-1][1] if stack else (), ""
        elif name in VOID or attributes.rstrip().endswith("/"):
            yield "close", path, ""
        else:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCKS:
                    break
            linked = 0
            path = (*(stack[-1][1] if stack else ()), block_name(name, attributes))
            stack.append((name, path))
            yield "open", path, attributes


# Wrappers ----------------------------------------------------------------------------------------------------------
# An element: n (pages that have it), o (how often they do), t (characters outside links), l (characters in links),
# a (links), b (texts), d (digest of its own text on every page, null once it differs), order (its children: names, and
# lists of names for repeated groups), kids (children by name).


def element() -> dict:
    return {"n": 1, "o": 0, "t": 0, "l": 0, "a": 0, "b": 0, "d": "", "order": [], "kids": {}}


def placed(order: list[list[str]], groups: list[list[str]]) -> list[list[str]]:
    """Align the children `groups` with `order`: what is met again earlier makes one repeated group of all in between."""
    at = -1
    for group in groups:
        known = [i for i, held in enumerate(order) if not set(held).isdisjoint(group)]
        if not known:
            at += 1
            order.insert(at, list(group))
            continue
        first, last = min(known), max(known)
        if first < at:
            last = max(last, at)
        if first == last and len(group) == 1:
            at = first
            continue
        whole = [name for held in order[first : last + 1] for name in held]
        whole += [name for name in group if name not in whole]
        order[first : last + 1] = [whole]
        at = first
    return order


def page_wrapper(page: str) -> dict:
    """The wrapper of a single page."""
    top = element()
    known = {(): top}
    runs: dict[tuple[str, ...], list[list[str]]] = {}
    texts: dict[tuple[str, ...], list[str]] = {}
    for kind, path, value in blocks(page):
        if kind == "open":
            above = known[path[:-1]]
            if path not in known:
                known[path] = above["kids"][path[-1]] = element()
            known[path]["o"] += 1
            sequence = runs.setdefault(path[:-1], [])
            if not sequence or sequence[-1] != path[-1]:
                sequence.append(path[-1])
            known[path]["b"] += 1
        elif kind in ("text", "link"):
            held = len(value.strip())
            if held:
                node = known[path]
                node["l" if kind == "link" else "t"] += held
                node["a"] += kind == "link"
                texts.setdefault(path, []).append(value)
    for path, sequence in runs.items():
        known[path]["order"] = placed([], [[name] for name in sequence])
    for path, parts in texts.items():
        node = known[path]
        node["d"] = digest(clean("".join(parts))) if node["o"] <= 1 else None
    return top


def merge(a: dict, b: dict) -> dict:
    """The least wrapper that both generalise to. Changes and returns `a`."""
    for name in ("n", "o", "t", "l", "a", "b"):
        a[name] += b[name]
    if a["d"] != b["d"]:
        a["d"] = None
    if a["order"] != b["order"]:
        a["order"] = placed(a["order"], b["order"])
    for name, kid in b["kids"].items():
        a["kids"][name] = merge(a["kids"][name], kid) if name in a["kids"] else kid
    return a


def expression(node: dict, name: str = "") -> str:
    """The wrapper as a regular expression, to be read."""
    parts = []
    for group in node["order"]:
        inner = " ".join(expression(node["kids"][k], k) + "?" * (len(group) > 1 or node["kids"][k]["n"] < node["n"]) for k in group)
        many = len(group) > 1 or node["kids"][group[0]]["o"] > node["kids"][group[0]]["n"]
        parts.append(f"({inner})+" if many else inner)
    if node["t"] or node["l"]:
        parts.insert(0, "#" if node["d"] is None else "constant")
    return f"<{name}>{' '.join(parts)}</{name}>"


def is_constant(node: dict) -> bool:
    return bool(node["d"]) and node["n"] >= SUPPORT


def weight(node: dict) -> int:
    """Characters of running text in an element and below."""
    own = node["t"] if node["t"] >= RUNNING * max(1, node["b"]) and not is_constant(node) else 0
    return own + sum(weight(k) for k in node["kids"].values())


def is_linked(node: dict) -> bool:
    """Whether an element and what is below is mostly links, and several of them on a page."""

    def total(x: dict, name: str) -> int:
        return x[name] + sum(total(k, name) for k in x["kids"].values())

    links, text = total(node, "l"), total(node, "t")
    return links >= LINKED * (links + text) and total(node, "a") >= LINKS * node["o"] > 0


def calls_itself_furniture(name: str) -> bool:
    tag, *words = name.split(".")
    return tag in FURNITURE_TAGS or (tag not in WHOLE and not FURNITURE_NAMES.isdisjoint(words))


def decide(top: dict) -> tuple[tuple[str, ...], frozenset[tuple[str, ...]]]:
    """Paths of the main part, and of furniture inside it."""
    path: tuple[str, ...] = ()
    at, around = top, None
    while at["kids"]:
        below = {k: weight(v) for k, v in at["kids"].items() if not calls_itself_furniture(k)}
        best = min(below, key=lambda k: (-below[k], k), default=None)
        if best is None or not below[best]:
            break
        if below[best] < SHARE * sum(below.values()):  # a tie: an article goes before the rest
            articles = [k for k in below if k.split(".")[0] in ARTICLE]
            if len(articles) != 1:
                break
            best = articles[0]
        kid = at["kids"][best]
        if not kid["kids"] or kid["o"] > kid["n"]:
            break
        path, at = (*path, best), kid
        if around is None and best.split(".")[0] in ARTICLE:
            around = path
    path = around or path
    at = top
    for name in path:
        at = at["kids"][name]
    varies = weight(at) > 0
    out = set()
    todo = [(path, at)]
    while todo:
        here, node = todo.pop()
        for name, kid in node["kids"].items():
            tag = name.split(".")[0]
            constant = varies and is_constant(kid) and not kid["kids"] and tag not in HEADINGS
            if tag not in WHOLE and (constant or is_linked(kid)):
                out.add((*here, name))
            else:
                todo.append(((*here, name), kid))
    return path, frozenset(out)


@lru_cache(maxsize=4096)
def host_decision(wrapper: str | None) -> tuple[tuple[str, ...], frozenset[tuple[str, ...]]] | None:
    return decide(json.loads(wrapper)) if wrapper else None


def infer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host and task, or several where a task meets very many hosts."""
    held: dict[str, dict] = {}

    def flush():
        return pa.RecordBatch.from_pydict({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            own = page_wrapper(page or "")
            held[host] = merge(held[host], own) if host in held else own
            if len(held) >= HOSTS:
                yield flush()
                held.clear()
    if held:
        yield flush()


def merge_batch(batch: dict[str, list]) -> dict[str, list]:
    out = []
    for wrappers in batch["wrappers"]:
        parsed = [json.loads(w) for w in wrappers]
        whole = parsed[0]
        for other in parsed[1:]:
            whole = merge(whole, other)
        out.append(json.dumps(whole))
    return {"host": batch["host"], "wrapper": out}


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: host, wrapper."""
    parts = with_host(pages).select("host", "html").mapInArrow(infer_batches, "host string, wrapper string")
    salted = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")).agg(
        F.sort_array(F.collect_list("wrapper")).alias("wrappers")
    )
    few = map_batches(salted.select("host", "wrappers"), merge_batch, "host string, wrapper string")
    whole = few.groupBy("host").agg(F.sort_array(F.collect_list("wrapper")).alias("wrappers"))
    return map_batches(whole, merge_batch, "host string, wrapper string")


def main_text(page: str | None, decision: tuple | None = None) -> str:
    """The main text of one page, by what its host's wrapper decided, or by its own where that part is missing."""
    if not page:
        return ""
    found = part_of(page, decision) if decision else None
    return part_of(page, decide(page_wrapper(page))) or "" if found is None else found


def part_of(page: str, decision: tuple) -> str | None:
    """The text of the main part of a page, or None if the page has no such part."""
    main, furniture = decision
    depth = len(main)
    out: list[str] = []
    run: list[str] = []
    seen = not depth
    left_out: tuple[str, ...] | None = None
    for kind, path, value in blocks(page):
        if kind in ("text", "link"):
            if left_out is None and path[:depth] == main:
                run.append(value)
            continue
        if run:
            if text := clean("".join(run)):
                out.append(text)
            run.clear()
        if left_out is not None and path[: len(left_out)] == left_out and not (kind == "open" and path == left_out):
            continue
        if left_out is not None and kind == "close" and len(path) >= len(left_out):
            continue
        left_out = None
        if kind == "open":
            seen |= path == main
            if path in furniture or furniture_by_name(path[-1].split(".")[0], value, path[:depth] == main):
                left_out = path
    if run and (text := clean("".join(run))):
        out.append(text)
    return "\n".join(out) if seen else None


def extract_batch(batch: dict[str, list]) -> dict[str, list]:
    texts = [main_text(p, host_decision(w)) for p, w in zip(batch["html"], batch["wrapper"])]
    return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    joined_pages = with_host(pages).join(infer_wrappers(pages), "host", "left")
    return map_batches(joined_pages.select("page_id", "url", "html", "wrapper"), extract_batch, EXTRACTED)
