"""License scans against plain code: places of phrases, expressions, and long texts."""

import itertools
import random
import re
import time

from driftgate.llm import licenses

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_places(text):
    words = plain_words(text)
    return sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def test_places_of_phrases_agree_with_slices_of_words():
    rng = random.Random(6)
    pieces = ["Under", "the", "MIT", "license,", "Apache", "License", "version", "2", "2.0", "CC", "BY-NC", "cc", "é", "_", "\n", "x9", "by", "nc", "--", "日本"]
    for _ in range(400):
        text = " ".join(rng.choices(pieces, k=rng.randint(0, 30))) + rng.choice(["", " cc by nc by nc", " under the mit license cc-by-nc"])
        n, n_base, first, last, base, labels, score, _ = licenses.scan_text(text)
        places = plain_places(text)
        assert (n, n_base) == (len(plain_words(text)), len(places))
        assert (first, last) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert base == labels == ",".join(sorted({p[1] for p in places})) and score == (0.9 if places else 0.0)


def value(node):
    """The set of sets of licences that a tree of and/or allows."""
    if isinstance(node, str):
        return {frozenset((node,))}
    op, left, right = node
    a, b = value(left), value(right)
    return a | b if op == "or" else {x | y for x, y in itertools.product(a, b)}


def text_of(node):
    return node if isinstance(node, str) else f"({text_of(node[1])} {node[0].upper()} {text_of(node[2])})"


def reread(text):
    """The value of an expression in its one spelling, by Python's own precedence of & and |."""

    class Term(frozenset):
        def __and__(self, other):
            return Term(x | y for x, y in itertools.product(frozenset(self), frozenset(other)))

        def __or__(self, other):
            return Term(frozenset.__or__(self, other))

    names = {n: Term({frozenset((n,))}) for n in "abcd"}
    return frozenset(eval(text.replace(" and ", " & ").replace(" or ", " | "), {}, names))


def test_expressions_allow_what_their_tree_allows():
    rng = random.Random(3)

    def tree(depth):
        return rng.choice("abcd") if not depth or rng.random() < 0.2 else (rng.choice(["and", "or"]), tree(depth - 1), tree(depth - 1))

    for _ in range(300):
        node = tree(3)
        spelled, named = licenses.evaluate(licenses.parse_expression(text_of(node)))
        assert reread(spelled) == frozenset(value(node)) and named == set().union(*value(node))


def test_tags():
    scan = lambda t: licenses.scan_text(t)[5:]
    assert scan("// SPDX-License-Identifier: MIT OR Apache-2.0 */") == ("apache-2.0,mit", 1.0, ["apache-2.0 or mit"])
    assert scan("SPDX-License-Identifier:Apache-2.0 and MIT and mit") == ("apache-2.0,mit", 1.0, ["apache-2.0 and mit"])
    assert scan("SPDX-License-Identifier: MIT (see LICENSE)") == ("mit", 1.0, ["mit"])
    assert scan("SPDX-License-Identifier: (MIT OR BSD-3-Clause) AND GPL-2.0 WITH Classpath-exception-2.0") == (
        "bsd-3-clause,gpl-2.0,mit", 1.0, ["(bsd-3-clause or mit) and gpl-2.0 with classpath-exception-2.0"])
    for broken in ("MIT OR", "(MIT", "MIT Apache", "AND MIT", "", "(MIT OR BSD) WITH x"):
        assert scan(f"SPDX-License-Identifier: {broken}\nMIT") == ("", 0.5, [])
    assert scan("spdx license identifier without a colon") == ("", 0.0, [])
    two = scan("é SPDX-License-Identifier: MIT\n\n日 SPDX-License-Identifier: Zlib under the MIT License")
    assert two[2] == ["mit"] and two[1] == 0.9 + 0.1


def test_very_many_hits_take_time_in_proportion():
    text = "cc by nc and more words here " * 100_000
    started = time.process_time()
    n, n_base, first, last, *_ = licenses.scan_text(text)
    assert (n, n_base, first, last) == (700_000, 100_000, 0, 699_993)
    assert time.process_time() - started < 10
