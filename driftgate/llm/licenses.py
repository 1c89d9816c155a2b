"""License scans: notice phrases and identifier tags by an Aho-Corasick automaton, expressions by a shunting yard.

One pass of the automaton over the normalised words of a text finds all places of all phrases and of the identifier tag.
Behind each tag's place, the licence expression on the same line is parsed with the usual order of precedence (with, and,
or) and evaluated: what `and` holds together and what `or` leaves open stay apart, exceptions stay with their licence, and
equal expressions get one spelling. Every licence named becomes a label. A score says how sure the strongest evidence is: a
tag with a well-formed expression, a full notice phrase, a tag with a broken expression, or nothing.

Null texts count as empty: no words, no labels, score 0. Texts of any length are read whole, in time that grows with their
length and number of hits. Phrases that overlap all count. Repeated rows get equal results. Extra columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from driftgate.llm.common import map_batches

#: Phrases of the scan's contract, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl",
    "permission is hereby granted free of charge": "mit",
}
TAG = "spdx license identifier"
#: What follows a tag: the expression up to the end of its line.
BEHIND_TAG = re.compile(rb"[ \t]*:[ \t]*([^\n]*)")
PART = re.compile(r"[A-Za-z0-9.+:-]+|[()]")
#: Operators of licence expressions, the tightest first.
PRECEDENCE = {"with": 3, "and": 2, "or": 1}
PHRASE_SCORE, TAG_SCORE, BROKEN_TAG_SCORE = 0.9, 1.0, 0.5
SCANNED = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double, expressions array<string>"
)
#: Everything in ASCII but digits and letters becomes a blank, A-Z become a-z.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Phrases between blanks, so that only whole words match. Bytes are searched as Latin-1 characters."""
    found = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def parse_expression(text: str) -> list[str] | None:
    """A licence expression in postfix order, None where it isn't well-formed.

    Trailing comment marks don't count, and neither does a remark in brackets behind a whole expression.
    """
    parts = PART.findall(re.sub(r"(\*/|-->|#}).*", "", text))
    out: list[str] = []
    pending: list[str] = []
    operand_next = True
    for part in parts:
        word = part.lower()
        if word in PRECEDENCE:
            if operand_next:
                return None
            while pending and pending[-1] != "(" and PRECEDENCE[pending[-1]] >= PRECEDENCE[word]:
                out.append(pending.pop())
            pending.append(word)
            operand_next = True
        elif word == "(":
            if not operand_next:
                if "(" in pending:
                    return None
                break
            pending.append(word)
        elif word == ")":
            if operand_next:
                return None
            while pending and pending[-1] != "(":
                out.append(pending.pop())
            if not pending:
                return None
            pending.pop()
        else:
            if not operand_next:
                return None
            out.append(word)
            operand_next = False
    if operand_next or "(" in pending:
        return None
    return out + pending[::-1]


def evaluate(postfix: list[str]) -> tuple[str, set[str]] | None:
    """An expression in one spelling, and the licences it names. None where an exception has no licence of its own.

    Operands of `and` and of `or` are sorted, and a repeated one is one; an `or` inside an `and` is in brackets.
    """
    stack: list[tuple[str, frozenset[str], frozenset[str]]] = []  # operator, operands as written, licences
    for part in postfix:
        if part not in PRECEDENCE:
            stack.append(("", frozenset((part,)), frozenset((part,))))
            continue
        right, left = stack.pop(), stack.pop()
        if part == "with":
            if left[0] or right[0]:
                return None
            stack.append(("with", frozenset((f"{written(left)} with {written(right)}",)), left[2]))
            continue
        operands = frozenset().union(*(x[1] if x[0] == part else (written(x, part),) for x in (left, right)))
        stack.append((part if len(operands) > 1 else "", operands, left[2] | right[2]))
    return written(stack[-1]), set(stack[-1][2])


def written(value: tuple[str, frozenset[str], frozenset[str]], inside: str = "") -> str:
    operator, operands, _ = value
    text = f" {operator} ".join(sorted(operands))
    return f"({text})" if operator == "or" and inside == "and" else text


def scan_text(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels, score, evaluated expressions of one text."""
    octets = (text or "").encode("utf-8", "surrogatepass")
    folded = octets.translate(FOLD)
    words = folded.split()
    line = b"".join((b" ", b" ".join(words), b" "))
    ends, tags, base, labels, score = [], [], set(), set(), 0.0
    for end, phrase in automaton().iter(line.decode("latin-1")):
        if phrase == TAG:
            tags.append(end)
            continue
        score = PHRASE_SCORE
        if phrase in BASE:
            ends.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
        else:
            labels.add(NOTICES[phrase])
    starts: list[int] = []
    if ends or tags:
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = np.searchsorted(blanks, ends).tolist()
    expressions = []
    if tags:
        # Folding keeps the length, so the words' places in the folded bytes are those in the text.
        filled = np.frombuffer(folded, np.uint8) != 32
        closing = np.flatnonzero(filled & ~np.r_[filled[1:], False]) + 1
        for number in (np.searchsorted(blanks, tags) - 1).tolist():
            found = BEHIND_TAG.match(octets, int(closing[number]))
            if not found:
                continue
            postfix = parse_expression(found[1].decode("utf-8", "replace"))
            value = evaluate(postfix) if postfix else None
            if value:
                labels |= value[1]
                expressions.append(value[0])
            score = max(score, TAG_SCORE if value else BROKEN_TAG_SCORE)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | labels)), score, expressions,
    )


def scan_batch(batch: dict[str, list]) -> dict[str, list]:
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions")
    found = list(zip(*map(scan_text, batch["text"])))
    return {"doc_id": batch["doc_id"], **{n: list(c) for n, c in zip(columns, found)}}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document, with what the scan found in its whole text."""
    return map_batches(docs.select("doc_id", "text"), scan_batch, SCANNED)
