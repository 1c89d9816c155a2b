"""Token counts by compiled finite-state tokenizers, run in parallel over chunks of text.

The splitting pattern of byte-level tokenizers is compiled into a deterministic transducer over classes of characters,
whose transitions say where tokens' words begin. All texts of a batch are one stream, cut into chunks of equal length. Each
chunk is run from every state at once, which gives a map from states to states; a parallel prefix scan composes these
maps, so every chunk knows the state it begins in, and one more pass reads off the words. How many tokens a word emits
comes from the automaton over the vocabulary (`automaton.py`), whose steps carry the number of tokens so far; words that
were seen before are looked up.

Null texts count as empty and have no tokens. Strings of the vocabulary's special tokens count as that one token, as the
library does by default. Repeated rows get equal results. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame

from driftgate.llm.automaton import Automaton
from driftgate.llm.common import map_batches

LIMIT = 1024
COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
CHUNK = 256
REMEMBERED = 500_000

CLASSES = ("letter", "stmd", "r", "v", "e", "l", "number", "apostrophe", "other", "space", "blank", "end")
STATES = ("start", "letters", "numbers", "others", "space", "spaces", "blank", "blanks", "quote", "quote_r", "quote_v", "quote_l", "short")
LETTERS = frozenset(("letter", "stmd", "r", "v", "e", "l"))
#: Where words begin: at this character, at the one before.
HERE, BEFORE = 1, 2


def transition(state: str, kind: str) -> tuple[str, int]:
    """The compiled pattern: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|blanks not before others|blanks."""
    if state == "quote":
        if kind == "stmd":
            return "short", 0
        if kind in ("r", "v", "l"):
            return f"quote_{kind}", 0
        if kind in ("apostrophe", "other"):
            return "others", 0
    if state.startswith("quote_"):
        if kind == {"r": "e", "v": "e", "l": "l"}[state[-1]]:
            return "short", 0
        after, begun = transition("letters", kind)  # the quote stands alone, its follower begins letters
        return after, begun | BEFORE
    if kind == "end":
        return "start", 0
    if kind in ("space", "blank"):
        within = state in ("space", "spaces", "blank", "blanks")
        return kind + "s" * within, 0 if within else HERE
    begun = {"space": 0, "spaces": BEFORE, "blank": HERE, "blanks": HERE | BEFORE}.get(state)
    if kind in LETTERS:
        return "letters", (0 if state == "letters" else HERE) if begun is None else begun
    if kind == "number":
        return "numbers", (0 if state == "numbers" else HERE) if begun is None else begun
    if kind == "apostrophe" and state not in ("others", "space", "spaces"):
        return "quote", HERE if begun is None else begun
    return "others", (0 if state == "others" else HERE) if begun is None else begun


def compile_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begun words, both at [class, state]."""
    after = np.zeros((len(CLASSES), len(STATES)), np.uint8)
    begun = np.zeros_like(after)
    for c, kind in enumerate(CLASSES):
        for s, state in enumerate(STATES):
            to, begins = transition(state, kind)
            after[c, s], begun[c, s] = STATES.index(to), begins
    return after, begun


NEXT, BEGUN = compile_tables()
END = CLASSES.index("end")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, CLASSES.index("other"), np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            out[code] = CLASSES.index("letter" if kind == "L" else "number")
        elif chr(code).isspace() and not 0x1C <= code <= 0x1F:
            out[code] = CLASSES.index("blank")
    for text, kind in (("stmd", "stmd"), ("r", "r"), ("v", "v"), ("e", "e"), ("l", "l"), ("'", "apostrophe"), (" ", "space")):
        for char in text:
            out[ord(char)] = CLASSES.index(kind)
    return out


def start_states(columns: np.ndarray) -> np.ndarray:
    """The state each chunk begins in. columns: classes at [place in chunk, chunk]."""
    states = len(STATES)
    maps = np.broadcast_to(np.arange(states, dtype=np.intp), (columns.shape[1], states))
    flat = NEXT.ravel().astype(np.intp)
    for kinds in columns.astype(np.intp) * states:
        maps = flat[kinds[:, None] + maps]
    # Prefix scan: after k rounds a map covers 2^k chunks.
    step = 1
    while step < len(maps):
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)])
        step *= 2
    return np.r_[0, maps[:-1, 0]]


def word_starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions in a stream of classes at which words begin; every text in it is followed by an end."""
    if not len(kinds):
        return np.empty(0, np.int64)
    padded = np.full(-(-len(kinds) // chunk) * chunk, END, np.uint8)
    padded[: len(kinds)] = kinds
    columns = padded.reshape(-1, chunk).T
    state, flat, begun = start_states(columns), NEXT.ravel().astype(np.intp), BEGUN.ravel()
    marks = np.empty(columns.shape, np.uint8)
    for place, kind in enumerate(columns.astype(np.intp) * len(STATES)):
        at = kind + state
        marks[place], state = begun[at], flat[at]
    marks = marks.T.ravel()
    here = (marks & HERE).astype(bool)
    here[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return np.flatnonzero(here)


def split_words(texts: list[str]) -> list[list[str]]:
    """The words of each text, which together are the text."""
    table = class_table()
    parts = []
    for text in texts:
        parts += (table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], [END])
    kinds = np.concatenate(parts).astype(np.uint8) if parts else np.empty(0, np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts = word_starts(kinds)
    bounds = np.searchsorted(starts, begins)
    out = []
    for k, text in enumerate(texts):
        at = (starts[bounds[k] : bounds[k + 1]] - begins[k]).tolist()
        out.append([text[a:b] for a, b in zip(at, [*at[1:], len(text)])])
    return out


def byte_of() -> dict[str, int]:
    """The printable characters by which vocabulary files write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """Token counts of texts by a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_of()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        pieces = {as_bytes(p): i for p, i in spec["model"]["vocab"].items() if p not in special}
        merges = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(spec["model"]["merges"])}
        self.automaton = Automaton(pieces, rank=lambda a, b: merges.get((a, b)))
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.known: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self.automaton.counts([w.encode("utf-8", "surrogatepass") for w in new])))

    def count(self, texts: list[str]) -> list[int]:
        totals, parts, owner = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            pieces = self.special.split(text)
            totals[k] = len(pieces) - 1
            parts += pieces
            owner += [k] * len(pieces)
        split = split_words(parts)
        self.learn({w for words in split for w in words})
        for k, words in zip(owner, split):
            totals[k] += sum(map(self.known.__getitem__, words))
        return totals


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_batch(batch: dict[str, list], path: str, limit: int) -> dict[str, list]:
    texts = [t or "" for t in batch["text"]]
    tokens = counter(path).count(texts)
    return {
        "doc_id": batch["doc_id"],
        "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
        "n_tokens": tokens,
        "over_limit": [n > limit for n in tokens],
    }


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    return map_batches(docs.select("doc_id", "text"), partial(count_batch, path=path, limit=limit), COUNTED)
