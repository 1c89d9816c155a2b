"""Token ids of whole texts by a Hugging Face tokenizer file, one unit of the file's own splitting at a time.

The file must lower-case, drop white space and split by a pattern that it names; then a text's ids are the ids of its units
one after the other. What the units are is read from the file, and that its splitting is what this module does with it is
checked against the library when it is loaded, for every character that the short way may see. Each worker remembers the
units it met lately in two halves: when the younger half is full, it becomes the older one, and units that are met again
move back. So frequent units are never forgotten.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache
from pathlib import Path

from tokenizers import Tokenizer, pre_tokenizers

#: Units in each half of a worker's memory.
REMEMBERED = 150_000
#: Characters below this one need no composition, and their lower case doesn't depend on their neighbours.
SHORT_WAY = 0x100


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def unit_pattern(path: str) -> str | None:
    """The pattern whose hits are the units, if the file is of the kind described above."""
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    steps = (file.get("normalizer") or {}).get("normalizers", [])
    kinds = [s.get("type") for s in steps]
    splits = [s for s in (file.get("pre_tokenizer") or {}).get("pretokenizers", []) if s.get("type") == "Split"]
    if kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1:
        return None
    split = splits[0]
    if split.get("behavior") != "Removed" or not split.get("invert"):
        return None
    return split["pattern"].get("Regex")


def for_short_way(pattern: str) -> str:
    """The pattern with its Unicode classes written out for the characters of the short way, which `re` can search."""
    chars = [chr(c) for c in range(SHORT_WAY)]
    classes = {
        "\\p{L}": [c for c in chars if unicodedata.category(c)[0] == "L"],
        "\\p{N}": [c for c in chars if unicodedata.category(c)[0] == "N"],
        # White space as Unicode has it, which is not what `re` has.
        "\\s": [c for c in chars if c.isspace() and not "\x1c" <= c <= "\x1f"],
    }
    for name, members in classes.items():
        pattern = pattern.replace(name, "".join(map(re.escape, members)))
    return pattern


class UnitEncoder:
    """Ids as little-endian unsigned 32-bit bytes. Texts that the short way can't be sure of go to the library whole."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        pattern = unit_pattern(path)
        self.units = re.compile(for_short_way(pattern)).findall if pattern else None
        self.model = self.tokenizer.model
        self.octets = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if self.units:
            probes = [f"{a}{chr(c)}{b}" for c in range(SHORT_WAY) for a, b in (("a", "B"), ("1", " "), ("!", "'s"))]
            if any(self.short(p) != self.whole(p) for p in probes):
                self.units = None

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def unit_ids(self, unit: str) -> bytes:
        """The ids of one unit, from the library's model: its characters stand for bytes, printable ASCII for itself."""
        held = unit if unit.isascii() and unit.isprintable() else self.octets.pre_tokenize_str(unit)[0][0]
        return packed([t.id for t in self.model.tokenize(held)])

    def turn(self) -> None:
        """Forget what was not met since the last turn, if the younger half is full."""
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}

    def short(self, text: str) -> bytes:
        units = self.units(text.lower())
        found = list(map(self.young.get, units))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    unit = units[i]
                    ids = self.young.get(unit) or self.old.get(unit) or self.unit_ids(unit)
                    self.young[unit] = found[i] = ids
        return b"".join(found)

    def is_plain(self, text: str) -> bool:
        """The short way is sure: no character beyond those checked, no added token."""
        return text.isascii() or max(text) < chr(SHORT_WAY)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.units and self.is_plain(text) and not any(s in text for s in self.special):
                out.append(self.short(text))
            else:
                out.append(self.whole(text))
            self.turn()
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)
