"""SentencePiece encoding and decoding, driven by the automaton over a model's pieces (`automaton.py`).

A model of type unigram splits by the best sum of scores, one of type BPE by what its merges leave; either way one pass
of the automaton relaxes the best score of each position along the output links. White space is written as the model
does: a blank goes before the text, and blanks belong to the word that follows. Characters without a piece become their
bytes. Models are expected to leave texts as they are (no normalisation), to put a blank in front and to have byte pieces.

Null texts count as empty and have no ids. Repeated rows get equal results. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache, partial

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from driftgate.llm.automaton import Automaton
from driftgate.llm.common import map_batches
from driftgate.llm.words import packed

MARK = "▁"
CHUNKS = re.compile(r" *[^ ]+| +")
REMEMBERED = 400_000
ENCODED = "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, ids_crc32 bigint, round_trip boolean"


class Codec:
    """Texts to ids and back. unigram: split by summed scores instead of by merges."""

    def __init__(self, path: str, unigram: bool = False):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes_of = {}, {}
        self.byte_ids = [0] * 256
        scores = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece.replace(MARK, " ").encode()] = i
                scores[i] = model.get_score(i)
        self.bytes_of |= {i: p for p, i in self.pieces.items()}
        order = {p: -scores[i] for p, i in self.pieces.items()}
        rank = None if unigram else lambda a, b: order.get(a + b)
        chars = lambda b: [c.encode() for c in b.decode()]
        self.automaton = Automaton(self.pieces, rank, scores, chars)
        single = {p.decode() for p in self.pieces if len(p.decode()) == 1}
        # Characters without a piece stand alone: nothing merges with them.
        self.alone = re.compile("([^" + "".join(map(re.escape, sorted(single))) + "]+)")
        self.known: dict[str, bytes] = {}
        self.spaced = not unigram and not any(" " in p.decode().lstrip(" ") for p in self.pieces)

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [c for c in chunks if c not in self.known]
        parts = [self.alone.split(c) for c in new]
        segments = list({s for p in parts for s in p[::2]})
        ids = dict(zip(segments, self.automaton.encode([s.encode() for s in segments])))
        for chunk, split in zip(new, parts):
            found: list[int] = []
            for k, part in enumerate(split):
                found += [self.byte_ids[b] for b in part.encode()] if k % 2 else ids[part]
            self.known[chunk] = packed(found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        spaced = [" " + t.replace(MARK, " ") if t else "" for t in texts]
        # No piece of a spaced vocabulary goes on after a blank, so words can be taken one by one.
        split = [CHUNKS.findall(t) if self.spaced else [t] for t in spaced]
        self.learn({c for chunks in split for c in chunks})
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids; without the blank that encoding put in front."""
        raw = b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_batch(batch: dict[str, list], path: str) -> dict[str, list]:
    tool = codec(path)
    low, high = min(tool.byte_ids), max(tool.byte_ids)
    encoded = tool.encode(batch["text"])
    return {
        "doc_id": batch["doc_id"],
        "n_tokens": [len(ids) // 4 for ids in encoded],
        "n_byte_tokens": [int(((n >= low) & (n <= high)).sum()) for n in (np.frombuffer(ids, "<u4") for ids in encoded)],
        "ids_crc32": [zlib.crc32(ids) for ids in encoded],
        "round_trip": [tool.decode(ids) == (t or "").replace(MARK, " ") for ids, t in zip(encoded, batch["text"])],
    }


def encode_report(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: number and checksum of its ids, byte ids among them, whether decoding gives the text back."""
    return map_batches(docs.select("doc_id", "text"), partial(encode_batch, path=path), ENCODED)
