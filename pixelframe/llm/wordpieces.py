"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes and an end-of-word symbol; an end that no piece takes in ends the split
and is no piece itself. Each node has a failure link and the
number of pieces that following it pops: a node that is a piece pops itself and fails to the root, any
other pops what its parent's chain pops until a node with the needed edge is found. Reading a word then
takes one step for each symbol and gives the length of the greedy longest-match split without building it.

Words: runs without white space, lower-cased in NFC, cut into contractions, runs of letters, single
digits and runs of other characters, as the vocabulary's own tokenizer cuts them.

Defined results. Null, empty and blank texts have 0 words and pieces. A word with a symbol that no piece
starts with is one piece (unknown). Repeated rows are counted row by row. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

VOCABULARY = "word_bpe_49k.json"
END, SYMBOLS = 256, 257
#: Fixed values of the byte-level alphabet: the ranges of bytes that stand for themselves.
PLAIN_BYTES = (range(33, 127), range(161, 173), range(174, 256))
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Cached runs a Python worker holds at most, when the cache is emptied, and characters of the longest that it takes.
CACHE_WORDS, CACHE_CHARS = 150_000, 100


def byte_of() -> dict[str, int]:
    """Bytes of the vocabulary's characters: plain ones as they are, the others from 256 on in order."""
    plain = {b for r in PLAIN_BYTES for b in r}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces as symbols; the mark `</w>` at a piece's end is END."""
    symbol = byte_of()
    out = []
    with open(path, encoding="utf-8") as f:
        for piece in json.load(f)["model"]["vocab"]:
            body = piece.removesuffix("</w>")
            if body and all(c in symbol for c in body):
                out.append(tuple(symbol[c] for c in body) + ((END,) if body != piece else ()))
    return out


class Automaton:
    """Trie edges by node * SYMBOLS + symbol; failure links (-1: none) and popped-piece counts by node."""

    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        self.edge: dict[int, int] = {}
        parent, label = [-1], [-1]
        whole = set()
        for piece in [*pieces, (END,)]:
            node = 0
            for s in piece:
                key = node * SYMBOLS + s
                if key not in self.edge:
                    self.edge[key] = len(parent)
                    parent.append(node)
                    label.append(s)
                node = self.edge[key]
            whole.add(node)
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        self.fail, self.pops = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if v in whole:
                self.fail[v], self.pops[v] = 0, int(v != self.edge[END])
                continue
            z, popped = self.fail[parent[v]], self.pops[parent[v]]
            while z >= 0 and z * SYMBOLS + label[v] not in self.edge:
                popped += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.edge[z * SYMBOLS + label[v]], popped

    def count(self, symbols: bytes) -> int:
        """Pieces of a word given by its bytes; 1 if it has no split."""
        edge, fail, pops = self.edge, self.fail, self.pops
        u = n = 0
        for s in (*symbols, END):
            while (to := edge.get(u * SYMBOLS + s)) is None:
                if fail[u] < 0:
                    return 1
                n += pops[u]
                u = fail[u]
            u = to
        while u:
            if fail[u] < 0:
                return 1
            n += pops[u]
            u = fail[u]
        return n


@lru_cache(1)
def automaton(name: str) -> Automaton:
    import public_tokenizers

    return Automaton(read_vocabulary(public_tokenizers.path(name)))


_known: dict[str, tuple[int, int]] = {}


def measure(run: str, machine: Automaton) -> tuple[int, int]:
    """(words, pieces) of a run without white space."""
    parts = PARTS.findall(unicodedata.normalize("NFC", run).lower())
    return len(parts), sum(machine.count(p.encode()) for p in parts)


def count_pieces(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars (code points), n_words, n_pieces (long) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocabulary)
        for batch in slices(batches):
            words, pieces, chars = [], [], []
            for text in batch["text"].to_pylist():
                text = text or ""
                w = p = 0
                for r in text.split():
                    got = _known.get(r)
                    if got is None:
                        if len(_known) >= CACHE_WORDS:
                            _known.clear()
                        got = measure(r, machine)
                        if len(r) <= CACHE_CHARS:
                            _known[r] = got
                    w += got[0]
                    p += got[1]
                chars.append(len(text))
                words.append(w)
                pieces.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (chars, words, pieces))],
                ["doc_id", "n_chars", "n_words", "n_pieces"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_chars long, n_words long, n_pieces long"
    )
