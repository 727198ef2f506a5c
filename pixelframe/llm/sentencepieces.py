"""SentencePiece encoding through a table of distinct chunks, and decoding from ids.

The model's text form puts a marker before every word. Where no piece has a marker behind another character, no merge
crosses the place in front of a run of markers, and a text falls into chunks: a run of markers and the word behind it. By the same
reason a character that no longer piece holds is a chunk of its own, and a word ends before a sign that no piece has behind a
letter. A model whose pieces do cross markers has whole texts as chunks.

Texts become positions in the table of distinct chunks; each chunk is segmented once, by byte-pair merges of the model's scores, when it
enters the table, and the ids of a block of texts are gathered from the table by position, all at once. A worker has one
table for all tasks it runs. It is bounded by TABLE_BYTES and starts anew beyond them, which costs time only: nothing is dealt out, so
no word is hot, and a lost task is done again by itself.

Defined results. Null and empty texts have the begin and end ids only. Blanks, line ends and characters without a piece
are encoded as they are, the latter by bytes. A literal marker (U+2581) reads back as a blank, as the library has it. Repeated
rows and null ids stay; an empty table gives an empty table. The text column gives way to `ids`, other columns stay;
an input column with the name of a result is replaced. A text without any white space is one chunk, segmented in O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
#: Bytes of a worker's table, CHUNK_BYTES of overhead for each chunk included.
TABLE_BYTES, CHUNK_BYTES = 64 << 20, 160
#: Characters up to which a chunk's pairs are scanned, not kept in a heap.
SHORT = 40


def _chunk_pattern(longer: list[str]) -> str:
    """Chunks, where pieces cross no marker: `longer` are the pieces of two or more characters."""
    held = {c for x in longer for c in x} - {MARK}
    word = {c for c in held if re.match(r"\w", c)}
    behind = {b for x in longer for a, b in zip(x, x[1:], strict=False) if a in word and b not in word}
    of = lambda chars: f"[{re.escape(''.join(sorted(chars)))}]" if chars else "(?!)"
    signs, words = of(held - word), of(word)
    return f"(?s)[^{of(held | {MARK})[1:]}|(?=.){MARK}*{signs}*{words}*(?:{of(behind)}{signs}*{words}*)*"


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.piece = [model.id_to_piece(i) for i in every]
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {self.piece[i]: i for i in plain}
        self.scores = {self.piece[i]: model.get_score(i) for i in plain}
        self.bytes = {int(self.piece[i][1:-1], 16): i for i in every if model.is_byte(i)}
        longer = [self.piece[i] for i in plain if len(self.piece[i]) > 1]
        crosses = any(MARK in x.lstrip(MARK) for x in longer)
        self.chunk = re.compile("(?s).+" if crosses else _chunk_pattern(longer))
        # What each id reads as, for decoding: bytes in one array, with ends.
        said = [b""] * len(self.piece)
        for i in plain:
            said[i] = self.piece[i].replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            said[i] = bytes([b])
        if self.unknown >= 0:
            said[self.unknown] = model.decode([self.unknown]).encode()
        self.said = said
        self.flat = np.frombuffer(b"".join(said), np.uint8)
        self.size = np.array([len(x) for x in said])
        self.at = np.cumsum(self.size) - self.size
        self.is_byte = np.isin(np.arange(len(said)), list(self.bytes.values()))
        self.silent = np.array([model.is_control(i) for i in every])
        self.marked = np.array([x.startswith(MARK) for x in self.piece]) & ~self.silent

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk: the adjacent pair of best score is merged, the leftmost of equal ones, until no pair is a piece."""
        n, scores = len(chunk), self.scores
        if n <= SHORT:
            return self._ids(self._short(chunk))
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # each symbol's end, and the start of the one before
        agenda: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            score = scores.get(chunk[a : end[b]])
            if score is not None:
                heapq.heappush(agenda, (-score, a, b, end[b]))

        for a in range(n - 1):
            offer(a, a + 1)
        while agenda:
            _, a, b, to = heapq.heappop(agenda)
            if end[a] != b or end[b] != to:  # one of the two has been merged since
                continue
            end[a], end[b] = to, -1
            if to < n:
                left[to] = a
                offer(a, to)
            if left[a] >= 0:
                offer(left[a], a)
        parts, a = [], 0
        while a < n:
            parts.append(chunk[a : end[a]])
            a = end[a]
        return self._ids(parts)

    def _short(self, chunk: str) -> list[str]:
        """The pieces of a short chunk: scanning its pairs beats a heap of them."""
        parts, score = list(chunk), self.scores.get
        low = float("-inf")
        pairs = [score(a + b, low) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == low:
                break
            k = pairs.index(best)
            parts[k] += parts.pop(k + 1)
            del pairs[k]
            if k:
                pairs[k - 1] = score(parts[k - 1] + parts[k], low)
            if k < len(pairs):
                pairs[k] = score(parts[k] + parts[k + 1], low)
        return parts

    def _ids(self, parts: list[str]) -> list[int]:
        out = []
        for piece in parts:
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[x] for x in piece.encode())
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """What the ids read as; the marker in front of the first word goes, bytes that are no character become U+FFFD each."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return b""
        out = self.flat[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()
        if self.is_byte[ids].any():
            try:
                whole = out.decode() is not None and not self.silent[ids[1:-1]].any()  # a silent id parts bytes too
            except UnicodeDecodeError:
                whole = False
            out = out if whole else self._mended(ids)
        first = ids[np.argmin(self.silent[ids])]
        return out[1:] if self.marked[first] else out

    def _mended(self, ids: np.ndarray) -> bytes:
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.said[i]
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        run[:k].decode()
                    except UnicodeDecodeError:
                        continue
                    break
                else:
                    k = 0
                out.append(run[:k] if k else "�".encode())
                run = run[k or 1 :]
            if i is not None:
                out.append(self.said[i])
        return b"".join(out)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Chunks:
    """The table of distinct chunks of the texts seen: ids of each, one after the other."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.size, self.bytes = array("i"), array("i"), 0

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, begin and end ids included, and where each text's ids start."""
        if self.bytes > TABLE_BYTES:
            self.clear()
        v, place = self.v, self.place
        codes, count = array("i"), []
        for text in texts:
            found = v.chunks(text or "")
            count.append(len(found))
            for chunk in found:
                at = place.get(chunk)
                if at is None:
                    at = place[chunk] = len(place)
                    ids = v.segment(chunk)
                    self.ids.extend(ids)
                    self.size.append(len(ids))
                    self.bytes += CHUNK_BYTES + len(chunk) + 4 * len(ids)
                codes.append(at)
        codes, size = np.array(codes), np.array(self.size, np.int64)
        starts = np.cumsum(size) - size
        k = size[codes]
        to = np.concatenate(([0], np.cumsum(k)))
        cuts = np.concatenate(([0], np.cumsum(count)))
        rows = np.concatenate(([0], np.cumsum(np.diff(to[cuts]) + 2)))
        out, inner = np.empty(rows[-1], np.int32), np.ones(rows[-1], bool)
        inner[rows[:-1]] = inner[rows[1:] - 1] = False
        out[rows[:-1]], out[rows[1:] - 1] = v.begin, v.end
        out[inner] = np.array(self.ids)[np.repeat(starts[codes] - to[:-1], k) + np.arange(to[-1])]
        return out, rows


@lru_cache(2)
def chunks_of(model: str) -> Chunks:
    return Chunks(vocabulary(model))


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` (array<int>, begin and end ids included) in place of the column `text`."""
    others = [c for c in docs.columns if c.lower() not in (text.lower(), "ids", "text")]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks_of(model)
        for batch in slices(batches):
            ids, rows = table.encoded(batch["text"].to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), lists], [*others, "ids"])

    return docs.select(*(F.col(f"`{c}`") for c in others), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{kinds}ids array<int>")


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """`encoded` with `decoded`, the text that its ids read as. Control ids are silent, null ids give null; an id out of range raises."""

    @F.arrow_udf("string")
    def read(column: pa.Array) -> pa.Array:
        v = vocabulary(model)
        return pa.array([None if x is None else v.decode(np.asarray(x)).decode() for x in (x.values for x in column)], pa.string())

    return encoded.withColumn("decoded", read(F.col(ids)))


def ids_sha256(ids: Column) -> Column:
    """Lowercase hex digest of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("string")
    def digest_of(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hashlib.sha256(np.asarray(x).astype("<u4").tobytes()).hexdigest() for x in (x.values for x in column)], pa.string())

    return digest_of(ids)


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text)."""
    both = decode(encode(docs.select("doc_id", "text"), model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
