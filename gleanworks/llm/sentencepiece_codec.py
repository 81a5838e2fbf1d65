"""Operator 5: SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text under a vocabulary's piece scores is found left to right. Scores are kept of a window of
positions no longer than the longest piece. As soon as the paths of all surviving positions pass one boundary, the ids
before it are committed and forgotten, so that what is held is bounded by the longest stretch without such a boundary,
not by the text. Every piece of the vocabulary that holds a word mark (U+2581) starts with it, so that all paths meet
where a word begins and the window is committed there at the latest. What is committed from one such place to the next
depends on the characters between alone: a worker remembers a bounded number of these runs.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import batches_of

MARK = "▁"
#: A word with the marks before it: where the next one begins, all paths meet.
_RUNS, _WHOLE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+"), re.compile(".+", re.S)
#: How far below the lowest score an unknown character is put.
UNKNOWN_PENALTY = 10.0
#: Runs remembered by a worker between batches (some 250 MB), and the characters of one at most.
MEMORY, RUN = 1_000_000, 64
SCHEMA = "doc_id long, n_ids long, ids_crc32 long, n_chars long, decoded_crc32 long, round_trip boolean"


class Vocabulary:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.vocab_size())
        normal = [i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.score = {p.id_to_piece(i): (p.get_score(i), i) for i in normal}
        self.unknown = p.unk_id()
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}
        self.longest = max(map(len, self.score))
        self.penalty = min(s for s, _ in self.score.values()) - UNKNOWN_PENALTY
        self.text_of = {i: p.id_to_piece(i) for i in normal}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: Every prefix of a piece: (score, id), with id -1 where it is no piece itself.
        self.prefixes = {piece[:k]: (0.0, -1) for piece in self.score for k in range(1, len(piece))} | self.score
        self.mark_leads = all(MARK not in piece.lstrip(MARK) for piece in self.score)

    def unknown_ids(self, char: str) -> list[int]:
        """A character outside the vocabulary is its UTF-8 bytes, or the unknown id where the model has no byte pieces."""
        return [self.bytes[b] for b in char.encode()] if len(self.bytes) == 256 else [self.unknown]


def stream(text: str, v: Vocabulary, memory: dict[str, tuple[bytes, str]] | None = None) -> Iterator[tuple[bytes, str]]:
    """(little-endian uint32 ids, decoded text with its word marks) of each run of the best segmentation of an escaped
    text, as soon as no later character can change it.

    Of equal scores the one whose last piece is longest wins, which makes the result unique. Runs between places where all
    paths meet are taken from ``memory``, and put there up to MEMORY.
    """
    for m in (_RUNS if v.mark_leads else _WHOLE).finditer(text):
        run = m[0]
        known = memory.get(run) if memory is not None else None
        if known is not None:
            yield known
            continue
        runs = ((array("I", ids).tobytes(), pieces_text(ids, v)) for ids in committed(run, v))
        if memory is not None and len(run) < RUN and len(memory) < MEMORY:
            runs = list(runs)
            memory[run] = runs[0] if len(runs) == 1 else (b"".join(ids for ids, _ in runs), "".join(d for _, d in runs))
        yield from runs


def committed(text: str, v: Vocabulary) -> Iterator[list[int]]:
    """The ids of the best segmentation, each list as soon as all surviving paths share its end."""
    get, penalty, n, step = v.prefixes.get, v.penalty, len(text), 2 * v.longest
    base, check, room = 0, step, min(n, step)  # what is before base is committed; positions kept beyond it
    best = [0.0] + [-np.inf] * room
    back = [(0, -1)] + [(1, -1)] * room  # (length of the last piece, its id, or -1 for an unknown character)
    for i in range(n):
        k = i - base
        if room - k < step and base + room < n:
            more = min(step, n - base - room)
            best += [-np.inf] * more
            back += [(1, -1)] * more
            room += more
        here = best[k]
        if here + penalty > best[k + 1]:
            best[k + 1], back[k + 1] = here + penalty, (1, -1)
        for j in range(i + 1, n + 1):
            found = get(text[i:j])
            if found is None:  # no piece begins so
                break
            score, piece = found
            if piece >= 0 and here + score > best[j - base]:
                best[j - base], back[j - base] = here + score, (j - i, piece)
        if k + 1 >= check:
            meet = _meeting(back, k + 1, best)
            if meet:
                yield _path(text, back, base, base + meet, v)
                best, back = best[meet:], back[meet:]
                base, room, check = base + meet, room - meet, step
            else:
                check *= 2
    if base < n:
        yield _path(text, back, base, n, v)


def _meeting(back: list[tuple[int, int]], now: int, best: list[float]) -> int:
    """The last boundary that the best paths to ``now`` and to all positions that longer pieces have reached beyond pass."""
    points = {now} | {k - back[k][0] for k in range(now + 1, len(back)) if best[k] > -np.inf}
    while len(points) > 1:
        last = max(points)
        points.discard(last)
        points.add(last - back[last][0])
    return points.pop()


def _path(text: str, back: list[tuple[int, int]], base: int, end: int, v: Vocabulary) -> list[int]:
    parts = []
    while end > base:
        n, i = back[end - base]
        parts.append([i] if i >= 0 else v.unknown_ids(text[end - n : end]))
        end -= n
    return [i for p in reversed(parts) for i in p]


def escaped(text: str) -> str:
    """Spaces as word marks, one mark before the text; an empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of ids: byte pieces are joined and read as UTF-8, the mark before the text is dropped."""
    out, held = [], bytearray()
    for i in ids:
        if i in v.byte_of:
            held.append(v.byte_of[i])
            continue
        if held:
            out.append(held.decode(errors="replace"))
            held.clear()
        out.append(v.text_of.get(i, "⁇"))
    if held:
        out.append(held.decode(errors="replace"))
    text = "".join(out).replace(MARK, " ")
    return text[1:] if text[:1] == " " else text


@functools.lru_cache(maxsize=1)
def _worker(path: str):
    """The vocabulary and the runs that this worker remembers."""
    return Vocabulary(path), {}


def encode_all(texts: list[str | None], path: str) -> list[tuple[bytes, str]]:
    """(little-endian uint32 ids, decoded text) of each text."""
    v, memory = _worker(path)
    out = []
    for text in texts:
        runs = list(stream(escaped(text or ""), v, memory))
        decoded = "".join(d for _, d in runs).replace(MARK, " ")
        out.append((b"".join(ids for ids, _ in runs), decoded[1:] if decoded[:1] == " " else decoded))
    return out


def pieces_text(ids: list[int], v: Vocabulary) -> str:
    """As ``decode_raw``, at once where there are no byte pieces."""
    try:
        return "".join([v.text_of[i] for i in ids])
    except KeyError:
        return decode_raw(ids, v)


def decode_raw(ids: list[int], v: Vocabulary) -> str:
    """As ``decode``, with the word marks left in."""
    out, held = [], bytearray()
    for i in [*ids, -1]:
        if i in v.byte_of:
            held.append(v.byte_of[i])
        else:
            out.append(held.decode(errors="replace"))
            held.clear()
            out.append("" if i < 0 else v.text_of.get(i, "⁇"))
    return "".join(out)


def _codec(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in batches_of(texts):
                cols: list[list] = [[] for _ in range(5)]
                for text, (ids, decoded) in zip(texts[a:b], encode_all(texts[a:b], path), strict=True):
                    row = (len(ids) // 4, zlib.crc32(ids), len(decoded), zlib.crc32(decoded.encode()), decoded == (text or ""))
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                kinds = [pa.int64()] * 4 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return run


def sentencepiece_codec(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id long, text, ...)``: doc_id, n_ids, ids_crc32, n_chars, decoded_crc32, round_trip.

    The whole text is encoded and its ids are decoded again; n_chars and decoded_crc32 are of the decoded text, and
    round_trip says whether it equals the text. A null text counts as empty and has no ids. A text that holds U+2581
    itself is decoded with a space in its place. A null doc_id stays null; repeated rows are encoded alike; other columns
    are ignored; an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_codec(path), SCHEMA)
