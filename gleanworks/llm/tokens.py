"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct word of a batch encoded once.

The vocabulary's pre-tokeniser never joins a character and the white space after it, so a text may be cut wherever a
space or line feed follows something else. The pieces of a batch are told apart by Arrow's dictionary encoding, the
distinct ones are encoded in long joined runs and told apart again by the byte length of each id, and numpy puts the ids
of the texts together. A worker remembers the ids of a bounded number of pieces between batches. A text with other white space is encoded whole. The ids equal those of ``encode`` on the text.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa

#: About so many bytes of text are encoded at once; a longer text is encoded on its own, whole.
BATCH_BYTES = 12_000_000
#: Distinct pieces joined to one string for the library, and pieces that a worker remembers (some 60 MB).
RUN, MEMORY = 2000, 300_000
_OTHER_SPACE = re.compile(r"[^\S \n]")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer, the byte length of each id and the remembered pieces, kept by each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    vocab = t.get_vocab(with_added_tokens=True)
    lengths = np.zeros(max(vocab.values()) + 1, np.int64)
    for piece, i in vocab.items():
        lengths[i] = len(piece)
    return t, lengths, {}


def batches_of(texts: list[str | None]):
    """Slices (from, to) of about BATCH_BYTES each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all ids one after another as uint32, number of ids of each text); null is an empty text."""
    t, lengths, memory = tokenizer(path)
    whole = [x for x in texts if x and _OTHER_SPACE.search(x)]
    odd = {x: np.array(e.ids, np.uint32) for x, e in zip(whole, t.encode_batch_fast(whole, add_special_tokens=False), strict=True)} if whole else {}
    raw = [b"" if not x or x in odd else x.encode() for x in texts]
    index, starts_of, pieces = _distinct_pieces(raw)
    flat, first, count = _encode_pieces(pieces, t, lengths, memory)
    n_ids = count[index]
    ids = flat[np.repeat(first[index] - np.concatenate(([0], np.cumsum(n_ids)[:-1])), n_ids) + np.arange(n_ids.sum())] if len(index) else flat[:0]
    upto = np.concatenate(([0], np.cumsum(n_ids)))[starts_of]
    counts = np.diff(upto)
    if odd:
        parts = [odd[x] if x in odd else ids[upto[i] : upto[i + 1]] for i, x in enumerate(texts)]
        counts = np.array([len(p) for p in parts], np.int64)
        ids = np.concatenate(parts)
    return ids, counts


def _distinct_pieces(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(piece number of each piece in order, where each text's pieces begin in that order, distinct pieces)."""
    data = b"".join(raw)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    gap = np.isin(np.frombuffer(data, np.uint8), (10, 32))
    cut = gap & ~np.concatenate(([False], gap[:-1])) if data else gap
    cut[bounds[bounds < len(data)]] = True
    starts = np.flatnonzero(cut)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), np.searchsorted(starts, bounds), coded.dictionary.to_pylist()


def _encode_pieces(pieces: list[bytes], t, lengths: np.ndarray, memory: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the distinct pieces one after another, where each piece's begin, how many it has)."""
    coded = list(map(memory.get, pieces))
    new = [i for i, c in enumerate(coded) if c is None]
    gaps = b" \n"
    joined = [i for i in new if pieces[i][0] in gaps and pieces[i][-1] not in gaps]
    alone = [i for i in new if pieces[i][0] not in gaps or pieces[i][-1] in gaps]
    runs = [joined[i : i + RUN] for i in range(0, len(joined), RUN)]
    for run, e in zip(runs, t.encode_batch_fast([b"".join(map(pieces.__getitem__, r)).decode() for r in runs], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, np.uint32)
        ends = np.cumsum([len(pieces[i]) for i in run])
        upto = np.cumsum(lengths[ids])
        last = np.searchsorted(upto, ends)
        if not np.array_equal(upto[last], ends):
            raise ValueError("the vocabulary joins pieces across white space")
        raw, at = ids.tobytes(), 0
        for i, end in zip(run, ((last + 1) * 4).tolist(), strict=True):
            coded[i] = raw[at:end]
            at = end
    for i, e in zip(alone, t.encode_batch_fast([pieces[i].decode() for i in alone], add_special_tokens=False), strict=True):
        coded[i] = np.array(e.ids, np.uint32).tobytes()
    for i in new[: max(0, MEMORY - len(memory))]:
        if len(pieces[i]) < 64:
            memory[pieces[i]] = coded[i]
    count = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    return np.frombuffer(b"".join(coded), np.uint32), np.cumsum(count) - count, count
