"""Lists of personal names as one automaton over tokens, in a file that the workers of a machine map together.

The automaton is a trie: its edges are (state, token), its tokens are spelt without marks or with umlauts written out, and a
state that ends an entry names the entry of each list. All of it lies in sorted arrays, so a worker opens a file instead of
building dictionaries, and pages that no text asks for are never read.
"""

from __future__ import annotations

import functools
import io
import json
import unicodedata
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..catalog import scratch_dir

MIN_LETTERS = 3
TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: What may stand between two words of one name, words before a name that make it one, and how far before it
#: they may begin; how umlauts are written out.
JOIN = regex.compile(r"[\s'’\-]{1,3}")
HONORIFICS = ("herr", "frau", "hr.", "mr.", "fr.", "m.", "mme", "mme.", "mlle", "mlle.", "monsieur", "madame", "signor", "signora", "sig.", "sig.ra")
HONORIFIC_REACH = 24
_WRITTEN_OUT = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue"})
_BEFORE = regex.compile(r"(\S+)\s+\Z")
_MAGIC = b"GWNAMES1"
LISTS = ("first", "last", "white")
#: Tokens whose lookup a worker remembers.
REMEMBERED = 200_000
#: The most spellings that are looked for one by one in a text before Python; longer lists have a Bloom filter.
FEW_SPELLINGS = 50
#: Of the Bloom filter: bits and probes for a spelling (one token in 5000 passes by chance), and the most spellings for
#: which there is one; the bits are part of the plan.
BITS, PROBES, MOST_SPELLINGS = 32, 4, 1_000_000


@functools.lru_cache(maxsize=65_536)
def spellings(token: str) -> tuple[str, str]:
    """(without marks, with umlauts written out), both case folded."""
    plain = lambda s: s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn")
    folded = token.casefold()
    return plain(folded), folded if folded.isascii() else plain(unicodedata.normalize("NFC", token).casefold().translate(_WRITTEN_OUT))


def entry_key(entry: str) -> str:
    return " ".join(spellings(t)[1] for t in TOKEN.findall(entry))


class Match(NamedTuple):
    """Tokens ``at`` to ``at + width`` are an entry of the first names, of the last names, or of both."""

    at: int
    width: int
    first: str | None
    last: str | None


def _heads(values: Sequence[bytes]) -> np.ndarray:
    """The first eight bytes of each string as a number, in the order of the strings."""
    return np.array([int.from_bytes(v[:8].ljust(8, b"\0"), "big") for v in values], np.uint64)


class _Strings:
    """Sorted distinct strings in one run of bytes; their heads find most of them, and most that are not among them."""

    def __init__(self, blob: np.ndarray, ends: np.ndarray, heads: np.ndarray | None = None):
        self.blob, self.ends, self.heads = blob, ends, heads

    def __getitem__(self, k: int) -> bytes:
        return self.blob[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes()

    def find(self, wanted: bytes) -> int:
        head = np.uint64(int.from_bytes(wanted[:8].ljust(8, b"\0"), "big"))
        low = int(self.heads.searchsorted(head))
        if low == len(self.heads) or self.heads[low] != head:
            return -1
        high = int(self.heads.searchsorted(head, "right"))
        while low < high:
            mid = (low + high) // 2
            if self[mid] < wanted:
                low = mid + 1
            else:
                high = mid
        return low if low < len(self.ends) and self[low] == wanted else -1

    @staticmethod
    def of(values: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(values), np.uint8), np.cumsum([len(v) for v in values]).astype(np.int64)


class NameIndex:
    """First names, last names and a whitelist; an entry with fewer than MIN_LETTERS letters is left out."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.tokens, self.keys = _Strings(arrays["token_blob"], arrays["token_ends"], arrays["token_heads"]), _Strings(arrays["key_blob"], arrays["key_ends"])
        self.edges, self.targets = arrays["edges"], arrays["targets"]
        self.ends = [arrays[k] for k in LISTS]
        self.longest = int(arrays["longest"][0]) if len(arrays["longest"]) else 0
        self._known: dict[str, tuple[int, int, bool]] = {}

    @classmethod
    def build(cls, firstnames: Iterable[str], lastnames: Iterable[str], whitelist: Iterable[str]) -> NameIndex:
        paths: list[dict[str, str]] = []  # of each list: a spelling of an entry to the entry's key
        for entries in (firstnames, lastnames, whitelist):
            keys: dict[str, str] = {}
            for e in entries:
                spelt = [spellings(t) for t in TOKEN.findall(e)]
                if sum(len(a) for a, _ in spelt) >= MIN_LETTERS:
                    key = " ".join(b for _, b in spelt)
                    keys.setdefault(" ".join(a for a, _ in spelt), key)
                    keys.setdefault(key, key)
            paths.append(keys)
        split = {p: p.split(" ") for keys in paths for p in keys}
        tokens = sorted({t.encode() for ts in split.values() for t in ts})
        token_id = {t: k for k, t in enumerate(tokens)}
        keys = sorted({k.encode() for each in paths for k in each.values()})
        key_id = {k: i for i, k in enumerate(keys)}
        states: dict[tuple[int, int], int] = {}
        ends: list[list[int]] = [[-1] * 3]
        for which, each in enumerate(paths):
            for path, key in each.items():
                state = 0
                for t in split[path]:
                    edge = (state, token_id[t.encode()])
                    if edge not in states:
                        states[edge] = len(ends)
                        ends.append([-1] * 3)
                    state = states[edge]
                ends[state][which] = key_id[key.encode()]
        edges = np.array([s * max(len(tokens), 1) + t for s, t in states], np.int64)
        order = np.argsort(edges)
        arrays = {"edges": edges[order], "targets": np.array(list(states.values()), np.int32)[order]}
        arrays |= dict(zip(LISTS, np.array(ends, np.int32).T.copy(), strict=True))
        arrays["token_blob"], arrays["token_ends"] = _Strings.of(tokens)
        arrays["token_heads"] = _heads(tokens)
        arrays["key_blob"], arrays["key_ends"] = _Strings.of(keys)
        arrays["longest"] = np.array([max((len(split[p]) for k in (0, 1) for p in paths[k]), default=0)], np.int32)
        return cls(arrays)

    def to_bytes(self) -> bytes:
        out, head, at = io.BytesIO(), {}, 0
        for name, a in self.arrays.items():
            at += -at % 8
            head[name] = (a.dtype.str, at, len(a))
            at += a.nbytes
        raw = json.dumps(head).encode()
        raw += b" " * (-len(raw) % 8)
        out.write(_MAGIC + len(raw).to_bytes(8, "little") + raw)
        for a in self.arrays.values():
            out.write(b"\0" * (-out.tell() % 8))
            out.write(a.tobytes())
        return out.getvalue()

    @classmethod
    def open(cls, path: str) -> NameIndex:
        """Map the file; its pages are shared by all who map it."""
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError("not a file of names")
        size = int(raw[8:16].view("<u8")[0])
        start = 16 + size
        head = json.loads(raw[16:start].tobytes())
        return cls({name: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in head.items()})

    def _step(self, state: int, token: int) -> int:
        if state < 0 or token < 0:
            return -1
        edge = state * len(self.tokens.ends) + token
        at = int(np.searchsorted(self.edges, edge))
        return int(self.targets[at]) if at < len(self.edges) and self.edges[at] == edge else -1

    def _look_up(self, token: str) -> tuple[int, int, bool]:
        """(the token without marks, with umlauts written out, whether an entry begins with one of them); -1: no token."""
        found = self._known.get(token)
        if found is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            without, written_out = spellings(token)
            a = self.tokens.find(without.encode())
            b = a if written_out == without else self.tokens.find(written_out.encode())
            found = self._known[token] = (a, b, self._step(0, a) >= 0 or self._step(0, b) >= 0)
        return found

    def _ended(self, *states: int) -> list[str | None]:
        """The entry of each list that ends in one of these states, of the first that has one."""
        keys = (next((int(ends[s]) for s in states if s >= 0 and ends[s] >= 0), -1) for ends in self.ends)
        return [self.keys[k].decode() if k >= 0 else None for k in keys]

    def matches(self, text: str) -> tuple[list[Match], list[tuple[int, int]]]:
        """Entries in the text, the longest at each token, left to right, none over another; and the tokens' spans. An entry
        of the whitelist is passed over unless an honorific stands before it."""
        look = self._look_up
        leads = {t for t in set(TOKEN.findall(text)) if look(t)[2]}
        if not leads:
            return [], []
        spans = [m.span() for m in TOKEN.finditer(text)]
        begins = [k for k, (a, b) in enumerate(spans) if text[a:b] in leads]
        found, free = [], 0
        for at in begins:
            if at < free:
                continue
            written_out = without = 0
            best = None
            for k in range(at, min(at + self.longest, len(spans))):
                if k > at and not JOIN.fullmatch(text, spans[k - 1][1], spans[k][0]):
                    break
                a, b, _ = look(text[spans[k][0] : spans[k][1]])
                written_out, without = self._step(written_out, b), self._step(without, a)
                if written_out < 0 and without < 0:
                    break
                first, last, white = self._ended(written_out, without)
                if (first or last) and (not white or is_addressed(text, spans[at][0])):
                    best = Match(at, k + 1 - at, first, last)
            if best:
                found.append(best)
                free = at + best.width
        return found, spans

    def first_tokens(self) -> list[str]:
        """The spellings with which entries begin."""
        n = len(self.tokens.ends)
        return [self.tokens[int(e)].decode() for e in self.edges[: np.searchsorted(self.edges, n)]]


def is_addressed(text: str, start: int) -> bool:
    """Whether the word before ``start`` is an honorific, on its own or after a sign that is no letter and no full stop."""
    m = _BEFORE.search(text[:start][-HONORIFIC_REACH - 1 :])
    if not m:
        return False
    word, near = m[1].casefold(), max(0, start - HONORIFIC_REACH)
    begin = max(0, start - HONORIFIC_REACH - 1) + m.start(1)
    for h in HONORIFICS:
        at = begin + len(word) - len(h)
        if word.endswith(h) and at >= near and not (at and regex.match(r"[\p{L}\p{M}.]", text[at - 1])):
            return True
    return False


def tagged(matches: Sequence[Match], glued: Sequence[bool]) -> list[tuple[str, str]]:
    """(tag, entry) of each match; ``glued[k]`` tells whether match k + 1 follows match k at once.

    A match on one list is of that list. One on both is a first name before a glued last name, else a last name after a glued
    first name, else what the entry was when a text first left it open, else a name.
    """
    leads = [g and m.last is not None for g, m in zip(glued, matches[1:], strict=True)] + [False]
    out: list[tuple[str, str]] = []
    met: dict[str | None, tuple[str, str]] = {}
    for k, m in enumerate(matches):
        if m.first and (not m.last or leads[k]):
            verdict = ("Firstname", m.first)
        elif m.last and (not m.first or k and glued[k - 1] and out[-1][0] == "Firstname"):
            verdict = ("Lastname", m.last)
        else:
            verdict = met.get(m.last, ("Name", m.last))
        if m.first and m.last:
            met.setdefault(m.last, verdict)
        out.append(verdict)
    return out


def publish(spark: SparkSession, index: NameIndex, fingerprint: str) -> str:
    """Put the file of the lists where executors fetch it once each; its name, for ``SparkFiles.get``."""
    name = f"gleanworks-names-{fingerprint[:32]}.gwn"
    if name in {str(f).rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}:
        return name
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark, 'names')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(index.to_bytes())
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


# --- the filter before Python -------------------------------------------------------------------------------------

#: Letters of which the filter knows both spellings; a token with any other passes it.
_LATIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
_KNOWN_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_UNKNOWN_LETTER = r"[\p{L}\p{M}&&[^A-Za-zÀ-ÖØ-öø-ÿ]]"


def _may_hold_few(text: Column, first: list[str]) -> Column:
    """``may_hold_names`` for short lists: whole texts are spelt, and cut into tokens that meet the list."""
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    written = F.replace(F.replace(F.replace(low, F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue"))
    held = lambda spelt: F.exists(F.split(spelt, "[^a-z]+"), lambda t: t.isin(first))
    strip = lambda s: F.translate(s, _LATIN, _PLAIN)
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, held(F.lower(text))).when(text.rlike(_UNKNOWN_LETTER), F.lit(True)).otherwise(held(strip(low)) | held(strip(written)))


def may_hold_names(text: Column, index: NameIndex) -> Column | None:
    """Whether a text may hold an entry: no text that does is false. None where the lists are too long for a filter."""
    first = index.first_tokens()
    if len(first) > MOST_SPELLINGS:
        return None
    if len(first) <= FEW_SPELLINGS:
        return _may_hold_few(text, first)
    spark = SparkSession.active()
    n_bits = max(64, len(first) * BITS) // 64 * 64 + 64
    bits = np.zeros(n_bits, bool)
    if first:
        hashed = spark.createDataFrame([("\n".join(first),)], "t string").select(F.transform(F.split("t", "\n"), lambda t: F.xxhash64(t)))
        h = np.array(hashed.first()[0], np.int64).view(np.uint64)  # a number for each spelling
        for k in range(PROBES):
            bits[((h & np.uint64(0x7FFFFFFF)) + np.uint64(k) * (h >> np.uint64(33))) % np.uint64(n_bits)] = True
    words = np.packbits(bits, bitorder="little").view("<i8")
    table = F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>")

    def probed(h: Column) -> Column:
        found = F.lit(True)
        for k in range(PROBES):
            at = (h.bitwiseAND(F.lit(0x7FFFFFFF)) + k * F.shiftrightunsigned(h, 33)) % n_bits
            word = F.get(table, F.floor(at / 64).cast("int"))
            found = found & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) != 0)
        return found

    listed = lambda spelt: F.exists(F.array(F.xxhash64(spelt)), probed)

    def token(t: Column) -> Column:
        low = F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))
        written = F.replace(F.replace(F.replace(low, F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue"))
        strip = lambda s: F.translate(s, _LATIN, _PLAIN)
        ascii_only = F.octet_length(t) == F.length(t)
        return F.when(ascii_only, listed(F.lower(t))).when(t.rlike(_KNOWN_LETTERS), listed(strip(low)) | listed(strip(written))).otherwise(True)

    tokens = F.array_distinct(F.array_remove(F.split(text, r"[^\p{L}\p{M}]+"), ""))
    return F.exists(tokens, token)

