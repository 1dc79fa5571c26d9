"""Byte-level BPE by the tokenizers library over Arrow batches.

Text is split where a single space or line end stands between other characters: no match of a
byte-level pattern reaches over such a place, so the parts can be encoded apart and their
ids remembered. New parts go to the tokenizers library as texts of many such parts; the bytes of
the tokens tell where each part's ids end. When the memory of parts is full, those that were used
once are forgotten, so common parts go there once per worker.
"""

from __future__ import annotations

import base64
import os
import re
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

from canopy.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts remembered in a worker before it forgets those that were used once: some 90 MB.
REMEMBER = 400_000
#: Seconds without work after which a worker forgets them.
IDLE = 2.0
#: A part that can be encoded in a text with others like it: no white space but perhaps one space before it.
WORD = re.compile(r" ?[!-~À-ÖØ-öø-ɏ]+")
#: So many of them at once.
TOGETHER = 20_000
#: White space that is not a lone space or line end between other characters.
ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]|\s\s|\A\s|\s\Z")


def byte_table() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """For each token of two or more bytes the two tokens it is merged from, in the order of ranks."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            joined = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(joined)
            if best >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def from_ranks(path: str, pattern: str):
    """A tokenizer of the tokenizers library with the vocabulary and merge order of a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_table()
    shown = lambda token: "".join(table[b] for b in token)
    tok = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges_of(ranks)], ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


def from_json(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


class Parts(dict):
    """Numbers parts as they are first asked for."""

    def __init__(self, log: list[str], before: str) -> None:
        super().__init__()
        self.log, self.before = log, before

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self.log)
        self.log.append(self.before + part)
        return n


class Encoder:
    """Encodes texts to ids; keeps the ids of parts."""

    def __init__(self, tok) -> None:
        self.tok, self.size = tok, Bytes(tok).size
        self.fresh()

    def fresh(self) -> None:
        self.log: list[str] = []
        self.alone, self.spaced = Parts(self.log, ""), Parts(self.log, " ")
        self.learned = 0
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros((1 << 18) + 1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def weed(self) -> None:
        """Forget parts that were used once lately, or more of the rare ones until half the room is free."""
        least = 2
        while np.count_nonzero(self.uses >= least) > REMEMBER // 2:
            least *= 2
        keep = self.uses >= least
        size = np.diff(self.ends[: self.learned + 1])
        ids, ends = self.ids[: self.ends[self.learned]][np.repeat(keep, size)], np.cumsum(size[keep])
        uses, number, old = self.uses[keep] // 2, np.where(keep, np.cumsum(keep) - 1, -1).tolist(), (self.alone, self.spaced)
        self.fresh()
        self.log += [""] * len(ends)
        for new, before in zip((self.alone, self.spaced), old, strict=True):
            new.update((part, number[n]) for part, n in before.items() if number[n] >= 0)
        self.learned, self.uses = len(ends), uses
        self.reserve(len(ends), len(ids))
        self.ids[: len(ids)], self.ends[1 : len(ends) + 1] = ids, ends

    def reserve(self, parts: int, ids: int) -> None:
        while parts + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def joined(self, parts: list[str]) -> list[np.ndarray] | None:
        """The ids of each of these words, encoded as one text; None if a token reaches over their bounds."""
        bare = np.array([p[0] != " " for p in parts])
        bare[0] = False
        ids = np.array(self.tok.encode_batch_fast(["".join([p if p[0] == " " else "\n" + p for p in parts]).removeprefix("\n")], add_special_tokens=False)[0].ids, np.uint32)
        size = np.array([len(p.encode()) for p in parts])
        at = np.concatenate([[0], np.cumsum(self.size[ids])])
        ends = np.cumsum(size + bare)
        lo, hi = np.searchsorted(at, ends - size), np.searchsorted(at, ends)
        if at[-1] != ends[-1] or (at[lo] != ends - size).any() or (at[hi] != ends).any():
            return None
        return [ids[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]

    def learn(self) -> None:
        """Encode the parts that were numbered since the last time."""
        parts = self.log[self.learned :]
        got: list = [None] * len(parts)
        words = [k for k, p in enumerate(parts) if WORD.fullmatch(p)]
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            for i, ids in zip(some, self.joined([parts[i] for i in some]) or (), strict=False):
                got[i] = ids
        others = [i for i, ids in enumerate(got) if ids is None]
        for i, e in zip(others, self.tok.encode_batch_fast([parts[i] for i in others], add_special_tokens=False), strict=True):
            got[i] = np.array(e.ids, np.uint32)
        n, at = self.learned, int(self.ends[self.learned])
        ends = at + np.cumsum([len(x) for x in got])
        self.reserve(n + len(got), int(ends[-1]))
        self.ids[at : ends[-1]] = np.concatenate(got)
        self.ends[n + 1 : n + 1 + len(got)] = ends
        self.log[n:] = [""] * len(got)
        self.learned += len(got)

    def split(self, text: str, out: list[int]) -> None:
        """Append the numbers of parts whose ids, one after the other, are the text's."""
        if (not text.replace("\n", "").isprintable() and ODD_SPACE.search(text)) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            first, *rest = re.split(r"(?<=[!-~]) (?=[!-~])", text)
            out.append(self.alone[first])
            out.extend(map(self.spaced.__getitem__, rest))
            return
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.alone["\n"])
            if line:
                first, *rest = line.split(" ")
                out.append(self.alone[first])
                out.extend(map(self.spaced.__getitem__, rest))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end: (ids, offsets)."""
        if len(self.log) > REMEMBER:
            self.weed()
        numbers: list[int] = []
        ends = [0]
        for x in texts:
            if x:
                self.split(x, numbers)
            ends.append(len(numbers))
        if self.learned < len(self.log):
            self.learn()
            self.uses = np.concatenate([self.uses, np.zeros(self.learned - len(self.uses), np.int64)])
        which = np.array(numbers, np.int64)
        self.uses += np.bincount(which, minlength=self.learned)
        begin, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        off = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - off[:-1], size) + np.arange(off[-1])]
        return ids, off[np.array(ends)]


class Bytes:
    """The bytes of each id, for decoding: reverses the byte table."""

    def __init__(self, tok) -> None:
        back = {c: b for b, c in enumerate(byte_table())}
        vocab = tok.get_vocab(with_added_tokens=False)
        words = [b""] * (max(vocab.values()) + 1)
        for shown, i in vocab.items():
            words[i] = bytes(back[c] for c in shown)
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.flat = np.frombuffer(b"".join(words), np.uint8)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each text's begin and end."""
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.flat[np.repeat(self.start[ids] - at[:-1], size) + np.arange(at[-1])] if len(ids) else np.zeros(0, np.uint8)
        return data, at[off]


def char_spans(data: np.ndarray, byte_ends: np.ndarray) -> np.ndarray:
    """Character positions of byte positions: how many characters begin before each."""
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return begins[byte_ends]


_ENCODERS: dict[tuple, Encoder] = {}
_LOCK = threading.Lock()
_lent, _ended = 0, 0.0


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """This worker's encoder for a vocabulary file: .json as it is, ranks with their pattern."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(from_ranks(path, pattern) if pattern else from_json(path))
    return _ENCODERS[key]


@contextmanager
def lent(path: str, pattern: str | None = None) -> Iterator[Encoder]:
    """An encoder for the length of a task.

    The next task of the same kind finds the parts that this one has learned; a worker that gets
    none of them soon forgets them, so that they do not lie beside what other operators need.
    """
    global _lent, _ended
    with _LOCK:
        _lent += 1
        own = encoder(path, pattern)
    try:
        yield own
    finally:
        with _LOCK:
            _lent, _ended = _lent - 1, time.monotonic()
        later = threading.Timer(IDLE, _forget)
        later.daemon = True
        later.start()


def _forget() -> None:
    with _LOCK:
        if not _lent and time.monotonic() - _ended > 0.9 * IDLE:
            for x in _ENCODERS.values():
                x.fresh()
            common.trim()
