"""Byte-level BPE ids of many texts, encoding each distinct piece once.

The vocabulary's pre-tokenization rule (contractions, runs of letters, digits,
other signs or white space, one space in front of a run) is evaluated on arrays
of code points; pieces are hashed with 64 bits, and only pieces not met before
by the worker are encoded. The ids equal those of the tokenizer file with
special-token strings read as ordinary text (tests compare them).
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np

from tabprobe.llm.words import _INV, _BASE, mix

CHUNK_CHARS = 1 << 20
CACHE_PIECES = 400_000  # distinct pieces remembered by a worker; then it starts anew

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: Unicode White_Space (fixed values)
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    t[_WHITE] = _SPACE
    return t


class PieceEncoder:
    """Ids of texts under one byte-level BPE vocabulary (ranks file)."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.token_bytes[i] = len(piece)
        self.classes = _classes()
        self.values = mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x1234567)) | np.uint64(1)
        n = 2 * CHUNK_CHARS
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            setattr(self, name, np.cumprod(p, dtype=np.uint64))
        self._reset()

    def _reset(self):
        self.keys = np.zeros(0, np.uint64)  # sorted piece hashes and their slots
        self.slots = np.zeros(0, np.int64)
        self.off = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _pieces(self, cp: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """True where a piece starts. rows: first code point of each text."""
        c = self.classes[cp]
        n = len(cp)
        first = np.zeros(n + 1, bool)
        first[rows] = True
        first[n] = True
        start = np.ones(n, bool)
        start[1:] = c[1:] != c[:-1]
        start |= first[:n]
        space = c == _SPACE
        before_run = np.zeros(n, bool)  # the last white space in front of a run
        before_run[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        start |= before_run
        joined = np.flatnonzero(before_run & (cp == 0x20)) + 1
        start[joined] = False
        quote = np.flatnonzero((cp == 0x27) & start)
        quote = quote[(quote + 1 < n)]
        quote = quote[(c[quote + 1] == _LETTER) & ~first[quote + 1]]
        if len(quote):
            a = cp[quote + 1]
            b = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for q, size in ((quote[one], 1), (quote[two], 2)):
                start[q + 1] = False
                after = q + 1 + size
                after = after[after < n]
                start[after] |= (c[after] == _LETTER)
        return start

    def _join(self, cp, starts, sizes, glue: bool):
        """The spans' characters in a row as one string, a line feed after each if asked."""
        width = sizes + glue
        done = np.cumsum(width)
        idx = np.repeat(starts - (done - width), width) + np.arange(done[-1])
        out = cp[np.minimum(idx, len(cp) - 1)]
        if glue:
            out[done - 1] = 0x0A
        return out.tobytes().decode("utf-32-le", "surrogatepass")

    def _encode_new(self, cp, starts, ends):
        """Token ids of spans, many spans a call: (order of the spans, ids, ids per span).

        Spans that begin with one space and a sign after it keep their bounds
        when put side by side; those that begin with no white space keep them
        with line feeds between; the rest is encoded one by one."""
        sizes = ends - starts
        head = self.classes[cp[starts]]
        second = self.classes[cp[np.minimum(starts + 1, len(cp) - 1)]]
        spaced = (cp[starts] == 0x20) & (sizes > 1) & (second != _SPACE)
        plain = head != _SPACE
        width = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000))])
        order, ids, counts = [], [], []
        for mask, glue in ((spaced, 0), (plain, 1)):
            at = np.flatnonzero(mask)
            if not len(at):
                continue
            got = np.array(self.encoding.encode_ordinary(self._join(cp, starts[at], sizes[at], bool(glue))), np.uint32)
            stop = np.cumsum(self.token_bytes[got])
            size = width[ends[at]] - width[starts[at]] + glue
            hi = np.searchsorted(stop, np.cumsum(size), side="right")
            n = np.diff(hi, prepend=0)
            if glue:
                keep = np.ones(len(got), bool)
                keep[hi - 1] = False
                got, n = got[keep], n - 1
            order.append(at)
            ids.append(got)
            counts.append(n)
        for i in np.flatnonzero(~spaced & ~plain).tolist():
            text = cp[starts[i]:ends[i]].tobytes().decode("utf-32-le", "surrogatepass")
            got = np.array(self.encoding.encode_ordinary(text), np.uint32)
            order.append(np.array([i]))
            ids.append(got)
            counts.append(np.array([len(got)]))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(counts)

    def _chunk(self, texts: list[str]):
        """(ids of all texts in a row, ids per text) for about CHUNK_CHARS."""
        lens = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        rows = np.concatenate([[0], np.cumsum(lens)])
        starts = np.flatnonzero(self._pieces(cp, rows[:-1][lens > 0]))
        ends = np.append(starts[1:], len(cp))
        s = np.empty(len(cp) + 1, np.uint64)
        s[0] = 0
        if len(self.up) < len(cp):
            raise ValueError("piece longer than a chunk")
        np.cumsum(self.values[cp] * self.up[:len(cp)], out=s[1:])
        h = mix((s[ends] - s[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES:
            self._reset()
        where = np.searchsorted(self.keys, uniq)
        near = np.minimum(where, max(len(self.keys) - 1, 0))
        known = self.keys[near] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        slots = np.where(known, self.slots[near] if len(self.keys) else 0, -1)
        new = np.flatnonzero(~known)
        if len(new):
            order, ids, counts = self._encode_new(cp, starts[at[new]], ends[at[new]])
            base = len(self.off) - 1
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids])
            slots[new[order]] = base + np.arange(len(new))
            self.slots = np.insert(self.slots, where[new], slots[new])
            self.keys = np.insert(self.keys, where[new], uniq[new])
        piece = slots[inv]
        cnt = self.off[piece + 1] - self.off[piece]
        done = np.concatenate([[0], np.cumsum(cnt)])
        idx = np.repeat(self.off[piece] - done[:-1], cnt) + np.arange(done[-1])
        return self.ids[idx], np.diff(done[np.searchsorted(starts, rows, side="left")])

    def _segments(self, text: str):
        """A long text in parts that begin with a single space before a run, where
        the rule starts a piece in any case. A run without such a place in a
        chunk's length goes to the library's encoder."""
        at = 0
        while len(text) - at > CHUNK_CHARS:
            cut = text.find(" ", at + CHUNK_CHARS // 2, at + CHUNK_CHARS)
            while cut > 0 and not (text[cut - 1].isalnum() and text[cut + 1:cut + 2].isalnum()):
                cut = text.find(" ", cut + 1, at + CHUNK_CHARS)
            if cut < 0:
                yield text[at:], True
                return
            yield text[at:cut], False
            at = cut
        yield text[at:], False

    def encode(self, texts: list[str]):
        """(ids of all texts in a row, ids per text)."""
        out, counts = [], []
        group: list[str] = []
        size = 0

        def flush():
            nonlocal group, size
            if group:
                ids, n = self._chunk(group)
                out.append(ids)
                counts.append(n)
                group, size = [], 0

        for t in texts:
            if size + len(t) > CHUNK_CHARS:
                flush()
            if len(t) <= CHUNK_CHARS:
                group.append(t)
                size += len(t)
                continue
            total = 0
            for part, plain in self._segments(t):
                ids = np.array(self.encoding.encode_ordinary(part), np.uint32) if plain else self._chunk([part])[0]
                out.append(ids)
                total += len(ids)
            counts.append(np.array([total]))
        flush()
        if not out:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        return np.concatenate(out), np.concatenate(counts)


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(ranks_path: str, pattern: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary (made once per Python worker)."""
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(ranks_path, pattern)
    return _ENCODERS[key]
