"""Whole texts to token ids with a published vocabulary, through the ``tokenizers`` library.

The byte-level pre-tokenizer never joins text across a single space or line end that stands between
two characters that are not white space: its pattern opens a new pre-token at such a space, and makes
such a line end one of its own.  Nor does it join letters with closing marks.  Texts are cut there, every distinct piece is encoded once by the library, and documents are put together
from the pieces' ids.  The ids are those of the whole text (see tests/llm/test_tokens.py); only
repeated pieces are not encoded again.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import trim

#: Distinct pieces kept between batches of a worker; then those that were used once go, so memory stays bounded (some 200 bytes each).
MAX_PIECES = 400_000
#: Those that a worker keeps between tasks, in which other stages need the memory.
REST_PIECES = 100_000
#: Bytes of text to encode in one call: its work space is some 20 times as large.
BLOCK = 2 << 20
#: New pieces that are encoded in one call.
GROUP = 2048
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s|^\s|\s\Z")
#: Marks that may close a word; after a letter, the pre-tokenizer cuts before a run of them.
_CLOSING = ".,!*$%&#?;:)"
_WHITE = re.compile(r"\s")
_OTHER_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_MADE: dict[str, "Encoder"] = {}


def _odd(text: str) -> bool:
    """Whether a space or line end has white space beside it, or ends the text."""
    if any(c in text for c in _OTHER_WHITE):
        return _ODD.search(text) is not None
    return text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text


class _Index(dict):
    """piece -> number; a new piece gets the next one and waits in one of the lists to be encoded.

    A piece is a word after a space; one NUL before it marks the first word of a line, two NULs mark text that
    stands alone.  A word with closing marks waits in ``joined`` to be put together from the two.
    """

    def __init__(self):
        self.words: tuple[list[str], list[int]] = ([], [])
        self.firsts: tuple[list[str], list[int]] = ([], [])
        self.others: tuple[list[str], list[int]] = ([], [])
        self.joined: list[tuple[int, int, int]] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        stem = piece.rstrip(_CLOSING)
        if len(stem) < len(piece) and stem and stem[-1].isalpha():
            self.joined.append((n, self[stem], self["\0\0" + piece[len(stem) :]]))
            return n
        if not piece or piece[0] != "\0":
            to = self.words
        elif piece[1:2] != "\0":
            to = self.firsts
            piece = piece[1:]
        else:
            to = self.others
            piece = piece[2:]
        to[0].append(piece)
        to[1].append(n)
        return n


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        # byte-level vocabularies write each byte as one character
        self.n_bytes = np.zeros(self.tok.get_vocab_size(), np.int64)
        for piece, i in self.tok.get_vocab().items():
            self.n_bytes[i] = len(piece)
        self._clear()

    def _clear(self) -> None:
        self.index, self.used = _Index(), 0
        self.ids, self.starts, self.lens = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.uses = np.zeros(1 << 14, np.int32)

    def rest(self) -> None:
        """At the end of a task: only the pieces used most often are kept, the memory of the others is given back."""
        if len(self.index) > REST_PIECES:
            self._shrink(REST_PIECES)
        trim()

    def _shrink(self, most: int) -> None:
        """Keeps the pieces used more often than once, or than what leaves at most so many; later uses weigh more."""
        n, least = len(self.index), 2
        while (keep := self.uses[:n] >= least).sum() > most:
            least *= 2
        at = np.flatnonzero(keep)
        ids, bounds = self._gather(at)
        lens, uses = self.lens[at], self.uses[at] // 2
        names = [p for p, k in zip(self.index, keep.tolist(), strict=True) if k]
        self._clear()
        for p in names:
            self.index[p] = len(self.index)
        self._add(np.arange(len(names)), ids, lens)
        self.uses[: len(names)] = uses

    def _add(self, at, ids: np.ndarray, lens: np.ndarray) -> None:
        """The pieces numbered ``at`` have these ids, one piece's after another's."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.index) > len(self.starts):
            self.starts, self.lens, self.uses = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lens, self.uses))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at] = self.used + np.cumsum(lens) - lens
        self.lens[at] = lens
        self.used += len(ids)

    def _group(self, names: list[str], at: list[int], first: bool) -> None:
        """Pieces without spaces and line ends, encoded as one text; the ids' byte lengths tell where each piece ends."""
        mark = "\n" if first else " "
        text = mark.join(names) + mark if first else mark + mark.join(names)
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == ord(mark))
        got = np.cumsum(self.n_bytes[ids])
        want = marks + 1 if first else np.append(marks[1:], got[-1])
        ends = np.searchsorted(got, want) + 1
        assert len(ends) == len(names) and (got[ends - 1] == want).all(), "a token crosses a piece"
        lens = np.diff(ends, prepend=0)
        if first:  # without the line ends
            assert (got[ends - 2] == want - 1).all(), "a token crosses a line end"
            ids, lens = np.delete(ids, ends - 1), lens - 1
        self._add(at, ids, lens)

    def _learn(self) -> None:
        new = self.index
        for (names, at), first in ((new.words, False), (new.firsts, True)):
            for k in range(0, len(names), GROUP):
                self._group(names[k : k + GROUP], at[k : k + GROUP], first)
            names.clear()
            at.clear()
        for piece, k in zip(*new.others, strict=True):
            ids = self.tok.encode(piece, add_special_tokens=False).ids
            self._add([k], np.array(ids, np.uint32), np.array([len(ids)]))
        new.others[0].clear()
        new.others[1].clear()
        if new.joined:
            n, stem, tail = np.array(new.joined).T
            new.joined = []
            ids, _ = self._gather(np.stack([stem, tail], 1).ravel())
            self._add(n, ids, self.lens[stem] + self.lens[tail])

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after another, their bounds)."""
        lens = self.lens[which]
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens, dtype=np.int64)])
        return self.ids[np.repeat(self.starts[which] - bounds[:-1], lens) + np.arange(bounds[-1])], bounds

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, document bounds as int64); null texts are empty; ``end_id`` closes each document."""
        if len(self.index) > MAX_PIECES:
            self._shrink(MAX_PIECES // 2)
        look, long = self.index.__getitem__, False
        plain = [bool(t) and "\0" not in t and not _odd(t) for t in texts]
        split = pc.split_pattern(pa.array(["\0" + t.replace("\n", " \0\0\n \0") for t, ok in zip(texts, plain, strict=True) if ok], pa.string()), " ")
        coded = split.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        long = any(len(n) > 65536 for n in names)
        numbers = np.fromiter(map(look, names), np.int64, len(names))
        which, ends = numbers[coded.indices.to_numpy()], iter(split.offsets.to_numpy().tolist())
        parts, at = [], next(ends, 0)
        for text, ok in zip(texts, plain, strict=True):
            if ok:
                end = next(ends)
                parts.append(which[at:end])
                at = end
            elif not text:
                parts.append(np.zeros(0, np.int64))
            elif "\0" in text:  # it would look like our marks; such a text stays whole
                parts.append(np.array([look("\0\0" + text)]))
                long |= len(text) > 65536
            else:
                pieces = _CUT.split(text)
                parts.append(np.array([look("\0\0" + pieces[0]), *(look("\0\0 " + p if _WHITE.search(p) else p) for p in pieces[1:])]))
                long |= any(len(p) > 65536 for p in pieces)
        self._learn()
        which = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ids, bounds = self._gather(which)
        n = len(self.index)
        self.uses[:n] += np.bincount(which, minlength=n).astype(np.int32)
        doc = bounds[np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])]
        if long:  # huge pieces aren't kept
            self._clear()
        if end_id is None:
            return ids, doc
        return np.insert(ids, doc[1:], np.uint32(end_id)), doc + np.arange(len(doc))


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    return _MADE[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
