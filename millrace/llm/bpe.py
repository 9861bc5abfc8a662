"""Exact byte-level BPE ids, with each distinct pre-token encoded once per worker.

A byte-level BPE cuts a text into pre-tokens and merges inside each alone, so
the ids of a text are those of its pre-tokens in turn. Texts in which the cut
is beyond doubt (printable Latin characters, no special string) are cut here
and their pre-tokens looked up; every other text goes to the library whole.
New pre-tokens go to the library many at a time, behind marks that merge with
nothing, so that a call costs little more than its merges.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np

#: Characters that a text may hold to be cut here; no Unicode version moves their classes.
_LATIN = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)) if c != 0xAD]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == kind)


#: The byte-level pre-tokeniser's pattern, over the characters above.
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_class('L')}]+| ?[{_class('N')}]+| ?[^\s{_class('L')}{_class('N')}]+|\s+(?!\S)|\s+"
_PIECES = re.compile(_PATTERN).findall
_PLAIN = re.compile(f"[{''.join(map(re.escape, _LATIN))}]*").fullmatch


def _byte_letters() -> list[str]:
    """The letters that byte-level vocabularies are spelt with.

    Printable bytes stand for themselves, the others for the characters from
    256 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


#: Bytes that UTF-8 has no use for.
_UNUSED = (0xFF, 0xFE, *range(0xF5, 0xFE), 0xC0, 0xC1)
#: Pre-tokens that are spelt as one string; more make its merges dearer, fewer the calls.
_GROUP = 32


def _mark(model: dict) -> tuple[str, int] | None:
    """A letter that merges with nothing, and its id; none if pieces side by side could depend on each other."""
    plain = model["type"] == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    merged = set().union(*("".join(m) for m in model["merges"])) if plain else set()
    letters = _byte_letters()
    return next(((x, model["vocab"][x]) for b in _UNUSED if plain and (x := letters[b]) in model["vocab"] and x not in merged), None)


_encoders: dict[str, "PieceEncoder"] = {}


def encoder(path: str, memo_entries: int = 200_000) -> "PieceEncoder":
    """The worker's encoder of this vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    _encoders[path].memo_entries = memo_entries
    return _encoders[path]


class PieceEncoder:
    """Encodes texts through the tokenizers library, memoising pre-tokens.

    ``memo_entries`` bounds the memo, in which every 64 characters are an entry more:
    what is past it after a call goes, and the memo starts anew.
    """

    def __init__(self, path: str, memo_entries: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo_entries = memo_entries
        #: the number of each piece, in the order in which they were met
        self.known: defaultdict[str, int] = defaultdict()
        self._forget()
        model = json.loads(self.tokenizer.to_str())
        cut = model["pre_tokenizer"] or {}
        self.cuts = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
            and not model["normalizer"] and not model["post_processor"]
        )
        self.special = [x["content"] for x in model["added_tokens"]]
        #: the same model without a pre-tokeniser, for pieces that are cut already
        self.merges = Tokenizer(self.tokenizer.model)
        self.mark = _mark(model["model"])
        if self.mark:
            # bytes 0 and 1, which no piece has, open a piece and end a group
            spell = [ord(x) for x in _byte_letters()]
            self.spell = np.array([ord(self.mark[0]), 1, *spell[2:]], dtype="<u4")

    def _forget(self) -> None:
        self.known.clear()
        self.known.default_factory = count().__next__
        #: the ids of all known pieces in turn, and where each piece's begin
        self.ids, self.begins = array("I"), array("q", [0])
        self.held = 0

    def _encode(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _learn(self, pieces: list[str]) -> None:
        """Takes the ids of new pieces, which have their numbers already."""
        if self.mark:
            groups = ("\0" + "\0".join(pieces[i : i + _GROUP]) for i in range(0, len(pieces), _GROUP))
            spelt = self.spell[np.frombuffer("\1".join(groups).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\1")
            found = self.merges.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(found[0].ids, dtype=np.uint32)
            marks = ids == self.mark[1]
            ends = np.append(np.flatnonzero(marks)[1:], len(ids)) - np.arange(1, len(pieces) + 1)
            ids = ids[~marks]
        else:
            each = self._encode(pieces)
            ids, ends = np.frombuffer(b"".join(each), np.uint32), np.cumsum([len(x) // 4 for x in each])
        self.begins.frombytes((len(self.ids) + ends).astype(np.int64).tobytes())
        self.ids.frombytes(ids.tobytes())
        self.held += len(pieces) + sum(map(len, pieces)) // 64

    def _look_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each text's pieces in turn."""
        known, first = self.known, len(self.known)
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.intp, sum(map(len, texts)))
        if len(known) > first:
            self._learn(list(islice(reversed(known), len(known) - first))[::-1])
        begins, ids = np.frombuffer(self.begins, np.int64), np.frombuffer(self.ids, np.uint32)
        starts = begins[at]
        sizes = begins[at + 1] - starts
        ends = np.append(0, np.cumsum(sizes))
        flat = ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
        return np.split(flat, ends[np.cumsum([len(p) for p in texts])[:-1]])

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, exactly as the library gives them for the whole."""
        split: list[list[str] | None] = [
            _PIECES(t) if self.cuts and _PLAIN(t) and not any(s in t for s in self.special) else None
            for t in texts
        ]
        whole = iter(self._encode([t for t, p in zip(texts, split) if p is None]))
        cut = [p for p in split if p is not None]
        try:
            looked_up = iter(self._look_up(cut) if cut else ())
        except BaseException:
            self._forget()  # pieces that have a number but no ids
            raise
        out = [np.frombuffer(next(whole), dtype="<u4") if p is None else next(looked_up) for p in split]
        if self.held > self.memo_entries:
            self._forget()
        return out
