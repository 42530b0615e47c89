"""Token ids of whole texts by the tokenizers library, with a bounded per-worker cache of encoded words.

The tokenizers used here split every text before they merge: at a space or line break that stands before another
character, and between letters and the marks after them. So the ids of a text are the ids of such parts in a row.
Each worker numbers the parts it meets, has the library encode those that are new, and gathers the ids of a batch of
texts by number. Texts with other white space or control characters, on whose class Python and the library may differ,
are encoded whole.

A text that holds the string of a special token is encoded whole and gets that token's id, as by the library's plain call;
``literal`` encoders take such strings as ordinary text (``encode_special_tokens``), so that no document can write one.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np

#: White space that is read by the regular expression below, and characters that Python and the library may class differently.
CHUNK = re.compile(r"\s*\S+|\s+")
UNUSUAL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x80-\xa0\xad᠎  -‏ -  -⁯　﻿]")
RUNS = ("  ", " \n", "\n\n\n", "\n\n ", "\t", "\r")
#: A worker numbers this many parts before it starts anew.
CACHED_PARTS = 1_000_000
#: ASCII marks that start a piece of their own after a letter; not the apostrophe, which may belong to it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: How byte-level models write each byte: printable ones as they are, the rest from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
SPACE = chr(SHOWN[32])

_encoders: dict[tuple[str, bool, bool], "Encoder"] = {}


class Numbers(dict):
    """Number of each part, given at the first look-up; ``new`` lists the parts numbered since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.new.append(part)
        return n


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, keep_space: bool, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        names = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names)) or "(?!)", re.I)
        self.mark = re.match(r"[^A-Za-z]*", os.path.commonprefix(names))[0]  # in every text that holds one
        self.model = self.tokenizer.model
        self.keep_space = keep_space
        self.marks: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.ids, self.starts, self.sizes = Numbers(), array("I"), array("q"), array("q")

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tail(self, marks: str) -> list[int]:
        if marks not in self.marks:
            if len(self.marks) > 50_000:
                self.marks.clear()
            self.marks[marks] = self._direct([marks])[0]
        return self.marks[marks]

    def _shown(self, word: str) -> str | None:
        """Latin letters as the model's merges write them; they are one piece for it."""
        if word.isascii():
            return word if self.keep_space else word.lower()
        if max(word) >= "\u0370":
            return None
        if not self.keep_space:
            word = word.lower()
            if not word.isalpha():
                return None
        return word.encode().decode("latin-1").translate(SHOWN)

    def _learn(self) -> None:
        """Ids of the new parts. A part starts with ``\\r`` where no space stands before it, with ``\\n`` where a line break does."""
        new, found, rest = self.numbers.new, [], []
        known, number, model, shown, space = len(self.starts), self.numbers.get, self.model.tokenize, self._shown, self.keep_space
        for k, part in enumerate(new):
            ids, head = None, part.rstrip(MARKS)
            if head.isalpha():
                at = number(head, known) if len(head) < len(part) else known
                if at < known:
                    ids = self.ids[self.starts[at] : self.starts[at] + self.sizes[at]].tolist()
                elif (word := shown(head)) is not None:
                    ids = [t.id for t in model(SPACE + word if space else word)]
                if ids is not None and len(head) < len(part):
                    ids += self._tail(part[len(head) :])
            elif space and part[0] in "\r\n" and head[1:].isalpha() and (word := shown(head[1:])) is not None:
                ids = [t.id for t in model(word)]
                ids = self._tail("\n") + ids if part[0] == "\n" else ids
                if len(head) < len(part):
                    ids += self._tail(part[len(head) :])
            if ids is None:
                rest.append(k)
            found.append(ids)
        for at in range(0, len(rest), 20_000):
            own = rest[at : at + 20_000]
            for k, ids in zip(own, self._direct([self._literal(new[k]) for k in own]), strict=True):
                found[k] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts.frombytes((len(self.ids) + np.cumsum(sizes) - sizes).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.ids.extend(chain.from_iterable(found))
        new.clear()

    def _literal(self, part: str) -> str:
        if not self.keep_space or part[0] == "\n":
            return part
        return part[1:] if part[0] == "\r" else " " + part

    def parts(self, text: str) -> list[str]:
        """The parts of a text, as ``_learn`` reads them."""
        if not self.keep_space:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split()
            return text.lower().split()  # these characters have one lower-case form, whatever stands around them
        if text[-1:].isspace() or any(x in text for x in RUNS):
            return ["\r" + x for x in CHUNK.findall(text)]
        out = text.replace("\n", " \n").split(" ")
        if out[0]:
            out[0] = "\r" + out[0]
        else:
            del out[0]
        return out

    def encode(self, texts: Iterable[str], at_once: int = 2_000_000) -> list[bytes]:
        """at_once: characters of texts that are gathered together."""
        out: list[bytes] = []
        held: list[list[str] | str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if len(self.numbers) > CACHED_PARTS:
                self._forget()
            n = [len(x) for x in held if isinstance(x, list)]
            parts = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(x for x in held if isinstance(x, list))), np.int64, sum(n))
            self._learn()
            ids, starts, sizes = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.starts, np.int64)[parts], np.frombuffer(self.sizes, np.int64)[parts]
            ends = np.cumsum(sizes)
            flat = ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4").tobytes()
            cuts = iter(zip((c := np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n, dtype=np.int64)])] * 4).tolist(), c[1:].tolist(), strict=False))
            for x in held:
                if isinstance(x, list):
                    a, b = next(cuts)
                    out.append(flat[a:b])
                else:
                    out.append(array("I", self._direct([x])[0]).tobytes())
            held.clear()
            size = 0

        collecting = gc.isenabled()
        gc.disable()  # the many small lists made here hold no cycles
        try:
            for text in texts:
                whole = UNUSUAL.search(text) or self.mark in text and self.special.search(text)
                held.append(text if whole else self.parts(text))
                size += len(text)
                if size >= at_once:
                    flush()
            flush()
        finally:
            if collecting:
                gc.enable()
        return out


def encoder(path: str, keep_space: bool, literal: bool = False) -> Encoder:
    """The worker's encoder of this tokenizer file. keep_space: white space reaches the ids; literal: special tokens' strings are ordinary text."""
    key = (path, keep_space, literal)
    if key not in _encoders:
        _encoders[key] = Encoder(path, keep_space, literal)
    return _encoders[key]
