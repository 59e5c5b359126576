"""Token ids of whole texts as a tokenizer file gives them, piece by piece.

A byte-level tokenizer cuts a text before every single space that stands between two words,
so a word with its leading space always has the same ids. Each task keeps the ids of the
words it has met and asks the tokenizer for new ones only. A word of Latin letters with signs behind
it is cut before the signs, and at a line's end between two such words, as the tokenizer does; each
run of letters is given to the tokenizer's model once, whatever follows it. Texts where this doesn't hold
(runs of white space, a special token's string inside) are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable

import numpy as np

KEPT_WORDS = 400_000  # words remembered by a task before the older half is let go
JOINED = 4_096  # new words given to the tokenizer at once
TOGETHER = 256  # texts whose new words are learned at once
_NO_IDS = 0  # kept for a word that has no ids of its own: a text that holds it is encoded whole


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def digest(spec: str) -> str:
    """Names the tokenizer's version: its file's content and the library's version."""
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}\n{spec}".encode()).hexdigest()


SIGNS = ".,;:!?#$%&*|"
LATIN_LINES = re.compile(rf"^(?:( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([{re.escape(SIGNS)}]*)|.*)$", re.M)  # nothing from other lines


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


def _shown(word: str) -> str:
    """A cached word as it stands in a text."""
    return word[:-1] if word[-1:] == " " else " " + word


def _odd(word: str) -> bool:
    """Whether white space stands at an end of a cached word, so that the cut before it is not the tokenizer's."""
    return word in ("", " ") or word[0].isspace() or word.rstrip(" ")[-1:].isspace()


class Encoder:
    """``encode(texts)``: for each text its ids as little-endian 32-bit numbers."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        given = json.loads(spec)
        before = given.get("pre_tokenizer") or {}
        self.marks = [t["content"] for t in given.get("added_tokens") or []]
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_word = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not given.get("normalizer")
            and not given.get("truncation")
            and not given.get("padding")
            and len(line_end) == 1
        )
        self.line_end = line_end[0] if line_end else -1
        self.model = self.tokenizer.model
        self.letter_of = np.arange(256, dtype="<u2")
        for byte, letter in _byte_letters().items():
            self.letter_of[byte] = ord(letter)
        self.raw = [np.array([i], "<u4").tobytes() for i in range(self.tokenizer.get_vocab_size())] if self.by_word else []
        self.tails: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}
        self.new: dict[str, bytes | int] = {}
        self.old: dict[str, bytes | int] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            self.tails[tail] = self.whole([tail])[0]
        return self.tails[tail]

    def _spelled(self, cores: list[str]) -> list[str]:
        """``cores`` as the vocabulary writes their bytes."""
        raw = np.frombuffer("\n".join(cores).encode(), np.uint8)
        return self.letter_of[raw].tobytes().decode("utf-16-le").split(chr(self.letter_of[10]))

    def _learn_cores(self, cores: list[str]) -> None:
        """Runs of Latin letters, each given to the model itself."""
        raw, tokenize, known = self.raw, self.model.tokenize, self.cores
        for core, spelled in zip(cores, self._spelled(cores)):
            known[core] = b"".join([raw[t.id] for t in tokenize(spelled)])

    def _learn(self, words: Iterable[str]) -> None:
        """Words as they are cached: one that starts a text ends in a blank, others have lost theirs."""
        new, tail_of = self.new, self._tail
        lines: list[str] = []  # of the words that have several; the others are looked at together
        lone, joined, plain = [], [], []
        for word in words:
            ids = self.old.get(word)
            if ids is not None:
                new[word] = ids
            elif "\n" in word:
                lines.append(word)
            else:
                plain.append(word)
        found = LATIN_LINES.findall("\n".join(map(_shown, plain))) if plain else []
        parts = [LATIN_LINES.findall(_shown(word)) for word in lines]
        cores = {core for core, _ in found}.union(*[[core for core, _ in of_word] for of_word in parts])
        cores.discard("")
        self._learn_cores([core for core in cores if core not in self.cores])
        known = self.cores
        for word, (core, tail) in zip(plain, found):
            if core:
                new[word] = known[core] + tail_of(tail) if tail else known[core]
            elif _odd(word):
                new[word] = _NO_IDS
            else:
                joined.append(word)
        for word, of_word in zip(lines, parts):
            if all(core for core, _ in of_word):
                new[word] = self.raw[self.line_end].join([known[core] + tail_of(tail) for core, tail in of_word])
            elif _odd(word):
                new[word] = _NO_IDS
            else:
                lone.append(word)
        for at in range(0, len(joined), JOINED):
            some = joined[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(map(_shown, some))], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) != len(some) - 1:
                lone += some
                continue
            raw, starts = ids.tobytes(), [0, *(ends + 1).tolist()]
            for word, begin, end in zip(some, starts, [*ends.tolist(), len(ids)]):
                new[word] = raw[4 * begin : 4 * end]
        if lone:
            new.update(zip(lone, self.whole([_shown(word) for word in lone])))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        out: list[bytes] = []
        for at in range(0, len(texts), TOGETHER):
            out += self._encode(texts[at : at + TOGETHER])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.new) > KEPT_WORDS:
            self.old, self.new, self.cores = self.new, {}, {}
        known = self.new
        out: list[bytes] = [b""] * len(texts)
        waiting: list[tuple[int, list[str], list[bytes | int | None], list[int]]] = []
        odd: list[int] = []
        unknown: set[str] = set()
        for k, text in enumerate(texts):
            if any(mark in text for mark in self.marks):
                odd.append(k)
                continue
            words = text.split(" ")
            words[0] += " "
            ids = list(map(known.get, words))
            places: list[int] = []
            for _ in range(ids.count(None)):
                places.append(ids.index(None, places[-1] + 1 if places else 0))
            unknown.update([words[place] for place in places])
            waiting.append((k, words, ids, places))
        self._learn(unknown)
        for k, words, ids, places in waiting:
            for place in places:
                ids[place] = known[words[place]]
            try:
                out[k] = b"".join(ids)
            except TypeError:  # a word without ids of its own
                odd.append(k)
        for k, ids in zip(odd, self.whole([texts[k] for k in odd])):
            out[k] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder per worker process, so that its words outlive a task."""
    key = digest(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]
