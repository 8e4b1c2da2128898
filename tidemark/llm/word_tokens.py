"""Token ids of whole texts by public tokenizers, with each word encoded once. Runs inside Python workers.

Both coders cut a text where no token can cross, look the cuts up in a cache and encode what is new together. The
ids are those of the whole text; tests compare them. A cache holds two generations of at most CACHE cuts of at most
LONG characters each: words in use move on to the younger one, the rest go with the older, so a worker's memory does
not follow the vocabulary of the corpus.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import filterfalse

import numpy as np

CACHE = 300_000
LONG = 256
#: Cuts encoded in one call.
JOINED = 1000

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?$%&*#"
WORD = re.compile(f"[{LETTERS}]+")
WITH_MARKS = re.compile(f"([0-9{LETTERS}]+)([{MARKS}].*)", re.S)


def _tokenizer(path: str, plain: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain
    return made


class _Coder:
    #: What an entry of the cache counts.
    weight = 1.0

    def __init__(self):
        self.known: dict = {}
        self.older: dict = {}

    def _missing(self, words: set[str]) -> set[str]:
        """The words to encode; those of the older generation move on."""
        new = set(filterfalse(self.known.__contains__, words))
        moved = list(filter(self.older.__contains__, new))
        self.known.update(zip(moved, map(self.older.__getitem__, moved), strict=True))
        new.difference_update(moved)
        return new

    def _forget(self, words) -> None:
        """Drop the long ones of words, and begin a generation where this one is full."""
        for w in words:
            if len(w) > LONG:
                self.known.pop(w, None)
        if len(self.known) * self.weight > CACHE:
            self.known, self.older = {}, self.known


def _packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class WordEndCoder(_Coder):
    """For tokenizers that drop white space and mark a word's last token, so that each word stands by itself.

    Words are the pieces between blanks and line feeds. A word with a mark behind letters or digits is looked up as
    two, as the tokenizer never joins these either.
    """

    #: Ids of one tokenizer: a cache of half as many again takes no more than that of the others.
    weight = 2 / 3

    def __init__(self, path: str):
        super().__init__()
        self.coder = _tokenizer(path, plain=False)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]
        self.ends = np.zeros(max(self.coder.get_vocab().values()) + 1, bool)
        for token, i in vocabulary["vocab"].items():
            self.ends[i] = token.endswith(vocabulary["end_of_word_suffix"])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        words = [t.replace("\n", " ").split(" ") for t in texts]
        new = self._missing(set().union(*words))
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, w)) for w in words]
        self._forget(new)
        return out

    def _learn(self, new: set[str]) -> None:
        halves = {w: m.groups() for w in new if (m := WITH_MARKS.fullmatch(w))}
        todo = new - halves.keys() | self._missing({x for pair in halves.values() for x in pair})
        single = [w for w in todo if len(w) <= LONG and WORD.fullmatch(w)]
        for at in range(0, len(single), JOINED):
            some = single[at : at + JOINED]
            ids = np.asarray(self.coder.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                whole, starts = ids.tobytes(), [0, *(4 * stops).tolist()]
                self.known.update((w, whole[starts[k] : starts[k + 1]]) for k, w in enumerate(some))
        rest = [w for w in todo if w not in self.known]
        for w, e in zip(rest, self.coder.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = _packed(e.ids)
        for w, (stem, mark) in halves.items():
            self.known[w] = self.known[stem] + self.known[mark]
        for x in todo - new:
            if len(x) > LONG:
                del self.known[x]


_BYTE_SIGNS = {**{chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
_BYTE_SIGNS |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_BYTE_SIGNS.values()))}


def spread(starts, lengths):
    """The places of runs of these lengths that begin at starts, run by run."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class TwoCoders(_Coder):
    """Ids of a byte-level tokenizer (A) and a piece model (B) for a blank and a text, with the bytes of every token.

    The cache holds, as little-endian unsigned 32-bit, how many ids a word has by A, these, and those by B.

    A blank behind anything that isn't white space begins a token of both, so texts are cut there. Texts that hold
    the piece model's own sign for a blank, or else don't come back byte by byte, have none.
    """

    weight = 1.2
    CUT = re.compile(r"(?<=\S) ")
    UNEVEN = re.compile(r"\s ")
    #: White space at an end of a word, where words stand behind single blanks.
    SPACED = re.compile(r" \s|\s |\s\Z")
    #: Letters, then marks or letters behind a line feed: no token of either crosses from one to the next.
    PARTED = re.compile(rf"[{LETTERS}]+(?:[{MARKS}]+|\n[{LETTERS}]+)+")
    PART = re.compile(rf"\n?[{LETTERS}]+|[{MARKS}]+")

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        super().__init__()
        self.a = _tokenizer(path_a, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = max(self.a.get_vocab().values()) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(_BYTE_SIGNS[c] for c in token) if all(c in _BYTE_SIGNS for c in token) else token.encode()
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    def words(self, text: str | None) -> list[str]:
        """The words of a text; each stands for a blank and itself."""
        if not text:
            return []
        return text.split(" ") if text[0] != " " and not self.UNEVEN.search(text) else self.CUT.split(text)

    def tokens(self, words: list[str]) -> list[bytes]:
        """What the cache holds of each word; no bytes where those of the word don't come back."""
        new = self._missing(words)
        self._learn(list(new))
        found = list(map(self.known.__getitem__, words))
        self._forget(new)
        return found

    def _learn(self, new: list[str]) -> None:
        # Words with white space at their ends wouldn't be cut off again when they are joined.
        odd = [w for w in new if not w or self.SPACED.search(" " + w)] if self.SPACED.search(" " + " ".join(new)) else []
        self.known.update((w, self._alone(w)) for w in odd)
        plain = list(filterfalse(set(odd).__contains__, new)) if odd else new
        parts = {w: self.PART.findall(w) for w in filter(self.PARTED.fullmatch, plain) if len(w) <= LONG}
        # A part that isn't the first is looked up behind an x, which is a token by itself.
        wanted = {p[0] for p in parts.values()} | {"x" + x for p in parts.values() for x in p[1:]}
        self._missing(wanted)
        self._encode([w for w in plain if w not in parts])
        self._encode([w for w in wanted if w not in self.known])
        behind = {x: self._sides(self.known["x" + x]) for x in {x for p in parts.values() for x in p[1:]}}
        lost = {x for x in wanted if not self.known[x]}
        for w, (head, *rest) in parts.items():
            if lost and not lost.isdisjoint([head, *("x" + x for x in rest)]):
                self.known[w] = self._alone(w)
                continue
            n, a, b = self._sides(self.known[head])
            for x in rest:
                m, of_a, of_b = behind[x]
                n, a, b = n + m - 1, a + of_a[4:], b + of_b[4:]
            self.known[w] = n.to_bytes(4, "little") + a + b

    @staticmethod
    def _sides(entry: bytes) -> tuple[int, bytes, bytes]:
        """How many ids by A, these, and those by B."""
        n = int.from_bytes(entry[:4], "little")
        return n, entry[4 : 4 + 4 * n], entry[4 + 4 * n :]

    def _encode(self, plain: list[str]) -> None:
        for at in range(0, len(plain), 4 * JOINED):
            some = plain[at : at + 4 * JOINED]
            whole = " " + " ".join(some)
            raw = whole.encode()
            stops = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[1:], len(raw))
            sides = []
            for ids, table, of in ((self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.bytes_a, self.sizes_a), (self.b.encode(whole[1:]), self.bytes_b, self.sizes_b)):
                if b"".join(map(table.__getitem__, ids)) == raw and len(stops) == len(some):
                    ids = np.asarray(ids, "<u4")
                    ends = np.cumsum(of[ids])
                    last = np.searchsorted(ends, stops)
                    if (ends[np.minimum(last, len(ends) - 1)] == stops).all():
                        sides.append((ids, np.diff(last + 1, prepend=0)))
            if len(sides) == 2:
                (a, in_a), (b, in_b) = sides
                bounds = np.concatenate(([0], np.cumsum(1 + in_a + in_b)))
                out = np.empty(bounds[-1], "<u4")
                out[bounds[:-1]] = in_a
                out[spread(bounds[:-1] + 1, in_a)] = a
                out[spread(bounds[:-1] + 1 + in_a, in_b)] = b
                packed, at_ = out.tobytes(), (4 * bounds).tolist()
                self.known.update(zip(some, map(packed.__getitem__, map(slice, at_, at_[1:])), strict=True))
            else:
                self.known.update((w, self._alone(w)) for w in some)

    def _alone(self, word: str) -> bytes:
        whole = (" " + word).encode()
        a, b = self.a.encode(" " + word, add_special_tokens=False).ids, self.b.encode(word) if word else [self.b.piece_to_id("▁")]
        if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return b""
        return _packed([len(a), *a, *b])


@lru_cache(maxsize=1)
def word_end_coder(path: str) -> WordEndCoder:
    """One for a worker, which keeps what it has learnt from task to task."""
    return WordEndCoder(path)


@lru_cache(maxsize=1)
def two_coders(path_a: str, path_b: str) -> TwoCoders:
    return TwoCoders(path_a, path_b)
