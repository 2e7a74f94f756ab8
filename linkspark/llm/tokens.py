"""Exact library tokenisation at corpus speed: texts are cut at boundaries that no token of the library can cross,
and the library encodes each distinct piece once per worker while a bounded cache holds it."""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from operator import attrgetter

_ID = attrgetter("id")

#: Latin letters; every one is a letter for the library as well, none combines with its neighbours.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"

#: Texts that try the cutting rules on a tokenizer before they are used.
PROBES = (
    "The cat, sat. on  the mat...\nThe End,, ok.,", " lead and trail \n\n two", "a.b,c d.,e don't we'll I'M it's.", "Élan über ñandú, æon. ÀÉ", "x1y22z333 4,5.6 a1b2",
    "tab\tand\r\nline", "sym!bol# (par) [br] $5 <tag> <|endoftext|> a<|endoftext|>b", "漢字 かな 🙂 ไทย", "a" * 40 + "." * 9 + "b" * 40,
)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def refuse_unless(same: bool, path: str) -> None:
    if not same:
        raise ValueError(f"{path}: this tokenizer joins tokens across the boundaries at which texts are cut here")


class BoundedCache(dict):
    """A dict that takes no more than `most` entries; what it holds never changes a result.

    Frequent keys come early and stay. When many keys have been refused, the texts must have changed: it starts anew.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.refused = most, 0

    def settle(self, added) -> None:
        """Forget the keys that were just added if there is no room for them."""
        if len(self) > self.most:
            self.refused += len(added)
            for k in added:
                self.pop(k, None)
            if self.refused > 10 * self.most:
                self.clear()
                self.refused = 0

    def keep(self, key, value):
        if len(self) < self.most:
            self[key] = value
        else:
            self.refused += 1
            if self.refused > 10 * self.most:
                self.clear()
                self.refused = 0
        return value


class Computed(BoundedCache):
    """A bounded cache that computes what it lacks. What it has no room for goes to a second one, half as large, that starts anew when a batch finds it full."""

    def __init__(self, most: int, make):
        super().__init__(most)
        self.make, self.spare = make, {}

    def of_batch(self) -> Computed:
        if len(self.spare) > self.most // 2:
            self.refused += len(self.spare)
            self.spare.clear()
        if self.refused > 10 * self.most:
            self.clear()
            self.refused = 0
        return self

    def __missing__(self, key):
        if (value := self.spare.get(key)) is None:
            value = self.make(key)
            if len(self) < self.most:
                self[key] = value
            else:
                self.spare[key] = value
        return value


def per_worker(key, make):
    """make(), once per Python worker: the tasks that follow in the worker share it. A worker holds one such object, the last asked for."""
    holder = sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state"))
    if getattr(holder, "key", None) != key:
        holder.key, holder.value = None, None
        holder.key, holder.value = key, make()
    return holder.value


def byte_letters() -> dict[int, str]:
    """How a byte-level pre-tokenizer writes a blank and each Latin letter, asked of the library."""
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = [" "] + [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    return {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}


def packed(ids: list[int], width: int = 4) -> bytes:
    """Little-endian unsigned numbers of 2 or 4 bytes."""
    out = array("H" if width == 2 else "I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordPieces:
    """Ids, as little-endian unsigned numbers of `width` bytes, of a tokenizer that drops white space and marks word ends.

    Cuts: at blanks and line feeds (dropped by the model; nothing composes across them), and between a word of
    Latin letters and trailing full stops or commas (the pre-tokenizer ends a letter run there). A plain word goes to
    the library's model as the normaliser and pre-tokenizer would hand it over; anything else through the whole encoder.
    A tokenizer for which that does not hold on PROBES is refused.
    """

    _plain = re.compile(f"([{LETTERS}]+)([.,]*)")

    def __init__(self, path: str, most: int = 450_000, width: int = 4):
        self.tok, self.width = load(path), width
        self.letters = byte_letters()
        self.chunks, self.words, self.tails = Computed(most, self._chunk), BoundedCache(most // 2), BoundedCache(1000)
        refuse_unless(self.encode(list(PROBES)) == [self._raw(t) for t in PROBES], path)

    @classmethod
    def of_worker(cls, path: str, width: int = 4) -> WordPieces:
        return per_worker(("word pieces", path, width), lambda: cls(path, width=width))

    def _raw(self, text: str) -> bytes:
        return packed(self.tok.encode(text, add_special_tokens=False).ids, self.width)

    def _word(self, w: str) -> bytes:
        if (core := self.words.get(w)) is None:
            # ASCII letters stand for themselves in the byte alphabet.
            core = packed(list(map(_ID, self.tok.model.tokenize(w if w.isascii() else w.translate(self.letters)))), self.width)
            self.words.keep(w, core)
        return core

    def _chunk(self, c: str) -> bytes:
        body = c if c.isalpha() else c.rstrip(".,")
        if not (body.isascii() and body.isalpha()):
            if (m := self._plain.fullmatch(c)) is None:
                return self._raw(c) if c else b""
            body = m[1]
        if len(body) == len(c):
            return self._word(c.lower())
        if (tail := self.tails.get(t := c[len(body) :])) is None:
            tail = self.tails.keep(t, self._raw(t))
        return self._word(body.lower()) + tail

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids = self.chunks.of_batch().__getitem__
        return [b"".join(map(ids, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]


class BytePieceCounts:
    """Token counts of a byte-level tokenizer whose tokens never join a blank to what stands before it.

    Cuts: before a blank or line feed that follows a character which is no white space, and between a word of
    Latin letters and the full stops or commas after it. A blank and a plain word are one pre-token, which goes to the
    library's model as such; the other pieces are encoded in batches of about equal bytes. A piece of more than `long`
    characters is also cut where its pre-tokenizer ends a run: between ASCII letters, digits and stops. What then is
    left in one run (of one script without blanks, say) is one piece. Texts with the control characters that count as
    white space here but not in the library (1C to 1F) are encoded whole. A tokenizer for which that does not hold on
    PROBES is refused.
    """

    _piece = re.compile(r"\s*[^\s]+|\s+")
    _odd = re.compile("[\x1c-\x1f]")
    _plain = re.compile(f"( [{LETTERS}]+)([.,]*)")
    _runs = re.compile(r"(?<=[A-Za-z])(?=[0-9.,;:!?])|(?<=[0-9])(?=[A-Za-z.,;:!?])|(?<=[.,;:!?])(?=[A-Za-z0-9])")

    def __init__(self, path: str, most: int = 150_000, batch_bytes: int = 400_000, long: int = 4096):
        self.tok = load(path)
        self.letters = byte_letters()
        self.pieces, self.words = BoundedCache(most), BoundedCache(most)
        self.batch_bytes, self.long = batch_bytes, long
        special = any(self._runs.search(t.content) for t in self.tok.get_added_tokens_decoder().values())
        within = [[p for x in self._piece.findall(t) for p in self._runs.split(x)] for t in PROBES]
        refuse_unless(not special and [sum(map(self._whole, x)) for x in within] == [self._whole(t) for t in PROBES] == self.count(list(PROBES)), path)

    @classmethod
    def of_worker(cls, path: str) -> BytePieceCounts:
        return per_worker(("byte piece counts", path), lambda: cls(path))

    def _whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def _pieces(self, text: str) -> list[str]:
        found = self._piece.findall(text)
        if len(text) > self.long and len(max(found, key=len)) > self.long:
            found = [q for p in found for q in (self._runs.split(p) if len(p) > self.long else [p])]
        return found

    def _count_each(self, texts: list[str]) -> list[int]:
        out = []
        for part in balanced(texts, self.batch_bytes):
            out += [len(e.ids) for e in self.tok.encode_batch(part, add_special_tokens=False)]
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        pieces = [None if t and self._odd.search(t) else self._pieces(t) if t else [] for t in texts]
        known, words, tokenize = self.pieces, self.words, self.tok.model.tokenize
        missing = set().union(*[p for p in pieces if p]).difference(known)
        split = {p: self._plain.fullmatch(p) for p in missing}
        fresh, blank = {m[1] for m in split.values() if m}.difference(words), self.letters[ord(" ")]
        for w in fresh:
            words[w] = len(tokenize(blank + w[1:] if w.isascii() else w.translate(self.letters)))
        rest = sorted({p for p, m in split.items() if m is None} | {m[2] for m in split.values() if m and m[2]})
        other = dict(zip(rest, self._count_each(rest)))
        for p, m in split.items():
            known[p] = other[p] if m is None else words[m[1]] + (other[m[2]] if m[2] else 0)
        get = known.__getitem__
        out = [self._whole(t) if p is None else sum(map(get, p)) for t, p in zip(texts, pieces)]
        known.settle(missing)
        words.settle(fresh)
        return out


def balanced(texts: list[str], most_bytes: int):
    """Consecutive groups of about equal UTF-8 bytes."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t) if t.isascii() else len(t.encode())
        if held >= most_bytes:
            yield group
            group, held = [], 0
    if group:
        yield group
