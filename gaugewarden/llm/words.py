"""Texts as sequences of chunks: what lies between spaces and newlines, looked up in a bounded cache.

The tokenizer of ``word_bpe_49k.json`` drops white space and never merges
across it, so the tokens of a text are the tokens of its chunks in order. Most
chunks of a corpus repeat, so each worker works out a chunk once.
"""

import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache
from operator import itemgetter

# Fixed values of the tokenizer file: its special strings and, for characters below U+0130, its pattern of pre-tokens.
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
LETTER = "a-zªµºß-öø-ÿā-į"
DIGIT = "0-9²³¹¼-¾"
SPACE = "\\t-\\r \\x85\\xa0"
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")

#: A comma or full stop next to another sign, with which it would be one pre-token.
BESIDE_SIGN = re.compile(f"[.,](?:[^{SPACE}{LETTER}{DIGIT}]|(?<=[^{SPACE}{LETTER}{DIGIT}][.,]))")

SPECIAL = re.compile("|".join(map(re.escape, SPECIALS)))
#: Above these characters lower-casing and composing depend on more than the single character.
BEYOND = re.compile("[^\x00-į]")
CACHE_ENTRIES = 250_000
LONG_CHUNK = 64


def chunks(text: str) -> list[str]:
    """Pieces between spaces and newlines; other white space stays inside, where the tokenizer handles it.

    Where a text has neither special strings nor characters beyond the plain
    ones, it is lower-cased at once, as the tokenizer would, and fewer chunks differ.
    """
    if "<|" not in text and (text.isascii() or not BEYOND.search(text)):
        text = text.lower()
    return text.replace("\n", " ").split(" ")


class Recent(dict):
    """A dictionary of bounded size: when full it becomes the old one, and entries that are asked for again move over."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries, self.old = entries, {}

    def turn(self) -> None:
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer of a file, once per worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkCache:
    """Values of chunks. ``work_out`` gets the distinct unknown chunks of a batch and returns their values.

    Chunks over ``LONG_CHUNK`` characters are not kept.
    """

    def __init__(self, work_out: Callable[[list[str]], list], empty):
        self.work_out, self.empty = work_out, empty
        self.known = Recent(CACHE_ENTRIES)

    def of_texts(self, texts: list[str]) -> list[list]:
        """For each text the values of its chunks, in order."""
        self.known.turn()
        self.known[""] = self.empty
        get, recall = self.known.get, self.known.__missing__
        lists, out, new = [chunks(t) for t in texts], [], {}
        for words in lists:
            values = list(map(get, words))
            if None in values:
                new.update((w, None) for w, v in zip(words, values) if v is None and recall(w) is None)
            out.append(values)
        fresh = list(new)
        found = dict(zip(fresh, self.work_out(fresh), strict=True)) if fresh else {}
        for i, words in enumerate(lists):
            if None in out[i]:
                out[i] = [(found[w] if w in found else get(w)) if v is None else v for w, v in zip(words, out[i])]
        self.known.update((w, v) for w, v in found.items() if len(w) <= LONG_CHUNK)
        return out


def text_blocks(texts, max_chars: int = 2_000_000):
    """Lists of consecutive texts of about ``max_chars`` characters, so that a batch of long texts stays small in memory."""
    block, size = [], 0
    for t in texts:
        block.append(t if t is not None else "")
        size += len(block[-1])
        if size >= max_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def pretokens(chunk: str, tokenizer) -> list[str | None]:
    """Pre-tokens of a chunk in the tokenizer's byte letters; None stands for a special string."""
    if "<|" in chunk and SPECIAL.search(chunk):
        # special strings split a text before it is normalised
        out: list[str | None] = []
        at = 0
        for m in SPECIAL.finditer(chunk):
            out += [*pretokens(chunk[at:m.start()], tokenizer), None]
            at = m.end()
        return out + pretokens(chunk[at:], tokenizer)
    if chunk.isascii():
        low = chunk.lower()
        if low.isalpha():
            return [low]
        if low[:-1].isalpha():  # a word and one sign or digit
            return [low[:-1], low[-1]] if low[-1].isprintable() else _by_library(chunk, tokenizer)
        return PRETOKEN.findall(low) if low.isprintable() else _by_library(chunk, tokenizer)
    if BEYOND.search(chunk):
        return _by_library(chunk, tokenizer)
    letters = byte_letters()
    return [p if p.isascii() and p.isprintable() else "".join([letters[b] for b in p.encode()]) for p in PRETOKEN.findall(chunk.lower())]


def _by_library(chunk: str, tokenizer) -> list[str | None]:
    return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(chunk))]


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit bytes."""

    if sys.byteorder != "little":
        raise ImportError("ids are written in the byte order of the machine, which must be little-endian")

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.words, self.chunks = Recent(CACHE_ENTRIES // 2), _Chunks(self, CACHE_ENTRIES // 2)
        self.plain = _Pretokens(self, CACHE_ENTRIES)

    def word(self, p: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(p)]).tobytes()
        if len(p) <= LONG_CHUNK:
            self.words[p] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not (chunk.isascii() or not BEYOND.search(chunk)):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        known = self.words
        return b"".join([known[p] or self.word(p) for p in pretokens(chunk, self.tokenizer)])

    def encode(self, texts: list[str]) -> list[bytes]:
        for cache in (self.words, self.chunks, self.plain):
            cache.turn()
        return [self._text(t) for t in texts]

    def _text(self, text: str) -> bytes:
        # one call looks up all parts of a text and works out the unknown ones on the way
        if "<|" not in text and (text.isascii() or not BEYOND.search(text)) and text.replace("\n", " ").isprintable():
            # nothing but plain letters, digits and signs
            low = text.lower()
            if BESIDE_SIGN.search(low):
                parts = PRETOKEN.findall(low)
            else:  # most chunks are then a word or a sign; few go through the pattern
                parts = low.replace(",", " , ").replace(".", " . ").split()
            return b"".join(itemgetter(*parts, "", "")(self.plain))
        return b"".join(itemgetter(*chunks(text), "")(self.chunks))


class _Pretokens(Recent):
    """Ids of plain chunks in lower case, of one pre-token or several."""

    def __init__(self, encoder: LibraryEncoder, entries: int):
        super().__init__(entries)
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = b"".join([self.work_out(p) for p in ([chunk] if chunk.isalpha() else PRETOKEN.findall(chunk))])
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
        return ids

    def work_out(self, pretoken: str) -> bytes:
        if not pretoken.isascii():
            letters = byte_letters()
            pretoken = "".join([letters[b] for b in pretoken.encode()])
        return array("I", [t.id for t in self.encoder.model.tokenize(pretoken)]).tobytes()


class _Chunks(Recent):
    def __init__(self, encoder: LibraryEncoder, entries: int):
        super().__init__(entries)
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encoder.chunk(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)
