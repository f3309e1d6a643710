"""Pre-tokens of texts for byte-pair tokenizers, and a cached encoder over them.

A byte-pair tokenizer encodes each pre-token on its own, so a text's ids are those
of its pre-tokens one after another. Splitting is done here only for texts of
ASCII and Latin letters up to U+017F, where the library's rules reduce to plain
character classes; any other text, and one that holds a string of a special token,
is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

from roadspeed.llm.frames import kept, release

#: Letters of Latin-1 and Latin Extended A. Capital I with dot grows when lower-cased and is left out.
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_SPACE = r"\t-\r "
_UNSAFE = re.compile(rf"[^\x00-\x7f{_LETTER}]")

_CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
#: Lower-cased letters, single digits, runs of the rest; white space dropped.
WORD_END = re.compile(rf"{_CONTRACTION}|[{_LETTER}]+|[0-9]|[^{_SPACE}{_LETTER}0-9]+")
#: Letters, digits or the rest, each with at most one space before; white space kept.
BYTE_LEVEL = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+|{_CONTRACTION}| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: Characters of texts that are split together, and new pre-tokens that are encoded as one text.
GROUP, JOINED = 600_000, 256

_CUT = re.compile(rf"[^{_SPACE}](?= [^{_SPACE}])")


def pieces(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut before a single space between words."""
    a = 0
    while len(text) - a > 2 * limit:
        cut = _CUT.search(text, a + limit)
        if cut is None:
            break
        yield text[a:cut.end()]
        a = cut.end()
    yield text[a:] if a else text


class Splitter:
    """Splits the texts that it can; ``split`` gives None for the others."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        kinds = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        if spec["model"]["type"] != "BPE" or spec.get("post_processor") is not None:
            raise ValueError("a byte-pair tokenizer without post-processor is needed")
        before = spec.get("pre_tokenizer") or {}
        if kinds == ["NFC", "Replace", "Lowercase"] and before.get("type") == "Sequence":
            self.pattern, self.lower = WORD_END, True
        elif spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space"):
            self.pattern, self.lower = BYTE_LEVEL, False
        else:
            raise ValueError("unknown normalizer or pre-tokenizer")
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special)) if special else None

    def tokens(self, text: str) -> list[str] | None:
        """All pre-tokens of a short text at once."""
        return None if self.whole(text) else self.pattern.findall(text.lower() if self.lower else text)

    def split(self, text: str) -> Iterator[list[str]] | None:
        if self.whole(text):
            return None
        return (self.pattern.findall(p.lower() if self.lower else p) for p in pieces(text))

    def whole(self, text: str) -> bool:
        """Whether the library has to see the text as a whole."""
        if not text.isascii() and _UNSAFE.search(text):
            return True
        return self.special is not None and "<|" in text and self.special.search(text) is not None


_KEPT: dict[tuple, CachedEncoder] = kept("pretokens")


class CachedEncoder:
    """Two tiers: a given table of frequent pre-tokens, and what this worker has met since.

    ``value`` turns the ids of a pre-token or text into what is kept and put together
    by the caller. The second tier has two generations of ``limit`` entries: when
    the younger is full it becomes the older, and what is met again moves over, so
    memory is bounded whatever the texts.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object], table: dict[str, object] | None = None,
                 limit: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.splitter = Splitter(spec)
        self.value, self.table, self.limit = value, table or {}, limit
        self.known, self.older = dict(self.table), {}
        # A byte-level piece has one character for each byte.
        self.bytes = None if self.splitter.pattern is not BYTE_LEVEL else np.array(
            [len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())], np.int64)

    @classmethod
    def kept(cls, key: tuple, make: Callable[[], CachedEncoder]) -> CachedEncoder:
        """This worker's encoder of a key, kept from task to task; another key replaces it."""
        release("pretokens")
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = make()
        return _KEPT[key]

    def encode(self, texts: list[str]) -> list:
        return [self.value(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def values(self, texts: Iterable[str]) -> Iterator[Iterator[list]]:
        """Per text an iterator of lists of values, in order; each is to be used up before the next.

        Short texts are split together, so that what is new in them is encoded in one call.
        """
        group, size = [], 0
        for text in texts:
            if len(text) > GROUP:
                yield from self._group(group)
                group, size = [], 0
                yield self._long(text)
                continue
            group.append(text)
            size += len(text)
            if size > GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[Iterator[list]]:
        tokens = [self.splitter.tokens(t) for t in texts]
        self._learn(set(chain.from_iterable(t for t in tokens if t is not None)))
        known = self.known.__getitem__
        for text, own in zip(texts, tokens):
            yield iter([self.encode([text]) if own is None else list(map(known, own))])

    def _long(self, text: str) -> Iterator[list]:
        split = self.splitter.split(text)
        if split is None:
            yield self.encode([text])
            return
        for own in split:
            self._learn(set(own))
            yield list(map(self.known.__getitem__, own))

    def _learn(self, tokens: set[str]) -> None:
        if len(self.known) > self.limit + len(self.table):
            self.known, self.older = dict(self.table), self.known
        need = tokens.difference(self.known)
        new = need.difference(self.older)
        self.known.update((t, self.older[t]) for t in need - new)
        self.known.update(self._encoded(list(new)))

    def _encoded(self, tokens: list[str]) -> Iterator[tuple[str, object]]:
        """Each pre-token and its value. Byte-level words with a space before are encoded many in one text, where they stay apart."""
        words = [t for t in tokens if t[0] == " " and t[1:2].isalpha()] if self.bytes is not None else []
        groups = [words[k:k + JOINED] for k in range(0, len(words), JOINED)]
        rest = tokens if not words else [t for t in tokens if t[0] != " " or not t[1:2].isalpha()]
        for group, e in zip(groups, self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids, want = e.ids, np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in group])
            ends = np.cumsum(self.bytes[ids])
            cut = np.searchsorted(ends, want)
            if cut[-1] != len(ids) - 1 or (ends[cut] != want).any():  # not apart, or an id that is no piece of bytes
                rest.extend(group)
                continue
            cut = (cut + 1).tolist()
            yield from zip(group, [self.value(ids[a:b]) for a, b in zip([0, *cut], cut)])
        yield from zip(rest, self.encode(rest))
