"""Token ids by the tokenizers library, one pre-token at a time through a bounded memory of known words.

A byte-level BPE without normalizer encodes each pre-token on its own, so joining the ids of the pre-tokens
gives the ids of the text. A pre-token ends wherever white space follows a visible character: texts are cut
there, frequent words are looked up, and the pre-tokens of the others go to the library's model. With
`added`, as the operators use it, texts are first split at the tokenizer's added tokens, as the library does;
without, their strings are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

from lorekeep.llm.store import kept_by_worker

VOCABULARY = "byte_bpe_50k.json"
#: Words kept in memory by each worker, and the longest that is kept.
KNOWN, KNOWN_LENGTH = 300_000, 40
#: Texts are split into slices of about so many characters, where a pre-token ends anyway.
SLICE = 1 << 18
#: Unicode white space, which lacks the separators U+001C to U+001F that str.isspace() counts.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_RUN = re.compile(f"[{SPACE}][{SPACE}]")
_WORDS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A word of Latin letters, and punctuation after it: one pre-token each.
_PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

_encoders: dict[tuple[str, bool], "Encoder"] = kept_by_worker({})


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _symbols() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as little-endian 32-bit values."""

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        tokens = {t.content: (i, t) for i, t in self.library.get_added_tokens_decoder().items()} if added else {}
        self.added = {c: array("I", [i]).tobytes() for c, (i, _) in tokens.items()}
        #: Tokens that take white space along or need word borders are left to the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for _, t in tokens.values())
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")") if tokens else None
        self.pre_tokens = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"(?!\S)", f"(?![^{SPACE}])"))
        self.symbols = _symbols()
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # the same of words after a space, by the word alone

    def _tokens(self, pre_token: str) -> bytes:
        """Ids of one pre-token."""
        shown = pre_token.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _encode(self, word: str) -> bytes:
        known, parts = self.known, []
        if plain := _PLAIN.fullmatch(word):
            space, letters, rest = plain.groups()
            if not rest:
                return self._tokens(word)
            if space:
                parts.append(self.spaced.get(letters) or self._after_space(letters))
            pre_tokens = [rest] if space else [letters, rest]
        else:
            pre_tokens = self.pre_tokens.findall(word)
        for pre_token in pre_tokens:
            ids = known.get(pre_token) or self._tokens(pre_token)
            if len(known) < KNOWN // 3 and len(pre_token) <= KNOWN_LENGTH:
                known[pre_token] = ids
            parts.append(ids)
        return b"".join(parts)

    def _after_space(self, word: str) -> bytes:
        ids = self._encode(" " + word)
        if len(self.spaced) < KNOWN and len(word) <= KNOWN_LENGTH:
            self.spaced[word] = ids
        return ids

    def slices(self, text: str) -> Iterator[str]:
        """Parts of a text, each but the first beginning with white space that follows a visible character."""
        at = 0
        while len(text) - at > SLICE:
            cut = _CUT.search(text, at + SLICE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split and self.split.search(text):
            if not self.plain:
                return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
            return b"".join(self.added.get(x) or self._ordinary(x) for x in self.split.split(text) if x)
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        spaced, after, out = self.spaced.get, self._after_space, []
        for part in self.slices(text):
            if _RUN.search(part):
                out += [spaced(w[1:]) or after(w[1:]) if w[0] == " " else self._encode(w) for w in _WORDS.findall(part)]
            else:
                head, *words = part.split(" ")
                out.append(self._encode(head))
                out += [spaced(w) or after(w) for w in words]
        return b"".join(out)


def encoder(path: str | None = None, added: bool = False) -> Encoder:
    """The encoder of this worker; its memory of words lasts from task to task, until one that needs none lets it go."""
    path = path or vocabulary_path()
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]
