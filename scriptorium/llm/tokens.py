"""Token ids of whole texts with a public tokenizer, through a memo of white-space-delimited chunks.

Both supported kinds of tokenizer (byte-level BPE with a leading blank, word-end BPE that drops white
space) cut a text before every run of white space and never merge across such a cut, so the ids of a
text are the ids of its chunks one after the other. Distinct chunks are encoded once in a worker.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from scriptorium.llm.common import hold

#: White space as the tokenizers' own patterns see it (fixed values).
_WS = "\t-\r \x85\xa0  -     　"
_ALNUM = "0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Any text: a chunk is a run of white space with the word after it; a lone full stop or comma after a
#: letter or digit is a chunk of its own, which spares most of the variants of a word.
_CHUNK = re.compile(rf"[{_WS}]*[^{_WS}.,]*[{_ALNUM}](?=[.,](?:[{_WS}]|\Z))|[{_WS}]*[^{_WS}]+|[{_WS}]+")
_STOP = np.isin(np.arange(256), list(b".,"))
_GAP = np.isin(np.arange(256), list(b" \n"))
_WORD = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
#: Second bytes of the letters from U+00C0 to U+00FF, all but the signs for times and divided by.
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
#: Chunks in each of a memo's two generations (about 200 bytes each), the longest chunk worth remembering, and the
#: characters of texts that are cut into chunks together.
MEMO_CHUNKS, MEMO_CHARS, TOGETHER = 220_000, 64, 1 << 18

_memos: dict[str, "ChunkMemo"] = {}


def _plain(text: str) -> bool:
    """Whether all white space is single blanks and line feeds between words."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return text.replace("\n", "").isprintable()


def _plain_stops(text: str) -> bool:
    """Whether every full stop or comma before a blank follows a letter or digit, Latin ones with accents included."""
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.flatnonzero(_STOP[data[1:-1]] & _GAP[data[2:]]) + 1
    before = data[at - 1]
    fine = _WORD[before] | (_LATIN[before] & (data[at - 2] == 0xC3) & (at > 1))
    return bool(fine.all()) and not (len(data) > 1 and _STOP[data[0]] and _GAP[data[1]])


def _keys(text: str) -> list[str]:
    """Chunks of a text as memo keys: a bare word stands for itself after a blank, a word after NUL for
    itself with nothing before it, a word after a line feed for both."""
    if not text:
        return []
    if _plain(text):
        # A full stop or comma is a chunk of its own where all of them follow letters or digits.
        stops = _plain_stops(text)
        text = text.replace("\n", " \n")
        if stops:
            text = text.replace(". ", " \0. ").replace(", ", " \0, ")
        found = text.split(" ")
        found[0] = "\0" + found[0]
        return found
    return [c[1:] if c[0] == " " and len(c) > 1 and c[1] not in "\0\n" and not c[1].isspace() else c if c[0] == "\n" else "\0" + c for c in _CHUNK.findall(text)]


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter of each byte: itself where printable, else the next letter from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


#: A word of letters alone is one unit of both kinds, so the model can have it without the text rules.
_LETTERS = re.compile("\0?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_BYTES = _byte_letters()


class ChunkMemo:
    """Ids of chunks as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.lower = "Lowercase" in json.dumps(rules["normalizer"])
        #: Control strings that the tokenizer takes out of a text before anything else; a text with one is encoded whole.
        self.special = re.compile("|".join(re.escape(t["content"]) for t in rules["added_tokens"]) or r"\Z.", re.IGNORECASE)
        self.clear()

    def clear(self) -> None:
        """Forget all chunks."""
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _word(self, key: str) -> bytes:
        """Ids of a word of letters."""
        bare = key.lstrip("\0")
        letters = (bare.lower() if self.lower else bare).encode().decode("latin-1").translate(_BYTES)
        if not self.lower and len(bare) == len(key):
            letters = _BYTES[32] + letters
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            if "<|" in text and self.special.search(text):
                out += self._group(group)
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
                group, size = [], 0
                continue
            group.append(text)
            size += len(text)
            if size > TOGETHER:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMO_CHUNKS:
            self.known, self.older = {}, self.known
        if self.lower:
            texts = [x.lower() if x.isascii() else x for x in texts]
        known, older, large, cut, rest = self.known, self.older, {}, [_keys(x) for x in texts], []
        for k in set().union(*cut).difference(known):
            if k in older:
                known[k] = older[k]
            elif len(k) <= MEMO_CHARS and _LETTERS.fullmatch(k):
                known[k] = self._word(k)
            else:
                rest.append(k)
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            plain = [k[1:] if k[:1] == "\0" else k if k[:1] == "\n" else " " + k for k in part]
            for k, e in zip(part, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)):
                (known if len(k) <= MEMO_CHARS else large)[k] = array("I", e.ids).tobytes()
        if large:
            return [b"".join([large[k] if k in large else known[k] for k in x]) for x in cut]
        return [b"".join(map(known.__getitem__, x)) for x in cut]


def chunk_memo(path: str) -> ChunkMemo:
    """The worker's memo for a tokenizer file. It serves all partitions of a stage; the first partition of another
    operator in the same worker drops its chunks."""
    if path not in _memos:
        _memos[path] = ChunkMemo(path)
    hold(_memos[path].clear)
    return _memos[path]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
