"""Ids of whole texts from a `tokenizers` file, each distinct stretch of text encoded once.

A byte-level pre-tokenizer never puts a character that is no white space and a space or
line feed after it into one piece, nor a letter and a mark such as a comma after it, and what
it does after such a place does not depend on what was before. A text is therefore cut there,
every distinct stretch goes to the library
once per worker (many of them joined in one text, whose ids are parted again by their bytes), and
the ids of a text are the ids of its stretches joined. Files with any other normalizer or
pre-tokenizer get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# Stretches whose ids a worker keeps in each of two generations, and the longest one kept.
KEPT_STRETCHES = 300_000
KEPT_CHARS = 64
# New stretches after which the library is called, and how many it gets joined in one text.
CALL_STRETCHES = 50_000
JOINED_STRETCHES = 500

# A space or line feed and plain letters before white space or a mark; marks before white
# space; else white space and other characters, going on over white space that starts with
# neither a space nor a line feed; white space at the very end.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_STRETCHES = re.compile(
    rf"[ \n]?[{_LETTER}]+(?=[ \n,.;:!?])|(?<=[{_LETTER}])[,.;:!?]+(?=[ \n])"
    r"|\s*\S+(?:(?![ \n])\s+\S+)*(?:(?![ \n])\s+\Z)?|\s+")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        spaced = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"])
                     for t in parts.get("added_tokens") or [])
        self.cuts = (parts.get("normalizer") is None and before.get("type") == "ByteLevel"
                     and before.get("use_regex", True) and not before.get("add_prefix_space") and not spaced)
        # Bytes of each token: one for each character of a byte-level token, and an added one's own.
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.sizes[number] = len(token)
        for number, token in self.library.get_added_tokens_decoder().items():
            self.sizes[number] = len(token.content.encode())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        if not self.cuts:
            return [np.frombuffer(ids, "<u4") for ids in self._library_ids(texts)]
        out: list[np.ndarray] = []
        todo: list[list[str]] = []
        new: set[str] = set()
        for text in texts:
            todo.append(stretches := _STRETCHES.findall(text))
            new.update(set(stretches).difference(self.known))
            if len(new) >= CALL_STRETCHES:
                self._finish(todo, list(new), out)
                todo, new = [], set()
        self._finish(todo, list(new), out)
        return out

    def _learn(self, stretches: list[str]) -> None:
        """Ids of stretches that may follow each other in one text; the tokens' bytes tell them apart."""
        groups = [stretches[i:i + JOINED_STRETCHES] for i in range(0, len(stretches), JOINED_STRETCHES)]
        coded = self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, coded):
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum([len(s.encode()) for s in group])
            cuts = 4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1)
            held, first = ids.tobytes(), 0
            for stretch, last in zip(group, cuts.tolist()):
                self.known[stretch] = held[first:last]
                first = last

    def _finish(self, todo: list[list[str]], new: list[str], out: list[np.ndarray]) -> None:
        again = [s for s in new if s in self.older]
        self.known.update((s, self.older[s]) for s in again)
        new = [s for s in new if s not in self.known] if again else new
        joins = [s for s in new if s[0] in " \n" and not s[-1].isspace() and len(s) <= KEPT_CHARS]
        self._learn(joins)
        alone = [s for s in new if s not in self.known]
        long = {}
        if alone:
            for text, ids in zip(alone, self._library_ids(alone)):
                (self.known if len(text) <= KEPT_CHARS else long)[text] = ids
        look = self.known.__getitem__ if not long else lambda s: long[s] if s in long else self.known[s]
        out += [np.frombuffer(b"".join(map(look, stretches)), "<u4") for stretches in todo]
        if len(self.known) > KEPT_STRETCHES:
            self.known, self.older = {}, self.known


    def rest(self) -> None:
        """Keep the younger generation alone until the worker's next task."""
        self.older = {}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
