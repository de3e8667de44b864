"""Token ids of whole texts with a public tokenizer file.

A library call over a whole text spends most of its time tracking alignments that nobody reads, and natural text repeats its
words.  A byte-level BPE tokenizer treats the text between two single spaces on its own: a single space with a non-space on
either side always opens a new pre-token.  So a text is cut at such spaces, distinct pieces are cut into pre-tokens by the
published pattern, each distinct pre-token goes through the library's model once per worker, and the ids of a text are its
pieces' ids put together.  The result equals encoding the text in one call (tested).  A tokenizer file that does not state
these rules is recognised, and its texts are encoded whole.
"""

from __future__ import annotations

import codecs
import gc
import json
import os
import re

import numpy as np

_ODD = re.compile(r" (?:[^\S ]|\Z)")  # a space before other white space or the end
STOPS = frozenset(".,;:!?)\"")  # signs that open no contraction
_LONE = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: the published pre-token pattern of byte-level BPE files that set use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    return table | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in table)}


class Encoder:
    """``encode_bytes(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    _made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, cache_entries: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = splits_at_spaces(spec)
        self.limit = cache_entries
        self.caches: list[dict[str, bytes]] = [{}, {}]  # pieces after a space; pieces at a text's start
        self.older: list[dict[str, bytes]] = [{}, {}]
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        if self.by_piece:
            import regex
            from tokenizers import pre_tokenizers

            self.pattern = regex.compile(PATTERN)
            characters = _byte_characters()
            self.letters = "".join(characters[b] for b in range(256))
            self.model = Tokenizer.from_file(path)
            self.model.post_processor = None
            self.mark = self.letters[10]
            self.mark_id = self.model.token_to_id(self.mark)
            self.model.pre_tokenizer = pre_tokenizers.Split(self.mark, "isolated")

    @classmethod
    def of(cls, path: str, cache_entries: int = 300_000) -> Encoder:
        """One encoder per worker process and file."""
        key = (path, cache_entries)
        if key not in cls._made:
            cls._made[key] = cls(path, cache_entries)
        return cls._made[key]

    def _library(self, texts: list[str]) -> list[bytes]:
        """Whole texts in one call."""
        if self.whole is None:  # seldom needed: the copy for pre-tokens does nearly all
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelled(self, text: str) -> str:
        """Each byte of a text as its character in the vocabulary."""
        return codecs.charmap_decode(text.encode(), "strict", self.letters)[0]

    def _pretokens(self, tokens: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens; those without a line feed share calls, with line feeds between them."""
        out: dict[str, bytes] = {}
        plain = [t for t in tokens if "\n" not in t]
        for lo in range(0, len(plain), 1000):
            part = plain[lo:lo + 1000]
            said = self._spelled("\n".join(part))
            ids = np.asarray(self.model.encode_batch_fast([said], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            raw, lows, highs = ids.tobytes(), [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            out.update((t, raw[4 * a:4 * b]) for t, a, b in zip(part, lows, highs, strict=True))
        for t in tokens:  # their line feeds can't be told from those between pre-tokens
            if "\n" in t:
                found = self.model.model.tokenize(self._spelled(t))
                out[t] = np.array([x.id for x in found], "<u4").tobytes()
        return out

    def _fill(self, k: int, missing: set[str]) -> None:
        cache, older, lead, cut = self.caches[k], self.older[k], " " if k == 0 else "", {}
        known = missing & older.keys()
        cache.update((p, older.pop(p)) for p in known)
        new = missing - known
        if special := {p for a in self.added for p in new if a in p}:
            cache.update(zip(special, self._library([lead + p for p in special]), strict=True))
            new -= special
        letters = []
        for p in new:
            if p.isalpha():
                letters.append(lead + p)
            elif p[-1:] in STOPS and p[:-1].isalpha():  # letters and one sign: two pre-tokens
                cut[p] = (lead + p[:-1], p[-1])
            else:
                cut[p] = self.pattern.findall(lead + p)
        ids = self._pretokens(list(set(letters).union(*cut.values())))
        at = len(lead)
        cache.update((p[at:], ids[p]) for p in letters)
        cache.update((p, b"".join(map(ids.__getitem__, parts))) for p, parts in cut.items())

    def _look_up(self, k: int, pieces: list[str]) -> list[bytes]:
        if len(self.caches[k]) > self.limit:  # words in use move over from the older half
            self.older[k], self.caches[k] = self.caches[k], {}
        cache = self.caches[k]
        found = list(map(cache.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            words = [pieces[i] for i in missing]
            self._fill(k, set(words))
            for i, x in zip(missing, map(cache.__getitem__, words), strict=True):
                found[i] = x
        return found

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._library(texts)
        heads, flat, ends = [], [], []
        for t in texts:
            pieces = _LONE.split(t) if "  " in t or " \n" in t or _ODD.search(t) else t.split(" ")
            heads.append(pieces[0])
            flat += pieces[1:]
            ends.append(len(flat))
        collecting = gc.isenabled()
        gc.disable()  # the caches hold no cycles; scanning them again and again costs more than the encoding
        try:
            first, rest = self._look_up(1, heads), self._look_up(0, flat)
        finally:
            if collecting:
                gc.enable()
        at, out = 0, []
        for head, end in zip(first, ends, strict=True):
            out.append(head + b"".join(rest[at:end]))
            at = end
        return out


def splits_at_spaces(spec: dict) -> bool:
    """Whether the tokenizer file says: byte-level pre-tokens by the usual pattern, no normaliser, no added prefix space, plain
    merges, added tokens that neither swallow neighbouring space nor hold a space themselves."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
            and model.get("type") == "BPE" and not model.get("dropout") and model.get("unk_token") is None
            and all(not t.get("lstrip") and not t.get("rstrip") and " " not in t["content"] for t in spec.get("added_tokens") or []))
