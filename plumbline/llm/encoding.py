"""Token ids and counts of whole texts, by the ``tokenizers`` library or ``sentencepiece``, remembered by word inside a worker.

Both vocabularies split text before they merge, and no piece of that split holds white space after other characters. A text may
therefore be cut before a space or line end that follows something else, and its parts encoded one by one: the ids are those of
the whole text. Words repeat, so each worker encodes a word once and keeps the answer; the store of answers is emptied when full.
Plain words (Latin letters, then ASCII punctuation) go straight to the library's merge model; everything else goes through the
whole library, as do texts whose white space is not single spaces and line ends. A tokenizer with other rules gets whole texts.
"""
from __future__ import annotations

import array
import json
import os
import re

from .batches import of_bytes

KEPT = 600_000  # words, and parts of words, remembered in a worker
CALL_BYTES = 1 << 19  # of text in one call of the library
SPACED = -(1 << 60)
PART = 1 << 14  # characters after which a long text may be cut
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\\[-`{-~]*)")
SAFE_CUT = re.compile("(?<=[^\\s᠎])(?=[ \n])")
# fixed values: the split patterns of the two public vocabularies this module knows how to cut
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_loaded: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a vocabulary file."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece
            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.kind, self.size = "whole", pieces.vocab_size()
            self._ids_of = lambda ts: pieces.encode(ts, num_threads=1)
        else:
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(path)
            self.kind, self.size, self.model = self._rules(json.loads(tok.to_str())), tok.get_vocab_size(True), tok.model
            self._ids_of = lambda ts: [e.ids for e in tok.encode_batch_fast(ts, add_special_tokens=False)]
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.width = array.array(self.code).itemsize
        self.parts: dict[str, bytes] = {}
        self.known = Known(lambda w: self._plain(w, ""), b"")
        self.first = Known(lambda w: (i := self._plain(w, "")) and len(i) // self.width, 0)
        self.later = Known(lambda w: (i := self._plain(w, " ")) and len(i) // self.width, 0)

    def _packed(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    @staticmethod
    def _rules(config: dict) -> str:
        """``dropped``: white space only separates. ``kept``: it is encoded too. ``whole``: unknown rules, so texts stay whole."""
        before, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in config["added_tokens"]):
            return "whole"
        if config.get("truncation") or config.get("padding") or config["model"].get("type") != "BPE":
            return "whole"
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and norm is None:
            return "kept"
        steps = before.get("pretokenizers") or [{}]
        if (steps[0].get("pattern") == {"Regex": _WORD_SPLIT} and steps[0].get("behavior") == "Removed" and norm
                and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]):
            return "dropped"
        return "whole"

    def _merge(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            letters = part if part.isascii() and part[0] != " " else part.encode().decode("latin-1").translate(_LETTERS)
            self.parts[part] = ids = self._packed([t.id for t in self.model.tokenize(letters)])
        return ids

    def _plain(self, word: str, lead: str) -> bytes | None:
        """Ids of a plain word; ``lead`` is the space before it where white space is encoded. None for other words."""
        m = PLAIN.fullmatch(word)
        if not m or not word:
            return None
        letters, marks = m.groups()
        if self.kind == "dropped":
            letters = letters.lower()
        elif letters:
            letters = lead + letters
        else:
            marks = lead + marks
        if not marks:
            return self._merge(letters)
        return self._merge(letters) + self._merge(marks) if letters else self._merge(marks)

    def _library(self, parts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for call in of_bytes(parts, CALL_BYTES):
            out += self._ids_of(call)
        return out

    def _settle(self, store: "Known", lead: str) -> None:
        """Encodes the words that were met and are not plain, in batches."""
        words, store.open = list(store.open), {}
        for w, ids in zip(words, self._library([lead + w for w in words])):
            store[w] = self._packed(ids) if store is self.known else len(ids)

    def _room(self, *stores: dict) -> None:
        for store in (*stores, self.parts):
            if len(store) > KEPT:
                store.clear()

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as packed little-endian integers, two bytes wide where the vocabulary allows."""
        if self.kind != "dropped":
            return [self._packed(i) for i in self._library(texts)]
        known, out, again = self.known, [], []
        self._room(known)
        for n, text in enumerate(texts):
            missed = known.missed
            out.append(b"".join(map(known.__getitem__, text.replace("\n", " ").split(" "))))
            if known.missed > missed:
                again.append(n)
        self._settle(known, "")
        for n in again:
            out[n] = b"".join(map(known.__getitem__, texts[n].replace("\n", " ").split(" ")))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """For each text its number of ids."""
        if self.kind == "dropped":
            return [len(i) // self.width for i in self.ids(texts)]
        if self.kind == "whole":
            return [len(i) for i in self._library(texts)]
        first, later, out, again = self.first, self.later, [], []
        self._room(first, later)

        def total(text: str) -> int:
            n = text.count("\n")
            for line in text.split("\n"):
                head, *words = line.split(" ")
                n += first[head] + sum(map(later.__getitem__, words))
            return n

        for n, text in enumerate(texts):
            missed = first.missed + later.missed
            out.append(total(text) if text else 0)
            if first.missed + later.missed > missed:
                again.append(n)
        for store in (first, later):  # a word that holds white space at an end, or none: the text is not words between single spaces
            spaced = [w for w in store.open if not w or w[0].isspace() or w[-1].isspace() or "᠎" in w]
            store.update(dict.fromkeys(spaced, SPACED))
            store.open = {w: None for w in store.open if w not in store}
        self._settle(first, "")
        self._settle(later, " ")
        for n in again:
            out[n] = total(texts[n])
        odd = [n for n, t in enumerate(out) if t < 0]
        parts = [(n, p) for n in odd for p in cut(texts[n])]
        for n in odd:
            out[n] = 0
        for (n, _), ids in zip(parts, self._library([p for _, p in parts])):
            out[n] += len(ids)
        return out


class Known(dict):
    """Word -> answer. A plain word is encoded when first asked for; another gets ``none`` until its batch is encoded."""

    def __init__(self, plain, none):
        super().__init__()
        self.plain, self.none, self.open, self.missed = plain, none, {}, 0

    def __missing__(self, word: str):
        answer = self.plain(word)
        if answer is None:
            self.open[word] = None
            self.missed += 1
            return self.none
        self[word] = answer
        return answer


def cut(text: str, most: int = PART) -> list[str]:
    """A long text in parts that end where no token of a space-keeping vocabulary can cross; their ids add up to the text's."""
    parts, start = [], 0
    while len(text) - start > most:
        m = SAFE_CUT.search(text, start + most)
        if not m:
            break
        parts.append(text[start:m.start()])
        start = m.start()
    return [*parts, text[start:]]
