"""Token ids of Arrow batches of texts: every distinct unit of a window of text is encoded once.

A unit starts where no token can cross: at a space or line end after a printable character, after a single line end, and at ASCII
punctuation after a letter.
The ids of a text are those of its units in order. Units are cut with numpy from the UTF-8 bytes, made distinct by Arrow, looked up
in the worker's store, and put back by Arrow's take; no Python object is made for a word that occurs again in its window. The store
is bounded by bytes, and long units are not kept in it. A tokenizer whose rules are not known gets whole texts.
"""
from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from .encoding import _LETTERS, Encoder, encoder

WINDOW = 8 << 20  # bytes of text handled at a time, whatever a text's length
STORE_BYTES = 128 << 20  # of units and ids remembered in a worker
ENTRY = 150  # bytes an entry of the store takes beside its letters and ids
LONGEST = 200  # characters of a unit that is remembered
PLAIN = re.compile(" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-/:-@\\[-`{-~]+)")
OTHER, SPACE, LETTER, MARK, DIGIT = range(5)


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[33:127] = MARK
    table[[32, 10]] = SPACE
    table[48:58] = DIGIT
    table[65:91] = table[97:123] = LETTER
    return table


class Units:
    """The ids of texts by one vocabulary, as packed little-endian integers of the encoder's width."""

    def __init__(self, enc: Encoder, special: list[str] = ()):
        self.enc, self.store, self.held = enc, {}, 0
        self.classes = _classes()
        for token in special:  # a special string is matched before texts are split, so no unit may start inside one
            self.classes[[ord(b) for a, b in zip(token, token[1:]) if a.isalpha() and b.isascii() and not b.isalnum()]] = OTHER
        self.starts = np.zeros(64, bool)
        self.starts[[LETTER << 3 | SPACE, MARK << 3 | SPACE, DIGIT << 3 | SPACE, LETTER << 3 | MARK]] = True

    def _cuts(self, raw: np.ndarray) -> np.ndarray:
        """Positions after the first where a unit starts."""
        kind = self.classes[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3) + 1  # second bytes of the Latin letters; the signs for times and divide are none
        kind[lead[(raw[lead] != 0x97) & (raw[lead] != 0xB7)]] = LETTER
        cuts = np.flatnonzero(self.starts[kind[:-1] << 3 | kind[1:]]) + 1
        line = cuts[(raw[cuts] == 10) & (cuts + 1 < len(raw))] + 1  # one line end between printable characters stands alone
        return np.concatenate([cuts, line[(kind[line] != OTHER) & (kind[line] != SPACE)]])

    def _new(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units that are not in the store: plain words by the library's merge model, all others by the whole library."""
        enc, found, rest = self.enc, {}, []
        for unit in units:
            if not PLAIN.fullmatch(unit):
                rest.append(unit)
                continue
            word = unit if enc.kind == "kept" else unit.strip(" ").lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_LETTERS)
            elif word[0] == " ":
                word = chr(_LETTERS[32]) + word[1:]
            found[unit] = enc._packed([t.id for t in enc.model.tokenize(word)])
        for unit, ids in zip(rest, enc._library(rest)):
            found[unit] = enc._packed(ids)
        kept = {u: i for u, i in found.items() if len(u) <= LONGEST}
        self.store.update(kept)
        self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY * len(kept)
        return found

    def _window(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed ids of the units between ``bounds``, and the byte at which each unit's ids start and end."""
        units = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        names = units.dictionary.to_pylist()
        if self.held > STORE_BYTES:
            self.store.clear()
            self.held = 0
        answers = list(map(self.store.get, names))
        missed = [u for u, a in zip(names, answers) if a is None]
        if missed:
            new = self._new(missed)
            answers = [new[u] if a is None else a for u, a in zip(names, answers)]
        ids = pa.array(answers, pa.binary()).take(units.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
        data = ids.buffers()[2]
        return (data.to_pybytes()[ends[0]:ends[-1]] if data else b""), ends - ends[0]

    def ids(self, texts: pa.StringArray) -> list[bytes]:
        """For each text its ids; a missing text has none."""
        if self.enc.kind == "whole":
            return self.enc.ids([t or "" for t in texts.to_pylist()])
        if texts.null_count:
            texts = texts.fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        data, places, total, start = [], np.zeros(len(at), np.int64), 0, 0
        while start < len(raw):
            size = WINDOW
            while True:  # a window ends at its last unit's start; one without a unit's start is widened
                part = raw[start:start + size]
                inside = at[np.searchsorted(at, start, "right"):np.searchsorted(at, start + len(part), "left")] - start
                mark = np.zeros(len(part) + 1, bool)
                mark[self._cuts(part)] = True
                mark[inside] = True
                cuts = np.flatnonzero(mark[:-1])
                if start + size >= len(raw) or len(cuts):
                    break
                size *= 2
            bounds = np.concatenate([[0], cuts, [len(part)] if start + size >= len(raw) else []]).astype(np.int64)
            part = part[:bounds[-1]]
            ids, ends = self._window(part, bounds)
            first, last = np.searchsorted(at, start, "left"), np.searchsorted(at, start + len(part), "right")
            places[first:last] = total + ends[np.searchsorted(bounds, at[first:last] - start)]
            data.append(ids)
            total += len(ids)
            start += len(part)
        every = data[0] if len(data) == 1 else b"".join(data)
        return [every[a:b] for a, b in zip(places, places[1:])]


_loaded: dict[str, Units] = {}


def units(path: str) -> Units:
    """The worker's units for a vocabulary file."""
    if path not in _loaded:
        enc = encoder(path)
        special = [] if path.endswith(".model") else [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        _loaded[path] = Units(enc, special)
    return _loaded[path]
