"""Token ids of many texts at once, by a public tokenizer file.

Both kinds of tokenizer known here cut a text into pieces before they merge, and
no piece goes over certain places at white space. Texts are cut at such places
only, each distinct part is encoded once by the tokenizers library, and the ids
are put together again. The result is that of encoding each text whole; tests
hold it against the library.

``breaks`` says where a file's texts may be cut:

- ``dropped``: white space separates and leaves no token; parts are words.
- ``leading``: a space belongs to what follows it; parts begin at a space
  between two characters that are not white space, or at a line break between such.
- ``none``: texts are encoded whole.

Parts also end between a letter and a mark such as a full stop, where either kind
of tokenizer begins a new piece.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

from aislefix.llm.cells import _WHITE, TextSlice, span_codes, word_spans

#: Distinct parts whose ids a Python worker keeps, in each of two generations; about 200 bytes each.
MOST_KEPT = 400_000

# Letters that normalisation leaves alone and that stand for themselves in lower case; fixed by Unicode.
_PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?()")] = True
# First bytes of characters among which Unicode's wide spaces are.
_WIDE_LEAD = np.zeros(256, dtype=bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _break_kind(spec: dict) -> str:
    before = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or spec.get("post_processor"):
        return "none"
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "none" if spec.get("normalizer") else "leading"
    steps = before.get("pretokenizers", [])
    if len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
        words = steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        spaced = "[^\\s" in steps[0]["pattern"].get("Regex", "")
        return "dropped" if words and spaced else "none"
    return "none"


class Encoder:
    """Encodes slices of texts; one per worker process and file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.breaks = _break_kind(spec)
        added = "".join(x["content"] for x in spec.get("added_tokens", ()))
        self.mark_breaks = self.breaks != "none" and not any(_MARK[b] for b in added.encode())
        self.lower = bool(spec.get("normalizer"))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(32, 256) if c < 127 or c >= 192]
        self.mapped = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _merged(self, part: bytes) -> bytes | None:
        """Ids of a part that is one piece of plain letters, straight from the merges; None for any other."""
        if part.isalpha():  # ASCII
            piece = (part.lower() if self.lower else part).decode()
        else:
            plain = _PLAIN.fullmatch(part.decode(errors="replace"))
            if plain is None or (plain[1] and self.breaks != "leading"):
                return None
            piece = (plain[2].lower() if self.lower else plain[0]).translate(self.mapped)
        return array("I", [token.id for token in self.model.tokenize(piece)]).tobytes()

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, as bytes of unsigned 32-bit integers."""
        look, older = self.young.get, self.old.get
        found = [look(part) or older(part) for part in parts]
        rest = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = found[i] = self._merged(parts[i])
                if ids is None:
                    rest.append(i)
                    continue
                self._keep(parts[i], ids)
        for at in range(0, len(rest), 2000):
            some = rest[at : at + 2000]
            texts = [parts[i].decode(errors="replace") for i in some]
            for i, encoding in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                found[i] = array("I", encoding.ids).tobytes()
                if len(parts[i]) <= 64:
                    self._keep(parts[i], found[i])
        return found

    def _keep(self, part: bytes, ids: bytes) -> None:
        if len(self.young) >= MOST_KEPT:
            self.young, self.old = {}, self.young
        self.young[part] = ids

    def _spans(self, part: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, size = part.data, len(part.data)
        begins, ends = np.zeros(size + 1, dtype=bool), np.zeros(size + 1, dtype=bool)
        if self.breaks == "dropped":
            starts, stops, _ = word_spans(data, part.offsets)
            begins[starts] = True
            ends[stops] = True
        else:
            begins[part.offsets[:-1]] = True
            begins[size] = False
        if self.breaks == "leading" and size > 2:
            begins[:size] |= _leading_breaks(data)
        if self.mark_breaks and size > 1:
            turns = _LETTER[data[:-1]] & _MARK[data[1:]]
            begins[1:size] |= turns
            ends[1:size] |= turns
        starts = np.flatnonzero(begins)
        stops = np.flatnonzero(ends) if self.breaks == "dropped" else np.append(starts[1:], size)[: len(starts)]
        return starts, stops, np.searchsorted(starts, part.offsets)

    def encode(self, part: TextSlice, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice (uint32) and the offsets of its texts in them; ``end_id`` closes each text."""
        starts, ends, first = self._spans(part)
        codes, values = span_codes(part.data, starts, ends)
        parts = self._parts(values.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), np.uint32)
        pool_at = np.concatenate([[0], np.cumsum(sizes)])
        lengths = sizes[codes]
        ends_at = np.cumsum(lengths)
        before = np.concatenate([[0], ends_at])
        closing = int(end_id is not None)
        offsets = before[first] + closing * np.arange(len(first))
        source = np.arange(before[-1]) + np.repeat(pool_at[codes] - before[:-1], lengths)
        ids = pool[source]
        if not closing:
            return ids, offsets
        result = np.full(offsets[-1], end_id, np.uint32)
        open_places = np.ones(len(result), dtype=bool)
        open_places[offsets[1:] - 1] = False
        result[open_places] = ids
        return result, offsets


def _leading_breaks(data: np.ndarray) -> np.ndarray:
    """Which places a part may begin at without a piece going over them.

    A space or line break counts only between two characters that are surely not
    white space; the lead bytes and ends of Unicode's wide spaces are left out.
    """
    ink = ~_WHITE[data]
    wide = _WIDE_LEAD[data]
    sure_next = ink & ~wide
    sure_before = sure_next.copy()
    for back in (1, 2):
        sure_before[back:] &= ~wide[:-back]
    single = sure_before[:-2] & sure_next[2:]
    result = np.zeros(len(data), dtype=bool)
    lines = single & (data[1:-1] == 10)
    result[1:-1] = lines | (single & (data[1:-1] == 32))
    result[2:] |= lines
    return result


@cache
def encoder(path: str) -> Encoder:
    """The encoder of this process for a file."""
    return Encoder(path)
