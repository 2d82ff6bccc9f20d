"""Token ids of whole texts by a public tokenizer, with repeated pieces encoded once."""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbytes import ragged

# Spaces before these, or at the end of a text, may belong to a longer token: such texts are encoded whole.
_ODD = "\x01| (?:[ \\t\\n\\v\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"
_LETTERS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
_PLAIN = re.compile(f"( ?{_LETTERS})([,.;:!?]?)(?:\n({_LETTERS})([,.;:!?]?))?")
# byte-level alphabets show printable bytes as themselves and the others, in order, from code point 256 on
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """Encode texts piece by piece: no token of these tokenizers crosses the start of a single space.

    The pieces between single spaces (each with the space before it) are encoded by the
    tokenizers library once and kept; when more than `keep` are known, the half met most
    often stays. Plain letters are one word to these tokenizers and go straight to the
    library's model, a mark after them or a line break before more letters is a word of its
    own; other pieces are encoded by the library in full. Texts in which a space meets other white space are given to the
    library whole. Special tokens are never added, and their strings in a text are ordinary text.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.lower = self.library.normalizer is not None  # the vocabulary with word ends drops spaces and case
        self.keep = keep
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros((1 << 16) + 1, np.int64)
        self.met = np.zeros(1 << 16, np.int64)

    def _put(self, pieces: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first, used = len(self.known), self.ends[len(self.known)]
        while first + len(pieces) > len(self.met):
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) - 1, np.int64)])
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(flat)] = flat
        self.ends[first + 1 : first + len(pieces) + 1] = used + np.cumsum(sizes)
        self.known.update(zip(pieces, range(first, first + len(pieces))))

    def _thin(self) -> None:
        n = len(self.known)
        stay = np.argsort(-self.met[:n], kind="stable")[: self.keep // 2]
        names, sizes, met = list(self.known), np.diff(self.ends)[stay], self.met[stay]
        flat = self.ids[ragged(self.ends[stay], sizes)]
        self.known = {}
        self._put([names[i] for i in stay], flat, sizes)
        self.met[:n] = 0
        self.met[: len(stay)] = met

    def _word(self, piece: str) -> list[int]:
        word = piece.strip(" ").lower() if self.lower else piece
        shown = word.replace(" ", chr(_BYTES[32])) if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.model.tokenize(shown)]

    def _add(self, pieces: list[str]) -> None:
        marks = {m: self.library.encode(m, add_special_tokens=False).ids for m in ",.;:!?"}
        marks[""], line = [], self.library.encode("\n", add_special_tokens=False).ids
        stems: dict[str, list[int]] = {}
        got: list[list[int] | None] = []
        whole: list[int] = []

        def stem(word: str) -> list[int]:
            if (ids := stems.get(word)) is None:
                at = self.known.get(word)
                ids = stems[word] = self._word(word) if at is None else self.ids[self.ends[at] : self.ends[at + 1]].tolist()
            return ids

        for i, piece in enumerate(pieces):
            if m := _PLAIN.fullmatch(piece):
                word, mark, after, last = m.groups()
                ids = stem(word) + marks[mark] if mark else stem(word)
                got.append(ids + line + stem(after) + marks[last] if after else ids)
            else:
                whole.append(i)
                got.append(None)
        for i in range(0, len(whole), 2048):
            part = whole[i : i + 2048]
            for j, e in zip(part, self.library.encode_batch_fast([pieces[j] for j in part], add_special_tokens=False)):
                got[j] = e.ids
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self._put(pieces, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), and n + 1 offsets. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        plain = pc.if_else(odd, "", texts)
        lists = pc.split_pattern(pc.replace_substring(plain, " ", "\x01 "), "\x01")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > self.keep:
            self._thin()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        place[new] = np.arange(len(self.known), len(self.known) + len(new))
        gc.disable()  # very many small lists, all short-lived
        self._add([distinct[i] for i in new])
        gc.enable()
        self.met[place] += 1
        n = len(self.known)
        store = pa.LargeListArray.from_arrays(pa.array(self.ends[: n + 1]), pa.array(self.ids[: self.ends[n]]))
        each = store.take(pa.array(place[words.indices.to_numpy(zero_copy_only=False)]))
        ids = each.flatten().to_numpy(zero_copy_only=False)
        ends = each.offsets.to_numpy(zero_copy_only=False)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = (ends - ends[0])[np.concatenate([[0], np.cumsum(counts)])]
        if not pc.any(odd).as_py():
            return ids, offsets
        rows = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            rows[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; it lives as long as the worker."""
    return Encoder(path)
