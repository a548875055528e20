"""Tokenizing whole texts with the ``tokenizers`` library.

A text is cut where its pre-tokenizer always cuts, each distinct piece is
parted into its letters and signs, each distinct part is encoded once per
Python worker and the ids are gathered back.  Where such a cut isn't safe the
whole text goes through the library.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textkit as tk

#: Distinct parts that a worker remembers; once it is full, new ones are encoded for their slice alone.
REMEMBER = 600_000
#: Bytes of text encoded at once; parts of a call.
SLICE, CALL = 6 << 20, 4096
_SIGNS = r"[!-&(-/:-@\[-^`{-~]"
#: Letters and signs that both pre-tokenizers always part: no digits, apostrophes or marks; signs of ASCII only.
PARTS = {
    "words": rf"^(?P<a>\p{{L}}+)(?P<b>{_SIGNS}+)$",
    "spaces": rf"^(?P<a> ?\p{{L}}+)(?P<b>{_SIGNS}+)?(?:(?P<c>\n)(?P<d>\p{{L}}+)(?P<e>{_SIGNS}+)?)?$",
}
_READY: dict[tuple[str, str], "Encoder"] = {}


def encoder(path: str, cut: str) -> "Encoder":
    """The worker's encoder of a vocabulary file, kept between tasks."""
    if (path, cut) not in _READY:
        _READY[path, cut] = Encoder(path, cut)
    return _READY[path, cut]


class Encoder:
    """``cut``: ``words`` for vocabularies that drop white space, ``spaces`` for byte-level ones."""

    def __init__(self, path: str, cut: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Added tokens are found in whole texts, before they are cut.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether an id ends a word, in vocabularies that mark it.
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.cut = cut
        self.known: dict[str, int] = {"": 0}  # slots of parts
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.runs = np.zeros((1 << 15, 2), np.int64)  # start and length in ids, by slot

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _hold(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        slot, to = len(self.known), len(self.known) + len(parts)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(ids) + len(self.ids), np.int32)])
        if to > len(self.runs):
            self.runs = np.concatenate([self.runs, np.zeros((len(parts) + len(self.runs), 2), np.int64)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.runs[slot:to, 0], self.runs[slot:to, 1] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.known.update(zip(parts, range(slot, to)))

    def _learn(self, fresh: list[str]) -> None:
        """Encode parts that aren't known: letters alone in one text, where the vocabulary marks the ends of words."""
        fresh.sort()
        alone = [x for x in fresh if x.isalpha()] if self.ends.any() else []
        for at in range(0, len(alone), CALL):
            part = alone[at : at + CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(part):  # else a letter becomes more than letters
                self._hold(part, ids, np.diff(ends, prepend=-1))
        rest = [x for x in fresh if x not in self.known]
        for at in range(0, len(rest), CALL):
            part = rest[at : at + CALL]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            self._hold(part, np.array(got.ids, np.int32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))

    def _pieces(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Code of each piece, offsets of the texts in them, the distinct pieces by code."""
        if self.cut == "words":
            codes, offsets, vocab = tk.words(text)
        else:
            lists = pc.split_pattern(text, " ")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.values.dictionary_encode()
            codes, vocab = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            first = np.zeros(len(codes), bool)
            first[offsets[:-1][np.diff(offsets) > 0]] = True
            codes = np.where(first, codes + len(vocab), codes)
            vocab = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(""), vocab, pa.scalar(" ")), vocab])
        used = np.flatnonzero(np.bincount(codes, minlength=len(vocab)))
        place = np.zeros(len(vocab), np.int64)
        place[used] = np.arange(len(used))
        vocab = vocab.take(pa.array(used))
        if self.cut == "words":
            vocab = pc.if_else(pc.string_is_ascii(vocab), pc.ascii_lower(vocab), vocab)
        return place[codes], offsets, vocab

    def encode(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text (null: empty), ``end`` after each; and the offsets of the texts in them."""
        text = odd_text = pc.fill_null(text, "")
        # texts with added tokens are encoded whole; runs of spaces are pieces of their own
        odd = np.zeros(len(text), bool)
        for x in self.added:
            odd |= pc.match_substring(text, x).to_numpy(zero_copy_only=False)
        if self.cut == "spaces":
            odd |= pc.match_substring(text, "  ").to_numpy(zero_copy_only=False)
        if odd.any():
            text = pc.if_else(pa.array(odd), "", text)
        codes, offsets, vocab = self._pieces(text)
        groups = pc.extract_regex(vocab, PARTS[self.cut]).flatten()
        groups = [pc.coalesce(groups[0], vocab), *(pc.fill_null(x, "") for x in groups[1:])]
        coded = pa.concat_arrays(groups).dictionary_encode()
        names = coded.dictionary.to_pylist()
        held = self.used, len(self.known)
        fresh = [x for x in names if x not in self.known]
        if fresh:
            self._learn(fresh)
        slots = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        slots = slots.reshape(len(groups), len(vocab)).T
        run, size = self.runs[slots, 0], self.runs[slots, 1]
        pieces = self.ids[tk.gather(run.ravel(), size.ravel())]
        size = size.sum(1)
        per = size[codes]
        ends = np.concatenate([[0], np.cumsum(per)])[offsets]  # ids of the texts before each text, without ends
        n = len(offsets) - 1
        out = np.full(int(ends[-1]) + n, end, np.int32)
        body = np.ones(len(out), bool)
        body[ends[1:] + np.arange(n)] = False
        out[body] = pieces[tk.gather((np.cumsum(size) - size)[codes], per)]
        at = ends + np.arange(n + 1)
        if held[1] > REMEMBER:
            for x in fresh:
                del self.known[x]
            self.used = held[0]
        if odd.any():
            rows = np.split(out, at[1:-1])
            for i in np.flatnonzero(odd):
                rows[i] = np.append(self.whole(odd_text[i].as_py()), np.int32(end))
            out, at = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return out, at

    def encode_whole(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, each whole text through the library; the plain form that tests compare with."""
        rows = [np.append(self.whole(x or ""), end) for x in text.to_pylist()]
        return np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
