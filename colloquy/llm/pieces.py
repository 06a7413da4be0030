"""Texts as pieces that a byte-level tokenizer treats apart, each encoded once.

The tokenizers here split a text before every space that another character than white space follows, and nothing before
that point bears on what follows. So a text is the stretch before its first space, and one piece for each space. Pieces
are told apart, counted and looked up column by column; only those not met before are encoded."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers at most.
REMEMBERED = 400_000
#: A space before white space or the end is no such point.
NO_PIECE = r"^$|^[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

Coded = tuple[np.ndarray, np.ndarray]


class Pieces:
    """encode: strings → all their ids (unsigned 32-bit) and how many each has. With ``True`` each string is a piece, which begins with a space and has no
    other; with ``False`` they are any texts."""

    def __init__(self, encode: Callable[[list[str], bool], Coded], remembered: int = REMEMBERED, whole: list[str] = ()):
        """whole: strings that may cross pieces; texts that hold one are encoded as they are."""
        self.encode, self.remembered, self.whole = encode, remembered, whole
        self.known = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def texts(self, texts: pa.Array) -> Coded:
        """All ids end to end, and where each text's begin, with the end."""
        texts = texts.cast(pa.large_string())
        lists = pc.split_pattern(texts, " ")
        places = lists.offsets.to_numpy()
        heads = lists.flatten().take(pa.array(places[:-1])).to_pylist()
        coded = lists.flatten().dictionary_encode()
        at, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        old = pc.index_in(pieces, value_set=self.known)
        is_new = pc.is_null(old).to_numpy(zero_copy_only=False)
        fresh = pieces.filter(pa.array(is_new))
        odd = pc.match_substring_regex(fresh, NO_PIECE).to_numpy(zero_copy_only=False)
        fresh = fresh.filter(pa.array(~odd))
        new_ids, new_sizes = self.encode([" " + p for p in fresh.to_pylist()], True)
        head_ids, head_sizes = self.encode(heads, False)

        # numbers: known pieces, new ones, heads, odd pieces' texts, nothing
        n_known, n_new = len(self.known), len(fresh)
        number = np.empty(len(pieces), np.int64)
        number[~is_new] = old.drop_null().to_numpy()
        of_new = np.full(len(odd), -1, np.int64)
        of_new[~odd] = n_known + np.arange(n_new)
        number[is_new] = of_new
        number = number[at]
        number[places[:-1]] = n_known + n_new + np.arange(len(heads))
        whole = np.zeros(0, np.int64)
        whole_ids, whole_sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        as_is = np.zeros(len(texts), bool)
        for token in self.whole:
            as_is |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if odd.any() or as_is.any():  # such texts in one go
            text_of = np.repeat(np.arange(len(texts)), np.diff(places))
            as_is[text_of[number < 0]] = True
            whole = np.flatnonzero(as_is)
        if len(whole):
            whole_ids, whole_sizes = self.encode(texts.take(pa.array(whole)).to_pylist(), False)
            number[np.isin(text_of, whole)] = n_known + n_new + len(heads) + len(whole)
            number[places[whole]] = n_known + n_new + len(heads) + np.arange(len(whole))
        values = np.concatenate((self.ids, new_ids, head_ids, whole_ids))
        size = np.concatenate((self.sizes, new_sizes, head_sizes, whole_sizes, [0]))
        begin = (np.cumsum(size) - size)[number]
        count = size[number]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        out = values[np.repeat((begin - (ends - count)).astype(np.int32), count) + np.arange(total, dtype=np.int32)]

        room = self.remembered - n_known
        if room > 0 and n_new:
            self.known = pa.concat_arrays([self.known, fresh.slice(0, room)])
            self.sizes = np.concatenate((self.sizes, new_sizes[:room]))
            self.ids = np.concatenate((self.ids, new_ids[: int(new_sizes[:room].sum())]))
        return out, np.concatenate(([0], ends))[places]
