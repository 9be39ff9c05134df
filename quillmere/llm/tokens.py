"""Ids of whole texts, looked up word by word in a table of words already encoded."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa

from quillmere.llm.common import give_back, kept_by_worker, prefix_sums, slices, span_hashes, utf8

#: What a byte is: 0 a blank that the tokenizer's splits never cross, and of ASCII 1 a letter, 2 a digit, 3 a sign, 4 the apostrophe; 5 any other.
_KIND = np.full(256, 5, np.uint8)
_KIND[[32, 9, 10, 13]] = 0
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 4
_LATIN = 6  # the last byte of a letter of Latin-1
#: Whether a word begins between bytes of two kinds (8 * the first + the second): after a blank, at a digit, and where letters of ASCII or Latin-1 end or those of ASCII follow a sign.
_CUT = np.zeros(64, np.uint8)
_CUT[[1, 2, 3, 4, 5, 6, *(8 * k + 2 for k in range(1, 7)), *(8 * k + j for k in (1, 2, 6) for j in (3, 4)), 17, 25]] = 1
_KINDS, _CUTS = _KIND.tobytes(), _CUT.tobytes().ljust(256, b"\0")
_LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte."""
    kind = np.frombuffer(bytearray(data.tobytes().translate(_KINDS)), np.uint8)
    kind[1:] += (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (kind[1:] == 5)
    return kind


def cut_words(data: np.ndarray, offsets: np.ndarray, fine: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer of texts, the kinds of its bytes, and each text's first word (n + 1).

    Words end at space, tab, newline and carriage return and, as the tokenizer cuts there as
    well, where _CUT says. Tokens like <|endoftext|> are kept whole only if `fine` is not set:
    then words end at blanks and before a comma or full stop that follows a letter or digit.
    """
    kind = kinds(data)
    begins = np.zeros(len(data) + 1, bool)
    if not len(data):
        pass
    elif fine:
        pairs = kind[:-1] << 3 | kind[1:]
        begins[1:-1] = np.frombuffer(pairs.tobytes().translate(_CUTS), bool)
    else:
        point = (data[1:] == 44) | (data[1:] == 46)
        begins[1:-1] = (kind[:-1] == 0) | (point & ((kind[:-1] == 1) | (kind[:-1] == 2)))
    begins[offsets] = True
    inside = kind != 0
    ends = begins[1:].copy()
    ends[:-1] |= ~inside[1:]
    ends &= inside
    begins = begins[:-1]
    begins &= inside
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, kind, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; `data` has eight bytes more than places."""
    return np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 8,), (1,), writeable=False)


#: Which bits of eight bytes the first 0 to 8 have.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places begin[i], begin[i] + 1, ... of length[i] each, one after the other."""
    total = int(length.sum())
    out = np.arange(total)
    out += np.repeat(begin - (np.cumsum(length) - length), length)
    return out


class Words:
    """A bounded memory of words and their ids, found by hash and compared byte by byte.

    Words are rows of growing arrays; an open-addressed table of 64-bit hashes finds their row.
    It starts anew when it holds `keep` words or `keep_bytes` bytes of them. Row 0 stands for
    the end of a text.
    """

    def __init__(self, path: str, end_id: int | None = None, keep: int = 400_000, keep_bytes: int = 1 << 23):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id, self.keep, self.keep_bytes = Tokenizer.from_file(path), end_id, keep, keep_bytes
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.plain = Tokenizer(self.tokenizer.model)  # for lower-case letters of ASCII, which nothing but the model changes
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._forget(0)

    def _forget(self, room: int) -> None:
        """Start anew, with room for `room` words at least."""
        self.slots = 1 << (4 * max(self.keep, room)).bit_length()
        self.rows = np.zeros(self.slots, np.int32)  # 0: free
        self.hashes = np.zeros(1 << 16, np.uint64)
        self.place, self.ids_at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)  # where a row's bytes and ids begin; the next row's begin where they end
        self.body, self.ids = np.zeros((1 << 20) + 8, np.uint8), np.zeros(1 << 18, np.uint32)
        self.n = 1
        if self.end_id is not None:
            self.ids[0] = self.end_id
            self.ids_at[1] = 1

    @staticmethod
    def _grown(x: np.ndarray, size: int) -> np.ndarray:
        return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of words with these hashes; 0 where there is none."""
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        out = self.rows[slot]
        open_ = np.flatnonzero((out != 0) & (self.hashes[out] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.slots
            found = self.rows[slot[open_]]
            out[open_] = found
            open_ = open_[(found != 0) & (self.hashes[found] != hashes[open_])]
        return out

    def _together(self, tokenizer, texts: list[str], count: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters with single blanks between them, and how many each has: it ends with its only id that ends a word. None if they are not `count`."""
        ids = np.frombuffer(b"".join(array("I", x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == count else None

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [array("I", x.ids) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.frombuffer(b"".join(ids), np.uint32), np.array([len(x) for x in ids], np.int64)

    def _encoded(self, data: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the words, and in that order their ids laid end to end and how many each has."""
        size = ends - starts
        place = spread(starts, size)
        ascii_ = (data[place] >= 97) & (data[place] <= 122)
        letters = (kind[place] == 1) | (kind[place] == _LATIN) | (data[place] == 0xC3)  # other signs that begin with this byte do not end with a letter's
        ascii_, letters = (np.logical_and.reduceat(x, np.cumsum(size) - size) & (size <= 200) if len(size) else x for x in (ascii_, letters))
        order, ids, lengths = [], [], []

        def put(chosen: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> None:
            order.append(chosen)
            ids.append(found[0])
            lengths.append(found[1])

        word = lambda k: data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")
        alike = ((tokenizer, chosen[at : at + 3000]) for tokenizer, chosen in ((self.plain, np.flatnonzero(ascii_)), (self.tokenizer, np.flatnonzero(letters & ~ascii_))) for at in range(0, len(chosen), 3000))
        for tokenizer, part in alike:
            room = np.cumsum(size[part] + 1)
            joined = np.full(int(room[-1]), 32, np.uint8)
            joined[spread(room - size[part] - 1, size[part])] = data[spread(starts[part], size[part])]
            cuts = [0, *room[59:-1:60].tolist(), len(joined)]  # short texts take the tokenizer less time a word
            texts = [joined[i : j - 1].tobytes().decode() for i, j in zip(cuts, cuts[1:], strict=False)]
            put(part, self._together(tokenizer, texts, len(part)) or self._one_by_one([word(k) for k in part]))
        rest = np.flatnonzero(~letters)
        put(rest, self._one_by_one([word(k) for k in rest]))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, data: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Take up words whose hashes are new and differ."""
        order, ids, lengths = self._encoded(data, kind, starts, ends)
        starts, hashes, size = starts[order], hashes[order], (ends - starts)[order]
        n, m = self.n, self.n + len(starts)
        self.hashes, self.place, self.ids_at = (self._grown(x, m + 1) for x in (self.hashes, self.place, self.ids_at))
        self.hashes[n:m] = hashes
        self.place[n + 1 : m + 1] = self.place[n] + np.cumsum(size)
        self.ids_at[n + 1 : m + 1] = self.ids_at[n] + np.cumsum(lengths)
        self.body, self.ids = self._grown(self.body, int(self.place[m]) + 8), self._grown(self.ids, int(self.ids_at[m]))
        self.body[self.place[n] : self.place[m]] = data[spread(starts, size)]
        self.ids[self.ids_at[n] : self.ids_at[m]] = ids
        left, slot = np.arange(n, m), (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):  # of those that want the same free slot the last has it
            free = self.rows[slot] == 0
            self.rows[slot[free]] = left[free]
            over = self.rows[slot] != left
            left, slot = left[over], (slot[over] + 1) % self.slots
        self.n = m

    def _differ(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which words are not those of the rows, byte by byte; `data` has eight bytes more than the texts."""
        at = self.place[rows]
        out = self.place[rows + 1] - at != size
        own, kept = eights(data), eights(self.body)
        out |= (own[starts] ^ kept[at]) & _FIRST[np.minimum(size, 8)] != 0
        left, done = np.flatnonzero((size > 8) & ~out), 8
        while len(left) and done < 64:
            other = (own[starts[left] + done] ^ kept[at[left] + done]) & _FIRST[np.minimum(size[left] - done, 8)] != 0
            out[left[other]] = True
            done += 8
            left = left[~other & (size[left] > done)]
        if len(left):
            other = np.flatnonzero(data[spread(starts[left], size[left])] != self.body[spread(at[left], size[left])])
            out[left[np.searchsorted(np.cumsum(size[left]), other, "right")]] = True
        return out

    def _encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        fine = b"<|" not in raw  # the tokenizer lower-cases all but its special tokens
        padded = np.frombuffer((raw.translate(_LOWERED) if fine else raw) + bytes(8), np.uint8)
        data = padded[:-8]
        starts, ends, kind, first = cut_words(data, offsets, fine)
        hashes = span_hashes(prefix_sums(data), starts, ends)
        rows = self._find(hashes)
        unknown = np.flatnonzero(rows == 0)
        if len(unknown):
            new = unknown[np.unique(hashes[unknown], return_index=True)[1]]
            if self.n + len(new) > self.keep or self.place[self.n] + int((ends[new] - starts[new]).sum()) > self.keep_bytes:
                new = np.unique(hashes, return_index=True)[1]
                self._forget(len(new))
                unknown = np.arange(len(hashes))
            self._learn(data, kind, starts[new], ends[new], hashes[new])
            rows[unknown] = self._find(hashes[unknown])
        wrong = self._differ(padded, starts, ends - starts, rows)
        ids_at, rows = self.ids_at, rows.astype(np.int64)
        begin, length = ids_at[rows], ids_at[rows + 1] - ids_at[rows]
        ids = self.ids
        if wrong.any():  # other words have their hash
            bad = np.flatnonzero(wrong)
            order, own, n = self._encoded(data, kind, starts[bad], ends[bad])
            length[bad[order]] = n
            begin[bad[order]] = ids_at[self.n] + np.cumsum(n) - n
            ids = np.concatenate([ids[: ids_at[self.n]], own])
        if self.end_id is not None:
            begin, length = np.insert(begin, first[1:], 0), np.insert(length, first[1:], 1)
            first = first + np.arange(len(first))
        total = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        return ids[spread(begin, length)], total[first]

    def encode(self, column: pa.Array, limit: int = 1 << 18):
        """Ids of a column's whole texts (null: empty), by slices: (first row, ids, offsets of its rows in them)."""
        data, offsets = utf8(column)
        for i, j in slices(offsets, limit):
            yield i, *self._encode_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


_memory: dict[tuple, Words] = kept_by_worker.setdefault("words", {})


def words_of(path: str, end_id: int | None = None, keep: int = 400_000, keep_bytes: int = 1 << 23) -> Words:
    """The memory of words of this worker process, which its tasks share. What earlier work of the process left unused goes back first."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = path, end_id, keep, keep_bytes
    if key not in _memory:
        _memory.clear()
        give_back()
        _memory[key] = Words(path, end_id, keep, keep_bytes)
    return _memory[key]
