"""Cached encoding with a tokenizer file.

Both supported pre-tokenizers always start a new piece at a space that stands between two
other characters, and where letters end, so the ids of a text are the ids of its
space-separated chunks in a row, and those of a chunk "word," are those of "word" and ",".
Chunks and words recur, so each worker process keeps their ids and calls the tokenizer for
new ones only. New words go to it as one text; its ids fall apart again at the tokens that
begin (or end) a word.

What is known is kept in flat arrays: an open-addressing table from a chunk's 64-bit hash to
its place, its length (compared as well) and its ids. That is about 40 bytes a chunk, of
fixed size in all.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np

#: Slots of the table, chunks and ids that it may hold; beyond that it is emptied.
SLOTS, MOST_CHUNKS, MOST_IDS = 1 << 21, 1_300_000, 7_000_000
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: What may follow a word's letters in a chunk.
TAIL = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
#: Mark of a text's first chunk; no UTF-8 text has this character.
FIRST = "\ud800"
#: White space that a byte-level pre-tokenizer may keep together: two in a row, but for a line break and one more before a word.
BLANK = re.compile(r"(?!(?<!\s)\n[\n ](?!\s|\Z))\s\s|\A\s|\s\Z")
OTHER_SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]
ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """The encoder of this worker process, with what it already knows."""
    if (path, spaced) not in ENCODERS:
        ENCODERS[path, spaced] = ChunkEncoder(path, spaced)
    return ENCODERS[path, spaced]


class Known:
    """hash and length of a chunk -> its ids."""

    def __init__(self, dtype: np.dtype, slots: int, most: int, most_ids: int):
        self.dtype, self.slots, self.most, self.most_ids = dtype, slots, most, most_ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int32)
        self.starts, self.counts, self.sizes = np.zeros(self.most, np.int32), np.zeros(self.most, np.int32), np.zeros(self.most, np.int32)
        self.pool = np.zeros(self.most_ids, self.dtype)
        self.used = self.used_ids = 0

    def find(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The place of each chunk, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        todo = np.arange(len(hashes))
        slot = hashes & (self.slots - 1)
        while len(todo):
            there = self.keys[slot]
            hit = there == hashes[todo]
            found = todo[hit]
            places = self.at[slot[hit]]
            out[found] = np.where(self.sizes[places] == sizes[found], places, -1)
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: list[bytes]) -> bool:
        """Adds distinct chunks, or says that there is no room."""
        raw = np.frombuffer(b"".join(ids), self.dtype)
        n = len(ids)
        if self.used + n > self.most or self.used_ids + len(raw) > self.most_ids:
            return False
        own = slice(self.used, self.used + n)
        counts = np.fromiter(map(len, ids), np.int32, n) // self.dtype.itemsize
        self.counts[own], self.sizes[own] = counts, sizes
        self.starts[own] = self.used_ids + np.cumsum(counts) - counts
        self.pool[self.used_ids : self.used_ids + len(raw)] = raw
        todo, slot = np.arange(n), hashes & (self.slots - 1)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[todo[free]]
            self.at[slot[free]] = self.used + todo[free]
            done = free & (self.at[slot] == self.used + todo) & (self.keys[slot] == hashes[todo])
            todo, slot = todo[~done], slot[~done]
            full = self.keys[slot] != 0
            slot = np.where(full, (slot + 1) & (self.slots - 1), slot)
        self.used, self.used_ids = self.used + n, self.used_ids + len(raw)
        return True

    def gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        counts = self.counts[places].astype(np.int64)
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.starts[places] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts


def hashed(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = len(chunks)
    h = np.fromiter(map(hash, chunks), np.int64, n)
    h[h == 0] = 1
    return h, np.fromiter(map(len, chunks), np.int32, n)


class ChunkEncoder:
    """Texts to ids, chunk by chunk.

    ``spaced``, for byte-level BPE: a chunk has its space or line break before it. Texts with
    other white space than one space or one or two line breaks between words, or with a
    special token, are encoded whole. Else white space is dropped and a word's last token
    ends in </w>.
    """

    def __init__(self, path: str, spaced: bool, slots: int = SLOTS, most: int = MOST_CHUNKS, most_ids: int = MOST_IDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.edge = np.array([(t or "").startswith("Ġ") if spaced else (t or "").endswith("</w>") for t in map(self.tokenizer.id_to_token, range(size))])
        self.known = Known(self.dtype, slots, most, most_ids)
        self.newline = self.ids(["\n"])[0]

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bool:
        """Whether a text has to be encoded in one piece."""
        if not self.spaced:
            return False
        return bool((len(text.split()) != text.count(" ") + text.count("\n") + 1 or any(c in text for c in OTHER_SPACES)) and BLANK.search(text) or any(t in text for t in self.special))

    def chunks(self, text: str) -> list[str]:
        return (FIRST + text.replace("\n", " \n")).split(" ") if self.spaced else text.replace("\n", " ").split(" ")

    def text_of(self, chunk: str) -> str:
        if not self.spaced or chunk[:1] == "\n":
            return chunk
        return chunk[1:] if chunk[:1] == FIRST else " " + chunk

    def learned(self, new: list[str]) -> list[bytes]:
        """The ids of chunks that are not known."""
        out: dict[str, bytes] = {"": b""}
        split, words, starts, tails, rest = [], {}, {}, {}, []
        before = {"\n": self.newline, FIRST: b""} if self.spaced else {}
        for chunk in new:
            if chunk.isalpha() and (self.spaced or chunk.islower()):
                words[chunk] = None
                continue
            mark = chunk[:1] if chunk[:1] in before else ""
            stem = chunk.rstrip(TAIL)
            word, tail = stem[len(mark) :], chunk[len(stem) :]
            if not word.isalpha() or not (self.spaced or word.islower() or LATIN.fullmatch(word)):
                rest.append(chunk)
                continue
            if not self.spaced:
                word = word.lower()
            split.append((chunk, mark, word, tail))
            (starts if mark else words)[word] = None
            tails[tail] = None
        out.update(zip(rest, self.ids([self.text_of(c) for c in rest]), strict=True))
        wanted = list(words)
        at = self.known.find(*hashed(wanted)) if wanted else np.empty(0, np.int32)
        flat, counts = self.known.gathered(at[at >= 0])
        have, raw, size, a = {}, flat.tobytes(), self.dtype.itemsize, 0
        for word, b in zip((wanted[i] for i in np.flatnonzero(at >= 0)), (np.cumsum(counts) * size).tolist(), strict=True):
            have[word], a = raw[a:b], b
        self.joined([w for w in wanted if w not in have], have, " ")
        begun: dict[str, bytes] = {}
        self.joined(list(starts), begun, "\n")
        ends = dict(zip(tails, self.ids(list(tails)), strict=True))
        for chunk, mark, word, tail in split:
            out[chunk] = (before[mark] + begun[word] if mark else have[word]) + ends[tail]
        return [out[c] if c in out else have[c] for c in new]

    def joined(self, words: list[str], into: dict[str, bytes], between: str) -> None:
        """Ids of words of letters, as they are after ``between``, from one text of many."""
        size = self.dtype.itemsize
        for at in range(0, len(words), 2_000):
            part = words[at : at + 2_000]
            lead = " " if self.spaced and between == " " else ""
            raw = self.ids([lead + between.join(part)])[0]
            ids = np.frombuffer(raw, dtype=self.dtype)
            if between == "\n":
                cuts = np.flatnonzero(ids == np.frombuffer(self.newline, dtype=self.dtype)[0])
                starts, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
            else:
                cuts = np.flatnonzero(self.edge[ids])
                starts, ends = (cuts, np.append(cuts[1:], len(ids))) if self.spaced else (np.append(0, cuts[:-1] + 1), cuts + 1)
            if len(ends) == len(part):
                into.update((w, raw[a:b]) for w, a, b in zip(part, (starts * size).tolist(), (ends * size).tolist(), strict=True))
            else:  # not as expected of such words
                into.update(zip(part, self.ids([lead + w for w in part]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, of type ``dtype``."""
        whole = [self.whole(t) for t in texts]
        split = [[] if w else self.chunks(t) for t, w in zip(texts, whole, strict=True)]
        flat = list(chain.from_iterable(split))
        hashes, sizes = hashed(flat)
        places = self.known.find(hashes, sizes)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            _, first = np.unique(hashes[missing], return_index=True)
            new = missing[first]
            if not self.known.add(hashes[new], sizes[new], self.learned([flat[i] for i in new.tolist()])):
                if not self.known.used:  # more at once than there is room for
                    return [np.frombuffer(x, self.dtype) for t in texts for x in self.ids([t])]
                self.known.clear()
                return self.encode(texts)
            places[missing] = self.known.find(hashes[missing], sizes[missing])
            clash = {t for t, own in zip(range(len(texts)), np.split(places, np.cumsum([len(c) for c in split])[:-1]), strict=True) if (own < 0).any()} if (places < 0).any() else set()
            whole = [w or t in clash for t, w in enumerate(whole)]
        ids, counts = self.known.gathered(np.maximum(places, 0))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(c) for c in split])]
        out, a = [], 0
        for text, one, b in zip(texts, whole, ends.tolist(), strict=True):
            out.append(np.frombuffer(self.ids([text])[0], self.dtype) if one else ids[a:b])
            a = b
        return out


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
