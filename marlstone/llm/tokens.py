"""Whole-text tokenizing with a public byte-level vocabulary, with exact reuse of repeated words.

The pre-tokenizer of byte-level BPE never joins a character to a space that stands after it, unless white space meets white
space. So a text whose spaces and line feeds all stand alone between other characters can be cut before each of them, after each
line feed, and where a run of letters ends; the ids of the pieces follow each other as the ids of the whole. Pieces repeat, so
their ids are kept in a table of bounded size. Pieces are found and told apart in the Arrow buffers of a batch of texts: only
those that are new to the table become Python objects. Texts with other white space or an added token are one piece.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_buffers

VOCABULARY = "byte_bpe_50k.json"
#: White space other than space and line feed, as any pattern may define it.
OTHER_SPACE = "[%s]" % "".join(map(chr, (*range(9, 10), *range(11, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
#: Spaces and line feeds that do not stand alone between other characters.
LOOSE_SPACE = r"\A[ \n]|[ \n][ \n]|[ \n]\z"
#: Id 0, the end of a document.
END = 0
#: Pieces worked on at once, and bytes of the longest that are kept for other batches.
AT_ONCE, LONGEST = 1 << 20, 64
#: What a byte can be: a letter of ASCII, another character of ASCII, a space or line feed, a line feed, the second and the first byte of a letter from U+00C0 to U+00FF.
LETTER, OTHER, SPACE, FEED, SECOND, FIRST = (1 << k for k in range(6))
KINDS = bytes((LETTER if chr(b).isalpha() else OTHER | SPACE * (b in b" \n") | FEED * (b == 10)) if b < 128 else SECOND * (b < 192 and b not in (0x97, 0xB7)) | FIRST * (b == 0xC3) for b in range(256))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether UTF-8 bytes may be cut before each of them: at a space, around a line feed, and at an ASCII character after a letter."""
    kinds = np.frombuffer(data.tobytes().translate(KINDS), np.uint8)
    here, before = kinds[1:], kinds[:-1]
    letter = (kinds & LETTER).astype(bool)
    letter[1:] |= (here & SECOND).astype(bool) & (before & FIRST).astype(bool)
    cut = (kinds & SPACE).astype(bool)
    cut[1:] |= (before & FEED).astype(bool) | letter[:-1] & (here & OTHER).astype(bool)
    return cut


class Encoder:
    """Ids of whole texts; most_kept bounds the table of pieces. A null or empty text has no ids."""

    def __init__(self, path: str | None = None, most_kept: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        # texts that hold an added token are encoded whole: the tokenizer takes such tokens out before all else
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.words = [a for a in added if a.strip().isalpha()]
        self.odd = "|".join([LOOSE_SPACE, OTHER_SPACE, *map(re.escape, added)])
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits an id")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.most_kept = most_kept
        self._clear()

    def _clear(self) -> None:
        self.kept: dict[bytes, int] = {}  # the number of a piece
        self.flat, self.stops = np.empty(0, np.uint16), np.zeros(1, np.int64)  # ids of all pieces by number, and where each piece's end

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: np.ndarray) -> None:
        """Number pieces that are new to the table, those of LONGEST bytes or less first."""
        ids: list[int] = []
        stops: list[int] = []
        tokenize, space = self.model.tokenize, self.letters[32]
        for piece in pieces:
            text = piece.decode()
            if text.removeprefix(" ").isalpha() and not (self.words and any(w in text for w in self.words)):
                ids += [t.id for t in tokenize(text.replace(" ", space) if text.isascii() else piece.decode("latin1").translate(self.letters))]
            else:
                ids += self.whole(text)
            stops.append(len(ids))
        self.kept.update((p, k) for k, p in enumerate(pieces, len(self.stops) - 1) if len(p) <= LONGEST)
        self.stops = np.concatenate([self.stops, len(self.flat) + np.array(stops, np.int64)])
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint16)])

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, given as bytes and n + 1 bounds, and how many each has."""
        found = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.kept.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(numbers < 0)
        long = np.fromiter(map(len, distinct[new]), np.int64, len(new)) > LONGEST
        new = np.concatenate([new[~long], new[long]])  # long ones leave the table's end again
        numbers[new] = np.arange(len(new)) + len(self.stops) - 1
        if len(new):
            self._learn(distinct[new])
        which = found.indices.to_numpy()
        counts = (self.stops[numbers + 1] - self.stops[numbers])[which]
        shift = self.stops[numbers][which] - (np.cumsum(counts) - counts)
        ids = self.flat[np.repeat(shift, counts) + np.arange(int(counts.sum()))]
        if len(self.kept) > self.most_kept:
            self._clear()
        elif long.any():
            self.stops = self.stops[: len(self.kept) + 1]
            self.flat = self.flat[: self.stops[-1]].copy()
        return ids, counts

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The 16-bit ids of all texts, one after the other, and the n + 1 offsets of each text's."""
        data, offsets = text_buffers(texts)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return np.empty(0, np.uint16), np.zeros(len(offsets), np.int64)
        cut = cuts(data)
        for k in np.flatnonzero(pc.match_substring_regex(texts, self.odd).fill_null(False).to_numpy(zero_copy_only=False)):
            cut[offsets[k] : offsets[k + 1]] = False
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        begins = np.flatnonzero(cut)
        bounds = np.append(begins, len(data))
        ids, counts = zip(*[self._pieces(data, bounds[at : at + AT_ONCE + 1]) for at in range(0, len(begins), AT_ONCE)], strict=True)
        stops = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), stops[np.searchsorted(begins, offsets)]

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ids, with the end id behind each text's."""
        ids, offsets = self.ids(texts)
        return np.insert(ids, offsets[1:], END), offsets + np.arange(len(offsets))

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian bytes."""
        return self.ids(pa.array([text], pa.string()))[0].astype("<u2").tobytes()


@lru_cache(maxsize=1)
def shared_encoder(path: str | None = None) -> Encoder:
    """One encoder a worker process: its table serves the tasks that follow."""
    return Encoder(path)


def crc(ids: np.ndarray, value: int = 0) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers, carried on from value."""
    return zlib.crc32(ids.astype("<u4").tobytes(), value)
