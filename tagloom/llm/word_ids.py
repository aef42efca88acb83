"""Token ids of whole texts by a tokenizer file whose words are separated by white space.

Text is cut at spaces and line feeds only: neither normalization nor any pre-token of such a tokenizer reaches
across them. Each distinct chunk is encoded once per worker and kept in a bounded memo, so the library's work
follows the vocabulary and not the text. Tables of texts are cut by Arrow, so that Python sees each distinct word of
about SLICE_BYTES of text once, without case and closing punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Entries that each of a memo's two generations holds; a bound on memory, not on what is encoded.
MEMO_ENTRIES = 300_000
END_ID = (1).to_bytes(4, "little")
_PUNCTUATION = ".,!?;:|#*$%&()-"
#: Text that encode_all() should get at once: more holds more memory, less meets more words again.
SLICE_BYTES = 4 << 20
#: Letters of the first 256 code points and closing punctuation: what two pieces make up.
_PLAIN = r"^(?P<word>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,!?;:|#*$%&()\-]*)$"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in printable else next(other)) for b in range(256)]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First and last row (not included) of runs of whole texts that begin within the same `size` bytes."""
    own = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    window = (np.cumsum(own) - own) // size
    cuts = [0, *(np.flatnonzero(np.diff(window)) + 1).tolist(), len(own)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def _runs(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of a pool that begin at `starts`, one after another."""
    before = np.cumsum(lengths) - lengths
    at = np.repeat(starts - before, lengths)
    at += np.arange(len(at))
    return pool[at]


class Memo(dict):
    """A dictionary of bounded size: the older half goes when the younger is full, and what is used again stays."""

    def __init__(self, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.entries, self.old = entries, {}

    def keep(self, key, value):
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds(Memo):
    """Maps a chunk without spaces to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str = "word_bpe_49k.json", path: str | None = None):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(name))
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces = Memo()
        self.letters = _byte_letters()

    def _piece(self, word: str) -> bytes:
        """One pre-token, lower-cased already, through the library's model."""
        found = self.pieces.get(word)
        if found is None:
            found = self.pieces.old.get(word)
            if found is None:
                spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
                found = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(spelt)])
            self.pieces.keep(word, found)
        return found

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is not None:
            return self.keep(chunk, found)
        word = chunk.rstrip(_PUNCTUATION)
        # Letters of the first 256 code points need no normalization, and their lower case is a single letter.
        if word.isalpha() and (word.isascii() or max(word) < "Ā"):
            tail, lower = chunk[len(word) :], word.lower()
            again = lower in self.pieces
            found = self._piece(lower) + (self._piece(tail) if tail else b"")
            return self.keep(chunk, found) if again else found
        found = b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(chunk, add_special_tokens=False).ids]) if chunk else b""
        return self.keep(chunk, found) if len(chunk) <= 64 else found

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, null as empty, and the end id."""
        if not text:
            return END_ID
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) + END_ID

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each as encode() has them, and their number for each text."""
        chunks = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        plain = pc.extract_regex(coded.dictionary, _PLAIN)
        words = pc.utf8_lower(pc.fill_null(pc.struct_field(plain, "word"), "")).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(plain, "tail"), "").dictionary_encode()
        # Chunks that aren't plain stand in place of a word.
        other = plain.is_null().to_numpy(zero_copy_only=False)
        parts = [w for part in (words, tails) for w in part.dictionary.to_numpy(zero_copy_only=False)]
        pieces = [self._piece(w) if p is None else p for w, p in zip(parts, map(self.pieces.get, parts), strict=True)]
        first = np.where(other, len(pieces) + np.cumsum(other) - 1, words.indices.to_numpy())
        second = len(words.dictionary) + tails.indices.to_numpy()
        pieces += [self[chunk] for chunk in coded.dictionary.filter(plain.is_null()).to_numpy(zero_copy_only=False)]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        both = np.stack([first, second], axis=1).ravel()
        distinct = _runs(np.frombuffer(b"".join(pieces), "<u4"), (np.cumsum(lengths) - lengths)[both], lengths[both])
        lengths, which = lengths[first] + lengths[second], coded.indices.to_numpy()
        own = lengths[which]
        ids = _runs(distinct, (np.cumsum(lengths) - lengths)[which], own)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])[np.cumsum(pc.list_value_length(chunks).to_numpy())]
        return np.insert(ids, ends, int.from_bytes(END_ID, "little")), np.diff(ends, prepend=0) + 1


_shared: dict[str, WordIds] = {}


def word_ids(name: str = "word_bpe_49k.json") -> WordIds:
    """This worker's encoder."""
    if name not in _shared:
        _shared[name] = WordIds(name)
    return _shared[name]


def forgotten() -> None:
    """This worker's encoders and their memos go; a task that needs one loads it again."""
    _shared.clear()
