"""SentencePiece BPE encoding by a prefix table, and decoding.

A prefix of a text has one last token: of the pieces that an automaton finds to end there, the one that stands
unmerged beside the last token of the prefix before it. So the table is filled from left to right with an
automaton match and a pair test for each entry, and the ids are read off backwards. Both tests are remembered.

No piece holds a space mark after another character, and none holds a line feed: a text is a row of independent
segments, cut before each run of marks and around line feeds. If no piece has a Latin letter beside another character
than its marks either, they are cut there too. Each distinct segment is encoded once per worker, and so is each distinct
word of segments.
Runs of several marks are pieces of equal score, where order decides; such a segment is merged step by step.

Null and empty texts have no ids and decode to the empty string. Repeated rows and ids stay separate rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import table
from tagloom.llm.word_ids import Memo

MARK = "▁"
_SEGMENT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: A run of Latin letters or of other characters, and segments of one such run.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_RUN = f"[{_LATIN}]+|[^{_LATIN}{MARK}\n]+"
_FINE_SEGMENT = re.compile(f"\n|{MARK}*(?:{_RUN})|{MARK}+")


class PieceModel:
    """The pieces, scores and byte ids of a model file, and the tests and tables over them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.bytes, self.names = {}, {}, {}, []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            self.names.append(b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else piece.replace(MARK, " ").encode())
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.names[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece reaches over a space mark or a line feed, so segments are not independent")
        whole = re.compile(_RUN).fullmatch
        self.cut = (_FINE_SEGMENT if all(whole(p.lstrip(MARK) or "a") for p in self.ids) else _SEGMENT).findall
        self.by_number = {str(i): name for i, name in enumerate(self.names)}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs, self.alone, self.edges = Memo(), {}, {}
        self.numbers = {piece: str(i) for piece, i in self.ids.items()}
        self.words, self.encoded = _Words(self), _Encoded(self)

    def merged(self, text: str) -> list[tuple]:
        """The nodes left by merging, again and again, the best-scored pair, the leftmost of equals.

        A node is (piece, time, left node, right node): the time is the worst rank of any merge in it.
        """
        parts: list[tuple | None] = [(c, 0.0, None, None) for c in text]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if (score := self.scores.get(both := parts[i][0] + parts[j][0])) is not None:
                heapq.heappush(heap, (-score, i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            rank, i, j, both = heapq.heappop(heap)
            left, right = parts[i], parts[j]
            if left is None or right is None or after[i] != j or left[0] + right[0] != both:
                continue
            parts[i], parts[j], after[i] = (both, max(rank, left[1], right[1]), left, right), None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def edge(self, piece: str, side: int) -> list[tuple[str, float, float]] | None:
        """The nodes along an edge of a piece, the leaf first, as (piece, its time, the time it goes up into the next).

        side: 3 for the right edge, 2 for the left. None if merging doesn't give this piece at all.
        """
        key = (piece, side)
        if key not in self.edges:
            nodes, found = self.merged(piece), None
            if len(nodes) == 1:
                found, node, goes = [], nodes[0], math.inf
                while node is not None:
                    found.append((node[0], node[1], goes))
                    node, goes = node[side], node[1]
                found.reverse()
            self.edges[key] = found
        return self.edges[key]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two stay as they are side by side: at no time do the nodes that meet there merge."""
        ours, theirs = self.edge(left, 3), self.edge(right, 2)
        if ours is None or theirs is None:
            return False
        i = j = 0
        while True:
            a, since_a, until_a = ours[i]
            b, since_b, until_b = theirs[j]
            score = self.scores.get(a + b)
            if score is not None:
                time = max(-score, since_a, since_b)
                if time < until_a and time <= until_b:
                    return False
            if until_a == until_b == math.inf:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def split(self, segment: str) -> list[str]:
        """The pieces of a segment, from its prefix table."""
        if segment.startswith(MARK + MARK):
            return [node[0] for node in self.merged(segment)]
        # The last piece of each prefix, by its last character.
        last: list[str | None] = [None] * len(segment)
        pairs, alone = self.pairs, self.alone
        for end, piece in self.automaton.iter(segment):
            if last[end]:
                continue
            before = end - len(piece)
            if before >= 0:
                both = last[before] or segment[before], piece
                fits = pairs.get(both)
                if fits is None:
                    fits = pairs.keep(both, self.compatible(*both))
            else:
                fits = alone.get(piece)
                if fits is None:
                    fits = alone[piece] = self.edge(piece, 3) is not None
            if fits:
                last[end] = piece
        out, end = [], len(segment) - 1
        while end >= 0:
            piece = last[end] or segment[end]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def segment_ids(self, segment: str) -> str:
        """The ids of a segment as decimal numbers joined by commas; a character that is no piece is its bytes."""
        numbers = self.numbers
        return ",".join([numbers.get(piece) or ",".join([str(self.bytes[b]) for b in piece.encode()]) for piece in self.split(segment)])

    def encode(self, text: str | None) -> list[str]:
        """The ids of a text by segment, each as segment_ids() has them."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return list(map(self.encoded.__getitem__, self.cut(MARK + text.replace(" ", MARK))))
        return list(map(self.words.__getitem__, text.split(" ")))

    def decode(self, ids: str) -> str:
        """The text of ids as decimal numbers joined by commas: spaces for marks, but for the first."""
        return b"".join(map(self.by_number.__getitem__, ids.split(",") if ids else ())).decode("utf-8", "replace").removeprefix(" ")


class _Encoded(Memo):
    """From a segment to its ids."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, segment: str) -> str:
        found = self.old.get(segment)
        if found is None:
            found = self.model.segment_ids(segment)
        return self.keep(segment, found) if len(segment) <= 64 else found


class _Words(_Encoded):
    """From what stands between single spaces to the ids of its segments, the first of which a space mark begins."""

    def __missing__(self, word: str) -> str:
        found = self.old.get(word)
        if found is None:
            found = ",".join(map(self.model.encoded.__getitem__, self.model.cut(MARK + word)))
        return self.keep(word, found) if len(word) <= 64 else found


_shared: dict[str, PieceModel] = {}


def piece_model(name: str = "piece_bpe_32k.model") -> PieceModel:
    """This worker's model."""
    if name not in _shared:
        _shared[name] = PieceModel(public_tokenizers.path(name))
    return _shared[name]


def encode_decode(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_tokens, and digests of its ids and of the text that they decode to."""

    def digest(batches):
        model = piece_model()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                joined = ",".join(model.encode(text))
                rows.append((doc_id, joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(model.decode(joined).encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
