"""Exact merge-type subword encoding by backtracking, and decoding.

A sequence of pieces is what merging would give exactly if every piece is its own merge result
and every two neighbours are the merge result of their joined text. So the encoder takes the
longest piece that starts at a place (an Aho-Corasick automaton over all pieces yields the matches of a text),
checks it against the piece before it by merging the two again, goes to shorter
pieces where they don't agree, and steps back where none does; a bitfield of places from which
no rest can be encoded keeps it from trying them twice. Checks are remembered by pair.
Texts are encoded word by word: no piece has a space mark after another character.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseweave.llm.common import slices

SPACE = "▁"
#: Words with their space marks, line feeds, and what follows these.
WORDS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
MARK = "\0"
NEVER = float("-inf")
#: Words whose ids a worker remembers, and pairs of pieces; it forgets all when there are more.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 400_000, 700_000


class BacktrackingEncoder(dict):
    """Maps a word (with its space marks) to its ids as little-endian unsigned 32-bit integers."""

    loaded: dict[str, BacktrackingEncoder] = {}

    def __init__(self, path: str):
        super().__init__()
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = model.bos_id(), model.eos_id()
        kinds = [(model.id_to_piece(i), i) for i in range(model.vocab_size())]
        self.bytes = {int(p[3:5], 16): i for p, i in kinds if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [(p, i) for p, i in kinds if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = dict(plain)
        self.score = {p: model.get_score(i) for p, i in plain}
        self.piece = [p for p, _ in kinds]
        # what an id stands for in a text; a byte outside ASCII stands for nothing alone
        self.text = ["" if model.is_control(i) else " ⁇ " if model.is_unknown(i) else p.replace(SPACE, " ") for p, i in kinds]
        for b, i in self.bytes.items():
            self.text[i] = chr(b) if b < 128 else None
        self.silent = {i for _, i in kinds if model.is_control(i)}
        if any(SPACE in p.lstrip(SPACE) for p, _ in plain):
            raise ValueError("the model has pieces that span words")
        self.within = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        if any("\n" in pair for pair in self.within):
            raise ValueError("the model has pieces that span lines")
        self.stretches: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}

    @classmethod
    def of(cls, path: str) -> BacktrackingEncoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best-scored neighbours first, the leftmost of equals."""
        parts, get = list(text), self.score.get
        scores = [get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], NEVER)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], NEVER)
        return parts

    def agree(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def whole(self, a: str) -> bool:
        known = self.own.get(a)
        if known is None:
            known = self.own[a] = self.merge(a) == [a]
        return known

    def matches(self, text: str) -> list[list[int]]:
        """Lengths of the pieces that start at each place, shortest first; a character without a piece stands alone."""
        out: list[list[int]] = [[1] for _ in text]
        for end, size in self.automaton.iter(text):
            if size > 1:
                out[end - size + 1].append(size)
        return out

    def encode_word(self, text: str) -> list[str]:
        sizes, n = self.matches(text), len(text)
        failed = bytearray(n + 1)
        taken: list[str] = []
        tries: list[int] = []
        at = 0
        untried = len(sizes[0]) - 1 if n else 0
        while at < n:
            choice = None
            for k in range(untried, -1, -1):
                size = sizes[at][k]
                piece = text[at : at + size]
                if not failed[at + size] and (size == 1 or self.whole(piece)) and (not taken or self.agree(taken[-1], piece)):
                    choice = k
                    break
            if choice is not None:
                taken.append(text[at : at + sizes[at][choice]])
                tries.append(choice)
                at += sizes[at][choice]
                untried = len(sizes[at]) - 1 if at < n else 0
                continue
            if not taken:
                raise ValueError("no encoding")
            # The pieces before this place are the one encoding of what stands before it, so
            # no other way leads here either: the place is dead.
            failed[at] = 1
            at -= len(taken.pop())
            untried = tries.pop() - 1
        return taken

    def __missing__(self, word: str) -> bytes:
        """Ids of a word, stretch by stretch: no piece joins two characters that follow each other in none."""
        within, start, out = self.within, 0, []
        for i in range(1, len(word)):
            if (word[i - 1], word[i]) not in within:
                out.append(self.stretch(word[start:i]))
                start = i
        out.append(self.stretch(word[start:]))
        ids = self[word] = b"".join(out)
        return ids

    def stretch(self, text: str) -> bytes:
        known = self.stretches.get(text)
        if known is None:
            if len(self.stretches) > REMEMBERED_WORDS:
                self.stretches.clear()
            ids: list[int] = []
            for piece in self.encode_word(text):
                one = self.ids.get(piece)
                ids.extend([one] if one is not None else [self.bytes[b] for b in piece.encode()])
            known = self.stretches[text] = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def encode(self, text: str) -> bytes:
        """Ids of a whole text without begin and end; an empty text has none."""
        if not text:
            return b""
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        if text[0] == " " or "  " in text or SPACE in text or MARK in text:
            return b"".join(map(self.__getitem__, WORDS.findall(SPACE + text.replace(" ", SPACE))))
        # without runs of spaces, words and lines are what stands between single signs
        words = (SPACE + text).replace(" ", MARK + SPACE).replace("\n", MARK + "\n" + MARK).split(MARK)
        return b"".join(map(self.__getitem__, words))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are silent, bytes that form no character become U+FFFD each, the first space mark goes."""
        numbers = ids.tolist()
        try:
            out = "".join(map(self.text.__getitem__, numbers))
        except TypeError:  # bytes outside ASCII
            parts: list[str] = []
            run = bytearray()
            for i in numbers:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    parts.append(_characters(bytes(run)))
                    run.clear()
                parts.append(self.text[i])
            out = "".join(parts) + _characters(bytes(run))
        first = next((self.piece[i] for i in numbers if i not in self.silent), "")
        return out[1:] if first.startswith(SPACE) else out


def _characters(run: bytes) -> str:
    out, i = [], 0
    while i < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[i : i + size].decode())
                break
            except UnicodeDecodeError:
                size = 0
        else:
            out.append("�")
        i += max(1, size)
    return "".join(out)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BacktrackingEncoder.of(path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (codec.bos, codec.eos))
        for part in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for text in part.column("text").to_pylist():
                ids = begin + codec.encode(text) + end
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BacktrackingEncoder.of(path)
        for part in slices(batches):
            ids = [[codec.bos, *np.frombuffer(codec.encode(t), "<u4").tolist(), codec.eos] for t in part.column("text").to_pylist()]
            texts = [codec.decode(np.array(i)) for i in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(texts)], ["doc_id", "ids", "decoded"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with begin and end), decoded text of every whole text of ``docs`` under the model file.

    Null texts are empty; an empty text is begin and end, decoded to the empty text. Repeated
    rows are encoded each, null ids stay null, an empty table gives no rows.
    """
    return _rows(docs).mapInArrow(_ids(model), "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """As encode_documents, with the number of ids and SHA-256 digests of ids and decoded text in their place."""
    return _rows(docs).mapInArrow(_digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
