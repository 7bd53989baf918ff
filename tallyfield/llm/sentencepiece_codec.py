"""Encoding and decoding with the pieces of a SentencePiece model by shared-prefix Viterbi.

A text's segmentation is the one with the largest sum of piece scores (ties: the longer last piece, from the end back).
Pieces never reach over the start of a marked word, so the best segmentation of a text is that of its words. The new
distinct words of a batch are sorted, which lays out their trie depth-first: of each word only the characters after the
prefix it shares with the word before are scored, the forward scores of the prefix are still there. Characters that no
piece covers fall back to byte pieces. Vocabulary files are read, never trained.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_BYTES = 56 << 20
PREFIX = 256  # characters of a word whose begun pieces are kept for the next one


class SharedPrefixViterbi:
    """Segments words by the scores of ``pieces`` {piece: (id, score)}; ``unknown`` is the score of a character without."""

    def __init__(self, pieces: dict[str, tuple[int, float]], unknown: float, fallback: Callable[[str], list[int]]) -> None:
        self.unknown, self.fallback = unknown, fallback
        self.root: dict = {}
        for piece, found in pieces.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = found

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted distinct ``words``.

        For every character of the current path there are kept: the best score up to it, the last piece of the best
        segmentation, and the pieces that are begun and not ended, as (start, node), the longest first.
        """
        unknown, root = self.unknown, self.root
        score, back, begun, out, before = [0.0], [(0, -1)], [[]], [], ""
        for word in words:
            shared, most = 0, min(len(word), len(before), PREFIX)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del score[shared + 1 :], back[shared + 1 :], begun[shared + 1 :]
            live = begun[shared]
            for end in range(shared, len(word)):
                char, best, how, grown = word[end], -np.inf, (end, -1), []
                for start, node in live:
                    node = node.get(char)
                    if node is not None:
                        grown.append((start, node))
                        found = node.get("")
                        if found is not None and score[start] + found[1] > best:
                            best, how = score[start] + found[1], (start, found[0])
                node = root.get(char)
                found = None
                if node is not None:
                    grown.append((end, node))
                    found = node.get("")
                total = score[end] + (unknown if found is None else found[1])
                if total > best:
                    best, how = total, (end, -1 if found is None else found[0])
                live = grown
                score.append(best)
                back.append(how)
                if end < PREFIX:
                    begun.append(live)
            ids: list[int] = []
            end = len(word)
            while end:
                start, piece = back[end]
                if piece < 0:
                    ids += self.fallback(word[start:end])[::-1]
                else:
                    ids.append(piece)
                end = start
            ids.reverse()
            out.append(ids)
            before = word
        return out


class Codec:
    """Whole texts to ids and back with one model file."""

    _WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a\n b") != f"{MARK}{MARK}a\n{MARK}b":
            raise ValueError("only models that keep the text as it is, with a mark before it, are supported")
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unk = model.unk_id()
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        self.pieces = pieces
        self.trie = SharedPrefixViterbi(pieces, min(s for _, s in pieces.values()) - 10, self._fallback)
        self.cut_lines = not any("\n" in p for p in pieces)
        self.raw = [b""] * len(ids)
        for piece, (i, _) in pieces.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        for byte, i in self.bytes.items():
            self.raw[i] = bytes([byte])
        self.raw[self.unk] = " ⁇ ".encode()
        self.newline = self._fallback("\n")
        self._clear()

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unk) for b in char.encode("utf-8", "replace")] if self.bytes else [self.unk]

    def _clear(self) -> None:
        self.known: dict[str, list[int]] = {"\n": self.newline} if self.cut_lines else {}
        self.held = 0

    def _words(self, text: str) -> list[str]:
        """The text cut at marks, and at line ends where no piece holds one."""
        if not text:
            return []
        out: list[str] = []
        for n, line in enumerate(text.split("\n") if self.cut_lines else [text]):
            if n:
                out.append("\n")
            if MARK in line or "  " in line or line[:1] == " " or line[-1:] == " ":
                marked = line.replace(" ", MARK)
                out += self._WORD.findall(marked if n else MARK + marked)
            else:
                first, *rest = line.split(" ")
                out.append(first if n else MARK + first)
                out += [MARK + w for w in rest]
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each whole text; null is empty."""
        split = [self._words(t or "") for t in texts]
        if self.held > CACHE_BYTES:
            self._clear()
        new = sorted(set(chain.from_iterable(split)).difference(self.known))
        ids = self.trie.segment(new)
        self.known.update(zip(new, ids))
        self.held += sum(map(len, new)) + 8 * sum(map(len, ids)) + 220 * len(new)  # about what words, lists and places take
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: Callable[[], str] = piece_bpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) for each row; round_trip says that decoding the ids gives the whole text.

    Null and empty texts have no ids, and a null text no round trip to speak of (true). Only the mark U+2581 inside a text
    is not kept: it decodes as a blank. Repeated rows are encoded alike. ``model`` gives the file's path on the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model())
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                texts = some.column(1).to_pylist()
                ids = codec.encode(texts)
                sizes = np.array([len(x) for x in ids], dtype=np.int32)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum())))
                same = [codec.decode(x) == (t or "") for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes), lists, pa.array(same)], ["doc_id", "n_pieces", "ids", "round_trip"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_pieces int, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: Callable[[], str] = piece_bpe, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model())
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    base = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(run, "doc_id long, text string")
