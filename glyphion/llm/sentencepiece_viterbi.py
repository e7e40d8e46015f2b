"""Sub-word encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reads a text once. At each position it follows its output links through all pieces
that end there, and each relaxes the best score of a segmentation up to that position. Characters
that no piece covers become byte pieces, so decoding gives every text back exactly. Piece scores
are those of a unigram model: minus the log of the piece's rank in the vocabulary.

No piece crosses from a non-blank to a blank, nor holds a line end, so the best segmentation of a
text is that of its blank-led words one by one; words met before come from a bounded cache.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphion.llm.common import carry, extended, pieces, restore, table
from glyphion.llm.token_counts import tokenizer_file

BLANK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
CHUNK = re.compile(r"\n| *[^ \n]+| +")
UNCOVERED = -1000.0  # of a character that only byte pieces can write


class Pieces:
    """A vocabulary: pieces (text, with a blank sign for the space) by id, and the ids of byte pieces."""

    def __init__(self, vocabulary: list[str], special: set[int], held_words: int = 250_000):
        self.pieces, self.byte_id, self.special, self.held_words = vocabulary, {}, special, held_words
        self.words: list[tuple[str, int, float]] = []
        for i, p in enumerate(vocabulary):
            if m := BYTE_PIECE.fullmatch(p):
                self.byte_id[int(m[1], 16)] = i
            elif i not in special and p:
                self.words.append((p, i, -math.log(i + 2)))
        self.chunked = not any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p, _, _ in self.words)
        self.automaton, self.cache = None, {}
        as_bytes = [p.replace(BLANK, " ").encode() for p in vocabulary]
        for b, i in self.byte_id.items():
            as_bytes[i] = bytes([b])
        for i in special:
            as_bytes[i] = b""
        self.as_bytes = as_bytes

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "cache": {}}

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        return cls([model.id_to_piece(i) for i in range(n)], {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)})

    def _search(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for p, i, s in self.words:
                self.automaton.add_word(p, (len(p), i, s))
            self.automaton.make_automaton()
        return self.automaton.iter

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of text, its spaces as they are. A blank sign in the text itself is written in bytes.

        Of equal scores the one whose last piece is the longest wins.
        """
        seen = text.replace(BLANK, "\0").replace(" ", BLANK)
        n = len(seen)
        best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        reached = 0
        for end, (size, piece, score) in self._search()(seen):
            end += 1
            while reached < end - 1:  # positions where no piece ends: the character goes to bytes
                reached += 1
                if best[reached - 1] + UNCOVERED > best[reached]:
                    best[reached], back[reached] = best[reached - 1] + UNCOVERED, (1, -1)
            if reached < end:
                reached = end
                best[end], back[end] = best[end - 1] + UNCOVERED, (1, -1)
            total = best[end - size] + score
            if total > best[end] or (total == best[end] and size > back[end][0]):
                best[end], back[end] = total, (size, piece)
        for at in range(reached + 1, n + 1):
            best[at], back[at] = best[at - 1] + UNCOVERED, (1, -1)
        out: list[int] = []
        at = n
        while at:
            size, piece = back[at]
            out += [self.byte_id[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))] if piece < 0 else [piece]
            at -= size
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of text with a space before it, as of the beginning of a word."""
        cache, parts = self.cache, []
        for word in CHUNK.findall(" " + text) if self.chunked else [" " + text]:
            ids = cache.get(word)
            if ids is None:
                ids = np.array(self.viterbi(word), dtype=np.int32).tobytes()
                if len(word) <= 64:
                    if len(cache) >= self.held_words:
                        cache.clear()
                    cache[word] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids) -> str:
        written = self.as_bytes
        return b"".join([written[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, vocabulary: Pieces) -> DataFrame:
    """docs with _ids, the pieces of text; null for a null text. An empty text is the ids of one space."""
    work = carry(docs, "text")
    names = work.columns
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in pieces(batches):
            parts = [None if t is None else held.value.encode(t) for t in batch.column(names.index("text")).to_pylist()]
            sizes = [0 if p is None else len(p) for p in parts]
            flat = pa.array(np.concatenate([p for p in parts if p is not None] or [np.empty(0, np.int32)]))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat, mask=pa.array([p is None for p in parts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, "_ids"])

    return restore(work.mapInArrow(run, extended(work.schema, "_ids array<int>")), docs, "_ids")


def decode(rows: DataFrame, vocabulary: Pieces) -> DataFrame:
    """rows with _text, the text of _ids; null for null."""
    work = carry(rows, "_ids")
    names = work.columns
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in pieces(batches):
            column = batch.column(names.index("_ids"))
            offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
            valid = column.is_valid().to_pylist()
            texts = [held.value.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "_text"])

    return restore(work.mapInArrow(run, extended(work.schema, "_text string")), rows, "_text")


def vocabulary(name: str = "piece_bpe_32k.model") -> Pieces:
    return Pieces.load(tokenizer_file(name))


def op8_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and whether its ids decode to its text again."""
    v = vocabulary()
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), v), v)
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("_ids", ","), 256).alias("ids_sha256"), F.col("_text").eqNullSafe(F.col("text")).alias("round_trip"), F.col("_ids").alias("ids"))
