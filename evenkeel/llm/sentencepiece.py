"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text gets the dummy space in front and falls into marked words: a run of spaces and
the characters up to the next space or line end.  No piece of the vocabulary reaches from
one marked word into the next, so the best path of a text is the best paths of its marked
words.  Within a batch, the distinct marked words are sorted, which is the depth-first
order of their trie; the forward scores of the prefix that a word shares with the one
before are kept, only the rest is computed.  Then texts are looked up word by word; words
that come back in the next batch are remembered for the task.

Scores are those of the vocabulary file, the highest sum wins, and of equal sums the
longer last piece.  A character without a piece costs ten more than the worst piece and
becomes its UTF-8 bytes; a literal mark (U+2581) is such a character, so decoding gives
back every text exactly.

Null texts have null ids and decode to null; an empty text has none; repeated rows encode alike; an
empty input gives an empty result.  A task holds one run of texts and twice ``WORDS`` words.
A word may be as long as its text: the search keeps 16 bytes for each of its characters.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import byte_runs

MARK = "▁"
#: Public vocabulary; its folder is a parameter of every query.
TOKENIZERS = os.environ.get("EVENKEEL_TOKENIZERS", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
#: Bytes of texts searched together (a longer text alone), and words that a task remembers at most.
TEXT_BYTES = 1 << 20
WORDS = 60_000
#: Characters of a word that the next one can take over; longer words are not remembered by the task.
SHARED = 4096

_MARKED = re.compile(r" *[^ \n]+| +|\n+")


class Vocabulary:
    """Pieces with scores, byte pieces, and the search."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]):
        """``pieces``: (text with marks, score, id) of ordinary pieces; ``byte_ids``: ids of the bytes 0 to 255."""
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p, *_ in pieces):
            raise ValueError("a piece reaches over a word's end")
        self.bytes = byte_ids
        self.unknown = min((s for _, s, _ in pieces), default=0.0) - 10.0
        self.scored = [(score, i) for _, score, i in pieces]
        self.texts = [""] * (1 + max([i for *_, i in pieces] + byte_ids))
        for piece, _, i in pieces:
            self.texts[i] = piece.replace(MARK, " ")
        for b, i in enumerate(byte_ids):  # bytes that are no character yet are half surrogates
            self.texts[i] = chr(b if b < 128 else 0xDC00 + b)

    @cached_property
    def trie(self) -> dict:
        """Nodes by character; at "" the score and id of a piece that ends here.  Decoding does without."""
        root: dict = {}
        for score, i in self.scored:
            node = root
            for c in self.texts[i]:
                node = node.setdefault(c, {})
            node[""] = (score, i)
        return root

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        ordinary = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([(model.id_to_piece(i), model.get_score(i), i) for i in ordinary], byte_ids)

    def search(self, words: list[str]) -> Iterator[array]:
        """Ids of each word; ``words`` are sorted and distinct.

        For a prefix of k characters, ``best[k]`` is the score of its best path, ``starts[k]``
        and ``pieces[k]`` the start and id of its last piece (-1: an unknown character), and
        ``kept[k]`` the pieces that may go on from there.  A word takes over what it shares with
        the one before, up to ``SHARED`` characters.  A longer word has arrays of plain numbers,
        and beyond that many characters keeps the open pieces of one place only.
        """
        trie, unknown, byte_ids, most = self.trie, self.unknown, self.bytes, SHARED
        known = [0.0] * (most + 1), [-1] * (most + 1), [-1] * (most + 1)
        kept: list = [[]] * (most + 1)
        before = ""
        for word in words:
            end = 0
            for a, b in zip(before[:most], word):
                if a != b:
                    break
                end += 1
            open_ = kept[end]
            best, starts, pieces = known
            if len(word) > most:
                best, starts, pieces = (
                    array(code, states) + array(code, [0]) * (len(word) - most) for code, states in zip("dii", known)
                )
            for c in word[end:]:
                top, first, piece, going = best[end] + unknown, -1, -1, []
                for start, node in open_:  # the longest piece comes first
                    if c in node:
                        node = node[c]
                        going.append((start, node))
                        if "" in node:
                            score, i = node[""]
                            score += best[start]
                            if score > top or (piece < 0 and score == top):
                                top, first, piece = score, start, i
                if c in trie:
                    node = trie[c]
                    going.append((end, node))
                    if "" in node:
                        score, i = node[""]
                        score += best[end]
                        if score > top or (piece < 0 and score == top):
                            top, first, piece = score, end, i
                end += 1
                best[end], starts[end], pieces[end], open_ = top, first, piece, going
                if end <= most:
                    kept[end] = going
            if len(word) > most:
                known = best[: most + 1].tolist(), starts[: most + 1].tolist(), pieces[: most + 1].tolist()
            before, ids = word, array("i")
            while end:
                if pieces[end] >= 0:
                    ids.append(pieces[end])
                    end = starts[end]
                else:
                    end -= 1
                    ids.extend([byte_ids[b] for b in reversed(word[end].encode())])
            ids.reverse()
            yield ids

    def decode(self, ids) -> str:
        text = "".join(map(self.texts.__getitem__, ids))
        return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")[1:]


def marked_words(text: str) -> list[str]:
    """Parts that join to the text with the dummy space in front."""
    return _MARKED.findall(" " + text) if text else []


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known, recent = Vocabulary.load(path), {}, {}
        for batch in batches:
            for first, end, *_ in byte_runs(batch.column("_text"), TEXT_BYTES):
                part = batch.slice(first, end - first)
                split = [marked_words(t.as_py() or "") for t in part.column("_text")]
                counts = np.fromiter(map(len, split), np.int64, len(split))
                words = set(chain.from_iterable(split))
                if len(known) > WORDS:
                    known.clear()
                known.update((w, recent[w]) for w in words & recent.keys())
                old = list(words & known.keys())
                new = sorted(words - known.keys())
                if len(recent) > WORDS:
                    recent.clear()
                found = list(vocabulary.search(new))
                recent.update((w, ids) for w, ids in zip(new, found) if len(w) <= SHARED)
                of_word = [*map(known.__getitem__, old), *found]
                # ids of the distinct words in a row, then those of all words by their places in it
                place = dict(zip(chain(old, new), range(len(words))))
                sizes = np.fromiter(map(len, of_word), np.int64, len(of_word))
                row = np.fromiter(chain.from_iterable(of_word), np.int32)
                begin = np.cumsum(sizes) - sizes
                at = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
                del split, words, of_word, found, place
                lengths = sizes[at]
                ends = np.concatenate([[0], np.cumsum(lengths)])
                values = row[np.repeat(begin[at] - ends[:-1], lengths) + np.arange(ends[-1])]
                bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
                lists = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(values), mask=part.column("_text").is_null()
                )
                yield pa.record_batch([part.column("_row"), pa.array(counts), lists], ["_row", "n_words", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """_row (a struct of the input's columns but ``text``), n_words, ids."""
    path = path or f"{TOKENIZERS}/{MODEL}"
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("_row"), F.col("text").cast("string").alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(_encoder(path), f"_row {kind}, n_words long, ids array<int>")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            texts = [None if not i.is_valid else vocabulary.decode(i.values.to_numpy().tolist()) for i in batch.column("ids")]
            yield pa.record_batch([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """_row, text from _row, ids."""
    path = path or f"{TOKENIZERS}/{MODEL}"
    kind = encoded.schema["_row"].dataType.simpleString()
    return encoded.select("_row", "ids").mapInArrow(_decoder(path), f"_row {kind}, text string")
