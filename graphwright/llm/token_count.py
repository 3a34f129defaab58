"""Token counts of whole texts as a SentencePiece BPE model gives them, by the whole-token shortcut.

Offline, before any text is read, the vocabulary is examined (VocabularyProof):

* No piece holds the space mark after another character. Merges join neighbouring pieces into a
  piece of the vocabulary, so no merge crosses the gap before a space mark: the runs "marks, then
  other characters" are encoded independently of each other.
* Characters that occur in no piece of several characters (line feed, tab and others) never merge.
  Each such character is a token of its own, or as many byte tokens as it has bytes in UTF-8, and
  what stands left and right of it is again independent.
* For each vocabulary string that starts with one space mark, the library is asked whether it
  encodes alone as that one token. Pre-tokens among these count 1 without any merge.

Texts are then split into pre-tokens; the proven ones are counted directly and the library merges
only the distinct rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm.words import slices, utf8_bytes

MARK = "▁"
#: Pre-tokens outside the proof whose counts are remembered at one time.
REMEMBERED = 200_000
#: Pre-tokens of more characters are encoded without being remembered.
LONG = 64


class VocabularyProof:
    """What is known about a model before reading texts: isolated characters and whole tokens."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(self.model.get_piece_size())
        ordinary = [
            self.model.id_to_piece(i)
            for i in ids
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))
        ]
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in ordinary):
            raise ValueError("a piece holds a space mark after another character: texts can't be split there")
        if [self.model.id_to_piece(i) for i in self.model.encode("a b")] != [MARK + "a", MARK + "b"]:
            raise ValueError("the model doesn't put a space mark before a text, or drops spaces")
        self.joined = {c for piece in ordinary if len(piece) > 1 for c in piece}
        if "\n" in self.joined:
            raise ValueError("line feeds merge in this model: they can't anchor the start of a line")
        feed = self.model.encode("\n")[-1]
        self.starts = np.array([self.model.id_to_piece(i).startswith(MARK) for i in ids])
        self.feeds = np.array([i == feed for i in ids])
        starts = [piece for piece in ordinary if len(piece) > 1 and piece[0] == MARK and MARK not in piece[1:]]
        encoded = self.model.encode([piece[1:] for piece in starts])
        self.whole = {
            piece[1:] for piece, ids_ in zip(starts, encoded, strict=True) if len(ids_) == 1 and self.model.id_to_piece(ids_[0]) == piece
        }


class TokenCounter:
    """Counts tokens of texts; holds the proof and a bounded memory of merged pre-tokens."""

    def __init__(self, model_path: str) -> None:
        self.proof = VocabularyProof(model_path)
        self.known = self._proven()
        self.proven = len(self.known)
        self.isolated: dict[str, int] = {}
        # The characters that separate pre-tokens besides the space mark: all that never merge.
        self.separators = [c for c in "\n\t\r\f\v" if c not in self.proof.joined]

    def _proven(self) -> dict[str, int]:
        """Pre-tokens without any merge: the proven strings, and the space mark by itself."""
        return {"": 1} | dict.fromkeys(self.proof.whole, 1)

    def _alone(self, char: str) -> int:
        """Tokens of an isolated character: one if it is a piece, else its bytes."""
        if char not in self.isolated:
            self.isolated[char] = len(self.proof.model.encode(char)) - 1
        return self.isolated[char]

    def _merged(self, words: list[str]) -> list[int]:
        """Tokens of each word with the space mark that precedes it.

        Words without spaces are encoded together, a space between them: each begins at the one
        piece of its own that starts with a mark.
        """
        if not words:
            return []
        if " " in words[0]:
            return [len(ids) for ids in self.proof.model.encode(words)]
        return self._lengths(" ".join(words), self.proof.starts)

    def _lengths(self, joined: str, first: np.ndarray) -> list[int]:
        """Tokens from each piece that first marks to the next one."""
        ids = np.array(self.proof.model.encode(joined))
        return np.diff(np.flatnonzero(first[ids]), append=len(ids)).tolist()

    def _marked(self, words: Counter[str]) -> int:
        """Tokens of words that one space mark precedes."""
        known, total, rest = self.known, 0, []
        for word, times in words.items():
            tokens = known.get(word)
            if tokens is None:
                rest.append(word)
            else:
                total += tokens * times
        if rest:
            if len(known) > self.proven + REMEMBERED:
                self.known = known = self._proven()
            rest.sort(key=lambda word: " " in word)
            plain = next((i for i, word in enumerate(rest) if " " in word), len(rest))
            for word, tokens in zip(rest, self._merged(rest[:plain]) + self._merged(rest[plain:]), strict=True):
                total += tokens * words[word]
                if len(word) <= LONG:
                    known[word] = tokens
        return total

    def count(self, text: str | None) -> int:
        """Tokens of one text, as the library counts them without begin and end tokens."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        total, words, bare = 0, Counter(), Counter()
        for sep in self.separators:
            if sep in text:
                total += text.count(sep) * self._alone(sep)
        lines = re.split(f"[{''.join(self.separators)}]", text) if self.separators else [text]
        for at, line in enumerate(lines):
            pieces = line.split(" ")
            if at == 0:
                pieces.insert(0, "")  # the library puts a space before a text
            # pieces[0] has no mark before it; empty pieces lengthen the run of marks before the next
            if pieces[0]:
                bare[pieces[0]] += 1
            if "" in pieces[1:]:
                run = 0
                for piece in pieces[1:]:
                    run += 1
                    if piece:
                        words[" " * (run - 1) + piece] += 1
                        run = 0
                if run:
                    words[" " * (run - 1)] += 1
            else:
                words.update(pieces[1:])
        return total + self._marked(words) + self._bare(bare)

    def _bare(self, words: Counter[str]) -> int:
        """Tokens of words that no space mark precedes: encoded after an isolated line feed."""
        if not words:
            return 0
        known, total, rest = self.known, 0, []
        for word, times in words.items():
            tokens = known.get("\n" + word)
            if tokens is None:
                rest.append(word)
            else:
                total += tokens * times
        if rest:
            for word, tokens in zip(rest, self._lengths("\n" + "\n".join(rest), self.proof.feeds), strict=True):
                total += (tokens - 1) * words[word]
                if len(word) <= LONG:
                    known["\n" + word] = tokens - 1
        return total


def count_tokens(
    docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", limit: int = 4096
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of docs.

    model_path names the model file on the executors, where the tokenizer package is installed.
    Null texts count as empty and have no tokens; each row is counted whole, whatever its length;
    repeated rows give repeated results; further columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenCounter(model_path)
        for batch in slices(batches):
            counts = [tokens.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    slim = docs.select(F.col(key), utf8_bytes(F.col(text)).alias("n_bytes"), F.col(text).alias("_text"))
    kind = slim.schema[key].dataType.simpleString()
    return slim.mapInArrow(counted, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
