"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces reads a text once. Where it stands, its output
links give every piece that ends there; each relaxes the best score of that
position from the position at which it starts (Viterbi).

For unigram models a path's score is the sum of its pieces' scores. In a BPE
model scores are only an order of merges, and the path of the best sum is not
the encoding. There a piece may follow another only if merging leaves the two
apart, which the merge order decides for each pair; of all paths, exactly one
keeps to this at each step, and it is the encoding. Runs of equal scores (in
models with pieces of several blanks) leave that order open, so words after
several blanks are merged step by step instead.

Characters that no piece holds become byte pieces, or the unknown piece where a
model has none. Text is cut before each run of blanks, and between letters and other characters,
where no piece crosses.

Defined results: a null or empty text has no tokens; decoding gives the text
back but for U+2581, which is read as a blank; unknown pieces decode to U+2047;
very long texts are read whole, and so is a word without blanks of any length;
repeated rows each keep their own row; the input's own columns of an output's
name are kept as name_input.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import shared

BLANK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of a generation remembered with their tokens (two are kept), and pairs of pieces with whether they may meet.
WORDS, PAIRS = 150_000, 500_000


@dataclass
class Pieces:
    """A model's pieces: text, score, and ids of bytes; built from the model file's own bytes."""

    model: bytes
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_ids = self.byte_ids if all(sp.is_byte(i) for i in self.byte_ids) else []
        self.prefix = sp.encode("a", out_type=str)[0].startswith(BLANK)
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.texts[i]: i for i in plain}
        self.rank = {self.texts[i]: self.scores[i] for i in plain}
        # A BPE model's scores are an order; a unigram model's are logarithms of probabilities.
        self.merges = all(self.scores[i] == round(self.scores[i]) for i in plain)
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        characters = set("".join(self.ids))
        line = "" if "\n" in characters else "\n"
        self.cut = re.compile(self.seams(line))
        self.raw = [bytes([self.byte_ids.index(i)]) if i in set(self.byte_ids) else t.encode() for i, t in enumerate(self.texts)]
        self.raw = [t.replace(BLANK.encode(), b" ") for t in self.raw]
        for i in range(n):
            if sp.is_control(i):
                self.raw[i] = b""
        if self.unknown >= 0:
            self.raw[self.unknown] = " ⁇ ".encode()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.stepwise: set[str] = set()

    def seams(self, line: str) -> str:
        """The pattern of the words that a text is cut into: no piece crosses from one to the next.

        Each is a run of letters, or of other characters, with the blanks
        before it. Letters that share a piece with other characters (as a raised
        2 with a full stop) count as such. Where that does not tell the two
        apart, only blanks begin a new word.
        """
        texts = [t.lstrip(BLANK) for t in self.ids]
        if any(BLANK in t for t in texts):
            return r"(?s).+"
        letter = re.compile(r"[^\W\d_]")
        odd = {c for t in texts if len({bool(letter.match(c)) for c in t}) == 2 for c in t if letter.match(c)}
        kinds = [{bool(letter.match(c)) and c not in odd for c in t} for t in texts]
        if any(len(k) == 2 for k in kinds):
            return f"{BLANK}+[^{BLANK}{line}]*|[^{BLANK}{line}]+|\n+"
        odd = "".join(sorted(odd))
        return f"{BLANK}*(?:[^\\W\\d_{odd}]+|(?:[^\\w{BLANK}{line}]|[\\d_{odd}])+)|{BLANK}+|\n+"

    def merged(self, text: str) -> list[int]:
        """Byte pair encoding step by step: the best score first, the leftmost of equals. Unknown characters are -1 - code point."""
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (both := parts[i] + parts[j]) in self.ids:
                heapq.heappush(queue, (-self.scores[self.ids[both]], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            if parts[i] != left or after[i] < 0 or parts[after[i]] != right:
                continue
            j = after[i]
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.ids.get(p, -1 - ord(p[0])) for p in parts if p is not None]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging, best score first, ends with ``left`` and ``right`` as they are."""
        parts, rank, seam = [*left, *right], self.rank, len(left)
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None or at == seam - 1:  # stuck, or a merge across the seam
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            seam -= at < seam
        return seam == 1 and rank.get(left + right) is None

    def may_meet(self, a: int, b: int) -> bool:
        """Whether merging leaves piece ``b`` next to piece ``a``."""
        if a < 0 or b < 0:
            return True
        key = a * len(self.texts) + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.apart(self.texts[a], self.texts[b])
        return found

    def viterbi(self, text: str) -> list[int] | None:
        """One pass of the automaton, whose output links relax the best way to each position; None if no way keeps to the pairs."""
        n, merges, scores, ids, pairs, width = len(text), self.merges, self.scores, self.ids, self.pairs, len(self.texts)
        never = float("-inf")
        best, came, last, done = [0.0, *[never] * n], [0] * (n + 1), [-1] * (n + 1), 0

        def settle(at: int) -> None:
            """A character that no piece ends with is a piece of its own."""
            if best[at + 1] == never and best[at] != never and text[at] not in ids:
                best[at + 1], came[at + 1], last[at + 1] = best[at] - 1e6, at, -1 - ord(text[at])

        for end, (length, i) in self.automaton.iter(text):
            while done < end:
                done += 1
                if best[done] == never:
                    settle(done - 1)
            start = end + 1 - length
            score = best[start] if merges else best[start] + scores[i]
            if score <= best[end + 1]:
                continue
            if merges and start:
                meet = pairs.get(last[start] * width + i)
                if not (self.may_meet(last[start], i) if meet is None else meet):
                    continue
            best[end + 1], came[end + 1], last[end + 1] = score, start, i
        for at in range(done, n):
            if best[at + 1] == never:
                settle(at)
        if best[n] == never:  # an order of merges with equal scores
            return None
        out, at = [], n
        while at:
            out.append(last[at])
            at = came[at]
        return out[::-1]

    def word(self, text: str) -> bytes:
        """A word's ids as little-endian 32-bit integers."""
        ids = None if self.merges and text.startswith(BLANK * 2) else self.viterbi(text)
        if ids is None:
            if len(self.stepwise) >= WORDS:
                self.stepwise.clear()
            self.stepwise.add(text)
            ids = self.merged(text)
        if min(ids) < 0:
            flat: list[int] = []
            for i in ids:
                flat += [i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]
            ids = flat
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian 32-bit integers."""
        return self.encoded(text)[0]

    def encoded(self, text: str | None) -> tuple[bytes, int]:
        """A text's ids, and how many of its words were merged step by step instead of by a way through the automaton."""
        if not text:
            return b"", 0
        cut = self.cut.findall((BLANK if self.prefix else "") + text.replace(" ", BLANK))
        out = list(map(self.words.get, cut))
        for at in [i for i, found in enumerate(out) if found is None]:
            out[at] = self.unseen(cut[at])
        return b"".join(out), sum(map(self.stepwise.__contains__, cut)) if self.stepwise else 0

    def unseen(self, w: str) -> bytes:
        """A word's ids, from what is remembered or worked out."""
        found = self.words.get(w) or self.older.get(w) or self.word(w)
        if len(w) <= 64:
            if len(self.words) >= WORDS:  # what is in use comes back from the older generation
                self.older, self.words = self.words, {}
            self.words[w] = found
        return found

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def loaded(model: bytes) -> Pieces:
    """One copy for each Python worker, which keeps what it remembers from task to task."""
    return Pieces(model)


class Tokenizer:
    """Encodes and decodes columns with the model at ``path``, read on the driver and sent to executors (about half a MB)."""

    def __init__(self, spark, path: str = MODEL):
        shared.bound_batches(spark)
        with open(path, "rb") as f:
            self.sent = spark.sparkContext.broadcast(f.read())

    def encoder(self):
        sent = self.sent

        @F.pandas_udf("array<int>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            pieces = loaded(sent.value)
            for texts in batches:
                yield pd.Series([np.frombuffer(pieces.encode(t), "<i4") for t in texts])

        return encode

    def decoder(self):
        sent = self.sent

        @F.pandas_udf("string")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            pieces = loaded(sent.value)
            for ids in batches:
                yield pd.Series([None if x is None else pieces.decode(np.asarray(x, "<i4").tobytes()) for x in ids])

        return decode

    def digester(self):
        """A function of a text column: struct (n_tokens, ids_sha256, text_sha256 of the decoded text, round_trip, n_stepwise)."""
        sent = self.sent

        @F.pandas_udf("n_tokens bigint, ids_sha256 string, text_sha256 string, round_trip boolean, n_stepwise bigint")
        def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            pieces = loaded(sent.value)
            for texts in batches:
                rows = []
                for t in texts:
                    ids, stepwise = pieces.encoded(t)
                    back = pieces.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (t or "").replace(BLANK, " "), stepwise))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "text_sha256", "round_trip", "n_stepwise"])

        return digest


def tokenized(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``docs`` with token_ids and n_tokens of the text."""
    encode = Tokenizer(docs.sparkSession, path).encoder()
    docs = shared.make_room(docs, "token_ids", "n_tokens")
    return docs.withColumn("token_ids", encode(F.col("text"))).withColumn("n_tokens", F.size("token_ids").cast("bigint"))


def report(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids), text_sha256, round_trip, n_stepwise (words that were merged step by step)."""
    digest = Tokenizer(docs.sparkSession, path).digester()
    return docs.select("doc_id", digest(F.col("text")).alias("d")).select("doc_id", "d.*")
