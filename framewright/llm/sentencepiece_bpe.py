"""SentencePiece BPE encoding and decoding by a prefix table.

For merge-type (BPE) models the encoding of a prefix of a text ends in one token only. The table stores that token for
each prefix: it is the one token that matches there (found by an automaton over all pieces) and whose pair with the last
token of what stands before it survives merging as it is. The ids of the whole text are then read off backwards.

No piece has a word separator behind another character, so no token crosses from a word into the next; the table is
made for one word at a time, and words met before are looked up. Memory is bounded by the longest word and the caches.

A null text counts as empty and has no ids. Repeated rows get equal results; extra columns stay, but for one named like
the result, which raises an error; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import bounded_batches, fresh_columns, table

SPACE = "▁"
#: Entries of a worker's caches, and the longest word that is kept.
WORDS, PAIRS, WORD_CHARS = 300_000, 1_000_000, 48


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key = shift = 0
        while True:
            b = data[at]
            at += 1
            key |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        kind = key & 7
        if kind in (0, 2):
            value = shift = 0
            while True:
                b = data[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            if kind == 2:
                value, at = data[at : at + value], at + value
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


class Model:
    """A BPE model with byte fallback, a dummy prefix and no further normalisation."""

    def __init__(self, data: bytes):
        import ahocorasick

        pieces, normalizer, trainer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or any(kind == 4 for _, _, kind in pieces):
            raise ValueError("only BPE models that leave white space and characters as they are")
        self.prefix = bool(normalizer.get(3, 1))
        self.score = {p: s for p, s, kind in pieces if kind == 1}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.text = [p for p, _, _ in pieces]
        self.kinds = [kind for _, _, kind in pieces]
        self.bytes = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a separator inside")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self._merge(p) == [i]:  # a piece that merging never makes can't be a token
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.words: dict[str, tuple[str, int, str]] = {}
        self.pairs: dict[int, bool] = {}

    def _merge(self, text: str) -> list[int]:
        """Merging step by step, for pieces and pairs of them."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max(((self.score.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(float("-inf"), 0))
            if best == float("-inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return [self.ids.get(p, -1) for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' texts gives these two tokens again."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        fits = self.pairs[left << 20 | right] = self._merge(self.text[left] + self.text[right]) == [left, right]
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text without a separator behind another character."""
        n = len(word)
        last = [-1] * (n + 1)  # the last token of each prefix; -1: a character that is no piece
        size = [1] * (n + 1)
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(word):  # by end, so what stands before is settled
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if before >= 0 and length < end:
                fits = pairs.get(before << 20 | token)
                if not (self._fits(before, token) if fits is None else fits):
                    continue
            last[end], size[end] = token, length
        out: list[int] = []
        while n:
            if last[n] == -1:
                raw = word[n - 1].encode("utf-8", "surrogatepass")
                out.extend(self.bytes.get(b, self.unknown) for b in reversed(raw))
            else:
                out.append(last[n])
            n -= size[n]
        return out[::-1]

    def normalize(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return [i for w in _WORD.findall(self.normalize(text)) for i in self.encode_word(w)]

    def decode_part(self, ids: list[int]) -> str:
        """The text of ids, separators as spaces, nothing taken off the front."""
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == 6:
                raw.append(int(self.text[i][3:-1], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i is not None and self.kinds[i] == 1:
                out.append(self.text[i].replace(SPACE, " "))
            elif i is not None and self.kinds[i] == 2:
                out.append(" ⁇ ")
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_part(ids)
        return text[1:] if self.prefix and text[:1] == " " else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids and digest of what they decode to."""
        total, ids, back, words = 0, [], [], self.words
        for w in _WORD.findall(self.normalize(text or "")):
            found = words.get(w)
            if found is None:
                own = self.encode_word(w)
                found = (",".join(map(str, own)), len(own), self.decode_part(own))
                if len(words) < WORDS and len(w) <= WORD_CHARS:  # frequent words come early
                    words[w] = found
            ids.append(found[0])
            total += found[1]
            back.append(found[2])
        decoded = "".join(back)
        decoded = decoded[1:] if self.prefix and decoded[:1] == " " else decoded
        return total, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MODELS: dict[str, Model] = {}


def _shared_model(spark: SparkSession, model: str | None):
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    with open(model, "rb") as f:
        file = f.read()
    return spark.sparkContext.broadcast(file), hashlib.sha256(file).hexdigest()  # one model file


def _load(shared, name: str) -> Model:
    found = _MODELS.get(name)
    if found is None:
        _MODELS.clear()
        found = _MODELS[name] = Model(shared.value)
    return found


def encode(documents: DataFrame, model: str | None = None, text: str = "text", to: str = "ids") -> DataFrame:
    """``documents`` with the column ``to``, the ids of each text (array<int>)."""
    bounded_batches(documents.sparkSession)
    fresh_columns(documents, to)
    shared, name = _shared_model(documents.sparkSession, model)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        m = _load(shared, name)
        return pa.array([m.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return documents.withColumn(to, ids.asNondeterministic()(text))


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``to``, the text that each list of ids stands for."""
    bounded_batches(encoded.sparkSession)
    fresh_columns(encoded, to)
    shared, name = _shared_model(encoded.sparkSession, model)

    @F.arrow_udf("string")
    def back(lists: pa.Array) -> pa.Array:
        m = _load(shared, name)
        return pa.array([m.decode(x or []) for x in lists.to_pylist()], pa.string())

    return encoded.withColumn(to, back.asNondeterministic()(ids))


def digests(documents: DataFrame, model: str | None = None, text: str = "text", to: str = "encoded") -> DataFrame:
    """``documents`` with the struct column ``to``: n_tokens, ids_sha256, decoded_sha256."""
    bounded_batches(documents.sparkSession)
    fresh_columns(documents, to)
    shared, name = _shared_model(documents.sparkSession, model)

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def both(texts: pa.Array) -> pa.Array:
        m = _load(shared, name)
        rows = [m.digest(t.as_py()) for t in texts]
        n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.withColumn(to, both.asNondeterministic()(text))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return digests(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "encoded.*")


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
SQL: dict[str, str] = {}
