"""Best-fit packing of tokenized documents into sequences, bulk-synchronously.

Documents are tokenized, ended with an end id and cut into pieces of the capacity where they are longer; the first
piece takes what is left over. Pieces are then packed longest first, in bands of sizes of which equally many fit a
sequence. A step of a band is one distributed sweep over its pieces and all gaps that are large enough, sorted by size from
the largest down: every piece takes the smallest gap, not taken yet, that has been passed, its successor among the gaps.
That is a matching of parentheses, gaps open and pieces close, so it needs no task to see the whole order: prefix sums over
runs of (size, part) give each gap and piece its height, and a piece takes the last gap before it of its height. Ranks
within a run resolve conflicts: of equal pieces those with the lowest ranks get the gaps, the others wait. Then the gaps
shrink and the sweep is repeated until a band's pieces are placed or none fits; those left open new sequences, side by side
in order of size. Gaps that hold several of a band's pieces take as many in one sweep as there are pieces for each gap.

The driver holds the counts of runs alone, bounded by the capacity times PARTS, and sums them up; they are what is
broadcast. Pieces and gaps are shuffled by run, height or sequence. A size that a third of all pieces has is dealt into
PARTS runs.

A null or empty text is one piece with the end id alone. Repeated rows are packed as often as they occur. Ties in size
are broken by rank. A null doc_id is packed like any other. An empty table gives no piece. Very long texts become many
pieces; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framewright.llm.common import bounded_batches, cut, fresh_columns, release_memory, shuffle_partitions, table

CAPACITY, END_ID = 1024, 2
#: Parts that the pieces, and the gaps, of one size are dealt into at most, and pieces that a gap takes in one sweep at most.
PARTS, SLOTS = 32, 16
#: Rows that a task of a sweep should have: sweeps over few rows run in few tasks.
TASK_ROWS = 1 << 16
#: How many pieces of the bands' sizes fit a sequence, from and to; the last band goes on to the capacity.
BANDS = ((1, 1), (2, 2), (3, 3), (4, 5), (6, 9), (10, 20), (21, None))
# Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file, as the ``tokenizers`` library gives them by default.

    The merges run in the faster of two libraries where the file describes a plain byte-level vocabulary (no normalizer, the
    usual split, ids in the order of merges), which is what makes both give the same ids; texts that hold the string of
    an added token, or that it can't take, and other files go to the ``tokenizers`` library.
    """

    def __init__(self, file: bytes):
        import tiktoken

        self.file, self._slow = file, None
        told = json.loads(file)
        model, split = told["model"], told.get("pre_tokenizer") or {}
        added = [t["content"] for t in told.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and told.get("normalizer") is None
        plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and not any(told.get(k) for k in ("truncation", "padding"))
        self.fast = None
        if plain and all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if t not in added}
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        del told, model, vocabulary, merges
        release_memory()

    def slow(self):
        """The other library's tokenizer, made when a text first needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.file.decode())
        return self._slow

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not (self.added and self.added.search(text)):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # its regular expressions give up on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.asarray(self.slow().encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def tokenize(documents: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, and with ``with_ids`` the ids themselves.

    The vocabulary file is read on the driver and sent to the executors.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    with open(vocabulary, "rb") as f:
        file = f.read()
    shared, name = spark.sparkContext.broadcast(file), hashlib.sha256(file).hexdigest()  # one vocabulary file
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long" + ",ids:array<int>" * with_ids + ">>")
    def pieces(texts: pa.Array) -> pa.Array:
        encode = _ENCODERS.get(name)
        if encode is None:
            _ENCODERS.clear()
            encode = _ENCODERS[name] = Encoder(shared.value)
        offsets, out = [0], [[] for _ in fields]
        for value in texts:
            ids = np.append(encode(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            bounds = [0, *range(first, len(ids) + 1, capacity)]
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                for column, v in zip(out, (i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None), strict=False):
                    column.append(v)
            offsets.append(len(out[0]))
        rows = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], names=[n for n, _ in fields])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return documents.select(F.col(key), F.explode(pieces.asNondeterministic()(F.col(text))).alias("p")).select(key, "p.*")


def heights(size: np.ndarray, pieces: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ``n`` gaps, or of pieces, of one size each: their order in the sweep, and how many gaps are open before
    each. Gaps of a size come before its pieces; a run of more pieces than there are gaps empties them."""
    order = np.lexsort((pieces, -size))
    change = np.where(pieces, -n, n)[order]
    after = np.cumsum(change)
    least = np.minimum.accumulate(np.concatenate([[0], np.minimum(after, 0)[:-1]])) if len(after) else after
    place, height = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    place[order], height[order] = np.arange(len(n)), after - change - least
    return place, height


def _table(spark: SparkSession, columns: dict[str, np.ndarray]) -> DataFrame:
    """A small table of longs, broadcast where it is joined: as many rows as runs."""
    rows = pa.table({name: pa.array(x.astype(np.int64)) for name, x in columns.items()})
    return F.broadcast(spark.createDataFrame(rows))


def _tasks(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


class Runs:
    """Counts of the pieces that are left, and of the gaps, by size and part."""

    def __init__(self, counts: DataFrame):
        found = counts.toArrow()  # capacity x PARTS rows at most
        self.size, self.part, self.n = (found.column(c).to_numpy().astype(np.int64) for c in ("size", "part", "n"))
        self.skip = np.zeros(len(self.n), np.int64)

    def take(self, use: np.ndarray) -> Runs:
        out = object.__new__(Runs)
        out.size, out.part, out.n, out.skip = self.size[use], self.part[use], self.n[use], self.skip[use]
        return out


def _ranked_gaps(changes: DataFrame, least: int, rows: int, parts: int) -> tuple[DataFrame, Runs]:
    """What is left of gaps, written with part and k, the rank in the run of (size, part), and their counts.

    ``changes`` are rows (sid, size) that add to a sequence's gap or take from it; gaps below ``least`` are left out.
    """
    rank = W.partitionBy("size", "part").orderBy("sid")
    gaps = _tasks(changes.groupBy("sid").agg(F.sum("size").alias("size")).where(F.col("size") >= least), rows)
    dealt = gaps.withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(parts)).cast("long")).withColumn("k", F.row_number().over(rank).cast("long") - 1)
    dealt = cut(_tasks(dealt, rows))
    return dealt, Runs(dealt.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")))


def _sweep(every: DataFrame, left: Runs, gaps: DataFrame, there: Runs, slots: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Placements (size, part, k, sid, slot) of pieces, and how many of each run are placed.

    A gap counts as so many slots, each an equal share of it.
    """
    spark = every.sparkSession
    of = np.repeat(np.arange(len(slots)), slots)
    slot = np.arange(len(of)) - np.repeat(np.cumsum(slots) - slots, slots)
    is_piece = np.arange(len(of) + len(left.n)) >= len(of)
    place, height = heights(np.concatenate([(there.size // slots)[of], left.size]), is_piece, np.concatenate([there.n[of], left.n]))
    taken = np.minimum(left.n, np.maximum(height[is_piece], 0))
    opens = _table(spark, {"size": there.size[of], "part": there.part[of], "slot": slot, "place": place[~is_piece], "height": height[~is_piece]})
    closes = _table(spark, {"size": left.size, "part": left.part, "skip": left.skip, "place": place[is_piece], "taken": taken, "height": height[is_piece]})
    none = F.lit(None).cast("long")
    opening = gaps.join(opens, ["size", "part"]).select("place", (F.col("height") + F.col("k") + 1).alias("h"), "sid", "slot", none.alias("size"), none.alias("part"), none.alias("k"))
    closing = every.join(closes, ["size", "part"]).where("k >= skip and k < skip + taken")
    closing = closing.select("place", (F.col("height") - F.col("k") + F.col("skip")).alias("h"), none.alias("sid"), none.alias("slot"), "size", "part", "k")
    order = W.partitionBy("h").orderBy("place")
    met = opening.union(closing).withColumn("sid", F.lag("sid").over(order)).withColumn("slot", F.lag("slot").over(order)).where("size is not null")
    return met.select("size", "part", "k", "sid", "slot"), taken


def pack(pieces: DataFrame, length: str = "length", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. Lengths are from 1 to the capacity."""
    spark = pieces.sparkSession
    fresh_columns(pieces, "sequence_id", "offset")
    parts = min(PARTS, shuffle_partitions(spark))
    size, part, rank = "__framewright_size", "__framewright_part", "__framewright_rank"
    order = [c for c in (key, "piece") if c in pieces.columns]
    dealt = pieces.withColumn(size, F.col(length).cast("long")).withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)).cast("long"))
    dealt = cut(_tasks(dealt.withColumn(rank, F.row_number().over(W.partitionBy(size, part).orderBy(*order)).cast("long") - 1), pieces.count()))
    every = dealt.select(F.col(size).alias("size"), F.col(part).alias("part"), F.col(rank).alias("k"))
    all_left = Runs(every.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")))
    nothing = spark.createDataFrame([], "size long, part long, k long, sid long, slot long")
    placements, gaps, there = [nothing.withColumn("turn", F.lit(0))], nothing.select("sid", "size", "part", "k"), all_left.take(np.zeros(len(all_left.n), bool))

    for few, most in BANDS:
        low, high = (capacity // (most + 1) + 1 if most else 1), capacity // few
        least = int(all_left.size.min()) if len(all_left.size) else 1  # what fits no piece at all is no gap
        some, left = every.where(F.col("size").between(low, high)), all_left.take((all_left.size >= low) & (all_left.size <= high))
        while len(left.n) and (fit := there.size >= left.size.min()).any():
            # a gap that takes several pieces of any size of the band takes them in one sweep, if there are so many
            large, n = there.take(fit), int(left.n.sum())
            slots = np.clip(large.size // high, 1, min(SLOTS, -(-n // int(large.n.sum()))))
            placed, taken = _sweep(some, left, gaps, large, slots)
            placed = cut(_tasks(placed, n))
            placements.append(placed.withColumn("turn", F.lit(len(placements))))
            left.n, left.skip = left.n - taken, left.skip + taken
            left = left.take(left.n > 0)
            gaps, there = _ranked_gaps(gaps.select("sid", "size").union(placed.select("sid", -F.col("size"))), least, int(there.n.sum()), parts)
        if len(left.n):  # of the pieces left, as many as fit side by side share a new sequence
            fit = capacity // left.size
            order_ = np.lexsort((left.part, -left.size, fit))
            before = np.cumsum(left.n[order_]) - left.n[order_]
            head = np.concatenate([[True], fit[order_][1:] != fit[order_][:-1]])
            first = np.empty(len(fit), np.int64)
            first[order_] = before - np.repeat(before[head], np.diff(np.append(np.flatnonzero(head), len(fit))))
            number = F.col("first") + F.col("k") - F.col("skip")
            placed = some.join(_table(spark, {"size": left.size, "part": left.part, "skip": left.skip, "fit": fit, "first": first}), ["size", "part"]).where("k >= skip")
            sid = F.call_function("shiftleft", F.col("fit"), F.lit(48)) + (number / F.col("fit")).cast("long")
            placed = cut(placed.select("size", "part", "k", sid.alias("sid"), F.pmod(number, F.col("fit")).alias("slot")))
            placements.append(placed.withColumn("turn", F.lit(len(placements))))
            whole = placed.where("slot = 0").select("sid", F.lit(capacity).cast("long"))
            changes = gaps.select("sid", "size").union(whole).union(placed.select("sid", -F.col("size")))
            gaps, there = _ranked_gaps(changes, least, int(there.n.sum() + left.n.sum()), parts)

    where = placements[0]
    for p in placements[1:]:
        where = where.union(p)
    inside = W.partitionBy("sid").orderBy("turn", "slot")
    where = where.select(F.col("size").alias(size), F.col("part").alias(part), F.col("k").alias(rank), F.col("sid").alias("sequence_id"), (F.sum("size").over(inside) - F.col("size")).alias("offset"))
    return dealt.join(where, [size, part, rank]).select(*(F.col(c) for c in pieces.columns), "sequence_id", "offset")


def pack_documents(documents: DataFrame, vocabulary: str | None = None, with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece of a document: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    The pieces are written once to the shared folder, so that texts are tokenized once.
    """
    return pack(cut(tokenize(documents, vocabulary, capacity=capacity, with_ids=with_ids)), capacity=capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
SQL: dict[str, str] = {}
