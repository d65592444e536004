"""Exact Jaccard join on word n-grams by a token-group matrix.

Texts with the same set of shingles are folded into one. Similar texts, those with a common min-hash, are partitioned
into groups of bounded size; texts that share none with another are dealt into groups too. The members of a group of
similar texts are compared with each other and with centres of their min-hash bucket, and what links among them is one
component from then on.

The matrix then holds each group's tokens as rows (token, group). A text is a query of the groups that hold a text of
another component, and opens only those that qualify, in three steps, each an upper bound on what they can share:
(1) a row of the matrix: of each text only those tokens are kept without which no partner can reach the threshold, in one
order of all tokens (those that few sets have before frequent ones, counted over the whole corpus, then by hash), and a
query needs such a token in common with the group, at positions and sizes that leave enough; (2) the counts of shingles by
leading bits of the group's union, then of each member; (3) the query's overlap with the group's union of whole token
sets. Inside an opened group the query is compared exactly with the members. Of two components that meet at a token, the
one with far fewer texts there asks and the other is asked, so a large family doesn't ask itself; of two that are about as
large, the one in an earlier group asks, so a text asks only later groups. No link between different texts is lost but
between those that are connected anyway; results name no pairs, only a forest of them.

Texts that are all close to one another, but not linked, still have to be told apart: each opens the groups of its family,
so the rows (query, group) grow with the square of such a family's size, divided by the size of a group.

Shingles are 64-bit hashes of ``words`` lower-cased words (A-Z only) between ASCII white space. A text with fewer words
is one shingle; null, empty or blank texts have none and link with nothing. Long texts are read in pieces. Documents are
told apart by doc_id: rows that repeat one get the same result each. A row without doc_id links with nothing and has a
null component. Pairs exactly at the threshold link. Extra columns stay out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import bounded_batches, cut, id_filter, release_memory, shuffle_partitions, table
from framewright.llm.components import components, forest

WORDS, PERCENT = 5, 75
#: Min-hashes a text is grouped by; centres of a min-hash bucket; parts that a bucket is joined in.
MINHASHES, CENTRES, SALTS = 4, 2, 16
#: Tokens that come last in the order of all tokens, at most, and how many sets must have one of them.
FREQUENT, FREQUENT_LEAST = 1 << 18, 6
#: Sets and shingles of a group of the matrix, and queries of a task that opens one.
GROUP_SETS, GROUP_TOKENS, GROUP_QUERIES = 256, 1 << 18, 1024

_PIECE = 1 << 22
_M = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xFFFFFFFFFFFF0000)
_SEEDS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    raw = (text or "").encode().lower()  # of bytes: A-Z only
    out, at = [], 0
    while at < len(raw):
        end = at + _PIECE
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        words = raw[at:end].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    key = h[: len(h) - n + 1] + np.uint64(n)
    for i in range(1, n):
        key = key * _M + h[i : len(h) - n + 1 + i]
    return np.unique(mix(key))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> bytes:
    """How many shingles begin with each of a power of two of leading bit patterns, up to 255; finer for larger sets."""
    bits = max(6, int(len(s) * 2 // 5).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _counts(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of ``width`` counts; a count that stopped at 255 may be any number."""
    out = np.empty((len(sketches), width), np.int32)
    for i, raw in enumerate(sketches):
        x = np.frombuffer(raw, np.uint8).astype(np.int32)
        out[i] = np.minimum(np.where(x == 255, 1 << 20, x).reshape(width, -1).sum(axis=1), 1 << 20)
    return out


def qualify(queries: list[bytes], asking: np.ndarray, members: list[bytes], inside: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which queries may reach the threshold with a member, and which members with a query, by sketches and set sizes."""
    q_hit, m_hit = np.zeros(len(queries), bool), np.zeros(len(members), bool)
    q_width, m_width = np.array([len(x) for x in queries]), np.array([len(x) for x in members])
    for w in np.unique(m_width).tolist():
        own = np.flatnonzero(m_width == w)
        for v in np.unique(q_width).tolist():
            asks = np.flatnonzero(q_width == v)
            width = min(w, v)
            rows = _counts([members[i] for i in own], width)
            sizes, union = inside[own], rows.max(axis=0)  # no member has more of a pattern than the union here
            for i, x in zip(asks.tolist(), _counts([queries[i] for i in asks], width), strict=True):
                fits = 100 * np.minimum(sizes, asking[i]) >= percent * np.maximum(sizes, asking[i])
                if not fits.any() or int(np.minimum(x, union).sum()) < -(-percent * (int(asking[i]) + int(sizes[fits].min())) // (100 + percent)):
                    continue
                k = np.flatnonzero(fits)
                hit = k[np.minimum(x, rows[k]).sum(axis=1) >= -(-percent * (asking[i] + sizes[k]) // (100 + percent))]
                q_hit[i] |= bool(len(hit))
                m_hit[own[hit]] = True
    return q_hit, m_hit


def _scan(documents: DataFrame, words: int) -> DataFrame:
    """id, n, key, min-hashes and sketch of each document; the last three are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, mins, sketches = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                mins.append([int(mix(s ^ seed).min()) - (1 << 63) for seed in _SEEDS[:MINHASHES]] if len(s) else None)
                sketches.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(mins, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "n", "key", "mins", "sketch"])
        release_memory()

    return documents.mapInArrow(run, "id long, n long, key binary, mins array<long>, sketch binary")


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows) for each shard that has any."""
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        yield i, order[bounds[i] : bounds[i + 1]]


def _six(tokens: np.ndarray) -> bytes:
    """Tokens without their low bytes: where these meet, a match only suggests."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _of_six(raw: bytes) -> np.ndarray:
    eight = np.zeros((len(raw) // 6, 8), np.uint8)
    eight[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return eight.view(np.uint64)[:, 0]


def _frequent(documents: DataFrame, words: int, percent: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (without their low bytes) that many different sets have among those they'd need in order of hash, and a
    bit more, sorted, with the logarithm of how many; the FREQUENT most frequent ones at most. Equal sets count once a
    task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            some = [np.zeros(0, np.uint64)]
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                key = xxhash.xxh3_64_digest(s.tobytes())
                if key not in seen:
                    seen.add(key)
                    some.append(s[: _needed(len(s), percent) * 7 // 5] if len(s) else s)
            token = np.concatenate(some)
            rows = [{"shard": i, "packed": _six(token[at])} for i, at in _by_shard((token >> np.uint64(16)).astype(np.int64) % shards, shards)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("packed", pa.binary())]))
        release_memory()

    def count(t: pa.Table) -> pa.Table:
        token, n = np.unique(np.concatenate([_of_six(raw.as_py()) for raw in t.column("packed")]), return_counts=True)
        often = n >= FREQUENT_LEAST
        out = pa.table({"token": token[often].view(np.int64), "n": n[often]})
        del token, n, often
        release_memory()
        return out

    counts = documents.mapInArrow(pack, "shard int, packed binary").groupBy("shard").applyInArrow(count, "token long, n long")
    rows = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    token, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], np.log2(n[order].astype(np.float64)).astype(np.int8)


def _needed(n: np.ndarray | int, percent: int):
    """Tokens of a text of n, in order, without which no partner reaches the threshold."""
    return n + (-percent * n) // 100 + 1


def _matrix(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int, shards: int) -> DataFrame:
    """(token, key, n, pos) of needed tokens that two or more different sets have. Sent as packed arrays by shard."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT tokens at most

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, docs, positions, keys, sizes = [], [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                if not len(s):
                    continue
                key = int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "big", signed=True)
                if key in seen:
                    continue
                seen.add(key)
                known, levels = shared.value
                at = np.minimum(np.searchsorted(known, s & _HIGH), max(0, len(known) - 1))
                late = known[at] == s & _HIGH if len(known) else np.zeros(len(s), bool)
                p = _needed(len(s), percent)
                use = s[~late][:p]
                if len(use) < p:  # then the frequent ones, rarer ones first
                    use = np.concatenate([use, s[late][np.argsort(levels[at[late]], kind="stable")][: p - len(use)]])
                tokens.append(use)
                docs.append(np.full(len(use), len(keys), np.uint16))
                positions.append((np.arange(len(use)) * 255 // max(1, len(s))).astype(np.uint8))
                keys.append(key)
                sizes.append(len(s))
            if not tokens:
                continue
            token, doc, position = np.concatenate(tokens), np.concatenate(docs), np.concatenate(positions)
            key, size = np.array(keys, np.int64), np.array(sizes, np.int64)
            out = []
            for i, at in _by_shard((token >> np.uint64(16)).astype(np.int64) % shards, shards):
                used, local = np.unique(doc[at], return_inverse=True)
                out.append((i, len(at), len(used), _six(token[at]) + local.astype(np.uint16).tobytes() + position[at].tobytes() + key[used].tobytes() + size[used].tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "tokens", "sets", "packed"), x, strict=True)) for x in out], schema=pa.schema([("shard", pa.int32()), ("tokens", pa.int32()), ("sets", pa.int32()), ("packed", pa.binary())]))
        release_memory()

    def meet(t: pa.Table) -> pa.Table:
        token, key, size, position = [], [], [], []
        for m, d, raw in zip(t.column("tokens").to_pylist(), t.column("sets").to_pylist(), t.column("packed"), strict=True):
            raw = raw.as_py()
            token.append(_of_six(raw[: 6 * m]).view(np.int64))
            local = np.frombuffer(raw[6 * m : 8 * m], np.uint16)
            position.append(np.frombuffer(raw[8 * m : 9 * m], np.uint8))
            rest = np.frombuffer(raw[9 * m :], np.int64)
            key.append(rest[:d][local])
            size.append(rest[d:][local])
        token, key, size, position = map(np.concatenate, (token, key, size, position))
        order = np.lexsort((key, token))
        token, key, size, position = (x[order] for x in (token, key, size, position))
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, size, position = (x[fresh] for x in (token, key, size, position))
        same = token[1:] == token[:-1]
        two = np.zeros(len(token), bool)
        two[1:] |= same
        two[:-1] |= same
        out = pa.table({"token": token[two], "key": key[two], "n": size[two], "pos": position[two].astype(np.int64) * size[two] // 255})
        del token, key, size, position, order, fresh, same, two
        release_memory()
        return out

    return documents.mapInArrow(pack, "shard int, tokens int, sets int, packed binary").groupBy("shard").applyInArrow(meet, "token long, key long, n long, pos long")


def _alike(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, n, k, m, tg, centres) of each set that is similar to another, and (tg, rep) of the centres that a group of
    similar sets is compared with.

    A set is similar to those it shares a min-hash with; the first such min-hash tells its bucket. Buckets are dealt into
    groups of about GROUP_TOKENS shingles, and of GROUP_SETS sets at most on average. (k, m) is the largest bucket.
    """
    salt = F.pmod(F.xxhash64("rep", F.lit("salt")), F.lit(SALTS))
    member = sets.select("rep", "n", F.posexplode("mins").alias("k", "m")).withColumn("salt", salt)
    firsts = [F.min(F.struct(F.xxhash64("rep", F.lit(i)), "rep"))["rep"] for i in range(CENTRES)]
    buckets = member.groupBy("k", "m").agg(F.count(F.lit(1)).alias("sets_"), F.sum("n").alias("tokens_"), F.array(*firsts).alias("centres")).where("sets_ > 1")
    buckets = cut(buckets)
    parts = F.greatest(F.ceil(F.col("sets_") / GROUP_SETS), F.ceil(F.col("tokens_") / GROUP_TOKENS))
    in_parts = buckets.select("k", "m", "sets_", parts.alias("parts"), "centres", _salts())
    chosen = member.join(in_parts, ["k", "m", "salt"]).groupBy("rep").agg(F.any_value("n").alias("n"), F.min(F.struct("k", "m", "parts", "centres")).alias("b"), F.max(F.struct("sets_", "k", "m")).alias("home"))
    tg = F.xxhash64("b.k", "b.m", F.pmod(F.xxhash64("rep"), "b.parts"))
    alike = cut(chosen.select("rep", "n", "home.k", "home.m", tg.alias("tg"), "b.centres"))
    return alike, alike.select("tg", F.explode("centres").alias("rep")).distinct()


def _groups(sets: DataFrame, alike: DataFrame, linked: DataFrame) -> DataFrame:
    """(rep, tg, g): the group of the matrix and the component of each set; ``linked`` has (id, component) of some.

    Similar sets are with those of their largest bucket, so a family fills few groups, and a query opens few. A bucket of more
    than a group is dealt in order of size, texts with links apart from those without, so a group's bounds are close to its
    members'. Sets that share no min-hash are dealt by hash. A group has about GROUP_TOKENS shingles or GROUP_SETS sets.
    """
    salt = F.pmod(F.xxhash64("rep", F.lit("salt")), F.lit(SALTS))
    weight = F.greatest("n", F.lit(GROUP_TOKENS // GROUP_SETS))
    homes = cut(alike.select("rep", "n", "k", "m").join(linked.withColumnRenamed("id", "rep"), "rep", "left").withColumn("linked", F.col("component").isNotNull()))
    sizes = homes.groupBy("k", "m", "linked", "n").agg(F.count(F.lit(1)).alias("sets_"))
    bucket = Window.partitionBy("k", "m")  # a row for each size, not for each set
    before = F.sum(weight * F.col("sets_")).over(bucket.orderBy("linked", "n")) - weight * F.col("sets_")
    large = sizes.withColumns({"before": before, "all_": F.sum(weight * F.col("sets_")).over(bucket)}).where(F.col("all_") > GROUP_TOKENS)
    dealt = homes.withColumn("salt", salt).join(large.select("k", "m", "linked", "n", "sets_", "before", _salts()), ["k", "m", "linked", "n", "salt"], "left")
    part = F.coalesce(F.floor((F.col("before") + F.pmod(F.xxhash64("rep"), "sets_") * weight) / GROUP_TOKENS), F.lit(0))
    at_home = dealt.select("rep", F.xxhash64("k", "m", part).alias("tg"), F.coalesce("component", "rep").alias("g"))
    rest = cut(sets.select("rep", "n").join(alike.select("rep"), "rep", "left_anti"))
    n, tokens = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    lone = rest.select("rep", F.xxhash64(F.lit("lone"), F.pmod(F.xxhash64("rep"), F.lit(max(1, -(-n // GROUP_SETS), -(-tokens // GROUP_TOKENS))))).alias("tg"), F.col("rep").alias("g"))
    return cut(at_home.union(lone))


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")


def _open(matrix: DataFrame, percent: int, shards: int) -> DataFrame:
    """(tg, id, asks): the queries of each group, texts of another component that share a needed token with it where sizes
    and positions leave enough, and the members they share it with."""

    def meet(t: pa.Table) -> pa.Table:
        token, rep, comp, tg, n, pos = (t.column(c).to_numpy() for c in ("token", "rep", "g", "tg", "n", "pos"))
        order = np.lexsort((comp, token))
        head = np.flatnonzero(np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (comp[order][1:] != comp[order][:-1])]))
        texts = np.empty(len(token), np.int64)  # of one component at one token
        texts[order] = np.repeat(np.diff(np.append(head, len(token))), np.diff(np.append(head, len(token))))
        many = (np.log2(texts) // 4).astype(np.int64)
        home = np.empty(len(token), np.int64)  # the first group of a component at a token
        home[order] = np.repeat(np.minimum.reduceat(tg[order], head), np.diff(np.append(head, len(token))))
        order = np.lexsort((comp, home, many))
        rank = np.empty(len(token), np.int64)  # a component with far fewer texts has the lower one, then one in an earlier group
        new = (many[order][1:] != many[order][:-1]) | (home[order][1:] != home[order][:-1]) | (comp[order][1:] != comp[order][:-1])
        rank[order] = np.cumsum(np.concatenate([[False], new]))
        order = np.lexsort((tg, token))
        token, rep, rank, tg, n, pos = (x[order] for x in (token, rep, rank, tg, n, pos))
        head = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (tg[1:] != tg[:-1])]))
        count = np.diff(np.append(head, len(token)))
        # of each group here: sizes from least to most, most that can follow, and its highest rank
        small, large = np.minimum.reduceat(n, head), np.maximum.reduceat(n, head)
        rest, high = np.maximum.reduceat(n - pos, head), np.maximum.reduceat(rank, head)
        of = token[head]
        first, last = np.searchsorted(of, token, side="left"), np.searchsorted(of, token, side="right")
        top = np.maximum.reduceat(rank, np.unique(first, return_index=True)[1])  # of each token
        asks = rank < np.repeat(top, np.diff(np.append(np.unique(first, return_index=True)[1], len(token))))
        many = np.where(asks, last - first, 0)
        found, opened = [np.zeros((0, 2), np.int64)], np.zeros(len(head), bool)
        for at in _slices(many, 1 << 18):
            i = np.repeat(np.arange(at.start, at.stop), many[at])
            k = np.arange(len(i)) - np.repeat(np.cumsum(many[at]) - many[at], many[at]) + first[i]
            other = np.clip(n[i], small[k], large[k])  # the nearest size in the group's range
            least = -(-percent * (n[i] + small[k]) // (100 + percent))
            fits = (rank[i] < high[k]) & (100 * np.minimum(n[i], other) >= percent * np.maximum(n[i], other)) & (np.minimum(n[i] - pos[i], rest[k]) >= least)
            opened[k[fits]] = True
            found.append(np.unique(np.stack([tg[head[k[fits]]], rep[i[fits]]], 1), axis=0))
        inside = np.repeat(opened, count)
        q = np.unique(np.concatenate(found), axis=0)
        m = np.unique(np.stack([tg[inside], rep[inside]], 1), axis=0)
        out = pa.table({"tg": np.concatenate([q[:, 0], m[:, 0]]), "id": np.concatenate([q[:, 1], m[:, 1]]), "asks": np.concatenate([np.ones(len(q), bool), np.zeros(len(m), bool)])})
        release_memory()
        return out

    shard = F.pmod(F.xxhash64("token"), F.lit(4 * shards)).cast("int")
    return matrix.withColumn("shard", shard).groupBy("shard").applyInArrow(meet, "tg long, id long, asks boolean").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """(tg, salt, id, asks): each group's queries in parts of about GROUP_QUERIES, all of its members with each part."""
    salts = rows.where("asks").groupBy("tg").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("int").alias("salts"))
    dealt = rows.join(salts, "tg")
    own = F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("id"), "salts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    return dealt.select("tg", F.explode(own).alias("salt"), "id", "asks")


def _qualified(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of (tg, id, asks) that may reach the threshold with another of their group, by sketches."""

    def bound(t: pa.Table) -> pa.Table:
        ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
        n, sketches = t.column("n").to_numpy(), t.column("sketch").to_pylist()
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        hit = np.zeros(len(ids), bool)
        hit[q], hit[m] = qualify([sketches[i] for i in q], n[q], [sketches[i] for i in m], n[m], percent)
        return pa.table({"tg": t.column("tg").filter(pa.array(hit)), "id": ids[hit], "asks": asks[hit]})

    with_sketch = _dealt(rows).join(sets.select(F.col("rep").alias("id"), "n", "sketch"), "id")
    return cut(with_sketch.groupBy("tg", "salt").applyInArrow(bound, "tg long, id long, asks boolean").distinct())


def _opened(rows: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """A forest (a, b) of the links between queries and members of groups (tg, id, asks), by exact comparison."""
    rows = cut(_dealt(rows))
    needed = id_filter(rows.select("id").distinct())

    def compare(t: pa.Table) -> pa.Table:
        ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
        texts = t.column("text")
        inside = np.flatnonzero(~asks)
        sets = [shingles(texts[int(i)].as_py(), words) for i in inside]
        mine = {int(ids[i]): s for i, s in zip(inside, sets, strict=True)}
        token = np.concatenate([np.zeros(0, np.uint64), *sets])
        size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        union, bounds = token[head], np.append(head, len(token))  # the group's tokens, and who has each
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(asks).tolist() if len(union) else ():
            s = mine.get(int(ids[i]))
            s = shingles(texts[i].as_py(), words) if s is None else s
            at = np.minimum(np.searchsorted(union, s), len(union) - 1)
            at = at[union[at] == s]
            least = -(-percent * (len(s) + np.maximum(size.min(), -(-percent * len(s) // 100))) // (100 + percent))
            if len(at) < least:
                continue  # not even all members together have enough
            many = bounds[at + 1] - bounds[at]
            both = np.bincount(owner[np.repeat(bounds[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))], minlength=len(sets))
            hit = np.flatnonzero((100 * both >= percent * (len(s) + size - both)) & (size > 0) & (ids[inside] != ids[i]))
            a.append(np.full(len(hit), ids[i]))
            b.append(ids[inside[hit]])
            if sum(map(len, a)) > 1 << 18:
                a, b = ([x] for x in forest(np.concatenate(a), np.concatenate(b)))
        a, b = forest(np.concatenate(a), np.concatenate(b))
        out = pa.table({"a": a, "b": b})
        release_memory()
        return out

    texts = documents.where(needed(F.col("id")))
    return cut(rows.join(texts, "id").groupBy("tg", "salt").applyInArrow(compare, "a long, b long"))


def _slices(many: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows with about ``most`` pairs each."""
    total, at = np.cumsum(many), 0
    while at < len(many):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


def jaccard_components(documents: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id: the smallest id that links reach, for each row of ``documents``."""
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    each = cut(_scan(docs, words))
    docs = docs.where("id is not null")
    sets = cut(each.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("mins").alias("mins"), F.any_value("sketch").alias("sketch")))

    alike, centres = _alike(sets)
    both = alike.select("tg", F.col("rep").alias("id"), F.explode(F.array(F.lit(True), F.lit(False))).alias("asks"))
    links = _opened(both.union(centres.select("tg", "rep", F.lit(False))).distinct(), docs, words, percent)
    group = components(links)

    shards = shuffle_partitions(spark)
    frequent = _frequent(docs, words, percent, max(8, shards // 2))
    names = sets.select(F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("key"), "rep")
    columns = _matrix(docs, frequent, words, percent, max(8, shards // 2))
    columns = columns.join(names, "key").drop("key")
    opened = cut(_open(columns.join(_groups(sets, alike, group), "rep"), percent, shards))
    links = links.union(_opened(_qualified(opened, sets, percent), docs, words, percent))
    group = components(links)

    whole = sets.join(group.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = each.join(whole, "key", "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), found.alias("component_id"))


def keep_first(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that have their component's smallest id, with their columns."""
    found = jaccard_components(documents, text, key)
    gone = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__framewright_gone")).distinct()
    return documents.join(gone, documents[key] == gone["__framewright_gone"], "left_anti")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
SQL = {
    "op9_ngram_jaccard_join": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as token from d, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) as g(i)),
n as (select doc_id, count(*) as n from s group by doc_id),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b using (token) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select i.a, i.b from inter i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * m >= 75 * (x.n + y.n - m)),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join links l on r.b = l.a),
component as (select a, min(b) as c from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, d.doc_id)::bigint as component_id
from documents d left join n using (doc_id) left join component c on c.a = d.doc_id""",
}
