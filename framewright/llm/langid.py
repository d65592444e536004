"""Language identification by nearest centroid.

A text becomes a vector of hashed character trigrams of its lower-cased letters: square-rooted counts, weighted by
inverse document frequency, normalised. Each language has several centroids, found by spherical k-means; a text gets
the language of the centroid with the highest cosine. A text far from every centroid, by what is usual for texts of its
length in the language of the nearest one, is marked rejected: short texts are less like a centroid than long ones.

Document frequencies come from all training rows; centroids from at most about SAMPLE_PER_LANGUAGE rows a language.
A null text, or one without a letter, is ``und`` with score 0 and rejected, and so is every text if there is nothing to
learn from. Texts are read whole, in pieces of bounded memory. Equal texts get equal results; ties go to the language
that sorts first. Extra columns stay as they are, but for one named like the result, which raises an error; an empty table
gives an empty result. A null doc_id is in the fold that is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import bounded_batches, fresh_columns, release_memory, table

#: The bounds of the classifier: rows a language that centroids are fitted to, vector length, centroids a language.
SAMPLE_PER_LANGUAGE, DIMENSIONS, CLUSTERS = 256, 4096, 4
#: Rows that a centroid must have; the rows of smaller ones go to the others.
CLUSTER_ROWS = 8
#: A text is rejected below this share of the similarity that all but REJECT_QUANTILE of the sample's texts of its length
#: reach. On sf0.1, 99 % of the texts of a language left out of training reach less than 0.6 of that, and random letters too.
REJECT_SHARE, REJECT_QUANTILE = 0.8, 0.01
#: The lengths in trigrams at which that similarity is learnt.
LENGTHS = tuple(1 << i for i in range(3, 15))
UNKNOWN = "und"

_PIECE = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed trigrams; anything that is no letter counts as a space. None without a letter."""
    if not text:
        return None
    counts, any_letter = np.zeros(DIMENSIONS, np.int64), False
    for at in range(0, len(text), _PIECE):  # pieces overlap by two characters, so that every trigram counts once
        codes = np.frombuffer(f" {text} "[at : at + _PIECE + 2].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        any_letter |= bool(letter.any())
        codes = np.where(letter, codes, np.uint32(32))
        h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        spaces = (codes[:-2] == 32) & (codes[1:-1] == 32)
        counts += np.bincount((h[~spaces] >> np.uint32(20)) % DIMENSIONS, minlength=DIMENSIONS)
    return counts if any_letter else None


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` unit centroids, none of them with fewer than CLUSTER_ROWS rows where ``x`` has enough.

    The first seed is the row nearest the mean, each next a k-means++ draw from the nine tenths of the rows nearest it.
    """
    rng, similar = np.random.default_rng(0), x @ x.mean(0)
    bulk = np.flatnonzero(similar >= np.quantile(similar, 0.1))
    seeds = [int(np.argmax(similar))]
    near = x[bulk] @ x[seeds[0]]
    while len(seeds) < min(k, len(x)) and (w := np.maximum(1 - near, 0)).sum() > 1e-6:
        seeds.append(int(bulk[rng.choice(len(bulk), p=w / w.sum())]))
        near = np.maximum(near, x[bulk] @ x[seeds[-1]])
    c, least = x[seeds], max(1, min(CLUSTER_ROWS, len(x) // (2 * k)))
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        sizes = np.bincount(of, minlength=len(c))
        kept = np.flatnonzero(sizes >= min(least, sizes.max()))
        c = np.stack([x[of == j].sum(0) for j in kept])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    while len(c) > 1 and (sizes := np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))).min() < least:
        c = np.delete(c, np.argmin(sizes), axis=0)
    return c


def usual_similarity(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """For each of LENGTHS the similarity that all but REJECT_QUANTILE of these texts reach when cut to that many trigrams.

    Each half of the texts is held against centroids of the other one. A length that few texts have takes the value of
    the one before.
    """
    rng, found = np.random.default_rng(0), [[] for _ in LENGTHS]
    for half in (0, 1):
        own, others = (counts[half::2], counts[1 - half :: 2]) if len(counts) > 1 else (counts[half:], counts)
        centroids = spherical_kmeans(vectors(others, idf), CLUSTERS)
        for c in own:
            if c.sum() > LENGTHS[-1]:
                c = rng.multivariate_hypergeometric(c.astype(np.int64), LENGTHS[-1], method="marginals")
            drawn = rng.permutation(np.repeat(np.arange(DIMENSIONS), c))
            at = [i for i, n in enumerate(LENGTHS) if n <= len(drawn)]
            if at:
                cut = np.stack([np.bincount(drawn[: LENGTHS[i]], minlength=DIMENSIONS) for i in at])
                for i, s in zip(at, (vectors(cut, idf) @ centroids.T).max(axis=1).tolist(), strict=True):
                    found[i].append(s)
    out = np.zeros(len(LENGTHS))
    for i, s in enumerate(found):
        few = len(s) < max(1, 0.4 * len(counts))
        out[i] = out[i - 1] if i and few else np.quantile(s, REJECT_QUANTILE) if s else 0
    return out


def fit(training: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> dict | None:
    """The model, or None if no training row has a text with a letter and a language."""
    bounded_batches(training.sparkSession)
    rows = training.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)).alias("h")).where("t is not null and l is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if (c := trigram_counts(value)) is not None:
                    n, df = n + 1, df + (c > 0)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(-1, DIMENSIONS), "n": np.concatenate([[n], df])})
        release_memory()

    found = rows.select("t").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS + 1 rows
    by_bucket = {r["bucket"]: r["n"] for r in found}
    if not by_bucket.get(-1):
        return None
    idf = np.log((1 + by_bucket[-1]) / (1 + np.array([by_bucket[i] for i in range(DIMENSIONS)]))).astype(np.float32) + 1

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([None if c is None else c.astype(np.uint32).tobytes() for c in map(trigram_counts, texts.to_pylist())], pa.binary())

    per_language = rows.groupBy("l").count().collect()  # as many rows as languages
    share = F.lit(0)
    for r in per_language:
        share = F.when(F.col("l") == r["l"], F.lit(min(1 << 30, (sample << 30) // r["count"]))).otherwise(share)
    taken = rows.where(F.col("h") < share).select("l", packed("t").alias("v"), "h").where("v is not null").collect()  # about ``sample`` rows a language
    langs, centroids, limits = [], [], []
    for name in sorted({r["l"] for r in taken}):
        own = sorted((r["h"], r["v"]) for r in taken if r["l"] == name)
        own = np.stack([np.frombuffer(v, np.uint32) for _, v in own])
        c = spherical_kmeans(vectors(own, idf), CLUSTERS)
        langs += [name] * len(c)
        centroids += list(c)
        limits += [REJECT_SHARE * usual_similarity(own, idf)] * len(c)
    return {"langs": langs, "centroids": np.stack(centroids), "limits": np.stack(limits), "idf": idf} if langs else None


def predict_udf(spark: SparkSession, model: dict | None):
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS numbers for each centroid

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        m, values = shared.value, texts.to_pylist()
        langs, scores, rejected = [UNKNOWN] * len(values), np.zeros(len(values)), np.ones(len(values), bool)
        for at in range(0, len(values) if m else 0, 256):
            counts = [(i, c) for i in range(at, min(at + 256, len(values))) if (c := trigram_counts(values[i])) is not None]
            if counts:
                similar = vectors(np.stack([c for _, c in counts]), m["idf"]) @ m["centroids"].T
                for (i, c), j, s in zip(counts, np.argmax(similar, axis=1).tolist(), similar.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i], rejected[i] = m["langs"][j], min(1.0, max(0.0, s)), s < np.interp(np.log2(c.sum()), np.log2(LENGTHS), m["limits"][j])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=["lang_pred", "score", "rejected"])

    return predict.asNondeterministic()


def held_out(doc_id: Column) -> Column:
    """The fold that is not learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, model: dict | None, text: str = "text", to: str = "language") -> DataFrame:
    """``documents`` with the struct column ``to``: lang_pred, score, rejected."""
    bounded_batches(documents.sparkSession)
    fresh_columns(documents, to)
    return documents.withColumn(to, predict_udf(documents.sparkSession, model)(text))


def keep_identified(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` whose language is found, with their columns."""
    model = fit(documents.where(~held_out(F.col(key))), text, lang, key)
    bounded_batches(documents.sparkSession)
    found = "__framewright_language"
    return documents.withColumn(found, predict_udf(documents.sparkSession, model)(text)).where(~F.col(found)["rejected"]).drop(found)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(documents.where(~held_out(F.col("doc_id"))))
    return identify(documents.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
