"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

Only vectors with equal, non-null labels (and equal dimension) are compared. Equal vectors are first folded into one
that counts for all of them. A label of n vectors gets about the cube root of n cells. Centroids start from vectors drawn by
hash and are moved in ROUNDS distributed rounds over a sample (SAMPLE_PER_CELL vectors a cell): blocks of vectors meet
their label's centroids, and sums a cell are added up by cell. Every vector then belongs to the cell of its nearest
centroid. A link may cross two cells, so a vector also visits each earlier cell whose border, the great circle between the two
centroids, is within the threshold's angle of it: that is exactly where partners can be.

Inside a cell, vectors within half the threshold's angle of the centroid, the core, all link with each other, so they are
only counted. All others are compared with the core and among themselves, in blocks of rows that are multiplied in double
precision, each pair of blocks in a task of its own. A large group of near copies costs no products within itself.

Vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with nothing and
are kept. A pair whose cosine is exactly the threshold links. Rows that repeat a vec_id and vector count as one vector and
each get its result; a null vec_id links with nothing and isn't kept. An empty table gives an empty result; extra columns
stay out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import bounded_batches, cut, release_memory, table
from framewright.llm.components import components, forest

THRESHOLD = 0.93
#: Sampled vectors a cell that centroids are fitted to, and rounds of fitting.
SAMPLE_PER_CELL, ROUNDS = 64, 2
#: Rows that meet the centroids at once, and rows of a block of products.
ASSIGN_ROWS, BLOCK_ROWS = 1 << 14, 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def fit_cells(vectors: DataFrame) -> DataFrame:
    """label, size, cell, c: the centroids, from label, size, cells, rows, rep and v of vectors that say how many cells
    their label should have."""
    label = dict(vectors.dtypes)["label"]

    def share(salt: str, of: int):
        return F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(1 << 30)) * F.col("rows") < F.col("cells") * F.lit(of << 30)

    sample = cut(vectors.where(share("sample", SAMPLE_PER_CELL)).select("label", "size", "block", "blocks", "rep", "v"))
    drawn = vectors.where(share("seed", 1)).select("label", "size", F.col("rep").alias("cell"), F.col("v").alias("c"))
    first = vectors.groupBy("label", "size").agg(F.min(F.struct(F.xxhash64("rep", F.lit("seed")), "rep", "v")).alias("f"))  # if none is drawn
    centroids = drawn.union(first.select("label", "size", "f.rep", "f.v")).distinct()
    centroids = cut(centroids.select("label", "size", "cell", F.col("c").cast("array<double>").alias("c")))

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        size = left.column("size")[0].as_py()
        x, c = _unit(_matrix(left.column("v"), size)), _unit(_matrix(right.column("c"), size))
        cells, of = right.column("cell").to_numpy(), np.argmax(x @ c.T, axis=1)
        there = np.unique(of)
        total = np.stack([x[of == j].sum(0) for j in there])
        n = len(there)
        return pa.table({"label": left.column("label").slice(0, 1).take(pa.array([0] * n)), "size": pa.array([size] * n, pa.int32()), "cell": cells[there], "c": _lists(total)})

    def add(t: pa.Table) -> pa.Table:
        total = _matrix(t.column("c"), t.column("size")[0].as_py()).sum(0, keepdims=True)
        if not np.abs(total).max() > 0:
            total = _matrix(t.column("c"), t.column("size")[0].as_py())[:1]
        return pa.table({"label": t.column("label").slice(0, 1), "size": t.column("size").slice(0, 1), "cell": t.column("cell").slice(0, 1), "c": _lists(_unit(total))})

    schema = f"label {label}, size int, cell long, c array<double>"
    for _ in range(ROUNDS):
        met = _met(sample, centroids)
        centroids = cut(met.applyInArrow(_with_both(sums, schema), schema).groupBy("label", "size", "cell").applyInArrow(add, schema))
    return centroids


def _with_both(f, schema: str):
    """For a cogroup: what only one side has gives nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right) if len(left) and len(right) else empty
        release_memory()
        return out

    return run


def _met(vectors: DataFrame, centroids: DataFrame):
    """Blocks of vectors with all centroids of their label."""
    dealt = centroids.join(vectors.select("label", "size", "block").distinct(), ["label", "size"])
    dealt = dealt.toDF(*dealt.columns)  # columns of their own
    return vectors.groupBy("label", "size", "block").cogroup(dealt.groupBy("label", "size", "block"))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept: one row for each row of ``embeddings``. The threshold must be above 0."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    number = F.col("v").cast("array<double>")
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & F.exists(number, lambda x: x != 0)
    good = rows.where(F.coalesce(sound, F.lit(False))).withColumn("size", F.size("v"))
    folded = cut(good.distinct().groupBy("label", "size", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    counts = folded.groupBy("label", "size").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("cells", F.ceil(F.cbrt("rows"))).withColumn("blocks", F.ceil(F.col("rows") / ASSIGN_ROWS))
    placed = cut(folded.join(counts, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")))
    centroids = fit_cells(placed)
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
    core_from = math.cos(math.acos(min(1.0, threshold)) / 2) + 1e-9

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        size = left.column("size")[0].as_py()
        right = right.sort_by("cell")
        cells, c = right.column("cell").to_numpy(), _unit(_matrix(right.column("c"), size))
        x = _unit(_matrix(left.column("v"), size))
        apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        row, cell, visit, core = [], [], [], []
        for at in range(0, len(x), 1024):
            cos = x[at : at + 1024] @ c.T
            own = np.argmax(cos, axis=1)
            best = cos[np.arange(len(cos)), own]
            near = (best[:, None] - cos <= reach * apart[own]) & (np.arange(len(c))[None] < own[:, None])
            near[np.arange(len(cos)), own] = True
            i, j = np.nonzero(near)
            row.append(i + at)
            cell.append(cells[j])
            visit.append(j != own[i])
            core.append((j == own[i]) & (best[i] >= core_from))
        row, cell, visit, core = (np.concatenate(z) for z in (row, cell, visit, core))
        out = left.select(["label", "size", "v", "rep", "n"]).take(pa.array(row))
        for name, z in (("cell", cell), ("visit", visit), ("core", core)):
            out = out.append_column(name, pa.array(z))
        return out

    types = dict(folded.dtypes)
    schema = f"label {types['label']}, size int, v {types['v']}, rep long, n long, cell long, visit boolean, core boolean"
    inside = cut(_met(placed.select("label", "size", "block", "v", "rep", "n"), centroids).applyInArrow(_with_both(assign, schema), schema))

    of_cell = ["label", "size", "cell"]
    core, visit = F.col("core"), F.col("visit")
    count = lambda c: F.ceil(F.count_if(c) / BLOCK_ROWS).cast("int")
    sizes = inside.groupBy(*of_cell).agg(
        count(core).alias("cores"),
        count(~core & ~visit).alias("owns"),
        count(visit).alias("visits"),
        F.sum(F.when(core, F.col("n"))).alias("core_n"),
        F.min(F.when(core, F.col("rep"))).alias("core_rep"),
    )
    joined = inside.join(sizes, of_cell)
    counted = joined.where("core").select(F.col("rep").alias("a"), F.col("core_rep").alias("b"), (F.col("core_n") - F.col("n")).alias("links"))
    deal, outside = F.xxhash64("rep"), F.col("cores") + F.col("owns")
    block = F.when(core, F.pmod(deal, "cores")).when(visit, outside + F.pmod(deal, "visits")).otherwise(F.col("cores") + F.pmod(deal, "owns"))
    # the core isn't multiplied with itself, nor are visitors with each other
    first, last = F.when(core, F.col("cores")).otherwise(0), F.when(visit, outside).otherwise(outside + F.col("visits")) - 1
    other = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    tasks = joined.withColumn("block", block.cast("int")).withColumn("other", F.explode(other))
    tasks = tasks.select(*of_cell, F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), (F.col("block") > F.col("other")).alias("second"), "visit", "rep", "n", "v")

    def compare(t: pa.Table) -> pa.Table:
        x = _unit(_matrix(t.column("v"), t.column("size")[0].as_py()))
        rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
        visit, second = (t.column(c).to_numpy(zero_copy_only=False) for c in ("visit", "second"))
        cross = bool(t.column("b1")[0].as_py() != t.column("b2")[0].as_py())
        left = np.flatnonzero(~second) if cross else np.arange(len(x))
        right = np.flatnonzero(second) if cross else left
        links, a, b = np.zeros(len(x), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(left), 512):
            i = left[at : at + 512]
            hit = (x[i] @ x[right].T >= threshold) & ~(visit[i][:, None] & visit[right][None])
            if not cross:
                hit &= i[:, None] < right[None]
            p, q = np.nonzero(hit)
            p, q = i[p], right[q]
            links += np.bincount(p, n[q], len(x)).astype(np.int64) + np.bincount(q, n[p], len(x)).astype(np.int64)
            f = forest(rep[p], rep[q])
            a.append(f[0])
            b.append(f[1])
        ea, eb = forest(np.concatenate(a), np.concatenate(b))
        some = np.flatnonzero(links)
        out = pa.table({"a": np.concatenate([rep[some], ea]), "b": np.concatenate([rep[some], eb]), "links": np.concatenate([links[some], np.zeros(len(ea), np.int64)])})
        release_memory()
        return out

    found = cut(tasks.groupBy(*of_cell, "b1", "b2").applyInArrow(compare, "a long, b long, links long").union(counted))
    of = components(found.select("a", "b"))
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    reps = folded.join(links, folded["rep"] == links["a"], "left").join(of, folded["rep"] == of["id"], "left")
    reps = reps.select("label", "size", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(reps, ["label", "size", "v"]).select(F.col("id").alias(key), "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


QUERIES = {"op8_embedding_near_dedup": op8_embedding_near_dedup}
SQL = {
    "op8_embedding_near_dedup": """
with recursive v as (
  select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= 0.93),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a),
degree as (select a, count(*) as n from links group by a),
component as (select a, min(b) as c from reach group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, coalesce(c.c, e.vec_id)::bigint as component_id, coalesce(c.c, e.vec_id) = e.vec_id as kept
from embeddings e left join degree d on d.a = e.vec_id left join component c on c.a = e.vec_id""",
}
