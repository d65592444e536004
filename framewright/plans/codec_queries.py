"""Queries on codec kernels: components of embeddings stand for coefficients and samples, event ids for header fields."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import kernels as K
from framewright.plans.kernel_queries import _B, _IDS, _V, _list, _text, blocks, ids, vectors
from framewright.plans.sequence_queries import table

KEY = ["vec_id", "block"]


def quantisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).withColumn("qp", (F.col("vec_id") + F.col("block")) % 52)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes out of each block."""
    return blocks(spark, sf_dir).withColumn("b", F.transform("b", lambda x: F.abs(x) % 256))


def luma_dc(spark, sf_dir):
    return quantisers(spark, sf_dir).select(*KEY, _text(K.luma_dc(F.col("b"), F.col("qp"))).alias("b"))


def residual_8x8(spark, sf_dir):
    v = blocks(spark, sf_dir, 64)
    return v.select(*KEY, _text(K.inverse_8x8(F.col("b"), F.col("vec_id") % 52)).alias("b"))


def lossless_4x4(spark, sf_dir):
    return blocks(spark, sf_dir).select(*KEY, _text(K.lossless_walsh(F.col("b"))).alias("b"))


def intra_predictors(spark, sf_dir):
    """Mean and nearest-neighbour prediction of 4x4 samples; every third block has nothing to its left."""
    s = samples(spark, sf_dir)
    above, left, corner = F.slice("b", 1, 4), F.slice("b", 5, 4), F.get("b", F.lit(8))
    there = F.when((F.col("vec_id") + F.col("block")) % 3 != 0, left)
    return s.select(*KEY, K.dc_prediction(above, there).cast("long").alias("dc"), _text(K.paeth(above, left, corner)).alias("paeth"))


def pcm_frames(spark, sf_dir):
    return ids(spark, sf_dir).select("event_id", K.pcm_frames(F.col("a") * 3, (F.col("b") % 4 + 1) * 8, F.col("c") % 8 + 1).cast("long").alias("frames"))


def glyph_triplets(spark, sf_dir):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    dx, dy, size = K.triplet(a, F.array(b, c, (a + b) % 256, (b + c) % 256))
    return ids(spark, sf_dir).select("event_id", dx.alias("dx"), dy.alias("dy"), size.alias("size"), (a < 128).alias("on_curve"))


def reordered_references(spark, sf_dir):
    """Sixteen frame numbers from a on; two changes move pictures to the front, the second often one that isn't there."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    references = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (a + i) % 32)
    changes = F.array(-(b % 16 + 1), c % 8 + 1)
    return ids(spark, sf_dir).select("event_id", _text(K.reordered(references, (a + 16) % 32, changes, 5)).alias("list"))


def palette_merge(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.select(*KEY, _text(K.merged_palette(F.transform(F.slice("b", 1, 8), lambda x: x % 16), F.transform(F.slice("b", 9, 8), lambda x: x % 16))).alias("colours"))


def motion_candidates(spark, sf_dir):
    """Each stream's candidates in two segments, the heavier first."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct((F.col("event_type") != "view").cast("int").alias("segment"), F.length("props").alias("weight"), F.col("event_id").alias("place")).alias("c"))
    e = e.groupBy("user_id").agg(K.ranked_candidates(F.collect_list("c")).alias("c"))
    return e.select("user_id", _text(F.transform("c", lambda x: x["place"])).alias("places"))


def spread_rotation(spark, sf_dir):
    """A vector's first 16 components turned by the angle of its quantiser, and made one long again."""
    v = vectors(spark, sf_dir).select("vec_id", F.slice("v", 1, 16).alias("v"), (F.col("vec_id") % 7 * 0.1).alias("angle"))
    r = K.rotated_unit(F.col("v"), F.col("angle"))
    return v.select("vec_id", F.round(F.get(r, F.lit(0)), 6).alias("first"), F.round(F.get(r, F.lit(13)), 6).alias("late"), F.round(F.get(r, F.lit(15)), 6).alias("last"))


def prediction_filters(spark, sf_dir):
    """Coefficients of three reflections."""
    codes = F.array(F.col("a") % 16, F.col("b") % 16, F.col("c") % 16)
    a = K.step_up(K.reflections(codes, 4))
    return ids(spark, sf_dir).select("event_id", *(F.round(F.get(a, F.lit(i)), 6).alias(f"a{i}") for i in range(4)))


def all_pole_filter(spark, sf_dir):
    v = vectors(spark, sf_dir)
    y = K.all_pole(F.col("v"), F.array(F.lit(1.0), F.lit(-0.5), F.lit(0.25)))
    return v.select("vec_id", F.round(F.element_at(y, -1), 6).alias("last"), F.round(F.array_max(y), 6).alias("top"))


def inverse_mdct(spark, sf_dir):
    y = K.inverse_mdct(F.slice("v", 1, 32), 64)
    return vectors(spark, sf_dir).select("vec_id", F.round(F.get(y, F.lit(0)), 6).alias("first"), F.round(F.array_max(y), 6).alias("top"))


def noise_bands(spark, sf_dir):
    e = ids(spark, sf_dir)
    y = K.noise(F.lit(8), F.col("a") - 128)
    return e.select("event_id", F.round(F.get(y, F.lit(0)) / F.pow(F.lit(2.0), (F.col("a") - 128) / 4), 6).alias("first"), F.round(F.get(y, F.lit(7)) / F.pow(F.lit(2.0), (F.col("a") - 128) / 4), 6).alias("last"))


def coarse_energies(spark, sf_dir):
    v = vectors(spark, sf_dir)
    y = K.coarse_energy(F.slice("v", 1, 32), F.transform(F.slice("v", 33, 32), lambda x: F.floor(x * 10).cast("double")), 0.8, 0.3, -0.1, -9.0)
    return v.select("vec_id", F.round(F.element_at(y, -1), 6).alias("last"), F.round(F.array_min(y), 6).alias("least"))


def floor_lines(spark, sf_dir):
    """Height in the middle between each event and the one before in its stream."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 256).alias("y"))
    e = e.withColumns({"x0": F.lag("event_id").over(w), "y0": F.lag("y").over(w)}).where("x0 is not null")
    x = F.floor((F.col("x0") + F.col("event_id")) / 2)
    return e.select("user_id", "event_id", K.line_at(F.col("x0"), F.col("y0"), F.col("event_id"), F.col("y"), x).alias("height"))


def lsp_envelopes(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", F.transform(F.slice("v", 1, 8), lambda x, i: (i + 1) * 0.3 + x / 10).alias("v"))
    return v.select("vec_id", F.round(K.lsp_envelope(F.col("v"), F.lit(20.0), 60, (F.col("vec_id") % 10 + 0.5) / 10), 6).alias("height"))


def celt_layouts(spark, sf_dir):
    blocks_, first, last, samples_ = K.celt_layout(F.col("a") % 32)
    return ids(spark, sf_dir).select("event_id", *(c.cast("long").alias(n) for c, n in ((blocks_, "blocks"), (first, "first"), (last, "last"), (samples_, "samples"))))


def fine_motion(spark, sf_dir):
    return ids(spark, sf_dir).select("event_id", K.fine_motion(F.col("a") - 128, F.col("b") - 128).alias("fine"))


QUERIES = {f.__name__: f for f in (
    luma_dc, residual_8x8, lossless_4x4, intra_predictors, pcm_frames, glyph_triplets, reordered_references, palette_merge, motion_candidates, spread_rotation, prediction_filters,
    all_pole_filter, inverse_mdct, noise_bands, coarse_energies, floor_lines, lsp_envelopes, celt_layouts, fine_motion,
)}


def _matrix_sql(n: int, stages: list, final, first: str) -> str:
    """SQL of passes over the rows, then the columns of an n x n block; a stage maps the n terms of a line."""
    rows, columns = [[n * r + c for c in range(n)] for r in range(n)], [[n * r + c for r in range(n)] for c in range(n)]
    out = f"with s0 as ({first})"
    k = 0
    for lines, kernels in zip((rows, columns), stages, strict=True):
        for kernel in kernels:
            terms = [""] * (n * n)
            for line in lines:
                for place, term in zip(line, kernel([f"b[{i + 1}]" for i in line]), strict=True):
                    terms[place] = term
            k += 1
            out += f", s{k} as (select vec_id, block, qp, [{', '.join(terms)}] as b from s{k - 1})"
    return out + f" select vec_id, block, {final} as b from s{k}"


def _blocks_sql(size: int) -> str:
    return f"select vec_id, k::bigint as block, list_transform(embedding[{size} * k + 1 : {size} * k + {size}], lambda x: floor(x::double * 100)::bigint) as b from embeddings, unnest(range(0, len(embedding) // {size})) as s(k)"


def _hadamard(x):
    return [f"{x[0]}+{x[1]}+{x[2]}+{x[3]}", f"{x[0]}+{x[1]}-{x[2]}-{x[3]}", f"{x[0]}-{x[1]}-{x[2]}+{x[3]}", f"{x[0]}-{x[1]}+{x[2]}-{x[3]}"]


_ZIGZAG = (0, 1, 5, 6, 2, 4, 7, 12, 3, 8, 11, 13, 9, 10, 14, 15)
_CODED = (0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15)
_SCALED = "case when qp >= 36 then ({v}) * (1::bigint << (qp // 6 - 6)) else (({v}) + (1::bigint << (5 - qp // 6))) >> (6 - qp // 6) end"


def _luma_sql() -> str:
    first = f"select vec_id, block, ((vec_id + block) % 52)::int as qp, [{', '.join(f'b[{i + 1}]' for i in _ZIGZAG)}] as b from ({_blocks_sql(16)})"
    terms = (_SCALED.format(v=f"b[{i + 1}] * 16 * [10, 11, 13, 14, 16, 18][qp % 6 + 1]") for i in _CODED)
    return _matrix_sql(4, [[_hadamard], [_hadamard]], _list(terms), first)


def _eight(x):
    h = [f"({v} + ({v} >> 1))" for v in x]
    e = [f"({x[0]} + {x[4]})", f"({x[5]} - {x[3]} - {h[7]})", f"({x[0]} - {x[4]})", f"({x[1]} + {x[7]} - {h[3]})", f"(({x[2]} >> 1) - {x[6]})", f"({x[7]} - {x[1]} + {h[5]})", f"({x[2]} + ({x[6]} >> 1))", f"({x[3]} + {x[5]} + {h[1]})"]
    f = [f"({e[0]} + {e[6]})", f"({e[1]} + ({e[7]} >> 2))", f"({e[2]} + {e[4]})", f"({e[3]} + ({e[5]} >> 2))", f"({e[2]} - {e[4]})", f"(({e[3]} >> 2) - {e[5]})", f"({e[0]} - {e[6]})", f"({e[7]} - ({e[1]} >> 2))"]
    return [f"{f[0]} + {f[7]}", f"{f[2]} + {f[5]}", f"{f[4]} + {f[3]}", f"{f[6]} + {f[1]}", f"{f[6]} - {f[1]}", f"{f[4]} - {f[3]}", f"{f[2]} - {f[5]}", f"{f[0]} - {f[7]}"]


def _residual_sql() -> str:
    scales = "[" + ", ".join(str(row) for row in K.SCALE_8X8) + "][qp % 6 + 1]"
    terms = ", ".join(_SCALED.format(v=f"b[{i + 1}] * 16 * s[{K.scale_class(i // 8, i % 8) + 1}]") for i in range(64))
    first = f"select vec_id, block, qp, [{terms}] as b from (select *, {scales} as s from (select *, (vec_id % 52)::int as qp from ({_blocks_sql(64)})))"
    return _matrix_sql(8, [[_eight], [_eight]], "array_to_string(list_transform(b, lambda x: (x + 32) >> 6), ',')", first)


def _lossless(x, shift=0):
    p, q, r, s = (f"({v} >> {shift})" if shift else v for v in x)
    m = f"((({p} + {q}) - ({r} - {s})) >> 1)"
    b, c = f"({m} - {s})", f"({m} - {q})"
    return [f"{p} + {q} - {b}", b, c, f"{r} - {s} + {c}"]


def _lossless_sql() -> str:
    clamp = [lambda x: [f"greatest(-32768, least(32767, {t}))" for t in _lossless(x, 2)]]
    return _matrix_sql(4, [clamp, [_lossless]], "array_to_string(b, ',')", f"select *, 0 as qp from ({_blocks_sql(16)})")


def _triplet_sql() -> str:
    def signed(value: str, minus: str) -> str:
        return f"case when {minus} then -({value}) else {value} end"

    two, three, four = "(d0 * 256 + d1)", "((d0 * 256 + d1) * 256 + d2)", "(((d0 * 256 + d1) * 256 + d2) * 256 + d3)"
    x = (
        f"case when i < 10 then 0 when i < 20 then {signed('d0 + (i - 10) // 2 * 256', 'i % 2 = 0')} when i < 84 then {signed('d0 // 16 + 1 + (i - 20) // 16 * 16', 'i % 2 = 0')} "
        f"when i < 120 then {signed(f'{two} // 256 + 1 + (i - 84) // 12 * 256', 'i % 2 = 0')} when i < 124 then {signed(f'{three} // 4096', 'i % 2 = 0')} else {signed(f'{four} // 65536', 'i % 2 = 0')} end"
    )
    y = (
        f"case when i < 10 then {signed('d0 + i // 2 * 256', 'i % 2 = 0')} when i < 20 then 0 when i < 84 then {signed('d0 % 16 + 1 + (i - 20) % 16 // 4 * 16', '(i - 20) // 2 % 2 = 0')} "
        f"when i < 120 then {signed(f'{two} % 256 + 1 + (i - 84) % 12 // 4 * 256', '(i - 84) // 2 % 2 = 0')} when i < 124 then {signed(f'{three} % 4096', '(i - 120) // 2 % 2 = 0')} else {signed(f'{four} % 65536', '(i - 124) // 2 % 2 = 0')} end"
    )
    return _IDS + f", d as (select event_id, a, a % 128 as i, b as d0, c as d1, (a + b) % 256 as d2, (b + c) % 256 as d3 from e) select event_id, ({x})::bigint as dx, ({y})::bigint as dy, (case when i < 84 then 1 when i < 120 then 2 when i < 124 then 3 else 4 end)::bigint as size, a < 128 as on_curve from d"


_REFLECTION = "sin(case when {c} % 16 < 8 then {c} % 16 else {c} % 16 - 16 end * pi() / 2 / (8 + case when {c} % 16 < 8 then -0.5::double else 0.5::double end))"

SQL = {
    "luma_dc": _luma_sql(),
    "residual_8x8": _residual_sql(),
    "lossless_4x4": _lossless_sql(),
    "intra_predictors": f"""
with s as (select vec_id, block, list_transform(b, lambda x: abs(x) % 256) as b from ({_blocks_sql(16)})),
p as (select *, b[9] as c, list_sum(b[1:4])::bigint as t, list_sum(b[5:8])::bigint as l from s)
select vec_id, block, case when (vec_id + block) % 3 = 0 then (t + 2) // 4 else (t + l + 4) // 8 end as dc,
  array_to_string(list_transform(range(0, 16), lambda i: case
    when abs(b[i % 4 + 1] - c) <= abs(b[i // 4 + 5] - c) and abs(b[i % 4 + 1] - c) <= abs(b[i % 4 + 1] + b[i // 4 + 5] - 2 * c) then b[i // 4 + 5]
    when abs(b[i // 4 + 5] - c) <= abs(b[i % 4 + 1] + b[i // 4 + 5] - 2 * c) then b[i % 4 + 1] else c end), ',') as paeth from p""",
    "pcm_frames": _IDS + "select event_id, case when a * 3 % ((b % 4 + 1) * (c % 8 + 1)) = 0 then a * 3 // ((b % 4 + 1) * (c % 8 + 1)) end as frames from e",
    "glyph_triplets": _triplet_sql(),
    "reordered_references": _IDS + """, r as (select event_id, list_transform(range(0, 16), lambda i: (a + 15 - i) % 32) as l, (a + 16 - (b % 16 + 1) + 32) % 32 as one, c % 8 + 1 as add from e),
f as (select event_id, l, one, (one + add) % 32 as two, list_concat([one], list_filter(l, lambda x: x <> one)) as m from r)
select event_id, case when list_contains(l, one) and list_contains(l, two) then array_to_string(list_concat([one, two], list_filter(m[2:], lambda x: x <> two)), ',') end as list from f""",
    "palette_merge": f"select vec_id, block, array_to_string(list_sort(list_distinct(list_transform(b, lambda x: abs(x) % 256 % 16))), ',') as colours from ({_blocks_sql(16)})",
    "motion_candidates": "select user_id, string_agg(event_id::varchar, ',' order by event_type <> 'view', length(props) desc, event_id) as places from events group by 1",
    "spread_rotation": """
with recursive v as (select vec_id, list_transform(embedding[1:16], lambda x: x::double) as v, sin(vec_id % 7 * 0.1::double) as s, cos(vec_id % 7 * 0.1::double) as c from embeddings),
r as (
  select vec_id, s, c, v, 0 as step from v
  union all
  select vec_id, s, c, list_transform(v, lambda x, j: case when j = place + 1 then c * x + s * v[place + 2] when j = place + 2 then c * x - s * v[place + 1] else x end), step + 1
  from (select *, case when step < 15 then step else 28 - step end as place from r where step < 29)),
n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from r where step = 29)
select vec_id, round(v[1] / n, 6) as first, round(v[14] / n, 6) as late, round(v[16] / n, 6) as last from n""",
    "prediction_filters": _IDS + f""", r as (select event_id, {_REFLECTION.format(c='a')} as r1, {_REFLECTION.format(c='b')} as r2, {_REFLECTION.format(c='c')} as r3 from e)
select event_id, 1.0::double as a0, round(r1 + r1 * r2 + r2 * r3, 6) as a1, round(r2 + r3 * (r1 + r1 * r2), 6) as a2, round(r3, 6) as a3 from r""",
    "all_pole_filter": """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
y as (select vec_id, v, 1 as n, v[1] as y, 0.0::double as before from v union all select vec_id, v, n + 1, v[n + 1] + 0.5::double * y - 0.25::double * before, y from y where n < len(v))
select vec_id, round(arg_max(y, n), 6) as last, round(max(y), 6) as top from y group by 1""",
    "inverse_mdct": """
with v as (select vec_id, list_transform(embedding[1:32], lambda x: x::double) as v from embeddings),
y as (select vec_id, n, list_sum(list_transform(v, lambda x, k: x * cos((k - 0.5::double) * (n + 16.5::double) * 2 * pi() / 64))) as y from v, unnest(range(0, 64)) as s(n))
select vec_id, round(max(y) filter (n = 0), 6) as first, round(max(y), 6) as top from y group by 1""",
    "noise_bands": """
with recursive g as (select 1 as n, (1 * 1664525 + 1013904223)::bigint % 4294967296 as s union all select n + 1, (s * 1664525 + 1013904223) % 4294967296 from g where n < 8),
x as (select n, case when s >= 2147483648 then s - 4294967296 else s end / 2147483648.0::double as x from g),
t as (select sqrt(sum(x * x)) as t, max(x) filter (n = 1) as a, max(x) filter (n = 8) as b from x)
select event_id, round(a / t, 6) as first, round(b / t, 6) as last from events, t""",
    "coarse_energies": """
with v as (select vec_id, k, embedding[k]::double as p, floor(embedding[k + 32]::double * 10) as r from embeddings, unnest(range(1, 33)) as s(k)),
e as (select vec_id, k, greatest(0.8::double * greatest(p, -0.1::double) + coalesce(sum(r) over (partition by vec_id order by k rows between unbounded preceding and 1 preceding), 0) * 0.7::double + r, -9.0::double) as e from v)
select vec_id, round(arg_max(e, k), 6) as last, round(min(e), 6) as least from e group by 1""",
    "floor_lines": """
with e as (select user_id, event_id, event_id * 7919 % 256 as y, lag(event_id) over w as x0, lag(event_id * 7919 % 256) over w as y0 from events window w as (partition by user_id order by event_id))
select user_id, event_id, y0 + sign(y - y0)::bigint * (abs(y - y0) * ((x0 + event_id) // 2 - x0) // (event_id - x0)) as height from e where x0 is not null""",
    "lsp_envelopes": """
with v as (select vec_id, list_transform(embedding[1:8], lambda x, i: cos(i * 0.3::double + x::double / 10)) as v, cos((vec_id % 10 + 0.5::double) / 10 * pi()) as c from embeddings),
p as (select vec_id, c, list_product(list_transform([v[1], v[3], v[5], v[7]], lambda x: 4 * (x - c) * (x - c))) as even, list_product(list_transform([v[2], v[4], v[6], v[8]], lambda x: 4 * (x - c) * (x - c))) as odd from v)
select vec_id, round(exp(0.11512925::double * (20 / sqrt((1 - c) / 2 * odd + (1 + c) / 2 * even) - 60)), 6) as height from p""",
    "celt_layouts": _IDS + """, k as (select event_id, a % 32 as k from e)
select event_id, (case when k >= 16 then k % 4 when k >= 12 then 2 + k % 2 end)::bigint as blocks, (case when k >= 16 then 0 when k >= 12 then 17 end)::bigint as first,
  (case when k >= 28 then 21 when k >= 24 then 19 when k >= 20 then 17 when k >= 16 then 13 when k >= 14 then 21 when k >= 12 then 19 end)::bigint as last,
  (120 << (case when k >= 16 then k % 4 when k >= 12 then 2 + k % 2 end)::int)::bigint as samples from k""",
    "fine_motion": _IDS + "select event_id, abs(a - 128) // 8 < 8 and abs(b - 128) // 8 < 8 as fine from e",
}
