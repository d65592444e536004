"""Queries over whole tables, against brute force."""

import math
from bisect import bisect_right
from collections import Counter

import pyarrow.parquet as pq

from framewright.plans import registry
from framewright.sources.containers import crc32_mpeg

DATA = "/root/testdata/sf0.001"


def rows_of(name, *columns):
    return [tuple(r.values()) for r in pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns)).to_pylist()]


def run(spark, name, *columns):
    return [tuple(r) for r in registry.all_queries()[name](spark, DATA).select(*columns).collect()]


def test_rle_expand_whole(spark):
    n, sums = Counter(), Counter()
    for order, quantity in rows_of("lineitem", "l_orderkey", "l_quantity"):
        n[order] += int(quantity)
        sums[order] += sum(range(int(quantity)))
    assert max(n) >= 200
    assert sorted(run(spark, "rle_expand", "l_orderkey", "n", "sum_i")) == sorted((o, n[o], sums[o]) for o in n if n[o])


def test_not_appended_whole(spark):
    expected = sorted(r for r in rows_of("orders", "o_orderkey", "o_orderstatus") if r[0] % 50 == 3)
    assert max(expected)[0] >= 500
    assert sorted(run(spark, "not_appended", "o_orderkey", "o_orderstatus")) == expected


def test_chunk_asof_whole(spark):
    runs = {}
    for first, size in sorted(rows_of("part", "p_partkey", "p_size")):
        runs.setdefault(size % 10, []).append((first, size))
    expected = Counter()
    for part, supplier, order, line in rows_of("lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"):
        of = runs.get(supplier % 10, [])
        at = bisect_right(of, (part, float("inf")))
        expected[supplier % 10, part, order, line, of[at - 1][1] if at else None] += 1
    assert Counter(run(spark, "chunk_asof", "bucket", "at", "l_orderkey", "l_linenumber", "p_size")) == expected


def test_reference_lists_whole(spark):
    of = {}
    for user, event in rows_of("events", "user_id", "event_id"):
        of.setdefault(user, []).append(event)
    expected = []
    for user, events in of.items():
        past, future = sorted((e for e in events if e < 5000), reverse=True), sorted(e for e in events if e > 5000)
        expected.append((user, ",".join(map(str, past + future)), ",".join(map(str, future + past))))
    assert any(e % 10 for events in of.values() for e in events)
    assert sorted(run(spark, "reference_lists", "user_id", "list0", "list1")) == sorted(expected)


def test_checksums_of_whole_texts(spark):
    texts = {i: t.encode() for i, t in rows_of("documents", "doc_id", "text")}
    assert dict(run(spark, "crc_mpeg", "doc_id", "crc")) == {i: crc32_mpeg(t) for i, t in texts.items()}
    assert dict(run(spark, "byte_sums", "doc_id", "signed")) == {i: sum(t) % 2**32 ^ 0x50475342 for i, t in texts.items()}
    words = {i: t + bytes(-len(t) % 4) for i, t in texts.items()}
    assert dict(run(spark, "table_checksums", "doc_id", "checksum")) == {i: sum(int.from_bytes(t[k : k + 4], "big") for k in range(0, len(t), 4)) % 2**32 for i, t in words.items()}


def test_zigzag_of_all_blocks(spark):
    order = (0, 1, 5, 6, 2, 4, 7, 12, 3, 8, 11, 13, 9, 10, 14, 15)
    expected = [(i, k, ",".join(str(math.floor(v[16 * k + o] * 100)) for o in order)) for i, v in rows_of("embeddings", "vec_id", "embedding") for k in range(len(v) // 16)]
    assert sorted(run(spark, "zigzag_blocks", "vec_id", "block", "b")) == sorted(expected)


def test_kernels_compute_their_input_once(spark):
    """An expression that names its input many times computes it as often."""
    from pyspark.sql import functions as F

    from framewright.functions import arrays as A

    b = F.col("block_")
    for c in (A.inverse_dct4(b), A.inverse_residual4(b), A.inverse_walsh4(b), A.hadamard(b, 4, 4), A.convolve(b, [1, 2, 1]), A.normalise(b)):
        assert str(c).count("block_") <= 3


def write_tables(folder, **tables):
    import duckdb

    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def same_as_sql(spark, con, folder, name):
    df = registry.all_queries()[name](spark, str(folder))
    theirs = con.execute(f"select {', '.join(df.columns)} from ({registry.all_sql()[name]})").fetchall()
    return Counter(tuple(r) for r in df.collect()) == Counter(theirs)


def test_byte_sums_of_odd_documents(spark, tmp_path):
    """Empty and null texts, ids that are null or repeated, and more bytes than 32 bits can add up."""
    con = write_tables(tmp_path, documents="""
        select * from (values (1::bigint, 'abc'), (2, ''), (3, null), (4, 'é'), (4, 'xy'), (null, 'lost'), (5, ''), (5, 'z'))
        t(doc_id, text) union all select 9, repeat('~', 1000) from range(200)""")
    assert same_as_sql(spark, con, tmp_path, "byte_sums")
    assert max(s or 0 for _, s in run(spark, "byte_sums", "doc_id", "signed")) < 2**32
    assert {r["doc_id"]: r["signed"] for r in registry.all_queries()["byte_sums"](spark, str(tmp_path)).collect()}[9] > 2**32


EVENTS = """
    select (case when i < 40 then i * 997 else 2860000 + 3000000 * (i % 7) + i end)::bigint as event_id, (i % 3)::bigint as user_id,
    case i % 5 when 0 then 'error' when 1 then 'click' else 'view' end as event_type from range(100) t(i)
    union all select 20000000, 7, 'view'"""


def test_units_whose_times_pass_33_bits(spark, tmp_path):
    con = write_tables(tmp_path, events=EVENTS)
    assert con.execute("select max(event_id) * 3003 from events").fetchone()[0] > 6 << 33
    assert same_as_sql(spark, con, tmp_path, "pes_units")
    assert same_as_sql(spark, con, tmp_path, "transport_streams")
