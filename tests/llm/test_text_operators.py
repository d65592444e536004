import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import jaccard, langid, packing, quality, sentencepiece_bpe, suffix
from framewright.llm.components import components


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Language


def test_language(documents, no_documents, texts):
    model = langid.fit(documents.where(~langid.held_out(F.col("doc_id"))))
    rows = by_id(langid.identify(documents.drop("language"), model))
    for i, (text, lang) in enumerate(texts):
        got = rows[i]["language"]
        if not any(c.isalpha() for c in text or ""):
            assert (got["lang_pred"], got["score"], got["rejected"]) == ("und", 0.0, True)
        elif i < 60:
            assert got["lang_pred"] == lang and 0 < got["score"] <= 1 and not got["rejected"]
        assert got["lang_pred"] in ("xx", "yy", "und")
    assert langid.fit(no_documents) is None
    assert langid.identify(no_documents.drop("language"), None).count() == 0
    kept = langid.keep_identified(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} >= set(range(60))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    r = langid.identify(docs, model).where(langid.held_out(F.col("doc_id"))).agg(F.avg((F.col("language.lang_pred") == F.col("lang")).cast("double")), F.avg(F.col("language.rejected").cast("double"))).head()
    assert r[0] > 0.98 and r[1] < 0.02


@pytest.mark.parametrize("unseen", ["es", "fr", "de", "en"])
def test_unseen_language_and_noise_are_rejected(spark, unseen):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id")) & (F.col("lang") != unseen)))
    rows = langid.identify(docs, model).where(langid.held_out(F.col("doc_id"))).collect()
    rejected = lambda rs: sum(r["language"]["rejected"] for r in rs) / len(rs)
    assert rejected([r for r in rows if r["lang"] == unseen and len(r["text"]) >= 200]) > 0.9
    assert rejected([r for r in rows if r["lang"] != unseen]) < 0.02
    rng = random.Random(11)
    noise = [(" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n)),) for n in (30, 300, 2000)]
    assert all(r["language"]["rejected"] for r in langid.identify(spark.createDataFrame(noise, "text string"), model).collect())


def test_centroids_have_rows():
    rng = np.random.default_rng(5)
    centres = np.eye(40)[:3]
    x = np.concatenate([np.repeat(centres, 80, axis=0) + rng.normal(size=(240, 40)) * 0.05, np.eye(40)[20:24]])  # four rows like no other
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.spherical_kmeans(x, 4)
    sizes = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    assert len(c) > 1 and sizes.min() >= langid.CLUSTER_ROWS
    assert langid.spherical_kmeans(x[:1], 4).shape == langid.spherical_kmeans(np.repeat(x[:1], 9, axis=0), 4).shape == (1, 40)


def test_trigrams_do_not_depend_on_pieces(monkeypatch):
    text = "some words of a text, and more of them. " * 50
    whole = langid.trigram_counts(text)
    monkeypatch.setattr(langid, "_PIECE", 64)
    assert (langid.trigram_counts(text) == whole).all()


# Quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, repeated = {}, set()
    for i in range(len(words) - 7):
        w = tuple(words[i : i + 8])
        if w in seen:
            repeated.update(range(i, i + 8), range(seen[w], seen[w] + 8))
        seen.setdefault(w, i)
    n = len(words)
    counts = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))
    return (*counts, n < 20 or 100 * len(repeated) > 30 * n)


def test_quality(documents, no_documents, texts):
    rows = by_id(quality.quality(documents.drop("quality")))
    for i, (text, _) in enumerate(texts):
        got = rows[i]["quality"]
        assert tuple(got)[:6] == brute_quality(text), text
        assert not (got["base_failed"] and got["kept"])
    assert all(rows[i]["quality"]["kept"] for i in range(60))
    assert quality.quality(no_documents.drop("quality")).count() == 0
    kept = quality.keep_good(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in rows if rows[i]["quality"]["kept"]}


@pytest.mark.parametrize("seed", range(4))
def test_repeated_windows(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = [rng.choice("ab" if seed % 2 else "abcdefgh") for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and len(words) > 10:
            words += words[2:12]
        assert quality.repeat_words([w.encode() for w in words]) == brute_quality(" ".join(words))[4]


def test_cascade_order_changes_no_verdict(documents, texts):
    order = quality.plan_cascade(documents)
    assert sorted(order) == sorted(quality.RULES)
    for text, _ in texts:
        assert any(quality.RULES[r](quality.Text(text)) for r in order) == any(f(quality.Text(text)) for f in quality.RULES.values())


# Names that clash, and the stages of the pipeline


def test_clashing_columns_raise(spark, documents):
    from framewright.llm import html, sentencepiece_bpe, url

    pages = spark.createDataFrame([(1, "http://a.org/b", "<p>x", "h", "t", "i")], "page_id long, url string, html string, Host string, text string, ids string")
    with pytest.raises(ValueError, match="language"):
        langid.identify(documents, None)
    with pytest.raises(ValueError, match="quality"):
        quality.quality(documents)
    with pytest.raises(ValueError, match="host"):
        url.filter_urls(pages)
    with pytest.raises(ValueError, match="text"):
        html.extract(pages)
    with pytest.raises(ValueError, match="ids"):
        sentencepiece_bpe.encode(pages, text="html")
    with pytest.raises(ValueError, match="offset"):
        packing.pack(spark.createDataFrame([(1, 2, 3)], "doc_id long, length long, offset long"))
    assert langid.identify(documents, None, to="other").columns == [*documents.columns, "other"]
    assert quality.quality(documents, to="other").columns == [*documents.columns, "other"]


def test_stages_on_odd_documents(spark, documents, no_documents):
    """Every stage keeps the columns, whatever their names, and takes nulls, empty texts, repeats and no rows at all."""
    import corpus_pipeline

    for docs in (documents, no_documents):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_run(spark, documents, texts, tmp_path):
    """run() against its stages one after the other, each checked by brute force where it can be."""
    import corpus_pipeline

    documents.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    langs = {r["doc_id"] for r in langid.keep_identified(documents).collect()}
    good = {i for i, (t, _) in enumerate(texts) if i in langs and not any(f(quality.Text(t)) for f in quality.RULES.values())}
    components = brute_components([t if i in good else None for i, (t, _) in enumerate(texts)])
    first = [i for i in sorted(good) if components[i][1] == i]
    left = brute_suffix([texts[i][0] for i in first])
    lengths = {}
    for r in got:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    twice = {3: 2 if 3 in first else 0}  # its row is there twice
    assert lengths == {i: (len(tokenizer.encode(x[4].decode("utf-8", "ignore"), add_special_tokens=False).ids) + 1) * twice.get(i, 1) for i, x in zip(first, left, strict=True)}


def test_language_by_brute_force(documents, texts):
    """The prediction is the language of the centroid with the highest cosine, counted trigram by trigram."""
    model = langid.fit(documents.where(~langid.held_out(F.col("doc_id"))))
    rows = by_id(langid.identify(documents, model, to="found"))
    mask = (1 << 32) - 1
    for i, (text, _) in enumerate(texts):
        if not any(c.isalpha() for c in text or ""):
            continue
        chars = [c if c.isalpha() else " " for c in f" {text} ".lower()]
        counts = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(chars, chars[1:], chars[2:]):
            if not a == b == " ":
                h = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) & mask
                counts[((((h ^ (h >> 15)) * 0x27D4EB2F) & mask) >> 20) % langid.DIMENSIONS] += 1
        v = np.sqrt(counts) * model["idf"]
        cosines = model["centroids"].astype(np.float64) @ v / np.linalg.norm(v)
        got = rows[i]["found"]
        assert got["lang_pred"] == model["langs"][int(np.argmax(cosines))] and abs(got["score"] - cosines.max()) < 1e-4


# Near copies


def brute_components(texts, least=75):
    def of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())

    sets = [of(t) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def test_jaccard(documents, no_documents, texts):
    rows = by_id(jaccard.jaccard_components(documents))
    expected = brute_components([t for t, _ in texts])
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == dict(enumerate(expected))
    assert jaccard.jaccard_components(documents).count() == len(texts) + 1
    assert jaccard.jaccard_components(no_documents).count() == 0
    kept = jaccard.keep_first(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in enumerate(expected) if c == i}


def test_jaccard_near_the_threshold(spark):
    """A family of edited copies whose similarities lie on both sides of the threshold, and one hot passage."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(60)] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(t))
    texts += [f"{' '.join(rng.choice(words) for _ in range(rng.randint(2, 40)))} {passage}" for _ in range(120)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = by_id(jaccard.jaccard_components(docs))
    assert [(rows[i]["n_shingles"], rows[i]["component_id"]) for i in range(len(texts))] == brute_components(texts)


def test_jaccard_families_open_few_groups(spark, monkeypatch):
    """Texts close to one another but mostly not linked: around one absent base, and with one passage at many sizes."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    passage = " ".join(f"p{rng.randrange(5000)}" for _ in range(40))
    texts = []
    for _ in range(700):
        t = list(base)
        for at in rng.sample(range(150), rng.randint(3, 5)):
            t[at] = f"e{rng.randrange(1 << 30)}"
        texts.append(" ".join(t))
    texts += [" ".join([passage, *(f"e{rng.randrange(1 << 30)}" for _ in range(rng.randint(9, 60)))]) for _ in range(700)]
    given, dealt = [], jaccard._dealt
    monkeypatch.setattr(jaccard, "_dealt", lambda rows: given.append(rows) or dealt(rows))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = by_id(jaccard.jaccard_components(docs))
    assert [(rows[i]["n_shingles"], rows[i]["component_id"]) for i in range(len(texts))] == brute_components(texts)
    first, opened, qualified = given
    for df in (opened, qualified):  # both sides of a join read them
        assert "FlatMapGroupsInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    queries = opened.where("asks").count()
    assert queries < 4 * len(texts), queries  # 8510 while families were spread over small groups of many sizes


def test_shingles_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(2000))
    whole = jaccard.shingles(text)
    monkeypatch.setattr(jaccard, "_PIECE", 100)
    assert (jaccard.shingles(text) == whole).all()


@pytest.mark.parametrize("seed", range(3))
def test_sketches_lose_no_link(seed):
    import numpy as np

    rng = random.Random(seed)

    def some(n):
        return np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)

    sets = []
    for n in (1, 3, 50, 400, 3000):
        base = some(n)
        sets += [np.unique(np.concatenate([base[: max(1, int(n * share))], some(int(n * extra))])) for share in (1, 0.95, 0.85, 0.7) for extra in (0, 0.05, 0.2)]
    sets.append(np.unique(some(200) >> np.uint64(40)))  # all begin alike, so counts stop at 255
    a, b = sets[::2], sets[1::2]
    q, m = jaccard.qualify([jaccard.sketch(x) for x in a], np.array(list(map(len, a))), [jaccard.sketch(x) for x in b], np.array(list(map(len, b))), 75)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if jaccard.linked(x, y):
                assert q[i] and m[j]
    assert not q.all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(80)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    root = {v: v for e in edges for v in e}
    for _ in range(400):
        moved = False
        for a, b in edges:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not moved:
            break
    assert all(got.get(v, v) == r for v, r in root.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Repeated passages


def brute_suffix(texts, length=50):
    seen, out = {}, []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen.setdefault(raw[s : s + length], i) < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_suffix(documents, no_documents, texts):
    expected = brute_suffix([t for t, _ in texts])
    rows = by_id(suffix.suffix_dedup(documents))
    assert {i: tuple(r)[1:] for i, r in rows.items()} == {i: e[:4] for i, e in enumerate(expected)}
    assert suffix.suffix_dedup(no_documents).count() == 0
    cleaned = suffix.remove_repeats(documents)
    assert cleaned.columns == documents.columns
    for r in cleaned.collect():
        assert (r["text"] or "") == expected[r["doc_id"]][4].decode("utf-8", "ignore") and r["n_chars"] in (len(r["text"] or ""), None)


def test_suffix_of_repetitive_texts(spark):
    rng = random.Random(2)
    texts = ["ab" * 100, "ba" * 80, "a" * 200, "", "a" * 49, "a" * 50, ("ab" * 30 + "c") * 4] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    texts += [t[10:] + "x" for t in texts[-10:]]
    rows = by_id(suffix.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)))
    assert {i: tuple(r)[1:] for i, r in rows.items()} == {i: e[:4] for i, e in enumerate(brute_suffix(texts))}


def test_sorter_with_queues_on_disk():
    import numpy as np

    from framewright.llm.induced import Sorter

    rng = np.random.default_rng(0)
    for _ in range(300):
        n, cap = int(rng.integers(1, 80)), int(rng.choice([3, 8, 50]))
        x = (1 + rng.integers(0, int(rng.integers(1, 5)), n)).astype(np.uint8)
        b = bytes(x)
        text = np.concatenate([x, np.zeros(cap + 16, np.uint8)])
        got = list(Sorter(text, n, cap, memory=int(rng.choice([0, 64, 1 << 20]))).suffixes())
        order, common = (np.concatenate(c) for c in zip(*got, strict=True))
        assert sorted(order.tolist()) == list(range(n))
        for i in range(n - 1):
            p, q = b[order[i] : order[i] + cap], b[order[i + 1] : order[i + 1] + cap]
            assert p <= q
            shared = next((k for k in range(min(len(p), len(q))) if p[k] != q[k]), min(len(p), len(q)))
            assert common[i + 1] == min(shared, cap)


def test_suffix_of_null_ids_and_long_texts(spark, monkeypatch):
    """A null id takes nothing and gives nothing; a text of several steps is one text."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(100_000))  # more than one step of bytes
    assert len(long) > suffix.STEP
    shared = long[suffix.STEP - 100 : suffix.STEP + 100]  # across the steps
    texts = [long, f"x {shared} y", long[300:400], "z" * 80]
    df = spark.createDataFrame([*enumerate(texts), (None, shared), (None, long[:500])], "doc_id long, text string").repartition(3)
    got = suffix.suffix_dedup(df).collect()
    expected = brute_suffix(texts)
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == {i: e[:4] for i, e in enumerate(expected)}
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got if r["doc_id"] is None) == [(200, 0), (500, 0)]


def test_frequent_anchors_are_cut(spark, monkeypatch):
    """Pieces around frequent anchors, dealt by longer strings, lose no window."""
    monkeypatch.setattr(suffix, "HOT_LEAST", 2)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(5)) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    texts += [f"{rng.choice(words)} {t[20:150]} {rng.choice(words)}" for t in texts[:20]]
    rows = by_id(suffix.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)))
    assert {i: tuple(r)[1:] for i, r in rows.items()} == {i: e[:4] for i, e in enumerate(brute_suffix(texts))}


def test_shard_sorts_only_windows_that_may_meet():
    """Pieces around one anchor without a common window, and whole copies, aren't sorted; rows between tasks are few."""
    import numpy as np

    rng = random.Random(12)
    some = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    anchor, whole = b"0123456789abcdef", lambda a, b: a + anchor + b
    first = whole(some(34), some(34))

    def ranges(*texts):
        shard = suffix.Shard(50)
        ids = np.array([i for i, _ in texts])
        shard.add(np.array([len(t) for _, t in texts]), ids, np.zeros(len(texts), np.int64), np.full(len(texts), 34), b"".join(t for _, t in texts))
        return [r for part in shard.ranges() for r in zip(*(x.tolist() for x in part), strict=True)], shard.sorted

    copies = [(1, first), (4, first), (2, whole(some(34), some(34)))]
    assert ranges(*copies) == ([(4, 0, 84)], 0)
    found, size = ranges(*copies, (3, first[:64] + some(20)))
    assert sorted(found) == [(3, 0, 64), (4, 0, 84)] and 0 < size < 2 * 84
    assert suffix._filter_log(43_000_000) > 27 >= suffix._filter_log(4_000_000)


def test_pieces_of_texts_together():
    import numpy as np

    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 100, int(n)).astype(np.uint8) for n in (50, 70, 3000, 51, 400)]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    expected = [[x + o if k < 3 else x for k, x in enumerate(r)] for o, t in zip(starts.tolist(), texts, strict=True) for r in zip(*(c.tolist() for c in suffix.pieces(t)), strict=True)]
    assert [list(r) for r in zip(*(c.tolist() for c in suffix.pieces(np.concatenate(texts), 50, starts)), strict=True)] == expected


MEMORY_TEST = """
import resource, sys
import numpy as np
from framewright.llm import induced, suffix
n = 24 << 20
rng = np.random.default_rng(1)
file = induced.scratch_file()
words = rng.integers(97, 123, (4000, 6), np.uint8)
for _ in range(48):  # half a megabyte at a time: pieces of 64 bytes, of which many share windows
    rows = words[rng.integers(0, 4000, (8192, 11))].reshape(8192, 66)[:, :63]
    file.write(np.concatenate([rows + 1, np.zeros((8192, 1), np.uint8)], axis=1).tobytes())
file.write(bytes(200))
file.flush()
pieces = 48 * 8192
text = np.memmap(file, np.uint8, "r")
def anonymous():
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous")) >> 10
before, most = anonymous(), 0
order, last = 0, None
for p, common in induced.Sorter(text, 64 * pieces, 50, 4 << 20).suffixes():
    most = max(most, anonymous())
    order += len(p)
assert order == 64 * pieces
print(64 * pieces >> 20, most - before)
"""


def test_sorter_of_a_text_larger_than_its_memory():
    """24 MB of text, whose suffixes and their values take 216 MB, with a budget of 4 MB."""
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", MEMORY_TEST], capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    size, used = map(int, done.stdout.split())
    assert size == 24 and used < 96, (size, used)


# Packing


@pytest.fixture(scope="module")
def reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(documents, no_documents, texts, reference_tokenizer):
    out = packing.pack_documents(documents, with_ids=True).collect()
    ids = [reference_tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t, _ in texts]
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], set()).add((r["start"], tuple(r["ids"])))
        assert r["length"] == len(r["ids"]) <= 1024
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, expected in enumerate(ids):
        mine = sorted(pieces[i])
        assert [x for _, p in mine for x in p] == expected and [s for s, _ in mine] == [sum(len(p) for _, p in mine[:k]) for k in range(len(mine))]
        assert all(len(p) == 1024 for _, p in mine[1:])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids)) + len(ids[3])
    assert len(sequences) <= -(-total // 1024) + 1
    assert packing.pack_documents(no_documents).count() == 0


def serial_best_fit(sizes, capacity):
    """Sequences that best fit needs, longest first, one piece after the other."""
    from bisect import bisect_left, insort

    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        i = bisect_left(gaps, size)
        if i < len(gaps):
            gap = gaps.pop(i)
        else:
            gap, n = capacity, n + 1
        if gap > size:
            insort(gaps, gap - size)
    return n


@pytest.mark.parametrize(("seed", "n", "capacity"), [(0, 400, 64), (1, 1500, 1024), (2, 1500, 100), (3, 3000, 32)])
def test_packing_needs_no_more_than_serial_best_fit(spark, seed, n, capacity):
    rng = random.Random(seed)
    some = [lambda: rng.randint(1, capacity), lambda: capacity // 3, lambda: rng.randint(1, max(1, capacity // 8)), lambda: capacity // 2 + 1]
    sizes = [rng.choice(some[: 2 + seed % 3])() for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    sequences = {}
    out = packing.pack(df, capacity=capacity).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(n))
    for r in out:
        assert r["length"] == sizes[r["doc_id"]]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    best = serial_best_fit(sizes, capacity)
    assert len(sequences) <= best + max(1, best // 200), (len(sequences), best, -(-sum(sizes) // capacity))


def test_packing_of_long_and_repeated_rows(spark):
    rows = [(1, "word " * 20_000), (1, "word " * 20_000), (None, "x"), (2, None), (2, None), (3, "a <|endoftext|> b")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len([r for r in out if r["doc_id"] == 1]) == 2 * 20 and len([r for r in out if r["doc_id"] is None]) == 1
    assert [r["length"] for r in out if r["doc_id"] == 2] == [1, 1] and [r["length"] for r in out if r["doc_id"] == 3] == [5]
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    assert all(a[0] != b[0] and b[1] == 0 or a[0] == b[0] and a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))


def test_encoders_agree(texts, reference_tokenizer):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        encode = packing.Encoder(f.read())
    assert encode.fast is not None
    odd = ["<|endoftext|> x", "a\u0301 ﬁ", "don't we'll I'M", "\r\n\t  \n x", "\0", "🙂🙂", " " * 50, "123abc_,.;"]
    for t in [t for t, _ in texts if t] + odd:
        assert encode(t).tolist() == reference_tokenizer.encode(t, add_special_tokens=False).ids


# SentencePiece


@pytest.fixture(scope="module")
def reference_pieces():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_sentencepiece(documents, no_documents, texts, reference_pieces):
    rows = by_id(sentencepiece_bpe.digests(documents))
    for i, (text, _) in enumerate(texts):
        ids = reference_pieces.encode(text or "")
        back = reference_pieces.decode(ids)
        assert tuple(rows[i]["encoded"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert sentencepiece_bpe.digests(no_documents).count() == 0
    both = sentencepiece_bpe.decode(sentencepiece_bpe.encode(documents)).where("text is not null").collect()
    assert all(r["decoded"] == r["text"] for r in both)


def test_sentencepiece_on_odd_strings(reference_pieces):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        m = sentencepiece_bpe.Model(f.read())
    rng = random.Random(1)
    parts = ["the", "  ", "\n", "▁", "é", "①", "aaaa", "<s>", "ing", "\t", "日本", "\u0301", "😀", "0", "\x00", " "]
    for _ in range(3000):
        t = "".join(rng.choice(parts) if rng.random() < 0.5 else rng.choice("abcdeghinorstu ") for _ in range(rng.randint(0, 25)))
        ids = reference_pieces.encode(t)
        assert m.encode(t) == ids and m.decode(ids) == reference_pieces.decode(ids)
