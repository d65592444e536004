import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import chat, html, url, vectors

# Chat


def test_chat(spark):
    rows = [(1, 2, "assistant", "b<|end|>\n[INST]"), (1, 1, "user", "a\\<"), (1, 3, "assistant", None), (2, 1, None, ""), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, None, "system", "<|turn|><|text|>"), (4, 1, "a<|b", "é🙂[")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "a\\<"), ("assistant", "b<|end|>\n[INST]"), ("assistant", "")]
    assert got[1]["loss_text"] == "b<|end|>\n[INST]" and got[1]["formatted"].count("<|turn|>") == 2
    assert [tuple(t) for t in got[2]["turns"]] == [("", "")]
    assert [tuple(t) for t in got[3]["turns"]] == [("system", "<|turn|><|text|>"), ("user", "x"), ("user", "x")]
    assert [tuple(t) for t in got[4]["turns"]] == [("a<|b", "é🙂[")]
    for r in made.collect():
        assert sum(x["length"] for x in r["loss_runs"]) == len(r["formatted"])
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("<[\\|/s>]a\n") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in out)
    assert not any(c in r["e"] for r in out for c in ("<|", "</s>", "[INST]", "[/INST]"))


# HTML

ARTICLE = "<p>The first paragraph of the article is long enough to be decided, and it has the words that a text has to have in it.</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just the text", "just the text"),
        (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head &amp; line</h1>{ARTICLE}<p>Short.</p></article><footer>&copy; x</footer>", "Head & line\nThe first paragraph of the article is long enough to be decided, and it has the words that a text has to have in it.\nShort."),
        ("<article><p><b>Unclosed bold.<br><p>Next one.</p></article>", "Unclosed bold.\nNext one."),
        ("<article><p>a&lt;b&#33; &eacute;&nbsp;x</p><script>var t='</p>'</script><!-- <p>no</p> --></article>", "a<b! é x"),
        (f"<div class='cookie-notice'>We use cookies and the site needs them to work for you in all of its parts.</div><div id=content>{ARTICLE}</div><div class='comments'><p>I think that this is the best of all the things that I have read on the subject.</p></div>", "The first paragraph of the article is long enough to be decided, and it has the words that a text has to have in it."),
        (f"<article><header><h2>Title</h2></header>{ARTICLE}<aside>More of the same, and more of it.</aside><form><label>Mail</label></form><section class=comments><p>First! It is the best that I have seen in all of the years.</p></section></article>", "Title\nThe first paragraph of the article is long enough to be decided, and it has the words that a text has to have in it."),
        ("<article><p>one\n two\t three</p><p>four", "one two three\nfour"),
        ("<article><p>cut in a tag<p cla", "cut in a tag"),
    ],
)
def test_html(page, text):
    assert html.main_text(page) == text


def test_html_is_linear():
    page = "<article>" + "<p><b>word and the word<br>" * 20000 + "</article>"
    assert html.main_text(page).count("\n") == 19999
    assert html.main_text("<div>" * 50000 + "the text" + "</i>" * 50000) == "the text"


def test_html_table(spark):
    rows = [(1, "u", "<article><p>x y</p></article>", "clash"), (2, None, None, "clash"), (1, "u", "<article><p>x y</p></article>", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["main"], r["text"]) for r in html.extract(df, to="main").collect()) == [(1, "x y", "clash"), (1, "x y", "clash"), (2, "", "clash")]
    with pytest.raises(ValueError, match="text"):
        html.extract(df)
    assert html.extract(df.limit(0), to="main").count() == 0


# What must not throw an article's text away, each by the way it once was or might be.
ODD_PAGES = (
    "<article><div class='overflow-hidden'>{}</div></article>",
    "<article><div aria-hidden='false'>{}</div></article>",
    "<article><div title='hidden gems'>{}</div></article>",
    "<article><div data-hidden=1>{}</div></article>",
    "<datalist><option value=a><option value=b></datalist><article>{}</article>",
    "<select><option value=a><option value=b></select><article>{}</article>",
    "<select><option>a<article>{}</article>",
    "<div class='entry has-comments no-sidebar'>{}</div>",
    "<article><section id='related-work'>{}</section></article>",
    "<div class='article-header'><h1>{}</h1></div>",
    "<form id=aspnetForm>{}</form>",
)
HIDDEN_PARTS = (
    "<div hidden>{}</div>",
    "<div aria-hidden='true'>{}</div>",
    "<div style='display: none'>{}</div>",
    "<div class='post-comments'>{}</div>",
    "<section id=commentList>{}</section>",
    "<div class='ad-slot'>{}</div>",
    "<div class='sidebar left'>{}</div>",
    "<aside>{}</aside>",
    "<div role=navigation>{}</div>",
    "<div class='cookie-notice'>{}</div>",
    "<div class='comments'><article>{}</article></div>",
)


@pytest.mark.parametrize("page", ODD_PAGES)
def test_html_keeps(page):
    assert html.main_text(page.format(ARTICLE)) == html.main_text(ARTICLE) != ""


@pytest.mark.parametrize("part", HIDDEN_PARTS)
def test_html_drops(part):
    other = "<p>It is the text of another part, which is as long as that of the article and has as many of the words in it.</p>"
    assert html.main_text(f"<article>{ARTICLE}{part.format(other)}</article>") == html.main_text(ARTICLE)
    assert html.main_text(f"<div>{ARTICLE}</div>{part.format(other)}") == html.main_text(ARTICLE)


def brute_labels(blocks):
    """The two passes read off their definition: for every block all others are looked at."""
    has_article = any(b.article for b in blocks)
    first = [html.decide(b, has_article)[0] for b in blocks]
    if not has_article and True not in first:
        first = [html.decide(b, False, weak=False)[0] for b in blocks]
    edges = [i > 0 and blocks[i].group != blocks[i - 1].group for i in range(len(blocks))]

    def apart(i, j):
        return abs(i - j) + html.STRIDE * sum(edges[min(i, j) + 1 : max(i, j) + 1])

    out = []
    for i, b in enumerate(blocks):
        if first[i] is not None:
            out.append(first[i])
            continue
        own = [j for j in range(len(blocks)) if blocks[j].article == b.article]
        heard = [j for j in own if first[j] is not None and not (b.article and blocks[j].evidence >= html.WEAK)]
        sides = []
        for some, end in (([j for j in heard if j < i], own[0]), ([j for j in heard if j > i], own[-1])):
            if some:
                sides.append((min(apart(i, j) for j in some), first[min(some, key=lambda j: apart(i, j))]))
            elif has_article:
                sides.append((apart(i, end) + 1, bool(b.article)))
        nearest = min((d for d, _ in sides), default=None)
        says = {x for d, x in sides if d == nearest}
        one_container = any(0 <= j < len(blocks) and apart(i, j) == 1 for j in (i - 1, i + 1))
        out.append(True if not says else says.pop() if len(says) == 1 else one_container)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_html_labels(seed):
    rng = random.Random(seed)
    parts = ["<p>short</p>", "<p>" + "zzz " * 30 + "</p>", "<p>" + "the text of it " * 8 + "</p>", "<p>" + "the text of it " * 20 + "</p>", "<p><a href=x>link</a></p>", "<nav>menu</nav>", "<form>form</form>", "<div>", "</div>", "<div class=sidebar>side</div>", "<article>", "</article>", "<li>x"]
    for _ in range(300):
        blocks = html.blocks_of("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))))
        assert html.label_blocks(blocks) == brute_labels(blocks)


def test_html_rules_find_articles_without_their_tags(spark):
    """Without article elements and class names, the rules alone must find nearly all of the same blocks."""
    import re

    same = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        want = html.main_text(r["html"]).split("\n")
        bare = re.sub(r" class=\"[^\"]*\"", "", re.sub(r"</?article>", "", r["html"]))
        got = html.main_text(bare).split("\n")
        same += len(set(want) & set(got))
        total += len(set(want) | set(got))
    assert same >= 0.94 * total


# URLs


def test_urls(spark):
    cases = [
        ("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://blog.example.com/en/1", "blog.example.com", "/en/1", "example.com/en/", "block"),
        ("https://example.com/fr", "example.com", "/fr", "com/", "allow"),
        ("http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
        ("http://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.com", "a.com", "", None, None),
        ("http://a.com?q=/", "a.com", "", None, None),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("x://É.com/a", "É.com", "/a", "com/", "allow"),
        ("http://online-casino-bonus.org/en/play", "online-casino-bonus.org", "/en/play", None, "block"),
        ("http://www.library-notes.org/en/7", "www.library-notes.org", "/en/7", None, "allow"),
        ("http://" + "a" * 20000 + ".org/" + "b" * 20000, "a" * 20000 + ".org", "/" + "b" * 20000, None, None),
    ]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, verdict string").drop("verdict")
    for r in url.filter_urls(df).collect():
        _, host, path, rule, verdict = cases[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    assert url.filter_urls(df.limit(0)).count() == 0


def test_url_model_learns_its_table(spark):
    rows = [("http://" + u, want) for us, want in ((url.BLOCKED, "block"), (url.ALLOWED, "allow")) for u in us]
    df = spark.createDataFrame(rows, "url string, want string")
    assert url.filter_urls(df, rules=()).where("want = verdict").count() >= 0.97 * len(rows)


# Vectors


def brute_vectors(rows, threshold=0.93):
    ids = sorted({r[0] for r in rows})
    value = {r[0]: r for r in rows}
    good = {i: np.array(value[i][1], float) / np.linalg.norm(np.array(value[i][1], float)) for i in ids if value[i][2] is not None and value[i][1] is not None and all(x is not None and np.isfinite(x) for x in value[i][1]) and any(value[i][1])}
    links = {i: {j for j in good if j != i and value[i][2] == value[j][2] and len(good[i]) == len(good[j]) and float(good[i] @ good[j]) >= threshold} if i in good else set() for i in ids}
    root = {i: i for i in ids}
    for _ in ids:
        fresh = {i: min([root[i], *(root[j] for j in links[i])]) for i in ids}
        if fresh == root:
            break
        root = fresh
    return {i: (len(links[i]), root[i], root[i] == i) for i in ids}


@pytest.mark.parametrize(("assign", "block"), [(1 << 14, 1024), (20, 16)])
def test_vectors(spark, monkeypatch, assign, block):
    monkeypatch.setattr(vectors, "ASSIGN_ROWS", assign)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(260):
        centre = np.random.default_rng(i % 40).normal(size=8)
        rows.append((i, [float(np.float32(x)) for x in centre + rng.normal(size=8) * 0.35], i % 3 if i % 17 else None))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(1100 + i, [float(np.float32(x)) for x in np.random.default_rng(99).normal(size=8) + rng.normal(size=8) * (0.01 + 0.004 * i)], 1) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] + [1.0] * 7, 1), (2003, [float("inf")] + [1.0] * 7, 1), (2004, [None] + [1.0] * 7, 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1), (2008, [1e-30, 2e-30], 1)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in [*rows, rows[7]]], "vec_id long, embedding array<float>, label int, cell string, n int").repartition(3)
    got = vectors.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    expected = brute_vectors(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == expected
    assert sum(e[0] for e in expected.values()) > 500
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# The registered queries


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.001")
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before.count(), name
        before = spark.createDataFrame(after.collect(), docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, before, "").collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in before.collect()}


def test_chat_query_digest(spark):
    from framewright.llm import registry

    r = registry.QUERIES["op4_chat_formatting"](spark, "/root/testdata/sf0.001").where("conv_id = -1").head()
    hostile = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(hostile) and r["loss_sha256"] == hashlib.sha256(hostile.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{hostile}\nassistant\n{hostile}\n".encode()).hexdigest()
