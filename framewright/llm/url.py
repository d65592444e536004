"""URL filters: host and path rules, then logistic regression on hashed character n-grams of host and path.

Everything is a DataFrame expression: the model is trained by gradient descent inside array functions over a small
labelled table, and its weights (as many as DIMENSIONS, whatever the data) become a literal of the scoring expression.

The n-grams are hashed by sums of products of their code points, the labelled table is built from literals, and the weights
are kept for the session once they are trained. A probability of exactly one half allows.

The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z in lower case;
the path follows it up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has both empty, meets no rule
and gets the model's verdict on empty strings, which is allow. Repeated rows get equal results, extra columns stay, but
for those named like a result, which raise an error; an empty table gives an empty result, and the work is linear in a
URL's length.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import fresh_columns, table

DIMENSIONS, NGRAMS, STEPS, RATE, DECAY = 8192, (3, 4, 5), 300, 8.0, 1e-4
#: Of the hash of an n-gram: a code point's factor by its place, and one for n; the prime it is taken by.
FACTORS, PRIME = (7919, 104729, 611953, 350377, 224737, 15485863), 1_000_003

# Rules as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

# Labelled URLs, host and path; those of the first group are to be blocked.
BLOCKED = (
    "casino-royal.test/play", "www.casino-bonus.test/en/12", "m.win-casino.test/slots", "online-casino.test/", "mega-casino.test/de/7",
    "free-betting.test/en/4", "blog.free-bets-now.test/odds", "sports-bets.test/", "www.best-bets.test/fr/9", "bets-win.test/live",
    "cheap-pill-shop.test/buy", "www.discount-pills.test/en/33", "diet-pills.test/", "m.pills-online.test/order", "cheap-meds.test/es/5",
    "adult-cams.test/cam", "www.adult-video.test/en/8", "xxx-adult.test/", "m.adult-chat.test/de/3", "adult-tube.test/watch",
    "ads-tracker.test/click", "www.ads-server.test/banner", "track-ads.test/pixel", "m.ads-tracking.test/en/2", "popup-ads.test/",
    "spam-factory.test/en/6", "www.link-farm.test/", "spam-links.test/fr/1", "m.spam-blog.test/post", "content-farm-spam.test/es/2",
    "poker-win.test/table", "www.lottery-winner.test/claim", "free-cash-loans.test/", "payday-loans.test/apply", "replica-watches.test/sale",
    "adult.test/de/41", "blog.adult-dating.test/en/2", "adults-only.test/fr/4", "www.adult-movies.test/es/19", "m.adult-pics.test/en/70",
)
ALLOWED = (
    "www.library.test/en/12", "blog.gardening.test/posts/7", "news.city.test/fr/4", "university.test/courses", "m.weather.test/de/3",
    "www.museum.test/", "recipes.kitchen.test/en/45", "blog.mountain.test/es/9", "science.journal.test/articles/2", "www.school.test/en/8",
    "travel.notes.test/fr/1", "history.archive.test/de/77", "m.music.test/albums", "www.theatre.test/en/5", "docs.software.test/manual",
    "thunder-blog.test/en/48", "www.honour.test/de/606", "nation.test/en/231", "m.three-rivers.test/es/510", "theroux.test/fr/588",
    "northern.test/en/20", "than-thy.test/en/938", "www.stationable.test/en/25", "thirst.test/de/833", "m.gathering.test/es/735",
    "photos.family.test/2020", "www.cooking.test/soup.html", "forum.cycling.test/en/3", "maps.region.test/", "www.bakery.test/en/66",
    "theatre.test/en/97.html", "blog.exertion.test/fr/414", "blog.thea.test/en/126", "farmers-market.test/", "track-and-field.test/en/4",
    "aqueduct.test/de/41", "blog.adalbert.test/en/2", "museum-only.test/fr/4", "www.quiet-movies.test/es/19", "m.garden-pics.test/en/70",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; both null if none fits."""
    name = verdict = None
    for rule_host, rule_path, says in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def features(host: Column, path: Column) -> Column:
    """The hashed n-grams of ``^host$path$``, one integer from 0 for each, repeats kept."""
    text = F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$"))
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))

    def grams(codes: Column) -> Column:
        def of(n: int) -> Column:
            def hashed(c: Column, i: Column) -> Column:
                total = c * FACTORS[0] + FACTORS[5] * n
                for k in range(1, n):
                    total = total + F.coalesce(F.get(codes, i + k), F.lit(0)) * FACTORS[k]
                return (total % PRIME % DIMENSIONS).cast("int")

            return F.transform(codes, hashed)

        return F.concat(*map(of, NGRAMS))

    return F.transform(F.array(codes), grams)[0]  # as a variable the characters are split once, not once for each gram


_TRAINED: dict[tuple, list[float]] = {}


def train(spark: SparkSession, blocked=BLOCKED, allowed=ALLOWED) -> list[float]:
    """Weights by full-batch gradient descent over the labelled table; the last one is the bias.

    The weights stay in the span of the labelled rows, so the descent runs on one coefficient a row, inside one array
    expression over the rows' products with each other.
    """
    table_ = (tuple(blocked), tuple(allowed))
    if table_ in _TRAINED:
        return _TRAINED[table_]
    n = len(blocked) + len(allowed)
    rows = [F.struct(F.lit(i).alias("r"), F.lit(u).alias("u"), F.lit(float(i < len(blocked))).alias("y")) for i, u in enumerate((*blocked, *allowed))]
    host, path = F.substring_index("u", "/", 1), F.regexp_extract("u", "(/.*)", 1)
    labelled = spark.range(1).select(F.inline(F.array(*rows))).select("r", "y", features(host, path).alias("g"))
    grams = labelled.select("r", "y", F.explode("g").alias("i"), F.sqrt(F.size("g").cast("double")).alias("s")).groupBy("r", "y", "i", "s").agg((F.count(F.lit(1)) / F.first("s")).alias("x"))
    other = grams.select(F.col("r").alias("q"), "i", F.col("x").alias("z"))
    products = grams.join(other, "i").groupBy("r", "y", "q").agg((F.round(F.sum(F.col("x") * F.col("z")), 9) + 1).alias("k"))  # 1 for the bias
    row = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda q: F.coalesce(F.get(F.map_values(F.map_filter("m", lambda j, _: j == q)), F.lit(0)), F.lit(1.0)))
    data = products.groupBy("r", "y").agg(F.map_from_entries(F.collect_list(F.struct("q", "k"))).alias("m"))
    data = data.select(F.struct("r", "y", row.alias("k")).alias("d")).agg(F.sort_array(F.collect_list("d")).alias("d"))  # one row, n arrays of n

    def step(alpha: Column, _: Column) -> Column:
        def descend(a: Column, d: Column) -> Column:
            z = F.aggregate(F.zip_with(alpha, d["k"], lambda p, k: p * k), F.lit(0.0), lambda t, v: t + v)
            return a * (1 - RATE * DECAY) - RATE / n * (1 / (1 + F.exp(-z)) - d["y"])

        return F.zip_with(alpha, "d", descend)

    alpha = data.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array_repeat(F.lit(0.0), n), step).alias("a")).head()["a"]
    weight = F.round(F.sum(F.get(F.lit(alpha), F.col("r")) * F.col("x")), 9)
    weights = [0.0] * DIMENSIONS + [sum(alpha)]
    for i, w in grams.groupBy("i").agg(weight.alias("w")).collect():  # DIMENSIONS rows at most
        weights[i] = w
    _TRAINED[table_] = weights
    return weights


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability that the URL is to be blocked."""
    w = F.lit(weights[:-1])

    def logit(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, i: s + F.get(w, i)) / F.sqrt(F.size(x).cast("double")) + F.lit(weights[-1])

    return 1 / (1 + F.exp(-F.transform(F.array(features(host, path)), logit)[0]))


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, weights: list[float] | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    fresh_columns(pages, "host", "path", "rule", "verdict")
    weights = weights or train(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(score(F.col("host"), F.col("path"), weights) > 0.5, "block").otherwise("allow")
    return pages.withColumns({"host": host, "path": path}).withColumn("rule", rule).withColumn("verdict", F.coalesce(says, own))


def plain_weights(blocked=BLOCKED, allowed=ALLOWED) -> tuple[dict[int, float], float]:
    """The same training written with plain loops, for the SQL that checks the query: weights other than 0, and the bias."""
    rows = []
    for u in (*blocked, *allowed):
        host, slash, path = u.partition("/")
        codes = [ord(c) for c in f"^{host}${slash}{path}$"]
        grams = [(sum(c * f for c, f in zip(codes[i : i + n], FACTORS, strict=False)) + FACTORS[5] * n) % PRIME % DIMENSIONS for n in NGRAMS for i in range(len(codes))]
        x: dict[int, float] = {}
        for g in grams:
            x[g] = x.get(g, 0.0) + 1 / len(grams) ** 0.5
        rows.append(x)
    y = [float(i < len(blocked)) for i in range(len(rows))]
    weights, bias = {}, 0.0
    for _ in range(STEPS):
        errors = [1 / (1 + exp(-bias - sum(v * weights.get(g, 0.0) for g, v in x.items()))) - t for x, t in zip(rows, y, strict=True)]
        weights = {g: w * (1 - RATE * DECAY) for g, w in weights.items()}
        bias = bias * (1 - RATE * DECAY) - RATE / len(rows) * sum(errors)
        for x, e in zip(rows, errors, strict=True):
            for g, v in x.items():
                weights[g] = weights.get(g, 0.0) - RATE / len(rows) * e * v
    return weights, bias


def _sql() -> str:
    weights, bias = plain_weights()
    values = ", ".join(f"({g}, {w:.9f})" for g, w in sorted(weights.items()))
    grams = " union all ".join(f"select page_id, ({' + '.join(f'coalesce(c[i + {k}], 0) * {FACTORS[k]}' for k in range(n))} + {FACTORS[5] * n}) % {PRIME} % {DIMENSIONS} as g from p, unnest(generate_series(1, len(c))) as s(i)" for n in NGRAMS)
    rules = "\n".join(f"    when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{t}') then '{h}{t}'" for h, t, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    says = " ".join(f"when '{h}{t}' then '{v}'" for h, t, v in RULES)
    return f"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1, 's') as path from pages),
p as (select page_id, list_transform(string_split('^' || host || '$' || path || '$', ''), lambda x: unicode(x)::bigint) as c from u),
w(g, w) as (values {values}),
m as (select page_id, {bias:.12f} + sum(coalesce(w, 0)) / sqrt(count(*)) as z from ({grams}) left join w using (g) group by page_id),
r as (select *, case
{rules} end as rule from u)
select page_id, host, path, rule, coalesce(case rule {says} end, case when z > 0 then 'block' else 'allow' end) as verdict from r join m using (page_id)"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op10_url_filters": op10_url_filters}
SQL = {"op10_url_filters": _sql()}
