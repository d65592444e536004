"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a bounded sample; the cascade then runs the rules in order of
rejections per cost and stops at a document's first rejection. The order changes only the time, never a verdict.

Texts are split into words at ASCII white space. A null text has no words. An empty text has none either and fails the
base rule; very long texts are handled whole, with one 8-byte number a word. Repeated rows get equal results, extra
columns stay, but for one named like the result, which raises an error; an empty table gives an empty result. Where all
counts are asked for, they are taken before the cascade, and a rule's cost is what it costs beyond them.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import bounded_batches, fresh_columns, table

#: Documents on which costs and rejections are measured.
SAMPLE_ROWS = 1000
WINDOW = 8

# Thresholds of the rules.
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_SYMBOLS_PERCENT = 10
MAX_DUPLICATE_LINES_PERCENT = 30
MEAN_WORD_CHARS = (3, 12)
MAX_UPPER_PERCENT = 40
MAX_TOP_WORD_PERCENT = 25
MIN_ALPHABETIC_PERCENT = 60

MAX_STUTTER_PERCENT = 20

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_PIECE = 1 << 20
_KINDS: list[np.ndarray] = []


def _letters_and_capitals(x: Text) -> tuple[int, int]:
    if not _KINDS:  # for each code point 1 if it is a letter, 2 more if it is a capital; made once a process
        _KINDS.append(np.fromiter((chr(i).isalpha() + 2 * chr(i).isupper() for i in range(0x110000)), np.uint8, 0x110000))
    letters = capitals = 0
    for at in range(0, len(x.text), _PIECE):
        kinds = _KINDS[0][np.frombuffer(x.text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters += int((kinds & 1).sum())
        capitals += int((kinds > 1).sum())
    return letters, capitals


class Text:
    """A text and what rules measure on it, computed when first asked for."""

    __slots__ = ("text", "words", "_counts")

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.encode().split()  # bytes split at ASCII white space only
        self._counts: dict = {}

    def count(self, name: str):
        if name not in self._counts:
            self._counts[name] = _MEASURES[name](self)
        return self._counts[name]


def _word_chars(x: Text) -> int:
    return len(x.text) - sum(x.text.count(c) for c in " \t\n\v\f\r")


def _duplicate_lines(x: Text) -> int:
    lines = [line for line in x.text.encode().split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _lines(x: Text) -> int:
    return sum(1 for line in x.text.encode().split(b"\n") if line.strip())


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = hashes[:n].copy()
    for i in range(1, window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    for i in np.flatnonzero(maybe).tolist():  # equal hashes only suggest; the words decide
        k = tuple(words[i : i + window])
        if k in seen:
            for at in (seen[k], i):
                covered[at] += 1
                covered[at + window] -= 1
        else:
            seen[k] = i
    return int((np.cumsum(covered) > 0).sum())


def _top_word(x: Text) -> int:
    return max(Counter(x.words).values(), default=0)


def _stutter(x: Text) -> int:
    return sum(map(eq, x.words, x.words[1:]))


_MEASURES: dict[str, Callable] = {
    "word_chars": _word_chars,
    "n_symbols": lambda x: len(_SYMBOLS.findall(x.text)),
    "n_dup_lines": _duplicate_lines,
    "n_lines": _lines,
    "n_repeat_words": lambda x: repeat_words(x.words),
    "top_word": _top_word,
    "stutter": _stutter,
    "letters_and_capitals": _letters_and_capitals,
}

#: True: the document goes.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda x: len(x.words) < MIN_WORDS,
    "repeated_windows": lambda x: 100 * x.count("n_repeat_words") > MAX_REPEATED_PERCENT * len(x.words),
    "symbols": lambda x: 100 * x.count("n_symbols") > MAX_SYMBOLS_PERCENT * len(x.words),
    "duplicate_lines": lambda x: 100 * x.count("n_dup_lines") > MAX_DUPLICATE_LINES_PERCENT * x.count("n_lines"),
    "word_length": lambda x: not MEAN_WORD_CHARS[0] * len(x.words) <= x.count("word_chars") <= MEAN_WORD_CHARS[1] * len(x.words),
    "capitals": lambda x: 100 * x.count("letters_and_capitals")[1] > MAX_UPPER_PERCENT * max(1, x.count("letters_and_capitals")[0]),
    "one_word": lambda x: 100 * x.count("top_word") > MAX_TOP_WORD_PERCENT * len(x.words),
    "stutter": lambda x: 100 * x.count("stutter") > MAX_STUTTER_PERCENT * len(x.words),
    "letters": lambda x: 100 * x.count("letters_and_capitals")[0] < MIN_ALPHABETIC_PERCENT * x.count("word_chars"),
}


#: What every text is counted for where counts are asked for.
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure_rules(documents: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, with_counts: bool = False) -> list[tuple[str, int, int]]:
    """(rule, nanoseconds, rejections) over a sample of about ``sample_rows`` rows, one row of sums a rule."""
    n = documents.count()
    sample = documents.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(max(1, n // max(1, sample_rows)))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 0)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for name, rule in RULES.items():
                    x = Text(value)
                    for c in COUNTS if with_counts else ():
                        x.count(c)
                    began = time.perf_counter_ns()
                    rejected[name] += rule(x)
                    spent[name] += time.perf_counter_ns() - began
        yield pa.RecordBatch.from_pydict({"rule": list(RULES), "ns": list(spent.values()), "rejected": list(rejected.values())})

    sums = sample.mapInArrow(run, "rule string, ns long, rejected long").groupBy("rule").agg(F.sum("ns").alias("ns"), F.sum("rejected").alias("rejected"))
    return [tuple(r) for r in sums.collect()]  # as many rows as rules


def plan_cascade(documents: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, with_counts: bool = False) -> list[str]:
    """All rules, those with most rejections per cost first; ties and an empty sample keep the order by name."""
    found = {rule: rejected / max(1, ns) for rule, ns, rejected in measure_rules(documents, text, sample_rows, with_counts)}
    return sorted(RULES, key=lambda r: (-found.get(r, 0.0), r))


_COLUMNS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()))
_TYPE = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,kept:boolean>"


def verdict_udf(order: list[str], with_counts: bool = True):
    """text -> counts and verdict. Without counts only what the cascade reaches is measured; the counts are then null."""

    @F.arrow_udf(_TYPE)
    def judge(texts: pa.Array) -> pa.Array:
        out: list[tuple] = []
        for value in texts.to_pylist():
            x = Text(value)
            counts = (len(x.words), *map(x.count, COUNTS)) if with_counts else (None,) * 5
            base = RULES["few_words"](x) or RULES["repeated_windows"](x) if with_counts else None
            kept = not any(RULES[r](x) for r in order)
            out.append((*counts, base, kept))
        columns = list(zip(*out, strict=True)) or [()] * len(_COLUMNS)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)], names=[n for n, _ in _COLUMNS])

    return judge.asNondeterministic()  # else the optimizer may run it once for each column taken from it


def quality(documents: DataFrame, text: str = "text", with_counts: bool = True, to: str = "quality") -> DataFrame:
    """``documents`` with the struct column ``to``: counts, base_failed and kept."""
    bounded_batches(documents.sparkSession)
    fresh_columns(documents, to)
    return documents.withColumn(to, verdict_udf(plan_cascade(documents, text, with_counts=with_counts), with_counts)(text))


def keep_good(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that no rule rejects, with their columns."""
    bounded_batches(documents.sparkSession)
    verdict = "__framewright_verdict"
    judged = documents.withColumn(verdict, verdict_udf(plan_cascade(documents, text), False)(text))
    return judged.where(F.col(verdict)["kept"]).drop(verdict)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every document."""
    return quality(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "quality.*")


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL = {
    "op2_quality_rules": r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, string_split(t, chr(10)) as lines,
    length(regexp_replace(t, '[^\p{L}]', '', 'g')) as letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) as capitals,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars from d),
l as (select r, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
windows as (select r, i, list_slice(ws, i, i + 7) as win from w, unnest(generate_series(1, len(ws) - 7)) as s(i)),
twice as (select r, unnest(list(i)) as i from windows group by r, win having count(*) > 1),
covered as (select r, count(distinct i + k) as n from twice, unnest(generate_series(0, 7)) as s(k) group by r),
word as (select r, count(*) as n from (select r, unnest(ws) as x from w) group by r, x),
top as (select r, max(n) as n from word group by r),
stutter as (select r, count(*) as n from w, unnest(generate_series(1, len(ws) - 1)) as s(i) where ws[i] = ws[i + 1] group by r),
c as (select d.doc_id, len(ws) as n_words, word_chars, n_symbols, len(l.lines) - len(list_distinct(l.lines)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
    len(l.lines) as n_lines, letters, capitals, coalesce(top.n, 0) as top, coalesce(stutter.n, 0) as stutter
  from d join w using (r) join l using (r) left join covered using (r) left join top using (r) left join stutter using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 30 * n_lines or word_chars < 3 * n_words or word_chars > 12 * n_words
    or 100 * capitals > 40 * greatest(1, letters) or 100 * top > 25 * n_words or 100 * stutter > 20 * n_words or 100 * letters < 60 * word_chars) as kept
from b""",
}
