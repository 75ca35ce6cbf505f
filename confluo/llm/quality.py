"""Quality rules as learned decision lists.

Each text is described by counts. Sequential covering then learns an ordered list of threshold conjunctions for bad
texts from labelled ones: a rule grows by the condition of most information gain, is pruned on rows it has not seen,
is taken if it is precise there, and the rows it covers go before the next rule grows. The list is a Spark
conditional expression over the counts.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are each judged; labels that
are missing, null or of one class give no rule, and then only the base rule rejects; a null doc_id has no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import short_batches, texts

#: Bound on labelled rows for the fit, those of the lowest hashes of doc_id.
SAMPLE_ROWS = 20_000
#: A learned rule rejects only with this share of bad rows among the unseen ones that it covers, and so many of them.
MIN_PRECISION = 0.97
MIN_COVER = 10

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_alpha long, n_digits long, n_distinct long, n_lines long, n_ends long"
#: What rules compare, as expressions over the counts that are safe for texts without words.
RATIOS = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_alpha, 1)",
    "alpha_share": "n_alpha / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "ends_per_word": "n_ends / greatest(n_words, 1)",
}

_SPACES = b"\t\n\x0b\x0c\r "
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>"


def counts(text: str) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS. Words are runs without ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    n_symbols = len(data) - len(data.translate(None, _SYMBOLS))
    points = len(text) - (len(data) - len(data.translate(None, _SPACES)))
    upper = len(data) - len(data.translate(None, _UPPER))
    letters = upper + len(data) - len(data.translate(None, _LOWER))
    many = len(data) - len(text)  # each letter beyond ASCII adds a byte or more
    digits = len(data) - len(data.translate(None, b"0123456789"))
    ends = len(data) - len(data.translate(None, b".!?"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated, distinct = 0, 0
    if n:
        codes, known = pd.factorize(np.array(words, dtype=object))
        distinct = len(known)
        if n >= 3 and distinct < n:
            repeated = int(_repeated(codes, distinct).sum())
    return (n, points, n_symbols, len(lines) - len(set(lines)), repeated, upper, letters + min(many, points), digits, distinct, len(lines), ends)


def _repeated(codes: np.ndarray, distinct: int) -> np.ndarray:
    """Marks the words in 3-word windows that are found twice or more."""
    pair = codes[:-1].astype(np.int64) * distinct + codes[1:]
    if distinct < 2_000_000:
        window = pair[:-1] * distinct + codes[2:]
    else:  # the product no longer fits; number the pairs first
        numbered = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        window = numbered[:-1] * distinct + codes[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), dtype=bool)
    for k in range(3):
        covered[k : k + len(window)] |= twice
    return covered


def _counts_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in COUNTS.split(", ")]
    for batch in batches:
        yield pd.DataFrame([counts(x) for x in batch], columns=names)


def with_counts(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """docs with a struct column of the counts; all its own columns stay in the JVM."""
    short_batches(docs.sparkSession)
    return docs.withColumn(into, pandas_udf(_counts_of, COUNTS)(texts(docs, text)))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def on(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.value if self.above else x[self.name] <= self.value

    def sql(self) -> str:
        return f"({RATIOS[self.name]}) {'>' if self.above else '<='} {self.value!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.on(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 3) -> Rule:
    """Adds the condition of the highest FOIL gain until the rule covers bad rows only, or is long enough."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most:
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0 or not n0:
            break
        best, found, before = 0.0, None, np.log2(p0 / (p0 + n0))
        for name in sorted(x):
            values = x[name][inside]
            order = np.argsort(values, kind="stable")
            sorted_values, is_bad = values[order], bad[inside][order]
            up = np.cumsum(is_bad)
            edges = np.flatnonzero(sorted_values[1:] > sorted_values[:-1])
            if not len(edges):
                continue
            p_low, n_low = up[edges], edges + 1 - up[edges]
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - before), 0)
                k = int(gain.argmax())
                if gain[k] > best + 1e-9:
                    best, found = float(gain[k]), Condition(name, above, float((sorted_values[edges[k]] + sorted_values[edges[k] + 1]) / 2))
        if found is None:
            break
        rule.append(found)
        inside &= found.on(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops last conditions while (bad - good) / covered on unseen rows does not fall."""

    def worth(r: Rule) -> float:
        inside = _covers(r, x, len(bad))
        return (2 * (inside & bad).sum() - inside.sum()) / max(1, inside.sum())

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(rows: pd.DataFrame, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER, most_rules: int = 12) -> list[Rule]:
    """A decision list for bad rows: columns of RATIOS, and ``good`` (0 or 1). Two thirds grow rules, a third prunes and admits them."""
    rows = rows.dropna(subset=["good"]).reset_index(drop=True)
    hold = np.arange(len(rows)) % 3 == 2
    good = rows["good"].to_numpy() == 1
    x = {k: rows[k].to_numpy(dtype=float) for k in RATIOS}
    rules: list[Rule] = []
    left = np.ones(len(rows), dtype=bool)
    while len(rules) < most_rules:
        a, b = left & ~hold, left & hold
        if (a & ~good).sum() < min_cover:
            break
        rule = _grow({k: v[a] for k, v in x.items()}, ~good[a])
        if not rule:
            break
        rule = _prune(rule, {k: v[b] for k, v in x.items()}, ~good[b])
        inside = _covers(rule, x, len(rows)) & left
        seen, unseen = inside & ~hold, inside & hold
        precise = [(m & ~good).sum() / max(1, m.sum()) for m in (seen, unseen)]
        if unseen.sum() < max(1, min_cover // 3) or inside.sum() < min_cover or min(precise) < min_precision:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as a conditional expression over count columns: the number of the first rule that holds, from 1; 0 if none does."""
    if not rules:
        return F.lit(0)
    cases = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {k}" for k, rule in enumerate(rules, 1))
    return F.expr(f"CASE {cases} ELSE 0 END")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **how) -> list[Rule]:
    """Learns from at most ``rows`` labelled documents, those whose doc_id has the lowest hash; the driver gets their counts alone."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long"), texts(docs).alias("text")).join(F.broadcast(known), "doc_id")
    sample = with_counts(found, "_c").select("doc_id", "good", "_c.*").where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    wide = sample.select("doc_id", "good", *(F.expr(e).cast("double").alias(k) for k, e in RATIOS.items())).toPandas()
    return learn(wide.sort_values(["doc_id", *RATIOS], kind="stable"), **how)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per document: doc_id, counts, base_failed, the rule that rejects it (0: none) and kept."""
    wide = with_counts(docs, "_c").select(F.col("doc_id").cast("long"), "_c.*")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    wide = wide.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return wide.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that neither the base rule nor a learned one rejects, with their own columns."""
    wide = with_counts(docs, "_confluo_counts")
    c = F.col("_confluo_counts")
    flat = wide.select("*", *(c[k].alias(f"_confluo_{k}") for k in (x.split()[0] for x in COUNTS.split(", "))))
    failed = base_failed(F.col("_confluo_n_words"), F.col("_confluo_n_repeat_words"))
    cases = [[Condition(k.name, k.above, k.value).sql() for k in rule] for rule in rules]
    names = [x.split()[0] for x in COUNTS.split(", ")]
    bad = failed
    for rule in cases:
        held = F.lit(True)
        for sql in rule:
            held &= F.expr(_renamed(sql, names))
        bad |= held
    return flat.where(~bad).select(*(F.col(f"`{k}`") for k in docs.columns))


def _renamed(sql: str, names: list[str]) -> str:
    import re

    return re.sub(rf"\b({'|'.join(names)})\b", r"_confluo_\1", sql)
