"""Weak supervision over quality rules, in DataFrame functions only.

Each rule looks at a text's statistics and votes good, bad or abstains. No rule decides alone: expectation
maximisation estimates, without labels, how each rule votes on good and on bad texts, and the posterior
probability of being good replaces all-must-pass filtering. EM runs on the table of distinct vote patterns with
their counts, which has at most ``3 ** len(RULES)`` rows whatever the corpus; texts take their posterior from
the same table.

Statistics are computed within a row, from the array of the text's words: no shuffle, no group.

Defined results: a null text has no words; without words all rules that need some abstain and the base fails;
repeated rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WS, let, stored

#: White space as characters, for trimming.
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds; abstains otherwise or where ``needs`` fails."""

    name: str
    bad: str
    good: str
    needs: str = "n_words > 0"


#: Over the columns of :func:`statistics`. Bounds are those that published web-text filters use, or near them.
RULES = [
    Rule("length", "n_words < 50", "n_words between 80 and 100000", "true"),
    Rule("word_size", "word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    Rule("symbols", "n_symbols * 10 > n_words", "n_symbols * 100 <= n_words"),
    Rule("dup_lines", "n_dup_lines * 10 > 3 * n_lines", "n_dup_lines * 20 <= n_lines", "n_lines >= 4"),
    Rule("repeats", "n_repeat_words * 10 > 3 * n_words", "n_repeat_words * 20 <= n_words", "n_words >= 10"),
    Rule("letters", "n_letters * 10 < 7 * word_chars", "n_letters * 100 >= 85 * word_chars"),
    Rule("capitals", "n_capitals * 10 > 4 * n_letters", "n_capitals * 10 <= n_letters", "n_letters > 20"),
    Rule("sentences", "n_stops * 60 < n_words", "n_stops * 30 >= n_words", "n_words >= 30"),
]
#: Posterior from which a text is kept.
KEEP = 0.5


def words_of(text: Column) -> Column:
    """The words between ASCII white space; an empty array for null or blank."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WS + "+"))


def _bits(n: Column) -> Column:
    """Bits that hold any position below n."""
    return F.length(F.bin(n.cast("long")))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that stand twice or more in the text.

    Each window's hash, less the low bits, carries its position in them; sorting these numbers, a primitive
    sort, puts equal windows side by side. Neighbours count as equal only if their words are, so that cut
    hashes decide nothing. The windows' union is measured in position order.
    """
    n = F.size(words)
    places = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def windows(h: Column, low: Column) -> Column:
        high = F.bitwise_not(low)

        def keyed(x: Column, i: Column) -> Column:
            return x.bitwiseAND(high).bitwiseOR(i.cast("long"))

        def same(a: Column, b: Column) -> Column:
            p, q = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
            texts = [F.get(words, p + k) == F.get(words, q + k) for k in range(3)]
            return (a.bitwiseXOR(b).bitwiseAND(high) == 0) & texts[0] & texts[1] & texts[2]

        def repeated(keys: Column) -> Column:
            def twice(x: Column, i: Column) -> Column:
                return F.coalesce(same(x, F.get(keys, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(keys, i + 1)), F.lit(False))

            return F.sort_array(F.transform(F.filter(keys, twice), lambda x: x.bitwiseAND(low)))

        def covered(at: Column) -> Column:
            # Each window adds what reaches beyond the one before it.
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
            add = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last"))
            return F.aggregate(at, start, add, lambda s: s["n"])

        return let(let(F.sort_array(F.transform(h, keyed)), repeated), covered)

    low = F.call_function("shiftleft", F.lit(1).cast("long"), _bits(n)) - 1
    # Most texts repeat no window, which a set of hashes shows at once.
    unlike = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(unlike(h), F.lit(0).cast("long")).otherwise(let(low, lambda m: windows(h, m)))))


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of statistics for each text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", words_of(F.col("t")).alias("w"))
    joined = F.array_join("w", "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    out = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        _count(F.col("t"), r"[#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        _count(F.col("t"), r"[A-Za-z\x{80}-\x{10FFFF}]+").alias("n_letters"),
        _count(F.col("t"), r"[A-Z]+").alias("n_capitals"),
        _count(F.col("t"), r"[.?!]+").alias("n_stops"),
    )
    return out.select("*", F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines")).drop("l")


def votes(stats: DataFrame) -> DataFrame:
    """``stats`` with ``votes``, a character for each rule: g, b or a."""
    each = [F.when(~F.expr(r.needs), "a").when(F.expr(r.bad), "b").when(F.expr(r.good), "g").otherwise("a") for r in RULES]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"votes": F.concat(*each), "base_failed": failed})


@dataclass
class Model:
    """Share of good texts, and each rule's vote distribution on good and on bad ones."""

    good: float
    given: list[dict[str, dict[str, float]]]

    def posterior(self, pattern: str) -> float:
        g, b = math.log(self.good), math.log(1 - self.good)
        for vote, table in zip(pattern, self.given, strict=True):
            g, b = g + math.log(table["g"][vote]), b + math.log(table["b"][vote])
        return 1 / (1 + math.exp(min(700.0, b - g)))


def fit(patterns: dict[str, int], rounds: int = 100, tolerance: float = 1e-7) -> Model:
    """EM over counted vote patterns, from the majority of votes; the classes keep the meaning they start with."""
    total = sum(patterns.values())
    belief = {}
    for p in patterns:
        good, bad = p.count("g"), p.count("b")
        belief[p] = (good + 2) / (good + 2 * bad + 4) if bad else 0.95
    model, last = Model(0.5, []), -math.inf
    for _ in range(rounds if total else 0):
        share = (sum(n * belief[p] for p, n in patterns.items()) + 1) / (total + 2)
        given = []
        for k in range(len(RULES)):
            sums = {"g": dict.fromkeys("gba", 1.0), "b": dict.fromkeys("gba", 1.0)}
            # A vote speaks for its own class before any text is seen.
            sums["g"]["g"] += 2.0
            sums["b"]["b"] += 2.0
            for p, n in patterns.items():
                sums["g"][p[k]] += n * belief[p]
                sums["b"][p[k]] += n * (1 - belief[p])
            given.append({c: {v: x / sum(t.values()) for v, x in t.items()} for c, t in sums.items()})
        model = Model(share, given)
        belief = {p: model.posterior(p) for p in patterns}
        now = sum(n * max(belief[p], 1 - belief[p]) for p, n in patterns.items())
        if abs(now - last) <= tolerance * total:
            break
        last = now
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """Statistics, votes, ``posterior`` and ``kept`` of each text."""
    seen = stored(votes(statistics(docs, id_col, text_col)), "votes")
    patterns = {r["votes"]: r["count"] for r in seen.groupBy("votes").count().collect()}
    model = fit(patterns)
    table = [(p, model.posterior(p)) for p in patterns] or [("", 0.0)]
    known = docs.sparkSession.createDataFrame(table, "votes string, posterior double")
    out = seen.join(F.broadcast(known), "votes", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= keep))
