"""Ranked search, importance resampling and prefix-hash fingerprints, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import prefix_hashes, ranked_search, resampling

DDL = "doc_id long, text string, score long, rank string, item_id string, block int"


def alnum(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def made(seed=1, n=80):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + "the of and Été naïve 한글 ZZ".split()
    out = [None, "", " \n\t ", "x", "the", "the the the", "naïve " * 300]
    for _ in range(n):
        out.append("".join(rnd.choice(words[: rnd.choice([5, 20, 47])]) + rnd.choice([" ", " ", ", ", "\n"]) for _ in range(rnd.choice([1, 3, 20, 120]))))
    out += [out[20]] * 15
    out.append(" ".join(rnd.choice(words) for _ in range(20_000)))
    return out


def table(spark, texts, ids=None):
    # Column names that the operators use inside themselves stand beside the texts.
    return spark.createDataFrame([(i, t, 1, "r", "i", 0) for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], DDL)


# --- ranked search ------------------------------------------------------------------------------------


def ranking(texts, items, k=10):
    """Every document scored, without accumulators or bounds."""
    docs = [(i, collections.Counter(alnum(t))) for i, t in texts]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = {}
    for name in {n for n, _ in items}:
        terms = {t for n, x in items if n == name for t in alnum(x)}
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out[name] = [(None if none else i, -s) for s, none, i in sorted(found)[:k]]
    return out


ITEMS = [(1, "the w1 w2"), (2, "naïve w45 w3 w3 한글"), (3, None), (4, " - "), (5, "unknown words"), (6, "w1 w2 w3 w4 w5 w6 w7 the of and"), (7, "ZZ"), (7, "Été"), (None, "w9 w10")]


def asked(spark):
    return spark.createDataFrame([(i, t, 9, 9) for i, t in ITEMS], "item_id long, text string, item int, score long")


def got_ranking(found):
    out = collections.defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["rank"])):
        out[r["item_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return dict(out)


@pytest.mark.parametrize(("segment", "block"), [(10**9, 10**9), (50, 10**9), (500, 4)])
def test_ranked_search(spark, monkeypatch, segment, block):
    monkeypatch.setattr(ranked_search, "SEGMENT_WORDS", segment)
    texts = made()
    index = ranked_search.build_index(table(spark, texts).coalesce(2))
    found = ranked_search.search(index, asked(spark), block_terms=block)
    want = {k: v for k, v in ranking(list(enumerate(texts)), ITEMS).items() if v}
    assert got_ranking(found) == want
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_search_repeated_and_missing_ids(spark):
    texts = [(1, "a b c"), (1, "a b c"), (1, "a"), (None, "a b c"), (None, "a"), (2, "a b c"), (3, "d")]
    items = [(1, "a b"), (2, "c")]
    found = ranked_search.search(ranked_search.build_index(table(spark, [t for _, t in texts], [i for i, _ in texts])), spark.createDataFrame(items, "item_id long, text string"))
    assert got_ranking(found) == ranking(texts, items)


def test_ranked_search_empty(spark):
    docs, items = table(spark, ["a b"]), asked(spark)
    assert ranked_search.search(ranked_search.build_index(docs.limit(0)), items).count() == 0
    assert ranked_search.search(ranked_search.build_index(docs), items.limit(0)).count() == 0
    assert ranked_search.search(ranked_search.build_index(table(spark, [None, "", "--"])), items).count() == 0


def test_accumulators_stop(spark):
    """Once the rare terms have given k documents, the frequent term opens none."""
    rnd = random.Random(3)
    n = 2000
    times = {0: sorted(rnd.sample(range(n), 30)), 1: list(range(n))}
    lists = ranked_search.Lists(np.array(times[0] + times[1]), np.ones(n + 30, np.int64), np.array([0, 30]), np.array([30, n + 30]), np.array([5000 * 10**6 // 2, 3 * 10**5]), np.full(n, 100))
    score = np.zeros(n, np.int64)
    docs, _ = ranked_search.best_of_segment(lists, np.array([0, 1]), np.array([5000, 1]), 10, 0, score)
    assert set(docs.tolist()) <= set(times[0]) and not score.any()


# --- importance resampling ----------------------------------------------------------------------------


def resampled(rows, target, percent=5, least=20, buckets=10_000):
    def features(t):
        w = alnum(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)

    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(features(x)[0])
    for x in target:
        t.update(features(x)[0])
    alls, allt = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * alls / ((s[b] + 1) * allt)))
    out = []
    for i, x in rows:
        f, n = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return out


def plain(rows):
    return sorted([tuple(r[:5]) for r in rows], key=repr)


def drawn(spark, rows, target, **more):
    found = resampling.resample(table(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, bucket long"), **more)
    return plain((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect())


def test_resampling(spark):
    rows, target = list(enumerate(made())), ["w1 w2 w3 the", None, "naïve Été", ""]
    for percent in (5, 60):
        assert drawn(spark, rows, target, percent=percent) == plain(resampled(rows, target, percent))


def test_resampling_ties_repeats_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text)] * 7 + [(None, text)] * 5 + [(i, text) for i in range(6, 30)] + [(1, "short")]
    for percent in (10, 50, 97):
        assert drawn(spark, rows, [text], percent=percent) == plain(resampled(rows, [text], percent))


def test_resampling_empty(spark):
    assert drawn(spark, [], ["a b"]) == []
    assert drawn(spark, [(1, None), (2, "a b")], []) == plain(resampled([(1, None), (2, "a b")], []))


def test_cutoff_by_bisection(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([-(2**62), -5, 0, 0, 0, 7, 2**62]), rnd.randrange(-3, 4), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 2, 77, 150, 299, 300):
        for halvings in (1, 5):
            assert tuple(resampling.cutoff(df, ["a", "b", "c"], k, halvings)) == sorted(rows)[k - 1]


def test_ranks_by_range(spark):
    rows = random.Random(2).sample(range(10**6), 500)
    got = resampling.ranked(spark.createDataFrame([(x,) for x in rows], "a long"), ["a"]).collect()
    assert [r["a"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows) and {r["rank"] for r in got} == set(range(1, 501))


# --- fingerprints -------------------------------------------------------------------------------------


def test_prefix_arrays_answer_spans():
    rnd = random.Random(4)
    a, b = ("".join(rnd.choice("ab\0é한😀") for _ in range(200)) for _ in range(2))
    x, y = prefix_hashes.prefixes(a), prefix_hashes.prefixes(b)
    for _ in range(3000):
        i, j = rnd.randrange(201), rnd.randrange(201)
        n = rnd.randrange(min(200 - i, 200 - j, 4) + 1)
        assert prefix_hashes.spans_equal(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
        longest = 0
        while max(i, j) + longest < 200 and a[i + longest] == b[j + longest]:
            longest += 1
        assert prefix_hashes.common_extension(x, i, y, j) == longest
    for m, n in ((0, 0), (0, 5), (7, 0), (200, 200), (13, 77)):
        assert (prefix_hashes.pieced(x, m, y, n) == prefix_hashes.prefixes(a[:m] + b[:n])).all()


def plainly(text):
    """A fingerprint by whole-number arithmetic and loops."""
    codes, p = [ord(c) + 1 for c in text], prefix_hashes.PRIME
    mask = 2**64 - 1
    of = lambda base, i, n: sum(c * pow(base, k, p) for k, c in enumerate(codes[i : i + n])) % p
    parts = [f"{len(codes):x}", "".join(f"{of(b, 0, len(codes)):08x}" for b in prefix_hashes.BASES)]
    for width in prefix_hashes.WIDTHS:
        w, least = min(width, len(codes)), {}
        for i in range(len(codes) - w + 1) if codes else ():
            m = of(prefix_hashes.BASES[0], i, w) * 0x9E3779B97F4A7C15 & mask
            m = (m ^ m >> 29) * 0x9E3779B97F4A7C15 & mask
            least[m >> 58] = min(least.get(m >> 58, m), m)
        parts.append("".join(f"{(least[b] >> 16 & 0xFFFF) | 1 if b in least else 0:04x}" for b in range(prefix_hashes.BINS)))
    return "-".join(parts)


def edited(text, after):
    h = len(text) // 2
    return text[: len(text) - h] + after[:h]


def expected(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        e = edited(t, after)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plainly(t), plainly(e)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [10**9, 10])
def test_fingerprints(spark, monkeypatch, block_rows):
    monkeypatch.setattr(prefix_hashes, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(prefix_hashes, "PER_BORDER", 2)
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abc é한😀") for _ in range(rnd.choice([0, 1, 2, 7, 8, 9, 33, 140]))) for _ in range(90)] + [None, "", "x" * 300]
    ids = rnd.sample(range(-500, 500), len(texts))
    got = prefix_hashes.fingerprints(table(spark, texts, ids).repartition(3)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(list(zip(ids, texts, strict=True)))
    for r in got:
        own, other = (prefix_hashes.from_text(r[c]) for c in ("fingerprint", "edited_fingerprint"))
        assert str(own) == r["fingerprint"] and r["near_edited"] == prefix_hashes.likeness(own, other) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["common_edited"] >= r["n_chars"] - r["n_chars"] // 2


def test_fingerprints_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(prefix_hashes, "BLOCK_ROWS", 2)
    monkeypatch.setattr(prefix_hashes, "PER_BORDER", 1)
    assert prefix_hashes.fingerprints(table(spark, [])).count() == 0
    alone = prefix_hashes.fingerprints(table(spark, ["abcdef"])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and alone["near_next"] == 1
    # Repeated and missing ids: each row once, and each next to one of its neighbours by id.
    rows = [(3, "three"), (3, "three"), (3, "drei"), (2, "two"), (1, "one"), (None, "none"), (None, None), (9, "nine" * 9), (8, "eight"), (7, "seven")]
    got = prefix_hashes.fingerprints(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted(((r["doc_id"], r["n_chars"]) for r in got), key=repr) == sorted(((i, len(t or "")) for i, t in rows), key=repr)
    assert next(r for r in got if r["doc_id"] == 2)["edited_sha256"] == hashlib.sha256(b"two"[:2] + b"o").hexdigest()


def test_likeness_tells_copies_from_strangers(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("aeioubdfgklmnprst") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    own = [said(300) for _ in range(30)]
    of = lambda t: prefix_hashes.fingerprint(prefix_hashes.prefixes(t))
    for a, b in zip(own, own[1:], strict=False):
        assert prefix_hashes.likeness(of(a), of(b)) < 0.1
        assert 0.25 < prefix_hashes.likeness(of(a), of(edited(a, b))) < 0.75
        assert prefix_hashes.likeness(of(a), of(a[: len(a) // 3] + " " + a[len(a) // 3 :])) > 0.8
        assert prefix_hashes.likeness(of(a), of(a)) == 1
