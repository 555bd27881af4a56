"""Operators over whole corpora, against brute force, exact round trips or held-out accuracy."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash
import zstandard

import corpus_pipeline
from millrace.llm import chat, near_copies, ordinal, packing, simhash, suffix_tree, warc
from millrace.llm.common import components

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, node int, segment string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def blank(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def corpus(seed=1, n=50):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghéß") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    out = [None, "", "  \n", "one", "one", "two words", "Two  WORDS"]
    for _ in range(n):
        w = [rnd.choice(words) for _ in range(rnd.choice([3, 30, 90, 200]))]
        out.append(" ".join(w))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            v = list(w)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            out.append(" ".join(v))
    out.append(" ".join(rnd.choice(words) for _ in range(15_000)))
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "fp", 7, "segment") for i, t in enumerate(texts)], DDL)


def united(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return [find(i) for i in range(n)]


def plain_fingerprint(t, width=4):
    w = blank(t)
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, texts)).withColumn("hex", simhash.fingerprint_hex()).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert [got[i]["hex"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == united(len(texts), links)


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_multi_index_finds_every_link(spark, segments):
    rnd = random.Random(segments)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for k in range(6):
            fps.append(f ^ sum(1 << b for b in rnd.sample(range(64), k)))
    fps = list(dict.fromkeys(fps))
    classes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(classes, 4, segments).collect()}
    assert got == {(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 4}


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 160), (7, 8), (9, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([5, *range(100, 161)], 5), 7: 7, 8: 7}


def test_near_copies(spark):
    texts = corpus(9, 60)
    got = {r["doc_id"]: r["group_id"] for r in near_copies.groups(table(spark, texts)).collect()}

    def grams(t):
        w = blank(t)
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert [got[i] for i in range(len(texts))] == united(len(texts), links)
    kept = {r["doc_id"] for r in near_copies.one_of_each(table(spark, texts)).collect()}
    assert kept == set(got.values())


def test_near_copies_with_repeated_and_missing_ids(spark):
    rnd = random.Random(3)
    said = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    a, b, c, d = said(60), said(60), said(60), said(60)
    rows = [
        (3, a, "a3"), (7, a + " more", "near a"), (7, b, "b7"), (7, c, "c7"), (7, c, "c7"), (8, c.upper(), "copy of c"),
        (None, b, "copy of b"), (None, d, "d"), (None, d, "d"), (None, d + " x", "d"), (None, None, "empty"), (None, "", "empty"), (12, said(60), "alone"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string").repartition(3)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["first"] for r in kept.collect()) == ["a3", "alone", "b7", "c7", "d", "empty"]


def test_near_copies_of_one_large_group(spark):
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    middle = [rnd.choice(words) for _ in range(150)]
    texts = [" ".join(rnd.choice(words) for _ in range(120)) for _ in range(200)]
    for _ in range(2500):
        w = list(middle)
        w[rnd.randrange(len(w))] = f"own{rnd.randrange(10**9)}"
        texts.append(" ".join(w))
    docs = table(spark, texts)
    signed = near_copies.signatures(docs)
    nodes = signed.groupBy("node").agg(*[F.min(c).alias(c) for c in ("rid", "m", "fp")])
    balls = near_copies.ball_pairs(nodes)
    posted = near_copies.postings(nodes, docs.select(near_copies.rid().alias("rid"), "text"))
    # Pairs stay in proportion to texts, and every text of the group is found.
    assert 500 < balls.count() < len(texts) and near_copies.leader_pairs(posted).count() < 70 * len(texts)
    got = collections.Counter(r["group_id"] for r in near_copies.groups(docs).collect())
    assert got[200] == 2500 and len(got) == 201


def test_suffix_tree_sums_beyond_32_bits():
    for own in ([], [0], [1, 255, 256], [2**32 - 1, 2**32, 2**40 + 7, 0], [2**63]):
        sums = np.array(own, np.uint64)
        assert suffix_tree.unpacked_sums([suffix_tree.packed_sums(sums)])[0].tolist() == own
    # Three segments' counts of one word.
    each = 3_000_000_000
    rows = [(1, 0, f"s{i}", suffix_tree.packed(np.array([5, 9], np.uint64)), suffix_tree.packed_sums(np.array([each, 1], np.uint64)), *[None] * 6) for i in range(3)]
    told = suffix_tree._summer(suffix_tree._batch(rows))
    assert [suffix_tree.unpacked_sums([c])[0].tolist() for c in told.column("a").to_pylist()] == [[3 * each, 3]] * 3


def test_suffix_tree_base_and_normalisation(spark):
    texts = corpus(3)
    got = {r["doc_id"]: r for r in suffix_tree.score(table(spark, texts)).collect()}
    counts = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*blank(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens = [*blank(t), None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def plain_tree(texts):
    """The log10 score of each text by a suffix tree in its plainest form."""
    start, end = object(), object()
    told = [[start, start, *blank(t), end] for t in texts]
    train = [w for i, w in enumerate(told) if zlib.crc32(str(i).encode()) % 5 != 1]
    one, of = collections.Counter(), collections.defaultdict(collections.Counter)
    for w in train:
        for k in range(2, len(w)):
            one[w[k]] += 1
            of[(w[k - 1],)][w[k]] += 1
            if k > 2:
                of[w[k - 2], w[k - 1]][w[k]] += 1
    n, v = sum(one.values()), len(one)
    total = {c: sum(x.values()) for c, x in of.items()}
    ml = lambda c, s: of[c][s] / total[c] if c else one[s] / n
    gain = {c: sum(m * math.log(ml(c, s) / ml(c[1:], s)) for s, m in x.items()) for c, x in of.items()}
    states = {c for c in of if c == (start,) or total[c] >= suffix_tree.LEAST and gain[c] >= suffix_tree.DIVERGENCE}
    spell = [[0.5] * 257 for _ in range(257)]
    mark = suffix_tree.MARK
    spelt_as = lambda s: [mark, *(b"" if s is end else s.encode()), mark]
    for s, m in one.items():
        b = spelt_as(s)
        for x, y in zip(b, b[1:]):
            spell[x][y] += m

    def p(c, s):
        if not c:
            b = spelt_as(s)
            return (one[s] + v * math.prod(spell[x][y] / sum(spell[x]) for x, y in zip(b, b[1:]))) / (n + v)
        if c not in states:
            return p(c[1:], s)
        weight = suffix_tree.SCALE * total[c] ** suffix_tree.POWER
        return (of[c][s] + weight * p(c[1:], s)) / (total[c] + weight)

    return [sum(math.log10(p((w[k - 1],) if k == 2 else (w[k - 2], w[k - 1]), w[k])) for k in range(2, len(w))) for w in told], len([c for c in states if len(c) == 2])


def test_suffix_tree_against_a_plain_one(spark):
    rnd = random.Random(12)
    words = ["tra", "mon", "é", "a\x02b", "\x00", "\x01", "kit", "sor", "vel"]
    texts = corpus(3, 20)
    for _ in range(60):
        k, w = rnd.randrange(9), []
        for _ in range(rnd.randrange(1, 80)):
            k = (k * 2 + rnd.choice([1, 1, 1, 2, 4])) % 9
            w.append(words[k])
        texts.append(" ".join(w))
    texts += texts[-3:]
    want, deep = plain_tree(texts)
    assert deep > 20
    for parts in (1, 5):
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score(table(spark, texts).repartition(parts)).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-6)


def test_suffix_tree_heeds_the_order_of_words(spark):
    rnd = random.Random(2)
    said = [" ".join(x for k in range(30) for x in rnd.choice(["one two three", "red green blue"]).split()) for _ in range(40)]
    shuffled = said[0].split()
    rnd.shuffle(shuffled)
    texts = [*said, said[0], " ".join(shuffled), "zebra " * 30_000, "q" * 70_000]
    got = {r["doc_id"]: r for r in suffix_tree.score(table(spark, texts)).collect()}
    assert got[40]["score"] > got[41]["score"] + 10 and got[40]["base_score"] == pytest.approx(got[41]["base_score"])
    held = [r for i, r in got.items() if r["held_out"] and i < 40]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_spelling_is_a_distribution(spark):
    held = suffix_tree.segments(table(spark, ["tramon a", "vel\x02 \x01"]))
    table_of = suffix_tree.spelling(held, 2).reshape(257, 257)
    assert np.power(10, table_of).sum(axis=1) == pytest.approx(np.ones(257))


def test_tokens_and_pieces(spark):
    odd = [None, "", " ", "a  b", " a b ", "x\n y", "don't 's", "a\xa0 b", "<|endoftext|> a", "1 2  3", "é è ñandú", "word " * 5000, "z" * 9000]
    got = collections.defaultdict(list)
    for r in packing.pieces(table(spark, odd), with_ids=True).collect():
        got[r["doc_id"]].append(r)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizers_path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    for i, t in enumerate(odd):
        rows = sorted(got[i], key=lambda r: r["piece"])
        ids = [x for r in rows for x in r["ids"]]
        assert ids == [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(rows):
            assert (r["piece"], r["start"], r["length"]) == (k, at, len(r["ids"])) and (k == 0 or r["length"] == 2048) and r["length"] <= 2048
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]


def check_packing(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_with_exchange(spark, monkeypatch, seed):
    monkeypatch.setattr(packing, "PARTITION", 60)
    rnd = random.Random(seed)
    lengths = [rnd.choice([2048, rnd.randrange(1, 2048), rnd.randrange(600, 1100)]) for _ in range(700)]
    df = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    packed = packing.best_fit(df).cache()
    rows = packed.collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    n = check_packing(rows, 2048)
    bound = packing.lower_bound(np.array(lengths), 2048)
    assert bound <= packing.plain_fit(lengths, 2048) <= n <= 1.03 * bound + 12
    found, whole = packing.certificates(packed).collect(), packing.utilisation(packed).first()
    assert (whole["sequences"], whole["bound"], whole["gap"]) == (n, bound, n - bound)
    assert sum(r["sequences"] for r in found) + lengths.count(2048) == n and all(r["gap"] == r["sequences"] - r["bound"] >= 0 for r in found)
    packed.unpersist()


def test_repeated_pieces_are_dealt_evenly(spark):
    docs = spark.createDataFrame([(None, "", "x", 1)] * 50_000 + [(1, "a b", "x", 1)] * 3, "doc_id long, text string, part string, row int")
    packed = packing.best_fit(packing.pieces(docs)).cache()
    assert packed.count() == 50_003 and packed.groupBy("part").count().agg({"count": "max"}).first()[0] < 1.2 * packing.PARTITION
    assert check_packing(packed.collect(), 2048) <= packing.utilisation(packed).first()["bound"] + 3
    packed.unpersist()


def test_lower_bound_and_best_fit():
    rnd = random.Random(8)
    for _ in range(200):
        lengths = [rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 40))]
        bins, offsets, left = packing.best_fit_decreasing(np.array(lengths), 20)
        assert len(left) == packing.plain_fit(lengths, 20)
        assert packing.lower_bound(np.array(lengths), 20) <= len(left)
    assert packing.lower_bound(np.array([11] * 6), 20) == 6
    assert packing.lower_bound(np.array([7] * 9), 20) == 5  # two fit a bin


def turns_of(rows):
    told = collections.defaultdict(list)
    for r in rows:
        told[r[0]].append((r[1], r[2] or "", r[3] or ""))
    return {k: sorted(v) for k, v in told.items()}


@pytest.mark.parametrize("budget", [64, 2048])
def test_chat_round_trip(spark, budget):
    rnd = random.Random(6)
    bad = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<|", "<\\\\|x", "\n", "é漢", "", None, "<\\n|", "a\r\n<|im_end|>\n"]
    rows = []
    for c in range(12):
        for t in range(rnd.choice([1, 2, 9, 40])):
            role = "system" if t == 0 and c % 2 else rnd.choice(["user", "assistant", "a\nb<|", None])
            rows.append((c, t, role, rnd.choice(bad) if rnd.random() < 0.4 else "word " * rnd.randrange(30)))
    rows += [(99, t, "assistant" if t % 2 else "user", "x" * (t % 50)) for t in range(700)]
    rows += [(98, 1, "user", "tie"), (98, 1, "user", "tie"), (98, 1, "assistant", "tie"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    made = chat.windows(df, budget).cache()
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    want = turns_of(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        targets = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(targets))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(targets.encode()).hexdigest()
    for w in made.collect():
        for s in w["loss"]:
            assert "<|im_start|>" not in w["formatted"][s["start"] : s["upto"]]
        system = want[w["conv_id"]][0]
        if system[1] == "system":
            assert w["formatted"].startswith("<|im_start|>system\n")
        size = [-(-len(t) // 4) + len(t.encode()) - len(t) + 4 for _, _, t in want[w["conv_id"]]]
        assert not w["over"] or max(size) > budget // 8
    made.unpersist()


def test_chat_windows_fill_their_budget_and_long_turns_stay_whole(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "word " * 40) for t in range(400)] + [(2, 0, "user", "q"), (2, 1, "assistant", "漢" * 200_000), (2, 2, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {(r["conv_id"], r["window"]): r for r in chat.windows(df, 2048).collect()}
    inner = [len(r["formatted"]) / 4 for (c, w), r in made.items() if c == 1 and w not in (0, max(w for c, w in made if c == 1))]
    assert min(inner) > 0.55 * 2048 and not any(r["over"] for (c, _), r in made.items() if c == 1)
    long = [r for (c, _), r in made.items() if c == 2 and "漢" * 200_000 in r["formatted"]]
    assert len(long) == 1 and long[0]["over"]


def test_warc_round_trip(spark):
    pages = [(3, "http://h/a", "<p>one</p>"), (1, "http://h/b c\r\nX: y", "<p>one</p>"), (2, None, None), (5, "u", ""), (4, "http://h/é", "ünï\r\n\r\nx"), (1, "again", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "u", "alone")]
    df = spark.createDataFrame([(*p, b"x") for p in pages], "page_id long, url string, html string, payload binary")
    archive = warc.write(df)
    assert archive.payloads.count() == 4
    written = warc.files(archive)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["n_bytes"], r["digest"]) for r in warc.read(written).collect()), key=repr)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    one, none, odd = b"<p>one</p>", b"", "ünï\r\n\r\nx".encode()
    want = [(3, "revisit", 1, 10, sha(one)), (1, "response", None, 10, sha(one)), (1, "response", None, 10, sha(one)), (None, "revisit", 1, 10, sha(one)), (2, "response", None, 0, sha(none)),
            (5, "revisit", 2, 0, sha(none)), (4, "response", None, len(odd), sha(odd)), (None, "response", None, 5, sha(b"alone"))]
    assert got == sorted(want, key=repr)
    for r in warc.reconstruct(archive).collect():
        block, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in block.split(b"\r\n")[1:])
        assert len(rest) == int(fields[b"Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        if fields[b"WARC-Type"] == b"response":
            assert sha(rest[:-4].partition(b"\r\n\r\n")[2]).encode() == fields[b"WARC-Payload-Digest"][5:]
    whole = b"".join(zstandard.decompress(bytes(r["content"])) for r in written.collect())
    assert sorted(f["WARC-Record-ID"] for f, _ in warc.records_of(whole)) == sorted(f"<urn:x-page:{'' if p[0] is None else p[0]}>" for p in pages)


def test_warc_takes_long_payloads_and_small_ones_as_responses(spark):
    pages = [(1, "u", "x" * 20_000_000), (2, "u", "x" * 20_000_000), (3, "v", "ab"), (4, "v", "ab")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["n_bytes"]) for r in warc.read(warc.files(warc.write(df, least=10))).collect()}
    assert got == {1: ("response", None, 20_000_000), 2: ("revisit", 1, 20_000_000), 3: ("response", None, 2), 4: ("response", None, 2)}


def test_warc_detects_a_changed_payload(spark):
    archive = warc.write(spark.createDataFrame([(1, "u", "good")], "page_id long, url string, html string"))
    evil = spark.createDataFrame([(archive.payloads.first()["sha256"], bytearray(zstandard.compress(b"evil")))], "sha256 string, packed binary")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.files(warc.Archive(evil, archive.records))
    with pytest.raises(Exception, match="no payload for"):
        warc.files(warc.Archive(evil.where("false"), archive.records))


def labelled_corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"wort{i}" for i in range(400)]
    rows = []
    for i in range(n):
        kind = rnd.choice([0, 1, 2, 2, 2])
        w = [rnd.choice(words) for _ in range(rnd.randrange(30, 120))]
        if kind == 0:
            w[::9] = [rnd.choice(["vilething", "vileword", "badstuff"]) for _ in w[::9]]
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), kind))
    return rows


def test_ordinal_classifier_on_held_out_rows(spark):
    rows = labelled_corpus(900, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(10_000, None, "x"), (10_001, "", "x")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 0), 0.5) for i, _, k in rows[:600]] + [(77_777, 1, 0, 0.5), (None, 1, 0, 0.5)], "doc_id long, quality int, toxic int, expected_grade double")
    model = ordinal.train(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in ordinal.score(docs, model).collect()}
    held = [(got[i]["p_from_2"] >= 0.5) == (k == 2) for i, _, k in rows[600:]]
    assert sum(held) / len(held) > 0.95
    for r in got.values():
        assert r["p_from_1"] >= r["p_from_2"] and r["expected_grade"] == pytest.approx(r["p_from_1"] + r["p_from_2"])
    assert ordinal.select(docs, model).columns == docs.columns
    assert ordinal.select(docs, model).count() == sum(r["p_from_2"] >= 0.5 for r in got.values())


def test_ordinal_fit_against_a_plain_likelihood():
    """Adam over the likelihood as it is defined, with gradients by differences, gives the fitted model."""
    rnd = np.random.default_rng(3)
    texts = [" ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee"], rnd.integers(0, 6))) + "!" * int(rnd.integers(0, 3)) for _ in range(25)]
    grades = rnd.integers(0, 3, len(texts))
    made = [ordinal.features(t) for t in texts]
    model = ordinal.fit(np.concatenate([p for p, _ in made]), np.cumsum([len(p) for p, _ in made]), grades, rounds=12, ridge=0.01)
    used = np.unique(np.concatenate([p for p, _ in made]))
    x = np.zeros((len(texts), len(used)))
    for row, (places, values) in zip(x, made, strict=True):
        np.add.at(row, np.searchsorted(used, places), values)
    share = np.array([1 / np.sqrt((grades == g).sum()) for g in grades])

    def loss(params):
        w, low, gap = params[:-2], params[-2], np.exp(params[-1])
        below = np.stack([np.zeros(len(x)), 1 / (1 + np.exp(x @ w - low)), 1 / (1 + np.exp(x @ w - low - gap)), np.ones(len(x))])
        each = below[grades + 1, np.arange(len(x))] - below[grades, np.arange(len(x))]
        return -(share / share.sum() * np.log(each)).sum() + 0.01 / 2 * (w * w).sum()

    params, m, v = np.array([0.0] * len(used) + [-1.0, 0.0]), 0.0, 0.0
    for t in range(1, 13):
        grad = np.array([(loss(params + d) - loss(params - d)) / 2e-5 for d in 1e-5 * np.eye(len(params))])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    assert model.weights[used] == pytest.approx(params[:-2], abs=2e-3)
    assert model.thresholds == pytest.approx([params[-2], params[-2] + np.exp(params[-1])], abs=2e-3)
    assert not np.delete(model.weights, used).any()
    # Scores of texts by the definition of the tails.
    tails = model.tails(np.array([model.weights[p] @ v for p, v in made]))
    assert tails == pytest.approx(np.stack([1 / (1 + np.exp(th - x @ model.weights[used])) for th in model.thresholds], axis=1))


def test_classifier_on_empty_documents_and_a_very_long_text(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "good word " * 200_000, 7), (2, "", 8)], "doc_id long, text string, expected_grade int")
    model = ordinal.train(docs, labels)
    assert {r["doc_id"]: r["p_from_2"] >= 0.5 for r in ordinal.score(docs, model).collect()} == {1: True, 2: False}
    assert ordinal.score(docs.limit(0), model).count() == ordinal.select(docs.limit(0), model).count() == 0
    assert ordinal.score(docs, ordinal.train(docs.limit(0), labels)).count() == 2


def test_classifier_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = ordinal.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert ordinal.select(docs, model).count() == 2


@pytest.mark.parametrize("run", [
    simhash.near_duplicates,
    near_copies.groups,
    suffix_tree.score,
    lambda d: packing.best_fit(packing.pieces(d)),
    lambda d: warc.read(warc.files(warc.write(d.selectExpr("doc_id as page_id", "text as url", "text as html")))),
    lambda d: chat.digest(chat.windows(d.selectExpr("doc_id as conv_id", "doc_id as turn", "text as role", "text"))),
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DDL)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(i, t) for i, t, _ in labelled_corpus(300, 5)]
    clean = labelled_corpus(300, 5)
    item = " ".join(f"item{k}" for k in range(14))
    whole = [(i, t) for i, t in rows]
    base = next(t for i, t, k in clean if k == 2)
    whole += [(1000, base), (1001, base + " and more"), (1002, base.replace("wort1 ", "other ", 1))]
    fresh = " ".join(f"wort{rnd.randrange(400)}" for _ in range(80))
    whole += [(1003, fresh + " " + item + " end"), (1004, " ".join(f"wort{rnd.randrange(400)}" for _ in range(80)) + " token=abcdef123456 end"), (1005, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in whole], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(k != 1), int(k == 0)) for i, _, k in clean], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "decontamination", "secret_redaction", "best_fit_packing"]
    kept, left = [], spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, d)
        path = f"{d}/{name}"
        left.write.parquet(path)
        left = spark.read.parquet(path)
        assert left.columns == docs.columns
        kept.append({r["doc_id"]: r for r in left.collect()})
    quality, single, clear, redacted = kept
    good = {i for i, _, k in clean if k == 2}
    assert len(good & set(quality)) / len(good) > 0.95 and not {i for i, _, k in clean if k == 0} & set(quality)
    first = next(i for i, t, k in clean if t == base)
    assert first in single and not {1000, 1001, 1002} & set(single)
    assert 1003 in single and 1003 not in clear
    assert redacted[1004]["text"].endswith("[secret] end") and redacted[1004]["n_chars"] == len(redacted[1004]["text"])
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in packed} == set(redacted)
    check_packing(packed, 2048)


def planted_copies(seed, n):
    """Texts and copies with a contiguous part replaced or appended, similarity 0.8 to 0.85; half of them repeat a passage."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 10))) for _ in range(3000)]
    out = []
    for k in range(n):
        w = [rnd.choice(words) for _ in range(rnd.choice([40, 80, 200, 400]))]
        w = w + w[:20] * 15 if k % 2 else w
        m = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
        new = [rnd.choice(words) for _ in range(int(m * rnd.uniform(0.19, 0.245)))]
        at, cut = rnd.randrange(20), max(1, int(m * 0.11) - 4)
        out += [" ".join(w), " ".join(w + new if k % 4 < 2 else w[:at] + new[:cut] + w[at + cut :])]
    return out


def test_near_copies_at_the_threshold(spark):
    texts = planted_copies(3, 120)
    got = {r["doc_id"]: r["group_id"] for r in near_copies.groups(table(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = blank(t)
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) > 60
    assert [got[i] for i in range(len(texts))] == united(len(texts), links)
