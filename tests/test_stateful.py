"""Streams with state, against plain loops over the same rows."""

import collections
import datetime
import random

import pytest

from millrace.streaming import stateful

START = datetime.datetime(2024, 1, 1)


def arrive(spark, rows, schema, folder, cuts):
    """The rows as a stream of ``cuts`` files, one a micro-batch, in order of their times."""
    rows = sorted(rows, key=lambda r: (r[-1], r[1]))
    for k in range(cuts):
        own = rows[len(rows) * k // cuts : len(rows) * (k + 1) // cuts]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def ran(spark, stream, tmp_path):
    q = stateful.appended(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert q.awaitTermination(240)
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_cache_hits_and_misses(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"k{rnd.randrange(6)}", i, START + datetime.timedelta(seconds=rnd.randrange(4000))) for i in range(300)]
    want, last = {}, {}
    for key, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = key in last and at < last[key] + datetime.timedelta(seconds=300)
        last[key] = last[key] if want[i] else at
    got = ran(spark, stateful.cached(arrive(spark, rows, "key string, id long, at timestamp", f"{tmp_path}/in", 4), late="1 second"), tmp_path)
    assert {r["id"]: r["hit"] for r in got} == want and 0 < sum(want.values()) < 300


@pytest.mark.parametrize("cuts", [1, 4])
def test_candidates_wait_for_their_gate(spark, tmp_path, cuts):
    rnd = random.Random(2)
    rows = [(f"g{rnd.randrange(5)}", i, rnd.choice([None, 1, 3, 5, 7, 8]) if rnd.random() < 0.3 else 4, START + datetime.timedelta(seconds=10 * i)) for i in range(150)]
    waiting, number, want = collections.defaultdict(list), collections.Counter(), []
    for g, i, s, _ in rows:
        waiting[g].append((i, s))
        if len(waiting[g]) > 5 or (s is not None and s >= 8):
            number[g] += 1
            want.append((g, number[g], len(waiting[g]), max((x for _, x in waiting[g] if x is not None), default=None), [x for x, _ in waiting.pop(g)], False))
    got = ran(spark, stateful.issues(arrive(spark, rows, "grp string, id long, score int, at timestamp", f"{tmp_path}/in", cuts)), tmp_path)
    assert sorted(map(tuple, got)) == sorted(want)


def test_candidates_that_waited_too_long(spark, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [("a", 1, 3, at(0)), ("a", 2, 3, at(10)), ("b", 3, 8, at(20)), ("b", 4, 1, at(5000)), ("c", 5, 1, at(9000))]
    got = ran(spark, stateful.issues(arrive(spark, rows, "grp string, id long, score int, at timestamp", f"{tmp_path}/in", 5), patience=600, late="1 second"), tmp_path)
    out = {(r["grp"], r["issue"]): (r["ids"], r["expired"]) for r in got}
    assert out["b", 1] == ([3], False) and out["a", 1] == ([1, 2], True) and out["b", 2] == ([4], True)
