"""Claims, logs by bucket, filters of known addresses, and the ledger of calls."""

import threading

import pytest
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.plans import pipeline
from millrace.sources import calls, keyed
from millrace.sources.claims import Claims
from millrace.sources.store import Store, TaskRunning


def test_of_many_claims_one_holds(spark, tmp_path):
    claims, won = Claims(spark, str(tmp_path / "c")), []
    threads = [threading.Thread(target=lambda i=i: claims.claim("7", str(i)) and won.append(i)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and claims.text("7") == str(won[0]) and claims.names() == ["7"]
    assert claims.claim("8") and not claims.claim("8", "x") and claims.text("8") == "" and claims.numbers() == [7, 8]


def test_of_two_starts_one_fails(spark, tmp_path):
    store, out = Store(spark, str(tmp_path / "s")), []

    def start():
        try:
            out.append(store.create_task())
        except TaskRunning:
            out.append(None)

    threads = [threading.Thread(target=start) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(out, key=str) == [1, None]
    store.complete_task(1)
    with pytest.raises(TaskRunning):
        store.complete_task(1)
    assert store.create_task() == 2


def test_an_issue_and_its_articles_show_together(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    issue = spark.createDataFrame([("a", 1, "t", "h")], "id string, issue_order int, title string, html string")
    used = spark.createDataFrame([("u1",), ("u2",)], "detail_url string")
    append = Store.append

    def stops(self, name, rows):
        if name == "newsletters":
            raise KeyboardInterrupt
        return append(self, name, rows)

    monkeypatch.setattr(Store, "append", stops)
    with pytest.raises(KeyboardInterrupt):
        store.save_newsletter(issue, used)
    monkeypatch.setattr(Store, "append", append)
    assert store.read("newsletter_articles").count() == 0 and store.read("newsletters").count() == 0 and store.next_issue() == 1
    # Another writer's issue of that number: one of both stands, with its own articles.
    assert store.save_newsletter(issue.withColumn("id", F.lit("b")), used.limit(1)) == "b"
    assert store.save_newsletter(issue, used) == "b"
    assert store.read("newsletters").count() == 1 and store.read("newsletter_articles").count() == 1 and store.next_issue() == 2


def test_log_of_upserts_stays_short(spark, tmp_path):
    log = keyed.KeyedLog(spark, str(tmp_path / "log"), "k string, v int, at int", "k", "at", buckets=2, every=4)
    assert log.read().count() == 0
    all_rows, most = [], 0
    for n in range(14):
        rows = [(f"k{(n * 3 + i) % 10}", n, n if i else 0) for i in range(4)]
        all_rows += rows
        assert log.append(spark.createDataFrame(rows, "k string, v int, at int")) == 4
        most = max(most, len(log.parts()[0]))
    want = R.latest(spark.createDataFrame(all_rows, "k string, v int, at int"), "k", F.col("at"))
    assert sorted(map(tuple, log.read().collect())) == sorted(map(tuple, want.collect()))
    assert most <= 5  # a version and fewer than four appends, or four before the first
    # A fold that another writer's append came before covers what it read, no more.
    folders, _, last = log.parts()
    log.append(spark.createDataFrame([("late", 1, 1)], "k string, v int, at int"))
    name, _ = log._written(log._latest(folders))
    log._claim(f"fold {name} {last}")
    assert log.read().where("k = 'late'").count() == 1


def test_known_addresses(spark, tmp_path):
    filters = keyed.Filters(spark, str(tmp_path / "f"), buckets=8, words=64)
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("u/"), "id").alias("u"))
    by = lambda df: df.withColumn("bucket", keyed.bucket_of(F.col("u"), 8))
    by(rows(0, 0)).write.partitionBy("bucket").parquet(str(tmp_path / "k"))
    for part in (rows(0, 150), rows(100, 300)):
        filters.add(part, "u")
        by(part).write.mode("append").partitionBy("bucket").parquet(str(tmp_path / "k"))
    known = spark.read.schema("u string, bucket int").parquet(str(tmp_path / "k"))
    asked = rows(250, 400).withColumn("more", F.lit(1)).unionByName(spark.createDataFrame([(None, 2)], "u string, more int"))
    got = keyed.unknown(asked, filters, known, "u")
    want = R.new_articles(asked, known, "u")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.columns == asked.columns
    passed = filters.maybe(rows(0, 3000), "u").count()
    assert 300 <= passed < 450
    # New addresses alone read nothing of the known ones; a known one reads its bucket.
    new = rows(10**6, 10**6 + 3)
    assert filters.maybe(new, "u").count() == 0 and keyed.unknown(new, filters, known, "u").count() == 3
    touched = [r["bucket"] for r in filters.maybe(rows(5, 6), "u").collect()]
    pruned = known.where(F.col("bucket").isin(touched))
    assert len(touched) == 1 and "PartitionFilters: [isnotnull(bucket" in pruned._jdf.queryExecution().toString().split("Physical")[-1]
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files(pruned)) < len(files(known)) / 4


def costly(folder):
    """An analyst; made here, so that workers get its code and not its module's name."""

    class Costly:
        """Writes down each call, and fails from the sixth on while a file says so."""

        def _made(self, what):
            import pathlib
            import uuid

            made = pathlib.Path(folder, "calls")
            made.mkdir(exist_ok=True)
            if pathlib.Path(folder, "failing").exists() and len(list(made.iterdir())) >= 5:
                raise OSError("quota")
            (made / f"{what}-{uuid.uuid4().hex}").touch()

        def tags(self, title, content, known):
            self._made(f"tags-{title}")
            return ["a", title]

        def image_context(self, title, content):
            self._made(f"image-{title}")
            return f"image of {title}"

        def score(self, title, content, tags):
            self._made(f"score-{title}")
            return len(tags) + len(content)

    return Costly()


def test_no_call_is_paid_twice(spark, tmp_path):
    articles = spark.createDataFrame([(f"u{i}", f"t{i}", "x" * i, i % 2 == 0) for i in range(6)], "detail_url string, title string, detail_content string, has_attached_image boolean").coalesce(1)
    ledger = calls.CallLedger(f"file://{tmp_path}/ledger", "m1")
    (tmp_path / "failing").touch()
    run = lambda: {r["detail_url"]: (r["tags"], r["image_context"], r["score"]) for r in pipeline.analyse(articles, costly(str(tmp_path)), [], 2, 1, 0, ledger).collect()}
    with pytest.raises(Exception, match="quota"):
        run()
    made = lambda: sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "calls").iterdir())
    assert len(made()) == 5
    (tmp_path / "failing").unlink()
    want = {f"u{i}": (["a", f"t{i}"], f"image of t{i}" if i % 2 == 0 else None, 2 + i) for i in range(6)}
    assert run() == want and len(made()) == 15 == len(set(made()))
    assert run() == want and len(made()) == 15
