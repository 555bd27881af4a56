"""Secret scans over a ledger of content-addressed texts, in DataFrame functions only.

Every version of every text is a blob, named by its SHA-256. The ledger is a table of the (blob, rule version)
pairs that have been scanned, with what was found. A run names the blobs of its input, takes from the ledger
which rule versions each has already met, scans each remaining blob once with just its unseen rules, appends
that to the ledger, and joins the findings back to every path that holds the blob. A rule's version is a hash
of its kind, pattern and floor, so a changed rule is unseen by all blobs and the others stay seen.

Which row scans a blob is decided on names alone; texts are neither shuffled nor sorted.

Rules are regular expressions with a gate, a word that must stand in the lower-case text for the rule to be
able to match. The built-in functions give matches but not places; those follow from the lengths of what
stands between matches. Places are code points, ends exclusive.

Defined results: a null text is the empty blob; repeated rows and equal texts get equal findings; rows
without path are scanned like others; an empty table leaves the ledger as it is; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, running, stored


@dataclass(frozen=True)
class Rule:
    """``least``: shortest ``group`` that counts (0: the whole match). ``gates``: any must stand in the lower-case text."""

    kind: str
    pattern: str
    least: int
    gates: tuple[str, ...]
    group: int = 0

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\n{self.pattern}\n{self.least}\n{self.group}".encode()).hexdigest()[:16]


#: The base rules, in the order in which spans of one start are listed.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, ("passw", "secret", "token", "api"), 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 24, ()),
]

#: Further kinds; formats that services publish for their credentials.
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, ("private key",)),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}", 0, ("glpat-",)),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, ("xox",)),
    Rule("slack_hook", r"hooks\.slack\.com/services/T[A-Za-z0-9_]+/B[A-Za-z0-9_]+/[A-Za-z0-9_]+", 0, ("hooks.slack.com",)),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}", 0, ("aiza",)),
    Rule("stripe", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, ("k_live_", "k_test_")),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, ("eyj",)),
    Rule("npm", r"\bnpm_[A-Za-z0-9]{36}", 0, ("npm_",)),
    Rule("pypi", r"\bpypi-[A-Za-z0-9_-]{50,}", 0, ("pypi-",)),
    Rule("sendgrid", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", 0, ("sg.",)),
    Rule("twilio", r"\bSK[0-9a-f]{32}", 0, ("sk",)),
    Rule("bearer", r"(?i:authorization):\x20*(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{16,}", 0, ("authorization",)),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s:/@]{1,64}:[^\s:/@]{3,64}@", 0, ("://",)),
]
RULES = BASE + MORE

#: Code points of a chunk that redaction cuts from.
CHUNK = 1024

SPAN = "struct<first: int, rank: int, upto: int, kind: string, version: string>"


def _places(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches that pass its floor."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    sizes = F.transform(F.arrays_zip(whole.alias("m"), held.alias("g"), between.alias("b")), lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), F.length(x["g"]).alias("g")))
    sizes = F.filter(sizes, lambda x: x["m"].isNotNull())

    def spans(s: Column, ends: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            upto = F.get(ends, i)
            place = F.struct((upto - x["m"]).alias("first"), F.lit(rank).alias("rank"), upto.alias("upto"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))
            return F.when(x["g"] >= rule.least, place)

        return F.filter(F.transform(s, span), lambda p: p.isNotNull())

    return let(sizes, lambda s: let(running(F.transform(s, lambda x: x["b"] + x["m"])), lambda ends: spans(s, ends)))


def spans_of(text: Column, low: Column, rules: list[Rule], unseen: Column | None = None) -> Column:
    """All spans by start, then in the order of the rules. ``unseen``: versions that shall run; else all."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    each = []
    for rank, rule in enumerate(rules):
        may = F.lit(True)
        if rule.gates:
            may = F.contains(low, F.lit(rule.gates[0]))
            for gate in rule.gates[1:]:
                may = may | F.contains(low, F.lit(gate))
        may = may & text.rlike(rule.pattern)
        if unseen is not None:
            may = F.array_contains(unseen, rule.version) & may
        each.append(F.when(may, _places(text, rule, rank)).otherwise(none))
    return F.array_sort(F.flatten(F.array(*each)))


LEDGER = f"blob string, versions array<string>, spans array<{SPAN}>"


def empty_ledger(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], LEDGER)


def named(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, blob, text)``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", F.sha2("text", 256).alias("blob"), "text")


def unseen_pairs(blobs: DataFrame, ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(blob, unseen)``: the rule versions that each blob has yet to meet; blobs that met all have no row."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen"))
    met = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    return met.select("blob", F.array_except(versions, F.col("seen")).alias("unseen")).where(F.size("unseen") > 0)


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(paths, entries)``: the stored ``(doc_id, blob)`` of all rows, and what the ledger gains.

    An entry holds the versions that a blob now met and what they found, if anything; later runs skip these pairs.
    """
    rules = RULES if rules is None else rules
    rows = named(docs, id_col, text_col)
    paths = stored(rows.select("doc_id", "blob"), "paths")
    # One row of each blob scans it.
    firsts = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    due = unseen_pairs(firsts, empty_ledger(docs) if ledger is None else ledger, rules).join(firsts, "blob")
    due = due.select(F.col("doc_id").alias("at"), F.col("blob").alias("due_blob"), "unseen")
    here = F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("due_blob"))
    due = due.hint("shuffle_hash")
    texts = rows.join(due, here).select("blob", "text", "unseen")
    # Only where rows share both id and text is a second step needed to leave one of them.
    repeated = paths.groupBy("doc_id", "blob").count().where("count > 1").limit(1).count()
    texts = (texts.dropDuplicates(["blob"]) if repeated else texts).withColumn("low", F.lower("text"))
    return paths, texts.select("blob", F.col("unseen").alias("versions"), spans_of(F.col("text"), F.col("low"), rules, F.col("unseen")).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(findings, ledger)``: ``(doc_id, blob, spans)`` of every row, and the ledger with this run's entries.

    Pairs in the ledger aren't scanned; their spans are taken from it. The new ledger is for the caller to keep.
    """
    rules = RULES if rules is None else rules
    paths, entries = scan_new(docs, ledger, rules, id_col, text_col)
    entries = stored(entries, "entries")
    everything = entries if ledger is None else ledger.unionByName(entries)
    # Ranks follow the present order of the rules; spans of versions that aren't among them are left out.
    order = F.array(*[F.lit(r.version) for r in rules])
    ranked = lambda s: F.struct(s["first"], (F.array_position(order, s["version"]) - 1).cast("int").alias("rank"), s["upto"], s["kind"], s["version"])
    current = everything.where(F.size("spans") > 0).withColumn("spans", F.transform(F.filter("spans", lambda s: F.array_contains(order, s["version"])), ranked))
    by_blob = current.groupBy("blob").agg(_told_once(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans")), everything


def _told_once(ordered: Column) -> Column:
    """A sorted array without repeats; array_distinct compares every struct with every other one."""
    return let(ordered, lambda o: F.filter(o, lambda s, i: (i == 0) | (s != F.get(o, i - 1))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["upto"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the base kinds, and all spans."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by ``mark``, touching and overlapping spans by one.

    ``found``: of the same rows. Rows join on id and blob, so repeated ids with other texts stay apart.
    """
    keys = found.where(F.size("spans") > 0).select("blob", "spans").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))

    # A place in a text is found by walking to it, so texts are cut from chunks of bounded length.
    def between(chunks: Column, first: Column, upto: Column) -> Column:
        part = lambda k: F.substring(F.get(chunks, k), F.greatest(first - k * CHUNK, F.lit(0)) + 1, F.least(upto, (k + 1) * CHUNK) - F.greatest(first, k * CHUNK))
        held = F.sequence(F.floor(first / CHUNK).cast("int"), F.floor((upto - 1) / CHUNK).cast("int"))
        return F.when(first < upto, F.array_join(F.transform(held, part), "")).otherwise("")

    def marked(spans: Column, chunks: Column, ends: Column) -> Column:
        def before(s: Column, i: Column) -> Column:
            last = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.when((i == 0) | (s["first"] > last), F.concat(between(chunks, last, s["first"]), F.lit(mark))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, before), ""), between(chunks, F.element_at(ends, -1), F.length(text)))

    tagged = docs.withColumn("millrace_blob", F.sha2(text, 256))
    joined = tagged.join(keys.withColumnRenamed("blob", "millrace_blob").withColumnRenamed("spans", "millrace_spans"), "millrace_blob", "left")
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    cut = let(F.col("millrace_spans"), lambda s: let(chunks, lambda c: let(running(F.transform(s, lambda x: x["upto"]), F.greatest), lambda ends: marked(s, c, ends))))
    return joined.withColumn(text_col, F.when(F.col("millrace_spans").isNotNull(), cut).otherwise(F.col(text_col))).select(*docs.columns)
