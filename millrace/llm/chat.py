"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: a turn belongs to the window on whose
stretch of ``budget // 2`` tokens its last token lies. A window holds, in this order, the system turn (the
conversation's first turn, where its role is system), history (turns of the window before, within
``budget // 8`` tokens of the span's start), and its own turns. Only assistant texts among its own turns are
under the loss mask, so every target counts once, whatever is repeated as context. Turns of up to
``budget // 8`` tokens leave every window within the budget; a longer turn stays whole and its window is
marked ``over``. Tokens are measured by built-in functions, as these have no vocabulary: see :func:`tokens`.

Sums are taken in two levels, over stretches of ``STRETCH`` turn numbers and then within them, and windows are
groups of their own, so a very long conversation is spread over tasks. Only its digest, which is defined over
its whole text, brings a conversation together.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a backslash is doubled and
``<|`` becomes ``<\\|``; a line feed in a role becomes ``<\\n|``. So no text can open or close a turn, and the
inverse is exact.

Defined results: null texts and roles are empty; turns of one number are ordered by role, then text; repeated
rows are turns each; rows without conversation id form one conversation; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import let, running, stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BUDGET = 2048
STRETCH = 256
#: A window's own turns take this part of the budget, and its history this.
OWN, HISTORY = 2, 8


def escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(s: Column) -> Column:
    return F.replace(escape(s), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(s: Column) -> Column:
    return unescape(F.replace(s, F.lit("<\\n|"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """The budget's measure: a token for every four characters begun, one for every byte beyond a character's first, and four for a turn's marks.

    So letters beyond ASCII, which byte-level vocabularies cut finely, count in full.
    """
    return (F.ceil(F.length(text) / 4) + F.octet_length(text) - F.length(text) + 4).cast("long")


def placed(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``conv_id, pos, role, text, start, upto, window``: place, tokens before and up to each turn, and its window."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"n": tokens(F.col("text")), "stretch": F.coalesce(F.floor(F.col("turn") / STRETCH).cast("long"), F.lit(-(1 << 62)))})
    sums = rows.groupBy("conv_id", "stretch").agg(F.sum("n").alias("own"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")))
    within = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"upto": F.col("n_before") + F.sum("n").over(within), "pos": F.col("rows_before") + F.count(F.lit(1)).over(within)})
    return rows.select("conv_id", "pos", "role", "text", (F.col("upto") - F.col("n")).alias("start"), "upto", F.floor((F.col("upto") - 1) / (budget // OWN)).cast("long").alias("window"))


def windows(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """A formatted row per window: ``conv_id, window, first, repeated, formatted, loss, over``.

    ``first``: place of its first own turn; ``repeated``: turns before that which are context only; ``loss``:
    spans (start, upto) of ``formatted``, in code points, that are under the mask.
    """
    rows = stored(placed(turns, budget), "turns")
    spans = rows.groupBy("conv_id", "window").agg(F.min("start").alias("span_start"))
    order = Window.partitionBy("conv_id").orderBy("window")
    spans = spans.withColumn("last", F.lag("window").over(order))
    following = spans.select(F.col("conv_id").alias("c"), F.col("last").alias("w"), F.col("window").alias("next"), F.col("span_start").alias("next_start")).where("w is not null")
    leads = (F.col("pos") == 1) & (F.col("role") == "system")
    member = ["conv_id", "window", "kind", "pos", "role", "text", "n"]
    size = (F.col("upto") - F.col("start")).alias("n")
    own = rows.select("conv_id", "window", F.lit(2).alias("kind"), "pos", "role", "text", size)
    history = rows.join(following, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")))
    history = history.where(~leads & (F.col("start") >= F.col("next_start") - budget // HISTORY))
    history = history.select("conv_id", F.col("next").alias("window"), F.lit(1).alias("kind"), "pos", "role", "text", size)
    system = rows.where(leads).select(F.col("conv_id").alias("c"), "role", "text", size)
    system = spans.where("last is not null").join(system, F.col("conv_id").eqNullSafe(F.col("c")))
    system = system.select("conv_id", "window", F.lit(0).alias("kind"), F.lit(1).cast("long").alias("pos"), "role", "text", "n")
    held = own.unionByName(history.select(*member)).unionByName(system.select(*member))
    grouped = held.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("kind", "pos", "role", "text"))).alias("t"),
        F.min(F.when(F.col("kind") == 2, F.col("pos"))).alias("first"),
        F.count_if(F.col("kind") < 2).cast("int").alias("repeated"),
        (F.sum("n") > budget).alias("over"),
    )
    parts = F.transform(
        "t",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            ((t["kind"] == 2) & (t["role"] == "assistant")).alias("target"),
        ),
    )
    grouped = grouped.select("conv_id", "window", "first", "repeated", "over", parts.alias("p"))

    ends = running(F.transform("p", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)))

    def span(p: Column, upto: Column) -> Column:
        return F.when(p["target"], F.struct((upto - F.length(p["body"])).alias("start"), upto.alias("upto")))

    spans = let(ends, lambda e: F.filter(F.transform("p", lambda p, i: span(p, F.get(e, i) - len(CLOSE))), lambda s: s.isNotNull()))
    text = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return grouped.select("conv_id", "window", "first", "repeated", text.alias("formatted"), spans.alias("loss"), "over")


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per window with what its text says: ``turns`` (role, text) of its own, and the text under the mask."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.col("repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("repeated"), F.lit(0)))
    turn = lambda p: F.struct(
        unescape_role(F.substring(F.substring_index(p, "\n", 1), len(OPEN) + 1, 1 << 30)).alias("role"),
        unescape(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.length(p))).alias("text"),
    )
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["upto"] - s["start"])))
    return formatted.select("conv_id", "window", "first", F.transform(pieces, turn).alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("formatted").cast("long").alias("chars"))


def digest(formatted: DataFrame) -> DataFrame:
    """A row per conversation, all of it taken from the formatted text."""
    told = read_back(formatted).select(
        "conv_id", "first", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), "loss_text", "chars"
    )
    one = told.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("first", "said", "loss_text"))).alias("w"))
    joined = lambda name: F.array_join(F.transform("w", lambda w: w[name]), "")
    return one.select("conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("loss_text")).cast("long").alias("loss_chars"), F.sha2(joined("loss_text"), 256).alias("loss_sha256"), "formatted_chars")
