"""Quotation linking for chats and mailing lists, in DataFrame functions only.

Lines that begin with ``>`` are quoted, one level for each mark.  A run of lines of one level is
a passage; passages are normalised and hashed, and joined to the earliest message of the
conversation that has the same passage or line unquoted.  Each message replies to the message it
quotes most at the lowest level, and threads are ordered so that a reply follows its original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: A text with a quoted line.
QUOTES = r"(?:^|[\r\n])[ \t]*>"
#: Endings of the line that introduces a quotation.
ATTRIBUTION = r"(?i)^.{0,300}\b(wrote|writes|schrieb|a écrit|escribió) ?:[ \t]*$"


def normalised(text: Column) -> Column:
    """Lower case, one space between words, no space or mark at the ends."""
    plain = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.regexp_replace(plain, r"^[ .,;:!?…]+|[ .,;:!?…]+$", "")


def _hash(normal: Column) -> Column:
    return F.when(normal != "", F.xxhash64(normal, F.length(normal)))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row, even where a lambda below reads them for each element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def passages(messages: DataFrame, quoting_only: bool = False) -> DataFrame:
    """Add ``__passages__``: array of (nth, level, body, lines) in order; level -1 introduces a quotation.

    With ``quoting_only`` a text without quoted lines is not cut up: it has one empty passage.
    """
    line, levels, bodies, starts = (F.col(c) for c in ("__lines__", "__levels__", "__bodies__", "__starts__"))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    out = _held(messages, __lines__=F.split(F.regexp_replace(F.coalesce(F.when(F.col("text").rlike(QUOTES), F.col("text")) if quoting_only else "text", F.lit("")), r"\r\n?", "\n"), "\n"))
    out = _held(out, __levels__=F.transform(line, level), __bodies__=F.transform(line, lambda x: F.regexp_replace(x, MARKS, "")))
    intro = lambda x, i: (levels[i] == 0) & (F.get(levels, i + 1) > 0) & x.rlike(ATTRIBUTION)
    out = _held(out, __kinds__=F.transform(line, lambda x, i: F.when(F.coalesce(intro(x, i), F.lit(False)), -1).otherwise(levels[i])))
    kinds = F.col("__kinds__")
    n = F.size(kinds)
    out = _held(out, __starts__=F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (kinds[i] != F.get(kinds, i - 1))))

    def passage(at: Column, k: Column) -> Column:
        lines = F.slice(bodies, at + 1, F.coalesce(F.get(starts, k + 1), n) - at)
        return F.struct(k.alias("nth"), kinds[at].alias("level"), F.array_join(lines, "\n").alias("body"), lines.alias("lines"))

    out = _held(out, __passages__=F.transform(starts, passage))
    return out.drop("__lines__", "__levels__", "__bodies__", "__kinds__", "__starts__")


def quote_links(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, nth, level, passage_hash, original_turn): a row for each quoted passage.

    The original is the earliest message that says the whole passage itself, else the one that
    says most of its lines by length (ties: the later).  ``original_turn`` is null where no
    earlier message does.  Rows of one conv_id and turn are parts of one message.
    """
    named = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", "text")
    quoting = named.where(F.col("text").rlike(QUOTES)).select("conv_id").distinct()  # only these conversations can link
    cut = passages(named.join(quoting, "conv_id", "left_semi"))
    each = cut.select("conv_id", "turn", F.explode("__passages__").alias("p")).select("conv_id", "turn", "p.*")
    line = lambda x: F.struct(normalised(x).alias("normal"), F.length(x).alias("size"))
    each = _held(each, whole=_hash(normalised(F.col("body"))), normals=F.transform("lines", line))
    keyed = each.withColumn(
        "keys",
        F.array_append(
            F.transform(F.filter("normals", lambda x: x["normal"] != ""), lambda x: F.struct(_hash(x["normal"]).alias("key"), x["size"].alias("size"), F.lit(False).alias("all"))),
            F.struct(F.col("whole").alias("key"), F.length("body").alias("size"), F.lit(True).alias("all")),
        ),
    )
    said = keyed.where("level = 0").select("conv_id", "turn", F.explode("keys.key").alias("key")).where("key is not null")
    first = said.groupBy("conv_id", "key").agg(F.min("turn").alias("original"))
    quoted = keyed.where("level > 0 and whole is not null").select("conv_id", "turn", "nth", "level", "whole", F.explode("keys").alias("k"))
    quoted = quoted.select("conv_id", "turn", "nth", "level", "whole", "k.key", "k.size", "k.all")
    met = quoted.join(first, ["conv_id", "key"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    votes = met.groupBy("conv_id", "turn", "nth", "level", "whole", "original").agg(F.max("all").alias("all"), F.sum("size").alias("size"))
    best = F.max_by("original", F.struct(F.col("original").isNotNull(), "all", "size", "original"))
    return votes.groupBy("conv_id", "turn", "nth", "level", F.col("whole").alias("passage_hash")).agg(best.alias("original_turn"))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Messages without quotations: other columns, text, reply_to, thread, depth, n_quotes, n_linked.

    ``reply_to`` is the turn this message quotes most at its lowest linked level (ties: the
    later), ``thread`` the first message up that chain and ``depth`` the replies up to it.
    Sorted by (conv_id, thread, turn), each reply follows its original.  A null text stays null,
    rows with a null conv_id or turn reply to nothing, texts of any length are read whole, and an
    empty table gives none.
    """
    links = settle(quote_links(messages))
    counts = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("original_turn").alias("n_linked"))
    by_level = links.where("original_turn is not null").groupBy("conv_id", "turn", "level", "original_turn").agg(F.count("*").alias("n"))
    parents = by_level.groupBy("conv_id", "turn").agg(F.max_by("original_turn", F.struct(-F.col("level"), "n", "original_turn")).alias("reply_to"))
    # up: the farthest message known up the chain, and the replies to it; doubles each round
    up = settle(parents.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        beyond = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("far"), F.col("depth").alias("more"))
        step = up.join(beyond, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        step = settle(step.select("conv_id", "turn", "reply_to", F.coalesce("far", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("far").isNotNull().alias("moved")))
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    own = ["reply_to", "thread", "depth", "n_quotes", "n_linked"]
    kept = [c for c in messages.columns if c not in own]
    body = F.array_join(F.transform(F.filter("__passages__", lambda p: p["level"] == 0), lambda p: p["body"]), "\n")
    body = F.when(F.col("text").rlike(QUOTES), body).otherwise(F.regexp_replace("text", r"\r\n?", "\n"))
    body = F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    plain = passages(messages.select(*kept), quoting_only=True).withColumn("text", body).drop("__passages__")
    right = counts.join(up, ["conv_id", "turn"], "left").select(F.col("conv_id").alias("__c__"), F.col("turn").alias("__t__"), "reply_to", "up", "depth", "n_quotes", "n_linked")
    out = plain.join(right, (F.col("conv_id") == F.col("__c__")) & (F.col("turn") == F.col("__t__")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        *kept, "reply_to", F.coalesce("up", "turn").alias("thread"), F.coalesce("depth", zero).alias("depth"),
        F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
    )
