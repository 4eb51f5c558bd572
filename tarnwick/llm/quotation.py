"""Chat formatting by quotation linking, in DataFrame functions only.

1. Lines that begin with ``>`` marks are quoted; runs of lines of one level are passages.  A message's own text is what
   is left, without attribution lines in front of a quotation.
2. Normalised passages and their lines are hashed and looked up among the hashes of earlier messages of the same
   conversation (whole own text, and each line).  The lookup is a running "last original seen" over the union of quoted
   and original hashes, not a join of all equal pairs, so a phrase that all messages share costs a row a message, and
   it runs in blocks of turns.
3. A message replies to the message that its passages of the least recognised level come from; one that quotes nothing known replies to the
   message before it.
4. Conversations are laid out in reply order: a message, then the subtrees of its replies in turn order.  A run of
   messages each of which replies to the one before it is a segment; a segment knows the message it branches off from.
   Paths of segments are built by doubling, in as many rounds as the logarithm of the deepest nesting.

Nothing gathers a conversation in one task: running values are made per block of turns and then over the blocks, and
the result is sorted by range on (conversation, order key), which splits a conversation that holds a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import SPACE_CLASS, cut, let, put, text_of

MARKS = r"^(?:[\x20\x09]*>)+"
ATTRIBUTION = r"(?i)^\s*(?:on\b.{1,200}\bwrote|.{1,100}\bsaid|quoting .{1,100}):\s*$"
#: Turns of a conversation in one block of the running values.
BLOCK = 1024


def level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SPACE_CLASS + "+", " "))


def passages(lines: Column) -> Column:
    """Array of (level, text) for the quoted passages of an array of lines, in order."""

    def cut_runs(tagged: Column) -> Column:
        n = F.size(tagged)
        changes = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(tagged, i - 1)["level"] != F.get(tagged, i)["level"]))

        def runs(at: Column) -> Column:
            pair = lambda k: F.struct(
                F.get(tagged, F.get(at, k))["level"].alias("level"),
                F.array_join(F.transform(F.slice(tagged, F.get(at, k) + 1, F.get(at, k + 1) - F.get(at, k)), lambda x: x["body"]), "\n").alias("text"),
            )
            return F.filter(F.transform(F.sequence(F.lit(0), F.size(at) - 2), pair), lambda run: run["level"] > 0)

        return let(changes, runs)

    tag = lambda line: F.struct(level(line).alias("level"), F.regexp_replace(line, MARKS + r"[\x20\x09]?", "").alias("body"))
    return let(F.transform(lines, tag), cut_runs)


def own_text(lines: Column) -> Column:
    """The unquoted lines; an attribution line that stands in front of a quoted one goes too."""
    quoted_next = lambda i: F.coalesce(level(F.get(lines, i + 1)) > 0, F.lit(False))
    stays = lambda line, i: (level(line) == 0) & ~(line.rlike(ATTRIBUTION) & quoted_next(i))
    return F.trim(F.array_join(F.filter(lines, stays), "\n"), F.lit(" \n\t\r"))


def keys(text: Column) -> Column:
    """Hashes of a text: the whole, then each of its lines; blank ones have none."""
    parts = F.concat(F.array(text), F.split(text, "\n", -1))
    return F.array_distinct(F.transform(F.filter(F.transform(parts, normal), lambda p: p != ""), lambda p: F.xxhash64(p)))


def link_quotations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """All input rows and columns plus ``own_text, n_passages, deepest_level, parent_turn, reply_kind, links, order_key``,
    sorted by conversation and order key.

    ``reply_kind`` is ``quote`` (an earlier message's text was recognised in a passage), ``next`` (the message
    before it) or ``first``.  ``links`` has (level, turn) for each level with a recognised passage; the least level's is
    the parent.  Of several originals of a level the one that the longest-first list of a message's hashes finds first
    wins, then the latest.  Sorting a conversation by ``order_key`` gives its messages in reply order.

    Null and empty texts are messages without words.  A null conversation id is a conversation of its own; a null turn
    comes first (and is no name for a reply to it).  Rows that repeat a turn are messages of their own in no fixed order among them; replies name the turn.
    An order key grows by 41 characters with each branch inside a branch: a conversation whose branches nest n deep has
    keys of that length times n.  Very long messages are parsed whole.  An empty table gives an empty result.  Input columns named like an output are
    replaced.
    """
    lines = F.split(text_of(text_col), "\n", -1)
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 63)))
    conv = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("-"))  # null apart from any name
    rows = put(messages, {"__conv": conv, "__turn": turn, "__lines": lines})
    has_marks = text_of(text_col).rlike(r"(?m)^[\x20\x09]*>")
    none = F.array().cast("array<struct<level:int,text:string>>")
    rows = put(rows, {"__passages": F.when(has_marks, passages(F.col("__lines"))).otherwise(none)})
    rows = put(
        rows,
        {
            "own_text": F.when(has_marks, own_text(F.col("__lines"))).otherwise(F.trim(text_of(text_col), F.lit(" \n\t\r"))),
            "n_passages": F.size("__passages"),
            "deepest_level": F.coalesce(F.array_max(F.transform("__passages", lambda p: p["level"])), F.lit(0)),
        },
    ).drop("__lines")

    targets = cut(_targets(rows))
    placed = rows.drop("__passages").join(targets, ["__conv", "__turn"], "left")
    placed = _running(placed)
    root = F.col("__before").isNull()
    parent = F.when(~root, F.coalesce("__target", "__before"))
    kind = F.when(root, "first").when(F.col("__target").isNull(), "next").otherwise("quote")
    placed = put(placed, {"__parent": parent, "reply_kind": kind})
    paths = _paths(placed)
    own = F.concat(F.lit("0"), _digits(F.col("__turn")))
    out = placed.join(paths, ["__conv", "__segment"], "left")
    named = F.nullif(F.col("__parent"), F.lit(-(1 << 63)))
    links = F.coalesce("__links", F.array().cast("array<struct<level:int,turn:bigint>>"))
    out = put(out, {"parent_turn": named, "links": links, "order_key": F.concat(F.coalesce("__path", F.lit("")), own)})
    out = out.orderBy("__conv", "order_key", role_col, "own_text")
    return out.drop("__conv", "__turn", "__target", "__links", "__before", "__segment", "__path", "__parent")


def _targets(rows: DataFrame) -> DataFrame:
    """Rows (conversation, turn, target turn, links) for the messages with a passage that comes from an earlier one."""
    hashed = lambda p: F.transform(keys(p["text"]), lambda k: F.struct(p["level"].alias("level"), k.alias("key")))
    asked = rows.where(F.col("n_passages") > 0).select("__conv", "__turn", F.posexplode(F.flatten(F.transform("__passages", hashed))).alias("rank", "at"))
    asked = asked.select("__conv", "__turn", "rank", "at.level", "at.key")
    asked = cut(asked.groupBy("__conv", "__turn", "level", "key").agg(F.min("rank").alias("rank")))
    wanted = asked.select("__conv", "key").distinct()
    given = rows.select("__conv", "__turn", F.explode(keys(F.col("own_text"))).alias("key")).join(wanted, ["__conv", "key"], "left_semi").distinct()
    none = F.lit(None).cast("int")
    both = asked.select("__conv", "key", "__turn", "level", "rank", F.lit(0).alias("given")).unionByName(
        given.select("__conv", "key", "__turn", none.alias("level"), none.alias("rank"), F.lit(1).alias("given"))
    )
    # The last original before a quotation, within its block of turns or else in the blocks before: no task gets all
    # messages of a conversation that share a passage.
    both = cut(both.withColumn("block", _block()))
    block = ["__conv", "key", "block"]
    original = F.when(F.col("given") == 1, F.col("__turn"))
    blocks = both.groupBy(*block).agg(F.max(original).alias("last"))
    earlier = Window.partitionBy("__conv", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*block, F.max("last").over(earlier).alias("outer"))
    before = Window.partitionBy(*block).orderBy("__turn", "given").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("inner", F.max(original).over(before)).join(blocks, block).withColumn("target", F.coalesce("inner", "outer"))
    found = found.where((F.col("given") == 0) & F.col("target").isNotNull() & (F.col("target") < F.col("__turn")))
    best = F.min(F.struct("rank", (-F.col("target").cast("decimal(20,0)")).alias("late"))).alias("best")
    levels = found.groupBy("__conv", "__turn", "level").agg(best).select("__conv", "__turn", F.struct("level", (-F.col("best.late")).cast("long").alias("turn")).alias("link"))
    links = levels.groupBy("__conv", "__turn").agg(F.array_sort(F.collect_list("link")).alias("__links"))
    return links.select("__conv", "__turn", F.get("__links", F.lit(0))["turn"].alias("__target"), "__links")


def _block() -> Column:
    return F.floor(F.col("__turn") / BLOCK).cast("long")


def _running(rows: DataFrame) -> DataFrame:
    """``__before``: the turn before; ``__segment``: the last turn up to here that branches off (or the first turn).

    A running value over a conversation is one over its blocks of turns and one within the block.
    """
    rows = rows.withColumn("__block", _block())
    branch = F.when(F.col("__target").isNotNull(), F.col("__turn"))
    turns = rows.groupBy("__conv", "__block", "__turn").agg(F.max(branch).alias("branch"))
    within = Window.partitionBy("__conv", "__block").orderBy("__turn").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("inner_before", F.lag("__turn").over(Window.partitionBy("__conv", "__block").orderBy("__turn")))
    turns = turns.withColumn("inner_branch", F.max("branch").over(within))
    blocks = turns.groupBy("__conv", "__block").agg(F.max("__turn").alias("last"), F.max("branch").alias("last_branch"), F.min("__turn").alias("start"))
    earlier = Window.partitionBy("__conv").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "__conv",
        "__block",
        F.max("last").over(earlier).alias("outer_before"),
        F.max("last_branch").over(earlier).alias("outer_branch"),
        F.coalesce(F.min("start").over(earlier), F.col("start")).alias("start"),
    )
    turns = turns.join(blocks, ["__conv", "__block"]).select(
        "__conv",
        "__turn",
        F.coalesce("inner_before", "outer_before").alias("__before"),
        F.coalesce("inner_branch", "outer_branch", "start").alias("__segment"),
    )
    return rows.drop("__block").join(turns, ["__conv", "__turn"])


def _digits(turn: Column) -> Column:
    return F.lpad((turn.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")


def _descending(turn: Column) -> Column:
    return F.lpad((F.lit((1 << 63) - 1).cast("decimal(20,0)") - turn.cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")


def _paths(placed: DataFrame) -> DataFrame:
    """Rows (conversation, segment, path) for the segments that branch off from a message.

    After the messages of a segment come its branches, those of later messages first, then by turn.
    """
    at = placed.where("reply_kind = 'quote'").select("__conv", F.col("__turn").alias("__segment"), F.col("__parent").alias("off")).distinct()
    homes = placed.select("__conv", F.col("__turn").alias("off"), F.col("__segment").alias("up")).distinct()
    step = F.concat(F.lit("1"), _descending(F.col("off")), _digits(F.col("__segment")))
    paths = cut(at.join(homes, ["__conv", "off"]).select("__conv", "__segment", "up", step.alias("__path")))
    while True:
        above = paths.select("__conv", F.col("__segment").alias("up"), F.col("up").alias("next"), F.col("__path").alias("front"))
        joined = paths.join(above, ["__conv", "up"], "left")
        if joined.where("front is not null").isEmpty():
            return paths.select("__conv", "__segment", "__path")
        paths = cut(joined.select("__conv", "__segment", F.col("next").alias("up"), F.concat(F.coalesce("front", F.lit("")), "__path").alias("__path")))
