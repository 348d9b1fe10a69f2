"""Chat formatting into budgeted windows, in DataFrame functions only.

A conversation is laid out on a line of tokens by prefix sums. The line is cut into cells of the
window's free budget: turns inside one cell form a window, a turn that crosses a cell's edge forms its
own, so windows are turn-aligned and, but for single turns over the budget, never over it. Each window
starts with the conversation's system turn, repeats the turns just before it as far as the history
budget allows, and masks everything repeated: every assistant text counts in the loss exactly once.

Prefix sums are two-level: rows are range-partitioned by (conversation, turn), summed inside each
partition, and offset by the partitions' totals, so one long conversation spreads over many tasks.

The template writes ``### role: text </turn>`` and a newline per turn; inside roles and texts the
characters that control strings begin with are written as escapes (``escape``), which ``unescape``
reads back exactly.

A system turn is the one that leads a conversation; later turns of that role are ordinary ones.

Defined results: null roles and texts are empty; equal turns are ordered by role, then text; a null
conv_id is a conversation of its own; a system turn is repeated whole whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altigrid.model import cut

#: Fixed values of the template: what each control character becomes.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]
OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
OVERHEAD = 4


def escape(c: Column) -> Column:
    for plain, mark in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def unescape(c: Column) -> Column:
    """Every backslash of an escaped text starts one mark, so marks cannot overlap; the backslash's own comes last."""
    for plain, mark in reversed(ESCAPES):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def tokens(text: Column) -> Column:
    """Budget units: a quarter of the UTF-8 bytes, and the template's share."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint") + OVERHEAD


def placed(turns: DataFrame) -> DataFrame:
    """Turns with their number ``_i`` and first token ``_at`` in the conversation, and its system turn's size."""
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_n", tokens(F.col("text")))
    # identical rows may stand in any order, so a task-made number may part them
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = cut(rows.repartitionByRange(n, "conv_id", "turn", "role", "text", "_tie").withColumn("_block", F.spark_partition_id()))
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text", "_tie")
    first = F.struct("turn", "role", "text", "_n")
    sums = dealt.groupBy("conv_id", "_block").agg(F.sum("_n").alias("_bn"), F.count(F.lit(1)).alias("_bc"), F.min(first).alias("_bs"))
    # one row per conversation and partition: a long conversation has as many as there are partitions
    whole = Window.partitionBy("conv_id").orderBy("_block")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id")
    offsets = sums.select(
        F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_bn"),
        F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_bc"), F.min("_bs").over(over).alias("_lead"))
    offsets = offsets.withColumn("_sys", F.when(F.col("_lead.role") == "system", F.col("_lead"))).drop("_lead")
    local = dealt.select(
        "*", F.row_number().over(inside).alias("_rn"), F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"))
    both = local.join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    return both.select(
        "conv_id", "role", "text", "_n", (F.col("_rn") - 1 + F.col("_bc")).alias("_i"), (F.col("_run") - F.col("_n") + F.col("_bn")).alias("_at"), "_sys")


def windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: conv_id, first_turn, n_repeated, n_tokens, formatted, loss_spans (code points, end exclusive)."""
    free = F.greatest(F.lit(budget - history) - F.coalesce(F.col("_sys._n"), F.lit(0)), F.lit(max(budget // 4, history)))
    t = placed(turns).withColumn("_free", free)
    cell = F.floor(F.col("_at") / F.col("_free")).cast("bigint")
    t = t.withColumn("_cell", cell).withColumn("_cross", F.col("_at") + F.col("_n") > (F.col("_cell") + 1) * F.col("_free"))
    t = cut(t)
    span = ["conv_id", "_cell", "_cross"]
    starts = t.groupBy(*span).agg(F.min(F.struct("_at", "_i")).alias("_s"), F.first("_sys").alias("_sys"))
    starts = starts.select(
        F.col("conv_id").alias("_c"), F.col("_cell").alias("_sc"), F.col("_cross").alias("_sx"), F.col("_s._at").alias("_sat"), F.col("_s._i").alias("_si"), "_sys")

    piece = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BETWEEN), escape(F.col("text")), F.lit(CLOSE))
    body = F.char_length(escape(F.col("text")))
    own = t.select(*span, "_i", F.lit(2).alias("_kind"), "_n", "role", piece.alias("_piece"), body.alias("_body"))
    # a turn is history of windows that start within `history` tokens after its own start: in its cell or the next
    near = t.select("conv_id", "_i", "_at", "_n", "role", piece.alias("_piece"), body.alias("_body"), F.explode(F.array(F.col("_cell"), F.col("_cell") + 1)).alias("_to"))
    past = near.join(first_at(starts), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_to") == F.col("_sc")))
    past = past.where((F.col("_i") < F.col("_si")) & (F.col("_at") >= F.col("_sat") - history) & ~F.coalesce(F.col("_i") == F.col("_sys_i"), F.lit(False)))
    past = past.select("conv_id", F.col("_sc").alias("_cell"), F.col("_sx").alias("_cross"), "_i", F.lit(1).alias("_kind"), "_n", "role", "_piece", "_body")
    sys_piece = F.concat(F.lit(OPEN), escape(F.lit("system")), F.lit(BETWEEN), escape(F.col("_sys.text")), F.lit(CLOSE))
    system = starts.where(F.col("_sys").isNotNull() & (F.col("_si") > 0)).select(
        F.col("_c").alias("conv_id"), F.col("_sc").alias("_cell"), F.col("_sx").alias("_cross"), F.lit(-1).cast("bigint").alias("_i"), F.lit(0).alias("_kind"),
        F.col("_sys._n").alias("_n"), F.lit("system").alias("role"), sys_piece.alias("_piece"), F.char_length(escape(F.col("_sys.text"))).alias("_body"))
    rows = own.unionByName(past).unionByName(system)
    # at most one window's turns meet here, so both the running length and the list are bounded by the budget
    run = Window.partitionBy(*span).orderBy("_kind", "_i").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("_piece")).over(run), F.lit(0)) + F.char_length("_piece") - len(CLOSE) - F.col("_body")
    rows = rows.withColumn("_from", begin)
    loss = (F.col("_kind") == 2) & (F.col("role") == "assistant")
    packed = rows.groupBy(*span).agg(
        F.sort_array(F.collect_list(F.struct("_kind", "_i", "_piece", F.when(loss, F.struct(F.col("_from").alias("start"), (F.col("_from") + F.col("_body")).alias("end"))).alias("span")))).alias("_t"),
        F.sum("_n").alias("n_tokens"), F.count(F.when(F.col("_kind") < 2, 1)).cast("int").alias("n_repeated"))
    return packed.select(
        "conv_id", F.element_at("_t", F.col("n_repeated") + 1)["_i"].alias("first_turn"), "n_repeated", "n_tokens",
        F.array_join(F.transform("_t", lambda x: x["_piece"]), "").alias("formatted"),
        F.filter(F.transform("_t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"))


def first_at(starts: DataFrame) -> DataFrame:
    """Window starts, with the number of the system turn if it leads the conversation (it is not repeated as history)."""
    return starts.select("_c", "_sc", "_sx", "_sat", "_si", F.when(F.col("_sys").isNotNull(), F.lit(0).cast("bigint")).alias("_sys_i"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window, from its text alone: the turns it adds, and the text under its loss mask, both unescaped."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda x: x != "")
    fresh = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - F.col("n_repeated"), F.lit(0)))
    head = len(OPEN)

    def turn(x: Column) -> Column:
        stop = F.instr(x, BETWEEN)
        return F.struct(
            unescape(F.substring(x, F.lit(head + 1), stop - 1 - head)).alias("role"), unescape(F.substring(x, stop + len(BETWEEN), F.char_length(x))).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "first_turn", F.char_length("formatted").cast("bigint").alias("chars"), F.transform(fresh, turn).alias("turns"), masked.alias("loss"))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what ``read_back`` gives, as counts and digests."""
    w = read_back(formatted).select(
        "conv_id", "first_turn", "chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("t"), F.array_join("loss", "").alias("l"))
    c = w.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.sort_array(F.collect_list(F.struct("first_turn", "t", "l"))).alias("_w"), F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"))
    all_of = lambda k: F.array_join(F.transform("_w", lambda x: x[k]), "")
    return c.select("conv_id", "n_turns", F.sha2(all_of("t"), 256).alias("turns_sha256"), F.char_length(all_of("l")).cast("bigint").alias("loss_chars"),
                    F.sha2(all_of("l"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")
