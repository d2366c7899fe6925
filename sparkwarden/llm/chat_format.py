"""Operator 8: preference formatting of conversations.

A pair is a chosen and a rejected conversation.  The longest common prefix of their turns is rendered once, as the
prompt; what follows on either side is rendered as a completion, with a mask that keeps the assistant's words only.

Only DataFrame functions run here.  Texts are shuffled once, to gather the turns of `BLOCK` consecutive numbers; a turn
that both sides have travels on as one.  Everything that spans blocks (places, the first place at which the sides differ,
offsets in the completions) is worked out on hashes and lengths, and joined back by block.  A block is one output row, so
no conversation, however long, is one group: rows in order of `block` make up the pair's prompt and completions, and a
mask counts from the start of the whole completion, whichever row it stands in.

Defined cases: turns are ordered by number, repeated numbers by role and text, and identical rows count once; turns
with a null number come first; a null role is `user` and a null text is empty; a pair with one side missing has an empty
prompt and an empty other side; identical sides are all prompt; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import save

#: Turn numbers that one output row spans.
BLOCK = 64
ASSISTANT = "assistant"
END = "<|end|>\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(header(role), text, F.lit(END))


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _turns(df: DataFrame, pair: str, turn: str, role: str, text: str, chosen: bool) -> DataFrame:
    number = F.coalesce(F.col(turn).cast("bigint"), F.lit(-1))
    return df.select(
        F.struct(F.col(pair).alias("id")).alias("_pair"),  # a null id is a pair like any other
        F.floor(number / BLOCK).alias("_block"),
        number.alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("user")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
        F.lit(chosen).alias("_c"),
        F.lit(not chosen).alias("_r"),
    )


def _blocks(turns: DataFrame) -> DataFrame:
    """(_pair, _block, _turns): the distinct turns of a block in order, each with the sides that have it."""
    one = turns.repartition("_pair", "_block").groupBy("_pair", "_block", "_turn", "_role", "_text").agg(F.max("_c").alias("_c"), F.max("_r").alias("_r"))
    return one.groupBy("_pair", "_block").agg(F.array_sort(F.collect_list(F.struct("_turn", "_role", "_text", "_c", "_r"))).alias("_turns"))


def _places(blocks: DataFrame) -> DataFrame:
    """(_pair, _block, _prefix, and for each side s: _base_s, its turns in earlier blocks, _at_s, its completion's characters there)."""
    sides = ("_c", "_r")
    slim = [F.transform(F.filter("_turns", lambda t: t[s]), lambda t: F.struct(F.xxhash64(t["_role"], t["_text"]).alias("h"), F.xxhash64(t["_text"], t["_role"], F.lit(1)).alias("g"), F.length(render(t["_role"], t["_text"])).alias("n"))).alias(f"_turns{s}") for s in sides]  # noqa: B023
    slim = save(blocks.select("_pair", "_block", *slim), "turn-hashes")
    before = Window.partitionBy("_pair").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    sizes = slim.select("_pair", "_block", *[F.size(f"_turns{s}").alias(f"_n{s}") for s in sides])
    bases = sizes.select("_pair", "_block", *[total(f"_n{s}").alias(f"_base{s}") for s in sides])
    based = save(slim.join(bases, ["_pair", "_block"]), "turn-places")
    placed = [based.select("_pair", F.col(f"_base{s}").alias("_base"), F.posexplode(f"_turns{s}").alias("_i", "_t")).select("_pair", (F.col("_base") + F.col("_i")).alias("_place"), F.struct("_t.h", "_t.g").alias("_h"), F.lit(s).alias("_s")) for s in sides]
    # A place at which both sides have equal turns has two rows of one hash.
    both = placed[0].unionByName(placed[1]).groupBy("_pair", "_place").agg(F.count("*").alias("_n"), F.min("_h").alias("_x"), F.max("_h").alias("_y"))
    same = (F.col("_n") == 2) & (F.col("_x") == F.col("_y"))
    prefix = both.groupBy("_pair").agg(F.coalesce(F.min(F.when(~same, F.col("_place"))), F.max("_place") + 1).alias("_prefix"))

    def length(s: str) -> Column:
        """Characters of the block's turns from the prefix on."""
        return F.aggregate(F.slice(f"_turns{s}", F.greatest(F.lit(1), F.least(F.col("_prefix") - F.col(f"_base{s}") + 1, F.size(f"_turns{s}") + 1).cast("int")), F.size(f"_turns{s}")), F.lit(0).cast("bigint"), lambda n, t: n + t["n"])

    sized = based.join(prefix, "_pair").select("_pair", "_block", "_prefix", *[F.col(f"_base{s}") for s in sides], *[length(s).alias(f"_n{s}") for s in sides])
    return sized.select("_pair", "_block", "_prefix", *[F.col(f"_base{s}") for s in sides], *[total(f"_n{s}").alias(f"_at{s}") for s in sides])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (pair_col, block, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask).

    Masks are arrays of (start, end) character ranges of the pair's whole completion that count for the loss: the
    assistant's words and the end mark after them.  Blocks of one pair join, in order, to its prompt and completions.
    """
    names = (pair_col, turn_col, role_col, text_col)
    blocks = save(_blocks(_turns(chosen, *names, True).unionByName(_turns(rejected, *names, False))), "turns-by-block")
    rows = blocks.join(_places(blocks), ["_pair", "_block"])

    def side(s: str, done: bool) -> Column:
        mine = F.filter("_turns", lambda t: t[s])
        return F.filter(mine, lambda t, i: (F.col(f"_base{s}") + i >= F.col("_prefix")) if done else (F.col(f"_base{s}") + i < F.col("_prefix")))

    def text_of(turns: Column) -> Column:
        return F.concat_ws("", F.transform(turns, lambda t: render(t["_role"], t["_text"])))

    def mask_of(turns: Column, at: Column) -> Column:
        # A running offset; the mark after a turn is its last character range, so a model learns to stop.
        start = F.struct(at.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            begin = acc["at"] + F.length(header(t["_role"]))
            stop = begin + F.length(t["_text"]) + F.lit(len(END) - 1)
            spans = F.when(t["_role"] == ASSISTANT, F.concat(acc["spans"], F.array(F.struct(begin.cast("bigint").alias("start"), stop.cast("bigint").alias("end"))))).otherwise(acc["spans"])
            return F.struct((stop + 1).cast("bigint").alias("at"), spans.alias("spans"))

        return F.aggregate(turns, start, step, lambda acc: acc["spans"])

    return rows.select(
        F.col("_pair.id").alias(pair_col),
        F.col("_block").alias("block"),
        F.col("_prefix").alias("n_prompt_turns"),
        text_of(side("_c", False)).alias("prompt"),
        text_of(side("_c", True)).alias("chosen"),
        mask_of(side("_c", True), F.col("_at_c")).alias("chosen_mask"),
        text_of(side("_r", True)).alias("rejected"),
        mask_of(side("_r", True), F.col("_at_r")).alias("rejected_mask"),
    )


def swapped_replies(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) from conversations alone: a rejected conversation ends with the last assistant turn of its
    neighbour (ids 2k and 2k + 1) instead of its own.  Without own or neighbour's reply the turn is left out.
    """
    t = df.select(F.col(conv_col).cast("bigint").alias("pair_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    last = t.where(F.col("role") == ASSISTANT).groupBy(F.col("pair_id").alias("_p")).agg(F.max(F.struct("turn", "text")).alias("_last"))
    cut = t.join(last.select("_p", F.col("_last.turn").alias("_at")), F.col("pair_id").eqNullSafe(F.col("_p")), "left")
    kept = cut.where("_at is null or turn is null or turn < _at").select("pair_id", "turn", "role", "text")
    other = last.select(F.col("_p").bitwiseXOR(F.lit(1).cast("bigint")).alias("_q"), F.col("_last.text").alias("_reply"))
    reply = last.join(other, F.col("_p") == F.col("_q")).select(F.col("_p").alias("pair_id"), F.col("_last.turn").alias("turn"), F.lit(ASSISTANT).alias("role"), F.col("_reply").alias("text"))
    return t, kept.unionByName(reply)
