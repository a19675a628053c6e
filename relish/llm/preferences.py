"""Chat formatting of preference pairs.

The longest common beginning of the chosen and the rejected conversation, in
whole turns, is rendered once as the prompt; what follows becomes two
completions, with the spans of characters that are learned from: the
assistant's words.  A pair is one row and is worked on by itself, with column
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = ("assistant",)


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation, ordered by turn, then role and text, as (role, text).

    Rows without a conversation id belong to none and are left out.
    """
    entry = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return turns.filter(F.col(conv_id).isNotNull()).groupBy(conv_id).agg(F.array_sort(F.collect_list(entry)).alias("turns")).withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _plain(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _plain(turn["role"]), F.lit(CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(_plain(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    """The text of some turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def trained_spans(turns: Column, trained: tuple[str, ...] = TRAINED) -> Column:
    """[start, end) in characters of what is learned from in ``render(turns)``: text and end mark of the trained roles."""
    sizes = F.transform(turns, lambda t: F.struct(
        F.length(_head(t)).alias("head"), F.length(_body(t)).alias("body"), F.coalesce(t["role"].isin(*trained), F.lit(False)).alias("trained")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, s: Column) -> Column:
        start = state["at"] + s["head"]
        own = F.array(F.struct(start.alias("start"), (start + s["body"]).alias("end")))
        return F.struct((start + s["body"]).alias("at"), F.when(s["trained"], F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(sizes, empty, add, lambda state: state["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """``pairs`` with ``n_common``, ``prompt``, ``chosen_text``, ``rejected_text``, ``chosen_spans`` and ``rejected_spans``.

    ``chosen`` and ``rejected`` are arrays of (role, text).  Turns are equal if
    role and text are; null is the same as empty and renders so; a null role is not
    trained.  A null conversation counts as empty.  If one conversation begins
    the other, or both are equal, its completion is empty.  Repeated rows are
    formatted alike, an empty table gives an empty result, and columns of
    ``pairs`` with the names above are replaced.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    a, b = F.coalesce(F.col(chosen), none), F.coalesce(F.col(rejected), none)
    both = F.least(F.size(a), F.size(b))
    same = F.transform(F.arrays_zip(F.slice(a, 1, both).alias("a"), F.slice(b, 1, both).alias("b")),
                       lambda z: (_plain(z["a"]["role"]) == _plain(z["b"]["role"])) & (_plain(z["a"]["text"]) == _plain(z["b"]["text"])))
    first = F.array_position(same, False)
    out = pairs.withColumn("n_common", F.when(first > 0, first - 1).otherwise(both.cast("long")))
    start = (F.col("n_common") + 1).cast("int")
    rest_a, rest_b = F.slice(a, start, F.size(a)), F.slice(b, start, F.size(b))
    return out.withColumns({
        "prompt": render(F.slice(a, F.lit(1), F.col("n_common").cast("int"))), "chosen_text": render(rest_a), "rejected_text": render(rest_b),
        "chosen_spans": trained_spans(rest_a, trained), "rejected_spans": trained_spans(rest_b, trained)})


def reply_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs from single conversations: each up to its last assistant turn, against the same with another last reply.

    The other reply is the conversation's first one, or an empty one if there
    is no other.  Without an assistant turn both sides are the whole conversation.
    Rows without a conversation id are left out.
    """
    told = conversations(turns)
    is_reply = lambda t: F.coalesce(t["role"] == "assistant", F.lit(False))
    place = F.transform("turns", is_reply)
    told = told.withColumn("_first", F.array_position(place, True)).withColumn(
        "_last", F.when(F.col("_first") > 0, F.size("turns") + 1 - F.array_position(F.reverse(place), True)).otherwise(F.size("turns")))
    kept = told.withColumn("chosen", F.slice("turns", F.lit(1), F.col("_last").cast("int")))
    other = F.when(F.col("_first") < F.col("_last"), F.coalesce(F.element_at("turns", F.greatest(F.col("_first"), F.lit(1)).cast("int"))["text"], F.lit(""))).otherwise(F.lit(""))
    swapped = F.transform("chosen", lambda t, i: F.when((i == F.col("_last") - 1) & (F.col("_first") > 0), F.struct(
        t["role"].alias("role"), F.col("_other").alias("text"))).otherwise(t))
    return kept.withColumn("_other", other).withColumn("rejected", swapped).select("conv_id", "chosen", "rejected")


SQL = r"""
WITH t AS (
  SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ends AS (
  SELECT *, max(CASE WHEN role = 'assistant' THEN pos END) OVER w AS last, min(CASE WHEN role = 'assistant' THEN pos END) OVER w AS first,
    min_by(text, CASE WHEN role = 'assistant' THEN pos END) OVER w AS first_text FROM t WINDOW w AS (PARTITION BY conv_id)),
sides AS (
  SELECT conv_id, pos, role, text AS a, CASE WHEN pos = last THEN CASE WHEN first < last THEN first_text ELSE '' END ELSE text END AS b
  FROM ends WHERE last IS NULL OR pos <= last),
common AS (
  SELECT *, coalesce(min(CASE WHEN a <> b THEN pos - 1 END) OVER (PARTITION BY conv_id), count(*) OVER (PARTITION BY conv_id)) AS n FROM sides),
drawn AS (
  SELECT *, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, a || '<|end|>' || chr(10) AS ta, b || '<|end|>' || chr(10) AS tb FROM common),
placed AS (
  SELECT *, sum(length(head) + length(ta)) OVER c - length(ta) AS sa, sum(length(head) + length(tb)) OVER c - length(tb) AS sb
  FROM drawn WINDOW c AS (PARTITION BY conv_id, pos > n ORDER BY pos))
SELECT conv_id, any_value(n)::BIGINT AS n_common, coalesce(string_agg(head || ta, '' ORDER BY pos) FILTER (pos <= n), '') AS prompt,
  coalesce(string_agg(head || ta, '' ORDER BY pos) FILTER (pos > n), '') AS chosen_text, coalesce(string_agg(head || tb, '' ORDER BY pos) FILTER (pos > n), '') AS rejected_text,
  coalesce(string_agg(sa::BIGINT || '-' || (sa + length(ta))::BIGINT, ' ' ORDER BY pos) FILTER (pos > n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(sb::BIGINT || '-' || (sb + length(tb))::BIGINT, ' ' ORDER BY pos) FILTER (pos > n AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id
"""
