"""Preference formatting of chat turns, DataFrame operations only.

Of a chosen and a rejected conversation the longest common prefix of turns is rendered once as
the prompt. The turns after it become two completions, each with the spans a model is trained
on: the bodies and end marks of assistant turns. Headers and other roles stay masked. What marks
turns in the template is escaped inside roles and texts, so no text forges a turn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import running
from .common import table


@dataclass(frozen=True)
class Template:
    """Header of a turn (with its role inside), the end mark after its text, and what every mark begins
    with, which stands escaped in roles and texts (empty: nothing is escaped)."""

    before: str = "<|im_start|>"
    after: str = "\n"
    end: str = "<|im_end|>\n"
    mark: str = "<|"
    escaped: str = "< |"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id, turns``: the turns of each conversation, in order of turn, role and text.

    Null roles and texts count as empty, null turn numbers come first; rows without a
    conversation id belong to none and are left out. Repeated rows are turns of their own. An empty
    table gives no rows, and other columns are not read. A conversation becomes one row, whatever its
    number of turns, as its rendered text is one value.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns that both lists share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.coalesce(F.array_position(same, False), F.lit(0)).cast("int")  # 0: all are shared


def _prefix_length(a: str, b: str) -> Column:
    first = common_prefix(F.col(a), F.col(b))
    return F.when(first > 0, first - 1).otherwise(F.size(a))


def _rest(turns: str) -> Column:
    return F.slice(turns, F.col("n_prompt") + 1, F.greatest(F.size(turns) - F.col("n_prompt"), F.lit(0)))


def _plain(value: Column, t: Template) -> Column:
    return F.replace(value, F.lit(t.mark), F.lit(t.escaped)) if t.mark else value


def _head(turn: Column, t: Template) -> Column:
    return F.concat(F.lit(t.before), _plain(turn["role"], t), F.lit(t.after))


def rendered(turns: Column, t: Template) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x, t), _plain(x["text"], t), F.lit(t.end))), "")


def trained_spans(turns: Column, t: Template, role: str = "assistant") -> Column:
    """Spans ``start:end`` (code points of the rendered turns) of that role's texts and end marks."""
    head = lambda x: F.length(_head(x, t))
    size = lambda x: F.length(_plain(x["text"], t)) + len(t.end)
    starts = running(F.transform(turns, lambda x: head(x) + size(x)), lambda a, v: a + v)
    span = lambda x, at: F.when(x["role"] == role, F.concat_ws(":", (at + head(x)).cast("string"), (at + head(x) + size(x)).cast("string")))
    return F.array_join(F.zip_with(turns, starts, span), ",")


def format_preferences(pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """Prompt and masked completions for rows (id, chosen, rejected) of turn lists.

    Returns id, n_prompt, prompt, chosen, rejected, chosen_spans, rejected_spans, status.
    status is 'pair' if both completions have a trained span, 'no rejected' if there is no
    rejected conversation (its columns are null, and all of chosen's turns are the prompt),
    'same' if the conversations are equal, else 'one-sided', as where one is a prefix of the other.
    Rows without a chosen conversation keep their id, all else null but the status, 'no chosen'.
    Equal rows give equal rows, and talks of any length take linear time.
    """
    whole = pairs.withColumn("n_prompt", F.when(F.col("rejected").isNull(), F.size("chosen")).otherwise(_prefix_length("chosen", "rejected")))
    cut = whole.select("id", "n_prompt", F.slice("chosen", 1, F.col("n_prompt")).alias("p"), _rest("chosen").alias("c"), F.when(F.col("rejected").isNotNull(), _rest("rejected")).alias("r"))
    out = cut.select("id", F.col("n_prompt").cast("long"), rendered(F.col("p"), template).alias("prompt"), *[f(F.col(x), template).alias(n) for x, n, f in (("c", "chosen", rendered), ("r", "rejected", rendered), ("c", "chosen_spans", trained_spans), ("r", "rejected_spans", trained_spans))])
    status = F.when(F.col("rejected").isNull(), "no rejected").when((F.col("chosen") == "") & (F.col("rejected") == ""), "same").when((F.col("chosen_spans") != "") & (F.col("rejected_spans") != ""), "pair").otherwise("one-sided")
    made = out.withColumn("status", F.when(F.col("chosen").isNull(), "no chosen").otherwise(status))
    return made.select("id", *[F.when(F.col("chosen").isNotNull(), F.col(c)).alias(c) for c in made.columns[1:-1]], "status")


def swapped_replies(talks: DataFrame) -> DataFrame:
    """Pairs (id, chosen, rejected) from conversations with integer ids, each of which is chosen once.

    In the rejected one an assistant turn gives way to one of its neighbour (ids 2k and 2k + 1), and
    what follows stays: the turn number k modulo the number of assistant turns. Of 16 conversations one
    meets itself and one is cut off behind that turn instead. Without an assistant turn on a side that
    needs one there is no rejected conversation.
    """
    own = F.array_compact(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i + 1)))
    nth = F.pmod(F.shiftright("id", 1), F.size("own")).cast("int")
    placed = talks.withColumn("own", own).withColumn("pick", F.when(F.size("own") > 0, F.get("own", nth)))
    donors = placed.where("pick is not null").select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.element_at("turns", F.col("pick")).alias("reply"))
    joined = placed.join(donors, "id", "left")
    part = lambda a, n: F.slice("turns", a, F.greatest(n, F.lit(0)))
    swapped = F.when(F.col("reply").isNotNull(), F.concat(part(F.lit(1), F.col("pick") - 1), F.array("reply"), part(F.col("pick") + 1, F.size("turns") - F.col("pick"))))
    kind = F.pmod("id", F.lit(16))
    rejected = F.when(F.col("pick").isNotNull(), F.when(kind == 14, F.col("turns")).when(kind == 15, part(F.lit(1), F.col("pick"))).otherwise(swapped))
    return joined.select("id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def op2_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against one that differs from it at a turn, is cut short or equal."""
    talks = conversations(table(spark, sf_dir, "conversations"))
    return format_preferences(swapped_replies(talks)).withColumnRenamed("id", "conv_id")


OP2_SQL = """
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), sizes as (
  select conv_id, count(*) as n, count(*) filter (role = 'assistant') as m, ((conv_id % 16) + 16) % 16 as kind from turns group by conv_id
), picks as (
  select a.conv_id, k as pick, role, text, kind from (select *, row_number() over (partition by conv_id order by k) as nth from turns where role = 'assistant') a join sizes s using (conv_id)
  where nth = ((conv_id >> 1) % m + m) % m + 1
), rejected as (
  select t.conv_id, k, t.role, t.text from turns t join picks p using (conv_id)
  where kind = 14 or kind = 15 and k <= pick or kind < 14 and k <> pick and exists (from picks r where r.conv_id = xor(p.conv_id, 1))
  union all
  select p.conv_id, p.pick, r.role, r.text from picks p join picks r on r.conv_id = xor(p.conv_id, 1) where p.kind < 14
), cut as (
  select s.conv_id, r.n is not null as has, case when r.n is null then s.n else coalesce(min(k) - 1, s.n) end as n_prompt
  from sizes s left join (select conv_id, count(*) as n from rejected group by conv_id) r using (conv_id)
  left join (
    select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.k, b.k) as k from turns a full join rejected b on a.conv_id = b.conv_id and a.k = b.k
    where a.role is distinct from b.role or a.text is distinct from b.text
  ) d on d.conv_id = s.conv_id and r.n is not null
  group by s.conv_id, r.n, s.n
), pieces as (
  select side, conv_id, k, replace(role, '<|', '< |') as role, replace(text, '<|', '< |') as text, role = 'assistant' as trained
  from (select 'chosen' as side, conv_id, k, role, text from turns union all select 'rejected', conv_id, k, role, text from rejected)
), laid as (
  select p.*, n_prompt, '<|im_start|>' || role || chr(10) as head, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as whole,
         coalesce(sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))) filter (k > n_prompt) over (partition by side, conv_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as pos
  from pieces p join cut using (conv_id)
), sides as (
  select conv_id, side, coalesce(string_agg(whole, '' order by k) filter (k > n_prompt), '') as body,
         coalesce(string_agg((pos + length(head)) || ':' || (pos + length(whole)), ',' order by k) filter (k > n_prompt and trained), '') as spans,
         coalesce(string_agg(whole, '' order by k) filter (k <= n_prompt), '') as prompt
  from laid group by conv_id, side
), final as (
  select c.conv_id, cast(c.n_prompt as bigint) as n_prompt, a.prompt, a.body as chosen, b.body as rejected, a.spans as chosen_spans, b.spans as rejected_spans
  from cut c join sides a on a.conv_id = c.conv_id and a.side = 'chosen' left join sides b on b.conv_id = c.conv_id and b.side = 'rejected'
)
select *, case when rejected is null then 'no rejected' when chosen = '' and rejected = '' then 'same' when chosen_spans <> '' and rejected_spans <> '' then 'pair' else 'one-sided' end as status
from final
"""
