"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores.

DataFrame operations only. A text is cut at the matches of a pattern, so running sums over the
lengths of pieces and matches give every span in code points, and the text on both sides of a match
is its context. Possessive patterns that start where a run starts keep long runs linear, and
running sums in chunks keep texts of many matches so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import once, running
from .common import table

#: Code points on each side of a span that count as its context.
CONTEXT = 40
#: Spans of added kinds need this score, in hundredths; base kinds stay whatever their score.
LEAST_SCORE = 50
#: Code points of a block that a text is redacted in.
BLOCK = 2048


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a cheap pattern without which no match exists
    words: tuple[str, ...]  # context that speaks for a span
    prior: int  # hundredths
    base: bool = True


#: The patterns of the contract, made possessive, and those of the added kinds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", ("mail", "contact", "write"), 90),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]++\.[0-9]", ("ip", "host", "server", "address"), 70),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", ("card", "visa", "credit", "pay"), 70),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", ("tel", "phone", "call", "mobile", "fax"), 60),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?", r"[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4}", ("iban", "account", "bank"), 80, False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9]{2}-[0-9]", ("ssn", "social security"), 30, False),
)
BONUS = 30


def _octet(part: Column) -> Column:
    digits = F.regexp_replace(part, "^0+", "")
    return (F.length(digits) < 3) | ((F.length(digits) == 3) & (digits <= "255"))


def mod97(code: Column) -> Column:
    """Whether an IBAN without blanks has the checksum remainder 1."""
    turned = F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.pmod(acc * F.when(c <= "9", 10).otherwise(100) + value(c), F.lit(97))
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _octet)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & mod97(code)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_of(kind: Kind, text: Column) -> Column:
    """The confirmed spans of one kind in order, or an empty array."""
    cut = F.zip_with(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    size = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    text_of = lambda cells, i, name: F.coalesce(F.get(cells, i)[name], F.lit(""))
    left, right = (lambda c: F.substring(c, 1, CONTEXT)), (lambda c: F.substring(c, -CONTEXT, CONTEXT))

    def all_spans(cells: Column) -> Column:
        def span(x: Column, i: Column, at: Column) -> Column:
            start = at + F.length(x["p"])
            before = right(F.concat(right(text_of(cells, i - 1, "p")), right(text_of(cells, i - 1, "m")), right(x["p"])))
            after = left(F.concat(left(text_of(cells, i + 1, "p")), left(text_of(cells, i + 1, "m")), left(text_of(cells, i + 2, "p"))))
            near = F.lower(F.concat(before, F.lit(" "), after)).rlike(_context(kind))
            score = F.least(F.lit(kind.prior) + F.when(near, BONUS).otherwise(0), F.lit(100))
            good = valid(kind.name, x["m"])
            if not kind.base:
                good = good & (score >= LEAST_SCORE)
            made = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), (score / 100).cast("double").alias("score"))
            return F.when(x["m"].isNotNull() & good, made)

        starts = running(F.transform(cells, size), lambda a, v: a + v)
        return F.array_compact(once(starts, lambda at: F.transform(cells, lambda x, i: span(x, i, F.get(at, i)))))

    return F.when(text.rlike(kind.gate), once(cut, all_spans)).otherwise(F.array()).cast(_SPAN)


def _context(kind: Kind) -> str:
    """A pattern of words that begin with one of the context words."""
    return "(^|[^a-z])(" + "|".join(kind.words) + ")"


def find_pii(df: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``df`` with an array of (kind, start, end, score) spans, by kind as listed, then start.

    A null or empty text has none; an empty table gives no rows; equal rows get equal spans, long
    texts are read whole. Positions are code points, the end exclusive. A score is the kind's own,
    raised where a context word begins within ``CONTEXT`` code points on either side. All other
    columns stay; a column that is already called ``out_col`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(out_col, F.concat(*[spans_of(k, text) for k in KINDS]))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``df`` with each span replaced by its kind in brackets; of overlapping spans the first
    (and of those that start together the longest) names the replaced stretch. Null stays null."""
    text = F.col(text_col)
    order = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["kind"].alias("k"))))
    end = F.array_max(F.transform(spans_col, lambda s: s["end"]))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def between(held: Column, a: Column, b: Column) -> Column:
        """Code points a to b of the text in blocks."""
        piece = lambda k: F.substring(F.get(held, k), F.greatest(a - k * BLOCK, F.lit(0)) + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - F.greatest(a - k * BLOCK, F.lit(0)))
        return F.when(a < b, F.array_join(F.transform(F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")), piece), "")).otherwise("")

    def pieces(held: Column, spans: Column) -> Column:
        # Where the text goes on before each span: behind all spans before it.
        ends = running(F.transform(spans, lambda s: -s["b"]), lambda a, v: F.greatest(a, v))
        named = lambda s, at: F.when(s["a"] >= at, F.concat(between(held, at, s["a"]), F.lit("["), s["k"], F.lit("]"))).otherwise("")
        return F.concat(F.zip_with(spans, ends, named), F.array(between(held, end, F.length(text))))

    built = once(blocks, lambda held: once(order, lambda spans: F.array_join(pieces(held, spans), "")))
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, built).otherwise(text))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, and their scores in hundredths."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("pii", lambda s: F.round(100 * s["score"]).cast("int").cast("string")), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*[k.name for k in KINDS if k.base]))
    return found.select("doc_id", *[count(k.name) for k in KINDS if k.base], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), scores.alias("scores"))


def _kind_sql(rank: int, kind: Kind) -> str:
    """Spans of one kind in SQL, from the plain pattern."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+"}.get(kind.name, kind.pattern)
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = "list_sum([case when i % 2 = 0 then case when 2 * c::int > 9 then 2 * c::int - 9 else 2 * c::int end else c::int end for c, i in list_reverse(string_split(d, ''))]) % 10 = 0"
    check = {
        "ip": "len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 or len(ltrim(x, '0')) = 3 and ltrim(x, '0') > '255')) = 0",
        "card": f"len(d) between 13 and 19 and {luhn}",
        "phone": "len(d) between 9 and 15",
        "iban": "len(code) between 15 and 34 and list_reduce(list_prepend(0, [case when c <= '9' then c::int else 100 + ascii(c) - 55 end for c in string_split(code[5:] || code[1:4], '')]), lambda a, x: case when x >= 100 then (a * 100 + x - 100) % 97 else (a * 10 + x) % 97 end) = 1",
    }.get(kind.name, "true")
    least = "true" if kind.base else f"score >= {LEAST_SCORE}"
    before = f"right(right(coalesce(p[i - 1], ''), {CONTEXT}) || right(coalesce(ms[i - 1], ''), {CONTEXT}) || right(p[i], {CONTEXT}), {CONTEXT})"
    after = f"left(left(coalesce(p[i + 1], ''), {CONTEXT}) || left(coalesce(ms[i + 1], ''), {CONTEXT}) || left(coalesce(p[i + 2], ''), {CONTEXT}), {CONTEXT})"
    score = f"least({kind.prior} + case when regexp_matches(lower({before} || ' ' || {after}), '{_context(kind)}') then {BONUS} else 0 end, 100)"
    return rf"""
    select row, {rank} as rank, '{kind.name}' as kind, s, s + len(m) as e, score from (
      select row, m, {digits} as d, replace(m, ' ', '') as code, {score} as score, list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) as s
      from (select row, p, ms, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m from (
        select row, string_split_regex(text, '{plain}') as p, regexp_extract_all(text, '{plain}') as ms from docs where regexp_matches(text, '{plain}')))
    ) where {check} and {least}"""


OP10_SQL = (
    "with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents), spans as ("
    + "\n union all ".join(_kind_sql(i, k) for i, k in enumerate(KINDS))
    + """
), listed as (
  select row, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
         string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by rank, s) filter (rank < 4) as base, string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by rank, s) as spans,
         string_agg(score::varchar, ',' order by rank, s) as scores
  from spans group by row
)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores
from docs left join listed using (row)"""
)
