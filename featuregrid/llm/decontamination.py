"""Benchmark decontamination over a positional inverted index, DataFrame operations only.

The corpus is normalised once to blank-separated words. Document frequencies of the
benchmark's terms come from all of it. For each benchmark window the rarest terms become its
anchors, and the index stores the postings (term, row, position) of every anchor term in every
text. Offset-adjusted lists meet by grouping postings on (row, item) and a slot of neighbouring
shifts (position - offset). Groups with fewer postings than a window has anchors go at once. In the
rest, a window whose anchors all stand in one slot is a proximity match, and one whose anchors
stand at the same shift is a candidate, whose words are compared with those of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Workspace, broadcast_if_small, join_by_key, table

#: Words of a window, anchors of each window, and the slop of a proximity match in words.
WINDOW, ANCHORS, SLOP = 13, 3, 8
#: Benchmark-side tables are broadcast up to so many rows and shuffled beyond.
BROADCAST_ROWS = 200_000

#: All ASCII characters that are not letters or digits separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """Words of a text, A-Z lowered, with single blanks between; null gives an empty string."""
    return F.trim(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " "), UPPER, LOWER))


def word_list(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _phrase(words: Column, start: Column, width: Column) -> Column:
    """``width`` words from ``start``, read one by one: a slice would copy the whole list each time."""
    return F.array_join(F.transform(F.sequence(start, start + width - 1), lambda i: F.get(words, i)), " ")


def benchmark_items(bench: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, item_id, words, width``: one row for each item with words."""
    items = bench.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("string").alias("item_id"), word_list(normalised(F.col(text_col))).alias("words")).where(F.size("words") > 0)
    return items.withColumn("width", F.least(F.size("words"), F.lit(window)))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """``item, width, start, phrase``: the first place of each different window of an item."""
    phrases = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("width")), lambda s: _phrase(F.col("words"), s, F.col("width")))
    windows = items.select("item", "width", F.posexplode(phrases).alias("start", "phrase"))
    return windows.groupBy("item", "width", "phrase").agg(F.min("start").alias("start"))


def _term(word: Column) -> Column:
    return F.xxhash64(word)


def contamination(docs: DataFrame, bench: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_words, n_hit, items, near_items``.

    n_hit counts the words inside occurrences of benchmark windows; items holds the sorted
    ids (as strings) of items with occurring windows, near_items those with a window whose anchors
    meet within about ``SLOP`` words of their places (exact matches are among them). A null or empty
    text has no words and no hits; rows are kept apart even if they repeat or have null ids; items
    with null or empty text have no windows, and items with a null id give hits but no id. Empty
    tables give empty results. Columns other than the named ones are not read. Time grows in
    proportion to the words of texts and items and to the places where anchors stand.
    """
    corpus = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("words"))
    corpus = corpus.select(F.monotonically_increasing_id().alias("row"), "id", F.size(word_list(F.col("words"))).cast("long").alias("n_words"), "words")
    corpus = work.save(corpus)
    items = work.save(benchmark_items(bench, item_id_col, item_text_col, window))
    phrases = work.save(benchmark_windows(items))

    # Frequencies of benchmark terms over all texts.
    vocabulary = items.select(F.explode("words").alias("word")).select(_term(F.col("word")).alias("term")).distinct()
    vocabulary = work.save(vocabulary)
    tokens = corpus.where("n_words > 0").select("row", F.posexplode(F.split("words", " ")).alias("position", "word")).select("row", "position", _term(F.col("word")).alias("term"))
    if vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        counts = tokens.select("term").join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))
    else:  # counted before they are joined, so a frequent term is one row
        counts = tokens.groupBy("term").agg(F.count("*").alias("df")).join(vocabulary, "term")
    counts = work.save(counts)

    # The rarest terms of each window; a window with a term that no text has cannot occur.
    places = items.select("item", F.posexplode("words").alias("place", "word")).select("item", "place", _term(F.col("word")).alias("term"))
    places = places.join(broadcast_if_small(counts, BROADCAST_ROWS), "term")
    inside = phrases.select("item", "width", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("place")).join(places, ["item", "place"])
    ranked = inside.groupBy("item", "width", "start").agg(F.sort_array(F.collect_list(F.struct("df", "place", "term"))).alias("terms")).where(F.size("terms") == F.col("width"))
    anchors = ranked.select("item", "start", F.explode(F.slice("terms", 1, ANCHORS)).alias("a"))
    anchors = work.save(anchors.select("item", "start", "a.place", "a.term", "a.df"))
    need = F.least(F.col("width"), F.lit(ANCHORS))
    needs = items.select("item", need.alias("need"))

    # The index: postings of the anchor terms in all texts, joined to the places of the items.
    sites = work.save(anchors.select("item", "place", "term", "df").distinct())
    terms = sites.select("term", "df").distinct()
    postings = work.save(join_by_key(tokens, terms, "term", "df", BROADCAST_ROWS).drop("df"))
    met = join_by_key(postings, sites, "term", "df", BROADCAST_ROWS).select("row", "item", (F.col("position") - F.col("place")).alias("shift"), "place")

    # Offset-adjusted lists meet where a slot of neighbouring shifts has as many postings as a window has anchors.
    base = F.floor(F.col("shift") / SLOP).cast("int")
    slotted = met.withColumn("slot", F.explode(F.array(base, base + 1)))
    full = slotted.groupBy("row", "item", "slot").agg(F.count("*").alias("n")).join(broadcast_if_small(needs, BROADCAST_ROWS), "item").where("n >= need").select("row", "item", "slot", "need")
    full = work.save(full)
    lists = slotted.join(broadcast_if_small(full, BROADCAST_ROWS), ["row", "item", "slot"])
    lists = work.save(lists.join(broadcast_if_small(anchors.select("item", "place", "start"), BROADCAST_ROWS), ["item", "place"]))
    near = lists.groupBy("row", "item", "slot", "start").agg(F.count_distinct("place").alias("n"), F.first("need").alias("need")).where("n = need").select("row", "item").distinct()
    # A window's anchors at one shift fall into both slots of that shift; one of them counts.
    exact = lists.where(F.col("slot") == base).groupBy("row", "item", "shift", "start").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    exact = exact.select("row", "item", "start", (F.col("shift") + F.col("start")).alias("at")).where("at >= 0")

    # Exact phrases: the words at the candidate places of a text, read once for each row, against the windows.
    candidates = work.save(exact.join(broadcast_if_small(phrases, BROADCAST_ROWS), ["item", "start"]).select("row", "item", "at", "width", "phrase"))
    spots = work.save(candidates.select("row", "at", "width").distinct().groupBy("row").agg(F.collect_list(F.struct("at", "width")).alias("spots")))
    texts = corpus.select("row", "words").join(broadcast_if_small(spots, BROADCAST_ROWS), "row")
    held = F.transform(F.array(F.split("words", " ")), lambda words: F.transform("spots", lambda s: F.struct(s["at"].alias("at"), s["width"].alias("width"), _phrase(words, s["at"], s["width"]).alias("phrase"))))
    read = texts.select("row", F.explode(F.get(held, F.lit(0))).alias("r")).select("row", "r.*")
    found = work.save(candidates.join(read, ["row", "at", "width", "phrase"]).select("row", "item", "at", "width"))

    names = broadcast_if_small(items.select("item", "item_id"), BROADCAST_ROWS)
    spans = found.select("row", F.struct(F.col("at").alias("a"), (F.col("at") + F.col("width")).alias("b")).alias("span")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    # Words under a union of spans, sorted by start: each adds what lies beyond the end so far.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")),
        lambda acc: acc["n"],
    )
    hits = spans.select("row", covered.alias("n_hit"))
    named = lambda rows, out: rows.select("row", "item").distinct().join(names, "item").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias(out))
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    out = corpus.select("row", "id", "n_words")
    for part in (hits, named(found, "items"), named(near, "near_items")):
        out = out.join(broadcast_if_small(work.save(part), BROADCAST_ROWS), "row", "left")
    out = out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
    out = work.save(out)
    work.drop_others(out)
    return out


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document, and the verdict."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "decontamination"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )


OP6_SQL = r"""
with docs as (
  select row_number() over () as row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), items as (
  select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark
), windows as (
  select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as phrase
  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s from items where len(w) > 0)
), grams as (
  select row, s, n, array_to_string(w[s:s + n - 1], ' ') as phrase
  from (select row, w, n, unnest(range(1, len(w) - n + 2)) as s from docs, (select distinct n from windows) where len(w) >= n)
), found as (
  select row, s, g.n, item_id from grams g join windows using (phrase)
), terms as (
  select item_id, w, n, unnest(range(1, len(w) + 1)) as place, unnest(w) as term from (select row_number() over () as item_id, w, least(13, len(w)) as n from items where len(w) > 0)
), tokens as (select row, unnest(range(1, len(w) + 1)) as pos, unnest(w) as term from docs
), df as (select term, count(*) as df from tokens join (select distinct term from terms) using (term) group by term
), starts as (
  select item_id, n, min(s) as s from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as s from (select distinct item_id, w, n from terms)) group by item_id, n, array_to_string(w[s:s + n - 1], ' ')
), anchors as (
  select item_id, s, n, place, term from (
    select item_id, s, st.n, place, term, df, row_number() over (partition by item_id, s order by df nulls last, place) as k, count(df) over (partition by item_id, s) as there
    from starts st join terms t using (item_id) left join df using (term) where place between s and s + st.n - 1)
  where k <= 3 and there = n
), slots as (
  select row, item_id, s, n, place, floor((pos - place) / 8.0) + unnest([0, 1]) as slot from tokens join anchors using (term)
), near as (
  select row, count(distinct ids) as n_near from (select distinct row, item_id from (select row, item_id from slots group by row, item_id, s, n, slot having count(distinct place) = least(3, n))) join (select row_number() over () as item_id, item_id as ids from items where len(w) > 0) using (item_id) group by row
), hits as (
  select row, count(distinct p) as n_hit from (select row, unnest(range(s, s + n)) as p from (select distinct row, s, n from found)) group by row
), named as (
  select row, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from found group by row
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
       cast(coalesce(n_near, 0) as bigint) as n_near_items
from docs left join hits using (row) left join named using (row) left join near using (row)
"""
