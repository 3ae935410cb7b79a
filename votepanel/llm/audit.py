"""Filter interaction audit: what each of five text filters removes, alone and after others, in every order.

The filters (a row fails when the condition holds; words are the maximal runs ``[^\\x20\\x09-\\x0D]+``, case-sensitive): A under 100 words;
B ``100 * distinct words < 80 * words``; C ``100 * [A-Z] characters > 10 * code points``; D holds any of ``#$%&*|``; E the text is
identical to the text of a smaller doc_id, table-wide, removed or not.

Hart-Mas-Colell potential. Per part (language) the removal game gives every coalition S of filters the number v(S) of rows that fail a member.
Its potential is computed recursively over the 32 coalitions, ``|S| * P(S) = v(S) + sum of P(S without i)``, from P(empty) = 0; the Shapley value of
filter i is ``P(all) - P(all without i)``. 60 P(S) is a whole number (a dividend of a coalition is divided by 1..5), so everything stays
exact in integers, and 120 times the Shapley value is the filter's removals summed over all orders. Differences of coalitions give the
steps of an order: what the filter at step k removes is ``v(first k) - v(first k-1)``; the same game over the rows
labelled good or toxic gives ``good_lost`` and ``toxic_lost``.

Distribution. One pass over the texts leaves a digest (SHA-256), four bits and the ids; partial counts collapse copies before anything is
shuffled by the digest, so a text that a third of all rows share is at most four rows a language there. From there on there are at most 32
counts a part. The games are columns of one row a part; nothing is collected.

Defined results: null or non-string text is empty or cast; null language is the empty name; a row without doc_id is never E and makes
no other row E, and has no label; rows that repeat a doc_id are rows of their own, and of the smallest id of a text none is E;
a doc_id with several labels is good (toxic) if one of them says so; labels of unknown documents are ignored; other columns are
ignored; an empty table has no part and no row.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
DUPLICATE = 1 << FILTERS.index("E")
#: 60 is divisible by every coalition size; 120 orders are twice that.
SCALE, ORDERS = 60, ["".join(p) for p in permutations(FILTERS)]
SPACES = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters A-D that the text fails."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words).cast("long")
    failed = [
        n < 100,
        100 * F.size(F.array_distinct(words)) < 80 * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 10 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))


def fail_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: rows of every part per set of failed filters, and how many of them are labelled good or toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    flags = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id is not null")
    flags = flags.groupBy("id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    rows = rows.join(flags, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    same = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low"))
    # of the smallest id of a text all rows are originals, and so are rows without an id
    first = F.col("low.id") == F.min("low.id").over(Window.partitionBy("digest"))
    original = F.col("nameless") + F.when(first, F.col("low.n")).otherwise(0)
    parts = same.select("part", "mask", "good", "toxic", "n", F.coalesce(original, F.col("nameless")).alias("original"))
    kinds = F.array(F.struct(F.col("mask"), F.col("original").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(DUPLICATE)).alias("mask"), (F.col("n") - F.col("original")).alias("n")))
    counts = parts.select("part", "good", "toxic", F.explode(kinds).alias("k")).select("part", "good", "toxic", "k.*")
    return counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def _game(name: str) -> Column:
    """v(S) for S = 0..31 from the counts per mask: rows that fail a member of S."""
    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda s: F.aggregate("counts", F.lit(0).cast("long"), lambda total, k: total + F.when(k["mask"].bitwiseAND(s) != 0, k[name]).otherwise(0)))


def _potential(game: Column) -> Column:
    """SCALE * P(S) for S = 0..31; every S without one member is a smaller number, so it is there already."""

    def grow(known: Column, s: Column) -> Column:
        smaller = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s - (1 << i))).otherwise(0) for i in range(len(FILTERS))]
        return F.array_append(known, F.call_function("div", sum(smaller, SCALE * F.get(game, s)), F.bit_count(s)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), grow)


def _bits(letters: Column) -> Column:
    return sum((F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))


def filter_games(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: ``rows``, the games ``removed``, ``good`` and ``toxic`` over 32 coalitions, and the ``potential`` (times SCALE)."""
    counts = fail_counts(docs, labels).groupBy("part").agg(F.sum("n").alias("rows"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 32 entries
    games = counts.select("part", "rows", _game("n").alias("removed"), _game("good").alias("good"), _game("toxic").alias("toxic"))
    return games.withColumn("potential", _potential(F.col("removed")))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost`` and ``shapley`` (summed over the orders)."""
    steps = filter_games(docs, labels).withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumns({"upto": _bits(F.substring("filter_order", F.lit(1), F.col("step"))), "before": _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    steps = steps.withColumn("own", F.col("upto") - F.col("before")).withColumn("rest", F.lit(ALL) - F.col("own"))

    def lost(game: str) -> Column:
        return F.get(game, "upto") - F.get(game, "before")

    return steps.select(
        "part", "filter_order", "step", (F.col("rows") - F.get("removed", "upto")).alias("kept"), lost("removed").alias("removed"), (F.get("removed", "own") - lost("removed")).alias("redundant"),
        (F.get("removed", F.lit(ALL)) - F.get("removed", "rest")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        (len(ORDERS) // SCALE * (F.get("potential", F.lit(ALL)) - F.get("potential", "rest"))).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters over the whole ``documents`` table."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_ROW_BITS = reduce(lambda a, b: f"{a} + {b}", (f"(case when {c} then {1 << i} else 0 end)" for i, c in enumerate((
    "len(w) < 100", "100 * len(list_distinct(w)) < 80 * len(w)", "100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t)", "regexp_matches(t, '[#$%&*|]')", "doc_id > min(doc_id) over (partition by t)"))))

#: Plain counting of every order, step by step, without games or potentials.
ORACLE = f"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') as w from documents),
rows as (select doc_id, part, {_ROW_BITS} as mask from texts),
flagged as (select r.part, r.mask, exists (select 1 from labels l where l.doc_id = r.doc_id and l.quality = 1) as good, exists (select 1 from labels l where l.doc_id = r.doc_id and l.toxic = 1) as toxic from rows r),
counts as (select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from flagged group by part, mask),
f(x, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from f a, f b, f c, f d, f e where a.b + b.b + c.b + d.b + e.b = 31 and a.b | b.b | c.b | d.b | e.b = 31),
steps as (select filter_order, s.step, bits[s.step] as own, list_sum(bits[1:s.step - 1]) as earlier from orders, (select unnest([1, 2, 3, 4, 5]) as step) s),
audit as (select part, filter_order, step, own,
  sum(case when mask & (own | coalesce(earlier, 0)::bigint) = 0 then n else 0 end) as kept,
  sum(case when mask & own <> 0 and mask & coalesce(earlier, 0)::bigint = 0 then n else 0 end) as removed,
  sum(case when mask & own <> 0 and mask & coalesce(earlier, 0)::bigint <> 0 then n else 0 end) as redundant,
  sum(case when mask = own then n else 0 end) as unique_fails,
  sum(case when mask & own <> 0 and mask & coalesce(earlier, 0)::bigint = 0 then good else 0 end) as good_lost,
  sum(case when mask & own <> 0 and mask & coalesce(earlier, 0)::bigint = 0 then toxic else 0 end) as toxic_lost
  from counts, steps group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley from audit
"""
