"""How filters interact: what each would remove in every order of application.

A document that is tested by filter f after the filters of a set S is on the edge (S, f) of the lattice
of subsets; five filters have 80 edges. Documents are first counted by the filters they fail, then
those counts are added up on the edges, and each step of each order is one of the edges: 600 steps are
joined with the edges' sums, whatever the number of documents.

The last filter asks for an equal text under a smaller doc_id. Equal texts meet by digest: rows of one
text are summed before they are shuffled, so neither a text that a third of all rows share nor an
empty one gathers in a task.

Defined cases: null texts are empty, and equal to empty ones; a null language is the part ''; a row
without a doc_id is no copy of another and none is a copy of it; rows of one doc_id and text are no
copies of each other; a doc_id that labels name repeatedly is good (toxic) if one of the rows says so;
rows without a label are neither; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.shared import WHITE_CLASS

FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """A bit for each of the filters A to D that the text fails: short, repetitive, capitals, symbols."""
    words = F.array_remove(F.split(text, f"{WHITE_CLASS}+"), "")
    tests = (
        lambda w: F.size(w) < 200,
        lambda w: 100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
        lambda w: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        lambda w: text.rlike("[#$%&*|]"),
    )
    bits = F.transform(F.array(words), lambda w: sum((F.when(t(w), 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)))
    return bits[0]


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by the filters they fail and their labels."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), failures(text).alias("fails"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    d = d.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ("digest", "part", "fails", "good", "toxic")
    by_id = d.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("bare"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a text has a row for each language and label
    at_first = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    counted = by_text.withColumn("first", first).select("part", "fails", "good", "toxic", "n", (at_first + F.col("bare")).alias("own"))
    either = F.explode(F.array(F.struct(F.col("fails"), F.col("own").alias("n")), F.struct((F.col("fails") + _COPY).alias("fails"), (F.col("n") - F.col("own")).alias("n"))))
    told = counted.select("part", "good", "toxic", either.alias("x")).where("x.n > 0")
    return told.groupBy("part", F.col("x.fails").alias("fails"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def edges(found: DataFrame) -> DataFrame:
    """What every edge (done, filter) of the lattice keeps, removes and loses, for each part."""
    n = len(FILTERS)
    all_edges = F.array(*[F.struct(F.lit(s).alias("done"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for f in range(n) for s in range(1 << n) if not s >> f & 1])
    at = found.select("*", F.explode(all_edges).alias("e")).select("*", "e.*")
    fails, before = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(F.col("done")) != 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return at.groupBy("part", "done", "filter").agg(
        count(~fails & ~before).alias("kept"),
        count(fails & ~before).alias("removed"),
        count(fails & before).alias("redundant"),
        count(F.col("fails") == F.col("bit")).alias("unique_fails"),
        count(fails & ~before & F.col("good")).alias("good_lost"),
        count(fails & ~before & F.col("toxic")).alias("toxic_lost"),
    )


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, filters done before, filter) of every step of every order: paths of the lattice."""
    every = ["".join(p) for p in permutations(FILTERS)]
    return [(p, k + 1, sum(1 << FILTERS.index(c) for c in p[:k]), FILTERS.index(p[k])) for p in every for k in range(len(p))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, done int, filter int")
    paths = edges(verdicts(docs, labels)).join(F.broadcast(steps), ["done", "filter"])  # always 600 rows
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return paths.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
    with recursive o as (
      select '' as p union all select p || c from o, unnest(['A', 'B', 'C', 'D', 'E']) as u(c) where not contains(p, c)
    ), steps as (
      select p as filter_order, cast(k as integer) as step, p[k] as f, p[:k - 1] as before from (select p, unnest(range(1, 6)) as k from o where length(p) = 5)
    ), l as (
      select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels where doc_id is not null group by 1
    ), d as (
      select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by coalesce(text, '')) as first from documents
    ), v as (
      select d.part, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic,
        case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
        || case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
        || case when doc_id > first then 'E' else '' end as fails
      from d left join l using (doc_id)
    ), g as (
      select part, fails, good, toxic, count(*) as n from v group by all
    ), s as (
      select part, filter_order, step, f, contains(fails, f) as hit, length(translate(fails, before, '')) < length(fails) as gone, fails, good, toxic, n from g, steps
    ), a as (
      select part, filter_order, step, f, sum(case when not hit and not gone then n else 0 end) as kept, sum(case when hit and not gone then n else 0 end) as removed, sum(case when hit and gone then n else 0 end) as redundant,
        sum(case when fails = f then n else 0 end) as unique_fails, sum(case when hit and not gone and good then n else 0 end) as good_lost, sum(case when hit and not gone and toxic then n else 0 end) as toxic_lost
      from s group by all
    )
    select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
      cast(sum(removed) over (partition by part, f) as bigint) as shapley from a
"""
