"""Operator 3: mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import durable, join_counted, table

SEED = "mix-1"
#: Steps that the order statistic is counted in before the one with the cut is ranked row by row.
STEPS = 16384


def _measure(text: Column) -> Column:
    """A document's inclusion weight: the binary digits of its length in characters; 0 if null or empty."""
    n = F.length(text).cast("bigint")
    return F.when(n > 0, F.length(F.bin(n)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _prepared(docs: DataFrame, seed: str) -> DataFrame:
    """docs with __key (the source, a null one apart from all strings), __x and the uniform draw __u."""
    source = docs["source"].cast("string")
    draw = F.md5(F.concat_ws("|", F.lit(seed), docs["doc_id"].cast("string")).cast("binary"))
    u = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return docs.withColumns({"__key": F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)), "__x": _measure(docs["text"]), "__u": u})


def _quotas(base: DataFrame, total: int | None, weights: dict[str | None, int] | None) -> DataFrame:
    """By source: __n, the copies it gets, and __sum, the sum of its weights."""
    per = base.where("__x > 0").groupBy("__key").agg(F.count("*").alias("__docs"), F.sum("__x").alias("__sum"))
    if weights is None:
        w = F.floor(F.sqrt(F.col("__docs").cast("double")) * 16).cast("bigint")
    else:
        known = [F.when(F.col("__key") == ("-" if s is None else "+" + s), int(v)) for s, v in weights.items()]
        w = F.coalesce(*known, F.lit(0)).cast("bigint")
    per = durable(per.withColumn("__w", w))
    everything = per.agg(F.sum("__docs").alias("n"), F.sum("__w").alias("w")).first()
    n = everything.n if total is None else total
    if not n or not everything.w:
        return per.select("__key", F.lit(0).cast("bigint").alias("__n"), "__sum")
    share = F.col("__w").cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)")
    per = per.withColumns({"__floor": F.floor(share / F.lit(everything.w)).cast("bigint")})
    per = per.withColumn("__rest", (share - F.col("__floor").cast("decimal(19,0)") * F.lit(everything.w).cast("decimal(19,0)")).cast("decimal(38,0)"))
    left = F.lit(n) - F.sum("__floor").over(Window.partitionBy())
    more = F.row_number().over(Window.orderBy(F.desc("__rest"), "__key")) <= left
    return per.select("__key", (F.col("__floor") + more.cast("bigint")).alias("__n"), "__sum")


def _drawn(rows: DataFrame) -> DataFrame:
    """Adds __whole, the certain copies, and __q, the random odds over the inclusion odds (null where no part is left)."""
    rows = rows.withColumns({"__whole": F.expr("__n * __x div __sum"), "__part": F.expr("(__n * __x) % __sum")})
    p = F.col("__part").cast("double") / F.col("__sum").cast("double")
    q = (F.col("__u") / (1.0 - F.col("__u"))) / (p / (1.0 - p))
    return rows.withColumn("__q", F.when(F.col("__part") > 0, q))


def mix(docs: DataFrame, total: int | None = None, weights: dict[str | None, int] | None = None, seed: str = SEED) -> DataFrame:
    """docs with the column __copies: how often each row is in the mixture (0 for not at all).

    Sources share `total` copies (as many as there are documents unless given) by largest remainders:
    in proportion to `weights`, whole numbers by source, or else to the square root of their document
    counts. In a source with n copies, a document of weight x has the expectation n*x/sum(x). Its whole
    part is certain; for the rest p the documents are ranked by (u/(1-u)) / (p/(1-p)), u uniform from
    doc_id and seed, and as many of the first are taken as bring the source to n exactly.

    A document's weight x is the number of binary digits of its length, so that null and empty texts
    are never taken. A null source is a source of its own. A null doc_id draws like any other id. Rows
    that repeat a doc_id share its draw: ties are broken by id and weight, and rows that agree with the
    row at the cut in all of these are in together, only then a source can get more than n. A source
    without a weight gets nothing. An empty table gives an empty one. Other columns are carried along,
    whatever their names; one named __copies gives way to the result's.

    The cut is found from counts by STEPS of the order statistic and a ranking of the rows in one step,
    so that no task has to sort a source; what is broadcast has a row for each source, and is counted.
    """
    names = [c for c in docs.columns if c.lower() != "__copies"]
    plain = docs.select(*[docs[f"`{c}`"].alias(f"__c{i}") for i, c in enumerate(names)], docs["doc_id"], docs["source"], docs["text"])
    prepared = _prepared(plain, seed)
    base = durable(prepared.select("__key", F.col("doc_id").cast("bigint").alias("__id"), "__x", "__u"))
    quotas = durable(_quotas(base, total, weights))
    step = F.floor(F.col("__q") / (1.0 + F.col("__q")) * STEPS).cast("int")
    drawn = _drawn(join_counted(base.where("__x > 0"), quotas, "__key")).withColumn("__step", step)
    steps = drawn.groupBy("__key", "__step").agg(F.count("__q").alias("c"), F.sum("__whole").alias("whole"), F.first("__n").alias("n"))
    by_key = Window.partitionBy("__key")
    steps = steps.withColumns({"need": F.col("n") - F.sum("whole").over(by_key), "upto": F.sum("c").over(by_key.orderBy(F.col("__step").asc_nulls_first()))})
    at = durable(steps.where("need > 0 AND c > 0 AND upto >= need AND upto - c < need").select("__key", F.col("__step").alias("__cut_step"), (F.col("need") - F.col("upto") + F.col("c")).alias("__nth")))
    near = join_counted(drawn, at, "__key").where("__step = __cut_step")
    nth = F.row_number().over(by_key.orderBy("__q", F.col("__id").asc_nulls_first(), "__x"))
    cut = near.withColumn("__rank", nth).where("__rank = __nth").select("__key", F.col("__q").alias("__cut_q"), F.col("__id").alias("__cut_id"), F.col("__x").alias("__cut_x"), F.lit(True).alias("__has_cut"))
    limits = durable(quotas.join(cut, "__key", "left"))
    final = _drawn(join_counted(prepared, limits, "__key", "left"))
    order = "coalesce(cast(doc_id as bigint), -9223372036854775808)"
    cut_order = "coalesce(__cut_id, -9223372036854775808)"
    drawn_in = F.expr(f"__has_cut AND __q IS NOT NULL AND (__q < __cut_q OR (__q = __cut_q AND ({order} < {cut_order} OR ({order} = {cut_order} AND __x <= __cut_x))))")
    copies = F.when(F.col("__x") > 0, F.coalesce("__whole", F.lit(0)) + F.coalesce(drawn_in, F.lit(False)).cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    return final.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], copies.alias("__copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mixture itself: every row of docs as often as it has copies, with the columns of docs."""
    inner = [f"__m{i}" for i in range(len(docs.columns))]
    apart = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, inner)], docs["doc_id"], docs["source"], docs["text"])
    rows = mix(apart).where("__copies > 0")
    return rows.select(*inner, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).select(*inner).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).where("__copies > 0").select("doc_id", "source", F.col("__copies").alias("copies"))


SQL = f"""
with base as (
  select doc_id, source, case when source is null then '-' else '+' || source end as k,
    case when length(text) > 0 then cast(length(bin(cast(length(text) as bigint))) as bigint) else 0 end as x,
    (cast(('0x' || substr(md5('{SEED}|' || cast(doc_id as varchar)), 1, 13))::bigint as double) + 0.5) / 4503599627370496.0::double as u
  from documents),
per as (
  select k, sum(x)::bigint as sx, floor(sqrt(count(*)::double) * 16)::bigint as w, count(*)::bigint as n_docs
  from base where x > 0 group by k),
al as (select sum(n_docs)::bigint as n, sum(w)::bigint as w_all from per),
fl as (select k, sx, (w::hugeint * n) // w_all as f, (w::hugeint * n) % w_all as rest, n from per cross join al),
quota as (
  select k, sx, (f + case when row_number() over (order by rest desc, k) <= n - sum(f) over () then 1 else 0 end)::bigint as n
  from fl),
part as (
  select doc_id, source, b.k, x, (n * x) // sx as whole, (n * x) % sx as p, sx, n, u
  from base b join quota q on b.k = q.k where x > 0),
drawn as (
  select *, case when p > 0 then (u / (1.0::double - u)) / ((p::double / sx::double) / (1.0::double - p::double / sx::double)) end as q from part),
need as (select k, max(n) - sum(whole) as m from part group by k),
ranked as (
  select d.*, m, case when q is not null then row_number() over (partition by d.k, q is null order by q, doc_id, x) end as r
  from drawn d join need on d.k = need.k)
select doc_id, source, (whole + case when r <= m then 1 else 0 end)::bigint as copies
from ranked where whole + case when r <= m then 1 else 0 end > 0
"""
