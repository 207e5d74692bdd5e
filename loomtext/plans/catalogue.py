"""The registered queries over the reference tables, each with the SQL that gives the same rows if SQL can.

All queries run over whole tables. Naive Bayes learns from the labelled documents and scores every
document; nearest neighbours take every vector as a probe among all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import scores as sc
from loomtext.functions import text as tx
from loomtext.functions.labels import CANONICAL, LabelEncoder, label_column
from loomtext.operators import bayes, embeddings, ensemble, features, metrics, rules
from loomtext.operators.knn import KnnModel, distance
from loomtext.operators.models import AdvancedClassifier, BayesClassifier
from loomtext.plans.builder import report
from loomtext.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _round(x: Column | str, places: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, places) + F.lit(0.0)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "FREE").otherwise("SPAM").alias("label"))
    return _docs(spark, d).join(labels, "doc_id")


TOK = r"list_filter(string_split(regexp_replace(lower(text),'[^\p{L}\p{N}]+',' ','g'),' '), lambda x: x<>'')"
STOP = ", ".join(f"'{w}'" for w in features.STOPWORDS)

# --- text ---


@query("normalize_text", r"select doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g')) as norm_md5, length(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'))::bigint as n from documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    norm = tx.normalize_text(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(norm.cast("binary")).alias("norm_md5"), F.length(norm).cast("bigint").alias("n"))


@query("tokenize_counts", f"select doc_id, len({TOK})::bigint as n_tokens, md5(array_to_string({TOK}, ' ')) as tokens_md5 from documents")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = tx.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


_CASED = r"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text,'(\p{Lu})([^\p{Lu}])','\1 \2','g'),'([^\p{Lu}])(\p{Lu})','\1 \2','g'),'[^\p{L}\p{N}]+',' ','g'),' '), lambda x: x<>'')"


@query("tokenize_cased", f"select doc_id, len({_CASED})::bigint as n_tokens, md5(array_to_string({_CASED}, ' ')) as tokens_md5 from documents")
def tokenize_cased(spark: SparkSession, d: str) -> DataFrame:
    t = tx.tokenize(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


@query("decode_named_entities", "select page_id, md5(" + "replace(" * 6 + "html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#x27;', ''''), '&#39;', '''')" + ") as html_md5 from pages")
def decode_named_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(tx.named_entities_once(F.col("html")).cast("binary")).alias("html_md5"))


@query("strip_inline_comments", "select page_id, md5(" + "replace(" * 4 + "translate(html, '＇％／＜＞＝', '''%/<>='), '/**/', ''), '/* */', ''), '--', ' '), '#', ' ')" + ") as html_md5 from pages")
def strip_inline_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(tx.strip_comments(F.col("html")).cast("binary")).alias("html_md5"))


@query("decode_obfuscated_text")
def decode_obfuscated(spark: SparkSession, d: str) -> DataFrame:
    out = tx.decode_obfuscated_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(out.cast("binary")).alias("html_md5"), F.length(out).cast("bigint").alias("n"))


_CANON = ", ".join(f"'{x}'" for x in CANONICAL)


@query("label_canonicalize", f"""
with l as (select event_type as raw from events union all select source from documents union all select o_orderpriority from orders union all select upper(substr(role,1,1)) || role from conversations)
select raw, case when upper(raw) in ({_CANON}) then upper(raw) else raw end as label, count(*)::bigint as n from l where length(raw) > 0 and strlen(raw) <= 64 group by all
""")
def label_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    raw = [table(spark, d, "events").select(F.col("event_type").alias("raw")), table(spark, d, "documents").select("source"), table(spark, d, "orders").select("o_orderpriority"), table(spark, d, "conversations").select(F.concat(F.upper(F.substring("role", 1, 1)), "role"))]
    every = raw[0].union(raw[1]).union(raw[2]).union(raw[3])
    return every.groupBy("raw").agg(F.count("*").alias("n")).select("raw", label_column(F.col("raw")).alias("label"), "n").where("label IS NOT NULL")


# --- features ---

_FREQ = f"""
t as (select doc_id, unnest({TOK}) as tok from documents), n as (select count(*)::double as n from documents),
v as (select tok, count(distinct doc_id) as df from t where tok not in ({STOP}) group by tok),
idf as (select tok, df, ln((n+1)/(df+1))+1 as idf from v cross join n where df >= 1 and df/n <= 0.95)"""


@query("doc_frequency", f"with {_FREQ} select tok as token, df::bigint as df from idf")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return features.fit_tfidf(_docs(spark, d), count=False).vocab.select("token", "df")


@query("tfidf_fit", f"with {_FREQ} select tok as token, (row_number() over (order by tok collate \"C\") - 1)::int as idx, df::bigint as df, round(idf, 6) as idf from idf".replace(' collate "C"', ""))
def tfidf_fit(spark: SparkSession, d: str) -> DataFrame:
    return features.fit_tfidf(_docs(spark, d)).vocab.select("token", "idx", "df", _round("idf").alias("idf"))


def _features(kind: str) -> str:
    w = "(1+ln(tf))*idf" if kind == "tfidf" else "tf::double"
    return f"""with {_FREQ}, c as (select doc_id, tok, count(*) as tf from t group by all),
    w as (select doc_id, c.tok, {w} as w from c join idf on c.tok = idf.tok)
    select doc_id, tok as token, round(w/sqrt(sum(w*w) over (partition by doc_id)), 6) as value from w"""


@query("tfidf_features", _features("tfidf"))
def tfidf_features(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return features.fit_tfidf(docs, count=False).weights(docs).select("doc_id", "token", _round("value").alias("value"))


@query("count_features", _features("count"))
def count_features(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return features.fit_tfidf(docs, count=False).weights(docs, count_only=True).select("doc_id", "token", _round("value").alias("value"))


@query("zscore_features", """
with x as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
s as (select pos, avg(x) as m, greatest(stddev_pop(x), 1e-6) as s from x group by pos)
select vec_id, x.pos::int as pos, round((x - m) / s, 6) + 0.0 as z from x join s on x.pos = s.pos
""")
def zscore_features(spark: SparkSession, d: str) -> DataFrame:
    z = features.zscore(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
    return z.select("vec_id", F.posexplode("vector").alias("pos", "z")).select("vec_id", "pos", _round("z").alias("z"))


@query("row_norms", "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def row_norms(spark: SparkSession, d: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", _round(F.sqrt(square)).alias("norm"))


# --- naive Bayes ---

_NB = f"""
lab as (select doc_id, case when quality = 1 then 'FREE' else 'SPAM' end as label from labels),
tr as (select l.label, unnest({TOK}) as tok from documents d join lab l on d.doc_id = l.doc_id),
te as (select doc_id, tok, count(*) as n from (select doc_id, unnest({TOK}) as tok from documents) group by all),
vs as (select count(distinct tok)::double as v from tr),
dl as (select label, count(*) as docs from documents d join lab using (doc_id) group by label),
tot as (select dl.label, docs, docs / (select sum(docs) from dl) as prior, coalesce(t.n, 0) as total from dl left join (select label, count(*) as n from tr group by label) t on dl.label = t.label),
c as (select label, tok, count(*) as c from tr group by all)"""


def _nb_scores(kind: str) -> str:
    idf = "" if kind == "count" else f""",
    ts as (select d.doc_id, unnest({TOK}) as tok from documents d join lab l on d.doc_id = l.doc_id), nn as (select count(*)::double as n from documents d join lab using (doc_id)),
    idf as (select tok, ln((n+1)/(df+1))+1 as idf from (select tok, count(distinct doc_id) as df from ts where tok not in ({STOP}) group by tok) cross join nn where df/n <= 0.95)"""
    weight, more = ("te.n", "") if kind == "count" else ("te.n * coalesce(idf.idf, 1.0::double)", "left join idf on idf.tok = te.tok")
    return f"""with {_NB}{idf},
    s as (select te.doc_id, tot.label, sum({weight} * ln(greatest((coalesce(c.c, 0) + 1.0::double) / (tot.total + vs.v), 1e-9))) as s
      from te cross join tot cross join vs left join c on c.label = tot.label and c.tok = te.tok {more} group by all),
    l as (select d.doc_id, tot.label, ln(tot.prior) + coalesce(s.s, 0) as s from documents d cross join tot left join s on s.doc_id = d.doc_id and s.label = tot.label),
    p as (select *, exp(s - max(s) over (partition by doc_id)) as e from l)"""


_NB_SELECT = " select doc_id, label, round(s, 4) as log_score, round(e / sum(e) over (partition by doc_id), 6) as score from p"


def _nb_model(spark: SparkSession, d: str, nlp: str = "Count") -> bayes.BayesModel:
    return bayes.train_bayes(_labelled(spark, d), nlp)


def _nb_query(spark: SparkSession, d: str, nlp: str) -> DataFrame:
    logs = _nb_model(spark, d, nlp).log_scores(_docs(spark, d)).withColumn("log_score", F.col("score"))
    return sc.softmax(logs, "doc_id").select("doc_id", "label", _round("log_score", 4).alias("log_score"), _round("score").alias("score"))


@query("bayes_train_counts", f"with {_NB} select label, tok as token, c::bigint as c from c")
def bayes_train_counts(spark: SparkSession, d: str) -> DataFrame:
    return _nb_model(spark, d).counts.select("label", "token", "c")


@query("bayes_priors", f"with {_NB} select label, docs::bigint as docs, round(prior, 6) as prior, total::bigint as total, v::bigint as n_tokens from tot cross join vs")
def bayes_priors(spark: SparkSession, d: str) -> DataFrame:
    m = _nb_model(spark, d)
    return m.labels.select("label", "docs", _round("prior").alias("prior"), "total", F.lit(m.n_tokens).cast("bigint").alias("n_tokens"))


@query("bayes_count_scores", _nb_scores("count") + _NB_SELECT)
def bayes_count_scores(spark: SparkSession, d: str) -> DataFrame:
    return _nb_query(spark, d, "Count")


@query("bayes_tfidf_scores", _nb_scores("tfidf") + _NB_SELECT)
def bayes_tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    return _nb_query(spark, d, "TfIdf")


@query("bayes_explain", _nb_scores("count") + f""",
best as (select doc_id, label from (select *, row_number() over (partition by doc_id order by s desc, label) as r from l) where r = 1),
ts as materialized (select doc_id, {TOK} as ts from documents), e as (select doc_id, unnest(ts) as token, generate_subscripts(ts, 1) - 1 as pos from ts)
select e.doc_id, best.label, pos::int as pos, token, round(ln((coalesce(c.c, 0) + 1.0::double) / (tot.total + vs.v)), 6) as contribution
from e join best on e.doc_id = best.doc_id join tot on tot.label = best.label cross join vs left join c on c.label = best.label and c.tok = e.token
""")
def bayes_explain(spark: SparkSession, d: str) -> DataFrame:
    return _nb_model(spark, d).explain(_docs(spark, d)).select("doc_id", "label", "pos", "token", _round("contribution").alias("contribution"))


# --- nearest neighbours ---


def _pair_sql(metric: str) -> str:
    a, b = "p.e", "c.e"
    return {
        "cosine": f"1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))",
        "euclidean": f"list_distance({a}, {b})",
        "manhattan": f"list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
        "minkowski": f"pow(list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(abs(z[1] - z[2]), 3.0::double))), 1.0::double / 3)",
    }[metric]


def _knn_sql(metric: str, source: str = "select vec_id, label, embedding::double[] as e from embeddings") -> str:
    return f"""with v as ({source}), dd as (select p.vec_id as doc_id, c.vec_id as cid, c.label, round({_pair_sql(metric)}, 12) as dist from v p join v c on true),
    r as (select *, row_number() over (partition by doc_id order by dist, cid) as rn from dd), w as (select doc_id, label, sum(exp(-dist)) as w from r where rn <= 6 group by all),
    s as (select *, exp(w - max(w) over (partition by doc_id)) as e from w)
    select doc_id, label::varchar as label, round(w, 6) as vote, round(e / sum(e) over (partition by doc_id), 6) as score from s"""


_Z = """select x.vec_id, any_value(l.label) as label, list((x - m) / s order by x.pos) as e from
  (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) x
  join (select pos, avg(x) as m, greatest(stddev_pop(x), 1e-6) as s from (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) group by pos) s on x.pos = s.pos
  join embeddings l on l.vec_id = x.vec_id group by x.vec_id"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))


def _knn_query(spark: SparkSession, d: str, metric: str, z: bool = False) -> DataFrame:
    v = _vectors(spark, d)
    v = features.zscore(v) if z else v
    votes = KnnModel(v.withColumnRenamed("doc_id", "train_id"), 6, metric, 3.0).votes(v.select("doc_id", "vector")).withColumn("vote", F.col("score"))
    return sc.softmax(votes, "doc_id").select("doc_id", "label", _round("vote").alias("vote"), _round("score").alias("score"))


for _m in ("cosine", "euclidean", "manhattan", "minkowski"):
    query(f"knn_{_m}", _knn_sql(_m))(lambda spark, d, m=_m: _knn_query(spark, d, m))
query("knn_zscore_euclidean", _knn_sql("euclidean", _Z))(lambda spark, d: _knn_query(spark, d, "euclidean", True))


@query("vector_distances", f"""with c as (select label, list(x order by pos) as e from (select label, pos, avg(x) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) group by all) group by label),
p as (select vec_id, embedding::double[] as e from embeddings)
select vec_id, label, round({_pair_sql('cosine')}, 6) as cosine, round({_pair_sql('euclidean')}, 6) as euclidean, round({_pair_sql('manhattan')}, 6) as manhattan, round({_pair_sql('minkowski')}, 6) as minkowski from p cross join c""")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    each = v.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s")).select("label", F.col("s.x").alias("centre"))
    joined = v.select("vec_id", "embedding").crossJoin(F.broadcast(centres))
    return joined.select("vec_id", "label", *[_round(distance(F.col("embedding"), F.col("centre"), m, 3.0)).alias(m) for m in ("cosine", "euclidean", "manhattan", "minkowski")])


# --- ranking and merging of scores ---


@query("label_ranking", _nb_scores("count") + ", q as (select doc_id, label, e / sum(e) over (partition by doc_id) as s from p), r as (select *, row_number() over (partition by doc_id order by s desc, label) as r from q) select doc_id, r::int as place, label, round(s, 6) as score from r")
def label_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = sc.rank(_nb_model(spark, d).scores(_docs(spark, d)), "doc_id")
    each = ranked.select("doc_id", F.posexplode("labels").alias("at", "l"))
    return each.select("doc_id", (F.col("at") + 1).alias("place"), F.col("l.label").alias("label"), _round(F.col("l.score")).alias("score"))


@query("is_hot_threshold", _nb_scores("count") + ", q as (select doc_id, label, e / sum(e) over (partition by doc_id) as s from p) select doc_id, min_by(label, (-s, label)) as top_label, round(max(s), 6) as top_score, max(s) >= 0.9 as is_hot from q group by doc_id".replace("min_by(label, (-s, label))", "first(label order by s desc, label)"))
def is_hot_threshold(spark: SparkSession, d: str) -> DataFrame:
    labels = F.col("labels")
    ranked = sc.rank(_nb_model(spark, d).scores(_docs(spark, d)), "doc_id")
    return ranked.select("doc_id", sc.top_label(labels).alias("top_label"), _round(sc.top_score(labels)).alias("top_score"), sc.is_hot(labels, 0.9).alias("is_hot"))


@query("softmax_array", "with x as (select o_orderkey, exp(v / 1e5 - max(v / 1e5) over (partition by o_orderkey)) as e, pos from (select l_orderkey as o_orderkey, l_extendedprice as v, l_linenumber as pos from lineitem)) select o_orderkey, pos::int as pos, round(e / sum(e) over (partition by o_orderkey), 6) as p from x")
def softmax_array(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("pos"), (F.col("l_extendedprice") / 1e5).alias("v")))).alias("i"))
    p = items.select("o_orderkey", F.arrays_zip(F.col("i.pos").alias("pos"), sc.softmax_array(F.col("i.v")).alias("p")).alias("z"))
    return p.select("o_orderkey", F.explode("z").alias("z")).select("o_orderkey", F.col("z.pos").cast("int").alias("pos"), _round(F.col("z.p")).alias("p"))


# --- rules ---

RULES = [
    rules.Rule("license", "license or rights line", "(?i)(license|licensed|copyright|all rights reserved)", 35.0, ("BLOCK_LIST", "FREE")),
    rules.Rule("secret", "assigned secret", r"(password|token)\s*=", 60.0, ("MALWARE",)),
    rules.Rule("address", "four numbers with dots", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", 25.0, ("WEB_ATTACK", "ANOMALY")),
    rules.Rule("symbols", "runs of symbols", r"[%&$*#]{3}", 15.0, ("SPAM", "ANOMALY")),
    rules.Rule("plain", "sign of ordinary prose", r"(^|[^a-z])(the|der|que|les) ", -5.0, ("HUMAN",)),
]
_RULES_SQL = "rules as (select * from (values " + ", ".join(f"({i}, '{r.title}', '{r.match_rule}', {r.score}::double)" for i, r in enumerate(RULES)) + ") as r(rule_id, title, pat, score)), " "hit as (select doc_id, rule_id, title, score from documents join rules on regexp_matches(text, pat))"


def _matcher(spark: SparkSession) -> rules.RegexMatcher:
    return rules.RegexMatcher.checked(spark, RULES)


@query("rule_hits", f"with {_RULES_SQL} select doc_id, title, score from hit")
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(_matcher(spark).hits(F.col("text"))).alias("h")).select("doc_id", "h.title", "h.score")


@query("rule_table_join", f"with {_RULES_SQL} select doc_id, rule_id::int as rule_id, score from hit")
def rule_table_join(spark: SparkSession, d: str) -> DataFrame:
    return rules.match_join(_docs(spark, d), rules.rule_table(spark, RULES))


@query("rule_boost", f"with {_RULES_SQL} select d.doc_id, least(100, coalesce(sum(score), 0))::double as boost, count(hit.doc_id)::int as n_hits, coalesce(string_agg(title, ',' order by rule_id), '') as titles from documents d left join hit on hit.doc_id = d.doc_id group by d.doc_id")
def rule_boost(spark: SparkSession, d: str) -> DataFrame:
    hit = _docs(spark, d).select("doc_id", _matcher(spark).hits(F.col("text")).alias("h"))
    return hit.select("doc_id", rules.rule_boost(F.col("h")).alias("boost"), F.size("h").alias("n_hits"), F.array_join(F.transform("h", lambda x: x["title"]), ",").alias("titles"))


_BOOSTED = _nb_scores("count") + f", {_RULES_SQL}, b as (select d.doc_id, least(100, coalesce(sum(score), 0))::double as boost from documents d left join hit on hit.doc_id = d.doc_id group by d.doc_id), q as (select doc_id, label, e / sum(e) over (partition by doc_id) as s from p), m as (select q.doc_id, label, least(1.0::double, s + boost / 100) as s from q join b on q.doc_id = b.doc_id)"


def _boosted(spark: SparkSession, d: str) -> DataFrame:
    return BayesClassifier(_nb_model(spark, d)).classify(_docs(spark, d), True, [_matcher(spark)])


@query("rule_merge_scores", _BOOSTED + " select doc_id, label, round(s, 6) as score from m")
def rule_merge_scores(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d).select("doc_id", F.explode("labels").alias("l")).select("doc_id", "l.label", _round(F.col("l.score")).alias("score"))


@query("rule_hits_off", _nb_scores("count") + f", {_RULES_SQL}, q as (select doc_id, label, e / sum(e) over (partition by doc_id) as s from p), h as (select doc_id, string_agg(title, ',' order by rule_id) as titles from hit group by doc_id) select q.doc_id, label, round(s, 6) as score, coalesce(titles, '') as titles from q left join h on h.doc_id = q.doc_id")
def rule_hits_off(spark: SparkSession, d: str) -> DataFrame:
    rows = BayesClassifier(_nb_model(spark, d)).classify(_docs(spark, d), False, [_matcher(spark)])
    titles = F.array_join(F.transform("extra_hits", lambda h: h["title"]), ",").alias("titles")
    return rows.select("doc_id", titles, F.explode("labels").alias("l")).select("doc_id", "l.label", _round(F.col("l.score")).alias("score"), "titles")


_TITLED = "title || ': ' || case rule_id " + " ".join(f"when {i} then '{r.description}'" for i, r in enumerate(RULES)) + " end"


@query("alert_titles", f"with {_RULES_SQL} select d.doc_id, count(hit.doc_id) > 0 as has_alerts, coalesce(string_agg({_TITLED}, '; ' order by rule_id), '') as titles from documents d left join hit on hit.doc_id = d.doc_id group by d.doc_id")
def alert_titles(spark: SparkSession, d: str) -> DataFrame:
    matcher = rules.AlertMatcher(RULES)
    found = _docs(spark, d).select("doc_id", matcher.alerts(F.col("text")).alias("a"))  # a projection of its own, so that each rule reads a text once
    return found.select("doc_id", (F.size("a") > 0).alias("has_alerts"), F.array_join(matcher.titles(F.col("a")), "; ").alias("titles"))


_ALERTS = "al as (select * from (values " + ", ".join(f"({i}, '{label}')" for i, r in enumerate(RULES) for label in r.target_labels) + ") as a(rule_id, label))"


@query("alert_label_max", f"with {_RULES_SQL}, {_ALERTS} select doc_id, label, max(score) as score from hit join al on al.rule_id = hit.rule_id group by all")
def alert_label_max(spark: SparkSession, d: str) -> DataFrame:
    return rules.AlertMatcher(RULES).classify_labels(_docs(spark, d))


@query("engine_max_merge", _nb_scores("count") + f", {_RULES_SQL}, {_ALERTS}, u as (select doc_id, label, e / sum(e) over (partition by doc_id) as s from p union all select doc_id, label, score from hit join al on al.rule_id = hit.rule_id) select doc_id, label, round(max(s), 6) as score from u group by all")
def engine_max_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    merged = rules.max_merge(_nb_model(spark, d).scores(docs), rules.AlertMatcher(RULES).classify_labels(docs))
    return merged.select("doc_id", "label", _round("score").alias("score"))


@query("report_records", _BOOSTED + f""", n as (select m.doc_id, string_agg(label || ':' || printf('%.2f', s), ',' order by s desc, label) as classify_names_list, max(s) * 100 as top from m group by m.doc_id),
h as (select doc_id, string_agg(title, ',' order by rule_id) as titles from hit group by doc_id)
select d.doc_id::varchar as title_object, d.source as name_file_dataset, d.doc_id::varchar as doc, classify_names_list, round(top, 4) as score_percent, coalesce(titles, '') as match_titles from documents d join n on n.doc_id = d.doc_id left join h on h.doc_id = d.doc_id
""")
def report_records(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_name"))
    rows = report(_boosted(spark, d), names).drop("date_of_occurrence")
    parts = F.split("name_file_dataset", "/")
    return rows.select("title_object", F.get(parts, F.lit(0)).alias("name_file_dataset"), F.get(parts, F.lit(1)).alias("doc"), "classify_names_list", _round("score_percent", 4).alias("score_percent"), "match_titles")


# --- ensembles ---


def _ensemble_sql(kind: str) -> str:
    members = f"with a as (select * from ({_nb_scores('count')} select doc_id, label, e / sum(e) over (partition by doc_id) as s from p)), b as (select * from ({_nb_scores('tfidf')} select doc_id, label, e / sum(e) over (partition by doc_id) as s from p)), k as (select doc_id, 'BLOCK_LIST' as label, least(100, sum(score)) / 100 as s from (with {_RULES_SQL} select * from hit) where score > 0 group by doc_id), u as (select *, 2.0::double / 4 as w from a union all select *, 1.0::double / 4 from b union all select *, 1.0::double / 4 from k), "
    if kind == "average":
        return members + "g as (select doc_id, label, sum(w * s) as s from u group by all) select doc_id, label, round(s / greatest(sum(s) over (partition by doc_id), 1e-9), 6) as score from g"
    return members + "g as (select doc_id, label, sum(w * ln(greatest(s, 1e-9))) as s from u group by all), x as (select *, exp(s - max(s) over (partition by doc_id)) as e from g) select doc_id, label, round(e / sum(e) over (partition by doc_id), 6) as score from x"


def _ensemble(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    docs = _docs(spark, d)
    positive = rules.RegexMatcher([r for r in RULES if r.score > 0])
    hit = docs.select("doc_id", positive.hits(F.col("text")).alias("h")).where(F.size("h") > 0)
    third = hit.select("doc_id", F.lit("BLOCK_LIST").alias("label"), (rules.rule_boost(F.col("h")) / 100).alias("score"))
    weighted = _nb_model(spark, d, "TfIdf")  # its counts are those of the other
    plain = bayes.BayesModel(weighted.labels, weighted.counts, weighted.n_tokens)
    members = [(plain.scores(docs), 2.0), (weighted.scores(docs), 1.0), (third, 1.0)]
    return ensemble.merge(members, strategy).select("doc_id", "label", _round("score").alias("score"))


query("ensemble_weighted", _ensemble_sql("average"))(lambda spark, d: _ensemble(spark, d, "WeightedAverage"))
query("ensemble_product", _ensemble_sql("product"))(lambda spark, d: _ensemble(spark, d, "ProductOfExperts"))

# --- metrics ---

_PAIRS = _nb_scores("count") + ", top as (select doc_id, first(label order by s desc, label) as y_pred from p group by doc_id), pr as (select lab.doc_id, lab.label as y_true, y_pred from lab join top on top.doc_id = lab.doc_id), cls as (select y_true as c from pr union select y_pred from pr), pc as (select c, count(*) filter (y_true = c and y_pred = c) as tp, count(*) filter (y_pred = c) as np, count(*) filter (y_true = c) as nt from cls cross join pr group by c), m as (select c, nt, case when np > 0 then tp / np else 0 end as p, case when nt > 0 then tp / nt else 0 end as r from pc), f as (select *, case when p + r < 1e-9 then 0 else 2 * p * r / (p + r) end as f1 from m)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    scores = _nb_model(spark, d).scores(_docs(spark, d))
    best = sc.rank(scores, "doc_id").select("doc_id", sc.top_label(F.col("labels")).alias("y_pred"))
    return _labelled(spark, d).select("doc_id", F.col("label").alias("y_true")).join(best, "doc_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_round(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("metrics_accuracy", _PAIRS + " select round(avg((y_true = y_pred)::int), 6) as accuracy from pr")
def metrics_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.accuracy(_pairs(spark, d)))


@query("metrics_precision_recall_f1", _PAIRS + " select round(p, 6)::double as precision, round(r, 6)::double as recall, round(f1, 6)::double as f1 from f where c = 'SPAM'")
def metrics_prf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.precision_recall_f1(_pairs(spark, d), "SPAM"))


@query("metrics_macro_f1", _PAIRS + " select round(avg(f1), 6)::double as macro_f1 from f")
def metrics_macro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.macro_f1(_pairs(spark, d)))


@query("metrics_weighted_f1", _PAIRS + " select round(sum(f1 * nt) / sum(nt), 6)::double as weighted_f1 from f")
def metrics_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.weighted_f1(_pairs(spark, d)))


@query("confusion_matrix", _PAIRS + " select a.c as y_true, b.c as y_pred, count(pr.doc_id)::bigint as n from (values ('FREE'), ('SPAM')) a(c) cross join (values ('FREE'), ('SPAM')) b(c) left join pr on pr.y_true = a.c and pr.y_pred = b.c group by all")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_matrix(_pairs(spark, d), ["FREE", "SPAM"])


@query("classification_report", _PAIRS + ' select c as "class", round(p, 6)::double as precision, round(r, 6)::double as recall, round(f1, 6)::double as f1, nt::bigint as support, (select round(avg((y_true = y_pred)::int), 6) from pr) as accuracy, (select round(avg(f1), 6)::double from f) as macro_f1, (select round(sum(f1 * nt) / sum(nt), 6)::double from f) as weighted_f1 from f where nt > 0')
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.classification_report(_pairs(spark, d)))


_AUC = "with x as (select d.doc_id, n_chars as s, toxic as y from documents d join labels l on d.doc_id = l.doc_id)"


def _auc_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_positive")), "doc_id")


@query("roc_auc_rows", _AUC + ", c as (select y, sum(y) over (order by s desc, doc_id rows unbounded preceding) as tp from x) select round(sum(case when y = 0 then tp end)::double / (sum(y) * sum(1 - y)), 6) as auc from c")
def roc_auc_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_auc_rows(spark, d), order="doc_id"))


@query("roc_auc_grouped", _AUC + ", g as (select s, sum(y) as p, sum(1 - y) as n from x group by s), c as (select *, coalesce(sum(p) over (order by s desc rows between unbounded preceding and 1 preceding), 0) as before from g) select round(sum(n * (before + p / 2))::double / (sum(p) * sum(n)), 6) as auc from c")
def roc_auc_grouped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_auc_rows(spark, d), ties="grouped"))


@query("label_encoding", "select label, (row_number() over (order by label) - 1)::int as code, n::bigint as n from (select source as label, count(*) as n from documents group by source)")
def label_encoding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    code = LabelEncoder.fit(docs, "source")
    n = docs.groupBy(code.encoded(F.col("source")).alias("code")).agg(F.count("*").alias("n"))
    return n.select(code.decoded(F.col("code")).alias("label"), "code", "n")


@query("class_distribution", "with c as (select quality, toxic, count(*)::double as n from labels group by all), t as (select sum(n) as t from c) select quality, toxic, n::bigint as n, round(n / t, 6) as share, round(1 - (select sum((n / t) * (n / t)) from c cross join t), 6) as gini from c cross join t")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    out = n.withColumn("share", share)
    return out.withColumn("gini", 1 - F.sum(F.col("share") * F.col("share")).over(Window.partitionBy())).select("quality", "toxic", "n", _round("share").alias("share"), _round("gini").alias("gini"))


# --- trained by iteration or with random numbers: rows only, held to invariants and quality in tests ---


def _dense_scores(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = _vectors(spark, d)
        hot, cold = ("0", "other") if method == "IsolationForest" else ("WEB_ATTACK", "RAW_DATA")
        train = v.withColumn("label", F.when(F.col("label") == "0", "0").otherwise("other")) if method == "IsolationForest" else v
        return AdvancedClassifier.train_dense(train, method, hot_label=hot, cold_label=cold).scores(v)

    return run


for _name, _method in (("logistic_scores", "LogisticRegression"), ("svm_scores", "Svm"), ("forest_scores", "RandomForest"), ("boosting_scores", "GradientBoosting"), ("isolation_scores", "IsolationForest")):
    query(_name)(_dense_scores(_method))


_WRAP = "18446744073709551616::hugeint"


def _hashed(x: str, dims: int = 16) -> str:
    """The hashed vector of a text in 128-bit arithmetic."""
    seed = f"list_reduce(list_transform(range(1, strlen({x}) + 1), lambda i: ('0x' || substr(hex(encode({x})), 2 * i - 1, 2))::int::hugeint), lambda s, b: (s * 131 + b + 17) % {_WRAP}, 0::hugeint)"
    steps = f"list_reduce(range({dims}), lambda a, i: list_append(a, (a[-1] * 6364136223846793005::hugeint + 1) % {_WRAP}), [{seed}])[2:]"
    return f"list_transform({steps}, lambda s: (s // 4294967296::hugeint)::float / 4294967295::float * 2::float - 1::float)"


def _subwords(longest: int, dims: int = 16) -> str:
    """CTEs: w, the distinct tokens; sv (token, pos, x), the means of the vectors of their n-grams of three characters or more."""
    return f"""w as (select distinct unnest({TOK}) as token from documents),
    g as (select token, unnest(flatten(list_transform(range(3, {longest + 1}), lambda n: list_transform(range(1, greatest(0, len(token) + 3 - n) + 1), lambda i: substr('<' || token || '>', i, n))))) as gram from w),
    gv as (select gram, {_hashed('gram', dims)} as v from (select distinct gram from g)),
    gx as (select gram, unnest(v)::double as x, generate_subscripts(v, 1) - 1 as pos from gv),
    sv as (select g.token, gx.pos, avg(gx.x) as x from g join gx on gx.gram = g.gram group by all)"""


def _long(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("vector").alias("pos", "value")).select(key, "pos", _round("value").alias("value"))


@query("hash_vectors", f"with v as (select token, {_hashed("token", 4)} as v from (select distinct unnest({TOK}) as token from documents)) select token, pos::int as pos, round(x::double, 6) + 0.0 as value from (select token, unnest(v) as x, generate_subscripts(v, 1) - 1 as pos from v)")
def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _long(embeddings.vector_table(_docs(spark, d), 4, "hash"), "token")


@query("subword_vectors", f"with {_subwords(5, 4)} select token, pos::int as pos, round(x, 6) + 0.0 as value from sv")
def subword_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _long(embeddings.vector_table(_docs(spark, d), 4, "subword"), "token")


@query("document_vectors", f"""with {_FREQ}, {_subwords(4)}, c as (select doc_id, t.tok, count(*) * coalesce(any_value(idf.idf), 1.0::double) as w from t left join idf on idf.tok = t.tok group by all),
s as (select c.doc_id, sv.pos, sum(c.w * sv.x) / greatest(sum(c.w), 1e-6) as x from c join sv on sv.token = c.tok group by all),
l as (select doc_id, pos, x / sqrt(sum(x * x) over (partition by doc_id)) as x from s)
select d.doc_id, p.pos::int as pos, round(coalesce(l.x, 0), 6) + 0.0 as value from documents d cross join (select unnest(range(16)) as pos) p left join l on l.doc_id = d.doc_id and l.pos = p.pos
""")
def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    model = embeddings.WordVectors(16, {}, embeddings.FastTextConfig(3, 4, 16))
    return _long(embeddings.document_vectors(docs, model, features.fit_tfidf(docs, count=False)), "doc_id")
