"""Domains, statistics, evaluation, feed, embeddings and the classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixture as X, url_columns
from queries.catalog import query
from queries.labelling import _SPLIT
from visitweave.config import NO_DOMAIN
from visitweave.operators import classifier, cooccurrence, domains, embeddings, evaluate, labels, sequences, split, stats, urls
from visitweave.sources import models, visits as V
from visitweave.storage import durable, fresh_path

_DOM = f""", d as (select *, case when event_type='error' then '{NO_DOMAIN}' else "domain" end dom from ev)
"""


def _with_domain(spark, sf):
    """Page views with the domain from the URL job; error events have no valid URL."""
    bad = F.when(F.col("event_type") == "error", F.lit("-")).otherwise(F.col("request_url"))
    views = X.page_views(spark, sf).drop("domain").withColumn("request_url", bad)
    return urls.domains(views, "request_url", X.rules(spark))


# -- domains -----------------------------------------------------------------------------

@query("a2_domain_counts", X.sql(_DOM + 'select dom "domain", count(*) n_events from d group by 1'))
def a2(spark, sf):
    return domains.domain_counts(_with_domain(spark, sf))


@query("f7_frequent_domains", X.sql(_DOM + 'select dom "domain", count(*) n_events from d group by 1 having count(*) >= 200'))
def f7(spark, sf):
    return domains.frequent(domains.domain_counts(_with_domain(spark, sf)), 200)


@query("a3_domain_dictionary", X.sql(_DOM + f"""
, n as (select dom from d union select '{NO_DOMAIN}')
select dom "domain", row_number() over (order by dom)-1 domain_id from n"""))
def a3(spark, sf):
    return domains.dictionary(_with_domain(spark, sf))


@query("j6_domain_ids", X.sql(_DOM + f"""
, n as (select dom from d where event_type <> 'signup' union select '{NO_DOMAIN}'),
ids as (select dom, row_number() over (order by dom)-1 domain_id from n)
select user_id, event_id, coalesce(domain_id,-1) domain_id from d left join ids using (dom)"""))
def j6(spark, sf):
    ev = _with_domain(spark, sf)
    ids = domains.dictionary(ev.filter("event_type <> 'signup'"))
    return domains.with_domain_id(ev, ids).select("user_id", "event_id", "domain_id")


@query("j7_rare_domains_replaced", X.sql(_DOM + f"""
, good as (select dom from d group by 1 having count(*) >= 200)
select user_id, event_id, case when dom in (select dom from good) then dom else '{NO_DOMAIN}' end "domain" from d"""))
def j7(spark, sf):
    return domains.replace_rare(_with_domain(spark, sf), 200).select("user_id", "event_id", "domain")


@query("a6_domain_chains", X.sql(_DOM + """
, o as (select *, (row_number() over (partition by user_id order by ts_ms, event_id)-1)//1000 part from d)
select user_id, part, string_agg(dom, ' ' order by ts_ms, event_id) chain from o group by all"""))
def a6(spark, sf):
    out = domains.chains(_with_domain(spark, sf), hot=X.hot_users(spark, sf))
    return out.select("user_id", "part", F.array_join("chain", " ").alias("chain"))


# -- statistics --------------------------------------------------------------------------

_PARTED = f""", e as (select *, case when {_SPLIT}=0 then 'test' else 'train' end split from ev),
x as (select *, case when {_SPLIT}=0 then 'test' else 'train' end split from vs)
"""


@query("a11_dataset_statistics", X.sql(_PARTED + """
, p as (select unnest(['train','test','overall']) part)
select p.part, (select count(*) from x where p.part in (x.split,'overall')) n_visits,
  (select count(*) from e where p.part in (e.split,'overall')) n_page_views,
  (select count(distinct "domain") from e where p.part in (e.split,'overall')) n_domains,
  (select count(distinct user_id) from e where p.part in (e.split,'overall')) n_users from p"""))
def a11(spark, sf):
    ev = split.with_split(X.page_views(spark, sf))
    return stats.dataset_statistics(ev, split.with_split(X.visits(spark, sf), "user"))


@query("a12_domain_overlap", X.sql(_PARTED + """
, tr as (select distinct "domain" from e where split='train'), te as (select distinct "domain" from e where split='test'),
c as (select (select count(*) from (select * from tr intersect select * from te)) n_both, (select count(*) from te) n_test)
select n_both, n_test, round(1 - n_both/n_test::double, 6) unseen_share from c"""))
def a12(spark, sf):
    out = stats.domain_overlap(split.with_split(X.page_views(spark, sf)))
    return out.withColumn("unseen_share", F.round("unseen_share", 6))


# -- evaluation --------------------------------------------------------------------------

_PRED = ", pr as (select user_id, event_id, visit_rank, visit_rank-1 actual, (visit_rank-1+event_id%3)%8 predicted from lab)\n"


def _predictions(spark, sf):
    lab = labels.visit_labels(X.page_views(spark, sf), X.visit_rows(spark, sf))
    actual = F.col("visit_rank") - 1
    return lab.select("user_id", "event_id", "visit_rank", actual.alias("actual"),
                      ((actual + F.col("event_id") % 3) % 8).cast("int").alias("predicted"))


@query("a7_confusion_matrix", X.sql(_PRED + """
select p predicted, a actual, count(pr.event_id) n from (select unnest(range(8)) p) x
cross join (select unnest(range(8)) a) y left join pr on predicted = p and actual = a group by all"""))
def a7(spark, sf):
    return evaluate.confusion(_predictions(spark, sf))


@query("a7_confusion_wide", X.sql(_PRED + "select p predicted, " + ", ".join(
    f"count(*) filter (where actual={i}) actual_{i}" for i in range(8))
    + " from (select unnest(range(8)) p) x left join pr on predicted = p group by 1"))
def a7_wide(spark, sf):
    return evaluate.confusion_wide(_predictions(spark, sf))


@query("a8_confusion_share", X.sql(_PRED + """
select p predicted, a actual, round(count(pr.event_id)/(select count(*) from pr)::double,6) share
from (select unnest(range(8)) p) x cross join (select unnest(range(8)) a) y
left join pr on predicted = p and actual = a group by all"""))
def a8(spark, sf):
    out = evaluate.confusion_share(evaluate.confusion(_predictions(spark, sf)))
    return out.withColumn("share", F.round("share", 6))


@query("a9_a10_accuracy", X.sql(_PRED + """
select round(avg((predicted = actual)::int),6) accuracy, count(*) n_samples from pr"""))
def a9(spark, sf):
    return evaluate.accuracy(_predictions(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query("p15_arg_max", X.sql(_PRED + "select user_id, event_id, predicted from pr", "lab"))
def p15(spark, sf):
    scored = _predictions(spark, sf).select("user_id", "event_id", F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == F.col("predicted"), 0.5).when(
            i > F.col("predicted"), 0.5).otherwise(0.1)).alias("scores"))
    return evaluate.predicted_class(scored).select("user_id", "event_id", "predicted")


@query("a13_referral_votes", X.sql(_PRED + """
, c as (select user_id, visit_rank, predicted, count(*) n from pr where predicted > 0 group by all),
best as (select user_id, visit_rank, predicted, row_number() over (partition by user_id, visit_rank
      order by n desc, predicted) rn from c)
select p.user_id, p.visit_rank, coalesce(max(q.predicted),0) referral from (select distinct user_id, visit_rank from pr) p
left join best q on q.user_id = p.user_id and q.visit_rank = p.visit_rank and rn = 1 group by all"""))
def a13(spark, sf):
    return evaluate.referral_votes(_predictions(spark, sf))


@query("a14_visit_votes", X.sql("""
, p as (select l.user_id, l.event_id, v.visit_rank,
               case when (l.event_id*7 + v.visit_rank*5) % 4 = 0 then 0 else 1 end predicted
        from lab l join vs v on v.user_id = l.user_id and v.visit_rank <= 8),
c as (select user_id, event_id, visit_rank, count(*) filter (where predicted=0) n from p group by all)
select user_id, event_id, coalesce(min(visit_rank) filter (where n > 0),0) voted_visit from c group by all"""))
def a14(spark, sf):
    hot = X.hot_users(spark, sf)
    pairs = sequences.single_visit(X.page_views(spark, sf), X.visit_rows(spark, sf, hot), hot=hot)
    said = F.when((F.col("event_id") * 7 + F.col("visit_rank") * 5) % 4 == 0, 0).otherwise(1)
    return evaluate.visit_votes(pairs.withColumn("predicted", said))


# -- sampling and feed -------------------------------------------------------------------

def _user_rows(spark, sf):
    return X._base(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


_FEED = """, us as (select user_id, count(*) n_rows from ev group by 1),
k as (select user_id, n_rows, ('0x'||substr(md5(user_id),1,8))::bigint % 4 shard, md5('7|'||user_id) "key" from us),
o as (select *, row_number() over (partition by shard order by "key", user_id) feed_rank,
      coalesce(sum(n_rows) over (partition by shard order by "key", user_id
               rows between unbounded preceding and 1 preceding),0) before from k)
"""


@query("g2_feed_order", X.sql(_FEED + "select user_id, n_rows, shard, feed_rank from o"))
def g2(spark, sf):
    return split.feed_order(_user_rows(spark, sf), 4, 7)


@query("g3_user_batches", X.sql(_FEED + "select user_id, n_rows, shard, feed_rank, (before//100)::bigint batch_id from o"))
def g3(spark, sf):
    return split.batches(_user_rows(spark, sf), 100, 4, 7)


@query("g3_user_batches_literal", X.sql(_FEED + """
, walk as (with recursive r as (
    select shard, feed_rank, user_id, n_rows, 0::bigint batch_id, n_rows filled from o where feed_rank = 1
    union all select o.shard, o.feed_rank, o.user_id, o.n_rows, r.batch_id + (r.filled > 100)::int,
      case when r.filled > 100 then o.n_rows else r.filled + o.n_rows end
    from r join o on o.shard = r.shard and o.feed_rank = r.feed_rank + 1) select * from r)
select user_id, n_rows, shard, feed_rank, batch_id from walk"""))
def g3_literal(spark, sf):
    return split.batches(_user_rows(spark, sf), 100, 4, 7, literal=True)


_CHANCE = "('0x'||substr(md5({seed}||'|'||user_id||'|'||event_id),1,8))::bigint"
_TIMES = " + ".join(f"({_CHANCE} >= {b})::int" for b in split.poisson_bounds(0.3))


@query("g1_sample_with_replacement", X.sql(f"""
, d as (select user_id, event_id, {_TIMES.format(seed=5)} times from ev)
select user_id, event_id from (select user_id, event_id, unnest(range(times)) from d)"""))
def g1(spark, sf):
    return split.sample(X.page_views(spark, sf).select("user_id", "event_id"), 0.3, 5)


@query("g4_epoch_samples", X.sql(f"""
, d as (select user_id, event_id, epoch::int epoch, {_TIMES.format(seed="(epoch + 5)")} times
        from ev, unnest(range(3)) r(epoch))
select user_id, event_id, epoch from (select user_id, event_id, epoch, unnest(range(times)) from d)"""))
def g4(spark, sf):
    return split.epochs(X.page_views(spark, sf).select("user_id", "event_id"), 3, 0.3, 5)


# -- embeddings and features -------------------------------------------------------------

SIZE = 20


def _vocabulary(vectors):
    return vectors.select("token", F.size("vector").alias("n"))


@query("m1_m3_url_embedding", X.sql(url_columns._PARTS.replace("\nwith ", "\n, ", 1) + f"""
, x as (select request_url url from ev union all select referrer_url from ev union all select prev_url from ev),
t as (select unnest(p.tokens) token from x join (select distinct url, tokens from w) p using (url))
select token, {SIZE} n from t group by token having count(*) >= 5"""))
def m1(spark, sf):
    sentences = embeddings.counted_sentences(X.events(spark, sf), X.rules(spark))
    return _vocabulary(embeddings.vector_table(embeddings.fit(sentences, seed=1, size=SIZE, times="times")))


@query("m2_m3_domain_embedding", X.sql(_DOM + f"""
, good as (select dom from d group by 1 having count(*) >= 5),
t as (select case when dom in (select dom from good) then dom else '{NO_DOMAIN}' end token from d)
select token, {SIZE} n from t group by token having count(*) >= 5"""))
def m2(spark, sf):
    chains = domains.chains(domains.replace_rare(durable(_with_domain(spark, sf))), hot=X.hot_users(spark, sf))
    return _vocabulary(embeddings.vector_table(embeddings.fit(chains, "chain", seed=1, size=SIZE)))


_PAIRS = _DOM + """
, walk as (select *, row_number() over (partition by user_id order by ts_ms, event_id)-1 p from d),
pair as (select a.dom token, b.dom context from walk a join walk b
      on a.user_id = b.user_id and a.p//1000 = b.p//1000 and b.p <> a.p and b.p between a.p - 5 and a.p + 5),
pn as (select token, context, count(*) n from pair group by all),
pm as (select token, sum(n) n from pn group by 1), pt as (select sum(n) n from pn),
pmis as (select pn.token, pn.context, pn.n, ln(pn.n::double * pt.n::double / (pm.n::double * pk.n::double)) pmi
      from pn join pm using (token) join pm pk on pk.token = pn.context, pt)
"""


def _chains(spark, sf):
    return durable(domains.chains(_with_domain(spark, sf), hot=X.hot_users(spark, sf)).select("chain"))


@query("m2_cooccurrence_counts", X.sql(_PAIRS + "select token, context, n from pn"))
def m2_counts(spark, sf):
    return cooccurrence.pair_counts(_chains(spark, sf), "chain")


@query("m2_positive_pmi", X.sql(_PAIRS + "select token, context, n, round(pmi, 6) pmi from pmis where pmi > 0.000001"))
def m2_pmi(spark, sf):
    found = cooccurrence.positive_pmi(durable(cooccurrence.pair_counts(_chains(spark, sf), "chain")))
    return found.filter("pmi > 0.000001").withColumn("pmi", F.round("pmi", 6))


@query("m2_cooccurrence_embedding", X.sql(_DOM + f"""
select dom token, {SIZE} n, true is_normal from d group by dom having count(*) >= 5"""))
def m2_factors(spark, sf):
    """Vectors of all domains from their co-occurrences; every vector has finite numbers."""
    vectors = embeddings.fit(_chains(spark, sf), "chain", seed=1, size=SIZE, method="cooccurrence")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e6))
    return vectors.select("token", F.size("vector").alias("n"), finite.alias("is_normal"))


@query("s5_s6_embedding_write_read", X.sql(_DOM + f"""
select dom token, {SIZE} n from d group by dom having count(*) >= 5"""))
def s5(spark, sf):
    path = fresh_path(spark, "embedding")
    chains = domains.chains(_with_domain(spark, sf))
    models.save_embedding(embeddings.fit(chains, "chain", seed=1, size=SIZE), path)
    back = embeddings.vector_table(models.load_embedding(path))
    return _vocabulary(models.load_vectors(spark, path).join(back.select("token"), "token"))


# The lookups below take vectors made from a token's md5, four numbers each, for tokens
# seen at least five times in the page URLs, so that SQL can follow every value.
DIM = 4
_MD5_VEC = "[" + ",".join(f"(('0x'||substr(md5({{0}}),{2 * i + 1},2))::int/256.0)::float" for i in range(DIM)) + "]"
_ZEROS = "[0,0,0,0]::float[]"
_VECTORS = f"""
, tok as (select page_id, url, unnest(tokens[:10]) token, generate_subscripts(tokens[:10],1)-1 pos from w),
vt as (select token, {_MD5_VEC.format('token')} vec from (select token from tok group by 1 having count(*) >= 5)),
dv as (select fld token, {_MD5_VEC.format('fld')} vec from (select fld from w group by 1 having count(*) >= 5)
       union all select '{NO_DOMAIN}', {_MD5_VEC.format("'" + NO_DOMAIN + "'")}),
ids as (select dom, row_number() over (order by dom)-1 domain_id from (
        select fld dom from w union select '{NO_DOMAIN}')),
known as (select url, pos, vec from tok join vt using (token)),
mean as (select url, [{','.join(f"(sum(vec[{i + 1}])::float*0.1::float)" for i in range(DIM))}] url_vec from known group by 1),
feat as (select w.url, coalesce(mean.url_vec,{_ZEROS}) url_vec,
                coalesce(dv.vec,(select vec from dv where token='{NO_DOMAIN}')) domain_vec, coalesce(domain_id,-1) domain_id
         from w left join mean using (url) left join dv on dv.token = w.fld left join ids on ids.dom = w.fld)
"""
_LIST = "array_to_string(list_transform({0}, lambda x: round(x::double*1000)::bigint),',')"


def _digits(col):
    return F.array_join(F.transform(col, lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",")


def _md5_vectors(tokens, min_count):
    """``(token, vector)`` for tokens with at least ``min_count`` rows."""
    kept = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    pair = lambda i: F.conv(F.substring(F.md5("token"), 2 * i + 1, 2), 16, 10).cast("float")
    return kept.select("token", F.array(*[(pair(i) / 256).cast("float") for i in range(DIM)]).alias("vector"))


def _page_lookup(spark, sf, with_missing=False):
    """URL dimension of the page table, its token and domain vectors, and domain ids.

    ``with_missing`` adds the empty URL, which events without a referrer have.
    """
    pages = X.table(spark, sf, "pages").select("url")
    if with_missing:
        pages = pages.union(spark.range(1).select(F.lit("")))
    dim = durable(urls.url_dimension(pages, ["url"], X.rules(spark)).select(
        "url", "domain_or_default", "vector_tokens"))
    tokens = _md5_vectors(dim.select(F.explode("vector_tokens").alias("token")), 5)
    names = dim.select(F.col("domain_or_default").alias("domain"))
    doms = _md5_vectors(names.select(F.col("domain").alias("token")), 5).unionByName(
        _md5_vectors(spark.range(1).select(F.lit(NO_DOMAIN).alias("token")), 1))
    return dim, tokens, doms, domains.dictionary(names)


@query("j4_token_vectors", url_columns._PARTS + _VECTORS + f"""
select url, pos, token, {_LIST.format(f'coalesce(vec,{_ZEROS})')} vector from tok left join vt using (token)""")
def j4(spark, sf):
    dim, tokens, _, _ = _page_lookup(spark, sf)
    return embeddings.token_vectors(dim, tokens, DIM).withColumn("vector", _digits("vector"))


@query("a5_url_means", url_columns._PARTS + _VECTORS + f"select url, {_LIST.format('url_vec')} url_vec from feat")
def a5(spark, sf):
    dim, tokens, _, _ = _page_lookup(spark, sf)
    return embeddings.url_means(dim.select("url", "vector_tokens"), tokens, DIM).select(
        "url", _digits("url_vec").alias("url_vec"))


@query("j5_domain_vectors", url_columns._PARTS + _VECTORS + f"select url, {_LIST.format('domain_vec')} domain_vec from feat")
def j5(spark, sf):
    dim, _, doms, _ = _page_lookup(spark, sf)
    return embeddings.with_domain_vector(dim.select("url", "domain_or_default"), doms, size=DIM).select(
        "url", _digits("domain_vec").alias("domain_vec"))


@query("p12_url_features", url_columns._PARTS + _VECTORS + f"""
select url, {_LIST.format('list_concat(list_concat(url_vec,domain_vec),[domain_id::float])')} features from feat""")
def p12(spark, sf):
    dim, tokens, doms, ids = _page_lookup(spark, sf)
    return embeddings.url_features(dim, tokens, doms, ids, DIM).select("url", _digits("features").alias("features"))


_EVENT_FEAT = X.sql(url_columns._PARTS.replace("\nwith ", "\n, ", 1) + _VECTORS)
_HREF = f"coalesce(h.domain_id, (select domain_id from ids where dom='{NO_DOMAIN}'))"


def _event_features(spark, ev, sf):
    dim, tokens, doms, ids = _page_lookup(spark, sf, with_missing=True)
    return embeddings.event_features(ev, embeddings.url_features(dim, tokens, doms, ids, DIM))


@query("p13_event_features", _EVENT_FEAT + f"""
select e.user_id, e.event_id, round(r.url_vec[1]::double*1000)::bigint request_first, r.domain_id request_domain,
       {_HREF} href_domain, 9 n_prev
from ev e join feat r on r.url = e.request_url left join feat h on h.url = e.referrer_url""")
def p13(spark, sf):
    out = _event_features(spark, X.events(spark, sf), sf)
    last = lambda c: F.element_at(c, -1).cast("long")
    return out.select("user_id", "event_id", F.round(F.col("request_vec")[0].cast("double") * 1000).cast("long")
                      .alias("request_first"), last("request_vec").alias("request_domain"),
                      last("href_vec").alias("href_domain"), F.size("prev_vec").alias("n_prev"))


@query("p11_model_rows", _EVENT_FEAT + f"""
, st as (select user_id, min(ts_ms) start_ms from ev group by 1)
select l.user_id, l.event_id, 20 n, r.domain_id::double request_domain, {_HREF}::double href_domain,
       round((l.ts_ms-start_ms)/1000.0::double,3) rel_time, l.visit_rank::double "label"
from lab l join st using (user_id) join feat r on r.url = l.request_url left join feat h on h.url = l.referrer_url""")
def p11(spark, sf):
    hot = X.hot_users(spark, sf)
    with_vec = _event_features(spark, X.events(spark, sf, hot), sf)
    marked = labels.label_events(with_vec, V.first_visits(X.visit_rows(spark, sf, hot)), matched_only=False)
    rows = sequences.since_start(marked, hot).filter("visit_rank > 0").withColumnRenamed("visit_rank", "label")
    row, at = F.col("model_row"), 2 * DIM + 1
    return embeddings.model_rows(rows).select(
        "user_id", "event_id", F.size(row).alias("n"), F.element_at(row, at).alias("request_domain"),
        F.element_at(row, 2 * at).alias("href_domain"), F.round(F.element_at(row, -2), 3).alias("rel_time"),
        F.element_at(row, -1).alias("label"))


# -- classifier --------------------------------------------------------------------------

def _samples(spark, sf, mode):
    hot = X.hot_users(spark, sf)
    made = sequences.learning_set(mode)(X.page_views(spark, sf), X.visit_rows(spark, sf, hot), hot=hot)
    return split.with_split(classifier.window_summary(sequences.non_empty(made))).select(
        "user_id", "event_id", "inputs", "label", "split")


def _trained(spark, sf, mode, iterations=5):
    samples = durable(_samples(spark, sf, mode))
    return samples, classifier.fit(samples.filter("split = 'train'"), mode, 1, iterations)


@query("m4_m6_score_windows", X.sql(f"""
select user_id, event_id, visit_rank-1 "label", true is_class, 8 n_scores, 1.0::double total from lab where {_SPLIT} = 0""", "lab"))
def m4(spark, sf):
    samples, model = _trained(spark, sf, "multi-visit")
    total = F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 6)
    return classifier.score(samples.filter("split = 'test'"), model).select(
        "user_id", "event_id", "label", F.col("predicted").between(0, 7).alias("is_class"),
        F.size("scores").alias("n_scores"), total.alias("total"))


@query("m7_evaluate_model", X.sql(f"""
, c as (select referrer_rank a, count(*) n from lab join refs using (user_id, visit_rank) where {_SPLIT} = 0 group by 1)
select a actual, 8 n_cells, coalesce(n,0) n_samples from (select unnest(range(8)) a) left join c using (a)"""))
def m7(spark, sf):
    samples, model = _trained(spark, sf, "multi-transfer")
    scored = classifier.score(samples.filter("split = 'test'"), model)
    cells = evaluate.confusion(scored.select("predicted", F.col("label").alias("actual")))
    return cells.groupBy("actual").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_samples"))


@query("m5_s8_train_and_log")
def m5(spark, sf):
    root = fresh_path(spark, "classifier")
    samples, model = _trained(spark, sf, "multi-visit", 3)
    models.save_classifier(model, f"{root}/model")
    again = classifier.fit(samples.filter("split = 'train'"), "multi-visit", 1, 3,
                           resume=models.load_classifier(spark, f"{root}/model"))
    for name, m in (("epoch", model), ("epoch", again)):
        scored = classifier.score(samples.filter("split = 'test'"), m)
        models.write_metrics(classifier.losses(scored).withColumn("type", F.lit(name)), f"{root}/log")
    return models.read_metrics(spark, f"{root}/log").select("type", F.round("loss", 4).alias("loss"),
                                                            F.round("accuracy", 4).alias("accuracy"))
