"""Queries that audit, compare and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import corpus, draws, features, heads, metrics, quality, reports, resampling, rows, stats
from ..sources.store import shared_dir
from . import fixtures as X
from .queries import _VEC as VEC_SQL
from .queries import _vectors as vectors
from .registry import query

_PROB = "(SELECT vec_id, pos, [a * a / t, b * b / t, c * c / t, g * g / t] AS p FROM (SELECT *, a * a + b * b + c * c + g * g AS t FROM (SELECT vec_id, pos, embedding[pos * 4 + 1]::DOUBLE AS a, embedding[pos * 4 + 2]::DOUBLE AS b, embedding[pos * 4 + 3]::DOUBLE AS c, embedding[pos * 4 + 4]::DOUBLE AS g FROM embeddings, range(16) r(pos))) WHERE t > 0)"
_DRAWS = """(SELECT label, replicate, vec_id, count(*) AS times FROM
  (SELECT label, replicate, ('0x' || substr(sha256('11|' || replicate || '|' || label || '|' || k), 1, 12))::BIGINT % n AS k FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IS NOT NULL), range(20) b(replicate)) d
  JOIN (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings WHERE label IS NOT NULL) r USING (label, k) GROUP BY ALL)"""


def _draws(spark, d):
    return rows.bootstrap_draws(X.table(spark, d, "embeddings").where("label IS NOT NULL"), "label", "vec_id", 20, 11)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1")
def a03_best_hit(spark, d):
    li = X.table(spark, d, "lineitem").groupBy("l_orderkey", "l_quantity", "l_linenumber").agg(F.max("l_extendedprice").alias("l_extendedprice"))
    return reports.best_hit(li, "l_orderkey", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, bool_and(l_discount < 0.08) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS group_flag FROM lineitem")
def a05_group_flag(spark, d):
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("positive"), (F.col("l_discount") < 0.08).alias("low"))
    return reports.group_flag(li, "l_orderkey", "positive", "low").select("l_orderkey", "l_linenumber", "group_flag")


@query("SELECT model_id, task_id, round(m, 9) AS mean FROM (SELECT model_id, task_id, count(DISTINCT seed) AS n, avg(value) AS m FROM v_results WHERE NOT (seed = 3 AND category = 1) GROUP BY ALL) JOIN (SELECT model_id, count(DISTINCT seed) AS s FROM v_results WHERE NOT (seed = 3 AND category = 1) GROUP BY ALL) USING (model_id) WHERE n = s")
def a08_shared_means(spark, d):
    r = X.results(spark, d).where("NOT (seed = 3 AND category = 1)")
    return reports.shared_means(r, ["model_id"], "task_id", "seed", "value").withColumn("mean", F.round("mean", 9))


_STATUS = "SELECT o_orderkey, o_orderpriority, CASE WHEN bool_or(l_returnflag = 'N') THEN 'complete' WHEN bool_or(l_returnflag = 'R') THEN 'terminal_failed' ELSE 'missing' END AS state FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


def _status(spark, d):
    li = X.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return reports.plan_status(X.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), li.where("l_returnflag = 'N'"), li.where("l_returnflag = 'R'"), "o_orderkey")


@query(_STATUS)
def j02_plan_status(spark, d):
    return _status(spark, d)


@query(f"SELECT o_orderpriority, count(*) AS planned, count(*) FILTER (state = 'complete') AS complete, count(*) FILTER (state = 'terminal_failed') AS terminal_failed, count(*) FILTER (state = 'missing') AS missing FROM ({_STATUS}) GROUP BY ALL")
def a17_report_summary(spark, d):
    return reports.status_totals(_status(spark, d), ["o_orderpriority"])


_TOKEN = "SELECT *, CASE WHEN seed <> 4 THEN category ELSE length(model_id) END AS token FROM v_results"


@query(f"SELECT a.model_id AS baseline, task_id, seed, round(b.value - a.value, 9) AS delta FROM ({_TOKEN}) a JOIN ({_TOKEN}) b USING (task_id, seed, token) WHERE b.model_id = (SELECT min(n_name) FROM nation) AND a.model_id <> b.model_id")
def j06_paired_seeds(spark, d):
    r = X.results(spark, d).withColumn("token", F.when(F.col("seed") != 4, F.col("category")).otherwise(F.length("model_id")).cast("int"))
    name = F.broadcast(X.table(spark, d, "nation").agg(F.min("n_name").alias("model_id")))  # one row
    other = r.join(name, "model_id", "left_anti").withColumnRenamed("model_id", "baseline")
    return reports.paired_seeds(r.join(name, "model_id", "left_semi"), other, ["task_id"], "value", "baseline").withColumn("delta", F.round("delta", 9))


_REPS = "SELECT (l_orderkey % 3)::INT AS run, l_returnflag AS token, l_partkey % 101 AS replicate, avg(l_discount::DOUBLE) AS value FROM lineitem GROUP BY ALL"


def _reps(spark, d):
    li = X.table(spark, d, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 3).cast("int").alias("run"), F.col("l_returnflag").alias("token"), (F.col("l_partkey") % 101).alias("replicate")).agg(F.avg(F.col("l_discount").cast("double")).alias("value"))


@query(f"""SELECT a.run, token, replicate, round(a.value - b.value, 9) + 0.0 AS delta FROM ({_REPS}) a JOIN ({_REPS}) b USING (token, replicate)
  WHERE b.run = (a.run + 1) % 3 AND (a.run, token) IN (SELECT (x.run, y.token) FROM (SELECT unnest(range(3)) AS run) x JOIN (SELECT token, list(DISTINCT run) AS runs, count(DISTINCT replicate) AS n, count(*) AS c FROM ({_REPS}) GROUP BY token) y ON n >= 100 AND c = 3 * n)""")
def j07_paired_replicates(spark, d):
    r = _reps(spark, d)
    # Each run against the next; every run holds all replicates of a token here, or none.
    return reports.paired_replicates(r, r.withColumn("run", F.pmod(F.col("run") - 1, F.lit(3))), ["run"]).select("run", "token", "replicate", (F.round("delta", 9) + 0.0).alias("delta"))


@query("""SELECT nation, CASE WHEN n = 5 THEN 'paired_t' WHEN b >= 100 THEN 'paired_bootstrap' ELSE 'descriptive' END AS method, CASE WHEN x > 0 THEN 'ours' WHEN x < 0 THEN 'baseline' ELSE 'tie' END AS winner
  FROM (SELECT *, CASE WHEN n <> 5 AND b >= 100 THEN bd ELSE coalesce(sd, bd) END AS x FROM (SELECT nation, coalesce(n, 0) AS n, sd, coalesce(b, 0) AS b, bd FROM
  (SELECT nation, count(*) AS n, avg(delta) AS sd FROM (SELECT c_nationkey AS nation, c_custkey % (4 + c_nationkey % 2) AS seed, avg(c_acctbal::DOUBLE) - 4500 AS delta FROM customer GROUP BY ALL) GROUP BY ALL)
  FULL JOIN (SELECT c_nationkey + 5 AS nation, count(*) AS b, avg(o_totalprice::DOUBLE - 150000) AS bd FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) USING (nation)))""")
def r03_choose_method(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").cast("double").alias("delta"))
    # Five seeds for odd nations and four for even ones; nations below 5 have no replicates, those above 24 no seeds.
    seeds = c.groupBy("nation", (F.col("c_custkey") % (4 + F.col("nation") % 2)).alias("seed")).agg((F.avg("delta") - 4500).alias("delta"))
    prices = X.table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select((F.col("nation") + 5).alias("nation"), (F.col("o_totalprice").cast("double") - 150000).alias("delta"))
    return reports.choose_method(seeds, prices, ["nation"]).select("nation", "method", "winner")


@query(f"SELECT label, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, count(*) AS n FROM (SELECT label, replicate, sum(CASE WHEN vec_id % 3 = 0 THEN times ELSE 0 END) / sum(times) AS v FROM {_DRAWS} GROUP BY ALL) GROUP BY label")
def r04_bootstrap_metric(spark, d):
    hits = X.table(spark, d, "embeddings").where("label IS NOT NULL").select("vec_id", (F.col("vec_id") % 3 == 0).alias("hit"))
    s = stats.boot_summary(reports.bootstrap_accuracy(hits, _draws(spark, d), ["vec_id"], ["label"]), ["label"], "value")
    return s.select("label", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")], "n")


@query(f"SELECT label, replicate, sha256(string_agg(vec_id || ':' || times, ',' ORDER BY vec_id)) AS token FROM {_DRAWS} GROUP BY ALL")
def r05_pairing_token(spark, d):
    return reports.pairing_token(_draws(spark, d), ["label", "replicate"], "vec_id")


@query("SELECT task_id, seed, value, row_number() OVER (PARTITION BY task_id ORDER BY seed) AS order_no FROM v_results WHERE model_id = 'NATION_3'")
def r07_trajectory(spark, d):
    return reports.trajectory(X.results(spark, d), "NATION_3", ["task_id"], "seed").select("task_id", "seed", "value", "order_no")


_TASKS = """SELECT c_custkey AS task_id, CASE WHEN c_custkey % 17 = 0 THEN 'excluded' WHEN c_custkey % 19 = 0 THEN 'analysis_only' WHEN e IS NULL THEN 'waiting' WHEN e > 0 THEN 'failed' ELSE 'ready' END AS status, coalesce(c_custkey % 4 = 0 AND n % 2 = 0, false) AS reused
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS e FROM orders GROUP BY ALL) ON o_custkey = c_custkey"""


def _tasks(spark, d):
    c, o = X.table(spark, d, "customer"), X.table(spark, d, "orders")
    kind = F.when(F.col("c_custkey") % 17 == 0, "excluded").when(F.col("c_custkey") % 19 == 0, "analysis_only").otherwise("task")
    audits = o.groupBy(F.col("o_custkey").alias("task_id")).agg(F.count("*").alias("hash"), F.count_if(F.col("o_orderstatus") == "P").alias("errors"))
    cached = audits.where("task_id % 4 = 0").select("task_id", F.expr("hash div 2 * 2").alias("hash"))
    return reports.dataset_status(c.select(F.col("c_custkey").alias("task_id"), kind.alias("kind")), audits, cached)


@query(_TASKS)
def q03_audit_all(spark, d):
    return _tasks(spark, d)


@query(f"SELECT status, count(*) AS n, count(*) FILTER (reused) AS reused FROM ({_TASKS}) GROUP BY status")
def q10_dataset_index(spark, d):
    return _tasks(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if("reused").alias("reused"))


@query("""SELECT 'unique:l_orderkey' AS rule, count(*) AS rows FROM (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'foreign:l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
  UNION ALL SELECT 'required:l_suppkey', count(*) FROM lineitem WHERE l_suppkey IS NULL UNION ALL SELECT 'allowed:l_returnflag', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""")
def q04_check_constraints(spark, d):
    known = X.table(spark, d, "part").where("p_size > 5").select("p_partkey")
    return quality.check_constraints(X.table(spark, d, "lineitem"), ("l_orderkey",), ("l_suppkey",), {"l_returnflag": ("A", "N")}, {"l_partkey": known})


@query("""SELECT unnest(['missing', 'extra', 'label', 'width', 'not_finite']) AS finding, unnest([count(*) FILTER (b IS NULL), count(*) FILTER (a IS NULL), count(*) FILTER (a AND b AND l IS DISTINCT FROM m), count(*) FILTER (a AND b AND coalesce(len(embedding), -1) <> 64),
  count(*) FILTER (a AND b AND NOT coalesce(list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v))), false))]) AS rows
  FROM (SELECT vec_id, CASE WHEN vec_id % 70 = 0 THEN -1 ELSE label END AS l, true AS a FROM embeddings WHERE vec_id % 50 <> 0) FULL JOIN (SELECT vec_id, label AS m, embedding, true AS b FROM embeddings WHERE vec_id % 60 <> 1) USING (vec_id)""")
def q08_verify_embeddings(spark, d):
    e = X.table(spark, d, "embeddings")
    s = e.where("vec_id % 50 <> 0").select("vec_id", F.when(F.col("vec_id") % 70 == 0, -1).otherwise(F.col("label")).alias("label"))
    return quality.verify_embeddings(s, e.where("vec_id % 60 <> 1"), "vec_id", 64)


@query("""SELECT p_partkey, CASE WHEN coalesce(p, '') = 'formal' OR coalesce(c, '') = 'formal' THEN 'formal' ELSE 'smoke' END AS profile, array_to_string(list_sort(list_distinct(list_concat(coalesce(pp, []), coalesce(cp, [])))), ',') AS patterns
  FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'formal' ELSE 'smoke' END AS p, [p_brand, p_type] AS pp FROM part WHERE p_partkey % 3 <> 0) FULL JOIN (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'formal' ELSE 'smoke' END AS c, [p_brand, 'all'] AS cp FROM part WHERE p_partkey % 2 = 0) USING (p_partkey)""")
def q09_merge_coverage(spark, d):
    p = X.table(spark, d, "part")
    side = lambda cut, *pats: ["p_partkey", F.when(F.col("p_size") > cut, "formal").otherwise("smoke").alias("profile"), F.array(*pats).alias("patterns")]
    m = reports.merge_coverage(p.where("p_partkey % 3 <> 0").select(*side(25, F.col("p_brand"), F.col("p_type"))), p.where("p_partkey % 2 = 0").select(*side(40, F.col("p_brand"), F.lit("all"))), "p_partkey")
    return m.withColumn("patterns", F.array_join("patterns", ","))


@query("SELECT key, count(*) AS n FROM (SELECT o_custkey AS key FROM orders UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY key")
def t01_union(spark, d):
    return X.table(spark, d, "orders").select(F.col("o_custkey").alias("key")).unionByName(X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"))).groupBy("key").agg(F.count("*").alias("n"))


@query(f"SELECT a.vec_id, round(avg(list_sum(list_transform(range(4), lambda i: (a.p[i + 1] - b.p[4 - i]) * (ln(greatest(a.p[i + 1], 1e-12)) - ln(greatest(b.p[4 - i], 1e-12))))) / 2), 7) AS divergence FROM {_PROB} a JOIN {_PROB} b ON a.vec_id = b.vec_id AND b.pos = 15 - a.pos GROUP BY a.vec_id")
def m18_strand_divergence(spark, d):
    p = features.base_probabilities(X.table(spark, d, "embeddings"))
    back = p.select("vec_id", (15 - F.col("pos")).alias("pos"), F.reverse("p").alias("q"))
    return features.strand_divergence(p.join(back, ["vec_id", "pos"]), ["vec_id"]).withColumn("divergence", F.round("divergence", 7))


@query(f"""SELECT id, round(-avg(CASE WHEN base = 4 THEN 0 ELSE ln(greatest(m.p[4 - base], 1e-12) / greatest(r.p[base + 1], 1e-12)) END), 7) AS score, count(*) FILTER (base < 4 AND (r.p IS NULL OR m.p IS NULL)) AS outside
  FROM (SELECT vec_id AS id, CASE WHEN o < 5 THEN 8 + vec_id % 3 - 6 + o ELSE 9 + vec_id % 3 + o - 5 END AS ref_pos, 3 + o AS mut_pos, (vec_id + o) % 5 AS base FROM embeddings, range(10) k(o) WHERE vec_id IN (SELECT vec_id FROM {_PROB}))
  LEFT JOIN {_PROB} r ON r.vec_id = id AND r.pos = ref_pos LEFT JOIN {_PROB} m ON m.vec_id = id AND m.pos = 15 - mut_pos GROUP BY id""")
def m14_boundary_score(spark, d):
    p = features.base_probabilities(X.table(spark, d, "embeddings"))
    mut = p.select("vec_id", (15 - F.col("pos")).alias("pos"), F.reverse("p").alias("p"))
    bases = F.substring(F.repeat(F.lit("ACGTN"), 3), (F.col("vec_id") % 5 + 1).cast("int"), F.lit(10))
    v = p.select("vec_id").distinct().select(F.col("vec_id").alias("id"), (8 + F.col("vec_id") % 3).alias("left"), (9 + F.col("vec_id") % 3).alias("right"), bases.alias("bases"))
    return features.boundary_score(features.boundary_pairs(v, 16), p, mut).withColumn("score", F.round("score", 7))


@query("SELECT window_id, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS canonical FROM (SELECT sample_id || '/' || i AS window_id, substr(sequence, i * 64 + 1, 64) AS s FROM v_samples, unnest(range((length(sequence) - 1) // 64 + 1)) r(i))")
def c02_canonical_windows(spark, d):
    c = features.chunks(X.samples(spark, d).select(F.col("sample_id").alias("contig"), "sequence"), 64, 0)
    return c.select(F.concat_ws("/", "contig", F.col("chunk_no").cast("string")).alias("window_id"), S.canonical(F.col("seq")).alias("canonical"))


@query("SELECT length, region, n, d // n AS round, d % n AS cursor, round(d / n, 9) AS exposure, (n - d % n) % n AS deficit FROM (SELECT length, region, count(*) AS n, 1000 + 7 * region AS d FROM v_windows GROUP BY ALL)")
def c10_pool_cursor(spark, d):
    q = X.windows(spark, d).groupBy("length", "region").agg(F.count("*").alias("n")).withColumn("draws", 1000 + 7 * F.col("region"))
    return corpus.pool_cursor(q).drop("draws").withColumn("exposure", F.round("exposure", 9))


@query("""SELECT c AS "check", v AS rows, v = 0 AS ok FROM (SELECT 'repeated_id' AS c, count(*) - count(DISTINCT sample_id) AS v FROM v_samples UNION ALL SELECT 'repeated_sequence', count(*) - count(DISTINCT least(sequence, reverse(translate(sequence, 'ACGT', 'TGCA')))) FROM v_samples
  UNION ALL SELECT 'group_crossing', count(*) FROM (SELECT group_id FROM v_samples GROUP BY group_id HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'bad_letters', count(*) FROM v_samples WHERE regexp_matches(sequence, '[^ACGTN]'))""")
def c11_ready_report(spark, d):
    return corpus.ready_report(X.samples(spark, d))


@query("""SELECT coalesce(a.model_id, b.model_id) AS model_id, coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.seed, b.seed) AS seed, CASE WHEN b.model_id IS NULL THEN 'only_left' WHEN a.model_id IS NULL THEN 'only_right' ELSE 'differs' END AS state
  FROM (SELECT * FROM v_results WHERE NOT (seed = 2 AND category = 1)) a FULL JOIN (SELECT model_id, task_id, seed, CASE WHEN seed = 1 THEN value + 0.1 ELSE value END AS value FROM v_results WHERE NOT (seed = 3 AND category = 0)) b
  ON a.model_id = b.model_id AND a.task_id = b.task_id AND a.seed = b.seed WHERE a.model_id IS NULL OR b.model_id IS NULL OR a.value IS DISTINCT FROM b.value""")
def j12_full_compare(spark, d):
    r = X.results(spark, d)
    other = r.where("NOT (seed = 3 AND category = 0)").withColumn("value", F.when(F.col("seed") == 1, F.col("value") + 0.1).otherwise(F.col("value")))
    return quality.full_compare(r.where("NOT (seed = 2 AND category = 1)"), other, ["model_id", "task_id", "seed"], "value")


def _heads(spark, d):
    e = X.table(spark, d, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL").withColumn("sample_id", F.col("vec_id").cast("string"))
    e = e.withColumn("split", F.when(S.hash_bucket(F.concat(F.lit("42|"), "sample_id"), 10) < 3, "test").otherwise("train"))
    return e.where("split = 'train'"), e.where("split = 'test'")


@query()
def f04_multilabel_head(spark, d):
    train, test = (x.withColumn("label_vec", F.expr("array(label % 2, label div 2 % 2)")) for x in _heads(spark, d))
    return heads.fit_multilabel(train, test, "label_vec", 2).select("vec_id", "output", "label", "pred", "score")


@query()
def f09_few_shot(spark, d):
    """Mean accuracy per seed of heads on eight rows a class."""
    out = heads.few_shot(*_heads(spark, d), 8, (42, 43))
    return out.groupBy("seed").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


_RANKED = "(SELECT *, rank() OVER (PARTITION BY task_id, seed ORDER BY value DESC) + (count(*) OVER (PARTITION BY task_id, seed, value) - 1) / 2 AS r FROM v_results WHERE NOT (model_id = 'NATION_2' AND seed = 4))"


@query(f"""SELECT model_id, round(macro, 9) AS macro, round(micro, 9) AS micro, round(mean_rank, 9) AS mean_rank, best_category, complete, CASE WHEN complete THEN row_number() OVER (PARTITION BY complete ORDER BY macro DESC, model_id) END AS position FROM
  (SELECT model_id, avg(m) AS macro, sum(s) / sum(n) AS micro, sum(rs) / sum(n) AS mean_rank, max({{'m': m, 'c': -category}}).c * -1 AS best_category, count(*) = 2 AND any_value(cells) = 25 AS complete FROM
    (SELECT model_id, category, avg(value) AS m, sum(value) AS s, count(*) AS n, sum(r) AS rs FROM {_RANKED} GROUP BY ALL) JOIN (SELECT model_id, count(DISTINCT (task_id, seed)) AS cells FROM {_RANKED} GROUP BY ALL) USING (model_id) GROUP BY model_id)""")
def r08_category_report(spark, d):
    out = reports.category_report(X.results(spark, d).where("NOT (model_id = 'NATION_2' AND seed = 4)"), "value", 2, 5, 5)
    return out.select("model_id", *[F.round(c, 9).alias(c) for c in ("macro", "micro", "mean_rank")], "best_category", "complete", "position")


_SETTINGS = "SELECT n_name AS model_id, o_orderpriority AS task_id, o_orderkey % 5 AS seed, avg(o_totalprice::DOUBLE) FILTER (o_orderkey % 2 = 0) AS f, avg(o_totalprice::DOUBLE) FILTER (o_orderkey % 2 = 1) AS l FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority NOT LIKE '5%' GROUP BY ALL"


@query(f"""SELECT model_id, seed, n_tasks, round(mean, 9) AS mean, round(least, 9) AS least FROM (WITH s AS (SELECT model_id, seed, count(*) AS n_tasks, avg(l / f) AS mean, min(l / f) AS least FROM ({_SETTINGS}) WHERE f <> 0 AND l IS NOT NULL GROUP BY ALL)
  SELECT * FROM s UNION ALL SELECT model_id, NULL, sum(n_tasks)::BIGINT, avg(mean), min(least) FROM s GROUP BY model_id)""")
def r09_retention_report(spark, d):
    o, c, n = (X.table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    setting = F.when(F.col("o_orderkey") % 2 == 0, "full").otherwise("low")
    r = j.groupBy(F.col("n_name").alias("model_id"), F.col("o_orderpriority").alias("task_id"), (F.col("o_orderkey") % 5).alias("seed"), setting.alias("setting")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("value"))
    out = reports.retention_report(r, "full", "low", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"))
    return out.select("model_id", "seed", "n_tasks", *[F.round(c, 9).alias(c) for c in ("mean", "least")])


@query("""SELECT model_id, task_id, state, CASE WHEN state = 'complete' THEN n END AS n, CASE WHEN state = 'complete' THEN round(m, 8) END AS mean, CASE WHEN state = 'complete' THEN round(m - h, 8) END AS low, CASE WHEN state = 'complete' THEN round(m + h, 8) END AS high,
  CASE WHEN state = 'not_applicable' THEN 'model does not take the task' WHEN state <> 'complete' THEN state WHEN n IS NULL THEN 'no value' WHEN n < 2 THEN 'one seed: no interval' END AS limitation FROM
  (SELECT *, CASE WHEN task_id LIKE '5%' AND length(model_id) = 8 THEN 'not_applicable' WHEN n = 5 THEN 'complete' WHEN n > 0 THEN 'terminal_failed' ELSE 'missing' END AS state, CASE WHEN n < 2 THEN 0 ELSE [12.706204736, 4.302652730, 3.182446305, 2.776445105][greatest(1, n - 1)] * s / sqrt(n) END AS h FROM
  (SELECT n_name AS model_id, o_orderpriority AS task_id FROM nation, (SELECT DISTINCT o_orderpriority FROM orders)) LEFT JOIN (SELECT model_id, task_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM v_results WHERE NOT (seed = 3 AND category = 1) GROUP BY ALL) USING (model_id, task_id))""")
def r06_matrix_rows(spark, d):
    r = X.results(spark, d).where("NOT (seed = 3 AND category = 1)")
    tasks = X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("task_id")).distinct()
    plan = X.table(spark, d, "nation").select(F.col("n_name").alias("model_id")).crossJoin(F.broadcast(tasks))  # the plan is a grid of models and tasks, one row per task here
    takes = plan.where("NOT (task_id LIKE '5%' AND length(model_id) = 8)")
    n = r.groupBy("model_id", "task_id").agg(F.count("*").alias("_n"))
    status = takes.join(n, ["model_id", "task_id"], "left").select("model_id", "task_id", F.when(F.col("_n") == 5, "complete").when(F.col("_n") > 0, "terminal_failed").otherwise("missing").alias("state"))
    out = reports.matrix_rows(plan, status, stats.mean_ci(r, ["model_id", "task_id"], "value"))
    return out.select("model_id", "task_id", "state", "n", *[F.round(c, 8).alias(c) for c in ("mean", "low", "high")], "limitation")


@query("SELECT seed, class, sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted, round(2 * sum(h) / (sum(t) + sum(p)), 9) AS f1 FROM (SELECT seed, label AS class, 1 AS t, 0 AS p, (label = pred)::INT AS h FROM v_pred_multi UNION ALL SELECT seed, pred, 0, 1, 0 FROM v_pred_multi) GROUP BY ALL")
def m05_class_scores(spark, d):
    return metrics.class_scores(X.pred_multi(spark, d), ["seed"]).withColumn("f1", F.round("f1", 9))


@query("""SELECT run_key, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 9) AS specificity FROM
  (SELECT run_key, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label <> 1 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label <> 1 AND score < 0.5) AS tn FROM v_pred_bin GROUP BY run_key)""")
def m15_confusion(spark, d):
    out = metrics.confusion(X.pred_bin(spark, d), ["run_key"])
    return out.select("run_key", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "specificity")])


@query(f"""SELECT run_key, round(any_value(ap), 8) AS micro_ap, round(avg(f), 8) AS macro_f1 FROM (SELECT run_key, output, 2 * count(*) FILTER (label = 1 AND score >= 0.5) / (2 * count(*) FILTER (label = 1 AND score >= 0.5) + count(*) FILTER (label <> 1 AND score >= 0.5) + count(*) FILTER (label = 1 AND score < 0.5)) AS f FROM ({VEC_SQL}) GROUP BY ALL)
  JOIN (SELECT run_key, sum(pos * tp / a) / sum(pos) AS ap FROM (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS a FROM (SELECT run_key, score, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM ({VEC_SQL}) GROUP BY ALL) WINDOW w AS (PARTITION BY run_key ORDER BY score DESC)) GROUP BY run_key) USING (run_key) GROUP BY run_key""")
def m08_pooled(spark, d):
    out = metrics.multilabel_pooled(vectors(spark, d), ["run_key"])
    return out.select("run_key", F.round("micro_ap", 8).alias("micro_ap"), F.round("macro_f1", 8).alias("macro_f1"))


@query(f"""SELECT run_key, output, round(corr(label, score), 7) AS pearson, round(corr(rl, rs), 7) AS spearman, round(1 - sum((score - label) ** 2) / (var_pop(label) * count(*)), 7) AS r2, round(avg(abs(score - label)), 7) AS mae, round(sqrt(avg((score - label) ** 2)), 7) AS rmse FROM
  (SELECT *, rank() OVER (PARTITION BY run_key, output ORDER BY label) + (count(*) OVER (PARTITION BY run_key, output, label) - 1) / 2 AS rl, rank() OVER (PARTITION BY run_key, output ORDER BY score) + (count(*) OVER (PARTITION BY run_key, output, score) - 1) / 2 AS rs FROM ({VEC_SQL})) GROUP BY run_key, output""")
def m07_outputs(spark, d):
    out = metrics.output_scores(vectors(spark, d), ["run_key"])
    return out.select("run_key", "output", *[F.round(c, 7).alias(c) for c in ("pearson", "spearman", "r2", "mae", "rmse")])


@query("""WITH g AS MATERIALIZED (SELECT doc_id % 40 AS grp, CASE WHEN doc_id % 40 = 7 THEN 'rare' ELSE lang END AS s, dense_rank() OVER (ORDER BY doc_id % 40) - 1 AS k FROM documents), n AS (SELECT count(DISTINCT grp) AS n, count(DISTINCT s) AS w FROM g),
  d AS MATERIALIZED (SELECT attempt, replicate, ('0x' || substr(sha256('5|' || attempt || '|' || replicate || '|' || draw), 1, 12))::BIGINT % n AS k, count(*) AS times FROM n, range(1, 31) a(attempt), range(20) r(replicate), range(40) x(draw) WHERE draw < n GROUP BY ALL),
  ok AS (SELECT replicate, min(attempt) AS attempt FROM (SELECT attempt, replicate FROM d JOIN g USING (k), n GROUP BY attempt, replicate, w HAVING count(DISTINCT s) = w) GROUP BY replicate)
  SELECT d.replicate, grp, times, d.attempt::INT AS attempt FROM d JOIN ok USING (replicate, attempt) JOIN (SELECT DISTINCT k, grp FROM g) USING (k)""")
def w21_group_bootstrap(spark, d):
    """Forty groups of documents, drawn until every language is there and what only one group has."""
    docs = X.table(spark, d, "documents").withColumn("grp", F.col("doc_id") % 40)
    return resampling.group_bootstrap(docs, "grp", F.array(F.when(F.col("grp") == 7, "rare").otherwise(F.col("lang"))), spark.range(20).withColumnRenamed("id", "replicate"), ["replicate"], 5)


@query()
def r04_bootstrap_ranked(spark, d):
    values = resampling.bootstrap_ranked(X.pred_bin(spark, d), ["run_key"], "row_no", "label", "score", 2025)
    each = [resampling.summarize_bootstrap(values, ["run_key"], m).withColumn("metric", F.lit(m)) for m in ("auroc", "average_precision")]
    return each[0].unionByName(each[1])


def _pools(spark, d):
    """The windows by length and region class, each class standing for a region's name."""
    names = list(draws.REGION_SHARES)
    weights = draws.draw_weights(draws.LENGTH_SHARES, draws.REGION_SHARES)
    sizes = {(r["length"], names[r["region"]]): r["n"] for r in X.windows(spark, d).groupBy("length", "region").agg(F.count("*").alias("n")).collect()}  # 35 rows
    return [draws.Pool(f"{n}:{r}", w, sizes[n, r]) for (n, r), w in weights.items() if (n, r) in sizes]


_SLOTS = """(SELECT pool, n, k, row_number() OVER (ORDER BY k::DOUBLE / w, o) - 1 AS slot FROM (SELECT length || ':' || name AS pool, count(*) AS n, any_value(lp * rp * (65536 // length)) AS w, any_value(li * 7 + region) AS o FROM v_windows
    JOIN (VALUES (4096, 5, 0), (8192, 15, 1), (16384, 5, 2), (32768, 5, 3), (65536, 70, 4)) l(length, lp, li) USING (length) JOIN (VALUES (0, 'coding', 32), (1, 'splice', 21), (2, 'promoter', 14), (3, 'UTR', 11), (4, 'TES', 8), (5, 'gene_body', 10), (6, 'background', 4)) r(region, name, rp) USING (region) GROUP BY ALL), range(60001) k(k))"""


@query(f"SELECT slot, pool, k // n AS round, k % n AS cursor FROM {_SLOTS} WHERE slot < 60000")
def c09_draw_slots(spark, d):
    """60,000 slots of the 35 pools, in the order in which they are due."""
    rows, _ = draws.draw(spark, draws.State(tuple(_pools(spark, d)), 42), 60_000)
    return rows.select("slot", "pool", "round", "cursor")


@query(f"SELECT pool, count(*) AS draws, count(*) // n AS round, count(*) % n AS cursor, least(count(*), n) AS windows, 0::BIGINT AS repeats FROM {_SLOTS} WHERE slot < 60000 GROUP BY pool, n")
def c10_resumed_draws(spark, d):
    """The same slots in three parts, each from the state that the one before saved; windows that a round takes twice are counted."""
    pools, path, parts = _pools(spark, d), shared_dir(spark), []
    for count in (10_001, 29_999, 20_000):
        rows, after = draws.draw(spark, draws.State.load(spark, path, pools, 42), count)
        after.save(spark, path)
        parts.append(rows)
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    twice = rows.groupBy("pool", "round", "place").count().groupBy("pool").agg(F.sum(F.col("count") - 1).alias("repeats"), F.count_distinct("place").alias("windows"))
    return after.table(spark).join(twice, "pool").select("pool", "draws", "round", "cursor", "windows", "repeats")
