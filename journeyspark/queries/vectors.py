"""Queries over embeddings and predictions: neighbours, resampling, segmentation, measures, models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from journeyspark.functions import metrics
from journeyspark.functions.draws import uniform, uniform_sql
from journeyspark.operators import cluster, components, journey, kmeans, neighbors, resample, splits
from journeyspark.plans import backoff, boosting, calibration, context_tree, models, search

from .tables import POSITIONS, clicks, table

Q: dict = {}
#: Radii for whole embeddings, which have length 1: unrelated ones are about 1.4 apart.
EPS_JOIN, ASSIGN = 1.15, 1.15


def q(sql: str | None = None):
    return lambda f: Q.setdefault(f.__name__, (f, sql))[0]


def vecs(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("v"))


def _round(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else c for c in df.columns])


VECS = "vecs AS (SELECT vec_id AS id, label AS y, embedding::DOUBLE[] AS v FROM embeddings)"
PAIRS = VECS + ", pairs AS (SELECT a.id, a.y, b.id AS nb, b.y AS nby, list_distance(a.v, b.v) AS d FROM vecs a JOIN vecs b ON a.id <> b.id)"
_NEAR = lambda cond, k: f"(SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS rn FROM pairs WHERE {cond} QUALIFY rn <= {k})"
NOISE_SQL = uniform_sql(3, "vec_id", "p")


@q("SELECT label AS y, count(*) AS n FROM embeddings GROUP BY 1")
def class_counts(s, d):
    return vecs(s, d).groupBy("y").agg(F.count("*").alias("n"))


@q("SELECT o_custkey % 700 AS y, count(*) AS n, count(*) >= 25 AS kept FROM orders GROUP BY 1")
def rare_classes(s, d):
    return splits.rare_classes(table(s, d, "orders").select((F.col("o_custkey") % 700).alias("y")), "y", 25)


_H = f"SELECT vec_id AS id, label AS y, row_number() OVER (PARTITION BY label ORDER BY {uniform_sql(1, 'vec_id', '%s')}, vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings"


@q(f"SELECT id, rn <= greatest(round(n * 0.2), 1) AS is_test FROM ({_H % 'holdout'})")
def holdout(s, d):
    return splits.holdout(vecs(s, d), "y", "id").select("id", "is_test")


@q(f"SELECT id, CASE WHEN rn <= round(n * 0.7) THEN 'train' WHEN rn <= round(n * 0.85) THEN 'val' ELSE 'test' END AS part FROM ({_H % 'parts'})")
def three_way(s, d):
    return splits.three_way(vecs(s, d), "y", "id").select("id", "part")


@q(f"SELECT h.id, ((off + rn - 1) % 5)::INT AS fold FROM ({_H % 'folds'}) h JOIN (SELECT y, coalesce(sum(c) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT label AS y, count(*) AS c FROM embeddings GROUP BY 1)) o USING (y)")
def folds(s, d):
    return splits.folds(vecs(s, d), "y", "id").select("id", "fold")


@q("SELECT y, n, round((sum(n) OVER () / (count(*) OVER () * n)) / avg_raw, 6) AS weight FROM (SELECT *, avg(total / (k * n)) OVER () AS avg_raw FROM (SELECT label AS y, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS k FROM embeddings GROUP BY 1))")
def class_weights(s, d):
    return _round(metrics.class_weights(vecs(s, d), "y"), "weight")


@q(f"WITH {PAIRS} SELECT id, nb AS neighbour, rn::INT AS rank, round(d, 6) AS distance FROM {_NEAR('true', 5)}")
def knn_join(s, d):
    v = vecs(s, d)
    return _round(neighbors.knn_join(v, v, 5), "distance")


@q(f"WITH {PAIRS} SELECT id, nb AS neighbour, rn::INT AS rank, round(d, 6) AS distance FROM {_NEAR('y = nby', 5)}")
def knn_same_class(s, d):
    v = vecs(s, d)
    return _round(neighbors.knn_join(v, v, 5, within="y"), "distance")


@q(f"WITH {VECS} SELECT a.id, b.id AS neighbour, round(list_distance(a.v, b.v), 6) AS distance FROM vecs a JOIN vecs b ON list_distance(a.v, b.v) <= {EPS_JOIN}")
def eps_join(s, d):
    v = vecs(s, d)
    return _round(neighbors.eps_join(v, EPS_JOIN), "distance")


_BASE = f"base AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {uniform_sql(1, 'id', 'turn')}, id) AS at FROM vecs), need AS (SELECT y, n, max(n) OVER () - n AS need FROM (SELECT y, count(*) AS n FROM vecs GROUP BY y))"


def _new_sql(draws: str) -> str:
    """draws: (y, base, key, at)."""
    return f"""newp AS (SELECT p.y, p.num, a.id AS base, b.id AS neighbour, {uniform_sql(1, 'p.key', 'gap')} AS g, a.v AS va, b.v AS vb FROM ({draws}) p JOIN vecs a ON a.id = p.base
 JOIN (SELECT id, max(rn) AS have FROM {_NEAR('y = nby', 5)} GROUP BY id) h ON h.id = p.base
 JOIN {_NEAR('y = nby', 5)} nn ON nn.id = p.base AND nn.rn = floor({uniform_sql(1, 'p.key', 'neighbour')} * have) + 1 JOIN vecs b ON b.id = nn.nb)"""


_SMOTE = f"""WITH {PAIRS}, {_BASE}, slots AS (SELECT y, n, s, y::VARCHAR || '-' || s::VARCHAR AS key, row_number() OVER (ORDER BY y, s) - 1 AS num FROM (SELECT *, unnest(range(0, need)) AS s FROM need WHERE need > 0 AND n >= 2)),
{_new_sql(f"SELECT k.y, b.id AS base, key, k.num FROM slots k JOIN base b ON b.y = k.y AND b.at = floor({uniform_sql(1, 'key', 'base')} * n) + 1")},
grown AS (SELECT id, y, v FROM vecs UNION ALL SELECT -num - 1, y, list_transform(list_zip(va, vb), lambda p: p[1] + g * (p[2] - p[1])) FROM newp)"""


@q(f"{_SMOTE} SELECT id, y, round(list_sum(v), 6) AS total FROM grown")
def smote(s, d):
    return resample.smote(vecs(s, d)).select("id", "y", F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


_LINKS = lambda src: f"""tp AS (SELECT a.id, a.y, b.id AS nb, b.y AS nby, list_distance(a.v, b.v) AS d FROM {src} a JOIN {src} b ON a.id <> b.id),
crossn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS rn FROM tp WHERE y <> nby QUALIFY rn = 1), own AS (SELECT id, min(d) AS o FROM tp WHERE y = nby GROUP BY id),
links AS (SELECT c.id AS a, c.nb AS b, c.d, coalesce(x.o, 'inf'::DOUBLE) AS oa, coalesce(z.o, 'inf'::DOUBLE) AS ob FROM crossn c LEFT JOIN own x ON x.id = c.id LEFT JOIN own z ON z.id = c.nb)"""  # noqa: E731


@q(f"WITH {VECS}, {_LINKS('vecs')} SELECT id, y FROM vecs WHERE id NOT IN (SELECT a FROM links WHERE d <= oa OR d <= ob UNION SELECT b FROM links WHERE d <= oa OR d <= ob)")
def tomek(s, d):
    return resample.drop_tomek(vecs(s, d)).select("id", "y")


@q(f"WITH {VECS}, {_LINKS('vecs')} SELECT l.a, l.b FROM links l JOIN crossn c ON c.id = l.b AND c.nb = l.a WHERE l.d <= oa AND l.d <= ob")
def tomek_mutual(s, d):
    return resample.tomek_links(vecs(s, d), "mutual")


_ADA = f"""near AS (SELECT id, y, nby, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS rn FROM (SELECT id, y, nb, nby, d FROM pairs UNION ALL SELECT id, y, id, y, 0.0 FROM vecs) QUALIFY rn <= 5),
top AS (SELECT y AS top FROM vecs GROUP BY y ORDER BY count(*) DESC, y LIMIT 1), hard AS (SELECT id, near.y, avg((nby = top)::INT) AS difficulty FROM near, top GROUP BY id, near.y),
bud AS (SELECT h.id, h.y, difficulty, floor(CASE WHEN sum(difficulty) OVER w > 0 THEN difficulty / sum(difficulty) OVER w ELSE 1.0 / count(*) OVER w END * need + 1e-9)::BIGINT AS budget FROM hard h JOIN need USING (y) WHERE need > 0 WINDOW w AS (PARTITION BY h.y))"""


@q(f"WITH {PAIRS}, {_BASE}, {_ADA} SELECT id, y, round(difficulty, 6) AS difficulty, budget FROM bud")
def adasyn_budget(s, d):
    return _round(resample.adasyn_budget(vecs(s, d)), "difficulty")


_ADA_DRAWS = "SELECT y, id AS base, y::VARCHAR || '-' || id::VARCHAR || '-' || i::VARCHAR AS key, row_number() OVER (ORDER BY y, id, i) - 1 AS num FROM (SELECT y, id, unnest(range(0, budget)) AS i FROM bud WHERE budget > 0)"


@q(f"WITH {PAIRS}, {_BASE}, {_ADA}, {_new_sql(_ADA_DRAWS)} SELECT id, y, round(list_sum(v), 6) AS total FROM vecs UNION ALL SELECT -num - 1, y, round(list_sum(va) + g * (list_sum(vb) - list_sum(va)), 6) FROM newp")
def adasyn(s, d):
    return resample.adasyn(vecs(s, d)).select("id", "y", F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@q(f"{_SMOTE}, {_LINKS('grown')} SELECT y, count(*) AS n FROM grown WHERE id NOT IN (SELECT a FROM links WHERE d <= oa OR d <= ob UNION SELECT b FROM links WHERE d <= oa OR d <= ob) GROUP BY y")
def smote_tomek(s, d):
    return resample.smote_tomek(vecs(s, d))[0].groupBy("y").agg(F.count("*").alias("n"))


_CURVE = f"curve AS (SELECT id, max(d) AS distance FROM {_NEAR('true', 10)} GROUP BY id)"


@q(f"WITH {PAIRS}, {_CURVE} SELECT id, round(distance, 6) AS distance FROM curve")
def k_distance(s, d):
    return _round(cluster.k_distances(vecs(s, d), 10), "distance")


@q(f"WITH {PAIRS}, {_CURVE}, e AS (SELECT quantile_cont(distance, [0.7, 0.75, 0.8, 0.85, 0.9]) AS e FROM curve) SELECT unnest([70, 75, 80, 85, 90])::INT AS percent, round(unnest(e), 6) AS eps FROM e")
def eps_percentiles(s, d):
    return _round(cluster.eps_candidates(cluster.k_distances(vecs(s, d), 10)), "eps")


@q(f"""WITH {PAIRS}, {_CURVE}, x AS (SELECT unnest(quantile_cont(distance, [{', '.join(f'{i}.0/999' for i in range(1000))}])) AS y, unnest(range(0, 1000)) AS i FROM curve),
u AS (SELECT y, i, i / 999.0 - CASE WHEN max(y) OVER () > min(y) OVER () THEN (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) ELSE 0 END AS gain FROM x) SELECT round(y, 6) AS eps FROM u ORDER BY gain DESC LIMIT 1""")
def knee_eps(s, d):
    return _round(cluster.knee(cluster.k_distances(vecs(s, d), 10)), "eps")


_EPS, _MIN = 1.2, 8
_DB = f"""near AS (SELECT a.id, b.id AS nb FROM vecs a JOIN vecs b ON list_distance(a.v, b.v) <= {_EPS}), core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= {_MIN}),
link AS (SELECT id, nb FROM near WHERE id IN (FROM core) AND nb IN (FROM core)),
walk AS (SELECT id, nb AS r FROM link UNION SELECT w.id, l.nb FROM walk w JOIN link l ON l.id = w.r),
comp AS (SELECT id, min(r) AS root FROM walk GROUP BY id), named AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS c FROM comp),
reach AS (SELECT n.id, min(c) AS c FROM near n JOIN named m ON m.id = n.nb GROUP BY n.id)"""


@q(f"WITH RECURSIVE {VECS}, {_DB} SELECT v.id, m.id IS NOT NULL AS is_core, coalesce(m.c, r.c, -1)::INT AS label FROM vecs v LEFT JOIN named m USING (id) LEFT JOIN reach r USING (id)")
def dbscan(s, d):
    return cluster.dbscan(vecs(s, d), _EPS, _MIN)


@q(f"WITH {VECS}, near AS (SELECT a.id, b.id AS nb FROM vecs a JOIN vecs b ON list_distance(a.v, b.v) <= {_EPS}), core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= {_MIN}) SELECT (SELECT count(*) FROM core) AS cores, count(*) FILTER (id NOT IN (SELECT id FROM near WHERE nb IN (FROM core))) AS noise FROM vecs")
def dbscan_core_noise(s, d):
    return cluster.dbscan_summary(cluster.dbscan(vecs(s, d), _EPS, _MIN)).select("cores", "noise")


_LAB = "lab AS (SELECT vec_id AS id, label % 3 AS label, embedding::DOUBLE[] AS v FROM embeddings)"
_CEN = f"""{_LAB}, parts AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM lab), means AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY 1, 2), cen AS (SELECT label, list(m ORDER BY i) AS c FROM means GROUP BY 1)"""


def lab(s, d):
    return vecs(s, d).withColumn("label", F.col("y") % 3)


@q(f"WITH {_LAB}, t AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n FROM lab a JOIN lab b ON true GROUP BY 1, 2, 3), s AS (SELECT id, max(total / (n - 1)) FILTER (label = other AND n > 1) AS a, min(total / n) FILTER (label <> other) AS b FROM t GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s")
def silhouette(s, d):
    return _round(cluster.silhouette(lab(s, d)), "silhouette")


@q(f"WITH {_CEN}, sp AS (SELECT l.label, avg(list_distance(v, c)) AS s, any_value(c) AS c FROM lab l JOIN cen USING (label) GROUP BY 1), r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM sp a JOIN sp b ON a.label <> b.label GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin(s, d):
    return _round(cluster.davies_bouldin(lab(s, d)), "davies_bouldin")


@q(f"""WITH {_CEN}, n AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), g AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(x) AS m FROM parts GROUP BY 1)),
b AS (SELECT sum(n * power(list_distance(c, mean), 2)) / (count(*) - 1) AS b, count(*) AS k, sum(n) AS t FROM cen JOIN n USING (label), g), w AS (SELECT sum(power(list_distance(v, c), 2)) AS w FROM lab JOIN cen USING (label))
SELECT round(b / (w / (t - k)), 4) AS calinski_harabasz FROM b, w""")
def calinski_harabasz(s, d):
    return _round(cluster.calinski_harabasz(lab(s, d)), "calinski_harabasz", n=4)


@q("""WITH c AS (SELECT label % 3 AS a, label % 4 AS b, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS bb, sum(n) AS n FROM c), x AS (SELECT sum(m * (m - 1) / 2) AS ia FROM (SELECT a, sum(n) AS m FROM c GROUP BY a)),
z AS (SELECT sum(m * (m - 1) / 2) AS ib FROM (SELECT b, sum(n) AS m FROM c GROUP BY b)) SELECT round((bb - ia * ib / (n * (n - 1) / 2)) / ((ia + ib) / 2 - ia * ib / (n * (n - 1) / 2)), 6) AS ari FROM t, x, z""")
def ari(s, d):
    v = vecs(s, d)
    return _round(cluster.adjusted_rand(v.select("id", (F.col("y") % 3).alias("label")), v.select("id", (F.col("y") % 4).alias("label"))), "ari")


@q(f"WITH {VECS}, n AS (SELECT a.id, b.id AS core, b.y, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rn FROM vecs a JOIN vecs b ON a.id % 2 = 1 AND b.id % 2 = 0 QUALIFY rn = 1) SELECT id, CASE WHEN d > {ASSIGN} THEN -1 ELSE y END AS label, d > {ASSIGN} AS is_noise, round(d, 6) AS distance FROM n")
def assign_cluster(s, d):
    v = vecs(s, d)
    cores = v.where("id % 2 = 0").select("id", "v", F.col("y").alias("label"), F.col("y").alias("dbscan_label"))
    return _round(cluster.assign(v.where("id % 2 = 1"), cores, ASSIGN), "distance")


@q("SELECT count(*) * count(*) * 8 AS dense, count(*) * 240 AS sparse FROM embeddings")
def affinity_footprint(s, d):
    n = F.count("*")
    f = cluster.affinity_footprint(1, 10)
    return vecs(s, d).agg((n * n * f["dense"]).alias("dense"), (n * f["sparse"]).alias("sparse"))


@q()
def kmeans_segments(s, d):
    return cluster.kmeans(vecs(s, d), 3).groupBy("label").agg(F.count("*").alias("n"))


@q()
def spectral_segments(s, d):
    return cluster.spectral(vecs(s, d), 3).groupBy("label").agg(F.count("*").alias("n"))


@q(f"""WITH {PAIRS}, near AS {_NEAR('true', 10)}, half AS (SELECT id, nb, count(*) / 2 AS w FROM (SELECT id, nb FROM near UNION ALL SELECT nb, id FROM near) GROUP BY ALL UNION ALL SELECT id, id, 1.0 FROM vecs),
deg AS (SELECT id, sum(w) AS degree FROM half GROUP BY id) SELECT h.id, h.nb AS neighbour, a.degree::DOUBLE AS degree, round(h.w / sqrt(a.degree * b.degree), 6) AS w FROM half h JOIN deg a ON a.id = h.id JOIN deg b ON b.id = h.nb""")
def neighbour_graph(s, d):
    """Degrees and weights of the graph that spectral clustering works on."""
    return _round(cluster.neighbour_graph(vecs(s, d)), "w")


@q()
def k_probe(s, d):
    return cluster.k_probe(vecs(s, d))


_CENTRES = "cen AS (SELECT id AS label, v AS c FROM vecs WHERE id < 3)"


@q(f"""WITH {VECS}, {_CENTRES}, near AS (SELECT id, v, label, list_distance(v, c) AS d FROM vecs, cen QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(v, c), label) = 1)
SELECT label::INT AS label, count(*) AS n, round(sum(d * d), 4) AS cost, round(sum(list_sum(v)), 4) AS total FROM near GROUP BY 1""")
def kmeans_step(s, d):
    """One round of k-means from given centres (the first three vectors): rows, cost and sum of each cluster."""
    v = vecs(s, d)
    c = [np.array(r["v"]) for r in v.where("id < 3").orderBy("id").collect()]
    got = kmeans.assignment_sums(v, [np.stack(c)]).where("n > 0")
    return _round(got.select("label", "n", "cost", F.aggregate("total", F.lit(0.0), lambda a, x: a + x).alias("total")), "cost", "total", n=4)


@q()
def pca_projection(s, d):
    return cluster.project(vecs(s, d))


@q(f"WITH {VECS}, parts AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs), m AS (SELECT i, avg(x) AS m FROM parts GROUP BY i) SELECT id, round(sqrt(sum(power(x - m, 2))), 6) AS size FROM parts JOIN m USING (i) GROUP BY id")
def pca_sizes(s, d):
    """Along all axes a row is as long as its way from the mean."""
    v = vecs(s, d)
    p = components.apply_components(v, components.principal_components(v))
    return p.select("id", F.round(F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("size"))


@q(f"""WITH {VECS}, parts AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs), c AS (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS c FROM parts), n AS (SELECT count(*) AS n FROM vecs),
cov AS (SELECT a.i, b.i AS j, sum(a.c * b.c) / (any_value(n) - 1) AS v FROM c a JOIN c b USING (id), n GROUP BY ALL)
SELECT count(*) FILTER (i = j) AS components, round(sum(v) FILTER (i = j), 6) AS total, round(sqrt(sum(v * v)), 6) AS size FROM cov""")
def pca_variances(s, d):
    """Explained variances sum to the covariance's trace, their squares to the square of its size."""
    got = components.principal_components(vecs(s, d)).variances
    return vecs(s, d).agg(F.max(F.size("v")).cast("long").alias("components")).select("components", F.round(F.lit(float(got.sum())), 6).alias("total"), F.round(F.lit(float((got**2).sum() ** 0.5)), 6).alias("size"))


# Predictions: the label, wrong where a hash says so, with probabilities that lean to it.


def preds(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y_true"))
    v = v.withColumn("u", uniform(3, F.col("id"), "p")).withColumn("y_pred", F.when(F.col("u") < 0.3, (F.col("y_true") + 1 + F.floor(F.col("u") * 30).cast("int") % 3) % 10).otherwise(F.col("y_true")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("y_pred"), 0.4).otherwise(0.0) + F.round((F.col("id") * (i + 3) % 17) / 17.0, 3))
    return v.select("id", "y_true", "y_pred", raw.alias("probs"))


PREDS = f"""p0 AS (SELECT vec_id AS id, label AS y_true, {NOISE_SQL} AS u FROM embeddings), preds AS (SELECT id, y_true, (CASE WHEN u < 0.3 THEN (y_true + 1 + floor(u * 30)::INT % 3) % 10 ELSE y_true END)::INT AS y_pred FROM p0),
long AS (SELECT id, y_true, i AS label, CASE WHEN i = y_pred THEN 0.4 ELSE 0.0 END + round((id * (i + 3) % 17) / 17.0, 3) AS prob FROM preds, (SELECT unnest(range(0, 10))::INT AS i)),
cm AS (SELECT y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL), t AS (SELECT y_true AS label, sum(n) AS support, sum(n) FILTER (y_true = y_pred) AS hit FROM cm GROUP BY 1), pr AS (SELECT y_pred AS label, sum(n) AS predicted FROM cm GROUP BY 1),
r0 AS (SELECT label, coalesce(hit, 0) AS hit, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted FROM t FULL JOIN pr USING (label)),
r1 AS (SELECT label, support, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM r0),
rep AS (SELECT label, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, support::BIGINT AS support FROM r1)"""
TEN = list(range(10))


@q(f"WITH {PREDS} SELECT round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM preds")
def accuracy(s, d):
    return _round(metrics.accuracy(preds(s, d)), "accuracy")


@q("SELECT round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels")
def accuracy_binary(s, d):
    return _round(metrics.accuracy(table(s, d, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))), "accuracy")


@q(f"WITH {PREDS} SELECT round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro, round(avg(f), 6) AS f1_macro FROM rep")
def prf_macro(s, d):
    return _round(metrics.macro(preds(s, d)), "precision_macro", "recall_macro", "f1_macro")


@q(f"WITH {PREDS} SELECT round(sum(p * support) / sum(support), 6) AS precision_weighted, round(sum(r * support) / sum(support), 6) AS recall_weighted, round(sum(f * support) / sum(support), 6) AS f1_weighted FROM rep")
def prf_weighted(s, d):
    return _round(metrics.weighted(preds(s, d)), "precision_weighted", "recall_weighted", "f1_weighted")


@q(f"WITH {PREDS} SELECT round(avg(r), 6) AS balanced_accuracy FROM rep WHERE support > 0")
def balanced_accuracy(s, d):
    return _round(metrics.balanced_accuracy(preds(s, d)), "balanced_accuracy")


@q(f"WITH {PREDS} SELECT round(avg(h), 6) AS top_k FROM (SELECT id, max((label = y_true)::INT) AS h FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, label) AS rn FROM long) WHERE rn <= 3 GROUP BY id)")
def topk_hit(s, d):
    return _round(metrics.top_k_hits(preds(s, d), TEN), "top_k")


@q(f"WITH {PREDS}, k AS (SELECT label, (label = y_true)::INT AS pos, rank() OVER (PARTITION BY label ORDER BY prob) + (count(*) OVER (PARTITION BY label, prob) - 1) / 2.0 AS rk FROM long), a AS (SELECT label, (sum(rk) FILTER (pos = 1) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (count(*) - sum(pos))) AS auc FROM k GROUP BY label HAVING sum(pos) > 0 AND sum(pos) < count(*)) SELECT round(avg(auc), 6) AS roc_auc FROM a")
def roc_auc(s, d):
    return _round(metrics.roc_auc(preds(s, d), TEN), "roc_auc")


@q(f"WITH {PREDS}, g AS (SELECT label, prob, count(*) AS n, sum((label = y_true)::INT) AS np FROM long GROUP BY 1, 2), c AS (SELECT label, np, sum(np) OVER w AS tp, sum(n) OVER w AS seen, sum(np) OVER (PARTITION BY label) AS al FROM g WINDOW w AS (PARTITION BY label ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)) SELECT round(avg(ap), 6) AS pr_auc FROM (SELECT label, sum(np / al * tp / seen) AS ap FROM c WHERE al > 0 GROUP BY label)")
def pr_auc(s, d):
    return _round(metrics.pr_auc(preds(s, d), TEN), "pr_auc")


@q(f"WITH {PREDS} SELECT * FROM cm")
def confusion(s, d):
    return metrics.confusion(preds(s, d))


@q(f"WITH {PREDS}, r AS (SELECT label::VARCHAR AS label, p, r, f, support FROM rep), s AS (SELECT sum(support)::BIGINT AS n FROM rep) SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM (FROM r UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT avg((y_true = y_pred)::INT) AS a FROM preds), s UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), any_value(n) FROM r, s UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), any_value(n) FROM r, s)")
def class_report(s, d):
    return _round(metrics.full_report(preds(s, d)), "precision", "recall", "f1")


@q(f"WITH {PREDS} SELECT * FROM cm WHERE y_true <> y_pred ORDER BY n DESC, y_true, y_pred LIMIT 20")
def top_confusions(s, d):
    return metrics.top_confusions(preds(s, d))


_BAND = "CASE WHEN id % 60 <= 0 THEN NULL WHEN id % 60 <= 5 THEN '(0, 5]' WHEN id % 60 <= 15 THEN '(5, 15]' WHEN id % 60 <= 40 THEN '(15, 40]' WHEN id % 60 <= 100 THEN '(40, 100]' END"


@q(f"WITH {PREDS} SELECT band, count(*) AS n, round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM (SELECT *, {_BAND} AS band FROM preds) WHERE band IS NOT NULL GROUP BY band")
def banded_accuracy(s, d):
    return _round(metrics.banded_accuracy(preds(s, d).withColumn("seq_len", F.col("id") % 60), "seq_len"), "accuracy")


@q(f"WITH {PREDS} SELECT id % 4 AS segment, count(*) AS n, round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM preds GROUP BY 1")
def grouped_accuracy(s, d):
    return _round(metrics.grouped_accuracy(preds(s, d).withColumn("segment", F.col("id") % 4), "segment"), "accuracy")


@q(f"WITH {PREDS} SELECT (y_true = y_pred)::INT AS correct, count(*) AS n, round(avg(id % 60), 6) AS seq_len FROM preds GROUP BY 1")
def error_profile(s, d):
    return _round(metrics.error_profile(preds(s, d).withColumn("seq_len", F.col("id") % 60), ["seq_len"]), "seq_len")


@q(f"WITH x AS ({_H % 'holdout'}), p AS (SELECT *, rn <= greatest(round(n * 0.2), 1) AS is_test FROM x), top AS (SELECT y FROM p WHERE NOT is_test GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) SELECT id, p.y AS y_true, top.y AS y_pred FROM p, top WHERE is_test")
def majority_baseline(s, d):
    h = splits.holdout(vecs(s, d), "y", "id")
    return metrics.majority_baseline(h.where("not is_test"), h.where("is_test").select("id", F.col("y").alias("y_true")), "y")


@q(f"WITH {PREDS}, b AS (SELECT 'noisy' AS model, avg((y_true = y_pred)::INT) AS a FROM preds UNION ALL SELECT 'shifted', avg((y_true = (y_pred + 1) % 10)::INT) FROM preds) SELECT model, round(a, 6) AS accuracy FROM b")
def comparison_table(s, d):
    p = preds(s, d)
    q_ = p.withColumn("y_pred", (F.col("y_pred") + 1) % 10)
    return _round(metrics.accuracy(p).withColumn("model", F.lit("noisy")).unionByName(metrics.accuracy(q_).withColumn("model", F.lit("shifted"))), "accuracy")


@q(f"""WITH {PREDS}, k AS (SELECT id, label, prob, row_number() OVER (PARTITION BY id ORDER BY prob DESC, label) AS rn FROM (SELECT id, label, prob / sum(prob) OVER (PARTITION BY id) AS prob FROM long))
SELECT id, array_to_string(list('Channel #' || label::VARCHAR ORDER BY rn) FILTER (rn <= 3), ',') AS names, round(100 * sum(prob) FILTER (rn <= 3), 4) AS confidence, count(*) FILTER (rn > 3) AS n_tail FROM k GROUP BY id""")
def rank_channels(s, d):
    p = preds(s, d).select("id", F.transform("probs", lambda x: x / F.aggregate("probs", F.lit(0.0), lambda a, b: a + b)).alias("probs"))
    r = models.rank_channels(p, TEN)
    return r.select("id", F.array_join(F.transform("top", lambda x: x["name"]), ",").alias("names"), F.round("confidence", 4).alias("confidence"), "n_tail")


_EX = f"ex AS (SELECT user_id AS id, max(touch) FILTER (rn = 1) AS target, coalesce(max(touch) FILTER (rn = 2), 0) AS step2, coalesce(max(touch) FILTER (rn = 3), 0) AS step3 FROM pos GROUP BY user_id), tr AS (SELECT * FROM ex WHERE {uniform_sql(5, 'id', 'train')} < 0.7)"


@q(f"""WITH {POSITIONS}, {_EX}, c0 AS (SELECT target, (count(*) + 1.0) / (sum(count(*)) OVER () + count(*) OVER ()) AS p0 FROM tr GROUP BY 1), c1 AS (SELECT step2, target, count(*) AS n FROM tr GROUP BY ALL), a1 AS (SELECT step2, count(*) AS n1 FROM tr GROUP BY 1),
c2 AS (SELECT step3, step2, target, count(*) AS n FROM tr GROUP BY ALL), a2 AS (SELECT step3, step2, count(*) AS n2 FROM tr GROUP BY ALL)
SELECT ex.id, c0.target, round((coalesce(c2.n, 0) + 5 * (coalesce(c1.n, 0) + 5 * p0) / (coalesce(n1, 0) + 5)) / (coalesce(n2, 0) + 5), 6) AS prob FROM ex CROSS JOIN c0 LEFT JOIN c1 ON c1.step2 = ex.step2 AND c1.target = c0.target LEFT JOIN a1 ON a1.step2 = ex.step2
 LEFT JOIN c2 ON c2.step3 = ex.step3 AND c2.step2 = ex.step2 AND c2.target = c0.target LEFT JOIN a2 ON a2.step3 = ex.step3 AND a2.step2 = ex.step2""")
def backoff_rank(s, d):
    ex = journey.last_two(journey.build_examples(journey.build_events(clicks(s, d)))).withColumnRenamed("user_id", "id")
    fitted = backoff.fit(ex.where(uniform(5, F.col("id"), "train") < 0.7))
    return _round(backoff.score(ex.select("id", "step2", "step3"), fitted), "prob")


def _tree_sql(depth: int = 5, least: int = 2, weight: float = 5.0) -> str:
    """CTEs occ, g1.. (gains), kept (depth, context) and pall (depth, context, target, c, prob) of a context tree over the training users."""
    name = lambda l: "''" if l == 0 else "concat_ws(',', " + ", ".join(f"l{i}" for i in range(1, l + 1)) + ")"  # noqa: E731, E741
    past = ", ".join(f"lead(touch, {i}) OVER w AS l{i}" for i in range(1, depth + 1))
    parts = [f"occ AS (SELECT * FROM (SELECT user_id AS id, rn, touch AS target, {past} FROM pos WINDOW w AS (PARTITION BY user_id ORDER BY rn)) WHERE {uniform_sql(5, 'id', 'train')} < 0.7)"]
    for l in range(depth + 1):  # noqa: E741
        has = "" if l == 0 else f" WHERE l{l} IS NOT NULL"
        parent = name(l - 1) if l else "NULL::VARCHAR"
        few = "" if l == 0 else f" WHERE n >= {least}"
        parts.append(f"c{l} AS (SELECT * FROM (SELECT context, parent, target, c, sum(c) OVER (PARTITION BY context) AS n FROM (SELECT {name(l)} AS context, {parent} AS parent, target, count(*) AS c FROM occ{has} GROUP BY ALL)){few})")
        if l:
            parts.append(f"g{l} AS (SELECT a.context, a.parent, max(a.n) AS n, sum(a.c * ln(a.c / a.n / (b.c / b.n))) AS gain FROM c{l} a JOIN c{l - 1} b ON b.context = a.parent AND b.target = a.target GROUP BY ALL)")
    for l in range(depth, 0, -1):  # noqa: E741
        needed = f" OR context IN (SELECT parent FROM k{l + 1})" if l < depth else ""
        parts.append(f"k{l} AS (SELECT * FROM g{l} WHERE gain >= (SELECT (count(*) - 1) / 2.0 * ln(sum(c)) FROM c0){needed})")
    parts.append("p0 AS (SELECT 0 AS depth, '' AS context, target, c, (c + 1.0) / (sum(c) OVER () + count(*) OVER ()) AS prob FROM c0)")
    for l in range(1, depth + 1):  # noqa: E741
        parts.append(f"p{l} AS (SELECT {l} AS depth, k.context, p.target, coalesce(c.c, 0) AS c, (coalesce(c.c, 0) + {weight} * p.prob) / (k.n + {weight}) AS prob FROM k{l} k JOIN p{l - 1} p ON p.context = k.parent LEFT JOIN c{l} c ON c.context = k.context AND c.target = p.target)")
    parts.append("pall AS (" + " UNION ALL ".join(f"SELECT * FROM p{l}" for l in range(depth + 1)) + ")")  # noqa: E741
    return ", ".join(parts)


def _journeys(s, d):
    return journey.build_examples(journey.build_events(clicks(s, d))).withColumnRenamed("user_id", "id")


@q(f"WITH {POSITIONS}, {_tree_sql()} SELECT depth::INT AS depth, context, target, c::BIGINT AS n, round(prob, 6) AS prob FROM pall")
def context_shares(s, d):
    """Kept contexts of up to five touches, with counts and blended shares of what follows, from the training users."""
    tree = context_tree.fit(_journeys(s, d).where(uniform(5, F.col("id"), "train") < 0.7))
    return _round(tree.shares.select("depth", "context", "target", F.col("c").alias("n"), "prob"), "prob")


_LAST = ", ".join(f"max(touch) FILTER (rn = {i + 1}) AS l{i}" for i in range(1, 6))
_CTX = " UNION ALL ".join(["SELECT id, 0 AS depth, '' AS context FROM now"] + ["SELECT id, %d, concat_ws(',', %s) FROM now WHERE l%d IS NOT NULL" % (i, ", ".join(f"l{j}" for j in range(1, i + 1)), i) for i in range(1, 6)])


@q(f"""WITH {POSITIONS}, {_tree_sql()}, now AS (SELECT user_id AS id, {_LAST} FROM pos GROUP BY user_id), ctx AS ({_CTX}),
best AS (SELECT id, max(x.depth) AS depth, arg_max(x.context, x.depth) AS context FROM ctx x JOIN (SELECT DISTINCT depth, context FROM pall) USING (depth, context) GROUP BY id)
SELECT id, target, round(prob, 6) AS prob FROM best JOIN pall USING (depth, context)""")
def context_rank(s, d):
    """Shares of every touch for every user's next one, from the longest kept context of the whole journey."""
    rows = _journeys(s, d)
    tree = context_tree.fit(rows.where(uniform(5, F.col("id"), "train") < 0.7))
    return _round(context_tree.score(rows, tree), "prob")


@q()
def logistic_holdout(s, d):
    h = splits.holdout(vecs(s, d), "y", "id").withColumn("y", F.col("y").cast("string"))
    model = models.fit(models.Candidate("logistic", models.ROSTER["logistic"].make), h.where("not is_test"))
    pred, labels = models.predict(model, h.where("is_test"))
    return pred.select("id", "y_true", "y_pred", F.round(F.array_max("probs"), 3).alias("top_prob"))


@q(f"SELECT id, rn <= greatest(round(n * 0.12), 1) AS is_stop FROM ({_H % 'holdout'})")
def inner_slice(s, d):
    return splits.holdout(vecs(s, d), "y", "id", 0.12).select("id", F.col("is_test").alias("is_stop"))


@q(f"SELECT part, count(*) AS n FROM (SELECT CASE WHEN rn <= round(n * 0.7) THEN 'train' WHEN rn <= round(n * 0.85) THEN 'val' ELSE 'test' END AS part FROM ({_H % 'parts'})) GROUP BY 1")
def split_sizes(s, d):
    return splits.three_way(vecs(s, d), "y", "id").groupBy("part").agg(F.count("*").alias("n"))


@q(f"""WITH {PREDS}, f AS (SELECT id % 3 AS fold, y_true, y_pred FROM preds), c AS (SELECT fold, count(*) FILTER (y_true = y_pred) / count(*) AS a FROM f GROUP BY 1)
SELECT round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS spread FROM c""")
def fold_spread(s, d):
    per = metrics.grouped_accuracy(preds(s, d).withColumn("fold", F.col("id") % 3), "fold")
    return per.agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_pop("accuracy"), 6).alias("spread"))


def _f1_sql(rows: str) -> str:
    """Macro F1 of a relation (y_true, y_pred)."""
    return f"""(SELECT avg(CASE WHEN t + p > 0 THEN 2.0 * h / (t + p) ELSE 0 END) FROM (SELECT label, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM
 (SELECT y_true AS label, 1 AS t, 0 AS p, (y_true = y_pred)::INT AS h FROM {rows} UNION ALL SELECT y_pred, 0, 1, 0 FROM {rows}) GROUP BY label))"""


def _dealt_sql(block: str, r: int) -> str:
    at = lambda what: f"row_number() OVER (ORDER BY {uniform_sql(1, 'id', what)}, id)"
    return f"(SELECT a.y_true, b.y_pred FROM (SELECT y_true, {at(f'keep-{r}')} AS n FROM preds) a JOIN (SELECT y_pred, {at(f'{block}-{r}')} AS n FROM preds) b USING (n))"


@q(f"""WITH {PREDS}, base AS (SELECT {_f1_sql('preds')} AS f), fall AS (SELECT f - {_f1_sql(_dealt_sql('prediction', 0))} AS a, f - {_f1_sql(_dealt_sql('prediction', 1))} AS b FROM base)
SELECT 'prediction' AS block, round((a + b) / 2, 6) AS mean, round(abs(a - b) / 2, 6) AS std FROM fall UNION ALL SELECT 'noise', 0, 0""")
def permutation_importance(s, d):
    data = preds(s, d).select("id", "y_true", "y_pred", (F.col("id") % 7).alias("noise"))
    score = lambda x: metrics.macro(x.select("id", "y_true", "y_pred")).first()["f1_macro"]
    return _round(metrics.permutation_importance(data, score, {"prediction": ["y_pred"], "noise": ["noise"]}, "id", 2), "mean", "std")


@q(f"""WITH RECURSIVE {PAIRS}, curve AS (SELECT id, max(d) AS distance FROM {_NEAR('true', 8)} GROUP BY id), e AS (SELECT unnest(quantile_cont(distance, [0.7, 0.75, 0.8, 0.85, 0.9])) AS eps FROM curve),
near AS (SELECT eps, id, nb FROM pairs JOIN e ON d <= eps UNION ALL SELECT eps, id, id FROM vecs, e), core AS (SELECT eps, id FROM near GROUP BY ALL HAVING count(*) >= 8),
link AS (SELECT n.eps, n.id, n.nb FROM near n JOIN core a ON a.eps = n.eps AND a.id = n.id JOIN core b ON b.eps = n.eps AND b.id = n.nb),
walk AS (SELECT eps, id, nb AS r FROM link UNION SELECT w.eps, w.id, l.nb FROM walk w JOIN link l ON l.eps = w.eps AND l.id = w.r),
comp AS (SELECT eps, id, min(r) AS root FROM walk GROUP BY ALL), k AS (SELECT e.eps, count(DISTINCT root) AS clusters, count(c.id) AS cores FROM e LEFT JOIN comp c USING (eps) GROUP BY ALL),
z AS (SELECT e.eps, count(*) AS noise FROM vecs v, e WHERE NOT EXISTS (SELECT 1 FROM near n JOIN core c ON c.eps = n.eps AND c.id = n.nb WHERE n.eps = e.eps AND n.id = v.id) GROUP BY ALL),
t AS (SELECT k.*, coalesce(noise, 0) AS noise, clusters > 1 AND coalesce(noise, 0) > 0 AS good FROM k LEFT JOIN z USING (eps))
SELECT round(eps, 6) AS eps, clusters, noise, cores FROM t ORDER BY good DESC, CASE WHEN good THEN noise ELSE -cores END, eps LIMIT 1""")
def eps_selection(s, d):
    v = vecs(s, d)
    got = cluster.select_eps(v, [r["eps"] for r in cluster.eps_candidates(cluster.k_distances(v, 8)).collect()], 8)
    return v.agg(F.count("*")).select(F.round(F.lit(got["eps"]), 6).alias("eps"), *[F.lit(got[c]).cast("long").alias(c) for c in ("clusters", "noise", "cores")])


_SHARES = ", ".join(f"{i}.0/32" for i in range(1, 32))


@q(f"""WITH {VECS}, parts AS (SELECT id, y, unnest(v) AS x, generate_subscripts(v, 1)::INT - 1 AS f FROM vecs), cuts AS (SELECT f, list_distinct(quantile_cont(x, [{_SHARES}])) AS c FROM parts GROUP BY f),
b AS (SELECT y, p.f, len(list_filter(c, lambda q: q < x))::INT AS bin FROM parts p JOIN cuts USING (f)), share AS (SELECT y AS k, count(*) / (SELECT count(*) FROM vecs) AS p FROM vecs GROUP BY y),
hist AS (SELECT k, f, bin, sum(p - (y = k)::INT) AS g, sum(p * (1 - p)) AS h FROM b, share GROUP BY ALL),
s AS (SELECT *, sum(g) OVER r AS gl, sum(h) OVER r AS hl, sum(g) OVER t AS gt, sum(h) OVER t AS ht FROM hist WINDOW r AS (PARTITION BY k, f ORDER BY bin ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY k, f)),
w AS (SELECT k, f, bin, gl, hl, gt - gl AS gr, ht - hl AS hr, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM s WHERE hl >= 0.001 AND ht - hl >= 0.001)
SELECT k AS label, f, bin, round(gain, 6) AS gain, round(-gl / (hl + 1), 6) AS left_value, round(-gr / (hr + 1), 6) AS right_value FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(gain, 9) DESC, f, bin) = 1""")
def boost_round(s, d):
    """The first split of each class's first tree: quantile bins, gradients and curvatures of the softmax loss, Newton values of both sides."""
    rows = vecs(s, d).select(F.col("y").alias("label"), "v")
    trees = boosting.first_trees(rows, rows.agg(F.max("label")).first()[0] + 1)
    best = boosting.best_splits(boosting.histograms(boosting.prepared(rows, trees), trees))
    value = lambda g, h: -F.col(g) / (F.col(h) + 1)
    return _round(best.select(F.col("k").alias("label"), "f", "bin", "gain", value("gl", "hl").alias("left_value"), value("gr", "hr").alias("right_value")), "gain", "left_value", "right_value")


@q(f"""WITH {PREDS}, c AS (SELECT label, least(floor(prob * 4096), 4095)::INT AS bucket, count(*) AS n, count(*) FILTER (y_true = label) AS hits FROM long GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER w AS sn, sum(hits) OVER w AS sh FROM c WINDOW w AS (PARTITION BY label ORDER BY bucket ROWS UNBOUNDED PRECEDING)),
span AS (SELECT a.label, a.bucket AS lo, b.bucket AS hi, (b.sh - a.sh + a.hits) / (b.sn - a.sn + a.n) AS mean FROM sums a JOIN sums b ON a.label = b.label AND a.bucket <= b.bucket),
low AS (SELECT s.label, s.lo, c.bucket, min(mean) AS m FROM span s JOIN c ON c.label = s.label AND c.bucket BETWEEN s.lo AND s.hi GROUP BY ALL)
SELECT c.label, c.bucket, c.n, c.hits, round(max(m), 6) AS value FROM c JOIN low l ON l.label = c.label AND l.bucket = c.bucket GROUP BY ALL""")
def isotonic(s, d):
    """Pooled values of every score bucket of every class: the highest, over all starts, of the lowest mean from there on."""
    return _round(calibration.fit_isotonic(calibration.score_buckets(preds(s, d), TEN)), "value")


@q()
def forest_search(s, d):
    p = splits.three_way(vecs(s, d), "y", "id").withColumn("y", F.col("y").cast("string"))
    got = search.random_search(p.where("part = 'train'").drop("part"), p.where("part = 'val'").drop("part"))
    return s.createDataFrame([(r["name"], float(r["f1_macro"])) for r in got], "name string, f1_macro double")
