"""Vector expressions and exact similarity search on the given embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from antipode.functions import vectors as V
from antipode.operators import profiles as P
from antipode.operators import search as S
from antipode.plans.pair_queries import supplier_pairs
from antipode.plans.registry import query
from antipode.plans.standins import OUT_SQL, PAIRS_SQL, outcomes, table

DIM = 64


def vectors(spark, d):
    sign = F.when(F.col("label") % 3 == 1, 1.0).when(F.col("label") % 3 == 2, -1.0).otherwise(0.0)
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("entity_id"), F.col("embedding").cast("array<double>").alias("vec"), "label", sign.alias("sign"))


def centroids(spark, d):
    """Mean vector per label: one query per label, from the whole table."""
    v = vectors(spark, d)
    means = v.groupBy("label").agg(*[F.avg(F.col("vec")[i]).alias(f"x{i}") for i in range(DIM)])
    return means.select(F.col("label").cast("long").alias("query_id"), F.array(*[f"x{i}" for i in range(DIM)]).alias("vec"))


VEC_CTE = """
  v AS (SELECT vec_id AS entity_id, embedding::DOUBLE[] AS vec, label,
               CASE label % 3 WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sign FROM embeddings),
  u AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v),
  m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2),
  c AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS vec FROM m GROUP BY 1)"""

SIM_SQL = "round((list_cosine_similarity(q.vec, e.vec) + 1) / 2, 12)"

TOP_CTE = VEC_CTE + f""",
  s AS (SELECT query_id, entity_id, e.sign, {SIM_SQL} AS similarity FROM c q, v e),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entity_id)::INT AS rank FROM s)"""


def with_centroid(spark, d):
    c = centroids(spark, d).select(F.col("query_id").cast("int").alias("label"), F.col("vec").alias("center"))
    return vectors(spark, d).join(c, "label")


@query("cosine01", f"""
WITH {VEC_CTE} SELECT entity_id, round((list_cosine_similarity(vec, cv) + 1) / 2, 9) AS similarity
FROM v JOIN (SELECT query_id, vec AS cv FROM c) ON query_id = label""")
def cosine01(spark, d):
    return with_centroid(spark, d).select("entity_id", F.round(V.cosine01(F.col("vec"), F.col("center")), 9).alias("similarity"))


@query("divergence", f"""
WITH {VEC_CTE} SELECT entity_id, round(1 - (list_cosine_similarity(vec, cv) + 1) / 2, 9) AS div
FROM v JOIN (SELECT query_id, vec AS cv FROM c) ON query_id = label""")
def divergence(spark, d):
    rows = with_centroid(spark, d).select("entity_id", V.divergence(F.col("vec"), F.col("center")).alias("div"))
    return rows.where(F.col("div").isNotNull()).select("entity_id", F.round("div", 9).alias("div"))


@query("combine_vectors", f"""
WITH {VEC_CTE}, j AS (SELECT entity_id, vec AS a, cv AS b FROM v JOIN (SELECT query_id, vec AS cv FROM c) ON query_id = label),
 k AS (SELECT entity_id, a || b || list_transform(list_zip(a, b), lambda z: z[1] * z[2]) || list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])) AS w FROM j)
SELECT entity_id, (generate_subscripts(w, 1) - 1)::INT AS i, round(unnest(w), 9) AS x FROM k""")
def combine_vectors(spark, d):
    w = V.combine_vectors(F.col("vec"), F.col("center"))
    return with_centroid(spark, d).select("entity_id", F.posexplode(w).alias("i", "x")).withColumn("x", F.round("x", 9))


LANGS = ("de", "en", "fr")


@query("one_hot", """
SELECT doc_id, i::INT AS i, CASE WHEN lang = ['de', 'en', 'fr'][i + 1] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x
FROM documents, range(0, 3) t(i)""")
def one_hot(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(V.one_hot(F.col("lang"), LANGS)).alias("i", "x"))


@query("cosine_topk", f"""
WITH {TOP_CTE} SELECT query_id, entity_id, rank, round(similarity, 9) AS similarity FROM r WHERE rank <= 10""")
def cosine_topk(spark, d):
    return S.cosine_topk(centroids(spark, d), vectors(spark, d), 10).withColumn("similarity", F.round("similarity", 9))


@query("opposite_sign_topk", f"""
WITH {TOP_CTE}, b AS (SELECT query_id, sign AS bs FROM r WHERE rank = 1),
 o AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entity_id)::INT AS rank FROM s JOIN b USING (query_id) WHERE s.sign * bs < 0)
SELECT query_id, entity_id, rank, round(similarity, 9) AS similarity FROM o WHERE rank <= 10""")
def opposite_sign_topk(spark, d):
    return S.opposite_sign_topk(centroids(spark, d), vectors(spark, d), 10).withColumn("similarity", F.round("similarity", 9))


ALL_CTE = f"""
  v AS (SELECT vec_id AS entity_id, embedding::DOUBLE[] AS vec FROM embeddings),
  s AS (SELECT q.entity_id AS query_id, e.entity_id, {SIM_SQL} AS similarity FROM v q JOIN v e ON q.entity_id <> e.entity_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entity_id)::INT AS rank FROM s)"""


def self_queries(spark, d):
    return vectors(spark, d).select(F.col("entity_id").alias("query_id"), "vec")


@query("nearest_of_all", f"""
WITH {ALL_CTE} SELECT query_id, entity_id, rank, round(similarity, 9) AS similarity FROM r WHERE rank <= 3""")
def nearest_of_all(spark, d):
    """Every vector asks for its three nearest others, through the pivot cells."""
    found = S.cosine_topk(self_queries(spark, d), vectors(spark, d), 3, skip_self=True, way="cells")
    return found.withColumn("similarity", F.round("similarity", 9))


@query("nearest_in_tiles", f"""
WITH {ALL_CTE} SELECT query_id, entity_id, rank, round(similarity, 9) AS similarity FROM r WHERE rank <= 3""")
def nearest_in_tiles(spark, d):
    """As ``nearest_of_all``, through tiles with bounds from the first coordinates."""
    found = S.cosine_topk(self_queries(spark, d), vectors(spark, d), 3, skip_self=True, way="tiles")
    return found.withColumn("similarity", F.round("similarity", 9))


@query("search_effort")
def search_effort(spark, d):
    """What the tile search of every vector against all multiplies and skips."""
    return S.search_effort(self_queries(spark, d), vectors(spark, d), 3).select("pairs", F.round("skipped", 4).alias("skipped"))


@query("novelty", f"WITH {ALL_CTE} SELECT query_id, round(1 - similarity, 9) AS novelty FROM r WHERE rank = 1")
def novelty(spark, d):
    return S.novelty(self_queries(spark, d), vectors(spark, d), skip_self=True).withColumn("novelty", F.round("novelty", 9))


@query("precision_at_k", f"""
WITH {ALL_CTE}, x AS (SELECT entity_id AS query_id, xor(entity_id, 1) AS expected_id FROM v)
SELECT count(*) AS n_queries, round(avg(coalesce(rank <= 1, false)::DOUBLE), 9) AS precision_at_1,
       round(avg(coalesce(rank <= 30, false)::DOUBLE), 9) AS precision_at_30
FROM x LEFT JOIN r ON r.query_id = x.query_id AND r.entity_id = x.expected_id""")
def precision_at_k(spark, d):
    key = F.col("entity_id")
    expected = vectors(spark, d).select(key.alias("query_id"), key.bitwiseXOR(F.lit(1).cast("long")).alias("expected_id"))
    found = S.expected_ranks(self_queries(spark, d), vectors(spark, d), expected, 30)
    p = S.precision_at_k(found, expected, (1, 30))
    return p.select("n_queries", F.round("precision_at_1", 9).alias("precision_at_1"),
                    F.round("precision_at_30", 9).alias("precision_at_30"))


@query("discrimination_rate", f"""
WITH {VEC_CTE}, w AS (SELECT a.entity_id, list_cosine_similarity(a.vec, ca.vec) AS own, list_cosine_similarity(a.vec, cb.vec) AS other
  FROM v a JOIN c ca ON ca.query_id = a.label JOIN c cb ON cb.query_id = (a.label + 1) % 10)
SELECT count(*) AS n, round(avg((own > other)::DOUBLE), 9) AS rate FROM w""")
def discrimination_rate(spark, d):
    """Share of vectors closer to their own label's mean than to the next label's."""
    c = centroids(spark, d)
    other = c.select(F.col("query_id").alias("other_label"), F.col("vec").alias("other"))
    rows = with_centroid(spark, d).withColumn("other_label", ((F.col("label") + 1) % 10).cast("long")).join(other, "other_label")
    own, cross = V.cosine01(F.col("vec"), F.col("center")), V.cosine01(F.col("vec"), F.col("other"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((own > cross).cast("double")), 9).alias("rate"))


@query("novel_screen", f"""
WITH {VEC_CTE}, o AS ({OUT_SQL}), f AS (SELECT * FROM o WHERE catalyst <> '' QUALIFY row_number() OVER (PARTITION BY catalyst ORDER BY id) = 1),
 n AS (SELECT f.id, f.catalyst, f.ee, max({SIM_SQL}) AS sim FROM f JOIN v q ON q.entity_id = f.catalyst::BIGINT, c e GROUP BY 1, 2, 3)
SELECT id, catalyst, 'novel_catalyst' AS hit_type, round(coalesce(ee, 0) / 100 + 0.5::DOUBLE, 9) AS priority FROM n WHERE sim < 0.8""")
def novel_screen(spark, d):
    v = vectors(spark, d).select(F.col("entity_id").cast("string").alias("catalyst"), "vec")
    corpus = centroids(spark, d).select(F.col("query_id").alias("entity_id"), "vec")
    return S.novel_screen(outcomes(spark, d), v, corpus).withColumn("priority", F.round("priority", 9))


@query("hits_for_query", f"""
WITH {TOP_CTE}, pairs AS ({PAIRS_SQL}), n AS (SELECT l_suppkey AS entity_id, count(*) AS n FROM lineitem GROUP BY 1),
 sides AS (SELECT class_key, a_id, b_id, a_id AS entity_id FROM pairs UNION ALL SELECT class_key, a_id, b_id, b_id FROM pairs),
 f AS (SELECT r.query_id, class_key, a_id, b_id, rank, similarity FROM r JOIN sides USING (entity_id) WHERE rank <= 40
       QUALIFY row_number() OVER (PARTITION BY r.query_id, class_key ORDER BY rank, a_id, b_id) = 1),
 g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, class_key)::INT AS hit_rank FROM f)
SELECT query_id, class_key, a_id, b_id, hit_rank,
       round(similarity * (1 + 0.1::DOUBLE * (coalesce(x.n, 0) + coalesce(y.n, 0))), 7) AS priority
FROM g LEFT JOIN n x ON x.entity_id = a_id LEFT JOIN n y ON y.entity_id = b_id WHERE hit_rank <= 20""")
def hits_for_query(spark, d):
    found = S.cosine_topk(centroids(spark, d), vectors(spark, d), 40)
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    hits = P.hits_for_query(found, supplier_pairs(spark, d), n, 20)
    return hits.select("query_id", "class_key", "a_id", "b_id", "hit_rank", F.round("priority", 7).alias("priority"))


@query("rank_ligands", f"""
WITH {VEC_CTE}, s AS (SELECT list(x ORDER BY i) AS sv FROM m WHERE label = 0)
SELECT entity_id, CASE WHEN label = 9 THEN 0.0::DOUBLE ELSE round((entity_id % 97) / 97 * 100, 9) END AS predicted,
       CASE WHEN label = 9 THEN 'Infinity'::DOUBLE ELSE round(list_distance(vec, sv), 9) END AS distance FROM v, s""")
def rank_ligands(spark, d):
    substrate = centroids(spark, d).where("query_id = 0").first()["vec"]
    c = vectors(spark, d).withColumn("score", F.when(F.col("label") != 9, (F.col("entity_id") % 97) / 97))
    ranked = S.rank_ligands(c, substrate)
    return ranked.select("entity_id", F.round("predicted", 9).alias("predicted"),
                         F.when(F.col("distance") == float("inf"), F.col("distance")).otherwise(F.round("distance", 9)).alias("distance"))


@query("random_project", f"""
WITH h AS (SELECT i, j, md5('42:' || i || ':' || j) AS h FROM range({DIM}) a(i), range(32) b(j)),
 g AS (SELECT i, j, sqrt(-2 * ln((('0x' || h[1:8])::BIGINT + 1) / 4294967296.0::DOUBLE)) * cos(2 * pi() * (('0x' || h[9:16])::BIGINT / 4294967296.0::DOUBLE)) AS m FROM h),
 c AS (SELECT j, sqrt(sum(m * m)) AS size FROM g GROUP BY 1),
 v AS (SELECT vec_id AS entity_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT entity_id, j::INT AS i, round(sum(x * m / size), 9) AS x FROM v JOIN g USING (i) JOIN c USING (j) GROUP BY entity_id, j""")
def random_project(spark, d):
    rows = S.random_project(vectors(spark, d), "vec", DIM, 32)
    return rows.select("entity_id", F.posexplode("projected").alias("i", "x")).withColumn("x", F.round("x", 9))


@query("get_vectors", """
SELECT vec_id AS entity_id, label, len(embedding)::INT AS nbits, round(list_sum(embedding::DOUBLE[]), 9) AS total
FROM embeddings WHERE label = 3""")
def get_vectors(spark, d):
    """Scan of one label's vectors: the filter reaches the file scan."""
    v = table(spark, d, "embeddings").where(F.col("label") == 3)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return v.select(F.col("vec_id").alias("entity_id"), "label", F.size("embedding").alias("nbits"), F.round(total, 9).alias("total"))
