"""Graph featurization on the orders: one path graph of line items per order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from antipode.functions import spectra as Z
from antipode.functions.text import joined_numbers
from antipode.operators import graphs as G
from antipode.plans.registry import query
from antipode.plans.standins import table
from antipode.scale import group_row_number, materialize, spread

NODE_KEYS = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus")

#: Line items that one task sorts.
TASK_ROWS = 400_000

GRAPH_CTE = f"""
  nodes AS (SELECT l_orderkey AS graph_id, l_partkey % 9 AS atomic, l_suppkey % 5 AS rank, l_quantity, l_discount, l_tax, l_linenumber,
                   CASE WHEN l_linestatus = 'O' THEN 'R' ELSE 'S' END AS label, l_returnflag,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(NODE_KEYS)}) AS node FROM lineitem),
  sizes AS (SELECT graph_id, count(*)::INT AS n_nodes FROM nodes GROUP BY 1),
  edges AS (SELECT x.graph_id, x.node AS u, y.node AS v, x.l_quantity / 10 AS w FROM nodes x JOIN nodes y ON y.graph_id = x.graph_id AND y.node = x.node + 1),
  labels AS (SELECT graph_id, node, label FROM nodes WHERE l_returnflag = 'A')"""

POS_CTE = GRAPH_CTE + """,
  deg AS (SELECT graph_id, node, count(*) AS degree FROM (SELECT graph_id, u AS node FROM edges UNION ALL SELECT graph_id, v FROM edges) GROUP BY 1, 2),
  pos AS (SELECT n.graph_id, n.node, (row_number() OVER (PARTITION BY n.graph_id ORDER BY atomic DESC, coalesce(degree, 0) DESC, rank, n.node) - 1)::INT AS pos
          FROM nodes n LEFT JOIN deg d ON d.graph_id = n.graph_id AND d.node = n.node),
  ord AS (SELECT e.graph_id, least(a.pos, b.pos) AS u, greatest(a.pos, b.pos) AS v, w
          FROM edges e JOIN pos a ON a.graph_id = e.graph_id AND a.node = e.u JOIN pos b ON b.graph_id = e.graph_id AND b.node = e.v),
  delta AS (SELECT o.*, ln(u + 1.0::DOUBLE) - ln(v + 1.0::DOUBLE) + CASE WHEN v - u > n_nodes * 0.33::DOUBLE THEN pi() ELSE 0 END AS t
            FROM ord o JOIN sizes USING (graph_id)),
  phased AS (SELECT graph_id, u, v, cos(0.3::DOUBLE * t) * w * ((1 + sqrt(5.0::DOUBLE)) / 2) AS w_cos,
                    sin(0.3::DOUBLE * t) * w * pow((1 + sqrt(5.0::DOUBLE)) / 2, 2) AS w_sin FROM delta)"""


def nodes(spark, d):
    li = table(spark, d, "lineitem")
    rows = group_row_number(li.select("l_orderkey", *NODE_KEYS), ["l_orderkey"], [F.asc(c) for c in NODE_KEYS], "node", task_rows=TASK_ROWS)
    return rows.select(
        F.col("l_orderkey").alias("graph_id"), "node", (F.col("l_partkey") % 9).alias("atomic"), (F.col("l_suppkey") % 5).alias("rank"),
        "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", F.col("l_partkey").alias("part"),
        F.when(F.col("l_linestatus") == "O", "R").otherwise("S").alias("label"))


def edges_of(n):
    """Consecutive line items of an order: each but the last with the next number."""
    last = F.count(F.lit(1)).over(Window.partitionBy("graph_id"))
    return n.select("graph_id", "node", "l_quantity", last.alias("last")).where(F.col("node") < F.col("last")).select(
        "graph_id", F.col("node").alias("u"), (F.col("node") + 1).alias("v"), (F.col("l_quantity") / 10).alias("w"))


def labels_of(n):
    return n.where(F.col("l_returnflag") == "A").select("graph_id", "node", "label")


@query("edge_weights", """
SELECT l_linenumber, l_returnflag, t AS bond_type, CASE t WHEN 'SINGLE' THEN 1.0::DOUBLE WHEN 'AROMATIC' THEN 1.5::DOUBLE WHEN 'DOUBLE' THEN 2.0::DOUBLE WHEN 'TRIPLE' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w, count(*) AS n
FROM (SELECT *, ['SINGLE', 'AROMATIC', 'DOUBLE', 'TRIPLE', 'OTHER'][l_linenumber % 5 + 1] AS t FROM lineitem) GROUP BY ALL""")
def edge_weights(spark, d):
    names = F.array(*[F.lit(x) for x in ("SINGLE", "AROMATIC", "DOUBLE", "TRIPLE", "OTHER")])
    t = names[F.col("l_linenumber") % 5]
    return table(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag", t.alias("bond_type")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("w", G.edge_weight(F.col("bond_type")))


@query("label_modulated_weights", f"""
WITH {GRAPH_CTE}, s AS (SELECT graph_id, node, CASE label WHEN 'R' THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS s FROM labels)
SELECT e.graph_id, e.u, e.v, w + coalesce(a.s, 0) + coalesce(b.s, 0) AS w FROM edges e
LEFT JOIN s a ON a.graph_id = e.graph_id AND a.node = e.u LEFT JOIN s b ON b.graph_id = e.graph_id AND b.node = e.v""")
def label_modulated_weights(spark, d):
    n = nodes(spark, d)
    return G.label_modulated_weights(edges_of(n), labels_of(n))


@query("canonical_order", f"WITH {POS_CTE} SELECT graph_id, node, pos FROM pos")
def canonical_order(spark, d):
    n = nodes(spark, d)
    return G.canonical_order(n, edges_of(n))


@query("shifted_order_per_center", f"""
WITH {POS_CTE}, nb AS (SELECT graph_id, u AS center, v AS node FROM edges UNION ALL SELECT graph_id, v, u FROM edges),
 r AS (SELECT nb.graph_id, nb.center, nb.node, pos, row_number() OVER (PARTITION BY nb.graph_id, nb.center ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY nb.graph_id, nb.center) AS k
       FROM nb JOIN labels l ON l.graph_id = nb.graph_id AND l.node = nb.center JOIN pos p ON p.graph_id = nb.graph_id AND p.node = nb.node),
 s AS (SELECT r.*, shift FROM r, (VALUES (1), (-1)) t(shift) WHERE k >= 2)
SELECT s.graph_id, s.center, shift, s.node, r.pos FROM s JOIN r ON r.graph_id = s.graph_id AND r.center = s.center AND r.i = (s.i - shift + s.k) % s.k""")
def shifted_order_per_center(spark, d):
    n = nodes(spark, d)
    e = edges_of(n)
    centers = labels_of(n).select("graph_id", F.col("node").alias("center"))
    return G.shifted_order_per_center(e, G.canonical_order(n, e), centers).drop("k")


@query("reorder_edges", f"WITH {POS_CTE} SELECT graph_id, u, v, w FROM ord")
def reorder_edges(spark, d):
    n = nodes(spark, d)
    e = edges_of(n)
    return G.reorder_edges(e, G.canonical_order(n, e))


@query("phase_edges", f"WITH {POS_CTE} SELECT graph_id, u, v, round(w_cos, 9) AS w_cos, round(w_sin, 9) AS w_sin FROM phased")
def phase_edges(spark, d):
    n = nodes(spark, d)
    e = edges_of(n)
    p = G.phase_edges(G.reorder_edges(e, G.canonical_order(n, e)), G.graph_sizes(n))
    return p.select("graph_id", "u", "v", F.round("w_cos", 9).alias("w_cos"), F.round("w_sin", 9).alias("w_sin"))


@query("signed_degrees", f"""
WITH {POS_CTE} SELECT graph_id, node, round(sum(abs(w)), 9) AS degree FROM (SELECT graph_id, u AS node, w_sin AS w FROM phased UNION ALL SELECT graph_id, v, w_sin FROM phased) GROUP BY 1, 2""")
def signed_degrees(spark, d):
    n = nodes(spark, d)
    e = edges_of(n)
    p = G.phase_edges(G.reorder_edges(e, G.canonical_order(n, e)), G.graph_sizes(n))
    return G.signed_degrees(p, "w_sin").withColumn("degree", F.round("degree", 9))


LAPLACE_CTE = GRAPH_CTE + """, ends AS (SELECT graph_id, u AS node, w FROM edges UNION ALL SELECT graph_id, v, w FROM edges),
  sd AS (SELECT graph_id, node, sum(abs(w)) AS degree FROM ends GROUP BY 1, 2)"""


@query("laplacian_entries", f"""
WITH {LAPLACE_CTE} SELECT graph_id, node AS i, node AS j, round(degree, 9) AS value FROM sd UNION ALL SELECT graph_id, u, v, round(-w, 9) FROM edges""")
def laplacian_entries(spark, d):
    return G.laplacian_entries(edges_of(nodes(spark, d))).withColumn("value", F.round("value", 9))


@query("laplacian_normalized", f"""
WITH {LAPLACE_CTE} SELECT graph_id, node AS i, node AS j, 1.0::DOUBLE AS value FROM sd
UNION ALL SELECT e.graph_id, u, v, round(-w / sqrt(a.degree) / sqrt(b.degree), 9) FROM edges e
JOIN sd a ON a.graph_id = e.graph_id AND a.node = u JOIN sd b ON b.graph_id = e.graph_id AND b.node = v""")
def laplacian_normalized(spark, d):
    return G.laplacian_entries(edges_of(nodes(spark, d)), normalized=True).withColumn("value", F.round("value", 9))


@query("distance_edges", f"""
WITH {GRAPH_CTE}, p AS (SELECT graph_id, node, 10 * (l_quantity / 50) AS x, 10 * (l_discount * 5) AS y, 10 * (l_tax * 5) AS z FROM nodes),
 e AS (SELECT a.graph_id, a.node AS u, b.node AS v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
       FROM p a JOIN p b ON a.graph_id = b.graph_id AND a.node < b.node)
SELECT graph_id, u, v, round(1 / d, 7) AS w FROM e WHERE d > 0.1 AND d <= 1.9371""")
def distance_edges(spark, d):
    n = nodes(spark, d)
    ten, right_angle = F.lit(10.0), F.lit(90.0)
    x, y, z = G.to_cartesian(F.col("l_quantity") / 50, F.col("l_discount") * 5, F.col("l_tax") * 5,
                             (ten, ten, ten, right_angle, right_angle, right_angle))
    points = n.select("graph_id", "node", x.alias("x"), y.alias("y"), z.alias("z"))
    return G.distance_edges(points, 1.9371).select("graph_id", "u", "v", F.round("w", 7).alias("w"))


# ---------------------------------------- expressions on given spectra

def line_spectra(spark, d):
    """Two numbers per line item as a stand-in pair of spectra of fixed length 2."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    ec = F.array(q / 10, q / 7, (q % 5) / 3)
    es = F.array(p / 20000, p / 15000)
    rows = spread(table(spark, d, "lineitem").select(*KEY_COLS, "l_quantity", "l_extendedprice"))
    return rows.select(*KEY_COLS, ec.alias("ec"), es.alias("es"))


KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
LINE_CTE = f"""
  ln AS (SELECT {KEYS}, l_quantity / 10 AS c1, l_quantity / 7 AS c2, l_extendedprice / 20000 AS s1, l_extendedprice / 15000 AS s2 FROM lineitem),
  g AS (SELECT *, abs(c1) + abs(s1) AS m1, abs(c2) + abs(s2) AS m2 FROM ln)"""
KEY_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("spectral_asymmetry", f"""
WITH {LINE_CTE} SELECT {KEYS}, round((abs(c1 - s1) + abs(c2 - s2)) / (m1 + m2), 9) AS score,
  sign((c1 - s1) * m1 + (c2 - s2) * m2)::DOUBLE AS sign FROM g""")
def spectral_asymmetry(spark, d):
    score, sign = Z.spectral_asymmetry(F.col("ec"), F.col("es"))
    return line_spectra(spark, d).select(*KEY_COLS, F.round(score, 9).alias("score"), sign.alias("sign"))


@query("activity_index", f"""
WITH {LINE_CTE}, a AS (SELECT *, sqrt((pow(c1 - s1, 2) + pow(c2 - s2, 2)) / 2) / ((m1 + m2) / 2) AS v FROM g)
SELECT {KEYS}, round(CASE WHEN v < 1e-6 THEN 0 ELSE v END, 9) AS activity,
  CASE WHEN v < 1e-6 THEN 'inactive' WHEN (c1 - s1) * m1 + (c2 - s2) * m2 > 0 THEN 'positive' ELSE 'negative' END AS sign FROM a""")
def activity_index(spark, d):
    value, sign = Z.activity_index(F.col("ec"), F.col("es"))
    return line_spectra(spark, d).select(*KEY_COLS, F.round(value, 9).alias("activity"), sign.alias("sign"))


@query("saturation_score", f"""
WITH {LINE_CTE} SELECT {KEYS}, round(1 / (1 + exp(-10.0::DOUBLE * ((abs(c1 - s1) + abs(c2 - s2)) / (m1 + m2) - 0.1::DOUBLE))), 9) AS saturation FROM g""")
def saturation_score(spark, d):
    return line_spectra(spark, d).select(*KEY_COLS, F.round(Z.saturation_score(F.col("ec"), F.col("es")), 9).alias("saturation"))


@query("edge_shift", f"""
WITH {LINE_CTE} SELECT {KEYS}, round((abs(c1 - s1) + exp(-1.0::DOUBLE) * abs(c2 - s2)) / (1 + exp(-1.0::DOUBLE)), 9) AS shift FROM g""")
def edge_shift(spark, d):
    return line_spectra(spark, d).select(*KEY_COLS, F.round(Z.edge_shift(F.col("ec"), F.col("es")), 9).alias("shift"))


@query("mode_contributions", f"""
WITH {LINE_CTE}, m AS (SELECT {KEYS}, 0 AS index, c1 AS ec, s1 AS es FROM g UNION ALL SELECT {KEYS}, 1, c2, s2 FROM g)
SELECT {KEYS}, index, round(ec, 9) AS ec, round(es, 9) AS es, round(ec - es, 9) AS delta FROM m WHERE abs(ec - es) > 1e-6""")
def mode_contributions(spark, d):
    rows = line_spectra(spark, d).select(*KEY_COLS, F.explode(Z.mode_contributions(F.col("ec"), F.col("es"))).alias("m"))
    return rows.select(*KEY_COLS, "m.index", *[F.round(f"m.{c}", 9).alias(c) for c in ("ec", "es", "delta")])


@query("rotation_class", """
SELECT p_partkey AS id, CASE WHEN p_size % 10 / 10 < 1e-6 OR p_partkey % 3 = 1 THEN 'inactive' WHEN p_partkey % 3 > 1 THEN 'dextrorotatory (+)' ELSE 'levorotatory (-)' END AS rotation,
  CASE WHEN p_size >= 20 THEN 'crystalline' WHEN len(list_distinct(l)) <= 3 THEN 'metamaterial' ELSE 'molecular' END AS material
FROM (SELECT *, string_split(p_brand || p_type, '') AS l FROM part)""")
def rotation_class(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        key.alias("id"), Z.rotation_class((key % 3 - 1).cast("double"), (size % 10) / 10).alias("rotation"),
        Z.material_class(size, F.split(F.concat("p_brand", "p_type"), "")).alias("material"))


# -------------------------------------------------- spectra of the graphs

def ordered(spark, d, modulated=False):
    n = nodes(spark, d)
    e = edges_of(n)
    pos = G.canonical_order(n, e)
    w = G.label_modulated_weights(e, labels_of(n)) if modulated else e
    return G.reorder_edges(w, pos), G.graph_sizes(n)


@query("spectrum")
def spectrum(spark, d):
    e, sizes = ordered(spark, d)
    return G.spectra(e, sizes).select("graph_id", "n_nodes", "error",
                                      joined_numbers("ev_cos", 6).alias("ev_cos"), joined_numbers("ev_sin", 6).alias("ev_sin"))


MOMENT_SQL = ", ".join(
    f"round(sum(CASE WHEN p = {p} THEN {c} END), 5) AS {c}_{p}" for c in ("cos", "sin") for p in (1, 2, 3))


@query("spectrum_moments", f"""
WITH {POS_CTE}, ends AS (SELECT graph_id, u AS i, v AS j, w_cos AS c, w_sin AS s FROM phased UNION ALL SELECT graph_id, v, u, w_cos, w_sin FROM phased),
 l AS (SELECT graph_id, i, j, -c AS c, -s AS s FROM ends UNION ALL SELECT graph_id, i, i, sum(abs(c)), sum(abs(s)) FROM ends GROUP BY ALL),
 two AS (SELECT a.graph_id, a.i, b.j, sum(a.c * b.c) AS c, sum(a.s * b.s) AS s FROM l a JOIN l b ON a.graph_id = b.graph_id AND a.j = b.i GROUP BY ALL),
 t AS (SELECT graph_id, 1 AS p, sum(c) AS cos, sum(s) AS sin FROM l WHERE i = j GROUP BY 1
       UNION ALL SELECT graph_id, 2, sum(c), sum(s) FROM two WHERE i = j GROUP BY 1
       UNION ALL SELECT a.graph_id, 3, sum(a.c * b.c), sum(a.s * b.s) FROM two a JOIN l b ON a.graph_id = b.graph_id AND a.j = b.i AND a.i = b.j GROUP BY 1)
SELECT graph_id, {MOMENT_SQL} FROM t GROUP BY graph_id""")
def spectrum_moments(spark, d):
    """Sums of the eigenvalues, their squares and cubes: the traces of L, L^2 and L^3."""
    e, sizes = ordered(spark, d)
    s = G.spectra(e, sizes.where("n_nodes > 1"), k=64, skip=0)
    total = lambda c, p: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(p)))
    return s.select("graph_id", *[F.round(total(f"ev_{c}", p), 5).alias(f"{c}_{p}") for c in ("cos", "sin") for p in (1, 2, 3)])


def part_graphs(spark, d):
    """Four branched graphs with cycles: the parts that suppliers ship, linked where they follow each other in an order."""
    n = nodes(spark, d).select("graph_id", "node", "l_quantity", "part")
    after = n.select("graph_id", (F.col("node") - 1).alias("node"), F.col("part").alias("other"))
    links = n.join(after, ["graph_id", "node"]).select((F.col("graph_id") % 4).alias("graph_id"), F.col("part").alias("u"), F.col("other").alias("v"),
                                                       (F.col("l_quantity") / 10).alias("w"))
    e = materialize(G.simple_edges(links), "links")
    both = e.select("graph_id", F.col("u").alias("part")).union(e.select("graph_id", "v")).distinct()
    at = materialize(group_row_number(both, ["graph_id"], [F.asc("part")], "pos"), "places").withColumn("pos", F.col("pos") - 1)
    end = lambda c: at.select("graph_id", F.col("part").alias(c), F.col("pos").alias(f"p{c}"))
    placed = e.join(end("u"), ["graph_id", "u"]).join(end("v"), ["graph_id", "v"]).select(
        "graph_id", F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"), "w")
    return placed, at.groupBy("graph_id").agg(F.count(F.lit(1)).cast("int").alias("n_nodes"))


@query("large_spectrum")
def large_spectrum(spark, d):
    """Low eigenvalues of graphs of hundreds to thousands of nodes, each within its residual."""
    e, sizes = part_graphs(spark, d)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.5f", x)), ",").alias(c)
    return G.spectra(e, sizes).select("graph_id", "n_nodes", "error", (F.coalesce("residual", F.lit(0.0)) < 1e-4).alias("settled"),
                                      text("ev_cos"), text("ev_sin"))


def raw(spark, d):
    n = materialize(nodes(spark, d).select("graph_id", "node", "atomic", "rank", "l_quantity", "l_returnflag", "label"), "nodes")
    e, sizes = materialize(edges_of(n), "edges"), G.graph_sizes(n)
    pos = materialize(G.canonical_order(n, e), "positions")
    plain = G.spectra(G.reorder_edges(e, pos), sizes)
    modulated = G.spectra(G.reorder_edges(G.label_modulated_weights(e, labels_of(n)), pos), sizes)
    return G.raw_vectors(plain, modulated)


@query("graph_vector")
def graph_vector(spark, d):
    v = G.graph_vector(raw(spark, d), "full", 32)
    return v.select("graph_id", joined_numbers("vec", 5).alias("vec"))


@query("difference_vector")
def difference_vector(spark, d):
    r = raw(spark, d)
    pure, chi = G.graph_vector(r, "pure_diff", 16), G.graph_vector(r, "chi_diff", 16).withColumnRenamed("vec", "chi")
    text = lambda c: joined_numbers(c, 5).alias(c)
    return pure.join(chi, "graph_id").select("graph_id", text("vec"), text("chi"))


def scored(spark, d):
    n = materialize(nodes(spark, d).select("graph_id", "node", "atomic", "rank", "l_quantity", "l_returnflag", "label"), "nodes")
    e, sizes, labels = materialize(edges_of(n), "edges"), G.graph_sizes(n), labels_of(n)
    centers = G.center_scores(sizes, e, materialize(G.canonical_order(n, e), "positions"), labels)
    return centers, G.graph_scores(sizes, centers, labels), sizes


@query("differential_score")
def differential_score(spark, d):
    return scored(spark, d)[1].select("graph_id", F.round("score", 6).alias("score"), "is_chiral",
                                      F.round("confidence", 4).alias("confidence"), "sign")


@query("compare_graphs")
def compare_graphs(spark, d):
    _, scores, sizes = scored(spark, d)
    key = F.col("graph_id")
    pairs = sizes.select(key.alias("a_id"), (key + 1).alias("b_id"))
    return G.compare_graphs(pairs, scores, sizes)
