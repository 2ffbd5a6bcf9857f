"""The engine's inputs derived from the supplied tables, as DataFrames and as SQL.

Even vectors are the left graph, odd ones the right; edges tie a vector to the next
two of its side; relations are the ten vector labels. Triples come from the star
schema. Whole tables are used throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import RAW_NAMESPACE
from twinweave.functions.vectors import gathered, mean_pool, similarity_pairs
from twinweave.operators import qubo
from twinweave.operators.similarity import threshold_pairs
from twinweave.runtime import table

#: The stand-in vectors are less alike than real labels; at 0.75 no pair is left.
THRESHOLD = 0.30
DIGITS = 6
ONTOLOGY = "urn:twinweave:ontology#"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """graph, idx, label, uri, kind, vec."""
    e = table(spark, d, "embeddings")
    name = F.concat(F.lit("item_"), F.col("vec_id").cast("string"))
    return e.select(F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right").alias("graph"), F.col("vec_id").alias("idx"), name.alias("label"), F.concat(F.lit(ONTOLOGY), name).alias("uri"), F.col("label").alias("kind"), F.col("embedding").cast("array<double>").alias("vec"))


def side(spark: SparkSession, d: str, graph: str) -> DataFrame:
    return nodes(spark, d).where(F.col("graph") == graph)


def similarity(spark: SparkSession, d: str, threshold: float | None = None) -> DataFrame:
    """i, a, sim rounded to DIGITS: the whole grid, or what reaches the threshold."""
    left, right = (side(spark, d, s).select("idx", "vec") for s in ("left", "right"))
    return similarity_pairs(left, right, None, DIGITS) if threshold is None else threshold_pairs(left, right, threshold, DIGITS)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """graph, src, dst, label."""
    n = nodes(spark, d)
    offered = n.select("graph", F.col("idx").alias("src"), F.explode(F.array(F.col("idx") + 2, F.col("idx") + 4)).alias("dst"), F.concat(F.lit("rel_"), F.col("kind").cast("string")).alias("label"))
    return offered.join(n.select(F.col("idx").alias("dst")), "dst", "left_semi").select("graph", "src", "dst", "label")


def relation_vectors(spark: SparkSession, d: str) -> DataFrame:
    """label, vec: the mean vector of each kind."""
    n = nodes(spark, d).select(F.concat(F.lit("rel_"), F.col("kind").cast("string")).alias("label"), "vec")
    return gathered(mean_pool(n, ["label"]), ["label"])


def weights(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return qubo.structural_weights(e.where("graph = 'left'"), e.where("graph = 'right'"), relation_vectors(spark, d))


def first_weights(spark: SparkSession, d: str, most: int) -> DataFrame:
    e = edges(spark, d)
    return qubo.first_weights(e.where("graph = 'left'"), e.where("graph = 'right'"), relation_vectors(spark, d), most)


def variable_weights(spark: SparkSession, d: str, variables: DataFrame) -> DataFrame:
    """The weights whose both ends are among variables(i, a)."""
    e = edges(spark, d)
    return qubo.structural_weights_of(variables, e.where("graph = 'left'"), e.where("graph = 'right'"), relation_vectors(spark, d))


def variables(spark: SparkSession, d: str) -> DataFrame:
    return qubo.variable_index(similarity(spark, d, THRESHOLD))


def triples(spark: SparkSession, d: str) -> DataFrame:
    """graph, s, p, o, o_is_uri from customers, suppliers, nations, regions and what suppliers supply."""
    t = lambda n: table(spark, d, n)
    nation, region, supplier, part = t("nation"), t("region"), t("supplier"), t("part")
    cust = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("left"), "c_name", F.lit("in_nation"), "n_name")
    supp = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("right"), "s_name", F.lit("in_nation"), "n_name")
    reg = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("left"), "n_name", F.lit("in_region"), "r_name")
    sold = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    sells = sold.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.lit("right"), "s_name", F.lit("supplies"), "p_name")
    out = cust.union(supp).union(reg).union(sells).toDF("graph", "sn", "pn", "on")
    uri = lambda c: F.concat(F.lit(RAW_NAMESPACE), F.replace(F.col(c), F.lit(" "), F.lit("_")))
    return out.select("graph", uri("sn").alias("s"), uri("pn").alias("p"), uri("on").alias("o"), F.lit(True).alias("o_is_uri"))


def allowed(spark: SparkSession, d: str) -> DataFrame:
    """name, type of the allow-list, in other case than the triples have."""
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" ")).alias("name")
    n = table(spark, d, "nation").select(spaced(F.lower("n_name")), F.lit("Nation").alias("type"))
    r = table(spark, d, "region").select(spaced(F.lower("r_name")), F.lit("Region").alias("type"))
    s = table(spark, d, "supplier").select(spaced(F.upper("s_name")), F.lit("Supplier").alias("type"))
    return n.unionByName(r).unionByName(s)


def mappings(spark: SparkSession, d: str) -> DataFrame:
    """pos, canonical, aliases of part names."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.initcap("p_name").alias("canonical"), F.array(F.upper("p_name"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("aliases"))


NODES = f"""nodes AS (
    SELECT CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END AS graph, vec_id AS idx, 'item_' || vec_id AS label,
           '{ONTOLOGY}item_' || vec_id AS uri, label AS kind, embedding::DOUBLE[] AS vec FROM embeddings)"""
SIM = f"""{NODES}, sim AS (
    SELECT l.idx AS i, r.idx AS a, round(list_cosine_similarity(l.vec, r.vec), {DIGITS}) AS sim
    FROM nodes l JOIN nodes r ON l.graph = 'left' AND r.graph = 'right')"""
CAND = f"{SIM}, cand AS (SELECT * FROM sim WHERE sim >= {THRESHOLD})"
VARS = f"{CAND}, vars AS (SELECT i, a, sim, row_number() OVER (ORDER BY i, a) - 1 AS var FROM cand)"
EDGES = """edges AS (
    SELECT n.graph, n.idx AS src, n.idx + k.d AS dst, 'rel_' || n.kind AS label
    FROM nodes n CROSS JOIN (VALUES (2), (4)) k(d) WHERE n.idx + k.d IN (SELECT idx FROM nodes))"""
WEIGHTS = f"""{EDGES}, pooled AS (
    SELECT label, pos, avg(v) AS x FROM (SELECT 'rel_' || kind AS label, unnest(vec) AS v, generate_subscripts(vec, 1) AS pos FROM nodes) GROUP BY label, pos),
    cosines AS (SELECT p.label AS lx, q.label AS ly, sum(p.x * q.x) / (sqrt(sum(p.x * p.x)) * sqrt(sum(q.x * q.x))) AS w FROM pooled p JOIN pooled q USING (pos) GROUP BY p.label, q.label),
    weights AS (
    SELECT l.src AS i, l.dst AS j, r.src AS a, r.dst AS b, c.w FROM edges l JOIN cosines c ON c.lx = l.label JOIN edges r ON r.label = c.ly
    WHERE l.graph = 'left' AND r.graph = 'right')"""
STRUCTURE = """hs AS (
    SELECT least(x.var, y.var) AS u, greatest(x.var, y.var) AS v, -sum(w.w) AS coeff FROM weights w
    JOIN vars x ON x.i = w.i AND x.a = w.a JOIN vars y ON y.i = w.j AND y.a = w.b GROUP BY 1, 2)"""
PARTS = """parts AS (
    SELECT 'node' AS component, var AS u, var AS v, -sim AS coeff FROM vars
    UNION ALL SELECT 'structure', u, v, coeff FROM hs
    UNION ALL SELECT 'penalty', p.u, p.v, sum(p.c) FROM (
        SELECT l.var AS u, r.var AS v, 2.0::DOUBLE AS c FROM vars l JOIN vars r ON l.i = r.i AND l.var < r.var
        UNION ALL SELECT l.var, r.var, 2.0::DOUBLE FROM vars l JOIN vars r ON l.a = r.a AND l.var < r.var) p GROUP BY p.u, p.v)"""
QUBO = f"{VARS}, {WEIGHTS}, {STRUCTURE}, {PARTS}"
GREEDY_STEPS = """ranked AS (SELECT i, a, sim, row_number() OVER (ORDER BY sim DESC, i, a) AS k FROM cand),
    steps(k, ui, ua, i, a, sim, ok) AS (
        SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, false
        UNION ALL
        SELECT k, CASE WHEN o THEN list_append(ui, i) ELSE ui END, CASE WHEN o THEN list_append(ua, a) ELSE ua END, i, a, sim, o
        FROM (SELECT s.ui, s.ua, c.i, c.a, c.sim, c.k, (NOT list_contains(s.ui, c.i) AND NOT list_contains(s.ua, c.a)) AS o FROM steps s JOIN ranked c ON c.k = s.k + 1)),
    pairs AS (SELECT i, a, sim FROM steps WHERE ok)"""
GREEDY = f"{CAND}, {GREEDY_STEPS}"
TRIPLES = f"""triples AS (
    SELECT graph, '{RAW_NAMESPACE}' || replace(sn, ' ', '_') AS s, '{RAW_NAMESPACE}' || pn AS p, '{RAW_NAMESPACE}' || replace(o_n, ' ', '_') AS o FROM (
        SELECT 'left' AS graph, c_name AS sn, 'in_nation' AS pn, n_name AS o_n FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'right', s_name, 'in_nation', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'left', n_name, 'in_region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'right', s_name, 'supplies', p_name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey))"""
ALLOWED = "allowed AS (SELECT replace(lower(n_name), '_', ' ') AS name, 'Nation' AS type FROM nation UNION ALL SELECT replace(lower(r_name), '_', ' '), 'Region' FROM region UNION ALL SELECT replace(upper(s_name), '_', ' '), 'Supplier' FROM supplier)"
#: Non-edges by the arithmetic of embed.negative_edges; eight draws are enough for graphs with fewer than seven edges a node.
MIXED = "(((({0}) * 48271 + 11) % 2147483647 * 16807) % 2147483647 * 39373) % 2147483647"
NEGATIVE = f"""ranks AS (SELECT graph, idx, row_number() OVER (PARTITION BY graph ORDER BY idx) - 1 AS rank, count(*) OVER (PARTITION BY graph) AS n FROM nodes),
    offers AS (SELECT r.graph, r.idx AS src, k.k, {MIXED.format('r.rank')} AS hash, (r.rank + 1 + ({MIXED.format('r.rank')} + k.k) % (r.n - 1)) % r.n AS dst_rank FROM ranks r CROSS JOIN range(8) k(k)),
    free AS (SELECT o.graph, o.src, t.idx AS dst, row_number() OVER (PARTITION BY o.graph ORDER BY o.k, o.hash, o.src) AS place FROM offers o JOIN ranks t ON t.graph = o.graph AND t.rank = o.dst_rank
        WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph = o.graph AND (e.src = o.src AND e.dst = t.idx OR e.src = t.idx AND e.dst = o.src))),
    negative AS (SELECT graph, src, dst FROM free WHERE place <= (SELECT count(*) FROM edges e WHERE e.graph = free.graph))"""
