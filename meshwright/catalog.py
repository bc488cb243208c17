"""The registered queries of the core library and, where SQL can express them, the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright import fixtures as fx
from meshwright.functions import geo, text
from meshwright.operators import aggregates, areas, network, paths, spatial
from meshwright.operators import routes as street_routes
from meshwright.operators.components import connected_components
from meshwright.graph import PropertyGraph
from meshwright.plans import assemble
from meshwright.plans.materialise import checkpoint, dealt, scratch_path
from meshwright.sources import graph_csv, graph_json, graphml, layers, wkb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# Parts of the oracles: the road grid as tables.
_ROAD = """
    road AS (
        SELECT 2 * k AS segmento_id, k AS u, k + 1 AS v, CAST(50 + s AS DOUBLE) AS largo_m, 'H' || (k // 50) AS calle,
               CASE k % 3 WHEN 0 THEN 'ambos' WHEN 1 THEN 'directo' ELSE 'inverso' END AS sentido
        FROM (SELECT p_partkey AS k, p_size AS s FROM part) WHERE k % 50 < 49 AND (k * 7) % 11 NOT IN (3, 5) AND k + 1 IN (SELECT p_partkey FROM part)
        UNION ALL
        SELECT 2 * k + 1, k, k + 50, CAST(60 + s AS DOUBLE), 'V' || (k % 50), 'ambos'
        FROM (SELECT p_partkey AS k, p_size AS s FROM part) WHERE (k * k + k) % 13 NOT IN (2, 6, 7) AND k + 50 IN (SELECT p_partkey FROM part)),
    arcs AS (SELECT u AS src, v AS dst, largo_m FROM road UNION ALL SELECT v, u, largo_m FROM road)
"""
_POINTS = """
    h AS (SELECT greatest(count(*) // 50 - 1, 1) AS h FROM part),
    c AS (SELECT c_custkey AS id, ((c_custkey * 6151) % 490000) / 100.0 AS x, ((c_custkey * 7919) % (h.h * 10000)) / 100.0 AS y FROM customer, h),
    s AS (SELECT s_suppkey AS id, ((s_suppkey * 4211) % 490000) / 100.0 AS x, ((s_suppkey * 9173) % (h.h * 10000)) / 100.0 AS y FROM supplier, h)
"""


# Patterns


@registered("""
    SELECT c.c_name AS customer, n.n_name AS nation, s.s_name AS supplier
    FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN supplier s ON s_nationkey = n_nationkey
""")
def pattern_same_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.key_graph(spark, sf_dir).match().node("c", "Customer", "name").out("CUSTOMER_IN").node("n", "Nation", "name").spread().into("SUPPLIER_IN").node("s", "Supplier", "name")
    return m.rows().select(F.col("c_name").alias("customer"), F.col("n_name").alias("nation"), F.col("s_name").alias("supplier"))


@registered("""
    SELECT n_name AS nation, count(*) AS orders, CAST(sum(CASE WHEN month(o_orderdate) >= 11 OR month(o_orderdate) < 3 THEN 1 ELSE 0 END) AS BIGINT) AS in_winter,
           CAST(sum(CASE WHEN o_totalprice >= 200000 THEN 1 ELSE 0 END) AS BIGINT) AS large
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name
""")
def pattern_group_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.key_graph(spark, sf_dir).match().node("o", "Orders", "orderdate", "totalprice").into("PLACED").node("c", "Customer").out("CUSTOMER_IN").node("n", "Nation")
    month = F.month("o_orderdate")
    counted = m.rows().groupBy("n").agg(F.count("*").alias("orders"), F.count_if((month >= 11) | (month < 3)).alias("in_winter"), F.count_if(F.col("o_totalprice") >= 200000).alias("large"))
    nations = fx.key_graph(spark, sf_dir).nodes["Nation"].rows.select(F.col("id").alias("n"), F.col("name").alias("nation"))
    return counted.join(nations, "n").select("nation", "orders", "in_winter", "large")


@registered("""
    SELECT p_name AS part, p_brand AS brand FROM part p
    WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p.p_partkey AND s_acctbal < 0)
""")
def pattern_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.key_graph(spark, sf_dir)
    indebted = g.match().node("s", "Supplier", "acctbal").where("s_acctbal < 0").out("SUPPLIES").node("p", "Part")
    return g.match().node("p", "Part", "name", "brand").exists(indebted).rows().select(F.col("p_name").alias("part"), F.col("p_brand").alias("brand"))


@registered("""
    SELECT c_name AS customer, n_name AS nation FROM customer c JOIN nation n ON c_nationkey = n_nationkey
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'F')
      AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n.n_nationkey AND s_acctbal < -900)
""")
def pattern_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.key_graph(spark, sf_dir)
    finished = g.match().node("c", "Customer").out("PLACED").node("o", "Orders", "orderstatus").where("o_orderstatus = 'F'")
    poor = g.match().node("s", "Supplier", "acctbal").where("s_acctbal < -900").out("SUPPLIER_IN").node("n", "Nation")
    m = g.match().node("c", "Customer", "name").out("CUSTOMER_IN").node("n", "Nation", "name").not_exists(finished).not_exists(poor)
    return m.rows().select(F.col("c_name").alias("customer"), F.col("n_name").alias("nation"))


@registered("""
    SELECT a.l_orderkey AS orders, a.l_partkey AS part, b.l_partkey AS other, a.l_quantity AS quantity
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_quantity >= 45 AND a.l_partkey <> b.l_partkey
""")
def pattern_comma_different(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.key_graph(spark, sf_dir)
    big = g.match().node("o", "Orders").out("CONTAINS", "e", "quantity").node("p", "Part").where("e_quantity >= 45")
    m = big.also(g.match().node("o", "Orders").out("CONTAINS").node("q", "Part")).where("p != q")
    return m.rows().select(F.col("o").alias("orders"), F.col("p").alias("part"), F.col("q").alias("other"), F.col("e_quantity").alias("quantity"))


@registered(f"""
    WITH {_ROAD} SELECT u AS a, v AS b, largo_m FROM road WHERE sentido = 'ambos' UNION ALL SELECT v, u, largo_m FROM road WHERE sentido = 'ambos'
""")
def pattern_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.road_graph(spark, sf_dir).match().node("a", "Corner").undirected("ROAD", "e", "largo_m").node("b", "Corner")
    return m.rows().select("a", "b", F.col("e_largo_m").alias("largo_m"))


@registered(f"""
    WITH {_ROAD}, e AS (SELECT *, CASE WHEN sentido = 'ambos' THEN 'ROAD' ELSE 'ONE_WAY' END AS label FROM road)
    SELECT u AS a, v AS b, largo_m, label FROM e UNION ALL SELECT v, u, largo_m, label FROM e
""")
def pattern_any_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.road_graph(spark, sf_dir).match().node("a", "Corner").any_way(None, "e", "largo_m").node("b", "Corner")
    return m.rows().select("a", "b", F.col("e_largo_m").alias("largo_m"), F.col("e_label").alias("label"))


@registered("""
    SELECT c_mktsegment AS segment, count(DISTINCT o_custkey) AS customers, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS nations
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 400000 GROUP BY c_mktsegment
""")
def pattern_collect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.key_graph(spark, sf_dir).match().node("o", "Orders", "totalprice").where("o_totalprice > 400000").into("PLACED").node("c", "Customer", "mktsegment").out("CUSTOMER_IN").node("n", "Nation", "name")
    return m.rows().groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_distinct("c").alias("customers"), F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("nations"))


@registered("SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand")
def pattern_value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.value_counts(fx.table(spark, sf_dir, "part"), "p_brand").withColumnRenamed("p_brand", "brand")


@registered("""
    SELECT 'nodo' AS clase, 'Nation' AS etiqueta, count(*) AS cantidad FROM nation UNION ALL SELECT 'nodo', 'Region', count(*) FROM region
    UNION ALL SELECT 'nodo', 'Customer', count(*) FROM customer UNION ALL SELECT 'nodo', 'Supplier', count(*) FROM supplier
    UNION ALL SELECT 'nodo', 'Part', count(*) FROM part UNION ALL SELECT 'nodo', 'Orders', count(*) FROM orders
    UNION ALL SELECT 'arista', 'CUSTOMER_IN', count(*) FROM customer UNION ALL SELECT 'arista', 'SUPPLIER_IN', count(*) FROM supplier
    UNION ALL SELECT 'arista', 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'arista', 'PLACED', count(*) FROM orders
    UNION ALL SELECT 'arista', 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'arista', 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
""")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.key_graph(spark, sf_dir).counts()


@registered("""
    SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND n_name NOT IN ('NATION_1', 'NATION_4')
""")
def pattern_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.key_graph(spark, sf_dir).match().node("c", "Customer", "name", "mktsegment").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    m = m.out("CUSTOMER_IN").node("n", "Nation", "name").where(~F.col("n_name").isin("NATION_1", "NATION_4"))
    return m.rows().select(F.col("c_name").alias("customer"), F.col("n_name").alias("nation"))


@registered("""
    SELECT 'customer:' || c_custkey AS id, '{"kind":"node","labels":["Customer"],"props":{"segment":"' || c_mktsegment || '"}}' AS node FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, '{"kind":"node","labels":["Supplier"],"props":{}}' FROM supplier
""")
def pattern_whole_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole nodes as values; a property that a node lacks isn't there."""
    g, out = fx.mixed_graph(spark, sf_dir), None
    for label in ("Customer", "Supplier"):
        rows = g.node_values(label).select(F.concat_ws(":", F.lit(label.lower()), F.col("id").cast("string")).alias("id"), F.to_json("node").alias("node"))
        out = rows if out is None else out.unionByName(rows)
    return out


@registered("""
    SELECT * FROM (VALUES ('node', 'Corner'), ('node', 'Customer'), ('node', 'Nation'), ('node', 'Supplier'),
                          ('edge', 'IS_IN'), ('edge', 'ONE_WAY'), ('edge', 'ROAD')) t(kind, label)
""")
def graph_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.mixed_graph(spark, sf_dir).schema()
    rows = [(kind, label) for kind in ("node", "edge") for label in found[f"{kind}_labels"]]
    return spark.createDataFrame(rows, "kind string, label string")


# Paths


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three junctions: halfway along the grid, at a third and at two fifths."""
    n = fx.table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    return n.select(F.explode(F.array(F.floor(F.col("n") / 2) + 20, F.floor(F.col("n") / 3), F.floor(F.col("n") * 2 / 5))).alias("node"))


def _arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    road = fx.grid_road(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"), "largo_m")
    return paths.both_ways(road)


_SEEDS = "seeds AS (SELECT unnest([count(*) // 2 + 20, count(*) // 3, (count(*) * 2) // 5]) AS node FROM part)"


# The whole grid is walked level by level; the cap is a condition on what was found.
_WALK = """
    walk(seed, node, hops, total) USING KEY (seed, node) AS (
        SELECT node, node, 0, CAST(0 AS DOUBLE) FROM seeds
        UNION
        SELECT w.seed, dst, w.hops + 1, min(w.total + largo_m) FROM walk w JOIN arcs ON w.node = src
        WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.seed = w.seed AND r.node = dst) GROUP BY w.seed, dst, w.hops)
"""


@registered(f"WITH RECURSIVE {_ROAD}, {_SEEDS}, {_WALK} SELECT seed, node, hops, total FROM walk WHERE total < 600")
def path_any_shortest_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.any_shortest(_arcs(spark, sf_dir), _seeds(spark, sf_dir), weight="largo_m", cap=600.0)


_HEAVY = _ROAD.replace(
    "arcs AS (SELECT u AS src, v AS dst, largo_m FROM road UNION ALL SELECT v, u, largo_m FROM road)",
    "heavy AS (SELECT * REPLACE (CASE WHEN segmento_id % 5 = 0 THEN largo_m * 12 ELSE largo_m END AS largo_m) FROM road),\n"
    "    arcs AS (SELECT u AS src, v AS dst, largo_m FROM heavy UNION ALL SELECT v, u, largo_m FROM heavy)",
)


@registered(f"WITH RECURSIVE {_HEAVY}, {_SEEDS}, {_WALK} SELECT seed, node, hops, total FROM walk WHERE total < 600")
def path_cap_is_no_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth segment weighs over the cap: a node behind it counts as reached, and a longer way round isn't taken instead."""
    metres = F.when(F.col("segmento_id") % 5 == 0, F.col("largo_m") * 12).otherwise(F.col("largo_m"))
    road = fx.grid_road(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"), metres.alias("largo_m"))
    return paths.any_shortest(paths.both_ways(road), _seeds(spark, sf_dir), weight="largo_m", cap=600.0)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of the group street - corner - street over the grid."""
    g = fx.street_graph(spark, sf_dir)
    turn = g.match().node("s", "Street").into("ON", "e").node("x", "Corner", "x").out("ON").node("m", "Street", "kind")
    return paths.group(turn.rows(), "s", "m", "x", "m_kind")


@registered(f"""
    WITH RECURSIVE {_ROAD}, j AS (SELECT u AS x, calle FROM road UNION SELECT v, calle FROM road),
    steps AS (SELECT a.calle AS src, a.x, b.calle AS dst FROM j a JOIN j b ON a.x = b.x AND a.calle <> b.calle),
    seeds AS (SELECT calle AS seed FROM j WHERE calle IN ('H1', 'V3') GROUP BY calle),
    walk(seed, here, hops, streets, corners, kinds) AS (
        SELECT seed, seed, 0, [seed], CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) FROM seeds
        UNION ALL
        SELECT seed, dst, hops + 1, list_append(streets, dst), list_append(corners, x), list_append(kinds, left(dst, 1))
        FROM walk JOIN steps ON here = src WHERE hops < 2),
    least AS (SELECT seed, here, min(hops) AS hops FROM walk GROUP BY ALL)
    SELECT seed, here AS target, hops, array_to_string(streets, '>') AS streets, array_to_string(corners, '>') AS corners,
           array_to_string(kinds, '>') AS kinds
    FROM walk JOIN least USING (seed, here, hops) WHERE here IN ('H3', 'V7', 'H1')
""")
def path_group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All routes with the fewest turns from two streets to three, with their streets, corners and a property of each street in order."""
    streets = fx.street_graph(spark, sf_dir).nodes["Street"].rows.select(F.col("id").alias("node"))
    seeds, targets = streets.filter(F.col("node").isin("H1", "V3")), streets.filter(F.col("node").isin("H3", "V7", "H1"))
    found = paths.all_shortest(_turns(spark, sf_dir), seeds, targets, most_hops=2)
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ">")
    return found.select(
        "seed", "target", "hops", joined("path").alias("streets"), joined(F.col("vias.x")).alias("corners"), joined(F.col("vias.m_kind")).alias("kinds")
    )


@registered(f"""
    WITH RECURSIVE {_ROAD}, j AS (SELECT u AS x, calle FROM road UNION SELECT v, calle FROM road),
    steps AS (SELECT DISTINCT a.calle AS src, b.calle AS dst FROM j a JOIN j b ON a.x = b.x AND a.calle <> b.calle),
    walk(node, hops) AS (
        SELECT DISTINCT calle, 0 FROM j WHERE calle LIKE '%9'
        UNION
        SELECT dst, hops + 1 FROM walk JOIN steps ON node = src WHERE hops < 6),
    reports AS (SELECT s_suppkey AS report, calle FROM supplier JOIN j ON x = s_suppkey % 97)
    SELECT report, calle AS street, 2 * min(hops) + 1 - 2 AS hops FROM reports JOIN walk ON node = calle GROUP BY report, calle
""")
def path_hops_per_report_and_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each report and each street of its corner, the edges to the nearest place, less two: an expression over an aggregate."""
    members = fx.street_graph(spark, sf_dir).edges["ON"].rows
    places = members.filter(F.col("dst").endswith("9")).select(F.col("dst").alias("node"))
    turns = paths.hops_to_nearest(_turns(spark, sf_dir).select("src", "dst"), places)
    reports = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report"), (F.col("s_suppkey") % 97).alias("src"))
    on = reports.join(members, "src").select("report", F.col("dst").alias("street")).join(turns.withColumnRenamed("node", "street"), "street")
    return on.groupBy("report", "street").agg((F.min(2 * F.col("hops") + 1) - 2).alias("hops"))


@registered("""
    SELECT 'Customer' AS label, c_custkey AS id, n_name AS nation, r_name AS region, c_mktsegment AS segment
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000
    UNION ALL
    SELECT 'Supplier', s_suppkey, n_name, r_name, NULL
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 9000
""")
def pattern_either_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as one variable, before and after an edge; ids of both are the same numbers."""
    g = fx.key_graph(spark, sf_dir)
    m = g.match().node("a", "Customer|Supplier", "acctbal", "mktsegment").where("a_acctbal > 9000").out("CUSTOMER_IN|SUPPLIER_IN").node("n", "Nation", "name")
    back = m.also(g.match().node("r", "Region", "name").into("IN_REGION").node("n", "Nation").into("CUSTOMER_IN|SUPPLIER_IN").node("a", "Customer|Supplier"))
    return back.rows().select(F.col("a_label").alias("label"), F.col("a").alias("id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("a_mktsegment").alias("segment"))


@registered("""
    SELECT n_name AS nation, c_mktsegment AS segment, min(o_totalprice) - 100 AS least, (max(o_totalprice) - min(o_totalprice)) / count(*) AS spread
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY spread DESC, nation, segment LIMIT 20
""")
def pattern_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.key_graph(spark, sf_dir).match().node("o", "Orders", "totalprice").into("PLACED").node("c", "Customer", "mktsegment").out("CUSTOMER_IN").node("n", "Nation", "name")
    price = F.col("o_totalprice")
    found = m.rows().groupBy(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))
    found = found.agg((F.min(price) - 100).alias("least"), ((F.max(price) - F.min(price)) / F.count("*")).alias("spread"))
    return found.orderBy(F.col("spread").desc(), "nation", "segment").limit(20)


@registered(f"""
    WITH RECURSIVE {_ROAD}, {_SEEDS},
    walk(seed, node, total) AS (
        SELECT node, node, CAST(0 AS DOUBLE) FROM seeds
        UNION
        SELECT seed, dst, total + largo_m FROM walk JOIN arcs ON node = src WHERE total + largo_m <= 400)
    SELECT seed, s_suppkey AS place, min(total) AS total FROM walk JOIN supplier ON node = s_suppkey * 7 GROUP BY ALL
""")
def path_nearest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = paths.isochrone(_arcs(spark, sf_dir), _seeds(spark, sf_dir), "largo_m", 400.0)
    anchors = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), (F.col("s_suppkey") * 7).alias("node"))
    return paths.nearest_places(reached, anchors)


@registered(f"""
    WITH RECURSIVE {_ROAD},
    walk(node, hops) AS (
        SELECT p_partkey, 0 FROM part WHERE p_size % 10 = 0
        UNION
        SELECT dst, hops + 1 FROM walk JOIN arcs ON node = src WHERE hops < 40)
    SELECT node, min(hops) AS hops FROM walk GROUP BY node
""")
def path_min_hops_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = fx.table(spark, sf_dir, "part").filter("p_size % 10 = 0").select(F.col("p_partkey").alias("node"))
    return paths.hops_to_nearest(_arcs(spark, sf_dir), sources)


@registered(f"""
    WITH RECURSIVE {_ROAD}, {_SEEDS},
    walk(seed, node, hops, path) AS (
        SELECT node, node, 0, [node] FROM seeds
        UNION ALL
        SELECT seed, dst, hops + 1, list_append(path, dst) FROM walk JOIN arcs ON node = src WHERE hops < 6 AND NOT list_contains(path, dst)),
    least AS (SELECT seed, node, min(hops) AS hops FROM walk GROUP BY ALL)
    SELECT seed, node AS target, hops, array_to_string(path, '>') AS path FROM walk JOIN least USING (seed, node, hops)
""")
def path_all_shortest_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, everywhere = _seeds(spark, sf_dir), fx.grid_nodes(spark, sf_dir)
    found = paths.all_shortest(_arcs(spark, sf_dir), seeds, everywhere, most_hops=6)
    return found.withColumn("path", F.array_join(F.transform("path", lambda n: n.cast("string")), ">"))


@registered(f"""
    WITH RECURSIVE {_ROAD}, {_SEEDS},
    walk(seed, node, total) AS (
        SELECT node, node, CAST(0 AS DOUBLE) FROM seeds
        UNION
        SELECT seed, dst, total + largo_m FROM walk JOIN arcs ON node = src WHERE total + largo_m <= 500)
    SELECT seed, node, min(total) AS total FROM walk GROUP BY ALL
""")
def isochrone_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.isochrone(_arcs(spark, sf_dir), _seeds(spark, sf_dir), "largo_m", 500.0)


@registered(f"""
    WITH RECURSIVE {_ROAD}, {_SEEDS},
    walk(seed, node, total) AS (
        SELECT node, node, CAST(0 AS DOUBLE) FROM seeds
        UNION
        SELECT seed, dst, total + largo_m FROM walk JOIN arcs ON node = src WHERE total + largo_m <= 500)
    SELECT segmento_id, u, v FROM road WHERE u IN (SELECT node FROM walk) AND v IN (SELECT node FROM walk)
""")
def reachable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = paths.isochrone(_arcs(spark, sf_dir), _seeds(spark, sf_dir), "largo_m", 500.0)
    return paths.reachable_segments(fx.grid_road(spark, sf_dir), reached).select("segmento_id", "u", "v")


_TRIPS = """
    n AS (SELECT count(*) AS n FROM part),
    ahead AS (
        SELECT s_suppkey AS trip, a.u AS source, c.v AS target, c.v - a.u IN (3, 150) AS straight
        FROM supplier, n JOIN road a ON a.u = (s_suppkey * 197) % n JOIN road b ON b.u = a.v JOIN road c ON c.u = b.v),
    trips AS (
        SELECT trip, source, CASE trip % 3 WHEN 0 THEN max(target) WHEN 1 THEN min(target) ELSE max(target) FILTER (NOT straight) END AS target
        FROM ahead GROUP BY trip, source HAVING target IS NOT NULL)
"""


def _trips(spark: SparkSession, sf_dir: str, road: DataFrame | None = None) -> DataFrame:
    """A trip for each supplier to a junction that three segments lead to: the last one, the first one, or the last round a bend."""
    n = fx.table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    k = fx.table(spark, sf_dir, "supplier").crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("trip"), (F.col("s_suppkey") * 197 % F.col("n")).alias("source"))
    step = fx.grid_road(spark, sf_dir) if road is None else road
    ahead = k.withColumn("at", F.col("source"))
    for _ in range(3):
        ahead = ahead.join(step.select(F.col("u").alias("at"), "v"), "at").select("trip", "source", F.col("v").alias("at"))
    bend = F.max(F.when(~(F.col("at") - F.col("source")).isin(3, 150), F.col("at"))).alias("bend")
    found = ahead.groupBy("trip", "source").agg(F.max("at").alias("last"), F.min("at").alias("first"), bend)
    target = F.when(F.col("trip") % 3 == 0, F.col("last")).when(F.col("trip") % 3 == 1, F.col("first")).otherwise(F.col("bend"))
    return found.select("trip", "source", target.alias("target")).filter("target is not null")


@registered(f"""
    WITH RECURSIVE {_ROAD}, {_TRIPS},
    ways AS (SELECT u AS src, v AS dst, segmento_id, calle, largo_m FROM road UNION ALL SELECT v, u, segmento_id, calle, largo_m FROM road),
    steps AS (SELECT * FROM ways UNION ALL SELECT src, dst, segmento_id, '', largo_m FROM ways),
    corner AS (SELECT DISTINCT src AS node, calle FROM ways),
    shared AS (SELECT trip, source, target, a.calle FROM trips JOIN corner a ON a.node = source JOIN corner b ON b.node = target AND b.calle = a.calle),
    wanted AS (SELECT * FROM shared UNION ALL SELECT trip, source, target, '' FROM trips),
    best(source, calle, node, cost) USING KEY (source, calle, node) AS (
        SELECT DISTINCT source, calle, source, [0.0::DOUBLE, 0] FROM wanted
        UNION
        SELECT b.source, b.calle, s.dst, min([b.cost[1] + s.largo_m, b.cost[2] + 1])
        FROM best b JOIN steps s ON s.src = b.node AND s.calle = b.calle
        LEFT JOIN recurring.best r ON r.source = b.source AND r.calle = b.calle AND r.node = s.dst
        WHERE r.node IS NULL OR [b.cost[1] + s.largo_m, b.cost[2] + 1] < r.cost
        GROUP BY b.source, b.calle, s.dst),
    before AS (
        SELECT b.source, b.calle, b.node, min([p.node, s.segmento_id]) AS step
        FROM best b JOIN steps s ON s.dst = b.node AND s.calle = b.calle
        JOIN best p ON p.source = b.source AND p.calle = b.calle AND p.node = s.src AND [p.cost[1] + s.largo_m, p.cost[2] + 1] = b.cost
        GROUP BY b.source, b.calle, b.node),
    chosen AS (
        SELECT w.*, b.cost[1] AS metres FROM wanted w JOIN best b ON b.source = w.source AND b.calle = w.calle AND b.node = w.target
        QUALIFY row_number() OVER (PARTITION BY w.trip ORDER BY w.calle = '', metres, w.calle) = 1),
    walk AS (
        SELECT trip, source, calle, metres, target AS node, CAST([] AS BIGINT[]) AS segments FROM chosen
        UNION ALL
        SELECT w.trip, w.source, w.calle, w.metres, b.step[1], list_prepend(b.step[2], w.segments)
        FROM walk w JOIN before b ON b.source = w.source AND b.calle = w.calle AND b.node = w.node WHERE w.node <> w.source)
    SELECT w.trip, w.source, c.target, nullif(w.calle, '') AS calle, metres, array_to_string(segments, '>') AS segments
    FROM walk w JOIN trips c ON c.trip = w.trip WHERE w.node = w.source
""")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From corner to corner, along a street that both lie on, or else any way, with the segments in order."""
    road = checkpoint(fx.grid_road(spark, sf_dir).select("segmento_id", "u", "v", "largo_m", F.col("calle").alias("calle_id")))
    trips = checkpoint(_trips(spark, sf_dir, road))
    found = street_routes.routes(road, trips)
    segments = F.array_join(F.transform("segmentos", lambda s: s.cast("string")), ">").alias("segments")
    return found.join(trips, "trip").select("trip", "source", "target", F.col("calle_id").alias("calle"), "metres", segments)


def _route_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Streets, rows of two or three corners (every fifth has none) with the streets of their corners, and two points for each row."""
    road = fx.grid_road(spark, sf_dir)
    on = road.select(F.explode(F.array("u", "v")).alias("node"), "calle").distinct().groupBy("node").agg(F.collect_set("calle").alias("calles"))
    corners = F.when(F.col("trip") % 5 == 0, F.array().cast("array<bigint>")).when(F.col("trip") % 3 == 0, F.array("source", "target", "source")).otherwise(F.array("source", "target"))
    trips = _trips(spark, sf_dir)
    at = lambda end: on.select(F.col("node").alias(end), F.col("calles").alias(f"{end}_calles"))
    rows = trips.join(at("source"), "source", "left").join(at("target"), "target", "left")
    no_streets = F.array().cast("array<string>")
    rows = rows.select(F.col("trip").alias("fila"), corners.alias("esquinas"), F.array_union(F.coalesce("source_calles", no_streets), F.coalesce("target_calles", no_streets)).alias("calles"))
    points = fx.points(spark, sf_dir, "customer").withColumn("fila", F.floor(F.col("id") / 2))
    points = points.join(rows.select("fila", "calles"), "fila")
    own = F.when(F.col("id") % 3 == 0, F.lower(F.get("calles", F.lit(0))))
    streets = road.select(F.col("calle").alias("calle_id"), F.col("calle").alias("nombre")).distinct()
    return streets, rows, points.select("fila", F.col("id").alias("punto"), "x", "y", own.alias("calle"))


_LABELS = """
    part_of(node, component) USING KEY (node) AS (
        SELECT p_partkey, p_partkey FROM part WHERE p_partkey IN (SELECT src FROM arcs)
        UNION
        SELECT p.node, min(q.component) FROM recurring.part_of p JOIN arcs ON p.node = src JOIN part_of q ON q.node = dst
        WHERE q.component < p.component GROUP BY p.node)
"""


@registered(f"WITH RECURSIVE {_ROAD}, {_LABELS} SELECT node, component FROM part_of")
def components_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(fx.grid_road(spark, sf_dir), "u", "v")


@registered(f"""
    WITH {_ROAD},
    starts AS (SELECT *, v - u AS step, CASE WHEN lag(v) OVER (PARTITION BY calle ORDER BY u) = u THEN 0 ELSE 1 END AS opens FROM road),
    runs AS (SELECT *, sum(opens) OVER (PARTITION BY calle ORDER BY u ROWS UNBOUNDED PRECEDING) AS run FROM starts)
    SELECT segmento_id, calle AS name, min(u) OVER (PARTITION BY calle, run) AS axis_node FROM runs
""")
def components_same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.axes(fx.grid_road(spark, sf_dir), "calle").select("segmento_id", "name", F.col("axis.node").alias("axis_node"))


@registered(f"""
    WITH RECURSIVE {_ROAD}, {_LABELS},
    top AS (SELECT component FROM part_of GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
    SELECT node FROM part_of WHERE component IN (SELECT component FROM top)
""")
def giant_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.giant_nodes(fx.grid_road(spark, sf_dir), "u", "v")


# Networks


@registered("""
    WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    SELECT a.l_suppkey AS calle_a, b.l_suppkey AS calle_b, count(*) AS esquinas FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL
""")
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = fx.key_graph(spark, sf_dir).edges["SUPPLIES"].rows
    return network.crossings(members.select(F.col("dst").alias("nodo_id"), F.col("src").alias("calle_id")))


@registered(f"""
    WITH {_ROAD}, j AS (SELECT u AS nodo_id, calle FROM road UNION SELECT v, calle FROM road)
    SELECT a.calle AS calle_a, b.calle AS calle_b, count(*) AS esquinas FROM j a JOIN j b ON a.nodo_id = b.nodo_id AND a.calle < b.calle GROUP BY ALL
""")
def street_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    road = fx.grid_road(spark, sf_dir).withColumnRenamed("calle", "calle_id")
    return network.crossings(network.street_junctions(road))


@registered(f"WITH {_ROAD} SELECT p_partkey AS node, count(src) AS grado FROM part LEFT JOIN arcs ON src = p_partkey GROUP BY p_partkey")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.degrees(fx.grid_nodes(spark, sf_dir), fx.grid_road(spark, sf_dir))


@registered(f"""
    WITH RECURSIVE {_ROAD}, {_LABELS},
    sizes AS (SELECT component, count(*) AS n FROM part_of GROUP BY component)
    SELECT 'grid' AS red, (SELECT CAST(sum(n) AS BIGINT) FROM sizes) AS nodos, count(*) AS tramos, count(*) + count(*) FILTER (sentido = 'ambos') AS arcos, sum(largo_m) / 1000 AS km,
           2.0 * count(*) / (SELECT sum(n) FROM sizes) AS grado_medio, (SELECT count(*) FROM sizes) AS componentes,
           CAST((SELECT max(n) FROM sizes) AS DOUBLE) / (SELECT sum(n) FROM sizes) AS componente_mayor
    FROM road
""")
def network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.summary("grid", network.directed_edges(fx.grid_road(spark, sf_dir)))


@registered(f"""
    WITH {_ROAD} SELECT segmento_id, u, v FROM road WHERE sentido <> 'inverso' UNION ALL SELECT segmento_id, v, u FROM road WHERE sentido <> 'directo'
""")
def oneway_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.directed_edges(fx.grid_road(spark, sf_dir)).select("segmento_id", "u", "v")


def _pick(values: tuple, by: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[(({by}) % {len(values)}) + 1]"


_TAGS = f"""
    tags AS (SELECT p_partkey AS way_id,
        {_pick(("residential", "motorway", "footway", "cycleway", "service", "path", "primary", "steps", None, "Track "), "p_partkey")} AS highway,
        {_pick((None, "private", "no", "yes", ""), "p_partkey * 3 + p_size")} AS access, {_pick((None, None, "yes", "no", "\tDesignated\u00a0"), "p_partkey + p_size")} AS bicycle,
        {_pick((None, "no", "yes"), "p_size")} AS foot, {_pick((None, None, "yes", "no"), "p_partkey * 5 + p_size * 3")} AS motor_vehicle,
        {_pick((None, "driveway", None, "parking_aisle", None, None, None), "p_partkey + 2 * p_size")} AS service,
        {_pick((None, "yes", "-1", "no", "reverse", "1"), "p_partkey * 7 + p_size")} AS oneway, {_pick((None, "lane", "no", "separate", ""), "p_partkey * 11 + p_size")} AS cycleway FROM part),
    t AS (SELECT way_id, lower(trim(coalesce(highway, ''), chr(9) || chr(160) || ' ')) AS highway, lower(trim(coalesce(access, ''), chr(9) || chr(160) || ' ')) AS access,
        lower(trim(coalesce(bicycle, ''), chr(9) || chr(160) || ' ')) AS bici, lower(trim(coalesce(foot, ''), chr(9) || chr(160) || ' ')) AS foot,
        lower(trim(coalesce(motor_vehicle, ''), chr(9) || chr(160) || ' ')) AS auto, lower(trim(coalesce(service, ''), chr(9) || chr(160) || ' ')) AS service,
        lower(trim(coalesce(oneway, ''), chr(9) || chr(160) || ' ')) AS oneway, lower(trim(coalesce(cycleway, ''), chr(9) || chr(160) || ' ')) AS cycleway FROM tags)
"""


def _rule(own: str, open_: str, closed: str) -> str:
    """May a mode use a way: what its own tag says, where it stands, the lists of open and closed classes."""
    return f"""
        CASE WHEN service IN ('parking_aisle', 'driveway') OR highway IN ({closed}) OR {own} IN ('no', 'private') THEN false
             WHEN {own} IN ('yes', 'designated', 'permissive', 'destination', 'official') THEN true
             WHEN access IN ('no', 'private') THEN false ELSE highway IN ({open_}) END"""


#: Fixed values, written out once more for the oracle: classes of ways that each mode may use, and those that it may not.
_STREETS = """'primary', 'primary_link', 'secondary', 'secondary_link', 'tertiary', 'tertiary_link',
    'unclassified', 'residential', 'living_street', 'service'"""
_CAR = _rule("auto", f"'motorway', 'motorway_link', 'trunk', 'trunk_link', {_STREETS}", "'footway', 'pedestrian', 'path', 'track', 'steps', 'corridor', 'cycleway'")
_BICYCLE = _rule("bici", f"{_STREETS}, 'path', 'track', 'cycleway'", "'motorway', 'motorway_link', 'trunk', 'trunk_link', 'steps', 'corridor'")
_FOOT = _rule("foot", f"{_STREETS}, 'footway', 'pedestrian', 'path', 'track', 'steps', 'corridor'", "'motorway', 'motorway_link', 'trunk', 'trunk_link', 'cycleway'")


@registered(f"""
    WITH {_TAGS} SELECT way_id, {_CAR} AS permite_auto, {_BICYCLE} AS permite_bici, {_FOOT} AS permite_peaton,
        CASE WHEN oneway IN ('yes', 'true', '1') THEN 'directo' WHEN oneway IN ('-1', 'reverse') THEN 'inverso' ELSE 'ambos' END AS sentido,
        highway = 'cycleway' OR (cycleway <> '' AND cycleway NOT IN ('no', 'separate', 'none')) AS ciclovia FROM t
""")
def access_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = fx.tagged_ways(spark, sf_dir)
    tagged = network.permissions(ways).withColumns({"sentido": network.oneway(ways), "ciclovia": network.has_cycleway(ways)})
    return tagged.select("way_id", "permite_auto", "permite_bici", "permite_peaton", "sentido", "ciclovia")


def _street_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unbroken run of the grid's streets as one way, with a half-metre wobble that the tolerance takes up."""
    road = checkpoint(fx.grid_road(spark, sf_dir))
    axis = network.axes(road, "calle").select("segmento_id", F.concat_ws("@", "name", F.col("axis.node").cast("string")).alias("way_id"))
    ends = road.join(dealt(axis), "segmento_id").select("way_id", F.explode(F.array("u", "v")).alias("node")).distinct().join(dealt(fx.grid_nodes(spark, sf_dir)), "node")
    wobble = F.when(F.col("way_id").startswith("V"), F.lit(0.5)).otherwise(F.lit(0.0))
    return ends.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("node", F.col("x").alias("x"), (F.col("y") + wobble).alias("y")))).alias("l")).select("way_id", F.transform("l", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


@registered(f"""
    WITH {_ROAD},
    starts AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY calle ORDER BY u) = u THEN 0 ELSE 1 END AS opens FROM road),
    runs AS (SELECT *, calle || '@' || min(u) OVER (PARTITION BY calle, run) AS way_id
             FROM (SELECT *, sum(opens) OVER (PARTITION BY calle ORDER BY u ROWS UNBOUNDED PRECEDING) AS run FROM starts)),
    members AS (SELECT way_id, u AS node FROM runs UNION SELECT way_id, v FROM runs),
    ends AS (SELECT way_id, min(node) AS a, max(node) AS b FROM members GROUP BY way_id),
    junctions AS (SELECT node FROM members GROUP BY node HAVING count(*) > 1 UNION SELECT a FROM ends UNION SELECT b FROM ends),
    along AS (SELECT way_id, node, lag(node) OVER (PARTITION BY way_id ORDER BY node) AS before FROM members JOIN junctions USING (node))
    SELECT way_id, count(before) AS segments, CAST(sum(CASE WHEN way_id LIKE 'H%' THEN (node - before) * 100 ELSE (node - before) * 2 END) AS DOUBLE) AS metres FROM along GROUP BY way_id
""")
def split_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, segments = network.split_ways(_street_lines(spark, sf_dir), 1.5)
    return segments.groupBy("way_id").agg(F.count("*").alias("segments"), F.sum("largo_m").alias("metres"))


@registered(f"""
    WITH {_ROAD},
    starts AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY calle ORDER BY u) = u THEN 0 ELSE 1 END AS opens FROM road),
    runs AS (SELECT *, sum(opens) OVER (PARTITION BY calle ORDER BY u ROWS UNBOUNDED PRECEDING) AS run FROM starts),
    axes AS (SELECT calle, run, min(u) AS a, max(v) AS z FROM runs GROUP BY calle, run),
    step AS (SELECT calle, run, a, CASE WHEN (a - lag(z) OVER w) * (CASE WHEN calle LIKE 'H%' THEN 100 ELSE 2 END) < 150 THEN 0 ELSE 1 END AS opens FROM axes WINDOW w AS (PARTITION BY calle ORDER BY a)),
    streets AS (SELECT *, sum(opens) OVER (PARTITION BY calle ORDER BY a ROWS UNBOUNDED PRECEDING) AS street FROM step),
    built AS (SELECT calle, street, min(streets.a) AS a, sum(largo_m) AS largo_m, count(*) AS segmentos, CASE WHEN 2 * count(*) FILTER (segmento_id % 3 = 0) >= count(*) THEN 'primary' ELSE 'residential' END AS tipo
              FROM runs JOIN streets USING (calle, run) GROUP BY calle, street),
    named AS (SELECT *, row_number() OVER (PARTITION BY calle ORDER BY largo_m DESC, calle || ',' || lpad(CAST(a AS VARCHAR), 12, '0')) AS k FROM built)
    SELECT lower(calle) || CASE WHEN k = 1 THEN '' ELSE '-' || k END AS calle_id, calle AS nombre, largo_m, segmentos, tipo FROM named
""")
def street_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    road, nodes = fx.grid_road(spark, sf_dir), fx.grid_nodes(spark, sf_dir)
    at = lambda end: dealt(nodes.select(F.col("node").alias(end), F.struct("x", "y").alias(f"_{end}")))
    lined = road.join(at("u"), "u").join(at("v"), "v").withColumn("line", F.array("_u", "_v")).withColumn("highway", F.when(F.col("segmento_id") % 3 == 0, "primary").otherwise("residential")).drop("_u", "_v")
    streets, _ = network.build_streets(lined, "calle", 150.0)
    return streets.select("calle_id", "nombre", "largo_m", "segmentos", "tipo")


@registered("""
    WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_suppkey AS street, any_value(l.n) AS segments, any_value(l.q) AS metres, arg_min(l_returnflag, (-c.n, l_returnflag)) AS kind, any_value(l.a) AS any_small
    FROM c JOIN (SELECT l_suppkey AS k, count(*) AS n, sum(l_quantity) AS q, bool_or(l_quantity < 2) AS a FROM lineitem GROUP BY 1) l ON k = l_suppkey GROUP BY l_suppkey
""")
def street_build_mode_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("street")).agg(F.count("*").alias("segments"), F.sum("l_quantity").alias("metres"), F.mode("l_returnflag", True).alias("kind"), F.bool_or(F.col("l_quantity") < 2).alias("any_small"))


@registered("""
    WITH s AS (SELECT p_partkey AS street, p_type AS nombre, p_retailprice AS metres, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS plain,
                      trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS brand, count(*) OVER (PARTITION BY p_type) AS n FROM part),
    b AS (SELECT *, CASE WHEN n > 1 THEN plain || '-' || brand ELSE plain END AS base FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY nombre, metres DESC, street) AS k FROM b)
    SELECT street, nombre, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS calle_id FROM r
""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.table(spark, sf_dir, "part")
    streets = parts.select(F.col("p_partkey").alias("street"), F.col("p_type").alias("nombre"), F.col("p_retailprice").alias("largo_m"), F.col("p_brand").alias("comuna"))
    return network.unique_names(streets).select("street", "nombre", "calle_id")


@registered("""
    WITH r AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 GROUP BY 1)
    SELECT s_suppkey AS calle_id, coalesce(n, 0) AS reclamos_ruido, coalesce(n, 0) / ((s_suppkey * 10 + 500) / 1000.0) AS ruido_por_km
    FROM supplier LEFT JOIN r ON k = s_suppkey
""")
def noise_per_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    streets = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("calle_id"), (F.col("s_suppkey") * 10 + 500).alias("largo_m"))
    lines = fx.table(spark, sf_dir, "lineitem").filter("l_quantity > 48")
    reports = lines.select(F.col("l_suppkey").alias("calle_id"), F.when(F.col("l_returnflag") == "R", "Ruido").otherwise("Otro").alias("categoria"))
    return network.noise_per_street(streets, reports).select("calle_id", "reclamos_ruido", "ruido_por_km")


@registered("""
    WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN ' ' || c_mktsegment END AS declared,
                      CASE WHEN o_orderkey % 3 <> 0 THEN c_nationkey END AS calle_id, o_totalprice AS far
               FROM orders JOIN customer ON o_custkey = c_custkey),
    b AS (SELECT p.*, CASE n_nationkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END AS nombre FROM p LEFT JOIN nation ON calle_id = n_nationkey)
    SELECT count(*) AS lugares, count(calle_id) AS asignados, median(far) FILTER (calle_id IS NOT NULL) AS mediana_m,
           count(*) FILTER (declared IS NOT NULL AND calle_id IS NOT NULL) AS declarados,
           avg(CAST(trim(declared) = nombre AS INTEGER)) FILTER (declared IS NOT NULL AND calle_id IS NOT NULL) AS coinciden
    FROM b
""")
def audit_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").join(fx.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    places = rows.select(key.alias("id"), F.when(key % 4 != 0, F.concat(F.lit(" "), "c_mktsegment")).alias("addr:street"))
    near = key % 3 != 0
    assigned = rows.select(key.alias("id"), F.when(near, F.col("c_nationkey")).alias("calle_id"), F.when(near, F.col("o_totalprice")).alias("distancia_m"))
    k = F.col("n_nationkey") % 3
    named = F.when(k == 0, "BUILDING").when(k == 1, "MACHINERY").otherwise("FURNITURE").alias("nombre")
    return network.audit(places, assigned, fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("calle_id"), named))


@registered(f"""
    WITH {_ROAD}, e AS (SELECT u AS node, v AS other, calle FROM road UNION ALL SELECT v, u, calle FROM road)
    SELECT node, array_to_string(list_sort(list(DISTINCT other)), ',') AS neighbours, array_to_string(list_sort(list(DISTINCT calle)), ',') AS calles FROM e GROUP BY node
""")
def corner_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = network.corner_index(fx.grid_road(spark, sf_dir).withColumnRenamed("calle", "calle_id"))
    return found.select("node", F.array_join(F.transform("neighbours", lambda n: n.cast("string")), ",").alias("neighbours"), F.array_join("calles", ",").alias("calles"))


_LINED = """
    l AS (SELECT segmento_id, calle, u, v, largo_m, (u % 50) * 100.0 AS ax, (u // 50) * 100.0 AS ay, (v % 50) * 100.0 AS bx, (v // 50) * 100.0 AS b_y FROM road)
"""


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's segments with straight lines and calle_id."""
    nodes = fx.grid_nodes(spark, sf_dir)
    at = lambda end: dealt(nodes.select(F.col("node").alias(end), F.struct("x", "y").alias(f"_{end}")))
    road = fx.grid_road(spark, sf_dir).join(at("u"), "u").join(at("v"), "v")
    return road.withColumn("line", F.array("_u", "_v")).withColumn("calle_id", F.col("calle")).drop("_u", "_v")


@registered(f"WITH {_ROAD}, {_LINED} SELECT min(least(ax, bx)) AS x0, min(least(ay, b_y)) AS y0, max(greatest(ax, bx)) AS x1, max(greatest(ay, b_y)) AS y1 FROM l")
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.bounds(_lined(spark, sf_dir))


@registered(f"""
    WITH {_ROAD}, {_LINED}, m AS (SELECT calle, segmento_id, largo_m, (ax + bx) / 2 AS x, (ay + b_y) / 2 AS y FROM l),
    c AS (SELECT calle, avg(x) AS mx, avg(y) AS my, sum(largo_m) AS metres FROM m GROUP BY calle),
    r AS (SELECT m.calle, m.x, m.y, c.metres, row_number() OVER (PARTITION BY m.calle ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my), 6), segmento_id) AS k FROM m JOIN c USING (calle))
    SELECT calle AS calle_id, x, y FROM r WHERE k = 1 ORDER BY CASE calle WHEN 'V3' THEN 1 WHEN 'H2' THEN 2 END NULLS LAST, metres DESC, calle LIMIT 12
""")
def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    focus = fx.grid_road(spark, sf_dir).select(F.col("calle").alias("calle_id")).distinct().filter(F.col("calle_id").isin("V3", "H2"))
    focus = focus.withColumn("prioridad", F.when(F.col("calle_id") == "V3", 1).otherwise(2))
    return network.label_places(_lined(spark, sf_dir), focus, 12)


@registered(f"""
    WITH {_ROAD}, {_LINED}
    SELECT calle AS calle_id, count(*) AS parts, array_to_string(list(CAST(ax + ay AS BIGINT) ORDER BY segmento_id), ',') AS starts FROM l GROUP BY calle
""")
def street_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = network.dissolved(_lined(spark, sf_dir), "calle_id")
    starts = F.transform("lines", lambda part: (part[0]["x"] + part[0]["y"]).cast("long").cast("string"))
    return found.select("calle_id", F.size("lines").cast("long").alias("parts"), F.array_join(starts, ",").alias("starts"))


_AREA = """
    h AS (SELECT count(*) // 50 AS h FROM part),
    edge(ex, ey, fx, fy) AS (
        SELECT 130.5, -50.0, 4711.25, 10.0 UNION ALL SELECT 4711.25, 10.0, 2100.5, h * 90 + 37.0 FROM h UNION ALL SELECT 2100.5, h * 90 + 37.0, 130.5, -50.0 FROM h
        UNION ALL SELECT 1500.5, h * 20 + 5.5, 2500.5, h * 20 + 5.5 FROM h UNION ALL SELECT 2500.5, h * 20 + 5.5, 2000.25, h * 50 + 7.5 FROM h
        UNION ALL SELECT 2000.25, h * 50 + 7.5, 1500.5, h * 20 + 5.5 FROM h)
"""


def _area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle over the grid with a triangle out of it."""
    h = fx.table(spark, sf_dir, "part").agg(F.floor(F.count("*") / 50).alias("h"))
    point = lambda x, a, b: F.struct(F.lit(x).alias("x"), (F.col("h") * a + b).cast("double").alias("y"))
    ring = lambda *p: F.array(*(point(*v) for v in (*p, p[0])))
    outer, hole = ring((130.5, 0, -50.0), (4711.25, 0, 10.0), (2100.5, 90, 37.0)), ring((1500.5, 20, 5.5), (2500.5, 20, 5.5), (2000.25, 50, 7.5))
    return h.select(F.lit(1).alias("polygon_id"), F.array(outer, hole).alias("rings"))


@registered(f"""
    WITH {_ROAD}, {_LINED}, {_AREA},
    meets AS (
        SELECT segmento_id, ((ex - ax) * (fy - ey) - (ey - ay) * (fx - ex)) / ((bx - ax) * (fy - ey) - (b_y - ay) * (fx - ex)) AS t,
               ((ex - ax) * (b_y - ay) - (ey - ay) * (bx - ax)) / ((bx - ax) * (fy - ey) - (b_y - ay) * (fx - ex)) AS u
        FROM l, edge WHERE (bx - ax) * (fy - ey) <> (b_y - ay) * (fx - ex)),
    cuts AS (SELECT segmento_id, t FROM meets WHERE t > 0 AND t < 1 AND u BETWEEN 0 AND 1 UNION SELECT segmento_id, unnest([0.0, 1.0]) FROM l),
    stretch AS (SELECT segmento_id, t AS t0, lead(t) OVER (PARTITION BY segmento_id ORDER BY t) AS t1 FROM cuts),
    middle AS (SELECT s.*, l.ax + (t0 + t1) / 2 * (bx - ax) AS x, l.ay + (t0 + t1) / 2 * (b_y - ay) AS y FROM stretch s JOIN l USING (segmento_id) WHERE t1 IS NOT NULL),
    kept AS (
        SELECT segmento_id, t0, t1 FROM middle, edge GROUP BY segmento_id, t0, t1, x, y
        HAVING count_if((ey > y) <> (fy > y) AND x < (fx - ex) * (y - ey) / (CASE WHEN fy = ey THEN 1 ELSE fy - ey END) + ex) % 2 = 1)
    SELECT segmento_id AS way_id, CAST(row_number() OVER (PARTITION BY segmento_id ORDER BY t0) - 1 AS INTEGER) AS part, round((t1 - t0) * (abs(bx - ax) + abs(b_y - ay)), 6) AS metres
    FROM kept JOIN l USING (segmento_id)
""")
def clip_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each segment within an area with a hole."""
    lines = _lined(spark, sf_dir).select(F.col("segmento_id").alias("way_id"), "line")
    kept = areas.clip_lines(lines, _area(spark, sf_dir), 250.0)
    return kept.select("way_id", "part", F.round(geo.line_length(F.col("line")), 6).alias("metres"))


_BLOCKS = """
    cell AS (SELECT p_partkey % 50 AS gx, p_partkey // 50 AS gy FROM part),
    named AS (SELECT gx, gy, (gx // 5) || '-' || (gy // 4) AS block, gx % 5 = 2 AND gy % 4 = 1 AS hole FROM cell),
    zone AS (SELECT gx, gy, CASE WHEN hole THEN 'hole ' ELSE 'block ' END || block AS name FROM named)
"""


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of 100 m for each junction of the grid; five by four of one name, with one of another in it."""
    k = F.col("p_partkey")
    gx, gy = k % 50, F.floor(k / 50)
    corner = lambda dx, dy: F.struct(((gx + dx) * 100).cast("double").alias("x"), ((gy + dy) * 100).cast("double").alias("y"))
    block = F.concat_ws("-", F.floor(gx / 5).cast("string"), F.floor(gy / 4).cast("string"))
    name = F.concat(F.when((gx % 5 == 2) & (gy % 4 == 1), "hole ").otherwise("block "), block).alias("name")
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return fx.table(spark, sf_dir, "part").select(k.alias("polygon_id"), name, F.array(ring).alias("rings"))


@registered(f"""
    WITH {_BLOCKS}, side AS (SELECT z.name, n.name AS other FROM zone z, unnest([[0, 1], [1, 0], [0, -1], [-1, 0]]) t(d) LEFT JOIN zone n ON n.gx = z.gx + d[1] AND n.gy = z.gy + d[2])
    SELECT name, count(*) * 10000.0 AS area, CAST(CASE WHEN name LIKE 'hole%' THEN 1 ELSE 2 END AS INTEGER) AS rings,
           (SELECT count(*) * 100.0 FROM side WHERE side.name = zone.name AND other IS DISTINCT FROM side.name) AS outline
    FROM zone GROUP BY name
""")
def dissolve_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares of each name as one area, with the hole that another name leaves."""
    found = areas.dissolve(_squares(spark, sf_dir), "name")
    outline = F.aggregate("rings", F.lit(0.0), lambda s, r: s + geo.line_length(r)).alias("outline")
    return found.select("name", "area", F.size("rings").alias("rings"), outline)


@registered(f"""
    WITH {_BLOCKS}
    SELECT gy * 50 + gx AS polygon_id, CAST((least(gx * 100 + 100, 1250) - greatest(gx * 100, 150)) * (least(gy * 100 + 100, 350) - greatest(gy * 100, 50)) AS DOUBLE) AS area
    FROM zone WHERE gx * 100 < 1250 AND gx * 100 + 100 > 150 AND gy * 100 < 350 AND gy * 100 + 100 > 50
""")
def clip_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares cut by a box."""
    kept = areas.clip_rings(_squares(spark, sf_dir), 150.0, 50.0, 1250.0, 350.0)
    area = F.aggregate("rings", F.lit(0.0), lambda s, r: s + geo.ring_area(r)).alias("area")
    return kept.select("polygon_id", area).filter("area > 0")


@registered(f"""
    WITH {_ROAD}, {_LINED}
    SELECT segmento_id, CAST(greatest(ax, 150) AS DOUBLE) AS ax, CAST(greatest(ay, 50) AS DOUBLE) AS ay, CAST(least(bx, 1250) AS DOUBLE) AS bx, CAST(least(b_y, 350) AS DOUBLE) AS by_
    FROM l WHERE ax <= 1250 AND bx >= 150 AND ay <= 350 AND b_y >= 50
""")
def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each segment within a box."""
    nodes = fx.grid_nodes(spark, sf_dir)
    at = lambda end, k: dealt(nodes.select(F.col("node").alias(end), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")))
    segments = fx.grid_road(spark, sf_dir).join(at("u", "a"), "u").join(at("v", "b"), "v")
    kept = spatial.clip(segments, 150.0, 50.0, 1250.0, 350.0)
    return kept.select("segmento_id", "ax", "ay", "bx", F.col("by").alias("by_"))


@registered(f"""
    WITH {_POINTS}, {_ROAD}, {_LINED},
    d AS (SELECT s.id, segmento_id, calle, sqrt((x - greatest(ax, least(bx, x))) * (x - greatest(ax, least(bx, x))) + (y - greatest(ay, least(b_y, y))) * (y - greatest(ay, least(b_y, y)))) AS far FROM s, l),
    near AS (SELECT id, arg_min(segmento_id, (far, segmento_id)) AS segmento_id, arg_min(calle, (far, segmento_id)) AS calle, min(far) AS far FROM d WHERE far <= 40 GROUP BY id),
    told AS (SELECT id, calle, min(far) AS far FROM d WHERE id % 3 = 0 AND calle = 'H' || id % 7 GROUP BY id, calle)
    SELECT s.id, lower(coalesce(told.calle, near.calle)) AS calle_id, near.segmento_id, round(coalesce(told.far, near.far), 6) AS distancia_m,
           CASE WHEN told.calle IS NOT NULL THEN 'declarada' WHEN near.calle IS NOT NULL THEN 'cercania' END AS origen
    FROM s LEFT JOIN near USING (id) LEFT JOIN told USING (id)
""")
def assign_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The street of each point: the declared one where there is such a street, else the nearest."""
    nodes = fx.grid_nodes(spark, sf_dir)
    at = lambda end, k: dealt(nodes.select(F.col("node").alias(end), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")))
    segments = fx.grid_road(spark, sf_dir).join(at("u", "a"), "u").join(at("v", "b"), "v").withColumn("calle_id", F.lower("calle"))
    streets = segments.select("calle_id", F.col("calle").alias("nombre")).distinct()
    declared = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" h"), (F.col("id") % 7).cast("string")))
    points = fx.points(spark, sf_dir, "supplier").withColumn("told", declared)
    found = network.assign_street(points, segments.select("segmento_id", "calle_id", "ax", "ay", "bx", "by"), streets, 40.0, "told")
    return found.withColumn("distancia_m", F.round("distancia_m", 6))


# Space


@registered(f"WITH {_POINTS} SELECT c.id AS left_id, s.id AS right_id, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS distance FROM c, s WHERE distance <= 100")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.radius_join(fx.points(spark, sf_dir, "customer"), fx.points(spark, sf_dir, "supplier"), 100.0)


@registered(f"""
    WITH {_POINTS}, d AS (SELECT c.id AS left_id, s.id AS right_id, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS distance FROM c, s)
    SELECT left_id, arg_min(right_id, (distance, right_id)) AS right_id, min(distance) AS distance FROM d GROUP BY left_id
""")
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_join(fx.points(spark, sf_dir, "customer"), fx.points(spark, sf_dir, "supplier"), 200.0)


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping triangles, one for each nation."""
    k = F.col("n_nationkey").cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    first = corner(k * 190, k * 3)
    return fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("polygon_id"), F.array(F.array(first, corner(k * 190 + 400, k * 3), corner(k * 190 + 200, k * 3 + 900), first)).alias("rings"))


@registered(f"""
    WITH {_POINTS},
    z AS (SELECT n_nationkey AS polygon_id, n_nationkey * 190.0 AS x0, n_nationkey * 3.0 AS y0 FROM nation),
    held AS (SELECT c.id, polygon_id FROM c, z WHERE y > y0 AND y < y0 + 900 AND x > x0 + 200 * (y - y0) / 900 AND x < x0 + 400 - 200 * (y - y0) / 900)
    SELECT c.id, min(polygon_id) AS polygon_id FROM c LEFT JOIN held USING (id) GROUP BY c.id
""")
def within_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.within_join(fx.points(spark, sf_dir, "customer"), _zones(spark, sf_dir), 500.0)


@registered(f"""
    WITH RECURSIVE {_POINTS}, near AS (SELECT a.id AS src, b.id AS dst FROM c a, c b WHERE a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 40 * 40),
    walk(id, other) AS (SELECT id, id FROM c UNION SELECT id, dst FROM walk JOIN near ON other = src)
    SELECT id, min(other) AS cluster FROM walk GROUP BY id
""")
def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cluster(fx.points(spark, sf_dir, "customer"), 40.0)


@registered(f"""
    WITH {_POINTS}, {_ROAD},
    g AS (SELECT segmento_id, (u % 50) * 100.0 AS ax, (u // 50) * 100.0 AS ay, (v % 50) * 100.0 AS bx, (v // 50) * 100.0 AS b_y FROM road),
    d AS (SELECT s.id, segmento_id, sqrt((x - greatest(ax, least(bx, x))) * (x - greatest(ax, least(bx, x))) + (y - greatest(ay, least(b_y, y))) * (y - greatest(ay, least(b_y, y)))) AS distance FROM s, g)
    SELECT s.id, arg_min(segmento_id, (distance, segmento_id)) AS segmento_id, round(min(distance), 6) AS distance FROM s LEFT JOIN (SELECT * FROM d WHERE distance <= 40) USING (id) GROUP BY s.id
""")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fx.grid_nodes(spark, sf_dir)
    at = lambda end, k: dealt(nodes.select(F.col("node").alias(end), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")))
    segments = fx.grid_road(spark, sf_dir).join(at("u", "a"), "u").join(at("v", "b"), "v")
    found = spatial.nearest_segment(fx.points(spark, sf_dir, "supplier"), segments, 40.0)
    return found.withColumn("distance", F.round("distance", 6))


@registered("""
    WITH c AS (SELECT 1 / 298.257223563 AS f, 6378137.0 AS a), k AS (SELECT f / (2 - f) AS n, a FROM c),
    p AS (SELECT n, a / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS big, 2 * sqrt(n) / (1 + n) AS e, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM k),
    h AS (SELECT greatest(count(*) // 50 - 1, 1) AS h FROM part),
    d AS (SELECT c_custkey AS id, radians(((c_custkey * 6151) % 490000) / 100.0 / 100000 - 70.7) - radians(6 * 19 - 183) AS dl, sin(radians(((c_custkey * 7919) % (h * 10000)) / 100.0 / 100000 - 33.5)) AS s FROM customer, h),
    t AS (SELECT id, dl, sinh(atanh(s) - e * atanh(e * s)) AS t, p.* FROM d, p),
    x AS (SELECT id, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta, big, a1, a2, a3 FROM t)
    SELECT id, round(500000 + 0.9996 * big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS x,
           round(10000000 + 0.9996 * big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS y FROM x
""")
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.points(spark, sf_dir, "customer").select("id", (F.col("x") / 100_000 - 70.7).alias("lon"), (F.col("y") / 100_000 - 33.5).alias("lat"))
    return geo.project_utm(points, "lon", "lat").select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@registered("""
    WITH h AS (SELECT greatest(count(*) // 50 - 1, 1) AS h FROM part)
    SELECT c_custkey AS id, round(((c_custkey * 6151) % 490000) / 100.0 / 100000 - 70.7, 7) AS lon, round(((c_custkey * 7919) % (h * 10000)) / 100.0 / 100000 - 33.5, 7) AS lat
    FROM customer, h
""")
def utm_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to metres and back, to seven places."""
    points = fx.points(spark, sf_dir, "customer").select("id", (F.col("x") / 100_000 - 70.7).alias("lon"), (F.col("y") / 100_000 - 33.5).alias("lat"))
    there = geo.project_utm(points, "lon", "lat").select("id", "x", "y")
    return geo.unproject_utm(there, "x", "y").select("id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@registered(f"""
    WITH {_ROAD}, {_LINED}
    SELECT segmento_id, calle, round(ax, 6) AS xmin, round(ay, 6) AS ymin, round(bx, 6) AS xmax, round(b_y, 6) AS ymax, CAST(2 AS INTEGER) AS vertices FROM l
    WHERE bx >= 150 AND b_y >= 50 AND ax <= 1250 AND ay <= 350
""")
def geo_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's lines written as well-known binary, and those that touch a box read back."""
    path = scratch_path(spark, "layer")
    rows = _lined(spark, sf_dir).select("segmento_id", "calle", wkb.geometry("LineString", F.col("line")).alias("geometry"))
    wkb.write_geo(rows, path)
    back = wkb.read_geo(spark, path, ["segmento_id", "calle"], (150.0, 50.0, 1250.0, 350.0)).withColumn("b", wkb.bounds())
    return back.select("segmento_id", "calle", *(F.col(f"b.{c}") for c in ("xmin", "ymin", "xmax", "ymax")), F.size(F.element_at(wkb.line_parts(), 1)).alias("vertices"))


@registered("""
    SELECT n_nationkey AS id, CAST(180000 AS DOUBLE) AS area, CAST(n_nationkey * 190 + 200 AS DOUBLE) AS cx, CAST(n_nationkey * 3 + 300 AS DOUBLE) AS cy,
           'POINT (' || n_nationkey * 190.0 || ' ' || n_nationkey * 3.0 || ')' AS wkt FROM nation
""")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.col("rings")[0]
    middle = geo.ring_centroid(ring)
    return _zones(spark, sf_dir).select(
        F.col("polygon_id").alias("id"),
        geo.ring_area(ring).alias("area"),
        F.round(middle["x"], 6).alias("cx"),
        F.round(middle["y"], 6).alias("cy"),
        geo.wkt_point(ring[0]["x"], ring[0]["y"]).alias("wkt"),
    )


@registered(f"""
    WITH {_ROAD}, {_LINED}
    SELECT segmento_id, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS metres, CAST(bx + b_y AS BIGINT) AS middle,
           'LINESTRING (' || ax || ' ' || ay || ', ' || bx || ' ' || b_y || ')' AS wkt
    FROM (SELECT segmento_id, CAST(ax AS DOUBLE) AS ax, CAST(ay AS DOUBLE) AS ay, CAST(bx AS DOUBLE) AS bx, CAST(b_y AS DOUBLE) AS b_y FROM l)
""")
def line_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    middle = geo.middle_vertex(line)
    return _lined(spark, sf_dir).select(
        "segmento_id", geo.line_length(line).alias("metres"), (middle["x"] + middle["y"]).cast("long").alias("middle"), geo.wkt_line(line).alias("wkt")
    )


# Text, ids and aggregates


@registered(r"""
    SELECT s_suppkey AS id, coalesce(nullif(trim(regexp_replace(lower(strip_accents(s_name)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'sin-nombre') AS slug FROM supplier
""")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.slug(F.col("s_name")).alias("slug"))


@registered(r"""
    SELECT s_suppkey AS id, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') || '-fi-12-ij' AS slug,
           upper(s_name) || ' FI 12 IJ' AS nombre, 'San José De ' || upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS titulo
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT LIKE '% %'
""")
def accented_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain names in accented letters, some beyond Latin-1, and compatible forms of several letters at the end."""
    rows = fx.table(spark, sf_dir, "supplier").join(fx.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.filter(~F.col("n_name").contains(" "))
    name = F.concat(F.translate("s_name", "Supleir", "Ṥửṕłḗįṟ".replace("ł", "ḽ")), F.lit(" \ufb01 \u00bd \u0133"))
    title = text.title_case(F.concat(F.lit("SAN JOSÉ DE "), "n_name"))
    return rows.select(F.col("s_suppkey").alias("id"), text.slug(name).alias("slug"), text.normal_name(name).alias("nombre"), title.alias("titulo"))


@registered(r"""
    SELECT conv_id, turn, trim(regexp_replace(replace(text, '.', chr(160) || '.' || chr(8232) || chr(28) || chr(9)), '[\s\x1c' || chr(160) || chr(8232) || ']+', ' ', 'g')) AS text
    FROM conversations
""")
def clean_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on one line, with white space beyond ASCII around each full stop."""
    spread = F.replace("text", F.lit("."), F.lit("\u00a0.\u2028\x1c\t"))
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.squeeze(spread).alias("text"))


@registered()
def anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.anonymise(F.col("text")).alias("text"))


@registered("SELECT event_id, lpad(CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS VARCHAR), 6, '0') AS reporte_id, strftime(ts, '%Y-%m-%d') AS fecha FROM events")
def positional_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"))
    return layers.numbered_reports(events, "event_id").select("event_id", "reporte_id", "fecha")


@registered("SELECT quality, count(*) AS n FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) GROUP BY quality")
def value_counts_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = fx.table(spark, sf_dir, "documents").select("doc_id").join(fx.table(spark, sf_dir, "labels").select("doc_id", "quality").distinct(), "doc_id", "left")
    return aggregates.value_counts(joined, "quality", keep_null=True)


@registered("""
    SELECT n_name AS nation, o.n * 10000.0 / c.n AS rate FROM nation
    JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey
    JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.k = n_nationkey
""")
def rate_per_10k(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, nation = (fx.table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    people = customers.groupBy("c_nationkey").agg(F.count("*").alias("people"))
    events = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("events"))
    return people.join(events, "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), aggregates.rate(F.col("events"), F.col("people")).alias("rate"))


@registered("SELECT o_orderpriority AS priority, o_orderstatus AS status, n, n * 100.0 / sum(n) OVER (PARTITION BY o_orderpriority) AS pct FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
def pct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.row_percent(fx.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").withColumnsRenamed({"o_orderpriority": "priority", "o_orderstatus": "status"})


@registered("SELECT CAST(floor(o_totalprice / 10000) AS INTEGER) AS bin, count(*) AS n FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 300000 GROUP BY 1")
def hist30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(fx.table(spark, sf_dir, "orders"), "o_totalprice", 0, 300_000, 30)


@registered("""
    SELECT count(*) AS n, sum(o_totalprice) AS total, median(o_totalprice) AS middle, avg(o_totalprice) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most,
           count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) AS share_f FROM orders
""")
def scalar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, price = fx.table(spark, sf_dir, "orders"), F.col("o_totalprice")
    return orders.agg(F.count("*").alias("n"), F.sum(price).alias("total"), F.lit(aggregates.median(orders, "o_totalprice")).cast("double").alias("middle"), F.avg(price).alias("mean"), F.min(price).alias("least"), F.max(price).alias("most"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("share_f"))


@registered("""
    SELECT c_custkey AS id, coalesce(n, 0) AS checkins FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey WHERE c_custkey % 9 <> 0
""")
def venue_checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 9 == 0, "Home (private)").otherwise(F.col("c_mktsegment")).alias("category")
    venues = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("venue_id"), kind)
    return layers.public_venues(venues, fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("venue_id"))).select(F.col("venue_id").alias("id"), "checkins")


@registered("""
    SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) b ON a.k = b.k
""")
def outer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.table(spark, sf_dir, "customer").filter("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = fx.table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@registered("""
    SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS text FROM documents
""")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.xml_escaped(F.col("text")).alias("text"))


@registered("""
    WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 3 = 1 THEN '' END AS amenity,
                      CASE WHEN c_custkey % 4 < 2 THEN 'books' END AS shop, CASE WHEN c_custkey % 5 = 0 THEN 'yes' END AS office FROM customer)
    SELECT id, coalesce('amenity=' || nullif(amenity, ''), 'shop=' || shop, 'office=' || office, 'sin_categoria') AS categoria FROM p
""")
def place_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    tags = {
        "amenity": F.when(key % 3 == 0, F.lower("c_mktsegment")).when(key % 3 == 1, ""),
        "shop": F.when(key % 4 < 2, "books"),
        "office": F.when(key % 5 == 0, "yes"),
    }
    return fx.table(spark, sf_dir, "customer").select(key.alias("id"), text.place_category(tags).alias("categoria"))


@registered("""
    WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN 'bench' WHEN 1 THEN 'cafe' END AS amenity,
                      CASE WHEN c_custkey % 5 = 0 THEN 'track' END AS leisure FROM customer)
    SELECT CAST(id AS VARCHAR) AS osm_id, name, amenity FROM p
    WHERE name IS NOT NULL OR NOT (coalesce(amenity = 'bench', false) OR coalesce(leisure = 'track', false))
""")
def admitted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named places and unnamed ones that aren't street furniture, with listed columns and ids as text."""
    key = F.col("c_custkey")
    places = fx.table(spark, sf_dir, "customer").select(
        key.alias("osm_id"),
        F.when(key % 2 == 0, F.col("c_name")).alias("name"),
        F.when(key % 3 == 0, "bench").when(key % 3 == 1, "cafe").alias("amenity"),
        F.when(key % 5 == 0, "track").alias("leisure"),
    )
    return layers.keep_listed(layers.admitted_places(places), ["name", "amenity", "not there"])


@registered("SELECT n_nationkey AS zona_id FROM nation WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_12')")
def zones_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of communes whose names are written with other accents and case."""
    zones = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zona_id"), F.translate("n_name", "AEIOU", "ÁÉÍÓÚ").alias("comuna"))
    return layers.zones_of(zones, "comuna", ["Natión_3", " nation_7 ", "NATION_12", "Nowhere"]).select("zona_id")


@registered("""
    WITH o AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
    SELECT o_custkey AS customer, o_orderkey AS orders, n FROM o WHERE k = 1
""")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest order of each customer, beside how many there are."""
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("orders"), "o_totalprice")
    first = spatial.first_of_each(orders, "customer", F.col("o_totalprice").desc(), "orders").select("customer", "orders")
    return first.join(orders.groupBy("customer").agg(F.count("*").alias("n")), "customer")


@registered("SELECT l_quantity AS value, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS price FROM lineitem GROUP BY l_quantity")
def value_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each value of a field, of several the last, in order of the values."""
    found = aggregates.steps(fx.table(spark, sf_dir, "lineitem"), "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return found.select(F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("price"))


@registered("""
    WITH c AS (SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    p AS (SELECT n_name AS name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT LIKE '%1' GROUP BY ALL)
    SELECT upper(left(name, 1)) || lower(name[2:]) AS comuna, c.n * 10000.0 / p.n AS rate FROM c JOIN p USING (name)
""")
def population_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by title-cased name against the population of that name; names that the population lacks are left out."""
    nation = fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    by = lambda t, key, name, n: fx.table(spark, sf_dir, t).join(nation, F.col(key) == F.col("n_nationkey")).groupBy(name.alias("comuna")).agg(F.count("*").alias(n))
    events = by("customer", "c_nationkey", text.title_case(F.col("n_name")), "events")
    people = by("supplier", "s_nationkey", text.title_case(F.lower("n_name")), "people").filter(~F.col("comuna").endswith("1"))
    return events.join(people, "comuna").select("comuna", aggregates.rate(F.col("events"), F.col("people")).alias("rate"))


# Files: contents of what was written and read back, of a graph whose IS_IN edges come from nodes of two labels


@registered(f"""
    WITH {_ROAD}, one AS (SELECT * REPLACE (CASE sentido WHEN 'inverso' THEN v ELSE u END AS u, CASE sentido WHEN 'inverso' THEN u ELSE v END AS v) FROM road)
    SELECT 'ROAD' AS label, 'corner:' || u AS src, 'corner:' || v AS dst, calle AS value FROM one WHERE sentido = 'ambos'
    UNION ALL SELECT 'ROAD', 'corner:' || v, 'corner:' || u, calle FROM one WHERE sentido = 'ambos'
    UNION ALL SELECT 'ONE_WAY', 'corner:' || u, 'corner:' || v, calle FROM one WHERE sentido <> 'ambos'
    UNION ALL SELECT 'IS_IN', 'customer:' || c_custkey, 'nation:' || c_nationkey, NULL FROM customer
    UNION ALL SELECT 'IS_IN', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'supplies' FROM supplier
    UNION ALL SELECT 'Nation', 'nation:' || n_nationkey, NULL, n_name FROM nation
    UNION ALL SELECT 'file', 'corner.csv customer.csv nation.csv supplier.csv is_in.csv one_way.csv road.csv', NULL, NULL
""")
def csv_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bundle")
    graph_csv.write_bundle(fx.mixed_graph(spark, sf_dir), path)
    graph = graph_csv.read_bundle(spark, path)
    out = graph.nodes["Nation"].rows.select(F.lit("Nation").alias("label"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("name").alias("value"))
    for name, t in graph.edges.items():
        label = name.split(":")[0]
        value = F.col("role") if label == "IS_IN" else F.col("calle")
        out = out.unionByName(t.rows.select(F.lit(label).alias("label"), "src", "dst", value.alias("value")))
    files = spark.read.text(f"{path}/{graph_csv.CONFIG}").select(F.lower(F.array_join(F.from_json("value", "files array<struct<path:string>>")["files"]["path"], " ")).alias("src"))
    return out.unionByName(files.select(F.lit("file").alias("label"), "src", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("value")))


_ELEMENTS = """
    elements AS (
        SELECT 'IS_IN' AS label, '->' AS directionality, 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, '{}' AS props FROM customer
        UNION ALL SELECT 'IS_IN', '->', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, '{"role":"supplies"}' FROM supplier
        UNION ALL SELECT 'ROAD', '~~', 'corner:' || u, 'corner:' || v, '{"calle":"' || calle || '"}' FROM road WHERE sentido = 'ambos'
        UNION ALL SELECT 'ONE_WAY', '->', 'corner:' || CASE sentido WHEN 'inverso' THEN v ELSE u END, 'corner:' || CASE sentido WHEN 'inverso' THEN u ELSE v END, '{"calle":"' || calle || '"}' FROM road WHERE sentido <> 'ambos'
        UNION ALL SELECT 'Nation', NULL, 'nation:' || n_nationkey, NULL, '{"name":"' || n_name || '"}' FROM nation
        UNION ALL SELECT 'Customer', NULL, 'customer:' || c_custkey, NULL, '{"segment":"' || c_mktsegment || '"}' FROM customer
        UNION ALL SELECT 'Supplier', NULL, 'supplier:' || s_suppkey, NULL, '{}' FROM supplier
        UNION ALL SELECT 'Corner', NULL, 'corner:' || p_partkey, NULL, '{}' FROM part)
"""


def _elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    props = F.to_json("props").alias("props")
    listed = edges.select(F.col("labels")[0].alias("label"), "directionality", F.col("endpoints")[0].alias("src"), F.col("endpoints")[1].alias("dst"), props)
    null = F.lit(None).cast("string")
    return listed.unionByName(nodes.select(F.col("labels")[0].alias("label"), null.alias("directionality"), F.col("id").alias("src"), null.alias("dst"), props))


@registered(f"WITH {_ROAD}, {_ELEMENTS} SELECT * FROM elements")
def json_lines_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "graph-lines")
    graph_json.write_lines(fx.mixed_graph(spark, sf_dir), path)
    return _elements(*graph_json.read_lines(spark, path))


@registered(f"WITH {_ROAD}, {_ELEMENTS} SELECT * FROM elements")
def json_document_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "graph-json")
    graph_json.write_document(fx.mixed_graph(spark, sf_dir), path)
    return _elements(*graph_json.read_document(spark, path))


@registered(f"""
    WITH {_ROAD}, {_ELEMENTS}
    SELECT CASE WHEN dst IS NULL THEN 'node' ELSE 'edge' END AS element, label, src, dst, coalesce(regexp_extract(props, '":"([^"]*)"', 1), '') AS value,
           coalesce(directionality = '~~', false) AS undirected FROM elements
""")
def graphml_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = graphml.lines(fx.mixed_graph(spark, sf_dir)).filter(F.col("order").isin(1, 2)).select("value")
    part = lambda pattern: F.regexp_extract("value", pattern, 1)
    return line.select(
        part("^<(node|edge) ").alias("element"),
        part('<data key="label">([^<]*)<').alias("label"),
        F.when(F.col("value").startswith("<node"), part('id="([^"]*)"')).otherwise(part('source="([^"]*)"')).alias("src"),
        F.nullif(part('target="([^"]*)"'), F.lit("")).alias("dst"),
        part('<data key="(?:calle|role|name|segment)">([^<]*)<').alias("value"),
        F.col("value").contains(' directed="false"').alias("undirected"),
    )


@registered("""
    SELECT 'nodo' AS clase, 'Nation' AS etiqueta, count(*) AS cantidad FROM nation UNION ALL SELECT 'nodo', 'Customer', count(*) FROM customer
    UNION ALL SELECT 'nodo', 'Supplier', count(*) FROM supplier UNION ALL SELECT 'nodo', 'Corner', count(*) FROM part
    UNION ALL SELECT 'arista', 'IS_IN', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
    UNION ALL SELECT 'arista', 'ROAD', (SELECT count(*) FROM road WHERE sentido = 'ambos') UNION ALL SELECT 'arista', 'ONE_WAY', (SELECT count(*) FROM road WHERE sentido <> 'ambos')
""".replace("\n    SELECT", f"\n    WITH {_ROAD} SELECT", 1))
def summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "summary")
    graph_csv.write_summary(fx.mixed_graph(spark, sf_dir), path)
    return graph_csv.read_summary(spark, path)


@registered(f"""
    WITH {_ROAD} SELECT CAST(CASE WHEN sentido = 'ambos' THEN 'road' ELSE 'one_way' END AS VARCHAR) AS file, CAST(sum(CASE WHEN sentido = 'ambos' THEN 2 ELSE 1 END) AS BIGINT) AS n FROM road GROUP BY 1
    UNION ALL SELECT 'corner', count(*) FROM part
""")
def csv_bundle_undirected_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bundle")
    graph_csv.write_bundle(fx.road_graph(spark, sf_dir), path)
    return graph_csv.read_bundle(spark, path).counts().select(F.lower("etiqueta").alias("file"), F.col("cantidad").alias("n"))


@registered(f"""
    WITH {_ROAD} SELECT 'edges' AS kind, CASE WHEN sentido = 'ambos' THEN '~~' ELSE '->' END AS directionality, count(*) AS n FROM road GROUP BY ALL
    UNION ALL SELECT 'nodes', NULL, count(*) FROM part
""")
def json_roundtrip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "graph-json")
    graph_json.write_lines(fx.road_graph(spark, sf_dir), path)
    nodes, edges = graph_json.read_lines(spark, path)
    counted = edges.groupBy("directionality").agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "directionality", "n")
    return counted.unionByName(nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), F.lit(None).cast("string").alias("directionality"), "n"))


@registered(f"WITH {_ROAD} SELECT 'node' AS element, count(*) AS n FROM part UNION ALL SELECT 'edge', count(*) FROM road")
def graphml_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = graphml.lines(fx.road_graph(spark, sf_dir))
    element = F.regexp_extract("value", "^<(node|edge) ", 1)
    return lines.groupBy(element.alias("element")).agg(F.count("*").alias("n")).filter("element != ''")


# The whole build: layers to a graph


_CITY = f"""
    {_ROAD},
    degrees AS (
        SELECT 'Interseccion' AS label, CAST(p_partkey AS VARCHAR) AS id, round(p_partkey % 50 * 0.001 - 70.7, 6) AS lon, round(p_partkey // 50 * 0.0009 - 33.5, 6) AS lat FROM part
        UNION ALL SELECT 'Lugar', CAST(s_suppkey AS VARCHAR), round(((s_suppkey * 4211) % 24500 * 2 + 1) / 1e6 - 70.7, 6), round(((s_suppkey * 9173) % 4500 * 2 + 1) / 1e6 - 33.5, 6) FROM supplier
        UNION ALL SELECT 'Reclamo', CAST(c_custkey AS VARCHAR), round(((c_custkey * 6151) % 24500 * 2 + 1) / 1e6 - 70.7, 6), round(((c_custkey * 7919) % 4500 * 2 + 1) / 1e6 - 33.5, 6) FROM customer
        UNION ALL SELECT 'Venue', CAST(s_suppkey AS VARCHAR), round(((s_suppkey * 3331) % 24500 * 2 + 1) / 1e6 - 70.7, 6), round(((s_suppkey * 7177) % 4500 * 2 + 1) / 1e6 - 33.5, 6) FROM supplier),
    ell AS (SELECT n, 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS big, 2 * sqrt(n) / (1 + n) AS e, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1,
                   13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM (SELECT (1 / 298.257223563) / (2 - 1 / 298.257223563) AS n)),
    conf AS (SELECT label, id, lon, lat, radians(lon) - radians(-69) AS dl, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t, ell.* FROM degrees, ell),
    turned AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM conf),
    spot AS (
        SELECT label, id, lon, lat, 500000 + 0.9996 * big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS x,
               10000000 + 0.9996 * big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS y FROM turned),
    corner AS (SELECT CAST(id AS BIGINT) AS node, x, y FROM spot WHERE label = 'Interseccion'),
    place AS (SELECT * FROM spot WHERE label <> 'Interseccion'),
    piece AS (SELECT r.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM road r JOIN corner a ON a.node = u JOIN corner b ON b.node = v),
    gap AS (
        SELECT p.label, p.id, s.segmento_id, s.calle, t, sqrt(pow(p.x - ax - t * (bx - ax), 2) + pow(p.y - ay - t * (b_y - ay), 2)) AS far
        FROM place p JOIN piece s ON p.x BETWEEN least(ax, bx) - 41 AND greatest(ax, bx) + 41 AND p.y BETWEEN least(ay, b_y) - 41 AND greatest(ay, b_y) + 41,
             LATERAL (SELECT greatest(0, least(1, ((p.x - ax) * (bx - ax) + (p.y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t)),
    near AS (SELECT label, id, arg_min(calle, (far, segmento_id)) AS calle FROM gap WHERE far <= 40 GROUP BY label, id),
    told AS (SELECT id, 'H' || CAST(id AS BIGINT) % 7 AS calle FROM place WHERE label = 'Lugar' AND CAST(id AS BIGINT) % 4 = 0 AND 'H' || CAST(id AS BIGINT) % 7 IN (SELECT calle FROM road)),
    on_street AS (
        SELECT p.label, p.id, coalesce(t.calle, n.calle) AS calle, CASE WHEN t.calle IS NOT NULL THEN 'declarada' ELSE 'cercania' END AS origen
        FROM place p LEFT JOIN told t ON p.label = 'Lugar' AND t.id = p.id LEFT JOIN near n ON n.label = p.label AND n.id = p.id WHERE coalesce(t.calle, n.calle) IS NOT NULL),
    foot AS (SELECT u AS src, v AS dst FROM road WHERE segmento_id % 5 <> 0 UNION ALL SELECT v, u FROM road WHERE segmento_id % 5 <> 0),
    part_of(node, component) USING KEY (node) AS (
        SELECT DISTINCT src, src FROM foot
        UNION
        SELECT p.node, min(q.component) FROM recurring.part_of p JOIN foot ON p.node = src JOIN part_of q ON q.node = dst WHERE q.component < p.component GROUP BY p.node),
    giant AS (SELECT node FROM part_of WHERE component IN (SELECT component FROM part_of GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)),
    at_corner AS (
        SELECT p.label, p.id, arg_min(c.node, (sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2)), c.node)) AS esquina
        FROM place p, corner c WHERE c.node IN (SELECT node FROM giant) GROUP BY p.label, p.id),
    in_zone AS (SELECT label, id, CAST(floor((x - 342000) / 600) AS BIGINT) AS zona FROM place WHERE x BETWEEN 342000 AND 345600 AND y BETWEEN 6292000 AND 6292600)
"""


def _city(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """A city on the grid: suppliers are places, some of which declare a street, and venues; customers are reports; six square zones."""

    def placed(name: str, key: str, a: int, b: int) -> DataFrame:
        k = F.col(key)
        at = fx.table(spark, sf_dir, name).select(k, F.round((k * a % 24_500 * 2 + 1) / 1e6 - 70.7, 6).alias("lon"), F.round((k * b % 4_500 * 2 + 1) / 1e6 - 33.5, 6).alias("lat"))
        return checkpoint(geo.project_utm(at, "lon", "lat").withColumn("id", k.cast("string")).drop("lon", "lat"))

    k = F.col("node")
    corners = fx.grid_nodes(spark, sf_dir).select("node", F.round(k % 50 * 0.001 - 70.7, 6).alias("lon"), F.round(F.floor(k / 50) * 0.0009 - 33.5, 6).alias("lat"))
    corners = checkpoint(geo.project_utm(corners, "lon", "lat").select(k.alias("nodo_id"), "x", "y"))
    end = lambda c: corners.select(F.col("nodo_id").alias(c), F.struct("x", "y").alias(f"_{c}"))
    segments = fx.grid_road(spark, sf_dir).withColumnRenamed("calle", "calle_id").join(dealt(end("u")), "u").join(dealt(end("v")), "v")
    s = F.col("segmento_id")
    segments = segments.withColumns({"line": F.array("_u", "_v"), "permite_auto": s % 7 != 0, "permite_bici": s % 3 >= 0, "permite_peaton": s % 5 != 0, "ciclovia": s % 2 == 0}).drop("_u", "_v")
    segments = checkpoint(segments)
    streets = segments.groupBy("calle_id").agg(F.first("calle_id").alias("nombre"), F.sum("largo_m").alias("largo_m"), F.count("*").alias("segmentos"))
    key = F.col("s_suppkey")
    places = placed("supplier", "s_suppkey", 4211, 9173).select(F.col("id").alias("osm_id"), "x", "y", F.when(key % 4 == 0, F.concat(F.lit("h"), key % 7)).alias("addr:street"))
    reports = placed("customer", "c_custkey", 6151, 7919).select(F.col("id").alias("reporte_id"), "x", "y")
    venues = placed("supplier", "s_suppkey", 3331, 7177).select(F.col("id").alias("venue_id"), "x", "y")
    point = lambda x, y: F.struct((342_000.0 + 600 * (F.col("id") + x)).alias("x"), F.lit(6_292_000.0 + 600 * y).alias("y"))
    ring = F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 1), point(0, 0))
    zones = spark.range(6).select(F.col("id").cast("string").alias("zona_id"), F.array(ring).alias("rings"))
    return assemble.build(corners, segments, streets, places, reports, venues, zones, utm=19)


@registered(f"""
    WITH RECURSIVE {_CITY},
    member AS (SELECT u AS node, calle FROM road UNION SELECT v, calle FROM road)
    SELECT 'nodo' AS clase, label AS etiqueta, count(*) AS cantidad FROM spot GROUP BY label
    UNION ALL SELECT 'nodo', 'Calle', count(DISTINCT calle) FROM road UNION ALL SELECT 'nodo', 'ZonaCensal', 6
    UNION ALL SELECT 'arista', 'CONECTA_AUTO', CAST(sum(CASE sentido WHEN 'ambos' THEN 2 ELSE 1 END) AS BIGINT) FROM road WHERE segmento_id % 7 <> 0
    UNION ALL SELECT 'arista', 'CONECTA_BICI', count(*) FROM road UNION ALL SELECT 'arista', 'CONECTA_PEATON', count(*) FROM road WHERE segmento_id % 5 <> 0
    UNION ALL SELECT 'arista', 'CRUZA_CON', count(*) FROM (SELECT DISTINCT a.calle, b.calle FROM member a JOIN member b ON a.node = b.node AND a.calle < b.calle)
    UNION ALL SELECT 'arista', 'EN_CALLE', (SELECT count(*) FROM member) + (SELECT count(*) FROM on_street)
    UNION ALL SELECT 'arista', 'EN_ESQUINA', count(*) FROM at_corner UNION ALL SELECT 'arista', 'EN_ZONA', count(*) FROM in_zone
    UNION ALL SELECT 'arista', 'CERCA_DE', count(*) FROM place r JOIN place l ON r.label = 'Reclamo' AND l.label = 'Lugar' AND sqrt(pow(r.x - l.x, 2) + pow(r.y - l.y, 2)) <= 50
""")
def city_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: every label's nodes and edges."""
    return _city(spark, sf_dir).counts().select("clase", "etiqueta", "cantidad")


@registered(f"""
    WITH RECURSIVE {_CITY}
    SELECT s.label, s.id, s.lon, s.lat, o.calle, o.origen, e.esquina, z.zona
    FROM spot s LEFT JOIN on_street o USING (label, id) LEFT JOIN at_corner e USING (label, id) LEFT JOIN in_zone z USING (label, id)
""")
def city_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: every corner and point in degrees, with its street, corner and zone."""
    graph, out = _city(spark, sf_dir), None
    for label in ("Interseccion", "Lugar", "Reclamo", "Venue"):
        rows = graph.nodes[label].rows.select(F.lit(label).alias("label"), F.col("id").cast("string").alias("id"), "lon", "lat")
        for edge, name in (("EN_CALLE", "calle"), ("EN_ESQUINA", "esquina"), ("EN_ZONA", "zona")):
            told = graph.edges[f"{edge}:{label}"].rows if label != "Interseccion" else None
            kind = "string" if name == "calle" else "long"
            if told is None:
                rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in ((name, kind), *([("origen", "string")] if name == "calle" else []))})
            else:
                rows = rows.join(told.select(F.col("src").alias("id"), F.col("dst").cast(kind).alias(name), *(["origen"] if name == "calle" else [])), "id", "left")
        out = rows if out is None else out.unionByName(rows)
    return out
