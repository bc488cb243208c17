"""A property graph, a road grid and points that are made from the benchmark tables by arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.graph import PropertyGraph
from meshwright.plans.materialise import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers and suppliers in nations, nations in regions, orders of customers and their parts."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}

    def renamed(name: str, key: str) -> DataFrame:
        prefix = key[: key.index("_") + 1]
        return t[name].select(F.col(key).alias("id"), *(F.col(c).alias(c.removeprefix(prefix)) for c in t[name].columns if c != key))

    keys = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey")}

    def edge(name: str, src: str, dst: str, **properties: str) -> DataFrame:
        return t[name].select(F.col(src).alias("src"), F.col(dst).alias("dst"), *(F.col(c).alias(k) for k, c in properties.items()))

    return PropertyGraph.build(
        {label: renamed(*k) for label, k in keys.items()},
        {
            "CUSTOMER_IN": (edge("customer", "c_custkey", "c_nationkey"), "Customer", "Nation"),
            "SUPPLIER_IN": (edge("supplier", "s_suppkey", "s_nationkey"), "Supplier", "Nation"),
            "IN_REGION": (edge("nation", "n_nationkey", "n_regionkey"), "Nation", "Region"),
            "PLACED": (edge("orders", "o_custkey", "o_orderkey"), "Customer", "Orders"),
            "CONTAINS": (edge("lineitem", "l_orderkey", "l_partkey", quantity="l_quantity"), "Orders", "Part"),
            # nearly all pairs differ: they are dealt out by part once, for what follows too
            "SUPPLIES": (edge("lineitem", "l_suppkey", "l_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dst").distinct(), "Supplier", "Part"),
        },
    )


def grid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One junction for each part, in rows of 50, 100 m apart: node, x, y."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("node"), (k % 50 * 100).cast("double").alias("x"), (F.floor(k / 50) * 100).cast("double").alias("y"))


def grid_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between neighbours of the grid, with gaps: segmento_id, u, v, largo_m, calle, sentido."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    k = F.col("k")
    across = part.filter((k % 50 < 49) & ~(k * 7 % 11).isin(3, 5)).select((k * 2).alias("segmento_id"), k.alias("u"), (k + 1).alias("v"), (F.lit(50.0) + F.col("p_size")).alias("largo_m"), F.concat(F.lit("H"), F.floor(k / 50).cast("string")).alias("calle"), F.when(k % 3 == 1, "directo").when(k % 3 == 2, "inverso").otherwise("ambos").alias("sentido"))
    down = part.filter(~((k * k + k) % 13).isin(2, 6, 7)).select((k * 2 + 1).alias("segmento_id"), k.alias("u"), (k + 50).alias("v"), (F.lit(60.0) + F.col("p_size")).alias("largo_m"), F.concat(F.lit("V"), (k % 50).cast("string")).alias("calle"), F.lit("ambos").alias("sentido"))
    ends = part.select(k.alias("v"))
    return across.unionByName(down).join(dealt(ends), "v").select("segmento_id", "u", "v", "largo_m", "calle", "sentido")


def road_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The grid as a property graph: undirected ROAD and directed ONE_WAY edges between corners."""
    road = grid_road(spark, sf_dir)
    two = road.filter("sentido = 'ambos'").select(F.col("u").alias("src"), F.col("v").alias("dst"), "largo_m", "calle")
    one = road.filter("sentido != 'ambos'").select(F.when(F.col("sentido") == "directo", F.col("u")).otherwise(F.col("v")).alias("src"), F.when(F.col("sentido") == "directo", F.col("v")).otherwise(F.col("u")).alias("dst"), "largo_m", "calle")
    corners = grid_nodes(spark, sf_dir).withColumnRenamed("node", "id")
    return PropertyGraph.build({"Corner": corners}, {"ROAD": (two, "Corner", "Corner", False), "ONE_WAY": (one, "Corner", "Corner")})


def street_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The grid's streets and the corners that lie on them."""
    road = grid_road(spark, sf_dir)
    on = road.select(F.explode(F.array("u", "v")).alias("src"), F.col("calle").alias("dst")).distinct()
    streets = road.select(F.col("calle").alias("id"), F.substring("calle", 1, 1).alias("kind")).distinct()
    corners = grid_nodes(spark, sf_dir).withColumnRenamed("node", "id")
    return PropertyGraph.build({"Corner": corners, "Street": streets}, {"ON": (on, "Corner", "Street")})


def mixed_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The road graph, and customers and suppliers in nations by one edge label with two kinds of ends."""
    road, t = road_graph(spark, sf_dir), {n: table(spark, sf_dir, n) for n in ("customer", "supplier", "nation")}
    no_text = F.nullif(F.lit("x"), F.lit("x"))
    nodes = {
        "Corner": road.nodes["Corner"].rows.select("id"),
        "Nation": t["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "Customer": t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")),
        "Supplier": t["supplier"].select(F.col("s_suppkey").alias("id"), no_text.alias("segment")),
    }
    of = lambda name, key, role: t[name].select(F.col(f"{key[0]}_{key[1]}").alias("src"), F.col(f"{key[0]}_nationkey").alias("dst"), *role)
    kinds = {
        "IS_IN:Customer": (of("customer", ("c", "custkey"), []), "Customer", "Nation"),
        "IS_IN:Supplier": (of("supplier", ("s", "suppkey"), [F.lit("supplies").alias("role")]), "Supplier", "Nation"),
    }
    roads = {k: (e.rows.select("src", "dst", "calle"), e.source, e.target, e.directed) for k, e in road.edges.items()}
    return PropertyGraph.build(nodes, kinds | roads)


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Customers or suppliers as points over the grid: id, x, y."""
    key, a, b = {"customer": ("c_custkey", 6151, 7919), "supplier": ("s_suppkey", 4211, 9173)}[name]
    rows = table(spark, sf_dir, "part").agg(F.greatest(F.floor(F.count("*") / 50) - 1, F.lit(1)).alias("h"))
    k = F.col(key)
    return table(spark, sf_dir, name).crossJoin(F.broadcast(rows)).select(k.alias("id"), (k * a % 490000 / 100.0).alias("x"), (k * b % (F.col("h") * 10000) / 100.0).alias("y"))


def tagged_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ways with access tags: way_id and tags."""
    k = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("way_id"),
        pick(("residential", "motorway", "footway", "cycleway", "service", "path", "primary", "steps", None, "Track "), k).alias("highway"),
        pick((None, "private", "no", "yes", ""), k * 3 + F.col("p_size")).alias("access"),
        pick((None, None, "yes", "no", "\tDesignated\u00a0"), k + F.col("p_size")).alias("bicycle"),
        pick((None, "no", "yes"), F.col("p_size")).alias("foot"),
        pick((None, None, "yes", "no"), k * 5 + F.col("p_size") * 3).alias("motor_vehicle"),
        pick((None, "driveway", None, "parking_aisle", None, None, None), k + 2 * F.col("p_size")).alias("service"),
        pick((None, "yes", "-1", "no", "reverse", "1"), k * 7 + F.col("p_size")).alias("oneway"),
        pick((None, "lane", "no", "separate", ""), k * 11 + F.col("p_size")).alias("cycleway"),
    )
