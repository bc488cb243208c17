"""The whole property graph of a city from its layers: streets, corners, places, reports, venues and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import geo
from meshwright.functions.text import place_category
from meshwright.graph import PropertyGraph
from meshwright.operators import areas, network, paths, spatial
from meshwright.plans.materialise import checkpoint, dealt

# Names of properties in the graph.
SEGMENT_PROPERTIES = {"highway": "tipo", "name": "calle", "surface": "superficie", "maxspeed": "velocidad_max", "lanes": "pistas", "lit": "iluminacion"}
PLACE_PROPERTIES = {"name": "nombre", "amenity": "amenity", "shop": "shop", "leisure": "leisure", "tourism": "tourism", "office": "office", "healthcare": "healthcare", "cuisine": "cocina", "brand": "marca", "operator": "operador", "opening_hours": "horario", "addr:street": "direccion_calle", "addr:housenumber": "direccion_numero"}
REPORT_PROPERTIES = {"reporte_id": "reporte_id", "categoria": "categoria", "grupo": "grupo", "fecha": "fecha", "hora": "hora", "dia_semana": "dia_semana", "description": "descripcion", "likes": "likes", "comments": "comentarios"}
VENUE_PROPERTIES = {"venue_id": "venue_id", "category": "categoria", "checkins": "checkins"}


def _properties(df: DataFrame, names: dict[str, str]) -> list[Column]:
    """The columns that are there, renamed; empty texts and numbers that aren't finite become null."""
    out = []
    for c, name in names.items():
        if c in df.columns:
            kind, col = df.schema[c].dataType.typeName(), F.col(f"`{c}`")
            col = F.nullif(col, F.lit("")) if kind == "string" else F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col) if kind in ("double", "float") else col
            out.append(col.alias(name))
    return out


def mode_edges(segments: DataFrame, mode: str) -> DataFrame:
    """Edges of one mode: arcs by direction of travel if the mode heeds it, else one undirected edge for each segment."""
    used = segments.filter(F.col(f"permite_{mode}"))
    used = network.directed_edges(used) if network.MODES[mode].directed else used
    extra = [F.col("ciclovia")] if mode == "bici" and "ciclovia" in used.columns else []
    street = [F.col("calle_id")] if "calle_id" in used.columns else []
    return used.select(F.col("u").alias("src"), F.col("v").alias("dst"), *_properties(used, SEGMENT_PROPERTIES), F.bround("largo_m", 1).alias("largo_m"), F.lit(mode).alias("modo"), *extra, *street)


def _straight(segments: DataFrame) -> DataFrame:
    """Segments as straight pieces: segmento_id, calle_id, ax, ay, bx, by."""
    n = F.size("line") - 1
    piece = F.explode(F.arrays_zip(F.slice("line", F.lit(1), n).alias("a"), F.slice("line", F.lit(2), n).alias("b")))
    return segments.select("segmento_id", "calle_id", piece.alias("s")).select("segmento_id", "calle_id", *(F.col(f"s.{e}.{k}").alias(f"{e}{k}") for e in "ab" for k in "xy"))


def build(nodes: DataFrame, segments: DataFrame, streets: DataFrame, places: DataFrame, reports: DataFrame, venues: DataFrame | None = None, zones: DataFrame | None = None, street_m: float = 40.0, near_m: float = 50.0, utm: int | None = None, south: bool = True) -> PropertyGraph:
    """Node and edge tables of every label.

    nodes(nodo_id, x, y); segments(segmento_id, u, v, largo_m, line, sentido, permite_*, calle_id, tags); streets(calle_id, nombre, largo_m, ...);
    places, reports and venues have an id (osm_id, reporte_id, venue_id) and x, y; zones(zona_id, rings, ...). A point goes to its street (a
    place's declared street first), to the nearest corner of the largest network on foot, and to its zone; a report also to places near it.
    With a zone number `utm`, corners and points have lon and lat too, to six places.
    """

    def located(rows: DataFrame) -> DataFrame:
        if utm is None:
            return rows
        return geo.unproject_utm(rows, "x", "y", utm, south).withColumns({c: F.round(c, 6) for c in ("lon", "lat")})

    straight = checkpoint(_straight(segments.filter(F.col("calle_id").isNotNull())))
    degree = network.degrees(nodes.select(F.col("nodo_id").alias("node")), segments)
    corners = nodes.join(dealt(degree.withColumnRenamed("node", "nodo_id")), "nodo_id").select(F.col("nodo_id").alias("id"), "x", "y", "grado")
    on_foot = segments.filter("permite_peaton")
    walkable = checkpoint(corners.select("id", "x", "y").join(paths.giant_nodes(on_foot, "u", "v").withColumnRenamed("node", "id"), "id", "left_semi"))
    named = [F.bround("largo_m", 1).alias("largo_m") if c == "largo_m" else F.col(c) for c in streets.columns]
    tables = {"Calle": streets.select(F.col("calle_id").alias("id"), *named), "Interseccion": located(corners)}
    edges: dict[str, tuple] = {
        mode.label: (mode_edges(segments, name), "Interseccion", "Interseccion", mode.directed) for name, mode in network.MODES.items()
    }
    members = network.street_junctions(segments)
    edges["CRUZA_CON"] = (network.crossings(members).withColumnsRenamed({"calle_a": "src", "calle_b": "dst"}), "Calle", "Calle", False)
    edges["EN_CALLE:Interseccion"] = (members.withColumnsRenamed({"nodo_id": "src", "calle_id": "dst"}), "Interseccion", "Calle")

    tags = {c: F.col(f"`{c}`") for c in ("amenity", "shop", "leisure", "tourism", "healthcare", "office") if c in places.columns}
    kind = place_category(tags)
    title = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("("), kind, F.lit(")"))) if "name" in places.columns else F.concat(F.lit("("), kind, F.lit(")"))
    tables["Lugar"] = located(places.select(F.col("osm_id").alias("id"), *_properties(places, PLACE_PROPERTIES), "x", "y", kind.alias("categoria"), title.alias("etiqueta")))
    tables["Reclamo"] = located(reports.select(F.col("reporte_id").alias("id"), *_properties(reports, REPORT_PROPERTIES), "x", "y"))
    points = {"Lugar": (places.withColumnRenamed("osm_id", "id"), "addr:street" if "addr:street" in places.columns else None), "Reclamo": (reports.withColumnRenamed("reporte_id", "id"), None)}
    if venues is not None:
        tables["Venue"] = located(venues.select(F.col("venue_id").alias("id"), *_properties(venues, VENUE_PROPERTIES), "x", "y"))
        points["Venue"] = (venues.withColumnRenamed("venue_id", "id"), None)
    if zones is not None:
        tables["ZonaCensal"] = zones.select(F.col("zona_id").alias("id"), *(F.col(c).alias(c.lower()) for c in zones.columns if c != "rings"))
        box = zones.select(F.explode(F.flatten("rings")).alias("p")).agg(F.max("p.x") - F.min("p.x"), F.max("p.y") - F.min("p.y")).first()
        cell = max(1.0, max(box[0] or 0.0, box[1] or 0.0) / 64)
    metres = lambda c: F.bround(c, 1).alias("distancia_m")
    for label, (rows, declared) in points.items():
        rows = rows.select("id", "x", "y", *([F.col(f"`{declared}`").alias("_declared")] if declared else []))
        street = network.assign_street(rows, straight, streets, street_m, "_declared" if declared else None).filter(F.col("calle_id").isNotNull())
        edges[f"EN_CALLE:{label}"] = (street.select(F.col("id").alias("src"), F.col("calle_id").alias("dst"), "origen", metres("distancia_m")), label, "Calle")
        corner = spatial.nearest_join(rows, walkable, 200.0)
        edges[f"EN_ESQUINA:{label}"] = (corner.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), metres("distance")), label, "Interseccion")
        if zones is not None:
            zone = areas.within_join(rows, zones.select(F.col("zona_id").alias("polygon_id"), "rings"), cell).filter(F.col("polygon_id").isNotNull())
            edges[f"EN_ZONA:{label}"] = (zone.select(F.col("id").alias("src"), F.col("polygon_id").alias("dst")), label, "ZonaCensal")
    near = spatial.radius_join(points["Reclamo"][0], points["Lugar"][0], near_m)
    edges["CERCA_DE"] = (near.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), metres("distance")), "Reclamo", "Lugar")
    return PropertyGraph.build(tables, edges)
