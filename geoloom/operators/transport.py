"""Segments with linear rules as a road graph: every layer of rules, the vertices and the connectors laid over each other in one sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.graph import written
from geoloom.operators.sequences import partition_faults


def fractions(vertices: DataFrame) -> DataFrame:
    """Vertices (id, seq, x, y) with ``at``, the share of the line's length before them: 0 first, exactly 1 last, null without length."""
    order = Window.partitionBy("id").orderBy("seq")
    dx, dy = (F.col(c) - F.lag(c).over(order) for c in "xy")
    step = vertices.withColumn("_len", F.coalesce(F.sqrt((dx * dx + dy * dy).cast("double")), F.lit(0.0)))
    run = step.withColumns({"_run": F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("seq").over(order), "_all": F.sum("_len").over(Window.partitionBy("id"))})
    at = F.when(F.col("_all") > 0, F.when(F.col("_next").isNull(), 1.0).otherwise(F.col("_run") / F.col("_all")))
    return run.select(*vertices.columns, at.alias("at"))


def graph_faults(vertices: DataFrame, refs: DataFrame, connectors: DataFrame, rules: DataFrame, tolerance: float) -> DataFrame:
    """(id, fault): why segments can't be taken whole; nothing is clipped or repaired.

    vertices have fractions; refs are (id, connector, at), connectors (connector, x, y), rules (id, layer, lo, hi, value). Faults: ``short`` (no length), ``ends`` (no
    connector at 0 or at 1), ``ambiguous`` (a connector twice, or two at one place), ``unknown`` and ``repeated`` connectors, ``off the line`` (farther than the
    tolerance from where the reference puts it), and for each layer of rules `` gap``, `` overlap`` or `` end`` after its name.
    """
    c = connectors.groupBy(F.col("connector").alias("_c")).agg(F.min("x").alias("cx"), F.min("y").alias("cy"), F.count(F.lit(1)).alias("n"))
    known = refs.join(c, F.col("connector") == F.col("_c"), "left").withColumn("twice", F.col("connector").isNull() | (F.count(F.lit(1)).over(Window.partitionBy("connector", "id")) > 1))
    # references and vertices are dealt by segment once: each reference and the vertices around it are found by one sort, and all else is told from the same rows
    none = {n: F.lit(None).cast(t).alias(n) for n, t in (("cx", "double"), ("cy", "double"), ("n", "long"), ("twice", "boolean"), *[(c, vertices.schema[c].dataType) for c in "xy"])}
    marks = vertices.select("id", "at", "x", "y", none["cx"], none["cy"], none["n"], none["twice"], F.lit(0).alias("kind"))
    asks = known.select("id", "at", none["x"], none["y"], F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), F.coalesce("n", F.lit(0)).alias("n"), "twice", F.lit(1).alias("kind"))
    order = Window.partitionBy("id").orderBy("at", "kind")
    spot, asked = F.when((F.col("kind") == 0) & F.col("at").isNotNull(), F.struct("at", "x", "y")), F.col("kind") == 1
    same = F.col("at").isNull() | ((F.lag("kind").over(order) == 1) & (F.lag("at").over(order) == F.col("at")))
    around = marks.unionByName(asks).withColumns({"p": F.last(spot, True).over(order), "q": F.first(spot, True).over(order.rowsBetween(1, Window.unboundedFollowing)), "same": same})
    t = F.coalesce((F.col("at") - F.col("p.at")) / F.nullif(F.col("q.at") - F.col("p.at"), F.lit(0.0)), F.lit(0.0))
    gap = [F.col(f"p.{c}") + t * F.coalesce(F.col(f"q.{c}") - F.col(f"p.{c}"), F.lit(0)) - F.col(f"c{c}") for c in "xy"]
    some = lambda what: F.coalesce(F.max(what), F.lit(False))
    own = around.groupBy("id").agg(
        some(~asked).alias("line"), F.max(F.when(~asked, F.col("at"))).alias("end"), F.min(F.when(asked, F.col("at"))).alias("lo"), F.max(F.when(asked, F.col("at"))).alias("hi"), some(asked & (F.col("same") | F.col("twice"))).alias("twice"),
        some(F.col("n") == 0).alias("unknown"), some(F.col("n") > 1).alias("repeated"), some((F.col("n") == 1) & (gap[0] * gap[0] + gap[1] * gap[1] > tolerance * tolerance)).alias("off"),
    )
    why = {"short": F.expr("line AND end IS NULL"), "ends": F.expr("line AND (lo IS NULL OR lo <> 0 OR hi <> 1)"), "ambiguous": F.expr("line AND twice"), "unknown": F.col("unknown"), "repeated": F.col("repeated"), "off the line": F.col("off")}
    found = own.select("id", F.explode(F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in why.items()]))).alias("fault"))
    uneven = partition_faults(rules.select(F.struct("id", "layer").alias("id"), "lo", "hi")).select("id.id", F.concat_ws(" ", "id.layer", "fault").alias("fault"))
    return found.union(uneven)


def transport_graph(vertices: DataFrame, refs: DataFrame, connectors: DataFrame, rules: DataFrame, layers: list[str], tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pieces (id, road, n, lo, hi, x, y, x2, y2, a column a layer), roads (id, road, start, end, pieces), faults (id, fault) and unused (connector).

    A segment without a fault is cut into roads at its connectors, numbered from 0, and a road into pieces at its vertices and wherever a rule of any layer begins; a piece has one
    value of each layer, null where a segment has no rule of it. All of a segment's marks go by in one sorted sweep, so the layers are not joined with each other.
    A connector's own coordinates replace those of the line. A null id, reference or rule takes no part. Vertices may bring their fractions ``at`` along.
    """
    at = vertices.where("id IS NOT NULL")
    at = at if "at" in vertices.columns else written(fractions(at))
    refs, rules = refs.where("id IS NOT NULL AND connector IS NOT NULL"), rules.where("id IS NOT NULL AND layer IS NOT NULL")
    faults = written(graph_faults(at, refs, connectors, rules, tolerance))
    bad = faults.select(F.col("id").alias("_bad")).distinct()
    named = refs.join(connectors.select(F.col("connector").alias("_c"), "x", "y"), F.col("connector") == F.col("_c"))
    place = lambda f: F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias(f)
    none = {f: F.lit(None).alias(f) for f in ("vertex", "tie", "connector", "layer", "value")}
    put = lambda df, key, **given: df.select("id", F.col(key).alias("at"), *[given.get(f, c) for f, c in none.items()])
    marks = put(at.where("at IS NOT NULL"), "at", vertex=place("vertex")).unionByName(put(named, "at", tie=place("tie"), connector=F.col("connector"))).unionByName(put(rules.where(F.col("layer").isin(layers)), "lo", layer=F.col("layer"), value=F.col("value")))
    sound = marks.join(bad, F.col("id") == F.col("_bad"), "left_anti")
    values = [F.max(F.when(F.col("layer") == n, F.struct("value"))).alias(n) for n in layers]
    breaks = sound.groupBy("id", "at").agg(F.max("vertex").alias("vertex"), F.max("tie").alias("tie"), F.max("connector").alias("connector"), *values)
    order = Window.partitionBy("id").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # vertices keep the line's shape; a connector replaces the vertex it lies on
    known = F.when(F.col("vertex").isNotNull(), F.struct("at", F.coalesce("tie", "vertex").alias("p")))
    swept = breaks.withColumns({"_p": F.last(known, True).over(so_far), "_q": F.first(known, True).over(order.rowsBetween(0, Window.unboundedFollowing)), "road": F.count("connector").over(so_far) - 1, "_last": F.last("connector", True).over(so_far), **{n: F.last(n, True).over(so_far) for n in layers}})
    t = F.coalesce((F.col("at") - F.col("_p.at")) / F.nullif(F.col("_q.at") - F.col("_p.at"), F.lit(0.0)), F.lit(0.0))
    spot = {c: F.coalesce(F.col(f"tie.{c}"), F.col(f"_p.p.{c}") + t * (F.col(f"_q.p.{c}") - F.col(f"_p.p.{c}"))) for c in "xy"}
    swept = swept.withColumns(spot)
    ahead = {"hi": F.lead("at").over(order), "x2": F.lead("x").over(order), "y2": F.lead("y").over(order)}
    # swept once: pieces, and the connectors that end roads, are read from one table
    numbered = swept.withColumns(ahead).withColumn("n", F.row_number().over(Window.partitionBy("id", "road").orderBy("at")).cast("bigint"))
    swept = written(numbered.select("id", "road", "n", F.col("at").alias("lo"), "hi", "x", "y", "x2", "y2", "connector", F.col("_last").alias("_start"), *[F.col(f"{n}.value").alias(n) for n in layers]))
    pieces = swept.where("hi IS NOT NULL").drop("connector")
    ends = swept.where("connector IS NOT NULL").select(F.col("id").alias("_i"), (F.col("road") - 1).alias("_r"), F.col("connector").alias("end"))
    count = pieces.groupBy("id", "road").agg(F.min("_start").alias("start"), F.count(F.lit(1)).alias("pieces"))
    roads = count.join(ends, (F.col("id") == F.col("_i")) & (F.col("road") == F.col("_r"))).select("id", "road", "start", "end", "pieces")
    unused = connectors.select("connector").distinct().join(refs.select(F.col("connector").alias("_used")).distinct(), F.col("connector") == F.col("_used"), "left_anti")
    return pieces.drop("_start"), roads, faults, unused
