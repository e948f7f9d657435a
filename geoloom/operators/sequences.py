"""Vertex sequences as rows: segments, arc lengths, splits, intervals, stations.

A line or ring is a set of rows (id, seq, x, y) in whole units. Every operator partitions by id, so
one line is one window partition; lines are short, and none is gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import clip_interval


def by_seq(id_col: str = "id", seq_col: str = "seq"):
    return Window.partitionBy(id_col).orderBy(seq_col)


def segments(points: DataFrame, closed: bool = False, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """(id, seq, x, y, x2, y2): each vertex with the next; rings get their closing edge."""
    order = by_seq(id_col, seq_col)
    following = {c: F.lead(c).over(order) for c in ("x", "y")}
    if closed:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        following = {c: F.coalesce(v, F.first(c).over(whole)) for c, v in following.items()}
    return points.select(id_col, seq_col, "x", "y", following["x"].alias("x2"), following["y"].alias("y2")).where("x2 IS NOT NULL")


def segment_length() -> Column:
    dx, dy = (F.col("x2") - F.col("x")).cast("double"), (F.col("y2") - F.col("y")).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def arc_length(segs: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """Segments with their length, the length before them, and the start's fraction of the whole."""
    order = by_seq(id_col, seq_col)
    with_len = segs.withColumn("len", segment_length())
    before = F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("len").over(Window.partitionBy(id_col))
    return with_len.withColumns({"at": before, "total": total}).withColumn("fraction", F.when(F.col("total") > 0, F.col("at") / F.col("total")).otherwise(0.0))


def split_at(points: DataFrame, cuts: DataFrame, id_col: str = "id", seq_col: str = "seq", key_col: str = "ref") -> DataFrame:
    """Lines cut at interior vertices whose key is in ``cuts``: (id, piece, seq, ...); a cut vertex belongs to both pieces."""
    order = by_seq(id_col, seq_col)
    keys = cuts.select(F.col(key_col).alias("_cut")).distinct()
    marked = points.join(keys, F.col(key_col) == F.col("_cut"), "left")
    inner = F.lag(F.lit(1)).over(order).isNotNull() & F.lead(F.lit(1)).over(order).isNotNull()
    marked = marked.withColumn("_is", (F.col("_cut").isNotNull() & inner).cast("int"))
    piece = F.coalesce(F.sum("_is").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # both rows of a cut vertex come from one pass over the sorted lines
    own = marked.withColumn("piece", piece)
    both = F.when(F.col("_is") == 1, F.array(F.col("piece"), F.col("piece") + 1)).otherwise(F.array("piece"))
    return own.withColumn("piece", F.explode(both)).drop("_cut", "_is")


def drop_repeats(points: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """Without vertices equal to the one before."""
    order = by_seq(id_col, seq_col)
    same = F.coalesce((F.lag("x").over(order) == F.col("x")) & (F.lag("y").over(order) == F.col("y")), F.lit(False))
    return points.withColumn("_same", same).where("NOT _same").drop("_same")


def partition_faults(rules: DataFrame, id_col: str = "id", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(id, fault): ids whose [lo, hi) rules do not cover 0 to 1 without gap or overlap."""
    order = Window.partitionBy(id_col).orderBy(lo, hi)
    joined = rules.withColumn("_gap", F.col(lo) - F.coalesce(F.lag(hi).over(order), F.lit(0.0)))
    found = joined.groupBy(id_col).agg(F.max("_gap").alias("g"), F.min("_gap").alias("o"), F.max(hi).alias("end"))
    fault = F.when(F.col("g") > 0, "gap").when(F.col("o") < 0, "overlap").when(F.col("end") != 1.0, "end")
    return found.select(id_col, fault.alias("fault")).where("fault IS NOT NULL")


def merge_intervals(df: DataFrame, id_col: str = "id", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Touching or overlapping intervals of an id joined: (id, lo, hi, parts)."""
    order = Window.partitionBy(id_col).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = df.withColumn("_new", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0))
    islands = fresh.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(id_col, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("parts")).drop("_island")


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def chunk(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """Rows of an ordered group in blocks of at most n, numbered from 0 in column ``block``."""
    return df.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / n))


def capped(df: DataFrame, keys: list[str], cap: int, *order: Column) -> DataFrame:
    """At most ``cap`` rows of each key, first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def stations(lines: DataFrame, spacing: float, phase: float = 0.0, clear: float = 0.0, id_col: str = "id") -> DataFrame:
    """Points every ``spacing`` along lines given as arc_length() rows: (id, k, at, x, y), clear of both ends."""
    spans = lines.withColumns({"first": F.greatest(F.lit(0.0), F.ceil((F.greatest(F.col("at"), F.lit(clear)) - phase) / spacing)), "stop": F.least(F.col("at") + F.col("len"), F.col("total") - clear)})
    last = F.ceil((F.col("stop") - phase) / spacing) - 1
    last = F.when((F.col("stop") == F.col("total")) & ((F.floor((F.col("stop") - phase) / spacing) * spacing + phase) == F.col("stop")), last + 1).otherwise(last)
    k = spans.withColumn("last", last).where((F.col("len") > 0) & (F.col("first") <= F.col("last"))).select("*", F.explode(F.sequence(F.col("first").cast("bigint"), F.col("last").cast("bigint"))).alias("k"))
    t = (F.col("k") * spacing + phase - F.col("at")) / F.col("len")
    return k.select(id_col, "k", (F.col("k") * spacing + phase).alias("at"), (F.col("x") + (F.col("x2") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("y2") - F.col("y")) * t).alias("y"))


def triples(df: DataFrame, id_col: str, seq_col: str, value_col: str) -> DataFrame:
    """Places where one value stands three times in a row."""
    order = by_seq(id_col, seq_col)
    both = df.withColumns({"_b": F.lead(value_col, 1).over(order), "_c": F.lead(value_col, 2).over(order)})
    return both.where((F.col(value_col) == F.col("_b")) & (F.col(value_col) == F.col("_c"))).drop("_b", "_c")


def turns(segs: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """(id, seq, dot, cross): each segment against the one before; dot < 0 is a sharp turn."""
    order = by_seq(id_col, seq_col)
    d = segs.withColumns({"dx": F.col("x2") - F.col("x"), "dy": F.col("y2") - F.col("y")})
    p = d.withColumns({"px": F.lag("dx").over(order), "py": F.lag("dy").over(order)}).where("px IS NOT NULL")
    return p.select(id_col, seq_col, (F.col("dx") * F.col("px") + F.col("dy") * F.col("py")).alias("dot"), (F.col("px") * F.col("dy") - F.col("py") * F.col("dx")).alias("cross"))


def corridor_faults(segs: DataFrame, id_col: str, seq_col: str, start: str, end: str) -> DataFrame:
    """Rows of a corridor that do not start where the one before ended, or that do not advance."""
    order = by_seq(id_col, seq_col)
    before = segs.withColumn("_prev", F.lag(end).over(order))
    fault = F.when(F.col("_prev") != F.col(start), "gap").when(F.col(end) <= F.col(start), "backwards")
    return before.withColumn("fault", fault).where("fault IS NOT NULL").drop("_prev")


def value_at(steps: DataFrame, asks: DataFrame, id_col: str = "id", at: str = "at") -> DataFrame:
    """As-of lookup along a line: each ask (id, t) with the last step's value at or before t.

    Steps and asks are merged in one sorted window by id, so no range join is formed.
    """
    both = steps.select(id_col, F.col(at).alias("t"), F.lit(0).alias("_kind"), "value").unionByName(asks.select(id_col, "t", F.lit(1).alias("_kind"), F.lit(None).cast(steps.schema["value"].dataType).alias("value")))
    order = Window.partitionBy(id_col).orderBy("t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(order)).where("_kind = 1").drop("_kind")


def crop_lines(points: DataFrame, window: tuple[int, int, int, int], least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Lines (id, seq, x, y, z) cut at a window (west, south, east, north): (id, piece, seq, x, y, z, cut), and (id, short), how many pieces below ``least`` went.

    Lines inside stay whole; where a line leaves, a piece ends with a ``cut`` vertex whose height is
    interpolated, and the next begins where it comes back. A line that only touches the window gives nothing.
    """
    order = by_seq()
    ahead = {f"{c}2": F.lead(c).over(order) for c in ("x", "y", "z")}
    t0, t1 = clip_interval(*[F.col(c) for c in ("x", "y", "x2", "y2")], *[F.lit(v) for v in window])
    segs = points.select("id", "seq", "x", "y", "z", *[v.alias(k) for k, v in ahead.items()]).where("x2 IS NOT NULL").withColumns({"t0": t0, "t1": t1})
    goes_on = F.coalesce((F.lag("t1").over(order) == 1) & (F.col("t0") == 0), F.lit(False))
    # a segment without length belongs to the piece that it stands in
    segs = segs.withColumn("new", ~goes_on).where("t0 < t1").withColumn("piece", F.sum(F.col("new").cast("int")).over(order) - 1)
    inside = Window.partitionBy("id", "piece").orderBy("seq")
    size = F.sum(segment_length() * (F.col("t1") - F.col("t0"))).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # a segment that opens its piece gives two vertices, any other one, so places are known before vertices are made
    opened = F.coalesce(F.sum(F.col("new").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segs = segs.withColumns({"size": size, "_place": F.row_number().over(inside) + opened})
    short = segs.where((F.col("size") < least) & F.col("new")).groupBy("id").agg(F.count(F.lit(1)).alias("short"))
    at = lambda t, cut: F.struct(*[(F.col(c) + F.col(t) * (F.col(f"{c}2") - F.col(c))).alias(c) for c in ("x", "y", "z")], cut.alias("cut"))
    ends = F.when(F.col("new"), F.array(at("t0", F.col("t0") > 0), at("t1", F.col("t1") < 1))).otherwise(F.array(at("t1", F.col("t1") < 1)))
    each = segs.where(F.col("size") >= least).select("id", "piece", "_place", F.posexplode(ends).alias("_at", "v"))
    return each.select("id", "piece", (F.col("_place") + F.col("_at")).cast("bigint").alias("seq"), "v.x", "v.y", "v.z", "v.cut"), short
