"""Common areas of any polygons, holes included, by their edges.

A shape is rows of rings: straight polygons, the first of a row its outline, the others its holes (``ARRAY<ARRAY<vertex>>``;
bent edges are flattened first). Edges are cut at the lines of a grid of strips, so that a shape of many edges is spread over
its strips. Shapes meet where they share a tile of a strip, an equi-join. A shape is what lies right of the edges where it begins,
less what lies right of those where it ends; so the common area of two is a sum over the pairs of their edges in a strip, of what
lies right of both, which is exact as edges are straight. Only a shape of several rows, which may overlap, is first parted
into slabs in which no two of its edges cross. Every step is a join, a sum or a window over one slab; nothing is gathered into arrays.

Edge cases: rows with a null id or without rings have no area and meet nothing; rings of less than three vertices, repeated
vertices and level edges add nothing; touching shapes share no area; rows that repeat an id count as one shape under the
even-odd rule. Rings must not cross themselves, holes must lie in their outline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.operators.matching import greedy_pairs
from quillmap.plans.storage import keep


def ring_edges(shapes: DataFrame, shape_id: str, rings: str) -> DataFrame:
    """``id, ring, ax, ay, bx, by``: one row for each edge."""
    ring = shapes.where(F.col(shape_id).isNotNull()).select(F.col(shape_id).alias("id"), F.posexplode(rings).alias("ring", "r"))
    edge = ring.select("id", "ring", F.explode(G.edges(F.col("r"))).alias("e"))
    return edge.select("id", "ring", *[F.col(f"e.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"])


def ring_areas(edges: DataFrame) -> DataFrame:
    """``id, area``: outlines less holes."""
    own = edges.groupBy("id", "ring").agg((F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2).alias("a"))
    return own.groupBy("id").agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))


def strips(edges: DataFrame, size: float, *more: str) -> DataFrame:
    """``id, strip, ya, yb, xa, xb`` and the columns ``more``: edges that are not level, from their low to their high end, cut at the strips' lines."""
    up = F.col("ay") < F.col("by")
    rows = edges.where("ay <> by").select("id", *more, *[F.when(up, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("x0", "ax", "bx"), ("y0", "ay", "by"), ("x1", "bx", "ax"), ("y1", "by", "ay"))])
    rows = rows.withColumn("strip", F.explode(F.sequence(F.floor(F.col("y0") / size), F.ceil(F.col("y1") / size) - 1)))
    low, high = F.greatest("y0", F.col("strip") * size), F.least("y1", (F.col("strip") + 1) * size)

    def at(y: Column) -> Column:
        return F.when(y == F.col("y0"), F.col("x0")).when(y == F.col("y1"), F.col("x1")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0")))

    return rows.select("id", "strip", low.alias("ya"), high.alias("yb"), at(low).alias("xa"), at(high).alias("xb"), *more)


def _borders(shapes: DataFrame, shape_id: str, rings: str, size: float) -> DataFrame:
    """``id, strip, ya, yb, xa, xb, way, area``: the pieces of ``strips``, 1 where the shape begins to their right and -1 where it ends."""
    whole = shapes.where(F.col(shape_id).isNotNull())
    turned = F.transform(rings, lambda r: F.coalesce(_turned(r), F.lit(0.0)))
    rows = whole.select(F.col(shape_id).alias("id"), F.col(rings).alias("rings"), turned.alias("turned"))
    area = 2 * F.abs(F.get("turned", F.lit(0))) - F.aggregate("turned", F.lit(0.0), lambda s, t: s + F.abs(t))
    rows = rows.select("id", "turned", area.alias("area"), F.posexplode("rings").alias("ring", "r"))
    # outlines run round with the inside on their left, holes with it on their right
    turn = F.signum(F.get("turned", F.col("ring"))) * F.when(F.col("ring") == 0, 1).otherwise(-1)
    edge = rows.select("id", "area", turn.cast("int").alias("turn"), F.explode(G.edges(F.col("r"))).alias("e"))
    edge = edge.select("id", "area", "turn", *[F.col(f"e.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"]).where("turn <> 0")
    pieces = keep(strips(edge.withColumn("way", F.when(F.col("ay") < F.col("by"), -F.col("turn")).otherwise(F.col("turn"))), size, "way", "area"), "strips")
    many = keep(whole.groupBy(F.col(shape_id).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated")
    if many.limit(1).count() == 0:
        return pieces
    return keep(pieces.join(many, "id", "left_anti").unionByName(_even_odd(pieces.join(many, "id", "left_semi"))), "strips")


def _turned(ring: Column) -> Column:
    """The area of a ring, positive if it runs with its inside on the left, y up; coordinates count from its first vertex."""
    first = F.get(ring, F.lit(0))

    def cross(e: Column) -> Column:
        return (e.a.x - first.x) * (e.b.y - first.y) - (e.b.x - first.x) * (e.a.y - first.y)

    return F.aggregate(G.edges(ring), F.lit(0.0), lambda s, e: s + cross(e)) / 2


def _even_odd(pieces: DataFrame) -> DataFrame:
    """The ``pieces`` of shapes whose rows may overlap, cut where they meet and marked by the even-odd rule.

    The heights of all ends and crossings of a shape's edges in a strip part it into slabs in which no two edges cross; across
    the middle of a slab, every second edge ends what the one before began.
    """
    key = ["id", "strip"]
    own = keep(pieces.select(*key, *_PIECE, F.monotonically_increasing_id().alias("m")), "own-pieces")
    other = own.select(*key, *[F.col(c).alias("q" + c) for c in (*_PIECE, "m")])
    low, high, gap = _gaps()
    crossed = own.join(other, key).where((F.col("m") < F.col("qm")) & (low < high)).select(*key, low.alias("low"), high.alias("high"), gap(low).alias("g0"), gap(high).alias("g1")).where("g0 * g1 < 0")
    crossed = crossed.select(*key, (F.col("low") + (F.col("high") - F.col("low")) * F.col("g0") / (F.col("g0") - F.col("g1"))).alias("y"))
    heights = own.select(*key, F.explode(F.array("ya", "yb")).alias("y")).unionByName(crossed).distinct()
    slabs = heights.withColumn("top", F.lead("y").over(W.partitionBy(*key).orderBy("y"))).where("top is not null")
    cuts = slabs.join(own, key).where("ya <= y and yb >= top").select(*key, F.col("y").alias("ya"), F.col("top").alias("yb"), _at("", F.col("y")).alias("xa"), _at("", F.col("top")).alias("xb"))
    across = W.partitionBy(*key, "ya").orderBy(F.col("xa") + F.col("xb"))
    marked = keep(cuts.withColumn("way", F.when(F.row_number().over(across) % 2 == 1, 1).otherwise(-1)), "marked")
    areas = marked.groupBy("id").agg((-F.sum(F.col("way") * (F.col("yb") - F.col("ya")) * (F.col("xa") + F.col("xb")) / 2)).alias("area"))
    return marked.join(areas, "id")


_PIECE = ("ya", "yb", "xa", "xb")


def _at(p: str, y: Column) -> Column:
    """Where a piece (columns with prefix ``p``) is at ``y``."""
    ya, yb, xa, xb = (F.col(p + c) for c in _PIECE)
    return F.when(y == ya, xa).when(y == yb, xb).otherwise(xa + (xb - xa) * (y - ya) / (yb - ya))


def _gaps():
    """Low and high end of what two pieces (the other with prefix ``q``) share in height, and how far the one is right of the other."""
    return F.greatest("ya", "qya"), F.least("yb", "qyb"), lambda y: _at("", y) - _at("q", y)


def _spans(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("id", "strip").agg(F.min(F.least("xa", "xb")).alias("x0"), F.max(F.greatest("xa", "xb")).alias("x1"), F.min("ya").alias("y0"), F.max("yb").alias("y1"))


def _pairs(a: DataFrame, b: DataFrame, size: float, same: bool) -> DataFrame:
    """``a, b, strip, x0``: shapes whose boxes in a strip meet, each once, and where they begin to; their tile is the first that both touch."""

    def spans(pieces: DataFrame, name: str) -> DataFrame:
        span = _spans(pieces).select(F.col("id").alias(name), "strip", *[F.col(c).alias(name + c) for c in ("x0", "x1", "y0", "y1")])
        return span.withColumn("tile", F.explode(F.sequence(F.floor(F.col(f"{name}x0") / size), F.floor(F.col(f"{name}x1") / size))))

    met = spans(a, "a").hint("merge").join(spans(b, "b"), ["strip", "tile"])
    x0 = F.greatest("ax0", "bx0")
    meets = (F.col("ax0") < F.col("bx1")) & (F.col("bx0") < F.col("ax1")) & (F.col("ay0") < F.col("by1")) & (F.col("by0") < F.col("ay1"))
    return met.where(meets & (F.col("tile") == F.floor(x0 / size)) & ((F.col("a") < F.col("b")) if same else F.lit(True))).select("a", "b", "strip", x0.alias("x0"))


def shared_areas(a: DataFrame, b: DataFrame | None, size: float, shape_id: str = "id", rings: str = "rings", same_id: bool = False) -> DataFrame:
    """``a, b, area_a, area_b, shared, iou`` of all pairs of shapes with common area; without ``b``, pairs ``a < b`` of one table.

    With ``same_id`` shapes of ``a`` meet only those of ``b`` with their own id, in whatever place the others lie.
    ``size`` is the height of strips and the width of tiles: about the height of a usual shape. An area that the rounding of
    its sum can't tell from 0 counts as none.
    """
    own = _borders(a, shape_id, rings, size)
    other = own if b is None else _borders(b, shape_id, rings, size)
    if same_id:
        pairs = _spans(own).select("id", "strip", "x0").join(other.select("id", "strip").distinct(), ["id", "strip"]).select(F.col("id").alias("a"), F.col("id").alias("b"), "strip", "x0")
    else:
        pairs = _pairs(own, other, size, b is None)
    one = pairs.join(own.select(F.col("id").alias("a"), "strip", *_PIECE, "way", F.col("area").alias("area_a")).hint("merge"), ["a", "strip"])
    two = other.select(F.col("id").alias("b"), "strip", *[F.col(c).alias("q" + c) for c in (*_PIECE, "way")], F.col("area").alias("area_b"))
    low, high, _ = _gaps()
    met = one.join(two.hint("merge"), ["b", "strip"]).where(low < high)
    ends = [_at(p, y) - F.col("x0") for y in (low, high) for p in ("", "q")]
    met = met.select("a", "b", "area_a", "area_b", (F.col("way") * F.col("qway")).alias("way"), (high - low).alias("high"), *[v.alias(n) for v, n in zip(ends, ("p0", "q0", "p1", "q1"), strict=True)])
    g0, g1 = F.col("p0") - F.col("q0"), F.col("p1") - F.col("q1")
    # the mean of the right one of both over their common height
    beyond = F.when((g0 < 0) & (g1 > 0), g1 * g1 / (g1 - g0) / 2).when((g0 > 0) & (g1 < 0), g0 * g0 / (g0 - g1) / 2).otherwise((F.greatest(g0, F.lit(0.0)) + F.greatest(g1, F.lit(0.0))) / 2)
    part = met.select("a", "b", "area_a", "area_b", (-F.col("way") * F.col("high") * ((F.col("q0") + F.col("q1")) / 2 + beyond)).alias("part"))
    found = part.groupBy("a", "b").agg(F.max("area_a").alias("area_a"), F.max("area_b").alias("area_b"), F.sum("part").alias("shared"), F.sum(F.abs("part")).alias("__all"))
    found = found.where(F.col("shared") > 1e-14 * F.col("__all"))
    return found.select("a", "b", "area_a", "area_b", "shared", (F.col("shared") / (F.col("area_a") + F.col("area_b") - F.col("shared"))).alias("iou"))


def best_matches(pairs: DataFrame, least: float, digits: int = 9) -> DataFrame:
    """``a, b, iou`` of the pairs of at least ``least``, taken from the greatest on, each shape once."""
    rows = keep(pairs.select("a", "b", F.round("iou", digits).alias("iou")).where(F.col("iou") >= least), "iou-pairs")
    return greedy_pairs(rows, "a", "b", cost=-F.col("iou")).select("a", "b", (-F.col("cost")).alias("iou"))


def compared(drawn: DataFrame, traced: DataFrame, size: float, shape_id: str = "id", exempt: str = "exempt", kind: str = "kind", rings: str = "rings") -> DataFrame:
    """``shape_id, status, iou`` of every drawn shape: how well the traced shape of the same id covers it.

    The status is ``hand`` for shapes that are exempt, ``missing`` without a traced shape, else the traced shape's kind; only the
    last have an overlap, 0 where nothing is shared. Ids are unique in both tables; null ids are left out, a null mark does not
    exempt, and traced shapes without a drawn one count for nothing.
    """
    hand = F.coalesce(F.col(exempt).cast("boolean"), F.lit(False))
    own = keep(drawn.where(F.col(shape_id).isNotNull()).select(F.col(shape_id).alias("id"), F.col(rings).alias("rings"), hand.alias("hand")), "drawn")
    other = keep(traced.where(F.col(shape_id).isNotNull()).select(F.col(shape_id).alias("id"), F.col(rings).alias("rings"), F.col(kind).alias("kind"), F.lit(True).alias("found")), "traced")
    shared = shared_areas(own.where("not hand"), other, size, same_id=True).select(F.col("a").alias("__id"), "iou")
    rows = own.select("id", "hand").join(other.select("id", "kind", "found"), "id", "left").join(shared, F.col("id") == F.col("__id"), "left")
    found = ~F.col("hand") & F.col("found").isNotNull()
    status = F.when(F.col("hand"), "hand").when(F.col("found").isNull(), "missing").otherwise(F.col("kind"))
    return rows.select(F.col("id").alias(shape_id), status.alias("status"), F.when(found, F.coalesce("iou", F.lit(0.0))).alias("iou"))


def status_counts(found: DataFrame, *by: str) -> DataFrame:
    """``n, traced, missing, hand`` of what ``compared`` gives: all shapes, those with an overlap, and those without one."""
    counts = [F.count_if(F.col("iou").isNotNull()).alias("traced"), *[F.count_if(F.col("iou").isNull() & (F.col("status") == s)).alias(s) for s in ("missing", "hand")]]
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts)
