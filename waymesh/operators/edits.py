"""Batch edits of authored routes (B11-B20), each over a whole node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.chains import BEST_PRIORITY
from waymesh.operators.numbering import number_rows
from waymesh.operators.tree import KEY, MARKS, frame_pieces, spines
from waymesh.session import cut

NODE = [*KEY, "places", "marks", "priority"]


def rename_counts(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """How often each name of ``renames(old, new)`` occurs on any route."""
    seen = nodes.select(F.explode("places").alias("old"))
    return renames.join(seen.groupBy("old").agg(F.count("*").alias("n")), "old", "left").select(
        "old", "new", F.coalesce("n", F.lit(0)).alias("occurrences")
    )


def rename_stops(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """Every occurrence of ``old`` becomes ``new``; only touched nodes are rebuilt."""
    hit = (
        nodes.select(*KEY, F.posexplode("places").alias("pos", "old"))
        .join(renames, "old")
        .groupBy(*KEY)
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("swap"))
    )
    return nodes.join(hit, KEY, "left").select(
        *KEY,
        F.when(F.col("swap").isNull(), F.col("places"))
        .otherwise(F.expr("transform(places, (p, i) -> coalesce(try_element_at(swap, i), p))"))
        .alias("places"),
        "marks",
        "priority",
    )


def _sorted_marks(column: str) -> Column:
    """Marks in the stored order: by ``from``, the given order among equals."""
    return F.expr(
        f"transform(array_sort(transform({column}, (m, i) -> struct(m.from as k, i as i, m as m))), e -> e.m)"
    )


def reverse_routes(nodes: DataFrame) -> DataFrame:
    """Flat routes the other way round, marks over the same stretches."""
    return nodes.withColumn(
        "turned",
        F.expr(
            "transform(marks, m -> named_struct('from', size(places) - 1 - m.to, "
            "'to', size(places) - 1 - m.from, 'priority', m.priority))"
        ).cast(MARKS),
    ).select(*KEY, F.reverse("places").alias("places"), _sorted_marks("turned").alias("marks"), "priority")


def set_marks(nodes: DataFrame, ratings: DataFrame) -> DataFrame:
    """Lay ``ratings(route_idx, node_path, from, to, priority)``, one per node, over
    the node's marks. What overlaps is trimmed or split, priority 0 clears, marks that only
    meet at a stop stay, and a range given backwards is turned round."""
    laid = ratings.select(
        *KEY,
        F.least("from", "to").alias("lo"),
        F.greatest("from", "to").alias("hi"),
        F.col("priority").alias("rating"),
    ).where("lo < hi")
    merged = F.expr(
        f"""concat(
          flatten(transform(marks, m -> case
            when m.to <= lo or m.from >= hi then array(m)
            else concat(
              if(m.from < lo, array(named_struct('from', m.from, 'to', lo, 'priority', m.priority)), cast(array() as {MARKS})),
              if(m.to > hi, array(named_struct('from', hi, 'to', m.to, 'priority', m.priority)), cast(array() as {MARKS})))
            end)),
          if(rating > {BEST_PRIORITY}, array(named_struct('from', lo, 'to', hi, 'priority', rating)), cast(array() as {MARKS})))"""
    )
    return (
        nodes.join(laid, KEY, "left")
        .withColumn("merged", F.when(F.col("lo").isNull(), F.col("marks")).otherwise(merged))
        .select(*KEY, "places", _sorted_marks("merged").alias("marks"), "priority")
    )


def remove_marks(nodes: DataFrame, doomed: DataFrame) -> DataFrame:
    """Drop mark ``mark_index`` of each named node."""
    return nodes.join(doomed, KEY, "left").select(
        *KEY,
        "places",
        F.expr("if(mark_index is null, marks, filter(marks, (m, i) -> i <> mark_index))").alias("marks"),
        "priority",
    )


# Old index -> new index of each kept stop, -1 for one that is gone: identity when the
# length is kept, else the first later stop of the same name.
_ALIGN = """
if(size(prev) = size(next), transform(prev, (p, i) -> i),
  aggregate(prev, named_struct('map', cast(array() as array<int>), 'cur', 0),
    (s, p) -> if(
      array_position(slice(next, s.cur + 1, size(next)), p) > 0,
      named_struct(
        'map', array_append(s.map, cast(s.cur + array_position(slice(next, s.cur + 1, size(next)), p) - 1 as int)),
        'cur', cast(s.cur + array_position(slice(next, s.cur + 1, size(next)), p) as int)),
      named_struct('map', array_append(s.map, -1), 'cur', s.cur)),
    s -> s.map))"""

_OWN = f"""
filter(transform(marks, m -> named_struct(
    'm', m,
    'kept', filter(slice(align, m.from + 1, least(m.to, size(prev) - 1) - m.from + 1), k -> k >= 0))),
  e -> size(e.kept) > 0)"""

_OWN_OUT = f"""
filter(transform(own, e -> named_struct(
    'from', e.kept[0],
    'to', if(e.m.to >= size(prev), e.m.to + size(next) - size(prev), e.kept[size(e.kept) - 1]),
    'priority', e.m.priority)), m -> m.to > m.from)"""

_REACHING = """
filter(transform(marks, m -> named_struct(
    'from', m.from,
    'to', case
      when m.to < offset then m.to
      when m.to >= offset + size(prev) then m.to + size(next) - size(prev)
      else coalesce(
        offset + try_element_at(filter(slice(align, 1, m.to - offset + 1), k -> k >= 0), -1),
        offset - 1) end,
    'priority', m.priority)), m -> m.to > m.from)"""


def patch_places(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Give nodes new stops and carry every mark over them.

    ``patches(route_idx, node_path, next)`` names at most one node per route. The node's
    own marks follow its stops; marks of nodes upstream that reach into it follow the
    stops they still cover.
    """
    edited = (
        nodes.select(*KEY, F.col("places").alias("prev"))
        .join(patches.select(*KEY, "next"), KEY)
        .withColumn("align", F.expr(_ALIGN))
    )
    own = nodes.join(edited, KEY, "left_semi").join(edited, KEY).withColumn("own", F.expr(_OWN))
    own = own.withColumn("out", F.expr(_OWN_OUT).cast(MARKS)).select(
        *KEY, F.col("next").alias("places"), _sorted_marks("out").alias("marks"), "priority"
    )
    # The distance from the front of an upstream node's frame to the edited node.
    others = nodes.join(edited.select(*KEY), KEY, "left_anti")
    target = edited.select("route_idx", F.col("node_path").alias("up_path"), "prev", "next", "align")
    sizes = nodes.select("route_idx", F.col("node_path").alias("up_path"), F.size("places").alias("n"))
    above = spines(others).join(target.select("route_idx", "up_path"), ["route_idx", "up_path"]).select(
        *KEY, F.col("step").alias("reach")
    )
    offsets = (
        spines(others)
        .join(above, KEY)
        .where("step < reach")
        .join(sizes, ["route_idx", "up_path"])
        .groupBy(*KEY)
        .agg(F.sum("n").cast("int").alias("offset"), F.max("reach").alias("reach"))
    )
    reaching = (
        others.join(offsets, KEY)
        .withColumn("up_path", F.expr("slice(node_path, 1, size(node_path) - reach)"))
        .join(target, ["route_idx", "up_path"])
        .withColumn("out", F.expr(_REACHING).cast(MARKS))
        .select(*KEY, "places", _sorted_marks("out").alias("marks"), "priority")
    )
    rest = others.join(offsets, KEY, "left_anti")
    return own.unionByName(reaching).unionByName(rest.select(*NODE))


def remove_range(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Delete frame ranges ``(route_idx, node_path, from, to)``, one per route. A range
    may run down into the shared tail; its pieces are applied node by node, so the number
    of rounds is at most the depth of the trees."""
    marked = ranges.select(F.struct("route_idx", "node_path").alias("range_id"), *KEY, "from", "to")
    pieces = cut(frame_pieces(nodes, marked), "pieces")
    deepest = pieces.agg(F.max("step")).first()[0]
    out = nodes.select(*NODE)
    for step in range((deepest if deepest is not None else -1) + 1):
        piece = pieces.where(F.col("step") == step).select(
            "route_idx", F.col("up_path").alias("node_path"), "from", "to"
        )
        patches = out.join(piece, KEY).select(
            *KEY, F.expr("filter(places, (p, i) -> i < from or i > to)").alias("next")
        )
        out = cut(patch_places(out, patches), "patched")
    return out


def duplicate_routes(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Copies of the chosen routes, each placed right after its original; the routes
    behind move back."""
    picked = chosen.select("route_idx").distinct()
    index = nodes.select("route_idx").distinct().join(
        picked.withColumn("twice", F.lit(1)), "route_idx", "left"
    ).select("route_idx", F.coalesce("twice", F.lit(0)).alias("twice"))
    copies = index.select("route_idx", F.explode(F.sequence(F.lit(0), F.col("twice"))).alias("copy"))

    placed = number_rows(copies, ["route_idx", "copy"], "new_idx")
    return nodes.join(placed, "route_idx").select(
        F.col("new_idx").cast(nodes.schema["route_idx"].dataType).alias("route_idx"),
        "node_path",
        "places",
        "marks",
        "priority",
    )


def split_stops(text: Column | str) -> Column:
    """A pasted comma list as stops, trimmed, blanks dropped."""
    return F.filter(
        F.transform(F.split(text, ","), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != ""
    )


def row_flags(nodes: DataFrame, priorities: DataFrame, closed: DataFrame) -> DataFrame:
    """Per route: touches a closure, worst rating, branched, too short."""
    touched = (
        nodes.select("route_idx", F.explode("places").alias("place"))
        .join(closed.select("place").distinct(), "place", "left_semi")
        .select("route_idx")
        .distinct()
        .withColumn("compromised", F.lit(True))
    )
    shape = nodes.groupBy("route_idx").agg(
        (F.max(F.size("node_path")) > 0).alias("branched"),
        F.max(F.when(F.size("node_path") == 0, F.size("places"))).alias("own"),
    )
    return (
        shape.join(priorities, "route_idx")
        .join(touched, "route_idx", "left")
        .select(
            "route_idx",
            F.coalesce("compromised", F.lit(False)).alias("compromised"),
            F.array_max("priorities").alias("worst"),
            "branched",
            (~F.col("branched") & (F.coalesce("own", F.lit(0)) < 2)).alias("too_short"),
        )
    )


def filter_routes(
    nodes: DataFrame,
    priorities: DataFrame,
    stops: list[str] = (),
    text: str = "",
    ratings: list[int] = (),
    pinned: DataFrame | None = None,
) -> DataFrame:
    """Routes in which every selected text is part of some stop, the free text too, and
    some rating is selected (none selected: all). Pinned routes pass regardless.

    ``places`` hold display names. One aggregate per route; no route is gathered whole.
    """
    terms = [s.lower() for s in stops]
    free = text.strip().lower()
    if free:
        terms.append(free)
    name = F.lower("place")
    seen = nodes.select("route_idx", F.explode_outer("places").alias("place"))
    tests = [F.max(F.coalesce(F.contains(name, F.lit(t)), F.lit(False))).alias(f"t{i}") for i, t in enumerate(terms)]
    matched = seen.groupBy("route_idx").agg(F.count("place").alias("n"), *tests)
    for i in range(len(terms)):
        matched = matched.where(F.col(f"t{i}"))
    if ratings:
        wanted = priorities.where(F.arrays_overlap("priorities", F.array(*[F.lit(r) for r in ratings])))
        matched = matched.join(wanted.select("route_idx"), "route_idx", "left_semi")
    out = matched.select("route_idx")
    return out if pinned is None else out.unionByName(pinned.select("route_idx")).distinct()
