"""Display values: names, short numbers, circle sizes, the zoom that opens a cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Point count and circle radius, in between linear.
RADIUS_STOPS = ((0, 15), (100, 25), (1000, 35), (10000, 45))
#: Point count and colour.
COLOUR_STOPS = ((0, "#51bbd6"), (100, "#f1f075"), (1000, "#f28cb1"))


def metric_title(name: Column) -> Column:
    """``avg_income`` -> ``Avg Income``; letters after the first stay as they are."""
    words = F.split(name, "_")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def short_number(value: Column) -> Column:
    """1234567 -> 1.2M, 12345 -> 12.3K, else one decimal."""
    v = value.cast("double")
    return F.when(v >= 1e6, F.concat(F.format_string("%.1f", v / 1e6), F.lit("M"))).when(v >= 1e3, F.concat(F.format_string("%.1f", v / 1e3), F.lit("K"))).otherwise(F.format_string("%.1f", v))


def circle_radius(count: Column) -> Column:
    out = F.when(count <= RADIUS_STOPS[0][0], F.lit(float(RADIUS_STOPS[0][1])))
    for (a, x), (b, y) in zip(RADIUS_STOPS, RADIUS_STOPS[1:], strict=False):
        out = out.when(count <= b, x + (count - a) * float(y - x) / float(b - a))
    return out.otherwise(float(RADIUS_STOPS[-1][1]))


def circle_colour(count: Column) -> Column:
    """The colour of the last stop that is reached."""
    out = F.lit(COLOUR_STOPS[0][1])
    for at, colour in COLOUR_STOPS[1:]:
        out = F.when(count >= at, colour).otherwise(out)
    return out


def opening_zoom(zoom: Column) -> Column:
    return F.least(zoom + 2, F.lit(16))
