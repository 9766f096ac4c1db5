"""Colour functions and the green predicates (D12)."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllo.functions.scalars import col
from phyllo.operators.grouped import per_group

# The share of the hue circle between two ids; preview colours.
HUE_STEP = 0.618033988749895
BACKGROUND, CLICK_BACKGROUND = (0, 0, 0), (150, 150, 150)
NO_LABEL = (220, 220, 220)
MASK_OFF, MASK_ON = (173, 216, 230), (255, 80, 80)
# The twenty colours of the common "tab20" palette.
TAB20 = [
    (31, 119, 180), (174, 199, 232), (255, 127, 14), (255, 187, 120), (44, 160, 44),
    (152, 223, 138), (214, 39, 40), (255, 152, 150), (148, 103, 189), (197, 176, 213),
    (140, 86, 75), (196, 156, 148), (227, 119, 194), (247, 182, 210), (127, 127, 127),
    (199, 199, 199), (188, 189, 34), (219, 219, 141), (23, 190, 207), (158, 218, 229),
]


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("red"), g.cast("int").alias("green"), b.cast("int").alias("blue"))


def constant(color: tuple[int, int, int]) -> Column:
    return rgb(*map(F.lit, color))


def hsv_to_rgb(h: Column, s: float, v: float) -> list[Column]:
    """Red, green and blue in 0..1 of a hue in turns: each is v less what its distance on the circle takes."""

    def channel(offset: int) -> Column:
        k = (h * 6.0 + F.lit(float(offset))) % F.lit(6.0)
        return F.lit(v) - F.lit(v * s) * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))

    return [channel(5), channel(3), channel(1)]


def instance_color(instance: Column | str, s: float = 0.70, v: float = 0.95, background: tuple[int, int, int] = BACKGROUND) -> Column:
    """Colour of an instance id; 0 and less have the background's."""
    instance = col(instance)
    hue = (instance.cast("double") * HUE_STEP) % 1.0
    return F.when(instance > 0, rgb(*[c * 255 for c in hsv_to_rgb(hue, s, v)])).otherwise(constant(background))


def instance_palette(df: DataFrame, instance: str = "instance_id", **options) -> DataFrame:
    """``df`` with ``red, green, blue``: computed once for each distinct id and joined."""
    colors = df.select(instance).distinct().select(instance, instance_color(instance, **options).alias("_c"))
    return df.join(colors, instance, "left").withColumns({c: F.col(f"_c.{c}") for c in ("red", "green", "blue")}).drop("_c")


def label_palette(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, red, green, blue)``: the n-th distinct label has the n-th of the twenty colours, spread over them; 0 is light grey."""
    from phyllo.operators.aggregates import numbered

    ranked = numbered(df.select(label).distinct(), label, "_n")
    ranked = ranked.crossJoin(ranked.agg(F.count(F.lit(1)).alias("_all")))  # one row
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("_n"), F.col("_all") - 1), F.lit(0.0)) * len(TAB20)), F.lit(len(TAB20) - 1))
    color = F.when(F.col(label) == 0, constant(NO_LABEL)).otherwise(F.element_at(F.array(*map(constant, TAB20)), (place + 1).cast("int")))
    return ranked.select(label, color.alias("_c")).select(label, "_c.*")


def random_palette(df: DataFrame, label: str = "label", seed: int = 0) -> DataFrame:
    """``(label, red, green, blue)`` drawn by hashing the label; 0 and less are a dim grey."""
    ids = df.select(label).distinct()
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed * 3 + k), F.col(label)), F.lit(256))
    return ids.select(label, F.when(F.col(label) > 0, rgb(draw(0), draw(1), draw(2))).otherwise(constant((105, 105, 105))).alias("_c")).select(label, "_c.*")


def mask_color(mask: Column | str, on: tuple[int, int, int] = MASK_ON, off: tuple[int, int, int] = MASK_OFF) -> Column:
    """Preview colour of a mask."""
    return F.when(col(mask), constant(on)).otherwise(constant(off))


def rgb_to_hsv8(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in 0..180 (half degrees), saturation and value in 0..255 of 8-bit colours."""
    r, g, b = (c.cast("double") for c in (r, g, b))
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    span = v - low
    hue = F.when(span == 0, 0.0).when(v == r, 60 * (g - b) / F.nullif(span, F.lit(0.0))).when(v == g, 120 + 60 * (b - r) / F.nullif(span, F.lit(0.0))).otherwise(240 + 60 * (r - g) / F.nullif(span, F.lit(0.0)))
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    return F.rint(hue / 2) % 180, F.when(v == 0, 0.0).otherwise(F.rint(255 * span / F.nullif(v, F.lit(0.0)))), v


def is_green(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Foreground by hue, or by an excess of green."""
    r, g, b = (col(c).cast("double") for c in (r, g, b))
    hue, sat, val = rgb_to_hsv8(r, g, b)
    by_hue = hue.between(35, 98) & (sat >= 35) & (val >= 30)
    return by_hue | ((2 * g - r - b >= 18) & (g > r + 8) & (g > b + 8) & (sat >= 25))


def is_green_range(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Foreground by a range of hue, saturation and value."""
    hue, sat, val = rgb_to_hsv8(*(col(c) for c in (r, g, b)))
    return hue.between(35, 85) & sat.between(35, 255) & val.between(35, 255)


def pca_colors(df: DataFrame, feature: str = "feat", keys: tuple[str, ...] = ()) -> DataFrame:
    """``red, green, blue`` in 0..1: the first three principal components of a feature array, drawn to their range."""
    vectors = df.withColumn("_v", array_to_vector(F.col(feature).cast("array<double>")))
    parts = vector_to_array(F.col("_p"))
    scored = PCA(k=3, inputCol="_v", outputCol="_p").fit(vectors).transform(vectors).withColumns({f"_p{i}": parts[i] for i in range(3)}).drop("_v", "_p")
    scored = per_group(scored, {f"_{s}{i}": f(F.col(f"_p{i}")) for i in range(3) for s, f in (("lo", F.min), ("hi", F.max))}, keys)
    unit = lambda i: F.coalesce(F.try_divide(F.col(f"_p{i}") - F.col(f"_lo{i}"), F.col(f"_hi{i}") - F.col(f"_lo{i}")), F.lit(0.0))
    return scored.withColumns({n: unit(i) for i, n in enumerate(("red", "green", "blue"))}).select(*df.columns, "red", "green", "blue")
