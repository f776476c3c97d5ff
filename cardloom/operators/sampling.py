"""Deterministic sampling: by the hash of an id and a seed, so that a sample doesn't depend on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*key: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(seed)))


def sample_set_diverse(rows: DataFrame, n: int, key: str, by: str = "set_code", within: str | None = None, seed: int = 0) -> DataFrame:
    """At most n rows (of each value of ``within``): a pool of n or fewer is taken whole; with fewer than five sets, or n of
    five or less, the first n by hash; else ``max(1, n // (2 * sets))`` of each set, in hashed order of sets, until n,
    and the rest from what is left, by hash.

    A set gives n rows at most. Rows are counted by set and length of their hash as a number: the shortest ones that make up n
    are about 2 n at most, however many rows a set has, and only those are sorted. A single pool then ends in a top-n, several
    in a window per pool.
    """
    pool = rows.withColumn("_w", F.col(within) if within else F.lit(0)).withColumn("_h", hash_order(key, seed=seed))
    length = F.length(F.bin(F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")))  # never falls as the hash grows
    pool = pool.withColumn("_l", length)
    counts = pool.groupBy("_w", by, "_l").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_w", by).orderBy("_l"))
    sets = counts.withColumn("_upto", upto).groupBy("_w", by).agg(
        F.sum("_c").alias("_n"), F.coalesce(F.min(F.when(F.col("_upto") >= n, F.col("_l"))), F.max("_l")).alias("_most")
    )
    shape = sets.groupBy("_w").agg(F.sum("_n").alias("_pool"), F.count("*").alias("_sets"))
    most = sets.select(F.col("_w").alias("_w2"), F.col(by).alias("_by2"), "_most")
    first = pool.join(most, (F.col("_w") == F.col("_w2")) & F.col(by).eqNullSafe(F.col("_by2"))).filter(F.col("_l") <= F.col("_most"))
    inside = F.row_number().over(Window.partitionBy("_w", by).orderBy("_h", key))
    ranked = first.withColumn("_r", inside).filter(F.col("_r") <= n).join(shape, "_w")
    plain = (F.col("_pool") <= n) | (F.col("_sets") < 5) | F.lit(n <= 5)
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / (2 * F.col("_sets"))))
    ranked = ranked.withColumn("_first", ~plain & (F.col("_r") <= quota))
    order = [F.desc("_first"), F.when(F.col("_first"), hash_order(by, seed=seed + 1)), F.when(F.col("_first"), F.col("_r")), F.col("_h"), F.col(key)]
    if within is None:
        return ranked.orderBy(*order).limit(n).select(*rows.columns)
    place = F.row_number().over(Window.partitionBy("_w").orderBy(*order))
    return ranked.withColumn("_place", place).filter(F.col("_place") <= n).select(*rows.columns)


# The step of the generator's state, and the constants that mix it.
STEP, MIX, SPREAD = 0x6D2B79F5, 1, 61
_WORD = (1 << 32) - 1
#: Draws for each row that is wanted, at most.
DRAWS = 50


def _times(x: Column, y: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without leaving 64 bits."""
    high = F.shiftright(x, 16) * y
    return (x.bitwiseAND(F.lit(0xFFFF)) * y + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_WORD))


def nth_draw(n: Column, seed: int) -> Column:
    """The n-th number (from 0) in [0, 1) of the generator whose state grows by a constant with each draw: an expression over
    n, so that draws need no order."""
    state = (F.lit(seed & _WORD) + (n + 1) * F.lit(STEP)).bitwiseAND(F.lit(_WORD))
    mixed = _times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(MIX)))
    spread = _times(mixed.bitwiseXOR(F.shiftright(mixed, 7)), mixed.bitwiseOR(F.lit(SPREAD)))
    mixed = mixed.bitwiseXOR((mixed + spread).bitwiseAND(F.lit(_WORD)))
    return mixed.bitwiseXOR(F.shiftright(mixed, 14)).cast("double") / F.lit(float(1 << 32))


def parity_sample(rows: DataFrame, files: DataFrame, n: int, seed: int = 1, pos: str = "pos") -> DataFrame:
    """rows (pos: 0, 1, 2 ...; filename) that the seeded generator draws, of those with a file, until there are ``n`` or so
    many draws were made: one row per draw, in ``draw`` its number. A row can be drawn again."""
    total = rows.agg(F.count("*").alias("_total"))
    draws = rows.sparkSession.range(DRAWS * n).select(F.col("id").alias("draw")).join(F.broadcast(total))
    drawn = draws.select("draw", F.floor(nth_draw(F.col("draw"), seed) * F.col("_total")).alias(pos))
    held = rows.join(files.select("filename").distinct(), "filename", "left_semi")
    return held.join(F.broadcast(drawn), pos).orderBy("draw").limit(n)


# What the test set's categories are made of.
FRAMES = ("2015", "2003", "1997", "1993", "future")
PLAIN_BORDERS = ("black", "white")
BORDERS = ("borderless", "gold", "silver", "yellow")
TREATMENTS = ("showcase", "extendedart", "etched", "inverted")
EFFECTS = {"legendary": "legendary", "snow": "snow", "companion": "companion", "nyxtouched": "enchantment", "colorshifted": "colorshifted"}
LAYOUTS = (
    "transform", "modal_dfc", "adventure", "split", "flip", "saga", "class", "meld", "leveler", "case", "mutate", "prototype",
    "reversible_card", "host", "augment", "prepare",
)
RARITIES = ("common", "uncommon", "rare", "mythic", "special")
PRINTINGS = (5, 20)


def _has(effect: str) -> Column:
    return F.coalesce(F.array_contains("frame_effects", effect), F.lit(False))


def test_categories(rows: DataFrame) -> DataFrame:
    """One row per face and category that it belongs to: frame and border of plain cards, other borders, treatments, frame
    effects, layouts, back faces, rarities on the newest frame, and names with 5 or 20 rows and more."""
    printings = rows.groupBy("name").agg(F.count("*").alias("printings"))
    framed = ~F.col("full_art") & ~_has("showcase") & ~_has("extendedart")
    is_in = lambda column, values: F.col(column).isin(*values)
    label = lambda prefix, *columns: F.concat_ws("_", *[F.lit(prefix)] * bool(prefix), *columns)
    labels = [
        F.when(is_in("frame", FRAMES) & is_in("border_color", PLAIN_BORDERS) & framed & (F.col("layout") == "normal"), label("", "frame", "border_color")),
        F.when(is_in("border_color", BORDERS) & framed, label("border", "border_color")),
        F.when(F.col("full_art") & is_in("border_color", ("black", "borderless")), label("treatment_fullart", "border_color")),
        *[F.when(_has(e), f"treatment_{e}") for e in TREATMENTS],
        *[F.when(_has(e), f"effect_{name}") for name, e in EFFECTS.items()],
        F.when(is_in("layout", LAYOUTS), label("layout", "layout")),
        F.when(F.col("face_index") == 1, "back_face"),
        F.when((F.col("frame") == "2015") & is_in("rarity", RARITIES), label("rarity", "rarity")),
        *[F.when(F.col("printings") >= n, f"multi_printing_{n}plus") for n in PRINTINGS],
    ]
    return rows.join(printings, "name").withColumn("category", F.explode(F.array_compact(F.array(*labels)))).drop("printings")


def names_in_pool(rows: DataFrame, least: int) -> DataFrame:
    """Rows whose name has at least that many rows."""
    names = rows.groupBy("name").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("name")
    return rows.join(names, "name", "left_semi")


def crop_pools(rows: DataFrame) -> DataFrame:
    """One row per face and pool of one kind of frame that it belongs to."""
    frame, border, full_art = F.col("frame"), F.col("border_color"), F.col("full_art")
    normal = F.col("layout") == "normal"
    black = (border == "black") & normal
    borderless = border == "borderless"
    pools = {
        "2015_black": (frame == "2015") & black & ~full_art & ~_has("showcase") & ~_has("extendedart"),
        **{f"{year}_black": (frame == year) & black for year in ("2003", "1997", "1993")},
        "future": (frame == "future") & normal,
        "borderless": borderless & ~full_art & ~_has("showcase"),
        "borderless_fullart": borderless & full_art,
        "extendedart": _has("extendedart"),
        "showcase": _has("showcase"),
        "white_border": border == "white",
    }
    return rows.withColumn("pool", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in pools.items()]))))


def stratified_sample(rows: DataFrame, per_category: int, key: str = "filename", seed: int = 0) -> DataFrame:
    return sample_set_diverse(test_categories(rows), per_category, key, within="category", seed=seed)


def test_manifest(rows: DataFrame) -> DataFrame:
    """The 13 columns of an evaluation manifest; effects comma-joined, corners as text."""
    from cardloom.functions.text import format_corners

    corners = format_corners(F.col("gt_corners")) if "gt_corners" in rows.columns else F.lit("")
    names = ["filename", "category", "name", "set_code", "collector_number", "frame", "border_color", "full_art", "layout"]
    return rows.select(*names, F.concat_ws(",", "frame_effects").alias("frame_effects"), "rarity", "face_index", corners.alias("gt_corners"))
