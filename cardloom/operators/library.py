"""State transitions of a collection: each takes the present rows and changes, and gives the next rows.

A library row is (card_id, scryfall_id, name, set_code, collector_number, foil, count, created_at, updated_at, ord, photo);
ord is the order of arrival.  (scryfall_id, foil) is unique where scryfall_id isn't null; rows without one are
placeholders.  Everything is set-oriented: sums and maxima commute, so a batch equals its rows one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.vectors import places
from cardloom.sources.shared import kept

FIELDS = ("card_id", "scryfall_id", "name", "set_code", "collector_number", "foil", "count", "created_at", "updated_at", "ord", "photo")
KEY = ("scryfall_id", "foil")
LEAST, MOST = 1, 9999


def check_printing_rule(library: DataFrame) -> DataFrame:
    """(scryfall_id, foil) that more than one row holds: none, after every transition."""
    return library.filter(F.col("scryfall_id").isNotNull()).groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")


def has_duplicate_printings(library: DataFrame) -> DataFrame:
    return check_printing_rule(library).agg(F.count("*").alias("duplicate_printings"))


def fold_duplicates(library: DataFrame) -> DataFrame:
    """One row per (scryfall_id, foil): the oldest stays, counts are summed, the newest date is taken; its photo, or else
    that of the newest folded row. Placeholders stay as they are."""
    known, rest = library.filter(F.col("scryfall_id").isNotNull()), library.filter(F.col("scryfall_id").isNull())
    age = F.struct("created_at", "ord")
    own = [c for c in FIELDS if c not in (*KEY, "count", "created_at", "photo")]
    folded = known.groupBy(*KEY).agg(
        F.min_by(F.struct(*own, "photo"), age).alias("s"), F.sum("count").alias("count"), F.max("created_at").alias("created_at"),
        F.max_by(F.when(F.col("photo").isNotNull(), F.col("photo")), F.when(F.col("photo").isNotNull(), age)).alias("other"),
    )
    return folded.select(*[F.col("s")[c].alias(c) for c in own], *KEY, "count", "created_at", move_photo(F.col("s")["photo"], F.col("other")).alias("photo")).select(*FIELDS).unionByName(rest.select(*FIELDS))


def move_photo(survivor: Column, folded: Column) -> Column:
    return F.coalesce(survivor, folded)


def survivors(library: DataFrame) -> DataFrame:
    """The oldest row of each group."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("created_at", "ord"))
    return library.filter(F.col("scryfall_id").isNotNull()).withColumn("_n", first).filter("_n = 1").drop("_n")


def upsert_add(library: DataFrame, cards: DataFrame) -> DataFrame:
    """Adds counts to held rows of the same (scryfall_id, foil), with the newer date; others are inserted, the first of
    several in order of arrival giving the row. Adds ``merged``: whether cards with other ids went into the row."""
    tagged = library.select(*FIELDS, F.lit(0).alias("_new")).unionByName(cards.select(*FIELDS, F.lit(1).alias("_new")))
    known, rest = tagged.filter(F.col("scryfall_id").isNotNull()), tagged.filter(F.col("scryfall_id").isNull())
    own = [c for c in FIELDS if c not in (*KEY, "count", "created_at", "updated_at", "photo")]
    first = F.struct("_new", "ord")
    rows = known.groupBy(*KEY).agg(
        F.min_by(F.struct(*own, "photo"), first).alias("s"), F.sum("count").alias("count"), F.max("created_at").alias("created_at"),
        F.max_by("updated_at", first).alias("updated_at"), F.min_by("photo", F.when(F.col("photo").isNotNull(), first)).alias("other"),
        (F.count("*") > 1).alias("merged"),
    )
    out = rows.select(*[F.col("s")[c].alias(c) for c in own], *KEY, "count", "created_at", "updated_at", move_photo(F.col("s")["photo"], F.col("other")).alias("photo"), "merged")
    return out.unionByName(rest.select(*FIELDS, F.lit(False).alias("merged")))


def upsert_set(library: DataFrame, cards: DataFrame) -> DataFrame:
    """Held rows take the card's count; the newer date only if the count grew; updated_at only if it changed. Cards hold
    one row per (scryfall_id, foil)."""
    new = cards.filter(F.col("scryfall_id").isNotNull()).select(*[F.col(c).alias(f"n_{c}") for c in FIELDS])
    held = library.filter(F.col("scryfall_id").isNotNull())
    both = held.join(new, (F.col("scryfall_id") == F.col("n_scryfall_id")) & (F.col("foil") == F.col("n_foil")), "full")
    old, fresh = F.col("card_id").isNotNull(), F.col("n_card_id").isNotNull()
    pick = {c: F.when(old, F.col(c)).otherwise(F.col(f"n_{c}")) for c in FIELDS}
    pick["count"] = F.when(fresh, F.col("n_count")).otherwise(F.col("count"))
    grew = old & fresh & (F.col("n_count") > F.col("count"))
    pick["created_at"] = F.when(grew, F.greatest("created_at", "n_created_at")).when(old, F.col("created_at")).otherwise(F.col("n_created_at"))
    pick["updated_at"] = F.when(old & fresh & (F.col("n_count") != F.col("count")), F.col("n_updated_at")).when(old, F.col("updated_at")).otherwise(F.col("n_updated_at"))
    rows = both.select(*[pick[c].alias(c) for c in FIELDS])
    return rows.unionByName(library.filter(F.col("scryfall_id").isNull()).select(*FIELDS)).unionByName(cards.filter(F.col("scryfall_id").isNull()).select(*FIELDS))


def insert_conflicts(library: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards that can't be inserted one by one, in order of ord: their id, or their (scryfall_id, foil), is held or taken by
    an earlier card that can be, or the count is below one."""
    return _judged(library, cards).filter("error is not null").select(*FIELDS, "error")


def _judged(library: DataFrame, cards: DataFrame) -> DataFrame:
    """cards with ``error``: null for those that can be inserted.  Each round decides the cards that come first for both of
    their keys, and those that share a key with one of them; there are as many rounds as the longest chain of such clashes."""
    ids = library.select("card_id").withColumn("_id", F.lit(True))
    keys = library.filter(F.col("scryfall_id").isNotNull()).select(*KEY).distinct().withColumn("_key", F.lit(True))
    rows = cards.select(*FIELDS).join(ids, "card_id", "left").join(keys, list(KEY), "left")
    error = F.when(F.col("_id"), "card_id is held").when(F.col("_key"), "printing is held").when(F.coalesce("count", F.lit(1)) < LEAST, "count below one")
    rows = rows.select(*FIELDS, error.alias("error"), F.xxhash64("card_id", *KEY, "ord", "count").alias("_tie"))
    rows = kept(rows, "judged")  # read twice, and what it is joined from isn't shuffled again
    decided, open_ = rows.filter("error is not null").drop("_tie"), rows.filter("error is null")
    order = ("ord", "_tie")
    first = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    own = F.struct("scryfall_id", "foil", F.when(F.col("scryfall_id").isNull(), F.col("card_id")))  # without a printing, a key of its own
    while not open_.isEmpty():
        ranked = open_.withColumn("_p", own).withColumn("_ok", first("card_id")).withColumn("_ok", F.col("_ok") & first("_p"))
        taken = lambda key: F.max("_ok").over(Window.partitionBy(key))
        clash = F.when(~F.col("_ok") & taken("card_id"), "card_id is held").when(~F.col("_ok") & taken("_p"), "printing is held")
        ranked = kept(ranked.select(*FIELDS, "_tie", "_ok", clash.alias("error")), "insert")
        decided = decided.unionByName(ranked.filter(F.col("_ok") | F.col("error").isNotNull()).select(*FIELDS, "error"))
        open_ = ranked.filter(~F.col("_ok") & F.col("error").isNull()).select(*FIELDS, "error", "_tie")
    return decided


def insert_cards(library: DataFrame, cards: DataFrame) -> DataFrame:
    """Library and cards that don't conflict; a missing count is one, a missing date now."""
    library = kept(library.select(*FIELDS), "library")  # joined twice and put out, but made once
    good = _judged(library, cards).filter("error is null")
    filled = good.withColumns({"count": F.coalesce("count", F.lit(1)), "created_at": F.coalesce("created_at", F.current_timestamp()), "updated_at": F.coalesce("updated_at", F.current_timestamp())})
    return library.select(*FIELDS).unionByName(filled.select(*FIELDS))


PATCH = ("scryfall_id", "name", "set_code", "collector_number", "foil", "count", "created_at")


def fold_patches(changes: DataFrame, *order: str) -> DataFrame:
    """Several patches of one card, in the given order, to one: per field the last value that was set, null if that was
    null, and ``now`` of the last that sets anything. Maxima over (order, value) commute, so a card with very many patches
    is combined before the shuffle; patches of equal order go by their value."""
    fields = [x for x in PATCH if f"set_{x}" in changes.columns]
    at = [F.col(c) for c in (order or ("now",))]
    is_set = {x: F.coalesce(f"set_{x}", F.lit(False)) for x in fields}
    last = [F.max(F.when(is_set[x], F.struct(*[c.alias(f"o{i}") for i, c in enumerate(at)], F.col(x).alias("value")))).alias(x) for x in fields]
    any_ = reduce(lambda a, b: a | b, is_set.values(), F.lit(False))
    now = F.max(F.when(any_, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(at)], F.col("now").alias("value")))).alias("now")
    folded = changes.groupBy("card_id").agg(*last, now)
    return folded.select("card_id", F.col("now.value").alias("now"), *[F.col(x).isNotNull().alias(f"set_{x}") for x in fields], *[F.col(f"{x}.value").alias(x) for x in fields])


def update_cards(library: DataFrame, changes: DataFrame, *order: str) -> DataFrame:
    """changes: card_id, now, and set_x, x for fields of ``PATCH``. A field changes where its flag is there and set, to null
    as well; a change without flags does nothing; otherwise updated_at becomes ``now``. Several changes of one card are
    applied in the order of the columns ``order`` (of ``now``, where none are given); card_id stays unique."""
    fields = [x for x in PATCH if f"set_{x}" in changes.columns]
    c = fold_patches(changes, *order)
    c = c.select("card_id", "now", *[F.col(f"set_{x}").alias(f"_set_{x}") for x in fields], *[F.col(x).alias(f"_{x}") for x in fields])
    rows = library.join(c, "card_id", "left")
    flags = [F.coalesce(f"_set_{x}", F.lit(False)) for x in fields]
    new = {x: F.when(f, F.col(f"_{x}")).otherwise(F.col(x)) for x, f in zip(fields, flags, strict=True)}
    new["updated_at"] = F.when(reduce(lambda a, b: a | b, flags, F.lit(False)), F.col("now")).otherwise(F.col("updated_at"))
    return rows.select(*[new.get(x, F.col(x)).alias(x) for x in FIELDS])


def unknown_ids(library: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(library.select("card_id"), "card_id", "left_anti").select("card_id")


def delete_cards(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids.select("card_id").distinct(), "card_id", "left_anti").select(*FIELDS)


def deleted(library: DataFrame, ids: DataFrame) -> DataFrame:
    """Each id, and whether it existed."""
    held = library.select("card_id").withColumn("existed", F.lit(True))
    return ids.select("card_id").distinct().join(held, "card_id", "left").select("card_id", F.coalesce("existed", F.lit(False)).alias("existed"))


def merge_errors(library: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (source, target) that can't be merged: with itself, with a missing side, or in a chain."""
    ids = library.select("card_id")
    has = lambda c: F.col(f"_{c}").isNotNull()
    rows = pairs.join(ids.select(F.col("card_id").alias("source"), F.lit(1).alias("_source")), "source", "left").join(ids.select(F.col("card_id").alias("target"), F.lit(1).alias("_target")), "target", "left")
    rows = rows.join(pairs.select(F.col("source").alias("target"), F.lit(1).alias("_chain")).distinct(), "target", "left")
    error = F.when(F.col("source") == F.col("target"), "self").when(~has("source"), "no source").when(~has("target"), "no target").when(has("chain"), "chain")
    return rows.withColumn("error", error).filter("error is not null").select("source", "target", "error")


def merge_cards(library: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each source goes into its target: counts add, the newer date stays, a missing photo is taken over."""
    good = pairs.join(merge_errors(library, pairs).select("source", "target"), ["source", "target"], "left_anti").dropDuplicates(["source"])
    source = library.select(F.col("card_id").alias("source"), F.col("count").alias("s_count"), F.col("created_at").alias("s_at"), F.col("photo").alias("s_photo"))
    added = good.join(source, "source").groupBy(F.col("target").alias("card_id")).agg(F.sum("s_count").alias("s_count"), F.max("s_at").alias("s_at"), F.max_by("s_photo", F.when(F.col("s_photo").isNotNull(), F.col("s_at"))).alias("s_photo"))
    rows = library.join(good.select(F.col("source").alias("card_id")), "card_id", "left_anti").join(added, "card_id", "left")
    new = {"count": F.col("count") + F.coalesce("s_count", F.lit(0)), "created_at": F.greatest("created_at", F.coalesce("s_at", "created_at")), "photo": move_photo(F.col("photo"), F.col("s_photo"))}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in FIELDS])


def change_cards(library: DataFrame, changes: DataFrame, *order: str) -> DataFrame:
    """``update_cards``; where a changed row lands on the (scryfall_id, foil) of an unchanged one, it goes into that row. Of
    several changes of one card, in their order, it is the last state that lands."""
    updated = update_cards(library, changes, *order)
    touched = changes.select("card_id").distinct().withColumn("_touched", F.lit(1))
    rows = updated.join(touched, "card_id", "left").withColumn("_touched", F.coalesce("_touched", F.lit(0)))
    first = Window.partitionBy(*KEY).orderBy("_touched", "ord")
    target = F.when(F.col("scryfall_id").isNotNull(), F.first("card_id").over(first))
    pairs = rows.withColumn("target", target).filter((F.col("target") != F.col("card_id")) & (F.col("_touched") == 1)).select(F.col("card_id").alias("source"), "target")
    return merge_cards(updated, pairs)


def add_scans(library: DataFrame, scans: DataFrame, catalog: DataFrame) -> DataFrame:
    """scans (card_id, scryfall_id, foil, at, ord, photo): names and numbers come from the catalogue, a null id makes a
    placeholder ``Unknown``; then ``upsert_add`` of one copy each. Scans of ``scan_errors`` are left out."""
    c = catalog.select("scryfall_id", "name", "set_code", "collector_number")
    good = scans.join(scan_errors(library, scans, catalog).select("card_id"), "card_id", "left_anti")
    rows = good.join(c, "scryfall_id", "left").withColumns({"name": F.coalesce("name", F.lit("Unknown")), "count": F.lit(1).cast("long"), "created_at": F.col("at"), "updated_at": F.col("at")})
    return upsert_add(library, rows)


def scan_errors(library: DataFrame, scans: DataFrame, catalog: DataFrame) -> DataFrame:
    ids = catalog.select("scryfall_id").distinct().withColumn("_known", F.lit(True))
    held = library.select("card_id").withColumn("_held", F.lit(True))
    rows = scans.join(ids, "scryfall_id", "left").join(held, "card_id", "left")
    error = F.when(F.col("_held"), "card_id is held").when(F.col("scryfall_id").isNotNull() & F.col("_known").isNull(), "not in the catalogue")
    return rows.withColumn("error", error).filter("error is not null").select("card_id", "scryfall_id", "error")


def find_owned(library: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (scryfall_id, foil, ...) with the held row's card_id and count, and the count after one more."""
    held = library.filter(F.col("scryfall_id").isNotNull()).select(*KEY, F.col("card_id").alias("owned_id"), F.col("count").alias("owned"))
    return wanted.join(held, list(KEY), "left").withColumn("then", F.col("owned") + 1)


def find_duplicates(library: DataFrame) -> DataFrame:
    """Each row's other rows of the same (scryfall_id, foil), oldest first."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("created_at", "ord"))
    n = F.count("*").over(Window.partitionBy(*KEY))
    rows = library.filter(F.col("scryfall_id").isNotNull()).withColumns({"n": n, "rank": rank})
    return rows.filter("n > 1").select(*KEY, "rank", "card_id", "count", "created_at")


def list_newest(library: DataFrame) -> DataFrame:
    """All rows with their place, newest first; ranges of the order are numbered by themselves."""
    return places(library, F.desc("created_at"), F.desc("ord"))


def validate_updates(rows: DataFrame, body: str = "body") -> DataFrame:
    """A JSON column of changes to typed fields, flags of those present, and the first rule broken (``error``)."""
    types = {"scryfall_id": "string", "name": "string", "set_code": "string", "collector_number": "string", "foil": "boolean", "count": "double"}
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    raw = {k: F.get_json_object(body, f"$.{k}") for k in types}
    has = {k: F.array_contains(keys, k) for k in types}
    text = lambda k: F.when(F.trim(raw[k]) != "", F.trim(raw[k]))
    count = raw["count"].try_cast("double")
    value = {k: text(k) for k in ("scryfall_id", "name", "set_code", "collector_number")} | {"foil": raw["foil"].try_cast("boolean"), "count": F.when(count == F.floor(count), count.cast("long"))}
    error = (
        F.when(has["name"] & value["name"].isNull(), "name is blank").when(has["foil"] & ~F.coalesce(raw["foil"].isin("true", "false"), F.lit(False)), "foil is not a boolean")
        .when(has["count"] & ~F.coalesce(value["count"].between(LEAST, MOST), F.lit(False)), "count is not from 1 to 9999")
    )
    valid = F.json_object_keys(body).isNotNull()
    return rows.select("*", *[has[k].alias(f"set_{k}") for k in types], *[value[k].alias(k) for k in types], F.when(~F.coalesce(valid, F.lit(False)), "not an object").otherwise(error).alias("error"))
