"""Collection transitions and imports over line items, which stand for copies of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import imports as I
from cardloom.operators import library as L
from cardloom.plans import tables as T
from cardloom.plans.registry import SQL, query
from cardloom.sources.shared import new_path, passing
from cardloom.sources.snapshots import read_snapshot, write_snapshot

H = "WITH " + T.LIBRARY_SQL
ALL = ", ".join(L.FIELDS)


def later():
    return F.lit("2002-01-01").cast("timestamp")


@query("fold_duplicates", H + f" SELECT {ALL} FROM held")
def fold_duplicates(spark, sf):
    return T.held_and_batch(spark, sf)[0].select(*L.FIELDS)


@query("move_photo", H + " SELECT card_id, photo FROM held WHERE photo IS NOT NULL")
def move_photo(spark, sf):
    return T.held_and_batch(spark, sf)[0].filter("photo is not null").select("card_id", "photo")


@query("survivor_pick", H + " SELECT card_id FROM held WHERE scryfall_id IS NOT NULL")
def survivor_pick(spark, sf):
    first = F.lit("1998-01-01").cast("timestamp")
    return L.survivors(T.library_rows(spark, sf).filter(F.col("created_at") < first)).select("card_id")


@query("count_library", H + " SELECT count(*) AS n FROM held")
def count_library(spark, sf):
    return T.held_and_batch(spark, sf)[0].agg(F.count("*").alias("n"))


@query("has_duplicate_printings", H + " SELECT count(*) AS duplicate_printings FROM (SELECT 1 FROM lib WHERE scryfall_id IS NOT NULL GROUP BY scryfall_id, foil HAVING count(*) > 1)")
def has_duplicate_printings(spark, sf):
    return L.has_duplicate_printings(T.library_rows(spark, sf))


@query("check_printing_rule", H + " SELECT scryfall_id, foil, count(*) AS n FROM lib WHERE scryfall_id IS NOT NULL GROUP BY scryfall_id, foil HAVING count(*) > 1")
def check_printing_rule(spark, sf):
    return L.check_printing_rule(T.library_rows(spark, sf))


ADD = """, u AS (SELECT *, CAST(0 AS HUGEINT) * 0 + ord AS turn FROM held UNION ALL SELECT *, CAST(1000000000000000000000 AS HUGEINT) + ord FROM batch)
SELECT arg_min(card_id, turn) AS card_id, scryfall_id, foil, CAST(sum(count) AS BIGINT) AS count, max(created_at) AS created_at, arg_max(updated_at, turn) AS updated_at, count(*) > 1 AS merged
FROM u WHERE scryfall_id IS NOT NULL GROUP BY scryfall_id, foil
UNION ALL SELECT card_id, scryfall_id, foil, count, created_at, updated_at, false FROM u WHERE scryfall_id IS NULL"""


@query("upsert_add", H + ADD)
def upsert_add(spark, sf):
    held, batch = T.held_and_batch(spark, sf)
    return L.upsert_add(held, batch).select("card_id", "scryfall_id", "foil", "count", "created_at", "updated_at", "merged")


ONE = ", one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scryfall_id, foil ORDER BY ord) AS r1 FROM batch WHERE scryfall_id IS NOT NULL) WHERE r1 = 1)"


@query("upsert_set", H + ONE + """ SELECT coalesce(h.card_id, o.card_id) AS card_id, coalesce(h.scryfall_id, o.scryfall_id) AS scryfall_id, coalesce(h.foil, o.foil) AS foil, coalesce(o.count, h.count) AS count,
  CASE WHEN h.card_id IS NULL THEN o.created_at WHEN o.count > h.count THEN greatest(h.created_at, o.created_at) ELSE h.created_at END AS created_at,
  CASE WHEN h.card_id IS NULL OR o.count <> h.count THEN o.updated_at ELSE h.updated_at END AS updated_at
FROM (SELECT * FROM held WHERE scryfall_id IS NOT NULL) h FULL JOIN one o ON o.scryfall_id = h.scryfall_id AND o.foil = h.foil
UNION ALL SELECT card_id, scryfall_id, foil, count, created_at, updated_at FROM held WHERE scryfall_id IS NULL""")
def upsert_set(spark, sf):
    held, batch = T.held_and_batch(spark, sf)
    rest = [c for c in L.FIELDS if c not in L.KEY]
    one = batch.filter("scryfall_id is not null").groupBy(*L.KEY).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*L.KEY, "r.*")
    return L.upsert_set(held, one).select("card_id", "scryfall_id", "foil", "count", "created_at", "updated_at")


@query("insert_cards", H + """, k AS (SELECT b.* FROM batch b WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.scryfall_id = b.scryfall_id AND h.foil = b.foil)),
n AS (SELECT *, row_number() OVER (PARTITION BY scryfall_id, foil ORDER BY ord) AS turn FROM k)
SELECT card_id, scryfall_id, foil, count FROM held UNION ALL SELECT card_id, scryfall_id, foil, count FROM n WHERE turn = 1 OR scryfall_id IS NULL""")
def insert_cards(spark, sf):
    """Of several of one printing in the batch the first goes in; card ids are all different."""
    held, batch = T.held_and_batch(spark, sf)
    return L.insert_cards(held, batch).select("card_id", "scryfall_id", "foil", "count")


@query("update_cards", H + """ SELECT card_id, CASE WHEN ord % 10 = 1 THEN NULL ELSE scryfall_id END AS scryfall_id, CASE WHEN ord % 10 = 2 THEN 7 ELSE count END AS count,
  CASE WHEN ord % 10 = 3 THEN TIMESTAMP '2001-01-01' ELSE created_at END AS created_at, CASE WHEN ord % 10 IN (1, 2, 3) THEN TIMESTAMP '2002-01-01' ELSE updated_at END AS updated_at FROM held""")
def update_cards(spark, sf):
    held, _ = T.held_and_batch(spark, sf)
    return L.update_cards(held, _changes(held)).select("card_id", "scryfall_id", "count", "created_at", "updated_at")


def _changes(held):
    no, text = F.lit(False), F.lit(None).cast("string")
    flags = {"scryfall_id": F.col("ord") % 10 == 1, "count": F.col("ord") % 10 == 2, "created_at": F.col("ord") % 10 == 3}
    values = {"foil": F.lit(True), "count": F.lit(7).cast("long"), "created_at": F.lit("2001-01-01").cast("timestamp")}
    return held.select("card_id", later().alias("now"), *[flags.get(k, no).alias(f"set_{k}") for k in L.PATCH], *[values.get(k, text).alias(k) for k in L.PATCH])


REPEATED = """, p AS (
  SELECT card_id, n, CASE WHEN n = 1 THEN false WHEN n = 3 THEN true END AS foil, CASE WHEN n = 2 THEN 7 WHEN n = 4 THEN 9 END AS count, n % 2 = 0 AS set_count, n % 2 = 1 AND n < 5 AS set_foil, n = 5 AND ord % 2 = 0 AS set_scryfall_id
  FROM held, range(1, 6) r(n) WHERE ord % 4 = 0 AND n <= 1 + ord % 5),
f AS (SELECT card_id, arg_max(foil, n) FILTER (set_foil) AS foil, arg_max(count, n) FILTER (set_count) AS count, bool_or(set_scryfall_id) AS cleared, max(n) FILTER (set_foil OR set_count OR set_scryfall_id) AS last FROM p GROUP BY card_id),
u AS (SELECT h.card_id, CASE WHEN f.cleared THEN NULL ELSE h.scryfall_id END AS scryfall_id, coalesce(f.foil, h.foil) AS foil, coalesce(f.count, h.count) AS count, h.ord, h.created_at,
  CASE WHEN f.last IS NULL THEN h.updated_at ELSE TIMESTAMP '2002-01-01' + f.last * INTERVAL 1 DAY END AS updated_at, f.card_id IS NOT NULL AS touched FROM held h LEFT JOIN f USING (card_id))"""


def _repeated(held):
    """Up to five patches of every fourth card: the printing's foil, its count, and, by the last, no printing at all."""
    n, no = F.col("n"), F.lit(None)
    rows = held.filter("ord % 4 = 0").withColumn("n", F.explode(F.sequence(F.lit(1), (F.col("ord") % 5 + 1).cast("int"))))
    values = {"foil": F.when(n == 1, False).when(n == 3, True), "count": F.when(n == 2, 7).when(n == 4, 9).cast("long"), "created_at": no.cast("timestamp")}
    flags = {"foil": (n % 2 == 1) & (n < 5), "count": n % 2 == 0, "scryfall_id": (n == 5) & (F.col("ord") % 2 == 0)}
    now = F.timestamp_add("DAY", n, later()).alias("now")
    return rows.select("card_id", "n", now, *[flags.get(k, F.lit(False)).alias(f"set_{k}") for k in L.PATCH], *[values.get(k, no.cast("string")).alias(k) for k in L.PATCH])


@query("update_cards_repeated", H + REPEATED + " SELECT card_id, scryfall_id, foil, count, updated_at FROM u")
def update_cards_repeated(spark, sf):
    held, _ = T.held_and_batch(spark, sf)
    return L.update_cards(held, _repeated(held), "n").select("card_id", "scryfall_id", "foil", "count", "updated_at")


@query("change_cards_repeated", H + REPEATED + """, t AS (SELECT *, CASE WHEN scryfall_id IS NOT NULL THEN first_value(card_id) OVER (PARTITION BY scryfall_id, foil ORDER BY touched, ord) END AS target FROM u),
m AS (SELECT target AS card_id, sum(count) AS count FROM t WHERE touched AND target <> card_id GROUP BY target)
SELECT t.card_id, scryfall_id, foil, CAST(t.count + coalesce(m.count, 0) AS BIGINT) AS count FROM t LEFT JOIN m USING (card_id) WHERE NOT (touched AND coalesce(target, card_id) <> card_id)""")
def change_cards_repeated(spark, sf):
    held, _ = T.held_and_batch(spark, sf)
    return L.change_cards(held, _repeated(held), "n").select("card_id", "scryfall_id", "foil", "count")


@query("delete_cards", H + " SELECT card_id FROM held WHERE count % 2 = 0")
def delete_cards(spark, sf):
    held, _ = T.held_and_batch(spark, sf)
    return L.delete_cards(held, held.filter("count % 2 = 1").select("card_id")).select("card_id")


PAIRS = """, p AS (SELECT a.card_id AS source, b.card_id AS target FROM held a JOIN held b ON a.scryfall_id = b.scryfall_id AND a.foil AND NOT b.foil)"""


@query("merge_cards", H + PAIRS + """ SELECT h.card_id, h.scryfall_id, h.foil, h.count + coalesce(s.count, 0) AS count, greatest(h.created_at, coalesce(s.created_at, h.created_at)) AS created_at
FROM held h LEFT JOIN p ON p.target = h.card_id LEFT JOIN held s ON s.card_id = p.source WHERE h.card_id NOT IN (SELECT source FROM p)""")
def merge_cards(spark, sf):
    held, _ = T.held_and_batch(spark, sf)
    a = held.filter("foil").select("scryfall_id", F.col("card_id").alias("source"))
    pairs = a.join(held.filter("not foil").select("scryfall_id", F.col("card_id").alias("target")), "scryfall_id").select("source", "target")
    return L.merge_cards(held, pairs).select("card_id", "scryfall_id", "foil", "count", "created_at")


@query("change_cards", H + """, c AS (SELECT *, foil AND scryfall_id IS NOT NULL AND ord % 3 = 0 AS moved FROM held),
s AS (SELECT c.*, o.card_id AS onto FROM c LEFT JOIN c o ON c.moved AND o.scryfall_id = c.scryfall_id AND NOT o.foil AND NOT o.moved)
SELECT s.card_id, s.scryfall_id, CASE WHEN s.moved THEN false ELSE s.foil END AS foil, s.count + coalesce(m.count, 0) AS count FROM s LEFT JOIN s m ON m.onto = s.card_id WHERE s.onto IS NULL""")
def change_cards(spark, sf):
    """A third of the foil rows turn plain, and go into the plain row of the same item where there is one."""
    held, _ = T.held_and_batch(spark, sf)
    moved = held.filter("foil and scryfall_id is not null and ord % 3 = 0")
    no, text = F.lit(False), F.lit(None).cast("string")
    flags = {k: F.lit(k == "foil") for k in L.PATCH}
    values = {"foil": no, "count": F.lit(None).cast("long"), "created_at": F.lit(None).cast("timestamp")}
    changes = moved.select("card_id", later().alias("now"), *[v.alias(f"set_{k}") for k, v in flags.items()], *[values.get(k, text).alias(k) for k in L.PATCH])
    return L.change_cards(held, changes).select("card_id", "scryfall_id", "foil", "count")


@query("add_scans", H + """, cat AS (SELECT CAST(p_partkey AS VARCHAR) AS scryfall_id, p_name AS name FROM part), good AS (SELECT b.* FROM batch b WHERE scryfall_id IS NULL OR scryfall_id IN (SELECT scryfall_id FROM cat)),
u AS (SELECT card_id, scryfall_id, foil, count, created_at, 0 AS new, ord FROM held UNION ALL SELECT card_id, scryfall_id, foil, 1, created_at, 1, ord FROM good)
SELECT scryfall_id, foil, CAST(sum(count) AS BIGINT) AS count, max(created_at) AS created_at, count(*) AS rows FROM u WHERE scryfall_id IS NOT NULL GROUP BY scryfall_id, foil
UNION ALL SELECT NULL, foil, CAST(sum(count) AS BIGINT), max(created_at), count(*) FROM u WHERE scryfall_id IS NULL GROUP BY foil""".replace("count(*) AS rows", "1 AS rows"))
def add_scans(spark, sf):
    held, batch = T.held_and_batch(spark, sf)
    scans = batch.select("card_id", "scryfall_id", "foil", F.col("created_at").alias("at"), "ord", "photo")
    out = L.add_scans(held, scans, T.catalog(spark, sf))
    known = F.col("scryfall_id").isNotNull()
    return out.groupBy("scryfall_id", "foil").agg(F.sum("count").alias("count"), F.max("created_at").alias("created_at"), F.count("*").alias("rows")).withColumn("rows", F.when(known, 1).otherwise(F.col("rows")).cast("long"))


@query("find_owned", H + """ SELECT b.card_id, h.card_id AS owned_id, h.count AS owned, h.count + 1 AS "then" FROM batch b LEFT JOIN held h ON h.scryfall_id = b.scryfall_id AND h.foil = b.foil""")
def find_owned(spark, sf):
    held, batch = T.held_and_batch(spark, sf)
    return L.find_owned(held, batch.select("card_id", *L.KEY)).select("card_id", "owned_id", "owned", "then")


@query("find_duplicates", H + """ SELECT * FROM (SELECT scryfall_id, foil, row_number() OVER (PARTITION BY scryfall_id, foil ORDER BY created_at, ord) AS rank, card_id, count, created_at,
  count(*) OVER (PARTITION BY scryfall_id, foil) AS n FROM lib WHERE scryfall_id IS NOT NULL) WHERE n > 1""".replace("SELECT * FROM (", "SELECT scryfall_id, foil, rank, card_id, count, created_at FROM (", 1))
def find_duplicates(spark, sf):
    return L.find_duplicates(T.library_rows(spark, sf))


@query("list_newest", H + " SELECT card_id, created_at, row_number() OVER (ORDER BY created_at DESC, ord DESC) AS place FROM held")
def list_newest(spark, sf):
    return L.list_newest(T.held_and_batch(spark, sf)[0]).select("card_id", "created_at", "place")


@query("get_card", H + " SELECT card_id, count FROM held JOIN (SELECT min(card_id) AS card_id FROM held) USING (card_id)")
def get_card(spark, sf):
    held, _ = T.held_and_batch(spark, sf)
    return held.join(held.agg(F.min("card_id").alias("card_id")), "card_id", "left_semi").select("card_id", "count")


@query("card_row_cast", H + " SELECT card_id, foil FROM lib")
def card_row_cast(spark, sf):
    stored = T.library_rows(spark, sf).select("card_id", F.col("foil").cast("int").alias("foil"))
    return stored.select("card_id", F.col("foil").cast("boolean").alias("foil"))


@query("new_card_id", H + " SELECT card_id, left(sha256(card_id), 32) AS id FROM lib")
def new_card_id(spark, sf):
    from cardloom.functions.text import new_card_id as make

    return T.library_rows(spark, sf).select("card_id", make(F.col("card_id")).alias("id"))


@query("valid_card_id", H + " SELECT card_id, regexp_full_match(card_id, '[A-Za-z0-9][A-Za-z0-9_-]{0,63}') AS ok, false AS bad FROM lib")
def valid_card_id(spark, sf):
    from cardloom.functions.text import valid_card_id as ok

    return T.library_rows(spark, sf).select("card_id", ok(F.col("card_id")).alias("ok"), ok(F.concat(F.lit(" "), F.col("card_id"))).alias("bad"))


@query("validate_update", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'name is blank' WHEN 1 THEN 'count is not from 1 to 9999' WHEN 2 THEN 'foil is not a boolean' WHEN 4 THEN 'not an object' END AS error,
  CASE WHEN event_id % 5 = 3 THEN 1 + event_id % 9 END AS count FROM events""")
def validate_update(spark, sf):
    e = F.col("event_id")
    body = (
        F.when(e % 5 == 0, F.lit('{"name": " ", "foil": true}')).when(e % 5 == 1, F.concat(F.lit('{"count": '), e + 10000, F.lit("}"))).when(e % 5 == 2, F.lit('{"foil": "yes"}'))
        .when(e % 5 == 3, F.concat(F.lit('{"count": '), 1 + e % 9, F.lit(', "scryfall_id": null}'))).otherwise(F.lit("[1]"))
    )
    rows = L.validate_updates(T.table(spark, sf, "events").select("event_id", body.alias("body")))
    return rows.select("event_id", "error", F.when(F.col("error").isNull(), F.col("count")).alias("count"))


# The file to import: batch rows as lines of a file, of which every seventh names a number that no item has.
FILE = """, lines AS (SELECT ord AS line, count, name, 'b' || (l.ord % 25) AS set_code, CASE WHEN ord % 7 = 0 THEN 'x' ELSE CAST(1 + ord % 50 AS VARCHAR) END AS collector_number, foil,
  CASE ord % 2 WHEN 0 THEN 'en' ELSE 'ja' END AS lang, created_at AS modified_at FROM batch l)"""
MATCH = FILE + ", " + T.CATALOG_SQL + """, m AS (SELECT * FROM (SELECT l.*, c.scryfall_id AS sid, c.name AS catalog_name,
  row_number() OVER (PARTITION BY l.line ORDER BY (c.lang IS NOT NULL AND c.lang = l.lang) DESC, (coalesce(c.lang, 'en') = 'en') DESC, c.pos) AS rn FROM lines l
  LEFT JOIN cat c ON lower(c.set_code) = lower(l.set_code) AND lower(c.collector_number) = lower(l.collector_number)) WHERE rn = 1)"""


def _lines(batch):
    o = F.col("ord")
    return batch.select(
        o.alias("line"), "count", "name", F.concat(F.lit("b"), o % 25).alias("set_code"), F.when(o % 7 == 0, "x").otherwise((1 + o % 50).cast("string")).alias("collector_number"), "foil",
        F.when(o % 2 == 0, "en").otherwise("ja").alias("lang"), F.col("created_at").alias("modified_at"),
    )


@query("match_import", H + MATCH + " SELECT line, sid AS scryfall_id, catalog_name FROM m")
def match_import(spark, sf):
    return I.match_import(_lines(T.held_and_batch(spark, sf)[1]), T.catalog(spark, sf)).select("line", "scryfall_id", "catalog_name")


COLLECT = """, c AS (SELECT sid, coalesce(sid || '|' || foil, lower(name) || '|' || set_code || '|' || collector_number || '|' || foil) AS key, foil, sum(count) AS count, max(modified_at) AS modified_at,
  min(line) AS line FROM m GROUP BY ALL)"""


@query("collect_import", H + MATCH + COLLECT + " SELECT sid AS scryfall_id, foil, line AS ord, CAST(count AS BIGINT) AS count, modified_at AS created_at FROM c")
def collect_import(spark, sf):
    return I.collect_import(I.match_import(_lines(T.held_and_batch(spark, sf)[1]), T.catalog(spark, sf))).select("scryfall_id", "foil", "ord", "count", "created_at")


@query("distinct_unmatched", H + MATCH + " SELECT name, min(line) AS line FROM m WHERE sid IS NULL GROUP BY name")
def distinct_unmatched(spark, sf):
    return I.distinct_unmatched(I.match_import(_lines(T.held_and_batch(spark, sf)[1]), T.catalog(spark, sf)))


@query("import_report", H + MATCH + COLLECT + """, k AS (SELECT c.*, CASE WHEN sid IS NULL THEN false ELSE EXISTS (SELECT 1 FROM held h WHERE h.scryfall_id = c.sid AND h.foil = c.foil) END AS there FROM c)
SELECT (SELECT count(*) FROM m) AS rows, (SELECT count(*) FROM m WHERE sid IS NULL) AS unmatched, (SELECT count(*) FROM k WHERE NOT there) AS added, (SELECT count(*) FROM k WHERE there) AS updated,
  (SELECT list(name ORDER BY line) FROM (SELECT name, min(line) AS line FROM m WHERE sid IS NULL GROUP BY name ORDER BY line LIMIT 50)) AS unmatched_names""")
def import_report(spark, sf):
    held, batch = T.held_and_batch(spark, sf)
    return I.import_report(held, _lines(batch), T.catalog(spark, sf))


@query("upsert_placeholders", H + """ SELECT card_id, count + CASE WHEN scryfall_id IS NULL AND rn = 1 THEN 5 ELSE 0 END AS count FROM (SELECT *, row_number() OVER (PARTITION BY scryfall_id, name, set_code, collector_number, foil ORDER BY created_at, ord) AS rn FROM held)""")
def upsert_placeholders(spark, sf):
    """Five more of each held row without an item, by name."""
    held, _ = T.held_and_batch(spark, sf)
    names = ["name", "set_code", "collector_number", "foil"]
    cards = held.filter("scryfall_id is null").select(*names).distinct()
    cards = cards.select(*[{"card_id": F.lit("new"), "count": F.lit(5).cast("long"), "ord": F.lit(0).cast("long"), "created_at": later(), "updated_at": later()}.get(c, F.col(c) if c in names else F.lit(None).cast("string")).alias(c) for c in L.FIELDS])
    return I.upsert_placeholders(held, cards, "add").select("card_id", "count")


@query("import_collection", H + MATCH + COLLECT + """ SELECT scryfall_id, foil, CAST(sum(count) AS BIGINT) AS count FROM (
  SELECT coalesce(h.scryfall_id, c.sid) AS scryfall_id, coalesce(h.foil, c.foil) AS foil, coalesce(c.count, h.count) AS count FROM (SELECT * FROM held WHERE scryfall_id IS NOT NULL) h
  FULL JOIN (SELECT * FROM c WHERE sid IS NOT NULL) c ON c.sid = h.scryfall_id AND c.foil = h.foil
  UNION ALL SELECT scryfall_id, foil, count FROM held WHERE scryfall_id IS NULL UNION ALL SELECT sid, foil, count FROM c WHERE sid IS NULL) GROUP BY scryfall_id, foil""")
def import_collection(spark, sf):
    held, batch = T.held_and_batch(spark, sf)
    out = I.import_collection(held, _lines(batch), T.catalog(spark, sf), "set")
    return out.groupBy("scryfall_id", "foil").agg(F.sum("count").alias("count"))


@query("import_snapshot", SQL["import_collection"])
def import_snapshot(spark, sf):
    """The same import between two snapshots of a stored collection."""
    held, batch = T.held_and_batch(spark, sf)
    path = new_path(spark, "collection")
    write_snapshot(held, path, None)
    passing(spark, path)
    I.import_snapshot(spark, path, _lines(batch), T.catalog(spark, sf), "set")
    return read_snapshot(spark, path).groupBy("scryfall_id", "foil").agg(F.sum("count").alias("count"))
