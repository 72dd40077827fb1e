"""One query per operator over the driver's tables, each over the whole of its table, with its SQL equivalent.

Orders are a collection (tenant: customer, address: order key); events are the log of a keyed type (tenant: user, key:
event type; a removal where event_id is divisible by 7, else a save); parts have a fuzzy index on their name; suppliers,
nations and regions are nested collections. Where a result has an order, its place comes as pos.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.errors import Conflict, PivotMissing
from chronolith.functions import Fold, ids, normalize
from chronolith.model import FuzzyIndex, RecordType, Shape
from chronolith.operators import extensions, fuzzy, idsets, reads
from chronolith.operators.bounds import Exact, Prefix, Range
from chronolith.operators.collection import Collection, Session, UniqueRecord
from chronolith.plans import views
from chronolith.registry import Context, Registry
from chronolith.sources import LogStore
from chronolith.streaming import Watch, watch_collection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CURSOR = 9000


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A living view; instants in nanoseconds."""
    return _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("tenant"), F.lit(0).cast("long").alias("pivot"), F.col("o_orderkey").alias("rec"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)") * 1000).alias("instant"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(V, R) of events."""
    log = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tenant"), F.lit(0).cast("long").alias("pivot"), F.col("event_type").alias("rec"), (F.col("event_id") + 1).alias("instant"),
        F.round(F.col("value") * 100).cast("long").alias("cents"), (F.col("event_id") % 7 == 0).alias("is_remove"),
    )
    versions, removals = views.from_operations(log, F.col("is_remove"))
    return versions.drop("is_remove"), removals


_ORDERS = """orders_c AS (SELECT o_custkey AS tenant, o_orderkey AS rec, epoch_us(o_orderdate) * 1000 AS instant, o_orderstatus AS status, o_orderpriority AS priority,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""
_LOG = """log AS (SELECT user_id AS tenant, event_type AS rec, event_id + 1 AS instant, CAST(round(value * 100) AS BIGINT) AS cents, event_id % 7 = 0 AS gone,
    lag(event_id % 7 = 0) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM events),
v AS (SELECT tenant, rec, instant, cents, coalesce(before, true) AS enters FROM log WHERE NOT gone),
r AS (SELECT tenant, rec, instant FROM log WHERE gone AND NOT before),
state AS (SELECT tenant, rec, max(instant) AS instant, arg_max(cents, instant) AS cents, max(instant) FILTER (WHERE enters) AS entered FROM v GROUP BY ALL),
dead AS (SELECT tenant, rec, max(instant) AS gone FROM r GROUP BY ALL),
latest AS (SELECT tenant, rec, instant, cents, entered > coalesce(gone, -1) AS alive FROM state LEFT JOIN dead USING (tenant, rec)),
living AS (SELECT tenant, rec, instant, cents FROM latest WHERE alive)"""


# Reads


@_query(f"WITH {_ORDERS} SELECT tenant, rec, instant, status, cents FROM orders_c WHERE tenant = 7 AND rec IN (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7)")
def get_record(spark, sf_dir):
    """A record by its address: the filter reaches the scan."""
    mine = _orders(spark, sf_dir).where("tenant = 7")
    rec = mine.agg(F.min("rec")).first()[0]
    return reads.get(mine, F.col("rec") == F.lit(rec)).select("tenant", "rec", "instant", "status", "cents")


@_query("SELECT user_id AS tenant, max(event_id) + 1 AS instant, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def get_unique(spark, sf_dir):
    """The last version of each tenant's unique record."""
    versions = _table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), (F.col("event_id") + 1).alias("instant"), "event_type")
    return views.unique_latest(versions).select("tenant", "instant", "event_type")


@_query(f"WITH {_LOG}, ids AS (SELECT DISTINCT user_id AS tenant, 'click' AS rec FROM events UNION ALL SELECT -1, 'click') SELECT tenant, rec, CASE WHEN alive IS NULL THEN 'vacant' WHEN alive THEN 'living' ELSE 'dead' END AS state FROM ids LEFT JOIN latest USING (tenant, rec)")
def classify_anchors(spark, sf_dir):
    """Whether addresses are vacant, living or dead."""
    ids = _table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant")).distinct().union(spark.range(1).select(F.lit(-1).cast("long"))).withColumn("rec", F.lit("click"))
    return reads.anchors(ids, views.latest(*_log(spark, sf_dir)), ["tenant", "rec"])


@_query(f"WITH {_LOG} SELECT tenant, rec, instant, cents, row_number() OVER (PARTITION BY tenant ORDER BY instant DESC, rec DESC) AS pos FROM living")
def all_recency(spark, sf_dir):
    """All living records, most recently written first."""
    return views.recency(views.living(*_log(spark, sf_dir))).select("tenant", "rec", "instant", "cents", "pos")


@_query(f"WITH {_ORDERS} SELECT tenant, rec, instant, cents, row_number() OVER (PARTITION BY tenant ORDER BY instant DESC, rec DESC) AS pos FROM orders_c")
def all_recency_orders(spark, sf_dir):
    return views.recency(_orders(spark, sf_dir)).select("tenant", "rec", "instant", "cents", "pos")


@_query(f"WITH {_ORDERS} SELECT tenant, rec, status, row_number() OVER (PARTITION BY tenant ORDER BY status, rec) AS pos FROM orders_c WHERE status = 'F'")
def by_exact(spark, sf_dir):
    return reads.search_by(_orders(spark, sf_dir), ("status",), Exact(("F",))).select("tenant", "rec", "status", "pos")


@_query(f"WITH {_ORDERS} SELECT tenant, rec, status, priority, row_number() OVER (PARTITION BY tenant ORDER BY status, priority, rec) AS pos FROM orders_c WHERE status = 'O' AND priority = '1-URGENT'")
def by_exact_composite(spark, sf_dir):
    return reads.search_by(_orders(spark, sf_dir), ("status", "priority"), Exact(("O", "1-URGENT"))).select("tenant", "rec", "status", "priority", "pos")


@_query(f"WITH {_ORDERS} SELECT tenant, rec, row_number() OVER (PARTITION BY tenant ORDER BY rec) AS pos FROM orders_c WHERE rec >= 1000 AND rec < 5000")
def by_range(spark, sf_dir):
    return reads.search_by(_orders(spark, sf_dir), ("rec",), Range((1000,), (5000,))).select("tenant", "rec", "pos")


@_query(f"WITH {_ORDERS} SELECT tenant, rec, status, priority FROM orders_c WHERE (status > 'F' OR (status = 'F' AND priority >= '3')) AND (status < 'O' OR (status = 'O' AND priority < '2'))")
def by_range_composite(spark, sf_dir):
    return reads.search_by(_orders(spark, sf_dir), ("status", "priority"), Range(("F", "3"), ("O", "2"))).select("tenant", "rec", "status", "priority")


@_query("SELECT p_partkey AS rec, p_name AS name, row_number() OVER (ORDER BY p_name, p_partkey) AS pos FROM part WHERE p_name LIKE 'red%'")
def by_prefix_string(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select(F.lit(0).alias("tenant"), F.col("p_partkey").alias("rec"), F.col("p_name").alias("name"))
    # One collection: places come from counts by range, not from a window over all of it.
    found = reads.StoredList.write(parts.where(Prefix(("red",)).predicate(("name",))), ("name",), f"{_scratch(spark)}/list")
    return found.all().select("rec", "name", (F.col("pos") + 1).alias("pos"))


@_query(f"WITH {_ORDERS} SELECT tenant, rec, priority, row_number() OVER (PARTITION BY tenant ORDER BY status, priority, rec) AS pos FROM orders_c WHERE status = 'P'")
def by_prefix_leading(spark, sf_dir):
    return reads.search_by(_orders(spark, sf_dir), ("status", "priority"), Prefix(("P",))).select("tenant", "rec", "priority", "pos")


@_query("SELECT o_orderkey AS rec FROM orders WHERE o_orderkey >= 256 AND o_orderkey < 512")
def by_prefix_integer(spark, sf_dir):
    """Orders whose key, as an unsigned 32-bit number, begins with the bytes 00 00 01."""
    return reads.search_by(_orders(spark, sf_dir), ("rec",), Prefix((b"\x00\x00\x01",), bits=32)).select("rec")


@_query(f"WITH {_ORDERS} SELECT tenant, rec, priority, row_number() OVER (PARTITION BY tenant ORDER BY priority, rec) AS pos FROM orders_c")
def listed(spark, sf_dir):
    return reads.search_by(_orders(spark, sf_dir), ("priority",)).select("tenant", "rec", "priority", "pos")


@_query(f"WITH {_ORDERS} SELECT rec, priority FROM orders_c ORDER BY priority, rec LIMIT 25 OFFSET 200")
def listed_page(spark, sf_dir):
    return reads.listed(_orders(spark, sf_dir), ("priority",), offset=200, limit=25).select("rec", "priority")


@_query(f"WITH {_ORDERS} SELECT rec, priority FROM orders_c ORDER BY priority, rec OFFSET 1000")
def listed_at_page(spark, sf_dir):
    """From page 40 of 25 on, to the end."""
    return reads.listed_at_page(_orders(spark, sf_dir), ("priority",), 40, 25, f"{_scratch(spark)}/list").select("rec", "priority")


@_query(f"WITH {_ORDERS} SELECT rec, priority, 999 + row_number() OVER (ORDER BY priority, rec) AS pos FROM (SELECT * FROM orders_c ORDER BY priority, rec LIMIT 25 OFFSET 1000)")
def stored_list_page(spark, sf_dir):
    """A deep page of a stored list: only the row groups that hold it are read."""
    path = f"{_scratch(spark)}/list"
    return reads.StoredList.write(_orders(spark, sf_dir), ("priority",), path).page(1000, 25).select("rec", "priority", "pos")


@_query("SELECT o_custkey AS tenant, count(*) AS len FROM orders GROUP BY o_custkey")
def list_len(spark, sf_dir):
    return reads.list_len(_orders(spark, sf_dir))


# Versions and changes


@_query(f"WITH {_LOG} SELECT tenant, rec, instant, lag(instant) OVER w AS previous, lead(instant) OVER w AS next, row_number() OVER (PARTITION BY tenant, rec ORDER BY instant DESC) AS ver FROM v WINDOW w AS (PARTITION BY tenant, rec ORDER BY instant)")
def history(spark, sf_dir):
    return views.history(_log(spark, sf_dir)[0]).select("tenant", "rec", "instant", "previous", "next", "ver")


@_query("SELECT conv_id AS tenant, turn AS instant, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS ver FROM conversations")
def history_unique(spark, sf_dir):
    versions = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tenant"), F.col("turn").alias("instant"), "role")
    return views.history(versions, ("tenant",)).select("tenant", "instant", "role", "ver")


_CHANGES = f"""WITH {_LOG} SELECT tenant, rec, instant, cents, 'saved' AS event FROM living WHERE instant > {CURSOR}
UNION ALL SELECT tenant, rec, instant, NULL, 'removed' FROM r WHERE instant > {CURSOR}"""


@_query(_CHANGES)
def changes_collection(spark, sf_dir):
    return views.changes(*_log(spark, sf_dir), CURSOR).select("tenant", "rec", "instant", "cents", "event")


@_query("""WITH u AS (SELECT user_id AS tenant, event_id + 1 AS instant FROM events), live AS (SELECT tenant, max(instant) AS live, min(instant) AS first FROM u GROUP BY tenant),
c AS (SELECT tenant, first AS cursor FROM live UNION ALL SELECT tenant, 0 FROM live UNION ALL SELECT tenant, live FROM live UNION ALL SELECT tenant, live + 5 FROM live)
SELECT tenant, cursor, instant, live AS new_cursor FROM c JOIN u USING (tenant) JOIN live USING (tenant)
WHERE cursor < live AND instant > cursor AND (cursor = first OR instant = live)""")
def changes_unique(spark, sf_dir):
    """From a known cursor all versions missed, from an unknown one the live version, from the live one or later nothing."""
    versions = _table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), (F.col("event_id") + 1).alias("instant"))
    ends = versions.groupBy("tenant").agg(F.min("instant").alias("a"), F.max("instant").alias("b"))
    cursors = ends.select("tenant", F.explode(F.array("a", F.lit(0).cast("long"), "b", F.col("b") + 5)).alias("cursor"))
    return views.unique_changes(versions, cursors).select("tenant", "cursor", "instant", "new_cursor")


@_query(f"WITH {_LOG} SELECT tenant, max(instant) AS cursor FROM (SELECT tenant, instant FROM living UNION ALL SELECT tenant, instant FROM r) GROUP BY tenant")
def changes_register(spark, sf_dir):
    return views.tail(*_log(spark, sf_dir)).select("tenant", "cursor")


@_query(f"WITH {_LOG} SELECT tenant, rec, instant FROM r")
def removals(spark, sf_dir):
    return _log(spark, sf_dir)[1].select("tenant", "rec", "instant")


@_query(f"WITH {_LOG} SELECT tenant, rec, entered, count(*) AS revivals FROM (SELECT v.tenant, v.rec, v.instant, max(v.instant) OVER (PARTITION BY v.tenant, v.rec) AS entered FROM v WHERE enters AND EXISTS (SELECT 1 FROM r WHERE r.tenant = v.tenant AND r.rec = v.rec AND r.instant < v.instant)) GROUP BY ALL")
def revive(spark, sf_dir):
    """Keys that a save brought back, how often and when last."""
    versions, gone = _log(spark, sf_dir)
    first = gone.groupBy(*views.ANCHOR).agg(F.min("instant").alias("first_gone"))
    back = versions.where("enters").join(first, list(views.ANCHOR)).where("instant > first_gone")
    return back.groupBy("tenant", "rec").agg(F.max("instant").alias("entered"), F.count("*").alias("revivals"))


@_query(f"WITH {_LOG} SELECT tenant, rec, instant, cents FROM latest WHERE NOT alive")
def dead_get(spark, sf_dir):
    """Removed records are still found by address."""
    return reads.get(views.latest(*_log(spark, sf_dir)), F.col("removed")).select("tenant", "rec", "instant", "cents")


# Id sets


def _two_lookups(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    left = orders.where(Exact(("F",)).predicate(("status",))).select(F.col("rec").alias("id"))
    right = orders.where(Exact(("1-URGENT",)).predicate(("priority",))).select(F.col("rec").alias("id"))
    return left, right


@_query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def ids_intersect(spark, sf_dir):
    return idsets.intersect(*_two_lookups(spark, sf_dir))


@_query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'")
def ids_except(spark, sf_dir):
    return idsets.except_(*_two_lookups(spark, sf_dir))


@_query("SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def ids_union(spark, sf_dir):
    return idsets.union(*_two_lookups(spark, sf_dir))


# Fuzzy search

_TEXT = "blue ren"
_GRAMS = """list_distinct(list_transform(range(1, length({0}) + 3), lambda i: substring(chr(65535) || chr(65535) || {0} || chr(65535) || chr(65535), i, 3)))"""
_FUZZY = f"""q AS (SELECT '{_TEXT}' AS t, {_GRAMS.format(f"'{_TEXT}'")} AS g),
p AS (SELECT p_partkey AS rec, p_name AS name, {_GRAMS.format("lower(p_name)")} AS g FROM part),
s AS (SELECT rec, name, len(list_intersect(p.g, q.g)) AS shared, len(p.g) AS np, len(q.g) AS nq, levenshtein(lower(name), q.t) AS d, abs(length(name) - length(q.t)) AS gap FROM p, q)"""


def _parts(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("tenant"), F.lit(0).cast("long").alias("pivot"), F.col("p_partkey").alias("rec"), F.col("p_name").alias("name"))


@_query(f"WITH {_FUZZY} SELECT rec, name, shared / (np + nq - shared) AS score FROM s WHERE shared >= ceil(0.3 * nq) AND shared / (np + nq - shared) >= 0.3")
def fuzzy_similarity(spark, sf_dir):
    return fuzzy.search(_parts(spark, sf_dir), "name", _TEXT, fuzzy.Similarity(0.3)).select("rec", "name", "score")


@_query(f"WITH {_FUZZY} SELECT rec, name, shared / nq AS score FROM s WHERE shared >= ceil(0.4 * nq) AND shared / nq >= 0.4")
def fuzzy_contains(spark, sf_dir):
    return fuzzy.search(_parts(spark, sf_dir), "name", _TEXT, fuzzy.Contains(0.4)).select("rec", "name", "score")


@_query(f"WITH {_FUZZY} SELECT rec, name, CAST(d AS DOUBLE) AS score FROM s WHERE shared >= greatest(nq - 9, 1) AND gap <= 3 AND d <= 3")
def fuzzy_distance(spark, sf_dir):
    return fuzzy.search(_parts(spark, sf_dir), "name", _TEXT, fuzzy.Distance(3)).select("rec", "name", "score")


@_query(f"WITH {_FUZZY} SELECT rec, name, shared / (np + nq - shared) AS score, row_number() OVER (ORDER BY 1 - shared / (np + nq - shared), rec) AS pos FROM s WHERE shared >= ceil(0.2 * nq) AND shared / (np + nq - shared) >= 0.2 QUALIFY pos <= 10")
def fuzzy_topk(spark, sf_dir):
    """The ten best, from postings."""
    parts = _parts(spark, sf_dir)
    found = fuzzy.search_postings(fuzzy.postings(parts, "name"), parts, "name", _TEXT, fuzzy.Similarity(0.2), limit=10)
    return found.withColumn("pos", F.row_number().over(Window.orderBy("rank", "rec")).cast("long")).select("rec", "name", "score", "pos")


@_query(f"SELECT gram, count(*) AS n FROM (SELECT unnest({_GRAMS.format('lower(p_name)')}) AS gram FROM part) GROUP BY gram")
def fuzzy_postings(spark, sf_dir):
    return fuzzy.postings(_parts(spark, sf_dir), "name").groupBy("gram").agg(F.count("*").alias("n"))


@_query("""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS n FROM documents)
SELECT doc_id, replace(replace(replace(replace(replace(translate(n, 'àáâãäåçèéêëìíîïðñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiidnoooooouuuuyy'), 'æ', 'ae'), 'þ', 'th'), 'ß', 'ss'), 'ĳ', 'ij'), 'œ', 'oe') AS normal FROM t""")
def normalized(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text"), Fold.LATIN).alias("normal"))


# Functions, watches, mirrors


@_query("SELECT o_orderkey AS rec, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_custkey = 7 AND round(o_totalprice * 100) > 10000000")
def server_fn(spark, sf_dir):
    """A registered function that filters its caller's collection."""
    registry = Registry()

    def orders_over(context: Context, least: int) -> DataFrame:
        mine = _orders(context.spark, sf_dir).where(F.col("tenant") == context.session.tenant)
        return mine.where(F.col("cents") > least).select("rec", "cents")

    registry.expose_function(orders_over)
    return registry.call("orders_over", Context(spark, Session(7)), least=10_000_000)


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; only where that is unset, on one machine, a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/chronolith-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="chronolith-")


EVENT = RecordType("event", Shape.NON_UNIQUE, T.StructType([T.StructField("cents", T.LongType())]))
SUPPLIER = RecordType("supplier", Shape.NON_UNIQUE, T.StructType([T.StructField("name", T.StringType()), T.StructField("nation", T.IntegerType())]), pivots=(("nation",), ("nation", "name")), lists=(("name",),))
NATION = RecordType("nation", Shape.NON_UNIQUE, T.StructType([T.StructField("name", T.StringType()), T.StructField("region", T.IntegerType())]), key=("name",))
PART = RecordType("part", Shape.NON_UNIQUE, T.StructType([T.StructField("part", T.LongType()), T.StructField("name", T.StringType())]), fuzzy=(FuzzyIndex("name"),))
TURN = RecordType("turn", Shape.UNIQUE, T.StructType([T.StructField("role", T.StringType())]))


def _store(spark: SparkSession, kind: RecordType) -> LogStore:
    return LogStore(spark, f"{_scratch(spark)}/{kind.name}", kind.body, kind.fuzzy, kind.name)


def _as_log(frame: DataFrame, *body: str) -> DataFrame:
    """Rows of tenant, pivot, rec, instant, enters and a body as a store holds versions."""
    none = F.lit(None)
    meta = [F.lit(False).alias("removed"), none.cast("long").alias("author"), F.col("instant").alias("device_created"), none.cast("string").alias("permission")]
    return frame.select("tenant", "pivot", F.col("rec").cast("string").alias("rec"), "instant", "enters", *meta, *body)


@_query(f"""WITH {_LOG} SELECT tenant, rec, instant, 'saved' AS event FROM v WHERE instant > {CURSOR} UNION ALL SELECT tenant, rec, instant, 'removed' FROM r WHERE instant > {CURSOR}""")
def watch_catchup(spark, sf_dir):
    """A watch over a log of several commits, stopped and started again, past a compaction and a batch that was refused: every event after the cursor, once."""
    store = _store(spark, EVENT)
    versions, gone = _log(spark, sf_dir)
    versions = _as_log(versions, "cents")
    watch = Watch(store, f"{_scratch(spark)}/watch", since=CURSOR)
    last = 0
    for upto in (CURSOR - 500, CURSOR + 400, 1 << 62):
        part = (F.col("instant") > last) & (F.col("instant") <= upto)
        store.apply(versions.where(part), gone.where(part))
        try:
            store.apply(versions.where(part), base=0)
        except Conflict:
            pass
        if last:
            watch.catch_up()
            store.compact()
        last = upto
    return watch.catch_up().select("tenant", "rec", "instant", "event")


@_query("SELECT s_suppkey AS rec, s_name AS name FROM supplier")
def adopt_mirror(spark, sf_dir):
    """A mirror that adopts another node's versions twice, a third of them beforehand, holds each once."""
    source = _table(spark, sf_dir, "supplier").select(F.lit(1).cast("long").alias("tenant"), F.lit(0).cast("long").alias("pivot"), F.col("s_suppkey").alias("rec"), F.col("s_suppkey").alias("instant"), F.lit(True).alias("enters"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    foreign, mirror = _as_log(source, "name", "nation"), Collection(SUPPLIER, _store(spark, SUPPLIER), Session(1))
    for part in (foreign.where("rec % 3 = 0"), foreign, foreign):
        mirror.adopt(part)
    return mirror.versions().select(F.col("rec").cast("long").alias("rec"), "name")


# Writes, each through a store


def _suppliers(spark, sf_dir) -> Collection:
    """Suppliers, inserted in one commit."""
    found = Collection(SUPPLIER, _store(spark, SUPPLIER), Session(1, user=9))
    found.insert_all(_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    return found


def _rec_of(suppliers: Collection, name: str) -> str:
    return suppliers.living().where(F.col("name") == name).first()["rec"]


@_query("SELECT s_name AS name, s_nationkey AS nation, true AS gapless, CAST(9 AS BIGINT) AS author FROM supplier")
def store_insert_all(spark, sf_dir):
    """A batch of inserts: one commit, instants without gaps."""
    suppliers = _suppliers(spark, sf_dir)
    ends = suppliers.living().agg(F.max("instant").alias("high"), F.min("instant").alias("low"), F.count_distinct("instant").alias("n")).first()
    return suppliers.all().select("name", "nation", F.lit(ends["high"] - ends["low"] + 1 == ends["n"]).alias("gapless"), "author")


@_query("SELECT s_name AS name, CASE WHEN s_nationkey < 10 THEN s_nationkey + 100 ELSE s_nationkey END AS nation, CASE WHEN s_nationkey < 10 THEN 2 ELSE 1 END::BIGINT AS versions FROM supplier")
def store_save_all(spark, sf_dir):
    """A batch of saves chains a version to each record."""
    suppliers = _suppliers(spark, sf_dir)
    suppliers.save_all(suppliers.living().where("nation < 10").select("rec", "name", (F.col("nation") + 100).alias("nation")))
    count = suppliers.versions().groupBy("rec").agg(F.count("*").alias("versions"))
    return suppliers.living().join(count, "rec").select("name", "nation", "versions")


_TWO = "(SELECT s_name FROM supplier ORDER BY s_suppkey LIMIT 2)"


@_query(f"SELECT s_name AS name, s_name IN {_TWO} AS removed, CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier) THEN -1 ELSE s_nationkey END AS nation FROM supplier")
def store_remove(spark, sf_dir):
    """Removed records are found by address; a save while dead gives a version and does not revive."""
    suppliers = _suppliers(spark, sf_dir)
    first, second = (r["s_name"] for r in _table(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(2).collect())
    recs = [_rec_of(suppliers, name) for name in (first, second)]
    for rec in recs:
        suppliers.remove(rec)
    suppliers.save(recs[0], name=first, nation=-1)
    return suppliers.latest().select("name", "removed", "nation")


@_query("SELECT n_name AS name, CASE WHEN n_regionkey = 1 THEN 51 ELSE n_regionkey END AS region, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END::BIGINT AS versions FROM nation")
def store_upsert(spark, sf_dir):
    """Inserting a key again saves to its record."""
    nations = Collection(NATION, _store(spark, NATION), Session(1))
    rows = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    nations.insert_all(rows)
    nations.insert_all(rows.where("region = 1").withColumn("region", F.col("region") + 50))
    count = nations.versions().groupBy("rec").agg(F.count("*").alias("versions"))
    return nations.living().join(count, "rec").select("name", "region", "versions")


@_query("WITH n AS (SELECT min(n_name) AS name FROM nation) SELECT name, event, region FROM n, (VALUES ('removed', NULL), ('saved', 77)) e(event, region)")
def store_revive(spark, sf_dir):
    """A removed keyed record that is inserted again, as the changes since tell it."""
    nations = Collection(NATION, _store(spark, NATION), Session(1))
    nations.insert_all(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    _, cursor = nations.changes()
    name = _table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    rec = nations.living().where(F.col("name") == name).first()["rec"]
    nations.remove(rec)
    assert nations.insert(name=name, region=77) == rec
    return nations.changes(cursor)[0].select(F.get_json_object("rec", "$[0]").alias("name"), "event", "region")


@_query("SELECT role, turn AS author, CAST(row_number() OVER (ORDER BY turn DESC) AS BIGINT) AS ver FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def store_unique(spark, sf_dir):
    """A unique record saved turn by turn by different authors, and its history."""
    conv = _table(spark, sf_dir, "conversations")
    turns = conv.where(F.col("conv_id") == conv.agg(F.min("conv_id")).first()[0]).orderBy("turn").select("turn", "role").collect()
    record = UniqueRecord(TURN, _store(spark, TURN), Session(1))
    for t in turns:
        record.save_as(t["turn"], role=t["role"])
    return record.history().select("role", "author", "ver")


@_query("SELECT 'conflict' AS outcome, count(*) AS living, CAST(1 AS BIGINT) AS commits FROM supplier")
def store_conflict(spark, sf_dir):
    """Of two batches planned on one commit the second is refused whole."""
    suppliers = _suppliers(spark, sf_dir)
    row = suppliers._frame([suppliers._row("late", 1 << 62, True, {"name": "late", "nation": 1})])
    try:
        suppliers.store.apply(row, base=0)
        outcome = "written"
    except Conflict:
        outcome = "conflict"
    return suppliers.living().agg(F.count("*").alias("living")).select(F.lit(outcome).alias("outcome"), "living", F.lit(len(suppliers.store.commits())).cast("long").alias("commits"))


@_query(f"SELECT s_name AS name, s_nationkey AS nation FROM supplier WHERE s_name NOT IN {_TWO}")
def store_adopt(spark, sf_dir):
    """A mirror of another node's log, removals included, holds what lives there, however often it adopts."""
    source = _suppliers(spark, sf_dir)
    for r in _table(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(2).collect():
        source.remove(_rec_of(source, r["s_name"]))
    mirror = Collection(SUPPLIER, _store(spark, SUPPLIER), Session(1))
    for _ in range(2):
        mirror.adopt(source.versions(), source.removals())
    return mirror.living().select("name", "nation")


@_query("SELECT s_name AS name, CASE WHEN s_nationkey < 5 THEN -1 ELSE s_nationkey END AS nation FROM supplier")
def store_adopt_records(spark, sf_dir):
    """Living records without metadata, adopted twice and then with changes: new, unchanged and changed ones."""
    mirror = Collection(SUPPLIER, _store(spark, SUPPLIER), Session(1))
    rows = _table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 20, "0").alias("rec"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    for part in (rows, rows, rows.withColumn("nation", F.when(F.col("nation") < 5, -1).otherwise(F.col("nation")))):
        mirror.adopt_records(part)
    return mirror.living().select("name", "nation")


@_query(f"SELECT s_name AS name, s_nationkey AS nation, CAST(1 AS BIGINT) AS commits FROM supplier WHERE s_name NOT IN {_TWO}")
def store_compact(spark, sf_dir):
    """A compaction leaves one commit and every record."""
    suppliers = _suppliers(spark, sf_dir)
    for r in _table(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(2).collect():
        suppliers.remove(_rec_of(suppliers, r["s_name"]))
    suppliers.store.compact()
    suppliers.store.vacuum(0)
    return suppliers.living().select("name", "nation", F.lit(len(suppliers.store.commits())).cast("long").alias("commits"))


@_query("SELECT r_name AS region, n_name AS nation, true AS refused FROM region JOIN nation ON n_regionkey = r_regionkey")
def store_pivots(spark, sf_dir):
    """A collection of nations for each region, made and filled; one that was not made is refused."""
    store, made = _store(spark, SUPPLIER), []
    nations = _table(spark, sf_dir, "nation")
    for r in _table(spark, sf_dir, "region").collect():
        child = Collection.create(SUPPLIER, store, Session(1))
        child.insert_all(nations.where(F.col("n_regionkey") == r["r_regionkey"]).select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("nation")))
        made.append((child.pivot, r["r_name"]))
    try:
        Collection(SUPPLIER, store, Session(1), pivot=5).all()
        refused = False
    except PivotMissing:
        refused = True
    owners = spark.createDataFrame(made, "pivot long, region string")
    return extensions.children(owners, views.living(store.versions().drop("removed"), store.removals()), ["pivot"]).select("region", F.col("name").alias("nation"), F.lit(refused).alias("refused"))


@_query("SELECT s_name AS name FROM supplier ORDER BY s_name LIMIT 30 OFFSET 40")
def store_list_page(spark, sf_dir):
    """A page from the list that is kept for the last commit."""
    suppliers = _suppliers(spark, sf_dir)
    suppliers.listed_at_page(2, 20).count()
    return suppliers.stored_list().page(40, 30).select("name")


@_query(f"WITH {_FUZZY} SELECT rec AS part, name, shared / (np + nq - shared) AS score FROM s WHERE shared >= ceil(0.3 * nq) AND shared / (np + nq - shared) >= 0.3 AND rec % 5 <> 0")
def store_fuzzy(spark, sf_dir):
    """A search through the postings that are kept with the log, after saves that changed a fifth of the names."""
    parts = Collection(PART, _store(spark, PART), Session(1))
    parts.insert_all(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name")))
    parts.save_all(parts.living().where("part % 5 = 0").select("rec", "part", F.lit("zzzz").alias("name")))
    parts.store.compact()
    return parts.fuzzy_search(_TEXT, fuzzy.Similarity(0.3)).select("part", "name", "score")


@_query(f"SELECT CASE WHEN s_name IN {_TWO} THEN NULL ELSE s_name END AS name, CASE WHEN s_name IN {_TWO} THEN 'removed' ELSE 'saved' END AS event FROM supplier UNION ALL SELECT s_name, 'saved' FROM supplier WHERE s_name IN {_TWO}")
def store_watch(spark, sf_dir):
    """A watch of one collection that mirrors what it tells before it tells it."""
    suppliers = _suppliers(spark, sf_dir)
    mirror = Collection(SUPPLIER, _store(spark, SUPPLIER), Session(1))
    watch = watch_collection(suppliers.store, f"{_scratch(spark)}/watch", Session(1), mirror=mirror.adopt)
    watch.catch_up()
    for r in _table(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(2).collect():
        suppliers.remove(_rec_of(suppliers, r["s_name"]))
    told = watch.catch_up()
    assert mirror.living().count() == suppliers.living().count()
    return told.select("name", "event")


@_query("SELECT s_name AS name, s_nationkey AS nation, CAST(1 AS BIGINT) AS tenant, CAST(9 AS BIGINT) AS author FROM supplier")
def store_triples(spark, sf_dir):
    """Whole records as they go over a wire: id, metadata and body."""
    return _suppliers(spark, sf_dir).triples().select("body.name", "body.nation", "id.tenant", "metadata.author")


@_query("SELECT max(struct_pack(nation := s_nationkey, name := s_name)).nation AS nation, max(struct_pack(nation := s_nationkey, name := s_name)).name AS name, true AS there, false AS gone, CAST(0 AS BIGINT) AS later FROM supplier")
def store_lookups(spark, sf_dir):
    """The greatest key of an index, membership, and records written in a span of time."""
    suppliers = _suppliers(spark, sf_dir)
    top = suppliers.greatest(1)
    there = {r["rec"]: r["living"] for r in suppliers.contains(top["rec"], "nobody").collect()}
    later = suppliers.created_between(top["instant"] + (1 << 50), 1 << 62)
    return later.agg(F.count("*").alias("later")).select(F.lit(top["nation"]).alias("nation"), F.lit(top["name"]).alias("name"), F.lit(there[top["rec"]]).alias("there"), F.lit(there["nobody"]).alias("gone"), "later")


@_query("SELECT s_name AS name, s_nationkey AS nation FROM supplier WHERE s_nationkey = 3 OR s_nationkey = 4")
def registry_perform(spark, sf_dir):
    """Operations by way of a registry: an insert, an overridden read, and a table function that streams frames."""
    registry, suppliers = Registry(), Collection(SUPPLIER, _store(spark, SUPPLIER), Session(1))
    registry.expose_type(SUPPLIER, ("insert", "all"), {"all": lambda handle, nation: handle.living().where(F.col("nation") == nation)})

    def of_nations(context: Context, *nations: int):
        for nation in nations:
            yield registry.perform(SUPPLIER.struct_hash, "all", suppliers, nation=nation)

    registry.expose_function(of_nations)
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    last = rows.orderBy(F.desc("name")).first()
    suppliers.insert_all(rows.where(F.col("name") != last["name"]))
    registry.perform(SUPPLIER.struct_hash, "insert", suppliers, name=last["name"], nation=last["nation"])
    return registry.table("of_nations", Context(spark, Session(1)), 3, 4).select("name", "nation")


# Extensions: what Spark adds


@_query("SELECT r_name, n_name, count(*) AS suppliers, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_name")
def ext_nested_pivots(spark, sf_dir):
    """Regions, their nations, and those nations' suppliers: pivots of pivots."""
    region, nation, supplier = (_table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    both = extensions.children(region, nation, F.col("n_regionkey") == F.col("r_regionkey"))
    return extensions.children(both, supplier, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("cents"))


@_query("SELECT o_orderpriority AS priority, count(DISTINCT l_orderkey) AS orders, count(*) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def ext_children_aggregate(spark, sf_dir):
    """Orders with their items, by priority."""
    orders = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey")
    per_order = items.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return extensions.children(orders, per_order, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("priority").agg(F.count("*").alias("orders"), F.sum("n").alias("items"))


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_event_windows(spark, sf_dir):
    return extensions.windowed(_table(spark, sf_dir, "events"), "ts", "1 hour", "event_type", n=F.count("*"))


@_query(f"WITH {_LOG}, v5 AS (SELECT * FROM v WHERE instant <= 5000), r5 AS (SELECT * FROM r WHERE instant <= 5000), s5 AS (SELECT tenant, rec, max(instant) AS instant, max(instant) FILTER (WHERE enters) AS entered FROM v5 GROUP BY ALL), d5 AS (SELECT tenant, rec, max(instant) AS gone FROM r5 GROUP BY ALL) SELECT tenant, rec, instant FROM s5 LEFT JOIN d5 USING (tenant, rec) WHERE entered > coalesce(gone, -1)")
def ext_as_of(spark, sf_dir):
    return views.as_of(*_log(spark, sf_dir), 5000).select("tenant", "rec", "instant")


@_query(f"WITH {_LOG}, q AS (SELECT DISTINCT tenant, rec, asked FROM v, (VALUES (2500), (7500)) t(asked)) SELECT q.tenant, q.rec, q.asked, max(v.instant) AS instant FROM q LEFT JOIN v ON v.tenant = q.tenant AND v.rec = q.rec AND v.instant <= q.asked GROUP BY ALL")
def ext_as_of_join(spark, sf_dir):
    versions, _ = _log(spark, sf_dir)
    requests = versions.select("tenant", "rec").distinct().select("tenant", "rec", F.explode(F.array(F.lit(2500), F.lit(7500))).alias("asked"))
    found = extensions.as_of_join(requests, versions.drop("pivot"), ["tenant", "rec"], at="asked")
    return found.select("tenant", "rec", "asked", F.col("version.instant").alias("instant"))


@_query("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) % 1000003 AS BIGINT) AS checksum FROM orders GROUP BY o_orderstatus")
def ext_aggregate_function(spark, sf_dir):
    """A registered aggregate function: partial results of Arrow batches, put together by sum."""
    registry = Registry()
    registry.expose_aggregate("checksum", lambda cents: int(cents.sum() % 1_000_003), "long")
    registry.expose_aggregate("rows", len, "long")
    checksum, rows = registry.aggregate("checksum"), registry.aggregate("rows")
    parts = _orders(spark, sf_dir).groupBy("status", F.pmod("rec", F.lit(64)).alias("part")).agg(rows("cents").alias("n"), checksum("cents").alias("c"))
    return parts.groupBy("status").agg(F.sum("n").alias("n"), (F.sum("c") % 1_000_003).alias("checksum"))


@_query("SELECT event_id + 1 AS key, user_id AS tenant, event_id % 2 = 0 AS flag, event_id % 32768 AS salt, user_id * 65536 + CASE WHEN event_id % 2 = 0 THEN 32768 ELSE 0 END + event_id % 32768 AS low, CASE WHEN event_id % 2 <> 0 THEN event_id + 1 END AS created_at FROM events")
def id_fields(spark, sf_dir):
    """Addresses packed into 128 bits, and their fields."""
    packed = ids.packed(F.col("event_id") + 1, F.col("user_id"), F.col("event_id") % 2 == 0, F.col("event_id") % 32768)
    found = ids.fields(F.col("id.high"), F.col("id.low"))
    return _table(spark, sf_dir, "events").select(packed.alias("id")).select(F.col("id.low").alias("low"), *[found[n].alias(n) for n in ("key", "tenant", "flag", "salt", "created_at")])


@_query("SELECT s_suppkey AS rec FROM supplier WHERE s_nationkey = 7 OR s_suppkey % 4 = 1 OR (s_suppkey % 4 = 2 AND s_nationkey < 9) OR (s_suppkey % 4 = 3 AND s_nationkey = 3)")
def ext_permissions(spark, sf_dir):
    """What tenant 7, in group 3, may read of suppliers whose tenant is their nation."""
    grant = F.array(F.lit(None).cast("string"), F.lit("public"), F.when(F.col("s_nationkey") < 9, "tenants:5,7,71").otherwise("tenants:70"), F.concat(F.lit("group:"), F.col("s_nationkey").cast("string")))
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("tenant"), F.col("s_suppkey").alias("rec"), F.element_at(grant, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("permission"))
    return extensions.readable(rows, 7, (3,)).select("rec")
