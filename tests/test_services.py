import pytest
from pyspark.sql import functions as F

from chronolith.errors import CollisionError, Conflict, LoginRequired, NotExposed, UnknownStructHash
from chronolith.offline import Mirror, OfflineQueue
from chronolith.operators import fuzzy, idsets
from chronolith.operators.collection import Collection, Session
from chronolith.registry import Context, Registry
from chronolith.sources import LogStore
from chronolith.streaming import poll, watch_collection
from tests.test_collection import PERSON, SETTING


def test_registry(spark, tmp_path):
    registry = Registry()
    registry.expose_type(PERSON, ("get", "insert", "all"), {"all": lambda handle: "mine"})
    hello = registry.expose_function(lambda context, name: f"{name}@{context.session.tenant}", "hello")
    registry.expose_function(lambda context: "open", "status", public=True)
    context = Context(spark, Session(5))
    assert registry.call("hello", context, name="x") == "x@5" and registry.call("hello", context.as_tenant(6), name="x") == "x@6"
    assert registry.knows(hello.struct_hash) and not registry.knows(1)
    nobody = Context(spark, Session(5, anonymous=True))
    assert registry.call("status", nobody) == "open"
    with pytest.raises(LoginRequired):
        registry.call("hello", nobody, name="x")
    with pytest.raises(UnknownStructHash):
        registry.call("nothing", context)
    with pytest.raises(CollisionError):
        registry.expose_function(lambda context: 1, "hello")
    people = Collection(PERSON, LogStore(spark, str(tmp_path / "p"), PERSON.body), Session(5))
    rec = registry.perform(PERSON.struct_hash, "insert", people, name="a", city="b")
    assert registry.perform(PERSON.struct_hash, "get", people, rec)["name"] == "a" and registry.perform(PERSON.struct_hash, "all", people) == "mine"
    with pytest.raises(NotExposed):
        registry.perform(PERSON.struct_hash, "remove", people, rec)
    with pytest.raises(UnknownStructHash):
        registry.perform(SETTING.struct_hash, "get", people, rec)


class Flaky:
    def __init__(self):
        self.up, self.saved = False, []

    def save(self, name):
        if not self.up:
            raise ConnectionError
        if name == "bad":
            raise Conflict
        self.saved.append(name)
        return 1


def test_offline_queue():
    record, queue = Flaky(), OfflineQueue()
    assert [queue.save(record, name=n) for n in ("a", "bad", "b")] == [None] * 3 and queue.replay() == 0
    record.up = True
    assert queue.replay() == 2 and record.saved == ["a", "b"] and len(queue.refused) == 1 and queue.save(record, name="c") == 1


def test_mirror(spark):
    mirror, down = Mirror(), [False]

    def read():
        if down[0]:
            raise ConnectionError
        return spark.range(3)

    assert mirror.read("r", read).count() == 3
    down[0] = True
    assert mirror.read("r", read).count() == 3
    with pytest.raises(ConnectionError):
        mirror.read("other", read)


def test_id_sets(spark):
    left = spark.createDataFrame([(i, p) for p, i in enumerate([3, 1, 3, 2])], "id long, at long")
    right = spark.createDataFrame([(i, p) for p, i in enumerate([2, 5, 3, 3])], "id long, at long")
    assert sorted(r["id"] for r in idsets.intersect(left, right).collect()) == [2, 3, 3]
    assert [r["id"] for r in idsets.except_(left, right).collect()] == [1]
    assert sorted(r["id"] for r in idsets.union(left, right).collect()) == [1, 2, 3, 5]
    assert [r["id"] for r in idsets.in_order(idsets.union(left, right, order="at"), "at").orderBy("pos").collect()] == [3, 1, 2, 5]


def test_fuzzy_needs_a_shared_gram(spark):
    live = spark.createDataFrame([(1, 0, 1, "cd"), (1, 0, 2, "abc"), (1, 0, 3, None)], "tenant long, pivot long, rec long, name string")
    assert [r["rec"] for r in fuzzy.search(live, "name", "ab", fuzzy.Distance(2)).collect()] == [2]
    assert [r["rec"] for r in fuzzy.search(live, "name", "ab", fuzzy.Distance(2), exhaustive=True).collect()] == [2, 1]
    assert fuzzy.search(live, "name", "ab", fuzzy.Similarity(1.5)).collect() == []
    index = fuzzy.postings(live, "name")
    for mode in (fuzzy.Distance(2), fuzzy.Similarity(0.2), fuzzy.Contains(0.3)):
        assert fuzzy.search_postings(index, live, "name", "ab", mode).collect() == fuzzy.search(live, "name", "ab", mode).collect()
    assert fuzzy.threshold(fuzzy.Distance(2), 10, 3) == 4 and fuzzy.threshold(fuzzy.Distance(9), 10, 3) == 0 and fuzzy.threshold(fuzzy.Contains(0), 10, 3) == 1


def test_fuzzy_cuts_a_text_once(spark):
    live = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(("Ab c", "abd", "x\U0001f600y", "", None))], "tenant long, pivot long, rec long, name string")
    index = fuzzy.postings(live, "name")
    for mode in (fuzzy.Distance(2), fuzzy.Similarity(0.2), fuzzy.Contains(0.3)):
        scan, kept = fuzzy.search(live, "name", "ab", mode), fuzzy.search_postings(index, live, "name", "ab", mode, limit=3)
        # From postings: once to cut, once to verify, and for distances once to leave out those of other lengths before the cut.
        for found, times in ((scan, 1), (kept, 3 if isinstance(mode, fuzzy.Distance) else 2)):
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("regexp_replace(") == times
        assert [r["rec"] for r in scan.collect()] == [r["rec"] for r in kept.collect()] and scan.columns == [*live.columns, "score", "rank"]
    assert index.where("rec = 2").select("gram").distinct().count() == 5 and index.where("rec > 3").isEmpty()


def test_watch_tells_committed_events_once(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "p"), PERSON.body)
    people, mirror = Collection(PERSON, store, Session(5)), Collection(PERSON, LogStore(spark, str(tmp_path / "m"), PERSON.body), Session(5))
    watch = watch_collection(store, str(tmp_path / "w"), Session(5), mirror=mirror.adopt)
    told = lambda: [(r["event"], r["name"]) for r in watch.catch_up().orderBy("instant").collect()]
    assert told() == []
    a = people.insert(name="a", city="x")
    with pytest.raises(Conflict):
        store.apply(people._frame([people._row("late", 5, True, {"name": "late"})]), base=0)
    Collection(PERSON, store, Session(6)).insert(name="another tenant's", city="x")
    assert told() == [("saved", "a")]
    people.remove(a)
    people.insert(name="b", city="x")
    store.compact()
    store.vacuum(-1)
    people.insert(name="c", city="x")
    watch = watch_collection(store, str(tmp_path / "w"), Session(5), mirror=mirror.adopt)
    assert told() == [("saved", "a"), ("removed", None), ("saved", "b"), ("saved", "c")] == told()
    assert [r["name"] for r in mirror.all().collect()] == ["c", "b"]


def test_poll_backs_off_while_idle(spark, tmp_path):
    people = Collection(PERSON, LogStore(spark, str(tmp_path / "p"), PERSON.body), Session(5))
    waits, asked = [], [0]

    def sleep(seconds):
        waits.append(seconds)
        if len(waits) == 3:
            people.insert(name="a", city="x")

    def until():
        asked[0] += 1
        return asked[0] > 11

    found = [f.collect() for f in poll(people.changes, interval=1.0, until=until, sleep=sleep)]
    assert [r["name"] for f in found for r in f] == ["a"] and waits == [1, 2, 4, 1, 2, 4, 8, 16, 16, 16]
