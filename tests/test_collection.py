from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.errors import Conflict, InvalidDeclaration, InvalidRecord, KeyMismatch, ListOutOfRange, PivotMissing, RecordMissing, SecondaryIndexOutOfRange
from chronolith.model import FuzzyIndex, Id, RecordType, Shape
from chronolith.operators import fuzzy
from chronolith.operators.bounds import Prefix, Range
from chronolith.operators.collection import Collection, Session, UniqueRecord, mint
from chronolith.sources import Expect, LogStore, MemoryStore

PERSON = RecordType("person", Shape.NON_UNIQUE, T.StructType([T.StructField("name", T.StringType()), T.StructField("city", T.StringType())]), pivots=(("city",), ("city", "name")), lists=(("name",),), fuzzy=(FuzzyIndex("name"),))
SETTING = RecordType("setting", Shape.NON_UNIQUE, T.StructType([T.StructField("slug", T.StringType()), T.StructField("value", T.StringType())]), key=("slug",))
PROFILE = RecordType("profile", Shape.UNIQUE, T.StructType([T.StructField("name", T.StringType())]))


@pytest.fixture
def people(spark, tmp_path):
    return Collection.adopt_pivot(PERSON, LogStore(spark, str(tmp_path / "people"), PERSON.body, PERSON.fuzzy, "person"), Session(7), 1)


def test_reads_and_writes(people):
    ada, bob, eve = (people.insert(name=n, city=c) for n, c in (("Ada Lovelace", "Bern"), ("Bob", "Basel"), ("Eve", "Bern")))
    assert [r["name"] for r in people.all().collect()] == ["Eve", "Bob", "Ada Lovelace"]
    assert [r["name"] for r in people.by(city="Bern").collect()] == ["Ada Lovelace", "Eve"]
    assert [r["name"] for r in people.search_by(1, Prefix(("Bern", "E"))).collect()] == ["Eve"]
    assert [r["name"] for r in people.search_by(0, Range(("Ba",), ("Be",))).collect()] == ["Bob"]
    assert [r["name"] for r in people.listed(0, 1, 1).collect()] == ["Bob"]
    assert people.listed(0, 9).collect() == [] and people.listed(0, 0, 0).collect() == [] and people.list_len() == 3
    assert [r["rec"] for r in people.fuzzy_search("ada lovelase", fuzzy.Distance(2)).collect()] == [ada]
    people.save(bob, name="Bobby", city="Bern")
    assert people.remove(eve) and not people.remove(eve) and not people.remove("nobody")
    assert people.anchor(eve) == "dead" and people.anchor("nobody") == "vacant" and people.get(eve)["name"] == "Eve"
    people.save(eve, name="Eva", city="Bern")
    assert people.anchor(eve) == "dead" and [r["name"] for r in people.all().collect()] == ["Bobby", "Ada Lovelace"]
    assert [r["name"] for r in people.history(bob).collect()] == ["Bobby", "Bob"]
    with pytest.raises(RecordMissing):
        people.history("nobody")
    with pytest.raises(RecordMissing):
        people.save("nobody", name="x", city="y")
    with pytest.raises(SecondaryIndexOutOfRange):
        people.search_by(5, None)
    with pytest.raises(ListOutOfRange):
        people.listed(3)
    for session, pivot in ((Session(8), 1), (Session(7), 2)):
        with pytest.raises(PivotMissing):
            Collection(PERSON, people.store, session, pivot).all()
    other = Collection.adopt_pivot(PERSON, people.store, Session(8), 1)
    assert other.all().collect() == [] and other.get(ada) is None


def test_changes_collapse_and_register(people):
    events, start = people.changes()
    assert events.collect() == [] and start == 0
    a = people.insert(name="a", city="x")
    _, start = people.changes()
    people.save(a, name="b", city="x")
    people.save(a, name="c", city="x")
    b = people.insert(name="d", city="x")
    people.remove(b)
    events, end = people.changes(start)
    assert [(r["rec"], r["event"], r["name"]) for r in events.collect()] == [(a, "saved", "c"), (b, "removed", None)]
    assert people.changes(end)[0].collect() == [] and people.changes(end)[1] == end


def test_keyed_upsert_and_revive(spark, tmp_path):
    settings = Collection(SETTING, LogStore(spark, str(tmp_path / "s"), SETTING.body), Session(1))
    rec = settings.insert(slug="theme", value="dark")
    _, cursor = settings.changes()
    assert settings.insert(slug="theme", value="light") == rec and settings.list_len is not None
    assert settings.remove(rec)
    assert settings.insert(slug="theme", value="back") == rec and settings.anchor(rec) == "living"
    assert [r["event"] for r in settings.changes(cursor)[0].collect()] == ["removed", "saved"]
    assert settings.history(rec).count() == 3
    with pytest.raises(KeyMismatch):
        settings.save(rec, slug="other", value="x")
    settings.insert_all(spark.createDataFrame([(f"k{i}", str(i)) for i in range(50)], SETTING.body))
    assert settings.living().count() == 51
    instants = [r["instant"] for r in settings.versions().collect()]
    assert len(set(instants)) == len(instants)


def test_conflict_leaves_nothing(people):
    base = people._base()
    people.insert(name="first", city="x")
    row = people._frame([people._row("r", 5, True, {"name": "late"})])
    with pytest.raises(Conflict):
        people.store.apply(row, base=base)
    with pytest.raises(Conflict):
        people.store.apply(row, expects=[Expect(7, 1, "r", 3)])
    assert [r["name"] for r in people.all().collect()] == ["first"]


def test_compaction_keeps_everything(people):
    for i in range(4):
        people.insert(name=f"n{i}", city="x")
    before = sorted(tuple(r) for r in people.versions().collect())
    people.store.compact()
    assert sorted(tuple(r) for r in people.versions().collect()) == before and len(people.store.commits()) == 1
    people.insert(name="after", city="x")
    assert people.list_len() == 5


def test_unique(spark, tmp_path):
    profile = UniqueRecord(PROFILE, LogStore(spark, str(tmp_path / "p"), PROFILE.body), Session(3))
    assert profile.get() is None and profile.history().collect() == [] and profile.changes(4)[1] == 4
    first = profile.save(name="a")
    profile.save(name="b")
    last = profile.save(name="c")
    assert profile.get()["name"] == "c" and [r["name"] for r in profile.history().collect()] == ["c", "b", "a"]
    assert [r["name"] for r in profile.changes(first)[0].collect()] == ["b", "c"]
    assert [r["name"] for r in profile.changes(1)[0].collect()] == ["c"] and profile.changes(last)[0].collect() == []


def test_adopt_mirrors_once(people, spark, tmp_path):
    people.insert(name="a", city="x")
    people.insert(name="b", city="y")
    mirror = Collection.adopt_pivot(PERSON, LogStore(spark, str(tmp_path / "m"), PERSON.body), Session(7), 1)
    mirror.adopt(people.versions())
    mirror.adopt(people.versions())
    assert sorted(tuple(r) for r in mirror.versions().collect()) == sorted(tuple(r) for r in people.versions().collect())


def test_stored_list_pages(people, tmp_path):
    for i in range(9):
        people.insert(name=f"n{8 - i}", city="x")
    stored = people.store_list(str(tmp_path / "list"))
    assert [(r["pos"], r["name"]) for r in stored.page(3, 4).orderBy("pos").collect()] == [(i, f"n{i}") for i in range(3, 7)]
    assert stored.page(90, 4).collect() == [] and len(stored) == 9


def test_declarations():
    body = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("n", T.LongType())])
    with pytest.raises(InvalidDeclaration):
        RecordType("t", Shape.NON_UNIQUE, body, pivots=(("x",),))
    with pytest.raises(InvalidDeclaration):
        RecordType("t", Shape.UNIQUE, body, lists=(("n",),))
    a, b = RecordType("t", Shape.NON_UNIQUE, body), RecordType("t", Shape.NON_UNIQUE, body, pivots=(("n",),))
    assert a.struct_hash != b.struct_hash and a.struct_hash == RecordType("t", Shape.NON_UNIQUE, body).struct_hash
    assert mint(1 << 62) == (1 << 62) + 1


def test_prefix_bits(spark):
    frame = spark.range(1000)
    assert frame.where(Prefix((b"\x00\x00\x02",), bits=32).predicate(("id",))).agg(F.min("id"), F.max("id")).first()[:] == (512, 767)


def test_a_manifest_is_whole_or_not_there(people):
    people.insert(name="a", city="x")
    folder = Path(people.store.path) / "commits"
    (folder / ".torn").write_text("")  # what a writer that died left
    assert [r["name"] for r in people.all().collect()] == ["a"]
    assert not people.store._put(f"{people.store.path}/commits/000000000002.json", "{}") and not list(folder.glob(".[0-9a-f]*"))
    people.insert(name="b", city="x")
    assert people.list_len() == 2


def test_a_store_of_another_type_is_refused(people, spark):
    people.insert(name="a", city="x")
    with pytest.raises(InvalidRecord):
        LogStore(spark, people.store.path, SETTING.body)
    with pytest.raises(InvalidRecord):
        LogStore(spark, people.store.path, PERSON.body, type_name="other")


def test_damaged_pages_are_found(people, spark):
    people.insert_all(spark.range(0, 20_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit("x").alias("city")))
    part = max(Path(people.store.path).glob("versions/*/part-*"), key=lambda p: p.stat().st_size)
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 2] ^= 0x55
    part.write_bytes(raw)
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        people.all().collect()


def test_batches(people, spark):
    rows = spark.range(0, 1000, 1, 7).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("x").alias("city"))
    people.insert_all(rows)
    first = [r["instant"] for r in people.living().orderBy("instant").collect()]
    assert first == list(range(first[0], first[0] + 1000)) and len({r["rec"] for r in people.living().collect()}) == 1000
    people.save_all(people.living().where("name < 'n5'").select("rec", "name", F.lit("y").alias("city")))
    assert people.by(city="y").count() == people.living().where("name < 'n5'").count() > 0
    with pytest.raises(RecordMissing):
        people.save_all(spark.createDataFrame([("nobody", "a", "b")], "rec string, name string, city string"))
    some = people.living().first()["rec"]
    with pytest.raises(InvalidRecord):
        people.save_all(spark.createDataFrame([(some, "a", "b")] * 2, "rec string, name string, city string"))
    assert not list(Path(people.store.path).glob("staging/*"))


def test_keyed_batches_refuse_a_key_twice(spark, tmp_path):
    settings = Collection(SETTING, LogStore(spark, str(tmp_path / "s"), SETTING.body), Session(1))
    with pytest.raises(InvalidRecord):
        settings.insert_all(spark.createDataFrame([("k", "1"), ("k", "2")], SETTING.body))
    settings.insert_all(spark.createDataFrame([("k é\"/", "1")], SETTING.body))
    rec = settings.living().first()["rec"]
    assert settings.insert(slug='k é"/', value="2") == rec and settings.list_len is not None and settings.living().count() == 1


def test_pages_and_lookups(people, spark):
    people.insert_all(spark.range(60).select(F.format_string("n%03d", "id").alias("name"), (F.col("id") % 7).cast("string").alias("city")))
    assert [r["name"] for r in people.listed(0, 50).collect()] == [f"n{i:03d}" for i in range(50, 60)]
    assert [r["name"] for r in people.listed_at_page(2, 25).collect()] == [f"n{i:03d}" for i in range(50, 60)]
    people.insert(name="n999", city="z")
    assert [r["name"] for r in people.listed(0, 58).collect()] == ["n058", "n059", "n999"]
    people.vacuum_lists()
    assert len(list(Path(people.store.path).glob("lists/*"))) == 1
    assert people.greatest(0)["name"] == "n999" and people.greatest(1)["city"] == "z"
    last = people.greatest(0)
    assert [r["living"] for r in people.contains(last["rec"], "nobody").orderBy("rec").collect()] == [True, False]
    assert [r["name"] for r in people.created_between(last["instant"], last["instant"] + 1).collect()] == ["n999"] and people.created_between(5, 5).collect() == []
    triple = people.triples().where("body.name = 'n999'").first()
    assert triple["id"]["rec"] == last["rec"] and triple["metadata"]["instant"] == last["instant"]


def test_reads_of_one_collection_are_not_one_task(people, spark):
    people.insert_all(spark.range(50).select(F.format_string("n%03d", "id").alias("name"), F.lit("x").alias("city")))
    for frame in (people.all(), people.by(city="x"), people.listed(0), people.listed(0, 20)):
        plan = frame._jdf.queryExecution().toString().rpartition("== Physical Plan ==")[2]
        assert "SinglePartition" not in plan and "Window" not in plan


def test_kept_postings_answer_as_a_scan(people, spark):
    people.insert_all(spark.createDataFrame([(n, "x") for n in ("Ada Lovelace", "Ada Lovelock", "Bob", "Eve", "Grace Hopper")], PERSON.body))
    people.save(people.living().where("name = 'Bob'").first()["rec"], name="Ada Love", city="y")
    people.remove(people.living().where("name = 'Ada Lovelock'").first()["rec"])
    for _ in range(2):
        for mode in (fuzzy.Distance(3), fuzzy.Similarity(0.3), fuzzy.Contains(0.4)):
            x = PERSON.fuzzy[0]
            assert people.fuzzy_search("ada love", mode).collect() == fuzzy.search(people.living(), x.field, "ada love", mode, None, x.n, x.fold).collect() != []
        people.store.compact()
    scanned = people.fuzzy_search("ada", fuzzy.Contains(0.1))._jdf.queryExecution().toString()
    assert "postings" in scanned


def test_no_task_sorts_a_batch_of_postings_alone(people, spark, monkeypatch):
    monkeypatch.setattr("chronolith.sources.store.POSTINGS_PER_TASK", 500)
    # One partition, and so one file of versions; every text has the same grams.
    people.insert_all(spark.range(400).select(F.lit("zzzz").alias("name"), F.lit("x").alias("city")).coalesce(1))
    for _ in range(2):
        sizes = [r["count"] for r in people.store.postings().groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == 400 * 5 and max(sizes) < 1000
        found = people.fuzzy_search("zzz", fuzzy.Similarity(0.5))
        assert found.count() == 400
        people.store.compact()


def test_adoption(people, spark, tmp_path):
    a, b = people.insert(name="a", city="x"), people.insert(name="b", city="y")
    people.save(a, name="a2", city="x")
    people.remove(b)
    mirror = Collection.adopt_pivot(PERSON, LogStore(spark, str(tmp_path / "m"), PERSON.body), Session(7), 1)
    for _ in range(2):
        mirror.adopt(people.versions(), people.removals())
    assert [tuple(r) for r in mirror.all().collect()] == [tuple(r) for r in people.all().collect()] and mirror.anchor(b) == "dead" and mirror.history(a).count() == 2
    assert len(mirror.store.commits()) == 2
    rows = spark.createDataFrame([(a, "a3", "x"), ("new", "n", "z"), (b, "b", "y")], "rec string, name string, city string")
    mirror.adopt_records(rows)
    before = len(mirror.store.commits())
    mirror.adopt_records(rows)
    assert len(mirror.store.commits()) == before and {r["name"] for r in mirror.all().collect()} == {"a3", "n", "b"}
    profile, other = (UniqueRecord(PROFILE, LogStore(spark, str(tmp_path / n), PROFILE.body), Session(3)) for n in ("p", "q"))
    profile.save_as(42, name="a")
    profile.save(name="b")
    for _ in range(2):
        other.adopt(profile.versions())
    assert [(r["name"], r["author"]) for r in other.history().collect()] == [("b", None), ("a", 42)]


def test_vacuum_keeps_what_counts(people):
    for i in range(3):
        people.insert(name=f"n{i}", city="x")
    people.store.compact()
    assert people.store.vacuum(3600) == 0 and people.store.vacuum(-1) > 0 and people.list_len() == 3
    assert Collection(PERSON, people.store, Session(7), 1).list_len() == 3


def test_ids():
    i = Id.of(1 << 63 | 5, (1 << 48) - 1, True, (1 << 15) + 9)
    assert (i.key, i.tenant, i.is_unique_anchor, i.salt, i.created_at, i.struct_hash) == (1 << 63 | 5, (1 << 48) - 1, True, 9, None, 1 << 63 | 5)
    assert Id.of(7, 3).created_at == 7 and Id.of(7, 3).struct_hash is None and Id(Id.of(7, 3).raw).tenant == 3
    with pytest.raises(InvalidDeclaration):
        Id.of(1, 1 << 48)


def test_memory_store_keeps_the_contract(spark, tmp_path):
    people = Collection.adopt_pivot(PERSON, MemoryStore(spark, str(tmp_path / "scratch"), PERSON.body, PERSON.fuzzy), Session(7), 1)
    ada = people.insert(name="Ada Lovelace", city="Bern")
    people.insert_all(spark.createDataFrame([("Bob", "Basel"), ("Eve", "Bern")], PERSON.body))
    with pytest.raises(Conflict):
        people.store.apply(people._frame([people._row("late", 5, True, {"name": "late"})]), base=1)
    people.save(ada, name="Ada", city="Basel")
    for _ in range(2):
        assert [r["name"] for r in people.by(city="Basel").collect()] == ["Ada", "Bob"]
        assert [r["name"] for r in people.fuzzy_search("adda", fuzzy.Distance(1)).collect()] == ["Ada"] and people.history(ada).count() == 2
        people.store.compact()
    assert len(people.store.commits()) == 1 and people.list_len() == 3
