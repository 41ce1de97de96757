"""Absorbing landing files as they arrive equals the batch run over all of them."""

import json
import random

import pytest

from orewash import TRANSACTIONS, USERS
from orewash.plans.silver import silver
from orewash.sources.landing import read_landing
from orewash.streaming import landing as streaming
from orewash.streaming.landing import absorb, landing_stream, stored_rejects, stored_silver
from orewash.streaming.store import MOST_PARTS, Store


def put(folder, name, *records):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def drain(spark, base, spec, **options):
    landing_stream(spark, f"{base}/in", f"{base}/store", f"{base}/check", spec, **options).awaitTermination()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same_as_batch(spark, base, spec):
    good, rejected = silver(read_landing(spark, f"{base}/in", spec), spec)
    assert rows(stored_silver(spark, f"{base}/store", spec)) == rows(good)
    assert rows(stored_rejects(spark, f"{base}/store", spec).select(*rejected.columns)) == rows(rejected)


def test_waves_of_transactions(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def tx(key, at, amount, user="u"):
        return {"tx_id": key, "user_id": user, "created_at": at, "amount": amount}

    put(folder, "1.json", tx("a", "2024-01-01", 1), tx("b", "2024-01-05", -9), tx("c", "2024-01-03", 3), {"tx_id": "x"})
    drain(spark, tmp_path, TRANSACTIONS)
    same_as_batch(spark, tmp_path, TRANSACTIONS)
    # a moves to another date and empties the old one; b's older good row must not get in; c gets an older copy
    put(folder, "2.json", tx("a", "2024-01-02", 2), tx("b", "2024-01-04", 5), tx("c", "2024-01-01", 4))
    put(folder, "3.json", tx("d", "2024-01-09", 7), tx(None, "2024-01-09", 7), tx("e", "junk", 7))
    drain(spark, tmp_path, TRANSACTIONS, files_per_batch=1)
    same_as_batch(spark, tmp_path, TRANSACTIONS)
    # the last batch again, as after a crash: nothing changes
    absorb(spark, [f"file:{folder}/3.json"], f"{tmp_path}/store", TRANSACTIONS)
    same_as_batch(spark, tmp_path, TRANSACTIONS)
    # a batch that crashed before it was noted is worked out afresh
    absorb(spark, [f"file:{folder}/2.json"], f"{tmp_path}/store", TRANSACTIONS)
    assert rows(stored_silver(spark, f"{tmp_path}/store", TRANSACTIONS).select("tx_id")) == [("a",), ("c",), ("d",)]


def test_waves_of_users(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "1.json", {"user_id": "u", "email": "a@x", "updated_at": "2024-01-01", "year": 7}, {"user_id": "v"}, {"email": "z"})
    drain(spark, tmp_path, USERS)
    same_as_batch(spark, tmp_path, USERS)
    put(folder, "2.json", {"user_id": "u", "city": "Rome", "updated_at": "2024-01-02"}, {"user_id": "v", "name": "V"})
    drain(spark, tmp_path, USERS)
    same_as_batch(spark, tmp_path, USERS)


def test_nothing_new(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "notes.md", {"a": 1})
    put(folder, "1.json", {"user_id": "u"})
    drain(spark, tmp_path, USERS, files_per_batch=1)
    drain(spark, tmp_path, USERS)
    same_as_batch(spark, tmp_path, USERS)


def test_new_checkpoint_and_second_stream(spark, tmp_path):
    folder, other = tmp_path / "in", tmp_path / "other"
    folder.mkdir()
    other.mkdir()
    put(folder, "1.json", {"user_id": "u"})
    drain(spark, tmp_path, USERS)
    put(folder, "2.json", {"user_id": "v"})
    put(other, "3.json", {"user_id": "w"})
    for source, check in ((folder, "check2"), (other, "check3")):
        landing_stream(spark, str(source), f"{tmp_path}/store", f"{tmp_path}/{check}", USERS).awaitTermination()
    assert [r["user_id"] for r in stored_silver(spark, f"{tmp_path}/store", USERS).orderBy("user_id").collect()] == ["u", "v", "w"]


def tx(key, at, amount=1):
    return {"tx_id": key, "user_id": "u", "created_at": at, "amount": amount}


@pytest.fixture
def waves(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "1.json", tx("a", "2024-01-01"), tx("b", "2024-01-02"), {"tx_id": "x"})
    put(folder, "2.json", tx("a", "2024-01-03"), tx("c", "2024-01-01"))
    drain(spark, tmp_path, TRANSACTIONS)
    return folder


def test_a_rewritten_file_is_taken_anew(spark, tmp_path, waves):
    put(waves, "2.json", tx("c", "2024-01-05"), tx("d", "2024-01-06"), {"tx_id": "y"})  # a's newest row is gone
    drain(spark, tmp_path, TRANSACTIONS)
    same_as_batch(spark, tmp_path, TRANSACTIONS)
    assert rows(stored_silver(spark, f"{tmp_path}/store", TRANSACTIONS).select("tx_id")) == [("a",), ("b",), ("c",), ("d",)]
    put(waves, "1.json")  # now empty
    put(waves, "3.json", tx("b", "2024-01-09"))
    absorb(spark, [f"file:{waves}/1.json"], f"{tmp_path}/store", TRANSACTIONS)
    drain(spark, tmp_path, TRANSACTIONS)
    same_as_batch(spark, tmp_path, TRANSACTIONS)


def test_files_that_are_gone_take_their_rows_along(spark, tmp_path, waves):
    (waves / "1.json").unlink()
    put(waves, "3.json", tx("c", "2024-01-05"))
    drain(spark, tmp_path, TRANSACTIONS)
    same_as_batch(spark, tmp_path, TRANSACTIONS)
    (waves / "2.json").unlink()
    absorb(spark, [f"file:{waves}/2.json"], f"{tmp_path}/store", TRANSACTIONS)
    same_as_batch(spark, tmp_path, TRANSACTIONS)


class Stop(Exception):
    pass


@pytest.mark.parametrize("step, rewrite", [("write_winners", False), ("write_part", True), ("publish", False), ("publish", True), ("after", True)])
def test_a_crash_at_any_step_changes_nothing(spark, tmp_path, waves, monkeypatch, step, rewrite):
    before = rows(stored_silver(spark, f"{tmp_path}/store", TRANSACTIONS))
    put(waves, "2.json" if rewrite else "3.json", tx("a", "2024-01-07"), tx("e", "2024-01-01"), {"tx_id": "z"})
    name = "2.json" if rewrite else "3.json"
    real = getattr(Store, "publish" if step == "after" else step)

    def crash(self, *args):
        if step == "after":
            assert real(self, *args)
        raise Stop

    with monkeypatch.context() as patched:
        patched.setattr(Store, "publish" if step == "after" else step, crash)
        with pytest.raises(Stop):
            absorb(spark, [f"file:{waves}/{name}"], f"{tmp_path}/store", TRANSACTIONS)
    if step != "after":
        assert rows(stored_silver(spark, f"{tmp_path}/store", TRANSACTIONS)) == before
    drain(spark, tmp_path, TRANSACTIONS)
    same_as_batch(spark, tmp_path, TRANSACTIONS)
    Store(spark, f"{tmp_path}/store").vacuum()
    same_as_batch(spark, tmp_path, TRANSACTIONS)


def test_two_streams_at_once(spark, tmp_path, waves, monkeypatch):
    """A second stream publishes while the first one is at work: the first one starts over and loses nothing."""
    put(waves, "3.json", tx("a", "2024-01-07"))
    put(waves, "4.json", tx("a", "2024-01-08"), tx("f", "2024-01-01"))
    store, real, calls = f"{tmp_path}/store", streaming._absorbed, []

    def late(held, before, paths, spec, partial):
        after = real(held, before, paths, spec, partial)
        if not calls:
            calls.append(paths)
            absorb(spark, [f"file:{waves}/4.json"], store, TRANSACTIONS)
        return after

    monkeypatch.setattr(streaming, "_absorbed", late)
    absorb(spark, [f"file:{waves}/3.json"], store, TRANSACTIONS)
    same_as_batch(spark, tmp_path, TRANSACTIONS)


def test_of_two_rows_for_a_version_the_first_counts(spark, tmp_path, waves):
    store = Store(spark, f"{tmp_path}/store")
    first = store.latest()
    (log,) = [p for p in (tmp_path / "store" / "log").glob("number=*") if int(p.name.split("=")[1]) == first.number]
    late = spark.createDataFrame([("0", {}, [], [], "newest")], "id string, dates map<string,string>, files array<string>, refused array<string>, layout string")
    late.coalesce(1).write.mode("append").parquet(str(log))
    assert store.latest() == first
    same_as_batch(spark, tmp_path, TRANSACTIONS)


def test_a_batch_reads_no_date_but_those_it_touches(spark, tmp_path, waves):
    store = Store(spark, f"{tmp_path}/store")
    version, schema = store.latest(), streaming._store_schema(TRANSACTIONS)
    some = store.winners(version, schema, ["2024-01-02"])
    assert {f.split("event_date=")[1][:10] for f in some.inputFiles()} == {"2024-01-02"} and rows(some.select("tx_id")) == [("b",)]
    assert len(version.dates) == 3 and len(store.winners(version, schema).inputFiles()) == 3


def test_many_small_parts_become_one(spark, tmp_path, waves):
    store = Store(spark, f"{tmp_path}/store")
    at = store.latest()
    many = streaming.replace(at, files=at.files * (MOST_PARTS + 1), refused=at.refused * (MOST_PARTS + 1))
    one = store.compacted(many)
    assert len(one.files) == len(one.refused) == 1
    assert store.files(one).distinct().count() == 2 and store.refused(one).distinct().count() == 1


def test_partial_histories_in_any_order(spark, tmp_path):
    """Waves of partial user rows, newest first, oldest first and mixed, give what the batch gives."""
    rng = random.Random(2)
    days = [f"2024-01-{d:02d}" for d in range(1, 20)]
    records = []
    for _ in range(60):
        filled = {c: rng.choice([None, f"{c}{rng.randrange(5)}"]) for c in ("name", "email", "city")}
        records.append({"user_id": rng.choice("uvwxyz"), "updated_at": rng.choice([None, *days]), "age": rng.choice([None, 30, 40]), **filled})
    records.append({"name": "nobody"})
    for order in (lambda r: r["updated_at"] or "" if "updated_at" in r else "", None):
        base = tmp_path / ("sorted" if order else "mixed")
        (base / "in").mkdir(parents=True)
        wave = sorted(records, key=order, reverse=True) if order else rng.sample(records, len(records))
        for n in range(3):
            put(base / "in", f"{n}.json", *wave[n::3] if not order else wave[20 * n : 20 * n + 20 + (n == 2)])
            drain(spark, base, USERS, partial=True)
        good, rejected = silver(read_landing(spark, f"{base}/in", USERS), USERS, partial=True)
        assert rows(stored_silver(spark, f"{base}/store", USERS)) == rows(good)
        assert rows(stored_rejects(spark, f"{base}/store", USERS).select(*rejected.columns)) == rows(rejected)
    with pytest.raises(ValueError, match="partial"):
        absorb(spark, [f"file:{base}/in/0.json"], f"{base}/store", USERS)
    with pytest.raises(ValueError, match="histories"):
        absorb(spark, [], f"{base}/none", TRANSACTIONS, partial=True)
