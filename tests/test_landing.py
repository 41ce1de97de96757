"""Mixed-format landing folders, file by file."""

import gzip

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from orewash import EVENTS, TRANSACTIONS, USERS
from orewash.operators.normalize import normalize
from orewash.sources.audit import judged, landing_audit, routed
from orewash.sources.delimited import first_lines
from orewash.sources.landing import drift_report, landing_sources, read_landing
from orewash.sources.silver import read_loose
from orewash.specs import CORRUPT


def put(folder, name, text):
    path = folder / name
    data = text.encode()
    path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return str(path)


def landed(spark, folder, *columns, spec=EVENTS, **options):
    df = read_landing(spark, str(folder), spec, **options)
    assert df.columns == [*spec.columns, CORRUPT]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("ending", ["json", "ndjson", "json.gz", "ndjson.gz", "json.txt", "ndjson.txt", "gz", "txt"])
def test_json_lines_under_every_ending(spark, tmp_path, ending):
    put(tmp_path, f"a.{ending}", '{"event_id":"1","user id":"u","amount":"1,5"}\n{"event_id":2,"user.id":{"n":1}}\n')
    assert landed(spark, tmp_path, "event_id", "user_id", "amount") == [("1", "u", "1,5"), ("2", '{"n":1}', None)]


@pytest.mark.parametrize("ending", ["csv", "csv.gz", "txt", "txt.gz", "gz"])
def test_delimited_with_header(spark, tmp_path, ending):
    put(tmp_path, f"a.{ending}", 'ts,event_id,user id,extra_1\n2024-01-01,1,u,x\n"2024-01-02",2\n')
    assert landed(spark, tmp_path, "event_id", "user_id", "ts") == [("1", "u", "2024-01-01"), ("2", None, "2024-01-02")]


@pytest.mark.parametrize("ending", ["csv.gz", "txt", "txt.gz", "gz"])
def test_delimited_without_header_goes_by_position(spark, tmp_path, ending):
    put(tmp_path, f"a.{ending}", "1,u,2024-01-01\n2,v,2024-01-02,33,IT,e,day,n,1,2,3,2024,1,2\n")
    want = [("1", "2024-01-01", None, None), ("2", "2024-01-02", "33", None)]
    assert landed(spark, tmp_path, "event_id", "ts", "age", CORRUPT) == want


def test_a_value_that_is_a_column_name_makes_no_header(spark, tmp_path):
    put(tmp_path, "a.txt", "1,u,2024-01-01,33,IT,e,day\n2,v,2024-01-02,34,IT,e,m\n")
    assert landed(spark, tmp_path, "event_id", "message") == [("1", "day"), ("2", "m")]


def test_surplus_values_make_a_line_corrupt(spark, tmp_path):
    put(tmp_path, "a.csv", 'event_id,user_id\n1,u,surplus\n2\n3,"a,b"\n4,u,\n')
    put(tmp_path, "b.txt", "5,v,2024-01-02,33,IT,e,m,n,1,2,3,2024,1,2,more\n")
    want = [("1", "1,u,surplus"), ("2", None), ("3", None), ("4", None), ("5", "5,v,2024-01-02,33,IT,e,m,n,1,2,3,2024,1,2,more")]
    assert landed(spark, tmp_path, "event_id", CORRUPT) == want
    good, rejected = normalize(read_landing(spark, str(tmp_path), EVENTS), EVENTS)
    assert sorted(r["reason"].split(",")[0] for r in rejected.where("event_id in ('1', '5') or event_id is null").collect())[:2] == ["corrupt"] * 2


def test_names_are_read_in_any_case(spark, tmp_path):
    put(tmp_path, "a.json", '{"event_id":"1"}')
    put(tmp_path, "B.JSON", '{"event_id":"2"}')
    put(tmp_path, "C.Csv", "event_id\n3\n")
    put(tmp_path, "D.NDJSON", '{"event_id":"4"}')
    spark.sql("select '5' event_id").coalesce(1).write.parquet(str(tmp_path / "p"))
    (file,) = (tmp_path / "p").glob("*.parquet")
    (tmp_path / "PART-1.PARQUET").write_bytes(file.read_bytes())
    for one_header in (False, True):
        assert landed(spark, tmp_path, "event_id", one_header=one_header) == [(str(i),) for i in range(1, 6)]


def test_a_file_cut_off_is_left_out_whole_and_listed(spark, tmp_path):
    text = "".join(f'{{"event_id":"{i}","user_id":"{i * 7919 % 1000003}"}}\n' for i in range(20_000))
    whole = gzip.compress(text.encode())
    (tmp_path / "cut.json.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "two.json.gz").write_bytes(gzip.compress(b'{"event_id":"a"}\n') + gzip.compress(b'{"event_id":"b"}\n'))
    spark.sql("select '5' event_id").coalesce(1).write.parquet(str(tmp_path / "p"))
    (file,) = (tmp_path / "p").glob("*.parquet")
    (tmp_path / "part-1.parquet").write_bytes(file.read_bytes()[:-9])
    assert landed(spark, tmp_path, "event_id", skip_damaged=True) == [("a",), ("b",)]
    verdicts = {r["path"].split("/")[-1]: r["verdict"] for r in landing_audit(spark, str(tmp_path), "events", probe=True).collect()}
    assert verdicts == {"cut.json.gz": "damaged", "two.json.gz": "valid", "part-1.parquet": "unreadable"}


def test_headers_may_differ_between_files(spark, tmp_path):
    put(tmp_path, "a.csv", "event_id,user_id,amount\n1,u,5\n")
    put(tmp_path, "b.csv", "amount,event_id\n7,2\n")
    put(tmp_path, "c.csv", "nothing,known\n8,3\n")
    put(tmp_path, "empty.csv", "")
    want = [("1", "u", "5"), ("2", None, "7"), (None, None, None)]
    assert landed(spark, tmp_path, "event_id", "user_id", "amount") == want


def test_one_header_needs_no_look(spark, tmp_path):
    put(tmp_path, "a.csv", "event_id,user_id\n1,u\n")
    put(tmp_path, "b.csv", "event_id,user_id\n2,v\n")
    put(tmp_path, "c.json", '{"event_id":"3"}')
    want = [("1", "u"), ("2", "v"), ("3", None)]
    assert landed(spark, tmp_path, "event_id", "user_id", one_header=True) == want


def test_corrupt_json_line_reaches_quarantine(spark, tmp_path):
    put(tmp_path, "a.json", '{"event_id":"1","user_id":"u"}\nnot json\n\n{"event_id":"2","user_id":\n')
    good, rejected = normalize(read_landing(spark, str(tmp_path), EVENTS), EVENTS)
    assert [r["event_id"] for r in good.collect()] == ["1"]
    reasons = sorted((r[CORRUPT], r["reason"].split(",")[0]) for r in rejected.collect())
    assert reasons == [("not json", "corrupt"), ('{"event_id":"2","user_id":', "corrupt")]


def test_parquet_keeps_its_types_and_late_columns(spark, tmp_path):
    spark.sql("select 1L event_id, 'u' `user id`, timestamp'2024-01-01' ts").write.parquet(str(tmp_path / "p1"))
    spark.sql("select 2L event_id, 'v' `user id`, 4.5D amount").write.parquet(str(tmp_path / "p2"))
    folder = tmp_path / "in"
    folder.mkdir()
    for n in ("p1", "p2"):
        (file,) = (tmp_path / n).glob("*.parquet")
        file.rename(folder / f"{n}.parquet")
    (source,) = landing_sources(spark, str(folder), EVENTS)
    assert dict(source.rows.dtypes)["event_id"] == "bigint" and dict(source.rows.dtypes)["amount"] == "double"
    assert landed(spark, folder, "event_id", "user_id", "amount") == [("1", "u", None), ("2", "v", "4.5")]


def test_mixed_folder_list_of_files_and_odd_names(spark, tmp_path):
    folder = tmp_path / "land ing"
    folder.mkdir()
    paths = [
        put(folder, "a b.json", '{"event_id":"1"}'),
        put(folder, "c.csv", "event_id\n2\n"),
        put(folder, "d.gz", "3,u,2024-01-01\n"),
        put(folder, "e.bin", "junk"),
    ]
    assert landed(spark, folder, "event_id") == [("1",), ("2",), ("3",)]
    some = read_landing(spark, [f"file:{p}" for p in paths[1:]], EVENTS)
    assert sorted(r[0] for r in some.select("event_id").collect()) == ["2", "3"]


def test_nothing_to_read(spark, tmp_path):
    assert landed(spark, tmp_path / "absent", "event_id") == []
    put(tmp_path, "notes.md", "x")
    assert landed(spark, tmp_path, "event_id") == []


def test_damaged_file_is_loud_unless_skipped(spark, tmp_path):
    put(tmp_path, "a.json", '{"event_id":"1"}')
    (tmp_path / "b.csv.gz").write_bytes(b"not gzip at all")
    with pytest.raises((PySparkException, Py4JJavaError), match="b.csv.gz"):
        landed(spark, tmp_path, "event_id")
    assert landed(spark, tmp_path, "event_id", skip_damaged=True) == [("1",)]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_first_lines_with_many_blocks(spark, tmp_path, small_blocks):
    path = put(tmp_path, "a.csv", "\n  \nhead,er\n" + "x,y\n" * 50_000)
    (row,) = first_lines(spark, [path]).collect()
    assert row["line"] == "head,er"


def test_a_blank_opening_block_hides_nothing(spark, tmp_path, small_blocks):
    put(tmp_path, "late.csv", "\n" * 60_000 + "event_id,user_id\n" + "".join(f"{i},u\n" for i in range(1000)))
    put(tmp_path, "late.txt", " \n" * 30_000 + '{"event_id":"j"}\n')
    put(tmp_path, "early.csv", "user_id,event_id\nv,e\n")
    put(tmp_path, "blank.csv", "\n" * 50_000)
    got = landed(spark, tmp_path, "event_id", "user_id")
    assert len(got) == 1002 and {("7", "u"), ("999", "u"), ("j", None), ("e", "v")} <= set(got)


def test_a_thousand_headers_are_one_scan(spark, tmp_path):
    for i in range(1000):
        extra = [f"extra_{i}_{k}" for k in range(i % 7)]
        put(tmp_path, f"{i}.{('csv', 'txt')[i % 2]}", ",".join([*extra, "event_id", f"only_{i}"]) + "\n" + ",".join([*extra, str(i), "x"]) + "\n")
    (source,) = landing_sources(spark, str(tmp_path), EVENTS)
    plan = source.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and plan.count("FileScan parquet") == 1  # lines, and the written layouts
    assert sorted(int(r[0]) for r in source.rows.select("event_id").collect()) == list(range(1000))
    assert {r["column"] for r in source.names.where("column like 'only%'").collect()} == {f"only_{i}" for i in range(1000)}


def test_a_header_may_name_a_column_twice(spark, tmp_path):
    put(tmp_path, "a.csv", "event_id,user id,user.id,extra\n1,,u,x\n2,v,w,\nevent_id,user id,user.id,extra\n3\n")
    assert landed(spark, tmp_path, "event_id", "user_id") == [("1", "u"), ("2", "v"), ("3", None)]


def parquet_file(spark, folder, name, sql):
    spark.sql(sql).coalesce(1).write.parquet(str(folder / f"_{name}"))
    (file,) = (folder / f"_{name}").glob("*.parquet")
    file.rename(folder / name)


def test_parquet_types_that_clash(spark, tmp_path):
    parquet_file(spark, tmp_path, "part-1.parquet", "select 1 event_id, 'u' user_id, 1.5D amount, timestamp'2024-01-01' ts")
    parquet_file(spark, tmp_path, "part-2.parquet", "select 3000000000L event_id, 'v' user_id, 2.5D amount")
    parquet_file(spark, tmp_path, "part-3.parquet", "select 'x' event_id, 7 user_id, '1,5' amount, '2024-01-02' ts")
    parquet_file(spark, tmp_path, "part-4.parquet", "select 'y' event_id, 8L user_id, '2,5' amount, named_struct('n', 1) message")
    parquet_file(spark, tmp_path, "part-5.parquet", "select 5 event_id, 'w' `user id`, cast(0.1 as float) amount")
    want = [
        ("1", "u", "1.5", "2024-01-01 00:00:00", None), ("3000000000", "v", "2.5", None, None), ("5", "w", "0.1", None, None),
        ("x", "7", "1,5", "2024-01-02", None), ("y", "8", "2,5", None, '{"n":1}'),
    ]
    assert landed(spark, tmp_path, "event_id", "user_id", "amount", "ts", "message") == want
    sources = landing_sources(spark, str(tmp_path), EVENTS)
    assert len(sources) == 3  # whole numbers widen, so five files are three scans
    put(tmp_path, "a.json", '{"event_id":"6"}')
    assert len(landed(spark, tmp_path, "event_id")) == 6


def test_many_files_of_few_schemas_are_few_scans(spark, tmp_path):
    spark.range(40).selectExpr("id event_id").repartition(20, "event_id").write.parquet(str(tmp_path / "a"))
    spark.range(40, 80).selectExpr("cast(id as string) event_id").repartition(20, "event_id").write.parquet(str(tmp_path / "b"))
    for n in "ab":
        for i, file in enumerate((tmp_path / n).glob("*.parquet")):
            file.rename(tmp_path / f"{n}{i}.parquet")
    assert len(landing_sources(spark, str(tmp_path), EVENTS)) == 2
    assert sorted(int(r[0]) for r in landed(spark, tmp_path, "event_id")) == list(range(80))


def test_drift_report(spark, tmp_path):
    put(tmp_path, "a.json", '{"user_id":"1","na.me":"x","odd key":1}\nnot json\n{"city":2}')
    put(tmp_path, "b.csv", "email,extra_1\n2,3\n")
    drift = {(r["column"], r["status"]) for r in drift_report(spark, str(tmp_path), USERS).collect()}
    assert {c for c, s in drift if s == "extra"} == {"odd_key", "extra_1", "na_me"}
    assert {c for c, s in drift if s == "missing"} == {"name", "phone", "age", "updated_at", "year", "month", "day"}


def test_loose_folder(spark, tmp_path):
    folder = tmp_path / "transactions"
    folder.mkdir()
    assert read_loose(spark, str(folder)) is None
    put(folder, "a.json", '{"id":"1","amount":5}')
    put(folder, "b.csv", "id,status\n2,ok\n")
    df = read_loose(spark, str(folder))
    assert sorted(r["tx_id"] for r in df.collect()) == ["1", "2"] and "id" not in df.columns
    assert read_loose(spark, str(tmp_path / "absent")) is None


# --- audit ---


@pytest.mark.parametrize(
    "name, verdict",
    [("a.csv", "valid"), ("A.CSV", "valid"), ("a.csv.gz", "valid"), ("a.json", "valid"), ("a.json.gz", "valid"),
     ("a.ndjson", "valid"), ("a.ndjson.gz", "valid"), ("a.txt", "valid"), ("a.bin.gz", "valid"),
     ("part-0.parquet", "valid"), ("data.parquet", "bad_extension"), ("a.xml", "bad_extension"),
     ("a.json.txt", "valid"), ("_SUCCESS", "metadata"), ("x/.part-0.parquet.crc", "metadata"),
     ("_success.csv", "metadata")],
)
def test_verdict_by_name(spark, name, verdict):
    df = judged(spark.createDataFrame([(name, 5)], "path string, length bigint"))
    assert df.first()["verdict"] == verdict


def test_audit_and_routing(spark, tmp_path):
    put(tmp_path, "a.json", '{"a":1}')
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "c.xml", "<a/>")
    (tmp_path / "bad.csv.gz").write_bytes(b"not gzip at all")
    (tmp_path / "part-1.parquet").write_bytes(b"not parquet at all")
    by_name = landing_audit(spark, str(tmp_path), "events")
    assert routed(by_name).good.count() == 3 and routed(by_name).rejected.count() == 2
    probed = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in landing_audit(spark, str(tmp_path), "events", True).collect()}
    assert probed == {
        "a.json": "valid", "empty.csv": "unreadable", "c.xml": "bad_extension", "bad.csv.gz": "unreadable",
        "part-1.parquet": "unreadable",
    }
    assert landing_audit(spark, str(tmp_path / "absent"), "events").count() == 0


def test_transactions_schema_reads_too(spark, tmp_path):
    put(tmp_path, "a.csv", "tx.id,user_id\n1,u\n")
    assert landed(spark, tmp_path, "tx_id", "user_id", spec=TRANSACTIONS) == [("1", "u")]
