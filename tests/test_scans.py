"""State in splits of a key equals state over the whole key."""

import random

import pytest
from pyspark.sql import functions as F

from leafstream.operators import nesting, pages, scans
from leafstream.sources import datasource, framing
from leafstream.sources.type_dim import is_begin, is_end

from .test_framing import F1, opened, stream


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = []
    for key, weights in (("a", "BBEX"), ("b", "BEEX"), ("c", "BE"), ("d", "BBBE"), ("e", "E"), ("f", "X")):
        rows += [(key, i, rng.choice(weights), rng.choice([None, f"v{i}"])) for i in range(rng.randint(30, 90))]
    return spark.createDataFrame(rows, "k string, at int, kind string, v string").cache()


SPLITS = {"one": 1000, "each": 1, "sevens": 7, "thirds": 33}


@pytest.mark.parametrize("name", SPLITS)
def test_trees(log, name):
    begin, end = F.col("kind") == "B", F.col("kind") == "E"
    same(scans.nested(log, ["k"], scans.by_offset(SPLITS[name], "at"), ["at"], begin, end, "at"), nesting.nested(log, ["k"], ["at"], begin, end, "at"))


@pytest.mark.parametrize("name", SPLITS)
def test_counts_values_and_attribution(log, name):
    document, group, split = F.col("kind") == "E", F.col("kind") == "B", scans.by_offset(SPLITS[name], "at")
    same(pages.attributed(log, ["k"], ["at"], document, group, F.col("v"), split), pages.attributed(log, ["k"], ["at"], document, group, F.col("v")))
    same(pages.context(log, ["k"], ["at"], group, split), pages.context(log, ["k"], ["at"], group))


def test_no_window_runs_over_a_whole_key(log):
    plan = scans.nested(log, ["k"], scans.by_offset(7, "at"), ["at"], F.col("kind") == "B", F.col("kind") == "E", "at")._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window" in line and "__split" not in line and "__level" not in line]
    assert not wide, wide  # those over summaries name __split or __level


def test_a_file_of_ten_splits(spark, tmp_path):
    """Through the data source: numbers, pages, depths and parents equal those of the whole walk."""
    body = stream(["BDT", "BNG"]) + stream([n for n in F1 if n not in ("BDT", "EDT", "BNG", "ENG")] * 60) + stream(["ENG", "EDT", "BDT"]) + stream(["BNG", "BPG", "TLE"] * 7)
    (tmp_path / "f.afp").write_bytes(body)
    spark.dataSource.register(datasource.PrintStream)
    size = -(-len(body) // 10)
    sf = spark.read.format("printstream").option("splitBytes", size).load(str(tmp_path / "f.afp"))
    assert sf.rdd.getNumPartitions() == 10
    sf, split = sf.withColumn("file_id", F.lit("f0")), scans.by_offset(size)
    _, whole = opened(spark, body)
    begin, end = is_begin(F.col("type_id")), is_end(F.col("type_id"))
    same(scans.numbered(sf, split).select("offset", "sf_no", "page_number"), pages.context(whole, ["file_id"], ["offset"], F.col("type_id") == "D3A8AD").select("offset", "sf_no", F.col("page_no").alias("page_number")))
    same(scans.nested(sf, ["file_id"], split, ["offset"], begin, end, "offset").select("offset", "depth", "parent"), nesting.nested(whole, ["file_id"], ["offset"], begin, end, "offset").select("offset", "depth", "parent"))
    same(pages.scan_index(sf, split), pages.scan_index(whole))


def test_split_framing_has_all_columns(spark, tmp_path):
    body = stream(F1 * 30)
    (tmp_path / "f.afp").write_bytes(body)
    spark.dataSource.register(datasource.PrintStream)
    got = spark.read.format("printstream").option("splitBytes", 333).load(str(tmp_path / "f.afp")).withColumn("file_id", F.lit("f0"))
    _, whole = opened(spark, body)
    same(scans.numbered(got, scans.by_offset(333)).drop("page_number"), whole)
    assert framing.SCHEMA.startswith("file_id")


def test_paths_by_doubling(spark, monkeypatch):
    """A chain of 300 elements and a bush: as many joins as the height has binary digits."""
    rng = random.Random(8)
    rows = [("chain", i, "B") for i in range(300)] + [("bush", i, rng.choice("BBEX")) for i in range(200)] + [("flat", 0, "X")]
    log = spark.createDataFrame(rows, "k string, at int, kind string")
    tree = nesting.nested(log, ["k"], ["at"], F.col("kind") == "B", F.col("kind") == "E", "at").cache()
    put, rounds = nesting.Shelf.put, []
    monkeypatch.setattr(nesting.Shelf, "put", lambda self, df: (rounds.append(1), put(self, df))[1])
    got = {(r.k, r["at"]): list(r.path) for r in nesting.with_paths(tree, ["k"], "at").collect()}
    assert len(rounds) == 9 + 1
    stack: dict[str, list[int]] = {}
    for k, at, kind in rows:
        open_ = stack.setdefault(k, [])
        assert got[k, at] == open_
        if kind == "B":
            open_.append(at)
        elif kind == "E" and open_:
            open_.pop()
    assert all(r.path == [] for r in nesting.with_paths(tree.where("depth = 0"), ["k"], "at").collect())


def test_kept_tables_have_an_end(spark, tmp_path, monkeypatch):
    import time

    from leafstream.sources import tables

    monkeypatch.setattr(tables, "shared_folder", lambda _: str(tmp_path))

    def keep():
        with tables.Shelf(spark) as shelf:
            shelf.put(spark.range(3))
            return shelf.keep(shelf.put(spark.range(5)))

    folder = tables.shared_folder(spark)
    known = lambda: {n for n in tables.listed(spark, folder) if len(n) == 32}
    before = known()
    with tables.owned(spark):
        assert keep().count() == 5 and len(known() - before) == 1
    assert known() == before
    kept = keep()
    assert kept.count() == 5 and tables.sweep(spark, 1.0) == 0
    time.sleep(1.1)
    assert tables.sweep(spark, 0.0001) >= 1 and not known() - before


def test_growing_files_as_a_stream(spark, tmp_path):
    """Appended bytes give their new fields only, whole ones; a restart repeats none."""
    folder = tmp_path / "in"
    folder.mkdir()
    bodies = {"a.bin": stream(F1 * 40, b"\r\n"), "b.bin": stream(F1 * 3)}
    spark.dataSource.register(datasource.PrintStream)
    rng, at, counts = random.Random(2), dict.fromkeys(bodies, 0), []
    for step in range(4):
        for name, body in bodies.items():
            end = len(body) if step == 3 else rng.randint(at[name], len(body))
            with open(folder / name, "ab") as f:
                f.write(body[at[name] : end])
            at[name] = end
        given = spark.readStream.format("printstream").option("splitBytes", 500).load(str(folder))
        out = given.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert out.awaitTermination(60)
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("file_id", F.element_at(F.split("file_id", "/"), -1))
    files = spark.createDataFrame([(n, bytearray(b)) for n, b in bodies.items()], "file_id string, content binary")
    same(got, framing.frames(files).drop("sf_no"))
    assert counts == sorted(counts) and counts[-1] > counts[0]


def test_many_short_splits_share_tasks(spark, tmp_path, sf_dir):
    """Splits behind each other are one task where there are more than TASKS; the fields stay the same, each once."""
    bodies = {"a.afp": stream(F1 * 60, b"\r\n"), "b.afp": stream(F1 * 9), "c.afp": b""}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    reader = datasource.PrintStreamReader({"path": f"{tmp_path}/*.afp", "splitBytes": "30"})
    found = reader.partitions()
    assert len(found) <= datasource.TASKS + len(bodies) < sum(-(-len(b) // 30) for b in bodies.values())
    for name, body in bodies.items():
        ranges = [(p.start, p.end) for p in found if p.path.endswith(name)]
        assert [a for a, _ in ranges] == [0, *[b for _, b in ranges[:-1]]][: len(ranges)] and (not body or ranges[-1][1] == len(body))
        places = [r["offset"] for p in found if p.path.endswith(name) for b in reader.read(p) for r in b.to_pylist()]
        assert places == [at for at, _, _ in framing.walk(body)]
    few = datasource.PrintStreamReader({"path": f"{tmp_path}/b.afp", "splitBytes": "100"}).partitions()
    assert len(few) == -(-len(bodies["b.afp"]) // 100)


@pytest.mark.parametrize("name", ["fields_in_splits", "scan_in_splits"])
def test_files_in_splits_are_framed_once(spark, sf_dir, name):
    """Windows and summaries read the stored fields, not the files again."""
    from leafstream.plans.queries import QUERIES

    assert "printstream" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
