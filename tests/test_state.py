"""What is kept between runs: versions, syncs, phases, totals and sequential looks, broken off and run again."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import loads, trends
from quillon.sources.versions import VersionConflict, VersionedTable
from quillon.streaming import looks, totals


def rows_of(df):  # of tables (project, n)
    return sorted((r["project"], r["n"]) for r in df.collect())


@pytest.fixture
def pairs(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "project string, n int")


def test_a_job_broken_before_its_manifest_leaves_the_version_before(spark, tmp_path, pairs, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), "project")
    t.write(pairs(("1", 1), ("2", 2)))
    before = t.read()

    def broken(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", broken)
        with pytest.raises(OSError):
            t.write(pairs(("9", 9)))
    assert t.versions() == [1] and rows_of(t.read()) == rows_of(before) == [("1", 1), ("2", 2)]
    assert t.write(pairs(("3", 3))) == 2
    assert rows_of(before) == rows_of(t.read(1)) and rows_of(t.read()) == [("3", 3)]
    assert len(t.clean(keep=1)) == 2 and t.versions() == [2] and rows_of(t.read()) == [("3", 3)]


def test_replace_writes_one_value_and_leaves_the_others(spark, tmp_path, pairs):
    t = VersionedTable(spark, str(tmp_path / "t"), "project")
    t.write(pairs(("1", 1), ("2", 2), (None, 3)))
    t.append(pairs(("1", 4)))
    t.replace("1", pairs(("1", 5)))
    same = lambda v=None: sorted(((r["project"] or "", r["n"]) for r in t.read(v).collect()))
    assert same() == [("", 3), ("1", 5), ("2", 2)]
    t.replace("2", pairs())
    assert same() == [("", 3), ("1", 5)] and same(2) == [("", 3), ("1", 1), ("1", 4), ("2", 2)]
    t.compact()
    assert same() == [("", 3), ("1", 5)] and len(t.manifest()["parts"]) == 1
    with pytest.raises(Exception, match="row outside 1"):
        t.replace("1", pairs(("2", 1)))
    with pytest.raises(ValueError, match="for a table of"):
        t.append(spark.createDataFrame([("1", "x")], "project string, n string"))
    assert same() == [("", 3), ("1", 5)]


def test_a_second_writer_of_a_version_is_refused_and_a_torn_manifest_counts_as_none(spark, tmp_path, pairs):
    t = VersionedTable(spark, str(tmp_path / "t"))

    def other():
        VersionedTable(spark, t.path).write(pairs(("2", 2)))
        return {}

    with pytest.raises(VersionConflict):
        t.write(pairs(("1", 1)), other)
    assert rows_of(t.read()) == [("2", 2)]
    (tmp_path / "t" / "manifests" / f"{2:012d}").write_text('{"version": 2, "par')
    assert t.versions() == [1] and rows_of(t.read()) == [("2", 2)]
    assert t.write(pairs(("3", 3))) == 3 and t.versions() == [1, 3]
    with pytest.raises(ValueError, match="no version"):
        VersionedTable(spark, str(tmp_path / "none")).read()


def test_sync_adds_new_posts_alone_and_posts_with_conditions_only_again(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "post long, kind string, name string")
    first = rows((1, "exposure", "a"), (1, "condition", "x"), (2, "condition", "y"), (1, "exposure", "a"), (None, "exposure", "a"))
    t = loads.ledger(spark, str(tmp_path / "quirk"))
    assert loads.sync(t, first) == {"sync": 1, "mapped": 2, "skipped": 0}
    both = first.unionByName(rows((1 << 21, "exposure", "b"), (-5, "exposure", None)))
    assert loads.sync(t, both) == {"sync": 2, "mapped": 3, "skipped": 1}  # post 2 comes again
    assert sorted((r["post"], r["sync"]) for r in t.read().collect()) == [(-5, 2), (1, 1), (1, 1), (2, 1), (2, 2), (1 << 21, 2)]
    assert loads.sync(t, rows()) == {"sync": 2, "mapped": 0, "skipped": 0}
    strict = loads.ledger(spark, str(tmp_path / "strict"))
    loads.sync(strict, first, marks=("exposure", "condition"))
    assert loads.sync(strict, both, marks=("exposure", "condition")) == {"sync": 2, "mapped": 2, "skipped": 2}
    plan = strict.read().where(F.col("range").between(2, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in plan


def test_phases_are_kept_resumed_after_a_failure_and_run_again_when_a_file_changes(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(3).write.parquet(source)
    made, fail = [], [True]

    def vocabulary(read):
        made.append("vocabulary")
        return spark.read.parquet(source)

    def events(read):
        made.append("events")
        if fail[0]:
            raise RuntimeError("source away")
        return read("vocabulary").where("id > 0")

    def signals(read):
        made.append("signals")
        return read("events").agg(F.count("*").alias("n"))

    phases = [loads.Phase("vocabulary", vocabulary, inputs=(source,)), loads.Phase("events", events, needs=("vocabulary",)), loads.Phase("signals", signals, needs=("events",))]
    run = lambda skip=(): [(r["status"], r["n"]) for r in loads.run_phases(spark, str(tmp_path / "load"), phases, skip)]
    assert run() == [("done", 3), ("failed", None), ("not run", None)]
    fail[0] = False
    assert run() == [("kept", 3), ("done", 2), ("done", 1)]
    assert run() == [("kept", 3), ("kept", 2), ("kept", 1)] and made == ["vocabulary", "events", "events", "signals"]
    spark.range(3, 5).write.mode("append").parquet(source)
    assert run(skip=("vocabulary",)) == [("skipped", None), ("kept", 2), ("kept", 1)]
    assert run() == [("done", 5), ("done", 4), ("done", 1)]
    log = loads.runs(spark, str(tmp_path / "load"))
    assert log.where("status = 'failed'").select("run", "phase", "error").collect() == [(1, "events", "RuntimeError: source away")]
    assert log.agg(F.max("run")).first()[0] == 5


def test_totals_of_each_batch_equal_a_full_count_and_a_replay_adds_nothing(spark, tmp_path):
    flags = {"large": F.col("v") > 1}
    batches = [[("a", 1), ("a", 2), (None, 3)], [("b", 5), ("a", None)], [(None, 2)]]
    frames = [spark.createDataFrame(b, "kind string, v int") for b in batches]
    source, t = str(tmp_path / "source"), VersionedTable(spark, str(tmp_path / "table"))
    so_far = None
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
        got = totals.run_available(stream, t, str(tmp_path / "state"), ["kind"], flags)  # the query starts again each time
        so_far = f if so_far is None else so_far.unionByName(f)
        assert sorted(map(str, got.collect())) == sorted(map(str, totals.counted(so_far, ["kind"], flags).collect()))
        note = t.manifest()["note"]
        assert (note["batch"], note["ticks"], note["total"], note["last"]) == (i, i + 1, sum(map(len, batches[: i + 1])), len(batches[i]))
    before = t.versions()
    assert not totals.add_batch(t, frames[2], 2, ["kind"], flags) and t.versions() == before


def reference_looks(series, alpha=0.05):
    """One key's looks, row by row."""
    c = mu = best = 0.0
    crossed, out = None, []
    x, y = zip(*trends.critical_values(alpha))
    for i, (look, n, expected) in enumerate(sorted(series), 1):
        c, mu = c + n, mu + expected
        llr = c * math.log(c / mu) - (c - mu) if c > mu > 0 else 0.0
        best = max(best, llr)
        if c <= x[0]:
            cv = y[0]
        elif c > x[-1]:
            cv = y[-1] + 0.3 * math.log(c / x[-1])
        else:
            k = next(k for k in range(1, len(x)) if c <= x[k])
            cv = y[k - 1] + (y[k] - y[k - 1]) * (c - x[k - 1]) / (x[k] - x[k - 1])
        if crossed is None and cv > 0 and best >= cv:
            crossed = look
        out.append((i, int(c), round(mu, 6), round(llr, 6), round(best, 6), round(cv, 6), crossed))
    return out


def test_looks_are_the_same_from_one_batch_from_three_and_after_a_restart(spark, tmp_path):
    days = [f"2024-01-0{d}" for d in range(1, 10)]
    series = {"up": [(d, 3 * i, 2.0) for i, d in enumerate(days)], "flat": [(d, 2, 2.0) for d in days], "much": [(d, 900, 850.0) for d in days], "none": [(d, 0, 0.0) for d in days]}
    rows = [(k, d, n, e) for k, s in series.items() for d, n, e in s]
    make = lambda r: spark.createDataFrame(r, "drug string, day string, n long, expected double").select("drug", F.to_timestamp("day").alias("look"), "n", "expected")

    def tested(name, cuts):
        source, folder, got = str(tmp_path / f"{name}-source"), str(tmp_path / name), None
        for low, high in cuts:  # each run starts the query again from its state
            make([r for r in rows if low <= r[1] <= high]).coalesce(1).write.mode("append").parquet(source)
            got = looks.run_available(spark.readStream.schema(make(rows).schema).parquet(source), "drug", folder)
        out = {k: [] for k in series}
        for r in got.orderBy("drug", "look").collect():
            out[r["drug"]].append((r["looks"], r["c"], round(r["mu"], 6), round(r["llr"], 6), round(r["max_llr"], 6), round(r["critical"], 6), r["first_crossing"] and f"{r['first_crossing']:%Y-%m-%d}"))
        return out

    want = {k: reference_looks(s) for k, s in series.items()}
    assert want["up"][-1][-1] and not want["flat"][-1][-1] and want["much"][-1][1] > 1000
    assert tested("one", [(days[0], days[-1])]) == want
    assert tested("three", [(days[0], days[2]), (days[3], days[3]), (days[4], days[-1])]) == want


def test_counts_that_come_late_join_the_next_look(spark, tmp_path):
    source = str(tmp_path / "source")
    got = None
    for part in ([("a", "2024-01-01", 1, 1.0), ("a", "2024-01-03", 1, 1.0)], [("a", "2024-01-02", 5, 1.0)], [("a", "2024-01-04", None, 1.0), ("a", "2024-01-04", 2, None)]):
        df = spark.createDataFrame(part, "drug string, day string, n long, expected double").select("drug", F.to_timestamp("day").alias("look"), "n", "expected")
        df.coalesce(1).write.mode("append").parquet(source)
        got = looks.run_available(spark.readStream.schema(df.schema).parquet(source), "drug", str(tmp_path / "state"))
    assert [(r["looks"], r["c"], r["mu"]) for r in got.orderBy("look").collect()] == [(1, 1, 1.0), (2, 2, 2.0), (3, 9, 4.0)]


@pytest.mark.parametrize("alpha", [0.05, 0.01])
def test_boundary_of_a_number_and_of_a_column(spark, alpha):
    n = [0, 1, 2, 7, 9, 1000, 1001, 50_000]
    got = spark.createDataFrame([(i,) for i in n], "n long").select(trends.critical_value(F.col("n"), alpha)).collect()
    assert [r[0] for r in got] == pytest.approx([looks.boundary(i, alpha) for i in n])
    assert looks.boundary(1000) == 4.28 and looks.boundary(2718) == pytest.approx(4.28 + 0.3 * math.log(2.718)) and looks.boundary(4) == 1.63
