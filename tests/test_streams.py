import json
import random
from datetime import datetime, timedelta

import pytest
from callatlas.operators import lookups
from callatlas.streaming import ledger as L
from callatlas.streaming import progress as P
from callatlas.streaming import runs as R
from callatlas.streaming import tail as T

T0 = datetime(2024, 1, 1)


def event(k, **more):
    return json.dumps({"ts": (T0 + timedelta(seconds=k)).isoformat(), "event_type": "stage.start" if k % 2 == 0 else "stage.end", "analysis_id": "a", "run_id": f"r{k % 3}", "stage": f"s{k % 5}", "ref": str(k)} | more)


def drain(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()


def positions(data):
    """(position, line) of the whole lines of a file, without blank ones."""
    at, found = 0, []
    for line in data.split(b"\n")[:-1]:
        if line.strip():
            found.append((at, line.decode("utf-8", "replace").strip()))
        at += len(line) + 1
    return found


@pytest.mark.parametrize("split, block", [(1, 1), (7, 3), (64, 16), (10_000, 50)])
def test_spans_share_out_lines(tmp_path, split, block):
    rng = random.Random(split)
    data = b"".join(rng.choice([b"\n", b"a\n", b"some line\n", "é\U0001f600\n".encode(), b"x" * 90 + b"\n", b"\r\n"]) for _ in range(60)) + b"part"
    path = tmp_path / "x.jsonl"
    path.write_bytes(data)
    store, _ = T.opened(str(path))
    end = T.line_end(store, str(path), len(data), 5)
    assert end == len(data) - 4
    for first in (0, positions(data)[10][0]):
        spans = [T.Span(str(path), first, low, min(low + split, end)) for low in range(first, end, split)]
        got = [(at, line.decode()) for s in spans for at, line in T.lines_of(store, s, block)]
        assert [(at, line.strip()) for at, line in got if line.strip()] == [x for x in positions(data) if x[0] >= first]


def test_tail_goes_on_after_restarts_without_loss_or_repeat(spark, tmp_path):
    folder, out, cp = tmp_path / "runs", tmp_path / "out", tmp_path / "cp"
    (folder / "deep").mkdir(parents=True)
    one, two = folder / "one.jsonl", folder / "deep" / "two.jsonl"
    (folder / "other.txt").write_text("no ledger\n")
    rng = random.Random(4)
    added = 0
    for turn in range(4):
        with one.open("ab") as f:
            n = rng.randint(3, 30)
            f.write("".join(event(k) + "\n" for k in range(added, added + n)).encode() + b"\n  \nnot json\n")
            added += n
            f.write(event(1000 + turn).encode()[: 20 if turn < 3 else None])  # a line that is being written
        if turn == 2:
            two.write_text(event(7) + "\n" + event(8) + "\n")
        drain(T.tail_lines(spark, str(folder), splitBytes=97), out, cp)
        with one.open("ab") as f:
            f.write(event(1000 + turn).encode()[20:] + b"\n" if turn < 3 else b"\n")
    drain(T.tail_lines(spark, str(folder), splitBytes=97), out, cp)
    got = sorted((r["path"], r["event_id"], r["line"]) for r in spark.read.parquet(str(out)).collect())
    assert got == sorted((str(p), *x) for p in (one, two) for x in positions(p.read_bytes()))


def test_a_batch_that_fails_is_read_again_alike(spark, tmp_path):
    path, cp = tmp_path / "run.jsonl", tmp_path / "cp"
    path.write_text("".join(event(k) + "\n" for k in range(40)))
    seen = []

    def sink(fail):
        def write(rows, number):
            seen.append((number, sorted(r["event_id"] for r in rows.collect())))
            if fail:
                raise RuntimeError("lost")
        return write

    with pytest.raises(Exception, match="lost"):
        P.run_batches(T.tail_ledger(spark, str(path)), sink(True), str(cp), "append")
    with path.open("a") as f:
        f.write(event(40) + "\n")
    for _ in range(2):  # the batch that failed, then what was added
        P.run_batches(T.tail_ledger(spark, str(path)), sink(False), str(cp), "append")
    assert seen[0] == seen[1] and len(seen[0][1]) == 40
    assert sorted(i for _, ids in seen[1:] for i in ids) == [at for at, _ in positions(path.read_bytes())]


def test_from_the_end_and_missing_and_cut_ledgers(spark, tmp_path):
    path, out, cp = tmp_path / "run.jsonl", tmp_path / "out", tmp_path / "cp"
    path.write_text(event(0) + "\n" + event(1)[:9])
    drain(T.tail_ledger(spark, str(path), from_="end"), out, cp)
    with path.open("a") as f:
        f.write(event(1)[9:] + "\n" + event(2) + "\n")
    drain(T.tail_ledger(spark, str(path), from_="end"), out, cp)
    assert sorted(r["ref"] for r in spark.read.parquet(str(out)).collect()) == ["1", "2"]
    path.write_text(event(5) + "\n")
    with pytest.raises(Exception, match="was cut"):
        drain(T.tail_ledger(spark, str(path), from_="end"), out, cp)
    with pytest.raises(Exception, match="no ledger"):
        drain(T.tail_ledger(spark, str(tmp_path / "none"), waitSeconds=0), tmp_path / "o2", tmp_path / "c2")


def test_state_of_a_tail_equals_the_batch(spark, tmp_path):
    schema = "analysis_id string, run_id string, stage string, started timestamp, ended timestamp, n_events bigint"
    folder = tmp_path / "runs"
    for turn in range(3):
        rows = [json.loads(event(k)) | {"file": f"f{k % 2}", "k": k} for k in range(turn * 50, turn * 50 + 50)]
        T.append_ledgers(spark.createDataFrame(rows), str(folder), "file", ["k"])
        got = L.run_available(L.stage_state(T.tail_ledger(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "cp"), schema, ["analysis_id", "run_id", "stage"])
    want = L.stage_state(L.read_ledger(spark, str(folder)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 15
    for k in range(2):
        ks = [json.loads(x)["k"] for x in (folder / f"f{k}.jsonl").read_text().splitlines()]
        assert ks == list(range(k, 150, 2))


U = "analysis_id string, method string, at timestamp"
A = f"{U}, jadx_available boolean, function_summary string, confidence double"


def progressed(spark, tmp_path, turns, **options):
    for uses, analyses in turns:
        spark.createDataFrame(uses, U).write.mode("append").parquet(str(tmp_path / "u"))
        spark.createDataFrame(analyses, A).write.mode("append").parquet(str(tmp_path / "a"))
        events = P.events_of(spark.readStream.schema(U).parquet(str(tmp_path / "u")), spark.readStream.schema(A).parquet(str(tmp_path / "a")))
        P.run_batches(P.method_progress(events, **options), P.upsert(str(tmp_path / "out")), str(tmp_path / "cp"))
    return {(r["analysis_id"], r["method"]): tuple(r)[2:] for r in P.latest(spark, str(tmp_path / "out")).collect()}


def test_methods_go_from_pending_to_complete(spark, tmp_path):
    at = lambda k: T0 + timedelta(minutes=k)
    first = ([("a", "<m1>", at(0))] * 3 + [("a", "<java.X>", at(0)), ("a", "<m2>", at(0)), ("b", "<m1>", at(0)), (None, "<m3>", at(0))], [])
    assert progressed(spark, tmp_path, [first]) == {("a", "<m1>"): (3, False, "pending", None, 0.0), ("a", "<m2>"): (1, False, "pending", None, 0.0), ("b", "<m1>"): (1, False, "pending", None, 0.0), (None, "<m3>"): (1, False, "pending", None, 0.0)}
    second = ([("a", "<m2>", at(1))], [("a", "<m1>", at(1), False, "early", 0.1), ("a", "<m1>", at(2), True, "does", 0.5), ("a", "<m9>", at(2), True, "unused", 0.7), ("b", "<m1>", at(2), None, "n", None)])
    third = ([("a", "<m9>", at(3))], [])
    got = progressed(spark, tmp_path, [second, third])
    want = {("a", "<m1>"): (3, True, "complete", "does", 0.5), ("a", "<m2>"): (2, False, "pending", None, 0.0), ("a", "<m9>"): (1, True, "complete", "unused", 0.7), ("b", "<m1>"): (1, False, "no_jadx", None, 0.0), (None, "<m3>"): (1, False, "pending", None, 0.0)}
    assert got == want
    # a batch that comes again changes nothing, nor does a new base
    folder = str(tmp_path / "out")
    last = max(int(p.name[6:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    rows = spark.read.parquet(f"{folder}/batch={last}").collect()
    P.upsert(folder)(spark.createDataFrame(rows, P.ROW), last)
    read = lambda f: {(r["analysis_id"], r["method"]): tuple(r)[2:] for r in P.latest(spark, f).collect()}
    assert read(folder) == want and read(P.compacted(spark, folder)) == want
    assert sorted(map(tuple, P.totals(P.latest(spark, folder)).collect()), key=str) == [("a", 3, 2, 2), ("b", 1, 0, 0), (None, 1, 0, 0)]


def test_timers_forget_methods_that_are_done(spark, tmp_path):
    at = lambda k: T0 + timedelta(hours=k)
    turns = [([("a", "<m1>", at(0)), ("a", "<m2>", at(0))], [("a", "<m1>", at(0), True, "s", 0.5)]), ([("a", "<m3>", at(10))], []), ([("a", "<m3>", at(11))], [])]
    got = progressed(spark, tmp_path, turns, keep_seconds=3600)
    assert got[("a", "<m1>")] == (1, True, "complete", "s", 0.5)  # the artifact keeps what the state forgets
    got = progressed(spark, tmp_path, [([("a", "<m1>", at(12)), ("a", "<m2>", at(12))], [])], keep_seconds=3600)
    assert got[("a", "<m1>")][:3] == (1, False, "pending") and got[("a", "<m2>")][:3] == (2, False, "pending")


def test_run_list_changes_equal_the_difference_of_batches(spark, tmp_path):
    rng = random.Random(3)
    state, lists = {}, []
    for number in range(6):
        for _ in range(12):
            state[(f"a{rng.randrange(3)}", f"r{rng.randrange(25)}")] = rng.randrange(4)
        for k in rng.sample(sorted(state), 4 if number else 0):
            del state[k]
        lists.append(dict(state) if number != 4 else lists[-1])
    lists.append({})
    schema = "analysis_id string, run_id string, n int"
    frames = [spark.createDataFrame([(*k, n) for k, n in x.items()], schema) for x in lists]
    folder, out = str(tmp_path / "s"), str(tmp_path / "out")
    for batch in ((0, 1), (2,), (3, 4, 5), (6,)):
        for number in batch:
            R.snapshot_rows(frames[number], number, 5).write.mode("append").parquet(folder)
        P.run_batches(R.run_list_changes(spark.readStream.schema(R.ROWS).parquet(folder)), P.upsert(out), str(tmp_path / "cp"), "append")
    rows = spark.read.schema(R.CHANGES).parquet(out).collect()
    for number, now in enumerate(lists):
        before = lists[number - 1] if number else {}
        got = {(r["analysis_id"], r["run_id"]): (r["change"], r["run"] and json.loads(r["run"])["n"]) for r in rows if r["snapshot"] == number}
        want = {k: ("changed" if k in before else "added", n) for k, n in now.items() if before.get(k) != n} | {k: ("removed", None) for k in before.keys() - now.keys()}
        assert got == want and len(got) == sum(r["snapshot"] == number for r in rows)
        if number:
            key = lambda d: d.selectExpr("concat(analysis_id, '/', run_id) as run_id", "n")
            plain = {r["run_id"] for r in lookups.changed_runs(key(frames[number - 1]), key(frames[number])).collect()}
            assert plain == {"/".join(k) for k, v in got.items() if v[0] != "removed"}
    assert not [r for r in rows if r["snapshot"] == 4]


def test_a_snapshot_waits_for_all_of_its_rows(spark, tmp_path):
    runs = spark.createDataFrame([("a", f"r{k}", k) for k in range(9)], "analysis_id string, run_id string, n int")
    rows = R.snapshot_rows(runs, 1, 2).collect()
    folder, out = str(tmp_path / "s"), str(tmp_path / "out")
    later = R.snapshot_rows(runs.where("n < 4"), 2, 2).collect()
    seen = []
    for part in (rows[:5], rows[5:-1], later, rows[-1:]):
        spark.createDataFrame(part, R.ROWS).write.mode("append").parquet(folder)
        P.run_batches(R.run_list_changes(spark.readStream.schema(R.ROWS).parquet(folder)), P.upsert(out), str(tmp_path / "cp"), "append")
        seen.append({(r["snapshot"], r["run_id"], r["change"]) for r in spark.read.schema(R.CHANGES).parquet(out).collect()})
    # the last row of snapshot 1 is the mark of bucket 1, which took snapshot 2 without it; bucket 0 was whole in time
    zero = {r["run_id"] for r in rows if r["bucket"] == 0 and r["run_id"]}
    one = {r["run_id"] for r in rows if r["bucket"] == 1 and r["run_id"]}
    assert rows[-1]["bucket"] == 1 and zero and one and not {x for x in seen[0] if x[1] in one}
    assert {x for x in seen[1]} == {(1, r, "added") for r in zero}
    assert seen[2] - seen[1] == {(2, r, "removed") for r in zero if r >= "r4"} | {(2, r, "added") for r in one if r < "r4"}
    assert seen[3] == seen[2]
