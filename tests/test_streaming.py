from __future__ import annotations

from kinloom.streaming import incremental


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = [(1, "jose vaca"), (2, "maria"), (3, "jozé")]
    known = spark.createDataFrame([("jose baca",), ("jose",)], "name string")
    table = spark.createDataFrame(rows, "id long, name string")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, name string").parquet(str(tmp_path / "in"))
    q = incremental.link_stream(stream, known).writeStream.format("memory").queryName("linked").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    got = sorted(map(tuple, spark.table("linked").collect()))
    assert got == sorted(map(tuple, incremental.link_stream(table, known).select("id", "name", "known", "distance").collect())) and len(got) == 2


def test_windows(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' t, 'a' k union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'a'")
    assert sorted(r["n"] for r in incremental.windowed_counts(df, "t", "k").collect()) == [1, 2]


def test_names_seen_earlier_in_a_stream(spark, tmp_path):
    """Several batches, with names that come again, near names inside one batch, and an empty batch; the result is that of the table."""
    import random

    r = random.Random(21)
    names = ["".join(r.choice("abvcs") for _ in range(r.randint(1, 7))) for _ in range(40)]
    rows = [(k, r.choice(names)) for k in range(120)] + [(500, None), (501, "new"), (502, "mew")]
    parts = [rows[:50], rows[50:51], [], rows[51:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "id long, name string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        out = incremental.advance(spark, f"file://{tmp_path}/in", "id long, name string", incremental.link_seen, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        so_far = spark.createDataFrame(sum(parts[: k + 1], []), "id long, name string")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, incremental.link_earlier(so_far).collect()))
    assert out.count() > 100 and (502, "mew", 501, "new", 1) in {tuple(x) for x in out.collect()}


def test_a_stream_meets_known_names_on_pieces(spark, tmp_path):
    import random

    r = random.Random(22)
    word = lambda: "".join(r.choice("abvcs") for _ in range(r.randint(0, 8)))
    known = spark.createDataFrame([(word(),) for _ in range(150)], "name string")
    table = spark.createDataFrame([(k, word()) for k in range(150)], "id long, name string")
    table.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long, name string").parquet(f"file://{tmp_path}/in")
    q = incremental.link_stream(stream, known).writeStream.format("memory").queryName("pieces").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, incremental.link_stream(table, known).select("id", "name", "known", "distance").collect()))
    assert sorted(map(tuple, spark.table("pieces").select("id", "name", "known", "distance").collect())) == want and len(want) > 50


def test_records_of_one_name_are_compared_once(monkeypatch):
    """One piece in two batches: pairs by the order of ids, each two names compared once in a batch however many records they have."""
    import pandas as pd

    class State:
        def __init__(self):
            self.kept = {}

        def iterator(self):
            return iter(self.kept.items())

        def updateValue(self, key, value):
            self.kept[key] = value

    state, calls, distance = State(), [], incremental.N._dp
    monkeypatch.setattr(incremental.N, "_dp", lambda a, b: calls.append((a, b)) or distance(a, b))
    one = incremental._Seen(2)
    one.names = state

    def batch(records):
        """What comes to the piece of the first letter, cut into frames."""
        calls.clear()
        frames = [pd.DataFrame({"id": [x], "name": [n]}) if x % 2 else pd.DataFrame({"id": [x, x + 100], "name": [n, n]}) for x, n in records]
        rows = pd.concat(list(incremental._gather(iter(frames))))
        own = rows.assign(ids=rows["ids"].map(lambda x: [min(x)]), own=True)
        got = pd.concat(list(one.handleInputRows(("3:0:a",), iter([rows.assign(own=False), own]), None)))
        assert len(calls) == len(set(calls))
        return sorted((x, r.name_, r.known_id, r.known) for r in got.rename(columns={"name": "name_"}).itertuples() for x in r.ids)

    first = batch([(5, "abc"), (3, "abx"), (8, "abc"), (7, "abx")])
    assert first == [(5, "abc", 3, "abx"), *[(7, "abx", k, n) for k, n in ((3, "abx"), (5, "abc"))], *[(x, "abc", k, n) for x in (8, 108) for k, n in ((3, "abx"), (5, "abc"))]]
    assert batch([(1, "abc"), (3, "abz"), (9, "abz")]) == [(1, "abc", 3, "abx"), (1, "abc", 5, "abc"), (3, "abz", 5, "abc"), *[(9, "abz", k, n) for k, n in ((3, "abx"), (3, "abz"), (5, "abc"))]]
    assert state.kept == {("abc",): (5,), ("abx",): (3,), ("abz",): (3,)}
