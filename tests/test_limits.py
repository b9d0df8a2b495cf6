"""Limits and bans over streams of files."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from echotrace.streaming import limits

START = datetime(2024, 1, 1)
SCHEMA = "user string, id bigint, at timestamp"


@pytest.fixture
def session(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, limits.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def arrive(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(folder / "new" / str(k)))
    (folder / "in").mkdir(exist_ok=True)
    for part in (folder / "new" / str(k)).glob("part-*"):
        part.rename(folder / "in" / f"{k:03}.json")


def run(spark, folder, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))

    def store(batch, number):
        batch.write.mode("overwrite").parquet(str(folder / "out" / f"batch={number}"))

    q = limits.limited(stream, "user", "id", "at", **options).writeStream.foreachBatch(store).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)


def stored(spark, folder):
    return sorted(((r["user"], r["id"], r["at"], r["outcome"], r["ban_expires"]) for r in spark.read.parquet(str(folder / "out")).collect()), key=lambda r: (r[0], r[2], r[1] or 0))


def plainly(rows, most, span, ban):
    out, seen, until = [], {}, {}
    for user, ident, at in sorted(rows, key=lambda r: (r[2], r[1])):
        times = seen.setdefault(user, [])
        times.append(at)
        if user in until and at < until[user]:
            out.append((user, ident, at, "banned", until[user]))
        elif sum(at - span < t <= at for t in times) > most:
            until[user] = at + ban
            out.append((user, ident, at, "over_limit", until[user]))
        else:
            out.append((user, ident, at, "run", None))
    return sorted(out, key=lambda r: (r[0], r[2], r[1]))


def test_a_ban_and_its_end(session, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    arrive(session, tmp_path, 0, [("a", k, at(k)) for k in range(4)] + [("b", 10, at(0))])
    arrive(session, tmp_path, 1, [("a", 4, at(50)), ("b", 11, at(60))])
    # Only b comes again; a's ban ends by its timer.
    arrive(session, tmp_path, 2, [("b", 12, at(200))])
    arrive(session, tmp_path, 3, [("b", 13, at(400)), ("a", 5, at(401))])
    run(session, tmp_path, most=3)
    got = [r for r in stored(session, tmp_path) if r[0] == "a"]
    assert [(r[1], r[3]) for r in got] == [(0, "run"), (1, "run"), (2, "run"), (3, "over_limit"), (4, "banned"), (None, "released"), (5, "run")]
    assert got[3][4] == got[4][4] == got[5][2] == at(63)
    assert [r[3] for r in stored(session, tmp_path) if r[0] == "b"] == ["run"] * 4


def test_a_batch_is_replayed(session, tmp_path):
    draw = random.Random(4)
    rows = [(draw.choice("abc"), k, START + timedelta(minutes=k, seconds=draw.randrange(50))) for k in range(120)]
    for k in range(3):
        arrive(session, tmp_path, k, rows[40 * k : 40 * k + 40])
    run(session, tmp_path, most=9, ban_seconds=1200)
    once = stored(session, tmp_path)
    # The last batch's end was never written down: it runs again from the state before it.
    last = max(int(f.name) for f in (tmp_path / "state" / "commits").glob("[0-9]*"))
    for f in (tmp_path / "state" / "commits").glob(f"*{last}*"):
        f.unlink()
    run(session, tmp_path, most=9, ban_seconds=1200)
    assert stored(session, tmp_path) == once
    want = plainly(rows, 9, timedelta(hours=1), timedelta(minutes=20))
    assert [r for r in once if r[3] != "released"] == want and {"run", "over_limit", "banned"} == {r[3] for r in want}


def test_ties_nulls_and_late_requests(session, tmp_path):
    arrive(session, tmp_path, 0, [("a", 1, START), ("a", 2, START), (None, 3, START), ("a", 4, None), ("a", 5, START + timedelta(hours=3))])
    # A batch's watermark holds for what comes after the next one: then request 6 is three hours late.
    arrive(session, tmp_path, 1, [("b", 8, START + timedelta(hours=3))])
    arrive(session, tmp_path, 2, [("a", 6, START), ("a", 7, START + timedelta(hours=3))])
    run(session, tmp_path, most=1)
    got = [(r[1], r[3]) for r in stored(session, tmp_path) if r[3] != "released"]
    assert got[:2] == [(1, "run"), (2, "over_limit")] and sorted(x for x, _ in got) == [1, 2, 5, 7, 8]
    assert dict(got)[7] == "over_limit"


class Store:
    """A user's state outside Spark; it counts the messages that Spark would get."""

    def __init__(self):
        self.calls, self.value, self.timers, self.watermark = 0, None, set(), 0

    def getValueState(self, name, schema):
        return self

    getListState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.update(None)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)

    def getCurrentWatermarkInMs(self):
        return self.watermark


class Fired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_few_messages_for_a_user_of_many_requests():
    draw = random.Random(9)
    rows = [("a", k, START + timedelta(seconds=draw.randrange(20 * 86_400))) for k in range(30_000)]
    rows.sort(key=lambda r: r[2])
    micros = lambda at: (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    store, limit = Store(), limits.Limit(9, 600, 1200)
    limit.init(store)
    got = []
    for part in (rows[:20_000], rows[20_000:]):
        draw.shuffle(part)
        got += limit.handleInputRows(("a",), iter([{"micros": micros(at), "id": k} for _, k, at in part]), store)
    # A ban in a batch that has ended in it needs no timer, and nothing is compared with all others.
    assert store.calls <= 6 and len(store.timers) == 1
    want = plainly(rows[:2000], 9, timedelta(seconds=600), timedelta(seconds=1200))
    assert [(r.id, r.outcome) for r in got[:2000]] == [(k, outcome) for _, k, _, outcome, _ in want]
    assert {r.outcome for r in got} == {"run", "over_limit", "banned"}
    # The one timer ends the last ban and lets go of all times, in as many steps as there are things to do.
    until = max(r.ban_expires or 0 for r in got)
    store.watermark, calls = max(store.timers) + 10**9, store.calls
    fired = store.timers.pop()
    assert [(r.id, r.at, r.outcome) for r in limit.handleExpiredTimer(("a",), store, Fired(fired))] == [(None, until, "released")]
    assert store.value is None and not store.timers and store.calls - calls == 2


def test_a_timer_that_is_too_early_is_set_anew():
    store, limit = Store(), limits.Limit(1, 100, 10)
    limit.init(store)
    second = 1_000_000
    list(limit.handleInputRows(("a",), iter([{"micros": 5 * second, "id": 1}]), store))
    assert store.timers == {105_001}
    # A ban that ends sooner takes the timer's place.
    assert [r.outcome for r in limit.handleInputRows(("a",), iter([{"micros": 6 * second, "id": 3}, {"micros": 6 * second, "id": None}]), store)] == ["over_limit", "banned"]
    assert store.timers == {16_000}
    store.watermark = 16_000
    assert [(r.at, r.outcome) for r in limit.handleExpiredTimer(("a",), store, Fired(store.timers.pop()))] == [(16 * second, "released")]
    assert store.timers == {106_001}
    store.watermark = 106_001
    assert list(limit.handleExpiredTimer(("a",), store, Fired(store.timers.pop()))) == [] and store.value is None
