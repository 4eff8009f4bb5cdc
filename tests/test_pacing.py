"""Pacing and retry with a clock of our own, a transport of our own, and no waiting."""

import json

from pyspark.sql import functions as F

from eventloom.operators import extract, pacing


class Clock:
    def __init__(self, now=1000.3):
        self.now, self.slept = now, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(round(seconds, 6))
        self.now += seconds


def body(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


def test_slots_never_meet():
    """Three tasks with clocks of one time, each as fast as it may: 30 requests a minute among them, none within two seconds."""
    times = []
    for task in range(3):
        clock = Clock()
        slots = pacing.Slots(30, task, 3, clock, clock.sleep)
        mine = [slots.wait() for _ in range(20)]
        assert all(b - a == 6 for a, b in zip(mine, mine[1:]))
        times += mine
    times.sort()
    assert len(set(times)) == 60 and min(b - a for a, b in zip(times, times[1:])) == 2
    late = Clock()
    slots = pacing.Slots(30, 0, 1, late, late.sleep)
    first = slots.wait()
    late.now += 100  # time that passed unused isn't made up for by a burst
    assert [slots.wait() - first for _ in range(3)] == [100, 102, 104]


def test_retry():
    def service(*replies):
        left, seen = list(replies), []

        def transport(request):
            seen.append(request)
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return transport, seen

    def asked(*replies):
        clock = Clock(0.0)
        transport, seen = service(*replies)
        return pacing.ask({"q": 1}, transport, pacing.Slots(6e9, 0, 1, clock, clock.sleep)), len(seen), [s for s in clock.slept if s > 0.01]

    ok = (200, {}, body(" yes "))
    assert asked(ok) == ("yes", 1, [])
    assert asked((429, {}, ""), (503, {}, ""), ok) == ("yes", 3, [4.0, 8.0])
    assert asked((429, {"Retry-After": "1.5"}, ""), (429, {"retry-after": "900"}, ""), (502, {"Retry-After": "soon"}, ""), ok) == ("yes", 4, [1.5, 30.0, 16.0])
    assert asked(*[(504, {}, "")] * 5) == (None, 4, [4.0, 8.0, 16.0])
    assert asked((400, {}, "bad"), ok) == (None, 1, [])
    assert asked(OSError("down"), ok) == (None, 1, [])


def test_errors_that_come_as_success():
    assert pacing.answer_of(body("x")) == "x"
    parts = {"choices": [{"message": {"content": [{"text": "a"}, {"content": "b"}, "c"]}}]}
    assert pacing.answer_of(json.dumps(parts)) == "abc"
    assert pacing.answer_of(json.dumps({"choices": [{"message": {"content": None, "reasoning_content": "r"}}]})) == "r"
    for bad in ("", "no json", "[]", "{}", '{"status": "error", "choices": [{"message": {"content": "x"}}]}', '{"error": {"code": 1}}', '{"detail": "no model"}', '{"choices": []}', '{"choices": [{"message": {"content": ""}}]}', '{"choices": [null]}'):
        assert pacing.answer_of(bad) is None, bad


def test_answers_of_a_table(spark):
    def transport(request):
        n = request["n"]
        return (200, {}, json.dumps({"choices": [{"message": {"content": f"said {n}"}}]})) if n % 3 else (500, {}, "")

    rows = spark.range(20).select("id", F.when(F.col("id") != 7, F.to_json(F.struct(F.col("id").alias("n")))).alias("request"))
    got = {r["id"]: r["answer"] for r in pacing.answers(rows, transport, 6e7, 3).collect()}
    assert got == {i: f"said {i}" if i % 3 and i != 7 else None for i in range(20)}


def test_models_are_asked_by_halves():
    """A model that a transport stands behind: a refused batch is asked again in halves, each try in a slot of its own."""
    clock, sizes = Clock(0.0), []

    def transport(request):
        sizes.append(len(request["rows"]))
        return (413, {}, "") if len(request["rows"]) > 2 else (200, {}, body(json.dumps([x * 2 for x in request["rows"]])))

    model = pacing.model_of(transport, lambda rows: {"rows": rows}, pacing.Slots(60, 0, 1, clock, clock.sleep), json.loads)
    assert extract.with_retry(model, [1, 2, 3, 4, 5], lambda _: -1) == [2, 4, 6, 8, 10]
    assert sizes == [5, 2, 3, 1, 2] and sum(clock.slept) >= 4
