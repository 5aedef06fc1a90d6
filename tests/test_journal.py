"""Calls that outlive a job: what was finished is not asked again, what failed is."""

import os
import time

import pytest

from articleflow.operators import completion
from articleflow.operators.journal import read_journal, with_journal

ROWS = "id long, prompt string"


def client(folder, dies_at=None, fails=()):
    """A model that notes each call in a file; it ends its process at one prompt and fails at some."""

    def answer(system, prompt):
        if prompt == dies_at:
            time.sleep(8)
            os._exit(3)
        with open(os.path.join(folder, f"{os.getpid()}.calls"), "a") as notes:
            notes.write(prompt + "\n")
        if prompt in fails:
            raise completion.ModelError("busy")
        return f" {system}:{prompt.upper()} " if prompt != "p3" else " "

    return lambda: completion.HandlerClient(answer)


def calls(folder):
    return sorted(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().split())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def run(spark, path, factory, count=40, per_task=4):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(count)], ROWS)
    return {r.id: (r.reply, r.error) for r in with_journal(rows, factory, path, system="s", per_task=per_task).collect()}


def test_a_job_that_died_goes_on(spark, tmp_path, folder):
    path = str(tmp_path / "journal")
    with pytest.raises(Exception):
        run(spark, path, client(folder, dies_at="p17"))
    finished = [r.request for r in read_journal(spark, path).collect()]
    done, asked = len(finished), calls(folder)
    assert 0 < done < 40
    got = run(spark, path, client(folder))
    assert got == {i: (f"s:P{i}", None) if i != 3 else (None, completion.EMPTY_REPLY) for i in range(40)}
    again = [p for p in set(calls(folder)) if calls(folder).count(p) > 1 and p != "p3"]
    assert len(calls(folder)) - len(asked) <= 40 - done + 1
    # Only calls of tasks that did not end were made twice: at most one task for each of the eight threads.
    assert len(again) <= 8 * 4
    kept = {r.request for r in read_journal(spark, path).collect()}
    assert set(finished) <= kept and len(kept) == 40


def test_finished_calls_are_made_once_and_failed_ones_again(spark, tmp_path, folder):
    path = str(tmp_path / "journal")
    first = run(spark, path, client(folder, fails=("p5", "p6")), count=10)
    assert first[5] == (None, "busy") and first[3] == (None, completion.EMPTY_REPLY)
    second = run(spark, path, client(folder), count=12)
    assert second[5] == ("s:P5", None) and len(second) == 12
    assert calls(folder) == sorted([f"p{i}" for i in range(12)] + ["p3", "p5", "p6"])


def test_other_prompts_and_equal_rows(spark, tmp_path, folder):
    path = str(tmp_path / "journal")
    rows = spark.createDataFrame([(1, "p1"), (1, "p1"), (2, "p1"), (None, None)], ROWS)
    got = with_journal(rows, lambda: completion.KeyedClient({1: "one", 2: "two", None: "none"}), path, system="s").collect()
    assert sorted((r.id or 0, r.reply) for r in got) == [(0, "none"), (1, "one"), (1, "one"), (2, "two")]
    assert read_journal(spark, path).count() == 3
    assert with_journal(rows.limit(0), client(folder), path, system="s").count() == 0
