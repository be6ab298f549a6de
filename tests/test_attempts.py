"""The streaming ledger against the batch one, with attempts in any order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from textquarry.operators.ledger import fetch_ledger, id_outcomes
from textquarry.streaming.attempts import ATTEMPTS, keep_ledger, kept_ledger

START = datetime(2024, 1, 1)


def _log(ids, source):
    """Attempts up to the first final one, and some beyond, with their times in order."""
    rows = []
    for key in ids:
        for attempt in range(4):
            status = source.choice([200, 404, 503, 503, None, 418])
            rows.append((key, attempt, status, START + timedelta(minutes=key, seconds=attempt)))
            if status in (200, 404, 418) and source.random() < 0.7:
                break
    return rows


def _deliver(spark, folder, name, rows):
    spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.parquet(f"{folder}/{name}")


def test_any_order_gives_the_totals_of_the_batch(spark, tmp_path):
    source = random.Random(4)
    rows = _log(range(200), source)
    # some are delivered twice, some lack an id or a time
    shuffled = rows + source.sample(rows, 60)
    source.shuffle(shuffled)
    arrived, target, log = (str(tmp_path / n) for n in ("arrived", "target", "log"))
    for turn in range(3):
        _deliver(spark, arrived, turn, shuffled[turn::3] + [(None, 0, 200, START), (5000 + turn, 0, 200, None)])
        keep_ledger(spark, arrived, target, log, delay="2 days").awaitTermination()
    expected = spark.createDataFrame(rows, ATTEMPTS)
    told = {tuple(r) for r in spark.read.parquet(target).collect()}
    assert told == {tuple(r) for r in id_outcomes(expected).collect()}
    assert kept_ledger(spark, target, 7).first() == fetch_ledger(expected, 7).first()


def test_watermark_settles_gaps_and_drops_state(spark, tmp_path):
    arrived, target, log = (str(tmp_path / n) for n in ("arrived", "target", "log"))

    def run(name, rows):
        _deliver(spark, arrived, name, rows)
        query = keep_ledger(spark, arrived, target, log, delay="1 hour")
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return sorted(tuple(r) for r in spark.read.parquet(target).collect()), state[-1]

    # the first attempt of 1 is missing, 2 is complete, 3 has no final attempt
    first, _ = run("a", [(1, 1, 200, START), (2, 0, 503, START), (2, 1, 404, START), (3, 0, 503, START)])
    assert first == [(2, "not_found", 2)]
    later = START + timedelta(days=3)
    second, _ = run("b", [(9, 0, 200, later)])
    third, kept = run("c", [(9, 1, 200, later), (2, 1, 404, START), (1, 0, 200, START)])
    # what comes after the watermark is dropped, also the missing attempt and the repeated one
    assert third == [(1, "success", 2), (2, "not_found", 2), (9, "success", 1)]
    fourth, kept = run("d", [(10, 0, 200, later + timedelta(days=3))])
    assert (9, "success", 1) in fourth and (10, "success", 1) in fourth and len(fourth) == 4
    _, kept_after = run("e", [(10, 1, 200, later + timedelta(days=3))])
    assert kept == kept_after == 1  # only that of the last id


def test_ids_of_a_group_share_one_state(spark, tmp_path):
    arrived, target, log = (str(tmp_path / n) for n in ("arrived", "target", "log"))

    def run(name, rows):
        _deliver(spark, arrived, name, rows)
        query = keep_ledger(spark, arrived, target, log, delay="1 hour")
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return sorted(tuple(r) for r in spark.read.parquet(target).collect()), state[-1]

    # the first attempt is missing; every id has a time of its own, three hours apart
    far = 2 ** 60
    rows = [(far + key, 1, 404, START + timedelta(hours=3 * key)) for key in range(12)]
    told, kept = run("a", rows)
    # the watermark has passed all but the last of them
    assert told == [(far + key, "not_found", 2) for key in range(11)] and kept == 1
    told, kept = run("b", [(far + 11, 0, 503, START + timedelta(hours=3 * 11 + 2)),
                           (far + 12, 0, 503, START + timedelta(hours=3 * 11 + 2))])
    assert told == [(far + key, "not_found", 2) for key in range(12)] and kept == 1  # of two ids
