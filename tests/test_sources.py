"""Frontiers, association payloads and request budgets against plain loops."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillrank.plans import graph
from quillrank.sources import associations
from quillrank.streaming import budgets, events


def plain_frontier(edges, seeds, levels, fanout):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
    found = {s: (0, None) for s in seeds if s is not None}
    for level, budget in enumerate(levels):
        layer = sorted(k for k, v in found.items() if v[0] == level)[:budget]
        new = {}
        for node in layer:
            for other in sorted(near.get(node, ()))[:fanout]:
                if other not in found:
                    new.setdefault(other, (level + 1, node))
        found |= new
    return found


@pytest.mark.parametrize(("levels", "fanout"), [([None, None, None], None), ([2, 5, 3], 3), ([0], 2), ([], None), ([1] * 6, 1)])
def test_frontier_equals_a_loop(spark, levels, fanout):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(7, k) for k in range(60)] + [(None, 3), (3, None), (4, 4)]
    edges += edges[:20]
    seeds = [3, 7, 3, None, 99]
    got = graph.frontier(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(s,) for s in seeds], "id int"), levels, fanout).collect()
    assert {r["id"]: (r["level"], r["via"]) for r in got} == plain_frontier(edges, seeds, levels, fanout) and len({r["id"] for r in got}) == len(got)


def test_frontier_of_nothing(spark):
    edges = spark.createDataFrame([], "src string, dst string")
    assert graph.frontier(edges, spark.createDataFrame([], "id string"), [None, 3]).collect() == []
    assert [tuple(r) for r in graph.frontier(edges, spark.createDataFrame([("a",)], "id string"), [None, 3]).collect()] == [("a", 0, None)]


def saved(spark, folder, provider, lines):
    spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in lines], "value string").coalesce(1).write.text(f"{folder}/provider={provider}")


@pytest.fixture
def folder(spark, tmp_path):
    path = f"file://{tmp_path}/payloads"
    two = [{"name": "l1", "entries": [{"key": "a"}, {"key": "b"}, {"key": "b"}, {"key": ""}, {}]}, {"name": "l2", "entries": [{"key": "b"}, {"key": "s"}]}]
    saved(spark, path, "shelves", [{"seed": "s", "lists": two}, {"seed": "t", "lists": []}, "no json", "[]", ""])
    saved(spark, path, "similar", [{"seed": "s", "recommendations": [{"key": "s"}, {"key": "c", "score": 0.9}, {"key": "c"}, {"key": None}, {"key": "d"}]}, {"seed": "t", "volumes": [{"id": f"v{k}", "info": {"title": "x"}} for k in range(50)]}, {"lists": two}])
    return path


def test_edges_of_payloads(spark, folder):
    rows = associations.payloads(spark, folder)
    assert rows.where("p is null and line <> ''").count() == 3
    got = {(r["provider"], r["seed"], r["related"]): (r["relation"], r["position"], r["weight"]) for r in associations.edges(rows).collect()}
    assert got.pop(("shelves", "s", "a")) == ("list", None, 1.0) and got.pop(("shelves", "s", "b")) == ("list", None, 2.0)
    assert got.pop(("similar", "s", "c")) == ("recommendation", 2, 0.5) and got.pop(("similar", "s", "d")) == ("recommendation", 5, 0.2)
    assert got == {("similar", "t", f"v{k}"): ("volume", k + 1, 1 / (k + 1)) for k in range(associations.MAX_PLACE)}


def test_a_filter_skips_other_providers(spark, folder):
    one = associations.payloads(spark, folder).where("provider = 'similar'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(provider" in plan and one.select("provider").distinct().collect() == [("similar",)]


READS = "id long, work string, author string, rating double, day date"


def test_provider_runs_are_audited(spark, folder):
    reads = spark.createDataFrame([(1, "s", "x", 5.0, date(2024, 1, 1)), (2, "t", "x", 2.0, None), (3, "d", "y", 3.0, None), (4, "u", "x", 4.0, date(2024, 1, 2)), (5, "w", "x", 4.0, None)], READS)
    kept = []
    run = associations.run_provider("similar", associations.saved_provider(spark, folder, "similar"), reads, lambda df: kept.extend(df.collect()))
    # Works that were read are no candidates, and seeds that weren't liked give nothing; an author has two seeds at most.
    assert (run.status, run.seeds, run.edges, run.persisted) == ("complete", 2, 1, 1) and [(r["related"], r["run"]) for r in kept] == [("c", run.id)]
    assert associations.run_provider("similar", associations.saved_provider(spark, folder, "similar"), reads).persisted == 0

    def fails(_):
        raise RuntimeError("quota\nat line 3")

    run = associations.run_provider("other", fails, reads, lambda df: kept.append(1))
    assert (run.status, run.edges, run.persisted, run.error) == ("failed", 0, 0, "quota") and len(kept) == 1


def plain_budget(batches, interval, window, most):
    out, state = {}, {}
    for batch in batches:
        for user, i, ts in sorted(batch, key=lambda x: (x[2], x[1])):
            at = int(ts.timestamp() * 1e6)
            last, mine, used = state.get(user, (None, None, 0))
            spent = used if at // int(window * 1e6) == mine else 0
            why = "interval" if last is not None and at - last < interval * 1e6 else "budget" if spent >= most else ""
            if not why:
                state[user] = (at, at // int(window * 1e6), spent + 1)
            out[i] = (user, not why, why)
    return out


def test_budgets_over_several_batches(spark, tmp_path):
    """State is carried from batch to batch, and dropped by its timer without changing a decision."""
    rng, start = random.Random(3), datetime(2024, 1, 1)
    batches, n = [], 0
    for day in range(4):
        batch = []
        for _ in range(60):
            n += 1
            batch.append((rng.randrange(5), n, start + timedelta(days=3 * day, seconds=60 * rng.randrange(1440))))
        batches.append([*batch, (9, 1000 + day, start + timedelta(days=3 * day))])
    path = tmp_path / "in"
    for k, batch in enumerate(batches):
        rows = spark.createDataFrame([(u, i, ts.isoformat()) for u, i, ts in batch], "user long, id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(f"file://{path}/{k}")
    schema = "user long, id long, ts timestamp"

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{path}")
        return events.run_to_end(budgets.budgets(source, "user", 3600, 86400, 3, "2 days"), "budgeted", f"file://{tmp_path}/state").collect()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    got = {r["id"]: (r["user"], r["allowed"], r["reason"]) for r in budgets.with_rocks(spark, run)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert got == plain_budget(batches, 3600, 86400, 3) and {w for _, _, w in got.values()} == {"", "interval", "budget"}
