"""Stratified SGD: gradients, one walk in NumPy, number of updates, ranking quality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwheel.operators import evaluate as ev
from cartwheel.operators import retrieval as rt
from cartwheel.operators import sgd


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(5, 3)), rng.normal(size=(5, 3))
    towers = sgd.glorot_layers(3, [4, 6], 1), sgd.glorot_layers(3, [5], 2)
    towers = [[(w, rng.normal(size=b.shape)) for w, b in t] for t in towers]
    _, gu, gv, grads_u, grads_v = sgd.batch_gradients(u, v, *towers)
    loss = lambda: sgd.batch_gradients(u, v, *towers)[0]
    checked = [(u, gu), (v, gv)] + [(x, g) for t, gs in zip(towers, (grads_u, grads_v)) for layer, got in zip(t, gs) for x, g in zip(layer, got)]
    for values, grad in checked:
        for k in np.ndindex(values.shape):
            old = values[k]
            values[k] = old + 1e-6
            up = loss()
            values[k] = old - 1e-6
            down = loss()
            values[k] = old
            assert abs((up - down) / 2e-6 - grad[k]) < 1e-5


def plain_loss_gradients(u, v):
    """In-batch softmax by loops over pairs."""
    gu, gv, loss = np.zeros_like(u), np.zeros_like(v), 0.0
    for a in range(len(u)):
        s = [float(u[a] @ v[b]) for b in range(len(v))]
        p = np.exp(np.array(s) - max(s))
        p /= p.sum()
        loss -= np.log(p[a])
        for b in range(len(v)):
            d = p[b] - (a == b)
            gu[a] += d * v[b]
            gv[b] += d * u[a]
    return loss, gu, gv


def walked(rows, start, blocks, epochs, batch_size, lr, order):
    """All updates one after the other: rows (user, item, user block, item block)."""
    w = dict(start)
    m, v, t = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2)), None, dict.fromkeys(w, 0)
    m, v = m
    history = []
    for epoch in range(epochs):
        total, n, steps = 0.0, 0, 0
        for turn in range(blocks):
            for task in range(blocks):
                held = sorted((order[epoch][x, y], x, y) for x, y, bx, by in rows if bx == task and (by - bx) % blocks == (epoch + turn) % blocks)
                for lo in range(0, len(held), batch_size):
                    batch = held[lo:lo + batch_size]
                    keys = [("u", x) for _, x, _ in batch], [("i", y) for _, _, y in batch]
                    loss, *grads = plain_loss_gradients(*(np.array([w[k] for k in side]) for side in keys))
                    sums = {}
                    for side, grad in zip(keys, grads):
                        for k, g in zip(side, grad):
                            sums[k] = sums.get(k, 0) + g
                    for k, g in sums.items():
                        t[k] += 1
                        m[k] = 0.9 * m[k] + 0.1 * g
                        v[k] = 0.999 * v[k] + 0.001 * g * g
                        w[k] = w[k] - lr * (m[k] / (1 - 0.9 ** t[k])) / (np.sqrt(v[k] / (1 - 0.999 ** t[k])) + 1e-7)
                    total, n, steps = total + loss, n + len(batch), steps + 1
        history.append((epoch, total / n, steps))
    return w, history


def toy_pairs(spark, n=160):
    rng = np.random.default_rng(6)
    rows = {(f"u{rng.integers(25)}", f"i{rng.integers(18)}") for _ in range(n)}
    return spark.createDataFrame(sorted(rows) + sorted(rows)[:5] + [(None, "i1"), ("u1", None)], "user_id string, item_id string"), rows


def test_training_equals_a_plain_walk(spark):
    pairs, rows = toy_pairs(spark)
    blocks, epochs, dim, lr = 3, 2, 4, 0.05
    model = sgd.stratified_sgd(pairs, dim=dim, epochs=epochs, lr=lr, batch_size=8, blocks=blocks, seed=11)
    block = lambda c: F.pmod(F.xxhash64(F.lit(c), F.col(c)), F.lit(blocks)).cast("int")
    placed = [tuple(r) for r in pairs.dropna().distinct().select("user_id", "item_id", block("user_id"), block("item_id")).collect()]
    order = [{(r[0], r[1]): r[2] for r in pairs.dropna().distinct().select("user_id", "item_id", F.xxhash64("user_id", "item_id", F.lit(11 + e))).collect()} for e in range(epochs)]
    start = {}
    for side, c, seed in (("u", "user_id", 11), ("i", "item_id", 12)):
        ids = pairs.dropna().select(c).distinct()
        limit = (6 / (ids.count() + 1 + dim)) ** 0.5
        for r in sgd.init_embeddings(ids, c, dim, seed, limit).collect():
            start[side, r["id"]] = np.array(r["features"], float)
            assert np.abs(start[side, r["id"]]).max() <= limit
    wanted, history = walked(placed, start, blocks, epochs, 8, lr, order)
    got = {("u", r["id"]): r["w"] for r in model.user_rows.collect()} | {("i", r["id"]): r["w"] for r in model.item_rows.collect()}
    assert set(got) == set(wanted) and all(np.allclose(got[k], wanted[k], atol=1e-9) for k in wanted)
    assert [(e, n) for e, _, n in model.history] == [(e, n) for e, _, n in history]
    assert np.allclose([x[1] for x in model.history], [x[1] for x in history])
    assert len(rows) / 8 <= history[0][2] <= len(rows) / 8 + blocks ** 2


def test_one_dense_step_equals_numpy(spark):
    pairs, rows = toy_pairs(spark, 30)
    model = sgd.stratified_sgd(pairs, dim=4, epochs=1, lr=0.05, batch_size=1000, blocks=1, use_dense=True, dense_units=[5], seed=11)
    layers = sgd.glorot_layers(4, [5], 11), sgd.glorot_layers(4, [5], 12)
    start = []
    for c, seed in (("user_id", 11), ("item_id", 12)):
        ids = pairs.dropna().select(c).distinct()
        start.append({r["id"]: np.array(r["features"], float) for r in sgd.init_embeddings(ids, c, 4, seed, (6 / (ids.count() + 5)) ** 0.5).collect()})
    held = sorted(rows)
    _, _, _, *grads = sgd.batch_gradients(np.array([start[0][x] for x, _ in held]), np.array([start[1][y] for _, y in held]), *layers)
    for got, old, grad in zip((model.user_layers, model.item_layers), layers, grads):
        for (w, b), (w0, b0), (gw, gb) in zip(got, old, grad):
            # the first Adam step moves every weight by lr against the sign of its gradient
            assert np.allclose(w, w0 - 0.05 * gw / (np.abs(gw) + 1e-7)) and np.allclose(b, b0 - 0.05 * gb / (np.abs(gb) + 1e-7))
    one = model.user_rows.first()
    out = {r["id"]: r["features"] for r in model.users().collect()}
    assert np.allclose(out[one["id"]], sgd.tower(np.array([one["w"]]), model.user_layers)[-1][0], atol=1e-5)


@pytest.mark.parametrize("dense", [False, True])
def test_trained_towers_beat_popularity(spark, dense):
    rng = np.random.default_rng(3)
    rows, held = [], []
    for u in range(60):
        pool = [i for i in range(60) if i % 4 == u % 4]
        own = rng.choice(pool, 8, replace=False)
        rows += [(f"u{u:02d}", f"i{i:02d}") for i in own[:6]]
        held += [(f"u{u:02d}", f"i{i:02d}") for i in own[6:]]
    pairs, test = (spark.createDataFrame(r, "user_id string, item_id string") for r in (rows, held))
    model = sgd.stratified_sgd(pairs, dim=8, epochs=6, lr=0.03 if dense else 0.1, batch_size=32, blocks=2, use_dense=dense, dense_units=[16])
    assert model.history[-1][1] < model.history[0][1]
    seen = pairs.withColumnRenamed("user_id", "query_id")
    popular = pairs.groupBy(F.col("item_id").alias("id")).agg(F.array(F.count("*").cast("double")).alias("features"))
    ones = model.user_rows.select("id", F.array(F.lit(1.0)).alias("features"))
    recall = [ev.evaluate(rt.topk_flat(q, i, 10, exclude=seen).withColumnRenamed("query_id", "user_id"), test, 10).first()["recall"]
              for q, i in ((model.users(), model.items()), (ones, popular))]
    assert recall[0] > recall[1] + 0.2


def test_empty_pairs_give_an_empty_model(spark):
    model = sgd.stratified_sgd(spark.createDataFrame([], "user_id string, item_id string"), epochs=1, blocks=2)
    assert model.users().count() == model.items().count() == 0 and model.history == [(0, 0.0, 0)]


@pytest.mark.parametrize("dense", [False, True])
def test_workers_of_a_barrier_stage_equal_a_job_a_rotation(spark, dense):
    pairs, _ = toy_pairs(spark)
    kw = dict(dim=4, epochs=2, lr=0.05, batch_size=8, blocks=7, use_dense=dense, dense_units=[5])
    wanted = sgd.stratified_sgd(pairs, tasks=0, **kw)
    rows = [{r["id"]: r["w"] for r in side.collect()} for side in (wanted.user_rows, wanted.item_rows)]
    for tasks in (1, 3):
        model = sgd.stratified_sgd(pairs, tasks=tasks, **kw)
        for side, want in zip((model.user_rows, model.item_rows), rows):
            got = {r["id"]: r["w"] for r in side.collect()}
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in want)
        assert np.allclose(sgd.flat(model.user_layers + model.item_layers), sgd.flat(wanted.user_layers + wanted.item_layers))
        assert np.allclose(model.history, wanted.history)


def test_rotations_shuffle_no_rows(spark, monkeypatch):
    monkeypatch.setattr(sgd, "_in_rotations", lambda *a: pytest.fail("a job for each rotation"))
    pairs, rows = toy_pairs(spark)
    model = sgd.stratified_sgd(pairs, dim=4, epochs=1, batch_size=8, blocks=40)   # some blocks have no rows
    assert model.users().count() == len({x for x, _ in rows}) and model.items().count() == len({y for _, y in rows})


def test_a_worker_keeps_a_bound_of_rows_in_memory():
    rng = np.random.default_rng(2)
    room, plain = sgd._Room(10 * 3 * 4 * 8), sgd._Room()
    held = [rng.uniform(size=7 * 3 * 4 + 7).tobytes() for _ in range(2)]
    blocks = [room.unpacked(h, 4) for h in held]
    assert [isinstance(b.state.base, np.memmap) for b in blocks] == [False, True]
    for block, h in zip(blocks, held):
        want, rows, grad = plain.unpacked(h, 4), np.array([3, 0, 3]), rng.normal(size=(3, 4))
        for b in (block, want):
            b.t[:] = 2
            b.update(rows, grad, 0.1)
        assert np.array_equal(block.state, want.state) and block.t.tolist() == [3, 2, 2, 3, 2, 2, 2]
    room.free(blocks[0].state)
    assert room.unpacked(held[0], 4).state.base is None
