"""Two-tower training by stratified stochastic gradient descent.

Users and items are hashed into ``blocks`` blocks each.  In rotation r a task holds user
block b, item block (b + r) mod blocks and the pairs between the two, so it alone holds
every row that its pairs touch: it makes one Adam update per batch of 128 pairs, one after
the other, as a single machine would.  ``blocks`` rotations see every pair once, and the
number of updates is the number of pairs / 128 (plus a short batch for each task).

Towers are an embedding, optionally followed by ReLU layers and a linear projection to the
embedding size.  The layers' weights are shared: a rotation reads one copy of them, the
tasks' gradients are summed by an aggregate, and one Adam update follows on the driver
(a few thousand numbers, whatever the data).

An epoch is one barrier stage.  Each of its workers keeps a run of neighbouring user blocks and the
item blocks that these meet; from one rotation to the next every item block moves to the
user block before, so a worker hands on one item block a rotation, through a file in the shared
checkpoint folder, and no row is shuffled.  Pairs reach a worker as numbers (the rows' places
in their blocks), sorted in the order of the batches.  With layers, the workers' sums of a
rotation are files as well.  Where barrier stages are not to be had, a rotation is a job that
shuffles the rows to the tasks that hold them and writes the new generation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.operators import rounds
from cartwheel.operators.train import BATCH_SIZE, EMBEDDING_DIM, EPOCHS, LEARNING_RATE, SEED, init_embeddings, start_vector
from cartwheel.session import ensure_checkpoint_dir, stored
from cartwheel.sources.io import remove_path

#: Embedding rows of one side that a task holds (with moments some 40 MB at 32 numbers a row).
BLOCK_ROWS = 50_000
#: Bytes of embedding rows that a worker of a barrier stage keeps in memory; more lie in mapped files.
HELD_BYTES = 1 << 29
_BETA1, _BETA2, _EPS = 0.9, 0.999, 1e-7
_ROW = "task int, kind string, block int, id string, w array<double>, m array<double>, v array<double>, t long"

Layers = list[tuple[np.ndarray, np.ndarray]]


# ------------------------------------------------------------------ towers

def glorot_layers(dim: int, units: list[int], seed: int) -> Layers:
    """Start weights of ReLU layers of the given sizes and the projection back to ``dim``; no units, no layers."""
    rng, out, last = np.random.default_rng(seed), [], dim
    for n in [*units, dim] if units else []:
        limit = (6 / (last + n)) ** 0.5
        out.append((rng.uniform(-limit, limit, (last, n)), np.zeros(n)))
        last = n
    return out


def tower(x: np.ndarray, layers: Layers) -> list[np.ndarray]:
    """The input and every layer's output; all but the last layer end in a ReLU."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        y = out[-1] @ w + b
        out.append(np.maximum(y, 0) if k + 1 < len(layers) else y)
    return out


def tower_gradients(outputs: list[np.ndarray], layers: Layers, grad: np.ndarray) -> tuple[np.ndarray, Layers]:
    """Gradients of the input and of the layers' weights, from that of the last output."""
    found = []
    for k in range(len(layers) - 1, -1, -1):
        if k + 1 < len(layers):
            grad = grad * (outputs[k + 1] > 0)
        found.append((outputs[k].T @ grad, grad.sum(axis=0)))
        grad = grad @ layers[k][0].T
    return grad, found[::-1]


def batch_gradients(u: np.ndarray, v: np.ndarray, user_layers: Layers, item_layers: Layers) -> tuple[float, np.ndarray, np.ndarray, Layers, Layers]:
    """Summed in-batch softmax loss of the pairs (row k of u, row k of v), and its gradients."""
    a, b = tower(u, user_layers), tower(v, item_layers)
    d = a[-1] @ b[-1].T
    own = np.arange(len(u))
    top, right = d.max(axis=1, keepdims=True), d[own, own].sum()
    d -= top
    np.exp(d, out=d)
    total = d.sum(axis=1, keepdims=True)
    loss = float((np.log(total) + top).sum() - right)
    d /= total
    d[own, own] -= 1
    gu, user_grads = tower_gradients(a, user_layers, d @ b[-1])
    gv, item_grads = tower_gradients(b, item_layers, d.T @ a[-1])
    return loss, gu, gv, user_grads, item_grads


def _adam(w, m, v, t, g, lr):
    m = _BETA1 * m + (1 - _BETA1) * g
    v = _BETA2 * v + (1 - _BETA2) * g * g
    return w - lr * (m / (1 - _BETA1 ** t)) / (np.sqrt(v / (1 - _BETA2 ** t)) + _EPS), m, v


class Block:
    """Embedding rows of one side that a task holds: their vectors (``state[:, 0]``), both moments and the number of their updates."""

    def __init__(self, state: np.ndarray, t: np.ndarray):
        self.state, self.t = state, t

    @classmethod
    def of(cls, part: pd.DataFrame) -> Block:
        state = np.stack([np.stack(part[c].to_numpy()) for c in ("w", "m", "v")], axis=1) if len(part) else np.zeros((0, 3, 0))
        return cls(state, part["t"].to_numpy(np.int64).copy())

    def update(self, rows: np.ndarray, grad: np.ndarray, lr: float) -> None:
        """One lazy Adam step of ``rows`` by the sum of their gradients."""
        order = np.argsort(rows, kind="stable")
        own = rows[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        g, own = (np.add.reduceat(grad[order], first, axis=0), own[first]) if len(first) < len(rows) else (grad[order], own)
        t = self.t[own] + 1
        self.t[own] = t
        s = self.state[own]
        w, m, v = s[:, 0], s[:, 1], s[:, 2]
        m *= _BETA1
        m += (1 - _BETA1) * g
        g *= g
        v *= _BETA2
        v += (1 - _BETA2) * g
        low = np.sqrt(v / (1 - _BETA2 ** t)[:, None])
        low += _EPS
        w -= m * (lr / (1 - _BETA1 ** t))[:, None] / low
        self.state[own] = s

    def frame(self, part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(w=list(self.state[:, 0]), m=list(self.state[:, 1]), v=list(self.state[:, 2]), t=self.t)


def train_pairs(users: Block, items: Block, x: np.ndarray, y: np.ndarray, user_layers: Layers, item_layers: Layers, batch_size: int, lr: float,
                sums: np.ndarray) -> tuple[float, int]:
    """One update per batch of the pairs (row x of users, row y of items); the loss and the number of batches, the layers' gradients go into ``sums``."""
    loss, steps = 0.0, 0
    for lo in range(0, len(x), batch_size):
        i, j = x[lo:lo + batch_size], y[lo:lo + batch_size]
        got, gu, gv, *layer_grads = batch_gradients(users.state[i, 0], items.state[j, 0], user_layers, item_layers)
        users.update(i, gu, lr)
        items.update(j, gv, lr)
        if len(sums):
            sums += flat(layer_grads[0] + layer_grads[1])
        loss, steps = loss + got, steps + 1
    return loss, steps


def train_block(part: pd.DataFrame, user_layers: Layers, item_layers: Layers, batch_size: int, lr: float) -> pd.DataFrame:
    """One task of a rotation: its rows after all its batches, and a row of kind ``g`` with the layers' summed gradients.

    That row's ``m`` holds the summed loss and the number of pairs, ``t`` the number of batches.
    """
    parts = [part[part["kind"] == kind] for kind in ("u", "i")]
    users, items = (Block.of(p) for p in parts)
    pairs = part[part["kind"] == "p"].sort_values(["t", "id", "other"], kind="stable")
    at = [np.array([place[k] for k in pairs[c]], np.int64) for c, place in zip(("id", "other"), ({k: n for n, k in enumerate(p["id"])} for p in parts))]
    sums = np.zeros(sum(w.size + b.size for w, b in user_layers + item_layers))
    loss, steps = train_pairs(users, items, *at, user_layers, item_layers, batch_size, lr, sums)
    told = pd.DataFrame({"kind": ["g"], "block": [0], "id": [""], "w": [sums], "m": [np.array([loss, float(len(pairs))])], "v": [np.zeros(0)], "t": [steps]})
    columns = ["kind", "block", "id", "w", "m", "v", "t"]
    out = pd.concat([f[columns] for f in (users.frame(parts[0]), items.frame(parts[1]), told) if len(f)], ignore_index=True)
    out.insert(0, "task", int(part["task"].iloc[0]))
    return out


def _task(user_layers: Layers, item_layers: Layers, batch_size: int, lr: float):
    return lambda part: train_block(part, user_layers, item_layers, batch_size, lr)


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([a.ravel() for layer in layers for a in layer]) if layers else np.zeros(0)


def shaped(values: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((values[at:at + w.size].reshape(w.shape), values[at + w.size:at + w.size + b.size]))
        at += w.size + b.size
    return out


# ------------------------------------------------------------------ training

@dataclass
class TwoTower:
    """A trained model: embedding rows, layers of both towers, and a row of history per epoch."""
    user_rows: DataFrame
    item_rows: DataFrame
    user_layers: Layers
    item_layers: Layers
    history: list[tuple[int, float, int]]

    def users(self) -> DataFrame:
        return embed(self.user_rows, self.user_layers)

    def items(self) -> DataFrame:
        return embed(self.item_rows, self.item_layers)


def embed(rows: DataFrame, layers: Layers) -> DataFrame:
    """``(id, features)``: the tower's output of each embedding row ``(id, w)``."""
    if not layers:
        return rows.select("id", F.col("w").cast("array<float>").alias("features"))

    def outputs(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "features": list(tower(np.stack(b["w"].to_numpy()), layers)[-1].astype(np.float32))})

    return rows.select("id", "w").mapInPandas(outputs, "id string, features array<float>")


def stratified_sgd(pairs: DataFrame, dim: int = EMBEDDING_DIM, epochs: int = EPOCHS, lr: float = LEARNING_RATE, batch_size: int = BATCH_SIZE,
                   blocks: int | None = None, use_dense: bool = False, dense_units: list[int] | None = None, seed: int = SEED, tasks: int | None = None) -> TwoTower:
    """Both towers trained on the distinct ``(user_id, item_id)`` with sequential Adam updates of ``batch_size`` pairs.

    Embeddings start glorot-uniform (of vocabulary + 1 rows and ``dim``), the layers as
    well; layers are built only if both ``use_dense`` and ``dense_units`` ask for them.  The result depends on the seed
    and on ``blocks`` (by default as many as keep BLOCK_ROWS rows a side in a task, at
    least 4), not on the cluster or on ``tasks``, the workers of an epoch (by default as many as run at once; 0: a job for each
    rotation).  Trains when called; pairs with a null side are left out.
    """
    spark = pairs.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/two-tower-{uuid.uuid4().hex}"
    known = pairs.where("user_id IS NOT NULL AND item_id IS NOT NULL").select(F.col("user_id").cast("string"), F.col("item_id").cast("string")).distinct()
    known.write.parquet(f"{root}/pairs")
    known = spark.read.schema("user_id string, item_id string").parquet(f"{root}/pairs")
    counts = [known.select(c).distinct().count() for c in ("user_id", "item_id")]
    blocks = blocks or max(4, -(-max(counts) // BLOCK_ROWS))
    tasks = min(rounds.tasks_at_once(spark) if tasks is None else tasks, blocks)
    units = list(dense_units or []) if use_dense else []
    job = Training(root, dim, epochs, lr, batch_size, blocks, seed, [(6 / (n + 1 + dim)) ** 0.5 for n in counts],
                   Dense(glorot_layers(dim, units, seed), glorot_layers(dim, units, seed + 1)))
    rows, history = _in_barrier_stages(known, job, tasks) if tasks and min(counts) else _in_rotations(known, job)
    return TwoTower(rows.where("kind = 'u'").select("id", "w"), rows.where("kind = 'i'").select("id", "w"), job.dense.user, job.dense.item, history)


@dataclass
class Dense:
    """The shared layers of both towers, their moments and the number of their updates."""
    user: Layers
    item: Layers
    moments: list[np.ndarray] = field(default_factory=list)
    steps: int = 0

    def values(self) -> np.ndarray:
        return flat(self.user + self.item)

    def take(self, values: np.ndarray) -> None:
        self.user, self.item = (shaped(part, like) for part, like in zip(np.split(values, [len(flat(self.user))]), (self.user, self.item)))

    def update(self, gradient: np.ndarray, lr: float) -> None:
        self.steps += 1
        values, *self.moments = _adam(self.values(), *(self.moments or [np.zeros_like(gradient)] * 2), self.steps, gradient, lr)
        self.take(values)


@dataclass
class Training:
    """What the epochs of a training share; ``limits`` bound the start vectors of users and items."""
    root: str
    dim: int
    epochs: int
    lr: float
    batch_size: int
    blocks: int
    seed: int
    limits: list[float]
    dense: Dense

    def block(self, c: str):
        return F.pmod(F.xxhash64(F.lit(c), F.col(c)), F.lit(self.blocks)).cast("int")

    def order(self, epoch: int):
        return F.xxhash64("user_id", "item_id", F.lit(self.seed + epoch))


_SIDES = (("u", "user_id"), ("i", "item_id"))
_OUT = "kind string, id string, w array<double>, m array<double>, v array<double>, t long"


def _in_barrier_stages(known: DataFrame, job: Training, tasks: int) -> tuple[DataFrame, list]:
    """The trained rows and the history; an epoch is one barrier stage of ``tasks`` workers."""
    spark, blocks = known.sparkSession, job.blocks
    numbered = known
    for n, (kind, c) in enumerate(_SIDES):
        place = (F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).cast("int")
        rows = known.select(F.col(c)).distinct().withColumn("block", job.block(c)).select("block", F.col(c).alias("id")).repartition(blocks, "block").withColumn("place", place)
        rows.withColumn("w", start_vector(job.dim, job.seed + n, job.limits[n])).write.partitionBy("block").parquet(f"{job.root}/{kind}")
        rows = spark.read.schema("id string, place int, block int").parquet(f"{job.root}/{kind}")
        numbered = numbered.join(rows.select(F.col("id").alias(c), F.col("block").alias(f"{kind}_block"), F.col("place").alias(kind)).hint("merge"), c)
    numbered = stored(numbered, "pairs")
    history = []
    for epoch in range(job.epochs):
        held = numbered.select(F.floor(F.col("u_block") * F.lit(tasks) / F.lit(blocks)).cast("int").alias("owner"),
                               F.pmod(F.col("i_block") - F.col("u_block") - F.lit(epoch), F.lit(blocks)).cast("int").alias("turn"), "u_block", job.order(epoch).alias("t"), "u", "i")
        # a place follows the order of the ids
        held = held.repartitionById(tasks, "owner").sortWithinPartitions("turn", "u_block", "t", "u", "i").select("turn", "u_block", "u", "i")
        held.mapInArrow(_worker(job, epoch, tasks), _OUT, barrier=True).write.parquet(f"{job.root}/rows-{epoch}")
        rows = spark.read.schema(_OUT).parquet(f"{job.root}/rows-{epoch}")
        told = rows.where("kind = 'g'").collect()   # a row of each worker
        loss, n_pairs, steps = (sum(r["v"][k] for r in told) for k in range(3))
        if job.dense.user:
            lead = next(r for r in told if r["w"])
            job.dense.take(np.array(lead["w"]))
            job.dense.moments, job.dense.steps = np.split(np.array(lead["m"]), 2), lead["t"]
        history.append((epoch, loss / max(n_pairs, 1), int(steps)))
        if epoch:
            remove_path(spark, f"{job.root}/state-{epoch - 1}")
    return rows, history


def _strata(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """The pairs of each turn and user block, in the order of the rows: ``((turn, user block), user places, item places)``."""
    key, parts = None, []
    for batch in batches:
        turn, block, u, i = (batch.column(n).to_numpy() for n in range(4))
        first = np.flatnonzero(np.r_[len(turn) > 0, (turn[1:] != turn[:-1]) | (block[1:] != block[:-1])])
        for lo, hi in zip(first, [*first[1:], len(turn)]):
            if key != (turn[lo], block[lo]):
                if parts:
                    yield key, *map(np.concatenate, zip(*parts))
                key, parts = (turn[lo], block[lo]), []
            parts.append((u[lo:hi], i[lo:hi]))
    if parts:
        yield key, *map(np.concatenate, zip(*parts))


class _Room:
    """Room for the rows of blocks: memory, and over ``most`` bytes unnamed files of the own temp folder, mapped, which the system may write out."""

    def __init__(self, most: int = HELD_BYTES):
        self.left = most

    def take(self, rows: int, dim: int) -> np.ndarray:
        size = rows * 3 * dim * 8
        if size <= self.left:
            self.left -= size
            return np.zeros((rows, 3, dim))
        with tempfile.TemporaryFile() as f:
            f.truncate(size)
            return np.asarray(np.memmap(f, np.float64, "r+", shape=(rows, 3, dim)))

    def free(self, state: np.ndarray) -> None:
        if state.base is None:   # not mapped
            self.left += state.nbytes

    def unpacked(self, held: bytes, dim: int) -> Block:
        n = len(held) // (8 * (3 * dim + 1))
        state = self.take(n, dim)
        state[:] = np.frombuffer(held, np.float64, n * 3 * dim).reshape(n, 3, dim)
        return Block(state, np.frombuffer(held, np.int64, n, n * 3 * dim * 8).copy())


def _worker(job: Training, epoch: int, tasks: int):
    """One worker's part of an epoch; rows come out of the last one, before it they are files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext
        context = BarrierTaskContext.get()
        me, blocks, dense = context.partitionId(), job.blocks, job.dense
        shared, run = rounds.Shared(job.root), context.allGather(uuid.uuid4().hex)[0]   # a repeated stage has files of its own
        mine, room = [b for b in range(blocks) if b * tasks // blocks == me], _Room()

        def start(kind: str, block: int) -> Block:
            if epoch:
                return room.unpacked(shared.load(f"state-{epoch - 1}/{kind}-{block}"), job.dim)
            place, w = shared.columns(f"{kind}/block={block}", ["place", "w"])
            if (place.to_numpy() != np.arange(len(place))).any():
                raise ValueError("rows are missing or out of order")
            state = room.take(len(place), job.dim)
            if len(place):
                state[:, 0] = w.combine_chunks().flatten().to_numpy().reshape(-1, job.dim)
            return Block(state, np.zeros(len(state), np.int64))

        users, items = {b: start("u", b) for b in mine}, {c: start("i", c) for c in ((b + epoch) % blocks for b in mine)}
        strata, none = _strata(batches), (None, np.zeros(0, np.int32), np.zeros(0, np.int32))
        following = next(strata, none)
        told = np.zeros(3)   # loss, pairs, batches
        for turn in range(blocks):
            before, sums = told.copy(), np.zeros_like(dense.values())
            for b in mine:
                c = (b + epoch + turn) % blocks
                if c not in items:
                    name = f"exchange-{run}/{c}-{turn}"
                    shared.wait([name])
                    items[c] = room.unpacked(shared.load(name), job.dim)
                    shared.remove(name)
                if following[0] == (turn, b):
                    _, x, y = following
                    told += [*(got := train_pairs(users[b], items[c], x, y, dense.user, dense.item, job.batch_size, job.lr, sums))[:1], len(x), got[1]]
                    following = next(strata, none)
                if b == mine[0] and turn + 1 < blocks and tasks > 1:   # the worker before needs it next
                    given = items.pop(c)
                    shared.write(f"exchange-{run}/{c}-{turn + 1}", [given.state, given.t])
                    room.free(given.state)
                    del given
            if len(sums):
                names = [f"exchange-{run}/sums-{turn}-{k}" for k in range(tasks)]
                shared.write(names[me], [np.r_[told[2] - before[2], sums]])
                shared.wait(names)
                steps, *sums = np.sum([np.frombuffer(shared.load(n)) for n in names], axis=0)
                if steps:
                    dense.update(np.array(sums) / steps, job.lr)
                if turn:
                    shared.remove(f"exchange-{run}/sums-{turn - 1}-{me}")   # all have gone on
        if following[0] is not None:
            raise ValueError("pairs are left")
        lead = me == 0 and dense.steps
        yield _batch("g", [""], dense.values()[None] if lead else np.zeros((1, 0)), np.concatenate(dense.moments)[None] if lead else np.zeros((1, 0)), told[None], dense.steps)
        for kind, held in (("u", users), ("i", items)):
            for block, rows in held.items():
                if epoch + 1 < job.epochs:
                    shared.write(f"state-{epoch}/{kind}-{block}", [rows.state, rows.t])
                    continue
                (ids,) = shared.columns(f"{kind}/block={block}", ["id"])
                for lo in range(0, len(ids), rounds.OUT_ROWS):
                    w = rows.state[lo:lo + rounds.OUT_ROWS, 0]
                    yield _batch(kind, ids[lo:lo + len(w)].combine_chunks(), w, np.zeros((len(w), 0)), np.zeros((len(w), 0)), 0)

    return work


def _batch(kind: str, ids, w: np.ndarray, m: np.ndarray, v: np.ndarray, t: int) -> pa.RecordBatch:
    n = len(ids)
    lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).reshape(-1)) for x in (w, m, v)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(ids, pa.string()), *lists, pa.array(np.full(n, t, np.int64))], names=["kind", "id", "w", "m", "v", "t"])


def _in_rotations(known: DataFrame, job: Training) -> tuple[DataFrame, list]:
    """The trained rows and the history; a rotation is a job that shuffles and writes the rows."""
    spark, root, blocks, dense = known.sparkSession, job.root, job.blocks, job.dense
    dealt = known.select(F.pmod(job.block("item_id") - job.block("user_id"), F.lit(blocks)).alias("rotation"), job.block("user_id").alias("task"), "user_id", "item_id")
    dealt.repartition("rotation", "task").write.partitionBy("rotation").parquet(f"{root}/by-rotation")
    dealt = spark.read.schema("task int, user_id string, item_id string, rotation int").parquet(f"{root}/by-rotation")

    def start(n: int) -> DataFrame:
        kind, c = _SIDES[n]
        rows = init_embeddings(known, c, job.dim, job.seed + n, job.limits[n]).withColumnRenamed("id", c)
        return rows.select(F.lit(0).alias("task"), F.lit(kind).alias("kind"), job.block(c).alias("block"), F.col(c).alias("id"), F.col("features").cast("array<double>").alias("w"),
                           F.col("m").cast("array<double>").alias("m"), F.col("v").cast("array<double>").alias("v"), F.col("t").cast("long").alias("t"))

    generation = 0
    start(0).unionByName(start(1)).write.parquet(f"{root}/rows-0")
    history = []
    for epoch in range(job.epochs):
        loss = n_pairs = steps = 0
        for turn in range(blocks):
            rotation = (epoch + turn) % blocks
            rows = spark.read.schema(_ROW).parquet(f"{root}/rows-{generation}").where("kind <> 'g'")
            rows = rows.withColumn("task", F.when(F.col("kind") == "u", F.col("block")).otherwise(F.pmod(F.col("block") - F.lit(rotation), F.lit(blocks))).cast("int"))
            own = dealt.where(F.col("rotation") == rotation).select("task", F.lit("p").alias("kind"), F.col("user_id").alias("id"), F.col("item_id").alias("other"), job.order(epoch).alias("t"))
            both = rows.unionByName(own, allowMissingColumns=True)
            trained = both.groupBy("task").applyInPandas(_task(dense.user, dense.item, job.batch_size, job.lr), _ROW)
            generation += 1
            trained.write.parquet(f"{root}/rows-{generation}")
            if generation > 1:
                remove_path(spark, f"{root}/rows-{generation - 2}")
            told = spark.read.schema(_ROW).parquet(f"{root}/rows-{generation}").where("kind = 'g'")
            sums = told.agg(F.sum(F.col("m")[0]).alias("loss"), F.sum(F.col("m")[1]).alias("pairs"), F.sum("t").alias("steps")).first()
            loss, n_pairs, steps = loss + (sums.loss or 0.0), n_pairs + (sums.pairs or 0.0), steps + (sums.steps or 0)
            if dense.user and sums.steps:
                dense.update(_summed(told, len(dense.values())) / sums.steps, job.lr)
        history.append((epoch, loss / max(n_pairs, 1), int(steps)))
    return spark.read.schema(_ROW).parquet(f"{root}/rows-{generation}"), history


def _summed(told: DataFrame, size: int) -> np.ndarray:
    """Sum of the tasks' gradients ``w``, combined on the executors (a tree of partial sums)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    total = told.select(Summarizer.sum(array_to_vector("w")).alias("s")).first()["s"]
    return np.asarray(total.toArray()) if total is not None else np.zeros(size)
