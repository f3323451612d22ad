"""Synchronous rounds of the in-batch softmax trainer (R4b) inside one barrier stage per epoch.

Embedding rows are dealt to the tasks of a barrier stage, which keep them in memory for the
epoch and between epochs write them to the shared checkpoint folder, so that no row is shuffled.  In every round the owners of the rows that its pairs touch write these to the shared
checkpoint folder, a task reads those of its batches, computes gradients and writes them
back, and the owners sum them per row and make one Adam update.  Only touched rows
move.  Tasks wait for each other's files (Spark's own barrier answers once a second only; the barrier stage sees
to it that all tasks run, and ends all if one fails); a file goes when all have gone on.
After the rounds the rows are sent once more for the loss of all batches, some rounds at a time.

All tasks read the round's pairs (ids as numbers: ``place * tasks + owner``) in the same order,
so files hold vectors only and the sums, in the order of the pairs, do not depend on the
number of tasks.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the last epoch, and of every task the summed loss of its batches and their pairs (side ``l``).
OUT_SCHEMA = "side string, id string, features array<double>, loss double, pairs long"
#: Rows that a task hands back to Spark at a time.
OUT_ROWS = 10_000
#: Rounds whose loss is found together.
LOSS_ROUNDS = 4


def tasks_at_once(spark) -> int:
    """Tasks of a barrier stage, which must all run together; 0 where barrier stages are not to be had."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true" or spark.conf.get("spark.default.parallelism", None):
        return 0   # the cores are not known
    return spark.sparkContext.defaultParallelism // int(spark.conf.get("spark.task.cpus", "1"))


def deal(ids: DataFrame, start: Column, path: str, tasks: int) -> DataFrame:
    """Write the distinct ``id`` with their vectors ``start``, a folder for each owner; ``(id, place, owner)``, the place being that among the owner's rows."""
    owner = F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")
    place = (F.row_number().over(Window.partitionBy("owner").orderBy("id")) - 1).cast("long")
    rows = ids.withColumn("owner", owner).repartition(tasks, "owner").select("owner", F.col("id").cast("string").alias("id"), place.alias("place"))
    rows.withColumn("features", start).write.partitionBy("owner").parquet(path)
    return ids.sparkSession.read.schema("id string, place long, owner int").parquet(path)


def numbered(pairs: DataFrame, users: DataFrame, items: DataFrame, tasks: int) -> DataFrame:
    """``(user_id, item_id, u, i)``: the pairs with the numbers of their rows."""
    number = (F.col("place") * F.lit(tasks) + F.col("owner"))
    for rows, side, c in ((users, "u", "user_id"), (items, "i", "item_id")):
        pairs = pairs.join(rows.select(F.col("id").alias(c), number.alias(side)).hint("merge"), c)
    return pairs.select("user_id", "item_id", "u", "i")


def write_rounds(batched: DataFrame, path: str) -> None:
    """The numbered pairs by ``round``, a folder each, in the order of their batches."""
    held = batched.select("round", "batch_id", "u", "i").repartition("round").sortWithinPartitions("round", "batch_id", "u", "i")
    held.write.partitionBy("round").parquet(path)


class Shared:
    """Files below a shared folder: a mounted one, or one that pyarrow opens by itself."""

    def __init__(self, root: str):
        from pyarrow import fs
        self.system, self.root = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))

    def columns(self, folder: str, names: list[str]) -> list[pa.ChunkedArray]:
        """Columns of the table in a folder (one file, or none)."""
        import pyarrow.parquet as pq
        from pyarrow import fs
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        files = sorted(f.path for f in found if f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
        if len(files) > 1:
            raise ValueError(f"{folder} holds several files")
        if not files:
            return [pa.chunked_array([], pa.null()) for _ in names]
        with self.system.open_input_file(files[0]) as f:
            table = pq.ParquetFile(f).read(columns=names)
        return [table.column(c) for c in names]

    def pairs(self, folder: str) -> tuple[np.ndarray, ...]:
        """Batch, user number and item number of the pairs in a folder."""
        return tuple(c.to_numpy().astype(np.int64, copy=False) for c in self.columns(folder, ["batch_id", "u", "i"]))

    def load(self, name: str) -> bytes:
        """A whole file."""
        with self.system.open_input_file(f"{self.root}/{name}") as f:
            return f.read()

    def write(self, name: str, values: list[np.ndarray]) -> None:
        self.system.create_dir(f"{self.root}/{name}".rpartition("/")[0])
        with self.system.open_output_stream(f"{self.root}/{name}.part") as f:
            for v in values:
                f.write(np.ascontiguousarray(v).data)
        self.system.move(f"{self.root}/{name}.part", f"{self.root}/{name}")   # whole when it is seen

    def wait(self, names: list[str]) -> None:
        """Until all the files are there."""
        from pyarrow import fs
        left, pause = [f"{self.root}/{n}" for n in names], 0.001
        while left := [f.path for f in self.system.get_file_info(left) if f.type == fs.FileType.NotFound]:
            time.sleep(pause)
            pause = min(pause * 1.5, 0.02)

    def remove(self, name: str) -> None:
        self.system.delete_file(f"{self.root}/{name}")

    def read(self, name: str, parts: list[tuple[int, int]], dim: int) -> list[np.ndarray]:
        """Rows ``lo`` to ``hi`` of a file, for every part."""
        with self.system.open_input_file(f"{self.root}/{name}") as f:
            return [np.frombuffer(f.read_at((hi - lo) * dim * 8, lo * dim * 8), np.float64).reshape(-1, dim) for lo, hi in parts]


class _Side:
    """Of one side of a round: which pairs' rows an owner sends to a task, and in which order."""

    def __init__(self, ids: np.ndarray, task: np.ndarray, tasks: int):
        self.slot, owner = ids // tasks, ids % tasks
        self.by_owner = np.argsort(owner * tasks + task, kind="stable")
        self.by_task = np.argsort(task * tasks + owner, kind="stable")
        count = np.bincount(owner * tasks + task, minlength=tasks * tasks).reshape(tasks, tasks)
        self.sent = np.concatenate([[0], np.cumsum(count)])             # bounds in by_owner, of owner * tasks + task
        self.got = np.concatenate([[0], np.cumsum(count.T)])            # bounds in by_task, of task * tasks + owner


class _Rows:
    """The embedding rows of one side that a task owns."""

    def __init__(self, w: np.ndarray, m: np.ndarray, v: np.ndarray, t: np.ndarray):
        self.w, self.m, self.v, self.t = w, m, v, t

    @classmethod
    def first(cls, shared: Shared, folder: str, dim: int) -> _Rows:
        place, w = shared.columns(folder, ["place", "features"])
        if (place.to_numpy() != np.arange(len(place))).any():
            raise ValueError("rows are missing or out of order")
        w = w.combine_chunks().flatten().to_numpy().reshape(-1, dim).copy() if len(place) else np.zeros((0, dim))
        return cls(w, np.zeros_like(w), np.zeros_like(w), np.zeros(len(w), np.int64))

    @classmethod
    def loaded(cls, held: bytes, dim: int) -> _Rows:
        n = len(held) // (8 * (3 * dim + 1))
        return cls(*np.frombuffer(held, np.float64, 3 * n * dim).reshape(3, n, dim).copy(), np.frombuffer(held, np.int64, n, 3 * n * dim * 8).copy())

    def update(self, slots: np.ndarray, grads: np.ndarray, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-7) -> None:
        """One lazy Adam step of the rows at ``slots`` by the sum of their gradients; a row counts its own steps."""
        order = np.argsort(slots, kind="stable")
        at, first = np.unique(slots[order], return_index=True)
        g = np.add.reduceat(grads[order], first, axis=0)
        t = self.t[at] = self.t[at] + 1
        m = self.m[at] = b1 * self.m[at] + (1 - b1) * g
        v = self.v[at] = b2 * self.v[at] + (1 - b2) * g * g
        step = lr * (m / (1 - b1 ** t)[:, None]) / (np.sqrt(v / (1 - b2 ** t)[:, None]) + eps)
        self.w[at] = (self.w[at] - step).astype(np.float32)


def batch_loss(u: np.ndarray, v: np.ndarray) -> float:
    """Summed in-batch softmax loss of the pairs (row k of u, row k of v)."""
    s = u @ v.T
    m = s.max(axis=1)
    right = np.diag(s).copy()
    s -= m[:, None]
    lse = m + np.log(np.exp(s, out=s).sum(axis=1))
    return float((lse - right).sum())


def gradients(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the summed in-batch softmax loss of the pairs (row k of u, row k of v)."""
    d = u @ v.T
    d -= d.max(axis=1, keepdims=True)
    np.exp(d, out=d)
    d /= d.sum(axis=1, keepdims=True)
    own = np.arange(len(u))
    d[own, own] -= 1
    return d @ v, d.T @ u


class _Sent:
    """The vectors of some pairs, sent by their owners to the tasks whose batches hold them (``name`` tells the files apart)."""

    def __init__(self, me: int, tasks: int, held: list[_Rows], pairs: tuple[np.ndarray, ...], shared: Shared, name: str):
        batch, *ids = pairs
        dim = held[0].w.shape[1]
        self.first = np.flatnonzero(np.r_[len(batch) > 0, batch[1:] != batch[:-1]])
        self.task = (np.cumsum(np.r_[0, batch[1:] != batch[:-1]]) % tasks) if len(batch) else batch
        self.sides = [_Side(x, self.task, tasks) for x in ids]
        mine = slice(me * tasks, me * tasks + tasks + 1)
        self.span = [(s.sent[mine], s.got[mine]) for s in self.sides]
        self.own = [s.by_owner[b[0]:b[-1]] for s, (b, _) in zip(self.sides, self.span)]       # pairs whose row is mine, by task
        self.asked = [s.by_task[b[0]:b[-1]] for s, (_, b) in zip(self.sides, self.span)]      # pairs of my batches, by owner
        self.files = [f"{name}-{k}" for k in range(tasks)]
        shared.write(self.files[me], [x.w[s.slot[o]] for x, s, o in zip(held, self.sides, self.own)])
        shared.wait(self.files)
        self.vectors = [np.zeros((len(batch), dim)) for _ in self.sides]
        for k in range(tasks):
            start = [s.sent[k * tasks] for s in self.sides]
            before = [0, self.sides[0].sent[(k + 1) * tasks] - start[0]]          # the items' rows follow the users'
            parts = [(n + s.sent[k * tasks + me] - a, n + s.sent[k * tasks + me + 1] - a) for s, a, n in zip(self.sides, start, before)]
            if any(hi > lo for lo, hi in parts):
                for x, o, (_, b), rows in zip(self.vectors, self.asked, self.span, shared.read(self.files[k], parts, dim)):
                    x[o[b[k] - b[0]:b[k + 1] - b[0]]] = rows
        self.batches = [(lo, hi) for lo, hi in zip(self.first, [*self.first[1:], len(batch)]) if self.task[lo] == me]   # mine


def run_round(me: int, tasks: int, held: list[_Rows], pairs: tuple[np.ndarray, ...], shared: Shared, run: str, r: int, lr: float) -> None:
    """The part of task ``me`` in a round: send rows, compute the gradients of its batches, update its rows."""
    sent = _Sent(me, tasks, held, pairs, shared, f"{run}/rows-{r}")
    if r:
        shared.remove(f"{run}/grads-{r - 1}-{me}")   # all have ended the last round
    dim, sides = held[0].w.shape[1], sent.sides
    grads = [np.zeros_like(x) for x in sent.vectors]
    for lo, hi in sent.batches:
        grads[0][lo:hi], grads[1][lo:hi] = gradients(sent.vectors[0][lo:hi], sent.vectors[1][lo:hi])
    files = [f"{run}/grads-{r}-{k}" for k in range(tasks)]
    shared.write(files[me], [g[o] for g, o in zip(grads, sent.asked)])
    shared.wait(files)
    shared.remove(sent.files[me])   # all have read it
    for k in range(tasks):
        start = [s.got[k * tasks] for s in sides]
        before = [0, sides[0].got[(k + 1) * tasks] - start[0]]
        parts = [(n + s.got[k * tasks + me] - a, n + s.got[k * tasks + me + 1] - a) for s, a, n in zip(sides, start, before)]
        if any(hi > lo for lo, hi in parts):
            for g, o, (b, _), rows in zip(grads, sent.own, sent.span, shared.read(files[k], parts, dim)):
                g[o[b[k] - b[0]:b[k + 1] - b[0]]] = rows
    for x, s, g, o in zip(held, sides, grads, sent.own):
        if len(o):
            o = np.sort(o)   # sums in the order of the pairs
            x.update(s.slot[o], g[o], lr)


def loss_of(me: int, tasks: int, held: list[_Rows], path: str, n_rounds: int, shared: Shared, run: str) -> tuple[float, int]:
    """The summed loss of this task's batches of all rounds under the rows as they are, and the number of their pairs."""
    loss, n, last = 0.0, 0, None
    for r in range(0, n_rounds, LOSS_ROUNDS):
        pairs = tuple(map(np.concatenate, zip(*(shared.pairs(f"{path}/round={k}") for k in range(r, min(r + LOSS_ROUNDS, n_rounds))))))
        sent = _Sent(me, tasks, held, pairs, shared, f"{run}/loss-{r}")
        if last:
            shared.remove(last)   # all have gone on
        last = sent.files[me]
        for lo, hi in sent.batches:
            loss, n = loss + batch_loss(sent.vectors[0][lo:hi], sent.vectors[1][lo:hi]), n + hi - lo
    return loss, n


def train_epoch(spark: SparkSession, root: str, epoch: int, last: bool, n_rounds: int, tasks: int, dim: int, lr: float) -> DataFrame:
    """The loss after the rounds stored at ``rounds-<epoch>`` (by ``write_rounds``), one synchronous update each, and with the last epoch the rows.

    The rows begin as written by ``deal`` at ``u`` and ``i``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext
        context = BarrierTaskContext.get()
        me = context.partitionId()
        shared, path = Shared(root), f"rounds-{epoch}"
        run = f"{path}/exchange-{context.allGather(uuid.uuid4().hex)[0]}"   # a repeated stage has files of its own
        held = [_Rows.loaded(shared.load(f"state-{epoch - 1}/{side}-{me}"), dim) if epoch else _Rows.first(shared, f"{side}/owner={me}", dim) for side in ("u", "i")]
        for r in range(n_rounds):
            run_round(me, tasks, held, shared.pairs(f"{path}/round={r}"), shared, run, r, lr)
        loss, n = loss_of(me, tasks, held, path, n_rounds, shared, run)
        yield _out("l", [""], np.zeros((1, 0)), loss, n)
        for side, own in zip(("u", "i"), held):
            if not last:
                shared.write(f"state-{epoch}/{side}-{me}", [own.w, own.m, own.v, own.t])
                continue
            (ids,) = shared.columns(f"{side}/owner={me}", ["id"])
            for lo in range(0, len(ids), OUT_ROWS):
                w = own.w[lo:lo + OUT_ROWS]
                yield _out(side, ids[lo:lo + len(w)].combine_chunks(), w, None, None)

    return spark.range(0, tasks, 1, tasks).mapInArrow(work, OUT_SCHEMA, barrier=True)


def _out(side: str, ids, w: np.ndarray, loss: float | None, n: int | None) -> pa.RecordBatch:
    features = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * w.shape[1], np.ascontiguousarray(w).reshape(-1))
    return pa.RecordBatch.from_arrays([pa.array([side] * len(ids)), pa.array(ids, pa.string()), features, pa.array([loss] * len(ids), pa.float64()), pa.array([n] * len(ids), pa.int64())], names=["side", "id", "features", "loss", "pairs"])
