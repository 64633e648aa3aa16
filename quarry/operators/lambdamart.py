"""LambdaMART: gradient boosted trees on lambda gradients of nDCG, trained by histograms summed over the cluster (ML-04).

Rows are packed into blocks of whole questions (a question has at most as many candidates as its run is deep).  Features
are cut into at most ``BINS`` bins by quantiles.  For every tree each block computes gradients and hessians of its pairs;
then the tree grows leaf by leaf, the leaf of the highest gain first.  One pass over the blocks serves all leaves that
might be split next: each block adds its gradients by (leaf, feature, bin), ``treeAggregate`` sums them, and the driver,
which never sees more than these histograms, chooses the splits; a right child's histogram is its parent's less its
sibling's.  Gradients are whole multiples of 2**-24, so sums do not depend on how rows are dealt.

Blocks with their scores are kept from tree to tree, in memory or on disk, and are checkpointed every ``CUT`` trees.

Defined results: missing and null features count as 0; rows of a question without a positive label bear no gradient;
equal scores keep the order of ``rank``; with no gradient at all every score is 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.store import saved, shared_dir

BINS = 255
CUT = 10
_UNIT = float(1 << 24)


def lambdas(score: np.ndarray, label: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of each row of a question: every pair of different labels pushes its rows apart by how much
    a swap would change nDCG, times how wrong the pair stands."""
    n = len(score)
    g, h = np.zeros(n), np.zeros(n)
    gain = np.exp2(label) - 1
    place = np.empty(n, np.int64)
    place[np.lexsort((rank, -score))] = np.arange(n)
    discount = 1 / np.log2(place + 2.0)
    best = (np.sort(gain)[::-1] / np.log2(np.arange(n) + 2.0)).sum()
    if best <= 0:
        return g, h
    for i in np.flatnonzero(gain > 0):  # the higher row of a pair
        lower = np.flatnonzero(label < label[i])
        swap = (gain[i] - gain[lower]) * np.abs(discount[i] - discount[lower]) / best
        wrong = 1 / (1 + np.exp(score[i] - score[lower]))
        push, bend = swap * wrong, swap * wrong * (1 - wrong)
        g[i] -= push.sum()
        h[i] += bend.sum()
        np.add.at(g, lower, push)
        np.add.at(h, lower, bend)
    return g * weight, h * weight


#: Pairs of rows whose pushes are worked out at once, of whole questions.
PAIRS = 1 << 20


def pushes(score: np.ndarray, label: np.ndarray, rank: np.ndarray, weight: np.ndarray, begin: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lambdas() of the wanted questions of a block, all their pairs at once; 0 in the others."""
    g, h = np.zeros(len(score)), np.zeros(len(score))
    if not len(begin):
        return g, h
    size = np.diff(np.append(begin, len(score)))
    of = np.repeat(np.arange(len(begin)), size)
    gain = np.exp2(label) - 1
    at = np.arange(len(score)) - begin[of]
    place = np.empty(len(score), np.int64)
    place[np.lexsort((rank, -score, of))] = at
    discount = 1 / np.log2(place + 2.0)
    best = np.add.reduceat(gain[np.lexsort((-gain, of))] / np.log2(at + 2.0), begin)
    upper = np.flatnonzero((gain > 0) & (wanted & (best > 0))[of])  # the higher rows of pairs
    many = size[of[upper]]
    ends = np.cumsum(many)
    a = 0
    while a < len(upper):
        b = max(int(np.searchsorted(ends, ends[a] - many[a] + PAIRS, side="right")), a + 1)
        if b < len(upper):  # back to where a question begins, or on to where this one ends
            back = int(np.searchsorted(of[upper], of[upper[b]], side="left"))
            b = back if back > a else int(np.searchsorted(of[upper], of[upper[a]], side="right"))
        n = many[a:b]
        i = np.repeat(upper[a:b], n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[of[i]]
        kept = label[j] < label[i]
        i, j = i[kept], j[kept]
        swap = (gain[i] - gain[j]) * np.abs(discount[i] - discount[j]) / best[of[i]]
        wrong = 1 / (1 + np.exp(score[i] - score[j]))
        push, bend = swap * wrong, swap * wrong * (1 - wrong)
        lo, hi = begin[of[upper[a]]], begin[of[upper[b - 1]]] + size[of[upper[b - 1]]]
        g[lo:hi] += np.bincount(j - lo, push, hi - lo) - np.bincount(i - lo, push, hi - lo)
        h[lo:hi] += np.bincount(j - lo, bend, hi - lo) + np.bincount(i - lo, bend, hi - lo)
        a = b
    return g * weight, h * weight


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * _UNIT)


class Tree:
    """Nodes in arrays; node 0 is the root, and a node without children has child 0."""

    def __init__(self) -> None:
        self.feature, self.bin, self.left, self.right, self.value = [0], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, bin_
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for x, v in ((self.feature, 0), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                x.append(v)
        return self.left[node], self.right[node]

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row comes to; a row whose bin is at most the split's goes left."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        on = np.arange(len(bins)) if left[0] else np.zeros(0, np.int64)
        while len(on):
            at = node[on]
            node[on] = np.where(bins[on, feature[at]] <= cut[at], left[at], right[at])
            on = on[left[node[on]] > 0]
        return node

    def pruned(self, kept: set[int], values: dict[int, float]) -> Tree:
        """The tree whose split nodes are ``kept``; leaves get their values."""
        out = Tree()
        todo = [(0, 0)]
        while todo:
            old, new = todo.pop()
            if old in kept:
                a, b = out.split(new, self.feature[old], self.bin[old])
                todo += [(self.left[old], a), (self.right[old], b)]
            else:
                out.value[new] = values[old]
        return out


class Block:
    """Whole questions: bins of the features, labels, ranks, weights, where questions begin, and scores so far."""

    def __init__(self, bins, label, rank, weight, begin, question) -> None:
        self.bins, self.label, self.rank, self.weight, self.begin, self.question = bins, label, rank, weight, begin, question
        self.score = np.zeros(len(label))
        self.g = self.h = self.in_ = None

    def moved(self, tree: Tree | None, turn: int, rows: float, seed: int) -> Block:
        """With a tree's values added, and gradients of the next turn; a question is in a turn by a hash."""
        out = Block(self.bins, self.label, self.rank, self.weight, self.begin, self.question)
        out.score = self.score if tree is None else self.score + np.array(tree.value)[tree.leaf(self.bins)]
        taken = _unit(self.question, seed * 1_000_003 + turn) < rows
        out.in_ = np.repeat(taken, np.diff(np.append(self.begin, len(self.label))))
        out.g, out.h = (_whole(x) for x in pushes(out.score, self.label, self.rank, self.weight, self.begin, taken))
        return out

    def histogram(self, tree: Tree, slots: dict[int, int], features: np.ndarray) -> np.ndarray:
        """(slot, feature, bin, [gradient, hessian, rows]) of the nodes in ``slots``."""
        shape = (len(slots), len(features), BINS + 1)
        slot_of = np.full(len(tree.feature), -1, np.int64)
        slot_of[list(slots)] = list(slots.values())
        slot = np.where(self.in_, slot_of[tree.leaf(self.bins)], -1)
        on = np.flatnonzero(slot >= 0)
        out = np.empty((*shape, 3), np.int64)
        start, g, h, cells = slot[on] * (BINS + 1), self.g[on], self.h[on], len(slots) * (BINS + 1)
        for k, f in enumerate(features):  # one column at a time
            at = start + self.bins[on, f]
            # sums of whole numbers, far below 2**53: exact in doubles
            for i, x in enumerate((g, h, None)):
                out[:, k, :, i] = np.bincount(at, x, cells).reshape(len(slots), BINS + 1)
        return out


def _unit(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 by a hash of each key."""
    x = keys.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(11)) * 2.0**-53


class LambdaMART:
    """fit() on rows question_id, rank, label, weight (1 where absent) and the columns; transform() adds model_score."""

    def __init__(self, columns: Sequence[str], leaves: int = 15, trees: int = 80, rate: float = 0.05, least: int = 10, rows: float = 0.9, features: float = 0.9, least_hessian: float = 1e-3, seed: int = 42) -> None:
        self.columns, self.leaves, self.n_trees, self.rate, self.least = list(columns), leaves, trees, rate, least
        self.rows, self.features, self.least_hessian, self.seed = rows, features, least_hessian, seed
        self.cuts: list[np.ndarray] = []
        self.trees: list[Tree] = []

    def _filled(self, rows: DataFrame) -> list:
        return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in self.columns]

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bin of each value: how many cuts lie below it."""
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, values.T)], 1).astype(np.uint8) if len(self.columns) else np.zeros((len(values), 0), np.uint8)

    def _blocks(self, rows: DataFrame, most: int = 20_000) -> DataFrame:
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
        flat = rows.select(F.xxhash64("question_id").alias("q"), F.col("rank").cast("double").alias("rank"), F.col("label").cast("double").alias("label"), weight.alias("weight"), F.array(*self._filled(rows)).alias("x"))
        ordered = flat.repartition("q").sortWithinPartitions("q", "rank")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def packed() -> pa.RecordBatch:
                q, rank, label, weight, bins = (np.concatenate(c) for c in zip(*held))
                begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                block = Block(bins, label, rank, weight, begin, q[begin])
                return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block.__dict__)], pa.binary())], names=["block"])

            for batch in batches:
                q, rank, label, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("q", "rank", "label", "weight"))
                bins = self.binned(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.columns)))
                at = 0
                if sum(len(x[0]) for x in held) >= most and held[-1][0][-1] != q[0]:
                    yield packed()
                    held = []
                while len(q) - at > most:  # cut before the question that stands at the bound
                    to = at + most
                    to = int(np.searchsorted(q[at:], q[to], side="left")) + at
                    if to == at:
                        to = int(np.searchsorted(q[at:], q[at], side="right")) + at
                    held.append((q[at:to], rank[at:to], label[at:to], weight[at:to], bins[at:to]))
                    at = to
                    if at < len(q):
                        yield packed()
                        held = []
                if at < len(q):
                    held.append((q[at:], rank[at:], label[at:], weight[at:], bins[at:]))
            if held:
                yield packed()

        return ordered.mapInArrow(pack, "block binary")

    def fit(self, rows: DataFrame) -> LambdaMART:
        spark = rows.sparkSession
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(shared_dir(spark))
        filled = rows.select(*self._filled(rows))
        steps = [i / BINS for i in range(1, BINS)]
        self.cuts = [np.unique(np.array(c)) for c in filled.approxQuantile(self.columns, steps, 0.0005)] if filled.columns else []
        n, seed = self.rows, self.seed

        def load(r) -> Block:
            block = Block.__new__(Block)
            block.__dict__.update(pickle.loads(r[0]))
            block.bins = np.asfortranarray(block.bins)  # columns are read one by one
            return block

        packed = saved(self._blocks(rows), "blocks").rdd
        deep = 2 if packed.getNumPartitions() > 16 else 1  # few partitions are summed on the driver at once
        state = packed.map(load).map(lambda b: b.moved(None, 0, n, seed)).persist(StorageLevel.MEMORY_AND_DISK)
        prior = None
        for turn in range(self.n_trees):
            use = np.sort(np.argsort(_unit(np.arange(len(self.columns)), seed * 7 + turn))[: max(1, round(self.features * len(self.columns)))])
            tree = self.grow(lambda t, s: state.treeAggregate(0, lambda acc, b: acc + b.histogram(t, s, use), lambda a, b: a + b, deep), use)  # noqa: B023
            self.trees.append(tree)
            if prior is not None:  # the tree's first sums have written the new state
                prior.unpersist()
            if turn + 1 < self.n_trees:
                prior, state = state, state.map(lambda b, t=tree, k=turn + 1: b.moved(t, k, n, seed)).persist(StorageLevel.MEMORY_AND_DISK)
                if (turn + 1) % CUT == 0:
                    state.checkpoint()
        state.unpersist()
        return self

    def best(self, histogram: np.ndarray) -> tuple[float, int, int]:
        """(gain, place of the feature, bin) of a node's best split; the first of equal gains."""
        left = histogram[:, :-1].cumsum(1)
        total = histogram.sum(1, keepdims=True)
        right = total - left
        part = lambda x: (x[..., 0] / _UNIT) ** 2 / np.maximum(x[..., 1] / _UNIT, 1e-12)
        fits = lambda x: (x[..., 2] >= self.least) & (x[..., 1] / _UNIT >= self.least_hessian)
        gain = np.where(fits(left) & fits(right), part(left) + part(right) - part(total), -np.inf)
        k = int(gain.argmax())
        return float(gain.flat[k]), k // gain.shape[1], k % gain.shape[1]

    def grow(self, histograms, use: np.ndarray) -> Tree:
        """One tree: ``histograms(tree, {node: slot})`` sums over all rows."""
        tree, known = Tree(), {}
        root = histograms(tree, {0: 0})
        if isinstance(root, int):  # no rows at all
            return tree
        known[0] = root[0]
        split = {0: self.best(root[0])}
        while True:
            leaves, kept, need = {0}, set(), []
            while len(leaves) < self.leaves:
                node = min(leaves, key=lambda x: (-split[x][0], x))
                if split[node][0] <= 0:
                    break
                if not tree.left[node]:
                    need = [x for x in leaves if split[x][0] > 0 and not tree.left[x]]
                    break
                leaves = (leaves - {node}) | {tree.left[node], tree.right[node]}
                kept.add(node)
            if not need:
                break
            for x in need:
                tree.split(x, int(use[split[x][1]]), split[x][2])
            got = histograms(tree, {tree.left[x]: i for i, x in enumerate(need)})
            for i, x in enumerate(need):
                known[tree.left[x]], known[tree.right[x]] = got[i], known[x] - got[i]
                for child in (tree.left[x], tree.right[x]):
                    split[child] = self.best(known[child])
        sums = {x: known[x][0].sum(0) for x in leaves}
        return tree.pruned(kept, {x: -self.rate * float(s[0]) / float(s[1]) if s[1] > 0 else 0.0 for x, s in sums.items()})

    def score(self, values: np.ndarray) -> np.ndarray:
        bins, out = self.binned(values), np.zeros(len(values))
        for tree in self.trees:
            out += np.array(tree.value)[tree.leaf(bins)]
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with model_score."""
        columns = [c for c in rows.columns if c != "model_score"]
        ready = rows.select(*[F.col(f"`{c}`") for c in columns], F.array(*self._filled(rows)).alias("model_score"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column("model_score").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(self.score(values))], names=[*columns, "model_score"])

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
        return ready.mapInArrow(run, f"{types}, model_score double")
