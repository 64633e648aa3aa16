"""Dictionary matching by an automaton over tokens, in flat arrays (JN-13, JN-14).

Entries (token sequences) are the paths of a trie: an edge is the number node * words + word in a sorted array, and a
node lists the entries that end there.  Tokens of a batch of texts become word numbers at once (a hash lookup in Arrow),
then all places of all texts step through the trie together; most leave it at the first token.  What matched is folded
leftmost first, longest first, without overlap.  A text is passed once, nothing is shuffled, and what travels to the
tasks is the dictionary, whose entries are counted first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries up to which a dictionary is sent to the tasks (some 100 bytes each), and tokens matched together.
ENTRIES, TOKENS = 500_000, 1 << 20


class Automaton:
    """The trie of a dictionary's entries: rows (entity_id, canonical, entity_type), canonical being words parted by
    single spaces.  Entries of the same words are tried in the order of their columns."""

    def __init__(self, entries: list[tuple[str, str, str]]) -> None:
        entries = sorted((c, i, t) for i, c, t in entries if c)
        paths = [c.split(" ") for c, _, _ in entries]
        number: dict[str, int] = {}
        edges: dict[tuple[int, int], int] = {}
        ends = []
        for path in paths:
            node = 0
            for word in path:
                node = edges.setdefault((node, number.setdefault(word, len(number))), len(edges) + 1)
            ends.append(node)
        self.words = pa.array(list(number), pa.string())
        self.base = max(1, len(number))
        key = np.array([n * self.base + w for n, w in edges], np.int64)
        by = np.argsort(key)
        self.edge, self.to = key[by], np.array(list(edges.values()), np.int64)[by]
        by = np.argsort(np.array(ends, np.int64), kind="stable")
        self.entry = by.astype(np.int64)  # entries by node
        self.first = np.searchsorted(np.array(ends, np.int64)[by], np.arange(len(edges) + 2))
        self.canonical, self.entity_id, self.entity_type = (pa.array([e[k] for e in entries], pa.string()) for k in range(3))

    def matches(self, word: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, tokens, entry) of all matches in word numbers (-1: in no entry); ``end``: where each place's text
        ends.  By start, longest first."""
        found = []
        place = np.flatnonzero(word >= 0)
        node, size = np.zeros(len(place), np.int64), 0
        while len(place):
            at = place + size
            on = np.flatnonzero(at < end[place])
            place, node, at = place[on], node[on], at[on]
            known = np.flatnonzero(word[at] >= 0)
            place, key = place[known], node[known] * self.base + word[at[known]]
            k = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = np.flatnonzero(self.edge[k] == key)
            place, node, size = place[on], self.to[k[on]], size + 1
            n = self.first[node + 1] - self.first[node]
            which = np.repeat(np.arange(len(n)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((place[which], np.full(len(which), size), self.entry[self.first[node][which] + step]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        start, length, entry = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((entry, -length, start))
        return start[by], length[by], entry[by]

    def chosen(self, tokens: pa.ListArray, most: int, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, entry) of the spans taken in each row's tokens."""
        bounds = tokens.offsets.to_numpy()
        flat = tokens.values.slice(bounds[0], bounds[-1] - bounds[0])
        word = pc.fill_null(pc.index_in(flat, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = bounds - bounds[0]
        row = np.repeat(np.arange(len(tokens)), np.diff(bounds))
        start, length, entry = self.matches(word, bounds[row + 1])
        taken, at, free, kept, seen = [], -1, 0, 0, set()
        name = self.entity_id.to_pylist() if once else None
        for k, (r, s, n) in enumerate(zip(row[start].tolist(), start.tolist(), length.tolist())):
            if r != at:
                at, free, kept, seen = r, s, 0, set()
            if s >= free and kept < most:
                if once:
                    if name[entry[k]] in seen:
                        continue
                    seen.add(name[entry[k]])
                taken.append(k)
                free, kept = s + n, kept + 1
        k = np.array(taken, np.int64)
        of = row[start[k]]
        return of, start[k] - bounds[of], start[k] + length[k] - bounds[of], entry[k]


def matched(rows: DataFrame, dictionary: DataFrame, key: str, most: int = 128, once: bool = False) -> DataFrame:
    """key, entity_id, canonical, entity_type, start_token, end_token of the spans of each row (key, ts: its tokens, as
    entries have them): leftmost, longest, without overlap, at most ``most``; ``once``: an entity only once."""
    entries = dictionary.select(*[F.col(c).cast("string") for c in ("entity_id", "canonical", "entity_type")]).where("canonical IS NOT NULL")
    sent = rows.sparkSession.sparkContext.broadcast(Automaton([tuple(r) for r in entries.collect()]))  # at most ENTRIES, see annotate.matches()
    types = {"entity_id": pa.string(), "canonical": pa.string(), "entity_type": pa.string(), "start_token": pa.int32(), "end_token": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            cut = np.searchsorted(np.cumsum(size), np.arange(TOKENS, size.sum() + TOKENS, TOKENS), side="left") + 1
            lo = 0
            for hi in np.unique(np.append(np.minimum(cut, len(size)), len(size))).tolist():
                some = batch.slice(lo, hi - lo)
                lo = hi
                if not some.num_rows:
                    continue
                tokens = pc.fill_null(some.column(1), pa.scalar([], some.column(1).type))
                of, start, end, entry = a.chosen(tokens, most, once)
                at = pa.array(entry)
                columns = [some.column(0).take(pa.array(of)), a.entity_id.take(at), a.canonical.take(at), a.entity_type.take(at), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *types])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "ts").mapInArrow(run, f"`{key}` {kind}, entity_id string, canonical string, entity_type string, start_token int, end_token int")
