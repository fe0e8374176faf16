"""Jaro-Winkler over many pairs of names in one step, and the settling of blocks of records with such names.

Functions here run in Python workers and travel with the plan.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters of a name that fit one word of bits; longer names are compared letter by letter.
WIDTH = 64
# Words of bits for the letters of a name, pairs compared and rows written in one step, entries of a table of places.
LETTER_WORDS, PAIRS, ROWS, PLACES = 4, 1 << 16, 1 << 16, 1 << 22
ONES = np.array([(1 << n) - 1 for n in range(WIDTH + 1)], np.uint64)


def _matched(a: str, b: str) -> tuple[list[str], list[str]]:
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    from_a = []
    for i, ch in enumerate(a):
        window = range(max(0, i - reach), min(len(b), i + reach + 1))
        j = next((j for j in window if b[j] == ch and not used[j]), None)
        if j is not None:
            used[j] = True
            from_a.append(ch)
    return from_a, [ch for ch, hit in zip(b, used) if hit]


def similarity(a: str, b: str) -> float:
    """Jaro-Winkler of two names; the prefix boost always applies."""
    if a == b:
        return 1.0
    left, right = _matched(a, b) if a and b else ([], [])
    m = len(left)
    if m == 0:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1.0 - jaro)


class Names:
    """Distinct names as numbered letters and as bits, one bit for each (letter, how often so far)."""

    def __init__(self, names: list[str]):
        self.names = names
        self.length = np.array([len(x) for x in names], np.int64)
        points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, code = np.unique(points, return_inverse=True)
        self.letters = len(letters) + 1
        row = np.repeat(np.arange(len(names)), self.length)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.codes = np.zeros((len(names), WIDTH), np.int32)
        short = place < WIDTH
        self.codes[row[short], place[short]] = code[short] + 1
        order = np.lexsort((place, code, row))
        first = np.ones(len(row), bool)
        first[1:] = (row[order][1:] != row[order][:-1]) | (code[order][1:] != code[order][:-1])
        at = np.arange(len(row))
        nth = at - np.maximum.accumulate(np.where(first, at, 0))
        token = np.unique(code[order].astype(np.int64) << 32 | nth, return_inverse=True)[1] % (64 * LETTER_WORDS)
        self.bits = np.zeros((LETTER_WORDS, len(names)), np.uint64)
        np.bitwise_or.at(self.bits, (token >> 6, row[order]), np.uint64(1) << (token & 63).astype(np.uint64))
        # Letters that have no bit of their own.
        self.spare = self.length - np.bitwise_count(self.bits).sum(axis=0, dtype=np.int64)

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters that both names begin with, four at most."""
        out, same = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        equal = np.ones(len(a), bool)
        for k in range(4):
            equal &= (k < same) & (self.codes[a, k] == self.codes[b, k])
            out += equal
        return out

    def alike(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the a-th and b-th names, pair by pair, have the similarity."""
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), PAIRS):
            i, j = a[at:at + PAIRS], b[at:at + PAIRS]
            la, lb = self.length[i], self.length[j]
            shared = np.minimum(self.spare[i], self.spare[j])
            for word in self.bits:
                shared = shared + np.bitwise_count(word[i] & word[j])
            prefix = self.prefix(i, j)
            near = i == j
            may = ~near & self._reaches(np.minimum(shared, np.minimum(la, lb)), la, lb, prefix, threshold)
            rest = np.flatnonzero(may)
            short = (la[rest] <= WIDTH) & (lb[rest] <= WIDTH)
            near[rest[short]] = self._scores(i[rest[short]], j[rest[short]], prefix[rest[short]], threshold) >= threshold
            for x in rest[~short].tolist():
                near[x] = similarity(self.names[i[x]], self.names[j[x]]) >= threshold
            out[at:at + PAIRS] = near
        return out

    @staticmethod
    def _reaches(matched, la, lb, prefix, threshold) -> np.ndarray:
        """Whether so many matched letters can give the threshold."""
        jaro = (matched / np.maximum(la, 1) + matched / np.maximum(lb, 1) + 1.0) / 3.0
        return np.where(matched > 0, jaro + prefix * 0.1 * (1.0 - jaro), 0.0) >= threshold - 1e-9

    def _scores(self, a: np.ndarray, b: np.ndarray, prefix: np.ndarray, threshold: float) -> np.ndarray:
        """The similarity of pairs of short names that differ; zero where it cannot reach the threshold."""
        if not len(a):
            return np.zeros(0)
        others, nth = np.unique(b, return_inverse=True)
        if len(others) * self.letters > PLACES and len(a) > 1:
            half = len(a) // 2
            return np.concatenate([self._scores(a[s], b[s], prefix[s], threshold) for s in (slice(half), slice(half, None))])
        la, lb = self.length[a], self.length[b]
        wide_a, wide_b = int(la.max()), int(lb.max())
        places = np.zeros((len(others), self.letters), np.uint64)
        every = np.arange(len(others))
        for k in range(wide_b):
            places[every, self.codes[others, k]] |= np.uint64(1 << k)
        places[:, 0] = 0
        from_a = np.ascontiguousarray(self.codes[a, :wide_a].T)
        reach = np.maximum(la, lb) // 2 - 1
        used, hits = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        base, flat = nth * self.letters, places.ravel()
        for i in range(wide_a):
            window = ONES[np.minimum(lb, i + reach + 1)] & ~ONES[np.maximum(i - reach, 0)]
            free = flat[base + from_a[i]] & window & ~used
            low = free & (~free + np.uint64(1))
            used |= low
            hits |= (low != 0).astype(np.uint64) << np.uint64(i)
        m = np.bitwise_count(used).astype(np.int64)
        out = np.zeros(len(a))
        left = np.flatnonzero(self._reaches(m, la, lb, prefix, threshold))
        hits, used, m = hits[left], used[left], m[left]
        mine, theirs = self.codes[a[left]], self.codes[b[left]]
        every, apart = np.arange(len(left)), np.zeros(len(left), np.int64)
        one = np.uint64(1)
        for _ in range(int(m.max()) if len(left) else 0):
            open_ = hits != 0
            x = np.minimum(np.bitwise_count((hits & (~hits + one)) - one), WIDTH - 1)
            y = np.minimum(np.bitwise_count((used & (~used + one)) - one), WIDTH - 1)
            apart += open_ & (mine[every, x] != theirs[every, y])
            hits, used = hits & (hits - one), used & (used - one)
        jaro = (m / la[left] + m / lb[left] + (m - apart // 2) / m) / 3.0
        out[left] = jaro + prefix[left] * 0.1 * (1.0 - jaro)
        return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, as rows come in the order of the first ``keys`` columns, with the number of each row's group."""
    held: pa.Table | None = None

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for c in range(keys):
            column = table.column(c).combine_chunks()
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        group = numbered(table)
        upto = int(np.searchsorted(group, group[-1]))
        if upto:
            yield table.slice(0, upto), group[:upto]
        held = table.slice(upto)
    if held is not None:
        yield held, np.zeros(held.num_rows, np.int64)


def numbered_names(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    encoded = column.combine_chunks().dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()


def _products(first: np.ndarray, begin: np.ndarray, count: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``first`` paired with each of its ``count`` numbers from ``begin`` on, in pieces of about ``limit`` pairs."""
    ends = np.cumsum(count)
    at = 0
    while at < len(first):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        n = count[at:upto]
        before = np.cumsum(n) - n
        yield np.repeat(first[at:upto], n), np.repeat(begin[at:upto] - before, n) + np.arange(int(n.sum()))
        at = upto


def alike_nodes(group: np.ndarray, side: np.ndarray, name: np.ndarray, names: Names, threshold: float
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group and different sides with alike names; rows come in the order of group and side."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    begin, end = np.searchsorted(group[right], group[left], "left"), np.searchsorted(group[right], group[left], "right")
    for a, b in _products(left, begin, end - begin, 4 * PAIRS):
        b = right[b]
        near = names.alike(name[a], name[b], threshold)
        yield a[near], b[near]


def alike_names(threshold: float):
    """(block, a, b) of alike names from rows (block, i, j, side, name), in order, each name once in a group and side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, 3):
            name, names = numbered_names(table.column(4))
            block, column = (table.column(c).combine_chunks() for c in (0, 4))
            for a, b in alike_nodes(group, table.column(3).to_numpy(), name, Names(names), threshold):
                for at in range(0, len(a), ROWS):
                    i, j = pa.array(a[at:at + ROWS]), pa.array(b[at:at + ROWS])
                    yield pa.RecordBatch.from_arrays([block.take(i), column.take(i), column.take(j)], ["block", "a", "b"])

    return run


def alike_records(threshold: float):
    """(id, order) pairs of records with alike names from rows (block, i, j, side, name, home, a's id and order, b's id and order).

    A pair that meets in an email block is left out there if both records are of one area: it meets in that area too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, 3):
            side = table.column(3).to_numpy().astype(np.int64)
            name, names = numbered_names(table.column(4))
            # Records of one name, in a group and side, are one node.
            order = np.lexsort((name, side, group))
            g, s, n = group[order], side[order], name[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(g)))
            blocks, homes = table.column(0).combine_chunks(), table.column(5).combine_chunks()
            at_home = pc.fill_null(pc.equal(blocks, homes), False).to_numpy(zero_copy_only=False)
            home = pc.fill_null(homes.dictionary_encode().indices, -1).to_numpy().astype(np.int64)
            columns = [table.column(c).combine_chunks() for c in (6, 7, 8, 9)]

            def records(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
                kept = at_home[x] | (home[x] < 0) | (home[x] != home[y])
                x, y = pa.array(x[kept]), pa.array(y[kept])
                return pa.RecordBatch.from_arrays(
                    [columns[0].take(x), columns[1].take(x), columns[2].take(y), columns[3].take(y)],
                    ["member_id", "pos_order", "app_member_id", "app_order"])

            for a, b in alike_nodes(g[begin], s[begin], n[begin], Names(names), threshold):
                # Each record of the first name with each of the second one.
                for of, x in _products(np.arange(len(a)), begin[a], count[a], 1 << 20):
                    pieces = _products(x, begin[b[of]], count[b[of]], ROWS)
                    yield from (records(order[x], order[y]) for x, y in pieces)

    return run


# --- serving the records of a cluster of blocks in order ----------------------------------------------------------------------

GRAPH = ("cluster string, p_id array<{id}>, p_order array<bigint>, p_shared array<boolean>, p_names array<array<int>>, "
         "a_id array<{other}>, a_order array<bigint>, a_shared array<boolean>, a_names array<array<int>>, starts array<int>, near array<int>")
TOLD = "cluster string, side int, at int, p_id {id}, a_id {other}, row_order bigint, best bigint, best_id {other}"


COLUMNS = ("cluster", "p_id", "p_order", "p_shared", "p_names", "a_id", "a_order", "a_shared", "a_names", "starts", "near")
GRAPH_ROWS = 1 << 10


def graphs(threshold: float):
    """One row for each cluster from rows (cluster, side, order, p_id, a_id, name, shared, block) in order: records and alike names.

    A record of two blocks has two rows. Names are counted by cluster, side and block; ``near`` lists, for each name of
    the first side from ``starts`` on, the names of the other side that are alike and of the same block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, 1):
            side = table.column(1).to_numpy().astype(np.int64)
            name, names = numbered_names(table.column(5))
            block, blocks = numbered_names(table.column(7))
            names, many = Names(names), len(names)
            nodes, of = np.unique(((group * len(blocks) + block) * 2 + side) * many + name, return_inverse=True)
            meeting, node_side = nodes // (2 * many), nodes // many % 2
            owner = meeting // len(blocks)
            # Names are numbered from zero in each cluster and side.
            rank, first = np.zeros(len(nodes), np.int64), []
            for s in (0, 1):
                at = np.flatnonzero(node_side == s)
                rank[at] = np.arange(len(at))
                first.append(np.searchsorted(owner[at], np.arange(int(group[-1]) + 2)))
            local = rank[of] - np.stack(first)[side, group]
            found = [(np.empty(0, np.int64),) * 2, *alike_nodes(meeting, node_side, nodes % many, names, threshold)]
            a, b = (rank[np.concatenate(x)] for x in zip(*found))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            clusters, ids, others, shared = (table.column(c).combine_chunks() for c in (0, 3, 4, 6))
            orders = table.column(2).to_numpy()
            id_of = [x.dictionary_encode().indices.fill_null(-1).to_numpy() for x in (ids, others)]
            new = np.ones(len(group), bool)
            new[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1]) | (id_of[0][1:] != id_of[0][:-1]) | (id_of[1][1:] != id_of[1][:-1])
            record = np.flatnonzero(new)
            lists = np.split(local, record[1:])
            edges = np.append(np.flatnonzero(np.append(True, group[record][1:] != group[record][:-1])), len(record))
            out: dict[str, list] = {n: [] for n in COLUMNS}
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                middle = begin + int(np.searchsorted(side[record[begin:end]], 1))
                g = int(group[record[begin]])
                starts = np.searchsorted(a, np.arange(first[0][g], first[0][g + 1] + 1))
                values = [clusters[int(record[begin])].as_py()]
                for kind, (low, high) in ((ids, (begin, middle)), (others, (middle, end))):
                    at = pa.array(record[low:high])
                    values += [kind.take(at).to_pylist(), orders[record[low:high]], shared.take(at).to_pylist(), lists[low:high]]
                for column, value in zip(out.values(), (*values, starts - starts[0], b[starts[0]:starts[-1]] - first[1][g])):
                    column.append(value)
                if sum(map(len, out["near"])) > PLACES or len(out["near"]) >= GRAPH_ROWS:
                    yield _graph_rows(out, ids.type, others.type)
                    out = {n: [] for n in COLUMNS}
            yield _graph_rows(out, ids.type, others.type)

    return run


def _graph_rows(out: dict, id_type: pa.DataType, other_type: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.string(), *(pa.list_(t) for t in (
        id_type, pa.int64(), pa.bool_(), pa.list_(pa.int32()), other_type, pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.int32(), pa.int32())))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def _walk(row: dict, told: list[dict] | None) -> tuple[list, list, list]:
    """For each POS record its first app record that is not known to be held by an earlier one, whether it offers, and who holds.

    Records come in order, so a refusal in the cluster is final. ``told`` has, of records that are in other clusters too, the
    best offer an app record has there and the best app record a POS record has left there; a POS record offers
    only what is not behind that. None: nothing is known yet and records of several clusters make no offer.
    """
    p_order, a_order, a_id = row["p_order"], row["a_order"], row["a_id"]
    held: list = [None] * len(a_order)
    bound = {}
    for x in told or ():
        if x["side"]:
            held[x["at"]] = x["best"]
        else:
            bound[x["at"]] = (x["best"], x["best_id"])
    queues: dict[int, list[int]] = {}
    for at, names in enumerate(row["a_names"]):
        for n in names:
            queues.setdefault(n, []).append(at)
    heads = dict.fromkeys(queues, 0)
    offered: list = [None] * len(a_order)
    best, offers = [], []
    starts, near = row["starts"], row["near"]
    for at, (order, names) in enumerate(zip(p_order, row["p_names"])):
        pick = None
        for m in (m for n in names for m in near[starts[n]:starts[n + 1]]):
            queue, head = queues[m], heads[m]
            while head < len(queue) and held[queue[head]] is not None and held[queue[head]] < order:
                head += 1
            heads[m] = head
            if head < len(queue) and (pick is None or queue[head] < pick):
                pick = queue[head]
        best.append(pick)
        may = pick is not None and (not row["p_shared"][at] if told is None else at not in bound or (a_order[pick], a_id[pick]) <= bound[at])
        offers.append(may)
        if may:
            offered[pick] = order if offered[pick] is None else offered[pick]
            held[pick] = order if held[pick] is None else min(held[pick], order)
    return best, offers, offered


def told_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each cluster tells of its records that are in other clusters too (``TOLD``), from rows of ``GRAPH`` and ``told``."""
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for row in batch.to_pylist():
            best, _, offered = _walk(row, row["told"])
            for at, pick in enumerate(best):
                if row["p_shared"][at]:
                    known = (None, None) if pick is None else (row["a_order"][pick], row["a_id"][pick])
                    for column, value in zip(out, (row["cluster"], 0, at, row["p_id"][at], None, row["p_order"][at], *known)):
                        column.append(value)
            for at, value in enumerate(offered):
                if row["a_shared"][at]:
                    for column, x in zip(out, (row["cluster"], 1, at, None, row["a_id"][at], row["a_order"][at], value, None)):
                        column.append(x)
        p_type, a_type = (batch.schema.field(n).type.value_type for n in ("p_id", "a_id"))
        kinds = (pa.string(), pa.int32(), pa.int32(), p_type, a_type, pa.int64(), pa.int64(), a_type)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)],
                                         ["cluster", "side", "at", "p_id", "a_id", "row_order", "best", "best_id"])


def served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member_id, app_member_id) of the offers that hold, once clusters have nothing new to tell."""
    for batch in batches:
        ids, others = [], []
        for row in batch.to_pylist():
            best, offers, _ = _walk(row, row["told"])
            ids += [row["p_id"][at] for at, may in enumerate(offers) if may]
            others += [row["a_id"][pick] for pick, may in zip(best, offers) if may]
        types = (batch.schema.field(n).type.value_type for n in ("p_id", "a_id"))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((ids, others), types)], ["member_id", "app_member_id"])
