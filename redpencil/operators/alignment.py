"""Edit alignment of tokenized sentence pairs, run inside Spark tasks on Arrow batches.

Every cell (i, j) of the token distance matrix that lies on some cheapest path is a lattice node.
An edit is a walk between two nodes that holds at least one change and at most ``max_unchanged``
kept tokens. The chosen edit sequence, in order of importance,

1. uses as many edits equal to gold edits as possible,
2. takes the fewest matrix steps outside those edits,
3. pays the least for its edits: 1 per edit, and 2 for a one-step edit that is cheapest under both
   substitution costs.

Remaining ties go to the candidate found first when steps are scanned by start node, then longer
edits by last inner node. Only token positions leave the task; Spark builds the texts from them.
"""

from __future__ import annotations

import gc
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

FAR = 1 << 28
EDIT_COST = 0.001       # fixed value: charge per edit; a matrix step costs 1
ONE_EDIT = 1.0 + EDIT_COST
FIRST = (float("inf"),)
CELLS_PER_CHUNK = 1 << 22
SPARSE_WORK = 200_000   # pairs of walks that are put together one by one; beyond, in matrices
DENSE_NODES = 1200      # lattices with more nodes and more pairs of walks than that charge a longer edit once
BIT_TOKENS = 1 << 13    # distances of longer pairs are found in bands, where the bits of all words would take too much memory
SHARED_NODES = 64       # lattices of no more nodes are remembered between batches
STEP_NODES = 256        # walks of merged lattices with more nodes are put together by their length
HELD_NODES = 1 << 16    # nodes of larger lattices that are remembered within a batch
PATTERN_BAND = 31       # the equal tokens of a row in a band of no more diagonals at each side are the bits of one number
KEPT_TOKENS = 512       # edits of pairs with longer sources are not remembered between batches
KEPT_BYTES = 1 << 25    # about the memory of one half of the remembered edits
BUFFER_ROWS, BUFFER_TOKENS = 1 << 14, 1 << 18      # batches are aligned together up to these
DELETE, INSERT, KEPT = 4, 16, 64    # places of the move counts in a lattice node's number

SPANS = "array<array<struct<start:int,end:int,hyp_start:int,hyp_end:int>>>"


class Band:
    """Rows of the distance matrices of several pairs, each an array [pair, cost, diagonal + band].

    The pairs with the longest sources come first, so a row ``i`` holds the first ``live[i]`` pairs only.
    """

    def __init__(self, pairs, sub_costs, band):
        self.band, self.width, self.rows = band, 2 * band + 1, len(pairs[0][0])
        lengths = np.array([-len(s) for s, _ in pairs])
        self.live = np.searchsorted(lengths, -np.arange(self.rows + 1), side="right").tolist()
        self.src = np.full((len(pairs), self.rows), -1, np.int32)
        self.hyp = np.full((len(pairs), self.rows + self.width), -2, np.int32)
        for p, (s, t) in enumerate(pairs):
            self.src[p, :len(s)] = s
            usable = t[:self.rows + self.width - band]
            self.hyp[p, band:band + len(usable)] = usable
        self.subs = np.asarray(sub_costs, np.int32)[None, :, None]
        self.ramp = np.arange(self.width, dtype=np.int32)
        self.costs = len(sub_costs)

    def shape(self, i):
        return self.live[i], self.costs, self.width

    def first(self):
        return np.broadcast_to(np.where(self.ramp >= self.band, self.ramp - self.band, FAR), self.shape(0)).astype(np.int32)

    def differ(self, i):
        """Where the source token before row ``i`` differs from the hypothesis token."""
        n = self.live[i]
        return (self.src[:n, i - 1, None] != self.hyp[:n, i - 1:i - 1 + self.width])[:, None, :]

    def after(self, prev, i):
        prev = prev[:self.live[i]]
        best = prev + self.differ(i) * self.subs
        best[..., :-1] = np.minimum(best[..., :-1], prev[..., 1:] + 1)
        return np.minimum.accumulate(best - self.ramp, axis=-1) + self.ramp


def _chunks(pairs, indexes, bands, costs):
    """Group pair numbers of one band, longest sources first, so that their stacked rows stay within the cell budget."""
    group, rows, band = [], 0, 0
    for p in sorted(indexes, key=lambda p: (bands[p], -len(pairs[p][0]))):
        if group and (bands[p] != band or (rows + len(pairs[p][0]) + 1) * (2 * band + 1) * costs > CELLS_PER_CHUNK):
            yield group, band
            group, rows = [], 0
        group.append(p)
        rows, band = rows + len(pairs[p][0]) + 1, bands[p]
    if group:
        yield group, band


def _first_bands(pairs):
    """Starting bands: room for the tokens that occur on one side only, which no path can keep."""
    if not pairs:
        return []
    return _bands_of(*(_numbered(side) for side in zip(*pairs)), [max(len(s), len(t)) for s, t in pairs])


def _bands_of(left, right, longer):
    """:func:`_first_bands` from the numbered codes of both sides and the length of each pair's longer one."""
    keys, counts = zip(*(np.unique(side, return_counts=True) for side in (left, right)))
    _, here, there = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    kept = np.bincount(keys[0][here] >> 32, np.minimum(counts[0][here], counts[1][there]), len(longer)).astype(int).tolist()
    return [_usual_band(n - k + 1) for n, k in zip(longer, kept)]


def _usual_band(least):
    """The next of a few bands, which many pairs share."""
    half = 1 << max(least.bit_length() - 2, 1)
    return -(-least // half) * half


def _numbered(lists):
    """The codes of all lists, with the number of their list in the upper half."""
    sizes = [len(x) for x in lists]
    codes = np.fromiter(chain.from_iterable(lists), np.int64, sum(sizes))
    return np.repeat(np.arange(len(sizes), dtype=np.int64) << 32, sizes) | codes


def _needs_wider_band(total, n, m, band):
    """Whether a path as cheap as ``total`` could leave the band: its insertions or deletions reach
    at most half of total plus length difference off the diagonal."""
    return (total + abs(m - n)) // 2 > band and band < max(n, m)


def _wider_band(n, m, band):
    return min(max(n, m), 2 * band)


def lattices(pairs, sub_costs):
    """Yield (pair number, band, lattice) with a band that provably holds every cheapest path; a lattice is its nodes
    and the moves into each of them, both as the bytes of 64-bit numbers.

    Rows of the matrices are kept at intervals only where all of them would not fit, and the rows between are computed
    again on the way back, so memory grows with the square root of the length times the band.
    """
    bands = _first_bands(pairs)
    waiting = list(range(len(pairs)))
    while waiting:
        retry = []
        for p, found in _lattices_in(pairs, waiting, bands, sub_costs):
            if found is None:
                bands[p] = _wider_band(len(pairs[p][0]), len(pairs[p][1]), bands[p])
                retry.append(p)
            else:
                yield p, bands[p], found
        waiting = retry


def _lattices_in(pairs, wanted, bands, sub_costs):
    """Yield (pair number, lattice) of the wanted pairs, None for a lattice that a wider band can only hold."""
    for group, width in _chunks(pairs, wanted, bands, len(sub_costs)):
        members = [pairs[p] for p in group]
        band = Band(members, sub_costs, width)
        cells = sum(band.live) * band.costs * band.width
        every = 1 if cells <= CELLS_PER_CHUNK else isqrt(band.rows) + 1
        kept, totals = _forward(band, members, every)
        fits = [not _needs_wider_band(t, len(s), len(h), width) for t, (s, h) in zip(totals, members)]
        for g, p in enumerate(group):
            if not fits[g]:
                yield p, None
        for g, lattice in _backward(band, members, kept, every, fits):
            yield group[g], lattice


def _forward(band, members, every):
    """Each ``every``-th row, and each pair's largest distance."""
    ends = _ends(band, members, range(len(members)))
    row, kept, totals = band.first(), {}, np.zeros(len(members), int)
    for i in range(band.rows + 1):
        if i:
            row = band.after(row, i)
        if i % every == 0:
            kept[i] = row
        if i in ends:
            g, d = ends[i]
            totals[g] = row[g, :, d].max(axis=1)
    return kept, totals.tolist()


def _ends(band, members, wanted):
    """By number of source tokens the pairs and the diagonals at which their matrices end."""
    ends = defaultdict(lambda: ([], []))
    for g in wanted:
        s, t = members[g]
        here = ends[len(s)]
        here[0].append(g)
        here[1].append(len(t) - len(s) + band.band)
    return ends


def _backward(band, members, kept, every, wanted):
    """Follow all cheapest paths back from the ends: (pair, (nodes, moves into each node)), nodes in row-major order.

    Nodes are ``row * width + diagonal``; the moves into a node are one number, decoded by :func:`moves`.
    """
    ends = _ends(band, members, [g for g, ok in enumerate(wanted) if ok])
    alive, found = np.zeros(band.shape(band.rows), bool), []
    rows: dict = {}
    place = band.ramp
    for i in range(band.rows, -1, -1):
        if i not in rows:
            start = i - i % every
            rows = {start: kept[start]}
            for k in range(start + 1, i + 1):
                rows[k] = band.after(rows[k - 1], k)
        if i in ends:
            before, alive = alive, np.zeros(band.shape(i), bool)
            alive[:len(before)] = before
            g, d = ends[i]
            alive[g, :, d] = True
        elif len(alive) < band.live[i]:
            before, alive = alive, np.zeros(band.shape(i), bool)
            alive[:len(before)] = before
        row = rows.pop(i)
        inserts = np.zeros(band.shape(i), bool)
        inserts[..., 1:] = row[..., :-1] + 1 == row[..., 1:]
        # a node is on a path when the next node at its right that is has only insertions in between
        if (alive & inserts).any():
            shut = np.where(inserts, np.int32(band.width), place)                   # no insertion leads into these
            shut = np.minimum.accumulate(shut[..., ::-1], axis=-1)[..., ::-1]
            near = np.where(alive, place, np.int32(2 * band.width))
            near = np.minimum.accumulate(near[..., ::-1], axis=-1)[..., ::-1]
            after = np.full(band.shape(i), band.width, np.int32)
            after[..., :-1] = shut[..., 1:]
            alive = near < after
        code = _over_costs(alive & inserts) * np.int16(INSERT)
        if i:
            prev = rows[i - 1] if i - 1 in rows else kept[i - 1] if i - 1 in kept else None
            if prev is None:
                start = (i - 1) - (i - 1) % every
                rows = {start: kept[start]}
                for k in range(start + 1, i):
                    rows[k] = band.after(rows[k - 1], k)
                prev = rows[i - 1]
            prev = prev[:band.live[i]]
            differ = band.differ(i)
            diagonal = alive & (prev + differ * band.subs == row)
            deletes = np.zeros(band.shape(i), bool)
            deletes[..., :-1] = alive[..., :-1] & (prev[..., 1:] + 1 == row[..., :-1])
            count = _over_costs(diagonal)
            code += count + ((count > 0) & ~differ[:, 0]) * np.int16(KEPT) + _over_costs(deletes) * np.int16(DELETE)
            alive = diagonal
            alive[..., 1:] |= deletes[..., :-1]
        g, d = np.nonzero(code)
        found.append((g, i * band.width + d, code[g, d]))
    pair, node, code = (np.concatenate(x) for x in zip(*found[::-1]))
    order = np.argsort(pair, kind="stable")
    pair, node, code = pair[order], node[order], code[order].astype(np.int64)
    cuts = np.searchsorted(pair, np.arange(len(members) + 1))
    origin, start = (np.array([x], np.int64).tobytes() for x in (band.band, 0))
    for g in range(len(members)):
        if wanted[g]:
            part = slice(cuts[g], cuts[g + 1])
            # a row's nodes were found from left to right, rows now ascend; the first node has no move into it
            yield g, (origin + node[part].tobytes(), start + code[part].tobytes())


def _over_costs(flags):
    """The number of substitution costs with the flag."""
    total = flags[:, 0].astype(np.int16)
    for k in range(1, flags.shape[1]):
        total += flags[:, k]
    return total


@lru_cache(maxsize=256)
def moves(width):
    """For each move number the moves into a node, by start node: (offset, is_change, charge). The
    charge is the number of substitution costs for which the move is on a cheapest path."""
    table = []
    for number in range(2 * KEPT):
        diagonal, deletion, insertion = number % DELETE, number // DELETE % DELETE, number // INSERT % DELETE
        table.append([move for move in (
            (-width, number < KEPT, diagonal), (-width + 1, True, deletion), (-1, True, insertion)) if move[2]])
    return table


def _arcs(lattice, nodes, width, keep, merged):
    """All walks of the lattice that can be an edit or a kept token, or None if they are too many to list.

    Returns :class:`_Arcs`. Walks are found node by node: one that ends at a node is prolonged by those that start there,
    and is listed when it is shorter than what its ends had before. So an arc can be listed again, and each time it is
    charged again.
    """
    into = moves(width)
    if merged:
        order = nodes                                        # row by row
        base = [(v + offset, v, change, charge) for v in nodes for offset, change, charge in into[lattice[v]]]
        base.sort()
    else:
        order, base, seen = [nodes[-1]], [], {nodes[-1]}     # breadth first from the end
        for v in order:
            for offset, change, charge in into[lattice[v]]:
                base.append((v + offset, v, change, charge))
                if v + offset not in seen:
                    seen.add(v + offset)
                    order.append(v + offset)
    # [steps, kept tokens, is kept, places]
    arcs, starts, goals, length = {}, defaultdict(dict), defaultdict(dict), 0
    for u, v, change, charge in base:
        arcs[u, v] = starts[v][u] = goals[u][v] = [1, 0 if change else 1, not change, list(range(length, length + charge))]
        length += charge
    listed = _prolong(order, arcs, starts, goals, keep, length)
    if listed is None:
        listed = _prolong_dense(order, arcs, keep, length) if len(nodes) <= DENSE_NODES else None
    if listed is None:
        return None
    # kept walks of several steps go, but after each of them the next entry of the list is passed over
    length, at = length + len(listed), 0
    while at < len(listed):
        arc = arcs.get(listed[at])
        if arc is not None and arc[2] and arc[0] > 1:
            del arcs[listed[at]]
            length -= 1
            at += 1
        at += 1
    number = {v: k for k, v in enumerate(nodes)}
    found: list = [[] for _ in nodes]
    for (u, v), (steps, _, kept, places) in arcs.items():
        weight = float(steps)
        if not kept:
            for _ in places:
                weight += EDIT_COST
        found[number[v]].append((number[u], weight, places, kept))
    return _Arcs(nodes, width, found, length)


class _Arcs:
    """The arcs of a lattice by the number of the node at their end: (number of the start, weight, places in the list of
    arcs, kept token?), and what all gold sets share: the best sequence without gold, and the arcs of a span."""

    def __init__(self, nodes, width, found, length):
        self.nodes, self.width, self.found, self.length = nodes, width, found, length
        self.rank, self.came = [(0.0, 1, -1)], [None]
        _rank(self.found, self.rank, self.came, {})
        self._rows, self._spans = [v // width for v in nodes], {}

    def span(self, start, end):
        """Numbers of the ends of a span's arcs, and how often each is listed."""
        own = self._spans.get((start, end))
        if own is None:
            rows = self._rows
            own = self._spans[start, end] = [
                (u, v, len(places)) for v in range(bisect_left(rows, end), bisect_right(rows, end))
                for u, _, places, _ in self.found[v] if rows[u] == start]
        return own


def _arcs_by_steps(nodes, codes, width, keep):
    """:func:`_arcs` of a merged lattice, for all walks of one length at a time.

    Row by row a walk only grows by single steps at its end, and no node is gone through before those that lead to it. So
    an arc has the fewest steps, of equal ones those over the first last inner node, and it is listed for each last inner
    node, in their order, over which it has fewer steps than before.
    """
    size = len(nodes)
    ends, kinds = [], codes >= KEPT
    for offset, place in ((-width, 1), (1 - width, DELETE), (-1, INSERT)):
        charge = codes // place % DELETE
        goal = np.flatnonzero(charge)
        ends.append((np.searchsorted(nodes, nodes[goal] + offset), goal, charge[goal], kinds[goal] & (place == 1)))
    start, goal, charge, alike = (np.concatenate(x) for x in zip(*ends))
    order = np.lexsort((goal, start))
    start, goal, charge, alike = start[order], goal[order], charge[order], alike[order]
    first = np.searchsorted(start, np.arange(size + 1))
    singles = done = start * size + goal
    at, end, kept, same, steps, work = start, goal, alike.astype(np.int64), alike, 1, 0
    settled, tried = [], []
    while len(at):
        many = first[end + 1] - first[end]
        work += int(many.sum())
        if work > SPARSE_WORK:
            return None
        owner, move = np.repeat(np.arange(len(at)), many), _ranges(first[end], many)
        held = kept[owner] + alike[move]
        fits = held <= keep
        owner, move, held = owner[fits], move[fits], held[fits]
        pair, inner, steps = at[owner] * size + goal[move], end[owner], steps + 1
        tried.append((pair, inner, np.full(len(pair), steps)))
        places = np.minimum(np.searchsorted(done, pair), len(done) - 1)
        order = np.flatnonzero(done[places] != pair)
        order = order[np.lexsort((inner[order], pair[order]))]
        order = order[np.concatenate([[True], pair[order][1:] != pair[order][:-1]])[:len(order)]]
        owner, move, pair = owner[order], move[order], pair[order]
        at, end, kept, same = at[owner], goal[move], held[order], same[owner] & alike[move]
        settled.append((pair, np.full(len(pair), steps), same))
        done = np.insert(done, np.searchsorted(done, pair), pair)
    pair, inner, long = (np.concatenate(x) for x in zip(*tried))
    order = np.lexsort((inner, pair))
    pair, inner, long = pair[order], inner[order], long[order]
    least = np.full(len(pair), FAR)
    for back in (1, 2):                     # a node has no more than three moves into it
        alike_before = np.flatnonzero(pair[back:] == pair[:-back]) + back
        least[alike_before] = np.minimum(least[alike_before], long[alike_before - back])
    places = np.minimum(np.searchsorted(singles, pair), len(singles) - 1)
    fresh = (long < least) & (singles[places] != pair)
    pair, inner = pair[fresh], inner[fresh]
    order = np.lexsort((pair, inner))
    listed, length = pair[order], int(charge.sum())
    pairs, long, same = (np.concatenate(x) for x in zip(*settled))
    gone, skipped, pure = set(), -1, set(pairs[same].tolist())
    if pure:
        # kept walks of several steps go, but after each of them the next entry of the list is passed over
        for k in np.flatnonzero(np.isin(listed, pairs[same])).tolist():
            if k != skipped and (one := int(listed[k])) not in gone:
                gone.add(one)
                skipped = k + 1
    order = np.argsort(listed, kind="stable")
    own = (order + length).tolist()
    by_pair, times = np.unique(listed, return_counts=True)
    lists, k = [list(range(b - c, b)) for b, c in zip(np.cumsum(charge).tolist(), charge.tolist())], 0
    for count in times.tolist():
        lists.append(own[k:k + count])
        k += count
    order = np.argsort(pairs)
    pairs = np.concatenate([singles, pairs[order]])         # the settled pairs are the listed ones
    weight = np.concatenate([np.ones(len(start)), long[order].astype(float)])
    same, count = np.concatenate([alike, same[order]]), np.concatenate([charge, times])
    for k in range(int(count.max(initial=0))):
        weight[~same & (count > k)] += EDIT_COST
    there = np.flatnonzero(~np.isin(pairs, list(gone))) if gone else np.arange(len(pairs))
    there = there[np.argsort(pairs[there] % size, kind="stable")]
    goals = pairs[there] % size
    arcs = list(zip((pairs[there] // size).tolist(), weight[there].tolist(), map(lists.__getitem__, there.tolist()), same[there].tolist()))
    cuts = np.searchsorted(goals, np.arange(size + 1)).tolist()
    return _Arcs(nodes.tolist(), width, [arcs[a:b] for a, b in zip(cuts, cuts[1:])], length + len(listed) - len(gone))


class _Shapes:
    """Lattices by their nodes, with their arcs and their edits without gold: words don't matter, so many pairs share them."""

    def __init__(self, max_unchanged, merged):
        self.options, self.known, self.held = (max_unchanged, merged), {}, 0

    def get(self, band, lattice):
        """(lattice, nodes, arcs, edits without gold); no arcs and no such edits where the walks are too many to list."""
        if len(lattice[0]) <= 8 * SHARED_NODES:
            return _shared_shape(band, *lattice, *self.options)
        shape = self.known.get((band, lattice))
        if shape is None:
            shape = _shape(band, *lattice, *self.options)
            self.held += len(shape[1])
            if self.held > HELD_NODES:
                self.known, self.held = {}, len(shape[1])
            self.known[band, lattice] = shape
        return shape


def _shape(band, nodes, codes, max_unchanged, merged):
    nodes, codes, width = np.frombuffer(nodes, np.int64), np.frombuffer(codes, np.int64), 2 * band + 1
    too_many = len(nodes) > DENSE_NODES and _least_work(nodes, codes, width) > SPARSE_WORK
    arcs = None
    if merged and len(nodes) > STEP_NODES and not too_many:
        arcs = _arcs_by_steps(nodes, codes, width, max_unchanged)
        too_many = arcs is None and len(nodes) > DENSE_NODES
    lattice = dict(zip(nodes.tolist(), codes.tolist()))
    nodes = list(lattice)
    if arcs is None and not too_many:
        arcs = _arcs(lattice, nodes, width, max_unchanged, merged)
    return lattice, nodes, arcs, None if arcs is None else best_spans(None, band, (), arcs)


@lru_cache(maxsize=2048)
def _shared_shape(*shape):
    """The shapes of short pairs, kept from batch to batch."""
    return _shape(*shape)


def _least_work(nodes, codes, width):
    """The pairs of single steps that meet at a node: :func:`_prolong` puts together no fewer walks."""
    into, out = np.zeros(len(nodes), int), np.zeros(len(nodes), int)
    for offset, place in ((-width, 1), (1 - width, DELETE), (-1, INSERT)):
        there = np.flatnonzero(codes // place % DELETE)
        into[there] += 1
        np.add.at(out, np.searchsorted(nodes, nodes[there] + offset), 1)
    return int(into @ out)


def _prolong(order, arcs, starts, goals, keep, length):
    rank = {v: k for k, v in enumerate(order)}.__getitem__
    listed, work = [], 0
    for k in order:
        before, after = starts[k], goals[k]
        work += len(before) * len(after)
        if work > SPARSE_WORK:
            return None
        if len(after) > 1:
            after = {j: after[j] for j in sorted(after, key=rank)}
        for i in sorted(before, key=rank) if len(before) > 1 else before:
            steps, kept, same, _ = before[i]
            own = goals[i]
            for j, (more, also, alike, _) in after.items():
                if kept + also > keep:
                    continue
                now = own.get(j)
                if now is None:
                    arcs[i, j] = own[j] = starts[j][i] = [steps + more, kept + also, same and alike, [length + len(listed)]]
                elif steps + more < now[0]:
                    now[:3] = steps + more, kept + also, same and alike
                    now[3].append(length + len(listed))
                else:
                    continue
                listed.append((i, j))
    return listed


def _prolong_dense(order, arcs, keep, length):
    """:func:`_prolong` over matrices [start, goal]; ``arcs`` may hold walks listed before, only single steps count."""
    size, rank = len(order), {v: k for k, v in enumerate(order)}
    for key in [key for key, arc in arcs.items() if arc[3][0] >= length]:
        del arcs[key]
    steps, kept = np.full((size, size), FAR, np.int32), np.zeros((size, size), np.int32)
    same = np.zeros((size, size), bool)
    for (u, v), arc in arcs.items():
        arc[:3], arc[3] = (1, int(arc[2] if arc[0] == 1 else 0), arc[2] if arc[0] == 1 else False), [x for x in arc[3] if x < length]
        steps[rank[u], rank[v]], kept[rank[u], rank[v]], same[rank[u], rank[v]] = arc[0], arc[1], arc[2]
    listed = []
    for k in range(size):
        i, j = np.flatnonzero(steps[:, k] < FAR), np.flatnonzero(steps[k] < FAR)
        if not len(i) or not len(j):
            continue
        both, held = steps[i, k][:, None] + steps[k, j], kept[i, k][:, None] + kept[k, j]
        a, b = np.nonzero((both < steps[np.ix_(i, j)]) & (held <= keep))
        steps[i[a], j[b]], kept[i[a], j[b]], same[i[a], j[b]] = both[a, b], held[a, b], same[i[a], k] & same[k, j[b]]
        listed.append(i[a] * size + j[b])
    flat = np.concatenate(listed) if listed else np.empty(0, np.int64)
    names = [(order[x // size], order[x % size]) for x in flat.tolist()]
    for place, key in enumerate(names, length):
        arc = arcs.get(key)
        if arc is None:
            arc = arcs[key] = [0, 0, False, []]
        arc[3].append(place)
    for (u, v), arc in arcs.items():
        x, y = rank[u], rank[v]
        arc[:3] = int(steps[x, y]), int(kept[x, y]), bool(same[x, y])
    return names


def _gold_weights(gold, pair, arcs, band):
    """Weights that differ because of gold edits: {number of the goal: {number of the start: weight}}."""
    src, hyp = pair
    by_span = defaultdict(list)
    for start, end, alternatives in gold:
        if 0 <= start <= end <= len(src):
            by_span[start, end].append(alternatives)
    if not by_span:
        return {}
    nodes, width = arcs.nodes, arcs.width
    place = lambda v: (v // width, v // width + v % width - band)
    weights: dict = defaultdict(dict)
    for (start, end), golds in by_span.items():
        own = arcs.span(start, end)
        if start < end:
            for u, v, _ in own:
                words = hyp[place(nodes[u])[1]:place(nodes[v])[1]]
                if any(words in alternatives for alternatives in golds):
                    weights[v][u] = float(-arcs.length)
        else:
            listed = sorted((nodes[u], nodes[v]) for u, v, times in own for _ in range(times))
            numbers = {nodes[k]: k for u, v, _ in own for k in (u, v)}
            golds = [[w for w in alternatives if w] for alternatives in golds]
            for (u, v), weight in _insertion_weights(listed, golds, hyp, place, float(-arcs.length)).items():
                weights[numbers[v]][numbers[u]] = weight
    return weights


def _insertion_weights(listed, golds, hyp, place, hit):
    """Weights of the insertions at one position, an entry for each time an arc is listed.

    Gold insertions are used once each, in order. The list is read from both ends: a miss changes the end, a hit keeps it
    and passes over the entries that do not continue from it; what is missed or passed over is charged.
    """
    weights = {(u, v): float(v - u) for u, v in listed}
    ends, open_golds, front = [0, len(listed) - 1], [0, len(golds) - 1], True
    while ends[0] <= ends[1]:
        front = front or ends[0] == ends[1]
        side, step = (0, 1) if front else (1, -1)
        arc = listed[ends[side]]
        words = hyp[place(arc[0])[1]:place(arc[1])[1]]
        order = range(open_golds[0], open_golds[1] + 1)
        found = next((g for g in (order if front else reversed(order)) if words in golds[g]), None)
        ends[side] += step
        if found is None:
            weights[arc] += EDIT_COST
            front = not front
            continue
        weights[arc] = hit
        open_golds[side] = found + step
        while 0 <= ends[side] < len(listed) and listed[ends[side]][side] != arc[1 - side]:
            weights[listed[ends[side]]] += EDIT_COST
            ends[side] += step
    return weights


def _rank(found, rank, came, weights):
    """Go on with ``rank`` and ``came``, which hold the first nodes: a node's rank is its cost, then the round and the
    place in the list at which it got that cost; it came by the arc of this place in its own list."""
    for v in range(len(rank), len(found)):
        own, other = found[v], weights.get(v)
        if other is None and len(own) == 1:
            u, weight, places, _ = own[0]
            cost, turn, at = rank[u]
            first = places[0]
            if first <= at:
                if places[-1] > at:
                    first = places[bisect_right(places, at)]
                else:
                    turn += 1
            rank.append((cost + weight, turn, first))
            came.append(0)
            continue
        best, least, back = FIRST, FIRST[0], None
        for k, (u, weight, places, _) in enumerate(own):
            cost, turn, at = rank[u]
            cost += weight if other is None else other.get(u, weight)
            if cost > least:
                continue
            first = places[0]
            if first <= at:
                if places[-1] > at:
                    first = places[bisect_right(places, at)]
                else:
                    turn += 1
            option = (cost, turn, first)
            if option < best:
                best, least, back = option, cost, k
        rank.append(best)
        came.append(back)


def best_spans(pair, band, gold, arcs):
    """Edit spans (start, end, hyp_start, hyp_end) of the cheapest sequence, in document order.

    Of sequences of equal cost the one stays that is found first when the list of arcs is gone through again and again.
    Up to the first arc that a gold edit changes, nodes keep the ranks that they have without gold.
    """
    nodes, width, rank, came = arcs.nodes, arcs.width, arcs.rank, arcs.came
    weights = _gold_weights(gold, pair, arcs, band) if gold else None
    if weights:
        first = min(weights)
        rank, came = rank[:first], came[:first]
        _rank(arcs.found, rank, came, weights)
    spans, node = [], len(nodes) - 1
    while node:
        start, _, _, kept = arcs.found[node][came[node]]
        if not kept:
            i, d = divmod(nodes[start], width)
            ii, dd = divmod(nodes[node], width)
            spans.append((i, ii, i + d - band, ii + dd - band))
        node = start
    return spans[::-1]


def _walk_exists(lattice, nodes, into, start, goal, max_unchanged):
    """Whether start -> goal is one edit; also whether it holds any change."""
    reach = {start: (0, 0, False)}
    for node in nodes[bisect_right(nodes, start):bisect_right(nodes, goal)]:
        for offset, change, _ in into[lattice[node]]:
            prev = node + offset
            if prev in reach:
                length, kept, changed = reach[prev]
                option = (length + 1, kept + (not change), changed or change)
                if option[1] <= max(max_unchanged, 1 if prev == start else 0) and (
                        node not in reach or option[0] < reach[node][0]):
                    reach[node] = option
    length, _, changed = reach.get(goal, (0, 0, False))
    return (length == 1 or changed) and length > 0, changed


def _insertion_hits(arcs, golds):
    """Pair insertions at one position with its gold insertions, each gold used once, in order.

    The arcs are scanned from both ends: a miss changes the end, a hit keeps it and drops the arcs
    that do not continue from it.
    """
    arcs, golds, hits, left = deque(arcs), deque(golds), [], True
    while arcs:
        front = left or len(arcs) == 1
        start, end, words = arcs.popleft() if front else arcs.pop()
        order = range(len(golds)) if front else range(len(golds) - 1, -1, -1)
        found = next((g for g in order if words in golds[g]), None)
        if found is None:
            left = not front
            continue
        hits.append((start, end))
        left = front
        for _ in range(found + 1 if front else len(golds) - found):
            golds.popleft() if front else golds.pop()
        while arcs and (arcs[0][0] != end if front else arcs[-1][1] != start):
            arcs.popleft() if front else arcs.pop()
    return hits


def _gold_arcs(gold, pair, lattice, nodes, band, max_unchanged):
    """Lattice walks equal to a gold edit: {goal: {(start, has_change)}}."""
    src, hyp = pair
    width = 2 * band + 1
    into = moves(width)
    arcs: dict[int, set] = {}
    insertions: dict[int, list] = {}

    def starts(row):
        """The lattice nodes of a row with their hypothesis positions."""
        first = row * width
        for node in nodes[bisect_left(nodes, first):bisect_left(nodes, first + width)]:
            yield node, node - first + row - band

    for start, end, alternatives in gold:
        if not 0 <= start <= end <= len(src):
            continue
        if start == end:
            insertions.setdefault(start, []).append([w for w in alternatives if w])
            continue
        for here, j in starts(start):
            for words in alternatives:
                last = j + len(words)
                diagonal = last - end + band
                there = end * width + diagonal
                if 0 <= diagonal < width and there in lattice and hyp[j:last] == words:
                    ok, changed = _walk_exists(lattice, nodes, into, here, there, max_unchanged)
                    if ok:
                        arcs.setdefault(there, set()).add((here, changed))
    for row, golds in insertions.items():
        found = []
        for here, j in starts(row):
            there = here
            while True:
                charge = lattice.get(there + 1, 0) // INSERT % DELETE
                if not charge or (there + 1) // width != row:
                    break
                there += 1
                words = hyp[j:j + there - here]
                found += [(here, there, words)] * (charge if there == here + 1 else 1)
        for here, there in _insertion_hits(found, golds):
            arcs.setdefault(there, set()).add((here, True))
    return arcs


def _spans_charged_once(pair, lattice, nodes, band, gold, max_unchanged):
    """:func:`best_spans` where the walks are too many to list: linear in the nodes, every longer edit charged once."""
    src, hyp = pair
    width = 2 * band + 1
    into = moves(width)
    arcs = _gold_arcs(gold, pair, lattice, nodes, band, max_unchanged) if gold else {}
    origin, goal = band, len(src) * width + len(hyp) - len(src) + band
    gold_bonus = 2.0 ** (2 * (len(src) + len(hyp)) + 2).bit_length()
    # rank = (cost, round, longer edit?, last inner node, start node)
    rank = {origin: (0.0, 1, 0, -1, -1)}
    came = {origin: None}
    # edits under way: node -> [(kept tokens, (cost, round, start, cost at start, steps))]; an edit with
    # more kept tokens is listed only when it is better
    under_way: dict[int, list] = {}
    for node in nodes[1:]:
        number = lattice[node]
        if number > KEPT and number - KEPT < DELETE and node - width not in under_way and node not in arcs:
            prev = node - width
            cost, rnd, longer, _, _ = rank[prev]
            rank[node], came[node] = (cost + 1.0, rnd + longer, 0, prev, prev), (prev, False)
            continue
        best, back, least, pending = FIRST, None, FAR, [None] * (max_unchanged + 1)
        for offset, change, charge in into[number]:
            prev = node + offset
            base, rnd, longer, _, _ = rank[prev]
            cost = base + (1.0 if not change else ONE_EDIT if charge == 1 else ONE_EDIT + EDIT_COST)
            if cost <= least:
                option = (cost, rnd + longer, 0, prev, prev)
                if option < best:
                    best, back, least = option, (prev, change), cost
            grown = under_way.get(prev, ())
            if change:
                cost, old = base + ONE_EDIT, pending[0]
                if old is None or cost < old[0] or cost == old[0] and (rnd, prev) < old[1:3]:
                    pending[0] = (cost, rnd, prev, base, 1.0)
                if max_unchanged and lattice[prev] >= KEPT:
                    # edits that start with kept tokens right before this change
                    grown, start = list(grown), prev
                    for kept in range(1, max_unchanged + 1):
                        if lattice[start] < KEPT:
                            break
                        start -= width
                        grown.append((kept, (0.0, rank[start][1], start, rank[start][0], float(kept))))
            for kept, (_, rnd, start, base, length) in grown:
                if not change:
                    kept += 1
                    if kept > max_unchanged:
                        break
                length += 1.0
                cost, old = base + (length + EDIT_COST), pending[kept]
                if old is None or cost < old[0] or cost == old[0] and (rnd, start) < old[1:3]:
                    pending[kept] = (cost, rnd, start, base, length)
                if cost <= least:
                    option = (cost, rnd, 1, prev, start)
                    if option < best:
                        best, back, least = option, (start, True), cost
        for start, change in arcs.get(node, ()):
            base, rnd, longer, _, _ = rank[start]
            option = (base - gold_bonus, rnd, 1, start, start)
            if option < best:
                best, back = option, (start, change)
        rank[node], came[node] = best, back
        listed, top = [], None
        for kept, value in enumerate(pending):
            if value is not None and (top is None or value < top):
                top = value
                listed.append((kept, value))
        if listed:
            under_way[node] = listed
    spans, node = [], goal
    while came[node] is not None:
        start, change = came[node]
        if change:
            i, d = divmod(start, width)
            ii, dd = divmod(node, width)
            spans.append((i, ii, i + d - band, ii + dd - band))
        node = start
    return spans[::-1]


def _token_ids(*columns):
    """Code the tokens of several list columns as shared integers; None rows stay None."""
    flat = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).tolist()
    words = {w: k for k, w in enumerate(flat.dictionary.to_pylist())}
    out, base = [], 0
    for column in columns:
        valid, lists = column.is_valid().to_pylist(), []
        for size, ok in zip(_sizes(column), valid):
            lists.append(codes[base:base + size] if ok else None)
            base += size
        out.append(lists)
    return out, words


def _sizes(lists):
    return pc.fill_null(pc.list_value_length(lists), 0).to_pylist()


class _Pairs:
    """The pairs of a batch as codes of all tokens in a row, with the start and the number of each side's tokens."""

    def __init__(self, source, hypothesis):
        flat = pa.concat_arrays([c.flatten() for c in (source, hypothesis)]).dictionary_encode()
        self.dictionary = flat.dictionary
        self.codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = [np.array(_sizes(c), np.int64) for c in (source, hypothesis)]
        ends = np.cumsum(np.concatenate(self.sizes))
        self.starts = np.split(ends - np.concatenate(self.sizes), 2)
        valid = [c.is_valid().to_numpy(zero_copy_only=False) for c in (source, hypothesis)]
        self.whole = valid[0] & valid[1]
        even = np.flatnonzero(self.whole & (self.sizes[0] == self.sizes[1]))
        here, there = (self.codes[_ranges(x[even], self.sizes[0][even])] for x in self.starts)
        owner = np.repeat(np.arange(len(even)), self.sizes[0][even])
        self.equal = np.zeros(len(source), bool)
        self.equal[even[np.bincount(owner[here != there], minlength=len(even)) == 0]] = True

    def words(self):
        return {w: k for k, w in enumerate(self.dictionary.to_pylist())}

    def tokens(self, side, row):
        start = self.starts[side][row]
        return self.codes[start:start + self.sizes[side][row]].tolist()

    def bands(self, rows):
        sizes = [x[rows] for x in self.sizes]
        numbered = [np.repeat(np.arange(len(rows), dtype=np.int64) << 32, n) | self.codes[_ranges(x[rows], n)]
                    for x, n in zip(self.starts, sizes)]
        return _bands_of(*numbered, np.maximum(*sizes).tolist())

    def patterns(self, rows, band):
        """What the lattices of rows depend on within a band: both lengths, the band, and which tokens are equal."""
        n, m = (x[rows] for x in self.sizes)
        room = n + 2 * band
        begin = np.cumsum(room) - room
        hyp = np.full(int(room.sum()), -1, np.int64)
        usable = np.minimum(m, n + band)
        hyp[_ranges(begin + band, usable)] = self.codes[_ranges(self.starts[1][rows], usable)]
        src, place = self.codes[_ranges(self.starts[0][rows], n)], _ranges(begin, n)
        kind = np.uint16 if band < 8 else np.uint64
        bits = np.zeros(len(src), kind)
        for d in range(2 * band + 1):
            bits |= (hyp[place + d] == src).astype(kind) << kind(d)
        raw, size = bits.tobytes(), bits.itemsize
        ends = (np.cumsum(n) * size).tolist()
        return [(a, b, band, raw[end - a * size:end]) for a, b, end in zip(n.tolist(), m.tolist(), ends)]


def _ranges(starts, sizes):
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Gold:
    """The gold sets of a batch; corrections are cut into words and coded once for each text."""

    def __init__(self, gold, pairs):
        sets = gold.flatten()
        self.starts, self.ends, corrections = sets.flatten().flatten()
        texts = pc.fill_null(corrections.flatten(), "").dictionary_encode()
        words = pairs.words() if len(texts) else {}
        coded = [[words.get(w, -1) for w in c.split(" ")] if c else [] for c in texts.dictionary.to_pylist()]
        texts = [coded[k] for k in texts.indices.to_pylist()]
        self.starts, self.ends = self.starts.to_pylist(), self.ends.to_pylist()
        self.texts, at = [], 0
        for size in _sizes(corrections):
            self.texts.append(texts[at:at + size])
            at += size
        self.rows, at, k = [], 0, 0
        sizes = _sizes(sets)
        for count in _sizes(gold):
            own = []
            for size in sizes[k:k + count]:
                own.append(range(at, at + size))
                at += size
            self.rows.append(own or (range(0),))
            k += count

    def edits(self, own):
        """(start, end, corrections) of a set."""
        return [(self.starts[e], self.ends[e], self.texts[e]) for e in own]

    def seen_in(self, own, hyp, size, band):
        """What a lattice of this band sees of a set: the spans in its source, and which corrections stand where."""
        seen = []
        for e in own:
            start, end = self.starts[e], self.ends[e]
            if not 0 <= start <= end <= size:
                continue
            first, found = max(0, start - band), []
            near = hyp[first:start + band + 1]
            for words in self.texts[e]:
                if not words:
                    if start < end:
                        found.append(0)
                elif words[0] in near:
                    k = len(words)
                    for j, word in enumerate(near, first):
                        if word == words[0] and (k == 1 or hyp[j:j + k] == words):
                            found.append((k, j - start))
            if found or start == end:
                seen.append((start, end, tuple(found)))
        return tuple(seen)


class _Remembered:
    """Edits by options, pattern and seen gold in two halves: the older one goes when the newer one is full."""

    def __init__(self):
        self.new, self.old, self.bytes = {}, {}, 0

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value):
        _, pattern, seen = key
        self.bytes += 500 + len(pattern[3]) + len(value) + 200 * len(seen or ())
        if self.bytes > KEPT_BYTES:
            self.new, self.old, self.bytes = {}, self.new, 0
        self.new[key] = value


_remembered = _Remembered()
WIDER = b"wider"          # in the place of edits: the band is too narrow


def _pack_spans(result):
    """Rows of span lists as bytes (or None) as one Arrow array."""
    sets = np.cumsum([0, *(len(row or ()) for row in result)], dtype=np.int32)
    found = list(chain.from_iterable(row or () for row in result))
    spans = np.cumsum([0, *(len(x) // 16 for x in found)], dtype=np.int32)
    columns = np.frombuffer(b"".join(found), np.int32).reshape(-1, 4)
    structs = pa.StructArray.from_arrays(
        [pa.array(columns[:, k]) for k in range(4)], ["start", "end", "hyp_start", "hyp_end"])
    inner = pa.ListArray.from_arrays(pa.array(spans), structs)
    return pa.ListArray.from_arrays(pa.array(sets), inner, mask=pa.array([row is None for row in result], pa.bool_()))


def align_batch(source, hypothesis, gold, max_unchanged, sub_costs):
    """One Arrow batch: per row the spans for each gold set (one empty set when gold is null).

    Lattices are many small objects without cycles, which the garbage collector would go through again and again.
    """
    collects = gc.isenabled()
    gc.disable()
    try:
        return _aligned_batch(source, hypothesis, gold, max_unchanged, sub_costs)
    finally:
        if collects:
            gc.enable()


def _aligned_batch(source, hypothesis, gold, max_unchanged, sub_costs):
    """Pairs with equal tokens at the same places of the band, and gold that is seen alike, have the same edits: words
    don't matter otherwise. So one pair of each pattern is aligned, and edits are remembered by pattern."""
    pairs = _Pairs(source, hypothesis)
    golds = _Gold(gold, pairs) if gold.null_count < len(gold) else None
    result: list = [None] * len(source)
    for r in np.flatnonzero(pairs.equal).tolist():
        result[r] = [b""] * (1 if golds is None else len(golds.rows[r]))
    options = (max_unchanged, tuple(sub_costs), SPARSE_WORK, DENSE_NODES)
    shapes, found = _Shapes(max_unchanged, len(sub_costs) > 1), {}
    waiting = np.flatnonzero(pairs.whole & ~pairs.equal)
    bands = dict(zip(waiting.tolist(), pairs.bands(waiting))) if len(waiting) else {}
    while bands:
        bands = _align_round(pairs, golds, bands, options, shapes, found, result)
    for r, keys in enumerate(result):
        if keys:
            result[r] = [key if isinstance(key, bytes) else found[key] for key in keys]
    return _pack_spans(result)


def _align_round(pairs, golds, bands, options, shapes, found, result):
    """Put the keys of the rows' edits into ``result`` and the edits into ``found``; returns rows that need a wider band."""
    by_band, patterns, todo, retry = defaultdict(list), {}, {}, []
    for r, band in bands.items():
        by_band[band].append(r)
    for band, rows in by_band.items():
        if band <= PATTERN_BAND:
            patterns.update(zip(rows, pairs.patterns(np.array(rows), band)))
        else:
            patterns.update((r, (tuple(pairs.tokens(0, r)), tuple(pairs.tokens(1, r)), band, None)) for r in rows)
    for r, pattern in patterns.items():
        size, _, band, bits = pattern
        short = bits is not None and size <= KEPT_TOKENS
        wide = (options, pattern, None)
        if short and wide not in found and _remembered.get(wide) is not None:
            found[wide] = WIDER
        if wide in found:
            retry.append(r)
            continue
        own = [()]
        if golds is not None:
            hyp = pairs.tokens(1, r)
            size = int(pairs.sizes[0][r])
            own = [golds.seen_in(edits, hyp, size, band) if edits else () for edits in golds.rows[r]]
        result[r] = keys = [(options, pattern, seen) for seen in own]
        for k, key in enumerate(keys):
            if key in found:
                continue
            value = _remembered.get(key) if short else None
            if value is None:
                todo.setdefault(pattern, {}).setdefault(own[k], (r, k))
            else:
                found[key] = value
    firsts = {pattern: next(iter(wanted.values()))[0] for pattern, wanted in todo.items()}
    members = [(pairs.tokens(0, r), pairs.tokens(1, r)) for r in firsts.values()]
    listed, sub_costs, max_unchanged = list(todo.items()), options[1], options[0]
    widths = [pattern[2] for pattern in todo]
    too_narrow = set()
    for p, lattice in _lattices_in(members, range(len(members)), widths, sub_costs):
        pattern, wanted = listed[p]
        short = pattern[3] is not None and pattern[0] <= KEPT_TOKENS
        if lattice is None:
            too_narrow.add(pattern)
            edits = {(options, pattern, None): WIDER}
        else:
            edits = {}
            cells, nodes, arcs, plain = shapes.get(widths[p], lattice)
            for seen, (r, k) in wanted.items():
                pair = members[p] if golds is None or not seen else (members[p][0], pairs.tokens(1, r))
                coded = golds.edits(golds.rows[r][k]) if seen else ()
                spans = plain if plain is not None and not seen else (
                    _spans_charged_once(pair, cells, nodes, widths[p], coded, max_unchanged) if arcs is None else
                    best_spans(pair, widths[p], coded, arcs))
                edits[options, pattern, seen] = np.array(spans, np.int32).tobytes()
        found.update(edits)
        if short:
            for key, value in edits.items():
                _remembered.put(key, value)
    if too_narrow:
        retry += [r for r, pattern in patterns.items() if pattern in too_narrow]
    return {r: _wider_band(int(pairs.sizes[0][r]), int(pairs.sizes[1][r]), bands[r]) for r in retry}


def align_batches(batches, max_unchanged, sub_costs):
    """:func:`align_batch` on several batches at a time, whose matrices have more pairs side by side."""
    def aligned(held):
        sides = [pa.concat_arrays(side) for side in zip(*held)]
        spans, at = align_batch(*sides, max_unchanged, sub_costs), 0
        for source, _, _ in held:
            yield spans.slice(at, len(source))
            at += len(source)
    held, rows, tokens = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, tokens = rows + len(batch[0]), tokens + len(batch[0].flatten()) + len(batch[1].flatten())
        if rows >= BUFFER_ROWS or tokens >= BUFFER_TOKENS:
            yield from aligned(held)
            held, rows, tokens = [], 0, 0
    if held:
        yield from aligned(held)


def edit_spans(source_tokens: Column, hypothesis_tokens: Column, gold: Column | None = None,
               max_unchanged_words: int = 2, lattice: str = "merged") -> Column:
    """Edit spans per gold set, as ``array<array<struct<start,end,hyp_start,hyp_end>>>``.

    ``gold`` is ``array<array<struct<start,end,corrections>>>``, one inner array per annotator.
    ``lattice='merged'`` joins the cheapest paths for substitution cost 1 and 2, ``'single'`` takes
    cost 2 only.
    """
    if lattice not in ("merged", "single"):
        raise ValueError(f"lattice must be 'merged' or 'single', not {lattice!r}")
    if max_unchanged_words < 0:
        raise ValueError("max_unchanged_words must not be negative")
    sub_costs = (1, 2) if lattice == "merged" else (2,)

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return align_batches(batches, max_unchanged_words, sub_costs)

    if gold is None:
        gold = F.lit(None)
    # not deterministic for the optimizer, so that filters on the result do not run the kernel twice
    return spans.asNondeterministic()(source_tokens, hypothesis_tokens, gold.cast(
        "array<array<struct<start:int,end:int,corrections:array<string>>>>"))


def _bit_distance(left, right, cost_sub):
    """The distance of two lists of codes, with a row of the matrix as the bits of one number.

    Bits tell where a cell is one more (``up``) or less (``down``) than the one before it; a replacement that costs two or
    more is never better than a deletion and an insertion, so then only the longest common subsequence counts.
    """
    if not cost_sub:
        return abs(len(left) - len(right))
    short, long = sorted((left, right), key=len)
    if not short:
        return len(long)
    places: dict = {}
    for k, word in enumerate(short):
        places[word] = places.get(word, 0) | 1 << k
    here = places.get
    size, every = len(short), (1 << len(short)) - 1
    if cost_sub > 1:
        unmatched = every
        for word in long:
            both = unmatched & here(word, 0)
            if both:
                unmatched = (unmatched + both | unmatched - both) & every
        return len(long) - size + 2 * unmatched.bit_count()
    up, down, last, total = every, 0, 1 << size - 1, size
    for word in long:
        equal = here(word, 0)
        free = (equal & up) + up ^ up | equal
        rise, fall = down | ~(free | up) & every, up & free
        if rise & last:
            total += 1
        elif fall & last:
            total -= 1
        rise, equal = rise << 1 | 1, equal | down
        up, down = (fall << 1 | ~(equal | rise)) & every, rise & equal & every
    return total


def _differing(left, right):
    """Both lists without the tokens that they begin and end with alike; these never cost anything."""
    ends = min(len(left), len(right))
    head = next((k for k in range(ends) if left[k] != right[k]), ends)
    tail = next((k for k in range(ends - head) if left[-1 - k] != right[-1 - k]), ends - head)
    return left[head:len(left) - tail], right[head:len(right) - tail]


def distance_batch(left, right, cost_sub):
    """Distances of one Arrow batch, null where a side is null."""
    (lefts, rights), _ = _token_ids(left, right)
    result: list = [None] * len(lefts)
    rows, pairs = [], []                    # pairs whose numbers would be too long, in bands
    for r, (s, t) in enumerate(zip(lefts, rights)):
        if s is None or t is None:
            continue
        s, t = _differing(s, t)
        if min(len(s), len(t)) <= BIT_TOKENS:
            result[r] = _bit_distance(s, t, cost_sub)
        else:
            rows.append(r)
            pairs.append((s, t))
    bands = _first_bands(pairs)
    waiting = list(range(len(pairs)))
    while waiting:
        retry = []
        for group, band in _chunks(pairs, waiting, bands, 1):
            members = [pairs[p] for p in group]
            _, totals = _forward(Band(members, (cost_sub,), band), members, 1 << 40)
            for g, p in enumerate(group):
                n, m = len(pairs[p][0]), len(pairs[p][1])
                total = totals[g]
                if _needs_wider_band(total, n, m, band):
                    bands[p] = _wider_band(n, m, band)
                    retry.append(p)
                else:
                    result[rows[p]] = total
        waiting = retry
    return pa.array(result, pa.int64())


def token_distance(left: Column, right: Column, cost_sub: int = 2) -> Column:
    """Edit distance of two token arrays with unit insertions and deletions."""
    if cost_sub < 0:
        raise ValueError("cost_sub must not be negative")

    @F.arrow_udf("long")
    def distance(left: pa.Array, right: pa.Array) -> pa.Array:
        return distance_batch(left, right, cost_sub)
    return distance(left, right)
