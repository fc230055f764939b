"""A plain model of the scorer's choice of edits, rule by rule and without any shortcut.

It follows the published behaviour of the measure: a graph of all cheapest alignments, shortcuts between any two of its
nodes, weights that favour gold edits, and a shortest path. It is slow and only meant for small pairs.
"""

from collections import defaultdict

INF = float("inf")
EPS = 0.001


class Edit:
    def __init__(self, start, end, j, jj, kept, pure):
        self.start, self.end, self.j, self.jj, self.kept, self.pure = start, end, j, jj, kept, pure

    def then(self, other):
        return Edit(self.start, other.end, self.j, other.jj, self.kept + other.kept, self.pure and other.pure)


def graph(src, hyp, sub):
    """Nodes in breadth-first order from the end, and the edges as they are met, with their edits."""
    n, m = len(src), len(hyp)
    cost = {}
    steps = defaultdict(list)
    for i in range(n + 1):
        for j in range(m + 1):
            options = []
            if i and j:
                options.append((cost[i - 1, j - 1] + (0 if src[i - 1] == hyp[j - 1] else sub), (i - 1, j - 1)))
            if i:
                options.append((cost[i - 1, j] + 1, (i - 1, j)))
            if j:
                options.append((cost[i, j - 1] + 1, (i, j - 1)))
            cost[i, j] = min((c for c, _ in options), default=0)
            steps[i, j] = [u for c, u in options if c == cost[i, j]]
    nodes, edges, edits, queue = [], [], {}, [(n, m)]
    while queue:
        v = queue.pop(0)
        if v in nodes:
            continue
        nodes.append(v)
        for u in steps[v]:
            same = u == (v[0] - 1, v[1] - 1) and src[u[0]] == hyp[u[1]]
            edges.append((u, v))
            edits[u, v] = Edit(u[0], v[0], u[1], v[1], int(same), same)
            if u not in queue:
                queue.append(u)
    return nodes, edges, edits


def choose(src, hyp, gold, keep, costs):
    """Spans of the chosen edits. ``gold``: (start, end, *corrections as lists of words)."""
    graphs = [graph(src, hyp, c) for c in costs]
    nodes, edges, edits = graphs[0]
    if len(graphs) > 1:
        nodes = sorted(set(nodes) | set(graphs[1][0]))
        edges, edits = sorted(edges + graphs[1][1]), {**graphs[1][2], **edits}
    length = {e: 1 for e in edges}
    for k in nodes:
        for i in nodes:
            for j in nodes:
                if (i, k) in edits and (k, j) in edits and length[i, k] + length[k, j] < length.get((i, j), INF):
                    both = edits[i, k].then(edits[k, j])
                    if both.kept <= keep:
                        edges.append((i, j))
                        length[i, j], edits[i, j] = length[i, k] + length[k, j], both
    at = 0
    while at < len(edges):                      # the entry after one that goes is not looked at
        e = edges[at]
        if e in edits and edits[e].pure and length[e] > 1:
            edges.remove(e)
            del edits[e]
            length[e] = INF
        at += 1
    edges = [e for e in edges if e in edits]
    weight = {e: float(length[e]) for e in edges}
    groups = defaultdict(list)
    for e in edges:
        groups[edits[e].start, edits[e].end].append(e)
    text = lambda e: list(hyp[edits[e].j:edits[e].jj])
    for span, own in groups.items():
        wanted = [list(alts) for a, b, *alts in gold if (a, b) == span]
        if span[0] < span[1]:
            for e in own:
                if any(text(e) in alts for alts in wanted):
                    weight[e] = float(-len(edges))
                elif not edits[e].pure:
                    weight[e] += EPS
        else:
            insertions(sorted(own), wanted, weight, text, float(-len(edges)))
    best, back = {v: INF for v in nodes}, {}
    best[0, 0] = 0.0
    for _ in nodes:
        for u, v in edges:
            if best[u] + weight[u, v] < best[v]:
                best[v], back[v] = best[u] + weight[u, v], u
    v, spans = (len(src), len(hyp)), []
    while v in back:
        u = back[v]
        if not edits[u, v].pure:
            spans.append((u[0], v[0], u[1], v[1]))
        v = u
    return spans[::-1]


def insertions(own, wanted, weight, text, hit):
    """Gold insertions of one place are used once each, from the left and from the right in turn."""
    left, right, first, last, at = 0, len(own) - 1, 0, len(wanted) - 1, 0
    while left <= right:
        e, from_left = own[at], at == left
        numbers = list(range(first, last + 1))
        match = [g for g in (numbers if from_left else numbers[::-1]) if text(e) in wanted[g]][:1]
        if match:
            weight[e] = hit
        else:
            weight[e] += EPS
        if from_left:
            left += 1
            if match:
                first = match[0] + 1
                while left < len(own) and own[left][0] != e[1]:
                    weight[own[left]] += EPS
                    left += 1
            at = left if match else right
        else:
            right -= 1
            if match:
                last = match[0] - 1
                while right >= 0 and own[right][1] != e[0]:
                    weight[own[right]] += EPS
                    right -= 1
            at = right if match else left
