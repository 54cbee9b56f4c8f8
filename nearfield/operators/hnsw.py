"""Layered small-world graphs of one shard, in numpy: build, search, removal. No Spark here.

A shard is built as a whole: the candidates of a node are its exact nearest members of the layer (what a perfect beam search would find),
so the graph doesn't depend on an order of insertion. A node keeps a diverse choice of them; edges go both ways, and a list
that grows beyond its cap is chosen anew.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

from nearfield.functions import kernels


@dataclass
class ShardGraph:
    """Vectors and ids of a shard; out[layer][row] lists rows. Rows with level < layer have no entry in that layer."""

    ids: np.ndarray
    x: np.ndarray
    level: np.ndarray
    metric: str
    max_edges: int
    out: list[dict[int, list[int]]] = field(default_factory=list)

    @property
    def entry(self) -> int:
        """Row of the entry point: the most layers, then the least id; -1 if empty."""
        return -1 if not len(self.ids) else int(np.lexsort((self.ids, -self.level))[0])

    def cap(self, layer: int) -> int:
        return 2 * self.max_edges if layer == 0 else self.max_edges

    def incoming(self, layer: int) -> dict[int, list[int]]:
        back: dict[int, list[int]] = {r: [] for r in self.out[layer]}
        for a, bs in self.out[layer].items():
            for b in bs:
                back[b].append(a)
        return back


def diverse(g: ShardGraph, q: int, candidates: np.ndarray, keep: int) -> list[int]:
    """Candidates nearest first (ties: least id), each only if it is nearer to q than to all kept before; all if fewer than keep."""
    d = kernels.block(g.metric, g.x[q : q + 1], g.x[candidates])[0]
    order = np.lexsort((g.ids[candidates], d))
    candidates, d = candidates[order], d[order]
    if len(candidates) < keep:
        return candidates.tolist()
    kept, open_ = [], np.ones(len(candidates), bool)
    while len(kept) < keep and open_.any():
        i = int(open_.argmax())
        kept.append(i)
        open_[: i + 1] = False
        rest = np.nonzero(open_)[0]
        open_[rest] = kernels.block(g.metric, g.x[candidates[i : i + 1]], g.x[candidates[rest]])[0] > d[rest]
    return candidates[kept].tolist()


def _link(g: ShardGraph, layer: int, rows: np.ndarray, new: np.ndarray, max_candidates: int) -> None:
    """Link the rows in new, members of the layer, with their best of max_candidates nearest members (rows), both ways; lists beyond the cap are chosen anew."""
    cap, edges = g.cap(layer), g.out[layer]
    width = min(len(rows) - 1, max(cap, max_candidates))
    linked = {r: dict.fromkeys(bs) for r, bs in edges.items()} | {int(r): {} for r in new}
    for s in range(0, len(new) if width > 0 else 0, 1024):
        part = new[s : s + 1024]
        d = kernels.block(g.metric, g.x[part], g.x[rows])
        d[np.arange(len(part)), np.searchsorted(rows, part)] = np.inf
        near = np.argpartition(d, width - 1, axis=1)[:, :width]
        for q, c in zip(part.tolist(), near):
            for b in diverse(g, q, rows[c], cap):
                linked[q].setdefault(b)
                linked[b].setdefault(q)
    g.out[layer] = {r: list(bs) if len(bs) <= cap else diverse(g, r, np.fromiter(bs, np.int64), cap) for r, bs in linked.items()}


def insert(g: ShardGraph, ids: np.ndarray, x: np.ndarray, level: np.ndarray, max_candidates: int = 1000) -> ShardGraph:
    """The graph with further rows, in ascending order of id. Only lists of the new rows and of those they link to change. Ids must not be there yet."""
    all_ids, n = np.concatenate([g.ids, ids]), len(g.ids)
    order = np.argsort(all_ids, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    out = ShardGraph(all_ids[order], np.concatenate([g.x, x.astype(np.float64)])[order], np.concatenate([g.level, level])[order], g.metric, g.max_edges)
    out.out = [{int(at[r]): [int(at[b]) for b in bs] for r, bs in edges.items()} for edges in g.out]
    for layer in range(int(out.level.max()) + 1 if len(out.ids) else 0):
        if layer == len(out.out):
            out.out.append({})
        new = np.sort(at[n:][level >= layer])
        if len(new):
            _link(out, layer, np.nonzero(out.level >= layer)[0], new, max_candidates)
    return out


def build(ids: np.ndarray, x: np.ndarray, level: np.ndarray, metric: str = "cosine", max_edges: int = 16, max_candidates: int = 1000) -> ShardGraph:
    """The graph of all rows, which are in ascending order of id: an empty one into which all are inserted at once."""
    kernels.known(metric)
    return insert(ShardGraph(np.zeros(0, np.int64), np.zeros((0, x.shape[1])), np.zeros(0, np.int64), metric, max_edges), ids, x, level, max_candidates)


def descend(g: ShardGraph, q: np.ndarray, to_layer: int) -> int:
    """From the entry point, layer by layer, to ever nearer neighbours; the row where this ends above to_layer."""
    at = g.entry
    d = kernels.block(g.metric, q[None], g.x[at : at + 1])[0, 0]
    for layer in range(int(g.level[at]), to_layer, -1):
        moved = True
        while moved:
            moved = False
            near = np.array(g.out[layer].get(at, []), np.int64)
            if len(near):
                dn = kernels.block(g.metric, q[None], g.x[near])[0]
                j = int(dn.argmin())
                if dn[j] < d:
                    at, d, moved = int(near[j]), dn[j], True
    return at


def search(g: ShardGraph, q: np.ndarray, k: int, min_nn: int = 5, layer: int = 0, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
    """Up to k (distance, row) nearest first by beam search of width max(min_nn, k). Rows that aren't allowed are passed through, not returned."""
    if not len(g.ids) or k <= 0:
        return []
    if layer >= len(g.out):
        raise ValueError(f"layer {layer} doesn't exist; the top layer is {len(g.out) - 1}")
    q = q.astype(np.float64)
    start = descend(g, q, layer)
    ef = max(min_nn, k)
    seen = np.zeros(len(g.ids), bool)
    seen[start] = True
    d = float(kernels.block(g.metric, q[None], g.x[start : start + 1])[0, 0])
    frontier = [(d, start)]
    best: list[tuple[float, int]] = [(-d, start)] if allowed is None or allowed[start] else []
    while frontier:
        d, r = heapq.heappop(frontier)
        if len(best) >= ef and d > -best[0][0]:
            break
        near = np.array([b for b in g.out[layer].get(r, []) if not seen[b]], np.int64)
        if not len(near):
            continue
        seen[near] = True
        for dn, b in zip(kernels.block(g.metric, q[None], g.x[near])[0].tolist(), near.tolist()):
            if len(best) < ef or dn < -best[0][0]:
                heapq.heappush(frontier, (dn, b))
                if allowed is None or allowed[b]:
                    heapq.heappush(best, (-dn, b))
                    if len(best) > ef:
                        heapq.heappop(best)
    return sorted(((-d, b) for d, b in best), key=lambda t: (t[0], g.ids[t[1]]))[:k]


def remove(g: ShardGraph, gone: np.ndarray) -> ShardGraph:
    """The graph without the rows in gone: whoever pointed to one adopts its neighbours, nearest first, while there is room and they are diverse."""
    dead = np.zeros(len(g.ids), bool)
    dead[gone] = True
    out = []
    for layer, edges in enumerate(g.out):
        cap = g.cap(layer)
        new: dict[int, list[int]] = {}
        for r, bs in edges.items():
            if dead[r]:
                continue
            kept = [b for b in bs if not dead[b]]
            heirs = {c for b in bs if dead[b] for c in edges.get(b, []) if not dead[c] and c != r} - set(kept)
            if heirs:
                c = np.fromiter(heirs, np.int64)
                d = kernels.block(g.metric, g.x[r : r + 1], g.x[c])[0]
                for i in np.lexsort((g.ids[c], d)):
                    if len(kept) >= cap:
                        break
                    if not kept or (kernels.block(g.metric, g.x[c[i] : c[i] + 1], g.x[np.array(kept)])[0] > d[i]).all():
                        kept.append(int(c[i]))
            new[r] = kept
        out.append(new)
    keep = np.nonzero(~dead)[0]
    at = np.full(len(g.ids), -1, np.int64)
    at[keep] = np.arange(len(keep))
    small = ShardGraph(g.ids[keep], g.x[keep], g.level[keep], g.metric, g.max_edges)
    small.out = [{int(at[r]): [int(at[b]) for b in bs] for r, bs in edges.items()} for edges in out]
    while small.out and not small.out[-1]:
        small.out.pop()
    return small


def to_rows(g: ShardGraph) -> list[tuple[int, list[list[int]], list[list[int]]]]:
    """(id, out_edges, in_edges) of every node, lists of ids per layer."""
    back = [g.incoming(layer) for layer in range(len(g.out))]
    name = g.ids.tolist()
    return [(name[r], [[name[b] for b in g.out[la][r]] for la in range(int(g.level[r]) + 1)], [[name[b] for b in back[la][r]] for la in range(int(g.level[r]) + 1)]) for r in range(len(name))]


def from_rows(ids: np.ndarray, x: np.ndarray, out_edges: list[list[list[int]]], metric: str, max_edges: int) -> ShardGraph:
    """The graph of rows as to_rows gives them. Edges to ids that aren't here are left out."""
    level = np.array([max(0, len(e) - 1) for e in out_edges], np.int64)
    g = ShardGraph(np.asarray(ids, np.int64), x.astype(np.float64), level, metric, max_edges)
    row = {int(i): r for r, i in enumerate(ids)}
    for layer in range(int(level.max()) + 1 if len(ids) else 0):
        g.out.append({r: [row[b] for b in e[layer] if b in row] if layer < len(e) else [] for r, e in enumerate(out_edges) if level[r] >= layer})
    return g
