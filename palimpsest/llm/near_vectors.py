"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard.

Vectors are dealt over shards by a hash of the id. A shard's graph grows by insertion; a vector that
lies within a small angle of one that is in it joins that leader instead of becoming a node, so a
hot group is a few nodes. Every leader is a query to its own shard and to all later ones (links are
mutual). A beam is widened for a query that it cannot hold the links of, and for all queries of two
shards until a recall audit passes, up to the whole graph, every node of which can be reached.

Whether vectors link is verified in double precision: between leaders by their cosine, between
their members by the triangle inequality of angles where it decides, else one by one. Components
are united over leaders and members.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, n_partitions, passing
from palimpsest.llm.components import components

#: Links per node on the lowest level and above; nodes of a level that the next one keeps: one of UP.
LINKS, LINKS_ABOVE, UP = 24, 12, 16
BUILD_BEAM, BEAM, AT_ONCE, STEPS = 64, 32, 512, 8
#: Vectors per shard at most, on average, and numbers in them; shards at least.
SHARD, SHARD_NUMBERS, SHARDS = 50_000, 1 << 22, 4
#: Pairs of shards that one round compares, about; it copies a shard twice for each distance of the round.
PAIRS_A_ROUND = 4096
#: Queries that an audit draws; how many of them it compares, and as many of those that have links; the recall that it asks for of every one.
DRAWN, AUDITED, RECALL = 2048, 256, 0.99
SLACK = 1e-4  # single precision in the search, double in the verification
#: Angle that rounding may take from a sum of angles.
ROUNDING = 1e-7
#: A vector joins a leader within this part of the angle of a link.
JOINED = 0.25


def select(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Of candidates [q, c] (best first, id -1: none) those nearer to the query than to one already
    taken, filled up with the best of the others: [q, most], -1 where there are too few."""
    ok = ids >= 0
    v = x[np.where(ok, ids, 0)]
    between = np.einsum("qid,qjd->qij", v, v)
    taken = np.zeros_like(ok)
    for j in range(ids.shape[1]):
        clash = ((between[:, j, :] > sims[:, j : j + 1]) & taken).any(axis=1)
        taken[:, j] = ok[:, j] & ~clash & (taken.sum(axis=1) < most)
    rank = np.where(taken, 0, np.where(ok, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.full((len(ids), most), -1, dtype=np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(ids, order, axis=1)
    return out


def best_of(sims: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(sims, order, axis=1), np.take_along_axis(ids, order, axis=1)


class Graph:
    """x: unit vectors of the nodes in single precision; low: links of the lowest level; levels: links above, lowest first.

    The two columns of low behind the LINKS make every node reachable from the first: see _reach().
    """

    def __init__(self, x: np.ndarray, low: np.ndarray | None = None) -> None:
        self.x, self.size = x, len(x)
        self.low = np.full((len(x), LINKS + 2), -1, dtype=np.int32) if low is None else low
        self.levels: list[np.ndarray] = []
        if low is not None:
            self._levels()

    @classmethod
    def build(cls, x: np.ndarray, angle: float = 0.0, seed: int = 0) -> tuple[Graph, np.ndarray, np.ndarray]:
        """The graph over leaders, which rows of x they are, and of each row the place of its leader.

        A row joins a leader that a search finds within `angle`, or an earlier one of its batch.
        """
        n = len(x)
        order = np.random.default_rng(seed).permutation(n)
        near = np.cos(angle) if angle > 0 else 2.0
        g = cls(np.zeros_like(x))
        g.size = 0
        rows, leader = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        done, linked_at = 0, 0
        while done < n:
            new = order[done : done + min(AT_ONCE, max(done, 64))]
            done += len(new)
            s2, i2 = g.search(x[new], BUILD_BEAM) if g.size else (np.full((len(new), 1), -2, np.float32), np.full((len(new), 1), -1, np.int32))
            joins = s2[:, 0] >= near
            leader[new[joins]] = i2[joins, 0]
            new, s2, i2 = new[~joins], s2[~joins], i2[~joins]
            if not len(new):
                continue
            sims = x[new] @ x[new].T
            first = np.arange(len(new))  # the leader of each within the batch
            for i in range(len(new)):
                if first[i] == i:
                    own = np.flatnonzero(sims[i, i + 1 :] >= near) + i + 1
                    first[own] = np.minimum(first[own], i)
            lead = np.flatnonzero(first == np.arange(len(new)))
            place = np.zeros(len(new), dtype=np.int64)
            place[lead] = g.size + np.arange(len(lead))
            leader[new] = place[first]
            ids = place[lead].astype(np.int32)
            rows[ids], g.x[ids] = new[lead], x[new[lead]]
            sims = sims[np.ix_(lead, lead)]
            sims[np.arange(len(lead)), np.arange(len(lead))] = -2
            s, i = best_of(sims, np.broadcast_to(ids, sims.shape), BUILD_BEAM // 2)
            i = np.where(s > -2, i, -1)
            s, i = best_of(np.concatenate((s, s2[lead]), axis=1), np.concatenate((i, i2[lead]), axis=1), BUILD_BEAM)
            g.low[ids, : LINKS // 2] = select(s, i, g.x, LINKS // 2)
            g.size += len(lead)
            g._back(ids)
            if g.size >= 2 * linked_at:
                g._levels()
                linked_at = g.size
        g.x, g.low = g.x[: g.size], g.low[: g.size]
        g._levels()
        g._reach()
        return g, rows[: g.size], leader

    def _levels(self) -> None:
        """The first nodes make the upper levels, which are linked by comparing all of their few."""
        self.levels, size = [], self.size // UP
        while size >= 1:
            nodes = np.arange(size, dtype=np.int32)
            links = np.full((size, LINKS_ABOVE), -1, dtype=np.int32)
            for a in range(0, size, AT_ONCE):
                sims = self.x[a : min(a + AT_ONCE, size)] @ self.x[:size].T
                sims[np.arange(len(sims)), a + np.arange(len(sims))] = -2
                s, i = best_of(sims, np.broadcast_to(nodes, sims.shape), 4 * LINKS_ABOVE)
                links[a : a + AT_ONCE] = select(s, np.where(s > -2, i, -1), self.x, LINKS_ABOVE)
            self.levels.append(links)
            size //= UP

    def _back(self, new: np.ndarray) -> None:
        """Links from the chosen neighbours back to the new nodes; full lists are selected anew."""
        own = self.low[new, : LINKS // 2]
        to, source = own.ravel(), np.repeat(new, own.shape[1])
        to, source = to[to >= 0], source[to >= 0]
        order = np.argsort(to, kind="stable")
        targets, begin, count = np.unique(to[order], return_index=True, return_counts=True)
        width = LINKS + int(count.max(initial=0))
        held = np.full((len(targets), width), -1, dtype=np.int32)
        held[:, :LINKS] = self.low[targets, :LINKS]
        row = np.repeat(np.arange(len(targets)), count)
        held[row, LINKS + np.arange(len(row)) - np.repeat(begin, count)] = source[order]
        for a in range(0, len(targets), AT_ONCE):
            ids = np.sort(held[a : a + AT_ONCE], axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            t = targets[a : a + AT_ONCE]
            sims = np.where(ids >= 0, np.einsum("qd,qkd->qk", self.x[t], self.x[np.maximum(ids, 0)]), -2)
            s, i = best_of(sims, ids, 2 * LINKS)
            self.low[t, :LINKS] = select(s, i, self.x, LINKS)

    def _reach(self) -> None:
        """Nodes that cannot be reached from the first are linked from the nearest that can: as its first, before those it has."""
        got = np.zeros(self.size, dtype=bool)
        edge = np.zeros(1, dtype=np.int64)
        while len(edge):
            got[edge] = True
            near = np.unique(self.low[edge])
            edge = near[near >= 0]
            edge = edge[~got[edge]]
        held, lost = np.flatnonzero(got), np.flatnonzero(~got)
        for a in range(0, len(lost), AT_ONCE):
            own = lost[a : a + AT_ONCE]
            for u, p in zip(own, held[(self.x[own] @ self.x[held].T).argmax(axis=1)], strict=True):
                self.low[u, LINKS + 1] = self.low[p, LINKS]
                self.low[p, LINKS] = u

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for all queries together: cosines and nodes [queries, beam], best first, -1 where there are fewer."""
        sims, ids = np.full((len(q), beam), -2, dtype=np.float32), np.full((len(q), beam), -1, dtype=np.int32)
        per = at_once(beam)
        for a in range(0, len(q), per):
            sims[a : a + per], ids[a : a + per] = self._search(q[a : a + per], beam)
        return sims, ids

    def _entry(self, q: np.ndarray) -> np.ndarray:
        """Walk down the upper levels from the first node."""
        at = np.zeros(len(q), dtype=np.int32)
        best = q @ self.x[0]
        for links in reversed(self.levels):
            moving = np.arange(len(q))
            while len(moving):
                near = links[at[moving]]
                s = np.where(near >= 0, np.einsum("qd,qkd->qk", q[moving], self.x[np.maximum(near, 0)]), -2)
                k = s.argmax(axis=1)
                top_s = s[np.arange(len(moving)), k]
                better = top_s > best[moving]
                moving, k, top_s, near = moving[better], k[better], top_s[better], near[better]
                at[moving], best[moving] = near[np.arange(len(moving)), k], top_s
        return at

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """From the node that the upper levels lead to and from the first one; a wide beam takes larger steps."""
        n, step = len(q), max(4, beam // STEPS)
        at = self._entry(q)
        seen = np.zeros((n, self.size), dtype=bool)
        ids, sims, done = np.full((n, beam), -1, np.int32), np.full((n, beam), -2, np.float32), np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0] = at, np.einsum("qd,qd->q", q, self.x[at])
        if beam > 1:
            other = at != 0
            ids[other, 1], sims[other, 1] = 0, q[other] @ self.x[0]
        seen[np.arange(n), at] = seen[:, 0] = True
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live] | (ids[live] < 0), -3, sims[live])
            some = open_.max(axis=1) > -3
            live, open_ = live[some], open_[some]
            if not len(live):
                break
            pick = np.argpartition(-open_, step, axis=1)[:, :step] if beam > step else np.argsort(-open_, axis=1)
            real = np.take_along_axis(open_, pick, axis=1) > -3
            done[live[:, None], pick] |= real
            near = self.low[np.maximum(ids[live[:, None], pick], 0)]
            near = np.sort(np.where(real[:, :, None], near, -1).reshape(len(live), -1), axis=1)
            bad = near < 0
            bad[:, 1:] |= near[:, 1:] == near[:, :-1]
            safe = np.maximum(near, 0)
            bad |= seen[live[:, None], safe]
            rows, cols = np.nonzero(~bad)
            seen[live[rows], safe[rows, cols]] = True
            s = np.full(near.shape, -2, np.float32)
            s[rows, cols] = np.einsum("kd,kd->k", q[live[rows]], self.x[safe[rows, cols]])
            every_s = np.concatenate((sims[live], s), axis=1)
            every_i = np.concatenate((ids[live], np.where(bad, -1, near)), axis=1)
            every_d = np.concatenate((done[live], np.zeros(near.shape, bool)), axis=1)
            order = np.argpartition(-every_s, beam - 1, axis=1)[:, :beam]
            sims[live], ids[live], done[live] = (np.take_along_axis(z, order, axis=1) for z in (every_s, every_i, every_d))
        return best_of(sims, ids, beam)


def at_once(beam: int) -> int:
    """Queries that are searched together, so that memory is bounded whatever the beam."""
    return max(8, AT_ONCE * BUILD_BEAM // max(beam, BUILD_BEAM))


def found_by(g: Graph, q: np.ndarray, least: np.ndarray, beam: int, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs of cosine >= least[query], some queries at a time; a beam that holds nothing else is doubled, up to all nodes."""
    left, width = np.arange(len(q)) if which is None else which, min(beam, g.size)
    while len(left):
        wider, per = [left[:0]], at_once(width)
        for a in range(0, len(left), per):
            own = left[a : a + per]
            sims, ids = g.search(q[own], width)
            full = (sims[:, -1] >= least[own]) & (width < g.size)
            r, c = np.nonzero((sims >= least[own, None]) & (ids >= 0) & ~full[:, None])
            yield own[r], ids[r, c]
            wider.append(own[full])
        left, width = np.concatenate(wider), min(2 * width, g.size)


def worst_recall(true: tuple[np.ndarray, np.ndarray], found: tuple[np.ndarray, np.ndarray], n: int) -> tuple[float, int, int]:
    """The least share of its true pairs that any query has among the found ones (1 without pairs); true pairs; how many
    of them were found. n: nodes of the graph."""
    query, owner = np.unique(true[0], return_inverse=True)
    if not len(query):
        return 1.0, 0, 0
    near = np.isin(found[0], query)
    hit = np.isin(true[0].astype(np.int64) * n + true[1], found[0][near].astype(np.int64) * n + found[1][near])
    return float((np.bincount(owner, weights=hit) / np.bincount(owner)).min()), len(hit), int(hit.sum())


def audited(g: Graph, q: np.ndarray, least: np.ndarray, own: np.ndarray, beam: int = BEAM) -> tuple[int, int, int]:
    """The beam that passes the audit; how many pairs the audit asked for, and how many that beam found.

    own: of each query, the node that is the query itself (-1: none), which no audit counts. Of DRAWN queries the
    first AUDITED, and the first AUDITED with links, are compared with all nodes. Every one is judged by itself,
    so a hot group cannot hide what others miss. The beam is doubled until it passes or is as wide as the
    graph, every node of which can be reached.
    """
    drawn = np.random.default_rng(len(q)).permutation(len(q))[:DRAWN]
    low = least - SLACK

    def found(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = list(found_by(g, q, low, beam, which))
        return np.concatenate([r for r, _ in pairs]), np.concatenate([c for _, c in pairs])

    if not len(drawn):
        return beam, 0, 0
    row, node = found(drawn)
    some = np.zeros(len(q), dtype=bool)
    some[row[node != own[row]]] = True
    chosen = np.unique(np.concatenate((drawn[:AUDITED], drawn[some[drawn]][:AUDITED])))
    true = [np.zeros((2, 0), int)]
    for a in range(0, len(chosen), AT_ONCE):
        at = chosen[a : a + AT_ONCE]
        r, c = np.nonzero(q[at] @ g.x.T >= least[at, None] + SLACK / 2)
        true.append(np.stack((at[r], c)))
    asked = np.concatenate(true, axis=1)
    asked = asked[:, asked[1] != own[asked[0]]]
    while True:
        recall, wanted, hits = worst_recall((asked[0], asked[1]), (row, node), g.size)
        if recall >= RECALL or beam >= g.size:
            return beam, wanted, hits
        beam = min(2 * beam, g.size)
        row, node = found(chosen)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids as few links that join the same ids: each to the least that it reaches."""
    names, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(names))
    while True:
        old = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == old).all():
            break
    own = label != np.arange(len(names))
    return names[own], names[label[own]]


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _built(group: pd.DataFrame, joined: float) -> pd.DataFrame:
    group = group.sort_values("vec_id")
    raw = np.stack(group["v"].to_numpy())
    v = raw.astype(np.float64)
    unit = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    g, rows, leader = Graph.build(unit, joined)
    blob = _pack(raw=raw, low=g.low, rows=rows, leader=leader, ids=group["vec_id"].to_numpy(), copies=group["copies"].to_numpy())
    return pd.DataFrame({"dim": [group["dim"].iloc[0]], "shard": [group["shard"].iloc[0]], "graph": [blob]})


@dataclass
class Shard:
    """unit: in double precision; rows: of each node of the graph, its row; leader: of each row, its node; members: rows by
    node, those of node k from first[k] on; angle: of each node, the largest to a member; weight: copies of its members."""

    ids: np.ndarray
    copies: np.ndarray
    unit: np.ndarray
    rows: np.ndarray
    leader: np.ndarray
    graph: Graph

    @classmethod
    def of(cls, blob: bytes) -> Shard:
        held = np.load(io.BytesIO(blob))
        v = held["raw"].astype(np.float64)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        return cls(held["ids"], held["copies"], unit, held["rows"], held["leader"], Graph(unit[held["rows"]].astype(np.float32), held["low"]))

    def __post_init__(self) -> None:
        n = len(self.rows)
        self.members = np.argsort(self.leader, kind="stable")
        self.first = np.searchsorted(self.leader[self.members], np.arange(n + 1))
        cosine = np.einsum("kd,kd->k", self.unit, self.unit[self.rows[self.leader]])
        own = np.where(self.rows[self.leader] == np.arange(len(self.leader)), 0.0, np.arccos(np.clip(cosine, -1, 1)) + ROUNDING)
        self.angle = np.zeros(n)
        np.maximum.at(self.angle, self.leader, own)
        self.weight = np.bincount(self.leader, weights=self.copies, minlength=n)

    def of_node(self, k: int) -> np.ndarray:
        return self.members[self.first[k] : self.first[k + 1]]


def compared(a: Shard, b: Shard, least: float) -> tuple[pd.DataFrame, int, int]:
    """Rows (a, n, b): how many links a vector has in the other shard (or its own); and few links a - b that join what is linked.

    a and b are the same shard, or two of which each link is looked for from a.
    """
    same, most = a is b, float(np.arccos(min(1.0, least)))
    reach = np.cos(np.minimum(np.pi, most + a.angle + b.angle.max(initial=0)))
    own = np.arange(len(a.rows)) if same else np.full(len(a.rows), -1)
    beam, wanted, hits = audited(b.graph, a.graph.x, reach, own)
    n_a, n_b = np.zeros(len(a.ids)), np.zeros(len(b.ids))
    to_a, to_b = np.zeros(len(a.rows)), np.zeros(len(b.rows))
    held = np.flatnonzero(a.rows[a.leader] != np.arange(len(a.leader))) if same else np.zeros(0, int)
    links = [np.stack((a.ids[held], a.ids[a.rows[a.leader[held]]]))]
    for row, node in found_by(b.graph, a.graph.x, reach - SLACK, beam):
        row, node = row[node != own[row]], node[node != own[row]]
        cosine = np.einsum("kd,kd->k", a.unit[a.rows[row]], b.unit[b.rows[node]])
        angle, spread = np.arccos(np.clip(cosine, -1, 1)), a.angle[row] + b.angle[node]
        single = spread == 0
        sure = np.where(single, cosine >= least, angle + spread <= most - ROUNDING)
        np.add.at(to_a, row[sure], b.weight[node[sure]])
        np.add.at(to_b, node[sure], a.weight[row[sure]])
        links.append(np.stack(spanning(a.ids[a.rows[row[sure]]], b.ids[b.rows[node[sure]]])))
        open_ = ~sure & ~single & (angle - spread <= most + ROUNDING)
        for i, j in zip(row[open_], node[open_], strict=True):
            x, y, joined = a.of_node(i), b.of_node(j), False
            for k in range(0, len(x), AT_ONCE):
                part = x[k : k + AT_ONCE]
                near = a.unit[part] @ b.unit[y].T >= least
                n_a[part] += near @ b.copies[y]
                n_b[y] += a.copies[part] @ near
                if not joined and near.any():
                    joined = True
                    r, c = np.unravel_index(near.argmax(), near.shape)
                    links.append(np.array([[a.ids[part[r]]], [b.ids[y[c]]]]))
    n_a += to_a[a.leader]
    if same:  # each end is a query: what it finds is its own
        n_a += np.where(a.angle[a.leader] > 0, a.weight[a.leader] - a.copies, 0)
        n_b = np.zeros(0)
    else:
        n_b += to_b[b.leader]
    u, v = spanning(*np.concatenate(links, axis=1))
    ids, n = np.concatenate((a.ids, b.ids[: len(n_b)])), np.concatenate((n_a, n_b))
    some = n > 0
    return pd.DataFrame({"a": np.concatenate((ids[some], u)), "n": np.concatenate((n[some].astype(np.int64), np.zeros(len(u), np.int64))), "b": np.concatenate((ids[some], v))}), wanted, hits


def pairs_of(graphs: DataFrame, n_shards: int, near: int, width: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides of the pairs (s, t) of shards with t - s from near to near + width - 1, and how many they are."""
    shard, far = F.col("shard"), near + width - 1
    later, earlier = F.sequence(shard + near, F.least(shard + far, F.lit(n_shards - 1))), F.sequence(F.greatest(shard - far, F.lit(0)), shard - near)
    asking = graphs.where(shard + near < n_shards).select("dim", shard.alias("s"), F.explode(later).alias("t"), "graph")
    asked = graphs.where(shard >= near).select("dim", F.explode(earlier).alias("s"), shard.alias("t"), "graph")
    return asking, asked, sum(n_shards - d for d in range(near, min(far + 1, n_shards)))


def near_vectors(rows: DataFrame, *, least: float = 0.9, shard_size: int = SHARD, shards: int = SHARDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A written table, one row per row: vec_id, n_links (other vectors linked directly), component_id, kept, audit_recall.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as
    do vectors of different lengths and rows with a null id. Equal vectors are one node that counts
    as often as it stands. Rows that share an id are one vector with the links of all. audit_recall
    is the share of the audits' links that the last beams found, the same in all rows (null: there were none).
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    with passing(rows.sparkSession):
        return cut(_linked(rows, least, shard_size, shards, id_col, vector_col), lasting=True)


def _linked(rows: DataFrame, least: float, shard_size: int, shards: int, id_col: str, vector_col: str) -> DataFrame:
    spark = rows.sparkSession
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    held = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    held = held.withColumn("x", F.xxhash64("v")).withColumn("y", F.hash("v"))
    nodes = cut(held.where("fine").groupBy("x", "y").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v")).select("vec_id", "copies", "v", F.size("v").alias("dim")))
    n, numbers = nodes.agg(F.count("*"), F.sum("dim")).first()
    n_shards = max(shards, -(-n // shard_size), -(-(numbers or 0) // SHARD_NUMBERS))
    n_parts = n_partitions(spark)
    own = nodes.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    angle = JOINED * float(np.arccos(least))
    graphs = cut(own.repartition(max(n_parts, 4 * n_shards), "dim", "shard").groupBy("dim", "shard").applyInPandas(lambda group: _built(group, angle), "dim int, shard int, graph binary"))

    def met(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):  # no vector of this length in one of them
            return pd.DataFrame({"a": [], "n": [], "b": []})
        a = Shard.of(one["graph"].iloc[0])
        out, wanted, hits = compared(a, a if one["s"].iloc[0] == one["t"].iloc[0] else Shard.of(two["graph"].iloc[0]), least)
        return pd.concat((out, pd.DataFrame({"a": [None], "n": [wanted], "b": [hits]}))).astype("Int64")

    # Each shard against itself and every later one, those of some distances at a time: a round holds few copies of a shard.
    answers, width = None, max(1, min(n_shards, PAIRS_A_ROUND // n_shards))
    for near in range(0, n_shards, width):
        asking, asked, pairs = pairs_of(graphs, n_shards, near, width)
        parts = max(n_parts, 4 * pairs)
        deal = lambda df, parts=parts: df.repartition(parts, "dim", "s", "t").groupBy("dim", "s", "t")
        found = cut(deal(asking).cogroup(deal(asked)).applyInPandas(met, "a long, n long, b long"))
        answers = found if answers is None else answers.union(found)
    audit = answers.where("a IS NULL").agg(F.sum("n"), F.sum("b")).first()
    counts = answers.where("a IS NOT NULL").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    met_ = held.where("fine").join(held.where("fine").groupBy("x", "y").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), ["x", "y"])
    copies = met_.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    comp = components(answers.where("a <> b").select("a", "b").union(copies))
    linked = met_.select("vec_id", "node", "copies").join(counts.withColumnRenamed("vec_id", "node"), "node", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    good = linked.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = held.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    recall = F.lit(audit[1] / audit[0] if audit[0] else None).cast("double")
    return good.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audit_recall", recall)
