"""Exact logic at any number of repeated, free or open leaves, by ordered decision diagrams.

An action's compiled gates become one diagram over its leaves: a node asks one leaf and has a branch for satisfied, violated and
unresolved; equal nodes are shared, so leaves that are reached on several paths are asked once. Status, belief, range and stability are
each one pass over the nodes, children first. Leaves that may be settled (free or open ones) are asked first, in the order
of their names; what follows each settlement is then a node of its own, and a leaf that the reduced diagram never asks is irrelevant.

The diagram of an action lives in the action's row, whose size its definition bounds. Rows come through Arrow in batches;
everything around them (joins, grouping) stays with Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from standpoint.operators.scan import spread
from standpoint.schemas import BLOCKED, NEEDS_INFO, READY

SATISFIED, VIOLATED, UNRESOLVED = 0, 1, 2
#: Gates of definitions read as thresholds: how many children must be satisfied.
NEED = {"AND": lambda n, k: n, "OR": lambda n, k: 1, "ATLEAST": lambda n, k: k}
LARGEST_COUNT = 2**31 - 1


class Diagram:
    """``order``: leaf positions in the order in which they are asked. Nodes 0, 1 and 2 are the outcomes; others follow their
    children, so a pass in number order meets children first."""

    def __init__(self, prog: list[dict], root: int, order: list[int]):
        self.order = order
        self.asks, self.branches = [len(order)] * 3, [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
        self.unique: dict[tuple, int] = {}
        self.memo: dict[tuple, int] = {}
        values = [0] * len(order)
        for place, leaf in enumerate(order):
            values[leaf] = self.node(place, SATISFIED, VIOLATED, UNRESOLVED)
        for gate in prog:
            kids = [values[i] for i in gate["kids"]]
            if gate["op"] == "NOT":
                values.append(self.negated(kids[0]))
            else:
                need = NEED[gate["op"]](len(kids), gate["k"])
                values.append(self.threshold(tuple(kids), need, len(kids) - need + 1))
        self.root = values[root]

    def node(self, place: int, *branches: int) -> int:
        if branches[0] == branches[1] == branches[2]:
            return branches[0]
        key = (place, *branches)
        if key not in self.unique:
            self.unique[key] = len(self.asks)
            self.asks.append(place)
            self.branches.append(branches)
        return self.unique[key]

    def negated(self, x: int) -> int:
        if x <= UNRESOLVED:
            return (VIOLATED, SATISFIED, UNRESOLVED)[x]
        key = ("NOT", x)
        if key not in self.memo:
            self.memo[key] = self.node(self.asks[x], *map(self.negated, self.branches[x]))
        return self.memo[key]

    def threshold(self, kids: tuple[int, ...], to_satisfy: int, to_violate: int) -> int:
        """Satisfied by so many satisfied children, violated by so many violated ones."""
        to_satisfy -= kids.count(SATISFIED)
        to_violate -= kids.count(VIOLATED)
        kids = tuple(sorted(c for c in kids if c > UNRESOLVED))
        if to_satisfy <= 0 or to_violate <= 0:
            return SATISFIED if to_satisfy <= 0 else VIOLATED
        if len(kids) < min(to_satisfy, to_violate):
            return UNRESOLVED
        if len(kids) == to_satisfy == to_violate == 1:
            return kids[0]
        key = (kids, to_satisfy, to_violate)
        if key not in self.memo:
            place = min(self.asks[c] for c in kids)
            self.memo[key] = self.node(place, *(self.threshold(tuple(self.branches[c][d] if self.asks[c] == place else c for c in kids), to_satisfy, to_violate) for d in range(3)))
        return self.memo[key]

    def expected(self, weights: list[tuple[float, float, float]], outcomes: tuple[float, float, float], first: int = 0) -> list[float | None]:
        """Of every node that asks nothing before ``first``, the mean of its outcome's value; ``weights`` by place."""
        out: list[float | None] = list(outcomes)
        for place, kids in zip(self.asks[3:], self.branches[3:], strict=True):
            out.append(sum(w * out[c] for w, c in zip(weights[place], kids, strict=True) if w) if place >= first else None)
        return out

    def settled(self, first: int) -> list[int]:
        """The nodes in which the settlements of the places before ``first`` can end."""
        seen, todo, ends = {self.root}, [self.root], []
        while todo:
            x = todo.pop()
            if self.asks[x] >= first:
                ends.append(x)
                continue
            for c in self.branches[x]:
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return ends


def disposition(s: float, v: float, ready: float, block: float) -> str:
    return READY if s >= ready and s >= v else BLOCKED if v >= block else NEEDS_INFO


def _leaf(d: dict) -> tuple[float, float, float]:
    return d["s"], d["v"], d["u"]


def _dispositions(diagram: Diagram, ls: list[dict], first: int, ready: float, block: float) -> Callable[[int], str]:
    """Disposition at a node that settlements end in."""
    weights = [_leaf(ls[leaf]) for leaf in diagram.order]
    s, v = diagram.expected(weights, (1.0, 0.0, 0.0), first), diagram.expected(weights, (0.0, 1.0, 0.0), first)
    return lambda x: disposition(s[x], v[x], ready, block)


def _settled_first(row: dict) -> tuple[Diagram, int]:
    """The diagram with the leaves at ``fpos`` (from 1) asked first."""
    free = [p - 1 for p in row["fpos"]]
    return Diagram(row["prog"], row["root"], free + [i for i in range(len(row["leaves"])) if i not in set(free)]), len(free)


def evaluated(row: dict) -> dict:
    """Status distribution and belief."""
    diagram = Diagram(row["prog"], row["root"], list(range(len(row["ls"]))))
    weights = [_leaf(d) for d in row["ls"]]
    s, v, u = (diagram.expected(weights, tuple(float(o == want) for o in range(3)))[diagram.root] for want in range(3))
    belief = diagram.expected([(b, 1.0 - b, 0.0) for b in row["lb"]], (1.0, 0.0, 0.0))[diagram.root]
    return {"s": s, "v": v, "u": u, "belief": belief}


def interval(row: dict) -> dict:
    """Least and largest belief over all values of the free leaves. The belief is linear in each leaf, so certain values hold the
    extremes; each way to set them ends in one node."""
    diagram, first = _settled_first(row)
    belief = diagram.expected([(b, 1.0 - b, 0.0) for b in (row["lb"][leaf] for leaf in diagram.order)], (1.0, 0.0, 0.0), first)
    seen, todo, ends = {diagram.root}, [diagram.root], []
    while todo:
        x = todo.pop()
        if diagram.asks[x] >= first:
            ends.append(belief[x])
            continue
        for c in diagram.branches[x][:2]:
            if c not in seen:
                seen.add(c)
                todo.append(c)
    return {"low": min(max(min(ends), 0.0), 1.0), "high": min(max(max(ends), 0.0), 1.0)}


def certificate(row: dict, ready: float, block: float) -> dict:
    """Whether every settlement of the free leaves keeps the disposition, else the first that does not, counted through in the
    order of names, satisfied before violated before open."""
    diagram, first = _settled_first(row)
    at = _dispositions(diagram, row["ls"], first, ready, block)
    now = evaluated(row)
    current = disposition(now["s"], now["v"], ready, block)
    differs = {x: at(x) != current for x in diagram.settled(first)}
    for x in range(3, len(diagram.asks)):
        if diagram.asks[x] < first and all(c in differs for c in diagram.branches[x]):
            differs[x] = any(differs[c] for c in diagram.branches[x])
    if not differs[diagram.root]:
        return {"current": current, "stable": True, "checked": min(3**first, LARGEST_COUNT), "counterexample": None, "becomes": None}
    x, digits = diagram.root, []
    for place in range(first):
        d = next(d for d in range(3) if differs[diagram.branches[x][d]]) if diagram.asks[x] == place else 0
        x = diagram.branches[x][d] if diagram.asks[x] == place else x
        digits.append(d)
    index = 0
    for d in digits:
        index = 3 * index + d
    words = ("satisfied", "violated", "open")
    return {"current": current, "stable": False, "checked": min(index + 1, LARGEST_COUNT),
            "counterexample": ",".join(f"{n}={words[d]}" for n, d in zip(row["fnames"], digits, strict=True)), "becomes": at(x)}


def irrelevant(row: dict, ready: float, block: float) -> list[str]:
    """Names of the leaves at ``fpos`` whose answer never changes the disposition: the diagram of dispositions, reduced, does not
    ask them."""
    diagram, first = _settled_first(row)
    at = _dispositions(diagram, row["ls"], first, ready, block)
    codes = {READY: 0, BLOCKED: 1, NEEDS_INFO: 2}
    small = {x: codes[at(x)] for x in diagram.settled(first)}
    unique: dict[tuple, int] = {}
    for x in range(3, len(diagram.asks)):
        if diagram.asks[x] < first and all(c in small for c in diagram.branches[x]):
            kids = tuple(small[c] for c in diagram.branches[x])
            small[x] = kids[0] if kids[0] == kids[1] == kids[2] else unique.setdefault((diagram.asks[x], *kids), len(unique) + 3)
    nodes = {n: key for key, n in unique.items()}
    seen, todo = set(), [small[diagram.root]]
    while todo:
        x = todo.pop()
        if x in nodes and x not in seen:
            seen.add(x)
            todo += nodes[x][1:]
    asked = {nodes[x][0] for x in seen}
    return [n for place, n in enumerate(row["fnames"]) if place not in asked]


def per_action(rows: DataFrame, keep: list[str], work: Callable[[dict], dict], result: str) -> DataFrame:
    """``keep`` columns and a column ``out`` (type ``result``) worked out from each action's row, dealt evenly: rows are a few
    bytes but much work."""
    read = [c for c in ("prog", "root", "leaves", "ls", "lb", "fnames", "fpos") if c in rows.columns]
    schema = rows.select(*keep, F.lit(None).cast(result).alias("out")).schema
    arrow = to_arrow_type(schema["out"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [work(r) for r in b.select(read).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, arrow)], names=[*keep, "out"])

    return spread(rows.select(*dict.fromkeys([*keep, *read])), *[c for c in keep if c in ("task_id", "action_id")]).mapInArrow(run, schema)
