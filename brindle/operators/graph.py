"""Graphs of expressions over the rows of a table, with gradients by the chain rule.

Nodes are sources (columns or constants), trainables (parameters of fixed size) and operations
on them. A graph is evaluated as one projection; its gradient by the parameters is built
backwards as expressions, too, and summed by one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import scalar as S


@dataclass(eq=False)
class Node:
    """value: from the values of the inputs to this one's. back: from them, this value and its gradient to the inputs' gradients."""

    inputs: list[Node]
    value: Callable[[list[list[Column]]], list[Column]]
    back: Callable[[list[list[Column]], list[Column], list[Column]], list[list[Column]]]
    name: str = ""
    start: list[float] = field(default_factory=list)


def source(*columns: Column | str) -> Node:
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return Node([], lambda _: cols, lambda *_: [])


def trainable(name: str, start: list[float]) -> Node:
    """A parameter vector; its present values are constants of each plan."""
    return Node([], lambda _: [], lambda *_: [], name, list(start))


def matmul(a: Node, b: Node) -> Node:
    """Inner product of two vectors."""
    total = lambda x: sum((p * q for p, q in zip(*x, strict=True)), F.lit(0.0))
    return Node([a, b], lambda x: [total(x)], lambda x, _, g: [[g[0] * q for q in x[1]], [g[0] * p for p in x[0]]])


def add(a: Node, b: Node) -> Node:
    return Node([a, b], lambda x: [p + q for p, q in zip(*x, strict=True)], lambda x, _, g: [g, g])


def multiply(a: Node, b: Node) -> Node:
    """Product by element."""
    return Node([a, b], lambda x: [p * q for p, q in zip(*x, strict=True)], lambda x, _, g: [[d * q for d, q in zip(g, x[1], strict=True)], [d * p for d, p in zip(g, x[0], strict=True)]])


def activation(a: Node, kind: str) -> Node:
    """sigmoid, tanh, relu or identity."""
    f = {"sigmoid": S.sigmoid, "tanh": F.tanh, "relu": S.relu, "identity": lambda v: v}[kind]
    d = {"sigmoid": S.d_sigmoid, "tanh": S.d_tanh, "relu": S.d_relu, "identity": lambda y: F.lit(1.0)}[kind]
    return Node([a], lambda x: [f(v) for v in x[0]], lambda x, y, g: [[p * d(v) for p, v in zip(g, y, strict=True)]])


def logistic_loss(logit: Node, label: Node) -> Node:
    """Negative log-likelihood of a 0/1 label."""
    return Node([logit, label], lambda x: [S.logistic_nll(x[0][0], x[1][0])], lambda x, _, g: [[g[0] * (S.sigmoid(x[0][0]) - x[1][0])], [F.lit(0.0)]])


def square_loss(a: Node, label: Node) -> Node:
    return Node([a, label], lambda x: [S.square_loss(x[0][0], x[1][0])], lambda x, _, g: [[g[0] * (x[0][0] - x[1][0])], [F.lit(0.0)]])


def _order(end: Node) -> list[Node]:
    """Inputs before what uses them; each node once, and no cycles."""
    out: list[Node] = []
    open_: set[int] = set()
    done: set[int] = set()

    def visit(n: Node) -> None:
        if id(n) in done:
            return
        if id(n) in open_:
            raise ValueError("a graph has no cycles")
        open_.add(id(n))
        for i in n.inputs:
            visit(i)
        done.add(id(n))
        out.append(n)

    visit(end)
    return out


def _values(order: list[Node], params: dict[str, list[float]]) -> dict[int, list[Column]]:
    got: dict[int, list[Column]] = {}
    for n in order:
        got[id(n)] = [F.lit(float(v)) for v in params[n.name]] if n.name else n.value([got[id(i)] for i in n.inputs])
    return got


def evaluate(end: Node, params: dict[str, list[float]] | None = None) -> Column:
    """The first value of a node, as one expression over the row."""
    order = _order(end)
    held = {n.name: n.start for n in order if n.name} | (params or {})
    return _values(order, held)[id(end)][0]


def gradients(rows: DataFrame, loss: Node, params: dict[str, list[float]]) -> tuple[float, dict[str, list[float]], int]:
    """(summed loss, summed gradients of the trainables, rows): one aggregate over the rows."""
    order = _order(loss)
    values = _values(order, params)
    grads: dict[int, list[Column]] = {id(loss): [F.lit(1.0)]}
    for n in reversed(order):
        if not n.inputs or id(n) not in grads:
            continue
        for i, g in zip(n.inputs, n.back([values[id(j)] for j in n.inputs], values[id(n)], grads[id(n)]), strict=True):
            grads[id(i)] = [a + b for a, b in zip(grads[id(i)], g, strict=True)] if id(i) in grads else g
    wanted = [(n.name, k, grads[id(n)][k]) for n in order if n.name and id(n) in grads for k in range(len(params[n.name]))]
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(values[id(loss)][0]).alias("loss"), *[F.sum(c).alias(f"g{j}") for j, (_, _, c) in enumerate(wanted)]).first()
    out = {name: [0.0] * len(v) for name, v in params.items()}
    for j, (name, k, _) in enumerate(wanted):
        out[name][k] = one[f"g{j}"] or 0.0
    return one["loss"] or 0.0, out, one["n"]


def train(rows: DataFrame, loss: Node, steps: int, lr: float) -> tuple[dict[str, list[float]], list[float]]:
    """Plain gradient steps on the mean loss; the parameters and the mean loss before each step. No rows, no losses."""
    params = {n.name: list(n.start) for n in _order(loss) if n.name}
    losses: list[float] = []
    for _ in range(steps):
        value, g, n = gradients(rows, loss, params)
        if not n:
            break
        losses.append(value / n)
        params = {name: [w - lr * d / n for w, d in zip(v, g[name], strict=True)] for name, v in params.items()}
    return params, losses
