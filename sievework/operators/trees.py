"""Bottom-up folds over tree tables.

A tree table has a row per node: tree, node (its place in depth-first order, from 0), size (how many nodes its subtree has, itself included),
parent (null at a root), parent_kind, ord (its place among its siblings, from 0), kind and own (what it holds itself). The nodes of a subtree stand
next to each other, so a tree is cut into ranges of nodes. A task folds what lies whole within a range, from the last node to the first, and hands on
its value; what reaches beyond the range goes on with what is known of it so far. Each round's ranges are wider: a tree needs
as many rounds as its size has digits, however deep it is, and a very large tree is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.widths import LARGER, ONE_BIT, SHIFTS
from ..sources.tables import drop, stored


@dataclass(frozen=True)
class Fold:
    """How values of children become that of a node.

    ``gather(kind, so_far, ord, value)`` adds a child's value to what is known of a node (None at first), in any order of children. ``merge(kind, a, b)``
    joins what two ranges know of a node. ``close(kind, own, so_far)`` gives the node's value. The types are names of ``_ARROW``.
    """

    gather: Callable[[str, Any, int, Any], Any]
    merge: Callable[[str, Any, Any], Any]
    close: Callable[[str, Any, Any], Any]
    own: str
    state: str
    value: str


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}


def _schema(f: Fold) -> list[tuple[str, str]]:
    return [("tree", "bigint"), ("node", "bigint"), ("size", "bigint"), ("parent", "bigint"), ("parent_kind", "string"), ("ord", "bigint"), ("kind", "string"), ("own", f.own), ("state", f.state), ("value", f.value), ("stage", "bigint")]


#: Stages of a row: a node that is not folded yet, what is known of a node that lies in an earlier range, a folded node.
OPEN, PART, DONE = 0, 1, 2


def _fold(batches: Iterator[pa.RecordBatch], f: Fold, width: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of tree and range, the last node first; parts before the node that they belong to."""
    schema = _schema(f)
    states: dict[int, tuple[str, Any]] = {}
    begun: list[tuple] = []
    here = None

    def known(node: int, kind: str, state: Any) -> None:
        before = states.get(node, (kind, None))[1]
        states[node] = kind, state if before is None else f.merge(kind, before, state)

    def left() -> None:
        begun.extend((here[0], node, None, None, None, None, kind, None, state, None, PART) for node, (kind, state) in states.items())
        states.clear()

    def parts() -> pa.RecordBatch:
        columns = list(zip(*begun)) or [()] * len(schema)
        begun.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])

    for batch in batches:
        # what a row holds passes as it came; only the last three columns are new
        kept, after, values, stages = [], [], [], []
        for i, (tree, node, size, parent, parent_kind, ord_, kind, own, state, _, stage) in enumerate(zip(*(batch.column(n).to_pylist() for n, _ in schema))):
            if here != (tree, node // width):
                if states:
                    left()
                here = tree, node // width
            if state is not None:
                known(node, kind, state)
            if stage == PART:
                continue
            mine = states.pop(node, (kind, None))[1]
            kept.append(i)
            if node + size > (here[1] + 1) * width:
                after.append(mine)
                values.append(None)
                stages.append(OPEN)
                continue
            value = f.close(kind, own, mine)
            after.append(None)
            values.append(value)
            stages.append(DONE)
            if parent is not None:
                states[parent] = parent_kind, f.gather(parent_kind, states.get(parent, ("", None))[1], ord_, value)
        same = batch if len(kept) == batch.num_rows else batch.take(pa.array(kept, pa.int64()))
        new = {"state": pa.array(after, _ARROW[f.state]), "value": pa.array(values, _ARROW[f.value]), "stage": pa.array(stages, pa.int64())}
        yield pa.RecordBatch.from_arrays([new.get(n, same.column(n)) for n, _ in schema], names=[n for n, _ in schema])
        if begun:
            yield parts()
    left()
    yield parts()


def folded(nodes: DataFrame, f: Fold, width: int = 4096, step: int = 64, most_rounds: int = 12) -> DataFrame:
    """``nodes`` with ``value``, a stored table: tree, node, size, parent, ord, kind, own, value.

    Nodes must be numbered in depth-first order without gaps, as ``tree_of_spans`` does.
    """
    types = dict(_schema(f))
    none = lambda n: F.lit(None).cast(types[n]).alias(n)
    rows = nodes.select(*(F.col(n).cast(types[n]).alias(n) for n in ("tree", "node", "size", "parent", "parent_kind", "ord", "kind", "own")), none("state"), none("value"), F.lit(OPEN).cast("bigint").alias("stage"))
    schema = ", ".join(f"{n} {t}" for n, t in _schema(f))
    rounds = []
    for _ in range(most_rounds):
        part = F.call_function("div", F.col("node"), F.lit(width))
        placed = rows.repartition("tree", part).sortWithinPartitions("tree", F.desc("node"), F.desc("stage"))
        rounds.append(stored(placed.mapInArrow(lambda b, width=width: _fold(b, f, width), schema), "fold"))
        rows, width = rounds[-1].where(F.col("stage") != DONE), width * step
        if rows.isEmpty():
            break
    else:
        raise RuntimeError("a tree has nodes that lie outside of it")
    done = None
    for r in rounds:
        found = r.where(F.col("stage") == DONE).drop("state", "stage", "parent_kind")
        done = found if done is None else done.unionByName(found)
    if len(rounds) == 1:
        return done
    out = stored(done, "folded")
    drop(*rounds)
    return out


def tree_of_spans(spans: DataFrame) -> DataFrame:
    """A tree table without kind and own from nested spans: tree, first and end (numbers, spans nest or are apart), ``id`` and more columns.

    A span's parent is the narrowest that holds it. Roots of one tree become siblings without a parent. The parent of a span is the last one before it that is one level
    up, so windows by tree and level find it.
    """
    from pyspark.sql.window import Window

    extra = [c for c in spans.columns if c not in ("tree", "first", "end")]
    rest = F.struct(*(F.col(f"`{c}`") for c in extra), F.lit(0).alias("__")).alias("rest")
    begin = spans.select("tree", F.col("first").alias("at"), F.lit(1).alias("step"), rest)
    stop = spans.select("tree", F.col("end").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast(begin.schema["rest"].dataType).alias("rest"))
    by = Window.partitionBy("tree").orderBy("at", "step")
    numbered = begin.unionByName(stop).withColumns({"depth": F.sum("step").over(by), "n": F.sum((F.col("step") > 0).cast("long")).over(by)})
    level = F.when(F.col("step") > 0, F.col("depth")).otherwise(F.col("depth") + 1)
    in_level = Window.partitionBy("tree", "level").orderBy("at", "step")
    paired = numbered.withColumn("level", level).withColumn("last", F.lead("n").over(in_level)).where("step > 0")
    nodes = paired.select("tree", (F.col("n") - 1).alias("node"), (F.col("last") - F.col("n") + 1).alias("size"), "level", "rest")
    up = nodes.select("tree", "node", (F.col("level") + 1).alias("level"), F.lit(1).alias("up"))
    both = nodes.select("tree", "node", "level", F.lit(0).alias("up"), "size", "rest").unionByName(up, allowMissingColumns=True)
    above = Window.partitionBy("tree", "level").orderBy("node", F.desc("up"))
    placed = both.withColumn("parent", F.last(F.when(F.col("up") == 1, F.col("node")), ignorenulls=True).over(above.rowsBetween(Window.unboundedPreceding, 0))).where("up = 0")
    siblings = Window.partitionBy("tree", "level", "parent").orderBy("node")
    return placed.select("tree", "node", "size", "parent", (F.row_number().over(siblings) - 1).alias("ord"), *(F.col(f"rest.`{c}`").alias(c) for c in extra))


def with_parent_kinds(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, node, parent, kind and more) with ``parent_kind``."""
    kinds = nodes.select("tree", F.col("node").alias("parent"), F.col("kind").alias("parent_kind"))
    return nodes.join(kinds, ["tree", "parent"], "left")


def _must_gather(kind: str, so_far: list[str] | None, ord_: int, value: list[str]) -> list[str] | None:
    if kind in ("loop", "run_loop") and (ord_ == 0) != (kind == "loop"):
        return so_far
    return list(value) if so_far is None else _must_merge(kind, so_far, value)


def _must_merge(kind: str, a: list[str], b: list[str]) -> list[str]:
    return sorted(set(a) & set(b) if kind == "choice" else set(a) | set(b))


def _must_close(kind: str, own: str | None, so_far: list[str] | None) -> list[str]:
    if kind == "assign":
        return [own] if own else []
    return [] if kind == "partial" else so_far or []


#: Names that a block surely assigns. Kinds: assign (own: the name), sequence (all children run), choice (just one child runs), partial (one runs
#: or none), loop (only its first child, the begin, surely runs), run_loop (its body runs at least once; its begin does not count).
MUST_ASSIGN = Fold(_must_gather, _must_merge, _must_close, "string", "array<string>", "array<string>")


def loop_runs(begin: Column, operator: Column, bound: Column) -> Column:
    """Whether a loop surely runs once: its condition holds for the constant it begins with; null if a side is unknown."""
    held = {"<": begin < bound, "<=": begin <= bound, ">": begin > bound, ">=": begin >= bound, "==": begin == bound, "!=": begin != bound}
    out = F.lit(None).cast("boolean")
    for name, value in held.items():
        out = F.when(operator == name, value).otherwise(out)
    return out


def not_always_assigned(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """LC001: (tree, name, node): names that a tree assigns somewhere but not surely, at the first place. ``values``: of ``folded`` with MUST_ASSIGN."""
    somewhere = nodes.where("kind = 'assign' and own <> ''").groupBy("tree", F.col("own").alias("name")).agg(F.min("node").alias("node"))
    surely = values.where("parent is null").select("tree", F.explode("value").alias("name")).distinct()
    return somewhere.join(surely, ["tree", "name"], "left_anti")


def _listed(kind: str, so_far: list[int] | None, ord_: int, value: int | None) -> list[int]:
    """Children as ord, value, ord, value; for sums and largest values only these are kept."""
    if kind in ("concat", "repeat"):
        return [0, value if so_far is None else None if value is None or so_far[1] is None else so_far[1] + value]
    return [*(so_far or []), ord_, value]


def _widths_merged(kind: str, a: list[int], b: list[int]) -> list[int]:
    return _listed(kind, a, 0, b[1]) if kind in ("concat", "repeat") else a + b


def _width(kind: str, own: int | None, so_far: list[int] | None) -> int | None:
    if kind == "leaf":
        return own
    if kind in ("concat", "repeat"):
        total = so_far[1] if so_far else 0
        return total if kind == "concat" or total is None else None if own is None else own * total
    sides = dict(zip(so_far[::2], so_far[1::2])) if so_far else {}
    if kind in ONE_BIT:
        return 1
    if kind in SHIFTS:
        return sides.get(0)
    if kind == "?":
        sides.pop(0, None)
    if kind in LARGER or kind == "?":
        return None if not sides or None in sides.values() else max(sides.values())
    return None


#: Widths of expression trees. Kinds: leaf (own: its width), concat, repeat (own: how often), ? (condition, then the two branches) and the binary operators of ``functions.widths``.
WIDTHS = Fold(_listed, _widths_merged, _width, "bigint", "array<bigint>", "bigint")


_UNARY = {"-": lambda a: -a, "+": lambda a: a, "~": lambda a: ~a, "!": lambda a: int(not a)}
_BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "&": lambda a, b: a & b, "|": lambda a, b: a | b, "^": lambda a, b: a ^ b,
    "/": lambda a, b: (abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1) if b else None,
    "%": lambda a, b: abs(a) % abs(b) * (-1 if a < 0 else 1) if b else None,
    "==": lambda a, b: int(a == b), "!=": lambda a, b: int(a != b), "<": lambda a, b: int(a < b), "<=": lambda a, b: int(a <= b), ">": lambda a, b: int(a > b), ">=": lambda a, b: int(a >= b),
    "&&": lambda a, b: int(bool(a and b)), "||": lambda a, b: int(bool(a or b)),
}


def _constant(kind: str, own: int | None, so_far: list[int] | None) -> int | None:
    if kind == "leaf":
        return own
    sides = [v for _, v in sorted(zip(so_far[::2], so_far[1::2]))] if so_far else []
    if kind == "?" and len(sides) == 3:
        return None if sides[0] is None else sides[1] if sides[0] else sides[2]
    if not sides or None in sides:
        return None
    one = len(sides) == 1
    of = (_UNARY if one else _BINARY).get(kind)
    value = None if of is None else of(sides[0]) if one else of(sides[0], sides[-1])
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


#: Values of constant expressions in signed 64 bits, null where unknown or out of range. Kinds: leaf (own: its value), ? and the unary and binary operators; / and % cut towards nought.
CONSTANTS = Fold(lambda kind, so_far, ord_, value: [*(so_far or []), ord_, value], lambda kind, a, b: a + b, _constant, "bigint", "array<bigint>", "bigint")
