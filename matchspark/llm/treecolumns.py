"""Trained tree ensembles as column expressions, so that scoring is plain DataFrame work."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_TREE = re.compile(r"Tree \d+ \(weight ([-\d.eE]+)\)")
_SPLIT = re.compile(r"If \(feature (\d+) <= ([-\d.eE]+)\)")


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def column(self, feature: Callable[[int], Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(feature(self.feature) <= F.lit(self.threshold), self.left.column(feature)).otherwise(
            self.right.column(feature))


def read_trees(description: str) -> list[tuple[float, Node]]:
    """(weight, tree) of every tree in a model's ``toDebugString``."""
    lines = [line.strip() for line in description.splitlines()]
    trees = []
    at = 0

    def node() -> Node:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return Node(value=float(line.split(":")[1]))
        split = _SPLIT.match(line)
        if not split:
            raise ValueError(f"not a split on a number: {line}")
        left = node()
        at += 1  # the line of the other side
        return Node(feature=int(split[1]), threshold=float(split[2]), left=left, right=node())

    while at < len(lines):
        head = _TREE.match(lines[at])
        at += 1
        if head:
            trees.append((float(head[1]), node()))
    return trees


def weighted_sum(trees: list[tuple[float, Node]], feature: Callable[[int], Column]) -> Column:
    total = F.lit(0.0)
    for weight, tree in trees:
        total = total + F.lit(weight) * tree.column(feature)
    return total
