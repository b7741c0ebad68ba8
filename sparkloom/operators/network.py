"""Structure of a discrete network: named variables and parent → child links.

The structure has one entry per column of the observation table, so it lives on
the driver. Graphs that grow with the data use :mod:`sparkloom.operators.dag`.
"""

from __future__ import annotations


def _names(item) -> list:
    return list(item) if isinstance(item, (list, set, frozenset)) else [item]


class Network:
    """``Network("a", ("a", "b"), (["a", "b"], ["c", "d"]))``.

    A bare name declares a variable. A pair links every name on its left side to
    every name on its right side.
    """

    def __init__(self, *structure):
        links, names = set(), set()
        for item in structure:
            if isinstance(item, tuple):
                upper, lower = item
                links |= {(p, c) for p in _names(upper) for c in _names(lower)}
            else:
                names.add(item)
        names |= {n for link in links for n in link}
        self.edges = sorted(links)
        self.parents = {n: sorted(p for p, c in links if c == n) for n in names}
        self.children = {n: sorted(c for p, c in links if p == n) for n in names}
        self.nodes = self._topological(names)

    def _topological(self, names) -> list:
        level, todo = {}, set(names)
        while todo:
            ready = [n for n in todo if all(p in level for p in self.parents[n])]
            if not ready:
                raise ValueError(f"the structure has a cycle through {sorted(todo)}")
            for n in ready:
                level[n] = 1 + max((level[p] for p in self.parents[n]), default=-1)
            todo -= set(ready)
        return sorted(names, key=lambda n: (level[n], n))

    @property
    def roots(self) -> list:
        return [n for n in self.nodes if not self.parents[n]]

    @property
    def is_tree(self) -> bool:
        return all(len(p) <= 1 for p in self.parents.values())

    def family(self, node) -> list:
        """Parents in name order, then the node."""
        return [*self.parents[node], node]

    def ancestors(self, *nodes) -> set:
        found, todo = set(), list(nodes)
        while todo:
            fresh = set(self.parents[todo.pop()]) - found
            found |= fresh
            todo += fresh
        return found

    def markov_boundary(self, node) -> list:
        """Parents, children and the children's other parents."""
        kids = self.children[node]
        spouses = {p for kid in kids for p in self.parents[kid]}
        return sorted(({*self.parents[node], *kids} | spouses) - {node})

    def depth_first(self) -> list:
        """Preorder from the roots, children in name order, each node once."""
        order, seen = [], set()
        stack = list(reversed(self.roots))
        while stack:
            node = stack.pop()
            if node not in seen:
                seen.add(node)
                order.append(node)
                stack += reversed(self.children[node])
        return order

    def factor_name(self, node) -> str:
        given = ", ".join(map(str, self.parents[node]))
        return f"P({node} | {given})" if given else f"P({node})"
