"""Plain versions of matching, for comparison."""

from itertools import permutations


def count(labels: dict[int, int], edges: dict[tuple[int, int], set[int]], p, must: tuple[int, int, int] | None = None) -> int:
    """Injective, non-induced mappings of a pattern; only those that use edge `must` if given."""
    by_label: dict[int, list[int]] = {}
    for v, k in labels.items():
        by_label.setdefault(k, []).append(v)

    def extend(image: list[int]) -> int:
        i = len(image)
        if i == p.n:
            return 1 if must is None or any({image[u], image[v]} == set(must[:2]) and k == must[2] for u, v, k in p.edges) else 0
        total = 0
        for x in by_label.get(p.labels[i], ()):
            if x not in image and all(p.adjacent[i][j] in edges.get((min(x, image[j]), max(x, image[j])), ()) for j in p.adjacent[i] if j < i):
                total += extend([*image, x])
        return total

    return extend([])


def replay(labels, initial, updates, p) -> dict[tuple[int, str], int]:
    """Matches gained or lost by each update, one at a time. updates: (id, op, u, v, elabel)."""
    edges: dict[tuple[int, int], set[int]] = {}
    for u, v, k in initial:
        edges.setdefault((min(u, v), max(u, v)), set()).add(k)
    out = {}
    for i, op, u, v, k in updates:
        here = edges.setdefault((min(u, v), max(u, v)), set())
        if (op == "+") == (k in here):
            continue
        if op == "+":
            here.add(k)
        if n := count(labels, edges, p, (u, v, k)):
            out[i, op] = n
        if op == "-":
            here.discard(k)
    return out


def automorphisms(p) -> set[tuple[int, ...]]:
    e = {(u, v): k for u, v, k in p.edges} | {(v, u): k for u, v, k in p.edges}
    return {a for a in permutations(range(p.n)) if all(p.labels[a[i]] == p.labels[i] for i in range(p.n)) and all(e.get((a[u], a[v])) == k for (u, v), k in e.items())}
