import pytest

from graphlift.model import Pattern
from graphlift.plans.order import min_width_order, path_signs, pattern_width, shortest_sign, simple_paths, spanning_tree, width
from graphlift.plans.steps import steps

PATH = Pattern.of(4, [(0, 1), (1, 2), (2, 3)])
CYCLE = Pattern.of(4, [(0, 1), (1, 2), (2, 3), (3, 0)])
CLIQUE = Pattern.of(4, [(a, b) for a in range(4) for b in range(a)])


def test_widths_of_known_shapes():
    assert [pattern_width(p) for p in (PATH, CYCLE, CLIQUE)] == [1, 2, 3]
    assert pattern_width(Pattern.of(1, [])) == 1


@pytest.mark.parametrize("pattern", [PATH, CYCLE, CLIQUE, Pattern.of(6, [(0, i) for i in range(1, 6)])])
def test_every_order_is_connected_and_exact_is_no_wider_than_greedy(pattern):
    exact, greedy = min_width_order(pattern, 8), min_width_order(pattern, 0)
    for order in (exact, greedy):
        assert sorted(order) == list(range(len(pattern.vertices)))
        for i in range(1, len(order)):
            assert pattern.neighbours(order[i]) & set(order[:i])
    assert width(pattern, list(exact)) <= width(pattern, list(greedy))


def test_unconnected_patterns_are_refused_by_the_order():
    with pytest.raises(ValueError):
        min_width_order(Pattern.of(2, []))


def test_simple_paths_and_signs():
    edges = [(0, 1), (2, 1), (0, 2)]
    assert {tuple(v for v, _ in p) for p in simple_paths(edges, 0, 2, 3)} == {(2,), (1, 2)}
    assert path_signs(edges, 0, 2, 3) == ["FB"]
    assert path_signs([*edges, (2, 0)], 0, 2, 3) == ["B", "FB"]
    assert shortest_sign([*edges, (2, 0)], 0, 2, 3) == ["B"]
    assert path_signs([(0, 1), (1, 2)], 0, 2, 1) == []


def test_spanning_tree_and_steps():
    assert spanning_tree(CYCLE) == [(0, 1), (0, 3), (1, 2)]
    plan = steps(CYCLE)
    assert sum(len(s.closing) for s in plan) + sum(s.edge is not None for s in plan) == 4
    assert plan[-1].live == ()
    assert steps(PATH, (0,))[-1].live == (0,)


def test_patterns_refuse_two_labels_and_unknown_vertices():
    p = Pattern.of(2, [(0, 1, 5)])
    with pytest.raises(ValueError):
        p.add_edge(0, 1, 6)
    with pytest.raises(ValueError):
        p.set_edge_label(0, 1, [5, 6])
    with pytest.raises(ValueError):
        p.add_edge(0, 7)
    assert p.set_ids(0, [3, -1]).ids_of(0) is None
    assert p.set_ids(0, 3).ids_of(0) == frozenset([3])
    assert p.set_vertex_label(0, -1).vertices[0].label is None
