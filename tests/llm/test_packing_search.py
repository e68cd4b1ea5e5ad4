import random

import pytest

from kinelake.llm import packing


def optimum(pieces, capacity):
    """The fewest sequences, by trying every place of every piece."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= pieces[i]}:
            at = rooms.index(room)
            place(i + 1, [*rooms[:at], room - pieces[i], *rooms[at + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


def counted(pieces):
    return {x: pieces.count(x) for x in pieces}


def size_of(plan, counts, capacity):
    used = {}
    for pattern, times in plan:
        assert sum(x * k for x, k in pattern) <= capacity
        for x, k in pattern:
            used[x] = used.get(x, 0) + k * times
    assert used == counts
    return sum(n for _, n in plan)


@pytest.mark.parametrize(
    ("pieces", "capacity", "want"),
    [
        ([12, 33, 15, 15, 17, 18, 13, 10, 10, 14, 16], 37, 5),
        ([30, 50, 82, 49, 32, 89, 25, 25, 42, 84, 40], 100, 6),
    ],
)
def test_a_filling_is_reconsidered(pieces, capacity, want):
    counts = counted(pieces)
    assert size_of(packing.plan_sequences(counts, capacity), counts, capacity) == want == optimum(pieces, capacity)


@pytest.mark.parametrize("seed", range(4))
def test_plans_and_search_against_exact_optima(seed):
    rng = random.Random(seed)
    for _ in range(100):
        capacity = rng.choice([10, 20, 37, 100])
        least, most = rng.choice([1, capacity // 6 + 1, capacity // 4]), rng.choice([capacity // 2, capacity])
        pieces = [x for _ in range(5) for x in [rng.randint(least, most)] * rng.randint(1, 3)][:9]
        counts, want = counted(pieces), optimum(pieces, capacity)
        assert size_of(packing.plan_sequences(counts, capacity), counts, capacity) == want
        # The search alone, from a plan with one piece in each sequence.
        functions = packing.bounds(counts, capacity)
        search = packing.Search(counts, capacity, [(((x, 1),), n) for x, n in counts.items()], functions, 10**6)
        assert size_of(search.run(), counts, capacity) == want
        assert search.proven and search.bound <= want


def test_an_ended_search_keeps_a_whole_plan():
    rng = random.Random(2000)
    counts = counted([rng.randint(700, 2000) for _ in range(500)])
    dives = size_of(packing.plan_sequences(counts, 4096, effort=0), counts, 4096)
    assert size_of(packing.plan_sequences(counts, 4096, effort=5000), counts, 4096) <= dives


@pytest.mark.parametrize(
    ("counts", "bound"),
    [
        ({1104: 198211, 787: 64610}, 76839),
        ({1349: 196654, 393: 93854}, 74937),
        ({1822: 123063, 942: 64737, 763: 99913, 512: 142643}, 110234),
    ],
)
def test_few_lengths_reach_the_bound_of_the_relaxation(counts, bound):
    _, prices = packing.relaxation(counts, 4096)
    assert packing.lower_bound(counts, [prices]) == bound
    plan = packing.plan_sequences(counts, 4096)
    assert size_of(plan, counts, 4096) <= bound + 1


@pytest.mark.parametrize("seed", range(3))
def test_prices_are_a_bound_at_any_time(seed):
    rng = random.Random(seed)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100])
        pieces = [x for _ in range(4) for x in [rng.randint(1, capacity)] * rng.randint(1, 3)][:8]
        counts, want = counted(pieces), optimum(pieces, capacity)
        for columns in (1, 3, 100):
            whole, prices = packing.relaxation(counts, capacity, columns)
            assert packing.lower_bound(counts, [prices]) <= want
            assert all(sum(k * t for p, t in whole for y, k in p if y == x) <= n for x, n in counts.items())


def test_the_heaviest_filling_against_all():
    rng = random.Random(4)
    for _ in range(100):
        lengths = rng.sample(range(1, 12), 3)
        most = [min(rng.randint(1, 4), 20 // x) for x in lengths]
        worth = packing.np.array([rng.randint(0, 9) for _ in lengths])
        every = [(a, b, c) for a in range(most[0] + 1) for b in range(most[1] + 1) for c in range(most[2] + 1)]
        want = max(sum(k * w for k, w in zip(f, worth)) for f in every if sum(k * x for k, x in zip(f, lengths)) <= 20)
        got, pieces = packing.heaviest(worth, lengths, most, 20)
        assert got == want == int(pieces @ worth) and pieces @ packing.np.array(lengths) <= 20
        assert all(k <= m for k, m in zip(pieces, most))
