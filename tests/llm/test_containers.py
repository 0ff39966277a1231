from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import containers as C


def best_fit(sizes, capacity):
    """Containers used by best fit in falling order, item by item."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= size]
        if fitting:
            i = min(fitting, key=lambda i: rooms[i])
            rooms[i] -= size
        else:
            rooms.append(capacity - size)
    return len(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=120))
def test_plan_is_best_fit(sizes):
    capacity = 20
    counts = Counter(sizes)
    slots = C.plan_slots(counts, capacity)
    used = Counter()
    by_length = defaultdict(list)
    for length, rank, first, each in slots:
        by_length[length].append((rank, first, each))
    for length, n in counts.items():
        plan = sorted(by_length[length])
        for r in range(n):
            rank, first, each = [s for s in plan if s[0] <= r][-1]
            used[first + (r - rank) // each] += length
    assert all(v <= capacity for v in used.values())
    assert len(used) == best_fit(sizes, capacity)
    assert not used or sorted(used) == list(range(len(used)))


def test_plan_does_not_grow_with_items():
    small = C.plan_slots({n: 50 for n in range(1, 513)}, 512)
    large = C.plan_slots({n: 5_000_000 for n in range(1, 513)}, 512)
    assert len(large) <= 4 * 512 and len(small) <= 4 * 512


def test_several_capacities_and_hot_lengths(spark):
    sizes = [7] * 400 + [3] * 90 + [20, 41, 0] * 5 + list(range(1, 60))
    df = spark.createDataFrame(list(enumerate(sizes)), "doc int, n int")
    found = C.pack_all(df, "doc", "n", [20, 50, 33], items_per_part=30).collect()
    for capacity in (20, 33, 50):
        rows = [r for r in found if r["capacity"] == capacity]
        fill, got, parts = defaultdict(int), defaultdict(int), []
        for r in rows:
            fill[r["container_id"]] += r["length"]
            got[r["doc"]] += r["length"]
            assert r["start"] == r["part_no"] * capacity
            if r["length"]:
                parts.append(r["length"])
        assert all(got[i] == n for i, n in enumerate(sizes)) and max(fill.values()) <= capacity
        assert sorted(fill) == list(range(len(fill))) and len(fill) == best_fit(parts, capacity)
        assert {r["length"] for r in rows if sizes[r["doc"]] == 59} <= {capacity, 59 % capacity}
    one = sorted(tuple(r) for r in C.pack(df, "doc", "n", 33).collect())
    assert len(one) == len([r for r in found if r["capacity"] == 33])


def test_rows(spark):
    rows = [(i, 7, "x") for i in range(300)] + [(900, None, "x"), (901, 0, "x"), (902, -3, "x"), (903, 53, "x"), (904, 20, "x"), (905, 3, "x"), (905, 3, "x"), (None, 5, "x")]
    df = spark.createDataFrame(rows, "doc int, n long, length string")
    found = C.pack(df, "doc", "n", 20).collect()
    fill = defaultdict(int)
    for r in found:
        fill[r["container_id"]] += r["length"]
    assert max(fill.values()) <= 20 and sum(fill.values()) == 300 * 7 + 53 + 20 + 6 + 5
    big = sorted((r["part_no"], r["start"], r["length"]) for r in found if r["doc"] == 903)
    assert big == [(0, 0, 20), (1, 20, 20), (2, 40, 13)]
    assert {r["container_id"] for r in found if r["doc"] in (900, 901, 902)} == {0}
    assert len([r for r in found if r["doc"] == 905]) == 2 and len(found) == 300 + 3 + 3 + 4
    assert C.pack(df.limit(0), "doc", "n", 20).count() == 0
