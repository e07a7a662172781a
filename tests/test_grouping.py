"""Sets of files: the plan against Python, and piecewise against whole."""

import itertools
import random

import pytest

from shelfspark.operators import grouping

MEMBERS, PAIRS, KEYS, LINKS = "file long, track long, key string, library boolean", "a long, b long, outcome string", "key_a string, key_b string", "track_a long, track_b long"


def brute(members, pairs, apart, same, links, most):
    node = {f: t if t is not None else -f - 1 for f, t, _, _ in members}
    key = {f: k for f, _, k, _ in members}
    files, library = {}, {}
    for f, _, _, lib in members:
        files.setdefault(node[f], []).append(f)
        library[node[f]] = library.get(node[f], False) or lib
    holds = {n: {key[f] for f in fs if key[f]} for n, fs in files.items()}

    def called(decisions):
        out = set()
        for ka, kb in decisions:
            for x, y in itertools.permutations(files, 2):
                if ka in holds[x] and kb in holds[y] and (ka != kb or (library[x] and library[y])):
                    out.add((min(x, y), max(x, y)))
        return out

    apart, same = called(apart), called(same)
    links = {(min(p), max(p)) for p in links if p[0] in files and p[1] in files} - same
    parent = {n: n for n in files}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    def held(group, unit):
        units = {unit[n] for n in group}
        if sum(any(library[n] for n in group if unit[n] == u) for u in units) >= 2:
            return "library"
        for name, ends in (("linked", links), ("apart", apart)):
            if any(x in group and y in group and unit[x] != unit[y] for x, y in ends):
                return name
        return None

    unit = {n: n for n in files}
    groups = {}
    for n, fs in files.items():
        ks = {key[f] for f in fs}
        if len(ks) == 1 and None not in ks:
            groups.setdefault(ks.pop(), []).append(n)
    for g in groups.values():
        if held(g, {n: n for n in g}) is None:
            for n in g:
                unit[n] = min(g)
    outcome = {(a, b): o for a, b, o in pairs if a in node and b in node}
    edges = [(unit[node[a]], unit[node[b]]) for (a, b), o in outcome.items() if o == "duplicate"] + [(unit[x], unit[y]) for x, y in same]
    edges += [(unit[x], unit[y]) for x, y in itertools.combinations(files, 2) if holds[x] & holds[y]]
    parent = {u: u for u in unit.values()}
    for x, y in edges:
        x, y = find(parent, x), find(parent, y)
        parent[max(x, y)] = min(x, y)
    out = []
    for s in {find(parent, u) for u in parent}:
        group = [n for n in files if find(parent, unit[n]) == s]
        units = {unit[n] for n in group}
        mine = [f for n in group for f in files[n]]
        if len(units) == 1:
            verdict = "single"
        elif not (verdict := held(group, unit)):
            called_units = {tuple(sorted((unit[x], unit[y]))) for x, y in same}
            if len({key[f] for f in mine}) == 1 and key[mine[0]]:
                verdict = "merge"
            elif len(mine) > most:
                verdict = "differ"
            else:
                verdict = "merge"
                for x, y in itertools.combinations(sorted(mine), 2):
                    ux, uy = unit[node[x]], unit[node[y]]
                    if ux == uy or tuple(sorted((ux, uy))) in called_units or (key[x] and key[x] == key[y]):
                        continue
                    o = outcome.get((x, y), "undecided")
                    if o not in ("duplicate", "undecided"):
                        verdict = "differ"
                    elif o == "undecided" and verdict == "merge":
                        verdict = "wait"
        out += [(f, node[f], unit[node[f]], s, verdict) for f in mine]
    return sorted(out)


def world(seed):
    rng = random.Random(seed)
    n = 60
    members = [(f, rng.choice([None, rng.randrange(1, 30)]), rng.choice([None, None, f"k{rng.randrange(25)}"]), rng.random() < 0.15) for f in range(1, n)]
    pairs = {}
    for _ in range(70):
        a, b = sorted(rng.sample(range(1, n), 2))
        pairs[a, b] = rng.choice(["duplicate", "duplicate", "duplicate", "undecided", "cut"])
    k = lambda: f"k{rng.randrange(25)}"
    return members, [(a, b, o) for (a, b), o in pairs.items()], [(k(), k()) for _ in range(4)], [(k(), k()) for _ in range(4)], [(rng.randrange(1, 30), rng.randrange(1, 30)) for _ in range(5)]


def frames(spark, w):
    return [spark.createDataFrame(x, s) for x, s in zip(w, (MEMBERS, PAIRS, KEYS, KEYS, LINKS))]


@pytest.mark.parametrize("seed", range(3))
def test_plan_and_change(spark, seed):
    w = world(seed)
    before = frames(spark, w)
    planned = grouping.stored(grouping.plan(*before, most=6), "test-plan")
    assert sorted(map(tuple, planned.collect())) == brute(*w, 6)
    rng = random.Random(100 + seed)
    members = [m for m in w[0] if rng.random() > 0.1] + [(100 + i, rng.choice([None, 3, 7]), rng.choice([None, "k1", "k2"]), False) for i in range(4)]
    members = [(f, t, "k3" if f == members[0][0] else k, lib) for f, t, k, lib in members]
    pairs = [p for p in w[1] if rng.random() > 0.1] + [(1, 100, "duplicate"), (100, 101, "duplicate"), (2, 102, "cut")]
    after = (members, pairs, *w[2:])
    now = frames(spark, after)
    touched = grouping.touched_files(before[0], now[0], ["file"], ["file"]).union(grouping.touched_files(before[1], now[1], ["a", "b"], ["a", "b"])).distinct()
    got = grouping.replan(planned, touched, *now, most=6)
    assert sorted(map(tuple, got.collect())) == brute(*after, 6)


def test_few_are_worked_out_again(spark):
    members = [(f, None, None, False) for f in range(1, 41)]
    pairs = [(f, f + 1, "duplicate") for f in range(1, 40, 2)]
    w = (members, pairs, [], [], [])
    planned = grouping.plan(*frames(spark, w))
    assert {r.verdict for r in planned.collect()} == {"merge"}
    touched = spark.createDataFrame([(1,), (3,)], "file long")
    fresh = grouping.replan(planned, touched, *frames(spark, (members, [*pairs, (1, 3, "duplicate")], [], [], [])))
    rows = {r.file: r for r in fresh.collect()}
    assert [rows[f].verdict for f in (1, 2, 3, 4)] == ["wait"] * 4 and rows[5].verdict == "merge" and len({rows[f].set for f in (1, 2, 3, 4)}) == 1


def test_destinations(spark):
    members = [(1, 10, "a", False), (2, 11, "a", True), (3, None, "b", False), (4, None, "b", False), (5, 12, None, False)]
    w = frames(spark, (members, [], [], [], []))
    got = grouping.destinations(w[0], grouping.plan(*w))
    assert sorted(map(tuple, got.collect())) == [(1, 11, None), (2, 11, None), (3, None, 3), (4, None, 3), (5, 12, None)]
