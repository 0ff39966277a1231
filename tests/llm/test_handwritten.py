import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import grammar as G
from docloom.llm import handwritten as H


def expand(seq):
    base = int(0x9E3779B97F4A7C15)
    h = 0
    for x in seq:
        h = (h * base + int(x)) % 2**64
    return h


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=60))
def test_grammar(a, b):
    tokens = [101, 103, 107, 109]
    x, y = [tokens[i] for i in a], [tokens[i] for i in b]
    for shared in (False, True):
        g = G.repair(np.array(x + y, np.uint64), np.array([len(x), len(y)]), shared)
        assert g.tokens.tolist() == [len(x), len(y)] and (g.left <= g.tokens).all() and (g.covered <= g.tokens).all()
        known = {expand(s[i : i + n]) for s in (x, y) for n in range(2, len(s) + 1) for i in range(len(s) - n + 1)}
        assert all(int(h) in known for h in g.rule_hash)
    alone = [G.repair(np.array(z, np.uint64), np.array([len(z)])) for z in (x, y)]
    both = G.repair(np.array(x + y, np.uint64), np.array([len(x), len(y)]))
    assert both.reuse.tolist() == [g.reuse[0] for g in alone]  # a file's grammar is its own


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab_1.9-+ \n'\"é界\U0001f600", max_size=60), st.text(alphabet="ab 1\n\0", max_size=20))
def test_tokens(a, b):
    import re

    t = G.tokenize([a, b])
    for n, text in enumerate((a, b)):
        want = re.findall(r"(?:[^\W]|(?<=\d)\.(?=\d))+|\n|[^\s\w\0]", text)
        assert t.size[t.owner == n].tolist() == [len(w) for w in want]
        assert t.line_end[t.owner == n].tolist() == [w == "\n" for w in want]
        raw = t.raw[t.owner == n].tolist()
        plain = ["0" if w[0].isdecimal() else w for w in want]
        assert all((raw[i] == raw[j]) == (plain[i] == plain[j]) for i in range(len(raw)) for j in range(i))
    two = G.tokenize(['x = "a b" + -1.5\n', "x = 'q' + 22\n"])
    assert two.shape[two.owner[two.plain] == 0].tolist() == two.shape[two.owner[two.plain] == 1].tolist()


def test_no_tokens():
    assert len(G.tokenize([]).raw) == 0 and len(G.tokenize(["", " "]).raw) == 0


def test_repetition_is_reuse():
    rng = np.random.default_rng(1)
    noise, unit = rng.integers(1, 2**62, 4000), rng.integers(1, 2**62, 20)
    g = G.repair(np.concatenate([noise, np.tile(unit, 200)]).astype(np.uint64), np.array([4000, 4000]))
    assert g.reuse[0] < 0.05 and g.reuse[1] > 0.9


def test_grammar_runs_until_nothing_repeats():
    # Fibonacci words need many rounds, and pairs that only overlap themselves must not end the search.
    a, b = [101], [101, 103]
    for _ in range(16):
        a, b = b, b + a
    for sequence in (b, [101, 101, 101, 103, 107, 103, 107, 103, 107, 103, 107]):
        g = G.repair(np.array(sequence, np.uint64), np.array([len(sequence)]))
        assert g.reuse[0] > (0.9 if len(sequence) > 99 else 0)


def test_claims():
    kinds = lambda t, p=None: [(k, x) for k, x, _ in H.claims(p, t)]
    assert kinds("# Code generated by maker v1.2.3. DO NOT EDIT.\nx = 1") == [("tool", "")]
    assert kinds("// Removes every file marked DO NOT EDIT before a release.") == []
    assert kinds("# These names were not generated by the tool; sorted by hand.") == []
    assert kinds("# Part of other/lib, MIT licence.") == [("copy", "other/lib")]
    assert kinds("x = 1", "apps/vendor/x.py") == [] and kinds("x = 1", "docs/third-party-access/x.md") == []
    assert kinds("x = 1", "vendor/forge.example/org/lib/x.go")[0][0] == "copy"
    assert kinds("x = 1", "src/forge.example/org/lib/x.go") == [("copy", "org/lib")]
    assert not H.foreign("org/lib", "org/lib") and H.foreign("org/lib", "me/app") and not H.foreign("me", "me/app") and H.foreign("org/lib", None)


def test_rows(spark):
    hand = "import os\n\n\ndef run(a):\n    # adds one\n    return a + 1\n" * 3
    notice = "# Code generated by maker v{}. DO NOT EDIT.\n"
    rows = [
        (1, "a/x.py", hand, "o/r"), (2, "b/x.py", notice.format("1.2.3") + hand, "o/r"), (3, "b/y.py", notice.format("1.9.3") + hand, "p/s"),
        (4, "third_party/lib/x.py", hand, "o/r"), (5, "third_party/lib/y.py", hand, "p/s"), (6, "x.py", "# Part of o/r, MIT licence.\n" + hand, "o/r"),
        (7, "d.py", "DATA = [\n" + "    1.5, 2.25, 3.125, 4.0,\n" * 60 + "]\n", "o/r"), (8, "app.js", "!function(a,b){a.c=b+a}(t,e);" * 60, "o/r"), (9, "e.py", "", "o/r"), (10, None, None, None),
        (11, "c.json", '{\n  "a": 1,\n  "b": "x"\n}\n', "o/r"), (7, "d.py", "DATA = [\n" + "    1.5, 2.25, 3.125, 4.0,\n" * 60 + "]\n", "o/r"), (12, "package-lock.json", "{}", "o/r"),
    ]
    df = spark.createDataFrame(rows, "id int, path string, content string, repo string").selectExpr("*", "'x' AS kind", "'y' AS hashes")
    found = sorted(r["id"] for r in H.not_handwritten(df, "id", "path", "content", "repo").collect())
    assert found == [2, 3, 4, 5, 7, 8]
    assert H.not_handwritten(df.limit(0), "id", "path", "content", "repo").count() == 0


def test_copies_without_header(spark):
    rng = np.random.default_rng(3)
    code = lambda n: "\n".join(f"def f{rng.integers(1 << 40):x}_x(a):\n    return a.q{rng.integers(1 << 40):x}_y + b" for _ in range(n)) + "\n"
    lib, pair, mine = code(150), code(150), code(150)
    rows = [(i, f"util/{i}.py", lib, f"o/r{i}") for i in range(4)] + [(10 + i, f"src/{i}.py", code(150) + lib[:500], f"o/r{i}") for i in range(4)]
    rows += [(20 + i, "p.py", pair, f"o/r{i}") for i in range(2)] + [(30 + i, "m.py", "# Part of o/r0, MIT licence.\n" + mine, f"o/r{i}") for i in range(3)] + [(40, "n.py", lib, None)]
    rows += [(50, "w.py", "import w  # moved\n" + lib, "o/r9")]
    df = spark.createDataFrame(rows, "id int, path string, content string, repo string")
    found = {r["id"] for r in H.not_handwritten(df, "id", "path", "content", "repo").collect()}
    assert {0, 1, 2, 3, 40, 50} <= found and not found & {*range(10, 14), 20, 21, 30}


def lists(spark):
    hand = "import os\n\n\ndef run(a):\n    # adds one\n    return a + 1\n" * 3
    field = "_F{0} = _descriptor.FieldDescriptor(name='f{0}', full_name='api.F{0}', index={0}, number=1)\n"
    rows = [
        (1, "x.py", "# Copied from lib/one at revision 1a\n" + hand, "o/r"), (2, "y.py", "# Upstream: lib/one\n" + hand, "p/s"),  # a project that two repositories name
        *[(10 + i, "z.py", f"# Upstream: own{i}/lib{i}\n" + hand, f"o/r{i % 2}") for i in range(14)],  # projects named once each
        (30, "t.csv.py", "D = [\n" + "    [1, 2, 3, 'a'],\n" * 60 + "]\n", "o/r"), (31, "s.py", "D = [\n    [1, 2, 3],\n    [4, 5, 6],\n]\n", "o/r"),  # many rows and two rows
        (32, "m.js", "var a=b" + "".join(f";c(d[{i}],e,f)" for i in range(200)), "o/r"), (33, "x_pb2.py", "".join(field.format(i) for i in range(40)), "o/r"),
        (34, "b.py", 'X = "' + "".join(f"{i * 2654435761 % 2**64:016x}Z{i * 40503 % 65536:04x}q" for i in range(200)) + '"\n', "o/r"), (35, "y_pb2.py", "x = 1\n", "o/r"),
    ]
    return spark.createDataFrame(rows, "id int, path string, content string, repo string")


def test_any_batches(spark):
    name, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    try:
        for size in (1, 4, 10_000):
            spark.conf.set(name, size)
            found.append(sorted(r["id"] for r in H.not_handwritten(lists(spark), "id", "path", "content", "repo").collect()))
    finally:
        spark.conf.set(name, before)
    assert found == [[1, 2, 30, 32, 33, 34]] * 3


def test_nothing_without_the_grammar():
    rows = {r[0]: r for r in [(30, "t.py", "D = [\n" + "    [1, 2, 3, 'a'],\n" * 60 + "]\n"), (32, "m.js", "var a=b" + ";c(d,e,f)" * 200), (33, "x_pb2.py", "x = f(a, b)\n" * 40)]}
    found = dict(zip(rows, H.grammars([r[2] for r in rows.values()])))
    assert all(H.by_structure(found[i], r[1], r[2]) for i, r in rows.items())
    off = H.Evidence(0.0, 1.0, 0.0, 0.0, np.zeros(0, np.uint64))
    assert not any(H.by_structure(off, r[1], r[2]) for r in rows.values())


def test_long_texts_and_claims():
    notice = "# " + "x" * 300 + " y"
    assert H.claims(None, "# Part of " + "o" * 250 + "/lib, MIT\n" + notice)[0][1] == "o" * 250 + "/lib"
    assert list(H.grammars([])) == [] and len(list(H.grammars(["a", "b " * 2_000_000, "c"]))) == 3


def many(own, n, seed):
    rng = np.random.default_rng(seed)
    return "\n".join(f"def f{own}{rng.integers(1 << 40):x}_x(a):\n    return a.q{rng.integers(1 << 40):x}_y + b" for _ in range(n)) + "\n"


def test_short_copies(spark):
    """Copies of some 100 tokens, of which a sample of the runs would hold too few."""
    rows = [(10 * k + i, f"u/{k}.py", many("s", 8, k), f"o/r{i}") for k in range(5) for i in range(3)] + [(100 + i, "t.py", many("t", 8, 50 + i), f"o/r{i}") for i in range(3)]
    assert all(71 <= len(G.tokenize([r[2]]).raw) < 192 for r in rows)
    df = spark.createDataFrame(rows, "id int, path string, content string, repo string")
    assert {r["id"] for r in H.not_handwritten(df, "id", "path", "content", "repo").collect()} == {r[0] for r in rows[:15]}


def test_all_runs_count():
    texts = [many("a", 30, 1), "x = 1\n", "", many("b", 6, 2)]
    found = G.tokenize(texts)
    for n, rules in enumerate(H._long_rules(found.raw, np.bincount(found.owner, minlength=len(texts)))):
        tokens = found.raw[found.owner == n].tolist()
        assert len(rules) == len({tuple(tokens[i : i + 64]) for i in range(len(tokens) - 63)})


def test_copies_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    stock = [many(f"k{k}", 6, k) for k in range(4)]
    rows = []
    for i in range(120):
        text = "".join(stock[k] for k in rng.integers(0, 4, 2)) if i % 3 else many(f"o{i}", 12, i)
        rows.append((i if i % 17 else 1000, f"{i}.py", text + f"# tail{i}\n" * int(rng.integers(0, 2)), None if i % 11 == 0 else f"o/r{rng.integers(0, 6)}"))
    runs = {i: set(e.rules.tolist()) for i, e in enumerate(H.grammars([r[2] for r in rows]))}
    uses: dict[int, set[str]] = {}
    for i, r in enumerate(rows):
        for x in runs[i]:
            uses.setdefault(x, set()).update([r[3]] if r[3] else [])
    want = sorted({rows[i][0] for i, mine in runs.items() if len(mine) >= 8 and sum(len(uses[x]) >= 3 for x in mine) >= 0.95 * len(mine)})
    assert 20 < len(want) < 80
    df = spark.createDataFrame(rows, "id int, path string, content string, repo string")
    for characters, together, files in ((10**9, 10**9, 1 << 16), (3000, 500, 1 << 16), (20_000, 10**9, 7)):
        monkeypatch.setattr(H, "PART_CHARACTERS", characters), monkeypatch.setattr(H, "RUNS_TOGETHER", together), monkeypatch.setattr(H, "FILES_TOGETHER", files), monkeypatch.setattr(H, "WIDE_BYTES", characters // 1000)
        assert sorted(r["id"] for r in H.not_handwritten(df, "id", "path", "content", "repo").collect()) == want


def test_uses_in_steps():
    rng = np.random.default_rng(7)
    hashes, repos = rng.integers(0, 400, 5000).astype(np.uint64), rng.integers(0, 5, 5000).astype(np.uint64)
    want = [h for h in range(400) if len(set(repos[(hashes == h) & (repos > 0)].tolist())) >= 3]
    for together in (10, 10_000):
        uses = H.Uses(3, together)
        for at in range(0, 5000, 37):
            uses.add(hashes[at : at + 37], repos[at : at + 37])
        assert uses.wide().tolist() == want
    assert H.Uses(3).wide().tolist() == []
