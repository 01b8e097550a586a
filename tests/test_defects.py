"""Dead and always-on blocks against brute force over all assignments."""

import itertools
import random
import re

import pytest

from variscope.operators import blocks as B, clauses as E, constraints as C, defects as D, models as M
from pyspark.sql import functions as F


def random_file(rng):
    names = ["CONFIG_A", "CONFIG_B", "CONFIG_C", "CONFIG_D"]

    def expr():
        a, b = rng.choice(names), rng.choice(names)
        return rng.choice([a, f"!{a}", f"{a} && {b}", f"{a} || !{b}", f"({a} || {b}) && !{rng.choice(names)}"])

    out = []

    def chain(depth):
        out.append(f"#if {expr()}")
        body(depth)
        for _ in range(rng.randint(0, 2)):
            out.append(f"#elif {expr()}")
            body(depth)
        if rng.random() < 0.5:
            out.append("#else")
            body(depth)
        out.append("#endif")

    def body(depth):
        if rng.random() < 0.3:
            out.append(rng.choice(["#define ", "#undef "]) + rng.choice(names))
        if depth < 2 and rng.random() < 0.5:
            chain(depth + 1)

    for _ in range(rng.randint(2, 3)):
        chain(0)
    return "\n".join(out)


def run(text, env):
    """Preprocess: the set of active blocks, and each block's parent."""
    env, active, stack, number, parents = dict(env), set(), [], -1, {}

    def holds(e):
        return eval(re.sub(r"CONFIG_\w+", lambda m: str(env[m.group()]), e).replace("!", " not ").replace("&&", "and").replace("||", "or"))

    for line in text.split("\n"):
        word, _, rest = line.partition(" ")
        live = all(s[1] for s in stack)
        if word == "#if":
            number += 1
            parents[number] = stack[-1][2] if stack else None
            on = live and holds(rest)
            stack.append([on, on, number])
        elif word in ("#elif", "#else"):
            number += 1
            above = stack[:-1]
            parents[number] = above[-1][2] if above else None
            live = all(s[1] for s in above)
            on = live and not stack[-1][0] and (word == "#else" or holds(rest))
            stack[-1] = [stack[-1][0] or on, on, number]
        elif word == "#endif":
            stack.pop()
            continue
        else:
            if live:
                env[rest] = word == "#define"
            continue
        if stack[-1][1]:
            active.add(stack[-1][2])
    return active, parents


NAMES = ["CONFIG_A", "CONFIG_B", "CONFIG_C", "CONFIG_D"]


def brute(text, allowed=lambda env: True):
    """(dead, undead) over all assignments the model allows."""
    seen, missed, any_env, parents = set(), set(), False, {}
    for values in itertools.product([False, True], repeat=4):
        env = dict(zip(NAMES, values))
        if not allowed(env):
            continue
        active, parents = run(text, env)
        seen |= active
        missed |= {b for b, p in parents.items() if b not in active and (p is None or p in active)}
    return set(parents) - seen, set(parents) - missed - (set(parents) - seen)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return [random_file(rng) for _ in range(40)]


def prepared(spark, texts):
    rows = [(i, n + 1, line) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "file_id long, line_no long, txt string")
    tree = B.structure(lines)
    defines = B.define_versions(lines, tree)
    blocks = B.block_tree(tree)
    return blocks, B.rewrite_symbols(blocks, defines), defines


def test_code_defects(spark, texts):
    blocks, rewritten, defines = prepared(spark, texts)
    keys, _, verdicts = D.code_verdicts(D.tested_slices(blocks, rewritten, defines))
    rows = keys.join(verdicts, "sid").filter("verdict = 'no' and block_no >= 0").collect()
    assert keys.join(verdicts, "sid").filter("verdict = 'unknown'").isEmpty()
    dead = {(r.file_id, r.block_no) for r in rows if r.suffix == "dead"}
    undead = {(r.file_id, r.block_no) for r in rows if r.suffix == "undead"} - dead
    want = [brute(t) for t in texts]
    assert dead == {(i, b) for i, (d, _) in enumerate(want) for b in d}
    assert undead == {(i, b) for i, (_, u) in enumerate(want) for b in u}


def test_model_defects(spark, texts):
    """Model: A -> B, C -> !A, D always on; all symbols known."""
    blocks, rewritten, defines = prepared(spark, texts)
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    files = s([(i, "m") for i in range(len(texts))], "file_id long, arch string")
    symbols = s([("m", n, "boolean") for n in NAMES], "arch string, symbol string, type string")
    literals = s([("m", "CONFIG_A", 1, "CONFIG_B", True), ("m", "CONFIG_C", 1, "CONFIG_A", False)],
                 "arch string, symbol string, clause_no int, lit_symbol string, positive boolean")
    forced = s([("m", "CONFIG_D", True)], "arch string, symbol string, on boolean")
    model = M.formulas(symbols, literals)
    related = M.related_symbols(symbols.select("arch", "symbol"), M.model_edges(model))
    meta = s([("m", "X", "y")], "arch string, key string, value string")
    spaces = M.space_regex(symbols.select("arch"), meta)
    complete = M.model_complete(symbols.select("arch"), model, meta)
    found = D.block_defects(blocks, rewritten, defines, files, related, model, E.model_clauses(literals, forced), forced, spaces, complete)
    dead = {(r.file_id, r.block_no) for r in D.dead_blocks(found).collect()}
    undead = {(r.file_id, r.block_no) for r in D.undead_blocks(found).collect()}
    allowed = lambda e: (not e["CONFIG_A"] or e["CONFIG_B"]) and (not e["CONFIG_C"] or not e["CONFIG_A"]) and e["CONFIG_D"]
    want = [brute(t, allowed) for t in texts]
    assert dead == {(i, b) for i, (d, _) in enumerate(want) for b in d}
    assert undead == {(i, b) for i, (_, u) in enumerate(want) for b in u}


@pytest.mark.parametrize("batched", [2048, 8])
def test_large_slices_take_the_relational_way(spark, monkeypatch, batched):
    """A chain of implications, decided in a batch and by relational rounds."""
    monkeypatch.setattr(E, "BATCHED", batched)
    n = 70
    clause = lambda *ls: [(v, p) for v, p in ls]
    rows = [("yes", clause((f"V{i}", False), (f"V{i + 1}", True))) for i in range(n)] + [("yes", clause(("V0", True)))]
    rows += [("no", c) for _, c in rows] + [("no", clause((f"V{n}", False)))]
    df = spark.createDataFrame(rows, "sid string, lits array<struct<var:string,positive:boolean>>")
    # Closing a chain link by link takes a round each, so start it from both ends.
    got = {r.sid: r.verdict for r in E.satisfiable_slices(df.unionByName(spark.createDataFrame(
        [(s, clause((f"V{i}", True))) for s in ("yes", "no") for i in range(n)], df.schema))).collect()}
    assert got == {"yes": "yes", "no": "no"}


def parity(names, helper, odd):
    """Clauses of the sum of ``names`` being odd, or even; partial sums are named after ``helper``."""
    out, last = [], names[0]
    for i, n in enumerate(names[1:]):
        total = f"{helper}{i}"
        out += [
            [(last, False), (n, False), (total, False)], [(last, True), (n, True), (total, False)],
            [(last, True), (n, False), (total, True)], [(last, False), (n, True), (total, True)],
        ]
        last = total
    return out + [[(last, odd)]]


@pytest.mark.parametrize("batched", [2048, 8])
def test_slices_with_many_open_symbols(spark, monkeypatch, batched):
    """The sum of 16 symbols can't be odd and even; more than 12 of them stay open until the search."""
    monkeypatch.setattr(E, "BATCHED", batched)
    names = [f"CONFIG_{i:02}" for i in range(16)]
    one, other = parity(names, "X.", True), parity(names[::-1], "Y.", False)
    apart = [[(f"Z{v}", p) for v, p in c] for c in one]
    slices = {"no": one + other, "yes": one, "part": apart + one + other, "both": apart + one}
    df = spark.createDataFrame([(k, c) for k, cs in slices.items() for c in cs], "sid string, lits array<struct<var:string,positive:boolean>>")
    assert {r.sid: r.verdict for r in E.satisfiable_slices(df).collect()} == {"no": "no", "yes": "yes", "part": "no", "both": "yes"}


def test_extreme_assignments_of_many_open_symbols(spark):
    """Fourteen open symbols, and 70 in five parts, against all masks; a slice without a solution gives no rows."""
    rng, slices = random.Random(3), {}
    for k in range(4):
        slices[f"s{k}"] = [[(f"V{v:02}", rng.random() < 0.6) for v in rng.sample(range(14), 3)] for _ in range(34)]
    slices["wide"] = [[(f"P{part}{v}", p) for v, p in c] for part in range(5) for c in slices["s0"]]
    slices["none"] = slices["s0"] + parity([f"V{i:02}" for i in range(14)], "X.", True) + parity([f"V{i:02}" for i in range(14)][::-1], "Y.", False)
    df = spark.createDataFrame([(k, c) for k, cs in slices.items() for c in cs], "sid string, lits array<struct<var:string,positive:boolean>>")
    for most in (False, True):
        got = {}
        for r in E.extreme_assignment(df, most).collect():
            got.setdefault(r.sid, {})[r.var] = r.val
        want = {}
        for k in ("s0", "s1", "s2", "s3"):
            names = sorted({v for c in slices[k] for v, _ in c})
            fits = (m for m in range(1 << len(names)) if all(any((m >> names.index(v) & 1 == 1) == p for v, p in c) for c in slices[k]))
            best = (max if most else min)(fits, key=lambda m: (m.bit_count(), m))
            want[k] = {n: best >> i & 1 == 1 for i, n in enumerate(names)}
        want["wide"] = {f"P{part}{v}": x for part in range(5) for v, x in want["s0"].items()}
        assert got == want


def test_scope(spark):
    rows = [
        (1, "x", "kconfig", True), (1, "a", "kconfig", False), (1, "b", "kconfig", False),
        (2, "x", "missing", True), (2, "a", "kconfig", False), (2, "b", "clean", False),
        (3, "x", "missing", True), (3, "a", "clean", False), (3, "b", "kconfig", False),
        (4, "x", "code", True),
    ]
    states = spark.createDataFrame([(f, 0, "dead", a, s, m, False) for f, a, s, m in rows],
                                   "file_id long, block_no long, suffix string, arch string, state string, is_main boolean, specific boolean")
    got = {(r.file_id, r.kind, r.arch, r.is_global) for r in D.defect_scope(states).collect()}
    assert got == {(1, "kconfig", "x", True), (2, "kconfig", "a", False), (3, "missing", "x", False), (4, "code", "x", True)}


def test_tree_of_defects_is_one_document_for_each_top_directory(spark):
    import json

    paths = ["a/x.c", "a/b/y.c", "a/b-c/z.c", "a/b/c/d/w.c", 'q"t/e.c', "lone.c"]
    files = spark.createDataFrame(list(enumerate(paths)), "file_id long, path string")
    spots = [(f, b) for f in range(len(paths)) for b in range(0, 3 + f % 2)]
    blocks = spark.createDataFrame([(f, b, 10 * b + 1, 10 * b + 5) for f, b in spots], "file_id long, block_no long, start_line long, end_line long")
    defects = spark.createDataFrame([(f, b, "code", "dead") for f, b in spots if b != 1 or f == 3], "file_id long, block_no long, kind string, suffix string")
    want = {}
    for r in sorted(defects.collect()):
        *dirs, name = paths[r["file_id"]].split("/")
        at = want.setdefault(dirs[0] if dirs else "", {})
        for d in dirs[1:]:
            at = at.setdefault(d, {})
        at.setdefault(name, []).append({"start_line": 10 * r["block_no"] + 1, "end_line": 10 * r["block_no"] + 5, "kind": "code", "suffix": "dead"})
    from variscope.operators.defects import defect_tree_json

    pieces = sorted(defect_tree_json(defects, blocks, files).collect(), key=lambda r: (r["path"], r["block_no"]))
    got = {top: json.loads("".join(r["piece"] for r in pieces if r["top"] == top)) for top in {r["top"] for r in pieces}}
    assert got == want
    assert defect_tree_json(defects.limit(0), blocks, files).count() == 0


def test_slices_with_equal_marks_are_made_once(spark, source):
    """Verdicts by marks equal those of all slices, with defines, nesting, long chains and marks too large to collect."""
    texts = (
        "#ifdef A\n#if B\n#endif\n#endif", "#if X\n#endif\n#ifdef A\n#if B\n#endif\n#endif", "#ifdef A\n#if !A\n#endif\n#elif A\n#else\n#endif",
        "#ifdef A\n#define B\n#if B && !A\n#endif\n#if !B\n#endif\n#endif", "#if A\n#define C\n#endif\n#if C\n#if !A\n#endif\n#endif",
        "#if 0\n#else\n#endif", "#if (A && B) || C\n#ifdef A\n#endif\n#endif", "#if A\n#elif B\n#elif C\n#else\n#if A\n#endif\n#endif",
    )
    lines = source(*texts)
    tree = B.structure(lines)
    blocks, defines = B.block_tree(tree), B.define_versions(lines, tree)
    rewritten = B.rewrite_symbols(blocks, defines)

    def told(keys, verdicts):
        return sorted(map(tuple, keys.join(verdicts, "sid").select("file_id", "block_no", "suffix", "verdict").collect()))

    keys, _, verdicts = D.code_verdicts(D.tested_slices(blocks, rewritten, defines))
    few, _, same = D.marked_verdicts(blocks, rewritten, defines)
    assert told(keys, verdicts) == told(few, same)
    member_rows = C.closure_members(blocks, defines)
    marks = {(r["file_id"], r["block_no"]): r["mark"] for r in C.slice_marks(rewritten, defines, member_rows).collect()}
    assert marks[0, 0] == marks[1, 1] and marks[0, 1] == marks[1, 2] and len({marks[k] for k in [(0, 0), (0, 1), (1, 0), (2, 1), (3, 1)]}) == 5
    alone = [r["mark"] for r in C.slice_marks(rewritten, defines, member_rows, limit=1).collect()]
    assert len(alone) == len(marks) and "0:1" in alone and "1:0" not in alone


def test_slices_over_the_limit_are_merged_all_the_same(spark):
    lit = lambda v, p: (v, p)
    rows = [(1, 5, [lit("B5", True)]), (1, 5, [lit("B5", False), lit("A", True)]), (2, 7, [lit("B7", True)]), (2, 7, [lit("B7", False), lit("A", True)]),
            (3, 1, [lit("B1", True)]), (3, 1, [lit("B1", True)]), (3, 1, [lit("B1", True)]), (4, 1, [lit("B1", True)])]
    df = spark.createDataFrame(rows, "file_id long, block_no long, lits array<struct<var:string,positive:boolean>>")
    for limit in (4096, 2, 1):
        keys, merged = E.merge_equal(df, ["file_id", "block_no"], limit)
        sid = {r["file_id"]: r["sid"] for r in keys.collect()}
        assert (sid[1] == sid[2]) == (limit > 1) and sid[3] == sid[4]
        clauses = sorted((r["sid"], tuple(tuple(x) for x in r["lits"])) for r in merged.collect())
        assert clauses == sorted({(sid[f], c) for f, own in ((1, 1), (2, 1), (3, 1), (4, 1)) for c in ([((f"B{own}", True),)] + [(("A", True), (f"B{own}", False))] * (f < 3))})


def test_slices_of_some_blocks_only(spark, source):
    tree = B.structure(source("#ifdef A\n#if B\n#endif\n#else\n#endif\n#if C\n#endif", "#if A\n#endif"))
    blocks = B.block_tree(tree)
    only = spark.createDataFrame([(0, 1)], "file_id long, block_no long")
    shown = lambda df: sorted((r["file_id"], r["block_no"], str(r["lits"])) for r in df.collect())
    every = shown(C.block_slices(blocks, blocks, None))
    assert shown(C.block_slices(blocks, blocks, None, None, only)) == [r for r in every if r[:2] == (0, 1)] != []


def test_blocks_without_a_chain_keep_their_slices(spark, source):
    blocks = B.block_tree(B.structure(source("#else\n#endif\n#if A\n#endif", "#if B\n#endif")))
    assert not blocks.filter("chain_no is null").isEmpty()
    keys, _, verdicts = D.code_verdicts(D.tested_slices(blocks, blocks, None))
    few, _, same = D.marked_verdicts(blocks, blocks, None)
    told = lambda k, v: sorted(map(tuple, k.join(v, "sid").select("file_id", "block_no", "suffix", "verdict").collect()))
    assert told(keys, verdicts) == told(few, same)
