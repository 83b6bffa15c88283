import hashlib
import math
import random

import numpy as np
import pytest

from latticeflow.llm import chat
from latticeflow.llm.common import connected_components
from latticeflow.llm.neardup import near_duplicates
from latticeflow.llm.vptree import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, id string, key int, vector string, n int, shard int, cell int"


def vectors(seed=1, n=150, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[i % 12] + 0.25 * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(9)]
    rows += [(n + 10, None, 1), (n + 11, [0.0] * dim, 1), (n + 12, [math.nan] + [1.0] * (dim - 1), 1), (n + 13, [None] + [1.0] * (dim - 1), 1), (n + 14, [math.inf] * dim, 1)]
    rows += [(n + 15, rows[1][1], None), (n + 16, rows[1][1][:3], 1), (n + 17, [2.0 * x for x in rows[2][1]], rows[2][2]), (None, rows[3][1], 1)]
    return [(*r, "d", "i", 1, "v", 2, 3, 4) for r in rows]


def usable(r):
    return r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


@pytest.mark.parametrize("shard_rows", [4096, 20])
def test_exact_search_matches_brute_force(spark, shard_rows):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest(frame, frame.where("vec_id % 5 = 0"), shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = [r for r in rows if usable(r)]
    for q in (r for r in fine if r[0] % 5 == 0):
        order = sorted(((-round(cosine(q[1], r[1]), 10), r[0]) for r in fine if r[0] != q[0] and len(r[1]) == len(q[1])))[:5]
        own = sorted(got.get(q[0], []))
        assert [o[1] for o in own] == [i for _, i in order]
        assert np.allclose([o[2] for o in own], [-c for c, _ in order], atol=1e-9)
    assert set(got) <= {r[0] for r in fine}


def test_ties_follow_the_exact_measure(spark):
    """Scaled copies of one vector differ in the last bits of their cosines only; ids that ask twice ask alike."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=16)
    rows = [(i, (v * (1 + 0.37 * i)).tolist()) for i in range(40)] + [(100 + i, rng.normal(size=16).tolist()) for i in range(30)] + [(0, rng.normal(size=16).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(frame, frame.where("vec_id % 10 = 0"), shard_rows=16).collect()
    asking = {}
    for i, e in rows:
        if i % 10 == 0:
            asking[i] = min(asking.get(i, e), e)
    from latticeflow.llm.vectors import cosine as measure

    for q, e in asking.items():
        best = {}
        for i, o in rows:
            if i != q:
                best[i] = max(best.get(i, -2.0), float(measure(np.array([e]), np.array([o]))[0]))
        expected = sorted(((-c, i) for i, c in best.items()))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(i, s) for _, i, s in own] == [(i, -c) for c, i in expected]


def test_relaxed_search_keeps_most(spark):
    frame = spark.createDataFrame(vectors(n=400), SCHEMA)
    exact = {(r.query_id, r.vec_id) for r in nearest(frame, frame.where("vec_id % 5 = 0"), shard_rows=40).collect()}
    relaxed = {(r.query_id, r.vec_id) for r in nearest(frame, frame.where("vec_id % 5 = 0"), shard_rows=40, factor=0.7).collect()}
    assert len(exact & relaxed) >= 0.9 * len(exact)


@pytest.mark.parametrize("tile", [512, 7])
def test_near_duplicates_match_brute_force(spark, tile):
    rows = vectors()
    n = len(rows)
    link = [[i != j and usable(a) and usable(b) and a[2] is not None and a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93 for j, b in enumerate(rows)] for i, a in enumerate(rows)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if link[i][j]:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    expected = sorted((r[0] if r[0] is not None else -1, sum(link[i]), least.get(find(i), -1)) for i, r in enumerate(rows))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_near_duplicates_of_many_tiles(spark):
    """Leaves, tiles and pairs of tiles, against all pairs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 12))
    m = np.concatenate([centres[rng.integers(0, 60, 900)] + 0.2 * rng.normal(size=(900, 12))])
    label = rng.integers(0, 2, 900)
    u = m / np.sqrt((m * m).sum(1, keepdims=True))
    link = (u @ u.T >= 0.93) & (label[:, None] == label) & ~np.eye(900, dtype=bool)
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(m, label))], "vec_id long, embedding array<double>, label int"), tile=20).collect()}
    assert [got[i].n_links for i in range(900)] == link.sum(1).tolist()
    root = np.arange(900)
    while True:
        new = np.minimum(root, np.where(link, root, 900).min(1))
        if (new == root).all():
            break
        root = new
    assert [got[i].component_id for i in range(900)] == root.tolist()


def test_empty_vector_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nearest(none, none).count() == 0
    assert near_duplicates(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}


def test_formatting_round_trip(spark):
    rng = random.Random(6)
    bits = ["### ", ": ", "</turn>", "\n", "\\", "\\h", "\\c", "#", "<", "assistant", "é", "</turn>\n### user: "]
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "odd: role\n#", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))]), "x"))
    rows += [(3, 0, "assistant", "tie", "x"), (3, 0, "assistant", "tie", "x"), (None, 1, "user", "no id", "x"), (4, None, "assistant", "no turn", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    texts = {r.conv_id: r for r in chat.formatted(frame).collect()}
    got = chat.digests(frame).collect()
    low = lambda v: (v is not None, v)
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (low(x[1]), low(x[2]), low(x[3])))
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        text = texts[r.conv_id]
        assert r.formatted_chars == len(text.formatted)
        assert "".join(chat.unescape(text.formatted[s.start : s.end]) for s in text.spans) == loss


def test_formatting_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(none).count() == chat.digests(none).count() == 0


def test_template_language():
    render = lambda t, **d: "".join(p for p, _ in chat.compile_template(t, {"up": str.upper})(**d))
    assert render("{{ 'a' + 'b' | up }}{% if 1 == 2 %}x{% elif y %}{{ y }}{% else %}z{% endif %}", y="Y") == "aBY"
    assert render("{% for m in ms %}{% if m.k != 'b' %}{{ m.k }},{% endif %}{% endfor %}", ms=[{"k": "a"}, {"k": "b"}, {"k": None}]) == "a,,"
    assert render("{% set x = y if y else 'none' %}{{ x }}", y="") == "none"
    assert len(chat.fold(chat.parse("a{{ 'b' }}{% if true %}c{% endif %}d{{ 'e' | up }}"), {"up": str.upper})) <= 3
    for bad in ("{{ 1 - 'a' }}", "{{ 'a' in 5 }}", "{{ y < none }}", "{{ x.__class__ }}", "{{ f(1) }}", "{% import os %}", "{{ x | nope }}", "{% for x in y %}", "{{ 'a }}", "{{ __x }}"):
        with pytest.raises(chat.TemplateError):
            render(bad, x={}, y=[])
    with pytest.raises(chat.TemplateError):
        render("{{ x.real }}", x=1)
