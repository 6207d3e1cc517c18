"""The calibration report against plain numpy: everything listed, sorted and left out one by one."""
import math

import numpy as np
import pytest

from shutterlake.operators import identity as D, vectors as V

SCHEMA = "face_id long, photo_id long, embedding array<double>, det_score double, person_id long, assigned_by string, ignored boolean"


def picked(faces):
    """Exemplars of (id, vector, score): the best scored, then each time the one least like those picked, of equals the last."""
    order = sorted(faces, key=lambda f: (-f[2], f[0]))
    out = order[:1]
    while len(out) < min(5, len(order)):
        rest = [f for f in order if f not in out]
        near = [max(f[1] @ o[1] for o in out) for f in rest]
        out.append(rest[max(i for i, x in enumerate(near) if x == min(near))])
    return out


def test_calibration(spark, monkeypatch):
    monkeypatch.setattr(V, "BINS", 4)
    rng = np.random.default_rng(3)
    rows, people = [], {}
    for i in range(60):
        v = rng.normal(size=8)
        v /= np.linalg.norm(v)
        person = i % 7 if i < 43 else None
        rows.append((i, i, v.tolist(), float(rng.random()), person, "user" if person is not None else None, i == 59))
        if person is not None:
            people.setdefault(person, []).append((i, v, rows[-1][3]))
    people[99] = [(100, np.eye(8)[0], 0.5)]
    rows.append((100, 100, np.eye(8)[0].tolist(), 0.5, 99, "user", False))
    faces = spark.createDataFrame(rows, SCHEMA)
    best = lambda v, group: max(float(v @ e[1]) for e in picked(group))
    pos = {p: [best(f[1], [g for g in own if g[0] != f[0]]) for f in own] if len(own) > 1 else [] for p, own in people.items()}
    neg = {p: [best(f[1], other) for f in own for q, other in people.items() if q != p] for p, own in people.items()}
    at = lambda values, q: sorted(values)[math.floor(q * (len(values) - 1) + 0.5)]
    p, n = sum(pos.values(), []), sum(neg.values(), [])
    got = D.calibration(faces).first()
    assert (got[0], got[4]) == (len(p), len(n))
    assert [got[i] for i in (1, 2, 3, 5, 6)] == pytest.approx([at(p, 0), at(p, 0.05), at(p, 0.5), at(n, 0.95), at(n, 1)])

    for r in D.calibration_persons(faces).collect():
        own, other = pos[r["person_id"]], neg[r["person_id"]]
        assert (r["confirmed"], r["positives"], r["negatives"]) == (len(people[r["person_id"]]), len(own), len(other))
        assert r["neg_max"] == pytest.approx(max(other)) and (r["pos_min"] == pytest.approx(min(own)) if own else r["pos_min"] is None)

    found = {r["face_id"]: r for r in D.calibration_unassigned(faces).collect()}
    assert set(found) == set(range(43, 59))
    empty = D.calibration(faces.limit(0)).first()
    assert (empty[0], empty[4]) == (0, 0) and set(empty[i] for i in (1, 2, 3, 5, 6)) == {None}
