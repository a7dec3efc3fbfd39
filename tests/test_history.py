"""The edit log against an editor that keeps whole copies."""

from __future__ import annotations

import random

from fixtures import dsm_of, two_cliques

from depmatrix.operators import graph, history


class Editor:
    """Cells and names by element number; copies before every edit, fifty at most."""

    def __init__(self, names, cells):
        self.state, self.back, self.forth = (dict(names), dict(cells)), [], []

    def step(self, kind, a, b, w, label):
        if kind == "undo":
            if self.back:
                self.forth.append(self.state)
                self.state = self.back.pop()
            return
        if kind == "redo":
            if self.forth:
                self.back.append(self.state)
                self.state = self.forth.pop()
            return
        if kind == "set" and a == b or kind == "rename" and not label:
            return
        self.back = (self.back + [self.state])[-50:]
        self.forth = []
        names, cells = dict(self.state[0]), dict(self.state[1])
        if kind == "set":
            cells[a, b] = w
        elif kind == "remove":
            del names[a]
            cells = {k: v for k, v in cells.items() if a not in k}
        else:
            names[a] = label
        self.state = names, cells


def test_three_versions_of_random_logs(spark):
    rng, rows, versions = random.Random(8), [], (20, 130, 400)
    base = two_cliques()
    cells = {(i, j): float(base[i, j]) for i in range(10) for j in range(10) if base[i, j]}
    want = {}
    for name in ("p", "q", "r"):
        editor, new = Editor({k: f"x{k}" for k in range(10)}, cells), 100
        for seq in range(401):
            there = list(editor.state[0])
            kind = rng.choice(("set", "set", "set", "rename", "add", "remove", *(("undo",) * 5 if 100 < seq < 220 else ("undo", "undo")), "redo"))
            a, b, w, label = rng.choice(there), rng.choice(there), float(rng.randint(0, 3)), rng.choice(("", f"n{seq}"))
            if kind == "add":
                a, label, new = new, f"n{seq}", new + 1
            if kind == "remove" and len(there) < 5:
                kind = "undo"
            rows.append((name, seq, kind, a, b, w, label))
            editor.step(kind, a, b, w, label)
            if seq in versions:
                names = sorted(editor.state[0].items())
                at = {uid: k for k, (uid, _) in enumerate(names)}
                want[name, seq] = ([x for _, x in names], {(at[i], at[j]): v for (i, j), v in editor.state[1].items() if v > 0})
    log = graph.cut(spark.createDataFrame(rows, history.LOG).repartition(3))
    d = dsm_of(spark, p=base, q=base, r=base)
    d = type(d)(d.elements.selectExpr("dsm_id", "idx", "concat('x', idx) AS label"), d.edges)
    done = graph.cut(history.effects(log))
    for version in versions:
        found, _ = history.as_of(d, log, done, version)
        labels = {(r["dsm_id"], r["idx"]): r["label"] for r in found.elements.collect()}
        edges = {(r["dsm_id"], r["i"], r["j"]): r["w"] for r in found.edges.collect()}
        for name in ("p", "q", "r"):
            names, cells_ = want[name, version]
            assert [labels[name, k] for k in range(len(names))] == names and sum(k[0] == name for k in labels) == len(names)
            assert {k[1:]: w for k, w in edges.items() if k[0] == name} == cells_
