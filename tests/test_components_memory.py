import random

import numpy as np
import pyarrow as pa

from loomgraph.operators import components


def test_contraction_makes_no_python_strings(monkeypatch):
    kinds, forest = set(), components.forest
    monkeypatch.setattr(components, "forest", lambda u, v: kinds.add(u.dtype.kind) or forest(u, v))
    monkeypatch.setattr(components, "CHUNK", 40)
    rng = random.Random(9)
    e = [(f"c{rng.randrange(90)}", f"p{rng.randrange(90)}é") for _ in range(120)]
    batches = [pa.RecordBatch.from_pydict({"u": [x for x, _ in e[i : i + 30]], "v": [y for _, y in e[i : i + 30]]}) for i in range(0, 120, 30)]
    got = {u: v for b in components._contract(iter(batches)) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert kinds == {"i"}
    ids, least = forest(np.array([x for x, _ in e], object), np.array([y for _, y in e], object))
    assert got == dict(zip(ids, least, strict=True))
