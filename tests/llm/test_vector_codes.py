"""Vector codes against a plain fit that scans every entry for every part."""

import hashlib
import math

import numpy as np

import __spark_entry__ as entry_point
from cohortry.llm import vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label) -> rows of the query."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    if not kept:
        return []
    step = len(kept[0][1]) // parts
    cut = [[tuple(v[k * step:(k + 1) * step]) for k in range(parts)] for _, v, _ in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]

    def nearest(part, k):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[k], k)[1], []).append(c[k])
            for j, group in members.items():
                books[k][j] = tuple(sum(x) // len(group) for x in zip(*group))
    found = [[nearest(c[k], k) for k in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{j:02x}" for _, j in f), e, by_label[lab], digest)
                  for (i, _, lab), f, e in zip(kept, found, errors))


def run(spark, rows, folder):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    got = entry_point.queries()["op11_vector_codes"](spark, str(folder))
    return sorted(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def test_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i * 3 % 401, [float(np.float32(x)) for x in rng.normal(0, 0.2, 64)], int(rng.integers(3)) or None) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(40)]  # ties and a large group
    rows += [(2000, None, 1), (2001, [float("nan")] * 64, 2), (2002, [None] + [0.1] * 63, 2), (2003, [float("inf")] * 64, None)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_few_rows_and_none(spark, tmp_path):
    rows = [(4, [0.5] * 64, None), (2, [-0.001] * 64, None), (9, [0.5] * 64, 1)]
    assert run(spark, rows, tmp_path / "few") == brute(rows)
    assert run(spark, [(1, None, 1)], tmp_path / "none") == []


def test_bounds_save_scans_and_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (3000, 4))
    history = [x[:32].copy()]
    codes, low, stamp = np.zeros(3000, np.int64), np.zeros(3000), np.zeros(3000, np.int64)
    scans = []
    for _ in range(12):
        codes, low, stamp, error, scan = vector_codes.assign(x, history, codes, low, stamp)
        far = vector_codes.squared(x, history[-1])
        assert (codes == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
        scans.append(scan.mean())
        after = history[-1].copy()
        for j in np.unique(codes):
            after[j] = x[codes == j].sum(axis=0) // (codes == j).sum()
        history.append(after)
    assert scans[0] == 1 and scans[-1] < 0.5 and (stamp < 11).any()
    net = vector_codes.net_ways(history)[0]
    summed = sum(np.sqrt(((b - a).astype(float) ** 2).sum(axis=1)) for a, b in zip(history, history[1:], strict=False))
    assert (net <= summed.max() + 1e-9).all()


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, codes string, `a.b` int, _v int, _row int, _codes int, _label int"
    rows = [(None, [1.0, 2.0], "x", 1, 2, 3, 4, 5), (1, [1.0, 2.0], "y", 1, 2, 3, 4, 5), (1, [0.0, 2.0], "z", 1, 2, 3, 4, 5),
            (5, [1.0], "w", 1, 2, 3, 4, 5), (6, [1e300, 0.0], "w", 1, 2, 3, 4, 5), (1, [1.0, 2.0], "y", 1, 2, 3, 4, 5)]
    docs = spark.createDataFrame(rows, schema)
    coded, history = vector_codes.encode(docs, parts=3, entries=2)
    got = coded.collect()
    assert len(got) == 4 and got[0]["a.b"] == 1 and got[0]["_v"] == 2 and len(got[0]["codes"]) == 3
    assert [len(b[0][0]) for b in history] == [0, 1, 1]
    empty, _ = vector_codes.encode(docs.limit(0))
    assert empty.count() == 0 and empty.columns == coded.columns
    blank, _ = vector_codes.encode(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>"))
    assert blank.first()["codes"] == [0] * 16
