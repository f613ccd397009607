"""Distance sums by label: the same sums in runs and tiles, handed on once an item and label."""
import numpy as np

from cadenza.operators import metric_index as MI
from cadenza.operators import similarity as S


def _items(spark, x, ids=None, labels="ab"):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), labels[n % len(labels)], [float(v) for v in r]) for n, (i, r) in enumerate(zip(ids, x))], "item_id long, label string, vec array<double>")


def _sums(x, ids, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    other = np.array(ids)[:, None] != np.array(ids)[None]
    of, out = np.array([labels[n % len(labels)] for n in range(len(x))]), {}
    for i, own in enumerate(ids):
        for name in set(labels):
            at = other[i] & (of == name)
            had = out.get((own, name), (0.0, 0))
            out[own, name] = had[0] + d[i, at].sum(), had[1] + int(at.sum())
    return out


def test_label_sums_in_runs_with_repeated_ids(spark, monkeypatch):
    x, ids = np.random.default_rng(4).normal(size=(400, 3)), [i % 390 for i in range(400)]
    want = _sums(x, ids, "abcab")
    for block in (None, 128):
        got = S.distance_sums_by_label(_items(spark, x, ids, "abcab"), id_col="item_id", vec_col="vec", label_col="label", block_rows=block).collect()
        assert {(r["item_id"], r["label"]): r["cnt"] for r in got} == {k: v[1] for k, v in want.items()}
        assert all(abs(r["dsum"] - want[r["item_id"], r["label"]][0]) < 1e-6 for r in got)
    monkeypatch.setattr(S, "RUN", 50)  # several runs and tiles
    monkeypatch.setattr(S, "RUN_CELLS", 300)
    labels, once = np.array(["abcab"[n % 5] for n in range(390)], dtype=object), _sums(x[:390], ids[:390], "abcab")
    sums = S._LabelSums(np.arange(390), x[:390])
    sums.add(S._Labelled(np.arange(390), x[:390], labels))
    for name, (total, count) in sums.sums.items():
        assert all(count[i] == once[i, name][1] and abs(total[i] - once[i, name][0]) < 1e-6 for i in range(390))


def test_label_sums_are_handed_on_once_an_item(spark, monkeypatch):
    units, real = [], MI.units_of
    monkeypatch.setattr(S, "SEED_BROADCAST_BYTES", 1000)
    monkeypatch.setattr(MI, "units_of", lambda *a: units.append(real(*a)) or units[-1])
    S.distance_sums_by_label(_items(spark, np.random.default_rng(5).normal(size=(5000, 2))), id_col="item_id", vec_col="vec", label_col="label").count()
    assert len(units[-1]) >= 4  # one unit, dealt to all tasks, before: each handed on all items


def test_label_sums_collect_no_row_objects(spark, monkeypatch):
    """615,384 items of two or three dimensions fit the broadcast, but were that many rows of Python objects on the driver."""
    x, labels = np.random.default_rng(6).normal(size=(60, 2)), ["a", None, "b"]
    df = _items(spark, x, labels=labels)

    many, real = [], type(df).collect
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", lambda self: many.append(real(self)) or many[-1])
        sums = S.distance_sums_by_label(df, id_col="item_id", vec_col="vec", label_col="label")
    assert max(map(len, many), default=0) <= 1  # counts only
    got = {(r["item_id"], r["label"]): r for r in sums.collect()}
    want = _sums(x, list(range(60)), ["a", "None", "b"])
    assert got.keys() == want.keys() and all(abs(got[k]["dsum"] - v[0]) < 1e-9 and got[k]["cnt"] == v[1] for k, v in want.items())
