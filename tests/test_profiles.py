"""Families computed for many instances at a time, against their own functions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.operators import families, profiles
from satchel.queries import families as queries

KP = "instance_id string, ord long, weights array<bigint>, profit array<bigint>, capacity bigint"


def test_batches_against_single_instances(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(80):
        n = rng.randrange(2, 12)
        rows.append((f"i{k}", k, [rng.randrange(1, 50) for _ in range(n)], [rng.randrange(1, 9000) for _ in range(n)], rng.randrange(1, 300)))
    rows += [("zero", 80, [0, 0], [1, 2], 3), ("less", 81, [-3, 4], [5, 6], 7), ("flat", 82, [4, 4], [0, 0], 0), ("null", 83, [1, None], [2, 3], 4), ("same", 84, [5, 5, 5], [7, 7, 7], 9), ("open", 85, [1, 2], [3, 4], None)]
    df = spark.createDataFrame(rows, KP).repartition(2)
    monkeypatch.setattr(queries, "instances", lambda *_: df)
    seen, alone, batches = [], [], profiles.batch_features
    monkeypatch.setattr(profiles, "batch_features", lambda rows, columns: seen.append((rows, columns)) or batches(rows, columns))
    summary = queries.profile_features(spark, "").collect()
    (made, columns), = seen
    texts = {(r.instance_id, c): r[c] for r in made.select("instance_id", *(F.to_json(c).alias(c) for c in columns)).collect() for c in columns}
    got = {(r.instance_id, r.part): r for r in batches(made, columns).collect()}
    assert set(got) == set(texts) and sum(r.rows for r in summary) == len(texts) == 12 * len(rows)
    for key, text in texts.items():
        r = got[key]
        assert r.family == columns[key[1]]
        try:
            want = families.FAMILIES[r.family](families.unpack(json.loads(text)))
        except (families.Unsupported, KeyError, TypeError, ValueError, IndexError, ZeroDivisionError) as error:
            assert r.features is None and r.reason == f"{type(error).__name__}: {error}", key
            continue
        if not np.isfinite(list(want.values())).all():
            assert r.reason.startswith("nonfinite: "), key
        else:
            assert r.reason is None and r.features == pytest.approx(list(want.values()), rel=1e-9, abs=1e-9), key
    d, plain = profiles._fields("transport", made.select("part_0").toArrow().column(0).combine_chunks())
    assert plain.sum() == 83  # rows with supplies above 0 are computed together


@pytest.mark.parametrize("family", sorted(profiles.BATCHES))
def test_names_are_the_families_own(spark, monkeypatch, family):
    df = spark.createDataFrame([("a", 0, [3, 5], [10, 20], 6)], KP)
    monkeypatch.setattr(queries, "instances", lambda *_: df)
    seen = []
    monkeypatch.setattr(profiles, "batch_features", lambda rows, columns: seen.append((rows, columns)) or profiles.families.family_features(rows.select("instance_id", F.lit("none").alias("family"), F.lit("{}").alias("payload"))))
    queries.profile_features(spark, "")
    (made, columns), = seen
    for c in [c for c, f in columns.items() if f == family]:
        x = made.select(c).toArrow().column(0).combine_chunks()
        d, plain = profiles._fields(family, x)
        assert plain.all() and list(profiles.BATCHES[family](d)) == list(families.FAMILIES[family](x.to_pylist()[0]))
