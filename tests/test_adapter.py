"""Both layouts of instances in one read, and what is refused."""

import json

import pytest

from satchel.operators.hashing import instance_hash
from satchel.sources import adapter

W, P, C = [3, 5, 8], [4, 1, 9], 10


def extractor(k=1, **more):
    return {"instance_id": f"e{k}", "origin": "sage", "parameters": {"weights": [w + k for w in W], "profit": P, "capacity": C}, "lineage": {"base_id": f"b{k}", "source": "OptMATH"}} | more


def adapted(k=1, **more):
    w = [w + 50 * k for w in W]
    return {
        "problem": "KP", "instance_id": f"a{k}", "canonical_hash": instance_hash(w, P, C), "proportional_hash": instance_hash(w, P, C, True), "source_kind": "sage_derived", "generation_depth": 1, "parent_canonical_hash": "ff",
        "instance": {"n_items": 3, "weights": w, "profits": P, "capacity": C}, "operator": "swap", "operator_parameters": {"i": 1}, "round": 2, "seed": 7, "ignored": [1],
    } | more


def write(folder, name, rows):
    path = folder / name
    path.write_text("﻿" + "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n\n  \n", encoding="utf-8")
    return str(path)


def test_both_layouts(spark, tmp_path):
    original = adapted(2, source_kind="sage_original", generation_depth=0) | {"parent_canonical_hash": None}
    no_id = {k: v for k, v in extractor(3, origin="synthetic").items() if k != "instance_id"}
    rows = {r.instance_id: r for r in adapter.read_adapted(spark, write(tmp_path, "good", [extractor(), adapted(), original, no_id])).collect()}
    e, a, o = rows["e1"], rows["a1"], rows["a2"]
    hashed = instance_hash([4, 6, 9], P, C)
    assert (e.canonical_hash, e.proportional_hash, e.source_kind, e.generation_depth, e.root_parent_hash) == (hashed, instance_hash([4, 6, 9], P, C, True), "sage_original", 0, hashed)
    assert e.lineage.asDict() == dict.fromkeys(adapter.LINEAGE) | {"base_id": "b1", "source": "OptMATH", "root_parent_hash": hashed}
    assert (a.source_kind, a.generation_depth, a.root_parent_hash, a.n_items, a.profit, a.capacity) == ("sage_derived", 1, "ff", 3, P, C)
    assert (a.lineage.operator, json.loads(a.lineage.operator_parameters), a.lineage["round"], a.lineage.seed, a.lineage.parent_canonical_hash) == ("swap", {"i": 1}, "2", "7", "ff")
    assert o.root_parent_hash == o.canonical_hash and o.generation_depth == 0
    made = rows[f"sage_original_KP_{instance_hash([6, 8, 11], P, C)[:10]}"]
    assert (made.source_kind, made.generation_depth) == ("sage_derived", 1)


BAD = [
    ("{not json", "not_json"), (adapted(3, problem="TSP"), "not_a_kp_record"), (adapted(4, proportional_hash=None), "missing_proportional_hash"), (adapted(5, source_kind=None), "missing_source_kind"),
    (adapted(6, generation_depth=2), "generation_depth"), (adapted(7, generation_depth=0), "source_kind_of_an_original"), (adapted(8, source_kind="sage_original"), "source_kind_of_a_derived"),
    (adapted(9, canonical_hash="00"), "invalid_canonical_hash"), (adapted(10, proportional_hash="00"), "invalid_proportional_hash"), (adapted(11, parent_canonical_hash=""), "no_root_parent_hash"),
    (adapted(12, instance={"n_items": 4, "weights": W, "profit": P, "capacity": C}, canonical_hash=instance_hash(W, P, C), proportional_hash=instance_hash(W, P, C, True)), "n_items"),
    (extractor(20, parameters={"weights": [1], "profit": [1], "capacity": 1}), "item_count"), (extractor(21, parameters={"weights": W, "profit": [1], "capacity": 1}), "length_mismatch"),
    (extractor(22, parameters={"weights": [0, 1], "profit": [1, 1], "capacity": 1}), "nonpositive_weight"), (extractor(23, parameters={"weights": [1, 1], "profit": [-1, 1], "capacity": 1}), "negative_profit"),
    (extractor(24, parameters={"weights": [1, 1], "profit": [1, 1], "capacity": 0}), "nonpositive_capacity"), (extractor(25, parameters=None), "missing_field"), (extractor(26, lineage={"canonical_hash": "00"}), "invalid_canonical_hash"),
]


def test_every_refused_row_has_its_reason_and_its_line(spark, tmp_path):
    lines = [b for b, _ in BAD] + [extractor(1), extractor(1, instance_id="copy"), extractor(2, parameters={"weights": [8, 12, 18], "profit": [8, 2, 18], "capacity": 20})]
    rows = adapter.audited(spark, write(tmp_path, "bad", lines)).orderBy("line").collect()
    assert [r.record for r in rows] == [x if isinstance(x, str) else json.dumps(x) for x in lines]
    assert [(r.reasons[0], k) for r, (_, k) in zip(rows, BAD, strict=False)] == [(k, k) for _, k in BAD]
    assert [r.reasons for r in rows[-3:]] == [[], ["repeated_canonical_hash", "repeated_proportional_hash"], ["repeated_proportional_hash"]]
    with pytest.raises(ValueError, match="'repeated_proportional_hash': 2"):
        adapter.read_adapted(spark, write(tmp_path, "strict", lines))
    with pytest.raises(ValueError, match="empty"):
        adapter.read_adapted(spark, write(tmp_path, "none", []))


def test_audit_of_instances(spark, tmp_path):
    rows = [
        extractor(1), extractor(2, instance_id=None, question_id="q2"), extractor(3, origin="synthetic"), extractor(4, origin="synthetic", generator="g", seed=1, validation={"ok": True}), extractor(5, variant="other"), extractor(6, origin=None),
        extractor(7, parameters={"weights": [1.0, 2.9], "profit": [1, 2], "capacity": 3}),
    ]
    got = {r.instance_id: r for r in adapter.audit_instances(spark, write(tmp_path, "audit", rows)).collect()}
    assert {k: r.reasons for k, r in got.items()} == {"e1": [], "q2": [], "e3": ["provenance"], "e4": [], "e5": ["variant"], "e6": ["origin"], "e7": []}
    assert got["e7"].weights == [1, 2] and json.loads(got["e4"].record) == rows[3]
    for bad in ([extractor(1), extractor(1)], [extractor(1, instance_id=None)], [extractor(1, instance_id="")]):
        with pytest.raises(ValueError, match="id of its own"):
            adapter.audit_instances(spark, write(tmp_path, "ids", bad))
