"""The filter audit against brute force over all orders."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from sievework.llm.audit import audit_orders, filter_audit, mask_counts, subset_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, part string, A int, E string, `a.b` int, rows long, good string"


def fails(docs):
    """The set of filters that each row fails."""
    texts = [t or "" for _, t, _ in docs]
    out = []
    for (id_, _, _), t in zip(docs, texts):
        words = WORD.findall(t)
        smaller = id_ is not None and any(x == t and i is not None and i < id_ for (i, _, _), x in zip(docs, texts))
        found = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": re.search(r"[#$%&*|]", t), "E": smaller}
        out.append({k for k, v in found.items() if v})
    return out


def brute(docs, labels, letters="ABCDE"):
    failed = fails(docs)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    out = {}
    for part in {p or "" for *_, p in docs}:
        rows = [(i, f) for (i, _, p), f in zip(docs, failed) if (p or "") == part]
        sums = dict.fromkeys(letters, 0)
        for order in map("".join, permutations(letters)):
            left = rows
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                sums[x] += len(gone)
                fail, alone = sum(x in f for _, f in rows), sum(f == {x} for _, f in rows)
                lost = [sum(i is not None and i in s for i, _ in gone) for s in (good, toxic)]
                out[part, order, step] = [len(left), len(gone), fail - len(gone), alone, *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["LOUD", "A#", "é"]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 400])]) for _ in range(rng.choice([1, 99, 100, 101, 300]))) for _ in range(60)]
    texts += [t.upper() for t in texts[:10]] + ["", None, " \n", "#", "É" * 9 + "A", "É" * 9 + "AA", " ".join(f"x{i}" for i in range(80)) + " x1" * 20, " ".join(f"x{i}" for i in range(79)) + " x1" * 21, "word " * 30_000]
    rows = [(i * 7 % 100, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    copies = [(200 + i, rng.choice(texts[:5]), "en") for i in range(30)]
    return [*rows, *copies, (None, texts[0], "en"), (None, texts[0], "en"), (None, None, None), rows[0], rows[0], (rows[0][0], texts[1], "de"), (-5, texts[2], "de"), (-5, texts[2], "en")]


LABELS = [(0, 1, 0), (7, 0, 1), (7, 1, 0), (14, None, 1), (None, 1, 1), (200, 1, 1), (201, 1, None), (-5, 1, 0), (9999, 1, 1)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, p, "x", 1, "y", 2, 3, "z") for i, t, p in docs], DOCS).repartition(3)


def test_filter_audit(spark, docs):
    labels = spark.createDataFrame([(*x, "w") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    got = filter_audit(frame(spark, docs), labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    want = brute(docs, LABELS)
    assert len(rows) == len(want) == 600 * len({p or "" for *_, p in docs})
    assert set(map(tuple, rows)) == want
    assert filter_audit(frame(spark, docs), labels.limit(0)).where("good_lost + toxic_lost > 0").isEmpty()
    assert filter_audit(frame(spark, []), labels).isEmpty()


def test_steps_add_up(spark):
    """Any number of filters up to seven; kept and removed add up, and so does what all filters remove over all orders."""
    rng = random.Random(1)
    rows = [(rng.choice("pq"), *(rng.random() < 0.3 for _ in range(3)), rng.random() < 0.5) for _ in range(200)]
    flagged = spark.createDataFrame(rows, "`the part` string, x boolean, `y.z` boolean, n boolean, odd boolean")
    got = audit_orders(subset_sums(mask_counts(flagged, ["x", "y.z", "n"], "the part", ["odd"]), 3, ["odd"]), "xyn", {"odd": "odd_lost"}).collect()
    assert len(got) == 2 * 6 * 3
    for r in got:
        mine = [x for x in rows if x[0] == r.part]
        names = dict(zip("xyn", (1, 2, 3)))
        before = [x for x in mine if not any(x[names[c]] for c in r.filter_order[: r.step - 1])]
        gone = [x for x in before if x[names[r.filter_order[r.step - 1]]]]
        assert (r.removed, r.kept, r.odd_lost) == (len(gone), len(before) - len(gone), sum(x[4] for x in gone))
        same_filter = [y.removed for y in got if y.part == r.part and y.filter_order[y.step - 1] == r.filter_order[r.step - 1]]
        assert r.shapley == sum(same_filter)
    with pytest.raises(ValueError):
        audit_orders(flagged, "abcdefgh")
