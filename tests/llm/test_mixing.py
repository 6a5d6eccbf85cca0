import hashlib
import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from chronostrata.llm import mixing as M


@dataclass
class Plan:
    step: int
    weight: dict
    quota: dict


def weigh(tokens, max_repeat=M.MAX_REPEAT, max_entropy=None):
    """The plan for the tokens of the sources, by plain bisection."""
    some = {s: n for s, n in sorted(tokens.items(), key=lambda x: (x[0] is not None, x[0] or "")) if n > 0}
    total = sum(some.values())

    def weights(step):
        raw = {s: math.pow(n / total, step / M.STEPS) for s, n in some.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def fits(step):
        w = weights(step)
        each = [w[s] / n for s, n in some.items()]
        if max_repeat is not None and max(each) > max_repeat * min(each):
            return False
        return max_entropy is None or len(w) < 2 or -sum(x * math.log(x) for x in w.values()) <= max_entropy * math.log(len(w))

    lo, hi = 0, M.STEPS
    while some and lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    w = weights(lo) if some else {}
    budget = max((n / w[s] for s, n in some.items()), default=0.0)
    quota = {s: max(n, round(budget * w[s])) for s, n in some.items()}
    return Plan(lo, {s: w.get(s, 0.0) for s in tokens}, {s: quota.get(s, 0) for s in tokens})


def planned(spark, tokens, *targets):
    df = spark.createDataFrame(list(tokens.items()), "source string, t bigint")
    rows = M.weigh(df, *targets).collect()
    return {r["source"]: r["weight"] for r in rows}, {r["source"]: r["quota"] for r in rows}


def test_the_exponent_meets_its_targets(spark):
    tokens = {"a": 1_000_000, "b": 100_000, "c": 10_000, None: 50, "empty": 0}
    weight, quota = planned(spark, tokens, 2.0)
    passes = {s: quota[s] / n for s, n in tokens.items() if n}
    assert min(passes.values()) == 1 and 1.99 < max(passes.values()) <= 2.02 and weight["empty"] == 0 and quota["empty"] == 0
    assert abs(sum(weight.values()) - 1) < 1e-9
    low, _ = planned(spark, tokens, None, 0.5)
    h = -sum(w * math.log(w) for w in low.values() if w)
    assert h <= 0.5 * math.log(4) < h + 1e-4
    for targets in ((2.0, None), (3.5, None), (None, 0.5), (1.0, None), (4.0, 0.9)):
        plan = weigh(tokens, *targets)
        weight, quota = planned(spark, tokens, *targets)
        assert quota == plan.quota and all(abs(weight[s] - w) < 1e-12 for s, w in plan.weight.items())
    assert planned(spark, {"a": 0})[1] == {"a": 0} and planned(spark, {"a": 7})[1] == {"a": 7} and planned(spark, {"a": 5, "b": 5})[0] == {"a": 0.5, "b": 0.5}


def test_many_sources(spark):
    df = spark.range(20_000).select(F.concat(F.lit("d"), F.col("id")).alias("source"), (F.col("id") % 977 + 1).alias("t"))
    quota = {r["source"]: r["quota"] for r in M.weigh(df).collect()}
    assert quota == weigh({f"d{i}": i % 977 + 1 for i in range(20_000)}).quota


def test_a_block_is_as_many_partitions_as_its_size_asks_for(documents, monkeypatch):
    want = [r["doc_id"] for r in M.mix(documents).collect()]
    monkeypatch.setattr(M, "PARTITION", 500)
    mixed = M.mix(documents)
    assert [r["doc_id"] for r in mixed.collect()] == want and mixed.rdd.getNumPartitions() > M.BLOCKS


def brute(rows, max_repeat=2.0, blocks=M.BLOCKS):
    n = [len((t or "").split()) for _, _, t in rows]
    by = defaultdict(int)
    for (_, s, _), k in zip(rows, n):
        by[s] += k
    plan, out = weigh(dict(by), max_repeat), []
    for s, t in by.items():
        q, done = plan.quota[s], 0
        for e in range(1 + (q // t if t else 0)):
            keyed = sorted((hashlib.md5(f"{M.SEED}/{e}/{'' if i is None else i}".encode()).hexdigest(), i, k) for (i, x, _), k in zip(rows, n) if x == s)
            for cell in sorted({k[:2] for k, *_ in keyed}):
                inside = [x for x in keyed if x[0][:2] == cell]
                if e and done >= q:
                    break
                at, sofar = (min(blocks - 1, done * blocks // q) if q else 0), done
                for key in sorted({k for k, *_ in inside}):
                    tie = [x for x in inside if x[0] == key]
                    if sofar < q or done + sum(x[2] for x in inside) <= q:
                        out += [(i, s, e, at, key, k) for _, i, k in tie]
                    sofar += sum(x[2] for x in tie)
                done += sum(x[2] for x in inside)
    return Counter(out)


@pytest.mark.parametrize("repeat", [2.0, 3.5])
def test_draws_are_those_of_a_plain_program(documents, repeat):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in documents.collect()]
    assert Counter(map(tuple, M.draw(documents, max_repeat=repeat).collect())) == brute(rows, repeat)


def test_every_document_is_drawn_and_blocks_hold_the_weights(documents):
    rows = M.draw(documents, blocks=4).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in documents.collect()}
    mixed = M.mix(documents)
    assert mixed.columns == documents.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in rows)


def test_order_of_the_mixed_table(spark, documents):
    want = [r["doc_id"] for r in M.draw(documents).orderBy("block", F.substring("order_key", 17, 16)).collect()]
    assert [r["doc_id"] for r in M.mix(documents).collect()] == want


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in odd.collect()]
    got = Counter(map(tuple, M.draw(odd).collect()))
    assert got == brute(rows)
    mixed = M.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(got.values())
    assert M.draw(none).count() == 0 and M.mix(none).count() == 0
