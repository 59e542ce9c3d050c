"""One scan for all terms against looking for each; packs that fail; profiles."""

import json
import random
import time

from pyspark.sql import functions as F

from sievewright.operators import rules
from sievewright.sources import packs as P


def test_one_scan_routes_as_looking_for_each_term_does(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc漢") for _ in range(rng.randint(1, 3)))
    some = lambda n: tuple(word() for _ in range(n))
    made = [rules.Pack(f"p{k}", (*some(4), "a", "a"), some(2), some(2), some(1), some(2), style=style, priority=k, route_min=0.4, exclude="ccc" if k % 2 else "") for k, style in enumerate(["factor", "bonus", "decisive"] * 3)]
    made += [rules.Pack("blank", ("", "zz")), rules.Pack("off", (), usable=False)]
    rows = [(k, "".join(rng.choice("abc漢 x") for _ in range(rng.randint(0, 12)))) for k in range(300)] + [(300, ""), (301, None)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    one, each = (sorted(map(tuple, rules.route(df, made, "id", "text", one_scan=x).collect())) for x in (True, False))
    assert [r for r in one if r[0] < 301] == [r for r in each if r[0] < 301] and len(one) == len(rows)


def test_a_thousand_terms_cost_about_one_scan(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(1000)]
    text = " ".join(rng.choice(words) + "x" for _ in range(300))
    df = spark.createDataFrame([(k, text) for k in range(400)], "id int, text string").repartition(4).cache()
    df.count()
    took = []
    for n in (10, 1000):
        pack = [rules.Pack("p", tuple(words[:n]), route_min=0.3)]
        rules.scores(df, pack, "id", "text", one_scan=True).collect()
        begun = time.time()
        rules.scores(df, pack, "id", "text", one_scan=True).collect()
        took.append(time.time() - begun)
    assert took[1] < 5 * took[0] + 1


def test_packs_that_fail_keep_none_of_the_others_out(spark, tmp_path):
    bodies = {"a": {"id": "a", "positives": ["x"]}, "b": {"id": "other", "positives": []}, "c": "not json", "d": {"id": "d", "colour": 1}, "e": {"id": "e", "positives": []}}
    for name, body in bodies.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "pack.json").write_text(body if isinstance(body, str) else json.dumps(body))
    found, failed = P.load_all(tmp_path)
    assert [p.id for p in found] == ["a", "e"] and [f for f, _ in failed] == ["b", "c", "d"]
    reasons = {r["folder"]: r["reason"] for r in P.failures(spark, tmp_path).collect()}
    assert "folder's name" in reasons["b"] and "unknown fields" in reasons["d"] and len(reasons) == 3


def test_profiles_say_how_sure_each_field_is(spark):
    df = spark.createDataFrame([(1, "LINE 上匯款 73,500元，第3天"), (2, "沒有"), (3, "2024年損失 5萬元和 900,000元")], "id int, text string")
    rows = rules.profile(df, "text", ["LINE"], {"bank": ["匯款"]}, F.when(F.col("id") == 1, "paid").otherwise("")).orderBy("id").collect()
    assert [(r["platform"], r["payment"], r["amount_range"], r["stage"], r["days"]) for r in rows] == [("LINE", "bank", "5 萬到 10 萬", "paid", 3), (None, None, None, None, None), (None, None, "5 萬到 10 萬", None, None)]
    assert [tuple(r["field_confidence"]) for r in rows] == [(0.4, 0.4, 0.6, 0.4), (0, 0, 0, 0), (0, 0, 0.6, 0)]
