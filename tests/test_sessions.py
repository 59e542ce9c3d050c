"""Sessions that end, terms that span utterances, answers from a stored decision, event windows."""

import datetime
import json
import random
from datetime import timedelta

from pyspark.sql import functions as F

from sievewright.operators import sessions
from sievewright.streaming import chat, events

START = datetime.datetime(2024, 1, 1)


def test_scores_are_those_of_the_joined_text(spark):
    rng = random.Random(7)
    terms, rows = ("abc", "ba", "ca\nb", "cccc"), []
    for conv in range(40):
        rows += [(conv, t, "user" if rng.random() < 0.8 else "assistant", rng.choice([None, "", "a", "b", "c", "cc", "ab", "ca", "abca"])) for t in range(rng.randint(1, 12))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for joint in ("\n", "", "bc"):
        want = {}
        for conv in range(40):
            said = [(t, x or "") for c, t, r, x in rows if c == conv and r == "user"]
            for k, (t, _) in enumerate(said):
                e = float(sum(x in joint.join(x for _, x in said[: k + 1]) for x in terms))
                want[conv, t] = round(e / (e + 2), 4)
        assert {(r["conv_id"], r["turn"]): r["score"] for r in sessions.score_trace(turns, terms, joint=joint).collect()} == want
        script = chat.Script({}, terms, (), questions=99, joint=joint)
        for conv in range(40):
            state = script.fresh()
            for t, text in [(t, x or "") for c, t, r, x in rows if c == conv and r == "user"]:
                assert script.step(json.loads(json.dumps(state)), text)["score"] == script.step(state, text)["score"] == want[conv, t]
                assert len(state["tail"]) < script.longest()


def feed(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, text string, at timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_idle_sessions_are_decided_and_their_state_ends(spark, tmp_path):
    script = chat.Script({}, ("pay",), (), questions=2)
    where, out = str(tmp_path / "in"), []
    at = lambda minute: START + timedelta(minutes=minute)
    feed(spark, where, [(1, 0, "hello", at(0)), (2, 0, "pay now", at(1))])
    live = spark.readStream.schema("conv_id long, turn long, text string, at timestamp").parquet(where)
    replies = chat.sessions(live, script, ts="at", idle=timedelta(minutes=30), late=timedelta(minutes=5))
    query = replies.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        query.processAllAvailable()
        assert [(r["conv_id"], r["closed"]) for r in sorted(out, key=lambda r: r["conv_id"])] == [(1, False), (2, False)]
        feed(spark, where, [(1, 1, "more", at(25))])  # keeps the first session open
        query.processAllAvailable()
        feed(spark, where, [(3, 0, "later", at(45))])  # the watermark passes the second one's rest
        query.processAllAvailable()
        feed(spark, where, [(3, 1, "still", at(46))])
        query.processAllAvailable()
        closed = [r for r in out if r["closed"]]
        assert [(r["conv_id"], r["phase"], r["turn"], r["score"]) for r in closed] == [(2, "DONE", None, 0.3333)]
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
        feed(spark, where, [(2, 5, "hi again", at(50))])
        query.processAllAvailable()
        again = [r for r in out if r["turn"] == 5]
        assert [(r["phase"], r["score"], r["closed"]) for r in again] == [("COLLECTING", 0.0, False)]
    finally:
        query.stop()


VERDICT = "conv_id long, status string, risk string, scam_type string, stage string, explanation string, actions array<struct<order:int,text:string>>, cases array<struct<source:string,case_id:string,excerpt:string>>, legal array<struct<title:string,article:string,version_date:string>>, locked_notice string"
VERDICTS = [
    (1, "COVERED", "HIGH", "假投資", "出金受阻", "平台不讓你出金", [(2, "報警"), (1, "停止匯款")], [("165", "F1", "老師叫我入金")], [("刑法", "第 339 條", "2024-01-01")], None),
    (2, "COVERED_LOCKED", None, None, None, None, None, None, None, "此模組未解鎖"),
    (3, "COVERED", "ODD", "", "接觸", "", [], None, [], None),
    (4, "UNCOVERED", None, None, None, None, None, None, None, None),
]
DIALOGUE = [
    (1, "這風險高嗎", "risk", ["風險等級：高"]), (1, "是哪一種", "verdict", ["假投資"]), (1, "我走到哪一步", "verdict", ["出金受阻\n\n平台不讓你出金"]),
    (1, "接下來怎麼辦", "verdict", ["1. 停止匯款", "2. 報警"]), (1, "有類似的嗎", "verdict", ["・[165 F1] 老師叫我入金"]), (1, "適用什麼法條", "verdict", ["・刑法 第 339 條（2024-01-01）"]),
    (1, "天氣如何", "say", [chat.ONLY_THIS]), (2, "風險", "locked", ["此模組未解鎖"]), (2, "天氣", "say", [chat.ONLY_THIS]),
    (3, "風險", "risk", ["風險等級：尚無法判斷"]), (3, "類型", "say", [chat.MISSING]), (3, "進度", "verdict", ["接觸"]), (3, "案例", "say", [chat.MISSING]), (3, "該做什麼", "say", [chat.MISSING]), (3, "法律", "say", [chat.MISSING]),
    (4, "風險", "say", [chat.MISSING]), (5, "風險", "say", [chat.MISSING]), (1, "別人走到哪一步", "verdict", ["出金受阻\n\n平台不讓你出金"]),
]


def test_answers_hold_what_the_decision_holds(spark, tmp_path):
    verdicts = spark.createDataFrame(VERDICTS, VERDICT)
    rows = [(c, k, t) for k, (c, t, _, _) in enumerate(DIALOGUE)]
    asked = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("intent", chat.follow_up(F.col("text")))
    got = [(r["kind"], r["lines"]) for r in chat.answers(asked, verdicts).orderBy("turn").collect()]
    assert got == [(k, lines) for _, _, k, lines in DIALOGUE]
    script = chat.Script({}, ("x",), (), questions=0, intents=chat.FOLLOW_UPS)
    spark.createDataFrame([(c, k + 10, t) for k, (c, t, _, _) in enumerate(DIALOGUE)] + [(c, 0, "x") for c in (1, 2, 3, 4, 5)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "in"))
    replies = chat.sessions(live, script)
    events.drain(chat.answers(replies.filter("phase = 'DONE' and turn > 0"), verdicts), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("turn").collect()
    assert [(r["kind"], r["lines"]) for r in rows] == got


def test_user_sessions_by_gaps(spark, tmp_path):
    rows = [(START + timedelta(minutes=m), u) for u, ms in ((1, (0, 10, 35, 90)), (2, (5,)), (3, (400,))) for m in ms]
    spark.createDataFrame(rows, "ts timestamp, user_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    events.drain(events.user_sessions(live), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r["user_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1), (1, 3), (2, 1)]  # the last one is still open
