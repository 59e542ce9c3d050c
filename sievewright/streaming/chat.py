"""The conversation state machine as a keyed streaming job.

Each session collects utterances, asks a fixed number of questions (the first open slots, never one
twice), and decides after the last answer or at an early finish. Distress advice is given once. After
the decision an utterance only picks what of the decision it asks for. The score is that of everything
said so far, joined; the state keeps which terms were said and, for terms that span utterances, the
last characters that one can begin in, not the text. A session that stays idle is decided and closed,
and its state ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINISH, RESTART = "/finish", "/restart"
OUTPUT = "conv_id long, turn long, phase string, question string, advice boolean, score double, intent string, closed boolean"

# What is asked for after a decision, by words in order; names of risks; the wording of
# answers, of a part that the decision has not, and of a question that is none of these.
FOLLOW_UPS = (
    ("stage", ("階段", "第幾步", "哪一步", "進度", "走到")),
    ("cases", ("案例", "類似", "別人", "其他人")),
    ("actions", ("怎麼辦", "做什麼", "行動", "接下來", "該做")),
    ("legal", ("法條", "法律", "告他", "刑法", "報警")),
    ("type", ("類型", "哪一種", "什麼詐騙", "是不是詐騙")),
    ("risk", ("風險", "嚴重")),
)
RISKS = {"UNKNOWN": "尚無法判斷", "LOW": "低", "MEDIUM": "中", "HIGH": "高", "CRITICAL": "非常高"}
RISK = "風險等級："
MISSING = "這次的判讀裡沒有這一項。"
ONLY_THIS = "我只能就這次判讀回答 —— 你可以問風險、類型、你走到哪一步、接下來該做什麼、相似案例或適用法條。要重講一次請按「重新開始」。"
# End of fixed values.


@dataclass
class Script:
    """What a session asks for and listens to."""

    slots: dict[str, tuple[str, ...]]
    positives: tuple[str, ...]
    distress: tuple[str, ...]
    questions: int = 3
    follow_ups: tuple[str, ...] = field(default=("more", "else", "when"))
    platforms: dict[str, tuple[str, ...]] = field(default_factory=dict)  #: terms by module
    moved: str = "moved_to"  #: the slot that two modules' platforms fill, where ``slots`` has it
    intents: tuple[tuple[str, tuple[str, ...]], ...] = ()  #: what can be asked after the decision; the first match counts
    covers: float = 0.0  #: a decision at a lower score is uncovered, and its answer holds the advice itself
    joint: str = "\n"  #: what stands between two utterances where they are scored together

    def fresh(self) -> dict:
        return {"phase": "COLLECTING", "answers": 0, "filled": [], "asked": [], "said": [], "platforms": [], "advised": False, "tail": ""}

    def longest(self) -> int:
        """Characters of the longest term that is looked for in what was said."""
        groups = (*self.slots.values(), *self.platforms.values(), self.positives, self.distress)
        return max((len(t) for terms in groups for t in terms), default=0)

    def step(self, state: dict, text: str) -> dict:
        """The reply to one utterance; changes ``state``."""
        if text == RESTART:
            state.clear()
            state.update(self.fresh())
            return self._reply(state, None, False)
        if state["phase"] == "DONE":
            return self._reply(state, None, False, next((name for name, terms in self.intents if any(t in text for t in terms)), None))
        heard = text
        if text != FINISH:
            heard = (state["tail"] + self.joint if state["answers"] else "") + text
            state["answers"] += 1
            text, asked = heard, text
            state["tail"] = heard[max(0, len(heard) - self.longest() + 1) :] if self.longest() > 1 else ""
            state["platforms"] = [m for m, ts in self.platforms.items() if m in state.get("platforms", []) or any(t in text for t in ts)]
            both = len(state["platforms"]) >= 2
            state["filled"] = [n for n, ts in self.slots.items() if n in state["filled"] or any(t in text for t in ts) or (n == self.moved and both)]
            state["said"] = [t for t in self.positives if t in state["said"] or t in text]
            text = asked
        advice = not state["advised"] and any(t in heard for t in self.distress)
        state["advised"] = state["advised"] or advice
        question = None
        if text == FINISH or len(state["asked"]) >= self.questions:
            state["phase"] = "DONE"
            advice = advice and self._reply(state, None, False)["score"] >= self.covers
        else:
            open_ = [n for n in self.slots if n not in state["filled"] and n not in state["asked"]]
            question = (open_ or [f for f in self.follow_ups if f not in state["asked"]] or ["else"])[0]
            state["asked"].append(question)
        return self._reply(state, question, advice)

    @staticmethod
    def _reply(state: dict, question: str | None, advice: bool, intent: str | None = None) -> dict:
        e = float(len(state["said"]))
        return {"phase": state["phase"], "question": question, "advice": advice, "score": round(e / (e + 2), 4), "intent": intent}


def sessions(turns: DataFrame, script: Script, ts: str | None = None, idle: timedelta | None = None, late: timedelta = timedelta(minutes=10)) -> DataFrame:
    """Replies to a stream of (conv_id, turn, text) user turns, one per utterance. Turns that arrive
    in one micro-batch are taken in turn order; late ones extend the session as they come.

    A session without an utterance for ``idle`` is decided and closed: one reply more, ``closed``, without
    a turn, and its state is gone. Time is that of the column ``ts`` with a watermark ``late`` behind, or
    the clock's where there is none; what is said to a closed session begins a new one. Without ``idle``
    sessions stay open, as a stream over a finished table needs."""
    rest = int(idle.total_seconds() * 1000) if idle else 0

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else script.fresh()
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([{"conv_id": key[0], "turn": None, **script.step(now, FINISH), "question": None, "advice": False, "closed": True}])
            return
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        replies = [{"conv_id": key[0], "turn": t, **script.step(now, text or ""), "closed": False} for t, text in zip(rows["turn"], rows["text"])]
        if ts and idle:
            now["last"] = max(now.get("last", 0), int(rows["__at"].max()))
            state.setTimeoutTimestamp(max(now["last"] + rest, state.getCurrentWatermarkMs() + 1))
        elif idle:
            state.setTimeoutDuration(rest)
        state.update((json.dumps(now),))
        yield pd.DataFrame(replies)

    kind = GroupStateTimeout.NoTimeout if not idle else GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.ProcessingTimeTimeout
    if ts:
        turns = turns.withWatermark(ts, f"{int(late.total_seconds())} seconds").withColumn("__at", F.unix_millis(F.col(ts).cast("timestamp")))
    return turns.groupBy("conv_id").applyInPandasWithState(run, OUTPUT, "state string", "append", kind)


def follow_up(text: Column, fields: tuple = FOLLOW_UPS) -> Column:
    """The part of a decision that an utterance asks for: the first whose words it holds, or null."""
    out = F.lit(None).cast("string")
    for name, words in reversed(fields):
        asked = F.lit(False)
        for word in words:
            asked = asked | F.contains(text, F.lit(word))
        out = F.when(asked, name).otherwise(out)
    return out


def answers(asked: DataFrame, verdicts: DataFrame, field: str = "intent", key: str = "conv_id") -> DataFrame:
    """Adds ``kind`` and ``lines``, the answer to each utterance after a decision, to a table or a stream.

    ``verdicts`` has a row for each decided session: status (COVERED, COVERED_LOCKED or UNCOVERED), risk,
    scam_type, stage, explanation, actions (order, text), cases (source, case_id, excerpt), legal (title,
    article, version_date) and locked_notice. Only what it holds is answered: a locked session has no
    verdict (risk is null) and gets its notice, a missing part says so, and what asks for none of the
    parts is told what can be asked."""
    named = {c: F.col(f"v.{c}") for c in ("status", "risk", "scam_type", "stage", "explanation", "actions", "cases", "legal", "locked_notice")}
    lines = lambda column, line: F.when(F.size(column) > 0, F.transform(column, line))
    labels = F.create_map(*[F.lit(x) for pair in RISKS.items() for x in pair])
    stage = F.concat(named["stage"], F.when(F.coalesce(named["explanation"], F.lit("")) != "", F.concat(F.lit("\n\n"), named["explanation"])).otherwise(""))
    by_field = {
        "risk": F.array(F.concat(F.lit(RISK), F.coalesce(F.try_element_at(labels, named["risk"]), F.lit(RISKS["UNKNOWN"])))),
        "type": F.when(F.coalesce(named["scam_type"], F.lit("")) != "", F.array(named["scam_type"])),
        "stage": F.when(F.coalesce(named["stage"], F.lit("")) != "", F.array(stage)),
        "actions": lines(F.array_sort(named["actions"]), lambda a: F.concat(a["order"].cast("string"), F.lit(". "), a["text"])),
        "cases": lines(named["cases"], lambda c: F.concat(F.lit("・["), c["source"], F.lit(" "), c["case_id"], F.lit("] "), c["excerpt"])),
        "legal": lines(named["legal"], lambda r: F.concat(F.lit("・"), r["title"], F.lit(" "), r["article"], F.lit("（"), r["version_date"], F.lit("）"))),
    }
    answer = F.lit(None).cast("array<string>")
    for name, found in by_field.items():
        answer = F.when(F.col(field) == name, found).otherwise(answer)
    held = F.when(named["risk"].isNotNull(), answer)
    locked = named["status"] == "COVERED_LOCKED"
    joined = asked.alias("a").join(verdicts.alias("v"), key, "left")
    kind = F.when(F.col(field).isNull(), "say").when(held.isNotNull(), F.when(F.col(field) == "risk", "risk").otherwise("verdict")).when(locked, "locked").otherwise("say")
    said = F.when(F.col(field).isNull(), F.array(F.lit(ONLY_THIS))).when(held.isNotNull(), held).when(locked, F.array(named["locked_notice"])).otherwise(F.array(F.lit(MISSING)))
    return joined.select(*[F.col(key) if c == key else F.col(f"a.{c}") for c in asked.columns], kind.alias("kind"), said.alias("lines"))
