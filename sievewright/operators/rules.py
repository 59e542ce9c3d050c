"""Rule classifiers, routing over packs, guards, coverage and verdict composition."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import automaton
from sievewright.functions import masking as M
from sievewright.functions import text as T

DISCLAIMER = "This is not legal advice."


@dataclass(frozen=True)
class Pack:
    """A rule pack: vocabularies and thresholds that become column expressions."""

    id: str
    positives: tuple[str, ...]
    negatives: tuple[str, ...] = ()
    platform: tuple[str, ...] = ()
    others: tuple[str, ...] = ()
    decisive: tuple[str, ...] = ()
    exclude: str = ""
    style: str = "factor"  #: factor, bonus or decisive
    plan: str = "free"
    priority: int = 0
    route_min: float = 0.5
    hint_min: float = 0.3
    usable: bool = True
    stages: tuple[tuple[str, str, tuple[str, ...]], ...] = field(default=())  #: (id, risk, cues) in order

    def __post_init__(self) -> None:
        if self.hint_min > self.route_min:
            raise ValueError("hint_min must not exceed route_min")

    def terms(self) -> tuple[str, ...]:
        """All terms that are looked for as they are."""
        return (*self.positives, *self.negatives, *self.platform, *self.decisive)

    def score(self, text: Column, found: automaton.Found | None = None) -> Column:
        """``found`` has the terms that one scan for all packs has found; without it each is looked for."""
        if not self.usable or not self.positives:
            return F.lit(0.0)
        any_term = found.any if found else lambda terms: T.any_term(text, terms)
        base = _keyword_score(*(found.count(ts) if found else T.n_hits(text, ts) for ts in (self.positives, self.negatives)))
        own = T.bounded_term(text, self.platform)
        if self.style == "factor":
            factor = F.when(own, 1.3).when(T.bounded_term(text, self.others), 0.6).otherwise(1.0)
            return F.bround(F.least(F.lit(1.0), base * factor), 4)
        on = any_term(self.platform)
        if self.style == "bonus":
            return F.least(F.lit(1.0), base + F.when(on, 0.15).otherwise(0.0))
        low = F.least(base, F.lit(self.hint_min))
        sure = ((base > 0) | ~any_term(self.negatives)) & on & any_term(self.decisive)
        out = F.when(sure, F.greatest(base, F.lit(0.6))).when(~on, low).otherwise(F.least(F.lit(1.0), base + 0.15))
        return F.when(text.rlike(self.exclude), low).otherwise(out) if self.exclude else out


def keyword_score(text: Column, positives, negatives=()) -> Column:
    """e / (e + 2) with e = hits - half the contrary hits, at least 0; overlapping terms all count."""
    return _keyword_score(T.n_hits(text, positives), T.n_hits(text, negatives))


def _keyword_score(hits: Column, contrary: Column) -> Column:
    e = F.greatest(F.lit(0.0), hits - 0.5 * contrary)
    return F.bround(e / (e + 2), 4)


def detect_stage(text: Column, stages) -> Column:
    """The last stage, in order, that any of its cues names; empty if none."""
    out = F.lit("")
    for name, _, cues in stages:
        out = F.when(T.any_term(text, cues), name).otherwise(out)
    return out


def stage_matrix(text: Column, patterns: dict[str, str]) -> list[Column]:
    return [text.rlike(p).alias(name) for name, p in patterns.items()]


@dataclass(frozen=True)
class Ladder:
    """An ordered account of how far an incident went, from numbered stage patterns."""

    patterns: dict[int, str]
    decisive: tuple[int, ...]
    suspicious: tuple[int, ...]
    rungs: tuple[tuple[str, tuple[int, ...]], ...]  #: (harm, stages), worst first
    pay: int
    repeat: str
    universal: tuple[tuple[str, str, int], ...] = ()  #: (name, pattern, decisive stage that says the same, or 0)

    def assess(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds stages, payments (0, 1, 2), harm, verdict and confidence."""
        c = F.col(text)
        found = F.filter(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in self.patterns.items()]), lambda x: x.isNotNull())
        df = df.withColumn("stages", found)
        df = df.withColumn("payments", F.when(F.array_contains("stages", self.pay), F.when(c.rlike(self.repeat), 2).otherwise(1)).otherwise(0))
        overlap = lambda ns: F.arrays_overlap("stages", F.array(*[F.lit(n) for n in ns]))
        harm = F.lit("NONE")
        for name, stages in reversed(self.rungs):
            hit = overlap(stages) if stages else F.lit(False)
            harm = F.when(hit | (F.col("payments") >= 2) if name == "REPEATED" else hit, name).otherwise(harm)
        signs = [(c.rlike(pattern), same) for _, pattern, same in self.universal]
        shared = F.lit(False)
        for sign, _ in signs:
            shared = shared | sign
        harm = F.when(shared & harm.isin("NONE", "PAID", "REPEATED"), "CREDENTIALS").otherwise(harm)
        count = lambda ns: F.size(F.array_intersect("stages", F.array(*[F.lit(n) for n in ns])))
        sure = count(self.decisive)
        for sign, same in signs:  # a sign that a decisive stage already gives counts once
            sure = sure + (sign & ~F.array_contains("stages", same)).cast("int")
        odd = count(self.suspicious) + (F.col("payments") >= 2).cast("int")
        verdict = F.when(sure >= 1, "SCAM").when(odd >= 2, "LIKELY").otherwise("UNKNOWN")
        confidence = F.when(sure >= 2, "HIGH").when((sure == 1) | (odd >= 2), "MEDIUM").otherwise("LOW")
        return df.withColumns({"harm": harm, "verdict": verdict, "confidence": confidence})


def extract_profile(df: DataFrame, text: str, platforms, payments: dict[str, list[str]]) -> DataFrame:
    """First matching platform in list order, first payment category with any term, days."""
    c = F.col(text)
    paid = F.lit(None).cast("string")
    for name, terms in reversed(list(payments.items())):
        paid = F.when(T.any_term(c, terms), name).otherwise(paid)
    return df.withColumns({"platform": F.get(T.hits(c, platforms), 0), "payment": paid, "days": T.extract_days(c, "days?|天|日"), "confidence": F.lit("LOW")})


#: How far a field of a profile is to be believed where a rule has found it.
FIELD_CONFIDENCE = {"platform": 0.4, "payment": 0.4, "amount_range": 0.6, "stage": 0.4}


def profile(df: DataFrame, text: str, platforms, payments: dict[str, list[str]], stage: Column, masked: Column | None = None) -> DataFrame:
    """As :func:`extract_profile`, with the range of the first amount, the stage (null where it is empty) and
    a confidence for each field, 0 where the rules found none. ``masked`` is the struct of masked text,
    where it is at hand."""
    amounts = F.filter((M.mask_struct(F.col(text)) if masked is None else masked)["redactions"], lambda r: r["kind"] == "amount")
    out = extract_profile(df.withColumn("__amount", F.get(amounts, 0)["placeholder"]), text, platforms, payments)
    out = out.withColumns({"amount_range": F.col("__amount"), "stage": F.nullif(stage, F.lit(""))}).drop("__amount")
    sure = [F.when(F.col(c).isNotNull(), v).otherwise(0.0).alias(c) for c, v in FIELD_CONFIDENCE.items()]
    return out.withColumn("field_confidence", F.struct(*sure))


def scores(df: DataFrame, packs: list[Pack], key: str, text: str, one_scan: bool = False) -> DataFrame:
    """(key, module, score, priority, thresholds, plan) for every row and usable pack: the packs are
    an array of column expressions, so the product needs no join. With ``one_scan`` the terms of all
    packs are found by one automaton, in one pass over the text, however many they are."""
    found = None
    if one_scan:
        known = automaton.Found([t for p in packs if p.usable for t in p.terms()], "__found")
        df, found = df.withColumn("__found", known.column(F.col(text))), known
    each = [F.struct(F.lit(p.id).alias("module"), F.lit(k).alias("place"), p.score(F.col(text), found).cast("double").alias("score"), F.lit(p.priority).alias("priority"), F.lit(p.route_min).alias("route_min"), F.lit(p.hint_min).alias("hint_min"), F.lit(p.plan).alias("plan")) for k, p in enumerate(packs) if p.usable]
    return df.select(key, F.explode(F.array(*each)).alias("s")).select(key, "s.*")


def route(df: DataFrame, packs: list[Pack], key: str, text: str, manual: Column | None = None, one_scan: bool = False) -> DataFrame:
    """(key, primary, score, also): the best claim wins, ties by priority; then the other claims in
    that order, then hints in the order of the packs. A manual choice goes before all."""
    all_ = scores(df, packs, key, text, one_scan)
    claim, hint = F.col("score") >= F.col("route_min"), F.col("score") >= F.col("hint_min")
    item = F.struct(F.when(claim, 0).otherwise(1).alias("kind"), F.when(claim, -F.col("score")).otherwise(0.0).alias("by"), F.when(claim, F.col("priority")).otherwise(0).alias("then"), "place", "module", "score")
    found = all_.groupBy(key).agg(F.array_sort(F.collect_list(F.when(hint, item))).alias("found"))
    top = F.get("found", 0)
    primary = F.when(top["kind"] == 0, top["module"])
    rest = F.when(primary.isNotNull(), F.slice("found", 2, F.size("found"))).otherwise(F.col("found"))
    out = found.select(key, primary.alias("primary"), F.when(primary.isNotNull(), top["score"]).alias("score"), F.array_join(F.transform(rest, lambda x: x["module"]), ",").alias("also"))
    if manual is None:
        return out
    chosen = df.select(key, manual.alias("manual"))
    return out.join(chosen, key).withColumn("primary", F.coalesce("manual", "primary")).drop("manual")


def coverage(routed: DataFrame, packs: list[Pack], unlocked: Column) -> DataFrame:
    """Adds status: uncovered, covered or covered_locked (an unknown entitlement counts as allowed)."""
    free = F.lit(False)
    for p in packs:
        free = F.when(F.col("primary") == p.id, p.plan == "free").otherwise(free)
    can = free | F.coalesce(unlocked, F.lit(True))
    return routed.withColumn("status", F.when(F.col("primary").isNull(), "UNCOVERED").when(can, "COVERED").otherwise("COVERED_LOCKED"))


def compose(df: DataFrame, stages: DataFrame, fallback: str, key: str = "stage") -> DataFrame:
    """Stage facts by id; an unknown id takes the fallback's, and without one the first stage's.

    ``stages`` is a playbook (id, pos, risk, actions): one row per stage, so it is broadcast."""
    first = stages.agg(F.min_by(F.struct("id", "risk", "actions"), "pos").alias("x"))
    spare = stages.filter(F.col("id") == fallback).agg(F.first(F.struct("id", "risk", "actions")).alias("y"))
    default = first.crossJoin(spare).select(F.coalesce("y", "x").alias("d"))
    named = df.join(F.broadcast(stages.select(F.col("id").alias(key), F.struct("id", "risk", "actions").alias("own"))), key, "left").crossJoin(F.broadcast(default))
    chosen = F.coalesce("own", "d")
    return named.select(*df.columns, chosen["id"].alias("stage_id"), chosen["risk"].alias("risk"), F.transform(chosen["actions"], lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a)).alias("steps"))


def actions_for(text: Column, own: Column, signs: list[tuple[str, str]], tail: list[str], dropped: str, first: tuple[Column, str] | None = None) -> Column:
    """Ordered actions: those of the signs (pattern, action) that a text shows, then ``tail`` and the
    own ones that don't speak of ``dropped``; without a sign the own ones. ``first`` is a condition
    and what then stands in the place of the first action, if there is one."""
    shown = F.filter(F.array(*[F.when(text.rlike(p), F.lit(a)) for p, a in signs]), lambda a: a.isNotNull())
    rest = F.concat(F.array(*[F.lit(a) for a in tail]), F.filter(own, lambda a: ~F.contains(a, F.lit(dropped))))
    out = T.let(shown, lambda s: F.when(F.size(s) > 0, F.concat(s, rest)).otherwise(own))
    if first is None:
        return out
    when, instead = first
    return T.let(out, lambda a: F.when(F.coalesce(when, F.lit(False)) & (F.size(a) > 0), F.concat(F.array(F.lit(instead)), F.slice(a, 2, F.size(a)))).otherwise(a))


def ordered(actions: Column, mark: str = "* ") -> Column:
    """Lines of an array of (order, text, preventive) structs by order; of one order, as they come."""
    placed = F.array_sort(F.transform(actions, lambda a, i: F.struct(a["order"].alias("order"), i.alias("i"), a["text"].alias("text"), a["preventive"].alias("preventive"))))
    return F.transform(placed, lambda a: F.concat(a["order"].cast("string"), F.lit(". "), F.when(a["preventive"], mark).otherwise(""), a["text"]))


def guards(df: DataFrame) -> DataFrame:
    """Checks (risk, actions, case_ids, disclaimer): violations, whether fatal, and the repaired row."""
    severe = F.col("risk").isin("HIGH", "CRITICAL")
    kept = F.filter("actions", lambda a: F.trim(a) != "")
    ids = F.filter("case_ids", lambda a: F.trim(a) != "")
    found = F.array(
        F.when(severe & (F.size(kept) == 0), "severe_without_actions"),
        F.when(F.size(ids) < F.size("case_ids"), "blank_case_id"),
        F.when(F.size(kept) < F.size("actions"), "blank_action"),
        F.when(F.trim(F.coalesce("disclaimer", F.lit(""))) == "", "no_disclaimer"),
    )
    out = df.withColumn("violations", F.filter(found, lambda v: v.isNotNull()))
    return out.withColumns({"fatal": F.array_contains("violations", "severe_without_actions"), "actions": kept, "case_ids": ids, "disclaimer": F.coalesce(F.nullif(F.trim("disclaimer"), F.lit("")), F.lit(DISCLAIMER)), "degraded": F.size("violations") > 0})


def stratified(df: DataFrame, strata: list[str], id_col: str, per_group: int) -> DataFrame:
    """``per_group`` rows for each value of the first stratum column, split evenly over the others;
    what small strata can't give comes from the largest. Rows go by id within a stratum."""
    group, cell = strata[0], Window.partitionBy(*strata)
    # No stratum gives more than per_group rows, so Spark drops the others before the shuffle.
    first = df.withColumn("__at", F.row_number().over(cell.orderBy(id_col))).filter(F.col("__at") <= per_group)
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    same = [first[c].eqNullSafe(sizes[c]) for c in strata]
    sized = first.join(sizes, same).select(*[first[c] for c in first.columns], "__n")
    # Dealing rows round by round, largest stratum first, gives the even split and the back-fill.
    turn = Window.partitionBy(group).orderBy("__at", F.desc("__n"), *strata[1:], id_col)
    return sized.withColumn("__turn", F.row_number().over(turn)).filter(F.col("__turn") <= per_group).drop("__n", "__at", "__turn")
