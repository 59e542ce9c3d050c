"""Vocabularies for the standard tables, whose texts are invented European prose."""

from sievewright.operators.rules import Ladder, Pack

PLATFORMS = ("License", "token", "@mail", "http")
TACTIC = ("thing", "shon", "trash", "idiot", "tthe")
DISTRESS = ("idiot", "worthless")
STAGES = (
    ("contact", "LOW", ("thing", "avec", "nicht")),
    ("paid", "MEDIUM", ("@mail", "+1 (")),
    ("drained", "HIGH", ("token", "trash")),
)
PACKS = [
    Pack("a", positives=("thing", "tion", "ther"), negatives=("###",), platform=("License", "that"), others=("token",), style="factor", priority=1, stages=STAGES),
    Pack("c", positives=("ement", "eau", "ique"), negatives=("***",), platform=("pour",), style="bonus", plan="paid", priority=2, stages=STAGES),
    Pack("e", positives=("keit", "ung", "sch"), negatives=("!!",), platform=("nicht", "der "), decisive=("die ",), exclude="trash|idiot", style="decisive", priority=3, stages=STAGES),
    Pack("off", positives=(), usable=False),
]
TABLES = {
    "category": {"junk": ["###", "!!"], "legal": ["license", "licensed"], "secret": ["token", "secret"]},
    "channel": {"mail": ["@mail"], "phone": ["+1 ("], "web": ["http", "www"]},
}
VOCABULARY = {k: list(v) for k, v in TABLES.items()}
GROUPS = {"Online": ["mail", "web"], "Reach": ["phone"]}
MATRIX = {"s1": "thing|avec", "s2": "@mail", "s3": "token|secret", "s4": "[0-9]{4} [0-9]{4}"}
LADDER = Ladder(
    patterns={1: "thing|avec|nicht", 4: "http|www", 5: "@mail", 8: r"\+1 \(|[0-9]{16}", 9: "token|secret", 11: "trash"},
    decisive=(9, 11),
    suspicious=(4, 5),
    rungs=(("DRAINED", (11,)), ("CREDENTIALS", (9,)), ("REPEATED", ()), ("PAID", (8,))),
    pay=8,
    repeat="again|License",
    universal=(("insult", "idiot", 0),),
)
PAYMENTS = {"card": ["4111", "token"], "phone": ["+1 ("], "mail": ["@mail"]}
INTENTS = [("thanks", ["thing", "gra"]), ("where", ["wh", "où"]), ("pay", ["pa"])]
SLOTS = {"who": ["the", "die"], "where": ["in ", "en "], "amount": ["pa", "for"]}
THRESHOLDS = [("hit_rate", 0.75, "ge"), ("latency", 1.0, "le"), ("kappa", 0.7, "ge")]
SIGNS = [("idiot|trash", "End the talk"), ("token|secret", "Change passwords")]
TAIL = ["Call 165", "Check accounts"]
NOT_AGAIN = "Do not pay again"
ASKED = (("stage", ("thing",)), ("cases", ("wh",)), ("actions", ("gra", "pa")), ("legal", ("or ",)), ("type", ("ing",)), ("risk", ("en",)))
SPANNING = ("tion", "ther", "er.T", "t.A", "s.O")
