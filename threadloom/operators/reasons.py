"""Short codes for why something was decided, and the wording shown for them.

Routing, retries and checks emit codes; a detail follows a colon. Only views
turn codes into sentences, through the tables here.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT = {
    "rule": "A rule you set; it goes along unchanged.",
    "exact": "You want this text exactly as it stands.",
    "instruction": "Part of the fixed instructions of this chat.",
    "model": "Marked by the classifier as something to keep unchanged.",
}
BACK = {
    "named_missing": "The reviewer listed this as absent from the last attempt.",
    "needed_next": "The message after it cannot be understood alone.",
    "next_best": "Next in line when more history was allowed.",
    "recent_turn": "One of the latest turns.",
    "reference": "Your request points at it.",
    "by_meaning": "Found by meaning rather than by words.",
    "pair_of": "Question and answer travel together.",
    "note_not_smaller": "A memory note would take as much room.",
    "notes_not_smaller": "A memory note would take as much room.",
    "standing_rule": "A lasting preference of yours.",
    "terms": "Words in common with the request: ",
    "no_terms": "Scored as related to the request.",
}
GONE = {"copy_of": "The same text is there already.", "unrelated": "Nothing ties it to the request, and it sets no lasting rule."}
PACKED = {"repeats": "Many alike; a sample stands for them.", "summary": "Only its main points matter here."}
NOTED = {"decision": "A project decision that still holds.", "rule": "A preference or rule that still holds.", "fact": "A fact that still holds."}
RETRIED = {
    "failed": "First answer rejected",
    "regenerated": "Asked again on the same history",
    "expanded": "Asked again with added history",
    "full": "Asked again on the whole history",
    "no_retry": "No second attempt",
    "flagged": "Answer flagged and returned; the history sent was not at fault",
}


def code_of(reason: Column) -> Column:
    return F.substring_index(reason, ":", 1)


def detail_of(reason: Column) -> Column:
    return F.when(F.contains(reason, F.lit(":")), F.substring(reason, F.length(code_of(reason)) + 2, F.length(reason))).otherwise("")


def worded(code: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, text in table.items():
        out = out.when(code == key, text)
    return out if otherwise is None else out.otherwise(otherwise)


def kept_code(role: Column, reason: Column, method: Column, exact: str) -> Column:
    """Kind of protection of a kept message."""
    return F.when(role.isin("system", "developer"), "instruction").when(reason == exact, "exact").when(method == "semantic", "model").otherwise("rule")
