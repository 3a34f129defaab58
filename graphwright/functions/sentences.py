"""Relations as sentences for people, in Italian or English."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences by language and relation ("" for any other); {0} is the source, {1} the target, {2} the relation's name.
RELATIONS = {
    "it": {
        "MAY_INDICATE": "Se succede {0}, una causa possibile è {1}.",
        "INDICATES": "Il codice {0} indica {1}.",
        "RESOLVED_BY": "Se la causa è {0}, si interviene con {1}",
        "AFFECTS": "La causa {0} riguarda il componente {1}.",
        "": "{0} è collegato a {1} ({2}).",
    },
    "en": {
        "MAY_INDICATE": "If {0} happens, a possible cause is {1}.",
        "INDICATES": "The code {0} indicates {1}.",
        "RESOLVED_BY": "If the cause is {0}, the fix is {1}",
        "AFFECTS": "The cause {0} concerns the component {1}.",
        "": "{0} is linked to {1} ({2}).",
    },
}
# Kinds of actions, kinds of conditions ("if" also for any other), quotes, and what follows an unstated cause.
ACTIONS = {
    "it": {"inspection": "un controllo", "repair": "una riparazione", "escalation": "rivolgersi all'assistenza"},
    "en": {"inspection": "a check", "repair": "a repair", "escalation": "call for service"},
}
CONDITIONS = {
    "it": {"if": "Vale se", "prerequisite": "Prima", "warning": "Attenzione", "expected": "Risultato atteso", "order": "Ordine"},
    "en": {"if": "Applies if", "prerequisite": "First", "warning": "Warning", "expected": "Expected result", "order": "Order"},
}
QUOTES = {"it": ("«", "»"), "en": ("“", "”")}
UNSTATED = {"it": "(causa non scritta nel manuale)", "en": "(cause not written in the manual)"}


def looked_up(key: Column, table: dict[str, str], other: str | None = None) -> Column:
    """The table's text for a key, or another."""
    found = F.lit(other).cast("string")
    for name, text in table.items():
        found = F.when(key == name, F.lit(text)).otherwise(found)
    return found


def relation_sentence(language: str, relation: Column, source: Column, target: Column, *, unstated: Column | None = None, action: Column | None = None, conditions: Column | None = None) -> Column:
    """One relation as a sentence, with each of its conditions as one more.

    unstated: whether the source is a cause that the manual only implies; action: the kind of a remedy,
    said in brackets; conditions: array of struct(kind, text), said in order, equal ones once. A
    relation without a sentence of its own is said to be a link.
    """
    left, right = QUOTES[language]
    first, second = (F.concat(F.lit(left), c, F.lit(right)) for c in (source, target))
    if unstated is not None:
        first = F.concat(first, F.when(unstated, f" {UNSTATED[language]}").otherwise(""))
    marks = {"{0}": "%1$s", "{1}": "%2$s", "{2}": "%3$s"}
    said = None
    for name, text in sorted(RELATIONS[language].items()):
        for mark, printed in marks.items():
            text = text.replace(mark, printed)
        whole = F.format_string(text, first, second, relation)
        if name == "RESOLVED_BY":
            kind = looked_up(action, ACTIONS[language]) if action is not None else F.lit(None).cast("string")
            whole = F.concat(whole, F.coalesce(F.concat(F.lit(" ("), kind, F.lit(").")), F.lit(".")))
        # the sentence of any other relation sorts first
        said = whole if said is None else F.when(relation == name, whole).otherwise(said)
    if conditions is None:
        return said
    table = CONDITIONS[language]
    texts = F.transform(conditions, lambda c: F.concat(looked_up(c["kind"], table, table["if"]), F.lit(": "), F.rtrim(c["text"], F.lit(".")), F.lit(".")))
    return F.concat_ws(" ", said, F.array_distinct(texts))
