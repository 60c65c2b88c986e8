"""Typed conversations as text with trained spans, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's labels, in the order they are named.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
REPLY = "assistant"

_LABEL = r"(?:^|\n)(?:System|User|Assistant): ?"


def turns(documents: DataFrame) -> DataFrame:
    """doc_id, messages (array of role, content) of the documents that are rendered conversations."""
    t = F.col("text")
    whole = documents.where(t.rlike(r"^(System|User|Assistant): "))
    labels = F.regexp_extract_all(t, F.lit(r"(?:^|\n)(System|User|Assistant):"), 1)
    parts = F.slice(F.split(t, r"(?:^|\n)(?:System|User|Assistant):"), 2, 1_000_000)
    content = F.transform(parts, lambda p, i: F.regexp_replace(p, r"^ |\n$", ""))
    return whole.select("doc_id", "text", F.transform(F.arrays_zip(labels.alias("l"), content.alias("c")), lambda x: F.struct(F.lower(x["l"]).alias("role"), x["c"].alias("content"))).alias("messages"))


def problem(messages: Column, prompt: bool = False) -> Column:
    """Why messages can't be rendered, or null."""
    roles = F.transform(messages, lambda m: F.lower(F.trim(m["role"])))
    out = (
        F.when(messages.isNull(), "not_a_list")
        .when(F.size(messages) == 0, "empty")
        .when(F.exists(messages, lambda m: m.isNull()), "not_an_object")
        .when(F.exists(roles, lambda r: r.isNull()), "no_role")
        .when(F.exists(roles, lambda r: ~r.isin(*LABELS)), "unknown_role")
        .when(F.exists(messages, lambda m: m["content"].isNull()), "no_content")
        .when(F.exists(messages, lambda m: F.length(F.trim(m["content"])) == 0), "empty_content")
    )
    last = F.element_at(roles, -1)
    return out.when(last == REPLY, "ends_with_reply") if prompt else out.when(~F.exists(roles, lambda r: r == REPLY), "no_assistant")


def _rendered(messages: Column) -> Column:
    """Array of (separator, label, content, trained) by message."""
    n = F.size(messages)
    role = lambda m: F.lower(F.trim(m["role"]))

    def piece(m: Column, i: Column) -> Column:
        before = F.get(messages, i - 1)
        gap = F.when(i == 0, "").when((role(before) == REPLY) & (role(m) != REPLY), "\n\n").otherwise("\n")
        label = F.concat(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[role(m)], F.lit(": "))
        after = F.get(messages, i + 1)
        behind = F.when(i == n - 1, 0).when((role(m) == REPLY) & (role(after) != REPLY), 2).otherwise(1)
        return F.struct(gap.alias("gap"), label.alias("label"), m["content"].alias("content"), (role(m) == REPLY).alias("trained"), behind.alias("behind"))

    return F.transform(messages, piece)


def render(conversations: DataFrame, messages: str = "messages") -> DataFrame:
    """conversations with text and trained_spans: of every reply from its first character up to the next label."""
    parts = _rendered(F.col(messages))
    out = conversations.withColumn("_p", parts)
    text = F.array_join(F.transform("_p", lambda p: F.concat(p["gap"], p["label"], p["content"])), "")
    size = lambda p: F.length(p["gap"]) + F.length(p["label"]) + F.length(p["content"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<span_start:int,span_end:int>>").alias("spans"))
    spans = F.aggregate(
        "_p",
        start,
        lambda s, p: F.struct(
            (s["at"] + size(p)).alias("at"),
            F.when(p["trained"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["gap"]) + F.length(p["label"])).alias("span_start"), (s["at"] + size(p) + p["behind"]).alias("span_end"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return out.withColumn("rendered", text).withColumn("spans", spans).drop("_p")


def prompt(messages: Column) -> Column:
    """The text to ask for a reply with, up to the label's colon; the last reply, if there is one at the end, left out."""
    asked = F.when(F.lower(F.trim(F.element_at(messages, -1)["role"])) == REPLY, F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages)
    text = F.array_join(F.transform(_rendered(asked), lambda p: F.concat(p["gap"], p["label"], p["content"])), "")
    return F.when(F.size(asked) > 0, F.concat(text, F.lit("\nAssistant:")))


def fault(messages) -> str | None:
    """As problem(), of a value that JSON gave."""
    if not isinstance(messages, list):
        return "not_a_list"
    if not messages:
        return "empty"
    if not all(isinstance(m, dict) for m in messages):
        return "not_an_object"
    roles = [m.get("role") for m in messages]
    if not all(isinstance(r, str) for r in roles):
        return "no_role"
    if not all(r.strip().lower() in LABELS for r in roles):
        return "unknown_role"
    if not all(isinstance(m.get("content"), str) for m in messages):
        return "no_content"
    if not all(m["content"].strip() for m in messages):
        return "empty_content"
    return None if any(r.strip().lower() == REPLY for r in roles) else "no_assistant"


def written_out(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """(text, trained spans) of faultless messages, as render() has them; for readers, which have no column yet."""
    roles = [m["role"].strip().lower() for m in messages]
    text, spans = "", []
    for k, (role, m) in enumerate(zip(roles, messages)):
        turn = role != REPLY and k > 0 and roles[k - 1] == REPLY
        text += ("\n\n" if turn else "\n" if k else "") + f"{LABELS[role]}: "
        begin = len(text)
        text += m["content"]
        if role == REPLY:
            after = 0 if k + 1 == len(roles) else 1 if roles[k + 1] == REPLY else 2
            spans.append((begin, len(text) + after))
    return text, spans


def reply_content(generated: Column, continuing: bool = False) -> Column:
    return F.regexp_replace(generated if continuing else F.regexp_replace(generated, "^ ", ""), r"\n+$", "")


def earliest_stop(text: Column, stops: tuple[str, ...]) -> Column:
    """(at, stop) where the first of the strings begins, the caller's order deciding ties; null where none does."""
    found = F.array(*(F.struct((F.instr(text, s) - 1).alias("at"), F.lit(i).alias("order"), F.lit(s).alias("stop")) for i, s in enumerate(stops)))
    return F.array_min(F.filter(found, lambda x: x["at"] >= 0))


def held_back(text: Column, stops: tuple[str, ...]) -> Column:
    """How many characters at the end may be the beginning of a stop string."""
    return F.greatest(F.lit(0), *(F.when(F.endswith(text, F.lit(s[:k])), F.lit(k)).otherwise(0) for s in stops for k in range(1, len(s))))
