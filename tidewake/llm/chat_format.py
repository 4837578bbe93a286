"""Conversations as one marked text each, with a loss flag per segment, in DataFrame operations only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks around turns, and the machine: by state and role the next state and whether the text carries loss. A role that
#: has no step in a state leads to `rejected` for good, where texts of the roles in `loss` still carry loss.
TEMPLATE = {
    "open": "### ",
    "role_end": ": ",
    "close": " </turn>\n",
    "start": "start",
    "accept": ("answered",),
    "steps": {
        ("start", "system"): ("ready", False),
        ("start", "user"): ("asked", False),
        ("ready", "user"): ("asked", False),
        ("asked", "assistant"): ("answered", True),
        ("answered", "user"): ("asked", False),
    },
    "loss": ("assistant",),
}


def escapes(template: dict) -> list[tuple[str, str]]:
    """(character, code) for the escape character, first, and one character of each mark that isn't a letter, digit or
    blank if it has any: no mark is complete without it, so none occurs in an escaped text. A code is the escape
    character and a letter that is in no mark's character."""
    keys = ["\\"]
    for mark in (template["open"], template["close"], template["role_end"]):
        key = next((c for c in mark if not c.isalnum() and not c.isspace()), mark[0])
        keys += [key] if key not in keys else []
    letters = [c for c in "bhlcdefg" if c not in keys]
    return [(k, "\\" + c) for k, c in zip(keys, letters, strict=False)]


def escaped(text: Column, template: dict) -> Column:
    for bare, code in escapes(template):
        text = F.replace(text, F.lit(bare), F.lit(code))
    return text


def unescaped(text: Column, template: dict) -> Column:
    for bare, code in reversed(escapes(template)):
        text = F.replace(text, F.lit(code), F.lit(bare))
    return text


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def machine(turns: Column, template: dict) -> Column:
    """What the template's finite-state machine makes of the turns: (valid, flags), flags being a string with l for
    each turn whose text carries loss and - for the others, as its transitions emit them."""
    steps = F.create_map(*[x for (state, role), (to, loss) in template["steps"].items() for x in (F.lit(f"{state} {role}"), F.struct(F.lit(to).alias("state"), F.lit("l" if loss else "-").alias("flag")))])
    otherwise = lambda t: F.struct(F.lit("rejected").alias("state"), F.when(t["role"].isin(*template["loss"]), "l").otherwise("-").alias("flag"))
    step = lambda a, t: let(F.coalesce(F.try_element_at(steps, F.concat(a["state"], F.lit(" "), t["role"])), otherwise(t)), lambda s: F.struct(s["state"].alias("state"), F.concat(a["flags"], s["flag"]).alias("flags")))
    end = F.aggregate(turns, F.struct(F.lit(template["start"]).alias("state"), F.lit("").alias("flags")), step)
    return let(end, lambda e: F.struct(e["state"].isin(*template["accept"]).alias("valid"), e["flags"].alias("flags")))


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text): conv_id, valid, formatted, segments.

    Rows of a conversation are in order of turn (null first), role, text; null role or text: empty; repeated
    rows are turns of their own; rows without conv_id are one conversation. A turn becomes open, role, role_end, text,
    close, with role and text escaped. segments: array of (start, length, loss) in code points over the whole of
    formatted, the flags being what the machine emits; valid: its verdict. Every conversation is formatted, valid or
    not, long texts whole. Starts are running sums over the rows, so a conversation of many turns takes time in
    proportion; all that it holds becomes one row. One shuffle, by conversation. Other columns play no part; without
    turns there are no conversations.
    """
    opened, role_end, close = (template[k] for k in ("open", "role_end", "close"))
    made = lambda c: escaped(F.coalesce(c, F.lit("")), template)
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("raw"), F.concat(F.lit(opened), made(F.col("role")), F.lit(role_end)).alias("head"), made(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "raw").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + F.lit(len(close))
    placed = clean.withColumn("at", F.coalesce(F.sum(size).over(order), F.lit(0)).cast("int"))
    held = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "head", "body"))).alias("turns"))
    held = held.select("conv_id", "turns", machine(F.col("turns"), template).alias("m"))
    segment = lambda start, length, loss: F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), loss.alias("loss"))
    three = lambda flags: lambda t, i: let(F.char_length(t["head"]), lambda h: let(F.char_length(t["body"]), lambda b: F.array(
        segment(t["at"], h, F.lit(False)), segment(t["at"] + h, b, F.get(flags, i) == "l"), segment(t["at"] + h + b, F.lit(len(close)), F.lit(False)))))
    segments = let(F.split(F.col("m.flags"), ""), lambda flags: F.flatten(F.transform("turns", three(flags))))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(close))), "")
    return held.select("conv_id", F.col("m.valid").alias("valid"), formatted.alias("formatted"), segments.alias("segments"))


def read_chats(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Reads back what format_chats made: conv_id, valid, turns (array of role, text), loss_text, formatted_chars.

    Roles and texts come from the marks in the text alone, loss_text from the segments with the loss flag."""
    opened, role_end, close = (template[k] for k in ("open", "role_end", "close"))
    literal = "".join(f"\\x{{{ord(c):x}}}" for c in close)  # nothing in it is a pattern
    parts = F.filter(F.split(F.col("formatted"), literal), lambda x: x != "")
    turn = F.transform(parts, lambda p: let(F.call_function("locate", F.lit(role_end), p, F.lit(len(opened) + 1)), lambda at: F.struct(
        unescaped(F.substring(p, F.lit(len(opened) + 1), at - 1 - len(opened)), template).alias("role"),
        unescaped(F.substring(p, at + len(role_end), F.char_length(p)), template).alias("text"),
    )))
    lost = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
    return formatted.select("conv_id", "valid", turn.alias("turns"), unescaped(F.array_join(lost, ""), template).alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
