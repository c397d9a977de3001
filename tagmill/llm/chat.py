"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds an array of typed parts. A visitor flattens them, in order, into one
body: text is escaped, an image, audio or document part becomes a placeholder whose
number is its place among the message's attachments. The attachments are recorded
with their reference and the number of tokens their placeholder expands to.

Template of a turn: ``### role: body</turn>\\n``. Control strings are ``###``,
``</turn>`` and ``<|...|>``. Inside texts a backslash is doubled and ``</``, ``<|``,
``##`` and, in roles, ``: `` get a backslash inside, so that no control string can
occur in an escaped text and removing one backslash of each pair restores it. Texts that
follow each other without an attachment between them are one text: where their ends
would make a control string, the second one begins with a backslash.

Defined cases: null text, role or part list counts as empty; a null part is skipped;
an unknown kind of part gives a placeholder of no tokens, and marks in its name are escaped; null and negative measures
count as 0; rows go by turn (nulls first), ties by role, then text, and repeated rows
all stay; rows without a conversation id form one conversation; other columns are
ignored; an empty table gives no rows; texts may be as long as a string can be. One conversation is one output row, hence one
row's memory; turns of a conversation meet by one hash aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN_END = "</turn>\n"
HEAD, HEAD_END = "### ", ": "
#: What control strings begin with, and how it is written in texts.
CONTROLS = (("</", "<\\/"), ("<|", "<\\|"), ("##", "#\\#"))
#: Token costs of attachments: pixels on a patch's side, tokens a second and a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    """Make control strings impossible in ``text``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, safe in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(safe))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))).cast(f"array<{PART}>")


def _count(value: Column) -> Column:
    return F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def part_tokens(part: Column, patch: int, audio_rate: int, page_tokens: int) -> Column:
    """Tokens that an attachment's placeholder expands to."""
    return (
        F.when(part["kind"] == "image", F.ceil(_count(part["width"]) / patch) * F.ceil(_count(part["height"]) / patch))
        .when(part["kind"] == "audio", F.ceil(_count(part["seconds"]) * audio_rate))
        .when(part["kind"] == "document", (_count(part["pages"]) * page_tokens).cast("long"))
        .otherwise(F.lit(0))
        .cast("long")
    )


def _shown(parts: Column) -> Column:
    """The parts that show in a body: place among the message's parts, kind (null: text) and text; empty texts go."""
    kind = lambda p: F.when(p["kind"] != "text", p["kind"])
    placed = F.transform(parts, lambda p, i: F.struct(i.alias("part"), kind(p).alias("kind"), F.coalesce(p["text"], F.lit("")).alias("text")))
    return F.filter(placed, lambda p: p["kind"].isNotNull() | (p["text"] != ""))


def _visit(shown: Column) -> Column:
    """Body of a message. Placeholders carry the part's place among the message's parts."""

    def text(p: Column, before: Column) -> Column:
        joint = F.concat(F.substring(before["text"], -1, 1), F.substring(p["text"], 1, 1))
        meets = before["kind"].isNull() & joint.isin(*(control for control, _ in CONTROLS))
        return F.concat(F.when(meets, "\\").otherwise(""), escape(p["text"]))

    def placeholder(p: Column) -> Column:
        return F.concat(F.lit("<|"), F.regexp_replace(p["kind"], r"([\\<|>#])", r"\\$1"), F.lit(" "), p["part"].cast("string"), F.lit("|>"))

    return F.array_join(F.transform(shown, lambda p, i: F.when(p["kind"].isNull(), text(p, F.get(shown, i - 1))).otherwise(placeholder(p))), "")


def format_conversations(
    df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    trained: tuple[str, ...] = ("assistant",), patch: int = PATCH, audio_rate: int = AUDIO_RATE, page_tokens: int = PAGE_TOKENS,
) -> DataFrame:
    """One row per conversation: formatted text, layout of its turns, attachments, token counts.

    ``turns`` lays ``formatted`` out: code points of head, body and tail of each turn and
    whether its body is under the loss mask. ``attachments`` has turn ordinal, part ordinal,
    kind, reference and tokens.
    """
    whole = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    turns = df.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), whole.alias("parts")).withColumn("shown", _shown(F.col("parts")))
    turns = turns.select(
        "conv_id", "turn", "role", _visit(F.col("shown")).alias("body"),
        F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p, patch, audio_rate, page_tokens).alias("tokens"))), lambda a: F.coalesce(a["kind"], F.lit("text")) != "text").alias("attached"),
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "attached"))).alias("rows"))
    head = lambda r: F.concat(F.lit(HEAD), escape_role(r["role"]), F.lit(HEAD_END))
    attached = F.flatten(F.transform("rows", lambda r, i: F.transform(r["attached"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = convs.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: F.concat(head(r), r["body"], F.lit(TURN_END))), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(F.length(head(r)).alias("head"), F.length(r["body"]).alias("body"), F.lit(len(TURN_END)).alias("tail"), r["role"].isin(*trained).alias("loss"))).alias("turns"),
        attached.alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: conv_id, messages (role, text) and the texts under the loss mask.

    Placeholders of attachments stay in the texts as they are written.
    """
    pieces = F.split("formatted", TURN_END)  # the end mark has no regex metacharacter
    df = formatted.select("conv_id", "formatted", "turns", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"))
    start = lambda piece: F.locate(HEAD_END, piece) + F.lit(len(HEAD_END))
    return df.select(
        "conv_id", "formatted",
        F.transform("pieces", lambda p: F.struct(unescape(F.substr(p, F.lit(len(HEAD) + 1), F.locate(HEAD_END, p) - F.lit(len(HEAD) + 1))).alias("role"), unescape(F.substr(p, start(p))).alias("text"))).alias("messages"),
        F.transform(F.filter(F.arrays_zip("pieces", "turns"), lambda z: z["turns"]["loss"]), lambda z: unescape(F.substr(z["pieces"], z["turns"]["head"] + 1, z["turns"]["body"]))).alias("loss_texts"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what read_back() finds."""
    back = read_back(formatted)
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
