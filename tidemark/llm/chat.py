"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. The parser is
deterministic: it splits at turn marks and undoes escapes. A turn is first rendered as it is and
parsed back; where the parser does not return the very role and text, the turn's content is
rendered escaped, which the parser always undoes. ``format_conversations`` compares the parsed
turns with the source once more and raises if any differ.

Escape: an opener (``<`` or ``[``), any backslashes, then the rest of a control string, gets one more
backslash; the parser removes one. The map is one to one, so texts that hold escapes survive. In
roles, ``%``, line ends, ``<`` and ``[`` become percent codes.

Everything is built from DataFrame functions. A conversation is one string by its nature, so its
turns meet in one row; nothing wider than a conversation does.

Edge cases: a null text or role is empty; turns are ordered by turn, null first, ties by role and
then text; repeated rows are turns of their own; rows with a null conv_id form one conversation; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this template and of two common others.
CONTROL_STRINGS = (START, END, "<s>", "</s>", "[INST]", "[/INST]")
_TAIL = r"(?=\|im_(?:start|end)\|>|/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*+)" + _TAIL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*+)" + _TAIL, "$1$2")


_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def escape_role(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def parse(formatted: Column) -> Column:
    """Turns of a rendered conversation: array of (role, text, chars, cut).

    A turn is well formed if it has one end mark, at its end, and no control string in its text; the
    text of any other is null. ``chars`` counts the code points after the start mark, ``cut`` those
    up to the end of the role's line.
    """
    # "<|im_start|>" starts every chunk but the first, which is empty; a chunk ends in "<|im_end|>\n"
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    chunks = F.slice(parts, F.lit(2), F.size(parts))

    def turn(chunk: Column) -> Column:
        cut, end = F.instr(chunk, "\n"), F.instr(chunk, END)
        body = F.substring(chunk, cut + 1, end - cut - 1)
        clean = ~body.rlike(r"[<\[]" + _TAIL) & (end > cut) & (end + len(END) == F.length(chunk))
        return F.struct(
            unescape_role(F.substring(chunk, F.lit(1), cut - 1)).alias("role"),
            F.when(clean, unescape(body)).alias("text"),
            F.length(chunk).cast("long").alias("chars"),
            cut.cast("long").alias("cut"),
        )

    return F.transform(chunks, turn)


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): conv_id, n_turns, formatted, loss_spans.

    ``loss_spans`` holds (start, chars) of the assistant texts in ``formatted``, in code points.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = rows.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("__t"))
    # each turn is rendered as it is; where parsing does not give it back, its content is escaped
    raw_role, raw_text = F.col("__t.role"), F.col("__t.text")
    plain = _rendered(raw_role, raw_text)
    back = parse(plain)
    same = (F.size(back) == 1) & F.coalesce((back[0]["role"] == raw_role) & (back[0]["text"] == raw_text), F.lit(False))
    safe = ~raw_text.rlike(r"[<\[]") & ~raw_role.rlike(r"[%\n<\[]")  # nothing to find there: no need to parse
    turns = turns.withColumn("__r", F.when(safe, plain).when(same, plain).otherwise(_rendered(escape_role(raw_role), escape(raw_text))))
    packed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("__t", "__r"))).alias("__all"))
    formatted = packed.select("conv_id", F.transform("__all", lambda x: x["__t"]).alias("__source"), F.array_join(F.transform("__all", lambda x: x["__r"]), "").alias("formatted"))
    parsed = formatted.withColumn("__parsed", parse(F.col("formatted")))
    pair = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    equal = F.transform("__source", pair) == F.transform("__parsed", pair)
    return parsed.select(
        "conv_id",
        F.size("__parsed").cast("long").alias("n_turns"),
        F.when(equal, F.col("formatted")).otherwise(F.raise_error(F.lit("a rendered conversation does not parse back to its turns"))).alias("formatted"),
        _loss_spans(F.col("__parsed")).alias("loss_spans"),
    )


def _loss_spans(parsed: Column) -> Column:
    """Spans of assistant texts, from the lengths of the chunks before them."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + len(START) + x["cut"]
        chars = x["chars"] - x["cut"] - len(END) - 1
        span = F.array(F.struct(start.alias("start"), chars.alias("chars")))
        return F.struct((acc["at"] + len(START) + x["chars"]).alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parsed, zero, add, lambda acc: acc["spans"])


def digest(formatted: DataFrame) -> DataFrame:
    """What the rendered strings say, read back from them: the columns of the contract."""
    parsed = formatted.withColumn("__p", parse(F.col("formatted")))
    one = F.array_join(F.transform("__p", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")
    return parsed.select(
        "conv_id",
        F.size("__p").cast("long").alias("n_turns"),
        F.sha2(one, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
