"""Chat formatting with a grammar round trip, in SQL functions alone.

Method. Each turn is rendered as  <s>role \\n text </s>  (without the blanks). A deterministic parser splits at </s>, takes what
stands before the first line break as the role, and undoes escapes. A turn with a control string in its role or text, or whose
own rendering the parser doesn't read back as it was, is escaped: after the opening bracket of <s>, </s>, <<SYS>>, <</SYS>>, [INST] and [/INST] a ~ is put, and
one more where there is one already, so the escape is undone by taking one ~ away, and other texts stay as they are. Then whole
conversations are parsed and compared with their source; one that still differs stops the job.

Defined results. Turns are in order of turn, role, text (null turns first); repeated rows are turns of their own. A null role or
text is empty. Rows with a null conv_id are one conversation. Line breaks, tabs and % in roles are written as %0A, %09 and %25.
Other columns are left out. Empty tables give empty results. A conversation is one value, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
_CONTROL = r"([<\[])(~*)(/?(?:s>|SYS>>|INST\]))"
_ESCAPED = r"([<\[])~(~*)(/?(?:s>|SYS>>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _name(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("\t", "%09")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role(name: Column) -> Column:
    for a, b in (("%09", "\t"), ("%0A", "\n"), ("%25", "%")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def _render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), body, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation; text is null where the grammar is broken."""

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = F.when(part.startswith(OPEN + "\n") | head.startswith(OPEN), F.substr(part, F.char_length(head) + 2))
        return F.struct(_role(unescape(F.substr(head, F.lit(len(OPEN) + 1)))).alias("role"), unescape(body).alias("text"))

    parts = F.split(formatted, CLOSE)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, n_turns of conversations (conv_id, turn, role, text)."""
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    plain = _render(_name(F.col("role")), F.col("text"))
    tried = rows.withColumn("plain", plain).withColumn("same", (parse(F.col("plain")) == source) & ~F.col("role").rlike(_CONTROL) & ~F.col("text").rlike(_CONTROL))
    rendered = F.when(F.col("same"), F.col("plain")).otherwise(_render(escape(_name(F.col("role"))), escape(F.col("text"))))
    turns = tried.select("conv_id", F.struct("turn", "role", "text", rendered.alias("rendered")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    joined = whole.select("conv_id", F.array_join(F.col("ts.rendered"), "").alias("formatted"), F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    broken = F.raise_error(F.concat(F.lit("conversation doesn't read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return joined.select("conv_id", F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(broken.cast("string")).alias("formatted"), F.size("source").cast("long").alias("n_turns"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array<struct<role, text>>), formatted_chars of rendered conversations (conv_id, formatted)."""
    return formatted.select("conv_id", parse(F.col("formatted")).alias("turns"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """What the loss mask covers, unescaped: the texts of a role in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def turns_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
