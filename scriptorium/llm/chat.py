"""Chat formatting with DataFrame functions only: a finite-state machine over roles checks the order of
turns, a declarative template gives text segments with a loss flag each, and a reader takes the formatted
text apart again.

Inside texts the template's control strings are escaped by a backslash and a letter, and backslashes are
doubled, so reading back gives every text unchanged, control strings included.

Nulls: a null text or role counts as empty, rows with a null conv_id form one conversation; a null turn stands first.
Repeated rows are turns of their own; turns of the same number stand in order of role and text. Very long texts are
formatted whole: a conversation is one value of the output, so it must fit a row, however many turns it has. A conversation
whose roles break the order is formatted all the same, with valid = false and the first wrong turn's place.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn, which roles are trained on, and which role may follow which."""

    mark: str = "###"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    other: str = "Role"
    end: str = "</turn>"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    def header(self, role: Column) -> Column:
        named = F.create_map(*[F.lit(x) for pair in self.names.items() for x in pair])
        name = F.coalesce(F.try_element_at(named, role), F.concat(F.lit(f"{self.other} "), F.replace(self.escape(role), F.lit(":"), F.lit("\\c"))))
        return F.concat(F.lit(f"{self.mark} "), name, F.lit(": "))

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        return F.replace(F.replace(out, F.lit(self.mark), F.lit("\\h")), F.lit(self.end), F.lit("\\t"))

    def unescape(self, text: Column) -> Column:
        """Between doubled backslashes, each escape stands for its control string."""

        def part(x: Column) -> Column:
            x = F.replace(F.replace(x, F.lit("\\h"), F.lit(self.mark)), F.lit("\\t"), F.lit(self.end))
            return F.replace(x, F.lit("\\c"), F.lit(":"))

        return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")

    def state_after(self, state: Column, role: Column) -> Column:
        """The machine's step; it has no way out of the state ''."""
        steps = F.create_map(*[F.lit(x) for s, roles in self.follows.items() for r in roles for x in (f"{s}>{r}", r)])
        return F.coalesce(F.try_element_at(steps, F.concat(state, F.lit(">"), role)), F.lit(""))


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Per conversation: conv_id, segments (text, loss), formatted text, valid, bad_turn (place from 0, null if none)."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def segments(t: Column) -> Column:
        return F.array(
            F.struct(template.header(t["role"]).alias("text"), F.lit(False).alias("loss")),
            F.struct(template.escape(t["text"]).alias("text"), t["role"].isin(*template.trained).alias("loss")),
            F.struct(F.lit(f"{template.end}\n").alias("text"), F.lit(False).alias("loss")),
        )

    def step(seen: Column, t: Column) -> Column:
        state = template.state_after(seen["state"], t["role"])
        good = seen["good"] + F.when(state != "", 1).otherwise(0)
        return F.struct(state.alias("state"), good.alias("good"))

    walked = F.aggregate("turns", F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("good")), step)
    out = talks.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), walked.alias("walk"))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("walk.state") != "").alias("valid"),
        F.when(F.col("walk.state") == "", F.col("walk.good")).alias("bad_turn"),
    )


def read_formatted(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    roles = F.create_map(*[F.lit(x) for role, name in template.names.items() for x in (name, role)])
    names = "|".join(template.names.values())
    pattern = rf"(?s)^\Q{template.mark}\E (?:({names})|{template.other} ([^:]*)): (.*)$"

    def turn(piece: Column) -> Column:
        known, other = F.regexp_extract(piece, pattern, 1), F.regexp_extract(piece, pattern, 2)
        return F.struct(
            F.coalesce(F.try_element_at(roles, known), template.unescape(other)).alias("role"),
            template.unescape(F.regexp_extract(piece, pattern, 3)).alias("text"),
        )

    pieces = F.split(formatted, rf"\Q{template.end}\E\n")
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 formatted and read back."""
    template = ChatTemplate()
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = format_conversations(turns.unionByName(extra), template).select("conv_id", "segments", "valid", "bad_turn")
    # All that follows is read from the one output, the segments: the text they make, and the part under their loss flags.
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    back = done.withColumn("formatted", text).withColumns({"turns": read_formatted(F.col("formatted"), template), "learned": F.array_join(masked, "")})
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("bad_turn").cast("long").alias("bad_turn"),
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(n)
), e AS (
  SELECT *, CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS code,
    replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS escaped,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE 'Role ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') END AS name
  FROM c
), a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(len('### ' || name || ': ' || escaped || '</turn>' || chr(10))) AS chars, string_agg(code, '' ORDER BY turn NULLS FIRST, role, text) AS codes
  FROM e GROUP BY conv_id
), v AS (
  SELECT *, len(regexp_extract(codes, '^s?(?:ua)*u?')) AS good FROM a
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
  good = n_turns AS valid, CASE WHEN good < n_turns THEN good END AS bad_turn
FROM v
"""
